"""Records as float32 values, maps of text, or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 with offset; a whole second carries no fraction."""
    text = F.date_format(ts, ISO_FORMAT)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
    out = F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(text)
    return F.regexp_replace(out, "Z$", "+00:00")


def to_float32_record(df: DataFrame) -> DataFrame:
    """Every floating column quantised to float32."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))]
    return df.withColumns({c: F.col(c).cast("float") for c in floating})


def to_json_record(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON object per row. Null float fields are left out, other nulls are written.

    Each field is written on its own and the pieces are joined, which is how both
    kinds of null can live in one object.
    """
    parts = []
    for f in to_float32_record(df).schema.fields:
        value = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            value = iso_timestamp(value)
        optional = isinstance(f.dataType, T.FloatType)
        if optional:
            # the double that holds the float32 value
            value = value.cast("double")
        text = F.to_json(F.struct(value.alias(f.name)), {"ignoreNullFields": "false"})
        inner = F.substring(text, F.lit(2), F.length(text) - 2)
        parts.append(F.when(value.isNotNull(), inner) if optional else inner)
    record = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return to_float32_record(df).select(record.alias(name))
