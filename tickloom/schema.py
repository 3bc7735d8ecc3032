"""Record layouts, enumerations and timeframe facts shared by every operator.

Schemas are explicit; nothing in the library infers a type.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_F, _S, _TS = T.FloatType(), T.StringType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TICK = _struct(("timestamp", _TS), ("symbol", _S), ("bid", _F), ("ask", _F), ("volume", _F))

# A tick with its arrival number; the layout every ordered operator reads.
ARRIVED_TICK = _struct(
    ("symbol", _S),
    ("ts", _TS),
    ("seq", T.LongType()),
    ("bid", T.DoubleType()),
    ("ask", T.DoubleType()),
    ("volume", T.DoubleType()),
)

OHLC = _struct(
    ("timestamp", _TS),
    ("symbol", _S),
    ("timeframe", _S),
    ("open", _F),
    ("high", _F),
    ("low", _F),
    ("close", _F),
    ("volume", _F),
)

FETCHED_OHLC = _struct(
    ("timestamp", _TS),
    ("open", _F),
    ("high", _F),
    ("low", _F),
    ("close", _F),
    ("volume", _F),
    ("spread", T.IntegerType()),
)

RAW_RATE = _struct(
    ("time", T.LongType()),
    ("open", T.DoubleType()),
    ("high", T.DoubleType()),
    ("low", T.DoubleType()),
    ("close", T.DoubleType()),
    ("tick_volume", T.LongType()),
    ("spread", T.IntegerType()),
    ("real_volume", T.LongType()),
)

RAW_TICK = _struct(
    ("time", T.DoubleType()),
    ("bid", T.DoubleType()),
    ("ask", T.DoubleType()),
    ("last", T.DoubleType()),
    ("volume", T.LongType()),
    ("time_msc", T.LongType()),
    ("flags", T.IntegerType()),
)

PREDICTION = _struct(
    ("symbol", _S),
    ("predicted_at", _TS),
    ("target_timestamp", _TS),
    ("prediction_type", _S),
    ("predicted_value", _F),
    ("confidence_score", _F),
    ("confidence_upper", _F),
    ("confidence_lower", _F),
    ("model_version", _S),
    ("metadata", T.MapType(_S, _S)),
)

ALERT = _struct(
    ("symbol", _S),
    ("timestamp", _TS),
    ("alert_type", _S),
    ("severity", _S),
    ("message", _S),
    ("threshold_value", _F),
    ("current_value", _F),
    ("condition", _S),
    ("metadata", T.MapType(_S, _S)),
    ("acknowledged", T.BooleanType()),
)

# Enumeration domains.
PREDICTION_TYPES = ["PRICE", "DIRECTION", "VOLATILITY"]
ALERT_TYPES = ["PRICE_THRESHOLD", "PATTERN_DETECTED", "RISK_WARNING"]
SEVERITIES = ["INFO", "WARNING", "CRITICAL"]

# Length of each timeframe in minutes. MN is thirty days when an
# interval is needed; its bars follow the calendar.
TIMEFRAME_MINUTES = {
    "M1": 1,
    "M5": 5,
    "M15": 15,
    "M30": 30,
    "H1": 60,
    "H4": 240,
    "D1": 1440,
    "W1": 10080,
    "MN": 43200,
}
_ALIASES = {"MN1": "MN"}

# Display labels.
TIMEFRAME_LABELS = {
    "M1": "1 Minute",
    "M5": "5 Minutes",
    "M15": "15 Minutes",
    "M30": "30 Minutes",
    "H1": "1 Hour",
    "H4": "4 Hours",
    "D1": "Daily",
    "W1": "Weekly",
    "MN": "Monthly",
}


def empty_frame(spark: SparkSession, schema: T.StructType = FETCHED_OHLC) -> DataFrame:
    """Zero rows with the full, typed layout."""
    return spark.createDataFrame([], schema)


def timeframe(name: str) -> str:
    """Canonical timeframe name; an unknown one is an error."""
    key = _ALIASES.get(name.upper(), name.upper())
    if key not in TIMEFRAME_MINUTES:
        raise ValueError(f"unknown timeframe {name!r}; expected one of {sorted(TIMEFRAME_MINUTES)}")
    return key


def timeframe_seconds(name: str) -> int:
    return TIMEFRAME_MINUTES[timeframe(name)] * 60


def _lookup(values: dict[str, object], name: Column) -> Column:
    pairs: Iterable[Column] = (F.lit(x) for item in values.items() for x in item)
    upper = F.upper(name)
    canonical = F.when(upper == "MN1", "MN").otherwise(upper)
    return F.element_at(F.create_map(*pairs), canonical)


def timeframe_minutes_col(name: Column) -> Column:
    """Minutes of a timeframe column; null for an unknown name (see V2/V5 for the check)."""
    return F.try_element_at(
        F.create_map(*(F.lit(x) for item in TIMEFRAME_MINUTES.items() for x in item)),
        F.when(F.upper(name) == "MN1", "MN").otherwise(F.upper(name)),
    )


def timeframe_label_col(name: Column) -> Column:
    return _lookup(TIMEFRAME_LABELS, name)


def bucket_start(ts: Column, tf: str | int) -> Column:
    """Opening instant of the bar that holds ``ts``.

    Seconds and the intraday/daily names floor to the epoch, weeks open on
    Monday, months on the first calendar day.
    """
    if isinstance(tf, str):
        tf = timeframe(tf)
        if tf == "MN":
            return F.date_trunc("month", ts)
    width = (tf if isinstance(tf, int) else timeframe_seconds(tf)) * 1_000_000
    # The epoch was a Thursday; weeks are counted from the Monday after it.
    shift = 4 * 86_400_000_000 if tf == "W1" else 0
    at = F.unix_micros(ts)
    past = F.pmod(at - F.lit(shift), F.lit(width)) if shift else F.pmod(at, F.lit(width))
    return F.timestamp_micros(at - past)


def bucket_end(start: Column, tf: str | int) -> Column:
    """Last microsecond of the bar opened at ``start``."""
    one = F.expr("INTERVAL 1 MICROSECOND")
    if not isinstance(tf, int) and timeframe(tf) == "MN":
        return F.add_months(start, 1).cast("timestamp") - one
    seconds = tf if isinstance(tf, int) else timeframe_seconds(tf)
    return F.timestamp_micros(F.unix_micros(start) + F.lit(seconds * 1_000_000 - 1))
