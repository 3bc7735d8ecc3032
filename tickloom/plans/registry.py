"""Named queries and the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Plain column types with rounded numbers, so two engines can be compared by value.

    Six decimals, rounded a little off the half: engines disagree about exact
    halves, and means of prices with two decimals hit them often.
    """
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.floor(c.cast("double") * 1e6 + 0.503) / 1e6
        elif isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, folder: comparable(run(configure(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


# --- SQL building blocks -------------------------------------------------------


def r(*names: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(rx(n, n) for n in names)


def rx(expression: str, name: str) -> str:
    return f"floor(({expression}) * 1e6 + 503e-3) / 1e6 AS {name}"


_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER)"

EV = f"ev AS (SELECT *, {_K} AS k FROM events)"

TICKS = (
    f"{EV}, ticks AS (SELECT 'X_' || upper(event_type) AS symbol, ts, event_id AS seq, value AS bid, "
    "value + 1e-2 * (k + 1) AS ask, CAST(k AS DOUBLE) AS volume FROM ev)"
)

USER_TICKS = (
    f"{EV}, ticks AS (SELECT 'USR' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS symbol, ts, event_id AS seq, "
    "value AS bid, value + 1e-2 * (k + 1) AS ask, CAST(k AS DOUBLE) AS volume FROM ev)"
)

# ticks in disturbed arrival order; ``last_ts`` is the latest time of earlier arrivals
SHUFFLED = (
    f"{TICKS}, shuffled AS (SELECT symbol, ts, (seq + (seq * 7919) % 13) * 64 + seq % 64 AS seq, bid, ask, volume "
    "FROM ticks), timed AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ts FROM shuffled)"
)

LINES = (
    "lines AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, "
    "datediff('day', TIMESTAMP '1970-01-01', l_shipdate) * CAST(281474976710656 AS BIGINT) + (l_orderkey * 8 + l_linenumber) * 64 + l_partkey % 64 AS seq, "
    "l_extendedprice / l_quantity AS bid, (l_extendedprice / l_quantity) * (1e0 + l_tax / 100) AS ask, "
    "l_quantity AS volume FROM lineitem)"
)


def bars_sql(name: str, bucket: str, source: str = "ticks", price: str = "bid") -> str:
    return (
        f"{name} AS (SELECT symbol, {bucket} AS time, arg_min({price}, seq) AS open, max({price}) AS high, "
        f"min({price}) AS low, arg_max({price}, seq) AS close, sum(volume) AS volume, count(*) AS tick_count, "
        f"avg(ask - bid) AS avg_spread FROM {source} GROUP BY 1, 2)"
    )


HOUR = "time_bucket(INTERVAL '1 hour', ts)"
MINUTE = "time_bucket(INTERVAL '1 minute', ts)"
HOURLY = f"{TICKS}, {bars_sql('hourly', HOUR)}"


def seconds(a: str, b: str) -> str:
    """Seconds from a to b."""
    return f"((epoch_us({b}) - epoch_us({a})) / 1e6)"
