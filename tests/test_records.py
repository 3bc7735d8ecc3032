"""Record rules, scalar functions, exports and the store."""

from __future__ import annotations

import datetime as dt
import os
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.functions import candles as K
from tickloom.functions import scalars as P
from tickloom.operators import validate as Q
from tickloom.sources import export, history
from tickloom.sources import ticks as X
from tickloom.sources.store import KeyedStore, KeyNotFound

UTC = dt.timezone.utc
AT = dt.datetime(2025, 1, 20, 10, tzinfo=UTC)


def violations(checked):
    return [r["violations"] for r in checked.collect()]


def test_tick_rules(spark):
    rows = [
        (AT, "eurusd", 1.1, 1.2, 1.0),
        (AT, "EUR", 1.1, 1.2, 1.0),
        (AT, "EURUSD", 0.0, 1.2, 1.0),
        (AT, "EURUSD", float("nan"), 1.2, 1.0),
        (AT, "EURUSD", 1.2, 1.2, 1.0),
        (AT, "EURUSD", 1.1, 1.2, -1.0),
        (AT, "EURUSD", 1.1, 1.2, None),
        # closer than float32 can tell
        (AT, "EURUSD", 1.1, 1.1, 1.0),
    ]
    checked = Q.validate_ticks(spark.createDataFrame(rows, S.TICK))
    assert violations(checked) == [
        [],
        ["symbol_length"],
        ["bid_not_positive"],
        ["bid_not_positive", "ask_not_above_bid"],
        ["ask_not_above_bid"],
        ["volume_negative"],
        [],
        ["ask_not_above_bid"],
    ]
    good = Q.good(checked).collect()
    assert [r["symbol"] for r in good] == ["EURUSD", "EURUSD"] and good[1]["volume"] == 0.0
    assert Q.quarantine(checked).count() == 6


def test_bar_rules(spark):
    def bar(o, h, l, c, v=1.0, tf="H1"):
        return (AT, "EURUSD", tf, o, h, l, c, v)

    rows = [bar(2.0, 3.0, 1.0, 2.5), bar(2.0, 1.5, 1.0, 1.2), bar(2.0, 3.0, 2.5, 2.7), bar(2.0, 3.0, 1.0, 4.0), bar(2.0, 3.0, 1.0, 2.0, -1.0), bar(2.0, 3.0, 1.0, 2.0, 1.0, "H9")]
    checked = Q.validate_bars(spark.createDataFrame(rows, S.OHLC))
    assert violations(checked) == [
        [],
        ["high_below_open"],
        ["low_above_open"],
        ["close_outside_range"],
        ["volume_negative"],
        ["unknown_timeframe"],
    ]
    assert Q.invalid_bars(spark.createDataFrame(rows, S.OHLC)).count() == 3


def prediction(**change):
    base = {
        "symbol": "EURUSD",
        "predicted_at": AT,
        "target_timestamp": AT + dt.timedelta(hours=1),
        "prediction_type": "PRICE",
        "predicted_value": 1.1,
        "confidence_score": 0.85,
        "confidence_upper": 1.2,
        "confidence_lower": 1.0,
        "model_version": "v1",
        "metadata": None,
    } | change
    return tuple(base[f.name] for f in S.PREDICTION.fields)


def test_prediction_rules(spark):
    rows = [
        prediction(),
        prediction(confidence_score=1.5),
        prediction(confidence_upper=0.9),
        prediction(target_timestamp=AT),
        prediction(prediction_type="GUESS"),
        prediction(model_version="v" * 51),
        prediction(confidence_upper=None),
    ]
    assert violations(Q.validate_predictions(spark.createDataFrame(rows, S.PREDICTION))) == [
        [],
        ["score_outside_0_1"],
        ["upper_below_lower"],
        ["target_not_after_prediction"],
        ["unknown_prediction_type"],
        ["model_version_too_long"],
        [],
    ]


def alert(**change):
    base = {
        "symbol": "EURUSD",
        "timestamp": AT,
        "alert_type": "PRICE_THRESHOLD",
        "severity": "WARNING",
        "message": "m",
        "threshold_value": 1.0,
        "current_value": 1.1,
        "condition": None,
        "metadata": None,
        "acknowledged": False,
    } | change
    return tuple(base[f.name] for f in S.ALERT.fields)


def test_alert_rules(spark):
    rows = [
        alert(),
        alert(threshold_value=None),
        alert(threshold_value=None, current_value=None),
        alert(message=""),
        alert(message="m" * 501),
        alert(condition="c" * 201),
        alert(severity="LOUD"),
    ]
    df = spark.createDataFrame(rows, S.ALERT)
    assert violations(Q.validate_alerts(df)) == [
        [],
        ["threshold_missing"],
        [],
        ["message_length"],
        ["message_length"],
        ["condition_too_long"],
        ["unknown_severity"],
    ]
    first = df.select(
        P.threshold_exceeded(F.col("alert_type"), F.col("current_value"), F.col("threshold_value")),
        P.threshold_difference(F.col("current_value"), F.col("threshold_value")),
        P.is_severity(F.col("severity"), "WARNING"),
    ).first()
    assert first[0] is True and first[1] == float(np.float32(1.1) - np.float32(1.0)) and first[2] is True


def test_validate_data(spark):
    ticks = spark.createDataFrame([(AT, "EURUSD", 1.1, 1.2, 1.0)], S.TICK)
    assert Q.validate_data(ticks, "tick") == (True, [])
    assert Q.validate_data(ticks.limit(0), "tick") == (False, ["Data is empty"])
    ok, errors = Q.validate_data(ticks.drop("bid"), "tick")
    assert not ok and errors == ["Missing column: bid"]
    assert Q.validate_data(ticks, "trade") == (False, ["Invalid data type: trade"])


def test_float32_scalars(spark):
    rng = np.random.default_rng(1)
    bid = rng.uniform(0.5, 200, 2000).astype("float32")
    ask = (bid + rng.uniform(0, 0.5, 2000).astype("float32")).astype("float32")
    df = spark.createDataFrame(list(zip(range(2000), bid.tolist(), ask.tolist())), "i int, bid double, ask double")
    out = df.select("i", P.spread(F.col("bid"), F.col("ask")).alias("s"), P.mid_price(F.col("bid"), F.col("ask")).alias("m")).orderBy("i").toPandas()
    assert (out["s"].to_numpy() == (ask - bid)).all()
    assert (out["m"].to_numpy() == ((bid + ask) / np.float32(2)).astype("float32")).all()


def test_high_confidence_uses_the_widened_float32(spark):
    df = spark.createDataFrame([(0.7,), (0.70001,), (0.85,)], "s double")
    assert [r[0] for r in df.select(P.is_high_confidence(F.col("s"))).collect()] == [False, True, True]


def test_decimal_round_trip(spark):
    ticks = spark.createDataFrame([(AT, "EURUSD", 1.042, 1.0422, 1.5)], S.TICK)
    decimal = P.ticks_to_decimal(ticks)
    row = decimal.first()
    assert str(row["bid"]) == "1.042000055313110400" and "time" in decimal.columns
    back = P.ticks_to_float(decimal).first()
    assert back["bid"] == ticks.first()["bid"] and back["timestamp"] == row["time"]
    assert P.ticks_to_float(ticks.drop("volume")).first()["volume"] == 0.0
    with pytest.raises(ValueError):
        P.ticks_to_float(ticks.drop("timestamp"))
    text = ticks.select(P.ensure_decimal(F.col("bid"), "float")).first()[0]
    assert float(text) == 1.042


def test_text_follows_the_binary_value(spark):
    values = [0.5, 1.5, 2.5, 1.255, 1.245, 0.125, 0.375, 123.455, 9.995, 59.95, 0.05, 0.0, 1e6, 99.999]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for places in (0, 1, 2, 5):
        out = df.select("i", P.fixed_text(F.col("x"), places).alias("t")).orderBy("i").collect()
        assert [r["t"] for r in out] == [f"{v:.{places}f}" for v in values]


def test_humanised(spark):
    df = spark.createDataFrame([(1_234_567.0, 45.0), (1_234.0, 125.0), (12.0, 5400.0), (1.0, 200_000.0)], "v double, s double")
    out = df.select(P.humanise_volume(F.col("v")), P.humanise_duration(F.col("s"))).collect()
    assert [tuple(r) for r in out] == [("1.23M", "45s"), ("1.23K", "2.1m"), ("12.00", "1.5h"), ("1.00", "2.3d")]


def test_candles(spark):
    rows = [(1.0, 2.0, 0.5, 1.5), (1.5, 2.0, 0.5, 1.0), (1.0, 1.0, 1.0, 1.0), (1.0, 2.0, 0.5, 1.1)]
    o, h, l, c = (F.col(x) for x in "ohlc")
    out = (
        spark.createDataFrame(rows, "o double, h double, l double, c double")
        .select(K.candle_type(o, h, l, c), K.is_bullish(o, c), K.is_bearish(o, c), K.upper_shadow(o, h, c), K.lower_shadow(o, l, c), K.is_doji(o, h, l, c))
        .collect()
    )
    assert [tuple(r) for r in out[:3]] == [
        ("Bullish", True, False, 0.5, 0.5, False),
        ("Bearish", False, True, 0.5, 0.5, False),
        ("Bearish", False, False, 0.0, 0.0, False),
    ]
    assert out[3][0] == "Doji" and out[3][5] is True


def test_raw_rates_and_ticks(spark):
    raw = spark.createDataFrame([(1704067200, 1.1, 1.2, 1.0, 1.15, 100, 3, 7)], S.RAW_RATE)
    bar = history.raw_to_ohlc(raw)
    assert bar.schema == S.FETCHED_OHLC
    assert bar.first()["timestamp"] == dt.datetime(2024, 1, 1) and bar.first()["volume"] == 100.0
    tick = spark.createDataFrame([(1704067200.25, 1.1, 1.2, 0.0, None, 0, 0)], S.RAW_TICK)
    row = X.raw_to_ticks(tick, "eurusd").first()
    assert row["timestamp"] == dt.datetime(2024, 1, 1, 0, 0, 0, 250000)
    assert row["volume"] == 0.0 and row["symbol"] == "EURUSD"


def test_timeframes(spark):
    assert S.timeframe("mn1") == "MN" and S.timeframe_seconds("H4") == 14_400
    with pytest.raises(ValueError):
        S.timeframe("M2")
    assert S.empty_frame(spark).schema == S.FETCHED_OHLC


def test_fetch_and_merge(spark):
    def bars(hours, volume):
        rows = [(AT + dt.timedelta(hours=i), "EURUSD", "H1", 1.0, 1.0, 1.0, 1.0, volume) for i in hours]
        return spark.createDataFrame(rows, S.OHLC)

    merged = history.merge_extracts([bars(range(5), 1.0), bars(range(4, 9), 2.0)])
    assert [r["volume"] for r in merged.orderBy("timestamp").collect()] == [1.0] * 5 + [2.0] * 4
    found, missing = history.fetch_ohlc_data(bars([0, 1, 4, 5, 5], 1.0), "eurusd", "H1", "2025-01-20 10:00:00", "2025-01-20 15:00:00")
    assert found.count() == 4 and [r["expected_bars"] for r in missing.collect()] == [3]
    none, _ = history.fetch_ohlc_data(bars([0], 1.0), "EURUSD", "H1", "1999-01-01", "1999-01-02")
    assert none.count() == 0 and none.columns == ["symbol", "timeframe", "timestamp", "open", "high", "low", "close", "volume"]
    with pytest.raises(ValueError):
        history.fetch_ohlc_data(bars([0], 1.0), "EURUSD", "H7", "1999-01-01", "1999-01-02")


def test_tick_scan_and_cursor(tick_frame):
    ticks = tick_frame([(i, 1.0 + i) for i in range(10)])
    assert X.fetch_tick_data(ticks, "eurusd", "2025-01-20 10:00:02", "2025-01-20 10:00:05").count() == 4
    assert X.fetch_tick_data(ticks, "eurusd", "2025-01-20", "2025-01-21", limit=3).count() == 3
    with pytest.raises(X.UnknownSymbol):
        X.fetch_tick_data(ticks, "GBPUSD", "2025-01-20", "2025-01-21")
    assert [r["seq"] for r in X.recent_ticks(ticks, 3).orderBy("seq").collect()] == [7, 8, 9]
    cursor = X.advance_cursor(ticks.filter("seq < 6"))
    assert X.new_ticks(ticks, cursor).count() == 4
    assert X.new_ticks(ticks, None).count() == 10
    batches = X.arrival_batches(ticks, 4).orderBy("batch").collect()
    assert [(b["ticks"], b["running_max"]) for b in batches] == [(4, 4.0), (4, 8.0), (2, 10.0)]


def test_json_record(spark):
    df = spark.createDataFrame([prediction(confidence_upper=None, model_version=None)], S.PREDICTION)
    record = json.loads(export.to_json_record(df).first()["record"])
    assert "confidence_upper" not in record and record["model_version"] is None and record["metadata"] is None
    assert record["confidence_score"] == float(np.float32(0.85))
    assert record["predicted_at"] == "2025-01-20T10:00:00+00:00"


def listed(store, *pattern):
    return sorted(r.key for r in store.list_keys(*pattern).collect())


@pytest.mark.parametrize("symbol", ["#AAPL", "0700", "EUR:USD", "a=b%"])
def test_store_keeps_odd_symbols(spark, tmp_path, tick_frame, symbol):
    store = KeyedStore(spark, str(tmp_path))
    key = f"tick/{symbol}/2025-01-20"
    store.save_partitioned(tick_frame([(i, 1.0 + i) for i in range(3)], symbol=symbol), "tick")
    assert store.table("tick").first().symbol == symbol
    store.save_data(tick_frame([(0, 1.0)], symbol=symbol), key)
    assert [r.symbol for r in store.load_data(key).collect()] == [symbol]
    assert listed(store) == listed(store, f"*/{symbol.replace('[', '[[]')}/*") == [key]
    store.delete_data(key)
    with pytest.raises(KeyNotFound):
        store.load_data(key)


def test_store_refuses_other_symbols(spark, tmp_path, tick_frame):
    with pytest.raises(ValueError):
        KeyedStore(spark, str(tmp_path)).save_data(tick_frame([(0, 1.0)]), "tick/GBPUSD/2025-01-20")


def test_store(spark, tmp_path, tick_frame):
    store = KeyedStore(spark, str(tmp_path))
    ticks = tick_frame([(i, 1.0 + i) for i in range(5)])
    store.save_data(ticks, "tick/EURUSD/2025-01-20", {"source": "test"})
    store.save_data(ticks.limit(2), "tick/EURUSD/2025-01-20", {"source": "again"})
    assert store.load_data("tick/EURUSD/2025-01-20").count() == 2
    meta = store.load_metadata("tick/EURUSD/2025-01-20").first()
    assert meta["metadata"] == {"source": "again"} and meta["saved_at"] is not None
    store.save_data([("x", 1.0)], "note/GBPUSD/2025-01-21", schema="name string, value double")
    assert listed(store) == ["note/GBPUSD/2025-01-21", "tick/EURUSD/2025-01-20"]
    assert listed(store, "tick/EUR*/*") == ["tick/EURUSD/2025-01-20"]
    assert store.query_data("SELECT count(*) AS n FROM tick WHERE symbol = :s", {"s": "EURUSD"}).first()["n"] == 2
    store.delete_data("tick/EURUSD/2025-01-20")
    for call in (store.load_data, store.delete_data, store.load_metadata):
        with pytest.raises(KeyNotFound):
            call("tick/EURUSD/2025-01-20")
    with pytest.raises(ValueError):
        store.load_data("tick")


def test_bulk_save_replaces_only_its_days(spark, tmp_path, tick_frame):
    store = KeyedStore(spark, str(tmp_path))
    store.save_partitioned(tick_frame([(i * 86_400, 1.0) for i in range(3)]), "tick")
    store.save_partitioned(tick_frame([(86_400, 2.0), (86_401, 2.0)]), "tick")
    assert len(listed(store)) == 3
    assert store.load_data("tick/EURUSD/2025-01-21").count() == 2
    assert store.table("tick").count() == 4
    assert store.load_metadata("tick/EURUSD/2025-01-21").first()["saved_at"] is not None


def failing(frame):
    """The rows of a frame, of which some fail while they are written."""
    return frame.withColumn("bid", F.when(F.col("seq") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("bid")))


def test_a_save_that_dies_leaves_the_old_rows(spark, tmp_path, tick_frame, monkeypatch):
    store, key = KeyedStore(spark, str(tmp_path)), "tick/EURUSD/2025-01-20"
    store.save_data(tick_frame([(i, 1.0) for i in range(5)]), key, {"run": "first"})
    opened = store.load_data(key)
    for save in (lambda df: store.save_data(df, key, {"run": "second"}), lambda df: store.save_partitioned(df, "tick")):
        with pytest.raises(Exception, match="lost"):
            save(failing(tick_frame([(i, 2.0) for i in range(9)])))  # dies among the rows
        with monkeypatch.context() as m, pytest.raises(RuntimeError):  # rows are written, the manifest is not
            m.setattr(store, "_rename", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
            save(tick_frame([(i, 2.0) for i in range(9)]))
        again = KeyedStore(spark, str(tmp_path))
        assert [r.bid for r in again.load_data(key).collect()] == [1.0] * 5 == [r.bid for r in again.table("tick").collect()]
        assert again.load_metadata(key).first()["metadata"] == {"run": "first"}
    store.save_data(tick_frame([(0, 3.0)]), key, {"run": "third"})
    assert [r.bid for r in store.load_data(key).collect()] == [3.0] and opened.count() == 5  # an open reader keeps its version
    assert store.vacuum("tick") >= 3 and len(os.listdir(tmp_path / "data" / "tick")) == 1
    assert [r.bid for r in store.table("tick").collect()] == [3.0] and store.load_metadata(key).first()["metadata"] == {"run": "third"}


def test_two_writers_do_not_lose_each_other(spark, tmp_path, tick_frame, monkeypatch):
    one, two = KeyedStore(spark, str(tmp_path)), KeyedStore(spark, str(tmp_path))
    one.save_data(tick_frame([(0, 1.0)]), "tick/EURUSD/2025-01-20")
    seen = one._entries("tick")
    two.save_data(tick_frame([(0, 2.0)]), "tick/EURUSD/2025-01-21")
    monkeypatch.setattr(one, "_entries", lambda kind: seen)  # as if it had looked before the other one published
    one.save_data(tick_frame([(0, 3.0)]), "tick/EURUSD/2025-01-22")
    assert len(listed(two)) == 3


def test_expected_data_type(spark, tmp_path, tick_frame):
    store, key = KeyedStore(spark, str(tmp_path)), "tick/EURUSD/2025-01-20"
    store.save_data(tick_frame([(0, 1.0)]), key)
    assert store.load_data(key, "tick").count() == 1
    with pytest.raises(ValueError, match="ohlc"):
        store.load_data(key, "ohlc")


def test_cross_record_check(spark, tick_frame):
    ticks = tick_frame([(0, 1.0)], symbol="nzdusd")
    bars = spark.createDataFrame([(AT, "NZDUSD", "H1", 1.0, 1.0, 1.0, 1.0, 1.0)], S.OHLC)
    row = Q.cross_record_check(
        ticks, bars, spark.createDataFrame([prediction(symbol="NZDUSD")], S.PREDICTION), spark.createDataFrame([alert(symbol="nzdusd")], S.ALERT)
    ).first()
    assert row["symbol"] == "NZDUSD" and row["times_consistent"]
    assert (row["ticks"], row["bars"], row["predictions"], row["alerts"]) == (1, 1, 1, 1)
