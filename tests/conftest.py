from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom import schema as S  # noqa: E402
from tickloom.session import local_session  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


@pytest.fixture
def tick_frame(spark):
    """Builds ticks from (seconds or datetime, bid[, ask[, volume[, symbol]]]) in arrival order."""

    def build(rows, start=dt.datetime(2025, 1, 20, 10, tzinfo=UTC), symbol="EURUSD"):
        out = []
        for i, row in enumerate(rows):
            at, bid, *rest = row
            ts = at if isinstance(at, dt.datetime) else start + dt.timedelta(seconds=at)
            ask = rest[0] if rest else bid + 0.0002
            volume = rest[1] if len(rest) > 1 else 1.0
            name = rest[2] if len(rest) > 2 else symbol
            out.append((name, ts, i, float(bid), float(ask), float(volume)))
        return spark.createDataFrame(out, S.ARRIVED_TICK)

    return build

