import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from barlattice.session import get_session  # noqa: E402

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        })
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def make_bars(n=300, symbols=("A", "B"), seed=3, step_minutes=60, gap_every=37):
    """Random walks with gaps; pandas frame in bar layout."""
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        t, price = START, 100.0
        for i in range(n):
            t += dt.timedelta(minutes=step_minutes * (30 if i % gap_every == gap_every - 1 else 1))
            o = price
            c = max(1.0, o + rng.normal(0, 2))
            h, lo = max(o, c) + rng.random(), min(o, c) - rng.random()
            out.append((s, "1h", t, o, h, lo, c, float(rng.integers(1, 50)), (h + lo) / 2, f"{s}{i // 100}"))
            price = c
    return pd.DataFrame(out, columns=["symbol", "timeframe", "ts", "open", "high", "low", "close",
                                      "volume", "average", "contract"])


def to_spark(spark, pdf, ddl=None):
    ddl = ddl or ("symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, "
                  "close double, volume double, average double, contract string")
    rows = [tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r)
            for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def bars_pdf():
    return make_bars()


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return to_spark(spark, bars_pdf).repartition(5).cache()
