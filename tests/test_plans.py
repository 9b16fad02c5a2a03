"""Distributed patterns against plain pandas on small series cut into tiny blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlattice.operators import indicators as I
from barlattice.plans.asof import asof
from barlattice.plans.blocks import Series, running, with_halo
from barlattice.plans.ranges import extremes_between
from barlattice.plans.touch import first_touch
from tests.conftest import START, make_bars, to_spark


def collect(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("block_rows", [7, 64, None])
@pytest.mark.parametrize("span", [2, 3, 14, 60])
def test_ema_equals_pandas(bars, bars_pdf, span, block_rows):
    s = Series(bars, block_rows=block_rows)
    name = s.ema("y", "close", span)
    got = collect(s.select(name, "_rn"), "symbol", "ts")
    want = bars_pdf.sort_values(["symbol", "ts"]).groupby("symbol")["close"].transform(
        lambda x: x.ewm(span=span, adjust=False).mean()).to_numpy()
    np.testing.assert_allclose(got["y"], want, rtol=1e-12)
    assert (got.groupby("symbol")["_rn"].apply(list).map(lambda v: v == list(range(1, len(v) + 1)))).all()


def stacked(bars, block_rows):
    s = Series(bars, block_rows=block_rows)
    I.compression(s, I.bollinger(s, 10)["norm_width"], 30, 0.25)
    I.trend_t(s, 20)
    I.vol_regime(s, 10, 40)
    I.stretch(s)
    I.structure(s, 8)
    I.fractal_levels(s, 6)
    I.half_life(s, 20)
    return s.frame()


def test_result_does_not_depend_on_blocks_or_partitions(bars):
    a = collect(stacked(bars, None), "symbol", "ts")
    b = collect(stacked(bars.repartition(3, "close"), 11), "symbol", "ts")
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert (a[c].fillna("?") == b[c].fillna("?")).all(), c


def test_no_look_ahead(bars):
    cut = START + dt.timedelta(days=12)
    whole = collect(stacked(bars, 50).where(F.col("ts") < F.lit(cut)), "symbol", "ts")
    part = collect(stacked(bars.where(F.col("ts") < F.lit(cut)), 50), "symbol", "ts")
    skip = {"_high_lead1", "_low_lead1", "_pivot_high", "_pivot_low"}  # judged at the pivot's centre
    for c in set(whole.columns) - skip:
        if whole[c].dtype == float:
            np.testing.assert_allclose(whole[c], part[c], rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert (whole[c].fillna("?") == part[c].fillna("?")).all(), c


def test_halo_keeps_each_row_once(bars):
    h = with_halo(bars, ["symbol", "timeframe"], back=25, ahead=2, block_rows=13)
    assert h.where("_own").count() == bars.count()
    assert h.select("symbol", "_block").distinct().count() > 10


@pytest.mark.parametrize("parts", [1, 24, 1440])
def test_running_equals_cumulative(bars, bars_pdf, parts):
    got = collect(running(bars, ["symbol"], "ts", sums={"s": "volume"}, maxes={"m": "high"}, lasts={"l": "close"},
                          parts=parts), "symbol", "ts")
    p = bars_pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    np.testing.assert_allclose(got["s"], p.groupby("symbol")["volume"].cumsum())
    np.testing.assert_allclose(got["m"], p.groupby("symbol")["high"].cummax())
    np.testing.assert_allclose(got["l"], p["close"])


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 24, 1440])
def test_asof_equals_merge_asof(spark, bars, bars_pdf, forward, strict, parts):
    rng = np.random.default_rng(5)
    base = bars_pdf.iloc[::3][["symbol", "ts"]].copy()
    base["ts"] = base["ts"] + pd.to_timedelta(rng.integers(-2, 3, len(base)) * 30, unit="min")
    base = pd.concat([base, pd.DataFrame({"symbol": ["A", "B"], "ts": [START - dt.timedelta(days=90), START + dt.timedelta(days=400)]})])
    base = pd.concat([base, base.iloc[[50] * 40]])  # copies of one timestamp
    base["pid"] = range(len(base))
    probes = to_spark(spark, base, "symbol string, ts timestamp_ntz, pid int")
    got = asof(probes, bars, ["symbol"], "ts", "ts", {"close": "px"}, forward=forward, strict=strict, parts=parts)
    got = got.toPandas().sort_values("pid")
    want = pd.merge_asof(base.sort_values("ts"), bars_pdf[["symbol", "ts", "close"]].sort_values("ts"), on="ts", by="symbol",
                         direction="forward" if forward else "backward", allow_exact_matches=not strict).sort_values("pid")
    np.testing.assert_allclose(got["px"].astype(float), want["close"].astype(float))


def test_asof_of_one_busy_day(spark):
    """One key, one day, most probes at one timestamp; facts are read once and probes at most twice."""
    day = dt.datetime(2024, 3, 1)
    facts = spark.createDataFrame([("A", day + dt.timedelta(seconds=i), float(i)) for i in range(3000)],
                                  "symbol string, ts timestamp_ntz, px double")
    times = [day + dt.timedelta(seconds=1500.5)] * 5000 + [day + dt.timedelta(seconds=i * 3) for i in range(900)]
    probes = spark.createDataFrame([("A", t, i) for i, t in enumerate(times)] + [(None, day, -1), ("A", None, -2)],
                                   "symbol string, ts timestamp_ntz, pid int")
    got = {r.pid: r.px for r in asof(probes, facts, ["symbol"], "ts", "ts", {"px": "px"}).collect()}
    assert got == {**{i: 1500.0 for i in range(5000)}, **{5000 + i: float(3 * i) for i in range(900)}, -1: None, -2: None}


@pytest.fixture(scope="module")
def long_bars(spark):
    pdf = make_bars(400, ("A", "B"), seed=9, step_minutes=600, gap_every=9)
    return pdf, to_spark(spark, pdf).cache()


def test_first_touch_equals_scan(spark, long_bars):
    pdf, b = long_bars
    rng = np.random.default_rng(1)
    p = pdf.sample(120, random_state=2)[["symbol", "timeframe", "ts", "close"]].reset_index(drop=True)
    p["up"] = p["close"] + rng.uniform(1, 40, len(p))
    p["down"] = p["close"] - rng.uniform(1, 40, len(p))
    p.loc[p.index % 11 == 0, "up"] = None
    p["pid"] = range(len(p))
    probes = spark.createDataFrame(
        [(r.symbol, r.timeframe, r.ts.to_pydatetime(), None if pd.isna(r.up) else float(r.up), float(r.down), int(r.pid))
         for r in p.itertuples()],
        "symbol string, timeframe string, ts timestamp_ntz, up double, down double, pid int")
    got = first_touch(probes, b, ["symbol", "timeframe"], "pid", "ts", "up", "down", ["close"]).toPandas().set_index("pid")
    assert len(got) == len(p)
    for r in p.itertuples():
        later = pdf[(pdf.symbol == r.symbol) & (pdf.ts > r.ts)]
        up = np.inf if pd.isna(r.up) else r.up
        hit = later[(later.high >= up) | (later.low <= r.down)]
        want = hit.ts.min() if len(hit) else pd.NaT
        have = got.loc[r.pid, "hit_ts"]
        assert (pd.isna(want) and pd.isna(have)) or pd.Timestamp(have) == want


def test_extremes_equal_scan(spark, long_bars):
    pdf, b = long_bars
    rng = np.random.default_rng(4)
    a = pdf.sample(80, random_state=3)[["symbol", "ts"]].reset_index(drop=True)
    a["end"] = a["ts"] + pd.to_timedelta(rng.integers(0, 200, len(a)) * 24 + rng.integers(0, 24, len(a)), unit="h")
    a["sid"] = range(len(a))
    spans = to_spark(spark, a, "symbol string, entry timestamp_ntz, done timestamp_ntz, sid int")
    got = extremes_between(spans, b, ["symbol"], "sid", "entry", "done").toPandas().set_index("sid")
    for r in a.itertuples():
        w = pdf[(pdf.symbol == r.symbol) & (pdf.ts > r.ts) & (pdf.ts <= r.end)]
        if len(w):
            assert got.loc[r.sid, "max_high"] == w.high.max() and got.loc[r.sid, "min_low"] == w.low.min()
        else:
            assert r.sid not in got.index


def test_extremes_within_a_day_and_over_years(spark):
    rng = np.random.default_rng(8)
    pdf = make_bars(3000, ("A", "B"), seed=11, step_minutes=7, gap_every=13)
    far = pdf[pdf.symbol == "A"].iloc[:40].assign(ts=lambda x: x.ts + pd.Timedelta(days=1900))
    pdf = pd.concat([pdf, far], ignore_index=True)
    pdf.loc[pdf.index % 17 == 0, ["high", "low"]] = None
    b = spark.createDataFrame([(r.symbol, r.ts.to_pydatetime(), None if pd.isna(r.high) else r.high, None if pd.isna(r.low) else r.low)
                               for r in pdf.itertuples()], "symbol string, ts timestamp_ntz, high double, low double")
    t0 = pdf.ts.min()
    minutes = rng.integers(-300, 20000, 150)
    width = rng.choice([0, 1, 7, 30, 59, 60, 61, 200, 1000, 1440, 1441, 9000, 1900 * 1440, 2500 * 1440], 150)
    a = pd.DataFrame({"symbol": rng.choice(["A", "B", "C"], 150), "ts": [t0 + pd.Timedelta(minutes=int(m)) for m in minutes]})
    a["end"] = a["ts"] + pd.to_timedelta(width, unit="m")
    a["sid"] = range(len(a))
    got = extremes_between(to_spark(spark, a, "symbol string, entry timestamp_ntz, done timestamp_ntz, sid int"), b, ["symbol"], "sid", "entry", "done")
    got = got.toPandas().set_index("sid")
    seen = 0
    for r in a.itertuples():
        w = pdf[(pdf.symbol == r.symbol) & (pdf.ts > r.ts) & (pdf.ts <= r.end)]
        if w.high.notna().any():
            seen += 1
            assert got.loc[r.sid, "max_high"] == w.high.max() and got.loc[r.sid, "min_low"] == w.low.min()
        else:
            assert r.sid not in got.index or pd.isna(got.loc[r.sid, "max_high"])
    assert seen > 40
