"""Small literal cases with known answers and sequential loops as references."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlattice.functions import order_stats as OS
from barlattice.functions import probability as PR
from barlattice.plans.blocks import Series
from barlattice.operators import attribution as A
from barlattice.operators import bars as B
from barlattice.operators import brackets as X
from barlattice.operators import execution as E
from barlattice.operators import exits as EX
from barlattice.operators import indicators as I
from barlattice.operators import ledger as L
from barlattice.operators import metrics as M
from barlattice.operators import pnl as PL
from barlattice.operators import predicates as P
from barlattice.operators import quality as Q
from barlattice.operators import risk as R
from barlattice.operators import signals as G
from barlattice.operators import walkforward as K
from barlattice.sources import artifacts as AR
from barlattice.sources import lake as LK
from tests.conftest import START, to_spark

T = dt.datetime


def day(i, h=0, m=0):
    return T(2024, 1, 1, h, m) + dt.timedelta(days=i)


def rows(df, *order):
    return df.orderBy(*order).collect()


def bar(ts, o, h, lo, c, v=1.0, avg=None, con="c", s="ES", tf="5m"):
    return (s, tf, ts, float(o), float(h), float(lo), float(c), float(v), float(avg if avg is not None else c), con)


BAR_DDL = ("symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, "
           "volume double, average double, contract string")


def test_back_adjustment(spark):
    b = spark.createDataFrame([
        bar(day(0), 90, 92, 89, 91, avg=90.5, con="OLD"), bar(day(1), 95, 97, 94, 96, con="MID"),
        bar(day(2), 99, 101, 98, 100, con="NEW")], BAR_DDL)
    got = {r.contract: r for r in B.back_adjust(b).collect()}
    # Gaps: NEW.open - MID.close = 3, MID.open - OLD.close = 4.
    assert got["NEW"].close == 100 and got["MID"].close == 99 and got["OLD"].close == 98
    assert got["OLD"].average == 97.5


def test_broken_roll_and_average_fail(spark):
    b = spark.createDataFrame([
        bar(day(0), 100, 101, 99, 100, con="A"), bar(day(0, 0, 5), 100, 101, 99, 150, avg=500, con="B"),
        bar(day(0, 0, 10), 150, 151, 149, 150, con="B")], BAR_DDL)
    r = Q.validate(b).first()
    assert r.average_outside == 1 and r.roll_jumps == 1 and not r.is_valid
    assert r.high_low_body == 1 and r.quality_score == 0.0


def test_unsupported_timeframe_raises(bars):
    with pytest.raises(ValueError):
        Q.validate_lake(bars, timeframes=["2h"])


@pytest.mark.parametrize("block_rows", [9, None])
def test_range_bars_equal_loop(bars, bars_pdf, block_rows):
    got = B.range_bars(bars, 600, 0.01, block_rows).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = []
    for s, g in bars_pdf.sort_values("ts").groupby("symbol"):
        o = h = lo = None
        vol, made, last = 0.0, 0, None
        for r in g.itertuples():
            if o is None:
                o = h = lo = r.open
            h, lo, vol, last = max(h, r.high), min(lo, r.low), vol + r.volume, r
            if h - lo >= 6.0:
                want.append((s, r.ts, o, h, lo, r.close, vol))
                o = h = lo = r.close
                vol, made = 0.0, made + 1
        if vol > 0 and made:
            want.append((s, last.ts, o, h, lo, last.close, vol))
    want = pd.DataFrame(want, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])
    assert len(got) == len(want)
    for c in ("open", "high", "low", "close", "volume"):
        np.testing.assert_allclose(got[c], want[c], err_msg=c)


def test_range_bars_without_a_close_and_in_a_trend(spark):
    """Blocks that close no bar, bars that span many blocks, and blocks in which every row makes a new high."""
    n = 3000
    rng = np.random.default_rng(2)
    quiet = 100 + 0.2 * np.sin(np.arange(n))
    quiet[-1] = 160.0  # the only close, at the very end
    frames = []
    for s, c in (("Q", quiet), ("T", 100 + 0.01 * np.arange(n)), ("W", 100 + np.cumsum(rng.normal(0, 0.6, n)))):
        frames.append(pd.DataFrame({"symbol": s, "timeframe": "1h", "ts": [START + dt.timedelta(hours=i) for i in range(n)],
                                    "open": c, "high": c, "low": c, "close": c, "volume": 1.0, "average": c, "contract": "x"}))
    pdf = pd.concat(frames, ignore_index=True)
    b = to_spark(spark, pdf)
    got = {k: B.range_bars(b, 700, 0.01, k).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for k in (30, 10**6)}
    pd.testing.assert_frame_equal(got[30], got[10**6])
    assert got[30].groupby("symbol").size().to_dict()["Q"] == 1 and (got[30].symbol == "W").sum() > 20


def test_kalman_over_many_blocks(spark):
    rng = np.random.default_rng(6)
    n = 5000
    x = 50 + np.cumsum(rng.normal(0, 0.3, n))
    y = 3 + np.linspace(0.5, 2.5, n) * x + rng.normal(0, 1, n)
    rows = [START + dt.timedelta(minutes=i) for i in range(n)]
    fx, fy = (spark.createDataFrame([("p", t, float(v)) for t, v in zip(rows, z)], "pair_id string, ts timestamp_ntz, close double") for z in (x, y))
    got = {k: I.kalman_beta(fx, fy, block_rows=k).toPandas().sort_values("ts")["beta"].to_numpy() for k in (200, 10**6)}
    a, b, p, c, d = 0.0, 1.0, 1.0, 0.0, 1.0
    want = [np.nan]
    for xi, yi in zip(x / x[0], y / x[0]):
        p, d = p + 1e-5, d + 1e-5
        u, v = p + xi * c, c + xi * d
        g, e = u + xi * v + 0.1, yi - a - b * xi
        a, b, p, c, d = a + u * e / g, b + v * e / g, p - u * u / g, c - u * v / g, d - v * v / g
        want.append(b)
    for k in got:
        np.testing.assert_allclose(got[k], want[:-1], rtol=1e-9)


@pytest.mark.parametrize("block_rows", [25, None])
def test_kalman_equals_loop(spark, bars_pdf, block_rows):
    a, b = (bars_pdf[bars_pdf.symbol == s][["ts", "close"]] for s in ("A", "B"))
    x, y = (to_spark(spark, d.assign(pair_id="p")[["pair_id", "ts", "close"]], "pair_id string, ts timestamp_ntz, close double") for d in (a, b))
    got = I.kalman_beta(x, y, block_rows=block_rows).toPandas().sort_values("ts")["beta"].to_numpy()
    m = a.merge(b, on="ts").sort_values("ts")
    xs, ys = m.close_x.to_numpy() / m.close_x.iloc[0], m.close_y.to_numpy() / m.close_x.iloc[0]
    state, cov = np.array([0.0, 1.0]), np.eye(2)
    want = [np.nan]
    for xi, yi in zip(xs, ys):
        h = np.array([1.0, xi])
        cov = cov + 1e-5 * np.eye(2)
        gain = cov @ h / (h @ cov @ h + 0.1)
        state = state + gain * (yi - h @ state)
        cov = cov - np.outer(gain, h @ cov)
        want.append(state[1])
    np.testing.assert_allclose(got, want[:-1], rtol=1e-9)


@pytest.mark.parametrize("block_rows", [30, None])
def test_unit_root_statistic_equals_least_squares(spark, block_rows):
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=260)) + 500
    y[100:175] = 480.0  # flat
    rows = [("A", "1h", START + dt.timedelta(hours=i), None if i == 220 else float(v)) for i, v in enumerate(y)]
    s = Series(spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, close double"), block_rows=block_rows)
    got = s.select(F.col(I.unit_root_tau(s, 60)).alias("tau")).toPandas().sort_values("ts")["tau"].astype(float).to_numpy()
    seen = 0
    for i in range(len(y)):
        w = y[max(0, i - 60):i]
        if len(w) < 60 or i - 60 <= 220 < i or len(set(w)) == 1:
            assert np.isnan(got[i]), i
            continue
        dy = np.diff(w)
        x = np.column_stack([w[1:-1], dy[:-1], np.ones(len(dy) - 1)])
        beta, *_ = np.linalg.lstsq(x, dy[1:], rcond=None)
        res = dy[1:] - x @ beta
        s2 = res @ res / (len(res) - 3)
        if res @ res < 1e-9 or np.linalg.matrix_rank(x) < 3:  # fits exactly, or flat but for its end: no statistic
            continue
        want = beta[0] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0])
        assert got[i] == pytest.approx(want, rel=1e-5), i
        seen += 1
    assert seen > 100
    p = spark.createDataFrame([(-2.86,), (-3.43,), (None,), (3.0,), (-19.0,)], "t double").select(PR.adf_p(F.col("t")).alias("p"))
    have = [r.p for r in p.collect()]
    # Published 5% and 1% points of the constant-only test.
    np.testing.assert_allclose(have[:2], [0.05, 0.01], atol=2e-3)
    assert have[2:] == [None, 1.0, 0.0]
    z = spark.range(161).select(((F.col("id") - 80) / 10.0).alias("z")).select("z", PR.normal_cdf(F.col("z")).alias("p")).toPandas()
    np.testing.assert_allclose(z["p"], [0.5 * math.erfc(-v / math.sqrt(2)) for v in z["z"]], atol=1e-14)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 300])
def test_order_statistics_of_windows(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 1)
    x[1::5] = np.nan
    for width in (1, 2, 5, 40, 500):
        rank = OS.rolling_rank(x, width, 1)
        quantile = OS.rolling_quantile(x, width, 2, 0.3)
        tails = OS.rolling_tail(x, width, 1, [0.05, 0.5])
        for i in range(n):
            seen = x[max(0, i - width + 1):i + 1]
            seen = seen[~np.isnan(seen)]
            want = ((seen < x[i]).sum() + 0.5 * (seen == x[i]).sum() + 0.5) / len(seen) if not np.isnan(x[i]) else np.nan
            assert rank[i] == pytest.approx(want, nan_ok=True)
            assert quantile[i] == pytest.approx(np.quantile(seen, 0.3) if len(seen) > 1 else np.nan, nan_ok=True)
            for q, (limit, mean) in zip((0.05, 0.5), tails):
                cut = np.quantile(seen, q) if len(seen) else np.nan
                assert limit[i] == pytest.approx(cut, nan_ok=True)
                assert not len(seen) or not (seen <= limit[i]).any() or mean[i] == pytest.approx(seen[seen <= limit[i]].mean())


@pytest.mark.parametrize("history, block_rows", [(500, 100), (500, None), (5000, None)])
def test_volatility_percentile_at_long_histories(spark, history, block_rows):
    rng = np.random.default_rng(3)
    c = np.round(100 + np.cumsum(rng.normal(size=7000)), 1)
    rows = [("A", "1h", START + dt.timedelta(hours=i), float(v)) for i, v in enumerate(c)]
    s = Series(spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, close double"), block_rows=block_rows)
    name = I.vol_percentile(s, 10, history)
    got = s.select(F.col(name).alias("p"), "_vol_10").toPandas().sort_values("ts")
    vol = got["_vol_10"].astype(float).to_numpy()
    have = got["p"].astype(float).to_numpy()
    for i in [*range(0, 400, 7), *range(400, 7000, 211)]:
        seen = vol[max(0, i - history + 1):i + 1]
        seen = seen[~np.isnan(seen)]
        want = ((seen < vol[i]).sum() + 0.5 * (seen == vol[i]).sum() + 0.5) / len(seen) if len(seen) >= history // 2 else np.nan
        assert have[i] == pytest.approx(want, nan_ok=True), i


def test_distribution_functions():
    p = np.array([1e-9, 0.001, 0.3, 0.5, 0.975, 1 - 1e-9])
    np.testing.assert_allclose(PR.norm_ppf_np(p), [NormalDist().inv_cdf(v) for v in p], rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(PR.norm_cdf_np(PR.norm_ppf_np(p)), p, rtol=1e-9)
    # Student-t table values.
    np.testing.assert_allclose(PR.t_two_sided_np([2.228, 12.706, 1.96, 0.0], [10, 1, 1e6, 5]), [0.05, 0.05, 0.05, 1.0], atol=2e-4)


TRADE = ("trade_id string, slot_id int, symbol string, direction string, entry_time timestamp_ntz, exit_time timestamp_ntz, "
         "entry_price double, quantity double, commission double, slippage double, multiplier double")


def test_excursions_leave_out_the_entry_bar(spark):
    b = spark.createDataFrame([
        bar(day(0, 9, 30), 100, 150, 50, 100), bar(day(0, 10), 100, 103, 99, 102), bar(day(0, 10, 30), 102, 102, 98, 101)], BAR_DDL)
    t = spark.createDataFrame([("t", 0, "ES", "LONG", day(0, 9, 30), day(0, 10, 30), 100.0, 1.0, 0.0, 0.0, 1.0)], TRADE)
    r = EX.enrich(t, b, 2, 4).first()
    assert r.mfe == 3.0 and r.mae == -2.0 and r.hold_minutes == 60.0


def test_forward_pnl_uses_the_last_close_before(spark):
    b = spark.createDataFrame([
        bar(day(0, 9, 30), 100, 100, 100, 100), bar(day(0, 9, 35), 100, 101, 100, 101), bar(day(0, 9, 45), 101, 102, 101, 102)], BAR_DDL)
    t = spark.createDataFrame([("t", 0, "ES", "LONG", day(0, 9, 30), day(0, 9, 45), 100.0, 1.0, 0.0, 0.0, 1.0)], TRADE)
    r = EX.forward_pnl(t, b).first()
    assert r.pnl_decay_5m == 1.0 and r.pnl_decay_15m == 2.0 and r.pnl_decay_1440m == 2.0


def test_drawdown_episodes(spark):
    values = [0.0, -5.0, -2.0, 0.0, 0.0, -3.0, -7.0, -1.0]
    d = spark.createDataFrame([("s", day(i), v) for i, v in enumerate(values)], "stream string, ts timestamp_ntz, drawdown_pct double")
    got = rows(R.episodes(d), "start_ts")
    assert [(r.depth_pct, r.duration_days) for r in got] == [(-5.0, 2.0), (-7.0, 2.0)]
    assert got[1].trough_ts == day(6) and got[1].end_ts == day(7)


def test_slot_equity_with_weight_and_missing_value(spark):
    h = spark.createDataFrame([("0", day(i), 50000.0 + i) for i in range(4)], "run_id string, ts timestamp_ntz, total_value double")
    s = spark.createDataFrame([("0", 0, day(i), v) for i, v in enumerate([None, 100.0, 50.0, 150.0])],
                              "run_id string, slot_id int, ts timestamp_ntz, cum_pnl double")
    w = spark.createDataFrame([(0, 0.5)], "slot_id int, weight double")
    assert [r.equity for r in rows(PL.slot_equity(s, h, w), "ts")] == [25000.0, 25100.0, 25050.0, 25150.0]


def test_stress_keeps_the_first_day_and_baseline(spark):
    d = spark.createDataFrame([("s", day(i).date(), e) for i, e in enumerate([1000.0, 1010.0, 990.0, 1020.0])], "stream string, day date, equity double")
    daily = PL.with_daily_change(d, ["stream"])
    cost = spark.createDataFrame([("s", day(1).date(), 2.0, 4.0)], "stream string, day date, commission double, slippage double")
    same = R.stress_paths(daily, cost, {"volatility": 1.0, "slippage": 1.0, "commission": 1.0}).toPandas()
    wide = same.pivot(index="day", columns="scenario", values="equity")
    for c in R.SCENARIOS:
        np.testing.assert_allclose(wide[c], wide["baseline"])
    half = R.stress_paths(daily, cost, {"volatility": 0.5, "slippage": 0.5, "commission": 0.5}).toPandas()
    pnl = half.pivot(index="day", columns="scenario", values="pnl")
    assert pnl["volatility"].iloc[0] == 0.0 and pnl["slippage"].iloc[1] == pytest.approx(10 + 2.0)


def test_deflated_sharpe_falls_with_trials(spark):
    rng = np.random.default_rng(7)
    eq = 1000 * np.cumprod(1 + rng.normal(0.001, 0.01, 300))
    e = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(eq)], "stream string, ts timestamp_ntz, equity double")
    t = spark.createDataFrame([("s", float(v)) for v in rng.normal(0, 0.05, 40)], "stream string, sharpe double")
    one = M.performance(e, period_seconds=PL.YEAR).first()
    many = M.performance(e, trials=200, trial_sharpes=t, period_seconds=PL.YEAR).first()
    assert 0 < many.dsr < one.dsr < 1
    r = pd.Series(eq).pct_change().dropna()
    assert one.t_stat == pytest.approx(r.mean() / (r.std() / math.sqrt(len(r))))
    assert one.max_drawdown == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())


@pytest.mark.parametrize("span", [2, 5, 20])
@pytest.mark.parametrize("block_rows", [16, 200, None])
def test_exponential_mean_over_gaps_equals_pandas(spark, span, block_rows):
    rng = np.random.default_rng(8)
    x = rng.normal(100, 5, 300)
    x[:7] = np.nan
    x[rng.random(300) < 0.2] = np.nan
    x[120:128] = np.nan
    rows = [("A", "1h", START + dt.timedelta(hours=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    b = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, x double")
    s = Series(b, block_rows=block_rows)
    s.ema("y", "x", span)
    got = s.select("y").toPandas().sort_values("ts")["y"].astype(float)
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=span, adjust=False).mean(), rtol=1e-9)


@pytest.mark.parametrize("block_rows", [24, 500])
def test_exponential_means_carry_over_any_gap(spark, block_rows):
    rng = np.random.default_rng(4)
    x = [np.nan] * 3
    for gap in (1, 2, 7, 40, 130, 400, 1500, 10_000, 5, 90):
        x += [*rng.normal(100, 5, int(rng.integers(1, 60))), *[np.nan] * gap]
    x = np.array(x + [100.0] * 5)
    rows = [("A", "1h", START + dt.timedelta(hours=i), None if np.isnan(v) else float(v), 1.0) for i, v in enumerate(x)]
    b = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, x double, one double")
    s = Series(b, block_rows=block_rows)
    for span in (2, 14):
        s.ema(f"y{span}", "x", span)
    s.add("z", F.col("x") - F.col(s.lag("x")), ["x", s.lag("x")])  # looks back one row
    s.ema("ez", "z", 3)
    s.ema("eo", "one", 5)
    got = s.select("y2", "y14", "ez", "eo").toPandas().sort_values("ts").astype({c: float for c in ("y2", "y14", "ez", "eo")})
    p = pd.Series(x)
    for name, want in (("y2", p.ewm(span=2, adjust=False).mean()), ("y14", p.ewm(span=14, adjust=False).mean()),
                       ("ez", p.diff().ewm(span=3, adjust=False).mean())):
        np.testing.assert_allclose(got[name], want, rtol=1e-9, atol=1e-9, err_msg=name)
    assert len(got) == len(x) and np.allclose(got["eo"], 1.0)


def test_trade_stats_edges(spark):
    none = spark.createDataFrame([], "pnl double")
    r = M.trade_stats(none).first()
    assert r.total_trades == 0 and r.win_rate == 0.0 and r.profit_factor == 0.0
    wins = spark.createDataFrame([(1.0,), (2.0,)], "pnl double")
    assert M.trade_stats(wins).first().profit_factor == math.inf


def fills_frame(spark, seed=11, n=200):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([
        ("0", int(rng.integers(0, 2)), "ES", START + dt.timedelta(minutes=13 * i), i, "BUY" if rng.random() < 0.5 else "SELL",
         float(rng.integers(1, 6)), float(round(100 + rng.normal(0, 3), 2)), float(rng.integers(1, 5)), 0.01, 5.0, 0.1)
        for i in range(n)],
        "run_id string, slot_id int, symbol string, ts timestamp_ntz, fill_id bigint, side string, quantity double, "
        "fill_price double, commission double, slippage double, multiplier double, margin_ratio double")


def sequential_fifo(pdf):
    out = []
    for (slot,), g in pdf.sort_values("ts").groupby(["slot_id"]):
        lots = []
        for r in g.itertuples():
            left = r.quantity
            while left > 0 and lots and lots[0][0].side != r.side:
                lot, rest = lots[0]
                q = min(left, rest)
                sign = 1 if lot.side == "BUY" else -1
                comm = (lot.commission / lot.quantity + r.commission / r.quantity) * q
                out.append((slot, lot.fill_id, r.fill_id, q, sign * (r.fill_price - lot.fill_price) * q * r.multiplier - comm))
                left -= q
                if q == rest:
                    lots.pop(0)
                else:
                    lots[0] = (lot, rest - q)
            if left > 0:
                lots.append((r, left))
    return sorted(out)


@pytest.mark.parametrize("part_rows", [3, 10_000])
def test_round_trips_equal_sequential_fifo(spark, part_rows):
    f = fills_frame(spark)
    got = sorted((r.slot_id, r.entry_fill, r.exit_fill, r.quantity, r.pnl) for r in L.round_trips(f, part_rows=part_rows).collect())
    want = sequential_fifo(f.toPandas())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4] for g in got], [w[4] for w in want])


def test_round_trips_of_fractions_are_exact(spark):
    """200 buys of 0.3 against 600 sells of 0.1 are 600 trades of 0.1."""
    rows = [("0", 0, "ES", START + dt.timedelta(minutes=i), i, "BUY" if i < 200 else "SELL", 0.3 if i < 200 else 0.1,
             100.0, 1.0, 0.01, 5.0, 0.1) for i in range(800)]
    t = L.round_trips(spark.createDataFrame(rows, fills_frame(spark, n=1).schema), part_rows=50).toPandas()
    assert len(t) == 600 and set(t.quantity) == {0.1} and t.groupby("entry_fill").size().eq(3).all()


def test_ledger_identities(spark):
    f = fills_frame(spark)
    p = f.groupBy("symbol", "ts").agg(F.max("fill_price").alias("close")).cache()
    book = L.slot_ledger(f, p)
    slots = book.toPandas()
    total = L.portfolio_totals(book, 1000.0).toPandas().sort_values("ts")
    last = slots.sort_values("ts").groupby("slot_id").tail(1)["cum_pnl"].sum()
    assert total["total_value"].iloc[-1] == pytest.approx(1000.0 + last)
    # Closed trades plus the open lots at the last price give the same PnL.
    trips = L.round_trips(f).toPandas()
    closed = trips.pnl.sum()
    pdf = f.toPandas().sort_values("ts")
    px = p.orderBy(F.desc("ts")).first().close
    open_pnl = 0.0
    for slot, g in pdf.groupby("slot_id"):
        used = {}
        for r in trips[trips.slot_id == slot].itertuples():
            for k in (r.entry_fill, r.exit_fill):
                used[k] = used.get(k, 0.0) + r.quantity
        for r in g.itertuples():
            q = r.quantity - used.get(r.fill_id, 0.0)
            if q > 0:
                sign = 1 if r.side == "BUY" else -1
                open_pnl += sign * (px - r.fill_price) * q * r.multiplier - r.commission * q / r.quantity
    assert closed + open_pnl == pytest.approx(last)


def test_fill_rules(spark):
    o = "order_id string, side string, order_type string, limit_price double, stop_price double, o double, h double, l double"
    cases = [
        (("gap_stop", "BUY", "STOP", None, 101.0, 103.0, 104.0, 102.0), (103.0, "OPEN")),
        (("stop", "SELL", "STOP", None, 99.0, 100.0, 101.0, 98.0), (99.0, "INTRABAR")),
        (("limit", "BUY", "LIMIT", 99.0, None, 100.0, 101.0, 98.5), (99.0, "INTRABAR")),
        (("gap_limit", "SELL", "LIMIT", 99.0, None, 100.0, 101.0, 98.5), (100.0, "OPEN")),
        (("no", "BUY", "LIMIT", 90.0, None, 100.0, 101.0, 98.5), (None, None)),
        (("sl_over", "BUY", "STOP_LIMIT", 102.0, 101.0, 103.0, 104.0, 101.5), (None, None)),
        (("sl", "BUY", "STOP_LIMIT", 100.5, 101.0, 100.0, 101.5, 99.0), (100.5, "INTRABAR")),
        (("mkt", "SELL", "MARKET", None, None, 100.0, 101.5, 99.0), (100.0, "OPEN")),
    ]
    df = spark.createDataFrame([c[0] for c in cases], o)
    c = F.col
    price, phase = E.fill_price(c("order_type"), c("side"), c("limit_price"), c("stop_price"), c("o"), c("h"), c("l"))
    got = {r.order_id: (r.p, r.f) for r in df.select("order_id", price.alias("p"), phase.alias("f")).collect()}
    assert got == {k[0]: v for k, v in cases}
    with pytest.raises(ValueError):
        E.normalize_order_type("TRAIL")


def test_contract_sizing(spark):
    ddl = ("k string, equity double, weight double, duty_cycle double, n_symbols int, price double, multiplier double, "
           "margin_ratio double, annual_vol double, direction int, intent string")
    base = (1e6, 1.0, 1.0, 1, 5000.0, 50.0, 0.1, 0.2, 1, "TARGET")
    df = spark.createDataFrame([
        ("plain", *base), ("close", *base[:-1], "CLOSE"), ("flat", *base[:4], 0.0, *base[5:]),
        ("short", *base[:8], -1, "TARGET"), ("novol", *base[:7], None, 1, "TARGET")], ddl)
    got = {r.k: r.target_qty for r in E.target_contracts(df, 0.15, 1.0).collect()}
    # 150,000 of risk over 0.2 * 5000 * 50 = 50,000 per contract.
    assert got == {"plain": 3.0, "close": 0.0, "flat": 0.0, "short": -3.0, "novol": 1.0 if round(150000 / 250000) else 0.0}
    assert {r.k: r.target_qty for r in E.target_contracts(df, 0.15, 1.0, 2).collect()}["plain"] == 2.0


def test_bracket_tie_is_a_stop_and_finer_bars_decide(spark):
    b = spark.createDataFrame([
        bar(day(0, 9), 100, 100, 100, 100, tf="1h"), bar(day(0, 10), 100, 110, 90, 100, tf="1h"), bar(day(0, 11), 101, 101, 101, 101, tf="1h")], BAR_DDL)
    s = spark.createDataFrame([("x", "ES", "1h", day(0, 9), 1, 95.0, 105.0)],
                              "signal_id string, symbol string, timeframe string, ts timestamp_ntz, side int, stop double, target double")
    out = X.outcomes(s, b, "resting")
    r = out.first()
    assert r.outcome == "STOP" and r.exit_price == 95.0 and X.outcomes(s, b).first().exit_price == 101.0
    fine = [bar(day(0, 9, 5 * k) if k < 12 else day(0, 10), 100, 106 if k == 3 else 101, 94 if k == 7 else 99, 100) for k in range(1, 13)]
    assert X.resolve_ties(out, spark.createDataFrame(fine, BAR_DDL), 300).first().resolved_outcome == "TARGET"
    assert X.resolve_ties(out, spark.createDataFrame(fine[:-1], BAR_DDL), 300).first().resolved_outcome == "STOP"


def test_signal_at_close_enters_at_next_open(spark, bars, bars_pdf):
    sig = G.signals(bars, "sma_pullback", [{"fast_sma_window": 5, "slow_sma_window": 20}], block_rows=40).toPandas()
    assert len(sig) > 10
    for r in sig.head(30).itertuples():
        later = bars_pdf[(bars_pdf.symbol == r.symbol) & (bars_pdf.ts > r.ts)].sort_values("ts")
        if len(later):
            assert r.next_open == later.open.iloc[0] and pd.Timestamp(r.next_ts) == later.ts.iloc[0]


@pytest.mark.parametrize("name", sorted(G.SIGNALS))
def test_every_signal_runs_and_has_a_small_search_space(bars, name):
    s = G.SIGNALS[name]
    assert len(s.space) <= K.MIN_TRADES - 1
    got = G.signals(bars, name, [{}, {"trade_direction": "both"}])
    assert {"params_id", "side", "stop", "target", "next_open"} <= set(got.columns)
    got.count()


def test_signal_names():
    assert G.resolve("ict_order_block") == "ict_ob"
    with pytest.raises(KeyError):
        G.resolve("nothing")
    assert G.override(G.CHANNEL, "chbrk", {"chbrk_length": 7})["length"] == 7


def test_folds(spark, bars):
    f = K.folds(bars, 3, 0.1, purge=4, embargo=2, block_rows=50).where("symbol = 'A'").toPandas()
    order = {t: i for i, t in enumerate(sorted(bars.where("symbol = 'A'").toPandas().ts))}
    for k, g in f.groupby("fold_id"):
        test = sorted(order[t] for t in g[g.role == "test"].ts)
        train = sorted(order[t] for t in g[g.role == "train"].ts)
        assert len(test) == 30 and test[0] == 210 + 30 * (k - 1) and train[-1] == test[0] - 7
    with pytest.raises(Exception, match="too few rows"):
        K.folds(bars, 10, 0.1).count()
    with pytest.raises(Exception, match="fold size"):
        K.folds(bars, 3, 0.0001).count()


def test_sampled_grid_is_repeatable_and_inside_the_space(spark):
    base = spark.range(1).select(F.lit("k").alias("key"))
    space = G.SIGNALS["sma_pullback"].space
    a, b = (K.candidates(base, space, 50, 7, ["key"]).toPandas().sort_values(list(space)) for _ in range(2))
    assert len(a) == 50 and a.reset_index(drop=True).equals(b.reset_index(drop=True))
    assert set(a.fast_sma_window) <= set(range(20, 81, 10))
    assert K.values_of((1.25, 3.0, 0.25))[-1] == 3.0


def test_correlation_invariants(spark):
    rng = np.random.default_rng(42)
    s = spark.createDataFrame([
        ("0", k, START + dt.timedelta(minutes=30 * i), float(v)) for k in (0, 1) for i, v in enumerate(np.cumsum(rng.normal(size=400)))],
        "run_id string, slot_id int, ts timestamp_ntz, cum_pnl double")
    m = A.strategy_correlation(PL.bar_pnl(s), {0: "a", 1: "b"}).toPandas()
    assert len(m) == 4 and (m[m.row_label == m.col_label]["corr"] == 1.0).all()
    assert m["corr"].between(-1, 1).all()
    one = s.withColumn("slot_id", F.lit(0)).where("ts < '2024-01-02'")
    assert A.strategy_correlation(PL.bar_pnl(one.dropDuplicates(["ts"])), {0: "a", 1: "b"}).count() == 0


def test_rebalance_marks_at_year_boundary(spark):
    b = spark.createDataFrame([bar(T(2024, 12, 28) + dt.timedelta(hours=12 * i), 1, 1, 1, 1) for i in range(12)], BAR_DDL)
    weekly = [r.ts.date() for r in rows(P.rebalance_marks(b, "weekly").where("rebalance"), "ts")]
    assert weekly == [dt.date(2024, 12, 28), dt.date(2024, 12, 30)]
    assert P.rebalance_marks(b, "daily").where("rebalance").count() == 6
    with pytest.raises(ValueError):
        P.rebalance_marks(b, "hourly")


def test_time_text_and_limits():
    assert P.parse_hhmm("09:30").hour == 9 and P.parse_hhmm(" ") is None
    with pytest.raises(ValueError):
        P.parse_hhmm("9h30")
    with pytest.raises(ValueError):
        P.check_portfolio(1.5, 20, 1.0, None)


def test_lake_round_trip_and_inventory(spark, bars, tmp_path):
    root = str(tmp_path / "lake")
    assert LK.save(bars, root) and not LK.save(bars.where("1 = 0"), root)
    lake = LK.read(spark, root)
    assert lake.count() == bars.count()
    one = LK.load(lake, "A", "1h", "2024-01-05 00:00:00", "2024-01-10 00:00:00")
    text = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in text and "PushedFilters: [IsNotNull(ts)" in text
    assert [r.symbol for r in LK.list_symbols(lake).collect()] == ["A", "B"]
    assert LK.file_sizes(spark, root).where("size_mb > 0").count() == 2
    assert len(LK.data_version(LK.file_marks(spark, root)).first()[0]) == LK.DIGEST_CHARS
    # Saving one series again leaves the other in place.
    LK.save(bars.where("symbol = 'A'").limit(10), root)
    assert LK.read(spark, root).groupBy("symbol").count().orderBy("symbol").collect()[0][1] == 10


def test_run_artifacts(spark, tmp_path):
    root = str(tmp_path / "runs")
    hist = spark.createDataFrame([("r1", day(0), 1.0), ("r2", day(0), 2.0)], "run_id string, ts timestamp_ntz, total_value double")
    none = spark.createDataFrame([], "run_id string, symbol string, pnl double")
    kpi = spark.createDataFrame([("r1", math.inf, 3)], "run_id string, profit_factor double, trades int")
    assert "trades" in AR.write_run(root, {"history": hist, "trades": none, "benchmark": none}, kpi)
    got = AR.load_run(spark, root, "r1")
    assert got["history"].first().total_value == 1.0 and got["benchmark"].count() == 0
    assert got["metrics"].first().metrics_json == '{"trades":3}'
    with pytest.raises(Exception):
        AR.load_run(spark, str(tmp_path / "nowhere"), "r1")


def test_candidate_export(spark, tmp_path):
    r = spark.createDataFrame([("s", "PASS", ["w"], {"a": 1.0}), ("t", "FAIL", [], {})],
                              "strategy string, verdict string, warnings array<string>, params map<string,double>")
    path = str(tmp_path / "c")
    assert AR.export_candidates(r, path)
    assert spark.read.option("header", True).csv(path).first().strategy == "s"
    assert not AR.export_candidates(r.where("verdict = 'FAIL'"), path + "2")
