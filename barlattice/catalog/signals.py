"""G, X8, X9, X17, K13: signals and what becomes of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import CTES, ema_cte, query, r, sql
from barlattice.catalog.indicators import BB, FRACTAL, KC, LEVELS, LINE, REGIME, SHOCK, VOL, VR, full, squeeze_sql
from barlattice.functions.exprs import rd
from barlattice.operators import brackets as X
from barlattice.operators import indicators as I
from barlattice.operators import signals as G
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle

SIG = ["symbol", "timeframe", "ts", "side"]
COLS = ["entry_level", "stop", "target"]


def shown(df, *extra):
    return df.select(*SIG, *extra, *[rd(c, 5).alias(c) for c in COLS])


def sel(extra=""):
    return f"""SELECT symbol, timeframe, ts, side{extra}, {r('entry_level', 5, 'entry_level')}, {r('stop', 5, 'stop')},
      {r('target', 5, 'target')} FROM g WHERE side <> 0"""


def shock_ok(gap, rng, chg):
    return f"(ref IS NULL OR coalesce(gap_atr <= {gap} AND range_atr <= {rng} AND change_atr <= {chg}, false))"


def pullback_sql(fast, slow, mult, rr):
    return f"""SELECT *, CAST(NULL AS DOUBLE) AS entry_level, close - side * y * {mult}::DOUBLE AS stop,
        close + side * y * {mult}::DOUBLE * {rr}::DOUBLE AS target
      FROM (SELECT *, CASE WHEN low <= f AND high >= f AND close > s THEN 1 WHEN low <= f AND high >= f AND close < s
            THEN -1 ELSE 0 END AS side FROM (
        SELECT b.*, y, {full('avg(close)', fast).replace('symbol', 'b.symbol').replace('rn ROWS', 'b.rn ROWS')} AS f,
          {full('avg(close)', slow).replace('symbol', 'b.symbol').replace('rn ROWS', 'b.rn ROWS')} AS s
        FROM bars b JOIN atr14 a ON a.symbol = b.symbol AND a.rn = b.rn))"""


@query("g1_sma_pullback", sql(sel(), "bars", "atr14", g=pullback_sql(50, 200, 2.0, 3.0)))
def _(spark, d):
    return shown(G.signals(T.bars(spark, d), "sma_pullback"))


THREE_BAR = f"""
  SELECT *, 'LIMIT' AS entry_type, 'DAY' AS tif, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS DOUBLE) AS target,
    close - side * y * 0.1::DOUBLE AS entry_level
  FROM (SELECT s.*, a.y, CASE WHEN c1 > close AND c2 > c1 AND low <= lo AND regime AND {shock_ok(1.0, 2.5, 1.75)} AND nx
            THEN 1 WHEN c1 < close AND c2 < c1 AND high >= hi AND NOT regime AND {shock_ok(1.0, 2.5, 1.75)} AND nx THEN -1 ELSE 0 END AS side
    FROM (SELECT *, lag(close) OVER w AS c1, lag(close, 2) OVER w AS c2, {full('min(low)', 5)} AS lo,
            {full('max(high)', 5)} AS hi, lead(ts) OVER w IS NOT NULL AS nx
          FROM sh WINDOW w AS (PARTITION BY symbol ORDER BY rn)) s
    JOIN atr14 a ON a.symbol = s.symbol AND a.rn = s.rn
    LEFT JOIN rg ON rg.symbol = s.symbol AND rg.day = CAST(s.ts AS DATE))"""


@query("g2_three_bar_reversion", sql(sel(", entry_type, tif"), "tr", "atr14", sh=SHOCK, rg=REGIME, g=THREE_BAR))
def _(spark, d):
    return shown(G.signals(T.bars(spark, d), "three_bar_mr", [{"regime_window": 10, "trade_direction": "both"}]),
                 "entry_type", "tif")


def channel_sql(length):
    return f"""SELECT *, CASE side WHEN 1 THEN res + 0.01 WHEN -1 THEN sup - 0.01 END AS entry_level,
        CASE side WHEN 1 THEN sup - 0.01 WHEN -1 THEN res + 0.01 END AS stop, CAST(NULL AS DOUBLE) AS target
      FROM (SELECT s.*, CASE WHEN res IS NOT NULL AND close > e.y AND {shock_ok(1.25, 3.0, 2.0)} THEN 1
              WHEN sup IS NOT NULL AND close < e.y AND {shock_ok(1.25, 3.0, 2.0)} THEN -1 ELSE 0 END AS side
        FROM (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY rn) AS res, lag(l) OVER (PARTITION BY symbol ORDER BY rn) AS sup
              FROM (SELECT *, {full('max(high)', length)} AS h, {full('min(low)', length)} AS l FROM sh)) s
        JOIN ema200 e ON e.symbol = s.symbol AND e.rn = s.rn)"""


@query("g3_channel_breakout", sql(sel(), "tr", "atr14", "ema200", sh=SHOCK, g=channel_sql(50)))
def _(spark, d):
    return shown(G.signals(T.bars(spark, d), "channel_breakout", [{"trade_direction": "both"}]))


def breakout_sql(sq, ratio, pad, rr, gates):
    return f"""SELECT *, CASE side WHEN 1 THEN ue WHEN -1 THEN de END AS entry_level, CASE side WHEN 1 THEN us WHEN -1 THEN ds END AS stop,
        CASE side WHEN 1 THEN ug WHEN -1 THEN dg END AS target
      FROM (SELECT *, CASE WHEN lg AND NOT st AND us < ue AND ue < ug THEN 1 WHEN st AND NOT lg AND dg < de AND de < ds THEN -1
              ELSE 0 END AS side
        FROM (SELECT *, res + 0.01 AS ue, sup - y * {pad}::DOUBLE AS us, res + 0.01 + mv AS ug, sup - 0.01 AS de,
              res + y * {pad}::DOUBLE AS ds, sup - 0.01 - mv AS dg,
              coalesce(rdy AND close > res AND high >= up, false) AS lg, coalesce(rdy AND close < sup AND low <= dn, false) AS st
          FROM (SELECT q.*, l.res, l.sup, a.y, greatest(l.res - l.sup, a.y) * {rr}::DOUBLE AS mv,
                  q.recent AND q.expanding AND v.vr >= {ratio} AND {gates} AS rdy
                FROM {sq} q JOIN lv l ON l.symbol = q.symbol AND l.rn = q.rn JOIN v ON v.symbol = q.symbol AND v.rn = q.rn
                JOIN atr14 a ON a.symbol = q.symbol AND a.rn = q.rn JOIN sh ON sh.symbol = q.symbol AND sh.rn = q.rn)))"""


@query("g4_bollinger_squeeze", sql(sel(), "tr", "atr14", bb=BB, sq=squeeze_sql("bb", 60, 0.35, 1.01), lv=LEVELS, v=VR, sh=SHOCK,
    g=breakout_sql("sq", 1.0, 0.5, 1.75, shock_ok(2.5, 3.5, 2.25))))
def _(spark, d):
    return shown(G.signals(T.bars(spark, d), "bollinger_squeeze_breakout", [dict(
        squeeze_lookback=60, squeeze_quantile=0.35, width_expansion_factor=1.01, breakout_volume_ratio=1.0,
        shock_max_gap_atr=2.5, trade_direction="both")]))


@query("g5_keltner_tightening", sql(sel(), "tr", "atr14", "atr20", "ema20", kc=KC.replace("1.5", "0.3").replace("3.0", "0.6"), sq=squeeze_sql("kc", 60, 0.9, 0.98), lv=LEVELS, v=VR,
    sh=SHOCK, g=breakout_sql("sq", 0.5, 0.6, 1.6, shock_ok(9.0, 9.0, 9.0))))
def _(spark, d):
    return shown(G.signals(T.bars(spark, d), "keltner_tightening_breakout", [dict(
        kc_atr_mult=0.3, tightening_lookback=60, tightening_quantile=0.9, width_expansion_factor=0.98, breakout_volume_ratio=0.5,
        shock_max_gap_atr=9.0, shock_max_range_atr=9.0, shock_max_close_change_atr=9.0, trade_direction="both")]))


@query("g6_fractal_pivot", sql(sel(), "tr", "atr14", "ema20", sh=SHOCK, fr=FRACTAL, g=f"""
  SELECT *, CAST(NULL AS DOUBLE) AS entry_level, close - side * y * 2.0 AS stop, close + side * y * 2.0 AS target
  FROM (SELECT *, CASE WHEN buy AND NOT sell AND ok AND (ref IS NULL OR coalesce(x <= 2.0, false)) THEN 1
          WHEN sell AND NOT buy AND ok AND (ref IS NULL OR coalesce(x >= -2.0, false)) THEN -1 ELSE 0 END AS side
    FROM (SELECT f.*, a.y, sh.ref, (f.close - e.y) / nullif(sh.ref, 0) AS x, {shock_ok(1.0, 2.75, 1.8)} AS ok,
        coalesce(hr AND f.low < lf AND f.close > lf AND f.open > lf AND ibs > 0.5 AND lf - f.low >= 0.02, false) AS buy,
        coalesce(hr AND f.high > hf AND f.close < hf AND f.open < hf AND ibs < 0.5 AND f.high - hf >= 0.02, false) AS sell
      FROM (SELECT *, hour(ts) >= 2 AND hour(ts) < 15 AS hr, (close - low) / greatest(high - low, 1e-5::DOUBLE) AS ibs FROM fr) f
      JOIN sh ON sh.symbol = f.symbol AND sh.rn = f.rn JOIN atr14 a ON a.symbol = f.symbol AND a.rn = f.rn
      JOIN ema20 e ON e.symbol = f.symbol AND e.rn = f.rn))"""))
def _(spark, d):
    return shown(G.signals(T.bars(spark, d), "rfp_fractal", [{"ibs_buy_threshold": 0.5, "ibs_sell_threshold": 0.5}]))


ZONES = """SELECT symbol, timeframe, ts AS formed_ts, rn AS formed_rn, direction, h2 AS zone_high, l2 AS zone_low,
    CASE direction WHEN 'bull' THEN l2 ELSE h2 END AS stop_base
  FROM (SELECT b.*, y, lag(high) OVER w AS h2, lag(low) OVER w AS l2, lag(high, 2) OVER w AS h1, lag(low, 2) OVER w AS l1
        FROM bars b JOIN atr14 a ON a.symbol = b.symbol AND a.rn = b.rn WINDOW w AS (PARTITION BY b.symbol ORDER BY b.rn))
  CROSS JOIN (VALUES ('bull'), ('bear')) AS t(direction)
  WHERE rn >= 4 AND abs(close - open) >= y * 0.75 AND CASE direction WHEN 'bull' THEN l2 < l1 AND l2 < low AND close > h2
    ELSE h2 > h1 AND h2 > high AND close < l2 END"""


@query("g7_order_blocks", sql("SELECT symbol, timeframe, formed_ts, direction, zone_high, zone_low, stop_base FROM z",
    "bars", "atr14", z=ZONES))
def _(spark, d):
    return G.order_blocks(T.bars(spark, d)).drop("formed_rn")


@query("g8_zone_entries", sql(f"""
  SELECT symbol, timeframe, formed_ts, direction, ts, {r('close', 5, 'entry_close')}, {r('stop', 5, 'stop')},
    {r("CASE direction WHEN 'bull' THEN close + rw ELSE close - rw END", 5, 'target')}
  FROM (SELECT *, greatest(y * 3.0, risk * 3.0) AS rw,
      min(CASE WHEN trg AND risk > 0 AND gate THEN rn END) OVER q AS first_in, min(CASE WHEN NOT trg AND blown THEN rn END) OVER q AS first_out
    FROM (SELECT *, CASE direction WHEN 'bull' THEN close - stop ELSE stop - close END AS risk,
        CASE direction WHEN 'bull' THEN low <= zone_high AND close > open AND close >= zone_low
          ELSE high >= zone_low AND close < open AND close <= zone_high END AS trg,
        CASE direction WHEN 'bull' THEN close < zone_low ELSE close > zone_high END AS blown,
        vok AND (m IS NULL OR CASE direction WHEN 'bull' THEN close > m ELSE NOT close > m END) AS gate
      FROM (SELECT z.*, b.* EXCLUDE (symbol, timeframe), CASE direction WHEN 'bull' THEN stop_base - 0.02 ELSE stop_base + 0.02 END AS stop
            FROM z JOIN bx b ON b.symbol = z.symbol AND b.rn BETWEEN z.formed_rn AND z.formed_rn + 48))
    WINDOW q AS (PARTITION BY symbol, formed_rn, direction))
  WHERE rn = first_in AND (first_out IS NULL OR first_in < first_out)""", "bars", "atr14", vol=VOL, z=ZONES, bx=f"""
  SELECT b.*, a.y, b.m2 AS m, coalesce(p.pct >= 0.2 AND p.pct <= 0.8, true) AS vok
  FROM (SELECT *, {full('avg(close)', 100)} AS m2 FROM bars) b JOIN atr14 a ON a.symbol = b.symbol AND a.rn = b.rn
  LEFT JOIN (SELECT a.symbol, a.rn, CASE WHEN count(h.vol) >= 50 AND any_value(a.vol) IS NOT NULL THEN
    (count(*) FILTER (h.vol < a.vol) + (count(*) FILTER (h.vol = a.vol) + 1) / 2.0::DOUBLE) / count(h.vol) END AS pct
    FROM vol a JOIN vol h ON a.symbol = h.symbol AND h.rn BETWEEN a.rn - 99 AND a.rn GROUP BY a.symbol, a.rn) p
  ON p.symbol = b.symbol AND p.rn = b.rn - 1"""))
def _(spark, d):
    z = G.zone_entries(T.bars(spark, d), dict(vol_regime_window=20, vol_history_window=100, trend_sma_window=100))
    return z.select("symbol", "timeframe", "formed_ts", "direction", "ts",
                    *[rd(c, 5).alias(c) for c in ("entry_close", "stop", "target")])


@query("g9_parameter_override", sql("""
  SELECT trial_id, fold_id, CASE WHEN side = 'long' THEN 50.0::DOUBLE ELSE CAST(fast AS DOUBLE) END AS fast_sma_window,
    CASE WHEN side = 'long' THEN 2.0::DOUBLE ELSE mult END AS atr_sl_mult, 3.0::DOUBLE AS rr_ratio FROM trials""", "trials"))
def _(spark, d):
    t = T.fold_trials(spark, d).withColumn("params", F.when(F.col("side") != "long", F.create_map(
        F.lit("smapull_fast_sma_window"), F.col("fast").cast("double"), F.lit("smapull_atr_sl_mult"), F.col("mult")))
        .otherwise(F.create_map().cast("map<string,double>")))
    return t.select("trial_id", "fold_id", *[
        G.param("params", "smapull", k, float(G.SMA_PULLBACK[k])).alias(k)
        for k in ("fast_sma_window", "atr_sl_mult", "rr_ratio")])


def bracket_sql(sig, fill):
    stop = f"CASE side WHEN 1 THEN low <= stop ELSE high >= stop END"
    goal = f"CASE side WHEN 1 THEN high >= target ELSE low <= target END"
    px = "next_open" if fill == "next_open" else """CASE WHEN st THEN CASE side WHEN 1 THEN least(open, stop)
      ELSE greatest(open, stop) END ELSE CASE side WHEN 1 THEN greatest(open, target) ELSE least(open, target) END END"""
    return f"""SELECT sid, symbol, timeframe, sts AS ts, side, params_id, stop, target, entry, st AS stop_touched, gt AS target_touched,
        CASE WHEN st THEN 'STOP' ELSE 'TARGET' END AS outcome, bts AS hit_ts, pts AS hit_prev_ts,
        {'nts' if fill == 'next_open' else 'bts'} AS exit_ts, {px} AS exit_price
      FROM (SELECT s.*, b.ts AS bts, b.open, b.high, b.low, b.next_open, b.nts, b.pts, {stop} AS st, {goal} AS gt,
              row_number() OVER (PARTITION BY sid ORDER BY b.rn) AS k
            FROM {sig} s JOIN (SELECT *, lead(open) OVER w AS next_open, lead(ts) OVER w AS nts, lag(ts) OVER w AS pts FROM bars
                WINDOW w AS (PARTITION BY symbol ORDER BY rn)) b
            ON b.symbol = s.symbol AND b.rn > s.rn WHERE {stop} OR {goal}) WHERE k = 1"""


def numbered(g, pid=0):
    return f"""SELECT g.symbol || '|' || CAST(g.rn AS VARCHAR) || '|{pid}' AS sid, g.symbol, g.timeframe, g.ts AS sts, g.rn, side, {pid} AS params_id,
      stop, target, n.open AS entry FROM {g} g LEFT JOIN bars n ON n.symbol = g.symbol AND n.rn = g.rn + 1 WHERE side <> 0"""


OUT = f"""SELECT s.symbol, s.timeframe, s.sts AS ts, s.side, outcome, coalesce(stop_touched, false) AS stop_touched,
    coalesce(target_touched, false) AS target_touched, hit_ts, exit_ts, {r('exit_price', 5, 'exit_price')} FROM s LEFT JOIN x ON x.sid = s.sid"""
P8 = [{"fast_sma_window": 20, "slow_sma_window": 60, "atr_sl_mult": 1.0, "rr_ratio": 1.5}]


def outcome_cols(df):
    return df.select(
        "symbol", "timeframe", "ts", "side", "outcome", "stop_touched", "target_touched", "hit_ts", "exit_ts",
        rd("exit_price", 5).alias("exit_price"))


@query("x8_bracket_next_open", sql(OUT, "bars", "atr14", g=pullback_sql(20, 60, 1.0, 1.5), s=numbered("g"), x=bracket_sql("s", "next_open")))
def _(spark, d):
    b = settle(T.bars(spark, d))
    return outcome_cols(X.outcomes(X.with_id(G.signals(b, "sma_pullback", P8)), b, "next_open"))


@query("x8_bracket_resting", sql(OUT, "bars", "atr14", g=pullback_sql(20, 60, 1.0, 1.5), s=numbered("g"), x=bracket_sql("s", "resting")))
def _(spark, d):
    b = settle(T.bars(spark, d))
    return outcome_cols(X.outcomes(X.with_id(G.signals(b, "sma_pullback", P8)), b, "resting"))


@query("x8_bracket_end_of_day", sql(f"""
  SELECT symbol, timeframe, ts, side, CASE WHEN cut THEN 'EOD' ELSE outcome END AS outcome,
    CASE WHEN cut THEN ets ELSE exit_ts END AS exit_ts, {r('CASE WHEN cut THEN ec ELSE exit_price END', 5, 'exit_price')}
  FROM (SELECT s.symbol, s.timeframe, s.sts AS ts, s.side, x.outcome, x.exit_ts, x.exit_price, e.ets, e.ec,
          coalesce(e.ets IS NOT NULL AND (x.hit_ts IS NULL OR e.ets < x.hit_ts), false) AS cut
        FROM s LEFT JOIN x ON x.sid = s.sid
        ASOF LEFT JOIN (SELECT symbol, min(ts) AS ets, arg_min(close, ts) AS ec FROM bars WHERE hour(ts) >= 20
              GROUP BY symbol, CAST(ts AS DATE)) e ON e.symbol = s.symbol AND s.sts < e.ets)""", "bars", "atr14", g=pullback_sql(20, 60, 1.0, 1.5), s=numbered("g"), x=bracket_sql("s", "resting")))
def _(spark, d):
    b = settle(T.bars(spark, d))
    x = X.outcomes(X.with_id(G.signals(b, "sma_pullback", P8)), b, "resting", eod_time="20:00")
    return x.select(
        "symbol", "timeframe", "ts", "side", "outcome", "exit_ts", rd("exit_price", 5).alias("exit_price"))


@query("x9_finer_bar_resolution", sql("""
  SELECT s.symbol, s.timeframe, s.sts AS ts, s.side, outcome, coalesce(CASE WHEN n = want AND grid THEN won END, outcome) AS resolved_outcome
  FROM s LEFT JOIN x ON x.sid = s.sid LEFT JOIN (
    SELECT sid, count(*) AS n, any_value(want) AS want, bool_and(ongrid) AS grid, arg_min(CASE WHEN fs THEN 'STOP' ELSE 'TARGET' END, fts)
        FILTER (fs OR fg) AS won
    FROM (SELECT x.sid, f.ts AS fts, (epoch_us(hit_ts) - epoch_us(hit_prev_ts)) // 300000000 AS want,
            (epoch_us(f.ts) - epoch_us(hit_prev_ts)) % 300000000 = 0 AS ongrid,
            CASE side WHEN 1 THEN f.low <= stop ELSE f.high >= stop END AS fs, CASE side WHEN 1 THEN f.high >= target ELSE f.low <= target END AS fg
          FROM x JOIN bars5 f ON f.symbol = x.symbol AND f.ts > hit_prev_ts AND f.ts <= hit_ts WHERE stop_touched AND target_touched)
    GROUP BY sid) q ON q.sid = x.sid""", "bars", "bars5", "atr14", g=pullback_sql(20, 60, 1.0, 1.5), s=numbered("g"), x=bracket_sql("s", "resting")))
def _(spark, d):
    b = settle(T.bars(spark, d))
    x = X.outcomes(X.with_id(G.signals(b, "sma_pullback", P8)), b, "resting")
    return X.resolve_ties(x, T.bars(spark, d, "5m"), 300).select("symbol", "timeframe", "ts", "side", "outcome", "resolved_outcome")


ENTRIES = """SELECT symbol, timeframe, n.ts AS entry_ts, side, CASE side WHEN 1 THEN greatest(n.open, entry_level) ELSE least(n.open, entry_level) END AS entry_price
  FROM (SELECT g.symbol, g.timeframe, g.side, g.entry_level, b.ts, b.open, b.high, b.low FROM g JOIN bars b ON b.symbol = g.symbol AND b.rn = g.rn + 1
        WHERE g.side <> 0) n WHERE CASE side WHEN 1 THEN high >= entry_level ELSE low <= entry_level END"""


def entries(b, name, params):
    """Signals whose stop entry fills on the next bar."""
    s = G.signals(b, name, [params])
    up = F.col("side") == 1
    met = F.when(up, F.col("next_high") >= F.col("entry_level")).otherwise(F.col("next_low") <= F.col("entry_level"))
    px = F.when(up, F.greatest("next_open", "entry_level")).otherwise(F.least("next_open", "entry_level"))
    return s.where(met).select("symbol", "timeframe", F.col("next_ts").alias("entry_ts"), "side", px.alias("entry_price"))


@query("x17_trailing_channel_exit", sql(f"""
  SELECT e.symbol, e.timeframe, entry_ts, e.side, {r('entry_price', 5, 'entry_price')}, h.ts AS exit_ts, {r('h.px', 5, 'exit_price')}
  FROM e ASOF LEFT JOIN (
    SELECT symbol, ts, side, px FROM (SELECT *, unnest([1, -1]) AS side, unnest([least(open, ls), greatest(open, ss)]) AS px,
        unnest([coalesce(low <= ls, false), coalesce(high >= ss, false)]) AS hit
      FROM (SELECT *, lag(sup - 0.01) OVER (PARTITION BY symbol ORDER BY rn) AS ls, lag(res + 0.01) OVER (PARTITION BY symbol ORDER BY rn) AS ss FROM lv)) WHERE hit
  ) h ON h.symbol = e.symbol AND h.side = e.side AND e.entry_ts < h.ts""", "tr", "atr14", "ema200", sh=SHOCK, lv=LEVELS, g=channel_sql(20),
    e=ENTRIES.replace("SELECT symbol, timeframe, n.ts", "SELECT symbol, timeframe, n.ts")))
def _(spark, d):
    b = settle(T.bars(spark, d))
    e = entries(b, "channel_breakout", {"length": 20, "trade_direction": "both"})
    return X.trailing_exits(e, b, 20, 0.01).select(
        "symbol", "timeframe", "entry_ts", "side", rd("entry_price", 5).alias("entry_price"), "exit_ts",
        rd("exit_price", 5).alias("exit_price"))


@query("x17_end_of_day_exit", sql(f"""
  SELECT e.symbol, e.timeframe, entry_ts, e.side, l.nts AS exit_ts, {r('l.nopen', 5, 'exit_price')}
  FROM e LEFT JOIN (SELECT symbol, ts, nts, nopen FROM (SELECT *, lead(ts) OVER w AS nts, lead(open) OVER w AS nopen FROM bars
      WINDOW w AS (PARTITION BY symbol ORDER BY rn)) WHERE nts IS NULL OR CAST(nts AS DATE) <> CAST(ts AS DATE)) l
  ON l.symbol = e.symbol AND CAST(l.ts AS DATE) = CAST(e.entry_ts AS DATE)""", "tr", "atr14", "ema200", sh=SHOCK, g=channel_sql(20), e=ENTRIES))
def _(spark, d):
    b = settle(T.bars(spark, d))
    e = entries(b, "channel_breakout", {"length": 20, "trade_direction": "both"})
    return X.end_of_day_exits(e, b).select(
        "symbol", "timeframe", "entry_ts", "side", "exit_ts", rd("exit_price", 5).alias("exit_price"))


SWEEP = [{"fast_sma_window": 20, "slow_sma_window": 60, "atr_sl_mult": 1.0, "rr_ratio": 1.5},
         {"fast_sma_window": 30, "slow_sma_window": 120, "atr_sl_mult": 2.0, "rr_ratio": 2.0},
         {}]


def sweep_sql():
    parts = {}
    for i, p in enumerate([(20, 60, 1.0, 1.5), (30, 120, 2.0, 2.0), (50, 200, 2.0, 3.0)]):
        parts[f"g{i}"] = pullback_sql(*p)
    union = " UNION ALL ".join(numbered(f"g{i}", i) for i in range(3))
    return sql(f"""SELECT symbol, timeframe, params_id, count(*) AS total_trades,
        {r('avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)', 6, 'win_rate')},
        {r('coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(abs(sum(pnl) FILTER (pnl <= 0)), 0)', 6, 'profit_factor')},
        {r('avg(pnl)', 6, 'avg_trade')}, {r('coalesce(avg(pnl) FILTER (pnl > 0), 0)', 6, 'avg_win')},
        {r('coalesce(avg(pnl) FILTER (pnl <= 0), 0)', 6, 'avg_loss')}
      FROM (SELECT *, side * (exit_price - entry) AS pnl FROM x WHERE exit_price IS NOT NULL AND entry IS NOT NULL)
      GROUP BY 1, 2, 3""", "bars", "atr14", **parts, s=union, x=bracket_sql("s", "next_open"))


@query("k13_signal_sweep", sweep_sql())
def _(spark, d):
    k = X.sweep_kpis(X.sweep(settle(T.bars(spark, d)), "sma_pullback", SWEEP))
    return k.select("symbol", "timeframe", "params_id", "total_trades", *[
        rd(F.when(F.col(c) != float("inf"), F.col(c)), 6).alias(c)
        for c in ("win_rate", "profit_factor", "avg_trade", "avg_win", "avg_loss")])


TRADES = f"""SELECT symbol, timeframe, ts, side, state, entry_ts, {r('entry_price', 5, 'entry_price')}, exit_ts, {r('exit_price', 5, 'exit_price')} FROM x"""


def trades(b, name, params):
    x = X.sweep(b, name, [params])
    return x.select("symbol", "timeframe", "ts", "side", "state", "entry_ts", rd("entry_price", 5).alias("entry_price"),
                    "exit_ts", rd("exit_price", 5).alias("exit_price"))


STATE = "CASE WHEN entry_ts IS NULL THEN 'UNFILLED' WHEN exit_price IS NOT NULL THEN 'CLOSED' ELSE 'OPEN' END AS state"
# Stop entries that the next bar decides.
STOPPED = """SELECT g.*, g.rn + 1 AS ern, CASE WHEN met THEN nts END AS entry_ts,
    CASE WHEN met THEN CASE side WHEN 1 THEN greatest(nopen, entry_level) ELSE least(nopen, entry_level) END END AS entry_price
  FROM (SELECT g.*, b.ts AS nts, b.open AS nopen, CASE side WHEN 1 THEN b.high >= entry_level ELSE b.low <= entry_level END AS met
        FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.rn = g.rn + 1 WHERE side <> 0) g"""


@query("k13_three_bar_sweep", sql(TRADES, "tr", "atr14", sh=SHOCK, rg=REGIME, g=THREE_BAR, e="""
  SELECT g.symbol, g.timeframe, g.ts, g.side, q.entry_ts, q.entry_price FROM g LEFT JOIN (
    SELECT g.symbol, g.rn, min(b.ts) AS entry_ts, arg_min(CASE side WHEN 1 THEN least(b.open, entry_level) ELSE greatest(b.open, entry_level) END, b.rn) AS entry_price
    FROM g JOIN bars b ON b.symbol = g.symbol AND b.rn > g.rn AND CAST(b.ts AS DATE) = CAST(g.ts AS DATE)
      AND CASE side WHEN 1 THEN b.low <= entry_level ELSE b.high >= entry_level END WHERE side <> 0 GROUP BY 1, 2) q
  ON q.symbol = g.symbol AND q.rn = g.rn WHERE side <> 0""", x=f"""
  SELECT *, {STATE} FROM (SELECT e.*, l.nts AS exit_ts, l.nopen AS exit_price FROM e LEFT JOIN (
      SELECT symbol, ts, nts, nopen FROM (SELECT *, lead(ts) OVER w AS nts, lead(open) OVER w AS nopen FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY rn))
      WHERE nts IS NULL OR CAST(nts AS DATE) <> CAST(ts AS DATE)) l ON l.symbol = e.symbol AND CAST(l.ts AS DATE) = CAST(e.entry_ts AS DATE))"""))
def _(spark, d):
    return trades(settle(T.bars(spark, d)), "three_bar_mr", {"regime_window": 10, "trade_direction": "both"})


@query("k13_channel_sweep", sql(TRADES, "tr", "atr14", "ema200", sh=SHOCK, lv=LEVELS, g=channel_sql(20), e=STOPPED, x=f"""
  SELECT *, {STATE} FROM (SELECT e.*, h.ts AS exit_ts, h.px AS exit_price FROM e ASOF LEFT JOIN (
    SELECT symbol, ts, hside, px FROM (SELECT *, unnest([1, -1]) AS hside, unnest([least(open, ls), greatest(open, ss)]) AS px,
        unnest([coalesce(low <= ls, false), coalesce(high >= ss, false)]) AS hit
      FROM (SELECT *, lag(sup - 0.01) OVER (PARTITION BY symbol ORDER BY rn) AS ls, lag(res + 0.01) OVER (PARTITION BY symbol ORDER BY rn) AS ss FROM lv)) WHERE hit
  ) h ON h.symbol = e.symbol AND h.hside = e.side AND e.entry_ts < h.ts)"""))
def _(spark, d):
    return trades(settle(T.bars(spark, d)), "channel_breakout", {"length": 20, "entry_buffer_ticks": 1, "trade_direction": "both"})


@query("k13_squeeze_sweep", sql(TRADES, "tr", "atr14", bb=BB, sq=squeeze_sql("bb", 60, 0.35, 1.01), lv=LEVELS, v=VR, sh=SHOCK,
    g=breakout_sql("sq", 1.0, 0.5, 1.75, shock_ok(2.5, 3.5, 2.25)), e=STOPPED,
    s="""SELECT symbol || '|' || CAST(rn AS VARCHAR) AS sid, symbol, timeframe, ts AS sts, ern AS rn, side, 0 AS params_id, stop, target, entry_price AS entry
         FROM e WHERE entry_ts IS NOT NULL""", b=bracket_sql("s", "resting"), x=f"""
  SELECT *, {STATE} FROM (SELECT e.*, b.exit_ts, b.exit_price FROM e LEFT JOIN b ON b.symbol = e.symbol AND b.ts = e.ts)"""))
def _(spark, d):
    return trades(settle(T.bars(spark, d)), "bollinger_squeeze_breakout", dict(
        squeeze_lookback=60, squeeze_quantile=0.35, width_expansion_factor=1.01, breakout_volume_ratio=1.0,
        shock_max_gap_atr=2.5, trade_direction="both"))


# A rule of a user's own, registered as any other: crossings of the close and its mean, with a bracket in percent.
def crossing(s, p):
    mean, close = I.sma(s, p["window"]), F.col("close")
    was = s.add(f"_was_above_{p['window']}", F.col(s.lag("close")) > F.col(s.lag(mean)), [s.lag("close"), s.lag(mean)])
    above = close > F.col(mean)
    side = F.when(above & ~F.col(was), 1).when((close < F.col(mean)) & F.col(was), -1).otherwise(0)
    return G.Rule(side, "MARKET", "GTC", F.lit(None).cast("double"), close * (1 - side * p["stop"]), close * (1 + side * p["target"]))


CROSSING = [dict(window=10), dict(window=25, stop=0.2, target=0.1)]


def crossing_sql(n, stop, target):
    return f"""SELECT *, close * (1 - side * {stop}::DOUBLE) AS stop, close * (1 + side * {target}::DOUBLE) AS target FROM (
      SELECT *, CASE WHEN close > m AND NOT was THEN 1 WHEN close < m AND was THEN -1 ELSE 0 END AS side FROM (
        SELECT *, lag(close > m) OVER (PARTITION BY symbol ORDER BY rn) AS was FROM (SELECT *, {full('avg(close)', n)} AS m FROM bars)))"""


@query("u1_user_rule_sweep", sql(f"""
  SELECT s.symbol, s.timeframe, s.sts AS ts, s.params_id, s.side, x.exit_ts, {r('s.entry', 5, 'entry_price')}, {r('x.exit_price', 5, 'exit_price')}
  FROM s LEFT JOIN x ON x.sid = s.sid AND s.entry IS NOT NULL""", "bars", g0=crossing_sql(10, 0.1, 0.15), g1=crossing_sql(25, 0.2, 0.1),
    s=f"{numbered('g0', 0)} UNION ALL {numbered('g1', 1)}", x=bracket_sql("s", "next_open")))
def _(spark, d):
    G.register("user_crossing", G.Signal("ucross", dict(window=20, stop=0.1, target=0.15), crossing,
                                         {"window": (5, 50, 5), "stop": (0.05, 0.3, 0.05)}, "next_open"))
    x = X.sweep(settle(T.bars(spark, d)), "user_crossing", CROSSING)
    return x.select("symbol", "timeframe", "ts", "params_id", "side", "exit_ts", rd("entry_price", 5).alias("entry_price"),
                    rd("exit_price", 5).alias("exit_price"))
