"""I: indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import phi, query, r, sql
from barlattice.functions.exprs import rd
from barlattice.operators import indicators as I
from barlattice.plans.blocks import Series
from barlattice.sources import tables as T

K = "b.symbol, b.timeframe, b.ts"


def series(spark, d, tf="1h"):
    return Series(T.bars(spark, d, tf))


def out(s, digits=6, flags=(), **cols):
    """Selected columns: rounded numbers by new name, flags as they are."""
    return s.select(*[rd(c, digits).alias(n) for n, c in cols.items()],
                    *[F.col(c).alias(n) for n, c in dict(flags).items()])


def win(n, extra=""):
    return f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW{extra})"


def full(expr, n, need=None, x="close"):
    """SQL aggregate over the last n rows with a minimum count."""
    return f"CASE WHEN count({x}) OVER {win(n)} >= {need or n} THEN {expr} OVER {win(n)} END"


@query("i1_sma", sql(f"""SELECT symbol, timeframe, ts, {r(full('avg(close)', 50), 6, 'sma')} FROM bars""", "bars"))
def _(spark, d):
    s = series(spark, d)
    return out(s, sma=I.sma(s, 50))


@query("i2_ema", sql(f"""SELECT {K}, {r('e.y', 6, 'ema')} FROM bars b JOIN ema50 e
  ON b.symbol = e.symbol AND b.rn = e.rn""", "bars", "ema50"))
def _(spark, d):
    s = series(spark, d)
    return out(s, ema=I.ema(s, 50))


# Closes of a few days each month and single ones are missing, so gaps have up to hundreds of rows.
@query("i2_ema_gaps", f"""
WITH RECURSIVE b AS (SELECT *, CASE WHEN day(ts) BETWEEN 4 AND 3 + 5 * (month(ts) % 5) OR hour(ts) % 7 = 3 THEN NULL ELSE close END AS x FROM ({sql("SELECT * FROM bars", "bars")})),
k AS (SELECT symbol, rn, x, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS i, rn - lag(rn) OVER (PARTITION BY symbol ORDER BY rn) AS d
      FROM b WHERE x IS NOT NULL),
e(symbol, rn, i, y) AS (SELECT symbol, rn, i, x FROM k WHERE i = 1
  UNION ALL SELECT k.symbol, k.rn, k.i, (pow(9 / 11.0::DOUBLE, k.d) * e.y + 2 / 11.0::DOUBLE * k.x) / (pow(9 / 11.0::DOUBLE, k.d) + 2 / 11.0::DOUBLE)
    FROM e JOIN k ON k.symbol = e.symbol AND k.i = e.i + 1)
SELECT b.symbol, b.timeframe, b.ts, {r('last_value(e.y IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.rn)', 6, 'ema')}
FROM b LEFT JOIN e ON e.symbol = b.symbol AND e.rn = b.rn""")
def _(spark, d):
    missing = F.dayofmonth("ts").between(F.lit(4), 3 + 5 * (F.month("ts") % 5)) | (F.hour("ts") % 7 == 3)
    s = Series(T.bars(spark, d).withColumn("x", F.when(~missing, F.col("close"))))
    return out(s, ema=I.ema(s, 10, "x"))


@query("i3_atr", sql(f"""SELECT {K}, {r('b.tr', 6, 'tr')}, {r('e.y', 6, 'atr')} FROM tr b JOIN atr14 e
  ON b.symbol = e.symbol AND b.rn = e.rn""", "tr", "atr14"))
def _(spark, d):
    s = series(spark, d)
    return out(s, atr=I.atr(s, 14), tr="tr")


VOL = f"""SELECT *, {full('stddev_samp(close)', 20, 10)} AS vol FROM bars"""
RANK = """SELECT a.symbol, a.rn, CASE WHEN count(h.vol) >= 50 AND any_value(a.vol) IS NOT NULL THEN
    (count(*) FILTER (h.vol < a.vol) + (count(*) FILTER (h.vol = a.vol) + 1) / 2.0::DOUBLE) / count(h.vol) END AS pct
  FROM vol a JOIN vol h ON a.symbol = h.symbol AND h.rn BETWEEN a.rn - 99 AND a.rn GROUP BY a.symbol, a.rn"""


@query("i4_volatility_regime", sql(f"""
  SELECT {K}, {r('p.pct', 6, 'vol_pct')}, coalesce(p.pct >= 0.2 AND p.pct <= 0.8, true) AS allowed
  FROM bars b LEFT JOIN rk p ON b.symbol = p.symbol AND p.rn = b.rn - 1""", "bars", vol=VOL, rk=RANK))
def _(spark, d):
    s = series(spark, d)
    pct, ok = I.vol_regime(s, 20, 100)
    return out(s, vol_pct=pct, flags={"allowed": ok})


SHOCK = """SELECT b.*, a.y AS ref, abs(open - pc) / nullif(a.y, 0) AS gap_atr, abs(high - low) / nullif(a.y, 0) AS range_atr,
    abs(close - pc) / nullif(a.y, 0) AS change_atr
  FROM tr b LEFT JOIN atr14 a ON b.symbol = a.symbol AND a.rn = b.rn - 1"""


@query("i5_shock_gate", sql(f"""
  SELECT {K}, {r('gap_atr', 6, 'gap_atr')}, {r('range_atr', 6, 'range_atr')}, {r('change_atr', 6, 'change_atr')},
    ref IS NULL OR coalesce(gap_atr <= 1.0 AND range_atr <= 2.5 AND change_atr <= 1.75, false) AS allowed
  FROM sh b""", "tr", "atr14", sh=SHOCK))
def _(spark, d):
    s = series(spark, d)
    c = I.shock(s)
    return out(s, flags={"allowed": c.pop("allowed")}, **c)


@query("i6_atr_stretch", sql(f"""
  SELECT symbol, timeframe, ts, {r('x', 6, 'stretch')}, ref IS NULL OR coalesce(x <= 1.75, false) AS long_ok,
         ref IS NULL OR coalesce(x >= -1.75, false) AS short_ok
  FROM (SELECT b.*, ref, (close - e.y) / nullif(ref, 0) AS x FROM bars b
        JOIN ema20 e ON b.symbol = e.symbol AND b.rn = e.rn
        LEFT JOIN (SELECT symbol, rn, y AS ref FROM atr14) a ON a.symbol = b.symbol AND a.rn = b.rn - 1)""",
    "bars", "atr14", "ema20"))
def _(spark, d):
    s = series(spark, d)
    c = I.stretch(s)
    return out(s, stretch=c["stretch"], flags={"long_ok": c["long_ok"], "short_ok": c["short_ok"]})


N7 = 40
LINE = f"""SELECT *, close - (mp + slope * (rn - mt)) AS res FROM (SELECT *, cv / nullif(vt, 0) AS slope FROM (SELECT *,
    {full('covar_samp(close, rn)', N7, N7 // 2)} AS cv, {full('var_samp(rn)', N7, N7 // 2)} AS vt,
    {full('avg(close)', N7, N7 // 2)} AS mp, {full('avg(rn)', N7, N7 // 2)} AS mt FROM bars))"""
TSTAT = f"""SELECT symbol, rn, CASE WHEN rv IS NOT NULL THEN slope / sqrt(greatest(rv / ((CAST({N7} AS DOUBLE) - 1) * vt), 0)) END AS t FROM (
    SELECT *, {full('var_samp(res)', N7, N7 // 2, 'res')} AS rv FROM line)"""


@query("i7_trend_t", sql(f"""
  SELECT {K}, {r('t', 4, 'trend_t')}, coalesce(abs(t) < 2.0, true) AS allowed
  FROM bars b LEFT JOIN ts ON b.symbol = ts.symbol AND ts.rn = b.rn - 1""", "bars", line=LINE, ts=TSTAT))
def _(spark, d):
    s = series(spark, d)
    t, ok = I.trend_t(s, N7)
    return out(s, 4, trend_t=t, flags={"allowed": ok})


# One regression of the change on the level and the previous change per window, from centred sums.
_OBS = "(PARTITION BY symbol ORDER BY slow_ts ROWS BETWEEN 70 PRECEDING AND 1 PRECEDING)"
SLOW = """SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY slow_ts) AS z FROM (
    SELECT *, close - x AS d FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY slow_ts) AS x, row_number() OVER (PARTITION BY symbol ORDER BY slow_ts) AS k FROM (
      SELECT symbol, slow_ts, arg_max(close, ts) AS close FROM (SELECT *, CASE WHEN ts = time_bucket(INTERVAL '1 hour', ts) THEN ts
        ELSE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' END AS slow_ts FROM bars5) GROUP BY 1, 2)))"""
TAU = f"""SELECT symbol, slow_ts, CASE WHEN k > 72 THEN b1 / sqrt((sdd - b1 * sxd - b2 * szd) / 67 * szz / det) END AS tau FROM (
    SELECT *, (szz * sxd - sxz * szd) / det AS b1, (sxx * szd - sxz * sxd) / det AS b2 FROM (SELECT *, sxx * szz - sxz * sxz AS det FROM (
      SELECT *, var_pop(x) OVER {_OBS} * 70 AS sxx, var_pop(z) OVER {_OBS} * 70 AS szz, covar_pop(x, z) OVER {_OBS} * 70 AS sxz, covar_pop(x, d) OVER {_OBS} * 70 AS sxd,
        covar_pop(z, d) OVER {_OBS} * 70 AS szd, var_pop(d) OVER {_OBS} * 70 AS sdd FROM slow)))"""
PVAL = f"""SELECT symbol, slow_ts, CASE WHEN tau IS NULL THEN NULL WHEN tau > 2.74 THEN 1 WHEN tau < -18.83 THEN 0 ELSE {phi('q')} END AS p FROM (
    SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau
      ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END AS q FROM tau)"""


@query("i8_unit_root", sql(f"""SELECT symbol, timeframe, ts, {r('pp', 6, 'adf_pvalue')}, coalesce(pp < 0.05, false) AS adf_ok FROM (
    SELECT *, lag(p) OVER (PARTITION BY symbol ORDER BY ts) AS pp FROM (
      SELECT b.symbol, b.timeframe, b.ts, v.p FROM bars5 b ASOF LEFT JOIN pv v ON v.symbol = b.symbol AND b.ts >= v.slow_ts))""", "bars5", slow=SLOW, tau=TAU, pv=PVAL))
def _(spark, d):
    return I.adf(T.bars(spark, d, "5m"), 72, 3600).select("symbol", "timeframe", "ts", rd("adf_pvalue", 6).alias("adf_pvalue"), "adf_ok")


@query("i9_half_life", sql(f"""
  SELECT {K}, {r('h.hl', 6, 'half_life')}, coalesce(h.hl > 0 AND h.hl <= 50, false) AS allowed
  FROM bars b LEFT JOIN (SELECT symbol, rn, CASE WHEN cv / nullif(vx, 0) < -1e-4::DOUBLE
      THEN least(-ln(2) / (cv / nullif(vx, 0)), 500::DOUBLE) END AS hl FROM (
      SELECT symbol, rn, {full('covar_samp(yl, dy)', 100, 50, 'yl')} AS cv, {full('var_samp(yl)', 100, 50, 'yl')} AS vx FROM (
        SELECT *, close - yl AS dy FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS yl FROM bars)))) h
  ON b.symbol = h.symbol AND h.rn = b.rn - 1""", "bars"))
def _(spark, d):
    s = series(spark, d)
    hl, ok = I.half_life(s)
    return out(s, half_life=hl, flags={"allowed": ok})


def pair(spark, d, symbol):
    return T.bars(spark, d).where(F.col("symbol") == symbol).select(F.lit("click-view").alias("pair_id"), "ts", "close")


KALMAN = sql(f"""SELECT 'click-view' AS pair_id, ts, {r('before', 6, 'beta')} FROM kf""", "bars", xy="""
  SELECT x.ts, x.close / f.c AS x, y.close / f.c AS y, row_number() OVER (ORDER BY x.ts) AS k FROM bars x JOIN bars y ON x.ts = y.ts AND x.symbol = 'view' AND y.symbol = 'click'
  CROSS JOIN (SELECT arg_min(x.close, x.ts) AS c FROM bars x JOIN bars y ON x.ts = y.ts AND x.symbol = 'view' AND y.symbol = 'click') f""", kf="""
  SELECT 0::BIGINT AS k, CAST(NULL AS TIMESTAMP) AS ts, 0::DOUBLE AS a, 1::DOUBLE AS b, 1::DOUBLE AS p, 0::DOUBLE AS c, 1::DOUBLE AS d, CAST(NULL AS DOUBLE) AS before
  UNION ALL SELECT k, ts, a + u * e / g, b + v * e / g, p - u * u / g, c - u * v / g, d - v * v / g, CASE WHEN k > 1 THEN b END FROM (
    SELECT *, u + x * v + 0.1::DOUBLE AS g, y - a - b * x AS e FROM (
      SELECT q.k, q.ts, q.x, q.y, s.a, s.b, s.p + 1e-5 AS p, s.c, s.d + 1e-5 AS d, s.p + 1e-5 + q.x * s.c AS u, s.c + q.x * (s.d + 1e-5) AS v
      FROM kf s JOIN xy q ON q.k = s.k + 1))""").replace("WITH ", "WITH RECURSIVE ", 1) + " WHERE k > 0"


@query("i10_kalman_beta", KALMAN)
def _(spark, d):
    return I.kalman_beta(pair(spark, d, "view"), pair(spark, d, "click")).withColumn("beta", rd("beta", 6))


@query("i11_candle_shape", sql(f"""SELECT symbol, timeframe, ts,
    {r('coalesce(abs(close - open) / nullif(high - low, 0), 0)', 6, 'body_fraction')},
    {r('coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)', 6, 'upper_wick_fraction')},
    {r('coalesce((least(open, close) - low) / nullif(high - low, 0), 0)', 6, 'lower_wick_fraction')} FROM bars""", "bars"))
def _(spark, d):
    return T.bars(spark, d).select("symbol", "timeframe", "ts", *[rd(c, 6).alias(n) for n, c in I.candle_shape().items()])


DM_N, DM_H, DM_T = 12, 6, 20


def frame_sql(lo, hi):
    def side(k):
        return "CURRENT ROW" if k == 0 else f"{-k} PRECEDING"
    return f"(PARTITION BY b.symbol ORDER BY b.rn ROWS BETWEEN {side(lo)} AND {side(hi)})"


_F1, _F2 = frame_sql(-(DM_N - 1), -(DM_N - DM_H)), frame_sql(-(DM_N - DM_H) + 1, 0)
_FA, _FT = frame_sql(-(DM_N - 1), 0), frame_sql(-(DM_N - 1) - DM_T, -DM_N)
DIAMOND = f"""SELECT b.*, a.y AS atr, max(high) OVER {_F1} - min(low) OVER {_F1} AS w1, max(high) OVER {_F2} AS hi2,
    min(low) OVER {_F2} AS lo2, max(high) OVER {_FA} - min(low) OVER {_FA} AS ht,
    regr_slope(high, b.rn) OVER {_F1} AS sh1, regr_slope(low, b.rn) OVER {_F1} AS sl1,
    regr_slope(high, b.rn) OVER {_F2} AS sh2, regr_slope(low, b.rn) OVER {_F2} AS sl2,
    regr_slope(close, b.rn) OVER {_FT} AS st, count(close) OVER {_FT} AS tn
  FROM bars b JOIN atr14 a ON a.symbol = b.symbol AND a.rn = b.rn"""


@query("i12_diamond", sql(f"""
  SELECT symbol, timeframe, ts, coalesce(shape AND st > steep * 0.5, false) AS top_pattern,
    coalesce(shape AND st < -steep * 0.5, false) AS bottom_pattern,
    {r('CASE WHEN ok THEN hi2 END', 6, 'upper_boundary')}, {r('CASE WHEN ok THEN lo2 END', 6, 'lower_boundary')},
    {r('CASE WHEN ok THEN ht END', 6, 'pattern_height')}
  FROM (SELECT *, ok AND sh1 > steep AND sl1 < -steep AND sh2 < -steep AND sl2 > steep AND hi2 - lo2 <= w1 * 0.95
          AND ht >= atr * 0.5 AND tn >= {max(4, DM_T // 2)} AS shape
        FROM (SELECT *, rn >= {DM_N} AND atr > 0 AS ok, atr * 0.01::DOUBLE / {DM_H} AS steep FROM dm))""",
    "bars", "atr14", dm=DIAMOND))
def _(spark, d):
    s = series(spark, d)
    c = I.diamond(s, DM_N, DM_T, min_slope=0.01, max_contraction=0.95, min_height=0.5)
    flags = {k: c.pop(k) for k in ("top_pattern", "bottom_pattern")}
    return out(s, flags=flags, **c)


@query("i13_structure", sql(f"""
  SELECT symbol, timeframe, ts, coalesce(lo > lag(lo, 5) OVER w, false) AS higher_lows,
    coalesce(hi < lag(hi, 5) OVER w, false) AS lower_highs
  FROM (SELECT *, lag(l) OVER w AS lo, lag(h) OVER w AS hi FROM (
      SELECT *, {full('min(low)', 10)} AS l, {full('max(high)', 10)} AS h FROM bars)
    WINDOW w AS (PARTITION BY symbol ORDER BY rn)) WINDOW w AS (PARTITION BY symbol ORDER BY rn)""", "bars"))
def _(spark, d):
    s = series(spark, d)
    lo, hi = I.structure(s, 10)
    return out(s, flags={"higher_lows": lo, "lower_highs": hi})


LEVELS = f"""SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY rn) AS res, lag(l) OVER (PARTITION BY symbol ORDER BY rn) AS sup
  FROM (SELECT *, {full('max(high)', 20)} AS h, {full('min(low)', 20)} AS l FROM bars)"""


@query("i14_range_levels", sql(f"""
  SELECT symbol, timeframe, ts, {r('res', 6, 'resistance')}, {r('sup', 6, 'support')}, {r('res - sup', 6, 'height')}
  FROM lv""", "bars", lv=LEVELS))
def _(spark, d):
    s = series(spark, d)
    return out(s, **I.range_levels(s, 20))


BB = f"""SELECT *, m + 2 * sd AS up, m - 2 * sd AS dn, 4 * sd AS width, 4 * sd / greatest(abs(m), 1e-9::DOUBLE) AS nw FROM (
  SELECT *, {full('avg(close)', 20)} AS m, {full('stddev_samp(close)', 20)} AS sd FROM bars)"""


@query("i15_bollinger", sql(f"""
  SELECT symbol, timeframe, ts, {r('m', 6, 'middle')}, {r('up', 6, 'upper')}, {r('dn', 6, 'lower')},
    {r('width', 6, 'width')}, {r('nw', 6, 'norm_width')} FROM bb""", "bars", bb=BB))
def _(spark, d):
    s = series(spark, d)
    return out(s, **I.bollinger(s))


KC = """SELECT b.*, e.y AS m, e.y + 1.5 * a.y AS up, e.y - 1.5 * a.y AS dn, 3.0 * a.y AS width,
    3.0 * a.y / greatest(abs(e.y), 1e-9::DOUBLE) AS nw
  FROM bars b JOIN ema20 e ON b.symbol = e.symbol AND b.rn = e.rn JOIN atr20 a ON b.symbol = a.symbol AND b.rn = a.rn"""


@query("i16_keltner", sql(f"""
  SELECT symbol, timeframe, ts, {r('m', 6, 'middle')}, {r('up', 6, 'upper')}, {r('dn', 6, 'lower')},
    {r('width', 6, 'width')}, {r('nw', 6, 'norm_width')} FROM kc""", "bars", "ema20", "atr20", kc=KC))
def _(spark, d):
    s = series(spark, d)
    return out(s, **I.keltner(s))


VR = f"""SELECT symbol, rn, volume / nullif(vm, 0) AS vr FROM (SELECT *, {full('avg(volume)', 20, x='volume')} AS vm FROM bars)"""


@query("i17_volume_ratio", sql(f"""SELECT {K}, {r('vr', 6, 'volume_ratio')} FROM bars b JOIN v
  ON b.symbol = v.symbol AND b.rn = v.rn""", "bars", v=VR))
def _(spark, d):
    s = series(spark, d)
    return out(s, volume_ratio=I.volume_ratio(s))


@query("i18_point_of_control", sql(f"""SELECT symbol, timeframe, ts, {r('pv / nullif(v, 0)', 6, 'poc')} FROM (
  SELECT *, {full('sum(close * volume)', 20)} AS pv, {full('sum(volume)', 20)} AS v FROM bars)""", "bars"))
def _(spark, d):
    s = series(spark, d)
    return out(s, poc=I.poc(s))


def squeeze_sql(src, lookback, q, expand):
    need = min(lookback, max(5, lookback // 2))
    return f"""SELECT *, coalesce(max(CAST(tight AS INTEGER)) OVER (PARTITION BY symbol ORDER BY rn
        ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 1 AS recent,
      coalesce(nw > lag(nw) OVER (PARTITION BY symbol ORDER BY rn) * {expand}::DOUBLE, false) AS expanding
      FROM (SELECT *, coalesce(nw <= lim, false) AS tight FROM (
        SELECT *, {full(f'quantile_cont(nw, {q})', lookback, need, 'nw')} AS lim FROM {src}))"""


@query("i19_compression", sql(f"""
  SELECT symbol, timeframe, ts, {r('lim', 6, 'threshold')}, tight AS compressed, recent, expanding FROM sq""",
    "bars", bb=BB, sq=squeeze_sql("bb", 100, 0.2, 1.05)))
def _(spark, d):
    s = series(spark, d)
    c = I.compression(s, I.bollinger(s)["norm_width"], 100, 0.2)
    return out(s, threshold=c["threshold"], flags={k: c[k] for k in ("compressed", "recent", "expanding")})


FRACTAL = """SELECT *, max(ph) OVER w AS hf, min(pl) OVER w AS lf FROM (
    SELECT *, CASE WHEN high > lag(high) OVER v AND high > lead(high) OVER v THEN high END AS ph,
      CASE WHEN low < lag(low) OVER v AND low < lead(low) OVER v THEN low END AS pl
    FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY rn))
  WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


@query("i20_fractal_levels", sql(f"""
  SELECT symbol, timeframe, ts, {r('hf', 6, 'fractal_high')}, {r('lf', 6, 'fractal_low')} FROM fr""", "bars", fr=FRACTAL))
def _(spark, d):
    s = series(spark, d)
    c = I.fractal_levels(s, 10)
    return out(s, fractal_high=c["high"], fractal_low=c["low"])


@query("i21_bar_strength", sql(f"""SELECT symbol, timeframe, ts,
  {r('(close - low) / greatest(high - low, 1e-5::DOUBLE)', 6, 'ibs')} FROM bars""", "bars"))
def _(spark, d):
    return T.bars(spark, d).select("symbol", "timeframe", "ts", rd(I.ibs(), 6).alias("ibs"))


LOGRET = """SELECT *, CASE WHEN close / nullif(pc, 0) > 0 THEN ln(close / nullif(pc, 0)) END AS lr FROM (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM bars)"""


@query("i22_realized_vol", sql(f"""SELECT symbol, timeframe, ts, {r(full('stddev_samp(lr)', 20, x='lr'), 6, 'realized_vol')}
  FROM lret""", "bars", lret=LOGRET))
def _(spark, d):
    s = series(spark, d)
    return out(s, realized_vol=I.realized_vol(s, 20))


REGIME = """SELECT symbol, day, lag(bull) OVER (PARTITION BY symbol ORDER BY day) AS regime FROM (
    SELECT *, CASE WHEN count(close) OVER w >= 10 THEN close > avg(close) OVER w ELSE false END AS bull FROM (
      SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


@query("i23_daily_regime", sql(f"""SELECT {K}, g.regime FROM bars b LEFT JOIN rg g
  ON b.symbol = g.symbol AND CAST(b.ts AS DATE) = g.day""", "bars", rg=REGIME))
def _(spark, d):
    return I.daily_regime(T.bars(spark, d), 10).select("symbol", "timeframe", "ts", "regime")
