"""E: exit analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import CTES, query, r, sql
from barlattice.catalog.indicators import RANK, VOL
from barlattice.functions.exprs import rd
from barlattice.operators import execution as X
from barlattice.operators import exits as E
from barlattice.operators.predicates import trades_of_strategy
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle

H = E.HORIZONS
CTES["itm"] = (("itrades", "specs"), """SELECT t.*, coalesce(sp.multiplier, 1.0::DOUBLE) AS multiplier, CASE direction WHEN 'LONG' THEN 1 ELSE -1 END AS sg,
    (epoch_us(exit_time) - epoch_us(entry_time)) / 6e7::DOUBLE AS hold_minutes FROM itrades t LEFT JOIN specs sp ON sp.symbol = t.symbol""")
CTES["excur"] = (("itm", "bars"), """SELECT trade_id, greatest(0, CASE direction WHEN 'LONG' THEN max(high) - any_value(entry_price) ELSE any_value(entry_price) - min(low) END * any_value(quantity * multiplier)) AS mfe,
    least(0, CASE direction WHEN 'LONG' THEN min(low) - any_value(entry_price) ELSE any_value(entry_price) - max(high) END * any_value(quantity * multiplier)) AS mae
  FROM itm t JOIN bars b ON b.symbol = t.symbol AND b.ts > t.entry_time AND b.ts <= t.exit_time GROUP BY trade_id, direction""")
CTES["decay"] = (("itm", "bars"), f"""SELECT trade_id, {', '.join(f'max(v) FILTER (h = {h}) AS pnl_decay_{h}m' for h in H)} FROM (
    SELECT p.trade_id, p.h, sg * (b.close - entry_price) * quantity * multiplier - commission - slippage AS v
    FROM (SELECT *, entry_time + to_minutes(h) AS at FROM (SELECT *, unnest({H}) AS h FROM itm)) p ASOF JOIN bars b ON b.symbol = p.symbol AND p.at >= b.ts) GROUP BY 1""")
CTES["vol"] = (("bars",), VOL)
CTES["rk"] = (("vol",), RANK)
CTES["entvol"] = (("itm", "bars", "rk"), """SELECT t.trade_id, k.pct AS entry_volatility FROM itm t ASOF LEFT JOIN (
    SELECT b.symbol, b.ts, rk.pct FROM bars b JOIN rk ON rk.symbol = b.symbol AND rk.rn = b.rn) k ON k.symbol = t.symbol AND t.entry_time >= k.ts""")
CTES["enriched"] = (("excur", "decay", "entvol"), """SELECT t.*, e.mfe, e.mae, d.* EXCLUDE (trade_id), v.entry_volatility FROM itm t
  LEFT JOIN excur e ON e.trade_id = t.trade_id LEFT JOIN decay d ON d.trade_id = t.trade_id LEFT JOIN entvol v ON v.trade_id = t.trade_id""")


def trades(spark, d):
    return X.with_specs(T.intraday_trades(spark, d), T.specs(spark))


def enriched(spark, d):
    return E.enrich(settle(trades(spark, d)), settle(T.bars(spark, d)), 20, 100)


@query("e1_excursions", sql(f"SELECT trade_id, {r('mfe', 4, 'mfe')}, {r('mae', 4, 'mae')} FROM excur", "excur"))
def _(spark, d):
    return E.excursions(settle(trades(spark, d)), settle(T.bars(spark, d))).select("trade_id", rd("mfe", 4).alias("mfe"), rd("mae", 4).alias("mae"))


def long_holds(spark, d):
    """Orders held to the last ship date of their parts' supplier nation group, over daily closes of order totals."""
    o = T.load(spark, d, "orders")
    px = o.groupBy(F.lit("total").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
        F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))
    t = o.select(F.col("o_orderkey").alias("trade_id"), F.lit("total").alias("symbol"), F.col("o_orderdate").alias("entry_time"),
                 (F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 900).cast("int"))).alias("exit_time"),
                 F.col("o_totalprice").alias("entry_price"), F.lit(1.0).alias("quantity"), F.lit(1.0).alias("multiplier"),
                 F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"))
    return t, px


@query("e1_excursions_long_holds", sql(f"""
  SELECT trade_id, {r("greatest(0, CASE direction WHEN 'LONG' THEN max(high) - any_value(entry_price) ELSE any_value(entry_price) - min(low) END)", 2, 'mfe')},
    {r("least(0, CASE direction WHEN 'LONG' THEN min(low) - any_value(entry_price) ELSE any_value(entry_price) - max(high) END)", 2, 'mae')}
  FROM (SELECT o_orderkey AS trade_id, o_orderdate AS entry_time, o_orderdate + to_days(CAST(o_custkey % 900 AS INTEGER)) AS exit_time, o_totalprice AS entry_price,
      CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction FROM orders) t
  JOIN (SELECT o_orderdate AS ts, max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders GROUP BY 1) b ON b.ts > entry_time AND b.ts <= exit_time
  GROUP BY trade_id, direction"""))
def _(spark, d):
    t, px = long_holds(spark, d)
    return E.excursions(t, px).select("trade_id", rd("mfe", 2).alias("mfe"), rd("mae", 2).alias("mae"))


@query("e2_forward_pnl", sql(f"SELECT trade_id, {', '.join(r(f'pnl_decay_{h}m', 4, f'pnl_decay_{h}m') for h in H)} FROM decay", "decay"))
def _(spark, d):
    f = E.forward_pnl(settle(trades(spark, d)), T.bars(spark, d))
    return f.select("trade_id", *[rd(f"pnl_decay_{h}m", 4).alias(f"pnl_decay_{h}m") for h in H])


@query("e3_entry_volatility", sql(f"SELECT trade_id, {r('entry_volatility', 6, 'entry_volatility')} FROM entvol", "entvol"))
def _(spark, d):
    return E.entry_volatility(trades(spark, d), T.bars(spark, d), 20, 100).withColumn("entry_volatility", rd("entry_volatility", 6))


NUM = ["hold_minutes", "mfe", "mae", "pnl_decay_5m", "pnl_decay_60m", "pnl_decay_1440m", "entry_volatility"]


@query("e4_enriched_trades", sql(f"SELECT trade_id, {', '.join(r(c, 4, c) for c in NUM)} FROM enriched", "enriched"))
def _(spark, d):
    return enriched(spark, d).select("trade_id", *[rd(c, 4).alias(c) for c in NUM])


@query("j6_bar_source_fallback", sql(f"""
  SELECT t.trade_id, CASE WHEN t.slot_id = 0 THEN '0|' ELSE '*|' END || t.symbol AS source FROM itrades t""", "itrades"))
def _(spark, d):
    b = T.bars(spark, d)
    both = b.withColumn("slot_id", F.lit(0)).unionByName(b.withColumn("slot_id", F.lit(None).cast("int")))
    t, _b = E.with_source(T.intraday_trades(spark, d), both)
    return t.select("trade_id", "source")


@query("e5_mfe_mae_points", sql(f"""SELECT trade_id, CASE WHEN pnl >= 0 THEN 'Winners' ELSE 'Losers' END AS series, {r('mae', 4, 'mae')}, {r('mfe', 4, 'mfe')}, {r('pnl', 4, 'pnl')}
  FROM enriched WHERE mfe IS NOT NULL AND mae IS NOT NULL""", "enriched"))
def _(spark, d):
    return E.scatter(enriched(spark, d)).select("trade_id", "series", *[rd(c, 4).alias(c) for c in ("mae", "mfe", "pnl")])


@query("e6_decay_curve", sql(f"""SELECT run_id, horizon_min, {r('avg_pnl', 4, 'avg_pnl')} FROM (
    SELECT run_id, 0 AS horizon_min, 0.0::DOUBLE AS avg_pnl FROM enriched GROUP BY 1
    {' '.join(f'UNION ALL SELECT run_id, {h}, avg(pnl_decay_{h}m) FROM enriched GROUP BY 1' for h in H)})
  WHERE horizon_min <= (SELECT coalesce(min(h), 1440) FROM (SELECT unnest({H}) AS h) WHERE h >= (SELECT max(hold_minutes) FROM enriched))""", "enriched"))
def _(spark, d):
    return E.decay_curve(enriched(spark, d)).withColumn("avg_pnl", rd("avg_pnl", 4))


@query("e6_decay_marks", sql(f"""SELECT run_id, {r('avg(pnl)', 4, 'actual_avg')}, {r("avg(hold_minutes) FILTER (exit_reason LIKE '%TIME_STOP%')", 4, 'time_stop_hold')},
    count(DISTINCT hold_minutes) FILTER (exit_reason LIKE '%TIME_STOP%') AS distinct_holds,
    (SELECT arg_min(h, abs(h - (SELECT avg(hold_minutes) FROM enriched WHERE exit_reason LIKE '%TIME_STOP%'))) FROM (SELECT unnest({H}) AS h)
      WHERE h <= (SELECT coalesce(min(h2), 1440) FROM (SELECT unnest({H}) AS h2) WHERE h2 >= (SELECT max(hold_minutes) FROM enriched))) AS marker_horizon
  FROM enriched GROUP BY 1""", "enriched"))
def _(spark, d):
    return E.decay_marks(trades(spark, d)).withColumns({c: rd(c, 4) for c in ("actual_avg", "time_stop_hold")})


@query("e7_hold_buckets", sql(f"""SELECT g.run_id, step_min, g.bucket, {r('coalesce(a, 0)', 4, 'avg_pnl')}, coalesce(n, 0) AS trades
  FROM (SELECT run_id, CAST(CASE WHEN top <= 60 THEN 15 WHEN top <= 240 THEN 60 WHEN top <= 1440 THEN 360 ELSE 1440 END AS INTEGER) AS step_min, CAST(unnest(range(5)) AS INTEGER) AS bucket
        FROM (SELECT run_id, max(hold_minutes) AS top FROM itm GROUP BY 1)) g
  LEFT JOIN (SELECT run_id, CAST(least(floor(hold_minutes / CASE WHEN top <= 60 THEN 15 WHEN top <= 240 THEN 60 WHEN top <= 1440 THEN 360 ELSE 1440 END), 4) AS INTEGER) AS bucket, avg(pnl) AS a, count(*) AS n
    FROM (SELECT *, max(hold_minutes) OVER (PARTITION BY run_id) AS top FROM itm) GROUP BY 1, 2) q ON q.run_id = g.run_id AND q.bucket = g.bucket""", "itm"))
def _(spark, d):
    return E.hold_buckets(trades(spark, d)).withColumn("avg_pnl", rd("avg_pnl", 4))


@query("e8_volatility_buckets", sql(f"""SELECT g.run_id, g.bucket, {r('coalesce(a, 0)', 4, 'avg_pnl')} FROM (SELECT DISTINCT run_id, unnest(['Compression', 'Normal', 'Panic']) AS bucket FROM enriched) g
  LEFT JOIN (SELECT run_id, CASE WHEN entry_volatility <= 0.2 THEN 'Compression' WHEN entry_volatility <= 0.8 THEN 'Normal' ELSE 'Panic' END AS bucket, avg(pnl) AS a
    FROM enriched WHERE entry_volatility IS NOT NULL GROUP BY 1, 2) q ON q.run_id = g.run_id AND q.bucket = g.bucket""", "enriched"))
def _(spark, d):
    return E.volatility_buckets(enriched(spark, d)).withColumn("avg_pnl", rd("avg_pnl", 4))


@query("e9_pnl_by_reason", sql(f"SELECT exit_reason, {r('sum(pnl)', 2, 'total_pnl')} FROM trades GROUP BY 1", "trades"))
def _(spark, d):
    return E.pnl_by_reason(T.trades(spark, d)).withColumn("total_pnl", rd("total_pnl", 2))


@query("e10_reason_breakdown", sql(f"""SELECT exit_reason, count(*) AS trades, {r('avg(CASE WHEN pnl >= 0 THEN 1.0::DOUBLE ELSE 0 END)', 6, 'win_rate')}, {r('avg(pnl)', 4, 'avg_pnl')},
  {r('sum(pnl)', 2, 'total_pnl')} FROM trades GROUP BY 1""", "trades"))
def _(spark, d):
    b = E.reason_breakdown(T.trades(spark, d))
    return b.withColumns({"win_rate": rd("win_rate", 6), "avg_pnl": rd("avg_pnl", 4), "total_pnl": rd("total_pnl", 2)})


@query("e11_trade_log_page", sql("""SELECT trade_id, strategy, symbol, direction, entry_time, exit_time, round(pnl, 4) + 0.0 AS pnl, exit_reason, (SELECT count(*) FROM itrades) AS total_rows FROM itrades
  ORDER BY entry_time, trade_id LIMIT 50 OFFSET 100""", "itrades"))
def _(spark, d):
    return E.trade_log(T.intraday_trades(spark, d), 3, 50).withColumn("pnl", rd("pnl", 4))


@query("p7_trades_of_strategy", sql(f"SELECT trade_id, {r('pnl', 4, 'pnl')} FROM itrades WHERE strategy = 'beta'", "itrades"))
def _(spark, d):
    return trades_of_strategy(T.intraday_trades(spark, d), "beta", 3).select("trade_id", rd("pnl", 4).alias("pnl"))
