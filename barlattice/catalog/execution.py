"""X1-X7, X14-X16: costs, fills, sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import CTES, query, r, sql
from barlattice.catalog.indicators import LOGRET
from barlattice.functions.exprs import rd
from barlattice.operators import execution as E
from barlattice.operators.indicators import realized_vol
from barlattice.plans.blocks import Series
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle

PROFILE = E.cost_profile(2.5, {"limit": 0.5}, {"stop": 3.0})


def orders(spark, d):
    """One order per hourly bar; type, side, validity and levels follow the bar number."""
    n = F.col("_rn")
    buy = n % 2 == 0
    s = Series(T.bars(spark, d))
    typ = F.element_at(F.array(*[F.lit(t) for t in E.ORDER_TYPES]), (n % 4 + 1).cast("int"))
    side = F.when(F.floor(n / 4) % 2 == 0, "BUY").otherwise("SELL")
    up = F.col("side") == "BUY"
    return s.frame().withColumn("side", side).select(
        F.concat_ws("-", "symbol", n.cast("string")).alias("order_id"), "symbol", "timeframe",
        F.col("ts").alias("placed_at"), "side", typ.alias("order_type"),
        F.when(n % 13 != 0, F.when(up, F.col("close") * 0.75).otherwise(F.col("close") * 1.25)).alias("limit_price"),
        F.when(up, F.col("close") * 1.5).otherwise(F.col("close") * 0.5).alias("stop_price"),
        F.element_at(F.array(F.lit("IOC"), F.lit("DAY"), F.lit("GTC")), (n % 3 + 1).cast("int")).alias("time_in_force"),
        (n % 4).cast("double").alias("quantity"), (n % 5 == 0).alias("reduce_only"),
        (n % 7 - 3).cast("double").alias("position"), (n % 6).cast("int").alias("spread_ticks"))


CTES["ords"] = (("bars",), """
  SELECT symbol || '-' || CAST(rn AS VARCHAR) AS order_id, symbol, timeframe, rn, ts AS placed_at, side,
    CASE rn % 4 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'STOP' ELSE 'STOP_LIMIT' END AS order_type,
    CASE WHEN rn % 13 <> 0 THEN CASE side WHEN 'BUY' THEN close * 0.75::DOUBLE ELSE close * 1.25::DOUBLE END END AS limit_price,
    CASE side WHEN 'BUY' THEN close * 1.5::DOUBLE ELSE close * 0.5::DOUBLE END AS stop_price,
    CASE rn % 3 WHEN 0 THEN 'IOC' WHEN 1 THEN 'DAY' ELSE 'GTC' END AS time_in_force,
    CAST(rn % 4 AS DOUBLE) AS quantity, rn % 5 = 0 AS reduce_only, CAST(rn % 7 - 3 AS DOUBLE) AS position,
    CAST(rn % 6 AS INTEGER) AS spread_ticks
  FROM (SELECT *, CASE WHEN (rn // 4) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM bars)""")
CTES["profile"] = ((), """SELECT * FROM (VALUES ('MARKET', 1.0::DOUBLE, 2.5::DOUBLE), ('LIMIT', 0.5, 2.5), ('STOP', 1.0, 3.0),
    ('STOP_LIMIT', 0.0, 2.5)) AS t(order_type, sm, cr)""")
SPEC = """coalesce(sp.tick_size, 0.01) AS tick_size, coalesce(sp.multiplier, 1.0) AS multiplier, 0.10::DOUBLE AS margin_ratio"""


@query("s20_instrument_specs", sql(f"""SELECT DISTINCT b.symbol, {SPEC} FROM bars b LEFT JOIN specs sp ON sp.symbol = b.symbol""",
    "bars", "specs"))
def _(spark, d):
    return E.with_specs(T.bars(spark, d).select("symbol").distinct(), T.specs(spark))


@query("x1_cost_profile", sql("""SELECT o.order_type, sm AS spread_multiplier, cr AS commission_rate, count(*) AS orders
  FROM ords o JOIN profile p ON p.order_type = o.order_type GROUP BY 1, 2, 3""", "ords", "profile"))
def _(spark, d):
    n = orders(spark, d).groupBy("order_type").agg(F.count("*").alias("orders"))
    return n.join(E.cost_profile_table(spark, PROFILE), "order_type")


@query("x2_effective_spread", sql("""SELECT order_id, greatest(0, CAST(round_even(spread_ticks * sm, 0) AS INTEGER)) AS effective_ticks
  FROM ords o JOIN profile p ON p.order_type = o.order_type""", "ords", "profile"))
def _(spark, d):
    return E.order_cost(E.with_specs(orders(spark, d), T.specs(spark)), PROFILE).select("order_id", "effective_ticks")


@query("x3_round_trip_cost", sql(f"""
  SELECT order_id, {r('qm * t1 + quantity * 2.5', 5, 'entry_total_cash')}, {r('qm * t2 + quantity * 2.5', 5, 'exit_total_cash')},
    {r('qm * t1 + quantity * 2.5 + qm * t2 + quantity * 2.5', 5, 'round_trip_cash')}
  FROM (SELECT *, quantity * tick_size * multiplier AS qm, greatest(0, round_even(CAST(spread_ticks AS DOUBLE), 0)) AS t1,
          greatest(0, round_even(spread_ticks * 0.5::DOUBLE, 0)) AS t2
        FROM (SELECT o.*, {SPEC} FROM ords o LEFT JOIN specs sp ON sp.symbol = o.symbol))""", "ords", "specs"))
def _(spark, d):
    o = E.round_trip_cost(E.with_specs(orders(spark, d), T.specs(spark)), PROFILE, "MARKET", "LIMIT")
    return o.select("order_id", *[rd(c, 5).alias(c) for c in ("entry_total_cash", "exit_total_cash", "round_trip_cash")])


@query("x4_adaptive_spread", sql("""
  SELECT symbol, timeframe, ts, CASE WHEN rn - 1 >= 21 AND nv > 0 AND bv > 0 AND st <> 0
      THEN greatest(0, CAST(round_even(4.0::DOUBLE * pow(1.5::DOUBLE, st), 0) AS INTEGER)) ELSE 4 END AS spread_ticks
  FROM (SELECT *, CAST(trunc((nv - bv) / nullif(bv, 0) / 0.10::DOUBLE) AS INTEGER) AS st FROM (
    SELECT *, CASE WHEN count(lr) OVER a >= 2 THEN stddev_samp(lr) OVER a ELSE 0 END AS nv,
      CASE WHEN count(lr) OVER z >= 2 THEN stddev_samp(lr) OVER z ELSE 0 END AS bv FROM lret
    WINDOW a AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
           z AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)))""", "bars", lret=LOGRET))
def _(spark, d):
    return E.adaptive_spread(T.bars(spark, d), 4, 0.10, 1.5).select("symbol", "timeframe", "ts", "spread_ticks")


FILL = """CASE order_type WHEN 'MARKET' THEN open
    WHEN 'LIMIT' THEN CASE side WHEN 'BUY' THEN CASE WHEN low <= limit_price THEN least(open, limit_price) END
      ELSE CASE WHEN high >= limit_price THEN greatest(open, limit_price) END END
    WHEN 'STOP' THEN CASE side WHEN 'BUY' THEN CASE WHEN high >= stop_price THEN greatest(open, stop_price) END
      ELSE CASE WHEN low <= stop_price THEN least(open, stop_price) END END
    ELSE CASE side
      WHEN 'BUY' THEN CASE WHEN open >= stop_price THEN CASE WHEN open <= limit_price THEN open END
        WHEN high >= stop_price AND low <= limit_price THEN limit_price END
      ELSE CASE WHEN open <= stop_price THEN CASE WHEN open >= limit_price THEN open END
        WHEN low <= stop_price AND high >= limit_price THEN limit_price END END END"""
NEXT = f"""SELECT o.*, b.ts AS bar_ts, b.open, b.high, b.low, b.close, CASE WHEN quantity > 0
      AND NOT (order_type IN ('LIMIT', 'STOP_LIMIT') AND limit_price IS NULL) THEN {FILL} END AS px,
    CASE WHEN quantity <= 0 THEN 'quantity not positive' WHEN order_type IN ('LIMIT', 'STOP_LIMIT') AND limit_price IS NULL
      THEN 'limit price missing' END AS rejection
  FROM ords o LEFT JOIN bars b ON b.symbol = o.symbol AND b.rn = o.rn + 1"""


@query("x5_next_bar_fill", sql(f"""
  SELECT order_id, rejection, bar_ts, {r('px', 5, 'raw_price')}, CASE WHEN px IS NOT NULL THEN CASE WHEN order_type = 'MARKET' OR px = open
    THEN 'OPEN' ELSE 'INTRABAR' END END AS fill_phase FROM nx""", "ords", nx=NEXT))
def _(spark, d):
    o = E.preview(E.next_bar(orders(spark, d), T.bars(spark, d)))
    return o.select("order_id", "rejection", "bar_ts", rd("raw_price", 5).alias("raw_price"), "fill_phase")


@query("x5_at_close", sql(f"""
  SELECT order_id, CASE WHEN order_type = 'MARKET' AND rejection IS NULL THEN {r('close', 5)} END AS raw_price,
    CASE WHEN order_type = 'MARKET' AND rejection IS NULL AND close IS NOT NULL THEN 'CLOSE' END AS fill_phase FROM nx""", "ords", nx=NEXT))
def _(spark, d):
    o = E.preview(E.next_bar(orders(spark, d), T.bars(spark, d)), at_close=True)
    return o.select("order_id", rd("raw_price", 5).alias("raw_price"), "fill_phase")


@query("x6_execute_orders", sql(f"""
  SELECT order_id, status, exec_quantity, CASE WHEN status = 'FILLED' THEN {r("CASE side WHEN 'BUY' THEN px + slip ELSE px - slip END", 5)} END AS fill_price,
    CASE WHEN status = 'FILLED' THEN {r('exec_quantity * cr', 5)} END AS commission, CASE WHEN status = 'FILLED' THEN {r('slip', 5)} END AS slippage
  FROM (SELECT *, CASE WHEN rejection IS NOT NULL THEN 'REJECTED' WHEN exec_quantity <= 0 THEN CASE WHEN reduce_only THEN 'CANCELLED' ELSE 'REJECTED' END
          WHEN px IS NOT NULL THEN 'FILLED' WHEN time_in_force = 'IOC' THEN 'CANCELLED' ELSE 'ACCEPTED' END AS status
    FROM (SELECT n.*, cr, greatest(0, round_even(spread_ticks * sm, 0)) * coalesce(sp.tick_size, 0.01) AS slip,
            CASE WHEN reduce_only THEN least(quantity, CASE side WHEN 'BUY' THEN greatest(-position, 0) ELSE greatest(position, 0) END)
              ELSE quantity END AS exec_quantity
          FROM nx n JOIN profile p ON p.order_type = n.order_type LEFT JOIN specs sp ON sp.symbol = n.symbol))""",
    "ords", "profile", "specs", nx=NEXT))
def _(spark, d):
    o = E.execute(orders(spark, d), T.bars(spark, d), PROFILE, T.specs(spark))
    return o.select("order_id", "status", "exec_quantity", *[rd(c, 5).alias(c) for c in ("fill_price", "commission", "slippage")])


@query("x7_resting_order_fill", sql(f"""
  SELECT o.order_id, q.bar_ts, {r('q.px', 5, 'raw_price')}, q.phase AS fill_phase
  FROM ords o LEFT JOIN (SELECT order_id, arg_min(bts, rn2) AS bar_ts, arg_min(px, rn2) AS px, arg_min(phase, rn2) AS phase FROM (
      SELECT *, CASE WHEN order_type = 'MARKET' OR px = open THEN 'OPEN' ELSE 'INTRABAR' END AS phase FROM (
        SELECT o.*, b.rn AS rn2, b.ts AS bts, b.open, {FILL} AS px FROM ords o JOIN bars b ON b.symbol = o.symbol AND b.rn > o.rn
        WHERE quantity > 0 AND NOT (order_type IN ('LIMIT', 'STOP_LIMIT') AND limit_price IS NULL) AND (
          order_type IN ('MARKET') AND b.rn = o.rn + 1 OR order_type <> 'MARKET' AND (time_in_force = 'IOC' AND b.rn = o.rn + 1
          OR time_in_force = 'DAY' AND CAST(b.ts AS DATE) = CAST(placed_at AS DATE) OR time_in_force = 'GTC'))) WHERE px IS NOT NULL)
    GROUP BY order_id) q ON q.order_id = o.order_id""", "ords"))
def _(spark, d):
    o = E.resting_fills(settle(orders(spark, d)), settle(T.bars(spark, d)))
    return o.select("order_id", "bar_ts", rd("raw_price", 5).alias("raw_price"), "fill_phase")


@query("x14_target_contracts", sql(f"""
  SELECT symbol, timeframe, ts, direction, CASE WHEN intent = 'CLOSE' THEN 0.0::DOUBLE ELSE n * direction END + 0.0 AS target_qty FROM (
    SELECT *, CASE WHEN close > 0 AND direction <> 0 THEN least(round_even(greatest(0, budget / nullif(vol * close * multiplier, 0)), 0),
        floor(margin / nullif(close * multiplier * 0.10::DOUBLE, 0)), 40) ELSE 0 END AS n
    FROM (SELECT b.symbol, b.timeframe, b.ts, b.close, CAST(rn % 3 - 1 AS INTEGER) AS direction, CASE WHEN rn % 10 = 0 THEN 'CLOSE' ELSE 'OPEN' END AS intent,
        coalesce(sp.multiplier, 1.0) AS multiplier, 1000000.0::DOUBLE * 0.12 * sqrt(0.4::DOUBLE) * least(1 / sqrt(0.5::DOUBLE), sqrt(1.5::DOUBLE)) / 2 AS budget,
        1000000.0::DOUBLE * 0.4 / 2 AS margin,
        coalesce(CASE WHEN v > 0 THEN v END * sqrt(8000::DOUBLE), 1.0) AS vol
      FROM (SELECT *, CASE WHEN count(lr) OVER w >= 20 THEN stddev_samp(lr) OVER w END AS v FROM lret
            WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) b
      LEFT JOIN specs sp ON sp.symbol = b.symbol))""", "bars", "specs", lret=LOGRET))
def _(spark, d):
    s = Series(T.bars(spark, d))
    v = realized_vol(s, 20)
    x = E.with_specs(s.frame(), T.specs(spark)).select(
        "symbol", "timeframe", "ts", F.col("close").alias("price"), "multiplier", "margin_ratio",
        (F.col("_rn") % 3 - 1).cast("int").alias("direction"),
        F.when(F.col("_rn") % 10 == 0, "CLOSE").otherwise("OPEN").alias("intent"),
        F.lit(1000000.0).alias("equity"), F.lit(0.4).alias("weight"), F.lit(0.5).alias("duty_cycle"),
        F.lit(2).alias("n_symbols"), (F.col(v) * F.sqrt(F.lit(8000.0))).alias("annual_vol"))
    t = E.target_contracts(x, 0.12, 1.5, 40)
    return t.select("symbol", "timeframe", "ts", "direction", (F.col("target_qty") + 0.0).alias("target_qty"))


@query("x15_target_deltas", sql("""
  SELECT slot_id, symbol, target_qty, exposure, delta, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS quantity,
    (exposure > 0 AND delta < 0 AND target_qty >= 0) OR (exposure < 0 AND delta > 0 AND target_qty <= 0) AS reduce_only
  FROM (SELECT *, target_qty - exposure AS delta FROM (
    SELECT t.slot_id, t.symbol, target_qty, coalesce(position, 0) + coalesce(p, 0) AS exposure
    FROM (SELECT slot_id, symbol, CAST(count(*) % 9 AS DOUBLE) - 4 AS target_qty FROM fills GROUP BY 1, 2) t
    LEFT JOIN (SELECT slot_id, symbol, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS position FROM fills GROUP BY 1, 2) q
      ON q.slot_id = t.slot_id AND q.symbol = t.symbol
    LEFT JOIN (SELECT slot_id, symbol, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS p FROM fills
      WHERE NOT fill_id % 4 = 0 AND quantity = 2 GROUP BY 1, 2) w ON w.slot_id = t.slot_id AND w.symbol = t.symbol))
  WHERE abs(delta) >= 0.5""", "fills"))
def _(spark, d):
    f = T.fills(spark, d)
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    targets = f.groupBy("slot_id", "symbol").agg((F.count("*") % 9 - 4).cast("double").alias("target_qty"))
    positions = f.groupBy("slot_id", "symbol").agg(F.sum(signed).alias("position"))
    pending = f.where(F.col("quantity") == 2).select(
        "slot_id", "symbol", signed.alias("signed_quantity"), (F.col("fill_id") % 4 == 0).alias("reduce_only"))
    return E.target_deltas(targets, positions, pending)


@query("x16_gross_pnl", sql(f"""
  SELECT trade_id, {r("CASE direction WHEN 'LONG' THEN 1 ELSE -1 END * (exit_price - entry_price) * quantity * coalesce(sp.multiplier, 1.0)", 2, 'gross_pnl')}
  FROM itrades t LEFT JOIN specs sp ON sp.symbol = t.symbol""", "itrades", "specs"))
def _(spark, d):
    return E.gross_pnl(E.with_specs(T.intraday_trades(spark, d), T.specs(spark))).select("trade_id", rd("gross_pnl", 2).alias("gross_pnl"))
