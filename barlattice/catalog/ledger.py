"""X10-X13: round trips, ledgers, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.catalog.core import CTES, query, r, sql
from barlattice.functions.exprs import rd
from barlattice.operators import execution as E
from barlattice.operators import ledger as L
from barlattice.sources import tables as T
from barlattice.plans.lineage import settle


def fills(spark, d):
    return E.with_specs(T.fills(spark, d), T.specs(spark))


CTES["xfills"] = (("fills", "specs"), """SELECT f.*, coalesce(sp.multiplier, 1.0::DOUBLE) AS multiplier, 0.1::DOUBLE AS margin_ratio,
    CASE side WHEN 'BUY' THEN quantity ELSE -quantity END AS sq FROM fills f LEFT JOIN specs sp ON sp.symbol = f.symbol""")
CTES["fifo"] = (("xfills",), """
  SELECT b.slot_id, b.symbol, CASE WHEN b.ts < s.ts THEN 'LONG' ELSE 'SHORT' END AS direction,
    least(b.hi, s.hi) - greatest(b.lo, s.lo) AS quantity, b.multiplier,
    CASE WHEN b.ts < s.ts THEN b.fill_id ELSE s.fill_id END AS entry_fill, CASE WHEN b.ts < s.ts THEN s.fill_id ELSE b.fill_id END AS exit_fill,
    (s.fill_price - b.fill_price) * (least(b.hi, s.hi) - greatest(b.lo, s.lo)) * b.multiplier AS gross,
    (b.commission / b.quantity + s.commission / s.quantity) * (least(b.hi, s.hi) - greatest(b.lo, s.lo)) AS commission,
    (b.slippage + s.slippage) * b.multiplier * (least(b.hi, s.hi) - greatest(b.lo, s.lo)) AS slippage
  FROM (SELECT *, hi - quantity AS lo FROM (SELECT *, sum(quantity) OVER (PARTITION BY slot_id, symbol, side ORDER BY ts, fill_id) AS hi FROM xfills) WHERE side = 'BUY') b
  JOIN (SELECT *, hi - quantity AS lo FROM (SELECT *, sum(quantity) OVER (PARTITION BY slot_id, symbol, side ORDER BY ts, fill_id) AS hi FROM xfills) WHERE side = 'SELL') s
  ON b.slot_id = s.slot_id AND b.symbol = s.symbol AND b.lo < s.hi AND s.lo < b.hi""")


@query("x10_fifo_round_trips", sql(f"""
  SELECT slot_id, symbol, direction, quantity, entry_fill, exit_fill, {r('gross - commission', 4, 'pnl')}, {r('commission', 4, 'commission')},
    {r('slippage', 4, 'slippage')} FROM fifo""", "fifo"))
def _(spark, d):
    t = L.round_trips(fills(spark, d))
    return t.select("slot_id", "symbol", "direction", "quantity", "entry_fill", "exit_fill",
                    *[rd(c, 4).alias(c) for c in ("pnl", "commission", "slippage")])


def _exact(side: str) -> str:
    """Intervals of one side's cumulative quantity, in decimals."""
    return f"""(SELECT *, hi - q AS lo FROM (SELECT *, sum(q) OVER (PARTITION BY slot_id, symbol ORDER BY ts, fill_id) AS hi FROM (
      SELECT *, CAST(quantity * CASE side WHEN 'BUY' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS DECIMAL(18, 9)) AS q FROM xfills
      WHERE side = '{side}')))"""


@query("x10_fractional_lots", sql(f"""
  SELECT b.slot_id, b.symbol, CASE WHEN (b.ts, b.fill_id) < (s.ts, s.fill_id) THEN 'LONG' ELSE 'SHORT' END AS direction,
    b.fill_id AS buy_fill, s.fill_id AS sell_fill, CAST(least(b.hi, s.hi) - greatest(b.lo, s.lo) AS DOUBLE) AS quantity
  FROM {_exact('BUY')} b JOIN {_exact('SELL')} s
  ON b.slot_id = s.slot_id AND b.symbol = s.symbol AND b.lo < s.hi AND s.lo < b.hi""", "xfills"))
def _(spark, d):
    lots = fills(spark, d).withColumn("quantity", F.col("quantity") * F.when(F.col("side") == "BUY", 0.3).otherwise(0.1))
    t = L.round_trips(lots)
    long = F.col("direction") == "LONG"
    return t.select("slot_id", "symbol", "direction", F.when(long, F.col("entry_fill")).otherwise(F.col("exit_fill")).alias("buy_fill"),
                    F.when(long, F.col("exit_fill")).otherwise(F.col("entry_fill")).alias("sell_fill"), "quantity")


@query("x11_single_ledger", sql(f"""
  SELECT b.symbol, b.ts, coalesce(pos, 0) AS position, {r('100000 + coalesce(cash, 0)', 4, 'cash')}, {r('coalesce(pos, 0) * b.close * m', 4, 'holdings')},
    {r('100000 + coalesce(cash, 0) + coalesce(pos, 0) * b.close * m', 4, 'total_value')}
  FROM bars b JOIN (SELECT symbol, max(multiplier) AS m FROM xfills GROUP BY 1) sp ON sp.symbol = b.symbol ASOF LEFT JOIN (
    SELECT symbol, ts, sum(sum(sq)) OVER w AS pos, sum(sum(-sq * fill_price * multiplier - commission)) OVER w AS cash FROM xfills GROUP BY symbol, ts
    WINDOW w AS (PARTITION BY symbol ORDER BY ts)) f ON f.symbol = b.symbol AND b.ts >= f.ts""", "bars", "xfills"))
def _(spark, d):
    x = L.single_ledger(fills(spark, d), T.bars(spark, d), 100000.0)
    return x.select("symbol", "ts", "position", *[rd(c, 4).alias(c) for c in ("cash", "holdings", "total_value")])


CTES["book"] = (("bars", "xfills"), """
  SELECT k.slot_id, k.symbol, b.ts, f.pos AS position, b.close AS price, f.cash + f.pos * b.close * k.m AS cum_pnl, f.pos * b.close * k.m AS notional,
    abs(f.pos * b.close * k.m) * 0.1::DOUBLE AS margin_used
  FROM (SELECT slot_id, symbol, min(ts) AS f0, max(multiplier) AS m FROM xfills GROUP BY 1, 2) k JOIN bars b ON b.symbol = k.symbol AND b.ts >= k.f0
  ASOF JOIN (SELECT slot_id, symbol, ts, sum(sum(sq)) OVER w AS pos, sum(sum(-sq * fill_price * multiplier - commission)) OVER w AS cash FROM xfills
    GROUP BY slot_id, symbol, ts WINDOW w AS (PARTITION BY slot_id, symbol ORDER BY ts)) f ON f.slot_id = k.slot_id AND f.symbol = k.symbol AND b.ts >= f.ts""")
CTES["grid"] = (("book",), """
  SELECT a.ts, k.slot_id, k.symbol, b.cum_pnl, b.notional, b.margin_used FROM (SELECT DISTINCT ts FROM book) a
  CROSS JOIN (SELECT DISTINCT slot_id, symbol FROM book) k ASOF JOIN book b ON b.slot_id = k.slot_id AND b.symbol = k.symbol AND a.ts >= b.ts""")


@query("x12_slot_ledger", sql(f"""SELECT slot_id, symbol, ts, position, {r('price', 4, 'price')}, {r('cum_pnl', 4, 'cum_pnl')}, {r('notional', 4, 'notional')},
  {r('margin_used', 4, 'margin_used')} FROM book""", "book"))
def _(spark, d):
    x = L.slot_ledger(fills(spark, d), T.bars(spark, d))
    return x.select("slot_id", "symbol", "ts", "position", rd("price", 4).alias("price"),
                    *[rd(c, 4).alias(c) for c in ("cum_pnl", "notional", "margin_used")])


@query("x12_portfolio_totals", sql(f"""SELECT ts, {r('1000000 + sum(cum_pnl)', 4, 'total_value')}, {r('sum(abs(notional))', 4, 'gross_notional')},
  {r('sum(margin_used)', 4, 'margin_used')} FROM grid GROUP BY ts""", "grid"))
def _(spark, d):
    x = L.portfolio_totals(settle(L.slot_ledger(fills(spark, d), T.bars(spark, d))), 1000000.0)
    return x.select("ts", *[rd(c, 4).alias(c) for c in ("total_value", "gross_notional", "margin_used")])


@query("x12_net_positions", sql("""SELECT symbol, ts, sum(position) AS net_position FROM book GROUP BY 1, 2""", "book"))
def _(spark, d):
    return L.net_positions(L.slot_ledger(fills(spark, d), T.bars(spark, d))).drop("run_id")


@query("j5_common_time_axis", sql(f"""
  SELECT slot_id, ts, {r('coalesce(sum(cum_pnl), 0)', 4, 'cum_pnl')} FROM grid GROUP BY 1, 2
  UNION ALL SELECT s.slot_id, a.ts, 0.0::DOUBLE FROM (SELECT DISTINCT ts FROM book) a CROSS JOIN (VALUES (0), (1), (2)) AS s(slot_id)
  WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.ts = a.ts AND g.slot_id = s.slot_id)""", "grid"))
def _(spark, d):
    book = settle(L.slot_ledger(fills(spark, d), T.bars(spark, d)))
    per_slot = settle(L.portfolio_totals(book, 0.0, ("run_id", "slot_id")))
    return L.on_common_axis(per_slot, book, [0, 1, 2], "cum_pnl").select("slot_id", "ts", rd("cum_pnl", 4).alias("cum_pnl"))


BREACH = """SELECT *, equity - first_value(equity) OVER (PARTITION BY stream, CAST(ts AS DATE) ORDER BY ts) < -400 AS dl,
    (pk - equity) / pk > 0.01 AS dd, equity <= 99000 AS fl
  FROM (SELECT *, greatest(100000::DOUBLE, max(equity) OVER (PARTITION BY stream ORDER BY ts)) AS pk FROM hourly)"""


@query("x13_limit_breaches", sql(f"""SELECT stream, ts, {r('equity', 4, 'equity')}, dl AS daily_loss_breach, dd AS drawdown_breach, fl AS floor_breach
  FROM br WHERE dl OR dd OR fl""", "hourly", br=BREACH))
def _(spark, d):
    return L.limit_breaches(settle(T.hourly_equity(spark, d)), 100000.0, 400.0, 0.01, 99000.0).withColumn("equity", rd("equity", 4))


@query("x13_first_breaches", sql("""SELECT stream, min(ts) FILTER (dl) AS first_daily_loss, min(ts) FILTER (dd) AS first_drawdown,
  min(ts) FILTER (fl) AS first_floor FROM br WHERE dl OR dd OR fl GROUP BY 1""", "hourly", br=BREACH))
def _(spark, d):
    return L.first_breaches(L.limit_breaches(settle(T.hourly_equity(spark, d)), 100000.0, 400.0, 0.01, 99000.0))
