"""Round trips, cash and equity ledgers and limit checks rebuilt from fills as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.exprs import DAY, falsy, over_zero
from barlattice.plans.asof import asof
from barlattice.plans.blocks import Series, running
from barlattice.plans.lineage import settle
from barlattice.plans.salt import join_small

BOOK = ["run_id", "slot_id", "symbol"]
FILL_PARTS = 96  # parts of a period in which the fills of a book are added up


def _signed() -> Column:
    return F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))


def round_trips(
    fills: DataFrame, keys: Sequence[str] = BOOK, period_seconds: int = DAY, part_rows: int = 10_000
) -> DataFrame:
    """First-in-first-out trades of every book.

    Under FIFO the k-th unit bought closes against the k-th unit sold. Each fill covers an interval
    of its side's cumulative quantity, in exact decimals. The ends of all intervals of both sides cut
    the axis; between two cuts one buy meets one sell, opened by the earlier fill, so there are at
    most as many trades as fills. A cut finds its buy and its sell among the next ends at or above
    it. The axis of a book is shared out in parts of about ``part_rows`` ends; what a part takes from
    its neighbours comes from one row per part. Needs ``multiplier`` and a ``fill_id`` that orders
    equal timestamps; fills without quantity are left out.
    """
    keys = list(keys)
    exact = fills.withColumn("_q", F.col("quantity").cast("decimal(28,9)")).where("_q > 0")
    cum = running(exact, [*keys, "side"], "ts", sums={"_hi": "_q"}, tie=["fill_id"],
                  period_seconds=period_seconds, parts=FILL_PARTS)
    reason = "exit_reason" if "exit_reason" in fills.columns else None
    fill = F.struct("ts", "fill_id", "fill_price", "commission", "slippage", "quantity",
                    (F.col(reason) if reason else F.lit(None).cast("string")).alias("exit_reason"))
    ends = settle(cum.select(*keys, "side", "multiplier", F.col("_hi").cast("decimal(38,9)").alias("_hi"), fill.alias("_f")))
    books = settle(ends.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "BUY", F.col("_hi"))).alias("_bought"),
        F.max(F.when(F.col("side") == "SELL", F.col("_hi"))).alias("_sold"),
        F.count(F.lit(1)).alias("_n"), F.max("multiplier").alias("_multiplier")))
    books = books.where("_bought is not null and _sold is not null").select(
        *keys, "_multiplier", F.least("_bought", "_sold").alias("_limit"),
        (F.greatest("_bought", "_sold").cast("double") / F.ceil(F.col("_n") / part_rows)).alias("_width"))
    cuts = (
        ends.drop("multiplier").join(books, keys)
        .withColumn("_part", F.floor(F.col("_hi").cast("double") / F.col("_width")))
        .groupBy(*keys, "_part", "_hi", "_limit", "_multiplier")
        .agg(F.max(F.when(F.col("side") == "BUY", F.col("_f"))).alias("_b"),
             F.max(F.when(F.col("side") == "SELL", F.col("_f"))).alias("_s"))
    )
    above = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = cuts.groupBy(*keys, "_part").agg(
        F.min_by("_b", F.when(F.col("_b").isNotNull(), F.col("_hi"))).alias("_b"),
        F.min_by("_s", F.when(F.col("_s").isNotNull(), F.col("_hi"))).alias("_s"), F.max("_hi").alias("_top"))
    edges = edges.select(
        *keys, "_part", F.last("_b", ignorenulls=True).over(above).alias("_next_b"),
        F.last("_s", ignorenulls=True).over(above).alias("_next_s"), F.last("_top").over(below).alias("_below"))
    inside = Window.partitionBy(*keys, "_part")
    down = inside.orderBy(F.desc("_hi")).rowsBetween(Window.unboundedPreceding, 0)
    pairs = cuts.join(edges, [*keys, "_part"]).select(
        *keys, F.col("_multiplier").alias("multiplier"), "_hi", "_limit",
        F.coalesce(F.last("_b", ignorenulls=True).over(down), F.col("_next_b")).alias("_b"),
        F.coalesce(F.last("_s", ignorenulls=True).over(down), F.col("_next_s")).alias("_s"),
        F.coalesce(F.lag("_hi").over(inside.orderBy("_hi")), F.col("_below"), F.lit(0).cast("decimal(38,9)")).alias("_lo"))
    pairs = pairs.where(F.col("_hi") <= F.col("_limit")).withColumn(
        "matched", (F.col("_hi") - F.col("_lo")).cast("double"))
    buy_first = F.struct("_b.ts", "_b.fill_id") < F.struct("_s.ts", "_s.fill_id")
    return _as_trades(pairs, keys, buy_first)


def _as_trades(pairs: DataFrame, keys: Sequence[str], buy_first: Column) -> DataFrame:
    p = pairs.withColumn("direction", F.when(buy_first, "LONG").otherwise("SHORT"))
    long = F.col("direction") == "LONG"
    opener = F.when(long, F.col("_b")).otherwise(F.col("_s"))
    closer = F.when(long, F.col("_s")).otherwise(F.col("_b"))
    p = p.withColumns({"_e": opener, "_x": closer})
    sign = F.when(long, 1.0).otherwise(-1.0)
    gross = sign * (F.col("_x.fill_price") - F.col("_e.fill_price")) * F.col("matched") * F.col("multiplier")
    comm = (F.col("_e.commission") / F.col("_e.quantity")
            + F.col("_x.commission") / F.col("_x.quantity")) * F.col("matched")
    slip = (F.abs("_e.slippage") + F.abs("_x.slippage")) * F.col("multiplier") * F.col("matched")
    return p.select(
        *keys, "direction",
        F.col("_e.ts").alias("entry_time"), F.col("_x.ts").alias("exit_time"),
        F.col("_e.fill_id").alias("entry_fill"), F.col("_x.fill_id").alias("exit_fill"),
        F.col("_e.fill_price").alias("entry_price"), F.col("_x.fill_price").alias("exit_price"),
        F.col("matched").alias("quantity"), (gross - comm).alias("pnl"), gross.alias("gross_pnl"),
        comm.alias("commission"), slip.alias("slippage"), F.col("_x.exit_reason").alias("exit_reason"),
    )


def book_flows(fills: DataFrame, keys: Sequence[str], period_seconds: int = DAY) -> DataFrame:
    """Position and cash flow of each book after every fill time."""
    flow = -_signed() * F.col("fill_price") * F.col("multiplier") - F.col("commission")
    step = fills.groupBy(*keys, "ts").agg(F.sum(_signed()).alias("_dq"), F.sum(flow).alias("_dc"))
    return running(step, list(keys), "ts", sums={"position": "_dq", "cash_flow": "_dc"},
                   period_seconds=period_seconds, parts=FILL_PARTS).drop("_dq", "_dc")


def single_ledger(
    fills: DataFrame, bars: DataFrame, initial: float, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Cash, holdings and total value at every bar of the book's symbol."""
    keys = list(keys)
    b = asof(bars.select(*keys, "ts", "close"), book_flows(fills, keys), keys, "ts", "ts",
             {"position": "position", "cash_flow": "cash_flow"})
    if "multiplier" in fills.columns:
        b = join_small(b, fills.groupBy(*keys).agg(F.max("multiplier").alias("multiplier")), keys, how="left")
    zero = F.lit(0.0)
    hold = F.coalesce("position", zero) * F.col("close") * F.coalesce("multiplier", F.lit(1.0))
    return b.select(
        *keys, "ts", F.coalesce("position", zero).alias("position"),
        (F.lit(initial) + F.coalesce("cash_flow", zero)).alias("cash"), hold.alias("holdings"),
        (F.lit(initial) + F.coalesce("cash_flow", zero) + hold).alias("total_value"))


def slot_ledger(fills: DataFrame, prices: DataFrame, period_seconds: int = DAY) -> DataFrame:
    """Per book and price time of its symbol: position, price, cumulative PnL, notional, margin.

    ``prices`` are (symbol, ts, close); spec columns come on the fills. PnL is realised plus
    unrealised: cash flow plus position at the price. A book has no rows before its first fill.
    """
    books = fills.groupBy(*BOOK).agg(
        F.min("ts").alias("_first"), F.max("multiplier").alias("multiplier"),
        F.max("margin_ratio").alias("margin_ratio"))
    points = join_small(
        prices.select("symbol", "ts", F.col("close").alias("price")), books, ["symbol"]
    ).where(F.col("ts") >= F.col("_first")).drop("_first")
    out = asof(points, book_flows(fills, BOOK, period_seconds), BOOK, "ts", "ts",
               {"position": "position", "cash_flow": "cash_flow"}, period_seconds=period_seconds)
    notional = F.col("position") * F.col("price") * F.col("multiplier")
    return out.select(
        *BOOK, "ts", "position", "price", (F.col("cash_flow") + notional).alias("cum_pnl"),
        notional.alias("notional"), (F.abs(notional) * F.col("margin_ratio")).alias("margin_used"))


def portfolio_totals(
    slots: DataFrame, initial: float, keys: Sequence[str] = ("run_id",), period_seconds: int = DAY
) -> DataFrame:
    """Total value, gross notional and margin at every time any book has a row.

    A book keeps its last values until its next row, so the totals are running sums of the books'
    changes; no table of all books at all times is built. ``keys`` may add ``slot_id``.
    """
    keys = list(keys)
    s = Series(slots.withColumn("_abs", F.abs("notional")), BOOK, period_seconds=period_seconds)
    prev = {c: s.lag(c) for c in ("cum_pnl", "_abs", "margin_used")}
    step = s.frame().groupBy(*keys, "ts").agg(*[
        F.sum(F.col(c) - F.coalesce(F.col(p), F.lit(0.0))).alias(f"_d{c}") for c, p in prev.items()])
    run = running(step, keys, "ts", period_seconds=period_seconds, sums={
        "cum_pnl": "_dcum_pnl", "gross_notional": "_d_abs", "margin_used": "_dmargin_used"})
    return run.select(*keys, "ts", "cum_pnl", (F.lit(initial) + F.col("cum_pnl")).alias("total_value"),
                      "gross_notional", "margin_used")


def on_common_axis(
    rows: DataFrame, axis: DataFrame, slots: Sequence[int], value: str, period_seconds: int = DAY
) -> DataFrame:
    """Last known ``value`` of each listed slot at every time of ``axis`` (run_id, ts); 0 before it."""
    grid = axis.select("run_id", "ts").distinct().withColumn(
        "slot_id", F.explode(F.array(*[F.lit(i) for i in slots])))
    out = asof(grid, rows.select("run_id", "slot_id", F.col("ts").alias("_t"), value),
               ["run_id", "slot_id"], "ts", "_t", {value: value}, period_seconds=period_seconds)
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def net_positions(slots: DataFrame) -> DataFrame:
    return slots.groupBy("run_id", "symbol", "ts").agg(F.sum("position").alias("net_position"))


def limit_breaches(
    equity: DataFrame, initial: float, daily_loss: float | None = None,
    max_drawdown: float | None = None, floor: float | None = None,
    keys: Sequence[str] = ("stream",), period_seconds: int = DAY,
) -> DataFrame:
    """Rows breaking the daily-loss, drawdown or account-floor limit, each flagged."""
    keys = list(keys)
    peaks = running(equity, keys, "ts", maxes={"_peak": "equity"}, period_seconds=period_seconds)
    peak = F.greatest(F.col("_peak"), F.lit(initial))
    day = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts")
    start = F.first("equity").over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    no = F.lit(False)
    flags = {
        "daily_loss_breach": no if daily_loss is None else F.col("equity") - start < -daily_loss,
        "drawdown_breach": no if max_drawdown is None else falsy(
            over_zero(peak - F.col("equity"), F.when(peak > 0, peak)) > max_drawdown),
        "floor_breach": no if floor is None else F.col("equity") <= floor,
    }
    any_flag = F.col("daily_loss_breach") | F.col("drawdown_breach") | F.col("floor_breach")
    return peaks.withColumns(flags).drop("_peak").where(any_flag)


def first_breaches(breaches: DataFrame, keys: Sequence[str] = ("stream",)) -> DataFrame:
    def first(flag: str) -> Column:
        return F.min(F.when(F.col(flag), F.col("ts")))

    return breaches.groupBy(*keys).agg(
        first("daily_loss_breach").alias("first_daily_loss"),
        first("drawdown_breach").alias("first_drawdown"), first("floor_breach").alias("first_floor"))
