"""Bars, fills, trades and equity derived from the star-schema and event tables.

These give every operator a table of its own shape whose size follows the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.functions.exprs import floor_to
from barlattice.plans.blocks import Series, running

TF_SECONDS = {"1m": 60, "5m": 300, "30m": 1800, "1h": 3600}
SLOTS = {0: "alpha", 1: "beta", 2: "gamma"}
WEIGHTS = {0: 0.5, 1: 0.3, 2: 0.2}
STATUS_SLOTS = {"F": 0, "O": 1, "P": 2}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    """OHLCV per event type from event values; the clock unit is ``tf``."""
    e = load(spark, sf_dir, "events").select(
        "event_type", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    order = F.struct("ts", "event_id")
    return (
        e.groupBy(F.col("event_type").alias("symbol"), floor_to("ts", TF_SECONDS[tf]).alias("bar"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.sum("k").cast("double").alias("volume"),
            F.avg("value").alias("average"),
        )
        .select(
            "symbol",
            F.lit(tf).alias("timeframe"),
            F.col("bar").alias("ts"),
            "open", "high", "low", "close", "volume", "average",
            F.concat(
                "symbol", F.lit("_"),
                F.floor((F.dayofmonth("bar") - 1) / 7).cast("long").cast("string"),
            ).alias("contract"),
        )
    )


def specs(spark: SparkSession) -> DataFrame:
    """Tick size and multiplier per event type (one symbol is left to the defaults)."""
    rows = [("click", 0.01, 1.0), ("error", 0.01, 5.0), ("purchase", 0.01, 20.0),
            ("signup", 0.01, 50.0)]
    return spark.createDataFrame(rows, "symbol STRING, tick_size DOUBLE, multiplier DOUBLE")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.lit("0").alias("run_id"),
        (F.col("user_id") % 3).cast("int").alias("slot_id"),
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("fill_id"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (1 + k % 3).cast("double").alias("quantity"),
        F.col("value").alias("fill_price"),
        (2.5 * (1 + k % 3)).cast("double").alias("commission"),
        F.lit(0.01).alias("slippage"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades with long holds from line items and their orders."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    pnl = F.col("l_extendedprice") * (0.05 - F.col("l_discount"))
    commission = F.col("l_extendedprice") * F.col("l_tax") * 0.01
    slippage = F.col("l_extendedprice") * 0.0005
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("0").alias("run_id"),
        F.col("l_returnflag").alias("strategy"),
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("direction"),
        F.least("o_orderdate", "l_shipdate").alias("entry_time"),
        F.greatest("o_orderdate", "l_shipdate").alias("exit_time"),
        F.col("l_quantity").alias("quantity"),
        pnl.alias("pnl"),
        commission.alias("commission"),
        slippage.alias("slippage"),
        F.col("o_orderpriority").alias("exit_reason"),
    )


def intraday_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per hourly bar, closed one to six bars later at that bar's close."""
    s = Series(bars(spark, sf_dir))
    for k in range(1, 7):
        s.lead("ts", k)
        s.lead("close", k)
    n = F.col("_rn")

    def pick(c: str) -> Column:
        out = F.lit(None)
        for k in range(1, 7):
            out = F.when(n % 6 == k - 1, F.col(f"_{c}_lead{k}")).otherwise(out)
        return out

    sign = F.when(n % 2 == 0, 1.0).otherwise(-1.0)
    return (
        s.frame()
        .select(
            F.concat_ws("-", "symbol", n.cast("string")).alias("trade_id"),
            F.lit("0").alias("run_id"),
            (n % 3).cast("int").alias("slot_id"),
            "symbol",
            F.when(n % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
            F.col("ts").alias("entry_time"),
            pick("ts").alias("exit_time"),
            F.col("open").alias("entry_price"),
            pick("close").alias("exit_price"),
            F.lit(1.0).alias("quantity"),
            (sign * (pick("close") - F.col("open"))).alias("pnl"),
            F.lit(0.5).alias("commission"),
            F.lit(0.25).alias("slippage"),
            F.when(n % 3 == 0, "TAKE_PROFIT")
            .when(n % 3 == 1, "STOP_LOSS").otherwise("TIME_STOP").alias("exit_reason"),
        )
        .where(F.col("exit_time").isNotNull())
        .withColumn("strategy", F.element_at(
            F.array(*[F.lit(v) for v in SLOTS.values()]), F.col("slot_id") + 1))
    )


def slot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative PnL per slot and hour, on the union of all hours."""
    e = load(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("int").alias("slot_id"), floor_to("ts", 3600).alias("ts"), "value"
    )
    mean = e.groupBy("slot_id").agg(F.avg("value").alias("m"))
    step = e.groupBy("slot_id", "ts").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    step = step.join(F.broadcast(mean), "slot_id").select(
        "slot_id", "ts", (F.col("v") - F.col("n") * F.col("m")).alias("step")
    )
    axis = step.select("ts").distinct().withColumn(
        "slot_id", F.explode(F.array(*[F.lit(k) for k in SLOTS]))
    )
    dense = axis.join(step, ["slot_id", "ts"], "left").fillna(0.0, ["step"])
    return running(dense, ["slot_id"], "ts", sums={"cum_pnl": "step"}).select(
        F.lit("0").alias("run_id"), "slot_id", "ts", "cum_pnl"
    )


def run_totals(slots: DataFrame) -> DataFrame:
    return slots.groupBy("run_id", "ts").agg(
        (F.lit(100000.0) + F.sum("cum_pnl")).alias("total_value"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_totals(slot_history(spark, sf_dir))


def daily_slot_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day PnL per order status over about 2,400 order days."""
    o = load(spark, sf_dir, "orders")
    w = F.when(F.col("o_orderstatus") == "F", 1.0).when(
        F.col("o_orderstatus") == "O", -1.0).otherwise(0.1)
    slot = F.when(F.col("o_orderstatus") == "F", 0).when(
        F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.groupBy(slot.alias("slot_id"), F.to_date("o_orderdate").alias("day")).agg(
        (F.sum(F.col("o_totalprice") * w) / 1009.0).alias("pnl")
    )


def daily_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-of-day equity per status stream: 1,000,000 plus cumulative day PnL."""
    d = daily_slot_pnl(spark, sf_dir).withColumn("ts", F.col("day").cast("timestamp_ntz"))
    return running(d, ["slot_id"], "ts", sums={"cum": "pnl"}, period_seconds=86400 * 366).select(
        F.concat(F.lit("slot_"), F.col("slot_id").cast("string")).alias("stream"),
        "slot_id", "ts", "day", (F.lit(1000000.0) + F.col("cum")).alias("equity"),
    )


def hourly_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standalone hourly equity per slot plus the portfolio, one stream each."""
    own = F.concat(F.lit("slot_"), F.col("slot_id").cast("string"))
    return (
        slot_history(spark, sf_dir)
        .select(F.explode(F.array(own, F.lit("portfolio"))).alias("stream"), "ts", "cum_pnl")
        .groupBy("stream", "ts")
        .agg((F.lit(100000.0) + F.sum("cum_pnl")).alias("equity"))
    )


def fold_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial statistics per fold from line items; part keys stand for parameter sets."""
    li = load(spark, sf_dir, "lineitem")
    return (
        li.groupBy(
            (1 + F.col("l_orderkey") % 5).cast("int").alias("fold_id"),
            F.col("l_partkey").alias("trial_id"),
        )
        .agg(
            (F.avg(F.col("l_discount") * 40 - 1) / 1.0093).alias("sharpe"),
            (F.avg(F.col("l_tax") * 50 - 1) / 1.0107).alias("sortino"),
            F.count(F.lit(1)).alias("trades"),
            (-F.max("l_quantity") * 0.5).alias("max_drawdown"),
            F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).alias("win_rate"),
            F.avg("l_extendedprice").alias("avg_win"),
            (-F.avg(F.col("l_extendedprice") * 0.9)).alias("avg_loss"),
        )
        .withColumn("fast", F.col("trial_id") % 7 + 5)
        .withColumn("mult", (F.col("trial_id") % 11) * 0.25 + 0.5)
        .withColumn("side", F.element_at(
            F.array(F.lit("both"), F.lit("long"), F.lit("short")),
            (F.col("trial_id") % 3 + 1).cast("int")))
    )


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notional per slot, symbol and hour (signed traded value of that hour)."""
    return (
        fills(spark, sf_dir)
        .withColumn("signed", F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0))
        .groupBy("run_id", "slot_id", "symbol", floor_to("ts", 3600).alias("ts"))
        .agg(
            F.sum(F.col("signed") * F.col("quantity")).alias("qty"),
            F.sum(F.col("signed") * F.col("quantity") * F.col("fill_price")).alias("notional"),
        )
    )


