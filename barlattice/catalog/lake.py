"""S: sources and sinks, on tables that a job would read or write."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.catalog.core import query, r, sql
from barlattice.catalog.walkforward import verdicts
from barlattice.functions.exprs import rd
from barlattice.operators import metrics as M
from barlattice.plans.lineage import shared_folder
from barlattice.sources import artifacts as A
from barlattice.sources import lake as S
from barlattice.sources import tables as T

OHLCV = "symbol, timeframe, ts, open, high, low, close, volume"
COLS = OHLCV.split(", ")


def both(spark, d):
    """A lake of hourly and 5-minute bars."""
    return T.bars(spark, d).select(*COLS).unionByName(T.bars(spark, d, "5m").select(*COLS))


LAKE = f"SELECT {OHLCV} FROM bars UNION ALL SELECT {OHLCV} FROM bars5"


@query("s1_load_series", sql(f"SELECT {OHLCV} FROM bars5 WHERE symbol = 'view' AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'", "bars5"))
def _(spark, d):
    return S.load(both(spark, d), "view", "5m", "2024-01-03 00:00:00", "2024-01-20 12:00:00")


@query("s2_load_timeframes", sql(f"SELECT {OHLCV} FROM lake WHERE symbol = 'click'", "bars", "bars5", lake=LAKE))
def _(spark, d):
    return S.load_timeframes(both(spark, d), "click")


@query("s4_list_symbols", sql("SELECT DISTINCT symbol FROM lake", "bars", "bars5", lake=LAKE))
def _(spark, d):
    return S.list_symbols(both(spark, d))


@query("s5_inventory", sql("""SELECT s.symbol, t.timeframe, n AS bars, a AS start_ts, z AS end_ts, n IS NOT NULL AS exists FROM (SELECT DISTINCT symbol FROM bars) s
  CROSS JOIN (VALUES ('1m'), ('5m'), ('30m'), ('1h')) AS t(timeframe) LEFT JOIN (SELECT symbol, timeframe, count(*) AS n, min(ts) AS a, max(ts) AS z FROM lake GROUP BY 1, 2) l
  ON l.symbol = s.symbol AND l.timeframe = t.timeframe""", "bars", "bars5", lake=LAKE))
def _(spark, d):
    return S.inventory(both(spark, d))


@query("s6_freshness", sql("""SELECT symbol, timeframe, max(ts) AS last_ts, CASE WHEN max(ts) < TIMESTAMP '2024-02-09 22:30:00' - INTERVAL 10 DAY THEN 'stale' ELSE 'fresh' END AS status
  FROM lake GROUP BY 1, 2""", "bars", "bars5", lake=LAKE))
def _(spark, d):
    return S.freshness(both(spark, d), "2024-02-09 22:30:00")


def wanted(spark, d):
    return T.bars(spark, d).select("symbol").distinct().withColumn("timeframe", F.explode(F.array(F.lit("30m"), F.lit("1h"))))


@query("s7_failed_requirements", sql("""SELECT s.symbol, t.timeframe, z AS last_ts, CASE WHEN z IS NULL THEN 'missing' ELSE 'stale' END AS status FROM (SELECT DISTINCT symbol FROM bars) s
  CROSS JOIN (VALUES ('30m'), ('1h')) AS t(timeframe) LEFT JOIN (SELECT symbol, timeframe, max(ts) AS z FROM bars GROUP BY 1, 2) l ON l.symbol = s.symbol AND l.timeframe = t.timeframe
  WHERE z IS NULL OR z < TIMESTAMP '2024-02-09 23:30:00' - INTERVAL 10 DAY""", "bars"))
def _(spark, d):
    return S.failed_requirements(wanted(spark, d), T.bars(spark, d), "2024-02-09 23:30:00")


@query("s8_merge_bars", sql("""SELECT symbol, timeframe, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY p DESC) AS k FROM (
    SELECT symbol, timeframe, ts, close + 1 AS close, 1 AS p FROM bars WHERE day(ts) >= 20 UNION ALL SELECT symbol, timeframe, ts, close, 2 FROM bars WHERE day(ts) BETWEEN 8 AND 24
    UNION ALL SELECT symbol, timeframe, ts, close - 1, 3 FROM bars WHERE day(ts) <= 10)) WHERE k = 1""", "bars"))
def _(spark, d):
    b, day = T.bars(spark, d).select("symbol", "timeframe", "ts", "close"), F.dayofmonth("ts")
    return S.merge(b.where(day >= 20).withColumn("close", F.col("close") + 1), b.where(day.between(8, 24)), b.where(day <= 10).withColumn("close", F.col("close") - 1))


@query("s9_missing_ranges", sql("""SELECT symbol, timeframe, kind, from_ts, to_ts FROM (
    SELECT s.symbol, t.timeframe, unnest(['init', 'head', 'tail']) AS kind, unnest([o, z, o]) AS from_ts, unnest([n, n, a]) AS to_ts,
      unnest([z IS NULL, z < n - INTERVAL 2 DAY, a > o + INTERVAL 7 DAY]) AS due
    FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (VALUES ('30m'), ('1h')) AS t(timeframe) CROSS JOIN (SELECT TIMESTAMP '2024-02-02 00:00:00' AS n, TIMESTAMP '2024-02-02 00:00:00' - INTERVAL 730 DAY AS o)
    LEFT JOIN (SELECT symbol, timeframe, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1, 2) l ON l.symbol = s.symbol AND l.timeframe = t.timeframe) WHERE due""", "bars"))
def _(spark, d):
    return S.missing_ranges(wanted(spark, d), T.bars(spark, d), "2024-02-02 00:00:00", 2)


@query("s10_naive_utc", sql("SELECT event_id, ts + INTERVAL 5 HOUR AS ts FROM events"))
def _(spark, d):
    return S.to_naive_utc(T.load(spark, d, "events").select("event_id", "ts"), "ts", "America/New_York")


@query("s12_instrument_closes", sql("SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2", "bars"))
def _(spark, d):
    return S.daily_closes(T.bars(spark, d))


@query("s21_daily_closes", sql("SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM bars5 GROUP BY 1, 2", "bars5"))
def _(spark, d):
    return S.daily_closes(T.bars(spark, d, "5m"))


def runs(spark, d):
    """Every order customer counts as a run; its order statuses stand for the parts that exist."""
    o = T.load(spark, d, "orders")
    part = F.when(F.col("o_orderstatus") == "F", "history").when(F.col("o_orderstatus") == "O", "trades").otherwise("manifest")
    present = o.select(F.col("o_custkey").cast("string").alias("run_id"), part.alias("artifact")).distinct()
    c = T.load(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 7 == 0, "other").when(F.col("c_custkey") % 2 == 0, "single").otherwise("portfolio")
    return c.select(F.col("c_custkey").cast("string").alias("run_id"), kind.alias("run_type")), present


@query("s14_run_completeness", sql("""
  SELECT c.run_id, run_type, CASE WHEN run_type = 'other' THEN [] ELSE list_sort(list_filter(['history', 'trades', 'manifest'], lambda x: NOT list_contains(coalesce(have, []), x))) END AS missing,
    CASE WHEN have IS NULL THEN 'missing' WHEN run_type = 'other' OR len(have) < 3 THEN 'incomplete' ELSE 'valid' END AS state
  FROM (SELECT CAST(c_custkey AS VARCHAR) AS run_id, CASE WHEN c_custkey % 7 = 0 THEN 'other' WHEN c_custkey % 2 = 0 THEN 'single' ELSE 'portfolio' END AS run_type FROM customer) c
  LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS run_id, list(DISTINCT CASE o_orderstatus WHEN 'F' THEN 'history' WHEN 'O' THEN 'trades' ELSE 'manifest' END) AS have FROM orders GROUP BY 1) p ON p.run_id = c.run_id"""))
def _(spark, d):
    return A.completeness(*runs(spark, d))


@query("s15_rerun_eligibility", sql("""
  SELECT run_id, run_type, CASE WHEN run_type = 'portfolio' THEN list_filter([CASE WHEN h = '' THEN 'config_hash' END, CASE WHEN v IS NULL THEN 'data_version' END], lambda x: x IS NOT NULL) ELSE [] END AS missing_fields,
    run_type = 'portfolio' AND h <> '' AND v IS NOT NULL AS is_rerunnable
  FROM (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'single' ELSE 'portfolio' END AS run_type, CASE WHEN c_acctbal < 1000 THEN '' ELSE 'x' END AS h,
    CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS v FROM customer)"""))
def _(spark, d):
    m = T.load(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 2 == 0, "single").otherwise("portfolio").alias("run_type"),
        F.when(F.col("c_acctbal") < 1000, "").otherwise("x").alias("config_hash"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("data_version"))
    return A.rerunnable(m, ["config_hash", "data_version"]).select("run_id", "run_type", "missing_fields", "is_rerunnable")


@query("s16_scenarios_of_baseline", sql("""SELECT o_orderkey AS scenario_id, o_orderdate AS generated_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders WHERE o_custkey = 77"""))
def _(spark, d):
    m = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderdate").alias("generated_at"), F.col("o_custkey").cast("string").alias("baseline_run_id"))
    w = Window.partitionBy("baseline_run_id").orderBy(F.desc("generated_at"), "scenario_id")
    s = A.list_scenarios(A.matching_baseline(m, "77")).withColumn("position", F.row_number().over(w).cast("long"))
    return s.select("scenario_id", "generated_at", "position")


@query("s17_candidate_export", sql("""SELECT symbol, timeframe, strategy, verdict, '["seen ' || lower(verdict) || '"]' AS warnings_json, '{"fast":' || CAST(length(symbol) AS VARCHAR) || '}' AS candidate_params_json
  FROM verdicts WHERE verdict IN ('PASS', 'WARNING')""", "verdicts"))
def _(spark, d):
    v = verdicts(spark, d).withColumns({
        "warnings": F.array(F.concat(F.lit("seen "), F.lower("verdict"))), "params": F.create_map(F.lit("fast"), F.length("symbol"))})
    return A.candidate_rows(v).select("symbol", "timeframe", "strategy", "verdict", "warnings_json", "candidate_params_json")


def scratch(spark):
    """A new folder under the shared folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/barlattice-{uuid.uuid4().hex}"


@query("s3_save_round_trip", sql(f"SELECT {OHLCV} FROM lake", "bars", "bars5", lake=LAKE))
def _(spark, d):
    root = scratch(spark)
    S.save(both(spark, d), root)
    return S.read(spark, root).select(*COLS)


@query("s5_file_sizes", sql("SELECT DISTINCT symbol, timeframe, true AS sized FROM lake", "bars", "bars5", lake=LAKE))
def _(spark, d):
    """Sizes depend on the writer, so the query states that each saved series has one below a MB a thousand bars."""
    root = scratch(spark)
    S.save(both(spark, d), root)
    bars = S.read(spark, root).groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("bars"))
    sizes = S.file_sizes(spark, root).join(bars, ["symbol", "timeframe"])
    return sizes.select("symbol", "timeframe", ((F.col("size_mb") > 0) & (F.col("size_mb") < 0.1 + F.col("bars") / 1000)).alias("sized"))


@query("s5_inventory_sizes")
def _(spark, d):
    """The sizes themselves, next to what the inventory says of each saved series; they depend on the writer, so there is no SQL."""
    root = scratch(spark)
    S.save(both(spark, d), root)
    bars = S.read(spark, root).groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return S.file_sizes(spark, root).join(bars, ["symbol", "timeframe"])


@query("s12_portfolio_artifacts", sql(f"""
  SELECT 'strategy_pnl_daily' AS artifact, CAST(slot_id AS VARCHAR) AS item, CAST(ts AS DATE) AS day, {r("arg_max(cum_pnl, ts)", 4, "value")} FROM slot_hist GROUP BY 2, 3
  UNION ALL SELECT 'instrument_closes', symbol, CAST(ts AS DATE), {r('arg_max(close, ts)', 4)} FROM bars GROUP BY 2, 3""", "slot_hist", "bars"))
def _(spark, d):
    """The portfolio set written and read back."""
    root = scratch(spark)
    day = F.to_date("ts").alias("day")
    slots = T.slot_history(spark, d)
    daily = slots.groupBy("run_id", "slot_id", day).agg(F.max_by("cum_pnl", "ts").alias("pnl"))
    closes = S.daily_closes(T.bars(spark, d)).withColumn("run_id", F.lit("0"))
    A.write_run(root, {"history": T.history(spark, d), "strategy_pnl_daily": daily, "instrument_closes": closes, "exposure": T.exposure(spark, d)})
    got = A.load_run(spark, root, "0")
    rows = [(got["strategy_pnl_daily"], "strategy_pnl_daily", "slot_id", "pnl"), (got["instrument_closes"], "instrument_closes", "symbol", "close")]
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("artifact"), F.col(k).cast("string").alias("item"), "day", rd(v, 4).alias("value"))
                                          for df, n, k, v in rows])


CURVE = f"""SELECT ts, {r('total_value', 4, 'total_value')} FROM hist"""


@query("s11_run_artifacts", sql("""SELECT (SELECT count(*) FROM hist) AS history, (SELECT count(*) FROM itrades) AS trades, 0::BIGINT AS benchmark,
    (SELECT count(*) FROM (SELECT DISTINCT slot_id, symbol, ts FROM expo)) AS exposure, 1::BIGINT AS metrics""", "hist", "itrades", "expo"))
def _(spark, d):
    root = scratch(spark)
    history = T.history(spark, d)
    kpis = M.trade_stats(T.intraday_trades(spark, d), ["run_id"])
    A.write_run(root, {"history": history, "trades": T.intraday_trades(spark, d).select("run_id", "slot_id", "strategy", "symbol", "direction", "entry_time", "exit_time",
                "entry_price", "exit_price", "quantity", "pnl", "commission", "slippage", "exit_reason"), "exposure": T.exposure(spark, d)}, kpis)
    got = A.load_run(spark, root, "0")
    parts = [got[n].agg(F.count("*").alias("n")).withColumn("part", F.lit(n)) for n in ("history", "trades", "benchmark", "exposure", "metrics")]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy().pivot("part", ["history", "trades", "benchmark", "exposure", "metrics"]).agg(F.sum("n"))


@query("s13_load_run", sql(CURVE, "hist"))
def _(spark, d):
    root = scratch(spark)
    A.write_run(root, {"history": T.history(spark, d)})
    return A.load_run(spark, root, "0")["history"].select("ts", rd("total_value", 4).alias("total_value"))


@query("s18_data_version", sql("""SELECT 2::BIGINT * count(DISTINCT symbol) AS series, 16 AS digest_chars, true AS same, true AS differs FROM bars""", "bars"))
def _(spark, d):
    """The digest depends on file times, so the query states what must hold of it for a saved lake."""
    root = scratch(spark)
    S.save(both(spark, d), root)
    marks = S.file_marks(spark, root)
    changed = marks.withColumn("modified", F.when(F.col("symbol") == "view", F.concat("modified", F.lit("1"))).otherwise(F.col("modified")))
    digests = reduce(DataFrame.unionByName, [S.data_version(x).withColumn("of", F.lit(n)) for x, n in (
        (marks, "one"), (S.file_marks(spark, root), "two"), (changed, "other"))])
    one, two, other = (F.max(F.when(F.col("of") == n, F.col("data_version"))) for n in ("one", "two", "other"))
    series = marks.agg(F.count(F.lit(1)).alias("series"))
    return (digests.unionByName(series, allowMissingColumns=True)
            .agg(F.max("series").alias("series"), F.length(one).alias("digest_chars"), (one == two).alias("same"), (one != other).alias("differs")))


@query("s18_digest")
def _(spark, d):
    """The digest of a saved lake with what it is made from; it depends on file times, so there is no SQL."""
    root = scratch(spark)
    S.save(both(spark, d), root)
    marks = S.file_marks(spark, root)
    return marks.withColumn("data_version", S.data_version(marks).scalar())


@query("s19_json_safe", sql(f"""SELECT strategy, CASE WHEN w > 0 AND l = 0 THEN NULL ELSE {r('w / nullif(l, 0)', 6)} END AS profit_factor, n AS total_trades, strftime(first_day, '%Y-%m-%d') AS first_day
  FROM (SELECT l_suppkey AS strategy, count(*) AS n, coalesce(sum(x) FILTER (x > 0), 0) AS w, abs(coalesce(sum(x) FILTER (x <= 0), 0)) AS l, CAST(min(l_shipdate) AS DATE) AS first_day
    FROM (SELECT *, l_extendedprice * (0.0999::DOUBLE - l_discount) AS x FROM lineitem) GROUP BY 1)"""))
def _(spark, d):
    li = T.load(spark, d, "lineitem").withColumn("pnl", F.col("l_extendedprice") * (0.0999 - F.col("l_discount"))).withColumnRenamed("l_suppkey", "strategy")
    days = li.groupBy("strategy").agg(F.to_date(F.min("l_shipdate")).alias("first_day"))
    k = S.json_safe(M.trade_stats(li, ["strategy"]).join(days, "strategy"))
    return k.select("strategy", rd("profit_factor", 6).alias("profit_factor"), "total_trades", "first_day")
