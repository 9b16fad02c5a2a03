"""Run artifacts: tables partitioned by run, metrics as JSON, manifests, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice import schemas as S
from barlattice.sources.lake import json_safe, to_json

# Artifacts a run must have, and manifest fields a rerun needs.
REQUIRED = {
    "single": ["history", "trades", "manifest"],
    "portfolio": ["history", "trades", "manifest"],
}
RERUN_FIELDS = ["source_config_path", "config_hash", "data_version"]

SCHEMAS = {
    "history": S.HISTORY, "slot_history": S.SLOT_HISTORY, "trades": S.TRADES,
    "benchmark": S.BENCHMARK, "exposure": S.EXPOSURE, "strategy_pnl_daily": S.DAILY_SLOT_PNL,
    "instrument_closes": S.INSTRUMENT_CLOSES, "metrics": S.METRICS,
}


def write_run(root: str, tables: Mapping[str, DataFrame], metrics: DataFrame | None = None) -> list[str]:
    """Write each table under ``root`` by run; trades also when empty, other empty tables not.

    ``metrics`` has one row per run and is stored as JSON with non-finite numbers as null.
    """
    done = []
    items = dict(tables)
    if metrics is not None:
        items["metrics"] = to_json(metrics, ["run_id"], "metrics_json")
    for name, df in items.items():
        if name != "trades" and df.isEmpty():
            continue
        df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        df.write.mode("overwrite").partitionBy("run_id").parquet(f"{root}/{name}")
        done.append(name)
    return done


def load_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """All artifacts of one run; an absent optional table is empty with its schema."""
    out = {}
    for name, ddl in SCHEMAS.items():
        try:
            df = spark.read.schema(ddl).parquet(f"{root}/{name}").where(F.col("run_id") == run_id)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND" or name in ("history",):
                raise
            df = spark.createDataFrame([], ddl)
        out[name] = df
    return out


def completeness(
    runs: DataFrame, present: DataFrame, required: Mapping[str, Sequence[str]] = REQUIRED
) -> DataFrame:
    """State and missing parts per run.

    ``runs`` are (run_id, run_type), ``present`` (run_id, artifact). A run without any part is
    missing, one without all required parts, or of an unknown type, incomplete.
    """
    names = F.create_map(*[x for k, v in required.items() for x in (
        F.lit(k), F.array(*[F.lit(a) for a in v]))])
    need = runs.withColumn("artifact", F.explode_outer(F.try_element_at(names, F.col("run_type"))))
    absent = need.where(F.col("artifact").isNotNull()).join(present, ["run_id", "artifact"], "left_anti")
    lost = absent.groupBy("run_id").agg(F.sort_array(F.collect_list("artifact")).alias("missing"))
    some = present.select("run_id").distinct().withColumn("_some", F.lit(True))
    none = F.array().cast("array<string>")
    return (
        runs.join(lost, "run_id", "left").join(some, "run_id", "left")
        .withColumn("missing", F.coalesce("missing", none))
        .withColumn("state", F.when(F.col("_some").isNull(), "missing").when(
            ~F.col("run_type").isin(list(required)) | (F.size("missing") > 0), "incomplete").otherwise("valid"))
        .drop("_some")
    )


def rerunnable(manifests: DataFrame, fields: Sequence[str] = RERUN_FIELDS) -> DataFrame:
    """Portfolio runs whose required manifest fields are all filled; the empty ones are listed."""
    types = dict(manifests.dtypes)

    def empty(name: str):
        if name not in types:
            return F.lit(True)
        c = F.col(name)
        if types[name].startswith(("array", "map")):
            return c.isNull() | (F.size(c) == 0)
        if types[name] == "string":
            return c.isNull() | (c == "")
        return c.isNull()

    gone = F.array_compact(F.array(*[F.when(empty(f), F.lit(f)) for f in fields]))
    is_portfolio = F.col("run_type") == "portfolio"
    return manifests.withColumn("missing_fields", F.when(is_portfolio, gone).otherwise(
        F.array().cast("array<string>"))).withColumn(
        "is_rerunnable", is_portfolio & (F.size("missing_fields") == 0))


def list_scenarios(manifests: DataFrame) -> DataFrame:
    """Newest first."""
    return manifests.orderBy(F.desc_nulls_last("generated_at"), "scenario_id")


def read_manifests(spark: SparkSession, paths: str | list[str], ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(paths)


def matching_baseline(scenarios: DataFrame, baseline_run_id: str) -> DataFrame:
    return scenarios.where(F.coalesce("baseline_run_id", F.lit("")) == baseline_run_id)


def candidate_rows(reports: DataFrame) -> DataFrame:
    """PASS and WARNING searches with warnings and parameters as JSON text."""
    picked = json_safe(reports.where(F.col("verdict").isin("PASS", "WARNING")))
    out = picked.withColumn("warnings_json", F.to_json("warnings")).drop("warnings")
    if "params" in out.columns:
        out = out.withColumn("candidate_params_json", F.to_json("params")).drop("params")
    return out


def export_candidates(reports: DataFrame, path: str) -> bool:
    """CSV of the candidates; nothing is written when there are none."""
    rows = candidate_rows(reports)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True
