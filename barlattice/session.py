"""Session settings shared by tests, the bench and user code."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that may be changed on a running session. Shuffle width is left to the cluster
# (AQE coalesces small shuffles); only correctness-relevant and adaptive settings are set.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
# Set when a session is built: checkpoint files go when nothing refers to them any more.
BUILD_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator relies on (naive timestamps are read as UTC)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _ship(spark)
    return spark


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The few pandas functions are pickled by reference, so workers must be able to import them
    wherever the driver program was started.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="barlattice-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def get_session(app: str = "barlattice", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; ``master`` is only needed outside spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Call-site capture costs several gateway calls per column expression; off unless asked for.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in {**BUILD_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
