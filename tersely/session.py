"""Sessions: settings for analytics over text, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: UTC timestamps and adaptive plans; the number of shuffle partitions is only a start, adaptive execution coalesces.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "tersely", **settings: str) -> SparkSession:
    """A session with SETTINGS; more as **{"spark.x": "y"}."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to the executors, once a SparkContext, so that its UDFs load where it isn't installed."""
    context = spark.sparkContext
    if not getattr(context, "_tersely_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tersely-")) / "tersely.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*")):
                if path.suffix in (".py", ".yaml"):
                    archive.write(path, Path(root.name) / path.relative_to(root))
        context.addPyFile(str(target))
        context._tersely_shipped = True
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut, in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
    return shared
