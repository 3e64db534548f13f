"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Settings that results (time zone) or skew handling (AQE) depend on.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key must be split even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "amperic") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def use_scratch(spark: SparkSession) -> None:
    """Make sure checkpoints have a folder every executor can read.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session,
    where one machine runs everything, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="amperic-")
    context.setCheckpointDir(folder)


_FOLDERS: dict[str, str] = {}


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; its folder goes with the cluster's scratch space
        pass


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared scratch space, deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            use_scratch(spark)
            base = spark.sparkContext.getCheckpointDir()
        _FOLDERS[app] = f"{base}/amperic-{app}"
        atexit.register(_forget, spark, _FOLDERS[app])
    return _FOLDERS[app]


def stage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write an intermediate result once as Parquet and read it back: later steps
    neither recompute it nor lose it with an executor, read only the columns they
    need, and know its true size."""
    path = f"{run_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
