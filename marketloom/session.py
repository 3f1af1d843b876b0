"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. AQE picks join strategies from measured sizes, splits skewed
# shuffle partitions and merges small ones, so no plan in this package carries a broadcast
# hint on data that can grow.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    # One call to the JVM per column expression instead of four; only error texts get shorter.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shuffle_partitions(shuffled_bytes: int) -> int:
    """Partitions of about 200 MB for the largest expected shuffle; AQE merges the small ones."""
    return max(200, math.ceil(shuffled_bytes / (200 << 20)))


def build_session(
    app: str = "marketloom", master: str | None = None, shuffled_bytes: int | None = None, **extra: str
) -> SparkSession:
    """Create (or reuse) a session with the settings above; keyword names use ``__`` for dots.

    ``shuffled_bytes`` sizes the shuffles: the default of 200 partitions is far too few for
    terabytes (10 TB shuffled are 50 GB per partition).
    """
    builder = SparkSession.builder.appName(app)
    if shuffled_bytes:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions(shuffled_bytes))
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that was made elsewhere."""
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.adaptive.forceOptimizeSkewedJoin",
    ):
        spark.conf.set(key, SETTINGS[key])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without the setting a local master gets a new temporary folder; elsewhere it is an error, because a
    machine-local folder would not survive the loss of its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="marketloom-"))
    return spark.conf.get("spark.checkpoint.dir")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several consumers need the same expensive result: the table survives lost
    executors, cuts the lineage, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
