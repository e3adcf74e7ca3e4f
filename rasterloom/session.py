"""Session for local runs, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "rasterloom", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a local one in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="rasterloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_made: dict[str, list[str]] = defaultdict(list)  # folders by application


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has written to yet; :func:`release` removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[spark.sparkContext.applicationId].append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the tables that :func:`stored` and :func:`new_folder` made in this application.

    DataFrames that read them can no longer be computed. Checkpoints are removed by Spark itself when they are no
    longer referenced, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as it is in local sessions.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    Meant for per-image tables (at most a few hundred values per image), never for pixels.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table of any size to the shared folder and read it from there."""
    folder = new_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
