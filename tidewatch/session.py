"""The Spark session the library expects: UTC, adaptive execution, and a shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "tidewatch") -> SparkSession:
    """A session on this machine, for tests and the bench. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where Spark runs on one machine."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not (context.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = context.getCheckpointDir()
    if not made:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tidewatch-"))
        made = context.getCheckpointDir()
    return made.rstrip("/")


class _Live(threading.local):
    """Folders of this thread that were made here and not released yet, in the order they were made."""

    def __init__(self):
        self.paths: dict[str, None] = {}


_LIVE = _Live()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; it stays until release_since() is called for it."""
    path = f"{shared_dir(spark)}/tidewatch-{label}-{uuid.uuid4().hex}"
    _LIVE.paths[path] = None
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors.

    The folder stays until release() or release_since() is called for it.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    _LIVE.paths.pop(path, None)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*frames: DataFrame) -> None:
    """Delete the folders of frames that written() made; nothing that reads them may run any more."""
    for df in frames:
        _delete(df.sparkSession, df.written_to)


def live_folders() -> frozenset[str]:
    return frozenset(_LIVE.paths)


def release_since(spark: SparkSession, before: frozenset[str], keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what written() has made since live_folders() gave `before`, but for the frames to keep."""
    kept = {df.written_to for df in keep}
    for path in [p for p in _LIVE.paths if p not in before and p not in kept]:
        _delete(spark, path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
