"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow. Counts of partitions are left to the cluster unless given."""
    builder = (
        SparkSession.builder.appName("siftwell")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go when nothing refers to them
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="siftwell-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


ROWS_A_FILE = 200_000


def cut_lineage(df: DataFrame, at_most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Where it is known to have ``at_most`` so many narrow rows, they go into as few files as hold them.
    """
    shared_folder(df.sparkSession)
    if at_most is not None:
        df = df.coalesce(max(1, -(-at_most // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """A folder of the shared file system goes; one that isn't there is no error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder of tables; names of files follow ``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
