"""Session helpers: shared checkpoint folder, lineage cuts, stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def builder(app: str = "shelfmark", master: str | None = None):
    """A session builder with the settings every plan here assumes."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    return b.master(master) if master else b


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs in one process (local tests) a
    temporary one is made. A cluster that names none is refused: executors don't share a machine's own folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfmark-")
        hadoop_path(spark, folder, delete=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of the rows observed by the job that writes the checkpoint: no further pass counts them.

    A repeated task may count its rows twice, so only ask whether there were any.
    """
    seen = Observation()
    done = cut(df.observe(seen, *(c.alias(n) for n, c in counts.items())))
    return done, seen.get


def collect_small(df: DataFrame, most: int) -> list:
    """The rows of a table of a checked size: more than ``most`` is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: raise the limit if each worker can hold them")
    return rows


def hadoop_path(spark: SparkSession, path: str, delete: bool = False):
    """(file system, path) of a folder; with ``delete`` it goes when the driver's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if delete:
        fs.deleteOnExit(at)
    return fs, at


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    fs, at = hadoop_path(spark, path)
    fs.mkdirs(at)  # what isn't there yet can't be marked for deletion
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder, compressed, and read again: what follows neither computes nor shuffles it anew.

    Columnar and compressed, so a reader of some columns or rows reads only those; the table goes when the driver ends.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of the rows observed by the job that writes them, as ``cut_counting`` does."""
    seen = Observation()
    done = stored(df.observe(seen, *(c.alias(n) for n, c in counts.items())))
    return done, seen.get
