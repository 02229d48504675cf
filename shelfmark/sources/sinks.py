"""Writers: stores that keep what the pipelines produce, as parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark.session import hadoop_path
from shelfmark.sources.tables import SCHEMAS


def read_or_empty(spark: SparkSession, path: str, name: str | None = None, schema: str | None = None) -> DataFrame:
    """A stored table, or an empty one of the declared schema where nothing is stored yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema or SCHEMAS[name])


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a stored table (history, vectors, new tags)."""
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str, keep_if_empty: bool = False) -> bool:
    """Put rows in the place of a stored table, also if they derive from it; True if written.

    The new rows are written beside the old ones first. With ``keep_if_empty`` an empty result leaves the store as it is.
    """
    if keep_if_empty and rows.isEmpty():
        return False
    spark = rows.sparkSession
    mark = uuid.uuid4().hex[:8]
    beside, aside = (f"{path.rstrip('/')}-{kind}-{mark}" for kind in ("new", "old"))
    rows.write.parquet(beside)
    fs, target = hadoop_path(spark, path)
    fresh, old = hadoop_path(spark, beside)[1], hadoop_path(spark, aside)[1]
    had = fs.exists(target)
    # the old table is moved, not deleted, until the new one stands: a crash between leaves both
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{beside} can't be moved to {path}")
    if had:
        fs.delete(old, True)
    return True
