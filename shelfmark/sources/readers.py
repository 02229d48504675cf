"""Sources: catalogue dumps in the formats Spark reads, whole or by condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.tables import SCHEMAS, with_id


def catalogue(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Records of a dump (parquet, json, csv, orc); documents without an id take their store key ``_id``.

    Without ``schema``, text formats are read by the declared one plus ``_id``, so that no pass infers it.
    """
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        reader = reader.schema(schema or SCHEMAS["seda_dataset"] + ", _id string")
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True)
    x = reader.load(path)
    return with_id(x) if "id" in x.columns else x


def seed(records: DataFrame, size: int) -> DataFrame:
    """The first records by id: the sample a vocabulary starts from."""
    return records.orderBy("id").limit(size)


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a table for a list of ids (id), each id's rows once."""
    return table.join(ids.select("id").where(F.col("id").isNotNull()).distinct(), "id", "left_semi")
