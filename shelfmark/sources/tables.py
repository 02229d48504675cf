"""Readers of the catalogue tables, with declared schemas for empty starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

#: DDL of the tables that pipelines create when nothing is stored yet.
SCHEMAS = {
    "seda_dataset": "id string, dataset_name string, dataset_desc string, dataset_url string, source string, tags array<string>, "
    "canonical_id string, application_visibility int, harvested_at timestamp_ntz, ingested_at timestamp_ntz",
    "seda_source": "id string, site_name string, n bigint, alive_rate double, alive_var double, last_n bigint, delta_n bigint, status string, "
    "last_detect_date timestamp_ntz, fail_streak int, is_hidden int, last_hidden_date timestamp_ntz, create_time timestamp_ntz, update_time timestamp_ntz",
    "link_detect": "id string, ext_host_name string, link_num int, link_rate double, status string, detect_date timestamp_ntz, create_time timestamp_ntz, update_time timestamp_ntz",
    "source_status": "ext_host_name string, application_visibility int",
    "tag_vocabulary": "tag_id int, tag_name string, tag_count int, created_at timestamp_ntz",
    "tag_cooccurrence": "tag_id_1 int, tag_id_2 int, weight float",
    "seda_dataset_vectors": "id string, embedding array<float>",
    "tag_vectors": "tag string, embedding array<float>",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table with the declared schema (the DDL of a first run)."""
    return spark.createDataFrame([], SCHEMAS[name])


def init_tables(spark: SparkSession, folder: str) -> list[str]:
    """Create the tables a store lacks, empty, as their DDL says; what is there stays. The names of all."""
    from shelfmark.session import hadoop_path

    for name in SCHEMAS:
        fs, at = hadoop_path(spark, f"{folder}/{name}.parquet")
        if not fs.exists(at):
            empty(spark, name).write.parquet(f"{folder}/{name}.parquet")
    return sorted(SCHEMAS)


def current(records: DataFrame, *columns: str) -> DataFrame:
    """The current row of every id: the latest ``harvested_at``; identical repeats count once.

    Rows without an id are dropped; a null ``harvested_at`` is older than any date. Rows of one id and moment are told
    apart by ``ingested_at`` (later wins) where the table has it, then by the values themselves, so the choice is the
    same on every run. Only ``columns`` (and what the choice needs) are read and shuffled, once, by id.
    """
    columns = columns or tuple(records.columns)
    extra = [c for c in ("ingested_at",) if c in records.columns]
    need = list(dict.fromkeys(["id", "harvested_at", *extra, *columns]))
    rest = [c for c in need if c not in ("id", "harvested_at", *extra)]
    order = [F.col("harvested_at").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in extra), *(F.col(c).asc_nulls_last() for c in rest)]
    return (
        records.select(*need)
        .where(F.col("id").isNotNull())
        .withColumn("_rn", F.row_number().over(W.partitionBy("id").orderBy(*order)))
        .where("_rn = 1")
        .select(*columns)
    )


def with_id(records: DataFrame, fallback: str = "_id", id_field: str = "id") -> DataFrame:
    """The id rule of harvested documents: the field's text unless empty or zero, else the store's own key."""
    own = F.col(id_field).cast("string")
    usable = F.when((own != "") & (own != "0"), own)
    return records.withColumn(id_field, F.coalesce(usable, F.col(fallback).cast("string")) if fallback in records.columns else usable)
