"""The three pipelines as they run: stores in, stores out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import plugins
from shelfmark.functions.vector import vectors_of
from shelfmark.operators import dedup, monitor, tags
from shelfmark.params import DEDUP, MONITOR, TAGGING, Dedup, Monitor, Tagging
from shelfmark.session import stored
from shelfmark.sources import sinks
from shelfmark.sources.tables import current, init_tables

INITIAL, INCREMENTAL = "init", "increment"


@dataclass(frozen=True)
class Stores:
    """The tables of one installation: a folder of parquet tables that all executors reach."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return sinks.read_or_empty(self.spark, self.path(name), name)

    def append(self, name: str, rows: DataFrame) -> None:
        """More rows, in the columns the store has."""
        have = self.read(name).schema
        sinks.append(rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have.fields)), self.path(name))

    def replace(self, name: str, rows: DataFrame, keep_if_empty: bool = False) -> bool:
        return sinks.replace(rows, self.path(name), keep_if_empty)


def monitor_run(stores: Stores, now: Column, prober: Callable[[DataFrame], DataFrame] = plugins.recorded_probe, p: Monitor = MONITOR, registry: tuple[monitor.Policy, ...] | None = None) -> DataFrame:
    """One monitoring round with its writes; its result (as by ``monitor.monitoring_round``).

    The round is told once and stored; then history grows by it and loses what is too old, the snapshot takes it in, and
    the records of newly hidden sites are made invisible. A site without an answer fails alone.
    """
    init_tables(stores.spark, stores.folder)
    history = stores.read("link_detect")
    plan = stored(monitor.allocate(monitor.site_state(stores.read("source_status"), stores.read("seda_source"), history, p), p))
    records = current(stores.read("seda_dataset"), "id", "source", "dataset_url", "dataset_name")
    probed = prober(monitor.sample(records, plan, p=p)).withColumn("alive", monitor.alive(F.col("url"), p, registry))
    result = stored(monitor.monitoring_round(plan, probed, history, now, p))
    stores.append("link_detect", monitor.history_rows(result, now))
    stores.replace("link_detect", monitor.purge(stores.read("link_detect"), p))
    stores.replace("seda_source", monitor.upsert_snapshot(stores.read("seda_source"), result, now))
    gone = result.where("newly_hidden").select("site")
    if not gone.isEmpty():
        stores.replace("seda_dataset", monitor.hide(stores.read("seda_dataset"), gone))
    return result


def dedup_run(stores: Stores, dimensions: int = 64, p: Dedup = DEDUP) -> DataFrame:
    """Link all records and write their canonical ids back; the mapping (id, canonical_id)."""
    init_tables(stores.spark, stores.folder)
    all_rows = stores.read("seda_dataset")
    mapped = stored(dedup.deduplicate(current(all_rows, "id", *p.fields), stores.read("seda_dataset_vectors"), dimensions, p))
    written = dedup.write_back(all_rows, mapped).select(*all_rows.columns)
    stores.replace("seda_dataset", written)
    return mapped


def tag_run(stores: Stores, mode: str, now: Column, encoder: plugins.Encoder = plugins.hashing_encoder, chooser: plugins.Chooser = plugins.first_candidates, dimensions: int = 64, p: Tagging = TAGGING) -> DataFrame:
    """Tag records with the writes that belong to it; (id, tags, new_tags) of those that were tagged.

    'init' builds vocabulary, counts, tag vectors and edges from the catalogue and tags all records; 'increment' takes
    what is stored, makes the vectors that are missing, and tags the records without tags; without a vocabulary it refuses.
    Tags the chooser proposed are added to the vocabulary with count 0 after the run.
    """
    if mode not in (INITIAL, INCREMENTAL):
        raise ValueError(f"mode is {INITIAL!r} or {INCREMENTAL!r}, not {mode!r}")
    init_tables(stores.spark, stores.folder)
    all_rows = stores.read("seda_dataset")
    records = stored(current(all_rows, "id", "dataset_name", "dataset_desc", "tags"))
    lower = lambda t: t.where("tag_name is not null and tag_name != ''").select(F.lower("tag_name").alias("tag")).distinct()
    if mode == INITIAL:
        vocabulary, vectors_of_tags, edges = tags.initial_graph(records, tags.seed_vocabulary(records, p), encoder, p)
        vectors_of_tags, edges = stored(vectors_of_tags), stored(edges)
        stores.replace("tag_vocabulary", tags.upsert_vocabulary(stores.read("tag_vocabulary"), tags.document_frequency(records, vocabulary), now))
        stores.replace("tag_cooccurrence", tags.edges_by_id(edges, stores.read("tag_vocabulary")), keep_if_empty=True)
        stores.replace("tag_vectors", vectors_of_tags)
        need = records
    else:
        vocabulary = lower(stores.read("tag_vocabulary"))
        if vocabulary.isEmpty():
            raise ValueError("no vocabulary is stored: run the initial mode first")
        have = stores.read("tag_vectors")
        made = stored(plugins.encoded(vocabulary.join(have.select("tag"), "tag", "left_anti"), "tag", "tag", encoder))
        stores.append("tag_vectors", made)
        vectors_of_tags = stores.read("tag_vectors")
        ids = stores.read("tag_vocabulary").where("tag_id is not null").select("tag_id", F.lower("tag_name").alias("t"))
        edges = stores.read("tag_cooccurrence").join(ids.select(F.col("tag_id").alias("tag_id_1"), F.col("t").alias("tag_1")), "tag_id_1").join(ids.select(F.col("tag_id").alias("tag_id_2"), F.col("t").alias("tag_2")), "tag_id_2")
        need = records.join(tags.untagged(records), "id", "left_semi")
        stores.append("seda_dataset_vectors", stored(tags.missing_vectors(need, vectors_of(need, stores.read("seda_dataset_vectors"), dimensions), encoder)))
    vectors = vectors_of(need, stores.read("seda_dataset_vectors"), dimensions)
    result = stored(tags.tag_records(need, vectors, vocabulary, vectors_of_tags, edges, chooser, p).select("id", "tags", "new_tags"))
    found = tags.new_tags(result.select(F.explode("new_tags").alias("tag")), stores.read("tag_vocabulary").withColumn("tag_name", F.lower("tag_name")))
    stores.replace("tag_vocabulary", tags.upsert_vocabulary(stores.read("tag_vocabulary"), found.withColumn("n", F.lit(0)), now))
    stores.replace("seda_dataset", tags.write_tags(all_rows, result))
    return result
