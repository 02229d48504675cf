"""Record linkage: exact matches, grouping, canonical record, merged attributes, id mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.hashing import simhash
from shelfmark.functions.text import normalize_name, record_text
from shelfmark.functions.urls import canonicalize_url
from shelfmark.functions.vector import vectors_of
from shelfmark.operators.blocking import exact_links, fingerprinted, lsh_signatures, similar_links
from shelfmark.operators.components import components
from shelfmark.params import DEDUP, Dedup
from shelfmark.session import stored


def normalized(records: DataFrame) -> DataFrame:
    """(id, name, url, text): comparable name and address, and the text of all fields with those two in comparable form."""
    x = records.select("id", normalize_name(F.col("dataset_name")).alias("name"), canonicalize_url(F.col("dataset_url")).alias("url"), "dataset_desc", "source")
    return x.select("id", "name", "url", record_text(F.col("name"), F.col("dataset_desc"), F.col("url"), F.col("source")).alias("text"))


def explicit_links(norm: DataFrame) -> DataFrame:
    """(kind, src, dst): each record with the smallest id of its name, and of its address; empty keys link nothing.

    A star per key has the closure of all its pairs in a linear number of rows.
    """
    keyed = norm.select("id", F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("key")), F.struct(F.lit("url").alias("kind"), F.col("url").alias("key")))).alias("k")).select("id", "k.kind", "k.key").where("key != ''")
    first = keyed.groupBy("kind", "key").agg(F.min("id").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "key", "src")
    return keyed.join(first, ["kind", "key"]).where("id != src").select("kind", "src", F.col("id").alias("dst"))


def completeness(p: Dedup = DEDUP):
    """Ten points per non-empty field plus the letters of all."""
    out = F.lit(0)
    for f in p.fields:
        n = F.char_length(F.coalesce(F.col(f), F.lit("")))
        out = out + F.when(n > 0, 10).otherwise(0) + n
    return out


def canonical_of(records: DataFrame, groups: DataFrame, p: Dedup = DEDUP) -> DataFrame:
    """(component, canonical_id, score): the most complete member; ties go to the smallest id."""
    x = records.join(groups, "id").select("component", "id", completeness(p).alias("score"))
    best = F.min(F.struct(-F.col("score"), F.col("id"))).alias("b")
    return x.groupBy("component").agg(best).select("component", F.col("b.id").alias("canonical_id"), (-F.col("b.col1")).alias("score"))


def mapping(records: DataFrame, links: DataFrame, p: Dedup = DEDUP) -> DataFrame:
    """(id, canonical_id) of every record; records without links stand for themselves."""
    groups = components(links)
    best = canonical_of(records, groups, p).select("component", "canonical_id")
    return records.select("id").join(groups.join(best, "component").select("id", "canonical_id"), "id", "left").select("id", F.coalesce("canonical_id", "id").alias("canonical_id"))


def merged(records: DataFrame, mapped: DataFrame, p: Dedup = DEDUP) -> DataFrame:
    """The canonical records, each field the canonical one's own unless empty, else that of the smallest id that has it."""
    x = records.join(mapped, "id")
    own = F.when(F.col("id") == F.col("canonical_id"), 0).otherwise(1)
    pick = lambda f: F.min(F.when(F.col(f) != "", F.struct(own.alias("o"), F.col("id").alias("i"), F.col(f).alias("v")))).alias(f)
    return x.groupBy("canonical_id").agg(*(pick(f) for f in p.fields), F.count(F.lit(1)).alias("members")).select(F.col("canonical_id").alias("id"), *(F.col(f"{f}.v").alias(f) for f in p.fields), "members")


def chained(mapped: DataFrame, further: DataFrame) -> DataFrame:
    """One more hop: where a canonical id was itself mapped on, the later one holds."""
    hop = further.select(F.col("id").alias("_k"), F.col("canonical_id").alias("_v"))
    return mapped.join(hop, mapped["canonical_id"] == F.col("_k"), "left").select("id", F.coalesce("_v", "canonical_id").alias("canonical_id"))


def marked(norm: DataFrame, vectors: DataFrame, p: Dedup = DEDUP) -> DataFrame:
    """(id, v, simhash, signature) of the records with a vector: what decides whether two are bucket mates, and alike."""
    texts = norm.select("id", "text")
    return vectors.join(simhash(texts, "id", "text"), "id").join(lsh_signatures(texts, p), "id")


def semantic_links(norm: DataFrame, vectors: DataFrame, p: Dedup = DEDUP) -> DataFrame:
    """(src, dst): records that share a SimHash band or projection signature and whose vectors agree, as stars."""
    return similar_links(marked(norm, vectors, p), p)


def bucket_links(norm: DataFrame, vectors: DataFrame, p: Dedup = DEDUP) -> DataFrame:
    """``semantic_links``, exact: all bucket mates whose vectors agree."""
    return exact_links(fingerprinted(norm.select("id", "text"), vectors, p), p)


def deduplicate(records: DataFrame, vectors: DataFrame, dimensions: int = 64, p: Dedup = DEDUP) -> DataFrame:
    """(id, canonical_id): exact and semantic links, grouped in one global pass."""
    records = stored(records.select("id", *p.fields))  # read for the links and for the choice of the canonical record
    norm = stored(normalized(records))
    links = explicit_links(norm).select("src", "dst").union(semantic_links(norm, vectors_of(records, vectors, dimensions), p))
    return mapping(records, links, p)


def write_back(records: DataFrame, mapped: DataFrame) -> DataFrame:
    """The records with their new canonical_id; ids known only to the mapping are added (an upsert)."""
    new = mapped.select("id", F.col("canonical_id").alias("_new"))
    keep = [c for c in records.columns if c not in ("id", "canonical_id")]
    old = F.col("canonical_id") if "canonical_id" in records.columns else F.lit(None).cast("string")
    return records.join(new, "id", "full_outer").select("id", *keep, F.coalesce("_new", old).alias("canonical_id"))
