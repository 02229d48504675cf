"""Consolidating pairwise matches into groups: deterministic Borůvka hooking.

Every round, each component picks its smallest outgoing edge, the picks form trees, pointer doubling collapses each
tree to its root, and the edges are relabelled and deduplicated, until none is left. A component at least doubles per
round, so the rounds grow with the logarithm of the largest group, and every step is a hash aggregation or an equi-join:
no group is ever gathered in one task, and hot nodes are pre-aggregated by the partial ``min`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import strip
from shelfmark.session import stored, stored_counting

LINKING_STAGES = ("name", "url", "mapping")
THRESHOLD = 0.82


def linked_pairs(pairs: DataFrame, ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): the pairs that link two known ids, each once, a < b.

    A pair counts if its stage is one of ``LINKING_STAGES`` or its similarity reaches ``threshold``; null similarity of
    another stage doesn't. Ids are meant whatever their case and outer blanks and come out as ``ids`` spells them (the
    smallest spelling if there are several). Self pairs, null and unknown ids link nothing.
    """
    key = lambda c: F.lower(strip(F.col(c)))
    known = ids.where(F.col("id").isNotNull()).groupBy(key("id").alias("k")).agg(F.min("id").alias("id"))
    stage = F.lower(strip(F.coalesce(F.col("stage"), F.lit(""))))
    links = F.coalesce(stage.isin(*LINKING_STAGES) | (~F.isnan("similarity") & (F.col("similarity") >= threshold)), F.lit(False))
    x = pairs.where(links).select(key("id_1").alias("k1"), key("id_2").alias("k2")).where("k1 != k2").select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct()
    x = x.join(known.select(F.col("k").alias("k1"), F.col("id").alias("i1")), "k1").join(known.select(F.col("k").alias("k2"), F.col("id").alias("i2")), "k2")
    return x.select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"))


def _hook(edges: DataFrame) -> DataFrame:
    """(v, p): the far end of each component's smallest outgoing edge; of two that pick the same edge the smaller is the root.

    Edges are ordered by (smaller end, larger end): a total order, so the picks can't close a cycle of three or more.
    """
    both = edges.select(F.col("a").alias("v"), "a", "b").union(edges.select(F.col("b").alias("v"), "a", "b"))
    pick = both.groupBy("v").agg(F.min(F.struct("a", "b")).alias("e"))
    # the end a of an edge (a, b) is a root exactly if b picked the same edge; v = a picks its smallest, which starts with a smaller end wherever one exists
    pick = pick.select("v", F.when(F.col("v") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a")).alias("p"))
    back = pick.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    return pick.join(_sorted(back), "p", "left").select("v", F.when((F.col("pp") == F.col("v")) & (F.col("v") < F.col("p")), F.col("v")).otherwise(F.col("p")).alias("p"))


def _sorted(df: DataFrame) -> DataFrame:
    """To be joined by a sorted merge: the sides grow with the collection, and many small broadcasts one after the other fill the driver."""
    return df.hint("merge")


def _collapse(parents: DataFrame) -> DataFrame:
    """Pointer jumping until every node points to its root: four pointers per step, one job each.

    The job that writes a step tells whether its last hop still moved anything; if not, all pointers have reached their roots.
    """
    while True:
        hop = lambda a, b: _sorted(parents.select(F.col("v").alias(a), F.col("p").alias(b)))  # noqa: B023, E731
        far = parents.join(hop("p", "g"), "p").join(hop("g", "t"), "g").join(hop("t", "u"), "t")
        jumped, seen = stored_counting(far.select("v", "t", F.col("u").alias("p")), moved=F.count_if(F.col("t") != F.col("p")))
        parents = jumped.select("v", "p")
        if not seen["moved"]:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(group_id, id) of every node of ``edges`` (a, b): group_id is the smallest id of its component.

    Directions, repeats and self pairs don't matter; nulls are dropped; nodes only in self pairs form no group; no
    edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, left = stored_counting(e, n=F.count(F.lit(1)))
    label = None
    while left["n"]:
        root = _collapse(stored(_hook(e)))
        if label is None:
            label = root.select(F.col("v").alias("id"), F.col("p").alias("root"))
        else:
            label = label.join(_sorted(root), label["root"] == root["v"], "left").select("id", F.coalesce("p", "root").alias("root"))
        ra = root.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        rb = root.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        # every component doubles at least per round, so the labels' plan stays a few joins over checkpoints
        e, left = stored_counting(e.join(_sorted(ra), "a").join(_sorted(rb), "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), n=F.count(F.lit(1)))
    if label is None:
        return e.select(F.col("a").alias("group_id"), F.col("b").alias("id"))
    first = label.groupBy("root").agg(F.min("id").alias("group_id"))
    return label.join(_sorted(first), "root").select("group_id", "id")
