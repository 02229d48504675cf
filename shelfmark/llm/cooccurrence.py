"""Items that appear together: basket collapsing, then weighted pair counts, lift and conviction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import tag_key, tag_parts
from shelfmark.session import stored

#: A vocabulary up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def known_items(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, items): the sorted distinct ids of the vocabulary's tags in each record's ``tags``; records without one are left out.

    An element may hold several tags; spellings are compared by ``tag_key``. Of vocabulary rows spelt alike the smallest
    tag_id holds; null names and ids are ignored, as are null elements and empty lists.
    """
    vocab = vocabulary.where("tag_id is not null").groupBy(tag_key(F.col("tag_name")).alias("k")).agg(F.min("tag_id").alias("item")).where("k != ''")
    if len(vocab.take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        vocab = F.broadcast(vocab)
    parts = records.where("id is not null").select("id", F.explode("tags").alias("t")).select("id", F.explode(tag_parts(F.col("t"))).alias("t")).select("id", tag_key(F.col("t")).alias("k"))
    return parts.join(vocab, "k").groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def pair_statistics(baskets: DataFrame) -> DataFrame:
    """(item_1, item_2, n12, n1, n2, n, weight, lift, conviction) of every pair in a common basket; item_1 < item_2.

    ``baskets`` has one sorted array of distinct items per record. Identical baskets collapse into a weight first, so a
    basket held by a third of all records is enumerated once. n is the number of records; weight is Ochiai's
    n12/sqrt(n1*n2); lift is n12*n/(n1*n2); conviction is (1-n2/n)/(1-n12/n1), null where the rule never fails.
    """
    weighed = stored(baskets.groupBy("items").agg(F.count(F.lit(1)).alias("w")).where(F.size("items") > 0))
    single = weighed.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("c"))
    total = F.broadcast(weighed.agg(F.sum("w").alias("n")))  # one row
    # two expansions, one after the other: the pairs of a large basket never lie in one row
    first = weighed.select("items", "w", F.posexplode("items").alias("at", "item_1")).select("item_1", "w", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_2"))
    both = first.groupBy("item_1", "item_2").agg(F.sum("w").alias("n12"))
    one = single.select(F.col("item").alias("item_1"), F.col("c").alias("n1"))
    two = single.select(F.col("item").alias("item_2"), F.col("c").alias("n2"))
    x = both.join(one, "item_1").join(two, "item_2").join(total, F.lit(True))
    fails = 1 - F.col("n12") / F.col("n1")
    return x.select(
        "item_1", "item_2", "n12", "n1", "n2", "n",
        (F.col("n12") / F.sqrt(F.col("n1").cast("double") * F.col("n2"))).alias("weight"),
        (F.col("n12").cast("double") * F.col("n") / (F.col("n1").cast("double") * F.col("n2"))).alias("lift"),
        F.when(fails > 0, (1 - F.col("n2") / F.col("n")) / fails).alias("conviction"),
    )


def item_counts(baskets: DataFrame) -> DataFrame:
    """(item, n1): records holding each item."""
    weighed = baskets.groupBy("items").agg(F.count(F.lit(1)).alias("w"))
    return weighed.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("n1"))
