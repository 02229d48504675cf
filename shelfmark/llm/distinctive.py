"""How distinctive a term is per record: log-likelihood ratio of a two-by-two table, record against the rest."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import stored

#: A whole run of letters, digits and underscores that consists of three or more letters a to z.
TERM = re.compile(r"(?<!\w)[a-z]{3,}(?!\w)")


def record_terms(records: DataFrame, *fields: str) -> DataFrame:
    """(id, len, term, tf): the terms of each record's fields (joined by a blank, null as empty), how often each occurs, and how many there are in all.

    A term is a whole run of letters, digits and underscores that, lower-cased, consists of three or more letters a to
    z. Terms of a record are counted where its text lies, one record at a time in Arrow batches: a JVM aggregation by
    (id, term) takes three times as long, since nearly every row is a group of its own.
    """
    text = F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    # the one letter that falls apart in lower case; as another letter beyond z it keeps its run together
    text = F.lower(F.when(text.contains("\u0130"), F.translate(text, "\u0130", "\u0131")).otherwise(text))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                kinds, terms, counts, sizes = [], [], [], []
                for t in part.column(1).to_pylist():
                    found = Counter(TERM.findall(t))
                    kinds.append(len(found))
                    sizes.append(found.total())
                    terms += found.keys()
                    counts += found.values()
                row = np.repeat(np.arange(len(kinds)), kinds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(np.array(sizes, np.int32)[row]), pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["id", "len", "term", "tf"]
                )

    return records.select("id", text.alias("_t")).mapInArrow(run, f"id {records.schema['id'].dataType.simpleString()}, len int, term string, tf int")


def log_likelihood(k11, k12, k21, k22):
    """Dunning's G² of the table, signed: negative if the record has the term less often than the rest."""
    def h(*parts):
        total = sum(parts[1:], parts[0])
        return sum((F.when(p > 0, p * F.log(p / total)).otherwise(0.0) for p in parts[1:]), F.when(parts[0] > 0, parts[0] * F.log(parts[0] / total)).otherwise(0.0))

    g = 2 * (h(k11, k12, k21, k22) - h(k11 + k12, k21 + k22) - h(k11 + k21, k12 + k22))
    return F.when(k11 * (k21 + k22) >= k21 * (k11 + k12), F.greatest(g, F.lit(0.0))).otherwise(-F.greatest(g, F.lit(0.0)))


def distinctive_terms(records: DataFrame, *fields: str, min_tf: int = 1) -> DataFrame:
    """(id, term, tf, df, llr) of every term with ``tf >= min_tf``.

    df counts the records that use the term and llr compares the term's share in the record with that in the remaining
    collection; both always rest on all records. Records without terms have no rows; an empty collection gives none; in
    a collection of one record llr is 0.
    """
    tf = stored(record_terms(records, *fields))  # read twice: its terms for the totals, its rows for the scores
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    # one row; it takes both sums, so that it reads the shuffled partial counts of ``stats`` instead of all terms once more
    total = F.broadcast(stats.agg(F.sum("cf").alias("all"), F.sum("df").alias("rows")))
    x = tf.where(F.col("tf") >= min_tf).join(stats, "term").join(total, F.lit(True)).where("rows > 0")
    k11, k12 = F.col("tf").cast("double"), (F.col("len") - F.col("tf")).cast("double")
    k21 = (F.col("cf") - F.col("tf")).cast("double")
    k22 = (F.col("all") - F.col("cf")).cast("double") - k12
    return x.select("id", "term", "tf", "df", log_likelihood(k11, k12, k21, k22).alias("llr"))
