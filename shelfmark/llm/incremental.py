"""Deduplicating new batches against all history: multi-key sorted-neighbourhood runs.

History is kept as runs: the keys of the accepted records (page address, title, description forwards, description
backwards; those of texts begin with a hash of their numbers), sorted within key ranges whose limits were drawn once
from a bounded sample. A batch is keyed, sorted and written as a run of its own; only the key ranges it touches are read,
and each new row is compared with the window of rows around it that share its key. The window is as long as the key
recurs, not a fixed count: a fixed one would lose links where many texts begin alike. Rows of one whole text fall
together in the first of them. What lies in a window is then checked: the same page, or the same title and description
up to small edits. Runs are compacted as they pile up, so that their number follows the logarithm of the batches.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import FILLERS, TAG
from shelfmark.functions.urls import page_key
from shelfmark.session import hadoop_path, shared_path, stored, stored_counting

#: Kinds of keys; letters of a text in a key; rows a key range is meant to have; sampled keys per range.
KINDS = ("page", "title", "forward", "backward")
LETTERS, RANGE_ROWS, SAMPLED = 40, 60_000, 50
#: Share of a description's tokens that may differ, and how many may in any case.
EDITS, FEW_EDITS = 0.12, 2
#: Times a last sentence must have been found added to another record's whole text, and in what share of its uses, to count as an addition.
SEEN, SHARE = 3, 0.2
#: Batches are merged together until they hold this share of the rows of the history, which each merge reads once.
AT_ONCE = 1 / 16
#: Keyed rows of a merge (about a hundred bytes each) up to which they are broadcast to the runs; beyond, both are shuffled.
BROADCAST_ROWS = 100_000
#: The batch of history, and of new records without one.
HISTORY, UNKNOWN = -1, 2**30

TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
MARKUP, DIGITS = re.compile(TAG), re.compile(r"\d+")
EMPTY = frozenset(FILLERS)
#: Of ASCII texts: every sign but letters and digits as a blank; the bytes that are no digits.
SIGNS, NO_DIGITS = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128)), bytes(c for c in range(256) if not 48 <= c < 58)
WORDS = "name string, head string, tail string, head_tokens int, tokens int, head_numbers string, numbers string, title int, half_1 int, half_2 int, phrase string"


def plain(text: str | None) -> str:
    """A text without markup, of normal width, lower case; '' if it tells nothing."""
    if not text:
        return ""
    if "<" in text:
        bare, text = MARKUP.sub("", text), MARKUP.sub(" ", text)
    else:
        bare = text
    if len(bare) < 40 and bare.strip().lower() in EMPTY:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.strip().lower()


def last_sentence(text: str) -> int:
    """Where the last sentence of a plain text begins; 0 if it has but one."""
    core = text.rstrip(".!?。)」\"' \t\r\n")
    return 1 + max(core.rfind(c) for c in ".!?。\n")


def tokens(text: str) -> list[str]:
    """The words of a plain text; single letters of scripts without blanks."""
    return text.translate(SIGNS).split() if text.isascii() else TOKEN.findall(text)


def digits(text: str) -> str:
    return text.encode().translate(None, NO_DIGITS).decode() if text.isascii() else "".join(DIGITS.findall(text))


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) - 2**31


def words_of(name: str | None, desc: str | None) -> tuple | None:
    """The columns of WORDS for one record; None if its title or description tells nothing."""
    n, d = plain(name), plain(desc)
    if not n or not d:
        return None
    at = last_sentence(d)
    title, head, tail = tokens(n), tokens(d[:at]), tokens(d[at:])
    if not title or not (head or tail):
        return None
    if not head or not tail:
        head, tail, at = head + tail, [], len(d)
    said, own, more = digits(n), digits(d[:at]), digits(d[at:])
    numbers = lambda x: hashlib.md5(f"{said}|{''.join(sorted(x))}".encode()).hexdigest()[:10]
    k = len(title)
    last, mine = " ".join(tail), numbers(own)
    return (
        " ".join(title), " ".join(head), last, len(head), len(head) + len(tail), mine, numbers(own + more) if more else mine,
        _hash("".join(title)), _hash(f"{k} " + " ".join(title[: k // 2])), _hash(f"{k} " + " ".join(title[k // 2 :])), DIGITS.sub("#", last) or None,
    )


def comparable(records: DataFrame) -> DataFrame:
    """The records with page and the columns of WORDS in place of title, description and address.

    name, head and tail are the words of the title, of the description but its last sentence, and of that; numbers a hash
    of the title's digits and the description's in any order (records that differ there are never the same); title and
    the halves hashes of the title's words; phrase the last sentence without its numbers. A record whose title or
    description tells nothing (null, blank, a filler, no word) has nulls there, one without a page address no page.
    """
    fixed = ("dataset_name", "dataset_desc", "dataset_url")
    names = [f.split()[0] for f in WORDS.split(", ")]
    keep = [c for c in records.columns if c not in (*fixed, "page", *names)]
    x = records.select(*keep, page_key(F.col("dataset_url")).alias("page"), "dataset_name", "dataset_desc")
    kinds = [pa.int32() if f.endswith(" int") else pa.string() for f in WORDS.split(", ")]
    none = (None,) * len(names)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows = [words_of(n, d) or none for n, d in zip(part.column(len(keep) + 1).to_pylist(), part.column(len(keep) + 2).to_pylist())]
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep) + 1)), *made], [*keep, "page", *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-2])
    return x.mapInArrow(run, f"{schema}, {WORDS}")


def history_of(records: DataFrame) -> DataFrame:
    """(batch, id, canonical_id, page, words...) of accepted records (id, canonical_id, dataset_name, dataset_desc, dataset_url), stored."""
    return stored(comparable(records).withColumns({"batch": F.lit(HISTORY), "canonical_id": F.coalesce("canonical_id", "id")}))


def batch_of(incoming: DataFrame) -> DataFrame:
    """(batch, id, page, words...) of new records, stored: repeated rows once, an id in its first batch, null ids left out."""
    first = W.partitionBy("id").orderBy(F.col("batch_no").asc_nulls_last(), F.col("arrived_at").asc_nulls_last(), "dataset_name", "dataset_desc", "dataset_url")
    x = incoming.where(F.col("id").isNotNull()).withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    return stored(comparable(x.select(F.coalesce(F.col("batch_no").cast("int"), F.lit(UNKNOWN)).alias("batch"), "id", "dataset_name", "dataset_desc", "dataset_url")))


def additions(records: DataFrame) -> DataFrame:
    """(phrase): last sentences that are often found added to the whole text of another record of the same title.

    Such as a mirror's note. What ends many texts, but was never seen added to one, is part of those texts.
    """
    squeeze = lambda *c: F.xxhash64(*(F.replace(F.col(x), F.lit(" "), F.lit("")) if x != "all" else F.replace(F.concat("head", "tail"), F.lit(" "), F.lit("")) for x in c))
    told = records.where("name is not null")
    ends = told.where("phrase is not null").select("phrase", squeeze("name", "head").alias("k"))
    whole = told.select(squeeze("name", "all").alias("k"))
    # a phrase has to recur before its texts are looked up
    often = ends.groupBy("phrase").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= SEEN)
    found = ends.join(often, "phrase").join(whole, "k", "left_semi").groupBy("phrase").agg(F.count(F.lit(1)).alias("hits"), F.first("uses").alias("uses"))
    return stored(found.where((F.col("hits") >= SEEN) & (F.col("hits") >= SHARE * F.col("uses"))).select("phrase"))


def without_additions(records: DataFrame, added: DataFrame) -> DataFrame:
    """(batch, id, page, name, desc, tokens, key parts...) of comparable records, whose descriptions lose a last sentence that is an addition."""
    x = records.join(added.withColumn("_cut", F.lit(True)), "phrase", "left")
    less = F.col("_cut").isNotNull()
    desc = F.when(less | (F.col("tail") == ""), F.col("head")).when(F.col("head") == "", F.col("tail")).otherwise(F.concat_ws(" ", "head", "tail"))
    x = x.select("batch", "id", "page", "name", desc.alias("desc"), F.when(less, F.col("head_tokens")).otherwise(F.col("tokens")).alias("n"), F.when(less, F.col("head_numbers")).otherwise(F.col("numbers")).alias("numbers"), "title", "half_1", "half_2", *(c for c in ("canonical_id",) if c in records.columns))
    return x.where("name is not null or page is not null")


def heads(records: DataFrame, copies: bool = False) -> DataFrame:
    """(kind, key, text, batch, id, title, half_1, half_2, n): the keys of the first record of every text, and of every page (whose text is 0).

    Equal texts have equal keys, so copies fall together before their keys are made, in partial aggregations before each shuffle.
    copies: the keys of every record, without a shuffle.
    """
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    x = records.where("name is not null").select("batch", "id", "numbers", bare("name").alias("_t"), bare("desc").alias("_d"), "title", "half_1", "half_2", "n")
    x = x.select(F.xxhash64("_t", "_d").alias("text"), "batch", "id", F.substring("_t", 1, LETTERS).alias("k1"), F.substring("_d", 1, LETTERS).alias("k2"), F.reverse(F.substring("_d", -LETTERS, LETTERS)).alias("k3"), "numbers", "title", "half_1", "half_2", "n")
    rest = ["k1", "k2", "k3", "numbers", "title", "half_1", "half_2", "n"]
    if not copies:
        x = x.groupBy("text").agg(F.min(F.struct("batch", "id", *rest)).alias("x")).select("text", "x.*")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.concat("numbers", f"k{k}").alias("key")) for k in (1, 2, 3))))
    texts = x.select(each.alias("k"), "text", "batch", "id", "title", "half_1", "half_2", "n").select("k.kind", "k.key", "text", "batch", "id", "title", "half_1", "half_2", "n")
    pages = records.where("page is not null").select("page", F.struct("batch", "id").alias("x"))
    pages = pages if copies else pages.groupBy("page").agg(F.min("x").alias("x"))
    none = F.lit(None).cast("int")
    return texts.unionByName(pages.select(F.lit(0).alias("kind"), F.col("page").alias("key"), F.lit(0).cast("bigint").alias("text"), "x.batch", "x.id", *(none.alias(c) for c in ("title", "half_1", "half_2", "n"))))


ROW = "kind int, key string, text bigint, batch int, id string, title int, half_1 int, half_2 int, n int, range int"


@dataclass
class Runs:
    """Sorted runs in the shared folder, the limits of the key ranges of each kind, what mirrors add, and the records accepted so far."""

    spark: SparkSession
    folder: str
    limits: list[list[str]]
    added: DataFrame
    names: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    accepted: list[DataFrame] = field(default_factory=list)
    rows: int = 0
    pending: DataFrame | None = None

    def at(self, keyed: DataFrame) -> DataFrame:
        """With the key range of each row: ranges of a kind are numbered on from those of the kind before. Limits are searched in two levels."""
        base, out = 0, None
        for kind, limits in enumerate(self.limits):
            here = F.lit(base)
            if limits:
                step = isqrt(len(limits)) + 1
                coarse = F.size(F.filter(F.lit(limits[::step]), lambda c: c <= F.col("key")))
                fine = F.size(F.filter(F.slice(F.lit(limits), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step)), lambda c: c <= F.col("key")))
                here = here + F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)
            out = F.when(F.col("kind") == kind, here) if out is None else out.when(F.col("kind") == kind, here)
            base += len(limits) + 1
        return keyed.withColumn("range", out)

    def read(self, ranges: list[int] | None = None, names: list[str] | None = None) -> DataFrame:
        """All rows of the runs, or those of some ranges: the others' files are not opened."""
        parts = [self.spark.read.schema(ROW).parquet(f"{self.folder}/{n}") for n in names or self.names]
        out = reduce(DataFrame.unionByName, parts)
        return out if ranges is None else out.where(F.col("range").isin(ranges))

    def add(self, keyed: DataFrame) -> str:
        """Write one more run: a file per key range, sorted by key; its name."""
        name = f"run-{len(self.names)}-{zlib.crc32(str(self.names).encode()):08x}"
        seen = Observation()
        rows = keyed.repartition("range").sortWithinPartitions("range", "kind", "key", "batch", "id").observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("range").parquet(f"{self.folder}/{name}")
        self.names.append(name)
        self.sizes.append(seen.get["n"])  # counted by the job that writes
        return name

    def ranges(self, name: str) -> list[int]:
        """The key ranges a run touches: its folders."""
        fs, at = hadoop_path(self.spark, f"{self.folder}/{name}")
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("range="))

    def compact(self, everything: bool = False) -> None:
        """Merge the last runs into one while the one before is less than twice as large, or all; of one key's equal texts the first stays."""
        first, total = len(self.names) - 1, self.sizes[-1] if self.sizes else 0
        while first > 0 and (everything or self.sizes[first - 1] < 2 * total):
            first -= 1
            total += self.sizes[first]
        old = self.names[first:]
        if len(old) < 2:
            return
        rows = self.read(names=old)
        rest = [c for c in rows.columns if c not in ("range", "kind", "key", "text", "batch", "id")]
        kept = rows.groupBy("range", "kind", "key", "text").agg(F.min(F.struct("batch", "id", *rest)).alias("x")).select("range", "kind", "key", "text", "x.*")
        before, sizes = self.names[:first], self.sizes[:first]
        self.add(kept)
        self.names, self.sizes = [*before, self.names[-1]], [*sizes, self.sizes[-1]]
        for name in old:
            fs, at = hadoop_path(self.spark, f"{self.folder}/{name}")
            fs.delete(at, True)


    def settle(self) -> None:
        """What the last merge left to the next one: its records are stored among the accepted, its run is compacted."""
        if self.pending is not None:
            self.accepted.append(stored(self.pending))
            self.pending = None
        self.compact()


def open_runs(history: DataFrame) -> Runs:
    """Runs that hold ``history`` (as by ``history_of``)."""
    spark = history.sparkSession
    added = additions(history)
    mine = without_additions(history, added)
    n = max(1, history.count())
    ranges = max(1, round(n / RANGE_ROWS))
    limits: list[list[str]] = [[] for _ in KINDS]
    keyed = heads(mine)
    if ranges > 1:
        drawn = heads(mine.where(F.pmod(F.xxhash64("id"), F.lit(n)) < ranges * SAMPLED), copies=True).select("kind", "key").collect()
        for k in range(len(KINDS)):
            own = sorted({r["key"] for r in drawn if r["kind"] == k})
            limits[k] = sorted({own[len(own) * i // ranges] for i in range(1, ranges)}) if own else []
    runs = Runs(spark, shared_path(spark, "runs"), limits, added)
    runs.add(runs.at(keyed))
    runs.accepted.append(mine)
    runs.rows = n
    return runs


def first_copies(fresh: DataFrame) -> DataFrame:
    """(batch, id, other_batch, other_id, page): each new record with the first new one of its whole text, and of its page."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    each = F.array(F.struct(F.lit(True).alias("page"), F.col("page").alias("k")), F.struct(F.lit(False).alias("page"), F.when(F.col("name").isNotNull(), F.xxhash64(bare("name"), bare("desc")).cast("string")).alias("k")))
    x = fresh.select("batch", "id", F.explode(each).alias("e")).select("batch", "id", "e.page", "e.k").where("k is not null")
    first = x.groupBy("page", "k").agg(F.min(F.struct("batch", "id")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return x.join(first, ["page", "k"]).select("batch", "id", F.col("f.batch").alias("other_batch"), F.col("f.id").alias("other_id"), "page").where("id != other_id")


def window_pairs(runs: Runs, name: str) -> DataFrame:
    """(batch, id, other_batch, other_id, page, sure): rows of the run ``name`` and the earlier accepted rows in the windows around them.

    Only ranges the run touches are read. A merge of up to BROADCAST_ROWS keys goes to where the runs lie, so that no old
    row is shuffled for it; of a larger one both sides are sorted and merged. Texts of one window that can't be the same (their titles differ in both halves, or their
    lengths by more than the edits allowed) are left out at once; equal texts are sure.
    """
    new = runs.read(names=[name])
    pick = ["text", "batch", "id", "title", "half_1", "half_2", "n"]
    other = runs.read(runs.ranges(name)).select("kind", "key", *(F.col(c).alias(f"o_{c}") for c in pick))
    new = new.select("kind", "key", *pick)
    x = other.join(F.broadcast(new) if runs.sizes[runs.names.index(name)] <= BROADCAST_ROWS else new, ["kind", "key"])
    same = F.col("text") == F.col("o_text")
    alike = (F.col("title") == F.col("o_title")) | (F.col("half_1") == F.col("o_half_1")) | (F.col("half_2") == F.col("o_half_2"))
    near = F.abs(F.col("n") - F.col("o_n")) <= F.greatest(F.lit(FEW_EDITS), F.floor(EDITS * F.greatest("n", "o_n")))
    before = F.struct("o_batch", "o_id") < F.struct("batch", "id")
    return x.where(before & (F.col("id") != F.col("o_id")) & (same | (alike & near))).select("batch", "id", F.col("o_batch").alias("other_batch"), F.col("o_id").alias("other_id"), (F.col("kind") == 0).alias("page"), same.alias("sure"))


@lru_cache(20_000)
def _split(words: str) -> tuple[str, ...]:
    return tuple(words.split())


def _edits(a: tuple[str, ...], b: tuple[str, ...], most: int) -> int:
    """Tokens to insert, delete or replace; more than ``most`` is not told exactly."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b or abs(len(a) - len(b)) > most:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _typo(x: str, y: str) -> bool:
    """Words that differ by a slip: one letter more, less or other, or two swapped; never in digits."""
    if any(c.isdigit() for c in x + y) or abs(len(x) - len(y)) > 1 or min(len(x), len(y)) < 4:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    a, b = x[i:], y[i:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:] or (len(a) > 1 and len(b) > 1 and a[:2] == b[1::-1] and a[2:] == b[2:])


def same_title(a: str, b: str) -> bool:
    """Whether two titles, as words, are equal but for at most one slip, however their words are joined."""
    x, y = _split(a), _split(b)
    if x == y or "".join(x) == "".join(y):
        return bool(x)
    return len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1 and all(p == q or _typo(p, q) for p, q in zip(x, y))


def same_description(a: str, b: str) -> bool:
    """Whether two descriptions, as words, are equal up to a few tokens; the numbers must be the same."""
    x, y = _split(a), _split(b)
    if x == y or "".join(x) == "".join(y):
        return bool(x)
    digits = lambda t: sorted(w for w in t if any(c.isdigit() for c in w))
    if digits(x) != digits(y):
        return False
    most = max(FEW_EDITS, int(EDITS * max(len(x), len(y))))
    return min(len(x), len(y)) > most and _edits(x, y, most) <= most


def checked(pairs: DataFrame, accepted: list[DataFrame], few: bool = False) -> DataFrame:
    """(batch, id, other_batch, other_id, page): the pairs that are one dataset: pages and equal texts as they are, the others by their words.

    few: whether the pairs to be looked at are no more than BROADCAST_ROWS, so that their ids go to where the texts lie.
    """
    names = ["batch", "id", "other_batch", "other_id"]
    sure = pairs.where("page or sure").groupBy(*names).agg(F.max("page").alias("page"))
    open_ = pairs.where("not page and not sure").select(*names).distinct()
    need = open_.select(F.col("id").alias("k")).union(open_.select(F.col("other_id").alias("k"))).distinct()
    need = F.broadcast(need) if few else need
    have = reduce(DataFrame.unionByName, [a.select(F.col("id").alias("k"), "name", "desc") for a in accepted]).join(need, "k", "left_semi")
    one = have.select(F.col("k").alias("id"), F.col("name").alias("n1"), F.col("desc").alias("d1"))
    two = have.select(F.col("k").alias("other_id"), F.col("name").alias("n2"), F.col("desc").alias("d2"))

    def judge(batches):
        for b in batches:
            n1, d1, n2, d2 = (b.column(i).to_pylist() for i in range(4, 8))
            ok = np.array([same_title(a, c) and same_description(x, y) for a, x, c, y in zip(n1, d1, n2, d2)], bool)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)], names).filter(pa.array(ok))

    same = open_.join(one, "id").join(two, "other_id").select(*names, "n1", "d1", "n2", "d2").mapInArrow(judge, "batch int, id string, other_batch int, other_id string")
    return sure.unionByName(same.withColumn("page", F.lit(False)))


def resolve(links: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical_id, id): each linked record's dataset. ``canonical`` (id, canonical_id) holds the records accepted before.

    A record follows its best link: to those accepted before, by page before text, to the earliest; links within the
    merged batches are followed to their first record by pointer doubling.
    """
    x = links.join(canonical.select(F.col("id").alias("other_id"), F.col("canonical_id").alias("c")), "other_id", "left")
    best = F.min(F.struct(F.col("c").isNull().alias("a"), (~F.col("page")).alias("b"), F.coalesce("c", F.lit("")).alias("d"), "other_batch", "other_id")).alias("m")
    unknown = {"open": F.count_if(F.col("done").isNull())}
    node, left = stored_counting(x.groupBy("id").agg(best).select("id", F.when(~F.col("m.a"), F.col("m.d")).alias("done"), F.col("m.other_id").alias("up")), **unknown)
    while left["open"]:
        up = node.select(F.col("id").alias("up"), F.col("done").alias("d2"), F.col("up").alias("up2"), F.lit(True).alias("there"))
        # a parent without links is new itself: the first record of its dataset
        node, left = stored_counting(node.join(up, "up", "left").select("id", F.coalesce("done", F.when(F.col("there").isNull(), F.col("up")), "d2").alias("done"), F.coalesce("up2", "up").alias("up")), **unknown)
    return node.select(F.col("done").alias("canonical_id"), "id")


def recognise(runs: Runs, incoming: DataFrame) -> DataFrame:
    """(canonical_id, id) of every new record of a dataset accepted before; the runs then hold the new records too.

    What only a further call needs (compaction after the last merge, the new records' canonical ids) is left to it.

    ``incoming`` as by ``batch_of``; several batches may come at once. They are merged into the runs one after the other
    (small ones together, see ``merges``), each record is compared with what was accepted before it, in the order of
    (batch, id), and what the merges found is judged in one pass. A record whose id was accepted before is no duplicate
    of itself. Empty tables give no rows.
    """
    runs.settle()
    fresh, took = stored_counting(without_additions(incoming, runs.added), n=F.count(F.lit(1)))
    sizes = {"n": F.count_if(~F.col("page") & ~F.col("sure"))}
    part, seen = stored_counting(first_copies(fresh).withColumn("sure", F.lit(True)), **sizes)
    parts, open_ = [part], seen["n"]
    for at, (first, last) in enumerate(merges(fresh, runs.rows)):
        if at:
            runs.compact()
        name = runs.add(runs.at(heads(fresh.where(F.col("batch").between(first, last)))))
        part, seen = stored_counting(window_pairs(runs, name), **sizes)
        parts, open_ = [*parts, part], open_ + seen["n"]
    known = reduce(DataFrame.unionByName, [a.select("id", "canonical_id") for a in runs.accepted])
    found = resolve(checked(reduce(DataFrame.unionByName, parts), [*runs.accepted, fresh], open_ <= BROADCAST_ROWS), known)
    runs.pending = fresh.join(found.select("id", F.col("canonical_id").alias("_c")), "id", "left").withColumn("canonical_id", F.coalesce("_c", "id")).drop("_c")
    runs.rows += took["n"]
    return found


def merges(incoming: DataFrame, rows: int) -> list[tuple[int, int]]:
    """(first, last) batch of each merge: batches in order, together until they hold AT_ONCE of the ``rows`` accepted so far."""
    sizes = incoming.groupBy("batch").count().orderBy("batch").collect()  # a row per batch
    out, held = [], 0
    for batch, n in sizes:
        if held:
            out[-1] = (out[-1][0], batch)
        else:
            out.append((batch, batch))
        held = 0 if held + n >= AT_ONCE * rows else held + n
    return out


def recognise_all(history: DataFrame, incoming: DataFrame) -> tuple[DataFrame, Runs]:
    """((canonical_id, id) of all batches, the runs after them)."""
    runs = open_runs(history)
    return recognise(runs, incoming), runs
