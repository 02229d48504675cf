"""Most similar vectors for every vector: additive quantisation, lookup-table scoring, exact reranking.

A sample of the collection cuts space into cells, and cells lie together in regions, one task each: a record goes to the
region of its own cell, as row and as query, and to the regions of the other cells near it, as query only. There the
region's own rows train its codebooks: a vector is the sum of one entry of each of several books over all dimensions; the
entries are chosen by beam search and stored with the length of their sum. The first book cuts the region into cells of
few rows, however many rows the collection has and however dense they lie. A query is compared with the rows of the cells
nearest to it: scores come from tables (products of the query with all codebook entries), and the best are reranked by
exact cosine. A task holds its rows; queries stream past them.

Regions expected to be very large are cut into slices by a hash of the id. Of more than ``k + 1`` copies of one vector only
the ``k + 1`` smallest ids are indexed: they are the neighbours of all the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import collect_small, cut


@dataclass(frozen=True)
class Settings:
    """sample: vectors that cut space into cells, about (the bound); row_cell: rows a cell is meant to have; most_cells: cells
    of that cut at most, of which the sample must tell (beyond, the regions cut more); local: rows that train the books of a
    region, at most; entries, codebooks: of the residual books; beam: partial encodings kept; probes: cells searched at most, by
    either cut (twice as many by the first where its cells hold more rows than meant); margin: how much less near than the
    nearest a cell may be to be searched; cell_best, rerank: candidates kept by table score in a cell and in a region;
    region: rows a region is meant to have; slice: rows of a region that are searched in one task, about; tasks: of the
    search, at most."""

    dimensions: int = 64
    sample: int = 20_000
    row_cell: int = 150
    most_cells: int = 2048
    local: int = 4096
    entries: int = 96
    codebooks: int = 7
    beam: int = 3
    probes: int = 8
    margin: float = 0.1
    cell_best: int = 100
    rerank: int = 200
    region: int = 4000
    slice: int = 40_000
    tasks: int = 20_000
    seed: int = 11


def usable(c: Column, dimensions: int) -> Column:
    """True for exactly ``dimensions`` finite numbers, not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) == dimensions) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k centres of the rows of x (fewer rows: the rows themselves, repeated)."""
    centres = x[rng.permutation(len(x))[:k]]
    if len(centres) < k:
        return np.resize(centres, (k, x.shape[1])).astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([(2 * b @ centres.T - (centres**2).sum(1)).argmax(1) for b in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        start = np.cumsum(count) - count
        full = count > 0
        sums = np.add.reduceat(x[order], start[full], axis=0)
        centres = centres.copy()
        centres[full] = sums / count[full, None]
        if (~full).any():
            centres[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return centres.astype(np.float32)


class Books:
    """The codebooks: the cells' centres, then the residual books."""

    def __init__(self, books: list[np.ndarray], beam: int):
        self.books, self.beam = books, beam

    @staticmethod
    def train(x: np.ndarray, cells: int, s: Settings) -> Books:
        """Books of residuals of residuals, then fitted together by least squares to the codes of a beam search."""
        rng = np.random.default_rng(s.seed)
        books, rest = [], x
        for size in [cells] + [s.entries] * s.codebooks:
            centres = kmeans(rest, size, rng)
            books.append(centres)
            near = np.concatenate([(2 * b @ centres.T - (centres**2).sum(1)).argmax(1) for b in np.array_split(rest, max(1, len(rest) // 4096))])
            rest = rest - centres[near]
        out = Books(books, s.beam)
        codes = out.encode(x)
        sizes = [len(b) for b in books]
        base = np.cumsum([0, *sizes[:-1]])
        total = sum(sizes)
        gram, right = np.zeros((total, total), np.float32), np.zeros((total, x.shape[1]), np.float32)
        for part in np.array_split(np.arange(len(x)), max(1, len(x) // 2048)):
            hot = np.zeros((len(part), total), np.float32)
            hot[np.arange(len(part))[:, None], codes[part] + base] = 1
            gram += hot.T @ hot
            right += hot.T @ x[part]
        flat = np.concatenate(books)
        fitted = flat + np.linalg.solve(gram + np.eye(total, dtype=np.float32), right - gram @ flat)
        return Books([b.astype(np.float32) for b in np.split(fitted, base[1:])], s.beam)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x books): the best of ``beam`` partial sums, extended book by book."""
        out = []
        for b in np.array_split(x, max(1, len(x) // 2048)):
            n, d = b.shape
            rest = b[:, None, :]
            codes = np.zeros((n, 1, 0), np.int64)
            for book in self.books:
                w = rest.shape[1]
                error = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, w, -1) + (book**2).sum(1)
                flat = error.reshape(n, -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
                parent, entry = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[entry]
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), entry[:, :, None]], 2)
            out.append(codes[:, 0])
        return np.concatenate(out) if out else np.zeros((0, len(self.books)), np.int64)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return np.asarray(flat, np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their scale."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _regions(centres: np.ndarray, own: np.ndarray, n: int, s: Settings, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Region of each cell, and slices of each region, from the rows of the cells expected of n, given the cells of a sample.

    While there are fewer regions than cells, regions are groups of near ones; beyond, every cell is a region.
    """
    rows = np.bincount(own, minlength=len(centres)) * (n / len(own))
    count = int(max(1, round(n / s.region)))
    if count < len(centres):
        middle = kmeans(centres, count, rng)
        region = (2 * centres @ middle.T - (middle**2).sum(1)).argmax(1)
    else:
        region, count = np.arange(len(centres)), len(centres)
    return region, np.maximum(1, np.ceil(np.bincount(region, rows, count) / s.slice)).astype(np.int64)


def _probes(v: np.ndarray, centres: np.ndarray, wide: int, margin: float) -> np.ndarray:
    """Cells to search for each vector, the nearest first: ``wide`` at most, those as near as the nearest but for the margin; -1 fills up."""
    near = v @ centres.T - (centres**2).sum(1) / 2
    wide = min(wide, len(centres))
    probe = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
    level = np.take_along_axis(near, probe, 1)
    order = np.argsort(-level, axis=1, kind="stable")
    level, probe = np.take_along_axis(level, order, 1), np.take_along_axis(probe, order, 1)
    return np.where(level >= level[:, :1] - margin, probe, -1)


class Index:
    """The rows of a region, to be searched: ids in order, unit vectors, the codes of books that these rows train."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, s: Settings):
        n = len(ids)
        self.s, self.ids, self.vec, self.books = s, np.r_[ids, np.array([None], object)], np.r_[vec, np.zeros((1, vec.shape[1]))], None
        if n <= s.rerank:  # all are reranked
            return
        x = vec.astype(np.float32)
        cells = max(1, round(n / s.row_cell))
        told = min(n, max(s.local, 16 * cells))
        self.books = Books.train(x[np.arange(told) * n // told], cells, s)
        codes = self.books.encode(x)
        self.scale = (1 / np.maximum(np.linalg.norm(self.books.sums(codes), axis=1), 1e-6)).astype(np.float32)
        self.order = np.argsort(codes[:, 0], kind="stable")
        self.begin = np.searchsorted(codes[self.order, 0], np.arange(cells + 1))
        sizes = [len(b) for b in self.books.books[1:]]
        self.codes = codes[:, 1:] + np.cumsum([0, *sizes[:-1]])

    def candidates(self, q: np.ndarray, share: int) -> np.ndarray:
        """The rows of each query (float32) that are to be compared exactly; the last, empty one fills up. share: see ``search``."""
        s, none = self.s, len(self.ids) - 1
        if self.books is None:
            return np.arange(none)[None].repeat(len(q), 0)
        first, residual = self.books.books[0], np.concatenate(self.books.books[1:]).T
        probes, tables = _probes(q, first, max(1, s.probes // share), s.margin), q @ residual
        width = probes.shape[1] * s.cell_best
        found = np.full((len(q), width), none, np.int64)
        score = np.full((len(q), width), -np.inf, np.float32)
        by_cell = np.argsort(probes.ravel(), kind="stable")
        ends = np.searchsorted(probes.ravel()[by_cell], np.arange(len(first) + 1))
        for c in range(len(first)):
            members = self.order[self.begin[c] : self.begin[c + 1]]
            who, slot = np.divmod(by_cell[ends[c] : ends[c + 1]], probes.shape[1])
            if not len(who) or not len(members):
                continue
            # the tables by entry: a code takes whole rows of them
            own = np.ascontiguousarray(tables[who].T)
            near = (q[who] @ first[c])[None].repeat(len(members), 0)
            for m in range(self.codes.shape[1]):
                near += own[self.codes[members, m]]
            near = (near * self.scale[members][:, None]).T
            keep = min(s.cell_best, len(members))
            best = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if keep < len(members) else np.arange(keep)[None].repeat(len(who), 0)
            place = slot[:, None] * s.cell_best + np.arange(keep)
            found[who[:, None], place] = members[best]
            score[who[:, None], place] = np.take_along_axis(near, best, 1)
        if width > (most := max(1, s.rerank // share)):
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            found = np.take_along_axis(found, best, 1)
        return found

    def search(self, names: np.ndarray, q: np.ndarray, k: int, share: int = 1):
        """(query, neighbour, cosine) of queries by id and unit vector. share: by what to divide the probes and what is reranked."""
        none = len(self.ids) - 1
        for at in range(0, len(q), 4096):
            found = self.candidates(q[at : at + 4096].astype(np.float32), share)
            for lo in range(0, len(found), 512):
                f, me = found[lo : lo + 512], names[at + lo : at + lo + 512]
                cos = np.einsum("qd,qcd->qc", q[at + lo : at + lo + len(f)], self.vec[f])
                cos[(f == none) | (self.ids[f] == me[:, None])] = -np.inf
                least = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k] if cos.shape[1] > k else -np.inf
                i, j = np.nonzero((cos >= least) & (cos > -np.inf))
                # ties: the smaller id; rows are in the order of their ids
                rank = np.lexsort((f[i, j], -cos[i, j], i))
                i, j = i[rank], j[rank]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                yield me[i], self.ids[f[i, j]], cos[i, j]


def neighbours(vectors: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(id, other, cosine): for every usable vector the k others most similar by cosine (fewer if there are fewer).

    ``vectors`` has id and embedding; unusable embeddings (null, other length, not finite, all zero) and null ids are
    left out; of an id with several embeddings the smallest holds; ties go to the smaller id. An empty table gives no
    rows. Approximate: ``recall`` measures against brute force.
    """
    s, spark = settings, vectors.sparkSession
    d = s.dimensions
    base = vectors.where(F.col("id").isNotNull() & usable(F.col("embedding"), d)).groupBy("id").agg(F.min("embedding").alias("embedding"))
    base = cut(base.select(F.col("id").cast("string").alias("id"), "embedding"))
    n = base.count()
    if n < 2:
        return spark.createDataFrame([], "id string, other string, cosine double")
    copies = [F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")]
    crowded = base.select(*copies).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1)
    indexed, rest = base, None
    if not crowded.isEmpty():
        hashed = base.select("id", "embedding", *copies)
        first = hashed.withColumn("_rn", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("_rn") <= k + 1)
        indexed = cut(first.select("id", "embedding", "h1", "h2"))
        tops = indexed.join(crowded.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("others"))
        salts = 16
        tops = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rest = hashed.join(indexed.select("id"), "id", "left_anti").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        rest = rest.join(tops, ["h1", "h2", "salt"]).select("id", F.explode("others").alias("other")).withColumn("cosine", F.lit(1.0))
        indexed = indexed.select("id", "embedding")
    sample = base.where(F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(n)) < s.sample).orderBy("id").select("embedding").toArrow()["embedding"].combine_chunks()
    x = _unit(_matrix(sample, d)).astype(np.float32)
    if not len(x):
        x = np.eye(1, d, dtype=np.float32)
    cells = int(max(1, min(s.most_cells, n // s.row_cell, len(x) // 8)))
    centres = kmeans(x, cells, np.random.default_rng(s.seed))
    region, slices = _regions(centres, _probes(x, centres, 1, 0)[:, 0], n, s, np.random.default_rng(s.seed))
    # a sample tells less of the borders of cells of many groups
    wide = s.probes * (2 if round(n / (cells * s.row_cell)) > 1 else 1)
    shared = spark.sparkContext.broadcast((centres, region, slices))  # a few hundred KB: bounded by the settings

    def route(batches):
        centres, region, slices = shared.value
        start = np.cumsum(slices) - slices
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids, slot = part.column(0), np.asarray(part.column(2))
                probe = _probes(_unit(_matrix(part.column(1), d)).astype(np.float32), centres, wide, s.margin)
                home = region[probe[:, 0]]
                # every region of a vector's cells once, and every slice of it
                ordered = np.sort(np.where(probe < 0, -1, region[probe]), axis=1)
                i, c = np.nonzero((ordered >= 0) & np.c_[np.ones(len(ordered), bool), ordered[:, 1:] != ordered[:, :-1]])
                r = ordered[i, c]
                times = slices[r]
                rep = np.repeat(np.arange(len(r)), times)
                t = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
                i, r, times = i[rep], r[rep], times[rep]
                own = (r == home[i]) & (slot[i] % times == t)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(start[r] + t, pa.int32()), pa.array(own), ids.take(take), part.column(1).take(take)], ["key", "own", "id", "embedding"])

    def search(batches):
        now, rows, index = None, [], None

        def answers(part, index, share=1):
            for a, b, c in index.search(np.array(part.column("id").to_pylist(), object), _unit(_matrix(part.column("embedding"), d)), k, share):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())], ["id", "other", "cosine"])

        def opened(rows):
            t = pa.Table.from_batches(rows).sort_by("id").combine_chunks().to_batches()[0]
            return t, Index(np.array(t.column("id").to_pylist(), object), _unit(_matrix(t.column("embedding"), d)), s)

        for b in batches:
            key, own = np.asarray(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (own[1:] != own[:-1])) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if rows and (key[lo] != now or not own[lo]):  # all rows are there; they are queries as well
                    t, index = opened(rows)
                    rows = []
                    yield from answers(t, index)
                if key[lo] != now:
                    now, index = key[lo], None
                if own[lo]:
                    rows.append(b.slice(lo, hi - lo))
                elif index is not None:
                    yield from answers(b.slice(lo, hi - lo), index, 2)  # most of their neighbours are at home
        if rows:
            t, index = opened(rows)
            yield from answers(t, index)

    kind = "array<float>" if "float" in base.schema["embedding"].dataType.simpleString() else "array<double>"
    routed = indexed.select("id", "embedding", F.crc32("id").alias("slot")).mapInArrow(route, f"key int, own boolean, id string, embedding {kind}")
    # a region's slice per task while there are not too many: hashed, several would meet in one task and others stay idle
    tasks = int(min(slices.sum(), s.tasks))
    found = routed.repartitionById(tasks, F.pmod("key", F.lit(tasks))).sortWithinPartitions("key", F.desc("own")).mapInArrow(search, "id string, other string, cosine double")
    best = W.partitionBy("id").orderBy(F.desc("cosine"), "other")
    out = found.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k).drop("_rn")
    return out.unionByName(rest) if rest is not None else out


def pairs(near: DataFrame) -> DataFrame:
    """(id_1, id_2), the smaller first: one of the two is among the other's neighbours."""
    return near.select(F.least("id", "other").alias("id_1"), F.greatest("id", "other").alias("id_2")).distinct()


def recall(near: DataFrame, vectors: DataFrame, k: int, every: int = 20, settings: Settings = Settings(), most: int = 20_000) -> float:
    """Share of the true k nearest found, for the queries whose number (the digits of the id) is divisible by ``every``, by brute force.

    The queries' vectors (at most ``most``, else an error: raise ``every``) are sent to all tasks; each compares its rows
    with them in blocks and gives the k best of its own, so that no vector of the collection comes to the driver.
    """
    d = settings.dimensions
    base = vectors.where(F.col("id").isNotNull() & usable(F.col("embedding"), d)).groupBy("id").agg(F.min("embedding").alias("embedding"))
    number = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint"), F.crc32("id"))
    asked = collect_small(base.where(number % every == 0), most)
    names = np.array([r[0] for r in asked], object)
    q = _unit(np.array([r[1] for r in asked], np.float64).reshape(-1, d))
    sent = base.sparkSession.sparkContext.broadcast((names, q))

    def best(batches):
        names, q = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                ids = np.array(part.column(0).to_pylist(), object)
                cos = (q @ _unit(_matrix(part.column(1), d)).T).round(12)
                cos[names[:, None] == ids[None]] = -np.inf
                keep = min(k, len(ids))
                top = np.lexsort((np.broadcast_to(ids, cos.shape), -cos), axis=1)[:, :keep] if len(ids) <= k else np.argpartition(-cos, keep - 1, axis=1)[:, :keep]
                row = np.repeat(np.arange(len(q)), keep)
                yield pa.RecordBatch.from_arrays([pa.array(names[row], pa.string()), pa.array(ids[top.ravel()], pa.string()), pa.array(np.take_along_axis(cos, top, 1).ravel())], ["id", "other", "cosine"])

    every_best = base.select("id", "embedding").mapInArrow(best, "id string, other string, cosine double").where("cosine > double('-infinity')")
    w = W.partitionBy("id").orderBy(F.desc("cosine"), "other")
    true = every_best.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select("id", "other")
    hit = true.join(near.select("id", "other"), ["id", "other"], "left_semi").count()
    return hit / max(1, true.count())
