"""Topic tags: candidates, vocabulary, synonyms, co-occurrence graph, scores, selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.vector import unit
from shelfmark.functions.text import blank_split, strip, tag_key, tag_parts, words
from shelfmark.params import TAGGING, Tagging
from shelfmark import session
from shelfmark.session import stored
from shelfmark.plugins import Chooser, Encoder, encoded, first_candidates, hashing_encoder

#: Tags up to which a vocabulary counts as small and is broadcast; checked where it matters.
SMALL = 5000
#: Scores that are ranked at a time.
BLOCK = 1 << 18
#: The head words of phrases.
TASKS = ("recognition", "detection", "classification", "generation", "analysis", "processing")
FIELDS = ("natural", "computer", "machine", "deep")
THINGS = ("learning", "vision", "network", "model")


def collect_small(df: DataFrame, most: int = SMALL) -> list:
    """The rows of a table of a checked size."""
    return session.collect_small(df, most)


def candidate_terms(records: DataFrame, p: Tagging = TAGGING) -> DataFrame:
    """(id, term, tf, first_pos, rank): words of three or more letters a-z of title and description, the heaviest first.

    Weight is alpha*tf + beta/first_pos, positions counted over the words kept; ties go to the earlier. Records without
    a description have none; rare and surplus terms are dropped as the settings say.
    """
    text = F.concat_ws(" ", F.coalesce("dataset_name", F.lit("")), F.col("dataset_desc"))
    kept = F.filter(words(text), lambda t: t.rlike("^[a-z]{3,}$"))
    x = records.where("dataset_desc != ''").select("id", F.posexplode(kept).alias("pos", "term"))
    x = x.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), (F.min("pos") + 1).alias("first_pos")).where(F.col("tf") >= p.min_frequency)
    heavy = p.alpha * F.col("tf") + p.beta / F.col("first_pos")
    return x.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc(heavy), "first_pos"))).where(F.col("rank") <= p.max_terms)


def phrases(text: Column, p: Tagging = TAGGING) -> Column:
    """Compound terms of a text, in the order of the three patterns, each once, the first few."""
    t = F.lower(F.coalesce(text, F.lit("")))
    letters, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    forms = (rf"{letters}[a-z]+(?U:\s)+(?:{'|'.join(TASKS)}){end}", rf"{letters}(?:{'|'.join(FIELDS)})(?U:\s)+[a-z]+{end}", rf"{letters}[a-z]+(?U:\s)+(?:{'|'.join(THINGS)}){end}")
    found = F.concat(*(F.regexp_extract_all(t, F.lit(f), F.lit(0)) for f in forms))
    return F.slice(F.array_distinct(found), 1, p.max_phrases)


def candidates(records: DataFrame, p: Tagging = TAGGING) -> DataFrame:
    """(id, tags): phrases, then terms, without repeats; records with neither have an empty list."""
    terms = candidate_terms(records, p).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("terms"))
    x = records.select("id", phrases(F.col("dataset_desc"), p).alias("phrases")).join(terms, "id", "left")
    merged = F.concat("phrases", F.coalesce("terms", F.array().cast("array<string>")))
    return x.select("id", F.array_distinct(F.filter(F.transform(merged, strip), lambda t: t != "")).alias("tags"))


def seed_vocabulary(records: DataFrame, p: Tagging = TAGGING) -> DataFrame:
    """(tag): the candidates of the first records by id (the seed; its size is a setting)."""
    return candidates(records.orderBy("id").limit(p.seed_size), p).select(F.explode("tags").alias("tag")).distinct()


def contained(records: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, tags): the vocabulary's tags that occur in title or description, as any part of the text, in alphabetical order.

    The vocabulary is small (checked); each worker builds one automaton of it, which finds all tags in one pass over a
    text however many they are. Without that library every tag is sought on its own.
    """
    names = sorted({r[0] for r in collect_small(tags.where("tag is not null and tag != ''").select("tag").distinct())})
    text = F.lower(F.concat(F.coalesce("dataset_name", F.lit("")), F.lit(" "), F.coalesce("dataset_desc", F.lit(""))))

    def run(batches):
        find = finder(names)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([find(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["id", "tags"])

    return records.select(F.col("id").cast("string").alias("id"), text.alias("_t")).mapInArrow(run, "id string, tags array<string>")


def finder(names: list[str]):
    """A function that lists, sorted, the names that occur in a text."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [n for n in names if n in text]
    a = ahocorasick.Automaton()
    for n in names:
        a.add_word(n, n)
    if not names:
        return lambda text: []
    a.make_automaton()
    return lambda text: sorted({n for _, n in a.iter(text)})


def document_frequency(records: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, n): records that contain each tag, 0 included."""
    n = contained(records, tags).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.select("tag").distinct().join(n, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def cooccurrence_edges(records: DataFrame, tags: DataFrame, p: Tagging = TAGGING) -> DataFrame:
    """(tag_1, tag_2, n12, weight): pairs contained in one record, weight n12/sqrt(n1*n2), at least the threshold; tag_1 < tag_2."""
    sets = stored(contained(records, tags).groupBy("tags").agg(F.count(F.lit(1)).alias("w")).where("size(tags) > 0"))
    single = sets.select(F.explode("tags").alias("t"), "w").groupBy("t").agg(F.sum("w").alias("n"))
    # two expansions, one after the other: the pairs of a long list never lie in one row
    first = sets.select("tags", "w", F.posexplode("tags").alias("at", "tag_1")).select("tag_1", "w", F.explode(F.slice("tags", F.col("at") + 2, F.size("tags"))).alias("tag_2"))
    both = first.groupBy("tag_1", "tag_2").agg(F.sum("w").alias("n12"))
    x = both.join(single.select(F.col("t").alias("tag_1"), F.col("n").alias("n1")), "tag_1").join(single.select(F.col("t").alias("tag_2"), F.col("n").alias("n2")), "tag_2")
    return x.withColumn("weight", F.col("n12") / F.sqrt(F.col("n1").cast("double") * F.col("n2"))).where(F.col("weight") >= p.edge).select("tag_1", "tag_2", "n12", "weight")


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, p): both directions of the edges (src, dst, weight) between known nodes (node), weights of a row summing to 1.

    Parallel edges add up; rows without weight stay away.
    """
    known = lambda c: nodes.select(F.col("node").alias(c)).distinct()
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(known("src"), "src").join(known("dst"), "dst")
    both = e.select("src", "dst", "weight").union(e.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(W.partitionBy("src"))
    return both.withColumn("p", F.col("weight") / F.when(total != 0, total).otherwise(1.0)).select("src", "dst", "p")


def pagerank(matrix: DataFrame, seeds: DataFrame, p: Tagging = TAGGING) -> DataFrame:
    """(id, node, score): personalised PageRank per id from its seeds (id, node); a seed has 1/(seeds of the id).

    score = (1-restart) * walk + restart * start, a fixed number of steps; seeds unknown to the matrix keep their start
    share only. Joins and sums on edges; for many ids over one small graph ``diffusion`` is faster.
    """
    start = seeds.select("id", "node").distinct()
    start = start.withColumn("s0", 1.0 / F.count(F.lit(1)).over(W.partitionBy("id")))
    score = start.withColumnRenamed("s0", "score")
    for _ in range(p.iterations):
        walk = score.join(matrix, score["node"] == matrix["src"]).groupBy("id", F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("w"))
        score = walk.join(start, ["id", "node"], "full_outer").select("id", "node", ((1 - p.restart) * F.coalesce("w", F.lit(0.0)) + p.restart * F.coalesce("s0", F.lit(0.0))).alias("score"))
    return score


class Spread:
    """Scores that one unit of start mass on a node spreads to; PageRank of several seeds is the mean of their rows.

    Edges are kept sparse and rows made for the nodes asked for; the last ones stay in a memory of bounded size.
    """

    def __init__(self, size: int, edges: list[tuple[int, int, float]], p: Tagging = TAGGING, remembered: int = 1 << 25):
        self.size, self.p, self.most, self.memory = size, p, max(1, remembered // max(1, size)), {}
        by = sorted((j, i, share) for i, j, share in edges)
        self.src, self.share = np.array([i for _, i, _ in by], np.int64), np.array([w for _, _, w in by], np.float64)
        self.dst, self.first = np.unique(np.array([j for j, _, _ in by], np.int64), return_index=True)

    def rows(self, nodes: list[int]) -> np.ndarray:
        """One row per node."""
        fresh = [n for n in dict.fromkeys(nodes) if n not in self.memory]
        made = {}
        step = max(1, (1 << 23) // max(1, len(self.src) + self.size))
        for lo in range(0, len(fresh), step):
            part = fresh[lo : lo + step]
            start = np.zeros((len(part), self.size))
            start[np.arange(len(part)), part] = 1
            score = start
            for _ in range(self.p.iterations):
                walk = np.zeros_like(start)
                if len(self.src):
                    walk[:, self.dst] = np.add.reduceat(score[:, self.src] * self.share, self.first, axis=1)
                score = (1 - self.p.restart) * walk + self.p.restart * start
            made.update(zip(part, score))
        out = np.array([made[n] if n in made else self.memory[n] for n in nodes]).reshape(-1, self.size)
        if len(self.memory) + len(made) > self.most:
            self.memory = {}
        self.memory.update(list(made.items())[: self.most])
        return out


def diffusion(size: int, edges: list[tuple[int, int, float]], p: Tagging = TAGGING) -> np.ndarray:
    """Row i: the scores that one unit of start mass on node i spreads to."""
    return Spread(size, edges, p).rows(list(range(size)))


def known_tags(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, node): the tag_id of every tag of a record (id, tags) that the vocabulary spells, whatever joins its words; of several the smallest."""
    names = vocabulary.where("tag_id is not null").select(tag_key(F.col("tag_name")).alias("k"), "tag_id").where("k != ''").groupBy("k").agg(F.min("tag_id").alias("node"))
    x = records.select("id", F.explode("tags").alias("t")).select("id", F.explode(tag_parts(F.col("t"))).alias("t")).select("id", tag_key(F.col("t")).alias("k"))
    return x.join(F.broadcast(names), "k").select("id", "node").distinct()


def record_ranks(matrix: DataFrame, nodes: DataFrame, seeds: DataFrame, p: Tagging = TAGGING, top: int | None = None) -> DataFrame:
    """(id, node, score, rank): ``pagerank`` of every id's seeds (id, node) over a graph of a checked size (node); only the best of an id with ``top``.

    An id stays one row, with its nodes and scores as lists, until the lists are unfolded at the very end: no rows of
    scores are shuffled, and no join can take their table for a small one and broadcast it. Scores of 0 are left out;
    ties go to the larger node.
    """
    names = sorted({r[0] for r in collect_small(nodes.select("node").distinct())})
    at = {n: i for i, n in enumerate(names)}
    edges = [(at[r[0]], at[r[1]], r[2]) for r in collect_small(matrix.select("src", "dst", "p"), SMALL * 40)]
    sets = seeds.groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("seeds"))
    step = max(1, BLOCK // max(1, len(names)))

    def run(batches):
        spread = Spread(len(names), edges, p)
        back = np.arange(len(names))[::-1]
        for b in batches:
            kind = b.column(1).type.value_type
            called = pa.array(names, kind)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                score = np.array([spread.rows([at[n] for n in own]).mean(0) for own in part.column(1).to_pylist()])
                best = back[np.argsort(-score[:, back].round(9), axis=1, kind="stable")][:, :top]
                score = np.take_along_axis(score, best, 1)
                some = score > 0
                ends = pa.array(np.concatenate([[0], some.sum(1).cumsum()]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, called.take(pa.array(best[some]))), pa.ListArray.from_arrays(ends, pa.array(score[some]))], ["id", "nodes", "scores"])

    own, kind = (sets.schema[c].dataType.simpleString() for c in ("id", "seeds"))
    ranks = sets.mapInArrow(run, f"id {own}, nodes {kind}, scores array<double>")
    return ranks.select("id", F.posexplode("nodes").alias("_at", "node"), "scores").select("id", "node", F.col("scores")[F.col("_at")].alias("score"), (F.col("_at") + 1).alias("rank"))


def synonyms(vectors: list[tuple[str, np.ndarray]], p: Tagging = TAGGING) -> dict[str, str]:
    """tag -> representative. Tags in alphabetical order; each yet free one leads and takes the free ones as similar as the threshold.

    The shortest name of a cluster represents it (ties: the leader, then the alphabet). Vectors None or of zeros stay alone.
    """
    vectors = sorted(vectors, key=lambda x: x[0])
    out: dict[str, str] = {}
    names = [t for t, v in vectors if v is not None]
    m = np.array([v for _, v in vectors if v is not None], np.float64) if names else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(n > 0, n, 1)
    free = np.ones(len(names), bool)
    for i, t in enumerate(names):
        if not free[i]:
            continue
        near = np.flatnonzero(free & (m @ m[i] >= p.synonym))
        cluster = [t, *(names[j] for j in near if j != i)]
        free[near] = False
        free[i] = False
        best = min(cluster, key=len)
        out.update(dict.fromkeys(cluster, best))
    out.update({t: t for t, v in vectors if v is None})
    return out


def synonyms_of(tag_vectors: DataFrame, p: Tagging = TAGGING, size: int = SMALL) -> dict[str, str]:
    """``synonyms`` of a table (tag, embedding) of a checked size."""
    return synonyms([(r[0], None if r[1] is None else np.array(r[1])) for r in collect_small(tag_vectors.select("tag", "embedding"), size)], p)


def initial_graph(records: DataFrame, seed: DataFrame, encoder: Encoder = hashing_encoder, p: Tagging = TAGGING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary (tag), its vectors (tag, embedding), edges (tag_1, tag_2, n12, weight)) that the initial mode builds.

    The seed's tags with synonyms merged, and their co-occurrence over all records.
    """
    leaders = sorted(set(synonyms_of(encoded(seed, "tag", "tag", encoder), p).values()))
    vocabulary = records.sparkSession.createDataFrame([(t,) for t in leaders], "tag string")
    return vocabulary, encoded(vocabulary, "tag", "tag", encoder), cooccurrence_edges(records, vocabulary, p)


def edges_by_id(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tag_id_1, tag_id_2, weight): edges between tags as they are stored, by the ids of a vocabulary (tag_id, tag_name); of names spelt alike the smallest."""
    ids = vocabulary.where("tag_id is not null and tag_name != ''").groupBy(F.lower("tag_name").alias("t")).agg(F.min("tag_id").alias("i"))
    one, two = ids.select(F.col("t").alias("tag_1"), F.col("i").alias("tag_id_1")), ids.select(F.col("t").alias("tag_2"), F.col("i").alias("tag_id_2"))
    return edges.join(one, "tag_1").join(two, "tag_2").select("tag_id_1", "tag_id_2", F.col("weight").cast("float").alias("weight"))


def bm25_single(text: Column, tag: Column) -> Column:
    """Okapi score of a tag's words in a collection of this one text: every word has idf -0.25*ln 3, so hits count against a tag.

    Null or blank text scores 0.
    """
    tokens = blank_split(text)
    query = blank_split(tag)
    idf = -0.25 * np.log(3.0)
    return F.aggregate(query, F.lit(0.0), lambda s, q: s + F.lit(float(idf)) * F.size(F.filter(tokens, lambda t: t == q)) * 2.5 / (F.size(F.filter(tokens, lambda t: t == q)) + 1.5))


def lexical(records: DataFrame, tags: DataFrame, mode: str = "singleton") -> DataFrame:
    """(id, tag, lex) where not 0. mode 'singleton' as ``bm25_single``; 'corpus' with the idf of all records, scaled to the best tag of a record.

    Tags are cut into words, joined with the records' tokens and summed: no record meets a tag it shares no word with.
    """
    text = F.concat_ws(" ", F.coalesce("dataset_name", F.lit("")), F.coalesce("dataset_desc", F.lit("")))
    tf = records.select("id", F.explode(blank_split(text)).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("tf"))
    query = tags.select("tag").distinct().select("tag", F.explode(blank_split(F.col("tag"))).alias("w")).groupBy("tag", "w").agg(F.count(F.lit(1)).alias("q"))
    if mode == "singleton":
        part = F.lit(float(-0.25 * np.log(3.0))) * F.col("q") * F.col("tf") * 2.5 / (F.col("tf") + 1.5)
        return tf.join(query, "w").groupBy("id", "tag").agg(F.sum(part).alias("lex"))
    length = tf.groupBy("id").agg(F.sum("tf").alias("len"))
    whole = F.broadcast(length.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")))  # one row
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("q") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    x = tf.join(query, "w").join(df, "w").join(length, "id").join(whole, F.lit(True)).groupBy("id", "tag").agg(F.sum(part).alias("lex"))
    top = F.max("lex").over(W.partitionBy("id"))
    return x.withColumn("lex", F.when(top > 0, F.col("lex") / top).otherwise(F.col("lex")))


def fused(sem: Column, lex: Column, p: Tagging = TAGGING) -> Column:
    """gamma * semantic + (1 - gamma) * lexical; a missing score is 0."""
    return p.gamma * F.coalesce(sem, F.lit(0.0)) + (1 - p.gamma) * F.coalesce(lex, F.lit(0.0))


def mmr(scores: np.ndarray, vectors: np.ndarray, k: int, balance: float) -> np.ndarray:
    """Rows of the k picks per row of scores: the best first, then the best of balance*score - (1-balance)*max(0, likeness to a pick). Ties: the earlier.

    ``vectors`` are unit vectors of the columns (zeros: alike nothing); only the picks' likeness is computed.
    """
    n, size = scores.shape
    picks = np.zeros((n, min(k, size)), np.int64)
    left, near = np.where(np.isnan(scores), -np.inf, scores), np.zeros(scores.shape)
    for step in range(picks.shape[1]):
        value = left if step == 0 else balance * left - (1 - balance) * near
        picks[:, step] = value.argmax(1)
        left = left.copy()
        left[np.arange(n), picks[:, step]] = -np.inf
        near = np.maximum(near, vectors[picks[:, step]] @ vectors.T)
    return picks


def tag_records(records: DataFrame, vectors: DataFrame, vocabulary: DataFrame, tag_vectors: DataFrame, edges: DataFrame, chooser: Chooser = first_candidates, p: Tagging = TAGGING, size: int = SMALL) -> DataFrame:
    """(id, seeds, candidates, tags, new_tags) of every record.

    vectors (id, v), vocabulary (tag) , tag_vectors (tag, embedding), edges (tag_1, tag_2, weight). Scores are fused,
    MMR picks seeds, they spread over the graph, the best tags are candidates (score descending, later tags first among
    equals) and the chooser decides; where it fails, the first candidates. Records without a vector get no tags. The
    vocabulary is frozen for the run and of a checked size; one pass over the records scores them in blocks.
    """
    tags = sorted({r[0] for r in collect_small(vocabulary.where("tag is not null").select("tag").distinct(), size)})
    at = {t: i for i, t in enumerate(tags)}
    spark = records.sparkSession
    have = {r[0]: np.array(r[1], np.float64) for r in collect_small(tag_vectors.where("tag is not null and embedding is not null").select("tag", "embedding"), size)}
    nodes = spark.createDataFrame([(t,) for t in tags], "node string")
    known = adjacency(edges.select(F.col("tag_1").alias("src"), F.col("tag_2").alias("dst"), "weight"), nodes)
    links = [(at[r[0]], at[r[1]], r[2]) for r in collect_small(known, size * 40)]
    dims = len(next(iter(have.values()), np.zeros(1)))
    m = np.stack([have.get(t, np.zeros(dims)) for t in tags]) if tags else np.zeros((0, dims))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(n > 0, n, 1)
    words_of = [t.lower().split() for t in tags]
    penalty = -0.25 * np.log(3.0)
    sent = spark.sparkContext.broadcast((tags, m, links, words_of))  # linear in the tags and edges, both of a checked size

    def run(batches):
        tags, m, links, words_of = sent.value
        spread = Spread(len(tags), links, p)
        single: dict[str, list[int]] = {}
        for i, ws in enumerate(words_of):
            for w in ws:
                single.setdefault(w, []).append(i)
        for b in batches:
            ids, names, descs, vecs = (c.to_pylist() for c in b.columns)
            rows = [i for i, v in enumerate(vecs) if v is not None and len(v) == m.shape[1] and tags]
            out = [([], [], [], []) for _ in ids]
            for lo in range(0, len(rows), 1024):
                part = rows[lo : lo + 1024]
                score = p.gamma * (np.array([vecs[i] for i in part]) @ m.T)
                for r, i in enumerate(part):
                    count: dict[str, int] = {}
                    for w in f"{names[i] or ''} {descs[i] or ''}".lower().split():
                        if w in single:
                            count[w] = count.get(w, 0) + 1
                    for w, tf in count.items():
                        for t in single[w]:
                            score[r, t] += (1 - p.gamma) * penalty * tf * 2.5 / (tf + 1.5)
                seeds = mmr(score, m, p.seeds, p.mmr)
                which, at = np.unique(seeds, return_inverse=True)
                final = spread.rows(which.tolist())[at.reshape(seeds.shape)].mean(1)
                best = (final.shape[1] - 1 - np.argsort(-final[:, ::-1], axis=1, kind="stable"))[:, : p.top]
                for r, i in enumerate(part):
                    found = [tags[t] for t in best[r]]
                    try:
                        chosen, new = chooser(names[i] or "", descs[i] or "", found, p.chosen)
                    except Exception:  # noqa: BLE001 - whatever a remote model does, the run goes on
                        chosen, new = found[: p.chosen], []
                    out[i] = ([tags[t] for t in seeds[r]], found, chosen[: p.chosen], new)
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], texts) for k in range(4))], ["id", "seeds", "candidates", "tags", "new_tags"])

    x = records.select("id", "dataset_name", "dataset_desc").join(vectors.select("id", "v"), "id", "left")
    return x.mapInArrow(run, "id string, seeds array<string>, candidates array<string>, tags array<string>, new_tags array<string>")


def missing_vectors(records: DataFrame, vectors: DataFrame, encoder: Encoder = hashing_encoder) -> DataFrame:
    """(id, embedding) of the records that have no vector (id, v): of the text "name. description", to be stored with the others."""
    text = F.concat(F.coalesce("dataset_name", F.lit("")), F.lit(". "), F.coalesce("dataset_desc", F.lit("")))
    return encoded(records.join(vectors.select("id"), "id", "left_anti").select("id", text.alias("text")), "id", "text", encoder)


def semantic(vectors: DataFrame, tag_vectors: DataFrame, top: int) -> DataFrame:
    """(id, tag, sem, rank): the ``top`` tags (tag, embedding; of a checked size) nearest to each record's vector (id, v); ties in the order of the alphabet.

    The best are taken where the cosines are made: pairs of all records and tags never leave their batch.
    """
    have = sorted((r[0], r[1]) for r in collect_small(tag_vectors.where("tag is not null and embedding is not null").select("tag", "embedding")))
    names = pa.array([t for t, _ in have], pa.string())
    m = np.array([v for _, v in have], np.float64).reshape(len(have), len(have[0][1]) if have else 0)
    m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    k = min(top, len(have))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows if k else 0, 1024):
                part = b.slice(lo, 1024)
                cos = np.array(part.column(1).to_pylist(), np.float64) @ m.T
                best = np.argsort(-cos.round(9), axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(cos)), k)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(cos, best, 1).ravel()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(cos)))], ["id", "tag", "sem", "rank"])

    return vectors.select("id", "v").mapInArrow(run, "id string, tag string, sem double, rank int")


def best_tags(records: DataFrame, vectors: DataFrame, tag_vectors: DataFrame, vocabulary: DataFrame, top: int, p: Tagging = TAGGING) -> DataFrame:
    """(id, tag, score, rank): the ``top`` tags of each record by semantic and lexical score together; ties in the order of the alphabet.

    A tag counts for a record if either score exists; the other is 0 then. Both are made and fused within a batch, with
    the vocabulary (tag) of a checked size at hand. Records without a vector have lexical scores only.
    """
    tags = sorted({r[0] for r in collect_small(vocabulary.where("tag is not null").select("tag").distinct())})
    have = {r[0]: r[1] for r in collect_small(tag_vectors.where("tag is not null and embedding is not null").select("tag", "embedding"))}
    dims = len(next(iter(have.values()), [0]))
    m = np.array([have.get(t, np.zeros(dims)) for t in tags], np.float64).reshape(len(tags), dims)
    m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    known = np.array([t in have for t in tags], bool)
    penalty = -0.25 * np.log(3.0)
    single: dict[str, list[tuple[int, int]]] = {}
    for i, t in enumerate(tags):
        own = t.lower().split()
        for w in dict.fromkeys(own):
            single.setdefault(w, []).append((i, own.count(w)))
    names = pa.array(tags, pa.string())

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows if tags else 0, 1024):
                part = b.slice(lo, 1024)
                texts, vecs = part.column(1).to_pylist(), part.column(2).to_pylist()
                with_vector = np.array([v is not None for v in vecs], bool)
                score = np.zeros((len(texts), len(tags)))
                if with_vector.any():
                    score[with_vector] = p.gamma * (np.array([v for v in vecs if v is not None]) @ m.T)
                there = with_vector[:, None] & known
                for r, text in enumerate(texts):
                    count: dict[str, int] = {}
                    for w in text.split():
                        if w in single:
                            count[w] = count.get(w, 0) + 1
                    for w, tf in count.items():
                        for t, q in single[w]:
                            score[r, t] += (1 - p.gamma) * penalty * q * tf * 2.5 / (tf + 1.5)
                            there[r, t] = True
                score = np.where(there, score.round(9), -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")[:, :top]
                value = np.take_along_axis(score, best, 1)
                row, at = np.nonzero(value > -np.inf)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), names.take(pa.array(best[row, at])), pa.array(value[row, at]), pa.array((at + 1).astype(np.int32))], ["id", "tag", "score", "rank"])

    text = F.lower(F.concat_ws(" ", F.coalesce("dataset_name", F.lit("")), F.coalesce("dataset_desc", F.lit(""))))
    x = records.select("id", text.alias("_t")).join(vectors.select("id", "v"), "id", "left")
    return x.select("id", "_t", "v").mapInArrow(run, "id string, tag string, score double, rank int")


def mean_vectors(tagged: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """(tag, embedding): each tag's vector as the mean of those (id, v) of the records (id, tag) that have it, of length 1. No model is asked."""
    x = tagged.select("id", "tag").distinct().join(vectors, "id")
    sums = x.groupBy("tag").agg(*(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dimensions)))
    return sums.select("tag", unit(F.array(*(F.col(f"s{i}") for i in range(dimensions)))).alias("embedding"))


def untagged(records: DataFrame) -> DataFrame:
    """(id): records without tags: none stored, an empty list, or only an empty text."""
    return records.where("tags is null or size(filter(tags, t -> t is not null)) = 0 or array_contains(tags, '')").select("id")


def tagged(records: DataFrame) -> DataFrame:
    """(id): records with a stored tag."""
    return records.where("size(filter(tags, t -> t is not null)) > 0").select("id").distinct()


def indexed_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """(idx, tag_id, tag_name, tag_count): a dense index from 0 in the order of tag_id.

    Ranks are counted per range and shifted by the sizes of the ranges before, so no single task sorts the table.
    """
    x = vocabulary.where("tag_id is not null").select("tag_id", "tag_name", F.coalesce("tag_count", F.lit(0)).alias("tag_count")).withColumn("_b", F.shiftright("tag_id", 16))
    sizes = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_o"))  # one row per 65,536 ids
    return x.join(F.broadcast(before), "_b").select((F.row_number().over(W.partitionBy("_b").orderBy("tag_id", "tag_name")) - 1 + F.col("_o")).cast("bigint").alias("idx"), "tag_id", "tag_name", "tag_count")


def upsert_vocabulary(vocabulary: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """The vocabulary with the counts (tag, n): known tags get theirs, new ones the next ids in the order of their names."""
    top = F.broadcast(vocabulary.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("_top")))  # one row
    old = vocabulary.join(counts.select(F.col("tag").alias("tag_name"), "n"), "tag_name", "left").select("tag_id", "tag_name", F.coalesce("n", "tag_count").cast("int").alias("tag_count"), "created_at")
    new = counts.join(vocabulary.select(F.col("tag_name").alias("tag")), "tag", "left_anti").groupBy("tag").agg(F.max("n").alias("n"))
    # ranks in the order of names, counted per initial letters and shifted by the sizes of those before: no single task sorts them all
    new = new.withColumn("_b", F.substring("tag", 1, 2))
    sizes = new.groupBy("_b").agg(F.count(F.lit(1)).alias("_s"))
    before = sizes.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_o"))  # one row per two letters
    new = new.join(before, "_b").withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("tag")) + F.col("_o")).join(top, F.lit(True))
    return old.unionByName(new.select((F.col("_top") + F.col("_r")).cast("int").alias("tag_id"), F.col("tag").alias("tag_name"), F.col("n").cast("int").alias("tag_count"), now.alias("created_at")))


def new_tags(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tag): tags (tag) the vocabulary doesn't hold."""
    return found.select("tag").where("tag is not null and tag != ''").distinct().join(vocabulary.select(F.col("tag_name").alias("tag")), "tag", "left_anti")


def write_tags(records: DataFrame, results: DataFrame) -> DataFrame:
    """The records with their new tags (id, tags) where there is a result, an empty list too."""
    new = results.select("id", F.col("tags").alias("_new"))
    return records.join(new, "id", "left").select(*(F.coalesce("_new", "tags").alias("tags") if c == "tags" else F.col(c) for c in records.columns))


def selection_prompt(name: Column, desc: Column, found: Column, p: Tagging = TAGGING) -> Column:
    """Text that asks a language model to pick a record's tags from its candidates; long descriptions are cut."""
    return F.concat(
        F.lit(f"Pick the {p.chosen} tags that best name the topic of this dataset. Prefer the candidates; if none fits, propose a general term.\nAnswer with JSON only: {{\"tags\": [...], \"new_tags\": [...]}}\n\nName: "),
        F.coalesce(name, F.lit("")), F.lit("\nDescription: "), F.left(F.coalesce(desc, F.lit("")), F.lit(p.prompt_chars)), F.lit("\nCandidates: "), F.array_join(found, ", "),
    )


def generation_prompt(name: Column, desc: Column, count: int = 2, p: Tagging = TAGGING) -> Column:
    """Text that asks a language model for tags without candidates."""
    return F.concat(F.lit(f'Propose {count} general topic tags for this dataset.\nAnswer with JSON only: {{"tags": [...]}}\n\nName: '), F.coalesce(name, F.lit("")), F.lit("\nDescription: "), F.left(F.coalesce(desc, F.lit("")), F.lit(p.prompt_chars)))


def validation_prompt(name: Column, desc: Column, tags: Column, p: Tagging = TAGGING) -> Column:
    """Text that asks a language model to check tags."""
    return F.concat(
        F.lit('Say which tags fit this dataset, and replace the others.\nAnswer with JSON only: {"valid_tags": [...], "invalid_tags": [...], "suggested_replacements": {...}}\n\nName: '),
        F.coalesce(name, F.lit("")), F.lit("\nDescription: "), F.left(F.coalesce(desc, F.lit("")), F.lit(p.prompt_chars)), F.lit("\nTags: "), F.array_join(tags, ", "),
    )
