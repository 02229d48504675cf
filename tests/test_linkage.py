import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.operators import blocking, dedup
from shelfmark.operators.components import components
from shelfmark.params import Dedup

SCHEMA = "id string, dataset_name string, dataset_desc string, dataset_url string, source string"


def closure(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components_equal_a_model(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(90)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("z", "z"), (None, "q")]
    want = closure([p for p in pairs if p[0] and p[0] != p[1]])
    assert dict(components(spark.createDataFrame(pairs, "src string, dst string")).collect()) == want
    assert components(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_exact_matching_picks_and_merges(spark):
    rows = [
        ("a", "Set v2", "", "http://x.example/1", "s"), ("b", "set", "long description", None, ""), ("c", "o", None, "https://X.example/1/", "s"),
        ("d", None, None, None, None), ("e", "", "", "", ""), ("f", "solo", "x", "y", "z"),
    ]
    r = spark.createDataFrame(rows, SCHEMA)
    links = dedup.explicit_links(dedup.normalized(r))
    assert {(x.kind, x.src, x.dst) for x in links.collect()} == {("name", "a", "b"), ("url", "a", "c")}
    mapped = dedup.mapping(r, links)
    got = dict(mapped.collect())
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
    merged = {x.id: x for x in dedup.merged(r, mapped).collect()}
    assert merged["a"].dataset_desc == "long description" and merged["a"].members == 3 and merged["d"].dataset_name is None
    assert dedup.mapping(r.limit(0), links.limit(0)).collect() == []


def test_equal_completeness_goes_to_the_smallest_id(spark):
    r = spark.createDataFrame([("b", "xx", "", "", ""), ("a", "yy", "", "", "")], SCHEMA)
    g = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, component string")
    assert dedup.canonical_of(r, g).collect()[0]["canonical_id"] == "a"


def test_write_back_and_chain(spark):
    old = spark.createDataFrame([("a", None), ("b", "x")], "id string, canonical_id string")
    new = spark.createDataFrame([("a", "b"), ("n", "n")], "id string, canonical_id string")
    assert dict(dedup.write_back(old, new).select("id", "canonical_id").collect()) == {"a": "b", "b": "x", "n": "n"}
    further = spark.createDataFrame([("b", "c")], "id string, canonical_id string")
    assert dict(dedup.chained(new, further).collect()) == {"a": "c", "n": "n"}


def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch):
    monkeypatch.setattr(blocking, "TILE", 8)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    v = np.repeat(base, 5, axis=0) + rng.normal(size=(60, 16)) * 0.15
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [f"r{i:02}" for i in range(60)]
    want = closure([(ids[i], ids[j]) for i in range(60) for j in range(i) if v[i] @ v[j] >= 0.82])
    buckets = spark.createDataFrame([("k", i) for i in ids] + [("l", "r00"), ("l", "gone")], "bucket string, id string")
    vectors = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v)], "id string, v array<double>")
    links = blocking.verified_links(buckets, vectors)
    assert dict(components(links).collect()) == want
    assert links.count() < 300


def test_tables_find_what_all_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(blocking, "TILE", 16)
    rng = np.random.default_rng(6)
    n = 240
    v = np.repeat(rng.normal(size=(n // 6, 16)), 6, axis=0) + rng.normal(size=(n, 16)) * 0.12
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1] = v[0]
    fp = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)]
    fp[1] = fp[0]
    for i in range(0, n, 3):
        fp[i + 2] = (fp[i] & 0xFF) | (fp[i + 2] & ~0xFF)
    sig = [int(x) for x in rng.integers(0, 40, n)]
    sig[1] = sig[0]
    ids = [f"r{i:03}" for i in range(n)]
    share = lambda a, b: any((a >> k) & 255 == (b >> k) & 255 for k in range(0, 64, 8))
    want = closure([(ids[i], ids[j]) for i in range(n) for j in range(i) if v[i] @ v[j] >= 0.82 and (sig[i] == sig[j] or share(fp[i], fp[j]))])
    marks = spark.createDataFrame([(i, [float(x) for x in row], f, s) for i, row, f, s in zip(ids, v, fp, sig)], "id string, v array<double>, simhash bigint, signature int")
    links = blocking.similar_links(marks, Dedup(met=16, recall=0.999))
    assert dict(components(links).collect()) == want and len(want) > 60
    assert blocking.similar_links(marks.limit(0)).collect() == []
    one, two = blocking.tables_for(1_000), blocking.tables_for(1_000_000)
    assert two[0] == one[0] + 10 and one[1] < two[1] < 10 * one[1]


def test_nearest_bucket_mates(spark):
    v = {"a": [1.0, 0.0], "b": [0.99, 0.14], "c": [0.9, 0.436], "d": [0.0, 1.0], "e": [1.0, 0.0]}
    b = spark.createDataFrame([("k", i) for i in "abcd"] + [("l", "a"), ("l", "e"), ("m", "gone")], "bucket string, id string")
    x = spark.createDataFrame(list(v.items()), "id string, v array<double>")
    got = {(r.bucket, r.id, r.other) for r in blocking.nearest_mates(b, x, Dedup(in_bucket=2)).collect()}
    assert got == {("k", "a", "b"), ("k", "b", "a"), ("k", "c", "b"), ("l", "a", "e"), ("l", "e", "a")}


def test_oversized_buckets_split(spark):
    p = Dedup(bucket=3)
    b = spark.createDataFrame([("k", f"r{i}") for i in range(5)] + [("s", "r0")], "bucket string, id string")
    v = spark.createDataFrame([(f"r{i}", [i / 1000 + 0.0005] * 2) for i in range(4)], "id string, v array<double>")
    got = {(r.bucket, r.id): r["sub"] for r in blocking.split_oversized(b, v, p).collect()}
    assert got == {("k", "r0"): 2, ("k", "r1"): 4, ("k", "r2"): 6, ("k", "r3"): 8, ("s", "r0"): 0}


def test_projection_signatures(spark):
    t = spark.createDataFrame([("a", "red green blue"), ("b", "blue red green"), ("c", "something else entirely"), ("d", None), ("e", "x y")], "id string, text string")
    got = dict(blocking.lsh_signatures(t).collect())
    assert got["a"] == got["b"] != got["c"] and got["d"] == got["e"] == 65535
    w = blocking.tfidf(t).groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("w")), 9)).collect()
    assert {r[1] for r in w} == {1.0}


def marks_of(spark, n, size, noise, seed):
    """(table of marks, pairs of bucket mates that agree): groups of vectors, some loose ones, one dense clump, few fingerprints."""
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.normal(size=(n // size, 16)), size, axis=0) + rng.normal(size=(n, 16)) * noise
    v[: n // 10] = v[0] + rng.normal(size=(n // 10, 16)) * 0.02
    v[-n // 10 :] = rng.normal(size=(n // 10, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    fp = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)]
    for i in range(0, n, 3):
        fp[i] = (fp[i] & ~0xFF) | 7
    sig, ids = [int(x) for x in rng.integers(0, 30, n)], [f"r{(i * 7919) % 99991:05}" for i in range(n)]
    share = lambda a, b: any((a >> k) & 255 == (b >> k) & 255 for k in range(0, 64, 8))
    pairs = [(ids[i], ids[j]) for i, j in np.argwhere(np.tril(v @ v.T >= 0.82, -1)) if sig[i] == sig[j] or share(fp[i], fp[j])]
    return spark.createDataFrame([(i, [float(x) for x in row], f, s) for i, row, f, s in zip(ids, v, fp, sig)], "id string, v array<double>, simhash bigint, signature int"), pairs


def test_cells_find_all_that_agree(spark, monkeypatch):
    monkeypatch.setattr(blocking, "CELL_TILE", 16)
    marks, pairs = marks_of(spark, 600, 8, 0.3, 4)
    want = closure(pairs)
    assert len(want) > 150 and dict(components(blocking.exact_links(marks)).collect()) == want
    monkeypatch.setattr(blocking, "CENTRES", 20)  # fewer centres than groups: wide cells, no pair less
    assert dict(components(blocking.exact_links(marks)).collect()) == want
    assert blocking.exact_links(marks.limit(0)).collect() == []


def test_bucket_links_send_a_vector_to_few_cells(spark, monkeypatch):
    monkeypatch.setattr(blocking, "TILE", 64)
    marks, pairs = marks_of(spark, 1200, 6, 0.1, 5)
    sent, repartition = [], type(marks).repartition
    monkeypatch.setattr(type(marks), "repartition", lambda x, *keys: sent.append(x) or repartition(x, *keys))
    monkeypatch.setattr(dedup, "fingerprinted", lambda *_: marks, raising=False)
    monkeypatch.setattr(dedup, "simhash_buckets", lambda *_: marks.select(F.explode(blocking.band_keys(F.col("simhash"))).alias("bucket"), "id"), raising=False)
    monkeypatch.setattr(dedup, "lsh_buckets", lambda *_: marks.select(F.concat(F.lit("lsh:"), F.col("signature").cast("string")).alias("bucket"), "id"), raising=False)
    none = spark.createDataFrame([], "id string, text string")
    assert dict(components(dedup.bucket_links(none, marks.select("id", "v"))).collect()) == closure(pairs)
    assert len(sent) == 1 and sent[0].count() < 3 * marks.count()


def test_words_are_marked_in_one_pass(spark):
    rng = random.Random(2)
    pool = ["red", "green", "blue", "x", "ÉCOLE", "数据", "a_b", "42", "7", "e\u0301t"]
    rows = [(f"r{i:02}", " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(60)] + [("s", None), ("t", ""), ("u", "--"), ("v", "x 7")]
    texts = spark.createDataFrame(rows, "id string, text string")
    vectors = spark.createDataFrame([(i, [1.0, 0.5]) for i, _ in rows[5:]] + [("gone", [1.0, 1.0])], "id string, v array<float>")
    for p in (Dedup(), Dedup(max_features=4)):
        want = {r.id: (r.simhash, r.signature) for r in blocking.simhash(texts, "id", "text").join(blocking.lsh_signatures(texts, p), "id").collect()}
        got = {r.id: (r.simhash, r.signature, r.v) for r in blocking.fingerprinted(texts, vectors, p).collect()}
        assert got == {i: (*want[i], [1.0, 0.5]) for i, _ in rows[5:]} and want["s"][0] == 0 and want["u"][0] == -1
