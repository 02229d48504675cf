import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import cooccurrence, distinctive, groups, neighbours, packing, survivors


# --- 1
def near_model(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -np.inf)
    return {ids[i]: {ids[j] for j in np.lexsort((np.arange(len(ids)), -cos[i].round(12)))[:k]} for i in range(len(ids))}


def frame(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "id string, embedding array<float>")


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (np.repeat(centres, 40, axis=0) + rng.normal(size=(1200, 16)) * 0.3).astype(np.float32)
    ids = [f"v{i:04}" for i in range(1200)]
    s = neighbours.Settings(dimensions=16, row_cell=60, region=300, codebooks=4, entries=32)
    near = neighbours.neighbours(frame(spark, ids, x), 10, s).cache()
    want, have = near_model(ids, x.astype(float), 10), {}
    for r in near.collect():
        have.setdefault(r.id, set()).add(r.other)
        assert r.id != r.other
    assert sum(len(want[i] & have[i]) for i in ids) / 12000 > 0.9
    assert neighbours.recall(near, frame(spark, ids, x), 10, 3, s) > 0.9
    p = neighbours.pairs(near)
    assert p.where("id_1 >= id_2").count() == 0 and p.count() == p.distinct().count()


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    one, rest = rng.normal(size=8), rng.normal(size=(6, 8))
    rows = [(f"c{i:02}", [float(v) for v in one], "x") for i in range(40)] + [(f"d{i}", [float(v) for v in r], "x") for i, r in enumerate(rest)]
    bad = [("n1", None, "x"), ("n2", [1.0] * 7, "x"), ("n3", [0.0] * 8, "x"), ("n4", [float("nan")] + [1.0] * 7, "x"), ("n5", [float("inf")] + [1.0] * 7, "x"), (None, [1.0] * 8, "x"), ("n6", [None] + [1.0] * 7, "x")]
    v = spark.createDataFrame(rows + bad + rows[:3], "id string, embedding array<float>, key string")
    got = {}
    for r in neighbours.neighbours(v, 3, neighbours.Settings(dimensions=8)).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got["c39"] == {"c00", "c01", "c02"} and got["c01"] == {"c00", "c02", "c03"} and set(got) == {r[0] for r in rows}
    assert all(len(x) == 3 for x in got.values())
    assert neighbours.neighbours(v.limit(0), 3).collect() == []
    few = {(r.id, r.other) for r in neighbours.neighbours(v.where("id in ('d0', 'd1')"), 3, neighbours.Settings(dimensions=8)).collect()}
    assert few == {("d0", "d1"), ("d1", "d0")}


def test_neighbours_of_many_rows_and_few_samples(spark):
    """Many small groups and a dense clump of few dimensions, of which the sample tells little: recall doesn't fall as they grow."""
    rng = np.random.default_rng(7)
    groups = np.repeat(rng.normal(size=(200, 24)), 20, axis=0) + rng.normal(size=(4000, 24)) * 0.25
    clump = rng.normal(size=24) * 2 + rng.normal(size=(4000, 5)) @ rng.normal(size=(5, 24)) * 0.3
    x = np.concatenate([groups, clump]).astype(np.float32)
    ids = [f"v{i:04}" for i in range(8000)]
    s = neighbours.Settings(dimensions=24, sample=200, row_cell=50, most_cells=8, region=1000, codebooks=2, entries=16, cell_best=40, rerank=80)
    want, have = near_model(ids, x.astype(float), 10), {}
    for r in neighbours.neighbours(frame(spark, ids, x), 10, s).collect():
        have.setdefault(r.id, set()).add(r.other)
    share = lambda own: sum(len(want[i] & have.get(i, set())) for i in own) / (10 * len(own))
    assert share(ids[:4000]) > 0.9 and share(ids[4000:]) > 0.9


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    s = neighbours.Settings(dimensions=12, codebooks=3, entries=16)
    wide = neighbours.Books.train(x, 8, s)
    narrow = neighbours.Books(wide.books, 1)
    error = lambda b: float(((x - b.sums(b.encode(x))) ** 2).sum())
    assert error(wide) <= error(narrow) < float((x**2).sum())


# --- 2
def test_consensus_votes_and_damage():
    t = survivors.tokens
    values = [(t("alpha beta gamma delta"), 2.0), (t("alpha beta gam"), 1.0), (t("alpha bXta gamma delta"), 0.5)]
    agreed = survivors.consensus(values)
    assert agreed == ["alpha", "beta", "gamma", "delta"]
    v = lambda x, f="dataset_name": survivors.verdict(x, agreed, f)
    assert v("Alpha beta_gamma delta") == (False, 0)
    assert v("Alpha beta gam")[0] and v("Alpha beta")[0] and v("Alpha beta gamma...")[0] and v("Alph� beta gamma delta") == (True, 0)
    assert v("Alpha bÃ©ta gamma delta")[0] and not v("Other words here entirely")[0]
    assert survivors.verdict("One. Two", ["one", "two"], "dataset_desc")[0] and not survivors.verdict("One. Two.", ["one", "two"], "dataset_desc")[0]
    # descriptions: cut after a sentence that the others go on from; whole without a final sign where all agree; a note one copy adds cuts nobody off
    whole, short, noted = "One two three. Four five six.", "One two three.", "One two three. Four five six. Seen in week eight."
    said = lambda *v: survivors.agreement([(t(x), float(v.count(x)), v.count(x)) for x in dict.fromkeys(v)])
    d = lambda x, v: survivors.verdict(x, v[0], "dataset_desc", v[1])[0]
    assert d(short, said(whole, whole, short)) and not d(whole, said(whole, whole, short)) and d("One two three. Four fi", said(whole, whole, "One two three. Four fi"))
    assert not d("one two three", said("one two three", "One two three")) and d("One two thr", said("One two three.", "One two thr")) and d("One two. Three", said("One two.", "One two. Three"))
    assert not d(whole, said(whole, noted)) and not d(noted, said(whole, noted)) and not d("Other text.", said(whole, whole, "Other text."))
    assert survivors.consensus([]) == [] and survivors.verdict("", [], "source") == (False, 0)
    assert survivors.repaired("RÃ©sumÃ©") == "Résumé" and t("数据 集x") == ("数", "据", "集", "x")


SURVIVOR = "id string, canonical_id string, dataset_name string, dataset_desc string, dataset_url string, source string, harvested_at string, damaged int"


def test_survivors(spark, monkeypatch):
    rows = [
        ("a", "g", "Full name of it", "Short. Th", "https://", "Hidden.example", "2025-01-05", 1), ("b", "g", "Full name o", "Short. The rest.", "http://x/1", "open.example", "2025-01-09", 1),
        ("c", "g", "Full name of it", None, "http://x/2", "  ", "2025-01-02", 1), ("d", "g", "N/A", "Short. The rest.", "http://x/3", "unknown", "2025-01-09", 1),
        ("e", "h", "alone", "x.", "u", "s", "2025-01-01", 1), ("f", None, "x", "x.", "u", "s", "2025-01-01", 1), ("i", "k", "", None, "#", "-", None, 1), ("j", "k", " ", "nan", None, None, None, 1),
    ]
    r = spark.createDataFrame(rows, SURVIVOR).withColumn("harvested_at", F.col("harvested_at").cast("timestamp_ntz"))
    status = spark.createDataFrame([("HIDDEN.example", 0), ("open.example", 1), (None, 0)], "ext_host_name string, application_visibility int")
    for block in (survivors.BLOCK, 2):
        monkeypatch.setattr(survivors, "BLOCK", block)
        got = {(x.group, x.field): x.id for x in survivors.survivors(r, status).collect()}
        assert got == {("g", "dataset_name"): "c", ("g", "dataset_desc"): "b", ("g", "dataset_url"): "b", ("g", "source"): "b"}
    assert survivors.survivors(r.limit(0), status).collect() == []


# --- 4
def test_likelihood_ratio(spark):
    rows = [("a", "one One x", "one two_2 two, THREE's é three"), ("b", None, "two three"), ("c", "", None), ("d", "ab 12", "..."), ("e", "three", "long " * 3000)]
    r = spark.createDataFrame([(*x, "z") for x in rows], "id string, n string, d string, term string")
    got = {(x.id, x.term): x for x in distinctive.distinctive_terms(r, "n", "d").collect()}
    assert {k: v.tf for k, v in got.items()} == {("a", "one"): 3, ("a", "two"): 1, ("a", "three"): 2, ("b", "two"): 1, ("b", "three"): 1, ("e", "three"): 1, ("e", "long"): 3000}
    assert got[("a", "three")].df == 3

    def g2(k11, k12, k21, k22):
        n, out = k11 + k12 + k21 + k22, 0.0
        for k, row, col in ((k11, k11 + k12, k11 + k21), (k12, k11 + k12, k12 + k22), (k21, k21 + k22, k11 + k21), (k22, k21 + k22, k12 + k22)):
            out += k * np.log(k * n / (row * col)) if k else 0.0
        return 2 * out

    assert abs(got[("a", "one")].llr - g2(3, 3, 0, 3003)) < 1e-6 and got[("e", "three")].llr < 0
    two = {(x.id, x.term): round(x.llr, 6) for x in distinctive.distinctive_terms(r, "n", "d", min_tf=2).collect()}
    assert two == {k: round(got[k].llr, 6) for k in got if got[k].tf > 1}
    assert distinctive.distinctive_terms(r.limit(0), "n", "d").collect() == []


# --- 5
def test_groups_against_a_model(spark):
    rng = random.Random(7)
    ids = [f"id{i:03}" for i in range(150)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(110)] + [("id000", f"id{i:03}") for i in range(1, 60)] + [(f"id{i:03}", f"id{i + 1:03}") for i in range(100, 140)]
    rng.shuffle(pairs)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    e = spark.createDataFrame(pairs + [(None, "q"), ("s", "s")], "a string, b string")
    assert {r.id: r.group_id for r in groups.components(e).collect()} == {x: find(x) for x in root}
    assert groups.components(e.limit(0)).collect() == []


def test_which_pairs_link(spark):
    rows = [
        ("A1 ", "b2", None, "name"), ("b2", "c3", 0.82, "lsh"), ("c3", "d4", 0.81, "simhash"), ("d4", "e5", None, "lsh"), ("e5", "e5", 1.0, "url"), ("e5", "zz", 1.0, "url"),
        (None, "a1", 1.0, "url"), ("d4", "e5", float("nan"), "lsh"), ("b2", "a1", 0.1, "URL"),
    ]
    p = spark.createDataFrame(rows, "id_1 string, id_2 string, similarity double, stage string")
    known = spark.createDataFrame([(x,) for x in ("a1", "b2", "c3", "d4", "e5", "a1", None)], "id string")
    assert {tuple(r) for r in groups.linked_pairs(p, known).collect()} == {("a1", "b2"), ("b2", "c3")}


# --- 6
def test_pairs_of_items(spark):
    vocab = spark.createDataFrame([(1, "Sea Ice"), (2, "csv"), (3, "sea-ice"), (4, None), (5, "lava")], "tag_id int, tag_name string")
    rows = [("a", ["SEA_ice", "csv|lava", None]), ("b", ["sea  ice;csv", "csv"]), ("c", ["lava"]), ("d", ["unknown"]), ("e", []), ("f", None), ("g", ["csv, sea ice"])]
    b = cooccurrence.known_items(spark.createDataFrame(rows, "id string, tags array<string>"), vocab)
    assert {r.id: r["items"] for r in b.collect()} == {"a": [1, 2, 5], "b": [1, 2], "c": [5], "g": [1, 2]}
    got = {(r.item_1, r.item_2): r for r in cooccurrence.pair_statistics(b).collect()}
    assert {k: (r.n12, r.n1, r.n2, r.n) for k, r in got.items()} == {(1, 2): (3, 3, 3, 4), (1, 5): (1, 3, 2, 4), (2, 5): (1, 3, 2, 4)}
    assert got[(1, 2)].conviction is None and abs(got[(1, 5)].lift - 4 / 6) < 1e-9 and abs(got[(1, 5)].conviction - 0.5 / (2 / 3)) < 1e-9
    assert dict(cooccurrence.item_counts(b).collect()) == {1: 3, 2: 3, 5: 2}
    assert cooccurrence.pair_statistics(b.limit(0)).collect() == []


# --- 9
def decreasing(sizes, capacity):
    """Containers that first fit on falling sizes needs, which knows all sizes beforehand."""
    open_ = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, v in enumerate(open_) if v + s <= capacity), None)
        if at is None:
            open_.append(s)
        else:
            open_[at] += s
    return len(open_)


def test_packing_never_overfills(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 3, 50, 64, 65, 128, 200, rng.randrange(1, 64)]) for _ in range(3000)] + [None]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, tokens bigint, container_kind string")
    kinds = spark.createDataFrame([("s", 64), ("s", 32), ("w", 150), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens int")
    rows = packing.pack(items, kinds).collect()
    for name, capacity in (("s", 64), ("w", 150)):
        mine = [r for r in rows if r.container_kind == name]
        fill, per = {}, {}
        for r in mine:
            if r.container_id is not None:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            per.setdefault(r.doc_id, []).append((r.piece_no, r.tokens))
        assert max(fill.values()) <= capacity
        assert {d: sum(t for _, t in p) for d, p in per.items()} == {i: s or 0 for i, s in enumerate(sizes)}
        for d, p in per.items():
            assert len(p) == max(1, -(-(sizes[d] or 0) // capacity)) and [n for n, _ in sorted(p)] == list(range(len(p)))
        assert len(fill) <= 1.1 * decreasing([r.tokens for r in mine if r.tokens], capacity) + 2
    assert {r.container_kind for r in rows} == {"s", "w"}
    again = packing.pack(items.repartition(3), kinds).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert packing.pack(items.limit(0), kinds).collect() == [] and packing.pack(items, kinds.limit(0)).collect() == []


@pytest.mark.parametrize("capacity", [10, 37])
def test_sum_of_squares_follows_its_rule(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randrange(1, capacity + 1) for _ in range(300)]
    got = packing.sum_of_squares(sizes, capacity)
    levels, where = [], {}
    for s, c in zip(sizes, got):
        count = {}
        for v in levels:
            if 0 < v < capacity:
                count[v] = count.get(v, 0) + 1
        cost = lambda a: sum(v * v for v in ({**count, **a}).values())  # noqa: E731,B023
        options = {}
        for h in [0, *count]:
            if h + s <= capacity:
                after = {}
                if h:
                    after[h] = count[h] - 1
                if h + s < capacity:
                    after[h + s] = after.get(h + s, count.get(h + s, 0)) + 1
                options[h] = cost(after)
        level = levels[c] if c < len(levels) else 0
        assert options[level] == min(options.values())
        if c < len(levels):
            levels[c] += s
        else:
            assert c == len(levels)
            levels.append(s)
    assert max(levels) <= capacity and zlib.crc32(b"") == 0 and not where
