import numpy as np
from pyspark.sql import functions as F

from shelfmark import plugins
from shelfmark.operators import tags
from shelfmark.params import Tagging
from shelfmark.plans import tagging
from shelfmark.sources import readers, sinks

SCHEMA = "id string, dataset_name string, dataset_desc string"


def test_terms(spark):
    rows = [("a", "Deep data", "data model data model éanment x1 the the"), ("b", "title title", None), ("c", None, "go go ok_ok ok_ok web web"), ("d", "t", "")]
    got = {}
    for r in tags.candidate_terms(spark.createDataFrame(rows, SCHEMA)).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.term, r.tf, r.first_pos))
    assert got == {"a": [("data", 3, 2), ("model", 2, 4), ("the", 2, 7)], "c": [("web", 2, 1)]}


def test_phrases(spark):
    t = "Image\nclassification and natural language; machine learning model. anti-image processing xmachine learning"
    got = spark.createDataFrame([(t,)], "t string").select(tags.phrases(F.col("t")), tags.phrases(F.lit(None))).first()
    assert got[0] == ["image\nclassification", "image processing", "natural language", "machine learning", "xmachine learning"]
    assert got[1] == []
    many = " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[i]}a analysis" for i in range(25))
    assert len(spark.range(1).select(tags.phrases(F.lit(many))).first()[0]) == 20


def test_graph(spark):
    r = spark.createDataFrame([("1", "start of art", ""), ("2", "art", "music"), ("3", None, None)], SCHEMA)
    v = spark.createDataFrame([("art",), ("music",), ("none",), (None,)], "tag string").where("tag is not null")
    assert dict(tags.document_frequency(r, v).collect()) == {"art": 2, "music": 1, "none": 0}
    e = tags.cooccurrence_edges(r, v).collect()
    assert [(x.tag_1, x.tag_2, x.n12, round(x.weight, 6)) for x in e] == [("art", "music", 1, 0.707107)]
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0), ("a", "x", 9.0)], "src string, dst string, weight double")
    m = tags.adjacency(edges, nodes)
    assert {(x.src, x.dst): round(x.p, 4) for x in m.collect()} == {("a", "b"): 1.0, ("b", "a"): 0.5, ("b", "c"): 0.5, ("c", "b"): 1.0}
    assert tags.adjacency(edges.limit(0), nodes).collect() == []


def test_pagerank_equals_the_matrix_form(spark):
    p = Tagging(iterations=6)
    edges = [("a", "b", 0.7), ("a", "c", 0.3), ("b", "a", 1.0), ("c", "a", 1.0)]
    m = spark.createDataFrame(edges, "src string, dst string, p double")
    seeds = spark.createDataFrame([(1, "a"), (1, "zz"), (2, "b")], "id int, node string")
    got = {(r.id, r.node): r.score for r in tags.pagerank(m, seeds, p).collect()}
    at = {n: i for i, n in enumerate("abc")}
    spread = tags.diffusion(3, [(at[s], at[d], w) for s, d, w in edges], p)
    for n, i in at.items():
        assert abs(got[(1, n)] - spread[0, i] / 2) < 1e-12 and abs(got[(2, n)] - spread[1, i]) < 1e-12
    assert abs(got[(1, "zz")] - 0.5 * p.restart) < 1e-12


def greedy(scores, like, k, balance):
    left, out = list(range(len(scores))), []
    while left and len(out) < k:
        value = lambda t: scores[t] if not out else balance * scores[t] - (1 - balance) * max(0.0, *(like[t][s] for s in out))
        best = max(left, key=lambda t: (value(t), -t))
        out.append(best)
        left.remove(best)
    return out


def test_mmr_equals_a_greedy_model():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(15, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    scores = rng.normal(size=(20, 15)).round(1)
    got = tags.mmr(scores, v, 5, 0.5)
    assert [list(g) for g in got] == [greedy(s, v @ v.T, 5, 0.5) for s in scores]
    assert tags.mmr(scores[:1, :3], np.eye(3), 5, 0.5).shape == (1, 3)


def test_okapi_of_one_text(spark):
    r = spark.createDataFrame([("1", "Sea ice", "ice, ice ICE"), ("2", None, None)], SCHEMA)
    v = spark.createDataFrame([("sea ice",), ("lava",)], "tag string")
    want = -0.25 * np.log(3) * (1 * 2.5 / 2.5 + 3 * 2.5 / 4.5)
    got = tags.lexical(r, v).collect()
    assert [(x.id, x.tag) for x in got] == [("1", "sea ice")] and abs(got[0].lex - -0.25 * np.log(3) * (1 + 3 * 2.5 / 4.5)) < 1e-9 or abs(got[0].lex - want) < 1e-9
    one = r.select("id", tags.bm25_single(F.concat_ws(" ", "dataset_name", "dataset_desc"), F.lit("sea ice")).alias("s")).collect()
    assert abs(one[0].s - got[0].lex) < 1e-9 and one[1].s == 0
    top = tags.lexical(r, v, "corpus").collect()
    assert [x.lex for x in top] == [1.0]


def test_synonyms_lead_in_order():
    v = [("bb", np.array([1.0, 0])), ("aaa", np.array([1.0, 0.01])), ("c", np.array([0, 1.0])), ("none", None), ("zero", np.zeros(2))]
    assert tags.synonyms(v) == {"aaa": "bb", "bb": "bb", "c": "c", "none": "none", "zero": "zero"}
    assert tags.synonyms([]) == {}


def test_tagging_end_to_end(spark):
    r = spark.createDataFrame([("1", "sea ice", "sea"), ("2", "lava", None), ("3", "no vector", "")], SCHEMA)
    v = plugins.encoded(spark.createDataFrame([("1", "sea ice"), ("2", "lava flow")], "id string, t string"), "id", "t").select("id", F.col("embedding").cast("array<double>").alias("v"))
    vocabulary = spark.createDataFrame([("sea ice",), ("lava flow",), ("rain",)], "tag string")
    edges = spark.createDataFrame([("sea ice", "rain", 1.0)], "tag_1 string, tag_2 string, weight double")
    vec = plugins.encoded(vocabulary, "tag", "tag")
    got = {x.id: x for x in tags.tag_records(r, v, vocabulary, vec, edges, p=Tagging(seeds=1)).collect()}
    assert got["2"].seeds == ["lava flow"] and got["2"].tags[0] == "lava flow" and got["3"].tags == [] and len(got["1"].tags) == 2

    def broken(*_):
        raise RuntimeError

    again = {x.id: x.tags for x in tags.tag_records(r, v, vocabulary, vec, edges, broken, Tagging(seeds=1)).collect()}
    assert again == {k: x.tags for k, x in got.items()}
    assert tags.tag_records(r, v, vocabulary.limit(0), vec.limit(0), edges.limit(0)).where("size(tags) > 0").count() == 0


def test_incremental_mode_makes_missing_vectors(spark, data):
    need = {r.id for r in tagging.untagged_records(spark, data).collect()}
    made = {r.id: r.embedding for r in tagging.missing_vectors(spark, data).collect()}
    stored = {r.id for r in tagging._vectors(spark, data).collect()}
    assert set(made) == need - stored and made
    got = {r.id: r.tags for r in tagging.incremental_tags(spark, data).collect()}
    assert set(got) == need and all(got.values())
    text = {r.id: f"{r.dataset_name or ''}. {r.dataset_desc or ''}" for r in tagging._texts(spark, data).collect()}
    assert all(np.allclose(v, plugins.hashing_encoder([text[i]])[0], atol=1e-6) for i, v in made.items())


def test_initial_mode_builds_vocabulary_and_graph(spark, data):
    texts = [f"{r.dataset_name or ''} {r.dataset_desc or ''}".lower() for r in tagging._texts(spark, data).collect()]
    stored = {r.tag for r in tagging._vocabulary(spark, data).collect()}
    edges = tagging.cooccurrence_edges(spark, data).collect()
    has = {t: {i for i, x in enumerate(texts) if t in x} for t in stored}
    want = {(a, b): len(has[a] & has[b]) for a in stored for b in stored if a < b and has[a] & has[b] and len(has[a] & has[b]) / (len(has[a]) * len(has[b])) ** 0.5 >= 0.1}
    assert {(e.tag_1, e.tag_2): e.n12 for e in edges} == want
    seed = {r.tag for r in tagging.seed_vocabulary(spark, data).collect()}
    rows = tagging.final_tags(spark, data).collect()
    used = {t for r in rows for t in r.candidates}
    assert len(rows) == len(texts) and used and used <= seed and not used <= stored


def test_every_record_is_ranked_from_its_tags(spark):
    v = spark.createDataFrame([(3, "Sea Ice"), (70, "lava"), (90, "rain")], "tag_id int, tag_name string")
    r = spark.createDataFrame([("a", ["sea-ice;LAVA"]), ("b", ["rain", "x"]), ("c", ["lava", "sea ice"]), ("d", None)], "id string, tags array<string>")
    nodes = v.select(F.col("tag_id").alias("node"))
    m = tags.adjacency(spark.createDataFrame([(3, 90, 1.0), (70, 90, 2.0)], "src int, dst int, weight double"), nodes)
    seeds = tags.known_tags(r, v)
    assert sorted(map(tuple, seeds.collect())) == [("a", 3), ("a", 70), ("b", 90), ("c", 3), ("c", 70)]
    got = {(x.id, x.node): x.score for x in tags.record_ranks(m, nodes, seeds).collect()}
    want = {(x.id, x.node): x.score for x in tags.pagerank(m, seeds).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert tags.record_ranks(m, nodes, seeds, top=1).count() == 3
    few = tags.Spread(3, [(0, 2, 1.0), (1, 2, 1.0), (2, 0, 0.5), (2, 1, 0.5)], remembered=3)
    assert np.allclose(few.rows([2, 0, 2]), tags.diffusion(3, [(0, 2, 1.0), (1, 2, 1.0), (2, 0, 0.5), (2, 1, 0.5)])[[2, 0, 2]]) and few.rows([]).shape == (0, 3)


def test_best_tags_equal_a_join_of_both_scores(spark):
    rng = np.random.default_rng(3)
    names = ["sea ice", "lava", "rain", "rain rain", "no vector"]
    r = spark.createDataFrame([("1", "Sea ice", "ice and rain rain"), ("2", "lava", None), ("3", None, "no"), ("4", None, None)], SCHEMA)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in ("1", "2", "4")], "id string, v array<double>")
    t = spark.createDataFrame([(n, [float(x) for x in rng.normal(size=4)]) for n in names[:-1]], "tag string, embedding array<double>")
    voc = spark.createDataFrame([(n,) for n in names] + [(None,)], "tag string")
    got = {(x.id, x.tag): x.score for x in tags.best_tags(r, v, t, voc, 99).collect()}
    sem, lex = tags.semantic(v, t, 99), tags.lexical(r, voc)
    want = {(x.id, x.tag): x.s for x in sem.join(lex, ["id", "tag"], "full_outer").select("id", "tag", tags.fused(F.col("sem"), F.col("lex")).alias("s")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want) and ("3", "no vector") in got
    top = tags.best_tags(r, v, t, voc, 2).collect()
    assert max(x.rank for x in top) == 2 and all(x.score >= sorted((s for (i, _), s in got.items() if i == x.id), reverse=True)[:2][-1] - 1e-9 for x in top)
    assert tags.semantic(v, t.limit(0), 5).collect() == [] and tags.best_tags(r, v, t, voc.limit(0), 5).collect() == []
    mean = {x.tag: x.embedding for x in tags.mean_vectors(spark.createDataFrame([("1", "a"), ("1", "a"), ("3", "b")], "id string, tag string"), v, 4).collect()}
    assert set(mean) == {"a"} and abs(sum(x * x for x in mean["a"]) - 1) < 1e-6


def test_vocabulary_and_sets(spark):
    v = spark.createDataFrame([(7, "b", None), (70000, "c", 2), (3, "a", 1)], "tag_id int, tag_name string, tag_count int").withColumn("created_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    assert [(r.idx, r.tag_id, r.tag_count) for r in tags.indexed_vocabulary(v).orderBy("idx").collect()] == [(0, 3, 1), (1, 7, 0), (2, 70000, 2)]
    counts = spark.createDataFrame([("a", 9), ("z", 1), ("y", 2)], "tag string, n int")
    up = {r.tag_name: (r.tag_id, r.tag_count) for r in tags.upsert_vocabulary(v, counts, F.lit("2026-01-01").cast("timestamp_ntz")).collect()}
    assert up == {"a": (3, 9), "b": (7, None), "c": (70000, 2), "y": (70001, 2), "z": (70002, 1)}
    assert [r.tag for r in tags.new_tags(counts, v).orderBy("tag").collect()] == ["y", "z"]
    r = spark.createDataFrame([("1", ["a"]), ("2", []), ("3", None), ("4", [""]), ("5", [None])], "id string, tags array<string>")
    assert sorted(x.id for x in tags.untagged(r).collect()) == ["2", "3", "4", "5"]
    assert sorted(x.id for x in tags.tagged(r).collect()) == ["1", "4"]
    new = spark.createDataFrame([("1", []), ("3", ["q"])], "id string, tags array<string>")
    assert dict(tags.write_tags(r, new).collect()) == {"1": [], "2": [], "3": ["q"], "4": [""], "5": [None]}


def test_prompts(spark):
    got = spark.range(1).select(tags.selection_prompt(F.lit("N"), F.lit("d" * 900), F.array(F.lit("x"), F.lit("y"))), tags.generation_prompt(F.lit(None), F.lit(None)), tags.validation_prompt(F.lit("N"), F.lit(""), F.array(F.lit("x")))).first()
    assert "d" * 500 + "\nCandidates: x, y" in got[0] and "d" * 501 not in got[0] and "Name: \n" in got[1] and got[2].endswith("Tags: x")


def test_stores(spark, tmp_path):
    path = str(tmp_path / "edges")
    assert sinks.read_or_empty(spark, path, "tag_cooccurrence").count() == 0
    e = spark.createDataFrame([(1, 2, 0.5)], "tag_id_1 int, tag_id_2 int, weight float")
    sinks.append(e, path)
    sinks.append(e, path)
    assert sinks.read_or_empty(spark, path).count() == 2
    assert sinks.replace(sinks.read_or_empty(spark, path).distinct(), path) and spark.read.parquet(path).count() == 1
    assert not sinks.replace(e.limit(0), path, keep_if_empty=True) and spark.read.parquet(path).count() == 1
    (tmp_path / "d.json").write_text('{"id": "", "_id": "k1", "dataset_name": "n"}\n{"id": "7", "_id": "k2"}\n')
    x = readers.catalogue(spark, str(tmp_path / "d.json"), "json")
    assert sorted(r.id for r in x.collect()) == ["7", "k1"]
    assert readers.by_ids(x, spark.createDataFrame([("7",), ("7",), (None,)], "id string")).count() == 1 and readers.seed(x, 1).first().id == "7"


def test_ranks_of_records_are_neither_shuffled_nor_broadcast(spark):
    v = spark.createDataFrame([(i, f"tag {i}") for i in range(40)], "tag_id int, tag_name string")
    r = spark.createDataFrame([(f"r{i:02}", [f"tag {i % 40}", f"tag {i * 7 % 40}"]) for i in range(60)], "id string, tags array<string>")
    nodes, seeds = v.select(F.col("tag_id").alias("node")), tags.known_tags(r, v)
    m = tags.adjacency(spark.createDataFrame([(i, (i * 3 + 1) % 40, 1.0 + i % 5) for i in range(40)], "src int, dst int, weight double"), nodes)
    got = tags.record_ranks(m, nodes, seeds)
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Join" not in plan[: plan.index("MapInArrow")]
    want = {(x.id, x.node): x.score for x in tags.pagerank(m, seeds).collect() if x.score > 0}
    assert {(x.id, x.node) for x in rows} == set(want) and all(abs(x.score - want[x.id, x.node]) < 1e-9 for x in rows)
    best = {}
    for x in sorted(rows, key=lambda x: (x.id, x.rank)):
        best.setdefault(x.id, []).append((-round(x.score, 9), -x.node))
    assert all(b == sorted(b) for b in best.values())
    few = {(x.id, x.node, x.rank) for x in tags.record_ranks(m, nodes, seeds, top=3).collect()}
    assert few == {(x.id, x.node, x.rank) for x in rows if x.rank <= 3}
