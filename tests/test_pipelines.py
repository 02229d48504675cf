import json

import pytest
from pyspark.sql import functions as F

from shelfmark import plugins, session
from shelfmark.operators import monitor, tags
from shelfmark.params import Monitor, Tagging
from shelfmark.plans import pipelines
from shelfmark.sources import sinks


def now(day="2026-01-01"):
    return F.lit(day).cast("timestamp_ntz")


@pytest.fixture
def stores(spark, tmp_path):
    s = pipelines.Stores(spark, str(tmp_path))
    rows = [(f"d{i}", f"Sea ice survey {i}", f"Sea ice and lava near place {i}. Machine learning of ice.", f"https://a.example/{i}", "a.example", None) for i in range(6)]
    rows += [("x1", "Lava", "Lava only.", "https://b.example/1", "b.example", ["old"]), ("x2", "Lava", None, "https://b.example/1/", "b.example", None), ("x3", None, None, None, None, None)]
    r = spark.createDataFrame(rows, "id string, dataset_name string, dataset_desc string, dataset_url string, source string, tags array<string>")
    s.append("seda_dataset", r.withColumn("harvested_at", F.lit("2025-01-01").cast("timestamp_ntz")))
    s.append("source_status", spark.createDataFrame([("a.example", 1), ("b.example", None)], "ext_host_name string, application_visibility int"))
    s.append("seda_source", spark.createDataFrame([("a", "a.example", 6, 2), ("b", "b.example", 2, 2)], "id string, site_name string, n bigint, fail_streak int"))
    return s


def test_monitoring(stores, spark):
    def dead(urls):
        return plugins.recorded_probe(urls).withColumn("head_status", F.when(F.col("url").contains("a.example"), F.array(F.lit(200))).otherwise(F.array(F.lit(404))))

    got = {r.site: r for r in pipelines.monitor_run(stores, now(), dead, Monitor(api_sites=(), browser_sites=())).collect()}
    assert got["a.example"].status == monitor.PASS and got["b.example"].newly_hidden and got["b.example"].fail_streak == 3
    assert stores.read("link_detect").count() == 2
    snap = {r.site_name: r for r in stores.read("seda_source").collect()}
    assert snap["b.example"].is_hidden == 1 and snap["a.example"].fail_streak == 0 and snap["a.example"].id == "a"
    assert {r.id for r in stores.read("seda_dataset").where("application_visibility = 0").collect()} == {"x1", "x2"}
    again = pipelines.monitor_run(stores, now("2026-01-02"), dead).where("newly_hidden").count()
    assert again == 0 and stores.read("link_detect").count() == 4


def test_linkage(stores):
    mapped = {r.id: r.canonical_id for r in pipelines.dedup_run(stores).collect()}
    assert mapped["x2"] == "x1" and mapped["d3"] == "d3"
    assert {r.id: r.canonical_id for r in stores.read("seda_dataset").collect()} == mapped


def test_tagging(stores):
    with pytest.raises(ValueError):
        pipelines.tag_run(stores, "other", now())
    with pytest.raises(ValueError):
        pipelines.tag_run(stores, pipelines.INCREMENTAL, now())
    stores.append("seda_dataset_vectors", plugins.encoded(stores.read("seda_dataset").select("id", "dataset_name"), "id", "dataset_name"))
    p = Tagging(min_frequency=1, edge=0.01)
    pipelines.tag_run(stores, pipelines.INITIAL, now(), p=p)
    words = {r.tag_name: r for r in stores.read("tag_vocabulary").collect()}
    assert words["lava"].tag_count == 8 and words["sea"].tag_count == 6 and "machine learning" in words
    edges = stores.read("tag_cooccurrence").collect()
    assert edges and {e.tag_id_1 for e in edges} <= {w.tag_id for w in words.values()} and stores.read("tag_vectors").count() >= len(words) - 1
    now_tagged = {r.id: r.tags for r in stores.read("seda_dataset").collect()}
    assert all(len(now_tagged[f"d{i}"]) == 2 for i in range(6))
    # new records come without tags and vectors; the model proposes a new tag
    stores.append("seda_dataset", stores.read("seda_dataset").where("id = 'd0'").withColumns({"id": F.lit("n1"), "tags": F.lit(None).cast("array<string>")}))
    ask = plugins.asking(lambda prompt: json.dumps({"tags": ["lava", "ice", "sea"], "new_tags": ["brand new"]}) if "Sea ice survey" in prompt else "no json")
    done = {r.id: r.tags for r in pipelines.tag_run(stores, pipelines.INCREMENTAL, now(), chooser=ask, p=p).collect()}
    assert done["n1"] == ["lava", "ice"] and "d0" not in done and len(done["x3"]) in (0, 2)
    assert stores.read("tag_vocabulary").where("tag_name = 'brand new'").first().tag_count == 0
    assert stores.read("seda_dataset_vectors").where("id = 'n1'").count() == 1


def test_the_chooser_reads_json(spark):
    say = lambda answer: plugins.asking(lambda _: answer)("n", "d", ["a", "b", "c"], 2)
    assert say('{"tags": ["b", "c", "a"], "new_tags": []}') == (["b", "c"], []) and say("{}") == ([], [])
    for bad in ("", "[]", '{"tags": "b"}', '{"tags": [1]}'):
        with pytest.raises(Exception):  # noqa: B017
            say(bad)
    row = spark.range(1).select(tags.selection_prompt(F.lit("N"), F.lit("d" * 900), F.array(F.lit("x"), F.lit("y")))).first()[0]
    assert row == plugins.selection_text("N", "d" * 900, ["x", "y"], 2, 500)


def test_shared_folder_and_stores(spark, tmp_path):
    x = session.stored(spark.range(5))
    assert x.count() == 5
    done, seen = session.cut_counting(spark.range(7), n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert seen == {"n": 7, "odd": 3} and done.count() == 7
    assert len(session.collect_small(spark.range(3), 3)) == 3
    with pytest.raises(ValueError):
        session.collect_small(spark.range(4), 3)
    path = str(tmp_path / "t")
    assert sinks.replace(spark.range(2), path) and sinks.replace(spark.range(3), path) and spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)
