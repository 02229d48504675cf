import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import encode, incremental, language, subjects
from shelfmark.sources.tables import current, table

FILE = os.path.join(encode.TOKENIZERS, encode.VOCABULARY)


# --- 8
@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [None, "", " ", "a", "aaaaaaa aaaaaa", "<|endoftext|> plain", "\n\n  \t x  ", "it's don't I'LL", "数据集，说明。", "é̀ 🙂🙂 ‍", "=" * 5000, "x" * 3000, "word " * 4000, "１２３ ½ ²"]


def test_ids_equal_a_public_encoder(spark, reference):
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("abc ABC éü数\n.,'0123") for _ in range(rng.randrange(300))) for _ in range(200)]
    d = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode(d).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = dict(encode.token_counts(d).collect())
    assert n == {i: len(x) for i, x in got.items()}
    assert encode.encode(d.limit(0)).collect() == [] and encode.token_counts(d.limit(0)).collect() == []
    assert all(reference.decode(x) == (texts[i] or "") for i, x in got.items())


def test_forgetting_words_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 5)
    monkeypatch.setattr(encode, "AT_ONCE", 20)
    e = encode.Encoder(FILE)
    texts = ["one two three", "three four five six", None, "one six seven eight nine ten"] * 3
    out = []
    for part in encode.chunks(texts):
        ids, n = e(part)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert out == [reference.encode_ordinary(t) if t else [] for t in texts]


# --- 10
def test_labels(spark):
    said = {"EN": "en", "en_GB": "en", " English ": "en", "zh-CN": "zh", "中文": "zh", "deu": "de", "pt-BR": "pt", "日本語": "ja", "und": None, "": None, None: None, "??": None, "Italian": None}
    got = dict(spark.createDataFrame([(k,) for k in said], "l string").select("l", language.label_of(F.col("l"))).collect())
    assert got == said


def test_what_is_a_sentence():
    s = language.sentences
    assert s(None) == s("") == s("  \n") == s("Keywords: sea ice, lava") == s("sea ice; lava; rain; snow; csv.") == s("https://a.example/x.") == s("x_1 | 2.0 | 3.") == []
    assert s("<p>One small step is here.</p><p>Ein zweiter Satz steht hier. — Un autre est là !</p>") == ["One small step is here.", "Ein zweiter Satz steht hier.", "— Un autre est là !"]
    assert len(s("数据按物种分组存放。缺失的字段留空。")) == 2
    assert len(s("A b c d e f. " * 5000)) == 5000


def test_changes_of_language_cost(monkeypatch):
    monkeypatch.setattr(language, "SWITCH", 2.0)
    odds = np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1], [0.001, 0.999]]))
    assert language.decode(odds).tolist() == [0, 0, 0, 1]
    assert language.decode(odds[:1]).tolist() == [0]


def test_segments(spark, data):
    d = table(spark, data.replace("sf0.001", "sf0.01"), "documents")
    protos = language.prototypes(d.select("doc_id", "text", "lang"), per_language=60)
    en, de, zh = "Every record can be linked to its source through a shared key. ", "Fehlende Werte wurden nicht ergänzt, sondern als leer gekennzeichnet. ", "缺失的数值没有补齐，而是在另一列中注明。"
    rows = [(1, en * 2, "English"), (2, de, "en"), (3, en + de + en, "en"), (4, zh, None), (5, "Tags: a, b", None), (6, None, "en"), (7, "", "??"), (8, en * 2, "English"), (9, (en + de) * 3000, "de")]
    parts = language.segments(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), protos).cache()
    got = {}
    for r in language.mislabelled(parts).orderBy("doc_id", "segment_no").collect():
        got.setdefault(r.doc_id, []).append((r.segment_no, r.lang))
    assert len(got.pop(9)) == 6000
    assert got == {2: [(1, "de")], 3: [(1, "en"), (2, "de"), (3, "en")], 4: [(1, "zh")]}
    main = {r.doc_id: r for r in language.document_languages(parts).collect()}
    assert main[3].lang == "en" and main[3].languages == 2 and 0 < main[1].confidence <= 1 and set(main) == {1, 2, 3, 4, 8, 9}
    assert language.segments(d.limit(0).select("doc_id", "text", "lang"), protos).collect() == []
    # held out: documents the prototypes haven't seen, with a usable label
    held = language.segments(d.select("doc_id", "text", "lang"), protos).where("label is not null and segment_no = 1").agg(F.avg((F.col("label") == F.col("lang")).cast("int"))).first()[0]
    assert held > 0.85


def test_prototypes_without_labels(spark):
    d = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert not language.prototypes(d).any()


# --- 3
def test_tokens_of_records():
    t = subjects.tokens
    assert t(None, None, None) == t("", " ", []) == t(None, "", [None, "", ";"]) == []
    assert t("Sea <b>Ice</b>", "数据集 x", ["SEA_ice; csv"]) == ["数据", "据集", "sea", "ice", "t:sea", "t:ice", "#sea ice", "#csv"]
    assert "container" in t("cÃ¶ntainer container", None, None) and "cöntainer" in t("cÃ¶ntainer", None, None)


def test_held_out_subjects(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    r = current(table(spark, folder, "seda_dataset"), "id", "dataset_name", "dataset_desc", "tags")
    labels, areas = table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas")
    kept = "pmod(xxhash64(id, 9), 4) = 0"
    m = subjects.train(r, labels, areas, skip=kept)
    want = {tuple(x) for x in labels.where(kept).where("id is not null").distinct().collect()}
    got = {(x.id, x.subject_code) for x in subjects.score(r.join(labels.where(kept).select("id").distinct(), "id"), m).collect()}
    assert 2 * len(want & got) / (len(want) + len(got)) > 0.8
    odd = spark.createDataFrame([("a", None, None, None), ("b", "", "", []), ("c", "galaxy telescope catalogue", "orbit " * 30000, [None, "sky map"])], "id string, dataset_name string, dataset_desc string, tags array<string>")
    assert {x.id for x in subjects.score(odd, m).collect()} == {"c"}
    assert subjects.score(r.limit(0), m).collect() == []
    assert subjects.subjects(odd, labels.limit(0), areas).collect() == [] and subjects.subjects(odd, labels, areas.limit(0)).collect() == []


# --- 7
RAW = "id string, canonical_id string, dataset_name string, dataset_desc string, dataset_url string"
NEW = "batch_no int, id string, dataset_name string, dataset_desc string, dataset_url string, source string, arrived_at string"
DESC = "Two network surveys were merged, which doubled the coverage of 12 sites. Access is open, though the originals stay with the office. Columns describe position and time."


def history(spark, rows):
    return incremental.history_of(spark.createDataFrame(rows, RAW))


def batch(spark, rows):
    """Rows (batch_no, id, name, description, address)."""
    return incremental.batch_of(spark.createDataFrame([(*r, None, None) for r in rows], NEW))


def found_of(df):
    return {r.id: r.canonical_id for r in df.collect()}


NOTE = " Mirrored copy, last checked in week {}."
#: Three records and a copy of each with a note added: what shows that the note is an addition.
NOTED = [(f"m{i}{x}", None, f"Atlas number {w}", f"The {w} table lists stations. All of {w} is open." + (NOTE.format(i) if x else ""), None) for i, w in enumerate(("one", "two", "three")) for x in ("", "n")]


def test_recognising(spark):
    old = [("s1", "s0", "Network survey, Place 2001", DESC, "https://a.example/record/1"), ("s0", "s0", None, None, "http://a.example/record/1/"), ("s2", None, "Network survey, Place 2002", DESC, None), ("s3", None, "n/a", "-", "#"), *NOTED]
    new = [
        (1, "n1", "data", None, "http://A.example:80/record/1?utm_source=x#top"), (1, "n2", "NETWORK_survey,  place 2001", DESC.replace("Access is", "access are") + NOTE.format(4), None),
        (1, "n3", "Network survey, Place 2003", DESC, None), (1, "n4", "Network survey, Place 2001", "Quite another text about lava and basalt at the mere.", None), (1, "n5", None, DESC, None),
        (2, "n6", "network survey, place 2003", DESC, "https://b.example/x"), (2, "n7", None, None, "https://B.example/x/"), (2, "n3", "Network survey, Place 2003", DESC, None), (1, "n8", "", "", ""), (None, None, "x", "y", "z"),
        (3, "n9", "Network survey, Place 2001", DESC.replace("12", "13"), None), (1, "n2", "NETWORK_survey,  place 2001", DESC, None),
    ]
    h, b = history(spark, old), batch(spark, new)
    want = {"n1": "s0", "n2": "s0", "n6": "n3", "n7": "n3"}
    runs = incremental.open_runs(h)
    assert found_of(incremental.recognise(runs, b)) == want
    # batch by batch gives the same, with the accepted ones carried along; runs are compacted on the way
    runs, got = incremental.open_runs(h), {}
    for n in (1, 2, 3):
        got |= found_of(incremental.recognise(runs, b.where(F.col("batch") == n)))
    assert got == want and len(runs.names) < 4
    rows = runs.read().count()
    runs.compact(everything=True)
    assert len(runs.names) == 1 and 0 < runs.read().count() <= rows == sum(runs.sizes) + rows - runs.read().count()
    assert found_of(incremental.recognise(runs, batch(spark, [(4, "z1", "Network survey, Place 2003", DESC, None)]))) == {"z1": "n3"}
    assert found_of(incremental.recognise(incremental.open_runs(h), b.limit(0))) == {} == found_of(incremental.recognise_all(h, b.limit(0))[0])
    assert found_of(incremental.recognise(incremental.open_runs(h.limit(0)), b)) == {"n6": "n3", "n7": "n3"}
    assert found_of(incremental.recognise_all(h, b)[0]) == want


def test_extra_columns_with_clashing_names(spark):
    raw = spark.createDataFrame([("a", "A tale of stone", "Rocks and sand are listed here.", None, 1, "x", 2, "y")], "id string, dataset_name string, dataset_desc string, dataset_url string, n int, page string, batch int, phrase string").withColumn("canonical_id", F.lit(None).cast("string"))
    runs = incremental.open_runs(incremental.history_of(raw))
    assert found_of(incremental.recognise(runs, batch(spark, [(1, "b", "a TALE of stone", "rocks and sand are listed here", None)]))) == {"b": "a"}


def test_last_merge_leaves_its_upkeep_to_the_next(spark):
    """One query's last batch neither compacts its runs nor stores its records; the next batch does, and finds them."""
    runs = incremental.open_runs(history(spark, [("a", None, "A tale of stone", "Rocks and sand are listed here", None)]))
    new = batch(spark, [(1, "b", "Survey of old wells", "Depth and water of wells are told", None)])
    assert found_of(incremental.recognise(runs, new)) == {} and len(runs.names) == 2 and len(runs.accepted) == 1 and runs.rows == 2
    again = batch(spark, [(2, "c", "Survey of old wells", "Depth and water of wells are told", None), (2, "d", "A tale of stone", "Rocks and sand are listed here", None)])
    assert found_of(incremental.recognise(runs, again)) == {"c": "b", "d": "a"} and len(runs.accepted) == 2 and runs.rows == 4
    runs.settle()
    assert len(runs.names) == 1 and len(runs.accepted) == 3


def test_merges():
    class Rows(list):
        groupBy = count = orderBy = lambda self, *_: self
        collect = lambda self: self

    assert incremental.merges(Rows([(1, 3), (2, 3), (3, 9), (5, 1)]), 80) == [(1, 2), (3, 3), (5, 5)] and incremental.merges(Rows(), 5) == []


def test_what_is_an_addition(spark):
    said = spark.createDataFrame(NOTED + [(f"k{i}", None, f"Plot {i}", f"Trees of plot {i} are listed. Access is open.", None) for i in range(9)] + [("k", None, "Plot 1", "Trees of plot 1 are listed.", None)], RAW)
    assert [r[0] for r in incremental.additions(incremental.comparable(said)).collect()] == ["mirrored copy last checked in week #"]
    assert incremental.words_of(None, "x y. z") is None and incremental.words_of("N/A", "x") is None and incremental.words_of("x", "...") is None
    assert incremental.words_of("A b", "One. Two 3.")[:5] == ("a b", "one", "two 3", 1, 3) and incremental.words_of("A", "No end")[1:3] == ("no end", "")


def test_equal_texts_within_a_batch(spark):
    """Ids with equal final digits, and none, in one batch: the first by its text is the dataset."""
    new = [(1, "x7", "Wind of the coast", "Readings of wind at the pier.", None), (1, "y7", "Wind of the coast", "Readings of wind at the pier.", None), (1, "alpha", "Wind of the coast", "readings of WIND at the pier", None), (1, "q", "Other", "Something else is said here.", None)]
    assert found_of(incremental.recognise(incremental.open_runs(history(spark, []).limit(0)), batch(spark, new))) == {"x7": "alpha", "y7": "alpha"}


def test_one_key_two_texts(spark):
    """Title, opening and ending shared, years apart in the middle: each copy finds its own."""
    text = lambda y: "The long series of readings of all the stations along the coast of the north, " + f"as of {y}, " + "with every file open to everyone who wishes to use it in any work of theirs at all."
    h = history(spark, [("d1", None, "Coast", text(1990), None), ("d2", None, "Coast", text(1991), None)])
    assert found_of(incremental.recognise(incremental.open_runs(h), batch(spark, [(1, "c2", "coast", text(1991), None), (1, "c3", "coast", text(1992), None)]))) == {"c2": "d2"}


def test_key_ranges_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(incremental, "RANGE_ROWS", 12)
    rng = random.Random(4)
    nouns = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(40)]
    text = lambda: " ".join(rng.choice(nouns) for _ in range(30)) + "."
    old = [(f"h{i:03}", None, f"title {rng.choice(nouns)} {i}", text(), f"https://h.example/{i}") for i in range(120)]
    new = []
    for i, (_, _, t, d, u) in enumerate(old[:60]):
        words = d.split()
        del words[rng.randrange(5, 25)]
        new.append((1, f"n{i:03}", t.upper(), " ".join(words), None) if i % 2 else (1, f"n{i:03}", None, None, u))
    runs = incremental.open_runs(history(spark, old))
    assert sum(len(x) for x in runs.limits) > 10
    keyed = runs.read().select("kind", "key", F.col("range").alias("was"))
    for r in runs.at(keyed).collect():
        base = sum(len(x) + 1 for x in runs.limits[: r.kind])
        assert r.range == r.was == base + sum(c <= r.key for c in runs.limits[r.kind])
    assert found_of(incremental.recognise(runs, batch(spark, new))) == {f"n{i:03}": f"h{i:03}" for i in range(60)}


def test_other_texts_of_one_key_are_compared(spark):
    half = "The series holds monthly readings of wind and rain from all the stations along the northern coast"
    desc = lambda year: f"{half}, as of {year} only; {half[::-1]}."
    old = [(f"h{year}", None, "Coast readings", desc(year), None) for year in range(2001, 2031)]
    new = [(1, f"n{year}", "Coast-Readings", desc(year).upper(), None) for year in range(2001, 2036)] + [(2, "n9999", "coast readings", desc(2033), None)]
    runs = incremental.open_runs(history(spark, old))
    assert found_of(incremental.recognise(runs, batch(spark, new))) == {f"n{y}": f"h{y}" for y in range(2001, 2031)} | {"n9999": "n2033"}
    runs.compact(everything=True)
    again = [(3, "m1", "Coast readings", desc(2005), None), (3, "m2", "Coast readings", desc(2034), None)]
    assert found_of(incremental.recognise(runs, batch(spark, again))) == {"m1": "h2005", "m2": "n2034"}


def test_slips_in_titles_among_many_alike(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubdfgklmnprst") for _ in range(9))
    lead, tail = "This collection of monthly readings was brought together by the coastal office", "and every file may be used by everyone without asking anyone at all before"
    old = [(f"h{i:03}", None, f"Atlas of {word()}", f"{lead} {word()} {word()} {word()}, {tail}.", None) for i in range(100)]
    slip = lambda t: t[:12] + t[13:]
    new = [(1, f"n{i:03}", slip(t), d, None) for i, (_, _, t, d, _) in enumerate(old)] + [(1, f"m{i:03}", slip(t), d.replace("office ", "offices "), None) for i, (_, _, t, d, _) in enumerate(old[:20])]
    found = incremental.recognise(incremental.open_runs(history(spark, old)), batch(spark, new))
    assert found_of(found) == {f"n{i:03}": f"h{i:03}" for i in range(100)} | {f"m{i:03}": f"h{i:03}" for i in range(20)}


def test_digits_however_written():
    numbers = lambda t: incremental.words_of("title", t)[6]
    assert numbers("a1 b²c½ ⑩㎡ ３") == numbers("a 1 2 1 2 10 2 3") == numbers("3 2 10 m2 12 1") != numbers("a 1 2 1 2 10 2 4")


def test_small_edits_and_others():
    words = lambda t: " ".join(incremental.TOKEN.findall(incremental.plain(t)))
    t, d = (lambda f: lambda a, b: f(words(a), words(b)))(incremental.same_title), (lambda f: lambda a, b: f(words(a), words(b)))(incremental.same_description)
    assert t("Oxide-and  acid_Atlas 2001", "<b>oxide and acid atlas 2001</b>") and t("Ｏｘｉｄｅ atlas", "oxide atlas") and t("Jizibhom atlas", "Jizibholm atlas")
    assert not t("atlas of A 2001", "atlas of A 2002") and not t("Survey of Gokac", "Survey of Kanad") and not t("", "") and not t(None, "x")
    assert d(DESC, DESC.replace("originals", "orignials").lower()) and d(DESC, DESC.replace(" stay", ""))
    assert not d(DESC, DESC[:60]) and not d(DESC, DESC.replace("12", "14")) and not d("", "") and not d(None, None)
