import re
import uuid
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import hashing, text, urls, vector

URLS = [
    "https://Data.A.example:8080/Path/x/?q=1#f", "http://u:p@A.example/a;p=1;q", "HTTP://A.example", "A.example/Path/", "//A.example/b/", "ftp://h/a;type=i/", "", None,
    " http://a.example/x y", "http://[bad", "mailto:x@y", "https://a.example/a/b///", "gopher://h/a;b", "a\tb://c",
]


def canonical(u):
    if not u:
        return ""
    try:
        p = urlparse(u)
        return p.netloc.lower() + p.path.rstrip("/")
    except ValueError:
        return u.strip().lower().rstrip("/")


def test_urls_match_the_standard_parser(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", urls.canonicalize_url(F.col("u")).alias("c"), urls.host_of(F.col("u")).alias("h")).collect()
    for r in rows:
        assert r.c == canonical(r.u), r.u
        try:
            assert r.h == (urlparse(r.u).netloc.lower() if r.u else ""), r.u
        except ValueError:
            assert r.h == ""


@pytest.mark.parametrize(
    "name, want",
    [(None, ""), ("  ImageNet <b>x</b> ", "imagenet x"), ("a__b--c", "a b c"), ("mnistv2", "mnist"), ("foo v1.2", "foo v1.2"), ("Foo  Bar v3", "foo bar"), ("a \tb", "a b"), ("x v2<i>", "x")],
)
def test_normalize_name(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(text.normalize_name(F.col("n"))).first()[0] == want


def test_page_key_tells_pages_apart(spark):
    same = ["https://A.example/c%61t/view?id=1", "http://a.example:80/cat/view/?id=1&utm_source=x#top", " https://a.example:443//cat/view/index.html?id=1 "]
    other = ["https://a.example/cat/view?id=2", "https://mirror.a.example/cat/view?id=1", "https://a.example/Cat/view?id=1"]
    none = ["", None, "about:blank", "#", "https://", "N/A", "https://a.example/"]
    key = {u: k for u, k in spark.createDataFrame([(u,) for u in same + other + none], "u string").select("u", urls.page_key(F.col("u"))).collect()}
    assert {key[u] for u in same} == {"a.example/cat/view?id=1"}
    assert len({key[u] for u in other} | {key[same[0]]}) == 4
    assert all(key[u] is None for u in none)


def simhash_of(t):
    import hashlib

    if not t:
        return 0
    votes = [0] * 64
    for w in re.findall(r"\w+", t.lower()):
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    f = sum(1 << i for i in range(64) if votes[i] >= 0)
    return f - (1 << 64) if f >= 1 << 63 else f


def test_simhash_and_bands(spark):
    texts = ["", None, "...", "one", "one one two", "tie tied", "Données é ü 数据 集", "x" * 5000 + " long " * 2000]
    got = dict(hashing.simhash(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect())
    assert got == {i: simhash_of(t) for i, t in enumerate(texts)}
    bands = spark.range(1).select(hashing.band_keys(F.lit(-1).cast("bigint"))).first()[0]
    assert bands == [f"band{i}:255" for i in range(8)]


def test_uuid5(spark):
    names = ["site-1.0", "数据-2", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(hashing.uuid5_hex(F.col("n"))).collect()]
    assert got == [uuid.uuid5(uuid.NAMESPACE_DNS, n).hex for n in names]


def test_vectors(spark):
    x = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0])], "id int, v array<double>")
    ok = {r[0]: r[1] for r in x.select("id", vector.usable(F.col("v"), 2)).collect()}
    assert ok == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert x.where("id = 1").select(F.round(vector.cosine(F.col("v"), F.array(F.lit(4.0), F.lit(3.0))), 6)).first()[0] == 0.96
    assert x.where("id = 1").select(vector.sub_bucket(F.array(F.lit(-0.0015)))).first()[0] == 49


def test_fillers_tell_nothing(spark):
    values = ["", " ", None, "N/A", "<p> - </p>", "暂无", "?", "https://", "real", "无标题数据"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.informative(F.col("v"))).collect()]
    assert got == [False] * 8 + [True, True]
