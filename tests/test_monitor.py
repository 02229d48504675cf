import datetime as dt

from pyspark.sql import functions as F

from shelfmark import plugins
from shelfmark.operators import monitor
from shelfmark.params import Monitor

NOW = dt.datetime(2026, 1, 1)
STATE = "site string, n bigint, delta_n bigint, sig2 double, fail_streak int, is_hidden int, last_hidden_date timestamp_ntz"


def day(i):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=i)


def test_allocation(spark):
    rows = [("big", 10000, 10, 0.1, 0, 0, None), ("none", 0, 0, 0.0, 0, 0, None), ("small", 30, 0, 0.0, 0, 0, None), ("hidden", 5, 0, 0.0, 4, 1, NOW), ("shrinks", 100, -90, 0.0, 0, 0, None)]
    got = {r.site: r for r in monitor.allocate(spark.createDataFrame(rows, STATE)).collect()}
    assert got["none"].k == 1 and got["hidden"].k == 20 and got["small"].k == 11 and got["shrinks"].k == 20
    assert got["shrinks"].weight < 0 and got["big"].k == 200
    alone = monitor.allocate(spark.createDataFrame(rows[1:2], STATE)).collect()
    assert alone[0].k == 1
    assert monitor.allocate(spark.createDataFrame([], STATE)).collect() == []


def test_liveness(spark):
    rows = [
        ("https://a.example/x", [200], None, None, None, True), ("https://a.example/x", [404], 200, None, None, False), ("https://a.example/x", [None, 301], None, None, None, True),
        ("https://a.example/x", [None, None], 200, None, None, True), ("https://a.example/x", None, None, None, None, False), ("", [200], None, None, None, False), (None, [200], None, None, None, False),
        ("https://api.example/o/n", [200], None, 200, None, True), ("https://api.example/o/n", [301], None, 200, None, False), ("https://api.example/o/n", [200], None, 404, None, False),
        ("https://x.web.example/o", [404], None, None, "Title", True), ("https://web.example/o", [200], None, None, "  ", False), ("https://web.example:80/o", [200], None, None, None, True),
    ]
    p = Monitor(api_sites=("api.example",), browser_sites=("web.example",))
    x = spark.createDataFrame(rows, f"url string, {plugins.PROBE}, want boolean").withColumn("got", monitor.alive(F.col("url"), p))
    assert [r.got for r in x.collect()] == [r[-1] for r in rows]


def test_streaks_hide_and_stay_hidden(spark):
    marks = "PFFPFFFP"
    rows = [("s", day(i), f"h{i}", 0.5 + i / 100, monitor.PASS if m == "P" else monitor.FAIL) for i, m in enumerate(marks)] + [("t", day(0), "x", None, None), (None, day(0), "y", 1.0, monitor.PASS)]
    h = spark.createDataFrame(rows + rows[:2], "ext_host_name string, detect_date timestamp_ntz, id string, link_rate double, status string")
    got = {r.id: r for r in monitor.streaks(h).collect()}
    assert [got[f"h{i}"].fail_streak for i in range(8)] == [0, 1, 2, 0, 1, 2, 3, 0]
    assert [got[f"h{i}"].is_hidden for i in range(8)] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert got["h7"].first_hidden == day(6) and got["x"].fail_streak == 1 and got["h0"].var5 == 0.0 and len(got) == 9


def test_streaks_over_periods_equal_a_pass_over_the_whole(spark):
    import random
    import statistics

    rng = random.Random(2)
    rows = []
    for site in "ab":
        at = dt.datetime(2024, 1, 1)
        for i in range(120):
            at += dt.timedelta(days=rng.choice((0, 1, 9, 40)))
            rows.append((site, at, f"h{i:03}" if rng.random() < 0.9 else None, rng.choice((None, 0.5, 0.9, 1.0, i / 1000)), rng.choice((monitor.PASS, monitor.FAIL, monitor.FAIL))))
    want = {}
    for site in "ab":
        streak, first, rates = 0, None, []
        for r in sorted({r for r in rows if r[0] == site}, key=lambda r: (r[1], r[2] or "", -1 if r[3] is None else r[3])):
            streak = 0 if r[4] == monitor.PASS else streak + 1
            first = first or (r[1] if streak >= 3 else None)
            rates.append(r[3])
            five = [x for x in rates[-5:] if x is not None]
            want[r[:4]] = (streak, first, round(statistics.variance(five), 9) if len(five) > 1 else 0.0)
    h = spark.createDataFrame(rows, "ext_host_name string, detect_date timestamp_ntz, id string, link_rate double, status string")
    for period in ("month", "day", "year"):
        got = monitor.streaks(h, Monitor(period=period)).collect()
        by = sorted((r.site, r.detect_date, r.id or "", r.fail_streak, r.first_hidden, round(r.var5, 9)) for r in got)
        assert by == sorted((k[0], k[1], k[2] or "", *x) for k, x in want.items())
    assert monitor.streaks(h.limit(0)).collect() == []


def test_policies_and_probes(spark):
    calls = []

    def transport(method, url, seconds):
        calls.append((method, url))
        if method == "HEAD" and "slow" in url:
            raise OSError
        return {"HEAD": 200, "GET": 301 if "slow" in url else 404, "RENDER": " T "}[method]

    p = Monitor(api_sites=("api.example",), browser_sites=("web.example",))
    own = (*monitor.policies(p), monitor.Policy("anything goes", "own", ("any.example",), lambda url: F.lit(True)))
    urls = spark.createDataFrame([("https://a.example/x",), ("https://slow.example/x",), ("https://api.example/o/n",), ("https://web.example/y",), ("https://any.example/404",), (None,), ("",)], "url string")
    asked = plugins.probing(monitor.policy(F.col("url"), p, own), F.concat(F.col("url"), F.lit("/second")), transport)(urls).withColumn("alive", monitor.alive(F.col("url"), p, own))
    got = {r.url: r for r in asked.collect()}
    assert got["https://slow.example/x"].head_status == [None, None] and got["https://slow.example/x"].get_status == 301 and got["https://slow.example/x"].alive
    assert got["https://api.example/o/n"].secondary_status == 404 and not got["https://api.example/o/n"].alive and got["https://web.example/y"].title == " T "
    assert got["https://any.example/404"].alive and got["https://a.example/x"].alive and not got[None].alive and not got[""].alive


def test_purge_keeps_ties(spark):
    rows = [("s", day(i)) for i in range(12)] + [("s", day(2)), ("t", day(0)), (None, day(0)), ("s", None)]
    kept = monitor.purge(spark.createDataFrame(rows, "ext_host_name string, detect_date timestamp_ntz")).collect()
    assert len(kept) == 14 and min(r[1] for r in kept if r[0] == "s" and r[1]) == day(2)


def test_round_and_upsert(spark):
    state = spark.createDataFrame([("a", 10, 0, 0.0, 2, 0, None), ("b", 10, 0, 0.0, 1, 1, day(1)), ("c", 5, 5, 0.0, 0, 0, None)], STATE)
    probes = spark.createDataFrame([("a", False), ("b", True), ("b", True)], "site string, alive boolean")
    history = spark.createDataFrame([("b", day(i), f"{i}", 0.8) for i in range(6)], "ext_host_name string, detect_date timestamp_ntz, id string, link_rate double")
    now = F.lit(NOW).cast("timestamp_ntz")
    result = monitor.monitoring_round(monitor.allocate(state), probes, history, now)
    got = {r.site: r for r in result.collect()}
    assert got["a"].fail_streak == 3 and got["a"].is_hidden == 1 and got["a"].newly_hidden and got["a"].last_hidden_date == NOW
    assert got["b"].alive_rate == 1.0 and got["b"].is_hidden == 1 and not got["b"].newly_hidden and got["b"].alive_var == 0.008
    assert got["c"].alive_rate == 0.0 and got["c"].status == monitor.FAIL and got["c"].link_num == 0
    from shelfmark.sources.tables import empty

    source = empty(spark, "seda_source")
    first = monitor.upsert_snapshot(source, result, now)
    assert first.count() == 3 and all(len(r.id) == 32 and r.last_n == r.n for r in first.collect())
    rows = monitor.history_rows(result, now).collect()
    import uuid

    assert {r.id for r in rows} == {uuid.uuid5(uuid.NAMESPACE_DNS, f"{s}-1767225600.0").hex for s in "abc"}


def test_sample_is_exact(spark):
    r = spark.createDataFrame([(f"{i}", "S.example ", f"http://s.example/{i}", "n") for i in range(30)] + [("x", "t.example", "", "n"), ("y", None, "http://q", "n")], "id string, source string, dataset_url string, dataset_name string")
    plan = spark.createDataFrame([("s.example", 7), ("t.example", 3)], "site string, k bigint")
    one, two = (sorted(x.url for x in monitor.sample(r, plan).collect()) for _ in range(2))
    assert len(one) == 7 and one == two


def test_hide(spark):
    r = spark.createDataFrame([("1", "a", 1), ("2", "b", None), ("3", None, 1)], "id string, source string, application_visibility int")
    got = {x.id: (x.application_visibility, x.traceability) for x in monitor.hide(r, spark.createDataFrame([("a",)], "site string")).collect()}
    assert got == {"1": (0, "untraceable"), "2": (None, None), "3": (1, None)}


def test_windowed_rates_in_a_stream(spark, tmp_path):
    from shelfmark.streaming.rates import windowed_rates

    p = spark.createDataFrame([("a", day(0), True), ("a", day(0), False), ("a", day(9), True)], "site string, ts timestamp, alive boolean")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_rates(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.link_num, r.rate) for r in spark.table("rates").collect()] == [(2, 0.5)]
