"""Queries of dead-link monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import plugins
from shelfmark.operators import monitor
from shelfmark.plans import pipelines
from shelfmark.plans.common import CUR, registry, store_copy, strip
from shelfmark.sources.tables import current, table

QUERIES, ORACLES, query = registry()

#: The moment of the round the queries play.
NOW_SQL = "timestamp '2026-01-01 00:00:00'"


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


SITES = "act as (select distinct ext_host_name site from source_status where (application_visibility = 1 or application_visibility is null) and ext_host_name is not null)"
COUNTS = "cnt as (select site_name site, arg_max(n, (update_time, n)) n from seda_source where site_name <> '' and n is not null group by 1)"
RATES = "rt as (select distinct ext_host_name site, detect_date, id, link_rate from link_detect where ext_host_name is not null and detect_date is not null and link_rate is not null)"
RECENT = f"""{RATES}, rn as (select *, row_number() over (partition by site order by detect_date desc, id desc nulls last, link_rate desc) rn from rt),
rc as (select site, list(link_rate order by rn desc) rates, coalesce(var_samp(link_rate), 0) sig2 from rn where rn <= 5 group by 1)"""
STATE = f"""{SITES}, {COUNTS}, {RECENT},
snap as (select * exclude (k) from (select site_name site, last_n, fail_streak, is_hidden, last_hidden_date, row_number() over (partition by site_name order by update_time desc nulls last, last_n desc nulls last, fail_streak desc nulls last, is_hidden desc nulls last, last_hidden_date desc nulls last) k from seda_source where site_name is not null) where k = 1),
st as (select site, coalesce(n, 0) n, coalesce(n, 0) - coalesce(last_n, 0) delta_n, coalesce(sig2, 0) sig2, coalesce(fail_streak, 0) fail_streak, coalesce(is_hidden, 0) is_hidden, last_hidden_date
 from act left join cnt using (site) left join snap using (site) left join rc using (site))"""
PLAN = """wt as (select *, ln(1 + greatest(n, 0)) * (1 + 3.0 * sig2) * (1 + 5.0 * (delta_n / (greatest(n, 0) + 1e-6))) weight from st),
tw as (select sum(greatest(weight, 0)) w from wt),
al as (select wt.*, case when is_hidden = 1 then 20 else least(greatest(20, round_even(weight / case when w > 0 then w else 1 end * 2000, 0)::bigint), greatest(1, round_even(2.0 * sqrt(greatest(n, 0)), 0)::bigint)) end k from wt, tw)"""
SAMPLE = f"""us as (select lower({strip('source')}) site, dataset_url url, dataset_name name, id from cur where dataset_url <> ''),
rk as (select *, row_number() over (partition by site order by md5('round' || url), url, id) rn from us),
sm as (select al.site, url, name from rk join al on al.site = rk.site where rn <= k)"""


def _plan(spark, folder):
    t = lambda n: table(spark, folder, n)
    return monitor.allocate(monitor.site_state(t("source_status"), t("seda_source"), t("link_detect")))


def _sample(spark, folder):
    return monitor.sample(current(table(spark, folder, "seda_dataset"), "id", "source", "dataset_url", "dataset_name"), _plan(spark, folder))


def _round(spark, folder):
    probed = plugins.recorded_probe(_sample(spark, folder)).withColumn("alive", monitor.alive(F.col("url")))
    return monitor.monitoring_round(_plan(spark, folder), probed, table(spark, folder, "link_detect"), now())


@query(f"with {SITES} select site from act")
def active_sites(spark, folder):
    """Sites to be monitored."""
    return monitor.active_sites(table(spark, folder, "source_status"))


@query(f"with {COUNTS} select site, n from cnt")
def site_counts(spark, folder):
    """Sizes of the sites."""
    return monitor.site_counts(table(spark, folder, "seda_source"))


@query(f"with {RECENT} select site, rates, round(sig2, 6) sig2 from rc")
def recent_rates(spark, folder):
    """The last five rates of every site, oldest first, and their variance."""
    return monitor.recent_rates(table(spark, folder, "link_detect")).withColumn("sig2", F.round("sig2", 6))


@query(f"with {STATE} select site, n, delta_n, round(sig2, 6) sig2, fail_streak, is_hidden, last_hidden_date from st")
def site_state(spark, folder):
    """What a round starts from."""
    t = lambda n: table(spark, folder, n)
    return monitor.site_state(t("source_status"), t("seda_source"), t("link_detect")).withColumn("sig2", F.round("sig2", 6))


@query(f"with {STATE}, {PLAN} select site, round(weight, 4) weight from wt")
def site_weights(spark, folder):
    """Sampling weight of every site."""
    return _plan(spark, folder).select("site", F.round("weight", 4).alias("weight"))


@query(f"with {STATE}, {PLAN} select site, k::bigint k from al")
def allocation(spark, folder):
    """Samples of every site."""
    return _plan(spark, folder).select("site", "k")


@query(f"with {CUR}, {STATE}, {PLAN}, {SAMPLE} select site, url, name from sm")
def sampled_urls(spark, folder):
    """The addresses to probe: exactly k of each site."""
    return _sample(spark, folder)


PROBED = r"""pb as (select site, url, ('0x' || substr(md5(url), 1, 4))::int % 100 d, lower(regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)', 2)) host from sm),
pc as (select site, url, d, case when d < 80 then 200 when d < 84 then 301 when d < 90 then 404 when d < 93 then 200 when d < 97 then 200 end first_, d % 7 <> 0 sec, d < 92 title,
 case when regexp_matches(host, '(^|\.)data.quellmar.example$') then 'api' when regexp_matches(host, '(^|\.)portal.example$') then 'browser' else 'plain' end pol from pb),
lv as (select site, url, coalesce(case pol when 'api' then first_ = 200 and sec and len(string_split(regexp_replace(url, '/+$', ''), '/')) >= 2 when 'browser' then title else first_ in (200, 301, 302) end, false) alive from pc)"""


@query(f"with {CUR}, {STATE}, {PLAN}, {SAMPLE}, {PROBED} select site, url, alive from lv")
def liveness(spark, folder):
    """Whether each sampled address lives, by the policy of its site; outcomes by the stand-in prober."""
    return plugins.recorded_probe(_sample(spark, folder)).select("site", "url", monitor.alive(F.col("url")).alias("alive"))


@query("select user_id, strftime(ts, '%Y-%m-%d') as day, count(*)::bigint link_num, round_even(avg(case when event_type <> 'error' then 1.0 else 0.0 end), 4) rate, case when round_even(avg(case when event_type <> 'error' then 1.0 else 0.0 end), 4) >= 0.9 then '合格' else '不合格' end status from events group by 1, 2")
def event_rates(spark, folder):
    """Share of events without error per user and day, and its verdict."""
    e = table(spark, folder, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_type") != "error").alias("alive"))
    return monitor.alive_rates(e, "user_id", "day").withColumn("status", monitor.verdict(F.col("rate")))


STREAKS = """h as (select distinct ext_host_name site, detect_date, id, link_rate, case when status = '合格' then 0 else 1 end failed from link_detect where ext_host_name is not null and detect_date is not null),
g as (select *, sum(1 - failed) over (partition by site order by detect_date, id nulls first, link_rate nulls first rows unbounded preceding) g,
 coalesce(var_samp(link_rate) over (partition by site order by detect_date, id nulls first, link_rate nulls first rows between 4 preceding and current row), 0) var5 from h),
s as (select *, sum(failed) over (partition by site, g order by detect_date, id nulls first, link_rate nulls first rows unbounded preceding) fail_streak from g),
o as (select *, min(case when fail_streak >= 3 then detect_date end) over (partition by site order by detect_date, id nulls first, link_rate nulls first rows unbounded preceding) first_hidden from s)"""


@query(f"with {STREAKS} select site, detect_date, id, failed::int failed, fail_streak::bigint fail_streak, (first_hidden is not null)::int is_hidden, first_hidden, round(var5, 6) var5 from o")
def fail_streaks(spark, folder):
    """Failure streak, sticky hidden flag and moving variance after every detection."""
    return monitor.streaks(table(spark, folder, "link_detect")).withColumn("var5", F.round("var5", 6))


ROUND = f"""ms as (select site, count(*) link_num, round_even(avg(case when alive then 1.0 else 0.0 end), 4) rate from lv group by 1),
r0 as (select al.*, coalesce(link_num, 0)::int link_num, coalesce(rate, 0.0) alive_rate, coalesce(rates, []::double[]) old from al left join ms using (site) left join rc using (site)),
r1 as (select *, list_append(old, alive_rate::double)[-5:] five, case when alive_rate >= 0.9 then '合格' else '不合格' end status from r0),
r2 as (select * replace (case when status = '合格' then 0 else fail_streak + 1 end as fail_streak), is_hidden was from r1),
rd as (select site, n, k::bigint k, delta_n, link_num, alive_rate::double alive_rate, case when len(five) >= 2 then round_even(list_var_samp(five), 6) else 0.0 end alive_var, status, fail_streak::int fail_streak,
 case when was = 0 and fail_streak >= 3 then 1 else was end is_hidden, (was = 0 and fail_streak >= 3) newly_hidden, case when was = 0 and fail_streak >= 3 then {NOW_SQL} else last_hidden_date end last_hidden_date from r2)"""
ALL = f"{CUR}, {STATE}, {PLAN}, {SAMPLE}, {PROBED}, {ROUND}"


@query(f"with {ALL} select * from rd")
def monitoring_round(spark, folder):
    """One whole round: plan, sample, probe, rate, streak, hiding."""
    return _round(spark, folder)


@query(f"""with {ALL}, j as (select coalesce(s.site_name, rd.site) site_name, s.id sid, s.n sn, s.alive_rate sar, s.alive_var sav, s.last_n sln, s.delta_n sdn, s.status sst, s.last_detect_date sld, s.fail_streak sfs, s.is_hidden sih, s.last_hidden_date slh, s.create_time sct, s.update_time sut, rd.* from seda_source s full join rd on rd.site = s.site_name)
select site_name, case when site is not null then n else sn end n, case when site is not null then alive_rate else sar end alive_rate, case when site is not null then alive_var else sav end alive_var, case when site is not null then n else sln end last_n,
case when site is not null then delta_n else sdn end delta_n, case when site is not null then status else sst end status, case when site is not null then {NOW_SQL} else sld end last_detect_date, case when site is not null then fail_streak else sfs end fail_streak,
case when site is not null then is_hidden else sih end is_hidden, case when site is not null then last_hidden_date else slh end last_hidden_date, case when site is not null then coalesce(sct, {NOW_SQL}) else sct end create_time, case when site is not null then {NOW_SQL} else sut end update_time from j""")
def snapshot_upsert(spark, folder):
    """The site table after the round (ids left out: SQL has no version 5 UUID)."""
    return monitor.upsert_snapshot(table(spark, folder, "seda_source"), _round(spark, folder), now()).drop("id")


UUID5 = r"""substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 15)"""


@query(f"""with {ALL}, hs as (select *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(site || '-1767225600.0')) h from rd)
select {UUID5} id, site ext_host_name, link_num, alive_rate link_rate, status, {NOW_SQL} detect_date, {NOW_SQL} create_time, {NOW_SQL} update_time from hs""")
def history_append(spark, folder):
    """The round's rows for the history, with their name-based ids."""
    return monitor.history_rows(_round(spark, folder), now())


@query(f"""with {ALL}, u as (select ext_host_name, link_num, link_rate, status, detect_date from link_detect union all select site, link_num, alive_rate, status, {NOW_SQL} from rd),
c as (select ext_host_name h, min(detect_date) cut from (select *, row_number() over (partition by ext_host_name order by detect_date desc) rn from u where ext_host_name is not null and detect_date is not null) where rn <= 10 group by 1)
select u.* from u left join c on c.h = u.ext_host_name where cut is null or detect_date is null or detect_date >= cut""")
def round_history(spark, folder):
    """The stored history after a whole round with its writes."""
    stores = store_copy(spark, folder, "source_status", "seda_source", "link_detect", "seda_dataset")
    pipelines.monitor_run(stores, now())
    return stores.read("link_detect").select("ext_host_name", "link_num", "link_rate", "status", "detect_date")


@query("""with c as (select ext_host_name h, min(detect_date) cut from (select *, row_number() over (partition by ext_host_name order by detect_date desc) rn from link_detect where ext_host_name is not null and detect_date is not null) where rn <= 10 group by 1)
select l.* from link_detect l left join c on c.h = l.ext_host_name where cut is null or detect_date is null or detect_date >= cut""")
def history_purge(spark, folder):
    """The history after retention."""
    return monitor.purge(table(spark, folder, "link_detect"))


@query(f"""with {CUR}, g as (select distinct site_name from seda_source where is_hidden = 1 and site_name is not null)
select id, source, case when site_name is not null then 0 else application_visibility end application_visibility, case when site_name is not null then 'untraceable' end traceability from cur left join g on g.site_name = cur.source""")
def hide_sites(spark, folder):
    """The records of hidden sites made invisible."""
    sites = table(spark, folder, "seda_source").where("is_hidden = 1 and site_name is not null").select(F.col("site_name").alias("site"))
    return monitor.hide(current(table(spark, folder, "seda_dataset"), "id", "source", "application_visibility"), sites)


@query(f"with {ALL} select status, is_hidden, count(*) sites, sum(link_num) probes, sum(newly_hidden::int) newly_hidden from rd group by 1, 2")
def round_summary(spark, folder):
    """The round's report."""
    return _round(spark, folder).groupBy("status", "is_hidden").agg(F.count(F.lit(1)).alias("sites"), F.sum("link_num").alias("probes"), F.sum(F.col("newly_hidden").cast("int")).alias("newly_hidden"))
