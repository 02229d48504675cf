"""Dead-link monitoring: sampling plan, liveness, rates, streaks, hiding, history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.hashing import uuid5_hex
from shelfmark.functions.text import strip
from shelfmark.functions.urls import host_of
from shelfmark.params import MONITOR, Monitor

PASS, FAIL = "合格", "不合格"


def active_sites(status: DataFrame) -> DataFrame:
    """(site): sites that are visible or whose visibility nobody set; each once, null names left out."""
    return status.where("application_visibility = 1 or application_visibility is null").where("ext_host_name is not null").select(F.col("ext_host_name").alias("site")).distinct()


def site_counts(source: DataFrame) -> DataFrame:
    """(site, n): sizes of named sites; of several rows the latest update holds, then the largest size."""
    best = F.max(F.struct("update_time", F.col("n").cast("bigint").alias("n"))).alias("b")
    return source.where("site_name != '' and n is not null").groupBy(F.col("site_name").alias("site")).agg(best).select("site", "b.n")


def rates(history: DataFrame) -> DataFrame:
    """(site, detect_date, id, link_rate): detections with a host, a date and a rate; repeated rows once."""
    return history.where("ext_host_name is not null and detect_date is not null and link_rate is not null").select(F.col("ext_host_name").alias("site"), "detect_date", "id", "link_rate").distinct()


def recent_rates(history: DataFrame, p: Monitor = MONITOR) -> DataFrame:
    """(site, rates, sig2): the last ``window`` rates, oldest first, and their sample variance (0 below two)."""
    w = W.partitionBy("site").orderBy(F.desc("detect_date"), F.desc_nulls_last("id"), F.desc("link_rate"))
    x = rates(history).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= p.window)
    last = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("k"), "link_rate"))), lambda s: s["link_rate"])
    return x.groupBy("site").agg(last.alias("rates"), F.coalesce(F.var_samp("link_rate"), F.lit(0.0)).alias("sig2"))


def site_state(status: DataFrame, source: DataFrame, history: DataFrame, p: Monitor = MONITOR) -> DataFrame:
    """(site, n, delta_n, sig2, fail_streak, is_hidden, last_hidden_date): what a round starts from, one row per active site.

    Unknown sizes, streaks and flags count 0; delta_n is the size less the size of the last round.
    """
    latest = F.max(F.struct("update_time", "last_n", "fail_streak", "is_hidden", "last_hidden_date")).alias("b")
    snap = source.where("site_name is not null").groupBy(F.col("site_name").alias("site")).agg(latest).select("site", "b.last_n", "b.fail_streak", "b.is_hidden", "b.last_hidden_date")
    x = active_sites(status).join(site_counts(source), "site", "left").join(snap, "site", "left").join(recent_rates(history, p).select("site", "sig2"), "site", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.select("site", zero("n").alias("n"), (zero("n") - zero("last_n")).alias("delta_n"), F.coalesce("sig2", F.lit(0.0)).alias("sig2"), zero("fail_streak").alias("fail_streak"), zero("is_hidden").alias("is_hidden"), "last_hidden_date")


def weight(n: Column, sig2: Column, delta: Column, p: Monitor = MONITOR) -> Column:
    """Sampling weight of a site; negative where it shrinks fast."""
    size = F.greatest(n, F.lit(0)).cast("double")
    return F.log1p(size) * (1 + p.volatility * sig2) * (1 + p.growth * (delta / (size + p.eps)))


def k_max(n: Column, p: Monitor = MONITOR) -> Column:
    """Most samples of a site: twice the root of its size, at least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(p.c_max * F.sqrt(F.greatest(n, F.lit(0)).cast("double")), 0).cast("bigint"))


def allocate(state: DataFrame, p: Monitor = MONITOR) -> DataFrame:
    """The state with weight and k, the samples of each site.

    Hidden sites get exactly ``k_min``; others their share of the budget, at least ``k_min``, then at most ``k_max``.
    Shares rest on the positive weights of all sites, hidden ones too; if there are none the divisor is 1.
    """
    x = state.withColumn("weight", weight(F.col("n"), F.col("sig2"), F.col("delta_n"), p))
    total = F.broadcast(x.agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("_w")))  # one row
    share = F.col("weight") / F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0)
    k = F.least(F.greatest(F.lit(p.k_min), F.bround(share * p.budget, 0).cast("bigint")), k_max(F.col("n"), p))
    return x.join(total, F.lit(True)).withColumn("k", F.when(F.col("is_hidden") == 1, F.lit(p.k_min)).otherwise(k).cast("bigint")).drop("_w")


def sample(records: DataFrame, plan: DataFrame, seed: str = "round", p: Monitor = MONITOR) -> DataFrame:
    """(site, url, name): exactly k addresses of each site (all if fewer), drawn by the MD5 of seed and address; empty ones never."""
    urls = records.where("dataset_url != ''").select(F.lower(strip(F.col("source"))).alias("site"), F.col("dataset_url").alias("url"), F.col("dataset_name").alias("name"), "id")
    w = W.partitionBy("site").orderBy(F.md5(F.concat(F.lit(seed), F.col("url"))), "url", "id")
    # no site gets more than the whole budget, or than hidden ones do: a bound known beforehand, with which the window prunes before its shuffle
    top = urls.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(p.budget, p.k_min)).join(plan.select("site", "k"), "site")
    return top.where(F.col("rn") <= F.col("k")).select("site", "url", "name")


def site_pattern(host: Column, sites: tuple[str, ...]) -> Column:
    """True if the host is one of the sites or below it; dots in a site match any letter, a port defeats the match."""
    out = F.lit(False)
    for s in sites:
        out = out | host.rlike(rf"(^|\.){s}$")
    return out


@dataclass(frozen=True)
class Policy:
    """How the addresses of some sites are verified. kind: 'api' ones are asked before 'browser' ones, others after both, in the order given.

    handler: (url) -> whether it lives, from the columns of ``plugins.PROBE``; without one the kind's own rule holds.
    """

    name: str
    kind: str
    sites: tuple[str, ...]
    handler: Callable[[Column], Column] | None = None


def policies(p: Monitor = MONITOR) -> tuple[Policy, ...]:
    """The registry of an installation whose settings name its sites; more policies may be added to it."""
    return (Policy("verified by API", "api", p.api_sites), Policy("rendered by a browser", "browser", p.browser_sites))


def ordered(registry: tuple[Policy, ...]) -> list[Policy]:
    rank = {"api": 0, "browser": 1}
    return sorted(registry, key=lambda x: rank.get(x.kind, 2))


def policy(url: Column, p: Monitor = MONITOR, registry: tuple[Policy, ...] | None = None) -> Column:
    """The kind of the first policy that has the address's site, or 'plain'."""
    h = host_of(url)
    out = F.lit("plain")
    for x in reversed(ordered(policies(p) if registry is None else registry)):
        out = F.when(site_pattern(h, x.sites), x.kind).otherwise(out)
    return out


def first_status() -> Column:
    """The first answer to HEAD, or that to GET if every HEAD raised."""
    return F.element_at(F.concat(F.filter(F.coalesce("head_status", F.array().cast("array<int>")), lambda s: s.isNotNull()), F.array(F.col("get_status"))), 1)


def by_api(url: Column) -> Column:
    """200 at first and in the second look-up, where the address has one."""
    second = F.when(F.size(F.split(F.regexp_replace(url, r"/+$", ""), "/")) < 2, False).otherwise(F.coalesce(F.col("secondary_status") == 200, F.lit(False)))
    return (first_status() == 200) & second


def by_browser(url: Column) -> Column:
    """The rendered page has a title."""
    return strip(F.col("title")) != ""


def alive(url: Column, p: Monitor = MONITOR, registry: tuple[Policy, ...] | None = None) -> Column:
    """Whether a probed URL lives, from the columns of ``plugins.PROBE``: by the handler of its site's policy, else by its status."""
    h, kinds = host_of(url), {"api": by_api, "browser": by_browser}
    out = first_status().isin(*p.ok_status)
    for x in reversed(ordered(policies(p) if registry is None else registry)):
        out = F.when(site_pattern(h, x.sites), (x.handler or kinds[x.kind])(url)).otherwise(out)
    return F.when(F.coalesce(url, F.lit("")) == "", False).otherwise(F.coalesce(out, F.lit(False)))


def alive_rates(probes: DataFrame, *by: str) -> DataFrame:
    """(by..., link_num, rate): share of living probes, four places."""
    return probes.groupBy(*by).agg(F.count(F.lit(1)).alias("link_num"), F.bround(F.avg(F.col("alive").cast("int")), 4).alias("rate"))


def verdict(rate: Column, p: Monitor = MONITOR) -> Column:
    """Pass or fail of a rounded rate; none is 0."""
    return F.when(F.coalesce(rate, F.lit(0.0)) >= p.pass_rate, PASS).otherwise(FAIL)


def streaks(history: DataFrame, p: Monitor = MONITOR) -> DataFrame:
    """(site, detect_date, id, failed, fail_streak, is_hidden, first_hidden, var5) after each detection of a site.

    fail_streak counts the failures in a row up to now; a site is hidden once the streak reaches the threshold and
    stays so; first_hidden is when; var5 the sample variance of the last five rates.

    No task orders a site's whole history: it is cut by ``period`` of time, each period told on its own, and what it hands
    on (the streak at its end, its last rates) follows from one small row per site and period.
    """
    x = history.where("ext_host_name is not null and detect_date is not null").select(F.col("ext_host_name").alias("site"), F.date_trunc(p.period, "detect_date").alias("_p"), "detect_date", "id", "link_rate", F.when(F.col("status") == PASS, 0).otherwise(1).alias("failed"))
    x = x.distinct()
    order = ["detect_date", F.asc_nulls_first("id"), F.asc_nulls_first("link_rate")]
    part = W.partitionBy("site", "_p").orderBy(*order)
    frame = lambda n: part.rowsBetween(1 - n, 0)
    so_far = part.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({
        "_g": F.sum(1 - F.col("failed")).over(so_far), "_rn": F.row_number().over(part), "_var": F.var_samp("link_rate").over(frame(p.window)), "_last": F.collect_list(F.struct("link_rate")).over(frame(p.window)),
    })
    x = x.withColumn("_s", F.sum("failed").over(W.partitionBy("site", "_p", "_g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    by_site = W.partitionBy("site").orderBy("_p")  # a row per period
    short = F.when(F.size("e._last") < p.window, F.col("e._last")).otherwise(F.slice("e._last", 2, p.window - 1))
    ends = x.groupBy("site", "_p").agg(F.max(F.struct("_rn", "_g", "_s", "_last")).alias("e")).select("site", "_p", F.col("e._g").alias("g"), F.col("e._s").alias("s"), short.alias("l"))
    ends = ends.withColumn("r", F.sum((F.col("g") > 0).cast("int")).over(by_site.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("out", F.sum("s").over(W.partitionBy("site", "r").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)))
    handed = F.flatten(F.collect_list("l").over(by_site.rowsBetween(1 - p.window, -1)))
    ends = ends.select("site", "_p", F.coalesce(F.lag("out").over(by_site), F.lit(0)).alias("_in"), handed.alias("_before"))
    x = x.join(ends, ["site", "_p"]).withColumn("fail_streak", F.col("_s") + F.when(F.col("_g") == 0, F.col("_in")).otherwise(0))
    # in the first rows of a period the last rates reach back into those before
    all_ = F.concat("_before", "_last")
    five = F.filter(F.transform(F.slice(all_, F.greatest(F.size(all_) - p.window + 1, F.lit(1)), p.window), lambda r: r["link_rate"]), lambda v: v.isNotNull())
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a, v):  # as the built-in aggregate adds a value, so that both round alike
        delta = v - a["mean"]
        part = delta / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), (a["mean"] + part).alias("mean"), (a["m2"] + delta * (delta - part)).alias("m2"))

    few = F.aggregate(five, zero, step, lambda a: F.when(a["n"] >= 2, a["m2"] / (a["n"] - 1)))
    var = F.when(F.col("_rn") >= p.window, F.col("_var")).otherwise(few)
    x = x.withColumn("var5", F.coalesce(var, F.lit(0.0)))
    at = F.struct("detect_date", "id", "link_rate")
    hidden = x.where(F.col("fail_streak") >= p.fail_threshold).groupBy("site").agg(F.min(at).alias("_f"))  # a row per site
    since = F.coalesce(at >= F.col("_f"), F.lit(False))
    return x.join(hidden, "site", "left").select("site", "detect_date", "id", "failed", "fail_streak", since.cast("int").alias("is_hidden"), F.when(since, F.col("_f.detect_date")).alias("first_hidden"), "var5")


def history_id(site: Column, moment: Column) -> Column:
    """Id of a history row: version 5 UUID of site and moment (seconds since 1970, as a float is written)."""
    micros = F.unix_micros(moment.cast("timestamp"))
    part = F.regexp_replace(F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"), r"0+$", "")
    return uuid5_hex(F.concat(site, F.lit("-"), F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.when(part == "", "0").otherwise(part)))


def monitoring_round(state: DataFrame, probes: DataFrame, history: DataFrame, now: Column, p: Monitor = MONITOR) -> DataFrame:
    """One round as one plan: (site, n, k, delta_n, link_num, alive_rate, alive_var, status, fail_streak, is_hidden, newly_hidden, last_hidden_date).

    ``state`` as by ``allocate``, ``probes`` (site, alive). Sites without probes have rate 0 and fail. The variance
    covers the last rates with this round's; a site is newly hidden when its streak reaches the threshold the first time.
    """
    measured = alive_rates(probes, "site")
    x = state.join(measured, "site", "left").join(recent_rates(history, p).select("site", "rates"), "site", "left")
    x = x.withColumn("alive_rate", F.coalesce("rate", F.lit(0.0))).withColumn("status", verdict(F.col("alive_rate"), p))
    five = F.slice(F.concat(F.coalesce("rates", F.array().cast("array<double>")), F.array("alive_rate")), -p.window, p.window)
    five = F.when(F.size(F.coalesce("rates", F.array().cast("array<double>"))) + 1 >= p.window, five).otherwise(F.concat(F.coalesce("rates", F.array().cast("array<double>")), F.array("alive_rate")))
    n = F.size("five").cast("double")
    total = F.aggregate("five", F.lit(0.0), lambda s, v: s + v)
    spread = F.aggregate("five", F.lit(0.0), lambda s, v: s + (v - total / n) * (v - total / n))
    x = x.withColumn("five", five).withColumn("alive_var", F.bround(F.when(n >= 2, spread / (n - 1)).otherwise(0.0), 6))
    x = x.withColumn("fail_streak", F.when(F.col("status") == PASS, 0).otherwise(F.col("fail_streak") + 1))
    fresh = (F.col("is_hidden") == 0) & (F.col("fail_streak") >= p.fail_threshold)
    return x.select(
        "site", "n", "k", "delta_n", F.coalesce("link_num", F.lit(0)).cast("int").alias("link_num"), "alive_rate", "alive_var", "status", F.col("fail_streak").cast("int").alias("fail_streak"),
        F.when(fresh, 1).otherwise(F.col("is_hidden")).alias("is_hidden"), fresh.alias("newly_hidden"), F.when(fresh, now).otherwise(F.col("last_hidden_date")).alias("last_hidden_date"),
    )


def upsert_snapshot(source: DataFrame, result: DataFrame, now: Column) -> DataFrame:
    """The site table after a round: matched sites keep id and creation, new ones get both; the others stay as they are."""
    new = result.select(F.col("site").alias("site_name"), *(F.col(c).alias(f"_{c}") for c in ("n", "alive_rate", "alive_var", "delta_n", "status", "fail_streak", "is_hidden", "last_hidden_date")), F.lit(True).alias("_hit"))
    x = source.join(new, "site_name", "full_outer")
    hit = F.col("_hit").isNotNull()
    take = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
    return x.select(
        F.coalesce("id", F.when(hit, history_id(F.col("site_name"), now))).alias("id"), "site_name", take("n", F.col("_n")), take("alive_rate", F.col("_alive_rate")), take("alive_var", F.col("_alive_var")),
        take("last_n", F.col("_n")), take("delta_n", F.col("_delta_n")), take("status", F.col("_status")), take("last_detect_date", now), take("fail_streak", F.col("_fail_streak")),
        take("is_hidden", F.col("_is_hidden")), take("last_hidden_date", F.col("_last_hidden_date")), F.when(hit, F.coalesce("create_time", now)).otherwise(F.col("create_time")).alias("create_time"), take("update_time", now),
    )


def history_rows(result: DataFrame, now: Column) -> DataFrame:
    """This round's rows for the history, ready to append."""
    return result.select(history_id(F.col("site"), now).alias("id"), F.col("site").alias("ext_host_name"), "link_num", F.col("alive_rate").alias("link_rate"), "status", now.alias("detect_date"), now.alias("create_time"), now.alias("update_time"))


def purge(history: DataFrame, p: Monitor = MONITOR) -> DataFrame:
    """The history without what is older than a site's ``keep``-th latest detection; ties with it stay, undated and hostless rows too.

    The cutoff per site is found first (the window keeps ``keep`` rows per site before its shuffle), then joined.
    """
    w = W.partitionBy("ext_host_name").orderBy(F.desc("detect_date"))
    dated = history.where("ext_host_name is not null and detect_date is not null").select("ext_host_name", "detect_date")
    cutoff = dated.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= p.keep).groupBy("ext_host_name").agg(F.min("detect_date").alias("_cut"))
    return history.join(cutoff, "ext_host_name", "left").where("_cut is null or detect_date is null or detect_date >= _cut").select(*history.columns)


def hide(records: DataFrame, sites: DataFrame) -> DataFrame:
    """The records with visibility 0 and trace 'untraceable' where their source is one of ``sites`` (site)."""
    gone = sites.select(F.col("site").alias("source"), F.lit(True).alias("_gone")).distinct()
    trace = F.col("traceability") if "traceability" in records.columns else F.lit(None).cast("string")
    x = records.join(gone, "source", "left")
    keep = [c for c in records.columns if c not in ("application_visibility", "traceability")]
    return x.select(*keep, F.when(F.col("_gone"), 0).otherwise(F.col("application_visibility")).alias("application_visibility"), F.when(F.col("_gone"), "untraceable").otherwise(trace).alias("traceability"))
