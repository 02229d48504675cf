"""Queries of record linkage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from shelfmark.functions.hashing import simhash as simhash_of
from shelfmark.functions.hashing import token_hash as hash_of
from shelfmark.functions.text import words
from shelfmark.functions.urls import api_second_url as second_url
from shelfmark.functions.urls import canonicalize_url as canonical
from shelfmark.functions.urls import host_of as host
from shelfmark.functions.urls import page_key as page
from shelfmark.functions.vector import cosine, embeddings_of, norm, unit, usable, vectors_of
from shelfmark.operators import blocking, dedup
from shelfmark.operators.components import components as grouped
from shelfmark.operators.monitor import policy
from shelfmark.params import DEDUP
from shelfmark.plans import pipelines
from shelfmark.plans.common import CUR, WS, registry, store_copy, strip
from shelfmark.session import stored
from shelfmark.sources.tables import current, table

QUERIES, ORACLES, query = registry()
FIELDS = ("dataset_name", "dataset_desc", "dataset_url", "source")


def _current(spark, folder, *columns):
    return current(table(spark, folder, "seda_dataset"), "id", *columns)


SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
CLEAN = r"regexp_replace(regexp_replace(coalesce(dataset_url, ''), '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"
HOST = f"case when contains(regexp_extract(u, '{SPLIT}', 2), '[') <> contains(regexp_extract(u, '{SPLIT}', 2), ']') then '' else lower(regexp_extract(u, '{SPLIT}', 2)) end"
SCHEMES = "('', 'ftp', 'hdl', 'prospero', 'http', 'https', 'shttp', 'rtsp', 'rtsps', 'rtspu', 'sip', 'sips', 'mms', 'sftp', 'tel')"
URL = f"""case when contains(regexp_extract(u, '{SPLIT}', 2), '[') <> contains(regexp_extract(u, '{SPLIT}', 2), ']') then rtrim(lower({strip("coalesce(dataset_url, '')")}), '/')
 else lower(regexp_extract(u, '{SPLIT}', 2)) || rtrim(case when lower(regexp_extract(u, '{SPLIT}', 1)) in {SCHEMES} then regexp_replace(regexp_extract(u, '{SPLIT}', 3), ';[^/]*$', '') else regexp_extract(u, '{SPLIT}', 3) end, '/') end"""
NAME = strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({strip("coalesce(dataset_name, '')")}), '<[^>]+>', '', 'g'), '[_\-]+', ' ', 'g'), '{WS}+', ' ', 'g'), 'v\pN+$', '')").replace(r"v\pN+$", r"v\p{Nd}+$")
NORM = f"""u0 as (select *, {CLEAN} u from cur),
nrm as (select id, {NAME} name, {URL} url, dataset_desc, source from u0),
norm as (select id, name, url, lower({strip("concat_ws(' ', nullif(name, ''), nullif(dataset_desc, ''), nullif(url, ''), nullif(source, ''))")}) as text from nrm)"""


@query(f"with {CUR}, u0 as (select *, {CLEAN} u from cur) select id, {HOST} host from u0")
def host_of(spark, folder):
    """Host of every record's address."""
    return _current(spark, folder, "dataset_url").select("id", host(F.col("dataset_url")).alias("host"))


@query(f"with {CUR}, u0 as (select *, {CLEAN} u from cur) select id, {URL} url from u0")
def canonicalize_url(spark, folder):
    """Comparable address of every record."""
    return _current(spark, folder, "dataset_url").select("id", canonical(F.col("dataset_url")).alias("url"))


@query(f"with {CUR} select id, {NAME} as name from cur")
def normalize_name(spark, folder):
    """Comparable name of every record."""
    from shelfmark.functions.text import normalize_name as norm_name

    return _current(spark, folder, "dataset_name").select("id", norm_name(F.col("dataset_name")).alias("name"))


@query(f"with {CUR}, {NORM} select id, text from norm")
def record_text(spark, folder):
    """The joined text of every record's fields."""
    return dedup.normalized(_current(spark, folder, *FIELDS)).select("id", "text")


BLANKS = strip("coalesce(dataset_url, '')")
PAGE = rf"""pg0 as (select id, regexp_replace({BLANKS}, '#.*$', '') x from cur),
pg1 as (select id, x, regexp_replace(regexp_replace(lower(regexp_extract(x, '{SPLIT}', 2)), ':(80|443)$', ''), '\.$', '') host, regexp_extract(x, '{SPLIT}', 3) path0, regexp_extract(x, '\?(.*)$', 1) q0 from pg0),
pg2 as (select id, host, regexp_replace(regexp_replace(regexp_replace(case when contains(path0, '%') then url_decode(path0) else path0 end, '/{{2,}}', '/', 'g'), '/(?i:index\.html?)$', ''), '/+$', '') path,
 list_sort(list_filter(string_split(q0, '&'), lambda p: p <> '' and not starts_with(lower(p), 'utm_'))) kept from pg1),
pg as (select id, case when host <> '' and (path <> '' or len(kept) > 0) then host || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end page from pg2)"""


@query(f"with {CUR}, {PAGE} select id, page from pg")
def page_keys(spark, folder):
    """One text per page, however its address is written."""
    return _current(spark, folder, "dataset_url").select("id", page(F.col("dataset_url")).alias("page"))


@query(f"""with {CUR}, u0 as (select *, {CLEAN} u from cur), h as (select id, {HOST} host from u0)
select id, case when regexp_matches(host, '(^|\\.)data.quellmar.example$') then 'api' when regexp_matches(host, '(^|\\.)portal.example$') then 'browser' else 'plain' end policy from h""")
def policy_class(spark, folder):
    """How each record's address is to be verified."""
    return _current(spark, folder, "dataset_url").select("id", policy(F.col("dataset_url")).alias("policy"))


@query(f"""with {CUR}, p as (select id, string_split(regexp_replace(dataset_url, '/+$', ''), '/') p from cur)
select id, case when len(p) >= 2 then 'https://api.example/datasets/' || p[-2] || ',' || p[-1] end url from p""")
def api_second_url(spark, folder):
    """Address of the second look-up of every record."""
    return _current(spark, folder, "dataset_url").select("id", second_url(F.col("dataset_url"), "https://api.example/datasets/").alias("url"))


TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
H = "('0x' || substr(md5(t), 17, 16))::UBIGINT"
SIGNED = "(case when {0}::HUGEINT >= 9223372036854775808 then {0}::HUGEINT - 18446744073709551616 else {0}::HUGEINT end)::BIGINT"


@query(f"with {CUR}, {NORM}, t as (select distinct unnest({TOKENS.format('text')}) t from norm) select t as token, {SIGNED.format(H)} hash from t")
def token_hash(spark, folder):
    """64-bit hash of every distinct token of the records' texts."""
    texts = dedup.normalized(_current(spark, folder, *FIELDS))
    return texts.select(F.explode(words(F.col("text"))).alias("token")).distinct().select("token", hash_of(F.col("token")).alias("hash"))


_BITS = " + ".join(f"(case when b{i} >= 0 then 1::HUGEINT << {i} else 0 end)" for i in range(64))
_SUMS = ", ".join(f"sum(case when (h >> {i}) & 1 = 1 then 1 else -1 end) b{i}" for i in range(64))
SIM = f"""tk as (select id, unnest({TOKENS.format('text')}) t from norm), hs as (select id, {H} h from tk), sm as (select id, {_SUMS} from hs group by id),
fp as (select id, {_BITS} f from sm), sh as (select norm.id, case when f is not null then {SIGNED.format('f')} when text = '' then 0 else -1 end simhash from norm left join fp using (id))"""


def _simhash(spark, folder):
    return simhash_of(dedup.normalized(_current(spark, folder, *FIELDS)).select("id", "text"), "id", "text")


@query(f"with {CUR}, {NORM}, {SIM} select id, simhash from sh")
def simhash(spark, folder):
    """64-bit SimHash of every record's text."""
    return _simhash(spark, folder)


_BANDS = ", ".join(f"'band{b}:' || (((case when simhash < 0 then simhash::HUGEINT + 18446744073709551616 else simhash end) // {1 << (8 * b)}::HUGEINT) % 256)::VARCHAR" for b in range(8))


@query(f"with {CUR}, {NORM}, {SIM}, bk as (select id, unnest([{_BANDS}]) bucket from sh) select bucket, count(*) n, count(*) > 500 oversized from bk group by 1")
def simhash_bands(spark, folder):
    """Sizes of the SimHash buckets, and which are oversized."""
    texts = dedup.normalized(_current(spark, folder, *FIELDS)).select("id", "text")
    return blocking.bucket_sizes(blocking.simhash_buckets(texts))


EXPLICIT = """k as (select 'name' kind, name key, id from norm where name <> '' union all select 'url', url, id from norm where url <> ''),
f as (select kind, key, min(id) src from k group by 1, 2), lk as (select kind, src, id dst from k join f using (kind, key) where id <> src)"""
REACH = """e as (select src a, dst b from lk union select dst, src from lk), r(id, low) as (select a, a from e union select e.b, r.low from r join e on e.a = r.id and r.low < e.b),
cc as (select id, min(low) component from r group by id)"""
SCORE = " + ".join(f"case when {f} <> '' then 10 + length({f}) else 0 end" for f in FIELDS)
SCORE = " + ".join(f"coalesce({p}, 0)" for p in (f"(case when {f} <> '' then 10 + length({f}) else 0 end)" for f in FIELDS))
PICK = f"sc as (select component, cc.id, {SCORE} score from cc join cur on cur.id = cc.id), pk as (select component, arg_min(id, (-score, id)) canonical_id, max(score) score from sc group by 1)"
MAPPED = "mp as (select cur.id, coalesce(pk.canonical_id, cur.id) canonical_id from cur left join cc on cc.id = cur.id left join pk using (component))"


def _links(spark, folder):
    records = stored(_current(spark, folder, *FIELDS))  # read for the links and for the choice
    return records, dedup.explicit_links(dedup.normalized(records))


@query(f"with {CUR}, {NORM}, {EXPLICIT} select kind, src, dst from lk")
def explicit_links(spark, folder):
    """Records of one name or one address, each linked with the first."""
    return _links(spark, folder)[1]


@query(f"with recursive {CUR}, {NORM}, {EXPLICIT}, {REACH} select id, component from cc")
def components(spark, folder):
    """Groups of records linked by exact matches."""
    return grouped(_links(spark, folder)[1])


@query(f"with recursive {CUR}, {NORM}, {EXPLICIT}, {REACH}, {PICK} select component, canonical_id, score from pk")
def canonical_pick(spark, folder):
    """The most complete record of every group."""
    records, links = _links(spark, folder)
    return dedup.canonical_of(records, grouped(links))


@query(f"with recursive {CUR}, {NORM}, {EXPLICIT}, {REACH}, {PICK}, {MAPPED} select id, canonical_id from mp")
def explicit_mapping(spark, folder):
    """Canonical id of every record by exact matches."""
    return dedup.mapping(*_links(spark, folder))


_MERGE = ", ".join(f"arg_min({f}, (case when cur.id = mp.canonical_id then 0 else 1 end, cur.id)) filter (where {f} <> '') {f}" for f in FIELDS)


@query(f"with recursive {CUR}, {NORM}, {EXPLICIT}, {REACH}, {PICK}, {MAPPED} select mp.canonical_id id, {_MERGE}, count(*) members from cur join mp using (id) group by 1")
def merge_attributes(spark, folder):
    """The merged record of every group."""
    records, links = _links(spark, folder)
    return dedup.merged(records, dedup.mapping(records, links))


@query(f"with recursive {CUR}, {NORM}, {EXPLICIT}, {REACH}, {PICK}, {MAPPED} select cur.id, coalesce(mp.canonical_id, cur.canonical_id) canonical_id from cur left join mp using (id)")
def canonical_writeback(spark, folder):
    """The records with the canonical ids written back."""
    records = _current(spark, folder, *FIELDS, "canonical_id")
    mapped = dedup.mapping(records, dedup.explicit_links(dedup.normalized(records)))
    return dedup.write_back(records.select("id", "canonical_id"), mapped)


@query(f"with {CUR} select c.id, coalesce(d.canonical_id, c.canonical_id, c.id) canonical_id from cur c left join (select id, coalesce(canonical_id, id) canonical_id from cur) d on d.id = coalesce(c.canonical_id, c.id)")
def mapping_chain(spark, folder):
    """Stored canonical ids followed one hop on."""
    stored = _current(spark, folder, "canonical_id").select("id", F.coalesce("canonical_id", "id").alias("canonical_id"))
    return dedup.chained(stored, stored)


USABLE = "len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
OWN = f"own as (select id, min(embedding) e from seda_dataset_vectors where id is not null and {USABLE} group by 1)"
UNIT = "un as (select id, list_transform(e, lambda x: x::double / (sqrt(list_dot_product(e::double[], e::double[])) + 1e-9)) v from own where id in (select id from cur))"
BUCKETS = f"bk as (select id, unnest([{_BANDS}]) bucket from sh)"
_PLANE = "sqrt(-2 * ln((('0x' || substr(md5(term || '#{0}'), 1, 8))::UBIGINT::double + 1) / 4294967297.0)) * cos(2 * pi() * ((('0x' || substr(md5(term || '#{0}'), 9, 8))::UBIGINT::double + 1) / 4294967297.0))"
_PLANES = ", ".join(f"{_PLANE.format(i)} g{i}" for i in range(16))
_SIGNS = " + ".join(f"case when coalesce(sum(w * g{i}), 0) >= 0 then {1 << i} else 0 end" for i in range(16))
LSH = rf"""lt as (select id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) term from norm), lf as (select id, term, count(*) tf from lt group by 1, 2),
ln_ as (select count(*) n from norm), ld as (select term, count(*) df, sum(tf) cf from lf group by 1 order by cf desc, term limit 20000),
lw as (select id, term, tf * (ln((1 + n) / (1 + df)) + 1) w from lf join ld using (term), ln_), lp as (select term, {_PLANES} from (select distinct term from lw)),
sg as (select norm.id, ({_SIGNS})::int signature from norm left join lw using (id) left join lp using (term) group by 1)"""
MATES = f"""{OWN}, {UNIT}, mk as (select un.id, v, simhash, signature from un join sh using (id) join sg using (id)),
cb as (select id, bucket from bk where id in (select id from un) union select id, 'lsh:' || signature from mk),
vl as (select distinct x.id src, y.id dst from cb x join cb y on x.bucket = y.bucket and x.id < y.id join un a on a.id = x.id join un b on b.id = y.id where list_dot_product(a.v, b.v) >= 0.82)"""


@query(f"with recursive {CUR}, {NORM}, {EXPLICIT.replace('lk as', 'ek as')}, {SIM}, {BUCKETS}, {LSH}, {MATES}, lk as (select src, dst from ek union select src, dst from vl), {REACH}, {PICK}, {MAPPED} select id, canonical_id from mp")
def dedup_mapping(spark, folder):
    """Canonical id of every record by exact and semantic matches; the flagship."""
    return dedup.deduplicate(_current(spark, folder, *FIELDS), table(spark, folder, "seda_dataset_vectors"))


@query(f"with recursive {CUR}, {NORM}, {EXPLICIT.replace('lk as', 'ek as')}, {SIM}, {BUCKETS}, {LSH}, {MATES}, lk as (select src, dst from ek union select src, dst from vl), {REACH}, {PICK}, {MAPPED} select r.id, r.harvested_at, coalesce(mp.canonical_id, r.canonical_id) canonical_id from seda_dataset r left join mp using (id)")
def dedup_store(spark, folder):
    """The stored records, superseded ones too, after a whole linkage run with its write."""
    stores = store_copy(spark, folder, "seda_dataset", "seda_dataset_vectors")
    pipelines.dedup_run(stores)
    return stores.read("seda_dataset").select("id", "harvested_at", "canonical_id")


def _normed(spark, folder):
    records = _current(spark, folder, *FIELDS)
    return stored(dedup.normalized(records)), vectors_of(records, table(spark, folder, "seda_dataset_vectors"), 64)


@query(f"with recursive {CUR}, {NORM}, {SIM}, {BUCKETS}, {LSH}, {MATES}, lk as (select src, dst from vl), {REACH} select id, component from cc")
def semantic_links(spark, folder):
    """Class of every record that shares a bucket with one whose vector agrees."""
    return grouped(dedup.semantic_links(*_normed(spark, folder)))


@query(f"with recursive {CUR}, {NORM}, {SIM}, {BUCKETS}, {LSH}, {MATES}, lk as (select src, dst from vl), {REACH} select id, component from cc")
def bucket_links(spark, folder):
    """The same, exact: no pair of bucket mates whose vectors agree is missed."""
    texts = stored(dedup.normalized(_current(spark, folder, *FIELDS)).select("id", "text"))
    vectors = embeddings_of(texts, table(spark, folder, "seda_dataset_vectors"), 64)
    return grouped(dedup.bucket_links(texts, vectors.select("id", F.col("embedding").alias("v"))))


@query(f"with {CUR}, {NORM}, {LSH} select id, signature from sg")
def lsh_signature(spark, folder):
    """Random-projection signature of every record's TF-IDF vector."""
    return blocking.lsh_signatures(stored(dedup.normalized(_current(spark, folder, *FIELDS))).select("id", "text"))


@query("""with un as (select vec_id, label, list_transform(embedding, lambda x: x::double / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-9)) v from embeddings),
k as (select 'label:' || a.label bucket, a.vec_id::varchar id, b.vec_id::varchar other, list_dot_product(a.v, b.v) cosine from un a join un b on a.label = b.label),
r as (select *, row_number() over (partition by bucket, id order by cosine desc, other) rn from k) select bucket, id, other, round(cosine, 6) cosine from r where rn <= 50 and id <> other and cosine >= 0.2""")
def nearest_mates(spark, folder):
    """Of every vector's 50 nearest in its bucket (one per label), itself counted, those above a threshold (0.2: these vectors lie far apart)."""
    e = table(spark, folder, "embeddings")
    ids = F.col("vec_id").cast("string").alias("id")
    near = blocking.nearest_mates(e.select(F.concat(F.lit("label:"), F.col("label").cast("string")).alias("bucket"), ids), e.select(ids, unit(F.col("embedding")).alias("v")), replace(DEDUP, threshold=0.2))
    return near.withColumn("cosine", F.round("cosine", 6))


@query(f"with {OWN} select id, round(sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))), 4) norm, 64 dimensions from own")
def vector_norms(spark, folder):
    """Length of every usable vector."""
    v = table(spark, folder, "seda_dataset_vectors").where(F.col("id").isNotNull() & usable(F.col("embedding"), 64)).groupBy("id").agg(F.min("embedding").alias("e"))
    return v.select("id", F.round(norm(F.col("e")), 4).alias("norm"), F.size("e").alias("dimensions"))


@query(f"""with {CUR}, {OWN}, p as (select c.id, c.canonical_id, a.e x, b.e y from cur c join own a on a.id = c.id join own b on b.id = c.canonical_id where c.id <> c.canonical_id)
select id, canonical_id, round(list_dot_product(x::double[], y::double[]) / (sqrt(list_dot_product(x::double[], x::double[])) * sqrt(list_dot_product(y::double[], y::double[]))), 5) cosine from p""")
def canonical_cosine(spark, folder):
    """Cosine of every record's vector with that of its canonical record."""
    v = table(spark, folder, "seda_dataset_vectors").where(usable(F.col("embedding"), 64)).groupBy("id").agg(F.min("embedding").alias("e"))
    x = _current(spark, folder, "canonical_id").where("canonical_id != id").join(v.select("id", F.col("e").alias("x")), "id").join(v.select(F.col("id").alias("canonical_id"), F.col("e").alias("y")), "canonical_id")
    return x.select("id", "canonical_id", F.round(cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query(f"""with {CUR}, {NORM}, {SIM}, {BUCKETS}, {OWN}, {UNIT}, sz as (select bucket, count(*) > 500 oversized from bk group by 1)
select bucket, case when oversized then (trunc(list_sum(list_slice(v, 1, 10)) * 1000)::bigint % 50 + 50) % 50 + 1 else 0 end::int sub, count(*) n from bk join sz using (bucket) join un using (id) group by 1, 2""")
def sub_buckets(spark, folder):
    """Second-level buckets of the oversized SimHash buckets, and their sizes."""
    records = _current(spark, folder, *FIELDS)
    texts = dedup.normalized(records).select("id", "text")
    split = blocking.split_oversized(blocking.simhash_buckets(texts), vectors_of(records, table(spark, folder, "seda_dataset_vectors"), 64))
    return split.groupBy("bucket", "sub").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {OWN} select id, [round(x / (sqrt(list_dot_product(e::double[], e::double[])) + 1e-9), 4) + 0.0 for x in e::double[]] v from own")
def unit_vectors(spark, folder):
    """Every usable vector, of length one."""
    v = table(spark, folder, "seda_dataset_vectors").where(F.col("id").isNotNull() & usable(F.col("embedding"), 64)).groupBy("id").agg(F.min("embedding").alias("e"))
    return v.select("id", F.transform(unit(F.col("e")), lambda x: F.round(x, 4) + F.lit(0.0)).alias("v"))
