"""Queries of topic tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import plugins
from shelfmark.functions.vector import vectors_of
from shelfmark.operators import tags
from shelfmark.params import TAGGING
from shelfmark.plans import pipelines
from shelfmark.plans.common import CUR, WS, registry, store_copy, strip
from shelfmark.plans.linkage import OWN, UNIT
from shelfmark.session import shared_path
from shelfmark.sources import readers, sinks
from shelfmark.sources.tables import current, init_tables, table

QUERIES, ORACLES, query = registry()


def _current(spark, folder, *columns):
    return current(table(spark, folder, "seda_dataset"), "id", *columns)


def _texts(spark, folder):
    return _current(spark, folder, "dataset_name", "dataset_desc")


def _vocabulary(spark, folder):
    return table(spark, folder, "tag_vocabulary").where("tag_name is not null and tag_name != ''").select(F.lower("tag_name").alias("tag")).distinct()


TERMS = r"""w as (select id, list_filter(regexp_extract_all(lower(coalesce(dataset_name, '') || ' ' || dataset_desc), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{3,}')) l from cur where dataset_desc <> ''),
u as (select id, unnest(l) term, unnest(range(len(l))) pos from w), tf as (select id, term, count(*) tf, min(pos) + 1 first_pos from u group by 1, 2 having count(*) >= 2),
tt as (select *, row_number() over (partition by id order by 1.0 * tf + 1.0 / first_pos desc, first_pos) rank from tf qualify rank <= 20)"""


@query(f"with {CUR}, {TERMS} select id, term, tf, first_pos::int first_pos, rank::int rank from tt")
def tag_terms(spark, folder):
    """Candidate terms of every record."""
    return tags.candidate_terms(_texts(spark, folder))


def _phrases(source: str, key: str, text: str) -> str:
    """CTE ``ph`` (key, phrase, ord): word pairs by the three patterns. A match uses up its words, so of a chain of overlapping ones every other counts."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    letters, blank = "regexp_full_match({0}, '[a-z]+')", f"regexp_full_match(sep, '{WS}+')"
    kinds = ((letters.format("tok"), f"nxt in ({quoted(tags.TASKS)})"), (f"tok in ({quoted(tags.FIELDS)})", letters.format("nxt")), (letters.format("tok"), f"nxt in ({quoted(tags.THINGS)})"))
    cases = " union all ".join(f"select {key}, {i} pat, i, tok || sep || nxt phrase from sq where {x} and {blank} and {y}" for i, (x, y) in enumerate(kinds))
    return rf"""rw as (select {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') l from {source}),
tk as (select {key}, unnest(l) tok, unnest(range(len(l))) i from rw), sq as (select {key}, i, tok, lead(tok) over w sep, lead(tok, 2) over w nxt from tk window w as (partition by {key} order by i)),
pc as ({cases}), pi as (select *, i // 2 - row_number() over (partition by {key}, pat order by i) g from pc), po as (select *, row_number() over (partition by {key}, pat, g order by i) n from pi),
pf as (select {key}, phrase, min(pat * 1000000000 + i) o from po where n % 2 = 1 group by 1, 2), ph as (select {key}, phrase, row_number() over (partition by {key} order by o) ord from pf qualify ord <= 20)"""


@query(f"with {_phrases('documents', 'doc_id', 'text')} select doc_id, phrase from ph")
def tag_phrases(spark, folder):
    """Compound terms of every document's text."""
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.explode(tags.phrases(F.col("text"))).alias("phrase"))


CANDIDATES = f"""{TERMS}, {_phrases("cur", "id", "dataset_desc")}, ca as (select id, {strip("phrase")} t, ord from ph union all select id, term, 1000 + rank from tt),
cg as (select id, t, min(ord) o from ca where t <> '' group by 1, 2), cl as (select cur.id, coalesce(list(t order by o) filter (where t is not null), []) tags from cur left join cg using (id) group by 1)"""


@query(f"with {CUR}, {CANDIDATES} select id, tags from cl")
def tag_candidates(spark, folder):
    """Phrases and terms of every record, merged."""
    return tags.candidates(_texts(spark, folder))


@query(f"with {CUR}, {CANDIDATES} select distinct unnest(tags) tag from cl where id in (select id from cur order by id limit 1000)")
def seed_vocabulary(spark, folder):
    """The vocabulary of the seed records."""
    return tags.seed_vocabulary(_texts(spark, folder))


@query(f"with {CUR} select id, dataset_name, dataset_desc from cur order by id limit 1000")
def seed_scan(spark, folder):
    """The records the initial vocabulary starts from."""
    return readers.seed(_texts(spark, folder), TAGGING.seed_size)


@query("select nullif(nullif(id, ''), '0') id, dataset_name, dataset_desc, dataset_url, source from seda_dataset")
def catalogue_scroll(spark, folder):
    """Every record of the dump, with the id rule of harvested documents."""
    return readers.catalogue(spark, f"{folder}/seda_dataset.parquet").select("id", "dataset_name", "dataset_desc", "dataset_url", "source")


VOC = "voc as (select distinct lower(tag_name) tag from tag_vocabulary where tag_name is not null and tag_name <> ''), tx as (select id, lower(coalesce(dataset_name, '') || ' ' || coalesce(dataset_desc, '')) x from cur), ct as (select id, tag from tx join voc on contains(x, tag))"


@query(f"with {CUR}, {VOC} select tag, count(id) n from voc left join ct using (tag) group by 1")
def tag_docfreq(spark, folder):
    """Records that contain each tag of the vocabulary."""
    return tags.document_frequency(_texts(spark, folder), _vocabulary(spark, folder))


EDGES = """cn as (select tag, count(*) n from ct group by 1), cb as (select x.tag tag_1, y.tag tag_2, count(*) n12 from ct x join ct y on x.id = y.id and x.tag < y.tag group by 1, 2),
ce as (select tag_1, tag_2, n12, n12 / sqrt(p.n::double * q.n) weight from cb join cn p on p.tag = tag_1 join cn q on q.tag = tag_2 where n12 / sqrt(p.n::double * q.n) >= 0.1)"""


def _edges(spark, folder):
    return tags.cooccurrence_edges(_texts(spark, folder), _vocabulary(spark, folder))


@query(f"with {CUR}, {VOC}, {EDGES} select tag_1, tag_2, n12, round(weight, 6) weight from ce")
def cooccurrence_edges(spark, folder):
    """Co-occurrence graph of the vocabulary over all current records."""
    return _edges(spark, folder).withColumn("weight", F.round("weight", 6))


@query(f"""with {CUR}, {VOC}, {EDGES}, vi as (select lower(tag_name) tag, min(tag_id) i from tag_vocabulary where tag_id is not null and tag_name <> '' group by 1)
select a.i tag_id_1, b.i tag_id_2, round(weight::float, 5) weight from ce join vi a on a.tag = tag_1 join vi b on b.tag = tag_2""")
def edge_replace(spark, folder):
    """The stored edges after a fresh graph took their place; read from the store."""
    path = shared_path(spark, "store") + "/tag_cooccurrence"
    sinks.append(table(spark, folder, "tag_cooccurrence"), path)
    sinks.replace(tags.edges_by_id(_edges(spark, folder), table(spark, folder, "tag_vocabulary")), path, keep_if_empty=True)
    return sinks.read_or_empty(spark, path, "tag_cooccurrence").withColumn("weight", F.round(F.col("weight").cast("double"), 5).cast("float"))


@query("select * from (values ('link_detect', 8), ('seda_dataset', 10), ('seda_dataset_vectors', 2), ('seda_source', 14), ('source_status', 2), ('tag_cooccurrence', 3), ('tag_vectors', 2), ('tag_vocabulary', 4)) t(name, columns)")
def tables_init(spark, folder):
    """The tables of a fresh store, each empty, and their columns."""
    path = shared_path(spark, "store")
    init_tables(spark, path)
    rows = [(n, len(t.columns)) for n in init_tables(spark, path) for t in [table(spark, path, n)] if t.isEmpty()]
    return spark.createDataFrame(rows, "name string, columns int")


ADJ = """nd as (select distinct tag_id node from tag_vocabulary where tag_id is not null), ed as (select tag_id_1 s, tag_id_2 d, weight::double w from tag_cooccurrence join nd a on a.node = tag_id_1 join nd b on b.node = tag_id_2),
bo as (select s, d, sum(w) w from (select s, d, w from ed union all select d, s, w from ed) group by 1, 2), ad as (select s src, d dst, w / case when sum(w) over (partition by s) <> 0 then sum(w) over (partition by s) else 1 end p from bo)"""


def _adjacency(spark, folder):
    edges = table(spark, folder, "tag_cooccurrence").select(F.col("tag_id_1").alias("src"), F.col("tag_id_2").alias("dst"), "weight")
    return tags.adjacency(edges, table(spark, folder, "tag_vocabulary").where("tag_id is not null").select(F.col("tag_id").alias("node")))


@query(f"with {ADJ} select src, dst, round(p, 6) p from ad")
def adjacency(spark, folder):
    """Row-normalised graph of the stored edges."""
    return _adjacency(spark, folder).withColumn("p", F.round("p", 6))


KNOWN = r"""kv as (select trim(regexp_replace(lower(tag_name), '[^\p{L}\p{N}]+', ' ', 'g')) k, min(tag_id) node from tag_vocabulary where tag_id is not null group by 1 having k <> ''),
kp as (select id, unnest(string_split_regex(t, '[,;|，；、\n]')) t from (select id, unnest(tags) t from cur)),
kt as (select distinct id, node from kp join kv on k = trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')))"""


def _steps() -> str:
    out = "s0 as (select id, node, 1.0 / count(*) over (partition by id) s from kt)"
    for i in range(1, TAGGING.iterations + 1):
        out += f""", s{i} as (select coalesce(w.id, z.id) id, coalesce(w.node, z.node) node, 0.85 * coalesce(w.s, 0) + 0.15 * coalesce(z.s, 0) s from
 (select id, dst node, sum(s * p) s from s{i - 1} join ad on ad.src = s{i - 1}.node group by 1, 2) w full join s0 z on z.id = w.id and z.node = w.node)"""
    return out


def _known(spark, folder):
    return tags.known_tags(_current(spark, folder, "tags"), table(spark, folder, "tag_vocabulary"))


def _ranks(spark, folder, top=None):
    nodes = table(spark, folder, "tag_vocabulary").where("tag_id is not null").select(F.col("tag_id").alias("node"))
    return tags.record_ranks(_adjacency(spark, folder), nodes, _known(spark, folder), top=top)


@query(f"with {CUR}, {ADJ}, {KNOWN}, {_steps()} select id, node, round(s, 6) score from s10 where s > 1e-9")
def ppr_scores(spark, folder):
    """Personalised PageRank of the stored graph's tags for every record, from all its known tags."""
    return _ranks(spark, folder).where("score > 1e-9").select("id", "node", F.round("score", 6).alias("score"))


@query(f"with {CUR}, {ADJ}, {KNOWN}, {_steps()} select id, node, rank::int rank from (select id, node, row_number() over (partition by id order by round(s, 9) desc, node desc) rank from s10 where s > 0) where rank <= 10")
def ppr_topk(spark, folder):
    """The ten best nodes of every record."""
    return _ranks(spark, folder, TAGGING.top).select("id", "node", "rank")


BLANK = r"list_filter(string_split_regex(lower({0}), '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda t: t <> '')"


LEXICAL = f"""lt as (select id, unnest({BLANK.format("concat_ws(' ', coalesce(dataset_name, ''), coalesce(dataset_desc, ''))")}) w from cur), tf as (select id, w, count(*) tf from lt group by 1, 2),
q as (select tag, w, count(*) q from (select distinct lower(tag_name) tag, unnest({BLANK.format('tag_name')}) w, generate_subscripts({BLANK.format('tag_name')}, 1) i from tag_vocabulary where tag_name <> '') group by 1, 2)"""


@query(f"with {CUR}, {LEXICAL} select id, tag, round(sum(-0.25 * ln(3.0) * q * tf * 2.5 / (tf + 1.5)), 6) lex from tf join q using (w) group by 1, 2")
def bm25_singleton(spark, folder):
    """Okapi scores of the vocabulary's tags, each record a collection of its own."""
    return tags.lexical(_texts(spark, folder), _vocabulary(spark, folder)).withColumn("lex", F.round("lex", 6))


@query(f"""with {CUR}, {LEXICAL}, ln_ as (select id, sum(tf) len from tf group by 1), wh as (select count(*) n, avg(len) mean from ln_), df as (select w, count(*) df from tf group by 1),
x as (select id, tag, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * q * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) lex from tf join q using (w) join df using (w) join ln_ using (id), wh group by 1, 2)
select id, tag, round(case when max(lex) over (partition by id) > 0 then lex / max(lex) over (partition by id) else lex end, 6) lex from x""")
def bm25_corpus(spark, folder):
    """Okapi scores with the idf of all records."""
    return tags.lexical(_texts(spark, folder), _vocabulary(spark, folder), "corpus").withColumn("lex", F.round("lex", 6))


def _tag_vectors(spark, folder):
    return plugins.encoded(_vocabulary(spark, folder), "tag", "tag")


def _vectors(spark, folder):
    return vectors_of(_current(spark, folder), table(spark, folder, "seda_dataset_vectors"), 64)


def _mean_vectors(spark, folder):
    """Vectors of the tags from the records that have them: no model takes part, so SQL can say what follows from them."""
    names = table(spark, folder, "tag_vocabulary").where("tag_id is not null").select(F.col("tag_id").alias("node"), F.lower("tag_name").alias("tag"))
    return tags.mean_vectors(_known(spark, folder).join(names, "node"), _vectors(spark, folder), 64)


MEANS = f"""{KNOWN}, {OWN}, {UNIT}, tg as (select distinct kt.id, lower(tag_name) tag from kt join tag_vocabulary on tag_id = node),
te as (select tag, unnest(v) x, unnest(range(64)) i from tg join un using (id)), ts as (select tag, i, sum(x) x from te group by 1, 2), tl as (select tag, list(x order by i) v from ts group by 1),
tv as (select tag, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) v from tl)"""
SEM = "sm as (select un.id, tag, list_dot_product(un.v, list_transform(tv.v, lambda x: x / (sqrt(list_dot_product(tv.v, tv.v)) + 1e-9))) sem from un, tv)"


@query(f"with {CUR}, {MEANS} select tag, list_transform(v, lambda x: round(x, 4) + 0.0) embedding from tv")
def tag_vectors(spark, folder):
    """Vectors of the vocabulary's tags, as the mean of their records'; written to the store and read from it."""
    path = shared_path(spark, "store") + "/tag_vectors"
    sinks.append(_mean_vectors(spark, folder), path)
    return sinks.read_or_empty(spark, path, schema="tag string, embedding array<double>").select("tag", F.transform("embedding", lambda x: F.round(x, 4) + F.lit(0.0)).alias("embedding"))


@query()
def encoded_tags(spark, folder):
    """Vectors of the vocabulary's tags by the stand-in encoder."""
    return _tag_vectors(spark, folder)


@query(f"with {CUR}, {OWN}, {UNIT} select cur.id, list_transform(un.v, lambda x: round(x, 4) + 0.0) v from cur left join un using (id) where tags is null or len(list_filter(tags, lambda t: t is not null)) = 0 or list_contains(tags, '')")
def vector_lookup(spark, folder):
    """The vector of every record that needs tags, null where it has none."""
    need = tags.untagged(_current(spark, folder, "tags"))
    return need.join(_vectors(spark, folder), "id", "left").select("id", F.transform("v", lambda x: F.round(x, 4) + F.lit(0.0)).alias("v"))


@query()
def synonym_clusters(spark, folder):
    """Representative of every tag of the vocabulary."""
    return spark.createDataFrame(sorted(tags.synonyms_of(_tag_vectors(spark, folder)).items()), "tag string, representative string")


@query(f"with {CUR}, {MEANS}, {SEM}, rs as (select *, row_number() over (partition by id order by round(sem, 9) desc, tag) rank from sm) select id, tag, round(sem, 6) sem, rank::int rank from rs where rank <= 5")
def semantic_scores(spark, folder):
    """The five tags nearest to every record by vector."""
    return tags.semantic(_vectors(spark, folder), _mean_vectors(spark, folder), 5).withColumn("sem", F.round("sem", 6))


FUSED = f"""{MEANS}, {SEM}, {LEXICAL}, lx as (select id, tag, sum(-0.25 * ln(3.0) * q * tf * 2.5 / (tf + 1.5)) lex from tf join q using (w) group by 1, 2),
vo as (select distinct lower(tag_name) tag from tag_vocabulary where tag_name <> ''), fs as (select id, tag, round(0.5 * coalesce(sem, 0) + 0.5 * coalesce(lex, 0), 9) score from (select * from sm where tag in (select tag from vo)) s full join lx using (id, tag)),
fr as (select *, row_number() over (partition by id order by score desc, tag) rank from fs)"""


def _best(spark, folder, top):
    return tags.best_tags(_texts(spark, folder), _vectors(spark, folder), _mean_vectors(spark, folder), _vocabulary(spark, folder), top)


@query(f"with {CUR}, {FUSED} select id, tag, score, rank::int rank from fr where rank <= 5")
def fused_scores(spark, folder):
    """The five best tags of every record by semantic and lexical score together."""
    return _best(spark, folder, 5)


@query(f"""with {CUR}, {FUSED}, bt as (select id, list(tag order by rank) t from fr where rank <= 2 group by 1)
select cur.id, case when bt.id is not null and (tags is null or len(list_filter(tags, lambda t: t is not null)) = 0 or list_contains(tags, '')) then t else tags end tags from cur left join bt using (id)""")
def tag_writeback(spark, folder):
    """The records after tags were written to those without: the two best by both scores; read from the store."""
    records = _current(spark, folder, "tags")
    best = _best(spark, folder, TAGGING.chosen).join(tags.untagged(records), "id", "left_semi")
    chosen = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    path = shared_path(spark, "store") + "/seda_dataset"
    sinks.append(records, path)
    sinks.replace(tags.write_tags(spark.read.parquet(path), chosen), path)
    return spark.read.parquet(path)


def _stored_edges(spark, folder):
    v = table(spark, folder, "tag_vocabulary").where("tag_id is not null").select("tag_id", F.lower("tag_name").alias("t"))
    e = table(spark, folder, "tag_cooccurrence")
    return e.join(v.select(F.col("tag_id").alias("tag_id_1"), F.col("t").alias("tag_1")), "tag_id_1").join(v.select(F.col("tag_id").alias("tag_id_2"), F.col("t").alias("tag_2")), "tag_id_2").select("tag_1", "tag_2", "weight")


def _tagged(spark, folder, records, vectors):
    return tags.tag_records(records, vectors, _vocabulary(spark, folder), _tag_vectors(spark, folder), _stored_edges(spark, folder))


def _initial(spark, folder):
    """(vocabulary, its vectors, edges) of the initial mode."""
    records = _texts(spark, folder)
    return tags.initial_graph(records, tags.seed_vocabulary(records))


@query()
def graph_system(spark, folder):
    """The stored edges, with the names of their tags, after the initial mode built vocabulary, counts and graph."""
    stores = store_copy(spark, folder, "seda_dataset", "seda_dataset_vectors", "tag_vocabulary", "tag_cooccurrence")
    pipelines.tag_run(stores, pipelines.INITIAL, F.lit("2026-01-01").cast("timestamp_ntz"))
    names = stores.read("tag_vocabulary").select("tag_id", "tag_name")
    x = stores.read("tag_cooccurrence").join(names.select(F.col("tag_id").alias("tag_id_1"), F.col("tag_name").alias("tag_1")), "tag_id_1").join(names.select(F.col("tag_id").alias("tag_id_2"), F.col("tag_name").alias("tag_2")), "tag_id_2")
    return x.select("tag_1", "tag_2", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query()
def init_tags(spark, folder):
    """The records' stored tags after the initial mode."""
    stores = store_copy(spark, folder, "seda_dataset", "seda_dataset_vectors", "tag_vocabulary", "tag_cooccurrence")
    pipelines.tag_run(stores, pipelines.INITIAL, F.lit("2026-01-01").cast("timestamp_ntz"))
    return current(stores.read("seda_dataset"), "id", "tags")


@query()
def increment_tags(spark, folder):
    """The records' stored tags after the incremental mode, which makes the vectors that are missing."""
    stores = store_copy(spark, folder, "seda_dataset", "seda_dataset_vectors", "tag_vocabulary", "tag_cooccurrence")
    pipelines.tag_run(stores, pipelines.INCREMENTAL, F.lit("2026-01-01").cast("timestamp_ntz"))
    return current(stores.read("seda_dataset"), "id", "tags")


@query()
def final_tags(spark, folder):
    """Seeds, candidates and tags of every record (initial mode: vocabulary and graph are built from the catalogue)."""
    return tags.tag_records(_texts(spark, folder), _vectors(spark, folder), *_initial(spark, folder))


def _new(spark, folder):
    """The records that need tags, and the vectors of those of them that have none."""
    records = _current(spark, folder, "dataset_name", "dataset_desc", "tags")
    new = records.join(tags.untagged(records), "id", "left_semi")
    return new, tags.missing_vectors(new, _vectors(spark, folder))


@query()
def missing_vectors(spark, folder):
    """Vectors the incremental mode makes, to be appended to the stored ones."""
    return _new(spark, folder)[1]


@query()
def incremental_tags(spark, folder):
    """Tags of the records that have none (incremental mode); missing vectors are made first."""
    new, made = _new(spark, folder)
    vectors = _vectors(spark, folder).unionByName(made.select("id", F.col("embedding").cast("array<double>").alias("v")))
    return _tagged(spark, folder, new, vectors).select("id", "tags")


@query(f"with {CUR} select id from cur where tags is null or len(list_filter(tags, lambda t: t is not null)) = 0 or list_contains(tags, '')")
def untagged_records(spark, folder):
    """Records that still need tags."""
    return tags.untagged(_current(spark, folder, "tags"))


@query(f"with {CUR} select id from cur where len(list_filter(tags, lambda t: t is not null)) > 0")
def tagged_records(spark, folder):
    """Records that have tags."""
    return tags.tagged(_current(spark, folder, "tags"))


@query("select row_number() over (order by tag_id, tag_name) - 1 idx, tag_id, tag_name, coalesce(tag_count, 0) tag_count from tag_vocabulary where tag_id is not null")
def vocabulary_index(spark, folder):
    """The vocabulary with its dense index."""
    return tags.indexed_vocabulary(table(spark, folder, "tag_vocabulary"))


@query("select count(*) n from tag_vocabulary")
def tag_count(spark, folder):
    """Number of tags."""
    return table(spark, folder, "tag_vocabulary").agg(F.count(F.lit(1)).alias("n"))


NEW = f"with {CUR}, f as (select distinct trim(lower(t)) tag from (select unnest(tags) t from cur) where t is not null), nt as (select tag from f where tag <> '' and tag not in (select tag_name from tag_vocabulary where tag_name is not null))"


def _found(spark, folder):
    return _current(spark, folder, "tags").select(F.explode("tags").alias("t")).select(F.trim(F.lower("t")).alias("tag")).where("tag is not null").distinct()


@query(f"{NEW} select tag from nt")
def new_tags(spark, folder):
    """Tags in use that the vocabulary lacks."""
    return tags.new_tags(_found(spark, folder), table(spark, folder, "tag_vocabulary"))


@query(f"""{NEW}, fc as (select trim(lower(t)) tag, count(*) n from (select unnest(tags) t from cur) where t is not null group by 1)
select tag_id, tag_name, coalesce(n, tag_count)::int tag_count from tag_vocabulary left join fc on fc.tag = tag_name
union all select ((select max(tag_id) from tag_vocabulary) + row_number() over (order by tag))::int, tag, n::int from fc where tag in (select tag from nt)""")
def vocabulary_upsert(spark, folder):
    """The vocabulary with fresh counts and the new tags."""
    counts = _current(spark, folder, "tags").select(F.explode("tags").alias("t")).where("t is not null").groupBy(F.trim(F.lower("t")).alias("tag")).agg(F.count(F.lit(1)).alias("n")).where("tag != ''")
    return tags.upsert_vocabulary(table(spark, folder, "tag_vocabulary"), counts, F.lit("2026-01-01").cast("timestamp_ntz")).drop("created_at")


@query(f"""with {CUR} select id, 'Pick the 2 tags that best name the topic of this dataset. Prefer the candidates; if none fits, propose a general term.
Answer with JSON only: {{"tags": [...], "new_tags": [...]}}

Name: ' || coalesce(dataset_name, '') || '
Description: ' || left(coalesce(dataset_desc, ''), 500) || '
Candidates: ' || coalesce(array_to_string(tags, ', '), '') prompt from cur""")
def selection_prompts(spark, folder):
    """Text for the language model, stored tags as candidates."""
    x = _current(spark, folder, "dataset_name", "dataset_desc", "tags")
    return x.select("id", tags.selection_prompt(F.col("dataset_name"), F.col("dataset_desc"), F.coalesce("tags", F.array().cast("array<string>"))).alias("prompt"))
