"""The queries of this subpackage and, where SQL can say them on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm import cooccurrence, distinctive, encode, groups, incremental, language, neighbours, packing, subjects, survivors
from shelfmark.session import cut
from shelfmark.sources.tables import current, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The current row of every id, in SQL.
CURRENT = "(select * exclude (_rn) from (select *, row_number() over (partition by id order by harvested_at desc nulls last, ingested_at desc nulls last) _rn from seda_dataset where id is not null) where _rn = 1)"


# --- 4: distinctive terms
TERMS = f"""
runs as (select id, unnest(string_split_regex(coalesce(dataset_name, '') || ' ' || coalesce(dataset_desc, ''), '[^\\p{{L}}\\p{{N}}_]+')) r from {CURRENT}),
tf as (select id, lower(r) term, count(*) tf from runs where regexp_full_match(lower(r), '[a-z]{{3,}}') group by all),
st as (select term, count(*) df, sum(tf) cf from tf group by 1)"""


@query(f"""with {TERMS}, n as (select count(*) ids from {CURRENT})
select tf.id, term from tf join st using (term), n where tf >= 2 and df between 3 and greatest(5, ids // 500)""")
def p4_found(spark, folder):
    """Distinctive terms by the stated counts; (id, term)."""
    records = current(table(spark, folder, "seda_dataset"), "id", "dataset_name", "dataset_desc")
    most = F.greatest(F.lit(5), F.floor(F.col("ids") / 500))
    ids = F.broadcast(table(spark, folder, "seda_dataset").where("id is not null").agg(F.countDistinct("id").alias("ids")))  # one row
    x = distinctive.distinctive_terms(records, "dataset_name", "dataset_desc", min_tf=2)
    return x.join(ids, F.lit(True)).where((F.col("df") >= 3) & (F.col("df") <= most) & F.col("llr").isNotNull()).select("id", "term")


@query(f"""with {TERMS}, ln as (select id, sum(tf) len from tf group by 1), al as (select sum(cf) a from st),
k as (select id, term, tf, df, tf::double k11, (len - tf)::double k12, (cf - tf)::double k21, (a - cf - len + tf)::double k22 from tf join st using (term) join ln using (id), al),
g as (select *, 2 * (
 (case when k11 > 0 then k11 * ln(k11 / (k11 + k12 + k21 + k22)) else 0 end + case when k12 > 0 then k12 * ln(k12 / (k11 + k12 + k21 + k22)) else 0 end
 + case when k21 > 0 then k21 * ln(k21 / (k11 + k12 + k21 + k22)) else 0 end + case when k22 > 0 then k22 * ln(k22 / (k11 + k12 + k21 + k22)) else 0 end)
 - ((k11 + k12) * ln((k11 + k12) / (k11 + k12 + k21 + k22)) + case when k21 + k22 > 0 then (k21 + k22) * ln((k21 + k22) / (k11 + k12 + k21 + k22)) else 0 end)
 - ((k11 + k21) * ln((k11 + k21) / (k11 + k12 + k21 + k22)) + case when k12 + k22 > 0 then (k12 + k22) * ln((k12 + k22) / (k11 + k12 + k21 + k22)) else 0 end)) g from k)
select id, term, tf, df, round(case when k11 * (k21 + k22) >= k21 * (k11 + k12) then greatest(g, 0) else -greatest(g, 0) end, 4) llr from g""")
def p4_scores(spark, folder):
    """Every term of every record with its log-likelihood ratio."""
    records = current(table(spark, folder, "seda_dataset"), "id", "dataset_name", "dataset_desc")
    x = distinctive.distinctive_terms(records, "dataset_name", "dataset_desc")
    return x.withColumn("llr", F.round("llr", 4))


# --- 5: groups
LINKS = """
ids as (select lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) k, min(id) id from seda_dataset where id is not null group by 1),
e as (select distinct least(x.id, y.id) a, greatest(x.id, y.id) b from match_pairs m
 join ids x on x.k = lower(regexp_replace(m.id_1, '^\\s+|\\s+$', '', 'g')) join ids y on y.k = lower(regexp_replace(m.id_2, '^\\s+|\\s+$', '', 'g'))
 where x.id <> y.id and (m.stage in ('name', 'url', 'mapping') or (m.similarity >= 0.82 and not isnan(m.similarity))))"""


@query(f"""with recursive {LINKS}, both_ways as (select a, b from e union select b, a from e),
r(id, low) as (select a, a from both_ways union select w.b, r.low from r join both_ways w on w.a = r.id and r.low < w.b)
select min(low) group_id, id from r group by id""")
def p5_found(spark, folder):
    """(group_id, id) of every dataset in a group of two or more."""
    ids = table(spark, folder, "seda_dataset").select("id")
    return groups.components(groups.linked_pairs(table(spark, folder, "match_pairs"), ids)).select("group_id", "id")


# --- 6: items together
BASKETS = f"""
vocab as (select trim(regexp_replace(lower(tag_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) k, min(tag_id) item from tag_vocabulary where tag_id is not null group by 1 having k <> ''),
el as (select id, unnest(tags) t from {CURRENT}),
part as (select id, unnest(string_split_regex(t, '[,;|，；、\n]')) t from el),
it as (select distinct id, item from part join vocab on k = trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))),
n1 as (select item, count(*) c from it group by 1), tot as (select count(distinct id) n from it),
n12 as (select x.item a, y.item b, count(*) c from it x join it y on x.id = y.id and x.item < y.item group by 1, 2),
st as (select a tag_id_1, b tag_id_2, n12.c n12, p.c n1, q.c n2, n from n12 join n1 p on p.item = a join n1 q on q.item = b, tot)"""


def _baskets(spark, folder):
    return cooccurrence.known_items(current(table(spark, folder, "seda_dataset"), "id", "tags"), table(spark, folder, "tag_vocabulary"))


@query(f"with {BASKETS} select tag_id_1, tag_id_2 from st where n12 >= 5 and n12 * n >= 15 * n1 * n2")
def p6_found(spark, folder):
    """Pairs of tags found together at least 5 times and 15 times as often as by chance."""
    x = cooccurrence.pair_statistics(_baskets(spark, folder))
    return x.where("n12 >= 5 and n12 * n >= 15 * n1 * n2").select(F.col("item_1").alias("tag_id_1"), F.col("item_2").alias("tag_id_2"))


@query(f"""with {BASKETS} select tag_id_1, tag_id_2, n12, n1, n2, round(n12 / sqrt(n1::double * n2), 6) weight, round(n12::double * n / (n1::double * n2), 4) lift,
case when n12 < n1 then round((1 - n2 / n) / (1 - n12 / n1), 6) end conviction from st""")
def p6_weights(spark, folder):
    """Fresh weights of all pairs of tags that share a record."""
    x = cooccurrence.pair_statistics(_baskets(spark, folder))
    return x.select(F.col("item_1").alias("tag_id_1"), F.col("item_2").alias("tag_id_2"), "n12", "n1", "n2", F.round("weight", 6).alias("weight"), F.round("lift", 4).alias("lift"), F.round("conviction", 6).alias("conviction"))


@query(f"with {BASKETS} select tag_id, coalesce(c, 0) tag_count from tag_vocabulary left join n1 on item = tag_id where tag_id is not null")
def p6_counts(spark, folder):
    """Fresh counts of all tags of the vocabulary."""
    fresh = cooccurrence.item_counts(_baskets(spark, folder)).select(F.col("item").alias("tag_id"), F.col("n1"))
    return table(spark, folder, "tag_vocabulary").where("tag_id is not null").select("tag_id").join(fresh, "tag_id", "left").select("tag_id", F.coalesce("n1", F.lit(0)).alias("tag_count"))


# --- 2: survivors
def _survivors(spark, folder):
    records = current(table(spark, folder, "seda_dataset"), "id", "canonical_id", "harvested_at", *survivors.FIELDS)
    return survivors.survivors(records, table(spark, folder, "source_status"))


@query()
def p2_found(spark, folder):
    """(canonical_id, field_name, id): the record whose value survives."""
    return _survivors(spark, folder).select(F.col("group").alias("canonical_id"), F.col("field").alias("field_name"), "id")


@query()
def p2_consensus(spark, folder):
    """The existing value closest to each group's consensus, and its distance from the survivor."""
    return _survivors(spark, folder).select(F.col("group").alias("canonical_id"), F.col("field").alias("field_name"), F.col("nearest").alias("id"), "distance")


# --- 8: encoding
@query()
def p8_ids(spark, folder):
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode.encode(table(spark, folder, "documents"))


# --- 9: packing
@query()
def p9_containers(spark, folder):
    """Every document's container of each kind."""
    return packing.pack(encode.token_counts(table(spark, folder, "documents")), table(spark, folder, "pack_containers"))


# --- 10: languages
def _segments(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return cut(language.segments(documents, language.prototypes(documents)))


@query()
def p10_found(spark, folder):
    """(doc_id, segment_no, lang) of documents labelled wrongly, not at all, or in several languages."""
    return language.mislabelled(_segments(spark, folder)).select("doc_id", "segment_no", "lang")


@query()
def p10_segments(spark, folder):
    """Every segment of every document with its language and confidence."""
    return _segments(spark, folder).select("doc_id", "segment_no", "lang", F.round("confidence", 4).alias("confidence"), "sentences")


@query()
def p10_documents(spark, folder):
    """The main language of every document with sentences."""
    return language.document_languages(_segments(spark, folder)).withColumn("confidence", F.round("confidence", 4))


# --- 1: neighbours
@query()
def p1_found(spark, folder):
    """(id_1, id_2): one is among the 10 most similar to the other."""
    return neighbours.pairs(neighbours.neighbours(table(spark, folder, "seda_dataset_vectors"), 10))


@query()
def p1_neighbours(spark, folder):
    """The 10 nearest of every dataset with a usable embedding, with their cosine."""
    return neighbours.neighbours(table(spark, folder, "seda_dataset_vectors"), 10).withColumn("cosine", F.round("cosine", 6))


# --- 3: subjects
def _subjects(spark, folder):
    records = current(table(spark, folder, "seda_dataset"), "id", "dataset_name", "dataset_desc", "tags")
    return subjects.subjects(records, table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas"))


@query()
def p3_found(spark, folder):
    """(id, subject_code) of every record."""
    return _subjects(spark, folder).select("id", "subject_code")


@query()
def p3_makeup(spark, folder):
    """Records of each subject area."""
    n = _subjects(spark, folder).groupBy("subject_code").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "subject_areas").select("subject_code", "subject_name").join(n, "subject_code", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- 7: new batches
@query()
def p7_found(spark, folder):
    """(canonical_id, id) of every incoming record of a dataset accepted before."""
    records = current(table(spark, folder, "seda_dataset"), "id", "canonical_id", "dataset_name", "dataset_desc", "dataset_url")
    found, _ = incremental.recognise_all(incremental.history_of(records), incremental.batch_of(table(spark, folder, "incoming_dataset")))
    return found
