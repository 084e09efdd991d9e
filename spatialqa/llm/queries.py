"""The registered queries of the thirteen operators and the SQL that must give the same rows."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spatialqa.llm import bpe, edits, filter_audit, hamming, licenses, mixture, ogg, packing, private, subspace, superkmers, vector_codes, zstd_quality
from spatialqa.llm.common import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op2_ogg_media(spark: SparkSession, folder: str) -> DataFrame:
    """Every text through an Ogg file and back."""
    docs = documents(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = ogg.read_media(ogg.add_media(docs))
    return stored.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                         F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"),
                         F.sha2("media", 256).alias("media_sha256"), "feature")


@query
def op3_forced_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the text of the ids."""
    path = tokenizer("byte_bpe_50k.json")
    ids = bpe.encode(documents(spark, folder).select("doc_id", "text"), path).drop("text")
    return bpe.decode(ids, path).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op4_window_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack_words(documents(spark, folder), tokenizer("word_bpe_49k.json"))


@query
def op8_super_k_mers(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated passages of 50 words removed."""
    out = superkmers.remove_repeats(documents(spark, folder))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op8_super_k_mers"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as s from w, unnest(range(1, len(words) - 48)) t(i)),
firsts as (select s, min(doc_id) as lo from windows group by s having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, p from (select doc_id, i from windows join firsts using (s) where doc_id > lo), unnest(range(i, i + 50)) t(p)),
each as (select doc_id, words[p] as word, p from w, unnest(range(1, len(words) + 1)) t(p)),
kept as (select doc_id, string_agg(word, ' ' order by p) as k, count(*) as n from each anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from w left join kept using (doc_id)"""


@query
def op9_hamming_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate documents."""
    return hamming.near_duplicates(documents(spark, folder))


ORACLES["op9_hamming_join"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, md5(array_to_string(words[i:i + 4], ' ')) as h from w, unnest(range(1, greatest(len(words) - 3, 2))) t(i) where len(words) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from documents union select r.doc_id, e.b from r join e on r.c = e.a),
m as (select doc_id, min(c) as c from r group by doc_id)
select m.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c as component_id, m.doc_id = c as kept from m left join n using (doc_id)"""


@query
def op10_subspace_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors of one label."""
    return subspace.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


ORACLES["op10_subspace_join"] = """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings),
g as (select vec_id, label, x from v where label is not null and x is not null and len(list_filter(x, lambda t: t is null or not isfinite(t))) = 0
      and list_sum(list_transform(x, lambda t: t * t)) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
      where list_cosine_similarity(a.x, b.x) >= 0.98),
r as (select vec_id, vec_id as c from v union select r.vec_id, l.b from r join l on r.c = l.a),
m as (select vec_id, min(c) as c from r group by vec_id),
k as (select a as vec_id, count(*) as n from l group by a)
select m.vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, m.vec_id = c as kept from m left join k using (vec_id)"""


@query
def op6_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text."""
    docs = documents(spark, folder)
    out_of = id_remainder(5) == 0
    names, table = mixture.learn(docs.where(~out_of))
    found = mixture.predict(docs.select("doc_id", "text"), names, table)
    return found.select("doc_id", out_of.alias("held_out"), "lang_pred", "score", "languages")


@query
def op7_zstd_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every text."""
    docs = documents(spark, folder).select("doc_id", "text")
    scored = zstd_quality.score(docs, zstd_quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    return scored.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in all documents."""
    return licenses.license_scan(documents(spark, folder))


@query
def op5_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document before and after edits drawn from its text."""
    docs = documents(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = edits.count_edits(docs.withColumn("edits", edits.revisions()), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_before", "n_after", "n_edits", "chars_encoded", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove in each of their orders, by source."""
    return filter_audit.audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


ORACLES["op11_filter_audit"] = r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
firsts as (select t, min(doc_id) as lo from w group by t),
g as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id),
f as (select w.part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
      [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
       regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > lo, false)] as fails from w join firsts using (t) left join g using (doc_id)),
c as (select part, fails, count(*) as n, sum(good) as good, sum(bad) as bad from f group by part, fails),
o as (select [a, b, c, d, e] as o from unnest(range(5)) t1(a), unnest(range(5)) t2(b), unnest(range(5)) t3(c), unnest(range(5)) t4(d), unnest(range(5)) t5(e)
      where len(list_distinct([a, b, c, d, e])) = 5),
x as (select part, o, array_to_string(list_transform(o, lambda z: substr('ABCDE', z + 1, 1)), '') as filter_order, n, good, bad, fails,
      coalesce(list_position(list_transform(o, lambda z: fails[z + 1]), true), 6) as gone from c, o),
r as (select part, filter_order, step, sum(case when gone > step then n else 0 end)::bigint as kept, sum(case when gone = step then n else 0 end)::bigint as removed,
      sum(case when gone < step and fails[o[step] + 1] then n else 0 end)::bigint as redundant,
      sum(case when fails[o[step] + 1] and len(list_filter(fails, lambda z: z)) = 1 then n else 0 end)::bigint as unique_fails,
      sum(case when gone = step then good else 0 end)::bigint as good_lost, sum(case when gone = step then bad else 0 end)::bigint as toxic_lost,
      any_value(o[step]) as filter from x, unnest(range(1, 6)) s(step) group by part, filter_order, step)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, filter))::bigint as shapley from r"""


@query
def op13_dual_tree_codes(spark: SparkSession, folder: str) -> DataFrame:
    """A code of 16 parts for every vector."""
    return vector_codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet"))


ORACLES["op13_dual_tree_codes"] = """
with v as (select vec_id, label, list_transform(embedding::double[], lambda t: floor(256 * t)::bigint) as x from embeddings
           where embedding is not null and len(list_filter(embedding, lambda t: t is null or not isfinite(t))) = 0),
p as (select vec_id, label, i as part, list_slice(x, i * len(x) // 16 + 1, (i + 1) * len(x) // 16) as x from v, unnest(range(16)) t(i)),
b0 as (select part, (row_number() over (partition by part order by vec_id) - 1) as entry, x from p qualify entry < 64),
d0 as (select vec_id, part, arg_min(entry, [list_sum(list_transform(list_zip(p.x, b0.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, entry]) as entry from p join b0 using (part) group by 1, 2),
s1 as (select part, entry, list(floor(s / n)::bigint order by j) as x from (select part, entry, j, sum(x[j]) as s, count(*) as n from p join d0 using (vec_id, part), unnest(range(1, len(x) + 1)) t(j) group by 1, 2, 3) group by 1, 2),
b1 as (select part, entry, coalesce(s1.x, b0.x) as x from b0 left join s1 using (part, entry)),
d1 as (select vec_id, part, arg_min(entry, [list_sum(list_transform(list_zip(p.x, b1.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, entry]) as entry from p join b1 using (part) group by 1, 2),
s2 as (select part, entry, list(floor(s / n)::bigint order by j) as x from (select part, entry, j, sum(x[j]) as s, count(*) as n from p join d1 using (vec_id, part), unnest(range(1, len(x) + 1)) t(j) group by 1, 2, 3) group by 1, 2),
b2 as (select part, entry, coalesce(s2.x, b1.x) as x from b1 left join s2 using (part, entry)),
d2 as (select vec_id, any_value(label) as label, part, min([list_sum(list_transform(list_zip(p.x, b2.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, entry]) as best from p join b2 using (part) group by vec_id, part),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b2),
c as (select vec_id, any_value(label) as label, string_agg(printf('%02x', best[2]), '' order by part) as code, sum(best[1])::bigint as error from d2 group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from c, h"""


@query
def op12_private_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    docs = documents(spark, folder).select("doc_id", "text")
    found = private.find(docs, private.learn(docs))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == private.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, private.KINDS), F.sha2(private.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), private.written(F.col("spans")).alias("spans"))
