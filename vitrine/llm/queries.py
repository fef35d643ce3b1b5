"""The queries of this package: every operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import align, ann, decontaminate, htmltext, langid, licenses, packing, pii, simhash, spelling, substrings, tokenfiles, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, d=4)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from documents whose remainder is not 2; every document is predicted from its text alone."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(langid.fold() != 2))
    held = docs.select("doc_id", "text").withColumn("held_out", langid.fold() == 2)
    found = langid.predict(held, profiles)
    return found.select("doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents in training order and reads every sequence back from the files."""
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), key="epoch-0", length=2048)
    found = tokenfiles.read(spark, manifest)
    return found.select("shard", "slot", "byte_offset", F.col("number").alias("sequence_no"), "n_ids", F.crc32("ids").alias("ids_crc32"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives and reads every record back."""
    chunks = warc.read(spark, warc.write(table(spark, sf_dir, "pages")))
    return chunks.where("is_last").select("page_id", "payload_bytes", F.col("payload_digest"), "record_type", "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.when(text == "", "").otherwise(F.sha2(text, 256))
    return align.align(table(spark, sf_dir, "documents"), told=digest).withColumnRenamed("groups", "groups_sha256")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), noise=31)


def queries() -> dict[str, Query]:
    every = (op1_decontamination, op2_packing, op3_simhash, op4_substrings, op5_langid, op6_html, op7_tokenfiles, op8_warc, op9_pii, op10_ann, op11_alignment, op12_licenses, op13_spelling)
    return {f.__name__: f for f in every}


#: The records that pages become.
WARC_SQL = """
    with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
      g as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
    select page_id, payload_bytes, payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type, case when page_id <> first then first end as refers_to
    from p left join g using (payload_digest)"""

#: Nearest neighbours by brute force; products are summed in order of the components.
ANN_SQL = """
    with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
      s as (select q.vec_id as query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2]), lambda a, b: a + b) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from s
    qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20"""

#: Words of windows of 35 that start anywhere else too, by a digest of every window.
REPEATS_SQL = r"""
    with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
      h as (select doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) as h, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35),
      d as (select doc_id, i from h where h in (select h from h group by h having count(*) > 1)),
      gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from d),
      e as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
      k as (select e.doc_id, string_agg(x, ' ' order by e.i) filter (where g.i is null) as kept, count(*) filter (where g.i is not null) as n_removed from e left join gone g on g.doc_id = e.doc_id and g.i = e.i group by 1)
    select w.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)"""

#: Rank profiles and out-of-place distances; the checksum that deals documents out is worked bit by bit. It holds
#: while no more rows are labelled than a fit samples.
LANGUAGE_SQL = f"""
    with d as (select doc_id, lang, text is not null as has_text, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) as t,
        xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
          lambda a, x: list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda b, y: xor(b >> 1, case when b & 1 = 1 then 3988292384 else 0 end + 0 * y))), 4294967295) % 4 as fold from documents),
      m as (select doc_id, ' ' || t || ' ' as m from d where t <> ''),
      c as (select doc_id, m, unnest(range(1, length(m) + 1)) as i from m),
      g as (select doc_id, unnest([case when substr(m, i, 1) <> ' ' then substr(m, i, 1) end, case when i < length(m) then substr(m, i, 2) end, case when i < length(m) - 1 and substr(m, i + 1, 1) <> ' ' then substr(m, i, 3) end]) as g from c),
      n as (select doc_id, g, count(*) as n from g where g is not null group by 1, 2),
      r as (select doc_id, g, row_number() over (partition by doc_id order by n desc, length(g), g) - 1 as rank from n qualify rank < {langid.RANKS}),
      l as (select lang, g, sum(n) as n from n join d using (doc_id) where fold <> 2 and lang is not null and has_text group by 1, 2),
      p as (select lang, g, row_number() over (partition by lang order by n desc, length(g), g) - 1 as place from l qualify place < {langid.PROFILE}),
      s as (select r.doc_id, k.lang, count(*) as grams, sum(case when p.place is null then {langid.PROFILE} else abs(p.place - r.rank) end) as far
        from r cross join (select distinct lang from p) k left join p on p.lang = k.lang and p.g = r.g group by 1, 2),
      b as (select doc_id, arg_min(lang, (far, lang)) as lang, min(far) as far, min(grams) as grams from s group by 1)
    select d.doc_id, d.fold = 2 as held_out, coalesce(b.lang, 'und') as lang_pred, coalesce(1.0::double - b.far::double / ({langid.PROFILE} * b.grams)::double, 0.0::double) as score from d left join b using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.oracle(), "op4_substrings": REPEATS_SQL, "op5_langid": LANGUAGE_SQL, "op8_warc": WARC_SQL, "op10_ann": ANN_SQL, "op12_licenses": licenses.oracle()}
