"""Statistics, text, vectors and similarity on the star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.functions import text as T
from vitrine.operators import aggregates as A
from vitrine.operators import postings, similar, text, vector
from vitrine.operators.hierarchy import shared_dir
from vitrine.plans.registry import query

EDGES = "(select l_orderkey, p_brand, p_type, p_size, p_name, l_partkey, l_suppkey, l_returnflag from lineitem join part on p_partkey=l_partkey)"


def edges(t):
    return t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size", "p_name"), "l_partkey")


@query(f"select p_brand as label, count(distinct l_orderkey) as n, round(100.0::double*count(distinct l_orderkey)/(select count(distinct l_orderkey) from lineitem), 1) as pct from {EDGES} group by 1")
def stats_vocab_dim(t):
    """Entities by label of a vocabulary term, with their share of the pool."""
    return A.dimension(edges(t), F.col("p_brand"), "l_orderkey")


@query("select s_suppkey, max(s_name) as label, count(distinct l_orderkey) as n from lineitem join supplier on s_suppkey=l_suppkey group by 1")
def stats_entity_dim(t):
    """Grouped by id, labelled by name."""
    lines = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("s_name").alias("label"), F.count_distinct("l_orderkey").alias("n"))


YEARS = "(select o_orderkey, (year(o_orderdate) - 1996)*57 + (o_orderkey%90)::int as y from orders)"


def years(t):
    return t.orders.select("o_orderkey", ((F.year("o_orderdate") - 1996) * 57 + (F.col("o_orderkey") % 90).cast("int")).alias("y"))


@query(f"select case when y>=0 then (y//100)*100 else -((-y-1)//100+1)*100 end::int as century, count(*) as n, min(case when y>=0 then (y//100+1)||case when (y//100+1)=1 then 'st' when (y//100+1)=2 then 'nd' when (y//100+1)=3 then 'rd' else 'th' end||' century' else ((-y-1)//100+1)||case when ((-y-1)//100+1)=1 then 'st' when ((-y-1)//100+1)=2 then 'nd' when ((-y-1)//100+1)=3 then 'rd' else 'th' end||' century BCE' end) as label from {YEARS} group by 1")
def stats_century(t):
    return years(t).groupBy(S.floor_century(F.col("y")).alias("century")).agg(F.count("*").alias("n"), F.min(S.century_label(F.col("y"))).alias("label"))


@query(f"select trunc(y/10.0)::int*10 as bin, count(*) as n from {YEARS} group by 1")
def stats_binned(t):
    return years(t).groupBy(S.binned(F.col("y"), 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("select (year(o_orderdate)//2)*2 as bin, count(*) as n from orders where year(o_orderdate) >= 1996 and year(o_orderdate) < 2000 group by 1")
def stats_clamped(t):
    rows = t.orders.withColumn("iso", F.date_format("o_orderdate", "yyyy-MM-dd")).where("iso >= '1996' and iso < '2000'")
    return rows.groupBy(S.binned(S.iso_year(F.col("iso")), 2).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("select count(distinct o_custkey) as with_bucket, (select count(*) from customer) - count(distinct o_custkey) as without_bucket, count(distinct o_orderpriority) as total_buckets from orders where o_totalprice > 450000 and o_custkey in (select c_custkey from customer)")
def stats_coverage(t):
    return A.coverage(t.customer, t.orders, F.when(F.col("o_totalprice") > 450000, F.col("o_orderpriority")), "c_custkey", "o_custkey")


@query(f"select p_type as label, count(distinct l_orderkey) as n, round(100.0::double*count(distinct l_orderkey)/(select count(distinct l_orderkey) from {EDGES} where l_returnflag='R'), 1) as pct from {EDGES} where l_returnflag='R' group by 1")
def stats_filtered_rowlevel(t):
    return A.dimension(edges(t).where("l_returnflag = 'R'"), F.col("p_type"), "l_orderkey")


@query("select s_nationkey as nation, count(distinct l_orderkey) as n from lineitem join supplier on s_suppkey=l_suppkey where s_acctbal < 0 group by 1")
def stats_gender_bound(t):
    """A filter on the person binds to the person of the bucket."""
    poor = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return t.lineitem.join(poor, "l_suppkey").groupBy("nation").agg(F.count_distinct("l_orderkey").alias("n"))


FACETS = """with f as (select unnest([{'dim':'brand','label':p_brand},{'dim':'type','label':p_type},{'dim':'size','label':p_size::varchar},{'dim':'initial','label':substr(p_name,1,1)}]) as p from part),
  c as (select p.dim as dim, p.label as label, count(*) as n from f group by 1, 2)"""


@query(f"{FACETS} select dim, label, n, round(100.0::double*n/sum(n) over (partition by dim), 1) as pct from c qualify row_number() over (partition by dim order by n desc, label) <= 5")
def facets_multi(t):
    return A.facets(t.part, {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size"), "initial": F.substring("p_name", 1, 1)}, 5)


@query("select o_orderpriority as label, count(*) as n, round(100.0::double*count(*)/sum(count(*)) over (), 1) as pct from orders where o_orderstatus='P' group by 1")
def facet_pct(t):
    return A.facets(t.orders.where("o_orderstatus = 'P'"), {"priority": F.col("o_orderpriority")}, 100).select("label", "n", "pct")


@query(f"""with c as (select s_nationkey, p_brand, count(distinct l_orderkey) as n from {EDGES} join supplier on s_suppkey=l_suppkey group by 1,2)
  select s_nationkey, p_brand, n, row_number() over (partition by s_nationkey order by n desc, p_brand)::int as rank from c qualify rank <= 3""")
def topn_per_group(t):
    counts = edges(t).join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").groupBy("s_nationkey", "p_brand").agg(F.count_distinct("l_orderkey").alias("n"))
    return A.top_per_group(counts, "s_nationkey", "p_brand", "n", 3)


@query(f"""with m as (select l_suppkey, count(*) as members, count(distinct l_orderkey) as orders_n from {EDGES} group by 1), ty as (select l_suppkey, p_type, count(*) as n from {EDGES} group by 1,2)
  select m.l_suppkey, members, orders_n, t.p_type as top_type, case when members >= 700 then 'umbrella' when t.n >= 0.95*members then 'uniform' when t.n >= 0.19*members then 'focused' else 'sub_collection' end as category
  from m join (select * from ty qualify row_number() over (partition by l_suppkey order by n desc, p_type)=1) t using (l_suppkey)""")
def set_stats(t):
    e = edges(t)
    members = e.groupBy("l_suppkey").agg(F.count("*").alias("members"), F.count_distinct("l_orderkey").alias("orders_n"))
    top = A.top_per_group(e.groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n")), "l_suppkey", "p_type", "n", 1)
    kind = F.when(F.col("members") >= 700, "umbrella").when(F.col("n") >= 0.95 * F.col("members"), "uniform").when(F.col("n") >= 0.19 * F.col("members"), "focused").otherwise("sub_collection")
    return members.join(top, "l_suppkey").select("l_suppkey", "members", "orders_n", F.col("p_type").alias("top_type"), kind.alias("category"))


@query("select l_partkey as term, count(distinct l_orderkey) as df, round(ln((select count(distinct l_orderkey) from lineitem)::double/count(distinct l_orderkey)), 6) as idf from lineitem group by 1")
def idf_df_table(t):
    return A.document_frequency(t.lineitem, "l_partkey", "l_orderkey").select("term", "df", F.round("idf", 6).alias("idf"))


@query("""select c_custkey, (case when c_acctbal > 0 then 3 else 0 end + case when c_mktsegment = 'BUILDING' then 3 else 0 end + least(coalesce(n, 0), 8) + least(coalesce(u, 0), 2))::bigint as score
  from customer left join (select o_custkey, count(*) as n, count(*) filter (o_orderpriority='1-URGENT') as u0, nullif(count(*) filter (o_orderpriority='1-URGENT'),0) as u from orders group by 1) on o_custkey=c_custkey""")
def importance_score(t):
    people = t.customer.select("c_custkey", (F.col("c_acctbal") > 0).alias("solvent"), (F.col("c_mktsegment") == "BUILDING").alias("builder"))
    return A.importance(people, "c_custkey", {"solvent": 3, "builder": 3}, [(t.orders, "o_custkey", "n", 8), (t.orders.where("o_orderpriority = '1-URGENT'"), "o_custkey", "u", 2)])


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
  select event_type, max(n) as n, min(value) as min_v, max(value) as max_v, max(value) filter (i = least(floor(n*50/100.0), n-1)) as p50, max(value) filter (i = least(floor(n*90/100.0), n-1)) as p90, max(value) filter (i = least(floor(n*99/100.0), n-1)) as p99 from r group by 1""")
def log_latency_percentiles(t):
    return A.nearest_rank(t.events, "event_type", "value")


BUCKETS = [1.0, 2.0, 5.0, 10.0, 20.0, 35.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 400.0, 600.0]


@query(f"""with e as (select unnest({BUCKETS}) as edge), b as (select event_type, coalesce((select min(edge) from e where value <= edge), 600.0) as edge from events where value is not null), c as (select event_type, edge, count(*) as n from b group by 1,2),
  r as (select *, sum(n) over (partition by event_type order by edge) as upto, sum(n) over (partition by event_type) as total from c)
  select event_type, min(edge::double) filter (upto*100 >= total*50) as p50, min(edge::double) filter (upto*100 >= total*95) as p95 from r group by 1""")
def hist_percentile(t):
    return A.histogram_percentile(t.events, "event_type", "value", BUCKETS)


@query("""select unnest([{'check':'urgent orders','n':(select count(*) from orders where o_orderpriority='1-URGENT'),'verdict':'PASS'},{'check':'free orders','n':(select count(*) from orders where o_totalprice<=0),'verdict':'PASS'},
  {'check':'open orders','n':(select count(*) from orders where o_orderstatus='O'),'verdict':case when (select count(*) from orders where o_orderstatus='O')>=100000000 then 'PASS' when (select count(*) from orders where o_orderstatus='O')>0 then 'WARN' else 'FAIL' end},{'check':'late orders','n':(select count(*) from orders where o_orderdate > timestamp '2100-01-01'),'verdict':'FAIL'},{'check':'all orders','n':(select count(*) from orders),'verdict':'SKIP'}], recursive := true)""")
def dq_audit(t):
    c = F.col
    return A.audit(t.orders, [
        ("urgent orders", c("o_orderpriority") == "1-URGENT", 1, None), ("free orders", c("o_totalprice") <= 0, 0, 0), ("open orders", c("o_orderstatus") == "O", 100_000_000, None),
        ("late orders", c("o_orderdate") > F.lit("2100-01-01").cast("timestamp"), 1, None), ("all orders", F.lit(True), None, None),
    ])


@query("""with m as (select p_partkey, p_name, unnest([case when regexp_matches(p_name,'^(red|blue|green)') then 'colour' end, case when regexp_matches(p_name,'(ring|rod)') then 'ring or rod' end, case when contains(p_name,' ') then 'two words' end]) as pattern from part)
  select pattern, count(*) as n from m where pattern is not null group by 1""")
def pattern_inventory(t):
    return A.pattern_inventory(t.part, "p_name", {"colour": "^(red|blue|green)", "ring or rod": "(ring|rod)", "two words": " "}).select("pattern", "n")


# --- text ---

#: Tokens of a document's text, accents removed.
PLAIN = "translate(lower(coalesce(text,'')), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy')"
TOKS = f"list_filter(string_split_regex({PLAIN}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
PAD = f"(' ' || array_to_string({TOKS}, ' ') || ' ')"


def searchable(t):
    return t.documents.select("doc_id", T.tokens(F.col("text")).alias("w")).withColumn("pad", T.padded(F.col("w")))


@query(f"select doc_id from documents where contains({PAD}, ' all rights reserved ')")
def txt_phrase(t):
    return searchable(t).where(T.has_phrase(F.col("pad"), "All rights, reserved")).select("doc_id")


@query(f"select doc_id from documents where contains({PAD}, ' apache license ') or contains({PAD}, ' gnu ')")
def txt_any(t):
    return searchable(t).where(T.clause(F.col("w"), F.col("pad"), {"any": ["Apache License", "GNU"]})).select("doc_id")


@query(f"select doc_id from documents where contains({PAD}, ' licens')")
def txt_prefix(t):
    return searchable(t).where(T.has_prefix(F.col("pad"), "licens")).select("doc_id")


@query(f"""with w as (select doc_id, {TOKS} as w from documents), p as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i from w)
  select distinct a.doc_id from p a join p b on a.doc_id=b.doc_id and a.t='license' and b.t in ('version','public') where abs(a.i-b.i) - 1 <= 1""")
def txt_near(t):
    return searchable(t).where(T.has_near(F.col("w"), [["license"], ["version", "public"]], 1)).select("doc_id")


@query(f"select doc_id from documents where contains({PAD}, ' the ') and (contains({PAD}, ' apache license ') or contains({PAD}, ' all rights')) and not contains({PAD}, ' gnu ')")
def txt_bool_dsl(t):
    s = searchable(t)
    wanted = {"must": [{"phrase": "the"}], "should": [{"phrase": "apache license"}, {"prefix": "all rights"}], "mustNot": [{"any": ["GNU"]}]}
    return s.where(T.boolean_query({"text": (F.col("w"), F.col("pad"))}, wanted)).select("doc_id")


@query(f"""with w as (select doc_id, {TOKS} as w from documents), f as (select doc_id, len(w) as len, len(list_filter(w, lambda x: x='rights')) as a, len(list_filter(w, lambda x: x='license')) as b from w),
  s as (select count(*) as n, avg(len) as al, count(*) filter (a>0) as da, count(*) filter (b>0) as db from f)
  select doc_id, round(-(case when ln((n-da+0.5)/(da+0.5))<=0 then 1e-6 else ln((n-da+0.5)/(da+0.5)) end*a*2.2/(a+1.2*(0.25+0.75*len/al)) + case when ln((n-db+0.5)/(db+0.5))<=0 then 1e-6 else ln((n-db+0.5)/(db+0.5)) end*b*2.2/(b+1.2*(0.25+0.75*len/al))), 6) as score
  from f, s where a>0 or b>0 order by score, doc_id limit 50""")
def txt_bm25_topk(t):
    found = text.bm25(t.documents, "doc_id", ["text"], ["rights", "license"])
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(50)


@query(f"""with w as (select doc_id, {TOKS} as w from documents), f as (select doc_id, len(w) as len, len(list_filter(w, lambda x: x='rights')) as a, len(list_filter(range(1, len(w)), lambda i: w[i]='apache' and w[i+1]='license')) as b from w),
  s as (select count(*) as n, avg(len) as al, count(*) filter (a>0) as da, count(*) filter (b>0) as db from f)
  select doc_id, round(-(case when ln((n-da+0.5)/(da+0.5))<=0 then 1e-6 else ln((n-da+0.5)/(da+0.5)) end*a*2.2/(a+1.2*(0.25+0.75*len/al)) + case when ln((n-db+0.5)/(db+0.5))<=0 then 1e-6 else ln((n-db+0.5)/(db+0.5)) end*b*2.2/(b+1.2*(0.25+0.75*len/al))), 6) as score
  from f, s where a>0 or b>0""")
def txt_bm25_postings(t):
    """Ranked search over stored postings: a word and a phrase."""
    folder = f"{shared_dir(t.spark)}/postings-{uuid.uuid4().hex}"
    postings.build(t.documents, "doc_id", ["text"], folder)
    found = postings.bm25(t.spark, folder, "doc_id", ["rights", "Apache License"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""with w as (select doc_id, {TOKS} as w from documents), u as (select unnest(list_distinct(w)) as term from w),
  b as (select unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) as term from w)
  select term, df, kind from (select term, count(*) as df, 'token' as kind from u group by 1 union all select term, count(*), 'bigram' from b group by 1) where df >= 20""")
def txt_tokens_bigrams(t):
    one = text.term_frequencies(t.documents, "doc_id", "text").withColumn("kind", F.lit("token"))
    two = text.term_frequencies(t.documents, "doc_id", "text", 2).withColumn("kind", F.lit("bigram"))
    return one.union(two).where("df >= 20")


def _strip_sql(c: str) -> str:
    for a, b in [("<style[^>]*>.*?</style>", " "), ("<script[^>]*>.*?</script>", " "), ("<[^>]*>", " "), (r"[a-z.#][\w.#-]*\s*\{[^}]*\}", " "), (r"\*\*([^*]+)\*\*", r"\1")]:
        c = f"regexp_replace({c}, '{a}', '{b}', 'gs')"
    for a, b in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " ", "&amp;": "&"}.items():
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(f"select page_id, {_strip_sql('html')} as plain from pages")
def html_strip(t):
    return t.pages.select("page_id", S.strip_html(F.col("html")).alias("plain"))


@query("select event_id, (props->>'$.k')::int as k from events")
def json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') as authority, nullif(regexp_extract(url, '^https?://[^?#]*/([A-Za-z0-9._~-]+)/?(?:[?#]|$)', 1), '') as id from pages")
def uri_authority(t):
    return t.pages.select("page_id", S.authority_of(F.col("url")).alias("a")).select("page_id", "a.authority", "a.id")


RULES = [("license", "(?i)licen[sc]e"), ("contact", "@|[+][0-9]"), ("upper", r"^[A-Z!,. ]+\z"), ("number", "[0-9]"), ("short", r"^.{0,20}\z")]


@query("select doc_id, " + "case " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in RULES) + " else 'other' end as category from documents")
def content_category(t):
    return t.documents.select("doc_id", S.content_category(F.col("text"), RULES).alias("category"))


@query("""with k as (select event_id, unnest(json_keys(props)) as path, props from events), v as (select event_id, path, json_type(props, '$.'||path) as type from k)
  select path, type, count(*) as n, count(distinct event_id) as docs, round(count(distinct event_id)::double/(select count(*) from events), 6) as coverage from (select event_id, path, case type when 'UBIGINT' then 'number' when 'BIGINT' then 'number' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' else lower(type) end as type from v) group by 1, 2""")
def schema_paths(t):
    from vitrine.sources.json_paths import path_profile

    return path_profile(t.events, "event_id", "props").select("path", "type", "n", "docs", F.round("coverage", 6).alias("coverage"))


# --- vectors ---


def stored_vector(t, key: int) -> list[float]:
    return t.embeddings.where(F.col("vec_id") == key).select("embedding").first()[0]


COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query(f"select e.vec_id, round(1 - {COS}, 5) as distance from embeddings e, (select embedding from embeddings where vec_id=0) q order by 1 - {COS}, vec_id limit 10")
def vec_knn(t):
    return vector.knn(t.embeddings, stored_vector(t, 0), 10, "vec_id", "embedding").select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"select e.vec_id, round(1 - {COS}, 5) as distance from embeddings e, (select embedding from embeddings where vec_id=0) q where e.label in (1,3) order by 1 - {COS}, vec_id limit 10")
def vec_knn_filtered(t):
    eligible = t.embeddings.where(F.col("label").isin(1, 3)).select("vec_id")
    return vector.knn(t.embeddings, stored_vector(t, 0), 10, "vec_id", "embedding", eligible).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"select e.vec_id, round({COS}, 3) as similarity from embeddings e, (select embedding from embeddings where vec_id=5) q where e.vec_id <> 5 order by {COS} desc, vec_id limit 12")
def vec_item_similar(t):
    return vector.similar_items(t.embeddings, 5, 12, "vec_id", "embedding")


@query("select vec_id, list_sum(list_transform(embedding, lambda x: trunc(greatest(least(x::double*127, 127), -127))::int))::bigint as checksum, trunc(greatest(least(embedding[1]::double*127, 127), -127))::int as first from embeddings")
def vec_quantise(t):
    q = t.embeddings.select("vec_id", vector.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"), F.col("q")[0].cast("int").alias("first"))


@query("select label, i::int as i, round(avg(x::double), 6) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by 1, 2")
def vec_centroids(t):
    return vector.centroids(t.embeddings, "label", "embedding").select("label", "i", F.round("mean", 6).alias("mean"))


# --- similarity ---

IDF = "(select l_partkey, ln((select count(distinct l_orderkey) from lineitem)::double/count(distinct l_orderkey)) as idf from lineitem group by 1)"
SHARED = f"(select l_orderkey as entity, round(sum(idf), 6) as score, count(*) as n_shared from (select distinct l_orderkey, l_partkey from lineitem where l_orderkey <> %s) join {IDF} using (l_partkey) where l_partkey in (select l_partkey from lineitem where l_orderkey = %s) group by 1)"
SEED = "(select min(l_orderkey) from lineitem)"


def seed_of(t):
    return t.lineitem.agg(F.min("l_orderkey")).first()[0]


@query(f"select * from {SHARED % (SEED, SEED)}")
def sim_idf_overlap(t):
    found = similar.idf_overlap(t.lineitem, seed_of(t), "l_orderkey", "l_partkey")
    return found.select("entity", F.round("score", 6).alias("score"), "n_shared")


STRENGTH = {"A": 1.0, "N": 0.6, "R": 0.3}
PAIRS = "(select distinct l_orderkey as e, l_returnflag as q, l_suppkey as c from lineitem)"


@query(f"""with p as {PAIRS}, i as (select c, ln((select count(distinct e) from p)::double/count(distinct e)) as idf from p group by 1)
  select p.e as entity, round(sum(case p.q when 'A' then 1.0 when 'N' then 0.6 when 'R' then 0.3 else 0 end::double * idf), 2) as score from p join p s on s.e = {SEED} and s.q=p.q and s.c=p.c join i on i.c=p.c where p.e <> {SEED} group by 1""")
def sim_pair_overlap(t):
    return similar.pair_overlap(t.lineitem, seed_of(t), "l_orderkey", "l_returnflag", "l_suppkey", STRENGTH)


PEERS = "(select a.o_orderkey as source, b.o_orderkey as peer, b.o_orderpriority as label from orders a join orders b on a.o_custkey = b.o_custkey)"
TIERS = {"1-URGENT": 6.0, "2-HIGH": 4.0, "3-MEDIUM": 4.0}


def peers(t):
    a = t.orders.select(F.col("o_orderkey").alias("source"), "o_custkey")
    b = t.orders.select(F.col("o_orderkey").alias("peer"), "o_custkey", F.col("o_orderpriority").alias("label"))
    return a.join(b, "o_custkey")


@query(f"select peer as entity, max(case label when '1-URGENT' then 6.0 when '2-HIGH' then 4.0 when '3-MEDIUM' then 4.0 else 2.0 end)::double as score from {PEERS} where source=(select min(o_orderkey) from orders) and peer <> source group by 1")
def sim_edge_tier(t):
    seed = t.orders.agg(F.min("o_orderkey")).first()[0]
    return similar.edge_tiers(peers(t), seed, "source", "peer", "label", TIERS, 2.0).select("entity", "score")


@query(f"""with p as {PAIRS}, parts as (select entity from {SHARED % (SEED, SEED)}), makers as (select distinct p.e as entity from p join p s on s.e={SEED} and s.c=p.c where p.e <> {SEED}), flags as (select distinct p.e as entity from p join p s on s.e={SEED} and s.q=p.q and s.c=p.c where p.e <> {SEED}),
  own as (select peer as entity from {PEERS} where source={SEED} and peer<>source), u as (select entity, 'parts' as ch from parts union all select entity, 'makers' from makers union all select entity, 'pairs' from flags union all select entity, 'peers' from own)
  select entity, count(distinct ch) as n_channels from u group by 1 having count(distinct ch) >= 2""")
def sim_pooled(t):
    seed = seed_of(t)
    channels = {
        "parts": similar.idf_overlap(t.lineitem, seed, "l_orderkey", "l_partkey"),
        "makers": similar.idf_overlap(t.lineitem, seed, "l_orderkey", "l_suppkey"),
        "pairs": similar.pair_overlap(t.lineitem, seed, "l_orderkey", "l_returnflag", "l_suppkey", STRENGTH),
        "peers": similar.edge_tiers(peers(t), seed, "source", "peer", "label", TIERS, 2.0),
    }
    return similar.pooled(channels, 2).select("entity", "n_channels")


# --- views ---


@query("""select c_custkey, c_name, (select count(*) from orders where o_custkey=c_custkey) as n_orders, (select array_to_string(list(o_orderkey::varchar order by o_orderkey), ',') from (select o_orderkey from orders where o_custkey=c_custkey order by o_orderkey limit 25)) as preview,
  (select round(max(o_totalprice),2) from orders where o_custkey=c_custkey) as dearest from customer""")
def detail_view(t):
    """An entity with previews of at most 25 linked rows and their total."""
    from vitrine.plans.catalogue import preview

    linked = preview(t.orders, "o_custkey", "o_orderkey", 25).withColumnRenamed("o_custkey", "c_custkey")
    top = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("dearest"))
    out = t.customer.join(linked, "c_custkey", "left").join(top, "c_custkey", "left")
    shown = F.nullif(F.array_join(F.transform("preview", lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("c_custkey", "c_name", F.coalesce("total", F.lit(0)).alias("n_orders"), shown.alias("preview"), "dearest")


@query("""select c_custkey, c_name, n as n_works from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey=c_custkey
  where c_mktsegment='BUILDING' and c_acctbal between 0 and 5000 and c_custkey in (select o_custkey from orders join lineitem on l_orderkey=o_orderkey join supplier on s_suppkey=l_suppkey where s_nationkey=3) order by n desc, lower(c_name) limit 40""")
def persons_search(t):
    """People by their own attributes and by what their works link to, busiest first."""
    makers = t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    works = t.lineitem.join(makers, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    there = t.orders.join(works, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_works"))
    people = t.customer.where("c_mktsegment = 'BUILDING' and c_acctbal between 0 and 5000").join(there, "c_custkey", "left_semi")
    return people.join(counts, "c_custkey").select("c_custkey", "c_name", "n_works").orderBy(F.desc("n_works"), F.lower("c_name")).limit(40)


@query("select l_partkey, count(distinct l_orderkey) as n_citing from lineitem group by 1")
def biblio_reverse(t):
    return t.lineitem.select("l_partkey", "l_orderkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n_citing"))
