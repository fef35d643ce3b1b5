"""Readers, exports, records and curation over the star tables: files are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.operators import aggregates, curation, details, provenance, vector
from vitrine.operators.hierarchy import shared_dir
from vitrine.plans.registry import Tables, query
from vitrine.sources import feeds


def folder(t: Tables) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(t.spark)}/files-{uuid.uuid4().hex}"


def written(t: Tables, lines: DataFrame) -> str:
    path = folder(t)
    lines.write.text(path)
    return path


# --- readers and sinks ---


@query("""select 'http://x/' || s_suppkey as subject, 'http://p/name' as predicate, 'Say "' || s_name || '"' as object, 'literal' as kind, case when s_suppkey % 2 = 0 then 'en' end as lang, null as datatype from supplier
  union all select 'http://x/' || s_suppkey, 'http://p/in', 'http://n/' || s_nationkey, 'uri', null, null from supplier""")
def src_triples(t):
    """Suppliers written as N-Triples, with remarks and broken lines, and read back."""
    names = t.supplier.selectExpr(r"""'<http://x/' || s_suppkey || '> <http://p/name> "Say \\"' || s_name || '\\""' || if(s_suppkey % 2 = 0, '@en', '') || ' .' as value""")
    links = t.supplier.selectExpr("'<http://x/' || s_suppkey || '> <http://p/in> <http://n/' || s_nationkey || '> .' as value")
    noise = t.nation.selectExpr("if(n_nationkey % 2 = 0, '# remark', '<http://broken> no') as value")
    return feeds.ntriples(t.spark, written(t, names.union(links).union(noise)))


@query("select 'http://x/' || s_suppkey as subject, n_name as object from supplier join nation on n_nationkey = s_nationkey")
def src_triples_followed(t):
    """A path through blank nodes."""
    lines = t.supplier.selectExpr("'<http://x/' || s_suppkey || '> <http://p/in> _:b' || s_nationkey || ' .' as value").union(t.nation.selectExpr("""'_:b' || n_nationkey || ' <http://p/called> "' || n_name || '" .' as value"""))
    return feeds.followed(feeds.ntriples(t.spark, written(t, lines)), ["http://p/in", "http://p/called"])


FEED = """'<record><header' || case when s_suppkey % 7 = 0 then ' status="deleted"' else '' end || '><identifier>oai:' || s_suppkey || '</identifier><datestamp>2024-01-0' || (s_suppkey % 9 + 1) || 'T00:00:00Z</datestamp><setSpec>n:' || s_nationkey || '</setSpec></header>' ||
 case when s_suppkey % 7 = 0 then '' else '<metadata><rdf:RDF xmlns:rdf="http://r"><dc:title xmlns:dc="http://d">' || s_name || '</dc:title></rdf:RDF></metadata>' end || '</record>' as value"""


@query("select 'oai:' || s_suppkey as identifier, s_suppkey % 7 = 0 as deleted, 'n:' || s_nationkey as sets, case when s_suppkey % 7 <> 0 then s_name end as title from supplier")
def src_feed_records(t):
    """A change feed with tombstones; titles by XPath."""
    rows = feeds.feed_records(t.spark, written(t, t.supplier.selectExpr(FEED)), {"title": "//title/text()"})
    return rows.select("identifier", "deleted", F.array_join("sets", ",").alias("sets"), F.try_element_at("title", F.lit(1)).alias("title"))


@query("select case when s_suppkey % 7 = 0 then null else s_name end as name, s_suppkey as id from supplier where s_suppkey % 7 <> 0 union all select n_name, -n_nationkey from nation where n_nationkey > 5")
def src_feed_upsert(t):
    """A batch of changes, repeated and out of order, into a table: last change counts, deletions go."""
    table = t.nation.select((-F.col("n_nationkey")).cast("long").alias("id"), F.col("n_name").alias("name"))
    added = t.supplier.selectExpr("s_suppkey as id", "s_name as name", "2 as at", "s_suppkey % 7 = 0 as deleted")
    older = t.supplier.selectExpr("s_suppkey as id", "'old' as name", "1 as at", "false as deleted")
    gone = t.nation.where("n_nationkey <= 5").selectExpr("cast(-n_nationkey as bigint) as id", "cast(null as string) as name", "3 as at", "true as deleted")
    return feeds.upserted(table, added.unionByName(older).unionByName(gone), "id", ["at"])


@query("select p_partkey as id, p_name as name from part where p_partkey % 11 <> 0")
def src_json_lines(t):
    """JSON lines; broken ones are left out."""
    lines = t.part.selectExpr("if(p_partkey % 11 = 0, '{\"id\": ', to_json(named_struct('id', p_partkey, 'name', p_name, 'more', p_size))) as value")
    return feeds.json_lines(t.spark, written(t, lines), "id long, name string")


@query("select strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at, 'srv' || user_id % 3 as server, event_type as level, 'client' as direction, '{\"id\":' || event_id || '}' as payload from events")
def src_log_lines(t):
    lines = t.events.selectExpr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") || ' [srv' || user_id % 3 || '] [' || event_type || '] Message from client: {\"id\":' || event_id || '}' as value")
    both = lines.union(t.nation.selectExpr("'noise ' || n_name as value"))
    return feeds.log_lines(t.spark, written(t, both)).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts")


@query("select s_suppkey, case when s_suppkey % 3 = 0 and s_suppkey % 2 = 1 then 'New ' || s_suppkey else s_name end as s_name, s_suppkey % 3 = 0 as updated from supplier")
def src_csv_update(t):
    """A CSV of corrections: keys that the table lacks and empty values change nothing."""
    path = folder(t)
    patch = t.supplier.where("s_suppkey % 3 = 0").selectExpr("s_suppkey", "if(s_suppkey % 2 = 1, 'New ' || s_suppkey, '') as s_name")
    curation.exported(patch.union(t.nation.selectExpr("cast(-1 - n_nationkey as bigint)", "'nobody'")), path)
    return feeds.updated_from_csv(t.supplier, path, "s_suppkey", ["s_name"]).select("s_suppkey", "s_name", "updated")


@query("select p_partkey as id, p_size as key from part")
def src_key_from_name(t):
    """Rows of files with a key in their folder's name."""
    path = folder(t)
    t.part.select(F.col("p_partkey").alias("id"), "p_size").write.partitionBy("p_size").json(path)
    rows = t.spark.read.schema("id long").option("recursiveFileLookup", True).json(path)
    return feeds.with_key_from_name(rows, r"p_size=(\d+)").select("id", F.col("key").cast("int").alias("key"))


@query("select p_partkey, p_name, null as p_brand from part")
def snk_size_guard(t):
    """Whole records only while their JSON is within a budget."""
    return feeds.size_guarded(t.part.select("p_partkey", "p_name", "p_brand"), ["p_partkey", "p_name"], 1000)


@query("select p_partkey, p_name, n_name, cast(n_regionkey as varchar) as n_regionkey from part left join nation on n_nationkey = p_partkey % 30")
def snk_wide_csv(t):
    """One wide row for each part and place, written as CSV and read back; a part without a place keeps its row."""
    path = folder(t)
    edges = t.part.selectExpr("p_partkey", "p_partkey % 30 as term")
    curation.exported(curation.wide(t.part, edges, t.nation.selectExpr("cast(n_nationkey as bigint) as term", "n_name", "n_regionkey"), "p_partkey", ["p_name"]), path)
    return t.spark.read.csv(path, header=True).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "n_name", "n_regionkey")


@query("select l_orderkey, l_linenumber, dense_rank() over (order by l_returnflag) as flag from lineitem")
def etl_dictionary(t):
    return feeds.dictionary(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", "flag")[0]


# --- records and projections ---


@query("select p_partkey, case when p_partkey % 7 = 0 then null when p_partkey % 4 = 0 then p_size::varchar else p_size || '–' || (p_size + 9) end as label from part")
def prj_date_label(t):
    start = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))
    return t.part.select("p_partkey", S.date_range_label(start, F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")).otherwise(F.col("p_size") + 9)).alias("label"))


@query("select p_partkey, case when p_size % 5 = 0 and p_partkey % 3 = 0 then null when p_size % 5 = 0 then 'w ' || p_partkey % 3 || ' cm' when p_partkey % 3 = 0 then 'h ' || p_size % 5 || ' cm' else 'h ' || p_size % 5 || ' cm × w ' || p_partkey % 3 || ' cm' end as label from part")
def prj_dimension_label(t):
    return t.part.select("p_partkey", S.dimension_label(F.col("p_size") % 5, F.col("p_partkey") % 3).alias("label"))


@query("select p_partkey, '[Title] ' || p_name || case when p_size > 25 then ' [Kind] ' || p_type else '' end as text from part")
def prj_source_text(t):
    rows = t.part.withColumn("kind", F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("  "))
    return rows.select("p_partkey", details.source_text({"p_name": "Title", "kind": "Kind"}).alias("text"))


@query("select p_partkey, p_size || '.' || p_partkey % 9 as room from part")
def prj_room(t):
    code = F.expr("if(p_size % 2 = 0, 'HG-', '') || p_size || '.' || p_partkey % 9 || '-B'")
    return t.part.select("p_partkey", details.room_hash(code).alias("room"))


@query("select l_partkey as art_id, count(*) filter (l_returnflag = 'A') as signatures, count(*) filter (l_returnflag = 'N') as inscriptions, count(*) as total from lineitem group by 1")
def prj_mark_counts(t):
    return details.mark_counts(t.lineitem.select(F.col("l_partkey").alias("art_id"), F.col("l_returnflag").alias("evidence_type_aat")), "art_id", "A", "N")


@query("select l_suppkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as variants from lineitem where l_returnflag <> case when l_suppkey % 2 = 0 then 'A' else 'N' end group by 1")
def prj_other_names(t):
    names = t.lineitem.select("l_suppkey", F.col("l_returnflag").alias("name"))
    labels = t.supplier.selectExpr("s_suppkey as l_suppkey", "if(s_suppkey % 2 = 0, 'A', 'N') as label")
    return details.other_names(names, labels, "l_suppkey").select("l_suppkey", F.array_join("variants", ",").alias("variants"))


@query("select l_partkey as art_id, count(*) as n, min(year(l_shipdate) - l_quantity::int) as first_year, max(year(l_shipdate)) as last_year, max(l_quantity::int) as longest, bool_or(l_tax = 0.0) as any_uncertain from lineitem group by 1")
def prj_periods(t):
    rows = t.lineitem.selectExpr("l_partkey as art_id", "year(l_shipdate) - cast(l_quantity as int) as begin_year", "year(l_shipdate) as end_year", "l_tax = 0.0 as uncertain")
    return details.period_rollup(rows, "art_id")


@query("select s_suppkey as k, case when s_suppkey % 2 = 0 then 'wikidata:Q' || s_suppkey || ' viaf:' || s_suppkey else 'viaf:' || s_suppkey end as equivalents from supplier")
def prj_crosswalk(t):
    """Ids at known authorities in their rank; others stay hidden."""
    ids = t.supplier.selectExpr("s_suppkey as k", "explode(array('http://viaf.org/' || s_suppkey, 'http://hidden.org/1', if(s_suppkey % 2 = 0, 'https://www.wikidata.org/entity/Q' || s_suppkey, null))) as uri").where("uri is not null")
    host = S.authority_of(F.col("uri"))
    named = ids.select("k", F.split_part(host["authority"], F.lit("."), F.lit(1)).alias("authority"), host["id"].alias("id"), "uri")
    shown = F.transform("equivalents", lambda e: F.concat(e["authority"], F.lit(":"), e["id"]))
    return details.crosswalk(named, "k", {"wikidata": 1, "viaf": 2}).select("k", F.array_join(shown, " ").alias("equivalents"))


@query("select s_suppkey as k, case when s_suppkey % 2 = 0 then 'http://hdl/' || s_suppkey end as handle, 'viaf:' || s_suppkey as others from supplier")
def prj_external_ids(t):
    ids = t.supplier.selectExpr("s_suppkey as k", "'viaf' as authority", "cast(s_suppkey as string) as id", "'u' as uri").union(t.supplier.where("s_suppkey % 2 = 0").selectExpr("s_suppkey", "'handle'", "'x'", "'http://hdl/' || s_suppkey"))
    return details.split_ids(ids, "k").select("k", "handle", F.array_join(F.transform("others", lambda o: F.concat(o["authority"], F.lit(":"), o["id"])), " ").alias("others"))


@query("select c_custkey as art_id, c_nationkey as creator_id, case c_custkey % 3 when 0 then 'painter' when 1 then 'engraver' end as role_id from customer")
def prj_production_rows(t):
    """Roles from pair rows, else by place where there are as many, else none."""
    creators = t.customer.selectExpr("c_custkey as art_id", "1 as place", "c_nationkey as creator_id")
    roles = t.customer.where("c_custkey % 3 <> 2").selectExpr("c_custkey as art_id", "1 as place", "'engraver' as role_id")
    pairs = t.customer.where("c_custkey % 3 = 0").selectExpr("c_custkey as art_id", "c_nationkey as creator_id", "'painter' as role_id", "0 as part_index")
    return details.paired_roles(creators, roles, pairs)


# --- scalar functions ---


@query("select p_partkey, round(p_size * case p_partkey % 4 when 0 then 0.1 when 1 then 1.0 when 2 then 2.54 end, 2) as cm from part")
def fn_converted(t):
    unit = F.expr("case p_partkey % 4 when 0 then ' MM ' when 1 then 'cm' when 2 then 'in' else 'ell' end")
    return t.part.select("p_partkey", S.converted(F.col("p_size"), unit, S.LENGTH_CM).alias("cm"))


@query("select p_partkey, case when p_size % 4 > 0 then round(10 + p_size * 50 / 100.0, 2) end as x, case when p_size % 4 > 0 then 25.0 end as h, case when p_size % 4 > 0 then p_size + 50 <= 100 end as valid from part")
def fn_region(t):
    text = F.expr("if(p_size % 4 = 0, 'px:1,2,3,4', 'pct:' || p_size || ',0,50,50')")
    r, outer = S.region(text), S.region(F.lit("pct:10,10,50,50"))
    return t.part.select("p_partkey", S.projected(r, outer)["x"].alias("x"), S.projected(r, outer)["h"].alias("h"), S.region_valid(r).alias("valid"))


@query("select p_partkey, case when length(p_name) > 9 then substr(p_name, 1, 6) || '...' else p_name end as cut, case when length(p_name) > 9 then split_part(p_name, ' ', 1) || ' […]' else p_name end as words from part")
def fn_shortened(t):
    return t.part.select("p_partkey", S.truncated(F.col("p_name"), 9).alias("cut"), S.snippet(F.col("p_name"), 9).alias("words"))


@query("select p_partkey, case when p_brand = 'Brand#7' then 1.0 else 1.0 / 3 end as j from part")
def fn_jaccard(t):
    a, b = F.array(F.lit("x"), F.col("p_brand")), F.array(F.lit("Brand#7"), F.lit("x"))
    return t.part.select("p_partkey", S.jaccard(a, b).alias("j"))


@query("select p_partkey, case when p_size % 3 = 0 then 1500 + p_size else 1400 + p_size end as earliest, case when p_size % 3 = 1 then 1400 + p_size else 1500 + p_size end as latest from part")
def fn_year_bounds(t):
    """A missing bound mirrors the other."""
    begins = F.expr("if(p_size % 3 = 0, array(), array((1400 + p_size) || '-01-01', 'n.d.'))").cast("array<string>")
    ends = F.expr("if(p_size % 3 = 1, array(), array((1500 + p_size) || '-12-31', '1500-01-01'))").cast("array<string>")
    return t.part.select("p_partkey", S.year_bounds(begins, ends).alias("b")).select("p_partkey", "b.*")


@query("select s_suppkey, 'cafe muller ' || lower(replace(s_name, '#', ' ')) as plain from supplier")
def fn_normalised(t):
    return t.supplier.select("s_suppkey", S.normalised(F.concat(F.lit(" Café–Müller, "), "s_name", F.lit("! "))).alias("plain"))


@query("""select p_partkey, y, case when y < 0 then ((-y - 1) // 100 + 1) else y // 100 + 1 end || case when (case when y < 0 then ((-y - 1) // 100 + 1) else y // 100 + 1 end) in (1, 21) then 'st' when (case when y < 0 then ((-y - 1) // 100 + 1) else y // 100 + 1 end) in (2, 22) then 'nd'
  when (case when y < 0 then ((-y - 1) // 100 + 1) else y // 100 + 1 end) = 3 then 'rd' else 'th' end || ' century' || case when y < 0 then ' BCE' else '' end as label from (select p_partkey, p_partkey % 2500 - 400 as y from part)""")
def fn_century(t):
    y = F.col("p_partkey") % 2500 - 400
    return t.part.select("p_partkey", y.alias("y"), S.century_label(y).alias("label"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'role' when 1 then 'llm:enrichment' when 2 then 'rule' end as tag from part")
def fn_method_tag(t):
    method = F.expr("case p_partkey % 4 when 0 then 'llm_structural:role' when 1 then 'llm_enrichment' when 2 then 'rule' else 'usual' end")
    return t.part.select("p_partkey", curation.method_tag(method, "usual").alias("tag"))


#: Pieces of histories, and their transfer types.
PIECES = [
    ("unsold in {n}", "sale"), ("commissioned by {n}", "commission"), ("war recuperation {n}", "recuperation"), ("stolen from {n}", "theft"), ("looted from {n}", "looting"), ("confiscated by {n}", "confiscation"), ("on loan to {n}", "loan"), ("sent to {n}", "transfer"),
    ("bequeathed by {n}", "bequest"), ("sold by {n}", "sale"), ("her posthumous sale, {n}", "sale"), ("purchased by {n}", "sale"), ("verwerving {n}", "sale"), ("from the dealer {n}", "sale"), ("the widow {n}", "widowhood"), ("by descent to {n}", "by_descent"), ("his sons {n}", "by_descent"),
    ("exchanged with {n}", "exchange"), ("collection {n}", "collection"), ("donated by {n}", "gift"), ("deposited at {n}", "deposit"), ("probate inventory of {n}", "inventory"), ("inventory of {n}", "collection"), ("{n}", "unknown"), ("Baron {n}", "unknown"), ("lot 12", "unknown"),
]
PIECE = "case p_partkey % 26 " + " ".join(f"when {i} then '{text}'" for i, (text, _) in enumerate(PIECES)) + " end"
KNOWN = "case p_partkey % 26 " + " ".join(f"when {i} then '{kind}'" for i, (_, kind) in enumerate(PIECES)) + " end"


@query(f"select p_partkey, {KNOWN} as transfer_type from part")
def fn_transfer_by_keywords(t):
    text = F.replace(F.expr(PIECE), F.lit("{n}"), F.lit("Vos"))
    return t.part.select("p_partkey", curation.transfer_of(text).alias("transfer_type"))


@query(f"select p_partkey, case p_partkey % 26 when 24 then 'collection' else {KNOWN} end as transfer_type from part where p_partkey % 26 <> 25")
def prv_refined(t):
    """Pieces that are none go, unknown ones take a type from keywords or signs."""
    rows = t.part.select("p_partkey", F.replace(F.expr(PIECE), F.lit("{n}"), F.lit("Vos")).alias("raw_text"), F.lit("unknown").alias("transfer_type"), F.lit(False).alias("is_cross_ref"), F.lit(False).alias("unsold"), F.lit(False).alias("gap"))
    return curation.refined(rows).select("p_partkey", "transfer_type")


@query("""select p_partkey, case when p_partkey % 3 = 1 then 'ambiguous' else 'ownership' end as transfer_category, case when p_partkey % 3 = 2 then p_size * 1000.0 end as price_amount, case when p_partkey % 3 = 2 then 'guilders' end as price_currency,
  case p_partkey % 3 when 0 then 'transfer_is_ownership' when 2 then 'unsold_price' else '' end as corrections from part""")
def prv_settled(t):
    rows = t.part.selectExpr("p_partkey", "if(p_partkey % 3 = 2, 'bought in at fl. ' || p_size || ',000', 'x') as raw_text", "if(p_partkey % 3 = 2, 'sale', 'transfer') as transfer_type", "if(p_partkey % 3 = 2, 'ownership', 'ambiguous') as transfer_category", "p_partkey % 3 = 1 as is_cross_ref", "p_partkey % 3 = 2 as unsold", "cast(null as double) as price_amount", "cast(null as string) as price_currency")
    return curation.settled(rows).select("p_partkey", "transfer_category", "price_amount", "price_currency", F.array_join("corrections", ",").alias("corrections"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'museum' when 1 then 'P. de Boer' end as receiver, case p_partkey % 4 when 0 then 'buyer' when 1 then 'dealer' end as role from part where p_partkey % 4 <> 3 union all select p_partkey, 'Vos', 'recipient' from part where p_partkey % 4 = 3")
def prv_receivers(t):
    """Receivers that a text names where no party received; a catalogue is none, and one that is there stays."""
    rows = t.part.selectExpr("p_partkey", "case p_partkey % 4 when 0 then 'fl. 500, to the museum, 1906' when 1 then 'to the dealer P. de Boer' when 2 then 'added to the catalogue' else 'given to the city' end as raw_text", "false as uncertain", "if(p_partkey % 4 = 3, array(named_struct('name', 'Vos', 'dates', cast(null as string), 'uncertain', false, 'role', 'recipient', 'position', 'receiver')), cast(array() as array<struct<name:string,dates:string,uncertain:boolean,role:string,position:string>>)) as parties")
    last = F.try_element_at("parties", F.lit(-1))
    return curation.with_receivers(rows).select("p_partkey", last["name"].alias("receiver"), last["role"].alias("role"))


# --- curation ---


@query("select p_partkey, case when p_brand <> 'Brand#3' then dense_rank() over (order by case when p_brand <> 'Brand#3' then p_brand else 'zzz' end) end as rights_id from part")
def etl_coded(t):
    """Few texts as codes; an empty one is no value."""
    rows = t.part.select("p_partkey", F.when(F.col("p_brand") != "Brand#3", F.col("p_brand")).otherwise("").alias("rights"))
    return curation.coded(rows, "rights", "rights_id")[0]


@query("select c_custkey, case c_custkey % 5 when 0 then 'agree' when 1 then 'mild' when 2 then 'wrong' when 3 then 'no_coverage' else 'agree' end as bucket from customer")
def etl_placed(t):
    at = lambda *v: F.expr("case c_custkey % 5 " + " ".join(f"when {i} then {x}" for i, x in enumerate(v)) + " end")
    bucket = curation.placed_as_expected(at("'NL'", "'NL'", "null", "null", "'NL'"), at("'nl'", "'be'", "'be'", "'xx'", "null"), at("true", "true", "true", "false", "true"))
    return t.customer.select("c_custkey", bucket.alias("bucket"))


@query("select l_partkey, arg_min(l_suppkey, (r, l_orderkey, l_suppkey)) as value, arg_min(tier, (r, l_orderkey, l_suppkey)) as tier from (select *, case l_linenumber when 1 then 3 when 2 then 2 when 3 then 1 end as r, case l_linenumber when 1 then 'inferred' when 2 then 'deterministic' when 3 then 'manual' end as tier from lineitem) where r is not null group by 1")
def etl_promoted(t):
    rows = t.lineitem.selectExpr("l_partkey", "l_orderkey", "l_suppkey as value", "case l_linenumber when 1 then 'inferred' when 2 then 'deterministic' when 3 then 'manual' else 'guessed' end as tier")
    return curation.promoted(rows, "l_partkey", "value", "tier", ["l_orderkey"])


@query("select s_suppkey + 1000 as id, s_nationkey as note, true as kept from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, s_nationkey, false from supplier where s_suppkey % 3 = 0")
def etl_reimported(t):
    """Ids of a new build by the natural key; rows whose entity is gone come back apart."""
    old, new = t.supplier.selectExpr("s_suppkey as id", "s_name"), t.supplier.where("s_suppkey % 3 <> 0").selectExpr("s_suppkey + 1000 as id", "s_name")
    kept, gone = curation.reimported(t.supplier.selectExpr("s_suppkey as id", "s_nationkey as note"), old, new, "id", "s_name")
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query("select p_partkey, 180 + p_size as duration, case p_partkey % 5 when 0 then 'artifact' when 1 then 'artifact' when 2 then 'legitimate' when 3 then 'legitimate' else 'uncertain' end as verdict from part where 180 + p_size > 200")
def etl_long_periods(t):
    at = lambda *v: "case p_partkey % 5 " + " ".join(f"when {i} then {x}" for i, x in enumerate(v)) + " end"
    rows = t.part.selectExpr("p_partkey", "1 as sequence", at("null", "null", "'Sint Bavo'", "'Vos'", "'Vos'") + " as owner_name", at("'sale'", "null", "null", "'commission'", "'sale'") + " as acquisition_method", at("1346", "1642", "1500", "1500", "1500") + " as begin_year", at("1346", "1642", "1500", "1500", "1500") + " + 180 + p_size as end_year", "1640 as date_earliest", "1645 as date_latest", "'a history' as text")
    return curation.long_periods(rows).select("p_partkey", "duration", "verdict")


@query("select p_partkey, p_name from part order by md5(p_partkey || '/42'), p_partkey limit 100")
def smp_uniform(t):
    return curation.sampled(t.part.select("p_partkey", "p_name"), "p_partkey", 100)


@query("select p_brand, count(distinct p_partkey) as n, count(distinct case when p_size > 25 then p_partkey end) as n_covered, round(count(distinct case when p_size > 25 then p_partkey end) / count(distinct p_partkey), 4) as share from part group by 1")
def agg_covered(t):
    return aggregates.covered(t.part, "p_brand", "p_partkey", F.col("p_size") > 25)


@query("select split_part(p_name, ' ', 1) as prefix, count(*) as n from part group by 1 having count(*) >= 3")
def agg_shared_prefixes(t):
    return aggregates.shared_prefixes(t.part.withColumn("t", F.replace("p_name", F.lit(" "), F.lit(" ("))), "t")


@query("select p_partkey, p_brand || '. ' || p_type || case when p_size > 25 then '. ' || p_name else '' end as text from part")
def vec_composite(t):
    rows = t.part.withColumn("p_name", F.when(F.col("p_size") > 25, F.col("p_name")))
    return rows.select("p_partkey", vector.composite_text(["p_name", "p_brand", "p_type"], ["p_name"]).alias("text"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'gift' when 1 then 'bequest' when 2 then 'sale' end as method from part")
def prv_credit_method(t):
    credit = F.expr("case p_partkey % 4 when 0 then 'Gift of ' || p_brand when 1 then 'Legaat ' || p_brand when 2 then 'Purchased with support' else p_brand end")
    return t.part.select("p_partkey", provenance.credited(credit).alias("method"))
