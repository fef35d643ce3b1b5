"""Linked data over the star tables: parts are written as JSON-LD lines of differing shape, suppliers as XML records with
entities of their own, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.hierarchy import shared_dir
from vitrine.plans.registry import Tables, query
from vitrine.sources import linked, records

G = linked.GETTY
#: A list of one, or that one; an id, or an object with it: parts with even keys have the first.
ONE = lambda x: f"if(p_partkey % 2 = 0, to_json(array({x})), to_json({x}))"
ID = lambda x: f"if(p_partkey % 2 = 0, to_json(named_struct('id', {x})), concat('\"', {x}, '\"'))"
NAME = lambda text, lang, kind: f"named_struct('type', 'Name', 'content', {text}, 'language', array(named_struct('id', '{G}{linked.LANGUAGES[lang]}')), 'classified_as', array(named_struct('id', '{G}{linked.TITLES[kind]}')))"
SAID = lambda kind, text: f"named_struct('classified_as', array(named_struct('id', '{G}{linked.STATEMENTS[kind]}')), 'content', {text})"
SIZE = lambda n, value, unit: f"named_struct('value', {value}, 'unit', named_struct('id', {unit}), 'classified_as', array(named_struct('id', '{G}{n}')))"
MAKER = "named_struct('type', 'AttributeAssignment', 'assigned_property', 'carried_out_by', 'assigned', array(named_struct('type', 'Person', 'id', concat('http://x/', p_type))), 'classified_as', array(named_struct('id', concat('http://x/', p_brand))))"
DOC = f"""concat('{{"identified_by":', to_json(array({NAME("p_name", "en", "brief")}, {NAME("p_type", "nl", "full")})),
  ',"dimension":', to_json(array({SIZE(linked.SIZES["height"], "p_size", f"if(p_partkey % 3 = 0, '{G}300379097', '{G}300379098')")}, {SIZE(linked.WEIGHT["weight"], "p_size", f"'{G}300379226'")})),
  ',"referred_to_by":', {ONE(SAID("inscription", "p_name"))},
  ',"produced_by":{{"part":[{{"technique":[', {ID("concat('http://x/', p_brand)")}, '],"assigned_by":', to_json(array({MAKER})), '}}],"took_place_at":', {ID("'http://x/here'")}, '}}',
  ',"attributed_by":', {ONE("named_struct('carried_out_by', array(named_struct('id', concat('http://x/', p_type))), 'classified_as', array(named_struct('id', 'http://x/report', 'notation', array(named_struct('@language', 'nl', '@value', p_type), named_struct('@language', 'en', '@value', p_brand)))), 'timespan', named_struct('begin_of_the_begin', cast(p_size as string)))")},
  ',"modified_by":', {ONE("named_struct('carried_out_by', array(concat('http://x/', p_brand)), 'referred_to_by', array(named_struct('content', p_name)))")},
  ',"equivalent":[', {ID("concat('http://www.wikidata.org/entity/Q', p_partkey)")}, '],"part_of":', {ONE("named_struct('type', 'HumanMadeObject', 'id', concat('http://x/', p_brand))")}, '}}')"""


def objects(t: Tables) -> DataFrame:
    """Documents from lines of text; a fifth as many lines that are none."""
    from uuid import uuid4

    path = f"{shared_dir(t.spark)}/objects-{uuid4().hex}"
    lines = t.part.selectExpr(f"concat(p_partkey, '\\t', {DOC}) as value").union(t.part.where("p_partkey % 5 = 0").selectExpr("concat(p_partkey, '\\t{broken') as value"))
    lines.write.text(path)
    cut = t.spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("long").alias("p_partkey"), F.expr("substring(value, instr(value, '\t') + 1)").alias("json"))
    return linked.documents(cut, "p_partkey", "json")


@query("select p_partkey, 0 as seq, p_name as title, 'en' as lang, 'brief' as qualifier from part union all select p_partkey, 1, p_type, 'nl', 'full' from part")
def src_linked_titles(t):
    return linked.titles(objects(t), "p_partkey")


@query("select p_partkey, case when p_partkey % 3 = 0 then round(p_size * 0.1::double, 2) else p_size::double end as height_cm, p_size * 1000.0::double as weight_g from part")
def src_linked_dimensions(t):
    return linked.dimensions(objects(t), "p_partkey").select("p_partkey", "height_cm", "weight_g")


@query("select p_partkey, 'inscription' as kind, p_name as statement from part where p_name <> ''")
def src_linked_statements(t):
    return linked.statements(objects(t), "p_partkey")


@query("""select p_partkey, 0 as part, 'role' as kind, p_brand as value, null::varchar as maker from part union all select p_partkey, 0, 'qualifier', p_brand, null from part union all select p_partkey, 0, 'maker', p_type, null from part
  union all select p_partkey, 0, 'attribution', p_brand, p_type from part union all select p_partkey, -1, 'place', 'here', null from part""")
def src_linked_production(t):
    return linked.production(objects(t), "p_partkey")


@query("select p_partkey, 0 as seq, p_type as examiner, 'http://x/report' as report, p_brand as report_label, p_size::varchar as begins from part")
def src_linked_examinations(t):
    return linked.examinations(objects(t), "p_partkey").select("p_partkey", "seq", "examiner", "report", "report_label", "begins")


@query("select p_partkey, 0 as seq, 'http://x/' || p_brand as by, p_name as description from part")
def src_linked_treatments(t):
    return linked.treatments(objects(t), "p_partkey").select("p_partkey", "seq", "by", "description")


@query("select p_partkey, 'wikidata.org' as authority, 'Q' || p_partkey as id, 'http://www.wikidata.org/entity/Q' || p_partkey as uri from part")
def src_linked_ids(t):
    from vitrine.functions.scalar import authority_of

    return linked.other_ids(objects(t), "p_partkey", authority_of).select("p_partkey", "authority.authority", "authority.id", "uri")


@query("select p_partkey, 'part_of' as kind, 'http://x/' || p_brand as id from part")
def src_linked_wholes(t):
    return linked.links(objects(t), "p_partkey")


#: A record of a supplier: every seventh names an entity that its record lacks, every eleventh is deleted; a nation is part of
#: its region, which is part of the nation again.
RECORD = """concat('<record><header', if(s_suppkey % 11 = 0, ' status="deleted"', ''), '><identifier>oai:', s_suppkey, '</identifier><datestamp>2024-01-01</datestamp><setSpec>all</setSpec></header>', if(s_suppkey % 11 = 0, '', concat(
  '<metadata><RDF><Aggregation><aggregatedCHO><ProvidedCHO about="http://x/', s_suppkey, '"><identifier>', s_name, '</identifier><title lang="nl">nl ', s_name, '</title><title lang="en">', s_name, '</title><creator resource="', if(s_suppkey % 7 = 0, 'gone', 'n'), '"/>',
  '<subject resource="n"/><subject resource="c"/><subject resource="gone"/></ProvidedCHO></aggregatedCHO></Aggregation><Place about="n"><prefLabel lang="en">', n_name, '</prefLabel><isPartOf resource="r"/></Place>',
  '<Place about="r"><prefLabel>', r_name, '</prefLabel><isPartOf resource="n"/></Place><Concept about="c"><altLabel>', n_nationkey, 'A</altLabel></Concept></RDF></metadata>')), '</record>')"""


def harvested(t: Tables) -> DataFrame:
    from uuid import uuid4

    path = f"{shared_dir(t.spark)}/records-{uuid4().hex}"
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows.selectExpr(f"{RECORD} as value").write.text(path)
    return records.resolved(records.records(t.spark, path))


@query("""select case when s_suppkey % 11 = 0 then 'oai:' || s_suppkey else 'http://x/' || s_suppkey end as about, case when s_suppkey % 11 <> 0 then s_name end as title, s_suppkey % 11 = 0 as deleted,
  case when s_suppkey % 11 <> 0 and s_suppkey % 7 <> 0 then n_name end as creator from supplier join nation on s_nationkey = n_nationkey""")
def src_record_fields(t):
    return records.fields(harvested(t)).select("about", "title", "deleted", "creator")


@query("""with s as (select 'http://x/' || s_suppkey as about, n_name, n_nationkey, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey % 11 <> 0)
  select about, 0 as seq, n_name as label, 'place' as kind, null::varchar as code, r_name as within from s union all select about, 1, n_nationkey || 'A', 'concept', n_nationkey || 'A', '' from s""")
def src_record_subjects(t):
    return records.subjects(harvested(t)).select("about", "seq", "label", "kind", "code", F.array_join("within", ",").alias("within"))
