"""Parsers of histories and inscriptions, over texts written from the tables: the SQL twin gives what the
text was written from, so that parsing is held against the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import inscriptions, provenance, references, replay, sequences
from vitrine.operators.hierarchy import kept
from vitrine.plans.registry import query

CITIES = ["Amsterdam", "Paris", "London", "Delft"]
#: By remainder of the order's key: text, transfer type, role, position, qualifier, whether a price is named.
KINDS = [
    ("sale {n}, {c}, {d} {m} {y}, fl. {p}", "sale", "seller", "sender", None, "guilders"),
    ("donated by {n}, {c}, {y}", "gift", "donor", "sender", None, None),
    ("by descent to {n}, {c}, before {y}", "by_descent", "heir", "receiver", "before", None),
    ("on loan from {n}, {c}, {m} {y}", "loan", "lender", "sender", None, None),
    ("collection {n}, {c}, c. {y}", "collection", "collector", "receiver", "circa", None),
    ("{n}, {c}, {y}", "unknown", None, None, None, None),
]


def histories(t):
    """(o_custkey, history): the orders of a customer as a text, one segment an order, in order of their dates."""
    o = t.orders.where("o_custkey is not null and o_orderdate is not null")
    parts = {
        "n": F.concat(F.lit("Owner "), F.element_at(F.array(*(F.lit(x) for x in ("Alder", "Birch", "Cedar"))), (F.col("o_custkey") % 3 + 1).cast("int"))),
        "c": F.element_at(F.array(*(F.lit(x) for x in CITIES)), (F.col("o_orderkey") % 4 + 1).cast("int")),
        "d": F.dayofmonth("o_orderdate").cast("string"), "m": F.date_format("o_orderdate", "MMMM"), "y": F.year("o_orderdate").cast("string"), "p": F.floor("o_totalprice").cast("string"),
    }

    def written(template: str):
        pieces = [p for x in template.split("{") for p in ([x] if "}" not in x else [(x[0],), x[2:]]) if p]
        return F.concat(*(parts[p[0]] if isinstance(p, tuple) else F.lit(p) for p in pieces))

    text = F.lit("")
    for i, (template, *_) in enumerate(KINDS):
        text = F.when(F.col("o_orderkey") % len(KINDS) == i, written(template)).otherwise(text)
    segment = F.concat(F.when(F.col("o_orderstatus") == "P", "? ").otherwise(""), text)
    chain = o.select("o_custkey", F.struct("o_orderdate", "o_orderkey", segment.alias("s")).alias("e")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return chain.select("o_custkey", F.array_join("es.s", "; ").alias("history"))


def _kind(i: int) -> str:
    shown = [f"'{k[i]}'" if k[i] is not None else "null" for k in KINDS]
    return "case o_orderkey % 6 " + " ".join(f"when {n} then {x}" for n, x in enumerate(shown)) + " end"


PROV_EVENTS = f"""select o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as sequence, {_kind(1)} as transfer_type, {_kind(2)} as role, {_kind(3)} as position,
  'Owner ' || ['Alder','Birch','Cedar'][o_custkey % 3 + 1] as name, ['Amsterdam','Paris','London','Delft'][o_orderkey % 4 + 1] as location, year(o_orderdate)::int as date_year, {_kind(4)} as date_qualifier,
  case when o_orderkey % 6 = 0 then floor(o_totalprice) end as price_amount, {_kind(5)} as price_currency, o_orderstatus = 'P' as uncertain from orders where o_custkey is not null and o_orderdate is not null"""


def prov_events(t):
    return provenance.events(histories(t), "o_custkey", "history")


@query(PROV_EVENTS)
def prov_parse_events(t):
    """Histories parsed into events."""
    e = prov_events(t).withColumn("p", F.try_element_at("parties", F.lit(1)))
    return e.select("o_custkey", "sequence", "transfer_type", "p.role", "p.position", "p.name", "location", "date_year", "date_qualifier", "price_amount", "price_currency", "uncertain")


BOUNDS = "case date_qualifier when 'before' then null when 'circa' then date_year - 10 else date_year end"


@query(f"""with e as ({PROV_EVENTS}) select o_custkey, sequence, case when transfer_type <> 'gift' then name end as owner_name, case when transfer_type = 'gift' then name end as acquisition_from, transfer_type as acquisition_method, location, {BOUNDS} as begin_year, case date_qualifier when 'circa' then date_year + 10 else date_year end as begin_year_latest,
  lead({BOUNDS}) over (partition by o_custkey order by sequence) as end_year from e""")
def prov_periods(t):
    """Periods of ownership; each ends with the earliest year of the next event. A gift that names its donor
    alone has no owner yet."""
    p = provenance.periods(prov_events(t), "o_custkey")
    return p.select("o_custkey", "sequence", "owner_name", "acquisition_from", "acquisition_method", "location", "begin_year", "begin_year_latest", "end_year")


@query(f"""with e as ({PROV_EVENTS}), hit as (select distinct o_custkey from e where transfer_type = 'sale' and price_amount >= 400000), non as (select distinct o_custkey from e where transfer_type = 'loan' and location = 'Paris')
  select o_custkey, sequence, transfer_type, transfer_type = 'sale' and coalesce(price_amount >= 400000, false) as matched from e where o_custkey in (select * from hit) and o_custkey not in (select * from non)""")
def prov_search_chains(t):
    """Whole chains with a dear sale and without a loan in Paris, their events flagged."""
    dear = (F.col("transfer_type") == "sale") & (F.col("price_amount") >= 400000)
    lent = (F.col("transfer_type") == "loan") & (F.col("location") == "Paris")
    return provenance.chains(prov_events(t), "o_custkey", dear, lent).select("o_custkey", "sequence", "transfer_type", "matched")


@query(f"""with e as ({PROV_EVENTS}) select o_custkey, count(*) as n_events, min(date_year) as first_year, max(date_year) as last_year, array_to_string(list_sort(list(distinct transfer_type) filter (transfer_type <> 'unknown')), ',') as transfer_types,
  bool_or(price_amount is not null) as has_price from e group by 1""")
def prov_rollup(t):
    found = provenance.rollup(prov_events(t), "o_custkey")
    return found.select("o_custkey", "n_events", "first_year", "last_year", F.when(F.size("transfer_types") > 0, F.array_join("transfer_types", ",")).alias("transfer_types"), "has_price")


def operated(t):
    """Histories, and a log of operations for their events by the remainder of the sequence."""
    chain = kept(prov_events(t))  # parsed once
    own = chain.select("o_custkey", "sequence", "raw_text").withColumn("_m", F.col("sequence") % 7)
    stay = own.where("_m not in (3, 4)")  # splits look for their event among those left
    addressed = lambda rows: sequences.duplicate_ordinals(rows, F.col("raw_text"), "o_custkey", "sequence").drop("raw_text")
    cases = {1: ("set", "transfer_type", "exchange", None, 0), 2: ("correct", "location", "Lyon", "Paris", 0), 3: ("merge", None, "Delft", None, -1), 4: ("alternative", None, None, None, 1), 5: ("split", None, None, None, 0), 6: ("mark", None, None, None, 0)}
    table = t.spark.createDataFrame([(m, *c) for m, c in cases.items()], "_m int, op string, field string, value string, expected string, _by int")
    ops = addressed(own).where("_m in (1, 2, 3, 4, 6)").unionByName(addressed(stay).where("_m = 5")).join(F.broadcast(table), "_m")
    parts = F.when(F.col("op") == "split", F.array(F.lit("x"), F.lit("y")))
    none = F.lit(None).cast(chain.schema["parties"].dataType)
    return chain, ops.select("o_custkey", F.col("sequence").cast("long").alias("op_id"), "content_hash", "dup_ordinal", "dup_count", "op", "field", "value", "expected", none.alias("parties"), (F.col("sequence") + F.col("_by")).alias("target"), parts.alias("parts"), F.when((F.col("op") == "set") & (F.col("sequence") > 7), 0.5).otherwise(0.8).alias("confidence"))


@query(f"""with e as ({PROV_EVENTS}), k as (select *, sequence % 7 as m, max(sequence) over (partition by o_custkey) as top from e),
  c as (select o_custkey, sequence as s, unnest(case when m = 5 then ['x','y'] else [''] end) as part, case when m = 1 and sequence < 8 then 'exchange' when m = 6 then 'non_provenance' else transfer_type end as transfer_type,
    case when m = 2 and sequence < top then 'Delft' when m = 2 and location = 'Paris' then 'Lyon' else location end as location, uncertain or m = 5 as uncertain from k where m not in (3, 4))
  select o_custkey, row_number() over (partition by o_custkey order by s, part)::int as sequence, part, transfer_type, location, uncertain from c""")
def prv_replayed(t):
    """Curated changes on parsed histories: set, corrected, merged, marked and split events, chains numbered anew."""
    events, _ = replay.replayed(*operated(t), "o_custkey")
    return events.select("o_custkey", "sequence", F.when(F.col("raw_text").isin("x", "y"), F.col("raw_text")).otherwise("").alias("part"), "transfer_type", "location", "uncertain")


@query(f"""with e as ({PROV_EVENTS}), o as (select case sequence % 7 when 1 then 'set' when 2 then 'correct' when 3 then 'merge' when 4 then 'alternative' when 5 then 'split' when 6 then 'mark' end as op,
  case when sequence % 7 = 1 and sequence > 7 then 'unsure' when sequence % 7 = 2 and location <> 'Paris' then 'value_changed' else 'applied' end as status from e) select op, status, count(*) as n from o where op is not null group by 1, 2""")
def prv_replay_report(t):
    """How many operations of each kind were applied, and why others weren't."""
    return replay.replayed(*operated(t), "o_custkey")[1]


#: By remainder of the customer's key: what its history says; others have one of their own.
POINTERS = {1: "See the provenance of SK-A-{-1}", 2: "* For the provenance, zie inv. no. SK-A-{-1}.", 3: "For both the present painting and its pendant SK A {1}, with lot BK-17", 4: "same provenance as SK-A-{-1}", 5: "zie onder SK-A-{5000000}"}


def pointing(t):
    """(number, history): customers as works, half of which refer to others; two of ten to each other."""
    c = t.customer
    text = F.concat(F.lit("sold to Owner Alder, Delft, 1800, lot SK-A-"), "c_custkey")
    for m, template in POINTERS.items():
        head, by, tail = template.replace("{", "|").replace("}", "|").split("|")
        text = F.when(F.col("c_custkey") % 10 == m, F.concat(F.lit(head), (F.col("c_custkey") + int(by)).cast("string"), F.lit(tail))).otherwise(text)
    return c.select(F.concat(F.lit("SK-A-"), "c_custkey").alias("number"), text.alias("history"))


@query("""with recursive w as (select c_custkey as k, case c_custkey % 10 when 1 then c_custkey-1 when 2 then c_custkey-1 when 3 then c_custkey+1 when 4 then c_custkey-1 when 5 then c_custkey+5000000 end as up from customer),
  r as (select k, k as tip, 0 as hops from w union all select r.k, w.up, hops+1 from r join w on w.k = r.tip where up is not null and hops < 5),
  l as (select k, tip, hops from r qualify row_number() over (partition by k order by hops desc) = 1)
  select 'SK-A-'||k as number, case when hops < 5 then 'SKA'||tip end as source, case when hops < 5 then hops end::int as hops, case when hops = 0 then 'own' when hops = 5 then 'cycle' when not exists (select 1 from w where w.k = tip) then 'missing' else 'resolved' end as status from l""")
def prv_references(t):
    """Works whose history stands at another work, and where it is found."""
    return references.resolved(pointing(t), "number", "history").drop("target")


#: By remainder of the part's key: Dutch or English type, technique and placement, and what they mean.
MARKS = [("signatuur, recto, pen", "signature", "recto", "pen"), ("annotation, verso, pencil", "annotation", "verso", "pencil"), ("verzamelaarsmerk, verso, gestempeld", "collector's mark", "verso", "stamped"), ("opschrift", "inscription", None, None)]


def inscribed(t):
    """(p_partkey, marks): one segment that says the name of a part, and for some a collector's mark."""
    head = F.lit("")
    for i, (h, *_) in enumerate(MARKS):
        head = F.when(F.col("p_partkey") % len(MARKS) == i, h).otherwise(head)
    mark = F.when(F.col("p_size") > 25, F.concat(F.lit(" | collector's mark, verso: Lugt "), F.col("p_size").cast("string"), F.lit("a"))).otherwise("")
    return t.part.select("p_partkey", F.concat(head, F.lit(": ‘"), "p_name", F.lit("’"), mark).alias("marks"))


def _mark(i: int) -> str:
    shown = [("'" + m[i].replace("'", "''") + "'") if m[i] else "null" for m in MARKS]
    return "case p_partkey % 4 " + " ".join(f"when {n} then {x}" for n, x in enumerate(shown)) + " end"


INSC = f"""(select p_partkey, 1 as sequence, {_mark(1)} as normalized_type, {_mark(2)} as normalized_placement, {_mark(3)} as normalized_technique, p_name as said, null as lugt from part
  union all select p_partkey, 2, 'collector''s mark', 'verso', null, '', p_size || 'A' from part where p_size > 25)"""


def marks_of(t):
    return inscriptions.segments(inscribed(t), "p_partkey", "marks")


@query(f"select * from {INSC}")
def insc_parse(t):
    """Inscriptions parsed into segments."""
    number = F.try_element_at("collector_marks", F.lit(1))["number"]
    return marks_of(t).select("p_partkey", "sequence", "normalized_type", "normalized_placement", "normalized_technique", F.array_join("transcribed", " ").alias("said"), number.alias("lugt"))


@query(f"select p_partkey, count(*) as n_matched from {INSC} where normalized_placement = 'verso' and normalized_type = 'collector''s mark' group by 1")
def insc_search(t):
    """Parts with a segment that has type and placement at once."""
    return inscriptions.search(marks_of(t), "p_partkey", inscriptions.facets(types=["collector's mark"], placements=["verso"])).select("p_partkey", "n_matched")


@query(f"select p_partkey, coalesce(upper(lugt), lower(said)) as group_key, count(*) as occurrences from {INSC} group by 1, 2")
def insc_group(t):
    """Segments that say the same, folded."""
    return inscriptions.grouped(marks_of(t), "p_partkey").select("p_partkey", "group_key", "occurrences")
