"""Filters, joins and sequences on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.operators import filters, geo, hierarchy, ranking, sequences
from vitrine.plans.registry import Tables, query

LAT, LON = "((%s * 7) %% 140 - 70)", "((%s * 13) %% 340 - 170)"


def place(key: str):
    """Made-up coordinates of a nation."""
    k = F.col(key)
    return ((k * 7) % 140 - 70).cast("double"), ((k * 13) % 340 - 170).cast("double")


def km_sql(a: str, b: str, c: str, d: str) -> str:
    return f"2*6371.0*asin(sqrt(least(1.0, power(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*power(sin(radians({d}-({b}))/2),2))))"


NATION_PLACES = f"(select n_nationkey, n_regionkey, {LAT % 'n_nationkey'}::double as lat, {LON % 'n_nationkey'}::double as lon from nation)"


def nations(t: Tables):
    lat, lon = place("n_nationkey")
    return t.nation.withColumn("lat", lat).withColumn("lon", lon)


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_suppkey in (1,2,3)) and p_partkey in (select l_partkey from lineitem where l_suppkey in (4,5,6))")
def flt_vocab_and(t):
    """Parts with line items of both of two groups of suppliers."""
    return filters.linked_to_all(t.part, t.lineitem, "p_partkey", "l_partkey", "l_suppkey", [[1, 2, 3], [4, 5, 6]]).select("p_partkey", "p_name")


@query("select n_nationkey, n_name from nation where n_nationkey in (select c_nationkey from customer where c_acctbal > 9900 union select s_nationkey from supplier where s_acctbal > 9900)")
def flt_vocab_multi_field(t):
    rich = [t.customer.where("c_acctbal > 9900").select("c_nationkey"), t.supplier.where("s_acctbal > 9900").select("s_nationkey")]
    return filters.linked_by_any(t.nation, "n_nationkey", rich).select("n_nationkey", "n_name")


@query(r"select p_partkey, p_name from part where regexp_matches(p_name, '(?i)\bring\b')")
def flt_word(t):
    return t.part.where(filters.word(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where p_name ilike '%idge%'")
def flt_substring(t):
    return t.part.where(filters.substring(F.col("p_name"), "IDGE")).select("p_partkey", "p_name")


@query("""with l as (select distinct p_name from part), x as (select p_name, case when contains(' '||p_name||' ', ' red rings ') then 1
  when regexp_matches(p_name, '\\b(red|reds|reding|reded)\\b') and regexp_matches(p_name, '\\b(rings|ring|ringing|ringed)\\b') then 2
  when contains(replace(p_name,' ',''), 'redrings') then 3 end as tier from l)
  select p_name, tier from x where tier = (select min(tier) from x)""")
def flt_tiered_label(t):
    return filters.tiered_label(t.part.select("p_name").distinct(), "p_name", "red rings").select("p_name", "tier")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='R' and l_linestatus='F')")
def flt_same_row(t):
    return filters.same_row(t.orders, t.lineitem, "o_orderkey", "l_orderkey", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).select("o_orderkey")


SPANS = "(select l_orderkey, min(year(l_shipdate))::int as lo, max(year(l_shipdate))::int as hi from lineitem group by 1)"


def spans(t):
    y = F.year("l_shipdate")
    return t.lineitem.groupBy("l_orderkey").agg(F.min(y).alias("lo"), F.max(y).alias("hi"))


@query(f"select l_orderkey, lo, hi from {SPANS} where lo <= 1997 and hi >= 1996")
def flt_interval_overlaps(t):
    return spans(t).where(filters.interval(F.col("lo"), F.col("hi"), 1996, 1997, "overlaps"))


@query(f"select l_orderkey, lo, hi from {SPANS} where lo >= 1996 and hi <= 1999")
def flt_interval_within(t):
    return spans(t).where(filters.interval(F.col("lo"), F.col("hi"), *S.parse_years("1996")[:1], 1999, "within"))


@query(f"select l_orderkey, lo, hi from {SPANS} where lo + hi between 2*1997 and 2*1998")
def flt_interval_midpoint(t):
    return spans(t).where(filters.interval(F.col("lo"), F.col("hi"), 1997, 1998, "midpoint"))


@query("select c_custkey, c_name from customer where c_name glob 'Customer#00000001*'")
def flt_glob(t):
    return t.customer.where(filters.glob(F.col("c_name"), "Customer#00000001*")).select("c_custkey", "c_name")


@query("select l_orderkey, l_linenumber, l_partkey, l_discount from lineitem where l_discount <= 0.03 and l_discount > 0 order by nullif(l_discount,0) desc nulls last, l_orderkey, l_linenumber, l_partkey limit 500")
def flt_range_sentinel(t):
    rows = t.lineitem.where(filters.measured(F.col("l_discount"), None, S.parse_range("-0.03")[1]))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").orderBy(F.nullif("l_discount", F.lit(0.0)).desc_nulls_last(), "l_orderkey", "l_linenumber", "l_partkey").limit(500)


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def flt_presence_semi(t):
    return filters.presence(t.customer, t.orders, "c_custkey", "o_custkey", True).select("c_custkey")


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def flt_absence_anti(t):
    return filters.presence(t.documents, t.labels, "doc_id", "doc_id", False).select("doc_id")


@query("select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='A' and l_quantity>=45 and year(l_shipdate) between 1997 and 1998)")
def flt_event_row(t):
    one = (F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 45) & F.year("l_shipdate").between(1997, 1998)
    return filters.same_row(t.orders, t.lineitem, "o_orderkey", "l_orderkey", one).select("o_orderkey", "o_totalprice")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey=c_custkey and o_orderpriority='1-URGENT' and o_orderstatus='F')")
def flt_party_row(t):
    one = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return filters.same_row(t.customer, t.orders, "c_custkey", "o_custkey", one).select("c_custkey")


@query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag='R') and not exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='A')")
def flt_exclude_anti(t):
    have = filters.same_row(t.orders, t.lineitem, "o_orderkey", "l_orderkey", F.col("l_returnflag") == "R")
    return filters.same_row(have, t.lineitem, "o_orderkey", "l_orderkey", F.col("l_returnflag") == "A", negate=True).select("o_orderkey")


@query(f"select n_nationkey, round({km_sql('-35.0', '-105.0', 'lat', 'lon')}, 6) as km from {NATION_PLACES} where {km_sql('-35.0', '-105.0', 'lat', 'lon')} <= 500")
def geo_radius(t):
    found = filters.near_point(nations(t), "lat", "lon", (-35.0, -105.0), 9999.0)
    return found.select("n_nationkey", F.round("km", 6).alias("km"))


@query(f"""select o_custkey, arg_min(n_nationkey, km) as place, round(min(km), 6) as km from (select o_custkey, n_nationkey, {km_sql('0.0', '0.0', 'lat', 'lon')} as km
  from orders join lineitem on l_orderkey=o_orderkey join supplier on s_suppkey=l_suppkey join {NATION_PLACES} on n_nationkey=s_nationkey) group by 1""")
def geo_nearest(t):
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    links = lines.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey").select("o_custkey", "n_nationkey")
    return geo.nearest(links, nations(t).select("n_nationkey", "lat", "lon"), "o_custkey", "n_nationkey", (0.0, 0.0)).select("o_custkey", "place", F.round("km", 6).alias("km"))


@query(f"select a.n_regionkey, count(distinct a.n_nationkey) as n, round(max({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 6) as max_km from {NATION_PLACES} a join {NATION_PLACES} b on a.n_regionkey=b.n_regionkey group by 1")
def geo_pairwise_spread(t):
    return geo.spread(nations(t), "n_regionkey", "n_nationkey", "lat", "lon").select("n_regionkey", "n", F.round("max_km", 6).alias("max_km"))


SCATTERED = "select c_nationkey as g, c_custkey as k, ((c_custkey * 37) % 29) * 1.0 + (c_custkey % 7) * 0.01 as lat, ((c_custkey * 91) % 53) * 1.0 + (case when c_custkey % 40 = 0 then 80.0 else 0.0 end) as lon from customer"


@query(f"""with p as (select g, k, lat::double as lat, lon::double as lon from ({SCATTERED})),
  s as (select a.g, a.k, sum({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}) as s, count(*) as n from p a join p b on a.g = b.g group by 1, 2),
  r as (select *, row_number() over (partition by g order by round(s, 6) desc, k) as i from s),
  kept as (select p.* from p join r on p.g = r.g and p.k = r.k where i > 2 or n <= 3)
  select a.g as nation, count(distinct a.k) as n, round(max({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 6) as max_km from kept a join kept b on a.g = b.g group by 1""")
def geo_trimmed_spread(t):
    places = t.customer.selectExpr("c_nationkey as nation", *SCATTERED.removeprefix("select c_nationkey as g, ").removesuffix(" from customer").split(", "))
    return geo.trimmed_spread(places, "nation", "k", "lat", "lon").select("nation", "n", F.round("max_km", 6).alias("max_km"))


TREE = f"""(select 'r'||r_regionkey as id, null as parent, (r_regionkey*10)::double as lat, (r_regionkey*20)::double as lon from region where r_regionkey <> 2
  union all select 'r'||r_regionkey, null, null, null from region where r_regionkey = 2
  union all select 'n'||n_nationkey, 'r'||n_regionkey, case when n_nationkey%3=0 then {LAT % 'n_nationkey'}::double end, case when n_nationkey%3=0 then {LON % 'n_nationkey'}::double end from nation
  union all select 's'||s_suppkey, 'n'||s_nationkey, null, null from supplier)"""


@query(f"""with recursive t as {TREE}, i as (select id, lat, lon, 0 as d from t where lat is not null union all
  select c.id, i.lat, i.lon, i.d+1 from t c join i on c.parent=i.id where c.lat is null)
  select t.id, i.lat, i.lon, case when i.d is null then null when i.d=0 then 'own' else 'inherited:'||i.d end as method from t left join i using (id)""")
def geo_inherit_coords(t):
    none = F.lit(None).cast("double")
    lat, lon = place("n_nationkey")
    known = F.col("r_regionkey") != 2
    regions = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.when(known, F.col("r_regionkey") * 10.0).alias("lat"), F.when(known, F.col("r_regionkey") * 20.0).alias("lon"))
    some = F.col("n_nationkey") % 3 == 0
    countries = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(some, lat).alias("lat"), F.when(some, lon).alias("lon"))
    makers = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), none.alias("lat"), none.alias("lon"))
    return hierarchy.inherited(regions.union(countries).union(makers), "id", "parent", "lat", "lon")


SHAPES = [("square", [(-80.0, -35.0), (20.0, -35.0), (20.0, 35.0), (-80.0, 35.0)]), ("triangle", [(-170.0, -70.0), (170.0, -70.0), (0.0, 69.5)])]


def _pip_sql() -> str:
    def crossings(ring):
        return " + ".join(f"(case when (({a[1]} > lat) <> ({b[1]} > lat)) and (lon < ({b[0]}-({a[0]}))*(lat-({a[1]}))/nullif({b[1]}-({a[1]}),0)+({a[0]})) then 1 else 0 end)" for a, b in zip(ring, ring[1:] + ring[:1], strict=True))

    return " union all ".join(f"select n_nationkey, '{name}' as shape from {NATION_PLACES} where ({crossings(ring)}) % 2 = 1" for name, ring in SHAPES)


@query(_pip_sql())
def geo_pip(t):
    shapes = t.spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in ring]) for n, ring in SHAPES], "shape string, ring array<struct<x double, y double>>")
    return geo.points_in_polygons(nations(t), shapes, "lon", "lat", "ring").select("n_nationkey", "shape")


@query("with recursive d as (select 3::bigint as id, 0 as depth union all select p_partkey, depth+1 from part join d on p_partkey//3 = d.id and p_partkey <> d.id where depth < 10) select id, min(depth)::int as depth from d group by 1")
def hier_descendants(t):
    tree = t.part.select("p_partkey", F.expr("p_partkey div 3").alias("up"))
    return hierarchy.descendants(tree, t.spark.createDataFrame([(3,)], "id long"), "p_partkey", "up")


EDGES = """(select p_partkey as id, p_partkey//3 as up from part union select p_partkey, p_partkey//5 + 1 from part where p_partkey % 40 = 0
  union select min(p_partkey), max(p_partkey) from part)"""


@query(f"""with recursive e as {EDGES}, d as (select p_partkey as id, 0 as depth from part where p_partkey in (3, 7) union select e.id, depth+1 from e join d on e.up = d.id and e.id <> d.id where depth < 10) select id, min(depth)::int as depth from d group by 1""")
def hier_labelled(t):
    """What stands below two parts, by interval labels stored in their order: some parts have a second parent, and the
    last one stands above the first, which closes a cycle."""
    more = t.part.where("p_partkey % 40 = 0").select("p_partkey", F.expr("p_partkey div 5 + 1").alias("up"))
    loop = t.part.select(F.min("p_partkey").alias("p_partkey"), F.max("p_partkey").alias("up"))
    tree = t.part.select("p_partkey", F.expr("p_partkey div 3").alias("up")).unionByName(more).unionByName(loop)
    labels, others = hierarchy.labelled(tree, "p_partkey", "up")
    return hierarchy.below(labels, others, t.part.where("p_partkey in (3, 7)").select("p_partkey"), 10)


@query("""with recursive a as (select p_partkey as id, p_partkey as node, 0 as d, p_type='PROMO' as ok from part union all
  select a.id, p.p_partkey, d+1, p.p_type='PROMO' from a join part p on p.p_partkey = a.node//3 and p.p_partkey <> a.node where not ok and d < 6)
  select id, node as ancestor, d as depth from a where ok""")
def hier_ancestor_first(t):
    tree = t.part.select("p_partkey", F.expr("p_partkey div 3").alias("up"), "p_type")
    return hierarchy.first_ancestor(tree, "p_partkey", "up", F.col("p_type") == "PROMO")


@query("select o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) over w as period_end, date_diff('day', o_orderdate, lead(o_orderdate) over w)::int as days from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def win_lead_periods(t):
    p = sequences.periods(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate")
    return p.select("o_custkey", "o_orderkey", "o_orderdate", "period_end", F.datediff("period_end", "o_orderdate").alias("days"))


@query("""with p as (select o_custkey, date_diff('day', o_orderdate, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey))::int as days from orders)
  select o_custkey, max(days) as longest from p where days >= 0 group by 1 having max(days) >= 365 order by longest desc, o_custkey limit 50""")
def period_search_duration(t):
    p = sequences.periods(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate").withColumn("days", F.datediff("period_end", "o_orderdate"))
    return p.where("days >= 0").groupBy("o_custkey").agg(F.max("days").alias("longest")).where("longest >= 365").orderBy(F.desc("longest"), "o_custkey").limit(50)


@query("""with g as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 1800000000 then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
  s as (select *, sum(new) over (partition by user_id order by ts range between unbounded preceding and current row)::bigint as session_no from g)
  select user_id, session_no, count(*) as n, min(ts) as started, max(ts) as ended, count(distinct event_type) as kinds from s group by 1, 2""")
def win_sessions(t):
    s = sequences.sessions(t.events, "user_id", "ts")
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_distinct("event_type").alias("kinds"))


@query("""with h as (select o_orderkey, o_custkey, sha256(cast(cast(floor(o_totalprice/50000) as bigint) as varchar)) as content_hash from orders)
  select o_orderkey, content_hash, row_number() over (partition by o_custkey, content_hash order by o_orderkey)::int as dup_ordinal, count(*) over (partition by o_custkey, content_hash) as dup_count from h""")
def win_dup_ordinal(t):
    rows = sequences.duplicate_ordinals(t.orders, F.floor(F.col("o_totalprice") / 50000), "o_custkey", "o_orderkey")
    return rows.select("o_orderkey", "content_hash", "dup_ordinal", "dup_count")


@query("select c_custkey, nullif(round(c_acctbal/1000), 0) as k, row_number() over (order by nullif(round(c_acctbal/1000),0) desc nulls last, c_custkey)::int as place from customer qualify place <= 200 or place > (select count(*) - 50 from customer)")
def sort_nulls_last(t):
    k = F.nullif(F.round(F.col("c_acctbal") / 1000), F.lit(0.0))
    keyed = t.customer.select("c_custkey", k.alias("k"))
    placed = ranking.places(keyed, [], [F.col("k").desc_nulls_last(), F.col("c_custkey")])
    return placed.where("place <= 200 or place > group_rows - 50").select("c_custkey", "k", F.col("place").cast("int").alias("place"))


@query("""with m as (select o_custkey, max(o_totalprice) as price from orders where o_orderpriority='1-URGENT' group by 1)
  select c_custkey, price from customer left join m on o_custkey=c_custkey order by price desc nulls last, c_custkey limit 300""")
def sort_agg_max(t):
    m = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("price"))
    return t.customer.select("c_custkey").join(m, "c_custkey", "left").orderBy(F.col("price").desc_nulls_last(), "c_custkey").limit(300)


@query("""with hit as (select o_custkey, count(*) as n_matched from orders where o_totalprice > 480000 group by 1)
  select o.o_custkey, o_orderkey, n_matched, o_totalprice > 480000 as matched, row_number() over (partition by o.o_custkey order by o_orderdate, o_orderkey)::int as sequence from orders o join hit using (o_custkey)""")
def chain_matched_flags(t):
    """Whole chains of entities with a matching event, each event flagged."""
    one = F.col("o_totalprice") > 480000
    hit = t.orders.where(one).groupBy("o_custkey").agg(F.count("*").alias("n_matched"))
    chains = t.orders.join(hit, "o_custkey").withColumn("matched", one)
    return sequences.renumbered(chains, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "n_matched", "matched", "sequence")


@query("""with page as (select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 400), c as (select o_orderkey, o_orderkey//10 as parent from page)
  select o_orderkey, (select count(*) from c x where x.parent = p.o_orderkey)::bigint as n_children from page p where not exists (select 1 from c y where y.o_orderkey=p.o_orderkey and y.parent in (select o_orderkey from page) and y.parent <> y.o_orderkey)""")
def groupby_parent_collapse(t):
    """A result page in which children whose parent is on it fold into the parent."""
    from vitrine.plans.catalogue import collapsed

    page = t.orders.select("o_orderkey", "o_totalprice", F.expr("o_orderkey div 10").alias("parent")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(400)
    return collapsed(page, "o_orderkey", "parent").select("o_orderkey", "n_children")


MUTATED = "(select c_custkey, case when c_custkey%7=0 then c_name||' x' else c_name end as c_name, case when c_custkey%11=0 then null else c_acctbal end as c_acctbal from customer where c_custkey%5<>0 union all select c_custkey+1000000, c_name, c_acctbal from customer where c_custkey%50=0)"


def mutated(t):
    k = F.col("c_custkey")
    a = t.customer.where(k % 5 != 0).select(k, F.when(k % 7 == 0, F.concat("c_name", F.lit(" x"))).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 11 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return a.union(t.customer.where(k % 50 == 0).select(k + 1000000, "c_name", "c_acctbal"))


@query(f"""select coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when a.c_custkey is null then 'new' when b.c_custkey is null then 'removed' when a.c_name is not distinct from b.c_name and a.c_acctbal is not distinct from b.c_acctbal then 'unchanged' else 'modified' end as status
  from customer a full join {MUTATED} b on a.c_custkey=b.c_custkey""")
def diff_full_outer(t):
    return sequences.difference(t.customer, mutated(t), "c_custkey", ["c_name", "c_acctbal"])


@query(f"""select a.c_custkey, 'c_name' as field, a.c_name as live, b.c_name as kept from customer a join {MUTATED} b using (c_custkey) where a.c_name is distinct from b.c_name
  union all select a.c_custkey, 'c_acctbal', 'value', case when b.c_acctbal is null then null else 'value' end from customer a join {MUTATED} b using (c_custkey) where a.c_acctbal is distinct from b.c_acctbal""")
def field_drift(t):
    found = sequences.field_drift(t.customer, mutated(t), "c_custkey", ["c_name", "c_acctbal"])
    shown = lambda c: F.when(F.col("field") == "c_name", F.col(c)).when(F.col(c).isNotNull(), F.lit("value"))
    return found.select("c_custkey", "field", shown("live").alias("live"), shown("kept").alias("kept"))


@query("""select p_partkey, case p_name when 'red ring' then 'ruby ring' when 'old gear' then 'antique gear' else p_name end as p_name, p_name in ('red ring','old gear') as patched from part""")
def patch_apply(t):
    patches = t.spark.createDataFrame([("red ring", "scarlet ring", 0.8), ("red ring", "ruby ring", 0.9), ("old gear", "antique gear", 0.7), ("new rod", "fresh rod", 0.5)], "old string, value string, confidence double")
    patches = patches.select(F.sha2("old", 256).alias("content_hash"), F.lit("p_name").alias("field"), "value", "confidence")
    return sequences.patched(t.part, patches, F.col("p_name"), "p_name").select("p_partkey", "p_name", "patched")


@query("""select c_custkey, coalesce(nullif(c_acctbal, case when c_custkey%3=0 then c_acctbal end), m.v, 0.0) as balance, case when c_custkey%3<>0 then 0 when m.v is not null then 1 else 2 end as filled_from
  from customer left join (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus='P' group by 1) m on o_custkey=c_custkey""")
def gapfill_coalesce(t):
    own = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("balance"))
    first = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_totalprice"))
    second = t.customer.select("c_custkey", F.lit(0.0))
    return sequences.gap_filled(own, [first, second], "c_custkey", "balance").select("c_custkey", "balance", "filled_from")


@query("""with e as (select *, count(*) filter (role='user') over (partition by conv_id order by turn) as ep from conversations)
  select conv_id, min(turn) filter (role='user') as ask_turn, min(turn) filter (role='assistant') as answer_turn from e where ep > 0 group by conv_id, ep""")
def req_resp_match(t):
    return sequences.answered(t.conversations, "conv_id", "turn", "role")


@query("select p_partkey, p_brand from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 4")
def sample_stratified(t):
    from pyspark.sql import Window

    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return sequences.stratified(t.part.withColumn("place", F.row_number().over(order)), "p_brand", F.col("place"), 4).select("p_partkey", "p_brand")


@query("""with s as (select p_type, count(*) as size, max(p_size%5+1) as w from part group by 1), q as (select p_type, least(greatest(round(100*w*size/sum(w*size) over ()),1),size)::bigint as quota from s),
  r as (select p_partkey, p_type, row_number() over (partition by p_type order by p_partkey) as i from part) select p_partkey, p_type from r join q using (p_type) where i <= quota""")
def sample_quota(t):
    return sequences.quota_sample(t.part, "p_type", F.col("p_size") % 5 + 1, F.col("p_partkey"), 100).select("p_partkey", "p_type")


@query("select user_id, event_id, event_type, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def seq_latest(t):
    return sequences.latest(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "ts")
