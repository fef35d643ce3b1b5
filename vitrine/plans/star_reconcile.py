"""Reconciliation on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import reconcile as R
from vitrine.plans.registry import query
from vitrine.plans.star_filters import NATION_PLACES, km_sql, nations


@query("""with n as (select lower(trim(p_name)) as nm, count(distinct p_partkey) as n, min(p_partkey) as m from part where p_size > 10 group by 1)
  select p_partkey, m as match, coalesce(n, 0) as n_matches, case when n = 1 then 'accepted' when n > 1 then 'review' else 'unmatched' end as verdict from part left join n on lower(trim(p_name)) = nm where p_size <= 10""")
def rec_by_name(t):
    """Parts matched by name against others: one match is accepted, several go to review."""
    return R.by_name(t.part.where("p_size <= 10"), t.part.where("p_size > 10"), "p_partkey", "p_name", "p_partkey", "p_name")


@query("""with l as (select lower(s_name) as lbl, count(distinct s_suppkey) as c, min(s_suppkey) as id from supplier group by 1 having count(distinct s_suppkey) = 1),
  e as (select s_suppkey * 2 as code, min(s_suppkey) as id from supplier group by 1)
  select c_custkey, coalesce(e.id, l.id) as match, case when e.id is not null then 'code' when l.id is not null then 'label' end as matched_by from customer left join e on c_custkey = code left join l on replace(lower(c_name), 'customer', 'supplier') = lbl""")
def rec_fallback(t):
    """Customers matched to suppliers by code, else by an unambiguous label."""
    rows = t.customer.select("c_custkey", F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier")).alias("label"))
    exact = t.supplier.select((F.col("s_suppkey") * 2).alias("code"), F.col("s_suppkey").alias("id"))
    return R.with_fallback(rows, exact, t.supplier.select(F.col("s_name").alias("label"), F.col("s_suppkey").alias("id")), "c_custkey", "c_custkey", "label")


@query("""with p as (select distinct p_name from part), w as (select p_name, list_distinct(list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as w from p)
  select x.p_name as a, y.p_name as b, len(list_intersect(x.w, y.w))::double / len(list_distinct(list_concat(x.w, y.w))) as similarity from w x, w y
  where len(list_intersect(x.w, y.w))::double / len(list_distinct(list_concat(x.w, y.w))) >= 0.6""")
def rec_alike(t):
    """Names with a likeness of tokens, met under their rarest tokens."""
    names = t.part.select("p_name").distinct()
    return R.alike(names, names, "p_name", "p_name", 0.6)


@query(f"""with n as {NATION_PLACES}, k as (select a.n_nationkey, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km from n a join n b on a.n_nationkey // 3 = b.n_nationkey and a.n_nationkey <> b.n_nationkey)
  select count(*) as n, count(*) filter (km > 3000) as far, round(count(*) filter (km > 3000) / count(*)::double, 4) as share from k""")
def rec_far_from_parent(t):
    """How many places stand too far from what they are part of."""
    tree = nations(t).withColumn("up", F.expr("case when n_nationkey > 0 then n_nationkey div 3 end"))
    return R.far_from_parent(tree, "n_nationkey", "up", "lat", "lon", 3000.0)


@query("""with u as (select c_custkey, c_acctbal as v, 'manual' as source, 0 as r from customer where c_custkey % 4 = 0 union all select c_custkey, -1.0, 'rule', 1 from customer where c_custkey % 2 = 0 union all select c_custkey, 0.0, 'default', 2 from customer)
  select c_custkey, v, source from u qualify row_number() over (partition by c_custkey order by r) = 1""")
def rec_preferred(t):
    """Values of the source that comes first."""
    k = t.customer
    return R.preferred({"manual": k.where("c_custkey % 4 = 0").select("c_custkey", F.col("c_acctbal").alias("v")), "rule": k.where("c_custkey % 2 = 0").select("c_custkey", F.lit(-1.0).alias("v")), "default": k.select("c_custkey", F.lit(0.0).alias("v"))}, "c_custkey")
