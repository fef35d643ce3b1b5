"""Every registered query of the reference's operators against its SQL twin, run by DuckDB on the same files."""

import math
import os
import re

import duckdb
import pytest

from vitrine import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_rows_are_those_of_the_sql_twin(spark, database, sf_dir, name):
    found = plans.queries()[name](spark, sf_dir)
    cursor = database.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, found.collect()) == rows_of(names, cursor.fetchall())


def test_the_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["label", "n", "pct"]


@pytest.mark.parametrize("left", ["", "corpus_pipeline.py", "vitrine/llm"])
def test_importing_without_the_training_data_operators(tmp_path, left):
    """The rest stands alone: a copy without those folders imports and lists its queries, whether or not the
    pipeline's file or an empty folder is left."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/vitrine", tmp_path / "vitrine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if left == "corpus_pipeline.py":
        (tmp_path / left).write_text("from vitrine.llm import packing\n")
    elif left:
        (tmp_path / left).mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'stats_vocab_dim' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=60)


@pytest.mark.parametrize(("name", "wanted"), [("flt_vocab_and", "LeftSemi"), ("flt_exclude_anti", "LeftAnti"), ("flt_presence_semi", "LeftSemi")])
def test_plans_use_semi_and_anti_joins(spark, sf_dir, name, wanted):
    plan = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert wanted in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plans.queries()["flt_range_sentinel"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_discount,0.03)" in plan and "l_comment" not in plan
    radius = plans.queries()["geo_radius"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Cartesian" not in radius


def test_histories_of_unknown_events_alone_have_no_types(spark, tmp_path):
    """No type but unknown: null, as in the SQL, not an empty text."""
    rows = "values (5L, 1L), (11L, 1L), (5L, 2L), (12L, 2L) as t(o_orderkey, o_custkey)"
    spark.sql(f"select *, 'F' as o_orderstatus, 10.0D as o_totalprice, date'1997-03-04' as o_orderdate from {rows}").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    found = sorted(map(tuple, plans.queries()["prov_rollup"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(plans.oracle_sql()["prov_rollup"]).fetchall())
    assert [r[4] for r in found] == [None, "sale"]


def test_histories_are_parsed_once_for_whole_chains(spark, sf_dir):
    plan = plans.queries()["prov_search_chains"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1


def test_openings_are_cut_by_fixed_patterns(spark, sf_dir):
    """A pattern that changes from row to row is compiled for every row; and a text meets few patterns, not all in turn."""
    plan = plans.queries()["prov_parse_events"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp_replace\(_b#\d+, \w", plan) and "(?i)^(?:sold (?:by" in plan and "stolen(?: from| by)?|" in plan


def test_rules_of_histories_stay_out_of_generated_code(spark, sf_dir):
    """Types, prices and dates are told in lambdas: the code generated for a row stays short enough to be compiled."""
    plan = plans.queries()["prov_parse_events"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"transform\(array\(_b#\d+\)", plan)) == 3
