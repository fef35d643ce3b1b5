"""The registered queries: one for each operator, and those with SQL against it."""

import duckdb
import pytest

from tests.test_queries import rows_of
from vitrine.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_the_sql_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.queries()[name](spark, sf_dir)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert rows_of(found.columns, found.collect()) == rows_of(names, cursor.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_contract_columns(spark, sf_dir):
    wanted = {
        "op2_packing": [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
        "op3_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")], "op4_substrings": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
        "op5_langid": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")], "op6_html": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
        "op8_warc": [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")], "op10_ann": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    }
    for name, columns in wanted.items():
        assert queries.queries()[name](spark, sf_dir).dtypes == columns, name
