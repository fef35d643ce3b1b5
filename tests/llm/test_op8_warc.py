import hashlib
import io

import pytest

from vitrine.llm import warc
from vitrine.llm.queries import op8_warc
from vitrine.llm.shared import open_store

LONG = "<p>" + "word " * 60_000 + "é漢</p>"
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, "http://a/9", LONG),
    (1, "http://a/1", "short"), (2, "http://a/2", "short"), (7, None, None), (8, "http://a/8", ""),
    (10, "http://a/10\r\nX-Bad: 1", "x" * 100), (11, "http://a/11", "x" * 100), (12, "u", "x" * 99), (13, "u", "x" * 99),
    (14, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 10),
]
SCHEMA = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100:
            first[raw] = min(page, first.get(raw, page))
    out = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        again = first.get(raw, page) != page
        out[page] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None)
    return out


def records(chunks):
    """page_id: its whole payload, from chunks in order."""
    out = {}
    for r in sorted(chunks, key=lambda r: (r["page_id"], r["chunk_no"])):
        out[r["page_id"]] = out.get(r["page_id"], b"") + bytes(r["chunk"])
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    manifest = warc.write(pages)
    chunks = warc.read(spark, manifest).collect()
    last = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in chunks if r["is_last"]}
    assert last == expected(ROWS)
    payloads = records(chunks)
    for page, _, html in ROWS:
        assert payloads[page] == ((html or "").encode() if last[page][2] == "response" else b"")
    assert max(len(r["chunk"]) for r in chunks) <= warc.CHUNK and sum(r["page_id"] == 3 for r in chunks) > 3
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS)


def test_digests_grow_chunk_by_chunk(spark):
    chunks = sorted((r for r in warc.read(spark, warc.write(spark.createDataFrame(ROWS[:1], SCHEMA))).collect()), key=lambda r: r["chunk_no"])
    h = hashlib.sha256()
    for r in chunks:
        h.update(bytes(r["chunk"]))
        assert r["digest_so_far"] == h.hexdigest()
    assert chunks[-1]["digest_so_far"] == chunks[-1]["payload_digest"]


def test_archives_are_warc(spark):
    row = warc.write(spark.createDataFrame(ROWS[3:4], SCHEMA)).first()
    store, path = open_store(row["path"])
    with store.open_input_file(path) as f:
        raw = f.read()
    opening, about, raw = raw.partition(b"\r\n\r\n")[0], *raw.partition(b"\r\n\r\n")[2].split(b"\r\n\r\n\r\n", 1)
    assert opening.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and opening.endswith(b"Content-Length: %d" % (len(about) + 2))
    head, http, rest = raw.split(b"\r\n\r\n", 2)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == "response"
    assert int(fields["Content-Length"]) == len(http) + 4 + len(b"short") and rest == b"short\r\n\r\n"


def test_a_changed_payload_is_found():
    raw = warc.head(1, "t", "u", "response", None, 5, hashlib.sha256(b"hello").hexdigest())
    assert list(warc.Reader(io.BytesIO(raw + b"hello\r\n\r\n")).chunks())[0][9] == b"hello"
    for bad in (raw + b"hullo\r\n\r\n", raw + b"hel", raw + b"helloxx\r\n"):
        with pytest.raises(ValueError):
            list(warc.Reader(io.BytesIO(bad)).chunks())


@pytest.mark.parametrize("size", [1, 3, 64])
def test_a_reader_with_little_memory(size):
    raw = warc.head(1, "t", "u", "response", None, 5, hashlib.sha256(b"hello").hexdigest()) + b"hello\r\n\r\n"
    chunks = list(warc.Reader(io.BytesIO(raw * 3), size).chunks())
    assert b"".join(c[9] for c in chunks) == b"hello" * 3 and sum(c[8] for c in chunks) == 3


def test_files_roll_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(30)], SCHEMA).coalesce(1)
    manifest = warc.write(pages)
    assert manifest.count() > 1 and warc.read(spark, manifest).where("is_last").count() == 30


def test_odd_rows_and_empty_table(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, LONG), (4, "u", LONG), (4, "u", LONG), (6, "u", LONG), (None, "u", "tiny")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({"payload": F.lit(1), "first": F.lit(2), "n": F.lit(3)})
    found = sorted((r["record_type"], r["page_id"] or -1, r["refers_to"] or -1) for r in warc.read(spark, warc.write(pages)).where("is_last").collect())
    assert found == [("response", -1, -1), ("response", 4, -1), ("revisit", -1, 4), ("revisit", 4, 4), ("revisit", 6, 4)]
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_every_record_has_its_own_name(spark):
    pages = spark.createDataFrame([*ROWS, *ROWS, (None, "u", LONG)], SCHEMA).repartition(4)
    last = warc.read(spark, warc.write(pages)).where("is_last")
    assert last.select("page_id", "tag").distinct().count() == last.count() == 2 * len(ROWS) + 1
    responses = last.where("record_type = 'response' and payload_bytes >= 100")
    assert responses.select("payload_digest").distinct().count() == responses.count() == 3


def test_query(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    found = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op8_warc(spark, sf_dir).collect()}
    assert found == expected(rows)
