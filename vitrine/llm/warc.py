"""WARC archives by way of a chunked record table.

A record's payload travels as rows of (record, chunk number, bytes, digest so far). Spark cuts a payload into chunks
where it is read, so tasks that write or read archives never hold more of one than a chunk: the writer carries the
digest from chunk to chunk and appends each, the reader gives them out as it meets them, and the digest of the whole
payload is the one on its last chunk. Equal payloads are written once, as the response with the smallest id; the
others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.shared import cut, fresh_dir, open_store

CHUNK = 1 << 14
LEAST = 100  # bytes from which equal payloads are written once
FILE_BYTES = 1 << 30
SMALL = 500_000  # groups of equal payloads up to which their table is broadcast
DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:vitrine:page:"  # then the page's id, and what tells its records apart
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "page_id long, tag string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no long, is_last boolean, chunk binary, digest_so_far string"
NAMES = [part.split()[0] for part in CHUNKS.split(", ")]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, tag, url, payload, payload_bytes, payload_digest, record_type, refers_to): what each row becomes. The
    tag of a response that others may refer to is its digest, any other is random."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.xxhash64("url").alias("u"))
    same = rows.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest", "page_id", "u").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "u", "n")).alias("first")
    groups = cut(same.groupBy("payload_digest").agg(first, F.sum("n").alias("n")).where("n > 1").select("payload_digest", "first"))
    small, tied = groups.count() <= SMALL, not groups.where("first.n > 1").isEmpty()
    rows = rows.join(F.broadcast(groups) if small else groups, "payload_digest", "left")
    own = F.col("first").isNull() | (F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("u") == F.col("first.u")))
    rows = rows.withColumn("again", ~own)
    if tied:  # rows that are equal in everything: one of them is the response
        equal = rows.where(own & (F.coalesce("first.n", F.lit(0)) > 1))
        counted = equal.groupBy("page_id", "url", "payload_bytes", "payload_digest", "u", "first").agg(F.any_value("payload").alias("payload"), F.count("*").alias("n"))
        dealt = counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("again", F.col("i") > 1)
        rows = rows.where(~(own & (F.coalesce("first.n", F.lit(0)) > 1))).unionByName(dealt.select(rows.columns))
    tag = F.when(F.col("again") | (F.col("payload_bytes") < LEAST), F.expr("uuid()")).otherwise(F.col("payload_digest"))
    return rows.select(
        "page_id", tag.alias("tag"), "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("again"), F.col("first.page_id")).alias("refers_to")
    )


def table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of records; a revisit, or an empty payload, is one empty chunk. A payload's chunks follow each
    other, and the digest is carried from one to the next."""
    end = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    last = F.greatest(F.lit(0), F.ceil(end / size) - 1).cast("int")
    numbered = rows.select(*rows.columns, F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    chunk = F.when(end > 0, F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size))).otherwise(F.lit(b""))
    made = numbered.select(
        "page_id", "tag", "url", "record_type", "refers_to", "payload_bytes", "payload_digest",
        F.col("chunk_no").cast("long").alias("chunk_no"), ((F.col("chunk_no") + 1) * F.lit(size) >= end).alias("is_last"), chunk.alias("chunk"),
    )

    def each(batches) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for batch in batches:
            digests = []
            for number, piece in zip(batch.column("chunk_no").to_pylist(), batch.column("chunk"), strict=True):
                if not number:
                    h = hashlib.sha256()
                h.update(memoryview(piece.as_buffer()))
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], schema=pa.schema(list(zip(NAMES, KINDS, strict=True))))

    return made.mapInArrow(each, CHUNKS)


def name_of(page: int | None, tag: str) -> str:
    return f"<{RECORD}{'null' if page is None else page}:{tag}>"


def head(page: int | None, tag: str, url: str | None, kind: str, first: int | None, n: int, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name_of(page, tag)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    fields += [("WARC-Target-URI", " ".join(url.split()))] if url is not None else []
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name_of(first, digest))] if kind == "revisit" else []
    fields += [("Content-Length", str(len(http) + (n if kind == "response" else 0)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def info(name: str) -> bytes:
    """The record that opens an archive."""
    about = b"software: vitrine\r\nformat: WARC File Format 1.1\r\n"
    fields = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:vitrine:archive:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
    return fields.encode() + about + b"\r\n\r\n"


def write(pages: DataFrame, to: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all rows as WARC files and returns the manifest (path, records, bytes).

    A null page is an empty payload; a null url leaves its field out; a null id is written as such and never
    a response that others refer to, unless its group has no other. Of rows that repeat the smallest id of
    their group one is the response. An empty table gives no file. A task writes below names of its own
    attempt, and only files in the manifest count, so lost or repeated tasks do no harm.
    """
    folder = to or fresh_dir(pages.sparkSession, "warc")

    def each(batches) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        task = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        done, out, n, size, first_of_record = [], None, 0, 0, True
        for batch in batches:
            for page, tag, url, kind, first, many, digest, _, last, chunk, so_far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n = f"{task}-{len(done):04d}.warc", 0
                    out = store.open_output_stream(f"{root}/{name}")
                    out.write(info(name))
                    size = len(info(name))
                if first_of_record:
                    start = head(page, tag, url, kind, first, many, digest)
                    out.write(start)
                    size += len(start)
                out.write(chunk)
                size += len(chunk)
                first_of_record = last
                if last:
                    if kind == "response" and so_far != digest:
                        raise ValueError(f"the chunks of record {page} don't have its digest")
                    out.write(b"\r\n\r\n")
                    size, n = size + 4, n + 1
                    if size >= FILE_BYTES:
                        out.close()
                        done.append((f"{folder}/{name}", n, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return cut(chunked(records(pages, id_col, url_col, html_col)).mapInArrow(each, "path string, records long, bytes long"))


def named(record: str) -> tuple[int | None, str]:
    """The page's id and the tag in a record's name."""
    page, tag = record[1:-1].removeprefix(RECORD).split(":")
    return None if page == "null" else int(page), tag


class Reader:
    """Records of one archive, chunk by chunk, from a file that is read forward once."""

    def __init__(self, file, size: int = CHUNK):
        self.file, self.size, self.held = file, size, b""

    def more(self) -> bool:
        got = self.file.read(self.size)
        self.held += got
        return bool(got)

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.held:
            if not self.more():
                return None
        out, self.held = self.held.split(mark, 1)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out

    @staticmethod
    def fields(raw: bytes) -> dict[str, str]:
        return dict(x.split(": ", 1) for x in raw.decode().split("\r\n")[1:])

    def chunks(self) -> Iterator[tuple]:
        while (raw := self.until(b"\r\n\r\n")) is not None:
            fields = self.fields(raw)
            if fields["WARC-Type"] == "warcinfo":
                self.take(int(fields["Content-Length"]) + 4)
                continue
            http = self.until(b"\r\n\r\n")
            if http is None:
                raise ValueError("a record ends early")
            left = int(fields["Content-Length"]) - len(http) - 4
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
            first = named(fields["WARC-Refers-To"])[0] if kind == "revisit" else None
            row = (*named(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, first, int(self.fields(http)["Content-Length"]), digest)
            h, number = hashlib.sha256(), 0
            while True:
                chunk = self.take(min(left, self.size))
                if len(chunk) < min(left, self.size):
                    raise ValueError("a payload ends early")
                left -= len(chunk)
                h.update(chunk)
                if not left and kind == "response" and h.hexdigest() != digest:
                    raise ValueError(f"record {row[0]}: the payload doesn't have its digest")
                yield (*row, number, not left, chunk, h.hexdigest())
                number += 1
                if not left:
                    break
            if self.take(4) != b"\r\n\r\n":
                raise ValueError("a record doesn't end")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The chunk table of the archives of a manifest. Of a revisit, length and digest are its full payload's."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                with store.open_input_stream(at) as file:
                    rows, held = [], 0
                    for row in Reader(file).chunks():
                        rows.append(row)
                        held += len(row[9])
                        if held >= 1 << 22 or len(rows) == 1000:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    return manifest.select("path").mapInArrow(each, CHUNKS)
