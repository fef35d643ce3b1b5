"""Packing of documents into training sequences by minimum bin slack.

Documents longer than a sequence are cut into full pieces and a remaining piece. What is packed is the
multiset of remaining lengths: a histogram with one count for each length below the capacity, however
large the corpus is. For the longest length left, a subset-sum dynamic programme over a bitset finds the
multiset of other lengths that fills the window closest to its capacity; its counts are read back from the
bitsets, longer lengths first. The pattern is used as often as the counts allow, so each use of the
programme exhausts a length and the whole plan has a few thousand lines at any scale. Pieces find their
line by their rank among the pieces of their length, counted in buckets, so no length is a hot spot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.shared import stored
from vitrine.llm.tokens import default_path, ids_of

CAPACITY = 2048
BUCKET = 200_000  # pieces of all lengths in one bucket of ranks


def fill(gap: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """The multiset of lengths whose sum comes closest to ``gap`` without passing it, as (length, count)."""
    reach, steps, full = 1, [], (1 << (gap + 1)) - 1
    for length in sorted((x for x in counts if x <= gap and counts[x]), reverse=True):
        before, left, part = reach, min(counts[length], gap // length), 1
        steps.append((length, left, before))
        while left:
            part = min(part, left)
            reach |= (reach << (length * part)) & full
            left -= part
            part *= 2
        if reach >> gap & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        used = next(j for j in range(most + 1) if at >= j * length and before >> (at - j * length) & 1)
        if used:
            out.append((length, used))
            at -= used * length
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, count), ...]) patterns that use up the histogram."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        root = max(counts)
        counts[root] -= 1
        pattern = dict(fill(capacity - root, counts))
        counts[root] += 1
        pattern[root] = pattern.get(root, 0) + 1
        times = min(counts[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
        out.append((times, sorted(pattern.items(), reverse=True)))
    return out


def lines(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, count in a sequence, offset there), by length and rank."""
    out, used, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length, n in pattern:
            out.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full pieces from each document's start, and the rest."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text, path)
                for s in range(0, len(ids), capacity):
                    raw = ids[s : s + capacity].astype("<u4").tobytes()
                    rows.append((key, s, len(raw) // 4, zlib.crc32(raw), len(ids), raw if with_ids else None))
            if rows:
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    made = docs.mapInArrow(each, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return made if with_ids else made.drop("ids")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    Each token of each document, closing id included, is in one piece; offsets in a sequence are gapless
    from 0 and sequences are numbered from 0. A null or empty text is its closing id alone. Null and
    repeated ids keep their rows: pieces are told apart by rank. ``ids`` (with ``with_ids``) are
    little-endian unsigned 32-bit ids. Other columns are not read; an empty table gives no rows.
    """
    cut = stored(pieces(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), capacity, tokenizer or default_path(), with_ids), "pieces")
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    found = lines(plan(by_length, capacity))
    buckets = max(1, sum(by_length.values()) // BUCKET)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside)).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first") - 1)
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    starts = (found[:, 0] << 44) + found[:, 1]

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            line = found[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            rank = rank - line[:, 1]
            sequence, offset = line[:, 2] + rank // line[:, 3], line[:, 4] + rank % line[:, 3] * length
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    kinds = {"ids": "binary"}
    return ranked.select(*keep, "rank").mapInArrow(each, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in [*keep, "sequence_id", "offset"]))
