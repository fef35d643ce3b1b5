"""Token files in training order: a keyed permutation gives every sequence its slot.

The documents of each input partition form one stream of ids, each document closed by its id, and the
stream is cut into sequences of fixed length, which are kept while they are counted (one number a partition)
and numbered: texts are tokenised once, unless an executor is lost, and numbering moves nothing. A Feistel network over the smallest even
power of two that holds them all, keyed and walked along its cycle until the value is below their number,
permutes the numbers: slots need no sort key, no table and no collisions check. Slots fall into shards of
equal size; each shard is one partition, sorted by slot and written as a file in which slot ``s`` stands at
byte ``(s mod shard size) x stride``. A reader goes through shards in sequence, or resumes at any slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.shared import cut, fresh_dir, open_store
from vitrine.llm.tokens import default_path, ids_of

LENGTH = 2048
SHARD_BYTES = 32 << 20
PAD = 0
HEADER = 12  # bytes before the ids of a sequence: its number (8) and its count of ids (4)


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of range(n)."""

    n: int
    key: str
    rounds: int = 6

    def slots(self, number: np.ndarray) -> np.ndarray:
        half = max(1, ((max(self.n - 1, 1)).bit_length() + 1) // 2)
        mask = np.uint64((1 << half) - 1)
        keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{self.key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(self.rounds)]
        at = number.astype(np.uint64)
        walk = np.arange(len(at))
        while len(walk):  # values outside range(n) go on along their cycle, which comes back into it
            left, right = at[walk] >> np.uint64(half), at[walk] & mask
            for k in keys:
                x = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(29))) & mask)
            at[walk] = (left << np.uint64(half)) | right
            walk = walk[at[walk] >= np.uint64(self.n)]
        return at.astype(np.int64)


def stream(batches, path: str, length: int) -> Iterator[np.ndarray]:
    """The sequences of one partition's documents; the last one may be shorter."""
    held, have = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(ids_of(text, path))
            if held[-1].max() >= 1 << 16:
                raise ValueError("ids of 16 bits need a vocabulary below 65,536")
            have += len(held[-1])
            if have >= 64 * length:
                ids = np.concatenate(held)
                yield from ids[: have // length * length].reshape(-1, length)
                held, have = [ids[have // length * length :]], have % length
    if have:
        ids = np.concatenate(held)
        for s in range(0, have, length):
            yield ids[s : s + length]


def write(docs: DataFrame, key: str = "epoch-0", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, tokenizer: str | None = None, text_col: str = "text", to: str | None = None) -> DataFrame:
    """Writes all documents and returns the manifest: one row per shard (shard, path, first_slot, sequences, stride).

    ``docs`` has to come in the same partitions and order each time it is computed, as tables read from
    files do; a partition that comes with more sequences than before is an error, and so is a shard with a gap. Null or empty texts are their closing
    id alone; an empty table gives no shard. Ids are little-endian unsigned 16-bit, so the vocabulary has
    to stay below 65,536. A shard is written under a name of its own attempt and then moved, so a lost or
    repeated task leaves no half a shard. Only the text column is read; ids and other columns may be null
    or repeat.
    """
    spark, path = docs.sparkSession, tokenizer or default_path()
    texts = docs.select(F.col(text_col).cast("string"))

    def sequences(batches) -> Iterator[pa.RecordBatch]:
        part, at, rows = TaskContext.get().partitionId(), 0, []
        for ids in stream(batches, path, length):
            rows.append(ids.astype("<u2").tobytes())
            if len(rows) == 1024:
                yield numbered_from(part, at, rows)
                at, rows = at + len(rows), []
        if rows:
            yield numbered_from(part, at, rows)

    def numbered_from(part: int, at: int, rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.binary())], names=["part", "at", "ids"])

    made = texts.mapInArrow(sequences, "part int, at long, ids binary").persist(StorageLevel.MEMORY_AND_DISK)
    counted = dict(sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count("*").alias("n")).collect()))  # one row per input partition
    firsts = dict(zip(counted, np.cumsum([0, *counted.values()]).tolist(), strict=False))
    total = sum(counted.values())
    stride = HEADER + 2 * length
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-total // per_shard))
    order = Permutation(total, key)

    def numbered(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if any(n >= counted[p] for p, n in zip(part.tolist(), at.tolist(), strict=True)):
                raise ValueError("a partition came with more sequences than were counted")
            number = np.array([firsts[p] for p in part.tolist()], np.int64) + at
            slots = order.slots(number)
            yield pa.RecordBatch.from_arrays([pa.array((slots // per_shard).astype(np.int32)), pa.array(slots), pa.array(number), batch.column(2)], names=["shard", "slot", "number", "ids"])

    folder = to or fresh_dir(spark, "tokens")

    def written(batches) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        shard, file, n = None, None, 0
        done = []
        attempt = TaskContext.get().taskAttemptId()

        def close():
            file.close()
            store.move(f"{root}/.{shard:06d}-{attempt}", f"{root}/{shard:06d}.bin")
            done.append((shard, f"{folder}/{shard:06d}.bin", shard * per_shard, n, stride))

        for batch in batches:
            for s, slot, number, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != shard:
                    if file:
                        close()
                    shard, n = s, 0
                    file = store.open_output_stream(f"{root}/.{shard:06d}-{attempt}")
                if slot != shard * per_shard + n:
                    raise ValueError(f"slot {slot} is out of turn in shard {shard}")
                file.write(number.to_bytes(8, "little") + (len(ids) // 2).to_bytes(4, "little") + ids.ljust(2 * length, b"\0"))
                n += 1
        if file:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["shard", "path", "first_slot", "sequences", "stride"])

    rows = made.mapInArrow(numbered, "shard int, slot long, number long, ids binary")
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    manifest = cut(dealt.mapInArrow(written, "shard int, path string, first_slot long, sequences long, stride int"))
    made.unpersist()
    return manifest


def read(spark: SparkSession, manifest: DataFrame, from_slot: int = 0) -> DataFrame:
    """The sequences from a slot on, read from the shards: shard, slot, byte_offset, number, n_ids, ids (binary)."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, first, many, stride in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                store, at = open_store(path)
                skip = min(max(0, from_slot - first), many)
                with store.open_input_file(at) as file:
                    file.seek(skip * stride)
                    for s in range(skip, many, 256):
                        raw = file.read(stride * min(256, many - s))
                        rows = [raw[i : i + stride] for i in range(0, len(raw), stride)]
                        n = [int.from_bytes(r[8:12], "little") for r in rows]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([shard] * len(rows), pa.int32()),
                                pa.array(range(first + s, first + s + len(rows)), pa.int64()),
                                pa.array([(s + i) * stride for i in range(len(rows))], pa.int64()),
                                pa.array([int.from_bytes(r[:8], "little") for r in rows], pa.int64()),
                                pa.array(n, pa.int32()),
                                pa.array([r[HEADER : HEADER + 2 * k] for r, k in zip(rows, n, strict=True)], pa.binary()),
                            ],
                            names=["shard", "slot", "byte_offset", "number", "n_ids", "ids"],
                        )

    kept = manifest.where(F.col("first_slot") + F.col("sequences") > from_slot).select("shard", "path", "first_slot", "sequences", "stride")
    return kept.mapInArrow(each, "shard int, slot long, byte_offset long, number long, n_ids int, ids binary")

