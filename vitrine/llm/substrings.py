"""Removal of repeated passages by Relative Lempel-Ziv parsing against an index of reference blocks.

The whole corpus is the reference. It is indexed in blocks: in each run of ``window`` words the seed (a shorter
run of words) with the smallest hash anchors the run, so equal runs have equal anchors wherever they stand.
Windows that follow each other and share an anchor are a block, and a block can copy from blocks of its seed only.

Blocks whose seed occurs once are literals. All others are factored: from its first window on, a block copies
as many words as possible from the place where its next window stood first, then from the next place, and so
on. Such a factor is a place, a length, and the place in the reference that it copies from; it has ``window``
words at least, because windows are what the index knows, and where it ends the next window decides anew
whether and where the copy goes on. On the document's side factors that go on where another ends are joined,
and the words that they cover are the duplicate spans: a word goes if and only if a window over it starts
anywhere else, in the same document or another. Windows are compared by 128 bits over their words.

Rows are told apart by hashes of id and text, not by id. Seeds that are very common would put all their blocks
on one task: their windows go one by one, dealt by their own hash. Whatever repeats inside a task is factored
there and doesn't travel. The text crosses the network once; both joins with it use the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import cut

WINDOW, SEED = 35, 12
HELD = 200_000  # different blocks that a task remembers
HOT = 2048  # blocks of one seed from which on its windows go one by one
BASES = 6364136223846793005, 2862933555777941757  # odd, so they have an inverse modulo 2**64
FACTOR = "k long, c long, at int, n int, ref_id long, ref_at int"
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(words: np.ndarray, up: np.ndarray, down: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words, mixed so that its order is as good as random."""
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Blocks:
    """Anchors of a document and the windows that each of them stands for."""

    def __init__(self, window: int, seed: int):
        self.window, self.seed, self.span = window, seed, window - seed + 1
        self.grow(1 << 15)

    def grow(self, n: int) -> None:
        self.powers = [(powers(b, n), powers(pow(b, -1, 1 << 64), n)) for b in BASES]

    def of(self, text: bytes | None, with_windows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None] | None:
        """(first window of each block, its count of windows, its seed's hash[, 128 bits of every window])."""
        words = text.split() if text else []
        n = len(words)
        if n < self.window:
            return None
        if n > len(self.powers[0][0]):
            self.grow(2 * n)
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T
        seeds = rolling(halves[0], *self.powers[0], self.seed)
        anchor = np.empty(n - self.window + 1, np.int64)
        for at in range(0, len(anchor), 1 << 16):  # in pieces: the view below is span times as large
            part = seeds[at : at + (1 << 16) + self.span - 1]
            anchor[at : at + (1 << 16)] = np.lib.stride_tricks.sliding_window_view(part, self.span).argmin(1) + np.arange(at, at + len(part) - self.span + 1)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        windows = np.stack([rolling(h, *p, self.window) for h, p in zip(halves, self.powers, strict=True)], 1) if with_windows else None
        return first, np.diff(np.r_[first, len(anchor)]), seeds[anchor[first]].view(np.int64), windows


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def record(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(seed, k, at): every block of every document; ``at`` is its first window."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(window, seed)
        for batch in batches:
            made: list[tuple[np.ndarray, ...]] = []
            for key, text in zip(batch.column("k").to_pylist(), texts_of(batch), strict=True):
                if found := blocks.of(text, False):
                    made.append((found[2], np.full(len(found[0]), key, np.int64), found[0].astype(np.int32)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=["seed", "k", "at"])

    return docs.select("k", "text").mapInArrow(each, "seed long, k long, at int")


def repeated(found: DataFrame) -> DataFrame:
    """(k, places): per document the blocks whose seed occurs more than once, twice their place and one more where
    the seed is very common. Counts are summed before they are shuffled, and each seed's one count joins its
    blocks, so a seed with many blocks can be split. Blocks are found twice, for the counts and for the join: that
    takes less than keeping them."""
    again = cut(found.groupBy("seed").count().where("count > 1").select("seed", (F.col("count") > HOT).cast("int").alias("hot")))
    return found.join(again, "seed").groupBy("k").agg(F.collect_list(2 * F.col("at") + F.col("hot")).alias("places"))


def add_factor(out: list[tuple], k: int, c: int, at: int, n: int, ref: tuple) -> None:
    """Appends the factor of windows ``at`` to ``at + n`` that copies from a place (k, c, id, at); it joins the last one if it goes on there."""
    if out:
        k_, c_, at_, n_, id_, ref_at = out[-1]
        if (k_, c_, id_) == (k, c, ref[2]) and at_ + n_ == at and ref_at + n_ == ref[3]:
            out[-1] = (k, c, at_, n_ + n, id_, ref_at)
            return
    out.append((k, c, at, n, ref[2], ref[3]))


def open_blocks(rows: DataFrame, places: DataFrame, window: int, seed: int) -> DataFrame:
    """The named blocks (part, k, c, id, at, windows): ``part`` is the seed, or the hash of the one window. And the
    factors that a task finds by itself (``windows`` null; n, ref_id, ref_at): a block that it has seen before, and
    the first one like it."""
    schema = "part long, k long, c long, id long, at int, windows binary, n int, ref_id long, ref_at int"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32()]

    def each(batches) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(window, seed)
        seen: dict[bytes, tuple | None] = {}
        told: dict[bytes, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for key, check, own, text, chosen in zip(*(batch.column(n).to_pylist() for n in ("k", "c", "id")), texts_of(batch), batch.column("places").to_pylist(), strict=True):
                if not (found := blocks.of(text, True)):
                    continue
                first, many, seeds, windows = found
                raw, places_, factors = windows.tobytes(), set(chosen), []
                for s, n, part in zip(first.tolist(), many.tolist(), seeds.tolist(), strict=True):
                    hot = 2 * s + 1 in places_
                    if not hot and 2 * s not in places_:
                        continue
                    for a, m in ((s + i, 1) for i in range(n)) if hot else ((s, n),):
                        content = raw[16 * a : 16 * (a + m)]
                        name = content if hot else xxhash.xxh3_128_digest(content)
                        here = (key, check, own, a)
                        if (place := told.get(name)) is not None:
                            add_factor(factors, key, check, a, m, place)
                        elif (place := seen.get(name)) is not None:
                            add_factor(factors, key, check, a, m, place)
                            out.append((key, place[0], place[1], place[2], place[3], None, m, own, a))
                            told[name] = place
                        else:
                            seen[name] = here
                            out.append((int.from_bytes(content[:8], "little", signed=True) if hot else part, *here, content, None, None, None))
                    if len(seen) > HELD:
                        seen.clear()
                        told.clear()
                out += [(k, k, c, own, at, None, n, ref_id, ref_at) for k, c, at, n, ref_id, ref_at in factors]
            if out:
                yield record(out, kinds, schema)

    return rows.join(places, "k").select("id", "text", "k", "c", "places").mapInArrow(each, schema)


def factored(opened: DataFrame) -> DataFrame:
    """(k, c, at, n, ref_id, ref_at): the factors of all blocks: ``n`` windows from ``at`` on copy those from
    ``ref_at`` on. Blocks of one part pass by in order, each is parsed against those before it, and the first place
    of a window becomes a factor too once a second one shows."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        last, seen, told = None, {}, set()
        for batch in batches:
            out: list[tuple] = []
            for part, k, c, own, at, raw, n, ref_id, ref_at in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if raw is None:
                    out.append((k, c, at, n, ref_id, ref_at))
                    continue
                if part != last:
                    last, seen, told = part, {}, set()
                copies: list[tuple] = []
                for i in range(len(raw) // 16):
                    h = raw[16 * i : 16 * i + 16]
                    if (place := seen.get(h)) is None:
                        seen[h] = (k, c, own, at + i)
                        continue
                    add_factor(copies, k, c, at + i, 1, place)
                    if h not in told:
                        told.add(h)
                        add_factor(out, place[0], place[1], place[3], 1, (k, c, own, at + i))
                out += copies
            if out:
                yield record(out, KINDS, FACTOR)

    return opened.repartition("part").sortWithinPartitions("part").mapInArrow(each, FACTOR)


def joined(factors: list[dict], check: int, window: int) -> list[tuple[int, int, int | None, int]]:
    """A document's factors (start, length in words, ref_id, ref_start) by start; one that goes on where another
    ends is part of it."""
    out: list[tuple] = []
    own = ((x["at"], x["n"], x["ref_id"], x["ref_at"]) for x in factors if x["c"] == check)
    for at, n, ref_id, ref_at in sorted(own, key=lambda x: (x[0], -x[1], x[2] is None, x[2] or 0, x[3])):
        add_factor(out, 0, 0, at, n, (0, 0, ref_id, ref_at))
    return [(at, n + window - 1, ref_id, ref_at) for _, _, at, n, ref_id, ref_at in out]


def kept_words(text: bytes, factors: list[tuple[int, int, int | None, int]]) -> tuple[list[bytes], int]:
    """The words outside all factors, and how many words there are."""
    words = text.split()
    if not factors:
        return words, len(words)
    cover = np.zeros(len(words) + 1, np.int32)
    for start, length, _, _ in factors:
        cover[start] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)], len(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words of windows that occur more than once.

    Returns (doc_id, n_words, n_removed, kept_text, factors): the words that stay, joined by one space, and the
    factors (start, length, ref_id, ref_start) that cover those that go, as places of words. Words are runs outside
    ASCII white space, compared byte for byte. A null or blank text has no words; a text shorter than the window
    loses none. Rows are compared as rows: a null id or one that repeats makes no difference, and of rows that
    are equal every window occurs in each. Other columns are not read; an empty table gives no rows.
    """
    if not 0 < seed <= window:
        raise ValueError("a seed stands inside its window")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"k": F.xxhash64("id", "text"), "c": F.xxhash64("text", F.lit("c"), "id")})
    opened = open_blocks(rows, repeated(anchors(rows, window, seed)), window, seed)
    found = factored(opened).groupBy("k").agg(F.collect_list(F.struct("c", "at", "n", "ref_id", "ref_at")).alias("found"))
    made = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start: int, length: int, ref_id: long, ref_start: int>>"
    span = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())])

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, check, marks in zip(batch.column("id").to_pylist(), texts_of(batch), batch.column("c").to_pylist(), batch.column("found").to_pylist(), strict=True):
                factors = joined(marks or [], check, window)
                kept, n = kept_words(text or b"", factors)
                out.append((key, n, n - len(kept), b" ".join(kept), [dict(zip(("start", "length", "ref_id", "ref_start"), x, strict=True)) for x in factors]))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            texts = pa.array(columns[3], pa.binary()).cast(pa.string())
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [texts, pa.array(columns[4], pa.list_(span))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    return rows.join(found, "k", "left").select("id", "text", "k", "c", "found").mapInArrow(each, made)
