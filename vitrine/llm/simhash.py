"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes by position. Two fingerprints that differ in at most ``d`` bits
differ in at most ``d`` bytes, so they share at least ``8 - d`` positional bytes: that is the count filter.
The index holds one entry for every choice of ``8 - d`` positions (four of eight, for ``d`` = 4) with the bytes
there: two fingerprints meet in as many lists as there are choices among the bytes that they share, so in one at
least if, and only if, their tally reaches the guaranteed count. The index itself is the count filter, and lists of
32 bits stay short where lists of single bytes would grow with the square of the corpus (a longer guarantee is
filed under six bytes, and its tally is checked in the list). What meets is verified by its bits. Lists give
spanning links, not all pairs, and long lists are dealt out as pairs of blocks.

For a similarity of shingle sets rather than a distance of fingerprints (``similar``) the fingerprints' index gives
candidates, whose shingle sets decide. Its guarantee over bytes doesn't reach all similar sets, so an index of shingles
gives the others: in one order of all shingles, rarest first, each set goes under
its first ones only, as many as a set may lack and still be similar, and one more. Two similar sets share one of
them, so every similar pair is a candidate, and shingle sets decide. How rare a shingle is comes from hashed
counts over all sets; they only set the order, which costs time where it is poor, never a pair. Long lists give
spanning links first; once sets have decided on those, all pairs of a long list follow that they don't connect and
whose sketches allow the similarity: a sketch has the parity of a set's hashes in each of some thousand slots, so two sets
differ in as many shingles as their sketches in bits, at least, and no similar pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import attached, components, cut, spare, stored

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK = 4096  # entries of one list that one task compares with as many others
HELD = 200_000  # different sets that a task remembers
PIECE = 1 << 20  # bytes of a text that are split into words at a time
REACH, SHORT = 15, 40  # of similar(): bits between linked texts of a long list, lists that are compared pair by pair
SKETCH = 1 << 11  # bits of a sketch
SLOTS, RANGES = 1 << 21, 256  # hashed counts of shingles, and the pieces in which they are added up


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time, so that memory doesn't follow the longest text."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes | None, k: int) -> int:
    """SimHash of one text over shingles of ``k`` words, as a signed 64-bit integer; no words: 0."""
    bits, n, kept, words = np.zeros(64, np.int64), 0, [], 0
    for block in word_blocks((text or b"").translate(LOWER)):
        words += len(block)
        kept += block
        if len(kept) >= k:
            shingles = map(b" ".join, zip(*(kept[i:] for i in range(k)), strict=False))
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
            bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
            kept = kept[len(kept) - k + 1 :]
    if not words:
        return 0
    if not n:
        value = np.uint64(xxhash.xxh64_intdigest(b" ".join(kept), 42))
        return int(value.astype(np.int64))
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text; null or blank text: 0."""

    def each(batches):
        for batch in batches:
            out = [fingerprint(x, k) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "id long, fp long")


def index_entries(classes: DataFrame, d: int) -> DataFrame:
    """(key, fp): the entries of every distinct fingerprint under each choice of positions."""
    need = 8 - d
    if not 0 < need <= 8:
        raise ValueError("a byte-position index needs a distance from 0 to 7")
    many = min(6, need)
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(8)]
    keys = []
    for c, positions in enumerate(combinations(range(8 - need + many), many)):
        key = F.lit(c).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    return classes.select("fp", F.explode(F.array(*keys)).alias("key"))


def list_links(fp: np.ndarray, d: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one list: a breadth-first walk in which every fingerprint is compared with those
    not yet reached only. Pairs whose tally of shared bytes is below ``8 - d`` (the list's key has six at most) drop
    out before their bits are verified."""
    left, wait = fp[1:], [fp[0]]
    while len(left):
        if not wait:
            wait, left = [left[0]], left[1:]
            continue
        at = wait.pop()
        x = left ^ at
        if 8 - d > 6:
            met = np.flatnonzero((x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= 8 - d)
            near = np.zeros(len(x), bool)
            near[met] = np.bitwise_count(x[met]) <= d
        else:
            near = np.bitwise_count(x) <= d
        if near.any():
            yield from ((int(at), int(y)) for y in left[near])
            wait += list(left[near])
            left = left[~near]


def links(classes: DataFrame, d: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs at ``d`` or fewer differing bits."""
    entries = index_entries(classes, d)
    full = entries.groupBy("key").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = (
        entries.join(full, "key")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def walk(batches):
        kept, last = [], None

        def flush():
            values = np.unique(np.array(kept, np.int64)).view(np.uint64)
            found = list(list_links(values, d)) if len(values) > 1 else []
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            return None

        for batch in batches:
            key, fp, i, j = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(4))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(key) else []
            ends = np.r_[starts[1:], len(key)].astype(int) if len(key) else []
            a, b = [], []
            for s, e in zip(starts, ends, strict=True):
                this = (key[s], i[s], j[s])
                if this != last:
                    if last is not None and len(kept) == 2:
                        a.append(kept[0])
                        b.append(kept[1])
                    elif last is not None and (out := flush()) is not None:
                        yield out
                    kept, last = [], this
                kept += fp[s:e].tolist()
            if a:
                x, y = np.array(a, np.int64), np.array(b, np.int64)
                near = np.bitwise_count((x ^ y).view(np.uint64)) <= d
                yield pa.RecordBatch.from_arrays([pa.array(x[near]), pa.array(y[near])], names=["a", "b"])
        if last is not None and (out := flush()) is not None:
            yield out

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(walk, "a long, b long").where("a <> b")


def component_ids(own: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``own`` (id, key) with the smallest id of each class's component. ``classes``: key, first, n; ``found``: node,
    root. A component, or a class, may hold a third of all rows."""
    found = found.withColumnsRenamed({"node": "of"})
    rooted = cut(classes.join(found, F.col(key) == F.col("of"), "left").select(key, "first", "n", F.coalesce("root", key).alias("root")))
    counts = rooted.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    of = attached(rooted, firsts, "root", "component_id", counts["classes"], key).select(key, "component_id", "n")
    return attached(own, of, key, "component_id", counts["rows"], "id")


def near_duplicates(docs: DataFrame, k: int = 4, d: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Returns (doc_id long, fingerprint string of 16 hexadecimal digits, component_id long): the component is
    the smallest id that links reach. Equal fingerprints link, those of documents without words (null, empty
    or blank text: fingerprint 0) like any other. A null id keeps its row with its fingerprint and takes no
    part in links: its component is null. Repeated ids give repeated rows. Other columns are not read; an
    empty table gives no rows.
    """
    own = cut(fingerprints(docs, k, id_col, text_col))
    classes = cut(own.where("id is not null").groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    named = component_ids(own, classes, components(links(classes.select("fp"), d)), "fp")
    return named.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; fewer than ``k`` words: one of the whole sequence."""
    found, words, kept = [], 0, []
    for block in word_blocks((text or b"").translate(LOWER)):
        words += len(block)
        kept += block
        if len(kept) >= k:
            shingles = map(b" ".join, zip(*(kept[i:] for i in range(k)), strict=False))
            found.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))
            kept = kept[len(kept) - k + 1 :]
    if found:
        return np.unique(np.concatenate(found))
    return np.array([xxhash.xxh64_intdigest(b" ".join(kept), 42)] if words else [], np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of 64 bits over a set of shingles, as a signed integer; no shingle: 0."""
    rows, count = hashes.view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for at in range(0, len(rows), 255):  # sums of up to 255 bits fit a byte
        count += np.add.reduce(np.unpackbits(rows[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * count > len(rows), bitorder="little").view(np.int64)[0])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of a set's hashes in each of ``SKETCH`` slots is odd, as bytes."""
    return np.packbits(np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1)


def set_batches(batches, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Rows (id, text) in parts, with the sets of their texts and a 64-bit name of each set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [shingle_set(x, k) for x in part.column(1).cast(pa.binary()).to_pylist()]
            yield part, made, np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in made), np.uint64, len(made)).view(np.int64)


def new_sets(batches, k: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Sets that are not empty, with their names; a task gives one that it remembers once only."""
    seen: set[int] = set()
    for _, made, names in set_batches(batches, k):
        fresh = []
        for s, node in zip(made, names.tolist(), strict=True):
            if len(s) and node not in seen:
                if len(seen) == HELD:
                    seen.clear()
                seen.add(node)
                fresh.append((s, node))
        if fresh:
            yield [s for s, _ in fresh], [node for _, node in fresh]


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


def levels(rows: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each slot are in all texts (id, text), eight steps to a doubling; 0: at most one.
    Equal sets of one task count once."""

    def counted(batches):
        total = np.zeros(SLOTS, np.int64)
        held, many = [], 0
        for made, _ in new_sets(batches, k):
            held += made
            many += sum(map(len, made))
            if many > SLOTS:
                total += np.bincount(slots(np.concatenate(held)), minlength=SLOTS)
                held, many = [], 0
        if held:
            total += np.bincount(slots(np.concatenate(held)), minlength=SLOTS)
        made = [x.tobytes() for x in np.minimum(total, 255).astype(np.uint8).reshape(RANGES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(made, pa.binary())], names=["range", "n"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(raw.as_py(), np.uint8).astype(np.int64)
        made = [np.minimum(8 * np.log2(np.maximum(x, 1)), 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(made, pa.binary())], names=["range", "n"])

    schema = "range int, n binary"
    out = np.zeros((RANGES, SLOTS // RANGES), np.uint8)
    for row in rows.mapInArrow(counted, schema).repartition("range").mapInArrow(added, schema).collect():
        out[row["range"]] = np.frombuffer(row["n"], np.uint8)
    return out.ravel()


def prefix(s: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """The places in a sorted set of its rarest shingles, one of which every similar set has among its own."""
    many = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
    return np.argsort(level[slots(s)], kind="stable")[:many]


def may_be_alike(n: np.ndarray, room: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of a list can be similar if its shingle is the first that they share: sizes are ``n``, and
    ``room`` shingles of a set are left from it on."""
    return np.minimum(room[i], room[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6


def near_pairs(node: np.ndarray, fp: np.ndarray, n: np.ndarray, room: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one list: all of a short one; of a long one spanning links, walked from those nearest
    to the list's centre, which stands for what copies have in common."""
    if len(node) <= SHORT:
        i, j = np.triu_indices(len(node), 1)
        near = may_be_alike(n, room, i, j, similarity)
        return node[i[near]], node[j[near]]
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1)
    far = (bits ^ (2 * bits.sum(0, dtype=np.int64) > len(bits)).astype(np.uint8)).sum(1)
    left, a, b = np.lexsort((node, far)), [], []  # the same order in every list, so links repeat and fold
    wait: list[int] = []
    while len(left):
        if wait:
            at = wait.pop(0)
        else:
            at, left = left[0], left[1:]
        near = np.bitwise_count(fp[left] ^ fp[at]) <= REACH
        a += [node[at]] * int(near.sum())
        b += node[left[near]].tolist()
        wait += left[near].tolist()
        left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def lists_of(batches, columns: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, starts, ends): whole lists of rows in order of their first three columns, across batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
        rows = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        key, i, j = rows[:3]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        held = [x[starts[-1] :] for x in rows]  # the last list may go on
        if len(starts) > 1:
            yield rows, starts[:-1], starts[1:]
    if held:
        yield held, np.array([0]), np.array([len(held[0])])


def folded(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Different pairs, smaller first."""
    both = np.stack([np.concatenate(a), np.concatenate(b)], 1).astype(np.int64)
    return np.unique(np.sort(both, axis=1), axis=0)


def dealt_lists(rows: DataFrame, level: np.ndarray, k: int, similarity: float) -> DataFrame:
    """(key, i, j, node, fp, n, room): the lists of the index, long ones as pairs of blocks, rows of one in order.
    A set that stands in texts of several tasks may be in a list as often."""
    known = rows.sparkSession.sparkContext.broadcast(level)

    def listed(batches):
        for sets, names in new_sets(batches, k):
            made: list[list[np.ndarray]] = [[], [], [], [], []]
            for s, node in zip(sets, names, strict=True):
                own = prefix(s, known.value, similarity)
                room = len(s) - np.arange(len(own), dtype=np.int32)
                more = known.value[slots(s[own])] > 0  # others stand in this set only
                if more.any():
                    fp = set_fingerprint(s)
                    for x, y in zip(made, (s[own[more]].view(np.int64), node, fp, len(s), room[more]), strict=True):
                        x.append(y if isinstance(y, np.ndarray) else np.full(int(more.sum()), y))
            if made[0]:
                kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(made, kinds, strict=True)], names=["key", "node", "fp", "n", "room"])

    entries = rows.mapInArrow(listed, "key long, node long, fp long, n int, room int")
    full = entries.groupBy("key").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rest = "node", "fp", "n", "room"
    return (
        entries.join(full, "key")
        .select("key", *rest, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rest)
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )


def candidates(texts: DataFrame, level: np.ndarray, k: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of sets of ``texts`` (id, text) that share one of their rarest shingles and whose sizes allow the
    similarity: all of short lists, spanning links of long ones. And the rows (key, i, j, node, n, room) of long lists."""

    def walk(batches):
        for rows, starts, ends in lists_of(batches, 7):
            node, fp, n, room = rows[3], rows[4].view(np.uint64), rows[5], rows[6]
            two = starts[ends - starts == 2]
            near = may_be_alike(n, room, two, two + 1, similarity)
            a, b = [node[two[near]]], [node[two[near] + 1]]
            long = []
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                at = s + np.unique(node[s:e], return_index=True)[1]
                x, y = near_pairs(node[at], fp[at], n[at], room[at], similarity)
                a.append(x)
                b.append(y)
                if len(at) > SHORT:
                    long.append(at)
            both = folded(a, b)
            nulls = [pa.nulls(len(both), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *nulls], names=names)
            if long:
                key, i, j, of, size, left = (pa.array(rows[c][np.concatenate(long)]) for c in (0, 1, 2, 3, 5, 6))
                yield pa.RecordBatch.from_arrays([of, pa.nulls(len(of), pa.int64()), key, i, j, size, left], names=names)

    names = ["a", "b", "key", "i", "j", "n", "room"]
    found = cut(dealt_lists(texts, level, k, similarity).mapInArrow(walk, "a long, b long, key long, i int, j int, n int, room int"))
    return found.where("a <> b").select("a", "b").distinct(), found.where("b is null").select("key", "i", "j", F.col("a").alias("node"), "n", "room")


def pairs_across(long: DataFrame, found: DataFrame, texts: DataFrame, classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b): all candidate pairs of long lists whose sets no link connects yet (``found``: node, root) and whose sketches allow the
    similarity; ``texts`` and ``classes`` as in ``verified``."""

    def sketched(batches):
        for _, made, names in set_batches(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([sketch(x).tobytes() for x in made], pa.binary())], names=["of_bits", "bits"])

    def walk(batches):
        a, b, many = [], [], 0
        for rows, starts, ends in lists_of(batches, 8):
            for s, e in zip(starts, ends, strict=True):
                node, n, room = rows[3][s:e], rows[4][s:e], rows[5][s:e]
                bits = np.frombuffer(b"".join(rows[7][s:e]), np.uint64).reshape(e - s, -1)
                _, group, count = np.unique(rows[6][s:e], return_inverse=True, return_counts=True)
                largest, every = group == count.argmax(), np.arange(e - s)
                for x in np.flatnonzero(~largest):
                    y = np.flatnonzero((group != group[x]) & (largest | (every > x)))
                    y = y[may_be_alike(n, room, y, np.full(len(y), x), similarity)]
                    apart = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
                    y = y[apart <= (1 - similarity) / (1 + similarity) * (n[y].astype(np.int64) + n[x]) + 1e-6]
                    a.append(np.full(len(y), node[x]))
                    b.append(node[y])
                    many += len(y)
                    if many > 1 << 20:
                        both, a, b, many = folded(a, b), [], [], 0
                        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
        if a:
            both = folded(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    nodes = long.select("node").distinct()
    firsts = classes.join(nodes, "node", "left_semi").select(F.col("first").alias("id"))
    own = texts.join(firsts, "id", "left_semi").select("id", "text").mapInArrow(sketched, "of_bits long, bits binary").dropDuplicates(["of_bits"])
    roots = found.select(F.col("node").alias("of"), "root")
    rows = long.join(roots, F.col("node") == F.col("of"), "left").join(own, F.col("node") == F.col("of_bits"))
    rows = rows.select("key", "i", "j", "node", "n", "room", F.coalesce("root", "node").alias("root"), "bits")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(walk, "a long, b long").where("a <> b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs of sets that are as similar; ``classes``: node, first, the smallest id in ``texts`` (id, text)."""

    def alike(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield kept

    def sets(batches):
        for part, made, names in set_batches(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in made], pa.binary())], names=["node", "s"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    firsts = classes.join(nodes, "node", "left_semi").select(F.col("first").alias("id"))
    own = stored(texts.join(firsts, "id", "left_semi").select("id", "text").mapInArrow(sets, "node long, s binary"), "sets")
    x, y = own.select(F.col("node").alias("a"), F.col("s").alias("x")), own.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def fingerprint_pairs(classes: DataFrame, d: int = 4) -> DataFrame:
    """Candidate pairs (a, b) of sets by their fingerprints (``classes``: node, fp): each with the first of its fingerprint,
    and firsts whose fingerprints ``links`` connects at ``d`` bits."""
    leads = cut(classes.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n")))
    total = leads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = attached(classes.select("node", "fp"), leads, "fp", "lead", total, "node").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    x, y = (leads.select(F.col("fp").alias(c), F.col("lead").alias(f"of_{c}")) for c in "ab")
    near = cut(links(leads.select("fp"), d).distinct()).join(x, "a").join(y, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): groups that links between texts of at least ``similarity`` connect (Jaccard over
    sets of ``k``-word shingles), each named after its smallest id. Nulls, blanks, repeats and empty tables as
    in ``near_duplicates``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def each(batches):
        for part, made, names in set_batches(batches, k):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array([*map(set_fingerprint, made)], pa.int64())], names=["id", "node", "fp"])

    own = cut(rows.mapInArrow(each, "id long, node long, fp long"))
    classes = cut(own.where("id is not null").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min("fp").alias("fp")))
    own = own.select("id", "node")
    texts = rows.where("id is not null")
    pairs, long = candidates(texts, levels(texts, k), k, similarity)
    pairs = cut(pairs.unionByName(fingerprint_pairs(classes)).distinct())
    alike = cut(verified(pairs, texts, classes, k, similarity))
    found = components(alike)
    more = cut(pairs_across(long, found, texts, classes, k, similarity))
    if not more.isEmpty():
        found = components(alike.unionByName(verified(more, texts, classes, k, similarity)))
    named = component_ids(own, classes, found, "node")
    return named.select(F.col("id").alias("doc_id"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of every group (``similar``) the row with the smallest id stays, whole
    and with all its columns. Rows whose id is null stay; of rows that repeat one id, all stay or go together."""
    found = similar(docs, k, similarity, id_col, text_col)
    mark = spare(docs, "_gone")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(mark))
    return docs.join(gone.distinct(), F.col(id_col) == F.col(mark), "left_anti")
