"""Two tokenizers aligned: where tokens of both end at one byte, a text is cut into groups, and tokens of a group are linked.

Python only tokenises: it cuts texts into pieces where both tokenizers end a token in any text, and hands over, for
batches of whole documents, every document as the numbers of its pieces and, once, the tokens of every distinct piece
with the places where both end one. Pieces that many batches hold are counted over all documents beforehand, and at
most ``OFTEN`` of them are tokenised and grouped once for the whole table: they have numbers of their own, and no
batch stores them again. How many there are only tells where a piece is grouped.

Everything after it is Spark's array functions: groups are written out and crossed to links, documents are lists of
pieces. Their texts are read from arrays by number; those of pieces met often are one broadcast row. What a document adds up
over pieces met often comes by a join with a broadcast table of their numbers; the links of other pieces become rows.

How many documents hold a pair is counted over all documents. A document gives each pair once, so nothing has
to be made distinct by a shuffle, and tasks add up before it. The counts come back to the links by a broadcast of at
most ``HOT`` pairs, which are all of them or those that more than a ``HOT``-th of all entries have; the links of rarer
pairs are shuffled.
"""

from __future__ import annotations

import json
import re
from array import array
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import tokens
from vitrine.llm.shared import stored

HOT = 500_000  # pairs that may be broadcast: two longs and a flag each
BATCH = 1 << 19  # bytes of text after which a task hands over what it has
OFTEN, WORD = 150_000, 40  # pieces that are grouped once for all batches, and the longest of them
COUNTED = 2_000_000  # pieces of batches that a task holds before it hands over those it has met twice
ROWS = 1000  # documents that go to Python at once
PER_FILE = 4  # batches in a stored file: readers of columns hold all rows of one, up to thousands, at once
FEW = 64  # tokens of a piece that has arrays of its own
RUN = 1000  # pieces that are tokenised together
SHORT = 200  # pieces up to this go to the fast merges, longer ones to those whose time doesn't grow with the square
#: Neither tokenizer joins what stands before a space to a letter or digit after it, where no other space stands before.
BORDER = re.compile(r"(?<=[^ ]) (?=[^\W_])")
SPACE = "▁"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Both:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        told = json.loads(self.a.to_str())
        self.bytes_a = tokens.bytes_of_ids(self.a)
        self.bytes_b = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        plain = tokens.splits_at_spaces(told)
        self.cut_alike = plain and not any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b.get_piece_size()))
        self.fast = tokens.merges(told, dict(enumerate(self.bytes_a))) if plain and tokens.merged_in_order(told) else None
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int32) for x in (self.bytes_a, self.bytes_b))

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def ids_a(self, piece: str) -> list[int]:
        return self.fast(" " + piece) if self.fast and len(piece) <= SHORT else self.a.encode(" " + piece, add_special_tokens=False).ids

    def pieces(self, texts) -> tuple[np.ndarray, object]:
        """(the pieces that come before each text and all, the pieces): texts, an Arrow array, cut before each space between
        another character and a letter or digit. Null and empty texts have none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        if not self.cut_alike:
            return np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))], texts.filter(some)
        words = pc.split_pattern(texts.filter(some), " ")
        flat, first = words.flatten(), words.offsets.to_numpy()
        first = first - first[0]
        begins = pc.utf8_is_alnum(pc.utf8_slice_codeunits(flat, 0, 1)).to_numpy(zero_copy_only=False).copy()
        begins[1:] &= pc.binary_length(flat).to_numpy()[:-1] > 0
        begins[first[:-1]] = True
        at = np.flatnonzero(begins)
        made = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(flat)].astype(np.int32)), flat), " ")
        n = np.zeros(len(texts), np.int64)
        n[some.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(at, first))
        return np.r_[0, np.cumsum(n)], made

    def tokens_a(self, pieces: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has). Pieces that go on where a text may be cut are tokenised together; they part where
        their bytes end (``size``), and where a token doesn't end there, each goes alone."""
        import pyarrow as pa
        import pyarrow.compute as pc

        alone = np.ones(len(pieces), bool)
        if self.fast and self.cut_alike and pieces:
            told = pa.array(pieces, pa.string())
            begins = pc.utf8_is_alnum(pc.utf8_slice_codeunits(told, 0, 1))
            some = pc.and_(pc.and_not(begins, pc.ends_with(told, " ")), pc.less_equal(pc.utf8_length(told), SHORT))
            alone = ~some.to_numpy(zero_copy_only=False)
        first = np.r_[True, alone[1:] | alone[:-1]][: len(pieces)]
        first[::RUN] = True
        at = np.flatnonzero(first)
        ids, n = array("i"), array("i")
        for s, e in zip(at.tolist(), [*at[1:].tolist(), len(pieces)], strict=False):
            if e - s > 1:
                some = self.fast(" " + " ".join(pieces[s:e]))
                ends, wanted = np.cumsum(self.size_a[some]), np.cumsum(size[s:e])
                place = np.searchsorted(ends, wanted)
                if place[-1] < len(ends) and (ends[place] == wanted).all():
                    ids.extend(some)
                    n.extend(np.diff(place, prepend=-1).tolist())
                    continue
            for piece in pieces[s:e]:
                some = self.ids_a(piece)
                ids.extend(some)
                n.append(len(some))
        return np.array(ids, np.int32), np.array(n, np.int32)

    def tokenised(self, pieces: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(the place of each piece among those that both tokenizers give back byte by byte, or -1; the arrays
        ids_a, n_a, ids_b, n_b of these, the tokens of each after one another)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = "".join([" " + x for x in pieces]).encode()
        size = 1 + pc.binary_length(pa.array(pieces, pa.string())).to_numpy().astype(np.int64)
        upto = np.cumsum(np.r_[0, size])
        b = self.b.encode(pieces, num_threads=1) if pieces else []
        n_b = np.fromiter(map(len, b), np.int32, len(pieces))
        sides = [self.tokens_a(pieces, size), (np.fromiter(chain.from_iterable(b), np.int32, int(n_b.sum())), n_b)]
        good = np.ones(len(pieces), bool)
        for (ids, n), own, sizes in zip(sides, (self.bytes_a, self.bytes_b), (self.size_a, self.size_b), strict=True):
            back = b"".join(map(own.__getitem__, ids.tolist()))
            ends = np.cumsum(np.r_[0, sizes[ids]], dtype=np.int64)[np.cumsum(np.r_[0, n])]
            if back != whole or not np.array_equal(ends, upto):
                good &= np.fromiter((back[ends[i] : ends[i + 1]] == whole[upto[i] : upto[i + 1]] for i in range(len(pieces))), bool, len(pieces))
        kept = [x for ids, n in sides for x in (ids[np.repeat(good, n)], n[good])]
        return np.where(good, np.cumsum(good, dtype=np.int32) - 1, -1).astype(np.int32), kept


@lru_cache(maxsize=2)
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


@contextmanager
def rows_at_once(spark: SparkSession, most: int):
    """While it lasts, tasks hand Python at most so many rows at once: an Arrow batch is held by both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts_of(made: Both, batch):
    """A batch (row, id, text) in parts of about ``BATCH`` bytes of text: (the part, ends of its documents' pieces from 0, pieces)."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH)))
        part = batch.slice(at, to - at)
        yield part, *made.pieces(part.column(2))
        at = to


def met_often(docs: DataFrame, path_a: str, path_b: str) -> list[str]:
    """At most ``OFTEN`` short pieces that most batches of all documents hold, by counts in which a task may miss those that it meets once."""

    def counted(inputs):
        import pyarrow as pa
        import pyarrow.compute as pc

        made, met = both(path_a, path_b), []

        def told():
            some = pa.chunked_array(met, pa.string()).value_counts()
            met.clear()
            some = some.filter(pc.greater(some.field("counts"), 1))
            return pa.RecordBatch.from_arrays([some.field("values"), some.field("counts")], names=["piece", "n"])

        for b in inputs:
            for _, _, pieces in parts_of(made, b):
                each = pieces.dictionary_encode().dictionary
                met.append(each.filter(pc.less_equal(pc.binary_length(each), WORD)))
                if sum(map(len, met)) > COUNTED:
                    yield told()
        yield told()

    found = docs.mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in found.orderBy(F.desc("n"), "piece").limit(OFTEN).select("piece").collect()]


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


TOKENS = "few array<struct<n_a: int, n_b: int, groups: array<struct<a: array<int>, b: array<int>>>>>, ids_a array<int>, upto_a array<int>, at_a array<int>, ids_b array<int>, upto_b array<int>, at_b array<int>, at_p array<int>"
NAMES = ["few", "ids_a", "upto_a", "at_a", "ids_b", "upto_b", "at_b", "at_p"]


def places(ends_a: np.ndarray, ends_b: np.ndarray, ends_p: np.ndarray) -> list[np.ndarray]:
    """How many tokens of each side, and how many cuts up to the end of each piece, come up to each byte where both sides end one,
    with a 0 in front."""
    cuts = np.intersect1d(ends_a, ends_b)
    return [np.r_[0, np.searchsorted(x, y, "right")].astype(np.int32) for x, y in ((ends_a, cuts), (ends_b, cuts), (cuts, ends_p))]


def told_tokens(made: Both, pieces: list[str]) -> tuple[np.ndarray, list]:
    """(the number of each piece, or -1; one row of ``TOKENS``): short pieces come first, each with arrays of its own, the tokens of
    each group; of long ones upto counts tokens on over all of them, and ``places`` tell where groups end."""
    import pyarrow as pa

    at, (ids_a, n_a, ids_b, n_b) = made.tokenised(pieces)
    few = n_a + n_b <= FEW
    order = np.argsort(~few, kind="stable")
    place = np.empty(len(order) + 1, np.int32)
    place[order], place[-1] = np.arange(len(order)), -1

    def of(some):
        ids, n = [x[np.repeat(some, k)] for x, k in ((ids_a, n_a), (ids_b, n_b))], [n_a[some], n_b[some]]
        ends = [np.cumsum(size[x], dtype=np.int64) for x, size in zip(ids, (made.size_a, made.size_b), strict=True)]
        upto = [np.cumsum(x, dtype=np.int32) for x in n]
        return ids, n, upto, places(*ends, ends[0][upto[0] - 1])

    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    ids, n, _, (at_a, at_b, at_p) = of(few)
    groups = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(k), pa.array(x)) for k, x in ((at_a, ids[0]), (at_b, ids[1]))], names=["a", "b"])
    short = pa.StructArray.from_arrays([pa.array(n[0]), pa.array(n[1]), pa.ListArray.from_arrays(pa.array(at_p), groups)], names=["n_a", "n_b", "groups"])
    ids, _, upto, (at_a, at_b, at_p) = of(~few)
    return place[at], [one(short), *(one(pa.array(x)) for x in (ids[0], upto[0], at_a, ids[1], upto[1], at_b, at_p))]


def tokenised(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, often: list[str] | None = None) -> DataFrame:
    """One row per batch of documents: docs (row, id, pieces: none where a text has no tokens, own) and the tokens of its distinct pieces
    that aren't in ``often`` (see ``told_tokens``). The numbers of pieces in ``often`` are their places there, those of others go on;
    ``own`` has the others alone, numbered from 0."""
    known = docs.sparkSession.sparkContext.broadcast(often or [])

    def batches(inputs):
        import pyarrow as pa
        import pyarrow.compute as pc

        made, many = both(path_a, path_b), np.int32(len(known.value))
        told = pa.array(known.value, pa.string())
        for b in inputs:
            for part, ends, pieces in parts_of(made, b):
                coded = pieces.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=told), -1).to_numpy(zero_copy_only=False).copy()
                new = np.flatnonzero(place < 0)
                at, arrays = told_tokens(made, coded.dictionary.take(pa.array(new)).to_pylist())
                place[new] = np.where(at < 0, -1, at + many)
                own = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int32)
                bad = np.cumsum(np.r_[0, own < 0])
                bad = bad[ends[1:]] > bad[ends[:-1]]  # documents with a piece that a tokenizer doesn't give back
                n = np.diff(ends)
                own, upto = own[~np.repeat(bad, n)], np.cumsum(np.r_[0, np.where(bad, 0, n)])
                rest = own >= many
                upto_rest = np.cumsum(np.r_[0, rest])[upto]
                lists = [pa.ListArray.from_arrays(pa.array(k.astype(np.int32)), pa.array(x)) for k, x in ((upto, own), (upto_rest, own[rest] - many))]
                docs_ = pa.StructArray.from_arrays([*part.columns[:2], *lists], names=["row", "id", "pieces", "own"])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(docs_), *arrays], names=["docs", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(batches, f"docs array<struct<row: bigint, id: {kind}, pieces: array<int>, own: array<int>>>, {TOKENS}")


def grouped_once(spark: SparkSession, often: list[str], path_a: str, path_b: str) -> tuple[list[str], DataFrame]:
    """Those of ``often`` that both tokenizers give back, and one row: known, their parts in this order (see ``grouped``)."""

    def tokens_of(inputs):
        import pyarrow as pa

        made = both(path_a, path_b)
        for b in inputs:
            at, arrays = told_tokens(made, b.column(1).to_pylist())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            kept = pa.array(at >= 0)
            yield pa.RecordBatch.from_arrays([one(b.column(0).filter(kept)), one(pa.array(at).filter(kept)), *arrays], names=["number", "at", *NAMES])

    rows = spark.createDataFrame([*enumerate(often)], "number long, piece string")
    made = parts_grouped(rows.repartition(16).mapInArrow(tokens_of, f"number array<bigint>, at array<int>, {TOKENS}"))
    each = made.select(F.explode(F.transform(F.arrays_zip("number", "at"), lambda x: F.struct(x["number"].alias("number"), F.get(F.col("parts"), x["at"]).alias("part")))).alias("x")).select("x.*")
    each = stored(each, "often")
    kept = sorted(r["number"] for r in each.select("number").collect())
    return [often[i] for i in kept], each.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "part"))), lambda x: x["part"]).alias("known"))


def between(values: Column, at: Column, k: Column) -> Column:
    """The values of the ``k``-th stretch."""
    return F.slice(values, F.get(at, k) + 1, F.get(at, k + 1) - F.get(at, k))


def stretches(at: str, f) -> Column:
    """``f`` of the number of each stretch, in order."""
    return F.when(F.size(at) > 1, F.transform(F.sequence(F.lit(0), F.size(at) - 2), f))


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, not again for every entry that reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def code(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32) + b


def pair(x: Column, y: Column, n: Column) -> Column:
    return F.struct(code(x, y).alias("code"), n.cast("long").alias("n"))


def crossed(in_a: Column, in_b: Column) -> Column:
    """The distinct pairs of a group's ids, each with its occurrences."""
    times = lambda ids, x: F.size(F.filter(ids, lambda y: y == x)).cast("long")
    cross = lambda xs, ys, n: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: pair(x, y, n(x, y)))))
    once = lambda ids: F.size(F.array_distinct(ids)) == F.size(ids)
    repeated = cross(F.array_distinct(in_a), F.array_distinct(in_b), lambda x, y: times(in_a, x) * times(in_b, y))
    return F.when(once(in_a) & once(in_b), cross(in_a, in_b, lambda x, y: F.lit(1))).otherwise(repeated)


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def part(n_a: Column, n_b: Column, n_groups: Column, text: Column, links: Column) -> Column:
    return F.struct(*(x.cast("int").alias(c) for x, c in ((n_a, "n_a"), (n_b, "n_b"), (n_groups, "n_groups"))), text.alias("text"), links.alias("links"))


def written(a: Column, b: Column) -> Column:
    """A group of two tokens; ``concat_ws`` takes twice the time for every entry."""
    return F.concat(a.cast("string"), F.lit("|"), b.cast("string"))


def of_few(p: Column) -> Column:
    """The part of a short piece."""
    first = lambda g: (F.get(g["a"], F.lit(0)), F.get(g["b"], F.lit(0)))
    single = lambda g: (F.size(g["a"]) == 1) & (F.size(g["b"]) == 1)
    text = lambda g: F.when(single(g), written(*first(g))).otherwise(F.concat_ws("|", joined(g["a"]), joined(g["b"])))
    links = lambda g: F.when(single(g), F.array(pair(*first(g), F.lit(1)))).otherwise(crossed(g["a"], g["b"]))
    return part(p["n_a"], p["n_b"], F.size(p["groups"]), F.array_join(F.transform(p["groups"], text), ";"), F.flatten(F.transform(p["groups"], links)))


def of_long() -> Column:
    """The parts of all long pieces of a row."""
    a, b, at_a, at_b, at_p = (F.col(c) for c in ("ids_a", "ids_b", "at_a", "at_b", "at_p"))
    single = lambda k: (F.get(at_a, k + 1) - F.get(at_a, k) == 1) & (F.get(at_b, k + 1) - F.get(at_b, k) == 1)
    first = lambda k: (F.get(a, F.get(at_a, k)), F.get(b, F.get(at_b, k)))
    text = lambda k: F.concat_ws("|", *(joined(between(ids, at, k)) for ids, at in ((a, at_a), (b, at_b))))
    texts = stretches("at_a", lambda k: F.when(single(k), written(*first(k))).otherwise(text(k)))
    links = stretches("at_a", lambda k: F.when(single(k), F.array(pair(*first(k), F.lit(1)))).otherwise(let(between(a, at_a, k), lambda x: let(between(b, at_b, k), lambda y: crossed(x, y)))))
    size = lambda c, k: F.get(F.col(c), k + 1) - F.get(F.col(c), k)
    of = lambda t, x: lambda k: part(size("upto_a", k), size("upto_b", k), size("at_p", k), F.array_join(between(t, at_p, k), ";"), F.flatten(between(x, at_p, k)))
    return let(texts, lambda t: let(links, lambda x: stretches("at_p", of(t, x))))


FIELDS = ["n_a", "n_b", "n_groups", "text", "links"]
PARTS = "array<struct<n_a: int, n_b: int, n_groups: int, text: string, links: array<struct<code: bigint, n: bigint>>>>"


def parts_grouped(made: DataFrame) -> DataFrame:
    """``made`` with parts instead of tokens: of each piece, by number, n_a, n_b, n_groups, its groups as text, and its
    links: (code, n) for each pair of each of its groups, n its occurrences there."""
    rest = [c for c in made.columns if c not in NAMES]
    parts = F.concat(F.transform("few", of_few), F.coalesce(of_long(), F.array().cast(PARTS)))
    return made.withColumns({c: F.concat(F.array(F.lit(0)), c) for c in ("upto_a", "upto_b")}).select(*rest, parts.alias("parts"))


def grouped(made: DataFrame) -> DataFrame:
    """One row per batch: docs, and a column of each field of its pieces' parts."""
    return parts_grouped(made).select("docs", *(F.col("parts")[c].alias(c) for c in FIELDS))


def of_either(often: Column, own: Column | None, p: Column, many: int) -> Column:
    """The entry of the piece of number ``p``, in ``often`` for the first ``many``, in ``own`` for the others."""
    return F.when(p < many, F.get(often, p)).otherwise(F.get(own, p - many))


def counted(batches: DataFrame, known: DataFrame, many: int) -> DataFrame:
    """(code, n, best): the documents that hold each pair, and whether no pair of its first id has more. ``known``: one row,
    the parts of the ``many`` pieces that are numbered first."""
    codes = lambda links: F.transform(links, lambda x: x["code"])
    known = known.select(F.transform("known", lambda x: x["links"]["code"]).alias("often"))
    of = lambda d, own: F.array_distinct(F.flatten(F.transform(F.array_distinct(d["pieces"]), lambda p: of_either(F.col("often"), own, p, many))))
    each = let(F.transform("links", codes), lambda own: F.transform("docs", lambda d: of(d, own)))
    each = batches.select("docs", "links").join(F.broadcast(known)).select(F.explode(each).alias("codes")).select(F.explode("codes").alias("code"))
    pairs = stored(each.groupBy("code").agg(F.count("*").alias("n")), "pairs")
    most = pairs.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("n").alias("most"))
    return pairs.join(most, F.shiftright("code", 32) == F.col("a")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def summed(links: DataFrame, by: str, often: DataFrame, rest: DataFrame | None) -> DataFrame:
    """(by, s, b, l) for links (by, code, times): the sum of their counts, how many have the highest of their first id, and how many
    there are. ``often``: counts to broadcast, ``rest``: the others. Pairs of documents without tokens have no count."""
    add = lambda df: df.groupBy(by).agg(F.sum(F.col("times") * F.col("n")).alias("s"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum("times").alias("l"))
    each = links.join(F.broadcast(often), "code", "inner" if rest is None else "left")
    sums = add(each.where(F.col("n").isNotNull()))
    if rest is None:
        return sums
    rare = each.where(F.col("n").isNull()).select(by, "code", "times").join(rest, "code")
    return sums.unionByName(add(rare)).groupBy(by).agg(*(F.sum(c).alias(c) for c in "sbl"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, told=lambda text: text) -> DataFrame:
    """Per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, and ``groups``.

    ``groups`` is ``told`` of a text that writes each group as ``a1,a2|b1``, groups joined by ``;``. ``n_best`` counts the
    links whose pair is held by as many documents as any pair of its first id (ties all count); ``count_sum`` adds
    up those documents over the links. Strings of special tokens are plain text.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte behind one space, have no tokens:
    zeros and ``told`` of ''. Every row is a document of its own, whatever its id: null and repeated ids and equal rows
    stay and each counts. Other columns are left out and may have any name. An empty table gives no rows.
    """
    paths = path_a or tokens.default_path(), path_b or piece_path()
    with rows_at_once(docs.sparkSession, ROWS):
        often, known = grouped_once(docs.sparkSession, met_often(texts_of(docs, id_col, text_col), *paths), *paths)
        batches = stored(grouped(tokenised(docs, id_col, text_col, *paths, often)), "aligned", PER_FILE)
    many = len(often)
    counts = stored(counted(batches, known, many), "counts")
    total = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("entries")).first()
    often, rest = counts, None
    if total["pairs"] > hot:
        often, rest = counts.where(F.col("n") > total["entries"] // hot), counts.where(F.col("n") <= total["entries"] // hot)

    parts = stored(known.select(F.posexplode("known").alias("number", "part")), "known")
    links = parts.select("number", F.explode("part.links").alias("x")).select("number", "x.code", F.col("x.n").alias("times"))
    numbers = [*FIELDS[:3], *"sbl"]
    each = parts.join(summed(links, "number", often, rest), "number", "left").select("number", *(F.col("part")[c].cast("long").alias(c) for c in FIELDS[:3]), *(F.coalesce(c, F.lit(0)).alias(c) for c in "sbl"))
    places_ = batches.select(F.explode("docs").alias("d")).select("d.row", F.explode("d.pieces").alias("number"))
    met = places_.join(F.broadcast(each), "number").groupBy("row").agg(*(F.sum(c).alias(f"often_{c}") for c in numbers))

    others = lambda d: F.flatten(F.transform(d["own"], lambda p: F.get(F.col("links"), p)))
    each = batches.select(F.explode(F.transform("docs", lambda d: F.struct(d["row"].alias("row"), others(d).alias("links")))).alias("d")).select("d.row", F.explode("d.links").alias("x"))
    sums = summed(each.select("row", "x.code", F.col("x.n").alias("times")), "row", often, rest)

    in_order = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "part.text"))), lambda x: x["text"]).alias("often"))
    add = lambda d, c: F.aggregate(d["own"], F.lit(0).cast("long"), lambda n, p: n + F.get(F.col(c), p))
    text = lambda d: F.array_join(F.transform(d["pieces"], lambda p: of_either(F.col("often"), F.col("text"), p, many)), ";")
    whole = lambda d: F.struct(d["row"].alias("row"), d["id"].alias("id"), *(add(d, c).alias(c) for c in FIELDS[:3]), told(text(d)).alias("groups"))
    out = batches.select("docs", *FIELDS[:-1]).join(F.broadcast(in_order)).select(F.explode(F.transform("docs", whole)).alias("d")).select("d.*").join(sums, "row", "left").join(met, "row", "left")
    of = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"often_{c}", F.lit(0))).cast("long")
    return out.select(F.col("id").alias(id_col), *(of(c).alias(c) for c in FIELDS[:3]), of("l").alias("n_links"), of("b").alias("n_best"), of("s").alias("count_sum"), "groups")
