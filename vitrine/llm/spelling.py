"""Spelling variants by symmetric deletes: words that differ in one code point meet under a shared key.

Every word is a key itself, and so is every distinct word that one deletion makes of it. An equi-join of the
keys gives the candidates; the exact distance decides. Keys travel as 64-bit sums over code points, from which a
deletion's sum follows in one step, so a word of any length costs what its length is, not its square; as the distance is
verified on the words, sums that agree by chance only make a candidate more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import stored

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG = 64  # words of more code points meet by their digests, so that their keys don't repeat them
BASE = 0x9E3779B97F4A7C15  # any odd number


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n): the words of whole texts, with only A-Z lower-cased, that have ``shortest`` code points and occur
    ``least`` times.

    ``noise``: with h the checksum of "id:word", a word whose h it divides loses the code point h % length. A null id is
    written as nothing.
    """
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({RUN})"), 1)).alias("w"))
    found = found.where(F.length("w") >= shortest).select("id", F.translate("w", UPPER, LOWER).alias("w"))
    if noise:
        h = F.crc32(F.concat_ws(":", "id", "w").cast("binary"))
        at = (h % F.length("w")).cast("int")
        gone = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2, F.length("w")))
        found = found.select(F.when(h % noise == 0, gone).otherwise(F.col("w")).alias("w")).where(F.length("w") >= shortest)
    return found.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def sums(codes: np.ndarray, powers: np.ndarray, less: np.uint64) -> np.ndarray:
    """The sum of a word and, behind it, the distinct sums of its deletions."""
    parts = codes * powers[: len(codes)]
    upto = np.cumsum(parts, dtype=np.uint64)
    return np.concatenate([upto[-1:], np.unique((upto - parts) + (upto[-1] - upto) * less)])


def keys(of: DataFrame) -> DataFrame:
    """(key, own, tag, length, n) for each word of ``of`` (word, tag, n) and each of its keys; ``own``: the key is the word
    itself."""

    def each(batches):
        import pyarrow as pa

        less = np.uint64(pow(BASE, -1, 1 << 64))
        powers = np.empty(0, np.uint64)
        for b in batches:
            made, lengths = [], []
            for w in b.column(0):
                codes = np.frombuffer(w.as_py().encode("utf-32-le"), "<u4").astype(np.uint64)
                if len(codes) > len(powers):
                    powers = np.cumprod(np.full(2 * len(codes), BASE, np.uint64), dtype=np.uint64)
                lengths.append(len(codes))
                made.append(sums(codes + np.uint64(1), powers, less))
            n = np.array([*map(len, made)])
            ends = np.cumsum(n)
            for first in range(0, len(n), 4096):
                last = min(first + 4096, len(n))
                rows = np.repeat(np.arange(first, last), n[first:last])
                own = np.zeros(len(rows), bool)
                own[ends[first:last] - n[first:last] - (ends[first] - n[first])] = True
                key = np.concatenate(made[first:last]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), *(x.take(pa.array(rows)) for x in (b.column(1), pa.array(lengths, pa.int32()), b.column(2)))], names=["key", "own", "tag", "length", "n"])

    return of.select("word", "tag", "n").mapInArrow(each, "key long, own boolean, tag string, length int, n long")


def near(of: DataFrame) -> DataFrame:
    """(word, n, other, m): the ordered pairs of words of ``of`` (word, n) that differ by exactly one inserted, deleted
    or replaced code point; each once. Two such words share exactly one key."""
    tag = F.when(F.length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256)))
    of = of.withColumn("tag", tag)
    found = stored(keys(of), "keys")
    a = found.select("key", F.col("own").alias("own_a"), F.col("tag").alias("word"), "n", F.col("length").alias("la"))
    b = found.select("key", F.col("own").alias("own_b"), F.col("tag").alias("other"), F.col("n").alias("m"), F.col("length").alias("lb"))
    kinds = F.when(F.col("own_a"), F.col("lb") - F.col("la") == 1).when(F.col("own_b"), F.col("la") - F.col("lb") == 1).otherwise(F.col("la") == F.col("lb"))
    met = a.join(b, "key").where(~(F.col("own_a") & F.col("own_b")) & kinds & (F.col("word") != F.col("other"))).select("word", "n", "other", "m")
    exact = F.levenshtein("word", "other", 1) == 1
    long = F.col("word").startswith("#") | F.col("other").startswith("#")
    whole = of.where(F.length("word") > LONG).select("tag", F.col("word").alias("whole"))
    told = met.where(long)
    for c in ("word", "other"):
        told = told.join(whole, told[c] == F.col("tag"), "left").withColumn(c, F.coalesce("whole", c)).drop("tag", "whole")
    return met.where(~long & exact).unionByName(told.where(exact))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last word that forms lead to, the word itself if it has none.

    A form occurs more often than its word, so there are no cycles, and every round doubles the steps taken.
    """
    at = stored(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return forms.join(at.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        at = at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None, shortest: int = 7, least: int = 2, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word that occurs ``least`` times with what it most likely stands for.

    ``n_near`` counts the near words (one code point more, less or other). ``form`` is the near word that occurs most
    (ties: the smallest in code-point order) if it occurs ``ratio`` times as often as the word, else null; ``form_n`` its
    occurrences. ``root`` follows forms to the last. ``noise`` see ``words``.

    Null and empty texts have no words; rows with null or repeated ids and equal rows count like any others; other
    columns may have any name. Words of any length take part. An empty table gives no rows.
    """
    of = stored(words(docs, id_col, text_col, noise, shortest, least), "words")
    order = F.struct((-F.col("m")).alias("less"), F.col("other"))
    best = near(of).groupBy("word").agg(F.min(order).alias("best"), F.count("*").alias("n_near"))
    out = of.join(best, "word", "left").withColumn("taken", -F.col("best.less") >= ratio * F.col("n"))
    form = F.when(F.col("taken"), F.col("best.other"))
    forms = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(F.col("taken"), -F.col("best.less")).alias("form_n")), "forms")
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
