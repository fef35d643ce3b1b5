"""Ranked text search over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as T


def occurrences(pad: Column, phrase: str) -> Column:
    """How often a phrase stands in padded tokens, overlaps of its single spaces included."""
    words = T.words_of(phrase)
    needle = f" {' '.join(words)} "
    doubled = F.replace(pad, F.lit(" "), F.lit("  "))
    return F.regexp_count(doubled, F.lit(f" {'  '.join(words)} ")) if words else F.length(F.lit(needle)) * 0


def bm25(docs: DataFrame, key: str, columns: list[str], phrases: list[str], scoped: list[str] | None = None) -> DataFrame:
    """(key, score) of documents that match any phrase, best (lowest) first to read. A phrase is one term;
    frequency and document frequency count in the scoped columns, length in all; an idf of zero or less is
    one millionth; k1 = 1.2, b = 0.75."""
    scoped = scoped or columns
    toks = docs.select(F.col(key), *(T.tokens(F.col(c)).alias(c) for c in columns))
    length = sum((F.size(c) for c in columns), F.lit(0))
    tf = [sum((occurrences(T.padded(F.col(c)), p) for c in scoped), F.lit(0)) for p in phrases]
    rows = toks.select(key, length.alias("len"), *(t.alias(f"tf{i}") for i, t in enumerate(tf)))
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score + idf * F.col(f"tf{i}") * 2.2 / (F.col(f"tf{i}") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(phrases))), F.lit(0)) > 0
    return rows.crossJoin(F.broadcast(stats)).where(hit).select(key, (-score).alias("score"))


def term_frequencies(docs: DataFrame, key: str, text: str, n: int = 1) -> DataFrame:
    """(term, df): in how many documents each run of n tokens occurs."""
    toks = docs.select(key, T.tokens(F.col(text)).alias("w"))
    grams = F.col("w") if n == 1 else F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))
    return toks.select(F.explode(F.array_distinct(grams)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
