"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (one to three characters of words marked at
both ends), most frequent first. A document is ranked the same way, over its whole text, and compared by
the out-of-place distance: how far each of its n-grams stands from its place in the profile, and a fixed
most for those that the profile lacks. The nearest profile wins.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400  # n-grams of a profile
RANKS = 300  # n-grams of a document
SAMPLE = 20_000  # labelled rows that a fit uses, about; chosen by a hash of the id over all of them
BLOCK = 1 << 20  # characters of a text that are counted at a time, up to where a word ends
OTHER = re.compile(r"[\W\d_]+")
#: Word characters that are neither letters nor digits, such as ² and ½.
NUMBERS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
UNKNOWN = "und"
LEAST = 0.25  # a text of another script, or of no language, scores near 0; short texts of a known one 0.4 and more


def codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers (21 bits a character), and their counts. No letter: none."""
    found, counts = [], []
    end = 0
    while end < len(text):
        at, end = end, end + BLOCK
        while end < len(text) and text[end].isalpha():
            end += 1
        part = text[at:end].lower()
        for c in NUMBERS.intersection(part):
            part = part.replace(c, " ")
        words = OTHER.sub(" ", part).strip()
        if not words:
            continue
        c = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        space = c == 32
        two = c[:-1] << np.uint64(21) | c[1:]
        three = two[:-1] << np.uint64(21) | c[2:]
        grams = np.concatenate([c[~space], two, three[~space[1:-1]]])
        u, n = np.unique(grams, return_counts=True)
        found.append(u)
        counts.append(n)
    if len(found) < 2:
        return (found[0], counts[0]) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
    u, inverse = np.unique(np.concatenate(found), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def top(grams: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent n-grams, most frequent first, ties to the smaller code."""
    return grams[np.lexsort((grams, -counts))[:n]]


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """A profile for each label of rows with text and label: at most ``PROFILE`` n-grams a language.

    At most about ``sample`` rows are used, a documented bound; which ones depends on a hash of their ids
    only. Nulls in either column are left out. No rows: no profile.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < sample)

    def each(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, {})
                for g, k in zip(*(x.tolist() for x in codes(text)), strict=True):
                    own[g] = own.get(g, 0) + k
        for lang, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = rows.select("text", "lang").mapInArrow(each, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= PROFILE).collect()  # PROFILE rows a language
    profiles: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def distances(ranked: np.ndarray, vocabulary: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Out-of-place distance of ranked n-grams to each profile (a row of ``places``)."""
    at = np.minimum(np.searchsorted(vocabulary, ranked), len(vocabulary) - 1)
    found = places[:, at]
    known = (vocabulary[at] == ranked) & (found < PROFILE)
    return np.where(known, np.abs(found - np.arange(len(ranked))), PROFILE).sum(1)


class Ranker:
    """Profiles as one table of places, for predictions in a task."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.vocabulary = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.places = np.full((len(self.names), len(self.vocabulary)), PROFILE, np.int64)
        for row, name in zip(self.places, self.names, strict=True):
            row[np.searchsorted(self.vocabulary, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))

    def best(self, text: str | None) -> tuple[str, float]:
        ranked = top(*codes(text), RANKS) if text else np.empty(0, np.uint64)
        if not len(ranked) or not self.names:
            return UNKNOWN, 0.0
        d = distances(ranked, self.vocabulary, self.places)
        return self.names[int(d.argmin())], 1.0 - float(d.min()) / (PROFILE * len(ranked))


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the nearest profile's language for every row, whole texts counted.

    The score is one minus the distance as a share of the largest possible one. A null text, a text without
    a letter, or no profile at all: ``und`` with score 0. Ties go to the first language in order. Null and
    repeated ids keep their rows; other columns are not read.
    """
    ranker = Ranker(profiles)

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = zip(*map(ranker.best, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(each, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: dict[str, list[int]], least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The documents, whole and with all their columns, whose language is known: those with a letter whose
    nearest profile scores at least ``least``. Rows are kept where they are read, without a join."""
    ranker = Ranker(profiles)
    at = docs.columns.index(text_col)

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = map(ranker.best, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def fold(id_col: str = "doc_id") -> Column:
    """The remainder that assigns a document to training (not 2) or held out (2)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))
