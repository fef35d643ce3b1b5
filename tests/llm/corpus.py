"""Small texts for the tests: words, copies, shared passages."""

import random

WORDS = "alder birch cedar drift ember fjord grove haven inlet jetty knoll lumen marsh north ochre plume quartz ridge slate thorn umber vale wharf xylem yarrow zephyr".split()

#: Rows that every operator on documents has to take: nulls, empty and blank texts, ties, repeats, a long text.
ODD = [
    (None, "alder birch cedar", "en", "s", 17),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n ", "en", "s", 4),
    (4, "word", None, "s", 4),
    (4, "word", None, "s", 4),
    (5, "Ünïcödé ñandú 漢字 🙂 " * 3, "es", None, 60),
    (6, "alder birch cedar drift ember " * 4000, "en", "s", None),
    (7, "x" * 50_000, "en", "s", 50_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["id", "fp", "key", "seed", "w", "h", "_gone", "_found", "_row", "_made", "_mentions", "_draws", "rank", "bucket", "at", "mask", "length", "n", "item_id", "windows", "place", "curve"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_documents(spark, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
