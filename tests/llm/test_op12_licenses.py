import random
import re

import pytest

from tests.llm.corpus import SCHEMA, no_documents, odd_documents
from vitrine.llm import licenses


def scanned(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    return sorted(licenses.scan(docs, **more).collect(), key=lambda r: r["doc_id"])


CASES = [
    ("Released under the MIT License.", "mit", "mit", 1),
    ("Licensed under the Apache License, Version 2.0 (the 'License')", "apache-2", "apache-2", 1),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc", "cc-by-nc", 1),
    ("cc by nc cc-by-nc CC/BY/NC", "cc-by-nc", "cc-by-nc", 3),
    ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3", 0),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of", "", "gpl-2", 0),
    ("SPDX-License-Identifier: BSD-3-Clause", "", "bsd-3-clause", 0),
    ("Neither the name of the University of Somewhere nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "", "bsd-3-clause", 0),
    ("Neither the name nor the names of its contributors may be used to promote products", "", "", 0),
    ("under the terms of the MIT license", "", "mit", 0),
    ("under the  mit\nlicense; Apache License version 2, cc by nc", "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,mit", 3),
    ("under the mıt license, under the mit licensed, cc by ncé", "", "", 0),
    (None, "", "", 0),
    ("", "", "", 0),
]


def test_labels(spark):
    for (text, base, labels, n), r in zip(CASES, scanned(spark, [c[0] for c in CASES]), strict=True):
        assert (r["base_labels"], r["labels"], r["n_base"]) == (base, labels, n), text
        assert (r["first_word"] is None) == (n == 0) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    words = scanned(spark, ["a b cc by nc d under the mit license"])[0]
    assert (words["first_word"], words["last_word"], words["n_words"]) == (2, 6, 10)


def test_more_wording_scores_more(spark):
    whole = licenses.TEMPLATES[0][1].replace("{", "").replace("}", "")
    some = scanned(spark, [whole, "SPDX-License-Identifier: MIT", whole.replace("merge", "merged")])
    assert some[0]["score"] > some[1]["score"] > 0 and some[0]["labels"] == "mit" and some[2]["labels"] == ""


TOY = [("x", "a {b {c} d} e"), ("y", "a <2> f"), ("z", "{a} b b <1> c"), ("w", "e <0> f {g}")]


def test_automaton_against_regular_expressions():
    """Every place where a template ends, by a pattern that is anchored there."""
    rng = random.Random(7)
    made = licenses.Automaton(TOY)
    for _ in range(3000):
        words = [rng.choice("abcdefgq") for _ in range(rng.randrange(1, 14))]
        wanted = set()
        for t, (_, markup) in enumerate(TOY):
            for last in range(len(words)):
                if re.search(licenses.pattern(markup) + "$", " " + " ".join(words[: last + 1]) + " "):
                    wanted.add((t, last))
        found = made.run([w.encode() for w in words])
        assert len(found) == len(set(found)) and set(found) == wanted, words


def test_templates_have_to_be_whole():
    for bad in ("a {b", "a } b", "{a}", "<3>", ""):
        with pytest.raises((ValueError, IndexError)):
            licenses.Automaton([("x", bad)])


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    rows = licenses.scan(docs)
    assert rows.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]
    got = rows.collect()
    assert len(got) == docs.count() and all(r["labels"] == "" and r["score"] == 0 for r in got)
    assert next(r["n_words"] for r in got if r["doc_id"] == 6) == 20_000
    assert licenses.scan(no_documents(spark)).count() == 0
    long = scanned(spark, ["word " * 400_000 + "under the MIT license"])[0]
    assert (long["n_words"], long["first_word"], long["labels"]) == (400_004, 400_000, "mit")
    assert [(x["label"], x["last"]) for x in long["found"]] == [("mit", 400_003)] * 2
