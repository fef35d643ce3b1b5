"""License wording in texts: templates with optional and replaceable regions become one automaton over words.

A template is words, ``{...}`` a region that may be missing (regions nest), ``<n>`` up to ``n`` words of any kind.
Everything else has to stand word by word. All templates are one automaton, run once over a text's words from
every place at once; its sets of states are numbered when they are first met, so a word costs one look-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 in lower case: all but ASCII that is neither a letter nor a digit
HALF = 4  # mandatory words that score a half

#: The phrases that are looked for at every place, with their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: The wording of public licenses and of the notices that name them, as words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {the software} to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "under {the terms of} the mit license"),
    ("mit", "spdx license identifier mit"),
    ("mit-0", "spdx license identifier mit 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "spdx license identifier isc"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {2} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of <12> nor the names of {its} {the} <3> contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause"),
    ("apache-2", "licensed under the apache license version 2 0 {the license} {you may not use this file except in compliance with the license}"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-2", "under the {terms of the} gnu general public license {as published by the free software foundation} {either} version 2"),
    ("gpl-3", "under the {terms of the} gnu general public license {as published by the free software foundation} {either} version 3"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("lgpl", "under the {terms of the} gnu {lesser} {library} general public license as published by the free software foundation {either} version 2 1"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license {as published by the free software foundation} {either} version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla public license {version} 2 0"),
    ("epl-2", "eclipse public license {v} {version} 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost-1", "boost software license {version} 1 0"),
    ("cc0-1", "cc0 1 0 {universal}"),
    ("cc-by", "{licensed} under {a} {the} creative commons attribution <1> {international} license"),
    ("cc-by", "licensed under {a} {the} cc by {1} {2} {3} {4} 0"),
    ("cc-by-sa", "licensed under {a} {the} cc by sa {1} {2} {3} {4} 0"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under {a} {the} cc by nc {1} {2} {3} {4} 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("proprietary", "all rights reserved <6> may not be {copied} {reproduced} {or} {distributed} without {the} {prior} {written} permission"),
]


def parsed(markup: str) -> list:
    """A template as words, numbers (so many words of any kind) and lists (what may be missing)."""
    stack: list[list] = [[]]
    for token in re.findall(r"[{}]|<\d+>|[^\s{}<>]+", markup):
        if token == "{":
            stack.append([])
        elif token == "}":
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(int(token[1:-1]) if token[0] == "<" else token)
    if len(stack) != 1:
        raise ValueError(f"regions of a template don't close: {markup!r}")
    return stack[0]


def mandatory(parts: Iterable) -> int:
    return sum(isinstance(p, str) for p in parts)


class Automaton:
    """All templates at once. Words that no template has are one word, None."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.weights = [mandatory(parsed(markup)) for _, markup in templates]
        if not all(self.weights):
            raise ValueError("a template needs a word that has to stand")
        self.on: list[dict] = []  # state: word, or True for any, to the state that follows
        self.free: list[list[int]] = []  # state: states that follow without a word
        self.ends: dict[int, int] = {}
        starts = []
        for t, (_, markup) in enumerate(templates):
            starts.append(self.state())
            self.ends[self.built(parsed(markup), starts[-1])] = t
        self.vocabulary = {w.encode(): w for state in self.on for w in state if w is not True}
        self.start = self.reached(starts)
        self.numbers = {self.start: 0}
        self.sets = [self.start]
        self.moves: list[dict] = [{}]
        self.accepts = [[]]

    def state(self) -> int:
        self.on.append({})
        self.free.append([])
        return len(self.on) - 1

    def built(self, parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, list):
                after = self.state()
                self.free[at].append(after)
                self.free[self.built(p, self.step(at))].append(after)
                at = after
            elif isinstance(p, int):
                after = self.state()
                for _ in range(p):
                    self.free[at].append(after)
                    self.on[at][True] = at = self.state()
                self.free[at].append(after)
                at = after
            else:
                at = self.free_of_words(at)
                self.on[at][p] = at = self.state()
        return at

    def step(self, at: int) -> int:
        after = self.state()
        self.free[at].append(after)
        return after

    def free_of_words(self, at: int) -> int:
        return self.step(at) if self.on[at] else at

    def reached(self, states: Iterable[int]) -> frozenset:
        found, open_ = set(), [*states]
        while open_:
            if (s := open_.pop()) not in found:
                found.add(s)
                open_.extend(self.free[s])
        return frozenset(found)

    def move(self, number: int, word: str | None) -> int:
        after = [self.on[s][w] for s in self.sets[number] for w in (word, True) if w in self.on[s]]
        found = self.reached([*after, *self.start])
        if found not in self.numbers:
            self.numbers[found] = len(self.sets)
            self.sets.append(found)
            self.moves.append({})
            self.accepts.append(sorted({self.ends[s] for s in self.reached(after) if s in self.ends}))
        self.moves[number][word] = self.numbers[found]
        return self.numbers[found]

    def run(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, its last word's place) for every template and place where it ends."""
        out, at, moves, accepts = [], 0, self.moves, self.accepts
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if at or w is not None:
                after = moves[at].get(w)
                at = self.move(at, w) if after is None else after
                if accepts[at]:
                    out.extend((t, i) for t in accepts[at])
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, base: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``found``: (label, last word)
    of every place where a template or phrase ends, in order.

    ``n_base`` counts the places of the phrases of ``base``, ``first_word`` and ``last_word`` are their smallest and
    largest start (words from 0; null without any). ``labels`` are those of the phrases and of the templates whose mandatory
    wording stands somewhere, distinct, sorted, joined by commas. ``score`` is m / (m + 4) with m the most mandatory words
    of anything found, so more exact wording says more; 0 without any.

    Null and empty texts have no words. Every row gives one row, with null or repeated ids too; other columns are left
    out and may have any name. Very long texts are read once. An empty table gives no rows.
    """
    base = BASE if base is None else base
    every = [*base, *(TEMPLATES if templates is None else templates)]
    lengths = [len(phrase.split()) for _, phrase in base]

    def rows(batches):
        import pyarrow as pa

        made = Automaton(every)
        labels, weights, n_base = made.labels, made.weights, len(base)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("last", pa.int64())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]
        for b in batches:
            out = []
            for text in b.column(1):
                words = WORD.findall((text.as_py() or "").encode().lower())
                found = made.run(words)
                starts = [i - lengths[t] + 1 for t, i in found if t < n_base]
                best = max((weights[t] for t, _ in found), default=0)
                own = lambda some: ",".join(sorted({labels[t] for t, _ in some}))
                spans = [{"label": labels[t], "last": i} for t, i in found]
                out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), own(x for x in found if x[0] < n_base), own(found), best / (best + HALF), spans))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["id", *names])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label: string, last: bigint>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def pattern(markup: str) -> str:
    """A template as a regular expression over words that are each followed by a space."""
    def of(parts: list) -> str:
        return "".join(f"(?:{of(p)})?" if isinstance(p, list) else f"(?:[^ ]+ ){{0,{p}}}" if isinstance(p, int) else f"{p} " for p in parts)

    return " " + of(parsed(markup))


def oracle() -> str:
    """SQL for the digest columns: phrases by place, templates by regular expressions."""
    every = [*BASE, *TEMPLATES]
    same = lambda p: " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    places = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {same(p)})" for _, p in BASE)
    says = lambda some, c: "[" + ", ".join(f"case when {c(k, m)} then '{label}' end" for k, (label, m) in some) + "]"
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda y: y is not null))), ',')"
    stands = lambda m: f"regexp_matches(t, '{pattern(m)}')"
    best = "greatest(0, " + ", ".join(f"case when {stands(m)} then {mandatory(parsed(m))} else 0 end" for _, m in every) + ")"
    return rf"""
    with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
      p as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as t, [{places}] as p from d),
      m as (select *, {best} as best from p)
    select doc_id, len(w)::bigint as n_words, len(flatten(p))::bigint as n_base, list_min(flatten(p)) - 1 as first_word, list_max(flatten(p)) - 1 as last_word,
      {joined(says(enumerate(BASE), lambda k, m: f"len(p[{k + 1}]) > 0"))} as base_labels, {joined(says(enumerate(every), lambda k, m: stands(m)))} as labels, best::double / (best + {HALF})::double as score
    from m"""
