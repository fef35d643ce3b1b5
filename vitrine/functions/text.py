"""Text matching over token arrays: phrases, prefixes, proximity, boolean queries and word forms."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_TERMS = 32


def _folds() -> dict[str, str]:
    """Lower-case Latin letters with marks, and the letters that they are without; o with a stroke counts too."""
    out = {"ø": "o"}
    for c in map(chr, (*range(0xDF, 0x250), *range(0x1E00, 0x1F00))):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(bare) == 1 and bare != c:
            out[c] = bare
    return out


FOLDS = _folds()
MARKS = "".join(map(chr, range(0x300, 0x370)))  # combining marks, which stand alone in decomposed texts


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; Latin accents removed, combined or not; null: none."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(FOLDS) + MARKS, "".join(FOLDS.values()))
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


def words_of(phrase: str) -> list[str]:
    """A query phrase as the tokens that it matches, folded as ``tokens`` folds texts."""
    plain = "".join(FOLDS.get(c, c) for c in phrase.lower() if c not in MARKS)
    return [w for w in re.split(r"[\W_]+", plain) if w]


def padded(toks: Column) -> Column:
    """Tokens as ' a b c ', in which a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def has_phrase(pad: Column, phrase: str) -> Column:
    words = words_of(phrase)
    return pad.contains(f" {' '.join(words)} ") if words else F.lit(False)


def has_prefix(pad: Column, prefix: str) -> Column:
    words = words_of(prefix)
    return pad.contains(f" {' '.join(words)}") if words else F.lit(False)


def has_near(toks: Column, slots: list[list[str]], distance: int) -> Column:
    """Whether one word of every slot stands together with those of the others, in any order, with at most
    ``distance`` other words between the first and the last."""
    options = [[w for s in slot for w in words_of(s)[:1]] for slot in slots]
    if not options or not all(options):
        return F.lit(False)
    n = len(options)

    def places(w: str) -> Column:
        return F.filter(F.transform(toks, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull())

    def joined(spans: Column, w: str) -> Column:
        """Every span, widened to each place of one more word outside it."""
        wider = lambda s: F.transform(F.filter(places(w), lambda j: (j < s["lo"]) | (j > s["hi"])), lambda j: F.struct(F.least(s["lo"], j).alias("lo"), F.greatest(s["hi"], j).alias("hi")))
        return F.flatten(F.transform(spans, wider))

    def together(choice: tuple[str, ...]) -> Column:
        first = F.transform(places(choice[0]), lambda i: F.struct(i.alias("lo"), i.alias("hi")))
        return F.exists(reduce(joined, choice[1:], first), lambda s: s["hi"] - s["lo"] - (n - 1) <= distance)

    return reduce(Column.__or__, [together(c) for c in product(*options)])


def clause(toks: Column, pad: Column, spec: dict) -> Column:
    """One clause: phrase, any of, prefix, any prefix of, or near."""
    tests = []
    if spec.get("phrase"):
        tests.append(has_phrase(pad, spec["phrase"]))
    if spec.get("any"):
        tests.append(reduce(Column.__or__, [has_phrase(pad, p) for p in spec["any"]]))
    if spec.get("prefix"):
        tests.append(has_prefix(pad, spec["prefix"]))
    if spec.get("anyPrefix"):
        tests.append(reduce(Column.__or__, [has_prefix(pad, p) for p in spec["anyPrefix"]]))
    if spec.get("near"):
        slots = [[t] if isinstance(t, str) else list(t) for t in spec["near"]["terms"]]
        tests.append(has_near(toks, slots, spec["near"].get("distance", 10)))
    if not tests:
        raise ValueError("a clause needs a phrase, any, prefix, anyPrefix or near")
    return reduce(Column.__and__, tests)


def terms_in(spec: dict) -> int:
    near = spec.get("near", {}).get("terms", [])
    return bool(spec.get("phrase")) + bool(spec.get("prefix")) + len(spec.get("any", ())) + len(spec.get("anyPrefix", ())) + sum(1 if isinstance(t, str) else len(t) for t in near)


def boolean_query(fields: dict[str, tuple[Column, Column]], query: dict) -> Column:
    """A column for {must, should, mustNot} over fields (name: tokens, padded tokens). A clause without a field
    holds if any field matches. Queries of exclusions alone, or of too many terms, are errors."""
    parts = {k: list(query.get(k) or ()) for k in ("must", "should", "mustNot")}
    if unknown := set(query) - set(parts):
        raise ValueError(f"unknown parts {sorted(unknown)}")
    if not parts["must"] and not parts["should"]:
        raise ValueError("a query needs must or should")
    if sum(terms_in(c) for cs in parts.values() for c in cs) > MOST_TERMS:
        raise ValueError(f"a query has at most {MOST_TERMS} terms")

    def test(spec: dict) -> Column:
        names = [spec["field"]] if spec.get("field") else list(fields)
        return reduce(Column.__or__, [clause(*fields[n], spec) for n in names])

    out = reduce(Column.__and__, map(test, parts["must"]), F.lit(True))
    if parts["should"]:
        out = out & reduce(Column.__or__, map(test, parts["should"]))
    return reduce(lambda a, c: a & ~test(c), parts["mustNot"], out)


def variants(word: str) -> list[str]:
    """Other forms of an English word: plural and singular, -ing, -ed."""
    w, out = word.lower(), []
    if len(w) < 3:
        return []
    stem = w
    if w.endswith("ies") and len(w) > 4:
        stem = w[:-3] + "y"
    elif w.endswith("es") and len(w) > 4:
        stem = w[:-2]
        out.append(w[:-1])
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 3:
        stem = w[:-1]
    elif w.endswith("ing") and len(w) > 5:
        stem = w[:-3]
        out.append(stem + "e")
    elif w.endswith("ed") and len(w) > 4:
        stem = w[:-2]
        out.append(stem + "e")
    out += [stem, stem + "s", stem + "ing", stem + "ed"]
    return [x for x in dict.fromkeys(out) if x != w and len(x) >= 3]


def expanded(phrase: str, most_words: int = 3, most_terms: int = 8) -> list[list[str]] | None:
    """Word groups (any of a group, all groups) for a phrase of few words; longest groups are trimmed first."""
    words = words_of(phrase)
    if not 0 < len(words) <= most_words:
        return None
    groups = [[w, *variants(w)] for w in words]
    while sum(map(len, groups)) > most_terms:
        max(groups, key=len).pop()
    return groups
