"""Scalar functions: column expressions, and the small parsers that run once while a plan is built."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres; null if a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def date_range_label(start: Column, end: Column) -> Column:
    """'1642', or '1640–1642' with an en dash; null without a start."""
    return F.when(start.isNull(), None).when(end.isNull() | (start == end), start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("–"), end.cast("string")))


def dimension_label(height: Column, width: Column, unit: str = "cm") -> Column:
    """'h 10 cm × w 20 cm'; what is missing or zero is left out, nothing left: null."""
    part = lambda name, c: F.when(c.isNotNull() & (c != 0), F.format_string(f"{name} %s {unit}", c.cast("string")))
    return F.nullif(F.concat_ws(" × ", part("h", height), part("w", width)), F.lit(""))


def floor_century(year: Column) -> Column:
    """First year of a century: 1642 -> 1600, -50 -> -100."""
    return F.when(year >= 0, F.expr("0") + F.floor(year / 100) * 100).otherwise(-(F.floor((-year - 1) / 100) + 1) * 100).cast("int")


def binned(value: Column, width: float) -> Column:
    """Lower edge of a bin, truncated toward zero, so values around zero share one."""
    return (value / F.lit(width)).cast("int") * F.lit(width)


def ordinal(n: int) -> str:
    return f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def century_label(year: Column) -> Column:
    """'17th century', '1st century BCE'."""
    n = F.when(year >= 0, F.floor(year / 100) + 1).otherwise(F.floor((-year - 1) / 100) + 1).cast("int")
    teen = (n % 100).between(10, 20)
    suffix = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix, F.lit(" century"), F.when(year < 0, " BCE").otherwise(""))


def century_span(year: Column) -> Column:
    """'1600s'."""
    return F.concat(floor_century(year).cast("string"), F.lit("s"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def snippet(text: Column, most: int) -> Column:
    """Cut at the last word that fits, with a mark."""
    return F.when(F.length(text) > most, F.concat(F.regexp_extract(F.substring(text, 1, most), r"^(.*)\s", 1), F.lit(" […]"))).otherwise(text)


def strip_html(text: Column) -> Column:
    """Markup, leaked style rules, character references and markdown bold removed; white space collapsed."""
    steps = [(r"(?s)<style[^>]*>.*?</style>", " "), (r"(?s)<script[^>]*>.*?</script>", " "), (r"<[^>]*>", " "), (r"[a-z.#][\w.#-]*\s*\{[^}]*\}", " "), (r"\*\*([^*]+)\*\*", "$1")]
    text = reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)
    for mark, plain in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}.items():
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def authority_of(uri: Column) -> Column:
    """struct(authority, id) of a URI: its host without 'www.', and what follows the last slash."""
    host = F.regexp_replace(F.regexp_extract(uri, r"^https?://([^/?#]+)", 1), r"^www\.", "")
    local = F.regexp_extract(uri, r"^https?://[^?#]*/([A-Za-z0-9._~-]+)/?(?:[?#]|$)", 1)
    return F.struct(F.nullif(host, F.lit("")).alias("authority"), F.nullif(local, F.lit("")).alias("id"))


LENGTH_CM = {"mm": 0.1, "cm": 1.0, "m": 100.0, "in": 2.54}
WEIGHT_G = {"mg": 0.001, "g": 1.0, "kg": 1000.0}


def converted(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """A measure in the base unit, two decimals; unknown units: null."""
    table = F.create_map(*(F.lit(x) for pair in factors.items() for x in pair))
    return F.round(value * F.try_element_at(table, F.lower(F.trim(unit))), 2)


def region(text: Column, prefix: str = "pct") -> Column:
    """struct(x, y, w, h) of 'pct:10,20,30,40'; anything else: null."""
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"^{prefix}:{number},{number},{number},{number}$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("double")
    return F.when(text.rlike(pattern), F.struct(*(part(i + 1).alias(n) for i, n in enumerate("xywh"))))


def region_valid(r: Column, slack: float = 0.01) -> Column:
    """Whether a region in percent lies in its image, within a slack."""
    return (r["x"] >= -slack) & (r["y"] >= -slack) & (r["w"] > 0) & (r["h"] > 0) & (r["x"] + r["w"] <= 100 + slack) & (r["y"] + r["h"] <= 100 + slack)


def projected(inner: Column, outer: Column) -> Column:
    """A region of a crop in percent of the whole image, two decimals."""
    return F.struct(
        F.round(outer["x"] + inner["x"] * outer["w"] / 100, 2).alias("x"), F.round(outer["y"] + inner["y"] * outer["h"] / 100, 2).alias("y"),
        F.round(inner["w"] * outer["w"] / 100, 2).alias("w"), F.round(inner["h"] * outer["h"] / 100, 2).alias("h"),
    )


def iso_year(text: Column) -> Column:
    """Year of an ISO date string, negative years included."""
    return F.regexp_extract(text, r"^(-?\d{4})", 1).try_cast("int")


def year_bounds(begins: Column, ends: Column) -> Column:
    """struct(earliest, latest) over arrays of ISO strings; a missing bound mirrors the other."""
    low = F.array_min(F.transform(begins, iso_year))
    high = F.array_max(F.transform(ends, iso_year))
    return F.struct(F.coalesce(low, high).alias("earliest"), F.coalesce(high, low).alias("latest"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; both empty: 0."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def normalised(text: Column) -> Column:
    """Lower case without accents (Latin), punctuation or extra space."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def content_category(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The first rule (name, pattern) that matches."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


# --- parsers of parameters ---


def parse_years(text: str) -> tuple[int, int] | None:
    """'1642', '164*', '16*', '-5*' (-5999 to -5000): the years that a wildcard spans; anything else: None."""
    m = re.fullmatch(r"(-?)(\d{1,4})(\*?)", text.strip())
    if not m or (m[3] and len(m[2]) == 4):
        return None
    digits = m[2]
    if not m[3]:
        year = int(m[1] + digits)
        return year, year
    size = 10 ** (4 - len(digits))
    low, high = int(digits) * size, int(digits) * size + size - 1
    return (-high, -low) if m[1] else (low, high)


def parse_range(text: str) -> tuple[float | None, float | None] | None:
    """'10-50', '10-', '-50', '10' (from there on)."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*(-)?\s*(\d+(?:\.\d+)?)?\s*", text)
    if not m or not (m[1] or m[3]):
        return None
    return (float(m[1]) if m[1] else None), (float(m[3]) if m[3] else None)


def parse_sort(text: str, known: set[str]) -> tuple[str, str] | None:
    """'height', 'height:asc', '-height': (column, direction)."""
    m = re.fullmatch(r"(-)?(\w+)(?::(asc|desc))?", text.strip())
    if not m or m[2] not in known:
        return None
    return m[2], m[3] or ("desc" if m[1] else "asc")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob of * and ?, everything else literal; at least two literal characters."""
    if len(re.sub(r"[*?]", "", glob)) < 2:
        raise ValueError("a pattern needs at least two characters besides * and ?")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def cache_key(params: dict) -> str:
    import json

    return "&".join(f"{k}={json.dumps(v, sort_keys=True)}" for k, v in sorted(params.items()) if v is not None)


def page_token(name: str, offset: int) -> str:
    import base64

    return base64.urlsafe_b64encode(f"{name}\t{offset}".encode()).decode()


def read_page_token(token: str) -> tuple[str, int]:
    import base64

    name, _, offset = base64.urlsafe_b64decode(token.encode()).decode().rpartition("\t")
    return name, int(offset)
