"""Inscriptions: 'type, qualifiers: value | ...' to structured segments, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types, techniques and placements, each with its surface forms (Dutch, then English).
TYPES = {
    "collector's mark": ["verzamelaarsmerk", "collector's mark"], "signature and date": ["signatuur en datum", "signature and date"], "signature": ["signatuur", "signature"], "date": ["datum", "datering", "date"],
    "inscription": ["opschrift", "inscriptie", "inscription"], "annotation": ["annotatie", "annotation"], "number": ["nummer", "number"], "blind stamp": ["blindstempel", "blind stamp"],
    "workshop stamp": ["atelierstempel", "workshop stamp"], "check stamp": ["controlestempel", "keurstempel", "check stamp"], "factory mark": ["fabrieksmerk", "factory mark"], "printer's mark": ["drukkersmerk", "printer's mark"],
    "postmark": ["poststempel", "postmark"], "postage stamp": ["postzegel", "postage stamp"], "stamp": ["stempel", "stamp"], "caption": ["onderschrift", "caption"], "address": ["adres", "address"], "monogram": ["monogram"],
    "watermark": ["watermerk", "watermark"], "mark": ["merk", "mark"], "title": ["titel", "title"], "label": ["etiket", "label"], "name": ["naam", "name"], "text": ["tekst", "text"], "edition": ["oplage", "edition"],
    "colour note": ["kleurnotitie", "colour note", "color note"], "price": ["prijs", "price"], "maker's mark": ["meesterteken", "maker's mark"], "seal": ["zegel", "seal"], "circumscription": ["omschrift", "circumscription"],
    "alloy mark": ["gehalteteken", "alloy mark"], "town mark": ["stadskeur", "town mark"], "date letter": ["jaarletter", "date letter"], "initials": ["initialen", "initials"], "dedication": ["opdracht", "dedication"],
    "retailer's mark": ["winkeliersmerk", "retailer's mark"], "negative number": ["negatiefnummer", "negative number"], "copyright notice": ["copyrightvermelding", "copyright notice"], "patent notice": ["octrooivermelding", "patent notice"],
    "monogram and date": ["monogram en datum", "monogram and date"], "date and inscription": ["datum en annotatie", "datum en inscriptie", "date and inscription"], "cliché instruction": ["clichéaanwijzing", "cliché instruction"],
    "coat of arms": ["wapen (heraldiek)", "wapen", "coat of arms"], "duty mark": ["belastingteken", "duty mark"], "bookplate": ["ex libris", "bookplate"], "mould mark": ["vormersmerk", "mold mark", "mould mark"],
    "company name": ["firmanaam", "company name"], "serial number": ["serienummer", "serial number"],
}
TECHNIQUES = {
    "stamped": ["gestempeld", "stamped"], "handwritten": ["handgeschreven", "handschrift", "handwritten"], "written": ["geschreven", "written"], "printed": ["gedrukt", "geprent", "afgedrukt", "drukken", "meegedrukt", "printed"],
    "engraved": ["gegraveerd", "graveren", "engraved"], "etched": ["geëtst", "geetst", "etched"], "pencil": ["potlood", "pencil"], "ink": ["inkt", "ink"], "pen": ["pen"], "chalk": ["krijt", "chalk"],
    "blind-embossed": ["blinddruk", "blind-embossed"], "painted": ["geschilderd", "painted"], "affixed": ["geplakt", "affixed"], "cut": ["gesneden", "cut"], "scratched": ["gekrast", "scratched"], "embossed": ["gepreegd", "embossed"],
    "struck": ["afgeslagen", "geslagen", "struck"], "incised": ["ingegrift", "gegrift", "incised"], "typed": ["getypt", "typeschrift", "typed"], "letterpress": ["boekdruk", "letterpress"], "embroidered": ["geborduurd", "borduren", "embroidered"],
    "relief": ["reliëf", "reliëfdruk", "relief"],
}
PLACEMENTS = {"recto": ["recto", "voorzijde", "obverse"], "verso": ["verso", "achterzijde", "keerzijde", "reverse"]}
#: Finer positions, which are known but not normalised.
POSITIONS = [
    "linksboven", "rechtsboven", "linksonder", "rechtsonder", "middenboven", "middenonder", "midden boven", "midden onder", "midden", "boven", "onder", "linksmidden", "rechtsmidden", "links", "rechts",
    "bovenregel", "onderregel", "bovenaan", "onderaan", "rand", "marge", "hoek", "passe-partout", "opzetvel", "opzetblad", "schutblad", "lijst", "onderzijde", "bovenzijde", "binnenzijde", "buitenzijde",
    "bottom", "top", "lower", "upper", "centre", "center", "middle", "left", "right", "margin", "edge", "corner",
]
#: References to the catalogue of collectors' marks, and quotation marks.
LUGT = r"(?i)\bLugt\s*(\d+[a-z]?)\b"
QUOTED = (r"‘([^’]*)’", r"\x22([^\x22]*)\x22")


def bucket(word: Column, buckets: dict[str, list[str]]) -> Column:
    """The bucket of a surface form, any case; unknown: null."""
    pairs = {form: name for name, forms in reversed(buckets.items()) for form in forms}
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), F.lower(F.trim(word)))


def segments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per segment: key, sequence, raw, type, normalized_type, placement, normalized_placement, technique,
    normalized_technique, value, transcribed, collector_marks, unknown_qualifiers, is_collector_mark,
    is_placeholder. Null texts have none; a segment without a colon is a type slot without a value."""
    out = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), r"\s*\|\s*")).alias("_i", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    colon = F.instr("raw", ":")
    out = out.withColumn("_head", F.when(colon > 0, F.substr("raw", F.lit(1), colon - 1)).otherwise(F.col("raw"))).withColumn("value", F.when(colon > 0, F.nullif(F.trim(F.substr(F.col("raw"), colon + 1)), F.lit(""))))
    out = out.withColumn("_parts", F.transform(F.split("_head", ","), lambda x: F.trim(x)))
    out = out.withColumn("type", F.col("_parts")[0]).withColumn("_rest", F.slice("_parts", 2, 50))
    first = lambda test: F.try_element_at(F.filter("_rest", test), F.lit(1))
    is_technique = lambda x: bucket(x, TECHNIQUES).isNotNull()
    is_surface = lambda x: bucket(x, PLACEMENTS).isNotNull()
    is_place = lambda x: is_surface(x) | F.lower(x).isin(*POSITIONS)
    marks = F.array_distinct(F.transform(F.regexp_extract_all("raw", F.lit(LUGT), 1), F.upper))
    decoded = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    quotes = F.concat(*(F.regexp_extract_all(F.coalesce("value", F.lit("")), F.lit(q), 1) for q in QUOTED))
    return out.select(
        key, F.row_number().over(Window.partitionBy(key).orderBy("_i")).alias("sequence"), "raw", "type", bucket(F.col("type"), TYPES).alias("normalized_type"),
        F.nullif(F.array_join(F.filter("_rest", is_place), ", "), F.lit("")).alias("placement"), bucket(first(is_surface), PLACEMENTS).alias("normalized_placement"),
        first(is_technique).alias("technique"), bucket(first(is_technique), TECHNIQUES).alias("normalized_technique"), "value",
        F.filter(F.transform(quotes, lambda q: F.trim(decoded(q))), lambda q: q != "").alias("transcribed"), F.transform(marks, lambda n: F.struct(F.lit("Lugt").alias("catalogue"), n.alias("number"))).alias("collector_marks"),
        F.filter("_rest", lambda x: ~is_technique(x) & ~is_place(x) & (x != "")).alias("unknown_qualifiers"), (F.coalesce(bucket(F.col("type"), TYPES) == "collector's mark", F.lit(False)) | (F.size(marks) > 0)).alias("is_collector_mark"),
        F.coalesce(F.col("value").isNull() | F.col("value").rlike(r"^[.…\s-]*$"), F.lit(True)).alias("is_placeholder"),
    )


def facets(types: list[str] = (), placements: list[str] = (), techniques: list[str] = (), mark: str | None = None, transcribed: bool | None = None, placeholder: bool | None = None, text: str | None = None) -> Column:
    """A condition on one segment: every facet given holds on it."""
    out = F.lit(True)
    for column, wanted in (("normalized_type", types), ("normalized_placement", placements), ("normalized_technique", techniques)):
        out = out & (F.col(column).isin(*wanted) if wanted else F.lit(True))
    if mark:
        out = out & F.exists("collector_marks", lambda m: m["number"] == mark.upper())
    if transcribed is not None:
        out = out & ((F.size("transcribed") > 0) == transcribed)
    if placeholder is not None:
        out = out & (F.col("is_placeholder") == placeholder)
    if text:
        out = out & F.contains(F.lower(F.coalesce("value", F.lit(""))), F.lit(text.lower()))
    return F.coalesce(out, F.lit(False))


def search(found: DataFrame, key: str, condition: Column, exclude_mark_only: bool = False) -> DataFrame:
    """(key, n_matched, matched): entities with a segment that meets the condition. Optionally without those
    whose segments are all collectors' marks."""
    out = found.groupBy(key).agg(F.count_if(condition).alias("n_matched"), F.array_sort(F.collect_list(F.when(condition, F.struct("sequence", "raw")))).alias("matched"), F.bool_and("is_collector_mark").alias("_only"))
    return out.where(F.col("n_matched") > 0).where(~F.col("_only") if exclude_mark_only else F.lit(True)).drop("_only")


def grouped(found: DataFrame, key: str) -> DataFrame:
    """(key, group_key, occurrences, raws): segments that say the same (marks, transcriptions, else value) folded."""
    same = F.coalesce(F.nullif(F.array_join(F.transform("collector_marks", lambda m: m["number"]), ","), F.lit("")), F.nullif(F.lower(F.array_join("transcribed", " ")), F.lit("")), F.lower("value"), F.lower("raw"))
    return found.groupBy(key, same.alias("group_key")).agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_list(F.struct("sequence", "raw"))).alias("raws"))


def rollup(found: DataFrame, key: str) -> DataFrame:
    """One row per entity: types, placements, techniques and marks that occur, and whether any has a transcription."""
    return found.groupBy(key).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("normalized_type")).alias("types"), F.array_sort(F.collect_set("normalized_placement")).alias("placements"), F.array_sort(F.collect_set("normalized_technique")).alias("techniques"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("collector_marks", lambda m: m["number"]))))).alias("marks"), F.bool_or(F.size("transcribed") > 0).alias("has_transcription"),
    )


def embedding_text(found: DataFrame, key: str) -> DataFrame:
    """(key, text): the distinct transcriptions and values worth embedding, in order."""
    kept = F.when(F.col("is_placeholder"), None).otherwise(F.when(F.size("transcribed") > 0, F.array_join("transcribed", " ")).otherwise(F.col("value")))
    return found.groupBy(key).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("sequence", kept.alias("t")))), lambda x: x["t"])), " ").alias("text"))
