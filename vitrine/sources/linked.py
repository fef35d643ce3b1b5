"""Objects described as linked data (JSON-LD) into tables: titles, dimensions, statements, production, treatments,
examinations, relations, other ids, evidence, narratives.

A document is one row with a VARIANT column, so nothing has to be known of its shape beforehand, and what may be one
value or a list of them, a bare id or an object with one, is read alike: ``many`` gives the values at a path as an
array, ``ref`` the id of any. What a node is about is told by the classes it is given; classes are compared by whole ids.
All of it is Spark's functions over that column, one pass for each table and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GETTY = "http://vocab.getty.edu/aat/"
#: Ids of a public thesaurus for what nodes are classed as.
SIZES = {"height": "300055644", "width": "300055647", "depth": "300072633", "diameter": "300055624"}
WEIGHT = {"weight": "300056240"}
CENTIMETRES = {"300379098": 1.0, "300379097": 0.1, "300379100": 100.0}
GRAMS = {"300379225": 1.0, "300379226": 1000.0}
TITLES = {"full": "300417200", "brief": "300417207", "display": "300404670"}
STATEMENTS = {"inscription": "300435414", "provenance": "300444174", "credit_line": "300026687", "description": "300435452", "production": "300435416"}
NARRATIVE = "300048722"
LANGUAGES = {"en": "300388277", "nl": "300388256"}


def documents(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, doc): ``rows`` whose text is a JSON object, parsed; other texts and nulls are left out."""
    return rows.select(key, F.try_parse_json(F.col(json)).alias("doc")).where(F.schema_of_variant("doc").startswith("OBJECT"))


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def many(v: Column, path: str) -> Column:
    """The values at a path: of a list its entries, of one value that one, of none or null none."""
    one = at(v, path)
    found = F.coalesce(at(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))
    return F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x))


def ref(v: Column) -> Column:
    """The id of a node: a bare text is one."""
    return F.nullif(F.when(is_text(v), v.try_cast("string")).otherwise(at(v, "id", "string")), F.lit(""))


def refs(v: Column, path: str) -> Column:
    return F.array_compact(F.transform(many(v, path), ref))


def local(uri: Column) -> Column:
    """The last part of an id."""
    return F.substring_index(uri, "/", -1)


def whole(number: str) -> str:
    return number if "/" in number else GETTY + number


def named(uri: Column, names: dict[str, str]) -> Column:
    """The name whose id is ``uri``; any other id its last part."""
    return F.coalesce(*(F.when(uri == whole(n), F.lit(name)) for name, n in names.items()), local(uri))


def classed(v: Column, *numbers: str) -> Column:
    return F.arrays_overlap(refs(v, "classified_as"), F.array(*(F.lit(whole(n)) for n in numbers)))


def texts(v: Column, path: str = "content") -> Column:
    """The texts at a path that aren't empty."""
    return F.filter(F.transform(F.filter(many(v, path), is_text), lambda x: x.try_cast("string")), lambda x: x != "")


def text(v: Column, between: str = " ") -> Column:
    return F.nullif(F.array_join(texts(v), between), F.lit(""))


def language(v: Column) -> Column:
    return named(F.get(refs(v, "language"), F.lit(0)), LANGUAGES)


def preferred(pairs: Column) -> Column:
    """Of (lang, text) pairs the text in the first of ``LANGUAGES`` that there is, else the first."""
    own = lambda lang: F.get(F.filter(pairs, lambda p: p["lang"] == lang), F.lit(0))["text"]
    return F.coalesce(*map(own, LANGUAGES), F.get(pairs, F.lit(0))["text"])


def pair(v: Column) -> Column:
    return F.named_struct(F.lit("lang"), language(v), F.lit("text"), text(v))


def said(nodes: Column) -> Column:
    """What named nodes say, in the preferred language."""
    return preferred(F.filter(F.transform(nodes, pair), lambda p: p["text"].isNotNull()))


def names(v: Column) -> Column:
    return F.filter(many(v, "identified_by"), lambda x: at(x, "type", "string") == "Name")


def span(v: Column) -> dict[str, Column]:
    return {"shown": F.get(F.array_compact(F.transform(names(at(v, "timespan")), lambda x: text(x))), F.lit(0)), "begins": at(v, "timespan.begin_of_the_begin", "string"), "ends": at(v, "timespan.end_of_the_end", "string")}


def each(docs: DataFrame, key: str, nodes: Column, **columns) -> DataFrame:
    """(key, seq, columns): a row for every node, with its place from 0; columns are functions of the node."""
    rows = docs.select(key, F.posexplode(nodes).alias("seq", "node"))
    return rows.select(key, "seq", *(f(F.col("node")).alias(name) for name, f in columns.items()))


def titles(docs: DataFrame, key: str, more: dict[str, str] | None = None) -> DataFrame:
    """(key, seq, title, lang, qualifier) of every name with a text; ``more``: further qualifiers by their class ids."""
    kinds = TITLES | (more or {})

    def qualifier(v: Column) -> Column:
        known = F.transform(refs(v, "classified_as"), lambda c: F.coalesce(*(F.when(c == whole(n), F.lit(name)) for name, n in kinds.items())))
        return F.get(F.array_compact(known), F.lit(0))

    return each(docs, key, F.filter(names(F.col("doc")), lambda v: text(v).isNotNull()), title=text, lang=language, qualifier=qualifier)


def measured(nodes: Column, classes: list[str], units: dict[str, float]) -> Column:
    """The first value of one of the classes, in the unit whose factor is 1; a unit that isn't known counts as that."""
    value = lambda v: at(v, "value", "double")
    node = F.get(F.filter(nodes, lambda v: value(v).isNotNull() & classed(v, *classes)), F.lit(0))
    factor = F.coalesce(*(F.when(ref(at(node, "unit")) == whole(n), F.lit(x)) for n, x in units.items() if x != 1.0))
    return F.when(factor.isNotNull(), F.round(value(node) * factor, 2)).otherwise(value(node))


def dimensions(docs: DataFrame, key: str, more: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, height_cm, width_cm, depth_cm, diameter_cm, weight_g, note); ``more``: further class ids by dimension."""
    nodes = many(F.col("doc"), "dimension")
    of = lambda name, n, units: measured(nodes, [n, *(more or {}).get(name, [])], units)
    note = F.array_join(F.flatten(F.transform(nodes, lambda v: F.flatten(F.transform(many(v, "referred_to_by"), lambda x: texts(x))))), " | ")
    return docs.select(key, *(of(name, n, CENTIMETRES).alias(f"{name}_cm") for name, n in SIZES.items()), of("weight", WEIGHT["weight"], GRAMS).alias("weight_g"), F.nullif(note, F.lit("")).alias("note"))


def statements(docs: DataFrame, key: str, more: dict[str, str] | None = None) -> DataFrame:
    """(key, kind, statement): the texts of each kind of statement, joined by `` | ``, in all languages."""
    nodes = many(F.col("doc"), "referred_to_by")
    of = lambda n: F.array_join(F.flatten(F.transform(F.filter(nodes, lambda v: classed(v, n)), lambda x: texts(x))), " | ")
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), of(n).alias("statement")) for kind, n in (STATEMENTS | (more or {})).items()))
    return docs.select(key, F.explode(found).alias("x")).select(key, "x.*").where("statement <> ''")


def edited(docs: DataFrame, key: str) -> DataFrame:
    """(key, created, modified): the first begin and the last end of what the statements' authors did; texts compare."""
    nodes = F.filter(F.transform(many(F.col("doc"), "referred_to_by"), lambda v: at(v, "created_by")), lambda v: v.isNotNull())
    return docs.select(key, F.array_min(F.transform(nodes, lambda v: span(v)["begins"])).alias("created"), F.array_max(F.transform(nodes, lambda v: span(v)["ends"])).alias("modified"))


def made_by(v: Column) -> Column:
    """Ids of assigned makers: of a group without an id those of the people that formed it."""
    members = lambda g: F.filter(refs(at(g, "formed_by"), "influenced_by"), lambda _: at(g, "type", "string") == "Group")
    return F.flatten(F.transform(many(v, "assigned"), lambda a: F.when(ref(a).isNotNull(), F.array(local(ref(a)))).otherwise(F.transform(members(a), local))))


def assignments(v: Column) -> Column:
    wanted = lambda x: (at(x, "type", "string") == "AttributeAssignment") & at(x, "assigned_property", "string").isin("carried_out_by", "influenced_by")
    return F.filter(many(v, "assigned_by"), wanted)


def production(docs: DataFrame, key: str) -> DataFrame:
    """(key, part, kind, value, maker): roles, qualifiers, makers, places and source types of every part of the making,
    and each qualifier with each maker that it was said of (kind ``attribution``). Parts count from 0; what is said of
    the whole is part -1; a making without parts is part 0."""
    making = at(F.col("doc"), "produced_by")
    listed = at(making, "part", "array<variant>").isNotNull()
    rows = docs.select(key, making.alias("making"), listed.alias("listed")).where("making is not null")
    parts = F.when(F.col("listed"), F.concat(F.array(F.named_struct(F.lit("part"), F.lit(-1), F.lit("node"), F.col("making"))), F.transform(many(F.col("making"), "part"), lambda v, i: F.named_struct(F.lit("part"), i, F.lit("node"), v))))
    parts = F.coalesce(parts, F.array(F.named_struct(F.lit("part"), F.lit(0), F.lit("node"), F.col("making"))))
    each_part = rows.select(key, F.explode(parts).alias("x")).select(key, "x.part", "x.node")
    node, own = F.col("node"), F.col("part") >= 0

    def entries(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("value"), x, F.lit("maker"), F.lit(None).cast("string")))

    ids = lambda v, path: F.transform(refs(v, path), local)
    pairs = lambda a: F.flatten(F.transform(ids(a, "classified_as"), lambda q: F.transform(made_by(a), lambda m: F.named_struct(F.lit("kind"), F.lit("attribution"), F.lit("value"), q, F.lit("maker"), m))))
    none = F.array().cast("array<string>")
    found = F.concat(
        entries("role", F.when(own, ids(node, "technique")).otherwise(none)), entries("qualifier", F.when(own, ids(node, "classified_as")).otherwise(none)),
        entries("qualifier", F.flatten(F.transform(assignments(node), lambda a: ids(a, "classified_as")))), entries("maker", F.flatten(F.transform(assignments(node), made_by))),
        F.flatten(F.transform(assignments(node), pairs)), entries("place", ids(node, "took_place_at")), entries("source_type", ids(node, "used_object_of_type")),
    )
    return each_part.select(key, "part", F.explode(found).alias("x")).select(key, "part", "x.*")


def evidence(docs: DataFrame, key: str) -> DataFrame:
    """(key, part, kind, source, label): what an attribution rests on, a row for each source, or one without any; equal
    rows once."""
    parts = docs.select(key, F.posexplode(many(at(F.col("doc"), "produced_by"), "part")).alias("part", "node"))
    why = F.flatten(F.transform(many(F.col("node"), "assigned_by"), lambda a: many(a, "motivated_by")))
    rows = parts.select(key, "part", F.explode(why).alias("why"))
    sources = refs(F.col("why"), "carried_by")
    rows = rows.select(key, "part", F.get(refs(F.col("why"), "classified_as"), F.lit(0)).alias("kind"), F.explode_outer(sources).alias("source"), said(many(F.col("why"), "identified_by")).alias("label"))
    return rows.groupBy(key, "part", "kind", "source").agg(F.min("label").alias("label"))


def treatments(docs: DataFrame, key: str) -> DataFrame:
    """(key, seq, by, shown, begins, ends, description) of every treatment."""
    first = lambda v: F.get(F.array_compact(F.transform(many(v, "referred_to_by"), lambda x: text(x))), F.lit(0))
    dates = {name: (lambda v, name=name: span(v)[name]) for name in ("shown", "begins", "ends")}
    return each(docs, key, many(F.col("doc"), "modified_by"), by=lambda v: F.get(refs(v, "carried_out_by"), F.lit(0)), **dates, description=first)


def attributed(docs: DataFrame) -> Column:
    return many(F.col("doc"), "attributed_by")


def examinations(docs: DataFrame, key: str) -> DataFrame:
    """(key, seq, examiner, report, report_label, shown, begins, ends): assignments that somebody carried out and that
    have a class; the label in the preferred language."""
    def examiner(v: Column) -> Column:
        name = lambda a: F.coalesce(F.get(F.array_compact(F.transform(many(a, "identified_by"), lambda x: text(x))), F.lit(0)), local(ref(a)))
        return F.get(F.array_compact(F.transform(many(v, "carried_out_by"), name)), F.lit(0))

    def label(v: Column) -> Column:
        kind = F.get(many(v, "classified_as"), F.lit(0))
        notes = F.transform(many(kind, "notation"), lambda n: F.named_struct(F.lit("lang"), F.try_variant_get(n, "$['@language']", "string"), F.lit("text"), F.nullif(F.try_variant_get(n, "$['@value']", "string"), F.lit(""))))
        return F.coalesce(preferred(F.filter(notes, lambda p: p["text"].isNotNull())), F.get(F.array_compact(F.transform(many(kind, "identified_by"), lambda x: text(x))), F.lit(0)))

    done = lambda v: (F.size(many(v, "carried_out_by")) > 0) & (F.size(refs(v, "classified_as")) > 0)
    dates = {name: (lambda v, name=name: span(v)[name]) for name in ("shown", "begins", "ends")}
    return each(docs, key, F.filter(attributed(docs), done), examiner=examiner, report=lambda v: F.get(refs(v, "classified_as"), F.lit(0)), report_label=label, **dates)


def relations(docs: DataFrame, key: str) -> DataFrame:
    """(key, related, label_en, label_nl): objects that an assignment by nobody names, with what it calls the relation; a
    label in another language, or in none, stands in for a missing English one; without any the relation is left out."""
    nobody = F.filter(attributed(docs), lambda v: F.size(many(v, "carried_out_by")) == 0)
    rows = docs.select(key, F.explode(nobody).alias("node"))
    pairs = F.filter(F.transform(many(F.col("node"), "identified_by"), pair), lambda p: p["text"].isNotNull())
    last = lambda lang: F.try_element_at(F.filter(pairs, lambda p: p["lang"] == lang), F.lit(-1))["text"]
    other = F.get(F.filter(pairs, lambda p: F.coalesce(~p["lang"].isin(*LANGUAGES), F.lit(True))), F.lit(0))["text"]
    found = rows.select(key, F.explode(refs(F.col("node"), "assigned")).alias("related"), F.coalesce(last("en"), other).alias("label_en"), last("nl").alias("label_nl"))
    return found.where("label_en is not null")


def other_ids(docs: DataFrame, key: str, authority) -> DataFrame:
    """(key, authority, uri): equal things elsewhere, those of what shows the object too, each id once. ``authority``: a
    function from an id to whose it is."""
    doc = F.col("doc")
    found = F.array_distinct(F.concat(refs(doc, "equivalent"), F.flatten(F.transform(many(doc, "shown_by"), lambda v: refs(v, "equivalent")))))
    return docs.select(key, F.explode(found).alias("uri")).select(key, authority(F.col("uri")).alias("authority"), "uri")


def narratives(docs: DataFrame, key: str) -> DataFrame:
    """(key, narrative): the essay in the preferred language; an essay takes the language of what it is part of."""
    def essays(v: Column) -> Column:
        known = [F.get(F.filter(refs(v, "language"), lambda x: x.isin(*map(whole, LANGUAGES.values()))), F.lit(0)), F.get(refs(v, "language"), F.lit(0))]
        lang = named(F.coalesce(*known), LANGUAGES)
        own = F.filter(many(v, "part"), lambda p: classed(p, NARRATIVE))
        return F.filter(F.transform(own, lambda p: F.named_struct(F.lit("lang"), lang, F.lit("text"), text(p))), lambda p: p["text"].isNotNull() & p["lang"].isNotNull())

    return docs.select(key, preferred(F.flatten(F.transform(many(F.col("doc"), "subject_of"), essays))).alias("narrative")).where("narrative is not null")


def links(docs: DataFrame, key: str) -> DataFrame:
    """(key, kind, id): wholes that an object is part of, what it is about, and what it shows first."""
    doc = F.col("doc")
    wholes = F.array_compact(F.transform(F.filter(many(doc, "part_of"), lambda v: at(v, "type", "string") == "HumanMadeObject"), ref))
    kinds = {"part_of": wholes, "about": F.transform(refs(doc, "about"), local), "shows": F.slice(refs(doc, "shows"), 1, 1)}
    of = lambda kind, ids: F.transform(ids, lambda x: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("id"), x))
    found = reduce(F.concat, (of(kind, ids) for kind, ids in kinds.items()))
    return docs.select(key, F.explode(found).alias("x")).select(key, "x.*")
