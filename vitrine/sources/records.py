"""Harvested records with entities of their own: fields that name an entity by its id are read from that entity.

Files are split at the end of records, so many tasks read one file, and every record is one VARIANT, so no element has to
be known beforehand. All entities of a record are found by their ids; references
are followed a stated number of steps, and what leads nowhere or back ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.linked import at, many, preferred

#: Kinds of subjects by the element that describes them; any other describes a concept.
KINDS = {"Place": "place", "Agent": "person"}


def records(spark: SparkSession, path: str, tag: str = "record") -> DataFrame:
    """(doc): every element ``tag`` of the XML files at ``path``, without namespaces; attributes are ``_name``, the text of an
    element that has attributes is ``_VALUE``. ``tag`` is written as the files write it, with a prefix if they have one.

    Its closing tag is what tasks split files at, so one file of any size is read by many. Elements that don't parse are
    left out.
    """
    text = spark.read.option("lineSep", f"</{tag}>").text(path)
    body = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>(?:(?!<{tag}[\s>]).)*+$", 0)
    docs = text.where(F.col("value").contains(f"<{tag}")).select(F.concat(body, F.lit(f"</{tag}>")).alias("x"))
    return docs.select(F.from_xml("x", "variant", {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("doc")).where(F.schema_of_variant("doc").startswith("OBJECT"))


def words(v: Column) -> Column:
    """The text of an element; numbers as they are written, elements without a text none."""
    return F.nullif(F.when(F.schema_of_variant(v).startswith("OBJECT"), at(v, "_VALUE", "string")).otherwise(v.try_cast("string")), F.lit(""))


def told(v: Column, *paths: str) -> Column:
    """The text in the preferred language of the elements at the first path that has any."""
    pairs = lambda p: F.filter(F.transform(many(v, p), lambda x: F.named_struct(F.lit("lang"), at(x, "_lang", "string"), F.lit("text"), words(x))), lambda x: x["text"].isNotNull())
    return F.coalesce(*(preferred(pairs(p)) for p in paths))


def targets(v: Column, path: str) -> Column:
    """The ids that elements at a path refer to."""
    return F.array_compact(F.transform(many(v, path), lambda x: at(x, "_resource", "string")))


def entities(rdf: Column) -> Column:
    """Every element below ``rdf`` that has an id, with its tag; of one id the last."""
    tags = F.map_entries(F.coalesce(rdf.try_cast("map<string, variant>"), F.create_map().cast("map<string, variant>")))

    def own(e: Column) -> Column:
        nodes = F.coalesce(e["value"].try_cast("array<variant>"), F.array(e["value"]))
        return F.transform(nodes, lambda n: F.named_struct(F.lit("about"), at(n, "_about", "string"), F.lit("tag"), e["key"], F.lit("node"), n))

    return F.filter(F.flatten(F.transform(tags, own)), lambda x: x["about"].isNotNull())


def found(all_: Column, uri: Column) -> Column:
    """The entity of an id, null if the record hasn't it."""
    return F.try_element_at(F.filter(all_, lambda e: e["about"] == uri), F.lit(-1))


def label(entity: Column) -> Column:
    return told(entity["node"], "prefLabel", "altLabel", "label")


def led_to(all_: Column, uri: Column, by: str, steps: int) -> Column:
    """The ids that ``by`` leads to from an id, nearest first, in at most ``steps`` steps; the first reference counts, and
    one that leads back, or out of the record, is the end."""

    def step(so_far: Column, _: Column) -> Column:
        after = F.get(targets(found(all_, F.element_at(so_far, -1))["node"], by), F.lit(0))
        return F.when(after.isNull() | F.array_contains(so_far, after) | found(all_, after).isNull(), so_far).otherwise(F.concat(so_far, F.array(after)))

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(uri), step)
    return F.when(uri.isNotNull(), F.slice(whole, 2, steps))


def resolved(docs: DataFrame) -> DataFrame:
    """``docs`` (doc) as (identifier, datestamp, sets, deleted, about, work, whole, entities): the described work and what
    holds it, null for deleted records."""
    doc = F.col("doc")
    rdf = at(doc, "metadata.RDF")
    head = [at(doc, "header.identifier", "string").alias("identifier"), at(doc, "header.datestamp", "string").alias("datestamp"), F.array_compact(F.transform(many(doc, "header.setSpec"), lambda x: words(x))).alias("sets")]
    gone = F.coalesce(at(doc, "header._status", "string") == "deleted", F.lit(False))
    some = docs.select(*head, gone.alias("deleted"), F.when(~gone, F.get(many(rdf, "Aggregation"), F.lit(0))).alias("whole"), F.when(~gone, entities(rdf)).alias("entities"))
    some = some.withColumn("work", F.get(many(F.col("whole"), "aggregatedCHO.ProvidedCHO"), F.lit(0)))
    return some.withColumn("about", F.coalesce(at(F.col("work"), "_about", "string"), F.col("identifier")))


def fields(found_: DataFrame) -> DataFrame:
    """One row per record of ``resolved``: about, number, datestamp, deleted, title, description, date, dimensions, type,
    materials, kind, creator, image, service, rights, sets (labels of what it is part of). Names come from the
    record's entities; references without one give nothing."""
    work, whole, all_ = F.col("work"), F.col("whole"), F.col("entities")
    labels = lambda path: F.array_compact(F.transform(targets(work, path), lambda u: label(found(all_, u))))
    first = lambda path: label(F.get(F.filter(F.transform(targets(work, path), lambda u: found(all_, u)), lambda e: e.isNotNull()), F.lit(0)))
    service = F.get(F.flatten(F.transform(many(whole, "isShownBy.WebResource"), lambda x: targets(x, "has_service"))), F.lit(0))
    return found_.select(
        "about", F.get(F.transform(many(work, "identifier"), lambda x: words(x)), F.lit(0)).alias("number"), "datestamp", "deleted", told(work, "title").alias("title"), told(work, "description").alias("description"),
        told(work, "created").alias("date"), told(work, "extent").alias("dimensions"), first("type").alias("type"), labels("medium").alias("materials"), F.get(F.transform(many(work, "type"), lambda x: words(x)), F.lit(0)).alias("kind"),
        first("creator").alias("creator"), F.get(targets(whole, "object"), F.lit(0)).alias("image"), service.alias("service"), F.get(targets(whole, "rights"), F.lit(0)).alias("rights"), labels("isPartOf").alias("sets"),
    )


def subjects(found_: DataFrame, concepts: str = "iconclass.org", steps: int = 3) -> DataFrame:
    """(about, seq, id, label, kind, uri, code, within): every subject that the record describes. Kinds follow the element
    (places, persons, else concepts); ``uri`` is what it is the same as, of concepts one of ``concepts`` first; ``code`` a
    concept's other name that begins with a digit; ``within`` the labels of what holds it, nearest first."""
    rows = found_.select("about", "entities", F.posexplode(targets(F.col("work"), "subject")).alias("seq", "id"))
    rows = rows.withColumn("e", found(F.col("entities"), F.col("id"))).where("e is not null")
    e, node = F.col("e"), F.col("e")["node"]
    kind = F.coalesce(*(F.when(e["tag"] == tag, F.lit(k)) for tag, k in KINDS.items()), F.lit("concept"))
    same = targets(node, "sameAs")
    known = F.when(kind == "concept", F.get(F.filter(same, lambda u: u.contains(concepts)), F.lit(0)))
    code = F.when(kind == "concept", F.get(F.filter(F.transform(many(node, "altLabel"), lambda x: words(x)), lambda t: t.rlike("^[0-9]")), F.lit(0)))
    within = F.array_compact(F.transform(led_to(F.col("entities"), F.col("id"), "isPartOf", steps), lambda u: label(found(F.col("entities"), u))))
    return rows.select("about", "seq", "id", F.coalesce(label(e), F.substring_index("id", "/", -1)).alias("label"), kind.alias("kind"), F.coalesce(known, F.get(same, F.lit(0))).alias("uri"), code.alias("code"), within.alias("within"))
