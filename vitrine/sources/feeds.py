"""Readers of what catalogues are harvested from: XML change feeds and exports, triples, logs, tables of patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "identifier string, datestamp string, setSpec array<string>, _status string"


def feed_headers(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, datestamp, sets, deleted) of every header of feed pages; pages may repeat."""
    rows = spark.read.format("xml").option("rowTag", "header").option("ignoreNamespace", "true").schema(HEADER).load(path)
    return rows.select("identifier", "datestamp", F.coalesce("setSpec", F.array().cast("array<string>")).alias("sets"), F.coalesce(F.col("_status") == "deleted", F.lit(False)).alias("deleted"))


def feed_records(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """(identifier, datestamp, sets, deleted, and ``fields``) of every record of feed pages. ``fields``: XPath
    expressions by name, each read as an array of strings from the record's metadata; deleted records have none.

    Records are kept as text and read by XPath in the JVM, so no element has to be known beforehand.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<record\b.*?</record>"), 0)).alias("x"))
    plain = F.regexp_replace(F.regexp_replace("x", r"\sxmlns(?::[\w-]+)?\s*=\s*(?:\x22[^\x22]*\x22|'[^']*')", ""), r"(</?|\s)[A-Za-z][\w-]*:(?=[A-Za-z])", "$1")
    rows = raw.select(plain.alias("x"))
    text = lambda p: F.nullif(F.xpath_string("x", F.lit(p)), F.lit(""))
    more = [F.xpath("x", F.lit(p)).alias(name) for name, p in (fields or {}).items()]
    return rows.select(text("record/header/identifier").alias("identifier"), text("record/header/datestamp").alias("datestamp"), F.xpath("x", F.lit("record/header/setSpec/text()")).alias("sets"), F.coalesce(text("record/header/@status") == "deleted", F.lit(False)).alias("deleted"), *more)


def resumption(spark: SparkSession, path: str) -> DataFrame:
    """(path, token, list_size): where each page says that the list goes on; the last page has no token."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", F.nullif(F.trim(F.regexp_extract("value", r"<resumptionToken[^>]*>([^<]*)</resumptionToken>", 1)), F.lit("")).alias("token"), F.regexp_extract("value", r"completeListSize\s*=\s*\x22(\d+)\x22", 1).try_cast("long").alias("list_size"))


def upserted(table: DataFrame, changes: DataFrame, key: str, order: list[str], deleted: str = "deleted") -> DataFrame:
    """A table after a batch of changes: of each key the last change counts, deleted keys go, others replace."""
    from vitrine.operators.sequences import latest

    last = latest(changes, key, order)
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted).select(table.columns))


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of one name in large XML exports, read one by one."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, kind, lang, datatype) of N-Triples files; kind is uri, bnode or literal.
    Escapes are decoded; comments, blank and broken lines are left out."""
    node = r"(?:<([^>]*)>|(_:\S+))"
    line = rf"^\s*{node}\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|\x22((?:[^\x22\\]|\\.)*)\x22(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$"
    part = lambda i: F.nullif(F.regexp_extract("value", line, i), F.lit(""))
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    kind = F.when(part(4).isNotNull(), "uri").when(part(5).isNotNull(), "bnode").otherwise("literal")
    literal = unescaped(F.regexp_extract("value", line, 6))
    return rows.select(F.coalesce(part(1), part(2)).alias("subject"), part(3).alias("predicate"), F.coalesce(part(4), part(5), literal).alias("object"), kind.alias("kind"), part(7).alias("lang"), part(8).alias("datatype"))


def unescaped(text: Column) -> Column:
    """Backslash escapes of a literal decoded: quotes, tabs, line ends, backslashes and code points."""
    pieces = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), 0)
    code = lambda p: F.decode(F.unhex(F.lpad(F.substr(p, F.lit(3)), 8, "0")), "UTF-32")

    def one(p: Column) -> Column:
        named = F.when(p == r"\n", "\n").when(p == r"\t", "\t").when(p == r"\r", "\r").otherwise(F.substr(p, F.lit(2)))
        return F.when(p.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), code(p)).when(p.startswith("\\"), named).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def by_subject(triples: DataFrame, predicates: dict[str, str], lang: str | None = None) -> DataFrame:
    """(subject, one array column per name): objects of the named predicates in order; with ``lang`` only
    literals of that language or of none."""
    own = triples.where(F.col("predicate").isin(*predicates.values()))
    if lang:
        own = own.where(F.col("lang").isNull() | (F.col("lang") == lang))
    return own.groupBy("subject").agg(*(F.array_sort(F.collect_set(F.when(F.col("predicate") == p, F.col("object")))).alias(name) for name, p in predicates.items()))


def followed(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(subject, object): what a path of predicates leads to, through blank nodes and others."""
    step = lambda p, a, b: triples.where(F.col("predicate") == p).select(F.col("subject").alias(a), F.col("object").alias(b))
    out = step(predicates[0], "subject", "_0")
    for i, p in enumerate(predicates[1:]):
        out = out.join(step(p, f"_{i}", f"_{i + 1}"), f"_{i}").drop(f"_{i}")
    return out.withColumnRenamed(f"_{len(predicates) - 1}", "object").distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; lines that are no JSON of that schema are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ts, server, level, direction, payload) of lines '2024-01-01T00:00:00Z [server] [level] message from client: {...}'."""
    line = r"^(\S+) \[([^\]]*)\] \[([^\]]*)\] Message from (\w+): (\{.*\})"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    part = lambda i: F.regexp_extract("value", line, i)
    return rows.select(F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("server"), part(3).alias("level"), part(4).alias("direction"), part(5).alias("payload"))


def with_key_from_name(df: DataFrame, pattern: str, name: str = "key") -> DataFrame:
    """Rows of files with what a pattern finds in their file's name."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def updated_from_csv(table: DataFrame, path: str, key: str, fields: list[str]) -> DataFrame:
    """``table`` with fields taken from a CSV with a header, for keys that it has; other keys of the CSV are
    skipped, empty values change nothing. Adds ``updated``."""
    spark = table.sparkSession
    patch = spark.read.csv(path, header=True).dropDuplicates([key]).select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_hit"))
    out = table.join(patch, F.col(key).cast("string") == F.col("_k"), "left").withColumn("updated", F.coalesce("_hit", F.lit(False)))
    new = {f: F.coalesce(F.nullif(F.col(f"_{f}"), F.lit("")).try_cast(table.schema[f].dataType), F.col(f)) for f in fields}
    return out.withColumns(new).drop("_k", "_hit", *(f"_{f}" for f in fields))


def dictionary(edges: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges with a text column as integers, and the dictionary (id, text), ids in order of the texts."""
    from vitrine.operators.ranking import places

    words = places(edges.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct(), [], [F.col("text")]).select(F.col("place").alias("id"), "text")
    return edges.join(words, F.col(column) == F.col("text")).drop("text", column).withColumnRenamed("id", name), words


def size_guarded(rows: DataFrame, compact: list[str], most_bytes: int) -> DataFrame:
    """``rows`` whole if their JSON is within a budget, else their compact columns; decided in the plan, by one
    row that both sides see."""
    total = F.broadcast(rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("_size")))
    rest = [c for c in rows.columns if c not in compact]
    out = rows.crossJoin(total)
    return out.select(*compact, *(F.when(F.col("_size") <= most_bytes, F.col(c)).alias(c) for c in rest))


def days(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Rows of a change log that is laid out as year=/month=/day= folders, from a day up to but not including
    another: the bounds are on the partition columns, so other folders aren't listed as input."""
    rows = spark.read.option("basePath", path).parquet(path)
    day = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))
    return rows.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))


def since(rows: DataFrame, ts: str, mark) -> DataFrame:
    """Rows after a high-water mark; None: all."""
    return rows if mark is None else rows.where(F.col(ts) > F.lit(mark).cast("timestamp"))


def centroid(geojson: Column) -> Column:
    """struct(lon, lat) of a GeoJSON geometry: a point itself, else the mean of the outer ring (of the first polygon)."""
    kind = F.get_json_object(geojson, "$.type")
    ring = F.coalesce(F.when(kind == "Polygon", F.get_json_object(geojson, "$.coordinates[0]")), F.when(kind == "MultiPolygon", F.get_json_object(geojson, "$.coordinates[0][0]")), F.when(kind.isin("LineString", "MultiPoint"), F.get_json_object(geojson, "$.coordinates")), F.when(kind == "Point", F.concat(F.lit("["), F.get_json_object(geojson, "$.coordinates"), F.lit("]"))))
    spots = F.from_json(ring, "array<array<double>>")
    mean = lambda i: F.aggregate(spots, F.lit(0.0), lambda s, p: s + p[i]) / F.size(spots)
    return F.when(F.size(spots) > 0, F.struct(mean(0).alias("lon"), mean(1).alias("lat")))
