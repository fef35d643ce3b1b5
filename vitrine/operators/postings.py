"""Stored postings: ranked search that reads the query's words alone, not all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import text as T

BUCKETS = 64
SPREAD = 8  # parts of a bucket, by document


def lengths(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(row, key, w0, w1 and so on: the tokens of the columns, len: how many)."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), *(T.tokens(F.col(c)).alias(f"w{i}") for i, c in enumerate(columns)))
    return words.withColumn("len", sum((F.size(f"w{i}") for i in range(len(columns))), F.lit(0)))


def postings(words: DataFrame, columns: list[str]) -> DataFrame:
    """(term, field, row, key, len, places), one row for each term of a document's field. A document's postings are made in its
    row: its tokens are sorted, and each run of one term is a slice. Nothing is shuffled."""
    field = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"w{i}").alias("w")) for i, c in enumerate(columns))))
    each = words.select("row", "key", "len", field.alias("f")).where("size(f.w) > 0")
    each = each.select("row", "key", "len", "f.field", F.array_sort(F.transform("f.w", lambda t, at: F.struct(t.alias("term"), at.alias("at")))).alias("s"))
    term = lambda i: F.get("s", i)["term"]
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))
    each = each.withColumn("first", F.concat(first, F.array(F.size("s"))))
    start = lambda k: F.get("first", k)
    posting = lambda k: F.struct(term(start(k)).alias("term"), F.transform(F.slice("s", start(k) + 1, start(k + 1) - start(k)), lambda x: x["at"]).alias("places"))
    posts = each.select("row", "key", "len", "field", F.explode(F.transform(F.sequence(F.lit(0), F.size("first") - 2), posting)).alias("p"))
    return posts.select("p.term", "field", "row", "key", "len", "p.places")


def build(docs: DataFrame, key: str, columns: list[str], folder: str, buckets: int = BUCKETS) -> None:
    """Writes postings of all tokens of some text columns, and the number and mean length of the documents.

    A posting is (term, field, row, the document's key, its length over all columns, the places of the term in that field). The table is
    partitioned by a hash of the term and sorted by term, so that a query's words are found by partitions and row
    groups; a term of very many documents is spread over files by document. Null texts have no tokens; every row is a
    document of its own, whatever its key; documents without a token count for the mean. Other columns may have any name.
    """
    words = lengths(docs, key, columns)
    words.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), F.lit(buckets).alias("buckets"), F.lit(None).cast(docs.schema[key].dataType).alias("key")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    posts = postings(words, columns)
    posts = posts.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))
    order = ["bucket", "term", "row"]
    # dealt by hashes: ranges would be sampled first, which makes every posting twice
    posts.repartition("bucket", F.pmod("row", F.lit(SPREAD))).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def of_words(spark: SparkSession, folder: str, words: list[str], fields: list[str] | None = None) -> DataFrame:
    """The postings of some tokens: the folders of their buckets, and there the row groups that hold them."""
    stats = spark.read.parquet(f"{folder}/stats")
    buckets, kind = stats.first()["buckets"], stats.schema["key"].dataType.simpleString()
    rows = spark.read.schema(f"term string, field string, row bigint, key {kind}, len int, places array<int>, bucket int").parquet(f"{folder}/postings")
    wanted = sorted(set(words))
    rows = rows.where(F.col("term").isin(wanted) & F.col("bucket").isin([F.pmod(F.hash(F.lit(w)), F.lit(buckets)) for w in wanted])) if wanted else rows.limit(0)
    return rows.where(F.col("field").isin(fields)) if fields else rows


def bm25(spark: SparkSession, folder: str, key: str, phrases: list[str], fields: list[str] | None = None) -> DataFrame:
    """(key, score) of documents that match any phrase, by stored postings; scores are those of ``text.bm25`` over the same
    documents. Phrases that overlap themselves count at each place. A phrase without a word matches nothing."""
    told = [T.words_of(p) for p in phrases]
    words = sorted({w for p in told for w in p})
    slot = {w: i for i, w in enumerate(words)}
    posts = of_words(spark, folder, words, fields)
    held = posts.groupBy("row", "field").agg(F.first("key").alias("key"), F.first("len").alias("len"), *(F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{i}") for w, i in slot.items()))

    def begins(w: str, i: int):
        return F.transform(F.col(f"p{slot[w]}"), lambda at: at - i)

    def times(phrase: list[str]):
        starts = None
        for i, w in enumerate(phrase):
            own = begins(w, i)
            starts = own if starts is None else F.array_intersect(starts, own)
        return F.coalesce(F.size(starts), F.lit(0)) if starts is not None else F.lit(0)

    per_field = held.select("row", "key", "len", *(F.greatest(times(p), F.lit(0)).alias(f"n{i}") for i, p in enumerate(told)))
    rows = per_field.groupBy("row").agg(F.first("key").alias(key), F.first("len").alias("len"), *(F.sum(f"n{i}").alias(f"tf{i}") for i in range(len(told))))
    stats = spark.read.parquet(f"{folder}/stats").drop("key").crossJoin(rows.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(told))), F.count("*").alias("_found")))
    score = F.lit(0.0)
    for i in range(len(told)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(told))), F.lit(0), F.lit(0)) > 0
    return rows.crossJoin(F.broadcast(stats)).where(hit).select(key, (-score).alias("score"))
