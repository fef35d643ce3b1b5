"""Benchmark decontamination by size-partitioned MinHash containment search, all in DataFrame functions.

A test item is contained in a document if at least ``threshold`` of its distinct shingles occur there. A
document is far longer than an item, so a signature of the document would drown it; instead the items carry
the signatures. Items are partitioned by size (powers of two of their shingle count); every item of a
partition gives its smallest shingle hashes, as many as the partition's largest size may miss, and one
more. A document that contains the item can't miss all of them, so probing with every shingle of the
document finds each contained item. Candidates are then verified by exact shingle containment, shingle
text against shingle text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.shared import cut, spare

SHINGLE, THRESHOLD = 5, 0.8
SMALL = 2_000_000  # rows of long integers, or of shingles of test items, up to which a side is broadcast


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def runs(w: str, k: int, f, short: list[int]) -> Column:
    """``f(i, n)`` for every run of ``k`` words of the array column ``w``, and of every number of words in ``short``: i its
    place, n its words."""
    none = F.array().cast("array<int>")
    places = lambda n: F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(none)
    of = lambda n: F.transform(places(n), lambda i: f(i, n))
    every = [of(n) for n in (k, *short)]
    return every[0] if len(every) == 1 else F.concat(*every)


def hashed_shingles(w: str, k: int, short: list[int]) -> Column:
    """A hash of every run of k words of the array column ``w``, and of the lengths in ``short``."""
    return runs(w, k, lambda i, n: F.xxhash64(*(F.get(F.col(w), i + j) for j in range(n))), short)


def shingles(w: str, k: int, short: list[int]) -> Column:
    """The text of every run of k words of the array column ``w``, and of the lengths in ``short``, each once."""
    return F.array_distinct(runs(w, k, lambda i, n: F.concat_ws(" ", F.slice(F.col(w), i + 1, n)), short))


def of_items(w: str, k: int, f, short: list[int]) -> Column:
    """``f`` (one of the two above) for an item: of fewer than ``k`` words the whole sequence is its one shingle."""
    out = f(w, k, [])
    for n in short:
        out = F.when(F.size(w) == n, f(w, n, [])).otherwise(out)
    return out


def sized(side: DataFrame, rows: int) -> DataFrame:
    """``side`` to be broadcast if it is proven small; beyond that Spark shuffles both sides."""
    return F.broadcast(side) if rows <= SMALL else side


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Test items contained in documents: (doc_id, item_id, n_shingles, n_shared, containment), one row per pair.

    An item of fewer than ``k`` words has one shingle, its whole sequence; null or empty texts, and those without a
    letter or digit, neither match nor are matched. Rows without an id take no part. Rows that repeat an id count as one document (or one
    item) with the shingles of all. Other columns are not read; empty tables give no rows.
    """
    item = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).where("item_id is not null")
    item = cut(item.where(F.size("w") > 0))
    short = sorted(r["n"] for r in item.select(F.size("w").alias("n")).where(F.col("n") < k).distinct().collect())  # k - 1 at most
    own = cut(item.select("item_id", F.explode(of_items("w", k, shingles, short)).alias("shingle")).distinct())
    total = own.count()
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    most = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1
    sizes = sizes.withColumn("part", F.floor(F.log2("n_shingles"))).withColumn("depth", (most - F.ceil(most * threshold) + 1).cast("int"))
    hashes = item.select("item_id", F.explode(of_items("w", k, hashed_shingles, short)).alias("h")).distinct()
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("h"))
    signature = hashes.withColumn("nth", nth).join(sizes, "item_id").where("nth <= depth").select("h", "item_id")
    lookup = cut(signature.select("h").distinct())

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    probes = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(hashed_shingles("w", k, short)).alias("h"))
    candidates = cut(probes.join(sized(lookup, lookup.count()), "h").select("doc_id").distinct())
    again = docs.join(sized(candidates, candidates.count()), "doc_id", "left_semi")
    have = again.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingles("w", k, short)).alias("shingle"))
    shared = have.join(sized(own, total), "shingle").groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"))
    return (
        shared.join(sized(sizes.select("item_id", "n_shingles"), total), "item_id")
        .where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9))
        .select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    )


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, whole and with all their columns, that contain no test item. Rows without an id stay."""
    mark = spare(docs, "_found")
    found = contained(docs, items, threshold, k, id_col, text_col).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(found, F.col(id_col) == F.col(mark), "left_anti")


def oracle(threshold: float = THRESHOLD, k: int = SHINGLE) -> str:
    """The same rows by exact containment of all pairs that share a shingle, for DuckDB."""
    words = "select %s, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from %s"
    return f"""
    with dw as ({words % ("doc_id", "documents")}), bw as ({words % ("item_id", "benchmark")}),
      d as (select distinct doc_id, array_to_string(w[i:i + n - 1], ' ') as shingle from dw, (select distinct least({k}, len(w)) as n from bw where len(w) > 0), unnest(range(1, len(w) - n + 2)) as t(i)),
      b as (select distinct item_id, array_to_string(w[i:i + least({k}, len(w)) - 1], ' ') as shingle from bw, unnest(range(1, len(w) - least({k}, len(w)) + 2)) as t(i) where len(w) > 0),
      n as (select item_id, count(*) as n_shingles from b group by 1)
    select doc_id, item_id, n_shingles, count(*) as n_shared, count(*) / n_shingles::double as containment
    from d join b using (shingle) join n using (item_id)
    group by doc_id, item_id, n_shingles having count(*) >= ceil(n_shingles * {threshold} - 1e-9)"""
