"""Schema discovery: which paths a column of JSON documents has, how often and of which types."""

from __future__ import annotations

import json as js
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "null"}


def walk(value, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(path, type, value) of every scalar, and the length of every array."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        yield path or "[]", "array", str(len(value))
        for v in value:
            yield from walk(v, f"{path}[]")
    else:
        yield path, KINDS[type(value)], None if value is None else str(value)


def path_values(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, type, value): every value of every document, arrays as ``path[]``; text that isn't JSON has
    none."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(k, *x) for x in walk(js.loads(text))] if text else []
                except ValueError:
                    continue
            if rows:
                k, p, t, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, batch.schema.field(0).type), pa.array(p, pa.string()), pa.array(t, pa.string()), pa.array(v, pa.string())], names=[key, "path", "type", "value"])

    return docs.select(key, json).mapInArrow(each, f"{key} {docs.schema[key].dataType.simpleString()}, path string, type string, value string")


def path_profile(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(path, type, n, docs, coverage, lengths): values of each path and type, documents that have it and their
    share; of arrays the least, mean and largest length."""
    total = F.broadcast(docs.agg(F.count("*").alias("_total")))
    size = F.when(F.col("type") == "array", F.col("value").try_cast("int"))
    counted = path_values(docs, key, json).groupBy("path", "type").agg(F.count("*").alias("n"), F.count_distinct(key).alias("docs"), F.struct(F.min(size).alias("least"), F.avg(size).alias("mean"), F.max(size).alias("most")).alias("lengths"))
    return counted.crossJoin(total).select("path", "type", "n", "docs", (F.col("docs") / F.col("_total")).alias("coverage"), "lengths")


def top_values(docs: DataFrame, key: str, json: str, most: int = 5) -> DataFrame:
    """(path, value, n): the most frequent values of each path, counted once a document."""
    from pyspark.sql import Window

    counted = path_values(docs, key, json).where("type <> 'array'").groupBy("path", "value").agg(F.count_distinct(key).alias("n"))
    return counted.withColumn("_i", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "value"))).where(F.col("_i") <= most).drop("_i")
