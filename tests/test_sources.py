from vitrine.sources import feeds

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
 <ListRecords>
  <record><header status="deleted"><identifier>http://x/9</identifier><datestamp>2026-01-03T00:00:00Z</datestamp></header></record>
  <record><header><identifier>http://x/2</identifier><datestamp>2026-01-02T00:00:00Z</datestamp><setSpec>a</setSpec><setSpec>b</setSpec></header>
   <metadata><rdf:RDF><rdf:Description rdf:about="http://x/2"><dc:title xml:lang="en">Mill &amp; river</dc:title><dc:title xml:lang="nl">Molen</dc:title><dc:type rdf:resource="http://t/1"/></rdf:Description></rdf:RDF></metadata></record>
  <resumptionToken completeListSize="12">next-page</resumptionToken>
 </ListRecords>
</OAI-PMH>"""


def written(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_feed_records_headers_and_tombstones(spark, tmp_path):
    path = written(tmp_path, "page.xml", FEED)
    rows = {r["identifier"]: r for r in feeds.feed_records(spark, path, {"titles": "//title/text()", "english": "//title[@lang='en']/text()", "types": "//type/@resource"}).collect()}
    assert rows["http://x/9"]["deleted"] and rows["http://x/9"]["titles"] == [] and rows["http://x/9"]["datestamp"] == "2026-01-03T00:00:00Z"
    two = rows["http://x/2"]
    assert (two["deleted"], two["sets"], two["titles"], two["english"], two["types"]) == (False, ["a", "b"], ["Mill & river", "Molen"], ["Mill & river"], ["http://t/1"])
    heads = {r["identifier"]: (r["deleted"], r["sets"]) for r in feeds.feed_headers(spark, path).collect()}
    assert heads == {"http://x/9": (True, []), "http://x/2": (False, ["a", "b"])}
    assert [(r["token"], r["list_size"]) for r in feeds.resumption(spark, path).collect()] == [("next-page", 12)]


def test_changes_replace_and_remove(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    changes = spark.createDataFrame([("a", 5, "2", False), ("a", 4, "1", False), ("b", None, "1", True), ("d", 7, "1", None), ("e", 8, "1", False), ("e", None, "2", True)], "id string, v int, at string, deleted boolean")
    assert sorted(map(tuple, feeds.upserted(table, changes, "id", ["at"]).collect())) == [("a", 5), ("c", 3), ("d", 7)]


def test_triples(spark, tmp_path):
    path = written(tmp_path, "d.nt", '<http://s/1> <http://p/label> "Caf\\u00E9 \\"x\\"\\n"@en .\n<http://s/1> <http://p/part> _:b1 .\n_:b1 <http://p/value> "12"^^<http://t/int> .\n# note\n\nbroken line\n<http://s/2> <http://p/label> "Twee"@nl .\n<http://s/2> <http://p/see> <http://s/1> . # end\n')
    t = feeds.ntriples(spark, path)
    rows = {(r["subject"], r["predicate"]): (r["object"], r["kind"], r["lang"], r["datatype"]) for r in t.collect()}
    assert rows == {("http://s/1", "http://p/label"): ('Café "x"\n', "literal", "en", None), ("http://s/1", "http://p/part"): ("_:b1", "bnode", None, None), ("_:b1", "http://p/value"): ("12", "literal", None, "http://t/int"), ("http://s/2", "http://p/label"): ("Twee", "literal", "nl", None), ("http://s/2", "http://p/see"): ("http://s/1", "uri", None, None)}
    by = {r["subject"]: r["label"] for r in feeds.by_subject(t, {"label": "http://p/label"}, "en").collect()}
    assert by == {"http://s/1": ['Café "x"\n']}
    assert [tuple(r) for r in feeds.followed(t, ["http://p/see", "http://p/part", "http://p/value"]).collect()] == [("http://s/2", "12")]


def test_elements_logs_and_patches(spark, tmp_path):
    xml = written(tmp_path, "l.xml", '<w xmlns:l="http://l"><l:lido><l:id>1</l:id><l:event><l:type>made</l:type></l:event></l:lido><l:lido><l:id>2</l:id></l:lido></w>')
    assert sorted((r["id"], r["event"]["type"] if r["event"] else None) for r in feeds.elements(spark, xml, "lido", "id int, event struct<type:string>").collect()) == [(1, "made"), (2, None)]
    log = written(tmp_path, "a.jsonl", '{"tool": "x", "ms": 1.5}\nnot json\n{"tool": "y", "ms": 2}\n')
    assert sorted(r["tool"] for r in feeds.json_lines(spark, log, "tool string, ms double").collect()) == ["x", "y"]
    lines = written(tmp_path, "s.log", '2024-01-01T00:00:00Z [srv] [info] Message from client: {"id":1}\nnoise\n')
    assert [(r["server"], r["direction"], r["payload"]) for r in feeds.log_lines(spark, lines).collect()] == [("srv", "client", '{"id":1}')]
    table = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, "c")], "id int, lat double, name string")
    patch = written(tmp_path, "p.csv", "id,lat,name\n2,5.5,\n3,,z\n9,1,q\n")
    assert sorted(tuple(r) for r in feeds.updated_from_csv(table, patch, "id", ["lat", "name"]).collect()) == [(1, 1.0, "a", False), (2, 5.5, "b", True), (3, 3.0, "z", True)]


def test_keys_dictionaries_and_budgets(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "admin-nl"))
    rows = feeds.with_key_from_name(spark.read.parquet(str(tmp_path / "admin-nl")), r"admin-(\w+)/").collect()
    assert {r["key"] for r in rows} == {"nl"}
    coded, words = feeds.dictionary(spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "k int, field string"), "field", "field_id")
    assert sorted(map(tuple, words.collect())) == [(1, "a"), (2, "b")] and sorted(map(tuple, coded.collect())) == [(1, 2), (2, 1), (3, 2)]
    wide = spark.createDataFrame([(1, "x" * 50)], "id int, body string")
    assert feeds.size_guarded(wide, ["id"], 1000).first()["body"] == "x" * 50 and feeds.size_guarded(wide, ["id"], 10).first()["body"] is None


def test_paths_of_json(spark):
    from vitrine.sources.json_paths import path_profile, top_values

    docs = spark.createDataFrame([(1, '{"a": 1, "b": [{"c": "x"}, {"c": "x"}]}'), (2, '{"a": null}'), (3, "no"), (4, None)], "id int, j string")
    rows = {(r["path"], r["type"]): (r["n"], r["docs"], r["coverage"]) for r in path_profile(docs, "id", "j").collect()}
    assert rows == {("a", "number"): (1, 1, 0.25), ("a", "null"): (1, 1, 0.25), ("b", "array"): (1, 1, 0.25), ("b[].c", "string"): (2, 1, 0.25)}
    assert ("b[].c", "x", 1) in {tuple(r) for r in top_values(docs, "id", "j").collect()}


def test_days_marks_and_centroids(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "log")
    spark.createDataFrame([(i, 2024, 1 + i // 20, 1 + i % 20) for i in range(40)], "i int, year int, month int, day int").write.partitionBy("year", "month", "day").parquet(path)
    rows = feeds.days(spark, path, "2024-01-19", "2024-02-03")
    assert sorted(r["i"] for r in rows.collect()) == [18, 19, 20, 21]
    assert "PartitionFilters: [isnotnull" in rows._jdf.queryExecution().executedPlan().toString()
    stamps = spark.sql("select timestamp '2024-01-01 00:00:00' as ts union all select timestamp '2024-01-02 00:00:00'")
    assert feeds.since(stamps, "ts", "2024-01-01 00:00:00").count() == 1 and feeds.since(stamps, "ts", None).count() == 2
    shapes = ['{"type":"Point","coordinates":[1,2]}', '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0]]],[[[9,9]]]]}', "no", None]
    found = [r["c"] and tuple(r["c"]) for r in spark.createDataFrame([(i, g) for i, g in enumerate(shapes)], "i int, g string").orderBy("i").select(feeds.centroid(F.col("g")).alias("c")).collect()]
    assert found == [(1.0, 2.0), (1.0, 1.0), (2.0, 0.0), None, None]
