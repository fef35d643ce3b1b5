"""Records whose fields refer to entities of the same record."""

import pytest

from vitrine.sources import records

HEAD = '<r:RDF xmlns:r="urn:r" xmlns:e="urn:e" xmlns:x="urn:x">'
FULL = f"""<record><header><identifier>oai:1</identifier><datestamp>2024-01-02</datestamp><setSpec>a</setSpec><setSpec>b</setSpec></header><metadata>{HEAD}
<e:Aggregation r:about="agg"><e:aggregatedCHO><e:ProvidedCHO r:about="http://x/1"><identifier>SK-1</identifier><title x:lang="nl">De molen</title><title x:lang="en">The Mill</title><created>1650</created>
<type>IMAGE</type><type r:resource="t1"/><medium r:resource="m1"/><medium r:resource="gone"/><medium r:resource="m2"/><creator r:resource="gone"/><creator r:resource="p1"/><isPartOf r:resource="s1"/>
<subject r:resource="pl1"/><subject r:resource="c1"/><subject r:resource="gone"/><subject r:resource="p1"/><subject>mills</subject></e:ProvidedCHO></e:aggregatedCHO>
<e:isShownBy><e:WebResource r:about="w"><e:has_service r:resource="http://svc"/></e:WebResource></e:isShownBy><e:object r:resource="http://img"/><e:rights r:resource="http://cc0"/></e:Aggregation>
<e:Agent r:about="p1"><prefLabel x:lang="de">Vos (de)</prefLabel><prefLabel x:lang="nl">Vos</prefLabel><sameAs r:resource="http://ulan/1"/></e:Agent>
<e:Concept r:about="t1"><altLabel>painting</altLabel></e:Concept><e:Concept r:about="m1"><prefLabel>oil</prefLabel></e:Concept><e:Description r:about="m2"><label>canvas</label></e:Description><e:Description r:about="s1"><prefLabel x:lang="en">Set</prefLabel></e:Description>
<e:Concept r:about="c1"><altLabel>mill</altLabel><altLabel>47D3</altLabel><sameAs r:resource="http://other/9"/><sameAs r:resource="http://iconclass.org/47D3"/></e:Concept>
<e:Place r:about="pl1"><prefLabel>Haarlem</prefLabel><isPartOf r:resource="pl2"/></e:Place><e:Place r:about="pl2"><prefLabel>Holland</prefLabel><isPartOf r:resource="pl3"/></e:Place><e:Place r:about="pl3"><isPartOf r:resource="pl1"/></e:Place></r:RDF></metadata></record>"""
GONE = '<record><header status="deleted"><identifier>oai:2</identifier><datestamp>2024</datestamp></header></record>'
BARE = f"<record><header><identifier>oai:3</identifier></header><metadata>{HEAD}</r:RDF></metadata></record>"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("feed") / "page.xml"
    path.write_text(f"<list>{FULL}{GONE}{BARE}</list>")
    return records.resolved(records.records(spark, str(path)))


def test_fields_come_from_entities(found):
    rows = {r["about"]: r.asDict() for r in records.fields(found).collect()}
    assert rows["http://x/1"] == {
        "about": "http://x/1", "number": "SK-1", "datestamp": "2024-01-02", "deleted": False, "title": "The Mill", "description": None, "date": "1650", "dimensions": None, "type": "painting", "materials": ["oil", "canvas"],
        "kind": "IMAGE", "creator": "Vos", "image": "http://img", "service": "http://svc", "rights": "http://cc0", "sets": ["Set"]}
    assert rows["oai:2"]["deleted"] and not rows["oai:3"]["deleted"] and rows["oai:3"]["title"] is None and rows["oai:3"]["materials"] == []
    assert len(rows) == 3


def test_subjects_their_kinds_and_what_holds_them(found):
    rows = sorted((tuple(r) for r in records.subjects(found).collect()), key=lambda r: r[1])
    assert rows == [
        ("http://x/1", 0, "pl1", "Haarlem", "place", None, None, ["Holland"]), ("http://x/1", 1, "c1", "mill", "concept", "http://iconclass.org/47D3", "47D3", []), ("http://x/1", 3, "p1", "Vos", "person", "http://ulan/1", None, [])]


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "large.xml"
    path.write_text("<list>\n" + "\n".join(FULL.replace("oai:1", f"oai:{i}").replace("http://x/1", f"http://x/{i}") for i in range(2000)) + "\n</list>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        docs = records.records(spark, str(path))
        assert docs.rdd.getNumPartitions() > 3
        ids = [r[0] for r in records.resolved(docs).select("identifier").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(ids) == sorted(f"oai:{i}" for i in range(2000))
