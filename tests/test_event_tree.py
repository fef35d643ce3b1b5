"""The tree of changes: what is listed, what a stream goes on from, and broken pages."""

import json
from datetime import date

import pytest

from vitrine.sources import event_tree


def put(root, name, members, pretty=False):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"member": members}, indent=2 if pretty else None))


def member(kind, uri, **graph):
    return {"@type": kind, "object": {"@id": f"{uri}?a=1&_profile=framed"}, **({"@graph": graph} if graph else {})}


def test_only_wanted_folders_are_listed(tmp_path, monkeypatch):
    for day in ("2023/12/31", "2024/2/28", "2024/2/29", "2024/10/1", "2025/1/1"):
        put(tmp_path, f"{day}/1.json", [])
    seen, real = [], event_tree.listed
    monkeypatch.setattr(event_tree, "listed", lambda system, folder: seen.append(folder) or real(system, folder))
    found = event_tree.files(str(tmp_path), [], None, date(2024, 2, 29), date(2024, 10, 1))
    assert [f[:4] for f in found] == [[2024, 2, 29, "1.json"]]
    assert not any(part in folder for folder in seen for part in ("2023", "2025", "/2/28", "/10/1"))
    seen.clear()
    later = event_tree.files(str(tmp_path), [2024, 10, 1, "1.json"], None, None, None)
    assert [f[:3] for f in later] == [[2025, 1, 1]] and not any("2023" in folder or "2024/2" in folder for folder in seen)


def test_names_in_order_hidden_files_and_empty_trees(tmp_path):
    for name in ("10.json", "9.json", ".tmp.json", "_part"):
        put(tmp_path, f"year=2024/month=03/day=05/{name}", [])
    (tmp_path / "year=2024" / "notes").mkdir()
    assert [f[3] for f in event_tree.files(str(tmp_path), [], None, None, None)] == ["9.json", "10.json"]
    assert event_tree.files(str(tmp_path / "absent"), [], None, None, None) == []


def test_changes_of_pages(spark, tmp_path):
    put(tmp_path, "2024/3/1/1.json", [member("Create", "x:1", a="é"), "no object", {"type": ["as:Delete"], "object": "x:2"}, {"object": {"id": "x:3", "profile": "p"}, "@graph": [1]}], pretty=True)
    with open(tmp_path / "2024/3/1/1.json", "a") as f:
        f.write('\n{"member": {"@type": "Update", "object": null}}\n{}')
    rows = event_tree.changes(spark, str(tmp_path)).orderBy("position").collect()
    assert [tuple(r)[2:] for r in rows] == [("Create", "x:1", "framed", '{"a": "é"}'), ("Delete", "x:2", None, None), (None, "x:3", "p", None), ("Update", None, None, None)]
    assert {r["day"] for r in rows} == {date(2024, 3, 1)}
    assert event_tree.changes(spark, str(tmp_path), "2024-03-02").count() == 0


@pytest.mark.parametrize("text", ["{", "[1]"])
def test_a_broken_page_fails_with_its_name(spark, tmp_path, text):
    put(tmp_path, "2024/3/1/1.json", [])
    (tmp_path / "2024/3/1/1.json").write_text(text)
    with pytest.raises(Exception, match="1.json"):
        event_tree.changes(spark, str(tmp_path)).count()


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    tree, log, progress = (tmp_path / n for n in ("tree", "log", "progress"))
    run = lambda: {r["object"]: json.loads(r["payload"])["v"] for r in event_tree.followed(spark, str(tree), str(log), str(progress), "framed").collect()}
    put(tree, "2024/3/1/1.json", [member("Create", "x:1", v=1), member("Create", "x:2", v=1)])
    put(tree, "2024/3/1/2.json", [member("Update", "x:1", v=2)])
    assert run() == {"x:1": 2, "x:2": 1}
    put(tree, "2024/3/1/10.json", [member("Delete", "x:2")])
    put(tree, "2024/4/1/1.json", [member("Create", "x:3", v=1), {"@type": "Update", "object": {"@id": "x:3?_profile=other"}, "@graph": {"v": 9}}])
    assert run() == {"x:1": 2, "x:3": 1}
    assert run() == {"x:1": 2, "x:3": 1}  # nothing new
    put(tree, "2024/4/2/1.json", [member("Create", "x:2", v=5), member("Delete", "x:1")])
    assert run() == {"x:2": 5, "x:3": 1}
