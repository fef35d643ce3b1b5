"""Changes laid out as a tree of years, months and days of files, as a data source for batches and for streams.

``path``/2024/3/15/0001.json (or year=2024/month=3/day=15/...) holds one or more pages, JSON objects one after another, whose
``member`` lists changes: their type (Create, Update, Delete), their object with the profile of its payload, and
the payload itself. Files of a day count in the order of their names, shorter names first. A file appears whole
(written under a name with a dot or underscore in front and then renamed); its changes are never altered.

The tree is walked level by level: a year or month outside the wanted days, or before the place where a stream
stands, isn't listed. A stream's offset is the last file that it has read, so a file that comes later under a
smaller name is not part of it. A file that holds anything but JSON objects fails with its name, because leaving it out
would lose its changes for good.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "day date, position string, kind string, object string, profile string, payload string"
FILES = 16  # files that a task reads


def opened(path: str):
    """(file system, folder) of a path or a URI that the workers can read."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(system, folder: str) -> list:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [f for f in found if not f.base_name.startswith((".", "_"))]


def place(at: list) -> tuple:
    """A position [year, month, day, file name], or the first parts of one, in order."""
    return (*at[:3], *((len(n), n) for n in at[3:4]))


def number(name: str) -> int | None:
    """The year, month or day that a folder stands for."""
    told = name.rpartition("=")[2]
    return int(told) if told.isdecimal() else None


def files(path: str, after: list, upto: list | None, first: date | None, end: date | None) -> list[list]:
    """Positions of the files behind one position up to another, of days from ``first`` to before ``end``, in order."""
    system, root = opened(path)
    lowest = [first.year, first.month, first.day] if first else []
    last = end - timedelta(days=1) if end else None
    highest = [last.year, last.month, last.day] if last else []

    def wanted(at: list) -> bool:
        n = min(len(at), 3)
        inside = (not lowest or at[:n] >= lowest[:n]) and (not highest or at[:n] <= highest[:n])
        return inside and place(at)[:n] >= place(after)[:n] and (upto is None or place(at)[:n] <= place(upto)[:n])

    level = [([], root)]
    for _ in range(3):
        below = [([*at, number(f.base_name)], f.path) for at, folder in level for f in listed(system, folder) if number(f.base_name) is not None]
        level = [(at, folder) for at, folder in below if wanted(at)]
    found = [([*at, f.base_name], f.path) for at, folder in level for f in listed(system, folder) if f.is_file]
    return [[*at, p] for at, p in sorted(found, key=lambda x: place(x[0])) if place(at) > place(after) and (upto is None or place(at) <= place(upto))]


def pages(text: str, name: str) -> Iterator[dict]:
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        try:
            page, at = decoder.raw_decode(text, at)
        except ValueError as e:
            raise ValueError(f"{name} is no JSON: {e}") from e
        if not isinstance(page, dict):
            raise ValueError(f"{name} holds a page that is no object")
        yield page


def told(thing: dict, *names: str):
    """The first of some fields that there is; of a list its first entry."""
    value = next((thing[n] for n in names if thing.get(n) is not None), None)
    return value[0] if isinstance(value, list) and value else value


def change(member: dict) -> tuple:
    """(kind, object, profile, payload) of a member."""
    thing = member.get("object")
    thing = thing if isinstance(thing, dict) else {"@id": thing}
    kind, uri, graph = told(member, "@type", "type"), told(thing, "@id", "id"), member.get("@graph")
    uri, _, asked = str(uri or "").partition("?")
    profile = next((x.partition("=")[2] for x in asked.split("&") if x.startswith("_profile=")), None) or told(thing, "profile")
    kind = str(kind).replace("#", "/").replace(":", "/").rpartition("/")[2] if kind else None
    return kind, uri or None, profile and str(profile), json.dumps(graph, ensure_ascii=False) if isinstance(graph, dict) else None


class Files(InputPartition):
    """Some files that one task reads."""


def rows(path: str, some: list[list]) -> Iterator[tuple]:
    """The changes of some files. ``position`` sorts as they follow each other."""
    system, _ = opened(path)
    for *at, file in some:
        with system.open_input_stream(file) as f:
            text = f.read().decode()
        day, n = date(*at[:3]), 0
        for page in pages(text, file):
            members = page.get("member") or []
            for m in members if isinstance(members, list) else [members]:
                if isinstance(m, dict):
                    yield day, f"{day.isoformat()}/{len(at[3]):04}/{at[3]}#{n:09}", *change(m)
                    n += 1


class Walk:
    """What the options say: the folder, the days, and how many files a task reads."""

    def __init__(self, options):
        self.path = options["path"]
        self.first, self.end = (date.fromisoformat(options[n]) if options.get(n) else None for n in ("from", "to"))
        self.each = int(options.get("files", FILES))

    def parts(self, after: list, upto: list | None) -> list[Files]:
        found = files(self.path, after, upto, self.first, self.end)
        return [Files(found[i : i + self.each]) for i in range(0, len(found), self.each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(self.path, partition.value)


class Batch(Walk, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.parts([], None) or [Files([])]


class Stream(Walk, DataSourceStreamReader):
    """Offsets are positions of files; the walk for the newest begins at the last one known."""

    def __init__(self, options):
        super().__init__(options)
        self.newest: list = []

    def initialOffset(self) -> dict:
        return {"after": []}

    def latestOffset(self) -> dict:
        found = files(self.path, self.newest, None, self.first, self.end)
        self.newest = found[-1][:4] if found else self.newest
        return {"after": self.newest}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        if not end["after"] or place(end["after"]) <= place(start["after"]):
            return []
        return self.parts(start["after"], end["after"])

    def commit(self, end: dict) -> None:
        self.newest = max(self.newest, end["after"], key=place)


class EventTree(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("event_tree").option("path", ...)``, with ``from`` (a day) and
    ``to`` (a day, itself left out)."""

    @classmethod
    def name(cls) -> str:
        return "event_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)


def changes(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, streaming: bool = False) -> DataFrame:
    """The changes of a tree (day, position, kind, object, profile, payload), of days from ``start`` to before ``end``."""
    spark.dataSource.register(EventTree)
    reader = (spark.readStream if streaming else spark.read).format("event_tree").option("path", path)
    for name, day in (("from", start), ("to", end)):
        reader = reader.option(name, day) if day else reader
    return reader.load()


def followed(spark: SparkSession, path: str, log: str, progress: str, profile: str | None = None) -> DataFrame:
    """Reads what is new in a tree since the last run with the same folders, adds it to the log of changes, and gives
    the objects as they now are: (object, position, kind, profile, payload) of each one's last change of any kind but
    Delete. With ``profile``, payloads of other profiles are left out; deletions count whatever their profile."""
    from pyspark.sql import functions as F

    from vitrine.streaming import events

    new = changes(spark, path, streaming=True).where("object is not null")
    if profile:
        new = new.where((F.col("profile") == profile) | (F.col("kind") == "Delete"))
    new = new.select("object", "position", "kind", "profile", "payload", (F.col("kind") == "Delete").alias("deleted"))
    events.applied(new, "object", ["position"], log, progress)
    return events.current(spark, log, "object", ["position"], "deleted").drop("deleted")
