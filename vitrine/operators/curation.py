"""What a catalogue's records go through after they are read: classes by keywords, rule corrections, tiers of
evidence, codes, audits of coordinates, snapshots carried into a new build, samples and wide exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a piece of a history says was done, by the cues that say it; of several classes the first counts. What became of
#: the work or its owner outranks what was paid, that outranks how people are related, and that where the work was.
#: A cue is words in a row, ``%`` anything between them, ``*`` any end of a word; marks are words of their own.
POSSESSIVE = ("his", "her", "their")
CHILDREN = [f"{a}{b}{c}" for a in ("", "grand", "great-grand", "step") for b in ("son", "daughter") for c in ("", "s")]
RELATIVES = [*CHILDREN, *(f"{x}{c}" for x in ("heir", "sister", "brother", "cousin", "uncle", "aunt", "nephew", "niece") for c in ("", "s")), "wife", "husband", "children", "mother", "father"]
NOBLES = ("count", "baron", "prince", "marchesa", "conte")
CUES = [
    ("it found no buyer", {"sale": ["unsold", "bought in", "withdrawn", "ingetrokken", "invendu"]}),
    ("it was made to order", {"commission": [f"commissioned {x}" for x in ("by", "for", "as")]}),
    ("it was taken, or taken back", {"recuperation": ["war recuperation"], "theft": ["stolen"], "looting": ["looted"], "confiscation": ["confiscat*", "führermuseum"]}),
    ("it went without changing hands", {"loan": ["on loan"], "transfer": ["transfer", "transferred", "removed", "sent to"]}),
    ("it was left in a will", {"bequest": ["bequest*", "bequeathed", "testament*"]}),
    ("it was paid for", {"sale": [
        *("sold", "purchased", "verwerving", "through the mediation", "from the artist", "bought by", "from the dealer", "by whom to", "from whom , % to", "from whose heirs % to the museum"),
        *(f"acquired {x}" for x in ("by", "from", "for", "in", "with")), *(f"{who} {x}sale" for who in POSSESSIVE for x in ("", "posthumous ", "deceased ")), *(f"from {x} % to" for x in NOBLES)]}),
    ("a partner outlived the owner", {"widowhood": ["widow", "widower"]}),
    ("it stayed in the family", {"by_descent": ["by descent", "inherited by", "from the heirs", "erven", "by inheritance", "through inheritance", *(f"{who} {x}" for who in POSSESSIVE for x in RELATIVES)]}),
    ("it was given for another", {"exchange": ["exchanged with", "exchanged for"]}),
    ("somebody had it", {"collection": ["collection", "with a dealer", "with an art dealer", "with a art dealer", "ex coll", "ex . coll", "first recorded", "first mentioned"]}),
    ("it was given", {"gift": ["donated", "donation", "gift", "given by", "presented by", "dedicated to", "schenking"]}),
    ("it was put somewhere", {"deposit": ["stored", "deposited", "installed", "placed"]}),
    ("it was listed", {"inventory": ["estate inventory", "probate inventory"], "collection": ["inventory"]}),
]
#: Words that come with an owner's name where no cue says what was done.
HOLDERS = {
    "rank": "baron jonkheer count countess graaf gravin lord lady prince princess duke duchess marquis sir dr prof",
    "house": "kunsthandel galerie gallery galleria museum musée stichting foundation",
    "building": "kerk church chapel kapel cathedral klooster monastery abbey abdij convent castle paleis palace stadhuis",
}
ANONYMOUS = [f"{x} {y}" for x in ("private", "unknown", "unidentified") for y in ("collector", "dealer")] + ["art market", "town hall"]
#: Words of owners that outlast people, and of what a work is built into.
LASTING = {
    "worship": "kerk church chapel kapel cathedral kathedraal monastery klooster abbey abdij convent priory parish diocese saint sint",
    "care": "hospital gasthuis weeshuis university universiteit library museum stichting foundation guild gilde order",
    "rule": "gemeente stad city town staat state council paleis palace castle kasteel",
}
BUILT_IN = "installed geplaatst chimney schoorsteenstuk altarpiece altaarstuk organ orgel pulpit preekstoel tomb graf monument facade gevel ceiling plafond wall wand floor vloer window raam door deur gate poort"


def spaced(text: Column) -> Column:
    """A text in lower case with a space around every word and every mark."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.regexp_replace(text, r"([^\p{L}\p{N}\s'’-])", " $1 ")), r"\s+", " "), F.lit(" "))


def says(t: Column, cue: str) -> Column:
    """Whether the spaced text ``t`` has the words of a cue."""
    return t.like(f"% {cue[:-1]}%" if cue.endswith("*") else f"% {cue} %")


def has_word(t: Column, *lists: str) -> Column:
    return F.arrays_overlap(F.split(t, " "), F.array(*(F.lit(w) for words in lists for w in words.split())))


def sale_named(t: Column) -> Column:
    """A sale that is an event of its own: named, numbered in brackets, or with its year."""
    return t.rlike(r" sale (?:\[|\p{L}|.*\d{4})")


def transfer_of(text: Column) -> Column:
    """The transfer type of the first class of ``CUES`` that the text has a cue of; none, or no text: unknown."""

    def of(t: Column) -> Column:
        found = []
        for what, kinds in CUES:
            for kind, cues in kinds.items():
                more = [sale_named(t)] if what == "it was paid for" else []
                found.append(F.when(reduce(Column.__or__, [*(says(t, c) for c in cues), *more]), F.lit(kind)))
        return F.coalesce(*found, F.lit("unknown"))

    return F.element_at(F.transform(F.array(spaced(text)), of), 1)


def collection_like(text: Column) -> Column:
    """Whether a text names an owner: a rank, house or building, an unnamed collector, years of life or a collector's
    mark in brackets."""

    def of(t: Column) -> Column:
        marked = t.rlike(r" \( l \. \d+ \) | \( \d{4} ?[-–] ?\d{2,4} (?:\? )?\) | \( \d{4}[-–]\d{2,4} (?:\? )?\) ")
        return reduce(Column.__or__, [marked, has_word(t, *HOLDERS.values()), *(says(t, c) for c in ANONYMOUS)])

    return F.coalesce(F.element_at(F.transform(F.array(spaced(text)), of), 1), F.lit(False))


def is_piece(text: Column) -> Column:
    """Whether more is left of a piece than a number of a lot or list and remarks in brackets."""
    rest = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"(?i)\b(?:lot|lots|no|nos)\b", "")
    return rest.rlike(r"\p{L}")


def refined(events: DataFrame) -> DataFrame:
    """Parsed events without pieces that are none (a bare lot, number or remark in brackets); unknown transfers take
    their type from cues, then from signs of an owner. Unsold pieces and cross references stay as they are."""
    c = F.col
    text = F.trim(F.regexp_replace("raw_text", r"\([A-Z]+(?:-[A-Z]+)*-\d[^)]*\)", ""))  # numbers of objects say nothing
    some = events.where(is_piece(text))
    open_ = (c("transfer_type") == "unknown") & ~c("is_cross_ref") & ~c("unsold")
    named = F.when(open_ & ~c("gap"), transfer_of(text)).otherwise(c("transfer_type"))
    return some.withColumn("transfer_type", F.when(open_ & (named == "unknown") & collection_like(text), "collection").otherwise(named))


def settled(events: DataFrame) -> DataFrame:
    """Events after the rules that need no judgement: ambiguous transfers change the owner; unsold pieces that say
    what they were bought in at get that price; adds ``corrections``, the names of the rules applied, in order."""
    from vitrine.operators.provenance import priced

    c = F.col
    owned = (c("transfer_type") == "transfer") & (c("transfer_category") == "ambiguous") & ~c("is_cross_ref")
    price = F.when(c("unsold") & c("price_amount").isNull(), priced(F.nullif(F.regexp_extract("raw_text", r"(?i)bought\s+in\s+at\s+(.*)", 1), F.lit(""))))
    done = F.array_compact(F.array(F.when(owned, F.lit("transfer_is_ownership")), F.when(price.isNotNull(), F.lit("unsold_price"))))
    return events.withColumns({
        "transfer_category": F.when(owned, "ownership").otherwise(c("transfer_category")), "price_amount": F.coalesce(c("price_amount"), price["amount"]),
        "price_currency": F.coalesce(c("price_currency"), price["currency"]), "corrections": done,
    })


def with_receivers(events: DataFrame) -> DataFrame:
    """Events with a receiver that the text names after 'to the' where no party received; catalogues receive nothing."""
    c = F.col
    name = F.regexp_extract("raw_text", r"(?i)\bto the ((?:dealers? )?[^,;{(]{2,100}?)\s*(?:[,;{(]|through the mediation|with support|$)", 1)
    dealer = name.rlike("(?i)^dealers? ")
    none = ~F.exists("parties", lambda p: F.coalesce(p["position"] == "receiver", F.lit(False)))
    add = none & (name != "") & ~name.rlike("(?i)^catalogue")
    party = F.struct(F.regexp_replace(name, "(?i)^dealers? ", "").alias("name"), F.lit(None).cast("string").alias("dates"), c("uncertain").alias("uncertain"), F.when(dealer, "dealer").otherwise("buyer").alias("role"), F.lit("receiver").alias("position"))
    return events.withColumn("parties", F.when(add, F.concat("parties", F.array(party))).otherwise(c("parties")))


def method_tag(method: Column, usual: str | None = None) -> Column:
    """A short tag of how a value was found: nothing for the usual way, 'llm:' and the rest for a model's, the bare
    name for a model's structural rule."""
    structural, model = "llm_structural:", "llm_"
    cut = lambda p: F.substr(method, F.lit(len(p) + 1))
    tag = F.when(method.startswith(structural), cut(structural)).when(method.startswith(model), F.concat(F.lit("llm:"), cut(model))).otherwise(method)
    return F.when(method == usual, None).otherwise(F.nullif(tag, F.lit(""))) if usual else F.nullif(tag, F.lit(""))


#: Tiers of evidence, strongest first.
TIERS = ("manual", "deterministic", "inferred")


def promoted(values: DataFrame, key: str, value: str, tier: str, order: list[str]) -> DataFrame:
    """One row for each key: the value of its strongest tier, of several the first by ``order``. Unknown tiers and null
    values never win; a key with no other has no row."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col(tier))
    own = values.withColumn("_r", F.nullif(rank, F.lit(0))).where(F.col("_r").isNotNull() & F.col(value).isNotNull())
    return own.groupBy(key).agg(F.min(F.struct("_r", *order, value, tier)).alias("_m")).select(key, F.col(f"_m.{value}").alias(value), F.col(f"_m.{tier}").alias(tier))


def coded(table: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``table`` with a text column of few values as integers (empty and null: null), and the codes (id, text) in order
    of the texts. Codes are broadcast only if they are counted to be under a thousand."""
    from vitrine.operators.ranking import places

    texts = table.select(F.nullif(F.col(column), F.lit("")).alias("text")).where("text is not null").distinct()
    codes = places(texts, [], [F.col("text")]).select(F.col("place").alias("id"), "text")
    side = codes.select(F.col("id").alias(name), F.col("text").alias("_text"))
    side = F.broadcast(side) if codes.limit(1000).count() < 1000 else side
    return table.join(side, F.col(column) == F.col("_text"), "left").drop("_text", column), codes


def placed_as_expected(found: Column, expected: Column, covered: Column) -> Column:
    """Verdict on a coordinate: the country of the area around it against the expected one; without an area it is wrong
    if the expected country has areas at all."""
    same = F.lower(found) == F.lower(expected)
    return F.when(found.isNotNull(), F.when(expected.isNull() | same, "agree").otherwise("mild")).otherwise(F.when(F.coalesce(covered, F.lit(False)) & expected.isNotNull(), "wrong").otherwise("no_coverage"))


def reimported(snapshot: DataFrame, old: DataFrame, new: DataFrame, key: str, natural: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an older build with the ids of a new one, by what names an entity in both, and the rows whose entity is gone."""
    ids = old.select(F.col(key).alias("_old"), natural).join(new.select(F.col(key).alias("_new"), natural), natural, "left").select("_old", "_new")
    rows = snapshot.join(ids, snapshot[key] == F.col("_old"), "left")
    kept = rows.where("_new is not null").withColumn(key, F.col("_new")).select(snapshot.columns)
    return kept, rows.where("_new is null").select(snapshot.columns)


def long_periods(periods: DataFrame, years: int = 200) -> DataFrame:
    """Periods of more than ``years``, with ``duration`` and ``verdict``: an artifact where a first period without an owner
    begins long before the work was made (a number read as a year) or, without a method either, when it was made;
    legitimate where an institution owns it, it was commissioned, or a named owner's history speaks of either; else
    uncertain. Columns: sequence, owner_name, acquisition_method, begin_year, end_year, date_earliest, date_latest, text."""
    c = F.col
    first, nobody = c("sequence") == 1, F.coalesce(c("owner_name"), F.lit("")) == ""
    artifact = first & nobody & ((c("begin_year") < c("date_earliest") - 50) | (c("acquisition_method").isNull() & c("begin_year").between(c("date_earliest"), c("date_latest"))))
    owner, said = spaced(c("owner_name")), spaced(c("text"))
    lasting = has_word(owner, *LASTING.values()) | (c("acquisition_method") == "commission") | (~nobody & has_word(said, *LASTING.values(), BUILT_IN))
    verdict = F.when(artifact, "artifact").when(lasting, "legitimate").otherwise("uncertain")
    return periods.withColumn("duration", c("end_year") - c("begin_year")).where(c("duration") > years).withColumn("verdict", verdict)


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``n`` rows without replacement, the same for the same seed: the first by a hash of the key
    (null: empty); rows of one key go by a hash of all their columns. Tasks keep their first ``n`` before anything is
    shuffled."""
    drawn = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return rows.orderBy(drawn, key, F.xxhash64(*rows.columns)).limit(n)


def wide(entities: DataFrame, edges: DataFrame, terms: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each entity and place linked to it: its columns, then the term's; an entity without any keeps one row.
    ``edges``: key, term; ``terms``: term and more."""
    return entities.select(key, *columns).join(edges.join(terms, "term").withColumnRenamed("term", "term_id"), key, "left")


def exported(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with headers, quoted where needed."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
