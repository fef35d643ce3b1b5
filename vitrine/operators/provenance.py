"""Ownership histories: free text to events to periods, and their search. Column expressions throughout: a
text is split into segments, each segment is typed by the first rule that fits, and dates, prices, parties
and places are extracted from what the rule leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Transfer types and what they transfer.
CATEGORY = {
    "sale": "ownership", "inheritance": "ownership", "by_descent": "ownership", "widowhood": "ownership", "bequest": "ownership", "gift": "ownership",
    "commission": "ownership", "exchange": "ownership", "confiscation": "ownership", "theft": "ownership", "looting": "ownership", "recuperation": "ownership",
    "restitution": "ownership", "collection": "ownership", "inventory": "ownership", "loan": "custody", "deposit": "custody", "transfer": "ambiguous", "unknown": "ambiguous",
}
#: A party's position by its role, and, without a role, by the transfer.
POSITION = {
    "buyer": "receiver", "borrower": "receiver", "heir": "receiver", "recipient": "receiver", "patron": "receiver", "collector": "receiver", "creator": "receiver", "sitter": "receiver",
    "seller": "sender", "consignor": "sender", "donor": "sender", "deceased": "sender", "lender": "sender",
    "intermediary": "agent", "auctioneer": "agent", "dealer": "agent",
}
RECEIVED = ("collection", "recuperation", "restitution", "commission", "inventory")
#: Words for relatives.
KIN = r"(?:step|grand|great-grand|god)?(?:sons?|daughters?)|heirs?|widow(?:er)?|wife|husband|nephews?|nieces?|brothers?|sisters?|cousins?|uncle|aunt|mother|father|parents|in-law|descendants?|family"

#: Openings of a segment in order: type, the first party's role, pattern. The first that fits decides.
OPENINGS = [
    ("sale", "buyer", r"sold (?:by \w+ )?to|(?:from|by) whom (?:purchased|bought|acquired|sold) (?:by|to)|purchased by|bought by|acquired by|from whose heirs to"),
    ("sale", "seller", r"(?:purchased|bought|acquired) (?:from|through)|sold by|(?:(?:his|her|their|anonymous|unknown|private|national) (?:posthumous |deceased )?)?sale(?: \[[^\]]*\])?,?"),
    ("sale", "intermediary", r"through the mediation of"),
    ("commission", "patron", r"commissioned (?:by|for)|founded by"),
    ("recuperation", None, r"war recuperation"),
    ("confiscation", None, r"confiscated (?:by|from)?|suppressed|seized (?:by|from)?"),
    ("theft", None, r"stolen(?: from| by)?"),
    ("looting", None, r"looted(?: from| by)?"),
    ("loan", "borrower", r"(?:from (?:which|whom) )?on (?:long[- ]term )?loan to"),
    ("loan", "lender", r"(?:from (?:which|whom) )?on (?:long[- ]term )?loan(?: from)?|on display|exhibited(?: at)?"),
    ("transfer", "recipient", r"(?:by whom )?transferred to|sent to|removed to|dispatched to|transfer to"),
    ("transfer", "consignor", r"transferred from|consigned by"),
    ("bequest", "heir", r"(?:by whom )?bequeathed to"),
    ("bequest", "heir", r"bequeathed by|(?:by )?bequest(?: of| from)?|(?:his|her) will"),
    ("gift", "recipient", r"(?:by whom )?(?:donated|given|presented) to|gift to"),
    ("gift", "donor", r"(?:donated|given|presented|dedicated) by|(?:donation|gift)(?: of| from| by)?|schenking(?: van)?"),
    ("exchange", None, r"(?:in )?exchanged? (?:by|with|between|for)"),
    ("restitution", "recipient", r"restituted to|returned to|redeemed by|restituted|retrieved by"),
    ("deposit", None, r"on deposit(?: at| in| with)?|stored(?: at| in)?|deposited(?: at| in| with)?|installed(?: at| in)?|placed(?: at| in)?|buried(?: at| in)?"),
    ("inventory", "deceased", r"(?:estate|probate) inventory(?: of)?,?"),
    ("collection", "dealer", r"with (?:an? |the )?(?:art )?dealer"),
    ("collection", "collector", r"collection(?: of)?|ex\.? coll\.?|(?:first )?(?:recorded|mentioned|documented|noted)(?: in| at| by)?"),
    ("by_descent", "heir", r"by descent(?: to)?|inherited by|from the heirs of"),
    ("inheritance", "heir", r"(?:by|through) inheritance(?: to)?"),
    ("sale", "seller", r"from (?:whom|the dealer|the artist)(?: to)?"),
]
#: Signs of a type anywhere in a segment that no opening fits.
SIGNS = [
    ("sale", r"\b(?:unsold|bought in|withdrawn|sold|purchased|sale)\b"), ("commission", r"\bcommissioned\b"), ("theft", r"\bstolen\b"), ("looting", r"\blooted\b"), ("confiscation", r"confiscat"),
    ("loan", r"\bon loan\b"), ("transfer", r"\btransfer"), ("bequest", r"beque(?:st|athed)"), ("exchange", r"\bexchange"), ("gift", r"\b(?:gift|donat|presented)"), ("by_descent", r"\bdescent\b"), ("collection", r"\bcollection\b"), ("deposit", r"\bstored\b"),
]
#: Months, and currencies by their sign in front of or behind an amount.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
BEFORE_AMOUNT = {"fl.": "guilders", "£": "pounds", "frs.": "francs", "$": "dollars", "€": "euros", "DM": "deutschmarks"}
AFTER_AMOUNT = {"livres": "livres", "napoléons": "napoléons", "guineas": "guineas", "florins": "florins", "francs": "francs", "guilders": "guilders", "pounds": "pounds"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def outside_brackets(text: Column) -> Column:
    """The pieces of a text between semicolons that stand in no bracket or quotation, however deep; a bracket that
    never closes holds nothing together."""

    def whole(t: Column) -> Column:
        n = lambda marks: F.length(t) - F.length(F.translate(t, marks, ""))
        return (n("([“") <= n(")]”")) & (n('"') % 2 == 0)

    def merged(at: Column, piece: Column) -> Column:
        joined = F.concat_ws(";", at["open"], piece)
        done = whole(joined)
        return F.struct(F.when(done, F.concat(at["done"], F.array(joined))).otherwise(at["done"]).alias("done"), F.when(~done, joined).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    held = F.aggregate(F.split(text, ";"), start, merged, lambda at: F.when(at["open"].isNull(), at["done"]).otherwise(F.concat(at["done"], F.split(at["open"], ";"))))
    return F.when(text.rlike(r'[(\[“"]'), held).otherwise(F.split(text, ";"))  # where nothing opens nothing is held together


def segments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sequence, raw_text, gap, citations): pieces between semicolons outside brackets, in order. Citations
    in braces are set aside; an ellipsis before or after a piece marks a gap."""
    clean = F.regexp_replace(F.col(text), r"<[^>]*>", "")
    mark = F.regexp_replace(clean, r"\{[^}]*\}", "\u0001")
    cited = F.regexp_extract_all(clean, F.lit(r"\{([^}]*)\}"), 1)
    pieces = outside_brackets(mark)
    out = rows.where(F.col(text).isNotNull()).select(key, pieces.alias("_all"), cited.alias("_cited")).select("*", F.posexplode("_all").alias("_i", "_t"))
    marks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\u0001"), F.lit("")))
    before = F.aggregate(F.slice("_all", F.lit(1), F.col("_i")), F.lit(0), lambda n, t: n + marks(t))
    out = out.withColumn("citations", F.when(F.size("_cited") == 0, F.col("_cited")).otherwise(F.slice("_cited", before + 1, F.greatest(marks(F.col("_t")), F.lit(0)))))
    bare = F.trim(F.regexp_replace(F.regexp_replace("_t", "\u0001", ""), r"^[\s.…]+|[\s.…]+$", " "))
    gap = F.col("_t").rlike(r"^\s*(?:…|\.\.\.)") | F.coalesce(F.get("_all", F.col("_i") - 1).rlike(r"(?:…|\.\.\.)[\s\u0001]*$"), F.lit(False))
    out = out.withColumn("gap", gap).withColumn("raw_text", bare).where("raw_text <> ''")
    return out.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy("_i"))).select(key, "sequence", "raw_text", "gap", "citations")


def dated(text: Column) -> Column:
    """struct(expression, year, qualifier): exact dates before qualified years, ranges, circa, months, bare years.
    A range has its rounded midpoint as year; life dates in brackets are no dates."""
    t = F.regexp_replace(text, r"\([^)]*\)", " ")
    year = lambda pattern, g: F.regexp_extract(t, pattern, g).try_cast("int")
    exact = rf"\b\d{{1,2}} (?:{MONTHS}) (\d{{4}})\b"
    qualified = r"(?i)\b(before|after|since|by|in) (\d{4})\b"
    ranged = r"\b(\d{4})\s*[-–/]\s*(\d{2,4})\b"
    circa, month, decade, bare = r"\bc(?:a|irca)?\.?\s*(\d{4})\b", rf"\b(?:{MONTHS}) (\d{{4}})\b", r"\b(\d{3}0)s\b", r"\b(1[0-9]{3}|20[0-9]{2})\b"
    tail = F.regexp_extract(t, ranged, 2)
    end = F.when(F.length(tail) == 2, F.concat(F.substring(F.regexp_extract(t, ranged, 1), 1, 2), tail)).otherwise(tail).try_cast("int")
    made = lambda p, y, q: F.struct(found(t, p).alias("expression"), y.alias("year"), q.alias("qualifier"))
    none = F.lit(None).cast("string")
    word = F.lower(F.regexp_extract(t, qualified, 1))
    return (
        F.when(t.rlike(exact), made(exact, year(exact, 1), none))
        .when(t.rlike(ranged), made(ranged, F.round((year(ranged, 1) + end) / 2).cast("int"), none))
        .when(t.rlike(qualified), made(qualified, year(qualified, 2), word))
        .when(t.rlike(circa), made(circa, year(circa, 1), F.lit("circa")))
        .when(t.rlike(month), made(month, year(month, 1), none))
        .when(t.rlike(decade), made(decade, year(decade, 1), F.lit("circa")))
        .when(t.rlike(bare), made(bare, year(bare, 1), none))
    )


def priced(text: Column) -> Column:
    """struct(amount, currency). Separators before three digits group thousands, others are decimal; 'fl. 10:5:-'
    counts twentieths."""
    number = r"(\d[\d.,]*(?::\d+)?)"
    out = F.lit(None).cast("struct<amount:double,currency:string>")

    def amount(raw: Column) -> Column:
        whole = F.split_part(raw, F.lit(":"), F.lit(1))
        plain = F.regexp_replace(F.regexp_replace(whole, r"[.,](?=\d{3}(?:\D|$))", ""), ",", ".")
        small = F.when(F.contains(raw, F.lit(":")), F.split_part(raw, F.lit(":"), F.lit(2)).try_cast("double"))
        return F.rtrim(plain, F.lit(".")).try_cast("double") + F.coalesce(small / 20, F.lit(0.0))

    rules = [(rf"\Q{sign}\E\s*{number}", name) for sign, name in BEFORE_AMOUNT.items()] + [(rf"(?iu){number}\s*{sign}\b", name) for sign, name in AFTER_AMOUNT.items()]
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), F.struct(amount(F.regexp_extract(text, pattern, 1)).alias("amount"), F.lit(name).alias("currency"))).otherwise(out)
    signs = "|".join([*(rf"\Q{sign}\E\s*\d" for sign in BEFORE_AMOUNT), rf"\d[\d.,:]*\s*(?:{'|'.join(AFTER_AMOUNT)})\b"])
    return F.when(text.rlike(f"(?iu){signs}"), out)


def apart(value: Column, f) -> Column:
    """``f`` of a value, in a lambda: its many branches stay out of the code generated for the row, which the JVM doesn't compile
    any more when it gets long."""
    return F.element_at(F.transform(F.array(value), f), 1)


def known_first(text: Column, rules: list[tuple[str, Column]], joined) -> Column:
    """The value of the first rule (pattern, value) whose pattern is in a text that has one of them, by halves: ``joined``
    makes one expression of several patterns, so a text meets as many as the logarithm of the rules."""
    if len(rules) == 1:
        return rules[0][1]
    left, right = rules[: len(rules) // 2], rules[len(rules) // 2 :]
    return F.when(text.rlike(joined([p for p, _ in left])), known_first(text, left, joined)).otherwise(known_first(text, right, joined))


def first_of(text: Column, rules: list[tuple[str, Column]], joined) -> Column:
    """The value of the first rule whose pattern is in a text, or null."""
    return F.when(text.rlike(joined([p for p, _ in rules])), known_first(text, rules, joined))


def position(role: Column, transfer: Column) -> Column:
    """sender, receiver or agent, from the role, a relative's role, or the transfer."""
    by_role = F.coalesce(lookup(POSITION, role), F.when(role.rlike(r"(?i)^(?:his|her|their)\s"), "receiver"))
    return F.when(role.isNotNull(), by_role).otherwise(F.when(transfer.isin(*RECEIVED), "receiver"))


def events(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per event: key, sequence, raw_text, gap, citations, transfer_type, transfer_category, uncertain,
    unsold, batch_price, parties (name, dates, uncertain, role, position), date_expression, date_year,
    date_qualifier, location, price_amount, price_currency, is_cross_ref, cross_ref_target. Null texts have none."""
    e = segments(rows, key, text)
    body = F.regexp_replace("raw_text", r"^\?\s*", "")
    e = e.withColumn("uncertain", F.col("raw_text").startswith("?")).withColumn("_b", body)
    kin = rf"(?i)^((?:his|her|their) (?:[\w'’-]+ ){{0,2}}?(?:{KIN}))\b,?"
    opens = lambda patterns: rf"(?i)^(?:{'|'.join(patterns)})(?=[\s,:]|$)"
    rule = lambda type_, role, cut: F.struct(F.lit(type_).alias("type"), F.lit(role).cast("string").alias("role"), cut.alias("cut"))

    def typed(b: Column) -> Column:
        widow = F.when(b.rlike(r"(?i)^\w+ widow(?:er)?\b"), "widowhood").otherwise("by_descent")
        relative = F.when(b.rlike(kin), F.struct(widow.alias("type"), F.lower(F.regexp_extract(b, kin, 1)).alias("role"), F.regexp_extract(b, kin, 0).alias("cut")))
        opened = first_of(b, [(p, rule(type_, role, F.regexp_extract(b, opens([p]), 0))) for type_, role, p in OPENINGS], opens)
        signed = first_of(b, [(p, rule(type_, None, F.lit(""))) for type_, p in SIGNS], lambda patterns: f"(?i){'|'.join(patterns)}")
        return F.coalesce(relative, opened, signed)

    e = e.withColumn("_m", apart(F.col("_b"), typed)).withColumn("transfer_type", F.coalesce("_m.type", F.lit("unknown")))
    rest = F.trim(F.substr("_b", F.coalesce(F.length("_m.cut"), F.lit(0)) + 1))  # what opens a segment goes
    e = e.withColumn("_rest", F.regexp_replace(rest, r"^[,:\s]+", ""))
    name = F.trim(F.regexp_replace(F.regexp_extract("_rest", r"^((?:[^,(]|\([^)]*\))*)", 1), r"\([^)]*\)", ""))
    e, name = e.withColumn("_said", name), F.col("_said")  # a column of its own is worked out once
    name = F.when(name.rlike(r"^(?:\d|[£$€]|fl\.|(?i:in|by|before|after|c\.|lot|no\.) ?\d|(?i:for|to the museum))") | (name == ""), None).otherwise(name)
    life = F.nullif(F.regexp_extract("_rest", r"^[^,]*?\(([^)]*\d{3,4}[^)]*)\)", 1), F.lit(""))
    receiver = found(F.col("_rest"), r"(?i)(?:^|[,\s])(?:by whom sold to|to) (the museum|[A-Z][^,(;]*)", 1)
    e = e.withColumn("_name", name)
    party = lambda n, d, r: F.struct(n.alias("name"), d.alias("dates"), F.col("uncertain").alias("uncertain"), r.alias("role"), position(r, F.col("transfer_type")).alias("position"))
    first = F.when(F.col("_name").isNotNull() & F.col("_m.role").isNotNull() & F.col("_m.role").isin("seller") & F.col("_name").rlike("(?i) to "), F.regexp_extract("_name", r"(?i)^(.*?) to ", 1)).otherwise(F.col("_name"))
    second = F.when((F.col("transfer_type") == "sale") & (F.col("_m.role") == "seller") & receiver.isNotNull(), F.trim(receiver))
    parties = F.array_compact(F.array(F.when(first.isNotNull(), party(first, life, F.col("_m.role"))), F.when(second.isNotNull(), party(second, F.lit(None).cast("string"), F.lit("buyer")))))
    place = found(F.regexp_replace("_rest", r"\([^)]*\)", ""), r"^[^,]+,\s*(\p{Lu}[\p{L}'’ .-]+?)\s*(?:,|$)", 1)
    e = e.withColumns({"_price": apart(F.col("_b"), priced), "_date": apart(F.col("_b"), dated), "_place": place})
    price, date, place = F.col("_price"), F.col("_date"), F.col("_place")
    cross = r"(?i)^(?:for (?:the )?provenance,? )?see (?:also )?(?:the )?(?:provenance of )?([\w.-]+(?:-[\w.]+)*)"
    return e.select(
        key, "sequence", "raw_text", "gap", "citations", "transfer_type", lookup(CATEGORY, F.col("transfer_type")).alias("transfer_category"), "uncertain",
        F.col("_b").rlike(r"(?i)\b(?:unsold|bought in|withdrawn|invendu|ingetrokken)\b").alias("unsold"), F.col("_b").rlike(r"(?i)\b(?:with \w+ others?|for the lot|en bloc)\b").alias("batch_price"),
        parties.alias("parties"), date["expression"].alias("date_expression"), date["year"].alias("date_year"), date["qualifier"].alias("date_qualifier"),
        F.when(~place.rlike(rf"^(?:{MONTHS})\b"), place).alias("location"), price["amount"].alias("price_amount"), price["currency"].alias("price_currency"),
        F.col("_b").rlike(cross).alias("is_cross_ref"), found(F.col("_b"), cross, 1).alias("cross_ref_target"),
    )


def bounds(expression: Column, year: Column, qualifier: Column) -> Column:
    """struct(earliest, latest, rule): the years that a date spans."""
    by, ranged = r"(?i)\bby\s+(\d{4})\b", r"^\s*(\d{4})\s*[-–/]\s*(\d{2,4})\b"
    start, tail = F.regexp_extract(expression, ranged, 1), F.regexp_extract(expression, ranged, 2)
    end = F.when(F.length(tail) == 2, F.concat(F.substring(start, 1, 2), tail)).otherwise(tail)
    none = F.lit(None).cast("int")
    made = lambda a, b, rule: F.struct(a.cast("int").alias("earliest"), b.cast("int").alias("latest"), F.lit(rule).alias("rule"))
    return (
        F.when(year.isNull() & F.coalesce(expression == "", F.lit(True)), made(none, none, "no_date"))
        .when(qualifier == "before", made(none, year, "before_year")).when(qualifier == "after", made(year, none, "after_year"))
        .when((qualifier == "circa") & year.isNotNull(), made(year - 10, year + 10, "circa_year"))
        .when(expression.rlike(by), made(none, F.regexp_extract(expression, by, 1).try_cast("int"), "by_year"))
        .when(expression.rlike(ranged), made(start.try_cast("int"), end.try_cast("int"), "year_range"))
        .when(year.isNotNull(), made(year, year, "exact_year")).otherwise(made(none, none, "unparsed"))
    )


def periods(chain: DataFrame, key: str, creation: DataFrame | None = None) -> DataFrame:
    """One row per period of ownership: key, sequence, owner, acquisition_from, acquisition_method, location,
    begin_year, begin_year_latest, end_year, derivation, uncertain, source_event. The end is the next event's
    earliest year, unless that event is a bare mention within the years of ``creation`` (key, earliest, latest)."""
    own = chain.where("not is_cross_ref").withColumn("_b", bounds(F.col("date_expression"), F.col("date_year"), F.col("date_qualifier")))
    own = own.join(creation.toDF(key, "_c0", "_c1"), key, "left") if creation is not None else own.withColumns({"_c0": F.lit(None).cast("int"), "_c1": F.lit(None).cast("int")})
    w = Window.partitionBy(key).orderBy("sequence")
    weak = F.col("transfer_type").isin("unknown", "collection") & ((F.size("parties") == 0) | ((F.size("parties") == 1) & F.col("parties")[0]["role"].isNull()))
    nxt = F.lead(F.struct(F.col("_b.earliest").alias("year"), weak.alias("weak"))).over(w)
    own = own.withColumn("_next", nxt).withColumn("_leak", F.coalesce(F.col("_next.weak") & F.col("_next.year").between(F.col("_c0"), F.col("_c1")), F.lit(False)))
    role = lambda *names: F.try_element_at(F.filter("parties", lambda p: p["role"].isin(*names)), F.lit(1))
    kin = F.try_element_at(F.filter("parties", lambda p: p["role"].rlike("heir|son|daughter|widow|nephew|husband")), F.lit(1))
    first, t = F.try_element_at("parties", F.lit(1)), F.col("transfer_type")
    owner = (
        F.when(t == "sale", F.coalesce(role("buyer"), role("seller")))
        .when(t.isin("bequest", "inheritance", "by_descent", "widowhood"), F.coalesce(kin, first))
        .when(t == "gift", F.coalesce(role("recipient"), F.when(role("donor").isNull(), first)))
        .when(t == "commission", F.coalesce(role("patron"), first)).when(t == "collection", F.coalesce(role("collector", "deceased"), first)).otherwise(first)
    )
    giver = F.when((t == "sale") & role("buyer").isNotNull(), role("seller")).when(t == "gift", role("donor"))
    end = F.when(~F.col("_leak"), F.col("_next.year"))
    rules = F.map_filter(F.create_map(F.lit("begin_year"), F.when(F.coalesce("_b.earliest", "_b.latest").isNotNull(), F.col("_b.rule")), F.lit("end_year"), F.when(end.isNotNull(), F.lit("inferred_from_next")), F.lit("location"), F.when(F.col("location").isNotNull(), F.lit("explicit"))), lambda k, v: v.isNotNull())
    return own.select(
        key, F.row_number().over(w).alias("sequence"), owner["name"].alias("owner_name"), owner["dates"].alias("owner_dates"), giver["name"].alias("acquisition_from"), t.alias("acquisition_method"), "location",
        F.col("_b.earliest").alias("begin_year"), F.col("_b.latest").alias("begin_year_latest"), end.alias("end_year"), rules.alias("derivation"), "uncertain", F.col("sequence").alias("source_event"),
    )


def chains(chain: DataFrame, key: str, condition: Column, without: Column | None = None) -> DataFrame:
    """Whole chains of the entities with an event on which the condition holds (and none on which ``without``
    does), each event with ``matched``."""
    own = Window.partitionBy(key)  # chains come parsed and in order by their keys, so they are read once
    some = lambda test: F.coalesce(F.bool_or(test).over(own), F.lit(False))
    out = chain.withColumns({"_hit": some(condition), "_non": F.lit(False) if without is None else some(without)})
    out = out.where(F.col(key).isNotNull() & F.col("_hit") & ~F.col("_non")).drop("_hit", "_non")
    return out.withColumn("matched", F.coalesce(condition, F.lit(False)))


def party_is(name: str) -> Column:
    """A condition on events: one party's name contains a text, any case."""
    return F.exists("parties", lambda p: F.contains(F.lower(p["name"]), F.lit(name.lower())))


def rollup(chain: DataFrame, key: str) -> DataFrame:
    """One row per chain: events, span of years, transfer types but unknown, first and last party, gap, price."""
    names = F.when(F.size("parties") > 0, F.struct("sequence", F.col("parties")[0]["name"].alias("name")))
    return chain.groupBy(key).agg(
        F.count("*").alias("n_events"), F.min("date_year").alias("first_year"), F.max("date_year").alias("last_year"),
        F.array_sort(F.collect_set(F.when(F.col("transfer_type") != "unknown", F.col("transfer_type")))).alias("transfer_types"),
        F.min(names)["name"].alias("first_owner"), F.max(names)["name"].alias("last_owner"), F.bool_or("gap").alias("has_gap"), F.bool_or(F.col("price_amount").isNotNull()).alias("has_price"),
    )


#: Credit lines in order: what they say about how the last owner got a work.
CREDITS = [
    ("bequest", r"bequest|bequeath|legaat|legacy"), ("gift", r"\bgift\b|donat|schenking|presented"), ("loan", r"on loan|bruikleen|long-term loan"), ("sale", r"purchase|aankoop|acquired with|bought"),
    ("exchange", r"exchange|ruil"), ("transfer", r"transfer|overgedragen"), ("recuperation", r"recuperat|restitut"), ("deposit", r"deposit"), ("commission", r"commission"),
]


def credited(text: Column) -> Column:
    """The transfer type that a credit line names first in the order of the rules; none: null."""
    return F.coalesce(*(F.when(text.rlike(rf"(?i){p}"), F.lit(t)) for t, p in CREDITS))


def with_credit_lines(chain: DataFrame, credits: DataFrame, key: str) -> DataFrame:
    """Events whose last or last but one of a chain is unknown take the type that the credit line (key,
    credit_line) names; adds ``inferred``."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sequence")))
    out = chain.withColumn("_back", back).join(credits.select(key, credited(F.col("credit_line")).alias("_credit")), key, "left")
    inferred = (F.col("transfer_type") == "unknown") & (F.col("_back") <= 2) & F.col("_credit").isNotNull()
    out = out.withColumn("inferred", F.coalesce(inferred, F.lit(False)))
    kind = F.when(F.col("inferred"), F.col("_credit")).otherwise(F.col("transfer_type"))
    return out.withColumn("transfer_type", kind).withColumn("transfer_category", lookup(CATEGORY, F.col("transfer_type"))).drop("_back", "_credit")


def split(chain: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Events replaced by parts: ``splits`` (key, content_hash, parts array of texts) names an event by the hash of
    its raw text; chains are numbered anew, other columns of a part are its event's."""
    named = splits.select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"), F.col("parts").alias("_parts"))
    out = chain.join(named, (F.col(key) == F.col("_k")) & (F.sha2("raw_text", 256) == F.col("_h")), "left")
    out = out.select(*chain.columns, F.posexplode(F.coalesce("_parts", F.array("raw_text"))).alias("_i", "_text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("sequence", "_i"))
    return out.withColumns({"_n": number, "raw_text": F.col("_text")}).withColumn("sequence", F.col("_n")).drop("_i", "_text", "_n")
