"""Personal data replaced by keyed surrogates, all in DataFrame functions.

Detection is one regular expression, its alternatives in order. A surrogate is a keyed function of what is
essential in an entity (its letters and digits in lower case), so every mention of one entity gets the same
surrogate, written in the format of the mention: digits for digits, letters for letters in the same case,
separators where they stood. What marks the kind stays: a country prefix, a key's prefix, an email's last
label, the label before a secret, a title. Card numbers stay valid, addresses stay addresses.

Names are found after a title or an introduction. Each of a name's words is an entity: given names follow the
title's gender, family names don't, both are made of syllables of the word's own script, and as words map to
different words, names map to different names. In a document that gives somebody a title, the words of that name
are replaced wherever they stand alone too.

Surrogates of all distinct entities are checked for collisions, with each other and with entities that
occur; whoever loses draws again, and names grow by a syllable with each draw, so draws end. Draws after the
first are few, and only documents that mention such entities meet them by a join; all other rows are rewritten
where they are read. Mentions are found twice: once for the entities, which are kept, and once to rewrite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import cut, spare, stored

KEY = "surrogate-key-1"
SMALL = 200_000  # documents with a later draw, or entities, up to which their table is broadcast
ROUNDS = 64

#: Titles by gender, what else introduces a name, and small words inside names.
MALE = "Mr|Sir|Herr|Herrn|Monsieur|Señor|Sr|Господин|Κύριος|Κύριο"
FEMALE = "Mrs|Ms|Miss|Lady|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Mx"
INTRODUCED = "[Mm]y name is|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo|[Мм]еня зовут"
PARTICLES = "van von de der den da di del dos la le".split()
#: Syllables by script (of others, single letters), and how given names end by gender.
SYLLABLES = {
    "latin": "ba den ker lo mar nis por ran sel tor va wen zil han gos fer".split(),
    "cyrillic": "ба ден кер ло мар нис пор ран сел тор ва вен зил хан гос фер".split(),
    "greek": "βα δεν κερ λο μαρ νισ πορ ραν σελ τορ ζα φεν χιλ θαν γοσ πελ".split(),
    "armenian": [chr(x) for x in range(0x561, 0x587)],
    "hebrew": [chr(x) for x in range(0x5D0, 0x5EB)],
    "arabic": [chr(x) for x in (*range(0x627, 0x63B), *range(0x641, 0x64B))],
    "devanagari": [chr(x) for x in range(0x915, 0x93A)],
    "georgian": [chr(x) for x in range(0x10D0, 0x10F1)],
    "hiragana": [chr(x) for x in range(0x304B, 0x3062)],
    "katakana": [chr(x) for x in range(0x30AB, 0x30C2)],
    "hangul": [chr(x) for x in range(0xAC00, 0xAC80)],
    "han": [chr(x) for x in range(0x4E00, 0x4E80)],
}
ENDINGS = {"latin": ("en", "a", "i"), "cyrillic": ("ен", "а", "и"), "greek": ("ος", "α", "ι")}

SECRET = "password|passwd|pwd|secret|token|api_key|apikey|api-key|access_key|access-key|client_secret|auth_token"
WORD = r"(?:\p{Lu}(?:\.|[\p{L}\p{M}]{1,40}(?:['’-][\p{L}\p{M}]{1,40}){0,3})|\p{Lo}{1,20}|\p{Lu}['’]\p{Lu}[\p{L}\p{M}]{1,40})"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kind, pattern, and what of a mention stays in front and behind. The first that matches wins; none starts inside a word.
KINDS = [
    ("secret", rf"(?=[apstc])(?:{SECRET})[\x22']?\s{{0,3}}[=:]\s{{0,3}}[\x22']?[A-Za-z0-9_/+.-]{{8,}}+", rf"^(?i:{SECRET})[\x22']?\s{{0,3}}[=:]\s{{0,3}}[\x22']?", ""),
    ("secret", rf"(?=[APSTCapstc])(?i:{SECRET})[\x22']?\s{{0,3}}[=:]\s{{0,3}}[\x22']?(?=[^\s0-9]*+[0-9])[A-Za-z0-9_/+.!#$%&*~-]{{6,}}+", rf"^(?i:{SECRET})[\x22']?\s{{0,3}}[=:]\s{{0,3}}[\x22']?", ""),
    ("key", r"(?=[Aegsx])(?:A[KS]IA[0-9A-Z]{16}\b|AIza[0-9A-Za-z_-]{35}|gh[oprsu]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|sk-[A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+)?)", "^(?:A[KS]IA|AIza|gh[oprsu]_|github_pat_|sk-|xox[abprs]-|eyJ)", ""),
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}\b", "", r"\.[A-Za-z]+$"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", "^[A-Z]{2}", ""),
    ("ip", rf"{OCTET}(?:\.{OCTET}){{3}}\b", "", ""),
    ("ipv6", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", "", ""),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b", r"^\+[0-9]{1,3}", ""),
    ("phone", r"(?:\([0-9]{3}\) ?[0-9]{3}[. -][0-9]{4}\b|[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}\b|0[0-9]{2,4}[ /-][0-9]{5,9}\b)", "", ""),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "", ""),
    ("card", r"(?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}\b|[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b)", "^[0-9]", ""),
    ("name", rf"(?=[A-Za-zΓ-Ωа-яА-Я])(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.?|{INTRODUCED}) {WORD}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{WORD}){{0,3}}", rf"^(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.?|{INTRODUCED}) ", ""),
]
ANY = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(f'(?:{pattern})' for _, pattern, _, _ in KINDS)})"
#: What every mention has some of: one of these characters, or one of these strings. Texts without are not searched.
SIGNS = "[0-9@=:]"
OPENINGS = [*f"{MALE}|{FEMALE}|{NEUTRAL}".split("|"), *"y name is|ch heiße|appelle|e llamo|еня зовут|sk-|github_pat_|gho_|ghp_|ghr_|ghs_|ghu_|xox|eyJ|AIza".split("|")]
#: Where letters begin or end.
BORDERS = r"(?<=[\p{L}\p{M}])(?![\p{L}\p{M}])|(?<![\p{L}\p{M}])(?=[\p{L}\p{M}])"
MENTION = ("e", "kind", "a", "m", "z")


def kind_of(e: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern, _, _ in reversed(KINDS):
        out = F.when(e.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def by_kind(kind: Column, each: dict[str, Column], other: Column) -> Column:
    for name, value in each.items():
        other = F.when(kind == name, value).otherwise(other)
    return other


def described(array: Column) -> Column:
    """Mentions (array of strings) as structs: the mention ``e``, its ``kind``, what stays in front (``a``) and
    behind (``z``), and what is replaced (``m``)."""
    fronts = {k: p for k, _, p, _ in KINDS if p and k != "phone"}
    backs = {k: p for k, _, _, p in KINDS if p}

    def part(x: Column, patterns: dict[str, str]) -> Column:
        own = {k: F.regexp_extract(x["e"], f"({p})", 1) for k, p in patterns.items()}
        if patterns is fronts:
            own["phone"] = F.regexp_extract(x["e"], r"(^\+[0-9]{1,3})", 1)
        return by_kind(x["kind"], own, F.lit(""))

    array = F.transform(array, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    array = F.transform(array, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), part(x, fronts).alias("a"), part(x, backs).alias("z")))
    m = lambda x: F.substr(x["e"], F.length(x["a"]) + 1, F.length(x["e"]) - F.length(x["a"]) - F.length(x["z"]))
    return F.transform(array, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["a"].alias("a"), m(x).alias("m"), x["z"].alias("z")))


def essence(kind: Column, m: Column) -> Column:
    return by_kind(kind, {"ip": m, "given": F.lower(m), "family": F.lower(m)}, F.lower(F.regexp_replace(m, "[^A-Za-z0-9]", "")))


def gender(title: Column) -> Column:
    return F.when(title.rlike(f"^(?:{MALE})\\b"), "m").when(title.rlike(f"^(?:{FEMALE})\\b"), "f").otherwise("n")


def parts(x: Column) -> Column:
    """What of a mention is replaced, each an entity of its own: (kind, g, a, m, entity). Of a name its words, of
    anything else one. Small words inside names and initials have no entity."""
    words = F.split(x["m"], " ")
    n = F.size(words)

    def word(w: Column, i: Column) -> Column:
        kind = F.when(i == n - 1, "family").otherwise("given")
        g = F.when(i == n - 1, "").otherwise(gender(x["a"]))
        entity = F.when(~w.isin(*PARTICLES) & ~w.rlike(r"^\p{Lu}\.$"), F.concat(kind, F.lit(":"), g, F.lit(":"), F.lower(w)))
        return F.struct(kind.alias("kind"), g.alias("g"), F.lit("").alias("a"), w.alias("m"), entity.alias("entity"))

    one = F.struct(x["kind"].alias("kind"), F.lit("").alias("g"), x["a"].alias("a"), x["m"].alias("m"), F.concat_ws(":", x["kind"], essence(x["kind"], x["m"])).alias("entity"))
    return F.when(x["kind"] == "name", F.transform(words, word)).otherwise(F.array(one))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    reversed_ = F.split(F.reverse(digits), "")
    doubled = F.transform(reversed_, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def hex_stream(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(h, F.sha2(h, 256), F.sha2(F.sha2(h, 256), 256), F.sha2(F.sha2(F.sha2(h, 256), 256), 256))


def byte(stream: Column, i: Column | int) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def like(text: Column, stream: Column) -> Column:
    """Letters and digits of ``text`` replaced in its format, the i-th of them by the stream's i-th byte."""

    def one(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(text, F.lit(1), i), "[^A-Za-z0-9]", ""))
        b = byte(stream, place)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(97 + b % 26)).when(c.rlike("[A-Z]"), F.char(65 + b % 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def hex_like(text: Column, stream: Column) -> Column:
    """As ``like``, for hexadecimal text."""
    one = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(byte(stream, i) % 16))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def named(w: Column, kind: Column, g: Column, stream: Column, draw: Column) -> Column:
    """A word of a name in the script and case of ``w``; given names end by gender. It grows with the draws."""
    def by_script(each: dict, other) -> Column:
        out = other
        for script, value in each.items():
            out = F.when(w.rlike(rf"\p{{Is{script.capitalize()}}}"), value).otherwise(out)
        return out

    arrays = {script: F.array(*(F.lit(x) for x in parts_)) for script, parts_ in SYLLABLES.items()}
    ends = {script: F.when(g == "m", of[0]).when(g == "f", of[1]).when(g == "n", of[2]).otherwise("") for script, of in ENDINGS.items()}
    many = F.least(F.when(kind == "family", 4).otherwise(3) + draw, F.lit(40))
    known = F.array(F.struct(by_script(arrays, arrays["latin"]).alias("array"), F.when(w.rlike("|".join(rf"\p{{Is{x.capitalize()}}}" for x in SYLLABLES if x not in ENDINGS)), "").otherwise(by_script(ends, ends["latin"])).alias("end")))
    number = lambda i: byte(stream, 2 * i) * 256 + byte(stream, 2 * i + 1)
    grown = lambda k: F.concat(F.array_join(F.transform(F.sequence(F.lit(1), many), lambda i: F.element_at(k["array"], number(i) % F.size(k["array"]) + 1)), ""), k["end"])

    def cased(o: Column) -> Column:
        o = F.when(w.contains("-"), F.concat(F.initcap(o), F.lit("-"), F.initcap(F.reverse(o)))).otherwise(F.initcap(o))
        return F.when((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1), F.upper(o)).otherwise(o)

    return F.element_at(F.transform(F.transform(known, grown), cased), 1)


def surrogate(x: Column, draw: Column, key: str) -> Column:
    """What stands for ``m`` of a part (``parts``). A number that only looks like a card stays."""
    entity, m, kind = F.coalesce(x["entity"], F.lit("")), x["m"], x["kind"]
    stream = lambda: hex_stream(F.lit(key), entity, draw.cast("string"))
    only = F.array(F.struct(stream().alias("s"), draw.alias("d")))

    def one(y: Column) -> Column:
        s, d = y["s"], y["d"]
        ip = F.concat_ws(".", byte(s, 0) % 223 + 1, byte(s, 1), byte(s, 2), byte(s, 3) % 254 + 1)
        email = F.concat(F.substr(hex_like(F.repeat(F.lit("a"), 40), s), F.lit(1), F.greatest(F.lit(0), d - 2)), like(m, s))
        secret = F.when(m.rlike("^[0-9a-f]{8,}$"), hex_like(m, s)).otherwise(like(m, s))
        word = F.when(m.isin(*PARTICLES), m).when(m.rlike(r"^\p{Lu}\.$"), like(m, hex_stream(F.lit(key), m))).otherwise(named(m, kind, x["g"], s, d))
        return by_kind(kind, {"ip": ip, "ipv6": hex_like(F.lower(m), s), "card": card(F.concat(x["a"], m), m, x["a"], s), "email": email, "secret": secret}, F.when(kind.isin("given", "family"), word).otherwise(like(m, s)))

    return F.element_at(F.transform(only, one), 1)


def card(e: Column, m: Column, a: Column, stream: Column) -> Column:
    """A valid number in the format of a valid number; any other number itself; ``m`` is ``e`` without its first digit ``a``."""
    drawn = like(F.substr(m, F.lit(1), F.length(m) - 1), stream)
    return F.when(luhn(F.regexp_replace(e, "[^0-9]", "")) == 0, F.concat(drawn, check_digit(F.concat(a, F.regexp_replace(drawn, "[^0-9]", ""))))).otherwise(m)


def check_digit(digits: Column) -> Column:
    return ((10 - luhn(F.concat(digits, F.lit("0")))) % 10).cast("string")


def mentions(text: Column) -> Column:
    """All mentions of a text in order; null: none."""
    hinted = reduce(Column.__or__, [text.contains(x) for x in OPENINGS], text.rlike(SIGNS))
    return F.when(hinted, F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))


def sized(side: DataFrame) -> DataFrame:
    """``side`` to be broadcast if it is counted and small; beyond that Spark shuffles both sides."""
    return F.broadcast(side) if side.count() <= SMALL else side


def drawn_anew(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (entity, draw, x) with ``own`` and ``as``, which tell them and their surrogates apart."""
    name = F.when(F.col("x.kind").isin("given", "family"), "name").otherwise(F.col("x.kind"))
    own = F.concat_ws(":", name, essence(F.col("x.kind"), F.col("x.m")))
    made = entities.withColumn("_s", surrogate(F.col("x"), F.col("draw"), key))
    return made.select("entity", "draw", "x", own.alias("own"), F.concat_ws(":", name, essence(F.col("x.kind"), F.col("_s"))).alias("as"))


def later_draws(found: DataFrame, key: str) -> DataFrame:
    """(entity, draw): entities whose first surrogate collides with another's, or with an entity that occurs.
    ``found``: rows with ``parts``."""
    each = found.select(F.explode("parts").alias("x")).where("x.entity is not null")
    each = each.where((F.col("x.kind") != "card") | (luhn(F.regexp_replace(F.concat("x.a", "x.m"), "[^0-9]", "")) == 0))
    own = each.groupBy("x.entity").agg(F.min("x").alias("x")).select("entity", F.lit(0).alias("draw"), "x")
    drawn = cut(drawn_anew(own, key))
    for _ in range(ROUNDS):
        taken = drawn.groupBy("as").agg(F.min("entity").alias("keeps"), F.count("*").alias("n")).where("n > 1")
        losers = drawn.join(taken, "as").where("entity <> keeps").select("entity")
        losers = cut(losers.unionByName(drawn.join(drawn.select(F.col("own").alias("as")).distinct(), "as", "left_semi").select("entity")).distinct())
        if losers.isEmpty():
            return drawn.where("draw > 0").select("entity", "draw")
        again = drawn.join(losers, "entity", "left_semi").select("entity", (F.col("draw") + 1).alias("draw"), "x")
        drawn = cut(drawn.join(losers, "entity", "left_anti").unionByName(drawn_anew(again, key)))
    raise RuntimeError(f"surrogates still collide after {ROUNDS} draws: an entity's format has no room left")


def words_of_names(found: Column, made: Column) -> Column:
    """Map of the words of titled names to their surrogates; each word once."""
    named = F.filter(F.zip_with(found, made, lambda x, m: F.struct(x["kind"].alias("kind"), x["m"].alias("m"), F.substr(m, F.length(x["a"]) + 1, F.length(m)).alias("s"))), lambda x: x["kind"] == "name")
    pairs = F.flatten(F.transform(named, lambda x: F.arrays_zip(F.split(x["m"], " ").alias("w"), F.split(x["s"], " ").alias("s"))))
    pairs = F.filter(pairs, lambda p: ~p["w"].isin(*PARTICLES) & (F.length(p["w"]) > 1) & ~p["w"].contains("."))
    words = F.array_distinct(F.transform(pairs, lambda p: p["w"]))
    return F.transform(words, lambda w: F.struct(w.alias("w"), F.element_at(F.filter(pairs, lambda p: p["w"] == w), 1)["s"].alias("s")))


def without_names(gap: Column, words: Column) -> Column:
    """A stretch between mentions with the words (array of w, s) replaced where they stand alone."""
    joint = F.aggregate(F.filter(words, lambda x: x["w"].rlike("['’-]")), gap, lambda g, x: F.replace(g, x["w"], x["s"]))
    known = F.map_from_entries(F.filter(words, lambda x: ~x["w"].rlike("['’-]")))
    return F.array_join(F.transform(F.split(joint, BORDERS), lambda t: F.coalesce(F.try_element_at(known, t), t)), "")


def replace(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, their texts with surrogates for personal data, and ``n_replaced``,
    the mentions that were replaced (words of a name that stand alone not counted).

    Null and empty texts stay as they are, with no replacement. Null ids and repeated ids or rows are
    rewritten like any others. A column ``n_replaced`` that was there before is overwritten; other columns
    may have any name. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    found_, made_, row_, draws_, names_ = (spare(docs, n) for n in ("_mentions", "_made", "_row", "_draws", "_names"))
    # no filter here: Spark would carry it, with all that makes the text, through every step before
    kept = docs.select(F.xxhash64(text).alias("row"), mentions(text).alias("e")).select("row", described(F.col("e")).alias("x"))
    kept = stored(kept.select("row", F.flatten(F.transform("x", parts)).alias("parts")), "mentions")
    draws = later_draws(kept, key)
    out = docs.withColumn(found_, described(mentions(text)))
    draw = lambda x: F.lit(0)
    if not draws.isEmpty():
        meets = kept.select("row", F.explode(F.array_distinct(F.transform("parts", lambda x: x["entity"]))).alias("entity")).join(sized(draws), "entity")
        of = cut(meets.groupBy(F.col("row").alias(row_)).agg(F.map_from_entries(F.collect_set(F.struct("entity", "draw"))).alias(draws_)))
        out = out.withColumn(row_, F.xxhash64(text)).join(sized(of), row_, "left")
        draw = lambda x: F.coalesce(F.try_element_at(F.col(draws_), x["entity"]), F.lit(0))
    one = lambda x: F.concat(x["a"], F.array_join(F.transform(parts(x), lambda y: surrogate(y, draw(y), key)), " "), x["z"])
    out = out.withColumn(made_, F.when(F.size(found_) > 0, F.transform(found_, one)))
    out = out.withColumn(names_, F.when(F.exists(found_, lambda x: x["kind"] == "name"), words_of_names(F.col(found_), F.col(made_))))
    gaps = F.split(text, ANY, -1)
    gaps = F.when(F.col(names_).isNull(), gaps).otherwise(F.transform(gaps, lambda g: without_names(g, F.col(names_))))
    joined = F.array_join(F.zip_with(gaps, F.col(made_), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    changed = F.zip_with(F.col(found_), F.col(made_), lambda x, m: F.when(x["e"] != m, F.lit(1)).otherwise(F.lit(0)))
    out = out.withColumn("n_replaced", F.coalesce(F.aggregate(changed, F.lit(0), lambda n, x: n + x), F.lit(0)))
    return out.withColumn(text_col, F.when(F.col(made_).isNull(), text).otherwise(joined)).drop(found_, made_, row_, draws_, names_)
