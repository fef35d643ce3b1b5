import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import CLASH, SCHEMA, no_documents, odd_documents, prose
from vitrine.llm import align, queries, tokens


@pytest.fixture(scope="module")
def made():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokens.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.piece_path())


def shown_bytes():
    """Byte of each character of a byte-level vocabulary, by the published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def groups_of(made, text):
    """[(a ids, b ids)] by two sweeps over whole texts."""
    if not text:
        return []
    a, b = made
    back = shown_bytes()
    ta = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
        return []
    ends = []
    for side in (ta, tb):
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((i, at))
        ends.append(out)
    cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
    found, before = [], 0
    for c in cuts:
        found.append(tuple([i for i, e in side if before < e <= c] for side in ends))
        before = c
    return found


def brute(made, texts):
    groups = [groups_of(made, t) for t in texts]
    df = Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in df.items():
        most[x] = max(most[x], n)
    out = []
    for g in groups:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(df[p] == most[p[0]] for p in links), sum(df[p] for p in links), text))
    return out


TEXTS = [
    "The quick  brown fox\n\njumps over 12,345 lazy dogs!", "naïve café — 漢字かな 🙂🙂 éé", "<|endoftext|> and </s> and <s> <0x41>", "a▁b", " leading", "trailing ", "x" * 3000, " " * 500, "\t\r\n", "ab" * 400 + " ab",
    "don't DON'T it's   'll", "def f(x):\n    return x\n\n\n", "aaa aaa aaa aaa", "nul\x00byte ​ zero ﻿", "é é ﬁ ² Ǆ", "=" * 777 + "- " * 33, "привет мир", "مرحبا", "1 2 3 4", "http://a.b/c?d=e&f=%20", None, "",
]


def found(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = align.align(docs, **more).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in rows]


def test_against_brute_force(spark, made):
    rng = random.Random(5)
    letters = "abcdeé .,'1 漢\n🙂A "
    texts = TEXTS + [prose(rng, rng.randrange(1, 60)) for _ in range(40)] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    wanted = brute(made, texts)
    assert found(spark, texts) == wanted
    assert sum(w[2] > 0 for w in wanted) > 100 and any(max((len(a) * len(b) for a, b in groups_of(made, t)), default=0) > 4 for t in texts)
    assert found(spark, texts, hot=20) == wanted  # most pairs come by the shuffle


def test_long_groups_don_t_give_all_their_pairs(spark, made):
    """A text whose tokens share few ends: millions of links from a few distinct pairs."""
    text = next(t for t in ("x" * 40_001, "xy" * 20_001, "=" * 40_003) if max(len(a) * len(b) for a, b in groups_of(made, t)) > 0)
    assert found(spark, [text, text]) == brute(made, [text, text])


def test_rows_and_columns(spark):
    docs = odd_documents(spark)
    rows = align.align(docs)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = rows.collect()
    assert len(got) == docs.count()
    assert [(r["n_a"], r["n_links"], r["groups"]) for r in got if r["doc_id"] in (1, 2)] == [(0, 0, "")] * 2
    twice = [tuple(r) for r in got if r["doc_id"] == 4]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0][6] == 2 * twice[0][4]
    assert align.align(no_documents(spark).withColumns({c: F.lit(1) for c in CLASH})).count() == 0


def test_query(spark, sf_dir, made):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    wanted = brute(made, [d["text"] for d in docs])
    rows = queries.queries()["op11_alignment"](spark, sf_dir).orderBy("doc_id")
    assert rows.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert [tuple(r) for r in rows.collect()] == [(d["doc_id"], *w[:6], sha(w[6])) for d, w in zip(docs, wanted, strict=True)]


def test_python_only_tokenises(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 0)], SCHEMA)
    made = align.grouped(align.tokenised(docs, "doc_id", "text", tokens.default_path(), align.piece_path()))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    after = align.align(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in after and "MapIn" not in after


def test_batches_don_t_matter(spark, made, monkeypatch):
    monkeypatch.setattr(align, "BATCH", 7)
    texts = [t for t in TEXTS if t] * 2
    assert found(spark, texts) == brute(made, texts)
