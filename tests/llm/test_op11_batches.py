import glob

from tests.llm.corpus import SCHEMA
from vitrine.llm import align, shared, tokens


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).coalesce(1)


def test_a_stored_file_holds_few_rows_of_megabytes(spark, monkeypatch):
    """A reader of columns takes thousands of rows of a file at once: that filled an executor's memory."""
    monkeypatch.setattr(align, "ROWS", 1)
    found = []
    monkeypatch.setattr(align, "stored", lambda df, what, *more: found.append((what, shared.stored(df, what, *more))) or found[-1][1])
    assert align.align(table(spark, ["some words"] * 30)).count() == 30
    batches = dict(found)["aligned"]
    assert batches.count() == 30
    files = [f.removeprefix("file://").removeprefix("file:") for f in batches.inputFiles()]
    assert len(files) >= 30 // align.PER_FILE and all(glob.glob(f) for f in files)


def test_pieces_met_often_are_tokenised_once(spark):
    docs, paths = table(spark, ["alpha beta gamma"] * 5 + ["alpha delta", None, ""]), (tokens.default_path(), align.piece_path())
    with align.rows_at_once(spark, 1):
        often = align.met_often(align.texts_of(docs, "doc_id", "text"), *paths)
        assert often == ["alpha", "beta", "gamma"]
        rows = align.tokenised(docs, "doc_id", "text", *paths, often).collect()
    assert sum(len(r["few"]) + len(r["upto_a"]) for r in rows) == 1  # delta
    assert sorted(d["id"] for r in rows for d in r["docs"]) == [*range(8)]


def test_pieces_that_are_not_given_back_are_not_known(spark, monkeypatch):
    docs = ["a ▁b c"] * 3 + ["a c"] * 3
    known, row = align.grouped_once(spark, ["a", "▁b", "c"], tokens.default_path(), align.piece_path())
    assert known == ["a", "c"] and len(row.first()["known"]) == 2
    monkeypatch.setattr(align, "ROWS", 1)
    assert [r["n_a"] for r in align.align(table(spark, docs)).orderBy("doc_id").collect()] == [0, 0, 0, 2, 2, 2]


def test_a_row_a_batch_against_brute_force(spark, monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    from tests.llm.test_op11_align import TEXTS, brute

    a = Tokenizer.from_file(tokens.default_path())
    a.encode_special_tokens = True
    monkeypatch.setattr(align, "ROWS", 1)
    texts = TEXTS + TEXTS[::-1]
    wanted = brute((a, sentencepiece.SentencePieceProcessor(model_file=align.piece_path())), texts)
    assert [tuple(r)[1:] for r in align.align(table(spark, texts)).orderBy("doc_id").collect()] == wanted


def test_pieces_met_often_are_not_stored_by_batches(spark, monkeypatch):
    """Every batch stored the groups of all its pieces, and was read for them three times: that was most of the CPU."""
    monkeypatch.setattr(align, "ROWS", 1)
    found = {}
    monkeypatch.setattr(align, "stored", lambda df, what, *more: found.setdefault(what, shared.stored(df, what, *more)))
    rows = align.align(table(spark, ["alpha beta gamma"] * 5 + ["alpha delta"])).orderBy("doc_id").collect()
    assert [r["n_links"] > 0 for r in rows] == [True] * 6 and rows[0]["count_sum"] == rows[4]["count_sum"]
    held = [x for r in found["aligned"].collect() for c in r for x in c if isinstance(x, str)]
    assert len(held) == 1  # delta


def test_pieces_tokenised_together_have_their_own_tokens():
    made = align.both(tokens.default_path(), align.piece_path())
    pieces = ["alpha", "antionhare", "beta ", "gamma", " lead", "x" * 300, "1.\nAvec,", "a ▁b", "ends\n", "<|endoftext|>", "漢字", "tail  "] * 200
    at, (ids_a, n_a, ids_b, n_b) = made.tokenised(pieces)
    kept = [x for x in pieces if x != "a ▁b"]
    assert [i < 0 for i in at] == [x == "a ▁b" for x in pieces] and at.max() == len(kept) - 1
    one = {x: (made.a.encode(" " + x, add_special_tokens=False).ids, made.b.encode(x)) for x in set(kept)}
    for side, ids, n in ((0, ids_a, n_a), (1, ids_b, n_b)):
        assert ids.tolist() == [i for x in kept for i in one[x][side]] and n.tolist() == [len(one[x][side]) for x in kept]


def test_documents_name_their_own_pieces(spark):
    """All pieces of a document were filtered for them, and went through six lambdas each for the numbers added up."""
    docs, paths = table(spark, ["alpha beta", "alpha delta alpha", "beta delta", None]), (tokens.default_path(), align.piece_path())
    rows = align.tokenised(docs, "doc_id", "text", *paths, ["alpha", "beta"]).collect()
    assert [(d["pieces"], d["own"]) for r in rows for d in r["docs"]] == [([0, 1], []), ([0, 2, 0], [0]), ([1, 2], [0]), ([], [])]
    assert "BroadcastHashJoin [number" in align.align(docs)._jdf.queryExecution().executedPlan().toString()
