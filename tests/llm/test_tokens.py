import random

import pytest

from vitrine.llm import tokens


@pytest.fixture(scope="module")
def made():
    return tokens.Encoder(tokens.default_path())


def test_parts_of_long_texts_give_the_ids_of_the_whole(made, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 10)
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(" \n\t  ab1é漢🙂'.,-_s\u0085　٣") for _ in range(rng.randrange(1, 60)))
        parts = list(made.parts(text))
        assert "".join(parts) == text
        assert all(len(p) <= 10 or not tokens.BORDER.search(p, 1) for p in parts)
        assert made.ids(text).tolist() == made.whole(text)


def test_texts_go_through_the_merges_whole(made, monkeypatch):
    """Not word by word, which cost over half of the time; only texts that merges alone can't tell go to tokenizers."""
    asked = []
    monkeypatch.setattr(made, "whole", lambda text: asked.append(text) or [7])
    assert len(made.ids("some words, and don't 12 more  of\n them")) > 5 and asked == []
    assert made.ids("a <|endoftext|> b").tolist() == [7] and len(asked) == 1
    assert made.ids("x" * (tokens.PART + 1)).tolist() == [7] and len(asked) == 2
