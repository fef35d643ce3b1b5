"""Token ids of whole texts, by the vocabulary files of public tokenizers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

EOS = 1
PART = 100_000  # characters of a text that are merged at a time
#: A byte-level vocabulary never joins what stands before a space to a letter or digit after it.
BORDER = re.compile(r" (?=[^\W_])")
#: Byte-level vocabularies write bytes that don't show as characters from 256 on, in order.
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splits_at_spaces(told: dict) -> bool:
    """Whether a vocabulary (its file, read) is byte-level and splits texts at spaces before it merges."""
    split = told.get("pre_tokenizer") or {}
    return not told.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")


def merged_in_order(told: dict) -> bool:
    """Whether earlier merges make smaller ids, so that the ids alone tell which merge comes first."""
    vocab = told["model"]["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in told["model"]["merges"]]
    return all(a < b for a, b in zip(made, made[1:], strict=False))


def bytes_of_ids(made) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    back = {shown: bytes([byte]) for byte, shown in SHOWN.items()}
    return [b"".join(back.get(ord(c), bytes([ord(c) & 255])) for c in made.id_to_token(i) or "") for i in range(made.get_vocab_size())]


def merges(told: dict, known: dict[int, bytes]):
    """The ids of a text by the merges of a vocabulary whose ids tell which merge comes first; special tokens are plain text."""
    import public_tokenizers
    import tiktoken

    special = {t["id"] for t in told.get("added_tokens", ())}
    ranks = {x: i for i, x in known.items() if i not in special}
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, those that ``tokenizers`` gives by the vocabulary's file.

    Where the vocabulary splits texts at spaces before it merges and earlier merges have smaller ids, its own merges are
    run by ``tiktoken``, which keeps nothing between texts; longer texts go there in parts that end before a space
    and a letter or digit. All other texts, those with the strings of special tokens and longer runs without
    such a place go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_file(path)
        told = json.loads(self.made.to_str())
        self.special = [t["content"] for t in told.get("added_tokens", ())]
        self.fast = merges(told, {i: x for i, x in enumerate(bytes_of_ids(self.made)) if x}) if splits_at_spaces(told) and merged_in_order(told) else None

    def whole(self, text: str) -> list[int]:
        return self.made.encode(text, add_special_tokens=False).ids

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of up to ``PART`` characters, longer ones only where there is no place to cut."""
        at, last = 0, 0
        for border in BORDER.finditer(text):
            if border.start() - at > PART and last > at:
                yield text[at:last]
                at = last
            last = border.start()
        if len(text) - at > PART and last > at:
            yield text[at:last]
            at = last
        yield text[at:]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.whole(text), "<u4")
        if len(text) <= PART:
            return np.array(self.fast(text), "<u4")
        return np.concatenate([np.array(self.fast(x) if len(x) <= PART else self.whole(x), "<u4") for x in self.parts(text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ids_of(text: str | None, path: str) -> np.ndarray:
    """The ids of a text (null: none) and the closing id."""
    return np.append(encoder(path).ids(text), np.uint32(EOS)) if text else np.array([EOS], np.uint32)
