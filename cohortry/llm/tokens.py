"""Token ids of whole texts with a public word-level BPE vocabulary.

The vocabulary file splits a lower-cased text into runs of letters, single digits and runs of other signs, and
encodes each piece on its own; no piece spans white space. Words repeat, so a task keeps the ids of the words it
has met and only encodes new ones; texts with characters for which the splitting rule is not restated here go
through the tokenizers library as a whole. Both ways give the same ids (tests/llm/test_tokens.py).
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

# Ends a piece inside the merge table; texts that hold the character itself take the general way.
PIECE_END = "\x7f"
MAX_CACHED_WORDS = 250_000
MAX_CACHED_LENGTH = 48

# Printable ASCII, Latin-1 and Latin Extended-A: no character here is changed by NFC.
RESTATED = re.compile("[\t\n\r -~¡-ſ]*")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LETTERS = "a-zªµºß-öø-ÿĀ-ſ"
DIGITS = "0-9²³¹¼-¾"
PIECES = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")


def byte_of_sign() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for signs from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return signs | {chr(256 + k): b for k, b in enumerate(others)}


def merge_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings with their ids, which are their merge order too; the word end becomes ``PIECE_END``."""
    signs, end = byte_of_sign(), PIECE_END.encode()
    ranks = {}
    for token, number in vocabulary.items():
        word_end = token.endswith("</w>")
        text = token[: -len("</w>")] if word_end else token
        ranks[bytes(signs[c] for c in text) + (end if word_end else b"")] = number
    return ranks


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class WordCache(dict):
    """Packed ids of a word (a run without white space, in lower case), encoded when first met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        pieces = [word] if word.isalpha() else PIECES.findall(word)
        ids = packed(self.encode("".join([piece + PIECE_END for piece in pieces])))
        if len(word) <= MAX_CACHED_LENGTH:
            if len(self) >= MAX_CACHED_WORDS:  # bounded memory; the ids do not depend on it
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """``ids(text)``: the ids of a whole text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.specials = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        ranks = merge_ranks({k: v for k, v in vocabulary.items() if k not in self.specials})
        pieces = tiktoken.Encoding(
            "pieces", pat_str=f"[^{PIECE_END}]+{PIECE_END}", mergeable_ranks=ranks, special_tokens={}
        )
        self.cache = WordCache(pieces.encode_ordinary)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if RESTATED.fullmatch(text) and not any(s in text for s in self.specials):
            return b"".join(map(self.cache.__getitem__, text.lower().split()))
        return packed(self.whole.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """One encoder per Python worker, kept between its tasks."""
    return TextEncoder(path)
