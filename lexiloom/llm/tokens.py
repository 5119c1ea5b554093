"""Byte-level BPE identifiers of whole texts, with a cache of words.

The vocabulary is a public ``tokenizers`` file. A boundary before a space that a
non-space follows, and around a single line feed between non-spaces, is one that
the vocabulary's own splitting rule always makes, so a text can be coded word by
word; words repeat, and their identifiers come from a cache. Texts with other
white space are coded in one piece. With ``added_tokens``, as the packing asks,
those of the file are told first, as the library does by default, and what stands
between them is coded by itself; without, they are coded like other text. The
tests hold the identifiers against the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Fixed value: the splitting rule of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(others)}


class _Irregular(Exception):
    pass


class _Words(dict):
    """Word to its identifiers as packed unsigned 32-bit integers."""

    def __init__(self, encode, prefix: str, most: int):
        super().__init__()
        self.encode, self.prefix, self.most = encode, prefix, most
        self.marks = {mark: array("I", encode(mark)).tobytes() for mark in ".,"}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Irregular
        # a letter ends its token where one of these marks follows
        if word[-1] in ".," and len(word) > 1 and word[-2].isalpha():
            packed = self[word[:-1]] + self.marks[word[-1]]
        else:
            packed = array("I", self.encode(self.prefix + word)).tobytes()
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed


class TokenCoder:
    """``coder(text)`` gives the identifiers of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached_words: int = 300_000, added_tokens: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_of_char()
        added = spec.get("added_tokens", ())
        for t in added if added_tokens else ():
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or (t.get("normalized") and spec.get("normalizer")):
                raise ValueError(f"added token {t['content']!r} is matched in a way that isn't supported")
        special = {t["content"] for t in added}
        # the leftmost one, and of several there the longest
        found = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        self._added = re.compile(f"({found})") if added_tokens and found else None
        self._added_ids = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self._first = _Words(self._encode, "", cached_words // 4)
        self._rest = _Words(self._encode, " ", cached_words)
        self._feed = array("I", self._encode("\n")).tobytes()

    def __call__(self, text: str) -> bytes:
        if self._added is None or self._added.search(text) is None:
            return self._plain(text)
        # parts at odd places are added tokens
        return b"".join(self._added_ids[x] if i % 2 else self._plain(x) for i, x in enumerate(self._added.split(text)))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            return self._feed.join(map(self._line, text.split("\n")))
        except _Irregular:
            return array("I", self._encode(text)).tobytes()

    def _line(self, line: str) -> bytes:
        words = line.split(" ")
        if not line or line[-1].isspace():
            raise _Irregular
        first = self._first[words[0]]
        return first + b"".join(map(self._rest.__getitem__, words[1:])) if len(words) > 1 else first


@lru_cache(maxsize=2)
def coder(path: str) -> TokenCoder:
    """One coder per worker process."""
    return TokenCoder(path, added_tokens=True)
