"""Token ids of a byte-level BPE file, with a bounded memory of what was encoded before."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Entries of a memory; beyond it the memory starts anew. It only saves work.
MEMORY = 400_000

#: Splits a text before each space that follows something that isn't white space.
_DOUBTFUL = re.compile(r"[\s\x1c-\x1f] ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others as code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def engine(path: str):
    """An encoder of the file's vocabulary. Ids are in order of merging, so they are ranks; the file's own library is slower by a factor of four and gives the same ids (tests compare them)."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    to_byte = _byte_of_char()
    added = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str) -> list[str] | None:
    """The text cut before each space, or None where a cut could part a pre-token.

    Pre-tokens contain a space only as their first character, or in runs of white space. So cuts before
    single spaces never part one; texts with a space after other white space aren't cut.
    """
    if _DOUBTFUL.search(text):
        return None
    parts = text.split(" ")
    return [parts[0], *(" " + p for p in parts[1:])]


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        value = self[key] = self.make(key)
        return value


@lru_cache(maxsize=2)
def special_tokens(path: str) -> dict[str, int]:
    """Strings and ids of the file's special tokens."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"] if x["special"]}


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes.

    specials: whether strings of special tokens in a text become those tokens. By default they are ordinary text, so that no
    text can say where a document ends: the file's library does so with encode_special_tokens = True.
    """

    def __init__(self, path: str | None = None, specials: bool = False):
        self.encode = engine(path or default_path()).encode_ordinary
        self.memory = _Memory(self._whole)
        self.specials = special_tokens(path or default_path()) if specials else {}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest_first))) if self.specials else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def _ordinary(self, text: str) -> bytes:
        parts = chunks(text)
        if parts is None:
            return self._whole(text)
        memory = self.memory
        return b"".join([memory[p] for p in parts])

    def ids(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._ordinary(text[at : m.start()]), np.array([self.specials[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])


class Counter:
    """(characters, tokens) of each pre-token of a text, as an array of two columns. Strings of special tokens are ordinary text."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex

        self.pretokens = regex.compile(public_tokenizers.PATTERN).findall
        self.encode = engine(path or default_path()).encode_ordinary
        self.memory = _Memory(self._whole)

    def _whole(self, text: str) -> bytes:
        return np.array([(len(p), len(self.encode(p))) for p in self.pretokens(text)], dtype="<u4").tobytes()

    def counts(self, text: str) -> np.ndarray:
        parts = chunks(text)
        memory = self.memory
        raw = self._whole(text) if parts is None else b"".join([memory[p] for p in parts])
        return np.frombuffer(raw, dtype="<u4").reshape(-1, 2).astype(np.int64)
