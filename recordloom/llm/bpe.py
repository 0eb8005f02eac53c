"""A public BPE tokenizer file, shared by token counting and encoding.

Pre-tokens are split with a compiled pattern. Below U+0250 its character classes are fixed; for a
text with characters beyond, the classes are taken once for each worker from the tokenizers library
itself, so that letters of newer Unicode versions fall where the library puts them.
"""

from __future__ import annotations

import functools
import json
import re

#: Character classes below U+0250.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = " \t-\r\x85\xa0"
#: White space of Unicode from U+0250 on.
MORE_SPACES = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: From this code point on no character is a letter, a number or a space.
UNUSED_FROM = 0x40000
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_level_pattern(letters: str, numbers: str, spaces: str) -> re.Pattern:
    return re.compile(
        f"{_CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


def word_pattern(letters: str, numbers: str, spaces: str) -> re.Pattern:
    return re.compile(f"{_CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


_BEYOND = re.compile("[^\x00-ɏ]")
#: Longer pre-tokens are not worth remembering.
MEMO_LENGTH = 64


def beyond(text: str) -> bool:
    """Whether the text has a character the compiled patterns do not cover."""
    return not text.isascii() and _BEYOND.search(text) is not None


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return [chr(b) if b in kept else chr(256 + moved.index(b)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and added tokens of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: The library's tokenizer; its model merges single pre-tokens.
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.added).items()}
        #: First characters of the added tokens: a text without them holds none.
        self.openers = {t[0] for t in self.added}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.written = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})

    def merge(self, piece: str) -> list[int]:
        """The ids of one pre-token, by its merges."""
        return [t.id for t in self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.written))]

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at added tokens: (string, whether it is one of them)."""
        if not any(first in text for first in self.openers):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False)] * (m.start() > at) + [(m[0], True)]
            at = m.end()
        return out + [(text[at:], False)] * (at < len(text))

    def pattern(self, text: str) -> re.Pattern:
        """The pattern that splits this text into pre-tokens."""
        return self._wide if beyond(text) else self._narrow

    @property
    def _make(self):
        return word_pattern if self.suffix else byte_level_pattern

    @functools.cached_property
    def _narrow(self) -> re.Pattern:
        return self._make(LETTERS, NUMBERS, SPACES)

    @functools.cached_property
    def _wide(self) -> re.Pattern:
        points = [c for c in range(0x250, UNUSED_FROM) if not 0xD800 <= c < 0xE000]
        joined = {}
        for first in "x!":  # a letter goes on from x, a sign goes on from !
            probe = "".join(f"{first}{chr(c)}\n" for c in points)
            joined[first] = {a // 3 for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe) if a % 3 == 0 and b == a + 2}
        spaces = re.compile(f"[{MORE_SPACES}]")
        letters = [c for i, c in enumerate(points) if i in joined["x"]]
        numbers = [c for i, c in enumerate(points) if i not in joined["x"] and i not in joined["!"] and not spaces.match(chr(c))]
        return self._make(LETTERS + _ranges(letters), NUMBERS + _ranges(numbers), SPACES + MORE_SPACES)


def _ranges(points: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One copy of a tokenizer for each Python worker."""
    return Bpe(path)
