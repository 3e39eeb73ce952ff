"""Token ids of whole texts, by the tokenizers library, with what it gave for a word kept for the next time.

Both kinds of tokenizer cut a text at spaces before they merge bytes, so the ids of a text are those of its
words in order. A word seen before costs one look-up; the library is asked for the others only. Texts in which
a space could matter otherwise (runs of spaces, special tokens) go to the library whole.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Words kept in a worker before it starts anew: bounds a worker's memory.
MOST_WORDS = 600_000


def _bytes_to_chars() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = ids = self.make(word)
        return ids


class Ids:
    """ids(text) -> little-endian unsigned 32-bit ids, as the library gives for the whole text without special tokens."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        import json

        with open(path) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        #: True: white space is dropped and case folded; False: a space leads the word that follows.
        self.drops_space = split is not None
        # The pattern of the byte-level step is part of that tokenizer's public definition.
        self.pieces = regex.compile(split or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        #: Characters for which folding case and composing are plain; words with others are the library's.
        self.plain = regex.compile(r"[\n\x21-\x7EÀ-ÖØ-öø-įĲ-ňŊ-ž]+").fullmatch
        self.chars = _bytes_to_chars()
        self.tokenize = self.library.model.tokenize
        self.piece = _Known(self._piece)
        self.first = _Known(self._word)
        self.later = self.first if self.drops_space else _Known(self._led)

    def _piece(self, piece: str) -> bytes:
        chars = piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join([self.chars[b] for b in piece.encode()])
        return array("I", [t.id for t in self.tokenize(chars)]).tobytes()

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if self.plain(word[1:] if word[0] == " " and not self.drops_space else word):
            piece = self.piece
            return b"".join([piece[p] for p in self.pieces(word.lower() if self.drops_space else word)])
        return self._library(word)

    def _led(self, word: str) -> bytes:
        """Of a word that a space leads. Letters, with one other sign behind them or none, are cut without the pattern."""
        if word.isascii():
            if word.isalpha():
                return array("I", [t.id for t in self.tokenize(self.chars[32] + word)]).tobytes()
            letters, sign = word[:-1], word[-1:]
            if letters.isalpha() and not sign.isspace():
                return self.later[letters] + self.piece[sign]
        elif (letters := word.rstrip(".,")).isalpha() and len(word) - len(letters) < 2 and self.plain(letters):
            led = self.piece[" " + letters]
            return led if len(letters) == len(word) else led + self.piece[word[-1]]
        return self._word(" " + word)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or any(s in text for s in self.special):
            return self._library(text)
        words = text.split(" ")
        if self.drops_space:
            return b"".join(map(self.first.__getitem__, words))
        head = self.first[words[0]]
        if not words[-1]:  # a space at the end stands alone
            return head + b"".join(map(self.later.__getitem__, words[1:-1])) + (self._library(" ") if len(words) > 1 else b"")
        return head + b"".join(map(self.later.__getitem__, words[1:]))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One for each worker process, kept between tasks."""
    return Ids(path)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
