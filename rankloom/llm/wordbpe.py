"""Vocabulary files of word-level BPE tokenizers and the split of texts into pre-tokens.

The file format is the JSON of the tokenizers library: a normaliser (NFC, lower case), a
pattern that picks pre-tokens and drops white space, byte-level symbols and a merge list
whose words end in a suffix. Control strings of the file are found in the raw text first.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import regex

#: Fixed values of the format: the contractions and white space of its patterns.
CONTRACTIONS = r"'(?:s|t|re|ve|m|ll|d)"
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# no two alternatives but the last start alike, so the commonest may come first
_ASCII = re.compile(rf"[a-z]+|[0-9]|{CONTRACTIONS}|[^\sa-z0-9]+", re.ASCII)
_LATIN = re.compile(rf"[a-zß-öø-ÿ]+|[0-9]|{CONTRACTIONS}|[^\sa-zß-öø-ÿ0-9]+", re.ASCII)
#: Characters beyond ASCII and the letters of Latin-1.
OTHER = r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]"
_OTHER = re.compile(OTHER)
#: Parts words in ``split_words``; no pre-token has white space.
BREAK = "\n"
_ASCII_WORDS = re.compile(rf"{_ASCII.pattern}|{BREAK}", re.ASCII)
_LATIN_WORDS = re.compile(rf"{_LATIN.pattern}|{BREAK}", re.ASCII)
_BLANK = re.compile("[ \n]")
_ANY = regex.compile(rf"\p{{L}}+|\p{{N}}|{CONTRACTIONS}|[^{WHITE}\p{{L}}\p{{N}}]+")


@cache
def byte_symbols() -> tuple[str, ...]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text without control strings.

    Lower case is taken character by character (no final sigma). Texts of ASCII or plain
    Latin-1 letters are in NFC already and use a narrower pattern with equal results. Where
    a character's class, lower case or normal form is not the same here and in the
    tokenizers library (they know different versions of Unicode) the library splits the text.
    """
    pattern, normal = _split_by(text)
    return pattern.findall(normal) if pattern else _library_split(text)


def split_words(text: str) -> list[str]:
    """Pre-tokens of words without OTHER characters, parted by BREAK, with the breaks between them."""
    return (_ASCII_WORDS if text.isascii() else _LATIN_WORDS).findall(text.lower())


def each_pre_token(text: str) -> Iterator[str]:
    """``pre_tokens`` one at a time."""
    pattern, normal = _split_by(text)
    return (m.group() for m in pattern.finditer(normal)) if pattern else iter(_library_split(text))


def _split_by(text: str) -> tuple:
    if text.isascii():
        return _ASCII, text.lower()
    if not _OTHER.search(text):
        return _LATIN, text.lower()
    return (None, text) if _odd(text) else (_ANY, _normal(text))


def _normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@cache
def _library() -> tuple:
    from tokenizers import Regex, normalizers, pre_tokenizers

    pattern = rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+"
    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


def _library_split(text: str) -> list[str]:
    normaliser, split = _library()
    return [w for w, _ in split.pre_tokenize_str(normaliser.normalize_str(text))]


#: Characters that have been compared with the library, and those in which it differs.
_compared: set[str] = set()
_differing: set[str] = set()


def _odd(text: str) -> bool:
    """Whether the text has a character that the library treats in another way; each character beyond ASCII and Latin-1 letters is compared once."""
    chars = set(_OTHER.findall(text))
    new = chars - _compared
    if new:
        for c in new:
            sample = f"a{c}1{c}{c}!"
            if unicodedata.category(c) == "Cn" or _library_split(sample) != _ANY.findall(_normal(sample)):
                _differing.add(c)
        _compared.update(new)
    return not _differing.isdisjoint(chars)


def stretches(text: str, size: int) -> Iterator[str]:
    """The text in parts of at most ``size`` characters that start at white space; longer where there is none.

    Normalisation and the split do not look across the place before a blank or a newline.
    """
    if len(text) <= size:
        yield text
        return
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        if cut < 0:
            found = _BLANK.search(text, at + size)
            cut = found.start() if found else len(text)
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


class Vocabulary:
    """Tokens, merges and control strings of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.tokens) + 1
        strings = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self.start = os.path.commonprefix(strings)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at control strings: (part, whether it is one)."""
        if self._special is None or self.start not in text:
            return [(text, False)]
        return [(part, i % 2 == 1) for i, part in enumerate(self._special.split(text)) if part]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
