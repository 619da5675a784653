"""Token ids of whole texts by the tokenizers library, with a word cache.

Both tokenizers cut a text into words before merging inside each word, so the
ids of a text are the joined ids of its words. For texts of plain Latin
characters the words are cut here and looked up; a word that is not in the
cache, and every text with any other character, goes to the library itself.
A text with the string of a special token goes to the library too, which gives
that string its own id, as it does by default.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įĲ-ňŊ-ž"
_NUMBER = "0-9²³¹¼-¾"
_CLITIC = "'s|'t|'re|'ve|'m|'ll|'d"
#: A character outside this set sends its text to the library.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-įĲ-ňŊ-ž]")
_BYTE_WORDS = re.compile(rf"{_CLITIC}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_LOWER_WORDS = re.compile(rf"{_CLITIC}|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
#: Words kept before the cache starts afresh (about 220 bytes each).
CACHE_WORDS = 700_000


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte, for ``str.translate``."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = (b for b in range(256) if b not in plain)
    return {b: chr(256 + k) for k, b in enumerate(shifted)}


_BYTE_LETTERS = _byte_letters()


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """``encode(text)`` gives a text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec.get("added_tokens") or []
        #: Strings of added tokens, looked for in texts as they are.
        self.special = [x["content"] for x in added]
        first, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        self.words, self.lower = None, False
        if any(x.get("normalized") for x in added):
            return  # matched in normalised texts, so every text goes to the library
        if first is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.words = _BYTE_WORDS
        elif first and [x.get("type") for x in first.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]:
            self.words, self.lower = _LOWER_WORDS, True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        pieces = self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))
        ids = self[word] = struct.pack(f"<{len(pieces)}I", *[x.id for x in pieces])
        return ids

    def encode(self, text: str) -> bytes:
        if self.words is None or _OTHER.search(text) or any(x in text for x in self.special):
            return self._whole(text)
        return b"".join(map(self.__getitem__, self.words.findall(text.lower() if self.lower else text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
