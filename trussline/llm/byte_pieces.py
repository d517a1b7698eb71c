"""Byte-level BPE ids of whole texts through the tokenizers library, with a cache of the parts between spaces.

A pre-token of this vocabulary starts at a space before a non-space character, whatever comes before, so a text's ids are
those of its parts, cut at each space between two characters that aren't white space. Parts recur; only new ones are encoded.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

#: Where the public vocabulary lies; a parameter of every entry point.
BYTE_BPE_PATH = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r" (?<=\S )(?=\S)")
#: Characters whose classes are the same in every version of Unicode that the libraries bring; other parts go to the library whole.
SETTLED = re.compile(r"[\n -~\xa1-ӿ]*")
#: Entries of the caches, characters of its longest key, and how many misses of a full cache show that the text has changed.
CACHE_PARTS, CACHE_CHARS, STALE = 1 << 20, 48, 1 << 22


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself where it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Memory(dict):
    """Results of ``make`` by their argument, for short arguments. What comes first stays, as frequent parts come early; after ``STALE`` misses it starts anew."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.missed = make, entries, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.entries:
            if len(key) <= CACHE_CHARS:
                self[key] = value
        else:
            self.missed += 1
            if self.missed > STALE:
                self.clear()
                self.missed = 0
        return value


class BytePieces:
    """Ids of texts as packed little-endian integers of ``dtype``."""

    def __init__(self, path: str, plain_specials: bool, entries: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        specials = [] if plain_specials else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_special = re.compile("|".join(specials) or r"(?!)").search
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pattern = regex.compile(PATTERN)
        self.letters = dict(enumerate(byte_characters()))
        self.model = self.tokenizer.model
        # words behind a space are parts, so they are kept once
        self.words = Memory(self._word, entries // 8)
        self.parts = Memory(self._part, entries - entries // 8)

    def _word(self, word: str) -> bytes:
        letters = word.replace(" ", self.letters[0x20]) if word.isascii() and word[1:].isalpha() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def whole(self, text: str) -> bytes:
        """The library's own encoding, without a cache."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _ids(self, text: str) -> bytes:
        if not SETTLED.fullmatch(text) or self.has_special(text):
            return self.whole(text)
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.parts[text[1:]] if text[0] == " " else self.words[text]
        words = self.pattern.findall(text)
        if len(words[0]) > 1 and words[0][0] == " " and words[0][1:].isalpha():
            return self.parts[words[0][1:]] + b"".join(map(self.words.__getitem__, words[1:]))
        return b"".join(map(self.words.__getitem__, words))

    def _part(self, part: str) -> bytes:
        text = " " + part
        if part.isalpha() and SETTLED.fullmatch(part) and not self.has_special(text):
            return self._word(text)
        return self._ids(text)

    def encode(self, text: str) -> bytes:
        first, *rest = CUT.split(text)
        return self._ids(first) + b"".join(map(self.parts.__getitem__, rest)) if first else b""

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        back = {c: b for b, c in enumerate(byte_characters())}
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        return [bytes(back[c] for c in name) if all(c in back for c in name) else name.encode() for name in names]


@lru_cache(maxsize=2)
def byte_pieces(path: str, plain_specials: bool = False, entries: int = CACHE_PARTS) -> BytePieces:
    return BytePieces(path, plain_specials, entries)
