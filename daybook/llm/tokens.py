"""Token ids of whole texts, by the tokenizers library.

The vocabulary's splits never join what white space parts, so a text's ids are those of its chunks in
order, and a chunk met before is not encoded again. The memory of chunks is bounded and lives as long as
the worker. Texts with white space that Python and the library see differently are encoded in one piece.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array

REMEMBERED = 600_000
LONGEST = 64
# White space to one of the two only, or so in some versions.
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
_TAIL = ".,;:!?&%$#*"
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class _Letters(dict):
    """Characters as the model spells their bytes."""

    def __init__(self, spell):
        self._spell = spell

    def __missing__(self, char: str) -> str:
        found = self[char] = self._spell(char)[0][0]
        return found


class Encoder(dict):
    """From a chunk to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._all = Tokenizer.from_file(path)
        self._model = self._all.model
        self.highest = max(self._all.get_vocab().values())
        self._letters = _Letters(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self._encode(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found

    def _encode(self, chunk: str) -> bytes:
        core = chunk.rstrip(_TAIL)
        if _PLAIN.fullmatch(core):
            if core != chunk:
                return self[core] + self[chunk[len(core):]]
            if (low := chunk.lower()) != chunk:
                return self[low]
            # Lower-case letters alone are one word to the model.
            word = chunk if chunk.isascii() else "".join(map(self._letters.__getitem__, chunk))
            return pack([token.id for token in self._model.tokenize(word)])
        return pack(self.whole(chunk))

    def whole(self, text: str) -> list[int]:
        return self._all.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> bytes:
        """Of a null text none."""
        if not text:
            return b""
        odd = any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text)
        if odd:
            return pack(self.whole(text))
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each vocabulary and worker."""
    return Encoder(path)
