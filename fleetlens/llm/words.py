"""Words of whole texts as bytes, a piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _bytes(kept: range | tuple) -> bytes:
    """A table for bytes.translate: A-Z in lower case; of other ASCII, all but what is kept as a blank."""
    return bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or b in kept else 32 for b in range(256))


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ and terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ stand between blanks of a text so translated.
LETTERS = _bytes(tuple(range(97, 123)))
LETTERS_AND_DIGITS = _bytes((*range(48, 58), *range(97, 123)))


def binary(texts: pa.Array) -> pa.Array:
    """The UTF-8 of texts, not copied through Python strings."""
    return pc.cast(texts, pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def pieces(data: bytes, size: int = 1 << 18) -> Iterator[list[bytes]]:
    """Words of data between ASCII white space, some `size` bytes at a time, so that a very long text is not held as objects."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = cut if cut >= 0 else data.find(b" ", end)
            end = cut if cut >= 0 else len(data)
            end = max(end, at + 1)
        yield data[at:end].split()
        at = end


class Numbers(dict):
    """Words to numbers from 0, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out

    def of(self, data: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in pieces(data)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])
