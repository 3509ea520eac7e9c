"""64-bit hashes of all words of many texts at once, with numpy.

A word's hash is a polynomial of its bytes modulo 2^64, and for words over LONG bytes one
modulo a prime beside it, as there are long words that no polynomial modulo a power of two
tells apart (the shortest ones have hundreds of letters).
"""

from __future__ import annotations

import numpy as np

#: An odd number and its inverse modulo 2^64: powers of it make hashes of all substrings comparable.
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
PIECE_BYTES = 1 << 18

#: Bytes from which a word has the second hash, its modulus, and a random number below it.
LONG, PRIME, BASE = 100, (1 << 31) - 1, 1_390_675_453

#: A-Z in lower case, and every blank as a space.
LOWER = bytes(b | 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_STEPS, _BACKS = powers(STEP, PIECE_BYTES), powers(BACK, PIECE_BYTES)


def second_hash(word: np.ndarray) -> int:
    """The bytes of a word as a polynomial modulo PRIME, a block at a time: a block's sum fits in 64 bits."""
    out, block = 0, 4096
    for at in range(0, len(word), block):
        part = word[at : at + block].astype(np.uint64) + np.uint64(1)
        out = (out * pow(BASE, len(part), PRIME) + int((part * _PRIMES[block - len(part) :]).sum(dtype=np.uint64))) % PRIME
    return out


#: Powers of BASE modulo PRIME, falling to 1.
_PRIMES = np.array([pow(BASE, i, PRIME) for i in range(4095, -1, -1)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of the texts in a row, A-Z in lower case, and the number of words of each text."""
    data = [t.encode().translate(LOWER) + b" " for t in texts]
    buffer = b"".join(data)
    doc_ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
    hashes, counts, at = [np.zeros(0, np.uint64)], np.zeros(len(data), np.int64), 0
    while at < len(buffer):
        end = min(at + PIECE_BYTES, len(buffer))
        if end < len(buffer):
            cut = buffer.rfind(b" ", at, end)
            end = (cut if cut >= 0 else buffer.find(b" ", end)) + 1
        raw = np.frombuffer(buffer, np.uint8, end - at, at)
        n = len(raw)
        steps, backs = (_STEPS[:n], _BACKS[:n]) if n <= PIECE_BYTES else (powers(STEP, n), powers(BACK, n))
        edge = np.diff(np.concatenate(([True], raw == 32, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * steps, dtype=np.uint64)])
        first = (prefix[ends] - prefix[starts]) * backs[starts]
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            first[i] ^= np.uint64(second_hash(raw[starts[i] : ends[i]]) * int(MIX) & (1 << 64) - 1)
        hashes.append(mixed(first))
        if len(starts):
            counts += np.bincount(np.searchsorted(doc_ends, starts + at, "right"), minlength=len(data))
        at = end
    return np.concatenate(hashes), counts
