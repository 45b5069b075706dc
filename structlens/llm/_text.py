"""Word splitting and hashing shared by the text operators.

Words are maximal runs of characters other than U+0020 and U+0009-U+000D.
``bytes.split()`` cuts at exactly those six bytes, and none of them occurs
inside a multi-byte UTF-8 sequence, so splitting the encoded text is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
_CHUNK = 1 << 20


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty, lone surrogates survive."""
    return (text or "").encode("utf-8", "surrogatepass")


def words(data: bytes) -> list[bytes]:
    return data.split()


def word_chunks(data: bytes, chunk: int = _CHUNK) -> Iterator[list[bytes]]:
    """Words in order, in lists of bounded size; no word is cut."""
    if len(data) <= chunk:
        yield data.split()
        return
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + chunk)
        while end < n and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


def small(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class HashCache(dict):
    """word -> XXH64 with seed 42; forgets everything when it has grown too large."""

    limit = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, element by element."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Grams:
    """Polynomial hashes modulo 2**64 of all runs of k words, from word hashes."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._power = np.ones(1, np.uint64)
        self._back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._power) < n:
            size = max(n, 2 * len(self._power), 4096)
            for name, b in (("_power", self.base), ("_back", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self._power[: len(hashes)], out=out[1:])
        return out

    def runs(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """One hash for each start of a run of k words; empty if there are fewer words."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        p = self.prefix(hashes)
        return mix((p[k:] - p[:-k]) * self._back[:n])
