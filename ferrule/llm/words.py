"""64-bit hashes of the words of texts, for whole batches at once.

A word is a run of bytes other than space and the five control characters from
tab on; A-Z count as a-z.  Its hash is that of its bytes, wherever it stands.

Results in odd cases: empty texts and texts of white space have no words; words
and texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes handled at once; a word is never cut.
CHUNK = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    def __init__(self):
        self.values = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.values[65:91] = self.values[97:123]
        self.white = np.zeros(256, bool)
        self.white[[32, *range(9, 14)]] = True
        self.up, self.down = powers(BASE, CHUNK), powers(INVERSE, CHUNK)

    def _chunk(self, raw: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        # where words begin and end
        edge = np.empty(n + 1, bool)
        edge[0], edge[n] = not white[0], not white[-1]
        np.not_equal(white[1:], white[:-1], out=edge[1:n])
        at = np.flatnonzero(edge)
        first, end = at[::2], at[1::2]
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[raw] * self.down[:n], dtype=np.uint64, out=sums[1:])
        return mix((sums[end] - sums[first]) * self.up[first]), first

    def placed(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, and where each begins."""
        raw, at, found, places = np.frombuffer(data, np.uint8), 0, [], []
        while at < len(raw):
            size = CHUNK
            part = raw[at : at + size]
            white = self.white[part]
            if at + size < len(raw):
                # up to the last white space, or, in a very long word, up to the next one
                while not white.any() and at + len(part) < len(raw):
                    size *= 2
                    part = raw[at : at + size]
                    white = self.white[part]
                if at + len(part) < len(raw):
                    keep = len(white) - int(white[::-1].argmax())
                    part, white = part[:keep], white[:keep]
            hashes, first = self._chunk(part, white)
            found.append(hashes)
            places.append(first + at)
            at += len(part)
        if not found:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(found), np.concatenate(places)

    def __call__(self, data: bytes) -> np.ndarray:
        return self.placed(data)[0]

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one after the other, and how many each text has."""
        hashes, places = self.placed(b"\n".join(texts))
        ends = np.cumsum([len(x) + 1 for x in texts])
        return hashes, np.diff(np.searchsorted(places, ends), prepend=0).astype(np.int64)

    def each(self, texts: list[bytes]) -> list[np.ndarray]:
        hashes, sizes = self.many(texts)
        return np.split(hashes, np.cumsum(sizes)[:-1]) if texts else []
