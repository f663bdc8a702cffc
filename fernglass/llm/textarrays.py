"""Whole texts as numpy byte arrays: words, rolling hashes, window minima.

Operators that must touch every byte work on Arrow's own buffers: the texts of
a batch lie end to end in one byte array with offsets, and everything below is
vectorised over it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_seeded = np.random.Generator(np.random.PCG64(20240229))
#: Polynomial hashes at two random points modulo the prime 2**31 - 1: two ranges of n bytes that differ meet with probability below (n / 2**31)**2.
PRIME = U((1 << 31) - 1)
POINTS = _seeded.integers(1 << 20, (1 << 31) - 2, 2)
BYTE_CODE = _seeded.integers(1, (1 << 31) - 2, (2, 256), dtype=np.uint64)
MIX1, MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * MIX1
    h = (h ^ (h >> U(33))) * MIX2
    return h ^ (h >> U(33))


def folded(x: np.ndarray) -> np.ndarray:
    """Congruent to x modulo PRIME and below 2**32, for x below 2**62."""
    return (x & PRIME) + (x >> U(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME, for x below 2**63."""
    x = folded(folded(x))
    x[x >= PRIME] -= PRIME
    return x


_powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _series(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    have = 1
    while have < size:  # the second half is the first times a power
        out[have : 2 * have] = reduced(out[:have] * U(pow(base, have, int(PRIME))))
        have *= 2
    return out


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of both points the powers 0..n-1 and the inverses of them."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = [(_series(int(p), size), _series(pow(int(p), -1, int(PRIME)), size)) for p in POINTS]
    return [(a[:n], b[:n]) for a, b in _powers[size]]


class Prefix:
    """Hashes of any byte ranges of ``data``: equal ranges have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.n, self.sums, self.down = len(data), [], []
        for code, (up, down) in zip(BYTE_CODE, powers(len(data) + 1)):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(folded(code[data] * up[:-1]), out=sums[1:])  # below 2**32 each
            self.sums.append(sums)
            self.down.append(down)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (reduced(folded(s[end] - s[start]) * d[start]) for s, d in zip(self.sums, self.down))
        return mix(one << U(31) | two)

    def grams(self, k: int) -> np.ndarray:
        """Of the k bytes from every position that has as many."""
        n = self.n
        if n < k:
            return np.zeros(0, np.uint64)
        one, two = (reduced(folded(s[k:] - s[: n - k + 1]) * d[: n - k + 1]) for s, d in zip(self.sums, self.down))
        return mix(one << U(31) | two)


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 19):
    """(first row, bytes, offsets) of consecutive rows; a chunk has ``most`` bytes or is one long text.

    A null is an empty text.  The offsets start at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        end = min(end, len(column))
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one more) for runs of bytes that are ``inside`` (not white space); none crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = ~SPACE[data] if inside is None else inside
    start, end = full[1:-1] & ~full[:-2], full[1:-1] & ~full[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = full[1:-1][inner]
    end[inner - 1] = full[1:-1][inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64) | U(1)


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): every text's k-word shingles in order; a text of fewer words has its whole sequence as one."""
    n = len(word_hash)
    counts = np.diff(first)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    padded = np.concatenate([word_hash, np.zeros(k, np.uint64)])
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += padded[j : j + n] * SHINGLE[j]
    h = mix(h)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(made)])
    within = np.arange(off[-1]) - np.repeat(off[:-1], made)
    at = np.repeat(first[:-1], made) + within
    out = h[at]
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        w = word_hash[first[t] : first[t + 1]]
        out[off[t]] = mix((w * SHINGLE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + U(len(w)))[0]
    return out, off


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of values[i:i+w] for every whole window."""
    n, have, out = len(values), 1, values
    if n < w:
        return values[:0]
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: n - w + 1], out[w - have : w - have + n - w + 1])
    return out
