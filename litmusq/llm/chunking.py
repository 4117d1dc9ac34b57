"""Content-defined chunking of normalised records, vectorised over a batch.

A record is the concatenation of its normalised fields.  A rolling polynomial
hash over the last ``WINDOW`` bytes decides where a chunk ends, so an edit
moves only the boundaries next to it.  Chunk digests are 64-bit polynomial
hashes taken from prefix sums, so no byte is visited from Python code.
"""

from __future__ import annotations

import numpy as np

#: Bytes the rolling hash looks at, and the mean number of bytes of a chunk.
WINDOW, MEAN_CHUNK = 6, 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0x100000001B3)


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser for 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def chunk_batch(texts: list[bytes], mean: int = MEAN_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts every text of a batch; gives (text index, digest, byte length) per chunk.

    An empty text has no chunk.  Chunks of a text follow each other without
    gaps, so their lengths add up to its length.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    total = int(sizes.sum())
    if total == 0:
        z = np.zeros(0, np.int64)
        return z, z.copy(), z.copy()
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        roll = np.zeros(total, np.uint64)
        power = np.uint64(1)
        for j in range(WINDOW):
            roll[j:] += b[: total - j] * power if j else b
            power = power * _ROLL
        cut = (mix64(roll) % np.uint64(mean)) == 0
        stops = np.cumsum(sizes[sizes > 0])
        begins = stops - sizes[sizes > 0]
        for j in range(WINDOW - 1):  # the window would reach into the text before
            cut[np.minimum(begins + j, stops - 1)] = False
        cut[stops - 1] = True  # a text ends its last chunk
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate(([0], ends[:-1]))
        # digest of [s, e) = (S(e) - S(s)) * base^-s with S the prefix sums of b[k] * base^k
        pw = np.full(total, _BASE, np.uint64)
        pw[0] = 1
        pw = np.multiply.accumulate(pw)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * pw, dtype=np.uint64)))
        inv = np.full(total, np.uint64(_inverse(int(_BASE))), np.uint64)
        inv[0] = 1
        inv = np.multiply.accumulate(inv)
        digest = mix64((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    owner = np.repeat(np.arange(len(texts)), sizes)[starts]
    return owner, digest.view(np.int64), (ends - starts).astype(np.int64)
