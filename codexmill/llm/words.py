"""Words of many texts at once, as slices of one byte array, and their hashes.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. The hash of
any slice comes from one running sum: bytes times powers of an odd number, modulo 2^64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, each text ended by a newline
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray  # number of the text of each word
    counts: np.ndarray  # words in each text


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((ODD, INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split(texts: list[str]) -> Words:
    data = _LOWER[np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
    text_ends = np.cumsum(sizes + 1)
    upto = np.searchsorted(starts, text_ends)
    counts = np.diff(np.concatenate([[0], upto]))
    return Words(data, starts, ends, np.repeat(np.arange(len(texts)), counts), counts)


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = powers(len(w.data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * up[: len(w.data)])])
    return mix((total[w.ends] - total[w.starts]) * down[w.starts])
