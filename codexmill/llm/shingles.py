"""Sets of five-word shingles, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from . import words

WORDS = 5
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]


def sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted distinct shingle hashes of each text, one after another; where each text's end).

    A text with fewer than five words has one element, for its whole sequence; one
    without words has none.
    """
    w = words.split(texts)
    h = words.hashes(w)
    many = len(h) - WORDS + 1
    if many > 0:
        sums = np.zeros(many, np.uint64)
        for k, step in enumerate(_STEPS):
            sums += h[k : k + many] * step
        whole = w.owner[:many] == w.owner[WORDS - 1 :]
        hashes, owner = words.mix(sums[whole]), w.owner[:many][whole]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.cumsum(w.counts) - w.counts
    for i in np.flatnonzero((w.counts > 0) & (w.counts < WORDS)).tolist():
        part = np.full(1, w.counts[i], np.uint64)
        for x in h[starts[i] : starts[i] + w.counts[i]]:
            part = part * _STEPS[1] + x
        hashes, owner = np.append(hashes, words.mix(part)), np.append(owner, i)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.cumsum(np.bincount(owner[new], minlength=len(texts)))
