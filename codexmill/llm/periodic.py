"""Periodic runs of words: maximal stretches that repeat a short sequence of words again and again.

Two suffixes of a text that share l words, d words apart, give a stretch of l + d words with period d. Classes of
suffixes are united in the order of falling length of their common prefix; the union-find keeps the positions of each
class in order, and only positions that become neighbours in it are looked at: a run of period q and length n shows up
once as such a pair, of its first word and the word q later, with n - q words in common.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Texts go through arrays of about so many words at a time; a longer text goes alone.
CHUNK = 400_000
#: Positions in one block of an ordered class.
BLOCK = 2048
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
SCHEMA = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Positions:
    """Ordered positions in blocks, so that an insertion moves one block only."""

    def __init__(self, first: int) -> None:
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def add(self, p: int) -> tuple[int, int]:
        """Put p in; its neighbours, or -1."""
        k = max(0, bisect_left(self.heads, p) - 1)
        block = self.blocks[k]
        i = bisect_left(block, p)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else -1
        block.insert(i, p)
        self.size += 1
        if not i:
            self.heads[k] = p
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads.insert(k + 1, block[BLOCK])
        return before, after


def suffix_ranks(x: np.ndarray) -> list[np.ndarray]:
    """Ranks of the prefixes of 1, 2, 4 ... words of every suffix, until all differ; x ends in a value of its own.

    A rank is the place of the first suffix with that prefix, so positions alone in their class keep it and drop out.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    sorted_x = x[order]
    new = np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int32 if n < 2**31 else np.int64)
    rank[order] = first
    levels, width = [rank], 1
    active = order[~(new & np.append(new[1:], True))]
    while len(active):
        after = np.minimum(active + width, n - 1)  # the last value is unique, so no class reaches beyond it
        key = rank[active].astype(np.int64) * n + rank[after]
        sort = np.argsort(key, kind="stable")
        active, key, old = active[sort], key[sort], rank[active][sort]
        at = np.arange(len(active))
        opens = np.concatenate([[True], key[1:] != key[:-1]])
        classes = np.concatenate([[True], old[1:] != old[:-1]])
        group = np.maximum.accumulate(np.where(opens, at, 0))
        rank = rank.copy()
        rank[active] = old + group - np.maximum.accumulate(np.where(classes, at, 0))
        levels.append(rank)
        width *= 2
        active = active[~(opens & np.append(opens[1:], True))]
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b have in common."""
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    last = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        total[same] += 1 << k
        a[same] = np.minimum(a[same] + (1 << k), last)
        b[same] = np.minimum(b[same] + (1 << k), last)
    return total


def runs(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an integer sequence that ends in a value of its own."""
    levels = suffix_ranks(x)
    shared = min(max((times - 1) * d, least - d) for d in range(1, least + 1))  # words that a run's first two periods share at least
    order = np.empty(len(x), np.int64)
    order[levels[-1]] = np.arange(len(x))
    width = min(shared.bit_length() - 1, len(levels) - 1)
    close = np.flatnonzero(levels[width][order[1:]] == levels[width][order[:-1]])
    lcp = common_prefixes(levels, order[close], order[close + 1])
    close, lcp = close[lcp >= shared], lcp[lcp >= shared]
    by_length = np.argsort(-lcp, kind="stable")
    values = x.tolist() if len(by_length) else []
    up: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    found = []

    def root(p: int) -> int:
        top = p
        while (above := up.get(top, top)) != top:
            top = above
        while p != top:
            up[p], p = top, up.get(p, top)
        return top

    for i, j, l in zip(order[close[by_length]].tolist(), order[close[by_length] + 1].tolist(), lcp[by_length].tolist()):
        a, b = root(i), root(j)
        large, small = classes.pop(a, None) or Positions(i), classes.pop(b, None) or Positions(j)
        if large.size < small.size:
            large, small = small, large
        inside = [p for block in small.blocks for p in block]
        later = -1
        for k in range(len(inside) - 1, -1, -1):  # from the right, so that what stands after p is there already
            p = inside[k]
            before, after = large.add(p)
            # neighbours of the other class only; another word of p's own class may still come between
            pairs = [(p, after)] if after not in (-1, later) else []
            if before > (inside[k - 1] if k else -1):
                pairs.append((before, p))
            later = p
            for s, e in pairs:
                d = e - s
                # a pair seeds a run if it overlaps enough and can't be moved to the left
                if l >= (times - 1) * d and l + d >= least and (s == 0 or values[s - 1] != values[e - 1]):
                    found.append((s, l + d, d))
        up[b] = a
        classes[a] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[list[bytes]], np.ndarray]]:
    """Words of some texts, and their numbers in one array in which each text ends in a number of its own."""
    words: list[list[bytes]] = []
    ids: list[int] = []
    base = 0
    for t in texts:
        own = (t or "").encode("utf-8", "surrogatepass").split()  # bytes split at 0x20 and 0x09 to 0x0D
        numbers: dict[bytes, int] = {}
        words.append(own)
        ids += [numbers.setdefault(w, base + len(numbers)) for w in own]
        base += len(numbers) + 1  # words of other texts have other numbers
        ids.append(base - 1)
        if len(ids) >= CHUNK:
            yield words, np.array(ids, np.int64)
            words, ids, base = [], [], 0
    if words:
        yield words, np.array(ids, np.int64)


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """Words joined by a space, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    drop = bytearray(len(words))
    for s, n, d in found:
        drop[s + d : s + n] = b"\1" * (n - d)
    return b" ".join(w for w, gone in zip(words, drop) if not gone)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start, then period), collapsed (the text without the repetitions).

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, compared as they are. A null text has none. A run has at
    least ``least`` words and ``times`` (2 or more) of its smallest period, and can't be extended. Other columns go;
    rows with equal or null ids are worked on one by one. No text is cut: it is one row, and so is its result.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    kind = docs.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType
    schema = f"id {kind.simpleString()}, n_words bigint, runs {RUN}, collapsed string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for words, ids in _chunks(batch.column(1).to_pylist()):
                ends = np.cumsum([len(w) + 1 for w in words])
                by_text: list[list] = [[] for _ in words]
                found = runs(ids, least, times)
                for (s, n, d), k in zip(found, np.searchsorted(ends, [r[0] for r in found], side="right").tolist()):
                    by_text[k].append((s - int(ends[k] - len(words[k]) - 1), n, d))
                columns = [
                    batch.column(0).slice(done, len(words)), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": d} for s, n, d in own] for own in by_text], SCHEMA),
                    pa.array([collapse(w, own).decode("utf-8", "surrogatepass") for w, own in zip(words, by_text)], pa.string()),
                ]
                done += len(words)
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
