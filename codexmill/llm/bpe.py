"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is vectorised. Every code point is mapped to a class by an array; class
and look-ahead give one of a few symbols, and each symbol is a function on the states of a
small automaton. Since functions compose associatively, the state before every position is
found by a blocked scan over a table of compositions: blocks are reduced side by side, their
functions are scanned in the same way, and the states then run through all blocks at once.
State and symbol tell whether a token starts at a position.

The slices between starts become an Arrow array over the bytes of the text; its distinct
slices are looked up in a bounded cache, and those not found are merged pair by pair, side
by side in arrays. Offsets of documents and of token bytes are kept for decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are handled in chunks of about so many bytes; workers live on from stage to stage, and so does the memory of the largest.
CHUNK_BYTES = 1 << 20
#: The cache holds up to twice so many words: when the younger half is full, the older goes.
CACHE_WORDS = 160_000
#: Longer words are merged one by one with a heap.
WIDE = 48

#: Code points that count as white space (Unicode White_Space).
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Letters after an apostrophe that form a token with it.
SUFFIX_1, SUFFIX_2 = "stmd", ("re", "ve", "ll")

# Letters and numbers that Unicode 16 added, first and last of each range. The tokenizer libraries
# know them, while Python's own tables may be older.
ADDED_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
ADDED_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

LETTER, NUMBER, OTHER, APOS_1, APOS_2, SPACE_IN, SPACE_END, BLANK, EDGE = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_BLANK, TAKE_1, TAKE_2 = range(8)


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_IN of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = [unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)]
    kinds = np.array(kinds)
    out[kinds == "L"] = LETTER
    out[kinds == "N"] = NUMBER
    for kind, ranges in ((LETTER, ADDED_LETTERS), (NUMBER, ADDED_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[WHITE] = SPACE_IN
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a token starts at it."""
    joined = state == AFTER_BLANK
    if symbol == LETTER:
        if state in (TAKE_1, TAKE_2):
            return (FRESH if state == TAKE_1 else TAKE_1), False
        return IN_LETTERS, not (joined or state == IN_LETTERS)
    if symbol == NUMBER:
        return IN_NUMBERS, not (joined or state == IN_NUMBERS)
    if symbol in (OTHER, APOS_1, APOS_2):
        if joined or state == IN_OTHER:
            return IN_OTHER, False
        return {OTHER: IN_OTHER, APOS_1: TAKE_1, APOS_2: TAKE_2}[symbol], True
    if symbol == SPACE_IN:
        return IN_SPACE, state != IN_SPACE
    return {SPACE_END: FRESH, BLANK: AFTER_BLANK, EDGE: FRESH}[symbol], True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(compose, apply, starts): tables over the functions that symbols generate.

    Function s < 9 is that of symbol s. compose[f, g] is "f, then g"; apply[f, state]
    is a state; starts[state, symbol] tells token starts.
    """
    steps = [tuple(_step(q, s)[0] for q in range(8)) for s in range(9)]
    known = {f: i for i, f in reversed(list(enumerate(steps)))}
    table = list(steps)
    at = 0
    while at < len(table):
        for g in steps:
            f = tuple(g[q] for q in table[at])
            if f not in known:
                known[f] = len(table)
                table.append(f)
        at += 1
    compose = np.array([[known[tuple(g[q] for q in f)] for g in table] for f in table], np.uint8)
    starts = np.array([[_step(q, s)[1] for s in range(9)] for q in range(8)])
    return compose, np.array(table, np.uint8), starts


def scan(functions: np.ndarray, first: int = FRESH, width: int = 64) -> np.ndarray:
    """The state before each of the functions when they are applied one after another."""
    compose, apply, _ = automaton()
    n = len(functions)
    if n <= width:
        out = np.empty(n, np.uint8)
        for i, f in enumerate(functions.tolist()):
            out[i] = first
            first = apply[f, first]
        return out
    rows = -(-n // width)
    grid = np.full(rows * width, EDGE, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    whole = grid[0]
    for column in grid[1:]:
        whole = compose[whole, column]
    state = scan(whole, first, width)
    out = np.empty((width, rows), np.uint8)
    for j, column in enumerate(grid):
        out[j] = state
        state = apply[column, state]
    return out.T.reshape(-1)[:n]


def symbols(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The automaton's symbols of code points; ``edges`` are positions between texts."""
    sym = classes()[points]
    sym[edges] = EDGE
    white = sym == SPACE_IN
    last = white.copy()
    last[:-1] &= ~(white[1:] | (sym[1:] == EDGE))
    last[-1:] = False
    sym[last] = SPACE_END
    sym[last & (points == 32)] = BLANK
    at = np.flatnonzero(points == ord("'"))
    at = at[sym[at] == OTHER]
    padded = np.concatenate([points[-2:] * 0, points, [0, 0]])[2:]
    one, two = padded[at + 1], padded[at + 2]
    inside = np.concatenate([sym, np.array([EDGE, EDGE], np.uint8)])
    ok1, ok2 = inside[at + 1] == LETTER, inside[at + 2] == LETTER
    sym[at[ok1 & np.isin(one, [ord(c) for c in SUFFIX_1])]] = APOS_1
    pair = np.zeros(len(at), bool)
    for a, b in SUFFIX_2:
        pair |= (one == ord(a)) & (two == ord(b))
    sym[at[ok1 & ok2 & pair]] = APOS_2
    return sym


def words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word of all texts, end of each text in the index)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.cumsum(sizes + 1) - 1
    sym = symbols(points, edges)
    start = np.flatnonzero(automaton()[2][scan(sym), sym])
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) > len(points):
        width = (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000) + 1
        ends = np.cumsum(width, dtype=np.int64)
        offsets = (ends - width)[start]
    else:
        offsets = start
    offsets = np.append(offsets, len(data)).astype(np.int32)
    slices = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = slices.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    at = np.searchsorted(start, edges)
    keep = np.ones(len(index), bool)
    keep[at] = False
    return coded.dictionary, index[keep], at - np.arange(len(texts))


class Ranks:
    """A byte-level vocabulary: bytes of each id, and which adjacent pairs merge to which id."""

    def __init__(self, ids: dict[bytes, int], pairs: dict[int, int]) -> None:
        """``ids`` of tokens rise with their rank; ``pairs`` maps left id << 32 | right id to the id they merge to."""
        self.ids, self.pairs = ids, pairs
        tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            tokens[i] = token
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([self.ids[bytes([i])] for i in range(256)], np.int32)
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(self.pairs.values(), np.int32, len(keys))[order]

    @classmethod
    def read(cls, path: str) -> Ranks:
        """From lines of a token in base64 and its rank; any two tokens merge to a third that they make up."""
        with open(path, "rb") as lines:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pairs = {}
        for token, i in ids.items():
            for cut in range(1, len(token)):
                a, b = ids.get(token[:cut]), ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        return cls(ids, pairs)

    NONE = 1 << 30

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id (which is the rank) that pairs merge to, NONE where they don't."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], self.NONE)

    def merge_side_by_side(self, group: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words of at most ``width`` bytes, how many each has): the pair of least rank first, the leftmost of equals."""
        lengths = np.fromiter(map(len, group), np.int64, len(group))
        filled = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in group]), np.uint8).reshape(len(group), width)
        column = np.arange(width, dtype=np.int32)
        ids = np.full((len(group), width + 1), -1, np.int32)
        ids[:, :-1] = np.where(column < lengths[:, None], self.byte[filled], -1)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(group))
        out = ids.copy()
        while len(live):
            at = ranks.argmin(axis=1).astype(np.int32)
            rows = np.arange(len(live))
            best = ranks[rows, at]
            go = best < self.NONE
            if not go.all():
                out[live[~go]] = ids[~go]
                live, ids, ranks, at, best = live[go], ids[go], ranks[go], at[go], best[go]
                rows = np.arange(len(live))
                if not len(live):
                    break
            behind = column > at[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=behind)
            ids[:, -1] = -1
            ids[rows, at] = best
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=behind[:, :-1])
            ranks[:, -1] = self.NONE
            ranks[rows, at] = self.rank(best, ids[rows, at + 1])
            left = np.maximum(at - 1, 0)
            ranks[rows, left] = np.where(at > 0, self.rank(ids[rows, left], best), ranks[rows, left])
        some = out >= 0
        return out[some], some.sum(axis=1)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length, by a heap over a linked list."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := self.pairs.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := self.pairs.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_words(self, items: list[bytes]) -> list[bytes]:
        """Ids of words, each as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(items)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(items):
            whole = self.ids.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > WIDE:
                out[i] = self.merge_long(w).astype("<u4").tobytes()
            else:
                groups.setdefault((len(w) + 3) & ~3, []).append(i)
        for width, at in groups.items():
            ids, counts = self.merge_side_by_side([items[i] for i in at], width)
            data, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            for i, a, b in zip(at, [0, *ends], ends):
                out[i] = data[a:b]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all ids, where each id's bytes end)."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)], ends


class Coder:
    """Encodes texts by a function on distinct words, whose results are cached."""

    def __init__(self, encode_words: Callable[[list[bytes]], list[bytes]]) -> None:
        self.encode_words, self.known, self.older = encode_words, {}, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, where each text's ids end)."""
        distinct, index, ends = words(texts)
        items = distinct.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [w for w in items if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in older]
        known.update(zip(new, self.encode_words(new), strict=True))
        coded = [known[w] for w in items]
        flat = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts = (np.cumsum(sizes) - sizes)[index]
        sizes = sizes[index]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[ends]


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[Ranks, Coder]:
    """One per Python worker."""
    ranks = Ranks.read(path)
    return ranks, Coder(ranks.encode_words)


def chunks(batch: pa.RecordBatch, text_col: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), of about ``size`` bytes each; a longer text is a slice."""
    column = batch.column(batch.schema.get_field_index(text_col))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        piece = batch.slice(a, b - a)
        yield piece, ["" if x is None else x for x in piece.column(batch.schema.get_field_index(text_col)).to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, ids (array of int), n_tokens, ids_sha256, decoded_sha256.

    ``path`` is a file of ranks that all executors can read. A null text counts as
    empty and has no ids. Rows are encoded where they are read: no shuffle, and repeated
    rows, ties and null ids simply pass through. Other columns are not read. With
    ``with_ids`` false the ids themselves are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + "ids array<int>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, encoder = coder(path)
        for batch in batches:
            for piece, texts in chunks(batch, size=2 * CHUNK_BYTES):  # words repeat within a chunk
                ids, ends = encoder(texts)
                data, byte_ends = ranks.decode(ids)
                byte_ends = np.concatenate([[0], byte_ends])
                upto = [0, *ends.tolist()]
                sums, decoded = [], []
                for a, b in zip(upto, upto[1:]):
                    sums.append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(data[byte_ends[a] : byte_ends[b]].tobytes()).hexdigest())
                columns = {id_col: piece.column(0)}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32)))
                columns |= {"n_tokens": pa.array(np.diff(upto)), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``data`` (binary), the bytes that the ids stand for; null ids give no bytes."""
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _ = coder(path)
        for batch in batches:
            out = [ranks.decode(np.array(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "data": pa.array(out, pa.binary())})

    return coded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, data binary")
