"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree.

A document longer than a sequence is cut at multiples of the sequence length; the full
pieces are sequences already, and the rest is an item like a short document. Items are dealt
at random into groups of about ``GROUP_ITEMS``, and each group is packed by itself: items by
falling length, each into the first bin that has room. A tournament tree, whose inner nodes
hold the largest room below them, finds that bin in a logarithmic number of steps.

Groups depend on nothing but a random draw, so neither a hot source nor a heap of copies
makes one group large, and work grows in proportion to the number of documents.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import materialize

LENGTH = 2048
END_ID = 1
GROUP_ITEMS = 8192


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_ranks(path: str) -> bpe.Ranks | None:
    """The merges of a tokenizer file if it is plain byte-level BPE whose ids rise with the merges, else None."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    letters = byte_alphabet()
    ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if set(token) <= letters.keys()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    vocab = model["vocab"]
    made = [vocab[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])) or not all(bytes([i]) in ids for i in range(256)):
        return None
    return bpe.Ranks(ids, {vocab[a] << 32 | vocab[b]: vocab[a + b] for a, b in merges})


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function on texts that gives (the ids of all of them, where each text's end); one per Python worker.

    Texts that hold a string which the tokenizer treats apart go to the library whole. So do the
    words of all others if the file is more than plain byte-level BPE; else they are merged side by side.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ranks = read_ranks(path)

    def by_library(items: list[bytes]) -> list[bytes]:
        coded = t.encode_batch_fast([w.decode("utf-8", "replace") for w in items], add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in coded]

    apart = [x.content for x in t.get_added_tokens_decoder().values()]
    coder = bpe.Coder(by_library if ranks is None else ranks.encode_words)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, text in enumerate(texts) if any(a in text for a in apart)]
        if not whole:
            return coder(texts)
        ids, ends = coder(["" if i in set(whole) else text for i, text in enumerate(texts)])
        out = np.split(ids, ends[:-1])
        for i in whole:
            out[i] = np.array(t.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return np.concatenate(out), np.cumsum([len(x) for x in out])

    return encode


def cut_up(ids: np.ndarray, ends: np.ndarray, length: int, end_id: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, crc32, tokens of the text) of the pieces of all texts, an end id after each text."""
    sizes = np.diff(ends, prepend=0) + 1
    flat = np.insert(ids, ends, end_id).astype("<u4")
    count = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
    size = np.minimum(length, sizes[row] - start)
    first = 4 * ((np.cumsum(sizes) - sizes)[row] + start)
    data = memoryview(flat).cast("B")
    crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * size).tolist())), np.int64, len(row))
    return row, start, size, crc, sizes[row]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every document's ids, cut at multiples of ``length``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("start", "length", "ids_crc32", "doc_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            for piece, texts in bpe.chunks(batch, size=2 * bpe.CHUNK_BYTES):
                row, *columns = cut_up(*encode(texts), length, end_id)
                longs = {n: pa.array(v.astype(np.int64)) for n, v in zip(names, columns, strict=True)}
                yield pa.RecordBatch.from_pydict({id_col: piece.column(0).take(pa.array(row, pa.int32()))} | longs)

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def first_fit(sizes: list[int], room: int) -> list[int]:
    """The bin of each item, items in the given order, each in the first bin with room for it."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    most = [room] * (2 * leaves)  # node i has children 2i and 2i+1; leaf i stands for bin i - leaves
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if most[node] < size:
                node += 1
        out.append(node - leaves)
        most[node] -= size
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            best = left if left >= right else right
            if most[node] == best:
                break
            most[node] = best
    return out


def pack(cut: DataFrame, id_col: str = "doc_id", length: int = LENGTH, group_items: int = GROUP_ITEMS, seed: int = 7) -> DataFrame:
    """``cut`` with sequence_id and offset for each piece.

    ``cut`` must be a stored table (rows come in the same order when read again): groups
    are drawn from the place of the rows. Ties in length are broken by id and start.
    """
    groups = max(1, -(-cut.count() // group_items))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", id_col, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins = np.array(first_fit(items["length"].tolist(), length), np.int64)
        items["sequence_id"] = (items["_group"].to_numpy(np.int64) << 32) + bins
        items["offset"] = items.groupby("sequence_id")["length"].cumsum() - items["length"]
        return items.drop(columns="_group")

    kind = cut.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a tokenizer file that all executors can read. A null or empty text has
    one piece: its end id alone. Repeated rows and null ids are packed as documents of
    their own; other columns are not read; an empty table gives no pieces.
    """
    return pack(materialize(pieces(docs, path, id_col, text_col, length), "pieces"), id_col, length)
