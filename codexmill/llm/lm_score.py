"""Language-model scores: context-tree weighting over byte contexts.

Every byte is eight binary decisions. For each decision, each context of 0 to DEPTH
preceding bytes holds a Krichevsky-Trofimov estimate from its counts of zeros and ones, and
the contexts of all depths are mixed by context-tree weighting: a node's weighted
probability is half its own estimate and half the product of its children's, which gives the
share with which the mixture stops at the node.

Counts of (context, byte) grams of all training texts are added up by a shuffle. Trees are
weighted from their deepest nodes: down to CROWN bytes in buckets of contexts, whose number
follows the number of grams, and from there on by sums over children. All nodes are kept. Only
those above CROWN, contexts of fewer than CROWN bytes, are gathered and broadcast; the deeper
ones stay in their buckets, where each distinct gram of all texts gets its score once.

Texts are sums over their grams' scores. The most frequent grams, at most HOT of them, are
looked up in place; all others are joined to their scores by a shuffle. That changes where
a score is read, not what it is.

The base score is that of a unigram model with counts plus one. Words above the share
EPSILON_WORDS of tokens, at most 1 / EPSILON_WORDS of them, are looked up in place; all
others are joined to their counts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from . import words
from .bpe import chunks
from .shared import materialize

DEPTH = 6
CROWN = 3
#: Grams in a bucket of contexts, about.
BUCKET = 200_000
#: Grams that are looked up in place, at most.
HOT = 1 << 21
EPSILON_WORDS = 2.0**-18
#: log2 of the places in a worker's table of gram scores.
PLACES = 22
#: Bytes of text and grams handled at once, and rows that a task sums up before it sends them.
SLICE, MISSES, HELD = 1 << 19, 1 << 16, 400_000
GRAM, WORD, TEXTS, TOKENS = range(4)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(for every byte and an end byte 0 of all texts: DEPTH bytes before it and itself, where each text's end).

    The byte just before comes first, in the high bits, so that sorted grams have sorted contexts at all depths;
    the byte itself comes last. Before a text stand zeros. A-Z count as a-z.
    """
    gap = b"\0" * (DEPTH + 1)
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = words._LOWER[np.frombuffer(gap[1:] + gap.join(parts) + gap, np.uint8)].astype(np.int64)
    gram = np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        gram |= data[k : k + len(gram)] << (8 * (k + 1) if k < DEPTH else 0)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
    keep = np.repeat(starts, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    return gram[keep], np.cumsum(sizes)


def _sum_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def count(docs: DataFrame, text_col: str = "text", learn_from: Column | None = None) -> DataFrame:
    """(kind, key, n): grams, hashes of words, and the numbers of texts and tokens of the rows that are learnt from.

    Grams of the other rows are there too, with n = 0 unless they are learnt as well.
    """

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": pa.array(key), "n": pa.array(n)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {GRAM: ([], []), WORD: ([], [])}
        texts_seen = tokens = 0
        for batch in batches:
            for piece, texts in chunks(batch, size=SLICE):
                learnt = piece.column(piece.schema.get_field_index("learnt")).to_pylist()
                other = [t for t, ok in zip(texts, learnt) if not ok]
                texts = [t for t, ok in zip(texts, learnt) if ok]
                w = words.split(texts)
                texts_seen += len(texts)
                tokens += len(texts) + len(w.starts)
                for kind, values, weight in ((GRAM, grams(texts)[0], 1), (GRAM, grams(other)[0], 0), (WORD, words.hashes(w).view(np.int64), 1)):
                    key, n = np.unique(values, return_counts=True)
                    held[kind][0].append(key)
                    held[kind][1].append(n * weight)
                    if sum(map(len, held[kind][0])) > 2 * HELD:
                        key, n = _sum_up(*held[kind])
                        held[kind] = ([key], [n])
                        if len(key) > HELD:
                            yield rows(kind, key, n)
                            held[kind] = ([], [])
        for kind, (keys, counts) in held.items():
            yield rows(kind, *_sum_up(keys, counts))
        held.clear()
        yield rows(TEXTS, np.zeros(1, np.int64), np.array([texts_seen]))
        yield rows(TOKENS, np.zeros(1, np.int64), np.array([tokens]))
        pa.default_memory_pool().release_unused()

    learnt = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    dealt = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"), learnt.alias("learnt")).mapInArrow(run, "kind int, key bigint, n bigint")
    return dealt.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series eight steps further up."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        series = series - np.log(x + k)
    return series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def shorter(key: np.ndarray, by: int = 1) -> np.ndarray:
    """Grams or nodes without the earliest bytes of their contexts."""
    return key >> (8 * by + 8) << 8 | key & 255


def weigh(gram: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(depth, node, zeros, ones, share that stops, log weighted) of all nodes of depth DEPTH to CROWN, in parts.

    A node is its context and the bits so far, with a leading one. Each number of bits has trees of its own.
    """
    grams_of = {DEPTH: (gram, n)}
    for depth in range(DEPTH - 1, CROWN - 1, -1):
        grams_of[depth] = _sum_up([shorter(grams_of[depth + 1][0])], [grams_of[depth + 1][1]])
    for b in range(8):
        children, below = np.zeros(0, np.int64), np.zeros(0)
        for depth in range(DEPTH, CROWN - 1, -1):
            key, total = grams_of[depth]
            node = key >> 8 << 8 | 1 << b | (key & 255) >> (8 - b)
            bit = (key >> (7 - b) & 1) == 1
            order = np.argsort(node, kind="stable")
            node, bit, total = node[order], bit[order], total[order]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            node, zeros, ones = node[first], np.add.reduceat(np.where(bit, 0, total), first), np.add.reduceat(np.where(bit, total, 0), first)
            own = log_kt(zeros.astype(float), ones.astype(float))
            if depth == DEPTH:
                weighted, stop = own, np.ones(len(node))
            else:
                weighted, stop = mixed(own, np.bincount(np.searchsorted(node, shorter(children)), below, minlength=len(node)))
            yield np.full(len(node), depth, np.int32), node, zeros, ones, stop, weighted
            children, below = node, weighted


def mixed(own: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, share that stops) from the logs of a node's estimate and of its children's product."""
    both = np.logaddexp(own, split)
    return both - np.log(2), np.exp(own - both)


class Model(NamedTuple):
    """For each depth: sorted nodes, their probability of a one, and the share that stops there."""

    node: list[np.ndarray]
    one: list[np.ndarray]
    stop: list[np.ndarray]

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each gram after the others; grams are sorted."""
        return sum((self.bit(gram, b) for b in range(8)), np.zeros(len(gram)))

    def bit(self, gram: np.ndarray, b: int) -> np.ndarray:
        """Log10 probability of bit ``b`` of the last byte; only nodes of that bit are looked up."""
        if len(gram) > MISSES:
            return np.concatenate([self.bit(gram[i : i + MISSES], b) for i in range(0, len(gram), MISSES)])
        # sorted grams have equal decisions side by side: each is looked up once
        decision = gram >> (8 - b)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), decision[1:] != decision[:-1]]))
        node_of = gram[first] >> 8 << 8 | 1 << b | (gram[first] & 255) >> (8 - b)
        left, mixture, last, live = np.ones(len(first)), np.zeros(len(first)), np.full(len(first), 0.5), np.arange(len(first))
        for depth, (node, one, stop) in enumerate(zip(*self, strict=True)):
            if not len(node) or not len(live):
                break
            key = shorter(node_of[live], DEPTH - depth) if depth < DEPTH else node_of[live]
            at = np.minimum(np.searchsorted(node, key), len(node) - 1)
            there = node[at] == key
            live, at = live[there], at[there]
            last[live] = one[at]
            mixture[live] += left[live] * stop[at] * one[at]
            left[live] *= 1.0 - stop[at]
        mixture = np.repeat(mixture + left * last, np.diff(np.append(first, len(gram))))
        return np.log10(np.where(gram >> (7 - b) & 1, mixture, 1 - mixture))


NODE = "depth int, node bigint, zeros bigint, ones bigint, stop double, weighted double"


def _crown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes from the sums over their children."""
    for b in batches:
        zeros, ones, split = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("zeros", "ones", "split"))
        weighted, stop = mixed(log_kt(zeros.astype(float), ones.astype(float)), split)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(stop), pa.array(weighted)], names=["depth", "node", "zeros", "ones", "stop", "weighted"])


def _dealt(counts: DataFrame) -> GroupedData:
    """(key, n) of all grams, grouped into buckets by the CROWN bytes before the last."""
    all_grams = counts.where(F.col("kind") == GRAM)
    buckets = max(16, all_grams.count() // BUCKET)
    context = F.shiftright("key", 8 * (DEPTH - CROWN) + 8)
    return all_grams.select(F.pmod(F.xxhash64(context), F.lit(buckets)).alias("bucket"), "key", "n").groupBy("bucket")


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def learn(counts: DataFrame, deepest: int = DEPTH) -> Model:
    """The nodes of depth 0 to ``deepest``, from a stored table of counts, in the driver.

    Nodes above CROWN are as many as there are contexts of fewer than CROWN bytes; a
    greater depth grows with the corpus and is meant for small ones.
    """

    def run(rows: pa.Table) -> pa.Table:
        key, n = _sorted(rows)
        parts = [[c[:0] for c in (np.zeros(0, np.int32), key, n, n, np.zeros(0), np.zeros(0))]]
        parts += [part for part in weigh(key[n > 0], n[n > 0]) if part[0][0] <= max(deepest, CROWN)] if n.any() else []
        return pa.table({k: pa.array(np.concatenate(v)) for k, v in zip(("depth", "node", "zeros", "ones", "stop", "weighted"), zip(*parts), strict=True)})

    nodes = materialize(_dealt(counts).applyInArrow(lambda t: run(t), NODE), "lm-nodes")
    level = nodes.where(F.col("depth") == CROWN)
    for depth in range(CROWN - 1, -1, -1):
        parent = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
        sums = level.groupBy(parent.alias("parent")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("split"))
        level = materialize(sums.select(F.lit(depth).alias("depth"), F.col("parent").alias("node"), "zeros", "ones", "split").mapInArrow(_crown, NODE), "lm-nodes")
        nodes = nodes.unionByName(level)
    rows = nodes.where(F.col("depth") <= deepest).select("depth", "node", ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)).alias("one"), "stop").toArrow()
    depths, node = rows["depth"].to_numpy(), rows["node"].to_numpy()
    out = Model([], [], [])
    for depth in range(deepest + 1):
        at = np.flatnonzero(depths == depth)
        at = at[np.argsort(node[at])]
        for column, values in zip(out, (node, rows["one"].to_numpy(), rows["stop"].to_numpy()), strict=True):
            column.append(values[at])
    return out


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, n, value): the log10 probability of each distinct gram of ``counts``, by the nodes of all depths."""
    sent = counts.sparkSession.sparkContext.broadcast(learn(counts, CROWN - 1))

    def run(rows: pa.Table) -> pa.Table:
        key, n = _sorted(rows)
        crown, value = sent.value, np.zeros(len(key))
        parts = weigh(key[n > 0], n[n > 0]) if n.any() else iter(())
        for b in range(8):
            # the trees of a bit, from their deepest nodes
            deep = [(node, (ones + 0.5) / (zeros + ones + 1.0), stop) for _, node, zeros, ones, stop, _ in islice(parts, DEPTH - CROWN + 1)][::-1]
            value += Model(*([*top, *more] for top, more in zip(crown, zip(*deep) if deep else ((), (), ())))).bit(key, b)
        return pa.table({"gram": pa.array(key), "n": pa.array(n), "value": pa.array(value)})

    return materialize(_dealt(counts).applyInArrow(lambda t: run(t), "gram bigint, n bigint, value double"), "lm-grams")


def most_frequent(all_grams: DataFrame) -> DataFrame:
    """At most HOT rows of ``all_grams``: those above some number of occurrences in training texts."""
    level = F.floor(8 * F.log2("n"))
    learnt = all_grams.where("n > 0")
    left, least = HOT, None
    for r in learnt.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred at most
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    return learnt.where(F.lit(False) if least is None else level >= least)


class Table:
    """Scores of frequent grams, of a fixed size: two places for each gram; those that find none are left out."""

    def __init__(self, gram: np.ndarray, value: np.ndarray) -> None:
        """Grams come in rising order of frequency."""
        self.key, self.value = np.full(1 << PLACES, -1, np.int64), np.zeros(1 << PLACES)
        for turn in range(2):
            place = self._place(gram, turn)
            free = self.key[place] == -1
            self.key[place[free]] = gram[free]  # of two with one place the last stays, in both arrays
            self.value[place[free]] = value[free]
            out = self.key[place] != gram
            gram, value = gram[out], value[out]

    @staticmethod
    def _place(gram: np.ndarray, turn: int) -> np.ndarray:
        mixed_up = words.mix(gram.view(np.uint64))
        return ((mixed_up << np.uint64(PLACES * turn)) >> np.uint64(64 - PLACES)).astype(np.int64)

    def __call__(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which grams are in the table, their values and zeros)."""
        there, value = np.zeros(len(gram), bool), np.zeros(len(gram))
        for turn in range(2):
            open_ = np.flatnonzero(~there)
            place = self._place(gram[open_], turn)
            hit = self.key[place] == gram[open_]
            there[open_[hit]], value[open_[hit]] = True, self.value[place[hit]]
        return there, value


def score(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows where ``learn_from`` holds are learnt from; all are scored, whole. A null text
    counts as empty and still has its end, which is a token and a byte. Without any row
    to learn from each bit has probability one half. Repeated rows count, and are scored,
    one by one; other columns are read only by ``learn_from``.
    """
    spark = docs.sparkSession
    counts = materialize(count(docs, text_col, learn_from), "lm-counts")
    all_grams = gram_scores(counts)
    frequent = most_frequent(all_grams).toArrow()
    order = np.argsort(frequent["n"].to_numpy(), kind="stable")
    hot, hot_value = frequent["gram"].to_numpy()[order], frequent["value"].to_numpy()[order]
    sums = {(r["kind"]): r["n"] for r in counts.where(F.col("kind").isin(TEXTS, TOKENS)).collect()}
    train_texts, train_tokens = sums.get(TEXTS, 0), sums.get(TOKENS, 0)
    all_words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    distinct = all_words.count() + (train_texts > 0)
    often = all_words.where(F.col("c") >= max(1.0, train_tokens * EPSILON_WORDS)).toArrow()
    order = np.argsort(often["word"].to_numpy())
    known, gain = often["word"].to_numpy()[order], np.log10(often["c"].to_numpy()[order] + 1.0)
    sent = spark.sparkContext.broadcast((Table(hot, hot_value), known, gain))  # bounded by PLACES and EPSILON_WORDS
    end_gain, end_known = float(np.log10(train_texts + 1.0)), int(train_texts > 0)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, n_known bigint, gain double, score double, rare array<bigint>, rare_grams array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, known, gain = sent.value
        for batch in batches:
            for piece, texts in chunks(batch, size=SLICE):
                n = len(texts)
                gram, ends = grams(texts)
                starts = np.concatenate([[0], ends[:-1]])
                found, value = scores(gram)
                total = np.add.reduceat(value, starts)
                grams_upto = np.concatenate([[0], np.cumsum(np.add.reduceat((~found).astype(np.int64), starts))])
                w = words.split(texts)
                h = words.hashes(w).view(np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    there = known[at] == h
                    more = np.bincount(w.owner[there], gain[at[there]], minlength=n)
                else:
                    there, more = np.zeros(len(h), bool), np.zeros(n)
                upto = np.concatenate([[0], np.cumsum(np.bincount(w.owner[~there], minlength=n))])
                yield pa.RecordBatch.from_pydict({
                    id_col: piece.column(0), "n_bytes": pa.array(ends - starts - 1), "n_tokens": pa.array(w.counts + 1),
                    "n_known": pa.array(np.bincount(w.owner[there], minlength=n) + end_known), "gain": pa.array(more + end_gain), "score": pa.array(total),
                    "rare": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(h[~there])),
                    "rare_grams": pa.ListArray.from_arrays(pa.array(grams_upto, pa.int32()), pa.array(gram[~found])),
                })
        pa.default_memory_pool().release_unused()

    scored = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    asked = scored.select("_row", F.explode("rare").alias("word"))
    found = asked.join(all_words, "word").groupBy("_row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count(F.lit(1)).alias("also"))
    asked = scored.select("_row", F.explode("rare_grams").alias("gram"))
    summed = asked.join(all_grams, "gram").groupBy("_row").agg(F.sum("value").alias("deep"))
    out = scored.drop("rare", "rare_grams").join(found, "_row", "left").join(summed, "_row", "left").withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    base = F.col("gain") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(train_tokens + distinct + 1.0))
    return out.select(
        id_col, "n_bytes", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
