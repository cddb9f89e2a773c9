"""Quality classifier: ridge regression on random Fourier features, with isotonic calibration.

Each text is described by a few statistics (FEATURES). Random Fourier features of the
standardised statistics approximate a Gaussian kernel; every task sums up its part of the
normal equations, the parts are added by a shuffle, and only their sum, whose size depends
on the number of features alone, is solved on the driver. The sums are kept apart by fold,
so that leaving a fold out is a subtraction: scores of rows by a fit that has not seen them
calibrate the score by isotonic regression over score bins.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .bpe import chunks
from .shared import materialize

FEATURES = [
    "log_chars", "letters", "upper", "digits", "blanks", "commas_stops", "symbols", "bars", "bangs", "beyond_ascii", "log_lines", "line_chars",
    "word_bytes", "word_spread", "distinct_words", "distinct_lines", "sentence_words", "odd_ends", "shouted", "other_marks",
]
FOURIER = 256
FOLDS = 4
WIDTH = 3.0
RIDGE = 1e-3
BINS = 1000
SEED = 11

_LETTER, _UPPER, _DIGIT, _BLANK, _STOP, _SYMBOL, _BAR, _BANG, _MARK = range(9)


@cache
def kinds() -> np.ndarray:
    """One kind for each code point."""
    out = np.full(sys.maxunicode + 1, _MARK, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))
        if c[0] == "L":
            out[i] = _UPPER if c == "Lu" else _LETTER
        elif c[0] == "N":
            out[i] = _DIGIT
        elif c[0] in "ZC":
            out[i] = _BLANK
    out[[ord(c) for c in ".,;:'?-"]] = _STOP
    out[[ord(c) for c in "#$%&*+<=>@^_~\\/"]] = _SYMBOL
    out[ord("|")], out[ord("!")] = _BAR, _BANG
    return out


def _shares(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct (owner, value) pairs of each owner divided by all of its pairs; 1 where there are none."""
    total = np.bincount(owner, minlength=n)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.where(total > 0, np.bincount(o[new], minlength=n) / np.maximum(total, 1), 1.0)


def describe(texts: list[str]) -> np.ndarray:
    """The statistics of each text, one row for each, all finite, for empty texts too."""
    n = len(texts)
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    kind = kinds()[points]
    chars = np.maximum(sizes, 1)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), first)

    by = [count(kind == k) for k in range(9)]
    letters = by[_LETTER] + by[_UPPER]
    lines = count(points == 10)
    w = words.split(texts)
    size = (w.ends - w.starts).astype(float)
    per = np.maximum(w.counts, 1)
    mean = np.bincount(w.owner, size, minlength=n) / per
    spread = np.sqrt(np.maximum(np.bincount(w.owner, size * size, minlength=n) / per - mean * mean, 0))
    last = w.data[np.maximum(w.ends - 1, 0)]
    odd = np.isin(last, np.frombuffer(b"#$%&*|!@", np.uint8))
    # lines as slices of the same bytes
    ends = np.flatnonzero(w.data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line_owner = np.repeat(np.arange(n), lines)
    line_hash = words.hashes(w._replace(starts=starts, ends=ends))
    long_words = np.bincount(w.owner, size >= 2, minlength=n)
    shouted = by[_UPPER] / np.maximum(letters, 1)
    table = [
        np.log1p(sizes), letters / chars, shouted, by[_DIGIT] / chars, by[_BLANK] / chars, by[_STOP] / chars, by[_SYMBOL] / chars, by[_BAR] / chars, by[_BANG] / chars,
        count(points > 127) / chars, np.log1p(lines), np.log1p(sizes / lines), mean, spread, _shares(words.hashes(w), w.owner, n), _shares(line_hash, line_owner, n),
        np.log1p(w.counts / (1 + count((points == 46) | (points == 63)))), np.bincount(w.owner, odd, minlength=n) / per, (shouted > 0.5).astype(float) * long_words / per, by[_MARK] / chars,
    ]
    return np.column_stack(table).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


def describe_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every row's whole text; null counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in chunks(batch):
                x = describe(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_pydict({id_col: piece.column(0), "x": lists})

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, x array<float>")


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # directions of the random features, one row for each
    phases: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # raw scores of the calibration ...
    levels: np.ndarray  # ... and their calibrated ones

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.weights)) * np.cos(z @ self.weights.T + self.phases)
        return np.column_stack([waves, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.fourier(x) @ self.beta, self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and level of each block, x ascending, n the weights."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            more = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], more, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fourier: int = FOURIER) -> Model:
    """Learn from the rows of ``described`` (a stored table) that ``labels`` has an id and a label for.

    Null ids and labels are left out; if an id has several labels, their mean counts.
    Without any labelled row the model scores 0.5 everywhere.
    """
    means = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    both = described.select(F.col(f"`{id_col}`").alias("id"), F.col("x")).join(means.toDF("id", "y"), "id")
    train = materialize(both.select("x", "y", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).alias("fold")), "labelled")
    k = len(FEATURES)
    sums = train.agg(F.count(F.lit(1)).alias("n"), *[f(F.get("x", F.lit(i)).cast("double")).alias(f"{a}{i}") for i in range(k) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(SEED)
    weights, phases = rng.normal(size=(fourier, k)) / WIDTH, rng.uniform(0, 2 * np.pi, fourier)
    zero = np.zeros(fourier + 1)
    if not sums["n"]:
        return Model(np.zeros(k), np.ones(k), weights, phases, zero, np.zeros(1), np.full(1, 0.5))
    mean = np.array([sums[f"m{i}"] for i in range(k)])
    scale = np.maximum(np.array([sums[f"s{i}"] for i in range(k)]), 1e-3)
    model = Model(mean, scale, weights, phases, zero, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((FOLDS, fourier + 1, fourier + 1)), np.zeros((FOLDS, fourier + 1))
        for b in batches:
            if len(b):
                z, y, fold = model.fourier(np.stack(b["x"])), b["y"].to_numpy(), b["fold"].to_numpy()
                for f in range(FOLDS):
                    gram[f] += z[fold == f].T @ z[fold == f]
                    right[f] += z[fold == f].T @ y[fold == f]
        for f in range(FOLDS):
            yield pd.DataFrame({"fold": f, "i": range(fourier + 1), "row": list(np.column_stack([gram[f], right[f]]))})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": rows["fold"][:1], "i": rows["i"][:1], "row": [np.sum(np.stack(rows["row"]), axis=0)]})

    kind = "fold int, i int, row array<double>"
    system = np.zeros((FOLDS, fourier + 1, fourier + 2))
    for r in train.mapInPandas(part, kind).groupBy("fold", "i").applyInPandas(add, kind).collect():
        system[r["fold"], r["i"]] = r["row"]
    n = system[:, -1, -2]  # the constant feature counts rows

    def solve(s: np.ndarray, rows: float) -> np.ndarray:
        return np.linalg.solve(s[:, :-1] + RIDGE * max(rows, 1) / (fourier + 1) * np.eye(fourier + 1), s[:, -1])

    total = system.sum(axis=0)
    model = model._replace(beta=solve(total, n.sum()))
    without = [solve(total - system[f], n.sum() - n[f]) for f in range(FOLDS)]

    def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z, fold = model.fourier(np.stack(b["x"])), b["fold"].to_numpy()
                raw = np.choose(fold, [z @ w for w in without])
                yield pd.DataFrame({"bin": np.clip(np.round(raw * BINS), -BINS, 2 * BINS).astype(np.int64), "y": b["y"].to_numpy()})

    bins = train.mapInPandas(unseen, "bin bigint, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    knots, levels = isotonic(*(np.array([r[c] for r in bins], float) for c in ("bin", "y", "n")))
    return model._replace(knots=knots / BINS, levels=levels)


def score(described: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row of ``described``: 0 to 1, higher if label 1 is likelier."""
    kind = described.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "score": pa.array(model.score(x))})

    return described.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score, predicted) for every row of ``docs``; labels count where ``learn_from`` holds.

    A null text counts as empty. Only the named columns are read, and of ``labels``
    only its id and label. Repeated rows are scored, and learnt from, one by one.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    described = materialize(describe_all(named, "id", "text"), "described")
    known = labels.where(learn_from).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    found = score(described, fit(described, known, "id", "label"), "id")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
