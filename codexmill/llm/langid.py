"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three
letters, words padded by a blank), in order of frequency. A document has a profile of the same kind,
and its distance to a language is the sum, over its n-grams, of how far out of place each is in
the language's list; an n-gram that the list lacks counts as far as the list is long. The
language with the least distance wins.

Learning counts n-grams of all training documents: every task sums up its own counts per
language, which are added by a shuffle keyed by language and n-gram. Only the heads of the
lists, PROFILE entries for each language, reach the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import chunks

PROFILE = 400
#: N-grams of a language that a task sums up before it sends them.
HELD = 200_000
#: Bytes of text that are ranked at a time: n-grams and their sorts take some 200 bytes for each letter.
CHUNK_BYTES = 1 << 18
UNDETERMINED = "und"
#: A document is in no known language if its distance is over that of 99 % of the training rows, and MARGIN more ...
USUAL = 0.99
MARGIN = 0.15
#: ... where that sum is held within these bounds, since few training rows fit their own profiles too well, and noisy ones badly.
CUT_BOUNDS = (0.6, 0.9)

Profiles = dict[str, np.ndarray]


@cache
def folded() -> np.ndarray:
    """Lower-case letter of each code point that is a letter, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts with 0 for a blank between words and at both ends of a text, the text of each)."""
    joined = "\n".join(texts) + "\n"
    points = folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    # a blank after a blank goes, but each text keeps the one at its end
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    ends = np.cumsum(np.bincount(owner, minlength=len(texts))) - 1
    keep[ends] = True
    return points[keep], owner[keep]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, text) of each n-gram: three times 21 bits of letters, 0 for a blank."""
    points, owner = letters(texts)
    points = points.astype(np.int64)
    before = np.concatenate([[0], points[:-1]])
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    before[~same] = 0
    two_before = np.concatenate([[0, 0], before[1:-1]]) if len(points) > 1 else np.zeros_like(points)
    two_before[~same] = 0
    one = points != 0
    pair = (before != 0) | one
    # a blank inside would join two words; a pair of blanks is no n-gram
    triple = before != 0
    mark = np.int64(0x1FFFFF)
    first = mark << 42 | mark << 21 | points
    second = mark << 42 | before << 21 | points
    third = two_before << 42 | before << 21 | points
    return np.concatenate([first[one], second[pair], third[triple]]), np.concatenate([owner[one], owner[pair], owner[triple]])


def readable(code: int) -> str:
    """An n-gram's letters, "_" for a blank."""
    parts = [(code >> s) & 0x1FFFFF for s in (42, 21, 0)]
    return "".join("_" if p == 0 else chr(p) for p in parts if p != 0x1FFFFF)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all rows with a language: n-gram codes, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            codes, n = held.pop(lang)
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": pa.array(codes), "n": pa.array(n)})

        for batch in batches:
            for piece, texts in chunks(batch):
                langs = piece.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    codes, n = np.unique(ngrams([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
                    if lang in held:
                        codes, at = np.unique(np.concatenate([held[lang][0], codes]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = codes, n
                    if len(codes) > HELD:
                        yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    heads = counts.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect()
    out: dict[str, list[int]] = {}
    for r in heads:
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def rank(texts: list[str], profiles: Profiles, size: int = PROFILE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(best language, score, mean distance of the best as a share of the largest, n-grams ranked) of each text."""
    names = sorted(profiles)
    n = len(texts)
    codes, owner = ngrams(texts)
    if not len(codes) or not names:
        return [UNDETERMINED] * n, np.zeros(n), np.ones(n), np.zeros(n, np.int64)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(new)
    codes, owner, freq = codes[at], owner[at], np.diff(np.append(at, len(codes)))
    order = np.lexsort((codes, -freq, owner))
    codes, owner = codes[order], owner[order]
    first = np.searchsorted(owner, np.arange(n))
    place = np.arange(len(owner)) - first[owner]
    top = place < size
    codes, owner, place = codes[top], owner[top], place[top]
    ranked = np.bincount(owner, minlength=n)
    total = np.maximum(ranked, 1)
    far = np.empty((n, len(names)))
    for j, name in enumerate(names):
        profile = profiles[name]
        sort = np.argsort(profile)
        found = np.minimum(np.searchsorted(profile[sort], codes), len(profile) - 1)
        there = profile[sort][found] == codes
        distance = np.where(there, np.minimum(np.abs(sort[found] - place), size), size)
        far[:, j] = np.bincount(owner, distance, minlength=n) / total / size
    best = far.argmin(axis=1)
    near = 1 - far
    score = near[np.arange(n), best] / np.maximum(near.sum(axis=1), 1e-12)
    some = ranked > 0
    least = np.where(some, far[np.arange(n), best], 1.0)
    langs = [names[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
    return langs, np.where(some, np.clip(score, 0, 1), 0.0), least, ranked


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", with_ngrams: bool = False, text: Column | None = None) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_distance (0 to 1), and lang_ngrams (distinct ones ranked, PROFILE at most) if asked for.

    A text that is null or has no letter is ``und`` with score 0, distance 1 and no n-grams. Ties
    go to the language first in alphabetical order. ``text``, if given, stands for the column of texts. Rows are handled where they are read;
    all other columns pass through, but for old columns of the names added.
    """
    added = ["lang_pred", "lang_score", "lang_distance"] + ["lang_ngrams"] * with_ngrams
    rest = docs.drop(*added)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(profiles)  # PROFILE codes for each language

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [rank(t, sent.value) for _, t in chunks(pa.RecordBatch.from_arrays([column], ["text"]), size=CHUNK_BYTES)]
            fields = [pa.array([x for p in parts for x in p[0]], pa.string())]
            fields += [pa.array(np.concatenate([p[k] for p in parts] or [np.zeros(0)]), kind) for k, kind in ((1, pa.float64()), (2, pa.float64()), (3, pa.int64()))]
            yield pa.StructArray.from_arrays(fields, ["lang_pred", "lang_score", "lang_distance", "lang_ngrams"])

    # called nondeterministic, or Spark would copy it into a filter on its columns and rank each text twice, in two workers a task
    judge = F.arrow_udf(run, "lang_pred string, lang_score double, lang_distance double, lang_ngrams bigint").asNondeterministic()
    struct = next(n for k in range(len(rest.columns) + 1) if (n := f"_lang{k}") not in rest.columns)
    judged = rest.withColumn(struct, judge(F.col(f"`{text_col}`") if text is None else text))
    return judged.select(*[F.col(f"`{c}`") for c in rest.columns], *[F.col(f"{struct}.{c}") for c in added])


def known(docs: DataFrame, trained: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are in one of the languages learnt from the rows that ``trained`` marks.

    A row goes if its text is null or has no letter, or if its distance to the best profile is over a cut: MARGIN over that of
    99 % of the training rows, held within CUT_BOUNDS, and 1 / sqrt(n) more for a text of n n-grams, as the mean distance of
    a short text says little. Columns stay as they are, whatever their names. Nothing is stored: training rows are judged
    for the cut and again with all others, as a copy with their texts would take the input's disk once more. Without
    training rows nothing is known, and all rows go.
    """
    read = lambda c: F.col(f"`{c}`")
    apart = docs.select(F.struct(*[read(c) for c in docs.columns]).alias("row"))  # the text is in it once: rows wait in memory while texts are judged
    learnt = docs.where(trained & read(lang_col).isNotNull()).select(read(text_col).alias("text"), read(lang_col).alias("lang"))
    profiles = learn(learnt)
    usual = predict(learnt.select("text"), profiles, with_ngrams=True).where("lang_ngrams > 0").agg(F.percentile_approx("lang_distance", USUAL)).first()[0]
    least, most = CUT_BOUNDS
    cut = min(max((usual or 0.0) + MARGIN, least), most)
    stay = (F.col("lang_pred") != UNDETERMINED) & (F.col("lang_distance") <= F.lit(cut) + 1 / F.sqrt("lang_ngrams"))
    return predict(apart, profiles, with_ngrams=True, text=F.col("row").getField(text_col)).where(stay).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def held_out(id_col: str, parts: int, part: int) -> Column:
    """True for rows whose crc32 of the id as text has the given remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
