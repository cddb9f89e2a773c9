"""Spelling variants: words that differ by one letter, found level by level in tries that are tables.

A trie's inner nodes are the beginnings of words after which the words go on differently; its edges hold the letters
from one such node to the next, or to a word's end. A state is a word, its place, a node and its edits. States at the
nodes of a word's own path have none; each tries the other edges with one letter replaced, inserted or deleted, and the
states that have spent their edit follow matching edges, one join with the edge table for each level, until they
come to a word's end: a neighbour. Edges carry a signature of the endings beyond them, so that most states without a neighbour end at once. Two tries share the work: of the words, for edits in the second half of a word, and of
the words read backwards, for those in the first half. So no state starts near a root, where all words meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a word, and occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs this many times as often as its variant, at least.
TIMES = 10
#: Rows of prefixes that are handed over at once.
ROWS = 100_000
#: An edge has a signature of so many times 64 bits (a power of two): one for the hash of what is left, beyond it, of each word that it leads to.
SIGNS = 4
#: Stands after a word's last letter; no letter.
END = "$"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(id, run): maximal runs of letters of at least so many, A-Z lower-cased, one row for each occurrence; none for a null text."""
    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), 0)).alias("run"))


def count_words(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of a table with a column ``word``; short, rare and null ones go. Counts are summed in each task before they are dealt."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, back, depth, next, a, b) for the prefixes of each word and of the word backwards from a half of it on: the letter that follows (0 at the end), and 128 bits of a hash."""

    def packed(rows: list[tuple[int, bool, int, int]], digests: list[bytes]) -> pa.RecordBatch:
        wid, back, depth, following = zip(*rows)
        hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = [pa.array(wid, pa.int64()), pa.array(back, pa.bool_()), pa.array(depth, pa.int32()), pa.array(following, pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["wid", "back", "depth", "next", "a", "b"])

    rows: list[tuple[int, bool, int, int]] = []
    digests: list[bytes] = []
    for batch in batches:
        for wid, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for back in (False, True):
                text = word[::-1] if back else word
                # a neighbour's half may lie one letter earlier
                start = max(0, _half(len(word), back) - 1)
                state = hashlib.blake2b(text[:start].encode(), digest_size=16, person=b"back" if back else b"")
                for depth in range(start, len(text) + 1):
                    if depth > start:
                        state.update(text[depth - 1].encode())
                    rows.append((wid, back, depth, ord(text[depth]) if depth < len(text) else 0))
                    digests.append(state.digest())
                    if len(rows) >= ROWS:
                        yield packed(rows, digests)
                        rows, digests = [], []
    if rows:
        yield packed(rows, digests)


def _half(length: int, back: bool) -> int:
    """Letters before the place from which edits are looked for: in the word, or in the word backwards."""
    return length - length // 2 if back else length // 2


def _tries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, states) of words (wid, word, n): a, b, first, label, to_a, to_b, near, near_n; and word, back, rest, a, b of all nodes on the words' paths from their halves on."""
    steps = words.select("wid", "word").mapInArrow(_prefixes, "wid bigint, back boolean, depth int, next int, a bigint, b bigint")
    steps = materialize(steps, "prefixes")
    forks = steps.groupBy("a", "b").agg(F.min("next").alias("x"), F.max("next").alias("y")).where("x <> y").select("a", "b")
    nodes = F.array_sort(F.collect_list(F.struct("depth", "a", "b"))).alias("nodes")
    paths = steps.join(forks, ["a", "b"]).groupBy("wid", "back").agg(nodes).join(words, "wid")
    text = F.concat(F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")), F.lit(END))
    paths = materialize(paths.select("word", "n", "back", text.alias("text"), "nodes"), "paths")
    discard(steps)
    at = paths.select("word", "n", "back", "text", "nodes", F.posexplode("nodes").alias("k", "node"))
    following = F.get("nodes", F.col("k") + 1)
    rest = F.expr("substring(text, node.depth + 1)")
    label = F.when(following.isNull(), rest).otherwise(F.expr("substring(text, node.depth + 1, get(nodes, k + 1).depth - node.depth)"))
    ending = F.xxhash64(F.expr("substring(text, get(nodes, k + 1).depth + 1)"))
    signs = [F.when(following.isNotNull() & (_slot(ending) == i), F.call_function("shiftleft", F.lit(1).cast("long"), ending.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")).alias(f"s{i}") for i in range(SIGNS)]
    edges = at.select(
        *signs, F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.substring(rest, 1, 1).alias("first"),
        F.struct(label.alias("label"), following["a"].alias("to_a"), following["b"].alias("to_b"), F.when(following.isNull(), F.col("word")).alias("near"), F.when(following.isNull(), F.col("n")).alias("near_n")).alias("edge"),
    ).groupBy("a", "b", "first").agg(F.min("edge").alias("edge"), *[F.bit_or(f"s{i}").alias(f"s{i}") for i in range(SIGNS)]).select("a", "b", "first", "edge.*", *[f"s{i}" for i in range(SIGNS)])
    length = F.length("word")
    half = F.when(F.col("back"), length - F.floor(length / 2)).otherwise(F.floor(length / 2))
    states = at.where(F.col("node.depth") >= half).select("word", "back", rest.alias("rest"), "node.a", "node.b")
    return materialize(edges, "edges"), states


def _slot(h: Column) -> Column:
    return F.shiftright(h, 6).bitwiseAND(F.lit(SIGNS - 1))


def _may_end(rest: Column) -> Column:
    """Whether an edge may lead to a word with that ending: always where it does, seldom else unless very many words lie beyond it."""
    h = F.xxhash64(rest)
    sign = F.lit(0).cast("long")
    for i in range(SIGNS):
        sign = F.when(_slot(h) == i, F.col(f"s{i}")).otherwise(sign)
    return F.col("to_a").isNull() | (F.getbit(sign, h.bitwiseAND(F.lit(63)).cast("int")) == 1)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs, both ways, of words (wid, word, n) that differ by one inserted, deleted or replaced code point."""
    edges, states = _tries(words)
    m = F.length("label")
    leaf = F.col("to_a").isNull()

    def left(used: Column) -> Column:
        return F.substring("rest", used + 1, F.length("rest"))

    def goes_on(same: Column, used: Column) -> Column:
        """Whether the letters agree, and what is left after so many may go on; a leaf must use up all."""
        return same & (~leaf | (F.length("rest") == used)) & _may_end(left(used))

    tail = F.expr("substring(label, 2)")
    edits = [  # a letter replaced, inserted, deleted
        (goes_on(tail == F.substring("rest", F.lit(2), m - 1), m), left(m)),
        (goes_on(tail == F.substring("rest", F.lit(1), m - 1), m - 1), left(m - 1)),
        (goes_on(F.col("label") == F.substring("rest", F.lit(2), m), m + 1), left(m + 1)),
    ]
    kept = ["word", "back", "to_a", "to_b", "near", "near_n"]
    # few of the pairs go on, so all is tested before anything is made of them
    live = states.join(edges, ["a", "b"]).where((F.substring("rest", 1, 1) != F.col("first")) & (edits[0][0] | edits[1][0] | edits[2][0]))
    live = live.select(*kept, F.explode(F.array_compact(F.array(*[F.when(good, rest) for good, rest in edits]))).alias("rest"))
    ends = []
    while True:
        live = materialize(live, "frontier")
        ends.append(live.where("to_a is null"))
        live = live.where("to_a is not null").select("word", "back", "rest", F.col("to_a").alias("a"), F.col("to_b").alias("b"), F.substring("rest", 1, 1).alias("first"))
        if live.isEmpty():
            break
        live = live.join(edges, ["a", "b", "first"]).where(F.col("rest").startswith(F.col("label")) & (~leaf | (F.length("rest") == m)) & _may_end(F.substring("rest", m + 1, F.length("rest"))))
        live = live.select(*kept, F.substring("rest", m + 1, F.length("rest")).alias("rest"))
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    # what both tries would find is left to the first
    both = F.col("back") & F.col("near").startswith(F.expr("left(word, cast(floor(length(word) / 2) as int))"))
    return found.where(~both).select("word", "near", "near_n")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words (word, n); words are distinct.

    A word's form is its neighbour of largest n (ties: the smallest in code-point order) if that is at least ``times`` its
    own n, else null; its root is where forms lead to, itself if it has none. With times over 1 forms can't run in a circle.
    """
    if times < 2:
        raise ValueError("forms could run in a circle")
    numbered = materialize(words.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    near = neighbours(numbered).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    good = -F.col("best.minus") >= times * F.col("n")
    rows = numbered.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"))
    rows = materialize(rows, "forms")
    step = rows.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("next"))
    # counts grow tenfold at each step, so paths are short
    roots, moving = None, step.select(F.col("at").alias("word"), F.col("next").alias("root"))
    while True:
        moved = materialize(moving.join(step, F.col("root") == F.col("at"), "left").select("word", "root", "next"), "roots")
        done = moved.where("next is null").select("word", "root")
        roots = done if roots is None else roots.unionByName(done)
        moving = moved.where("next is not null").select("word", F.col("next").alias("root"))
        if moving.isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
