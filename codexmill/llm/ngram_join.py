"""N-gram Jaccard join by T-occurrence search with DivideSkip, distributed.

Two sets x and y of at least 0.75 similarity share T = ceil(3 (|x| + |y|) / 7) elements. For a
set of n elements the inverted lists divide into the long ones and the n - ceil(3n / 4) + l
short ones, of which a partner must stand on l at least. "Short" follows one order for
all sets: elements in more than LIST sets come last, and all others go by their hash.

1. Equal sets are one class from here on. A pass counts in how many classes each
   element is (partial counts in each task); a bitmap of fixed size keeps the frequent ones.
2. The short lists are built by buckets of elements. A list of at most LIST classes gives
   its pairs, which are counted; a longer one only chains its classes. Pairs that share l short
   lists, and chains, make groups: each link lies in one group.
3. Each group searches itself. For each class the rarest lists of the group are merged
   with a heap, and classes found often enough are probed for in the long lists by
   binary search until T is reached or out of reach. Classes that are linked already to
   the best-connected one are not searched for again, since their partners search for them.

Large groups are searched in blocks: every block by itself, then a few leaders in all
blocks, and then only what those haven't tied to the main component in all blocks. What is
asked is dealt into blocks too, so a task holds two blocks, about, at most. So no list, group of copies or component is gathered in a task, and no link is lost.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles, words
from .bpe import chunks
from .components import Forest, components
from .shared import discard, materialize

#: Lists of more classes are long.
LIST = 16
#: Partners share so many short lists.
SHARED = 4
#: Elements in a bucket of lists, about.
BUCKET = 1 << 19
#: Elements in a block of a group, about.
BLOCK = 1 << 20
LEADERS = 16
#: Bytes of text that are handled at once.
SLICE = 2 << 20
#: log2 of the bits in a bitmap (2 MB).
BITS = 24
_SURE = 1 << 20
_POSTING = np.dtype([("element", "<u8"), ("cls", "<u8"), ("n", "<u4")])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """(rows, their sets, their class keys) of each slice of a batch."""
    for piece, texts in chunks(batch, size=SLICE):
        flat, ends = shingles.sets(texts)
        upto = np.concatenate([[0], ends])
        spread = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
        keys = words.mix((spread[upto[1:]] - spread[upto[:-1]]) + np.diff(upto).astype(np.uint64))
        yield piece, [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], keys.view(np.int64)


def _once(items: list[np.ndarray], keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, set) of the non-empty sets, each class once."""
    return list({k: s for k, s in zip(keys.tolist(), items, strict=True) if len(s)}.items())


def _slots(fingerprints: np.ndarray) -> np.ndarray:
    return words.mix(fingerprints) >> np.uint64(64 - BITS)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITS bits with the given slots set, at most 2^(BITS - 6) rows to the driver."""
    rows = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).collect()
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _set_in(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, cls): the size and class key of each row's set; equal sets have equal keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, items, keys in _sets(batch):
                yield pa.RecordBatch.from_pydict({id_col: piece.column(0), "n_shingles": pa.array([len(s) for s in items], pa.int64()), "cls": pa.array(keys)})

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_shingles bigint, cls bigint")


def _parts(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) by the high bits of the elements."""
    element = values["element"] if values.dtype.names else values
    bucket = (element >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, part in zip(found.tolist(), np.split(values[order], first[1:])):
        yield b, part


def _chain_parts(chain: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, pairs) by a hash of the pair, so that no bucket gets the chains of all classes."""
    pairs = np.unique(np.sort(chain.astype("<u8"), axis=1), axis=0)
    bucket = (words.mix(pairs[:, 0] ^ words.mix(pairs[:, 1])) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pairs), np.int64)
    for b in np.unique(bucket).tolist():
        yield b, pairs[bucket == b]


def frequent(docs: DataFrame, bits: int, text_col: str) -> np.ndarray:
    """A bitmap of the elements that more than LIST classes hold."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, items, keys in _sets(batch):
                own = [s for _, s in _once(items, keys)]
                if own:
                    values, n = np.unique(np.concatenate(own), return_counts=True)
                    values = np.repeat(values, np.minimum(n, LIST + 1))
                    rows = [(b, (p >> np.uint64(32 - bits)).astype("<u4").tobytes()) for b, p in _parts(values, bits)]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        values, n = np.unique(np.frombuffer(b"".join(rows["data"].to_pylist()), "<u4"), return_counts=True)
        fingerprint = np.uint64(key[0].as_py() << 32) | values[n > LIST].astype(np.uint64)
        return pa.table({"slot": pa.array(_slots(fingerprint).astype(np.int64))})

    dealt = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")).mapInArrow(deal, "bucket bigint, data binary")
    return _bitmap(dealt.groupBy("bucket").applyInArrow(count, "slot bigint"))


def candidates(docs: DataFrame, bits: int, often: np.ndarray, text_col: str) -> DataFrame:
    """(a, b): pairs of classes that share SHARED short lists, and chains along long ones."""
    sent = docs.sparkSession.sparkContext.broadcast(often)  # 2^BITS bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, items, keys in _sets(batch):
                own = _once(items, keys)
                short = []
                for key, s in own:
                    late = _set_in(sent.value, _slots(s >> np.uint64(32 - bits)))
                    take = np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])[: len(s) // 4 + SHARED]
                    part = np.empty(len(take), _POSTING)
                    part["element"], part["cls"], part["n"] = s[take], np.int64(key).astype(np.uint64), len(s)
                    short.append(part)
                if not short:
                    continue
                values = np.concatenate(short)
                # a list that is long within this slice is chained here, and one class stands for the rest
                values = values[np.lexsort((values["cls"], values["element"]))]
                first = np.flatnonzero(np.concatenate([[True], values["element"][1:] != values["element"][:-1]]))
                size = np.diff(np.append(first, len(values)))
                member = np.repeat(size > LIST, size)
                head = np.repeat(values["cls"][first], size)
                chain = np.unique(np.stack([head[member], values["cls"][member]], axis=1), axis=0)
                lone = np.ones(len(values), bool)
                lone[member] = False
                # LIST + 1 stay, so that the list is seen to be long in its bucket as well
                place = np.arange(len(values)) - np.repeat(first, size)
                rows = [(b, p.tobytes(), b"") for b, p in _parts(values[lone | (place <= LIST)], bits)]
                rows += [(b, b"", p.tobytes()) for b, p in _chain_parts(chain, bits)]
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(("bucket", "data", "chain"), zip(*rows), (pa.int64(), pa.binary(), pa.binary()), strict=True)})

    def pair(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        chain = np.frombuffer(b"".join(rows["chain"].to_pylist()), "<u8").reshape(-1, 2)
        values = np.unique(np.frombuffer(b"".join(rows["data"].to_pylist()), _POSTING))
        first = np.flatnonzero(np.concatenate([[True], values["element"][1:] != values["element"][:-1]])) if len(values) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(values)))
        a, b, needs = [chain[:, 0]], [chain[:, 1]], [np.ones(len(chain), np.int64)]
        for s in np.unique(size[(size > 1) & (size <= LIST)]).tolist():
            lists = values[first[size == s][:, None] + np.arange(s)]
            i, j = np.triu_indices(s, 1)
            x, y = lists[:, i].ravel(), lists[:, j].ravel()
            less, more = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"]).astype(np.int64)
            ok = 4 * less >= 3 * more
            a.append(x["cls"][ok])
            b.append(y["cls"][ok])
            needs.append(np.minimum(SHARED, (3 * more[ok] + 3) // 4))
        sure = len(chain)
        for f, s in zip(first[size > LIST].tolist(), size[size > LIST].tolist()):
            a.append(np.repeat(values["cls"][f : f + 1], s - 1))
            b.append(values["cls"][f + 1 : f + s])
            needs.append(np.full(s - 1, -1))
        a, b, needs = np.concatenate(a).astype(np.uint64).view(np.int64), np.concatenate(b).astype(np.uint64).view(np.int64), np.concatenate(needs)
        needs[:sure] = -1
        table = np.stack([np.minimum(a, b), np.maximum(a, b), needs], axis=1)
        table, n = np.unique(table, axis=0, return_counts=True) if len(table) else (table, np.zeros(0, np.int64))
        n = np.where(table[:, 2] < 0, _SURE, n)
        return pa.table({"a": pa.array(table[:, 0]), "b": pa.array(table[:, 1]), "need": pa.array(np.abs(table[:, 2])), "n": pa.array(n)})

    dealt = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")).mapInArrow(deal, "bucket bigint, data binary, chain binary")
    found = dealt.groupBy("bucket").applyInArrow(pair, "a bigint, b bigint, need bigint, n bigint")
    return found.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("n").alias("n")).where("n >= need and a <> b").select("a", "b")


def kept_sets(docs: DataFrame, members: DataFrame, text_col: str) -> DataFrame:
    """(cls, n, data): the sets of the classes in ``members``, each once."""
    slots = members.mapInArrow(_member_slots, "slot bigint")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(slots))  # 2^BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, items, keys in _sets(batch):
                there = _set_in(sent.value, _slots(keys.view(np.uint64)))
                own = _once([s for s, t in zip(items, there) if t], keys[there])
                yield pa.RecordBatch.from_pydict({
                    "cls": pa.array([k for k, _ in own], pa.int64()), "n": pa.array([len(s) for _, s in own], pa.int64()),
                    "data": pa.array([s.astype("<u8").tobytes() for _, s in own], pa.binary()),
                })

    found = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "cls bigint, n bigint, data binary")
    # a class that many slices hold is thinned out in each task before it moves
    return found.dropDuplicates(["cls"]).join(members, "cls")


def _member_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"slot": pa.array(_slots(batch.column(batch.schema.get_field_index("cls")).to_numpy().view(np.uint64)).astype(np.int64))})


class Lists:
    """Inverted lists of some sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.members = owner[order]  # rising within each list
        new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.append(self.first, len(flat)))
        number = np.cumsum(new) - 1
        self.keys = number * len(sets) + self.members  # (list, member) in rising order, for probes
        self.of = np.empty(len(flat), np.int64)
        self.of[order] = number
        self.ends = np.cumsum(self.sizes)

    def lists_of(self, x: int) -> np.ndarray:
        return self.of[self.ends[x] - self.sizes[x] : self.ends[x]]

    def search(self, x: int, skip) -> Iterator[int]:
        """Members y with 7 |x & y| >= 3 (|x| + |y|), but for those that ``skip`` names."""
        own = self.lists_of(x)
        n = len(own)
        own = own[np.argsort(self.length[own], kind="stable")]
        least = -(-3 * n // 4)
        short, long = own[: n - least + 1], own[n - least + 1 :]  # a partner is on one short list at least
        short = short[self.length[short] > 1]
        parts = [self.members[a : a + k] for a, k in zip(self.first[short].tolist(), self.length[short].tolist())]
        total = sum(map(len, parts))
        if total <= 4096:
            found = Counter(heapq.merge(*(p.tolist() for p in parts)))
        else:
            n_on = np.bincount(np.concatenate(parts), minlength=len(self.sizes))
            found = {y: int(n_on[y]) for y in np.flatnonzero(n_on).tolist()}
        for y, count in found.items():
            size = int(self.sizes[y])
            need = -(-3 * (n + size) // 7)
            if y == x or 4 * min(n, size) < 3 * max(n, size) or count + len(long) < need or skip(y):
                continue
            probe = long * len(self.sizes) + y
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            if count + int((self.keys[at] == probe).sum()) >= need:
                yield y

    def heart(self) -> int:
        """The member on the longest lists, on average."""
        weight = np.add.reduceat(self.length[self.of].astype(float), self.ends - self.sizes)
        return int((weight / self.sizes).argmax())


def _search(rows: pa.Table) -> pa.Table:
    """Links (a, b) that tie together the members of a block; ``comp`` tells what is tied already."""
    keys = rows["cls"].to_pylist()
    sets = [np.frombuffer(d, "<u8") for d in rows["data"].to_pylist()]
    asks = rows["asks"].to_pylist()
    forest, known, links = Forest(len(keys)), {}, []
    for i, c in enumerate(rows["comp"].to_pylist()):
        forest.join(known.setdefault(c, i), i)
    lists = Lists(sets)

    def ask(x: int) -> None:
        for y in lists.search(x, lambda y: forest.find(y) == forest.find(x)):
            if forest.join(x, y):
                links.append((keys[x], keys[y]))

    heart = lists.heart()
    if all(asks):
        ask(heart)
        # links are mutual: who is tied to the heart is found by those who aren't
        for x in range(len(keys)):
            if forest.find(x) != forest.find(heart):
                ask(x)
    else:
        for x in range(len(keys)):
            if asks[x]:
                ask(x)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _links(blocks: DataFrame) -> DataFrame:
    keys = ["grp", "block", "guest"]
    # dealt by all three: grouping alone would keep a join's partitioning by group, and all blocks of a group in one task
    dealt = blocks.select(*keys, "cls", "comp", "asks", "data").repartition(*keys)
    return dealt.groupBy(*keys).applyInArrow(_search, "a bigint, b bigint")


def linked(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, component) of the classes that have links; ``sets`` is a stored table (cls, n, data, grp)."""
    sizes = sets.groupBy("grp").agg(F.sum("n").alias("all"))
    cut = sets.join(sizes, "grp").withColumn("blocks", F.expr(f"cast((all + {block} - 1) div {block} as int)"))
    cut = cut.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cls"), F.col("blocks"))).otherwise(0).cast("int")).drop("all")
    found = materialize(_links(cut.select("*", F.lit(0).alias("guest"), F.col("cls").alias("comp"), F.lit(True).alias("asks"))), "links")
    large = cut.where("blocks > 1")
    if not large.limit(1).count():
        return components(found)
    large = materialize(large, "large-groups")

    def tied(links: DataFrame) -> DataFrame:
        done = components(links).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
        return materialize(large.join(done, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "tied")

    def asked(now: DataFrame, who: DataFrame) -> DataFrame:
        """Links between ``who`` and all blocks of their groups but their own."""
        parts = who.groupBy("grp").agg(F.expr(f"cast((sum(n) + {block} - 1) div {block} as int)").alias("parts"))
        who = who.join(parts, "grp").withColumn("guest", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int")).drop("parts")
        now = now.join(parts, "grp").withColumn("guest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        guests = who.withColumn("home", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        guests = guests.where("block <> home").drop("home").withColumn("asks", F.lit(True))
        return materialize(_links(now.withColumn("asks", F.lit(False)).unionByName(guests)), "links")

    def main_of(now: DataFrame) -> DataFrame:
        counts = now.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("k"))
        return counts.groupBy("grp").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))

    now = tied(found)
    least = now.join(main_of(now), "grp").where("comp = main").groupBy("grp", "block").agg(F.min("cls").alias("cls")).groupBy("grp").agg(F.slice(F.sort_array(F.collect_set("cls")), 1, LEADERS).alias("lead"))
    leaders = now.join(least.select("grp", F.explode("lead").alias("cls")), ["grp", "cls"])
    found = found.unionByName(asked(now, leaders.select(*now.columns)))
    discard(now)
    now = tied(found)
    rest = now.join(main_of(now), "grp").where("comp <> main").select(*now.columns)
    out = components(found.unionByName(asked(now, rest)))
    for sets in (large, now):
        discard(sets)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id reachable by links).

    Links join sets of five-word shingles with 100 |x & y| >= 75 |x or y|. A text with
    fewer words has one element, one without words (null, empty, blank) none and no
    link: its component is its own id. Equal ids are rows of their own. Where all ids of a component are
    null, so is component_id. Sets are held as 64-bit hashes of shingles. Columns other than the two named are not
    read, and these may have any names.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(classes(named, "id", "text"), "classes")
    total = rows.where("n_shingles > 0").agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1, total / BUCKET)))))
    pairs = materialize(candidates(named, bits, frequent(named, bits, "text"), "text"), "pairs")
    groups = materialize(components(pairs).select(F.col("node").alias("cls"), F.col("component").alias("grp")), "groups")
    discard(pairs)
    sets = materialize(kept_sets(named, groups, "text"), "sets")
    ties = linked(sets, block)
    discard(sets)  # links and components are stored
    of = rows.join(ties.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = of.where("n_shingles > 0").groupBy("component").agg(F.min("id").alias("least"))
    least = materialize(least, "least")  # stored, so that the join's shuffles stand alone and a hot component is split
    out = of.where("n_shingles > 0").join(least, "component").select("id", "n_shingles", "least")
    out = out.unionByName(of.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("least")))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the least id; columns stay, whatever their names.

    Rows without words, linked with nothing, all stay. A row with a null id stays only if its whole component has
    null ids. Of several rows with the least id one stays, whole. Rows are numbered in a stored copy of ``docs``.
    """
    row, own = (next(n for k in range(len(docs.columns) + 1) if (n := f"_{name}{k}") not in docs.columns) for name in ("row", "own"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard_components(numbered, row, text_col).select(F.col(row).alias("r"), F.col("component_id").alias("c"))
    ids = numbered.select(F.col(row).alias("r"), F.col(f"`{id_col}`").alias("i"))
    first = F.min(F.struct(F.col("i").isNull(), "i", "r"))
    # stored, so that its size is known before texts are dealt: below Spark's threshold it is broadcast
    stay = materialize(found.join(ids, "r").groupBy("c").agg(first.alias("s")).select(F.col("s.r").alias(own)), "stay")
    return numbered.join(stay, numbered[row] == stay[own], "left_semi").select(*[numbered[f"`{c}`"] for c in docs.columns])
