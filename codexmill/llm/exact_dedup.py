"""Exact dedup by deterministic block naming, with DataFrame functions only.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and numbered, so that two blocks have one integer name exactly when their
bytes are equal. Then adjacent pairs of names get names in the same manner, again
and again, until each text has one name left: its collision-free identity among the
texts of its length. No decision rests on a hash: hashes only deal out the work.

Only distinct keys are named: every task first makes the sets of its own keys by bucket of
their hash, and the sets are joined by a shuffle and sorted. So a key that fills a third of the
table costs one entry a task. Names go back to rows by the key's hash where the bucket shows that no two of its keys
share one, and by the whole key in all other buckets. The table of names is stored, so that this join is
two plain shuffles, and adaptive execution splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

BLOCK_BYTES = 8192
#: More buckets than tasks: a bucket is sorted as one array, of 25 MB or so if there are 100 TB of distinct blocks.
BUCKETS = 1 << 22
#: Repeated rows that are made at once.
SHARE = 1 << 16


def _hash(key: str) -> Column:
    return F.xxhash64(key)


def _named(df: DataFrame, key: str) -> DataFrame:
    """Replace column ``key`` by a long ``name``: bucket * 2^40 + the key's place in it; equal keys and only these share one."""
    hashed = df.withColumn("_h", _hash(key))
    sets = hashed.groupBy(F.pmod("_h", F.lit(BUCKETS)).alias("_b")).agg(F.sort_array(F.collect_set(key)).alias("_keys"))
    clash = F.size(F.array_distinct(F.transform("_keys", lambda x: _hash(x)))) < F.size("_keys")
    each = sets.select("_b", clash.alias("_clash"), F.posexplode("_keys").alias("_place", "_key"))
    names = each.select(
        _hash("_key").alias("_h"), (F.shiftleft("_b", 40) + F.col("_place")).alias("name"), "_clash", F.when(F.col("_clash"), F.col("_key")).alias("_key")
    )
    names = materialize(names, "names")
    out = hashed.drop(key).join(names.where("not _clash").select("_h", "name"), "_h").drop("_h")
    clashes = names.where("_clash").select("_h", F.col("_key").alias(key), "name")
    if clashes.limit(1).count():
        out = out.unionByName(hashed.join(clashes, ["_h", key]).drop("_h", key))
    return out


def text_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, sha, n_bytes, name, copies) for each distinct (id, text) of ``docs``.

    (n_bytes, name) is equal for two rows exactly when their texts are. ``sha`` is
    the SHA-256 of the text: it is part of the result, and it tells rows apart that
    share an id. ``copies`` counts repeated rows of equal id and text.
    """
    data = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), data.alias("data"))
    base = base.select("id", "data", F.octet_length("data").cast("long").alias("n_bytes"))
    last = F.greatest(F.lit(0), F.expr(f"cast((n_bytes - 1) div {block_bytes} as int)"))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))
    shaped = base.select("id", F.unhex(F.sha2("data", 256)).alias("sha"), "n_bytes", (last + 1).cast("long").alias("left"), F.posexplode(blocks).alias("pos", "block"))
    level = materialize(_named(shaped, "block").withColumn("copies", F.lit(1).cast("long")), "block-names")
    done = []
    most = level.agg(F.max("left")).first()[0] or 1
    while True:
        done.append(level.where("left = 1").groupBy("id", "sha", "n_bytes", "name").agg(F.sum("copies").alias("copies")))
        if most <= 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            level.where("left > 1").groupBy("id", "sha", "n_bytes", F.expr("cast((left + 1) div 2 as bigint)").alias("left"), F.expr("cast(pos div 2 as int)").alias("pos"))
            .agg(F.struct(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")).alias("pair"), F.sum(F.when(even, F.col("copies")).otherwise(0)).alias("copies"))
        )
        level = materialize(_named(pairs, "pair"), "pair-names")
        most = (most + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; a null text counts as empty. Of
    equal texts the row with the largest id stays; if several rows with that id hold
    the text, one of them. Rows with a null id come last: such a row stays only if
    its whole group has null ids. An empty table gives an empty result, and columns
    other than the two named ones are not read.
    """
    same = materialize(text_identities(docs, id_col, text_col, block_bytes), "identities")
    groups = same.groupBy("n_bytes", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialize(groups, "groups")  # stored, so that the join's shuffles stand alone and a hot group is split
    rows = same.join(groups, ["n_bytes", "name"])
    # repeated rows come back in shares, so that no row holds an array of them all
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {SHARE}"))).alias("share"))
    rows = rows.select("*", F.explode(F.sequence(F.col("share") * SHARE + 1, F.least(F.col("share") * SHARE + SHARE, F.col("copies")))).alias("copy"))
    return rows.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the largest id; columns stay, whatever their names.

    Of several rows with that id and text one stays, whole. A null text counts as empty; a row with a null id stays
    only if its whole group has null ids.
    """
    # rows and kept ones meet by one key, a struct, whose nulls are equal: dealt by it once, texts aren't dealt again for repeated rows
    key = next(n for k in range(len(docs.columns) + 1) if (n := f"_key{k}") not in docs.columns)
    sha = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256))
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.struct(F.col(f"`{id_col}`").alias("i"), F.unhex("text_sha256").alias("s")).alias("_k"))
    marked = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("i"), sha.alias("s")))
    once = marked.dropDuplicates([key])  # each task drops its repeated rows before it deals any
    return once.join(kept, once[key] == kept["_k"], "left_semi").drop(key)
