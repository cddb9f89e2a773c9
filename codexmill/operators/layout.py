"""Joins and scans over rows that have a place: as-of, carry-forward, first below.

The scans of ordered rows (``nearest_before``, ``segment``, ``links.numeric_place``) sort the rows of a key in one task. With
``ranges`` they work on two levels instead: rows are cut into that many ordered ranges, wherever keys begin or end, each range
is scanned by itself, and what it hands on to the next (a last header, a count) goes through a table with a row for each key of each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import stored

RANGE = "_range"


def assemble(rows: DataFrame, keys: list[str], height: str, text: str, order: list[str], sep: str = " ") -> DataFrame:
    """Rows with one half-even rounded height become a line: (keys, y, line), texts in the given order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    line = F.array_join(F.transform(parts, lambda x: x["_t"]), sep)
    return rows.groupBy(*keys, S.half_even(F.col(height)).alias("y")).agg(line.alias("line"))


def headers(lines: DataFrame, keys: list[str], pattern: str = S.HEADER) -> DataFrame:
    """(keys, y, qid, topic) of lines that hold a header."""
    found = lines.where(F.col("line").rlike(pattern))
    return found.select(*keys, "y", F.regexp_extract("line", pattern, 1).alias("qid"), S.strip(F.regexp_extract("line", pattern, 2)).alias("topic"))


def in_ranges(rows: DataFrame, keys: list[str], order: list[Column | str], ranges: int) -> DataFrame:
    """The rows with ``_range``: ranges follow the order of keys and, within a key, the given order. Bounds come from a sample that Spark takes, so ranges are about equal."""
    return rows.repartitionByRange(ranges, *keys, *order).withColumn(RANGE, F.spark_partition_id())


def from_earlier(pieces: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Of (range, keys, ...) rows, one for each key of each range, those with an earlier range of the same key, and ``values`` over these.

    A key has at most as many rows here as there are ranges.
    """
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    found = pieces.withColumns({"_nth": F.row_number().over(Window.partitionBy(*keys).orderBy(RANGE)), **{name: v.over(earlier) for name, v in values.items()}})
    return found.where("_nth > 1").select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(RANGE).alias("_of_range"), *values)


def with_earlier(rows: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what earlier ranges of their key hand on, null where there is none."""
    same = F.col(RANGE) == F.col("_of_range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(earlier, same, "left").drop("_of_range", *[f"_of_{k}" for k in keys])


def _nearest(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, carry: list[str], order: list[str], after: bool, ranges: int | None) -> DataFrame:
    first = marks.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.min(F.struct(*order, *[F.col(c).alias(f"_carry_{c}") for c in carry])).alias("_mark"))
    one = rows.select(*keys, at, F.struct(*rows.columns).alias("_row"))
    both = one.withColumn("_late", F.lit(0)).unionByName(first.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    # the side that is looked at comes first in the order, and rows come before marks of their own place
    placed: list[Column | str] = [F.col(at).desc() if after else F.col(at), "_late"]
    by = [*keys]
    if ranges is not None:
        both, by = in_ranges(both, keys, placed, ranges), [RANGE, *keys]
    upto = Window.partitionBy(*by).orderBy(*placed).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_mark", ignorenulls=True).over(upto))
    if ranges is not None:
        both = stored(both, "ranges")
        # of the marks of a range, the last in its order
        latest = (F.min if after else F.max)(F.when(F.col("_mark").isNotNull(), F.struct(at, "_mark")))
        pieces = both.groupBy(RANGE, *keys).agg(latest.alias("_piece"))
        both = with_earlier(both, from_earlier(pieces, keys, _before=F.last("_piece", ignorenulls=True)), keys)
        both = both.withColumn("_last", F.coalesce("_last", "_before._mark"))
    last = F.when(F.col(at).isNotNull(), F.col("_last"))
    return both.where("_late = 0").select("_row.*", *[last[f"_carry_{c}"].alias(c) for c in carry])


def nearest_before(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, carry: list[str], ranges: int | None = None) -> DataFrame:
    """Each row with columns ``carry`` of the last mark strictly before it, null if there is none or its place is null.

    Marks and rows are put in one order, in which rows come before marks of the same place; of marks at one place
    the first in the order of ``carry`` wins, as the first of equal maxima does.
    """
    return _nearest(rows, marks, keys, at, carry, [], False, ranges)


def nearest_after(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, order: list[str], carry: list[str], ranges: int | None = None) -> DataFrame:
    """Each row with ``carry`` of the first mark strictly after it, of marks at one place the first by ``order``; null if there is none.

    One backward scan over rows and marks: no row meets more than one mark.
    """
    return _nearest(rows, marks, keys, at, carry, order, True, ranges)


def unclaimed(marks: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """Marks whose keys no row has claimed."""
    return marks.join(claimed.select(*keys), keys, "left_anti")


def segment(rows: DataFrame, keys: list[str], order: list[Column | str], header: Column, out: str = "seq", ranges: int | None = None) -> DataFrame:
    """Number of the segment of each row: one more wherever the header differs from the current one.

    ``header`` is null for rows that start nothing; rows before the first header get 0. The
    current header is added as ``<out>_header``.
    """
    by = [*keys]
    if ranges is not None:
        rows, by = in_ranges(rows, keys, order, ranges), [RANGE, *keys]
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = Window.partitionBy(*by).orderBy(*order)
    scanned = rows.withColumn("_now", F.last(header, ignorenulls=True).over(upto))
    if ranges is not None:
        scanned = scanned.withColumns({"_first": F.first(header, ignorenulls=True).over(upto), "_nth": F.row_number().over(plain)})
    before = F.lag("_now").over(plain)
    new = F.when(F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(before), 1).otherwise(0)
    scanned = scanned.withColumn("_new", new).withColumn(out, F.sum("_new").over(upto)).drop("_new")
    if ranges is None:
        return scanned.withColumnRenamed("_now", f"{out}_header")
    scanned = stored(scanned, "ranges")
    ends = scanned.groupBy(RANGE, *keys).agg(F.max_by(F.struct(F.col("_now").alias("last"), F.col("_first").alias("first"), F.col(out).alias("count")), "_nth").alias("_end"))
    # a range that begins with the header in force starts one segment less than it counted
    headed = from_earlier(ends, keys, _header=F.last("_end.last", ignorenulls=True))
    counts = with_earlier(ends, headed, keys)
    counts = counts.withColumn("_count", F.col("_end.count") - F.coalesce(F.col("_end.first") == F.col("_header"), F.lit(False)).cast("int"))
    joined = with_earlier(scanned, from_earlier(counts, keys, _header=F.last("_end.last", ignorenulls=True), _seen=F.sum("_count")), keys)
    again = F.coalesce(F.col("_first") == F.col("_header"), F.lit(False)).cast("int")
    number = F.col(out) + F.coalesce("_seen", F.lit(0)) - again
    return joined.withColumn(out, number).withColumn(f"{out}_header", F.coalesce("_now", "_header")).drop("_now", "_first", "_nth", "_header", "_seen", RANGE)


def first_so_far(keys: list[str], order: list[Column | str], value: Column) -> Column:
    """First non-null value from the start of the group to the current row."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def lookup_last(left: DataFrame, table: DataFrame, keys: list[str], order: str, carry: list[str]) -> DataFrame:
    """Left join to the last row of each key in ``table``; a miss gives nulls."""
    last = table.groupBy(*keys).agg(F.max_by(F.struct(*carry), order).alias("_l"))
    return left.join(last, keys, "left").select(*left.columns, *[F.col(f"_l.{c}").alias(c) for c in carry])


def content_paths(assets: DataFrame, content: str, ext: Column) -> DataFrame:
    """Assets with ``path``: the MD5 of the content and an ending; equal contents share one."""
    return assets.withColumn("path", F.concat(F.md5(content), F.lit("."), ext))
