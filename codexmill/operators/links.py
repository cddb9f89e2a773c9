"""Links in page sources: extraction, filtering, first-occurrence dedup and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import stored
from . import layout

# Fixed value: a link to an article, with its query.
ARTICLE_LINK = r"caricaArticolo\?([^'\"]+)"


def extract(pages: DataFrame, pattern: str, html: str = "html", out: str = "link") -> DataFrame:
    """One row per match of group 1, with its position ``pos`` (from 0); the source column goes."""
    found = pages.withColumn("_all", F.regexp_extract_all(html, F.lit(pattern), 1)).drop(html)
    rest = [c for c in found.columns if c != "_all"]
    return found.select(*rest, F.posexplode("_all").alias("pos", out))


def first_of(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row of each key. Only the key and a struct of the row travel, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("_row"))
    return first.select(*keys, "_row.*").select(*rows.columns)


def numeric_place(rows: DataFrame, keys: list[str], within: list[str], out: str = "place", ranges: int | None = None) -> DataFrame:
    """Place of each row within its group when keys (strings) are sorted as integers; non-numbers first, as nulls.

    With ``ranges`` rows are dealt into so many ordered ranges and numbered in each, and a range starts at the number of rows that
    earlier ranges have of its group; so neither a large group nor one place in all rows (``within`` empty) needs a task that holds it.
    """
    order = [F.col(k).try_cast("bigint") for k in keys]
    if ranges is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
    placed = layout.in_ranges(rows, within, order, ranges)
    placed = stored(placed.withColumn(out, F.row_number().over(Window.partitionBy(layout.RANGE, *within).orderBy(*order)).cast("long")), "ranges")
    sizes = placed.groupBy(layout.RANGE, *within).agg(F.count(F.lit(1)).alias("_n"))
    joined = layout.with_earlier(placed, layout.from_earlier(sizes, within, _before=F.sum("_n")), within)
    return joined.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_before", layout.RANGE)


def article_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Article links of table-of-contents pages: nine columns, first per (keys, article, sub-article).

    ``keys`` name the columns that separate laws and sources. Links of another kind than "0" go.
    """
    raw = extract(pages.select(*keys, html), ARTICLE_LINK, html, "query")
    query = F.rtrim("query", F.lit("&"))
    rows = raw.where(S.query_get(query, "flagTipoArticolo") == "0")
    rows = rows.select(*keys, "pos", *[S.query_get(query, k).alias(k) for k in S.LINK_KEYS])
    rows = rows.withColumn("progressivo", S.default_if_empty(F.col("progressivo"), "0"))
    return first_of(rows, [*keys, "idArticolo", "idSottoArticolo"])


def split_numeric(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links whose ids are integers, in order; the others, for quarantine).

    Links with equal ids are in the order of their columns from left to right, so that none of the few pairs of ids is one task's work.
    """
    a, b = F.col("idArticolo").try_cast("int"), F.col("idSottoArticolo").try_cast("int")
    good = a.isNotNull() & b.isNotNull()
    return links.where(good).orderBy(a, b, *links.columns), links.where(~good)


def with_names(links: DataFrame, laws: DataFrame, more_suffixes: bool = False) -> DataFrame:
    """Links with label, url, filename and the columns of their law (a small table of fixed size)."""
    named = links.withColumns({
        "label": S.article_label(F.col("idArticolo"), F.col("idSottoArticolo"), more_suffixes),
        "url": S.article_url(),
        "filename": S.file_name(F.col("idArticolo"), F.col("idSottoArticolo")),
    })
    return named.join(F.broadcast(laws), "law", "left")
