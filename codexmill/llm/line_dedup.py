"""Line dedup by site-relative frequency.

A line is boilerplate on a host when the pages of the host that hold it, divided by all
pages of the host, exceed a ratio. Counts are taken over all pages: lines are counted by
(host, digest) with partial sums before the shuffle, so a host with a third of all pages
is no single group. Digests are MD5 of the line, to move 16 bytes instead of the line.

The boilerplate list is small: on each host the ratios of its lines add up to the mean
number of lines on a page, so at most (lines per page / ratio) lines are over it. It is
broadcast if its measured size is under ``BROADCAST_BYTES``, else joined by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: A line on more than this share of a host's pages is dropped ...
RATIO = 0.3
#: ... if it is on so many pages at least: on tiny hosts a share means little.
MIN_PAGES = 3
BROADCAST_BYTES = 32 << 20

#: Block elements end lines; comments, scripts and styles are no text.
BREAKS = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|</?(?:html|head|title|body|nav|article|section|header|footer|main|aside|div|p|br|hr|ul|ol|li|dl|dt|dd|table|tr|td|th|h[1-6]|pre|blockquote|form)\b[^>]*>"
TAGS = r"<[^>]*>"
BLANKS = " \t\r\n\f"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty for a null or odd URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """The non-empty lines of a page's text, trimmed, in order."""
    parts = F.split(F.coalesce(html, F.lit("")), BREAKS, -1)
    texts = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, TAGS, ""), F.lit(BLANKS)))
    return F.filter(texts, lambda x: x != "")


def text_lines(text: Column) -> Column:
    """The non-empty lines of plain text, trimmed, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)))
    return F.filter(parts, lambda x: x != "")


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, digest, pages, total) of lines over the ratio; ``pages`` has a host and an array of lines."""
    totals = pages.groupBy(host).agg(F.count(F.lit(1)).alias("total"))
    digests = F.array_distinct(F.transform(lines, lambda x: F.unhex(F.md5(x))))
    counts = pages.select(host, F.explode(digests).alias("digest")).groupBy(host, "digest").agg(F.count(F.lit(1)).alias("pages"))
    return counts.where(F.col("pages") >= min_pages).join(totals, host).where(F.col("pages") > F.col("total") * ratio)


def drop_lines(
    pages: DataFrame, host: Column, lines: Column, id_col: str = "page_id", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row: id, host, n_lines, n_dropped, text (the lines that stay, joined by newlines).

    A null page has no lines, a null URL the empty host; both give a row with an
    empty text. A line that a page repeats counts once for the page and is dropped or
    kept at all its places. Rows with equal ids are rows of their own. Only ``id_col`` and what
    the two expressions name is read. An empty table gives an empty result.
    """
    read = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), lines.alias("_lines"))
    found = materialize(boilerplate(read, "_host", "_lines", ratio, min_pages).select("_host", "digest"), "boilerplate")
    size = found.agg(F.sum(F.lit(64) + F.octet_length("_host"))).first()[0] or 0
    lists = found.groupBy("_host").agg(F.sort_array(F.collect_set("digest")).alias("_drop"))
    joined = read.join(F.broadcast(lists) if size <= broadcast_bytes else lists, "_host", "left")
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains(F.col("_drop"), F.unhex(F.md5(x))))
    )
    out = joined.select("_id", "_host", F.size("_lines").alias("n_lines"), kept.alias("_kept"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), "n_lines",
        (F.col("n_lines") - F.size("_kept")).alias("n_dropped"), F.array_join("_kept", "\n").alias("text"),
    )
