"""Article records from pages of a law, by CSS class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import markup as M

# Classes of the article markup.
NUMBER, HEADING, PREAMBLE = "article-num-akn", "article-heading-akn", "article-pre-comma-text-akn"
COMMA, COMMA_NUMBER, COMMA_TEXT, REPEALED, REPEALED_ARTICLE = "art-comma-div-akn", "comma-num-akn", "art_text_in_comma", "abrogato", "art_abrogato-akn"
_ALL = [NUMBER, HEADING, PREAMBLE, COMMA, COMMA_NUMBER, COMMA_TEXT, REPEALED, REPEALED_ARTICLE]


def is_article(html: str = "html") -> Column:
    return F.coalesce(F.contains(F.col(html), F.lit(NUMBER)), F.lit(False))


def split_valid(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that hold an article, the rejected ones)."""
    return pages.where(is_article()), pages.where(~is_article())


def _commas() -> Column:
    """For every comma its place and its text; the text is null if the comma holds no text span."""

    def one(comma: Column) -> Column:
        first = lambda name: F.get(M.within(F.col(name), comma), F.lit(0))
        prefix = M.once(first("numbers"), lambda x: F.when(x.isNotNull(), F.concat(M.text_of(x, ""), F.lit(" "))).otherwise(""))
        text = M.once(first("bodies"), lambda x: F.when(x.isNotNull(), F.concat(prefix, M.text_of(x, " "))))
        return F.struct(comma["open_i"].alias("open_i"), text.alias("text"))

    return F.transform(M.with_class(COMMA), one)


def parse(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number, title, text, paragraphs, url, scraped_at, repealed, and title_clean, repealed_article, rejected.

    ``pages`` has keys, url, html. The last three columns are additions: the title without blanks at its ends; whether the
    article itself (not one comma) is repealed; the places of commas without a text span, which the paragraphs leave out.
    Every page is worked on in its own row, without a shuffle.
    """
    mention = F.coalesce(F.contains(F.lower("html"), F.lit(REPEALED)), F.lit(False))
    found = M.outline(pages.withColumn("_mention", mention), keys, M.any_class(*_ALL), carry=("url", "_mention"))
    found = found.withColumns({"bodies": M.with_class(COMMA_TEXT), "numbers": M.with_class(COMMA_NUMBER)})

    def first_text(cls: str, sep: str) -> Column:
        return F.coalesce(M.text_of(F.get(M.with_class(cls), F.lit(0)), sep), F.lit(""))

    title = F.col("title")
    found = found.withColumns({"commas": _commas(), "title": F.trim(first_text(HEADING, ""), F.lit("()."))})
    texts = F.transform(F.filter("commas", lambda x: x["text"].isNotNull()), lambda x: x["text"])
    rejected = F.transform(F.filter("commas", lambda x: x["text"].isNull()), lambda x: x["open_i"])
    return found.select(
        *keys, S.without_prefix(first_text(NUMBER, "")).alias("number"), title, first_text(PREAMBLE, " ").alias("text"), texts.alias("paragraphs"), "url", S.iso_now().alias("scraped_at"),
        ((F.size(M.with_class(REPEALED)) > 0) | F.col("_mention")).alias("repealed"), S.strip(title).alias("title_clean"), (F.size(M.with_class(REPEALED_ARTICLE)) > 0).alias("repealed_article"), rejected.alias("rejected"),
    )


def rejected_commas(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, open_i) of commas without a text span, from the records that ``parse`` makes."""
    return records.select(*keys, F.explode("rejected").alias("open_i"))
