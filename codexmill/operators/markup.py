"""Class-scoped extraction from HTML: a page's tokens are an array, and a stack machine folds over it.

``outline`` works on each row by itself: nothing is exploded, shuffled or sorted across rows. What is asked of a page
are expressions on its arrays of texts and scopes. ``tokens`` is the same tokenisation as a table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

NOT_CONTENT = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>|<[?!].*?>"
TOKEN = r'<(?:"[^"]*"|[^>"])*>|[^<]+'
# The same two for Java, which runs through these without a choice at each character.
_NOT_CONTENT = r"(?is)<(?:!--.*?-->|(?:script|style)\b.*?</(?:script|style)>|[?!].*?>)"
_REST = r'[^">]*+(?:"[^"]*+"[^">]*+)*+>'
_TOKEN = rf"<{_REST}|[^<]++"
_NAME = r"^</?\s*([A-Za-z][A-Za-z0-9:-]*)"
_CLASS = r"""(?i)\sclass\s*=\s*["']([^"']*)"""
# Elements that have no end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

#: Which elements are wanted, by their tag and their classes.
Wanted = Callable[[Column, Column], Column]


def _content(html: Column) -> Column:
    """A page without its comments, scripts, styles and declarations."""
    page, lower = F.coalesce(html, F.lit("")), F.lower(html)
    # most texts need no search
    holds = [F.contains(page, F.lit("<!")), F.contains(page, F.lit("<?")), F.contains(lower, F.lit("<script")), F.contains(lower, F.lit("<style"))]
    return F.when(reduce(or_, holds), F.regexp_replace(page, _NOT_CONTENT, "")).otherwise(page)


def token_array(html: Column) -> Column:
    return F.regexp_extract_all(_content(html), F.lit(_TOKEN), 0)


def _markup(raw: Column) -> Column:
    return F.coalesce(raw.startswith("<"), F.lit(False))


def _tag(raw: Column) -> Column:
    return F.when(_markup(raw), F.lower(F.regexp_extract(raw, _NAME, 1)))


def _kind(raw: Column, tag: Column) -> Column:
    return F.when(~_markup(raw), "text").when(raw.startswith("</"), "close").when(tag.isin(VOID) | raw.endswith("/>"), "void").otherwise("open")


def _classes(raw: Column) -> Column:
    opens = _markup(raw) & ~raw.startswith("</")
    return F.when(opens, _names(raw)).when(_markup(raw), F.array().cast("array<string>"))


def _names(opening: Column) -> Column:
    """The class names of an opening tag."""
    found = F.regexp_extract_all(F.regexp_extract(opening, _CLASS, 1), F.lit(r"\S+"), 0)
    return F.when(F.contains(opening, F.lit("=")), found).otherwise(F.array().cast("array<string>"))


def tokens(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, i, kind, tag, cls, s): kind is open, void, close or text; s is a text token's stripped text.

    A page without tokens has one row, of kind text without a text.
    """
    raw = pages.select(*keys, F.posexplode_outer(token_array(F.col(html))).alias("i", "raw"))
    text, tag = F.col("raw"), _tag(F.col("raw"))
    return raw.select(*keys, F.coalesce("i", F.lit(0)).alias("i"), _kind(text, tag).alias("kind"), tag.alias("tag"), _classes(text).alias("cls"), F.when(~_markup(text), S.strip(S.decode_entities(text))).alias("s"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Openings and closings of a page are one text: "<tag place!" for a wanted element, "<tag place." for another, "place/tag " for a closing.
#: An opening and a closing of its tag next to it are a pair, which bears on no other; without them their neighbours may be one.
_PAIR = r"<([^ <]*+) [0-9]++[!.][0-9]++/\1 "
_WANTED_PAIR = r"<(([^ <]*+) [0-9]++![0-9]++)/\2 "
_ENTRY = r"<[^ <]*+ [0-9]++[!.]|[0-9]++/[^ ]*+ "
#: So many times pairs are taken out; what is left, the outer elements and those that don't nest, goes to the fold.
_ROUNDS = 4


def _entry(wanted: Wanted) -> Callable[[Column, Column], Column]:
    def entry(raw: Column, place: Column) -> Column:
        tag, at = F.lower(F.regexp_extract(raw, _NAME, 1)), place.cast("string")
        opening = lambda t: F.concat(F.lit("<"), t, F.lit(" "), at, F.when(wanted(t, _names(raw)), "!").otherwise("."))
        opens = raw.startswith("<") & ~raw.endswith("/>")
        return F.when(raw.startswith("</"), F.concat(at, F.lit("/"), tag, F.lit(" "))).when(opens, once(tag, lambda t: F.when(t.isin(VOID), "").otherwise(opening(t)))).otherwise("")

    return entry


def _step(state: Column, entry: Column) -> Column:
    """One opening or closing: an opening goes onto the stack, a closing takes off all down to the last opening of its tag.

    The stack is a text of openings, the last one first: each step copies the state, and a text is one copy. What is taken off is done, the
    wanted ones with the closing's place after their mark. A closing without an opening changes nothing.
    """
    stack, done = state["stack"], state["done"]

    def become(stack: Column, done: Column) -> Column:
        return F.struct(stack.alias("stack"), done.alias("done"))

    def taken(n: Column) -> Column:
        ended = F.replace(F.substring(stack, F.lit(1), n), F.lit("!"), F.concat(F.lit("!"), F.substring_index(entry, "/", 1), F.lit(";")))
        return become(F.substring(stack, n + 1, F.length(stack)), F.concat(done, ended))

    at = F.position(F.concat(F.lit("<"), F.substring_index(entry, "/", -1)), stack)
    through = lambda at: F.coalesce(F.nullif(F.position(F.lit("<"), stack, at + 1), F.lit(0)) - 1, F.length(stack))
    return F.when(entry.startswith("<"), become(F.concat(entry, stack), done)).otherwise(once(at, lambda at: F.when(at > 0, once(through(at), taken)).otherwise(state)))


def outline(pages: DataFrame, keys: list[str], wanted: Wanted, html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``pages``: keys, ``carry``, ``texts`` (of each token its stripped string, null for markup) and ``scopes``.

    Scopes are the elements whose opening is wanted, in order: open_i, close_i, tag, cls, where texts open_i + 1 to
    close_i - 1 lie within. They nest as a stack of open elements has it: an end tag closes its element and all that are still
    open within it; one without an open element is passed over. An element that is never closed reaches to the end of
    the page (close_i null). A null page has neither texts nor scopes. Work on a page grows with its tokens, times the elements open at once.
    """
    rows = pages.select(*keys, *carry, token_array(F.col(html)).alias("_tokens"))
    text = F.transform("_tokens", lambda x: F.when(~x.startswith("<"), S.strip(S.decode_entities(x))))
    rows = rows.withColumns({"texts": text, "_left0": F.array_join(F.transform("_tokens", _entry(wanted)), "")})
    for n in range(_ROUNDS):
        rows = rows.withColumns({f"_left{n + 1}": F.regexp_replace(f"_left{n}", _PAIR, ""), f"_pairs{n}": F.regexp_extract_all(f"_left{n}", F.lit(_WANTED_PAIR), 1)})
    start = F.struct(F.lit("").alias("stack"), F.lit("").alias("done"))
    rows = rows.withColumn("_end", F.aggregate(F.regexp_extract_all(f"_left{_ROUNDS}", F.lit(_ENTRY), 0), start, _step))
    unclosed = F.replace("_end.stack", F.lit("!"), F.lit("!;"))
    folded = F.regexp_extract_all(F.concat("_end.done", unclosed), F.lit("<([^ <]*+ [0-9]++![0-9]*+);"), 1)

    def scope(pair: Column) -> Column:
        tag, open_i, close_i = F.substring_index(pair, " ", 1), F.substring_index(F.substring_index(pair, " ", -1), "!", 1).cast("int"), F.substring_index(pair, "!", -1).try_cast("int")
        return F.struct(open_i.alias("open_i"), close_i.alias("close_i"), tag.alias("tag"), _names(F.get("_tokens", open_i)).alias("cls"))

    found = F.sort_array(F.transform(F.concat(*[f"_pairs{n}" for n in range(_ROUNDS)], folded), scope))
    # as the one row of a generator, so that no later filter repeats the fold
    return rows.select(*keys, *carry, F.inline(F.array(F.struct("texts", found.alias("scopes")))))


def any_class(*names: str) -> Wanted:
    """Elements that bear one of the classes."""
    return lambda tag, cls: F.arrays_overlap(cls, F.array(*map(F.lit, names)))


def any_tag(*names: str) -> Wanted:
    return lambda tag, cls: tag.isin(*names)


def with_class(name: str) -> Column:
    """The scopes of a page that bear a class."""
    return F.filter("scopes", lambda x: F.array_contains(x["cls"], name))


def with_tag(name: str) -> Column:
    return F.filter("scopes", lambda x: x["tag"] == name)


def within(inner: Column, outer: Column) -> Column:
    """Those scopes of an array that open within another one."""
    return F.filter(inner, lambda x: (x["open_i"] > outer["open_i"]) & (outer["close_i"].isNull() | (x["open_i"] < outer["close_i"])))


def text_of(scope: Column, sep: str) -> Column:
    """A scope's stripped strings, blank ones left out, joined by ``sep``; null if there is no scope."""

    def joined(x: Column) -> Column:
        size = F.coalesce(x["close_i"], F.size("texts")) - x["open_i"]
        return F.array_join(F.array_remove(F.slice(F.col("texts"), x["open_i"] + 1, size), ""), sep)

    return once(scope, joined)
