"""Rules of quality with thresholds that each language and source sets itself.

Statistics of a text are integers. Those of documents that pass the base rules go into quantile
sketches by language and source: counts by value, of which the six leading bits are kept, so a
quantile is off by 1/32 of its value at most. Sketches merge by adding counts, in any order and
with one result. A source's thresholds are the outer fences of its quartiles; one with few documents
takes those of its language's merged sketch, or of all documents. Documents are then joined with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Base rules: words at least, and the share (in percent) of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"
#: Leading bits that a sketch keeps of a value.
BITS = 6
#: Documents that a source, or else a language, must have for thresholds of its own.
LEAST_GROUP = 200
#: Fences lie this many interquartile ranges outside of the quartiles, but no closer to them than the tolerance of the statistic.
REACH = 3
#: Thousandths: of a character a word; of a symbol a word; of the lines; of the words. The first has a lower fence, too.
TOLERANCE = {"word_length": 500, "symbols": 100, "dup_lines": 300, "repeated": 200}
TWO_SIDED = "word_length"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row per document: id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text has no words. Lines without a word don't count. A word counts as repeated once, however many repeated
    windows hold it. Windows are told apart by 64-bit hashes of their words. Other columns go; null groups stay null.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(name) for c, name in zip(groups, ("lang", "source"))], text.alias("text"))
    bare = F.trim("text", F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACES}]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    rows = rows.select("id", "lang", "source", words.alias("w"), lines.alias("l"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("h", F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])))
    # most texts repeat no window, and need no order
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("windows", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    # equal windows are neighbours once sorted
    twice = F.filter("windows", lambda x, j: (x["h"] == F.get(F.col("windows"), j - 1)["h"]) | (x["h"] == F.get(F.col("windows"), j + 1)["h"]))
    rows = rows.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("places"), j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    n_lines = F.size("l").cast("long")
    found = F.struct(
        F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols", n_lines.alias("n_lines"),
        (n_lines - F.size(F.array_distinct("l"))).alias("n_dup_lines"), covered.alias("n_repeat_words"),
    )
    # as rows of a generator: a later filter on a statistic stays behind it, instead of repeating all its expressions
    return rows.select("id", "lang", "source", F.inline(F.array(found)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _values() -> dict[str, Column]:
    """The statistics that have thresholds, in thousandths."""

    def share(part: str, whole: str) -> Column:
        return F.expr(f"coalesce(1000 * {part} div nullif({whole}, 0), 0)")

    return {"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeated": share("n_repeat_words", "n_words")}


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, name, low, n): how many documents have a value whose leading bits are those of ``low``."""
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("v")) for k, v in _values().items()])).alias("x")
    rest = F.greatest(F.lit(0), F.length(F.bin("x.v")) - BITS)
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("x.v"), rest), rest)
    return stats.where(~base_failed()).select("lang", "source", value).select("lang", "source", "x.name", low.alias("low")).groupBy("lang", "source", "name", "low").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, total, <name>_low, <name>_high) from a sketch merged by ``groups``; a group has one row for each bin."""
    merged = sketch.groupBy(*groups, "name", "low").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*groups, "name")
    upto = by.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(by))

    def quartile(name: str, k: int) -> Column:
        return F.min(F.when((F.col("name") == name) & (4 * F.col("upto") >= k * F.col("total")), F.col("low")))

    cols = []
    for name, least in TOLERANCE.items():
        low, high = quartile(name, 1), quartile(name, 3)
        reach = F.greatest(REACH * (high - low), F.lit(least))
        cols += [(low - reach).alias(f"{name}_low"), (high + reach).alias(f"{name}_high")]
    return ranked.groupBy(*groups).agg(F.max("total").alias("total"), *cols)


def thresholds(sketch: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """(lang, source, level, <name>_low, <name>_high): level 0 is the source's own sketch, 1 that of its language, 2 that of all."""
    own, language, everything = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch, [])
    names = [f"{k}_{side}" for k in TOLERANCE for side in ("low", "high")]

    def packed(df: DataFrame, groups: list[str], name: str) -> DataFrame:
        return df.select(*[F.col(g).alias(f"{g}_{name}") for g in groups], F.struct("total", *names).alias(name))

    own, language, everything = packed(own, ["lang", "source"], "s"), packed(language, ["lang"], "l"), packed(everything, [], "a")
    both = own.join(language, F.col("lang_s").eqNullSafe(F.col("lang_l"))).join(F.broadcast(everything), F.lit(True))  # the last is one row
    level = F.when(F.col("s.total") >= least, 0).when(F.col("l.total") >= least, 1).otherwise(2)
    of = lambda c: F.when(F.col("level") == 0, F.col(f"s.{c}")).when(F.col("level") == 1, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return both.withColumn("level", level).select(F.col("lang_s").alias("lang"), F.col("source_s").alias("source"), "level", *map(of, names))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source"), least: int = LEAST_GROUP) -> DataFrame:
    """Every document's statistics with base_failed and kept, in a column of the id's name and those of ``statistics``.

    A document is kept if it passes the base rules and none of its values lies beyond its source's fences. Nulls in lang
    or source are a group; repeated rows are judged one by one; texts are read once, their statistics are stored.
    """
    stats = materialize(statistics(docs, id_col, text_col, groups), "statistics")
    found = materialize(thresholds(materialize(sketches(stats), "sketches"), least), "thresholds")
    judged = _judged(stats, found)
    return judged.select(F.col("id").alias(id_col), *[c for c in judged.columns if c not in ("id", "lang", "source")])


def _judged(stats: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``statistics`` with level, base_failed and kept by thresholds."""
    values = _values()
    fair = values[TWO_SIDED] >= F.col(f"{TWO_SIDED}_low")
    for name, v in values.items():
        fair &= v <= F.col(f"{name}_high")
    own = found.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = stats.join(own, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    failed = base_failed()
    # a source all of whose documents fail the base rules has no thresholds and needs none
    return joined.select(*stats.columns, "level", failed.alias("base_failed"), (~failed & F.coalesce(fair, F.lit(False))).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source"), least: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps. Statistics are computed once more beside the row, so repeated or null ids do no harm."""
    found = materialize(thresholds(sketches(materialize(statistics(docs, id_col, text_col, groups), "statistics")), least), "thresholds")
    rows = statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{g}`").alias(n) for g, n in zip(groups, ("lang", "source"))]), "id")
    return _judged(rows, found).where("kept").select("id.*")


def _fence_sql(groups: str) -> str:
    """SQL for the outer fences of sketches merged by ``groups`` (followed by a comma, or empty)."""
    by = f"PARTITION BY {groups} name"
    quartile = lambda name, k: f"min(low) FILTER (name = '{name}' AND 4 * upto >= {k} * total)"
    sides = []
    for name, least in TOLERANCE.items():
        a, b = quartile(name, 1), quartile(name, 3)
        reach = f"greatest({REACH} * ({b} - {a}), {least})"
        sides.append(f"{a} - {reach} AS {name}_low, {b} + {reach} AS {name}_high")
    ranked = f"SELECT {groups} name, low, sum(n) OVER ({by} ORDER BY low) AS upto, sum(n) OVER ({by}) AS total FROM (SELECT {groups} name, low, sum(n) AS n FROM sketch GROUP BY ALL)"
    return f"SELECT {groups} max(total) AS total, {', '.join(sides)} FROM ({ranked})" + (f" GROUP BY {groups[:-1]}" if groups else "")


def _pick(c: str) -> str:
    return f"CASE level WHEN 0 THEN s.{c} WHEN 1 THEN l.{c} ELSE a.{c} END"


_SPACE = r"[\x20\x09-\x0D]"
#: The same as ``judge`` on ``documents``, for DuckDB.
SQL = rf"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    o AS (SELECT row, unnest(range(len(w))) AS i, unnest(w) AS x FROM d),
    g AS (SELECT row, i, x || ' ' || lead(x) OVER (PARTITION BY row ORDER BY i) || ' ' || lead(x, 2) OVER (PARTITION BY row ORDER BY i) AS g FROM o),
    again AS (SELECT row, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
    r AS (SELECT row, sum(step)::BIGINT AS n_repeat_words FROM (SELECT row, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i) - i, {WINDOW})) AS step FROM again) GROUP BY row),
    m AS (
        SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
            len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (row)),
    v AS (
        SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS word_length,
            coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbols, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_lines, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeated FROM m),
    u AS (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeated FROM v WHERE NOT base_failed) ON word_length, symbols, dup_lines, repeated INTO NAME name VALUE v),
    k AS (SELECT lang, source, name, v, greatest(0, length(ltrim(bin(v), '0')) - {BITS})::INT AS rest FROM u),
    sketch AS (SELECT lang, source, name, (v >> rest) << rest AS low, count(*) AS n FROM k GROUP BY ALL),
    s AS ({_fence_sql("lang, source,")}), l AS ({_fence_sql("lang,")}), a AS ({_fence_sql("")}),
    levels AS (SELECT s.lang, s.source, CASE WHEN s.total >= {LEAST_GROUP} THEN 0 WHEN l.total >= {LEAST_GROUP} THEN 1 ELSE 2 END AS level FROM s JOIN l ON l.lang IS NOT DISTINCT FROM s.lang),
    f AS (
        SELECT s.lang AS of_lang, s.source AS of_source, {", ".join(f"{_pick(c)} AS {c}" for c in [f"{TWO_SIDED}_low", *[f"{k}_high" for k in TOLERANCE]])}
        FROM s JOIN levels ON levels.lang IS NOT DISTINCT FROM s.lang AND levels.source IS NOT DISTINCT FROM s.source JOIN l ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND coalesce({" AND ".join(f"{k} <= {k}_high" for k in TOLERANCE)} AND {TWO_SIDED} >= {TWO_SIDED}_low, false) AS kept, n_lines
    FROM v LEFT JOIN f ON lang IS NOT DISTINCT FROM of_lang AND source IS NOT DISTINCT FROM of_source"""
