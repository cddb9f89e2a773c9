"""The registered queries on the given tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import crawl, layout, links, markup
from ..sources.tables import given

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HREF = 'href="([^"]+)"'
URL_KEYS = ["page", "ref", "utm_source"]
QUANTITY = 45.0
#: Ordered ranges in the queries on a table of which one key holds a third.
RANGES = 32
_HOT = "CASE WHEN event_id % 10 < 3 THEN 0 ELSE user_id END"


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Entities that occur in the given pages, for the SQL; the ampersand comes last, so nothing is decoded twice.
_PAGE_ENTITIES = ["nbsp", "copy", "middot", "quot", "lt", "gt", "amp"]


def _entities(x: str) -> str:
    """SQL that decodes entities; as in ``decode_entities`` these names, all older ones, need no semicolon if no letter or digit follows."""
    for name in _PAGE_ENTITIES:  # an underscore is no letter, but \b takes it for one
        x = rf"regexp_replace({x}, '&{name}(?:;|\b|(_))', '{S.ENTITIES[name]}\1', 'g')"
    return x


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


_CLEAN = f"regexp_replace(html, '{markup.NOT_CONTENT}', '', 'g')"


def _text(x: str, sep: str) -> str:
    """SQL for the text of a piece of markup."""
    parts = f"list_transform(list_filter(regexp_extract_all({x}, '{markup.TOKEN}'), lambda t: t[1] <> '<'), lambda t: {_strip(_entities('t'))})"
    return f"coalesce(array_to_string(list_filter({parts}, lambda t: t <> ''), '{sep}'), '')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "pages").select("page_id", "html")


@query(f"""
    SELECT page_id, min(pos) AS pos, link FROM (
        SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS l FROM pages))
    GROUP BY page_id, link""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.extract(given(spark, sf_dir, "pages").select("page_id", "html"), HREF)
    return links.first_of(found, ["page_id", "link"]).withColumn("pos", F.col("pos").cast("long"))


def _params(sf: DataFrame) -> DataFrame:
    text = F.regexp_replace("url", "#.*$", "")
    text = F.when(text.contains("?"), F.regexp_extract(text, r"[?](.*)$", 1)).otherwise("")
    got = {k: S.query_get(text, k) for k in URL_KEYS}
    got["page"] = S.default_if_empty(got["page"], "0")
    return sf.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("base"), *[v.alias(k) for k, v in got.items()])


_PARAMS_SQL = "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, " + ", ".join(
    (f"coalesce(nullif({x}, ''), '0')" if k == "page" else x) + f" AS {k}"
    for k in URL_KEYS
    for x in [_strip(f"url_decode(replace(regexp_extract(regexp_extract(regexp_replace(url, '#.*$', ''), '[?](.*)$', 1), '(?:^|&){k}=([^&]*)', 1), '+', ' '))")]
) + " FROM pages"


@query(_PARAMS_SQL)
def page_url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _params(given(spark, sf_dir, "pages"))


@query(f"""SELECT page_id, base || '?' || concat_ws('&', {", ".join(f"'{k}=' || replace(url_encode({k}), '%20', '+')" for k in URL_KEYS)}) AS rebuilt FROM ({_PARAMS_SQL})""")
def page_url_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _params(given(spark, sf_dir, "pages"))
    return params.select("page_id", F.concat("base", F.lit("?"), S.encode_query({k: F.col(k) for k in URL_KEYS})).alias("rebuilt"))


@query(rf"""
    SELECT page_id, count(*) FILTER (t[1] = '<' AND t[2] <> '/') AS n_open, count(*) FILTER (t[1:2] = '</') AS n_close,
        count(*) FILTER (t[1] <> '<' AND {_strip(_entities('t'))} <> '') AS n_text
    FROM (SELECT page_id, unnest(regexp_extract_all({_CLEAN}, '{markup.TOKEN}')) AS t FROM pages) GROUP BY page_id""")
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    return markup.tokens(_pages(spark, sf_dir), ["page_id"]).groupBy("page_id").agg(
        F.count_if(kind.isin("open", "void")).alias("n_open"), F.count_if(kind == "close").alias("n_close"), F.count_if((kind == "text") & (F.col("s") != "")).alias("n_text")
    )


@query(rf"""SELECT page_id, {_text("h", "")} AS title FROM (SELECT page_id, regexp_extract({_CLEAN}, '(?is)<h1\b[^>]*>(.*?)(?:</h1>|$)', 1) AS h FROM pages WHERE regexp_matches({_CLEAN}, '(?i)<h1\b'))""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.outline(_pages(spark, sf_dir), ["page_id"], markup.any_tag("h1")).where(F.size("scopes") > 0)
    return found.select("page_id", markup.text_of(F.get("scopes", F.lit(0)), "").alias("title"))


@query(rf"""
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS n, {_text("h", " ")} AS text
    FROM (SELECT page_id, unnest(l) AS h, unnest(range(len(l))) AS k FROM (SELECT page_id, regexp_extract_all({_CLEAN}, '(?is)<div class="ad">(.*?)</div>', 1) AS l FROM pages))""")
def page_ad_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.outline(_pages(spark, sf_dir), ["page_id"], markup.any_class("ad"))
    texts = F.transform("scopes", lambda x: markup.text_of(x, " "))
    return found.select("page_id", F.posexplode(texts).alias("n", "text")).select("page_id", (F.col("n") + 1).cast("long").alias("n"), "text")


@query(rf"""
    SELECT page_id, count(*) AS n_items, string_agg({_text("h", "")}, ' | ' ORDER BY k) AS items
    FROM (SELECT page_id, unnest(l) AS h, unnest(range(len(l))) AS k FROM (
        SELECT page_id, regexp_extract_all(regexp_extract({_CLEAN}, '(?is)<nav>(.*?)</nav>', 1), '(?is)<li>(.*?)</li>', 1) AS l FROM pages))
    GROUP BY page_id""")
def page_nav_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.outline(_pages(spark, sf_dir), ["page_id"], markup.any_tag("nav", "li"))
    nav = F.get(markup.with_tag("nav"), F.lit(0))
    items = F.transform(markup.within(markup.with_tag("li"), nav), lambda x: markup.text_of(x, ""))
    out = found.select("page_id", F.size(items).cast("long").alias("n_items"), F.array_join(items, " | ").alias("items"))
    return out.where("n_items > 0")


@query(rf"""
    SELECT page_id, contains(html, '<h1') AS valid, contains(lower(html), 'worthless') AS mention, regexp_matches({_CLEAN}, '(?i)<[^>]*\sclass="(?:[^"]*\s)?ad(?:\s[^"]*)?"') AS has_ad,
        regexp_matches({_CLEAN}, '(?i)<[^>]*\sclass="(?:[^"]*\s)?abrogato(?:\s[^"]*)?"') OR contains(lower(html), 'abrogato') AS repealed
    FROM pages""")
def page_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = given(spark, sf_dir, "pages").select("page_id", "html")
    openings = F.filter(markup.token_array(F.col("html")), lambda t: t.rlike(r"(?i)^<[a-z]"))
    classes = F.flatten(F.transform(openings, lambda t: F.split(F.regexp_extract(t, r'(?i)\sclass="([^"]*)"', 1), r"\s+")))
    marked = pages.withColumn("classes", classes)
    return marked.select(
        "page_id", F.contains("html", F.lit("<h1")).alias("valid"), F.contains(F.lower("html"), F.lit("worthless")).alias("mention"), F.array_contains("classes", "ad").alias("has_ad"),
        (F.array_contains("classes", "abrogato") | F.contains(F.lower("html"), F.lit("abrogato"))).alias("repealed"),
    )


_SUFFIX_SQL = "CASE sub " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SUFFIXES.items()) + " ELSE ' (' || sub || ')' END"


@query(f"""
    SELECT l_orderkey, l_linenumber, 'Art. ' || l_partkey || {_SUFFIX_SQL} AS label, printf('art_%04d_%s.html', l_partkey, sub) AS filename
    FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS sub FROM lineitem)""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, sub = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")
    return given(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.article_label(number, sub).alias("label"), S.file_name(number, sub).alias("filename"))


@query("""
    SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS INT)) AS place
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders)""")
def numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return links.numeric_place(rows, ["o_orderkey"], ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)")
def numeric_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place among all rows, in ordered ranges."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = given(spark, sf_dir, "lineitem").select(*keys).distinct()
    return links.numeric_place(rows.select(*[F.col(k).cast("string") for k in keys]), keys, [], ranges=RANGES).select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("long"), "place")


@query("SELECT user_id, round_even(value, 0) AS y, string_agg(event_type, ' ' ORDER BY event_id) AS line FROM events GROUP BY user_id, round_even(value, 0)")
def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.assemble(given(spark, sf_dir, "events"), ["user_id"], "value", "event_type", ["event_id"])


def _nearest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = given(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    marks = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("header_id"))
    return marks, layout.nearest_before(events.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), marks, ["user_id"], "ts", ["header_id"])


_NEAREST_SQL = """
    SELECT p.event_id, p.user_id, s.event_id AS header_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts > s.ts"""


@query(_NEAREST_SQL)
def nearest_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)[1].select("event_id", "user_id", "header_id")


@query(f"SELECT user_id, event_id AS header_id FROM events WHERE event_type = 'signup' AND event_id NOT IN (SELECT header_id FROM ({_NEAREST_SQL}) WHERE header_id IS NOT NULL)")
def unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, found = _nearest(spark, sf_dir)
    return layout.unclaimed(marks.select("user_id", "header_id"), found.where("header_id is not null"), ["user_id", "header_id"])


def _hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which three in ten belong to one user."""
    return given(spark, sf_dir, "events").withColumn("user_id", F.expr(_HOT))


@query(_NEAREST_SQL.replace("FROM events", f"FROM (SELECT event_id, ts, event_type, {_HOT} AS user_id FROM events)"))
def nearest_header_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest header where one key holds a third of all rows, in ordered ranges."""
    events = _hot_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    marks = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("header_id"))
    rows = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return layout.nearest_before(rows, marks, ["user_id"], "ts", ["header_id"], ranges=RANGES).select("event_id", "user_id", "header_id")


_SEGMENT_SQL = """
    SELECT *, sum(CASE WHEN header IS NOT NULL AND header IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq
    FROM (SELECT *, lag(header) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
        FROM (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS header FROM events))"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    rows = layout.segment(given(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], header)
    return rows.withColumnRenamed("seq_header", "header").withColumn("seq", F.col("seq").cast("long"))


@query(f"SELECT event_id, user_id, seq, header FROM ({_SEGMENT_SQL})")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("event_id", "user_id", "seq", "header")


@query(f"SELECT event_id, user_id, seq, header FROM ({_SEGMENT_SQL.replace('FROM events', f'FROM (SELECT event_id, ts, event_type, {_HOT} AS user_id FROM events)')})")
def segments_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments where one key holds a third of all rows, in ordered ranges."""
    header = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    rows = layout.segment(_hot_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], header, ranges=RANGES)
    return rows.select("event_id", "user_id", F.col("seq").cast("long").alias("seq"), F.col("seq_header").alias("header"))


@query(f"""SELECT event_id, seq, first_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, seq ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS first_click
    FROM ({_SEGMENT_SQL})""")
def segment_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.when(F.col("event_type") == "click", F.col("value"))
    return _segments(spark, sf_dir).select("event_id", "seq", layout.first_so_far(["user_id", "seq"], ["ts", "event_id"], click).alias("first_click"))


@query("""
    SELECT u.conv_id, u.turn, count(a.turn) AS n_rows, coalesce(string_agg(a.turn::VARCHAR || ':' || length(a.text), ',' ORDER BY a.turn), '') AS rows
    FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE role = 'user') u
    LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn > u.turn AND (u.next IS NULL OR a.turn < u.next)
    GROUP BY u.conv_id, u.turn""")
def conversation_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = given(spark, sf_dir, "conversations")
    head = F.when(F.col("role") == "user", F.col("turn"))
    rows = layout.segment(turns, ["conv_id"], ["turn"], head).where("seq > 0")
    own = F.when(F.col("role") == "assistant", F.struct("turn", F.length("text").alias("n")))
    nested = rows.groupBy("conv_id", F.col("seq_header").alias("turn")).agg(F.array_sort(F.collect_list(own)).alias("rows"))
    joined = F.array_join(F.transform("rows", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    return nested.select("conv_id", "turn", F.size("rows").cast("long").alias("n_rows"), joined.alias("rows"))


HEADER_SQL = r"Quesito[\s\x{00A0}]+n.?[\s\x{00A0}]*(\d+)[\s\x{00A0}]*[-–][\s\x{00A0}]*(.+)"


@query(rf"""
    SELECT p_partkey, regexp_extract(line, '{HEADER_SQL}', 1) AS qid, trim(regexp_extract(line, '{HEADER_SQL}', 2)) AS topic, p_brand AS bare, trim(replace(p_name, chr(10), ' ')) AS name
    FROM (SELECT *, 'x Quesito' || chr(160) || 'n. ' || p_size || ' – ' || p_brand || ' ' AS line FROM part) WHERE regexp_matches(line, '{HEADER_SQL}')""")
def header_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = given(spark, sf_dir, "part").withColumn("line", F.concat(F.lit("x Quesito\xa0n. "), F.col("p_size").cast("string"), F.lit(" – "), "p_brand", F.lit(" "))).withColumn("y", F.lit(0.0))
    lines = lines.withColumns({"bare": S.without_prefix(F.concat(F.lit("Art.\xa0"), "p_brand")), "name": S.one_line(F.col("p_name"))})
    return layout.headers(lines, ["p_partkey", "bare", "name"]).drop("y")


@query("SELECT event_id, CASE upper(trim(event_type)) WHEN 'SIGNUP' THEN true WHEN 'ERROR' THEN false END AS answer FROM events")
def answer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events").select("event_id", S.answer(F.col("event_type"), "SIGNUP", "ERROR").alias("answer"))


@query("SELECT md5(text) || '.txt' AS path, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = layout.content_paths(given(spark, sf_dir, "documents").select("doc_id", "text"), "text", F.lit("txt"))
    return docs.groupBy("path").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"""
    SELECT o_orderkey, o_orderdate, arg_min(l_linenumber, (l_shipdate, l_linenumber)) AS line
    FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > {QUANTITY}) ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate
    GROUP BY o_orderkey, o_orderdate""")
def range_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = given(spark, sf_dir, "lineitem").where(F.col("l_quantity") > QUANTITY).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("o_orderdate"), F.col("l_linenumber").alias("line"))
    return layout.nearest_after(orders, lines, ["o_orderkey"], "o_orderdate", [], ["line"])


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = given(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    rows = given(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return layout.lookup_last(rows, parts, ["l_partkey"], "p_size", ["p_name"]).drop("l_partkey")


@query(f"""
    WITH a AS (
        SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt,
            CASE floor(value)::BIGINT % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 END AS status FROM events),
    t AS (SELECT * FROM a WHERE attempt <= {crawl.MAX_ATTEMPTS}),
    s AS (SELECT user_id, event_type, min(attempt) FILTER (status = 200) AS ok FROM t GROUP BY ALL)
    SELECT user_id, event_type, ok IS NOT NULL AS fetched, ok AS success_attempt, count(*) FILTER (ok IS NULL OR attempt <= ok) AS tries,
        coalesce(sum(CASE WHEN status IN (429, 500, 503) THEN 15.0 * attempt WHEN attempt < {crawl.MAX_ATTEMPTS} THEN 1.5 * attempt ELSE 0 END) FILTER (ok IS NULL OR attempt < ok), 0)::DOUBLE AS wait_s
    FROM t JOIN s USING (user_id, event_type) GROUP BY user_id, event_type, ok""")
def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    attempt = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id")).cast("long")
    draw = F.pmod(F.floor("value"), F.lit(5))
    status = F.when(draw == 0, 200).when(draw == 1, 429).when(draw == 2, 503).when(draw == 3, 404)
    return crawl.outcomes(given(spark, sf_dir, "events").select(*keys, attempt.alias("attempt"), status.alias("status")), keys)


@query(f"""
    SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages)
    WHERE link NOT IN (SELECT regexp_extract(url, '://[^/]+(/[^/?#]*)', 1) FROM pages)""")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = given(spark, sf_dir, "pages")
    wanted = links.extract(pages.select("html"), HREF).select("link").distinct()
    return crawl.pending(wanted, pages.select(F.regexp_extract("url", "://[^/]+(/[^/?#]*)", 1).alias("link")), ["link"])


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
