"""Registered queries for whole products: article records, link tables, question banks, and their sinks and stream.

The given tables hold no law and no layout, so pages, tables of contents and layout tables are derived from them by
Spark; the SQL computes what has to come out straight from the given tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import articles, crawl, links, quiz
from ..sources import sinks, tables
from ..sources.shared import new_path, stored
from ..sources.tables import given
from ..streaming import incremental
from .driver import HEADER_SQL, query

KEYS = ["law", "filename"]
_LAW_SQL = "CASE WHEN o_custkey % 2 = 0 THEN 'cds' ELSE 'cap' END AS law"
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _law() -> Column:
    return F.when(F.col("o_custkey") % 2 == 0, "cds").otherwise("cap").alias("law")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: Least number of parts that derived pages are dealt into by key. Parsing is work by row, so what counts is rows, not the few bytes
#: they take when compressed, by which adaptive execution would put them into one or two tasks.
PARTS = 64


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def law_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(law, filename, url, html): an article page for every order, a comma for each of its lines; an order without lines gives no article."""
    part, number = F.col("l_partkey"), F.col("l_linenumber")
    body = F.when(F.col("l_returnflag") == "R", _text("<i>", part, "</i>")).otherwise(_text('<span class="art_text_in_comma">part&nbsp;', part, " <b>", F.col("l_quantity").cast("long"), "</b></span>"))
    comma = _text('<div class="art-comma-div-akn"><span class="comma-num-akn">', number, ".</span>", body, "</div>\r\n")
    commas = F.array_sort(F.collect_list(F.struct(*_LINE_ORDER, comma.alias("html"))))
    lines = _dealt(given(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER, "l_returnflag"), "l_orderkey")
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(commas, lambda x: x["html"]), "").alias("commas"))
    priority = F.col("o_orderpriority")
    number = _text('<h2 class="article-num-akn">Art.&nbsp;', F.col("o_orderkey"), F.when(priority == "5-LOW", "-bis").otherwise(""), "</h2>")
    heading = _text('<div class="article-heading-akn">((', priority, ") )</div>")
    preamble = F.when(F.col("o_orderstatus") == "O", F.lit('<div class="article-pre-comma-text-akn">open &lt;<b>since</b>&#62; date</div>')).otherwise("")
    repealed = F.when(priority == "1-URGENT", '<p class="art_abrogato-akn">gone</p>').when(priority == "2-HIGH", "<p>(Comma ABROGATO)</p>").otherwise("")
    html = F.when(F.col("commas").isNull(), _text("<p>no article ", F.col("o_orderkey"), "</p>")).otherwise(_text("<html><body>\r\n", number, heading, preamble, F.col("commas"), repealed, "</body></html>"))
    file = S.file_name(F.col("o_orderkey").cast("string"), F.lit("1"))
    pages = _dealt(given(spark, sf_dir, "orders"), "o_orderkey").join(per_order, "o_orderkey", "left")
    return pages.select(_law(), file.alias("filename"), _text("u/", file).alias("url"), html.alias("html"))


_ARTICLES_SQL = rf"""
    SELECT {_LAW_SQL}, printf('art_%04d_%s.html', o_orderkey, '1') AS filename, o_orderkey || CASE o_orderpriority WHEN '5-LOW' THEN '-bis' ELSE '' END AS number,
        trim('((' || o_orderpriority || ') )', '().') AS title, trim(trim('((' || o_orderpriority || ') )', '().')) AS title_clean,
        CASE o_orderstatus WHEN 'O' THEN 'open < since > date' ELSE '' END AS text, o_orderpriority IN ('1-URGENT', '2-HIGH') AS repealed, o_orderpriority = '1-URGENT' AS repealed_article,
        coalesce(list(l_linenumber || '. part' || chr(160) || l_partkey || ' ' || CAST(l_quantity AS BIGINT) ORDER BY {", ".join(_LINE_ORDER)}) FILTER (l_returnflag <> 'R'), []) AS paragraphs
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority, o_orderstatus"""
_ARTICLE_ROWS = ["law", "filename", "number", "title", "title_clean", "text", "repealed", "repealed_article"]
_DIGEST_SQL = f"SELECT {', '.join(_ARTICLE_ROWS)}, len(paragraphs) AS n_paragraphs, array_to_string(paragraphs, ' | ') AS paragraphs, 'u/' || filename AS url, true AS stamped FROM ({_ARTICLES_SQL})"


def _digest(records: DataFrame) -> DataFrame:
    stamped = F.col("scraped_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")
    return records.select(*_ARTICLE_ROWS, F.size("paragraphs").cast("long").alias("n_paragraphs"), F.array_join("paragraphs", " | ").alias("paragraphs"), "url", stamped.alias("stamped"))


@query(_DIGEST_SQL)
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(articles.parse(articles.split_valid(law_pages(spark, sf_dir))[0], KEYS))


@query(f"SELECT {_LAW_SQL}, printf('art_%04d_%s.html', o_orderkey, '1') AS filename FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def rejected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.split_valid(law_pages(spark, sf_dir))[1].select(*KEYS)


@query(f"SELECT {_LAW_SQL}, printf('art_%04d_%s.html', o_orderkey, '1') AS filename, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey, o_custkey")
def rejected_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = articles.rejected_commas(articles.parse(articles.split_valid(law_pages(spark, sf_dir))[0], KEYS), KEYS)
    return found.groupBy(*KEYS).agg(F.countDistinct("open_i").alias("n"))


@query(_DIGEST_SQL)
def article_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written by law, and those of one law written again, as they are read back."""
    folder = new_path(spark, "articles")
    records = stored(articles.parse(articles.split_valid(law_pages(spark, sf_dir))[0], KEYS), "records")  # parsed once for both writes
    sinks.write_articles(records, folder)
    sinks.write_articles(records.where("law = 'cds'"), folder)
    return _digest(spark.read.schema(records.schema).json(folder))


@query(f"SELECT {_LAW_SQL}, printf('art_%04d_%s.html', o_orderkey, '1') AS filename, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' ELSE 'old ' END || o_orderkey AS html FROM orders")
def page_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and a third of them once more with another text, as they are read back."""
    folder = new_path(spark, "raw-pages")
    key = F.col("o_orderkey")

    def pages(word: str) -> DataFrame:
        return given(spark, sf_dir, "orders").select(_law(), S.file_name(key.cast("string"), F.lit("1")).alias("filename"), F.lit("u").alias("url"), _text(word, key).alias("html"), key)

    sinks.write_pages(pages("old "), folder)
    sinks.write_pages(pages("new ").where(key % 3 == 0), folder)
    return sinks.read_pages(spark, folder).drop("url")


_HTML_SQL = "CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 3 = 0 THEN 'è漢' || chr(13) || chr(10) || html || chr(13) || chr(10) ELSE html END"


@query(f"""
    SELECT law, printf('art_%04d_1.html', page_id) AS filename, length(h) AS n_chars, md5(h) AS md5
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'cds' ELSE 'cap' END AS law, {_HTML_SQL} AS h FROM pages)""")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files named by article, written by the executors and scanned; some are empty, some not ASCII with CRLF."""
    folder, key, html = new_path(spark, "page-files"), F.col("page_id"), F.col("html")
    text = F.when(key % 7 == 0, "").when(key % 3 == 0, F.concat(F.lit("è漢\r\n"), html, F.lit("\r\n"))).otherwise(html)
    law = F.when(key % 2 == 0, "cds").otherwise("cap").alias("law")
    sinks.write_page_files(given(spark, sf_dir, "pages").select(law, S.file_name(key.cast("string"), F.lit("1")).alias("filename"), text.alias("html")), folder)
    return tables.raw_pages(spark, folder).select("law", "filename", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("md5"))


@query(f"SELECT {_LAW_SQL}, printf('art_%04d_%s.html', o_orderkey, '1') AS filename, (o_orderkey % 8) || ' ' || o_orderkey AS html FROM orders")
def page_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are written again and again, each time without an eighth of them, as they are read back."""
    folder, key = new_path(spark, "rewritten-pages"), F.col("o_orderkey")
    orders = given(spark, sf_dir, "orders")
    for k in range(8):
        rows = orders.where(F.pmod(key, F.lit(8)) >= k)
        sinks.write_pages(rows.select(_law(), S.file_name(key.cast("string"), F.lit("1")).alias("filename"), F.lit("u").alias("url"), _text(F.lit(k), " ", key).alias("html")), folder, buckets=8)
    return sinks.read_pages(spark, folder).drop("url")


@query(_DIGEST_SQL)
def incremental_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that land in two lots, with an overlap, through the stream; then all once more, for a stream whose checkpoint is lost."""
    folder, out, log = (new_path(spark, name) for name in ("landing", "stream-out", "stream-log"))
    pages = law_pages(spark, sf_dir).withColumn("lot", F.pmod(F.xxhash64(*KEYS), F.lit(3)))
    for lots in ((0, 1), (1, 2)):
        pages.where(F.col("lot").isin(*lots)).drop("lot").write.mode("append").parquet(folder)
        incremental.extract_articles(incremental.page_tables(spark, folder), out, log).awaitTermination()
    incremental.extract_articles(incremental.page_tables(spark, folder), out, new_path(spark, "stream-log")).awaitTermination()
    return _digest(incremental.records(spark, out))


_ID = "CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE CAST(o_orderkey % 7 + 1 AS VARCHAR) END"


_OUTPUTS = ", ".join(f"('{law}', '{name}')" for law, _, name in tables.LAWS)
_LINKS_SQL = f"""
    WITH l AS (
        SELECT {_LAW_SQL}, CAST(o_custkey AS VARCHAR) AS src, o_orderkey, {_ID} AS "idArticolo", CAST(o_orderkey % 3 + 1 AS VARCHAR) AS "idSottoArticolo", CAST(o_orderkey AS VARCHAR) AS versione,
            CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE CAST(o_orderkey AS VARCHAR) END AS progressivo FROM orders WHERE o_orderstatus <> 'P'),
    f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY law, src, "idArticolo", "idSottoArticolo" ORDER BY o_orderkey) = 1),
    s(sub, suffix) AS (VALUES ('1', ''), ('2', ' bis'), ('3', ' ter')),
    o(law, output_name) AS (VALUES {_OUTPUTS})
    SELECT law, src, "idArticolo", "idSottoArticolo", versione, progressivo, "idArticolo" <> 'x' AS numeric,
        CASE WHEN "idArticolo" <> 'x' THEN 'Art. ' || "idArticolo" || suffix END AS label, CASE WHEN "idArticolo" <> 'x' THEN printf('art_%04d_%s.html', try_cast("idArticolo" AS INT), sub) END AS filename,
        CASE WHEN "idArticolo" <> 'x' THEN '{S.ARTICLE_URL}?art.versione=' || versione || '&art.idGruppo=4&art.flagTipoArticolo=0&art.codiceRedazionale=092G0306&art.idArticolo=' || "idArticolo"
            || '&art.idSottoArticolo=' || sub || '&art.idSottoArticolo1=10&art.dataPubblicazioneGazzetta=1992-05-18+00%3A00&art.progressivo=' || progressivo END AS url,
        CASE WHEN "idArticolo" <> 'x' THEN output_name END AS output_name
    FROM f JOIN s ON sub = "idSottoArticolo" JOIN o USING (law)"""


def law_contents(orders: DataFrame) -> DataFrame:
    """(law, src, html): a table of contents for every customer, with a link for each order."""
    key = F.col("o_orderkey")
    one = _text(
        "<a onclick=\"return caricaArticolo?art.versione=", key, "&art.idGruppo=4&art.flagTipoArticolo=", F.when(F.col("o_orderstatus") == "P", "1").otherwise("0"), "&codiceRedazionale=092G0306&art.idArticolo=",
        F.when(key % 97 == 0, "x").otherwise((key % 7 + 1).cast("string")), "&art.idSottoArticolo=", key % 3 + 1, "&art.idSottoArticolo=9&art.idSottoArticolo1=10&art.dataPubblicazioneGazzetta=1992-05-18%2000%3A00",
        F.when(key % 2 == 0, "&art.progressivo=&").otherwise(_text("&art.progressivo=", key)), "\">x</a>",
    )
    rows = _dealt(orders.select(_law(), F.col("o_custkey").cast("string").alias("src"), "o_orderkey", "o_orderstatus"), "law", "src")
    toc = rows.groupBy("law", "src").agg(F.array_sort(F.collect_list(F.struct(key, one.alias("a")))).alias("all"))
    return toc.select("law", "src", F.array_join(F.transform("all", lambda x: x["a"]), "\n").alias("html"))


def _named_links(found: DataFrame) -> DataFrame:
    good, bad = links.split_numeric(stored(found, "found-links"))  # numeric ones and others are two readings, and the order takes a sample
    named = links.with_names(good, tables.laws(found.sparkSession)).withColumn("numeric", F.lit(True)).unionByName(bad.withColumn("numeric", F.lit(False)), allowMissingColumns=True)
    return named.select("law", "src", "idArticolo", "idSottoArticolo", "versione", "progressivo", "numeric", "label", "filename", "url", "output_name")


@query(_LINKS_SQL)
def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all tables of contents; those without a numeric id are set apart."""
    return _named_links(links.article_links(law_contents(given(spark, sf_dir, "orders")), ["law", "src"]))


@query(f"SELECT *, CAST(src AS BIGINT) % 2 = 1 AS pending FROM ({_LINKS_SQL})")
def link_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of tables of contents that land in two lots, the second holding the first's links again, through streams with a checkpoint each; pages of even customers are at hand."""
    folder, out = new_path(spark, "contents"), new_path(spark, "links-out")
    orders = given(spark, sf_dir, "orders")
    middle = orders.agg(F.avg("o_orderkey")).first()[0]
    for lot in (orders.where(F.col("o_orderkey") <= middle), orders):
        law_contents(lot).write.mode("append").parquet(folder)
        contents = incremental.table_stream(spark, folder, "law string, src string, html string")
        incremental.collect_links(contents, ["law", "src"], out, new_path(spark, "links-log")).awaitTermination()
    found = incremental.records(spark, out)
    key = ["law", "src", "idArticolo", "idSottoArticolo"]
    waiting = incremental.pending_links(spark, out, found.where(F.col("src").cast("long") % 2 == 0), key).select(*key, F.lit(True).alias("pending"))
    return _named_links(found).join(waiting, key, "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


#: Questions of layout tables in SQL; ``words``, ``tables``, ``table_rows``, ``images`` and ``assets`` come before it.
QUESTIONS_SQL = r"""
    lines AS (SELECT doc, page, round_even(top, 0) AS y, string_agg(text, ' ' ORDER BY x0, ord) AS line FROM words GROUP BY ALL),
    heads AS (SELECT doc, page, y, regexp_extract(line, '{header}', 1) AS qid, trim(regexp_extract(line, '{header}', 2)) AS topic FROM lines WHERE regexp_matches(line, '{header}')),
    matched AS (SELECT t.doc, t.page, 0 AS phase, t.top AS y, t.ord AS table_ord, h.qid, h.topic, h.y AS head_y FROM tables t ASOF LEFT JOIN heads h ON t.doc = h.doc AND t.page = h.page AND t.top > h.y),
    happenings AS (
        SELECT * FROM matched UNION ALL
        SELECT doc, page, 1, y, NULL, qid, topic, NULL FROM heads h WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc = h.doc AND m.page = h.page AND m.qid = h.qid)),
    carried AS (SELECT *, last_value(qid IGNORE NULLS) OVER w AS current FROM happenings WINDOW w AS (PARTITION BY doc ORDER BY page, phase, y, table_ord ROWS UNBOUNDED PRECEDING)),
    started AS (SELECT *, current IS NOT NULL AND current IS DISTINCT FROM lag(current) OVER (PARTITION BY doc ORDER BY page, phase, y, table_ord) AS new FROM carried),
    counted AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc ORDER BY page, phase, y, table_ord ROWS UNBOUNDED PRECEDING)::BIGINT AS seq FROM started),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc, seq ORDER BY page, phase, y, table_ord) AS nth FROM counted WHERE seq > 0),
    looks AS (SELECT doc, page, seq, nth, coalesce(head_y, 0.0) AS from_y FROM placed WHERE phase = 0 AND (qid IS NULL OR nth = 1)),
    named AS (SELECT l.doc, l.page, l.seq, l.nth, arg_min(i.name, (i.top, i.ord)) AS name FROM looks l JOIN images i ON i.doc = l.doc AND i.page = l.page AND i.x0 > 400 AND i.top > l.from_y GROUP BY ALL),
    paths AS (SELECT doc, page, name, arg_max(md5(content) || '.' || ext, ord) AS path FROM assets GROUP BY ALL),
    seen AS (SELECT n.doc, n.seq, n.nth, path FROM named n JOIN paths USING (doc, page, name)),
    pictured AS (SELECT p.*, first_value(path IGNORE NULLS) OVER (PARTITION BY p.doc, p.seq ORDER BY p.nth ROWS UNBOUNDED PRECEDING) AS image FROM placed p LEFT JOIN seen USING (doc, seq, nth)),
    answers AS (
        SELECT p.doc, p.seq, p.nth, r.row_idx, trim(r.cells[1]) AS number, trim(replace(coalesce(r.cells[2], ''), chr(10), ' ')) AS text, CASE upper(trim(r.cells[3])) WHEN 'VERO' THEN 'yes' WHEN 'FALSO' THEN 'no' ELSE '?' END AS answer, coalesce(image, '-') AS image
        FROM pictured p JOIN table_rows r ON r.doc = p.doc AND r.page = p.page AND r.table_ord = p.table_ord WHERE p.phase = 0 AND regexp_full_match(trim(r.cells[1]), '[0-9]+')),
    questions AS (
        SELECT q.doc, q.seq, q.current AS question_id, q.topic, count(a.number) AS n_rows, coalesce(string_agg(concat_ws('/', a.number, a.text, a.answer, a.image), ';' ORDER BY a.nth, a.row_idx) FILTER (a.number IS NOT NULL), '') AS rows
        FROM placed q LEFT JOIN answers a ON a.doc = q.doc AND a.seq = q.seq WHERE q.nth = 1 GROUP BY q.doc, q.seq, q.current, q.topic)""".replace("{header}", HEADER_SQL)
_LAYOUT_SQL = """
    e AS (SELECT *, 'u' || user_id AS doc, (event_id % 3 + 1)::INT AS page FROM events),
    words AS (
        SELECT doc, page, event_id * 10 + k AS ord, [' ', 'Quesito', 'n.', CAST(event_id % 4 AS VARCHAR), '-', 'Topic'][k + 1] AS text, value AS top, k::DOUBLE AS x0
        FROM e, range(1, 6) r(k) WHERE event_type = 'signup'),
    tables AS (SELECT doc, page, event_id AS ord, value AS top FROM e WHERE event_type = 'purchase'),
    table_rows AS (
        SELECT doc, page, event_id AS table_ord, k AS row_idx, CASE k WHEN 0 THEN ['Numero', 'Testo', 'R'] WHEN 1 THEN [' ' || event_id, ' text' || chr(10) || 'of it ', ['vero ', 'FALSO', 'forse'][event_id % 3 + 1]] WHEN 2 THEN [NULL, 'x', 'VERO'] ELSE ['7', NULL] END AS cells
        FROM e, range(0, 4) r(k) WHERE event_type = 'purchase'),
    images AS (SELECT doc, page, event_id AS ord, 350.0 + event_id % 4 * 50 AS x0, value AS top, 'n' || event_id % 3 AS name FROM e WHERE event_type = 'view'),
    assets AS (SELECT doc, page, event_id AS ord, 'n' || event_id % 4 AS name, 'c' || event_id % 5 AS content, 'png' AS ext FROM e WHERE event_type = 'click')"""


def layout_of_events(spark: SparkSession, sf_dir: str, names: Iterable[str] = tables.LAYOUT) -> dict[str, DataFrame]:
    """Layout tables, those asked for: signups are headers, purchases tables with four rows each, views images and clicks their files; stored and read as a source."""
    folder = new_path(spark, "layout")
    number = F.col("event_id").cast("int")
    events = given(spark, sf_dir, "events").select(_text("u", F.col("user_id")).alias("doc"), (F.col("event_id") % 3 + 1).cast("int").alias("page"), number.alias("ord"), F.col("value").alias("top"), "event_type")

    def of(kind: str) -> DataFrame:
        return events.where(F.col("event_type") == kind).drop("event_type")

    header = F.array(F.lit("Quesito"), F.lit("n."), (F.col("ord") % 4).cast("string"), F.lit("-"), F.lit("Topic"))
    words = of("signup").select("doc", "page", "ord", "top", F.posexplode(header).alias("k", "text"))
    answer = F.get(F.array(F.lit("vero "), F.lit("FALSO"), F.lit("forse")), F.col("ord") % 3)
    cells = F.array(
        F.array(F.lit("Numero"), F.lit("Testo"), F.lit("R")), F.array(_text(" ", F.col("ord")), F.lit(" text\nof it "), answer), F.array(F.lit(None).cast("string"), F.lit("x"), F.lit("VERO")), F.array(F.lit("7"), F.lit(None).cast("string"))
    )
    made = {
        "words": words.select("doc", "page", (F.col("ord") * 10 + F.col("k") + 1).alias("ord"), "text", "top", (F.col("k") + 1).cast("double").alias("x0")),
        "tables": of("purchase").select("doc", "page", "ord", "top"),
        "table_rows": of("purchase").select("doc", "page", F.col("ord").alias("table_ord"), F.posexplode(cells).alias("row_idx", "cells")),
        "images": of("view").select("doc", "page", "ord", (350.0 + F.col("ord") % 4 * 50).cast("double").alias("x0"), "top", _text("n", F.col("ord") % 3).alias("name")),
        "assets": of("click").select("doc", "page", "ord", _text("n", F.col("ord") % 4).alias("name"), F.lit(0).alias("xref"), F.lit("png").alias("ext"), _text("c", F.col("ord") % 5).cast("binary").alias("content")),
    }
    for name in names:
        made[name].write.parquet(f"{folder}/{name}.parquet")
    return tables.layout(spark, folder, names)


def question_rows(found: DataFrame) -> DataFrame:
    """Questions with their rows as one string."""
    answer = lambda x: F.when(x["correct_answer"], "yes").when(~x["correct_answer"], "no").otherwise("?")
    rows = F.transform("sub_questions", lambda x: F.concat_ws("/", x["number"], x["text"], answer(x), F.coalesce(x["image"], F.lit("-"))))
    return found.select("doc", F.col("seq").cast("long").alias("seq"), "question_id", "topic", F.size("sub_questions").cast("long").alias("n_rows"), F.array_join(rows, ";").alias("rows"))


@query(f"WITH {_LAYOUT_SQL}, {QUESTIONS_SQL} SELECT * FROM questions")
def quiz_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_rows(quiz.questions(**layout_of_events(spark, sf_dir)))


@query(f"WITH {_LAYOUT_SQL}, {QUESTIONS_SQL} SELECT count(*) AS questions, sum(n_rows)::BIGINT AS sub_questions FROM questions")
def quiz_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.totals(quiz.questions(**layout_of_events(spark, sf_dir)))


@query(f"WITH {_LAYOUT_SQL}, {QUESTIONS_SQL} SELECT * FROM questions")
def quiz_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as JSON, as they are read back."""
    folder, found = new_path(spark, "questions"), quiz.questions(**layout_of_events(spark, sf_dir))
    sinks.write_questions(found, folder)
    return question_rows(spark.read.schema(found.schema).json(folder))


@query(f"WITH {_LAYOUT_SQL} SELECT md5(content) || '.' || ext AS path, any_value(ext) AS ext, any_value(content) AS content FROM assets GROUP BY md5(content), ext")
def asset_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct image, as it is read back."""
    folder = new_path(spark, "assets")
    sinks.write_assets(layout_of_events(spark, sf_dir, ["assets"])["assets"], folder)
    return spark.read.parquet(folder).select("path", "ext", F.col("content").cast("string").alias("content"))


@query(f"""
    WITH a AS (
        SELECT user_id, event_id % 2 + 1 AS round, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS attempt, event_id % 3 = 0 AS valid,
            CASE floor(value)::BIGINT % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 END AS status FROM events),
    t AS (SELECT * FROM a WHERE attempt <= {crawl.MAX_ATTEMPTS}),
    s AS (SELECT user_id, round, min(attempt) FILTER (status = 200) AS ok FROM t GROUP BY ALL),
    r AS (
        SELECT user_id, round, ok IS NOT NULL AS fetched, coalesce(bool_or(valid) FILTER (attempt = ok), false) AS valid, count(*) FILTER (ok IS NULL OR attempt <= ok) AS tries,
            coalesce(sum(CASE WHEN status IN (429, 500, 503) THEN 15.0 * attempt WHEN attempt < {crawl.MAX_ATTEMPTS} THEN 1.5 * attempt ELSE 0 END) FILTER (ok IS NULL OR attempt < ok), 0)::DOUBLE AS wait_s
        FROM t JOIN s USING (user_id, round) GROUP BY user_id, round, ok)
    SELECT x.user_id, coalesce(y.fetched, x.fetched) AS fetched, coalesce(y.valid, x.valid) AS valid, CASE WHEN y.round IS NULL THEN 1 ELSE 2 END::BIGINT AS rounds, x.tries + coalesce(y.tries, 0) AS tries, x.wait_s + coalesce(y.wait_s, 0) AS wait_s
    FROM r x LEFT JOIN r y ON y.user_id = x.user_id AND y.round = 2 AND x.fetched AND NOT x.valid WHERE x.round = 1""")
def fetch_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 2).orderBy("ts", "event_id"))
    draw = F.pmod(F.floor("value"), F.lit(5))
    status = F.when(draw == 0, 200).when(draw == 1, 429).when(draw == 2, 503).when(draw == 3, 404)
    log = given(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 2 + 1).alias("round"), attempt.alias("attempt"), status.alias("status"), (F.col("event_id") % 3 == 0).alias("valid"))
    return crawl.resolve(log, ["user_id"])
