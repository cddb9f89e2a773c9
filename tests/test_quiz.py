"""The question bank: layouts with their questions written out by hand, and random ones against SQL."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from codexmill.operators import crawl, layout, links, quiz
from codexmill.plans import products
from codexmill.sources import sinks, tables

ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}


class Layout:
    """A layout that is put down page by page."""

    def __init__(self):
        self.rows = {k: [] for k in tables.LAYOUT}

    def header(self, page, y, qid, topic, dash="-"):
        for x, text in enumerate(["Quesito", "n.", qid, dash, topic]):
            self.rows["words"].append(("d", page, len(self.rows["words"]), text, y, float(x)))

    def table(self, page, y, *rows):
        n = len(self.rows["tables"])
        self.rows["tables"].append(("d", page, n, y))
        self.rows["table_rows"] += [("d", page, n, i, list(r)) for i, r in enumerate(rows)]

    def image(self, page, y, name, x0=450.0):
        self.rows["images"].append(("d", page, len(self.rows["images"]), x0, y, name))

    def asset(self, page, name, content):
        n = len(self.rows["assets"])
        self.rows["assets"].append(("d", page, n, name, n, "png", content))

    def frames(self, spark):
        return {k: spark.createDataFrame(v, tables.LAYOUT[k]) for k, v in self.rows.items()}


def test_questions_by_hand(spark):
    page = Layout()
    page.table(1, 5.0, ["0", "before any header", "VERO"])  # dropped
    page.header(1, 10.5, "7", "Signs")  # its line is at 10
    page.table(1, 10.4, ["1", "just below\nits line", "vero "], ["Numero", "Testo", "R"], ["x", "no number", ""])
    page.image(1, 30.0, "far"), page.image(1, 20.0, "near"), page.image(1, 15.0, "left", 400.0)
    page.asset(1, "near", b"A"), page.asset(1, "near", b"B"), page.asset(1, "far", b"C")  # of one name the last
    page.table(1, 40.0, ["2", None, "FALSO"])
    page.header(1, 60.0, "8", "Lights", "–")  # no table follows on its page
    page.table(2, 9.0, ["1", "of eight", ""], ["2"])  # continues 8, and brings its image
    page.image(2, 1.0, "late"), page.asset(2, "late", b"A")
    page.header(2, 20.0, "7", "Signs again")
    page.table(2, 20.0, ["3", "on its header's line is not below", None])  # so this is still 8's
    page.header(3, 5.0, "9", "Empty")
    got = [(r.question_id, r.topic, [tuple(x) for x in r.sub_questions]) for r in sorted(quiz.questions(**page.frames(spark)).collect(), key=lambda r: r.seq)]
    import hashlib

    a, b = (hashlib.md5(x).hexdigest() + ".png" for x in (b"A", b"B"))
    assert got == [
        ("7", "Signs", [("1", "just below its line", True, b), ("2", "", False, b)]),
        ("8", "Lights", [("1", "of eight", None, a), ("2", "", None, a), ("3", "on its header's line is not below", None, a)]),
        ("7", "Signs again", []),
        ("9", "Empty", []),
    ]


def scatter(rnd):
    """Random headers, tables and images on a coarse grid, so that places often coincide."""
    page = Layout()
    for number in range(1, 4):
        for y in rnd.sample(range(12), rnd.randrange(4)):
            page.header(number, y * 10 + rnd.choice([0.0, 0.25]), rnd.choice("123"), "Topic", rnd.choice("-–"))
        for y in rnd.sample(range(12), rnd.randrange(4)):
            choice = [["Numero", "T", "R"], ["1 ", " a\nb", "vero"], [None, "x", "FALSO"], ["2", None, ""], ["4", "d", "falso"], ["5x", "", ""], ["6", "short"]]
            page.table(number, y * 10 + rnd.choice([0.0, 0.3]), *rnd.sample(choice, rnd.randrange(6)))
        for _ in range(rnd.randrange(3)):
            page.image(number, float(rnd.randrange(120)), f"n{rnd.randrange(3)}", rnd.choice([400.0, 401.0]))
            page.asset(number, f"n{rnd.randrange(3)}", rnd.choice([b"a", b"b"]))
    return page


def test_random_layouts_agree_with_sql(spark, tmp_path):
    rnd, rows = random.Random(5), {k: [] for k in tables.LAYOUT}
    for d in range(60):
        for k, found in scatter(rnd).rows.items():
            rows[k] += [(f"d{d}", *r[1:]) for r in found]
    con = duckdb.connect()
    for name, fields in tables.LAYOUT.items():
        spark.createDataFrame(rows[name], fields).write.parquet(str(tmp_path / f"{name}.parquet"))
        names, kinds = zip(*(f.split(" ") for f in fields.split(", ")))
        con.register(name, pa.table([pa.array(list(c), ARROW[k]) for c, k in zip(zip(*rows[name]), kinds)], names=list(names)))
    found = quiz.questions(**tables.layout(spark, str(tmp_path)))
    want = sorted(con.execute(f"WITH {products.QUESTIONS_SQL} SELECT doc, seq, question_id, topic, n_rows, rows FROM questions").fetchall())
    assert sorted(tuple(r) for r in products.question_rows(found).collect()) == want and len(want) > 100
    sums = quiz.totals(found).first()
    assert (sums.questions, sums.sub_questions) == (len(want), sum(r[4] for r in want))
    sinks.write_questions(found, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == len(want)


def test_nearest_is_strict(spark):
    rows = spark.createDataFrame([(1, 5.0, "a"), (1, 4.0, "b"), (2, 9.0, "c")], "k int, y double, r string")
    marks = spark.createDataFrame([(1, 4.0, "m4"), (1, 5.0, "m5"), (2, 9.0, "m9")], "k int, y double, m string")
    got = {r.r: r.m for r in layout.nearest_before(rows, marks, ["k"], "y", ["m"]).collect()}
    assert got == {"a": "m4", "b": None, "c": None}


def test_ranges_equal_one_window(spark):
    """Scans in ordered ranges give what a window over the key gives, with a key that holds most rows, ties, nulls and ranges without a header."""
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([float(rnd.randrange(400)), None]), k, rnd.choice([None] * 9 + ["a", "b"])) for k in range(1500)]
    df = spark.createDataFrame(rows, "k int, y double, n int, h string")
    marks = df.where("h is not null").select("k", "y", F.col("n").alias("m"))
    key = lambda found: sorted(map(str, found.collect()))
    for ranges in (1, 7, 40):
        assert key(layout.segment(df, ["k"], ["y", "n"], F.col("h"), ranges=ranges).select("n", "seq", "seq_header")) == key(layout.segment(df, ["k"], ["y", "n"], F.col("h")).select("n", "seq", "seq_header"))
        assert key(layout.nearest_before(df, marks, ["k"], "y", ["m"], ranges=ranges)) == key(layout.nearest_before(df, marks, ["k"], "y", ["m"]))
        assert key(layout.nearest_after(df, marks, ["k"], "y", [], ["m"], ranges=ranges)) == key(layout.nearest_after(df, marks, ["k"], "y", [], ["m"]))
        text = df.select(F.col("n").cast("string").alias("n"), "k")
        assert key(links.numeric_place(text, ["n"], ["k"], ranges=ranges)) == key(links.numeric_place(text, ["n"], ["k"]))
        assert sorted(r.place for r in links.numeric_place(text, ["n"], [], ranges=ranges).collect()) == list(range(1, 1501))
    sizes = layout.in_ranges(df.where("y is not null"), ["k"], ["y", "n"], 8).groupBy("_range").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) <= 2 * sorted(r["count"] for r in sizes)[4]


def test_nearest_after_is_strict_and_takes_the_least(spark):
    rows = spark.createDataFrame([(1, 5.0, "a"), (1, 4.0, "b"), (2, 9.0, "c"), (1, None, "d"), (None, 1.0, "e")], "k int, y double, r string")
    marks = spark.createDataFrame([(1, 5.0, 2, "p"), (1, 5.0, 1, "q"), (1, 7.0, 3, "z"), (2, 9.0, 4, "s"), (2, None, 5, "t")], "k int, y double, ord int, m string")
    got = {r.r: r.m for r in layout.nearest_after(rows, marks, ["k"], "y", ["ord"], ["m"]).collect()}
    assert got == {"a": "z", "b": "q", "c": None, "d": None, "e": None}


def test_line_rounding_is_half_even(spark):
    df = spark.createDataFrame([(10.5, "a"), (11.5, "b"), (12.4, "c")], "top double, t string").withColumn("ord", F.monotonically_increasing_id())
    assert {r.y: r.line for r in layout.assemble(df, [], "top", "t", ["ord"]).collect()} == {10.0: "a", 12.0: "b c"}


def test_outcomes(spark):
    log = {"once": [200], "second": [500, 200], "never": [503, 503, 503], "missing": [404, 404, 404], "net": [None, None, 200], "fourth": [404, 404, 404, 200]}
    df = spark.createDataFrame([(u, i + 1, s) for u, x in log.items() for i, s in enumerate(x)], "url string, attempt int, status int")
    got = {r.url: (r.fetched, r.success_attempt, r.tries, r.wait_s) for r in crawl.outcomes(df, ["url"]).collect()}
    assert got == {"once": (True, 1, 1, 0.0), "second": (True, 2, 2, 15.0), "never": (False, None, 3, 90.0), "missing": (False, None, 3, 4.5), "net": (True, 3, 3, 4.5), "fourth": (False, None, 3, 4.5)}


def test_second_round_after_an_invalid_page(spark):
    log = [("good", 1, 1, 200, True), ("good", 2, 1, 200, False), ("cured", 1, 1, 200, False), ("cured", 2, 1, 500, None), ("cured", 2, 2, 200, True), ("lost", 1, 1, 404, None), ("lost", 2, 1, 200, True), ("bad", 1, 1, 200, None), ("late", 2, 1, 200, True)]
    df = spark.createDataFrame(log, "url string, round int, attempt int, status int, valid boolean")
    got = {r.url: (r.fetched, r.valid, r.rounds, r.tries, r.wait_s) for r in crawl.resolve(df, ["url"]).collect()}
    assert got == {"good": (True, True, 1, 1, 0.0), "cured": (True, True, 2, 3, 15.0), "lost": (False, False, 1, 1, 1.5), "bad": (True, False, 1, 1, 0.0)}
