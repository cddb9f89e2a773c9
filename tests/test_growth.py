"""Steps whose cost once grew faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.operators import articles, links, markup
from codexmill.plans import products
from codexmill.sources.tables import given
from codexmill.streaming import incremental

from .conftest import DATA


def test_derived_pages_are_dealt_into_parts(spark):
    for pages in (products.law_pages(spark, DATA), products.law_contents(given(spark, DATA, "orders"))):
        sizes = pages.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 32 and sum(r["count"] for r in sizes) == pages.count()


def test_the_sink_parses_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(products.sinks, "write_articles", lambda records, folder: seen.append(records))
    monkeypatch.setattr(products, "_digest", lambda records: records)
    monkeypatch.setattr(type(spark.read), "json", lambda self, folder: None)
    products.article_sink(spark, DATA)
    assert len(seen) == 2 and all(df.inputFiles() and "/records-" in df.inputFiles()[0] for df in seen)


def test_links_are_stored_before_they_are_read_twice(spark, monkeypatch):
    seen = []
    split = links.split_numeric
    monkeypatch.setattr(links, "split_numeric", lambda found: (seen.append(found), split(found))[1])
    products.article_links(spark, DATA)
    assert "/found-links-" in seen[0].inputFiles()[0]


def test_links_with_equal_ids_have_an_order(spark):
    rows = [("cds", str(k * 7 % 50), "2", "1") for k in range(50)]
    good, _ = links.split_numeric(spark.createDataFrame(rows, "law string, src string, idArticolo string, idSottoArticolo string").repartition(8))
    assert [r.src for r in good.collect()] == sorted(r[1] for r in rows)


def test_nested_closings_and_many_commas(spark):
    comma = '<div class="art-comma-div-akn"><span class="comma-num-akn">{0}.</span><span class="art_text_in_comma">a <b>b<i>{0}</span></p></div>'
    html = '<h2 class="article-num-akn">Art. 7</h2>' + "".join(map(comma.format, range(40))) + '<div class="art-comma-div-akn">lost'
    page = spark.createDataFrame([("cds", "f", "u", html)], "law string, filename string, url string, html string")
    (r,) = articles.parse(page, products.KEYS).collect()
    assert r.paragraphs == [f"{k}. a b {k}" for k in range(40)] and len(r.rejected) == 1


def test_a_fold_has_few_steps(spark, monkeypatch):
    """Elements that nest are paired before the fold, so its steps are those of outer and of mis-nested elements."""
    seen = []
    step = markup._step
    comma = '<div class="art-comma-div-akn"><span class="comma-num-akn">1.</span><p><b>x</b></div>'
    page = spark.createDataFrame([("f", '<h2 class="article-num-akn">Art. 7</h2>' + comma * 50)], "filename string, html string")
    monkeypatch.setattr(markup, "_step", lambda state, entry: F.struct(state["stack"].alias("stack"), F.concat(state["done"], entry).alias("done")))
    plain = markup.outline(page, ["filename"], markup.any_class(*articles._ALL))
    assert plain.select(F.size("scopes").alias("n")).first().n == 51  # the pairs, without a fold; commas hold a "p" that isn't closed
    monkeypatch.setattr(markup, "_step", lambda state, entry: (seen.append(1), step(state, entry))[1])
    (r,) = markup.outline(page, ["filename"], markup.any_class(*articles._ALL)).collect()
    assert seen and len(r.scopes) == 101 and [s.close_i for s in r.scopes if "art-comma-div-akn" in s.cls] == [11 + 9 * k for k in range(50)]


def test_long_tags_and_open_quotes(spark):
    long = "<a href='" + "x" * 50000 + "'>y</a>"
    rows = [(1, f"<ul>{long}</ul>"), (2, '<ul>a<b title="c>d</b></ul>'), (3, "a < b <ul>c</ul>"), (4, '<ul title="x>y">z</ul>')]
    found = markup.outline(spark.createDataFrame(rows, "k int, html string"), ["k"], markup.any_tag("ul"))
    got = {r.k: r.t for r in found.select("k", F.transform("scopes", lambda x: markup.text_of(x, "+")).alias("t")).collect()}
    assert got == {1: ["y"], 2: ['a+b title="c>d'], 3: [], 4: ["z"]}


def test_held_pages_go_before_texts_are_grouped(spark, tmp_path, monkeypatch):
    """A page of a key that is held isn't sorted by its text, and of several new ones in a batch the least stays."""
    out, seen = str(tmp_path / "out"), []
    page = '<h3 class="article-num-akn">Art. {}</h3>'

    def run(rows, name):
        spark.createDataFrame([("cap", f, "u", h) for f, h in rows], "law string, filename string, url string, html string").write.parquet(str(tmp_path / name))
        incremental.extract_articles(incremental.page_tables(spark, str(tmp_path / name)), out, str(tmp_path / f"{name}-log")).awaitTermination()

    run([("a", page.format(2)), ("a", page.format(1))], "one")
    real = articles.parse
    monkeypatch.setattr(incremental.articles, "parse", lambda pages, keys: (seen.append(pages._jdf.queryExecution().optimizedPlan().toString()), real(pages, keys))[1])
    run([("a", page.format(0)), ("b", page.format(4)), ("b", page.format(3)), ("b", page.format(3))], "two")
    assert sorted((r.filename, r.number) for r in incremental.records(spark, out).collect()) == [("a", "1"), ("b", "3")]
    assert seen and seen[0].index("Aggregate") < seen[0].index("Join LeftAnti")  # the plan has the last step first
