import html as library
import random
from html import parser as html_parser

import pytest
from pyspark.sql import functions as F

from codexmill.functions import scalars
from codexmill.operators import articles, links, markup
from codexmill.sources import manifest, sinks, tables
from codexmill.streaming import incremental

HTML = """<!DOCTYPE html>\r\n<html><body><script>var a = '<div class="article-num-akn">no</div>';</script>
<section><h3 class="big article-num-akn">Art.&nbsp;12-ter</h3>
<p class="article-heading-akn">(On <i>rivers</i> and&#160;lakes).</p>
<ul>
<li class="art-comma-div-akn"><b class="comma-num-akn">1. </b><em class="art_text_in_comma">Water &laquo;flows&raquo; <a href="#">down</a>.<br></em></li>
<li class="art-comma-div-akn"><b class="comma-num-akn">2. </b>no text of its own</li>
<li class="art-comma-div-akn"><em class="art_text_in_comma">))</em><em class="art_text_in_comma">second</em></li>
</ul></section></body></html>"""
REPEALED = '<h3 class="article-num-akn">Art. 5</h3><q class="art_abrogato-akn">none left</q>'
PREAMBLE = '<h3 class="article-num-akn">Art. 6</h3><p class="article-heading-akn">of <b>the</b>law</p><p class="article-pre-comma-text-akn">We&nbsp;say&#39;s<br>&egrave; so'
KEYS = ["law", "filename"]


def pages(spark):
    rows = [("cap", "art_0012_3.html", HTML), ("cap", "art_0005_1.html", REPEALED), ("cds", "art_0006_1.html", PREAMBLE), ("cds", "art_0001_1.html", "<p>gone</p>"), ("cds", "art_0002_1.html", None)]
    return spark.createDataFrame([(a, b, "u/" + b, c) for a, b, c in rows], "law string, filename string, url string, html string")


def test_records(spark):
    valid, bad = articles.split_valid(pages(spark))
    assert {r.filename for r in bad.collect()} == {"art_0001_1.html", "art_0002_1.html"}
    got = {r.filename: r for r in articles.parse(valid, KEYS).collect()}
    a = got["art_0012_3.html"]
    assert (a.number, a.title, a.text, a.repealed) == ("12-ter", "Onriversand\xa0lakes", "", False)
    assert a.paragraphs == ["1. Water «flows» down .", "))"]
    b = got["art_0005_1.html"]
    assert (b.number, b.title, b.text, b.paragraphs, b.repealed, b.repealed_article) == ("5", "", "", [], True, True)
    c = got["art_0006_1.html"]
    assert (c.number, c.title, c.text) == ("6", "ofthelaw", "We\xa0say's è so")
    assert [r.filename for r in articles.rejected_commas(articles.parse(valid, KEYS), KEYS).collect()] == ["art_0012_3.html"]


def test_pages_are_worked_on_in_their_rows(spark):
    plan = articles.parse(articles.split_valid(pages(spark))[0], KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan and plan.count("aggregate(") == 1
    kept = markup.outline(pages(spark), KEYS, markup.any_tag("h3")).where(F.size("scopes") > 0)
    assert kept._jdf.queryExecution().executedPlan().toString().count("aggregate(") == 1  # a filter doesn't repeat the fold


class Stack(html_parser.HTMLParser):
    """Scopes and texts of a page by a plain stack of open elements."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.found, self.texts, self.data = wanted, [], [], [], ""

    def flush(self):
        if self.data.strip():
            self.texts.append(self.data.strip())
        self.data = ""

    def handle_data(self, data):
        self.data += data

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in markup.VOID:
            entry = [len(self.found), tag, len(self.texts), None] if tag in self.wanted else None
            self.open.append((tag, entry))
            if entry:
                self.found.append(entry)

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if any(t == tag for t, _ in self.open):
            while True:
                t, entry = self.open.pop()
                if entry:
                    entry[3] = len(self.texts)
                if t == tag:
                    break

    def scopes(self):
        self.flush()
        return [(tag, "+".join(self.texts[a:b])) for _, tag, a, b in self.found]


def test_scopes_equal_a_stack_parser(spark):
    rnd, rows = random.Random(6), []
    for k in range(300):
        parts = [rnd.choice(["<div>", "</div>", "<a>", "</a>", "<p>", "</p>", "<b>", "</b>", "<br>", "<i/>", "x", " y ", "&nbsp;", "z&amp;"]) for _ in range(rnd.randrange(30))]
        rows.append((k, "".join(parts)))
    rows.append((300, "<a><h2>n</h2><div><div>(( (Con</a> of rest) ))</div> tail</div><p>after</p>"))  # an element opened outside ends within
    rows.append((301, "<div>" * 200 + "deep" + "</div>" * 199))
    df = spark.createDataFrame(rows, "k int, html string")
    found = markup.outline(df, ["k"], markup.any_tag("div", "p", "a"))
    got = {r.k: [tuple(x) for x in r.s] for r in found.select("k", F.transform("scopes", lambda x: F.struct(x["tag"], markup.text_of(x, "+"))).alias("s")).collect()}
    for k, text in rows:
        parser = Stack({"div", "p", "a"})
        parser.feed(text)
        parser.close()
        assert got[k] == parser.scopes(), text
    assert got[300] == [("a", "n+(( (Con"), ("div", "(( (Con"), ("div", "(( (Con"), ("p", "after")]


def test_entities_equal_the_library(spark):
    texts = ["&rsquo;&#8217;&#x2019;", "&laquo;x&raquo; &Agrave;&euro;", "&amp;lt; &amp", "&unknown; & &;", "&#0;&#xD800;&#1114112;", "&#150;&#128;", "no", "&NotEqualTilde;&copy 2020&nbsp"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.decode_entities(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == {t: library.unescape(t) for t in texts}


@pytest.mark.parametrize(("inner", "outer"), [("u", "ol"), ("ol", "ol")])
def test_nested_elements(spark, inner, outer):
    df = spark.createDataFrame([(1, f"<{outer}>a<{inner}>b</{inner}>c</{outer}>d"), (2, ""), (3, None)], "k int, html string")
    got = {r.k: r.t for r in markup.outline(df, ["k"], markup.any_tag("u", "ol")).select("k", F.transform("scopes", lambda x: markup.text_of(x, "+")).alias("t")).collect()}
    assert got == {1: ["a+b+c", "b"], 2: [], 3: []}


def test_unclosed_elements_reach_to_the_end(spark):
    df = spark.createDataFrame([(1, "<ul><li>a<li>b</ul><p>c")], "k int, html string")
    found = markup.outline(df, ["k"], markup.any_tag("ul", "p"))
    got = found.select(F.explode("scopes").alias("s"), "texts").select("s.tag", markup.text_of(F.col("s"), "+").alias("text")).collect()
    assert {r.tag: r.text for r in got} == {"ul": "a+b", "p": "c"}


def test_links(spark):
    q = "art.versione=1&art.idGruppo=2&art.flagTipoArticolo={}&art.codiceRedazionale=X&art.idArticolo={}&art.idSottoArticolo={}&art.idSottoArticolo1=10&art.dataPubblicazioneGazzetta=1992-05-18 00%3A00&{}"
    parts = [q.format(0, 10, 1, "art.progressivo=5"), q.format(1, 3, 1, ""), q.format(0, 2, 3, "&"), q.format(0, 10, 1, "art.progressivo=9"), q.format(0, "x", 1, ""), "idArticolo=100&art.flagTipoArticolo=0&idSottoArticolo=7&idSottoArticolo=8&art.versione="]
    html = "".join(f"<a onclick=\"caricaArticolo?{p}\">" for p in parts)
    toc = spark.createDataFrame([("cds", "toc", html)], "law string, src string, html string")
    good, bad = links.split_numeric(links.article_links(toc, ["law", "src"]))
    rows = links.with_names(good, tables.laws(spark)).collect()
    assert sorted((int(r.idArticolo), r.idSottoArticolo, r.progressivo, r.label, r.filename) for r in rows) == [
        (2, "3", "0", "Art. 2 ter", "art_0002_3.html"), (10, "1", "5", "Art. 10", "art_0010_1.html"), (100, "7", "0", "Art. 100 (7)", "art_0100_7.html")]
    assert [int(r.idArticolo) for r in good.collect()] == [2, 10, 100]
    assert "art.dataPubblicazioneGazzetta=1992-05-18+00%3A00&art.progressivo=" in next(r.url for r in rows if r.idArticolo == "2")
    assert all(r.output_name == "codice_della_strada.json" for r in rows)
    assert [r.idArticolo for r in bad.collect()] == ["x"]


def test_stream_equals_batch_and_replays_add_nothing(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    (raw / "cap").mkdir(parents=True)
    (raw / "cap/art_0012_3.html").write_text(HTML)
    run = lambda: incremental.extract_articles(incremental.page_files(spark, str(raw)), out, str(tmp_path / "ckpt")).awaitTermination()
    run()
    (raw / "cap/art_0005_1.html").write_text(REPEALED)
    run()
    (raw / "cap/art_0012_3.html").write_text(HTML + " ")  # delivered again
    run()
    cols = ["law", "filename", "number", "title", "paragraphs", "repealed"]
    got = sorted(map(str, incremental.records(spark, out).select(*cols).collect()))
    valid, _ = articles.split_valid(tables.raw_pages(spark, str(raw)))
    assert got == sorted(map(str, articles.parse(valid, KEYS).select(*cols).collect())) and len(got) == 2


def land(spark, folder, rows):
    spark.createDataFrame([(a, b, "u", c) for a, b, c in rows], "law string, filename string, url string, html string").coalesce(1).write.mode("append").parquet(folder)


def test_a_lost_checkpoint_leaves_each_key_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    page = '<h3 class="article-num-akn">Art. {}</h3>'
    lots = [[("cap", f"art_{k:04d}_1.html", page.format(k)) for k in range(a, b)] for a, b in ((0, 25), (15, 40))]
    for lot in lots:
        land(spark, folder, lot)
        incremental.extract_articles(incremental.page_tables(spark, folder), out, str(tmp_path / "first")).awaitTermination()
    incremental.extract_articles(incremental.page_tables(spark, folder, 1), out, str(tmp_path / "fresh")).awaitTermination()
    assert sorted(r.number for r in incremental.records(spark, out).collect()) == sorted(map(str, range(40)))


def test_a_half_written_batch_counts_for_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    rows = lambda a, b: spark.createDataFrame([(k, None if k % 5 == 0 else "v") for k in range(a, b)], "k int, v string")
    incremental.append_new(rows(0, 10), ["k", "v"], out)
    for broken in ("new_part", "commit"):  # before anything is written, and after records and keys were

        def fail(*_):
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(manifest, broken, fail)
            with pytest.raises(OSError):
                incremental.append_new(rows(5, 15), ["k", "v"], out)
        assert incremental.records(spark, out).count() == 10
    incremental.append_new(rows(5, 15), ["k", "v"], out)
    incremental.append_new(rows(5, 15), ["k", "v"], out)  # repeated after its commit
    assert sorted(r.k for r in incremental.records(spark, out).collect()) == list(range(15))


def test_two_writers_and_merged_keys(spark, tmp_path, monkeypatch):
    out, rows = str(tmp_path / "out"), lambda a, b: spark.createDataFrame([(k,) for k in range(a, b)], "k int")
    incremental.append_new(rows(0, 3), ["k"], out)
    real, other = manifest.commit, []

    def beaten(spark_, folder, number, content):
        if not other:
            other.append(1)
            incremental.append_new(rows(2, 6), ["k"], out)  # another writer is first
        return real(spark_, folder, number, content)

    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", beaten)
        incremental.append_new(rows(3, 8), ["k"], out)
    assert sorted(r.k for r in incremental.records(spark, out).collect()) == list(range(8))
    monkeypatch.setattr(incremental, "MERGE", 2)
    for k in range(8, 13):
        incremental.append_new(rows(k - 1, k + 1), ["k"], out)
    _, state = manifest.last(spark, out)
    assert all(len(level) < 2 for level in state["keys"]) and sorted(r.k for r in incremental.records(spark, out).collect()) == list(range(13))


def test_rewritten_pages_stay_in_few_files(spark, tmp_path):
    folder = str(tmp_path / "pages")
    for k in range(9):
        land(spark, f"{folder}-{k}", [("cap", f"art_{i:04d}_1.html", f"{k} {i}") for i in range(k, 12)])
        sinks.write_pages(spark.read.parquet(f"{folder}-{k}"), folder, buckets=2)
        _, state = manifest.last(spark, folder)
        assert all(len(v) < sinks.MERGE for v in state["versions"].values()) and state["buckets"] == 2
    got = {r.filename: r.html for r in sinks.read_pages(spark, folder).collect()}
    assert got == {f"art_{i:04d}_1.html": f"{min(i, 8)} {i}" for i in range(12)}
    assert sinks.read_pages(spark, str(tmp_path / "none")).count() == 0


def test_page_files_are_scanned(spark, tmp_path):
    rows = [("cap", "art_0001_1.html", "è\r\n\r\nx"), ("cds", "art_0001_1.html", ""), ("cds", "art_0002_1.html", "€ 漢")]
    land(spark, str(tmp_path / "in"), rows)
    assert sinks.write_page_files(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out")) == 3
    assert sorted((r.law, r.filename, r.html) for r in tables.raw_pages(spark, str(tmp_path / "out")).collect()) == rows


def test_sinks(spark, tmp_path):
    records = articles.parse(articles.split_valid(pages(spark))[0], KEYS)
    sinks.write_articles(records, str(tmp_path / "a"))
    sinks.write_articles(records.where("law = 'cds'"), str(tmp_path / "a"))
    back = spark.read.json(str(tmp_path / "a"))
    assert back.count() == 3 and back.where("law = 'cds'").first().text.endswith("è so")
    sinks.write_pages(pages(spark).unionByName(pages(spark)), str(tmp_path / "p"))
    changed = pages(spark).where("filename = 'art_0005_1.html'").withColumn("html", F.lit("changed"))
    sinks.write_pages(changed, str(tmp_path / "p"))
    kept = {r.filename: r.html for r in sinks.read_pages(spark, str(tmp_path / "p")).collect()}
    assert len(kept) == 5 and kept["art_0005_1.html"] == "changed" and kept["art_0012_3.html"] == HTML
    assets = spark.createDataFrame([("d", 1, k, f"n{k}", k, "png", bytearray(b)) for k, b in enumerate([b"x", b"x", b"y"])], tables.LAYOUT["assets"])
    sinks.write_assets(assets, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
