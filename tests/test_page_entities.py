"""Queries on pages and their SQL on entities without a semicolon."""

from __future__ import annotations

import duckdb
import pytest

from codexmill.plans import driver

TITLES = {
    1: ("und&amp", "und&"), 2: ("a&amp&amp b", "a&& b"), 3: ("&lt_x&gt;", "<_x>"), 4: ("&ampx &amp1", "&ampx &amp1"), 5: ("&amp;lt &amplt; &lt&amp", "&lt &amplt; <&"),
    6: ("&copyè&am", "©è&am"), 7: ("&quot;;&quot;", '";"'),
}


@pytest.mark.parametrize("name", ["page_title", "page_tokens", "page_ad_text", "page_nav_items"])
def test_entities_without_semicolon(spark, tmp_path, name):
    rows = [(k, f"u{k}", f'<nav><ul><li>{t}</li></ul></nav><div class="ad">{t}</div><h1>{t}</h1>') for k, (t, _) in TITLES.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = driver.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(driver.ORACLES[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if name == "page_title":
        assert dict(want) == {k: v for k, (_, v) in TITLES.items()}
