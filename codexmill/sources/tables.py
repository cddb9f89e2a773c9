"""Sources: the given tables, raw pages under per-law folders, laws, and layout tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = "https://www.normattiva.it/uri-res/N2Ls?urn:nir:stato:decreto.legislativo:"
# Slug, table-of-contents URL and output name of the laws.
LAWS = [
    ("cds", _BASE + "1992-04-30;285!vig=", "codice_della_strada.json"),
    ("cap", _BASE + "2005-09-07;209!vig=", "codice_assicurazioni_private.json"),
]
LAYOUT = {
    "words": "doc string, page int, ord int, text string, top double, x0 double",
    "tables": "doc string, page int, ord int, top double",
    "table_rows": "doc string, page int, table_ord int, row_idx int, cells array<string>",
    "images": "doc string, page int, ord int, x0 double, top double, name string",
    "assets": "doc string, page int, ord int, name string, xref int, ext string, content binary",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def laws(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAWS, "law string, toc_url string, output_name string")


def named(files: DataFrame) -> DataFrame:
    """(law, filename, url, html) of whole-text rows with the path of their file."""
    path = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("law"), F.regexp_extract(path, r"([^/]+)$", 1).alias("filename"), path.alias("url"), F.col("value").alias("html")
    )


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages stored as <folder>/<law>/art_<number>_<sub>.html; an empty file is an empty page."""
    pattern = f"{folder}/*/art_*.html"
    # Spark's sources pass over files without a byte
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    empty = [(p.getParent().getName(), p.getName(), p.toUri().toString(), "") for f in files if f.getLen() == 0 for p in [f.getPath()]]
    pages = named(spark.read.text(pattern, wholetext=True)) if len(empty) < len(files) else None
    if pages is None or empty:
        nothing = spark.createDataFrame(empty, "law string, filename string, url string, html string")
        pages = nothing if pages is None else pages.unionByName(nothing)
    return pages


def layout(spark: SparkSession, folder: str, names: Iterable[str] = LAYOUT) -> dict[str, DataFrame]:
    """Layout tables of page documents (all five), stored as Parquet."""
    return {name: spark.read.schema(LAYOUT[name]).parquet(f"{folder}/{name}.parquet") for name in names}
