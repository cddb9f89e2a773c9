"""Sinks: records and pages by law, questions as JSON, one row per distinct image."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest

#: Pages are split by a hash of their key; each bucket holds less than MERGE versions.
BUCKETS, MERGE = 32, 6
ATTEMPTS = 20
_PAGE_KEY = ["law", "filename"]


def _by_law(df: DataFrame, folder: str, kind: str, mode: str) -> None:
    # only the partitions that are written are replaced
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("law").format(kind).save(folder)


def write_articles(records: DataFrame, folder: str, kind: str = "json", mode: str = "overwrite") -> None:
    """One folder per law; JSON Lines keep non-ASCII letters as they are."""
    _by_law(records, folder, kind, mode)


def write_pages(pages: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Raw pages, one row for each (law, filename): a page that is written again replaces its older copy, all others stay.

    Of several rows with one key in ``pages`` that with the greatest url and text stays. The new pages are a version of their own, split into
    buckets by key; a bucket that would hold MERGE versions is merged into one, the others aren't touched. So a read opens
    less than MERGE versions of each bucket, after any number of writes, and a page is rewritten once in MERGE - 1 writes
    to its bucket. Versions count once the log (``manifest``) names them; of two writers at once the later one
    starts over. ``buckets`` holds for a new folder and is then fixed; choose it so that a bucket fits a few tasks.
    """
    spark = pages.sparkSession
    for _ in range(ATTEMPTS):
        number, state = manifest.last(spark, folder)
        many = state.get("buckets", buckets)
        held: dict[str, list[str]] = {b: list(v) for b, v in state.get("versions", {}).items()}
        one = pages.groupBy(*_PAGE_KEY).agg(F.max(F.struct("url", "html")).alias("page")).select(*_PAGE_KEY, "page.*")
        version = manifest.new_part(f"{number + 1:012d}")
        _write_version(one, folder, version, many)
        written = spark.read.schema("law string, _bucket int").option("basePath", folder).parquet(f"{folder}/version={version}")
        for row in written.select("_bucket").distinct().collect():  # at most as many as there are buckets
            held.setdefault(str(row[0]), []).append(version)
        full = {b: v for b, v in held.items() if len(v) >= MERGE}
        if full:
            merged = manifest.new_part(f"{number + 1:012d}")
            _write_version(_latest(spark, folder, full), folder, merged, many)
            held |= {b: [merged] for b in full}
        if manifest.commit(spark, folder, number + 1, {"buckets": many, "versions": held}):
            return
    raise RuntimeError(f"{folder}: others committed first {ATTEMPTS} times")


def _write_version(pages: DataFrame, folder: str, version: str, buckets: int) -> None:
    placed = pages.select(*_PAGE_KEY, "url", "html", F.pmod(F.xxhash64(*_PAGE_KEY), F.lit(buckets)).cast("int").alias("_bucket"))
    # large buckets are split over several tasks, small ones don't leave a file for each task
    placed.hint("rebalance", "_bucket").write.partitionBy("_bucket", "law").parquet(f"{folder}/version={version}")


def _latest(spark: SparkSession, folder: str, held: dict[str, list[str]]) -> DataFrame:
    """(law, filename, url, html): of each page of some buckets the latest version."""
    paths = [f"{folder}/version={v}/_bucket={b}" for b, versions in held.items() for v in versions]
    schema = "filename string, url string, html string, version string, _bucket int, law string"
    found = spark.read.schema(schema).option("basePath", folder).parquet(*paths) if paths else spark.createDataFrame([], schema)
    if any(len(v) > 1 for v in held.values()):
        # only keys and versions are dealt out for the choice; versions sort as they were committed
        newest = found.groupBy(*_PAGE_KEY).agg(F.max("version").alias("version"))
        found = found.join(newest, [*_PAGE_KEY, "version"])
    return found.select(*_PAGE_KEY, "url", "html")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(law, filename, url, html) as ``write_pages`` left them; what no commit names doesn't count."""
    return _latest(spark, folder, manifest.last(spark, folder)[1].get("versions", {}))


def write_page_files(pages: DataFrame, folder: str) -> int:
    """One file for each page, <folder>/<law>/<filename>, in UTF-8, as ``tables.raw_pages`` scans them; how many were written.

    Each task writes its own pages, so a repeated task writes the same files again. A null text is an empty file. The folder is a path or URI that
    every executor reaches and Arrow knows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for law, name, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system.create_dir(f"{top}/{law}", recursive=True)
                with system.open_output_stream(f"{top}/{law}/{name}") as out:
                    out.write((html or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return pages.select(*_PAGE_KEY, "html").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_questions(questions: DataFrame, folder: str, mode: str = "overwrite") -> None:
    questions.write.mode(mode).json(folder)


def write_assets(assets: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """(path, ext, content), one row for each distinct content; ``path`` comes from the content."""
    keyed = assets.withColumn("path", F.concat(F.md5("content"), F.lit("."), F.col("ext")))
    first = keyed.groupBy(F.md5("content").alias("hash")).agg(F.min_by(F.struct("path", "ext", "content"), F.struct("doc", "page", "ord")).alias("a"))
    first.select("a.*").write.mode(mode).parquet(folder)
