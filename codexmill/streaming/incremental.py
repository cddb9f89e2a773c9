"""Streams that add to a table only rows whose key it doesn't hold yet: article records, and links by first occurrence.

The table has a log of its own (``sources.manifest``). It, and not the checkpoint of a stream, says what is there: a fresh or lost
checkpoint, a batch that is repeated, one that broke off half-written, and a second stream into the same table all leave
each key once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import articles, links
from ..sources import manifest, tables

KEYS = ["law", "filename"]
#: Keys are split by their hash: a batch reads only the shards that its own keys fall into.
SHARDS = 64
#: So many parts of one level are merged into one of the next, so n batches leave some MERGE * log(n) parts of keys.
MERGE = 8
#: Times that a batch starts over if other writers commit first.
ATTEMPTS = 20


def page_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of pages that land as <folder>/<law>/art_<number>_<sub>.html."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(f"{folder}/*/art_*.html")
    return tables.named(raw)


def page_tables(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of pages that land as Parquet files of (law, filename, url, html)."""
    return table_stream(spark, folder, "law string, filename string, url string, html string", files_per_batch)


def table_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of rows that land as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _shard(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int")


def _keys(spark: SparkSession, out: str, parts: list[str], schema: str) -> DataFrame:
    found = spark.read.schema(f"{schema}, part string, _shard int").option("basePath", f"{out}/keys").parquet(*[f"{out}/keys/part={p}" for p in parts])
    return found.drop("part")


def append_new(rows: DataFrame, keys: list[str], out: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append ``make`` of those rows whose keys the table at ``out`` doesn't hold; ``make`` keeps keys and gives each once, as ``rows`` has them if it is left out.

    Null keys count as equal. Records are written first, then their keys, then the commit that names both.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    for _ in range(ATTEMPTS):
        number, state = manifest.last(spark, out)
        records, levels = state.get("records", []), state.get("keys", [])
        fresh = rows.withColumn("_shard", _shard(keys))
        if levels:
            touched = [r[0] for r in fresh.select("_shard").distinct().collect()]  # SHARDS at most
            old = _keys(spark, out, [p for level in levels for p in level], schema).where(F.col("_shard").isin(touched)).toDF(*[f"_old{i}" for i in range(len(keys))], "_old")
            same = F.col("_shard") == F.col("_old")
            for i, k in enumerate(keys):
                same &= F.col(k).eqNullSafe(F.col(f"_old{i}"))
            fresh = fresh.join(old, same, "left_anti")
        part = manifest.new_part("batch")
        made = make(fresh.drop("_shard"))
        made.write.parquet(f"{out}/records/part={part}")
        added = spark.read.schema(made.schema).parquet(f"{out}/records/part={part}").select(*keys)
        if records and added.isEmpty():
            return
        added.withColumn("_shard", _shard(keys)).repartition("_shard").write.partitionBy("_shard").parquet(f"{out}/keys/part={part}")
        state = {"records": [*records, part], "keys": _merged(spark, out, levels, part, schema)}
        if manifest.commit(spark, out, number + 1, state):
            return
    raise RuntimeError(f"{out}: others committed first {ATTEMPTS} times")


def _merged(spark: SparkSession, out: str, levels: list[list[str]], part: str, schema: str) -> list[list[str]]:
    """Parts of keys by level with a new one; a level that is full becomes one part of the next."""
    levels = [[*levels[0], part], *levels[1:]] if levels else [[part]]
    k = 0
    while len(levels[k]) >= MERGE:
        merged = manifest.new_part("merged")
        _keys(spark, out, levels[k], schema).repartition("_shard").write.partitionBy("_shard").parquet(f"{out}/keys/part={merged}")
        if k + 1 == len(levels):
            levels.append([])
        levels[k], levels[k + 1] = [], [*levels[k + 1], merged]
        k += 1
    return levels


def records(spark: SparkSession, out: str) -> DataFrame:
    """The table as its last commit has it."""
    _, state = manifest.last(spark, out)
    if not state:
        raise ValueError(f"{out} holds no commit")
    return spark.read.option("basePath", f"{out}/records").parquet(*[f"{out}/records/part={p}" for p in state["records"]]).drop("part")


def _stream(source: DataFrame, one: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    return source.writeStream.foreachBatch(lambda batch, number: one(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_articles(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse new pages batch by batch and append the records that ``out`` doesn't hold yet, keyed by law and filename.

    A page that is delivered again, whatever its text, adds nothing. Of several in one batch, that with the least url and text stays.
    """

    def one(batch: DataFrame) -> None:
        parts = batch.rdd.getNumPartitions()

        def made(fresh: DataFrame) -> DataFrame:
            # after the held keys are gone, so that texts of pages that are at hand aren't dealt and sorted for this; into as many parts
            # as the batch was read in, since adaptive execution puts pages together by their compressed bytes, and parsing is work by row
            first = fresh.repartition(parts, *KEYS).groupBy(*KEYS).agg(F.min(F.struct("url", "html")).alias("page")).select(*KEYS, "page.*")
            return articles.parse(first, KEYS)

        append_new(articles.split_valid(batch)[0], KEYS, out, made)

    return _stream(pages, one, checkpoint)


def collect_links(tocs: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Article links of table-of-contents pages as they land: the first of each (keys, article, sub-article) over all batches stays.

    Within a batch the first is that of the smallest place, as ``links.article_links`` has it.
    """
    link_keys = [*keys, "idArticolo", "idSottoArticolo"]
    return _stream(tocs, lambda batch: append_new(links.article_links(batch, keys), link_keys, out), checkpoint)


def pending_links(spark: SparkSession, out: str, done: DataFrame, keys: list[str]) -> DataFrame:
    """Links that the stream has seen and whose pages aren't at hand."""
    return records(spark, out).join(done.select(*keys), keys, "left_anti")
