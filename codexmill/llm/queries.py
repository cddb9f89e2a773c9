"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, line_dedup, lm_score, media_tiff, ngram_join, packing, periodic, pii, quality, quality_rules, spelling
from .shared import table


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = langid.held_out("doc_id", 7, 2)
    out = lm_score.score(table(spark, sf_dir, "documents"), ~apart)
    return out.select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiff.measure(media_tiff.store(table(spark, sf_dir, "documents")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymize(docs, pii.DEMO_KEY)

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("pii", lambda x: x["kind"] == kind)), F.lit(0)).alias(f"n_{kind}")

    return out.select("doc_id", "text", *map(count, pii.KINDS))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), with_ids=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    apart = langid.held_out("doc_id", 3, 1)
    out = quality.classify(docs, labels, ~apart)
    return out.select("doc_id", apart.alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "pages"), line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = langid.held_out("doc_id", 4, 2)
    out = langid.predict(docs.select("doc_id", "text"), langid.learn(docs.where(~apart)))
    return out.select("doc_id", apart.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def _crc(*parts: Column) -> Column:
    """crc32 of the parts as text, a null being empty."""
    return F.crc32(F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in parts]).cast("binary"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of which one letter is taken out now and then, by a hash of document and run; a null id counts as an empty one."""
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    h, run = _crc(F.col("id"), F.lit(":"), F.col("run")), F.col("run")
    at = (h % F.length(run)).cast("int")
    words = runs.select(F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run).alias("word"))
    return spelling.group_variants(spelling.count_words(words))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def repeated_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth text, by a hash of its id, goes on from some word with a short stretch of itself again and again; rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"), h.alias("h"), F.floor(h / 10).alias("g"))
    n, g = F.size("w"), F.col("g")
    start = (g % n).cast("int")
    placed = words.where("h % 10 = 0 and size(w) > 0").select("doc_id", "w", start.alias("a"), (1 + F.floor((n - start) / (3 + g % 8))).cast("int").alias("p"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(F.col("w"), F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    others = words.where("not coalesce(h % 10 = 0 and size(w) > 0, false)")
    return others.select("doc_id", "text").unionByName(placed.select("doc_id", F.array_join(again, " ").alias("text")))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(repeated_texts(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    length, period = -best["length"], best["period"]
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_langid": op4_langid,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_lm_score": op8_lm_score,
    "op9_media_tiff": op9_media_tiff,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling": op11_spelling,
    "op12_quality_rules": op12_quality_rules,
    "op13_periodic": op13_periodic,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": rf"""
        WITH p AS (
            SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '')) AS host,
                list_filter(
                    list_transform(string_split_regex(coalesce(html, ''), '{line_dedup.BREAKS}'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), chr(32) || chr(9) || chr(13) || chr(10) || chr(12))),
                    lambda x: x <> '') AS lines
            FROM pages),
        t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
        c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
        b AS (SELECT host, list(line) AS bad FROM c JOIN t USING (host) WHERE n >= {line_dedup.MIN_PAGES} AND n > total * {line_dedup.RATIO} GROUP BY host)
        SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text
        FROM (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM p LEFT JOIN b USING (host))
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256
        FROM d JOIN g USING (h)
    """,
    "op12_quality_rules": quality_rules.SQL,
}
