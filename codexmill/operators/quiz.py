"""A question bank from page-layout tables: words, tables, table rows, images, assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import layout as L

# Fixed value: images of a question lie to the right of this place.
IMAGE_LEFT = 400.0
_PAGE = ["doc", "page"]


def content_images(images: DataFrame, left: float = IMAGE_LEFT) -> DataFrame:
    return images.where(F.col("x0") > left)


def image_below(rows: DataFrame, images: DataFrame, assets: DataFrame, left: float = IMAGE_LEFT) -> DataFrame:
    """Rows (with doc, page, from_y) and ``image``: the path of the topmost content image below from_y.

    If its name is not among the page's assets, the image is null, whatever lies further down.
    """
    below = content_images(images, left).select(*_PAGE, F.col("top").alias("from_y"), "ord", "name")
    named = L.nearest_after(rows, below, _PAGE, "from_y", ["ord"], ["name"])
    paths = L.content_paths(assets, "content", F.col("ext")).select(*_PAGE, "name", "ord", "path")
    return L.lookup_last(named, paths, [*_PAGE, "name"], "ord", ["path"]).withColumnRenamed("path", "image").drop("name")


def questions(words: DataFrame, tables: DataFrame, table_rows: DataFrame, images: DataFrame, assets: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc, seq, question_id, topic, sub_questions): every question of every document, in order.

    On each page, tables come first, from the top, each with the nearest header strictly
    above it; then headers that no table has claimed, from the top. A new question starts
    where the header differs from the current one. A table without a header belongs to
    the current question. The first image found for a question holds from there on.
    Documents are independent; a document is one ordered state machine over its pages, scanned in so many ``ranges`` if one may be very large.
    """
    heads = L.headers(L.assemble(words, _PAGE, "top", "text", ["x0", "ord"]), _PAGE)
    placed = tables.select(*_PAGE, F.col("ord").alias("table_ord"), F.col("top").alias("y"))
    above = heads.withColumn("head_y", F.col("y"))
    matched = L.nearest_before(placed, above, _PAGE, "y", ["qid", "topic", "head_y"])
    lone = L.unclaimed(heads, matched.where("qid is not null").select(*_PAGE, "qid").distinct(), [*_PAGE, "qid"])
    events = matched.withColumn("phase", F.lit(0)).unionByName(lone.withColumn("phase", F.lit(1)), allowMissingColumns=True)
    order = ["page", "phase", "y", "table_ord"]
    seqs = L.segment(events, ["doc"], order, F.col("qid"), ranges=ranges).where("seq > 0")
    numbered = Window.partitionBy("doc", "seq").orderBy(*order)
    seqs = seqs.withColumn("nth", F.row_number().over(numbered))
    # a table that starts a question looks below its header; one without a header looks at its whole page
    looks = seqs.where("phase = 0 and (qid is null or nth = 1)").select("doc", "page", "seq", "nth", F.coalesce("head_y", F.lit(0.0)).alias("from_y"))
    found = image_below(looks, images, assets).select("doc", "seq", "nth", F.col("image").alias("candidate"))
    seqs = seqs.join(found, ["doc", "seq", "nth"], "left").withColumn("image", L.first_so_far(["doc", "seq"], ["nth"], F.col("candidate")))
    topics = seqs.where("nth = 1").select("doc", "seq", F.col("seq_header").alias("question_id"), "topic")
    cells = table_rows.select(*_PAGE, "table_ord", "row_idx", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)])
    cells = cells.where(S.is_number(F.col("c0")) & ~F.contains(F.col("c0"), F.lit("Numero")))
    rows = seqs.where("phase = 0").select("doc", "seq", "nth", "page", "table_ord", "image").join(cells, [*_PAGE, "table_ord"])
    sub = F.struct("nth", "row_idx", S.strip(F.col("c0")).alias("number"), S.one_line(F.col("c1")).alias("text"), S.answer(F.col("c2")).alias("correct_answer"), "image")
    nested = rows.groupBy("doc", "seq").agg(F.array_sort(F.collect_list(sub)).alias("all"))
    plain = F.transform("all", lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"), x["correct_answer"].alias("correct_answer"), x["image"].alias("image")))
    none = F.array().cast("array<struct<number:string,text:string,correct_answer:boolean,image:string>>")
    return topics.join(nested, ["doc", "seq"], "left").select("doc", "seq", "question_id", "topic", F.coalesce(plain, none).alias("sub_questions"))


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("questions"), F.sum(F.size("sub_questions")).alias("sub_questions"))
