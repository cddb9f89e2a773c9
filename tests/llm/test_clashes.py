"""Reserved names, repeated and null ids, and odd tables, by plain Python."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codexmill.llm import exact_dedup, langid, ngram_join, quality

from . import helpers as H


def test_all_ten_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_keep_one_goes_by_row(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base, "a"), (5, base, "b"), (5, base + " x", "c"), (7, base, "d"), (None, base, "e"), (5, "quite another text of nine words in all", "f"), (None, "quite another text of nine words in all", "g"),
            (9, "", "h"), (9, None, "i"), (None, "alone with a null id here now", "j"), (None, "alone with a null id here now", "k")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _row0 string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = [r["_row0"] for r in kept.collect()]
    assert len(got) == 5 and {"a", "f", "h", "i"} < set(got) and set(got) - {"a", "f", "h", "i"} <= {"j", "k"}
    assert ngram_join.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["cls", "component", "grp", "id", "text_", "n"])
def test_jaccard_with_any_id_name(spark, name):
    rows = [(3, "a b c d e f"), (4, "A b c d e f"), (5, None)]
    df = spark.createDataFrame(rows, f"{name} int, t string")
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(df, name, "t").collect()) == [(3, 2, 3), (4, 2, 3), (5, 0, 5)]


def test_exact_keep_one_with_clashing_columns(spark):
    rows = [(1, "x", "p"), (1, "x", "p"), (2, "x", "q"), (None, "y", "r"), (3, None, "s"), (4, "", "t")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _of string").withColumn("_sha0", F.lit(1)).withColumn("_i", F.lit(2))
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["_of"] for r in kept.collect()) == ["q", "r", "t"]


def test_language_with_clashing_columns(spark):
    df = spark.createDataFrame([("hello there", "en", "kept", 1.5)], "text string, lang string, _lang0 string, lang_score double")
    out = langid.predict(df, langid.learn(df))
    assert out.columns == ["text", "lang", "_lang0", "lang_pred", "lang_score", "lang_distance"] and out.first()["_lang0"] == "kept"


def test_distances_of_odd_rows_by_plain_python(spark):
    """The whole prediction, on odd texts and two learnt languages, restated with counters and lists."""
    from collections import Counter

    rows = [r for r in H.odd_rows() if r[0] is not None and len(r[1] or "") < 3000]
    df = spark.createDataFrame(rows, H.SCHEMA)
    grams = lambda t: Counter(langid.ngrams([t or ""])[0].tolist())
    order = lambda c: [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][: langid.PROFILE]
    learnt = {}
    for r in rows:
        if r[2] is not None:
            learnt.setdefault(r[2], Counter()).update(grams(r[1]))
    profiles = {k: {g: i for i, g in enumerate(order(c))} for k, c in learnt.items()}
    got = {r.sha or r.text: r for r in langid.predict(df, langid.learn(df)).collect()}
    for r in rows:
        own = order(grams(r[1]))
        far = {k: sum(min(abs(p[g] - i), langid.PROFILE) if g in p else langid.PROFILE for i, g in enumerate(own)) / max(1, len(own)) / langid.PROFILE for k, p in profiles.items()}
        best = min(sorted(far), key=lambda k: far[k]) if own else "und"
        assert got[r[1]].lang_pred == best and abs(got[r[1]].lang_distance - (far[best] if own else 1.0)) < 1e-9


def test_quality_with_reserved_id_names(spark):
    for name in ("x", "y", "fold", "score_"):
        docs = spark.createDataFrame([(k, "good text here" if k % 2 else "!!! $$$") for k in range(40)], f"{name} int, text string")
        labels = spark.createDataFrame([(k, k % 2) for k in range(40)], f"{name} int, quality int")
        out = quality.classify(docs, labels, F.lit(True), id_col=name).collect()
        assert all(r.predicted == r[name] % 2 for r in out)


def test_quality_model_by_brute_force(spark):
    """Sums by partition and fold give the ridge fit, and the calibration, that plain numpy gives on all rows at once."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, k = 200, len(quality.FEATURES)
    x = rng.normal(size=(n, k)).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    described = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "doc_id int, x array<float>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id int, quality int")
    model = quality.fit(described, labels, fourier=16)
    mean, scale = x.astype(float).mean(0), np.maximum(x.astype(float).std(0), 1e-3)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    z = np.column_stack([np.sqrt(2 / 16) * np.cos(np.clip((x - mean) / scale, -8, 8) @ model.weights.T + model.phases), np.ones(n)])

    def ridge(a, b):
        return np.linalg.solve(a.T @ a + quality.RIDGE * len(a) / 17 * np.eye(17), a.T @ b)

    assert np.allclose(model.beta, ridge(z, y), atol=1e-6)
    fold = np.array([r.f for r in spark.range(n).select(F.pmod(F.xxhash64(F.col("id").cast("int")), F.lit(quality.FOLDS)).alias("f")).collect()])
    raw = np.zeros(n)
    for f in range(quality.FOLDS):
        raw[fold == f] = z[fold == f] @ ridge(z[fold != f], y[fold != f])
    bins = np.clip(np.round(raw * quality.BINS), -quality.BINS, 2 * quality.BINS)
    found = np.unique(bins)
    level = np.array([y[bins == b].mean() for b in found])
    weight = np.array([(bins == b).sum() for b in found])
    # isotonic regression by its min-max form
    best = [max(min(np.average(level[i : j + 1], weights=weight[i : j + 1]) for j in range(m, len(found))) for i in range(m + 1)) for m in range(len(found))]
    assert np.allclose(np.unique(np.round(best, 9)), np.unique(np.round(model.levels, 9)))


def test_texts_are_dealt_once_for_the_kept_rows(spark):
    """Kept rows and repeated ones are found with one shuffle of the texts; null ids and repeated rows come out once."""
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (None, "a", "z"), (None, "b", "p"), (None, "b", "p"), (3, None, "q"), (4, "", "r"), (5, "c", "s")], "doc_id int, text string, source string")
    out = exact_dedup.keep_one(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id or 0, r.text, r.source) for r in out.collect()) == [(0, "b", "p"), (2, "a", "y"), (4, "", "r"), (5, "c", "s")]
    assert plan.count("Exchange hashpartitioning(_key") == 1 and "hashpartitioning(doc_id" not in plan and "hashpartitioning(coalesce(doc_id" not in plan
