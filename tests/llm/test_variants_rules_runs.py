"""Spelling variants, adaptive quality rules and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import periodic, quality_rules, queries, spelling

from ..conftest import DATA, plain
from . import helpers as H


def clashing(spark, rows):
    """The rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, H.SCHEMA)
    return df.withColumns({c: F.lit(None).cast("int") for c in ("id", "w", "l", "h", "runs", "run", "word", "n", "a", "b", "kept", "level", "low", "windows", "collapsed", "g", "p")})


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def variants(counts):
    found = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        found[w] = (form, n, len(close), counts.get(form))
    out = {}
    for w, (form, *rest) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out[w] = (form, root, *rest)
    return out


def test_near_is_one_edit():
    assert near("abc", "abd") and near("abc", "abbc") and near("abbc", "abc") and near("aab", "aaab") and near("abc", "ab") and not near("abc", "acb") and not near("abc", "abc")


def test_variants_equal_brute_force(spark):
    rnd = random.Random(7)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))) for _ in range(500)} | {"aaaaaaa" + "a" * k for k in range(9)} | {"x" * 3000, "x" * 3001, "x" * 3003, "y" + "x" * 3000, "ÿabc", "àabc", "abcàÿ"}
    counts = {w: int(10 ** (rnd.random() * 4)) + 1 for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect()}
    assert got == variants(counts) and sum(v[2] for v in got.values()) > 500 and any(v[0] and v[0] != v[1] for v in got.values())
    assert spelling.group_variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(df, times=1)


def runs_of(docs):
    """The words that op11 counts."""
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(H.LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_op11_equals_brute_force_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, None, None, None, None, None, None) for r in docs] + H.odd_rows() + [(70, "x" * 20000, None, None, None, None, None, None)] * 2
    clashing(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling(spark, str(tmp_path)).collect()}
    assert got == variants(runs_of([r[:2] for r in rows])) and len(got) > 500 and any(v[0] for v in got.values())


def plain_runs(w, least, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            k = i
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            n = k - i + q
            if n >= max(least, times * q):
                found.setdefault((i, n), q)  # the smallest period of a stretch comes first
            i = k + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def smallest(w, runs):
    """Those whose period is the smallest of their stretch."""
    return [(s, n, q) for s, n, q in runs if not any(all(w[i] == w[i + d] for i in range(s, s + n - d)) for d in range(1, q))]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_brute_force(least, times):
    rnd = random.Random(times)
    for _ in range(400):
        w = [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):  # some stretches repeat
            if w:
                i, d = rnd.randrange(len(w)), rnd.randrange(1, 5)
                w[i:i] = w[i : i + d] * rnd.randrange(1, 6)
        assert periodic.runs(np.array([*w, 99]), least, times) == smallest(w, plain_runs(w, least, times)), w


def op13_by_hand(i, t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    n = len(w)
    if i is not None:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = smallest(w, plain_runs(w, 6, 4))
    drop = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_op13_equals_brute_force_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 4000").limit(150).select("doc_id", "text").collect()
    line = "one two three\n"
    more = [line * 9 + "end", "a " * 40 + "b " * 7 + "a b a b a b a b a", line * 5 + "x " + line * 4, "Was was was was was was\x85", "a\x1cb " * 9]
    rows = [(r.doc_id, r.text, None, None, None, None, None, None) for r in docs]
    rows += [(5000 + 37 * k, t, None, None, None, None, None, None) for k, t in enumerate(more * 9)] + [r for r in H.odd_rows() if len(r[1] or "") < 100_000]
    clashing(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op13_periodic(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((op13_by_hand(*r[:2]) for r in rows), key=str) and sum(r[1] > 0 for r in got) > 30


def test_long_and_many_repetitions(spark):
    df = spark.createDataFrame([(1, "w " * 150_000), (2, "a b c " * 60_000 + "d"), (3, None), (None, "e " * 7)], "doc_id bigint, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(df).collect()}
    assert got == {1: ([(0, 150_000, 1)], "w"), 2: ([(0, 180_000, 3)], "a b c d"), 3: ([], ""), None: ([(0, 7, 1)], "e")}
    assert periodic.find_runs(df.limit(0)).collect() == []


def test_ordered_positions():
    rnd, size = random.Random(3), periodic.BLOCK
    periodic.BLOCK = 4
    try:
        order = rnd.sample(range(300), 300)
        held, have = periodic.Positions(order[0]), [order[0]]
        for p in order[1:]:
            before, after = max((x for x in have if x < p), default=-1), min((x for x in have if x > p), default=-1)
            assert held.add(p) == (before, after)
            have.append(p)
        assert [p for b in held.blocks for p in b] == list(range(300))
    finally:
        periodic.BLOCK = size


def test_op12_agrees_with_its_sql_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    rnd = random.Random(4)
    rows = [(r.doc_id, r.text, rnd.choice([r.lang, None]), rnd.choice([r.source, None, None]), None, None, None, None) for r in docs]
    rows += [(10_000 + k, r[1], r[2], r[3], *r[4:]) for k, r in enumerate(H.odd_rows())] + [(20_000, "a b c " * 30 + "#$% \n\n" * 9, None, None, None, None, None, None)]
    path = str(tmp_path / "documents.parquet")
    clashing(spark, rows).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cur = con.execute(queries.ORACLES["op12_quality_rules"])
    names = [d[0] for d in cur.description]
    got = queries.op12_quality_rules(spark, str(tmp_path)).collect()
    assert sorted(tuple(plain(r[n]) for n in names) for r in got) == sorted(tuple(map(plain, r)) for r in cur.fetchall()) and len(got) == len(rows)
    assert 0 < sum(r.kept for r in got) < sum(not r.base_failed for r in got)


def test_quality_rules_keep_whole_rows(spark):
    df = clashing(spark, H.odd_rows())
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns
    judged = quality_rules.judge(df).where("kept")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in judged.collect())
    assert quality_rules.judge(df.limit(0)).collect() == [] and quality_rules.keep(df.limit(0)).collect() == []


def test_sketches_merge_and_bound_quantiles(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice("st"), 60, rnd.randrange(200, 900), rnd.randrange(30), 10, rnd.randrange(5), rnd.randrange(20)) for _ in range(2000)]
    stats = spark.createDataFrame(rows, "lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint")
    sketch = quality_rules.sketches(stats)
    halves = quality_rules.sketches(stats.where("word_chars % 2 = 0")).unionByName(quality_rules.sketches(stats.where("word_chars % 2 = 1")))
    key = ["lang", "source", "name", "low"]
    assert sorted(map(tuple, halves.groupBy(*key).agg(F.sum("n").alias("n")).collect())) == sorted(map(tuple, sketch.collect()))
    exact = sorted(1000 * r[3] // 60 for r in rows)
    low, high = exact[len(exact) // 4], exact[3 * len(exact) // 4]
    f = quality_rules._fences(sketch, []).first()
    reach = quality_rules.REACH * (high - low)
    assert abs(f.word_length_high - (high + reach)) < (7 * high + 3 * low) / 31 and f.total == 2000
