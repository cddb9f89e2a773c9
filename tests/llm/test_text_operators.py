import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import bpe, exact_dedup, langid, line_dedup, lm_score, media_tiff, ngram_join, packing, pii, quality, queries, shingles

from ..conftest import DATA
from . import helpers as H

pytestmark = pytest.mark.filterwarnings("ignore::RuntimeWarning")
RANKS = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
TOKENIZER = queries.tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(H.odd_rows(), H.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tiktoken_encoding):
    rnd = random.Random(1)
    letters = list("'''ssttrrevemlld  \n\t aàЖ漢٣5²Ⅷ!?-😀́\x1c\x85 ")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["", "a" * 5000, "'" * 200, " " * 500, "ab" * 999 + "'s"]
    ranks, coder = bpe.coder(RANKS)
    ids, ends = coder(texts)
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == tiktoken_encoding.encode_ordinary(text), text
    assert ranks.decode(ids)[0].tobytes() == "".join(texts).encode()


def test_scan_equals_step_by_step():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 5000, 70000):
        f = rnd.integers(0, 9, n).astype(np.uint8)
        state, want = bpe.FRESH, []
        for s in f.tolist():
            want.append(state)
            state = bpe._step(state, s)[0]
        assert bpe.scan(f).tolist() == want


def test_bpe_query(spark, given, odd, tiktoken_encoding):
    for df, texts in ((queries.op1_bpe(spark, DATA), given),):
        for r in df.collect():
            ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    coded = bpe.encode(odd, RANKS)
    back = bpe.decode(coded, RANKS)
    assert sorted(bytes(r.data).decode() for r in back.collect()) == sorted((r[1] or "") for r in H.odd_rows())
    assert bpe.encode(odd.limit(0), RANKS).count() == 0


def test_quality_on_rows_it_has_not_seen(spark, odd):
    d = "/root/testdata/sf0.01"
    got = queries.op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    unseen = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in unseen) > 0.95 * len(unseen) > 50
    assert all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 1), (None, 1), (7, None)], "doc_id bigint, quality int")
    out = quality.classify(odd, labels, F.lit(True)).collect()
    assert len(out) == len(H.odd_rows()) and all(0 <= r.score <= 1 for r in out)
    none = quality.classify(odd, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(odd.limit(0), labels, F.lit(True)).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    rnd = np.random.default_rng(1)
    y, n = rnd.random(200), rnd.integers(1, 9, 200)
    x, level = quality.isotonic(np.arange(200.0), y, n)
    assert (np.diff(level) > 0).all() and (np.diff(x) > 0).all()
    assert np.isclose(np.average(y, weights=n), level @ [n[(np.searchsorted(np.r_[x[:-1] / 2 + x[1:] / 2], np.arange(200.0))) == k].sum() for k in range(len(x))] / n.sum(), atol=0.2)


def test_line_dedup(spark, agrees):
    df = queries.op3_line_dedup(spark, DATA)
    assert agrees(df, queries.ORACLES["op3_line_dedup"]) > 0
    rows = [(i, f"http://H.example/{i}", f"top\nown {i}\n\n  foot  \nown {i}", "z") for i in range(10)] + [(20, "http://b.example/", "top\nfoot", None), (21, None, "top", None), (22, "http://h.example/x", None, None), (0, "http://h.example/0", "top", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, host string")
    make = lambda limit: line_dedup.drop_lines(pages, line_dedup.host_of(F.col("url")), line_dedup.text_lines(F.col("html")), broadcast_bytes=limit)
    got = sorted((r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in make(1 << 20).collect())
    assert got == sorted((r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in make(-1).collect())
    assert (3, "h.example", 4, 2, "own 3\nown 3") in got and (20, "b.example", 2, 0, "top\nfoot") in got and (21, "", 1, 0, "top") in got
    assert (22, "h.example", 0, 0, "") in got and (0, "h.example", 1, 1, "") in got and len(got) == 14
    assert line_dedup.drop_lines(pages.limit(0), F.col("host"), line_dedup.html_lines(F.col("html"))).count() == 0


def test_languages(spark, odd):
    d = "/root/testdata/sf0.01"
    got = queries.op4_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in unseen) > 0.97 * len(unseen) > 100
    profiles = langid.learn(odd)
    out = langid.predict(odd, profiles)
    assert out.columns == [*odd.columns, "lang_pred", "lang_score", "lang_distance"] and out.count() == len(H.odd_rows())
    assert {r.lang_pred for r in out.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert langid.learn(odd.limit(0)) == {} and langid.predict(odd.limit(0), profiles).count() == 0


def test_unknown_languages_go(spark):
    """Texts of a language that wasn't learnt, random letters and texts without letters go; short and long ones of a learnt language stay."""
    rnd = random.Random(5)
    known = "the house stands near the river and people walk along its banks in the evening when the light is soft and the water is still".split()
    other = "il mercato della piccola citta apre ogni mattina presto perche gli abitanti vogliono comprare pane fresco verdura olio".split()
    prose = lambda vocabulary, n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    noise = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 10))) for _ in range(n))
    rows = [(k, prose(known, n), "en") for k, n in enumerate([40, 80, 200, 400] * 10)]
    rows += [(100, "the river", None), (101, prose(known, 3000), None), (102, "The people walk.", None)]
    rows += [(200, noise(60), None), (201, noise(2000), None), (202, prose(other, 300), None), (203, "123 !!", None), (204, None, "en"), (205, "", None), (206, "漢字" * 40, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("row", F.lit("r")).withColumn("trained", F.lit(2)).withColumn("lang_pred", F.lit("own"))
    out = langid.known(df, F.col("doc_id") < 100)
    assert out.columns == df.columns and out.where("row <> 'r' or trained <> 2 or lang_pred <> 'own'").count() == 0
    assert sorted(r.doc_id for r in out.collect()) == [*range(40), 100, 101, 102]
    assert langid.known(df.limit(0), F.lit(True)).count() == 0 and langid.known(df, F.lit(False)).count() == 0


def test_texts_are_ranked_once(spark):
    """A filter on what a prediction gives doesn't rank the texts again, neither in the stage's two jobs."""
    df = spark.createDataFrame([(k, "the river runs " * (k + 1), "en") for k in range(8)] + [(8, "12", None), (9, None, "en")], "doc_id int, text string, lang string")
    profiles = langid.learn(df.where("lang is not null"))
    usual = langid.predict(df.select("text"), profiles, with_ngrams=True).where("lang_ngrams > 0").agg(F.percentile_approx("lang_distance", 0.5))
    judged = langid.predict(df, profiles).where("lang_pred <> 'und'").select("doc_id", "lang_pred", "lang_distance")
    for out in (usual, judged, langid.known(df, F.lit(True))):
        assert out._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    assert sorted(r.doc_id for r in judged.collect()) == [*range(8)] and usual.first()[0] is not None


def test_ngrams_by_brute_force():
    from collections import Counter

    for text in ["Ab c1d", "", "x", "Éa bc", "  a  "]:
        words_ = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        want = Counter()
        for w in words_:
            want.update(w)
        joined = "_" + "_".join(words_) + "_" if words_ else ""
        want.update(joined[i : i + 2] for i in range(len(joined) - 1))
        want.update(g for i in range(len(joined) - 2) if (g := joined[i : i + 3])[1] != "_")
        assert Counter(map(langid.readable, langid.ngrams([text])[0].tolist())) == want, text


def test_pii(spark):
    texts = ["born 1984-02-29, 31.12.1999, 30.02.2001 and 03/04/2010", "ssn 123-45-6789, 000-12-3456 ip 256.1.1.1 10.0.0.1. 9.9.9.9", "card 4111 1111 1111 1111 or 4111-1111-1111-1111, 4111111111111112", None, "", "plain text, 12 pages",
             "mail é.12@x.example.com +1 (743) 555-3824 97.51.17.173 token=\"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\"", "again 10.0.0.1 and 4111111111111111"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id int, text string, pii string")
    rows = {r.doc_id: r for r in pii.pseudonymize(df, "key").collect()}
    kinds = {i: [x.kind for x in r.pii] if r.pii is not None else None for i, r in rows.items()}
    assert kinds == {0: ["date"] * 3, 1: ["ssn", "ipv4", "ipv4"], 2: ["card", "card"], 3: None, 4: [], 5: [], 6: ["email", "phone", "ipv4", "secret"], 7: ["ipv4", "card"]}
    assert rows[5].text == texts[5] and rows[3].text is None and rows[4].text == "" and "30.02.2001" in rows[0].text and "4111111111111112" in rows[2].text
    linked = {x.value: x.pseudonym for r in rows.values() for x in r.pii or []}
    assert rows[1].pii[1].pseudonym == rows[7].pii[0].pseudonym
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(linked["4111 1111 1111 1111"]) == digits(linked["4111-1111-1111-1111"]) == linked["4111111111111111"]
    for i, r in rows.items():
        want = texts[i]
        for x in r.pii or []:
            assert x.pseudonym != x.value and len(x.pseudonym) == len(x.value) or x.kind == "ipv4"
            want = want.replace(x.value, x.pseudonym)
        assert r.text == want


def test_feistel_is_a_permutation(spark):
    every = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s")).select(pii.permuted(F.col("s"), "k", "t").alias("p"))
    assert every.distinct().where("p rlike '^[0-9]{3}$'").count() == 1000
    pairs = spark.range(270 * 7).select(pii.permuted_pair(F.col("id") % 270, F.floor(F.col("id") / 270), 270, 7, "k", "d").alias("p"))
    assert pairs.distinct().where("p.a between 0 and 269 and p.b between 0 and 6").count() == 270 * 7


def test_packing(spark, given, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)

    def check(pieces, texts):
        ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
        got, room = {}, {}
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            assert room.get(p.sequence_id, 0) == p.offset and p.offset + p.length <= 2048
            room[p.sequence_id] = p.offset + p.length
            got.setdefault(p.doc_id, []).append(p)
        for i, want in ids.items():
            at = 0
            for p in sorted(got[i], key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(want)) and p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(want)
        return 1 - sum(room.values()) / 2048 / len(room)

    assert check(queries.op6_packing(spark, DATA).collect(), given) < 0.02
    unique = {r[0]: r[1] for r in H.odd_rows()[:16]}
    check(packing.pack_documents(odd.where("sha is null and name = 'x'").dropDuplicates(["doc_id"]), TOKENIZER).collect(), unique)
    assert packing.pack_documents(odd, TOKENIZER).where("start = 0").count() == len(H.odd_rows())
    assert packing.pack_documents(odd.limit(0), TOKENIZER).count() == 0


def test_first_fit_by_brute_force():
    rnd = random.Random(4)
    for _ in range(50):
        sizes = sorted((rnd.randrange(1, 101) for _ in range(rnd.randrange(0, 80))), reverse=True)
        rooms, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(rooms) if r >= s), len(rooms))
            if k == len(rooms):
                rooms.append(100)
            rooms[k] -= s
            want.append(k)
        assert packing.first_fit(sizes, 100) == want


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 150])
def test_jaccard_components(spark, given, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.read.parquet(f"{DATA}/documents.parquet"), block=block).collect()}
    assert got == H.jaccard_components(given.items())


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 900])
def test_jaccard_components_of_a_large_group(spark, block):
    rnd = random.Random(8)
    pool = [f"w{k}" for k in range(4000)]
    base, other = rnd.choices(pool, k=120), rnd.choices(pool, k=120)
    texts = []
    for k in range(90):
        w = list(base if k % 3 else other)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(pool)
        texts.append(" ".join(w if k % 7 else w[: rnd.randrange(60, 120)]))
    rows = [(k, t) for k, t in enumerate([*texts, *texts[:20], "a b c d", "A b  c d", "a b c d e", "", None])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id int, text string"), block=block).collect()}
    assert got == H.jaccard_components(rows)


def test_chains_of_near_copies_are_dealt_over_buckets(spark, monkeypatch):
    """Chains of a large group reach many buckets, not one task."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40)) + f" x{i}") for i in range(400)], "doc_id int, text string").coalesce(1)
    seen, kept = [], type(docs).groupBy

    def spy(self, *keys):
        if keys == ("bucket",) and "chain" in self.columns:
            seen.extend(r.bucket for r in self.where("length(chain) > 0").collect())
        return kept(self, *keys)

    monkeypatch.setattr(type(docs), "groupBy", spy)
    ngram_join.candidates(docs, 6, np.zeros(1 << (ngram_join.BITS - 6), np.uint64), "text")
    assert len(set(seen)) > 16


def test_tasks_of_an_untied_group_hold_two_blocks(spark, monkeypatch):
    """Documents that share a passage but don't link make one group; no task gets all of it."""
    rows = [(i, " ".join([f"w{k}" for k in range(60)] + [f"x{i}y{k}" for k in range(12)])) for i in range(40)]
    links, most = ngram_join._links, []

    def spy(blocks):
        keys = [k for k in ("grp", "block", "guest") if k in blocks.columns]
        most.append(blocks.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0])
        return links(blocks)

    monkeypatch.setattr(ngram_join, "_links", spy)
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id int, text string"), block=300).collect()
    assert all(r.component_id == r.doc_id for r in out) and len(most) == 3
    assert max(most) < 40 * 68 * 3 // 4


def test_jaccard_odd_rows(spark, odd):
    out = ngram_join.jaccard_components(odd).collect()
    assert len(out) == len(H.odd_rows()) and all(r.component_id == r.doc_id for r in out if r.n_shingles == 0)
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0
    kept = ngram_join.keep_one(odd.where("doc_id is not null"))
    assert kept.columns == odd.columns


def test_shingle_sets_by_brute_force(given):
    texts = [*given.values(), "", "a", "a b c d e", "A B C D e f", "\t \n"]
    flat, ends = shingles.sets(texts)
    assert np.diff([0, *ends]).tolist() == [len(H.shingles(t)) for t in texts]


def test_language_model(spark, odd):
    texts = ["", "a", "Ab" * 20, "é\n"]
    gram, ends = lm_score.grams(texts)
    want = []
    for t in texts:
        b = bytes(lm_score.DEPTH) + t.lower().encode() + b"\0"
        want += [int.from_bytes(b[i : i + lm_score.DEPTH][::-1] + b[i + lm_score.DEPTH :][:1], "big") for i in range(len(b) - lm_score.DEPTH)]
    assert gram.tolist() == want and ends.tolist() == [1, 3, 44, 48]
    import math
    from collections import Counter

    rows = [r for r in H.odd_rows() if r[0] is not None]
    learnt = [r for r in rows if r[2] is not None]
    out = lm_score.score(odd.where("doc_id is not null"), F.col("lang").isNotNull()).collect()
    c = Counter(t for r in learnt for t in [*H.words(r[1]), None])
    n, v = sum(c.values()), len(c)
    base = sorted(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in [*H.words(r[1]), None]) for r in rows)
    assert np.allclose(sorted(r.base_score for r in out), base) and {r.train_tokens for r in out} == {n}
    assert sorted(r.n_known for r in out) == sorted(sum(c[t] > 0 for t in [*H.words(r[1]), None]) for r in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    blank = lm_score.score(odd, F.lit(False)).where("doc_id = 1").first()
    assert math.isclose(blank.score, 8 * math.log10(0.5)) and blank.train_tokens == 0


def test_context_tree_by_brute_force(spark):
    """The model's probability equals the recursive weighting over a small corpus."""
    import math

    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab c") for _ in range(60)) for _ in range(8)]
    counts = lm_score.materialize(lm_score.count(spark.createDataFrame([(t,) for t in texts], "text string")), "t")
    model = lm_score.learn(counts)
    depth, bits = lm_score.DEPTH, {}
    gram = lm_score.grams(texts)[0].tolist()
    for g in gram:
        for b in range(8):
            prefix = (1 << b) | (g & 255) >> (8 - b)
            for d in range(depth + 1):
                bits.setdefault((d, g >> 8 >> 8 * (depth - d), prefix), [0, 0])[g >> (7 - b) & 1] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    children = {}
    for d, c, p in bits:
        if d:
            children.setdefault((d - 1, c >> 8, p), []).append((d, c, p))
    stop = {}

    def weighted(node):
        own = kt(*bits[node])
        if node[0] == depth:
            stop[node] = 1.0
            return own
        both = np.logaddexp(own, sum(weighted(x) for x in children[node]))
        stop[node] = math.exp(own - both)
        return both - math.log(2)

    for node in [n for n in bits if n[0] == 0]:
        weighted(node)
    for g in rnd.sample(gram, 40):
        want = 0.0
        for b in range(8):
            prefix, left, one = (1 << b) | (g & 255) >> (8 - b), 1.0, 0.0
            for d in range(depth + 1):
                node = (d, g >> 8 >> 8 * (depth - d), prefix)
                z, o = bits[node]
                one += left * stop[node] * (o + 0.5) / (z + o + 1)
                left *= 1 - stop[node]
            want += math.log10(one if g >> (7 - b) & 1 else 1 - one)
        assert math.isclose(model.log10(np.array([g]))[0], want, rel_tol=1e-4)


@pytest.mark.parametrize("hot", [lm_score.HOT, 20, 0])
def test_language_model_keeps_rare_contexts(spark, hot, monkeypatch):
    """A context seen once among a million bytes stays in the model, and scores are those of the whole model."""
    monkeypatch.setattr(lm_score, "HOT", hot)
    texts = [(i, "ab " * 7000 + str(i), True) for i in range(60)] + [(60, "qzx vjk wqp", True), (61, "qzx vjk wq", False), (62, "kkk ü", None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string, learnt boolean").repartition(4)
    model = lm_score.learn(lm_score.materialize(lm_score.count(docs.where("learnt")), "t"))
    rare = np.sort(lm_score.grams([texts[60][1]])[0])
    assert np.isin(rare >> 8 << 8 | 1, model.node[lm_score.DEPTH]).all()
    got = {r.doc_id: r.score for r in lm_score.score(docs, F.col("learnt")).collect()}
    for i in (0, 60, 61, 62):
        assert np.isclose(got[i], model.log10(np.sort(lm_score.grams([texts[i][1]])[0])).sum(), rtol=1e-9)


def test_tiff_codecs_and_layouts():
    rnd = random.Random(3)
    for n in (0, 1, 300, 9000):
        for k in range(3):
            data = bytes(rnd.choice(b"abcab  \0") if k else rnd.randrange(256) for _ in range(n))
            assert media_tiff.lzw(media_tiff.to_lzw(data)) == data == media_tiff.packbits(media_tiff.to_packbits(data))
    # a code stream written out by hand: clear, 7, 7, 258 (7 7), 8, end
    assert media_tiff.lzw(int("".join(f"{c:09b}" for c in (256, 7, 7, 258, 8, 257)).ljust(56, "0"), 2).to_bytes(7, "big")) == b"\7\7\7\7\10"
    for compression in (1, 5, 8, 32773, 32946):
        for predictor in (1, 2):
            for tiled in (False, True):
                for order in "<>":
                    images = [np.frombuffer(rnd.randbytes(h * w), np.uint8).reshape(h, w) for h, w in ((1, 64), (200, 64), (130, 77))]
                    got = list(media_tiff.pages(media_tiff.write(images, compression, predictor, tiled, order)))
                    assert len(got) == 3 and all((p.samples[:, :, 0] == i).all() for p, i in zip(got, images))


def test_tiff_queries(spark, given, odd):
    for r in queries.op9_media_tiff(spark, DATA).collect():
        data = given[r.doc_id].encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = media_tiff.store(odd)
    assert media_tiff.measure(stored).count() == len(H.odd_rows())
    pages = media_tiff.explode_pages(stored).where("doc_id = 13 and page > 0").collect()
    assert len(pages) == 1 and pages[0].width == 64 and bytes(pages[0].pixels).rstrip(b"\0") == b"x" * (70000 - 65536)
    bad = spark.createDataFrame([(1, b"II*\0"), (2, None), (3, media_tiff.stored(b"y" * 64)[:-9]), (4, b"")], "doc_id int, media binary")
    assert {r.doc_id for r in media_tiff.explode_pages(bad).where("error is not null").collect()} == {1, 2, 3, 4}
    assert media_tiff.measure(stored.limit(0)).count() == 0


@pytest.mark.parametrize("block", [exact_dedup.BLOCK_BYTES, 16])
def test_exact_dedup(spark, agrees, odd, block, monkeypatch):
    assert agrees(queries.op10_exact_dedup(spark, DATA), queries.ORACLES["op10_exact_dedup"]) > 0
    if block == 16:
        # few buckets and fewer hashes, so that keys meet by their hash and are told apart by themselves
        monkeypatch.setattr(exact_dedup, "_hash", lambda key: F.pmod(F.xxhash64(key), F.lit(7)))
    rows = [(r[0], r[1]) for r in H.odd_rows()]
    df = exact_dedup.exact_dedup(odd.where("length(text) < 1000 or text is null") if block == 16 else odd, block_bytes=block)
    rows = [r for r in rows if block != 16 or len(r[1] or "") < 1000]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = df.collect()
    assert len(got) == len(rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = digest[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t in [(r[0], r[1]) for r in H.odd_rows()]})
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_exact_dedup_of_many_repeats_and_odd_names(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", 3)
    df = spark.createDataFrame([(1, "a")] * 10 + [(2, "a"), (3, "b")] + [(None, "c")] * 3, "`the.id` int, `the.text` string")
    got = exact_dedup.exact_dedup(df, "the.id", "the.text").collect()
    assert sorted(((r["the.id"] or 0, r.keep_id or 0, r.group_size, r.kept) for r in got)) == sorted([(1, 2, 11, False)] * 10 + [(2, 2, 11, True), (3, 3, 1, True)] + [(0, 0, 3, False)] * 2 + [(0, 0, 3, True)])
