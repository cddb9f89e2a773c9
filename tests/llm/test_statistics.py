"""The statistics of the quality classifier, one text at a time in plain Python."""

import math
import random
import re
import unicodedata

import numpy as np
import pyarrow.parquet as pq

from codexmill.llm import quality

from ..conftest import DATA
from . import helpers as H

STOPS, SYMBOLS = ".,;:'?-", "#$%&*+<=>@^_~\\/"


def kind(c):
    if c in STOPS:
        return "stop"
    if c in SYMBOLS:
        return "symbol"
    if c in "|!":
        return c
    k = unicodedata.category(c)
    return "upper" if k == "Lu" else "lower" if k[0] == "L" else "digit" if k[0] == "N" else "blank" if k[0] in "ZC" else "mark"


def by_hand(text):
    kinds = [kind(c) for c in text] + ["blank"]  # a text's end counts as a line's
    n, share = max(len(text), 1), lambda k: kinds.count(k) / max(len(text), 1)
    letters = kinds.count("upper") + kinds.count("lower")
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.translate(H.LOWER).encode())
    lines = text.translate(H.LOWER).split("\n")
    per = max(len(words), 1)
    mean = sum(map(len, words)) / per
    spread = math.sqrt(max(sum(len(w) ** 2 for w in words) / per - mean * mean, 0))
    shouted = kinds.count("upper") / max(letters, 1)
    return [
        math.log1p(len(text)), letters / n, shouted, share("digit"), share("blank"), share("stop"), share("symbol"), share("|"), share("!"), sum(ord(c) > 127 for c in text) / n,
        math.log1p(len(lines)), math.log1p(len(text) / len(lines)), mean, spread, len(set(words)) / len(words) if words else 1, len(set(lines)) / len(lines),
        math.log1p(len(words) / (1 + text.count(".") + text.count("?"))), sum(w[-1:] in (b"#", b"$", b"%", b"&", b"*", b"|", b"!", b"@") for w in words) / per,
        (shouted > 0.5) * sum(len(w) >= 2 for w in words) / per, share("mark"),
    ]


def test_statistics_equal_plain_python():
    rnd = random.Random(12)
    texts = [r or "" for r in pq.read_table(f"{DATA}/documents.parquet").column("text").to_pylist()] + [r[1] or "" for r in H.odd_rows()]
    texts += ["".join(rnd.choice("aB 9\n\t#|!.?,é漢٣́'\"()Ω") for _ in range(rnd.randrange(60))) for _ in range(300)]
    got = quality.describe(texts)
    want = np.array([by_hand(t) for t in texts])
    assert got.shape == (len(texts), len(quality.FEATURES))
    bad = np.argwhere(~np.isclose(got, want, rtol=2e-5, atol=2e-4))
    assert not len(bad), (texts[bad[0][0]][:50], quality.FEATURES[bad[0][1]], got[tuple(bad[0])], want[tuple(bad[0])])
