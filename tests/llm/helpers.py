"""Plain Python twins of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sha string, name string, bucket int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_components(rows):
    """{id: (size, component)} for (id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    lists, first = defaultdict(list), {}
    for i, x in sets.items():
        if not x:
            continue
        found = [first[x]] if x in first else []
        if not found:
            first[x] = i
            shared = Counter(y for t in x for y in lists[t])
            found = [y for y, k in shared.items() if 100 * k >= 75 * (len(x) + len(sets[y]) - k)]
            for t in x:
                lists[t].append(i)
        for y in found:
            a, b = sorted((find(i), find(y)))
            up[b] = a
    return {i: (len(x), find(i)) for i, x in sets.items()}


def odd_rows():
    """Nulls in all columns, empty and blank texts, ties, repeated rows, a long text, odd characters."""
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdeÀéß漢") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = text(80)
    near = base.replace(" ", "  ", 1) + " tail"
    texts = [None, "", " \t\n", "a", "A", base, base, near, base.upper(), text(3), text(5), text(40), text(60000), "x" * 70000, "  don't 12३ \x85!'s <|endoftext|> 😀", base + "\n" + base]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 4 == 0 else "s", len(t or ""), None, "x", 1) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (3, "other", None, None, None, None, None, None), (None, "no id", "en", None, None, None, None, None)]
