from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import HARD
from hypothesis import given, settings, strategies as st

from quirework.llm import phrases

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count, top=2000, longest=5):
    """The contract's rules by brute force over all phrases."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f[lang or "und"][tuple(w[i:i + m])] += 1
    out = []
    for lang, c in f.items():
        often = {g: k for g, k in c.items() if k >= min_count and len(g) > 1}
        inside = {}
        for g, k in often.items():
            for m in range(1, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i:i + m]] = max(inside.get(g[i:i + m], 0), k)
        rated = []
        for g, a in often.items():
            if 100 * inside.get(g, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rated.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rated)[:top], 1)]
    return sorted(out)


def some_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "c\x1cd", "é", "x y", "to", "the", "\U0001f600"]
    fixed = ["to the end of it all", "The end. of it", "a a a a a a a"]
    out = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(6)]
        out.append((i, rng.choice([" ", "\t", ", ", "\n", "? "]).join(parts), rng.choice(["en", "en", "fr", None, "und"]), "s"))
    return out


@pytest.mark.parametrize("seed, rows", [(1, 100_000), (2, 7), (3, 1)])
def test_phrases_of_small_tables(make_docs, seed, rows):
    docs = some_docs(seed)
    got = phrases.collocations(make_docs(docs), min_count=4, rows=rows)
    assert sorted(map(tuple, got.collect())) == plain(docs, 4)
    few = phrases.collocations(make_docs(docs), min_count=4, max_words=3, top=5, rows=rows)
    assert sorted(map(tuple, few.collect())) == plain(docs, 4, 5, 3)


def test_full_tables_of_bits_change_nothing(make_docs, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_BITS", 64)
    monkeypatch.setattr(phrases, "HELD", 3)
    monkeypatch.setattr(phrases, "CHUNK", 10)
    docs = some_docs(4)
    assert sorted(map(tuple, phrases.collocations(make_docs(docs), min_count=3).collect())) == plain(docs, 3)


def test_hard_rows(hard, empty):
    got = phrases.collocations(hard, min_count=2)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")}
    assert sorted(map(tuple, got.collect())) == plain(HARD, 2)
    assert phrases.collocations(empty).count() == 0


def test_large_counts_are_exact(spark):
    a, n, l, r = 4 * 10**15, 9 * 10**18, 3 * 10**18, 7 * 10**15
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    from pyspark.sql import functions as F
    assert row.select(phrases.score("a", "n", F.col("l"), F.col("r"))).first()[0] == 1000 * a * n // (l * r)


@settings(max_examples=100, deadline=None)
@given(st.text("ab.,\n\t\x0b \r!é", max_size=200), st.integers(1, 30))
def test_chunks_end_where_pieces_end(text, size):
    old, phrases.CHUNK = phrases.CHUNK, size
    try:
        pieces = [[]]
        for chunk in phrases.chunks(text.encode()):
            pieces.append([])
            for w in chunk:
                pieces.append([]) if w == phrases.BREAK else pieces[-1].append(w.decode())
    finally:
        phrases.CHUNK = old
    want = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]
    assert [p for p in pieces if p] == [p for p in want if p]


def test_a_walk_needs_all_prefixes():
    walk = phrases.Walk()
    list(walk.take(0, ("a",), 5, True))
    with pytest.raises(ValueError):
        list(walk.take(0, ("a", "b", "c"), 3, True))


def test_hash_tables_hold_what_was_put_in():
    table = np.zeros(4, dtype=np.uint64)
    h = np.array([3, 64, 255, 2**63 + 7], dtype=np.uint64)
    for x in h.tolist():
        table[(x & 255) >> 6] |= np.uint64(1 << (x & 63))
    assert phrases.held(table, h).all() and not phrases.held(table, np.array([4, 9, 100], dtype=np.uint64)).any()
