from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from cases import HARD, LONG, SMALL
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quirework.llm import lines, quality
from quirework.llm.queries import op1_line_dedup


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i: i + 3])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    each = text.split("\n")
    dup = sum(1 for i, x in enumerate(each) if WORD.search(x) and x in each[:i]) if len(each) < 5000 else None
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c\n\t#|é\x0b", max_size=80))
def test_measures_match_plain_counts(text):
    assert quality.measure(text)[:5] == plain_measures(text)


def test_hard_rows_have_measures(hard, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) for r in quality.ledger(hard).collect())
    want = Counter((i, *(m for k, m in enumerate(plain_measures(t)) if k != 3)) for i, t, *_ in HARD)
    assert got == want
    assert quality.ledger(empty).count() == 0


def test_policies_and_ablations_come_from_the_bits(spark, make_docs):
    clean = " ".join(f"word{i}" for i in range(80))
    docs = make_docs([(1, clean), (2, "short"), (3, clean + " #$%" * 40), (4, clean.upper() + "!! " * 60)])
    rows = quality.ledger(docs)
    kept = {r.doc_id: (r.kept_base, r.kept_v1, r.kept_v2) for r in quality.apply_policies(rows).collect()}
    assert kept[1] == (True, True, True)
    assert kept[2] == (False, False, False)
    bits = {r.doc_id: r.failures for r in rows.collect()}
    for r in quality.ablations(rows).collect():
        whole, one = quality.mask(quality.POLICIES[r.policy]), quality.mask((r.rule,))
        assert r.n_failed == sum(b & one != 0 for b in bits.values())
        assert r.n_only_this == sum(b & whole == one for b in bits.values())
        assert r.n_rejected == sum(b & whole != 0 for b in bits.values())


def test_capitals_are_a_share_of_the_letters_of_all_scripts(make_docs):
    words = {"ru": "слово", "ar": "كلمة", "hi": "शब्द", "el": "λέξη", "zh": "文字"}
    rows = [(i, " ".join(f"{w}{n}" for n in range(80)) + " NATO EU", lang) for i, (lang, w) in enumerate(words.items())]
    rows += [(10, "СЛОВО " + " ".join(f"SHOUT{n}" for n in range(80)), "en"), (11, " ".join(f"ÉCOUTE{n}" for n in range(80)), "fr")]
    docs = make_docs(rows)
    bit = quality.mask(("capitals",))
    assert {r.doc_id for r in quality.ledger(docs).collect() if r.failures & bit} == {10, 11}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(range(len(words)))


def test_keep_good_keeps_columns(hard):
    assert quality.keep_good(hard).columns == hard.columns


def plain_dedup(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    count = Counter()
    for _, text, *_ in rows:
        count.update({key(x) for x in (text or "").split("\n")} - {""})
    out = []
    for i, text, *_ in rows:
        each = (text or "").split("\n")
        keep = [x for x in each if count[key(x)] < least]
        out.append((i, len(each), len(each) - len(keep), "\n".join(keep)))
    return Counter(out)


def test_line_dedup_on_hard_rows(hard, empty):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup(hard, min_docs=2).select(
        "_d.doc_id", "_lines.*").collect())
    assert got == plain_dedup(HARD, 2)
    assert lines.dedup(empty).count() == 0


def test_line_dedup_with_one_id_for_many_rows(make_docs):
    rows = [(None, f"shared\nother {i % 3}\nown {i}") for i in range(40)] + [(7, "shared\nsame")] * 12 + [(7, "own 1")]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup(make_docs(rows)).select(
        "_d.doc_id", "_lines.*").collect())
    assert got == plain_dedup(rows, 10)


def test_registered_query_matches_plain_rules(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, n, d, t), c in plain_dedup(docs, 10).items() for _ in range(c))
    assert Counter(tuple(r) for r in op1_line_dedup(spark, SMALL).collect()) == want


def test_adding_and_removing_is_reversible(spark, make_docs):
    old = [(i, "common\nshared %d\nown %d" % (i % 3, i)) for i in range(12)]
    new = [(100 + i, "common\nfresh line\nshared 1") for i in range(3)]
    old_occ, new_occ = (lines.occurrences(make_docs(x)) for x in (old, new))
    before = lines.reference_counts(old_occ)
    shards = lines.build_shards(before, 2, min_docs=3)
    after = lines.change_counts(before, added=new_occ)
    grown = lines.change_shards(shards, before, after, 2, min_docs=3)
    back = lines.change_counts(after, removed=new_occ)
    shrunk = lines.change_shards(grown, after, back, 2, min_docs=3)
    rows = lambda df: sorted(map(tuple, df.select("h1", "h2", "n_docs").collect()))
    assert rows(back) == rows(before)

    def members(shards, counts):
        every = np.array([(r.h1, r.h2) for r in counts.select("h1", "h2").collect()])
        found, exact = set(), set()
        for r in shards.collect():
            mine = every[every[:, 0] % 2 == r.shard]
            f = lines.CuckooFilter.from_row(r.buckets, r.stash)
            found |= set(map(tuple, mine[f.contains(mine)].tolist()))
            exact |= set(map(tuple, np.frombuffer(r["keys"], dtype="<i8").reshape(-1, 2).tolist()))
        return found, exact

    for state, counts in ((grown, after), (shrunk, back)):
        found, exact = members(state, after)
        assert exact == {(r.h1, r.h2) for r in counts.filter("n_docs >= 3").collect()}
        assert exact <= found
    assert members(shrunk, after)[1] == members(shards, after)[1]


def test_cuckoo_filter_survives_crowding():
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, size=(3000, 2))
    f = lines.CuckooFilter.sized(200)  # far too small: the stash takes the rest
    f.insert(keys)
    assert f.contains(keys).all()
    f = lines.CuckooFilter.sized(3000)
    f.insert(keys)
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all()
    assert f.contains(keys[:1500]).mean() < 0.01


def test_filters_grow_with_their_keys(spark):
    """From 1,000 to 9,000 duplicate keys: no shard's filter overflows into its stash."""
    import time

    keys = spark.range(9000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), "id")
    before = keys.filter("id < 1000").select("h1", "h2", F.lit(3).alias("n_docs"))
    after = keys.select("h1", "h2", F.lit(3).alias("n_docs"))
    shards = lines.build_shards(before, 2, min_docs=3)
    grown = lines.change_shards(shards, before, after, 2, min_docs=3).collect()
    every = np.array([(r.h1, r.h2) for r in after.collect()])
    for r in grown:
        f = lines.CuckooFilter.from_row(r.buckets, r.stash)
        assert not f.stash and f.has_room(len(np.frombuffer(r["keys"], dtype="<i8")) // 2)
        assert f.contains(every[every[:, 0] % 2 == r.shard]).all()
        assert f.contains(every[every[:, 0] % 2 != r.shard]).mean() < 0.01
    start = time.perf_counter()
    lines.CuckooFilter.sized(50_000).insert(np.random.default_rng(2).integers(-2**63, 2**63 - 1, size=(50_000, 2)))
    assert time.perf_counter() - start < 3


def test_a_very_long_text_is_whole(make_docs):
    r = quality.ledger(make_docs([(1, LONG)])).first()
    assert r.n_words == len(WORD.findall(LONG))
