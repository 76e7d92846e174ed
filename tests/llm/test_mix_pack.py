from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import islice

import corpus_pipeline
import numpy as np
import pytest
from cases import HARD, SMALL
from hypothesis import given, settings, strategies as st

from quirework.llm import lines, mixing, packing, quality, simhash
from quirework.llm.queries import op5_mixing, op8_packing, tokenizer

from test_near import near, plain_components, plain_fingerprint
from test_quality_lines import plain_dedup


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.floats(0.01, 100), min_size=1, max_size=12), st.integers(1, 400))
def test_schedule_deviates_by_less_than_one_block(weights, slots):
    shares = mixing.period_of(weights, slots)
    period = sum(shares.values())
    plan = mixing.schedule(shares)
    assert sorted(t for _, _, t in plan) == list(range(period))
    given_ = Counter()
    for name, k, t in plan:
        assert k == given_[name]
        given_[name] += 1
        for s, p in shares.items():
            assert abs(given_[s] * period - (t + 1) * p) < period
    assert given_ == Counter(shares)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 6), st.integers(1, 500)), min_size=1, max_size=9), st.integers(1, 60), st.integers(1, 500))
def test_pieces_are_the_one_schedule(shares, length, end):
    period = sum(shares)
    names = {f"{i:03d}": p for i, p in enumerate(shares)}
    want = [(int(s), k, t) for s, k, t in islice(mixing.turns(names), end)]
    got, waiting = [], set()
    for first, last in mixing.pieces_of(shares, period, end, length):
        got += mixing.Piece(shares, period, first, last, waiting).turns()
        tried = mixing.Piece(shares, period, first, last)
        list(tried.turns())
        left = set(mixing.ones(mixing.bits(tried.left, len(shares))))
        waiting = mixing.Piece(shares, period, first, last, waiting).wait_on(tried.idle, left)
    assert got == want
    given_ = Counter()
    for i, _, t in got:  # less than one block from its due, for every source at every slot
        given_[i] += 1
        assert all(abs(given_[s] * period - (t + 1) * p) < period for s, p in enumerate(shares))


def test_the_run_is_spelled_in_many_tasks(spark):
    shares, end = [700, 250, 49, 1], 5000
    rows = mixing.spelled(spark, shares, end, 300)
    assert rows.rdd.getNumPartitions() == 17
    want = [(int(s), k, t) for s, k, t in islice(mixing.turns({str(i): p for i, p in enumerate(shares)}), end)]
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[2]) == want


def test_a_tiny_source_beside_a_large_one(spark, make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 500)
    rows = [(i, "x" * 10, "en", "big") for i in range(6000)] + [(10_000 + i, "y", "en", "tiny") for i in range(3)]
    out = mixing.mix(make_docs(rows), {"big": 1, "tiny": 1}, block_chars=10)
    found = out.select("_d.doc_id", "_s", "_block", "_epoch", "_slot").collect()
    turns = Counter(r._s for r in found)
    blocks = 6000 + 1  # the last block begins where the last document ends
    assert turns["big"] == 6000 and abs(turns["tiny"] / 3 - blocks) <= 1
    # every slot has the block that the schedule gives it
    plan = {(s, k): t for s, k, t in islice(mixing.turns({"big": 1, "tiny": 1}), 2 * blocks)}
    assert all(r._slot == plan[r._s, r._epoch + r._block if r._s == "tiny" else r._block] for r in found)
    # no cell holds more than a chunk of a block's turns
    plan_text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan_text


def test_mixed_documents_keep_their_shares(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300), "en", "abc"[min(2, i % 5)]) for i in range(900)]
    weights = {"a": 5, "b": 3, "c": 2}
    out = mixing.mix(make_docs(rows), weights, block_chars=1000, slots=20).collect()
    assert {r._d.doc_id for r in out} == {r[0] for r in rows}
    slot_of = defaultdict(set)
    for r in out:
        slot_of[r._slot].add(r._s)
        assert r._d.source == r._s
    assert all(len(s) == 1 for s in slot_of.values())  # a slot belongs to one source
    last = max(slot_of)
    # a slot may be empty where one long document covers it; the schedule's shares are exact
    plan = mixing.schedule(mixing.period_of(weights, 20))
    turn = {t: s for s, _, t in plan}
    assert all(s == {turn[t % 20]} for t, s in slot_of.items())
    chars = Counter()
    for r in out:
        chars[r._s] += len(r._d.text)
    total = sum(chars.values())
    for s, w in weights.items():
        assert abs(chars[s] / total - w / 10) < 0.02 + 1000 / total
    blocks = defaultdict(set)
    for r in out:
        blocks[r._s, r._d.doc_id].add(r._block)
    assert all(len(b) == 1 for b in blocks.values())  # epochs repeat the same blocks
    assert last > 0


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 1, "tiny": 0.001}])
def test_long_runs_stay_at_the_unrounded_targets(make_docs, weights):
    rows = [(i, "x" * 10, "en", "abc"[i % 3]) for i in range(9000)] + [(9000, "x" * 10, "en", "tiny")] * ("tiny" in weights)
    out = mixing.mix(make_docs(rows), weights, block_chars=10).collect()
    assert {r._d.doc_id for r in out} == {r[0] for r in rows}
    turn = {r._slot: r._s for r in out}
    total, given_ = sum(weights.values()), Counter()
    for t in range(max(turn) + 1):
        given_[turn.get(t)] += 1  # the block after the last document of a source is empty
        assert all(abs(given_[s] + given_[None] * (s in given_) - (t + 1) * w / total) < 1.05 + given_[None] for s, w in weights.items())
    assert given_[None] <= len(weights) * 3


def test_tiny_source_is_not_repeated_beyond_its_target():
    sizes = dict.fromkeys("abc", 10**8) | {"tiny": 200}
    targets = {s: n**mixing.TEMPER for s, n in sizes.items()}
    n_blocks = {s: n // 20_000 + 1 for s, n in sizes.items()}
    total, given_ = sum(targets.values()), Counter()
    for s, _, t in mixing.run_of(mixing.shares_for(targets, n_blocks), n_blocks):
        given_[s] += 1
        assert all(abs(given_[x] - (t + 1) * w / total) < 1.05 for x, w in targets.items())
    assert given_["tiny"] <= 2 and all(given_[s] >= n for s, n in n_blocks.items())


def test_more_sources_than_the_driver_may_hold_are_an_error(make_docs, monkeypatch):
    docs = make_docs([(i, "text", "en", f"s{i}") for i in range(4)])
    monkeypatch.setattr(mixing, "MAX_SOURCES", 4)
    assert mixing.mix(docs).count() >= 4
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="more than 3 sources"):
        mixing.mix(docs)


def test_mixing_hard_rows(hard, empty):
    out = mixing.mix(hard).collect()
    firsts = [r for r in out if r._epoch == 0]
    assert Counter((r._d.doc_id, r._d.text) for r in firsts) == Counter((i, t) for i, t, *_ in HARD)
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(hard, {"a": 1})


def test_registered_mixing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = op5_mixing(spark, SMALL)
    assert out.filter("epoch = 0").count() == docs.count()
    # the schedule again, block by block, with exact earliest deadlines
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(r.text or "")
    targets = {s: max(1.0, n) ** mixing.TEMPER for s, n in sizes.items()}
    shares = mixing.period_of(targets)
    period = sum(shares.values())
    at = {(s, k): t for s, k, t in mixing.schedule(shares)}
    for r in out.collect():
        n = sizes[r.source] // mixing.BLOCK_CHARS + 1
        k = r.block + r.epoch * n
        assert r.slot == k // shares[r.source] * period + at[r.source, k % shares[r.source]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=80))
def test_packer_fills_bins(lengths):
    packer, bins, number = packing.Packer(), [], 0
    for n in lengths:
        pieces = packing.cuts(n)
        assert sum(size for _, size in pieces) == n
        for start, size in pieces:
            full = packer.take((number, start, size))
            number += 1
            if full:
                k = 1024 // full[0][2]
                assert len(full) == k and all(1024 // p[2] == k for p in full)
                bins.append([p[2] for p in full])
    rest = [[b - a for _, a, b in parts] for parts in packer.finish()]
    assert sum(map(sum, bins + rest)) == sum(lengths)
    assert all(sum(b) <= 1024 for b in bins)
    assert all(sum(b) & (sum(b) - 1) == 0 for b in rest)  # powers of two, 1024 included


def check_pieces(rows, pieces, full):
    """``rows`` (doc_id, text) packed into ``pieces``."""
    want = Counter((i, (*full.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    texts = defaultdict(list)
    for (i, ids), n in want.items():
        texts[i] += [ids] * n
    assert by.keys() == texts.keys()
    for i, parts in by.items():
        got = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in parts)
        assert sum(p.length for p in parts) == sum(map(len, texts[i]))
        for start, length, crc, tokens in got:
            assert any(len(ids) == tokens and crc == zlib.crc32(np.array(ids[start: start + length], "<u4").tobytes())
                       for ids in texts[i])
        if len(texts[i]) == 1:
            at = 0
            for p in sorted(parts, key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(texts[i][0])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 1024
        used += at
        padded += at if at & (at - 1) == 0 else 1024
    return used, padded


def full_tokenizer():
    return packing.Encoder(**tokenizer()).full


def test_registered_packing(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    used, padded = check_pieces(rows, op8_packing(spark, SMALL).collect(), full_tokenizer())
    assert padded <= 1.02 * used


def test_packing_hard_rows(hard, empty):
    check_pieces([r[:2] for r in HARD], packing.pack(hard, **tokenizer()).collect(), full_tokenizer())
    assert packing.pack(empty, **tokenizer()).count() == 0


def test_both_tokenizers_agree_on_plain_characters():
    both = packing.Encoder(**tokenizer())
    plain = [chr(c) for c in range(0x3000) if not packing.PLAIN.search(chr(c))]
    assert len(plain) > 600
    for x in plain:
        for t in (f" {x}", f"a{x}b", f"1{x}2 {x}{x}  {x} .{x}", f"{x} {x}a{x}1", f"  {x}'{x}s\n{x}"):
            assert both.fast.encode_ordinary(t) == both.full.encode(t, add_special_tokens=False).ids
    assert both("<|endoftext|>").tolist() == both.full.encode("<|endoftext|>", add_special_tokens=False).ids


def test_pipeline_against_plain_python(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = quality.mask(quality.POLICIES[quality.CURRENT])
    bits = {r.doc_id: r.failures for r in quality.ledger(docs).collect()}
    good = [r for r in rows if bits[r[0]] & whole == 0]
    deduped = {i: t for i, _, _, t in plain_dedup(good, lines.MIN_DOCS)}
    ids = list(deduped)
    comp = plain_components([plain_fingerprint(deduped[i]) for i in ids], ids, near)
    left = {i for i, c in zip(ids, comp, strict=True) if i == c}
    step = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, SMALL)
        assert step.columns == docs.columns
    got = {r.doc_id: r for r in step.collect()}
    assert got.keys() == left
    assert all(got[i].text == deduped[i] for i in left)
    mixed = corpus_pipeline.mix_sources(spark, step, SMALL)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == left
    want = Counter((r.doc_id, r.text) for r in mixed.collect())
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    check_pieces([k for k, n in want.items() for _ in range(n)], pieces, full_tokenizer())


def test_stages_take_hard_and_empty_tables(spark, hard, empty):
    for docs in (hard, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            assert k == 4 or out.columns == docs.columns
            out.write.format("noop").mode("overwrite").save()
