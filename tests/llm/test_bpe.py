from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from cases import HARD, SMALL
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirework.llm import bpe
from quirework.llm.packing import PLAIN
from quirework.llm.queries import op11_bpe

PATH = P.path("byte_bpe_50k.json")
CODER = bpe.Coder(PATH, P.PATTERN)
LIBRARY = Tokenizer.from_file(PATH)

PIECES = ["a", "b", " ", "  ", "'", "re", "'s", "1", "23", ".", "!", "\n", "\t", "é", "中文", "\U0001f600", "<|endoftext|>",
          "<|", "endof", "text|>", "the ", " world", "́", " ", "​", "aaaaaaa", "        "]


def by_tree(text: str, leaf: int) -> bpe.Node:
    parts = [text[i: i + leaf] for i in range(0, len(text), leaf)] or [""]
    return bpe.join_all(CODER, [bpe.Node.of(CODER.ids_of(CODER.words(p))) for p in parts])


def library_ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 40))
def test_tree_gives_the_ids_of_the_library(parts, leaf):
    text = "".join(parts)
    node = by_tree(text, leaf)
    assert node.ids.tolist() == library_ids(text)
    whole = bpe.Node.of(CODER.ids_of(CODER.words(text)))
    assert node.begins.tolist() == whole.begins.tolist()
    assert CODER.decode(node.ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(1, 20))
def test_any_text(text, leaf):
    assert by_tree(text, leaf).ids.tolist() == library_ids(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "1" * 4000, " " * 3000 + "x", "中" * 3000, "\U0001f600" * 1500,
                                  "x" + "\n" * 3000 + " y", "<|endoftext|>" * 200, "abcabcabd" * 800])
def test_text_that_is_never_split(text):
    for leaf in (7, 1000):
        assert by_tree(text, leaf).ids.tolist() == library_ids(text)


def test_a_join_reads_little_of_a_long_word(monkeypatch):
    left, right = (by_tree("lorem" * 4000, 5000) for _ in range(2))
    read = []
    plain = CODER.bpe
    monkeypatch.setattr(CODER, "bpe", lambda data: read.append(len(data)) or plain(data))
    ids = bpe.join_ids(CODER, left.ids, right.ids)
    assert ids.tolist() == library_ids("lorem" * 8000) and sum(read) < 500


def test_both_splitters_agree_on_every_plain_character():
    characters = [c for c in map(chr, range(0x20C0)) if not PLAIN.search(c)]
    assert len(characters) > 690
    for c in characters:
        for text in (f"a{c}b", f" {c} x", f"{c}{c}7", f"'{c}s  {c}", f"1{c} {c}\n"):
            assert CODER.find(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=20))
def test_decoding_any_ids(ids):
    assert CODER.decode(np.array(ids, dtype="<u4")) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_encode_table(spark, hard, empty):
    rows = bpe.encode(hard, PATH, P.PATTERN, leaf=700, fan=4)
    got = sorted((str(r.doc_id), bytes(r.ids)) for r in rows.collect())
    assert got == sorted((str(d), np.array(library_ids(t or ""), dtype="<u4").tobytes()) for d, t, _, _ in HARD)
    back = bpe.decode(rows, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, _, _ in HARD)
    assert bpe.encode(empty, PATH, P.PATTERN).count() == 0


def test_registered_bpe(spark):
    digest = lambda data: hashlib.sha256(data).hexdigest()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want = set()
    for r in docs.collect():
        ids = library_ids(r.text)
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(text.encode())))
    rows = op11_bpe(spark, SMALL)
    assert dict(rows.dtypes)["n_tokens"] == "bigint"
    assert {tuple(r) for r in rows.collect()} == want
