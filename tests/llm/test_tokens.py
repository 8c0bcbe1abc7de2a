"""Tokenizer and packing."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import packing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenizer.read_vocabulary(tokenizer.DEFAULT_VOCABULARY)
    return tokenizer.MergeTransducer(ranks), tiktoken.Encoding("t", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


HARD = ["", " ", "\n\n  x", "a" * 5000, "0" * 900, "哈" * 3000, "é" * 700, "<|endoftext|> y", "龍喚士の魔ーティサーティ" * 40, "don't WE'LL 'tis", "😀👨\u200d👩\u200d👧 x", "\u3000全角\u3000空白", "ab" * 400 + "龍喚士", "\u0000�"]


@pytest.mark.parametrize("text", HARD)
def test_equal_to_direct_merging(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("the ing龍士大の0189 \n'"))))
def test_equal_on_random_text(both, text):
    ids = both[0].encode(text)
    assert ids == both[1].encode_ordinary(text)
    decoder = tokenizer.IncrementalDecoder(both[2])
    assert "".join([*(decoder.feed([i]) for i in ids), decoder.feed([], True)]) == text


def test_tables(spark):
    rows = [(1, "监管 abc", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "x" * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = {r.doc_id: r.ids for r in tokenizer.encode_documents(docs).collect()}
    assert out[2] == [] and out[3] == [] and len(out[1]) > 2
    assert tokenizer.encode_documents(docs).count() == 5 and tokenizer.encode_documents(docs.limit(0)).count() == 0
    text = {r.doc_id: r.text for r in tokenizer.decode_ids(tokenizer.encode_documents(docs)).collect()}
    assert text[1] == "监管 abc" and text[2] == "" and text[4] == "x" * 30000
    assert {r.doc_id: r.n_tokens for r in tokenizer.count_tokens(docs).collect()}[1] == len(out[1])


def test_fill_is_whole_and_tight():
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 2049, 3000), rng.integers(1, 400, 5000), np.full(100, 1025), np.full(4096, 1), np.array([2048, 1, 2047]), np.zeros(0, np.int64)):
        box = packing.fill_containers(sizes.astype(np.int64), 2048)
        fill = np.bincount(box, weights=sizes) if len(sizes) else np.zeros(0)
        assert (fill <= 2048).all() and (fill > 0).all()
        if len(sizes) and sizes.max() < 1000:
            assert len(fill) <= np.ceil(sizes.sum() / 2048) + 1


def test_two_replace_one_if_tighter():
    # 6 + 3 leaves 1; the two 2s fill 3's place and the gap
    box = packing.fill_containers(np.array([6, 3, 2, 2]), 10)
    assert len({box[0], box[2], box[3]}) == 1 and box[1] != box[0]


def test_pack_cuts_only_what_is_larger(spark):
    rows = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, None), (5, 3), (5, 3)], "doc_id bigint, n_tokens int")
    out = packing.pack(rows, capacity=10, shard_items=3).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.part, r.start, r.n_tokens))
    assert sorted(by[1]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and by[2] == [(0, 0, 10)] and len(by[5]) == 2 and set(by) == {1, 2, 5}
    fill = {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 10
    assert packing.pack(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(rows, capacity=0)
