import os

import pytest

from voxgraph.llm import tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
TEXTS = ["", None, "It's 10 a.m., isn't it?", "  two  blanks\n\n\ttabs ", "日本語のテキスト。", "Ünïcödé " * 500, "<|endoftext|>", "a" * 3000, "🙂👍🏽"]


def test_equals_public_library():
    import tiktoken

    coder = tokens.encoder(PATH)
    ranks = dict(zip(coder.whole.keys, coder.whole.values))
    public = tiktoken.Encoding("public", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in TEXTS:
        if t:
            assert coder.encode(t, {}) == public.encode_ordinary(t)


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(1000)]
    h = tokens.PerfectHash(keys, list(range(1000)))
    assert [h.get(k) for k in keys] == list(range(1000)) and len(h.keys) == 1000
    assert h.get(b"absent") is None and h.get(b"") is None


def test_merges_reach_every_whole_token():
    coder = tokens.encoder(PATH)
    some = [k for k in coder.whole.keys if len(k) > 1][::97]
    assert all(coder.merge(k) == [coder.whole.get(k)] for k in some)


def test_null_and_empty_have_no_ids(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r.ids for r in tokens.token_ids(df, "text", "doc_id").collect()}
    assert rows[0] == [] and rows[1] == [] and len(rows) == len(TEXTS)
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "text", "doc_id").collect()}
    assert counts == {k: len(v) for k, v in rows.items()}
    assert tokens.token_ids(df.limit(0), "text", "doc_id").count() == 0
