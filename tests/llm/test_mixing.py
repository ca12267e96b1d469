import os
import random

import pytest

from voxgraph.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")


def tables(spark):
    order = random.Random(2)
    docs = [(i, "big", " ".join(["word"] * order.randint(1, 40)), 0) for i in range(300)] + [(1000 + i, "small", "tiny text here", 0) for i in range(12)]
    docs += [(2000, "other", "not listed", 0), (2001, None, "no source", 0), (2002, "big", None, 0), (2003, "big", "", 0), (None, "big", "no id", 0)]
    targets = [("big", 0.6, 1), ("small", 0.4, 5), ("none", 0.1, 3)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string, copies int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, targets = tables(spark)
    mixed, report = mixing.mix(docs, targets)
    rows = {r.source: r for r in report.collect()}
    assert rows["small"].actual_tokens == rows["small"].planned_tokens == 5 * rows["small"].available_tokens and rows["small"].most_copies == 5
    assert abs(rows["big"].actual_share - 0.6) < 0.006 and rows["none"].actual_tokens == 0 and not rows["big"].short
    assert {r.source for r in mixed.collect()} == {"big", "small"} and mixed.where("doc_id is null").count() == 0


def test_a_tiny_source_falls_short_instead_of_holding_the_mix_down(spark):
    docs, targets = tables(spark)
    tiny = spark.createDataFrame([("small", 0.04, 5), ("big", 0.96, 2)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mixing.mix(docs, tiny)[1].collect()}
    assert rows["small"].short and rows["small"].most_copies == 5 and rows["big"].planned_tokens == 2 * rows["big"].available_tokens
    rows = {r.source: r for r in mixing.mix(docs, tiny, tolerance=0.0)[1].collect()}
    assert not rows["small"].short and abs(rows["big"].actual_share - 0.96) < 0.01


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no tables here")
def test_shares_of_the_test_tables(spark):
    from voxgraph.llm.queries import p9_shares

    rows = [r for r in p9_shares(spark, "/root/testdata/sf0.1").collect() if r.available_tokens]
    assert len(rows) > 5
    for r in rows:
        assert abs(r.actual_share - r.fair_share) <= 0.01 * r.fair_share and abs(r.actual_tokens - r.planned_tokens) <= 0.01 * r.planned_tokens


def test_given_total_and_empty(spark):
    docs, targets = tables(spark)
    _, report = mixing.mix(docs, targets, total_tokens=100_000)
    rows = {r.source: r for r in report.collect()}
    assert all(rows[s].actual_tokens == rows[s].available_tokens * n for s, n in (("big", 1), ("small", 5)))
    mixed, report = mixing.mix(docs.limit(0), targets)
    assert mixed.count() == 0 and {r.actual_tokens for r in report.collect()} == {0}
