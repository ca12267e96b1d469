import random
import re
from collections import Counter

import numpy as np

from voxgraph.llm import fuzzy, golay


def test_two_words_within_two_bits_share_a_codeword():
    order = np.random.default_rng(1)
    x = order.integers(0, 1 << 23, 3000)
    flips = np.zeros_like(x)
    for _ in range(2):
        flips ^= np.where(order.random(len(x)) < 0.8, 1 << order.integers(0, 23, len(x)), 0)
    a, b = golay.codewords(x), golay.codewords(x ^ flips)
    assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))
    assert golay._remainder(golay.GENERATOR) == 0


def texts(n, seed):
    order = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    out = []
    for i in range(n):
        words = [order.choice(vocabulary) for _ in range(order.choice([23, 24, 25, 30, 37, 55, 80, 140]))]
        out.append(words)
        for _ in range(order.randint(0, 3)):
            copy = list(words)
            for _ in range(order.randint(0, max(1, len(copy) // 5))):
                at = order.randrange(len(copy))
                kind = order.random()
                if kind < 0.5:
                    copy[at] = order.choice(vocabulary)
                elif kind < 0.75:
                    del copy[at]
                else:
                    copy.insert(at, order.choice(vocabulary))
            if order.random() < 0.3:
                order.shuffle(copy)
            out.append(copy)
    return [(f"q{i:04d}", " ".join(w)) for i, w in enumerate(out)]


def brute(rows):
    docs = [(i, Counter(t.split()), len(t.split()), re.sub(r"\W", "", t)) for i, t in rows if t and len(t.split()) >= 24]
    return {(a[0], b[0]) for k, a in enumerate(docs) for b in docs[k + 1 :] if a[3] != b[3] and 20 * sum((a[1] & b[1]).values()) >= 17 * max(a[2], b[2])}


def test_no_pair_is_lost_and_none_is_false(spark):
    rows = texts(120, 5)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows + rows[:20]] + [("n", None, ""), (None, rows[0][1], ""), ("s", "short", "")], "id string, text string, codes string")
    got = {(r.lo, r.hi) for r in fuzzy.near_pairs(df, "id", "text").collect()}
    assert got == brute(rows) and len(got) > 50


def test_crowded_and_hot_keys_lose_nothing(spark, monkeypatch):
    base = [f"w{i}" for i in range(30)]
    rows = [(f"q{k:03d}", " ".join(base[:k % 30] + [f"x{k}"] + base[k % 30 + 1 :])) for k in range(70)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r.lo, r.hi) for r in fuzzy.near_pairs(df, "id", "text").collect()}
    assert got == brute(rows)


def test_keys_dealt_to_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "KEY_ROWS", 5)
    monkeypatch.setattr(fuzzy, "TASK_ROWS", 50)
    base = [f"w{i}" for i in range(30)]
    rows = [(f"q{k:03d}", " ".join(base[:k % 30] + [f"x{k % 3}"] + base[k % 30 + 1 :])) for k in range(45)]
    got = {(r.lo, r.hi) for r in fuzzy.near_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got == brute(rows)


def test_classes_and_links(spark):
    base = [f"w{i}" for i in range(30)]
    rows = [("a", " ".join(base)), ("b", " ".join(base[:-1] + ["x"])), ("c", " ".join(base).upper()), ("d", " ".join(f"v{i}" for i in range(30)))]
    out = {r.id: (r.class_id, r.links) for r in fuzzy.near_classes(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert out["a"][0] == out["b"][0] == out["c"][0] != out["d"][0] and out["a"][1] == 1 and out["d"][1] == 0


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert fuzzy.near_pairs(df, "id", "text").count() == 0 and fuzzy.near_classes(df, "id", "text").count() == 0
