import random
from datetime import datetime, timedelta

from voxgraph.llm import consensus

SCHEMA = "annotation_id long, annotator string, quote_id string, status string, sentiment string, qid string, saved_at timestamp, label string"


def saves(seed=1, items=200):
    order = random.Random(seed)
    truth, rows, start = {}, [], datetime(2021, 1, 1)
    care = {"a": 0.95, "b": 0.9, "c": 0.85, "d": 0.8, "always": None, "liar": 0.1, "coin": 0.5}
    for i in range(items):
        q = f"q{i}"
        truth[q] = "keep" if order.random() < 0.65 else "reject"
        for who in order.sample(sorted(care), 5):
            right = who == "always" or order.random() < care[who]
            said = "keep" if who == "always" else truth[q] if right else {"keep": "reject", "reject": "keep"}[truth[q]]
            rows.append((len(rows), who, q, f" {said.upper()}", "positive" if said == "keep" else None, "Q1" if said == "keep" else None, start + timedelta(hours=len(rows)), "x"))
            if order.random() < 0.2:
                rows.append((len(rows), who, q, "pending", None, None, start - timedelta(days=1), "x"))
    return truth, rows


def test_beats_majority_and_sees_liars(spark):
    truth, rows = saves()
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)
    got = {r.quote_id: r.label for r in consensus.annotation_labels(df).where("label_field = 'status'").collect()}
    right = sum(got[q] == t for q, t in truth.items())
    votes = {}
    for r in rows:
        if r[3].strip() in ("KEEP", "REJECT"):
            votes.setdefault(r[2], []).append(r[3].strip().lower())
    majority = sum((v.count("keep") * 2 > len(v)) == (truth[q] == "keep") for q, v in votes.items())
    assert right >= majority and right > 0.9 * len(truth)
    rel = {r.annotator: r.reliability for r in consensus.annotator_reliability(df).where("field = 'status'").collect()}
    assert rel["a"] > rel["d"] > rel["coin"] > rel["liar"] and rel["liar"] < 0


def test_blocks_of_votes_and_joined_rates_give_the_same(spark):
    _, rows = saves(3, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda out: {(r.quote_id, r.label_field): (r.label, r.agreement, round(r.confidence, 6)) for r in out.collect()}
    want = key(consensus.annotation_labels(df))
    assert key(consensus.annotation_labels(df, block=2)) == want and key(consensus.annotation_labels(df, block=2, sent=0)) == want


def test_nulls_ties_and_empty(spark):
    t = datetime(2021, 1, 1)
    rows = [
        (1, "a", "q", "keep", "Not about", None, t, ""), (2, "b", "q", "keep ", "not_about", None, t, ""), (3, None, "q", "keep", "mixed", "Q2", t, ""), (4, "c", None, "keep", None, None, t, ""), (5, "c", "r", None, None, None, t, ""),
        (6, "c", "s", "reject", "mixed", "Q2", t, ""), (7, "d", "t", "keep", None, "q7", None, ""), (8, "d", "t", "reject", None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.quote_id, r.label_field): r.label for r in consensus.annotation_labels(df).collect()}
    assert got[("q", "status")] == "keep" and got[("q", "sentiment")] == "not_about" and ("q", "qid") not in got
    assert got[("s", "status")] == "reject" and ("s", "qid") not in got and got[("t", "status")] == "reject" and "r" not in {k[0] for k in got}
    empty = df.limit(0)
    assert consensus.annotation_labels(empty).count() == 0 and consensus.annotator_reliability(empty).count() == 0 and consensus.agreement(empty).count() == 0
