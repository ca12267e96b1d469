import random

from voxgraph.llm import spans


def corpus(seed):
    order = random.Random(seed)
    letters = "abcdefghijklmnop qrstuvwxyzäöü日本語🙂"
    make = lambda n: "".join(order.choice(letters) for _ in range(n))
    passages = [make(n) for n in (199, 200, 201, 350, 700)]
    docs = [make(order.randint(0, 300)) + (order.choice(passages) if order.random() < 0.7 else "") + make(order.randint(0, 300)) for _ in range(60)]
    return [(i, t) for i, t in enumerate(docs + ["aaaa" * 100, "baaaa" + "aaaa" * 90, "", "x"])] + [(900, None)]


def brute(rows, n=200):
    seen = {}
    for i, t in rows:
        for p in range(len(t or "") - n + 1):
            seen.setdefault(t[p : p + n], set()).add(i)
    pairs, covered = set(), {}
    for i, t in rows:
        marks = bytearray(len(t or ""))
        for p in range(len(t or "") - n + 1):
            if len(seen[t[p : p + n]]) > 1:
                marks[p : p + n] = b"\1" * n
        covered[i] = sum(marks)
    for ids in seen.values():
        pairs |= {(a, b) for a in ids for b in ids if a < b}
    return pairs, covered


def test_pairs_and_coverage_are_exact(spark):
    rows = corpus(3)
    pairs, covered = brute(rows)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc long, text string, pos int")
    got = {(r.lo, r.hi) for r in spans.shared_runs(df, "doc", "text")[0].collect()}
    assert got == pairs and len(pairs) > 20
    shares = {r.doc: r.shared_chars for r in spans.shared_share(df, "doc", "text").collect()}
    assert shares == covered


def test_common_passages_by_windows(spark):
    rows = corpus(4)
    pairs, covered = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, _ = spans.shared_runs(df, "doc_id", "text", crowd=0)
    linked = {frozenset(p) for p in pairs}
    assert {frozenset((r.lo, r.hi)) for r in got.collect()} <= linked
    shares = {r.doc_id: r.shared_chars for r in spans.shared_share(df, "doc_id", "text", crowd=0).collect()}
    assert shares == covered


def test_removals_and_empty(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = spans.removal_clusters(df, "doc_id", "text").collect()
    assert {r.cluster for r in out} == {r.doc_id for r in out if r.keep}
    assert spans.shared_share(df.limit(0), "doc_id", "text").count() == 0
    nulls = {r.doc_id: (r.n_chars, r.shared_chars, r.shared_share) for r in spans.shared_share(df, "doc_id", "text").collect()}
    assert nulls[900] == (None, 0, 0.0)


def test_all_pairs_of_common_passages(spark):
    rows = corpus(6)
    pairs, _ = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (0, 5):
        got = [(r.lo, r.hi) for r in spans.shared_runs(df, "doc_id", "text", crowd=crowd)[0].collect()]
        assert len(got) == len(set(got)) and set(got) == pairs, crowd
    clusters = lambda crowd: {tuple(r) for r in spans.removal_clusters(df, "doc_id", "text", crowd=crowd).collect()}
    assert clusters(0) == clusters(1000)
