import random

from voxgraph.llm import paragraphs


def corpus(seed):
    order = random.Random(seed)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ara", "elo", "ini", "oma", "uta")]
    make = lambda n: [order.choice(words) for _ in range(n)]
    docs = []
    for i in range(40):
        lines = [" ".join(make(order.randint(30, 90))) for _ in range(3)]
        docs.append(lines)
    for i in range(20):
        line = order.choice(docs[i]).split()
        for _ in range(order.randint(0, 1)):
            line[order.randrange(len(line))] = order.choice(words)
        docs[order.randrange(20, 40)].append(" ".join(line))
    return [(i, order.choice(["\n", "\r\n", "\r"]).join(x)) for i, x in enumerate(docs)]


def test_banding_finds_what_exact_comparison_finds(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows + [(90, None), (91, ""), (None, rows[0][1])], "doc long, text string")
    flat = [(i, p) for i, t in rows for p in t.replace("\r\n", "\n").replace("\r", "\n").split("\n") if len(p) >= 200]
    sets = [set(paragraphs.shingles(p).tolist()) for _, p in flat]
    near = {frozenset((flat[i][1], flat[j][1])) for i in range(len(flat)) for j in range(i) if flat[i][1] != flat[j][1] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    at = paragraphs.paragraphs(df, "doc", "text")
    texts = {bytes(r.content): r.paragraph for r in at.collect()}
    got = {frozenset((texts[bytes(r.lo)], texts[bytes(r.hi)])) for r in paragraphs.near_contents(at).collect()}
    assert got <= near and len(got) >= 0.95 * len(near) and len(near) > 3
    assert sorted(texts.values()) == sorted({p for _, p in flat})


def test_clusters_keep_one_occurrence(spark):
    rows = corpus(3)
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    out = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc long, text string"), "doc", "text").collect()
    by = {}
    for r in out:
        by.setdefault(r.cluster, []).append(r)
        line = dict(rows)[r.doc].replace("\r\n", "\n").replace("\r", "\n")
        assert "\n" not in line[r.start : r.start + r.n_chars] and (r.start == 0 or line[r.start - 1] == "\n")
    assert by and all(len(v) > 1 and sum(x.keep for x in v) == 1 and min((x.doc, x.start) for x in v) == next((x.doc, x.start) for x in v if x.keep) for v in by.values())
    assert paragraphs.repeated_paragraphs(spark.createDataFrame([], "doc long, text string"), "doc", "text").count() == 0


def test_tuned_bands():
    bands, width = paragraphs.tuned(0.8, 0.99)
    assert 1 - (1 - 0.8**width) ** bands >= 0.99 and bands * width <= 256
