from voxgraph.llm import sentences

TEMPLATES = [
    "The bridge near {} was opened before the council assembled.", "Mr. {} and Dr. {} closed the road.", "Will the tram save {}, or is it lost?", "They wrote \"The road is shut. Go home.\" on the wall of {}.", "It costs approx. 40.5 crowns, i.e. less than {} paid.",
    "“Leave it alone!” was all {} said.", "Ask the mill of {}: has it been shut since 1986?",
]
NAMES = "Rudaqorf Velisingen Mosarez Tanibor Ludovac Peremaard Zelimov Coradine".split()


def texts():
    out = []
    for i in range(240):
        parts = [TEMPLATES[(i + k * 3) % len(TEMPLATES)].format(NAMES[(i + k) % 8], NAMES[(i * 5 + k) % 8]) for k in range(1 + i % 4)]
        out.append(" ".join(parts))
    return out


def true_starts(parts, gap=" "):
    at, out = 0, []
    for p in parts:
        out.append(at)
        at += len(p) + len(gap)
    return out


MODEL = sentences.Segmenter().fit(sorted(set(texts())), ["mr", "dr"])


def test_held_out_texts_in_any_case():
    right = total = 0
    for i in range(60):
        parts = [TEMPLATES[(i * 3 + k * 2 + 1) % len(TEMPLATES)].format(NAMES[(i * 3 + k) % 8], NAMES[(i + k * 5) % 8]) for k in range(3)]
        for change in (str, str.lower, str.upper):
            total += 1
            right += MODEL.starts(change(" ".join(parts))) == true_starts(parts)
    assert right / total > 0.95


def test_scripts_and_edges():
    assert MODEL.starts("") == [] and MODEL.starts(" \n ") == []
    assert MODEL.starts("  “Wait”, he said") == [2]
    assert MODEL.starts("桥已经建成。港口关闭了。") == [0, 6]
    assert MODEL.starts("他喊道“停下！渡船已经租赁。”然后离开了。") == [0]
    assert len(MODEL.starts("The road is shut. " * 2000)) == 2000


def test_unmarked_script():
    words = ["ภาษี", "ตลาด", "ถนน", "ศาล", "โรงเรียน"]
    lines = [f"ทำไม{words[i % 5]}จึงไม่เปิด{words[(i * 3 + 1) % 5]} ทำไม{words[(i + 2) % 5]}จึงไม่เปิด{words[i * 2 % 5]}" for i in range(60)]
    m = sentences.Segmenter().fit(lines)
    assert m.starts(lines[0])[1] == lines[0].index(" ") + 1
    joined = lines[7].replace(" ", "")
    assert m.starts(joined) == [0, lines[7].index(" ")]


def test_rows(spark):
    df = spark.createDataFrame([("a", "One is here. Two is there.", 1), ("a", "One is here. Two is there.", 1), ("b", None, 1), ("c", "  ", 1), (None, "x", 1)], "quote_id string, text string, sent_start int")
    got = sorted((r.quote_id, r.sent_start) for r in sentences.sentence_starts(df, "quote_id", "text", MODEL).collect())
    assert [g[0] for g in got] == ["a"] * len(got) and got[0] == ("a", 0)
    assert sentences.sentence_starts(df.limit(0), "quote_id", "text", MODEL).count() == 0
    assert sentences.train(df.limit(0), "text").starts("Anything") == [0]


def test_chain_forbids_neighbours():
    assert sentences.viterbi([0, 2.0, 1.0, 3.0]) == [1, 3] and sentences.viterbi([1.0, 2.0], [4, 9]) == [0, 1] and sentences.viterbi([1.0, 2.0], [4, 5]) == [1]


def test_learned_transitions_decide():
    assert sentences.best_path([0.5, -0.5], [[0.0, -1.0], [0.0, 0.0]]) == [] and sentences.best_path([0.5, -0.5], [[0.0, 0.0], [0.0, 1.0]]) == [0, 1]
    assert sentences.best_path([], []) == [] and MODEL.chain.shape == (2, 7) and abs(MODEL.chain).sum() > 0
    assert sentences.apart("One two. Three", [9]) == [2]
