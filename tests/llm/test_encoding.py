from voxgraph.llm import encoding
from voxgraph.llm.encoding import read

CLEAN = ["Le café fermé de São Paulo", "Die Straße für größere Brücken", "“Stop” – said O’Neil", "Почему был построен мост в городе и как это было", "él pagó 40 €", "señor naïve façade née", "为什么没有桥梁。"] * 4


def garble(text, chain):
    for written, seen in chain:
        text = read(text.encode(written), seen)
    return text


CASES = [
    (garble("Le café fermé", [("utf-8", "latin-1")]), "Le café fermé"), (garble("größere Brücken", [("utf-8", "cp1252")]), "größere Brücken"), (garble("café fermé", [("utf-8", "cp1252"), ("utf-8", "cp1252")]), "café fermé"),
    (garble("São Paulo", [("utf-8", "mac_roman")]), "São Paulo"), (garble("fermé", [("utf-8", "cp437")]), "fermé"), (garble("café fermé", [("utf-8", "cp1252")]).lower(), "café fermé"), (garble("Почему был построен мост", [("koi8-r", "cp1251")]), "Почему был построен мост"),
    (garble("Почему был построен мост", [("cp1251", "cp1252")]), "Почему был построен мост"), (garble("Почему был", [("utf-8", "cp1251")]), "Почему был"), ("Die gr?ßere Stra?e", "Die größere straße"), ("the se?or", "the señor"), ("lost S�O here", None),
]


def frames(spark):
    rows = [("g", f"g{i}", t) for i, (t, _) in enumerate(CASES)] + [("c", f"c{i}", t) for i, t in enumerate(CLEAN)] + [("c", "x", None), ("c", "y", ""), ("c", "z", "Is it? Yes. what?The next"), ("c", "w", "IRMÃ» AMANHÃ…"), (None, "v", CASES[0][0])]
    return spark.createDataFrame([(*r, 1) for r in rows], "kind string, id string, text string, form int")


def test_found_and_restored(spark):
    df = frames(spark)
    forms = encoding.forms(df.where("kind = 'c'"), "text")
    found = {(r.kind, r.id) for r in encoding.damaged(df, ["kind", "id"], "text", forms).collect()}
    assert found == {("g", f"g{i}") for i in range(len(CASES))}
    back = {r.id: r.restored for r in encoding.restore(df, ["kind", "id"], "text", forms).collect()}
    for i, (_, original) in enumerate(CASES):
        if original is not None:
            assert back[f"g{i}"].lower() == original.lower(), (i, back[f"g{i}"])


def test_empty(spark):
    df = frames(spark).limit(0)
    forms = encoding.forms(df, "text")
    assert forms.count() == 0 and encoding.damaged(df, ["kind", "id"], "text", forms).count() == 0
    assert encoding.damaged(frames(spark).where("kind = 'c'"), ["kind", "id"], "text", forms).count() == 0


def test_partial_damage_by_words(spark):
    line = "Почему был построен мост в городе и как это было"
    hurt = {
        "koi": garble(line, [("koi8-r", "cp1251")]), "latin": garble(line, [("cp1251", "cp1252")]), "one": "Почему был " + garble("построен", [("koi8-r", "cp1251")]) + " мост",
    }
    texts = {k: t if k == "one" else "\n".join([other, t, other.upper()]) for other in ["Иван видел новую реку около старого завода, когда шёл домой с работы вечером"] for k, t in hurt.items()}
    rows = [("g", k, t) for k, t in texts.items()] + [("c", f"c{i}", t) for i, t in enumerate([*CLEAN, line.upper(), "ХОТЯ ЧТО", "хотя что"] * 4)]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    forms = encoding.forms(df.where("kind = 'c'"), "text")
    assert {r.id for r in encoding.damaged(df, ["kind", "id"], "text", forms).collect()} == set(texts)
    back = {r.id: r.restored for r in encoding.restore(df, ["kind", "id"], "text", forms).collect()}
    assert back["koi"] == texts["koi"].replace(hurt["koi"], line) and back["latin"] == texts["latin"].replace(hurt["latin"], line) and back["one"] == "Почему был построен мост"
    assert forms.where("form = original and chain <> 'clean'").count() == 0


def test_one_weak_word_is_found_by_the_whole_word(spark):
    rows = [("g", "v", "the " + garble("fermé", [("utf-8", "cp1251")]) + " door")]
    df = spark.createDataFrame(rows + [("c", f"c{i}", t) for i, t in enumerate(CLEAN)], "kind string, id string, text string")
    forms = encoding.forms(df.where("kind = 'c'"), "text")
    assert {r.id for r in encoding.damaged(df, ["kind", "id"], "text", forms).collect()} == {"v"}
    back = {r.id: r for r in encoding.restore(df, ["kind", "id"], "text", forms).collect()}
    assert back["v"].restored == "the fermé door" and (back["v"].made_words, back["v"].verified_words) == (1, 1)
