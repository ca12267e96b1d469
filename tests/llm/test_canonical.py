from pyspark.sql import functions as F

from voxgraph.llm import canonical, pairing

ROWS = [
    ("a", "The  Bridge, is open!"), ("b", "the bridge is OPEN"), ("b", "the bridge is OPEN"), ("c", "another one"), ("d", None), ("e", " ... "), (None, "the bridge is open"),
    ("f", "PLACE: Rome; EDITION: 4\nThe text."), ("g", "Edition: 4; place: ROME;\n\nThe text"), ("h", "PLACE: Rome; EDITION: 5\nThe text."), ("i", "PLACE Rome EDITION 4 The text"),
]


def frame(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ROWS], "id string, text string, form int")


def test_copies_are_counted(spark):
    rows = {r.record: (r.copies, r.ids, r.collided) for r in canonical.collapse(frame(spark), "id", "text").collect()}
    assert rows["a"] == (3, 2, False) and rows["c"] == (1, 1, False) and "d" not in rows and "e" not in rows


def test_order_of_fields_is_free(spark):
    rows = {r.record: r.ids for r in canonical.collapse(frame(spark), "id", "text", fields=True).collect()}
    assert rows["f"] == 2 and rows["h"] == 1


def test_pairs_of_either_form(spark):
    keys = canonical.content_keys(frame(spark), "text", "id", fields=True)
    pairs = {(r.lo, r.hi) for r in pairing.class_pairs(keys, ["h128", "check"], "id").collect()}
    assert pairs == {("a", "b"), ("f", "g"), ("f", "i")}


def test_class_of_1500_copies_gives_all_pairs_and_members(spark):
    df = spark.range(1500).selectExpr("format_string('%04d', id) as id", "'same text' as text").unionByName(frame(spark).select("id", "text"))
    keys = canonical.content_keys(df, "text", "id")
    pairs = pairing.class_pairs(keys, ["h128", "check"], "id")
    assert pairs.count() == pairs.distinct().count() == 1500 * 1499 // 2 + 2 and pairs.where("lo >= hi").count() == 0
    assert pairing.class_pairs(keys, ["h128", "check"], "id", 100).exceptAll(pairs).count() == 0
    members = {r.id: (r.record, r.ids) for r in canonical.copy_classes(df, "id", "text").collect()}
    assert members["1499"] == ("0000", 1500) and members["b"] == ("a", 2) and members["c"] == ("c", 1) and "d" not in members


def test_expanded_pairs_of_classes(spark):
    members = spark.createDataFrame([(k, f"{k}{i}") for k, n in (("a", 5), ("b", 40), ("c", 1)) for i in range(n)] + [("a", None)], "k string, id string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "z")], "x string, y string")
    got = {(r.lo, r.hi) for r in pairing.expand(pairs, members, F.col("x"), F.col("y"), "k", "id", 7).collect()}
    assert got == {(f"a{i}", f"b{j}") for i in range(5) for j in range(40)} | {(f"b{j}", "c0") for j in range(40)}


def test_empty(spark):
    assert canonical.collapse(frame(spark).limit(0), "id", "text").count() == 0
