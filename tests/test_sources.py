import gzip
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from voxgraph.operators import analytics
from voxgraph.sources import readers
from voxgraph.streaming import quotes as streaming


def test_knowledge_base_and_labels(spark, tmp_path):
    with gzip.open(tmp_path / "kb.json.gz", "wt") as f:
        f.write('[\n{"id":"Q1"},\n\n{"id":"Q2"}\n]\n')
    assert sorted(r.instance for r in readers.knowledge_base_lines(spark, str(tmp_path / "kb.json.gz"), 2).collect()) == ['{"id":"Q1"}', '{"id":"Q2"}']
    (tmp_path / "l.tsv").write_text("Q1\tLabel\ta||b\nQ2\t\ta|\n\n")
    assert {r.qid: r.aliases for r in readers.label_lines(spark, str(tmp_path / "l.tsv")).collect()} == {"Q1": ["Label", "a", "b"], "Q2": ["a", ""]}


def test_redirects(spark, tmp_path):
    result = '<result><binding name="redirect"><uri>http://x/Q1</uri></binding><binding name="target"><uri>http://x/Q2</uri></binding></result><result><binding name="redirect"><uri>http://x/Q3</uri></binding></result>'
    (tmp_path / "r.xml").write_text(f"<sparql><results>{result}</results></sparql>")
    assert [tuple(r) for r in readers.redirect_results(spark, str(tmp_path / "r.xml")).collect()] == [("Q1", "Q2")]


def test_tagged_framed_and_dump(spark, tmp_path):
    long = "“word” " * 80
    record = lambda i, d="2009-01-05": f"I\t{i}\nV\t1\nU\thttp://a.example/x\nD\t{d} 10:00\nT\told\nT\tnew\nC\t{long}"
    text = "\n\n".join([record("1"), record("2", "1999-01-01"), record("3") + "\nnonsense", "partial"])
    data = text.encode()
    raw = lambda b: bytes(pa.compress(b, codec="snappy", asbytes=True))
    blocks = [raw(data[:300]), raw(data[300:])]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "shard.snappy").write_bytes(b"".join(struct.pack(">i", len(b)) + b for b in blocks) + struct.pack(">i", 0) + b"rest")
    values = readers.framed_records(spark, str(tmp_path / "d"))
    assert values.count() == 3
    fields = values.select(readers.tag_map(F.col("value")).alias("fields"))
    assert {r.article_id: (r.title, r.phase) for r in readers.dump_articles(fields).collect()} == {"1": ("new", "A"), "3": ("new", "A")}
    (tmp_path / "t.txt").write_text(text)
    assert readers.tagged_records(spark, str(tmp_path / "t.txt")).count() == 3


def test_labelled_tokens(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Ann B-Speaker\nLee I-Speaker\n\nsaid O\n")
    got = readers.labelled_tokens(spark, str(tmp_path / "c.txt"))
    assert sorted((r.pos, r.word, r.tag) for r in got.collect()) == [(0, "Ann", "B-Speaker"), (0, "said", "O"), (1, "Lee", "I-Speaker")]


def test_tables_and_chunks(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("k"))
    readers.write_table(df.coalesce(2), str(tmp_path / "p"), by=["k"])
    assert readers.read_table(spark, str(tmp_path / "p")).count() == 100
    groups = readers.row_groups(spark, str(tmp_path / "p"))
    assert groups.agg(F.sum("n_rows")).first()[0] == 100 and analytics.row_group_chunks(groups, 2).select("chunk_id").distinct().count() == 2
    (tmp_path / "j.json").write_text('{"id": 1, "x": "a"}\n{"id": 2}\n')
    readers.json_to_parquet(spark, str(tmp_path / "j.json"), str(tmp_path / "q"), "id int, x string")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "q")).collect())) == [(1, "a"), (2, None)]
    readers.write_sample(df, str(tmp_path / "s"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "s")).count() == 100


def test_documents(spark, tmp_path):
    (tmp_path / "h" / "2009").mkdir(parents=True)
    (tmp_path / "h" / "2009" / "2009-x.html.gz").write_bytes(gzip.compress(b"<html><script>x()</script><p>A &amp; B</p><p>it's  5.3</p></html>"))
    row = readers.html_files(spark, str(tmp_path / "h")).select("article_id", readers.html_text(F.col("html")).alias("t"), readers.ptb_tokens(readers.html_text(F.col("html"))).alias("k"), readers.is_html(F.lit(None).cast("string"), F.col("html")).alias("h")).first()
    assert (row.article_id, row.t, row.h) == ("2009-x", "A & B\nit's 5.3", True) and row.k == ["A", "&", "B", "it", "'s", "5.3"]
    (tmp_path / "b.jsonl").write_text('{"id": "a", "text": " ", "content": "body text"}\n')
    batch = readers.article_batch(spark, str(tmp_path / "b.jsonl")).first()
    assert (batch.article_id, batch.text) == ("a", "body text")
    records = spark.createDataFrame([("a/b", "x")], "annotator string, article_id string")
    readers.write_annotations(records, str(tmp_path / "ann"))
    assert readers.read_annotations(spark, str(tmp_path / "ann"), "annotator string, article_id string").first().article_id == "x"


def test_streams(spark, tmp_path):
    rows = [("2020-01-01 01:00:00", "q1", "a"), ("2020-01-01 02:00:00", "q1", "b"), ("2020-01-01 03:00:00", "q1", "b"), ("2020-01-20 00:00:00", "q2", "a")]
    df = spark.createDataFrame(rows, "t string, q string, d string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, s, mode in (("outlets", streaming.outlets_over_time(stream, "t", "q", "d"), "complete"), ("fresh", streaming.new_quotations(stream, "t", "q"), "append")):
        query = s.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert sorted((r.q, r.n_outlets) for r in spark.table("outlets").collect()) == [("q1", 2), ("q2", 1)]
    assert sorted(r.q for r in spark.table("fresh").collect()) == ["q1", "q2"]
