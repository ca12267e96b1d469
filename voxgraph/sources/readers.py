"""Readers and writers of the corpus's file formats. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """A Parquet or JSON table; JSON (also .gz) needs a schema. Nested folders and names that begin with _ or . are handled by Spark."""
    reader = spark.read.option("recursiveFileLookup", "true") if fmt == "parquet" else spark.read
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "zstd", by: Sequence[str] = ()) -> None:
    """Parquet, partitioned by the named columns."""
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_to_parquet(spark: SparkSession, source: str, target: str, schema: StructType | str) -> None:
    write_table(read_table(spark, source, schema, "json"), target, "overwrite")


def write_sample(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small sample as CSV with header, or as Parquet."""
    (df.write.mode("overwrite").option("header", "true").csv(path)) if fmt == "csv" else write_table(df, path, "overwrite")


def knowledge_base_lines(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(instance) of a dump with one JSON object per line: brackets, commas and blank lines dropped, trailing commas stripped.

    A .gz file is one split; parts spreads its lines afterwards.
    """
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",+$", "").alias("instance")).where(~F.col("instance").isin("", "[", "]"))
    return lines.repartition(parts) if parts else lines


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(qid, aliases) of lines of item, label and |-joined aliases, parted by tabs; lines without item are left out."""
    from ..functions.nested import label_line

    return spark.read.text(path).select(label_line(F.col("value")).alias("x")).select("x.*").where("coalesce(qid, '') <> ''")


def redirect_results(spark: SparkSession, path: str) -> DataFrame:
    """(redirect, target) of a SPARQL result in XML; items are named by the last part of their address."""
    shape = "binding array<struct<_name string, uri string>>"
    rows = spark.read.format("xml").option("rowTag", "result").schema(shape).load(path)
    value = lambda name: F.get(F.transform(F.filter("binding", lambda b: b["_name"] == name), lambda b: F.substring_index(b["uri"], "/", -1)), 0)
    return rows.select(value("redirect").alias("redirect"), value("target").alias("target")).where("redirect is not null and target is not null")


def tagged_records(spark: SparkSession, path: str) -> DataFrame:
    """(fields) of records parted by blank lines: a map of one-letter tags to values, the last of equal tags; lines without tab are dropped."""
    return spark.read.option("lineSep", "\n\n").text(path).select(tag_map(F.col("value")).alias("fields")).where("cardinality(fields) > 0")


def tag_map(record: Column) -> Column:
    pairs = F.filter(F.transform(F.split(record, "\n"), lambda line: F.struct(F.substring_index(line, "\t", 1).alias("k"), F.regexp_extract(line, r"(?s)^[^\t]*\t(.*)$", 1).alias("v"))), lambda p: p["k"].rlike("^[A-Za-z]$"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda o: o["k"] == p["k"]))
    return F.map_from_entries(last)


def framed_records(spark: SparkSession, path: str, decompress=None, largest: int = 20 << 20) -> DataFrame:
    """(value) of each record in files of length-framed Snappy blocks (four bytes, big end first).

    A length of zero, below or above `largest`, or a truncated block, ends the file; the partial record at the end is
    dropped. decompress: bytes to bytes; raw Snappy of pyarrow by default. Files are read whole by one task each.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def unpack(block: bytes) -> bytes:
            if decompress is not None:
                return decompress(block)
            size, shift, at = 0, 0, 0
            while True:
                size |= (block[at] & 127) << shift
                shift += 7
                at += 1
                if block[at - 1] < 128:
                    break
            return pa.decompress(block, decompressed_size=size, codec="snappy", asbytes=True)

        for batch in batches:
            records: list[str] = []
            for data in batch.column(0).to_pylist():
                out, at = [], 0
                while at + 4 <= len(data):
                    (n,) = struct.unpack(">i", data[at : at + 4])
                    if n <= 0 or n > largest or at + 4 + n > len(data):
                        break
                    out.append(unpack(data[at + 4 : at + 4 + n]))
                    at += 4 + n
                records += b"".join(out).decode("utf-8", "replace").split("\n\n")[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def dump_articles(records: DataFrame, fields: str = "fields") -> DataFrame:
    """(article_id, url, date, title, content, phase) of tagged records that can be used.

    Needed: an id, a phase, a web address, 400 characters with a quotation mark, a host that isn't blocked.
    """
    from ..functions.text import phase_of_date
    from ..functions.urls import is_blocked

    f = lambda k: F.try_element_at(F.col(fields), F.lit(k))
    rows = records.select(f("I").alias("article_id"), f("U").alias("url"), F.left(f("D"), F.lit(10)).alias("date"), f("T").alias("title"), f("C").alias("content"))
    rows = rows.withColumn("phase", phase_of_date(F.col("date")))
    good = (F.coalesce("article_id", F.lit("")) != "") & F.col("phase").isNotNull() & F.col("url").startswith("http") & (F.length("content") >= 400) & F.col("content").rlike("[\"“”«»]|``|''")
    return rows.where(good & ~is_blocked(F.col("url")))


def labelled_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(paragraph, pos, word, tag) of lines "word TAG", blank lines between paragraphs; paragraph is the paragraph's hash."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''").select(F.xxhash64("value").alias("paragraph"), F.posexplode(F.filter(F.split(F.trim("value", F.lit("\n")), "\n"), lambda line: F.trim(line) != "")).alias("pos", "line"))
    return blocks.select("paragraph", "pos", F.regexp_extract("line", r"^(.*) \S+$", 1).alias("word"), F.regexp_extract("line", r"(\S+)$", 1).alias("tag"))


def open_parquet(path: str):
    """A Parquet file on any file system that Arrow knows by its address."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    uri = "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path
    system, place = pyarrow.fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(system.open_input_file(place))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_group, n_rows) of every Parquet file below a folder, from the files' footers, read by tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                meta = open_parquet(p).metadata
                rows += [(p, i, meta.row_group(i).num_rows) for i in range(meta.num_row_groups)]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["path", "row_group", "n_rows"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(run, "path string, row_group int, n_rows long")


def read_slices(manifest: DataFrame, schema: StructType) -> DataFrame:
    """The rows of a manifest's row groups (path, row_group), only the schema's columns, each row group read by one task.

    One chunk's rows: read_slices(manifest.where("chunk_id = 3"), schema).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in schema.fields]

    def run(batches: Iterator) -> Iterator:
        wanted = to_arrow_schema(schema)
        for batch in batches:
            for path, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = open_parquet(path).read_row_group(group, columns=names).select(names)
                yield from found.cast(wanted).to_batches(max_chunksize=10_000)

    return manifest.select("path", "row_group").repartition("path", "row_group").mapInArrow(run, schema)


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """(chunk_id, files, row_groups, n_rows, first_row) of each chunk of a manifest."""
    return manifest.groupBy("chunk_id").agg(F.countDistinct("path").alias("files"), F.count("*").alias("row_groups"), F.sum("n_rows").alias("n_rows"), F.min("first_row").alias("first_row"))


def word_list(spark: SparkSession, path: str, fallback: Sequence[str] = ("president", "manager"), most: int = 100_000) -> list[str]:
    """Lower-case words of a file with one a line, without blank lines and those that begin with #; the fallback if there is no file."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> '' and not startswith(value, '#')")
        found = rows.select("w").distinct().limit(most + 1).collect()
    except AnalysisException:
        return sorted(fallback)
    if len(found) > most:
        raise ValueError(f"a word list of over {most} words")
    return sorted(r.w for r in found)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, html) of files <id>.html.gz below a folder."""

    def unzip(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        for batch in batches:
            texts = [gzip.decompress(b).decode("utf-8", "replace") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["article_id", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html.gz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.html\.gz$", 1).alias("article_id"), "content").mapInArrow(unzip, "article_id string, html string")


def write_annotations(records: DataFrame, path: str) -> None:
    """Annotation records as JSON, one folder per annotator with a name that is safe in paths."""
    safe = F.regexp_replace(F.coalesce("annotator", F.lit("default")), r"[^A-Za-z0-9_.-]", "_")
    records.withColumn("annotator_key", safe).write.mode("append").partitionBy("annotator_key").json(path)


def read_annotations(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def article_batch(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, text, url, phase, title, text_hash) of article batches in JSON lines; the text from the first key that isn't blank."""
    from ..functions.nested import first_nonblank

    schema = "article_id string, articleID string, id string, url string, phase string, title string, text string, detokenized_content string, content string, body string"
    a = spark.read.schema(schema).json(path)
    text = first_nonblank(*(F.col(c) for c in ("text", "detokenized_content", "content", "body")))
    key = first_nonblank(*(F.col(c) for c in ("article_id", "articleID", "id")))
    return a.select(key.alias("article_id"), text.alias("text"), "url", "phase", "title", F.sha2(text, 256).alias("text_hash"))


def is_html(content_type: Column, body: Column) -> Column:
    """Whether the type says html or xml, or the first 400 characters hold <html, <!doctype or <p."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.rlike("html|xml") | F.lower(F.left(F.coalesce(body, F.lit("")), F.lit(400))).rlike("<html|<!doctype|<p")


def html_text(html: Column) -> Column:
    """Text of HTML without scripts, styles, comments and tags, blanks collapsed; block ends become line ends. Approximate: no parser."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</(p|div|li|h[1-6]|blockquote|tr)>|<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def ptb_tokens(text: Column) -> Column:
    """Word, number and punctuation tokens; double quotes as `` and ''. Approximate: regular expressions, not the treebank's tokeniser."""
    x = F.regexp_replace(F.regexp_replace(text, r'(^|[\s(\[“])"', "$1`` "), '"', " ''")
    x = F.replace(F.replace(x, F.lit("“"), F.lit("`` ")), F.lit("”"), F.lit(" ''"))
    return F.regexp_extract_all(x, F.lit(r"``|''|(?U)n't\b|'(?:s|re|ve|ll|d|m)\b|\w+(?:[.,]\d+)*(?=n't\b)|\w+(?:[-.,]\w+)*|[^\w\s]"), F.lit(0))
