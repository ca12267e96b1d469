"""Near-equal paragraphs of different documents by MinHash banding, exact Jaccard similarity and components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.lineage import cut
from .pairing import class_pairs

#: Words of a shingle; a character of a script without blanks counts as a word.
SHINGLE = 5
_WORDS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*|[\p{L}\p{N}\p{M}]+")
_LINES = r"\r\n|\n|\r"


@lru_cache
def tuned(similarity: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows) with the fewest candidates that still find a pair of the given similarity with probability recall.

    Of all bandings of at most `most` hashes that reach the recall, the one with the most rows a band: each row more
    thins out the pairs below the similarity.
    """
    fit = [(rows, int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))) for rows in range(1, 33)]
    rows, bands = max((r, b) for r, b in fit if r * b <= most)
    return bands, rows


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of SHINGLE words, in lower case; of all words if there are fewer."""
    words = _WORDS.findall(text.lower())
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.array([xxhash.xxh3_64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(n)], np.uint64))


def signature(hashes: np.ndarray, count: int) -> np.ndarray:
    """Least values of `count` multiplicative permutations of the hashes."""
    odd = np.random.default_rng(11).integers(1 << 62, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (hashes[:, None] ^ (hashes[:, None] >> np.uint64(29))) * odd[None, :]
    return (mixed ^ (mixed >> np.uint64(32))).min(0)


def _banded(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            keys = [[xxhash.xxh3_64_intdigest(bytes([b]) + s[b * rows : (b + 1) * rows].tobytes()) for b in range(bands)] for s in (signature(h, bands * rows) for h in found)]
            to = lambda lists: pa.array([np.array(x, np.uint64).view(np.int64) for x in lists], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), to(found), to(keys)], ["content", "shingles", "bands"])

    return run


def paragraphs(df: DataFrame, id_col: str, text: str, min_len: int = 200) -> DataFrame:
    """Rows (doc, start, content, paragraph) of the paragraphs (lines) of at least min_len characters.

    start is the offset of the paragraph in the text with line ends counted as one character; content is a 128-bit hash.
    """
    rows = df.where(F.col(id_col).isNotNull() & (F.length(text) >= min_len)).select(F.col(id_col).alias("doc"), F.split(text, _LINES).alias("p"))
    starts = F.expr("aggregate(p, array(0), (s, x) -> concat(s, array(element_at(s, -1) + length(x) + 1)))")
    rows = rows.select("doc", F.explode(F.arrays_zip("p", starts.alias("s"))).alias("x")).select("doc", F.col("x.s").alias("start"), F.col("x.p").alias("paragraph"))
    return rows.where(F.length("paragraph") >= min_len).select("doc", "start", F.unhex(F.md5("paragraph")).alias("content"), "paragraph")


def near_contents(rows: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """Pairs (lo, hi) of different contents whose shingles have a Jaccard similarity of at least `similarity`.

    Equal paragraphs count once, so one in a third of all documents is one row. Each distinct content has one key per
    band; contents that collide are paired in blocks and verified by the shingles themselves.
    """
    bands, width = tuned(similarity, recall)
    distinct = rows.groupBy("content").agg(F.first("paragraph").alias("paragraph"))
    banded = cut(distinct.mapInArrow(_banded(bands, width), "content binary, shingles array<bigint>, bands array<bigint>"))
    keys = banded.select("content", F.explode("bands").alias("band"))
    met = class_pairs(keys, ["band"], "content").distinct()
    side = lambda s: banded.select(F.col("content").alias(s), F.col("shingles").alias(f"{s}_shingles"))
    both = met.join(side("lo"), "lo").join(side("hi"), "hi").withColumn("common", F.size(F.array_intersect("lo_shingles", "hi_shingles")))
    return both.where(F.col("common") >= similarity * (F.size("lo_shingles") + F.size("hi_shingles") - F.col("common"))).select("lo", "hi")


def repeated_paragraphs(df: DataFrame, id_col: str, text: str, min_len: int = 200, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row (id, start, n_chars, cluster, keep) per paragraph that occurs, nearly the same, in two places or more.

    cluster is the least content hash of the component, in hexadecimal digits; keep marks the one occurrence, of the
    least id and offset, that a removal of repeats would leave. Paragraphs under min_len characters, null texts and ids
    have no row.
    """
    rows = paragraphs(df, id_col, text, min_len)
    parts = connected_components(near_contents(rows, similarity, recall), "lo", "hi").withColumnRenamed("node", "content")
    placed = rows.select("doc", "start", "content", F.length("paragraph").alias("n_chars")).join(parts, "content", "left").withColumn("cluster", F.coalesce("component", "content"))
    placed = cut(placed.drop("component", "content"))
    first = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("first")).where("n > 1")
    out = placed.join(first, "cluster")
    return out.select(F.col("doc").alias(id_col), "start", "n_chars", F.lower(F.hex("cluster")).alias("cluster"), (F.struct("doc", "start") == F.col("first")).alias("keep"))
