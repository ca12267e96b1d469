"""Long exact spans shared between documents.

Every window of min_len characters counts as a paragraph. Its MinHash, over shingles of `shingle` characters, is one
band of one row: equal windows have the same MinHash, so banding finds each of them, and a document keeps only the
distinct (position, hash) of its minima, about one per (min_len - shingle) / 2 characters. Colliding minima are
verified by the characters around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.lineage import cut, drop
from .pairing import class_pairs, expand

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def _shingles(points: np.ndarray, width: int, powers: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Mixed 64-bit polynomial hashes of all runs of width code points."""
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=sums[1:])
    x = (sums[width:] - sums[:-width]) * back[: len(points) - width + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least value in each window of width values (the last of equal ones), each position once."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    shaped = padded.reshape(blocks, width)
    head = np.minimum.accumulate(shaped, axis=1).ravel()
    tail = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[: len(x) - width + 1], head[width - 1 : len(x)])
    hits = np.zeros(len(x), bool)
    by_value = np.argsort(x, kind="stable")
    values, windows = x[by_value], np.arange(len(least))
    # the last position at or before the window's end that has its least value
    at = np.searchsorted(values, least, side="left")
    single = (at + 1 >= len(values)) | (values[np.minimum(at + 1, len(values) - 1)] != least)
    hits[by_value[at[single]]] = True
    for w in windows[~single]:  # equal shingles: rare
        hits[w + width - 1 - int(np.argmax(x[w : w + width][::-1] == least[w]))] = True
    return np.flatnonzero(hits)


def _anchors(min_len: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = back = np.zeros(0, np.uint64)
        for batch in batches:
            rows, places, keys = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is None or len(text) < min_len:
                    continue
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                if len(points) > len(powers):
                    size = max(4096, 2 * len(points))
                    powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE)])
                    back = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BACK)])
                x = _shingles(points, shingle, powers, back)
                at = _minima(x, min_len - shingle + 1)
                rows.append(np.full(len(at), row))
                places.append(at)
                keys.append(x[at])
            if rows:
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64))], ["doc", "pos", "key"])

    return run


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _contexts(min_len: int, shingle: int):
    """For each anchor of a document what stands around it: up to min_len - shingle characters before, min_len from it on."""
    reach = min_len - shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, hits = (batch.column(batch.schema.get_field_index(n)) for n in ("doc", "text", "hits"))
            flat = hits.flatten()
            keys, places = flat.field(0), flat.field(1).to_pylist()
            rows = np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy()))
            left, right = [], []
            spans = zip(rows.tolist(), places)
            for row, group in groupby(spans, key=lambda x: x[0]):
                text = texts[row].as_py()
                for _, p in group:
                    left.append(text[max(0, p - reach) : p])
                    right.append(text[p : p + min_len])
            columns = [keys, docs.take(pa.array(rows)), pa.array(places, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "pos", "left", "right"])

    return run


def _verified(min_len: int, shingle: int):
    """Pairs of contexts of one anchor, with how many characters before and after it they have in common, if these are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))
            pairs = [zip(get(f"a_{n}").to_pylist(), get(f"b_{n}").to_pylist()) for n in ("left", "right")]
            left = np.array([_common(a[::-1], b[::-1]) for a, b in pairs[0]], np.int32)
            right = np.array([_common(a, b) for a, b in pairs[1]], np.int32)
            keep = (right >= shingle) & (left + right >= min_len)
            kept = [get(n).filter(pa.array(keep, pa.bool_())) for n in ("key", "a", "b")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(left[keep]), pa.array(right[keep])], ["key", "a", "b", "before", "after"])

    return run


def _windows(min_len: int, shingle: int):
    """For each hit, a hash of every window of min_len characters that holds the anchor, and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, hashes = [], [], []
            left, right, pos = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("left", "right", "pos"))
            for row, (a, b, p) in enumerate(zip(left, right, pos)):
                around = a + b
                for s in range(max(0, len(a) + shingle - min_len), min(len(a), len(around) - min_len) + 1):
                    rows.append(row)
                    starts.append(p - len(a) + s)
                    hashes.append(hash_window(around[s : s + min_len]))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(hashes, pa.binary())], ["doc", "start", "window"])

    return run


def hash_window(text: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


@dataclass(frozen=True)
class _Shared:
    """What documents share: sets of documents with one passage, pairs of such sets, windows of common anchors, and spans."""

    sets: DataFrame  # set, doc
    equal: DataFrame  # set: all its documents share a run
    pairs: DataFrame  # a, b: each document of set a shares a run with each of set b
    spans: DataFrame  # doc, start, end
    windows: DataFrame  # doc, start, window


def _shared(df: DataFrame, id_col: str, text: str, min_len: int, shingle: int | None, crowd: int) -> _Shared:
    shingle = shingle or max(1, min_len * 58 // 100)
    docs = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & (F.length(text) >= min_len)).select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    kind = docs.schema["doc"].dataType.simpleString()
    anchors = cut(docs.mapInArrow(_anchors(min_len, shingle), f"doc {kind}, pos int, key long"))
    keys = anchors.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key")
    hits = anchors.join(keys, "key").groupBy("doc").agg(F.collect_list(F.struct("key", "pos")).alias("hits"))
    around = docs.join(hits, "doc").mapInArrow(_contexts(min_len, shingle), f"key long, doc {kind}, pos int, left string, right string")
    # equal contexts of one anchor are one class, verified once
    side = cut(around.withColumn("cls", F.struct(F.xxhash64("left", "right").alias("u"), F.xxhash64(F.lit(1), "right", "left").alias("w"))))
    drop(anchors)
    classes = side.groupBy("key", "cls").agg(F.first("left").alias("left"), F.first("right").alias("right"))
    crowded = cut(classes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
    few, many = side.join(crowded, "key", "left_anti"), side.join(crowded, "key", "left_semi")

    members = few.select("key", "cls", "doc").distinct()
    sized = members.groupBy("key", "cls").agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("y")).alias("set"))
    kinds = classes.join(crowded, "key", "left_anti").join(sized, ["key", "cls"])
    kinds = cut(kinds)
    full = (F.length("left") + F.length("right") >= min_len) & (F.col("set.n") > 1)
    a, b = (kinds.select("key", F.struct("cls", "set").alias(s), F.col("left").alias(f"{s}_left"), F.col("right").alias(f"{s}_right")) for s in "ab")
    met = a.join(b, "key").where("a.cls < b.cls")
    side_type = kinds.select(F.struct("cls", "set").alias("a")).schema["a"].dataType.simpleString()
    runs = cut(met.mapInArrow(_verified(min_len, shingle), f"key long, a {side_type}, b {side_type}, before int, after int"))
    pairs = runs.select(F.col("a.set").alias("a"), F.col("b.set").alias("b")).distinct()
    equal = kinds.where(full).select("set").distinct()
    used = equal.unionByName(pairs.select(F.col("a").alias("set"))).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    one = kinds.groupBy("set").agg(F.min(F.struct("key", "cls")).alias("m")).join(used, "set").select("set", "m.*")
    sets = members.join(one, ["key", "cls"]).select("set", "doc")

    extent = runs.select("key", F.col("a.cls").alias("cls"), "before", "after").unionByName(runs.select("key", F.col("b.cls").alias("cls"), "before", "after"))
    extent = extent.unionByName(kinds.where(full).select("key", "cls", F.length("left").alias("before"), F.length("right").alias("after"))).distinct()
    spans = few.join(extent, ["key", "cls"]).select("doc", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end"))
    windows = cut(many.mapInArrow(_windows(min_len, shingle), f"doc {kind}, start int, window binary"))
    windows = windows.join(windows.groupBy("window").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("window"), "window")
    spans = spans.unionByName(windows.select("doc", "start", (F.col("start") + min_len).alias("end"))).distinct()
    return _Shared(sets, equal, pairs, spans, windows)


def _window_sets(windows: DataFrame) -> DataFrame:
    """Rows (set, doc) of the documents of each window; windows with the same documents count once."""
    members = windows.select("window", "doc").distinct()
    sets = members.groupBy("window").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("y"))
    sets = sets.groupBy("n", "x", "y").agg(F.min("window").alias("window"))
    return members.join(sets.select("window", F.struct("n", "x", "y").alias("set")), "window").select("set", "doc")


def shared_runs(df: DataFrame, id_col: str, text: str, min_len: int = 200, shingle: int | None = None, crowd: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Pairs (lo, hi) of documents with a run of at least min_len equal characters, and spans (doc, start, end) of such runs.

    The spans of a document cover exactly its characters that lie in such a run; they may overlap. Anchors with equal
    surroundings are verified once, whatever the number of documents, and sets of documents that come of several anchors
    are paired once, in blocks. An anchor with more than `crowd` different surroundings is resolved by hashes of the
    windows of min_len characters around it instead, with the same result. All documents of a passage are paired, so a
    passage in n documents gives n (n - 1) / 2 pairs. Null and short texts share nothing.
    """
    found = _shared(df, id_col, text, min_len, shingle, crowd)
    pairs = class_pairs(found.sets.join(found.equal, "set", "left_semi"), ["set"], "doc")
    pairs = pairs.unionByName(expand(found.pairs, found.sets, F.col("a"), F.col("b"), "set", "doc"))
    pairs = pairs.unionByName(class_pairs(_window_sets(found.windows), ["set"], "doc"))
    return pairs.distinct(), found.spans


def shared_share(df: DataFrame, id_col: str, text: str, min_len: int = 200, shingle: int | None = None, crowd: int = 1000) -> DataFrame:
    """One row (id, n_chars, shared_chars, shared_share) for each row with an id: how much of it lies in a shared run.

    Null texts have n_chars null and nothing shared; empty ones a share of 0.
    """
    spans = _shared(df, id_col, text, min_len, shingle, crowd).spans
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy(F.col("doc").alias("_doc")).agg(F.sum("fresh").alias("shared_chars"))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.length(text).alias("n_chars"))
    rows = rows.join(covered, F.col(id_col) == F.col("_doc"), "left").drop("_doc").na.fill(0, ["shared_chars"])
    share = F.coalesce(F.expr("try_divide(shared_chars, n_chars)"), F.lit(0.0))
    return rows.withColumn("shared_share", F.round(share, 6))


def removal_clusters(df: DataFrame, id_col: str, text: str, min_len: int = 200, shingle: int | None = None, crowd: int = 1000) -> DataFrame:
    """One row (id, cluster, keep) for each document of a shared run: cluster is its least id, which alone is kept.

    Components need each document's link to the least of its set, and one link per pair of sets, not all pairs.
    """
    found = _shared(df, id_col, text, min_len, shingle, crowd)
    sets = cut(found.sets.unionByName(_window_sets(found.windows)))
    least = sets.groupBy("set").agg(F.min("doc").alias("lo"))
    inner = found.equal.unionByName(_window_sets(found.windows).select("set").distinct()).distinct()
    # a set whose documents share no run among themselves is linked through the sets it is paired with
    through = found.pairs.select("a", "b").unionByName(found.pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("set")).agg(F.min("b").alias("b"))
    through = through.join(least.select(F.col("set").alias("b"), "lo"), "b").select("set", "lo")
    links = sets.join(through.unionByName(least.join(inner, "set", "left_semi")), "set").select("lo", F.col("doc").alias("hi"))
    across = found.pairs.join(least.select(F.col("set").alias("a"), F.col("lo").alias("x")), "a").join(least.select(F.col("set").alias("b"), F.col("lo").alias("y")), "b")
    links = links.unionByName(across.select(F.col("x").alias("lo"), F.col("y").alias("hi"))).where("lo <> hi").distinct()
    parts = connected_components(links, "lo", "hi")
    return parts.select(F.col("node").alias(id_col), F.col("component").alias("cluster"), (F.col("node") == F.col("component")).alias("keep"))
