"""Near-duplicate texts by Golay-code fuzzy hashing.

Words are dealt to segments by hash. A segment's fingerprint is a 23-bit parity vector: each word flips one bit, so
an inserted or deleted word is one bit error, a replaced one two. Two texts within the threshold differ in at most
E words; of E // 3 + 1 segments one then has at most two errors (pigeonhole), and list decoding with the Golay code
gives both texts' segments a common codeword index. As 12 bits alone select too little, an index is joined with a
word, the anchor. Let A and B be two such segments, words ordered by rarity over the corpus:

* the rarest words of both are equal: it is the anchor, with all indices of the whole segment;
* A's rarest is rarer than B's, so it isn't in B, and A without it has one error left: if its next word is B's rarest,
  that is the anchor, with the one index nearest to A without its rarest, which is in B's list; if B's rarest isn't in A
  either, A and B without their rarest are equal and give the same such key;
* A's two rarest aren't in B: A without them equals B, so the hash of the one is that of the other;
* nothing is in common: both have at most two words, and the texts' rarest words serve as keys (prefix filter).

Hence every pair above the threshold shares a key; candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.lineage import cut
from .golay import LENGTH, codewords
from .pairing import class_pairs, expand
from .textforms import canonical, words

#: Segment counts in use; a text takes the next larger one, so that few counts are needed for partners of other lengths.
COUNTS = np.unique(np.concatenate([np.arange(1, 4), np.ceil(3 * 1.55 ** np.arange(1, 36)).astype(np.int64)]))
#: Buckets of the histogram of word frequencies by which words are ranked; its size doesn't depend on the corpus.
BUCKETS = 1 << 20
#: A key that more than three texts have is crowded, one that more than HOT have is hot.
CROWD, HOT = 3, 50
#: Bits of a bitmap per key in it; the least and the largest bitmap (512 kB and 256 MB).
SPARSE, LEAST_BITS, MOST_BITS = 64, 1 << 22, 1 << 31
#: Rows of a task that pairs the texts of crowded keys, and rows of one key that a task pairs at once.
TASK_ROWS, KEY_ROWS = 200_000, 2000
WHOLE, REST = 1, 2
BOTH = WHOLE | REST


def word_codes(text: Column) -> Column:
    """The words of a text as sorted 31-bit hashes."""
    return F.array_sort(F.transform(words(text), lambda w: F.hash(w).bitwiseAND(F.lit(0x7FFFFFFF))))


def word_ranks(forms: DataFrame) -> np.ndarray:
    """For each hash bucket of words the binary logarithm of its frequency over all texts: BUCKETS bytes."""
    counted = forms.select(F.explode("codes").alias("c")).groupBy((F.col("c") % BUCKETS).alias("b")).agg(F.count("*").alias("n"))
    found = counted.select("b", F.ceil(F.log2("n") * 8).cast("int").alias("r")).toArrow()
    ranks = np.zeros(BUCKETS, np.uint16)
    ranks[found["b"].to_numpy()] = found["r"].to_numpy()
    return ranks


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys, and each row's rank in its run."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    return starts, np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))


def segment_counts(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index into COUNTS of the segments needed where the longer text has n words."""
    differing = 2 * (n - -(-n * num // den))
    return np.searchsorted(COUNTS, differing // 3 + 1)


def fuzzy_keys(offsets: np.ndarray, codes: np.ndarray, ranks: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a batch of texts, given as offsets into word codes: text index, key and role of each.

    Rows that meet in a key are candidates if one of them has the bit WHOLE in its role and the other the bit REST.
    """
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    codes = codes.astype(np.int64)
    order = np.lexsort((codes, ranks[codes % BUCKETS], doc))  # rarest words first
    doc, codes = doc[order], codes[order]
    _, seen = _runs(doc << 32 | codes)
    feature = _mix(codes | seen << 32, 1)  # the second of two equal words is another word
    _, rank = _runs(doc)
    prefix = rank <= (n - -(-n * num // den))[doc]
    least, most = segment_counts(n, num, den), segment_counts(n * den // num, num, den)
    out_doc, out_key, out_role = [], [], []

    def emit(docs: np.ndarray, keys: np.ndarray, role: int) -> None:
        out_doc.append(docs)
        out_key.append(keys)
        out_role.append(np.full(len(docs), role, np.int64))

    for k in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        count = int(COUNTS[k])
        use = (least <= k) & (k <= most)
        if not use.any():
            continue
        rows = use[doc]
        d, f, pre = doc[rows], feature[rows], prefix[rows]
        group = d * count + (_mix(f, 2 + count) % np.uint64(count)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        group_, f_, d_ = group[by], f[by], d[by]
        starts, place = _runs(group_)
        size = np.diff(np.r_[starts, len(group_)])
        segment = _mix((group_[starts] % count) << 16 | count, 4)
        bit = np.left_shift(1, (_mix(f_, 3) % np.uint64(LENGTH)).astype(np.int64))
        whole, total = np.bitwise_xor.reduceat(bit, starts), np.add.reduceat(_mix(f_, 9), starts)
        anchor = lambda r, index: _mix(_mix(f_[starts[r] + index] ^ segment[r], 5), 0)
        index = codewords(whole)
        fresh = np.ones_like(index, bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :1]
        every = np.arange(len(starts))
        emit(np.repeat(d_[starts], 6)[fresh.ravel()], _mix(anchor(every, 0)[:, None] + index.astype(np.uint64), 6)[fresh], BOTH)
        two = np.flatnonzero(size >= 2)
        rest = codewords(whole[two] ^ bit[starts[two]])[:, 0]
        emit(d_[starts[two]], _mix(anchor(two, 1) + rest.astype(np.uint64), 6), BOTH)
        emit(d_[starts], _mix(total ^ segment, 10), WHOLE)
        three = np.flatnonzero(size >= 3)
        less = total[three] - _mix(f_[starts[three]], 9) - _mix(f_[starts[three] + 1], 9)
        emit(d_[starts[three]], _mix(less ^ segment[three], 10), REST)
        sizes = np.bincount(group, minlength=len(n) * count)[: len(n) * count].reshape(len(n), count)
        thin_doc, thin_group = np.nonzero((sizes <= 2) & use[:, None])
        if len(thin_doc):
            first = np.searchsorted(d, np.arange(len(n)))
            width = np.bincount(d[pre], minlength=len(n))[thin_doc]
            which = np.repeat(np.arange(len(thin_doc)), width)
            at = first[thin_doc][which] + _runs(which)[1]
            emit(thin_doc[which], _mix(f[at] ^ _mix(thin_group[which] << 16 | count, 7), 8), BOTH)
    if not out_doc:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_doc), np.concatenate(out_key).view(np.int64), np.concatenate(out_role)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            codes = part.column("codes")
            offsets = codes.offsets.to_numpy()
            yield part, offsets - offsets[0], codes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _keys(ranks, num: int, den: int):
    """Rows (v, key), v being the text's number times four plus its role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, codes in _batches(batches):
            text, key, role = fuzzy_keys(offsets, codes, ranks.value, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(part.column("f").to_numpy()[text] << 2 | role), pa.array(key)], ["v", "key"])

    return run


def _crowded_keys(ranks, num: int, den: int, crowded, hot):
    """Rows (v, key, n, s1, s2) for keys whose bit is set in crowded.

    A key whose bit is set in hot is refined: every pair above the threshold also shares one of the rarest words of both
    texts (prefix filter), so such a row comes once with each of these words in its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, codes in _batches(batches):
            text, key, role = fuzzy_keys(offsets, codes, ranks.value, num, den)
            h = key & (len(crowded.value) * 64 - 1)
            keep = (crowded.value[h >> 6] >> (h & 63)) & 1 == 1
            text, key, role = text[keep], key[keep], role[keep]
            h = key & (len(hot.value) * 64 - 1)
            is_hot = (hot.value[h >> 6] >> (h & 63)) & 1 == 1
            if is_hot.any():
                n = np.diff(offsets)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((codes, ranks.value[codes % BUCKETS], doc))
                rare = _runs(doc)[1] <= (n - -(-n * num // den))[doc]
                word, owner = codes[order][rare].astype(np.int64), doc[rare]
                first, width = np.searchsorted(owner, text[is_hot]), (n - -(-n * num // den) + 1)[text[is_hot]]
                which = np.repeat(np.flatnonzero(is_hot), width)
                at = np.repeat(first, width) + _runs(which)[1]
                refined = _mix(key[which].view(np.uint64) ^ _mix(word[at], 11), 12).view(np.int64)
                text, role, key = (np.concatenate([x[~is_hot], y]) for x, y in ((text, text[which]), (role, role[which]), (key, refined)))
            columns = [part.column(c).to_numpy() for c in ("f", "n", "s1", "s2")]
            f, *rest = (c[text] for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f << 2 | role, key, *rest)], ["v", "key", "n", "s1", "s2"])

    return run


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key's hash. The number of bits follows the number of keys, up to MOST_BITS.

    A key that is no member but has its bit set only makes more rows, never other pairs.
    """
    bits = LEAST_BITS
    while bits < min(MOST_BITS, SPARSE * keys.count()):
        bits *= 2
    h = keys.select((F.col("key").bitwiseAND(F.lit(bits - 1))).alias("h"))
    words_ = h.groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words_["w"].to_numpy()] = words_["b"].to_numpy()
    return out


def _heavy_keys(many: DataFrame, rows: int) -> DataFrame | None:
    """(key, blocks) of the keys with more than KEY_ROWS rows: exact counts only of keys in hash buckets with so many."""
    buckets = 1 << max(10, (8 * rows // KEY_ROWS).bit_length())
    at = F.col("key").bitwiseAND(F.lit(buckets - 1))
    # as a table its size is known, so the join below sends it to the rows where it is small
    full = cut(many.groupBy(at.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS).select("bucket"))
    if full.isEmpty():
        return None
    counts = many.select("key", at.alias("bucket")).join(full, "bucket").groupBy("key").agg(F.count("*").alias("n"))
    heavy = cut(counts.where(F.col("n") > KEY_ROWS).select("key", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("blocks")))
    return None if heavy.isEmpty() else heavy


def _crowd_pairs(many: DataFrame, apart: str) -> DataFrame:
    """Pairs (a, b) of rows that share a key, one with WHOLE and one with REST, and are not too far apart by sketch.

    Keys are spread over as many tasks as the rows need. A key with more than KEY_ROWS rows is dealt to blocks of rows,
    each pair of which is a join key of its own.
    """
    rows = many.count()
    n, heavy = rows // TASK_ROWS + 1, _heavy_keys(many, rows)
    roles = f"(((a.v & {WHOLE}) > 0 and (b.v & {REST}) > 0) or ((a.v & {REST}) > 0 and (b.v & {WHOLE}) > 0))"
    met = lambda a, b, on: a.alias("a").join(b.alias("b"), F.expr(f"{on} and {roles} and {apart}")).select(F.col("a.v").alias("a"), F.col("b.v").alias("b"))
    if heavy is None:
        light = many.repartition(n, "key")
        return met(light, light, "a.key = b.key and a.v < b.v")
    light = many.join(heavy, "key", "left_anti").repartition(n, "key")
    salted = heavy.withColumn("salt", F.explode(F.expr("sequence(0, 63)")))
    dealt = many.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(64)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(2, v), blocks) as int)"))
    a = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.expr("sequence(own, blocks - 1)")))
    b = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.expr("sequence(0, own)")))
    return met(light, light, "a.key = b.key and a.v < b.v").unionByName(met(a, b, "a.key = b.key and a.i = b.i and a.j = b.j and (a.i < a.j or a.v < b.v)"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each pair the number of words, counted with repeats, that its two code lists share."""
    for batch in batches:
        sides = []
        for name in ("a_codes", "b_codes"):
            codes = batch.column(name)
            offsets = codes.offsets.to_numpy()
            flat = codes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
            pair = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offsets))
            sides.append(np.unique(pair << 31 | flat, return_counts=True))
        (a, na), (b, nb) = sides
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = np.bincount(a[i] >> 31, weights=np.minimum(na[i], nb[j]), minlength=batch.num_rows).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("longer"), pa.array(shared)], ["a", "b", "longer", "shared"])


def texts_as_forms(df: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """Distinct (form, content, id, codes) of texts with at least min_words words, as a table in the shared folder.

    form is a 64-bit hash of the words in any order, content one of the letters and digits in order.
    """
    made = F.struct(word_codes(F.col(text)).alias("codes"), F.xxhash64(canonical(F.col(text))).alias("content"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(made)).alias("m"))
    rows = rows.where(F.size("m.codes") >= min_words).select("id", F.xxhash64("m.codes").alias("form"), "m.content", "m.codes")
    return cut(rows.groupBy("form", "content", "id").agg(F.first("codes").alias("codes")))


def form_pairs(base: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different forms that share at least num/den of the words of the longer one."""
    # f numbers the forms: it compresses better than their hashes; s1 and s2 hold the parities of words by 7 bits of hash
    half = lambda bit: F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: F.when(c.bitwiseAND(F.lit(64)) == 64 * bit, s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63))))).otherwise(s))
    forms = base.groupBy("form").agg(F.first("codes").alias("codes"))
    forms = cut(forms.select("form", "codes", F.monotonically_increasing_id().alias("f"), F.size("codes").alias("n"), half(0).alias("s1"), half(1).alias("s2")))
    ranks = forms.sparkSession.sparkContext.broadcast(word_ranks(forms))
    keys = forms.select("f", "codes").mapInArrow(_keys(ranks, num, den), "v long, key long")
    met = keys.groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.expr("bit_xor(v)").alias("x"), F.count("*").alias("times"), F.expr("bit_or(v & 3)").alias("roles"))
    met = cut(met.where("a < b and roles = 3").drop("roles"))
    crowded, hot = (forms.sparkSession.sparkContext.broadcast(_bitmap(met.where(F.col("times") > t).select("key"))) for t in (CROWD, HOT))
    many = cut(forms.select("f", "codes", "n", "s1", "s2").mapInArrow(_crowded_keys(ranks, num, den, crowded, hot), "v long, key long, n int, s1 long, s2 long"))
    # the words by which two texts differ flip at least as many words' parities as parities differ
    apart = f"bit_count(a.s1 ^ b.s1) + bit_count(a.s2 ^ b.s2) <= 2 * (greatest(a.n, b.n) - ceil(greatest(a.n, b.n) * {num} / {den})) and least(a.n, b.n) * {den} >= greatest(a.n, b.n) * {num}"
    crowd = _crowd_pairs(many, apart)
    c = met.where("times = 3").withColumn("c", F.expr("a ^ b ^ x"))
    third = c.select("a", F.col("c").alias("b")).unionByName(c.select(F.col("c").alias("a"), "b"))
    number = lambda df: df.select(F.shiftright("a", 2).alias("a"), F.shiftright("b", 2).alias("b")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x < y").distinct()
    sketch = forms.select("f", "n", "s1", "s2")
    few = number(met.where("times < 4").select("a", "b").unionByName(third))
    few = few.join(sketch.alias("a"), F.col("x") == F.col("a.f")).join(sketch.alias("b"), F.col("y") == F.col("b.f")).where(F.expr(apart)).select("x", "y")
    pairs = few.unionByName(number(crowd)).distinct()
    sided = pairs.join(forms.select(F.col("f").alias("x"), F.col("codes").alias("a_codes"), F.col("form").alias("a")), "x")
    sided = sided.join(forms.select(F.col("f").alias("y"), F.col("codes").alias("b_codes"), F.col("form").alias("b")), "y")
    sided = sided.select("a", "b", "a_codes", "b_codes", F.greatest(F.size("a_codes"), F.size("b_codes")).alias("longer"))
    return cut(sided.mapInArrow(_shared, "a long, b long, longer int, shared int").where(f"shared * {den} >= longer * {num}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def near_pairs(df: DataFrame, id_col: str, text: str, min_words: int = 24, num: int = 17, den: int = 20) -> DataFrame:
    """Pairs (lo, hi) of ids whose texts share at least num/den of the words of the longer one, in any order.

    Words are counted with repeats. Left out: texts under min_words words, null texts and ids, and pairs with the same
    letters and digits in order (those are copies). Every id of a content is paired with every id of a near content, in
    blocks, so the output grows with the product of the copies of both; near_classes is linear in the rows.
    """
    base = texts_as_forms(df, id_col, text, min_words)
    near = form_pairs(base, num, den)
    used = near.select(F.col("a").alias("form")).unionByName(near.select(F.col("b").alias("form"))).distinct()
    linked = base.join(used, "form", "left_semi").select("form", F.struct("content", "id").alias("m"))
    far = expand(near, linked, F.col("a"), F.col("b"), "form", "m").where("lo.content <> hi.content")
    # one bag of words in several orders
    several = base.groupBy("form").agg(F.min("content").alias("x"), F.max("content").alias("y")).where("x < y").select("form")
    bags = base.join(several, "form", "left_semi").select("form", F.struct("form", "content").alias("c"), "id")
    same = expand(class_pairs(bags, ["form"], "c"), bags, F.col("lo"), F.col("hi"), "c", "id")
    out = far.select(F.col("lo.id").alias("x"), F.col("hi.id").alias("y")).unionByName(same.toDF("x", "y")).where("x <> y")
    return out.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()


def near_classes(df: DataFrame, id_col: str, text: str, min_words: int = 24, num: int = 17, den: int = 20) -> DataFrame:
    """One row (id, class_id, links) for each id with a text of at least min_words words.

    class_id is shared by all ids that near texts link, directly or through others (copies included); links counts the
    other word forms that are near the id's own. Sizes and hot groups: as near_pairs, but copies are never paired.
    """
    base = texts_as_forms(df, id_col, text, min_words)
    near = form_pairs(base, num, den)
    part = connected_components(near, "a", "b")
    links = near.select(F.col("a").alias("form")).unionByName(near.select(F.col("b").alias("form"))).groupBy("form").agg(F.count("*").alias("links"))
    rows = base.select("id", "form").distinct().join(part.withColumnRenamed("node", "form"), "form", "left").join(links, "form", "left")
    return rows.select("id", F.coalesce("component", "form").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
