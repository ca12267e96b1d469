"""Pairs of ids from classes of any size, and pairs of classes, dealt to blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Ids that a block holds on average at most, and hash classes among which the rows of a heavy class are dealt.
BLOCK, SALTS = 1000, 64


def blocks(members: DataFrame, keys: list[str], id_col: str, block: int = BLOCK) -> DataFrame:
    """Rows (keys..., blk, blocks, ids): the distinct ids of each class in sorted arrays of about `block` ids or fewer.

    A class of n rows has ceil(n / block) blocks, dealt by hash of the id. Sizes are counted with map-side combining; only
    the heavy classes, at most one row per `block` rows, are joined back, once per hash class of the id, so that no class
    is bound to one task. Null ids are left out.
    """
    ids = cut(members.select(*keys, F.col(id_col).alias("_id")).where("_id is not null"))
    # as a table its size is known, so that it is sent to the rows where it is small
    heavy = cut(ids.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block))
    if heavy.isEmpty():
        dealt = ids.select(*keys, F.lit(0).alias("blk"), F.lit(1).alias("blocks"), "_id")
    else:
        heavy = heavy.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"), F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("_salt"))
        dealt = ids.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(heavy, [*keys, "_salt"], "left")
        own = F.coalesce(F.expr("pmod(xxhash64(2, _id), _blocks)"), F.lit(0)).cast("int")
        dealt = dealt.select(*keys, own.alias("blk"), F.coalesce("_blocks", F.lit(1)).alias("blocks"), "_id")
    return dealt.groupBy(*keys, "blk", "blocks").agg(F.sort_array(F.collect_set("_id")).alias("ids"))


def class_pairs(members: DataFrame, keys: list[str], id_col: str, block: int = BLOCK) -> DataFrame:
    """All pairs (lo, hi) of distinct ids in one class, whatever its size: n (n - 1) / 2 of n ids.

    A block's pairs are made in place; each pair of blocks of a heavy class is a join key of its own, so no task holds
    a class's pairs. Ids in several common classes give a pair for each.
    """
    dealt = blocks(members, keys, id_col, block)
    inner = dealt.where("size(ids) > 1").select("ids", F.posexplode("ids").alias("at", "lo"))
    inner = inner.select("lo", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("hi"))
    large = dealt.where("blocks > 1")
    a = large.select(*keys, F.col("ids").alias("a"), F.col("blk").alias("i"), F.explode(F.expr("filter(sequence(blk, blocks - 1), j -> j > blk)")).alias("j"))
    b = large.select(*keys, F.col("ids").alias("b"), F.col("blk").alias("j"), F.explode(F.expr("filter(sequence(0, blk), i -> i < blk)")).alias("i"))
    outer = a.join(b, [*keys, "i", "j"]).select(F.explode("a").alias("x"), "b").select("x", F.explode("b").alias("y"))
    return inner.unionByName(outer.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")))


def expand(pairs: DataFrame, members: DataFrame, a: Column, b: Column, key: str, id_col: str, block: int = BLOCK) -> DataFrame:
    """Pairs (lo, hi) of different ids, one of class a and one of class b, for each row of pairs; a pair may repeat.

    Classes come as blocks of ids, so a pair of large classes is met block by block and spread over tasks.
    """
    dealt = blocks(members, [key], id_col, block)
    left, right = (dealt.select(F.col(key).alias(k), F.col("blk").alias(n), F.col("ids").alias(i)) for k, n, i in (("_a", "_i", "_x"), ("_b", "_j", "_y")))
    met = pairs.select(a.alias("_a"), b.alias("_b")).join(left, "_a").join(right, "_b")
    out = met.select("_y", F.explode("_x").alias("x")).select("x", F.explode("_y").alias("y")).where("x <> y")
    return out.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))


def memberships(members: DataFrame, keys: list[str], id_col: str, block: int = BLOCK) -> DataFrame:
    """One row (id, record, ids) per class and id: the class's least id stands for it; ids is the class's size."""
    dealt = blocks(members, keys, id_col, block)
    least = dealt.groupBy(*keys).agg(F.min(F.col("ids")[0]).alias("record"), F.sum(F.size("ids")).alias("n_ids"))
    return dealt.join(least, keys).select(F.explode("ids").alias("id"), "record", F.col("n_ids").alias("ids"))
