"""Corpus counts and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outlets_per_quote(quotes: DataFrame, quote: str, domain: str, approximate: bool = False) -> DataFrame:
    """(quote, n_outlets): distinct domains by quotation; null domains don't count, so 0 is possible."""
    count = F.approx_count_distinct(domain) if approximate else F.countDistinct(domain)
    return quotes.groupBy(quote).agg(count.alias("n_outlets"))


def once_only(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur in exactly one row."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(key)


def quotes_of_graph(quotes: DataFrame, edges: DataFrame, article: str, quote: str, edge_quote: str) -> DataFrame:
    """(article, quote_ids): sorted distinct quotation ids of each article that occur in the graph, joined by blanks."""
    ids = edges.select(F.col(edge_quote).alias(quote)).distinct()
    return quotes.select(article, quote).distinct().join(ids, quote, "left_semi").groupBy(article).agg(F.array_join(F.array_sort(F.collect_list(quote)), " ").alias("quote_ids"))


def draw(key: Column, seed: str) -> Column:
    """A uniform, repeatable order of keys."""
    return F.md5(F.concat(key, F.lit(seed)))


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Catalyst limits each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: str = "0", held: DataFrame | None = None) -> DataFrame:
    """k rows of each group, uniform and without replacement; repeated keys count once, null groups are left out.

    Keys of held, which an earlier draw has, are skipped.
    """
    some = rows.where(F.col(group).isNotNull())
    if held is not None:
        some = some.join(held.select(key).distinct(), key, "left_anti")
    some = some.dropDuplicates([key])
    return top_per_group(some, group, k, draw(F.col(key), seed), F.col(key)).drop("rank")


def uniform_sample(rows: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n distinct keys, uniform; a bounded heap per task."""
    return rows.select(key).distinct().orderBy(draw(F.col(key), seed), F.col(key)).limit(n)


def quota_sample(rows: DataFrame, bucket: str, key: str, quotas: Mapping[str, int], seed: str = "0") -> DataFrame:
    """Of each bucket as many rows as its quota; buckets without quota give none."""
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(bucket) == name, n).otherwise(quota)
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(draw(F.col(key), seed), F.col(key)))
    # the greatest quota as a literal limits each task's groups before the shuffle
    some = rows.where(F.col(bucket).isin(list(quotas))).withColumn("_rank", rank).where(F.col("_rank") <= max(quotas.values(), default=0))
    return some.where(F.col("_rank") <= quota).drop("_rank")


def damaged_first(rows: DataFrame, damaged: Column, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows, up to half of them damaged, the rest from the others; too few of one kind are made up by the other."""
    rank = F.row_number().over(Window.partitionBy("_d").orderBy(draw(F.col(key), seed), F.col(key)))
    ranked = rows.withColumn("_d", F.coalesce(damaged, F.lit(False))).withColumn("_r", rank).where(F.col("_r") <= n)
    place = F.when(F.col("_d") & (F.col("_r") <= n // 2), 0).when(~F.col("_d"), 1).otherwise(2)
    return ranked.orderBy(place, "_r").limit(n).drop("_d", "_r")


def row_group_chunks(groups: DataFrame, chunks: int, order: Sequence[str] = ("path", "row_group")) -> DataFrame:
    """Row groups (path, row_group, n_rows) with first_row and chunk_id, cut into contiguous slices of ceil(total / chunks) rows.

    A row group belongs to the chunk in which it begins. Files (the first column of the order) are summed first, so the
    running sum over all of them has one row per file, and the one over row groups runs by file.
    """
    file, *rest = order
    sums = groups.groupBy(file).agg(F.sum("n_rows").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(F.lit(0)).orderBy(file).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    within = F.sum("n_rows").over(Window.partitionBy(file).orderBy(*(rest or [file])).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_rows")
    total = groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("_total"))
    rows = groups.withColumn("_within", within).join(sums.withColumn("_before", before).drop("_rows"), file)
    rows = rows.withColumn("first_row", F.col("_before") + F.col("_within")).drop("_before", "_within").crossJoin(F.broadcast(total))
    return rows.withColumn("chunk_id", F.floor(F.col("first_row") / F.greatest(F.ceil(F.col("_total") / chunks), F.lit(1))).cast("int")).drop("_total")
