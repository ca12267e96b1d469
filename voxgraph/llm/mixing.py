"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut, drop
from .tokens import token_counts

#: Bits of the hash that each histogram splits, and the number of histograms.
BITS, LEVELS = 12, 4
#: Documents beyond the threshold that may fill what is left of a source's budget.
FILLS = 2


def _plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None, tolerance: float) -> DataFrame:
    """Per target source its available and planned tokens, whole copies and the rest; one row per listed source."""
    t = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    t = t.join(sizes, "source", "left").na.fill(0, ["available_tokens", "target_share"])
    t = t.withColumn("cap", F.col("available_tokens") * F.greatest(F.col("max_repeats"), F.lit(0)))
    t = t.withColumn("reach", F.when((F.col("cap") > 0) & (F.col("target_share") > 0), F.col("cap") / F.col("target_share")))
    if total_tokens is None:
        # the least reach, after sources that hold together at most `tolerance` of the wanted shares
        before = F.sum("target_share").over(Window.partitionBy(F.lit(0)).orderBy("reach", "source").rowsBetween(Window.unboundedPreceding, 0))
        ranked = t.where("reach is not null").withColumn("upto", before)
        total = ranked.agg(F.coalesce(F.min(F.when(F.col("upto") > tolerance * (1 + 1e-9), F.col("reach"))), F.min("reach")).alias("total"))
        t = t.crossJoin(F.broadcast(total))
    else:
        t = t.withColumn("total", F.lit(float(total_tokens)))
    wanted = F.coalesce("total", F.lit(0.0)) * F.col("target_share")
    t = t.withColumn("planned_tokens", F.round(F.least(F.col("cap").cast("double"), wanted)).cast("long"))
    t = t.withColumn("short", F.col("cap") < F.floor(wanted))
    full = F.when(F.col("available_tokens") > 0, F.floor(F.col("planned_tokens") / F.col("available_tokens"))).otherwise(0)
    return t.withColumn("whole", full).withColumn("rest", F.col("planned_tokens") - F.col("whole") * F.col("available_tokens")).drop("cap", "reach")


def _threshold(rows: DataFrame, sums: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, low, gap): documents of a hash under low fit the rest of the plan and leave gap; and the boundary rows.

    sums: tokens by source and the hash's first BITS bits, so the rows are read only to keep those of the boundary
    bucket, and each further level reads the last one's boundary rows alone.
    """
    edge, inside = plan.select("source", "rest", F.lit(0).cast("long").alias("low")), rows
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        if level:
            sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        met = sums.join(edge, "source").withColumn("upto", upto)
        fit, over = F.col("upto") <= F.col("rest"), F.col("upto") > F.col("rest")
        step = met.groupBy("source").agg(F.max(F.when(fit, F.col("upto"))).alias("used"), F.min(F.when(over, F.col("bucket"))).alias("bucket"))
        # the first bucket that doesn't fit; if all fit, none is left to split
        edge = edge.join(step, "source", "left").select("source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), F.coalesce(F.shiftleft("bucket", shift), F.lit(1 << (BITS * LEVELS))).alias("low"))
        edge = cut(edge)
        last, inside = inside, cut(inside.join(edge.select("source", F.shiftright("low", shift).alias("b")), "source").where(F.shiftright("h", shift) == F.col("b")).drop("b"))
        if level:
            drop(last)
    return edge.withColumnRenamed("rest", "gap"), inside


def _fills(rows: DataFrame, edge: DataFrame, id_col: str) -> DataFrame:
    """(source, id): up to FILLS documents per source, beyond its threshold, that together bring it nearest to its plan.

    Each step takes the document that leaves the smallest error, if that is less than without it; ties go to the least
    hash. One aggregate per step, one row per source and task.
    """
    taken = None
    for _ in range(FILLS):
        rest = rows.join(edge.where("gap > 0"), "source").where("h >= low")
        if taken is not None:
            rest = rest.join(taken, ["source", id_col], "left_anti")
        best = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("n_tokens")).alias("error"), "h", F.col(id_col).alias("id"), "n_tokens", "gap")).alias("m"))
        best = cut(best.where("m.error < m.gap").select("source", F.col("m.id").alias(id_col), "m.n_tokens"))
        edge = edge.join(best.select("source", "n_tokens"), "source", "left").select("source", "low", (F.col("gap") - F.coalesce("n_tokens", F.lit(0))).alias("gap"))
        best = best.select("source", id_col)
        taken = best if taken is None else taken.unionByName(best)
    return taken


def mix(
    documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", total_tokens: int | None = None, tolerance: float = 0.05, **tokenizer
) -> tuple[DataFrame, DataFrame]:
    """The mix (id, source, n_tokens, copies) of all documents used at least once, and a report of shares by source.

    targets: source, target_share, max_repeats. total_tokens is the size of the mix. Without it, it is the largest size
    that every source with tokens reaches, but for sources that want together at most `tolerance` of the mix and would
    hold it down: these give all they may and are marked short. With it, any source may be short. The report's fair_share
    is a source's planned part of what all sources plan, so what the short ones lack is spread over the others; it
    equals target_share where none is short or empty. Sources that are no target, null sources and ids, and texts
    without tokens are left out; a target without tokens gives nothing and stands in the report with 0.

    Which documents get one copy more is decided by a threshold on a hash of the id: a histogram of token sums over hash
    buckets locates it, further ones split the boundary bucket alone, so nothing is sorted and the plan's tables grow
    with sources, not with rows. Up to FILLS documents beyond the threshold then fill the gap as nearly as one document
    can. Ids are taken as unique; rows of one id share their fate.
    """
    known = documents.where(F.col("source").isNotNull() & F.col(id_col).isNotNull())
    known = known.join(targets.where("source is not null").select("source").distinct(), "source", "left_semi")
    counted = token_counts(known, text, id_col, "source", **tokenizer).where("n_tokens > 0")
    rows = cut(counted.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - BITS * LEVELS)))
    sums = cut(rows.groupBy("source", F.shiftright("h", BITS * (LEVELS - 1)).alias("bucket")).agg(F.sum("n_tokens").alias("n")))
    plan = cut(_plan(sums.groupBy("source").agg(F.sum("n").alias("available_tokens")), targets, total_tokens, tolerance))
    edge, boundary = _threshold(rows, sums, plan)
    drop(boundary)
    fills = _fills(rows, edge, id_col).withColumn("fill", F.lit(1))
    drawn = rows.join(plan.select("source", "whole"), "source").join(edge.select("source", "low"), "source").join(fills, ["source", id_col], "left")
    more = (F.col("h") < F.col("low")) | F.col("fill").isNotNull()
    mixed = drawn.withColumn("copies", F.col("whole") + more.cast("long")).where("copies > 0").select(id_col, "source", "n_tokens", "copies")
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left").na.fill(0, ["actual_tokens", "documents", "most_copies"])
    report = report.crossJoin(F.broadcast(report.agg(F.sum("actual_tokens").alias("all_tokens"), F.sum("planned_tokens").alias("all_planned"))))
    share = lambda n, of: F.coalesce(F.expr(f"try_divide({n}, {of})"), F.lit(0.0))
    report = report.withColumns({"actual_share": share("actual_tokens", "all_tokens"), "fair_share": share("planned_tokens", "all_planned")})
    return mixed, report.select("source", "target_share", "fair_share", "max_repeats", "available_tokens", "planned_tokens", "actual_tokens", "actual_share", "short", "documents", "most_copies")
