"""Per-key results where a few keys hold most rows: counts of (key, value) first, everything else from those."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Parts into which a round of the percentile search cuts a key's remaining range of values.
PARTS = 1024
#: A key with more distinct values than HEAVY is dealt to SPREAD hash classes of values.
HEAVY, SPREAD = 100_000, 64


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, value, n): how often each value occurs with each key; nulls of either are groups of their own.

    A key's rows are spread over tasks by value, and equal pairs are combined before the shuffle.
    """
    return df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("n"))


def distinct_and_mode(counts: DataFrame) -> DataFrame:
    """From (key, value, n): rows (key, rows, nonnull, distinct_values, mode, mode_count).

    Null values count in rows only. Of equally frequent values the least is the mode; a key with null values only has
    0 distinct values and a null mode. Each task sends one partial row per key, so no key is bound to one task's rows.
    """
    real = F.col("value").isNotNull()
    # the greatest count and the least value among those that have it: one aggregate that combines map-side
    best = F.min(F.when(real, F.struct((-F.col("n")).alias("n"), "value"))).alias("best")
    sums = counts.groupBy("key").agg(F.sum("n").alias("rows"), F.sum(F.when(real, F.col("n")).otherwise(0)).alias("nonnull"), F.count("value").alias("distinct_values"), best)
    mode_count = F.coalesce(-F.col("best.n"), F.lit(0).cast("long")).alias("mode_count")
    return sums.select("key", "rows", "nonnull", "distinct_values", F.col("best.value").alias("mode"), mode_count)


def exact_percentiles(counts: DataFrame, percents: Sequence[float], max_rounds: int = 40) -> DataFrame:
    """From (key, value, n) with a numeric value: rows (key, q, result) of exact discrete percentiles.

    result is the least value at or below which at least q of the key's non-null values lie. Keys without such values
    give no row; NaN is greater than any number. Each round splits every key's remaining range into PARTS parts by
    value, sums weights per part (combined map-side), and keeps the part that holds the rank: windows run over parts,
    never over rows, whatever a key's size. A key with many distinct values meets its open ranges in SPREAD parts by
    hash of the value, for which its ranges (a row per percentile) are repeated, so its rows are never one task's.
    """
    rows = counts.where("value is not null").select("key", F.col("value").cast("double").alias("value"), "n")
    salts = F.explode(F.expr(f"sequence(0, {SPREAD - 1})"))
    heavy = rows.groupBy("key").agg(F.count("*").alias("values")).where(F.col("values") > HEAVY).select(F.col("key").alias("k"), salts.alias("s"))
    own = F.pmod(F.xxhash64("value"), F.lit(SPREAD)).cast("int")
    rows = rows.join(heavy, F.col("k").eqNullSafe(F.col("key")) & (F.col("s") == own), "left")
    rows = cut(rows.select("key", "value", "n", F.coalesce("s", F.lit(0)).alias("salt")))
    span = rows.groupBy("key").agg(F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.count("*") > HEAVY).alias("heavy"))
    # a percentile's rank, from 1; the small term keeps 0.1 * 30 from becoming 4
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total") - 1e-9)).cast("long")
    asked = F.explode(F.array(*(F.lit(float(q)) for q in percents)))
    open_ = cut(span.withColumn("q", asked).select("key", "q", "lo", "hi", rank.alias("rank"), "heavy"))
    done = open_.where(~(F.col("lo") < F.col("hi"))).select("key", "q", F.col("lo").alias("result"))
    open_ = open_.where("lo < hi")
    for _ in range(max_rounds):
        if open_.isEmpty():
            return done
        o = open_.select(F.col("key").alias("k"), "q", "lo", "hi", "rank", "heavy", F.explode(F.expr(f"sequence(0, if(heavy, {SPREAD - 1}, 0))")).alias("s"))
        met = rows.join(o, F.col("k").eqNullSafe(F.col("key")) & (F.col("s") == F.col("salt")) & F.col("value").between(F.col("lo"), F.col("hi")))
        width = F.col("hi") / 2 - F.col("lo") / 2
        share = (F.col("value") / 2 - F.col("lo") / 2) / width
        part = F.when((F.col("hi") == float("inf")) | F.isnan("hi") | (F.col("lo") == float("-inf")), F.when(F.col("value") == F.col("lo"), 0).when(F.col("value") == F.col("hi"), PARTS).otherwise(PARTS // 2)).otherwise(F.floor(share * PARTS))
        parts = met.groupBy("key", "q", "rank", "heavy", part.alias("part")).agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("key", "q").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        found = parts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        found = cut(found.select("key", "q", "lo", "hi", "heavy", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
        done = done.unionByName(found.where(~(F.col("lo") < F.col("hi"))).select("key", "q", F.col("lo").alias("result")))
        open_ = found.where("lo < hi")
    raise RuntimeError(f"percentiles need more than {max_rounds} rounds")


def key_profile(df: DataFrame, key: str, category: str, measures: Mapping[str, Sequence[float]]) -> DataFrame:
    """One row per key: rows, distinct values and mode of a category, and exact percentiles of measures.

    Columns: key, rows, nonnull, distinct_values, mode, mode_count, and <measure>_p<percent> for each measure and
    percentile (null for a key without a value). A null key is a key.
    """
    out = distinct_and_mode(value_counts(df, key, category))
    for name, percents in measures.items():
        wide = exact_percentiles(value_counts(df, key, name), percents).withColumnRenamed("key", "k")
        picks = [F.max(F.when(F.col("q") == float(q), F.col("result"))).alias(f"{name}_p{round(q * 100)}") for q in percents]
        out = out.join(wide.groupBy("k").agg(*picks), F.col("k").eqNullSafe(F.col("key")), "left").drop("k")
    return out
