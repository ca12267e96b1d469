"""Statistics of scored edges: bins, regressions with clustered errors, decompositions, corrections."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import erfc, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, drop
from .skew import exact_percentiles, value_counts

#: Fixed: rows of at least so many words; bins and models of at least so many rows; sure attributions; widths of bins.
LEAST_WORDS, LEAST_ROWS, SURE, AGE_WIDTH, GAP_WIDTH = 25, 100, 0.8, 5, 5


def floor_bin(x: Column, width: float) -> Column:
    """The lower end of x's bin, rounded down for negative values too."""
    return F.floor(x / width) * width


def preprocess(edges: DataFrame) -> DataFrame:
    """Edges of enough words between different persons, with logarithm of length, gaps, bins and dyad; one projection and filter."""
    e = edges.where((F.col("n_words") >= LEAST_WORDS) & (F.col("source_id") != F.col("target_id")))
    return e.withColumns({
        "log_quote_length": F.log("n_words"), "age_diff": F.col("source_age") - F.col("target_age"), "pagerank_diff": F.col("source_pagerank") - F.col("target_pagerank"),
        "source_age_bin": floor_bin(F.col("source_age"), AGE_WIDTH), "target_age_bin": floor_bin(F.col("target_age"), AGE_WIDTH),
        "age_diff_bin": floor_bin(F.col("source_age") - F.col("target_age"), GAP_WIDTH), "dyad_id": F.concat_ws("_", "source_id", "target_id"),
    })


def bin_statistics(rows: DataFrame, score: str, *bins: str, least: int = LEAST_ROWS) -> DataFrame:
    """(bins, mean, std, n, se, ci_low, ci_high) of a score; n counts scores that aren't null, smaller cells are left out."""
    g = rows.where(" and ".join(f"`{b}` is not null" for b in bins)).groupBy(*bins).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(score).alias("n")).where(F.col("n") >= least)
    se = F.col("std") / F.sqrt("n")
    return g.withColumn("se", se).withColumn("ci_low", F.col("mean") - 1.96 * se).withColumn("ci_high", F.col("mean") + 1.96 * se)


def binning_sensitivity(rows: DataFrame, score: str, gap: str, base: int = 5, least: int = LEAST_ROWS) -> DataFrame:
    """bin_statistics at half, base and double width in one aggregation: each row comes once per width."""
    widths = [("half", base // 2 or 1), ("base", base), ("double", base * 2)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(w).alias("width")) for n, w in widths)))
    r = rows.select(score, gap, each.alias("w")).select(score, F.col("w.label").alias("label"), F.col("w.width").alias("width"), floor_bin(F.col(gap), F.col("w.width")).alias("gap_bin"))
    return bin_statistics(r, score, "label", "width", "gap_bin", least=least)


def interpolated_percentiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact percentiles of a column, interpolated between neighbours; empty without a value.

    The values at both neighbouring ranks are located by the range search of skew.exact_percentiles, so no task holds
    all distinct values; the driver gets two values per share.
    """
    counts = value_counts(rows.select(F.lit(0).alias("_k"), F.col(column).cast("double").alias("_v")), "_k", "_v")
    counts = cut(counts)
    n = counts.where("value is not null").agg(F.sum("n")).first()[0]
    if not n:
        return []
    places = [(n - 1) * q for q in shares]
    ranks = sorted({min(n, int(p) + d) for p in places for d in (1, 2)})
    # a share half a rank below makes the discrete percentile that rank's value
    found = {r["q"]: r["result"] for r in exact_percentiles(counts, [(r - 0.5) / n for r in ranks]).collect()}
    value = {r: found[(r - 0.5) / n] for r in ranks}
    drop(counts)
    return [value[int(p) + 1] + (p - int(p)) * (value[min(n, int(p) + 2)] - value[int(p) + 1]) for p in places]


def quantile_bins(rows: DataFrame, column: str, parts: int = 20) -> DataFrame:
    """rows with <column>_bin, the number of the quantile bin (low, high] from 0, the least value in the first; equal edges join.

    Edges are exact, interpolated percentiles. Null stays null.
    """
    edges = list(dict.fromkeys(interpolated_percentiles(rows, column, [i / parts for i in range(parts + 1)])))
    low = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)).cast("array<double>"), lambda e: e < F.col(column)))
    return rows.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), F.greatest(low - 1, F.lit(0))))


def summary(edges: DataFrame) -> DataFrame:
    """One row: quotes, speakers, targets, dyads, exact median and mean length, first and last year.

    Edges are counted by dyad first; the distinct counts work on that table.
    """
    dyads = cut(edges.groupBy("source_id", "target_id").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.count("n_words").alias("known"), F.min("pub_year").alias("low"), F.max("pub_year").alias("high")))
    one = lambda c: dyads.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count("*").alias("n")).first()[0]
    median = interpolated_percentiles(edges, "n_words", [0.5])
    all_ = dyads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_quotes"), F.count("*").alias("n_dyads"), F.try_divide(F.sum("words"), F.sum("known")).alias("mean_words"), F.min("low").alias("first_year"), F.max("high").alias("last_year"))
    made = {"n_speakers": F.lit(one("source_id")).cast("long"), "n_targets": F.lit(one("target_id")).cast("long"), "median_words": F.lit(median[0] if median else None).cast("double")}
    return all_.withColumns(made).select("n_quotes", "n_speakers", "n_targets", "n_dyads", "median_words", "mean_words", "first_year", "last_year")


class Fit:
    """A least-squares model from its cross products: coefficients, residual sum, and what can be had without another pass."""

    def __init__(self, names: Sequence[str], xx: np.ndarray, xy: np.ndarray, yy: float, y: float, n: int):
        self.names, self.xx, self.xy, self.yy, self.y, self.n = list(names), xx, xy, yy, y, n
        self.beta = np.linalg.pinv(xx) @ xy
        self.rank = int(np.linalg.matrix_rank(xx))
        self.rss = float(max(yy - self.beta @ xy, 0.0))
        self.r2 = 1 - self.rss / (yy - y * y / n) if n and yy - y * y / n > 0 else 0.0

    def without(self, *names: str) -> Fit:
        keep = [i for i, x in enumerate(self.names) if x not in names]
        return Fit([self.names[i] for i in keep], self.xx[np.ix_(keep, keep)], self.xy[keep], self.yy, self.y, self.n)

    def partial_eta(self, *names: str) -> float:
        """Share of a term in what the other terms leave unexplained."""
        term = self.without(*names).rss - self.rss
        return term / (term + self.rss) if term + self.rss > 0 else 0.0

    @property
    def aic(self) -> float:
        return self.n * (log(2 * pi * self.rss / self.n) + 1) + 2 * self.rank if self.rss > 0 else float("-inf")


def _design(numeric: Mapping[str, Column], categories: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Intercept, numeric terms, and an indicator for each level but the first."""
    out = {"Intercept": F.lit(1.0)} | {k: c.cast("double") for k, c in numeric.items()}
    for column, levels in categories.items():
        out |= {f"{column}[{v}]": (F.col(column) == v).cast("double") for v in levels[1:]}
    return out


def levels(rows: DataFrame, column: str, most: int = 400) -> list[str]:
    """All levels of a category, sorted; more than `most`, whose cross products would be too large, are an error."""
    found = rows.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels; group the rare ones first")
    return sorted(r[0] for r in found)


def _products(k: int):
    """Per batch the cross products of all columns (terms, then the score), upper half, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        n = 0
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((k, 0))
            total, n = total + x @ x.T, n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["n", "xx"])

    return run


def fit(rows: DataFrame, score: str, numeric: Mapping[str, Column], categories: Mapping[str, Sequence[str]] | None = None) -> Fit:
    """Least squares in one pass: every task sends one matrix of cross products, whatever the number of rows."""
    x = _design(numeric, categories or {})
    names, k = list(x), len(x)
    held = rows.select(*(c.cast("double").alias(f"_x{i}") for i, c in enumerate(x.values())), F.col(score).cast("double").alias("_y")).dropna()
    parts = held.mapInArrow(_products(k + 1), "n long, xx array<double>").select("n", F.posexplode("xx").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = {r["at"]: r for r in parts.collect()}
    if not got or not got[0]["n"]:
        return Fit(names, np.zeros((k, k)), np.zeros(k), 0.0, 0.0, 0)
    all_ = np.array([got[i]["v"] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1)
    return Fit(names, all_[:k, :k], all_[:k, k], float(all_[k, k]), float(all_[0, k]), int(got[0]["n"]))


def clustered_covariance(rows: DataFrame, model: Fit, score: str, numeric: Mapping[str, Column], cluster: str, categories: Mapping[str, Sequence[str]] | None = None) -> np.ndarray:
    """Covariance of the coefficients with errors correlated within clusters: one aggregation by cluster, one over all."""
    x = _design(numeric, categories or {})
    held = rows.select(F.col(cluster).alias("_g"), F.col(score).cast("double").alias("_y"), *(c.alias(f"_x{i}") for i, c in enumerate(x.values()))).dropna()
    k = len(model.names)
    error = F.col("_y") - sum((F.col(f"_x{i}") * float(b) for i, b in enumerate(model.beta)), F.lit(0.0))
    scores = held.withColumn("_e", error).groupBy("_g").agg(*(F.sum(F.col(f"_x{i}") * F.col("_e")).alias(f"u{i}") for i in range(k))).drop("_g")
    parts = scores.mapInArrow(_products(k), "n long, xx array<double>").select("n", F.posexplode("xx").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = {r["at"]: r for r in parts.collect()}
    meat = np.array([got[i]["v"] if i in got else 0.0 for i in range(k * k)]).reshape(k, k)
    bread, g, n = np.linalg.pinv(model.xx), got[0]["n"] if got else 0, model.n
    return bread @ meat @ bread * (g / max(g - 1, 1)) * ((n - 1) / max(n - model.rank, 1))


def _tail(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def gap_regression(rows: DataFrame, score: str, gap: str, attribute: str = "source_age", categories: Sequence[str] = ("source_occupation",), cluster: str = "dyad_id") -> DataFrame | None:
    """(term, coef, se, p_value, ci_low, ci_high, partial_eta_sq, n_obs, r_squared, aic, aic_linear) of gap and gap_sq; None under 100 rows.

    The model has the gap, its square, the source's attribute, the logarithm of length and an intercept for each level of
    each category (occupations of both ends and nationality, where the table has them); errors are clustered by dyad,
    p-values normal. Rows with a null in any of these are left out.
    """
    some = rows.where(" and ".join(f"`{c}` is not null" for c in (score, gap, attribute, *categories, "log_quote_length")))
    numeric = {"gap": F.col(gap), "gap_sq": F.col(gap) ** 2, attribute: F.col(attribute), "log_quote_length": F.col("log_quote_length")}
    cats = {c: levels(some, c) for c in categories}
    model = fit(some, score, numeric, cats)
    if model.n < LEAST_ROWS:
        return None
    cov = clustered_covariance(some, model, score, numeric, cluster, cats)
    return _report(rows, model, cov, ("gap", "gap_sq"), model.without("gap_sq").aic)


def interaction_regression(rows: DataFrame, score: str, source: str, target: str, categories: Sequence[str] = ("source_occupation",), cluster: str = "dyad_id") -> DataFrame | None:
    """As gap_regression, of source, target and source:target in a model with their product."""
    some = rows.where(" and ".join(f"`{c}` is not null" for c in (score, source, target, *categories, "log_quote_length")))
    cross = f"{source}:{target}"
    numeric = {source: F.col(source), target: F.col(target), cross: F.col(source) * F.col(target), "log_quote_length": F.col("log_quote_length")}
    cats = {c: levels(some, c) for c in categories}
    model = fit(some, score, numeric, cats)
    if model.n < LEAST_ROWS:
        return None
    cov = clustered_covariance(some, model, score, numeric, cluster, cats)
    return _report(rows, model, cov, (source, target, cross), model.without(cross).aic)


def _report(rows: DataFrame, model: Fit, cov: np.ndarray, terms: Sequence[str], aic_linear: float) -> DataFrame:
    out = []
    for t in terms:
        i = model.names.index(t)
        b, se = float(model.beta[i]), sqrt(max(cov[i, i], 0.0))
        out.append((t, b, se, _tail(b / se) if se else 1.0, b - 1.96 * se, b + 1.96 * se, model.partial_eta(t), model.n, model.r2, model.aic, aic_linear))
    return rows.sparkSession.createDataFrame(out, "term string, coef double, se double, p_value double, ci_low double, ci_high double, partial_eta_sq double, n_obs long, r_squared double, aic double, aic_linear double")


def combined_coefficient(model: Fit, terms: Sequence[str]) -> float:
    return float(sum(model.beta[model.names.index(t)] for t in terms))


def combined_error(model: Fit, covariance: np.ndarray, terms: Sequence[str]) -> float:
    """Standard error of a sum of coefficients: the root of the sum of their covariances."""
    at = [model.names.index(t) for t in terms]
    return sqrt(max(float(covariance[np.ix_(at, at)].sum()), 0.0))


def fdr(results: DataFrame, p: str, alpha: float = 0.05, parts: int = 1024) -> DataFrame:
    """results with p_adjusted and significant, by Benjamini and Hochberg; null p-values stay null and don't count.

    Tests of equal p-values have the adjusted value of the last of them, so equal values are counted first; ranks come of
    counts by `parts` ranges of p in [0, 1] and places within, and the running minimum of one within each range and one
    over the ranges. No task holds more than a range of distinct values. Values outside [0, 1] are of the end ranges.
    """
    counts = cut(results.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_n")))
    counts = counts.withColumn("_b", F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(F.col("_p") * parts))).cast("int"))
    ranges = counts.groupBy("_b").agg(F.sum("_n").alias("_in"))
    over = Window.partitionBy(F.lit(0)).orderBy("_b")  # at most `parts` rows
    ranges = ranges.withColumn("_before", F.sum("_in").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).withColumn("_all", F.sum("_in").over(Window.partitionBy(F.lit(0))))
    up = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(F.broadcast(ranges), "_b").withColumn("_rank", F.col("_before") + F.sum("_n").over(up))
    raw = ranked.withColumn("_raw", F.col("_p") * F.col("_all") / F.col("_rank"))
    down = Window.partitionBy("_b").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    raw = cut(raw.withColumn("_own", F.min("_raw").over(down)).select("_p", "_b", "_own"))
    least = raw.groupBy("_b").agg(F.min("_own").alias("_least"))
    later = least.withColumn("_later", F.min("_least").over(Window.partitionBy(F.lit(0)).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    adjusted = raw.join(F.broadcast(later), "_b").select("_p", F.least(F.lit(1.0), "_own", F.coalesce("_later", F.lit(1.0))).alias("p_adjusted"))
    out = results.join(adjusted, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")
    return out.withColumn("significant", F.col("p_adjusted") < alpha)


def global_rank(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """rows with their place, from 1, in the order of a hexadecimal hash: counts by its first three digits, then places within."""
    r = rows.withColumn("_h", order).withColumn("_b", F.left("_h", F.lit(3)))
    counts = r.groupBy("_b").agg(F.count("*").alias("_n"))
    start = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_start", F.lit(0)).alias("_start"))
    placed = r.join(F.broadcast(start), "_b")  # at most 4096 rows
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    return placed.withColumn(name, F.col("_start") + within).drop("_h", "_b", "_start")


def permuted(rows: DataFrame, key: str, columns: Sequence[str], seed: str) -> DataFrame:
    """rows with the named columns shuffled jointly: row k of one random order gets them from row k of another."""
    left = global_rank(rows.drop(*columns), F.md5(F.concat(F.lit("l" + seed), F.col(key).cast("string"))), "_k")
    right = global_rank(rows.select(F.col(key).alias("_key"), *columns), F.md5(F.concat(F.lit("r" + seed), F.col("_key").cast("string"))), "_k").drop("_key")
    return left.join(right, "_k").drop("_k")


def permutation_baseline(rows: DataFrame, key: str, score: str, times: int = 10, source: str = "source_age", target: str = "target_age") -> DataFrame:
    """One row (real_r_squared, mean, std, p_permutation, times): fit of score on the gap against fits with targets shuffled."""
    some = rows.where(" and ".join(f"`{c}` is not null" for c in (score, source, target, "log_quote_length"))).select(key, score, source, target, "log_quote_length")
    terms = {"gap": F.col(source) - F.col(target), "gap_sq": (F.col(source) - F.col(target)) ** 2, source: F.col(source), "log_quote_length": F.col("log_quote_length")}
    real = fit(some, score, terms).r2
    others = np.array([fit(permuted(some, key, [target], str(i)), score, terms).r2 for i in range(times)])
    out = [(real, float(others.mean()), float(others.std()), float((others >= real).mean()), times)]
    return rows.sparkSession.createDataFrame(out, "real_r_squared double, permuted_mean double, permuted_std double, p_permutation double, times int")


def variance_decomposition(rows: DataFrame, score: str, source_bin: str, target_bin: str) -> DataFrame:
    """(term, sum_sq, partial_eta_sq, n_obs, r_squared) of both bins and their interaction, each after the other main effect.

    One aggregation to cells; the nested fits work on the cells, whose number doesn't depend on the rows.
    """
    some = rows.where(" and ".join(f"`{c}` is not null" for c in (score, source_bin, target_bin)))
    cells = some.groupBy(F.col(source_bin).alias("s"), F.col(target_bin).alias("t")).agg(F.count("*").alias("n"), F.sum(score).alias("y"), F.sum(F.col(score) * F.col(score)).alias("yy")).collect()
    schema = "term string, sum_sq double, partial_eta_sq double, n_obs long, r_squared double"
    if not cells:
        return rows.sparkSession.createDataFrame([], schema)
    w, y = np.array([c["n"] for c in cells], float), np.array([c["y"] for c in cells], float)
    total, n = float(sum(c["yy"] for c in cells)), int(w.sum())

    def indicators(values: list) -> np.ndarray:
        order = sorted(set(values))
        return np.array([[float(v == o) for o in order[1:]] for v in values]).reshape(len(values), -1)

    a, b, one = indicators([c["s"] for c in cells]), indicators([c["t"] for c in cells]), np.ones((len(cells), 1))

    def rss(*parts: np.ndarray) -> float:
        x = np.hstack([one, *parts])
        beta = np.linalg.pinv(x.T @ (x * w[:, None])) @ (x.T @ y)
        return total - float(beta @ (x.T @ y))

    full = total - float((y * y / w).sum())
    both = rss(a, b)
    terms = {source_bin: rss(b) - both, target_bin: rss(a) - both, f"{source_bin}:{target_bin}": both - full}
    r2 = 1 - full / (total - y.sum() ** 2 / n) if total - y.sum() ** 2 / n > 0 else 0.0
    return rows.sparkSession.createDataFrame([(t, float(s), float(s / (s + full)) if s + full > 0 else 0.0, n, float(r2)) for t, s in terms.items()], schema)
