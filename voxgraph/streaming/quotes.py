"""Streaming forms, an extension: per-article operators run unchanged on streams; counts need event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outlets_over_time(quotes: DataFrame, time: str, quote: str, domain: str, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """(start, quote, n_outlets) per event-time window: late rows within the delay count, later ones are dropped; repeated (quote, domain) once, approximately counted."""
    seen = quotes.withWatermark(time, delay)
    return seen.groupBy(F.window(time, window).alias("w"), quote).agg(F.approx_count_distinct(domain).alias("n_outlets")).select(F.col("w.start").alias("start"), quote, "n_outlets")


def new_quotations(quotes: DataFrame, time: str, quote: str, delay: str = "7 days") -> DataFrame:
    """Each quotation id once within the delay: repeated loads of a quotation are dropped, with state bounded by the watermark."""
    return quotes.withWatermark(time, delay).dropDuplicatesWithinWatermark([quote])


def self_quotation_free(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The stateless part of the self-quotation rule: rows that quote the speaker themself. Whole groups need the batch form."""
    return edges.where(~F.col(source).eqNullSafe(F.col(target)))
