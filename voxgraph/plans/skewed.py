"""Problem 4: keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.skew import key_profile
from ..sources.tables import table


def p4_source_profile(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "enriched_edges", "source_id", "target_id", "n_words", "tone", "clout")
    return key_profile(edges, "source_id", "target_id", {"n_words": (0.5, 0.9), "tone": (0.25, 0.5), "clout": (0.5,)}).withColumnRenamed("key", "source_id")


def p4_target_profile(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "enriched_edges", "target_id", "source_id", "source_age", "conflict")
    return key_profile(edges, "target_id", "source_id", {"source_age": (0.5,), "conflict": (0.5, 0.99)}).withColumnRenamed("key", "target_id")


def p4_speaker_profile(spark: SparkSession, folder: str) -> DataFrame:
    quotes = table(spark, folder, "quote_candidates", "speaker_qid", "article_id", "speaker_probability")
    return key_profile(quotes, "speaker_qid", "article_id", {"speaker_probability": (0.1, 0.5)}).withColumnRenamed("key", "speaker_qid")


def _profile_sql(name: str, key: str, category: str, measures: dict[str, tuple[float, ...]]) -> str:
    picks = ", ".join(f"quantile_disc({m}, {q})::double as {m}_p{round(q * 100)}" for m, qs in measures.items() for q in qs)
    return f"""
        with c as (select {key} k, {category} v, count(*) n from {name} group by 1, 2),
        m as (select k, v, n from c where v is not null qualify row_number() over (partition by k order by n desc, v) = 1),
        s as (select {key} k, count(*) as rows, count({category}) as nonnull, count(distinct {category}) as distinct_values, {picks} from {name} group by 1)
        select s.k as {key}, s.* exclude (k), m.v as mode, coalesce(m.n, 0) as mode_count from s left join m on s.k is not distinct from m.k"""


QUERIES = {f.__name__: f for f in (p4_source_profile, p4_target_profile, p4_speaker_profile)}
SQL = {
    "p4_source_profile": _profile_sql("enriched_edges", "source_id", "target_id", {"n_words": (0.5, 0.9), "tone": (0.25, 0.5), "clout": (0.5,)}),
    "p4_target_profile": _profile_sql("enriched_edges", "target_id", "source_id", {"source_age": (0.5,), "conflict": (0.5, 0.99)}),
    "p4_speaker_profile": _profile_sql("quote_candidates", "speaker_qid", "article_id", {"speaker_probability": (0.1, 0.5)}),
}
