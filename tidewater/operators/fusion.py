"""Reciprocal-rank fusion, candidate tables and ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import ABSENT_RANK, ABSENT_SCORE, CANDIDATE_BUDGET, RRF_K
from ..functions.scalars import ranked


def _rrf(weights: dict[str, float] | None, counted=None):
    weight = F.lit(1.0)
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source") == source, float(w)).otherwise(weight)
    part = weight / (RRF_K + F.col("rank"))
    return F.round(F.sum(part if counted is None else F.when(counted, part)), 12)


def fuse(long: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """customer_key, article_id, rrf_score, cand_rank. Equal scores (to 12 places) go by article."""
    fused = long.groupBy("customer_key", "article_id").agg(_rrf(weights).alias("rrf_score"))
    return fused.withColumn("cand_rank", ranked("customer_key", F.desc("rrf_score"), F.asc("article_id")).cast("long"))


def build_candidates(generated: DataFrame, sources: list[str], n_candidates: int = CANDIDATE_BUDGET, annotated: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One pass: fusion, the number of sources, and a rank and a score for each source. Rows of
    ``annotated`` describe candidates, but neither propose them nor count in the fusion."""
    rows = generated.withColumn("_by", F.lit(True))
    if annotated is not None:
        rows = rows.unionByName(annotated.withColumn("_by", F.lit(False)))
    pivot = [F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{c}_{s}") for s in sources for c in ("rank", "score")]
    wide = rows.groupBy("customer_key", "article_id").agg(_rrf(weights, F.col("_by")).alias("rrf_score"), F.countDistinct("source").alias("n_sources"), *pivot).filter(F.col("rrf_score").isNotNull())
    cut = wide.withColumn("cand_rank", ranked("customer_key", F.desc("rrf_score"), F.asc("article_id")).cast("long")).filter(F.col("cand_rank") <= n_candidates)
    return cut.fillna(ABSENT_RANK, [f"rank_{s}" for s in sources]).fillna(ABSENT_SCORE, [f"score_{s}" for s in sources])


def candidate_lists(fused: DataFrame, k: int) -> DataFrame:
    """customer_key, articles in order."""
    ordered = F.sort_array(F.collect_list(F.struct("cand_rank", "article_id")))
    return fused.filter(F.col("cand_rank") <= k).groupBy("customer_key").agg(F.transform(ordered, lambda x: x["article_id"]).alias("articles"))


def attribution(candidates: DataFrame, sources: list[str]) -> DataFrame:
    """Adds ``sources``: those that proposed the candidate, in the given order."""
    named = F.array(*[F.when(F.col(f"rank_{s}") != ABSENT_RANK, s) for s in sources])
    return candidates.withColumn("sources", F.array_compact(named))
