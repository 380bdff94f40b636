"""Similarity search and the rules on its hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scalars import as_col
from riskweave.operators.search import nearest

__all__ = ["above_threshold", "by_response_model", "nearest", "reranked", "with_defaults"]

# --------------------------------------------------------------------------- hit rules


def above_threshold(hits: DataFrame, threshold: float, fallback: int) -> DataFrame:
    """Hits at or above the threshold; a query without any keeps its best ``fallback``.

    ``hits`` must hold every hit of the threshold and the best ``fallback`` of each query.
    """
    query = Window.partitionBy("query_id")
    passed = (F.col("score") >= threshold).cast("int")
    some = F.max(passed).over(query) == 1
    return (
        hits.withColumn("fallback", (~some).cast("int"))
        .where(
            ((F.col("fallback") == 0) & (F.col("score") >= threshold))
            | ((F.col("fallback") == 1) & (F.col("rank") <= fallback))
        )
    )


def by_response_model(hits: DataFrame, model: str) -> DataFrame:
    """One candidate per (query, model): best score and the hits that activated it."""
    return hits.groupBy("query_id", model).agg(
        F.max("score").alias("score"),
        F.sort_array(
            F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("corpus_id")))
        ).alias("activations"),
    ).withColumn(
        "activations",
        F.transform(
            "activations",
            lambda a: F.struct(a["corpus_id"].alias("corpus_id"), (-a["s"]).alias("score")),
        ),
    )


def with_defaults(
    candidates: DataFrame, model: str, defaults: Sequence[int], keep: int = 4, most: int = 5
) -> DataFrame:
    """The best ``keep`` models per query, then default models not yet present, up to ``most``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), model)
    best = candidates.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= keep
    ).select("query_id", model, "score", "place", F.lit(0).alias("is_default"))
    listed = F.posexplode(F.array(*[F.lit(d) for d in defaults]))
    offered = best.select("query_id").distinct().select("query_id", listed.alias("at", model))
    offered = offered.join(best, ["query_id", model], "left_anti").select(
        "query_id",
        F.col(model).cast(dict(candidates.dtypes)[model]).alias(model),
        F.lit(0.0).alias("score"),
        (F.lit(keep + 1) + F.col("at")).alias("place"),
        F.lit(1).alias("is_default"),
    )
    final = Window.partitionBy("query_id").orderBy("place", model)
    return (
        best.unionByName(offered)
        .withColumn("place", F.row_number().over(final))
        .where(F.col("place") <= most)
    )


def reranked(hits: DataFrame, rerank: str, k: int, tie: str = "corpus_id") -> DataFrame:
    """Top-k by an external score, or by similarity where the external score is missing.

    The fallback holds per query: one missing score means the whole query keeps its
    similarity order.
    """
    query = Window.partitionBy("query_id")
    failed = F.max(as_col(rerank).isNull().cast("int")).over(query) == 1
    used = hits.withColumn("fallback", failed.cast("int")).withColumn(
        "final_score", F.when(failed, F.col("score")).otherwise(as_col(rerank))
    )
    order = query.orderBy(F.desc("final_score"), tie)
    return used.withColumn("final_rank", F.row_number().over(order)).where(
        F.col("final_rank") <= k
    )
