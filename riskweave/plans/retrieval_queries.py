"""Similarity search over the embeddings and the rules on its hits.

Every vector is a query against all the others; its label plays the response model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import evaluation, retrieval
from riskweave.plans.monitoring_queries import SCORED_SQL, rounded, scored_documents
from riskweave.plans.registry import query
from riskweave.sources import tables as src

TOP = 10


THRESHOLD, FALLBACK = 0.45, 3


def hits(spark, sf, k=TOP, at_least=None):
    vectors = src.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(
        vectors, vectors, "vec_id", "embedding", k, skip_self=True, at_least=at_least
    )


def labelled_hits(spark, sf):
    labels = src.table(spark, sf, "embeddings")
    return hits(spark, sf).join(
        labels.select(F.col("vec_id").alias("corpus_id"), F.col("label").alias("model")), "corpus_id"
    )


_HITS_SQL = f"""pair AS (SELECT a.vec_id AS query_id, b.vec_id AS corpus_id, b.label AS model,
    a.label AS query_label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
    CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id)
  AS rank FROM pair) WHERE rank <= {TOP})"""


@query(
    "j13_r01_o04_nearest",
    f"WITH {_HITS_SQL} SELECT query_id, corpus_id, score, CAST(rank AS INT) AS rank FROM hit",
)
def nearest(spark, sf):
    return hits(spark, sf)


_KEPT_SQL = """judged AS (SELECT *, max(CASE WHEN score >= 0.45 THEN 1 ELSE 0 END)
    OVER (PARTITION BY query_id) AS found FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM pair)),
kept AS (SELECT *, 1 - found AS fallback FROM judged
  WHERE (found = 1 AND score >= 0.45) OR (found = 0 AND rank <= 3))"""


@query(
    "r02_threshold_fallback",
    f"""WITH {_HITS_SQL}, {_KEPT_SQL} SELECT query_id, corpus_id, score, CAST(rank AS INT) AS rank, fallback
FROM kept""",
)
def threshold_fallback(spark, sf):
    return retrieval.above_threshold(hits(spark, sf, FALLBACK, THRESHOLD), THRESHOLD, FALLBACK)


@query(
    "r03_response_models",
    f"""WITH {_HITS_SQL} SELECT query_id, model, max(score) AS score,
  string_agg(corpus_id, ',' ORDER BY score DESC, corpus_id) AS activations FROM hit GROUP BY ALL""",
)
def response_models(spark, sf):
    grouped = retrieval.by_response_model(labelled_hits(spark, sf), "model")
    ids = F.transform("activations", lambda a: a["corpus_id"].cast("string"))
    return grouped.withColumn("activations", F.array_join(ids, ","))


@query(
    "r04_with_defaults",
    f"""WITH {_HITS_SQL}, m AS (SELECT query_id, model, max(score) AS score FROM hit GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, model)
  AS place FROM m) WHERE place <= 4),
d AS (SELECT query_id, model, 0.0 AS score, place FROM (SELECT DISTINCT query_id FROM b),
  (VALUES (1, 5), (2, 6)) AS t(model, place) WHERE (query_id, model) NOT IN (SELECT query_id, model FROM b)),
u AS (SELECT query_id, model, score, place, 0 AS is_default FROM b
  UNION ALL SELECT query_id, model, score, place, 1 FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, model) AS p FROM u)
SELECT query_id, model, CAST(score AS DOUBLE) AS score, CAST(p AS INT) AS place, is_default FROM f WHERE p <= 5""",
)
def with_defaults(spark, sf):
    grouped = retrieval.by_response_model(labelled_hits(spark, sf), "model")
    return retrieval.with_defaults(grouped, "model", [1, 2])


@query(
    "r05_reranked",
    f"""WITH {_HITS_SQL}, e AS (SELECT *, CASE WHEN corpus_id % 97 = 0 THEN NULL
    ELSE (corpus_id * 7919 % 1000) / 1000.0 END AS external FROM hit),
f AS (SELECT *, max(CASE WHEN external IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS fallback FROM e),
u AS (SELECT *, CASE WHEN fallback = 1 THEN score ELSE external END AS final_score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, corpus_id) AS fr FROM u)
SELECT query_id, corpus_id, CAST(final_score AS DOUBLE) AS final_score, fallback,
  CAST(fr AS INT) AS final_rank FROM r WHERE fr <= 5""",
)
def reranked(spark, sf):
    external = F.when(
        F.col("corpus_id") % 97 != 0, (F.col("corpus_id") * 7919 % 1000) / 1000
    )
    rows = hits(spark, sf).withColumn("external", external)
    return retrieval.reranked(rows, "external", 5).select(
        "query_id", "corpus_id", "final_score", "fallback", "final_rank"
    )


@query(
    "r06_ranking_metrics",
    f"""WITH {_HITS_SQL}, q AS (SELECT query_id, min(CASE WHEN model = query_label THEN rank END) AS first,
  sum(CASE WHEN model = query_label THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
  count(*) FILTER (WHERE model = query_label AND rank <= 1) AS n1,
  count(*) FILTER (WHERE model = query_label AND rank <= 3) AS n3,
  count(*) FILTER (WHERE model = query_label AND rank <= 5) AS n5 FROM hit GROUP BY 1),
t AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings),
g AS (SELECT q.*, t.n, CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(CAST(n AS BIGINT), {TOP}) + 1),
  lambda k: 1 / log2(k + 1))) ELSE 0 END AS ndcg FROM q JOIN t USING (query_id))
SELECT count(*) AS n_queries, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 6) AS hit_1,
  round(avg(CASE WHEN first <= 3 THEN 1 ELSE 0 END), 6) AS hit_3,
  round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 6) AS hit_5,
  round(avg(CASE WHEN n > 0 THEN n1 / n END), 6) AS recall_1,
  round(avg(CASE WHEN n > 0 THEN n3 / n END), 6) AS recall_3,
  round(avg(CASE WHEN n > 0 THEN n5 / n END), 6) AS recall_5,
  round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM g""",
)
def ranking_metrics(spark, sf):
    """Every other vector of the query's label is relevant, found or not."""
    vectors = src.table(spark, sf, "embeddings")
    same = vectors.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    labels = vectors.join(same, "label").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), "n_relevant"
    )
    judged = (
        labelled_hits(spark, sf)
        .join(labels, "query_id")
        .withColumn("relevant", (F.col("model") == F.col("query_label")).cast("int"))
    )
    return rounded(
        evaluation.ranking_metrics(judged, "query_id", "rank", "relevant", "n_relevant", TOP)
    )


@query(
    "r07_threshold_curve",
    f"""WITH {SCORED_SQL}, c AS (SELECT round(p * 100, 1) AS score, count(*) AS n, sum(quality) AS pos FROM s GROUP BY 1)
SELECT score, CAST(sum(n) OVER w AS BIGINT) AS accepted, round(sum(pos) OVER w / sum(n) OVER w, 6) AS precision,
  round(sum(pos) OVER w / sum(pos) OVER (), 6) AS recall, CASE WHEN score >= 60 THEN 1 ELSE 0 END AS is_kept
FROM c WINDOW w AS (ORDER BY score DESC)""",
)
def threshold_curve(spark, sf):
    rows = scored_documents(spark, sf).withColumn("confidence", F.round(F.col("p") * 100, 1))
    curve = evaluation.threshold_curve(rows, "quality", "confidence")
    return rounded(curve, 6, "score").withColumn(
        "is_kept", (F.col("score") >= 60).cast("int")
    )
