"""Training jobs on the labelled documents (rows-only checks: results depend on Spark ML)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import evaluation, isotonic, training
from riskweave.plans.monitoring_queries import SCORED_SQL, rounded, scored_documents
from riskweave.plans.registry import query
from riskweave.sources import tables as src

_NUMERIC = ["n_chars", "n_words", "n_lines", "digit_share"]


def labelled(spark, sf):
    """Documents with a label and a few numeric features."""
    text = F.col("text")
    length = F.greatest(F.length(text), F.lit(1))
    return (
        src.table(spark, sf, "documents")
        .join(src.table(spark, sf, "labels"), "doc_id")
        .select(
            "doc_id",
            "lang",
            "quality",
            F.col("n_chars").cast("double").alias("n_chars"),
            F.size(F.split(text, r"\s+")).cast("double").alias("n_words"),
            F.size(F.split(text, "\n")).cast("double").alias("n_lines"),
            (F.length(F.regexp_replace(text, r"[^0-9]", "")) / length).alias("digit_share"),
        )
    )


@query(
    "m24_one_hot",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS is_f, CAST(o_orderstatus = 'O' AS INT) AS is_o,
  CAST(o_orderstatus = 'P' AS INT) AS is_p FROM orders""",
)
def one_hot(spark, sf):
    """The encoder drops its spare category; the columns are put in alphabetical order."""
    orders = src.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    coded = training.one_hot_vectors(orders, ["o_orderstatus"])
    flags = vector_to_array("o_orderstatus_code")
    index = F.col("o_orderstatus_index").cast("int")
    return coded.select(
        "o_orderkey",
        *[
            F.when(F.col("o_orderstatus") == s, F.get(flags, index)).otherwise(0).cast("int").alias(
                f"is_{s.lower()}"
            )
            for s in ("F", "O", "P")
        ],
    )


@query("m25_tree_importance")
def tree_importance(spark, sf):
    return rounded(training.tree_importance(labelled(spark, sf), "quality", _NUMERIC))


@query("m26_cross_validated_trees")
def cross_validated_trees(spark, sf):
    """AUC of the chosen boosted trees on the rows they were trained on, and over the folds."""
    rows = labelled(spark, sf)
    chosen = training.cross_validated_trees(rows, "quality", "doc_id", _NUMERIC, ["lang"])
    scored = training.probabilities(chosen.bestModel, rows)
    return rounded(
        evaluation.performance(scored, "quality", "p").withColumn(
            "fold_auc", F.lit(float(max(chosen.avgMetrics)))
        )
    )


@query("m26_calibration")
def calibration(spark, sf):
    """Calibration bins after an isotonic map learnt on half of the rows."""
    rows = scored_documents(spark, sf)
    train = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = training.calibrated(rows.where(train), rows.where(~train), "quality", "p")
    return rounded(evaluation.calibration(out, "quality", "calibrated"))


@query(
    "m26_isotonic_fit",
    f"""WITH {SCORED_SQL}, d AS (SELECT p, count(*) AS w, sum(quality) AS y FROM s GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(w) OVER (ORDER BY p) AS cw, sum(y) OVER (ORDER BY p) AS cy FROM d),
mean AS (SELECT a.i AS j, b.i, (b.cy - a.cy + a.y) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS v FROM c a JOIN c b ON a.i <= b.i),
least AS (SELECT j, i, min(v) OVER (PARTITION BY j ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS v FROM mean),
fit AS (SELECT p, max(v) AS v FROM least JOIN c USING (i) GROUP BY 1)
SELECT doc_id, s.p, round(v, 6) AS calibrated FROM s JOIN fit USING (p)""",
)
def isotonic_fit(spark, sf):
    """The monotone map of the score on all labelled rows, by the largest of the least means in SQL."""
    rows = scored_documents(spark, sf).select("doc_id", "p", "quality")
    out = isotonic.applied(isotonic.fitted(rows, "quality", "p"), rows, "p")
    return rounded(out.select("doc_id", "p", "calibrated"))


@query("m26_sigmoid_calibration")
def sigmoid_calibration(spark, sf):
    rows = scored_documents(spark, sf)
    train = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = training.calibrated(rows.where(train), rows.where(~train), "quality", "p", "sigmoid")
    return rounded(evaluation.calibration(out, "quality", "calibrated"))


@query(
    "m26_class_weights",
    """SELECT doc_id, quality, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY quality)), 6) AS weight
FROM documents JOIN labels USING (doc_id)""",
)
def class_weights(spark, sf):
    return rounded(
        training.class_weights(labelled(spark, sf).select("doc_id", "quality"), "quality")
    )
