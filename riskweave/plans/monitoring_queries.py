"""Data quality, drift, performance, rules on runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import drift, evaluation, profiles, quality
from riskweave.plans.registry import query
from riskweave.sources import tables as src
from riskweave.streaming.monitors import EVENT_SCHEMA


def rounded(df, digits=6, *skip):
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.round(c, digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(c)
            for c in df.columns
        ]
    )


# ------------------------------------------------------------------------- data quality


@query(
    "q01_schema_check",
    """WITH f AS (SELECT column_name AS c, CASE column_type WHEN 'VARCHAR' THEN 'string'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp'
  ELSE lower(column_type) END AS a FROM (DESCRIBE events)),
e(c, x) AS (VALUES ('event_id', 'bigint'), ('ts', 'timestamp'), ('user_id', 'bigint'),
  ('event_type', 'string'), ('value', 'double'), ('props', 'string'))
SELECT coalesce(e.c, f.c) AS "column", x AS expected, a AS actual, CASE WHEN a IS NULL THEN 'missing'
  WHEN x IS NULL THEN 'unexpected' WHEN a = x THEN 'ok' ELSE 'wrong_type' END AS state
FROM e FULL JOIN f ON e.c = f.c""",
)
def schema_check(spark, sf):
    return quality.schema_check(spark, EVENT_SCHEMA, src.table(spark, sf, "events").schema)


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(1 - count({c}) / CAST(count(*) AS DOUBLE), 6) AS null_rate,
  count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS DOUBLE) AS minimum,
  CAST(max({c}) AS DOUBLE) AS maximum,
  count(*) FILTER (WHERE abs({c} - m) > 3 * s) AS n_outliers,
  (SELECT round(max(n) / CAST(sum(n) AS DOUBLE), 6) FROM
    (SELECT count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})) AS top_share
FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)"""
    for c in _PROFILED
)


@query("q02_quality_profile", _PROFILE_SQL)
def quality_profile(spark, sf):
    return rounded(
        profiles.quality_profile(src.table(spark, sf, "lineitem"), _PROFILED),
        6,
        "minimum",
        "maximum",
    )


# ------------------------------------------------------------------------------- drift


def _sides(spark, sf):
    """events with the first half of the month as reference; one scan serves both sides."""
    return src.table(spark, sf, "events").select(
        "event_type",
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("ts") < "2024-01-16").cast("int").alias("is_ref"),
    )


_HALVES_SQL = """side AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS is_ref FROM events)"""

_KS_SQL = f"""{_HALVES_SQL}, cell AS (
  SELECT 'value' AS feature, value AS x, is_ref FROM side
  UNION ALL SELECT 'k', k, is_ref FROM side UNION ALL SELECT 'user_id', user_id, is_ref FROM side
), c AS (SELECT feature, x, sum(is_ref) AS r, sum(1 - is_ref) AS q FROM cell GROUP BY ALL),
e AS (SELECT feature, sum(r) OVER w / sum(r) OVER f AS fr, sum(q) OVER w / sum(q) OVER f AS fq,
    sum(r) OVER f AS nr, sum(q) OVER f AS nq FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY x), f AS (PARTITION BY feature)),
d AS (SELECT feature, max(abs(fr - fq)) AS d, max(nr) AS nr, max(nq) AS nq FROM e GROUP BY 1),
t AS (SELECT *, d * sqrt(nr * nq / (nr + nq)) AS t FROM d),
p AS (SELECT *, CASE WHEN t < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
  list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END
    * exp(-2.0 * i * i * t * t))))) END AS p FROM t)"""


@query(
    "q03_ks_drift",
    f"""WITH {_KS_SQL} SELECT feature, round(d, 9) AS statistic, CAST(nr AS BIGINT) AS n_ref,
  CAST(nq AS BIGINT) AS n_cur, round(p, 9) AS p_value, CASE WHEN p < 0.01 THEN 1 ELSE 0 END AS drift
FROM p""",
)
def ks_drift(spark, sf):
    return rounded(
        drift.ks_drift(_sides(spark, sf), ["value", "k", "user_id"]), 9
    )


@query(
    "q04_chi2_drift",
    f"""WITH {_HALVES_SQL}, c AS (SELECT event_type AS x, sum(is_ref) AS r, sum(1 - is_ref) AS q
  FROM side GROUP BY 1), t AS (SELECT sum(r) AS nr, sum(q) AS nq FROM c),
s AS (SELECT sum(power(r - (r + q) * nr / (nr + nq), 2) / ((r + q) * nr / (nr + nq))
  + power(q - (r + q) * nq / (nr + nq), 2) / ((r + q) * nq / (nr + nq))) AS s FROM c, t)
SELECT 'event_type' AS feature, round(s, 9) AS statistic, CAST(4 AS BIGINT) AS dof,
  round(exp(-s / 2) * (1 + s / 2), 9) AS p_value,
  CASE WHEN exp(-s / 2) * (1 + s / 2) < 0.01 THEN 1 ELSE 0 END AS drift FROM s""",
)
def chi2_drift(spark, sf):
    return rounded(drift.chi2_drift(_sides(spark, sf), ["event_type"]), 9)


_PSI_SQL = """r AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_shipdate < DATE '1998-07-01'),
q AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_shipdate >= DATE '1998-07-01'),
e AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM r),
b AS (SELECT len(list_filter(e, lambda y: y < x)) AS bin, 1 AS is_ref FROM r, e
  UNION ALL SELECT len(list_filter(e, lambda y: y < x)), 0 FROM q, e),
c AS (SELECT bin, sum(is_ref) AS n_ref, sum(1 - is_ref) AS n_cur FROM b GROUP BY 1),
s AS (SELECT *, greatest(n_ref / sum(n_ref) OVER (), 0.0001) AS fr,
  greatest(n_cur / sum(n_cur) OVER (), 0.0001) AS fc FROM c)"""


def _price_bins(spark, sf):
    lines = src.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("x"), "l_shipdate"
    )
    cut = F.col("l_shipdate") < "1998-07-01"
    return drift.psi(lines.where(cut), lines.where(~cut), "x")


@query(
    "q05_psi",
    f"""WITH {_PSI_SQL}
SELECT CAST(bin AS INT) AS bin, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
  round((fc - fr) * ln(fc / fr), 9) AS psi FROM s""",
)
def psi(spark, sf):
    return rounded(_price_bins(spark, sf), 9)


@query(
    "q05_psi_total",
    f"""WITH {_PSI_SQL}, t AS (SELECT sum((fc - fr) * ln(fc / fr)) AS psi, count(*) AS n_bins FROM s)
SELECT round(psi, 9) AS psi, n_bins,
  CASE WHEN psi >= 0.0008 THEN 'high' WHEN psi >= 0.0002 THEN 'moderate' ELSE 'none' END AS alert FROM t""",
)
def psi_total(spark, sf):
    return rounded(drift.psi_total(_price_bins(spark, sf), 0.0002, 0.0008), 9)


@query(
    "q06_prediction_drift",
    f"""WITH {_KS_SQL}, m AS (SELECT avg(value) FILTER (WHERE is_ref = 0)
  - avg(value) FILTER (WHERE is_ref = 1) AS mean_shift,
  stddev_pop(value) FILTER (WHERE is_ref = 0) - stddev_pop(value) FILTER (WHERE is_ref = 1)
  AS std_shift FROM side)
SELECT round(d, 6) AS statistic, round(p, 6) AS p_value, CASE WHEN p < 0.01 THEN 1 ELSE 0 END AS drift,
  round(mean_shift, 6) AS mean_shift, round(std_shift, 6) AS std_shift
FROM p, m WHERE feature = 'value'""",
)
def prediction_drift(spark, sf):
    return rounded(drift.prediction_drift(_sides(spark, sf), "value"))


@query(
    "q07_alert_level",
    f"""WITH {_KS_SQL}, n AS (SELECT count(*) FILTER (WHERE p < 0.01) AS n_drifted FROM p)
SELECT n_drifted, CASE WHEN n_drifted > 5 THEN 'red' WHEN n_drifted > 0 THEN 'orange'
  ELSE 'green' END AS level FROM n""",
)
def alert_level(spark, sf):
    return drift.alert_level(ks_drift(spark, sf))


# -------------------------------------------------------------------------- performance


def scored_documents(spark, sf):
    """documents with a label, a score that has ties, and the class it predicts."""
    documents = src.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    p = F.round(1 / (1 + F.exp(-(F.lit(2500) - F.col("n_chars")) / 3000)), 3)
    return documents.join(src.table(spark, sf, "labels"), "doc_id").withColumn("p", p).withColumn(
        "predicted", (F.col("p") >= 0.5).cast("int")
    )


SCORED_SQL = """scored AS (SELECT doc_id, lang, source, n_chars, quality, toxic,
    round(1 / (1 + exp(-(2500 - n_chars) / 3000.0)), 3) AS p FROM documents JOIN labels USING (doc_id)
), s AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scored)"""


def _performance_sql(table: str) -> str:
    return f"""(WITH c AS (SELECT p, sum(quality) AS pos, sum(1 - quality) AS neg FROM {table} GROUP BY 1),
  r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS ap,
    sum(neg) OVER () AS an FROM c WINDOW w AS (ORDER BY p))
  SELECT CAST(sum(pos + neg) AS BIGINT) AS n,
    CAST(sum(pos * (cn - neg + neg / 2.0)) AS DOUBLE) / (max(ap) * max(an)) AS auc,
    max(abs(cp / ap - cn / an)) AS ks,
    sum(pos * power(1 - p, 2) + neg * power(p, 2)) / sum(pos + neg) AS brier,
    -sum(pos * ln(greatest(least(p, 1 - 1e-15), 1e-15))
      + neg * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))) / sum(pos + neg) AS log_loss FROM r)"""


@query(
    "q08_performance",
    f"""WITH {SCORED_SQL} SELECT n, round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini,
  round(ks, 9) AS ks, round(brier, 9) AS brier, round(log_loss, 9) AS log_loss
FROM {_performance_sql('s')}""",
)
def performance(spark, sf):
    return rounded(evaluation.performance(scored_documents(spark, sf), "quality", "p"), 9)


@query(
    "q08_performance_by_language",
    f"""WITH {SCORED_SQL}, pairs AS (SELECT a.lang, avg(CASE WHEN a.p > b.p THEN 1.0
  WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.lang = b.lang
  WHERE a.quality = 1 AND b.quality = 0 GROUP BY 1)
SELECT lang, count(*) AS n, round(max(auc), 9) AS auc FROM s LEFT JOIN pairs USING (lang) GROUP BY 1""",
)
def performance_by_language(spark, sf):
    out = evaluation.performance(scored_documents(spark, sf), "quality", "p", ["lang"])
    return rounded(out.select("lang", "n", "auc"), 9)


@query(
    "q09_degradation",
    f"""WITH {SCORED_SQL}, en AS (SELECT * FROM s WHERE lang = 'en'), other AS (
  SELECT * FROM s WHERE lang <> 'en')
SELECT round(c.auc, 9) AS current_auc, round(r.auc, 9) AS reference_auc,
  round(r.auc - c.auc, 9) AS auc_drop, CASE WHEN r.auc - c.auc > 0.02 THEN 1 ELSE 0 END AS degraded
FROM {_performance_sql('other')} c, {_performance_sql('en')} r""",
)
def degradation(spark, sf):
    rows = scored_documents(spark, sf)
    english = F.col("lang") == "en"
    return rounded(
        evaluation.degradation(rows.where(english), rows.where(~english), "quality", "p"), 9
    )


_REPORT_SQL = """m AS (SELECT quality AS t, predicted AS y, sum({w}) AS w FROM s GROUP BY ALL),
k AS (SELECT t AS class FROM m UNION SELECT y FROM m),
r AS (SELECT class, coalesce((SELECT sum(w) FROM m WHERE t = class), 0) AS support,
  coalesce((SELECT sum(w) FROM m WHERE y = class), 0) AS given,
  coalesce((SELECT sum(w) FROM m WHERE t = class AND y = class), 0) AS hit FROM k),
f AS (SELECT *, coalesce(hit / nullif(given, 0), 0) AS precision,
  coalesce(hit / nullif(support, 0), 0) AS recall FROM r),
g AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM f)"""


@query(
    "q10_confusion",
    f"""WITH {SCORED_SQL} SELECT quality AS truth, predicted, CAST(count(*) AS DOUBLE) AS weight
FROM s GROUP BY ALL""",
)
def confusion(spark, sf):
    return evaluation.confusion(scored_documents(spark, sf), "quality", "predicted")


def _class_report_sql(weight: str) -> str:
    return f"""WITH {SCORED_SQL}, {_REPORT_SQL.format(w=weight)}
SELECT class, CAST(support AS DOUBLE) AS support, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM g"""


@query("q10_class_report", _class_report_sql("1"))
def class_report(spark, sf):
    return rounded(evaluation.class_report(confusion(spark, sf)))


@query("q10_weighted_class_report", _class_report_sql("n_chars"))
def weighted_class_report(spark, sf):
    matrix = evaluation.confusion(
        scored_documents(spark, sf), "quality", "predicted", F.col("n_chars").cast("double")
    )
    return rounded(evaluation.class_report(matrix))


@query(
    "q10_macro_report",
    f"""WITH {SCORED_SQL}, {_REPORT_SQL.format(w=1)}
SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(precision), 6)
  AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM g""",
)
def macro_report(spark, sf):
    return rounded(evaluation.macro_report(evaluation.class_report(confusion(spark, sf))))


@query(
    "q11_calibration",
    f"""WITH {SCORED_SQL} SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n,
  round(avg(p), 6) AS mean_predicted, round(avg(quality), 6) AS observed FROM s GROUP BY 1""",
)
def calibration(spark, sf):
    return rounded(evaluation.calibration(scored_documents(spark, sf), "quality", "p"))


@query(
    "q11_lift",
    f"""WITH {SCORED_SQL}, c AS (SELECT p, count(*) AS n, sum(quality) AS pos FROM s GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY p DESC) AS cn, sum(n) OVER () AS an, sum(pos) OVER () AS ap FROM c)
SELECT CAST(ceil(CAST(cn * 10 AS DOUBLE) / an) AS INT) AS part, CAST(sum(n) AS BIGINT) AS n,
  round(sum(pos) / sum(n), 6) AS rate, round(sum(pos) / sum(n) / (max(ap) / max(an)), 6) AS lift
FROM r GROUP BY 1""",
)
def lift(spark, sf):
    return rounded(evaluation.lift(scored_documents(spark, sf), "quality", "p"))


@query(
    "q12_fairness",
    f"""WITH {SCORED_SQL}, r AS (SELECT lang, count(*) AS n, avg(predicted) AS sr,
  avg(predicted) FILTER (WHERE quality = 1) AS tpr, abs(avg(p) - avg(quality)) AS gap FROM s GROUP BY 1),
b AS (SELECT sr AS bsr, tpr AS btpr FROM r WHERE lang = 'en')
SELECT lang, n, round(sr, 6) AS selection_rate, round(sr / bsr, 6) AS disparate_impact,
  round(tpr - btpr, 6) AS opportunity_difference, round(gap, 6) AS calibration_gap,
  CASE WHEN sr / bsr NOT BETWEEN 0.8 AND 1.25 OR gap >= 0.05 THEN 1 ELSE 0 END AS alert FROM r, b""",
)
def fairness(spark, sf):
    return rounded(
        evaluation.fairness(
            scored_documents(spark, sf), "lang", "quality", "predicted", "p", "en"
        )
    )


@query(
    "q13_prediction_stability",
    """WITH e AS (SELECT vec_id % 5 AS period, label, list_max(list_transform(embedding,
  lambda x: CAST(x AS DOUBLE) * x)) AS conf FROM embeddings),
c AS (SELECT period, label, count(*) AS n, sum(conf) AS c FROM e GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY period) AS a FROM c)
SELECT period, CAST(max(a) AS BIGINT) AS n, count(*) AS n_classes,
  round(sum(-n / a * ln(n / a)), 6) AS entropy, round(sum(c) / max(a), 6) AS mean_confidence
FROM t GROUP BY 1""",
)
def prediction_stability(spark, sf):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    rows = src.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 5).alias("period"), "label", F.array_max(squares).alias("confidence")
    )
    return rounded(evaluation.prediction_stability(rows, "period", "label", "confidence"))


# ---------------------------------------------------------------- text and vector drift

_REFERENCE_SOURCES = [f"src{i}" for i in range(10)]
_REFERENCE_SQL = ", ".join(f"'{s}'" for s in _REFERENCE_SOURCES)


@query(
    "q14_vocabulary_drift",
    rf"""WITH w AS (SELECT source, source IN ({_REFERENCE_SQL}) AS is_ref,
  unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents),
v AS (SELECT DISTINCT word FROM w WHERE is_ref),
c AS (SELECT source, word, count(*) AS n FROM w WHERE NOT is_ref GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_words,
  round(count(*) / sum(n), 6) AS diversity,
  round(coalesce(sum(n) FILTER (WHERE v.word IS NULL), 0) / sum(n), 6) AS oov_rate
FROM c LEFT JOIN v USING (word) GROUP BY source""",
)
def vocabulary_drift(spark, sf):
    documents = src.table(spark, sf, "documents").select("source", "text")
    known = F.col("source").isin(*_REFERENCE_SOURCES)
    return rounded(
        drift.vocabulary_drift(documents.where(known), documents.where(~known), "text", "source")
    )


@query(
    "q14_length_drift",
    f"""WITH side AS (SELECT n_chars AS x, CASE WHEN source IN ({_REFERENCE_SQL}) THEN 1 ELSE 0 END
  AS is_ref FROM documents), c AS (SELECT x, sum(is_ref) AS r, sum(1 - is_ref) AS q FROM side GROUP BY 1),
e AS (SELECT sum(r) OVER (ORDER BY x) / sum(r) OVER () AS fr, sum(q) OVER (ORDER BY x) / sum(q) OVER ()
  AS fq FROM c)
SELECT 'n_chars' AS feature, round(max(abs(fr - fq)), 9) AS statistic FROM e""",
)
def length_drift(spark, sf):
    documents = src.table(spark, sf, "documents").select("source", "n_chars")
    known = F.col("source").isin(*_REFERENCE_SOURCES)
    sides = drift.two_sides(documents.where(known), documents.where(~known))
    return rounded(drift.ks_drift(sides, ["n_chars"]).select("feature", "statistic"), 9)


@query(
    "q15_centroid_drift",
    """WITH x AS (SELECT label, vec_id % 2 AS side, unnest(embedding) AS x,
  unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
m AS (SELECT label, side, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL),
v AS (SELECT label, side, list(m ORDER BY i) AS v FROM m GROUP BY ALL)
SELECT a.label, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance
FROM v a JOIN v b ON a.label = b.label AND a.side = 0 AND b.side = 1""",
)
def centroid_drift(spark, sf):
    rows = src.table(spark, sf, "embeddings")
    even = F.col("vec_id") % 2 == 0
    return rounded(
        drift.centroid_drift(rows.where(even), rows.where(~even), "embedding", ["label"])
    )


# ------------------------------------------------------------------ rules on pipeline runs


def control_runs(spark, sf):
    """documents in the role of transcribed and checked recordings."""
    i, n = F.col("doc_id"), F.col("n_chars")
    share = (i % 101) / 100
    decision = lambda c: F.element_at(
        F.array(F.lit("OUI"), F.lit("NON"), F.lit("NON_CONCERNÉ")), ((i + c) % 3 + 1).cast("int")
    )

    def checkpoint(c: int):
        count = ((i + c) % 4).cast("int")
        flags = F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(3)), lambda j: j <= count),
            lambda j: (i + j * 7 + c) % 9 != 0,
        )
        return F.struct(
            F.lit(f"cp{c}").alias("checkpoint_id"),
            decision(c).alias("decision"),
            count.alias("num_evidences"),
            flags.alias("evidences_grounded"),
        )

    return src.table(spark, sf, "documents").select(
        "doc_id",
        "source",
        (n / 12.0).alias("duration_sec"),
        F.size(F.split("text", " ")).alias("total_word_count"),
        (i * 7 % 45).cast("double").alias("snr_db"),
        share.alias("silence_ratio_ch0"),
        (1 - share).alias("silence_ratio_ch1"),
        ((i % 83) / 100).alias("avg_no_speech_prob"),
        (0.8 + (i % 19) / 10).alias("avg_compression_ratio"),
        F.when(i % 3 == 0, "auto").otherwise("fr").alias("language_setting"),
        F.col("lang").alias("detected_language"),
        F.lit(0.5).alias("stt_preprocessing_time_sec"),
        (n / 12.0 * (i % 13) / 10).alias("stt_inference_time_sec"),
        F.lit(0.25).alias("stt_postprocessing_time_sec"),
        (1 + i % 3).cast("int").alias("num_speakers_detected"),
        F.when(i % 5 != 0, F.lit(2)).alias("num_speakers_expected"),
        F.create_map(F.lit("s0"), share, F.lit("s1"), 1 - share).alias("speaker_time_ratios"),
        (n > 5000).alias("transcript_truncated"),
        F.when(i % 17 == 0, "length").otherwise("stop").alias("llm_finish_reason"),
        (i % 5).cast("int").alias("retry_count"),
        F.when(i % 7 == 0, 1).otherwise(0).alias("num_checkpoints_missing"),
        F.when(i % 29 == 0, "failure").otherwise("success").alias("stt_status"),
        F.when(i % 31 == 0, "failure").otherwise("success").alias("llm_status"),
        (i % 23 != 0).alias("parsing_success"),
        F.array(checkpoint(1), checkpoint(2), checkpoint(3)).alias("checkpoints"),
    )


_RUN_SQL = """run AS (SELECT doc_id, source, doc_id AS i, n_chars / 12.0 AS dur, lang, n_chars,
  len(string_split(text, ' ')) AS words, doc_id * 7 % 45 AS snr, (doc_id % 101) / 100.0 AS sil,
  (doc_id % 83) / 100.0 AS nsp, 0.8 + (doc_id % 19) / 10.0 AS comp FROM documents),
point AS (SELECT doc_id, c, (i + c) % 3 AS dec, (i + c) % 4 AS n_ev,
  list_transform(list_filter([1, 2, 3], lambda j: j <= (i + c) % 4),
    lambda j: (i + j * 7 + c) % 9 <> 0) AS flags
  FROM run, (VALUES (1), (2), (3)) AS t(c)),
ground AS (SELECT doc_id, sum(len(list_filter(flags, lambda f: f))) / nullif(sum(len(flags)), 0) AS g,
  max(CASE WHEN dec < 2 AND n_ev = 0 THEN 1 ELSE 0 END) AS unfounded FROM point GROUP BY 1)"""


@query(
    "q16_transcription_rules",
    f"""WITH {_RUN_SQL} SELECT doc_id, concat_ws(',',
  CASE WHEN nsp > 0.6 AND words > 50 THEN 'silent_hallucination' END,
  CASE WHEN comp > 2.4 THEN 'looping_hallucination' END,
  CASE WHEN words / nullif(dur, 0) * 60 < 40 THEN 'slow_speech' END,
  CASE WHEN words / nullif(dur, 0) * 60 > 280 THEN 'fast_speech' END,
  CASE WHEN sil > 0.95 THEN 'dead_channel_0' END, CASE WHEN 1 - sil > 0.95 THEN 'dead_channel_1' END,
  CASE WHEN snr < 15 THEN 'noisy_audio' END,
  CASE WHEN (0.5 + dur * (i % 13) / 10 + 0.25) / nullif(dur, 0) >= 1 THEN 'slower_than_real_time' END,
  CASE WHEN i % 3 = 0 AND lang <> 'fr' THEN 'unexpected_language' END,
  CASE WHEN i % 5 <> 0 AND 1 + i % 3 <> 2 THEN 'speaker_mismatch' END,
  CASE WHEN greatest(sil, 1 - sil) > 0.95 THEN 'dominant_speaker' END) AS alerts FROM run""",
)
def transcription_rules(spark, sf):
    found = quality.alerts(quality.transcription_rules())
    return control_runs(spark, sf).select("doc_id", F.array_join(found, ",").alias("alerts"))


@query(
    "q17_control_rules",
    f"""WITH {_RUN_SQL} SELECT doc_id, concat_ws(',',
  CASE WHEN n_chars > 5000 THEN 'transcript_truncated' END,
  CASE WHEN i % 17 = 0 THEN 'answer_cut' END, CASE WHEN i % 5 >= 3 THEN 'many_retries' END,
  CASE WHEN i % 7 = 0 THEN 'missing_checkpoints' END,
  CASE WHEN unfounded = 1 THEN 'unfounded_decision' END) AS alerts FROM run JOIN ground USING (doc_id)""",
)
def control_rules(spark, sf):
    found = quality.alerts(quality.control_rules())
    return control_runs(spark, sf).select("doc_id", F.array_join(found, ",").alias("alerts"))


@query(
    "q18_quality_gate",
    f"""WITH {_RUN_SQL} SELECT doc_id, CASE WHEN i % 29 <> 0 AND i % 31 <> 0 THEN 'success'
  WHEN i % 29 <> 0 OR i % 31 <> 0 THEN 'partial_failure' ELSE 'failure' END AS status,
  CAST(i % 29 <> 0 AND i % 31 <> 0 AND n_chars <= 5000 AND i % 23 <> 0 AND i % 7 <> 0
    AND comp <= 2.4 AND snr >= 15 AND coalesce(g, 1) >= 0.9 AS INT) AS passed
FROM run JOIN ground USING (doc_id)""",
)
def quality_gate(spark, sf):
    return control_runs(spark, sf).select(
        "doc_id",
        quality.run_status("stt_status", "llm_status").alias("status"),
        quality.quality_gate().cast("int").alias("passed"),
    )


@query(
    "q19_grounding",
    f"""WITH {_RUN_SQL} SELECT 'cp' || c AS checkpoint_id, count(*) AS n,
  CAST(sum(len(flags)) AS BIGINT) AS n_evidences,
  round(sum(len(list_filter(flags, lambda f: f))) / sum(len(flags)), 6) AS grounding_rate,
  round(avg(CASE WHEN dec < 2 AND n_ev = 0 THEN 1 ELSE 0 END), 6) AS unfounded_rate,
  CASE WHEN sum(len(list_filter(flags, lambda f: f))) / sum(len(flags)) < 0.9 THEN 1 ELSE 0 END AS alert
FROM point GROUP BY c""",
)
def grounding(spark, sf):
    return rounded(quality.grounding_by_checkpoint(control_runs(spark, sf)))


@query(
    "q20_success_targets",
    """WITH k AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n,
  avg(CASE WHEN value < 250 THEN 1 ELSE 0 END) AS r, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1)
SELECT day, n, round(r, 6) AS success_rate, round(median, 6) AS median, round(p95, 6) AS p95,
  CASE WHEN r < 0.995 THEN 1 ELSE 0 END AS below_target FROM k""",
)
def success_targets(spark, sf):
    kpis = profiles.daily_kpis(
        src.table(spark, sf, "events"),
        F.date_format("ts", "yyyy-MM-dd"),
        [],
        F.col("value") < 250,
        "value",
    )
    return rounded(quality.success_targets(kpis, 0.995))


@query(
    "q21_version_change",
    """WITH v AS (SELECT 'v' || CAST(floor((day(ts) - 1) / 7) AS INT) AS version, min(ts) AS f,
  count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS m FROM events GROUP BY 1)
SELECT version, n, round(m, 6) AS metric, round(m - lag(m) OVER (ORDER BY f), 6) AS change FROM v""",
)
def version_change(spark, sf):
    events = src.table(spark, sf, "events").withColumn(
        "version",
        F.concat(F.lit("v"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").cast("string")),
    )
    rate = F.avg((F.col("event_type") == "error").cast("int"))
    out = drift.version_change(events, "version", "ts", rate)
    return rounded(out.drop("first_seen"))


@query(
    "q22_severity",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
  AS ok FROM events GROUP BY 1), p AS (SELECT *, lag(ok) OVER (ORDER BY day) AS before FROM d),
r AS (SELECT day, 100 * (before - ok) / before AS drop_pct FROM p)
SELECT strftime(day, '%Y-%m-%d') AS day, round(drop_pct, 6) AS drop_pct,
  CASE WHEN drop_pct < 2 THEN 'info' WHEN drop_pct <= 5 THEN 'warning'
    WHEN drop_pct <= 10 THEN 'critical' WHEN drop_pct > 10 THEN 'urgent' END AS severity FROM r""",
)
def severity(spark, sf):
    daily = src.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    ok = F.avg((F.col("event_type") != "error").cast("int"))
    out = drift.version_change(daily, "day", "ts", ok)
    before = F.col("metric") - F.col("change")
    drop = 100 * (before - F.col("metric")) / before
    return rounded(
        out.select(
            F.date_format("day", "yyyy-MM-dd").alias("day"),
            drop.alias("drop_pct"),
            drift.degradation_severity(drop).alias("severity"),
        )
    )


@query(
    "q23_sampled_conversations",
    """SELECT conv_id, turn, role FROM conversations
WHERE CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10""",
)
def sampled_conversations(spark, sf):
    """A tenth of the conversations, the same ones on every run."""
    return quality.sampled(src.table(spark, sf, "conversations"), "conv_id", 10).select(
        "conv_id", "turn", "role"
    )


@query(
    "q24_prediction_sanity",
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x) AS v FROM embeddings),
s AS (SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN v[1:60] WHEN 2 THEN list_concat(v[1:63], [-0.5])
  WHEN 3 THEN list_concat(v[1:63], [0.9]) ELSE v END AS v FROM p)
SELECT vec_id, CASE WHEN len(v) <> 64 THEN 'width'
    WHEN len(list_filter(v, lambda x: x < 0 OR x > 1)) > 0 THEN 'out_of_range'
    WHEN abs(list_sum(v) - 1) > 0.001 THEN 'sum' END AS problem,
  greatest(len(v), 64) AS padded_width, round(list_sum(v), 6) AS total FROM s""",
)
def prediction_sanity(spark, sf):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    i = F.col("vec_id") % 5
    rows = src.table(spark, sf, "embeddings").withColumn("p", squares).withColumn(
        "p",
        F.when(i == 1, F.slice("p", 1, 60))
        .when(i == 2, F.concat(F.slice("p", 1, 63), F.array(F.lit(-0.5))))
        .when(i == 3, F.concat(F.slice("p", 1, 63), F.array(F.lit(0.9))))
        .otherwise(F.col("p")),
    )
    filled = quality.padded("p", 64)
    return rows.select(
        "vec_id",
        quality.prediction_problem("p", 64).alias("problem"),
        F.size(filled).cast("long").alias("padded_width"),
        F.round(F.aggregate(filled, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(
    "q25_labelled_scores",
    """SELECT vec_id, 'label_' || i AS label, round(CAST(x AS DOUBLE) * x, 9) AS score FROM (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)""",
)
def labelled_scores(spark, sf):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    listed = quality.labelled_scores(squares, [f"label_{i}" for i in range(64)])
    return rounded(
        src.table(spark, sf, "embeddings").select("vec_id", F.inline(listed)), 9
    )


@query(
    "q26_concept_drift",
    f"""WITH {SCORED_SQL}, x AS (SELECT least(n_chars // 1000, 5) AS bin,
  source IN ({_REFERENCE_SQL}) AS is_ref, quality FROM s),
b AS (SELECT bin, count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur,
  avg(quality) FILTER (WHERE is_ref) AS r, avg(quality) FILTER (WHERE NOT is_ref) AS c FROM x GROUP BY 1)
SELECT bin, n_ref, n_cur, round(n_cur / sum(n_cur) OVER () - n_ref / sum(n_ref) OVER (), 6)
  AS share_change, round(c - r, 6) AS rate_change FROM b""",
)
def concept_drift(spark, sf):
    rows = scored_documents(spark, sf)
    known = F.col("source").isin(*_REFERENCE_SOURCES)
    bins = F.least(F.floor(F.col("n_chars") / 1000), F.lit(5))
    return rounded(drift.concept_drift(rows.where(known), rows.where(~known), bins, "quality"))


@query(
    "q27_quality_regression",
    """SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 9) AS correlation,
  round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1""",
)
def quality_regression(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    return src.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr(y, x), 9).alias("correlation"),
        F.round(F.regr_slope(y, x), 6).alias("slope"),
        F.round(F.regr_intercept(y, x), 4).alias("intercept"),
    )


@query(
    "j15_late_feedback",
    """SELECT d.doc_id, source, quality, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS has_feedback
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def late_feedback(spark, sf):
    return (
        src.table(spark, sf, "documents")
        .select("doc_id", "source")
        .join(src.table(spark, sf, "labels"), "doc_id", "left")
        .select(
            "doc_id", "source", "quality", F.col("quality").isNotNull().cast("int").alias("has_feedback")
        )
    )


@query(
    "j16_aligned_populations",
    f"""WITH {_HALVES_SQL} SELECT event_type, CAST(floor(value / 50) AS BIGINT) AS bin,
  CAST(sum(is_ref) AS BIGINT) AS n_ref, CAST(sum(1 - is_ref) AS BIGINT) AS n_cur
FROM side GROUP BY ALL""",
)
def aligned_populations(spark, sf):
    keys = ["event_type", "bin"]
    binned = _sides(spark, sf).withColumn("bin", F.floor(F.col("value") / 50))
    ref, cur = (
        binned.where(F.col("is_ref") == flag).groupBy(*keys).agg(F.count("*").alias(n))
        for flag, n in ((1, "n_ref"), (0, "n_cur"))
    )
    return ref.join(cur, keys, "full_outer").fillna(0, ["n_ref", "n_cur"])


