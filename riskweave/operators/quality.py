"""Schema checks, rule tables and gates on transcription and control runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave import rules
from riskweave.functions.scalars import as_col, largest_value, ratio, share_true, tags


def schema_check(spark: SparkSession, expected: StructType, actual: StructType) -> DataFrame:
    """One row per expected or unexpected column with its state; reads no data."""
    have = {f.name: f.dataType.simpleString() for f in actual.fields}
    rows = []
    for field in expected.fields:
        want = field.dataType.simpleString()
        found = have.get(field.name)
        state = "missing" if found is None else "ok" if found == want else "wrong_type"
        rows.append((field.name, want, found, state))
    for name, found in have.items():
        if name not in expected.fieldNames():
            rows.append((name, None, found, "unexpected"))
    return spark.createDataFrame(
        rows, "column string, expected string, actual string, state string"
    )


# Rule tables: name -> condition on the columns of a run.


def transcription_rules() -> list[tuple[str, Column]]:
    words, seconds = F.col("total_word_count"), F.col("duration_sec")
    pace = ratio(words, seconds) * 60
    spent = (
        F.col("stt_preprocessing_time_sec")
        + F.col("stt_inference_time_sec")
        + F.col("stt_postprocessing_time_sec")
    )
    return [
        ("silent_hallucination", (F.col("avg_no_speech_prob") > 0.6) & (words > 50)),
        ("looping_hallucination", F.col("avg_compression_ratio") > 2.4),
        ("slow_speech", pace < 40),
        ("fast_speech", pace > 280),
        ("dead_channel_0", F.col("silence_ratio_ch0") > 0.95),
        ("dead_channel_1", F.col("silence_ratio_ch1") > 0.95),
        ("noisy_audio", F.col("snr_db") < 15),
        ("slower_than_real_time", ratio(spent, seconds) >= 1),
        (
            "unexpected_language",
            (F.col("language_setting") == "auto") & (F.col("detected_language") != "fr"),
        ),
        (
            "speaker_mismatch",
            F.col("num_speakers_expected").isNotNull()
            & (F.col("num_speakers_detected") != F.col("num_speakers_expected")),
        ),
        ("dominant_speaker", largest_value("speaker_time_ratios") > 0.95),
    ]


def control_rules() -> list[tuple[str, Column]]:
    unfounded = F.exists(
        "checkpoints",
        lambda c: c["decision"].isin("OUI", "NON") & (c["num_evidences"] == 0),
    )
    return [
        ("transcript_truncated", F.col("transcript_truncated")),
        ("answer_cut", F.col("llm_finish_reason") == "length"),
        ("many_retries", F.col("retry_count") >= 3),
        ("missing_checkpoints", F.col("num_checkpoints_missing") > 0),
        ("unfounded_decision", unfounded),
    ]


def alerts(rule_table: list[tuple[str, Column]]) -> Column:
    return tags(*[(test, name) for name, test in rule_table])


def run_status(first: Column | str, second: Column | str) -> Column:
    first, second = as_col(first) == "success", as_col(second) == "success"
    return (
        F.when(first & second, "success")
        .when(first | second, "partial_failure")
        .otherwise("failure")
    )


def grounding(checkpoints: Column | str) -> Column:
    """Share of evidences of all checkpoints found in the transcript."""
    every = F.flatten(F.transform(as_col(checkpoints), lambda c: c["evidences_grounded"]))
    return share_true(every)


def quality_gate() -> Column:
    """True when both steps succeeded and nothing makes the result unreliable."""
    return (
        (run_status("stt_status", "llm_status") == "success")
        & ~F.col("transcript_truncated")
        & F.col("parsing_success")
        & (F.col("num_checkpoints_missing") == 0)
        & (F.col("avg_compression_ratio") <= 2.4)
        & (F.col("snr_db") >= 15)
        & (F.coalesce(grounding("checkpoints"), F.lit(1.0)) >= rules.GROUNDING_TARGET)
    )


def grounding_by_checkpoint(runs: DataFrame) -> DataFrame:
    """Grounding rate and rate of unfounded decisions per checkpoint, with the alert."""
    c = F.col("c")
    flags = F.filter(c["evidences_grounded"], lambda f: f)
    decided = c["decision"].isin("OUI", "NON")
    return (
        runs.select(F.explode("checkpoints").alias("c"))
        .groupBy(c["checkpoint_id"].alias("checkpoint_id"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.size(c["evidences_grounded"])).alias("n_evidences"),
            F.try_divide(
                F.sum(F.size(flags)).cast("double"), F.sum(F.size(c["evidences_grounded"]))
            ).alias("grounding_rate"),
            F.avg((decided & (c["num_evidences"] == 0)).cast("double")).alias("unfounded_rate"),
        )
        .withColumn(
            "alert",
            (F.col("grounding_rate") < rules.GROUNDING_TARGET).cast("int"),
        )
    )


def success_targets(kpis: DataFrame, target: float) -> DataFrame:
    return kpis.withColumn("below_target", (F.col("success_rate") < target).cast("int"))


# ------------------------------------------------------------------- prediction sanity


def prediction_problem(values: Column | str, width: int, tolerance: float = 1e-3) -> Column:
    """First problem of a probability vector, or NULL."""
    v = as_col(values)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    outside = ~F.forall(v, lambda x: x.between(0, 1))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return (
        F.when(v.isNull() | (F.size(v) != width), "width")
        .when(broken, "not_finite")
        .when(outside, "out_of_range")
        .when(F.abs(total - 1) > tolerance, "sum")
    )


def padded(values: Column | str, width: int) -> Column:
    """Vector filled up with zeros; a vector that is long enough stays as it is."""
    v = as_col(values)
    missing = F.greatest(F.lit(width) - F.size(v), F.lit(0))
    return F.concat(v, F.array_repeat(F.lit(0.0), missing))


def labelled_scores(values: Column | str, labels: list[str]) -> Column:
    """Array of (label, score), one per label."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.zip_with(
        names, as_col(values), lambda n, s: F.struct(n.alias("label"), s.alias("score"))
    )


def sampled(df: DataFrame, key: str, percent: int) -> DataFrame:
    """The same ``percent`` of keys on every run and in every engine, by the key's MD5."""
    head = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.where(head % 100 < percent)
