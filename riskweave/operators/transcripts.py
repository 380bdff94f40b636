"""Clean-up of transcripts and language scores over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import text as tx
from riskweave.operators.drift import words
from riskweave.operators.terms import corrected_texts


def cleaned(df: DataFrame, key: str, text: str, glossary: DataFrame | None = None) -> DataFrame:
    """Original and corrected text.

    The order matters: numbers, fillers, repetitions, terms, case, amounts.
    """
    step = df.select(key, F.col(text).alias("original"))
    spoken = tx.smart_repetitions(
        tx.without_filler_variants(tx.without_fillers(tx.number_words_to_digits("original")))
    )
    step = step.withColumn("corrected", spoken)
    if glossary is not None:
        fixed = corrected_texts(step, key, "corrected", glossary).select(key, "corrected")
        step = step.drop("corrected").join(fixed, key)
    return step.withColumn(
        "corrected", tx.normalised_amounts(tx.sentence_case("corrected"))
    )


def language_profile(df: DataFrame, text: str, language: str, target: str) -> DataFrame:
    """Share of each word's occurrences that stand in texts of the target language."""
    return (
        words(df, text, language)
        .groupBy("word")
        .agg(F.avg((F.col(language) == target).cast("double")).alias("weight"))
    )


def language_scores(df: DataFrame, key: str, text: str, profile: DataFrame) -> DataFrame:
    """Mean profile weight of the words of each text; NULL for a text without known words.

    Words are counted per text before they meet the profile, so a frequent word is one row
    per text.
    """
    counted = words(df, text, key).groupBy(key, "word").agg(F.count("*").alias("n"))
    scored = (
        counted.join(profile, "word")
        .groupBy(key)
        .agg((F.sum(F.col("n") * F.col("weight")) / F.sum("n")).alias("score"))
    )
    return df.select(key, text).join(scored, key, "left")
