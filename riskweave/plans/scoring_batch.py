"""The monthly scoring batch as one lazy plan with counted steps."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.operators import scope, scoring
from riskweave.operators import statements as st
from riskweave.operators.movements import add_transaction_features
from riskweave.session import written

KEY = "enterprise_id"
#: Letters of an error message that a step report keeps.
MESSAGE_LETTERS = 500
Step = tuple[str, Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class ScoringInputs:
    """The tables of one run; every one but ``scope`` and ``sectors`` is keyed by enterprise.

    The statement details hold ``closing``, ``code`` and ``value``; ``closings`` has a row per
    enterprise and closing with the declared ``months`` and the tax ``regime``, either of them null
    where unknown.
    """

    scope: DataFrame
    sectors: DataFrame
    overdrafts: DataFrame
    accounts: DataFrame
    ratings: DataFrame
    category_totals: DataFrame
    conso_detail: DataFrame
    solo_detail: DataFrame
    closings: DataFrame


CONSO_CODES = (*rules.CONSO_RESULT, "24", "309")
SOLO_CODES = tuple(dict.fromkeys([*rules.CASH_FLOW_REGIME_1, *rules.CASH_FLOW_REGIME_2]))
RATING_GROUP = (KEY, "day", "status", "priority")


def scoring_steps(
    inputs: ScoringInputs, debt_service: Column, result: Column, assets: Column, total: Column
) -> list[Step]:
    """Named steps from the scope to the scored table.

    The four columns name the parts of the solo ratios; they may use any ``mt_`` column of
    the solo codes.
    """

    def newest(detail: DataFrame, codes: Sequence[str]) -> DataFrame:
        """The newest statement of each enterprise with its length in months and its regime."""
        wide = st.wide_statement(detail, [KEY, "closing"], "code", "value", codes)
        wide = st.latest_rows(wide, KEY, [F.desc("closing")])
        before = st.previous_closing(inputs.closings, KEY, "closing")
        heads = inputs.closings.join(before, [KEY, "closing"]).select(
            KEY,
            "closing",
            st.exercise_length(inputs.closings, "months", "closing", "previous_closing").alias("months"),
            "regime",
        )
        found = wide.join(heads, [KEY, "closing"], "left")
        months = F.coalesce("months", F.lit(float(rules.EXERCISE_MONTHS)))
        return found.withColumn("months", months).withColumn(
            "regime", st.imputed_tax_regime("regime", "rank")
        )

    def conso(df: DataFrame) -> DataFrame:
        made = st.conso_ratios(newest(inputs.conso_detail, CONSO_CODES), "months")
        return scoring.enriched(df, made.select(KEY, "VB023"), KEY)

    def solo(df: DataFrame) -> DataFrame:
        wide = newest(inputs.solo_detail, SOLO_CODES)
        made = st.solo_ratios(wide, "regime", "months", debt_service, result, assets, total)
        return scoring.enriched(df, made.select(KEY, "VB005", "VB035", "VB055"), KEY)

    def encoded(df: DataFrame) -> DataFrame:
        df = df.withColumn("legal_form_class", scoring.legal_form_class("legal_form"))
        df = df.withColumn("top_ga", scoring.group_flag("group_id"))
        return scoring.add_sector_class(df, "sector_code", inputs.sectors)

    def formatted(df: DataFrame) -> DataFrame:
        made = scoring.score_variables()
        kept = [c for c in df.columns if c not in made]
        flags = ("remb_sepa_max", "pres_prlv_retourne", "pres_saisie", "net_int_turnover")
        # An enterprise without movements has no flag yet: it counts as "2".
        df = df.select(*kept, *[c.alias(n) for n, c in made.items()])
        return df.fillna("2", list(flags))

    return [
        ("encoding", encoded),
        ("risk", lambda d: scoring.add_risk_features(d, inputs.overdrafts, KEY, "days")),
        (
            "balances",
            lambda d: scoring.add_balance_features(d, inputs.accounts, KEY, "account_id", "cents"),
        ),
        (
            "rating",
            lambda d: scoring.add_rating_features(
                d, inputs.ratings, KEY, "day", RATING_GROUP, "q_score"
            ),
        ),
        (
            "transactions",
            lambda d: add_transaction_features(d, inputs.category_totals, KEY),
        ),
        ("consolidated_statements", conso),
        ("solo_statements", solo),
        ("eligibility", scope.eligible),
        ("format", formatted),
        ("score", scoring.add_score),
        (
            "output",
            lambda d: d.select(KEY, *rules.SCORE_VARIABLES, "sum_total_coeffs", "PDO_compute", "PDO"),
        ),
    ]


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for _, step in steps:
        df = step(df)
    return df


def apply_counted(df: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, list[Observation]]:
    """The same plan with a row count after every step.

    The counts ride along with the one action of the run; nothing is counted separately.
    """
    seen = [Observation("load")]
    df = df.observe(seen[0], F.count(F.lit(1)).alias("n"))
    for name, step in steps:
        watch = Observation(name)
        df = step(df).observe(watch, F.count(F.lit(1)).alias("n"))
        seen.append(watch)
    return df, seen


def step_counts(spark, steps: Sequence[Step], seen: Sequence[Observation]) -> DataFrame:
    """Rows in and out per step once the action has run; one row per step."""
    counts = [watch.get["n"] for watch in seen]
    rows = [("load", 0, counts[0], counts[0], "OK")]
    for i, (name, _) in enumerate(steps, 1):
        status = "OK" if counts[i] else "EMPTY"
        rows.append((name, i, counts[i - 1], counts[i], status))
    return spark.createDataFrame(
        rows, "step string, position int, rows_in long, rows_out long, status string"
    )


def apply_timed(
    df: DataFrame, steps: Sequence[Step], run_id: str
) -> tuple[DataFrame | None, DataFrame]:
    """Run the steps one after the other and report each one's rows, seconds and status.

    Every step's table is written to the shared folder, so its time is its own and a later step
    starts from it. A step that fails is FAILED with its message, those after it are SKIPPED, and
    the result is None; a step without rows is EMPTY.
    """
    rows: list[tuple] = []
    out: DataFrame | None = df
    before = 0
    for position, (name, step) in enumerate([("load", lambda d: d), *steps]):
        if out is None:
            rows.append((run_id, name, position, None, None, "SKIPPED", None, None))
            continue
        begun = time.perf_counter()
        try:
            out = written(step(out), f"step-{name}")
            n = out.count()
        except Exception as error:  # reported, not hidden: the run ends here
            seconds, out = time.perf_counter() - begun, None
            rows.append((run_id, name, position, before, None, "FAILED", seconds, str(error)[:MESSAGE_LETTERS]))
            continue
        seconds = time.perf_counter() - begun
        rows.append((run_id, name, position, before if position else n, n, "OK" if n else "EMPTY", seconds, None))
        before = n
    report = df.sparkSession.createDataFrame(
        rows,
        "run_id string, step string, position int, rows_in long, rows_out long, status string, seconds double, message string",
    )
    return out, report
