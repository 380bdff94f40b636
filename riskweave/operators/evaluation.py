"""Model, transcript and ranking evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions import stats
from riskweave.functions.scalars import as_col
from riskweave.functions.text import evaluation_form
from riskweave.operators.ordered import chains, running_totals
from riskweave.operators.terms import blank_separated

# ---------------------------------------------------------------------- classification


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(1 - F.col(label).cast("long")).alias("neg"),
    )


def performance(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC with ties, Gini, KS, Brier score and log loss.

    Everything is computed on one row per distinct score, so ties cost nothing and the
    order is spread over value ranges.
    """
    ranked = running_totals(score_counts(df, label, score, by), "score", ["pos", "neg"], by)
    p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-15)), F.lit(1e-15))
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    pairs = F.max("all_pos") * F.max("all_neg")
    n = F.sum(F.col("pos") + F.col("neg"))
    error = F.col("pos") * F.pow(1 - F.col("score"), 2) + F.col("neg") * F.pow(F.col("score"), 2)
    found = ranked.groupBy(*by).agg(
        n.alias("n"),
        F.try_divide(F.sum(F.col("pos") * below), pairs).alias("auc"),
        F.max(
            F.abs(
                F.try_divide("cum_pos", "all_pos") - F.try_divide("cum_neg", "all_neg")
            )
        ).alias("ks"),
        (F.sum(error) / n).alias("brier"),
        (-F.sum(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p)) / n).alias("log_loss"),
    )
    return found.select(
        *by, "n", "auc", (2 * F.col("auc") - 1).alias("gini"), "ks", "brier", "log_loss"
    )


def degradation(reference: DataFrame, current: DataFrame, label: str, score: str) -> DataFrame:
    """Drop of the AUC from reference to current, with the alert."""
    ref = performance(reference, label, score).select("auc").scalar()
    drop = F.col("reference_auc") - F.col("auc")
    return (
        performance(current, label, score)
        .withColumn("reference_auc", ref)
        .select(
            F.col("auc").alias("current_auc"),
            "reference_auc",
            drop.alias("auc_drop"),
            (drop > rules.AUC_DROP).cast("int").alias("degraded"),
        )
    )


def confusion(df: DataFrame, truth: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """Weight per (true, predicted) class; the default weight is one per row."""
    weight = F.lit(1.0) if weight is None else weight
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.sum(weight).alias("weight")
    )


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("weight")).otherwise(0.0)
    sides = F.inline(
        F.array(
            F.struct(
                F.col("truth").alias("class"), F.col("weight").alias("actual"),
                F.lit(0.0).alias("given"), hit.alias("hit"),
            ),
            F.struct(
                F.col("predicted").alias("class"), F.lit(0.0).alias("actual"),
                F.col("weight").alias("given"), F.lit(0.0).alias("hit"),
            ),
        )
    )
    sums = matrix.select(sides).groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("given").alias("given"), F.sum("hit").alias("hit")
    )
    precision = F.coalesce(F.try_divide("hit", "given"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return (
        sums.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"),
                    F.col("precision") + F.col("recall"),
                ),
                F.lit(0.0),
            ),
        )
        .select("class", "support", "precision", "recall", "f1")
    )


def macro_report(report: DataFrame) -> DataFrame:
    """Accuracy, macro precision, recall and F1 over all classes of a class report."""
    return report.agg(
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def calibration(df: DataFrame, label: str, score: str, n_bins: int = 10) -> DataFrame:
    """Mean predicted and observed rate per equal-width score bin."""
    slot = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(slot.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("observed"),
    )


def lift(df: DataFrame, label: str, score: str, parts: int = 10) -> DataFrame:
    """Positive rate per part of the rows ordered by falling score, against the mean rate.

    Rows of one score stay together, in the part their last row falls into.
    """
    ranked = running_totals(
        score_counts(df, label, score)
        .withColumn("falling", -F.col("score"))
        .withColumn("n", F.col("pos") + F.col("neg")),
        "falling",
        ["n", "pos"],
    )
    part = F.ceil(F.col("cum_n") * parts / F.col("all_n")).cast("int")
    rate = F.sum("pos") / F.sum("n")
    return ranked.groupBy(part.alias("part")).agg(
        F.sum("n").alias("n"),
        rate.alias("rate"),
        (rate / (F.max("all_pos") / F.max("all_n"))).alias("lift"),
    )


def threshold_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall of accepting every score at or above each distinct score."""
    ranked = running_totals(
        score_counts(df, label, score)
        .withColumn("falling", -F.col("score"))
        .withColumn("n", F.col("pos") + F.col("neg")),
        "falling",
        ["n", "pos"],
    )
    return ranked.select(
        "score",
        F.col("cum_n").alias("accepted"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        F.try_divide("cum_pos", "all_pos").alias("recall"),
    )


def fairness(
    df: DataFrame, group: str, label: str, predicted: str, score: str, reference: str
) -> DataFrame:
    """Per group against a reference group: selection ratio, recall gap, calibration gap."""
    yes = F.col(predicted) == 1
    rates = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(yes.cast("double")).alias("selection_rate"),
        F.avg(F.when(F.col(label) == 1, yes.cast("double"))).alias("true_positive_rate"),
        F.abs(F.avg(score) - F.avg(F.col(label).cast("double"))).alias("calibration_gap"),
    )
    base = rates.where(F.col(group) == reference).select(
        F.struct("selection_rate", "true_positive_rate").alias("base")
    )
    low, high = rules.DISPARATE_IMPACT
    impact = F.try_divide(F.col("selection_rate"), F.col("base.selection_rate"))
    return rates.withColumn("base", base.scalar()).select(
        group,
        "n",
        "selection_rate",
        impact.alias("disparate_impact"),
        (F.col("true_positive_rate") - F.col("base.true_positive_rate")).alias(
            "opportunity_difference"
        ),
        "calibration_gap",
        (~impact.between(low, high) | (F.col("calibration_gap") >= rules.CALIBRATION_GAP))
        .cast("int")
        .alias("alert"),
    )


def prediction_stability(
    df: DataFrame, period: str, predicted: str, confidence: str
) -> DataFrame:
    """Per period: rows, number of predicted classes, class entropy and mean confidence."""
    counts = df.groupBy(period, predicted).agg(
        F.count("*").alias("n"), F.sum(confidence).alias("c")
    )
    totals = counts.groupBy(period).agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    return (
        counts.join(totals, period)
        .groupBy(period)
        .agg(
            F.max("all").alias("n"),
            F.count("*").alias("n_classes"),
            F.sum(stats.entropy_term(share)).alias("entropy"),
            (F.sum("c") / F.max("all")).alias("mean_confidence"),
        )
    )


# --------------------------------------------------------------------------- transcripts


# Code points from 0x10000 to 0x10FFFF.
MOST_WORDS = 0x100000


def word_distance(ref_words: Column | str, hyp_words: Column | str) -> Column:
    """Edit distance between two word arrays.

    Each distinct word of the pair becomes one character, so the built-in string distance
    counts words. A pair of more than ``MOST_WORDS`` distinct words, for which the characters do
    not suffice, has no distance (null) and does not stop the others.
    """
    ref, hyp = as_col(ref_words), as_col(hyp_words)

    def symbols(vocabulary: Column) -> Column:
        # 0x10000 upwards: no surrogates, room for a million distinct words.
        points = F.transform(
            F.sequence(F.lit(65536), F.size(vocabulary) + 65535),
            lambda i: F.decode(F.unhex(F.lpad(F.hex(i.cast("long")), 8, "0")), "UTF-32"),
        )
        fits = (F.size(vocabulary) > 0) & (F.size(vocabulary) <= MOST_WORDS)
        return F.when(fits, F.map_from_arrays(vocabulary, points))

    def coded(words: Column, table: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.element_at(table, w)), "")

    vocabulary = F.array_distinct(F.concat(ref, hyp))
    pair = F.struct(ref.alias("ref"), hyp.alias("hyp"), symbols(vocabulary).alias("symbols"))
    distance = _once(
        pair,
        lambda p: F.levenshtein(coded(p["ref"], p["symbols"]), coded(p["hyp"], p["symbols"])),
    )
    empty = (F.size(ref) == 0) | (F.size(hyp) == 0)
    return F.when(empty, F.greatest(F.size(ref), F.size(hyp))).otherwise(distance)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, not once per lambda call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def error_rates(pairs: DataFrame, ref: str, hyp: str, form=evaluation_form) -> DataFrame:
    """Word and character error rates of each pair after the same normalisation.

    The distances cost the product of the two lengths, far more than moving the pair, so the
    pairs are first dealt out evenly over the tasks.
    """
    tasks = pairs.sparkSession.sparkContext.defaultParallelism
    prepared = pairs.repartition(max(tasks, _shuffle_partitions(pairs)))
    prepared = prepared.withColumn("_ref", form(ref)).withColumn("_hyp", form(hyp))
    prepared = prepared.withColumn("_rw", blank_separated("_ref")).withColumn(
        "_hw", blank_separated("_hyp")
    )
    return (
        prepared.withColumn("word_errors", word_distance("_rw", "_hw"))
        .withColumn("char_errors", F.levenshtein("_ref", "_hyp"))
        .withColumn("ref_words", F.size("_rw"))
        .withColumn("wer", F.try_divide(F.col("word_errors").cast("double"), F.size("_rw")))
        .withColumn("cer", F.try_divide(F.col("char_errors").cast("double"), F.length("_ref")))
        .drop("_ref", "_hyp", "_rw", "_hw")
    )


def speaker_overlaps(
    ref: DataFrame, hyp: DataFrame, key: str, slot: float = 60.0
) -> DataFrame:
    """Seconds both speakers talk at once, per (key, reference speaker, hypothesis speaker).

    Both sides hold ``speaker``, ``start`` and ``stop``. Segments are put into time slots and
    meet inside a slot only; a pair is counted in the slot its common part starts in, so a
    long recording is many small joins instead of all pairs of its segments.
    """

    def slotted(df: DataFrame, side: str) -> DataFrame:
        slots = F.sequence(
            F.floor(F.col("start") / slot).cast("long"), F.floor(F.col("stop") / slot).cast("long")
        )
        return df.where("stop > start").select(
            key,
            F.col("speaker").alias(f"{side}_speaker"),
            F.col("start").alias(f"{side}_start"),
            F.col("stop").alias(f"{side}_stop"),
            F.explode(slots).alias("_slot"),
        )

    begin = F.greatest("ref_start", "hyp_start")
    end = F.least("ref_stop", "hyp_stop")
    met = slotted(ref, "ref").join(slotted(hyp, "hyp"), [key, "_slot"]).where(
        (end > begin) & (F.floor(begin / slot).cast("long") == F.col("_slot"))
    )
    return met.groupBy(key, "ref_speaker", "hyp_speaker").agg(F.sum(end - begin).alias("overlap"))


def greedy_speaker_map(overlaps: DataFrame, key: str) -> DataFrame:
    """Reference speaker with the largest overlap for each hypothesis speaker."""
    best = F.min(F.struct((-F.col("overlap")).alias("o"), "ref_speaker")).alias("b")
    return overlaps.groupBy(key, "hyp_speaker").agg(best).select(
        key, "hyp_speaker", F.col("b.ref_speaker").alias("ref_speaker")
    )


def _best_assignment(gain: list[list[float]]) -> list[int]:
    """Column of each row (-1 for none) with the largest total gain, by row potentials."""
    n_rows, n_cols = len(gain), len(gain[0])
    size = max(n_rows, n_cols)
    inf = float("inf")
    cost = [
        [-gain[r][c] if r < n_rows and c < n_cols else 0.0 for c in range(size)]
        for r in range(size)
    ]
    row_shift, col_shift = [0.0] * (size + 1), [0.0] * (size + 1)
    owner, came_from = [0] * (size + 1), [0] * (size + 1)
    for row in range(1, size + 1):
        owner[0] = row
        slack, done = [inf] * (size + 1), [False] * (size + 1)
        at = 0
        while owner[at]:
            done[at] = True
            step, following = inf, 0
            for col in range(1, size + 1):
                if done[col]:
                    continue
                reduced = cost[owner[at] - 1][col - 1] - row_shift[owner[at]] - col_shift[col]
                if reduced < slack[col]:
                    slack[col], came_from[col] = reduced, at
                if slack[col] < step:
                    step, following = slack[col], col
            for col in range(size + 1):
                if done[col]:
                    row_shift[owner[col]] += step
                    col_shift[col] -= step
                else:
                    slack[col] -= step
            at = following
        while at:
            owner[at] = owner[came_from[at]]
            at = came_from[at]
    chosen = [-1] * n_rows
    for col in range(1, size + 1):
        if owner[col] <= n_rows and col <= n_cols:
            chosen[owner[col] - 1] = col - 1
    return chosen


def optimal_speaker_map(overlaps: DataFrame, key: str) -> DataFrame:
    """One-to-one mapping with the largest total overlap per key.

    A group is the small speaker-by-speaker table of one recording.
    """
    types = dict(overlaps.dtypes)

    def assign(table: pd.DataFrame) -> pd.DataFrame:
        wide = table.pivot_table(
            index="hyp_speaker", columns="ref_speaker", values="overlap", fill_value=0.0
        ).sort_index().sort_index(axis=1)
        chosen = _best_assignment(wide.to_numpy().tolist())
        rows = [
            (table[key].iloc[0], hyp, wide.columns[c])
            for hyp, c in zip(wide.index, chosen)
            if c >= 0
        ]
        return pd.DataFrame(rows, columns=[key, "hyp_speaker", "ref_speaker"])

    schema = f"{key} {types[key]}, hyp_speaker string, ref_speaker string"
    return overlaps.groupBy(key).applyInPandas(assign, schema)


def boundary_matches(
    ref: DataFrame, hyp: DataFrame, key: str, time: str, tolerance: float = 0.25,
    mode: str = "optimal",
) -> DataFrame:
    """Reference, hypothesis and one-to-one matched boundaries per key.

    Boundaries further apart than the tolerance never match, so the time line is cut there and every
    piece is matched on its own, by one fold over its sorted times. ``optimal`` finds the most matches,
    ``greedy`` gives each hypothesis boundary in time order its nearest free partner (ties to the
    earlier). Rows without a time take no part.
    """
    if mode not in ("optimal", "greedy"):
        raise ValueError(f"mode must be 'optimal' or 'greedy', not {mode!r}")
    both = ref.select(key, F.col(time).cast("double").alias("t"), F.lit(True).alias("is_ref")).unionByName(
        hyp.select(key, F.col(time).cast("double").alias("t"), F.lit(False).alias("is_ref"))
    )
    # A hair of slack keeps distances equal to the tolerance inside one piece.
    reach = tolerance + 1e-9
    pieces = chains(both, [key], "t", reach, slot=max(60.0, 100 * tolerance))
    is_ref = F.col("is_ref")
    # For the greedy fold each hypothesis brings the number of references that are not too late for it.
    # (Only SQL has ranges of fractions.)
    within = f"PARTITION BY `{key}`, chain ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {reach!r}D FOLLOWING"
    upto = F.expr(f"int(count_if(is_ref) OVER ({within}))") if mode == "greedy" else F.lit(0)
    lines = pieces.withColumn("upto", upto).groupBy(key, "chain").agg(
        F.sort_array(F.collect_list(F.when(is_ref, F.col("t")))).alias("refs"),
        F.sort_array(F.collect_list(F.when(~is_ref, F.struct("t", "upto")))).alias("hyps"),
    )
    refs, hyps = F.col("refs"), F.col("hyps")
    count = _most_matches(refs, hyps, reach) if mode == "optimal" else _nearest_matches(refs, hyps, reach)
    both_sides = (F.size(refs) > 0) & (F.size(hyps) > 0)
    return (
        lines.select(key, refs, hyps, F.when(both_sides, count).otherwise(0).alias("matched"))
        .groupBy(key)
        .agg(
            F.sum(F.size(refs)).cast("long").alias("n_ref"),
            F.sum(F.size(hyps)).cast("long").alias("n_hyp"),
            F.sum("matched").cast("long").alias("matched"),
        )
    )


def _most_matches(refs: Column, hyps: Column, reach: float) -> Column:
    """Two places that move on: both on a match, else the one at the earlier boundary."""

    def step(state: Column, _: Column) -> Column:
        i, j = state["i"], state["j"]
        gap = F.get(hyps, j)["t"] - F.get(refs, i)  # null once a side is used up: nothing moves
        match, early_hyp, early_ref = F.abs(gap) <= reach, gap < -reach, gap > reach
        return F.struct(
            (i + F.when(match | early_ref, 1).otherwise(0)).alias("i"),
            (j + F.when(match | early_hyp, 1).otherwise(0)).alias("j"),
            (state["n"] + F.when(match, 1).otherwise(0)).alias("n"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
    steps = F.sequence(F.lit(1), F.greatest(F.size(refs) + F.size(hyps), F.lit(1)))
    return F.aggregate(steps, start, step, lambda state: state["n"])


def _nearest_matches(refs: Column, hyps: Column, reach: float) -> Column:
    """Each hypothesis in turn takes the nearest of the free references within its reach.

    The state holds only the free references that a later hypothesis may still take.
    """

    def step(state: Column, hyp: Column) -> Column:
        arrived = F.slice(refs, state["i"] + 1, F.greatest(hyp["upto"] - state["i"], F.lit(0)))
        free = F.filter(F.concat(state["free"], arrived), lambda r: r >= hyp["t"] - reach)

        def taken(free: Column) -> Column:
            best = F.array_min(F.transform(free, lambda r, k: F.struct(F.abs(hyp["t"] - r), r, k.alias("place"))))["place"]
            return F.struct(
                F.greatest(hyp["upto"], state["i"]).alias("i"),
                F.filter(free, lambda _, k: best.isNull() | (k != best)).alias("free"),
                (state["n"] + best.isNotNull().cast("int")).alias("n"),
            )

        return _once(free, taken)

    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<double>").alias("free"), F.lit(0).alias("n"))
    return F.aggregate(hyps, start, step, lambda state: state["n"])


def precision_recall_f1(matched: Column, n_hyp: Column, n_ref: Column) -> dict[str, Column]:
    precision = F.coalesce(F.try_divide(matched, n_hyp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(matched, n_ref), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


# ------------------------------------------------------------------------------- ranking


def ranking_metrics(
    hits: DataFrame, query: str, rank: str, relevant: str, n_relevant: str, k: int
) -> DataFrame:
    """Hit rate and recall at 1, 3 and 5, mean reciprocal rank and NDCG of the best k hits.

    ``n_relevant`` is the number of relevant rows of the query's whole corpus, found or not. The
    hit rate asks for one relevant hit among the first; recall is the share of the relevant rows
    among the first; the ideal order of NDCG has all relevant rows first. Queries without relevant
    rows have no recall and an NDCG of zero.
    """
    yes = F.col(relevant) == 1
    gain = F.when(yes & (F.col(rank) <= k), 1 / F.log2(F.col(rank) + 1)).otherwise(0.0)
    per_query = hits.groupBy(query).agg(
        F.min(F.when(yes, F.col(rank))).alias("first"),
        F.sum(gain).alias("dcg"),
        F.max(n_relevant).alias("n"),
        *[F.count_if(yes & (F.col(rank) <= n)).alias(f"n_{n}") for n in (1, 3, 5)],
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda s, i: s + 1 / F.log2(i + 1),
    )
    first, some = F.col("first"), F.col("n") > 0

    def found(n: int) -> Column:
        return F.avg(F.coalesce((first <= n).cast("double"), F.lit(0.0))).alias(f"hit_{n}")

    def recall(n: int) -> Column:
        return F.avg(F.when(some, F.col(f"n_{n}") / F.col("n"))).alias(f"recall_{n}")

    return per_query.withColumn("ndcg", F.when(some, F.col("dcg") / ideal).otherwise(0.0)).agg(
        F.count("*").alias("n_queries"),
        *[found(n) for n in (1, 3, 5)],
        *[recall(n) for n in (1, 3, 5)],
        F.avg(F.coalesce(F.try_divide(F.lit(1.0), first), F.lit(0.0))).alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
    )
