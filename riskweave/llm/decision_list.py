"""Quality rules: text statistics and a learned, readable list of threshold conjunctions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.ranks import unused
from riskweave.session import written

#: Documents shorter than this many words, or with more repeated words than this share, fail the base.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated.
WINDOW_WORDS = 3
#: Labelled rows used to fit at most: those with the smallest digests of their ids.
TRAINING_ROWS = 20_000
#: A learned rule must hold for this share of the pruning rows it meets, and for this many rows.
LEAST_PRECISION = 0.9
LEAST_ROWS = 5
_SPACES = " \t\n\x0b\x0c\r"

STATISTICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_lines_per_word", "repeat_share")


def repeated_words(words: list) -> int:
    """Words that lie in a window found at least twice, its first place included."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(WINDOW_WORDS))))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    total, upto = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + WINDOW_WORDS - max(at, upto)
            upto = at + WINDOW_WORDS
    return total


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines and repeated words of a whole text.

    Words are runs without ASCII white space. A line counts as repeated if it has a word and equals
    an earlier line. A null text is an empty text.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space only
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_statistics(df: DataFrame, text: str, name: str = "_statistics") -> DataFrame:
    """All rows and columns of ``df`` with a struct of the text's statistics."""

    @F.pandas_udf(STATISTICS)
    def made(texts: pd.Series) -> pd.DataFrame:
        names = [part.split()[0] for part in STATISTICS.split(", ")]
        return pd.DataFrame([statistics(t) for t in texts], columns=names).astype("int64")

    return df.withColumn(name, made(F.col(text).cast("string")))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED_PERCENT * s["n_words"])


def features(s: Column) -> list[Column]:
    """The columns named in ``FEATURES``; shares of a text without words are zero."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return [
        s["n_words"].cast("double"), s["word_chars"] / words, s["n_symbols"] / words,
        s["n_dup_lines"] / words, s["n_repeat_words"] / words,
    ]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature]
        return column > self.value if self.above else column <= self.value

    def column(self, values: list[Column]) -> Column:
        return values[self.feature] > F.lit(self.value) if self.above else values[self.feature] <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.value:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    met = np.ones(len(x), bool)
    for condition in rule:
        met &= condition.holds(x)
    return met


def _best_condition(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The threshold with the highest information gain for the bad rows (FOIL), over all features."""
    p, n = int(bad.sum()), int((~bad).sum())
    if not p or not n:
        return None
    before = np.log2(p / (p + n))
    best: tuple[float, Condition] | None = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, good = x[order, f], ~bad[order]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        below_n = np.cumsum(good)[cuts]
        below_p = cuts + 1 - below_n
        for above, pp, nn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -np.inf)
            i = int(gain.argmax())
            if best is None or gain[i] > best[0]:
                middle = float((values[cuts[i]] + values[cuts[i] + 1]) / 2)
                best = (float(gain[i]), Condition(f, above, middle))
    return best[1] if best and best[0] > 0 else None


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add conditions until only bad rows are met or none gains."""
    rule: Rule = ()
    while len(bad) and not bad.all():
        condition = _best_condition(x, bad)
        if condition is None:
            break
        met = condition.holds(x)
        rule, x, bad = rule + (condition,), x[met], bad[met]
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    met = holds(rule, x)
    p, n = int((met & bad).sum()), int((met & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop last conditions as long as the pruning rows do not speak against it."""
    best = rule
    for length in range(len(rule) - 1, 0, -1):
        if _worth(rule[:length], x, bad) >= _worth(best, x, bad):
            best = rule[:length]
    return best


def fit(x: np.ndarray, bad: np.ndarray, seed: int = 0) -> list[Rule]:
    """An ordered list of rules for bad rows, by sequential covering; what no rule meets is kept.

    Each round splits the rows not yet covered into two thirds to grow a rule and one third to
    prune it. The list ends with the first rule that is not precise enough on the pruning rows.
    """
    rules: list[Rule] = []
    random = np.random.default_rng(seed)
    left = np.arange(len(bad))
    while bad[left].sum() >= LEAST_ROWS:
        shuffled = random.permutation(left)
        cut = 2 * len(shuffled) // 3
        grow, prune = shuffled[:cut], shuffled[cut:]
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        rule = _prune(rule, x[prune], bad[prune])
        met = holds(rule, x[prune])
        covered = holds(rule, x[left])
        if not met.any() or bad[prune][met].mean() < LEAST_PRECISION or covered.sum() < LEAST_ROWS:
            break
        rules.append(rule)
        left = left[~covered]
    return rules


def verdict(rules: list[Rule], values: list[Column]) -> Column:
    """The list as one ordered conditional: false at the first rule met, else true."""
    if not rules:
        return F.lit(True)
    chain = None
    for rule in rules:
        met = rule[0].column(values)
        for condition in rule[1:]:
            met = met & condition.column(values)
        chain = F.when(met, F.lit(False)) if chain is None else chain.when(met, F.lit(False))
    return chain.otherwise(F.lit(True))


def training_rows(
    df: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = TRAINING_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """Features and bad marks of ``most`` labelled documents that pass the base rules.

    The labelled keys with the smallest digests are taken. A key labelled twice counts as bad if one
    label is 0; a null label or key is none. A key with several texts counts once, by its smallest
    statistics. Only this bounded table reaches the driver.
    """
    chosen = written(
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg((F.min(label) == 0).alias("_bad"))
        .orderBy(F.md5(F.col("_key").cast("string")), "_key").limit(most),
        "decision-labels",
    )
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key")
    known = with_statistics(texts, "_text").groupBy("_key").agg(F.min("_statistics").alias("s"), F.first("_bad").alias("_bad"))
    rows = (
        known.where(~base_failed(F.col("s")))
        .select("_key", "_bad", *[f.alias(n) for f, n in zip(features(F.col("s")), FEATURES)])
        .toPandas().sort_values("_key")
    )
    return rows[list(FEATURES)].to_numpy(float), rows["_bad"].to_numpy(bool)


def judged(
    df: DataFrame, labels: DataFrame, key: str, text: str, label: str = "quality", most: int = TRAINING_ROWS,
    names: tuple[str, str, str] = ("_statistics", "_base_failed", "_kept"),
) -> DataFrame:
    """All rows and columns of ``df`` with three more: statistics, base failure and verdict.

    ``names`` replace older columns of these names.

    The list is fitted on a bounded sample of labelled rows; statistics, base rules and the learned
    conditional are applied to every whole text. Null and empty texts have no words and fail the
    base. Without labels the base rules alone decide. An empty table gives no rows.
    """
    rules = fit(*training_rows(df, labels, key, text, label, most))
    statistics_, failed_, kept_ = names
    s = F.col(statistics_)
    return (
        with_statistics(df, text, statistics_)
        .withColumn(failed_, base_failed(s))
        .withColumn(kept_, ~F.col(failed_) & verdict(rules, features(s)))
    )


def kept_documents(
    df: DataFrame, labels: DataFrame, key: str, text: str, label: str = "quality", most: int = TRAINING_ROWS
) -> DataFrame:
    """The rows of ``df`` that base rules and learned list keep, with its columns unchanged."""
    names = unused(df, "_statistics", "_base_failed", "_kept")
    found = judged(df, labels, key, text, label, most, tuple(names))
    return found.where(F.col(names[2])).select(*df.columns)
