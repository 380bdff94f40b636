"""Spelling variants: all words one edit apart, by composing acceptors with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import written

LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS = 6
MIN_COUNT = 5
#: A word's form is at least this many times as frequent.
RATIO = 5
#: Words of one partition of the initial states; a larger one is cut further.
GROUP_WORDS = 4_096
#: Words of a batch of pairs that a task hands on.
_PAIRS = 16_384
_PART = ["m", "head", "tail"]


# ------------------------------------------------------------------------------------- the words


def misspelt_words(
    df: DataFrame, key: str, text: str, every: int | None = None, letters: int = MIN_LETTERS
) -> DataFrame:
    """``word, n``: maximal letter runs of whole texts, A-Z lower-cased, with their number.

    With ``every``, a run loses one letter where the CRC-32 ``h`` of ``<key>:<run>`` is a multiple of
    ``every``: the letter ``h`` modulo its length. Words under ``letters`` letters are left out. Words
    are counted before the shuffle, so a frequent one sends a row from each task. Null and empty
    texts have no words, a null key counts as the empty text, repeated rows count each.
    """
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{letters},}}"), F.lit(0))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = df.select(name.alias("key"), F.explode(runs).alias("run")).select(
        "key", F.translate("run", _UPPER, _LOWER).alias("word")
    )
    if every:
        h, length = F.crc32(F.concat("key", F.lit(":"), "word").cast("binary")), F.length("word")
        at = (h % length).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2, length))
        found = found.select(F.when(h % every == 0, cut).otherwise(F.col("word")).alias("word"))
        found = found.where(F.length("word") >= letters)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------- acceptors in a task


class Acceptor:
    """The minimal acyclic automaton of sorted distinct strings.

    A state is a number; ``moves[state]`` maps a letter to the next state. States with the same
    future are one: a state is looked up as soon as no later string can add to it.
    """

    def __init__(self, strings: list[str]):
        self.moves: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        open_moves: list[dict[str, int]] = [{}]
        open_final = [False]

        def closed() -> int:
            moves, final = open_moves.pop(), open_final.pop()
            state = known.setdefault((final, *moves.items()), len(self.moves))
            if state == len(self.moves):
                self.moves.append(moves)
                self.final.append(final)
            return state

        def close_to(depth: int, string: str) -> None:
            while len(open_moves) - 1 > depth:
                state = closed()
                open_moves[-1][string[len(open_moves) - 1]] = state

        last = ""
        for string in strings:
            shared = len(commonprefix((last, string)))
            close_to(shared, last)
            for _ in string[shared:]:
                open_moves.append({})
                open_final.append(False)
            open_final[-1] = True
            last = string
        close_to(0, last)
        self.start = closed()


class _Composition:
    """Pairs that ``left``, one edit and ``right`` accept, the left one no longer than the right one.

    Before the edit both sides read the same letters; after it a pair of states accepts what both
    futures hold. Walks keep one path, so a long word costs its length.
    """

    def __init__(self, left: Acceptor, right: Acceptor):
        self.left, self.right = left, right
        self._alive: dict[tuple[int, int], bool] = {}

    def _steps(self, p: int, q: int) -> list[tuple[str, int, int]]:
        there = self.right.moves[q]
        return [(x, after, there[x]) for x, after in self.left.moves[p].items() if x in there]

    def _ends(self, p: int, q: int) -> bool:
        return self.left.final[p] and self.right.final[q]

    def alive(self, p: int, q: int) -> bool:
        """Whether both states accept some string in common; looked up for each pair of states once."""
        waiting = [(p, q)]
        while waiting:
            pair = waiting[-1]
            if pair not in self._alive:
                after = [s[1:] for s in self._steps(*pair)]
                if missing := [x for x in after if x not in self._alive]:
                    waiting += missing
                    continue
                self._alive[pair] = self._ends(*pair) or any(self._alive[x] for x in after)
            waiting.pop()
        return self._alive[p, q]

    def common(self, p: int, q: int) -> Iterator[str]:
        """Strings that both states accept."""
        path: list[str] = []
        waiting = [(0, "", p, q)] if self.alive(p, q) else []
        while waiting:
            depth, letter, p, q = waiting.pop()
            path[max(0, depth - 1) :] = [letter]
            if self._ends(p, q):
                yield "".join(path)
            waiting += [(depth + 1, x, i, j) for x, i, j in self._steps(p, q) if self._alive[i, j]]

    def replaced(self) -> Iterator[tuple[str, str]]:
        """One letter replaced; both sides are the same acceptor, each pair of letters comes once."""
        path: list[str] = []
        waiting = [(0, "", self.left.start)]
        while waiting:
            depth, letter, p = waiting.pop()
            path[max(0, depth - 1) :] = [letter]
            moves = list(self.left.moves[p].items())
            for n, (a, after_a) in enumerate(moves):
                for b, after_b in moves[n + 1 :]:
                    for s in self.common(after_a, after_b):
                        before = "".join(path)
                        yield before + a + s, before + b + s
                waiting.append((depth + 1, a, after_a))

    def inserted(self) -> Iterator[tuple[str, str]]:
        """One letter more on the right side, at its first place in a run of that letter."""
        path: list[str] = []
        waiting = [(0, "", self.left.start, self.right.start)]
        while waiting:
            depth, letter, p, q = waiting.pop()
            path[max(0, depth - 1) :] = [letter]
            for more, after in self.right.moves[q].items():
                if more != letter:
                    for s in self.common(p, after):
                        before = "".join(path)
                        yield before + s, before + more + s
            waiting += [(depth + 1, x, i, j) for x, i, j in self._steps(p, q)]


def _near_in_group(middles: list[str], short: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart of sorted strings of ``short`` letters or one more, one of them short."""
    left = [s for s in middles if len(s) == short]
    right = [s for s in middles if len(s) != short]
    if not left:
        return
    shorter = Acceptor(left)
    if len(left) > 1:
        yield from _Composition(shorter, shorter).replaced()
    if right:
        yield from _Composition(shorter, Acceptor(right)).inserted()


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by partition and middle to pairs of words; a partition may span batches."""

    def batch_of(pairs: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*pairs)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "a_n", "b", "b_n"]
        )

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    pairs: list[tuple] = []
    for (m, head, tail), group in groupby(rows, key=lambda r: r[:3]):
        counts = {r[3]: r[4] for r in group}
        if len(counts) < 2:
            continue
        for x, y in _near_in_group(list(counts), m - len(head) - len(tail)):
            pairs.append((head + x + tail, counts[x], head + y + tail, counts[y]))
            if len(pairs) >= _PAIRS:
                yield batch_of(pairs)
                pairs = []
    yield batch_of(pairs)


# ------------------------------------------------------------------------------------- partitions


def _initial_parts(words: DataFrame) -> DataFrame:
    """Each word below the states that an untouched half leads to.

    ``m`` is the length of the shorter word of a pair. Cut that word in half: one edit leaves one half
    alone, so a pair meets below its common first half or below its common second half.
    """
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m >= 1")
    half, rest = F.floor(F.col("m") / 2).cast("int"), F.ceil(F.col("m") / 2).cast("int")
    empty = F.lit("")
    first = F.struct(
        F.substr("word", F.lit(1), half).alias("head"), empty.alias("tail"),
        F.substr("word", half + 1, length).alias("middle"),
    )
    second = F.struct(
        empty.alias("head"), F.substr("word", length - rest + 1, rest).alias("tail"),
        F.substr("word", F.lit(1), length - rest).alias("middle"),
    )
    return sized.select("m", F.inline(F.array(first, second)), "n")


def _cut_again(parts: DataFrame) -> DataFrame:
    """The same step inside a partition: below a longer head, and below a longer tail."""
    short = F.col("m") - F.length("head") - F.length("tail")
    half, rest = F.floor(short / 2).cast("int"), F.ceil(short / 2).cast("int")
    length = F.length("middle")
    first = F.struct(
        F.concat("head", F.substr("middle", F.lit(1), half)).alias("head"), F.col("tail").alias("tail"),
        F.substr("middle", half + 1, length).alias("middle"),
    )
    second = F.struct(
        F.col("head").alias("head"), F.concat(F.substr("middle", length - rest + 1, rest), "tail").alias("tail"),
        F.substr("middle", F.lit(1), length - rest).alias("middle"),
    )
    return parts.select("m", F.inline(F.array(first, second)), "n")


def _bounded_parts(words: DataFrame, group_words: int) -> DataFrame:
    """Partitions of at most ``group_words`` words, or with at most one letter between head and tail."""
    small: list[DataFrame] = []
    parts = _initial_parts(words)
    while True:
        sizes = parts.groupBy(*_PART).agg(F.count(F.lit(1)).alias("size"))
        between = F.col("m") - F.length("head") - F.length("tail")
        large = written(sizes.where((F.col("size") > group_words) & (between >= 2)).select(*_PART), "spelling-parts")
        if large.isEmpty():
            break
        small.append(parts.join(large, _PART, "left_anti"))
        parts = _cut_again(parts.join(large, _PART, "left_semi"))
    for more in small:
        parts = parts.unionByName(more)
    return parts


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of ``words`` (distinct ``word``, ``n``) one edit apart, once.

    The composed machine of vocabulary, one edit and vocabulary is enumerated by partitions of its
    initial states: the states that a common head or a common tail leads to. A partition over
    ``group_words`` words is cut again below longer heads and tails, so a frequent ending is no large
    task. In a task the minimal acceptors of the shorter and the longer middles are composed; states
    of equal future are one, and so are their common futures. An edit is replacing, inserting or
    deleting one code point.
    """
    parts = _bounded_parts(words, group_words).select(*_PART, "middle", "n")
    dealt = parts.repartition(*_PART).sortWithinPartitions(*_PART, "middle")
    return dealt.mapInArrow(_composed, "a string, a_n bigint, b string, b_n bigint").distinct()


# ------------------------------------------------------------------------------------------ forms


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of forms ends. Pointers double, so a round halves the chains."""
    roots = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(roots.join(step, "root", "left").select("word", "root", "next"), "spelling-roots")
        if joined.where("next is not null").isEmpty():
            return roots
        roots = joined.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per word of ``words`` (``word``, ``n``): ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is at
    least ``ratio`` times the word's, else null; ``root`` follows forms to the last one. Forms grow by
    the ratio, so chains are short and have no circles for a ratio above 1, which is required. Rows
    without a word or number, and empty words, are left out; the numbers of repeated words are added. Other columns are left out. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("the ratio must be above 1, or forms could lead in circles")
    listed = words.where("word is not null and word <> '' and n is not null")
    vocabulary = written(listed.groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "spelling-words")
    pairs = near_words(vocabulary, group_words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    near = pairs.select(F.inline(sides)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    chosen = -F.col("best.less") >= ratio * F.col("n")
    judged = written(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("bigint").alias("n_near"), "form_n"
    )
