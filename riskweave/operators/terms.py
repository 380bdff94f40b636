"""Term correction, phrase detection and protected words over a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions.scalars import as_col
from riskweave.functions.text import is_acronym, normalised_similarity
from riskweave.session import written

WORD = r"[\p{L}\p{M}\p{N}_]+"
EditBound = Callable[[Column, Column], Column]
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\s+"

# ---------------------------------------------------------------------------- edit bounds


def adaptive_similarity(length: Column) -> Column:
    return (
        F.when(length <= 4, 0.95).when(length <= 8, 0.85).when(length <= 12, 0.75).otherwise(0.70)
    )


def adaptive_distance(length: Column) -> Column:
    return (
        F.when(length <= 4, 1)
        .when(length <= 8, 2)
        .when(length <= 12, 3)
        .otherwise(F.floor(length / 4))
        .cast("int")
    )


def adaptive_edits(word_length: Column, term_length: Column) -> Column:
    """Most edits both adaptive bounds allow between words of these lengths."""
    allowed = F.floor(
        (1 - adaptive_similarity(word_length)) * F.greatest(word_length, term_length) + 1e-9
    )
    return F.least(adaptive_distance(word_length), allowed.cast("int"))


def edits_for_similarity(threshold: float) -> EditBound:
    """Most edits with 1 - d / max(length) >= threshold."""

    def edits(word_length: Column, term_length: Column) -> Column:
        longest = F.greatest(word_length, term_length)
        return F.floor((1 - threshold) * longest + 1e-9).cast("int")

    return edits


# ------------------------------------------------------------------------------ fuzzy join


# Word lengths up to which a bound is tried out.
MOST_LETTERS = 128
# Hash buckets whose rows are counted on both sides to find heavy pieces: the most rows of that table.
PIECE_BUCKETS = 1 << 16
# Words, or terms, of one bucket that meet in a task as they are; more are dealt out.
SIDE_ROWS = 2_048
# Corrections of one text in a map on average, and the most maps of a text.
FIXES_PER_MAP, MOST_FIX_MAPS = 4, 512


def _pieces(length: Column, edits: Column) -> Column:
    """(i, start, size) of the even cut of a word into ``edits + 1`` pieces."""
    count = edits + 1
    size = F.floor(length / count).cast("int")
    longer_from = count - length % count

    def piece(i: Column) -> Column:
        return F.struct(
            i.alias("i"),
            (i * size + F.greatest(i - longer_from, F.lit(0))).cast("int").alias("start"),
            (size + F.when(i >= longer_from, 1).otherwise(0)).cast("int").alias("size"),
        )

    return F.transform(F.sequence(F.lit(0), edits), piece)


def _dealt(
    left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_row`` and ``_column``: the cell of a grid in which they meet under a key.

    Rows are counted per hash bucket of the key, at most ``PIECE_BUCKETS`` rows a side, so finding the
    heavy buckets shuffles no pieces. Where a side of a bucket is over ``SIDE_ROWS`` and twice the
    mean, its rows are dealt over several rows or columns of the grid by their own hash, and the other
    side's rows of that bucket are repeated once for each. Every pair still meets in exactly one cell.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(PIECE_BUCKETS)).cast("int")

    def sizes(side: DataFrame, name: str) -> DataFrame:
        counts = written(side.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n")), "piece-counts")
        most = F.greatest(F.lit(float(SIDE_ROWS)), 2.0 * counts.agg(F.avg("n")).scalar())
        return counts.select("_bucket", F.ceil(F.col("n") / most).cast("int").alias(name))

    grid = written(
        sizes(left, "_rows").join(sizes(right, "_columns"), "_bucket", "full").where("_rows > 1 or _columns > 1"),
        "heavy-pieces",
    )
    rows, columns = F.coalesce("_rows", F.lit(1)), F.coalesce("_columns", F.lit(1))

    def placed(side: DataFrame, own: str, own_count: Column, own_id: str, other: str, other_count: Column) -> DataFrame:
        return (
            side.withColumn("_bucket", bucket)
            .join(F.broadcast(grid), "_bucket", "left")
            .withColumn(own, F.pmod(F.xxhash64(own_id), own_count).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), other_count - 1)))
            .drop("_bucket", "_rows", "_columns")
        )

    return (
        placed(left, "_row", rows, left_id, "_column", columns),
        placed(right, "_column", columns, right_id, "_row", rows),
    )


def similar_words(
    words: DataFrame, terms: DataFrame, edits: EditBound, accept: Column
) -> DataFrame:
    """(word, term, distance) for every pair within the edits its two lengths allow.

    If a word is cut into k + 1 pieces and at most k edits lead to the term, one piece is
    found unchanged in the term. The edits left and right of that piece add up to at most k,
    which bounds how far it can have moved. Words and terms meet on (both lengths, piece
    number, piece): no pair without a common piece is built, and none is missed.
    Words no longer than their edits have too few pieces and meet the terms on both lengths alone.
    ``edits`` must not fall when a length grows, and must not allow a pair of which one side is
    more than twice as long as the other; another bound is refused.
    ``accept`` filters on the columns ``word``, ``term`` and ``distance``.
    A piece that many words or terms share is dealt over a grid of salts (see ``_dealt``).
    """
    # The words are few bytes and much work, so they are dealt over all cores and not packed by size.
    cores = words.sparkSession.sparkContext.defaultParallelism
    words = written(words.select("word").distinct(), "words").repartition(cores, "word")
    terms = written(terms.select("term").distinct(), "terms").repartition(cores, "term")
    l, m, k = F.col("l"), F.col("m"), F.col("k")
    # Bounds grow with both lengths, and no pair in use differs by more than a factor of two.
    reach = edits(l, 2 * l)
    lengths = words.sparkSession.range(1, MOST_LETTERS).select(F.col("id").cast("int").alias("l"))
    if not lengths.where(edits(l, 2 * l + 1) > l).isEmpty():
        raise ValueError("the bound allows a word and a term more than twice as long")
    left = (
        words.withColumn("l", F.length("word"))
        .withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), l - reach), l + reach)))
        .withColumn("k", edits(l, m))
        .where((F.abs(l - m) <= k) & (l > k))
        .select("word", "l", "m", "k", F.inline(_pieces(l, k)))
        .select("word", "l", "m", "k", "i", F.expr("substring(word, start + 1, size)").alias("piece"))
    )

    wide = edits(2 * m, 2 * m)
    first = F.greatest(F.lit(0), F.col("start") - F.floor((k - (m - l)) / 2).cast("int"))
    last = F.least(m - F.col("size"), F.col("start") + F.floor((k + (m - l)) / 2).cast("int"))
    right = (
        terms.withColumn("m", F.length("term"))
        .withColumn("l", F.explode(F.sequence(F.greatest(F.lit(1), m - wide), m + wide)))
        .withColumn("k", edits(l, m))
        .where((F.abs(l - m) <= k) & (l > k))
        .select("term", "l", "m", "k", F.inline(_pieces(l, k)))
        .where(first <= last)
        .select("term", "l", "m", "i", "size", F.explode(F.sequence(first, last)).alias("at"))
        .select("term", "l", "m", "i", F.expr("substring(term, at + 1, size)").alias("piece"))
        .distinct()
    )
    # The distance is checked inside the join, so only true pairs leave it.
    dealt_words, dealt_terms = _dealt(left, right, ["l", "m", "i", "piece"], "word", "term")
    met = dealt_words.join(dealt_terms, ["l", "m", "i", "piece", "_row", "_column"]).where(
        F.expr("levenshtein(word, term, k) >= 0")
    )
    tiny = (
        words.withColumn("l", F.length("word"))
        .withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), l - reach), l + reach)))
        .withColumn("k", edits(l, m))
        .where((F.abs(l - m) <= k) & (l <= k))
        .join(terms.select("term", F.length("term").alias("m")), "m")
        .where(F.expr("levenshtein(word, term, k) >= 0"))
    )
    return (
        met.select("word", "term")
        .unionByName(tiny.select("word", "term"))
        .distinct()
        .withColumn("distance", F.levenshtein("word", "term"))
        .where(accept)
    )


def pair_similarity() -> Column:
    return 1 - F.col("distance") / F.greatest(F.length("word"), F.length("term"))


def distinct_words(df: DataFrame, text: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))
    return df.select(F.explode(found).alias("word")).distinct()


def corrections(words: DataFrame, glossary: DataFrame) -> DataFrame:
    """Best glossary term per word that is not a term itself.

    Thresholds follow the word length. The most similar term wins, then the first in
    alphabetical order.
    """
    terms = glossary.select(F.lower("term").alias("term")).distinct()
    unknown = words.join(terms, F.col("word") == F.col("term"), "left_anti")
    length = F.length("word")
    accept = (F.col("distance") <= adaptive_distance(length)) & (
        pair_similarity() >= adaptive_similarity(length)
    )
    pairs = similar_words(unknown, terms, adaptive_edits, accept)
    best = F.min(
        F.struct((-pair_similarity()).alias("s"), "term", "distance")
    ).alias("best")
    return pairs.groupBy("word").agg(best).select(
        "word",
        F.col("best.term").alias("term"),
        F.col("best.distance").alias("distance"),
        (-F.col("best.s")).alias("similarity"),
    )


def corrected_texts(
    df: DataFrame, key: str, text: str, glossary: DataFrame
) -> DataFrame:
    """Texts with each unknown word replaced by its correction, all else unchanged.

    Only the corrections a text needs travel to it, in small maps by the hash of the word: a map is
    searched from its start, so one map would cost each token of a text all corrections of the text.
    The corrections are written first, so Spark knows their size when it joins them to the words of all
    texts.
    """
    found = written(
        corrections(distinct_words(df, text), glossary).select("word", "term"), "corrections"
    )
    held = df.select(
        key,
        F.explode(
            F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))
        ).alias("word"),
    )
    entry = F.struct(F.xxhash64("word").alias("hash"), "word", "term")
    fixes = held.join(found, "word").groupBy(key).agg(F.collect_set(entry).alias("fixes"))
    n = F.least(F.lit(MOST_FIX_MAPS), F.ceil(F.size("fixes") / FIXES_PER_MAP).cast("int"))

    def small_map(i: Column) -> Column:
        own = F.filter("fixes", lambda f: F.pmod(f["hash"], F.col("n_maps")) == i)
        return F.map_from_entries(F.transform(own, lambda f: F.struct(f["word"], f["term"])))

    maps = fixes.withColumn("n_maps", n).select(
        key,
        F.size("fixes").alias("n_fixes"),
        "n_maps",
        F.transform(F.sequence(F.lit(0), F.col("n_maps") - 1), small_map).alias("maps"),
    )
    tokens = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))

    def fixed(t: Column) -> Column:
        own = F.get("maps", F.pmod(F.xxhash64(F.lower(t)), F.col("n_maps")).cast("int"))
        return F.coalesce(F.try_element_at(own, F.lower(t)), t)

    replaced = F.array_join(F.transform(tokens, fixed), "")
    return df.join(maps, key, "left").select(
        key,
        F.when(F.col("maps").isNull(), F.col(text)).otherwise(replaced).alias("corrected"),
        F.coalesce("n_fixes", F.lit(0)).alias("n_terms_fixed"),
    )


# ---------------------------------------------------------------------------- phrase search


def blank_separated(text: Column | str) -> Column:
    return F.filter(F.split(as_col(text), r"\s+"), lambda w: w != "")


def _phrase_table(phrases: DataFrame, phrase: str) -> DataFrame:
    """Multi-word phrases by their lower-case words; of equal ones the first spelling."""
    split = phrases.select(
        F.col(phrase).alias("phrase"), blank_separated(F.lower(phrase)).alias("phrase_words")
    ).where(F.size("phrase_words") >= 2)
    return split.groupBy("phrase_words").agg(F.min("phrase").alias("phrase"))


def _leftmost(hits: Column) -> Column:
    """Keep hits in order as long as they start at or after the end of the last one kept.

    ``hits`` is sorted by start; the first field is the start, ``stop`` the end.
    """
    empty = F.filter(hits, lambda _: F.lit(False))
    start = F.struct(F.lit(0).alias("until"), empty.alias("kept"))
    return F.aggregate(
        hits,
        start,
        lambda acc, h: F.when(
            h["start"] >= acc["until"],
            F.struct(
                h["stop"].alias("until"), F.array_append(acc["kept"], h).alias("kept")
            ),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


# Slots of the filter of openings per opening, and its least and greatest size in bytes.
SLOTS_PER_OPENING, FEWEST_SLOTS, MOST_SLOTS = 16, 1 << 10, 1 << 20


def _opening_filter(openings: DataFrame, word: str, following: str) -> Callable[[Column, Column], Column]:
    """A test whether two words may open something; it never says no to a true opening.

    Openings set one byte each in a literal of at most ``MOST_SLOTS`` bytes. With more openings than
    slots the test lets more pairs through, and the join after it sorts them out.
    """

    def slot(a: Column, b: Column, slots: int) -> Column:
        return F.pmod(F.xxhash64(a, b), F.lit(slots)).cast("int")

    slots = FEWEST_SLOTS
    while slots < min(MOST_SLOTS, SLOTS_PER_OPENING * openings.count()):
        slots *= 2
    taken = bytearray(slots)
    for row in openings.select(slot(F.col(word), F.col(following), slots).alias("slot")).distinct().collect():
        taken[row["slot"]] = 1
    table = F.lit(bytes(taken))
    return lambda a, b: F.substr(table, slot(a, b, slots) + 1, F.lit(1)) == F.lit(b"\x01")


def _opening_pairs(
    df: DataFrame, key: str, text: str, may_open: Callable[[Column, Column], Column]
) -> DataFrame:
    """(key, start, word, following) for every two words in a row that pass the filter.

    The filter runs inside the row of the text, so other pairs never become rows.
    """
    split = df.select(key, blank_separated(F.lower(F.col(text))).alias("words"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("words") - 2), lambda i: may_open(F.get("words", i), F.get("words", i + 1))
    )
    pairs = F.transform(
        F.when(F.size("words") >= 2, starts),
        lambda i: F.struct(
            i.alias("start"), F.get("words", i).alias("word"), F.get("words", i + 1).alias("following")
        ),
    )
    return split.select(key, F.inline(pairs))


def find_phrases(
    df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str
) -> DataFrame:
    """(key, start, stop, phrase) of multi-word phrases, leftmost and longest, no overlap.

    Positions count words. A place whose two words open some phrase gives one window per
    phrase length seen with that opening, and the windows meet the phrases on their whole
    text. Many phrases with one opening therefore never multiply the rows. Pairs of words that open
    nothing are dropped inside the text's row.
    """
    listed = _phrase_table(phrases, phrase).select(
        "phrase",
        F.size("phrase_words").alias("n"),
        F.get("phrase_words", F.lit(0)).alias("word"),
        F.get("phrase_words", F.lit(1)).alias("following"),
        F.array_join("phrase_words", " ").alias("window"),
    )
    openings = written(
        listed.groupBy("word", "following").agg(F.sort_array(F.collect_set("n")).alias("lengths")), "openings"
    )
    may_open = _opening_filter(openings, "word", "following")
    places = (
        _opening_pairs(df, key, text, may_open)
        .join(openings, ["word", "following"])
        .groupBy(key)
        .agg(F.collect_list(F.struct("start", "lengths")).alias("places"))
    )
    in_text = df.select(key, blank_separated(F.lower(F.col(text))).alias("words")).join(places, key)
    windows = F.flatten(
        F.transform(
            "places",
            lambda p: F.transform(
                F.filter(p["lengths"], lambda n: p["start"] + n <= F.size("words")),
                lambda n: F.struct(
                    p["start"].alias("start"),
                    n.alias("n"),
                    F.array_join(F.slice("words", p["start"] + 1, n), " ").alias("window"),
                ),
            ),
        )
    )
    hits = (
        in_text.select(key, F.inline(windows))
        .join(listed.select("window", "phrase"), "window")
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "start",
                        (-F.col("n")).alias("shortness"),
                        "phrase",
                        (F.col("start") + F.col("n")).alias("stop"),
                    )
                )
            ).alias("hits")
        )
    )
    return hits.select(key, F.inline(_leftmost(F.col("hits")))).select(
        key, "start", "stop", "phrase"
    )


def find_similar_phrases(
    df: DataFrame,
    key: str,
    text: str,
    phrases: DataFrame,
    phrase: str,
    word_threshold: float = 0.80,
    phrase_threshold: float = 0.85,
    first_threshold: float = 0.85,
) -> DataFrame:
    """Phrases with spelling errors: every word, the mean and the first word must be close.

    At one start the best mean wins, then the longer phrase; the search goes on after it.
    """
    listed = (
        _phrase_table(phrases, phrase)
        .withColumn("first", F.get("phrase_words", F.lit(0)))
        .withColumn("second", F.get("phrase_words", F.lit(1)))
    )
    openers = listed.select(F.explode(F.array("first", "second")).alias("term"))
    vocabulary = df.select(F.explode(F.array_distinct(blank_separated(F.lower(F.col(text))))).alias("word"))
    least = min(first_threshold, word_threshold)
    # Both roles below read these pairs; written, they are found once and their size is known.
    near = written(
        similar_words(
            vocabulary, openers, edits_for_similarity(least), pair_similarity() >= least
        ).withColumn("similarity", pair_similarity()),
        "similar-words",
    )
    firsts = near.where(F.col("similarity") >= first_threshold).select(
        "word", F.col("term").alias("first")
    )
    seconds = near.where(F.col("similarity") >= word_threshold).select(
        F.col("word").alias("following"), F.col("term").alias("second")
    )
    # Texts meet phrases on two spoken words at once, so a frequent word builds no candidates.
    openings = written(
        listed.join(firsts, "first").join(seconds, "second").select("word", "following", "phrase", "phrase_words"),
        "openings",
    )
    may_open = _opening_filter(openings, "word", "following")
    candidates = (
        _opening_pairs(df, key, text, may_open).join(openings, ["word", "following"])
        .groupBy(key)
        .agg(F.collect_list(F.struct("start", "phrase", "phrase_words")).alias("candidates"))
    )
    words = blank_separated(F.lower(F.col(text)))
    in_text = df.select(key, words.alias("words")).join(candidates, key)

    def scored(c: Column) -> Column:
        n = F.size(c["phrase_words"])
        spoken_words = F.slice("words", c["start"] + 1, n)
        each = F.zip_with(spoken_words, c["phrase_words"], normalised_similarity)
        # A word below its threshold, or a text that ends too early, spoils the whole sum.
        total = F.aggregate(
            each, F.lit(0.0), lambda a, s: F.when(s >= word_threshold, a + s)
        )
        return F.struct(
            c["start"].alias("start"),
            (-F.coalesce(total / n, F.lit(0.0))).alias("badness"),
            (-n).alias("shortness"),
            c["phrase"].alias("phrase"),
            (c["start"] + n).alias("stop"),
        )

    ordered = F.array_sort(
        F.filter(
            F.transform("candidates", scored), lambda h: -h["badness"] >= phrase_threshold
        )
    )
    return in_text.select(key, F.inline(_leftmost(ordered))).select(
        key, "start", "stop", "phrase", (-F.col("badness")).alias("score")
    )


# ------------------------------------------------------------------------- protected words


def follows_honorific(previous: Column) -> Column:
    bare = F.regexp_replace(F.lower(previous), r"[.,:;]+$", "")
    return F.coalesce(bare.isin(*rules.HONORIFICS), F.lit(False))


def looks_like_name(word: Column, position_in_sentence: Column) -> Column:
    return word.rlike(r"^\p{Lu}[^\p{Lu}]*$") & word.rlike(r"^.$|^.\P{L}*\p{Ll}") & (
        position_in_sentence > 0
    )


def protected_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, word, reason) of acronyms and proper names.

    Neighbours are read from the word array of the same text; a sentence ends with a word
    that closes on ``.``, ``!`` or ``?``.
    """
    rows = df.select(key, blank_separated(text).alias("words"))
    shifted = F.transform(
        "words",
        lambda w, i: F.struct(
            i.alias("position"),
            w.alias("word"),
            F.when(i > 0, F.get("words", i - 1)).alias("previous"),
        ),
    )
    word, previous = F.col("word"), F.col("previous")
    bare = F.regexp_replace(word, r"^\P{L}+|\P{L}+$", "")
    starts_sentence = previous.isNull() | previous.rlike(r"[.!?]$")
    place = F.when(starts_sentence, 0).otherwise(1)
    reason = (
        F.when(is_acronym(bare), "acronym")
        .when(follows_honorific(previous), "after_honorific")
        .when(looks_like_name(word, place), "capitalised")
    )
    return (
        rows.select(key, F.inline(shifted))
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(key, "position", "word", "reason")
    )
