"""Transcript clean-up, terms, phrases and transcript evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions import text as tx
from riskweave.operators import evaluation, terms, transcripts
from riskweave.plans.monitoring_queries import rounded
from riskweave.plans.registry import query
from riskweave.sources import tables as src

# ------------------------------------------------------------------ transcript clean-up


def spoken(spark, sf):
    """conversations with fillers and repetitions put in at fixed places."""
    text = F.replace(F.col("text"), F.lit(", "), F.lit(", euh "))
    text = F.replace(text, F.lit(". "), F.lit(". Euuuh, "))
    text = F.replace(text, F.lit(" en "), F.lit(" en en en "))
    text = F.replace(text, F.lit(" the "), F.lit(" très  Très "))
    text = F.replace(text, F.lit(" de "), F.lit(" de de "))
    return src.table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))


_SPOKEN_SQL = """spoken AS (SELECT conv_id, turn, replace(replace(replace(replace(replace(text,
  ', ', ', euh '), '. ', '. Euuuh, '), ' en ', ' en en en '), ' the ', ' très  Très '),
  ' de ', ' de de ') AS text FROM conversations)"""


@query(
    "x01_without_fillers",
    rf"""WITH {_SPOKEN_SQL} SELECT conv_id, turn, array_to_string(list_filter(list_filter(
  regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(regexp_replace(
  lower(w), '^[.,!?;:]+', ''), '[.,!?;:]+$', '') NOT IN ('euh', 'bah', 'hum', 'hein', 'ben')), ' ')
  AS clean FROM spoken""",
)
def without_fillers(spark, sf):
    return spoken(spark, sf).select("conv_id", "turn", tx.without_fillers("text").alias("clean"))


_PROTECTED_TEXT = "replace(replace(text, '. ', '. Ben, '), ', ', ', et ben euh ')"


@query(
    "x01_w13_protected_fillers",
    rf"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array({_PROTECTED_TEXT}, '\s+'),
    lambda w: w <> '') AS w FROM conversations),
u AS (SELECT conv_id, turn, unnest(w) AS w, unnest(list_prepend('', w[1:len(w) - 1])) AS p,
  unnest(range(1, len(w) + 1)) AS i FROM w),
b AS (SELECT *, regexp_replace(regexp_replace(w, '^[.,!?;:]+', ''), '[.,!?;:]+$', '') AS bare FROM u)
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS clean FROM b
WHERE lower(bare) NOT IN ('euh', 'bah', 'hum', 'hein', 'ben') OR bare = 'Ben'
  OR lower(p) IN ('et', 'ben', 'bon') GROUP BY ALL""",
)
def protected_fillers(spark, sf):
    text = F.replace(F.col("text"), F.lit(". "), F.lit(". Ben, "))
    text = F.replace(text, F.lit(", "), F.lit(", et ben euh "))
    return src.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.without_fillers(text, protect=True).alias("clean")
    )


_EDGE = r"[^\p{L}\p{N}_]"
_FILLER_SQL = rf"(?i)(^|{_EDGE})(?:e+u+h+|h+u+m+|b+a+h+|h+e+i+n+)($|{_EDGE})"


@query(
    "x02_without_filler_variants",
    rf"""WITH {_SPOKEN_SQL}, once AS (SELECT conv_id, turn,
  regexp_replace(text, '{_FILLER_SQL}', '\1\2', 'g') AS t FROM spoken),
twice AS (SELECT conv_id, turn, regexp_replace(t, '{_FILLER_SQL}', '\1\2', 'g') AS t FROM once)
SELECT conv_id, turn, trim(regexp_replace(t, '\s+', ' ', 'g')) AS clean FROM twice""",
)
def without_filler_variants(spark, sf):
    return spoken(spark, sf).select(
        "conv_id", "turn", tx.without_filler_variants("text").alias("clean")
    )


# Words and the blanks between them as rows, with the length of each run of one word.
_RUN_SQL = rf"""{_SPOKEN_SQL}, piece AS (SELECT conv_id, turn, unnest(p) AS piece,
    unnest(range(1, len(p) + 1)) AS i FROM (SELECT conv_id, turn,
    regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS p FROM spoken)),
token AS (SELECT *, regexp_full_match(piece, '[\p{{L}}\p{{N}}_]+') AS is_word,
    lag(piece) OVER w AS sep, lag(piece, 2) OVER w AS prev FROM piece
  WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
marked AS (SELECT *, CASE WHEN is_word AND regexp_full_match(sep, '\s+') AND lower(prev) = lower(piece)
    THEN 0 ELSE 1 END AS opens FROM token),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM marked WHERE is_word),
sized AS (SELECT *, count(*) OVER r AS size, row_number() OVER (PARTITION BY conv_id, turn, run ORDER BY i)
    AS place, first(piece) OVER (PARTITION BY conv_id, turn, run ORDER BY i) AS head FROM runs
  WINDOW r AS (PARTITION BY conv_id, turn, run)),
joined AS (SELECT t.conv_id, t.turn, t.i, t.piece, t.is_word, s.size, s.place, s.head,
    n.place AS next_place, n.size AS next_size, n.piece AS next_piece
  FROM token t LEFT JOIN sized s ON t.conv_id = s.conv_id AND t.turn = s.turn AND t.i = s.i
  LEFT JOIN sized n ON t.conv_id = n.conv_id AND t.turn = n.turn AND t.i + 1 = n.i)"""


@query(
    "x03_without_repetitions",
    f"""WITH {_RUN_SQL} SELECT conv_id, turn, string_agg(CASE WHEN is_word THEN
    CASE WHEN place = 1 THEN piece ELSE '' END ELSE CASE WHEN next_place > 1 THEN '' ELSE piece END END,
    '' ORDER BY i) AS clean FROM joined GROUP BY ALL""",
)
def without_repetitions(spark, sf):
    return spoken(spark, sf).select(
        "conv_id", "turn", tx.without_repetitions("text").alias("clean")
    )


_KEPT_SQL = "('très', 'trop', 'vraiment', 'absolument', 'super', 'hyper', 'oui', 'non', 'ok', 'bien')"


@query(
    "x04_smart_repetitions",
    f"""WITH {_RUN_SQL} SELECT conv_id, turn, string_agg(CASE
    WHEN is_word AND place = 1 THEN piece
    WHEN is_word AND size > 2 THEN ''
    WHEN is_word AND lower(piece) IN {_KEPT_SQL} THEN head
    WHEN is_word THEN piece
    WHEN next_place > 1 AND next_size > 2 THEN ''
    WHEN next_place > 1 AND lower(next_piece) IN {_KEPT_SQL} THEN ' '
    ELSE piece END, '' ORDER BY i) AS clean FROM joined GROUP BY ALL""",
)
def smart_repetitions(spark, sf):
    return spoken(spark, sf).select(
        "conv_id", "turn", tx.smart_repetitions("text").alias("clean")
    )


@query(
    "x05_without_false_starts",
    r"SELECT conv_id, turn, regexp_replace(text, '(^|\s)([a-m]\p{L}{4,})', '\1zz- \2', 'g') AS clean FROM conversations",
)
def without_false_starts(spark, sf):
    """Each longer word gets a cut copy in front, which goes; a cut of another word stays."""
    other = F.regexp_replace("text", r"(^|\s)([a-m]\p{L}{4,})", "$1zz- $2")
    broken = F.regexp_replace(other, r"(?<!\S)(\p{L}{2})(\p{L}{3,})", "$1- $1$2")
    return src.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.without_false_starts(broken).alias("clean")
    )


@query(
    "x06_amounts",
    """WITH t AS (SELECT doc_id, text || ' total ' || n_chars || ' Euros, dont ' || doc_id || '€ et 12 euro' AS t
  FROM documents) SELECT doc_id, md5(regexp_replace(t, '(?i)\\b(\\d{1,9})\\s*(?:euros?\\b|€)', '\\1 €', 'g'))
  AS clean, array_to_string(list_transform(regexp_extract_all(t,
  '(?i)\\b(\\d{1,9})\\s*(?:euros?\\b|€)', 1), lambda v: v || ' €'), ',') AS amounts FROM t""",
)
def amounts(spark, sf):
    text = F.concat(
        "text", F.lit(" total "), "n_chars", F.lit(" Euros, dont "), "doc_id", F.lit("€ et 12 euro")
    )
    return src.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(tx.normalised_amounts(text)).alias("clean"),
        F.array_join(tx.amounts(text), ",").alias("amounts"),
    )


def french_name(n: int) -> str:
    """Name of a number from 0 to 999."""
    units = [w for w in rules.NUMBER_WORDS if w not in ("une", "vingts")][:17]
    tens = {20: "vingt", 30: "trente", 40: "quarante", 50: "cinquante", 60: "soixante"}
    if n >= 100:
        head = "cent" if n < 200 else f"{units[n // 100]} cent"
        return head if n % 100 == 0 else f"{head} {french_name(n % 100)}"
    if n < 17:
        return units[n]
    if n < 20:
        return f"dix-{units[n - 10]}"
    if n < 70:
        ten, unit = n // 10 * 10, n % 10
        join = " et " if unit == 1 else "-"
        return tens[ten] if unit == 0 else f"{tens[ten]}{join}{units[unit]}"
    if n < 80:
        return "soixante et onze" if n == 71 else f"soixante-{french_name(n - 60)}"
    return "quatre-vingts" if n == 80 else f"quatre-vingt-{french_name(n - 80)}"


def _named(n):
    names = F.array(*[F.lit(french_name(i)) for i in range(100)])
    rest, hundreds = (n % 100).cast("int"), F.floor(n / 100).cast("int")
    head = F.when(hundreds == 1, "cent").when(
        hundreds > 1, F.concat(F.get(names, hundreds), F.lit(" cent"))
    )
    tail = F.when((rest > 0) | (hundreds == 0), F.get(names, rest))
    return F.concat_ws(" ", head, tail)


@query(
    "x07_number_words",
    """SELECT doc_id, 'je dois ' || (n_chars % 1000) || ' euros et ' || (doc_id % 1000) || ' mois' AS clean
FROM documents""",
)
def number_words(spark, sf):
    said = F.concat(
        F.lit("je dois "), _named(F.col("n_chars") % 1000), F.lit(" euros et "),
        _named(F.col("doc_id") % 1000), F.lit(" mois"),
    )
    return src.table(spark, sf, "documents").select(
        "doc_id", tx.number_words_to_digits(said).alias("clean")
    )


@query(
    "x07_dictated_phone",
    """SELECT doc_id, '06 ' || lpad(CAST(10 + doc_id % 90 AS VARCHAR), 2, '0') || ' '
  || (10 + n_chars % 90) || ' 12 ' || (10 + (doc_id + n_chars) % 90) AS phone FROM documents""",
)
def dictated_phone(spark, sf):
    a, n = F.col("doc_id"), F.col("n_chars")
    said = F.concat_ws(
        ", ", F.lit("zéro six"), _named(10 + a % 90), _named(10 + n % 90), F.lit("douze"),
        _named(10 + (a + n) % 90),
    )
    return src.table(spark, sf, "documents").select(
        "doc_id", tx.dictated_phone(tx.number_words_to_digits(said)).alias("phone")
    )


def glossary(spark, sf):
    """Distinct words of the benchmark texts."""
    return terms.distinct_words(src.table(spark, sf, "benchmark"), "text").select(
        F.col("word").alias("term")
    )


@query("x08_cleaned_transcripts")
def cleaned_transcripts(spark, sf):
    """The whole chain; its steps are checked one by one."""
    rows = spoken(spark, sf).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return transcripts.cleaned(rows, "id", "text", glossary(spark, sf))


# DuckDB counts bytes, so each accented letter is first mapped to one unused ASCII character.
_FOLD = "translate({}, 'èéêöüóäßçíñàâîïôûùœ', 'ABCDEFGHIJKLMNOPQRS')"
_ADAPTIVE_SQL = """word AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text),
    '[\\p{L}\\p{M}\\p{N}_]+')) AS word FROM documents),
term AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS term
  FROM benchmark),
bound AS (SELECT word, length(word) AS l, CASE WHEN length(word) <= 4 THEN 0.95
    WHEN length(word) <= 8 THEN 0.85 WHEN length(word) <= 12 THEN 0.75 ELSE 0.7 END AS s,
    CASE WHEN length(word) <= 4 THEN 1 WHEN length(word) <= 8 THEN 2 WHEN length(word) <= 12 THEN 3
    ELSE length(word) // 4 END AS d FROM word WHERE word NOT IN (SELECT term FROM term)),
pair AS (SELECT word, term, s, d, l, levenshtein(""" + _FOLD.format("word") + ", " + _FOLD.format(
    "term"
) + """) AS e FROM bound JOIN term ON abs(length(term) - l) <= d),
good AS (SELECT word, term, e, 1 - e / CAST(greatest(l, length(term)) AS DOUBLE) AS sim FROM pair
  WHERE e <= d AND 1 - e / CAST(greatest(l, length(term)) AS DOUBLE) >= CAST(s AS DOUBLE)),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, term) AS rn FROM good)"""


@query(
    "j14_x09_term_corrections",
    f"""WITH {_ADAPTIVE_SQL} SELECT word, term, CAST(e AS INT) AS distance, round(sim, 6) AS similarity
FROM best WHERE rn = 1""",
)
def term_corrections(spark, sf):
    found = terms.corrections(
        terms.distinct_words(src.table(spark, sf, "documents"), "text"), glossary(spark, sf)
    )
    return rounded(found)


@query(
    "x09_corrected_texts",
    f"""WITH {_ADAPTIVE_SQL}, fix AS (SELECT map_from_entries(list((word, term))) AS m FROM best WHERE rn = 1)
SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text,
    '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]|\\s+'),
    lambda t: coalesce(m[lower(t)], t)), '')) AS corrected FROM documents, fix""",
)
def corrected_texts(spark, sf):
    out = terms.corrected_texts(
        src.table(spark, sf, "documents"), "doc_id", "text", glossary(spark, sf)
    )
    return out.select("doc_id", F.md5("corrected").alias("corrected"))


def benchmark_sentences(spark, sf):
    sentences = F.split("text", r"(?<=[.!?])\s+")
    return src.table(spark, sf, "benchmark").select(F.explode(sentences).alias("phrase")).where(
        F.trim("phrase") != ""
    )


@query(
    "x10_phrases",
    r"""WITH RECURSIVE sentence AS (SELECT DISTINCT trim(unnest(regexp_split_to_array(
    regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS phrase FROM benchmark),
p AS (SELECT phrase, list_filter(regexp_split_to_array(lower(phrase), '\s+'), lambda w: w <> '') AS pw
  FROM sentence),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w
  FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS s FROM d),
hit AS (SELECT t.doc_id, s, s + len(pw) AS e, phrase FROM t JOIN p ON pw[1] = word AND len(pw) >= 2
  JOIN d ON d.doc_id = t.doc_id WHERE w[s + 1 : s + len(pw)] = pw),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY e DESC, phrase)
  AS rn FROM hit) WHERE rn = 1),
walk AS (
  SELECT doc_id, s, e, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k
    FROM longest) WHERE k = 1
  UNION ALL
  SELECT doc_id, s, e, phrase FROM (
    SELECT l.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.s) AS k
    FROM walk JOIN longest l ON l.doc_id = walk.doc_id AND l.s >= walk.e) WHERE k = 1
)
SELECT doc_id, CAST(s AS INT) AS start, CAST(e AS INT) AS stop, phrase FROM walk""",
)
def phrases(spark, sf):
    return terms.find_phrases(
        src.table(spark, sf, "documents"), "doc_id", "text", benchmark_sentences(spark, sf), "phrase"
    )


def _like(a: str, b: str) -> str:
    return (
        f"(1 - levenshtein({_FOLD.format(a)}, {_FOLD.format(b)})"
        f" / CAST(greatest(length({a}), length({b})) AS DOUBLE))"
    )


@query(
    "x11_similar_phrases",
    rf"""WITH RECURSIVE sentence AS (SELECT DISTINCT trim(unnest(regexp_split_to_array(
    regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS phrase FROM benchmark),
p AS (SELECT phrase, list_filter(regexp_split_to_array(lower(phrase), '\s+'), lambda w: w <> '') AS pw
  FROM sentence),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w
  FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS s FROM d),
opening AS (SELECT word, term FROM (SELECT DISTINCT word FROM t), (SELECT DISTINCT pw[1] AS term FROM p
    WHERE len(pw) >= 2) WHERE abs(length(word) - length(term)) <= 4 AND {_like('word', 'term')} >= 0.85),
cand AS (SELECT t.doc_id, s, phrase, pw, w[s + 1 : s + len(pw)] AS said FROM t JOIN opening USING (word)
  JOIN p ON pw[1] = term AND len(pw) >= 2 JOIN d ON d.doc_id = t.doc_id WHERE s + len(pw) <= len(w)),
each AS (SELECT *, list_transform(range(1, len(pw) + 1), lambda i: {_like('said[i]', 'pw[i]')}) AS sims FROM cand),
hit AS (SELECT doc_id, s, s + len(pw) AS e, phrase, list_sum(sims) / len(pw) AS score FROM each
  WHERE list_min(sims) >= 0.8 AND list_sum(sims) / len(pw) >= 0.85),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s
  ORDER BY score DESC, e DESC, phrase) AS rn FROM hit) WHERE rn = 1),
walk AS (
  SELECT doc_id, s, e, phrase, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k
    FROM longest) WHERE k = 1
  UNION ALL
  SELECT doc_id, s, e, phrase, score FROM (
    SELECT l.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.s) AS k
    FROM walk JOIN longest l ON l.doc_id = walk.doc_id AND l.s >= walk.e) WHERE k = 1
)
SELECT doc_id, CAST(s AS INT) AS start, CAST(e AS INT) AS stop, phrase, round(score, 6) AS score FROM walk""",
)
def similar_phrases(spark, sf):
    """Phrases with spelling errors."""
    found = terms.find_similar_phrases(
        src.table(spark, sf, "documents"), "doc_id", "text", benchmark_sentences(spark, sf), "phrase"
    )
    return rounded(found)


_HONORIFIC_SQL = ", ".join(f"'{h}'" for h in rules.HONORIFICS)


@query(
    "x12_f19_w13_protected_words",
    rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w
  FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(list_prepend(NULL, w[1:len(w) - 1])) AS prev,
  unnest(range(0, len(w))) AS position FROM d),
b AS (SELECT *, regexp_replace(regexp_replace(word, '^\P{{L}}+', ''), '\P{{L}}+$', '') AS bare FROM t),
r AS (SELECT *, CASE WHEN regexp_full_match(bare, '\p{{Lu}}{{2,6}}') THEN 'acronym'
  WHEN regexp_replace(lower(prev), '[.,:;]+$', '') IN ({_HONORIFIC_SQL}) THEN 'after_honorific'
  WHEN regexp_full_match(word, '\p{{Lu}}[^\p{{Lu}}]*') AND (length(word) = 1
    OR regexp_matches(word, '^.\P{{L}}*\p{{Ll}}')) AND prev IS NOT NULL
    AND NOT regexp_matches(prev, '[.!?]$') THEN 'capitalised' END AS reason FROM b)
SELECT doc_id, CAST(position AS INT) AS position, word, reason FROM r WHERE reason IS NOT NULL""",
)
def protected_words(spark, sf):
    return terms.protected_words(src.table(spark, sf, "documents"), "doc_id", "text")


# ------------------------------------------------------------------ transcript evaluation


def _dropped(text):
    """The hypothesis of a pair: the text without some short words."""
    return F.array_join(
        F.filter(F.split(text, r"\s+"), lambda w: ~w.isin("de", "en", "the", "of", "und", "la")), " "
    )


@query(
    "x13_error_rates",
    r"""WITH n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text),
    '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g')) AS ref,
  trim(regexp_replace(regexp_replace(lower(array_to_string(list_filter(regexp_split_to_array(text, '\s+'),
    lambda w: w NOT IN ('de', 'en', 'the', 'of', 'und', 'la')), ' ')),
    '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g')) AS hyp FROM conversations),
c AS (SELECT conv_id, turn, length(ref) AS rc, length(hyp) AS hc, len(list_filter(string_split(ref, ' '),
    lambda w: w <> '')) AS rw, len(list_filter(string_split(hyp, ' '), lambda w: w <> '')) AS hw FROM n)
SELECT conv_id, turn, CAST(rw - hw AS INT) AS word_errors, CAST(rc - hc AS INT) AS char_errors,
  round((rw - hw) / nullif(rw, 0), 6) AS wer, round((rc - hc) / nullif(rc, 0), 6) AS cer FROM c""",
)
def error_rates(spark, sf):
    """Only words are dropped, so both distances are plain differences in the check."""
    pairs = src.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", _dropped("text").alias("hyp")
    )
    out = evaluation.error_rates(pairs, "text", "hyp")
    return rounded(out.select("conv_id", "turn", "word_errors", "char_errors", "wer", "cer"))


@query(
    "x13_word_errors",
    r"""WITH n AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text),
    '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM conversations),
c AS (SELECT *, len(w) AS size, len(list_filter(range(1, len(w) + 1), lambda i: i % 5 = 0)) AS changed,
  len(list_filter(range(1, len(w) + 1), lambda i: i % 7 = 0 AND i % 5 <> 0)) AS other FROM n)
SELECT conv_id, turn, CAST(changed + other AS INT) AS word_errors,
  round((changed + other) / nullif(size, 0), 6) AS wer FROM c""",
)
def word_errors(spark, sf):
    """Every fifth word is replaced by a word of no text; every seventh is lost or, in odd turns, doubled by one.

    Foreign words cost one each and the lengths differ by the lost or added ones, so no cheaper
    alignment exists and the check is a count of places.
    """
    words = F.filter(F.split(evaluation.evaluation_form("text"), " "), lambda w: w != "")

    def spoken(w, i):
        foreign = F.concat(F.lit("qzx"), i.cast("string"))
        added = F.when(F.col("turn") % 2 == 1, F.array(w, F.concat(F.lit("qqz"), i.cast("string")))).otherwise(
            F.array().cast("array<string>")
        )
        return F.when((i + 1) % 5 == 0, F.array(foreign)).when((i + 1) % 7 == 0, added).otherwise(F.array(w))

    pairs = src.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.array_join(F.flatten(F.transform(words, spoken)), " ").alias("hyp")
    )
    return rounded(evaluation.error_rates(pairs, "text", "hyp").select("conv_id", "turn", "word_errors", "wer"))


@query(
    "x14_semantic_error_rates",
    "SELECT doc_id, CAST(0 AS INT) AS word_errors, 0.0::DOUBLE AS wer FROM documents",
)
def semantic_error_rates(spark, sf):
    """The two sides differ in how an amount and a title are written, never in meaning."""
    n = F.col("n_chars") % 1000
    pairs = src.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("M. Dupont de "), "source", F.lit(" doit "), n, F.lit(" €")).alias("ref"),
        F.concat(
            F.lit("Monsieur Dupont de "), "source", F.lit(" doit "), _named(n), F.lit(" euros")
        ).alias("hyp"),
    )

    def form(text):
        return tx.evaluation_form(tx.number_words_to_digits(tx.spoken_form(text)))

    return rounded(
        evaluation.error_rates(pairs, "ref", "hyp", form).select("doc_id", "word_errors", "wer")
    )


def _segments(spark, sf):
    """Turns as timed segments; the hypothesis is shifted and some speakers are swapped."""
    turns = src.table(spark, sf, "conversations").withColumn("n", F.length("text"))
    start = F.col("turn") * 10 + (F.col("n") % 7) * 0.25
    stop = start + 8 + (F.col("n") % 5)
    late = F.when(F.col("n") % 3 == 0, 0.125).otherwise(0.5)
    swapped = F.when(F.col("n") % 11 == 0, F.when(F.col("role") == "user", "assistant").otherwise("user"))
    ref = turns.select("conv_id", F.col("role").alias("speaker"), start.alias("start"), stop.alias("stop"))
    hyp = turns.select(
        "conv_id",
        F.concat(F.lit("hyp_"), F.coalesce(swapped, "role")).alias("speaker"),
        (start + late).alias("start"),
        (stop + late).alias("stop"),
    )
    return ref, hyp


_SEGMENT_SQL = """turn_row AS (SELECT conv_id, role, length(text) AS n,
    turn * 10 + (length(text) % 7) * 0.25 AS b FROM conversations),
ref AS (SELECT conv_id, role AS speaker, b AS start, b + 8 + n % 5 AS stop FROM turn_row),
hyp AS (SELECT conv_id, 'hyp_' || CASE WHEN n % 11 = 0 THEN CASE WHEN role = 'user' THEN 'assistant'
    ELSE 'user' END ELSE role END AS speaker, b + CASE WHEN n % 3 = 0 THEN 0.125 ELSE 0.5 END AS start,
    b + 8 + n % 5 + CASE WHEN n % 3 = 0 THEN 0.125 ELSE 0.5 END AS stop FROM turn_row),
o AS (SELECT r.conv_id, r.speaker AS ref_speaker, h.speaker AS hyp_speaker,
    CAST(sum(least(r.stop, h.stop) - greatest(r.start, h.start)) AS DOUBLE) AS overlap
  FROM ref r JOIN hyp h ON r.conv_id = h.conv_id AND least(r.stop, h.stop) > greatest(r.start, h.start)
  GROUP BY ALL)"""


@query("j11_speaker_overlaps", f"WITH {_SEGMENT_SQL} SELECT * FROM o")
def speaker_overlaps(spark, sf):
    return evaluation.speaker_overlaps(*_segments(spark, sf), "conv_id")


@query(
    "x15_greedy_speaker_map",
    f"""WITH {_SEGMENT_SQL} SELECT conv_id, hyp_speaker, ref_speaker FROM (SELECT *, row_number() OVER (
  PARTITION BY conv_id, hyp_speaker ORDER BY overlap DESC, ref_speaker) AS rn FROM o) WHERE rn = 1""",
)
def greedy_speaker_map(spark, sf):
    return evaluation.greedy_speaker_map(speaker_overlaps(spark, sf), "conv_id")


@query("x15_optimal_speaker_map")
def optimal_speaker_map(spark, sf):
    return evaluation.optimal_speaker_map(speaker_overlaps(spark, sf), "conv_id")


_BOUNDARY_SQL = """WITH RECURSIVE turn_row AS (SELECT conv_id, turn * 0.3125 + (length(text) % 7) * 0.0625 AS t,
    length(text) AS n FROM conversations),
lines AS (SELECT conv_id, list_sort(list(t)) AS refs, list_sort(coalesce(list(t + ((n * 3) % 11 - 5) * 0.0625)
    FILTER (WHERE n % 13 <> 0), [])) AS hyps FROM turn_row GROUP BY conv_id),
{fold}
SELECT conv_id, CAST(r AS BIGINT) AS n_ref, CAST(h AS BIGINT) AS n_hyp, CAST(k AS BIGINT) AS matched,
  round(coalesce(k / nullif(h, 0), 0), 6) AS precision, round(k / r, 6) AS recall, round(2 * k / (r + h), 6) AS f1
FROM (SELECT conv_id, len(any_value(refs)) AS r, len(any_value(hyps)) AS h, max(k) AS k FROM fold GROUP BY conv_id)"""

# Two places that move along the sorted times of a conversation.
_OPTIMAL_SQL = """fold AS (SELECT conv_id, refs, hyps, 1 AS i, 1 AS j, 0 AS k FROM lines UNION ALL
  SELECT conv_id, refs, hyps, i + CASE WHEN hyps[j] - refs[i] >= -0.25 THEN 1 ELSE 0 END,
    j + CASE WHEN hyps[j] - refs[i] <= 0.25 THEN 1 ELSE 0 END,
    k + CASE WHEN abs(hyps[j] - refs[i]) <= 0.25 THEN 1 ELSE 0 END
  FROM fold WHERE i <= len(refs) AND j <= len(hyps))"""

# Hypothesis by hypothesis, the nearest of the references not yet taken, by their places.
_GREEDY_SQL = """fold AS (SELECT conv_id, refs, hyps, [0] AS taken, 1 AS j, 0 AS k FROM lines UNION ALL
  SELECT conv_id, refs, hyps, list_append(taken, coalesce(best, 0)), j + 1, k + CASE WHEN best IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(refs) + 1),
        lambda x: NOT list_contains(taken, x) AND abs(refs[x] - hyps[j]) <= 0.25),
      lambda x: {'d': abs(refs[x] - hyps[j]), 'x': x}))['x'] AS best FROM fold WHERE j <= len(hyps)))"""


def _boundaries(spark, sf, mode):
    """Dense lines, where nearest partners and most partners differ; some hypotheses are missing."""
    n = F.length("text")
    turns = src.table(spark, sf, "conversations").select(
        "conv_id", n.alias("n"), (F.col("turn") * 0.3125 + (n % 7) * 0.0625).alias("start")
    )
    moved = F.col("start") + ((F.col("n") * 3) % 11 - 5) * 0.0625
    hyp = turns.where(F.col("n") % 13 != 0).select("conv_id", moved.alias("start"))
    found = evaluation.boundary_matches(turns, hyp, "conv_id", "start", 0.25, mode)
    made = evaluation.precision_recall_f1(F.col("matched"), F.col("n_hyp"), F.col("n_ref"))
    return rounded(found.select("*", *[c.alias(n) for n, c in made.items()]))


@query("x16_boundary_scores", _BOUNDARY_SQL.format(fold=_OPTIMAL_SQL))
def boundary_scores(spark, sf):
    return _boundaries(spark, sf, "optimal")


@query("j12_nearest_boundaries", _BOUNDARY_SQL.format(fold=_GREEDY_SQL))
def nearest_boundaries(spark, sf):
    return _boundaries(spark, sf, "greedy")


def _roles(spark, sf):
    n = F.length("text")
    return src.table(spark, sf, "conversations").select(
        "role",
        F.when(n % 5 == 0, "user").otherwise(F.col("role")).alias("given"),
        (n / 15).alias("seconds"),
    )


_ROLE_SQL = """WITH t AS (SELECT role AS t, CASE WHEN length(text) % 5 = 0 THEN 'user' ELSE role END AS y,
  {w} AS w FROM conversations), k AS (SELECT t AS class FROM t UNION SELECT y FROM t),
r AS (SELECT class, coalesce((SELECT sum(w) FROM t WHERE t = class), 0) AS support,
  coalesce((SELECT sum(w) FROM t WHERE y = class), 0) AS given,
  coalesce((SELECT sum(w) FROM t WHERE t = class AND y = class), 0) AS hit FROM k),
f AS (SELECT *, coalesce(hit / nullif(given, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM r),
g AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM f)
SELECT round(sum(r * support) / sum(support), 6) AS accuracy, round(avg(p), 6) AS macro_precision,
  round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1 FROM g"""


@query("x17_roles_by_segment", _ROLE_SQL.format(w="1.0::DOUBLE"))
def roles_by_segment(spark, sf):
    matrix = evaluation.confusion(_roles(spark, sf), "role", "given")
    return rounded(evaluation.macro_report(evaluation.class_report(matrix)))


@query("x17_roles_by_duration", _ROLE_SQL.format(w="length(text) / 15.0::DOUBLE"))
def roles_by_duration(spark, sf):
    matrix = evaluation.confusion(_roles(spark, sf), "role", "given", F.col("seconds"))
    return rounded(evaluation.macro_report(evaluation.class_report(matrix)))


@query(
    "x18_language_decision",
    r"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word
  FROM documents), p AS (SELECT word, avg(CASE WHEN lang = 'fr' THEN 1.0 ELSE 0 END) AS weight FROM w GROUP BY 1),
s AS (SELECT doc_id, avg(weight) AS score FROM w JOIN p USING (word) GROUP BY 1),
r AS (SELECT d.doc_id, round(score, 6) AS score, length(trim(text, ' ')) < 10 OR score IS NULL
  OR score < 1e-6 AS undetermined FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id)
SELECT doc_id, CASE WHEN undetermined THEN 0.0 ELSE score END AS french,
  CASE WHEN undetermined THEN 0.0 ELSE round(1 - score, 6) END AS non_french,
  CASE WHEN undetermined THEN 'undetermined' WHEN score >= 0.5 THEN 'french'
    WHEN score >= 0.3 THEN 'grey' ELSE 'non_french' END AS decision FROM r""",
)
def language_decision(spark, sf):
    documents = src.table(spark, sf, "documents").select("doc_id", "text", "lang")
    profile = transcripts.language_profile(documents, "text", "lang", "fr")
    scored = transcripts.language_scores(documents, "doc_id", "text", profile).withColumn(
        "score", F.round("score", 6)
    )
    made = tx.language_decision("text", "score")
    return scored.select("doc_id", *[c.alias(n) for n, c in made.items()])


_HISTORY = "\n-----Message d'origine-----\nDe: x@example.com\n"


def _mail_sql(table: str, key: str, body: str) -> str:
    steps = [
        (r"(?is)<script\b.*?</script\s*>", " "),
        (r"(?is)<style\b.*?</style\s*>", " "),
        (r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6])\s*>", "\n"),
        (r"(?s)<!--.*?-->|<[^>]+>", " "),
    ]
    late = [
        ("[\ufeff\r\t]", " "),
        (r"(?is)\n[ ]*-{2,}\s*(?:message d''origine|original message)\s*-{2,}.*$", ""),
        (r"(?is)\n[ ]*(?:de|from)\s*:[^\n]*\n[ ]*(?:envoyé|sent)\s*:.*$", ""),
        (r"(?m)^[ ]*>.*$", ""),
        (r"(?s)\n-- ?\n.*$", ""),
        (r"(?is)\n[ ]*(?:ce message est confidentiel|this message is confidential).*$", ""),
        (r"[ ]+", " "),
        (r"\s*\n\s*", "\n"),
        (r"^\s+|\s+$", ""),
    ]
    out = body
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    for entity, character in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")
    ):
        out = f"replace({out}, '{entity}', '{character}')"
    for pattern, new in late:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"SELECT {key}, md5({out}) AS message FROM {table}"


@query("x19_mail_from_pages", _mail_sql("pages", "page_id", "html"))
def mail_from_pages(spark, sf):
    return src.table(spark, sf, "pages").select(
        "page_id", F.md5(tx.last_message("html")).alias("message")
    )


@query(
    "x19_mail_from_documents",
    _mail_sql("documents", "doc_id", f"text || '{_HISTORY.replace(chr(39), chr(39) * 2)}' || text"),
)
def mail_from_documents(spark, sf):
    body = F.concat("text", F.lit(_HISTORY), "text")
    return src.table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.last_message(body)).alias("message")
    )


@query(
    "x20_guarded_responses",
    r"""WITH c AS (SELECT conv_id, turn, regexp_replace(translate(text, '*#_`~', ''), '[ \t]+', ' ', 'g') AS r
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, md5(substr(r, 1, 1200)) AS response, length(r) AS full_length,
  CASE WHEN length(r) > 1200 THEN 1 ELSE 0 END AS truncated FROM c""",
)
def guarded_responses(spark, sf):
    made = tx.guarded_response("text")
    return (
        src.table(spark, sf, "conversations")
        .where("role = 'assistant'")
        .select(
            "conv_id",
            "turn",
            F.md5(made["response"]).alias("response"),
            made["full_length"].cast("long").alias("full_length"),
            made["truncated"].alias("truncated"),
        )
    )


@query(
    "x21_chunks",
    """WITH s AS (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 10000)) AS s FROM documents)
SELECT doc_id, CAST((s - 1) // 10000 AS INT) AS chunk, md5(substr(text, s, 10000)) AS content,
  length(substr(text, s, 10000)) AS n FROM s""",
)
def chunks(spark, sf):
    pieces = src.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(tx.chunks("text")).alias("chunk", "piece")
    )
    return pieces.select(
        "doc_id", "chunk", F.md5("piece").alias("content"), F.length("piece").cast("long").alias("n")
    )
