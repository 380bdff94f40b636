"""Text clean-up and guards as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskweave import rules
from riskweave.functions.scalars import as_col

SPACES = r"\s+"


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def without_control_characters(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), rules.CONTROL_CHARACTERS, "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def without_addresses_and_codes(text: Column | str) -> Column:
    """Drop web and e-mail addresses and long digit or capital codes, collapse spaces."""
    out = F.regexp_replace(as_col(text), r"https?://\S+|www\.\S+", " ")
    out = F.regexp_replace(out, r"\S+@\S+\.\S+", " ")
    out = F.regexp_replace(out, r"\b[0-9A-Z]{6,}\b", " ")
    return collapse_spaces(out)


def special_character_ratio(text: Column | str) -> Column:
    """Share of characters that are neither letters, digits nor blanks."""
    text = as_col(text)
    special = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", ""))
    return F.try_divide(special.cast("double"), F.length(text))


def guarded_text(
    text: Column | str, max_characters: int = rules.MAX_INPUT_CHARACTERS
) -> dict[str, Column]:
    """Sanitised text and the reason it is refused, if any."""
    clean = F.trim(without_control_characters(text))
    reason = F.when(as_col(text).isNull() | (clean == ""), "empty").when(
        F.length(clean) > max_characters, "too_long"
    )
    return {"clean_text": clean, "refusal": reason}


def injection_reason(text: Column | str) -> Column:
    """Name of the first suspicious pattern, excessive special characters, or NULL."""
    text = as_col(text)
    chain = F.when(text.isNull() | (text == ""), "empty")
    for i, pattern in enumerate(rules.SQL_INJECTION_PATTERNS, 1):
        chain = chain.when(text.rlike(f"(?i){pattern}"), f"sql_{i}")
    for i, pattern in enumerate(rules.SCRIPT_INJECTION_PATTERNS, 1):
        chain = chain.when(text.rlike(f"(?i){pattern}"), f"script_{i}")
    return chain.when(
        special_character_ratio(text) > rules.SPECIAL_CHARACTER_RATIO, "special_characters"
    )


def _redacted(value: object) -> object:
    if isinstance(value, dict):
        return {
            k: "[REDACTED]" if any(s in k.lower() for s in _SENSITIVE) else _redacted(v)
            for k, v in value.items()
        }
    if isinstance(value, list):
        return [_redacted(v) for v in value]
    return value


_SENSITIVE = tuple(k.lower() for k in rules.SENSITIVE_KEYS)


def _redacted_text(payload: str) -> str | None:
    try:
        value = json.loads(payload)
        return json.dumps(_redacted(value), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _redacted_texts(payload: pd.Series) -> pd.Series:
    return payload.map(_redacted_text, na_action="ignore")


def redacted_json(payload: Column | str) -> Column:
    """A JSON text with the whole value of every sensitive key masked, at any depth.

    Objects and arrays under such a key are masked like scalars. A text that cannot be parsed is
    refused (null): nothing of it is handed on.
    """
    return _redacted_texts(as_col(payload))


def is_acronym(word: Column | str) -> Column:
    return as_col(word).rlike(r"^\p{Lu}{2,6}$")


def normalised_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = as_col(a), as_col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        1 - F.levenshtein(F.lower(a), F.lower(b)) / longest
    )


# ------------------------------------------------------------------- transcript clean-up


def without_fillers(
    text: Column | str, fillers: Sequence[str] = rules.FILLERS, protect: bool = False
) -> Column:
    """Drop blank-separated words that are fillers once punctuation is stripped.

    With ``protect`` an ambiguous word stays when its context says it is none: the name written
    with a capital, and a word after one of the set phrases' first words.
    """
    words = F.filter(F.split(as_col(text), SPACES), lambda w: w != "")

    def is_filler(w: Column) -> Column:
        return F.regexp_replace(F.lower(w), r"^[.,!?;:]+|[.,!?;:]+$", "").isin(*fillers)

    if not protect:
        return F.array_join(F.filter(words, lambda w: ~is_filler(w)), " ")

    # Each word is paired with the one before it.
    previous = F.concat(
        F.array(F.lit("")), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    )
    pairs = F.zip_with(words, previous, lambda w, p: F.struct(w.alias("w"), p.alias("p")))

    def kept(pair: Column) -> Column:
        bare = F.regexp_replace(pair["w"], r"^[.,!?;:]+|[.,!?;:]+$", "")
        name = (F.lower(bare) == rules.FILLER_NAME) & bare.rlike(r"^\p{Lu}")
        return ~is_filler(pair["w"]) | name | F.lower(pair["p"]).isin(*rules.FILLER_PROTECTORS)

    return F.array_join(F.transform(F.filter(pairs, kept), lambda p: p["w"]), " ")


def without_filler_variants(text: Column | str) -> Column:
    """Drop stretched fillers such as "euuuh" and collapse the blanks left behind."""
    return collapse_spaces(
        F.regexp_replace(as_col(text), f"(?iU){rules.FILLER_PATTERN}", "")
    )


def without_repetitions(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), r"(?iU)\b(\w+)(\s+\1\b)+", "$1")


def _alternatives(words: Sequence[str]) -> str:
    return "|".join(words)


def smart_repetitions(text: Column | str) -> Column:
    """Keep doubled emphasis and confirmation words, reduce three or more to one.

    Other doubled words stay. A doubled emphasis or confirmation word is written with one
    blank between its two copies.
    """
    kept = _alternatives(
        w for w in (*rules.EMPHASIS_WORDS, *rules.CONFIRMATION_WORDS) if "'" not in w
    )
    out = F.regexp_replace(as_col(text), r"(?iU)\b(\w+)(?:\s+\1\b){2,}", "$1")
    return F.regexp_replace(out, rf"(?iU)\b({kept})\s+\1\b", "$1 $1")


def without_false_starts(text: Column | str) -> Column:
    """Drop a word cut by a hyphen when the next word starts with it."""
    return F.regexp_replace(
        as_col(text), r"(?iU)(?<!\S)(\S*)-\s+(?=\1)", ""
    )


AMOUNT = r"(?iU)\b(\d+)\s*(?:euros?\b|€)"


def normalised_amounts(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), AMOUNT, "$1 €")


def amounts(text: Column | str) -> Column:
    found = F.regexp_extract_all(as_col(text), F.lit(AMOUNT), F.lit(1))
    return F.transform(found, lambda v: F.concat(v, F.lit(" €")))


# Words that make a number of an article before them.
UNITS = frozenset(
    "euro euros € centime centimes dollar dollars pourcent % mois an ans année années jour jours "
    "semaine semaines heure heures minute minutes seconde secondes fois".split()
)


def _number_value(words: list[str]) -> int | None:
    """Value of French number words, or None when they do not form a number."""
    total = group = 0
    last = None
    for word in words:
        if word == "et":
            continue
        if word in rules.NUMBER_MULTIPLIERS:
            size = rules.NUMBER_MULTIPLIERS[word]
            if size == 100:
                group = max(group, 1) * 100
            else:
                total += max(group, 1) * size
                group = 0
        elif word in rules.NUMBER_WORDS:
            value = rules.NUMBER_WORDS[word]
            if value == 20 and last == 4:
                group += 4 * 20 - 4
            else:
                group += value
        else:
            return None
        last = rules.NUMBER_WORDS.get(word)
    return total + group


def _digits_for(text: str) -> str:
    """Number words as digits; white space and all other words stay as they are.

    "un" and "une" alone are articles unless a unit follows, a number stands beside them, or the
    text is nothing else.
    """
    out: list[str] = []
    run: list[str] = []
    parts: list[str] = []
    gaps: list[str] = []
    blank, *spaced = re.split(r"(\S+)", text)
    tokens, between = spaced[::2], spaced[1::2]
    after_number = False

    def close(following: str | None = None) -> None:
        nonlocal after_number
        if not run:
            return
        while parts and parts[-1] == "et":
            parts.pop()
        ends_with_et = run[-1].lower() == "et"
        gap = gaps[-2] if ends_with_et else gaps[-1]
        article = parts in (["un"], ["une"]) and not after_number and len(tokens) > 1
        if article and (following or "").lower().strip(".,!?;:") not in UNITS:
            out.append(run[0].rstrip(".,!?;:") + gap)
            after_number = False
        else:
            out.append(str(_number_value(parts)) + gap)
            after_number = True
        if ends_with_et:
            out.append(run[-1] + gaps[-1])
        run.clear()
        parts.clear()
        gaps.clear()

    for token, gap in zip(tokens, between):
        lowered = token.lower().strip(".,!?;:")
        pieces = lowered.split("-")
        known = all(p in rules.NUMBER_WORDS or p in rules.NUMBER_MULTIPLIERS for p in pieces)
        if not known and not (lowered == "et" and run):
            close(token)
            out.append(token + gap)
            after_number = False
            continue
        # "six douze trente" is three dictated numbers, "cent douze" is one.
        if known and parts and _starts_new_number(parts, pieces):
            after_number = True
            close()
        run.append(token)
        gaps.append(gap)
        parts.extend(pieces)
        if known and token[-1] in ".,!?;:":
            close()
            kept = len(out[-1].rstrip())
            out[-1] = out[-1][:kept] + token[-1] + out[-1][kept:]
    close()
    return blank + "".join(out)


def _starts_new_number(parts: list[str], pieces: list[str]) -> bool:
    """Whether a spelled-out token cannot continue the number read so far."""
    if pieces[0] in rules.NUMBER_MULTIPLIERS or parts[-1] in rules.NUMBER_MULTIPLIERS:
        return False
    words = [p for p in parts if p != "et"]
    if words[-1] == "vingts":
        return True
    last, value = rules.NUMBER_WORDS[words[-1]], _number_value(pieces)
    if last == 4 and value == 20:
        return False
    eighty = last == 20 and len(words) > 1 and rules.NUMBER_WORDS.get(words[-2]) == 4
    if last == 10:
        return not 7 <= value <= 9
    most = 19 if last == 60 or eighty else 9 if last >= 20 else 0
    return not 1 <= value <= most


@F.pandas_udf(StringType())
def number_words_to_digits(text: pd.Series) -> pd.Series:
    """Spelled-out French numbers as digits, the rest of the words unchanged."""
    return text.map(_digits_for, na_action="ignore")


def dictated_phone(digits_text: Column | str) -> Column:
    """Group a dictated ten-digit number in pairs; expects numbers already as digits."""
    text = collapse_spaces(F.regexp_replace(as_col(digits_text), r"[,.]", " "))
    padded = F.regexp_replace(text, r"\b([1-9])\b", "0$1")
    padded = F.regexp_replace(padded, r"\b0\s+0([1-9])\b", "0$1")
    run = F.regexp_extract(padded, r"\b(0[1-9](?:\s+\d{2}){4})\b", 1)
    digits = F.regexp_replace(run, SPACES, "")
    return F.when(
        F.length(digits) == 10, F.regexp_replace(digits, r"(\d{2})(?=\d)", "$1 ")
    )


def spoken_form(text: Column | str) -> Column:
    """Expand currency signs and titles on the way to a comparable form."""
    out = F.regexp_replace(as_col(text), "€", " euros ")
    out = F.regexp_replace(out, r"\$", " dollars ")
    for pattern, word in (
        (r"(?iU)\bM\.\s*", "monsieur "),
        (r"(?iU)\bMme\b\.?\s*", "madame "),
        (r"(?iU)\bDr\b\.?\s*", "docteur "),
        (r"(?iU)\bn°\s*", "numéro "),
    ):
        out = F.regexp_replace(out, pattern, word)
    return collapse_spaces(F.lower(out))


def evaluation_form(text: Column | str) -> Column:
    """Lower case, no punctuation, single blanks."""
    return collapse_spaces(
        F.regexp_replace(F.lower(as_col(text)), r"[\p{P}\p{S}]", "")
    )


# -------------------------------------------------------------------------------- mails


def last_message(text: Column | str) -> Column:
    """Remove mark-up, quoted history, signature and legal notice from a mail body."""
    out = F.regexp_replace(as_col(text), r"(?is)<script\b.*?</script\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6])\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for entity, character in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
        ("&amp;", "&"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(character))
    out = F.regexp_replace(out, "[\ufeff\r\t]", " ")
    out = F.regexp_replace(
        out, r"(?is)\n[ ]*-{2,}\s*(?:message d'origine|original message)\s*-{2,}.*$", ""
    )
    out = F.regexp_replace(out, r"(?is)\n[ ]*(?:de|from)\s*:[^\n]*\n[ ]*(?:envoyé|sent)\s*:.*$", "")
    out = F.regexp_replace(out, r"(?m)^[ ]*>.*$", "")
    out = F.regexp_replace(out, r"(?s)\n-- ?\n.*$", "")
    out = F.regexp_replace(
        out, r"(?is)\n[ ]*(?:ce message est confidentiel|this message is confidential).*$", ""
    )
    out = F.regexp_replace(out, r"[ ]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def guarded_response(
    text: Column | str,
    forbidden: str = "*#_`~",
    max_characters: int = rules.RESPONSE_MAX_CHARACTERS,
) -> dict[str, Column]:
    """Answer without forbidden characters, cut to the allowed length, with a warning.

    The cut is the rule of the outgoing channel; the full length is kept beside it.
    """
    text = as_col(text)
    clean = F.regexp_replace(F.translate(text, forbidden, ""), r"[ \t]+", " ")
    return {
        "response": F.substring(clean, 1, max_characters),
        "full_length": F.length(clean),
        "truncated": (F.length(clean) > max_characters).cast("int"),
    }


def chunks(text: Column | str, size: int = rules.CHUNK_CHARACTERS) -> Column:
    """Array of consecutive pieces of at most ``size`` characters that cover the whole text."""
    text = as_col(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


def sentence_case(text: Column | str) -> Column:
    text = as_col(text)
    return F.concat(
        F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text))
    )


def language_decision(text: Column | str, french: Column | str) -> dict[str, Column]:
    """Scores of the two classes and the decision on a given French score."""
    text, score = as_col(text), as_col(french)
    low, high = rules.LANGUAGE_GREY_ZONE
    undetermined = (
        (F.length(F.trim(text)) < rules.MIN_LANGUAGE_CHARACTERS)
        | score.isNull()
        | (score < rules.MIN_LANGUAGE_SCORE)
    )
    return {
        "french": F.when(undetermined, F.lit(0.0)).otherwise(F.round(score, 6)),
        "non_french": F.when(undetermined, F.lit(0.0)).otherwise(F.round(1 - score, 6)),
        "decision": F.when(undetermined, "undetermined")
        .when(score >= high, "french")
        .when(score >= low, "grey")
        .otherwise("non_french"),
    }
