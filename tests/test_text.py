import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskweave.functions import text as tx
from riskweave.operators import evaluation, terms
from riskweave.plans.text_queries import french_name


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build("t").alias("o")).first().o


def test_number_names_come_back():
    assert all(tx._digits_for(french_name(n)) == str(n) for n in range(1000))


@pytest.mark.parametrize(
    "said, digits",
    [
        ("deux cent cinquante euros", "250 euros"),
        ("mille neuf cent quatre-vingt-dix-neuf", "1999"),
        ("un million deux cent mille", "1200000"),
        ("zéro six douze trente-quatre", "0 6 12 34"),
        ("vingt et un et trente", "21 et 30"),
        ("rien du tout", "rien du tout"),
        ("un problème  avec\nune carte", "un problème  avec\nune carte"),
        ("un euro et une  heure", "1 euro et 1  heure"),
        ("zéro un, deux", "0 1, 2"),
        ("  cent\tun\nclients ", "  101\nclients "),
    ],
)
def test_number_words(said, digits):
    assert tx._digits_for(said) == digits


def test_phone(spark):
    said = "zéro six douze trente-quatre cinquante-six soixante-dix-huit"
    assert one(spark, said, lambda c: tx.dictated_phone(tx.number_words_to_digits(c))) == "06 12 34 56 78"
    assert one(spark, "deux euros", lambda c: tx.dictated_phone(tx.number_words_to_digits(c))) is None


@pytest.mark.parametrize(
    "build, before, after",
    [
        (tx.without_fillers, "Euh, je hum. veux bah", "je veux"),
        (tx.without_filler_variants, "Euuuuh je heiiin veux", "je veux"),
        (tx.without_filler_variants, "heureux bahut", "heureux bahut"),
        (tx.without_repetitions, "oui oui oui je", "oui je"),
        (tx.without_repetitions, "Très très été été", "Très été"),
        (tx.smart_repetitions, "très très bien", "très très bien"),
        (tx.smart_repetitions, "oui oui oui oui je", "oui je"),
        (tx.smart_repetitions, "oui oui je je", "oui oui je je"),
        (tx.without_false_starts, "je vou- voudrais", "je voudrais"),
        (tx.without_false_starts, "je vou- vou- voudrais", "je voudrais"),
        (tx.without_false_starts, "peut- être", "peut- être"),
        (tx.normalised_amounts, "200 euros, 15euro et 3€", "200 €, 15 € et 3 €"),
        (tx.evaluation_form, "M. Dupont,  doit: 200 € !", "m dupont doit 200"),
        (tx.spoken_form, "M. Dupont doit 200 €", "monsieur dupont doit 200 euros"),
    ],
)
def test_clean_up(spark, build, before, after):
    assert one(spark, before, build) == after


def test_protected_fillers(spark):
    said = "Ben arrive, ben oui et ben bon euh merci"
    assert one(spark, said, lambda c: tx.without_fillers(c)) == "arrive, oui et bon merci"
    kept = one(spark, said, lambda c: tx.without_fillers(c, protect=True))
    assert kept == "Ben arrive, oui et ben bon euh merci"


def test_guards(spark):
    reasons = {
        "x' UNION all SELECT 1": "sql_1",
        "a OR 1=1": "sql_2",
        "<script src=x>": "script_1",
        "onload = 1": "script_4",
        "$$$$$$a": "special_characters",
        "": "empty",
        "a normal sentence.": None,
    }
    df = spark.createDataFrame([(t,) for t in reasons], "t string")
    got = {r.t: r.r for r in df.select("t", tx.injection_reason("t").alias("r")).collect()}
    assert got == reasons
    made = tx.guarded_text("t")
    texts = spark.createDataFrame([("  ok\x00 ",), (" \x07 ",), ("x" * 10001,)], "t string")
    got = [(r.c, r.r) for r in texts.select(made["clean_text"].alias("c"), made["refusal"].alias("r")).collect()]
    assert got[0] == ("ok", None) and got[1] == ("", "empty") and got[2][1] == "too_long"
    assert len(got[2][0]) == 10001


def test_redacted_json(spark):
    raw = '{"a":{"apiToken":"x,\\"y","n":1},"Password":12,"l":[{"secret_id":null}]}'
    want = '{"a":{"apiToken":"[REDACTED]","n":1},"Password":"[REDACTED]","l":[{"secret_id":"[REDACTED]"}]}'
    assert one(spark, raw, tx.redacted_json) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"token":["abc","def"],"ok":1}', '{"token":"[REDACTED]","ok":1}'),
        ('{"password":{"v":"x y","w":"zz"},"k":2}', '{"password":"[REDACTED]","k":2}'),
        ('{"a":[{"My_Secret" : {"b":["s1"]}}], "é": "ü"}', '{"a":[{"My_Secret":"[REDACTED]"}],"é":"ü"}'),
        ('{"token":"s1"', None),
        ('not json, token: s1', None),
        ("[1,2]", "[1,2]"),
    ],
)
def test_no_secret_survives(spark, raw, want):
    assert one(spark, raw, tx.redacted_json) == want


def test_long_amounts(spark):
    assert one(spark, "1234567890 euros et 12 euros", tx.normalised_amounts) == "1234567890 € et 12 €"


def test_mail(spark):
    mail = (
        "<p>Bonjour,<br>merci&nbsp;bien</p><script>x()</script>\n> cité\n"
        "-----Message d'origine-----\nDe: a\nEnvoyé: b\nvieux"
    )
    assert one(spark, mail, tx.last_message) == "Bonjour,\nmerci bien"


def test_chunks_cover_the_text(spark):
    text = "é" * 25 + "b" * 6
    parts = one(spark, text, lambda c: tx.chunks(c, 10))
    assert "".join(parts) == text and [len(p) for p in parts] == [10, 10, 10, 1]


# ------------------------------------------------------------------------- brute force


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def mutated(word, rnd):
    for _ in range(rnd.randint(0, 4)):
        at = rnd.randrange(len(word) + 1)
        kind = rnd.random()
        if kind < 0.4:
            word = word[:at] + rnd.choice("abcé") + word[at:]
        elif len(word) > 1 and at < len(word):
            word = word[:at] + (rnd.choice("abcé") if kind < 0.7 else "") + word[at + 1 :]
    return word


@pytest.fixture(scope="module")
def vocabulary():
    rnd = random.Random(3)
    glossary = sorted({"".join(rnd.choice("abcdé") for _ in range(rnd.randint(2, 20))) for _ in range(120)})
    words = sorted({mutated(rnd.choice(glossary), rnd) for _ in range(600)})
    return words, glossary


def test_similar_words_miss_nothing(spark, vocabulary):
    words, glossary = vocabulary
    w = spark.createDataFrame([(x,) for x in words], "word string")
    g = spark.createDataFrame([(x,) for x in glossary], "term string")
    for threshold in (0.8, 0.85):
        got = terms.similar_words(
            w, g, terms.edits_for_similarity(threshold), terms.pair_similarity() >= threshold
        )
        found = {(r.word, r.term) for r in got.collect()}
        want = {
            (a, b)
            for a, b in itertools.product(words, glossary)
            if 1 - distance(a, b) / max(len(a), len(b)) >= threshold and len(a) > distance(a, b)
            and (distance(a, b) == 0 or len(a) > int((1 - threshold) * max(len(a), len(b)) + 1e-9))
        }
        assert found == want


def test_heavy_pieces_are_dealt_over_cells_and_miss_nothing(spark, monkeypatch):
    """One ending on many words and terms; broadcasting by size is off."""
    monkeypatch.setattr(terms, "SIDE_ROWS", 16)
    monkeypatch.setattr(terms, "PIECE_BUCKETS", 1 << 12)
    rnd = random.Random(9)
    some = sorted({"".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(900)})
    words = [x + "tions" for x in some[:300]] + ["".join(rnd.choice("klmnopq") for _ in range(11)) for _ in range(600)]
    listed = [x + "tions" for x in some[300:450]]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    g = spark.createDataFrame([(x,) for x in listed], "term string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = []
        plain = terms._dealt
        monkeypatch.setattr(terms, "_dealt", lambda *a: seen.append(plain(*a)) or seen[-1])
        got = terms.similar_words(w, g, terms.edits_for_similarity(0.75), terms.pair_similarity() >= 0.75)
        found = {(r.word, r.term) for r in got.collect()}
        cell = ["l", "m", "i", "piece", "_row", "_column"]
        left, right = (side.groupBy(*cell).count() for side in seen[0])
        assert left.agg({"count": "max"}).first()[0] <= 3 * 16 and right.agg({"count": "max"}).first()[0] <= 3 * 16
        assert left.where("_row > 0").count() > 5
        assert seen[0][0].join(seen[0][1], cell).select("word", "term", "l", "m", "i").count() >= len(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {
        (a, b) for a, b in itertools.product(set(words), listed) if 1 - distance(a, b) / max(len(a), len(b)) >= 0.75
    }
    assert len(found) > 20


def test_only_openings_leave_the_row_of_a_text(spark):
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice("abcdefghijklmnopqrst") + rnd.choice("xyz") for _ in range(200))) for i in range(50)]
    texts += [(99, None), (100, ""), (101, "one"), (102, "ax bx")]
    df = spark.createDataFrame(texts, "id long, t string")
    openings = spark.createDataFrame([("ax", "bx"), ("cy", "dz")], "word string, following string")
    test = terms._opening_filter(openings, "word", "following")
    got = sorted((r.id, r.start, r.word, r.following) for r in terms._opening_pairs(df, "id", "t", test).collect())
    pairs = [(i, n, *two) for i, t in texts for n, two in enumerate(itertools.pairwise((t or "").split()))]
    want = [p for p in pairs if p[2:] in {("ax", "bx"), ("cy", "dz")}]
    assert set(want) <= set(got) and len(got) <= len(want) + len(pairs) / 50
    none = terms._opening_filter(openings.limit(0), "word", "following")
    assert terms._opening_pairs(df, "id", "t", none).count() == 0


def test_loose_bounds_miss_nothing_or_are_refused(spark, vocabulary):
    words, glossary = vocabulary[0][:150] + ["ab", "a"], vocabulary[1][:60] + ["abzz", "ab", "b"]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    g = spark.createDataFrame([(x,) for x in glossary], "term string")
    got = terms.similar_words(w, g, terms.edits_for_similarity(0.5), terms.pair_similarity() >= 0.5)
    want = {
        (a, b)
        for a, b in itertools.product(words, glossary)
        if 1 - distance(a, b) / max(len(a), len(b)) >= 0.5
    }
    assert {(r.word, r.term) for r in got.collect()} == want
    with pytest.raises(ValueError):
        terms.similar_words(w, g, terms.edits_for_similarity(0.3), terms.pair_similarity() >= 0.3)


def limits(n):
    return (0.95, 1) if n <= 4 else (0.85, 2) if n <= 8 else (0.75, 3) if n <= 12 else (0.70, n // 4)


def test_corrections_against_all_pairs(spark, vocabulary):
    words, glossary = vocabulary
    want = {}
    for a in words:
        if a in glossary:
            continue
        least, most = limits(len(a))
        scored = [
            (-(1 - distance(a, b) / max(len(a), len(b))), b)
            for b in glossary
            if distance(a, b) <= most and 1 - distance(a, b) / max(len(a), len(b)) >= least
        ]
        if scored:
            want[a] = min(scored)[1]
    got = terms.corrections(
        spark.createDataFrame([(x,) for x in words], "word string"),
        spark.createDataFrame([(x,) for x in glossary], "term string"),
    )
    assert {r.word: r.term for r in got.collect()} == want
    assert len(want) > 20


def test_phrases(spark):
    texts = spark.createDataFrame(
        [(1, "Je fais un virement international SEPA demain virement international"), (2, "rien")],
        "id long, t string",
    )
    listed = spark.createDataFrame(
        [("virement international SEPA",), ("virement international",), ("un virement",)], "p string"
    )
    got = terms.find_phrases(texts, "id", "t", listed, "p").orderBy("start").collect()
    assert [(r.start, r.stop, r.phrase) for r in got] == [
        (2, 4, "un virement"), (7, 9, "virement international")
    ]
    got = terms.find_phrases(texts, "id", "t", listed.limit(2), "p").orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(3, 6), (7, 9)]


def similarity(a, b):
    return 1 - distance(a.lower(), b.lower()) / max(len(a), len(b))


def similar_by_hand(text, phrases):
    words, out, i = text.lower().split(), [], 0
    while i < len(words):
        best = None
        for p in phrases:
            pw = p.lower().split()
            spoken = words[i : i + len(pw)]
            if len(spoken) < len(pw) or similarity(spoken[0], pw[0]) < 0.85:
                continue
            each = [similarity(a, b) for a, b in zip(spoken, pw)]
            mean = sum(each) / len(each)
            if min(each) >= 0.80 and mean >= 0.85:
                best = min(best or (1, 0, ""), (-mean, -len(pw), p))
        if best:
            out.append((i, i - best[1], best[2]))
            i -= best[1]
        else:
            i += 1
    return out


def test_similar_phrases(spark):
    rnd = random.Random(5)
    base = ["virement", "international", "compte", "courant", "credit", "carte", "bancaire"]
    phrases = sorted({" ".join(rnd.sample(base, rnd.randint(2, 3))) for _ in range(12)})
    texts = []
    for i in range(40):
        spoken = []
        for _ in range(12):
            w = rnd.choice(base)
            spoken.append(mutated(w, rnd) if rnd.random() < 0.3 else w)
        texts.append((i, " ".join(spoken)))
    got = terms.find_similar_phrases(
        spark.createDataFrame(texts, "id long, t string"), "id", "t",
        spark.createDataFrame([(p,) for p in phrases], "p string"), "p",
    ).collect()
    found = sorted((r.id, r.start, r.stop, r.phrase) for r in got)
    want = sorted((i, *hit) for i, t in texts for hit in similar_by_hand(t, phrases))
    assert found == want and len(want) > 20


def test_protected_words(spark):
    df = spark.createDataFrame([(1, "Bonjour Mme. dupont de BNP. Demain Paul vient")], "id long, t string")
    got = {r.word: r.reason for r in terms.protected_words(df, "id", "t").collect()}
    assert got == {
        "Mme.": "capitalised", "dupont": "after_honorific", "BNP.": "acronym", "Paul": "capitalised"
    }


def test_word_distance(spark):
    rnd = random.Random(11)
    pairs = [
        (i, " ".join(rnd.choices("abcde", k=rnd.randint(0, 12))), " ".join(rnd.choices("abcde", k=rnd.randint(0, 12))))
        for i in range(60)
    ]
    df = spark.createDataFrame(pairs, "i long, r string, h string")
    got = {r.i: (r.word_errors, r.char_errors) for r in evaluation.error_rates(df, "r", "h").collect()}
    assert got == {i: (distance(r.split(), h.split()), distance(r, h)) for i, r, h in pairs}


def test_semantic_rate_is_zero(spark):
    df = spark.createDataFrame([(1, "200 €", "deux cents euros"), (2, "M. Dupont", "monsieur dupont")],
                               "i long, r string, h string")

    def form(c):
        return tx.evaluation_form(tx.number_words_to_digits(tx.spoken_form(c)))

    assert [r.wer for r in evaluation.error_rates(df, "r", "h", form).collect()] == [0.0, 0.0]


# --------------------------------------------------------------------------- diarisation


def test_overlap_does_not_depend_on_slots(spark):
    rnd = random.Random(2)

    def segments(prefix):
        return [("d", f"{prefix}{rnd.randrange(3)}", s, s + rnd.uniform(0.1, 50)) for s in
                (rnd.uniform(0, 300) for _ in range(60))]

    ref, hyp = segments("r"), segments("h")
    schema = "k string, speaker string, start double, stop double"
    want = {}
    for _, a, s, e in ref:
        for _, b, s2, e2 in hyp:
            common = min(e, e2) - max(s, s2)
            if common > 0:
                want[(a, b)] = want.get((a, b), 0) + common
    for slot in (5.0, 60.0, 1000.0):
        got = evaluation.speaker_overlaps(
            spark.createDataFrame(ref, schema), spark.createDataFrame(hyp, schema), "k", slot
        )
        found = {(r.ref_speaker, r.hyp_speaker): r.overlap for r in got.collect()}
        assert found == pytest.approx(want)


def test_optimal_map_beats_greedy(spark):
    df = spark.createDataFrame(
        [("d", "Client", "HYP_1", 50.0), ("d", "Conseiller", "HYP_1", 40.0),
         ("d", "Client", "HYP_2", 45.0), ("d", "Conseiller", "HYP_2", 55.0)],
        "k string, ref_speaker string, hyp_speaker string, overlap double",
    )
    got = {r.hyp_speaker: r.ref_speaker for r in evaluation.optimal_speaker_map(df, "k").collect()}
    assert got == {"HYP_1": "Client", "HYP_2": "Conseiller"}


def test_best_assignment_against_all_orders():
    rnd = random.Random(1)
    for _ in range(50):
        rows, cols = rnd.randint(1, 5), rnd.randint(1, 5)
        gain = [[rnd.randint(0, 9) for _ in range(cols)] for _ in range(rows)]
        chosen = evaluation._best_assignment(gain)
        total = sum(gain[r][c] for r, c in enumerate(chosen) if c >= 0)
        wide = [row + [0] * rows for row in gain]
        best = max(
            sum(wide[r][c] for r, c in enumerate(p))
            for p in itertools.permutations(range(cols + rows), rows)
        )
        assert total == best


def nearest_in_turn(refs, hyps, tolerance=0.25):
    free, count = list(refs), 0
    for h in hyps:
        near = [(abs(h - r), r) for r in free if abs(h - r) <= tolerance + 1e-9]
        if near:
            free.remove(min(near)[1])
            count += 1
    return count


def largest_matching(refs, hyps, tolerance=0.25):
    """Augmenting paths over all pairs within the tolerance."""
    owner = {}

    def place(h, seen):
        for r, t in enumerate(refs):
            if abs(t - hyps[h]) <= tolerance + 1e-9 and r not in seen:
                seen.add(r)
                if r not in owner or place(owner[r], seen):
                    owner[r] = h
                    return True
        return False

    return sum(place(h, set()) for h in range(len(hyps)))


@pytest.mark.parametrize("mode, count", [("optimal", largest_matching), ("greedy", nearest_in_turn)])
def test_boundaries(spark, mode, count):
    """Long lines, dense lines with ties and repeated times, and lines of one side only."""
    rnd = random.Random(4)
    lines = {"long": ([round(rnd.uniform(0, 200), 2) for _ in range(150)], [round(rnd.uniform(0, 200), 2) for _ in range(150)])}
    for n in range(60):
        lines[f"dense{n}"] = tuple([rnd.randint(0, 24) / 8 for _ in range(rnd.randint(0, 12))] for _ in range(2))
    lines["b"] = ([], [1.0])
    r = spark.createDataFrame([(k, t) for k, v in lines.items() for t in v[0]], "k string, t double").repartition(3)
    h = spark.createDataFrame([(k, t) for k, v in lines.items() for t in v[1]] + [("long", None)], "k string, t double")
    found = evaluation.boundary_matches(r, h, "k", "t", 0.25, mode)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {x.k: (x.n_ref, x.n_hyp, x.matched) for x in found.collect()}
    want = {k: (len(v[0]), len(v[1]), count(sorted(v[0]), sorted(v[1]))) for k, v in lines.items() if v[0] or v[1]}
    assert got == want
    assert evaluation.boundary_matches(r.limit(0), h.limit(0), "k", "t", 0.25, mode).count() == 0


def test_boundary_mode_is_checked(spark):
    rows = spark.createDataFrame([("a", 1.0)], "k string, t double")
    with pytest.raises(ValueError):
        evaluation.boundary_matches(rows, rows, "k", "t", mode="other")


def test_vectors_of_words_are_not_needed_for_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "a b"), (2, "", "")], "i long, r string, h string")
    got = {r.i: (r.word_errors, r.wer) for r in evaluation.error_rates(df, "r", "h").collect()}
    assert got == {1: (2, None), 2: (0, None)}


def test_language_decision(spark):
    df = spark.createDataFrame(
        [("ok", 0.9), ("une phrase assez longue", 0.9), ("une phrase assez longue", 0.4),
         ("a sentence long enough", 0.1), ("a sentence long enough", 1e-9)], "t string, s double")
    made = tx.language_decision("t", "s")
    got = [r.d for r in df.select(made["decision"].alias("d")).collect()]
    assert got == ["undetermined", "french", "grey", "non_french", "undetermined"]


def test_response_guard(spark):
    made = tx.guarded_response("t")
    df = spark.createDataFrame([("**a**  b" + "x" * 1300,)], "t string")
    row = df.select(*[c.alias(n) for n, c in made.items()]).first()
    assert (len(row.response), row.truncated, row.full_length) == (1200, 1, 1303)
    assert row.response.startswith("a bx")


def test_filter_keeps_functions_native(spark):
    df = spark.createDataFrame([("a a",)], "t string").select(tx.smart_repetitions("t"), F.lit(1))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_many_corrections_in_one_text_and_texts_under_one_key(spark):
    """Each word gets its own correction, also where two rows share a key and their words."""
    right = [f"{a}{b}{c}lingen" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    wrong = [w[:-1] + "m" for w in right]
    glossary = spark.createDataFrame([(w,) for w in right], "term string")
    rows = [(1, " ".join(wrong)), (1, " ".join(wrong)), (2, "plain, words"), (None, wrong[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [tuple(r) for r in terms.corrected_texts(df, "id", "text", glossary).collect()]
    best = {r["word"]: r["term"] for r in terms.corrections(terms.distinct_words(df, "text"), glossary).collect()}
    assert len(best) == len(wrong)
    want = (1, " ".join(best[w] for w in wrong), len(wrong))
    assert sorted(got, key=str) == sorted([want, want, (2, "plain, words", 0), (None, wrong[0], 0)], key=str)
