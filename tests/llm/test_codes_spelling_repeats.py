"""Vector codes, spelling variants and repeats against plain Python, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from riskweave.llm import codes, repeats, spelling

VECTORS = "vec_id bigint, embedding array<double>, label int, code string, _row int"


# --- vector codes ---------------------------------------------------------------------------


def lloyd(rows, parts, entries, rounds):
    """(id, label, code, error) per usable row and the codebooks, in Python's whole numbers."""
    usable = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [[int(np.floor(1024 * x)) for x in r[1]] for r in usable]
    order = sorted(range(len(usable)), key=lambda i: (usable[i][0] is None, usable[i][0] or 0, whole[i]))
    size = len(whole[0]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for v in whole] for p in range(parts)]
    books = [[list(cut[p][i]) for i in order[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for part in cut[p]:
                members[nearest(part, books[p])[1]].append(part)
            books[p] = [
                [sum(c) // len(members[n]) for c in zip(*members[n])] if members[n] else e for n, e in enumerate(books[p])
            ]
    found = []
    for i, row in enumerate(usable):
        best = [nearest(cut[p][i], books[p]) for p in range(parts)]
        found.append((row[0], row[2], tuple(b[1] for b in best), sum(b[0] for b in best)))
    return found, books


def coded(df, parts, entries, rounds, owner_rows):
    out, books = codes.compressed(df, "vec_id", "embedding", "label", parts, entries, rounds, owner_rows)
    assert out.columns == ["vec_id", "label", "_row", "code", "error", "label_error"]
    return [(r["vec_id"], r["label"], tuple(r["code"]), int(r["error"]), int(r["label_error"])) for r in out.collect()], books


@pytest.mark.parametrize("owner_rows", [2, 4_096])
def test_codes_by_hand(spark, owner_rows):
    rng = random.Random(4)
    rows = [(n, [rng.uniform(-1, 1) for _ in range(8)], n % 3 if n % 7 else None) for n in range(60)]
    hot = [0.25, -0.25, 0.5, 0.0, 0.1, 0.1, 0.1, 0.1]
    rows += [(100 + n, hot, 1) for n in range(30)]  # a third of the rows is one vector
    rows += [(3, [rng.uniform(-1, 1) for _ in range(8)], 2), rows[5], rows[5], (None, hot, None)]
    rows += [(200, None, 1), (201, [None] * 8, 1), (202, [float("nan")] * 8, 1), (203, [1.0] * 7 + [float("inf")], 1)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], VECTORS).repartition(4)
    got, books = coded(df, 4, 16, 4, owner_rows)
    wanted, wanted_books = lloyd(rows, 4, 16, 4)
    sums = defaultdict(int)
    for r in wanted:
        sums[r[1]] += r[3]
    assert Counter(got) == Counter((*r, sums[r[1]]) for r in wanted)
    assert books == wanted_books


def test_large_components_stay_exact(spark):
    rows = [(n, [3.0e9 * n, -2.0e9 * n * n, 1.0 * n, 4.0e9], n) for n in range(9)]
    got, books = coded(spark.createDataFrame([(*r, "x", 9) for r in rows], VECTORS), 2, 3, 3, 4)
    wanted, wanted_books = lloyd(rows, 2, 3, 3)
    assert books == wanted_books and [r[:4] for r in sorted(got)] == sorted(wanted)


def test_code_tables_without_codes(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert coded(empty, 4, 16, 2, 10) == ([], [[], [], [], []])
    assert coded(spark.createDataFrame([(1, None, 1, "", 1)], VECTORS), 4, 16, 2, 10)[0] == []
    none, _ = coded(spark.createDataFrame([(1, [], 1, "", 1), (2, [], None, "", 1)], VECTORS), 4, 16, 2, 10)
    assert sorted(none) == [(1, 1, (0, 0, 0, 0), 0, 0), (2, None, (0, 0, 0, 0), 0, 0)]
    for vectors in ([[1.0] * 8, [1.0] * 4], [[1.0] * 6]):
        with pytest.raises(ValueError):
            coded(spark.createDataFrame([(n, v, 1, "", 1) for n, v in enumerate(vectors)], VECTORS), 4, 16, 2, 10)
    with pytest.raises(Exception, match="cannot be scaled"):
        coded(spark.createDataFrame([(1, [1e300] * 4, 1, "", 1)], VECTORS), 4, 16, 2, 10)


def test_only_members_that_change_entry_move(spark, monkeypatch):
    moved = []
    plain = codes._migrated
    monkeypatch.setattr(codes, "_migrated", lambda movers, n: (moved.append(movers.count()), plain(movers, n))[1])
    rng = np.random.default_rng(1)
    rows = [(n, (rng.normal(size=8) + 5 * (n % 4)).tolist(), 1, "", 1) for n in range(400)]
    codes.compressed(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", None, 4, 8, 4)[0].collect()
    assert moved[0] == 4 * 400 and len(moved) == 4 and all(m < 4 * 400 / 2 for m in moved[1:])


# --- spelling -------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts, ratio):
    found = {}
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in close.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        found[w] = (form.get(w), root, counts[w], len(close[w]), counts.get(form.get(w)))
    return found


def variants(df, ratio=5, group_words=spelling.GROUP_WORDS):
    rows = spelling.variants(df, ratio, group_words).collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("group_words", [1, 3, 4_096])
def test_variants_by_hand(spark, group_words):
    rng = random.Random(8)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 5, 10, 50, 50]) for _ in range(300)}
    counts |= {"x" * n: 5**n for n in range(1, 12)} | {"aaaaab": 10, "aaaab": 50, "y": 3, "z" * 3_000: 2, "z" * 2_999: 20}
    df = spark.createDataFrame([Row(word=w, n=n, form="x") for w, n in counts.items()])
    assert variants(df, 5, group_words) == variants_by_hand(counts, 5)


def test_variants_of_odd_tables(spark):
    schema = "word string, n bigint"
    assert variants(spark.createDataFrame([], schema)) == {}
    rows = [("word", 2), ("word", 3), (None, 4), ("", 9), ("words", None), ("wörds", 100), ("wrds", 1)]
    assert variants(spark.createDataFrame(rows, schema)) == variants_by_hand({"word": 5, "wörds": 100, "wrds": 1}, 5)
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], schema), 1)


def test_one_common_ending_is_cut_into_bounded_partitions(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcdefgh") for _ in range(6)) + "ation" for _ in range(2_000)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    parts = spelling._bounded_parts(df, 20).groupBy("m", "head", "tail").count()
    assert parts.agg({"count": "max"}).first()[0] <= 72  # at most 8 letters, and 64 pairs of letters, between
    assert variants(df, 5, 20) == variants_by_hand(dict.fromkeys(words, 5), 5)


def test_acceptor_is_minimal_and_accepts_its_strings():
    words = sorted({a + b + c for a in "abc" for b in "xy" for c in ("", "end", "ing")})
    machine = spelling.Acceptor(words)

    def accepted(state, before):
        return ([before] if machine.final[state] else []) + [
            w for letter, after in machine.moves[state].items() for w in accepted(after, before + letter)
        ]

    assert sorted(accepted(machine.start, "")) == words
    assert len(machine.moves) == 2 + 1 + 2 + 2 + 1  # start, after a/b/c, after x/y, inside "end" and "ing", the end


def test_misspelt_words_by_hand(spark):
    texts = ["Éclair éclair ECLAIR eclairs", None, "", "don't×stop÷now über", "abcdef " * 50_000, "a" * 3_000, "tiny words 123456 under_score"]
    rows = [(n, t) for n, t in enumerate(texts * 40)] + [(None, "keyless letters")] * 2
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    assert {r["word"]: r["n"] for r in spelling.misspelt_words(df, "doc_id", "text", 7).collect()} == counts
    assert spelling.misspelt_words(df.limit(0), "doc_id", "text", 7).collect() == []


# --- repeats --------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, chunk string, n_words int"


def repeats_by_hand(rows, words):
    """Rows in the order of (key, digest of the text for shared keys); equal rows in any order."""
    seen, found = set(), []
    for key, text in rows:
        parts = (text or "").encode().split()
        gone = set()
        for at in range(len(parts) - words + 1):
            window = tuple(parts[at : at + words])
            gone.update(range(at, at + words) if window in seen else ())
            seen.add(window)
        found.append((key, len(parts), len(gone), b" ".join(p for i, p in enumerate(parts) if i not in gone).decode()))
    return Counter(found)


def without_repeats(df, words, shortest, chunk_bytes):
    out = repeats.without_repeats(df, "doc_id", "text", words, shortest, chunk_bytes)
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect())


def passages():
    rng = random.Random(6)
    words = [f"w{n}" for n in range(400)]

    def text(n):
        return [rng.choice(words) for _ in range(n)]

    shared, rows = text(30), []
    for n in range(60):
        parts = text(rng.randint(0, 40))
        if n % 3 == 0:
            at = rng.randint(0, len(parts))
            parts[at:at] = shared[rng.randint(0, 8) : rng.randint(22, 30)]
        rows.append((n * 7 % 61, " ".join(parts)))
    rows += [(100 + n, rows[4][1]) for n in range(40)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "same " * 60), (205, "a b " * 30), (206, "same " * 60)]
    rows += [(207, "x\x85y z é" * 9), (208, " ".join(text(20_000))), (-5, rows[3][1]), (300, "long " + "y" * 200_000)]
    return rows


@pytest.mark.parametrize(("words", "shortest", "chunk_bytes"), [(20, 5, 300), (20, 5, 4 << 20), (7, 2, 900), (1, 5, 400), (5, 5, 100)])
def test_repeats_by_hand(spark, words, shortest, chunk_bytes):
    rows = passages()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    assert without_repeats(df, words, shortest, chunk_bytes) == repeats_by_hand(sorted(rows, key=lambda r: r[0]), words)


def test_repeats_of_shared_and_missing_keys(spark):
    one, two = " ".join(f"a{n}" for n in range(30)), " ".join(f"a{n}" for n in range(5, 40))
    rows = [(7, one), (7, one), (7, two), (None, two), (8, one)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    got = [without_repeats(df, 10, 5, size) for size in (10, 1 << 20)]
    assert got[0] == got[1]
    # the null key comes first; of the rows of key 7 the order is that of digests, and copies leave one
    assert (None, 35, 0, two) in got[0] and (8, 30, 30, "") in got[0]
    assert sum(got[0].values()) == 5 and sorted(n for (k, _, n, _) in got[0].elements() if k == 7)[-2:] == [30, 35]


def test_repeats_of_empty_tables_and_refused_names(spark):
    assert without_repeats(spark.createDataFrame([], DOCS), 20, 5, 100) == Counter()
    unique = spark.createDataFrame([(1, "a b c d e f g", "", 1), (2, "h i j k l m", "", 1)], DOCS)
    assert without_repeats(unique, 4, 2, 5) == repeats_by_hand([(1, "a b c d e f g"), (2, "h i j k l m")], 4)
    with pytest.raises(ValueError):
        repeats.without_repeats(unique, "n_words", "text")


def test_levels_double():
    assert repeats.level_lengths(20) == [5, 10, 20]
    assert repeats.level_lengths(50) == [4, 7, 13, 25, 50] and repeats.level_lengths(3) == [3]


def test_a_level_looks_only_at_what_the_level_before_has_left(spark, monkeypatch):
    asked = []
    plain = repeats._write_answers
    monkeypatch.setattr(repeats, "_write_answers", lambda df, f, p, n: (asked.append(df.agg({"n": "sum"}).first()[0]), plain(df, f, p, n))[1])
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choices([f"w{i}" for i in range(900)], k=200)), "", 1) for n in range(50)]
    rows += [(99, rows[0][1], "", 1)]
    without_repeats(spark.createDataFrame(rows, DOCS), 20, 5, 2_000)
    assert len(asked) == 3 and asked[0] > 9_000 and asked[1] < 500 and asked[2] < 500


def test_digest_of_codebooks():
    assert codes.codebooks_digest([[[1, -2], [3, 4]], [[5, 6]]]) == hashlib.sha256(b"1,-2,3,4,5,6").hexdigest()
