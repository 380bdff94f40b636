"""The operators against plain Python on small tables with nulls, ties, copies and odd texts."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import (
    bpe, components, decision_list, main_text, mixing, neighbours, packed_ids, queries, sharding, simhash,
    token_counts, tool_calls,
)
from riskweave.llm.tokenizers_local import rank_encoding

RANKS = public_tokenizers.path(queries.RANK_FILE)
PLAIN = public_tokenizers.path(queries.PLAIN_RANK_FILE)
JSON = public_tokenizers.path(queries.JSON_FILE)
SCHEMA = "doc_id bigint, text string, source string, shard string, slot string, tile string, ids string, bytes string, file string"

LONG = "word one two, " * 9_000 + " " * 3_000 + "\n" * 2_000 + "x" * 5_000 + "é" * 70_000
TEXTS = [
    "the quick brown fox jumps over the lazy dog", "The QUICK brown fox jumps over the lazy dog", None, "", "   ",
    "one", "one two", "one two three", "one  two\tthree", "a" * 400, "<|endoftext|> is text", LONG, LONG,
    "line\nline\nline two\n\nÉté à l'île…", "it's we'll they've 123456 !!!??", "\x1c\x1d odd \x85 spaces   x",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [Row(n, t, "abc"[n % 3] if n % 5 else None, "s", "s", "s", "s", "s", "s") for n, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], rows[0], Row(None, "no key", "a", *"ssssss"), Row(None, "no key", "a", *"ssssss")]
    rows.append(Row(7, "another text for key seven", "b", *"ssssss"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- sharding -------------------------------------------------------------------------------


def shard_by_hand(key, weights):
    def score(n):
        digest = hashlib.md5(f"{'' if key is None else key}#{n}".encode()).hexdigest()
        return -weights[n] / np.log((int(digest[:13], 16) + 0.5) / 16**13)

    return max(range(len(weights)), key=lambda n: (score(n), -n))


def test_shards_by_hand(spark):
    weights = [1.0, 2.0, 0.5, 4.0, 1.0]
    got = sharding.with_shard(spark.range(500), "id", weights).collect()
    assert all(r["shard"] == shard_by_hand(r["id"], weights) for r in got)


def test_shard_shares_follow_weights(spark):
    weights = [1.0, 2.0, 5.0]
    got = Counter(r["shard"] for r in sharding.with_shard(spark.range(20_000), "id", weights).collect())
    for n, w in enumerate(weights):
        assert abs(got[n] / 20_000 - w / 8) < 0.02


def test_one_more_shard_takes_rows_only_into_itself(spark):
    a, b = [1.0] * 10, [1.0] * 11
    rows = spark.range(5_000).select(
        sharding.shard_of(F.col("id"), a).alias("a"), sharding.shard_of(F.col("id"), b).alias("b")
    ).collect()
    assert all(r["b"] in (r["a"], 10) for r in rows)
    assert 0.05 < sum(r["b"] == 10 for r in rows) / 5_000 < 0.13


def test_slots_are_gapless_and_rows_whole(docs, empty):
    describe = {"size": F.coalesce(F.octet_length("text"), F.lit(0))}
    got = sharding.shard_slots(docs, "doc_id", [1.0] * 4, describe).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter(
        (k, len((t or "").encode())) for k, t in plain(docs)
    )
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_slots(empty, "doc_id", [1.0], describe).count() == 0


def test_shard_weights_must_be_positive():
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [1.0, 0.0])


# --- byte-level BPE -------------------------------------------------------------------------


def whole(text, path=RANKS):
    return rank_encoding(path, public_tokenizers.PATTERN).encode_ordinary(text or "")


def test_round_trip(docs, empty):
    got = bpe.round_trip(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()
    want = Counter()
    for key, text in plain(docs):
        ids = whole(text)
        want[(
            key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe.round_trip(empty, "doc_id", "text", RANKS, public_tokenizers.PATTERN).count() == 0


def test_encode_and_decode_keep_other_columns(docs):
    coded = bpe.encode(docs, "text", RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, "ids", RANKS, public_tokenizers.PATTERN)
    assert set(back.columns) == set(docs.columns)
    for r in back.select("text", "ids", "bytes", "file").collect():
        assert r["ids"] == whole(r["text"]) and bytes(r["bytes"]) == (r["text"] or "").encode() and r["file"] == "s"


def test_white_space_too_long_for_the_library(spark):
    df = spark.createDataFrame([(1, " " * 1_200_000 + "end")], "doc_id int, text string")
    row = bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN).first()
    assert rank_encoding(RANKS, public_tokenizers.PATTERN).decode(row["ids"]) == " " * 1_200_000 + "end"


# --- SimHash --------------------------------------------------------------------------------


def print_by_hand(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_fingerprints_by_hand():
    for text in TEXTS[:11] + ["x y z " * 50, "É É é A a Z"]:
        assert simhash.fingerprint(text) == print_by_hand(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def prints_near(random, n):
    base = random.integers(0, 2**63, n, dtype=np.uint64)
    near = base[: n // 2] ^ np.uint64(1) << random.integers(0, 64, n // 2, dtype=np.uint64)
    far = near[: n // 4] ^ np.uint64(1) << random.integers(0, 64, n // 4, dtype=np.uint64)
    chain = far[: n // 8] ^ np.uint64(3) << random.integers(0, 62, n // 8, dtype=np.uint64)
    return np.unique(np.concatenate([base, near, far, chain, [np.uint64(0), np.uint64(2**64 - 1), np.uint64(5)]]))


@pytest.mark.parametrize("block_rows", [1, 7, 65_536])
def test_links_connect_what_all_pairs_connect(spark, block_rows):
    prints = prints_near(np.random.default_rng(3), 120)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp bigint")
    found = simhash.links(df, 2, block_rows).collect()
    unsigned = lambda x: x & (2**64 - 1)
    assert all((unsigned(r["a"]) ^ unsigned(r["b"])).bit_count() <= 4 for r in found)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(found, "a bigint, b bigint")).collect()}
    want = classes_by_hand([int(p) for p in prints.view(np.int64)], lambda a, b: (unsigned(a) ^ unsigned(b)).bit_count() <= 2)
    assert all(got.get(n, n) == r for n, r in want.items())


def test_near_pairs_in_strips(monkeypatch):
    monkeypatch.setattr(simhash, "STRIP_ROWS", 5)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 64)
    prints = prints_near(np.random.default_rng(5), 200)
    left, right = prints[::2], prints[1::2]
    i, j = simhash.near_pairs(left, right, 2)
    got = set(zip(left[i].tolist(), right[j].tolist()))
    assert got == {(a, b) for a in left.tolist() for b in right.tolist() if (a ^ b).bit_count() <= 2}


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs, "doc_id", "text").collect()
    rows = [(k, print_by_hand(t)) for k, t in plain(docs)]
    roots = classes_by_hand({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for k, f in rows:
        if k is not None:
            first[roots[f]] = min(k, first.get(roots[f], k))
    want = Counter((k, f, first.get(roots[f])) for k, f in rows)
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component"]) for r in got) == want
    assert simhash.near_duplicates(empty, "doc_id", "text").count() == 0
    kept = simhash.kept_documents(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    keys = [r["doc_id"] for r in kept.collect()]
    assert sorted(keys, key=str) == sorted([*first.values(), *[None] * (len(set(roots.values())) - len(first))], key=str)
    assert simhash.kept_documents(empty, "doc_id", "text").count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(n, n + 1) for n in range(0, 60)]
    star = [(1_000, n) for n in range(1_001, 1_040)] + [(1_500, n) for n in range(1_400, 1_440)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain + star + [(7_000, 7_000)], "a bigint, b bigint")).collect()}
    assert {got[n] for n in range(61)} == {0} and {got[n] for n in range(1_000, 1_040)} == {1_000}
    assert {got[n] for n in [*range(1_400, 1_440), 1_500]} == {1_400} and got[7_000] == 7_000
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- token files ----------------------------------------------------------------------------


def test_token_counts(docs, empty):
    got = token_counts.document_token_counts(docs, "doc_id", "text", PLAIN, public_tokenizers.PATTERN, queries.FLAT_END_ID)
    want = Counter((k, len(whole(t, PLAIN))) for k, t in plain(docs))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.document_token_counts(empty, "doc_id", "text", PLAIN, public_tokenizers.PATTERN, 50_256).count() == 0


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_documents_that_span_blocks(spark, tmp_path, block_bytes):
    random = np.random.default_rng(1)
    files, want = [], set()
    for n in range(4):
        ids = random.integers(0, 5, 200).astype("<u2")
        ids[50:120] = 1  # one document over many blocks
        if n == 3:
            ids[:] = 2  # no end at all
        path = str(tmp_path / f"{n}.bin")
        ids.tofile(path)
        files.append((path, 2 * len(ids)))
        start, ordinal = 0, 0
        for at in np.flatnonzero(ids == 0).tolist():
            want.add((path, ordinal, start, at - start, True))
            start, ordinal = at + 1, ordinal + 1
        if start < len(ids):
            want.add((path, ordinal, start, len(ids) - start, False))
    files.append((str(tmp_path / "none.bin"), 0))
    df = spark.createDataFrame(files, "file string, file_bytes bigint")
    got = [tuple(r) for r in token_counts.count_tokens(df, 0, 50_000, block_bytes).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 24, 31, 32])
def test_packing(width):
    random = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 1_000):
        ids = random.integers(0, 2**width, n, dtype=np.uint64).astype("<u4")
        data = packed_ids.pack(ids, width)
        assert len(data) == (n * width + 7) // 8
        assert packed_ids.unpack(data, width, n).tolist() == ids.tolist()
        assert int.from_bytes(data, "little") == sum(int(x) << width * i for i, x in enumerate(ids))
    if width < 32:
        with pytest.raises(ValueError):
            packed_ids.pack(np.array([2**width], "<u4"), width)


@pytest.mark.parametrize("width", [9, 16, 17])
def test_random_access(tmp_path, monkeypatch, width):
    monkeypatch.setattr(packed_ids, "BLOCK_IDS", 16)
    random = np.random.default_rng(2)
    documents = [random.integers(0, 2**width, n).astype("<u4") for n in (0, 5, 16, 300, 0, 1, 31, 64)]
    path = str(tmp_path / "x.bin")
    writer = packed_ids.PackedWriter(path, width)
    for n, d in enumerate(documents):
        writer.add(None if n == 2 else n, d)
    assert writer.close() == (len(documents), sum(map(len, documents)))
    reader = packed_ids.PackedReader(path)
    flat = np.concatenate(documents).tolist()
    for n, d in enumerate(documents):
        assert reader.document(n).tolist() == d.tolist()
    for a, b in ((0, 417), (15, 17), (16, 32), (400, 417), (3, 3)):
        assert reader.ids(a, b).tolist() == flat[a:b]
    seen = defaultdict(list)
    for n, at, ids in reader.runs(blocks=1):
        seen[n] += ids.tolist()
    assert [seen[n] for n in range(len(documents))] == [d.tolist() for d in documents]
    assert reader.null_keys.tolist() == [n == 2 for n in range(8)]


def test_packed_round_trip(docs, empty):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    got = packed_ids.packed_round_trip(docs, "doc_id", "text", JSON, 0).collect()
    want = Counter()
    for key, text in plain(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[(key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1].tolist()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert keys == sorted(keys)
    assert packed_ids.packed_round_trip(empty, "doc_id", "text", JSON, 0).count() == 0


# --- neighbours -----------------------------------------------------------------------------


def nearest_by_hand(rows, step, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in rows:
        if q % step == 0:
            near = sorted((float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))), i) for i, b in rows if i != q and len(a) == len(b))
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(2, 7), (1_024, 16_384)])
@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e6])
def test_nearest(spark, sizes, scale, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 13)
    random = np.random.default_rng(4)
    rows = [(n, [float(np.float32(x * scale)) for x in random.normal(size=6)]) for n in range(90)]
    rows += [(200 + n, rows[n % 3][1]) for n in range(15)]  # ties
    rows += [rows[0], rows[0], rows[50], (300, [0.0] * 6), (310, None), (320, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (330, [float("nan")] * 6)]
    rows += [(340, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6), (350, [1.0, 2.0]), (400, [1.0, 2.5]), (401, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank string, score int")
    got = neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, *sizes).collect()
    want = nearest_by_hand(rows, 50, 5)
    got = sorted(tuple(r) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).count() == 0


# --- mixing ---------------------------------------------------------------------------------


def test_mix_is_a_schedule_within_windows(spark):
    sizes = {"a": 333, "b": 70, "c": 5, None: 41, "": 3}
    rows = [(n, s) for s, size in sizes.items() for n in range(size)]
    df = spark.createDataFrame([(i, s, "t") for i, (_, s) in enumerate(rows)], "doc_id bigint, source string, slot string")
    weights, block = {"a": 5, "b": 3}, 4
    got = mixing.mixed(df, "doc_id", "source", weights, 2, block).collect()
    assert sorted((r["doc_id"], r["source"] or "") for r in got) == sorted((i, s or "") for i, (_, s) in enumerate(rows))
    slots = {}
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
        assert slots.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    assert sorted(slots) == list(range(sum(-(-n // block) for n in sizes.values())))
    places = defaultdict(list)
    for r in got:
        places[r["slot"]].append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # Less than one block from the share after every slot of the periods that all sources fill.
    share = {s: weights.get(s, 2) for s in sizes}
    period, blocks = sum(share.values()), Counter()
    whole_periods = min(-(-n // block) // share[s] for s, n in sizes.items())
    for t in range(whole_periods * period):
        blocks[slots[t][0]] += 1
        assert all(abs(blocks[s] - share[s] * (t + 1) / period) < 1 for s in sizes)


def test_mixed_copies_and_order(docs, empty):
    got = mixing.mixed(docs, "doc_id", "source", {"a": 2}, 1, 3).collect()
    assert sum(r["copies"] for r in got) == docs.count()
    out = mixing.in_mixed_order(docs, "doc_id", "source", {"a": 2}, 1, 3)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
    order = {(r["doc_id"], r["source"]): (r["slot"], r["place"]) for r in got}
    seen = [order[(r["doc_id"], r["source"])] for r in out.collect()]
    assert seen == sorted(seen)
    assert mixing.mixed(empty, "doc_id", "source", {}, 1).count() == 0
    assert mixing.in_mixed_order(empty, "doc_id", "source", {}, 1).count() == 0
    with pytest.raises(ValueError):
        mixing.weight_of(F.lit("a"), {"a": 0}, 1)


# --- main text ------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script>{head}
<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><h1>Title &amp; more</h1><p>First   paragraph
with <b>bold</b> text&nbsp;here and a good deal of further words to read.<br>Line<p>Unclosed &lt;b&gt; paragraph<aside>Read also</aside>
<form><label>Mail</label><input></form><p>Of.</p><section id="comments"><p>First!</p></section></article>
<aside>Side</aside><div class="ad">Buy now, buy a lot of things now, this is a long advert indeed</div><footer>&copy; x</footer></body></html>"""
WANT = "Title & more\n\nFirst paragraph with bold text here and a good deal of further words to read. Line\n\nUnclosed <b> paragraph\n\nOf."


@pytest.mark.parametrize("head", ["</head>", ""])
def test_article(head):
    assert main_text.main_text(PAGE.replace("{head}", head)) == WANT


def test_page_without_article():
    menu = "".join(f"<li><a href=/{n}>Item {n}</a></li>" for n in range(20))
    body = "".join(f"<p>{'some plain words of a text ' * 12}{n}</p>" for n in range(8))
    got = main_text.main_text(f"<html><body><ul>{menu}</ul><div>{body}</div><ul>{menu}</ul></body></html>")
    assert [x.split()[-1] for x in got.split("\n\n")][:8] == [str(n) for n in range(8)] and "Item 5" not in got


def test_uneven_paragraphs_without_article():
    sizes = (60, 300, 250, 40, 280, 300, 200, 260, 310, 2500, 300, 200)
    texts = [f"{n} ".ljust(size, "x") for n, size in enumerate(sizes)]
    menu = "<ul>" + "".join(f"<li><a href=/{n}>Item {n}</a></li>" for n in range(20)) + "</ul>"
    body = "".join(f"<p>{t}</p>" for t in texts)
    for page in (body, f"<body>{body}", f"{menu}<div>{body}</div>{menu}", f"<body>{menu}{body}{menu}</body>"):
        assert main_text.main_text(page) == "\n\n".join(texts)
    apart = "".join(f"<div><p>{t}</p></div>" for t in (*texts, "y" * 5_000))
    assert main_text.main_text(f"{menu}<div>{apart}</div>{menu}") == "\n\n".join([*texts, "y" * 5_000])
    # Headings, short list items and a lone link stay in place.
    title = "A heading of some sixty characters above all the paragraphs"
    parts = f"<h2><a href=/>Part</a></h2><p>{'b' * 300}</p><ul><li>one</li><li>two</li></ul><p><a href=/>See</a></p><p>{'c' * 300}</p>"
    eight = "".join(f"<p>{'a' * 300}</p>" for _ in range(8))
    want = "\n\n".join([title, *["a" * 300] * 8, "Part", "b" * 300, "one", "two", "See", "c" * 300])
    assert main_text.main_text(f"<div><h1>{title}</h1>{eight}{parts}</div>") == want
    assert main_text.main_text(f"{menu}<h2>{title}</h2><div>{eight}{parts}</div>{menu}") == want
    assert main_text.main_text(f"{menu}<h1>{title}</h1><p>By x</p><div>{eight}{parts}</div>{menu}") == want.replace(title, title + "\n\nBy x")


def test_every_article_stays():
    assert main_text.main_text("<article>one</article><article>two</article>") == "one\n\ntwo"
    long = "l" * 3_000
    page = f"<article><p>{long}</p><p>{long}</p></article><div>apart</div><article><p>short</p></article><main><h2>m</h2></main>"
    assert main_text.main_text(page) == f"{long}\n\n{long}\n\nshort\n\nm"
    assert main_text.main_text(f"<article><a href=/>Next</a> &raquo;</article>{page}") == f"{long}\n\n{long}\n\nshort\n\nm"
    assert main_text.main_text("<p>x</p><article><a href=/>A</a></article><article><a href=/>B</a></article>") == "A\n\nB"


def test_parts_are_left_out_by_whole_names():
    text = main_text.main_text
    for part in ("div class='content-sidebar-wrap'", "div class='container has-sidebar'", "div class=no-sidebar", "div class='sidebar'", "form", "div hidden", "aside"):
        tag = part.split()[0]
        assert text(f"<{part}><article><h1>A</h1><p>b</p></article></{tag}>") == "A\n\nb"
        assert text(f"<main><h1>A</h1><{part}><article>b</article></{tag}></main>") == "A\n\nb"
    article = "<h1>A</h1><h2 id='related-work'>B</h2><h3 id=related>C</h3><section id='social-history'><p>d</p></section>"
    assert text(f"<article>{article}<p class='share'>no</p></article>") == "A\n\nB\n\nC\n\nd"
    # A form around the page is the page; a small one is not.
    page = f"<h1>A</h1><p>{'b' * 90}</p><label>Mail</label>"
    assert text(f"<body><form id=aspnetForm>{page}</form><p>&copy;</p></body>") == f"A\n\n{'b' * 90}"
    assert text(f"<article>{page}<form><p>Subscribe</p><input></form></article>") == f"A\n\n{'b' * 90}"
    # Articles of comment lists are the readers' own.
    replies = "<section id=comments><article>First!</article></section>"
    assert text(f"<article>A{replies}</article>{replies}") == "A" and text(replies) == "First!"


def test_start_tags_end_open_parts():
    text = main_text.main_text
    assert text("<article><p class=notice>x<p>A</p><p>B</p></article>") == "A\n\nB"
    assert text("<article><p class=notice>x<section>A</section>B</article>") == "A\n\nB"
    assert text("<article><ul><li class=ad>x<ul><li>y</ul><li>A<li><p class=ad>x<li>B</ul><p>C</article>") == "A\n\nB\n\nC"
    assert text("<article><dl><dt class=ad>x<dd>A<dt>B</dl><table><tr><td class=ad><div>x<td>C<tr class=ad><td>x<tr><td>D</table></article>") == "A\n\nB\n\nC\n\nD"
    assert text("<article><p>A <span class=notice>x</span> b <b>c</b></p></article>") == "A b c"


def test_odd_pages(spark):
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<p></p><!-- x") == ""
    assert main_text.main_text("<article>one</article><article>two</article>") in ("one\n\ntwo", "one", "two")
    assert len(main_text.main_text("<article><p>" + "w " * 200_000 + "</p></article>")) == 399_999
    assert main_text.main_text("<div>" * 3_000 + "deep") == "deep"
    df = spark.createDataFrame([(1, PAGE.replace("{head}", "</head>"), "old"), (1, None, "old"), (2, "", None)], "page_id int, html string, text string")
    got = main_text.extract(df, "html")
    assert got.columns == ["page_id", "text"] and Counter(r["text"] for r in got.collect()) == Counter([WANT, "", ""])
    assert main_text.extract(df.limit(0), "html").count() == 0


# --- quality rules --------------------------------------------------------------------------


def statistics_by_hand(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_statistics():
    texts = TEXTS + ["a b c a b c a b", "x x x x x", "a\na\n \n \nb\na", "# * $ % & | < > ok", "a b a b a b c a b a"]
    for text in texts:
        assert decision_list.statistics(text) == statistics_by_hand(text)


def test_rules_are_learned_and_pruned():
    random = np.random.default_rng(0)
    x = np.c_[random.integers(50, 500, 3_000), random.normal(5, 0.3, 3_000), random.random((3_000, 3))]
    bad = ((x[:, 2] > 0.7) & (x[:, 0] < 200)) | (x[:, 1] > 5.8)
    train, held = slice(0, 2_000), slice(2_000, None)
    rules = decision_list.fit(x[train], bad[train])
    met = np.zeros(1_000, bool)
    for rule in rules:
        met |= decision_list.holds(rule, x[held])
    assert (met == bad[held]).mean() > 0.98 and all(str(c) for rule in rules for c in rule)
    noise = random.random(2_000) < 0.05
    assert decision_list.fit(random.random((2_000, 5)), noise) == []
    assert decision_list.fit(np.empty((0, 5)), np.empty(0, bool)) == []


def test_judged_on_the_given_labels(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (queries.table(spark, folder, t) for t in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    found = decision_list.judged(documents.select("doc_id", "text"), even, "doc_id", "text")
    odd = found.join(labels.where("doc_id % 2 = 1"), "doc_id").select("_base_failed", "_kept", "quality").collect()
    passed = [r for r in odd if not r["_base_failed"]]
    assert np.mean([r["_kept"] == (r["quality"] == 1) for r in passed]) > 0.98
    assert not any(r["_kept"] for r in odd if r["_base_failed"])


def test_judged_without_labels_and_rows(docs, empty, spark):
    labels = spark.createDataFrame([(None, 0), (3, None)], "doc_id bigint, quality int")
    found = decision_list.judged(docs, labels, "doc_id", "text")
    assert found.count() == docs.count() and set(docs.columns) <= set(found.columns)
    assert all(r["_kept"] == (not r["_base_failed"]) for r in found.collect())
    assert decision_list.judged(empty, labels, "doc_id", "text").count() == 0


def test_verdict_is_ordered_and_matches_numpy(spark):
    rules = [
        (decision_list.Condition(0, True, 10.0), decision_list.Condition(2, False, 0.5)),
        (decision_list.Condition(1, True, 3.0),),
    ]
    x = np.random.default_rng(1).random((200, 5)) * [20, 5, 1, 1, 1]
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double, e double")
    got = [r["v"] for r in df.select(decision_list.verdict(rules, [F.col(c) for c in "abcde"]).alias("v")).collect()]
    assert got == [not (decision_list.holds(rules[0], x[[i]])[0] or decision_list.holds(rules[1], x[[i]])[0]) for i in range(200)]


# --- tool calls -----------------------------------------------------------------------------

MESSAGES = "conversation string, turn bigint, role string, kind string, call_id string, after string, tool string, arguments string, content string, level string"


def message(conversation, turn, kind, call_id=None, after=None, tool=None, arguments=None, content=None):
    return (conversation, turn, {"call": "user", "result": "assistant"}.get(kind, "system"), kind, call_id, after, tool, arguments, content, "x")


def test_links_levels_and_faults(spark):
    good = '{"limit": 3, "query": "é"}'
    rows = [
        message("c", 0, "text", content="hello"),
        message("c", 9, "call", "a", None, "search", good), message("c", 1, "result", "a", content="r"),
        message("c", 2, "call", "b", "a", "search", '{"limit": 0, "query": "x"}'), message("c", 3, "result", "b", content=None),
        message("c", 4, "call", "d", "b", "search", "{bad"), message("c", 5, "result", "d", content="r"),
        message("c", 6, "call", "e", "zz", "nothing", "{}"), message("c", 7, "result", "e", content="r"),
        message("c", 8, "call", "f", None, "search", good), message("c", 8, "result", "lost", content="r"),
        message("k", 0, "call", "x", "y", "search", good), message("k", 1, "call", "y", "x", "search", good),
        message("k", 2, "result", "x"), message("k", 3, "result", "y"), message("k", 4, "call", "z", "y", "search", good), message("k", 5, "result", "z"),
        message("t", 0, "call", "a", None, "search", good), message("t", 0, "call", "a", None, "search", good), message("t", 1, "result", "a"),
        message("t", 2, "call", None, None, "search", good), message(None, 2, "call", "a", None, "search", good),
        message("u", 0, "call", "a", None, "search", '{"limit": true, "query": "x", "more": 1}'), message("u", 1, "result", "a"),
    ]
    got = {}
    for r in tool_calls.link_calls(spark.createDataFrame(rows, MESSAGES), queries.TOOL_SCHEMAS).collect():
        got.setdefault((r["conversation"], r["turn"], r["kind"]), []).append((r["level"], r["fault"], r["line"]))
    assert sum(map(len, got.values())) == len(rows)
    level_fault = {k: (v[0][0], v[0][1]) for k, v in got.items()}
    assert level_fault[("c", 0, "text")] == (None, None)
    assert level_fault[("c", 9, "call")] == (0, None) and level_fault[("c", 1, "result")] == (0, None)
    assert level_fault[("c", 2, "call")] == (1, "$.limit: below minimum")
    assert level_fault[("c", 4, "call")] == (2, "arguments: not JSON") and level_fault[("c", 5, "result")] == (2, None)
    assert level_fault[("c", 6, "call")] == (0, "dangling")
    assert level_fault[("c", 8, "call")] == (0, "call: no result") and level_fault[("c", 8, "result")] == (None, "result: no call")
    assert {level_fault[("k", t, k)] for t, k in ((0, "call"), (1, "call"), (4, "call"), (5, "result"))} == {(None, "cycle")}
    assert level_fault[("t", 0, "call")] == (0, "identifier: used twice") and len(got[("t", 0, "call")]) == 2
    assert level_fault[("t", 2, "call")] == level_fault[(None, 2, "call")] == (None, "identifier: missing")
    assert level_fault[("u", 0, "call")][1] == "$.more: unknown"
    assert got[("c", 9, "call")][0][2] == '{"arguments":{"limit":3,"query":"é"},"id":"a","role":"user","tool":"search"}'
    assert tool_calls.link_calls(spark.createDataFrame([], MESSAGES), {}).count() == 0


SCHEMA_CASES = [
    ({"type": ["string", "null"]}, [None, "a"], [1]),
    ({"pattern": "^a+$"}, ["aa", 3], ["ab"]),
    ({"const": 1}, [1, 1.0], [True, 2]),
    ({"enum": [0, "a"]}, [0, "a"], [False, "b"]),
    ({"exclusiveMinimum": 0, "exclusiveMaximum": 2}, [1], [0, 2]),
    ({"multipleOf": 0.1}, [0.3, 2], [0.35, float("inf")]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "integer"}}, [[1], [1, 2]], [[], [1, 2, 3], [1, 1], ["a"]]),
    ({"minProperties": 1, "additionalProperties": {"type": "integer"}}, [{"a": 1}], [{}, {"a": "b"}]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 4], [2]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 4], [2]),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}], "not": {"const": 2}}, [1, 3], [0, 2, 4]),
]


@pytest.mark.parametrize("schema, good, bad", SCHEMA_CASES)
def test_schema_keywords(schema, good, bad):
    tool_calls.checked_schema(schema, "t")
    assert not any(tool_calls.faults(v, schema) for v in good) and all(tool_calls.faults(v, schema) for v in bad)


def test_unknown_schema_keywords_are_refused(spark):
    messages = spark.createDataFrame([], MESSAGES)
    for part in ({"$ref": "#/x"}, {"format": "date"}, {"type": "text"}, {"type": [["string"]]}, {"anyOf": [{"if": {}}]}):
        with pytest.raises(ValueError):
            tool_calls.link_calls(messages, {"t": {"properties": {"a": part}}})


def test_long_chain_is_ordered(spark):
    n = 300
    rows = [message("c", n - i, "call", str(i), str(i - 1) if i else None, "search", "{}") for i in range(n)]
    got = {r["call_id"]: r["level"] for r in tool_calls.link_calls(spark.createDataFrame(rows, MESSAGES), {}).collect()}
    assert got == {str(i): i for i in range(n)}


def test_canonical_json():
    assert tool_calls.canonical({"b": [1, {"z": None, "a": "é\n"}], "a": 1.5}) == '{"a":1.5,"b":[1,{"a":"é\\n","z":null}]}'
    assert tool_calls.canonical("\ud800é") == '"\\ud800\\u00e9"'
    assert tool_calls.check_arguments("search", '{"limit": NaN}', {})[1] == "arguments: not JSON"
