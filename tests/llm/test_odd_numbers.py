"""Numbers at the ends of what doubles hold, in searched vectors and in tool arguments."""

import json
import math

import numpy as np
import pytest

from riskweave.llm import neighbours, tool_calls


def distance(a, b):
    return math.dist(a, b) if all(map(math.isfinite, (x - y for x, y in zip(a, b)))) else math.inf


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1.0, 1e300])
def test_vectors_of_any_size(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(n, (rng.normal(size=4) * scale).tolist()) for n in range(30)]
    rows += [(30 + n, [1e200, float(n), 1.0, 0.0]) for n in range(4)] + [(40 + n, [1e-200 * (n + 1), 0.0, 0.0, 0.0]) for n in range(4)]
    rows += [(50, [1.7e308] * 4), (51, [-1.7e308] * 4), (52, [1.0, 2.0, 3.0, 4.0]), (53, [1.0, 2.0, 3.0, 4.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<double>")
    got = {}
    for r in neighbours.nearest(df, "vec_id", "e", df["vec_id"] >= 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for n, v in rows:
        want = sorted((distance(v, w), m) for m, w in rows if m != n)[:5]
        found = sorted(got[n])
        assert [s for _, _, s in found] == pytest.approx([s for s, _ in want], rel=1e-12)
        # distances that only differ by rounding may trade places
        assert all(distance(v, dict(rows)[m]) == pytest.approx(s, rel=1e-12) for _, m, s in found)


def test_one_id_with_several_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 5.0]), (3, [0.0, 4.0]), (1, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<double>")
    got = neighbours.nearest(df, "vec_id", "e", df["vec_id"] == 1, 2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 1.0), (2, 3, 3.0)]
    got = neighbours.nearest(df, "vec_id", "e", df["vec_id"] == 3, 2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 1.0), (2, 2, 2.0)]


SCHEMA = {"t": {"type": "object", "properties": {"n": {"type": "number", "multipleOf": 0.5}}}}


@pytest.mark.parametrize("digits", ["1e999", "-1e999", "[1e400]", "1" + "0" * 400])
def test_numbers_out_of_range_are_a_fault(digits):
    value, fault = tool_calls.check_arguments("t", f'{{"n": {digits}}}', SCHEMA)
    assert fault == "arguments: number out of range" and json.loads(tool_calls.canonical(value)) == f'{{"n": {digits}}}'
    assert tool_calls.check_arguments("t", '{"n": 1e308}', SCHEMA)[1] is None


@pytest.mark.parametrize(
    "part", [{"multipleOf": 0}, {"multipleOf": "2"}, {"properties": []}, {"pattern": "("}, {"pattern": 3}, {"anyOf": {}}, {"required": "n"}]
)
def test_schemas_that_cannot_be_checked_are_refused(part):
    with pytest.raises(ValueError):
        tool_calls.checked_schema(part, "t")


def test_chunks_cut_after_words_and_keep_the_ids_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    from riskweave.llm import chunks, tokenizers_local

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    text = "Plain words, naïve café's 3x4-5 ab漢字 x y  tabs\t\nend."
    assert chunks._CHUNK.findall("ab, cd漢e (f) 漢g") == ["ab", ",", " cd漢e", " (f)", " 漢g"]
    assert "".join(chunks._CHUNK.findall(text)) == text
    encoder = tokenizers_local.json_encoder(path)
    for part in (text, " word", "word", " naïve", "Ünïted words"):
        assert encoder.ids(part).tolist() == whole.encode(part, add_special_tokens=False).ids
