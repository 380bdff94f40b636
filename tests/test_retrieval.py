import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.functions import vectors
from riskweave.operators import evaluation, quality, retrieval, search

rng = np.random.default_rng(5)


@pytest.fixture(scope="module")
def table(spark):
    v = rng.normal(size=(300, 8))
    v[10] = v[11]  # equal vectors tie
    v[20] = 0
    pdf = pd.DataFrame({"id": np.arange(300), "v": [row.tolist() for row in v]})
    return v, spark.createDataFrame(pdf, "id long, v array<float>").repartition(6)


def by_hand(v, k):
    f = v.astype(np.float32).astype(float)
    n = np.linalg.norm(f, axis=1)
    unit = f / np.where(n > 0, n, 1)[:, None]
    s = np.round(unit @ unit.T, 6)
    out = {}
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[i, j], j))[:k]
        out[i] = order
    return out


def ranked(hits):
    got = {}
    for h in sorted(hits.collect(), key=lambda h: h["rank"]):
        got.setdefault(h.query_id, []).append(h.corpus_id)
    return got


@pytest.mark.parametrize("block_rows", [None, 7, 40])
def test_blocks_are_exact(spark, table, block_rows, monkeypatch):
    v, df = table
    monkeypatch.setattr(search, "TILE_CELLS", 1000)
    assert ranked(retrieval.nearest(df, df, "id", "v", 5, skip_self=True, block_rows=block_rows)) == by_hand(v, 5)


def clustered(spark, per_cluster=40):
    centres = 3 * rng.normal(size=(25, 8))
    v = np.repeat(centres, per_cluster, axis=0) + 0.2 * rng.normal(size=(25 * per_cluster, 8))
    v[3] = 0
    v[50:90] = v[50]  # copies
    pdf = pd.DataFrame({"id": np.arange(len(v)), "v": [row.tolist() for row in v]})
    return v, spark.createDataFrame(pdf, "id long, v array<float>").repartition(6)


def test_clusters_skip_most_pairs_of_blocks_and_lose_nothing(spark):
    v, df = clustered(spark)
    assert ranked(retrieval.nearest(df, df, "id", "v", 5, skip_self=True, block_rows=20)) == by_hand(v, 5)
    plan = search.prepared(df, df.where("id <> 3"), "id", "v", 5, True, block_rows=20)
    assert plan.pairs_met() < plan.pairs_in_all() / 3


def test_every_hit_above_a_score(spark):
    v, df = clustered(spark, 8)
    some = df.where("id % 3 = 0")
    got = retrieval.nearest(some, df, "id", "v", 2, skip_self=True, at_least=0.9, block_rows=10).collect()
    unit = v.astype(np.float32).astype(float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1), 1e-300)[:, None]
    scores = np.round(unit @ unit.T, 6)
    best = {i: o[:2] for i, o in by_hand(v, 2).items()}
    want = {(i, j) for i in range(0, len(v), 3) for j in range(len(v)) if i != j and (scores[i, j] >= 0.9 or j in best[i])}
    assert {(h.query_id, h.corpus_id) for h in got} == want and len(got) == len(want)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert ranked(retrieval.nearest(df, df, "id", "v", 9, skip_self=True)) == {1: [4, 3], 3: [1, 4], 4: [1, 3]}
    assert retrieval.nearest(df, df.where("false"), "id", "v", 9).count() == 0


def test_no_queries(spark, table):
    _, df = table
    assert retrieval.nearest(df.where("false"), df, "id", "v", 3).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, corpus_id long, score double, rank int, model int")


def test_threshold_and_fallback(spark):
    df = hits(spark, [(1, 10, 0.9, 1, 1), (1, 11, 0.05, 2, 2), (2, 10, 0.05, 1, 1), (2, 11, 0.04, 2, 2),
                      (2, 12, 0.03, 3, 3)])
    got = retrieval.above_threshold(df, 0.1, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.corpus_id, r.fallback) for r in got] == [(1, 10, 0), (2, 10, 1), (2, 11, 1)]


def test_defaults_are_not_repeated(spark):
    df = hits(spark, [(1, 10, 0.9, 1, 1), (1, 11, 0.8, 2, 7), (2, 1, 0.9, 1, 5), (2, 2, 0.8, 2, 6),
                      (2, 3, 0.7, 3, 7), (2, 4, 0.6, 4, 8), (2, 5, 0.5, 5, 9)])
    grouped = retrieval.by_response_model(df, "model")
    got = retrieval.with_defaults(grouped, "model", [1, 2]).orderBy("query_id", "place").collect()
    assert [r.model for r in got if r.query_id == 1] == [1, 7, 2]
    assert [r.model for r in got if r.query_id == 2] == [5, 6, 7, 8, 1]
    assert [r.is_default for r in got if r.query_id == 2] == [0, 0, 0, 0, 1]


def test_rerank_falls_back_per_query(spark):
    df = hits(spark, [(1, 10, 0.9, 1, 1), (1, 11, 0.8, 2, 2), (2, 10, 0.9, 1, 1), (2, 11, 0.8, 2, 2)])
    scored = df.withColumn("r", F.when(F.col("query_id") == 1, F.col("corpus_id") * 1.0)
                           .when(F.col("corpus_id") == 11, 5.0))
    got = retrieval.reranked(scored, "r", 1).orderBy("query_id").collect()
    assert [(r.corpus_id, r.fallback) for r in got] == [(11, 0), (10, 1)]


def test_ranking_metrics(spark):
    rows = [(1, 1, 1), (1, 2, 0), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 0)]
    df = spark.createDataFrame(rows, "q int, rank int, y int")
    df = df.withColumn("n", F.when(F.col("q") == 1, 4).when(F.col("q") == 2, 1).otherwise(0))
    row = evaluation.ranking_metrics(df, "q", "rank", "y", "n", 2).first()
    assert row.hit_1 == pytest.approx(1 / 3) and row.hit_3 == pytest.approx(2 / 3)
    assert row.recall_1 == pytest.approx((1 / 4 + 0) / 2) and row.recall_3 == pytest.approx((1 / 4 + 1) / 2)
    assert row.mrr == pytest.approx(0.5)
    second = 1 / np.log2(3)
    assert row.ndcg == pytest.approx((1 / (1 + second) + second) / 3)


def test_all_hits_above_a_score(spark, table):
    v, df = table
    f = v.astype(np.float32).astype(float)
    n = np.linalg.norm(f, axis=1)
    unit = f / np.where(n > 0, n, 1)[:, None]
    s = np.round(unit @ unit.T, 6)
    got = retrieval.nearest(df, df, "id", "v", 2, skip_self=True, at_least=0.2).collect()
    best = by_hand(v, 2)
    want = {(i, j) for i in range(len(v)) for j in range(len(v)) if i != j and (s[i, j] >= 0.2 or j in best[i])}
    assert len(got) == len(want) and {(r.query_id, r.corpus_id) for r in got} == want


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    row = df.select(vectors.l2_norm("a").alias("n"), vectors.cosine("a", "b").alias("c"),
                    vectors.l2_norm("z").alias("z"), vectors.cosine("a", "z").alias("cz"),
                    vectors.scaled_score(F.lit(-1.0)).alias("s"), vectors.clamped_score(F.lit(1.2)).alias("k")).first()
    assert (row.n, row.c, row.z, row.cz, row.s, row.k) == (5.0, 0.96, 1.0, 0.0, 0.0, 1.0)


def test_prediction_problems(spark):
    cases = [([0.4, 0.6], None), ([0.4], "width"), ([0.4, float("nan")], "not_finite"),
             ([0.4, float("inf")], "not_finite"), ([-0.4, 1.4], "out_of_range"), ([0.4, 0.5], "sum"), (None, "width")]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v array<double>")
    got = {r.i: r.p for r in df.select("i", quality.prediction_problem("v", 2).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [p for _, p in cases]
    padded = df.where("i = 1").select(quality.padded("v", 3).alias("p")).first().p
    assert padded == [0.4, 0.0, 0.0]


def test_odd_components_hide_no_hits(spark, table):
    v, df = table
    odd = spark.createDataFrame([(1000 + i, [float("nan")] * 8) for i in range(60)] + [(2000, [float("inf")] * 8)], "id long, v array<float>")
    both = df.unionByName(odd)
    assert ranked(retrieval.nearest(both, both, "id", "v", 5, skip_self=True, block_rows=40)) == by_hand(v, 5)


def test_readers_of_the_hits_do_not_search_again(spark, table):
    _, df = table
    found = retrieval.nearest(df, df, "id", "v", 3, skip_self=True)
    plan = found.join(found.select("query_id").distinct(), "query_id")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "FlatMapCoGroups" not in plan


@pytest.mark.parametrize("tile", [1 << 19, 64])
def test_tiles_keep_ties_copies_and_every_hit_above_a_score(tile, monkeypatch):
    monkeypatch.setattr(search, "TILE_CELLS", tile)
    monkeypatch.setattr(search, "TILE_QUERIES", 8)
    base = rng.normal(size=(30, 6))
    unit = search._unit(np.concatenate([base] * 4 + [np.zeros((2, 6))]))
    ids = rng.permutation(len(unit)).astype(np.int64)
    best = search._Best(ids[:50], unit[:50], 7, True, 0.9)
    for part in np.array_split(np.arange(len(unit)), 3):
        best.add(ids[part], unit[part])
    scores = np.round(unit[:50] @ unit.T, 6)
    for row in range(50):
        others = sorted((c for c in range(len(unit)) if ids[c] != ids[row]), key=lambda c: (-scores[row, c], ids[c]))
        assert best.ids[row].tolist() == ids[others[:7]].tolist()
        above = {int(ids[c]) for c in others if scores[row, c] >= 0.9}
        assert above == {int(i) for q, i, _ in (x for a in best.above for x in zip(*a)) if q == ids[row]}
