"""The plans keep the properties the design relies on."""

import glob
import os
import re

import pytest

import __spark_entry__ as contract
from riskweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

PYTHON = {
    "f16_unicode_nfc", "p22_redacted_nested", "x07_number_words", "x07_dictated_phone", "x08_cleaned_transcripts",
    "x14_semantic_error_rates", "x15_optimal_speaker_map",
    "j13_r01_o04_nearest", "r02_threshold_fallback",
    "r03_response_models", "r04_with_defaults", "r05_reranked", "r06_ranking_metrics",
    "q04_chi2_drift", "m25_variance_inflation", "m26_cross_validated_trees",
}


def plan(spark, name):
    return contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", sorted(n for n in catalogue.QUERIES if n[0] in "apjwmfoqxs" and n not in PYTHON and not n.startswith("m26"))
)
def test_native_and_without_cross_joins(spark, name):
    text = plan(spark, name)
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cancels_use_an_anti_join(spark):
    assert "LeftAnti" in plan(spark, "j01_without_cancelled")


def test_filters_reach_the_scan(spark):
    text = plan(spark, "s02_whole_months")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(o_orderdate", text)
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate" in text


def test_latest_rows_are_limited_before_the_shuffle(spark):
    for name in ("w04_m13_two_latest", "w05_w06_w07_newest_row", "j09_latest_with_ties"):
        assert "WindowGroupLimit" in plan(spark, name)


def test_quantiles_per_key_have_one_set_of_cuts(spark):
    text = plan(spark, "a14_activity_features")
    assert not re.search(r"keys=\[[^\]]+\], functions=\[[^\]]*percentile_approx", text)


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from riskweave.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError):
        shared_folder(session)


def test_no_local_checkpoints_or_forbidden_calls():
    for path in glob.glob(os.path.join(ROOT, "riskweave", "**", "*.py"), recursive=True):
        source = open(path, encoding="utf-8").read()
        assert "localCheckpoint" not in source and ".crossJoin(" not in source
        assert ".rdd" not in source
