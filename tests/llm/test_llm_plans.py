"""Plans of the training-data queries keep what their design relies on."""

import os
import re

import pytest

from riskweave.llm import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", ["op1_shards", "op7_mixed_sources"])
def test_native_plans(spark, name):
    text = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|Arrow", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sharding_moves_no_texts(spark):
    text = queries.op1_shards(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in part.split("]")[0].replace("text_crc32", "") for part in text.split("hashpartitioning(")[1:])


def test_one_pass_without_a_shuffle(spark):
    for name in ("op2_bpe_round_trip", "op8_main_text"):
        text = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text
