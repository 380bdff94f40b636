import pytest
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.operators import movements as mv

CASES = [
    (9, -1.0, "x", "agios"),
    (9, 0.0, "x", "agios"),  # zero is a debit
    (32, 5.0, "AMORTISSEMENT PRET 12", "amort_pret"),
    (32, 5.0, "other", "turnover"),
    (999, 5.0, "AVIS A TIERS DETENTEUR TRESOR PUBLIC PARIS", "atd_tres_pub"),
    (999, 5.0, "OPPOSITION A TIERS DETENTEUR COLLECTIVITE", "atd_tres_pub"),
    (9, -5.0, "SAISIE ATTRIBUTION-BLOCAGE", "agios"),  # an earlier rule wins
    (1, -5.0, "SAISIE ATTRIBUTION-BLOCAGE", "attri_blocage"),
    (26, 5.0, "x", "recept_pret>>credit"),
    (856, 5.0, "DGFIP", "prlv_sepa_retourne"),
    (857, 5.0, "DGFIP", "rembt_prlv_sepa"),
    (568, 5.0, "DGFIP 75", "tax"),
    (568, 5.0, "D.G.F.I.P 75", "tax"),
    (568, 5.0, "SIE PARIS", "tax_credit>>sie"),
    (568, 5.0, "SIEGE", "turnover"),
    (860, 5.0, "URSSAF", "urssaf>>credit"),
    (809, -5.0, "URSSAF", "cost>>debit"),  # the last rule can never fire
    (1, 5.0, "x", "rejected_check"),
    (999, 5.0, "x", None),
    (9, None, "x", None),
    (None, 5.0, "x", None),
]


def test_categories(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)],
                               "i int, code long, amount double, label string")
    out = df.withColumn("side", mv.direction("amount")).withColumn(
        "category", mv.category("code", "side", "label")
    )
    got = {r.i: r.category for r in out.collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]


def test_cancelled_needs_both_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "movement_id int, day string")
    cancels = spark.createDataFrame([(1, "a"), (2, "z"), (1, "a")], "movement_id int, day string")
    kept = mv.without_cancelled(rows, cancels, ["movement_id", "day"])
    assert sorted(map(tuple, kept.collect())) == [(1, "b"), (2, "a")]


@pytest.fixture
def totals(spark):
    return spark.createDataFrame(
        [
            ("E1", "interets", -10.0, 2, -8.0, -2.0, 40),
            ("E1", "turnover", 1000.0, 30, 1.0, 90.0, 40),
            ("E1", "attri_blocage", 5.0, 1, 5.0, 5.0, 40),
            ("E1", "atd_tres_pub", 7.0, 1, 7.0, 7.0, 40),
            ("E2", "rembt_prlv_sepa", 4000.0, 1, 4000.0, 4000.0, 3),
            ("E3", "agios", 1.0, 1, 1.0, 1.0, 1),
        ],
        "e string, category string, netamount double, nops_category long, min_amount double, "
        "max_amount double, nops_total long",
    )


def test_wide_columns(spark, totals):
    wide = {r.e: r for r in mv.wide_by_condition(totals, "e").collect()}
    assert set(wide) == {"E1", "E2"}
    assert wide["E1"].saisie__netamount == 12.0 and wide["E1"].saisie__nops == 2.0
    assert wide["E1"].rembt_prlv_sepa__netamount is None
    assert wide["E1"].nops == 160.0  # the total once per kept row
    total = {r.e: r.nops for r in mv.wide_by_condition(totals, "e", nops_mode="total").collect()}
    assert total == {"E1": 40.0, "E2": 3.0}
    with pytest.raises(ValueError):
        mv.wide_by_condition(totals, "e", nops_mode="other")
    names = [f"{c}__{m}" for c in rules.MODEL_CATEGORIES for m in mv.MEASURES]
    pivoted = mv.wide_by_pivot(totals, "e").orderBy("e").select("e", *names).collect()
    assert pivoted == mv.wide_by_condition(totals, "e").orderBy("e").select("e", *names).collect()


def test_features_keep_every_enterprise(spark, totals):
    main = spark.createDataFrame([("E1",), ("E2",), ("E3",), ("E4",)], "e string")
    got = {r.e: r for r in mv.add_transaction_features(main, totals, "e").collect()}
    assert len(got) == 4 and all(r.flag_transac == "OK" for r in got.values())
    assert (got["E1"].net_int_turnover, got["E1"].pres_saisie, got["E1"].remb_sepa_max) == ("1", "1", "2")
    assert (got["E2"].net_int_turnover, got["E2"].pres_saisie, got["E2"].remb_sepa_max) == ("2", "2", "1")
    assert got["E4"].remb_sepa_max is None


def test_aggregate_equals_windows(spark):
    rows = spark.createDataFrame(
        [("E1", "a", 1.0), ("E1", "a", 2.0), ("E1", None, 5.0), ("E1", "b", -1.0), ("E2", None, 1.0)],
        "e string, category string, amount double",
    )
    grouped = mv.totals_by_category(rows, "e").orderBy("category").collect()
    assert [(r.category, r.netamount, r.nops_category, r.nops_total) for r in grouped] == [
        ("a", 3.0, 2, 4), ("b", -1.0, 1, 4)
    ]
    detail = mv.windowed_totals(rows, "e").groupBy("e", "category").agg(
        F.max("netamount").alias("n"), F.count("*").alias("c")
    )
    assert sorted((r.category, r.n, r.c) for r in detail.collect()) == [("a", 3.0, 2), ("b", -1.0, 1)]


def test_a_hot_enterprise_is_summed_before_the_shuffle(spark):
    rows = spark.range(30000).selectExpr(
        "if(id % 3 = 0, 0, id) AS e", "if(id % 2 = 0, 'a', 'b') AS category", "1.0D AS amount"
    )
    hot = mv.totals_by_category(rows, "e").where("e = 0")
    assert sorted((r.category, r.nops_category, r.nops_total) for r in hot.collect()) == [
        ("a", 5000, 10000), ("b", 5000, 10000)
    ]
