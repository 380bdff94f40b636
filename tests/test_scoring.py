import math

import pytest
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions import scalars as sc
from riskweave.operators import scope, scoring
from riskweave.operators import statements as st

REFERENCE = {
    "nat_jur_a": "1-3", "secto_b": "4", "seg_nae": "ME", "top_ga": "0", "nbj": ">12",
    "solde_cav_char": "1", "reboot_score_char2": "9", "remb_sepa_max": "1",
    "pres_prlv_retourne": "1", "pres_saisie": "1", "net_int_turnover": "1",
    "rn_ca_conso_023b": "1", "caf_dmlt_005": "1", "res_total_passif_035": "1",
    "immob_total_passif_055": "1",
}
SCHEMA = ", ".join(f"{v} string" for v in rules.SCORE_VARIABLES)


def rows(spark, *overrides):
    data = [tuple({**REFERENCE, **o}[v] for v in rules.SCORE_VARIABLES) for o in overrides]
    return spark.createDataFrame(data, SCHEMA)


def test_table_has_46_modalities_of_15_variables():
    assert len(rules.COEFFICIENTS) == 46
    assert len(rules.SCORE_VARIABLES) == 15


def test_reference_profile(spark):
    row = scoring.add_score(rows(spark, {})).first()
    assert row.sum_total_coeffs == pytest.approx(rules.INTERCEPT)
    assert row.PDO == 0.9794
    assert row.flag_pdo_OK == "flag"
    direct = scoring.add_score(rows(spark, {}), orientation="direct").first()
    assert direct.PDO == 0.0206
    bare = scoring.add_score(rows(spark, {}), include_intercept=False).first()
    assert bare.PDO == 0.5


def test_protective_profile_meets_the_floor(spark):
    best = {}
    for v, m, c in rules.COEFFICIENTS:
        if c >= max(x for w, _, x in rules.COEFFICIENTS if w == v):
            best[v] = m
    row = scoring.add_score(rows(spark, best)).first()
    assert row.PDO_compute < 0.001
    expected = 1 - 1 / (1 + math.exp(-row.sum_total_coeffs))
    assert row.PDO == (0.0001 if expected < 0.0001 else round(expected, 4))
    assert [r.p for r in spark.range(1).select(sc.floored(F.lit(0.00001)).alias("p")).collect()] == [
        0.0001
    ]


@pytest.mark.parametrize("value", [None, "", "XX", "7"])
def test_unknown_modality_weighs_nothing(spark, value):
    row = scoring.add_score(rows(spark, {"nat_jur_a": value})).first()
    assert row.sum_total_coeffs == pytest.approx(rules.INTERCEPT)


def test_missing_variable_is_an_error(spark):
    with pytest.raises(ValueError, match="nbj"):
        scoring.add_score(rows(spark, {}).drop("nbj"))
    with pytest.raises(ValueError):
        scoring.add_linear_probability(rows(spark, {}), {"absent": 1.0}, 0.0)
    with pytest.raises(ValueError):
        scoring.add_linear_probability(rows(spark, {}), {}, 0.0)


def test_one_hot_of_null_is_all_zero(spark):
    wide = scoring.one_hot(rows(spark, {"nat_jur_a": None})).first()
    names = [scoring.one_hot_name("nat_jur_a", m) for m in ("1-3", "4-6", ">=7")]
    assert [wide[n] for n in names] == [0, 0, 0]
    assert len({scoring.one_hot_name(v, m) for v, m, _ in rules.COEFFICIENTS}) == 46


def test_sigmoid_is_stable(spark):
    df = spark.createDataFrame([(0.0,), (800.0,), (-800.0,), (None,)], "x double")
    assert [r.s for r in df.select(sc.sigmoid("x").alias("s")).collect()] == [0.5, 1.0, 0.0, None]


def test_rating_bins_leave_null_and_the_hole_out(spark):
    df = spark.createDataFrame(
        [(None,), (0.0456250459,), (0.0456250460,), (0.0014,), (0.00142771716,), (0.5,)], "x double"
    )
    got = [r.b for r in df.select(sc.bin_class("x", rules.RATING_BINS).alias("b")).collect()]
    assert got == [None, None, "9", "1", "2", "9"]


def test_balance_and_margin_defaults(spark):
    df = spark.createDataFrame([(None,), (-9.10499954,), (-10.0,), (1e9,)], "x double")
    got = df.select(
        sc.bin_class("x", rules.BALANCE_BINS).alias("b"),
        sc.bin_class("x", rules.CONSO_MARGIN_BINS).alias("m"),
        scoring.overdraft_class("x").alias("d"),
    ).collect()
    assert [r.b for r in got] == ["4", "2", "1", "4"]
    assert [r.m for r in got] == ["2", "1", "1", "3"]
    assert [r.d for r in got] == ["<=12", "<=12", "<=12", ">12"]


def test_encoders(spark):
    codes = ["26", "27", "33", "30", "20", "64", "22", "58", None, "", "  ", "99", "XX"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r.k for r in df.select(scoring.legal_form_class("c").alias("k")).collect()]
    assert got == ["1-3"] * 4 + ["4-6"] * 2 + ["7"] * 7
    groups = spark.createDataFrame([(None,), ("",), ("G1",)], "g string")
    flags = groups.select(
        scoring.group_flag("g").alias("a"), scoring.group_flag("g", True).alias("b")
    ).collect()
    assert [(r.a, r.b) for r in flags] == [("0", "0"), ("1", "0"), ("1", "1")]
    sectors = spark.createDataFrame(
        [("420053",), ("360120",), ("",), ("010010",), ("999999",)], "s string"
    )
    out = scoring.add_sector_class(sectors, "s", scoring.sector_mapping(spark)).collect()
    assert {r.s: r.sector_class for r in out} == {
        "420053": "1", "360120": "2", "": "3", "010010": "4", "999999": "3"
    }


def test_risk_keeps_every_enterprise(spark):
    main = spark.createDataFrame([("A",), ("B",), ("C",)], "k string")
    days = spark.createDataFrame([("A", 3), ("A", 7), ("A", 5), ("B", 2), ("B", 15)], "k string, d long")
    got = {r.k: r.overdraft_days for r in scoring.add_risk_features(main, days, "k", "d").collect()}
    assert got == {"A": 7, "B": 15, "C": None}
    guarded = scope.guard_range(days, "d", 0, 10)
    got = {r.k: r.overdraft_days for r in scoring.add_risk_features(main, guarded, "k", "d").collect()}
    assert got == {"A": 7, "B": 2, "C": None}
    empty = scoring.add_risk_features(main, days.where("false"), "k", "d")
    assert empty.count() == 3 and empty.where("overdraft_days IS NULL").count() == 3


def test_balances_keep_zero_apart_from_missing(spark):
    main = spark.createDataFrame([("A",), ("B",), ("C",)], "k string")
    accounts = spark.createDataFrame(
        [("A", "1", 150), ("A", "1", -50), ("B", "2", 100), ("B", "3", -100)],
        "k string, a string, c long",
    )
    got = scoring.add_balance_features(main, accounts, "k", "a", "c").collect()
    assert {r.k: (r.balance, r.n_accounts) for r in got} == {
        "A": (1.0, 2), "B": (0.0, 2), "C": (None, None)
    }


def test_ratings(spark):
    main = spark.createDataFrame([("A",), ("B",), ("C",)], "k string")
    raw = [
        ("2024-01-01", "A", "m", "1,5"), ("2024-03-01", "A", "m", "3,0"),
        ("2024-02-01", "A", "m", "2,0"), ("2024-03-01", "B", "m", "5,0"),
        ("2024-03-01", "B", "m", "6,0"), ("2024-01-01", "C", "m", "#REF!"),
    ]
    ratings = spark.createDataFrame(raw, "d string, k string, m string, q string")
    got = scoring.add_rating_features(main, ratings, "k", "d", ["d", "k", "m"], "q").collect()
    assert {r.k: r.rating_score for r in got} == {"A": 3.0, "B": 11.0, "C": None}


def test_equal_dates_are_settled_the_same_way_on_any_partitioning(spark):
    rows_ = [("A", "2024-01-01", f"m{i}", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows_, "k string, d string, m string, s double")
    picks = {
        scoring.newest_rating(df.repartition(n), "k", "d", ["k", "d", "m"], "s").first().rating_score
        for n in (1, 3, 7)
    }
    assert picks == {9.0}  # "m9" is the largest text


def test_eligibility_nulls(spark):
    base = ("26", "4711A", "ME", "0", "1", "0", "999", "00001")
    schema = (
        "legal_form string, activity string, segment string, real_estate string, "
        "has_account string, risk_claim string, economic_code string, client_nature string"
    )

    def variant(position, value):
        return tuple(value if i == position else v for i, v in enumerate(base))

    data = [base, variant(5, None), variant(5, "1"), variant(3, "1"), variant(3, None),
            variant(3, ""), variant(7, None), variant(0, "31"), variant(6, "011")]
    df = spark.createDataFrame(data, schema)
    assert scope.eligible(df).count() == 3
    strict = scope.eligible(df, scope.eligibility_rules(strict_real_estate=True))
    assert strict.count() == 1
    report = scope.filter_report(df).collect()
    assert report[0].rows_in == 9 and report[-1].rows_out == 3
    assert all(a.rows_out == b.rows_in for a, b in zip(report, report[1:]))


def test_statement_lengths_and_ratios(spark):
    df = spark.createDataFrame(
        [(12.0, 5.0), (0.0, 5.0), (None, 5.0), (0.0, 0.0), (None, -1.0)], "declared double, derived double"
    )
    got = [r.m for r in df.select(sc.valid_exercise_months("declared", "derived").alias("m")).collect()]
    assert got == [12.0, 5.0, 5.0, 12.0, 12.0]
    one = spark.createDataFrame([(None, 2.0, -2.0)], "mt_310 double, mt_24 double, mt_309 double")
    for c in rules.CONSO_RESULT:
        if c != "310":
            one = one.withColumn(f"mt_{c}", F.lit(1.0))
    row = st.conso_ratios(one.withColumn("months", F.lit(12)), "months").first()
    assert row.conso_turnover == 0.0 and row.VB023 is None
    regimes = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "r string")
    for c in {**rules.CASH_FLOW_REGIME_1, **rules.CASH_FLOW_REGIME_2}:
        regimes = regimes.withColumn(f"mt_{c}", F.lit(10.0))
    solo = st.solo_ratios(
        regimes.withColumn("months", F.lit(6.0)), "r", "months",
        F.lit(0.0), F.lit(5.0), F.lit(5.0), F.lit(0.0),
    ).collect()
    assert [r.cash_flow for r in solo] == [80.0, 60.0, None, None]
    assert all((r.VB005, r.VB035, r.VB055) == (0.0, 0.0, 0.0) for r in solo)


def test_group_resolution_matches_the_union_of_branches(spark):
    links = spark.createDataFrame(
        [
            ("A", 1, "OTHER", "2020", "1"), ("B", 1, "CAPIT", "2020", "1"), ("B", 2, "OTHER", "2023", "1"),
            ("C", 1, "CAPIT", "2020", "1"), ("C", 2, "CAPIT", "2021", "1"), ("D", 1, "OTHER", "2020", "1"),
            ("D", 2, "OTHER", "2021", "1"), ("E", 1, "CAPIT", "2020", "1"), ("E", 2, "CAPIT", "2020", "2"),
        ],
        "e string, g long, link_type string, start_date string, update_date string",
    )
    got = {r.e: r.g for r in scope.resolve_groups(links, "e", "g").collect()}
    assert got == {"A": 1, "B": 1, "C": 2, "E": 2}
    parts = scope.group_branches(links, "e", "g")
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert {r.e: r.g for r in union.collect()} == got and union.count() == 4
    assert {r.e: r.g for r in scope.resolve_groups(links, "e", "g", False).collect()}["D"] == 2


def test_steps_are_timed_and_a_failure_ends_the_run(spark):
    from riskweave.plans import scoring_batch as sb

    steps = [
        ("halved", lambda d: d.where("id % 2 = 0")),
        ("none", lambda d: d.where("id < 0")),
        ("broken", lambda d: d.select("missing")),
        ("after", lambda d: d),
    ]
    done, report = sb.apply_timed(spark.range(10), steps[:1], "a")
    assert done.count() == 5
    out, report = sb.apply_timed(spark.range(10), steps, "b")
    rows = report.orderBy("position").collect()
    assert out is None
    assert [(r.step, r.rows_in, r.rows_out, r.status) for r in rows] == [
        ("load", 10, 10, "OK"), ("halved", 10, 5, "OK"), ("none", 5, 0, "EMPTY"),
        ("broken", 0, None, "FAILED"), ("after", None, None, "SKIPPED"),
    ]
    assert "missing" in rows[3].message and all(r.seconds > 0 for r in rows[:4])
