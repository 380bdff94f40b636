"""The scoring batch over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.operators import profiles, scoring
from riskweave.plans import feature_queries as ftq
from riskweave.plans import filter_queries as fq
from riskweave.plans import movement_queries as mq
from riskweave.plans import scoring_batch as sb
from riskweave.plans.registry import query
from riskweave.session import written
from riskweave.sources import tables as src

_SECTOR_CODES = ftq._SECTOR_CODES
_REGIMES = ("1", "2", "3", None, "1")


def _inputs(spark, sf) -> sb.ScoringInputs:
    index = (F.col("enterprise_id") % len(_SECTOR_CODES)).cast("int")
    main = (
        fq.eligibility_rows(spark, sf)
        .withColumn("sector_code", F.get(F.array(*[F.lit(c) for c in _SECTOR_CODES]), index))
        .withColumn("group_id", F.when(F.col("enterprise_id") % 6 != 0, F.col("client_nature")))
    )
    orders = src.table(spark, sf, "orders").withColumnRenamed("o_custkey", "enterprise_id")
    closing = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    lines = src.table(spark, sf, "lineitem").join(
        orders.select("o_orderkey", "enterprise_id", closing.alias("closing")),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    year = F.col("enterprise_id") + F.year("closing")
    closings = (
        orders.select("enterprise_id", closing.alias("closing"))
        .distinct()
        .withColumn("months", F.get(F.array(*[F.lit(m) for m in (12, 0, None, 6)]), (year % 4).cast("int")))
        .withColumn("regime", F.get(F.array(*[F.lit(r) for r in _REGIMES]), (year % 5).cast("int")))
    )

    def detail(codes):
        at = ((F.col("l_partkey") + F.col("l_linenumber")) % len(codes)).cast("int")
        code = F.get(F.array(*[F.lit(c) for c in codes]), at)
        return lines.select(
            "enterprise_id", "closing", code.alias("code"), F.col("l_quantity").alias("value")
        )

    price = (F.col("o_totalprice") / -50000).cast("decimal(18,6)").cast("string")
    return sb.ScoringInputs(
        scope=main,
        sectors=scoring.sector_mapping(spark),
        overdrafts=lines.select("enterprise_id", (F.col("l_linenumber") * 2).alias("days")),
        accounts=orders.select(
            "enterprise_id",
            F.col("o_orderkey").alias("account_id"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        ),
        ratings=orders.select(
            "enterprise_id",
            F.col("o_orderdate").alias("day"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.replace(price, F.lit("."), F.lit(",")).alias("q_score"),
        ),
        category_totals=mq.movement_totals(spark, sf),
        conso_detail=detail(sb.CONSO_CODES),
        solo_detail=detail(sb.SOLO_CODES),
        closings=closings,
    )


def _steps(inputs):
    return sb.scoring_steps(
        inputs, F.col("mt_469") * 10, F.col("mt_182") - 100, F.col("mt_290"), F.col("mt_294") * 3
    )


def _wide_sql(codes) -> str:
    shown = ", ".join(f"'{c}'" for c in codes)
    sums = ", ".join(f"sum(l_quantity) FILTER (WHERE code = '{c}') AS mt_{c}" for c in codes)
    return f"""SELECT w.*, coalesce(h.m, 12) AS m, coalesce(h.regime, '1') AS regime FROM (
    SELECT o_custkey AS enterprise_id, closing, {sums} FROM (SELECT o_custkey, l_quantity,
      make_date(year(o_orderdate), 12, 31) AS closing,
      list_extract([{shown}], 1 + (l_partkey + l_linenumber) % {len(codes)}) AS code
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY closing DESC) = 1) w
  LEFT JOIN head h ON h.enterprise_id = w.enterprise_id AND h.closing = w.closing"""


_COEFFICIENT_ROWS = ", ".join(f"('{v}', '{m}', {c!r}::DOUBLE)" for v, m, c in rules.COEFFICIENTS)
_UNPIVOT = " UNION ALL ".join(
    f"SELECT enterprise_id, '{v}' AS variable, {v} AS modality FROM class" for v in rules.SCORE_VARIABLES
)
_RATING_EDGES = ", ".join(repr(e) for e in rules.RATING_BINS.bounds)

BATCH_SQL = f"""WITH {fq.ELIGIBILITY_SQL}, {mq.MOVEMENT_FLAG_SQL},
sector(sector_code, sector_class) AS (VALUES {", ".join(f"('{c}', '{k}')" for c, k in rules.SECTOR_SAMPLE)}),
main AS (SELECT *, list_extract([{", ".join(f"'{c}'" for c in _SECTOR_CODES)}],
    1 + enterprise_id % {len(_SECTOR_CODES)}) AS sector_code FROM candidate
  WHERE {" AND ".join(sql for _, sql in fq._CHECKS_SQL)}),
risk AS (SELECT o_custkey AS enterprise_id, max(l_linenumber * 2) AS days FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
bal AS (SELECT o_custkey AS enterprise_id, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS bal
  FROM orders GROUP BY 1),
rate AS (SELECT o_custkey AS enterprise_id, o_orderdate, o_orderstatus, o_orderpriority,
  sum(CAST(o_totalprice / -50000 AS DECIMAL(18,6))) AS s FROM orders GROUP BY ALL),
rated AS (SELECT *, row_number() OVER (PARTITION BY enterprise_id ORDER BY o_orderdate DESC,
  o_orderstatus DESC, o_orderpriority DESC) AS rn FROM rate),
closed AS (SELECT *, lag(closing) OVER (PARTITION BY enterprise_id ORDER BY closing) AS prev,
  enterprise_id + year(closing) AS y FROM (SELECT DISTINCT o_custkey AS enterprise_id,
    make_date(year(o_orderdate), 12, 31) AS closing FROM orders)),
head AS (SELECT enterprise_id, closing, CASE WHEN y % 4 IN (0, 3) THEN CASE y % 4 WHEN 0 THEN 12.0 ELSE 6.0 END
    WHEN date_diff('day', prev, closing) > 0 THEN date_diff('day', prev, closing) / 30.44 ELSE 12.0 END::DOUBLE AS m,
  CASE y % 5 WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN NULL ELSE '1' END AS regime FROM closed),
conso AS (SELECT enterprise_id, ({ftq._signed_sql(rules.CONSO_RESULT)}) / m * 12
  / nullif(coalesce(mt_310 / m * 12, (mt_24 + mt_309) / m * 12), 0) * 100 AS VB023 FROM ({_wide_sql(sb.CONSO_CODES)})),
solo AS (SELECT enterprise_id,
  coalesce(CASE regime WHEN '1' THEN ({ftq._signed_sql(rules.CASH_FLOW_REGIME_1)}) / m * 12
    WHEN '2' THEN ({ftq._signed_sql(rules.CASH_FLOW_REGIME_2)}) / m * 12 END / nullif(mt_469 * 10, 0), 0) * 100 AS VB005,
  coalesce((mt_182 - 100) / nullif(mt_294 * 3, 0), 0) * 100 AS VB035,
  coalesce(mt_290 / nullif(mt_294 * 3, 0), 0) * 100 AS VB055 FROM ({_wide_sql(sb.SOLO_CODES)})),
class AS (SELECT m.enterprise_id,
  CASE WHEN legal_form IN ('26','27','33','30') THEN '1-3'
    WHEN legal_form IN ('20','21','29','55','59','64') THEN '4-6' ELSE '>=7' END AS nat_jur_a,
  coalesce(sector_class, '3') AS secto_b, CASE WHEN segment = 'ME' THEN 'ME' ELSE 'autres' END AS seg_nae,
  CASE WHEN m.enterprise_id % 6 <> 0 AND client_nature IS NOT NULL THEN '1' ELSE '0' END AS top_ga,
  CASE WHEN days > 12 THEN '>12' ELSE '<=12' END AS nbj,
  CASE WHEN bal < -9.10499954 THEN '1' WHEN bal < 15235.6445 THEN '2' WHEN bal < 76378.7031 THEN '3'
    ELSE '4' END AS solde_cav_char,
  CASE WHEN s IS NOT NULL THEN CAST(1 + len(list_filter([{_RATING_EDGES}],
    lambda e: e <= 1 / (1 + exp(-CAST(s AS DOUBLE))))) AS VARCHAR) END AS reboot_score_char2,
  coalesce(remb_sepa_max, '2') AS remb_sepa_max, coalesce(pres_prlv_retourne, '2') AS pres_prlv_retourne,
  coalesce(pres_saisie, '2') AS pres_saisie,
  CASE WHEN nops >= 60 AND ratio < -0.00143675995 THEN '1' ELSE '2' END AS net_int_turnover,
  CASE WHEN VB023 < 0.430999994 THEN '1' WHEN VB023 < 2.99849987 THEN '2' WHEN VB023 >= 2.99849987 THEN '3'
    ELSE '2' END AS rn_ca_conso_023b,
  CASE WHEN VB005 < 66.2200012 THEN '1' WHEN VB005 >= 66.2200012 THEN '2' END AS caf_dmlt_005,
  CASE WHEN VB035 < -8.194 THEN '1' WHEN VB035 < 2.02 THEN '2' WHEN VB035 < 7.104 THEN '3'
    WHEN VB035 >= 7.104 THEN '4' END AS res_total_passif_035,
  CASE WHEN VB055 < 22.643 THEN '1' WHEN VB055 < 47.462 THEN '2' WHEN VB055 >= 47.462 THEN '3' END
    AS immob_total_passif_055
  FROM main m LEFT JOIN sector USING (sector_code) LEFT JOIN risk USING (enterprise_id)
  LEFT JOIN bal USING (enterprise_id) LEFT JOIN rated r ON r.enterprise_id = m.enterprise_id AND rn = 1
  LEFT JOIN flagged f ON f.enterprise_id = m.enterprise_id
  LEFT JOIN conso c ON c.enterprise_id = m.enterprise_id LEFT JOIN solo so ON so.enterprise_id = m.enterprise_id),
coefficient(variable, modality, weight) AS (VALUES {_COEFFICIENT_ROWS}),
z AS (SELECT u.enterprise_id, -3.86402362750751::DOUBLE + sum(coalesce(weight, 0)) AS z FROM ({_UNPIVOT}) u
  LEFT JOIN coefficient k ON k.variable = u.variable AND k.modality = u.modality GROUP BY 1)"""


@query(
    "m19_scoring_batch",
    f"""{BATCH_SQL} SELECT class.*, round(z, 9) AS sum_total_coeffs,
  round(1 - 1 / (1 + exp(-z)), 9) AS PDO_compute, CASE WHEN 1 - 1 / (1 + exp(-z)) < 0.0001 THEN 0.0001
  ELSE round(1 - 1 / (1 + exp(-z)), 4) END AS PDO FROM class JOIN z USING (enterprise_id)""",
)
def scoring_batch(spark, sf):
    inputs = _inputs(spark, sf)
    return (
        sb.apply_steps(inputs.scope, _steps(inputs))
        .withColumn("sum_total_coeffs", F.round("sum_total_coeffs", 9))
        .withColumn("PDO_compute", F.round("PDO_compute", 9))
    )


_SAME_ROWS = (
    "load encoding risk balances rating transactions consolidated_statements solo_statements".split()
)
_AFTER = ("eligibility", "format", "score", "output")
_ALL_CHECKS = " AND ".join(sql for _, sql in fq._CHECKS_SQL)


_STEP_SQL = (
    f"WITH {fq.ELIGIBILITY_SQL}, n AS (SELECT count(*) AS a, count(*) FILTER (WHERE {_ALL_CHECKS}) AS k"
    " FROM candidate) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS step, {i} AS position, "
        + ("a" if name in _SAME_ROWS or name == "eligibility" else "k")
        + " AS rows_in, "
        + ("a" if name in _SAME_ROWS else "k")
        + " AS rows_out, 'OK' AS status FROM n"
        for i, name in enumerate((*_SAME_ROWS, *_AFTER))
    )
)


@query("m19_step_control", _STEP_SQL)
def step_control(spark, sf):
    """Rows in and out of each step of one run, counted while the scored table is written."""
    inputs = _inputs(spark, sf)
    steps = _steps(inputs)
    scored, seen = sb.apply_counted(inputs.scope, steps)
    written(scored, "scored")
    return sb.step_counts(spark, steps, seen)


@query(
    "m19_a19_step_durations",
    f"SELECT *, 1 AS is_timed, 1.0::DOUBLE AS total_share, CAST(3 AS BIGINT) AS n_slowest FROM ({_STEP_SQL})",
)
def step_durations(spark, sf):
    """One run written step by step, its report passed on to the duration shares."""
    inputs = _inputs(spark, sf)
    _, report = sb.apply_timed(inputs.scope, _steps(inputs), "run")
    whole = Window.partitionBy("run_id")
    return profiles.step_report(report).select(
        "step", "position", "rows_in", "rows_out", "status",
        (F.col("seconds") > 0).cast("int").alias("is_timed"),
        F.round(F.sum("share").over(whole), 6).alias("total_share"),
        F.sum("is_slowest").over(whole).alias("n_slowest"),
    )
