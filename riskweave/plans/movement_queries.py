"""Movement extraction, categorisation and transaction features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.operators import movements as mv
from riskweave.plans import binding as b
from riskweave.plans.registry import query
from riskweave.sources import tables as src

_WINDOW_SQL = """operation_date > last_day(DATE '2001-08-01' - INTERVAL 7 MONTH)
    AND operation_date < last_day(DATE '2001-08-01' - INTERVAL 1 MONTH) + INTERVAL 1 DAY"""


def _categorised(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.movements(spark, sf).withColumn("direction", mv.direction("amount"))
    return rows.withColumn("category", mv.category("code", "direction", "label"))


def _current(spark: SparkSession, sf: str) -> DataFrame:
    """Current-account movements of six whole months, cancelled ones removed."""
    window = src.whole_months("operation_date", b.AS_OF)
    rows = _categorised(spark, sf).where(window & (F.col("family") == "100"))
    cancels = b.cancels(spark, sf).where(window)
    return mv.without_cancelled(rows, cancels, ["movement_id", "operation_date"])


def _of_enterprises(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return mv.bridge(
        b.enterprise_scope(spark, sf), (b.holders(spark, sf), "enterprise_id", "account_id")
    ).join(rows, "account_id")


_CURRENT_SQL = f"""{b.MOVEMENT_SQL}, {b.CATEGORY_SQL}, {b.ENTERPRISE_SQL}, kept AS (
  SELECT g.* FROM categorised g
  WHERE {_WINDOW_SQL} AND family = '100'
    AND NOT EXISTS (SELECT 1 FROM cancel x WHERE x.movement_id = g.movement_id
                    AND x.operation_date = g.operation_date)
), owned AS (
  SELECT e.enterprise_id, k.* FROM enterprise e JOIN holder h USING (enterprise_id)
  JOIN kept k USING (account_id)
)"""


def as_double(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.col(name).cast("double"))
    return df


# --------------------------------------------------------------- categories and filters


@query(
    "p02_movement_categories",
    f"""WITH {b.MOVEMENT_SQL}, {b.CATEGORY_SQL}
SELECT category, direction, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
FROM categorised GROUP BY category, direction""",
)
def movement_categories(spark, sf):
    return (
        _categorised(spark, sf)
        .groupBy("category", "direction")
        .agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))
    )


@query(
    "p02_category_function",
    f"""WITH {b.MOVEMENT_SQL}, {b.CATEGORY_SQL}
SELECT category, family, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
FROM categorised GROUP BY category, family""",
)
def category_function(spark, sf):
    """The categories by a SQL function that is called in plain SQL."""
    spark.sql(mv.category_function_sql())
    return spark.sql(
        """SELECT movement_category(code, CASE WHEN amount > 0 THEN 'credit' WHEN amount <= 0 THEN 'debit' END, label)
    AS category, family, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
  FROM {movement} GROUP BY ALL""",
        movement=b.movements(spark, sf),
    )


@query(
    "p03_label_prefixes",
    """SELECT p_partkey, p_name,
  CASE WHEN p_name LIKE 'red %' OR p_name LIKE 'blue %' THEN 1 ELSE 0 END AS is_coloured
FROM part""",
)
def label_prefixes(spark, sf):
    return src.table(spark, sf, "part").select(
        "p_partkey",
        "p_name",
        mv.starts_with_any("p_name", ("red ", "blue ")).cast("int").alias("is_coloured"),
    )


@query(
    "p04_direction_from_sign",
    f"""WITH {b.MOVEMENT_SQL}
SELECT CASE WHEN amount > 0 THEN 'credit' WHEN amount <= 0 THEN 'debit' END AS direction,
  count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM movement GROUP BY 1""",
)
def direction_from_sign(spark, sf):
    return (
        b.movements(spark, sf)
        .groupBy(mv.direction("amount").alias("direction"))
        .agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))
    )


@query(
    "p05_account_family",
    f"""WITH {b.MOVEMENT_SQL}
SELECT code, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
FROM movement WHERE family = '100' GROUP BY code""",
)
def account_family(spark, sf):
    return (
        b.movements(spark, sf)
        .where(F.col("family") == "100")
        .groupBy("code")
        .agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))
    )


# ------------------------------------------------------------------------------- joins


@query(
    "j01_without_cancelled",
    f"""WITH {b.MOVEMENT_SQL}
SELECT m.movement_id, strftime(m.operation_date, '%Y-%m-%d') AS operation_date,
  CAST(m.amount AS DOUBLE) AS amount
FROM movement m LEFT JOIN cancel x
  ON m.movement_id = x.movement_id AND m.operation_date = x.operation_date
WHERE x.movement_id IS NULL""",
)
def without_cancelled(spark, sf):
    kept = mv.without_cancelled(
        b.movements(spark, sf), b.cancels(spark, sf), ["movement_id", "operation_date"]
    )
    return kept.select(
        "movement_id",
        F.date_format("operation_date", "yyyy-MM-dd").alias("operation_date"),
        F.col("amount").cast("double").alias("amount"),
    )


@query(
    "j03_enterprise_bridge",
    f"""WITH {b.MOVEMENT_SQL}, {b.ENTERPRISE_SQL}
SELECT n_name AS nation, count(*) AS n, count(DISTINCT e.enterprise_id) AS n_enterprises,
  CAST(sum(m.amount) AS DOUBLE) AS amount
FROM enterprise e JOIN holder h USING (enterprise_id) JOIN movement m USING (account_id)
JOIN customer ON c_custkey = e.enterprise_id JOIN nation ON n_nationkey = c_nationkey
GROUP BY n_name""",
)
def enterprise_bridge(spark, sf):
    owned = _of_enterprises(
        spark, sf, b.movements(spark, sf).select("account_id", "amount")
    )
    per_enterprise = owned.groupBy("enterprise_id").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount")
    )
    customer = src.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = src.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        per_enterprise.join(customer, F.col("c_custkey") == F.col("enterprise_id"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .groupBy(F.col("n_name").alias("nation"))
        .agg(
            F.sum("n").alias("n"),
            F.count("*").alias("n_enterprises"),
            F.sum("amount").cast("double").alias("amount"),
        )
    )


# ------------------------------------------------------------------------ aggregations

_A01_SQL = f"""WITH {_CURRENT_SQL}, grouped AS (
  SELECT enterprise_id, category, sum(amount) AS netamount, count(amount) AS nops_category,
         min(amount) AS min_amount, max(amount) AS max_amount
  FROM owned GROUP BY enterprise_id, category
), counted AS (SELECT enterprise_id, count(amount) AS nops_total FROM owned GROUP BY 1)
SELECT enterprise_id, category, CAST(netamount AS DOUBLE) AS netamount, nops_category,
  CAST(min_amount AS DOUBLE) AS min_amount, CAST(max_amount AS DOUBLE) AS max_amount, nops_total
FROM grouped JOIN counted USING (enterprise_id) WHERE category IS NOT NULL"""


def movement_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per enterprise and category of the current movements."""
    rows = _of_enterprises(
        spark, sf, _current(spark, sf).select("account_id", "category", "amount")
    )
    return mv.totals_by_category(rows, "enterprise_id")


@query("a01_category_totals", _A01_SQL)
def category_totals(spark, sf):
    return as_double(movement_totals(spark, sf), "netamount", "min_amount", "max_amount")


@query("o01_ordered_category_totals", _A01_SQL + " ORDER BY enterprise_id, category")
def ordered_category_totals(spark, sf):
    return category_totals(spark, sf).orderBy("enterprise_id", "category")


@query(
    "a02_operation_count",
    f"""WITH {_CURRENT_SQL}
SELECT enterprise_id, count(amount) AS nops_total, count(category) AS nops_categorised
FROM owned GROUP BY enterprise_id""",
)
def operation_count(spark, sf):
    rows = _of_enterprises(
        spark, sf, _current(spark, sf).select("account_id", "category", "amount")
    )
    return rows.groupBy("enterprise_id").agg(
        F.count("amount").alias("nops_total"), F.count("category").alias("nops_categorised")
    )


_WINDOW_TOTALS_SQL = f"""WITH {b.MOVEMENT_SQL}, {b.CATEGORY_SQL}, {b.ENTERPRISE_SQL}, owned AS (
  SELECT enterprise_id, c.* FROM enterprise JOIN holder USING (enterprise_id)
  JOIN categorised c USING (account_id)
), w AS (
  SELECT *,
    sum(amount) OVER k AS net, count(amount) OVER k AS nc, min(amount) OVER k AS lo,
    max(amount) OVER k AS hi, count(amount) OVER (PARTITION BY enterprise_id) AS nt,
    row_number() OVER (PARTITION BY enterprise_id, category) AS rn
  FROM owned WINDOW k AS (PARTITION BY enterprise_id, category)
)"""


@query(
    "w01_w02_windowed_totals",
    _WINDOW_TOTALS_SQL
    + """ SELECT enterprise_id, movement_id, category, CAST(amount AS DOUBLE) AS amount,
  CAST(net AS DOUBLE) AS netamount, nc AS nops_category, CAST(lo AS DOUBLE) AS min_amount,
  CAST(hi AS DOUBLE) AS max_amount, nt AS nops_total FROM w WHERE category IS NOT NULL""",
)
def windowed_totals(spark, sf):
    rows = _of_enterprises(
        spark, sf, _categorised(spark, sf).select("account_id", "movement_id", "category", "amount")
    ).drop("account_id")
    out = mv.windowed_totals(rows, "enterprise_id")
    return as_double(out, "amount", "netamount", "min_amount", "max_amount")


@query(
    "w03_one_row_per_category",
    _WINDOW_TOTALS_SQL
    + """ SELECT enterprise_id, category, CAST(net AS DOUBLE) AS netamount, nc AS nops_category,
  CAST(lo AS DOUBLE) AS min_amount, CAST(hi AS DOUBLE) AS max_amount, nt AS nops_total
FROM w WHERE category IS NOT NULL AND rn = 1""",
)
def one_row_per_category(spark, sf):
    rows = _of_enterprises(
        spark, sf, _categorised(spark, sf).select("account_id", "category", "amount")
    )
    return as_double(
        mv.totals_by_category(rows, "enterprise_id"), "netamount", "min_amount", "max_amount"
    )


_MODEL_ROW_SQL = """model_row AS (
  SELECT *, CASE WHEN category IN ('attri_blocage', 'atd_tres_pub') THEN 'saisie'
                 ELSE category END AS model_category
  FROM event_total
)"""
_MODEL_SQL = f"{b.EVENT_TOTALS_SQL}, {_MODEL_ROW_SQL}"

_MEASURE_SQL = {
    "netamount": "netamount",
    "nops": "nops_category",
    "min_amount": "min_amount",
    "max_amount": "max_amount",
}
_WIDE_COLUMNS = ", ".join(
    f"CAST(sum({source}) FILTER (WHERE model_category = '{name}') AS DOUBLE) AS {name}__{measure}"
    for name in rules.MODEL_CATEGORIES
    for measure, source in _MEASURE_SQL.items()
)


@query(
    "p08_p09_model_categories",
    f"""WITH {_MODEL_SQL}
SELECT model_category, count(*) AS n, CAST(sum(netamount) AS DOUBLE) AS netamount
FROM model_row WHERE model_category IN
  ('interets', 'turnover', 'prlv_sepa_retourne', 'rembt_prlv_sepa', 'saisie')
GROUP BY model_category""",
)
def model_categories(spark, sf):
    kept = mv.model_rows(b.event_totals(spark, sf), "category")
    return kept.groupBy("model_category").agg(
        F.count("*").alias("n"), F.sum("netamount").cast("double").alias("netamount")
    )


@query(
    "a03_wide_by_pivot",
    f"WITH {_MODEL_SQL} SELECT enterprise_id, {_WIDE_COLUMNS} FROM model_row GROUP BY 1",
)
def wide_by_pivot(spark, sf):
    return mv.wide_by_pivot(b.event_totals(spark, sf), "enterprise_id")


@query(
    "a04_wide_by_condition",
    f"WITH {_MODEL_SQL} SELECT enterprise_id, {_WIDE_COLUMNS} FROM model_row GROUP BY 1",
)
def wide_by_condition(spark, sf):
    return mv.wide_by_condition(b.event_totals(spark, sf), "enterprise_id").drop("nops")


@query(
    "a05_operation_sum",
    f"""WITH {_MODEL_SQL} SELECT enterprise_id, CAST(sum(nops_total) AS DOUBLE) AS nops
FROM model_row WHERE model_category IN
  ('interets', 'turnover', 'prlv_sepa_retourne', 'rembt_prlv_sepa', 'saisie') GROUP BY 1""",
)
def operation_sum(spark, sf):
    return mv.wide_by_condition(b.event_totals(spark, sf), "enterprise_id").select(
        "enterprise_id", "nops"
    )


_WIDE_FLAG_SQL = f"""wide AS (
  SELECT enterprise_id, {_WIDE_COLUMNS}, CAST(sum(nops_total) AS DOUBLE) AS nops
  FROM model_row GROUP BY 1
), flagged AS (
  SELECT *, CASE WHEN rembt_prlv_sepa__max_amount > 3493.57007 THEN '1' ELSE '2' END
      AS remb_sepa_max,
    CASE WHEN prlv_sepa_retourne__nops > 0 THEN '1' ELSE '2' END AS pres_prlv_retourne,
    CASE WHEN saisie__nops > 0 THEN '1' ELSE '2' END AS pres_saisie,
    coalesce(interets__netamount / nullif(turnover__netamount, 0), 0) AS ratio
  FROM wide
)"""
_FLAG_SQL = f"{_MODEL_SQL}, {_WIDE_FLAG_SQL}"

# The same flags from movements: categorised, current accounts, six months, cancelled ones removed.
MOVEMENT_FLAG_SQL = f"""{_CURRENT_SQL}, grouped AS (
  SELECT enterprise_id, category, sum(amount) AS netamount, count(amount) AS nops_category,
         min(amount) AS min_amount, max(amount) AS max_amount
  FROM owned GROUP BY enterprise_id, category
), counted AS (SELECT enterprise_id, count(amount) AS nops_total FROM owned GROUP BY 1),
event_total AS (SELECT * FROM grouped JOIN counted USING (enterprise_id) WHERE category IS NOT NULL),
{_MODEL_ROW_SQL}, {_WIDE_FLAG_SQL}"""


@query(
    "m02_presence_flags",
    f"""WITH {_FLAG_SQL} SELECT enterprise_id, remb_sepa_max, pres_prlv_retourne, pres_saisie
FROM flagged""",
)
def presence_flags(spark, sf):
    wide = mv.wide_by_condition(b.event_totals(spark, sf), "enterprise_id")
    return mv.transaction_flags(wide).select(
        "enterprise_id", "remb_sepa_max", "pres_prlv_retourne", "pres_saisie"
    )


@query(
    "m03_interest_turnover",
    f"""WITH {_FLAG_SQL} SELECT enterprise_id, round(ratio, 9) AS net_interets_sur_turnover,
  CASE WHEN nops >= 60 AND ratio < -0.00143675995 THEN '1' ELSE '2' END AS net_int_turnover
FROM flagged""",
)
def interest_turnover(spark, sf):
    wide = mv.wide_by_condition(b.event_totals(spark, sf), "enterprise_id")
    return mv.transaction_flags(wide).select(
        "enterprise_id",
        F.round("net_interets_sur_turnover", 9).alias("net_interets_sur_turnover"),
        "net_int_turnover",
    )


@query(
    "m01_transaction_features",
    f"""WITH {_FLAG_SQL}
SELECT c_custkey AS enterprise_id, remb_sepa_max, pres_prlv_retourne, pres_saisie, nops,
  round(ratio, 9) AS net_interets_sur_turnover,
  CASE WHEN enterprise_id IS NULL THEN NULL
       WHEN nops >= 60 AND ratio < -0.00143675995 THEN '1' ELSE '2' END AS net_int_turnover,
  interets__netamount, saisie__nops, 'OK' AS flag_transac
FROM customer LEFT JOIN flagged ON enterprise_id = c_custkey""",
)
def transaction_features(spark, sf):
    main = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("enterprise_id"))
    out = mv.add_transaction_features(main, b.event_totals(spark, sf), "enterprise_id")
    return out.select(
        "enterprise_id",
        "remb_sepa_max",
        "pres_prlv_retourne",
        "pres_saisie",
        "nops",
        F.round("net_interets_sur_turnover", 9).alias("net_interets_sur_turnover"),
        "net_int_turnover",
        "interets__netamount",
        "saisie__nops",
        "flag_transac",
    )


@query(
    "a14_activity_features",
    """WITH r AS (
  SELECT user_id AS enterprise_id, value AS v, event_type AS t,
    CASE event_type WHEN 'view' THEN 'loyer' WHEN 'signup' THEN 'turnover'
      WHEN 'purchase' THEN 'pret' WHEN 'error' THEN 'rejected' ELSE 'interets' END AS category,
    CASE WHEN event_type IN ('signup', 'click') THEN 'credit' ELSE 'debit' END AS side,
    ts < TIMESTAMP '2024-01-16' AS first_half
  FROM events
)
SELECT enterprise_id, round(sum(v), 4) AS total_volume, count(v) AS n_movements,
  round(avg(v), 8) AS mean_amount, round(stddev_samp(v), 6) AS std_amount,
  round(stddev_samp(v) / avg(v), 6) AS cv_amount,
  round(sum(v) FILTER (WHERE first_half) / sum(v) FILTER (WHERE NOT first_half), 6)
    AS trend_halves,
  count(*) FILTER (WHERE v - 50 < 0) AS n_debit_days, round(min(v - 50), 4) AS min_balance,
  round(count(*) FILTER (WHERE category = 'rejected') / count(category), 6) AS reject_rate,
  round(sum(v * v) FILTER (WHERE side = 'credit') / power(sum(v) FILTER (WHERE side = 'credit'), 2), 6)
    AS revenue_concentration,
  count(DISTINCT category) FILTER (WHERE side = 'credit') AS n_revenue_sources,
  round(abs(sum(v) FILTER (WHERE category = 'loyer')) / sum(v) FILTER (WHERE side = 'credit'), 6)
    AS fixed_charge_ratio,
  round(abs(sum(v) FILTER (WHERE category = 'interets'))
    / sum(v) FILTER (WHERE category = 'turnover'), 6) AS interest_turnover_ratio,
  round(sum(v) FILTER (WHERE side = 'credit') / abs(sum(v) FILTER (WHERE category = 'pret')), 6)
    AS loan_cover,
  round(quantile_cont(v, 0.95), 6) AS p95_amount
FROM r GROUP BY enterprise_id""",
)
def activity_features(spark, sf):
    kind = F.col("event_type")
    rows = src.table(spark, sf, "events").select(
        F.col("user_id").alias("enterprise_id"),
        F.col("value").alias("amount"),
        F.when(kind == "view", "loyer")
        .when(kind == "signup", "turnover")
        .when(kind == "purchase", "pret")
        .when(kind == "error", "rejected")
        .otherwise("interets")
        .alias("category"),
        F.when(kind.isin("signup", "click"), "credit").otherwise("debit").alias("side"),
        F.when(F.col("ts") < "2024-01-16", 1).otherwise(2).alias("period"),
        (F.col("value") - 50).alias("balance"),
    )
    out = mv.activity_features(rows, "enterprise_id")
    exact = {"enterprise_id", "n_movements", "n_debit_days", "n_revenue_sources"}
    digits = {"total_volume": 4, "min_balance": 4, "mean_amount": 8}
    return out.select(
        *[
            F.col(c) if c in exact else F.round(c, digits.get(c, 6)).alias(c)
            for c in out.columns
        ]
    )
