"""The supplied tables in the roles of the banking tables.

Each role is given once as a DataFrame and once as a SQL common table expression for the
checks. Money is cast to decimals, so sums do not depend on the order of the rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.operators.movements import totals_by_category
from riskweave.sources.tables import table

AS_OF = date(2001, 8, 1)
EVENTS_AS_OF = date(2024, 1, 31)

# Stand-in movement codes and labels.
CODES = (9, 32, 1, 98, 89, 569, 60, 52, 29, 856, 26, 74, 36, 56, 857, 568, 4, 860)
LABELS = {
    0: "AVIS A TIERS DETENTEUR TRESOR PUBLIC X",
    1: "SAISIE ATTRIBUTION-BLOCAGE X",
    2: "DGFIP X",
    3: "D.G.F.I.P X",
    4: "SIE X",
    5: "URSSAF X",
    6: "AMORTISSEMENT PRET X",
}
EVENT_CATEGORIES = {
    "view": "interets",
    "signup": "turnover",
    "purchase": "prlv_sepa_retourne",
    "error": "rembt_prlv_sepa",
    "click": "attri_blocage",
}


def movements(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as booked movements."""
    line = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    label = F.col("p_name")
    for residue, text in LABELS.items():
        label = F.when(F.col("l_partkey") % 40 == residue, text).otherwise(label)
    amount = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    codes = F.array(*[F.lit(c).cast("long") for c in CODES])
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("account_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("movement_id"),
        F.col("l_shipdate").alias("operation_date"),
        F.get(codes, ((F.col("l_suppkey") + F.col("l_linenumber")) % 18).cast("int")).alias("code"),
        label.alias("label"),
        F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias("amount"),
        F.when(F.col("l_linenumber") == 7, "200").otherwise("100").alias("family"),
    )


def cancels(spark: SparkSession, sf: str) -> DataFrame:
    """Lines flagged A and F play the cancelled operations."""
    return (
        table(spark, sf, "lineitem")
        .where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("movement_id"),
            F.col("l_shipdate").alias("operation_date"),
        )
    )


_CODE_LIST = ", ".join(str(c) for c in CODES)
_LABEL_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABELS.items())

MOVEMENT_SQL = f"""movement AS (
  SELECT l_orderkey AS account_id,
         l_orderkey * 8 + l_linenumber AS movement_id,
         l_shipdate AS operation_date,
         list_extract([{_CODE_LIST}], 1 + (l_suppkey + l_linenumber) % 18) AS code,
         CASE l_partkey % 40 {_LABEL_CASES} ELSE p_name END AS label,
         CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DECIMAL(2,0))
           * CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount,
         CASE WHEN l_linenumber = 7 THEN '200' ELSE '100' END AS family
  FROM lineitem JOIN part ON l_partkey = p_partkey
), cancel AS (
  SELECT DISTINCT l_orderkey * 8 + l_linenumber AS movement_id, l_shipdate AS operation_date
  FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'
)"""


def _sql_list(values, quote: bool) -> str:
    if not values:
        return "NULL"
    shown = [f"'{v}'" for v in values] if quote else [str(v) for v in values]
    return "[" + ", ".join(shown) + "]"


_RULE_ROWS = ",\n    ".join(
    "({rank}, '{name}', {codes}, {side}, {labels})".format(
        rank=rank,
        name=rule.category,
        codes=_sql_list(rule.codes, False),
        side=f"'{rule.direction}'" if rule.direction else "NULL",
        labels=_sql_list(rule.label_prefixes, True),
    )
    for rank, rule in enumerate(rules.CATEGORY_RULES)
)

# The check joins the rule rows and takes the lowest rank, where the plan uses one CASE chain.
CATEGORY_SQL = f"""rule(rank, category, codes, side, labels) AS (
  VALUES
    {_RULE_ROWS}
), signed AS (
  SELECT *, CASE WHEN amount > 0 THEN 'credit' WHEN amount <= 0 THEN 'debit' END AS direction
  FROM movement
), matched AS (
  SELECT s.code, s.direction, s.label, arg_min(r.category, r.rank) AS category
  FROM (SELECT DISTINCT code, direction, label FROM signed) s
  JOIN rule r ON (r.codes IS NULL OR list_contains(r.codes, s.code))
    AND (r.side IS NULL OR r.side = s.direction)
    AND (r.labels IS NULL
         OR len(list_filter(r.labels, lambda p: starts_with(s.label, p))) > 0)
  GROUP BY ALL
), categorised AS (
  SELECT g.*, m.category
  FROM signed g LEFT JOIN matched m
    ON g.code = m.code AND g.direction = m.direction AND g.label = m.label
)"""


def enterprise_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the kept market that are active (balance not negative)."""
    return (
        table(spark, sf, "customer")
        .where((F.col("c_mktsegment") != "FURNITURE") & F.col("c_custkey").isNotNull())
        .select(F.col("c_custkey").alias("enterprise_id"))
    )


def holders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("enterprise_id"), F.col("o_orderkey").alias("account_id")
    )


ENTERPRISE_SQL = """enterprise AS (
  SELECT c_custkey AS enterprise_id FROM customer
  WHERE c_mktsegment <> 'FURNITURE' AND c_custkey IS NOT NULL
), holder AS (
  SELECT DISTINCT o_custkey AS enterprise_id, o_orderkey AS account_id FROM orders
)"""


def event_totals(spark: SparkSession, sf: str) -> DataFrame:
    """events summed per (user, event type) in the shape of category totals."""
    mapping = F.create_map(*[F.lit(x) for pair in EVENT_CATEGORIES.items() for x in pair])
    side = F.when(F.col("event_type") == "view", -1).otherwise(1)
    value = (F.col("value").cast("decimal(18,2)") * side).alias("amount")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("enterprise_id"),
        mapping[F.col("event_type")].alias("category"),
        value,
    )
    return totals_by_category(rows, "enterprise_id")


_EVENT_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CATEGORIES.items())

EVENT_TOTALS_SQL = f"""event_row AS (
  SELECT user_id AS enterprise_id, CASE event_type {_EVENT_CASES} END AS category,
         CASE WHEN event_type = 'view' THEN -1 ELSE 1 END * CAST(value AS DECIMAL(18,2)) AS amount
  FROM events
), event_total AS (
  SELECT enterprise_id, category, sum(amount) AS netamount, count(amount) AS nops_category,
         min(amount) AS min_amount, max(amount) AS max_amount,
         sum(count(amount)) OVER (PARTITION BY enterprise_id) AS nops_total
  FROM event_row GROUP BY enterprise_id, category
)"""
