"""Joins, statements, ratings, windows, group resolution and the score."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions import scalars as sc
from riskweave.operators import profiles as pf
from riskweave.operators import scope, scoring
from riskweave.operators import statements as st
from riskweave.plans import binding as b
from riskweave.plans import filter_queries as fq
from riskweave.plans.registry import query
from riskweave.sources import tables as src

_ISO = "yyyy-MM-dd"


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


# ------------------------------------------------------------------------------- joins


@query(
    "j02_resolved_identity",
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer
LEFT OUTER JOIN orders ON o_custkey = c_custkey
WHERE o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL""",
)
def resolved_identity(spark, sf):
    customer = src.table(spark, sf, "customer").select("c_custkey")
    orders = src.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return (
        customer.join(orders.dropna(), F.col("o_custkey") == F.col("c_custkey"))
        .select("c_custkey", "o_orderkey", "o_orderstatus")
    )


@query(
    "j04_left_enrichment",
    """WITH r AS (SELECT o_custkey, max(l_linenumber) AS overdraft_days FROM orders
  JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
bal AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS balance,
  count(*) AS n_accounts FROM orders GROUP BY 1)
SELECT c_custkey, overdraft_days, balance, n_accounts FROM customer
LEFT JOIN r ON r.o_custkey = c_custkey LEFT JOIN bal ON bal.o_custkey = c_custkey""",
)
def left_enrichment(spark, sf):
    main = src.table(spark, sf, "customer").select("c_custkey")
    orders = src.table(spark, sf, "orders")
    worst = (
        orders.join(
            src.table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max("l_linenumber").alias("overdraft_days"))
    )
    balance = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(money("o_totalprice")).cast("double").alias("balance"),
        F.count("*").alias("n_accounts"),
    )
    return scoring.enriched(scoring.enriched(main, worst, "c_custkey"), balance, "c_custkey")


@query(
    "j05_semi_join",
    """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def semi_join(spark, sf):
    scope_ids = src.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    orders = src.table(spark, sf, "orders")
    return orders.join(
        scope_ids, F.col("o_custkey") == F.col("c_custkey"), "left_semi"
    ).select("o_orderkey", "o_totalprice")


@query(
    "j06_filtered_dimension",
    """SELECT s_name, count(*) AS n FROM lineitem JOIN
  (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey GROUP BY 1""",
)
def filtered_dimension(spark, sf):
    """The dimension is filtered first; Spark broadcasts it if its size allows."""
    supplier = src.table(spark, sf, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    per_supplier = src.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n")
    )
    return per_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        "s_name"
    ).agg(F.sum("n").alias("n"))


@query(
    "j07_snapshot_join",
    """WITH a AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS m,
  count(*) AS n FROM orders GROUP BY ALL),
bb AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS m, count(*) AS urgent FROM orders
  WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT a.k AS enterprise_id, strftime(a.m, '%Y-%m-%d') AS extract_date, n, urgent
FROM a JOIN bb ON a.k = bb.k AND a.m = bb.m""",
)
def snapshot_join(spark, sf):
    orders = src.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("enterprise_id"),
        F.date_format(F.trunc("o_orderdate", "month"), _ISO).alias("extract_date"),
        "o_orderpriority",
    )
    keys = ["enterprise_id", "extract_date"]
    every = orders.groupBy(*keys).agg(F.count("*").alias("n"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy(*keys).agg(
        F.count("*").alias("urgent")
    )
    return every.join(urgent, keys)


@query(
    "j08_rating_drivers",
    """WITH h AS (SELECT o_custkey AS k, o_orderkey AS model, o_orderdate AS d,
  o_orderstatus AS c FROM orders),
dr AS (SELECT o_custkey AS k, l_orderkey AS model, o_orderdate AS d,
  CASE WHEN l_quantity > 25 THEN o_orderstatus END AS c,
  l_linenumber AS driver, l_quantity AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT h.k AS enterprise_id, h.model AS model_id, strftime(h.d, '%Y-%m-%d') AS day, driver, score
FROM h LEFT JOIN dr ON h.k = dr.k AND h.model = dr.model AND h.d = dr.d AND h.c = dr.c""",
)
def rating_drivers(spark, sf):
    keys = ["enterprise_id", "model_id", "day", "status"]
    history = src.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("enterprise_id"),
        F.col("o_orderkey").alias("model_id"),
        F.date_format("o_orderdate", _ISO).alias("day"),
        F.col("o_orderstatus").alias("status"),
    )
    lines = src.table(spark, sf, "lineitem")
    status = F.when(F.col("l_quantity") > 25, F.col("status"))
    drivers = history.join(lines, F.col("l_orderkey") == F.col("model_id")).select(
        *keys[:-1],
        status.alias("status"),
        F.col("l_linenumber").alias("driver"),
        F.col("l_quantity").alias("score"),
    )
    return history.join(drivers, keys, "left").drop("status")


@query(
    "j09_latest_with_ties",
    """WITH d AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1)
SELECT o.o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day
FROM orders o JOIN d ON o.o_custkey = d.o_custkey AND o_orderdate = newest""",
)
def latest_with_ties(spark, sf):
    rows = src.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return st.latest_with_ties(rows, "o_custkey", "o_orderdate").select(
        "o_custkey", "o_orderkey", F.date_format("o_orderdate", _ISO).alias("day")
    )


@query(
    "j10_statement_scope",
    """SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def statement_scope(spark, sf):
    per_nation = src.table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("n")
    )
    nation, region = src.table(spark, sf, "nation"), src.table(spark, sf, "region")
    return (
        per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_name", "r_name")
        .agg(F.sum("n").alias("n"))
    )


# ------------------------------------------------------------------------ aggregations


def _customer_lines(spark, sf):
    orders = src.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return (
        src.table(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumnRenamed("o_custkey", "enterprise_id")
    )


@query(
    "a06_max_overdraft",
    """SELECT o_custkey AS enterprise_id, max(l_linenumber) AS overdraft_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def max_overdraft(spark, sf):
    return _customer_lines(spark, sf).groupBy("enterprise_id").agg(
        F.max("l_linenumber").alias("overdraft_days")
    )


@query(
    "a07_risk_on_scope",
    """SELECT o_custkey AS enterprise_id, max(l_linenumber) AS overdraft_days,
  count(*) FILTER (WHERE l_linenumber > 5) AS n_alerts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE') GROUP BY 1""",
)
def risk_on_scope(spark, sf):
    lines = _customer_lines(spark, sf).join(
        b.enterprise_scope(spark, sf), "enterprise_id", "left_semi"
    )
    return lines.groupBy("enterprise_id").agg(
        F.max("l_linenumber").alias("overdraft_days"),
        F.count_if(F.col("l_linenumber") > 5).alias("n_alerts"),
    )


@query(
    "a08_balances",
    """SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS balance,
  count(o_orderkey) AS n_accounts FROM orders GROUP BY 1""",
)
def balances(spark, sf):
    accounts = src.table(spark, sf, "orders").withColumn(
        "cents", F.round(F.col("o_totalprice") * 100).cast("long")
    )
    return scoring.balances(accounts, "o_custkey", "o_orderkey", "cents")


_RATING_SQL = """rating AS (
  SELECT o_custkey, o_orderdate, o_orderstatus, o_orderpriority,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s
  FROM orders GROUP BY ALL
), newest AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderstatus DESC, o_orderpriority DESC) AS rn FROM rating
)"""


@query(
    "a09_newest_rating",
    f"""WITH {_RATING_SQL}
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, o_orderpriority,
  CAST(s AS DOUBLE) AS rating_score FROM newest WHERE rn = 1""",
)
def newest_rating(spark, sf):
    rows = src.table(spark, sf, "orders").withColumn("score", money("o_totalprice"))
    group = ["o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"]
    newest = scoring.newest_rating(rows, "o_custkey", "o_orderdate", group, "score")
    return newest.select(
        "o_custkey",
        F.date_format("o_orderdate", _ISO).alias("day"),
        "o_orderstatus",
        "o_orderpriority",
        F.col("rating_score").cast("double").alias("rating_score"),
    )


@query(
    "a10_statement_pivot",
    "SELECT l_orderkey, "
    + ", ".join(
        f"sum(l_quantity) FILTER (WHERE l_linenumber = {i}) AS mt_{i}" for i in range(1, 6)
    )
    + " FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4, 5) GROUP BY 1",
)
def statement_pivot(spark, sf):
    return st.wide_statement(
        src.table(spark, sf, "lineitem"),
        ["l_orderkey"],
        "l_linenumber",
        "l_quantity",
        [1, 2, 3, 4, 5],
    )


@query("a11_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_pairs(spark, sf):
    return src.table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@query(
    "a13_value_distribution",
    """SELECT event_type, count(*) AS n, count(value) AS n_present,
  count(*) - count(value) AS n_missing FROM events GROUP BY 1 ORDER BY n DESC""",
)
def value_distribution(spark, sf):
    return (
        src.table(spark, sf, "events")
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            F.count("value").alias("n_present"),
            F.count_if(F.col("value").isNull()).alias("n_missing"),
        )
        .orderBy(F.desc("n"))
    )


@query(
    "a15_contradictions",
    """WITH p AS (SELECT DISTINCT lower(trim(text, ' ')) AS q, source FROM documents),
w AS (SELECT q, count(*) AS n_targets FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT md5(q) AS question, source, n_targets FROM p JOIN w USING (q)""",
)
def contradictions(spark, sf):
    return pf.contradictions(src.table(spark, sf, "documents"), "text", "source").withColumn(
        "question", F.md5("question")
    )


@query(
    "a16_duplicates_and_blanks",
    """SELECT sha256(lower(trim(text, ' '))) AS hash, count(*) AS n, min(doc_id) AS first_id,
  max(CASE WHEN trim(text, ' ') = '' THEN 1 ELSE 0 END) AS is_blank
FROM documents GROUP BY lower(trim(text, ' ')) HAVING count(*) > 1 OR lower(trim(text, ' ')) = ''""",
)
def duplicates_and_blanks(spark, sf):
    return pf.duplicate_or_blank(src.table(spark, sf, "documents"), "doc_id", "text")


@query(
    "a17_completeness",
    """WITH o AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT'
  AND o_orderdate >= DATE '1999-01-01' THEN o_totalprice END) AS turnover FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN turnover IS NULL THEN 1 ELSE 0 END AS no_turnover,
  CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS no_balance,
  CAST(1 - CASE WHEN turnover IS NULL THEN 0.4 ELSE 0 END
    - CASE WHEN c_acctbal < 0 THEN 0.6 ELSE 0 END AS DOUBLE) AS completeness
FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
)
def completeness(spark, sf):
    known = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= "1999-01-01")
    turnover = (
        src.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max(F.when(known, F.col("o_totalprice"))).alias("turnover"))
    )
    joined = src.table(spark, sf, "customer").join(turnover, "c_custkey", "left").withColumn(
        "balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    )
    made = scoring.completeness({"turnover": 0.4, "balance": 0.6})
    return joined.select(
        "c_custkey",
        made["no_turnover"].alias("no_turnover"),
        made["no_balance"].alias("no_balance"),
        F.round(made["completeness"], 6).alias("completeness"),
    )


@query(
    "a18_daily_kpis",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n,
  round(avg(CASE WHEN value < 100 THEN 1 ELSE 0 END), 6) AS success_rate,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY 1, 2""",
)
def daily_kpis(spark, sf):
    kpis = pf.daily_kpis(
        src.table(spark, sf, "events"),
        F.date_format("ts", _ISO),
        ["event_type"],
        F.col("value") < 100,
        "value",
    )
    return kpis.select(
        "day",
        "event_type",
        "n",
        F.round("success_rate", 6).alias("success_rate"),
        F.round("median", 6).alias("median"),
        F.round("p95", 6).alias("p95"),
    )


@query(
    "a19_step_report",
    """WITH s AS (SELECT user_id AS run_id, event_type AS step,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS seconds FROM events GROUP BY ALL)
SELECT *, round(seconds / sum(seconds) OVER (PARTITION BY run_id), 9) AS share,
  CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY seconds DESC, step) <= 3
    THEN 1 ELSE 0 END AS is_slowest FROM s""",
)
def step_report(spark, sf):
    steps = src.table(spark, sf, "events").groupBy(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("step")
    ).agg(F.sum(money("value")).cast("double").alias("seconds"))
    return pf.step_report(steps).withColumn("share", F.round("share", 9))


@query(
    "a20_w12_volumetry",
    """SELECT event_type, n, round(n / sum(n) OVER (), 9) AS share FROM (
  SELECT event_type, count(*) AS n FROM events GROUP BY 1)""",
)
def volumetry(spark, sf):
    return pf.share_of_total(src.table(spark, sf, "events"), ["event_type"]).withColumn(
        "share", F.round("share", 9)
    )


@query(
    "a20_hourly_volumetry",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n
FROM events GROUP BY 1""",
)
def hourly_volumetry(spark, sf):
    return src.table(spark, sf, "events").groupBy(
        F.date_format("ts", "yyyy-MM-dd HH").alias("hour")
    ).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------------- windows


@query(
    "w04_m13_two_latest",
    """SELECT * EXCLUDE (d) FROM (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 2""",
)
def two_latest(spark, sf):
    rows = src.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ranked = st.latest_rows(
        rows, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], keep=2
    )
    return ranked.select(
        "o_custkey",
        "o_orderkey",
        F.date_format("o_orderdate", _ISO).alias("day"),
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    "w05_w06_w07_newest_row",
    """SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey,
  strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders GROUP BY 1""",
)
def newest_row(spark, sf):
    rows = src.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = st.latest_rows(rows, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select(
        "o_custkey", "o_orderkey", F.date_format("o_orderdate", _ISO).alias("day")
    )


@query(
    "w08_f04_exercise_length",
    """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
p AS (SELECT o_custkey, d, lag(d) OVER (PARTITION BY o_custkey ORDER BY d) AS prev FROM d)
SELECT o_custkey, strftime(d, '%Y-%m-%d') AS closing, strftime(prev, '%Y-%m-%d') AS previous,
  round(date_diff('day', prev, d) / 30.44, 6) AS months,
  round(CASE WHEN date_diff('day', prev, d) / 30.44 > 0 THEN date_diff('day', prev, d) / 30.44
    ELSE 12 END, 6) AS valid_months FROM p""",
)
def exercise_length(spark, sf):
    closings = src.table(spark, sf, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("closing")
    )
    before = st.previous_closing(closings, "o_custkey", "closing")
    months = sc.exercise_months("closing", "previous_closing")
    return before.select(
        "o_custkey",
        F.date_format("closing", _ISO).alias("closing"),
        F.date_format("previous_closing", _ISO).alias("previous"),
        F.round(months, 6).alias("months"),
        F.round(sc.valid_exercise_months(F.lit(None), months), 6).alias("valid_months"),
    )


@query(
    "w09_change_over_previous",
    """WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS yr,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL),
p AS (SELECT *, lag(v) OVER (PARTITION BY o_custkey ORDER BY yr) AS pv FROM y)
SELECT o_custkey, yr AS year, v AS amount, round((v - pv) / abs(pv), 6) AS change,
  CAST(sign(v - pv) AS DOUBLE) AS trend, round(abs(v - pv) / sqrt(2), 6) AS volatility FROM p""",
)
def change_over_previous(spark, sf):
    yearly = src.table(spark, sf, "orders").groupBy(
        "o_custkey", F.year("o_orderdate").alias("year")
    ).agg(F.sum(money("o_totalprice")).cast("double").alias("amount"))
    return st.change_over_previous(yearly, "o_custkey", "year", "amount").select(
        "o_custkey",
        "year",
        "amount",
        F.round("change", 6).alias("change"),
        "trend",
        F.round("volatility", 6).alias("volatility"),
    )


@query(
    "w10_segment_median",
    """WITH c AS (SELECT *, CASE WHEN c_acctbal < 1000 THEN NULL ELSE c_acctbal END AS bal FROM customer)
SELECT c_custkey, c_mktsegment,
  round(coalesce(bal, quantile_cont(bal, 0.5) OVER (PARTITION BY c_mktsegment)), 6) AS balance FROM c""",
)
def segment_median(spark, sf):
    rows = src.table(spark, sf, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.when(F.col("c_acctbal") >= 1000, F.col("c_acctbal")).alias("balance"),
    )
    return pf.impute_by_segment(rows, "balance", "c_mktsegment").withColumn(
        "balance", F.round("balance", 6)
    )


@query(
    "w11_moving_average",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS s,
  count(value) AS n FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w, 6)
  AS moving_average FROM d
WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""",
)
def moving_average(spark, sf):
    daily = src.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.sum(money("value")).alias("s"), F.count("value").alias("n")
    )
    out = pf.moving_average(daily.withColumn("s", F.col("s").cast("double")), "day", "s", "n")
    return out.select(
        F.date_format("day", _ISO).alias("day"),
        F.round("moving_average", 6).alias("moving_average"),
    )


# ---------------------------------------------------------------------------- set work


@query(
    "o02_recent_months",
    """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders
  ORDER BY 1 DESC LIMIT 7)
SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders
WHERE strftime(o_orderdate, '%Y%m') IN (SELECT month FROM m) GROUP BY 1""",
)
def recent_months(spark, sf):
    rows = src.table(spark, sf, "orders").select(sc.year_month("o_orderdate").alias("month"))
    per_month = rows.groupBy("month").agg(F.count("*").alias("n"))
    return per_month.orderBy(F.desc("month")).limit(7)


def _links(spark, sf):
    """customer in business groups: supplier nations play the groups of its orders."""
    orders = src.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "CAPIT").otherwise("OTHER")
    return orders.select(
        F.col("o_custkey").alias("enterprise_id"),
        (F.col("o_orderkey") % 5).alias("group_id"),
        kind.alias("link_type"),
        F.date_format("o_orderdate", "yyyy-MM").alias("start_date"),
        F.date_format("o_orderdate", _ISO).alias("update_date"),
    )


_LINK_SQL = """link AS (
  SELECT o_custkey AS enterprise_id, o_orderkey % 5 AS group_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'CAPIT' ELSE 'OTHER' END AS link_type,
    strftime(o_orderdate, '%Y-%m') AS start_date, strftime(o_orderdate, '%Y-%m-%d') AS update_date
  FROM orders
), sized AS (
  SELECT *, count(DISTINCT group_id) OVER (PARTITION BY enterprise_id) AS n_groups FROM link
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY enterprise_id ORDER BY
    CASE WHEN link_type = 'CAPIT' THEN 1 ELSE 0 END DESC, start_date DESC, update_date DESC,
    group_id DESC) AS rn FROM sized
)"""


@query(
    "o08_business_groups",
    f"""WITH {_LINK_SQL} SELECT enterprise_id, group_id, link_type, start_date, update_date
FROM ranked WHERE rn = 1 AND (n_groups = 1 OR link_type = 'CAPIT')""",
)
def business_groups(spark, sf):
    return scope.resolve_groups(_links(spark, sf), "enterprise_id", "group_id")


@query(
    "o08_business_groups_kept",
    f"""WITH {_LINK_SQL} SELECT enterprise_id, group_id, link_type, start_date, update_date
FROM ranked WHERE rn = 1""",
)
def business_groups_kept(spark, sf):
    return scope.resolve_groups(
        _links(spark, sf), "enterprise_id", "group_id", drop_if_no_capital=False
    )


_BRANCH_SQL = """branch_sized AS (
  SELECT enterprise_id, count(DISTINCT group_id) AS n_groups,
    count(DISTINCT group_id) FILTER (WHERE link_type = 'CAPIT') AS n_capital
  FROM link GROUP BY 1
), pick AS (
  SELECT l.*, n_groups, n_capital, row_number() OVER (PARTITION BY enterprise_id
    ORDER BY start_date DESC, update_date DESC, group_id DESC) AS rn
  FROM link l JOIN branch_sized USING (enterprise_id)
  WHERE n_groups = 1 OR link_type = 'CAPIT'
)"""
_BRANCH_ROWS = "SELECT enterprise_id, group_id, link_type, start_date, update_date FROM pick WHERE rn = 1 AND "


@query(
    "o06_union_distinct",
    f"WITH {_LINK_SQL}, {_BRANCH_SQL} {_BRANCH_ROWS} n_groups = 1 UNION {_BRANCH_ROWS}"
    f" n_groups > 1 AND n_capital = 1 UNION {_BRANCH_ROWS} n_groups > 1 AND n_capital > 1",
)
def union_distinct(spark, sf):
    single, one, several = scope.group_branches(_links(spark, sf), "enterprise_id", "group_id")
    return single.unionByName(one).unionByName(several).distinct()


@query(
    "o07_union_all",
    f"WITH {_LINK_SQL}, {_BRANCH_SQL} {_BRANCH_ROWS} n_groups = 1 UNION ALL {_BRANCH_ROWS}"
    f" n_groups > 1 AND n_capital = 1 UNION ALL {_BRANCH_ROWS} n_groups > 1 AND n_capital > 1",
)
def union_all(spark, sf):
    single, one, several = scope.group_branches(_links(spark, sf), "enterprise_id", "group_id")
    return single.unionByName(one).unionByName(several)


# ------------------------------------------------------------------ encoders, features


@query(
    "m04_m06_encoders",
    f"""WITH {fq.ELIGIBILITY_SQL}
SELECT enterprise_id,
  CASE WHEN legal_form IN ('26','27','33','30') THEN '1-3'
       WHEN legal_form IN ('20','21','29','55','59','64') THEN '4-6' ELSE '7' END AS legal_form_class,
  CASE WHEN real_estate IS NULL THEN '0' ELSE '1' END AS top_ga,
  CASE WHEN coalesce(trim(real_estate), '') = '' THEN '0' ELSE '1' END AS top_ga_blank
FROM candidate""",
)
def encoders(spark, sf):
    return fq.eligibility_rows(spark, sf).select(
        "enterprise_id",
        scoring.legal_form_class("legal_form").alias("legal_form_class"),
        scoring.group_flag("real_estate").alias("top_ga"),
        scoring.group_flag("real_estate", blank_is_null=True).alias("top_ga_blank"),
    )


_SECTOR_CODES = tuple(code for code, _ in rules.SECTOR_SAMPLE) + ("999999",)


def _with_sector(spark, sf):
    index = (F.col("p_size") % len(_SECTOR_CODES)).cast("int")
    return src.table(spark, sf, "part").withColumn(
        "sector_code", F.get(F.array(*[F.lit(c) for c in _SECTOR_CODES]), index)
    )


@query(
    "m05_sector_class",
    "WITH m(sector_code, sector_class) AS (VALUES "
    + ", ".join(f"('{c}', '{k}')" for c, k in rules.SECTOR_SAMPLE)
    + "), p AS (SELECT p_partkey, list_extract(["
    + ", ".join(f"'{c}'" for c in _SECTOR_CODES)
    + f"], 1 + p_size % {len(_SECTOR_CODES)}) AS sector_code FROM part)"
    " SELECT p_partkey, sector_code, coalesce(sector_class, '3') AS sector_class"
    " FROM p LEFT JOIN m USING (sector_code)",
)
def sector_class(spark, sf):
    rows = _with_sector(spark, sf).select("p_partkey", "sector_code")
    return scoring.add_sector_class(rows, "sector_code", scoring.sector_mapping(spark))


@query(
    "m07_risk_features",
    """WITH r AS (SELECT o_custkey, max(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_linenumber END) AS m
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS enterprise_id, m AS overdraft_days, 'OK' AS flag_risk
FROM customer LEFT JOIN r ON o_custkey = c_custkey""",
)
def risk_features(spark, sf):
    main = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("enterprise_id"))
    late = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    lines = _customer_lines(spark, sf).withColumn("days", F.when(late, F.col("l_linenumber")))
    return scoring.add_risk_features(main, lines, "enterprise_id", "days")


@query(
    "m08_balance_features",
    """WITH a AS (SELECT o_custkey,
  sum(CASE WHEN o_orderdate >= DATE '2001-01-01' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) / 100.0 AS bal,
  count(CASE WHEN o_orderdate >= DATE '2001-01-01' THEN o_orderkey END) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS enterprise_id, bal AS balance, n AS n_accounts, 'OK' AS flag_balance
FROM customer LEFT JOIN a ON o_custkey = c_custkey""",
)
def balance_features(spark, sf):
    main = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("enterprise_id"))
    current = F.col("o_orderdate") >= "2001-01-01"
    accounts = src.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("enterprise_id"),
        F.when(current, F.col("o_orderkey")).alias("o_orderkey"),
        F.when(current, F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
    )
    return scoring.add_balance_features(main, accounts, "enterprise_id", "o_orderkey", "cents")


@query(
    "m09_rating_features",
    """WITH r AS (SELECT o_custkey, o_orderdate, o_orderstatus, o_orderpriority,
    sum(CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / -50000 END
      AS DECIMAL(18,6))) AS s FROM orders GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderstatus DESC, o_orderpriority DESC) AS rn FROM r)
SELECT c_custkey AS enterprise_id, round(CAST(s AS DOUBLE), 6) AS rating_score,
  round(1 / (1 + exp(-CAST(s AS DOUBLE))), 9) AS rating_probability
FROM customer LEFT JOIN n ON o_custkey = c_custkey AND rn = 1""",
)
def rating_features(spark, sf):
    main = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("enterprise_id"))
    value = (F.col("o_totalprice") / -50000).cast("decimal(18,6)").cast("string")
    text = F.when(F.col("o_orderstatus") == "P", "#REF!").otherwise(
        F.replace(value, F.lit("."), F.lit(","))
    )
    ratings = src.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("enterprise_id"),
        "o_orderdate",
        "o_orderstatus",
        "o_orderpriority",
        text.alias("q_score"),
    )
    group = ["enterprise_id", "o_orderdate", "o_orderstatus", "o_orderpriority"]
    out = scoring.add_rating_features(
        main, ratings, "enterprise_id", "o_orderdate", group, "q_score"
    )
    return out.select(
        "enterprise_id",
        F.round("rating_score", 6).alias("rating_score"),
        F.round("rating_probability", 9).alias("rating_probability"),
    )


# ------------------------------------------------------------------------- statements

_CONSO_CODES = [*rules.CONSO_RESULT, "24", "309"]
_SOLO_CODES = list(dict.fromkeys([*rules.CASH_FLOW_REGIME_1, *rules.CASH_FLOW_REGIME_2]))


def _statement_lines(spark, sf, codes):
    """Quantities of an order spread over the statement codes by part and line."""
    index = ((F.col("l_partkey") + F.col("l_linenumber")) % len(codes)).cast("int")
    return src.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 400).alias("company"),
        F.get(F.array(*[F.lit(c) for c in codes]), index).alias("code"),
        F.col("l_quantity").alias("value"),
    )


def _statement_sql(codes):
    shown = ", ".join(f"'{c}'" for c in codes)
    wide = ", ".join(f"sum(value) FILTER (WHERE code = '{c}') AS mt_{c}" for c in codes)
    return f"""line AS (
  SELECT l_orderkey % 400 AS company, l_quantity AS value,
    list_extract([{shown}], 1 + (l_partkey + l_linenumber) % {len(codes)}) AS code FROM lineitem
), wide AS (SELECT company, {wide} FROM line GROUP BY 1)"""


def _signed_sql(codes):
    return " ".join(f"{'+' if sign > 0 else '-'} mt_{code}" for code, sign in codes.items())


@query(
    "m10_conso_ratios",
    f"""WITH {_statement_sql(_CONSO_CODES)}, months AS (SELECT *, 6 + company % 12 AS m FROM wide),
r AS (SELECT company, ({_signed_sql(rules.CONSO_RESULT)}) / m * 12 AS res,
  CASE WHEN mt_310 IS NOT NULL THEN mt_310 / m * 12 ELSE (mt_24 + mt_309) / m * 12 END AS ca FROM months)
SELECT company, round(res, 6) AS conso_result, round(ca, 6) AS conso_turnover,
  round(res / nullif(ca, 0) * 100, 6) AS VB023 FROM r""",
)
def conso_ratios(spark, sf):
    wide = st.wide_statement(
        _statement_lines(spark, sf, _CONSO_CODES), ["company"], "code", "value", _CONSO_CODES
    ).withColumn("months", 6 + F.col("company") % 12)
    return st.conso_ratios(wide, "months").select(
        "company",
        *[F.round(c, 6).alias(c) for c in ("conso_result", "conso_turnover", "VB023")],
    )


@query(
    "m11_m12_solo_ratios",
    f"""WITH {_statement_sql(_SOLO_CODES)}, s AS (SELECT *,
    CASE company % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' ELSE '1' END AS regime,
    CASE WHEN company % 13 = 0 THEN 12 ELSE company % 13 END AS m FROM wide),
r AS (SELECT *, CASE regime WHEN '1' THEN ({_signed_sql(rules.CASH_FLOW_REGIME_1)}) / m * 12
  WHEN '2' THEN ({_signed_sql(rules.CASH_FLOW_REGIME_2)}) / m * 12 END AS caf FROM s)
SELECT company, regime, round(caf, 6) AS cash_flow,
  round(coalesce(caf / nullif(mt_469, 0), 0) * 100, 6) AS VB005,
  round(coalesce(mt_182 / nullif(mt_294, 0), 0) * 100, 6) AS VB035,
  round(coalesce(mt_290 / nullif(mt_294, 0), 0) * 100, 6) AS VB055 FROM r""",
)
def solo_ratios(spark, sf):
    company = F.col("company")
    declared = F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.lit(None)),
                            (company % 4 + 1).cast("int"))
    wide = (
        st.wide_statement(
            _statement_lines(spark, sf, _SOLO_CODES), ["company"], "code", "value", _SOLO_CODES
        )
        .withColumn("regime", st.imputed_tax_regime(declared, F.lit(1)))
        .withColumn("months", sc.valid_exercise_months(company % 13, F.lit(0.0)))
    )
    out = st.solo_ratios(
        wide, "regime", "months", F.col("mt_469"), F.col("mt_182"), F.col("mt_290"), F.col("mt_294")
    )
    return out.select(
        "company",
        "regime",
        *[F.round(c, 6).alias(c) for c in ("cash_flow", "VB005", "VB035", "VB055")],
    )


_POSTS = (
    "current_assets current_liabilities inventory cash equity total_liabilities financial_debt "
    "long_term_debt cash_flow net_result total_assets gross_surplus turnover operating_result "
    "mean_inventory receivables payables purchases fixed_assets working_capital_need "
    "net_working_capital interest_charges debt_service turnover_n1 net_result_n1 staff staff_n1 "
    "equity_n1"
).split()


def _posts(spark, sf):
    """Statement posts of a company; net result and equity are shifted so some are negative."""
    index = ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(_POSTS)).cast("int")
    rows = src.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 400).alias("company"),
        F.get(F.array(*[F.lit(p) for p in _POSTS]), index).alias("post"),
        F.col("l_quantity").alias("value"),
    )
    wide = rows.groupBy("company").pivot("post", _POSTS).agg(F.sum("value"))
    for name in ("net_result", "net_result_n1", "equity", "cash"):
        wide = wide.withColumn(name, F.col(name) - 150)
    return wide


_POST_LIST = ", ".join(f"'{p}'" for p in _POSTS)
_POST_WIDE = ", ".join(
    f"sum(value) FILTER (WHERE post = '{p}')"
    + (" - 150" if p in ("net_result", "net_result_n1", "equity", "cash") else "")
    + f" AS {p}"
    for p in _POSTS
)
_POST_SQL = f"""line AS (SELECT l_orderkey % 400 AS company, l_quantity AS value,
  list_extract([{_POST_LIST}], 1 + (l_partkey * 7 + l_linenumber) % {len(_POSTS)}) AS post
  FROM lineitem), posts AS (SELECT company, {_POST_WIDE} FROM line GROUP BY 1)"""
_Q = "{} / nullif({}, 0)"
_RATIO_SQL = {
    "current_ratio": _Q.format("current_assets", "current_liabilities"),
    "quick_ratio": _Q.format("(current_assets - inventory)", "current_liabilities"),
    "cash_ratio": _Q.format("cash", "current_liabilities"),
    "equity_ratio": _Q.format("equity", "total_liabilities"),
    "gearing": _Q.format("financial_debt", "equity"),
    "repayment_years": _Q.format("long_term_debt", "cash_flow"),
    "roe": _Q.format("net_result", "equity"),
    "roa": _Q.format("net_result", "total_assets"),
    "gross_margin": _Q.format("gross_surplus", "turnover"),
    "operating_margin": _Q.format("operating_result", "turnover"),
    "inventory_turns": _Q.format("turnover", "mean_inventory"),
    "customer_days": "365 * " + _Q.format("receivables", "turnover"),
    "supplier_days": "365 * " + _Q.format("payables", "purchases"),
    "capital_intensity": _Q.format("fixed_assets", "total_assets"),
    "working_capital_share": _Q.format("working_capital_need", "turnover"),
    "working_capital_cover": _Q.format("net_working_capital", "working_capital_need"),
    "interest_cover": _Q.format("gross_surplus", "interest_charges"),
    "debt_cover": _Q.format("cash_flow", "debt_service"),
    "turnover_growth": _Q.format("(turnover - turnover_n1)", "turnover_n1"),
    "result_growth": _Q.format("(net_result - net_result_n1)", "abs(net_result_n1)"),
    "staff_growth": _Q.format("(staff - staff_n1)", "staff_n1"),
    "loss_flag": "CAST(net_result < 0 AS INT)",
    "negative_equity_flag": "CAST(equity < 0 AS INT)",
    "negative_cash_flag": "CAST(cash < 0 AS INT)",
    "repeated_loss_flag": "CAST(net_result < 0 AND net_result_n1 < 0 AS INT)",
}


def _shown_ratio(name, sql):
    return f"{sql} AS {name}" if name.endswith("_flag") else f"round({sql}, 6) + 0.0 AS {name}"


@query(
    "m20_financial_ratios",
    f"WITH {_POST_SQL} SELECT company, "
    + ", ".join(_shown_ratio(n, s) for n, s in _RATIO_SQL.items())
    + " FROM posts",
)
def financial_ratios(spark, sf):
    made = st.financial_ratios()
    return _posts(spark, sf).select(
        "company",
        *[
            (c if n.endswith("_flag") else F.round(c, 6)).alias(n) for n, c in made.items()
        ],
    )


@query(
    "m21_interactions",
    f"""WITH {_POST_SQL}, r AS (SELECT *, current_assets / nullif(current_liabilities, 0) AS lq,
  financial_debt / nullif(equity, 0) AS ge, net_result / nullif(equity, 0) AS ro,
  gross_surplus / nullif(turnover, 0) AS gm FROM posts)
SELECT company, round(cash * 0.5, 6) AS balance_x_rating, round(turnover * ge, 6) AS turnover_x_gearing,
  round(3 * lq, 6) AS sector_x_liquidity,
  round(20 / 180.0 * (0.1 + 0.01) * (1 / nullif(lq + 0.1, 0)), 6) AS stress_score,
  round(0.3 * least(greatest(ro, -1), 1) + 0.3 * least(greatest(lq, 0), 3) / 3
    + 0.2 * (1 - least(greatest(ge, 0), 5) / 5) + 0.2 * least(greatest(gm, -0.5), 0.5) + 0.5, 6)
    AS health_score FROM r""",
)
def interactions(spark, sf):
    ratios = st.financial_ratios()
    rows = _posts(spark, sf).select(
        "company",
        "turnover",
        F.col("cash").alias("balance"),
        F.lit(0.5).alias("rating_score"),
        F.lit("3").alias("sector_class"),
        F.lit(20).alias("n_debit_days"),
        F.lit(0.1).alias("reject_rate"),
        *[ratios[n].alias(n) for n in ("current_ratio", "gearing", "roe", "gross_margin")],
    )
    return rows.select(
        "company", *[F.round(c, 6).alias(n) for n, c in st.interactions().items()]
    )


# ------------------------------------------------------------------- binning and score


@query(
    "m14_m15_binning",
    """SELECT c_custkey, CASE WHEN c_acctbal * 10 < -9.10499954 THEN '1'
    WHEN c_acctbal * 10 < 15235.6445 THEN '2' WHEN c_acctbal * 10 < 76378.7031 THEN '3' ELSE '4' END
    AS solde_cav_char,
  CASE WHEN c_custkey % 11 = 0 OR c_custkey % 11 = 1 THEN NULL
    ELSE CAST(1 + len(list_filter([0.00142771716, 0.00274042692, 0.00563700218, 0.0102700535,
      0.0129012, 0.0147122974, 0.0159990136, 0.0456250459],
      lambda e: e <= CAST(c_acctbal / 200000 AS DOUBLE))) AS VARCHAR) END AS reboot_score_char2,
  CASE WHEN c_nationkey > 12 THEN '>12' ELSE '<=12' END AS nbj,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'ME' ELSE 'autres' END AS seg_nae,
  CASE WHEN c_acctbal / 1000 < 0.430999994 THEN '1' WHEN c_acctbal / 1000 < 2.99849987 THEN '2'
    ELSE '3' END AS rn_ca_conso_023b,
  CASE WHEN c_acctbal / 100 < 66.2200012 THEN '1' ELSE '2' END AS caf_dmlt_005,
  CASE WHEN c_acctbal / 1000 < -8.194 THEN '1' WHEN c_acctbal / 1000 < 2.020 THEN '2'
    WHEN c_acctbal / 1000 < 7.104 THEN '3' ELSE '4' END AS res_total_passif_035,
  CASE WHEN c_acctbal / 100 < 22.643 THEN '1' WHEN c_acctbal / 100 < 47.462 THEN '2' ELSE '3' END
    AS immob_total_passif_055
FROM customer""",
)
def binning(spark, sf):
    balance, key = F.col("c_acctbal"), F.col("c_custkey")
    rows = src.table(spark, sf, "customer").select(
        "c_custkey",
        (balance * 10).alias("balance"),
        F.when(key % 11 == 0, F.lit(None))
        .when(key % 11 == 1, F.lit(rules.RATING_BINS.hole))
        .otherwise(balance / 200000)
        .alias("rating_probability"),
        F.col("c_nationkey").alias("overdraft_days"),
        F.when(F.col("c_mktsegment") == "BUILDING", "ME").otherwise("GR").alias("segment"),
        (balance / 1000).alias("VB023"),
        (balance / 100).alias("VB005"),
        (balance / 1000).alias("VB035"),
        (balance / 100).alias("VB055"),
    )
    made = scoring.score_variables()
    names = (
        "solde_cav_char reboot_score_char2 nbj seg_nae rn_ca_conso_023b caf_dmlt_005 "
        "res_total_passif_035 immob_total_passif_055"
    ).split()
    return rows.select("c_custkey", *[made[n].alias(n) for n in names])


def _modalities(variable: str) -> list[str]:
    return [m for v, m, _ in rules.COEFFICIENTS if v == variable]


def scored_customers(spark, sf):
    """customer with a modality of every variable; a modality past the last one is unknown."""
    key = F.col("c_custkey")
    rows = src.table(spark, sf, "customer").select(key.alias("enterprise_id"))
    for i, variable in enumerate(rules.SCORE_VARIABLES):
        known = _modalities(variable)
        index = (F.floor(F.col("enterprise_id") / (i + 1)) % (len(known) + 1)).cast("int")
        rows = rows.withColumn(variable, F.get(F.array(*[F.lit(m) for m in known]), index))
    return rows


def _weight_sql(i: int, variable: str) -> str:
    weights = ", ".join(repr(c) for v, _, c in rules.COEFFICIENTS if v == variable)
    n = len(_modalities(variable))
    return f"coalesce(list_extract([{weights}], 1 + (c_custkey // {i + 1}) % {n + 1}), 0.0)"


SCORE_SQL = (
    "z AS (SELECT c_custkey AS enterprise_id, CAST(-3.86402362750751 AS DOUBLE) + "
    + " + ".join(f"CAST({_weight_sql(i, v)} AS DOUBLE)" for i, v in enumerate(rules.SCORE_VARIABLES))
    + " AS z FROM customer), p AS (SELECT *, 1 - 1 / (1 + exp(-z)) AS pdo FROM z)"
)


@query(
    "m16_m17_score",
    f"""WITH {SCORE_SQL} SELECT enterprise_id, round(z, 9) AS sum_total_coeffs,
  round(pdo, 9) AS PDO_compute, CASE WHEN pdo < 0.0001 THEN 0.0001 ELSE round(pdo, 4) END AS PDO,
  'flag' AS flag_pdo_OK FROM p""",
)
def score(spark, sf):
    return scoring.add_score(scored_customers(spark, sf)).select(
        "enterprise_id",
        F.round("sum_total_coeffs", 9).alias("sum_total_coeffs"),
        F.round("PDO_compute", 9).alias("PDO_compute"),
        "PDO",
        "flag_pdo_OK",
    )


@query(
    "m17_score_direct",
    f"""WITH {SCORE_SQL} SELECT enterprise_id, round(z + 3.86402362750751, 9) AS z,
  round(1 / (1 + exp(-(z + 3.86402362750751))), 9) AS probability FROM p""",
)
def score_direct(spark, sf):
    out = scoring.add_score(
        scored_customers(spark, sf), include_intercept=False, orientation="direct"
    )
    return out.select(
        "enterprise_id",
        F.round("sum_total_coeffs", 9).alias("z"),
        F.round("PDO_compute", 9).alias("probability"),
    )


@query(
    "m18_one_hot_model",
    f"""WITH {SCORE_SQL} SELECT enterprise_id, CASE WHEN 1 / (1 + exp(-z)) < 0.0001 THEN 0.0001
  ELSE round(1 / (1 + exp(-z)), 4) END AS probability FROM p""",
)
def one_hot_model(spark, sf):
    wide = scoring.one_hot(scored_customers(spark, sf))
    weights = {scoring.one_hot_name(v, m): c for v, m, c in rules.COEFFICIENTS}
    return scoring.add_linear_probability(wide, weights, rules.INTERCEPT).select(
        "enterprise_id", "probability"
    )


@query(
    "a12_score_summary",
    f"""WITH {SCORE_SQL} SELECT round(min(pdo), 9) AS minimum, round(max(pdo), 9) AS maximum,
  round(avg(pdo), 9) AS mean, round(median(pdo), 9) AS median FROM p""",
)
def score_summary(spark, sf):
    scored = scoring.add_score(scored_customers(spark, sf))
    out = pf.score_summary(scored, "PDO_compute")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "m27_decision_tags",
    """SELECT event_id, concat_ws(',', 'risk:' || CASE WHEN value > 200 THEN 'high' ELSE 'low' END,
  CASE WHEN event_type = 'error' THEN 'fraud_detected' END,
  CASE WHEN value * 5 > 500 THEN 'high_value' END,
  CASE WHEN user_id > 100 THEN 'far_merchant' END,
  CASE WHEN hour(ts) < 6 THEN 'night_transaction' END) AS tags FROM events""",
)
def decision_tags(spark, sf):
    rows = src.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("value") > 200, "high").otherwise("low").alias("risk"),
        (F.col("event_type") == "error").alias("fraud"),
        (F.col("value") * 5).alias("amount"),
        F.col("user_id").alias("distance"),
        (F.hour("ts") < 6).alias("night"),
    )
    made = scoring.decision_tags("risk", "fraud", "amount", "distance", "night")
    return rows.select("event_id", F.array_join(made, ",").alias("tags"))


# --------------------------------------------------------- imputation, encoders, screens


@query(
    "m22_imputation",
    """WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal >= 1000 THEN c_acctbal END AS b,
  CASE WHEN c_acctbal >= 6000 THEN c_acctbal END AS r,
  CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS t FROM customer)
SELECT c_custkey, c_mktsegment,
  round(coalesce(b, quantile_cont(b, 0.5) OVER (PARTITION BY c_mktsegment)), 6) AS balance,
  round(coalesce(r, (SELECT quantile_cont(r, 0.5) FROM c)), 6) AS rare,
  CASE WHEN r IS NULL THEN 1 ELSE 0 END AS rare_missing, coalesce(t, 'UNKNOWN') AS kind FROM c""",
)
def imputation(spark, sf):
    balance = F.col("c_acctbal")
    rows = src.table(spark, sf, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.when(balance >= 1000, balance).alias("balance"),
        F.when(balance >= 6000, balance).alias("rare"),
        F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("kind"),
    )
    out = pf.impute(rows, ["balance", "rare"], ["kind"], "c_mktsegment")
    return out.withColumn("balance", F.round("balance", 6)).withColumn(
        "rare", F.round("rare", 6)
    )


@query(
    "m23_f12_outlier_forms",
    """WITH q AS (SELECT quantile_cont(c_acctbal, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q FROM customer)
SELECT c_custkey, round(least(greatest(c_acctbal, q[1]), q[5]), 6) AS winsorised,
  round((c_acctbal - q[3]) / (q[4] - q[2]), 6) AS scaled,
  round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS logged FROM customer, q""",
)
def outlier_forms(spark, sf):
    rows = src.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return pf.outlier_forms(rows, "c_acctbal").select(
        "c_custkey",
        F.round("winsorised", 6).alias("winsorised"),
        F.round("scaled", 6).alias("scaled"),
        F.round(sc.signed_log("c_acctbal"), 6).alias("logged"),
    )


@query(
    "m24_target_encoding",
    """WITH d AS (SELECT doc_id, source, quality, doc_id % 5 AS fold FROM documents JOIN labels USING (doc_id)),
f AS (SELECT source, fold, sum(quality) AS s, count(*) AS n FROM d GROUP BY ALL),
o AS (SELECT source, fold, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS e FROM f
  WINDOW w AS (PARTITION BY source))
SELECT doc_id, d.source, CAST(d.fold AS INT) AS fold,
  round(coalesce(e, (SELECT avg(quality) FROM d)), 6) AS encoded
FROM d JOIN o ON d.source = o.source AND d.fold = o.fold""",
)
def target_encoding(spark, sf):
    rows = src.table(spark, sf, "documents").select("doc_id", "source").join(
        src.table(spark, sf, "labels"), "doc_id"
    )
    return pf.out_of_fold_target(rows, "source", "quality", F.col("doc_id") % 5).select(
        "doc_id", "source", "fold", F.round("encoded", 6).alias("encoded")
    )


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{c}' AS \"right\", round(corr({a}, {c}), 6) AS correlation FROM lineitem"
    for i, a in enumerate(_NUMERIC)
    for c in _NUMERIC[i + 1 :]
)


@query("m25_correlations", _PAIR_SQL)
def correlations(spark, sf):
    return pf.correlation_pairs(src.table(spark, sf, "lineitem"), _NUMERIC).withColumn(
        "correlation", F.round("correlation", 6)
    )


def _determinant_sql(names: list[str]) -> str:
    """The determinant of the correlation matrix of ``names``, as a sum over all permutations."""
    n = len(names)
    terms = []
    for order in itertools.permutations(range(n)):
        odd = sum(order[i] > order[j] for i in range(n) for j in range(i + 1, n)) % 2
        cells = [f"c_{min(a, b)}_{max(a, b)}" for a, b in ((names[i], names[j]) for i, j in enumerate(order)) if a != b]
        terms.append(("-" if odd else "+") + (" * ".join(cells) or "1"))
    return " ".join(terms)


_CELLS_SQL = ", ".join(
    f"corr({a}, {c}) AS c_{min(a, c)}_{max(a, c)}" for i, a in enumerate(_NUMERIC) for c in _NUMERIC[i + 1 :]
)
# A diagonal cell of the inverse is the determinant without its row and column over the whole one.
_VIF_SQL = f"WITH c AS (SELECT {_CELLS_SQL} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, round(({_determinant_sql([n for n in _NUMERIC if n != name])})"
    f" / ({_determinant_sql(_NUMERIC)}), 6) AS vif FROM c"
    for name in _NUMERIC
)


@query("m25_variance_inflation", _VIF_SQL)
def variance_inflation(spark, sf):
    return pf.variance_inflation(src.table(spark, sf, "lineitem"), _NUMERIC).withColumn(
        "vif", F.round("vif", 6)
    )


_SCREENED = ("quantity", "price", "gross", "often_null", "nearly_same")
_SCREEN_FROM = """SELECT l_quantity AS quantity, l_extendedprice AS price, l_extendedprice * (1 + l_tax) AS gross,
  CASE WHEN l_quantity > 30 THEN l_discount END AS often_null,
  CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS nearly_same,
  CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END AS target FROM lineitem"""


@query(
    "m25_screening",
    f"WITH f AS ({_SCREEN_FROM}), s AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, 1 - count({c}) / count(*) AS null_rate, abs(corr({c}, target)) AS relevance,"
        f" (SELECT max(n) FROM (SELECT count(*) AS n FROM f WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) AS top_share"
        " FROM f"
        for c in _SCREENED
    )
    + """), p AS (SELECT corr(price, gross) AS c FROM f)
SELECT feature, round(null_rate, 6) AS null_rate, round(top_share, 6) AS top_share, round(relevance, 6) AS relevance,
  CASE WHEN null_rate > 0.5 THEN 'nulls' WHEN top_share > 0.95 THEN 'near constant'
    WHEN feature IN ('price', 'gross') AND abs(c) > 0.95
      AND relevance < (SELECT max(relevance) FROM s WHERE feature IN ('price', 'gross')) THEN 'correlated' END AS reason
FROM s, p""",
)
def screened_features(spark, sf):
    price = F.col("l_extendedprice")
    rows = src.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        price.alias("price"),
        (price * (1 + F.col("l_tax"))).alias("gross"),
        F.when(F.col("l_quantity") > 30, F.col("l_discount")).alias("often_null"),
        F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0).alias("nearly_same"),
        F.when(price > 30000, 1).otherwise(0).alias("target"),
    )
    found = pf.screening(rows, _SCREENED, "target")
    return found.withColumns({c: F.round(c, 6) for c in ("null_rate", "top_share", "relevance")})


@query(
    "m25_mutual_information",
    """WITH d AS (SELECT lang, source, quality FROM documents JOIN labels USING (doc_id)),
l AS (SELECT 'lang' AS feature, lang AS x, quality AS y FROM d
  UNION ALL SELECT 'source', source, quality FROM d),
j AS (SELECT feature, x, y, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, x) AS nx,
  sum(n) OVER (PARTITION BY feature, y) AS ny FROM j)
SELECT feature, round(sum(n / nn * ln(CAST(n AS DOUBLE) * nn / (nx * ny))), 6) AS mutual_information
FROM t GROUP BY 1""",
)
def mutual_information(spark, sf):
    rows = src.table(spark, sf, "documents").select("doc_id", "lang", "source").join(
        src.table(spark, sf, "labels"), "doc_id"
    )
    return pf.mutual_information(rows, ["lang", "source"], "quality").withColumn(
        "mutual_information", F.round("mutual_information", 6)
    )
