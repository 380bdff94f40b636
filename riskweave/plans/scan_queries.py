"""Scans, date windows, sources and sinks."""

from __future__ import annotations

import os
import uuid
import zlib
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from riskweave.functions import vectors
from riskweave.operators import scoring
from riskweave.plans import binding as b
from riskweave.plans.registry import query
from riskweave.session import shared_folder
from riskweave.sources import tables as src


def _folder(spark, name: str) -> str:
    return os.path.join(shared_folder(spark), "files", f"{name}-{uuid.uuid4().hex}")


_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "s01_table_scans",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _ALL
    ),
)
def table_scans(spark, sf):
    counts = [
        src.table(spark, sf, t).agg(F.count("*").alias("n_rows")).select(
            F.lit(t).alias("table_name"), "n_rows"
        )
        for t in _ALL
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


_SCANNED = ("orders", "lineitem", "customer")


def _registered(spark, sf):
    """The schema that holds the tables of ``sf``; its name follows from the folder."""
    schema = f"riskweave_{zlib.crc32(sf.encode()):08x}"
    src.register_tables(spark, schema, sf, _SCANNED)
    return schema


@query(
    "s01_catalog_scans",
    """SELECT strftime(o_orderdate, '%Y%m') AS month, c_mktsegment AS segment, count(*) AS n,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_quantity > 10 GROUP BY 1, 2""",
)
def catalog_scans(spark, sf):
    """Three tables read by their three-part names, joined and totalled."""
    schema = _registered(spark, sf)
    line, order, customer = (
        src.catalog_table(spark, src.SESSION_CATALOG, schema, t) for t in ("lineitem", "orders", "customer")
    )
    return (
        line.where(F.col("l_quantity") > 10)
        .join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month"), F.col("c_mktsegment").alias("segment"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
        )
    )


def _order_totals(rows):
    return rows.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"),
    )


_ORDER_TOTALS_SQL = """SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders
WHERE {} GROUP BY 1"""


@query(
    "s02_whole_months",
    _ORDER_TOTALS_SQL.format(
        "o_orderdate > last_day(DATE '2001-08-01' - INTERVAL 7 MONTH)"
        " AND o_orderdate <= last_day(DATE '2001-08-01' - INTERVAL 1 MONTH)"
    ),
)
def whole_months(spark, sf):
    return _order_totals(
        src.table(spark, sf, "orders").where(src.whole_months("o_orderdate", b.AS_OF))
    )


@query(
    "s03_month_window",
    _ORDER_TOTALS_SQL.format(
        "o_orderdate >= date_trunc('month', DATE '2001-08-01' - INTERVAL 6 MONTH)"
        " AND o_orderdate < date_trunc('month', DATE '2001-08-01')"
    ),
)
def month_window(spark, sf):
    return _order_totals(
        src.table(spark, sf, "orders").where(src.month_window("o_orderdate", b.AS_OF))
    )


@query(
    "s04_rolling_year",
    """SELECT event_type, count(*) AS n FROM events
WHERE ts >= DATE '2024-01-31' - INTERVAL 365 DAY AND ts < DATE '2024-02-01' GROUP BY 1""",
)
def rolling_year(spark, sf):
    rows = src.table(spark, sf, "events").where(src.rolling_days("ts", b.EVENTS_AS_OF))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "s05_latest_snapshot",
    """WITH early AS (SELECT * FROM events WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-01-06')
SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM early WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM early) GROUP BY 1""",
)
def latest_snapshot(spark, sf):
    rows = src.latest_snapshot(src.table(spark, sf, "events"), "ts", b.EVENTS_AS_OF)
    return rows.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("amount"),
    )


@query(
    "s06_month_to_date",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events
WHERE year(ts) = 2024 AND month(ts) = 1 AND day(ts) <= 20 GROUP BY 1""",
)
def month_to_date(spark, sf):
    rows = src.table(spark, sf, "events").where(
        src.month_to_date("ts", b.EVENTS_AS_OF.replace(day=20))
    )
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n")
    )


@query(
    "s07_look_back",
    _ORDER_TOTALS_SQL.format(
        "o_orderdate IS NOT NULL AND o_orderdate >= DATE '2001-08-01' - INTERVAL 24 MONTH"
        " AND CAST(o_orderdate AS DATE) <= DATE '2001-08-01'"
    ),
)
def look_back(spark, sf):
    return _order_totals(
        src.table(spark, sf, "orders").where(
            src.look_back("o_orderdate", "o_orderdate", b.AS_OF)
        )
    )


# ------------------------------------------------------------------------------- files


@query(
    "s08_semicolon_csv",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_acctbal >= 0 AND c_name IS NOT NULL AND c_mktsegment IS NOT NULL""",
)
def semicolon_csv(spark, sf):
    """Customers with a negative balance are written without a name, so the read drops them."""
    path = _folder(spark, "semicolon")
    src.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("c_name"),
        "c_mktsegment",
    ).write.csv(path, sep=";", header=True)
    schema = StructType(
        [
            StructField("c_custkey", LongType()),
            StructField("c_name", StringType()),
            StructField("c_mktsegment", StringType()),
        ]
    )
    return src.semicolon_csv(spark, path, schema)


@query(
    "s09_bom_csv",
    "SELECT p_partkey AS question_id, p_name AS question, p_size AS response_model FROM part",
)
def bom_csv(spark, sf):
    path = _folder(spark, "bom")
    src.table(spark, sf, "part").select(
        F.col("p_partkey").alias("\ufeffquestion_id"),
        F.col("p_name").alias("question"),
        F.col("p_size").alias("response_model"),
    ).write.csv(path, header=True)
    schema = StructType(
        [
            StructField("question_id", LongType()),
            StructField("question", StringType()),
            StructField("response_model", IntegerType()),
        ]
    )
    return src.bom_csv(spark, path, schema)


@query(
    "s10_batch_csv_scoring",
    """SELECT c_custkey, round(1 / (1 + exp(-(0.0001 * c_acctbal - 0.05 * c_nationkey))), 6)
  AS probability FROM customer""",
)
def batch_csv_scoring(spark, sf):
    features, scored = _folder(spark, "features"), _folder(spark, "scored")
    src.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey").write.csv(
        features, header=True
    )
    schema = StructType(
        [
            StructField("c_custkey", LongType()),
            StructField("c_acctbal", DoubleType()),
            StructField("c_nationkey", IntegerType()),
        ]
    )

    def score(rows):
        z = 0.0001 * F.col("c_acctbal") - 0.05 * F.col("c_nationkey")
        return rows.select("c_custkey", F.round(scoring.sigmoid(z), 6).alias("probability"))

    return src.score_csv(spark, features, scored, schema, score)


def _exported(spark, sf, file_format):
    path = _folder(spark, f"export-{file_format}")
    events = src.table(spark, sf, "events")
    src.export_by_period(events, path, "ts", file_format)
    schema = StructType([*events.schema.fields, StructField("day", StringType())])
    back = spark.read.schema(schema).format(file_format).load(path)
    return back.groupBy("day", "event_type").agg(
        F.count("*").alias("n"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"),
    )


_EXPORT_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2"""


@query("s11_export_parquet", _EXPORT_SQL)
def export_parquet(spark, sf):
    return _exported(spark, sf, "parquet")


@query("s11_export_json", _EXPORT_SQL)
def export_json(spark, sf):
    return _exported(spark, sf, "json")


def _weekly(spark, sf, folder):
    """The events exported by week: the schema to read them back with."""
    events = src.table(spark, sf, "events")
    src.export_by_period(events, folder, "ts", period="week")
    return StructType([*events.schema.fields, StructField("week", StringType())])


_WEEK_SQL = """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events {} GROUP BY 1"""


def _week_totals(rows):
    return rows.groupBy("week").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")
    )


@query("s11_export_weekly", _WEEK_SQL.format(""))
def export_weekly(spark, sf):
    path = _folder(spark, "export-weekly")
    schema = _weekly(spark, sf, path)
    return _week_totals(spark.read.schema(schema).parquet(path))


@query(
    "s12_embedding_store",
    """SELECT vec_id, label, len(embedding) AS width,
  round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm
FROM embeddings""",
)
def embedding_store(spark, sf):
    return src.table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        F.size("embedding").cast("long").alias("width"),
        F.round(vectors.l2_norm("embedding"), 6).alias("norm"),
    )


@query(
    "s13_retention",
    _ORDER_TOTALS_SQL.format("o_orderdate >= DATE '2001-08-01' - INTERVAL 6 MONTH"),
)
def retention(spark, sf):
    return _order_totals(src.retained(src.table(spark, sf, "orders"), "o_orderdate", b.AS_OF))


@query(
    "s13_purged_export", _WEEK_SQL.format("WHERE date_trunc('week', ts) >= date_trunc('week', DATE '2024-07-16' - INTERVAL 6 MONTH)")
)
def purged_export(spark, sf):
    """What is left of a weekly export when the folders behind the retention are deleted."""
    path = _folder(spark, "export-purged")
    schema = _weekly(spark, sf, path)
    src.purge_periods(spark, path, date(2024, 7, 16), period="week")
    return _week_totals(spark.read.schema(schema).parquet(path))


@query(
    "s14_masked_checkpoint",
    "SELECT sha256(CAST(c_custkey AS VARCHAR)) AS c_custkey, c_mktsegment, c_acctbal FROM customer",
)
def masked_checkpoint(spark, sf):
    """The opt-in dump of a step: its key column is hashed."""
    path = _folder(spark, "masked")
    rows = src.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    src.masked_checkpoint(rows, path, ["c_custkey"], enabled=True)
    return spark.read.parquet(path)
