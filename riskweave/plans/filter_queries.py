"""Projections, scope filters and text guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions import scalars as sc
from riskweave.functions import text as tx
from riskweave.operators import scope
from riskweave.plans import binding as b
from riskweave.plans.registry import query
from riskweave.sources import tables as src


@query(
    "p01_pruned_projection",
    """SELECT l_orderkey AS account_id, l_suppkey AS customer_id, l_extendedprice AS amount,
  l_returnflag AS movement_direction, strftime(l_shipdate, '%Y%m') AS month_year FROM lineitem""",
)
def pruned_projection(spark, sf):
    return src.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("account_id"),
        F.col("l_suppkey").alias("customer_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("movement_direction"),
        sc.year_month("l_shipdate").alias("month_year"),
    )


@query(
    "p06_market_scope",
    """SELECT c_custkey, c_name FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_custkey IS NOT NULL
  AND c_name IS NOT NULL""",
)
def market_scope(spark, sf):
    return (
        src.table(spark, sf, "customer")
        .where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") >= 0))
        .dropna(subset=["c_custkey", "c_name"])
        .select("c_custkey", "c_name")
    )


@query(
    "p07_id_prefix",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE substr(c_mktsegment, 1, 2) = 'BU'",
)
def id_prefix(spark, sf):
    return (
        src.table(spark, sf, "customer")
        .where(F.col("c_mktsegment").startswith("BU"))
        .select("c_custkey", "c_mktsegment")
    )


# Stand-in codes of the eligibility columns.
_FORMS = ("26", "27", "33", "30", "20", "21", "29", "55", "59", "64", "22", "25", "31", "32",
          "99", None, "", "XX")
_ACTIVITIES = ("6419Z", "8411Z", "4711A", "6201Z")
_SEGMENTS = {"BUILDING": "ME", "AUTOMOBILE": "GR", "MACHINERY": "A3", "HOUSEHOLD": "AP",
             "FURNITURE": "PE"}
_REAL_ESTATE = ("1", "0", None, "")
_CLAIMS = ("0", "1", "2", None, "3")
_NATURES = ("00001", "00003", None)


def _element(values, index):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def _sql_element(values, index):
    shown = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"list_extract([{shown}], 1 + {index})"


def eligibility_rows(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    segment = F.create_map(*[F.lit(x) for pair in _SEGMENTS.items() for x in pair])
    return src.table(spark, sf, "customer").select(
        key.alias("enterprise_id"),
        _element(_FORMS, key % len(_FORMS)).alias("legal_form"),
        _element(_ACTIVITIES, nation % len(_ACTIVITIES)).alias("activity"),
        segment[F.col("c_mktsegment")].alias("segment"),
        _element(_REAL_ESTATE, F.floor(key / 3) % len(_REAL_ESTATE)).alias("real_estate"),
        F.when(F.col("c_acctbal") > 0, "1").otherwise("0").alias("has_account"),
        _element(_CLAIMS, F.floor(key / 7) % len(_CLAIMS)).alias("risk_claim"),
        F.lpad((key % 500).cast("string"), 3, "0").alias("economic_code"),
        _element(_NATURES, nation % len(_NATURES)).alias("client_nature"),
    )


_SEGMENT_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENTS.items())
ELIGIBILITY_SQL = f"""candidate AS (
  SELECT c_custkey AS enterprise_id,
    {_sql_element(_FORMS, f'c_custkey % {len(_FORMS)}')} AS legal_form,
    {_sql_element(_ACTIVITIES, f'c_nationkey % {len(_ACTIVITIES)}')} AS activity,
    CASE c_mktsegment {_SEGMENT_CASES} END AS segment,
    {_sql_element(_REAL_ESTATE, f'(c_custkey // 3) % {len(_REAL_ESTATE)}')} AS real_estate,
    CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS has_account,
    {_sql_element(_CLAIMS, f'(c_custkey // 7) % {len(_CLAIMS)}')} AS risk_claim,
    lpad(CAST(c_custkey % 500 AS VARCHAR), 3, '0') AS economic_code,
    {_sql_element(_NATURES, f'c_nationkey % {len(_NATURES)}')} AS client_nature
  FROM customer
)"""
_ECO = ", ".join(f"'{c}'" for c in rules.EXCLUDED_ECONOMIC_CODES)
_CHECKS_SQL = (
    ("legal_form", "legal_form NOT IN ('31','32','34','35','93','95','99')"),
    ("activity", "activity <> '6419Z'"),
    ("public_activity", "NOT (segment = 'AP' AND activity = '8411Z')"),
    ("segment", "segment IN ('ME', 'GR', 'A3')"),
    ("real_estate", "coalesce(real_estate, '') <> '1'"),
    ("has_account", "has_account = '1'"),
    ("risk_claim", "risk_claim NOT IN ('1', '2')"),
    ("economic_code", f"economic_code NOT IN ({_ECO})"),
    ("client_nature", "client_nature <> '00003'"),
)


def _single_rule(position: int):
    name, sql = _CHECKS_SQL[position]

    def run(spark, sf):
        _, test = scope.eligibility_rules()[position]
        return eligibility_rows(spark, sf).where(test)

    return run, f"WITH {ELIGIBILITY_SQL} SELECT * FROM candidate WHERE {sql}"


for _id, _position in (
    ("p10_legal_form", 0),
    ("p11_activity", 1),
    ("p11_public_activity", 2),
    ("p12_segment", 3),
    ("p13_real_estate", 4),
    ("p14_has_account", 5),
    ("p15_risk_claim", 6),
    ("p16_economic_code", 7),
    ("p17_client_nature", 8),
):
    _run, _sql = _single_rule(_position)
    query(_id, _sql)(_run)


@query(
    "p13_real_estate_strict",
    f"WITH {ELIGIBILITY_SQL} SELECT * FROM candidate WHERE real_estate IS NULL",
)
def real_estate_strict(spark, sf):
    _, test = scope.eligibility_rules(strict_real_estate=True)[4]
    return eligibility_rows(spark, sf).where(test)


@query(
    "p10_p17_eligible",
    f"WITH {ELIGIBILITY_SQL} SELECT * FROM candidate WHERE "
    + " AND ".join(sql for _, sql in _CHECKS_SQL),
)
def eligible(spark, sf):
    return scope.eligible(eligibility_rows(spark, sf))


def _report_sql() -> str:
    parts, so_far = [], "TRUE"
    for i, (name, sql) in enumerate(_CHECKS_SQL, 1):
        now = f"{so_far} AND {sql}"
        parts.append(
            f"SELECT {i} AS step, '{name}' AS rule, "
            f"(SELECT count(*) FROM candidate WHERE {so_far}) AS rows_in, "
            f"(SELECT count(*) FROM candidate WHERE {now}) AS rows_out"
        )
        so_far = now
    return (
        f"WITH {ELIGIBILITY_SQL}, report AS ({' UNION ALL '.join(parts)}) SELECT *, "
        "coalesce(round(100.0 * (rows_in - rows_out) / nullif(rows_in, 0), 2), 0.0) "
        "AS pct_removed FROM report"
    )


@query("p18_filter_report", _report_sql())
def filter_report(spark, sf):
    return scope.filter_report(eligibility_rows(spark, sf))


_RANGE_SQL = "l_linenumber * 2 - 3"


def _days(spark, sf):
    return src.table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 2 - 3).alias("days")
    )


@query(
    "p19_range_report",
    f"""SELECT count(*) AS rows_in, count(*) FILTER (WHERE {_RANGE_SQL} NOT BETWEEN 0 AND 10)
  AS rows_rejected, max({_RANGE_SQL}) FILTER (WHERE {_RANGE_SQL} BETWEEN 0 AND 10) AS max_kept
FROM lineitem""",
)
def range_report(spark, sf):
    return scope.range_report(_days(spark, sf), "days", 0, 10)


@query(
    "p19_range_drop",
    f"""SELECT l_orderkey, max({_RANGE_SQL}) AS days, count(*) AS n FROM lineitem
WHERE {_RANGE_SQL} BETWEEN 0 AND 10 GROUP BY l_orderkey""",
)
def range_drop(spark, sf):
    kept = scope.guard_range(_days(spark, sf), "days", 0, 10, "drop")
    return kept.groupBy("l_orderkey").agg(F.max("days").alias("days"), F.count("*").alias("n"))


@query(
    "p19_range_clip",
    f"""SELECT least(greatest({_RANGE_SQL}, 0), 10) AS days,
  CAST(sum(CASE WHEN {_RANGE_SQL} NOT BETWEEN 0 AND 10 THEN 1 ELSE 0 END) AS BIGINT) AS clipped,
  count(*) AS n FROM lineitem GROUP BY 1""",
)
def range_clip(spark, sf):
    clipped = scope.guard_range(_days(spark, sf), "days", 0, 10, "clip")
    return clipped.groupBy("days").agg(
        F.count_if("out_of_range").alias("clipped"), F.count("*").alias("n")
    )


# -------------------------------------------------------------------------- text guards

# DuckDB reads a NUL or other control character inside a class as its escape.
_CONTROL_SQL = r"regexp_replace(text, '[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]', '', 'g')"


@query(
    "p20_f15_text_guard",
    f"""WITH c AS (SELECT doc_id, text, trim({_CONTROL_SQL}, ' ') AS clean FROM documents)
SELECT doc_id, md5(clean) AS clean_hash, length(clean) AS clean_length,
  CASE WHEN text IS NULL OR clean = '' THEN 'empty'
       WHEN length(clean) > 10000 THEN 'too_long' END AS refusal FROM c""",
)
def text_guard(spark, sf):
    guarded = tx.guarded_text("text")
    return (
        src.table(spark, sf, "documents")
        .select("doc_id", *[c.alias(n) for n, c in guarded.items()])
        .select(
            "doc_id",
            F.md5("clean_text").alias("clean_hash"),
            F.length("clean_text").cast("long").alias("clean_length"),
            "refusal",
        )
    )


def _injection_sql(key: str, text: str, table: str) -> str:
    cases = [f"WHEN {text} IS NULL OR {text} = '' THEN 'empty'"]
    for kind, patterns in (
        ("sql", rules.SQL_INJECTION_PATTERNS),
        ("script", rules.SCRIPT_INJECTION_PATTERNS),
    ):
        cases += [
            f"WHEN regexp_matches({text}, '(?i){p}') THEN '{kind}_{i}'"
            for i, p in enumerate(patterns, 1)
        ]
    ratio = (
        rf"length(regexp_replace({text}, '[\p{{L}}\p{{N}}\s]', '', 'g')) "
        f"/ CAST(length({text}) AS DOUBLE)"
    )
    cases.append(f"WHEN {ratio} > 0.5 THEN 'special_characters'")
    return (
        f"SELECT {key}, CASE {' '.join(cases)} END AS reason, round({ratio}, 6) AS special_ratio "
        f"FROM {table}"
    )


def _injection(spark, sf, name, key, text):
    return src.table(spark, sf, name).select(
        key,
        tx.injection_reason(text).alias("reason"),
        F.round(tx.special_character_ratio(text), 6).alias("special_ratio"),
    )


@query("p21_f21_injection_documents", _injection_sql("doc_id", "text", "documents"))
def injection_documents(spark, sf):
    return _injection(spark, sf, "documents", "doc_id", "text")


@query("p21_injection_pages", _injection_sql("page_id", "html", "pages"))
def injection_pages(spark, sf):
    return _injection(spark, sf, "pages", "page_id", "html")


@query(
    "p22_redacted_payload",
    """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') ||
  '","api_key":"[REDACTED]","user_token":"[REDACTED]","kind":"' || event_type || '"}' AS payload
FROM events""",
)
def redacted_payload(spark, sf):
    payload = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(
            F.lit("api_key"), F.col("user_id").cast("string"),
            F.lit("user_token"), F.md5(F.col("user_id").cast("string")),
            F.lit("kind"), F.col("event_type"),
        ),
    )
    return src.table(spark, sf, "events").select(
        "event_id", F.to_json(sc.redact_keys(payload)).alias("payload")
    )


@query(
    "p22_redacted_nested",
    """SELECT event_id, '{"outer":{"k":' || json_extract_string(props, '$.k') ||
  ',"Password":"[REDACTED]"},"secret_id":"[REDACTED]","list":[{"token":"[REDACTED]"}]}' AS payload
FROM events""",
)
def redacted_nested(spark, sf):
    user = F.col("user_id")
    nested = F.to_json(
        F.struct(
            F.struct(
                F.get_json_object("props", "$.k").cast("int").alias("k"),
                F.concat(F.lit("p,\""), user).alias("Password"),
            ).alias("outer"),
            user.alias("secret_id"),
            F.array(F.struct(user.cast("string").alias("token"))).alias("list"),
        )
    )
    return src.table(spark, sf, "events").select(
        "event_id", tx.redacted_json(nested).alias("payload")
    )


# -------------------------------------------------------------------- scalar functions


@query(
    "f01_f02_f03_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS month_long,
  strftime(o_orderdate, '%Y%m') AS month_short,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
  strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
  strftime(last_day(CAST(o_orderdate AS DATE) - INTERVAL 7 MONTH), '%Y-%m-%d') AS window_start
FROM orders""",
)
def dates(spark, sf):
    day = F.col("o_orderdate")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return src.table(spark, sf, "orders").select(
        "o_orderkey",
        sc.year_month_from_parts(day).alias("month_long"),
        sc.year_month(day).alias("month_short"),
        iso(F.trunc(day, "month")).alias("month_start"),
        iso(F.last_day(day)).alias("month_end"),
        iso(F.last_day(F.add_months(day, -7))).alias("window_start"),
    )


@query(
    "f05_f06_safe_casts",
    """SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS name_number,
  TRY_CAST(replace(replace(CAST(p_retailprice AS VARCHAR), '.', ','), ',', '.') AS DOUBLE)
    AS comma_number,
  CASE WHEN p_size < 10 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS flawed_number FROM part""",
)
def safe_casts(spark, sf):
    return (
        src.table(spark, sf, "part")
        .withColumn("comma", F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))
        .withColumn("flawed", F.when(F.col("p_size") < 10, "#REF!").otherwise(F.col("p_size").cast("string")))
        .select(
            "p_partkey",
            sc.number_or_null("p_name").alias("name_number"),
            sc.decimal_comma_number("comma").alias("comma_number"),
            sc.decimal_comma_number("flawed").alias("flawed_number"),
        )
    )


@query(
    "f07_f08_f09_f10_f11_f12_numbers",
    """SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) / 100.0 AS units,
  round(1 / (1 + exp(-c_acctbal / 1000)), 9) AS probability,
  CASE WHEN 1 / (1 + exp(c_acctbal / 1000)) < 0.0001 THEN 0.0001
       ELSE round(1 / (1 + exp(c_acctbal / 1000)), 4) END AS floored,
  coalesce(c_acctbal / nullif(c_nationkey, 0), 0.0) AS safe_ratio,
  c_acctbal / nullif(c_nationkey, 0) AS open_ratio,
  least(greatest(c_acctbal, 0.0), 5000.0) AS clipped,
  round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 9) AS signed_log FROM customer""",
)
def numbers(spark, sf):
    balance = F.col("c_acctbal")
    return src.table(spark, sf, "customer").select(
        "c_custkey",
        sc.cents_to_units(F.round(balance * 100).cast("long")).alias("units"),
        F.round(sc.sigmoid(balance / 1000), 9).alias("probability"),
        sc.floored(sc.sigmoid(-balance / 1000)).alias("floored"),
        sc.ratio_or_zero(balance, "c_nationkey").alias("safe_ratio"),
        sc.ratio(balance, "c_nationkey").alias("open_ratio"),
        sc.clip(balance, 0.0, 5000.0).alias("clipped"),
        F.round(sc.signed_log(balance), 9).alias("signed_log"),
    )


@query(
    "f13_strings",
    """SELECT c_custkey, substr(c_name, 1, 8) AS head, lower(trim('  ' || c_name || ' ')) AS lowered,
  length(c_name) AS n, CAST(starts_with(c_name, 'Customer') AS INT) AS known FROM customer""",
)
def strings(spark, sf):
    name = F.col("c_name")
    return src.table(spark, sf, "customer").select(
        "c_custkey",
        F.substring(name, 1, 8).alias("head"),
        F.lower(F.trim(F.concat(F.lit("  "), name, F.lit(" ")))).alias("lowered"),
        F.length(name).cast("long").alias("n"),
        name.startswith("Customer").cast("int").alias("known"),
    )


@query(
    "f14_clean_addresses",
    # RE2 knows ASCII word borders only, so the border is spelled out; a code next to another
    # one shares its border and needs the second pass.
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url || ' ' || html,
  'https?://\S+|www\.\S+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t,
  '(^|[^\p{L}\p{N}_])[0-9A-Z]{6,}($|[^\p{L}\p{N}_])', '\1 \2', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t,
  '(^|[^\p{L}\p{N}_])[0-9A-Z]{6,}($|[^\p{L}\p{N}_])', '\1 \2', 'g') AS t FROM b)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS clean FROM c""",
)
def clean_addresses(spark, sf):
    joined = F.concat_ws(" ", "url", "html")
    return src.table(spark, sf, "pages").select(
        "page_id", tx.without_addresses_and_codes(joined).alias("clean")
    )


@query(
    "f16_unicode_nfc",
    "SELECT doc_id, md5(nfc_normalize(text)) AS composed, length(nfc_normalize(text)) AS n FROM documents",
)
def unicode_nfc(spark, sf):
    composed = tx.nfc("text")
    return src.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(composed).alias("composed"),
        F.length(composed).cast("long").alias("n"),
    )


@query(
    "f17_similarity",
    """WITH a AS (SELECT p_partkey, p_name, p_type FROM part)
SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type))
  / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 6) AS similarity FROM a""",
)
def similarity(spark, sf):
    return src.table(spark, sf, "part").select(
        "p_partkey", F.round(tx.normalised_similarity("p_name", "p_type"), 6).alias("similarity")
    )


@query(
    "f18_acronyms",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '\p{Lu}{2,6}') GROUP BY word""",
)
def acronyms(spark, sf):
    words = src.table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    return words.where(tx.is_acronym("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    "f20_vector_functions",
    """WITH c AS (SELECT list(m ORDER BY i) AS centre FROM (
  SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT unnest(embedding) AS x,
    unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i)),
s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre) AS cos
  FROM embeddings, c)
SELECT vec_id, round(cos, 6) AS cosine, round((cos + 1) / 2, 6) AS scaled,
  round(greatest(0.0, least(1.0, cos)), 6) AS clamped FROM s""",
)
def vector_functions(spark, sf):
    from riskweave.functions import vectors
    from riskweave.operators.drift import centroid

    rows = src.table(spark, sf, "embeddings")
    centre = centroid(rows, "embedding").select("centroid").scalar()
    scored = rows.withColumn("centre", centre).select(
        "vec_id", vectors.cosine("embedding", "centre").alias("c")
    )
    return scored.select(
        "vec_id",
        F.round("c", 6).alias("cosine"),
        F.round(vectors.scaled_score("c"), 6).alias("scaled"),
        F.round(vectors.clamped_score("c"), 6).alias("clamped"),
    )


@query(
    "f22_base64",
    "SELECT p_partkey, decode(from_base64(to_base64(encode(p_name)))) AS decoded FROM part",
)
def base64_text(spark, sf):
    encoded = F.base64(F.encode("p_name", "UTF-8"))
    return src.table(spark, sf, "part").select(
        "p_partkey", F.decode(F.unbase64(encoded), "UTF-8").alias("decoded")
    )


@query(
    "f23_f24_f25_collections",
    """WITH q AS (SELECT l_orderkey, count(*) AS n,
  count(*) FILTER (WHERE l_quantity > 25) AS big, max(l_quantity) AS top,
  sum(l_quantity) AS total, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
  FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(big / CAST(n AS DOUBLE), 6) AS share_big,
  round(top / total, 6) AS top_share,
  concat_ws(',', CASE WHEN top > 40 THEN 'large' END, CASE WHEN returned = 1 THEN 'returned' END,
    CASE WHEN n > 5 THEN 'long' END) AS tags FROM q""",
)
def collections(spark, sf):
    """Flags and quantities of one order as arrays and maps; an order has few lines."""
    lines = (
        src.table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.collect_list(F.col("l_quantity") > 25).alias("flags"),
            F.max("l_quantity").alias("top"),
            F.sum("l_quantity").alias("total"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"),
        )
    )
    shares = F.create_map(F.lit("top"), F.col("top") / F.col("total"), F.lit("none"), F.lit(0.0))
    found = sc.tags(
        (F.col("top") > 40, "large"),
        (F.col("returned") == 1, "returned"),
        (F.size("flags") > 5, "long"),
    )
    return lines.select(
        "l_orderkey",
        F.round(sc.share_true("flags"), 6).alias("share_big"),
        F.round(sc.largest_value(shares), 6).alias("top_share"),
        F.array_join(found, ",").alias("tags"),
    )


@query(
    "f26_json_get",
    """SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n
FROM events GROUP BY 1""",
)
def json_get(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return src.table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query(
    "f27_subject_and_body",
    """SELECT p_partkey, concat_ws(' ', CASE WHEN p_size < 10 THEN NULL ELSE p_name END,
  CASE WHEN p_size > 40 THEN NULL ELSE p_type END) AS content FROM part""",
)
def subject_and_body(spark, sf):
    subject = F.when(F.col("p_size") < 10, "  ").otherwise(F.col("p_name"))
    body = F.when(F.col("p_size") > 40, "").otherwise(F.col("p_type"))
    return src.table(spark, sf, "part").select(
        "p_partkey", sc.subject_and_body(subject, body).alias("content")
    )


@query(
    "f28_version_hash",
    """SELECT c_mktsegment, sha256(string_agg(CAST(c_nationkey AS VARCHAR), ',' ORDER BY c_nationkey))
  AS list_hash FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) GROUP BY 1""",
)
def version_hash(spark, sf):
    """Hash of a term list; the distinct terms per list are a closed vocabulary."""
    terms = src.table(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()
    ordered = F.transform(F.sort_array(F.collect_list("c_nationkey")), lambda n: n.cast("string"))
    return terms.groupBy("c_mktsegment").agg(
        F.sha2(F.concat_ws(",", ordered), 256).alias("list_hash")
    )
