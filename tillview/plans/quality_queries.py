"""Quality and cleaning over a defective version of the benchmark tables."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillview.functions.columns import rounded
from tillview.operators import cleaning, quality
from tillview.plans.analytics_queries import FLAT
from tillview.plans.edge import plain
from tillview.session import kept_for_inputs, passes, spread, stage, tune, unstage
from tillview.sources.flat import COLUMNS, dirty
from tillview.sources.transactions import table

MAPPING = {
    "transaction_id": "order_id",
    "purchase_date": "order_date",
    "customer_id": "customer_id",
    "product_id": "product_id",
    "product_name": "product_name",
    "category": "category",
    "price": "unit_price",
    "quantity": "quantity",
    "discount": "discount_pct",
    "revenue": "total_amount",
    "payment_method": "payment_method",
    "city": "city",
    "state": "region",
}
AS_OF = dt.date(2000, 6, 30)
NUMBERS = ["unit_price", "quantity", "discount_pct", "total_amount", "customer_rating"]


@kept_for_inputs
def _raw(sf_dir: str):
    """Version 1, written once and read by every query on it."""
    spark = tune(SparkSession.active())
    items = table(spark, sf_dir, "lineitem")
    return stage(*[spread(dirty(spark, sf_dir, part), items) for part in passes(items, "l_orderkey")])


def raw(spark, sf_dir):
    return _raw(spark, sf_dir)


@kept_for_inputs
def _clean(sf_dir: str):
    out = cleaning.clean(_raw(SparkSession.active(), sf_dir))
    made, out.rows = out.rows, stage(out.rows)
    unstage(made)
    return out


def cleaned(spark, sf_dir):
    return _clean(spark, sf_dir)


def _q(build):
    return lambda spark, sf_dir: plain(build(raw(spark, sf_dir)))


_SCORE = dict(date_text=["order_date"], numeric=["unit_price", "quantity", "discount_pct", "total_amount"], categorical=["category"])


def quality_queries():
    return {
        "dq_profile": _q(quality.basic_profile),
        "dq_issues": _q(quality.basic_issues),
        "dq_duplicate_rows": _q(quality.duplicate_rows),
        "dq_near_duplicates": _q(lambda df: quality.near_duplicates(df, ["order_id", "customer_id", "product_id"])),
        "dq_duplicate_identifiers": _q(lambda df: quality.duplicate_identifiers(df, MAPPING)),
        "dq_repeated_order_ids": _q(lambda df: quality.duplicate_identifiers(df, MAPPING, "ORDER_LEVEL")),
        "dq_rows_in_conflict": _q(
            lambda df: quality.rows_in_conflict(df.select("order_id", "payment_method", "customer_id", "order_date"), MAPPING)
        ),
        "dq_consistency_parts": _q(lambda df: quality.consistency_parts(df, MAPPING, **_SCORE)),
        "dq_category_variants": _q(lambda df: quality.category_variants(df, ["category", "payment_method"])),
        "dq_validity_rules": _q(lambda df: quality.validity_rules(df, MAPPING, AS_OF, "RATIO")),
        "dq_weighted_score": _q(lambda df: quality.weighted_score(df, MAPPING, AS_OF, "RATIO", **_SCORE)),
        "dq_accuracy_indicators": _q(lambda df: quality.accuracy_indicators(df, MAPPING, AS_OF)),
        "dq_missingness": _q(quality.missingness),
        "dq_co_missing": _q(quality.co_missing),
        "dq_missing_masks": _q(quality.missing_masks),
        "dq_outlier_report": _q(
            lambda df: quality.outlier_report(df, NUMBERS, MAPPING).withColumns(
                {c: rounded(c, 4) for c in ("lower", "upper")}
            )
        ),
        "dq_extreme_rows": _q(
            lambda df: quality.extreme_rows(
                df.select("order_id", "product_id", "quantity", "unit_price"),
                "quantity",
                ["order_id", "product_id", "quantity", "unit_price"],
            )
        ),
        "clean_rows": lambda spark, d: plain(cleaned(spark, d).rows),
        "clean_log": lambda spark, d: plain(cleaned(spark, d).log.select("step", "operation", "column", "rows_modified")),
        "clean_fingerprint": lambda spark, d: plain(cleaning.fingerprint(cleaned(spark, d).rows)),
        "clean_compare_versions": lambda spark, d: plain(
            cleaning.compare_versions(raw(spark, d), cleaned(spark, d).rows)
        ),
        "clean_normalize_categories": _q(
            lambda df: cleaning.apply_steps(df, [cleaning.Step("NORMALIZE_CATEGORIES", ["category"])])[0]
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("rows"))
        ),
        "clean_steps_log": _q(
            lambda df: cleaning.preview_steps(
                df,
                [
                    cleaning.Step("REMOVE_EXACT_DUPLICATES"),
                    cleaning.Step("NORMALIZE_TEXT", ["category"]),
                    cleaning.Step("HANDLE_MISSING", ["customer_rating"], {"strategy": "FLAG_ONLY"}),
                    cleaning.Step("HANDLE_MISSING", ["payment_method"], {"strategy": "LABEL"}),
                    cleaning.Step("PARSE_DATES", ["order_date"], {"formats": ["yyyy-MM-dd HH:mm:ss"]}),
                    cleaning.Step("REMOVE_INVALID_RECORDS", [], {"rule": "quantity < 0"}),
                ],
            ).drop("reason")
        ),
    }


DIRTY = (
    FLAT.replace("AS customer_rating", "AS customer_rating, l_returnflag, l_linestatus, CAST(ROUND(l_tax * 100) AS INT) AS t, o_orderstatus")
    + """,
defects AS (
  SELECT CAST(order_id AS VARCHAR) AS order_id, strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date,
    CAST(customer_id AS VARCHAR) AS customer_id, CAST(product_id AS VARCHAR) AS product_id, product_name,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN ' ' || category || ' ' ELSE category END AS category,
    unit_price, CASE WHEN l_returnflag = 'R' AND t = 8 THEN -quantity
      WHEN l_returnflag <> 'R' AND t = 0 AND discount_pct = 0.1 THEN quantity * 100 ELSE quantity END AS quantity,
    discount_pct, total_amount, CASE WHEN o_orderstatus <> 'P' THEN payment_method END AS payment_method,
    city, region, customer_rating, l_returnflag = 'A' AND t = 1 AS again FROM flat),
raw AS (SELECT * EXCLUDE (again) FROM defects UNION ALL SELECT * EXCLUDE (again) FROM defects WHERE again)"""
)
_R = f"WITH {DIRTY}"
_NULLS = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in COLUMNS)
_DUPES = "(SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM raw GROUP BY ALL))"


def _group_all(table: str) -> str:
    cols = ", ".join(COLUMNS)
    return f"(SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {cols}))"


def _fence(c: str, table: str = "raw") -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"(SELECT COUNT(*) FROM {table}, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table}) WHERE q3 > q1 AND ({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)))"


def _profile(table: str) -> str:
    outliers = " + ".join(_fence(c, table) for c in NUMBERS)
    return f"""SELECT COUNT(*) AS total_rows, COUNT(*) * {len(COLUMNS)} AS total_cells, {_NULLS} AS null_cells,
  {_group_all(table)} AS duplicate_rows, {outliers} AS outlier_count,
  COUNT(*) FILTER (WHERE quantity < 0) + COUNT(*) FILTER (WHERE unit_price < 0) + COUNT(*) FILTER (WHERE total_amount < 0) AS neg,
  COUNT(*) FILTER (WHERE abs(CAST(total_amount AS DOUBLE) - CAST(quantity AS DOUBLE) * unit_price * (1 - COALESCE(discount_pct, 0))) > 1.0) AS broken
FROM {table}"""


_SCORES = f"""SELECT *, CAST(round_even((1 - CAST(null_cells AS DOUBLE) / total_cells) * 100, 0) AS BIGINT) AS completeness_score,
  CAST(round_even((1 - CAST(duplicate_rows AS DOUBLE) / total_rows) * 100, 0) AS BIGINT) AS uniqueness_score,
  CAST(round_even((1 - CAST(neg AS DOUBLE) / (total_rows * {len(NUMBERS)})) * 100, 0) AS BIGINT) AS validity_score,
  CAST(round_even((1 - CAST(broken AS DOUBLE) / total_rows) * 100, 0) AS BIGINT) AS consistency_score"""
_OVERALL = "CAST(round_even(0.30 * completeness_score + 0.25 * uniqueness_score + 0.25 * validity_score + 0.20 * consistency_score, 0) AS BIGINT) AS overall_score"


def _missing_issue(c: str, action: str) -> str:
    return f"""SELECT 'MISSING_VALUES' AS issue_type, CASE WHEN p > 10 THEN 'HIGH' WHEN p > 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  '{c}' AS column_name, n AS affected_rows, '{action}' AS action_taken
FROM (SELECT COUNT(*) FILTER (WHERE {c} IS NULL) AS n, ROUND(CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / COUNT(*) * 100, 1) AS p FROM raw) WHERE n > 0"""


_CONFLICT = """conflicts AS (SELECT order_id AS transaction_id, COUNT(*) AS lines FROM {0} GROUP BY order_id
  HAVING COALESCE(MIN(customer_id) <> MAX(customer_id), FALSE) OR COALESCE(MIN(order_date) <> MAX(order_date), FALSE)
      OR COALESCE(MIN(payment_method) <> MAX(payment_method), FALSE) OR (COUNT(payment_method) > 0 AND COUNT(payment_method) < COUNT(*)))"""
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '\\p{{P}}', '', 'g'), '\\s+', ' ', 'g'))"


def _variants(columns) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS variant, {_NORM.format(c)} AS key, COUNT(*) AS rows FROM raw WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )
    return f"""variants AS (SELECT *, FIRST_VALUE(variant) OVER (PARTITION BY "column", key ORDER BY rows DESC, variant) AS dominant FROM ({cells}))"""


_SHAPED = ("unit_price", "quantity", "discount_pct", "total_amount")
_FORMAT_BASE = " + ".join(f"COUNT({c})" for c in _SHAPED)
_PARTS = f"""parts AS (
  SELECT 'format' AS part, 2 AS weight, CAST(SUM(n) - MAX(n) AS BIGINT) AS affected, CAST(SUM(n) + ANY_VALUE(more) AS BIGINT) AS base FROM (SELECT COUNT(order_date) AS n FROM raw WHERE order_date IS NOT NULL GROUP BY regexp_replace(order_date, '[0-9]', '9', 'g')), (SELECT {_FORMAT_BASE} AS more FROM raw)
  UNION ALL SELECT 'category_variants', 2, CAST(COALESCE(SUM(rows) FILTER (WHERE variant <> dominant), 0) AS BIGINT), CAST(SUM(rows) AS BIGINT) FROM variants
  UNION ALL SELECT 'header_conflicts', 3, CAST(COALESCE(SUM(lines), 0) AS BIGINT), (SELECT COUNT(*) FROM raw) FROM conflicts)"""
_RULES = f"""rules AS (
  SELECT 'VAL-PRICE-NEG' AS rule, 3 AS weight, COUNT(*) FILTER (WHERE unit_price < 0) AS violations, COUNT(unit_price) AS checked FROM raw
  UNION ALL SELECT 'VAL-QTY', 2, COUNT(*) FILTER (WHERE quantity = 0), COUNT(quantity) FROM raw
  UNION ALL SELECT 'VAL-REV-SIGN', 3, COUNT(*) FILTER (WHERE (total_amount < 0 AND quantity >= 0) OR (total_amount > 0 AND quantity < 0)), COUNT(*) FROM raw
  UNION ALL SELECT 'VAL-DISC', 2, COUNT(*) FILTER (WHERE discount_pct < 0 OR discount_pct > 1), COUNT(discount_pct) FROM raw
  UNION ALL SELECT 'VAL-DATE', 3, COUNT(*) FILTER (WHERE CAST(order_date AS DATE) > DATE '{AS_OF}' OR CAST(order_date AS DATE) < DATE '1990-01-01'), COUNT(order_date) FROM raw)"""
_ROLE_WEIGHT = {c: 3 if r in quality.KEY_ROLES else 2 for r, c in MAPPING.items()}
_LOST = " + ".join(f"{_ROLE_WEIGHT.get(c, 1)} * COUNT(*) FILTER (WHERE {c} IS NULL)" for c in COLUMNS)
_WEIGHTS = sum(_ROLE_WEIGHT.get(c, 1) for c in COLUMNS)
_GAPPY = ("customer_rating", "payment_method")


def _outlier(c: str, domain: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", method, ROUND(ANY_VALUE(lo), 4) AS lower, ROUND(ANY_VALUE(hi), 4) AS upper, COALESCE(COUNT(*) FILTER (WHERE {x} < lo), 0) AS low_count,
  COALESCE(COUNT(*) FILTER (WHERE {x} > hi), 0) AS high_count, {domain} AS domain_count
FROM raw, (SELECT CASE WHEN d <= 12 THEN 'discrete' WHEN abs(sk) < 1 THEN 'ZSCORE' ELSE 'IQR' END AS method,
  CASE WHEN d <= 12 THEN NULL WHEN abs(sk) < 1 THEN m - 3 * s ELSE q1 - 1.5 * (q3 - q1) END AS lo,
  CASE WHEN d <= 12 THEN NULL WHEN abs(sk) < 1 THEN m + 3 * s ELSE q3 + 1.5 * (q3 - q1) END AS hi
  FROM (SELECT COUNT(DISTINCT {x}) AS d, skewness({x}) AS sk, AVG({x}) AS m, stddev_samp({x}) AS s, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM raw))
GROUP BY method"""


_CLEAN = f"""{DIRTY}, once AS (SELECT DISTINCT * FROM raw),
v2 AS (SELECT trim(order_id) AS order_id, CAST(order_date AS TIMESTAMP) AS order_date, trim(customer_id) AS customer_id,
  trim(product_id) AS product_id, trim(product_name) AS product_name, trim(category) AS category, unit_price, quantity, discount_pct, total_amount,
  COALESCE(trim(payment_method), 'UNKNOWN') AS payment_method, trim(city) AS city, trim(region) AS region,
  COALESCE(CAST(customer_rating AS DOUBLE), (SELECT median(CAST(customer_rating AS DOUBLE)) FROM once)) AS customer_rating FROM once)"""

SQL = {
    "dq_profile": f"""{_R} SELECT {_OVERALL}, completeness_score, uniqueness_score, validity_score, consistency_score,
  total_rows, total_cells, null_cells, duplicate_rows, outlier_count FROM ({_SCORES} FROM ({_profile('raw')}))""",
    "dq_issues": f"""{_R} SELECT 'EXACT_DUPLICATE_ROWS' AS issue_type, 'HIGH' AS severity, '[ALL_COLUMNS]' AS column_name,
  {_group_all('raw')} AS affected_rows, 'One copy is kept by cleaning' AS action_taken
UNION ALL {_missing_issue('payment_method', 'Label UNKNOWN is set by cleaning')}
UNION ALL {_missing_issue('customer_rating', 'Median is filled in by cleaning')}
UNION ALL SELECT 'WHITESPACE_INCONSISTENCY', 'LOW', 'category', COUNT(*), 'Outer blanks are cut by cleaning' FROM raw WHERE category <> trim(category)
UNION ALL SELECT 'STATISTICAL_OUTLIERS', 'INFO', (SELECT string_agg(c, ', ' ORDER BY p) FROM (
    SELECT * FROM (VALUES {", ".join(f"('{c}', {i}, {_fence(c)})" for i, c in enumerate(NUMBERS))}) AS v(c, p, n) WHERE n > 0 ORDER BY p LIMIT 3)),
  {' + '.join(_fence(c) for c in NUMBERS)}, 'Reported only; values stay'""",
    "dq_duplicate_rows": f"{_R} SELECT {_group_all('raw')} AS duplicate_rows",
    "dq_near_duplicates": f"""{_R} SELECT COUNT(*) AS near_duplicate_groups, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS near_duplicate_rows FROM (
  SELECT SUM(n) AS n, COUNT(*) AS v FROM (
    SELECT *, {_NORM.format('category')} AS nc, {_NORM.format('payment_method')} AS np, {_NORM.format('order_date')} AS nd, {_NORM.format('product_name')} AS nn,
      ROUND(unit_price, 2) AS nu, ROUND(total_amount, 2) AS nt, ROUND(discount_pct, 2) AS ndp FROM (SELECT *, COUNT(*) AS n FROM raw GROUP BY ALL))
  GROUP BY order_id, customer_id, product_id, nd, nn, nc, nu, quantity, ndp, nt, np, city, region, customer_rating HAVING v > 1)""",
    "dq_duplicate_identifiers": f"{_R}, once AS (SELECT DISTINCT * FROM raw), {_CONFLICT.format('once')} SELECT COUNT(*) AS groups, CAST(COALESCE(SUM(lines), 0) AS BIGINT) AS rows FROM conflicts",
    "dq_repeated_order_ids": f"""{_R}, once AS (SELECT DISTINCT * FROM raw) SELECT COUNT(*) AS groups, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS rows
FROM (SELECT COUNT(*) AS n FROM once GROUP BY order_id HAVING COUNT(*) > 1)""",
    "dq_rows_in_conflict": f"{_R}, once AS (SELECT DISTINCT order_id, payment_method, customer_id, order_date FROM raw), {_CONFLICT.format('once')} SELECT order_id, payment_method, customer_id, order_date FROM raw WHERE order_id IN (SELECT transaction_id FROM conflicts)",
    "dq_consistency_parts": f"{_R}, {_variants(['category'])}, {_CONFLICT.format('raw')}, {_PARTS} SELECT * REPLACE (CAST(weight AS BIGINT) AS weight) FROM parts",
    "dq_category_variants": f"{_R}, {_variants(['category', 'payment_method'])} SELECT * FROM variants",
    "dq_validity_rules": f"{_R}, {_RULES} SELECT * REPLACE (CAST(weight AS BIGINT) AS weight) FROM rules",
    "dq_weighted_score": f"""{_R}, {_variants(['category'])}, {_CONFLICT.format('raw')}, {_PARTS}, {_RULES},
dims AS (SELECT 100.0 - LEAST(100.0, 2 * (SELECT CAST(({_LOST}) * 100 AS DOUBLE) / (COUNT(*) * {_WEIGHTS}) FROM raw)) AS completeness,
  100.0 - LEAST(100.0, 2 * (SELECT SUM(weight * (CAST(affected AS DOUBLE) / base)) * 100 / SUM(weight) FROM parts)) AS consistency,
  100.0 - LEAST(100.0, 3 * (SELECT SUM(weight * (CAST(violations AS DOUBLE) / checked)) * 100 / SUM(weight) FROM rules)) AS validity,
  100.0 - LEAST(100.0, 10 * (SELECT CAST({_group_all('raw')} * 100 AS DOUBLE) / COUNT(*) FROM raw)) AS uniqueness),
o AS (SELECT *, ROUND(0.30 * completeness + 0.20 * consistency + 0.25 * validity + 0.25 * uniqueness, 2) AS overall FROM dims)
SELECT overall, ROUND(completeness, 2) AS completeness, ROUND(consistency, 2) AS consistency, ROUND(validity, 2) AS validity,
  ROUND(uniqueness, 2) AS uniqueness, CASE WHEN overall >= 85 THEN 'GOOD' WHEN overall >= 70 THEN 'FAIR' ELSE 'POOR' END AS band FROM o""",
    "dq_accuracy_indicators": f"""{_R} SELECT COUNT(*) FILTER (WHERE total_amount < 0) AS negative_revenue_rows, COUNT(*) FILTER (WHERE total_amount = 0) AS zero_revenue_rows,
  COUNT(*) FILTER (WHERE total_amount < 0 AND quantity < 0) AS refund_rows, COUNT(*) FILTER (WHERE CAST(order_date AS DATE) > DATE '{AS_OF}') AS future_date_rows,
  COUNT(*) FILTER (WHERE off) AS revenue_price_qty_mismatch_rows, ROUND(CAST(COUNT(*) FILTER (WHERE NOT off) AS DOUBLE) / COUNT(off), 6) AS revenue_consistency_ratio,
  COUNT(*) FILTER (WHERE {' AND '.join(f'{c} IS NULL' for c in COLUMNS)}) AS blank_rows
FROM (SELECT *, abs(CAST(total_amount AS DOUBLE) - unit_price * CAST(quantity AS DOUBLE)) > GREATEST(0.01, abs(unit_price * CAST(quantity AS DOUBLE)) * 0.01) AS off FROM raw)""",
    "dq_missingness": f"""{_R} SELECT "column", nulls, ROUND(p, 4) AS null_pct, CASE WHEN p <= 5 THEN 'LOW' WHEN p <= 20 THEN 'MODERATE' WHEN p <= 50 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
FROM (SELECT "column", nulls, CAST(nulls AS DOUBLE) / n * 100 AS p FROM ({" UNION ALL ".join(f"SELECT '{c}' AS " + '"column"' + f", COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, COUNT(*) AS n FROM raw" for c in COLUMNS)}) WHERE nulls > 0)""",
    "dq_co_missing": f"{_R} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CAST(COUNT(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS DOUBLE) / COUNT(*) FILTER (WHERE {a} IS NULL), 6) AS share FROM raw"
        for a in _GAPPY
        for b in _GAPPY
    ),
    "dq_missing_masks": f"""{_R} SELECT concat_ws(',', CASE WHEN customer_rating IS NULL THEN 'customer_rating' END, CASE WHEN payment_method IS NULL THEN 'payment_method' END) AS mask,
  COUNT(*) AS rows FROM raw GROUP BY 1 HAVING mask <> ''""",
    "dq_outlier_report": f"{_R} "
    + " UNION ALL ".join(
        _outlier(c, domain)
        for c, domain in (
            ("unit_price", "COUNT(*) FILTER (WHERE unit_price < 0 AND NOT COALESCE(quantity < 0, FALSE))"),
            ("quantity", "COUNT(*) FILTER (WHERE quantity > 10000)"),
            ("discount_pct", "COUNT(*) FILTER (WHERE FALSE)"),
            ("total_amount", "COUNT(*) FILTER (WHERE total_amount < 0 AND NOT COALESCE(quantity < 0, FALSE))"),
            ("customer_rating", "COUNT(*) FILTER (WHERE FALSE)"),
        )
    ),
    "dq_extreme_rows": f"""{_R} SELECT order_id, product_id, quantity, unit_price, CASE WHEN quantity < lo THEN lo - quantity ELSE quantity - hi END AS distance
FROM raw, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(CAST(quantity AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(quantity AS DOUBLE), 0.75) AS q3 FROM raw))
WHERE quantity < lo OR quantity > hi ORDER BY distance DESC, order_id, product_id, quantity, unit_price LIMIT 100""",
    "clean_rows": f"WITH {_CLEAN} SELECT * REPLACE (strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date, CAST(total_amount AS DOUBLE) AS total_amount) FROM v2",
    "clean_log": f"""WITH {_CLEAN} SELECT CAST(step AS BIGINT) AS step, operation, "column", CAST(n AS BIGINT) AS rows_modified FROM (
  SELECT 1 AS step, 'REMOVE_EXACT_DUPLICATES' AS operation, '[ALL_COLUMNS]' AS "column", (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM once) AS n
  UNION ALL SELECT 2, 'STANDARDIZE_WHITESPACE', 'category', (SELECT COUNT(*) FROM once WHERE category <> trim(category))
  UNION ALL SELECT 3, 'IMPUTE_CATEGORICAL_LABEL', 'payment_method', (SELECT COUNT(*) FROM once WHERE payment_method IS NULL)
  UNION ALL SELECT 4, 'IMPUTE_NUMERIC_MEDIAN', 'customer_rating', (SELECT COUNT(*) FROM once WHERE customer_rating IS NULL)
  UNION ALL SELECT 5, 'STANDARDIZE_DATETIME_ISO8601', 'order_date', (SELECT COUNT(*) FROM once))""",
    "clean_compare_versions": f"""WITH {_CLEAN}, a AS (SELECT *, {_OVERALL} FROM ({_SCORES} FROM ({_profile('raw')}))),
b AS (SELECT *, {_OVERALL} FROM ({_SCORES} FROM ({_profile('v2')})))
SELECT figure, v1, v2, v2 - v1 AS delta, ROUND((v2 - v1) * 100 / NULLIF(v1, 0), 2) AS delta_pct FROM (
  {" UNION ALL ".join(f"SELECT '{f}' AS figure, CAST(a.{f} AS DOUBLE) AS v1, CAST(b.{f} AS DOUBLE) AS v2 FROM a, b" for f in ("total_rows", "overall_score", "duplicate_rows", "null_cells", "outlier_count"))})""",
    "clean_normalize_categories": f"{_R}, {_variants(['category'])} SELECT dominant AS category, CAST(SUM(rows) AS BIGINT) AS rows FROM variants GROUP BY dominant",
    "clean_steps_log": f"""WITH {_CLEAN}, n AS (SELECT (SELECT COUNT(*) FROM raw) AS r0, (SELECT COUNT(*) FROM once) AS r1,
  (SELECT COUNT(*) FROM once WHERE category <> trim(category)) AS pad, (SELECT COUNT(*) FROM once WHERE customer_rating IS NULL) AS g1,
  (SELECT COUNT(*) FROM once WHERE payment_method IS NULL) AS g2, (SELECT COUNT(*) FROM once WHERE quantity < 0) AS neg)
SELECT CAST(seq AS BIGINT) AS seq, type, columns, rows_before, rows_after, rows_affected FROM (
  SELECT 1 AS seq, 'REMOVE_EXACT_DUPLICATES' AS type, '' AS columns, r0 AS rows_before, r1 AS rows_after, r0 - r1 AS rows_affected FROM n
  UNION ALL SELECT 2, 'NORMALIZE_TEXT', 'category', r1, r1, pad FROM n
  UNION ALL SELECT 3, 'HANDLE_MISSING', 'customer_rating', r1, r1, g1 FROM n
  UNION ALL SELECT 4, 'HANDLE_MISSING', 'payment_method', r1, r1, g2 FROM n
  UNION ALL SELECT 5, 'PARSE_DATES', 'order_date', r1, r1, r1 FROM n
  UNION ALL SELECT 6, 'REMOVE_INVALID_RECORDS', '', r1, r1 - neg, neg FROM n)""",
}
