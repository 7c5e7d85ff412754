"""Metrics, insights, number checks and ad-hoc SQL over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillview.functions.columns import one_row, ratio, rounded
from tillview.operators import adhoc, catalog, claims, insights, metrics, quality, rfm, slices
from tillview.operators.relations import Relations
from tillview.plans.analytics_queries import _CODE, _FIGURES
from tillview.plans.analytics_queries import SQL as ANALYTICS_SQL
from tillview.plans.edge import plain
from tillview.plans.quality_queries import _CLEAN, cleaned, raw
from tillview.plans.quality_queries import SQL as QUALITY_SQL
from tillview.plans.shared import relations
from tillview.plans.template_sql import CUSTOMERS, ORDERS, using
from tillview.plans.template_sql import SQL as TEMPLATE_SQL
from tillview.session import kept_for_inputs, spread, stage, tune
from tillview.sources.flat import flat, flat_source
from tillview.sources.transactions import benchmark_source, table

DIGEST = "digest-of-the-version"


def _flat(spark, d):
    return flat(tune(spark), d, "order_id", "customer_id", "order_date", "total_amount", "payment_method", "product_id")


@kept_for_inputs
def _pool(sf_dir: str):
    spark = tune(SparkSession.active())
    df = _flat(spark, sf_dir)
    done = cleaned(spark, sf_dir)
    scored = rfm.score(rfm.flat_base(df), rules="code")
    counts = {
        "cleaned_rows": done.cleaned_rows,
        "original_rows": done.original_rows,
        "dropped_duplicates": done.dropped_duplicates,
        "imputed_cells": done.imputed_cells,
    }
    return stage(
        metrics.number_pool(
            df, flat_source(spark, sf_dir), quality.basic_profile(raw(spark, sf_dir)), counts, rfm.segment_table(spark, scored)
        )
    )


def pool(spark, sf_dir):
    return _pool(spark, sf_dir)


def statements(spark, sf_dir):
    """One sentence per customer, quoting its revenue, share, orders and value per order."""
    rel = relations(spark, sf_dir)
    total = rel.tx("revenue").agg(F.sum("revenue").alias("t"))
    people = rel.customers("total_revenue", "order_count")
    share = rounded(ratio("total_revenue", one_row(total, "t")) * 100, 2)
    aov = rounded(ratio("total_revenue", "order_count"), 2)
    lakh = rounded(F.col("total_revenue").cast("double") / 100000, 2)
    text = F.concat(
        F.lit("Customer spent ₹"),
        F.format_number(F.col("total_revenue").cast("double"), 2),
        F.lit(", that is ₹"),
        lakh.cast("decimal(18,2)").cast("string"),
        F.lit("L or "),
        share.cast("decimal(9,2)").cast("string"),
        F.lit("% of the total, "),
        ratio("order_count", F.lit(1)).cast("decimal(18,1)").cast("string"),
        F.lit("x the usual visits and "),
        aov.cast("decimal(18,2)").cast("string"),
        F.lit(" per order."),
    )
    return people.select(F.col("customer_id").alias("doc_id"), text.alias("text"))


def _checked(spark, sf_dir, texts):
    return claims.match(stage(claims.extract(texts)), pool(spark, sf_dir))


def _documents(spark, d):
    return spread(table(tune(spark), d, "documents").select("doc_id", "text"))


def _metric_rows(spark, d):
    # Relations of its own: keeping the grouped relations must not change what other queries measure.
    rel = Relations(tune(spark), benchmark_source(spark, d))
    rows = metrics.collect_metrics(rel, "run-1")
    member = F.array_join(F.map_values("dimensions"), "/")
    return rows.select("module", "metric_name", member.alias("member"), rounded("value", 6).alias("value"), "unit")


def _sql(text, **parameters):
    def run(spark, d):
        adhoc.session_over(relations(spark, d))
        return plain(adhoc.query(spark, text, parameters))

    return run


def _findings(spark, d):
    df = _flat(spark, d)
    source = flat_source(spark, d)
    scored = rfm.score(rfm.flat_base(df), rules="code")
    pay = catalog.payment_table(df.withColumn("payment_method", F.replace("payment_method", F.lit("1-URGENT"), F.lit("UPI"))))
    return insights.findings(
        rfm.segment_table(spark, scored),
        stage(catalog.product_table(source)),
        pay,
        quality.basic_profile(raw(spark, d)),
        slices.key_figures(df),
    )


def _registry(spark, d):
    out = metrics.registry(_flat(spark, d), quality.basic_profile(raw(spark, d)), DIGEST, "run-1")
    return plain(out.select("metric_key", "category", "formatted_value", "numeric_value", "unit", "grain"))


def _latest(spark, d):
    """Order statuses as metric records over time: the newest value per customer."""
    orders = table(tune(spark), d, "orders")
    records = orders.select(
        F.col("o_custkey").alias("metric_key"),
        F.struct("o_orderdate", "o_orderkey").alias("created_at"),
        F.col("o_totalprice").alias("numeric_value"),
    )
    return plain(metrics.latest_by_key(records).select("metric_key", "numeric_value"))


ADHOC = {
    "sql_filter_aggregate": """SELECT country, COUNT(*) FILTER (WHERE discount > 5) AS discounted, COUNT(DISTINCT CASE WHEN discount = 0 THEN customer_id END) AS full_price_customers
FROM transactions GROUP BY country""",
    "sql_scalar_subquery": "SELECT COUNT(*) AS above_average FROM orders WHERE order_revenue > (SELECT AVG(order_revenue) FROM orders)",
    "sql_set_union": "SELECT customer_id FROM customers WHERE order_count >= 12 UNION SELECT customer_id FROM customers WHERE total_revenue > 3000000",
    "sql_set_intersect": "SELECT customer_id FROM customers WHERE order_count >= 12 INTERSECT SELECT customer_id FROM customers WHERE total_revenue > 3000000",
    "sql_set_except": "SELECT customer_id FROM customers WHERE order_count >= 12 EXCEPT SELECT customer_id FROM customers WHERE total_revenue > 3000000",
    "sql_full_outer_join": """SELECT COUNT(*) AS n, COUNT(a.customer_id) AS l, COUNT(b.customer_id) AS r
FROM (SELECT customer_id FROM customers WHERE order_count >= 10) a FULL OUTER JOIN (SELECT customer_id FROM customers WHERE total_revenue > 2500000) b ON a.customer_id = b.customer_id""",
    "sql_null_functions": """SELECT COUNT(coalesce(NULLIF(country, 'CHINA'), NULLIF(state, 'ASIA'))) AS placed, SUM(CAST(ifnull(NULLIF(discount, 0), 100) AS DOUBLE)) AS discount,
  COUNT(NULLIF(payment_method, '1-URGENT')) AS calm, MAX(CASE WHEN customer_id IS NULL THEN 'no' ELSE 'yes' END) AS known FROM transactions""",
    "sql_semi_join": "SELECT COUNT(*) AS n FROM customers c WHERE EXISTS (SELECT 1 FROM transactions t WHERE t.customer_id = c.customer_id AND t.quantity >= 50)",
    "sql_band_join": """SELECT d.band, COUNT(*) AS lines, SUM(CAST(t.quantity AS DOUBLE)) AS quantity
FROM (SELECT CASE WHEN discount < 3 THEN 1 WHEN discount < 7 THEN 2 ELSE 3 END AS k, quantity FROM transactions) t
JOIN (VALUES (1, 'low'), (2, 'mid'), (3, 'high')) AS d(k, band) ON t.k = d.k GROUP BY d.band""",
}
# Windows over the months of a year: at most twelve rows each, whatever the size of the tables.
_WINDOWED = """SELECT y, m, n, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr,
  ROUND(percent_rank() OVER w, 9) AS pr, ROUND(cume_dist() OVER w, 9) AS cd, ntile(3) OVER w AS nt,
  lag(n) OVER w AS lg, lead(n) OVER w AS ld, first_value(n) OVER w AS fv, last_value(n) OVER w AS lv, nth_value(n, 2) OVER w AS nv
FROM (SELECT year(order_date) AS y, month(order_date) AS m, COUNT(*) AS n FROM {0} GROUP BY 1, 2) WINDOW w AS (PARTITION BY y ORDER BY n DESC, m)"""
_FUNCTIONS = """SELECT {0} FROM orders"""
_FUNCTION_COLUMNS = {
    "starts": "COUNT(*) FILTER (WHERE starts_with(CAST(transaction_id AS STRING), '1'))",
    "ends": "COUNT(*) FILTER (WHERE ends_with(CAST(transaction_id AS STRING), '7'))",
    "matches": "COUNT(*) FILTER (WHERE regexp_matches(CAST(transaction_id AS STRING), '^[0-4]+$'))",
    "first_only": "MAX(regexp_replace(CAST(order_date AS STRING), '-', '/'))",
    "dow": "CAST(SUM(dayofweek(order_date)) AS BIGINT)",
    "iso": "CAST(SUM(isodow(order_date)) AS BIGINT)",
    "boundaries": "CAST(SUM(date_diff('month', order_date, DATE '2001-08-31')) AS BIGINT)",
    "months": "CAST(SUM(date_sub('month', order_date, DATE '2001-08-31')) AS BIGINT)",
    "seconds": "CAST(MAX(epoch(CAST(order_date AS TIMESTAMP))) AS BIGINT)",
    "week_label": "MAX(strftime(order_date, '%Y-W%W'))",
    "joined": "MAX(concat(CAST(line_count AS STRING), NULL))",
    "whole": "CAST(SUM(CAST(trunc(CAST(order_revenue AS DOUBLE)) AS BIGINT)) AS BIGINT)",
    "logs": "ROUND(SUM(log(CAST(line_count AS DOUBLE))), 6)",
    "q_cont": "ROUND(quantile_cont(CAST(line_count AS DOUBLE), 0.3), 6)",
    "by_min": "arg_min(transaction_id, (order_revenue, transaction_id))",
    "modes": "mode(line_count)",
    "part": "MAX(split_part(CAST(order_date AS STRING), '-', 2))",
    "pads": "MAX(lpad(CAST(line_count AS STRING), 4, '0'))",
    "biggest": "MAX(greatest(line_count, 3))",
    "tried": "COUNT(TRY_CAST(CAST(order_date AS STRING) AS INT))",
}


def _select(functions):
    return _FUNCTIONS.format(", ".join(f"{e} AS {n}" for n, e in functions.items()))


def insight_queries():
    return {
        "metric_catalog": _metric_rows,
        "metric_series": lambda spark, d: plain(
            metrics.collect_series(relations(spark, d), "run-1").select("metric_name", "grain", F.inline("value_series"))
        ).withColumn("v", rounded("v", 5)),
        "metric_registry": _registry,
        "metric_latest_by_key": _latest,
        "metric_latest_50": lambda spark, d: plain(
            metrics.latest(table(tune(spark), d, "events").select("event_id", "event_type", "value", F.struct("ts", "event_id").alias("created_at"))).drop("created_at")
        ),
        "metric_evidence": lambda spark, d: plain(
            metrics.evidence(_flat(spark, d), rfm.score(rfm.flat_base(_flat(spark, d)), rules="code"), DIGEST, ["order_id", "product_id"]).select(
                "metric_key", "raw_value"
            )
        ),
        "metric_high_value_join": lambda spark, d: plain(
            metrics.high_value_revenue_by_join(_flat(spark, d), rfm.score(rfm.flat_base(_flat(spark, d)), rules="code"))
        ),
        "insight_findings": _findings,
        "insight_ranked": lambda spark, d: plain(insights.ranked_insights(_metric_rows(spark, d))),
        "number_pool": lambda spark, d: plain(pool(spark, d)),
        "claims_in_documents": lambda spark, d: plain(claims.extract(_documents(spark, d))),
        "claims_in_statements": lambda spark, d: plain(claims.extract(statements(tune(spark), d))),
        "claims_matched": lambda spark, d: plain(_checked(spark, d, statements(tune(spark), d))),
        "claims_report_documents": lambda spark, d: plain(
            claims.report(_documents(spark, d), _checked(spark, d, _documents(spark, d)))
        ),
        "claims_report_findings": lambda spark, d: plain(
            claims.report(
                _findings(spark, d).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "finding", "impact").alias("text")),
                _checked(spark, d, _findings(spark, d).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "finding", "impact").alias("text"))),
            )
        ),
        "sql_windows": _sql(_WINDOWED.format("orders")),
        "sql_functions": _sql(_select(_FUNCTION_COLUMNS)),
        **{name: _sql(text) for name, text in ADHOC.items()},
    }


# --- DuckDB ---------------------------------------------------------------------------------------

def _bound(b) -> str:
    base = TEMPLATE_SQL[b.template]
    parts = []
    for name, column, unit in b.metrics:
        value = f'CAST("{column}" AS DOUBLE)'
        if not b.dimensions:
            parts.append(f"SELECT '{b.module}' AS module, '{name}' AS metric_name, '' AS member, ROUND({value}, 6) AS value, '{unit}' AS unit FROM ({base}) WHERE \"{column}\" IS NOT NULL")
            continue
        member = " || '/' || ".join(f"CAST({x} AS VARCHAR)" for x in b.dimensions)
        if b.top:
            keep = "" if name in b.additive else f" AND rn <= {b.top}"
            order = ", ".join([f"{b.order} DESC", *b.dimensions])
            parts.append(
                f"""SELECT '{b.module}' AS module, '{name}' AS metric_name, CASE WHEN rn <= {b.top} THEN {member} ELSE '__OTHER__' END AS member,
  ROUND(CAST(SUM(CAST({value} AS DECIMAL(38,10))) AS DOUBLE), 6) AS value, '{unit}' AS unit FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS rn FROM ({base})) WHERE "{column}" IS NOT NULL{keep} GROUP BY 3"""
            )
        else:
            parts.append(f"SELECT '{b.module}' AS module, '{name}' AS metric_name, {member} AS member, ROUND({value}, 6) AS value, '{unit}' AS unit FROM ({base}) WHERE \"{column}\" IS NOT NULL")
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


_NEW = TEMPLATE_SQL["cust_new_vs_returning_monthly"]
_CATALOG = "\nUNION ALL\n".join(_bound(b) for b in metrics.CATALOG) + "".join(
    f"""
UNION ALL SELECT 'CUSTOMERS', '{n}', '', CAST({n} AS DOUBLE), 'count' FROM (SELECT * FROM ({_NEW}) WHERE month_start > (SELECT CAST(date_trunc('month', MIN(o_orderdate)) AS DATE)::VARCHAR FROM orders JOIN lineitem ON l_orderkey = o_orderkey) ORDER BY month_start DESC LIMIT 1)"""
    for n in ("new_customers", "returning_customers")
)


def _adhoc(text: str) -> str:
    return using(ORDERS, CUSTOMERS) + ", orders_ AS (SELECT * FROM o)\n" + text.replace("FROM orders", "FROM orders_")


_CUR = r"(?i)₹\s*(?:[0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]+)?|\d+(?:\.[0-9]+)?)\s*(?:L|Cr|k|M)?"
_PCT = r"[+-]?\d+(?:\.\d+)?\s*%"
_RAT = r"(?i)\d+(?:\.\d+)?\s*x"
_NUM = r"\b(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|\d+\.\d+)\b"


def _list(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(text, '{pattern}'), lambda t: trim(t))"


def _claims(source: str) -> str:
    return f"""src AS ({source}),
lists AS (SELECT doc_id, {_list(_CUR)} AS m, {_list(_PCT)} AS p, {_list(_RAT)} AS x, {_list(_NUM)} AS n FROM src),
seen AS (SELECT doc_id, list_distinct(m) AS m, list_filter(list_distinct(p), lambda t: NOT list_contains(m, t)) AS p,
  list_filter(list_distinct(x), lambda t: NOT list_contains(m, t) AND NOT list_contains(p, t)) AS x, n FROM lists),
kept AS (SELECT doc_id, m, p, x, list_distinct(list_filter(n, lambda t, i: len(list_filter(list_concat(list_concat(m, p), list_concat(x, list_slice(n, 1, i - 1))), lambda s: contains(s, t))) = 0)) AS n FROM seen),
claims AS (
  SELECT doc_id, token, 'CURRENCY' AS kind, TRY_CAST(regexp_replace(regexp_replace(token, '(?i)(l|cr|k|m)$', ''), '[₹,\\s]', '', 'g') AS DOUBLE)
    * CASE lower(regexp_extract(token, '(?i)(l|cr|k|m)$', 1)) WHEN 'l' THEN 1e5 WHEN 'cr' THEN 1e7 WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 ELSE 1 END AS number
  FROM (SELECT doc_id, unnest(m) AS token FROM kept)
  UNION ALL SELECT doc_id, token, 'PERCENTAGE', abs(TRY_CAST(regexp_replace(token, '[%\\s]', '', 'g') AS DOUBLE)) FROM (SELECT doc_id, unnest(p) AS token FROM kept)
  UNION ALL SELECT doc_id, token, 'RATIO', TRY_CAST(regexp_replace(token, '[xX\\s]', '', 'g') AS DOUBLE) FROM (SELECT doc_id, unnest(x) AS token FROM kept)
  UNION ALL SELECT doc_id, token, CASE WHEN contains(token, '.') THEN 'DECIMAL' ELSE 'INTEGER' END, TRY_CAST(replace(token, ',', '') AS DOUBLE) FROM (SELECT doc_id, unnest(n) AS token FROM kept))"""


_STATEMENTS = """SELECT customer_id AS doc_id, 'Customer spent ₹' || format('{:,.2f}', CAST(total_revenue AS DOUBLE)) || ', that is ₹'
  || CAST(CAST(ROUND(CAST(total_revenue AS DOUBLE) / 100000, 2) AS DECIMAL(18,2)) AS VARCHAR) || 'L or '
  || CAST(CAST(ROUND(CAST(total_revenue AS DOUBLE) / (SELECT CAST(SUM(revenue) AS DOUBLE) FROM transactions) * 100, 2) AS DECIMAL(9,2)) AS VARCHAR)
  || '% of the total, ' || CAST(CAST(order_count AS DECIMAL(18,1)) AS VARCHAR) || 'x the usual visits and '
  || CAST(CAST(ROUND(CAST(total_revenue AS DOUBLE) / order_count, 2) AS DECIMAL(18,2)) AS VARCHAR) || ' per order.' AS text FROM customers"""

_HV = "(SELECT ROUND(CAST(SUM(monetary) AS DOUBLE), 2) FROM seg WHERE r_score >= 4 AND f_score >= 4)"
_K = f"(SELECT {{}} FROM ({_FIGURES}))"

def _of(frame: str, entries, base: int) -> str:
    return "\nUNION ALL ".join(
        f"SELECT CAST({base + i} AS BIGINT) AS position, '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM ({frame})" for i, (n, e) in enumerate(entries)
    )


_SEG_AT = "CAST(300 + CASE code WHEN 'HV' THEN 0 WHEN 'REG' THEN 10 WHEN 'OCC' THEN 20 ELSE 30 END AS BIGINT)"
_SEG = (
    ("_count", "customer_count"), ("_cust_pct", "customer_pct"), ("_rev", "total_revenue"), ("_rev_lakh", "ROUND(total_revenue / 1e5, 2)"),
    ("_rev_pct", "revenue_pct"), ("_aov", "avg_order_value"), ("_recency", "avg_recency_days"),
)
_QUALITY = (
    ("quality_overall", "overall_score"), ("quality_completeness", "completeness_score"), ("quality_uniqueness", "uniqueness_score"),
    ("quality_validity", "validity_score"), ("quality_consistency", "consistency_score"), ("quality_null_cells", "null_cells"), ("quality_outliers", "outlier_count"),
)
_KPIS = (
    ("total_revenue", "total_revenue"), ("total_revenue_lakh", "ROUND(total_revenue / 1e5, 2)"), ("total_revenue_cr", "ROUND(total_revenue / 1e7, 2)"),
    ("total_orders", "total_orders"), ("total_customers", "total_customers"), ("aov", "average_order_value"),
)
_DONE = f"""WITH {_CLEAN} SELECT (SELECT COUNT(*) FROM once) AS cleaned_rows, (SELECT COUNT(*) FROM raw) AS original_rows,
  (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM once) AS dropped_duplicates,
  (SELECT COUNT(*) FILTER (WHERE customer_rating IS NULL) + COUNT(*) FILTER (WHERE payment_method IS NULL) FROM once) AS imputed_cells"""
_COUNTS = ("cleaned_rows", "original_rows", "dropped_duplicates", "imputed_cells")
_POOL = "\nUNION ALL ".join(
    [
        _of(ANALYTICS_SQL["kpi_block"], _KPIS, 0),
        _of(QUALITY_SQL["dq_profile"], _QUALITY, 100),
        _of(_DONE, [(c, c) for c in _COUNTS], 200),
        *[
            f"SELECT {_SEG_AT} + {i}, 'rfm_' || lower(code) || '{n}', CAST({e} AS DOUBLE) FROM ({ANALYTICS_SQL['rfm_code_segments']})"
            for i, (n, e) in enumerate(_SEG)
        ],
        *[
            f"SELECT 400 + rank * 3 + {i}, 'prod_' || rank || '{n}', CAST({e} AS DOUBLE) FROM ({ANALYTICS_SQL['product_table']}) WHERE rank <= 10"
            for i, (n, e) in enumerate((("_rev", "revenue"), ("_pct", "revenue_pct"), ("_units", "units_sold")))
        ],
        *[
            f"""SELECT 1000 + ROW_NUMBER() OVER (ORDER BY total_revenue DESC, payment_method) * 3 + {i}, 'pay_' || replace(lower(payment_method), ' ', '_') || '{n}', CAST({e} AS DOUBLE)
FROM ({ANALYTICS_SQL['payment_table']})"""
            for i, (n, e) in enumerate((("_rev", "total_revenue"), ("_pct", "revenue_pct"), ("_txns", "transaction_count")))
        ],
        *[f"SELECT CAST({(1 << 60) + i} AS BIGINT), '{n}', CAST({v} AS DOUBLE)" for i, (n, v) in enumerate(claims.CONSTANTS)],
    ]
)
_OFF = "abs(number - value)"
_MATCHED = f"""pool AS ({_POOL}),
best AS (SELECT number, metric, ROUND({_OFF}, 4) AS delta FROM (SELECT DISTINCT number FROM claims WHERE number IS NOT NULL)
  JOIN pool ON {_OFF} < 0.05 OR {_OFF} / NULLIF(abs(value), 0) < 0.02
  QUALIFY ROW_NUMBER() OVER (PARTITION BY number ORDER BY CASE WHEN {_OFF} < 0.05 THEN 0 ELSE 1 END, CASE WHEN {_OFF} < 0.05 THEN 0 ELSE {_OFF} END, position) = 1),
matched AS (SELECT doc_id, token, kind, claims.number, metric AS matched_metric, delta, metric IS NOT NULL AS is_verified FROM claims LEFT JOIN best ON best.number = claims.number)"""

def _core(key: str, category: str, shown: str, value: str, unit: str, grain: str, frame: str) -> str:
    return f"SELECT '{key}' AS metric_key, '{category}' AS category, {shown} AS formatted_value, CAST({value} AS DOUBLE) AS numeric_value, '{unit}' AS unit, '{grain}' AS grain FROM ({frame})"


_KPI_SQL, _SEG_SQL = ANALYTICS_SQL["kpi_block"], ANALYTICS_SQL["rfm_code_segments"]
_REGISTRY = "\nUNION ALL ".join(
    [
        _core("total_revenue", "REVENUE", "'₹' || format('{:,.2f}', total_revenue)", "total_revenue", "INR", "TOTAL", _KPI_SQL),
        _core("total_orders", "VOLUME", "format('{:,}', total_orders)", "total_orders", "COUNT", "TOTAL", _KPI_SQL),
        _core("active_customers", "CUSTOMER", "format('{:,}', total_customers)", "total_customers", "COUNT", "TOTAL", _KPI_SQL),
        _core("average_order_value", "EFFICIENCY", "'₹' || format('{:,.2f}', average_order_value)", "average_order_value", "INR", "TRANSACTION", _KPI_SQL),
        _core("quality_score", "QUALITY", "overall_score || '/100'", "overall_score", "SCORE", "DATASET", QUALITY_SQL["dq_profile"]),
        f"""SELECT 'rfm_rev_' || lower(code), 'SEGMENT', '₹' || format('{{:,.2f}}', total_revenue), total_revenue, 'INR', 'COHORT' FROM ({_SEG_SQL})""",
    ]
)
_RULES = ", ".join(f"('{r}', '{t}', '{m}', '{about or ''}', {least}, {str(a).upper()})" for r, t, m, about, least, a in insights.RULES)
_RANKED = f"""WITH rules(rule_key, theme, metric_name, about, least, is_association) AS (VALUES {_RULES})
SELECT rule_key, theme, metric_name, member, value, is_association, DENSE_RANK() OVER (ORDER BY abs(value) DESC) AS impact_rank
FROM rules JOIN ({_CATALOG}) m USING (metric_name) WHERE about = member AND abs(value) >= least"""

def _points(module: str, template: str, name: str, at: str, value: str, unit: str) -> str:
    frame, grain = TEMPLATE_SQL[template], f"'{metrics.GRAIN_OF[at]}'"
    if at == "date":  # by week or month where there are more days than points
        frame = f"""SELECT grain, CAST(CASE grain WHEN 'DAY' THEN d WHEN 'WEEK' THEN date_trunc('week', d) ELSE date_trunc('month', d) END AS DATE) AS date, SUM(revenue) AS revenue
  FROM (SELECT CAST(date AS DATE) AS d, CAST(revenue AS DECIMAL(38,10)) AS revenue, CASE WHEN COUNT(*) OVER () <= {metrics.POINTS} THEN 'DAY' WHEN COUNT(*) OVER () // 7 + 2 <= {metrics.POINTS} THEN 'WEEK' ELSE 'MONTH' END AS grain FROM ({frame})) GROUP BY 1, 2"""
        grain = "grain"
    return f"SELECT '{name}' AS metric_name, {grain} AS grain, ROW_NUMBER() OVER (ORDER BY {at}) AS position, CAST({at} AS VARCHAR) AS t, ROUND(CAST({value} AS DOUBLE), 5) AS v FROM ({frame})"


SQL = {
    "metric_catalog": _CATALOG,
    "metric_series": "\nUNION ALL\n".join(_points(*s) for s in metrics.SERIES),
    "metric_latest_by_key": "SELECT o_custkey AS metric_key, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS numeric_value FROM orders GROUP BY o_custkey",
    "metric_latest_50": "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "metric_evidence": _CODE + f"""SELECT 'total_revenue' AS metric_key, {_K.format('total_revenue')} AS raw_value
UNION ALL SELECT 'active_customers', CAST({_K.format('total_customers')} AS DOUBLE) UNION ALL SELECT 'average_order_value', {_K.format('average_order_value')}
UNION ALL SELECT 'high_value_revenue', {_HV}""",
    "metric_high_value_join": _CODE + f"SELECT {_HV} AS hv_revenue",
    "claims_in_documents": f"WITH {_claims('SELECT doc_id, text FROM documents')} SELECT * FROM claims",
    "claims_in_statements": using(CUSTOMERS, _claims(_STATEMENTS)) + "SELECT * FROM claims",
    "metric_registry": _REGISTRY,
    "insight_ranked": _RANKED,
    "number_pool": _POOL,
    "claims_matched": using(CUSTOMERS, _claims(_STATEMENTS), _MATCHED) + "SELECT * FROM matched",
    "claims_report_documents": f"""WITH {_claims('SELECT doc_id, text FROM documents')}, {_MATCHED}
SELECT doc_id, COUNT(token) AS total, COUNT(*) FILTER (WHERE is_verified) AS verified, COUNT(*) FILTER (WHERE NOT is_verified) AS unverified,
  COALESCE(string_agg(CASE WHEN NOT is_verified THEN token END, ' | ' ORDER BY token), '') AS flagged_tokens, COUNT(*) FILTER (WHERE NOT is_verified) = 0 AS is_fully_verified
FROM (SELECT doc_id FROM documents) LEFT JOIN matched USING (doc_id) GROUP BY doc_id""",
    "sql_windows": _adhoc(_WINDOWED.format("orders")),
    "sql_functions": _adhoc(_select(_FUNCTION_COLUMNS)),
    **{name: _adhoc(text) for name, text in ADHOC.items()},
}
