"""Slices, exploratory statistics, code-rule scores and product shares over the benchmark tables."""

from __future__ import annotations


from tillview.operators import catalog, eda, rfm, slices
from tillview.plans.edge import plain
from tillview.session import tune
from tillview.sources.flat import flat, flat_source

_SLICE = ("order_id", "customer_id", "order_date", "total_amount", "category")
NUMBERS = ("unit_price", "quantity", "discount_pct", "total_amount", "customer_rating")


def _slice(preset, build, *args, start=None, end=None, columns=_SLICE):
    def run(spark, sf_dir):
        df = flat(tune(spark), sf_dir, *columns)
        return plain(build(slices.time_slice(df, preset, start, end), *args))

    return run


def _flat(build, *columns):
    def run(spark, sf_dir):
        return plain(build(flat(tune(spark), sf_dir, *columns)))

    return run


def _scores(build):
    def run(spark, sf_dir):
        df = flat(tune(spark), sf_dir, "order_id", "customer_id", "order_date", "total_amount")
        return plain(build(spark, rfm.score(rfm.flat_base(df), rules="code")))

    return run


def _products(build):
    return lambda spark, sf_dir: plain(build(catalog.product_table(flat_source(tune(spark), sf_dir))))


_NAMED = ("product_name", "category", "payment_method", "city", "region", "customer_rating")
_KPI = ("order_id", "customer_id", "order_date", "total_amount")
_TREND = ("order_id", "order_date", "total_amount")
_SPLIT = ("order_id", "order_date", "total_amount", "category")


def analytics_queries():
    return {
        "kpi_block": _slice("all", slices.key_figures, columns=_KPI),
        "kpi_last_30_days": _slice("last_30_days", slices.key_figures, columns=_KPI),
        "kpi_q1": _slice("q1", slices.key_figures, columns=_KPI),
        "kpi_q4": _slice("q4", slices.key_figures, columns=_KPI),
        "kpi_custom": _slice("custom", slices.key_figures, start="1996-02-10", end="1998-11-30", columns=_KPI),
        "trend_daily": _slice("all", slices.trend, "daily", columns=_TREND),
        "trend_daily_q2": _slice("q2", slices.trend, "daily", columns=_TREND),
        "trend_weekly": _slice("all", slices.trend, "weekly", columns=_TREND),
        "trend_monthly": _slice("all", slices.trend, "monthly", columns=_TREND),
        "category_split": _slice("all", slices.category_split, columns=_SPLIT),
        "category_split_q3": _slice("q3", slices.category_split, columns=_SPLIT),
        "breakdown_category": _flat(lambda df: eda.breakdown(df, "category"), "category", "total_amount"),
        "breakdown_payment": _flat(lambda df: eda.breakdown(df, "payment_method"), "payment_method", "total_amount"),
        "breakdown_region": _flat(lambda df: eda.breakdown(df, "region"), "region", "total_amount"),
        "monthly_revenue": _flat(eda.monthly_revenue, "order_id", "order_date", "total_amount"),
        "product_table": _products(lambda p: p),
        "pareto_summary": _products(catalog.pareto_summary),
        "payment_table": _flat(catalog.payment_table, "payment_method", "total_amount"),
        "rfm_code_customers": _scores(lambda spark, s: rfm.customer_table(s)),
        "rfm_code_segments": _scores(rfm.segment_table),
        "rfm_code_grid": _scores(rfm.grid),
        "rfm_code_at_risk_top": _scores(lambda spark, s: rfm.filter_segment(rfm.customer_table(s), "at risk")),
        "eda_summary": _flat(eda.numeric_summary, *NUMBERS),
        "eda_histogram": _flat(eda.histogram, *eda.HISTOGRAM_COLUMNS),
        "eda_pearson": _flat(eda.pearson_matrix, *NUMBERS),
        "eda_spearman": _flat(lambda df: eda.spearman_matrix(df, NUMBERS), *NUMBERS),
        "eda_top_values": _flat(lambda df: eda.top_values(df, list(_NAMED)), *_NAMED),
        "eda_box_plot": _flat(lambda df: eda.box_plot(df, NUMBERS), *NUMBERS),
        "eda_scatter_sample": _flat(
            lambda df: eda.scatter_sample(df, "unit_price", "total_amount", ["order_id", "product_id"]),
            "order_id",
            "product_id",
            "unit_price",
            "total_amount",
        ),
    }


FLAT = """flat AS (
  SELECT l_orderkey AS order_id, o_orderdate AS order_date, o_custkey AS customer_id, l_partkey AS product_id,
         p_name AS product_name, p_type AS category, ROUND(l_extendedprice / l_quantity, 2) AS unit_price,
         CAST(l_quantity AS BIGINT) AS quantity, l_discount AS discount_pct,
         CAST(CAST(l_extendedprice AS DECIMAL(13,2)) * (1 - CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(18,4)) AS total_amount,
         o_orderpriority AS payment_method, n_name AS city, r_name AS region,
         CASE WHEN l_returnflag <> 'R' THEN CAST(LEAST(5, FLOOR(ROUND(l_tax * 100) / 2) + 1) AS BIGINT) END AS customer_rating
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey)"""
_W = "WITH " + FLAT
_DAY = "CAST(order_date AS DATE)"
_FIGURES = f"""SELECT COALESCE(ROUND(CAST(SUM(total_amount) AS DOUBLE), 2), 0.0) AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
  COUNT(DISTINCT customer_id) AS total_customers,
  COALESCE(ROUND(CAST(SUM(total_amount) AS DOUBLE) / NULLIF(COUNT(DISTINCT order_id), 0), 2), 0.0) AS average_order_value,
  COUNT(*) AS total_rows FROM flat"""


def _trend(label: str, where: str = "") -> str:
    return f"""{_W} SELECT {label} AS period, ROUND(CAST(SUM(total_amount) AS DOUBLE), 2) AS revenue,
  COUNT(DISTINCT order_id) AS orders FROM flat {where} GROUP BY 1"""


def _break(column: str) -> str:
    return f"""{_W} SELECT '{column}' AS "column", {column} AS value, COUNT(*) AS count,
  ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM flat) * 100, 2) AS percentage,
  ROUND(CAST(SUM(total_amount) AS DOUBLE), 2) AS revenue,
  ROUND(CAST(SUM(total_amount) AS DOUBLE) / (SELECT CAST(SUM(total_amount) AS DOUBLE) FROM flat) * 100, 2) AS revenue_pct
FROM flat WHERE {column} IS NOT NULL GROUP BY {column}"""


_PRODUCT = f"""{_W}, sums AS (SELECT product_id AS sku, product_name, category, SUM(total_amount) AS r, SUM(quantity) AS units
  FROM flat GROUP BY ALL),
pct AS (SELECT *, CAST(ROUND(CAST(r AS DOUBLE) / (SELECT CAST(SUM(total_amount) AS DOUBLE) FROM flat) * 100, 2) AS DECIMAL(9,2)) AS p FROM sums),
cum AS (SELECT *, ROW_NUMBER() OVER (ORDER BY r DESC, sku, product_name, category) AS rank FROM pct),
run AS (SELECT *, SUM(p) OVER (ORDER BY rank) AS c FROM cum)
"""

_CODE = f"""{_W}, base AS (SELECT customer_id, MAX(order_date) AS last, COUNT(DISTINCT order_id) AS frequency, SUM(total_amount) AS monetary
  FROM flat WHERE customer_id IS NOT NULL GROUP BY customer_id),
days AS (SELECT *, CAST(FLOOR((epoch_us((SELECT MAX(order_date) FROM flat)) + 86400000000 - epoch_us(last)) / 86400000000.0) AS BIGINT) AS recency_days,
  COUNT(*) OVER () AS n FROM base),
placed AS (SELECT *, ROW_NUMBER() OVER (ORDER BY recency_days DESC, customer_id) AS rr,
  ROW_NUMBER() OVER (ORDER BY frequency, customer_id) AS fr, ROW_NUMBER() OVER (ORDER BY monetary, customer_id) AS mr FROM days),
scored AS (SELECT *, CAST(GREATEST(1, CEIL(5.0 * (rr - 1) / (n - 1))) AS BIGINT) AS r_score,
  CAST(GREATEST(1, CEIL(5.0 * (fr - 1) / (n - 1))) AS BIGINT) AS f_score,
  CAST(GREATEST(1, CEIL(5.0 * (mr - 1) / (n - 1))) AS BIGINT) AS m_score FROM placed),
seg AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'High Value' WHEN r_score <= 2 THEN 'At Risk'
  WHEN r_score >= 4 AND f_score <= 2 THEN 'Occasional' ELSE 'Regular' END AS segment FROM scored)
"""
_CODE_CUSTOMERS = """SELECT customer_id, recency_days, frequency AS frequency_orders, ROUND(CAST(monetary AS DOUBLE), 2) AS total_spend,
  ROUND(CAST(monetary AS DOUBLE) / GREATEST(1, frequency), 2) AS aov, r_score, f_score, m_score, segment FROM seg"""


def _summary(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({x}), 2) AS mean, ROUND(stddev_samp({x}), 2) AS std,
  ROUND(MIN({x}), 2) AS min, ROUND(quantile_cont({x}, 0.25), 2) AS q25, ROUND(median({x}), 2) AS median,
  ROUND(quantile_cont({x}, 0.75), 2) AS q75, ROUND(MAX({x}), 2) AS max, ROUND(skewness({x}), 2) AS skewness FROM flat"""


def _histogram(c: str) -> str:
    return f"""SELECT '{c}' AS "column", k + 1 AS bin, ROUND(lo + w * k, 2) AS bin_start,
  ROUND(CASE WHEN k = 9 THEN hi ELSE lo + w * (k + 1) END, 2) AS bin_end,
  (SELECT COUNT(*) FROM flat WHERE CAST({c} AS DOUBLE) >= lo + w * k
     AND (CASE WHEN k = 9 THEN CAST({c} AS DOUBLE) <= hi ELSE CAST({c} AS DOUBLE) < lo + w * (k + 1) END)) AS count
FROM (SELECT MIN(CAST({c} AS DOUBLE)) AS lo, MAX(CAST({c} AS DOUBLE)) AS hi,
             (MAX(CAST({c} AS DOUBLE)) - MIN(CAST({c} AS DOUBLE))) / 10 AS w FROM flat), range(10) AS r(k)"""


def _corr(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS x, '{b}' AS y, ROUND(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 3) AS correlation FROM flat"""


def _spearman(a: str, b: str) -> str:
    mid = "RANK() OVER (ORDER BY {0}) + (COUNT(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return f"""SELECT '{a}' AS x, '{b}' AS y, ROUND(corr(rx, ry), 6) AS correlation FROM (
  SELECT {mid.format(a)} AS rx, {mid.format(b)} AS ry FROM flat WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


def _top(c: str) -> str:
    return f"""SELECT '{c}' AS "column", ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR)) AS position,
  CAST({c} AS VARCHAR) AS value, COUNT(*) AS count,
  ROUND(CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) * 100, 2) AS percentage
FROM flat WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY position <= 20"""


def _box(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", q1, median, q3, lower_fence, upper_fence,
  MIN(CASE WHEN {x} BETWEEN lower_fence AND upper_fence THEN {x} END) AS whisker_low,
  MAX(CASE WHEN {x} BETWEEN lower_fence AND upper_fence THEN {x} END) AS whisker_high,
  COUNT(*) FILTER (WHERE {x} < lower_fence OR {x} > upper_fence) AS outliers
FROM flat, (SELECT q1, median, q3, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM (
  SELECT quantile_cont({x}, 0.25) AS q1, median({x}) AS median, quantile_cont({x}, 0.75) AS q3 FROM flat)) GROUP BY ALL"""


def _all(parts) -> str:
    return f"{_W} " + "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


SQL = {
    "kpi_block": f"{_W} {_FIGURES}",
    "kpi_last_30_days": f"{_W} {_FIGURES} WHERE {_DAY} >= (SELECT MAX({_DAY}) - INTERVAL 30 DAY FROM flat)",
    "kpi_q1": f"{_W} {_FIGURES} WHERE month(order_date) IN (1, 2, 3)",
    "kpi_q4": f"{_W} {_FIGURES} WHERE month(order_date) IN (10, 11, 12)",
    "kpi_custom": f"{_W} {_FIGURES} WHERE {_DAY} BETWEEN DATE '1996-02-10' AND DATE '1998-11-30'",
    "trend_daily": _trend(f"strftime({_DAY}, '%Y-%m-%d')"),
    "trend_daily_q2": _trend(f"strftime({_DAY}, '%Y-%m-%d')", "WHERE month(order_date) IN (4, 5, 6)"),
    "trend_weekly": _trend(f"strftime({_DAY}, '%Y-W%W')"),
    "trend_monthly": _trend(f"strftime({_DAY}, '%Y-%m')"),
    "category_split": f"""{_W} SELECT category, ROUND(CAST(SUM(total_amount) AS DOUBLE), 2) AS revenue, COUNT(DISTINCT order_id) AS orders,
  ROUND(CAST(SUM(total_amount) AS DOUBLE) * 100 / (SELECT CAST(SUM(total_amount) AS DOUBLE) FROM flat), 1) AS pct FROM flat GROUP BY category""",
    "category_split_q3": f"""{_W} SELECT category, ROUND(CAST(SUM(total_amount) AS DOUBLE), 2) AS revenue, COUNT(DISTINCT order_id) AS orders,
  ROUND(CAST(SUM(total_amount) AS DOUBLE) * 100 / (SELECT CAST(SUM(total_amount) AS DOUBLE) FROM flat WHERE month(order_date) IN (7, 8, 9)), 1) AS pct
FROM flat WHERE month(order_date) IN (7, 8, 9) GROUP BY category""",
    "breakdown_category": _break("category"),
    "breakdown_payment": _break("payment_method"),
    "breakdown_region": _break("region"),
    "monthly_revenue": f"""{_W} SELECT strftime(order_date, '%Y-%m') AS month, ROUND(CAST(SUM(total_amount) AS DOUBLE), 2) AS revenue,
  COUNT(DISTINCT order_id) AS orders, ROUND(CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT order_id), 2) AS aov FROM flat GROUP BY 1""",
    "product_table": _PRODUCT + """SELECT rank, sku, product_name, category, CAST(units AS BIGINT) AS units_sold,
  ROUND(CAST(r AS DOUBLE), 2) AS revenue, CAST(p AS DOUBLE) AS revenue_pct, CAST(c AS DOUBLE) AS cumulative_revenue_pct,
  c <= 80 AS is_pareto_top_80 FROM run""",
    "pareto_summary": _PRODUCT + """SELECT COUNT(*) FILTER (WHERE c <= 80) AS top_80_skus, COUNT(*) AS total_skus,
  ROUND(CAST(COUNT(*) FILTER (WHERE c <= 80) AS DOUBLE) / COUNT(*) * 100, 1) AS sku_pct FROM run""",
    "payment_table": f"""{_W} SELECT payment_method, COUNT(*) AS transaction_count, ROUND(CAST(SUM(total_amount) AS DOUBLE), 2) AS total_revenue,
  ROUND(CAST(SUM(total_amount) AS DOUBLE) / (SELECT CAST(SUM(total_amount) AS DOUBLE) FROM flat) * 100, 2) AS revenue_pct
FROM flat WHERE payment_method IS NOT NULL GROUP BY payment_method""",
    "rfm_code_customers": _CODE + _CODE_CUSTOMERS,
    "rfm_code_at_risk_top": _CODE + f"SELECT * FROM ({_CODE_CUSTOMERS}) WHERE segment = 'At Risk' ORDER BY total_spend DESC, customer_id LIMIT 100",
    "rfm_code_segments": _CODE + """, names(segment, code) AS (VALUES ('High Value', 'HV'), ('Regular', 'REG'), ('Occasional', 'OCC'), ('At Risk', 'AR')),
tot AS (SELECT COUNT(*) AS n, CAST(SUM(monetary) AS DOUBLE) AS r FROM seg)
SELECT segment, code, COUNT(customer_id) AS customer_count, ROUND(CAST(COUNT(customer_id) AS DOUBLE) / ANY_VALUE(n) * 100, 2) AS customer_pct,
  ROUND(COALESCE(CAST(SUM(monetary) AS DOUBLE), 0), 2) AS total_revenue,
  COALESCE(ROUND(CAST(SUM(monetary) AS DOUBLE) / ANY_VALUE(r) * 100, 2), 0) AS revenue_pct,
  COALESCE(ROUND(CAST(SUM(monetary) AS DOUBLE) / NULLIF(CAST(SUM(frequency) AS DOUBLE), 0), 2), 0) AS avg_order_value,
  COALESCE(ROUND(CAST(SUM(recency_days) AS DOUBLE) / NULLIF(COUNT(customer_id), 0), 1), 0) AS avg_recency_days,
  COALESCE(ROUND(CAST(SUM(frequency) AS DOUBLE) / NULLIF(COUNT(customer_id), 0), 1), 0) AS avg_frequency
FROM (SELECT names.segment, code, customer_id, monetary, frequency, recency_days, tot.n, tot.r
      FROM names LEFT JOIN seg ON seg.segment = names.segment, tot) GROUP BY segment, code""",
    "rfm_code_grid": _CODE + """SELECT r, f, COUNT(customer_id) AS count, ROUND(COALESCE(CAST(SUM(monetary) AS DOUBLE), 0), 2) AS revenue,
  ROUND(CAST(COUNT(customer_id) AS DOUBLE) / (SELECT COUNT(*) FROM seg) * 100, 2) AS percentage
FROM range(1, 6) AS a(r), range(1, 6) AS b(f) LEFT JOIN seg ON r_score = r AND f_score = f GROUP BY r, f""",
    "eda_summary": _all(_summary(c) for c in NUMBERS),
    "eda_histogram": _all(_histogram(c) for c in eda.HISTOGRAM_COLUMNS),
    "eda_pearson": _all(_corr(a, b) for a in NUMBERS for b in NUMBERS),
    "eda_spearman": _all(_spearman(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]),
    "eda_top_values": _all(_top(c) for c in _NAMED),
    "eda_box_plot": _all(_box(c) for c in NUMBERS),
}
