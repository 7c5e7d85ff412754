"""Star schema tables, checks and measures over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillview.operators import star
from tillview.plans.analytics_queries import FLAT
from tillview.plans.edge import plain
from tillview.plans.shared import relations
from tillview.plans.template_sql import CALENDAR, CUSTOMERS, PRODUCTS, RFM, SEGMENTS, using
from tillview.session import kept_for_inputs, tune
from tillview.sources.flat import flat

# The benchmark has no payment names; two of its five order priorities stand for digital ones.
DIGITAL = ("1-URGENT", "2-HIGH")


@kept_for_inputs
def _star(sf_dir: str):
    return star.build(relations(SparkSession.active(), sf_dir))


def model(spark, sf_dir):
    tune(spark)
    return _star(spark, sf_dir)


@kept_for_inputs
def _plain(sf_dir: str):
    return star.plain_star(flat(tune(SparkSession.active()), sf_dir), DIGITAL)


def plain_model(spark, sf_dir):
    return _plain(spark, sf_dir)


def _t(name):
    return lambda spark, d: plain(model(spark, d)[name])


def _p(name):
    return lambda spark, d: plain(plain_model(spark, d)[name])


def star_queries():
    return {
        "star_fact_sales": _t("fact_sales"),
        "star_dim_customer": _t("dim_customer"),
        "star_dim_product": _t("dim_product"),
        "star_dim_date": _t("dim_date"),
        "star_dim_location": _t("dim_location"),
        "star_dim_payment": _t("dim_payment"),
        "star_band_totals": lambda spark, d: plain(
            model(spark, d)["dim_discount_band"]
            .join(model(spark, d)["fact_sales"].groupBy("discount_band_key").agg(F.sum("revenue").alias("revenue")), "discount_band_key", "left")
        ),
        "star_reconcile": lambda spark, d: plain(star.reconcile(relations(spark, d), model(spark, d))),
        "star_orphans": lambda spark, d: plain(
            star.orphans(model(spark, d), "product_key", "dim_product").select("line_id", "product_key")
        ),
        "star_export_types": lambda spark, d: plain(
            star.export_types(model(spark, d)["fact_sales"].select("quantity", "revenue", "discount_pct"))
        ),
        "star_measures": lambda spark, d: plain(star.measures(model(spark, d))),
        "star_parity": lambda spark, d: plain(
            star.parity(relations(spark, d), model(spark, d)).select("measure", "kind", "ok")
        ),
        "star_segment_shares": lambda spark, d: plain(star.segment_shares(model(spark, d))),
        "star_product_shares": lambda spark, d: plain(
            star.member_shares(model(spark, d), "dim_product", "product_key", "product_natural_key")
        ),
        "star_category_shares": lambda spark, d: plain(
            star.member_shares(model(spark, d), "dim_product", "product_key", "category")
        ),
        "star_payment_shares": lambda spark, d: plain(
            star.member_shares(model(spark, d), "dim_payment", "payment_key", "payment_method")
        ),
        "star_country_shares": lambda spark, d: plain(
            star.member_shares(model(spark, d), "dim_location", "location_key", "country")
        ),
        "star_state_shares": lambda spark, d: plain(star.member_shares(model(spark, d), "dim_location", "location_key", "state")),
        "star_city_shares": lambda spark, d: plain(star.member_shares(model(spark, d), "dim_location", "location_key", "city")),
        "star_month_completeness": lambda spark, d: plain(star.month_completeness(model(spark, d))),
        "star_top_product_share": lambda spark, d: plain(star.top_product_share(model(spark, d))),
        "star_yearly_growth": lambda spark, d: plain(star.yearly_growth(model(spark, d), "revenue")),
        "plain_fact_sales": _p("fact_sales"),
        "plain_dim_date": _p("dim_date"),
        "plain_dim_customer": _p("dim_customer"),
        "plain_dim_product": _p("dim_product"),
        "plain_dim_payment": _p("dim_payment"),
        "plain_dim_location": _p("dim_location"),
        "plain_band_totals": lambda spark, d: plain(
            plain_model(spark, d)["fact_sales"]
            .groupBy(star.band_of(F.col("discount_pct")).alias("band_id"))
            .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("total_amount").cast("decimal(28,2)")).alias("revenue"))
            .join(plain_model(spark, d)["dim_discount_band"], "band_id", "right")
        ),
        "plain_measures": lambda spark, d: plain(star.plain_measures(plain_model(spark, d))),
    }


_DIMS = """dc AS (SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key, * FROM customers),
dp AS (SELECT ROW_NUMBER() OVER (ORDER BY product_key, category) AS k, product_key AS nk, product_name, category FROM products),
dl AS (SELECT ROW_NUMBER() OVER (ORDER BY country, state, city) AS location_key, country, state, city FROM (SELECT DISTINCT country, state, city FROM transactions)),
dm AS (SELECT ROW_NUMBER() OVER (ORDER BY payment_method) AS payment_key, payment_method FROM (SELECT DISTINCT payment_method FROM transactions))"""
_FACT = f"""{_DIMS}, sized AS (SELECT *, COUNT(*) OVER (PARTITION BY transaction_id) AS order_line_count FROM transactions),
fact AS (SELECT ROW_NUMBER() OVER (ORDER BY s.transaction_id, dp.k, s.quantity, s.revenue, s.discount) AS line_id, s.transaction_id,
  dp.k AS product_key, CAST(s.quantity AS DOUBLE) AS quantity, CAST(s.revenue AS DOUBLE) AS revenue, CAST(s.discount AS DOUBLE) AS discount_pct,
  s.transaction_id IS NOT NULL AS has_transaction_id, s.order_line_count,
  CASE WHEN s.order_line_count >= 10 THEN '10+' ELSE CAST(s.order_line_count AS VARCHAR) END AS order_size_bucket,
  dc.customer_key, s.customer_id IS NOT NULL AS has_customer, dl.location_key, dm.payment_key,
  CAST(strftime(s.purchase_date, '%Y%m%d') AS BIGINT) AS date_key,
  CAST(CASE WHEN s.discount = 0 THEN 1 WHEN s.discount <= 10 THEN 2 WHEN s.discount <= 20 THEN 3 WHEN s.discount <= 30 THEN 4 ELSE 5 END AS BIGINT) AS discount_band_key
FROM sized s JOIN dc USING (customer_id) JOIN dp ON dp.nk = s.product_id JOIN dl USING (country, state, city) JOIN dm USING (payment_method))"""
_S = using(CUSTOMERS, PRODUCTS, _FACT)
_PLAIN = f"""WITH {FLAT}, numbered AS (SELECT ROW_NUMBER() OVER (ORDER BY order_id, order_date, customer_id, product_id, product_name, category,
  unit_price, quantity, discount_pct, total_amount, payment_method, city, region, customer_rating NULLS FIRST) AS sales_key, * FROM flat)
"""
_AMOUNT = "CAST(ROUND(CAST(total_amount AS DOUBLE), 2) AS DECIMAL(28,2))"


def _shares(label: str, column: str) -> str:
    return using() + f"""SELECT '{label}' AS "by", CAST({column} AS VARCHAR) AS member, CAST(SUM(revenue) AS DOUBLE) AS revenue,
  CAST(SUM(revenue) AS DOUBLE) / (SELECT CAST(SUM(revenue) AS DOUBLE) FROM transactions) AS share FROM transactions GROUP BY {column}"""


_MONTHS = """m AS (SELECT c.month_start, COALESCE(SUM(t.revenue), 0) AS revenue, COUNT(DISTINCT t.transaction_id) AS orders
  FROM calendar c LEFT JOIN transactions t ON t.purchase_date = c.date WHERE c.month_is_complete GROUP BY c.month_start),
latest AS (SELECT MAX(month_start) AS l FROM m),
now AS (SELECT m.* FROM m, latest WHERE month_start = l), prv AS (SELECT m.* FROM m, latest WHERE month_start = l - INTERVAL 1 MONTH)"""
_ACTIVE = """(SELECT COUNT(DISTINCT t.customer_id) FROM transactions t JOIN customers USING (customer_id), latest
  WHERE t.purchase_date BETWEEN l AND last_day(l) AND first_purchase_date {} l)"""
_D = "CAST({} AS DOUBLE)"
_MEASURES = {
    "Total Revenue": "(SELECT CAST(SUM(revenue) AS DOUBLE) FROM transactions)",
    "Total Orders": "(SELECT CAST(COUNT(DISTINCT transaction_id) AS DOUBLE) FROM transactions)",
    "Total Quantity": "(SELECT CAST(SUM(quantity) AS DOUBLE) FROM transactions)",
    "Total Customers": "(SELECT CAST(COUNT(DISTINCT customer_id) AS DOUBLE) FROM transactions)",
    "Average Order Value": "(SELECT CAST(SUM(revenue) AS DOUBLE) / COUNT(DISTINCT transaction_id) FROM transactions)",
    "Revenue per Customer": "(SELECT CAST(SUM(revenue) AS DOUBLE) / COUNT(DISTINCT customer_id) FROM transactions)",
    "Average Lines per Order": "(SELECT CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT transaction_id) FROM transactions)",
    "Average Basket Quantity": "(SELECT CAST(SUM(quantity) AS DOUBLE) / COUNT(DISTINCT transaction_id) FROM transactions)",
    "Repeat Customer Rate": "(SELECT CAST(COUNT(*) FILTER (WHERE order_count >= 2) AS DOUBLE) / COUNT(*) FROM customers)",
    "Orders per Customer": "(SELECT CAST(SUM(order_count) AS DOUBLE) / COUNT(*) FROM customers)",
    "Revenue Growth": "(SELECT CAST(now.revenue - prv.revenue AS DOUBLE) / CAST(prv.revenue AS DOUBLE) FROM now, prv)",
    "Order Growth": "(SELECT CAST(now.orders - prv.orders AS DOUBLE) / prv.orders FROM now, prv)",
    "New Customers (Headline)": f"CAST({_ACTIVE.format('>=')} AS DOUBLE)",
    "Returning Customers (Headline)": f"CAST({_ACTIVE.format('<')} AS DOUBLE)",
}
_CHECKS = ["row_count", "revenue", "not_a_number"]
for _k, _ in star.RELATIONSHIPS:
    _CHECKS += [f"orphan_{_k}", f"repeated_{_k}"]
_CHECKS += ["segments_cover_customers", "category_revenue", "contiguous_dates"]

SQL = {
    "star_fact_sales": _S + "SELECT * FROM fact",
    "star_dim_customer": using(CUSTOMERS, PRODUCTS, RFM, SEGMENTS, _DIMS) + """SELECT dc.customer_key, dc.customer_id, CAST(first_purchase_date AS VARCHAR) AS first_purchase_date,
  CAST(last_purchase_date AS VARCHAR) AS last_purchase_date, order_count, CAST(total_revenue AS DOUBLE) AS lifetime_revenue,
  CASE WHEN order_count >= 5 THEN '5+' ELSE CAST(order_count AS VARCHAR) END AS purchase_frequency_bucket, LEAST(order_count, 5) AS purchase_frequency_sort,
  recency_days AS rfm_recency_days, frequency AS rfm_frequency, CAST(monetary AS DOUBLE) AS rfm_monetary, r_score, f_score, m_score, rfm_score, segment AS segment_code,
  CASE segment WHEN 'HIGH_VALUE' THEN 'High Value' WHEN 'REGULAR' THEN 'Regular' WHEN 'OCCASIONAL' THEN 'Occasional' ELSE 'At Risk' END AS segment,
  CAST(CASE segment WHEN 'HIGH_VALUE' THEN 1 WHEN 'REGULAR' THEN 2 WHEN 'OCCASIONAL' THEN 3 ELSE 4 END AS BIGINT) AS segment_sort
FROM dc JOIN customer_rfm USING (customer_id) JOIN customer_segments USING (customer_id)""",
    "star_dim_product": using(CUSTOMERS, PRODUCTS, _DIMS) + """SELECT k AS product_key, nk AS product_natural_key, nk AS product_id, product_name, category, FALSE AS is_unknown FROM dp
UNION ALL SELECT -1, NULL, NULL, 'Unknown', 'Unknown', TRUE""",
    "star_dim_date": using(CALENDAR) + """, span AS (SELECT CAST(unnest(generate_series(make_date(year(lo), 1, 1), make_date(year(hi), 12, 31), INTERVAL 1 DAY)) AS DATE) AS d, lo, hi FROM rng)
SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, CAST(d AS VARCHAR) AS date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, day(d) AS day,
  'Q' || quarter(d) || ' ' || year(d) AS quarter_label, strftime(d, '%B') AS month_name, strftime(d, '%b') AS month_short, strftime(d, '%Y-%m') AS year_month,
  CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month_start, CAST(last_day(d) AS VARCHAR) AS month_end, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS week_start,
  weekofyear(d) AS iso_week, isodow(d) AS day_of_week, strftime(d, '%A') AS day_name, isodow(d) >= 6 AS is_weekend, year(d) * 100 + month(d) AS month_sort,
  d BETWEEN lo AND hi AS in_data_range, lo <= date_trunc('month', d) AND hi >= last_day(d) AS month_is_complete,
  lo <= date_trunc('week', d) AND hi >= CAST(date_trunc('week', d) AS DATE) + 6 AS week_is_complete,
  lo <= make_date(year(d), 1, 1) AND hi >= make_date(year(d), 12, 31) AS year_is_complete FROM span""",
    "star_dim_location": using(CUSTOMERS, PRODUCTS, _DIMS) + """SELECT location_key, country, state, city, city AS location_label, FALSE AS is_unknown FROM dl
UNION ALL SELECT -1, 'Unknown', 'Unknown', 'Unknown', 'Unknown', TRUE""",
    "star_dim_payment": using(CUSTOMERS, PRODUCTS, _DIMS) + "SELECT *, FALSE AS is_unknown FROM dm UNION ALL SELECT -1, 'Unknown', TRUE",
    "star_band_totals": using() + """SELECT CAST(k AS BIGINT) AS discount_band_key, b AS discount_band, CAST(o AS BIGINT) AS band_order, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM (VALUES (1, '0', 1), (2, '(0,10]', 2), (3, '(10,20]', 3), (4, '(20,30]', 4), (5, '>30', 5), (-1, 'Unknown', 6)) AS v(k, b, o)
LEFT JOIN transactions ON k = CASE WHEN discount IS NULL THEN -1 WHEN discount = 0 THEN 1 WHEN discount <= 10 THEN 2 WHEN discount <= 20 THEN 3 WHEN discount <= 30 THEN 4 ELSE 5 END
GROUP BY ALL""",
    "star_reconcile": f"""SELECT c AS "check", CAST(0 AS DOUBLE) AS off, TRUE AS ok FROM (VALUES {', '.join(f"('{c}')" for c in _CHECKS)}) AS v(c)""",
    "star_orphans": "SELECT CAST(1 AS BIGINT) AS line_id, CAST(1 AS BIGINT) AS product_key WHERE FALSE",
    "star_export_types": using() + ", figures AS (" + " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", CAST(MAX(length(regexp_replace(split_part(CAST({c} AS VARCHAR), '.', 2), '0+$', ''))) AS BIGINT) AS max_scale, MAX(abs(CAST({c} AS DOUBLE))) AS max_abs FROM transactions"""
        for name, c in (("quantity", "quantity"), ("revenue", "revenue"), ("discount_pct", "discount"))
    ) + ") SELECT *, CASE WHEN max_scale <= 4 AND max_abs < 1e15 THEN 'FIXED_DECIMAL' ELSE 'DECIMAL' END AS export_type FROM figures",
    "star_measures": using(CALENDAR, CUSTOMERS, _MONTHS) + " UNION ALL ".join(f"SELECT '{n}' AS measure, {e} AS value" for n, e in _MEASURES.items()),
    "star_parity": f"SELECT measure, kind, TRUE AS ok FROM (VALUES {', '.join(f'''('{m}', '{k}')''' for m, _, _, k in star.PARITY)}) AS v(measure, kind)",
    "star_segment_shares": using(CUSTOMERS, RFM, SEGMENTS) + """SELECT CASE s.segment WHEN 'HIGH_VALUE' THEN 'High Value' WHEN 'REGULAR' THEN 'Regular' WHEN 'OCCASIONAL' THEN 'Occasional' ELSE 'At Risk' END AS segment,
  COUNT(*) AS customers, CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS customer_share, CAST(SUM(monetary) AS DOUBLE) AS revenue,
  CAST(SUM(monetary) AS DOUBLE) / CAST(SUM(SUM(monetary)) OVER () AS DOUBLE) AS revenue_share, CAST(SUM(recency_days) AS DOUBLE) / COUNT(*) AS avg_recency_days,
  CAST(SUM(frequency) AS DOUBLE) / COUNT(*) AS avg_frequency, CAST(SUM(monetary) AS DOUBLE) / COUNT(*) AS avg_monetary
FROM customer_segments s JOIN customer_rfm USING (customer_id) GROUP BY s.segment""",
    "star_product_shares": _shares("product_natural_key", "product_id"),
    "star_category_shares": _shares("category", "category"),
    "star_payment_shares": _shares("payment_method", "payment_method"),
    "star_country_shares": _shares("country", "country"),
    "star_state_shares": _shares("state", "state"),
    "star_city_shares": _shares("city", "city"),
    "star_month_completeness": using(CALENDAR) + """SELECT CAST(SUM(revenue) FILTER (WHERE month_is_complete) AS DOUBLE) AS revenue_complete_months,
  CAST(SUM(revenue) FILTER (WHERE NOT month_is_complete) AS DOUBLE) AS revenue_partial_months FROM transactions JOIN calendar ON date = purchase_date""",
    "star_top_product_share": using(PRODUCTS) + """SELECT CAST((SELECT SUM(total_revenue) FROM (SELECT total_revenue FROM products ORDER BY total_revenue DESC, product_key LIMIT 10)) AS DOUBLE)
  / CAST(SUM(total_revenue) AS DOUBLE) AS top_product_share FROM products""",
    "star_yearly_growth": using() + """, y AS (SELECT year(purchase_date) AS year, SUM(revenue) AS r FROM transactions GROUP BY 1)
SELECT a.year, CAST(a.r AS DOUBLE) AS revenue, CAST(b.r AS DOUBLE) AS prior_revenue, COALESCE(CAST(a.r - b.r AS DOUBLE) / CAST(b.r AS DOUBLE), 0) AS yoy
FROM y a LEFT JOIN y b ON b.year = a.year - 1""",
    "plain_fact_sales": _PLAIN + """SELECT sales_key, CAST(order_id AS VARCHAR) AS order_id, CAST(strftime(order_date, '%Y%m%d') AS BIGINT) AS date_key, customer_id, product_id,
  payment_method, city, quantity, ROUND(unit_price, 2) AS unit_price, ROUND(discount_pct, 4) AS discount_pct, ROUND(CAST(total_amount AS DOUBLE), 2) AS total_amount FROM numbered""",
    "plain_dim_date": _PLAIN + """SELECT DISTINCT CAST(strftime(order_date, '%Y%m%d') AS BIGINT) AS date_key, strftime(order_date, '%Y-%m-%d') AS full_date, year(order_date) AS year,
  'Q' || quarter(order_date) AS quarter, month(order_date) AS month_num, strftime(order_date, '%B') AS month_name, day(order_date) AS day_of_month, strftime(order_date, '%A') AS day_name FROM numbered""",
    "plain_dim_customer": _PLAIN + "SELECT customer_id, arg_min(city, sales_key) AS primary_city, arg_min(region, sales_key) AS region FROM numbered GROUP BY customer_id",
    "plain_dim_product": _PLAIN + "SELECT product_id, arg_min(product_name, sales_key) AS product_name, arg_min(category, sales_key) AS category FROM numbered GROUP BY product_id",
    "plain_dim_payment": _PLAIN + "SELECT DISTINCT payment_method, payment_method IN ('1-URGENT', '2-HIGH') AS is_digital FROM numbered",
    "plain_dim_location": _PLAIN + "SELECT DISTINCT city, region, 'India' AS country FROM numbered",
    "plain_band_totals": _PLAIN + f"""SELECT CAST(band_id AS BIGINT) AS band_id, band_name, CAST(min_rate AS DOUBLE) AS min_rate, CAST(max_rate AS DOUBLE) AS max_rate,
  NULLIF(COUNT(sales_key), 0) AS lines, CAST(SUM({_AMOUNT}) AS DOUBLE) AS revenue
FROM (VALUES (1, 'No Discount (0%)', 0.00, 0.00), (2, 'Low (1% - 10%)', 0.01, 0.10), (3, 'Medium (11% - 20%)', 0.11, 0.20), (4, 'High (> 20%)', 0.21, 1.00)) AS v(band_id, band_name, min_rate, max_rate)
LEFT JOIN numbered ON band_id = CASE WHEN ROUND(discount_pct, 4) <= 0 THEN 1 WHEN ROUND(discount_pct, 4) <= 0.1::DOUBLE THEN 2 WHEN ROUND(discount_pct, 4) <= 0.2::DOUBLE THEN 3 ELSE 4 END GROUP BY ALL""",
    "plain_measures": _PLAIN + f""", t AS (SELECT CAST(SUM({_AMOUNT}) AS DOUBLE) AS r, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS o, CAST(SUM(quantity) AS DOUBLE) AS u,
  CAST(COUNT(DISTINCT customer_id) AS DOUBLE) AS c, CAST(SUM(CAST(quantity * unit_price AS DECIMAL(28,4)) - {_AMOUNT}) AS DOUBLE) AS drag,
  CAST(SUM({_AMOUNT}) FILTER (WHERE payment_method IN ('1-URGENT', '2-HIGH')) AS DOUBLE) AS dig FROM numbered),
per AS (SELECT COUNT(DISTINCT order_id) AS n FROM numbered GROUP BY customer_id)
SELECT 'Total Revenue' AS measure, r AS value FROM t UNION ALL SELECT 'Total Orders', o FROM t UNION ALL SELECT 'Total Units Sold', u FROM t
UNION ALL SELECT 'Active Customers', c FROM t UNION ALL SELECT 'Average Order Value', r / o FROM t UNION ALL SELECT 'Customer Lifetime Value', r / c FROM t
UNION ALL SELECT 'Discount Dollar Drag', drag FROM t UNION ALL SELECT 'Digital Payment Ratio', dig / r FROM t
UNION ALL SELECT 'Repeat Purchase Rate', CAST(COUNT(*) FILTER (WHERE n > 1) AS DOUBLE) / COUNT(*) FROM per""",
}
