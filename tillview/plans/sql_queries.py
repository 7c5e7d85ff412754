"""Ad-hoc SQL over the relations: the same text runs here, through the query door, and in the twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillview.operators import adhoc, intervals
from tillview.plans.edge import plain
from tillview.plans.shared import relations
from tillview.plans.template_sql import CUSTOMERS, ORDERS, PRODUCTS, using

# A query over ``transactions``, ``orders`` and ``customers``, one for each group of functions; every name is the surface's own.
TEXTS = {
    "sql_aggregates": """SELECT country, COUNT(*) AS n, ROUND(quantile_cont(CAST(quantity AS DOUBLE), 0.3), 6) AS q_cont, CAST(quantile_disc(CAST(quantity AS DOUBLE), 0.7) AS DOUBLE) AS q_disc,
  arg_min(transaction_id, (revenue, transaction_id)) AS cheapest, arg_max(transaction_id, (revenue, transaction_id)) FILTER (WHERE discount > 5) AS dearest,
  ROUND(corr(CAST(quantity AS DOUBLE), CAST(revenue AS DOUBLE)), 6) AS corr_rev, ROUND(corr(CAST(quantity AS DOUBLE), CAST(0 AS DOUBLE)), 6) IS NOT NULL AS corr_flat,
  ROUND(covar_pop(CAST(quantity AS DOUBLE), CAST(revenue AS DOUBLE)), 4) AS cov_p, ROUND(covar_samp(CAST(quantity AS DOUBLE), CAST(revenue AS DOUBLE)), 4) AS cov_s,
  ROUND(stddev(CAST(quantity AS DOUBLE)), 6) AS sd, ROUND(stddev_pop(CAST(quantity AS DOUBLE)), 6) AS sd_p, ROUND(variance(CAST(quantity AS DOUBLE)), 6) AS va, ROUND(var_pop(CAST(quantity AS DOUBLE)), 6) AS va_p,
  ROUND(median(CAST(revenue AS DOUBLE)), 6) AS med, CAST(count_if(discount = 0) AS BIGINT) AS full_price, bool_and(quantity > 0) AS sold, bool_or(discount > 9) AS cut,
  any_value(NULLIF(state, 'nowhere')) = MAX(state) AS one_state, length(string_agg(payment_method, '|')) AS listed, mode(payment_method) IS NOT NULL AS usual
FROM transactions GROUP BY country""",
    "sql_histogram": "SELECT k AS line_count, CAST(h[k] AS BIGINT) AS n FROM (SELECT histogram(line_count) AS h FROM orders) t, unnest(map_keys(h)) AS u(k)",
    "sql_unnest": """SELECT v AS line_count, COUNT(*) AS n, COUNT(DISTINCT customer_id) AS customers
FROM (SELECT customer_id, list(line_count) FILTER (WHERE order_revenue > 1000) AS l FROM orders GROUP BY customer_id) t CROSS JOIN LATERAL unnest(t.l) AS u(v) GROUP BY v""",
    "sql_math": """SELECT line_count, CAST(SUM(trunc(CAST(order_revenue AS DOUBLE))) AS DOUBLE) AS whole, CAST(SUM(trunc(CAST(-order_revenue AS DOUBLE))) AS DOUBLE) AS below,
  ROUND(log(line_count), 9) AS lg, ROUND(log10(line_count), 9) AS lg10, ROUND(ln(line_count), 9) AS nat, ROUND(exp(line_count), 6) AS e, ROUND(sqrt(line_count), 9) AS root,
  ROUND(power(line_count, 2), 6) AS sq, ROUND(pow(line_count, 3), 6) AS cube, CAST(mod(-line_count, 4) AS BIGINT) AS rest, CAST(sign(-line_count) AS DOUBLE) AS sg,
  CAST(abs(-line_count) AS BIGINT) AS size, CAST(greatest(line_count, 3, NULL) AS BIGINT) AS most, CAST(least(line_count, 3) AS BIGINT) AS few,
  CAST(ceil(line_count / 2.0) AS DOUBLE) AS up, CAST(floor(line_count / 2.0) AS DOUBLE) AS down, CAST(iif_count AS BIGINT) AS odd
FROM (SELECT *, if(mod(line_count, 2) = 1, 1, 0) AS iif_count FROM orders) o GROUP BY line_count, iif_count""",
    "sql_strings": """SELECT country, concat(MAX(country), NULL, '/', MAX(line_count)) AS joined, concat_ws('-', country, NULL, 'x') AS ws, regexp_replace(country, '[AEIOU]', '*') AS first_vowel,
  regexp_replace(country, '([aeiou])', '<\\1>', 'gi') AS vowels, regexp_replace(country, '^(.)(.)', '\\2\\1') AS swapped, regexp_replace(country, '$', '!') AS ended, regexp_matches(country, '^[A-F]') AS early,
  starts_with(country, 'U') AS u, ends_with(country, 'A') AS a, contains(country, 'IN') AS has_in, split_part(country, ' ', 1) AS word, left(country, 3) AS l3, right(country, 3) AS r3,
  lpad(country, 5, '.') AS lp, rpad(country, 20, '.') AS rp, trim(country, 'A') AS tr, ltrim(country, 'A') AS lt, rtrim(country, 'A') AS rt, replace(lower(country), 'a', upper('b')) AS rep,
  length(country) AS n, substr(country, 2, 3) AS s3, substring(country, 3) AS s0
FROM (SELECT t.country, o.line_count FROM transactions t JOIN orders o ON t.transaction_id = o.transaction_id) x GROUP BY country""",
    "sql_dates": """SELECT m, MAX(strftime(order_date, '%d/%m/%Y')) AS shown, MAX(strftime(order_date, '%Y-W%W')) AS week_label, MIN(strftime(order_date, '%B %-d, day %j')) AS named,
  MAX(CAST(strptime(strftime(order_date, '%d.%m.%Y'), '%d.%m.%Y') AS DATE)) AS back, CAST(SUM(date_diff('month', order_date, DATE '2001-08-31')) AS BIGINT) AS months, CAST(SUM(date_sub('month', order_date, DATE '2001-08-31')) AS BIGINT) AS whole_months,
  CAST(SUM(date_diff('day', order_date, DATE '2001-08-31')) AS BIGINT) AS days, CAST(SUM(date_diff('week', order_date, DATE '2001-08-31')) AS BIGINT) AS weeks, CAST(SUM(date_diff('quarter', order_date, DATE '2001-08-31')) AS BIGINT) AS quarters,
  CAST(SUM(date_sub('quarter', order_date, DATE '2001-08-31')) AS BIGINT) AS whole_quarters, CAST(SUM(date_diff('year', order_date, DATE '2001-08-31')) AS BIGINT) AS years, CAST(SUM(date_sub('year', order_date, DATE '2001-08-31')) AS BIGINT) AS whole_years,
  MAX(CAST(date_add(order_date, INTERVAL 1 MONTH) AS DATE)) AS next_month, CAST(SUM(date_part('dow', order_date)) AS BIGINT) AS dow, CAST(SUM(date_part('doy', order_date)) AS BIGINT) AS doy, CAST(SUM(dayofweek(order_date)) AS BIGINT) AS dow2,
  CAST(SUM(isodow(order_date)) AS BIGINT) AS iso, CAST(SUM(week(order_date)) AS BIGINT) AS wk, CAST(MAX(epoch(order_date)) AS DOUBLE) AS seconds, MAX(last_day(order_date)) AS month_end, MAX(make_date(year(order_date), month(order_date), 1)) AS month_start,
  MAX(CAST(date_trunc('month', order_date) AS DATE)) AS truncated, MAX(quarter(order_date)) AS q, MAX(day(order_date)) AS d
FROM (SELECT month(order_date) AS m, order_date FROM orders) o GROUP BY m""",
    "sql_nested_with": """WITH big AS (SELECT customer_id, COUNT(*) AS n FROM orders GROUP BY customer_id HAVING COUNT(*) >= 8), few AS (SELECT customer_id FROM big WHERE n < 20)
SELECT COUNT(*) AS n, SUM(CAST(c.total_revenue AS DOUBLE)) > 0 AS paid FROM customers c WHERE c.customer_id IN (SELECT customer_id FROM few) AND NOT EXISTS (SELECT 1 FROM big b WHERE b.customer_id = c.customer_id AND b.n > 15)""",
}


def _sql(text):
    def run(spark, d):
        adhoc.session_over(relations(spark, d))
        return plain(adhoc.query(spark, text))

    return run


def _above_list_price(spark, d):
    """For every product, lines of any product whose price per unit lies up to 0.02 above its own average."""
    rel = relations(spark, d)
    price = lambda r, q: F.col(r).cast("double") / F.col(q).cast("double")
    lines = rel.tx("revenue", "quantity").select(price("revenue", "quantity").alias("price"))
    goods = rel.products("total_revenue", "total_quantity").select("product_key", price("total_revenue", "total_quantity").alias("low"))
    goods = goods.withColumn("high", F.col("low") + F.lit(0.02))
    found = intervals.interval_join(lines, goods, "price", "low", "high")
    return plain(found.groupBy("product_key").agg(F.count("*").alias("lines"), F.min("price").alias("least"), F.max("price").alias("most")))


def sql_queries():
    return {"theta_price_neighbours": _above_list_price, **{name: _sql(text) for name, text in TEXTS.items()}}


def _twin(text: str) -> str:
    own = text.replace("FROM orders", "FROM orders_").replace("JOIN orders", "JOIN orders_")
    frame = using(ORDERS, CUSTOMERS) + ", orders_ AS (SELECT * FROM o)"
    return f"{frame}, {own.removeprefix('WITH ')}" if own.startswith("WITH ") else f"{frame}\n{own}"


# Dates leave Spark as text.
_AS_TEXT = ("back", "next_month", "month_end", "month_start", "truncated")
SQL = {
    "theta_price_neighbours": using(PRODUCTS)
    + """, goods AS (SELECT product_key, CAST(total_revenue AS DOUBLE) / CAST(total_quantity AS DOUBLE) AS low FROM products)
SELECT product_key, COUNT(*) AS lines, MIN(price) AS least, MAX(price) AS most
FROM (SELECT CAST(revenue AS DOUBLE) / CAST(quantity AS DOUBLE) AS price FROM transactions) JOIN goods ON low < price AND price <= low + 0.02 GROUP BY product_key""",
    **{name: _twin(text) for name, text in TEXTS.items()},
}
SQL["sql_dates"] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _AS_TEXT)}) FROM ({SQL['sql_dates']})"
