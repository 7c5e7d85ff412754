"""What a mapping makes available, where a version comes from, how settings are read, and a star whose faults the checks must find."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillview.functions.columns import fixed_rows, rounded
from tillview.operators import availability, cleaning, quality, roles, star
from tillview.plans.edge import plain
from tillview.plans.quality_queries import FLAT
from tillview.plans.shared import relations
from tillview.plans.star_queries import model
from tillview.plans.template_sql import CALENDAR, using
from tillview.plans.template_sql import SQL as TEMPLATE_SQL
from tillview.session import shared_dir, tune
from tillview.sources import sinks
from tillview.sources.flat import flat
from tillview.sources.transactions import table

UNMAPPED = ("payment_method", "state", "quantity")
SETTINGS = {"revenue": "total_amount", "discount": "discount_pct", "transaction_id": "order_id", "quantity": "quantity"}


def _available(spark, d):
    """Every item of the model, with the roles counted as mapped that have a value in some line, less three that are left out."""
    lines = relations(spark, d).transactions()
    names = [r for r in availability.ROLES if r in lines.columns and r not in UNMAPPED]
    some = lines.agg(*[F.count(r).alias(r) for r in names]).first()
    return plain(availability.table_of(spark, [r for r in names if some[r]]))


def _lineage(spark, d):
    """Five versions of the parts, each a part of its parent; what the last lost on its line, not on the branch beside it."""
    place = f"{shared_dir(tune(spark)).rstrip('/')}/lineage-{uuid.uuid4().hex}"
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    first = sinks.write_version(rows, place, 1)
    second = sinks.write_version(first.where("p_partkey % 5 <> 0"), place, 2, 1)
    third = sinks.write_version(second.where("p_partkey % 2 = 0"), place, 3, 2)
    sinks.write_version(second.where("p_partkey % 3 = 0"), place, 4, 2)
    sinks.write_version(third.where("p_partkey % 7 <> 0"), place, 5, 3)
    versions = sinks.versions(spark, place)
    before = versions.select(F.col("version").alias("parent"), F.col("rows").alias("before"))
    lost = versions.join(before, "parent").select("version", F.lit("DROP_ROWS").alias("operation"), F.lit("").alias("column"), (F.col("before") - F.col("rows")).alias("rows_affected"))
    return plain(quality.lineage_issues(versions.select("version", "parent"), lost, 5))


def _settings(spark, d):
    found = roles.derived_settings(flat(tune(spark), d, *SETTINGS.values()), SETTINGS)
    return fixed_rows(spark, list(found.items()), "setting string, value string")


def _discounts(spark, d):
    lines = cleaning.standard_discount(flat(tune(spark), d, "order_id", "discount_pct"), "discount_pct")
    return plain(lines.groupBy(rounded("discount_pct", 6).alias("discount_pct")).agg(F.count("*").alias("lines")))


def _broken(spark, d):
    """The star without every fiftieth order, tenth product, and day 13; with a payment method twice and customers without a segment."""
    good = model(spark, d)
    people = good["dim_customer"].withColumn("segment_code", F.when(F.col("customer_id") % 7 != 0, F.col("segment_code")))
    methods = good["dim_payment"]
    return star.Star(
        {
            **good.tables,
            "fact_sales": good["fact_sales"].where("transaction_id % 50 <> 0"),
            "dim_product": good["dim_product"].where("is_unknown OR product_natural_key % 10 <> 0"),
            "dim_date": good["dim_date"].where("day <> 13"),
            "dim_payment": methods.unionByName(methods.where("payment_method = '1-URGENT'")),
            "dim_customer": people,
        }
    )


def _parity(spark, d):
    found = star.parity(relations(spark, d), model(spark, d))
    return plain(found.withColumns({c: rounded(c, 6) for c in ("expected", "value")}))


def model_queries():
    return {
        "model_availability": _available,
        "dq_lineage": _lineage,
        "map_derived_settings": _settings,
        "clean_discount": _discounts,
        "star_reconcile_planted": lambda spark, d: plain(star.reconcile(relations(spark, d), _broken(spark, d)).withColumn("off", rounded("off", 4))),
        "star_orphans_planted": lambda spark, d: plain(star.orphans(_broken(spark, d), "product_key", "dim_product").groupBy("transaction_id").agg(F.count("*").alias("lines"))),
        "star_parity_values": _parity,
    }


def _resolved(name: str, source: str, known: str) -> str:
    """SQL: what each item of ``source`` (item, needs) lacks, the ``known`` table telling what each need lacks (none: nothing)."""
    return f"""{name}_groups AS (SELECT item, g, unnest(string_split(g, '|')) AS alternative FROM (SELECT item, unnest(string_split(trim(needs), ' ')) AS g FROM {source}) WHERE g <> ''),
{name}_each AS (SELECT item, g, alternative, lacks FROM {name}_groups LEFT JOIN {known} ON name = alternative),
{name}_lost AS (SELECT item, g, COUNT(DISTINCT alternative) AS n, COUNT(DISTINCT alternative) FILTER (WHERE lacks IS NOT NULL) AS bad, string_agg(DISTINCT lacks, ' or ' ORDER BY lacks) AS alternatives FROM {name}_each GROUP BY item, g),
{name} AS (SELECT DISTINCT l.item AS name, CASE WHEN l.n > 1 THEN l.alternatives ELSE e.lacks END AS lacks FROM {name}_lost l JOIN {name}_each e USING (item, g) WHERE l.n = l.bad)"""


def _values(rows) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


_HAVE = [r for r in availability.ROLES if r not in (*UNMAPPED, "price", "customer_age", "gender", "product_name")]
_MAPPED = " UNION ALL ".join(f"SELECT '{r}' AS role WHERE (SELECT COUNT({r}) FROM transactions) > 0" for r in [*_HAVE, "product_name"])
_LIST = [(k, t, i, n) for k, t, i, n in availability.items()]
_AVAILABLE = using() + f""", mapped AS ({_MAPPED}),
roles AS (SELECT role AS name, role AS lacks FROM (VALUES {_values((r,) for r in availability.ROLES)}) AS v(role) WHERE role NOT IN (SELECT role FROM mapped)),
fact AS (SELECT 'fact_sales' AS item, 'revenue' AS needs), {_resolved('one', 'fact', 'roles')},
known AS (SELECT * FROM roles UNION ALL SELECT * FROM one),
dims AS (SELECT * FROM (VALUES {_values((t, n) for t, n in availability.TABLES.items() if t != 'fact_sales')}) AS v(item, needs)), {_resolved('two', 'dims', 'known')},
told AS (SELECT * FROM known UNION ALL SELECT * FROM two),
things AS (SELECT * FROM (VALUES {_values(_LIST)}) AS v(kind, tab, thing, needs)),
keyed AS (SELECT kind || '/' || tab || '/' || thing AS item, CASE WHEN kind = 'table' THEN thing ELSE needs END AS needs FROM things), {_resolved('three', 'keyed', 'told')},
short AS (SELECT name, string_agg(lacks, ', ' ORDER BY lacks) AS missing FROM three GROUP BY name)
SELECT kind, tab AS "table", thing AS item, CASE WHEN missing IS NULL THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS state, coalesce(missing, '') AS missing_roles,
  'Required columns are not mapped: ' || missing || '.' AS reason FROM things LEFT JOIN short ON name = kind || '/' || tab || '/' || thing"""
_ZERO = ("not_a_number", "orphan_customer_key", "repeated_customer_key", "repeated_product_key", "repeated_date_key", "orphan_location_key", "repeated_location_key", "orphan_payment_key", "orphan_discount_band_key", "repeated_discount_band_key")
_KEPT, _GONE = "transaction_id % 50 <> 0", "transaction_id % 50 = 0"
_FAULTS = {
    "row_count": f"(SELECT -COUNT(*) FROM transactions WHERE {_GONE})",
    "revenue": f"(SELECT -SUM(revenue) FROM transactions WHERE {_GONE})",
    "orphan_product_key": f"(SELECT COUNT(*) FROM transactions WHERE {_KEPT} AND product_id % 10 = 0)",
    "orphan_date_key": f"(SELECT COUNT(*) FROM transactions WHERE {_KEPT} AND day(purchase_date) = 13)",
    "repeated_payment_key": "(SELECT COUNT(DISTINCT payment_method) FROM transactions WHERE payment_method = '1-URGENT')",
    "segments_cover_customers": "(SELECT COUNT(DISTINCT customer_id) FROM transactions WHERE customer_id % 7 = 0)",
    "category_revenue": f"(SELECT SUM(revenue) FILTER (WHERE {_KEPT} AND product_id % 10 <> 0) - SUM(revenue) FROM transactions)",
    "contiguous_dates": "(SELECT 12 * (year(hi) - year(lo) + 1) FROM rng)",
    **dict.fromkeys(_ZERO, "0"),
}
_F = f"WITH {FLAT}"
SQL = {
    "model_availability": _AVAILABLE,
    "dq_lineage": " UNION ALL ".join(
        f"SELECT CAST({v} AS BIGINT) AS version, 'DROP_ROWS' AS issue_type, '' AS \"column\", COUNT(*) AS rows_affected, 'REMOVED' AS handling, TRUE AS synthesized FROM part WHERE {gone} HAVING COUNT(*) > 0"
        for v, gone in ((2, "p_partkey % 5 = 0"), (3, "p_partkey % 5 <> 0 AND p_partkey % 2 <> 0"), (5, "p_partkey % 5 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 7 = 0"))
    ),
    "map_derived_settings": _F + """, per AS (SELECT order_id, COUNT(*) AS n, COUNT(DISTINCT (total_amount, discount_pct, quantity)) AS kinds FROM flat GROUP BY order_id),
share AS (SELECT SUM(n) FILTER (WHERE n > 1) / SUM(n) >= 0.02 AND MAX(kinds) > 1 AS lines FROM per),
d AS (SELECT MIN(discount_pct) AS lo, MAX(discount_pct) AS hi, COUNT(*) FILTER (WHERE discount_pct NOT IN (0, 1)) AS other FROM flat)
SELECT 'revenue_basis' AS setting, 'OBSERVED' AS value UNION ALL SELECT 'discount_kind', CASE WHEN lo >= 0 AND hi <= 1 AND other > 0 THEN 'RATIO' WHEN hi <= 100 THEN 'PERCENT' ELSE 'AMOUNT' END FROM d
UNION ALL SELECT 'frequency_basis', 'ORDERS' UNION ALL SELECT 'order_grain', CASE WHEN lines THEN 'LINE_ITEMS' ELSE 'ORDER_LEVEL' END FROM share""",
    "clean_discount": _F + """, s AS (SELECT MAX(discount_pct) <= 1 AS ratio FROM flat)
SELECT ROUND(CASE WHEN ratio THEN discount_pct * 100 ELSE discount_pct END, 6) AS discount_pct, COUNT(*) AS lines FROM flat, s GROUP BY 1""",
    "star_reconcile_planted": using(CALENDAR) + " UNION ALL ".join(f"""SELECT '{c}' AS "check", ROUND(CAST({e} AS DOUBLE), 4) AS off, abs(CAST({e} AS DOUBLE)) < 0.005 AS ok""" for c, e in _FAULTS.items()),
    "star_orphans_planted": using() + f"SELECT transaction_id, COUNT(*) AS lines FROM transactions WHERE {_KEPT} AND product_id % 10 = 0 GROUP BY 1",
    "star_parity_values": " UNION ALL ".join(
        f"SELECT '{m}' AS measure, '{k}' AS kind, ROUND(CAST({c} AS DOUBLE), 6) AS expected, ROUND(CAST({c} AS DOUBLE), 6) AS value, TRUE AS ok FROM ({TEMPLATE_SQL[t]})" for m, t, c, k in star.PARITY
    ),
}
