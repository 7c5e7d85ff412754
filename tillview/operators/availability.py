"""What a mapping of roles makes available: tables, columns, measures and templates, and which roles each absent item lacks.

Items need roles, or items that need roles themselves; what an item lacks follows through all of them. The templates ask here before they
run, so that the list and what they raise are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tillview.functions.columns import fixed_rows

ROLES = (
    "transaction_id", "customer_id", "customer_age", "gender", "product_id", "product_name", "category", "quantity", "price", "revenue", "discount",
    "purchase_date", "payment_method", "country", "state", "city",
)

# What each item needs. Any one of the names between bars will do; a name is a role or another item.
TABLES = {
    "fact_sales": "revenue",
    "dim_customer": "fact_sales customer_id",
    "dim_product": "fact_sales product_id|product_name|category",
    "dim_date": "fact_sales purchase_date",
    "dim_location": "fact_sales country|state|city",
    "dim_payment": "fact_sales payment_method",
    "dim_discount_band": "fact_sales discount",
}
_DAYS = (
    "date_key date year quarter month day quarter_label month_name month_short year_month month_start month_end week_start iso_week day_of_week day_name is_weekend month_sort"
    " in_data_range month_is_complete week_is_complete year_is_complete"
)
_SCORES = "rfm_recency_days rfm_frequency rfm_monetary r_score f_score m_score rfm_score segment_code segment segment_sort"
COLUMNS = {
    "fact_sales": {
        "revenue line_id": "",
        "quantity": "quantity",
        "unit_price": "price",
        "transaction_id has_transaction_id order_line_count order_size_bucket": "transaction_id",
        "customer_key has_customer": "dim_customer",
        "product_key": "dim_product",
        "location_key": "dim_location",
        "payment_key": "dim_payment",
        "date_key": "dim_date",
        "discount_band_key discount_pct": "dim_discount_band",
    },
    "dim_customer": {
        "customer_key customer_id order_count lifetime_revenue purchase_frequency_bucket purchase_frequency_sort": "",
        "first_purchase_date last_purchase_date": "purchase_date",
        "customer_age": "customer_age",
        "gender": "gender",
        _SCORES: "purchase_date",
    },
    "dim_product": {"product_key product_natural_key is_unknown": "", "product_id": "product_id", "product_name": "product_name", "category": "category"},
    "dim_date": {_DAYS: ""},
    "dim_location": {"location_key location_label is_unknown": "", "country": "country", "state": "state", "city": "city"},
    "dim_payment": {"payment_key payment_method is_unknown": ""},
    "dim_discount_band": {"discount_band_key discount_band band_order": ""},
}
MEASURES = {
    "Total Revenue": "fact_sales",
    "Total Orders": "fact_sales transaction_id",
    "Total Quantity": "fact_sales quantity",
    "Total Customers": "dim_customer",
    "Average Order Value": "fact_sales transaction_id",
    "Revenue per Customer": "dim_customer",
    "Average Lines per Order": "fact_sales transaction_id",
    "Average Basket Quantity": "fact_sales transaction_id quantity",
    "Repeat Customer Rate": "dim_customer transaction_id",
    "Orders per Customer": "dim_customer transaction_id",
    "Revenue Growth": "dim_date",
    "Order Growth": "dim_date transaction_id",
    "New Customers (Headline)": "dim_date dim_customer",
    "Returning Customers (Headline)": "dim_date dim_customer",
}
_GOODS = "product_id|product_name"
TEMPLATES = {
    "sales_total_revenue": "revenue",
    "sales_total_orders": "transaction_id",
    "sales_total_quantity": "quantity",
    "sales_average_order_value": "transaction_id revenue",
    "sales_avg_revenue_per_customer": "customer_id revenue",
    "sales_growth_latest_period": "revenue purchase_date",
    "cust_total_customers": "customer_id",
    "cust_new_vs_returning_monthly": "customer_id purchase_date",
    "cust_repeat_purchase_rate": "customer_id",
    "cust_avg_customer_revenue": "customer_id revenue",
    "cust_avg_orders_per_customer": "customer_id",
    "cust_top_customers": "customer_id revenue",
    "cust_revenue_deciles": "customer_id revenue",
    "cust_segment_summary": "customer_id revenue purchase_date",
    "cust_rfm_table": "customer_id revenue purchase_date",
    "cust_rfm_distribution": "customer_id revenue purchase_date",
    "prod_top_by_revenue": f"{_GOODS} revenue",
    "prod_bottom_by_revenue": f"{_GOODS} revenue",
    "prod_top_by_quantity": f"{_GOODS} quantity",
    "prod_revenue_and_quantity": f"{_GOODS} revenue",
    "prod_pareto": f"{_GOODS} revenue",
    "cat_revenue_quantity_contribution": "category revenue",
    "time_revenue_daily": "revenue purchase_date",
    "time_revenue_weekly": "revenue purchase_date",
    "time_revenue_monthly": "revenue purchase_date",
    "time_revenue_yearly": "revenue purchase_date",
    "time_mom_growth": "revenue purchase_date",
    "time_yoy_growth": "revenue purchase_date",
    "time_revenue_by_day_of_week": "revenue purchase_date",
    "geo_customer_distribution": "customer_id country",
    "geo_revenue_by_country": "revenue country",
    "geo_revenue_by_state": "revenue state",
    "geo_revenue_by_city": "revenue city",
    "geo_revenue_by_country_state": "revenue country state",
    "geo_revenue_by_country_state_city": "revenue country state city",
    "disc_band_summary": "revenue discount",
    "disc_revenue_association": "revenue discount",
    "pay_summary": "transaction_id revenue payment_method",
    "beh_order_size_distribution": "transaction_id revenue",
    "beh_order_quantity_distribution": "transaction_id revenue quantity",
    "beh_order_value_deciles": "transaction_id revenue",
    "beh_purchase_frequency": "customer_id",
    "beh_basket_summary": "transaction_id revenue quantity",
    "loy_inter_purchase_days": "transaction_id customer_id revenue purchase_date",
    "loy_cohort_retention": "customer_id purchase_date",
    "loy_at_risk_customers": "customer_id revenue purchase_date",
}
# Revenue is there when it can be worked out.
_DERIVED = {"revenue": ("price", "quantity")}


def lacking(needs: str, have: Iterable[str]) -> set[str]:
    """The roles without which ``needs`` cannot be met; alternatives that are all absent are one entry, joined by ``or``."""
    have = set(have)
    out: set[str] = set()
    for need in needs.split():
        each = [_lacks(name, have) for name in need.split("|")]
        if all(each):
            out |= each[0] if len(each) == 1 else {" or ".join(sorted(set().union(*each)))}
    return out


def _lacks(name: str, have: set[str]) -> set[str]:
    if name in TABLES:
        return lacking(TABLES[name], have)
    if name in have or (name in _DERIVED and have.issuperset(_DERIVED[name])):
        return set()
    return {name}


def reason(roles: Iterable[str]) -> str:
    return f"Required columns are not mapped: {', '.join(sorted(roles))}."


def items() -> list[tuple[str, str, str, str]]:
    """(kind, table, item, needs) of everything that may be absent."""
    out = [("table", t, t, needs) for t, needs in TABLES.items()]
    out += [("column", t, c, f"{t} {needs}") for t, groups in COLUMNS.items() for names, needs in groups.items() for c in names.split()]
    out += [("measure", "", m, needs) for m, needs in MEASURES.items()]
    return out + [("template", "", t, needs) for t, needs in TEMPLATES.items()]


def table_of(spark: SparkSession, have: Iterable[str]) -> DataFrame:
    """State of every table, column, measure and template under the mapped roles, with the roles that each absent one lacks."""
    have = set(have)
    rows = []
    for kind, table, item, needs in items():
        roles = lacking(needs, have)
        rows.append((kind, table, item, "UNAVAILABLE" if roles else "AVAILABLE", ", ".join(sorted(roles)), reason(roles) if roles else None))
    return fixed_rows(spark, rows, "kind string, table string, item string, state string, missing_roles string, reason string")


def require(template: str, has: Callable[[str], bool]) -> str | None:
    """Why a template cannot run, or None."""
    roles = lacking(TEMPLATES[template], [r for r in ROLES if has(r)])
    return reason(roles) if roles else None
