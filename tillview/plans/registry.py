"""Every named query with its callable; the SQL twins live next to the group they belong to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.columns import rounded
from tillview.operators import templates
from tillview.operators.relations import Relations
from tillview.plans import analytics_queries, insight_queries, io_queries, model_queries, profile_queries, quality_queries, sql_queries, star_queries, template_sql
from tillview.plans.edge import plain
from tillview.plans.shared import relations

Query = Callable[[SparkSession, str], DataFrame]


def _template(build: Callable[[Relations], DataFrame], rounding: dict[str, int] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plain(build(relations(spark, sf_dir)))
        return df.withColumns({c: rounded(c, n) for c, n in (rounding or {}).items()})

    return run


ROUNDED = {
    "disc_revenue_association": {"pearson_discount_revenue": 6},
    "beh_order_value_deciles": {"median_order_value": 5},
}


def _thinned(rel: Relations) -> DataFrame:
    grain, series = templates.thin_series(rel)
    return series.withColumn("grain", F.lit(grain))


def template_queries() -> dict[str, Query]:
    out = {name: _template(f, ROUNDED.get(name)) for name, f in templates.TEMPLATES.items()}
    more: dict[str, Callable[[Relations], DataFrame]] = {
        "revenue_unclassified": templates.revenue_unclassified,
        "location_totals": templates.location_totals,
        "top_n_other_products": lambda r: templates.top_n_other(r.products("total_revenue"), "product_key", "total_revenue"),
        "pareto_thinned": lambda r: templates.thin_ranks(templates.prod_pareto(r)),
        "series_thinned": _thinned,
        "rel_transactions": lambda r: r.transactions(),
        "rel_orders": lambda r: r.orders(),
        "rel_customers": lambda r: r.customers(),
        "rel_products": lambda r: r.products(),
        "rel_calendar": lambda r: r.calendar(),
        "rel_run_params": lambda r: r.run_params(),
        "rel_customer_segments": lambda r: r.customer_segments(),
    }
    return out | {name: _template(f) for name, f in more.items()}


GROUPS: list[tuple[Callable[[], dict[str, Query]], dict[str, str]]] = [
    (template_queries, template_sql.SQL),
    (analytics_queries.analytics_queries, analytics_queries.SQL),
    (quality_queries.quality_queries, quality_queries.SQL),
    (profile_queries.profile_queries, profile_queries.SQL),
    (star_queries.star_queries, star_queries.SQL),
    (insight_queries.insight_queries, insight_queries.SQL),
    (io_queries.io_queries, io_queries.SQL),
    (model_queries.model_queries, model_queries.SQL),
    (sql_queries.sql_queries, sql_queries.SQL),
]


def all_queries() -> dict[str, Query]:
    return {name: q for build, _ in GROUPS for name, q in build().items()}


def all_sql() -> dict[str, str]:
    return {name: text for _, sql in GROUPS for name, text in sql.items()}
