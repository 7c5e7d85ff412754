"""Query results as metric records, the metric registry, and the evidence behind a metric."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.functions.columns import one_row, rounded
from tillview.operators import catalog, rfm, templates
from tillview.operators.ordering import ranked
from tillview.operators.relations import Relations, Unavailable

OTHER, TOP_N, POINTS = "__OTHER__", 20, 1000


@dataclass(frozen=True)
class Binding:
    """Columns of a template as metrics. ``additive`` columns fold members beyond the top N into one."""

    module: str
    template: str
    metrics: tuple[tuple[str, str, str], ...]  # (metric name, column, unit)
    dimensions: tuple[str, ...] = ()
    order: str | None = None
    top: int | None = None
    additive: tuple[str, ...] = ()


_PLACE = (("revenue_by_{0}", "revenue", "currency"), ("orders_by_{0}", "orders", "count"), ("customers_by_{0}", "customers", "count"))


def _place(level: str) -> Binding:
    names = tuple((m.format(level), c, u) for m, c, u in _PLACE)
    return Binding("GEOGRAPHY", f"geo_revenue_by_{level}", names, (level,), "revenue", TOP_N, (f"revenue_by_{level}",))


# Which column of which template is which metric.
CATALOG = (
    Binding("SALES", "sales_total_revenue", (("total_revenue", "total_revenue", "currency"),)),
    Binding("SALES", "sales_total_orders", (("total_orders", "total_orders", "count"),)),
    Binding("SALES", "sales_total_quantity", (("total_quantity", "total_quantity", "quantity"),)),
    Binding("SALES", "sales_average_order_value", (("average_order_value", "average_order_value", "currency"),)),
    Binding("SALES", "sales_avg_revenue_per_customer", (("avg_revenue_per_customer", "avg_revenue_per_customer", "currency"),)),
    Binding("SALES", "sales_growth_latest_period", (("revenue_growth", "revenue_growth", "ratio"), ("order_growth", "order_growth", "ratio"))),
    Binding("CUSTOMERS", "cust_total_customers", (("total_customers", "total_customers", "count"),)),
    Binding("CUSTOMERS", "cust_repeat_purchase_rate", (("repeat_purchase_rate", "repeat_purchase_rate", "ratio"),)),
    Binding("CUSTOMERS", "cust_avg_customer_revenue", (("avg_customer_revenue", "avg_customer_revenue", "currency"),)),
    Binding("CUSTOMERS", "cust_avg_orders_per_customer", (("avg_orders_per_customer", "avg_orders_per_customer", "count"),)),
    Binding(
        "SEGMENTATION",
        "cust_segment_summary",
        (
            ("segment_customers", "customers", "count"),
            ("segment_customer_share", "customer_share", "ratio"),
            ("segment_revenue", "revenue", "currency"),
            ("segment_revenue_share", "revenue_share", "ratio"),
            ("segment_aov", "average_order_value", "currency"),
        ),
        ("segment",),
    ),
    Binding(
        "RFM", "cust_rfm_distribution", (("rfm_customers", "customers", "count"), ("rfm_revenue", "revenue", "currency")), ("r_score", "f_score")
    ),
    Binding(
        "PRODUCTS",
        "prod_revenue_and_quantity",
        (
            ("revenue_by_product", "total_revenue", "currency"),
            ("quantity_by_product", "total_quantity", "quantity"),
            ("product_revenue_share", "revenue_share", "ratio"),
        ),
        ("product_key",),
        "total_revenue",
        TOP_N,
        ("revenue_by_product", "quantity_by_product", "product_revenue_share"),
    ),
    Binding(
        "PRODUCTS",
        "cat_revenue_quantity_contribution",
        (
            ("revenue_by_category", "revenue", "currency"),
            ("quantity_by_category", "quantity", "quantity"),
            ("category_revenue_share", "revenue_share", "ratio"),
        ),
        ("category",),
        "revenue",
        TOP_N,
        ("revenue_by_category", "quantity_by_category", "category_revenue_share"),
    ),
    Binding(
        "PAYMENT",
        "pay_summary",
        (
            ("revenue_by_payment_method", "revenue", "currency"),
            ("orders_by_payment_method", "orders", "count"),
            ("aov_by_payment_method", "average_order_value", "currency"),
        ),
        ("payment_method",),
        "revenue",
        TOP_N,
        ("revenue_by_payment_method",),
    ),
    _place("country"),
    _place("state"),
    _place("city"),
    Binding(
        "DISCOUNT",
        "disc_band_summary",
        (("discount_band_revenue", "revenue", "currency"), ("discount_band_orders", "orders", "count"), ("discount_band_aov", "average_order_value", "currency")),
        ("discount_band",),
    ),
    Binding("DISCOUNT", "disc_revenue_association", (("discount_revenue_correlation", "pearson_discount_revenue", "score"),)),
    Binding("TIME", "time_mom_growth", (("mom_growth", "mom_growth", "ratio"),), ("month_start",)),
    Binding("TIME", "time_yoy_growth", (("yoy_growth", "yoy_growth", "ratio"),), ("month_start",)),
    Binding("LOYALTY", "loy_cohort_retention", (("cohort_retention", "retention", "ratio"),), ("cohort_month", "months_since_first")),
    Binding("LOYALTY", "loy_inter_purchase_days", (("avg_days_between_orders", "avg_days_between_orders", "days"),)),
)
# Metrics that are one series of points, by template and the time column.
SERIES = (
    ("TIME", "time_revenue_daily", "revenue_daily", "date", "revenue", "currency"),
    ("TIME", "time_revenue_monthly", "revenue_monthly", "month_start", "revenue", "currency"),
    ("TIME", "time_revenue_weekly", "revenue_weekly", "week_start", "revenue", "currency"),
    ("TIME", "time_revenue_yearly", "revenue_yearly", "year", "revenue", "currency"),
    ("CUSTOMERS", "cust_revenue_deciles", "customer_revenue_deciles", "decile", "revenue", "currency"),
    ("PURCHASE_BEHAVIOR", "beh_order_value_deciles", "order_value_deciles", "decile", "median_order_value", "currency"),
)


GRAIN_OF = {"date": "DAY", "week_start": "WEEK", "month_start": "MONTH", "year": "YEAR", "decile": "DECILE"}


def bind(frame: DataFrame, b: Binding) -> DataFrame:
    """One row per metric and member; undefined values and absent columns give no metric."""
    values = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric_name"),
                F.lit(unit).alias("unit"),
                F.lit(name in b.additive).alias("additive"),
                F.col(c).cast("decimal(38,10)").alias("value"),
            )
            for name, c, unit in b.metrics
            if c in frame.columns
        ]
    )
    if not b.dimensions:
        return frame.select(F.inline(values)).where("value IS NOT NULL").select(
            "metric_name", F.create_map().cast("map<string,string>").alias("dimensions"), "value", "unit"
        )
    names = F.array(*[F.lit(d) for d in b.dimensions])
    members = F.array(*[F.col(d).cast("string") for d in b.dimensions])
    if b.top:
        # Only the members that stay named are looked up; the others are never ranked.
        best = frame.orderBy(F.desc(b.order), *b.dimensions).limit(b.top).select(*b.dimensions, F.lit(True).alias("_named"))
        frame = frame.join(F.broadcast(best), list(b.dimensions), "left")  # at most 20 rows
        members = F.when(F.col("_named"), members).otherwise(F.transform(names, lambda n: F.lit(OTHER)))
        named = F.coalesce("_named", F.lit(False))
    else:
        named = F.lit(True)
    rows = (
        frame.select(members.alias("members"), named.alias("named"), F.inline(values))
        .where("value IS NOT NULL AND (named OR additive)")
        .groupBy("metric_name", "unit", "members")
        .agg(F.sum("value").cast("decimal(38,10)").alias("value"))
    )
    return rows.select("metric_name", F.map_from_arrays(names, F.col("members")).alias("dimensions"), "value", "unit")


def headline_customers(rel: Relations) -> DataFrame:
    """New and returning customers of the latest complete month, the first month of the data left out."""
    months = templates.cust_new_vs_returning_monthly(rel)
    first = rel.bounds[0].replace(day=1)
    last = months.where(F.col("month_start") > F.lit(first)).orderBy(F.desc("month_start")).limit(1)
    pairs = [F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("decimal(38,10)").alias("value")) for n in ("new_customers", "returning_customers")]
    return last.select(F.inline(F.array(*pairs))).select(
        "metric_name", F.create_map().cast("map<string,string>").alias("dimensions"), "value", F.lit("count").alias("unit")
    )


def collect_metrics(rel: Relations, run_id: str, catalog_rows: Sequence[Binding] = CATALOG) -> DataFrame:
    """Every metric whose template is available, as one frame."""
    rel.keep("orders", "customers", "products")
    out = None
    parts = [(b.module, b.template, lambda b=b: bind(templates.TEMPLATES[b.template](rel), b)) for b in catalog_rows]
    parts.append(("CUSTOMERS", "cust_new_vs_returning_monthly", lambda: headline_customers(rel)))
    for module, template, make in parts:
        try:
            rows = make()
        except Unavailable:
            continue
        rows = rows.select(F.lit(module).alias("module"), F.lit(template).alias("template"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("run_id", F.lit(run_id))


def collect_series(rel: Relations, run_id: str, points: int = POINTS) -> DataFrame:
    """Series metrics: their points in order of the typed axis, with position and grain.

    A daily series of more than ``points`` days is summed by week or month instead, first and last days included; the
    others have a point for each week, month, year or decile. Nothing is cut.
    """
    out = None
    for module, template, name, at, value, unit in SERIES:
        try:
            grain, frame = GRAIN_OF[at], templates.TEMPLATES[template](rel)
            if at == "date":
                days = (rel.bounds[1] - rel.bounds[0]).days + 1 if rel.bounds[0] else 0
                grain = "DAY" if days <= points else "WEEK" if days // 7 + 2 <= points else "MONTH"
                if grain != "DAY":
                    frame = frame.groupBy(F.trunc(at, grain.lower()).alias(at)).agg(F.sum(value).alias(value))
        except Unavailable:
            continue
        typed = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).cast("decimal(38,10)").alias("v"))))
        series = F.transform(typed, lambda p, i: F.struct((i + 1).cast("bigint").alias("position"), p["at"].cast("string").alias("t"), p["v"].alias("v")))
        row = frame.agg(series.alias("value_series")).select(
            F.lit(module).alias("module"), F.lit(template).alias("template"), F.lit(name).alias("metric_name"), F.lit(grain).alias("grain"), "value_series", F.lit(unit).alias("unit")
        )
        out = row if out is None else out.unionByName(row)
    return out.withColumn("run_id", F.lit(run_id))


# --- the registry of core metrics -----------------------------------------------------------------


def registry(flat: DataFrame, quality_score: DataFrame, digest: str, run_id: str) -> DataFrame:
    """Five core metrics and the revenue of the four segments, each with formula, SQL and data digest."""
    from tillview.operators.slices import key_figures

    kpi = key_figures(flat)
    score = one_row(quality_score, "overall_score")

    def money(c):
        return F.concat(F.lit("₹"), F.format_number(c, 2))

    def row(key, name, category, shown, value, unit, grain, formula, sql):
        return F.struct(
            F.lit(key).alias("metric_key"),
            F.lit(name).alias("metric_name"),
            F.lit(category).alias("category"),
            shown.alias("formatted_value"),
            value.cast("double").alias("numeric_value"),
            F.lit(unit).alias("unit"),
            F.lit(grain).alias("grain"),
            F.lit(formula).alias("formula"),
            F.lit(sql).alias("underlying_sql"),
        )

    revenue, orders, people, aov = (F.col(c) for c in ("total_revenue", "total_orders", "total_customers", "average_order_value"))
    core = kpi.select(
        F.inline(
            F.array(
                row("total_revenue", "Total Revenue", "REVENUE", money(revenue), revenue, "INR", "TOTAL", "SUM(total_amount)", "SELECT SUM(total_amount) FROM transactions"),
                row("total_orders", "Total Orders", "VOLUME", F.format_number(orders, 0), orders, "COUNT", "TOTAL", "COUNT(DISTINCT order_id)", "SELECT COUNT(DISTINCT order_id) FROM transactions"),
                row("active_customers", "Active Customers", "CUSTOMER", F.format_number(people, 0), people, "COUNT", "TOTAL", "COUNT(DISTINCT customer_id)", "SELECT COUNT(DISTINCT customer_id) FROM transactions"),
                row("average_order_value", "Average Order Value", "EFFICIENCY", money(aov), aov, "INR", "TRANSACTION", "SUM(total_amount) / COUNT(DISTINCT order_id)", "SELECT SUM(total_amount) / COUNT(DISTINCT order_id) FROM transactions"),
                row("quality_score", "Data Quality Score", "QUALITY", F.concat(score.cast("string"), F.lit("/100")), score, "SCORE", "DATASET", "0.30 C + 0.25 U + 0.25 V + 0.20 K", None),
            )
        )
    )
    scored = rfm.score(rfm.flat_base(flat), rules="code")
    segments = rfm.segment_table(flat.sparkSession, scored).select(
        F.concat(F.lit("rfm_rev_"), F.lower("code")).alias("metric_key"),
        F.concat("segment", F.lit(" Segment Revenue")).alias("metric_name"),
        F.lit("SEGMENT").alias("category"),
        money(F.col("total_revenue")).alias("formatted_value"),
        F.col("total_revenue").alias("numeric_value"),
        F.lit("INR").alias("unit"),
        F.lit("COHORT").alias("grain"),
        F.concat(F.lit("SUM(total_amount) of segment "), "segment").alias("formula"),
        F.concat(F.lit("SELECT SUM(revenue) FROM customer_segments WHERE segment = '"), "segment", F.lit("'")).alias("underlying_sql"),
    )
    return core.unionByName(segments).withColumns({"sha256_hash": F.lit(digest), "run_id": F.lit(run_id)})


def latest_by_key(metrics: DataFrame, key: str = "metric_key", at: str = "created_at") -> DataFrame:
    """The newest record of every metric: an aggregate, so a metric written very often stays cheap."""
    rest = [c for c in metrics.columns if c != key]
    return metrics.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("m")).select(key, "m.*")


def latest(metrics: DataFrame, rows: int = 50, at: str = "created_at") -> DataFrame:
    """The newest records; of equally new ones those first in the order of their other columns."""
    rest = [c for c, kind in metrics.dtypes if c != at and not kind.startswith("map")]
    return metrics.orderBy(F.desc(at), *rest).limit(rows)


def evidence(flat: DataFrame, scored: DataFrame, digest: str, order: Sequence[str]) -> DataFrame:
    """Per metric its value, formula and SQL, the data digest, and five rows of the data."""
    from tillview.operators.slices import key_figures

    kpi = key_figures(flat)
    high = scored.where((F.col("r_score") >= 4) & (F.col("f_score") >= 4)).agg(F.sum("monetary").alias("r"))
    sample = flat.orderBy(*order).limit(5).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, "total_amount")))).alias("s"))
    entries = (
        ("total_revenue", "total_revenue", "SUM(total_amount)", "SELECT ROUND(SUM(total_amount), 2) AS total_revenue FROM transactions"),
        ("active_customers", "total_customers", "COUNT(DISTINCT customer_id)", "SELECT COUNT(DISTINCT customer_id) AS active_customers FROM transactions"),
        ("average_order_value", "average_order_value", "SUM(total_amount) / COUNT(DISTINCT order_id)", "SELECT ROUND(SUM(total_amount) / COUNT(DISTINCT order_id), 2) AS aov FROM transactions"),
    )
    rows = [
        F.struct(F.lit(k).alias("metric_key"), F.col(c).cast("double").alias("raw_value"), F.lit(f).alias("formula"), F.lit(q).alias("underlying_sql"))
        for k, c, f, q in entries
    ]
    rows.append(
        F.struct(
            F.lit("high_value_revenue").alias("metric_key"),
            F.coalesce(rounded(one_row(high, "r"), 2), F.lit(0.0)).alias("raw_value"),
            F.lit("SUM(total_amount) of customers with r_score >= 4 and f_score >= 4").alias("formula"),
            F.lit(
                "SELECT ROUND(SUM(t.total_amount), 2) FROM transactions t JOIN rfm_scores r USING (customer_id)"
                " WHERE r.r_score >= 4 AND r.f_score >= 4"
            ).alias("underlying_sql"),
        )
    )
    return kpi.select(F.inline(F.array(*rows))).withColumns(
        {"sha256_hash": F.lit(digest), "sample_records": one_row(sample, "s")}
    )


def high_value_revenue_by_join(flat: DataFrame, scored: DataFrame) -> DataFrame:
    """The evidence query of the high-value segment: lines joined to the scores of their customer."""
    chosen = scored.where((F.col("r_score") >= 4) & (F.col("f_score") >= 4)).select("customer_id")
    return flat.join(chosen, "customer_id").agg(rounded(F.sum("total_amount"), 2).alias("hv_revenue"))


# --- the pool of figures a text may quote ---------------------------------------------------------


def number_pool(
    flat: DataFrame, source, quality: DataFrame, cleaning: dict[str, int], segments: DataFrame, with_constants: bool = True
) -> DataFrame:
    """(position, metric, value): key figures, quality, cleaning, segments, best products, payments, constants."""
    from tillview.operators.claims import CONSTANTS
    from tillview.operators.slices import key_figures

    def pairs(frame: DataFrame, entries, base: int) -> DataFrame:
        rows = [
            F.struct(F.lit(base + i).cast("bigint").alias("position"), (F.lit(n) if isinstance(n, str) else n).alias("metric"), v.cast("double").alias("value"))
            for i, (n, v) in enumerate(entries)
        ]
        return frame.select(F.inline(F.array(*rows)))

    c = F.col
    revenue = c("total_revenue")
    parts = [
        pairs(
            key_figures(flat),
            [
                ("total_revenue", revenue),
                ("total_revenue_lakh", rounded(revenue / 1e5, 2)),
                ("total_revenue_cr", rounded(revenue / 1e7, 2)),
                ("total_orders", c("total_orders")),
                ("total_customers", c("total_customers")),
                ("aov", c("average_order_value")),
            ],
            0,
        ),
        pairs(
            quality,
            [
                ("quality_overall", c("overall_score")),
                ("quality_completeness", c("completeness_score")),
                ("quality_uniqueness", c("uniqueness_score")),
                ("quality_validity", c("validity_score")),
                ("quality_consistency", c("consistency_score")),
                ("quality_null_cells", c("null_cells")),
                ("quality_outliers", c("outlier_count")),
            ],
            100,
        ),
        pairs(flat.sparkSession.range(1), [(n, F.lit(v)) for n, v in cleaning.items()], 200),
    ]
    prefix = F.concat(F.lit("rfm_"), F.lower("code"))
    names = (
        ("_count", c("customer_count")),
        ("_cust_pct", c("customer_pct")),
        ("_rev", c("total_revenue")),
        ("_rev_lakh", rounded(c("total_revenue") / 1e5, 2)),
        ("_rev_pct", c("revenue_pct")),
        ("_aov", c("avg_order_value")),
        ("_recency", c("avg_recency_days")),
    )
    order = F.lit(9)
    for i, (_, code) in enumerate(rfm.CODE_SEGMENTS):
        order = F.when(c("code") == code, i).otherwise(order)
    seg = segments.select(
        (F.lit(300) + order * 10).alias("at"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.concat(prefix, F.lit(n)).alias("metric"), v.cast("double").alias("value")) for i, (n, v) in enumerate(names)])),
    )
    parts.append(seg.select((c("at") + c("i")).alias("position"), "metric", "value"))
    best = catalog.product_table(source).where("rank <= 10")
    trio = [("_rev", c("revenue")), ("_pct", c("revenue_pct")), ("_units", c("units_sold"))]
    prod = best.select(
        "rank",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.concat(F.lit("prod_"), c("rank").cast("string"), F.lit(n)).alias("metric"), v.cast("double").alias("value"))
                    for i, (n, v) in enumerate(trio)
                ]
            )
        ),
    )
    parts.append(prod.select((F.lit(400) + c("rank") * 3 + c("i")).alias("position"), "metric", "value"))
    # Payment names come from the data, so their number is not bounded here; the matcher does not rely on it.
    name = F.concat(F.lit("pay_"), F.replace(F.lower("payment_method"), F.lit(" "), F.lit("_")))
    trio = [("_rev", c("total_revenue")), ("_pct", c("revenue_pct")), ("_txns", c("transaction_count"))]
    pay = ranked(catalog.payment_table(flat), [F.desc("total_revenue"), c("payment_method")]).select(
        "rank",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.concat(name, F.lit(n)).alias("metric"), v.cast("double").alias("value"))
                    for i, (n, v) in enumerate(trio)
                ]
            )
        ),
    )
    parts.append(pay.select((F.lit(1000) + c("rank") * 3 + c("i")).alias("position"), "metric", "value"))
    if with_constants:
        parts.append(pairs(flat.sparkSession.range(1), [(n, F.lit(v)) for n, v in CONSTANTS], 1 << 60))
    out = None
    for p in parts:
        p = p.select(c("position").cast("bigint").alias("position"), "metric", "value")
        out = p if out is None else out.unionByName(p)
    return out.where("value IS NOT NULL")

