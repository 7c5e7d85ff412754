"""The library of named questions over the relations."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillview.functions.columns import month_of, of_groups, one_row, ratio
from tillview.operators import availability, rfm
from tillview.operators.ordering import ntile_of, quantiles, ranked
from tillview.operators.relations import Relations, Unavailable

ORDERS = "orders"


def _bounded(limit: int) -> int:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return limit


# --- sales ----------------------------------------------------------------------------------------


def sales_total_revenue(rel: Relations) -> DataFrame:
    return rel.tx("revenue").agg(F.sum("revenue").alias("total_revenue"))


def sales_total_orders(rel: Relations) -> DataFrame:
    return rel.tx("transaction_id").agg(F.count_distinct("transaction_id").alias("total_orders"))


def sales_total_quantity(rel: Relations) -> DataFrame:
    return rel.tx("quantity").agg(F.sum("quantity").alias("total_quantity"))


def sales_average_order_value(rel: Relations) -> DataFrame:
    lines = rel.tx("transaction_id", "revenue").where(F.col("transaction_id").isNotNull())
    return lines.agg(ratio(F.sum("revenue"), F.count_distinct("transaction_id")).alias("average_order_value"))


def sales_avg_revenue_per_customer(rel: Relations) -> DataFrame:
    people = rel.customers("total_revenue")
    return people.agg(ratio(F.sum("total_revenue"), F.count(F.lit(1))).alias("avg_revenue_per_customer"))


def _dated(rel: Relations, label: Column, name: str) -> DataFrame:
    """Revenue and, where transactions are known, orders per label of the purchase date."""
    known = rel.source.has("transaction_id")
    rows, orders = rel.per_order("purchase_date", "revenue", *(["transaction_id"] if known else []))
    sums = [F.sum("revenue").alias("revenue")] + ([orders.alias("orders")] if known else [])
    return rows.where(F.col("purchase_date").isNotNull()).groupBy(label.alias(name)).agg(*sums)


def _months(rel: Relations, complete_only: bool = True) -> DataFrame:
    """Zero-filled months of the calendar with revenue and distinct orders."""
    monthly = _dated(rel, month_of("purchase_date"), "month_start")
    months = rel.calendar().groupBy("month_start").agg(F.bool_and("month_is_complete").alias("is_complete"))
    if complete_only:
        months = months.where("is_complete")
    return months.join(monthly, "month_start", "left").select(
        "month_start",
        "is_complete",
        F.coalesce("revenue", F.lit(0)).alias("revenue"),
        *([F.coalesce("orders", F.lit(0)).alias("orders")] if ORDERS in monthly.columns else []),
    )


def _previous(months: DataFrame, k: int) -> DataFrame:
    """Pair each month with the month ``k`` earlier; months without that partner drop out."""
    earlier = months.select(
        F.add_months("month_start", k).alias("month_start"),
        F.col("month_start").alias("previous_month"),
        F.col("revenue").alias("previous_revenue"),
        *([F.col("orders").alias("previous_orders")] if ORDERS in months.columns else []),
    )
    return months.join(earlier, "month_start")


def _growth(now: str, before: str) -> Column:
    return ratio(F.col(now) - F.col(before), before)


def sales_growth_latest_period(rel: Relations) -> DataFrame:
    """Latest complete month against the one before; no row when they are not consecutive."""
    pairs = _previous(_months(rel), 1)
    newest = rel.calendar().where("month_is_complete").agg(F.max("month_start").alias("m"))
    return pairs.where(F.col("month_start") == one_row(newest, "m")).select(
        F.col("month_start").alias("current_month"),
        "previous_month",
        F.col("revenue").alias("current_revenue"),
        "previous_revenue",
        _growth("revenue", "previous_revenue").alias("revenue_growth"),
        *([_growth("orders", "previous_orders").alias("order_growth")] if rel.source.has("transaction_id") else []),
    )


# --- customers ------------------------------------------------------------------------------------


def cust_total_customers(rel: Relations) -> DataFrame:
    rows, _ = rel.per_order("customer_id")
    return rows.agg(F.count_distinct("customer_id").alias("total_customers"))


def _customer_months(rel: Relations) -> DataFrame:
    """Distinct (customer, month) pairs with the customer's first month."""
    pairs = (
        rel.per_order("customer_id", "purchase_date")[0]
        .where(F.col("customer_id").isNotNull() & F.col("purchase_date").isNotNull())
        .select("customer_id", month_of("purchase_date").alias("month"))
        .distinct()
    )
    # At most one row per month and customer, so no customer makes a large window.
    return pairs.withColumn("first_month", F.min("month").over(Window.partitionBy("customer_id")))


def cust_new_vs_returning_monthly(rel: Relations) -> DataFrame:
    complete = rel.calendar().where("month_is_complete").select(F.col("month_start").alias("month")).distinct()
    is_new = F.col("first_month") == F.col("month")
    counts = _customer_months(rel).groupBy("month").agg(
        F.count_if(is_new).alias("new_customers"), F.count_if(~is_new).alias("returning_customers")
    )
    return (
        counts.join(complete, "month")
        .select(F.col("month").alias("month_start"), "new_customers", "returning_customers")
        .orderBy("month_start")
    )


def cust_repeat_purchase_rate(rel: Relations) -> DataFrame:
    repeat = F.count_if(F.col("order_count") >= 2)
    return rel.customers("order_count").agg(
        ratio(repeat, F.count(F.lit(1))).alias("repeat_purchase_rate"),
        repeat.alias("repeat_customers"),
        F.count(F.lit(1)).alias("total_customers"),
    )


def cust_avg_customer_revenue(rel: Relations) -> DataFrame:
    return rel.customers("total_revenue").agg(
        ratio(F.sum("total_revenue"), F.count("total_revenue")).alias("avg_customer_revenue")
    )


def cust_avg_orders_per_customer(rel: Relations) -> DataFrame:
    return rel.customers("order_count").agg(
        ratio(F.sum("order_count"), F.count(F.lit(1))).alias("avg_orders_per_customer")
    )


def cust_top_customers(rel: Relations, limit: int = 10) -> DataFrame:
    return (
        rel.customers("total_revenue", "order_count", "first_purchase_date", "last_purchase_date")
        .orderBy(F.desc("total_revenue"), "customer_id")
        .limit(_bounded(limit))
    )


def cust_revenue_deciles(rel: Relations) -> DataFrame:
    placed = ranked(rel.customers("total_revenue"), [F.desc("total_revenue"), F.col("customer_id")], total="n")
    deciles = (
        placed.groupBy(ntile_of(F.col("rank"), F.col("n"), 10).alias("decile"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("total_revenue").alias("revenue"))
    )
    # Ten rows at most.
    total = F.sum("revenue").over(Window.partitionBy(F.lit(0)))
    return deciles.withColumn("revenue_share", ratio("revenue", total)).orderBy("decile")


def cust_segment_summary(rel: Relations) -> DataFrame:
    """Customers, revenue, their shares and order-weighted order value per segment."""
    grouped = (
        rel.customer_rfm()
        .groupBy(rfm.segment().alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("monetary").alias("revenue"),
            F.sum("frequency").alias("orders"),
        )
    )
    # Four rows at most.
    whole = Window.partitionBy(F.lit(0))
    return grouped.select(
        "segment",
        "customers",
        ratio("customers", F.sum("customers").over(whole)).alias("customer_share"),
        "revenue",
        ratio("revenue", F.sum("revenue").over(whole)).alias("revenue_share"),
        ratio("revenue", "orders").alias("average_order_value"),
    ).orderBy(rfm.segment_order())


def cust_rfm_table(rel: Relations) -> DataFrame:
    return rel.customer_rfm().orderBy(F.desc("monetary"), "customer_id")


def cust_rfm_distribution(rel: Relations) -> DataFrame:
    return (
        rel.customer_rfm()
        .groupBy("r_score", "f_score")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("revenue"))
        .orderBy(F.desc("r_score"), F.desc("f_score"))
    )


# --- products and categories ----------------------------------------------------------------------


def _product_total(rel: Relations) -> Column:
    ids = [c for c in ("product_id", "product_name") if rel.source.has(c)]
    if rel.source.lookup("product_id"):
        ids = ["product_id"]
    some = F.lit(False)
    for c in ids:
        some = some | F.col(c).isNotNull()
    known = rel.tx(*ids, "revenue").where(some)
    return one_row(known.agg(F.sum("revenue").alias("r")), "r")


def _with_share(rel: Relations, df: DataFrame) -> DataFrame:
    return df.withColumn("revenue_share", ratio("total_revenue", _product_total(rel)))


_PRODUCT_COLUMNS = ("product_name", "category", "total_revenue", "total_quantity")


def prod_top_by_revenue(rel: Relations, limit: int = 10) -> DataFrame:
    return _with_share(rel, _best(rel, [F.desc("total_revenue")], limit))


def prod_bottom_by_revenue(rel: Relations, limit: int = 10) -> DataFrame:
    return _with_share(rel, _best(rel, [F.asc("total_revenue")], limit))


def prod_top_by_quantity(rel: Relations, limit: int = 10) -> DataFrame:
    return _best(rel, [F.desc("total_quantity")], limit)


def _best(rel: Relations, order: list[Column], limit: int) -> DataFrame:
    return rel.products(*_PRODUCT_COLUMNS).orderBy(*order, "product_key").limit(_bounded(limit))


def prod_revenue_and_quantity(rel: Relations) -> DataFrame:
    table = rel.products(*_PRODUCT_COLUMNS, "order_count")
    return _with_share(rel, table).orderBy(F.desc("total_revenue"), "product_key")


def prod_pareto(rel: Relations) -> DataFrame:
    """Cumulative share of revenue over products in descending order of revenue."""
    placed = ranked(
        rel.products("total_revenue"),
        [F.desc("total_revenue"), F.col("product_key")],
        running={"cumulative": "total_revenue"},
    )
    return placed.select(
        "rank",
        "product_key",
        "total_revenue",
        ratio("cumulative", _product_total(rel)).alias("cumulative_revenue_share"),
    ).orderBy("rank")


_OPTIONAL = {
    "quantity": ("quantity", lambda: F.sum("quantity")),
    "orders": ("transaction_id", lambda: F.count_distinct("transaction_id")),
    "customers": ("customer_id", lambda: F.count_distinct("customer_id")),
}


def _mapped(rel: Relations, *names: str) -> dict[str, tuple]:
    """The optional figures whose role is mapped; the others are left out of the result."""
    return {n: _OPTIONAL[n] for n in names if rel.source.has(_OPTIONAL[n][0])}


def _breakdown(rel: Relations, keys: list[str], *figures: str) -> DataFrame:
    """Group the lines that have every key; ``revenue_share`` is of the lines kept."""
    extra = _mapped(rel, *figures)
    known, orders = rel.per_order(*dict.fromkeys([*keys, "revenue", *[role for role, _ in extra.values()]]))
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return (
        known.groupBy(*keys)
        .agg(
            F.sum("revenue").alias("revenue"),
            *[(orders if name == ORDERS else agg()).alias(name) for name, (_, agg) in extra.items()],
        )
        .withColumn("revenue_share", ratio("revenue", of_groups("revenue")))
        .orderBy(F.desc("revenue"), *keys)
    )


def cat_revenue_quantity_contribution(rel: Relations) -> DataFrame:
    return _breakdown(rel, ["category"], "quantity", "orders")


def revenue_unclassified(rel: Relations) -> DataFrame:
    """Revenue on lines without a category, so that category totals reconcile."""
    return rel.tx("category", "revenue").agg(
        F.sum(F.when(F.col("category").isNull(), F.col("revenue")).otherwise(0)).alias("revenue_unclassified")
    )


# --- time -----------------------------------------------------------------------------------------


def _calendar_series(rel: Relations, key: str, keep: str | None = None, flag: str | None = None) -> DataFrame:
    """Revenue and orders per calendar value of ``key``; days without sales count as 0."""
    days = rel.calendar()
    if keep:
        days = days.where(F.col(keep))
    frame = days.groupBy(key).agg(*([F.bool_and(flag).alias("is_complete")] if flag else [F.count(F.lit(1)).alias("_d")]))
    label = {
        "date": F.col("purchase_date"),
        "week_start": F.trunc("purchase_date", "week"),
        "month_start": month_of("purchase_date"),
        "year": F.year("purchase_date"),
        "day_of_week": F.weekday("purchase_date") + 1,
    }[key]
    sums = _dated(rel, label, key)
    zero = F.lit(0)
    return frame.join(sums, key, "left").select(
        key,
        *(["is_complete"] if flag else []),
        F.coalesce("revenue", zero).alias("revenue"),
        *([F.coalesce(ORDERS, zero).alias(ORDERS)] if ORDERS in sums.columns else []),
    ).orderBy(key)


def time_revenue_daily(rel: Relations) -> DataFrame:
    return _calendar_series(rel, "date")


def time_revenue_weekly(rel: Relations) -> DataFrame:
    """Complete ISO weeks only."""
    return _calendar_series(rel, "week_start", keep="week_is_complete")


def time_revenue_monthly(rel: Relations) -> DataFrame:
    return _calendar_series(rel, "month_start", flag="month_is_complete")


def time_revenue_yearly(rel: Relations) -> DataFrame:
    return _calendar_series(rel, "year", flag="year_is_complete")


def time_revenue_by_day_of_week(rel: Relations) -> DataFrame:
    return _calendar_series(rel, "day_of_week")


def time_mom_growth(rel: Relations) -> DataFrame:
    return _previous(_months(rel), 1).select(
        "month_start", "revenue", "previous_revenue", _growth("revenue", "previous_revenue").alias("mom_growth")
    ).orderBy("month_start")


def time_yoy_growth(rel: Relations) -> DataFrame:
    return _previous(_months(rel), 12).select(
        "month_start",
        "revenue",
        F.col("previous_revenue").alias("previous_year_revenue"),
        _growth("revenue", "previous_revenue").alias("yoy_growth"),
    ).orderBy("month_start")


# --- geography, discount, payment -----------------------------------------------------------------


def geo_revenue(rel: Relations, *levels: str) -> DataFrame:
    """Revenue, orders and customers by country, state or city, or by a combination of them."""
    return _breakdown(rel, list(levels), "orders", "customers")


def geo_customer_distribution(rel: Relations, level: str = "country") -> DataFrame:
    return (
        rel.per_order(level, "customer_id")[0]
        .where(F.col(level).isNotNull())
        .groupBy(level)
        .agg(F.count_distinct("customer_id").alias("customers"))
        .orderBy(F.desc("customers"), level)
    )


# Discount bands in percent, upper edges inclusive.
DISCOUNT_BANDS = ((1, "0", 0), (2, "(0,10]", 10), (3, "(10,20]", 20), (4, "(20,30]", 30), (5, ">30", None))


def discount_band_key(c: str | Column = "discount") -> Column:
    value = F.col(c) if isinstance(c, str) else c
    key = F.lit(DISCOUNT_BANDS[-1][0])
    for number, _, top in reversed(DISCOUNT_BANDS[:-1]):
        key = F.when(value == 0 if top == 0 else value <= top, number).otherwise(key)
    return F.when(value.isNotNull(), key)


def disc_band_summary(rel: Relations) -> DataFrame:
    names = F.create_map(*[F.lit(x) for number, name, _ in DISCOUNT_BANDS for x in (number, name)])
    extra = _mapped(rel, "orders", "quantity")
    return (
        rel.tx("discount", "revenue", *[role for role, _ in extra.values()])
        .where(F.col("discount").isNotNull())
        .groupBy(discount_band_key().alias("band_order"))
        .agg(F.sum("revenue").alias("revenue"), *[agg().alias(name) for name, (_, agg) in extra.items()])
        .orderBy("band_order")
        .select(
            names[F.col("band_order")].alias("discount_band"),
            "revenue",
            *([ratio("revenue", "orders").alias("average_order_value")] if "orders" in extra else []),
            *extra,
        )
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; NULL when either side is constant or fewer than two pairs exist."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def disc_revenue_association(rel: Relations) -> DataFrame:
    lines = rel.tx("discount", "revenue").where("discount IS NOT NULL AND revenue IS NOT NULL")
    return lines.agg(
        pearson(F.col("discount"), F.col("revenue")).alias("pearson_discount_revenue"),
        F.count(F.lit(1)).alias("observations"),
    )


def pay_summary(rel: Relations) -> DataFrame:
    rows, orders = rel.per_order("payment_method", "transaction_id", "revenue")
    known = rows.where(F.col("payment_method").isNotNull() & F.col("transaction_id").isNotNull())
    return (
        known.groupBy("payment_method")
        .agg(orders.alias("orders"), F.sum("revenue").alias("revenue"))
        .select(
            "payment_method",
            "orders",
            "revenue",
            ratio("revenue", "orders").alias("average_order_value"),
            ratio("revenue", of_groups("revenue")).alias("revenue_share"),
        )
        .orderBy(F.desc("revenue"), "payment_method")
    )


# --- purchase behavior ----------------------------------------------------------------------------


def _top_coded(c: str, top: int) -> Column:
    return F.when(F.col(c) >= top, f"{top}+").otherwise(F.col(c).cast("string"))


def beh_order_size_distribution(rel: Relations) -> DataFrame:
    return (
        rel.orders("line_count")
        .groupBy(_top_coded("line_count", 10).alias("lines_per_order"))
        .agg(F.min("line_count").alias("sort_key"), F.count(F.lit(1)).alias("orders"))
        .orderBy("sort_key")
    )


def beh_order_quantity_distribution(rel: Relations) -> DataFrame:
    """Orders by the pieces they hold, whole pieces, ten and more together."""
    pieces = rel.orders("order_quantity").where(F.col("order_quantity").isNotNull()).select(F.floor("order_quantity").cast("long").alias("pieces"))
    return (
        pieces.groupBy(_top_coded("pieces", 10).alias("pieces_per_order"))
        .agg(F.min("pieces").alias("sort_key"), F.count(F.lit(1)).alias("orders"))
        .orderBy("sort_key")
    )


def beh_order_value_deciles(rel: Relations) -> DataFrame:
    """Order value per decile. A decile is a range of ranks, so its median is one or two known ranks."""
    placed = ranked(rel.orders("order_revenue"), [F.col("order_revenue"), F.col("transaction_id")], total="n")
    n, k, rank = F.col("n"), F.col("decile"), F.col("rank")
    size, extra = F.floor(n / 10), n % 10
    start = (k - 1) * size + F.least(k - 1, extra)
    here = size + F.when(k <= extra, 1).otherwise(0)
    middle = (rank == start + F.floor((here + 1) / 2)) | (rank == start + F.floor((here + 2) / 2))
    return (
        placed.withColumn("decile", ntile_of(rank, n, 10))
        .withColumn("middle", F.when(middle, F.col("order_revenue").cast("double")))
        .groupBy("decile")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.min("order_revenue").alias("min_order_value"),
            F.avg("middle").alias("median_order_value"),
            F.max("order_revenue").alias("max_order_value"),
        )
        .orderBy("decile")
    )


def beh_purchase_frequency(rel: Relations) -> DataFrame:
    """Customers by number of orders; their revenue too where revenue is mapped."""
    people = rel.customers("order_count", "total_revenue")
    revenue = [F.sum("total_revenue").alias("revenue")] if "total_revenue" in people.columns else []
    return (
        people.groupBy(_top_coded("order_count", 5).alias("orders_per_customer"))
        .agg(F.min("order_count").alias("sort_key"), F.count(F.lit(1)).alias("customers"), *revenue)
        .orderBy("sort_key")
    )


def beh_basket_summary(rel: Relations) -> DataFrame:
    from tillview.session import stage

    orders = stage(rel.orders("order_quantity", "line_count"))
    median = quantiles(orders, ["order_quantity"], [0.5])["order_quantity"][0.5]
    return orders.agg(
        ratio(F.sum("order_quantity"), F.count("order_quantity")).alias("avg_basket_quantity"),
        F.lit(median).cast("double").alias("median_basket_quantity"),
        ratio(F.sum("line_count"), F.count(F.lit(1))).alias("avg_lines_per_order"),
    )


# --- loyalty --------------------------------------------------------------------------------------


def loy_inter_purchase_days(rel: Relations) -> DataFrame:
    """Mean and median days between consecutive orders of a customer.

    Orders of one customer on one day are 0 days apart, so they are counted, not laid out: the window
    sees one row per customer and day. Gaps are whole days within the data range, so the median comes
    from one counter per distinct gap.
    """
    rel.require("customer_id", "purchase_date", "transaction_id")
    days = (
        rel.orders("customer_id", "order_date")
        .where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
        .groupBy("customer_id", "order_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("customer_id").orderBy("order_date")
    gaps = (
        days.select("n", F.datediff("order_date", F.lag("order_date").over(w)).alias("gap"))
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("gap").alias("gap"), F.when(F.col("gap").isNotNull(), 1).otherwise(0).alias("n")),
                    F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("n")),
                )
            ).alias("g")
        )
        .where(F.col("g.gap").isNotNull() & (F.col("g.n") > 0))
        .groupBy(F.col("g.gap").alias("gap"))
        .agg(F.sum("g.n").alias("n"))
    )
    return gaps.agg(
        ratio(F.sum(F.col("gap") * F.col("n")), F.sum("n")).alias("avg_days_between_orders"),
        F.expr("percentile(gap, 0.5, n)").alias("median_days_between_orders"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
    )


def loy_cohort_retention(rel: Relations) -> DataFrame:
    """Active customers per first-purchase month and months since, with the share of the cohort."""
    since = (F.year("month") - F.year("first_month")) * 12 + F.month("month") - F.month("first_month")
    counts = (
        _customer_months(rel)
        .groupBy(F.col("first_month").alias("cohort_month"), since.alias("months_since_first"))
        .agg(F.count(F.lit(1)).alias("active_customers"))
    )
    # One row per pair of months.
    size = F.max(F.when(F.col("months_since_first") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month")
    )
    return counts.withColumn("retention", ratio("active_customers", size)).orderBy("cohort_month", "months_since_first")


def loy_at_risk_customers(rel: Relations) -> DataFrame:
    return (
        rel.customer_rfm()
        .where(rfm.segment() == "AT_RISK")
        .select("customer_id", "recency_days", "frequency", "monetary", "rfm_score")
        .orderBy(F.desc("monetary"), "customer_id")
    )


# --- series and dimensions for display ------------------------------------------------------------


def top_n_other(df: DataFrame, key: str, value: str, n: int = 20, other: str = "__OTHER__") -> DataFrame:
    """Keep the ``n`` largest keys of a grouped frame and fold the rest into one bucket."""
    best = df.where(F.col(key).isNotNull()).orderBy(F.desc(value), key).limit(n).select(key, F.lit(True).alias("_kept"))
    return (
        df.join(F.broadcast(best), key, "left")  # at most n rows
        .groupBy(F.when(F.col("_kept"), F.col(key).cast("string")).otherwise(other).alias(key))
        .agg(F.sum(value).alias(value))
        .orderBy(F.col(key) == other, F.desc(value), key)
    )


def thin_ranks(df: DataFrame, rank: str = "rank", points: int = 1000, keep: int = 100) -> DataFrame:
    """Every k-th rank plus the first ``keep`` and the last, at most ``points`` rows in all."""
    n = df.agg(F.max(rank)).first()[0] or 0
    step = max(1, -(-max(0, n - keep) // max(1, points - keep - 1)))
    return df.where(((F.col(rank) - keep) % step == 0) | (F.col(rank) <= keep) | (F.col(rank) == n))


def thin_series(rel: Relations, points: int = 1000) -> tuple[str, DataFrame]:
    """The finest of the daily, weekly and monthly series that stays within ``points`` rows."""
    first, last = rel.bounds
    days = 0 if first is None else (last - first).days + 1
    if days <= points:
        return "DAY", time_revenue_daily(rel)
    if days // 7 + 2 <= points:
        return "WEEK", time_revenue_weekly(rel)
    return "MONTH", time_revenue_monthly(rel)


def location_totals(rel: Relations) -> DataFrame:
    """Subtotals along country, state and city with the level of each row (0 = finest)."""
    levels = [c for c in ("country", "state", "city") if rel.source.has(c)]
    if not levels:
        raise Unavailable("A geography column is required.")
    return (
        rel.tx(*levels, "revenue")
        .groupBy(*levels)  # fold to the finest level before the rows are repeated per level
        .agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("lines"))
        .rollup(*levels)
        .agg(F.grouping_id().alias("level"), F.sum("revenue").alias("revenue"), F.sum("lines").alias("lines"))
        .orderBy(*levels, "level")
    )


_TEMPLATES = {
    f.__name__: f
    for f in (
        sales_total_revenue,
        sales_total_orders,
        sales_total_quantity,
        sales_average_order_value,
        sales_avg_revenue_per_customer,
        sales_growth_latest_period,
        cust_total_customers,
        cust_new_vs_returning_monthly,
        cust_repeat_purchase_rate,
        cust_avg_customer_revenue,
        cust_avg_orders_per_customer,
        cust_top_customers,
        cust_revenue_deciles,
        cust_segment_summary,
        cust_rfm_table,
        cust_rfm_distribution,
        prod_top_by_revenue,
        prod_bottom_by_revenue,
        prod_top_by_quantity,
        prod_revenue_and_quantity,
        prod_pareto,
        cat_revenue_quantity_contribution,
        time_revenue_daily,
        time_revenue_weekly,
        time_revenue_monthly,
        time_revenue_yearly,
        time_mom_growth,
        time_yoy_growth,
        time_revenue_by_day_of_week,
        geo_customer_distribution,
        disc_band_summary,
        disc_revenue_association,
        pay_summary,
        beh_order_size_distribution,
        beh_order_quantity_distribution,
        beh_order_value_deciles,
        beh_purchase_frequency,
        beh_basket_summary,
        loy_inter_purchase_days,
        loy_cohort_retention,
        loy_at_risk_customers,
    )
} | {
    "geo_revenue_by_country": lambda rel: geo_revenue(rel, "country"),
    "geo_revenue_by_state": lambda rel: geo_revenue(rel, "state"),
    "geo_revenue_by_city": lambda rel: geo_revenue(rel, "city"),
    "geo_revenue_by_country_state": lambda rel: geo_revenue(rel, "country", "state"),
    "geo_revenue_by_country_state_city": lambda rel: geo_revenue(rel, "country", "state", "city"),
}


def _asking(name: str, build: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
    @functools.wraps(build)
    def run(rel: Relations) -> DataFrame:
        why = availability.require(name, rel.source.has)
        if why:
            raise Unavailable(why)
        return build(rel)

    return run


# A template whose roles are not mapped says so before anything is built.
TEMPLATES = {name: _asking(name, build) for name, build in _TEMPLATES.items()}
