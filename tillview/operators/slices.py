"""Key figures, trend and category split of one time slice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.columns import monday_week_label, of_groups, one_row, ratio, rounded

# Months of the quarter presets; the year is not looked at.
QUARTERS = {"q1": (1, 2, 3), "q2": (4, 5, 6), "q3": (7, 8, 9), "q4": (10, 11, 12)}


def time_slice(
    df: DataFrame,
    preset: str = "all",
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    date: str = "order_date",
) -> DataFrame:
    """Rows of one preset: all, last_30_days (before the newest date), q1..q4, custom(start, end)."""
    day = F.col(date).cast("date")
    if preset == "last_30_days":
        newest = one_row(df.agg(F.max(day).alias("d")), "d")
        return df.where(day >= F.date_sub(newest, 30))
    if preset in QUARTERS:
        return df.where(F.month(day).isin(*QUARTERS[preset]))
    if preset == "custom":
        if start is not None:
            df = df.where(day >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(day <= F.lit(end).cast("date"))
        return df
    if preset != "all":
        raise ValueError(f"unknown preset {preset!r}")
    return df


def key_figures(df: DataFrame) -> DataFrame:
    """Revenue, distinct orders and customers, order value and rows of a slice; zeros when it is empty."""
    revenue = F.sum("total_amount").cast("double")
    orders = F.count_distinct("order_id")
    zero = F.lit(0.0)
    return df.agg(
        F.coalesce(rounded(revenue, 2), zero).alias("total_revenue"),
        orders.alias("total_orders"),
        F.count_distinct("customer_id").alias("total_customers"),
        F.coalesce(rounded(ratio(revenue, orders), 2), zero).alias("average_order_value"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def _period(grain: str, date: str) -> Column:
    day = F.col(date).cast("date")
    if grain == "daily":
        return F.date_format(day, "yyyy-MM-dd")
    if grain == "weekly":
        return monday_week_label(day)
    return F.date_format(day, "yyyy-MM")


def trend(df: DataFrame, grain: str = "monthly", date: str = "order_date") -> DataFrame:
    return (
        df.groupBy(_period(grain, date).alias("period"))
        .agg(
            rounded(F.sum("total_amount"), 2).alias("revenue"),
            F.count_distinct("order_id").alias("orders"),
        )
        .orderBy("period")
    )


def category_split(df: DataFrame) -> DataFrame:
    """Revenue, orders and the percentage of the slice per category, to one decimal."""
    groups = df.groupBy("category").agg(F.sum("total_amount").alias("r"), F.count_distinct("order_id").alias("orders"))
    return groups.select(
        "category",
        rounded(F.col("r").cast("double"), 2).alias("revenue"),
        "orders",
        rounded(ratio(F.col("r").cast("double") * 100, of_groups("r")), 1).alias("pct"),
    ).orderBy(F.desc("revenue"), "category")
