"""Product concentration and payment shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.functions.columns import of_groups, one_row, pct, ratio, rounded
from tillview.operators.ordering import ranked
from tillview.sources.transactions import TransactionSource

PARETO_PCT = 80


def product_table(source: TransactionSource) -> DataFrame:
    """Units, revenue, share, cumulative share and the top-80 flag per product, largest first.

    The cumulative share adds the shares after rounding, so the product that crosses 80 is not flagged.
    """
    about = ["product_name", "category"]
    late = [c for c in about if source.lookup("product_id") and c in source.lookup("product_id").columns]
    keys = ["product_id", *[c for c in about if c not in late]]
    lines = source.select(*keys, "total_amount", "quantity")
    sums = (
        lines.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        .groupBy(*keys)
        .agg(F.sum("total_amount").alias("revenue"), F.sum("quantity").alias("units_sold"))
    )
    if late:
        sums = sums.join(source.lookup("product_id").pick(late), "product_id").dropna(subset=late)
    total = one_row(source.select("total_amount").agg(F.sum("total_amount").alias("t")), "t")
    shares = sums.withColumn("revenue_pct", rounded(ratio("revenue", total) * 100, 2).cast("decimal(9,2)"))
    order = [F.desc("revenue"), *[F.col(k) for k in ["product_id", *about]]]
    return ranked(shares, order, running={"cumulative_revenue_pct": "revenue_pct"}).select(
        "rank",
        F.col("product_id").alias("sku"),
        *about,
        F.col("units_sold").cast("bigint").alias("units_sold"),
        rounded(F.col("revenue"), 2).alias("revenue"),
        "revenue_pct",
        "cumulative_revenue_pct",
        (F.col("cumulative_revenue_pct") <= PARETO_PCT).alias("is_pareto_top_80"),
    )


def pareto_summary(products: DataFrame) -> DataFrame:
    flagged, all_skus = F.count_if("is_pareto_top_80"), F.count(F.lit(1))
    return products.agg(
        flagged.alias("top_80_skus"), all_skus.alias("total_skus"), pct(flagged, all_skus, 1).alias("sku_pct")
    )


def payment_table(df: DataFrame) -> DataFrame:
    """Rows, revenue and share of revenue per payment method."""
    groups = df.groupBy("payment_method").agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("total_amount").alias("revenue"))
    return (
        groups.select(
            "payment_method",
            "transaction_count",
            rounded(F.col("revenue"), 2).alias("total_revenue"),
            pct("revenue", of_groups("revenue")).alias("revenue_pct"),
        )
        .where("payment_method IS NOT NULL")  # the rows without one count in the total
        .orderBy(F.desc("total_revenue"), "payment_method")
    )
