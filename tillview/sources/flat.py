"""The benchmark tables in the shape of one flat retail file, clean or with known defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.columns import ratio, rounded
from tillview.sources.transactions import Lookup, TransactionSource, table

COLUMNS = [
    "order_id",
    "order_date",
    "customer_id",
    "product_id",
    "product_name",
    "category",
    "unit_price",
    "quantity",
    "discount_pct",
    "total_amount",
    "payment_method",
    "city",
    "region",
    "customer_rating",
]


def flat_source(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> TransactionSource:
    """``items`` stands for the rows of lineitem, all of them unless given."""
    read = lambda name: table(spark, sf_dir, name)
    lines = (read("lineitem") if items is None else items).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        rounded(ratio("l_extendedprice", "l_quantity"), 2).alias("unit_price"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_discount").alias("discount_pct"),
        (F.col("l_extendedprice").cast("decimal(13,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(3,2)")))
        .cast("decimal(18,4)")
        .alias("total_amount"),
        F.when(F.col("l_returnflag") != "R", F.least(F.lit(5), F.floor(F.round(F.col("l_tax") * 100) / 2) + 1))
        .cast("bigint")
        .alias("customer_rating"),
        "l_returnflag",
        "l_linestatus",
        F.round(F.col("l_tax") * 100).cast("int").alias("l_tax_pct"),
    )
    headers = read("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
        F.col("o_orderpriority").alias("payment_method"),
        "o_orderstatus",
    )
    places = (
        read("nation")
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("region"))
    )
    buyers = (
        read("customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("c_custkey").alias("customer_id"), "city", "region")
    )
    goods = read("part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category")
    )
    return TransactionSource(
        lines, [Lookup("order_id", headers), Lookup("customer_id", buyers), Lookup("product_id", goods)]
    )


def flat(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return flat_source(spark, sf_dir).select(*(columns or COLUMNS))


def dirty(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """The flat table with padded categories, missing cells, wrong signs, outliers, repeats and text dates."""
    df = flat_source(spark, sf_dir, items).select(*COLUMNS, "l_returnflag", "l_linestatus", "l_tax_pct", "o_orderstatus")
    returned = F.col("l_returnflag") == "R"
    open_line = F.col("l_linestatus") == "O"
    df = df.withColumns(
        {
            "order_date": F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"),
            **{c: F.col(c).cast("string") for c in ("order_id", "customer_id", "product_id")},
            "category": F.when(returned & open_line, F.concat(F.lit(" "), "category", F.lit(" "))).otherwise(
                F.col("category")
            ),
            "payment_method": F.when(F.col("o_orderstatus") != "P", F.col("payment_method")),
            "quantity": F.when(returned & (F.col("l_tax_pct") == 8), -F.col("quantity"))
            .when(~returned & (F.col("l_tax_pct") == 0) & (F.col("discount_pct") == 0.1), F.col("quantity") * 100)
            .otherwise(F.col("quantity")),
        }
    )
    repeated = (F.col("l_returnflag") == "A") & (F.col("l_tax_pct") == 1)
    # Repeats are made of the joined rows, not by joining once more.
    times = F.when(repeated, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.select(*COLUMNS, F.explode(times).alias("_time")).drop("_time")
