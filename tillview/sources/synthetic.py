"""A retail data set with the defects the engine is meant to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Made up for this data set: category, weight in percent, products as (sku, name, price).
CATALOG = (
    ("Garden", 40, (
        ("GA-1", "Watering can, 9 litres", 640.0),
        ("GA-2", "Cordless hedge trimmer", 8900.0),
        ("GA-3", "Compost bin, larch wood", 5250.0),
        ("GA-4", "Rain gauge", 310.0),
        ("GA-5", "Folding wheelbarrow", 3780.0),
    )),
    ("Music", 25, (
        ("MU-1", "Soprano recorder, pear wood", 2150.0),
        ("MU-2", "Practice drum pad", 1420.0),
        ("MU-3", "Digital stage piano", 41500.0),
        ("MU-4", "Guitar strings, set of six", 560.0),
    )),
    ("Workshop", 18, (
        ("WO-1", "Block plane", 2690.0),
        ("WO-2", "Bench vice, 125 mm", 4880.0),
        ("WO-3", "Spirit level, 60 cm", 980.0),
        ("WO-4", "Drill bits, 19 pieces", 1330.0),
    )),
    ("Camping", 12, (
        ("CA-1", "Two-person tunnel tent", 11900.0),
        ("CA-2", "Gas stove with wind shield", 3240.0),
        ("CA-3", "Enamel mug", 270.0),
    )),
    ("Games", 5, (
        ("GM-1", "Wooden chess set", 1870.0),
        ("GM-2", "Jigsaw, 1000 pieces", 790.0),
        ("GM-3", "Dice tower", 1150.0),
        ("GM-4", "Travel backgammon", 930.0),
    )),
)
# Weighted choices; the places are made up too.
CITIES = (
    (("Harrowmere", "Lakes"), 26), (("Port Ellory", "Coast"), 21), (("Tansfield", "Plains"), 19), (("Osk", "Coast"), 13),
    (("Lower Dunnet", "Lakes"), 8), (("Quarry Hill", "Highlands"), 6), (("Saltash Bay", "Coast"), 4), (("Vell", "Plains"), 3),
)
PAYMENTS = (("UPI", 48), ("Credit Card", 31), ("Net Banking", 14), ("Cash on Delivery", 7))
QUANTITIES = ((1, 700), (2, 180), (3, 70), (4, 30), (5, 15), (8, 5))
RATINGS = ((5, 55), (4, 28), (3, 10), (2, 4), (1, 3))
DISCOUNTS = ((0.05, 1), (0.10, 1), (0.15, 1), (0.20, 1))
CUSTOMERS = 1800
OUTLIER_ROWS = (420, 888)


def _draw(seed: int, salt: int) -> Column:
    """A repeatable uniform number per row: a hash of the row id, so partitioning does not matter."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _choose(u: Column, options) -> Column:
    """The option whose slice of the cumulative weight holds ``u``."""
    total, upto, out = sum(w for _, w in options), 0, None
    for value, weight in options:
        literal = F.struct(*[F.lit(v).alias(f"_{i}") for i, v in enumerate(value)]) if isinstance(value, tuple) else F.lit(value)
        upto += weight
        out = F.when(u < upto / total, literal) if out is None else out.when(u < upto / total, literal)
    return out.otherwise(literal)


def retail(spark: SparkSession, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """One year of order lines with about 1.2 % repeats, 8 % missing ratings, 2 % padded categories and two outliers."""
    base = int(rows * 0.988)
    products = [((sku, name, c, price), w / len(items)) for c, w, items in CATALOG for sku, name, price in items]

    def u(salt):
        return _draw(seed, salt)

    # A heavy-tailed share per customer: the inverse of a Pareto distribution over the unit interval.
    who = F.least(F.lit(CUSTOMERS - 1), F.floor(F.pow(u(1), 2.5) * CUSTOMERS).cast("int"))
    late = u(3) < 0.25
    day = F.when(late, 270 + F.floor(u(2) * 95)).otherwise(F.floor(u(2) * 365))
    minute = (8 + F.floor(u(4) * 15)) * 60 + F.floor(u(5) * 60)
    item, place = _choose(u(6), products), _choose(u(7), CITIES)
    lines = (
        spark.range(base)
        .select("id", item.alias("item"), place.alias("place"), who.alias("who"), (day * 1440 + minute).alias("minute"))
        .select(
            "id",
            F.concat(F.lit("ORD-2025-"), (F.col("id") + 100000).cast("string")).alias("order_id"),
            F.date_format(
                F.timestamp_seconds(F.unix_timestamp(F.lit("2025-01-01 00:00:00")) + F.col("minute") * 60), "yyyy-MM-dd HH:mm:ss"
            ).alias("order_date"),
            F.concat(F.lit("CUST-"), (F.col("who") + 1000).cast("string")).alias("customer_id"),
            F.col("item._0").alias("product_id"),
            F.col("item._1").alias("product_name"),
            F.when(u(8) < 0.02, F.concat(F.lit(" "), "item._2", F.lit(" "))).otherwise(F.col("item._2")).alias("category"),
            F.col("item._3").alias("unit_price"),
            F.when(F.col("id").isin(*OUTLIER_ROWS), 45).otherwise(_choose(u(9), QUANTITIES)).cast("bigint").alias("quantity"),
            F.when(u(10) < 0.35, _choose(u(11), DISCOUNTS)).otherwise(F.lit(0.0)).alias("discount_pct"),
            _choose(u(12), PAYMENTS).alias("payment_method"),
            F.col("place._0").alias("city"),
            F.col("place._1").alias("region"),
            F.when(u(13) >= 0.08, _choose(u(14), RATINGS)).cast("bigint").alias("customer_rating"),
        )
        .withColumn("total_amount", F.round(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_pct")), 2))
    )
    # Repeats are copies of early rows, drawn with replacement.
    picks = spark.range(rows - base).select(F.floor(_draw(seed, 15) * min(1000, base)).cast("bigint").alias("id"))
    columns = [
        "order_id", "order_date", "customer_id", "product_id", "product_name", "category", "unit_price", "quantity",
        "discount_pct", "total_amount", "payment_method", "city", "region", "customer_rating",
    ]
    return lines.select(*columns).unionByName(lines.join(picks, "id").select(*columns))
