"""Recency, frequency and monetary scores and the customer segments built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.columns import fixed_rows, one_row, pct, ratio, rounded
from tillview.operators.ordering import ntile_of, quantile_bin_of, ranked
from tillview.session import stage

# Segment order and labels.
SPEC_SEGMENTS = ("HIGH_VALUE", "REGULAR", "OCCASIONAL", "AT_RISK")
CODE_SEGMENTS = (("High Value", "HV"), ("Regular", "REG"), ("Occasional", "OCC"), ("At Risk", "AR"))
# Accepted column names, first present wins.
CUSTOMER_NAMES = ("customer_id", "user_id", "client_id")
DATE_NAMES = ("order_date", "date", "transaction_date")
ORDER_NAMES = ("order_id", "invoice_no")
AMOUNT_NAMES = ("total_amount", "revenue", "amount", "sales")


def score(base: DataFrame, rules: str = "spec", min_customers: int = 1) -> DataFrame:
    """1-5 scores per customer from ``customer_id, recency_days, frequency, monetary``.

    ``rules="spec"``: NTILE(5), recency descending into the score by ``6 - tile``.
    ``rules="code"``: equal-frequency bins of the rank, recency ranked from the longest ago.
    Ties are ordered by customer_id in both. The three rankings share one range shuffle: each customer
    becomes three (metric, value) rows, ranked within the metric, and one grouping brings them back.
    """
    kinds = dict(base.dtypes)
    common = "double" if kinds["monetary"] == "double" else "decimal(38,4)"
    recency = F.col("recency_days") if rules == "spec" else -F.col("recency_days")
    metrics = F.array(
        *[
            F.struct(F.lit(tag).alias("metric"), value.cast(common).alias("value"))
            for tag, value in (("r", recency), ("f", F.col("frequency")), ("m", F.col("monetary")))
        ]
    )
    rows = base.select("customer_id", F.explode(metrics).alias("m")).select("customer_id", "m.metric", "m.value")
    placed = ranked(rows, [F.col("value").asc_nulls_last(), F.col("customer_id")], within=["metric"], total="_n")
    placed = placed.where(F.col("_n") >= min_customers)
    tile = ntile_of if rules == "spec" else quantile_bin_of
    placed = placed.withColumn("tile", tile(F.col("rank"), F.col("_n"), 5))

    def pick(tag: str, name: str) -> Column:
        return F.max(F.when(F.col("metric") == tag, F.col(name)))

    wide = placed.groupBy("customer_id").agg(
        pick("r", "value").alias("recency_days"),
        pick("f", "value").cast("bigint").alias("frequency"),
        pick("m", "value").cast(kinds["monetary"]).alias("monetary"),
        *[pick(tag, "tile").alias(f"{tag}_score") for tag in "rfm"],
    )
    sign = 1 if rules == "spec" else -1
    r = (6 - F.col("r_score")) if rules == "spec" else F.col("r_score")
    # Scores are read by many queries and several times by some, so they are written once.
    return stage(
        wide.withColumn("recency_days", (F.col("recency_days") * sign).cast("int"))
        .withColumn("r_score", r)
        .withColumn("rfm_score", F.concat(*[F.col(f"{t}_score").cast("string") for t in "rfm"]))
    )


def segment(rules: str = "spec") -> Column:
    """First matching rule wins; every customer gets exactly one segment."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    if rules == "spec":
        return (
            F.when((r <= 2) & (f >= 3), "AT_RISK")
            .when((f >= 4) & (m >= 4), "HIGH_VALUE")
            .when((f >= 3) | (m >= 3), "REGULAR")
            .otherwise("OCCASIONAL")
        )
    return (
        F.when((r >= 4) & (f >= 4), "High Value")
        .when(r <= 2, "At Risk")
        .when((r >= 4) & (f <= 2), "Occasional")
        .otherwise("Regular")
    )


def segment_order(c: str = "segment") -> Column:
    order = F.lit(len(SPEC_SEGMENTS))
    for i, name in reversed(list(enumerate(SPEC_SEGMENTS, 1))):
        order = F.when(F.col(c) == name, i).otherwise(order)
    return order


def flat_base(df: DataFrame) -> DataFrame | None:
    """The score inputs of a flat table by the accepted column names; None when one is lacking."""
    def first(names):
        return next((n for n in names if n in df.columns), None)

    who, when, order, amount = map(first, (CUSTOMER_NAMES, DATE_NAMES, ORDER_NAMES, AMOUNT_NAMES))
    if not (who and when and amount):
        return None
    moment = F.col(when).cast("timestamp")
    last_seen = one_row(df.agg(F.max(moment).alias("m")), "m")
    people = (
        df.where(F.col(who).isNotNull())
        .groupBy(F.col(who).alias("customer_id"))
        .agg(
            F.max(moment).alias("last"),
            (F.count_distinct(order) if order else F.count(F.lit(1))).alias("frequency"),
            F.sum(amount).alias("monetary"),
        )
    )
    day = 86_400_000_000
    gap = F.unix_micros(last_seen) + day - F.unix_micros("last")
    return people.select("customer_id", F.floor(gap / day).cast("int").alias("recency_days"), "frequency", "monetary")


def customer_table(scored: DataFrame) -> DataFrame:
    """Drill-down rows: order value per customer, largest spend first."""
    return scored.select(
        "customer_id",
        "recency_days",
        F.col("frequency").alias("frequency_orders"),
        rounded(F.col("monetary"), 2).alias("total_spend"),
        rounded(ratio("monetary", F.greatest(F.lit(1), F.col("frequency"))), 2).alias("aov"),
        "r_score",
        "f_score",
        "m_score",
        segment("code").alias("segment"),
    ).orderBy(F.desc("total_spend"), "customer_id")


def segment_table(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """All four segments with size, revenue, order value and mean recency and frequency."""
    names = fixed_rows(
        spark, [(i, n, c) for i, (n, c) in enumerate(CODE_SEGMENTS)], "position int, segment string, code string"
    )
    totals = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("monetary").alias("revenue"))
    grouped = (
        scored.withColumn("segment", segment("code"))
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("monetary").alias("revenue"),
            F.sum("frequency").alias("orders"),
            F.sum("recency_days").alias("recency"),
        )
    )
    zero = F.lit(0)
    return (
        names.join(grouped, "segment", "left")
        .select(
            "position",
            "segment",
            "code",
            F.coalesce("customers", zero).alias("customer_count"),
            pct("customers", one_row(totals, "n")).alias("customer_pct"),
            rounded(F.coalesce(F.col("revenue"), F.lit(0.0)), 2).alias("total_revenue"),
            pct("revenue", one_row(totals, "revenue")).alias("revenue_pct"),
            F.coalesce(rounded(ratio("revenue", "orders"), 2), F.lit(0.0)).alias("avg_order_value"),
            F.coalesce(rounded(ratio("recency", "customers"), 1), F.lit(0.0)).alias("avg_recency_days"),
            F.coalesce(rounded(ratio("orders", "customers"), 1), F.lit(0.0)).alias("avg_frequency"),
        )
        .orderBy("position")
        .drop("position")
    )


def grid(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """All 25 recency x frequency cells, also the empty ones."""
    cells = spark.range(25).select(
        (F.lit(5) - F.floor(F.col("id") / 5)).cast("int").alias("r"), (F.col("id") % 5 + 1).cast("int").alias("f")
    )
    total = one_row(scored.agg(F.count(F.lit(1)).alias("n")), "n")
    found = scored.groupBy(F.col("r_score").alias("r"), F.col("f_score").alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("monetary").alias("revenue")
    )
    return (
        cells.join(found, ["r", "f"], "left")
        .select(
            "r",
            "f",
            F.coalesce("n", F.lit(0)).alias("count"),
            rounded(F.coalesce(F.col("revenue"), F.lit(0.0)), 2).alias("revenue"),
            pct("n", total).alias("percentage"),
        )
        .orderBy(F.desc("r"), "f")
    )


def filter_segment(customers: DataFrame, name: str = "all", rows: int = 100) -> DataFrame:
    """Top spenders of one segment, matched without regard to case."""
    if name.lower() != "all":
        customers = customers.where(F.lower("segment") == name.lower())
    return customers.orderBy(F.desc("total_spend"), "customer_id").limit(rows)
