"""Findings that rest on computed figures only, and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.columns import fixed_rows, one_row, rounded
from tillview.operators.catalog import pareto_summary

_FIELDS = "id", "category", "severity", "evidence_key", "finding", "impact"


def _money(c: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(c, 2))


def _text(c: Column) -> Column:
    return c.cast("string")


def _row(df: DataFrame, number: str, category: str, severity: str, key: str, finding: list, impact: list) -> DataFrame:
    parts = [[F.lit(p) if isinstance(p, str) else p for p in text] for text in (finding, impact)]
    return df.select(
        F.lit(number).alias("id"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        F.lit(key).alias("evidence_key"),
        F.concat(*parts[0]).alias("finding"),
        F.concat(*parts[1]).alias("impact"),
    )


def findings(segments: DataFrame, products: DataFrame, payments: DataFrame, quality: DataFrame, kpi: DataFrame) -> DataFrame:
    """Five rules over the segment table, the product table, the payments and the quality profile.

    Each rule reads a table of one row (a segment, a summary, a payment method) and yields a row only
    when that row exists; every number in the text is a column of it.
    """
    c = F.col
    high = segments.where("segment = 'High Value'")
    risk = segments.where("segment = 'At Risk'")
    best = products.where("rank = 1").select("product_name", "revenue", "revenue_pct")
    pareto = pareto_summary(products).select("*", *[one_row(best, n).alias(n) for n in best.columns])
    digital = payments.where(F.upper("payment_method").contains("UPI")).orderBy(F.desc("total_revenue")).limit(1)
    name = F.upper("payment_method")
    cash = payments.where(name.contains("COD") | name.contains("CASH")).agg(F.max("revenue_pct").alias("cash_pct"))
    hygiene = quality.withColumn("average_order_value", one_row(kpi, "average_order_value"))
    rows = [
        _row(
            high,
            "INS-01",
            "CUSTOMER",
            "CRITICAL",
            "high_value_concentration",
            [
                F.format_number("customer_count", 0),
                " high-value customers, ",
                _text(c("customer_pct")),
                "% of all, bring ",
                _text(c("revenue_pct")),
                "% of revenue (",
                _money(c("total_revenue")),
                ").",
            ],
            ["Losing 5% of this segment would cost ", _money(c("total_revenue") * 0.05), "."],
        ),
        _row(
            risk,
            "INS-02",
            "RISK",
            "HIGH",
            "at_risk_churn",
            [
                F.format_number("customer_count", 0),
                " customers (",
                _text(c("customer_pct")),
                "%) last bought ",
                F.format_number("avg_recency_days", 0),
                " days ago on average; their past revenue is ",
                _money(c("total_revenue")),
                ".",
            ],
            ["Revenue at risk: ", _money(c("total_revenue")), "."],
        ),
        _row(
            pareto,
            "INS-03",
            "PRODUCT",
            "HIGH",
            "product_pareto",
            [
                _text(c("top_80_skus")),
                " of ",
                _text(c("total_skus")),
                " products (",
                _text(c("sku_pct")),
                "%) make up 80% of revenue; the first, ",
                c("product_name"),
                ", makes ",
                _money(c("revenue")),
                " (",
                _text(c("revenue_pct").cast("double")),
                "%).",
            ],
            ["A stockout of these products hits most of the revenue."],
        ),
        _row(
            digital.withColumn("cash_pct", one_row(cash, "cash_pct")),
            "INS-04",
            "REVENUE",
            "POSITIVE",
            "upi_dominance",
            [
                c("payment_method"),
                " carries ",
                _text(c("revenue_pct")),
                "% of revenue (",
                _money(c("total_revenue")),
                "); cash carries ",
                F.coalesce(_text(c("cash_pct")), F.lit("0.0")),
                "%.",
            ],
            ["Fees of 1.8% avoided: ", _money(c("total_revenue") * 0.018), "."],
        ),
        _row(
            hygiene,
            "INS-05",
            "DATA_QUALITY",
            "INFO",
            "data_quality_audit",
            [
                F.format_number("duplicate_rows", 0),
                " repeated rows and ",
                F.format_number("null_cells", 0),
                " missing cells were found; the quality score is ",
                _text(c("overall_score")),
                "/100.",
            ],
            ["Revenue not counted twice: ", _money(c("duplicate_rows") * c("average_order_value")), "."],
        ),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select(*_FIELDS).orderBy("id")


# Rule, theme, metric, member it is about, least value, whether it is only an association.
RULES = (
    ("high_value_revenue_concentration", "CUSTOMERS", "segment_revenue_share", "HIGH_VALUE", 0.25, False),
    ("at_risk_revenue", "CUSTOMERS", "segment_revenue_share", "AT_RISK", 0.10, False),
    ("repeat_purchasing", "CUSTOMERS", "repeat_purchase_rate", None, 0.30, False),
    ("revenue_trend", "TIME", "revenue_growth", None, 0.02, False),
    ("order_trend", "TIME", "order_growth", None, 0.02, False),
    ("discount_and_revenue", "DISCOUNT", "discount_revenue_correlation", None, 0.01, True),
)


def ranked_insights(metrics: DataFrame) -> DataFrame:
    """The rules whose metric reaches its threshold, by the size of the figure.

    ``metrics``: (metric_name, member, value). A rule without a metric yields nothing, so every insight
    refers to at least one.
    """
    rules = fixed_rows(
        metrics.sparkSession,
        RULES,
        "rule_key string, theme string, metric_name string, about string, least double, is_association boolean",
    )
    value = F.col("value").cast("double")
    found = (
        metrics.join(F.broadcast(rules), "metric_name")  # the fixed rules above
        .where(F.coalesce("about", F.lit("")) == F.coalesce("member", F.lit("")))
        .where(F.abs(value) >= F.col("least"))
    )
    best = found.agg(F.sort_array(F.collect_set(F.abs(value)), asc=False).alias("sizes"))  # at most one per rule
    return found.select(
        "rule_key",
        "theme",
        "metric_name",
        "member",
        rounded(value, 6).alias("value"),
        "is_association",
        F.array_position(one_row(best, "sizes"), F.abs(value)).cast("int").alias("impact_rank"),
    ).orderBy("impact_rank", "rule_key")
