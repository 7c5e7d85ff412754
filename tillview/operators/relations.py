"""The relations queries are written against, derived from the transaction lines."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.columns import fixed_rows
from tillview.operators import rfm
from tillview.session import stage
from tillview.sources.transactions import TransactionSource


class Unavailable(Exception):
    """A relation or query whose roles are not mapped; carries the reason shown to the user."""


class Relations:
    """Views over one version of a dataset.

    Aggregation comes before lookups wherever a lookup is keyed by the grouping key, so a key holding a
    large share of the lines is folded to one row per map task before anything is joined.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: TransactionSource,
        *,
        reference_date: dt.date | None = None,
        currency: str = "INR",
        rfm_min_customers: int = 20,
        revenue_is_derived: bool = False,
    ):
        self.spark = spark
        self.source = source
        self.currency = currency
        self.rfm_min_customers = rfm_min_customers
        self.revenue_is_derived = revenue_is_derived
        self._reference_date = reference_date
        self._kept: dict[str, DataFrame] = {}

    def require(self, *roles: str) -> None:
        lacking = [r for r in roles if not self.source.has(r)]
        if lacking:
            raise Unavailable(f"Required columns are not mapped: {', '.join(lacking)}.")

    # --- lines and parameters ---------------------------------------------------------------------

    def tx(self, *columns: str) -> DataFrame:
        self.require(*columns)
        return self.source.select(*columns)

    def per_order(self, *columns: str) -> tuple[DataFrame, Column]:
        """Lines folded to one row per transaction, where the asked columns allow it, and how orders are counted.

        With headers in a table of their own, customer, date, payment and place have one value per
        transaction. Revenue and quantity are then summed per transaction before anything is joined, and
        orders are rows. Otherwise the lines come as they are and orders are distinct ids. Either way sums
        and distinct counts over any of the columns are the same.
        """
        self.require(*columns)
        sums = [c for c in ("revenue", "quantity") if c in columns]
        attributes = set(columns) - {"transaction_id", *sums}
        if not (self.source.lookup("transaction_id") and attributes <= self.source.reached_from("transaction_id")):
            return self.tx(*columns), F.count_distinct("transaction_id")
        lines = self.source.lines.select("transaction_id", *sums)
        folded = lines.groupBy("transaction_id").agg(*[F.sum(c).alias(c) for c in sums]) if sums else lines.distinct()
        return TransactionSource(folded, self.source.lookups).select(*columns), F.count("transaction_id")

    def transactions(self) -> DataFrame:
        return self.source.select(*self.source.columns)

    @cached_property
    def bounds(self) -> tuple[dt.date | None, dt.date | None]:
        """First and last purchase date: two values, read once."""
        row = self.per_order("purchase_date")[0].agg(F.min("purchase_date"), F.max("purchase_date")).first()
        return row[0], row[1]

    @property
    def reference_date(self) -> dt.date | None:
        if self._reference_date or self.bounds[1] is None:
            return self._reference_date
        return self.bounds[1] + dt.timedelta(days=1)

    @property
    def frequency_basis(self) -> str:
        return "ORDERS" if self.source.has("transaction_id") else "ROWS"

    def run_params(self) -> DataFrame:
        first, last = self.bounds
        return fixed_rows(
            self.spark,
            [
                (
                    self.reference_date,
                    first,
                    last,
                    self.currency,
                    self.rfm_min_customers,
                    self.revenue_is_derived,
                    self.frequency_basis,
                )
            ],
            "reference_date date, data_min_date date, data_max_date date, currency string,"
            " rfm_min_customers int, revenue_is_derived boolean, frequency_basis string",
        )

    def calendar(self) -> DataFrame:
        """One row per day between the first and the last purchase."""
        first, last = self.bounds
        days = 0 if first is None else (last - first).days + 1
        d = F.col("date")
        lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
        year_start, year_end = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
        return (
            self.spark.range(0, days, 1, 1)
            .select(F.date_add(lo, F.col("id").cast("int")).alias("date"))
            .select(
                d,
                F.year(d).alias("year"),
                F.quarter(d).alias("quarter"),
                F.month(d).alias("month"),
                F.trunc(d, "month").alias("month_start"),
                F.last_day(d).alias("month_end"),
                F.trunc(d, "week").alias("week_start"),
                (F.weekday(d) + 1).alias("day_of_week"),
                (F.weekday(d) >= 5).alias("is_weekend"),
            )
            .select(
                "*",
                ((lo <= F.col("month_start")) & (hi >= F.col("month_end"))).alias("month_is_complete"),
                ((lo <= F.col("week_start")) & (hi >= F.date_add("week_start", 6))).alias("week_is_complete"),
                ((lo <= year_start) & (hi >= year_end)).alias("year_is_complete"),
            )
        )

    # --- grouped relations ------------------------------------------------------------------------

    def keep(self, *names: str) -> Relations:
        """Write grouped relations once when many queries follow; they are read from there afterwards."""
        for name in names:
            if name not in self._kept:
                try:
                    self._kept[name] = stage(getattr(self, name)())
                except Unavailable:
                    continue
        return self

    def orders(self, *columns: str) -> DataFrame:
        """One row per transaction. ``columns`` narrows the output; the default is all that are mapped."""
        self.require("transaction_id", "revenue")
        made = {
            "order_revenue": ("revenue", lambda: F.sum("revenue")),
            "order_quantity": ("quantity", lambda: F.sum("quantity")),
            "line_count": ("transaction_id", lambda: F.count(F.lit(1))),
        }
        headers = {"customer_id": "customer_id", "order_date": "purchase_date"}
        wanted = [
            c
            for c in (columns or ["customer_id", "order_date", *made])
            if c != "transaction_id" and self.source.has(made[c][0] if c in made else headers[c])
        ]
        if "orders" in self._kept:
            return self._kept["orders"].select("transaction_id", *wanted)
        lookup = self.source.lookup("transaction_id")
        late = [c for c in wanted if c in headers and lookup and headers[c] in lookup.columns]
        early = [c for c in wanted if c in headers and c not in late]
        sums = [c for c in wanted if c in made]
        inputs = {"transaction_id", *[made[c][0] for c in sums], *[headers[c] for c in early]}
        out = (
            self.tx(*sorted(inputs))
            .where(F.col("transaction_id").isNotNull())
            .groupBy("transaction_id")
            .agg(
                F.count(F.lit(1)).alias("_lines"),
                *[made[c][1]().alias(c) for c in sums],
                *[F.min(headers[c]).alias(c) for c in early],
            )
        )
        if late:
            found = lookup.pick([headers[c] for c in late])
            out = out.join(found.select("transaction_id", *[F.col(headers[c]).alias(c) for c in late]), "transaction_id", "left")
        return out.select("transaction_id", *wanted)

    def customers(self, *columns: str) -> DataFrame:
        """One row per customer. ``columns`` narrows the output."""
        self.require("customer_id")
        has = self.source.has
        made = {
            "first_purchase_date": ("purchase_date", "order_date", F.min),
            "last_purchase_date": ("purchase_date", "order_date", F.max),
            "order_count": (None, None, None),
            "total_revenue": ("revenue", "order_revenue", F.sum),
            "total_quantity": ("quantity", "order_quantity", F.sum),
        }
        wanted = [c for c in (columns or made) if c != "customer_id" and (made[c][0] is None or has(made[c][0]))]
        if "customers" in self._kept:
            return self._kept["customers"].select("customer_id", *wanted)
        values = [c for c in wanted if made[c][0]]
        lookup = self.source.lookup("transaction_id")
        if lookup and has("revenue") and {"customer_id", "purchase_date"} <= set(lookup.columns):
            # Every order has one customer and one date: fold the lines to orders first.
            lines = self.orders("customer_id", *dict.fromkeys(made[c][1] for c in values))
            aggs, count = [made[c][2](made[c][1]).alias(c) for c in values], F.count(F.lit(1))
        else:
            inputs = dict.fromkeys(["customer_id", *[made[c][0] for c in values]])
            by_order = "order_count" in wanted and has("transaction_id")
            lines = self.tx(*inputs, *(["transaction_id"] if by_order else []))
            aggs = [made[c][2](made[c][0]).alias(c) for c in values]
            count = F.count_distinct("transaction_id") if by_order else F.count(F.lit(1))
        if "order_count" in wanted:
            aggs.append(count.alias("order_count"))
        lines = lines.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
        return (lines.agg(*aggs) if aggs else lines.agg(F.count(F.lit(1)))).select("customer_id", *wanted)

    def products(self, *columns: str) -> DataFrame:
        """One row per product: id, or name when no id is known."""
        ids = [c for c in ("product_id", "product_name") if self.source.has(c)]
        if not ids:
            raise Unavailable("A product identifier or name is required.")
        made = {
            "product_name": ("product_name", F.min),
            "category": ("category", F.min),
            "total_revenue": ("revenue", F.sum),
            "total_quantity": ("quantity", F.sum),
            "order_count": ("transaction_id", F.count_distinct),
        }
        wanted = [c for c in (columns or made) if c != "product_key" and self.source.has(made[c][0])]
        if "products" in self._kept:
            return self._kept["products"].select("product_key", *wanted)
        lookup = self.source.lookup("product_id")
        if lookup:
            late = [c for c in wanted if c in lookup.columns]
            early = [c for c in wanted if c not in late]
            inputs = dict.fromkeys(["product_id", *[made[c][0] for c in early]])
            out = (
                self.tx(*inputs)
                .where(F.col("product_id").isNotNull())
                .groupBy("product_id")
                .agg(F.count(F.lit(1)).alias("_lines"), *[made[c][1](made[c][0]).alias(c) for c in early])
            )
            if late:
                out = out.join(lookup.pick(late), "product_id", "left")
            return out.select(F.col("product_id").alias("product_key"), *wanted)
        key = F.coalesce(*[F.col(c).cast("string") if len(ids) > 1 else F.col(c) for c in ids])
        inputs = dict.fromkeys([*ids, *[made[c][0] for c in wanted]])
        return (
            self.tx(*inputs)
            .withColumn("product_key", key)
            .where(F.col("product_key").isNotNull())
            .groupBy("product_key")
            .agg(F.count(F.lit(1)).alias("_lines"), *[made[c][1](made[c][0]).alias(c) for c in wanted])
            .select("product_key", *wanted)
        )

    # --- customer scores --------------------------------------------------------------------------

    def rfm_base(self) -> DataFrame:
        """recency in days to the reference date, order count and revenue per customer."""
        self.require("customer_id", "purchase_date", "revenue")
        people = self.customers("last_purchase_date", "order_count", "total_revenue")
        return people.select(
            "customer_id",
            F.datediff(F.lit(self.reference_date), "last_purchase_date").alias("recency_days"),
            F.col("order_count").alias("frequency"),
            F.col("total_revenue").alias("monetary"),
        )

    @cached_property
    def _scores(self) -> dict[str, DataFrame]:
        return {}

    def customer_rfm(self, rules: str = "spec") -> DataFrame:
        if rules not in self._scores:
            self._scores[rules] = rfm.score(self.rfm_base(), rules=rules, min_customers=self.rfm_min_customers)
        return self._scores[rules]

    def customer_segments(self, rules: str = "spec") -> DataFrame:
        return self.customer_rfm(rules).select("customer_id", rfm.segment(rules).alias("segment"))

    # --- SQL --------------------------------------------------------------------------------------

    def register(self) -> list[str]:
        """Register every available relation as a temporary view; ``retail_sales`` and ``sales`` alias the lines."""
        lines = self.transactions()
        views = {"transactions": lines, "retail_sales": lines, "sales": lines, "run_params": None, "calendar": None}
        if self.source.has("purchase_date"):
            views |= {"run_params": self.run_params(), "calendar": self.calendar()}
        for name in ("orders", "customers", "products", "customer_rfm", "customer_segments"):
            try:
                views[name] = getattr(self, name)()
            except Unavailable:
                views[name] = None
        for name, df in views.items():
            if df is not None:
                df.createOrReplaceTempView(name)
        return [name for name, df in views.items() if df is not None]
