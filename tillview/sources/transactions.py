"""The canonical transaction lines, joined only as far as the asked columns need."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lookup:
    """A table unique on ``key`` that supplies further columns."""

    key: str
    frame: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c != self.key]

    def pick(self, columns: Sequence[str]) -> DataFrame:
        return self.frame.select(self.key, *[c for c in self.columns if c in columns])


class TransactionSource:
    """Lines plus lookups. Columns whose role is not mapped are absent, never NULL-filled.

    A flat file has no lookups. Normalized tables declare them in the order they can be followed from
    the line, so ``select`` joins only what the asked columns need. A lookup whose key another one supplies
    is joined to that one first, so the lines are shuffled once for both.
    """

    def __init__(self, lines: DataFrame, lookups: Sequence[Lookup] = ()):
        self.lines = lines
        self.lookups = list(lookups)

    @property
    def columns(self) -> list[str]:
        return self.lines.columns + [c for lk in self.lookups for c in lk.columns]

    def has(self, *columns: str) -> bool:
        return set(columns) <= set(self.columns)

    def lookup(self, key: str) -> Lookup | None:
        return next((lk for lk in self.lookups if lk.key == key), None)

    def reached_from(self, key: str) -> set[str]:
        """Columns with one value per ``key``: those of its lookup and of the lookups that follow."""
        known = {key}
        for lk in self.lookups:
            if lk.key in known:
                known |= set(lk.columns)
        return known - {key}

    def select(self, *columns: str) -> DataFrame:
        need, joins = set(columns), []
        for lk in reversed(self.lookups):
            if need & set(lk.columns):
                joins.append(lk)
                need.add(lk.key)
        df = self.lines.select(*[c for c in self.lines.columns if c in need])
        picked = {lk.key: lk.pick(need) for lk in reversed(joins)}
        for lk in joins:  # from the farthest to the nearest
            nearer = [at.key for at in joins if lk.key in at.columns and self.lookups.index(at) < self.lookups.index(lk)]
            if nearer and lk.key not in self.lines.columns:
                picked[nearer[0]] = picked[nearer[0]].join(picked.pop(lk.key), lk.key, "left")
        for key, frame in picked.items():
            df = df.join(frame, key, "left")
        return df.select(*columns)


def from_flat(df: DataFrame, mapping: Mapping[str, str]) -> TransactionSource:
    """Canonical lines of one flat table, by ``{role column: source column}``.

    Revenue is price x quantity when no revenue column is mapped. A time component in the date is kept
    as ``purchase_ts``.
    """
    from tillview.operators.cleaning import standard_discount

    cols = []
    kinds = dict(df.dtypes)
    for role, source in mapping.items():
        c = F.col(source)
        if role in ("quantity", "price", "revenue"):
            c = c if kinds[source].startswith("decimal") else c.cast("decimal(18,4)")
        elif role == "purchase_date":
            ts = c.cast("timestamp")
            if kinds[source] != "date":
                cols.append(ts.alias("purchase_ts"))
            c = ts.cast("date")
        elif role == "customer_age":
            c = c.cast("int")
        cols.append(c.alias(role))
    lines = df.select(*cols)
    if "revenue" not in mapping and {"price", "quantity"} <= set(mapping):
        lines = lines.withColumn("revenue", (F.col("price") * F.col("quantity")).cast("decimal(28,4)"))
    if "discount" in mapping:
        lines = standard_discount(lines, "discount")
    return TransactionSource(lines)


# --- The benchmark tables -------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_source(spark: SparkSession, sf_dir: str) -> TransactionSource:
    """lineitem as transaction lines; orders, customer, nation, region and part as lookups."""
    read = lambda name: table(spark, sf_dir, name)
    lines = read("lineitem").select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
        (F.col("l_extendedprice").cast("decimal(13,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(3,2)")))
        .cast("decimal(18,4)")
        .alias("revenue"),
        (F.col("l_discount").cast("decimal(5,2)") * 100).cast("decimal(7,2)").alias("discount"),
    )
    headers = read("orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("purchase_date"),
        F.col("o_orderpriority").alias("payment_method"),
    )
    places = (
        read("nation")
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("state"))
    )
    buyers = (
        read("customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("c_custkey").alias("customer_id"), "country", "state", F.col("c_mktsegment").alias("city"))
    )
    goods = read("part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category")
    )
    return TransactionSource(
        lines,
        [Lookup("transaction_id", headers), Lookup("customer_id", buyers), Lookup("product_id", goods)],
    )
