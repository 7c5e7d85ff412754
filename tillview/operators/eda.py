"""Exploratory statistics: summaries, histograms, breakdowns, correlations, samples, chart choice."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillview.functions.columns import fixed_rows, numeric_columns, of_groups, pct, rounded
from tillview.operators.ordering import quantiles, ranked
from tillview.operators.templates import pearson
from tillview.session import stage

# Columns with a histogram, and columns with a breakdown.
HISTOGRAM_COLUMNS = ("total_amount", "quantity", "unit_price", "discount_pct")
BREAKDOWN_COLUMNS = ("category", "payment_method", "region")


def number(c: str) -> Column:
    """A numeric column as DOUBLE with NaN as NULL."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def adjusted_skewness(x: Column) -> Column:
    """Sample skewness (adjusted Fisher-Pearson); NULL below three values or without spread."""
    n = F.count(x)
    fix = F.sqrt(n * (n - 1).cast("double")) / F.nullif(n - 2, F.lit(0))
    return F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * fix)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, quartiles, range and skewness per numeric column, to two decimals."""
    columns = list(columns or numeric_columns(df))
    cut = quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(columns):
        x = number(c)
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), adjusted_skewness(x).alias(f"skew{i}")]
    row = df.agg(*aggs).first()
    rows = [
        (
            c,
            cut[c]["n"],
            row[f"mean{i}"],
            row[f"std{i}"] or 0.0,
            cut[c]["min"],
            cut[c][0.25],
            cut[c][0.5],
            cut[c][0.75],
            cut[c]["max"],
            row[f"skew{i}"] or 0.0,
        )
        for i, c in enumerate(columns)
        if cut[c]["n"]
    ]
    figures = ["mean", "std", "min", "q25", "median", "q75", "max", "skewness"]
    out = fixed_rows(df.sparkSession, rows, "column string, count bigint, " + ", ".join(f"{n} double" for n in figures))
    return out.select("column", "count", *[rounded(n, 2).alias(n) for n in figures])


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width bins over the range of each column, the last one closed; empty bins appear.

    Two scans: the ranges, then one counter per bin. Nothing but the counters is shuffled.
    """
    columns = [c for c in (columns or HISTOGRAM_COLUMNS) if c in df.columns]
    ends = df.agg(*[f(number(c)).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.min, F.max)]).first()
    edges: dict[str, list[float]] = {}
    for i, c in enumerate(columns):
        lo, hi = ends[f"min{i}"], ends[f"max{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        edges[c] = [lo + width * k for k in range(bins)] + [hi]
    if not edges:
        return fixed_rows(df.sparkSession, [], "column string, bin int, bin_start double, bin_end double, count bigint")
    aggs = []
    for i, (c, e) in enumerate(edges.items()):
        x = number(c)
        for k in range(bins):
            top = x <= e[k + 1] if k == bins - 1 else x < e[k + 1]
            aggs.append(F.count_if((x >= e[k]) & top).alias(f"h{i}_{k}"))
    row = df.agg(*aggs).first()
    rows = [
        (c, k + 1, e[k], e[k + 1], row[f"h{i}_{k}"]) for i, (c, e) in enumerate(edges.items()) for k in range(bins)
    ]
    out = fixed_rows(df.sparkSession, rows, "column string, bin int, bin_start double, bin_end double, count bigint")
    return out.withColumns({n: rounded(n, 2) for n in ("bin_start", "bin_end")})


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """Rows and revenue per value of a column with their percentages of all rows and all revenue."""
    groups = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"), F.sum("total_amount").alias("_r"))
    return (
        groups.select(
            F.lit(column).alias("column"),
            "value",
            "count",
            pct("count", of_groups("count")).alias("percentage"),
            rounded(F.col("_r"), 2).alias("revenue"),
            pct("_r", of_groups("_r")).alias("revenue_pct"),
        )
        .where("value IS NOT NULL")  # the group without a value counts in the totals
        .orderBy(F.desc("revenue"), "value")
    )


def monthly_revenue(df: DataFrame, date: str = "order_date") -> DataFrame:
    """Revenue, distinct orders and order value per month present in the data."""
    revenue = F.sum("total_amount").cast("double")
    orders = F.count_distinct("order_id") if "order_id" in df.columns else F.count(F.lit(1))
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.date_format(F.col(date).cast("timestamp"), "yyyy-MM").alias("month"))
        .agg(
            rounded(revenue, 2).alias("revenue"),
            orders.alias("orders"),
            F.coalesce(rounded(F.try_divide(revenue, orders.cast("double")), 2), F.lit(0.0)).alias("aov"),
        )
        .orderBy("month")
    )


def pearson_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete correlations to three decimals; pairs without a value are left out."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations_with_replacement(columns, 2))
    data = df.select(*[number(c).alias(c) for c in columns])
    row = data.agg(*[pearson(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    rows = []
    for i, (a, b) in enumerate(pairs):
        if row[f"p{i}"] is not None:
            rows += [(a, b, row[f"p{i}"])] + ([(b, a, row[f"p{i}"])] if a != b else [])
    out = fixed_rows(df.sparkSession, rows, "x string, y string, correlation double")
    return out.withColumn("correlation", rounded("correlation", 3))


_PAIRS_AT_ONCE = 40


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns over the rows where both are present; ties share a rank.

    Equal rows are one, with their number. A column is ranked once for all partners that are missing in the same rows of it: once
    altogether where nothing is missing. All these rankings share one range shuffle of distinct values; ranks then come back to
    their rows as one array a row, and the sums of all pairs are taken from it without a further shuffle. The driver
    sees one count for each pattern of missing columns.
    """
    pairs = list(combinations(columns, 2))
    data = df.select(*[number(c).alias(c) for c in columns])
    bits = [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0).cast("long") for i, c in enumerate(columns)]
    present = functools.reduce(lambda a, b: a + b, bits)
    rows = data.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("present", present)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    patterns = {r["present"]: r["n"] for r in rows.groupBy("present").agg(F.sum("n").alias("n")).collect()}
    # Rankings: a column, and which rows of it count; partners that agree on these share one.
    slots: dict[tuple[int, frozenset[int]], int] = {}
    slot_of = {}
    for a in range(len(columns)):
        for b in range(len(columns)):
            if a != b:
                counted = frozenset(m for m in patterns if m >> a & 1 and m >> b & 1)
                slot_of[a, b] = slots.setdefault((a, counted), len(slots))
    entries = [
        F.when(F.col("present").isin(*counted), F.struct(F.lit(slot).alias("slot"), F.col(columns[a]).alias("v"))) for (a, counted), slot in slots.items() if counted
    ]
    if not entries:
        return fixed_rows(df.sparkSession, [], "x string, y string, correlation double")
    cells = rows.select("row", "n", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("row", "n", "e.slot", "e.v")
    values = cells.groupBy("slot", "v").agg(F.sum("n").alias("n"))
    placed = ranked(values, [F.col("v")], within=["slot"], running={"upto": "n"})
    mid = placed.select("slot", "v", (F.col("upto") - (F.col("n") - 1) / 2).alias("r"))
    ranks = cells.join(mid, ["slot", "v"]).groupBy("row", "n").agg(F.map_from_entries(F.collect_list(F.struct("slot", "r"))).alias("r"))
    ranks = stage(ranks.select("n", *[F.try_element_at("r", F.lit(slot)).alias(f"r{slot}") for slot in range(len(slots))]))
    out = []
    for at in range(0, len(pairs), _PAIRS_AT_ONCE):
        sums = []
        for i, (x, y) in enumerate(pairs[at : at + _PAIRS_AT_ONCE]):
            a, b = columns.index(x), columns.index(y)
            size = sum(n for m, n in patterns.items() if m >> a & 1 and m >> b & 1)
            # Ranks of a side average (size + 1) / 2, whatever the ties.
            both = F.col(f"r{slot_of[b, a]}").isNotNull() & F.col(f"r{slot_of[a, b]}").isNotNull()
            dx, dy = (F.when(both, F.col(f"r{s}") - (size + 1) / 2) for s in (slot_of[a, b], slot_of[b, a]))
            products = (F.sum(F.col("n") * p * q) for p, q in ((dx, dy), (dx, dx), (dy, dy)))
            xy, xx, yy = products
            sums.append(F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)).alias(f"c{i}"))
        found = ranks.agg(*sums).first()
        out += [(x, y, found[f"c{i}"]) for i, (x, y) in enumerate(pairs[at : at + _PAIRS_AT_ONCE]) if found[f"c{i}"] is not None]
    return fixed_rows(df.sparkSession, out, "x string, y string, correlation double").withColumn("correlation", rounded("correlation", 6))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 20) -> DataFrame:
    """The ``k`` most frequent values of each column with their share of its non-null rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.explode(cells).alias("c"))
        .where(F.col("c.value").isNotNull())
        .groupBy("c.column", "c.value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    # row_number() <= k is cut to k rows per column in every task before the shuffle.
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return (
        counts.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= k)
        .join(F.broadcast(totals), "column")  # one row per column
        .select("column", "position", "value", "count", pct("count", "total").alias("percentage"))
    )


def box_plot(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, fences, whisker ends (the furthest values inside the fences) and the rows beyond."""
    cut = quantiles(df, columns, [0.25, 0.5, 0.75])
    kept = [c for c in columns if cut[c]["n"]]
    fences = {}
    for c in kept:
        spread = cut[c][0.75] - cut[c][0.25]
        fences[c] = (cut[c][0.25] - k * spread, cut[c][0.75] + k * spread)
    aggs = []
    for i, c in enumerate(kept):
        x, (lo, hi) = number(c), fences[c]
        inside = F.when(x.between(lo, hi), x)
        aggs += [
            F.min(inside).alias(f"lo{i}"),
            F.max(inside).alias(f"hi{i}"),
            F.count_if((x < lo) | (x > hi)).alias(f"out{i}"),
        ]
    row = df.agg(*aggs).first()
    rows = [
        (c, cut[c][0.25], cut[c][0.5], cut[c][0.75], *fences[c], row[f"lo{i}"], row[f"hi{i}"], row[f"out{i}"])
        for i, c in enumerate(kept)
    ]
    names = ["q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]
    return fixed_rows(
        df.sparkSession, rows, "column string, " + ", ".join(f"{n} double" for n in names) + ", outliers bigint"
    )


def scatter_sample(df: DataFrame, x: str, y: str, key: Sequence[str], points: int = 1000, seed: int = 42) -> DataFrame:
    """A repeatable sample of (x, y) pairs: the rows whose keyed hash is smallest."""
    order = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.orderBy(order, *key).limit(points).select(*key, x, y)


# Which chart suits which pair of column kinds.
CHART_RULES = (
    ("DATE", "NUMERIC", "LINE"),
    ("CATEGORICAL", "NUMERIC", "BAR"),
    ("NUMERIC", "NUMERIC", "SCATTER"),
    ("NUMERIC", None, "HISTOGRAM"),
    ("CATEGORICAL", None, "BAR"),
)


def chart_choice(spark: SparkSession, kinds: dict[str, str]) -> DataFrame:
    """Charts for single columns and pairs of columns by their kinds (DATE, CATEGORICAL, NUMERIC)."""
    columns = fixed_rows(spark, list(kinds.items()), "column string, kind string")
    rules = fixed_rows(spark, CHART_RULES, "kind string, other_kind string, chart string")
    alone = columns.join(rules.where("other_kind IS NULL"), "kind").select(
        F.col("column").alias("x"), F.lit(None).cast("string").alias("y"), "chart"
    )
    other = columns.select(F.col("column").alias("y"), F.col("kind").alias("other_kind"))
    pairs = (
        columns.join(rules.where("other_kind IS NOT NULL"), "kind")
        .join(other, "other_kind")
        .where((F.col("kind") != F.col("other_kind")) | (F.col("column") < F.col("y")))
        .select(F.col("column").alias("x"), "y", "chart")
    )
    return alone.unionByName(pairs).orderBy("x", "y")
