"""Ranks, tiles, running sums and quantiles over whole tables, without a one-partition window.

An unpartitioned ``Window`` sends every row to one task. Here rows are range-partitioned on the sort
key, so a tied value or a hot group is spread over as many tasks as it needs; only one counter per
partition is gathered to link the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.session import stage

# monotonically_increasing_id() holds the partition in the upper bits and the row in the lower 33.
_ROW_BITS = 33


def ranked(
    df: DataFrame,
    order_by: Sequence[Column],
    within: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    running: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based row number of each row in ``order_by`` order.

    ``order_by`` must be a total order. ``within`` restarts the rank per value of a few low-cardinality,
    non-null columns. ``total`` names a column for the number of rows ranked. ``running`` maps new column
    names to numeric columns whose cumulative sum (up to and including the row) is wanted.
    """
    keys = [F.col(c) for c in within] + list(order_by)
    placed = stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", _ROW_BITS))

    running = dict(running or {})
    spans = placed.groupBy(*within, "_part").agg(
        F.min("_pos").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(src).alias(f"_sum_{name}") for name, src in running.items()],
    )
    # One row per partition (times the few ``within`` values): the only frame brought together.
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *within,
        "_part",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*within)).alias("_total"),
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_before_{name}") for name in running],
    )

    if running:
        here = (
            Window.partitionBy(*within, "_part")
            .orderBy("_pos")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        placed = placed.select("*", *[F.sum(src).over(here).alias(f"_here_{n}") for n, src in running.items()])
    out = placed.join(F.broadcast(spans), [*within, "_part"])
    return out.select(
        *df.columns,
        (F.col("_before") + F.col("_pos") - F.col("_first") + 1).alias(rank),
        *([F.col("_total").alias(total)] if total else []),
        *[
            (F.col(f"_here_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n)
            for n in running
        ],
    )


def ntile_of(rank: Column, total: Column, tiles: int) -> Column:
    """SQL NTILE from a row number: the first ``total mod tiles`` tiles hold one row more."""
    size = F.floor(total / F.lit(tiles))
    extra = total % F.lit(tiles)
    in_large = (size + 1) * extra
    return (
        F.when(rank <= in_large, F.floor((rank - 1) / (size + 1)) + 1)
        .otherwise(extra + F.floor((rank - 1 - in_large) / F.greatest(size, F.lit(1))) + 1)
        .cast("int")
    )


def quantile_bin_of(rank: Column, total: Column, bins: int) -> Column:
    """Equal-frequency bin of a distinct rank with linear-interpolated edges, lowest edge included."""
    spread = F.when(total > 1, F.lit(bins) * (rank - 1) / (total - 1)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(1), F.ceil(spread)).cast("int")


# Brackets holding at most this many rows are finished on the driver.
_FINISH_ROWS = 20_000
_SKETCH = 10_000
_MARGIN = 2.5 / _SKETCH


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, dict]:
    """Exact linear-interpolated quantiles of numeric columns.

    ``percentile`` keeps every distinct value of a column in one buffer. This selects order statistics
    instead. A sketch proposes edges around each wanted rank; one scan counts the rows on and between
    the edges, which tells where every rank lies. A rank on an edge is found; an interval with few rows
    is read; an interval with many rows gets new edges inside it. Each round is a scan with map-side
    aggregation, and the driver sees counts and, per interval, at most ``_FINISH_ROWS`` rows. Returns
    ``{column: {"n", "min", "max", prob: value}}``; values are None when the column holds no number.
    """
    columns = list(columns)
    data = df.select(*[_number(F.col(c)).alias(c) for c in columns])
    grid = sorted({_unit(p + side) for p in probs for side in (-_MARGIN, _MARGIN)})
    row = data.agg(
        *[
            agg
            for i, c in enumerate(columns)
            for agg in (
                F.count(c).alias(f"n{i}"),
                F.min(c).alias(f"lo{i}"),
                F.max(c).alias(f"hi{i}"),
                F.percentile_approx(c, grid, _SKETCH).alias(f"q{i}"),
            )
        ]
    ).first()

    out = {c: {"n": row[f"n{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"]} for i, c in enumerate(columns)}
    wanted: dict[str, set[int]] = {}
    edges: dict[str, list[float]] = {}
    for i, c in enumerate(columns):
        n = out[c]["n"]
        if n:
            wanted[c] = {r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
            edges[c] = sorted({out[c]["min"], out[c]["max"], *(row[f"q{i}"] if n > _FINISH_ROWS else ())})
    chosen: dict[tuple[str, int], float] = {}
    while edges:
        edges = _select_round(data, edges, wanted, chosen)

    for c in columns:
        for p in probs:
            if not out[c]["n"]:
                out[c][p] = None
                continue
            h = (out[c]["n"] - 1) * p
            low, high = chosen[c, math.floor(h)], chosen[c, math.ceil(h)]
            out[c][p] = low + (high - low) * (h - math.floor(h))
    return out


def _unit(p: float) -> float:
    return min(1.0, max(0.0, p))


def _number(c: Column) -> Column:
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class _Gap:
    """The rows strictly between two edges of a column: how many, after how many, and their range."""

    column: str
    below: int
    rows: int
    lo: float
    hi: float
    ranks: list[int]


def _select_round(data: DataFrame, edges: dict, wanted: dict, chosen: dict) -> dict[str, list[float]]:
    """Count on and between the edges; settle the ranks that can be; return edges for the others."""
    places = []
    for k, (c, cuts) in enumerate(edges.items()):
        # Even places lie between edges, odd ones on an edge.
        place = sum(((F.col(c) > e).cast("int") + (F.col(c) >= e).cast("int") for e in cuts), F.lit(0))
        places.append(F.struct(F.lit(k).alias("k"), place.alias("place"), F.col(c).alias("v")))
    counts = (
        data.select(F.explode(F.array(*places)).alias("p"))
        .where("p.v IS NOT NULL")
        .groupBy("p.k", "p.place")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("p.v").alias("lo"), F.max("p.v").alias("hi"))
        .collect()
    )  # at most two rows per edge
    gaps: list[_Gap] = []
    for k, (c, cuts) in enumerate(edges.items()):
        below = 0
        for row in sorted((r for r in counts if r["k"] == k), key=lambda r: r["place"]):
            here = [r for r in wanted[c] if below <= r < below + row["rows"]]
            if here and row["lo"] == row["hi"]:
                chosen.update({(c, r): row["lo"] for r in here})
            elif here:
                gaps.append(_Gap(c, below, row["rows"], row["lo"], row["hi"], here))
            below += row["rows"]
        wanted[c] = {r for g in gaps if g.column == c for r in g.ranks}
    few = [g for g in gaps if g.rows <= _FINISH_ROWS]
    if few:
        _read_gaps(data, few, chosen)
        for g in few:
            wanted[g.column] -= set(g.ranks)
    return _cut_gaps(data, [g for g in gaps if g.rows > _FINISH_ROWS])


def _inside(g: _Gap) -> Column:
    return F.col(g.column).between(F.lit(g.lo), F.lit(g.hi))


def _read_gaps(data: DataFrame, few: list[_Gap], chosen: dict) -> None:
    """Read the few values inside each interval and pick the wanted ranks."""
    hits = [
        F.when(_inside(g), F.struct(F.lit(i).alias("g"), F.col(g.column).alias("v"))) for i, g in enumerate(few)
    ]
    rows = (
        data.select(F.explode(F.array_compact(F.array(*hits))).alias("h"))
        .groupBy("h.g", "h.v")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    for i, g in enumerate(few):
        seen = g.below
        for value, n in sorted((r["v"], r["n"]) for r in rows if r["g"] == i):
            chosen.update({(g.column, r): value for r in g.ranks if seen <= r < seen + n})
            seen += n


def _cut_gaps(data: DataFrame, many: list[_Gap]) -> dict[str, list[float]]:
    """New edges around each rank inside the over-full intervals; their ends are edges too."""
    if not many:
        return {}
    aggs = []
    for i, g in enumerate(many):
        at = [(r - g.below) / g.rows for r in g.ranks]
        cuts = sorted({_unit(p + side) for p in at for side in (-_MARGIN, _MARGIN)})
        aggs.append(F.percentile_approx(F.when(_inside(g), F.col(g.column)), cuts, _SKETCH).alias(f"q{i}"))
    row = data.agg(*aggs).first()
    edges: dict[str, set[float]] = {}
    for i, g in enumerate(many):
        edges.setdefault(g.column, set()).update([g.lo, g.hi, *row[f"q{i}"]])
    return {c: sorted(e) for c, e in edges.items()}
