"""Cleaning with an audit log, as frames in and frames out; the input version is never changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.functions.columns import (
    fixed_rows,
    missing,
    numeric_columns,
    one_row,
    rounded,
    stripped,
    text_columns,
)
from tillview.operators.ordering import quantiles
from tillview.session import passes, stage, unstage

DATE_NAMES = ("order_date", "date", "transaction_date")
LOG_SCHEMA = "step int, operation string, column string, rows_modified bigint, reason string"


@dataclass
class Cleaned:
    rows: DataFrame
    log: DataFrame
    original_rows: int
    cleaned_rows: int
    dropped_duplicates: int
    imputed_cells: int


def clean(df: DataFrame, dedupe_after_trim: bool = False) -> Cleaned:
    """The standard sequence: drop exact repeats, trim text, fill gaps, parse the date columns.

    Repeats are dropped before trimming, so rows that differ only in white space both survive unless
    ``dedupe_after_trim`` is set. Date columns are parsed all or nothing and keep their NULLs.
    """
    texts = text_columns(df)
    before = df.count()
    log: list[tuple] = []

    def note(operation: str, column: str, rows: int, reason: str) -> None:
        log.append((len(log) + 1, operation, column, rows, reason))

    first = stage(*[part.dropDuplicates() for part in passes(df)])
    kept = first.count()
    if before > kept:
        note("REMOVE_EXACT_DUPLICATES", "[ALL_COLUMNS]", before - kept, "Repeats inflate revenue and counts.")

    counts = first.agg(
        *[F.count_if(F.col(c) != stripped(c)).alias(f"pad{i}") for i, c in enumerate(texts)],
        *[F.count_if(missing(first, c)).alias(f"null{i}") for i, c in enumerate(first.columns)],
        *[
            F.count_if(F.col(c).isNotNull() & as_timestamp(c).isNull()).alias(f"bad_{c}")
            for c in DATE_NAMES
            if c in texts
        ],
    ).first()
    for i, c in enumerate(texts):
        if counts[f"pad{i}"]:
            note("STANDARDIZE_WHITESPACE", c, counts[f"pad{i}"], "Padded spellings would split groups.")

    gaps = {c: counts[f"null{i}"] for i, c in enumerate(first.columns) if counts[f"null{i}"]}
    numbers = [c for c in numeric_columns(first) if c in gaps]
    medians = quantiles(first, numbers, [0.5]) if numbers else {}
    imputed = 0
    out = []
    for f in first.schema.fields:
        c = F.col(f.name)
        if f.name in texts:
            c = stripped(c)
        if f.name in medians and medians[f.name][0.5] is not None:
            median = medians[f.name][0.5]
            kind = f.dataType if isinstance(f.dataType, T.DecimalType) else T.DoubleType()
            c = F.when(missing(first, f.name), F.lit(median)).otherwise(c).cast(kind)
            imputed += gaps[f.name]
            note("IMPUTE_NUMERIC_MEDIAN", f.name, gaps[f.name], "The median is robust against outliers.")
        elif f.name in gaps and f.name in texts and f.name not in DATE_NAMES:
            c = F.coalesce(c, F.lit("UNKNOWN"))
            imputed += gaps[f.name]
            note("IMPUTE_CATEGORICAL_LABEL", f.name, gaps[f.name], "Keeps rows without inventing a category.")
        out.append(c.alias(f.name))
    rows = first.select(*out)
    for name in DATE_NAMES:
        if name in rows.columns and (name not in texts or not counts[f"bad_{name}"]):
            rows = rows.withColumn(name, as_timestamp(name) if name in texts else F.col(name).cast("timestamp"))
            note("STANDARDIZE_DATETIME_ISO8601", name, kept, "One time format allows sorting and time series.")
    if dedupe_after_trim:
        rows = stage(rows.dropDuplicates())
        unstage(first)
        if rows.count() < kept:
            note("REMOVE_EXACT_DUPLICATES", "[ALL_COLUMNS]", kept - rows.count(), "Repeats that trimming revealed.")
            kept = rows.count()
    audit = fixed_rows(df.sparkSession, log, LOG_SCHEMA)
    return Cleaned(rows, audit, before, kept, before - kept, imputed)


def as_timestamp(c: str) -> Column:
    return F.expr(f"try_cast(trim(`{c}`) AS timestamp)")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a digest that do not depend on row order and see repeated rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    # 15 hex digits fit a BIGINT; the sum, unlike an exclusive or, does not cancel repeats.
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("digest"))


def standard_discount(df: DataFrame, column: str) -> DataFrame:
    """Discount in percent: ratios times 100, percentages kept, anything else not exposed."""
    row = df.agg(F.min(column), F.max(column)).first()
    lo, hi = row[0], row[1]
    if lo is None or lo < 0 or hi > 100:
        return df.drop(column)
    return df.withColumn(column, F.col(column) * 100) if hi <= 1 else df


def exact_duplicates_first(df: DataFrame, line_id: str = "line_id") -> DataFrame:
    """One row per distinct content, the one with the smallest line id."""
    rest = [c for c in df.columns if c != line_id]
    return df.groupBy(*rest).agg(F.min(line_id).alias(line_id)).select(*df.columns)


# --- single operations ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """One requested operation: its type, the columns it looks at and its parameters."""

    type: str
    columns: Sequence[str] = ()
    parameters: Mapping[str, object] | None = None

    def get(self, name: str, default=None):
        return (self.parameters or {}).get(name, default)


def _changed(df: DataFrame, new: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """New column values and the number of rows any of them changes."""
    flag = F.lit(False)
    for c, value in new.items():
        flag = flag | ~F.col(c).cast("string").eqNullSafe(value.cast("string"))
    return df.withColumns(dict(new)), df.agg(F.count_if(flag).alias("n"))


def _removed(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    keep = F.coalesce(keep, F.lit(True))
    return df.where(keep), df.agg(F.count_if(~keep).alias("n"))


def _remove_exact_duplicates(df: DataFrame, step: Step):
    from tillview.operators.quality import duplicate_rows

    return df.dropDuplicates(), duplicate_rows(df).select(F.col("duplicate_rows").alias("n"))


def _standardize_types(df: DataFrame, step: Step):
    """Text to the type named in ``types``; cells that do not parse become NULL."""
    types = step.get("types", {})
    new = {c: F.expr(f"try_cast(trim(`{c}`) AS {types[c]})") for c in step.columns}
    lost = F.lit(False)
    for c, value in new.items():
        lost = lost | (F.col(c).isNotNull() & value.isNull())
    return df.withColumns(new), df.agg(F.count_if(lost).alias("n"))


def _normalize_categories(df: DataFrame, step: Step):
    """Every spelling becomes the dominant one of its group."""
    from tillview.operators.quality import category_variants

    # Written first: their size decides whether the rows have to be shuffled to meet them.
    found = stage(category_variants(df, step.columns).where("variant <> dominant"))
    out = df
    for c in step.columns:
        names = found.where(F.col("column") == c).select(F.col("variant").alias(c), F.col("dominant").alias(f"_{c}"))
        out = out.join(names, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.select(*df.columns), found.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))


def _handle_missing(df: DataFrame, step: Step):
    """Strategy MEDIAN, LABEL, DROP_ROWS or FLAG_ONLY."""
    strategy = step.get("strategy", "FLAG_ONLY")
    gap = F.lit(False)
    for c in step.columns:
        gap = gap | missing(df, c)
    n = df.agg(F.count_if(gap).alias("n"))
    if strategy == "DROP_ROWS":
        return df.where(~gap), n
    if strategy == "LABEL":
        label = F.lit(step.get("label", "UNKNOWN"))
        return df.withColumns({c: F.coalesce(F.col(c), label) for c in step.columns}), n
    if strategy == "MEDIAN":
        mid = quantiles(df, list(step.columns), [0.5])
        return (
            df.withColumns(
                {
                    c: F.when(missing(df, c), F.lit(mid[c][0.5])).otherwise(F.col(c).cast("double"))
                    for c in step.columns
                }
            ),
            n,
        )
    return df.withColumns({f"{c}_missing": missing(df, c) for c in step.columns}), n


def _parse_dates(df: DataFrame, step: Step):
    """Text dates by the first of the given formats that fits the cell."""
    formats = step.get("formats", ["yyyy-MM-dd"])
    new = {
        c: F.coalesce(*[F.try_to_timestamp(F.trim(F.col(c)), F.lit(f)) for f in formats]) for c in step.columns
    }
    parsed = F.lit(False)
    for c, value in new.items():
        parsed = parsed | value.isNotNull()
    return df.withColumns(new), df.agg(F.count_if(parsed).alias("n"))


def _remove_invalid_records(df: DataFrame, step: Step):
    """Rows matching ``rule`` (a SQL condition), or rows beyond the fences of the columns."""
    from tillview.operators.eda import number
    from tillview.operators.quality import iqr_fences, outside

    rule = step.get("rule")
    if rule != "OUTLIER_FLAGGED":
        return _removed(df, ~F.expr(rule))
    bad = F.lit(False)
    for c, fences in iqr_fences(df, list(step.columns)).items():
        bad = bad | F.coalesce(outside(number(c), fences), F.lit(False))
    return _removed(df, ~bad)


def _normalize_text(df: DataFrame, step: Step):
    case = {"lower": F.lower, "upper": F.upper}.get(step.get("case", ""), lambda c: c)
    return _changed(df, {c: case(F.regexp_replace(stripped(c), r"\s+", " ")) for c in step.columns})


def _standardize_numerics(df: DataFrame, step: Step):
    """Numbers written with signs, separators and currency marks to DOUBLE."""
    from tillview.operators.typing import number_style, parse_number

    new = {c: parse_number(F.col(c), number_style(df, c)) for c in step.columns}
    parsed = F.lit(False)
    for value in new.values():
        parsed = parsed | value.isNotNull()
    return df.withColumns(new), df.agg(F.count_if(parsed).alias("n"))


OPERATIONS = {
    "REMOVE_EXACT_DUPLICATES": (_remove_exact_duplicates, "Exact duplicate records"),
    "STANDARDIZE_TYPES": (_standardize_types, "Cells that do not parse become missing"),
    "NORMALIZE_CATEGORIES": (_normalize_categories, "Spellings replaced by the dominant one"),
    "HANDLE_MISSING": (_handle_missing, "Missing values handled"),
    "PARSE_DATES": (_parse_dates, "Text dates parsed"),
    "REMOVE_INVALID_RECORDS": (_remove_invalid_records, "Records breaking a rule removed"),
    "NORMALIZE_TEXT": (_normalize_text, "White space and case unified"),
    "STANDARDIZE_NUMERICS": (_standardize_numerics, "Written numbers parsed"),
}


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
    """Run the operations in order; returns the new rows and a log row per operation."""
    entries = []
    rows_before = df.count()
    for seq, step in enumerate(steps, 1):
        run, reason = OPERATIONS[step.type]
        after, affected = run(df, step)
        after = stage(after)
        rows_after = after.count()
        entries.append((seq, step.type, ",".join(step.columns), rows_before, rows_after, affected.first()["n"], reason))
        if seq > 1:
            unstage(df)
        df, rows_before = after, rows_after
    log = fixed_rows(
        df.sparkSession,
        entries,
        "seq int, type string, columns string, rows_before bigint, rows_after bigint, rows_affected bigint, reason string",
    )
    return df, log


def preview_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The log the operations would write; no version is created."""
    return apply_steps(df, steps)[1]


def compare_versions(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Both versions measured the same way, side by side, with the change of each figure."""
    from tillview.operators.quality import basic_profile

    a, b = basic_profile(v1), basic_profile(v2)
    figures = ["total_rows", "overall_score", "duplicate_rows", "null_cells", "outlier_count"]
    entries = [
        F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias("v1"), one_row(b, f).cast("double").alias("v2"))
        for f in figures
    ]
    return (
        a.select(F.inline(F.array(*entries)))
        .withColumn("delta", F.col("v2") - F.col("v1"))
        .withColumn("delta_pct", rounded(F.try_divide(F.col("delta") * 100, F.col("v1")), 2))
    )
