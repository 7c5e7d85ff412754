"""Dataset and column profiles, personal-data suspicion and previews."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.functions.columns import missing, numeric_columns, one_row, ratio, rounded
from tillview.operators.eda import adjusted_skewness, number, top_values
from tillview.operators.ordering import quantiles
from tillview.operators.quality import duplicate_rows

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
# Shapes and names that suggest personal data.
PII_NAME = (
    r"(^|_)(name|first_name|last_name|full_name|email|e_mail|phone|mobile|contact|address|street|zip"
    r"|postcode|pincode|dob|birth|ssn|aadhaar|pan|passport)($|_)"
)
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?(?:[ \-]*\d){7,15}$"
PERSON = r"^\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"
# Written forms of national identity and tax numbers.
GOVERNMENT_ID = r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4}|[A-Z]{5}[0-9]{4}[A-Z])$"
MANY = 100
PREVIEW_ROWS = 1000


def samples(df: DataFrame, k: int = 3) -> DataFrame:
    """Each column with its type and ``k`` of its non-null values as text, those least by digest: any order of rows gives the same."""
    out = None
    for i, (c, kind) in enumerate(df.dtypes, 1):
        value = F.col(f"`{c}`")
        text = value.cast("string")
        found = df.where(text.isNotNull()).select(text.alias("v")).orderBy(F.sha2("v", 256), "v").limit(k)
        row = found.agg(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(kind).alias("type"), F.sort_array(F.collect_list("v")).alias("samples")
        )
        out = row if out is None else out.unionByName(row)
    return out


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, exact repeats and missing cells."""
    gaps = sum((F.count_if(missing(df, c)) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("row_count"), gaps.alias("missing_cell_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        one_row(duplicate_rows(df), "duplicate_rows").alias("duplicate_row_count"),
        "missing_cell_count",
        F.coalesce(rounded(ratio("missing_cell_count", F.col("row_count") * len(df.columns)) * 100, 4), F.lit(0.0)).alias(
            "missing_pct"
        ),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct values per column. Each (column, value) pair is folded before it is shuffled."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns or df.columns]
    )
    return (
        df.select(F.explode(cells).alias("c"))
        .where("c.v IS NOT NULL")
        .groupBy("c.column", "c.v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )


def approximate_distinct(df: DataFrame) -> DataFrame:
    """For display of very wide ranges only; never enters a metric or a score."""
    return df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in df.columns])


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: gaps, distinct values, range, moments, percentiles and text length."""
    numbers = numeric_columns(df)
    cut = quantiles(df, numbers, list(PERCENTILES.values())) if numbers else {}
    entries = []
    for i, f in enumerate(df.schema.fields, 1):
        c, text = F.col(f"`{f.name}`"), isinstance(f.dataType, T.StringType)
        is_number = f.name in numbers
        x = number(f.name) if is_number else F.lit(None).cast("double")

        def bound(agg, numeric: str) -> Column:
            if is_number:
                return F.lit(cut[f.name][numeric]).cast("double").cast("string")
            return F.substring(agg(c).cast("string"), 1, 64)

        entries.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column"),
                F.count_if(missing(df, f.name)).alias("null_count"),
                F.count(F.lit(1)).alias("rows"),
                bound(F.min, "min").alias("min"),
                bound(F.max, "max").alias("max"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                (adjusted_skewness(x) if is_number else F.lit(None).cast("double")).alias("skewness"),
                *[
                    F.lit(cut[f.name][p] if is_number else None).cast("double").alias(name)
                    for name, p in PERCENTILES.items()
                ],
                (F.avg(F.length(c)) if text else F.lit(None).cast("double")).alias("avg_length"),
            )
        )
    stats = df.agg(F.array(*entries).alias("c")).select(F.inline("c"))
    distinct = distinct_counts(df)
    return (
        stats.join(F.broadcast(distinct), "column", "left")  # one row per column
        .select(
            "ordinal",
            "column",
            "null_count",
            rounded(ratio("null_count", "rows") * 100, 4).alias("null_pct"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            rounded(ratio("unique_count", F.col("rows") - F.col("null_count")) * 100, 4).alias("unique_pct"),
            "min",
            "max",
            *[rounded(n, 6).alias(n) for n in ("mean", "std", "skewness", *PERCENTILES, "avg_length")],
        )
        .orderBy("ordinal")
    )


def column_top_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Up to 20 most frequent values of up to 100 characters of the text columns.

    Longer values are not listed, but shares are of all values, and ``longer_rows`` counts them.
    """
    columns = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    short = df.select(*[F.when(F.length(F.col(f"`{c}`")) <= 100, F.col(f"`{c}`")).alias(c) for c in columns])
    sizes = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("values"), F.count_if(F.length(F.col(f"`{c}`")) > 100).alias("longer_rows")) for c in columns]).alias("c"))
    sizes = sizes.select(F.inline("c"))
    top = top_values(short, columns, 20).join(F.broadcast(sizes), "column")  # one row a column
    share = rounded(ratio("count", "values") * 100, 2)
    return top.withColumn("percentage", share).drop("values")


def pii_suspicion(df: DataFrame) -> DataFrame:
    """Columns whose name or values look personal, with the shares behind the verdict.

    Two capitalized words alone do not make names of persons (``Home Decor``): the column must also have more than
    ``MANY`` distinct values, or more than half as many as it has values. Distinct values are counted for such columns only.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    share = lambda c, pattern: F.coalesce(F.avg(F.col(f"`{c}`").rlike(pattern).cast("int")), F.lit(0.0))
    shapes = {"email_share": EMAIL, "phone_share": PHONE, "id_share": GOVERNMENT_ID, "person_share": PERSON}
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(bool(re.search(PII_NAME, c.lower()))).alias("by_name"),
            *[(share(c, p) if c in texts else F.lit(0.0)).alias(n) for n, p in shapes.items()],
            F.count(F.col(f"`{c}`")).alias("values"),
        )
        for c in df.columns
    ]
    found = df.agg(F.array(*entries).alias("c")).select(F.inline("c"))
    rows = found.collect()  # one row a column
    asked = [r["column"] for r in rows if r["person_share"] >= 0.8]
    distinct = {r["column"]: r["unique_count"] for r in distinct_counts(df, asked).collect()} if asked else {}
    many = [r["column"] for r in rows if r["column"] in asked and (distinct.get(r["column"], 0) > MANY or 2 * distinct.get(r["column"], 0) > r["values"])]
    shares = [[r["column"], r["by_name"], *[r[n] for n in shapes], r["column"] in many] for r in rows]
    table = df.sparkSession.createDataFrame(shares, "column string, by_name boolean, " + ", ".join(f"{n} double" for n in shapes) + ", many_persons boolean")
    verdict = F.col("by_name") | (F.col("email_share") >= 0.3) | (F.col("phone_share") >= 0.3) | (F.col("id_share") >= 0.3) | F.col("many_persons")
    return table.select("column", "by_name", *[rounded(c, 6).alias(c) for c in shapes], "many_persons", verdict.alias("is_pii_suspected"))


def preview(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    equals: Mapping[str, object] | None = None,
    contains: Mapping[str, str] | None = None,
    sort: str | None = None,
    descending: bool = False,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of rows: filters, one sort column, at most 200 rows at a time and 1,000 in all."""
    if not 1 <= limit <= 200 or offset + limit > PREVIEW_ROWS:
        raise ValueError("preview is limited to 200 rows a page and 1,000 rows in all")
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    for c, v in (contains or {}).items():
        df = df.where(F.contains(F.col(c), F.lit(v)))
    if sort:
        rest = [c for c in df.columns if c != sort]
        df = df.orderBy(F.desc(sort) if descending else F.asc(sort), *rest)
    df = df.select(*columns) if columns else df
    return df.offset(offset).limit(limit)


def page_after(df: DataFrame, value: str, key: str, last: tuple | None = None, limit: int = 50) -> DataFrame:
    """Keyset paging: the next rows below (value, key) in descending value, ascending key order."""
    if last is not None:
        v, k = F.lit(last[0]), F.lit(last[1])
        df = df.where((F.col(value) < v) | ((F.col(value) == v) & (F.col(key) > k)))
    return df.orderBy(F.desc(value), key).limit(limit)


def protect(df: DataFrame, columns: Sequence[str], mode: str = "INCLUDE", secret: str | None = None) -> DataFrame:
    """Personal columns as they are, as a keyed hash (HMAC-SHA256, 16 hex digits) or left out."""
    if mode == "INCLUDE":
        return df
    if mode == "OMIT":
        return df.drop(*columns)
    if mode != "HASH" or not secret:
        raise ValueError("mode is INCLUDE, HASH (with a secret) or OMIT")
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))

    def keyed(c: str) -> Column:
        first = F.unhex(F.sha2(F.concat(inner, F.encode(F.col(c).cast("string"), "UTF-8")), 256))
        return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(outer, first), 256), 1, 16))

    return df.withColumns({c: F.when(F.col(c).isNotNull(), keyed(c)) for c in columns})

