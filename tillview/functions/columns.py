"""Small column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """DOUBLE quotient, NULL when the bottom is 0 or NULL."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def rounded(x: str | Column, places: int = 2) -> Column:
    """Half away from zero on the scaled DOUBLE, the way SQL engines round floating numbers."""
    scale = float(10**places)
    return F.round(col(x).cast("double") * scale) / scale


def pct(top: str | Column, bottom: str | Column, places: int = 2) -> Column:
    """Percentage rounded to ``places``, 0 when there is nothing to divide by."""
    return F.coalesce(rounded(ratio(top, bottom) * 100, places), F.lit(0.0))


def missing(df: DataFrame, name: str) -> Column:
    """True where a cell is NULL, or NaN in a floating column."""
    kind = df.schema[name].dataType
    null = F.col(name).isNull()
    return null | F.isnan(name) if isinstance(kind, (T.DoubleType, T.FloatType)) else null


def row_digest(parts: Iterable[Column]) -> Column:
    """SHA-256 over cells as text: 32 bytes stand for a row of any width when rows are compared.

    The length before each cell keeps NULL, the empty string and shifted cells apart.
    """
    marked = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat_ws("|", *marked), 256))


def cell_texts(df: DataFrame, columns: Iterable[str] | None = None) -> list[Column]:
    """Cells as text in which equal values are equal: -0.0 reads as 0.0, nested values as JSON."""
    out = []
    for name in columns or df.columns:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0)
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(c.cast("string"))
    return out


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, *NUMERIC)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def stripped(c: str | Column) -> Column:
    """Text without leading or trailing white space of any kind (blank, tab, newline)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def month_of(d: str | Column) -> Column:
    return F.trunc(col(d), "month")


def monday_week_label(d: str | Column) -> Column:
    """``YYYY-Www`` with weeks starting on Monday and week 00 before the year's first Monday."""
    c = col(d)
    week = F.floor((F.dayofyear(c) + 6 - F.weekday(c)) / 7)
    return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def of_groups(name: str) -> Column:
    """The sum of a column over all rows of a grouped frame. Only for groups that are few whatever the size of the
    data (categories, places, payment methods): they meet in one task, and the lines are not read again."""
    return F.sum(name).over(Window.partitionBy())


def one_row(df: DataFrame, name: str) -> Column:
    """A scalar subquery: the single value of ``name`` in a one-row frame."""
    return df.select(name).scalar()


def fixed_rows(spark, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A literal table of a few rows, planned as a local relation."""
    return spark.createDataFrame(list(rows), schema)
