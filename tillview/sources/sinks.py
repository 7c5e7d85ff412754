"""Writing versions, star schemas, results and metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_ROWS = 10_000


def write_version(df: DataFrame, root: str, number: int, parent: int | None = None) -> DataFrame:
    """One immutable version of a dataset; its row goes to the table of versions next to it."""
    path = f"{root}/v{number}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(number).alias("version"),
        F.lit(parent).cast("int").alias("parent"),
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(path).alias("path"),
    ).write.mode("append").parquet(f"{root}/versions")
    return stored


def versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions")


def csv_safe(df: DataFrame, spreadsheet: bool = True) -> DataFrame:
    """Text cells for CSV: ISO dates, true/false, plain decimals, and no cell a spreadsheet would run."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.expr(f"format_number(`{f.name}`, '0.##########')")
        if isinstance(f.dataType, T.StringType) and spreadsheet:
            return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
        return c.cast("string")

    return df.select(*[cell(f).alias(f.name) for f in df.schema.fields])


def write_tables(
    tables: Mapping[str, DataFrame], root: str, parquet: bool = False, order: Mapping[str, str] | None = None
) -> None:
    """One CSV folder per table, and typed Parquet copies when asked."""
    for name, df in tables.items():
        key = (order or {}).get(name)
        rows = df.orderBy(key) if key else df
        csv_safe(rows).write.mode("errorifexists").options(
            header=True, nullValue="", emptyValue="", quote='"', escape='"', encoding="UTF-8"
        ).csv(f"{root}/data/{name}")
        if parquet:
            df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/data_parquet/{name}")


def keep_result(df: DataFrame, path: str, rows: int = RESULT_ROWS) -> tuple[DataFrame, bool]:
    """Store a query result for paging; the flag tells whether it was cut."""
    spark = df.sparkSession
    df.limit(rows + 1).write.mode("errorifexists").parquet(path)
    kept = spark.read.parquet(path)
    cut = kept.count() > rows
    return kept.limit(rows), cut


def append_metrics(metrics: DataFrame, root: str) -> None:
    """Metrics are only ever added, in one folder per run."""
    metrics.write.mode("append").partitionBy("run_id").parquet(f"{root}/metrics")
