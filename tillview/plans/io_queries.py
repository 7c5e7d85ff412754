"""Tables written through a sink into the shared folder and read back through a source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.plans.edge import plain
from tillview.session import shared_dir, tune
from tillview.sources import files, sinks
from tillview.sources.transactions import table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(tune(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_retailprice").cast("decimal(18,2)").alias("p_retailprice"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "csv")
    sinks.write_tables({"parts": _parts(spark, d)}, place)
    return files.read_csv(spark, f"{place}/data/parts")[0]


def csv_line_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Names with a line break, a quote and a delimiter in them."""
    place = _place(spark, "csv")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit(', "'), F.col("p_brand"), F.lit('"'))
    sinks.write_tables({"parts": _parts(spark, d).select("p_partkey", name.alias("p_name"))}, place)
    return files.read_csv(spark, f"{place}/data/parts")[0]


def csv_safe_cells(spark: SparkSession, d: str) -> DataFrame:
    """Dates, truth values and cells a spreadsheet would run, as they stand in the file."""
    place = _place(spark, "csv")
    orders = table(spark, d, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("day"),
        (F.col("o_totalprice") > 100000).alias("large"),
        F.concat(F.lit("=A"), F.col("o_orderkey").cast("string")).alias("formula"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"),
    )
    sinks.write_tables({"orders": orders}, place)
    return files.read_csv(spark, f"{place}/data/orders")[0]


def csv_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """Rows read from a file of each delimiter, which both sniffers have to find."""
    out = None
    for sep in files.DELIMITERS:
        place = _place(spark, "csv")
        _parts(spark, d).write.csv(place, sep=sep, header=True)
        found = files.sniff_delimiter(spark, place), files.sniff_delimiter_by_shape(spark, place)
        number = [F.lit(str(files.DELIMITERS.index(x))) for x in (sep, *found)]
        row = files.read_csv(spark, place)[0].agg(
            *[n.alias(a) for n, a in zip(number, ("written", "sniffed", "by_shape"))], F.count("*").alias("rows"), F.min("p_name").alias("first_name")
        )
        out = row if out is None else out.union(row)
    return out


def csv_encoding(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "csv")
    _parts(spark, d).select("p_partkey", F.concat("p_name", F.lit(" é")).alias("p_name")).write.csv(place, header=True, encoding="ISO-8859-1")
    return files.read_csv(spark, place)[0].withColumn("encoding", F.lit(files.sniff_encoding(spark, place)))


def csv_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which every 50th has a cell too many, within the tolerance of the call."""
    place = _place(spark, "csv")
    extra = F.when(F.col("p_partkey") % 50 == 0, F.lit(",extra")).otherwise("")
    key = F.concat(F.col("p_partkey").cast("string"), extra)
    _parts(spark, d).select(F.col("p_brand"), key.alias("p_partkey")).write.csv(place, header=True, quote="")
    df, bad = files.read_csv(spark, place, tolerance=0.05)
    return df.agg(F.count("*").alias("rows"), F.count_distinct("p_brand").alias("brands")).withColumn("malformed", F.lit(bad).cast("bigint"))


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """One nested object per line, flattened."""
    place = _place(spark, "json")
    inner = F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_partkey").alias("key")).alias("in"))
    _parts(spark, d).select(F.struct(inner.alias("of"), F.col("p_name").alias("name")).alias("part"), F.array("p_brand").alias("tags")).write.json(place)
    return files.read_json(spark, place)


def json_wrapper(spark: SparkSession, d: str) -> DataFrame:
    """One object whose only key holds all rows; such a file is small."""
    place = _place(spark, "json")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    rows.agg(F.collect_list(F.struct("key", "name")).alias("rows")).coalesce(1).write.json(place)
    return files.read_json(spark, place)


def json_array(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of a thousand rows or so, a file each, on one line: cut at the ends of their elements."""
    place = _place(spark, "json")
    row = F.to_json(F.struct(F.col("p_partkey").alias("key"), F.struct(F.concat("p_name", F.lit(' }"\n')).alias("name")).alias("of")))
    arrays = _parts(spark, d).groupBy(F.floor(F.col("p_partkey") / 1000).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ", "), F.lit("]")).alias("value"))
    arrays.write.partitionBy("g").text(place)
    return files.read_json(spark, place)


def version_written(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "versions")
    first = sinks.write_version(_parts(spark, d), place, 1)
    sinks.write_version(first.where("p_partkey % 2 = 0"), place, 2, 1)
    return sinks.versions(spark, place).drop("path")


def parquet_copies(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "copies")
    sinks.write_tables({"parts": _parts(spark, d)}, place, parquet=True, order={"parts": "p_partkey"})
    return spark.read.parquet(f"{place}/data_parquet/parts")


def result_kept(spark: SparkSession, d: str) -> DataFrame:
    kept, cut = sinks.keep_result(table(spark, d, "lineitem").select("l_orderkey"), _place(spark, "result"))
    return kept.agg(F.count("*").alias("rows")).withColumn("cut", F.lit(cut))


def metrics_appended(spark: SparkSession, d: str) -> DataFrame:
    """The figures of two runs, added one after the other."""
    place = _place(spark, "metrics")
    for run in ("run-1", "run-2"):
        rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric_key")).agg(F.count("*").alias("value"))
        sinks.append_metrics(rows.withColumn("run_id", F.lit(run)), place)
    return spark.read.parquet(f"{place}/metrics").withColumn("run_id", F.col("run_id").cast("string"))


_MADE = (csv_round_trip, csv_line_breaks, csv_safe_cells, csv_delimiters, csv_encoding, csv_malformed, json_lines, json_wrapper, json_array, version_written, parquet_copies, result_kept, metrics_appended)


def io_queries():
    return {f"io_{f.__name__}": (lambda spark, d, f=f: plain(f(spark, d))) for f in _MADE}


_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)"
SQL = {
    "io_csv_round_trip": f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, {_PRICE} AS p_retailprice FROM part",
    "io_csv_line_breaks": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, replace(p_name, ' ', chr(10)) || ', "' || p_brand || '"' AS p_name FROM part""",
    "io_csv_safe_cells": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS large,
  '''=A' || o_orderkey AS formula, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders""",
    "io_csv_delimiters": "SELECT CAST(i AS VARCHAR) AS written, CAST(i AS VARCHAR) AS sniffed, CAST(i AS VARCHAR) AS by_shape, COUNT(*) AS rows, MIN(p_name) AS first_name FROM part, range(4) AS r(i) GROUP BY i",
    "io_csv_encoding": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ' é' AS p_name, 'ISO-8859-1' AS encoding FROM part",
    "io_csv_malformed": "SELECT COUNT(*) AS rows, COUNT(DISTINCT p_brand) AS brands, COUNT(*) FILTER (WHERE p_partkey % 50 = 0) AS malformed FROM part",
    "io_json_lines": """SELECT p_brand AS part__of__brand, '{"key":"' || p_partkey || '"}' AS part__of__in, p_name AS part__name, '["' || p_brand || '"]' AS tags FROM part""",
    "io_json_wrapper": "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation",
    "io_json_array": """SELECT CAST(p_partkey AS VARCHAR) AS key, p_name || ' }"' || chr(10) AS of__name FROM part""",
    "io_version_written": """SELECT CAST(1 AS BIGINT) AS version, CAST(NULL AS BIGINT) AS parent, COUNT(*) AS rows, CAST(4 AS BIGINT) AS columns FROM part
UNION ALL SELECT 2, 1, COUNT(*), 4 FROM part WHERE p_partkey % 2 = 0""",
    "io_parquet_copies": "SELECT p_partkey, p_name, p_brand, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS p_retailprice FROM part",
    "io_result_kept": "SELECT LEAST(COUNT(*), 10000) AS rows, COUNT(*) > 10000 AS cut FROM lineitem",
    "io_metrics_appended": "SELECT o_orderpriority AS metric_key, COUNT(*) AS value, run_id FROM orders, (VALUES ('run-1'), ('run-2')) AS r(run_id) GROUP BY ALL",
}
