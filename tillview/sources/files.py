"""Reading delimited, JSON and Parquet files, every cell as text until its type is inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.session import stage
from tillview.sources.records import csv_framing, json_framing, records

DELIMITERS = (",", "\t", ";", "|")
MALFORMED_LIMIT = 0.001
MALFORMED = "_malformed"


class InvalidStructure(ValueError):
    """The file is not a table the engine accepts."""


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, else ISO-8859-1, which decodes anything."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in the first non-empty line; comma when none does."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is None:
        return ","
    counts = {d: first["value"].count(d) for d in DELIMITERS}
    best = max(counts, key=counts.get)
    return best if counts[best] else ","


def sniff_delimiter_by_shape(spark: SparkSession, path: str, records: int = 1000) -> str:
    """The candidate whose column count is the most consistent over the leading records."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(records)
    sizes = F.array(
        *[
            F.struct(F.lit(i).alias("d"), (F.length("value") - F.length(F.replace("value", F.lit(d))) + 1).alias("width"))
            for i, d in enumerate(DELIMITERS)
        ]
    )
    shape = (
        lines.select(F.explode(sizes).alias("s"))
        .groupBy("s.d", "s.width")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("width > 1")
        .orderBy(F.desc("n"), F.desc("width"), "d")
        .first()
    )
    return "," if shape is None else DELIMITERS[shape["d"]]


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line ends inside a quoted cell: it then holds an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
    tolerance: float = MALFORMED_LIMIT,
) -> tuple[DataFrame, int]:
    """All columns as text, and the number of records whose field count differs from the header.

    Such records are padded or cut and counted; above ``tolerance`` of the rows the file is rejected. Cells with line
    breaks are looked for unless ``multi_line`` says. A file that has them is read by as many tasks as any other: its records are
    put together first (see ``records``).
    """
    if multi_line is None:
        multi_line = has_open_quotes(spark, path)
    options = {
        "header": True,
        "sep": delimiter or sniff_delimiter(spark, path),
        "encoding": encoding or sniff_encoding(spark, path),
        "quote": '"',
        "escape": '"',
        "enforceSchema": True,
    }
    names = spark.read.options(**options, multiLine=multi_line).csv(path).columns  # reads no further than the header
    if not names:
        raise InvalidStructure("the file has no header")
    schema = T.StructType([T.StructField(n.lstrip("﻿"), T.StringType()) for n in names])
    kinds = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    read = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED).schema(kinds)
    if multi_line:
        whole, rest = records(spark, path, csv_framing(options["sep"]), options["encoding"])
        rows = whole.where("NOT first").select("text").union(rest.select("text"))
        line = F.replace(F.rtrim(F.col("text"), F.lit("\r")), F.lit("\r\n"), F.lit("\n"))
        df = _texts_as(read.option("header", False), "csv", rows.select(line.alias("text")).where(F.trim("text") != ""))
    else:
        df = read.csv(path)
    # Every column is asked for: a record is only compared with the header when it is parsed whole.
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(MALFORMED).alias("bad"),
        F.max(F.xxhash64(*[F.col(f"`{n}`") for n in schema.names])).alias("_"),
    ).first()
    if counts["n"] == 0:
        raise InvalidStructure("the file has no data rows")
    if counts["bad"] > tolerance * counts["n"]:
        raise InvalidStructure(f"{counts['bad']} of {counts['n']} records do not match the header")
    return df.drop(MALFORMED), counts["bad"]


def _texts_as(reader: DataFrameReader, form: str, texts: DataFrame) -> DataFrame:
    """Texts, one record each, parsed as if they were the lines of a file."""
    strings = getattr(texts._jdf, "as")(texts.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(getattr(reader._jreader, form)(strings), texts.sparkSession)


# What stands before the first element of an array, alone or as the only value of an object.
_BEFORE = {1: r"^\s*\[", 2: r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\['}


def _elements(spark: SparkSession, path: str, depth: int) -> DataFrame | None:
    """(text) of the objects of an array ``depth`` levels down; None when the file holds anything else beside it."""
    whole, rest = records(spark, path, json_framing(depth))
    # The brace that ends an object beside the array is no end of an element, so the array is all there is when what follows is.
    if not rest.where(~F.regexp_like("text", F.lit(r"^\s*\]\s*(\}?)\s*$"))).isEmpty():
        return None
    begun = F.regexp_replace("text", F.when(F.col("first"), F.lit(_BEFORE[depth])).otherwise(F.lit(r"^\s*,")), F.lit(""))
    out = stage(whole.select(F.concat(F.trim(begun), F.lit("}")).alias("text")))
    odd = out.where(~F.regexp_like("text", F.lit(r"^\s*\{"))).first()
    if odd is not None:
        raise InvalidStructure(f"an element that is no object: {odd['text'][:80]}")
    return out


def _json_frame(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The rows as they stand, and whether they may yet be one object around an array."""
    head = spark.read.text(path).where(F.trim("value") != "").first()
    if head is None:
        raise InvalidStructure("the file is empty")
    line = head["value"].strip()
    read = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST")
    if line.startswith("{") and line.endswith("}") and not _wraps(spark, path):
        return read.json(path), True
    depth = 1 if line.startswith("[") else 2 if _wraps(spark, path) else 0
    texts = _elements(spark, path, depth) if depth else None
    if texts is not None:
        return _texts_as(read, "json", texts), False
    return read.option("multiLine", True).json(path), True


def _wraps(spark: SparkSession, path: str) -> bool:
    """Whether the file begins as an object whose first value is an array of objects, and goes on after its first line or that is all it has."""
    lines = spark.read.option("lineSep", "}").text(path).first()
    if lines is None or not re.match(_BEFORE[2] + r"\s*\{", lines["value"]):
        return False
    return len(spark.read.text(path).where(F.trim("value") != "").take(2)) == 1 or "\n" in lines["value"].strip()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, one object per line, or an object whose only key holds such an array.

    Each of these is read by many tasks: arrays are cut at the closing braces of their elements, wherever line breaks are. Only
    an object with other values beside its array, or one without an array, is read by one task; such a file is one row.
    """
    df, may_wrap = _json_frame(spark, path)
    if may_wrap and len(df.columns) == 1:
        kind = df.schema[0].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            df = df.select(F.inline(F.col(f"`{df.columns[0]}`")))
    return flatten(df)


def flatten(df: DataFrame, depth: int = 3) -> DataFrame:
    """Nested fields as ``a__b`` down to ``depth`` names; deeper fields and arrays as JSON text."""

    def walk(c: Column, kind: T.DataType, name: str, level: int) -> list[Column]:
        if isinstance(kind, T.StructType) and level < depth:
            return [x for f in kind.fields for x in walk(c[f.name], f.dataType, f"{name}__{f.name}", level + 1)]
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return [F.to_json(c).alias(name)]
        return [c.alias(name)]

    return df.select(*[x for f in df.schema.fields for x in walk(F.col(f"`{f.name}`"), f.dataType, f.name, 1)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """By file ending: Parquet, JSON, else delimited text."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".json", ".jsonl", ".ndjson")):
        return read_json(spark, path)
    return read_csv(spark, path)[0]
