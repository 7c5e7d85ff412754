"""Data quality: the basic four-part score, the weighted score, issues, duplicates, missingness, outliers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.functions.columns import (
    cell_texts,
    fixed_rows,
    missing,
    numeric_columns,
    one_row,
    ratio,
    rounded,
    row_digest,
    stripped,
    text_columns,
)
from tillview.operators.eda import adjusted_skewness, number
from tillview.operators.ordering import quantiles
from tillview.session import stage

# Fixed values of the basic score.
NON_NEGATIVE = ("quantity", "unit_price", "total_amount")
BASIC_WEIGHTS = {"completeness": 0.30, "uniqueness": 0.25, "validity": 0.25, "consistency": 0.20}
# Fixed values of the weighted score: weight and sensitivity per dimension, role weights, bands.
SCORE_WEIGHTS = {"completeness": 0.30, "consistency": 0.20, "validity": 0.25, "uniqueness": 0.25}
SENSITIVITY = {"completeness": 2, "consistency": 2, "validity": 3, "uniqueness": 10}
KEY_ROLES = ("customer_id", "transaction_id", "product_id", "revenue", "quantity", "price", "purchase_date")
HEADER_ROLES = ("customer_id", "purchase_date", "payment_method", "country")
GENDER_TOKENS = (
    "m", "f", "male", "female", "man", "woman", "other", "non-binary", "nb", "u", "unknown",
)
EARLIEST = dt.date(1990, 1, 1)


def cell(name: str) -> Column:
    return F.col(f"`{name}`")


# --- duplicates -----------------------------------------------------------------------------------


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of every exact repeat; NULLs and NaNs match themselves.

    Rows are compared by digest, so 32 bytes a row are shuffled, not the row.
    """
    groups = df.groupBy(row_digest(cell_texts(df)).alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def normalized_text(c: Column) -> Column:
    """Lower case, without punctuation (symbols stay: ``A+`` is not ``A``), white space collapsed."""
    bare = F.regexp_replace(F.lower(c), r"\p{P}", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    """NFKC and case folding, which the built-in functions do not offer."""
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def near_duplicates(df: DataFrame, identifiers: Sequence[str] = ()) -> DataFrame:
    """Groups of rows equal after normalization that are not all exact repeats.

    Only two hashes per row are shuffled: of the row as it is and of its normalized form. Lower case is case
    folding for plain ASCII, so only rows with other characters take the Unicode step.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in identifiers]

    def kept(name: str, kind: T.DataType, fold: bool) -> Column:
        c = cell(name)
        if name in identifiers:
            return c.cast("string")
        if isinstance(kind, T.StringType):
            return normalized_text(_folded(c) if fold else c)
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.round(c, 2).cast("string")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return c.cast("date").cast("string")
        return c.cast("string")

    def digests(part: DataFrame, fold: bool) -> DataFrame:
        key = row_digest([kept(f.name, f.dataType, fold) for f in df.schema.fields])
        return part.select(key.alias("key"), row_digest(cell_texts(df)).alias("exact"))

    beyond = F.lit(False)
    for c in texts:
        beyond = beyond | F.coalesce(cell(c).rlike(r"[^\x00-\x7F]"), F.lit(False))
    rows = digests(df.where(~beyond), False)
    if texts:
        rows = rows.union(digests(df.where(beyond), True))
    groups = (
        rows.groupBy("key", "exact")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("variants"))
        .where(F.col("variants") > 1)
    )
    return groups.agg(
        F.count(F.lit(1)).alias("near_duplicate_groups"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("near_duplicate_rows"),
    )


def _disagrees(name: str) -> Column:
    """Aggregate: the values of a field within a group are not all equal (NULL counts as a value)."""
    c = cell(name)
    some_null = (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
    return F.coalesce(F.min(c) != F.max(c), F.lit(False)) | some_null


def header_conflicts(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Orders whose lines disagree on customer, date, payment method or country, with their line count."""
    order = mapping["transaction_id"]
    fields = [mapping[r] for r in HEADER_ROLES if r in mapping]
    lines = df.where(cell(order).isNotNull())
    if "purchase_date" in mapping and dict(df.dtypes)[mapping["purchase_date"]].startswith("timestamp"):
        lines = lines.withColumn(mapping["purchase_date"], cell(mapping["purchase_date"]).cast("date"))
    flag = F.lit(False)
    for f in fields:
        flag = flag | _disagrees(f)
    return (
        lines.groupBy(cell(order).alias("transaction_id"))
        .agg(F.count(F.lit(1)).alias("lines"), flag.alias("conflict"))
        .where("conflict")
        .select("transaction_id", "lines")
    )


def _once(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Order id and header fields of every distinct row; the digest stands for the other columns."""
    fields = dict.fromkeys(mapping[r] for r in ("transaction_id", *HEADER_ROLES) if r in mapping)
    return df.select(*[cell(c) for c in fields], row_digest(cell_texts(df)).alias("_row")).dropDuplicates()


def duplicate_identifiers(df: DataFrame, mapping: Mapping[str, str], grain: str = "LINE_ITEMS") -> DataFrame:
    """Rows affected by repeated order ids; exact repeats are left out first."""
    order = mapping["transaction_id"]
    rows = _once(df, mapping)
    if grain == "ORDER_LEVEL":
        groups = rows.where(cell(order).isNotNull()).groupBy(cell(order)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows"))
    bad = header_conflicts(rows, mapping)
    return bad.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("lines"), F.lit(0)).alias("rows"))


def rows_in_conflict(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """The rows of the orders whose header fields disagree."""
    order = mapping["transaction_id"]
    bad = header_conflicts(_once(df, mapping), mapping).select(F.col("transaction_id").alias(order))
    return df.join(bad, order, "left_semi")


# --- the basic score ------------------------------------------------------------------------------


def _score100(share: Column) -> Column:
    """0-100, halves to the even neighbour."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(share * 100, 0).cast("int")))


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = 1.5, least_rows: int = 11) -> dict[str, tuple]:
    """Fences of the columns that have enough values and a positive spread."""
    cut = quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c in columns:
        if cut[c]["n"] >= least_rows and cut[c][0.75] > cut[c][0.25]:
            spread = cut[c][0.75] - cut[c][0.25]
            out[c] = (cut[c][0.25] - k * spread, cut[c][0.75] + k * spread)
    return out


def outside(c: Column, fences: tuple[float, float]) -> Column:
    return (c < F.lit(fences[0])) | (c > F.lit(fences[1]))


def _facts(df: DataFrame) -> DataFrame:
    """One row with every count the basic score and the issue log need, from one scan of the rows."""
    numbers, texts = numeric_columns(df), text_columns(df)
    fences = iqr_fences(df, numbers) if numbers else {}
    total, zero = F.count(F.lit(1)), F.lit(0)
    math_cols = {"quantity", "unit_price", "total_amount"}
    broken = zero
    if math_cols <= set(df.columns):
        expected = cell("quantity").cast("double") * cell("unit_price").cast("double")
        if "discount_pct" in df.columns:
            expected = expected * (1 - F.coalesce(cell("discount_pct").cast("double"), F.lit(0.0)))
        broken = F.count_if(F.abs(cell("total_amount").cast("double") - expected) > 1.0)
    negative = zero
    for c in NON_NEGATIVE:
        if c in numbers:
            negative = negative + F.count_if(cell(c) < 0)
    return df.agg(
        total.alias("total_rows"),
        (total * len(df.columns)).alias("total_cells"),
        (total * len(numbers)).alias("checks"),
        negative.alias("negative_cells"),
        broken.alias("broken_rows"),
        F.create_map(*[x for c in df.columns for x in (F.lit(c), F.count_if(missing(df, c)))]).alias("nulls"),
        (
            F.create_map(*[x for c in texts for x in (F.lit(c), F.count_if(cell(c) != stripped(cell(c))))])
            if texts
            else F.lit(None).cast("map<string,bigint>")
        ).alias("padded"),
        (
            F.create_map(
                *[x for c in fences for x in (F.lit(c), F.count_if(outside(number(c), fences[c])))]
            )
            if fences
            else F.lit(None).cast("map<string,bigint>")
        ).alias("outliers"),
    )


def _sum_of(values: str) -> Column:
    return F.aggregate(F.coalesce(F.map_values(values), F.array()), F.lit(0).cast("bigint"), lambda a, x: a + x)


def basic_profile(df: DataFrame) -> DataFrame:
    """One row: the four part scores, the weighted overall score and the counts behind them."""
    facts = _facts(df)
    repeats = one_row(duplicate_rows(df), "duplicate_rows")
    rows = facts.select(
        "total_rows",
        "total_cells",
        _sum_of("nulls").alias("null_cells"),
        repeats.alias("duplicate_rows"),
        _sum_of("outliers").alias("outlier_count"),
        "checks",
        "negative_cells",
        "broken_rows",
    )

    def part(bad: str, of: str) -> Column:
        share = 1 - F.coalesce(ratio(bad, of), F.lit(0.0))
        return F.when(F.col("total_rows") == 0, 0).otherwise(_score100(share))

    scored = rows.withColumns(
        {
            "completeness_score": part("null_cells", "total_cells"),
            "uniqueness_score": part("duplicate_rows", "total_rows"),
            "validity_score": part("negative_cells", "checks"),
            "consistency_score": part("broken_rows", "total_rows"),
        }
    )
    overall = sum((F.lit(w) * F.col(f"{name}_score") for name, w in BASIC_WEIGHTS.items()), F.lit(0.0))
    return scored.select(
        F.bround(overall, 0).cast("int").alias("overall_score"),
        *[f"{name}_score" for name in BASIC_WEIGHTS],
        "total_rows",
        "total_cells",
        "null_cells",
        "duplicate_rows",
        "outlier_count",
    )


def basic_issues(df: DataFrame) -> DataFrame:
    """Issue log: repeats, missing values, padded text and outliers, with severity and action."""
    numbers = F.array(*[F.lit(c) for c in numeric_columns(df)]) if numeric_columns(df) else F.array().cast("array<string>")
    facts = _facts(df).withColumn("repeats", one_row(duplicate_rows(df), "duplicate_rows"))

    def entries(values: str, build) -> Column:
        pairs = F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:bigint>>"))
        return F.transform(F.filter(pairs, lambda e: e["value"] > 0), build)

    def issue(kind, severity, column, rows, action) -> Column:
        return F.struct(
            F.lit(kind).alias("issue_type"),
            severity.alias("severity"),
            column.alias("column_name"),
            rows.cast("bigint").alias("affected_rows"),
            action.alias("action_taken"),
        )

    def missing_issue(e: Column) -> Column:
        share = rounded(ratio(e["value"], F.col("total_rows")) * 100, 1)
        severity = F.when(share > 10, "HIGH").when(share > 2, "MEDIUM").otherwise("LOW")
        action = F.when(F.array_contains(numbers, e["key"]), "Median is filled in by cleaning").otherwise("Label UNKNOWN is set by cleaning")
        return issue("MISSING_VALUES", severity, e["key"], e["value"], action)

    def padded_issue(e: Column) -> Column:
        return issue("WHITESPACE_INCONSISTENCY", F.lit("LOW"), e["key"], e["value"], F.lit("Outer blanks are cut by cleaning"))

    outlying = F.transform(
        F.filter(
            F.coalesce(F.map_entries("outliers"), F.array().cast("array<struct<key:string,value:bigint>>")),
            lambda e: e["value"] > 0,
        ),
        lambda e: e["key"],
    )
    repeats = F.when(
        F.col("repeats") > 0,
        F.array(
            issue(
                "EXACT_DUPLICATE_ROWS",
                F.lit("HIGH"),
                F.lit("[ALL_COLUMNS]"),
                F.col("repeats"),
                F.lit("One copy is kept by cleaning"),
            )
        ),
    )
    outliers = F.when(
        F.size(outlying) > 0,
        F.array(
            issue(
                "STATISTICAL_OUTLIERS",
                F.lit("INFO"),
                F.array_join(F.slice(outlying, 1, 3), ", "),
                _sum_of("outliers"),
                F.lit("Reported only; values stay"),
            )
        ),
    )
    found = [repeats, entries("nulls", missing_issue), entries("padded", padded_issue), outliers]
    lists = F.flatten(F.array_compact(F.array(*found)))
    return facts.select(F.explode(lists).alias("i")).select("i.*")


# --- the weighted score ---------------------------------------------------------------------------


def weighted_completeness(df: DataFrame, mapping: Mapping[str, str]) -> Column:
    """Aggregate: missing share in percent, key roles weighing 3, other roles 2, unmapped columns 1."""
    role_of = {c: r for r, c in mapping.items()}
    weight = {c: 3 if role_of.get(c) in KEY_ROLES else 2 if c in role_of else 1 for c in df.columns}
    lost = sum((F.lit(w) * F.count_if(missing(df, c)) for c, w in weight.items()), F.lit(0))
    return F.coalesce(ratio(lost * 100, F.count(F.lit(1)) * sum(weight.values())), F.lit(0.0))


# Shapes of written dates, told apart by their separators and parts.
DATE_SHAPES = (
    ("iso_datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
    ("iso", r"^\d{4}-\d{2}-\d{2}$"),
    ("ymd_slash", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("slash", r"^\d{1,2}/\d{1,2}/\d{2,4}"),
    ("dash", r"^\d{1,2}-\d{1,2}-\d{2,4}"),
    ("dot", r"^\d{1,2}\.\d{1,2}\.\d{2,4}"),
    ("compact", r"^\d{8}$"),
    ("month_name", r"[A-Za-z]{3,}"),
)


def date_shape(c: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(DATE_SHAPES):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return F.when(c.isNotNull(), out)


def unparsable_cells(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Text cells that do not read as the type the column is meant to hold (``number`` or ``date``)."""
    bad, all_cells = F.lit(0), F.lit(0)
    for c, kind in columns.items():
        read = F.expr(f"try_cast(trim(`{c}`) AS {'double' if kind == 'number' else 'timestamp'})")
        bad = bad + F.count_if(cell(c).isNotNull() & read.isNull())
        all_cells = all_cells + F.count(cell(c))
    return df.agg(bad.alias("affected"), all_cells.alias("base"))


def mixed_format_cells(df: DataFrame, date_columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Cells not written in the dominant shape of their date column; typed numbers have one shape."""
    shapes = F.array(*[F.struct(F.lit(c).alias("column"), date_shape(cell(c)).alias("shape")) for c in date_columns])
    base = df.agg(sum((F.count(cell(c)) for c in numeric), F.lit(0)).alias("n"))
    if not date_columns:
        return base.select(F.lit(0).cast("bigint").alias("affected"), F.col("n").alias("base"))
    per = (
        df.select(F.explode(shapes).alias("s"))
        .where("s.shape IS NOT NULL")
        .groupBy("s.column", "s.shape")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(F.sum("n").alias("rows"), F.max("n").alias("main"))
    )
    return per.agg(
        F.coalesce(F.sum(F.col("rows") - F.col("main")), F.lit(0)).alias("affected"),
        (F.coalesce(F.sum("rows"), F.lit(0)) + one_row(base, "n")).alias("base"),
    )


def category_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every spelling of a category with its group key, count and the dominant spelling of the group.

    Values are counted first, so normalization (NFKC and case folding included) sees each spelling once.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("variant")) for c in columns])
    counts = (
        df.select(F.explode(cells).alias("c"))
        .where("c.variant IS NOT NULL")
        .groupBy("c.column", "c.variant")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    counts = counts.withColumn("key", normalized_text(_folded(F.col("variant"))))
    # Most frequent first, then the lexicographically smallest.
    best = counts.groupBy("column", "key").agg(
        F.min_by("variant", F.struct(-F.col("rows"), F.col("variant"))).alias("dominant")
    )
    return counts.join(best, ["column", "key"])


def variant_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = category_variants(df, columns)
    return found.agg(
        F.coalesce(F.sum(F.when(F.col("variant") != F.col("dominant"), F.col("rows"))), F.lit(0)).alias("affected"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("base"),
    )


def conflict_cells(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    rows = one_row(df.agg(F.count(F.lit(1)).alias("n")), "n")
    return header_conflicts(df, mapping).agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("affected"), rows.alias("base"))


def consistency_parts(
    df: DataFrame,
    mapping: Mapping[str, str],
    *,
    meant: Mapping[str, str] | None = None,
    date_text: Sequence[str] = (),
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    grain: str = "LINE_ITEMS",
) -> DataFrame:
    """The applicable parts of consistency: affected and examined cells with the part's weight."""
    parts = []
    if meant:
        parts.append(("type", 3, unparsable_cells(df, meant)))
    if date_text or numeric:
        parts.append(("format", 2, mixed_format_cells(df, date_text, numeric)))
    if categorical:
        parts.append(("category_variants", 2, variant_cells(df, categorical)))
    if grain == "LINE_ITEMS" and "transaction_id" in mapping:
        parts.append(("header_conflicts", 3, conflict_cells(df, mapping)))
    out = None
    for name, weight, frame in parts:
        row = frame.select(
            F.lit(name).alias("part"),
            F.lit(weight).alias("weight"),
            F.col("affected").cast("bigint").alias("affected"),
            F.col("base").cast("bigint").alias("base"),
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        out = fixed_rows(df.sparkSession, [], "part string, weight int, affected bigint, base bigint")
    return out.where("base > 0")


def _integral(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0


def discount_kind(df: DataFrame, column: str) -> str:
    """RATIO, PERCENT, AMOUNT or FLAG from the values and the column name."""
    x = cell(column).cast("double")
    row = df.agg(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.count_if(~x.isin(0.0, 1.0)).alias("other"), F.count(x).alias("n")
    ).first()
    name = column.lower()
    pct_name = any(t in name for t in ("pct", "percent", "%", "rate"))
    if not row["n"]:
        return "AMOUNT"
    if not row["other"] and not pct_name:
        return "FLAG"
    in_unit = row["lo"] >= 0 and row["hi"] <= 1 and row["other"] > 0
    if in_unit:
        return "RATIO"
    if pct_name and row["hi"] <= 100:
        return "PERCENT"
    if row["lo"] >= 0 and row["hi"] <= 100 and quantiles(df, [column], [0.5])[column][0.5] <= 50:
        return "PERCENT"
    return "AMOUNT"


def validity_rules(
    df: DataFrame, mapping: Mapping[str, str], as_of: dt.date, kind: str | None = None, whole_quantity: bool | None = None
) -> DataFrame:
    """One row per applicable rule: weight, violating rows and rows the rule could be checked on.

    Fractions of a quantity break a rule only where the column is integral: by its type, or as told.
    """
    at = {r: cell(c) for r, c in mapping.items()}
    rules = []
    if "price" in at:
        rules.append(("VAL-PRICE-NEG", 3, [at["price"]], at["price"] < 0))
    if "quantity" in at:
        q = at["quantity"].cast("double")
        bad = q == 0
        if whole_quantity if whole_quantity is not None else _integral(df, mapping["quantity"]):
            bad = bad | (q != F.floor(q))
        rules.append(("VAL-QTY", 2, [at["quantity"]], bad))
    if {"revenue", "quantity"} <= set(at):
        r, q = at["revenue"], at["quantity"]
        rules.append(("VAL-REV-SIGN", 3, [r, q], ((r < 0) & (q >= 0)) | ((r > 0) & (q < 0))))
    if "discount" in at and kind not in (None, "FLAG"):
        d = at["discount"].cast("double")
        if kind == "AMOUNT":
            bad = d < 0
            if {"price", "quantity"} <= set(at):
                bad = bad | (d > F.coalesce(at["price"] * at["quantity"], d))
        else:
            bad = (d < 0) | (d > (1 if kind == "RATIO" else 100))
        rules.append(("VAL-DISC", 2, [at["discount"]], bad))
    if "purchase_date" in at:
        day = F.expr(f"try_cast(`{mapping['purchase_date']}` AS timestamp)").cast("date")
        rules.append(("VAL-DATE", 3, [day], (day > F.lit(as_of)) | (day < F.lit(EARLIEST))))
    if "customer_age" in at:
        rules.append(("VAL-AGE", 2, [at["customer_age"]], ~at["customer_age"].between(0, 120)))
    if "gender" in at:
        rules.append(("VAL-GENDER", 1, [at["gender"]], ~F.lower(F.trim(at["gender"])).isin(*GENDER_TOKENS)))
    if not rules:
        return fixed_rows(df.sparkSession, [], "rule string, weight int, violations bigint, checked bigint")
    aggs = []
    for name, weight, inputs, bad in rules:
        known = F.lit(True)
        for c in inputs:
            known = known & c.isNotNull()
        aggs.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.lit(weight).alias("weight"),
                F.count_if(known & bad).alias("violations"),
                F.count_if(known).alias("checked"),
            )
        )
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r")).where("checked > 0")


def weighted_score(
    df: DataFrame, mapping: Mapping[str, str], as_of: dt.date, kind: str | None = None, **consistency
) -> DataFrame:
    """One row: the four dimension scores, the overall score and its band."""

    def share(frame: DataFrame, bad: str, of: str) -> DataFrame:
        return frame.agg(
            F.coalesce(ratio(F.sum(F.col("weight") * ratio(bad, of)) * 100, F.sum("weight")), F.lit(0.0)).alias("p")
        )

    rows = df.agg(F.count(F.lit(1)).alias("n"), weighted_completeness(df, mapping).alias("completeness"))
    cons = share(consistency_parts(df, mapping, **consistency), "affected", "base")
    valid = share(validity_rules(df, mapping, as_of, kind), "violations", "checked")
    uniq = ratio(one_row(duplicate_rows(df), "duplicate_rows") * 100, "n")
    parts = rows.select(
        "completeness",
        one_row(cons, "p").alias("consistency"),
        one_row(valid, "p").alias("validity"),
        F.coalesce(uniq, F.lit(0.0)).alias("uniqueness"),
    )
    scored = parts.select(
        *[(F.lit(100.0) - F.least(F.lit(100.0), F.lit(k) * F.col(d))).alias(d) for d, k in SENSITIVITY.items()]
    )
    overall = rounded(sum((F.lit(w) * F.col(d) for d, w in SCORE_WEIGHTS.items()), F.lit(0.0)), 2)
    band = F.when(F.col("overall") >= 85, "GOOD").when(F.col("overall") >= 70, "FAIR").otherwise("POOR")
    return scored.select(overall.alias("overall"), *[rounded(d, 2).alias(d) for d in SENSITIVITY]).withColumn("band", band)


def accuracy_indicators(df: DataFrame, mapping: Mapping[str, str], as_of: dt.date) -> DataFrame:
    """Counts that hint at wrong values without entering the score."""
    at = {r: cell(c) for r, c in mapping.items()}
    out = []
    if "revenue" in at:
        out += [F.count_if(at["revenue"] < 0).alias("negative_revenue_rows")]
        out += [F.count_if(at["revenue"] == 0).alias("zero_revenue_rows")]
    if {"revenue", "quantity"} <= set(at):
        out += [F.count_if((at["revenue"] < 0) & (at["quantity"] < 0)).alias("refund_rows")]
    if "purchase_date" in at:
        day = F.expr(f"try_cast(`{mapping['purchase_date']}` AS timestamp)").cast("date")
        out += [F.count_if(day > F.lit(as_of)).alias("future_date_rows")]
    if {"revenue", "price", "quantity"} <= set(at):
        gross = at["price"].cast("double") * at["quantity"].cast("double")
        off = F.abs(at["revenue"].cast("double") - gross) > F.greatest(F.lit(0.01), F.abs(gross) * 0.01)
        out += [F.count_if(off).alias("revenue_price_qty_mismatch_rows")]
        out += [rounded(ratio(F.count_if(~off), F.count_if(off.isNotNull())), 6).alias("revenue_consistency_ratio")]
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & missing(df, c)
    out.append(F.count_if(blank).alias("blank_rows"))
    return df.agg(*out)


# --- missingness ----------------------------------------------------------------------------------


def missingness(df: DataFrame, low: float = 5, moderate: float = 20, high: float = 50) -> DataFrame:
    """Missing cells per column with the severity band; a value on a boundary is in the lower band."""
    counts = F.array(
        *[F.struct(F.lit(c).alias("column"), F.count_if(missing(df, c)).alias("nulls")) for c in df.columns]
    )
    pct = ratio("nulls", "rows") * 100
    band = F.when(pct <= low, "LOW").when(pct <= moderate, "MODERATE").when(pct <= high, "HIGH").otherwise("CRITICAL")
    return (
        df.agg(F.count(F.lit(1)).alias("rows"), counts.alias("c"))
        .select("rows", F.inline("c"))
        .where("nulls > 0")
        .select("column", "nulls", rounded(pct, 4).alias("null_pct"), band.alias("severity"))
    )


def _gappy(df: DataFrame, most: int | None) -> list[str]:
    """Columns with missing cells, most missing first; only the first ``most`` where that is given."""
    row = df.agg(*[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    ranked_cols = sorted((-row[f"m{i}"], i) for i in range(len(df.columns)) if row[f"m{i}"])
    return [df.columns[i] for _, i in ranked_cols[:most]]


def co_missing(df: DataFrame, most: int | None = None) -> DataFrame:
    """P(A and B missing) / P(A missing) for every ordered pair of columns with gaps, or of the ``most`` with most gaps."""
    cols = _gappy(df, most)
    if not cols:
        return fixed_rows(df.sparkSession, [], "a string, b string, share double")
    cells = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            ratio(F.count_if(missing(df, a) & missing(df, b)), F.count_if(missing(df, a))).alias("share"),
        )
        for a in cols
        for b in cols
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c")).withColumn("share", rounded("share", 6)).orderBy("a", "b")


def missing_masks(df: DataFrame, k: int = 10, most: int | None = None) -> DataFrame:
    """The most frequent combinations of columns that are missing together, of all or of the ``most`` with most gaps."""
    cols = _gappy(df, most)
    if not cols:
        return fixed_rows(df.sparkSession, [], "mask string, rows bigint")
    mask = F.concat_ws(",", *[F.when(missing(df, c), F.lit(c)) for c in sorted(cols)])
    return (
        df.groupBy(mask.alias("mask"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("mask <> ''")
        .orderBy(F.desc("rows"), "mask")
        .limit(k)
    )


# --- outliers -------------------------------------------------------------------------------------

# Plausible limits per role.
DOMAIN_LIMITS = {"customer_age": (0, 120), "quantity": (None, 10_000), "price": (0, None), "revenue": (0, None)}


def outlier_report(df: DataFrame, columns: Sequence[str], mapping: Mapping[str, str] | None = None, k: float = 1.5) -> DataFrame:
    """Method, limits and counts of outliers per numeric column, or why a column was not assessed."""
    role_of = {c: r for r, c in (mapping or {}).items()}
    cut = quantiles(df, columns, [0.25, 0.75])
    aggs = []
    for i, c in enumerate(columns):
        x = number(c)
        aggs += [
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            adjusted_skewness(x).alias(f"skew{i}"),
        ]
    row = df.agg(*aggs).first()
    few = few_distinct(df, columns, 12)
    limits: dict[str, tuple] = {}
    for i, c in enumerate(columns):
        n, skew, std = cut[c]["n"], row[f"skew{i}"], row[f"std{i}"]
        if n < 20:
            limits[c] = ("too_few_values", None, None)
        elif cut[c]["min"] == cut[c]["max"]:
            limits[c] = ("constant", None, None)
        elif c in few:
            limits[c] = ("discrete", None, None)
        elif n >= 30 and skew is not None and abs(skew) < 1:
            limits[c] = ("ZSCORE", row[f"mean{i}"] - 3.0 * std, row[f"mean{i}"] + 3.0 * std)
        else:
            spread = cut[c][0.75] - cut[c][0.25]
            limits[c] = ("IQR", cut[c][0.25] - k * spread, cut[c][0.75] + k * spread)
    entries = []
    for c, (method, lo, hi) in limits.items():
        x = number(c)
        d_lo, d_hi = DOMAIN_LIMITS.get(role_of.get(c), (None, None))
        beyond = F.lit(False)
        if d_lo is not None:
            below = x < d_lo
            if role_of.get(c) in ("price", "revenue") and "quantity" in (mapping or {}):  # a return explains it
                below = below & ~F.coalesce(number(mapping["quantity"]) < 0, F.lit(False))
            beyond = beyond | below
        if d_hi is not None:
            beyond = beyond | (x > d_hi)
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(method).alias("method"),
                F.lit(lo).cast("double").alias("lower"),
                F.lit(hi).cast("double").alias("upper"),
                (F.count_if(x < lo) if lo is not None else F.lit(0)).cast("bigint").alias("low_count"),
                (F.count_if(x > hi) if hi is not None else F.lit(0)).cast("bigint").alias("high_count"),
                F.count_if(beyond).cast("bigint").alias("domain_count"),
            )
        )
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def few_distinct(df: DataFrame, columns: Sequence[str], most: int) -> set[str]:
    """Columns with at most ``most`` distinct numbers, exactly. A task hands on no more than ``most`` + 1 of a column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        seen = [pa.array([], pa.float64()) for _ in columns]
        for batch in batches:
            for i, have in enumerate(seen):
                if len(have) <= most:
                    seen[i] = pc.unique(pa.concat_arrays([have, batch.column(i).drop_null()]))[: most + 1]
        for i, have in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(i, pa.int32()), len(have)), have], names=["i", "v"])

    values = df.select(*[number(c).cast("double").alias(f"n{i}") for i, c in enumerate(columns)])
    found = values.mapInArrow(run, "i int, v double").distinct().groupBy("i").count().collect()
    many = {r["i"] for r in found if r["count"] > most}
    return {c for i, c in enumerate(columns) if i not in many}


def extreme_rows(df: DataFrame, column: str, order: Sequence[str], k: float = 1.5, rows: int = 100) -> DataFrame:
    """The rows furthest beyond the fences of a column, by distance to the nearer fence."""
    fences = iqr_fences(df, [column], k).get(column)
    x = number(column)
    if fences is None:
        return df.limit(0).withColumn("distance", F.lit(0.0))
    lo, hi = fences
    distance = F.when(x < lo, F.lit(lo) - x).when(x > hi, x - F.lit(hi))
    return (
        df.withColumn("distance", distance)
        .where("distance IS NOT NULL")
        .orderBy(F.desc("distance"), *order)
        .limit(rows)
    )


def ancestors(versions: DataFrame, version: object) -> DataFrame:
    """(version) of a version and all it was made from; ``versions`` holds (version, parent).

    Pointers are doubled: after k rounds each version points 2^k steps back, so that a line of n versions takes about log2(n) rounds.
    A line that comes back to itself is refused; versions beside the line do not matter. A parent that is no row of the table ends the line, and
    a version that is no row has only itself.
    """
    spark = versions.sparkSession
    jumps = stage(versions.where("version IS NOT NULL AND parent IS NOT NULL").select("version", "parent").distinct())
    count = versions.count()
    kind = versions.schema["version"].dataType
    line = spark.range(1).select(F.lit(version).cast(kind).alias("version"))
    steps = 1
    while True:
        further = stage(line.join(jumps, "version").select(F.col("parent").alias("version")))
        if further.isEmpty():
            return line
        if steps > count:
            raise ValueError(f"version {version} is its own ancestor")
        line = stage(line.union(further).distinct())
        back = jumps.select(F.col("version").alias("parent"), F.col("parent").alias("before"))
        jumps = stage(jumps.join(back, "parent").select("version", F.col("before").alias("parent")).distinct())
        steps *= 2


def lineage_issues(versions: DataFrame, operations: DataFrame, version: object) -> DataFrame:
    """Cleaning operations of a version and its ancestors as removed issues, which are never scored.

    ``versions``: (version, parent). ``operations``: (version, operation, column, rows_affected).
    """
    return (
        operations.join(ancestors(versions, version), "version")
        .where("rows_affected > 0")
        .select("version", F.col("operation").alias("issue_type"), "column", "rows_affected")
        .withColumn("handling", F.lit("REMOVED"))
        .withColumn("synthesized", F.lit(True))
    )
