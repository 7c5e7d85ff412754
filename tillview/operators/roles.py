"""Which business role each column plays, decided from names and profile figures.

The inputs are one row per column, so the decisions are made on the driver over metadata; the figures
they rest on come from Spark aggregations over every row.
"""

from __future__ import annotations

import datetime as dt
import difflib
import re
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.columns import columns_of, fixed_rows, numeric_columns, ratio, rounded, text_columns
from tillview.operators.eda import adjusted_skewness, number
from tillview.operators.ordering import quantiles
from tillview.operators.profile import distinct_counts
from tillview.operators.quality import GENDER_TOKENS, cell

# Name patterns of the simple mapper; the first role with any hit wins.
NAME_PATTERNS = {
    "TRANSACTION_DATE": [r"order_?date", r"date", r"trans(action)?_?date", r"created_?at", r"timestamp"],
    "CUSTOMER_ID": [r"cust(omer)?_?id", r"user_?id", r"client_?id", r"buyer_?id"],
    "ORDER_ID": [r"order_?id", r"invoice_?(no|num|id)?", r"trans(action)?_?id", r"receipt_?id"],
    "REVENUE": [r"total_?amount", r"revenue", r"sales", r"price_?total", r"net_?amount", r"amount"],
    "QUANTITY": [r"quantity", r"qty", r"items?_?count", r"volume", r"units"],
    "UNIT_PRICE": [r"unit_?price", r"item_?price", r"price", r"cost_?per_?unit"],
    "PRODUCT_ID": [r"product_?id", r"sku", r"item_?id", r"part_?number"],
    "PRODUCT_NAME": [r"product_?name", r"item_?name", r"title", r"description"],
    "CATEGORY": [r"category", r"department", r"prod(uct)?_?category", r"group"],
    "PAYMENT_METHOD": [r"payment_?method", r"payment_?type", r"pay_?mode", r"tender"],
    "GEOGRAPHY": [r"city", r"region", r"state", r"country", r"zip", r"postal"],
}

# Whole names and weak tokens per role, in role order.
VOCABULARY = {
    "CUSTOMER_ID": (
        (
            "customer_id", "cust_id", "customerid", "client_id", "user_id", "buyer_id", "member_id", "shopper_id",
            "customer_no", "customer_number", "customer_code",
        ),
        (
            "customer", "cust", "client", "buyer", "member",
        ),
    ),
    "TRANSACTION_ID": (
        (
            "transaction_id", "txn_id", "order_id", "invoice_no", "invoice_number", "invoice_id", "receipt_id",
            "receipt_no", "bill_no", "sale_id", "order_number", "order_no", "invoice",
        ),
        (
            "transaction", "txn", "invoice", "receipt", "order",
        ),
    ),
    "PRODUCT_ID": (
        (
            "product_id", "sku", "stock_code", "item_id", "article_id", "product_code", "item_code", "asin", "upc",
            "ean",
        ),
        (
            "sku", "stock", "article",
        ),
    ),
    "PRODUCT_NAME": (
        (
            "product_name", "product", "item_name", "item", "description", "product_description", "title",
            "article_name",
        ),
        (
            "product", "item", "description", "title",
        ),
    ),
    "CATEGORY": (
        (
            "category", "product_category", "item_category", "department", "product_type", "category_name",
        ),
        (
            "category", "department", "type",
        ),
    ),
    "QUANTITY": (
        (
            "quantity", "qty", "units", "units_sold", "quantity_sold", "pieces", "items_sold", "order_quantity",
        ),
        (
            "qty", "quantity", "units", "pieces",
        ),
    ),
    "PRICE": (
        (
            "price", "unit_price", "price_per_unit", "selling_price", "sale_price", "item_price", "unitprice",
            "rate",
        ),
        (
            "price", "rate",
        ),
    ),
    "REVENUE": (
        (
            "revenue", "sales", "sales_amount", "total_amount", "total_price", "net_sales", "order_value",
            "line_total", "gmv", "turnover", "total_revenue", "order_amount", "net_amount", "amount", "total",
        ),
        (
            "revenue", "sales", "amount", "total", "gmv",
        ),
    ),
    "DISCOUNT": (
        (
            "discount", "discount_pct", "discount_percent", "discount_amount", "discount_rate", "disc", "markdown",
            "promo_discount",
        ),
        (
            "discount", "disc", "markdown", "promo",
        ),
    ),
    "PURCHASE_DATE": (
        (
            "purchase_date", "order_date", "transaction_date", "invoice_date", "sale_date", "order_datetime",
            "purchase_time", "date", "timestamp", "invoicedate",
        ),
        (
            "date", "time", "timestamp", "datetime",
        ),
    ),
    "CUSTOMER_AGE": (
        (
            "customer_age", "age", "buyer_age",
        ),
        (
            "age",
        ),
    ),
    "GENDER": (
        (
            "gender", "sex", "customer_gender",
        ),
        (
            "gender", "sex",
        ),
    ),
    "CITY": (
        (
            "city", "town", "shipping_city", "billing_city", "customer_city",
        ),
        (
            "city", "town",
        ),
    ),
    "STATE": (
        (
            "state", "province", "state_code", "region", "customer_state",
        ),
        (
            "state", "province", "region",
        ),
    ),
    "COUNTRY": (
        (
            "country", "nation", "country_code", "ship_country", "customer_country",
        ),
        (
            "country", "nation",
        ),
    ),
    "PAYMENT_METHOD": (
        (
            "payment_method", "payment_type", "payment_mode", "pay_method", "payment", "tender_type",
        ),
        (
            "payment", "tender",
        ),
    ),
}
EXACT = {role: list(whole) for role, (whole, _) in VOCABULARY.items()}
WEAK = {role: list(weak) for role, (_, weak) in VOCABULARY.items()}
_TEXT = ("CATEGORICAL", "TEXT", "IDENTIFIER")
_NUMBER = ("INTEGER", "NUMERIC", "FLOAT")
# The types a role may have.
ALLOWED = {
    **{r: ("IDENTIFIER", "INTEGER", "CATEGORICAL", "TEXT") for r in ("CUSTOMER_ID", "TRANSACTION_ID", "PRODUCT_ID")},
    **{r: _TEXT for r in ("PRODUCT_NAME", "CITY", "STATE", "COUNTRY")},
    **{r: ("CATEGORICAL", "TEXT") for r in ("CATEGORY", "GENDER", "PAYMENT_METHOD")},
    **{r: _NUMBER for r in ("QUANTITY", "PRICE", "REVENUE", "DISCOUNT")},
    "PURCHASE_DATE": ("DATE", "DATETIME"),
    "CUSTOMER_AGE": ("INTEGER", "NUMERIC"),
}
# Words that payment methods are written with.
PAYMENT_TOKENS = (
    "cash", "card", "credit", "debit", "upi", "wallet", "netbanking", "net banking", "paypal", "cod", "cheque", "emi", "gift card",
)
FLOOR, ACCEPT = 0.45, 0.75


def simple_mapping(df: DataFrame) -> DataFrame:
    """Role per column by name: 0.99 for a whole match, 0.85 for a partial one, else by type."""
    rows = []
    for name, kind in df.dtypes:
        text = name.lower().strip()
        hit = next(
            ((role, 0.99 if re.fullmatch(p, text) else 0.85) for role, ps in NAME_PATTERNS.items() for p in ps if re.search(p, text)),
            None,
        )
        if hit is None and kind in ("date", "timestamp"):
            hit = ("TRANSACTION_DATE", 0.70)
        elif hit is None:
            hit = ("NUMERIC_METRIC", 0.60) if name in numeric_columns(df) else ("CATEGORICAL_DIMENSION", 0.60)
        rows.append((name, kind, *hit))
    return fixed_rows(df.sparkSession, rows, "column string, type string, role string, confidence double")


# --- figures per column ---------------------------------------------------------------------------


def country_names(spark: SparkSession) -> set[str]:
    """Two- and three-letter codes and English names, from the locale data of the Java runtime."""
    locale = spark.sparkContext._jvm.java.util.Locale
    english = locale.ENGLISH
    out = set()
    for code in locale.getISOCountries():
        place = locale.forLanguageTag(f"und-{code}")
        out |= {code.lower(), place.getISO3Country().lower(), place.getDisplayCountry(english).lower()}
    return out


def role_figures(df: DataFrame, types: Mapping[str, str], as_of: dt.date, countries: Collection[str] = ()) -> dict[str, dict]:
    """Per column: rows, gaps, distinct values and the shares the value patterns ask for."""
    numbers = [c for c in numeric_columns(df) if types.get(c) in _NUMBER]
    texts = text_columns(df)
    dates = [c for c in df.columns if types.get(c) in ("DATE", "DATETIME")]
    cut = quantiles(df, numbers, [0.5]) if numbers else {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(cell(c)).alias(f"n{i}"))
        if c in numbers:
            x = number(c)
            aggs += [
                F.avg((x > 0).cast("int")).alias(f"positive{i}"),
                F.avg((x >= 0).cast("int")).alias(f"non_negative{i}"),
                F.avg((x == F.floor(x)).cast("int")).alias(f"whole{i}"),
                F.avg(x.between(0, 120).cast("int")).alias(f"age{i}"),
                F.stddev_samp(x).alias(f"std{i}"),
                adjusted_skewness(x).alias(f"skew{i}"),
            ]
        elif c in dates:
            day = cell(c).cast("date")
            ok = day.between(F.lit(dt.date(1990, 1, 1)), F.lit(as_of + dt.timedelta(days=366)))
            aggs.append(F.avg(ok.cast("int")).alias(f"plausible{i}"))
        elif c in texts:
            low = F.lower(F.trim(cell(c)))
            aggs += [
                F.avg(F.length(cell(c))).alias(f"length{i}"),
                F.avg(low.isin(*GENDER_TOKENS).cast("int")).alias(f"gender{i}"),
                F.avg(low.rlike("|".join(PAYMENT_TOKENS)).cast("int")).alias(f"payment{i}"),
                F.avg(low.isin(*sorted(countries)).cast("int") if countries else F.lit(0)).alias(f"country{i}"),
            ]
    row = df.agg(*aggs).first().asDict()
    distinct = {r["column"]: r["unique_count"] for r in distinct_counts(df).collect()}  # one row per column
    out = {}
    for i, c in enumerate(df.columns):
        own = {re.sub(r"\d+$", "", k): v for k, v in row.items() if re.fullmatch(rf"[a-z_]+{i}", k)}
        rows, n = row["rows"], row[f"n{i}"]
        out[c] = {
            **own,
            "rows": rows,
            "n": n,
            "unique": distinct.get(c, 0),
            "null_pct": 100.0 * (rows - n) / rows if rows else 0.0,
            "unique_pct": 100.0 * distinct.get(c, 0) / n if n else 0.0,
            "median": cut[c][0.5] if c in cut else None,
            "max": cut[c]["max"] if c in cut else None,
        }
    return out


# --- scoring --------------------------------------------------------------------------------------


def name_score(name: str, role: str) -> float:
    tokens = name.split("_")
    if name in EXACT[role]:
        return 1.0
    for synonym in EXACT[role]:
        parts = synonym.split("_")
        if any(tokens[k : k + len(parts)] == parts for k in range(len(tokens) - len(parts) + 1)):
            return 0.85
    if any(difflib.SequenceMatcher(None, name, s).ratio() >= 0.90 for s in EXACT[role]):
        return 0.70
    return 0.55 if set(tokens) & set(WEAK[role]) else 0.0


def value_score(role: str, kind: str, f: Mapping, revenue_max: float | None = None) -> float:
    """How well the figures of a column fit a role, 0 to 1."""
    rows, unique = f["rows"], f["unique"]

    def share(name: str) -> float:
        return f.get(name) or 0.0

    if role == "CUSTOMER_ID":
        return 0.0 if unique < 2 else 1.0 if unique <= 0.9 * rows else 0.6
    if role == "TRANSACTION_ID":
        return 1.0 if f["unique_pct"] >= 50 and f["null_pct"] <= 1 else 0.6 if unique > 2 else 0.0
    if role == "PRODUCT_ID":
        return 1.0 if 2 <= unique <= 0.9 * rows else 0.5
    if role == "PRODUCT_NAME":
        return 1.0 if share("length") >= 3 and unique <= 0.5 * rows else 0.5
    if role == "CATEGORY":
        return 1.0 if kind == "CATEGORICAL" and 2 <= unique <= 200 else 0.7 if kind == "TEXT" and unique <= 200 else 0.0
    if role == "QUANTITY":
        fits = share("whole") == 1 and share("positive") >= 0.9 and f["median"] <= 100 and f["max"] <= 10_000
        return 1.0 if fits else 0.6
    if role == "PRICE":
        return 1.0 if share("non_negative") >= 0.95 and f["median"] > 0 else 0.5
    if role == "REVENUE":
        return 1.0 if share("non_negative") >= 0.9 and f["median"] > 0 and (f.get("skew") or 0) > 0 else 0.7
    if role == "DISCOUNT":
        top = f["max"] if f["max"] is not None else float("inf")
        fits = share("non_negative") >= 0.9 and (top <= 100 or (revenue_max is not None and top <= revenue_max))
        return 1.0 if fits else 0.5
    if role == "PURCHASE_DATE":
        return 1.0 if share("plausible") >= 0.95 else 0.4
    if role == "CUSTOMER_AGE":
        fits = share("whole") == 1 and share("age") >= 0.95 and 10 <= (f["median"] or 0) <= 90
        return 1.0 if fits else 0.5
    if role == "GENDER":
        return 1.0 if unique <= 6 and share("gender") >= 0.9 else 0.0
    if role == "COUNTRY":
        return 1.0 if share("country") >= 0.8 else 0.4
    if role in ("STATE", "CITY"):
        return 1.0 if unique <= (100 if role == "STATE" else 20_000) else 0.5
    if role == "PAYMENT_METHOD":
        if kind != "CATEGORICAL" or unique > 20:
            return 0.0
        return 1.0 if share("payment") >= 0.4 else 0.6
    raise KeyError(role)


@dataclass
class Assignment:
    mapping: dict[str, str]  # role -> column
    confidence: dict[str, float]  # role -> confidence
    candidates: list[tuple[str, str, float]] = field(default_factory=list)  # (column, role, confidence) below acceptance
    notes: dict[str, str] = field(default_factory=dict)


def assign(figures: Mapping[str, Mapping], types: Mapping[str, str], intended_dates: Mapping[str, float] | None = None) -> Assignment:
    """Best confidence first; a column and a role are used once; 0.75 is needed to be assigned."""
    columns, roles = list(figures), list(VOCABULARY)
    revenue_max = max(
        (figures[c]["max"] for c in columns if types.get(c) in _NUMBER and name_score(c, "REVENUE") >= 0.85 and figures[c]["max"] is not None),
        default=None,
    )
    scored = []
    for i, c in enumerate(columns):
        for k, r in enumerate(roles):
            kind = types.get(c)
            if r == "PURCHASE_DATE" and (intended_dates or {}).get(c, 0) >= 0.90:
                kind = "DATE"
            if kind not in ALLOWED[r]:
                continue
            confidence = round(0.60 * name_score(c, r) + 0.40 * value_score(r, kind, figures[c], revenue_max), 4)
            if confidence >= FLOOR:
                scored.append((-confidence, i, k, c, r))
    out = Assignment({}, {})
    used: set[str] = set()
    for neg, _, _, c, r in sorted(scored):
        if -neg >= ACCEPT and c not in used and r not in out.mapping:
            out.mapping[r], out.confidence[r] = c, -neg
            used.add(c)
    out.candidates = [(c, r, -neg) for neg, _, _, c, r in sorted(scored) if -neg < ACCEPT and c not in used]
    dates = [c for c in columns if types.get(c) in ("DATE", "DATETIME")]
    if "PURCHASE_DATE" not in out.mapping and len(dates) == 1 and (figures[dates[0]].get("plausible") or 0) >= 0.95:
        out.mapping["PURCHASE_DATE"], out.confidence["PURCHASE_DATE"] = dates[0], 0.75
        out.notes["PURCHASE_DATE"] = "sole_date_column"
    return out


def mapping_table(spark: SparkSession, found: Assignment) -> DataFrame:
    rows = [(r, c, found.confidence[r], found.notes.get(r)) for r, c in found.mapping.items()]
    return fixed_rows(spark, rows, "role string, column string, confidence double, note string")


# --- checks on a mapping --------------------------------------------------------------------------


def validate_mapping(df: DataFrame, mapping: Mapping[str, str], as_of: dt.date) -> DataFrame:
    """One row per check: the share it found, its limit and whether it holds. Roles in lower case."""
    rows = F.count(F.lit(1))
    checks = []

    def check(name: str, role: str, share, limit: float, above: bool) -> None:
        ok = share >= limit if above else share <= limit
        checks.append(
            F.struct(
                F.lit(name).alias("check"),
                F.lit(role).alias("role"),
                rounded(share, 6).alias("value"),
                F.lit(float(limit)).alias("limit"),
                F.coalesce(ok, F.lit(False)).alias("ok"),
            )
        )

    for role, c in mapping.items():
        check("COVERAGE", role, ratio(F.count_if(cell(c).isNull()) * 100, rows), 50, False)
    if "purchase_date" in mapping:
        c = mapping["purchase_date"]
        day = F.expr(f"try_cast(`{c}` AS timestamp)").cast("date")
        check("DATE_PARSED", "purchase_date", ratio(F.count(day), F.count(cell(c))), 0.9, True)
        ok = day.between(F.lit(dt.date(1990, 1, 1)), F.lit(as_of + dt.timedelta(days=366)))
        check("DATE_PLAUSIBLE", "purchase_date", ratio(F.count_if(ok), F.count(day)), 0.9, True)
    for role in ("revenue", "price"):
        if role in mapping:
            x = number(mapping[role])
            check("NOT_CONSTANT", role, F.when(F.max(x) > F.min(x), 1.0).otherwise(0.0), 1.0, True)
    if {"price", "quantity", "revenue"} <= set(mapping):
        gross = number(mapping["price"]) * number(mapping["quantity"])
        near = F.abs(number(mapping["revenue"]) - gross) <= F.greatest(F.lit(0.01), F.abs(gross) * 0.01)
        check("REVENUE_IS_PRICE_TIMES_QUANTITY", "revenue", ratio(F.count_if(near), F.count(near)), 0.8, True)
    return df.agg(F.array(*checks).alias("c")).select(F.inline("c"))


def derived_settings(df: DataFrame, mapping: Mapping[str, str]) -> dict[str, str | None]:
    """How revenue, discount, orders and frequency are to be read under a mapping (roles in lower case)."""
    from tillview.operators.quality import discount_kind

    out: dict[str, str | None] = {
        "revenue_basis": "OBSERVED" if "revenue" in mapping else "DERIVED_GROSS" if {"price", "quantity"} <= set(mapping) else None,
        "discount_kind": discount_kind(df, mapping["discount"]) if "discount" in mapping else None,
        "frequency_basis": "ORDERS" if "transaction_id" in mapping else "ROWS",
        "order_grain": "UNDEFINED",
    }
    if "transaction_id" in mapping:
        order = cell(mapping["transaction_id"])
        rows = df.where(order.isNotNull()).groupBy(*[cell(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
        per = rows.groupBy(order.alias("o")).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("kinds"))
        row = per.agg(
            ratio(F.sum(F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)), F.sum("rows")).alias("shared"),
            F.max("kinds").alias("kinds"),
        ).first()
        lines = (row["shared"] or 0) >= 0.02 and row["kinds"] > 1
        out["order_grain"] = "LINE_ITEMS" if lines else "ORDER_LEVEL"
    return out


# Roles each module needs; any one of a tuple will do. Orders exist only where revenue is mapped.
MODULES = {
    "SALES": (("revenue",),),
    "ORDERS": (("transaction_id",), ("revenue",)),
    "CUSTOMERS": (("customer_id",),),
    "RFM": (("customer_id",), ("purchase_date",), ("revenue",)),
    "SEGMENTATION": (("customer_id",), ("purchase_date",), ("revenue",)),
    "PRODUCTS": (("product_id", "product_name"), ("revenue", "quantity")),
    "DISCOUNT": (("discount",), ("revenue",)),
    "PAYMENT": (("payment_method",),),
    "GEOGRAPHY": (("country", "state", "city"),),
    "TIME": (("purchase_date",), ("revenue",)),
    "LOYALTY": (("customer_id",), ("purchase_date",), ("transaction_id",), ("revenue",)),
}


def availability(spark: SparkSession, mapped: Sequence[str]) -> DataFrame:
    """State of every module with the roles it lacks and the reason shown to the user."""
    have = set(mapped)
    if {"price", "quantity"} <= have:
        have.add("revenue")
    need = fixed_rows(
        spark,
        [(m, i, "|".join(alternatives), bool(set(alternatives) & have)) for m, rs in MODULES.items() for i, alternatives in enumerate(rs)],
        "module string, position int, role string, present boolean",
    )
    lacking = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("present"), F.col("role")))), ", ")
    return (
        need.groupBy("module")
        .agg(lacking.alias("missing_roles"))
        .select(
            "module",
            F.when(F.col("missing_roles") == "", "AVAILABLE").otherwise("UNAVAILABLE").alias("state"),
            "missing_roles",
            F.when(F.col("missing_roles") != "", F.concat(F.lit("Required columns are not mapped: "), "missing_roles")).alias(
                "reason"
            ),
        )
        .orderBy("module")
    )


def logical_types(df: DataFrame) -> dict[str, str]:
    """Logical types of an already typed table, text columns being told apart by their figures."""
    from pyspark.sql import types as T

    out = {c: "INTEGER" for c in columns_of(df, T.IntegerType, T.LongType, T.ShortType, T.ByteType)}
    out |= {c: "NUMERIC" for c in columns_of(df, T.DecimalType)} | {c: "FLOAT" for c in columns_of(df, T.DoubleType, T.FloatType)}
    out |= {c: "DATE" for c in columns_of(df, T.DateType)} | {c: "DATETIME" for c in columns_of(df, T.TimestampType)}
    out |= {c: "BOOLEAN" for c in columns_of(df, T.BooleanType)}
    texts = text_columns(df)
    if texts:
        from tillview.operators.typing import infer_types

        out |= {t.column: "TEXT" if t.type == "MIXED" else t.type for t in infer_types(df, texts)}
    return out
