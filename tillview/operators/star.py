"""The star schema: keyed dimensions, the fact at line grain, its checks, and the measures over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillview.functions.columns import fixed_rows, month_of, one_row, ratio, rounded
from tillview.operators import rfm, templates
from tillview.operators.ordering import ranked
from tillview.operators.relations import Relations, Unavailable
from tillview.session import stage, unstage
from tillview.sources.transactions import TransactionSource

UNKNOWN_KEY, UNKNOWN = -1, "Unknown"
SEGMENT_LABELS = dict(zip(rfm.SPEC_SEGMENTS, ("High Value", "Regular", "Occasional", "At Risk")))


@dataclass
class Star:
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables


def with_line_id(df: DataFrame, name: str = "line_id") -> DataFrame:
    """A 1-based row number in the total order of all columns, which does not depend on file layout."""
    return ranked(df, [F.col(f"`{c}`") for c in df.columns], rank=name).select(name, *df.columns)


def keyed(df: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """Distinct rows numbered from 1 in the order of their natural key."""
    return ranked(df, [F.col(c) for c in natural], rank=key).select(F.col(key).cast("bigint").alias(key), *df.columns)


def _with_unknown(df: DataFrame, key: str, texts: Sequence[str]) -> DataFrame:
    """Append the member that lines without a natural key point to."""
    member = df.sparkSession.range(1).select(
        *[
            F.lit(UNKNOWN_KEY).cast("bigint").alias(c)
            if c == key
            else F.lit(UNKNOWN).alias(c)
            if c in texts
            else F.lit(None).cast(df.schema[c].dataType).alias(c)
            for c in df.columns
        ]
    )
    return df.withColumn("is_unknown", F.lit(False)).unionByName(member.withColumn("is_unknown", F.lit(True)))


# --- dimensions -----------------------------------------------------------------------------------


def dim_customer(rel: Relations) -> DataFrame:
    """One row per customer with lifetime figures, scores and segment as of the reference date."""
    people = rel.customers()
    count, text = F.col("order_count"), F.col("order_count").cast("string")
    made = {
        "customer_id": F.col("customer_id"),
        **{c: F.col(c) for c in ("first_purchase_date", "last_purchase_date") if c in people.columns},
        "order_count": count,
        "lifetime_revenue": F.col("total_revenue"),
        "purchase_frequency_bucket": F.when(count >= 5, "5+").otherwise(text),
        "purchase_frequency_sort": F.least(count, F.lit(5)).cast("int"),
    }
    out = people.select(*[e.alias(c) for c, e in made.items()])
    extra = [c for c in ("customer_age", "gender") if rel.source.has(c)]
    if extra:
        about = rel.tx("customer_id", *extra).groupBy("customer_id").agg(*[F.min(c).alias(c) for c in extra])
        out = out.join(about, "customer_id", "left")
    try:
        scores = rel.customer_rfm()
    except Unavailable:
        return keyed(out, ["customer_id"], "customer_key")
    labels = F.create_map(*[F.lit(x) for pair in SEGMENT_LABELS.items() for x in pair])
    scores = scores.select(
        "customer_id",
        F.col("recency_days").alias("rfm_recency_days"),
        F.col("frequency").alias("rfm_frequency"),
        F.col("monetary").alias("rfm_monetary"),
        "r_score",
        "f_score",
        "m_score",
        "rfm_score",
        rfm.segment().alias("segment_code"),
    ).withColumns({"segment": labels[F.col("segment_code")], "segment_sort": rfm.segment_order("segment_code")})
    return keyed(out.join(scores, "customer_id", "left"), ["customer_id"], "customer_key")


def _natural_product(rel: Relations) -> list[str]:
    if rel.source.lookup("product_id"):
        return ["product_id"]
    return [c for c in ("product_id", "product_name") if rel.source.has(c)]


def dim_product(rel: Relations) -> DataFrame:
    """One row per product and category, so category totals match the lines."""
    ids = _natural_product(rel)
    about = [c for c in ("product_id", "product_name", "category") if rel.source.has(c)]
    lookup = rel.source.lookup("product_id")
    if lookup:
        rows = rel.tx("product_id").where(F.col("product_id").isNotNull()).distinct()
        rows = rows.join(lookup.pick([c for c in about if c != "product_id"]), "product_id", "left")
    else:
        rows = rel.tx(*about)
    natural = F.coalesce(*[F.col(c) if len(ids) == 1 else F.col(c).cast("string") for c in ids]) if ids else F.col("category")
    rows = rows.withColumn("product_natural_key", natural).where("product_natural_key IS NOT NULL")
    if "category" in about:
        rows = rows.withColumn("category", F.coalesce("category", F.lit(UNKNOWN)))
    keys = ["product_natural_key"] + (["category"] if "category" in about else [])
    others = [c for c in about if c not in keys]
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in others]).drop("_n")
    grouped = grouped.fillna(UNKNOWN, subset=[c for c in others if c == "product_name"])
    out = keyed(grouped, keys, "product_key")
    return _with_unknown(out, "product_key", [c for c in ("product_name", "category") if c in out.columns])


def dim_date(rel: Relations) -> DataFrame:
    """Every day of the years the data touches, with completeness flags relative to the data."""
    first, last = rel.bounds
    if first is None:
        raise Unavailable("A purchase date is required.")
    start = F.make_date(F.lit(first.year), F.lit(1), F.lit(1))
    days = (last.replace(month=12, day=31) - first.replace(month=1, day=1)).days + 1
    d, lo, hi = F.col("date"), F.lit(first), F.lit(last)
    return (
        rel.spark.range(0, days, 1, 1)
        .select(F.date_add(start, F.col("id").cast("int")).alias("date"))
        .select(
            F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
            "date",
            F.year(d).alias("year"),
            F.quarter(d).alias("quarter"),
            F.month(d).alias("month"),
            F.day(d).alias("day"),
            F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.year(d)).alias("quarter_label"),
            F.date_format(d, "MMMM").alias("month_name"),
            F.date_format(d, "MMM").alias("month_short"),
            F.date_format(d, "yyyy-MM").alias("year_month"),
            month_of(d).alias("month_start"),
            F.last_day(d).alias("month_end"),
            F.trunc(d, "week").alias("week_start"),
            F.weekofyear(d).alias("iso_week"),
            (F.weekday(d) + 1).alias("day_of_week"),
            F.date_format(d, "EEEE").alias("day_name"),
            (F.weekday(d) >= 5).alias("is_weekend"),
            (F.year(d) * 100 + F.month(d)).alias("month_sort"),
            d.between(lo, hi).alias("in_data_range"),
            ((lo <= month_of(d)) & (hi >= F.last_day(d))).alias("month_is_complete"),
            ((lo <= F.trunc(d, "week")) & (hi >= F.date_add(F.trunc(d, "week"), 6))).alias("week_is_complete"),
            (
                (lo <= F.make_date(F.year(d), F.lit(1), F.lit(1))) & (hi >= F.make_date(F.year(d), F.lit(12), F.lit(31)))
            ).alias("year_is_complete"),
        )
    )


def _levels(rel: Relations) -> list[str]:
    return [c for c in ("country", "state", "city") if rel.source.has(c)]


def dim_location(rel: Relations) -> DataFrame:
    """The combinations of the mapped levels that occur, labelled by the most specific one."""
    levels = _levels(rel)
    places = rel.tx(*levels).distinct().where(F.coalesce(*[F.col(c) for c in levels]).isNotNull())
    label = F.coalesce(*[F.col(c) for c in reversed(levels)])
    places = places.withColumn("location_label", label).fillna(UNKNOWN, subset=levels)
    return _with_unknown(keyed(places, levels, "location_key"), "location_key", [*levels, "location_label"])


def dim_payment(rel: Relations) -> DataFrame:
    methods = rel.tx("payment_method").where(F.col("payment_method").isNotNull()).distinct()
    return _with_unknown(keyed(methods, ["payment_method"], "payment_key"), "payment_key", ["payment_method"])


def dim_discount_band(spark: SparkSession) -> DataFrame:
    rows = [(k, name, k) for k, name, _ in templates.DISCOUNT_BANDS] + [(UNKNOWN_KEY, UNKNOWN, 6)]
    return fixed_rows(spark, rows, "discount_band_key int, discount_band string, band_order int")


# --- fact -----------------------------------------------------------------------------------------


def fact_sales(rel: Relations, star: Mapping[str, DataFrame]) -> DataFrame:
    """One row per line with surrogate keys. Lines per order are counted once per order and joined back,
    so an order of any size is folded before it meets its lines."""
    rel.require("revenue")
    has = rel.source.has
    if _split(rel, star):
        return _fact_of_tables(rel, star)
    ids = _natural_product(rel) if "dim_product" in star else []
    levels = _levels(rel) if "dim_location" in star else []
    inputs = dict.fromkeys(
        [
            *[c for c in ("transaction_id", "customer_id", "purchase_date", "payment_method") if has(c)],
            *ids,
            *(["category"] if "dim_product" in star and has("category") else []),
            *levels,
            *[c for c in ("quantity", "price", "revenue", "discount") if has(c)],
        ]
    )
    lines = rel.tx(*inputs)
    out = [c for c in ("quantity", "revenue") if has(c)]
    if has("price"):
        lines = lines.withColumn("unit_price", F.col("price"))
        out.insert(1, "unit_price")
    if has("transaction_id"):
        sizes = (
            lines.where("transaction_id IS NOT NULL")
            .groupBy("transaction_id")
            .agg(F.count(F.lit(1)).alias("order_line_count"))
        )
        size = F.col("order_line_count")
        lines = lines.join(sizes, "transaction_id", "left").withColumns(
            {
                "has_transaction_id": F.col("transaction_id").isNotNull(),
                "order_size_bucket": _size_bucket(size),
            }
        )
        out += ["transaction_id", "has_transaction_id", "order_line_count", "order_size_bucket"]
    if "dim_customer" in star:
        people = star["dim_customer"].select("customer_id", "customer_key")
        lines = lines.join(people, "customer_id", "left").withColumn("has_customer", F.col("customer_id").isNotNull())
        out += ["customer_key", "has_customer"]
    if "dim_product" in star:
        natural = F.coalesce(*[F.col(c) if len(ids) == 1 else F.col(c).cast("string") for c in ids]) if ids else F.col("category")
        on = {"product_natural_key": natural}
        if has("category"):
            on["category"] = F.coalesce("category", F.lit(UNKNOWN))
        goods = star["dim_product"].where("NOT is_unknown").select("product_key", *on)
        lines = lines.withColumns(on).join(goods, list(on), "left")
        lines = lines.withColumn("product_key", F.coalesce("product_key", F.lit(UNKNOWN_KEY)))
        out.append("product_key")
    if "dim_location" in star:
        places = star["dim_location"].where("NOT is_unknown").select("location_key", *levels)
        lines = lines.fillna(UNKNOWN, subset=levels).join(places, levels, "left")
        lines = lines.withColumn("location_key", F.coalesce("location_key", F.lit(UNKNOWN_KEY)))
        out.append("location_key")
    if "dim_payment" in star:
        methods = star["dim_payment"].where("NOT is_unknown").select("payment_key", "payment_method")
        lines = lines.join(methods, "payment_method", "left")
        lines = lines.withColumn("payment_key", F.coalesce("payment_key", F.lit(UNKNOWN_KEY)))
        out.append("payment_key")
    if has("purchase_date"):
        lines = lines.withColumn("date_key", F.date_format("purchase_date", "yyyyMMdd").cast("int"))
        out.append("date_key")
    if "dim_discount_band" in star:
        band = F.coalesce(templates.discount_band_key(), F.lit(UNKNOWN_KEY))
        lines = lines.withColumns({"discount_band_key": band, "discount_pct": F.col("discount")})
        out += ["discount_band_key", "discount_pct"]
    return _numbered(lines, out)


def _numbered(lines: DataFrame, out: Sequence[str]) -> DataFrame:
    front = [c for c in ("transaction_id", "product_key", "quantity", "revenue", "discount_pct") if c in out]
    return with_line_id(lines.select(*front, *[c for c in out if c not in front]))


def _size_bucket(size: Column) -> Column:
    return F.when(size >= 10, "10+").otherwise(size.cast("string"))


def _split(rel: Relations, star: Mapping[str, DataFrame]) -> bool:
    """Whether customer, payment, place and date come with the order and the category with the product."""
    source = rel.source
    if not (source.lookup("transaction_id") and source.lookup("product_id") and "dim_product" in star):
        return False
    of_order = {c for c in ("customer_id", "purchase_date", "payment_method", *_levels(rel)) if source.has(c)}
    of_line = {c for c in ("transaction_id", "product_id", "quantity", "price", "revenue", "discount") if source.has(c)}
    own = set(source.lines.columns)
    return (
        of_line <= own
        and {"transaction_id", "product_id"} <= own
        and of_order <= source.reached_from("transaction_id") - own
        and not of_order & source.reached_from("product_id")
        and (not source.has("category") or "category" in source.lookup("product_id").columns)
    )


def _fact_of_tables(rel: Relations, star: Mapping[str, DataFrame]) -> DataFrame:
    """The fact where orders and products are tables of their own: their keys are looked up at their grain, so a line
    is shuffled once for its product, once for its order and once for its number, and carries keys only."""
    has, source = rel.source.has, rel.source
    goods = star["dim_product"].where("NOT is_unknown").withColumnRenamed("product_natural_key", "_natural")
    known = goods.select(F.col("_natural").alias("product_id")).distinct()
    on = ["_natural"]
    if has("category"):
        on.append("category")
        known = known.join(source.lookup("product_id").pick(["category"]), "product_id", "left").withColumn("category", F.coalesce("category", F.lit(UNKNOWN)))
    known = known.withColumn("_natural", F.col("product_id")).join(goods.select("product_key", *on), on, "left").select("product_id", "product_key")
    figures = [c for c in ("quantity", "price", "revenue", "discount") if has(c)]
    lines = source.lines.select("transaction_id", "product_id", *figures)
    lines = lines.join(known, "product_id", "left").drop("product_id")
    lines = stage(lines.withColumn("product_key", F.coalesce("product_key", F.lit(UNKNOWN_KEY))))

    # Orders with the keys of what comes with them, for every transaction of the lines, and the number of its lines.
    levels = _levels(rel) if "dim_location" in star else []
    of_order = [c for c in ("customer_id", "purchase_date", "payment_method") if has(c)] + levels
    others = [lk for lk in source.lookups if lk.key != "transaction_id"]
    heads = TransactionSource(source.lookup("transaction_id").frame, others).select("transaction_id", *of_order)
    heads = heads.where(F.col("transaction_id").isNotNull())
    made: list[str] = []
    if "dim_customer" in star:
        heads = heads.join(star["dim_customer"].select("customer_id", "customer_key"), "customer_id", "left")
        heads = heads.withColumn("has_customer", F.col("customer_id").isNotNull())
        made += ["customer_key", "has_customer"]
    if levels:
        places = star["dim_location"].where("NOT is_unknown").select("location_key", *levels)
        heads = heads.fillna(UNKNOWN, subset=levels).join(places, levels, "left")
        made.append("location_key")
    if "dim_payment" in star:
        methods = star["dim_payment"].where("NOT is_unknown").select("payment_key", "payment_method")
        heads = heads.join(methods, "payment_method", "left")
        made.append("payment_key")
    if has("purchase_date"):
        heads = heads.withColumn("date_key", F.date_format("purchase_date", "yyyyMMdd").cast("int"))
        made.append("date_key")
    heads = stage(heads.select("transaction_id", *made))
    sizes = lines.where("transaction_id IS NOT NULL").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_lines"))
    twice = heads.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_heads"))
    orders = sizes.join(twice, "transaction_id", "left").join(heads, "transaction_id", "left")
    orders = stage(orders.withColumn("order_line_count", F.col("_lines") * F.coalesce("_heads", F.lit(1))).drop("_lines", "_heads"))

    facts = lines.join(orders, "transaction_id", "left").withColumns(
        {"has_transaction_id": F.col("transaction_id").isNotNull(), "order_size_bucket": _size_bucket(F.col("order_line_count"))}
    )
    new = {"has_customer": F.coalesce("has_customer", F.lit(False))} if "has_customer" in made else {}
    if levels:
        nowhere = star["dim_location"].where("NOT is_unknown").where(" AND ".join(f"{c} = '{UNKNOWN}'" for c in levels))
        nowhere = one_row(nowhere.agg(F.min("location_key").alias("k")), "k")
        new["location_key"] = F.coalesce("location_key", nowhere, F.lit(UNKNOWN_KEY))
    if "dim_payment" in star:
        new["payment_key"] = F.coalesce("payment_key", F.lit(UNKNOWN_KEY))
    out = [c for c in ("quantity", "revenue") if has(c)]
    if has("price"):
        new["unit_price"] = F.col("price")
        out.insert(1, "unit_price")
    tail = ["transaction_id", "has_transaction_id", "order_line_count", "order_size_bucket"]
    tail += [c for c in made if c in ("customer_key", "has_customer")] + ["product_key"]
    tail += [c for c in made if c not in ("customer_key", "has_customer")]
    if "dim_discount_band" in star:
        new |= {"discount_band_key": F.coalesce(templates.discount_band_key(), F.lit(UNKNOWN_KEY)), "discount_pct": F.col("discount")}
        tail += ["discount_band_key", "discount_pct"]
    done = _numbered(facts.withColumns(new), out + tail)
    for frame in (lines, heads, orders):
        unstage(frame)
    return done


def build(rel: Relations) -> Star:
    """All tables whose roles are mapped; each is written once and shared by everything that reads it."""
    has = rel.source.has
    tables: dict[str, DataFrame] = {}
    if has("customer_id"):
        tables["dim_customer"] = stage(dim_customer(rel))
    if has("product_id") or has("product_name") or has("category"):
        tables["dim_product"] = stage(dim_product(rel))
    if has("purchase_date"):
        tables["dim_date"] = dim_date(rel)
    if _levels(rel):
        tables["dim_location"] = stage(dim_location(rel))
    if has("payment_method"):
        tables["dim_payment"] = stage(dim_payment(rel))
    if has("discount"):
        tables["dim_discount_band"] = dim_discount_band(rel.spark)
    tables["fact_sales"] = fact_sales(rel, tables)  # its rows were written when they were numbered
    return Star(tables)


RELATIONSHIPS = (
    ("customer_key", "dim_customer"),
    ("product_key", "dim_product"),
    ("date_key", "dim_date"),
    ("location_key", "dim_location"),
    ("payment_key", "dim_payment"),
    ("discount_band_key", "dim_discount_band"),
)


def relationships(star: Star) -> DataFrame:
    rows = [
        (f"fact_sales.{k}", f"{t}.{k}", "MANY_TO_ONE", "SINGLE", True) for k, t in RELATIONSHIPS if t in star
    ]
    return fixed_rows(star["fact_sales"].sparkSession, rows, "from string, to string, cardinality string, cross_filter string, active boolean")


def orphans(star: Star, key: str, dim: str) -> DataFrame:
    """Fact rows whose key is not in the dimension; NULL keys are allowed."""
    return star["fact_sales"].where(F.col(key).isNotNull()).join(star[dim].select(key), key, "left_anti")


def reconcile(rel: Relations, star: Star) -> DataFrame:
    """One row per check with the number of violations or the difference found; all must be 0."""
    fact = star["fact_sales"]
    lines = rel.tx("revenue").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("r"))
    found = fact.agg(
        (F.count(F.lit(1)) - one_row(lines, "n")).cast("double").alias("row_count"),
        (F.coalesce(F.sum("revenue"), F.lit(0)) - one_row(lines, "r")).cast("double").alias("revenue"),
        F.count_if(F.isnan(F.col("revenue").cast("double"))).cast("double").alias("not_a_number"),
    )
    checks = [found.select(F.expr("stack(3, 'row_count', row_count, 'revenue', revenue, 'not_a_number', not_a_number) AS (check, off)"))]
    for key, dim in RELATIONSHIPS:
        if dim in star:
            lost = orphans(star, key, dim).agg(F.count(F.lit(1)).cast("double").alias("off"))
            checks.append(lost.select(F.lit(f"orphan_{key}").alias("check"), "off"))
            twice = star[dim].agg((F.count(F.lit(1)) - F.count_distinct(key)).cast("double").alias("off"))
            checks.append(twice.select(F.lit(f"repeated_{key}").alias("check"), "off"))
    if "dim_customer" in star and "segment_code" in star["dim_customer"].columns:
        people = star["dim_customer"]
        off = people.agg((F.count(F.lit(1)) - F.count("segment_code")).cast("double").alias("off"))
        checks.append(off.select(F.lit("segments_cover_customers").alias("check"), "off"))
    if "dim_product" in star and "category" in star["dim_product"].columns:
        by_category = fact.join(star["dim_product"], "product_key").groupBy("category").agg(F.sum("revenue").alias("r"))
        off = by_category.agg((F.sum("r") - one_row(lines, "r")).cast("double").alias("off"))
        checks.append(off.select(F.lit("category_revenue").alias("check"), "off"))
    if "dim_date" in star:
        gap = star["dim_date"].agg(
            (F.datediff(F.max("date"), F.min("date")) + 1 - F.count(F.lit(1))).cast("double").alias("off")
        )
        checks.append(gap.select(F.lit("contiguous_dates").alias("check"), "off"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.withColumn("ok", F.abs("off") < 0.005)


def export_types(df: DataFrame) -> DataFrame:
    """Fixed decimal when a number has at most four decimals and fewer than 15 digits before them."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType))]
    entries = []
    for c in columns:
        text = F.col(c).cast("decimal(38,10)").cast("string")
        scale = F.length(F.regexp_replace(F.regexp_extract(text, r"\.(\d*)$", 1), "0+$", ""))
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.max(scale).alias("max_scale"),
                F.max(F.abs(F.col(c).cast("double"))).alias("max_abs"),
            )
        )
    kind = F.when((F.col("max_scale") <= 4) & (F.col("max_abs") < 1e15), "FIXED_DECIMAL").otherwise("DECIMAL")
    return df.agg(F.array(*entries).alias("c")).select(F.inline("c")).withColumn("export_type", kind)


# --- the plain model: natural keys, attributes as first seen ---------------------------------------

# Bands of the plain model, digital payment names, and the country it assumes.
PLAIN_BANDS = (
    (1, "No Discount (0%)", 0.00, 0.00),
    (2, "Low (1% - 10%)", 0.01, 0.10),
    (3, "Medium (11% - 20%)", 0.11, 0.20),
    (4, "High (> 20%)", 0.21, 1.00),
)
DIGITAL = ("UPI", "CREDIT CARD", "NET BANKING")


def plain_star(flat: DataFrame, digital: Sequence[str] = DIGITAL, country: str = "India") -> Star:
    """The seven export tables over a flat file."""
    lines = with_line_id(flat, "sales_key")
    day = F.col("order_date").cast("timestamp")
    key = F.date_format(day, "yyyyMMdd").cast("int")
    fact = lines.select(
        "sales_key",
        F.col("order_id").cast("string").alias("order_id"),
        key.alias("date_key"),
        "customer_id",
        "product_id",
        "payment_method",
        "city",
        F.col("quantity").cast("bigint").alias("quantity"),
        rounded("unit_price", 2).alias("unit_price"),
        rounded("discount_pct", 4).alias("discount_pct"),
        rounded("total_amount", 2).alias("total_amount"),
    )
    dates = (
        lines.select(day.cast("date").alias("d"))
        .distinct()
        .select(
            F.date_format("d", "yyyyMMdd").cast("int").alias("date_key"),
            F.date_format("d", "yyyy-MM-dd").alias("full_date"),
            F.year("d").alias("year"),
            F.concat(F.lit("Q"), F.quarter("d")).alias("quarter"),
            F.month("d").alias("month_num"),
            F.date_format("d", "MMMM").alias("month_name"),
            F.day("d").alias("day_of_month"),
            F.date_format("d", "EEEE").alias("day_name"),
        )
        .orderBy("date_key")
    )

    def first_seen(by: str, **attributes: str) -> DataFrame:
        return lines.groupBy(by).agg(*[F.min_by(c, "sales_key").alias(n) for n, c in attributes.items()])

    return Star(
        {
            "fact_sales": fact,
            "dim_date": dates,
            "dim_customer": first_seen("customer_id", primary_city="city", region="region"),
            "dim_product": first_seen("product_id", product_name="product_name", category="category"),
            "dim_payment": lines.select("payment_method")
            .distinct()
            .withColumn("is_digital", F.upper("payment_method").isin(*[d.upper() for d in digital])),
            "dim_location": lines.select("city", "region").distinct().withColumn("country", F.lit(country)),
            "dim_discount_band": fixed_rows(
                flat.sparkSession, PLAIN_BANDS, "band_id int, band_name string, min_rate double, max_rate double"
            ),
        }
    )


def band_of(rate: Column) -> Column:
    """The plain model's band of a discount rate, by its upper limits."""
    return F.when(rate <= 0, 1).when(rate <= 0.10, 2).when(rate <= 0.20, 3).when(rate.isNotNull(), 4)


# The declared logical model as (table, column, type, role).
DECLARED = (
    ("fact_sales", "sales_key", "BIGINT", "SURROGATE_KEY"),
    ("fact_sales", "order_id", "VARCHAR(64)", "DEGENERATE_DIMENSION"),
    ("fact_sales", "date_key", "INTEGER", "FOREIGN_KEY"),
    ("fact_sales", "customer_key", "INTEGER", "FOREIGN_KEY"),
    ("fact_sales", "product_key", "INTEGER", "FOREIGN_KEY"),
    ("fact_sales", "payment_key", "INTEGER", "FOREIGN_KEY"),
    ("fact_sales", "quantity", "INTEGER", "ADDITIVE_MEASURE"),
    ("fact_sales", "unit_price", "DECIMAL(12,2)", "NON_ADDITIVE_PRICE"),
    ("fact_sales", "discount_pct", "DECIMAL(5,4)", "RATE"),
    ("fact_sales", "total_amount", "DECIMAL(14,2)", "ADDITIVE_REVENUE"),
    ("dim_dates", "date_key", "INTEGER", "PRIMARY_KEY"),
    ("dim_dates", "full_date", "DATE", "DATE_ATTRIBUTE"),
    ("dim_dates", "year", "INTEGER", "HIERARCHY_LEVEL_1"),
    ("dim_dates", "quarter", "VARCHAR(2)", "HIERARCHY_LEVEL_2"),
    ("dim_dates", "month_num", "INTEGER", "SORT_ORDER"),
    ("dim_dates", "month_name", "VARCHAR(16)", "HIERARCHY_LEVEL_3"),
    ("dim_dates", "day_of_month", "INTEGER", "ATTRIBUTE"),
    ("dim_dates", "day_name", "VARCHAR(12)", "ATTRIBUTE"),
    ("dim_customers", "customer_key", "INTEGER", "PRIMARY_KEY"),
    ("dim_customers", "customer_id", "VARCHAR(64)", "BUSINESS_KEY"),
    ("dim_customers", "city", "VARCHAR(64)", "GEOGRAPHY"),
    ("dim_customers", "region", "VARCHAR(32)", "GEOGRAPHY_HIERARCHY"),
    ("dim_customers", "rfm_segment", "VARCHAR(32)", "ANALYTICAL_SEGMENT"),
    ("dim_products", "product_key", "INTEGER", "PRIMARY_KEY"),
    ("dim_products", "product_id", "VARCHAR(64)", "BUSINESS_KEY"),
    ("dim_products", "product_name", "VARCHAR(128)", "ATTRIBUTE"),
    ("dim_products", "category", "VARCHAR(64)", "HIERARCHY_LEVEL_1"),
    ("dim_products", "is_pareto_core", "BOOLEAN", "FLAG"),
    ("dim_payment_methods", "payment_key", "INTEGER", "PRIMARY_KEY"),
    ("dim_payment_methods", "payment_method", "VARCHAR(32)", "ATTRIBUTE"),
    ("dim_payment_methods", "is_digital_rail", "BOOLEAN", "FLAG"),
)


def declared_model(spark: SparkSession) -> DataFrame:
    return fixed_rows(spark, DECLARED, "table string, column string, type string, role string")


def declared_schema(table: str) -> T.StructType:
    kinds = {"BIGINT": T.LongType(), "INTEGER": T.IntegerType(), "DATE": T.DateType(), "BOOLEAN": T.BooleanType()}

    def kind(text: str) -> T.DataType:
        if text.startswith("DECIMAL"):
            precision, scale = text[8:-1].split(",")
            return T.DecimalType(int(precision), int(scale))
        return kinds.get(text, T.StringType())

    return T.StructType([T.StructField(c, kind(t)) for name, c, t, _ in DECLARED if name == table])


# --- measures -------------------------------------------------------------------------------------


def _stack(row: DataFrame) -> DataFrame:
    """A one-row frame as (measure, value) rows."""
    pairs = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def measures(star: Star) -> DataFrame:
    """The unfiltered headline measures as (measure, value)."""
    fact = star["fact_sales"]
    orders = F.count_distinct("transaction_id")
    people = F.count_distinct("customer_key")
    in_order = F.sum(F.when(F.col("has_transaction_id"), F.col("revenue")))
    of_customer = F.sum(F.when(F.col("has_customer"), F.col("revenue")))
    totals = fact.agg(
        F.sum("revenue").alias("Total Revenue"),
        orders.alias("Total Orders"),
        F.sum("quantity").alias("Total Quantity"),
        people.alias("Total Customers"),
        ratio(in_order, orders).alias("Average Order Value"),
        ratio(of_customer, people).alias("Revenue per Customer"),
        ratio(F.count_if("has_transaction_id"), orders).alias("Average Lines per Order"),
        ratio(F.sum(F.when(F.col("has_transaction_id"), F.col("quantity"))), orders).alias("Average Basket Quantity"),
    )
    per_customer = (
        fact.where("customer_key IS NOT NULL")
        .groupBy("customer_key")
        .agg(F.count_distinct("transaction_id").alias("orders"))
    )
    repeat = per_customer.agg(
        ratio(F.count_if(F.col("orders") >= 2), F.count(F.lit(1))).alias("Repeat Customer Rate"),
        ratio(F.sum("orders"), F.count(F.lit(1))).alias("Orders per Customer"),
    )
    return _stack(totals).unionByName(_stack(repeat)).unionByName(_stack(_month_measures(star)))


def _by_month(star: Star) -> DataFrame:
    """Revenue and orders of every complete month, months without sales as 0."""
    fact, dates = star["fact_sales"], star["dim_date"]
    label = F.to_date((F.floor(F.col("date_key") / 100) * 100 + 1).cast("string"), "yyyyMMdd")
    sums = (
        fact.where("date_key IS NOT NULL")
        .groupBy(label.alias("month_start"))
        .agg(F.sum("revenue").alias("revenue"), F.count_distinct("transaction_id").alias("orders"))
    )
    months = dates.where("month_is_complete").select("month_start").distinct()
    zero = F.lit(0)
    return months.join(sums, "month_start", "left").select(
        "month_start", F.coalesce("revenue", zero).alias("revenue"), F.coalesce("orders", zero).alias("orders")
    )


def _month_measures(star: Star) -> DataFrame:
    """Growth of the latest complete month and its new and returning customers; NULL where undefined."""
    months = stage(_by_month(star))
    latest = one_row(months.agg(F.max("month_start").alias("m")), "m")
    now, before = (months.where(F.col("month_start") == F.add_months(latest, -k)) for k in (0, 1))
    first = one_row(star["dim_date"].where("in_data_range").agg(F.min("month_start").alias("m")), "m")
    active = (
        star["fact_sales"]
        .where("customer_key IS NOT NULL")
        .where(F.col("date_key").between(F.date_format(latest, "yyyyMMdd").cast("int"), F.date_format(F.last_day(latest), "yyyyMMdd").cast("int")))
        .select("customer_key")
        .distinct()
        .join(star["dim_customer"].select("customer_key", "first_purchase_date"), "customer_key")
    )
    counts = active.agg(
        F.count_if(F.col("first_purchase_date") >= latest).alias("new"), F.count_if(F.col("first_purchase_date") < latest).alias("old")
    )

    def of(frame: DataFrame, name: str) -> Column:
        return one_row(frame.agg(F.max(name).alias("v")), "v")

    return star["fact_sales"].sparkSession.range(1).select(
        ratio(of(now, "revenue") - of(before, "revenue"), of(before, "revenue")).alias("Revenue Growth"),
        ratio(of(now, "orders") - of(before, "orders"), of(before, "orders")).alias("Order Growth"),
        F.when(latest > first, one_row(counts, "new")).alias("New Customers (Headline)"),
        F.when(latest > first, one_row(counts, "old")).alias("Returning Customers (Headline)"),
    )


def plain_measures(star: Star) -> DataFrame:
    """The measures of the plain model, among them discount drag and the digital share."""
    fact = star["fact_sales"].join(star["dim_payment"], "payment_method", "left")
    revenue = F.sum(F.col("total_amount").cast("decimal(28,2)"))
    orders, people = F.count_distinct("order_id"), F.count_distinct("customer_id")
    gross = (F.col("quantity") * F.col("unit_price")).cast("decimal(28,4)")
    totals = fact.agg(
        revenue.alias("Total Revenue"),
        orders.alias("Total Orders"),
        F.sum("quantity").alias("Total Units Sold"),
        people.alias("Active Customers"),
        F.coalesce(ratio(revenue, orders), F.lit(0.0)).alias("Average Order Value"),
        F.coalesce(ratio(revenue, people), F.lit(0.0)).alias("Customer Lifetime Value"),
        F.sum(gross - F.col("total_amount").cast("decimal(28,4)")).alias("Discount Dollar Drag"),
        F.coalesce(
            ratio(F.sum(F.when(F.col("is_digital"), F.col("total_amount").cast("decimal(28,2)"))), revenue), F.lit(0.0)
        ).alias("Digital Payment Ratio"),
    )
    per_customer = fact.where("customer_id IS NOT NULL").groupBy("customer_id").agg(F.count_distinct("order_id").alias("orders"))
    repeat = per_customer.agg(
        F.coalesce(ratio(F.count_if(F.col("orders") > 1), F.count(F.lit(1))), F.lit(0.0)).alias("Repeat Purchase Rate")
    )
    return _stack(totals).unionByName(_stack(repeat))


def yearly_growth(star: Star, amount: str = "total_amount") -> DataFrame:
    """Revenue per year against the year before, 0 when there is none."""
    years = (
        star["fact_sales"]
        .where("date_key IS NOT NULL")
        .groupBy(F.floor(F.col("date_key") / 10000).cast("int").alias("year"))
        .agg(F.sum(F.col(amount).cast("decimal(28,4)")).alias("revenue"))
    )
    earlier = years.select((F.col("year") + 1).alias("year"), F.col("revenue").alias("prior_revenue"))
    return (
        years.join(earlier, "year", "left")
        .select(
            "year",
            "revenue",
            "prior_revenue",
            F.coalesce(ratio(F.col("revenue") - F.col("prior_revenue"), "prior_revenue"), F.lit(0.0)).alias("yoy"),
        )
        .orderBy("year")
    )


def segment_shares(star: Star) -> DataFrame:
    """Customers, revenue and their shares per segment, with mean recency, frequency and monetary value."""
    people = star["dim_customer"]
    grouped = people.groupBy("segment", "segment_sort").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("lifetime_revenue").alias("revenue"),
        F.sum("rfm_recency_days").alias("_r"),
        F.sum("rfm_frequency").alias("_f"),
    )
    whole = Window.partitionBy(F.lit(0))  # four rows
    return grouped.orderBy("segment_sort").select(
        "segment",
        "customers",
        ratio("customers", F.sum("customers").over(whole)).alias("customer_share"),
        "revenue",
        ratio("revenue", F.sum("revenue").over(whole)).alias("revenue_share"),
        ratio("_r", "customers").alias("avg_recency_days"),
        ratio("_f", "customers").alias("avg_frequency"),
        ratio("revenue", "customers").alias("avg_monetary"),
    )


def member_shares(star: Star, dim: str, key: str, label: str) -> DataFrame:
    """Revenue per member and its share of the revenue that is not on the Unknown member."""
    by_key = star["fact_sales"].groupBy(key).agg(F.sum("revenue").alias("revenue"))
    named = (
        by_key.join(star[dim].select(key, F.col(label).cast("string").alias("member")), key)
        .groupBy("member")
        .agg(F.sum("revenue").alias("revenue"))
    )
    known = one_row(named.where(F.col("member") != UNKNOWN).agg(F.sum("revenue").alias("r")), "r")
    return named.select(F.lit(label).alias("by"), "member", "revenue", ratio("revenue", known).alias("share"))


def month_completeness(star: Star) -> DataFrame:
    """Revenue on complete and on partial months of the data range."""
    dates = star["dim_date"].select("date_key", "month_is_complete", "in_data_range")
    by_day = star["fact_sales"].groupBy("date_key").agg(F.sum("revenue").alias("r"))
    return by_day.join(dates, "date_key").agg(
        F.sum(F.when(F.col("month_is_complete"), F.col("r"))).alias("revenue_complete_months"),
        F.sum(F.when(~F.col("month_is_complete") & F.col("in_data_range"), F.col("r"))).alias("revenue_partial_months"),
    )


def top_product_share(star: Star, k: int = 10) -> DataFrame:
    """Share of revenue of the ``k`` best products."""
    by_key = star["fact_sales"].where(F.col("product_key") != UNKNOWN_KEY).groupBy("product_key").agg(F.sum("revenue").alias("r"))
    named = by_key.join(star["dim_product"].select("product_key", "product_natural_key"), "product_key")
    named = named.groupBy("product_natural_key").agg(F.sum("r").alias("r"))
    best = named.orderBy(F.desc("r"), "product_natural_key").limit(k).agg(F.sum("r").alias("r"))
    return named.agg(ratio(one_row(best, "r"), F.sum("r")).alias("top_product_share"))


# Which template figure each measure must equal, and the tolerance kind.
PARITY = (
    ("Total Revenue", "sales_total_revenue", "total_revenue", "amount"),
    ("Total Orders", "sales_total_orders", "total_orders", "count"),
    ("Total Quantity", "sales_total_quantity", "total_quantity", "amount"),
    ("Total Customers", "cust_total_customers", "total_customers", "count"),
    ("Average Order Value", "sales_average_order_value", "average_order_value", "average"),
    ("Revenue per Customer", "sales_avg_revenue_per_customer", "avg_revenue_per_customer", "average"),
    ("Revenue Growth", "sales_growth_latest_period", "revenue_growth", "ratio"),
    ("Order Growth", "sales_growth_latest_period", "order_growth", "ratio"),
    ("Repeat Customer Rate", "cust_repeat_purchase_rate", "repeat_purchase_rate", "ratio"),
    ("Orders per Customer", "cust_avg_orders_per_customer", "avg_orders_per_customer", "average"),
    ("Average Lines per Order", "beh_basket_summary", "avg_lines_per_order", "average"),
    ("Average Basket Quantity", "beh_basket_summary", "avg_basket_quantity", "average"),
)


def parity(rel: Relations, star: Star) -> DataFrame:
    """Each measure next to the template figure it must equal, within its tolerance."""
    expected, frames = None, {}
    for measure, template, column, kind in PARITY:
        frame = frames.setdefault(template, templates.TEMPLATES[template](rel))
        row = frame.select(F.lit(measure).alias("measure"), F.lit(kind).alias("kind"), F.col(column).cast("double").alias("expected"))
        expected = row if expected is None else expected.unionByName(row)
    off = F.abs(F.col("value") - F.col("expected"))
    allowed = (
        F.when(F.col("kind") == "count", 0.0)
        .when(F.col("kind") == "ratio", 1e-9)
        .when(F.col("kind") == "average", F.abs("expected") * 1e-9)
        .otherwise(F.greatest(F.lit(0.005), F.abs("expected") * 1e-9))
    )
    return (
        expected.join(measures(star), "measure", "left")
        .select("measure", "kind", "expected", "value", F.coalesce(off <= allowed, F.lit(False)).alias("ok"))
    )
