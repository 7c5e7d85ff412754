import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillview import session
from tillview.functions import dialect
from tillview.operators import adhoc, metrics, rfm, slices, star, templates
from tillview.operators.relations import Relations, Unavailable
from tillview.sources.transactions import Lookup, TransactionSource, from_flat

MAPPING = {
    "transaction_id": "order",
    "customer_id": "who",
    "product_id": "sku",
    "category": "cat",
    "quantity": "qty",
    "revenue": "paid",
    "discount": "disc",
    "purchase_date": "day",
    "country": "land",
    "payment_method": "pay",
}
SCHEMA = "order string, who string, sku string, cat string, qty int, paid decimal(18,2), disc double, day date, land string, pay string"


def line(order, who, paid, day, sku="P1", cat="c", qty=1, disc=0.0, land="IN", pay="UPI"):
    return (order, who, sku, cat, qty, Decimal(str(paid)), float(disc), dt.date.fromisoformat(day), land, pay)


def relations(spark, rows, mapping=MAPPING, **kw):
    return Relations(spark, from_flat(spark.createDataFrame(rows, SCHEMA), mapping), **kw)


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def golden(spark):
    return relations(spark, [line("1", "A", 100, "2024-01-05"), line("2", "A", 200, "2024-02-05"), line("3", "B", 300, "2024-02-20")])


def test_golden(golden):
    assert one(templates.sales_total_revenue(golden))["total_revenue"] == 600
    assert one(templates.cust_total_customers(golden))["total_customers"] == 2
    top = [(r["customer_id"], r["total_revenue"]) for r in templates.cust_top_customers(golden).collect()]
    assert top == [("A", 300), ("B", 300)]
    assert one(templates.cust_repeat_purchase_rate(golden)) == {
        "repeat_purchase_rate": 0.5,
        "repeat_customers": 1,
        "total_customers": 2,
    }
    assert one(templates.loy_inter_purchase_days(golden)) == {
        "avg_days_between_orders": 31.0,
        "median_days_between_orders": 31.0,
        "observations": 1,
    }


def test_growth_needs_consecutive_complete_months(spark):
    partial = relations(spark, [line("1", "A", 100, "2024-01-05"), line("2", "A", 150, "2024-02-20")])
    assert templates.sales_growth_latest_period(partial).isEmpty()
    whole = relations(
        spark,
        [line("1", "A", 100, "2024-01-01"), line("2", "A", 150, "2024-02-20"), line("3", "B", 1, "2024-04-30")],
    )
    # March has no sales: it counts as 0 and is the month before April.
    got = one(templates.sales_growth_latest_period(whole))
    assert got["current_month"] == dt.date(2024, 4, 1) and got["previous_revenue"] == 0 and got["revenue_growth"] is None
    growth = {r["month_start"].month: r["mom_growth"] for r in templates.time_mom_growth(whole).collect()}
    assert growth == {2: 0.5, 3: -1.0, 4: None}
    assert templates.time_yoy_growth(whole).isEmpty()
    assert templates.time_revenue_daily(whole).count() == 121


def test_null_keys_and_unclassified(spark):
    rows = [line("1", "A", 100, "2024-01-05"), (None, None, "P2", None, 2, Decimal("40"), None, None, None, None)]
    rel = relations(spark, rows)
    assert one(templates.sales_total_revenue(rel))["total_revenue"] == 140
    assert one(templates.sales_average_order_value(rel))["average_order_value"] == 100
    assert one(templates.revenue_unclassified(rel))["revenue_unclassified"] == 40
    by_category = templates.cat_revenue_quantity_contribution(rel).collect()
    assert [(r["category"], r["revenue_share"]) for r in by_category] == [("c", 1.0)]
    assert rel.orders().count() == 1 and rel.customers().count() == 1 and rel.products().count() == 2


def test_empty_sums_are_null_not_zero(spark):
    rel = relations(spark, [])
    assert one(templates.sales_total_revenue(rel))["total_revenue"] is None
    assert one(templates.sales_average_order_value(rel))["average_order_value"] is None
    assert rel.calendar().isEmpty()


def test_refunds_ties_and_ranks(spark):
    rows = [line(str(i), f"C{i}", 50 if i < 4 else -10, "2024-01-05", sku=f"P{i % 3}") for i in range(6)]
    rel = relations(spark, rows)
    top = [r["customer_id"] for r in templates.cust_top_customers(rel, limit=3).collect()]
    assert top == ["C0", "C1", "C2"]
    share = [r["cumulative_revenue_share"] for r in templates.prod_pareto(rel).collect()]
    assert share[-1] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        templates.cust_top_customers(rel, limit=101)


def test_missing_roles(spark):
    mapping = {k: v for k, v in MAPPING.items() if k not in ("transaction_id", "customer_id")}
    rel = relations(spark, [line("1", "A", 100, "2024-01-05")], mapping)
    for build in (templates.sales_total_orders, templates.cust_total_customers, templates.loy_cohort_retention):
        with pytest.raises(Unavailable):
            build(rel)
    assert "orders" not in rel.register() and rel.frequency_basis == "ROWS"
    assert "orders" not in templates._months(rel).columns
    kept = metrics.collect_metrics(rel, "r").where("metric_name = 'total_orders'")
    assert kept.isEmpty()


def test_rows_basis_when_orders_are_unknown(spark):
    mapping = {k: v for k, v in MAPPING.items() if k != "transaction_id"}
    rel = relations(spark, [line("1", "A", 1, "2024-01-05"), line("1", "A", 1, "2024-01-05")], mapping)
    assert one(rel.customers("order_count"))["order_count"] == 2


def test_derived_revenue_and_discount_kinds(spark):
    df = spark.createDataFrame([(2, 10.5, 0.1), (1, 4.0, 0.25)], "q int, p double, d double")
    src = from_flat(df, {"quantity": "q", "price": "p", "discount": "d"})
    assert sorted(r["revenue"] for r in src.select("revenue").collect()) == [Decimal("4.0000"), Decimal("21.0000")]
    assert sorted(r["discount"] for r in src.select("discount").collect()) == [10.0, 25.0]
    money = from_flat(df.withColumn("d", F.col("d") * 1000), {"quantity": "q", "discount": "d"})
    assert not money.has("discount")


def test_single_customer_scores(spark):
    rel = relations(spark, [line("1", "A", 100, "2024-01-05")], rfm_min_customers=1)
    got = one(rel.customer_rfm())
    assert (got["r_score"], got["f_score"], got["m_score"], got["recency_days"]) == (5, 1, 1, 1)
    assert relations(spark, [line("1", "A", 100, "2024-01-05")]).customer_rfm().isEmpty()
    code = rfm.score(rel.rfm_base(), rules="code").first()
    assert code["rfm_score"] == "111"


def test_code_rules_match_qcut(spark):
    import pandas as pd

    rows = [(f"c{i:03d}", (i * 37) % 11, i % 4, float((i * 53) % 17)) for i in range(123)]
    base = spark.createDataFrame(rows, "customer_id string, recency_days int, frequency bigint, monetary double")
    got = rfm.score(base.repartition(5), rules="code").toPandas().set_index("customer_id").sort_index()
    want = pd.DataFrame(rows, columns=["customer_id", "recency", "frequency", "monetary"]).set_index("customer_id")
    cut = lambda s, up: pd.qcut(s.rank(method="first", ascending=up), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert (got["f_score"] == cut(want["frequency"], True)).all() and (got["m_score"] == cut(want["monetary"], True)).all()
    # Descending with ties by id, as rank(method="first", ascending=False) gives.
    assert (got["r_score"] == cut(want["recency"], False)).all()


def test_row_order_does_not_matter(spark):
    rows = [line(str(i // 3), f"C{i % 25}", (i * 7) % 40, f"2024-0{1 + i % 6}-11", sku=f"P{i % 9}", disc=i % 40) for i in range(300)]
    a = relations(spark, rows)
    b = Relations(spark, from_flat(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), MAPPING))
    for name in ("cust_rfm_table", "cust_revenue_deciles", "prod_pareto", "beh_order_value_deciles", "disc_band_summary", "loy_cohort_retention"):
        assert templates.TEMPLATES[name](a).collect() == templates.TEMPLATES[name](b).collect(), name


def test_invariants(spark):
    rows = [line(str(i // 2), f"C{i % 30}", 1 + (i * 7) % 40, f"2024-0{1 + i % 6}-1{i % 9}", sku=f"P{i % 50}", cat=f"k{i % 25}") for i in range(400)]
    rel = relations(spark, rows)
    total = one(templates.sales_total_revenue(rel))["total_revenue"]
    found = metrics.collect_metrics(rel, "r")
    for name in ("revenue_by_category", "revenue_by_product", "revenue_by_country", "revenue_by_payment_method"):
        part = found.where(F.col("metric_name") == name)
        assert part.agg(F.sum("value")).first()[0] == total, name
    assert found.where("metric_name = 'revenue_by_product'").count() == 21
    seg = templates.cust_segment_summary(rel).toPandas()
    assert seg["customers"].sum() == 30 and seg["customer_share"].sum() == pytest.approx(1)
    scores = rel.customer_rfm()
    assert scores.where("r_score NOT BETWEEN 1 AND 5 OR length(rfm_score) <> 3").isEmpty()
    curve = [r["cumulative_revenue_share"] for r in templates.prod_pareto(rel).collect()]
    assert curve == sorted(curve) and curve[-1] == pytest.approx(1.0)


def test_series_thinning(spark, golden):
    ranks = spark.range(1, 5001).select(F.col("id").alias("rank"))
    kept = [r["rank"] for r in templates.thin_ranks(ranks).orderBy("rank").collect()]
    assert len(kept) <= 1000 and kept[:100] == list(range(1, 101)) and kept[-1] == 5000
    assert templates.thin_series(golden)[0] == "DAY"
    assert templates.thin_series(golden, points=20)[0] == "WEEK"
    assert templates.thin_series(golden, points=3)[0] == "MONTH"


def test_slices_reject_unknown_presets(spark):
    df = spark.createDataFrame([("1", "a", 5.0, dt.date(2024, 1, 1))], "order_id string, customer_id string, total_amount double, order_date date")
    with pytest.raises(ValueError):
        slices.time_slice(df, "q5")
    empty = one(slices.key_figures(slices.time_slice(df, "q4")))
    assert empty["total_revenue"] == 0.0 and empty["average_order_value"] == 0.0 and empty["total_rows"] == 0


def test_adhoc_sql(spark, golden):
    adhoc.session_over(golden)
    got = adhoc.run(spark, "SELECT customer_id, total_revenue FROM customers WHERE total_revenue >= :least ORDER BY 1;", {"least": 300}, rows=1)
    assert got.columns == ["customer_id", "total_revenue"] and [r[0] for r in got.rows] == ["A"]
    for text in ("DROP VIEW customers", "INSERT INTO t VALUES (1)", ""):
        with pytest.raises(ValueError):
            adhoc.query(spark, text)
    flat = spark.createDataFrame([("1", 5.0)], "order_id string, total_amount double")
    for text in ("WITH x AS (SELECT 1 AS a) SELECT a FROM x", "-- comment\nSELECT 1", "/* c */ (SELECT 1) UNION SELECT 2", "VALUES (1)", "FROM customers SELECT customer_id", "SELECT (SELECT max(total_revenue) FROM customers) AS m"):
        adhoc.query(spark, text).collect()
    assert adhoc.expose(flat).columns == ["order_id", "total_amount", "transaction_id", "revenue"]
    assert one(adhoc.query(spark, "SELECT sum(revenue) AS r FROM sales"))["r"] == 5.0


def test_star_unknown_members_and_reconciliation(spark):
    rows = [line("1", "A", 100, "2024-01-05"), line("1", "B", 7, "2024-01-06", cat=None, pay=None, land=None)]
    rows.append((None, None, None, None, 1, Decimal("3"), None, None, None, None))
    rel = relations(spark, rows, rfm_min_customers=1)
    model = star.build(rel)
    fact = {r["revenue"]: r for r in model["fact_sales"].collect()}
    last = fact[Decimal("3")]
    assert (last["product_key"], last["payment_key"], last["location_key"], last["discount_band_key"]) == (-1, -1, -1, -1)
    assert last["customer_key"] is None and last["date_key"] is None and not last["has_transaction_id"]
    assert fact[Decimal("100")]["order_line_count"] == 2 and fact[Decimal("7")]["order_size_bucket"] == "2"
    assert sorted(r["line_id"] for r in fact.values()) == [1, 2, 3]
    checks = star.reconcile(rel, model)
    assert checks.where("NOT ok").isEmpty()
    assert star.relationships(model).count() == 6
    broken = star.Star({**model.tables, "dim_product": model["dim_product"].where("product_key <> 1")})
    bad = {r["check"] for r in star.reconcile(rel, broken).where("NOT ok").collect()}
    assert "orphan_product_key" in bad and "category_revenue" in bad
    assert model["dim_date"].count() == 366
    shares = {r["member"]: r["share"] for r in star.member_shares(model, "dim_payment", "payment_key", "payment_method").collect()}
    assert shares["UPI"] == 1.0 and shares["Unknown"] == pytest.approx(0.1)
    assert star.declared_schema("fact_sales").names[0] == "sales_key"
    assert star.declared_model(spark).count() == len(star.DECLARED)


def test_latest_metrics(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "metric_key string, created_at int, numeric_value double")
    got = {r["metric_key"]: r["numeric_value"] for r in metrics.latest_by_key(df).collect()}
    assert got == {"a": 20.0, "b": 5.0} and metrics.latest(df, 1).first()["created_at"] == 2


def test_kept_relations_give_the_same_rows(spark, golden):
    kept = Relations(spark, golden.source).keep("orders", "customers", "products", "customer_rfm")
    for name in ("sales_avg_revenue_per_customer", "cust_top_customers", "beh_order_size_distribution", "prod_pareto"):
        assert templates.TEMPLATES[name](kept).collect() == templates.TEMPLATES[name](golden).collect(), name


def test_date_patterns(spark):
    assert dialect.date_pattern("%d/%m/%Y at %H:%M") == "dd/MM/yyyy' at 'HH:mm"
    with pytest.raises(ValueError):
        dialect.date_pattern("%Q")


def test_no_statement_gets_through_the_query_door(spark, golden, tmp_path):
    adhoc.session_over(golden)
    into = str(tmp_path / "out")
    refused = [
        f"WITH x AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{into}' USING parquet SELECT * FROM x",
        f"FROM customers INSERT OVERWRITE DIRECTORY '{into}' USING csv SELECT customer_id",
        f"-- a comment\n/* more */ INSERT OVERWRITE DIRECTORY '{into}' USING parquet SELECT 1",
        f"CREATE TABLE t USING parquet LOCATION '{into}' AS SELECT 1 AS a",
        "CREATE OR REPLACE TEMP VIEW v AS SELECT 1", "DROP VIEW customers", "SET x = 1", "USE default", "SHOW TABLES", "DESCRIBE customers",
        "CACHE TABLE customers", "EXPLAIN SELECT 1", "SELECT 1; DROP VIEW customers", "BEGIN SELECT 1; END", "", " ; ", "DELETE FROM customers", "REFRESH TABLE customers",
    ]
    for text in refused:
        with pytest.raises(ValueError):
            adhoc.query(spark, text)
    assert not (tmp_path / "out").exists() and spark.table("customers").count() == 2


def test_series_keep_their_last_day(spark, golden):
    rows = {r["metric_name"]: r for r in metrics.collect_series(golden, "r").collect()}
    for r in rows.values():
        assert [p["position"] for p in r["value_series"]] == list(range(1, len(r["value_series"]) + 1))
    daily = rows["revenue_daily"]
    total = sum(p["v"] for p in daily["value_series"])
    assert daily["grain"] == "DAY" and daily["value_series"][-1]["t"] == str(golden.bounds[1])
    for points, grain in ((20, "WEEK"), (3, "MONTH")):
        coarse = {r["metric_name"]: r for r in metrics.collect_series(golden, "r", points).collect()}["revenue_daily"]
        assert coarse["grain"] == grain and sum(p["v"] for p in coarse["value_series"]) == total


def test_frequency_without_revenue(spark):
    from tillview.sources.transactions import Lookup, TransactionSource, from_flat

    df = spark.createDataFrame([("o1", "a"), ("o2", "a"), ("o3", "b")], "o string, c string")
    rel = Relations(spark, from_flat(df, {"transaction_id": "o", "customer_id": "c"}))
    got = templates.beh_purchase_frequency(rel)
    assert "revenue" not in got.columns and sorted(r["customers"] for r in got.collect()) == [1, 1]


def test_fact_of_tables_is_that_of_joined_lines(spark, monkeypatch):
    """Repeated, missing and null keys on every side, places that are called Unknown, equal lines."""
    lines = [(1, 10, "1.00"), (1, 10, "1.00"), (1, 11, "2.00"), (2, 12, "3.00"), (3, None, "4.00"), (None, 10, "5.00"), (9, 99, "6.00"), (4, 13, "7.00"), (5, 10, "8.00")]
    heads = [(1, 5, "2024-01-02", "cash"), (1, 6, "2024-02-03", None), (2, 5, "2024-01-05", "card"), (3, None, None, "card"), (4, 7, "2024-03-01", "card"), (5, 8, "2024-03-02", "cash"), (None, 5, "2024-01-01", "cash"), (6, 5, "2024-01-01", "cash")]
    buyers = [(5, "IN", "North", "Pune"), (5, "IN", "North", "Delhi"), (6, None, "South", None), (7, "Unknown", "Unknown", "Unknown"), (8, None, None, None)]
    goods = [(10, "a", "x"), (11, "b", "x"), (11, "c", "y"), (12, "d", None), (13, "e", "y"), (13, "e", "y")]
    source = TransactionSource(
        spark.createDataFrame(lines, "transaction_id int, product_id int, r string").selectExpr(
            "transaction_id", "product_id", "CAST(2 AS DECIMAL(12,2)) AS quantity", "CAST(r AS DECIMAL(18,4)) AS revenue", "CAST(transaction_id AS DECIMAL(7,2)) AS discount"
        ),
        [
            Lookup("transaction_id", spark.createDataFrame(heads, "transaction_id int, customer_id int, d string, payment_method string").selectExpr("transaction_id", "customer_id", "CAST(d AS DATE) AS purchase_date", "payment_method")),
            Lookup("customer_id", spark.createDataFrame(buyers, "customer_id int, country string, state string, city string")),
            Lookup("product_id", spark.createDataFrame(goods, "product_id int, product_name string, category string")),
        ],
    )
    rel = Relations(spark, source, rfm_min_customers=1)
    assert star._split(rel, star.build(rel).tables)
    before = len(session._STAGED)
    got = star.build(rel)["fact_sales"]
    kept = len(session._STAGED) - before
    monkeypatch.setattr(star, "_split", lambda rel, tables: False)
    want = star.build(rel)["fact_sales"]
    assert len(session._STAGED) - before == 2 * kept  # nothing is left of what stood between
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 20
