import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillview import session
from tillview.operators import cleaning, eda, quality
from tillview.operators.cleaning import Step
from tillview.sources import synthetic
from tillview.sources.transactions import Lookup, TransactionSource


@pytest.fixture(scope="module")
def retail(spark):
    from tillview.session import stage

    return stage(synthetic.retail(spark, 3000, seed=3))


def test_basic_profile_matches_pandas(retail):
    pdf = retail.toPandas()
    got = quality.basic_profile(retail).first().asDict()
    numbers = pdf.select_dtypes(include=[np.number]).columns
    nulls = int(pdf.isna().sum().sum())
    dupes = int(pdf.duplicated().sum())
    computed = pdf["quantity"] * pdf["unit_price"] * (1 - pdf["discount_pct"])
    broken = int(((pdf["total_amount"] - computed).abs() > 1).sum())
    outliers = 0
    for c in numbers:
        s = pdf[c].dropna()
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        if q3 > q1:
            outliers += int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())
    c = round((1 - nulls / pdf.size) * 100)
    u = round((1 - dupes / len(pdf)) * 100)
    k = round((1 - broken / len(pdf)) * 100)
    assert got["null_cells"] == nulls and got["duplicate_rows"] == dupes and got["outlier_count"] == outliers
    assert (got["completeness_score"], got["uniqueness_score"], got["validity_score"], got["consistency_score"]) == (c, u, 100, k)
    assert got["overall_score"] == round(0.3 * c + 0.25 * u + 25 + 0.2 * k)


def test_empty_table(spark):
    got = quality.basic_profile(spark.createDataFrame([], "a string, quantity int")).first()
    assert got["overall_score"] == 0 and got["total_rows"] == 0


def test_eda_matches_pandas(retail):
    pdf = retail.toPandas()
    for r in eda.numeric_summary(retail).collect():
        s = pdf[r["column"]].dropna()
        want = [len(s), s.mean(), s.std(), s.min(), s.quantile(0.25), s.median(), s.quantile(0.75), s.max(), s.skew()]
        assert list(r)[1:] == pytest.approx(want, abs=0.00501)
    for c in ("total_amount", "quantity", "discount_pct"):
        counts, edges = np.histogram(pdf[c].dropna(), bins=10)
        got = eda.histogram(retail, [c]).orderBy("bin").collect()
        assert [r["count"] for r in got] == list(counts)
        assert [r["bin_start"] for r in got] == pytest.approx(edges[:-1], abs=0.00501)
    corr = pdf[["quantity", "unit_price", "customer_rating"]].corr("spearman")
    for r in eda.spearman_matrix(retail, list(corr)).collect():
        assert r["correlation"] == pytest.approx(corr.loc[r["x"], r["y"]], abs=1e-5)


def test_constant_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0)] * 20, "a double, b double")
    got = eda.histogram(df, ["a"]).orderBy("bin").collect()
    assert got[0]["bin_start"] == 4.5 and got[9]["bin_end"] == 5.5 and sum(r["count"] for r in got) == 20
    assert eda.pearson_matrix(df).isEmpty()
    assert eda.chart_choice(spark, {"d": "DATE", "v": "NUMERIC", "w": "NUMERIC"}).where("chart = 'SCATTER'").count() == 1


def test_scatter_sample_is_repeatable(retail):
    key = ["order_id", "product_id"]
    a = eda.scatter_sample(retail, "unit_price", "total_amount", key, 50).collect()
    b = eda.scatter_sample(retail.repartition(9), "unit_price", "total_amount", key, 50).collect()
    assert a == b and len(a) == 50
    assert a != eda.scatter_sample(retail, "unit_price", "total_amount", key, 50, seed=1).collect()


def test_clean_steps_and_order(spark):
    rows = [
        ("1", " x ", 1.0, "2024-01-01"),
        ("1", " x ", 1.0, "2024-01-01"),
        ("1", "x\t", 1.0, "2024-01-01"),
        ("2", None, None, "2024-01-02 10:00:00"),
        ("3", "y", 4.0, None),
    ]
    df = spark.createDataFrame(rows, "id string, t string, v double, order_date string")
    got = cleaning.clean(df)
    assert (got.original_rows, got.cleaned_rows, got.dropped_duplicates, got.imputed_cells) == (5, 4, 1, 2)
    out = {(r["id"], r["t"], r["v"], r["order_date"]) for r in got.rows.collect()}
    assert out == {
        ("1", "x", 1.0, dt.datetime(2024, 1, 1)),
        ("2", "UNKNOWN", 1.0, dt.datetime(2024, 1, 2, 10)),
        ("3", "y", 4.0, None),
    }
    assert got.rows.count() == 4  # twins that differ in white space both survive
    assert cleaning.clean(df, dedupe_after_trim=True).cleaned_rows == 3
    ops = [(r["operation"], r["column"], r["rows_modified"]) for r in got.log.orderBy("step").collect()]
    assert ops == [
        ("REMOVE_EXACT_DUPLICATES", "[ALL_COLUMNS]", 1),
        ("STANDARDIZE_WHITESPACE", "t", 2),
        ("IMPUTE_CATEGORICAL_LABEL", "t", 1),
        ("IMPUTE_NUMERIC_MEDIAN", "v", 1),
        ("STANDARDIZE_DATETIME_ISO8601", "order_date", 4),
    ]
    bad = cleaning.clean(df.withColumn("order_date", F.when(F.col("id") == "3", "soon").otherwise(F.col("order_date"))))
    assert dict(bad.rows.dtypes)["order_date"] == "string"


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def test_staging_gives_back_its_shuffles(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("a"), F.col("id").cast("string").alias("b")).repartition(7, "a")
    before = _shuffle_files(spark)
    staged = session.stage(df.join(df.groupBy("a").count(), "a"))
    assert not _shuffle_files(spark) - before
    assert staged.count() == 20_000 and df.count() == 20_000
    session.unstage(staged.where("a > 1"))
    assert df.count() == 20_000


def test_steps_keep_one_table(spark):
    df = spark.createDataFrame([("Red", 1), ("red", 2), ("Red", None), (None, 4)], "color string, v int")
    before = len(session._STAGED)
    steps = [Step("NORMALIZE_CATEGORIES", ["color"]), Step("HANDLE_MISSING", ["v"], {"strategy": "DROP_ROWS"}), Step("NORMALIZE_TEXT", ["color"], {"case": "upper"})]
    out, log = cleaning.apply_steps(df, steps)
    assert sorted(map(tuple, out.collect()), key=str) == [("RED", 1), ("RED", 2), (None, 4)]
    assert [r["rows_affected"] for r in log.orderBy("seq").collect()] == [1, 1, 2]
    assert len(session._STAGED) - before == 2  # the rows of the last step, the spellings


def test_repeats_are_dropped_in_passes(spark, monkeypatch):
    rows = [(None, 0.0, "a "), (None, -0.0, "a "), (None, None, None), (None, None, None), (7, float("nan"), "b"), (7, float("nan"), "b")] * 3 + [(i, float(i), f"t{i % 5}") for i in range(40)]
    table = session.stage(spark.createDataFrame(rows, "`a.b` int, v double, t string"))
    assert len(session.passes(table)) == 1
    monkeypatch.setattr(session, "_PASS_BYTES", 100)
    parts = session.passes(table)
    assert len(parts) == session._PASSES and len(session.passes(table.distinct())) == 1
    assert sum(p.count() for p in parts) == len(rows) == table.count()
    got = session.stage(*[p.dropDuplicates() for p in parts])
    assert got.count() == 43 == table.distinct().count() == got.distinct().count()
    by_key = session.passes(table, "t")
    assert sum(p.where("t = 't1' OR t IS NULL").count() for p in by_key) == 14
    assert all(p.where("t = 't1'").count() in (0, 8) for p in by_key)


def test_cleaning_in_passes_is_cleaning_at_once(spark, retail, monkeypatch):
    once = cleaning.clean(retail)
    monkeypatch.setattr(session, "_PASS_BYTES", 5_000)
    assert len(session.passes(retail)) > 1
    parts = cleaning.clean(retail)
    assert sorted(map(str, parts.rows.collect())) == sorted(map(str, once.rows.collect()))
    assert parts.log.collect() == once.log.collect() and parts.dropped_duplicates == once.dropped_duplicates > 0


def test_lookups_meet_before_the_lines(spark):
    lines = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (9, 12), (None, 10)], "order_id int, product_id int")
    heads = spark.createDataFrame([(1, 5), (2, None), (2, 6), (3, 5)], "order_id int, customer_id int")
    buyers = spark.createDataFrame([(5, "A"), (5, "B"), (None, "C")], "customer_id int, city string")
    goods = spark.createDataFrame([(10, "x"), (11, "y"), (11, "z")], "product_id int, name string")
    source = TransactionSource(lines, [Lookup("order_id", heads), Lookup("customer_id", buyers), Lookup("product_id", goods)])
    got = source.select("order_id", "city", "name")
    want = lines.join(heads, "order_id", "left").join(buyers, "customer_id", "left").join(goods, "product_id", "left").select("order_id", "city", "name")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = source.select("order_id", "city")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert "Join" not in plan.children().head().toString() and "Join" in plan.children().last().toString()


def test_fingerprint(spark, retail):
    a = cleaning.fingerprint(retail).first()
    assert a == cleaning.fingerprint(retail.repartition(5).orderBy(F.rand(1))).first()
    assert a != cleaning.fingerprint(retail.unionByName(retail.limit(1))).first()
    twice = spark.createDataFrame([(1,), (1,)], "a int")
    assert cleaning.fingerprint(twice).first()["digest"] != 0


def test_single_operations(spark):
    df = spark.createDataFrame(
        [("Red", "1,200", 1.0, "03/04/2024"), ("red ", "x", None, "2024-04-05"), ("Red", "7", 900.0, None)],
        "color string, n string, v double, d string",
    )
    out, log = cleaning.apply_steps(
        df,
        [
            Step("NORMALIZE_CATEGORIES", ["color"]),
            Step("STANDARDIZE_NUMERICS", ["n"]),
            Step("HANDLE_MISSING", ["v"], {"strategy": "FLAG_ONLY"}),
            Step("PARSE_DATES", ["d"], {"formats": ["dd/MM/yyyy", "yyyy-MM-dd"]}),
            Step("REMOVE_INVALID_RECORDS", [], {"rule": "v > 100"}),
        ],
    )
    rows = {r["n"]: r for r in out.collect()}
    assert {r["color"] for r in rows.values()} == {"Red"} and set(rows) == {1200.0, None}
    assert rows[None]["v_missing"] and rows[1200.0]["d"] == dt.datetime(2024, 4, 3)
    assert [(r["rows_before"], r["rows_after"], r["rows_affected"]) for r in log.orderBy("seq").collect()] == [
        (3, 3, 1),
        (3, 3, 2),
        (3, 3, 1),
        (3, 3, 2),
        (3, 2, 1),
    ]
    typed, _ = cleaning.apply_steps(df, [Step("STANDARDIZE_TYPES", ["n"], {"types": {"n": "int"}}), Step("HANDLE_MISSING", ["n"], {"strategy": "DROP_ROWS"})])
    assert [r["n"] for r in typed.collect()] == [7]
    assert cleaning.exact_duplicates_first(spark.createDataFrame([(2, "a"), (1, "a")], "line_id int, t string")).first()["line_id"] == 1


def test_near_duplicates_and_conflicts(spark):
    df = spark.createDataFrame(
        [("o1", "Blue, Mug", 1.001), ("o1", "blue  mug", 1.0), ("o2", "cup", 2.0), ("o2", "cup", 2.0), ("o3", None, 3.0), ("o3", "", 3.0)],
        "order_id string, t string, v double",
    )
    got = quality.near_duplicates(df, ["order_id"]).first()
    assert (got["near_duplicate_groups"], got["near_duplicate_rows"]) == (1, 2)
    lines = spark.createDataFrame(
        [("1", "A", "x"), ("1", "A", "x"), ("2", "A", "x"), ("2", "B", "x"), ("3", "C", None), ("3", "C", "y")],
        "order string, who string, pay string",
    )
    mapping = {"transaction_id": "order", "customer_id": "who", "payment_method": "pay"}
    assert {(r[0], r[1]) for r in quality.header_conflicts(lines, mapping).collect()} == {("2", 2), ("3", 2)}
    assert quality.duplicate_identifiers(lines, mapping).first().asDict() == {"groups": 2, "rows": 4}
    assert quality.duplicate_identifiers(lines, mapping, "ORDER_LEVEL").first().asDict() == {"groups": 2, "rows": 2}
    assert quality.rows_in_conflict(lines, mapping).count() == 4


def test_unicode_variants(spark):
    df = spark.createDataFrame([("Straße",), ("STRASSE",), ("STRASSE",), ("ﬁt",), ("FIT",)], "c string")
    got = {r["variant"]: r["dominant"] for r in quality.category_variants(df, ["c"]).collect()}
    assert got == {"Straße": "STRASSE", "STRASSE": "STRASSE", "ﬁt": "FIT", "FIT": "FIT"}


def test_symbols_tell_categories_apart(spark):
    df = spark.createDataFrame([("A+",), ("A",), ("A",), ("C#",), ("C",), ("a.",), ("Ａ",)], "c string")
    got = {r["variant"]: r["dominant"] for r in quality.category_variants(df, ["c"]).collect()}
    assert got == {"A+": "A+", "A": "A", "C#": "C", "C": "C", "a.": "A", "Ａ": "A"}  # a number sign is punctuation
    rows = spark.createDataFrame([("Straße", 1.0), ("STRASSE", 1.001), ("A+", 2.0), ("A", 2.0)], "c string, x double")
    assert quality.near_duplicates(rows).first().asDict() == {"near_duplicate_groups": 1, "near_duplicate_rows": 2}


def test_fractions_and_returns(spark):
    mapping = {"quantity": "q", "revenue": "r"}
    df = spark.createDataFrame([(1.5, 3.0), (0.0, 0.0)] + [(-1.0, -float(i)) for i in range(1, 30)] + [(2.0, -50.0)], "q double, r double")
    rules = lambda **k: {x["rule"]: x["violations"] for x in quality.validity_rules(df, mapping, dt.date(2024, 1, 1), **k).collect()}
    assert rules()["VAL-QTY"] == 1 and rules(whole_quantity=True)["VAL-QTY"] == 2
    report = {x["column"]: x["domain_count"] for x in quality.outlier_report(df, ["q", "r"], mapping).collect()}
    assert report["r"] == 1
    assert quality.few_distinct(df, ["q", "r"], 4) == {"q"}
    assert quality.few_distinct(df, ["q", "r"], 3) == set()


def test_all_columns_with_gaps_are_looked_at(spark):
    df = spark.range(3).selectExpr(*[f"nullif(id, {i % 3}) AS c{i:02d}" for i in range(25)])
    assert quality.co_missing(df).count() == 625
    assert quality.co_missing(df, most=20).count() == 400
    assert all(len(r["mask"].split(",")) in (8, 9) for r in quality.missing_masks(df).collect())


def test_weighted_score_and_rules(spark):
    df = spark.createDataFrame(
        [("1", 10.0, 1, 10.0, dt.date(2024, 1, 1), 200, "male"), ("2", -1.0, 0, 5.0, dt.date(1980, 1, 1), 30, "xx"), ("3", 2.0, -1, -2.0, None, None, None)],
        "o string, p double, q int, r double, d date, a int, g string",
    )
    mapping = {"transaction_id": "o", "price": "p", "quantity": "q", "revenue": "r", "purchase_date": "d", "customer_age": "a", "gender": "g"}
    rules = {r["rule"]: (r["violations"], r["checked"]) for r in quality.validity_rules(df, mapping, dt.date(2024, 6, 1)).collect()}
    assert rules == {
        "VAL-PRICE-NEG": (1, 3),
        "VAL-QTY": (1, 3),
        "VAL-REV-SIGN": (0, 3),
        "VAL-DATE": (1, 2),
        "VAL-AGE": (1, 2),
        "VAL-GENDER": (1, 2),
    }
    got = quality.weighted_score(df, mapping, dt.date(2024, 6, 1), grain="ORDER_LEVEL").first()
    lost = 100 * (3 + 2 + 2) / ((3 * 5 + 2 * 2) * 3)
    assert got["completeness"] == round(100 - 2 * lost, 2) and got["uniqueness"] == 100.0 and got["consistency"] == 100.0
    assert quality.accuracy_indicators(df, mapping, dt.date(2024, 6, 1)).first()["refund_rows"] == 1
    mixed = spark.createDataFrame([("1", "2024-01-01"), ("x", "01/02/2024"), ("3", "2024-01-03")], "n string, d string")
    parts = quality.consistency_parts(mixed, {}, meant={"n": "number"}, date_text=["d"])
    assert {(r["part"], r["affected"], r["base"]) for r in parts.collect()} == {("type", 1, 3), ("format", 1, 3)}


def test_discount_kinds(spark):
    kind = lambda values, name: quality.discount_kind(spark.createDataFrame([(float(v),) for v in values], f"{name} double"), name)
    assert kind([0, 1, 1], "discount") == "FLAG" and kind([0.1, 0.5, 1], "discount") == "RATIO"
    assert kind([0, 5, 30], "discount") == "PERCENT" and kind([0, 500], "discount") == "AMOUNT"
    assert kind([60, 90, 95], "discount_pct") == "PERCENT" and kind([60, 90, 95], "discount") == "AMOUNT"


def test_outlier_methods(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {"normal": np.append(rng.normal(0, 1, 499), 5.0), "skewed": rng.pareto(1.2, 500), "rating": rng.integers(1, 6, 500), "flat": 1.0}
    )
    got = {r["column"]: r for r in quality.outlier_report(spark.createDataFrame(pdf), list(pdf)).collect()}
    assert got["normal"]["method"] == "ZSCORE" and got["normal"]["high_count"] >= 1
    assert got["skewed"]["method"] == "IQR" and got["rating"]["method"] == "discrete" and got["flat"]["method"] == "constant"
    few = quality.outlier_report(spark.createDataFrame(pdf.head(10)), ["normal"]).first()
    assert few["method"] == "too_few_values"
    far = quality.extreme_rows(spark.createDataFrame(pdf[["skewed"]]), "skewed", ["skewed"], rows=5)
    assert far.first()["skewed"] == pytest.approx(pdf["skewed"].max())


def test_missing_patterns_and_bands(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, None, 1.0), (3, "x", None), (4, "y", 2.0)], "a int, b string, c double")
    assert {(r["a"], r["b"]): r["share"] for r in quality.co_missing(df).collect()}[("b", "c")] == 0.5
    assert {r["mask"]: r["rows"] for r in quality.missing_masks(df).collect()} == {"b": 1, "c": 1, "b,c": 1}
    bands = {r["column"]: r["severity"] for r in quality.missingness(df, 5, 50, 60).collect()}
    assert bands == {"b": "MODERATE", "c": "MODERATE"}
    assert quality.co_missing(df.select("a")).isEmpty() and quality.missing_masks(df.select("a")).isEmpty()


def test_lineage(spark):
    versions = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "version int, parent int").selectExpr("cast(version as string) version", "cast(parent as string) parent")
    ops = spark.createDataFrame([("2", "REMOVE_EXACT_DUPLICATES", "", 5), ("3", "TRIM", "c", 0), ("3", "FILL", "c", 2), ("4", "OTHER", "", 9)], "version string, operation string, column string, rows_affected int")
    got = {(r["version"], r["issue_type"]) for r in quality.lineage_issues(versions, ops, "3").collect()}
    assert got == {("2", "REMOVE_EXACT_DUPLICATES"), ("3", "FILL")}


def test_version_comparison(spark, retail):
    after = cleaning.clean(retail).rows
    got = {r["figure"]: (r["v1"], r["v2"]) for r in cleaning.compare_versions(retail, after).collect()}
    assert got["total_rows"] == (3000.0, 2964.0) and got["duplicate_rows"] == (36.0, 0.0) and got["null_cells"][1] == 0.0
    assert got["overall_score"][1] >= got["overall_score"][0]
