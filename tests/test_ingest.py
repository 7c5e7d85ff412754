import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillview.operators import profile, roles, typing
from tillview.sources import files, sinks, synthetic


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("d", [",", "\t", ";", "|"])
def test_delimiter(spark, tmp_path, d):
    path = write(tmp_path, "a.csv", f"\n  \na{d}b{d}c\n1{d}2{d}3\n")
    assert files.sniff_delimiter(spark, path) == d
    assert files.sniff_delimiter_by_shape(spark, path) == d


def test_delimiter_default_and_shape(spark, tmp_path):
    assert files.sniff_delimiter(spark, write(tmp_path, "one.csv", "a\n1\n")) == ","
    path = write(tmp_path, "b.csv", "a;b\nx, y;1\nz;2\nq, r, s;3\n")
    assert files.sniff_delimiter_by_shape(spark, path) == ";"


def test_encoding(spark, tmp_path):
    assert files.sniff_encoding(spark, write(tmp_path, "u.csv", "naïve,₹\n" * 3000)) == "UTF-8"
    path = write(tmp_path, "l.csv", "name,v\ncafé,1\n".encode("latin1"))
    assert files.sniff_encoding(spark, path) == "ISO-8859-1"
    assert files.read_csv(spark, path)[0].first()["name"] == "café"


def test_csv_text_only_and_malformed(spark, tmp_path):
    body = "id,code,note\n" + "".join(f'00{i},NA,"a ""q"", b"\n' for i in range(2000))
    df, bad = files.read_csv(spark, write(tmp_path, "ok.csv", "﻿" + body + "7,x\n"))
    assert bad == 1 and df.count() == 2001 and df.columns == ["id", "code", "note"]
    row = df.where("id = '000'").first()
    assert row["note"] == 'a "q", b' and row["code"] == "NA"
    with pytest.raises(files.InvalidStructure):
        files.read_csv(spark, write(tmp_path, "bad.csv", "a,b\n1,2\n3\n"))


def test_json_shapes(spark, tmp_path):
    one = '{"a": 1, "address": {"city": "X", "geo": {"lat": 1.5, "deep": {"z": 2}}}, "tags": [1, 2]}'
    for name, text in (("l.json", one + "\n" + one), ("a.json", f"[{one},\n {one}]"), ("w.json", f'{{\n"data": [{one}, {one}]\n}}')):
        df = files.read_json(spark, write(tmp_path, name, text))
        assert set(df.columns) == {"a", "address__city", "address__geo__lat", "address__geo__deep", "tags"}
        row = df.first()
        assert df.count() == 2 and row["a"] == "1" and row["address__geo__deep"] == '{"z":"2"}'


def test_names():
    got = typing.normalized_names(["UnitPrice", "CustomerID", " Revenue (INR) ", "revenue inr", "2024 Sales", "", "ﬁeld", "order_id"])
    assert got == ["unit_price", "customer_id", "revenue_inr", "revenue_inr_2", "c_2024_sales", "col_6", "field", "order_id_raw"]
    assert typing.normalized_names(["order_id"], mapped=["order_id"]) == ["order_id"]


def frame(spark, **cols):
    n = max(len(v) for v in cols.values())
    rows = [tuple(v[i % len(v)] for v in cols.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def test_null_tokens(spark):
    df = frame(spark, country=["NA", "IN", "US", "GB", "IN", "US", "FR", "DE", "IT", "ES", "PT", "SE"], v=["1", " N/A ", "-", "unknown"])
    got = typing.without_null_tokens(df)
    assert got.where("country = 'NA'").count() == 1
    assert got.where("v is null").count() == 6 and got.where("v = 'unknown'").count() == 3
    counts = {(r["column"], r["token"]): r["count"] for r in typing.null_token_counts(df).collect()}
    assert counts == {("country", "na"): 1, ("v", "n/a"): 3, ("v", "-"): 3, ("v", "unknown"): 3}


def test_numbers(spark):
    def parsed(*values):
        df = frame(spark, v=list(values))
        style = typing.number_style(df, "v")
        return style, [r[0] for r in df.select(typing.parse_number(F.col("v"), style)).collect()]

    assert parsed("₹1,23,456.78", "(1,200)", "-5", "7-") == ("indian", [123456.78, -1200.0, -5.0, -7.0])
    assert parsed("$1,234,567.89", "USD 12", "5%") == ("western", [1234567.89, 12.0, 5.0])
    assert parsed("1.234.567,89", "1,5", "€2.000") == ("european", [1234567.89, 1.5, 2000.0])
    assert parsed("1,234", "1,5", "12x", "1.2e5") == ("auto", [1234.0, 1.5, None, 120000.0])


def test_type_decisions(spark):
    days = [f"{d:02d}/03/2024" for d in range(1, 29)]
    df = frame(
        spark,
        customer_id=[f"00{i}" for i in range(200)],
        flag_active=["1", "0"],
        gift=["yes", "No", "T"],
        amount=["₹1,200.50", "300", "nan"],
        units=["1", "2", "3"],
        share=["0.123456", "1"],
        day=days,
        when_at=["2024-03-01 10:00:00", "2024-03-02 11:30:15"],
        us=["03/25/2024", "12/01/2023"],
        vague=["03/04/2024", "05/06/2024"],
        mix=["1"] * 9 + ["x"],
        city=["Pune", "Delhi", "unknown"],
        serial=["45000", "45001"],
        blob=[f"w{i} and words" for i in range(200)],
        token=[f"tk{i}" for i in range(200)],
        short_date=["01/02/68", "31/12/69"],
    )
    types = {t.column: t for t in typing.infer_types(df)}
    assert {c: t.type for c, t in types.items()} == {
        "customer_id": "IDENTIFIER",
        "flag_active": "BOOLEAN",
        "gift": "BOOLEAN",
        "amount": "NUMERIC",
        "units": "INTEGER",
        "share": "FLOAT",
        "day": "DATE",
        "when_at": "DATETIME",
        "us": "DATE",
        "vague": "DATE",
        "mix": "MIXED",
        "city": "CATEGORICAL",
        "serial": "INTEGER",
        "blob": "TEXT",
        "token": "IDENTIFIER",
        "short_date": "DATE",
    }
    assert types["us"].pattern == "M/d/yyyy" and types["day"].pattern == "d/M/yyyy"
    assert "DATE_ORDER_ASSUMED" in types["vague"].notes and types["mix"].intended == "NUMERIC"
    out = typing.typed(df, list(types.values()))
    row = out.first()
    assert row["amount"] == Decimal("1200.5") and row["customer_id"] == "000" and row["mix"] == "1"
    assert row["day"] == dt.date(2024, 3, 1) and row["flag_active"] is True and row["us"] == dt.date(2024, 3, 25)
    assert {r[0] for r in out.select("short_date").distinct().collect()} == {dt.date(2068, 2, 1), dt.date(1969, 12, 31)}
    assert out.count() == 200


def test_patterns_see_each_spelling_once(spark, monkeypatch):
    seen = []
    inner = typing._written_evidence
    monkeypatch.setattr(typing, "_written_evidence", lambda cells: seen.append(cells.count()) or inner(cells))
    df = frame(spark, amount=["$1,234.50", "€7", "12", "-3.5", "none"], day=["31.12.2024", "01.02.2023"], land=["NA", "DE", "FR"], n=["5\n", ".5", "7-"])
    df = df.unionByName(df).unionByName(df)
    types = typing.infer_types(df)
    assert seen == [6]  # two amounts, two days, a number before a line break, one with its sign behind
    assert [(t.column, t.type, t.n, t.codes) for t in types] == [
        ("amount", "NUMERIC", 12, False),
        ("day", "DATE", 15, False),
        ("land", "CATEGORICAL", 15, True),
        ("n", "NUMERIC", 15, False),
    ]
    # What inference has found out is not counted again.
    monkeypatch.setattr(typing, "_codes_columns", None)
    got = typing.typed(df, types)
    assert {r[0] for r in got.select("land").distinct().collect()} == {"NA", "DE", "FR"}
    assert sorted({r[0] for r in got.select("n").collect()}) == [Decimal(-7), Decimal("0.5"), Decimal(5)]
    assert sorted({r[0] for r in got.where("amount IS NOT NULL").select("amount").collect()}) == [Decimal("-3.5"), 7, 12, Decimal("1234.5")]


def test_profile_and_protect(spark):
    df = spark.createDataFrame(
        [("A B", "x@y.com", 1.0), ("C D", "z@y.org", None), ("Asha Rao", None, 3.0)], "person string, contact string, v double"
    )
    pii = {r["column"]: r["is_pii_suspected"] for r in profile.pii_suspicion(df).collect()}
    assert pii == {"person": False, "contact": True, "v": False}
    import hashlib
    import hmac

    got = [r[0] for r in profile.protect(df, ["contact"], "HASH", "k").select("contact").collect()]
    want = "sha256:" + hmac.new(b"k", b"x@y.com", hashlib.sha256).hexdigest()[:16]
    assert got[0] == want and got[2] is None
    assert profile.protect(df, ["contact"], "OMIT").columns == ["person", "v"]
    assert profile.samples(df).where("column = 'v'").first()["samples"] == ["1.0", "3.0"]
    page = profile.preview(df, columns=["person"], contains={"contact": "y."}, sort="v", descending=True, limit=1)
    assert [r[0] for r in page.collect()] == ["A B"]
    assert profile.approximate_distinct(df).first()["person"] == 3


def test_synthetic_shape_and_roles(spark):
    df = synthetic.retail(spark, 10_000)
    again = synthetic.retail(spark, 10_000).repartition(3)
    assert df.count() == 10_000 and df.exceptAll(again).isEmpty()
    distinct = df.distinct().count()
    assert distinct == 9880
    row = df.agg(
        F.avg(F.col("customer_rating").isNull().cast("int")).alias("gap"),
        F.avg((F.col("category") != F.trim("category")).cast("int")).alias("pad"),
        F.count_if(F.col("quantity") == 45).alias("out"),
        F.count_distinct("product_id").alias("skus"),
        F.avg((F.col("payment_method") == "UPI").cast("int")).alias("upi"),
    ).first()
    assert 0.06 < row["gap"] < 0.1 and 0.01 < row["pad"] < 0.03 and row["out"] >= 2 and row["skus"] == 20
    assert 0.45 < row["upi"] < 0.51

    simple = {r["column"]: (r["role"], r["confidence"]) for r in roles.simple_mapping(df).collect()}
    assert simple["order_date"] == ("TRANSACTION_DATE", 0.99)
    assert simple["total_amount"] == ("REVENUE", 0.99) and simple["city"] == ("GEOGRAPHY", 0.99)
    assert simple["discount_pct"] == ("NUMERIC_METRIC", 0.60)

    text = df.select(*[F.col(c).cast("string") for c in df.columns])
    types = typing.infer_types(text)
    stored = typing.typed(text, types)
    kinds = {t.column: t.type for t in types}
    figures = roles.role_figures(stored, kinds, dt.date(2026, 1, 1))
    found = roles.assign(figures, kinds)
    assert found.mapping == {
        "TRANSACTION_ID": "order_id",
        "PURCHASE_DATE": "order_date",
        "CUSTOMER_ID": "customer_id",
        "PRODUCT_ID": "product_id",
        "PRODUCT_NAME": "product_name",
        "CATEGORY": "category",
        "PRICE": "unit_price",
        "QUANTITY": "quantity",
        "DISCOUNT": "discount_pct",
        "REVENUE": "total_amount",
        "PAYMENT_METHOD": "payment_method",
        "CITY": "city",
        "STATE": "region",
    }
    mapping = {r.lower(): c for r, c in found.mapping.items()}
    checks = {(r["check"], r["role"]): r["ok"] for r in roles.validate_mapping(stored, mapping, dt.date(2026, 1, 1)).collect()}
    assert checks[("COVERAGE", "revenue")] and checks[("DATE_PLAUSIBLE", "purchase_date")]
    assert not checks[("REVENUE_IS_PRICE_TIMES_QUANTITY", "revenue")]
    settings = roles.derived_settings(stored, mapping)
    assert settings == {
        "revenue_basis": "OBSERVED",
        "discount_kind": "RATIO",
        "frequency_basis": "ORDERS",
        "order_grain": "ORDER_LEVEL",
    }


def test_availability_and_countries(spark):
    state = {r["module"]: (r["state"], r["missing_roles"]) for r in roles.availability(spark, ["price", "quantity", "customer_id"]).collect()}
    assert state["SALES"] == ("AVAILABLE", "") and state["RFM"] == ("UNAVAILABLE", "purchase_date")
    assert state["GEOGRAPHY"] == ("UNAVAILABLE", "country|state|city")
    assert {"in", "ind", "india", "namibia", "na"} <= roles.country_names(spark)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "=cmd", dt.date(2024, 1, 2), True, 1e-7, Decimal("1.50")), (2, None, None, False, 1e12, None)],
        "k int, t string, d date, b boolean, f double, m decimal(10,2)",
    )
    root = str(tmp_path)
    v1 = sinks.write_version(df, root, 1)
    sinks.write_version(v1, root, 2, parent=1)
    assert sorted((r["version"], r["parent"], r["rows"]) for r in sinks.versions(spark, root).collect()) == [(1, None, 2), (2, 1, 2)]
    with pytest.raises(Exception):
        sinks.write_version(df, root, 1)
    sinks.write_tables({"t": df}, f"{root}/star", parquet=True, order={"t": "k"})
    lines = [r[0] for r in spark.read.text(f"{root}/star/data/t").collect()]
    assert "1,'=cmd,2024-01-02,true,0.0000001,1.50" in lines and "2,,,false,1000000000000," in lines
    kept, cut = sinks.keep_result(spark.range(30), f"{root}/r", rows=10)
    assert cut and kept.count() == 10
    sinks.append_metrics(spark.createDataFrame([("r1", "a")], "run_id string, key string"), root)
    sinks.append_metrics(spark.createDataFrame([("r2", "a")], "run_id string, key string"), root)
    assert spark.read.parquet(f"{root}/metrics").count() == 2
