"""What the list of available items says, and what the operators do."""

import datetime as dt
from decimal import Decimal

import pytest
from tillview.operators import availability, quality, star, templates
from tillview.operators.relations import Relations, Unavailable
from tillview.sources.transactions import TransactionSource

SCHEMA = (
    "transaction_id string, customer_id string, product_id string, product_name string, category string, quantity decimal(12,2), price decimal(12,2), revenue decimal(18,4),"
    " discount decimal(7,2), purchase_date date, country string, state string, city string, payment_method string"
)


def relations(spark, *without):
    rows = [(str(i // 2), "AB"[i % 2], "p", "n", "c", Decimal(1), Decimal(5), Decimal(5), Decimal(0), dt.date(2024, 1, i + 1), "x", "y", "z", "m") for i in range(4)]
    return Relations(spark, TransactionSource(spark.createDataFrame(rows, SCHEMA).drop(*without)))


def roles_of(rel):
    return [r for r in availability.ROLES if rel.source.has(r)]


WITHOUT = [(), ("customer_id",), ("purchase_date",), ("transaction_id", "discount"), ("product_id", "product_name"), ("product_id", "product_name", "category"), ("country", "state", "city", "payment_method"), ("quantity", "price")]


@pytest.mark.parametrize("without", WITHOUT)
def test_star_holds_what_is_listed(spark, without):
    rel = relations(spark, *without)
    built = star.build(rel)
    listed = availability.table_of(spark, roles_of(rel)).where("state = 'AVAILABLE'").collect()
    assert set(built.tables) == {r["item"] for r in listed if r["kind"] == "table"}
    for name, df in built.tables.items():
        assert set(df.columns) == {r["item"] for r in listed if r["kind"] == "column" and r["table"] == name}, name


@pytest.mark.parametrize("role", ["revenue", "customer_id", "purchase_date", "transaction_id", "quantity", "country"])
def test_templates_raise_what_is_listed(spark, role):
    rel = relations(spark, role)
    listed = {r["item"]: r["reason"] for r in availability.table_of(spark, roles_of(rel)).where("kind = 'template'").collect() if role != "revenue" or True}
    assert set(listed) == set(templates.TEMPLATES)
    for name, why in listed.items():
        if why is None:
            continue
        with pytest.raises(Unavailable) as raised:
            templates.TEMPLATES[name](rel)
        assert str(raised.value) == why


def test_reasons_follow_through():
    have = ["customer_id", "price"]
    assert availability.lacking("dim_customer", have) == {"revenue"}
    assert availability.lacking("dim_customer", [*have, "quantity"]) == set()  # revenue can be worked out
    assert availability.lacking(availability.TABLES["dim_location"], []) == {"revenue", "city or country or state"}
    assert availability.lacking("dim_date dim_customer", ["revenue"]) == {"purchase_date", "customer_id"}


def test_ancestors(spark):
    edges = [(1, None), *[(i, i - 1) for i in range(2, 150)], (500, 20), (600, 601), (601, 600), (700, 601), (800, 99_999), (149, 148)]
    versions = spark.createDataFrame(edges, "version int, parent int")
    line = lambda v: sorted(r[0] for r in quality.ancestors(versions, v).collect())
    assert line(149) == list(range(1, 150))  # further than a recursive query goes
    assert line(500) == [*range(1, 21), 500] and line(1) == [1] and line(12_345) == [12_345] and line(800) == [800, 99_999]
    for v in (600, 700):
        with pytest.raises(ValueError, match="its own ancestor"):
            quality.ancestors(versions, v)
