import re

from pyspark.sql import functions as F

from tillview.operators import claims, insights

TEXTS = [
    "Revenue was ₹8.92L, or ₹8,92,000.50 in 1,234 orders; 12.5% more, 12.5 % again, 4.2x and 4.2 X.",
    "₹5CR and ₹ 7 k, then 11.5 and 1.5 and 11.5, 22,331,115.75",
    "no numbers here 42 7",
    "-3% +3% 100% ₹0",
    "£5.25 naïve5.5 5.5é ٣.٤ 2.25\n%",
    "",
]


def expected(text):
    """The rules applied one after the other, as a plain loop."""
    forms = [
        ("CURRENCY", re.compile(r"₹\s*([0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]+)?|\d+(?:\.[0-9]+)?)\s*(?:L|Cr|k|M)?", re.I)),
        ("PERCENTAGE", re.compile(r"([+-]?\d+(?:\.\d+)?)\s*%")),
        ("RATIO", re.compile(r"(\d+(?:\.\d+)?)\s*x", re.I)),
        ("NUMBER", re.compile(r"\b([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|\d+\.\d+)\b")),
    ]
    seen, out = [], []
    for kind, form in forms:
        for m in form.finditer(text):
            token = m.group(0).strip()
            if token in seen or (kind == "NUMBER" and any(token in s for s in seen)):
                continue
            seen.append(token)
            out.append((token, kind if kind != "NUMBER" else "DECIMAL" if "." in token else "INTEGER"))
    return out


def test_extraction_matches_the_loop(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = claims.extract(df).collect()
    for i, text in enumerate(TEXTS):
        assert sorted((r["token"], r["kind"]) for r in got if r["doc_id"] == i) == sorted(expected(text)), text
    value = {r["token"]: r["number"] for r in got}
    assert value["₹8.92L"] == 892000.0 and value["₹5CR"] == 5e7 and value["₹ 7 k"] == 7000.0
    assert value["-3%"] == 3.0 and value["4.2 X"] == 4.2 and value["22,331,115.75"] == 22331115.75


def test_many_numbers_in_one_text(spark):
    text = " ".join(f"{i}.{i % 10}" for i in range(1, 3000))
    got = claims.extract(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert got.count() == len(expected(text))


def brute(value, pool):
    best, least = None, float("inf")
    for name, v in pool:
        off = abs(value - v)
        if off < 0.05:
            return name
        if v and off / abs(v) < 0.02 and off < least:
            best, least = name, off
    return best


def test_matching_equals_brute_force(spark):
    pool = [("a", 100.0), ("b", 101.0), ("c", 100.04), ("zero", 0.0), ("neg", -50.0), ("big", 1e9), ("small", 0.3), ("d", 99.0), ("e", 5.0)]
    numbers = [x / 100 for x in range(0, 700, 3)] + [98.03 + i * 0.01 for i in range(500)] + [1e9 * (0.975 + i * 0.001) for i in range(60)]
    texts = spark.createDataFrame([(i, f"{n!r}", "DECIMAL", n) for i, n in enumerate(numbers)], "doc_id int, token string, kind string, number double")
    table = spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(pool)], "position int, metric string, value double")
    for r in claims.match(texts, table).collect():
        assert r["matched_metric"] == brute(r["number"], pool), r


def test_report(spark):
    texts = spark.createDataFrame([(1, "5.0% and 77.7%"), (2, "plain")], "doc_id int, text string")
    pool = spark.createDataFrame([(0, "five", 5.0)], "position int, metric string, value double")
    got = {r["doc_id"]: r for r in claims.report(texts, claims.match(claims.extract(texts), pool)).collect()}
    assert (got[1]["total"], got[1]["verified"], got[1]["flagged_tokens"], got[1]["is_fully_verified"]) == (2, 1, "77.7%", False)
    assert got[2]["total"] == 0 and got[2]["is_fully_verified"]


def test_findings_quote_only_computed_numbers(spark):
    from tillview.operators import catalog, cleaning, quality, rfm, slices
    from tillview.sources import synthetic
    from tillview.sources.transactions import TransactionSource
    from tillview.session import stage

    df = stage(cleaning.clean(synthetic.retail(spark, 2000)).rows)
    scored = stage(rfm.score(rfm.flat_base(df), rules="code"))
    rows = insights.findings(
        rfm.segment_table(spark, scored),
        catalog.product_table(TransactionSource(df)),
        catalog.payment_table(df),
        quality.basic_profile(df),
        slices.key_figures(df),
    )
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"INS-01", "INS-02", "INS-03", "INS-04", "INS-05"}
    assert all("{" not in r["finding"] + r["impact"] and r["finding"] for r in got.values())
    assert "UPI carries" in got["INS-04"]["finding"] and "of 20 products" in got["INS-03"]["finding"]


def test_ranked_insights_need_a_metric(spark):
    df = spark.createDataFrame(
        [("segment_revenue_share", "HIGH_VALUE", 0.6), ("segment_revenue_share", "REGULAR", 0.3), ("discount_revenue_correlation", None, -0.2), ("revenue_growth", None, 0.001)],
        "metric_name string, member string, value double",
    )
    got = [(r["rule_key"], r["impact_rank"], r["is_association"]) for r in insights.ranked_insights(df).collect()]
    assert got == [("high_value_revenue_concentration", 1, False), ("discount_and_revenue", 2, True)]
    assert insights.ranked_insights(df.where(F.lit(False))).isEmpty()


def test_numbers_in_long_texts(spark, monkeypatch):
    """Rows of many tokens give what rows of few give, and a text of a megabyte is done in no time."""
    import random
    import time

    rng = random.Random(5)

    def token():
        x = rng.randrange(1, 4000)
        return rng.choice([f"{x}.{x % 10}", f"1,{x % 900 + 100}.{x % 7}", f"₹{x}.{x % 10}", f"{x % 100}.{x % 10}%", f"{x % 50}.5x", f"{x}", "word"])

    rows = [(i, " ".join(token() for _ in range(rng.choice([0, 5, 150])))) for i in range(40)] + [(99, None), (98, "")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    order = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(claims, "_FEW", 10**6)
    want = order(claims.extract(texts))
    for few in (0, 20):
        monkeypatch.setattr(claims, "_FEW", few)
        assert order(claims.extract(texts)) == want
    monkeypatch.undo()
    long = " ".join(f"{i}.{i % 1000:03d}" for i in range(10_000, 120_000))
    assert len(long) > 1_000_000
    began = time.time()
    assert claims.extract(spark.createDataFrame([(1, long)], "doc_id int, text string")).count() == 110_000
    assert time.time() - began < 120
