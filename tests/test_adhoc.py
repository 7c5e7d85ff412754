"""The query door by names, the function surface, and the interval join."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from tillview.functions import dialect
from tillview.operators import adhoc, intervals


@pytest.fixture(scope="module")
def view(spark):
    rows = "(1, 'a', DATE'2020-02-03', 2.5D, array(1, 2)), (2, NULL, DATE'2021-03-04', -2.7D, array(3)), (3, 'cac', NULL, NULL, array())"
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(k, s, d, x, a)").createOrReplaceTempView("orders")
    spark.catalog.dropTempView("products")
    return spark


REFUSED = [
    *[f"SELECT * FROM {kind}.`/etc/passwd`" for kind in ("text", "csv", "json", "parquet", "orc", "binaryFile", "avro")],
    "SELECT * FROM `/etc/passwd`", "SELECT * FROM spark_catalog.default.orders", "SELECT * FROM global_temp.orders", "SELECT * FROM IDENTIFIER('text.x')", "SELECT * FROM STREAM orders", "SELECT * FROM nowhere",
    *[f"SELECT {f}('java.lang.System', 'getProperty', 'user.home')" for f in ("reflect", "java_method", "try_reflect")],
    "WITH c AS (SELECT reflect('a', 'b') AS x) SELECT * FROM c", "WITH c AS (SELECT * FROM csv.`/etc/x`) SELECT * FROM c", "SELECT (SELECT max(value) FROM text.`/x`) FROM orders",
    "SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM json.`/x`)", "SELECT * FROM orders WHERE k IN (SELECT k FROM parquet.`/x`)", "SELECT * FROM orders, LATERAL (SELECT * FROM orc.`/x`)",
    "SELECT * FROM orders, LATERAL (SELECT reflect('a', 'b'))", "SELECT sum(k) OVER w FROM orders WINDOW w AS (PARTITION BY reflect('a', 'b'))", "SELECT sum(k) OVER (ORDER BY reflect('a', 'b')) FROM orders",
    "SELECT k FROM orders ORDER BY reflect('a', 'b')", "SELECT * FROM orders o JOIN orders p ON reflect('a', 'b') = '1'", "SELECT * FROM VALUES (reflect('a', 'b')) AS t(a)", "SELECT k FROM orders LIMIT length(reflect('a', 'b'))",
    "SELECT k FROM orders GROUP BY k HAVING reflect('a', 'b') = ''", "SELECT count(*) FILTER (WHERE reflect('a', 'b') = 'x') FROM orders", "SELECT transform(a, q -> reflect('a', 'b')) FROM orders",
    "SELECT s FROM orders PIVOT (max(reflect('a', 'b')) FOR k IN (1))", "SELECT * FROM orders LATERAL VIEW stack(1, reflect('a', 'b')) z AS q", "SELECT CASE WHEN k = 1 THEN reflect('a', 'b') END FROM orders",
    *[f"SELECT * FROM {f}" for f in ("range(10)", "read_files('/x')", "python_worker_logs()", "sql_keywords()", "stack(1, 2)", "json_tuple('a', 'b')")],
    *[f"SELECT {f}" for f in ("current_user", "session_user", "user", "current_date", "current_timestamp()", "now()", "rand()", "uuid()", "version()", "input_file_name()", "from_json('1', 'int')", "spark_catalog.default.f(1)")],
    "SELECT '${env:HOME}'", "SELECT IDENTIFIER('reflect')('a', 'b')", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "SELECT * FROM orders TABLESAMPLE (10 PERCENT)",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused_before_analysis(view, text):
    with pytest.raises(ValueError):
        adhoc.query(view, text)


def test_an_absent_relation_says_why(view):
    with pytest.raises(ValueError, match="not available"):
        adhoc.query(view, "SELECT * FROM products")
    with pytest.raises(ValueError, match="no relation"):
        adhoc.query(view, "SELECT * FROM orders", relations=["customers"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT quantile_disc((k + 1), 0.5) FILTER (WHERE k > 1) AS q, arg_min(s, trunc(x)) AS m, arg_max( (k) , ((x)) ) AS n FROM orders", [(3.0, "a", 1)]),
        ("SELECT list(s) AS l, list(k) FILTER (WHERE k > 5) AS n, any_value(s) AS a FROM orders WHERE k < 3", [(["a", None], None, "a")]),
        ("SELECT list(k) OVER (ORDER BY k) AS l FROM orders ORDER BY k", [([1],), ([1, 2],), ([1, 2, 3],)]),
        ("SELECT corr(k, k * 2) AS c, corr(k, k - k) AS z, corr(k, x) FILTER (WHERE k > 9) AS e FROM orders", [(1.0, "nan", None)]),
        ("SELECT k, CAST(h[k] AS BIGINT) AS n FROM (SELECT histogram(length(s)) AS h FROM orders) t, unnest(map_keys(h)) AS u(k) ORDER BY k", [(1, 1), (3, 1)]),
        ("SELECT y FROM orders, unnest(a) AS u(y) ORDER BY y", [(1,), (2,), (3,)]),
        ("SELECT y FROM orders CROSS JOIN LATERAL unnest(orders.a) AS u(y) ORDER BY 1", [(1,), (2,), (3,)]),
        ("SELECT unnest(a) AS y FROM orders ORDER BY y", [(1,), (2,), (3,)]),
        ("SELECT concat(s, NULL, k) AS c, regexp_replace('aXbX', 'X', '$1') AS f, regexp_replace('aXbX', '(x)', '<\\1>', 'gi') AS g, regexp_replace('ab', '(?<=a)b$', '') AS b FROM orders WHERE k = 1", [("a1", "a$1bX", "a<X>b<X>", "a")]),
        ("SELECT strftime(d, '%d/%m/%Y week %W, %%') AS a, date_diff('month', d, DATE'2021-01-31') AS b, date_sub('month', d, DATE'2021-01-01') AS c, isodow(d) AS i, dayofweek(d) AS w FROM orders WHERE k = 1", [("03/02/2020 week 05, %", 11, 10, 1, 1)]),
        ("SELECT iif(k > 1, 'p', 'q') AS a, log(100) AS b, log(2, 8) AS c, trunc(-2.7) AS d, 'date_diff is a name' AS e, upper('unnest(x)') AS f FROM orders WHERE k = 1", [("q", 2.0, 3.0, -2, "date_diff is a name", "UNNEST(X)")]),
        ("SELECT k FROM orders WHERE s LIKE '%a%' AND k BETWEEN 1 AND 3 AND NOT s IS NULL AND k IN (1, 2) UNION ALL VALUES (7) ORDER BY 1", [(1,), (7,)]),
        ("WITH c AS (SELECT k FROM orders), e AS (SELECT k FROM c) SELECT count(*) AS n FROM e JOIN c USING (k) WHERE k IN (SELECT k FROM e)", [(3,)]),
        ("SELECT trim('xxaxx', 'x') || ltrim('xxa', 'x') || rtrim('axx', 'x') AS t FROM orders LIMIT 1", [("aaa",)]),
    ],
)
def test_meanings(view, text, want):
    got = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in adhoc.query(view, text).collect()]
    assert got == want


def test_every_name_of_the_surface_is_known(spark):
    """Names that Spark has not, or has with another meaning, are written anew."""
    ours = {name for name, _ in dialect.MEANINGS} | {"date_diff"}
    for kind, names in dialect.SURFACE.items():
        for name in names.split():
            assert name in ours or kind == "window" or spark.catalog.functionExists(name), name


def test_formats_must_be_written_out(view):
    with pytest.raises(ValueError, match="written out"):
        adhoc.query(view, "SELECT strftime(d, s) FROM orders")
    with pytest.raises(ValueError):
        adhoc.query(view, "SELECT strftime(d, '%Q') FROM orders")
    with pytest.raises(ValueError, match="DISTINCT"):
        adhoc.query(view, "SELECT list(DISTINCT s) FROM orders")


# intervals


def pairs(spark, points, spans, **more):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "p int, x double")
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "s int, a double, b double")
    out = intervals.interval_join(p, s, "x", "a", "b", **more)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    return sorted((r.p, r.s) for r in out.collect())


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(3)
    points = [rng.choice([rng.uniform(0, 100), 7.0, rng.uniform(5, 6), -1e9, 1e9]) for _ in range(900)] + [None, math.nan, math.inf]
    spans = [(a, a + rng.choice([0.01, 1.0, 90.0, 0.0, -1.0])) for a in [rng.uniform(-5, 105) for _ in range(150)]]
    spans += [(6.0, 7.0), (7.0, 8.0), (-math.inf, 3.0), (99.0, math.inf), (None, 1.0), (1.0, None), (math.nan, 2.0)]
    want = sorted((i, j) for i, x in enumerate(points) for j, (a, b) in enumerate(spans) if None not in (x, a, b) and not any(map(math.isnan, (x, a, b))) and a < x <= b)
    assert pairs(spark, points, spans) == want
    assert pairs(spark, points, spans, bin_rows=50) == want  # a third of the points is one value


def test_interval_join_of_nothing(spark):
    assert pairs(spark, [], [(0.0, 1.0)]) == [] and pairs(spark, [1.0], []) == []


def test_dates_as_numbers(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, i),) for i in range(1, 10)], "d date").select(F.unix_date("d").alias("x"))
    s = spark.createDataFrame([(1, 19725, 19727)], "s int, a int, b int")
    assert intervals.interval_join(d, s, "x", "a", "b").count() == 2
