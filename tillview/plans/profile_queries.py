"""Profiles, type inference and role mapping over the defective version."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from tillview.operators import profile, roles, typing
from tillview.plans.edge import plain
from tillview.plans.quality_queries import DIRTY, MAPPING, NUMBERS, raw
from tillview.sources.flat import COLUMNS

TEXTS = [c for c in COLUMNS if c not in NUMBERS]
AS_OF = dt.date(2026, 1, 1)


def _q(build):
    return lambda spark, sf_dir: plain(build(raw(spark, sf_dir)))


def as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _role_map(df):
    typed = df.withColumn("order_date", F.col("order_date").cast("timestamp"))
    kinds = roles.logical_types(typed)
    return roles.mapping_table(df.sparkSession, roles.assign(roles.role_figures(typed, kinds, AS_OF), kinds))


def _exact(df):
    """Fractions as decimals: their text is the same wherever it is made."""
    return df.select(*[F.col(f.name).cast("decimal(18,4)").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


# Columns of text made of the orders, the same expressions in both engines: every style of number, dates, mixtures, null tokens, a row index.
_ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_DAY, _MONTH, _YEAR = (f"substr({_ISO}, {a}, {n})" for a, n in ((9, 2), (6, 2), (1, 4)))
_X = "((o_orderkey * 7919) % 90000000 + 1000000)"


def _digits(unit: int, size: int) -> str:
    number = f"CAST(floor({_X} / {unit}) AS BIGINT)"
    return f"lpad(CAST({number} % {10**size} AS STRING), {size}, '0')"


WRITTEN = {
    "place": "CAST(o_orderkey AS STRING)",
    "order_no": "CAST(o_orderkey AS STRING)",
    "western": f"'$' || {_digits(1000000, 2)} || ',' || {_digits(1000, 3)} || ',' || {_digits(1, 3)} || '.50'",
    "indian": f"'₹' || {_digits(10000000, 1)} || ',' || {_digits(100000, 2)} || ',' || {_digits(1000, 2)} || ',' || {_digits(1, 3)} || '.75'",
    "european": f"{_digits(1000000, 2)} || '.' || {_digits(1000, 3)} || '.' || {_digits(1, 3)} || ',25'",
    "bracketed": f"'(' || {_digits(1, 3)} || ')'",
    "share": "CAST(o_orderkey % 100 AS STRING) || '%'",
    "powers": "CAST(o_orderkey % 9 + 1 AS STRING) || '.5e3'",
    "flag_active": "CAST(o_orderkey % 2 AS STRING)",
    "bits": "CAST(o_orderkey % 2 AS STRING)",
    "answer": "CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'No' END",
    "day_first": f"{_DAY} || '/' || {_MONTH} || '/' || {_YEAR}",
    "month_first": f"{_MONTH} || '/' || {_DAY} || '/' || {_YEAR}",
    "iso": _ISO,
    "both_orders": f"CASE WHEN o_orderkey % 10 = 0 THEN {_MONTH} || '/' || {_DAY} ELSE {_DAY} || '/' || {_MONTH} END || '/' || {_YEAR}",
    "mostly_dates": f"CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE {_ISO} END",
    "mostly_numbers": "CASE WHEN o_orderkey % 8 = 0 THEN 'n.k.' ELSE CAST(o_orderkey % 50 AS STRING) END",
    "gaps": "CASE o_orderkey % 4 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'unknown' ELSE CAST(o_orderkey % 7 AS STRING) END",
    "land": "CASE o_orderkey % 20 WHEN 0 THEN 'NA' WHEN 1 THEN '-' ELSE 'DE' END",
    "label": "o_orderpriority",
    "ticket": "'tk' || CAST(o_orderkey AS STRING)",
    "remark": "'order ' || CAST(o_orderkey AS STRING) || ' is here'",
}


def _written(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").selectExpr(*[f"{e} AS {c}" for c, e in WRITTEN.items()])
    return plain(typing.type_table(orders, typing.infer_types(orders)))


def _near_distinct(df):
    """The exact count of every column and whether the sketch is within a tenth of it."""
    sketch = profile.approximate_distinct(df)
    rows = sketch.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("about")) for c in df.columns])))
    both = rows.join(profile.distinct_counts(df), "column", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    return both.select("column", "unique_count", (F.abs(F.col("about") - F.col("unique_count")) <= F.col("unique_count") * 0.1).alias("within"))


def profile_queries():
    return {
        "profile_dataset": _q(profile.dataset_profile),
        "profile_columns": _q(profile.column_profile),
        "profile_distinct": _q(profile.distinct_counts),
        "profile_top_values": _q(profile.column_top_values),
        "profile_samples": _q(lambda df: profile.samples(_exact(df)).withColumn("samples", F.array_join("samples", "|"))),
        "profile_pii": _q(profile.pii_suspicion),
        "profile_approximate_distinct": _q(_near_distinct),
        "preview_page": _q(
            lambda df: profile.preview(
                df,
                columns=["order_id", "product_id", "total_amount"],
                equals={"region": "ASIA"},
                contains={"product_name": "ring"},
                sort="total_amount",
                descending=True,
                limit=50,
                offset=50,
            )
        ),
        "preview_keyset": _q(
            lambda df: profile.page_after(
                df.groupBy("customer_id").agg(F.sum("total_amount").alias("spend")), "spend", "customer_id", (1500000, ""), 50
            )
        ),
        "protect_hash": _q(
            lambda df: profile.protect(df.select("customer_id").distinct(), ["customer_id"], "HASH", "package-secret")
        ),
        "null_token_counts": _q(lambda df: typing.null_token_counts(df, ["category", "payment_method"])),
        "type_written": _written,
        "type_table": _q(lambda df: typing.type_table(df, typing.infer_types(as_text(df)))),
        "typed_version": _q(lambda df: typing.typed(as_text(df), typing.infer_types(as_text(df)))),
        "role_mapping": _q(_role_map),
        "role_validation": _q(lambda df: roles.validate_mapping(df, MAPPING, AS_OF)),
    }


_R = f"WITH {DIRTY}"


def _column(i: int, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    number = c in NUMBERS
    null = "CAST(NULL AS DOUBLE)"
    figures = {
        "mean": f"AVG({x})",
        "std": f"stddev_samp({x})",
        "skewness": f"skewness({x})",
        **{name: f"quantile_cont({x}, {p})" for name, p in profile.PERCENTILES.items()},
    }
    stats = ", ".join(f"{f'ROUND({e}, 6)' if number else null} AS {name}" for name, e in figures.items())
    length = null if number else f"ROUND(AVG(length({c})), 6)"
    bound = "CAST({0}(CAST({1} AS DOUBLE)) AS VARCHAR)" if number else "substring({0}({1}), 1, 64)"
    return f"""SELECT {i} AS ordinal, '{c}' AS "column", COUNT(*) - COUNT({c}) AS null_count,
  ROUND(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100, 4) AS null_pct, COUNT(DISTINCT {c}) AS unique_count,
  ROUND(CAST(COUNT(DISTINCT {c}) AS DOUBLE) / COUNT({c}) * 100, 4) AS unique_pct, {bound.format('MIN', c)} AS min, {bound.format('MAX', c)} AS max,
  {stats}, {length} AS avg_length FROM raw"""


def _top(c: str) -> str:
    return f"""SELECT '{c}' AS "column", ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS position, {c} AS value, COUNT(*) AS count,
  ROUND(CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) * 100, 2) AS percentage,
  CAST(0 AS BIGINT) AS longer_rows
FROM raw WHERE length({c}) <= 100 GROUP BY {c} QUALIFY position <= 20"""


def _samples(i: int, c: str) -> str:
    kind = "string" if c in TEXTS else "bigint" if c in ("quantity", "customer_rating") else "decimal(18,4)"
    text = {"string": c, "bigint": f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"}.get(kind, f"CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR)")
    return f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", '{kind}' AS type, (SELECT string_agg(v, '|' ORDER BY v) FROM (
  SELECT {text} AS v FROM raw WHERE {c} IS NOT NULL ORDER BY sha256({text}), 1 LIMIT 3)) AS samples"""


def _pad(with_: int) -> str:
    """The key of the package secret, padded to a block and combined byte by byte, in hex."""
    return bytes(b ^ with_ for b in b"package-secret".ljust(64, b"\0")).hex()


def _share(c: str, pattern: str) -> str:
    return f"ROUND(COALESCE(AVG(CAST(regexp_matches({c}, '{pattern}') AS INT)), 0), 6)" if c in TEXTS else "MAX(CAST(0 AS DOUBLE))"


def _pii(c: str) -> str:
    by_name = str(bool(re.search(profile.PII_NAME, c))).upper()
    return f"""SELECT '{c}' AS "column", {by_name} AS by_name, {_share(c, profile.EMAIL)} AS email_share, {_share(c, profile.PHONE)} AS phone_share,
  {_share(c, profile.GOVERNMENT_ID)} AS id_share, {_share(c, profile.PERSON)} AS person_share,
  {_share(c, profile.PERSON)} >= 0.8 AND (COUNT(DISTINCT {c}) > {profile.MANY} OR 2 * COUNT(DISTINCT {c}) > COUNT({c})) AS many_persons FROM raw"""


def _check(name: str, role: str, value: str, limit: float, ok: str) -> str:
    return f"""SELECT '{name}' AS "check", '{role}' AS role, ROUND(v, 6) AS value, CAST({limit} AS DOUBLE) AS "limit", v {ok} {limit} AS ok FROM (SELECT {value} AS v FROM raw)"""


_DAY = "TRY_CAST(order_date AS TIMESTAMP)"
_NEAR = "(abs(CAST(total_amount AS DOUBLE) - unit_price * quantity) <= GREATEST(0.01, abs(unit_price * quantity) * 0.01))"


def _union(parts) -> str:
    return f"{_R} " + "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


SQL = {
    "profile_dataset": f"""{_R} SELECT COUNT(*) AS row_count, CAST({len(COLUMNS)} AS BIGINT) AS column_count,
  (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM raw GROUP BY {', '.join(COLUMNS)})) AS duplicate_row_count,
  {' + '.join(f'(COUNT(*) - COUNT({c}))' for c in COLUMNS)} AS missing_cell_count,
  ROUND(CAST({' + '.join(f'(COUNT(*) - COUNT({c}))' for c in COLUMNS)} AS DOUBLE) / (COUNT(*) * {len(COLUMNS)}) * 100, 4) AS missing_pct FROM raw""",
    "profile_columns": _union(_column(i, c) for i, c in enumerate(COLUMNS, 1)).replace(" AS ordinal", "::BIGINT AS ordinal"),
    "profile_distinct": _union(f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS unique_count FROM raw""" for c in COLUMNS),
    "profile_top_values": _union(_top(c) for c in TEXTS),
    "profile_samples": _union(_samples(i, c) for i, c in enumerate(COLUMNS, 1)),
    "profile_approximate_distinct": _union(f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS unique_count, COUNT(DISTINCT {c}) >= 0 AS within FROM raw""" for c in COLUMNS),
    "protect_hash": f"""{_R} SELECT 'sha256:' || substr(sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(customer_id)))), 1, 16) AS customer_id
FROM (SELECT DISTINCT customer_id FROM raw)""",
    "profile_pii": f"""{_R} SELECT *, by_name OR email_share >= 0.3 OR phone_share >= 0.3 OR id_share >= 0.3 OR many_persons AS is_pii_suspected
FROM ({' UNION ALL '.join(_pii(c) for c in COLUMNS)})""",
    "preview_page": f"""{_R} SELECT order_id, product_id, CAST(total_amount AS DOUBLE) AS total_amount FROM raw
WHERE region = 'ASIA' AND product_name LIKE '%ring%' ORDER BY raw.total_amount DESC, {', '.join(f'raw.{c}' for c in COLUMNS if c != 'total_amount')} LIMIT 50 OFFSET 50""",
    "preview_keyset": f"""{_R} SELECT customer_id, CAST(s AS DOUBLE) AS spend FROM (SELECT customer_id, SUM(total_amount) AS s FROM raw GROUP BY customer_id)
WHERE s < 1500000 OR (s = 1500000 AND customer_id > '') ORDER BY s DESC, customer_id LIMIT 50""",
    "null_token_counts": f"""{_R} SELECT "column", token, COUNT(*) AS count FROM (SELECT 'category' AS "column", lower(trim(category)) AS token FROM raw
  UNION ALL SELECT 'payment_method', lower(trim(payment_method)) FROM raw)
WHERE token IN ({', '.join(f"'{t}'" for t in typing.NULL_TOKENS)}) GROUP BY ALL""",
    "typed_version": f"""{_R} SELECT * REPLACE (trim(category) AS category, strftime(CAST(order_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS order_date,
  CAST(total_amount AS DOUBLE) AS total_amount) FROM raw""",
    "role_validation": _union(
        [
            _check("COVERAGE", r, f"CAST(COUNT(*) - COUNT({c}) AS DOUBLE) * 100 / COUNT(*)", 50, "<=") for r, c in MAPPING.items()
        ]
        + [
            _check("DATE_PARSED", "purchase_date", f"CAST(COUNT({_DAY}) AS DOUBLE) / COUNT(order_date)", 0.9, ">="),
            _check(
                "DATE_PLAUSIBLE",
                "purchase_date",
                f"CAST(COUNT(*) FILTER (WHERE CAST({_DAY} AS DATE) BETWEEN DATE '1990-01-01' AND DATE '{AS_OF + dt.timedelta(days=366)}') AS DOUBLE) / COUNT({_DAY})",
                0.9,
                ">=",
            ),
            _check("NOT_CONSTANT", "revenue", "CASE WHEN MAX(total_amount) > MIN(total_amount) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", 1, ">="),
            _check("NOT_CONSTANT", "price", "CASE WHEN MAX(unit_price) > MIN(unit_price) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", 1, ">="),
            _check(
                "REVENUE_IS_PRICE_TIMES_QUANTITY",
                "revenue",
                f"CAST(COUNT(*) FILTER (WHERE {_NEAR}) AS DOUBLE) / COUNT({_NEAR})",
                0.8,
                ">=",
            ),
        ]
    ),
}


def _written_twin() -> str:
    """Types by the rules of the table: shares of cells that read as numbers in the style most of them need, as dates, as yes or no."""
    tokens = ", ".join(f"'{t}'" for t in typing.NULL_TOKENS)
    cells = "\nUNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS c, trim({e}) AS v FROM orders" for i, (c, e) in enumerate(WRITTEN.items(), 1))
    return f"""WITH cells AS ({cells}),
coded AS (SELECT ordinal, COUNT(*) FILTER (WHERE regexp_full_match(v, '[A-Z]{{2}}')) >= 0.9 * COUNT(*) AS codes FROM cells WHERE lower(v) NOT IN ({tokens}) GROUP BY ordinal),
clean AS (SELECT ordinal, c, v, regexp_replace(regexp_replace(v, '^[₹$]|%$', '', 'g'), '^\\((.*)\\)$', '-\\1') AS m, contains(v, '%') AS pct
  FROM cells JOIN coded USING (ordinal) WHERE lower(v) NOT IN ({tokens}) OR (codes AND lower(v) = 'na')),
style AS (SELECT ordinal, COUNT(*) FILTER (WHERE regexp_full_match(m, '[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]+')) > 0 AS euro FROM clean GROUP BY ordinal),
plain AS (SELECT *, CASE WHEN euro THEN replace(replace(m, '.', ''), ',', '.') ELSE replace(m, ',', '') END AS t FROM clean JOIN style USING (ordinal)),
read AS (SELECT *, CASE WHEN regexp_matches(v, '^[0-9]+/|^[0-9]{{4}}-') THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS x, try_strptime(v, '%Y-%m-%d') AS iso, try_strptime(v, '%d/%m/%Y') AS dmy, try_strptime(v, '%m/%d/%Y') AS mdy FROM plain),
shares AS (SELECT ordinal, c, COUNT(*) AS n, COUNT(x) AS num, COUNT(*) FILTER (WHERE regexp_full_match(t, '-?[0-9]+') AND x IS NOT NULL) AS whole, bool_or(contains(lower(t), 'e') AND x IS NOT NULL) AS sci, bool_or(pct) AS pct,
  MIN(x) AS lo, MAX(x) AS hi, COUNT(DISTINCT v) AS kinds, AVG(length(v)) AS len, COUNT(*) FILTER (WHERE contains(v, ' ')) / COUNT(*) AS spaced,
  bool_and(lower(v) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n')) OR (bool_and(v IN ('0', '1')) AND c = 'flag_active') AS flag,
  COUNT(iso) AS iso, COUNT(dmy) AS dmy, COUNT(mdy) AS mdy, bool_or(TRY_CAST(split_part(v, '/', 1) AS INT) > 12 AND contains(v, '/')) AS day_high, bool_or(TRY_CAST(split_part(v, '/', 2) AS INT) > 12) AS month_high
  FROM read GROUP BY ordinal, c),
dates AS (SELECT *, greatest(iso, CASE WHEN month_high AND NOT day_high THEN 0 ELSE dmy END, CASE WHEN month_high THEN mdy ELSE 0 END) / n AS p_date, num / n AS p_num FROM shares),
named AS (SELECT *, CASE WHEN c = 'order_no' AND (p_num < 0.98 OR whole = num) THEN 'IDENTIFIER' WHEN flag THEN 'BOOLEAN'
    WHEN p_num >= 0.98 AND whole = num AND lo = 1 AND hi = n AND kinds = n AND num = n THEN 'IDENTIFIER' WHEN p_num >= 0.98 THEN CASE WHEN whole = num THEN 'INTEGER' WHEN sci THEN 'FLOAT' ELSE 'NUMERIC' END
    WHEN p_date >= 0.98 THEN 'DATE' WHEN greatest(p_num, p_date) >= 0.8 THEN 'MIXED'
    WHEN kinds / n >= 0.95 AND n >= 50 AND len <= 40 AND spaced < 0.2 THEN 'IDENTIFIER' WHEN kinds <= least(1000, greatest(50, ceil(n / 20))) AND len <= 50 THEN 'CATEGORICAL' ELSE 'TEXT' END AS kind FROM dates),
final AS (SELECT *, kind = 'MIXED' AND p_date > p_num AS as_date, kind IN ('INTEGER', 'NUMERIC', 'FLOAT') OR (kind = 'IDENTIFIER' AND c = 'place') AS as_number FROM named)
SELECT CAST(ordinal AS BIGINT) AS ordinal, c AS "column", CASE kind WHEN 'MIXED' THEN 'TEXT' ELSE kind END AS type, CASE WHEN kind = 'MIXED' THEN CASE WHEN as_date THEN 'DATE' ELSE 'NUMERIC' END END AS intended, n,
  CAST(CASE WHEN as_number THEN p_num WHEN kind = 'DATE' OR as_date THEN p_date WHEN kind = 'MIXED' THEN p_num ELSE 1 END AS DOUBLE) AS parse_rate,
  CASE WHEN kind = 'DATE' OR kind = 'MIXED' THEN CASE WHEN iso > 0 OR p_date = 0 THEN 'yyyy-MM-dd' WHEN month_high AND NOT day_high THEN 'M/d/yyyy' ELSE 'd/M/yyyy' END END AS pattern,
  concat_ws(',', CASE WHEN day_high AND month_high AND kind IN ('DATE', 'MIXED') THEN 'FORMAT_INCONSISTENCY' END, CASE WHEN as_number AND pct THEN 'PERCENT_SUFFIX' END,
    CASE WHEN kind = 'IDENTIFIER' AND c = 'place' THEN 'ROW_INDEX_CANDIDATE' END, CASE WHEN kind = 'MIXED' THEN 'TYPE_INCONSISTENCY' END) AS notes FROM final"""


SQL["type_written"] = _written_twin()
