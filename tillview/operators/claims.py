"""Numbers quoted in text, and whether they agree with computed figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.columns import rounded
from tillview.session import stage

# The written forms that are looked for. (?U) gives digits, spaces and word edges their
# Unicode meaning.
CURRENCY = r"(?iU)₹\s*(?:[0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]+)?|\d+(?:\.[0-9]+)?)\s*(?:L|Cr|k|M)?"
PERCENT = r"(?U)[+-]?\d+(?:\.\d+)?\s*%"
RATIO = r"(?iU)\d+(?:\.\d+)?\s*x"
NUMBER = r"(?U)\b(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|\d+\.\d+)\b"
# Multipliers of the currency suffixes, tolerances, and numbers any text may use.
SUFFIXES = {"l": 1e5, "cr": 1e7, "k": 1e3, "m": 1e6}
ABSOLUTE, RELATIVE = 0.05, 0.02
CONSTANTS = (
    ("zero", 0.0), ("hundred", 100.0), ("five_pct", 5.0), ("ten_pct", 10.0), ("fifteen_pct", 15.0), ("eighty_pct", 80.0),
    ("twenty_pct", 20.0), ("thirty_days", 30.0), ("sixty_days", 60.0), ("ninety_days", 90.0),
)
_MARK = "\u0001"


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))))


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, r"[₹,%xX\s]|(?i)(?:l|cr|k|m)$", "").try_cast("double")


def _currency_value(token: Column) -> Column:
    """The amount with its suffix applied, whatever its case; NULL when it does not parse."""
    suffix = F.lower(F.regexp_extract(token, r"(?i)(l|cr|k|m)\s*$", 1))
    times = F.lit(1.0)
    for text, factor in SUFFIXES.items():
        times = F.when(suffix == text, factor).otherwise(times)
    return _digits(token) * times


_FEW = 64  # tokens that are compared with each other within their row
_STRETCH = r"[\p{Nd},.]+"


def _alone_of_few(found: DataFrame) -> DataFrame:
    """``n`` without the numbers that are part of an earlier token, for rows of few tokens."""
    # All tokens in order, between marks: a number is part of an earlier token when its first
    # occurrence comes before the place where it stands alone.
    all_ = F.concat(F.lit(_MARK), F.array_join(F.concat("money", "pct", "x", "n"), _MARK), F.lit(_MARK))

    def alone(t: Column) -> Column:
        whole = F.concat(F.lit(_MARK), t, F.lit(_MARK))
        return F.instr(F.col("_all"), t) == F.instr(F.col("_all"), whole) + 1

    return found.withColumn("_all", all_).withColumn("n", F.filter("n", alone)).drop("_all")


def _alone_of_many(found: DataFrame) -> DataFrame:
    """The same for rows of many tokens, by one shuffle of the parts that their tokens have.

    A number holds digits, commas and points only, so it is part of a token when it is a piece of one of the token's stretches of those, and only
    pieces as long as some number of the row matter. The first token that has a piece is found map-side first; the key holds the piece, so that
    a single long text is spread too.
    """
    lengths, before = F.array_distinct(F.transform("n", F.length)), F.size("money") + F.size("pct") + F.size("x")
    rows = found.withColumns({"_row": F.monotonically_increasing_id(), "_lengths": lengths, "_before": before, "_tokens": F.concat("money", "pct", "x", "n")})
    rows = stage(rows)  # so that a token is not handed on with the lists it is from
    tokens = rows.select("_row", F.col("_lengths").alias("lengths"), F.col("_before").alias("before"), F.posexplode("_tokens").alias("place", "token"))

    def pieces(stretch: Column, length: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(stretch) - length + 1), lambda at: F.substring(stretch, at, length))

    stretches = tokens.select("_row", "place", "lengths", F.explode(F.regexp_extract_all("token", F.lit(_STRETCH), F.lit(0))).alias("stretch"))
    cut = stretches.select("_row", "place", "stretch", F.explode("lengths").alias("length")).where(F.col("length") <= F.length("stretch"))
    parts = cut.select("_row", "place", F.explode(pieces(F.col("stretch"), F.col("length"))).alias("token"))
    first = parts.groupBy("_row", "token").agg(F.min("place").alias("first"))
    numbers = tokens.where("place >= before").select("_row", "place", "token").join(first, ["_row", "token"], "left")
    kept = numbers.where(F.col("first").isNull() | (F.col("first") >= F.col("place"))).groupBy("_row")
    kept = kept.agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("kept"))
    out = rows.drop("n").join(kept, "_row", "left").drop("_row")
    none = F.array().cast("array<string>")
    return out.withColumn("n", F.coalesce(F.transform("kept", lambda k: k["token"]), none)).drop("kept").select(*found.columns)


def extract(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct number quoted in a text: its token, kind and value.

    A token found as an amount is not counted again as a percentage or ratio, and a bare number that
    is part of a token found before it is left out. The work grows with the tokens of a text, not with their square.
    """
    body = F.col(text)
    money = _found(body, CURRENCY)
    found = (
        texts.select(key, money.alias("money"), _found(body, PERCENT).alias("pct"), _found(body, RATIO).alias("x"), _found(body, NUMBER).alias("n"))
        .withColumn("pct", F.array_except("pct", "money"))
        .withColumn("x", F.array_except("x", F.concat("money", "pct")))
    )
    # A null text has no tokens. Rows of few tokens need no shuffle.
    many = F.coalesce(F.size(F.concat("money", "pct", "x", "n")) > _FEW, F.lit(False))
    found = stage(found)
    few = _alone_of_few(found.where(~many))
    long = found.where(many)
    found = few if long.isEmpty() else few.union(_alone_of_many(long))

    def entries(column: str, kind, value) -> Column:
        return F.transform(
            column, lambda t: F.struct(t.alias("token"), kind(t).alias("kind"), value(t).alias("number"))
        )

    def fixed(name: str):
        return lambda t: F.lit(name)

    number_kind = lambda t: F.when(F.contains(t, F.lit(".")), "DECIMAL").otherwise("INTEGER")
    claims = F.concat(
        entries("money", fixed("CURRENCY"), _currency_value),
        entries("pct", fixed("PERCENTAGE"), lambda t: F.abs(_digits(t))),
        entries("x", fixed("RATIO"), _digits),
        entries("n", number_kind, _digits),
    )
    return found.select(key, F.explode(claims).alias("c")).select(key, "c.token", "c.kind", "c.number")


def match(claims: DataFrame, pool: DataFrame) -> DataFrame:
    """The figure each claim agrees with: the first one within 0.05, else the nearest within 2 %.

    ``pool``: (position, metric, value). Distinct numbers are matched, not claims, and only figures in
    the same or a neighbouring bucket are compared: buckets of 0.05 for the absolute tolerance, of 2 %
    for the relative one.
    """
    numbers = claims.where("number IS NOT NULL").select("number").distinct()

    def near(value: Column) -> Column:
        return F.floor(value / ABSOLUTE)

    def scale(value: Column) -> Column:
        return F.when(value > 0, F.floor(F.ln(value) / RELATIVE))

    sought = numbers.select(
        "number",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("by"), near(F.col("number")).alias("bucket")),
                F.struct(F.lit("r").alias("by"), scale(F.col("number")).alias("bucket")),
            )
        ).alias("b"),
    ).select("number", "b.by", "b.bucket").where("bucket IS NOT NULL")
    spread = F.concat(
        F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.struct(F.lit("a").alias("by"), (near(F.col("value")) + d).alias("bucket"))),
        F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.struct(F.lit("r").alias("by"), (scale(F.col("value")) + d).alias("bucket"))),
    )
    known = pool.select("position", "metric", "value", F.explode(spread).alias("b")).select(
        "position", "metric", "value", "b.by", "b.bucket"
    ).where("bucket IS NOT NULL")
    off = F.abs(F.col("number") - F.col("value"))
    hit, close = off < ABSOLUTE, off / F.abs(F.nullif("value", F.lit(0.0))) < RELATIVE
    best = (
        sought.join(known, ["by", "bucket"])
        .where(hit | close)
        .groupBy("number")
        .agg(
            F.min_by(
                F.struct("metric", rounded(off, 4).alias("delta")),
                # An absolute hit wins by position; a relative one by distance, then position.
                F.struct(F.when(hit, 0).otherwise(1), F.when(hit, F.lit(0.0)).otherwise(off), F.col("position")),
            ).alias("m")
        )
        .select("number", "m.metric", "m.delta")
    )
    return claims.join(best, "number", "left").select(
        *claims.columns, F.col("metric").alias("matched_metric"), "delta", F.col("metric").isNotNull().alias("is_verified")
    )


def report(texts: DataFrame, matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per text: numbers found, verified, not verified, and the tokens that were not.

    The list is never longer than the text it was taken from, which is one row already.
    """
    flagged = F.when(~F.col("is_verified"), F.col("token"))
    counts = matched.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_verified").alias("verified"),
        F.array_join(F.array_sort(F.collect_list(flagged)), " | ").alias("flagged_tokens"),
    )
    zero = F.lit(0)
    return (
        texts.select(key)
        .join(counts, key, "left")
        .select(
            key,
            F.coalesce("total", zero).alias("total"),
            F.coalesce("verified", zero).alias("verified"),
            (F.coalesce("total", zero) - F.coalesce("verified", zero)).alias("unverified"),
            F.coalesce("flagged_tokens", F.lit("")).alias("flagged_tokens"),
        )
        .withColumn("is_fully_verified", F.col("unverified") == 0)
    )
