"""Column names, null tokens and type inference over tables read as text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names the derived relations use.
RESERVED = ("line_id", "order_id", "purchase_ts", "purchase_date", "revenue_is_derived", "discount_rate")
# Cells that mean "no value", compared without case after trimming.
NULL_TOKENS = (
    "", "null", "none", "nan", "n/a", "#n/a", "na", "nil", "-", "--", "?", "missing", "unknown",
)
BOOLEAN_TOKENS = ("true", "false", "t", "f", "yes", "no", "y", "n")
TRUE_TOKENS = ("true", "t", "yes", "y", "1")
# What names and amounts are told by.
IDENTIFIER_NAME = r"(^|_)(id|uuid|guid|sku|code|key|ref|no|number|num)($|_)"
FLAG_NAME = r"^(is|has|was|flag)_|_flag$|(active|returned|refunded|cancelled)"
DATE_NAME = r"date|time|timestamp|_at$|_on$"
CURRENCY = r"[₹$€£¥]|\b(INR|USD|EUR|GBP)\b|[\s']"

# Date formats in the order they are tried: family, shape, pattern, has a time of day.
DATE_FORMATS = (
    ("ISO", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", False),
    ("ISO", r"^\d{4}-\d{2}-\d{2}T", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", True),
    ("ISO", r"^\d{4}-\d{2}-\d{2} ", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", True),
    ("ISO", r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd", False),
    ("ISO", r"^\d{8}$", "yyyyMMdd", False),
    ("DMY", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy", False),
    ("DMY", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy", False),
    ("DMY", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy", False),
    ("DMY", r"^\d{1,2}/\d{1,2}/\d{4} ", "d/M/yyyy H:mm[:ss]", True),
    ("DMY", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy", False),
    ("DMY", r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy", False),
    ("DMY", r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy", False),
    ("MDY", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", False),
    ("MDY", r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy", False),
    ("MDY", r"^\d{1,2}/\d{1,2}/\d{4} ", "M/d/yyyy H:mm[:ss]", True),
    ("MDY", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", False),
    ("MDY", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy", False),
)
_AMBIGUOUS = {"d/M/yyyy", "d-M-yyyy", "d/M/yyyy H:mm[:ss]", "M/d/yyyy", "M-d-yyyy", "M/d/yyyy H:mm[:ss]"}


# --- names ----------------------------------------------------------------------------------------


def normalized_names(names: Sequence[str], mapped: Sequence[str] = ()) -> list[str]:
    """snake_case column names: unique, never empty, never starting with a digit."""
    out: list[str] = []
    for i, raw in enumerate(names, 1):
        text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw)).strip()
        text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
        text = re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")
        text = text or f"col_{i}"
        if text[0].isdigit():
            text = f"c_{text}"
        if text in RESERVED and text not in mapped:
            text = f"{text}_raw"
        name, k = text, 2
        while name in out:
            name, k = f"{text}_{k}", k + 1
        out.append(name)
    return out


def normalize_columns(df: DataFrame, mapped: Sequence[str] = ()) -> DataFrame:
    return df.toDF(*normalized_names(df.columns, mapped))


# --- null tokens ----------------------------------------------------------------------------------


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (position of the column, trimmed text) per cell; meant to be folded again by position."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("k"), F.trim(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(columns)]
    )
    return df.select(F.explode(entries).alias("c")).select("c.k", "c.v").where("v IS NOT NULL")


def _is_token(v: Column, *but: str) -> Column:
    return F.lower(v).isin(*[t for t in NULL_TOKENS if t not in but])


def null_token_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How often each null token occurs per text column."""
    columns = list(columns or df.columns)
    names = F.array(*[F.lit(c) for c in columns])
    return (
        _cells(df, columns)
        .where(_is_token(F.col("v")))
        .groupBy(names[F.col("k")].alias("column"), F.lower("v").alias("token"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _codes_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns that are at least 90 % two-letter codes, where ``NA`` is a value (Namibia)."""
    shares = (
        _cells(df, columns)
        .where(~_is_token(F.col("v")))
        .groupBy("k")
        .agg(F.avg(F.col("v").rlike("^[A-Z]{2}$").cast("int")).alias("share"))
        .where("share >= 0.9")
    )
    return {columns[r["k"]] for r in shares.collect()}


def without_null_tokens(
    df: DataFrame, columns: Sequence[str] | None = None, keep_unknown: bool = True, codes: set[str] | None = None
) -> DataFrame:
    """Trimmed text with null tokens as NULL. ``unknown`` stays a label unless told otherwise."""
    columns = list(columns or df.columns)
    codes = _codes_columns(df, columns) if codes is None else codes
    new = {}
    for c in columns:
        kept = (["na"] if c in codes else []) + (["unknown"] if keep_unknown else [])
        text = F.trim(F.col(f"`{c}`"))
        new[c] = F.when(~_is_token(text, *kept), text)
    return df.withColumns(new)


# --- numbers --------------------------------------------------------------------------------------

_WESTERN = r"^\d{1,3}(,\d{3})+(\.\d+)?$"
_INDIAN = r"^\d{1,2}(,\d{2})*,\d{3}(\.\d+)?$"
_EUROPEAN = r"^\d{1,3}(\.\d{3})+(,\d+)?$"
_PLAIN = r"^\d*\.?\d+([eE][+-]?\d+)?$|^\d+\.$"


def _magnitude(c: Column) -> tuple[Column, Column]:
    """The unsigned digits of a written number and whether it is negative."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), f"(?i){CURRENCY}", ""), r"%$", "")
    negative = bare.rlike(r"^\(.*\)$") | bare.rlike(r"^-") | bare.rlike(r"-$")
    return F.regexp_replace(bare, r"^\(|\)$|^[+-]|-$", ""), negative


def number_style(df: DataFrame, column: str) -> str:
    """western, indian or european by the majority of values that can only be one of them; else auto."""
    return number_styles(df, [column])[column]


# Written numbers that only one style explains.
_ONLY = {
    "western": r"^\d{1,3}(,\d{3})+\.\d+$|^\d{1,3}(,\d{3}){2,}$",
    "indian": r"^\d{1,2}(,\d{2})+,\d{3}(\.\d+)?$",
    "european": r"^\d{1,3}(\.\d{3})+,\d+$|^\d{1,3}(\.\d{3}){2,}$",
}


def number_styles(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    m, _ = _magnitude(F.col("v"))
    votes = (
        _cells(df, columns)
        .where(F.contains("v", F.lit(",")) | F.col("v").like("%.%.%"))  # only separators can tell
        .select("k", m.alias("m"))
        .groupBy("k")
        .agg(*[F.count_if(F.col("m").rlike(p)).alias(style) for style, p in _ONLY.items()])
    )
    out = dict.fromkeys(columns, "auto")
    for row in votes.collect():  # one row per column
        out[columns[row["k"]]] = _voted(row)
    return out


def _voted(votes: Mapping[str, int]) -> str:
    best = max(_ONLY, key=lambda style: votes[style])
    return best if votes[best] else "auto"


# Digits with at most one point and a leading minus: such a cell is its own plain notation unless a point may group.
_OWN_NOTATION = r"^-?(?:\d+\.?\d*|\.\d+)\z"


def number_text(c: Column, style: str | Column = "auto") -> Column:
    """A written number in plain notation, or NULL when it does not follow the style.

    Most cells are plain already. The patterns for the others stand in a lambda, so that they add nothing to the
    generated code of the cells that do without (methods beyond 8 KB are not compiled).
    """

    def digits(v: Column) -> Column:
        m, negative = _magnitude(v)
        return _plain_digits(m, negative, style)

    v = F.trim(c)
    own = v.rlike(_OWN_NOTATION) & ((F.lit(style) if isinstance(style, str) else style) != "european")
    return F.when(own, v).when(v.isNotNull(), F.element_at(F.transform(F.array(v), digits), 1))


def _plain_digits(m: Column, negative: Column, style: str | Column) -> Column:
    no_commas = F.regexp_replace(m, ",", "")
    decimal_comma = F.translate(m, ",.", ".")  # commas become points, points go
    plain = F.when(m.rlike(_PLAIN), m)
    grouped = F.when(m.rlike(_WESTERN) | m.rlike(_INDIAN), no_commas)
    european = F.when(m.rlike(_EUROPEAN) | m.rlike(r"^\d+,\d+$"), decimal_comma)
    unsettled = F.when(m.rlike(r"^\d{1,3},\d{3}$"), no_commas).when(m.rlike(r"^\d+,\d{1,2}$"), decimal_comma)
    by_style = {
        "european": F.coalesce(european, plain),
        "western": F.coalesce(plain, grouped),
        "indian": F.coalesce(plain, grouped),
        "auto": F.coalesce(plain, unsettled, grouped),
    }
    if isinstance(style, str):
        digits = by_style[style]
    else:
        digits = (
            F.when(style == "european", by_style["european"])
            .when(style == "auto", by_style["auto"])
            .otherwise(by_style["western"])
        )
    return F.when(negative, F.concat(F.lit("-"), digits)).otherwise(digits)


def parse_number(c: Column, style: str = "auto", kind: str = "double") -> Column:
    return number_text(c, style).try_cast(kind)


# --- dates ----------------------------------------------------------------------------------------


def _four_digit_years(c: Column) -> Column:
    """Two-digit years: 00-68 belong to the 2000s, 69-99 to the 1900s."""
    text = F.trim(c)
    text = F.regexp_replace(text, r"^(\d{1,2}[/.-]\d{1,2}[/.-])((?:[0-5]\d|6[0-8]))$", "$120$2")
    return F.regexp_replace(text, r"^(\d{1,2}[/.-]\d{1,2}[/.-])((?:69|[7-9]\d))$", "$119$2")


def parse_date(c: Column, pattern: str) -> Column:
    shape = next(s for _, s, p, _ in DATE_FORMATS if p == pattern)
    text = _four_digit_years(c)
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))


# --- inference ------------------------------------------------------------------------------------


@dataclass
class ColumnType:
    """What a text column holds, with the evidence."""

    column: str
    type: str
    n: int
    parse_rate: float = 1.0
    intended: str | None = None
    style: str = "auto"
    pattern: str | None = None
    decimals: int = 0
    distinct: int | None = None
    codes: bool | None = None  # two-letter codes, where NA is a value; None when not looked at
    notes: list[str] = field(default_factory=list)

    @property
    def lossless(self) -> bool:
        """Typed storage loses nothing: every non-null value parses."""
        return self.parse_rate == 1.0


def infer_types(
    df: DataFrame, columns: Sequence[str] | None = None, date_order: str = "DMY", identifiers: Sequence[str] = ()
) -> list[ColumnType]:
    """One decision per text column from counts over every row.

    Cells are folded to one row of counts per column: which null tokens there are, which style numbers have, and how many
    cells read as each type in every style. Only spellings that need patterns meet their equals in a shuffle. Distinct values are counted only for the columns that are
    neither numbers, dates nor booleans, and for whole numbers that may count the rows.
    """
    columns = list(columns or df.columns)
    found: dict[str, ColumnType] = {c: ColumnType(c, "TEXT", 0) for c in columns}
    codes = set()
    for ev in _evidence(df, columns):
        c = columns[ev["k"]]
        if ev["labels"] and ev["codes"] / ev["labels"] >= 0.9:  # two-letter codes, where NA is one
            codes.add(c)
            ev["n"] += ev["na"]
        style = _voted(ev)
        kind = {"indian": "western"}.get(style, style)
        ev |= {name: ev[f"{name}_{kind}"] for name in _NUMBER_COUNTS}
        found[c] = _decide(c, ev, style, date_order, identifiers)
    for c in columns:
        found[c].codes = c in codes
    counting = [c for c in columns if "ROW_INDEX_CANDIDATE" in found[c].notes]
    if counting:
        # From 1 to n in n rows: an index of the rows when no number comes twice.
        values = [F.count_distinct(parse_number(F.trim(F.col(f"`{c}`")), found[c].style, "bigint")).alias(c) for c in counting]
        for c, n in df.agg(*values).first().asDict().items():
            if n == found[c].n:
                found[c].type = "IDENTIFIER"
            else:
                found[c].notes.remove("ROW_INDEX_CANDIDATE")
    text = [c for c in columns if found[c].type == "TEXT"]
    if text:
        _decide_text(without_null_tokens(df, text, codes=codes), text, found)
    return [found[c] for c in columns]


_SHAPES = tuple(dict.fromkeys(shape for _, shape, _, _ in DATE_FORMATS))


_NUMBER_STYLES = ("auto", "western", "european")
_NUMBER_COUNTS = ("num", "integral", "exponent", "places", "lo", "hi", "total")


def _evidence(df: DataFrame, columns: Sequence[str]) -> list[dict]:
    """Per column with cells: how many of them read as each type.

    Null tokens, text without digits and plain numbers are folded to counts inside each task. Equal cells of the
    rest ("written": a date, an amount with separators, a code) are folded first, and the patterns run once on each.
    """
    cells = _cells(df, columns)
    plain = F.col("v").rlike(_OWN_NOTATION)
    written = F.col("v").rlike("[0-9]") & ~plain
    easy = cells.where(~written).withColumn("plain", plain)
    spelled = cells.where(written).groupBy("k", "v").agg(F.count(F.lit(1)).alias("times"))
    found: dict[int, dict] = {}
    for part in (_easy_evidence(easy), _written_evidence(spelled)):
        for row in part.collect():  # one row per column
            _added(found.setdefault(row["k"], {"k": row["k"]}), row.asDict())
    return [dict.fromkeys(_COUNTS, 0) | ev for ev in found.values()]


_COUNTS = (
    *("n", "na", "labels", "codes", "bool", "bits", *_ONLY, "percent", "day_high", "month_high"),
    *[f"fmt{i}" for i in range(len(DATE_FORMATS))],
)


def _added(ev: dict, more: dict) -> None:
    """Counts and totals of two sets of cells are added, limits are compared."""
    for name, x in more.items():
        if name == "k" or x is None:
            ev.setdefault(name, x)
        elif ev.get(name) is None:
            ev[name] = x
        elif name.startswith("lo_"):
            ev[name] = min(ev[name], x)
        elif name.startswith(("hi_", "places_")):
            ev[name] = max(ev[name], x)
        else:
            ev[name] += x


def _easy_evidence(cells: DataFrame) -> DataFrame:
    """Cells without a digit and plain numbers, which read the same in every style."""
    v, plain = F.col("v"), F.col("plain")
    lower, token = F.lower(v), _is_token(v)
    is_text = ~plain & ~token
    dotted = F.contains(v, F.lit("."))
    whole = plain & ~dotted & ((F.length(v) < 18) | v.try_cast("bigint").isNotNull())
    day = F.when(plain & (F.length(v) == 8) & v.rlike(r"^\d{8}$"), v)
    eight = [i for i, (_, s, _, _) in enumerate(DATE_FORMATS) if s == r"^\d{8}$"]
    x = F.when(plain, v.try_cast("double"))
    once = {
        "num": F.count(x),
        "integral": F.count_if(whole),
        "exponent": F.lit(0).cast("bigint"),
        "places": F.max(F.when(x.isNotNull() & dotted, F.length(F.substring_index(v, ".", -1)))),
        "lo": F.min(x),
        "hi": F.max(x),
        "total": F.sum(x),
    }
    out = cells.groupBy("k").agg(
        F.count_if(plain | ~token).alias("n"),
        F.count_if(~plain & (lower == "na")).alias("na"),
        F.count_if(is_text & v.rlike("^[A-Z]{2}$")).alias("codes"),
        F.count_if(is_text & lower.isin(*BOOLEAN_TOKENS)).alias("bool"),
        F.count_if(plain & v.isin("0", "1")).alias("bits"),
        *[F.count(F.try_to_timestamp(day, F.lit(DATE_FORMATS[i][2]))).alias(f"fmt{i}") for i in eight],
        *[c.alias(name) for name, c in once.items()],
    )
    every = [F.col(name).alias(f"{name}_{s}") for name in once for s in _NUMBER_STYLES]
    return out.withColumn("labels", F.col("n")).select("*", *every).drop(*once)


def _written_evidence(cells: DataFrame) -> DataFrame:
    """Cells that hold a digit and are no plain number, each spelling with its ``times``."""
    v, times = F.col("v"), F.col("times")
    magnitude, negative = _magnitude(v)
    # Each cell has one date shape, so it is parsed by the formats of that shape only.
    shape = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(_SHAPES))):
        shape = F.when(F.col("d").rlike(pattern), i).otherwise(shape)
    # Nothing written like a date reads as a number.
    number_like = F.col("shape").isNull()
    cells = (
        cells.withColumn("d", _four_digit_years(v))
        .withColumn("shape", shape)
        .withColumns({"m": F.when(number_like, magnitude), "neg": F.when(number_like, negative)})
        .withColumns({f"t_{s}": F.when(number_like, _plain_digits(F.col("m"), F.col("neg"), s)) for s in _NUMBER_STYLES})
        .withColumns({f"x_{s}": F.col(f"t_{s}").try_cast("double") for s in _NUMBER_STYLES})
    )

    def many(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, times)), F.lit(0))

    over_12 = r"(?:1[3-9]|[2-9]\d)"
    day_first = F.col("d").rlike(rf"^{over_12}[/-]\d{{1,2}}[/-]\d{{4}}")
    month_first = F.col("d").rlike(rf"^\d{{1,2}}[/-]{over_12}[/-]\d{{4}}")
    formats = [
        many((F.col("shape") == _SHAPES.index(s)) & F.try_to_timestamp(F.when(F.col("shape") == _SHAPES.index(s), F.col("d")), F.lit(p)).isNotNull()).alias(f"fmt{i}")
        for i, (_, s, p, _) in enumerate(DATE_FORMATS)
    ]
    numbers = []
    for s in _NUMBER_STYLES:
        t, x = F.col(f"t_{s}"), F.col(f"x_{s}")
        numbers += [
            many(x.isNotNull()).alias(f"num_{s}"),
            many(t.rlike(r"^-?\d+$") & t.try_cast("bigint").isNotNull()).alias(f"integral_{s}"),
            many(F.contains(F.lower(t), F.lit("e"))).alias(f"exponent_{s}"),
            F.max(F.when(x.isNotNull() & F.contains(t, F.lit(".")), F.length(F.substring_index(t, ".", -1)))).alias(f"places_{s}"),
            F.min(x).alias(f"lo_{s}"),
            F.max(x).alias(f"hi_{s}"),
            F.sum(x * times).alias(f"total_{s}"),
        ]
    return cells.groupBy("k").agg(
        F.sum("times").alias("n"),
        F.sum("times").alias("labels"),
        *[many(F.col("m").rlike(p)).alias(style) for style, p in _ONLY.items()],
        *numbers,
        many(F.endswith(v, F.lit("%"))).alias("percent"),
        many((F.col("shape") >= 0) & day_first).alias("day_high"),
        many((F.col("shape") >= 0) & month_first).alias("month_high"),
        *formats,
    )


def _decide(c: str, ev: dict, style: str, date_order: str, identifiers: Sequence[str]) -> ColumnType:
    n = ev["n"]
    if n == 0:
        return ColumnType(c, "TEXT", 0)
    p_num = ev["num"] / n
    whole = ev["integral"] == ev["num"] and ev["num"] > 0
    if (re.search(IDENTIFIER_NAME, c) or c in identifiers) and (p_num < 0.98 or whole):
        return ColumnType(c, "IDENTIFIER", n)
    if ev["bool"] == n or (ev["bits"] == n and re.search(FLAG_NAME, c)):
        return ColumnType(c, "BOOLEAN", n)

    notes = []
    order = date_order
    if ev["day_high"] and ev["month_high"]:
        notes.append("FORMAT_INCONSISTENCY")
    elif ev["day_high"]:
        order = "DMY"
    elif ev["month_high"]:
        order = "MDY"
    ranked_formats = [
        (k, f) for k, f in enumerate(DATE_FORMATS) if f[2] not in _AMBIGUOUS or f[0] == order or "FORMAT_INCONSISTENCY" in notes
    ]
    hit = next(((k, f) for k, f in ranked_formats if ev[f"fmt{k}"] / n >= 0.98), None)
    best = hit or max(ranked_formats, key=lambda kf: ev[f"fmt{kf[0]}"])
    p_date = ev[f"fmt{best[0]}"] / n
    if best[1][2] in _AMBIGUOUS and not ev["day_high"] and not ev["month_high"] and p_date >= 0.8:
        notes.append("DATE_ORDER_ASSUMED")

    dated = bool(re.search(DATE_NAME, c))
    if p_num >= 0.98 and p_date >= 0.98 and not dated:
        p_date = 0.0
    if p_num >= 0.98 and dated and whole and p_date < 0.98 and ev["lo"] >= 20000 and ev["hi"] <= 80000:
        return ColumnType(c, "DATE", n, p_num, style=style, pattern="SERIAL", notes=["EXCEL_SERIAL"])
    if p_num >= 0.98 and not (p_date >= 0.98 and dated):
        if ev["percent"]:
            notes.append("PERCENT_SUFFIX")
        kind = "INTEGER" if whole else "NUMERIC" if (ev["places"] or 0) <= 4 and not ev["exponent"] else "FLOAT"
        out = ColumnType(c, kind, n, p_num, style=style, decimals=ev["places"] or 0, notes=notes)
        if kind == "INTEGER" and ev["lo"] == 1 and ev["hi"] == n and ev["num"] == n and abs(ev["total"] * 2 / (n * (n + 1)) - 1) < 1e-9:
            out.notes.append("ROW_INDEX_CANDIDATE")
        return out
    if p_date >= 0.98:
        has_time = best[1][3]
        return ColumnType(c, "DATETIME" if has_time else "DATE", n, p_date, pattern=best[1][2], notes=notes)
    rate, meant = max((p_num, "NUMERIC"), (p_date, "DATETIME" if best[1][3] else "DATE"))
    if rate >= 0.80:
        return ColumnType(
            c, "MIXED", n, rate, intended=meant, style=style, pattern=best[1][2], notes=[*notes, "TYPE_INCONSISTENCY"]
        )
    return ColumnType(c, "TEXT", n)


def _decide_text(df: DataFrame, columns: list[str], found: dict[str, ColumnType]) -> None:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in columns])
    distinct = (
        df.select(F.explode(cells).alias("c"))
        .where("c.v IS NOT NULL")
        .groupBy("c.column", "c.v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("distinct"),
            F.sum("n").alias("n"),
            F.sum(F.length("v") * F.col("n")).alias("chars"),
            F.sum(F.when(F.contains("v", F.lit(" ")), F.col("n")).otherwise(0)).alias("spaced"),
        )
    )
    for row in distinct.collect():  # one row per text column
        n, d, length = row["n"], row["distinct"], row["chars"] / row["n"]
        out = found[row["column"]]
        out.n, out.distinct = n, d
        if d / n >= 0.95 and n >= 50 and length <= 40 and row["spaced"] / n < 0.2:
            out.type = "IDENTIFIER"
        elif d <= min(1000, max(50, -(-n // 20))) and length <= 50:
            out.type = "CATEGORICAL"


# Storage type per logical type.
STORAGE = {
    "INTEGER": "bigint",
    "NUMERIC": "decimal(38,10)",
    "FLOAT": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "DATETIME": "timestamp",
}


def typed(df: DataFrame, types: Sequence[ColumnType]) -> DataFrame:
    """Version 1: each column in its type when every value parses, else as text; no row is lost."""
    columns = [t.column for t in types]
    unseen = [t.column for t in types if t.codes is None]
    codes = {t.column for t in types if t.codes} | (_codes_columns(df, unseen) if unseen else set())
    labels = without_null_tokens(df, columns, keep_unknown=True, codes=codes)
    new = {}
    for t in types:
        v = F.col(f"`{t.column}`")
        value = F.when(F.lower(v) != "unknown", v)
        if not t.lossless or t.type not in STORAGE:
            new[t.column] = v
        elif t.type == "BOOLEAN":
            new[t.column] = F.when(value.isNotNull(), F.lower(value).isin(*TRUE_TOKENS))
        elif t.pattern == "SERIAL":
            new[t.column] = F.date_add(F.lit("1899-12-30").cast("date"), parse_number(value, t.style, "int"))
        elif t.type in ("DATE", "DATETIME"):
            new[t.column] = parse_date(value, t.pattern).cast(STORAGE[t.type])
        else:
            new[t.column] = parse_number(value, t.style, STORAGE[t.type])
    return labels.withColumns(new).select(*df.columns)


def type_table(df: DataFrame, types: Sequence[ColumnType]) -> DataFrame:
    rows = [
        (i, t.column, t.type if t.type != "MIXED" else "TEXT", t.intended, t.n, float(t.parse_rate), t.pattern, ",".join(t.notes))
        for i, t in enumerate(types, 1)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "ordinal int, column string, type string, intended string, n bigint, parse_rate double, pattern string, notes string",
    )
