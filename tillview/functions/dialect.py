"""The function surface of ad-hoc SQL: which names may be called, and what those mean that Spark knows otherwise or not at all.

Spark's parser tells where in the text a call stands and where its arguments stand. ``rewritten`` puts the Spark expression
of such a call in its place; nothing else of the text is touched. Where the expression is long it is a temporary SQL function,
which Catalyst inlines like a view.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

# The functions of the surface by kind.
SURFACE = {
    "aggregate": "count sum avg min max median mode stddev stddev_pop stddev_samp variance var_pop var_samp corr covar_pop covar_samp quantile_cont quantile_disc"
    " approx_count_distinct arg_min arg_max any_value first last list string_agg bool_and bool_or count_if histogram",
    "window": "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value",
    "math": "abs ceil floor round trunc sqrt power pow ln log log10 exp sign greatest least mod",
    "null": "coalesce nullif ifnull",
    "string": "lower upper trim ltrim rtrim length substr substring replace concat concat_ws contains starts_with ends_with regexp_matches regexp_replace split_part left right lpad rpad",
    "date": "date_trunc date_part date_diff date_add date_sub year quarter month week day dayofweek isodow strftime strptime make_date last_day epoch",
    "branch": "if iif",
    "table": "unnest",
}
# Spark's own names that may be called as well. None of them reads anything but its arguments.
ALSO = (
    "percentile percentile_disc min_by max_by collect_list collect_set listagg array struct named_struct map size element_at explode posexplode inline transform filter aggregate"
    " array_contains map_keys map_values cardinality array_distinct array_sort sort_array array_join startswith endswith regexp_like regexp_extract datediff date_format to_date to_timestamp try_to_timestamp try_strptime"
    " weekofyear weekday dayofyear dayofmonth hour minute second extract cast date timestamp try_divide ceiling char_length position locate reverse string int bigint double grouping grouping_id"
)
# Names that the parser itself gives to operators, and the functions below.
_PARSED = "between tv_date_diff"
NAMES = frozenset(" ".join([*SURFACE.values(), ALSO, _PARSED]).split())
TABLE_NAMES = frozenset("unnest explode posexplode inline".split())

# Name, parameters, result type and Spark expression of the temporary functions.
FUNCTIONS = (
    ("tv_date_part", "f STRING, t TIMESTAMP", "BIGINT",
     "CASE lower(f) WHEN 'year' THEN year(t) WHEN 'quarter' THEN quarter(t) WHEN 'month' THEN month(t) WHEN 'week' THEN weekofyear(t) WHEN 'day' THEN day(t)"
     " WHEN 'dow' THEN dayofweek(t) - 1 WHEN 'dayofweek' THEN dayofweek(t) - 1 WHEN 'isodow' THEN weekday(t) + 1 WHEN 'doy' THEN dayofyear(t) WHEN 'dayofyear' THEN dayofyear(t)"
     " WHEN 'hour' THEN hour(t) WHEN 'minute' THEN minute(t) WHEN 'second' THEN second(t) WHEN 'decade' THEN year(t) div 10 WHEN 'century' THEN (year(t) + 99) div 100"
     " ELSE CAST(raise_error(concat('no part of a date: ', f)) AS BIGINT) END"),
    ("tv_date_diff", "f STRING, a TIMESTAMP, b TIMESTAMP", "BIGINT",
     "CASE lower(f) WHEN 'year' THEN year(b) - year(a) WHEN 'quarter' THEN (year(b) * 4 + quarter(b)) - (year(a) * 4 + quarter(a))"
     " WHEN 'month' THEN (year(b) * 12 + month(b)) - (year(a) * 12 + month(a)) WHEN 'week' THEN datediff(b, a) div 7 WHEN 'day' THEN datediff(b, a)"
     " WHEN 'hour' THEN (unix_seconds(date_trunc('hour', b)) - unix_seconds(date_trunc('hour', a))) div 3600"
     " WHEN 'minute' THEN (unix_seconds(date_trunc('minute', b)) - unix_seconds(date_trunc('minute', a))) div 60"
     " WHEN 'second' THEN unix_seconds(b) - unix_seconds(a) ELSE CAST(raise_error(concat('no part of a date: ', f)) AS BIGINT) END"),
    ("tv_date_sub", "f STRING, a TIMESTAMP, b TIMESTAMP", "BIGINT",
     "CASE lower(f) WHEN 'year' THEN timestampdiff(YEAR, a, b) WHEN 'quarter' THEN timestampdiff(QUARTER, a, b) WHEN 'month' THEN timestampdiff(MONTH, a, b)"
     " WHEN 'week' THEN timestampdiff(WEEK, a, b) WHEN 'day' THEN timestampdiff(DAY, a, b) WHEN 'hour' THEN timestampdiff(HOUR, a, b) WHEN 'minute' THEN timestampdiff(MINUTE, a, b)"
     " WHEN 'second' THEN timestampdiff(SECOND, a, b) ELSE CAST(raise_error(concat('no part of a date: ', f)) AS BIGINT) END"),
    # A replacement has \1 where Java has $1. The first match only: what follows it is matched too, and put back.
    ("tv_replacement", "r STRING", "STRING", r"""regexp_replace(replace(r, r'$', r'\$'), r'\\([0-9])', r'\$$1')"""),
    ("tv_regexp_first", "s STRING, p STRING, r STRING", "STRING", r"""regexp_replace(s, concat('(?:', p, r')(?<tvrest>[\s\S]*)\z'), concat(tv_replacement(r), '$', '{tvrest}'))"""),
    ("tv_regexp_options", "s STRING, p STRING, r STRING, o STRING", "STRING",
     "CASE WHEN contains(o, 'g') THEN regexp_replace(s, concat(CASE WHEN contains(o, 'i') THEN '(?i)' ELSE '' END, p), tv_replacement(r))"
     " ELSE tv_regexp_first(s, concat(CASE WHEN contains(o, 'i') THEN '(?i)' ELSE '' END, p), r) END"),
)

# Format letters of strftime and their date_format patterns.
FORMATS = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD", "%y": "yy", "%f": "SSSSSS", "%p": "a",
    "%-d": "d", "%-m": "M", "%-H": "H", "%-I": "h", "%-M": "m", "%-S": "s", "%-j": "D",
}
# Format letters without a pattern, as expressions of a date.
COUNTED = {
    "%W": "lpad(CAST((dayofyear({0}) + 6 - weekday({0})) div 7 AS STRING), 2, '0')",
    "%U": "lpad(CAST((dayofyear({0}) + 7 - dayofweek({0})) div 7 AS STRING), 2, '0')",
    "%u": "CAST(weekday({0}) + 1 AS STRING)",
    "%w": "CAST(dayofweek({0}) - 1 AS STRING)",
    "%%": "'%'",
}


@dataclass
class Call:
    """A call in a text: where it begins and ends, and where its arguments do. Without a name: a text literal."""

    name: str
    start: int
    end: int
    arguments: list[tuple[int, int]]
    distinct: bool = False
    inner: bool = False  # a table function joined to what stands left of it


def date_pattern(strftime: str) -> str:
    """A strftime format as a date_format pattern; letters outside the codes are quoted."""
    parts = _format_parts(strftime)
    for kind, text in parts:
        if kind == "code" and text not in FORMATS:
            raise ValueError(f"{text} has no date_format pattern")
    return "".join(FORMATS[t] if kind == "code" else _quoted(t) for kind, t in parts)


def _quoted(literal: str) -> str:
    literal = literal.replace("'", "''")
    return f"'{literal}'" if any(ch.isalpha() or ch in "'[]{}#" for ch in literal) else literal


def _format_parts(strftime: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(strftime):
        code = next((strftime[i : i + n] for n in (3, 2) if strftime[i : i + n] in FORMATS or strftime[i : i + n] in COUNTED), None)
        if code is None and strftime[i] == "%":
            raise ValueError(f"{strftime[i : i + 2]} has no date_format pattern")
        if code:
            out.append(("code", code))
        elif out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + strftime[i])
        else:
            out.append(("text", strftime[i]))
        i += len(code or "x")
    return out


def _literal(text: str) -> str:
    text = text.strip()
    if len(text) < 2 or text[0] != "'" or text[-1] != "'" or "'" in text[1:-1] or "\\" in text:
        raise ValueError(f"a format must be written out, not computed: {text}")
    return text[1:-1]


def _strftime(when: str, form: str) -> str:
    """Pieces that date_format knows, and those counted out, in one text."""
    pieces, pattern = [], ""
    for kind, text in [*_format_parts(_literal(form)), ("code", "%%end")]:
        if kind == "code" and text not in FORMATS:
            if pattern:
                escaped = pattern.replace("'", "''")
                pieces.append(f"date_format({when}, '{escaped}')")
                pattern = ""
            if text in COUNTED:
                pieces.append(COUNTED[text].format(f"({when})"))
        else:
            pattern += FORMATS[text] if kind == "code" else _quoted(text)
    return f"concat({', '.join(pieces)})" if pieces else "''"


def _pattern(form: str) -> str:
    escaped = date_pattern(_literal(form)).replace("'", "''")
    return f"'{escaped}'"


def _date_add(when: str, step: str) -> str:
    return f"(CAST({when} AS TIMESTAMP) + {step})" if "interval" in step.lower() else f"date_add({when}, {step})"


def _concat(*parts: str) -> str:
    return "concat_ws('', {})".format(", ".join(f"CAST({p} AS STRING)" for p in parts))


# By name and number of arguments, the Spark expression. Clauses behind a call (FILTER, OVER) go to {clauses}, or to the end.
MEANINGS: dict[tuple[str, int], str | Callable[..., str]] = {
    ("quantile_cont", 2): "percentile({0}, {1})",
    ("quantile_disc", 2): "percentile_disc({1}) WITHIN GROUP (ORDER BY {0})",
    ("arg_min", 2): "min_by({0}, IF({0} IS NULL, NULL, {1}))",
    ("arg_max", 2): "max_by({0}, IF({0} IS NULL, NULL, {1}))",
    ("any_value", 1): "any_value({0}) IGNORE NULLS",
    ("list", 1): "transform(nullif(collect_list(struct({0} AS v)){clauses}, array()), s -> s.v)",
    # Counts are mergeable and exact for as many values as are tracked; with more it fails rather than guesses.
    ("histogram", 1): "map_from_entries(filter(transform(array_sort(approx_top_k({0}, 65536, 131072){clauses}), (e, i) -> IF(i = 65535, raise_error('more than 65535 values in histogram'), e)), e -> e.item IS NOT NULL))",
    ("corr", 2): "IF(count(IF({0} IS NULL OR {1} IS NULL, NULL, 1)){clauses} = 0, NULL, coalesce(try_divide(covar_pop({0}, {1}){clauses}, stddev_pop(IF({1} IS NULL, NULL, {0})){clauses} * stddev_pop(IF({0} IS NULL, NULL, {1})){clauses}), double('NaN')))",
    ("trunc", 1): "IF({0} < 0, ceil({0}), floor({0}))",
    ("log", 1): "log10({0})",
    ("concat", -1): _concat,
    ("starts_with", 2): "startswith({0}, {1})",
    ("ends_with", 2): "endswith({0}, {1})",
    ("regexp_matches", 2): "regexp_like({0}, {1})",
    ("regexp_replace", 3): "tv_regexp_first({0}, {1}, {2})",
    ("regexp_replace", 4): "tv_regexp_options({0}, {1}, {2}, {3})",
    ("trim", 2): "trim(BOTH {1} FROM {0})",
    ("ltrim", 2): "trim(LEADING {1} FROM {0})",
    ("rtrim", 2): "trim(TRAILING {1} FROM {0})",
    ("date_part", 2): "tv_date_part({0}, {1})",
    ("date_sub", 3): "tv_date_sub({0}, {1}, {2})",
    ("date_add", 2): _date_add,
    ("week", 1): "weekofyear({0})",
    ("dayofweek", 1): "(dayofweek({0}) - 1)",
    ("isodow", 1): "(weekday({0}) + 1)",
    ("strftime", 2): _strftime,
    ("strptime", 2): lambda s, f: f"to_timestamp({s}, {_pattern(f)})",
    ("try_strptime", 2): lambda s, f: f"try_to_timestamp({s}, {_pattern(f)})",
    ("epoch", 1): "(unix_micros(CAST({0} AS TIMESTAMP)) / 1e6D)",
    ("iif", 3): "if({0}, {1}, {2})",
    ("unnest", 1): "explode({0})",
}
def readable(text: str) -> str:
    """``text`` with date_diff of a quoted part under another name: Spark's grammar takes a bare one only."""
    return re.sub(r"(?i)\bdate_diff(\s*\(\s*'\w+'\s*,)", r"tv_date_diff\1", text)


def rewritten(text: str, calls: Sequence[Call]) -> str:
    """``text`` with Spark's expression in the place of every call that has one."""
    known = sorted((c for c in calls if not c.name or (c.name, len(c.arguments)) in MEANINGS or (c.name, -1) in MEANINGS), key=lambda c: (c.start, -c.end))

    def render(low: int, high: int, own: list[Call]) -> str:
        out, at = [], low
        while own:
            call, *rest = own
            inside = [c for c in rest if c.end <= call.end]
            own = [c for c in rest if c.end > call.end]
            out.append(text[at : call.start])
            at = call.end
            if not call.name:  # a backslash stands for itself
                out.append(text[call.start : call.end].replace("\\", "\\\\"))
                continue
            parts = [render(a, b, [c for c in inside if a <= c.start and c.end <= b]).strip() for a, b in call.arguments]
            close = call.arguments[-1][1]
            out.append(_meaning(call, parts, render(close + 1, call.end, [c for c in inside if c.start > close])))
        return "".join(out) + text[at:high]

    return render(0, len(text), known)


def _meaning(call: Call, parts: list[str], clauses: str) -> str:
    found = MEANINGS.get((call.name, len(parts))) or MEANINGS[(call.name, -1)]
    if call.distinct:
        if call.name not in ("quantile_cont",):
            raise ValueError(f"DISTINCT is not known in {call.name}")
        parts[0] = f"DISTINCT {parts[0]}"
    if not isinstance(found, str):
        return found(*parts) + clauses
    if "{clauses}" not in found:
        found += "{clauses}"
    for i, part in enumerate([*parts]):
        found = found.replace(f"{{{i}}}", f"\0{i}\0")
    for i, part in enumerate(parts):
        found = found.replace(f"\0{i}\0", part)
    lateral = "LATERAL " if call.inner else ""
    return lateral + found.replace("{clauses}", clauses)


def register(spark: SparkSession) -> list[str]:
    """Add the temporary functions to the session."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
