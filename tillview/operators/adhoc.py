"""Read-only SQL over the relations."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions import dialect
from tillview.operators.relations import Relations

DEFAULT_ROWS = 500
# The relations a query may name.
RELATIONS = ("transactions", "orders", "customers", "products", "calendar", "run_params", "customer_rfm", "customer_segments", "retail_sales", "sales")
# What a parsed query is made of; anything else writes, changes, describes or reads something else.
NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit LimitAll Offset Union Intersect Except Distinct SubqueryAlias"
    " UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable LocalRelation UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith OneRowRelation"
    " Generate WithWindowDefinition UnresolvedHaving Pivot Unpivot".split()
)
EXPRESSIONS = frozenset(
    "UnresolvedAlias Alias MultiAlias UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAttribute UnresolvedOrdinal UnresolvedSubqueryColumnAliases Literal UnresolvedFunction"
    " UnresolvedGenerator UnresolvedExtractValue UnresolvedNamedLambdaVariable LambdaFunction UnresolvedWindowExpression WindowExpression WindowSpecDefinition WindowSpecReference"
    " SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing SortOrder And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan"
    " GreaterThanOrEqual Between In InSubquery ListQuery ScalarSubquery Exists LateralSubquery Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny IsNull IsNotNull IsTrue IsFalse CaseWhen If"
    " Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Concat Cast Substring Overlay StringTrim StringTrimLeft StringTrimRight StringLocate Extract"
    " TimestampAdd TimestampDiff NamedParameter AggregateExpression First Last AnyValue CreateStruct CreateNamedStruct GroupingSets Cube Rollup".split()
)
# Names that Spark answers from its session where no column has them.
_SESSION_NAMES = ("user", "session_user", "localtime", "localtimestamp")
_PLAIN_CALLS = {"AnyValue": "any_value", "First": "first", "Last": "last"}


@dataclass
class Result:
    columns: list[str]
    types: list[str]
    rows: list[tuple]
    milliseconds: float


def expose(df: DataFrame) -> DataFrame:
    """A flat file under both its own and the canonical names, as ``transactions``, ``retail_sales`` and ``sales``."""
    names = {"order_id": "transaction_id", "order_date": "purchase_date", "total_amount": "revenue"}
    extra = [F.col(a).alias(b) for a, b in names.items() if a in df.columns and b not in df.columns]
    out = df.select("*", *extra)
    for view in ("transactions", "retail_sales", "sales"):
        out.createOrReplaceTempView(view)
    return out


def query(spark: SparkSession, text: str, parameters: Mapping[str, object] | None = None, relations: Iterable[str] = RELATIONS) -> DataFrame:
    """The rows of one query with bound parameters; whatever is no query, or names anything else, is refused.

    Spark's own parser gives the plan, which is looked at before anything is analysed or run: every node and expression must be
    one that a query is made of, every relation a view of ``relations`` or a name of an enclosing WITH, every function one of
    the surface. That holds in subqueries, in the bodies of WITH and in window definitions too. Calls whose meaning differs
    in Spark are then put in Spark's words (see ``dialect``).
    """
    text = dialect.readable(text.strip().rstrip(";"))
    if not text:
        raise ValueError("only queries are accepted")
    if "${" in text:
        raise ValueError("settings and variables of the session are not accessible")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"this is not a query: {str(e)[:300]}") from None
    seen = _Seen(spark, text, frozenset(r.lower() for r in relations))
    seen.plan(plan, frozenset())
    ours = dialect.rewritten(text, seen.calls)
    if "tv_" in ours:
        dialect.register(spark)
    return spark.sql(ours, args=dict(parameters or {}))


def _items(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]


class _Seen:
    """A walk over a parsed plan that refuses what is not allowed and notes where function calls stand."""

    def __init__(self, spark: SparkSession, text: str, relations: frozenset[str]):
        self.catalog, self.text, self.relations = spark._jsparkSession.sessionState().catalog(), text, relations
        self.calls: list[dialect.Call] = []

    def plan(self, node, names: frozenset[str], joined: bool = False) -> None:
        """``names``: what enclosing WITH clauses define. ``joined``: stands right of a join."""
        kind = _kind(node)
        if kind not in NODES:
            raise ValueError(f"only queries are accepted, not {kind}")
        if kind == "UnresolvedRelation":
            self.relation(_items(node.multipartIdentifier()), node, names)
        elif kind == "UnresolvedTableValuedFunction":
            self.table_function(node, joined)
        elif kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                name, body = pair._1().lower(), pair._2()
                self.plan(body, names | {name} if node.allowRecursion() else names)
                names |= {name}
        elif kind == "WithWindowDefinition":
            for definition in _items(node.windowDefinitions().values().toSeq()):
                self.expression(definition, names)
        for e in _items(node.expressions()) if kind != "LocalRelation" else []:  # constants, by now
            self.expression(e, names)
        children = _items(node.children())
        for i, child in enumerate(children):
            passed = joined and kind in ("SubqueryAlias", "UnresolvedTVFAliases", "UnresolvedSubqueryColumnAliases")
            self.plan(child, names, passed or (kind == "Join" and i == 1))
        if kind == "LateralJoin":
            self.expression(node.right(), names)

    def relation(self, parts: list[str], node, names: frozenset[str]) -> None:
        name = parts[0].lower()
        if len(parts) > 1 or node.isStreaming() or node.options().size():
            raise ValueError(f"no relation of this data set: {'.'.join(parts)}")
        if name in names:
            return
        if name not in self.relations:
            raise ValueError(f"no relation of this data set: {name}")
        if self.catalog.getTempView(name).isEmpty():
            raise ValueError(f"{name} is not available: a column it needs is not mapped")

    def table_function(self, node, joined: bool) -> None:
        parts = _items(node.name())
        name = parts[-1].lower()
        if len(parts) > 1 or name not in dialect.TABLE_NAMES:
            raise ValueError(f"no table function of the surface: {'.'.join(parts)}")
        self.note(name, node, _items(node.functionArgs()), inner=joined)

    def expression(self, e, names: frozenset[str]) -> None:
        kind = _kind(e)
        if kind not in EXPRESSIONS:
            raise ValueError(f"not part of a query here: {kind}")
        if kind == "UnresolvedFunction":
            parts = _items(e.nameParts())
            name = parts[-1].lower()
            if len(parts) > 1 or name not in dialect.NAMES:
                raise ValueError(f"no function of the surface: {'.'.join(parts)}")
            self.note(name, e, _items(e.arguments()), distinct=e.isDistinct())
        elif kind == "AggregateExpression":
            inner = e.aggregateFunction()
            if _kind(inner) in _PLAIN_CALLS:
                self.note(_PLAIN_CALLS[_kind(inner)], e, _items(inner.children()))
        elif kind == "UnresolvedGenerator":
            name = e.name().funcName().lower()
            if name not in dialect.TABLE_NAMES or e.name().database().isDefined():
                raise ValueError(f"no table function of the surface: {name}")
            if name == "unnest":
                raise ValueError("write LATERAL VIEW explode(...), or unnest(...) behind FROM")
        elif kind == "Literal" and e.origin().startIndex().isDefined():
            start, end = _extent(e)
            if self.text[start] == "'" and "\\" in self.text[start:end]:
                self.calls.append(dialect.Call("", start, end, []))
        elif kind == "UnresolvedAttribute":
            parts = _items(e.nameParts())
            if len(parts) == 1 and (parts[0].lower().startswith("current_") or parts[0].lower() in _SESSION_NAMES):
                raise ValueError(f"not part of a query here: {parts[0]}")
        elif kind in ("ListQuery", "ScalarSubquery", "Exists", "LateralSubquery"):
            self.plan(e.plan(), names)
        for child in _items(e.children()):
            self.expression(child, names)

    def note(self, name: str, e, arguments: list, distinct: bool = False, inner: bool = False) -> None:
        if (name, len(arguments)) not in dialect.MEANINGS and (name, -1) not in dialect.MEANINGS:
            return
        start, end = e.origin().startIndex().get(), e.origin().stopIndex().get() + 1
        spots = [_extent(a) for a in arguments]
        self.calls.append(dialect.Call(name, start, end, _arguments(self.text, start, spots), distinct, inner))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _extent(e) -> tuple[int, int]:
    """Where an expression begins and ends in the text; what it is made of may stand left of its own operator."""
    low, high = e.origin().startIndex().get(), e.origin().stopIndex().get() + 1
    for child in _items(e.children()):
        a, b = _extent(child)
        low, high = min(low, a), max(high, b)
    return low, high


def _arguments(text: str, start: int, spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From the end of one comma to the next: arguments with the brackets around them. ``spots``: where each is known to stand."""
    at = text.index("(", start) + 1
    if text[at:].lstrip()[:8].lower() == "distinct":
        at = text.lower().index("distinct", at) + 8
    out = []
    for i, (low, high) in enumerate(spots):
        open_ = text[at:low].count("(")
        end = high
        while open_ or text[end] not in ",)":
            open_ -= text[end] == ")"
            end += 1
        out.append((at, end))
        at = end + 1
    return out


def run(spark: SparkSession, text: str, parameters: Mapping[str, object] | None = None, rows: int = DEFAULT_ROWS) -> Result:
    """At most ``rows`` rows for display, whatever limit the text itself has."""
    start = time.perf_counter()
    df = query(spark, text, parameters).limit(rows)
    data = [tuple(r) for r in df.collect()]  # bounded by ``rows``
    return Result(df.columns, [t for _, t in df.dtypes], data, round((time.perf_counter() - start) * 1000, 2))


def session_over(rel: Relations) -> list[str]:
    """Register the relations and the function surface for ad-hoc use."""
    return rel.register() + dialect.register(rel.spark)
