"""A statement over one frame becomes one DataFrame plan; Catalyst does the rest."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.expressions import Expressions, Scope, Typed
from granary.sql.errors import SqlError
from granary.sql.parser import parse
from granary.sql.tree import Binary, Call, Item, Literal, Name, Node, Select, default_name, holds_aggregate, is_aggregate


_ANALYSIS = threading.Lock()


@contextmanager
def _wrapping(spark: SparkSession) -> Iterator[None]:
    """While plans are analysed, integers wrap at 64 bits: an operator keeps the mode that it was analysed in.

    The setting belongs to the session, so that one statement is analysed at a time; running them is not affected.
    """
    key = "spark.sql.ansi.enabled"
    with _ANALYSIS:
        before = spark.conf.get(key)
        spark.conf.set(key, "false")
        try:
            yield
        finally:
            spark.conf.set(key, before)


def plan(sql: str | Select, frame: DataFrame) -> DataFrame:
    """The statement's result. Its FROM name is not looked at: the caller says which frame it runs over."""
    with _wrapping(frame.sparkSession):
        return _plan(sql, frame)


def _plan(sql: str | Select, frame: DataFrame) -> DataFrame:
    s = parse(sql) if isinstance(sql, str) else sql
    scope = Scope(frame)
    items = [i for item in s.items for i in ([item] if item.expr is not None else [Item(Name(c), c) for c in frame.columns])]
    aliases: dict[str, Node] = {}
    for i in s.items:
        if i.expr is not None and i.alias is not None:
            aliases.setdefault(i.alias, i.expr)

    def resolved(n: Node) -> Node:
        """Aliases replaced by what they name; an alias wins over a column of its name."""
        return aliases[n.name] if isinstance(n, Name) and n.name in aliases else n.map(resolved)

    group, order = tuple(map(resolved, s.group)), [(resolved(o.expr), o.descending) for o in s.order]
    having = resolved(s.having) if s.having is not None else None
    if s.where is not None:
        frame = frame.where(Expressions(scope).predicate(s.where))
    # output names come from the items as written, values from the items with sums shared
    exprs = [_shared_sums(i.expr, scope) for i in items]
    having = _shared_sums(having, scope) if having is not None else None
    order = [(_shared_sums(n, scope), down) for n, down in order]
    if group or having is not None or any(map(holds_aggregate, [*exprs, *(n for n, _ in order)])):
        frame, build = _grouped(frame, scope, group, [*exprs, *([having] if having is not None else []), *(n for n, _ in order)])
    else:
        build = Expressions(scope)
    if having is not None:
        frame = frame.where(build.predicate(having))
    keys = [(build(n).column, down) for n, down in order if not isinstance(n, Literal)]
    if keys:
        frame = frame.orderBy(*(c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in keys))
    if s.offset:
        frame = frame.offset(s.offset)
    if s.limit is not None:
        frame = frame.limit(s.limit)
    return frame.select(*(build(e).column.alias(i.alias if i.alias is not None else default_name(i.expr)) for e, i in zip(exprs, items, strict=True)))


def _grouped(frame: DataFrame, scope: Scope, group: tuple[Node, ...], roots: list[Node]) -> tuple[DataFrame, Expressions]:
    """The aggregated frame, and expressions over its keys and aggregates.

    Keys that only derive from other keys (ClientIP - 1 beside ClientIP) are computed afterwards, so that they
    are neither hashed nor shuffled; constant keys do not group.
    """
    rows = Expressions(scope)
    for n in group:
        if holds_aggregate(n):
            raise SqlError(f"aggregate in GROUP BY: {default_name(n)}")
    varying = list(dict.fromkeys(n for n in group if not isinstance(n, Literal)))
    plain = {_canonical(n, scope) for n in varying if isinstance(n, Name)}
    base = [n for n in varying if isinstance(n, Name) or not _names(n, scope) or not _names(n, scope) <= plain]
    keys = {_canonical(n, scope): f"k{j}" for j, n in enumerate(base)}
    calls = list(dict.fromkeys(_canonical(c, scope) for r in roots for c in _aggregates(r)))
    names = {c: f"a{j}" for j, c in enumerate(calls)}
    typed = {c: _aggregate(c, rows) for c in calls}
    columns = [rows(n).column.alias(keys[_canonical(n, scope)]) for n in base]
    if group and not columns:
        columns = [F.lit(1).alias("k")]
    aggregates = [typed[c].column.alias(names[c]) for c in calls]
    if not columns:
        out = frame.agg(*aggregates)
    elif not aggregates:
        out = frame.select(*columns).distinct()
    else:
        out = frame.groupBy(*columns).agg(*aggregates)
    answers = {c: Typed(F.col(name), typed[c].kind, wide=typed[c].wide) for c, name in names.items()}
    for n in base:
        t = rows(n)
        answers[_canonical(n, scope)] = Typed(F.col(keys[_canonical(n, scope)]), t.kind, wide=t.wide)

    def special(n: Node) -> Typed | None:
        c = _canonical(n, scope)
        if c in answers:
            return answers[c]
        if isinstance(n, Name):
            raise SqlError(f"column {n.name!r} is neither grouped nor aggregated")
        return None

    return out, Expressions(scope, special)


def _canonical(n: Node, scope: Scope) -> Node:
    """The node with columns by their real names, so that letter case makes no difference."""
    return Name(scope.find(n.name).name) if isinstance(n, Name) else n.map(lambda x: _canonical(x, scope))


def _names(n: Node, scope: Scope) -> set[Node]:
    return {_canonical(n, scope)} if isinstance(n, Name) else set().union(*(_names(x, scope) for x in n.children()))


def _aggregates(n: Node) -> list[Call]:
    return [n] if is_aggregate(n) else [c for x in n.children() for c in _aggregates(x)]


def _aggregate(c: Call, rows: Expressions) -> Typed:
    if c.star:
        if c.name != "count":
            raise SqlError(f"{c.name}(*) is not supported")
        return Typed(F.count(F.lit(1)), "int", wide=True)
    if len(c.args) != 1:
        raise SqlError(f"{c.name} takes one argument")
    x = c.args[0]
    if holds_aggregate(x):
        raise SqlError(f"nested aggregate: {default_name(c)}")
    t = rows(x)
    if c.name == "count":
        return Typed(F.count_distinct(t.column) if c.distinct else F.count(t.column), "int", wide=True)
    if c.name in ("min", "max"):
        return Typed((F.min if c.name == "min" else F.max)(t.column), t.kind, wide=t.wide)
    rows.numeric(x)
    if c.name == "avg":
        return Typed(F.call_function("avg", t.column) if not c.distinct else _avg_distinct(t), "double")
    if c.distinct:
        return Typed(F.sum_distinct(t.as_number(t.kind)), t.kind, wide=t.kind == "int")
    return Typed(F.sum(t.as_number(t.kind)), t.kind, wide=t.kind == "int")


def _avg_distinct(t: Typed):
    total = F.sum_distinct(t.column.cast("double"))
    return total / F.nullif(F.count_distinct(t.column), F.lit(0))


def _shared_sums(n: Node, scope: Scope) -> Node:
    """sum(col + k) of integers as sum(col) + k * count(col): many such sums share two aggregates."""
    match n:
        case Call("sum", (Binary("PLUS" | "MINUS" as op, Name() as name, Literal("int", k)),), False) if scope.column(name.name).kind == "int":
            return Binary(op, Call("sum", (name,)), Binary("MUL", Literal("int", k), Call("count", (name,))))
        case Call("sum", (Binary("PLUS", Literal("int", k), Name() as name),), False) if scope.column(name.name).kind == "int":
            return Binary("PLUS", Call("sum", (name,)), Binary("MUL", Literal("int", k), Call("count", (name,))))
    return n.map(lambda x: _shared_sums(x, scope))
