"""Typed expressions: a syntax tree over a frame's columns becomes a Column and a kind.

Kinds are int, double, string, bool, time and other; int covers all integer columns, which widen to 64
bits before arithmetic. There is no coercion between texts and numbers: that is an error here rather than
a surprise at run time. A time column stands for its ISO text, and is compared with a constant text as a
time, so that the comparison still reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import dialect
from granary.sql.errors import SqlError
from granary.sql.tree import Binary, Call, Case, InList, IsNull, Like, Literal, Name, Node, Unary, default_name, is_aggregate

COMPARE = {"EQ": lambda a, b: a == b, "NEQ": lambda a, b: a != b, "LT": lambda a, b: a < b, "LE": lambda a, b: a <= b, "GT": lambda a, b: a > b, "GE": lambda a, b: a >= b}
ARITHMETIC = {"PLUS": lambda a, b: a + b, "MINUS": lambda a, b: a - b, "MUL": lambda a, b: a * b}


@dataclass(frozen=True)
class Typed:
    """wide: an int that is 64 bits already."""

    column: Column
    kind: str
    literal: Literal | None = None
    wide: bool = False

    def as_number(self, kind: str) -> Column:
        """The column as 64-bit integers (kind int) or doubles."""
        if kind == "int":
            return self.column if self.wide else dialect.long(self.column)
        return self.column.cast("double")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "double"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "other"


class Scope:
    """Columns of a frame by name: exact case first, then any case."""

    def __init__(self, frame: DataFrame):
        self.fields = {}
        for f in frame.schema.fields:
            self.fields.setdefault(f.name, f)
        self.by_lower = {}
        for f in self.fields.values():
            self.by_lower.setdefault(f.name.lower(), f)

    def find(self, name: str) -> T.StructField:
        f = self.fields.get(name) or self.by_lower.get(name.lower())
        if f is None:
            raise SqlError(f"unknown column {name!r}")
        return f

    def column(self, name: str) -> Typed:
        f = self.find(name)
        c, kind = F.col("`" + f.name.replace("`", "``") + "`"), kind_of(f.dataType)
        return Typed(c.cast("double") if isinstance(f.dataType, T.DecimalType) else c, kind, wide=isinstance(f.dataType, T.LongType))


class Expressions:
    """Turns trees into Columns. `special` may answer for a node first, as grouping does for keys and aggregates."""

    def __init__(self, scope: Scope, special: Callable[[Node], Typed | None] = lambda n: None):
        self.scope, self.special = scope, special

    def __call__(self, n: Node) -> Typed:
        found = self.special(n)
        return found if found is not None else self.build(n)

    def predicate(self, n: Node) -> Column:
        t = self(n)
        if t.kind != "bool" and not (t.literal and t.literal.kind == "null"):
            raise SqlError(f"a condition expected: {default_name(n)}")
        return t.column.cast("boolean")

    def build(self, n: Node) -> Typed:
        match n:
            case Literal("null", _):
                return Typed(F.lit(None).cast("bigint"), "int", n)
            case Literal("int", v):
                return Typed(F.lit(v).cast("bigint"), "int", n, wide=True)
            case Literal(kind, v):
                return Typed(F.lit(v), kind, n)
            case Name(name):
                return self.scope.column(name)
            case Unary("NEG", x):
                t = self.numeric(x)
                return Typed(-t.as_number(t.kind), t.kind, wide=t.kind == "int")
            case Unary("NOT", x):
                return Typed(~self.predicate(x), "bool")
            case Binary("AND", a, b):
                return Typed(self.predicate(a) & self.predicate(b), "bool")
            case Binary("OR", a, b):
                return Typed(self.predicate(a) | self.predicate(b), "bool")
            case Binary(op, a, b) if op in COMPARE:
                left, right = self.comparable(a, b)
                return Typed(COMPARE[op](left, right), "bool")
            case Binary(op, a, b):
                return self.arithmetic(op, self.numeric(a), self.numeric(b))
            case IsNull(x, negated):
                c = self(x).column
                return Typed(c.isNotNull() if negated else c.isNull(), "bool")
            case Like(value, pattern, negated):
                c = dialect.like(self.text(value), pattern.value if isinstance(pattern, Literal) and pattern.kind == "string" else self.text(pattern))
                return Typed(~c if negated else c, "bool")
            case InList(value, items, negated):
                pairs = [self.comparable(value, i) for i in items]
                c = pairs[0][0] == pairs[0][1]
                if all(isinstance(i, Literal) for i in items):
                    c = pairs[0][0].isin(*(b for _, b in pairs))
                else:
                    for a, b in pairs[1:]:
                        c = c | (a == b)
                return Typed(~c if negated else c, "bool")
            case Case(whens, otherwise):
                return self.case(whens, otherwise)
            case Call():
                return self.call(n)
        raise SqlError(f"unsupported: {default_name(n)}")

    def numeric(self, n: Node) -> Typed:
        t = self(n)
        if t.kind not in ("int", "double"):
            raise SqlError(f"a number expected: {default_name(n)}")
        return t

    def text(self, n: Node) -> Column:
        t = self(n)
        if t.kind == "time":
            return dialect.time_text(t.column)
        if t.kind != "string" and not (t.literal and t.literal.kind == "null"):
            raise SqlError(f"a text expected: {default_name(n)}")
        return t.column.cast("string")

    def comparable(self, a: Node, b: Node) -> tuple[Column, Column]:
        s, t = self(a), self(b)
        kinds = {s.kind, t.kind}
        if any(x.literal and x.literal.kind == "null" for x in (s, t)) or kinds in ({"int"}, {"double"}, {"int", "double"}):
            # integer constants stay as narrow as they fit, so that the scan gets the comparison
            narrow = lambda x: F.lit(x.literal.value) if x.literal and x.literal.kind == "int" else x.column
            null = lambda x, y: F.lit(None).cast({"string": "string", "bool": "boolean", "time": "timestamp_ntz"}.get(y.kind, "bigint")) if x.literal and x.literal.kind == "null" else narrow(x)
            return null(s, t), null(t, s)
        if kinds in ({"string"}, {"bool"}, {"time"}):
            return s.column, t.column
        if kinds == {"time", "string"}:
            as_time = lambda x: x.column if x.kind == "time" else x.column.try_cast("timestamp_ntz") if x.literal else None
            if as_time(s) is not None and as_time(t) is not None:
                return as_time(s), as_time(t)
            return self.text(a), self.text(b)
        raise SqlError(f"cannot compare {default_name(a)} ({s.kind}) with {default_name(b)} ({t.kind})")

    @staticmethod
    def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
        kind = "int" if a.kind == b.kind == "int" else "double"
        wide = kind == "int"
        if op == "DIV":
            return Typed((dialect.int_divide if wide else dialect.divide)(a.column, b.column), kind, wide=wide)
        if op == "MOD":
            return Typed(dialect.remainder(a.column, b.column, "bigint" if wide else "double"), kind, wide=wide)
        return Typed(ARITHMETIC[op](a.as_number(kind), b.as_number(kind)), kind, wide=wide)

    def case(self, whens: tuple, otherwise: Node | None) -> Typed:
        tests = [self.predicate(t) for t, _ in whens]
        values = [self(v) for _, v in whens] + ([self(otherwise)] if otherwise is not None else [])
        kinds = {v.kind for v in values if not (v.literal and v.literal.kind == "null")} or {"int"}
        if kinds <= {"int", "double"}:
            kind = "double" if "double" in kinds else "int"
            to = "double" if kind == "double" else "bigint"
        elif len(kinds) == 1:
            kind = next(iter(kinds))
            to = {"string": "string", "bool": "boolean", "time": "timestamp_ntz"}.get(kind)
        else:
            kind = to = "string"
        columns = [v.column.cast(to) if to else v.column for v in values]
        out = F.when(tests[0], columns[0])
        for t, c in zip(tests[1:], columns[1 : len(tests)], strict=True):
            out = out.when(t, c)
        return Typed(out.otherwise(columns[-1]) if otherwise is not None else out, kind)

    def call(self, n: Call) -> Typed:
        if is_aggregate(n):
            raise SqlError(f"{default_name(n)} is not allowed here")
        if n.distinct or n.star:
            raise SqlError(f"DISTINCT and * belong to aggregates, not to {n.name}")
        counts = {"strlen": 1, "length": 1, "extract": 2, "date_trunc": 2, "regexp_replace": 3}
        if n.name not in counts:
            raise SqlError(f"unsupported function {n.name}")
        if len(n.args) != counts[n.name]:
            raise SqlError(f"{n.name} takes {counts[n.name]} arguments")
        if n.name in ("strlen", "length"):
            return Typed(dialect.long(F.length(self.text(n.args[0]))), "int")
        if n.name == "regexp_replace":
            value, pattern, replacement = n.args
            plain = replacement.value if isinstance(replacement, Literal) and replacement.kind == "string" else self.text(replacement)
            return Typed(dialect.regexp_replace(self.text(value), self.text(pattern), plain), "string")
        what, value = n.args
        if not (isinstance(what, Literal) and what.kind == "string"):
            raise SqlError(f"{n.name} takes a constant as its first argument")
        field = str(what.value).lower()
        if field not in (dialect.FIELDS if n.name == "extract" else dialect.PRECISIONS):
            raise SqlError(f"unknown field {field!r}")
        t = self(value)
        if n.name == "extract":
            return Typed(dialect.extract_time(field, t.column) if t.kind == "time" else dialect.extract_text(field, self.text(value)), "int")
        return Typed(dialect.trunc_time(field, t.column) if t.kind == "time" else dialect.trunc_text(field, self.text(value)), "string")
