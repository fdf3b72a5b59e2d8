"""Typed compilation of expression trees into Spark columns.

Every subexpression gets one static type. Operations that can't succeed for the types at hand are null (or false, for
comparisons) at planning time, so that nothing raises at run time; what may fail by value uses try_ functions.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import links
from .syntax import Node, SyntaxFault, parse

DAY = 86_400_000_000


class Untranslatable(ValueError):
    """The expression has no meaning here: bad syntax, an unknown function or method."""


@dataclass(frozen=True)
class Value:
    """A column with its type: null, bool, int, float, str, date, datetime, duration (microseconds), list, object, regex, file or props.

    item: of a list, the type of its elements as a Value without a column. fields: of an object, file or props, by name.
    const: the Python value of a literal.
    """

    col: Column | None
    kind: str
    item: Value | None = None
    fields: dict[str, Value] | None = None
    const: object = None

    def of(self, col: Column) -> Value:
        """The same type for another column."""
        return Value(col, self.kind, self.item, self.fields)


def _t(kind: str, item: Value | None = None, fields=None) -> Value:
    return Value(None, kind, item, fields)


def null() -> Value:
    return Value(F.lit(None), "null")


STR, INT, FLOAT, BOOL, DATE, DATETIME = (_t(k) for k in ("str", "int", "float", "bool", "date", "datetime"))
SPARK = {"bool": "boolean", "int": "bigint", "float": "double", "str": "string", "date": "date", "datetime": "timestamp_ntz", "duration": "bigint", "null": "string"}


def spark_type(v: Value) -> str:
    if v.kind == "list":
        return f"array<{spark_type(v.item or STR)}>"
    if v.kind in ("object", "file", "props"):
        return "struct<" + ",".join(f"`{n}`:{spark_type(x)}" for n, x in (v.fields or {}).items()) + ">"
    return SPARK[v.kind]


@dataclass
class Env:
    """What an expression sees: the row's fields, the file namespace, the frozen clock.

    resolve: gives the file (a Value of kind file) that a link text names, in this row; None if nothing was joined.
    """

    fields: dict[str, Value]
    file: dict[str, Value] = field(default_factory=dict)
    this: dict[str, Value] = field(default_factory=dict)
    now: datetime.datetime = datetime.datetime(1970, 1, 1)
    resolve: object = None
    scope: dict[str, Value] = field(default_factory=dict)

    def within(self, **names: Value) -> Env:
        return Env(self.fields, self.file, self.this, self.now, self.resolve, {**self.scope, **names})


# -- conversions -----------------------------------------------------------------------------------------------


def truthy(v: Value) -> Column:
    """Two-valued: null, 0, "", [] and {} are false."""
    c = v.col
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return F.coalesce(c, F.lit(False))
    if v.kind in ("int", "float", "duration"):
        return F.coalesce(c != 0, F.lit(False))
    if v.kind == "str":
        return F.coalesce(c != "", F.lit(False))
    if v.kind == "list":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if v.kind in ("object", "props"):
        return c.isNotNull() & F.lit(bool(v.fields))
    return F.lit(True) if v.kind == "regex" else c.isNotNull()


def number(v: Value) -> Value | None:
    if v.kind == "bool":
        return INT.of(v.col.cast("bigint"))
    return v if v.kind in ("int", "float") else None


def text(v: Value) -> Column:
    """As Python's str(): True, 1.0, 2021-03-01 10:00:00; null stays null."""
    c = v.col
    if v.kind == "bool":
        return F.when(c, "True").when(~c, "False")
    if v.kind == "float":
        plain = c.cast("string")
        wide = (F.abs(c) >= 1e7) & (F.abs(c) < 1e16)
        whole = F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))
        small = (F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4)
        mantissa, power = F.regexp_extract(plain, r"^(-?[0-9.]+)E(-?[0-9]+)$", 1), F.regexp_extract(plain, r"E(-?[0-9]+)$", 1)
        signed = F.when(power.startswith("-"), F.concat(F.lit("-"), F.lpad(F.substring(power, 2, 9), 2, "0"))).otherwise(F.concat(F.lit("+"), F.lpad(power, 2, "0")))
        exp = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), signed)
        digits = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
        return F.when(wide & (c == F.floor(c)), whole).when(wide | small, digits).when(plain.contains("E"), exp).otherwise(F.when(c.isNotNull(), plain))
    if v.kind == "list":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _repr(v.item.of(x))), ", ", "None"), F.lit("]"))
    if v.kind == "file":
        return c["path"]
    if v.kind in ("object", "props"):
        return F.to_json(c)
    if v.kind == "duration":
        return F.concat(F.floor(c / 1_000_000).cast("string"), F.lit("s"))
    return c.cast("string")


def _repr(v: Value) -> Column:
    return F.concat(F.lit("'"), v.col, F.lit("'")) if v.kind == "str" else text(v)


def unify(a: Value, b: Value) -> tuple[Value, Column, Column]:
    """A type for either of two values and both as columns of it; text if nothing else fits."""
    if a.kind == b.kind == "list":
        item, _, _ = unify(a.item.of(F.lit(None)), b.item.of(F.lit(None)))
        t = _t("list", _t(item.kind, item.item, item.fields))
        return t, a.col.cast(spark_type(t)), b.col.cast(spark_type(t))
    if a.kind == b.kind and a.fields == b.fields:
        return a, a.col, b.col
    if a.kind == "null":
        return b, F.lit(None).cast(spark_type(b)), b.col
    if b.kind == "null":
        return a, a.col, F.lit(None).cast(spark_type(a))
    if {a.kind, b.kind} <= {"int", "float"}:
        return FLOAT, a.col.cast("double"), b.col.cast("double")
    return STR, text(a), text(b)


def as_list(v: Value) -> Value:
    """A list as it is, null as the empty list, anything else as a list of one."""
    if v.kind == "list":
        return v.of(F.coalesce(v.col, F.array().cast(spark_type(v))))
    if v.kind == "null":
        return Value(F.array().cast("array<string>"), "list", STR)
    return Value(F.when(v.col.isNull(), F.array().cast(f"array<{spark_type(v)}>")).otherwise(F.array(v.col)), "list", v.of(None))


def choose(condition: Column, a: Value, b: Value) -> Value:
    t, x, y = unify(a, b)
    return t.of(F.when(condition, x).otherwise(y))


# -- operators -------------------------------------------------------------------------------------------------


def duration_of(v: Value) -> Value | None:
    """A duration, from one or from text like 3h 30m."""
    if v.kind == "duration":
        return v
    return Value(durations(v), "duration") if v.kind == "str" else None


#: Fixed value: the tokens of a duration; years of 365 and months of 30 days.
UNITS = r"(\d+)\s*(y(?:ears?)?|M|months?|w(?:eeks?)?|d(?:ays?)?|h(?:ours?)?|m(?:inutes?)?|s(?:econds?)?)"
_SECONDS = {"y": 31_536_000, "M": 2_592_000, "w": 604_800, "d": 86_400, "h": 3_600, "m": 60, "s": 1}


def durations(v: Value) -> Column:
    """Microseconds of all tokens in a text; null if there are none."""
    if isinstance(v.const, str):
        found = re.findall(UNITS, v.const)
        total = sum(int(n) * _SECONDS["M" if u.startswith("month") else u[0]] for n, u in found)
        return F.lit(total * 1_000_000 if found else None).cast("bigint")
    numbers, units = F.regexp_extract_all(v.col, F.lit(UNITS), 1), F.regexp_extract_all(v.col, F.lit(UNITS), 2)
    scale = lambda u: F.when(u.startswith("month"), _SECONDS["M"]).otherwise(F.element_at(F.create_map(*[F.lit(x) for p in _SECONDS.items() for x in p]), F.substring(u, 1, 1)))
    seconds = F.zip_with(numbers, units, lambda n, u: n.try_cast("bigint") * scale(u))
    return F.when(F.size(numbers) > 0, F.aggregate(seconds, F.lit(0).cast("bigint"), lambda a, x: a + x) * 1_000_000)


def _shift(a: Value, d: Value, sign: int) -> Value:
    if a.kind == "date":
        return DATE.of(F.date_add(a.col, (F.floor(F.lit(sign) * d.col / DAY)).try_cast("int")))
    return DATETIME.of(a.col + F.make_dt_interval(secs=(F.lit(sign) * d.col / 1_000_000).cast("decimal(18,6)")))


def add(a: Value, b: Value) -> Value:
    if a.kind == b.kind == "str":
        return STR.of(F.concat(a.col, b.col))
    x, y = number(a), number(b)
    if x and y:
        return _arith(x, y, lambda p, q: p + q, F.try_add)
    if a.kind == b.kind == "list":
        t, p, q = unify(a, b)
        return t.of(F.concat(p, q))
    for p, q in ((a, b), (b, a)):
        if p.kind in ("date", "datetime") and (d := duration_of(q)):
            return _shift(p, d, 1)
    if a.kind == b.kind == "duration":
        return Value(a.col + b.col, "duration")
    return null()


def micros(v: Value) -> Column:
    """Microseconds of a date or date-time since 1970 by its own clock, whatever the session's time zone."""
    days = F.unix_date(v.col.cast("date")).cast("bigint") * DAY
    if v.kind == "date":
        return days
    second = (F.date_part(F.lit("SECOND"), v.col).cast("decimal(8,6)") * 1_000_000).cast("bigint")
    return days + (F.hour(v.col) * 3_600 + F.minute(v.col) * 60).cast("bigint") * 1_000_000 + second


def subtract(a: Value, b: Value) -> Value:
    x, y = number(a), number(b)
    if x and y:
        return _arith(x, y, lambda p, q: p - q, F.try_subtract)
    if a.kind == b.kind and a.kind in ("date", "datetime"):
        return FLOAT.of((micros(a) - micros(b)) / 1000)
    if a.kind in ("date", "datetime") and (d := duration_of(b)):
        return _shift(a, d, -1)
    if a.kind == b.kind == "duration":
        return Value(a.col - b.col, "duration")
    return null()


def _arith(x: Value, y: Value, plain, tried) -> Value:
    if x.kind == y.kind == "int":
        return INT.of(tried(x.col, y.col))
    return FLOAT.of(plain(x.col.cast("double"), y.col.cast("double")))


def multiply(a: Value, b: Value) -> Value:
    x, y = number(a), number(b)
    if x and y:
        return _arith(x, y, lambda p, q: p * q, F.try_multiply)
    for p, q in ((a, y), (b, x)):
        if p.kind == "str" and q and q.kind == "int":
            return STR.of(F.repeat(p.col, q.col.try_cast("int")))
    return null()


def divide(a: Value, b: Value) -> Value:
    x, y = number(a), number(b)
    return FLOAT.of(F.try_divide(x.col.cast("double"), y.col.cast("double"))) if x and y else null()


def modulo(a: Value, b: Value) -> Value:
    """Takes the sign of the divisor; null for 0."""
    x, y = number(a), number(b)
    if not (x and y):
        return null()
    kind = INT if x.kind == y.kind == "int" else FLOAT
    p, q = (v.col.cast(spark_type(kind)) for v in (x, y))
    safe = F.nullif(q, F.lit(0).cast(spark_type(kind)))
    return kind.of(((p % safe) + safe) % safe)


def compare(op: str, a: Value, b: Value) -> Value:
    x, y = number(a), number(b)
    alike = (x and y) or a.kind == b.kind or "null" in (a.kind, b.kind)
    if x and y:
        p, q = (x.col, y.col) if x.kind == y.kind else (x.col.cast("double"), y.col.cast("double"))
    elif a.kind == b.kind and a.kind != "null":
        _, p, q = unify(a, b)
    else:
        p = q = None
    if op in ("==", "!="):
        if p is not None:
            same = p.eqNullSafe(q)
        else:
            same = a.col.isNull() & b.col.isNull() if alike or "null" not in (a.kind, b.kind) else F.lit(False)
        return BOOL.of(same if op == "==" else ~same)
    if p is None or a.kind in ("file", "object", "props"):
        return BOOL.of(F.lit(False))
    result = {"<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]
    return BOOL.of(F.coalesce(result, F.lit(False)))


ARITHMETIC = {"+": add, "-": subtract, "*": multiply, "/": divide, "%": modulo}


# -- members ---------------------------------------------------------------------------------------------------

#: Parts of dates and durations that can be read by a dot.
PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def dot(v: Value, name: str) -> Value:
    c = v.col
    if name == "length" and v.kind in ("str", "list"):
        return INT.of(F.when(c.isNotNull(), F.char_length(c) if v.kind == "str" else F.size(c)).cast("bigint"))
    if name == "millisecond" and v.kind == "datetime":
        return INT.of(F.floor(F.date_part(F.lit("SECOND"), c).cast("decimal(12,6)") * 1000 % 1000).cast("bigint"))
    if name in PARTS and (v.kind == "datetime" or v.kind == "date" and name in ("year", "month", "day")):
        return INT.of(PARTS[name](c).cast("bigint"))
    if v.kind == "duration" and name == "days":
        return INT.of(F.floor(c / DAY).cast("bigint"))
    if v.kind == "duration" and name == "seconds":
        return INT.of(F.floor((c - F.floor(c / DAY) * DAY) / 1_000_000).cast("bigint"))
    if v.kind in ("object", "file", "props"):
        own = v.fields or {}
        if name == "basename":
            name = "name"
        if v.kind == "file" and name == "file":
            return v
        if v.kind == "file" and name not in own and name in (own["properties"].fields or {} if "properties" in own else {}):
            v, own = own["properties"].of(c["properties"]), own["properties"].fields or {}
            c = v.col
        if name in own:
            return own[name].of(c[name])
    return null()


def index(v: Value, i: Value) -> Value:
    """Counts from 0, from the end if negative; null out of range. Text in an object or namespace is a key."""
    if isinstance(i.const, str) and v.kind in ("object", "file", "props"):
        return dot(v, i.const)
    n = number(i)
    if not n:
        return null()
    at = n.col.try_cast("bigint").try_cast("int")
    at = F.when(at < 0, at).otherwise(at + 1)
    if v.kind == "list":
        return v.item.of(F.try_element_at(v.col, at))
    if v.kind == "str":
        size = F.char_length(v.col)
        return STR.of(F.when((at <= size) & (at >= -size), F.substring(v.col, at, F.lit(1))))
    return null()


# -- the walk --------------------------------------------------------------------------------------------------


class Compiler:
    def __init__(self, env: Env) -> None:
        self.env = env

    def visit(self, n: Node) -> Value:
        return getattr(self, f"_{n.kind}")(n)

    def _number(self, n: Node) -> Value:
        return Value(F.lit(n.value).cast("bigint" if isinstance(n.value, int) else "double"), "int" if isinstance(n.value, int) else "float", const=n.value)

    def _string(self, n: Node) -> Value:
        return Value(F.lit(n.value), "str", const=n.value)

    def _bool(self, n: Node) -> Value:
        return Value(F.lit(n.value), "bool", const=n.value)

    def _regex(self, n: Node) -> Value:
        try:
            re.compile(n.value)
        except re.error as e:
            raise Untranslatable(f"bad pattern /{n.value}/: {e}") from None
        return Value(F.lit(n.value), "regex", const=n.value)

    def _list(self, n: Node) -> Value:
        items = [self.visit(x) for x in n.items]
        if not items:
            return Value(F.array().cast("array<string>"), "list", STR)
        t = items[0]
        for x in items[1:]:
            t, _, _ = unify(t.of(F.lit(None)), x)
        cols = [x.col.cast(spark_type(t)) if x.kind in ("null", t.kind) or {x.kind, t.kind} <= {"int", "float"} else text(x) for x in items]
        return Value(F.array(*cols), "list", _t(t.kind, t.item, t.fields))

    def _object(self, n: Node) -> Value:
        pairs = {k: self.visit(x) for k, x in n.items}
        if not pairs:
            return Value(F.struct(F.lit(None).alias("_")), "object", fields={})
        return Value(F.struct(*[x.col.cast(spark_type(x)).alias(k) for k, x in pairs.items()]), "object", fields={k: x.of(None) for k, x in pairs.items()})

    def _name(self, n: Node) -> Value:
        e, name = self.env, n.value
        if name == "file":
            return self.file()
        if name in e.scope:
            return e.scope[name]
        if name in ("note", "formula"):
            return Value(None, "namespace", fields=e.fields)
        if name == "this":
            return Value(None, "namespace", fields={"file": Value(None, "namespace", fields=e.this)})
        return e.fields.get(name, null())

    def file(self) -> Value:
        return Value(None, "namespace", fields=self.env.file)

    def _member(self, v: Value, name: str) -> Value:
        if v.kind == "namespace":
            own = v.fields or {}
            if v is not None and own is self.env.file and name in ("basename", "file"):
                return own["name"] if name == "basename" else v
            if own is self.env.file and name == "properties":
                return Value(None, "namespace", fields=self.env.fields)
            return own.get(name, null())
        return dot(v, name)

    def _dot(self, n: Node) -> Value:
        return self._member(self.visit(n.items[0]), n.value)

    def _index(self, n: Node) -> Value:
        v, i = self.visit(n.items[0]), self.visit(n.items[1])
        if v.kind == "namespace":
            return self._member(v, i.const) if isinstance(i.const, str) else null()
        return index(v, i)

    def _unary(self, n: Node) -> Value:
        v = self.visit(n.items[0])
        if n.value == "!":
            return BOOL.of(~truthy(v))
        x = number(v)
        if x:
            return Value(-x.col, x.kind, const=-v.const if v.const is not None else None)
        return Value(-v.col, "duration") if v.kind == "duration" else null()

    def _binary(self, n: Node) -> Value:
        a, b = self.visit(n.items[0]), self.visit(n.items[1])
        if n.value in ARITHMETIC:
            return ARITHMETIC[n.value](a, b)
        if n.value == "||":
            return choose(truthy(a), a, b)
        if n.value == "&&":
            return choose(truthy(a), b, a)
        return compare(n.value, a, b)

    def _call(self, n: Node) -> Value:
        from .library import GLOBALS

        if n.value == "if":
            arms = [*n.items, None, None, None]
            c, a, b = (self.visit(x) if x is not None else null() for x in arms[:3])
            return choose(truthy(c), a, b)
        if n.value not in GLOBALS:
            raise Untranslatable(f"unknown function {n.value}()")
        return GLOBALS[n.value](self, *[self.visit(x) for x in n.items])

    def _method(self, n: Node) -> Value:
        from .library import FILE_METHODS, METHODS

        v, name, args = self.visit(n.items[0]), n.value, n.items[1:]
        if name in ("filter", "map", "reduce"):
            return getattr(self, name)(as_list(v), args)
        if v.kind in ("namespace", "file"):
            if name not in FILE_METHODS:
                raise Untranslatable(f"unknown method {name}() of a file")
            return FILE_METHODS[name](self, v, *[self.visit(x) for x in args])
        if name not in METHODS:
            raise Untranslatable(f"unknown method {name}()")
        return METHODS[name](self, v, *[self.visit(x) for x in args])

    def filter(self, v: Value, args) -> Value:
        if not args:
            return v
        return v.of(F.filter(v.col, lambda x, i: truthy(Compiler(self.env.within(value=v.item.of(x), index=INT.of(i.cast("bigint")))).visit(args[0]))))

    def _probe(self, item: Value, extra: dict[str, Value], arg: Node) -> Value:
        """The type of a lambda's body."""
        t = item.of(F.lit(None).cast(spark_type(item)))
        return Compiler(self.env.within(value=t, index=INT.of(F.lit(0).cast("bigint")), **extra)).visit(arg)

    def map(self, v: Value, args) -> Value:
        if not args:
            return v
        body = lambda x, i: Compiler(self.env.within(value=v.item.of(x), index=INT.of(i.cast("bigint")))).visit(args[0])
        t = self._probe(v.item, {}, args[0])
        if t.kind == "namespace":
            raise Untranslatable("a namespace is no value")
        if t.kind == "list":
            empty = F.array().cast(spark_type(t))
            return t.of(F.flatten(F.transform(v.col, lambda x, i: F.coalesce(body(x, i).col, empty))))
        return Value(F.transform(v.col, lambda x, i: body(x, i).col.cast(spark_type(t))), "list", _t(t.kind, t.item, t.fields))

    def reduce(self, v: Value, args) -> Value:
        if not args:
            return null()
        start = self.visit(args[1]) if len(args) > 1 else null()
        t = self._probe(v.item, {"acc": start}, args[0])
        t, first, _ = unify(t.of(F.lit(None).cast(spark_type(t))), start)
        first = start.col.cast(spark_type(t))
        pairs = F.transform(v.col, lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i")))

        def step(acc, p):
            r = Compiler(self.env.within(acc=t.of(acc), value=v.item.of(p["x"]), index=INT.of(p["i"]))).visit(args[0])
            return r.col.cast(spark_type(t))

        return t.of(F.aggregate(pairs, first, step))


def translate(expression: str, env: Env) -> Value:
    """The typed column of an expression; Untranslatable if it has none."""
    try:
        v = Compiler(env).visit(parse(expression))
    except SyntaxFault as e:
        raise Untranslatable(str(e)) from None
    if v.kind == "namespace":
        raise Untranslatable(f"{expression!r} is a namespace, no value")
    if v.kind == "file":
        return STR.of(F.when(v.col.isNotNull(), links.as_link(v.col["folder"], v.col["name"])))
    if v.kind == "list" and v.item.kind == "file":
        return Value(F.transform(v.col, lambda f: F.when(f.isNotNull(), links.as_link(f["folder"], f["name"]))), "list", STR)
    return v

