"""Methods and global functions: each takes the compiler, the receiver and typed arguments and gives a typed column."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import links
from ...functions.python_text import exact_round, fixed, title
from .compiler import BOOL, DATE, DATETIME, FLOAT, INT, STR, Value, add, as_list, durations, micros, null, number, spark_type, text, truthy, unify

SPACE = r"[\s\x1c-\x1f\x85]"


def _str(v: Value) -> Column:
    return v.col if v.kind == "str" else text(v)


def _literal(v: Value | None, default=None):
    return default if v is None or v.const is None else v.const


# -- text ------------------------------------------------------------------------------------------------------


def contains(c, v: Value, x: Value | None = None) -> Value:
    """Of text: a part; of a list: an item. A link is compared by the record it names."""
    if x is None:
        return null()
    if v.kind == "list":
        if v.item.kind == "str" and x.kind == "str":
            name = links.link_name(x.col)
            by_name = F.exists(F.transform(v.col, links.link_name), lambda n: F.coalesce(n == name, F.lit(False)))
            return BOOL.of(F.when(v.col.isNotNull(), F.when(links.is_link(x.col), by_name).otherwise(F.coalesce(F.array_contains(v.col, x.col), F.lit(False)))))
        a, b = number(v.item.of(F.lit(None))), number(x)
        if a and b or v.item.kind == x.kind:
            wide = "array<double>" if a and "float" in (v.item.kind, x.kind) else spark_type(v)
            return BOOL.of(F.when(v.col.isNotNull(), F.exists(v.col.cast(wide), lambda i: i.eqNullSafe(x.col.cast(wide[6:-1])))))
        return BOOL.of(F.when(v.col.isNotNull(), F.lit(False)))
    if v.kind == "str" and x.kind == "str":
        same = links.link_name(v.col) == links.link_name(x.col)
        return BOOL.of(F.when(links.is_link(x.col) & links.is_link(v.col), same).otherwise(F.contains(v.col, x.col)))
    return null()


def replace(c, v: Value, a: Value | None = None, b: Value | None = None) -> Value:
    if v.kind != "str" or a is None:
        return null()
    to = _str(b) if b is not None else F.lit("")
    if a.kind == "regex":
        if b is not None and b.const is not None:
            to = F.lit(re.sub(r"\\(\d)", r"$\1", str(b.const).replace("$", "\\$")))
        return STR.of(F.regexp_replace(v.col, F.lit("(?U)" + a.const), to))
    return STR.of(F.replace(v.col, _str(a), to))


def split(c, v: Value, sep: Value | None = None, n: Value | None = None) -> Value:
    """At each place of the separator, or runs of white space without one; n is the most splits."""
    t = Value(None, "list", STR)
    if v.kind != "str":
        return as_list(v)
    limit = int(_literal(n, -1))
    items = limit + 1 if limit >= 0 else -1
    if sep is None or sep.kind == "null":
        trimmed = F.regexp_replace(v.col, f"(?U)^{SPACE}+|{SPACE}+$", "")
        return t.of(F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"(?U){SPACE}+", items)))
    if isinstance(sep.const, str):
        return t.of(F.split(v.col, re.sub(r"([^\w\s])", r"\\\1", sep.const), items)) if sep.const else null()
    return t.of(F.split(v.col, F.concat(F.lit("\\Q"), sep.col, F.lit("\\E")), items))


def cut(c, v: Value, start: Value | None = None, stop: Value | None = None) -> Value:
    """From start up to stop, both counted from the end if negative."""
    if v.kind not in ("str", "list"):
        return null()
    size = F.char_length(v.col) if v.kind == "str" else F.size(v.col)
    bound = lambda x, default: default if x is None or x.kind == "null" else F.greatest(F.lit(0), F.least(size, F.when(x.col < 0, x.col + size).otherwise(x.col))).try_cast("int")
    a, b = bound(start, F.lit(0)), bound(stop, size)
    length = F.greatest(b - a, F.lit(0))
    return v.of(F.substring(v.col, a + 1, length) if v.kind == "str" else F.slice(v.col, a + 1, length))


def _of_text(f):
    return lambda c, v, *_: STR.of(f(v.col)) if v.kind == "str" else null()


def _affix(method: str):
    return lambda c, v, x=None: BOOL.of(getattr(v.col, method)(x.col)) if v.kind == "str" and x is not None and x.kind == "str" else null()


def strip(side: str):
    pattern = {"l": f"(?U)^{SPACE}+", "r": f"(?U){SPACE}+$", "b": f"(?U)^{SPACE}+|{SPACE}+$"}[side]
    return _of_text(lambda x: F.regexp_replace(x, pattern, ""))


def zfill(c, v: Value, n: Value | None = None) -> Value:
    if v.kind != "str" or n is None:
        return null()
    sign = F.regexp_extract(v.col, "^[+-]", 0)
    body = F.substring(v.col, F.char_length(sign) + 1, F.char_length(v.col))
    width = (n.col.try_cast("int") - F.char_length(v.col))
    return STR.of(F.concat(sign, F.repeat(F.lit("0"), F.greatest(width, F.lit(0))), body))


# -- numbers ---------------------------------------------------------------------------------------------------


def _of_number(f, kind=None):
    def method(c, v: Value, *_) -> Value:
        x = number(v)
        return (kind or x).of(f(x.col)) if x else null()

    return method


def rounded(c, v: Value, n: Value | None = None) -> Value:
    """Half to even on the exact value; without n to an integer."""
    x = number(v)
    if not x:
        return null()
    if n is None or n.kind == "null":
        return INT.of(x.col if x.kind == "int" else F.bround(x.col).try_cast("bigint"))
    digits = int(_literal(n, 0))
    if x.kind == "int":
        return x if digits >= 0 else INT.of(F.bround(x.col, digits))
    return FLOAT.of(exact_round(x.col, digits))


def to_fixed(c, v: Value, n: Value | None = None) -> Value:
    x = number(v)
    if not x:
        return null()
    return STR.of(text(x) if n is None or n.kind == "null" else fixed(x.col.cast("double"), int(_literal(n, 0))))


# -- lists, objects, anything ----------------------------------------------------------------------------------


def sort(c, v: Value, *_) -> Value:
    """Ascending; a null inside can't be ordered and makes the result null."""
    if v.kind != "list" or v.item.kind in ("list", "object", "file"):
        return null()
    return v.of(F.when(~F.exists(v.col, lambda x: x.isNull()), F.array_sort(v.col)))


def unique(c, v: Value, *_) -> Value:
    if v.kind != "list" or v.item.kind in ("list", "object"):
        return null()
    if v.item.kind == "file":
        return v.of(F.array_distinct(v.col))
    return v.of(F.array_distinct(v.col))


def join(c, v: Value, sep: Value | None = None) -> Value:
    if v.kind != "list":
        return STR.of(text(v))
    items = F.transform(v.col, lambda x: F.coalesce(text(v.item.of(x)), F.lit("None")))
    return STR.of(F.when(v.col.isNotNull(), F.call_function("array_join", items, _str(sep) if sep is not None else F.lit(""))))


def flat(c, v: Value, *_) -> Value:
    v = as_list(v)
    while v.item.kind == "list":
        v = v.item.of(F.flatten(v.col))
    return v


def is_type(c, v: Value, t: Value | None = None) -> Value:
    """Takes Python's names and the field types' names."""
    names = {"str": ("str", "string"), "int": ("int", "integer"), "float": ("float", "number"), "bool": ("bool", "boolean"), "object": ("dict", "object"), "duration": ("timedelta", "duration")}.get(v.kind, (v.kind,))
    return BOOL.of(F.when(v.col.isNotNull(), F.lit(_literal(t) in names)))


def is_empty(c, v: Value, *_) -> Value:
    return BOOL.of(F.when(v.col.isNotNull(), ~truthy(v)))


def keys(c, v: Value, *_) -> Value:
    own = list(v.fields or {}) if v.kind in ("object", "props") else []
    return Value(F.when(v.col.isNotNull(), F.array(*[F.lit(k) for k in own]).cast("array<string>")), "list", STR)


def values(c, v: Value, *_) -> Value:
    own = list((v.fields or {}).items()) if v.kind in ("object", "props") else []
    if not own:
        return Value(F.when(v.col.isNotNull(), F.array().cast("array<string>")), "list", STR)
    t = own[0][1]
    for _, x in own[1:]:
        t, _, _ = unify(t.of(F.lit(None)), x.of(F.lit(None)))
    cols = [v.col[k].cast(spark_type(t)) if x.kind == t.kind or {x.kind, t.kind} <= {"int", "float"} else text(x.of(v.col[k])) for k, x in own]
    return Value(F.when(v.col.isNotNull(), F.array(*cols)), "list", t.of(None))


def count(c, v: Value, x: Value | None = None) -> Value:
    if v.kind == "list" and x is not None and x.kind == v.item.kind:
        return INT.of(F.size(F.filter(v.col, lambda i: i.eqNullSafe(x.col))).cast("bigint"))
    if v.kind == "str" and x is not None and x.kind == "str":
        return INT.of(((F.char_length(v.col) - F.char_length(F.replace(v.col, x.col, F.lit("")))) / F.char_length(x.col)).cast("bigint"))
    return null()


def position(c, v: Value, x: Value | None = None) -> Value:
    """The place of an item, from 0; null if it isn't there."""
    if x is None or v.kind not in ("list", "str"):
        return null()
    at = F.array_position(v.col, x.col) if v.kind == "list" else F.instr(v.col, x.col)
    return INT.of(F.when(at > 0, at - 1).cast("bigint"))


def get(c, v: Value, k: Value | None = None) -> Value:
    from .compiler import index

    return index(v, k) if k is not None and v.kind in ("object", "props") else null()


def matches(c, v: Value, s: Value | None = None) -> Value:
    """Whether the receiver, a pattern, is found anywhere in the text."""
    if s is None or s.kind != "str" or v.kind not in ("regex", "str"):
        return null()
    return BOOL.of(F.regexp_like(s.col, F.concat(F.lit("(?U)"), v.col)))


# -- dates -----------------------------------------------------------------------------------------------------

#: Tokens of date formats and what Spark calls them.
TOKENS = {"YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "DD": "dd", "dddd": "EEEE", "ddd": "EEE", "HH": "HH", "hh": "hh", "mm": "mm", "ss": "ss", "A": "a", "a": "a"}
_TOKEN = re.compile("|".join(TOKENS))


def java_pattern(fmt: str) -> str:
    """Everything between tokens is literal text."""
    out, at = [], 0
    for m in [*_TOKEN.finditer(fmt), None]:
        plain = fmt[at : m.start() if m else len(fmt)]
        if plain:
            out.append("'" + plain.replace("'", "''") + "'")
        if m:
            out.append(TOKENS[m[0]])
            at = m.end()
    return "".join(out)


def date_format(c, v: Value, fmt: Value | None = None) -> Value:
    if v.kind not in ("date", "datetime"):
        return null()
    pattern = _literal(fmt)
    return STR.of(F.date_format(v.col, java_pattern(pattern)) if pattern else text(v))


def relative(c, v: Value, *_) -> Value:
    """How long ago or ahead of the frozen clock: minutes, hours or days."""
    if v.kind not in ("date", "datetime"):
        return null()
    seconds = F.floor((F.lit(_epoch(c.env.now)) - micros(v)) / 1_000_000)
    size = F.abs(seconds)
    said = F.lit(None).cast("string")
    for unit, length in (("minute", 60), ("hour", 3_600), ("day", 86_400)):
        n = F.floor(size / length).cast("bigint")
        phrase = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
        said = F.when(size >= length, F.when(seconds >= 0, F.concat(phrase, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), phrase))).otherwise(said)
    return STR.of(F.when(size < 60, "just now").otherwise(said))


def _epoch(moment) -> int:
    return calendar.timegm(moment.timetuple()) * 1_000_000 + moment.microsecond


def as_date(c, v: Value, *_) -> Value:
    if v.kind == "datetime":
        return DATE.of(v.col.cast("date"))
    return v if v.kind == "date" else v


def time(c, v: Value, *_) -> Value:
    return STR.of(F.date_format(v.col, "HH:mm:ss")) if v.kind == "datetime" else null()


# -- links and files -------------------------------------------------------------------------------------------


def as_file(c, v: Value, *_) -> Value:
    """The file that a link names; null if there is none."""
    return c.env.resolve(v.col) if v.kind == "str" and c.env.resolve else null()


def links_to(c, v: Value, x: Value | None = None) -> Value:
    """Whether the file that a link names has a link containing the text."""
    target = as_file(c, v)
    return has_link(c, target, x) if target.kind == "file" else null()


def _part(c, v: Value, name: str) -> Value:
    own = v.fields or {}
    if name not in own:
        return null()
    return own[name] if v.kind == "namespace" else own[name].of(v.col[name])


def has_link(c, v: Value, x: Value | None = None) -> Value:
    own = _part(c, v, "links")
    if own.kind != "list" or x is None:
        return BOOL.of(F.lit(False))
    return BOOL.of(F.coalesce(F.exists(own.col, lambda item: F.contains(item, _str(x))), F.lit(False)))


def has_tag(c, v: Value, *tags: Value) -> Value:
    own = as_list(_part(c, v, "tags"))
    if not tags or own.item.kind != "str":
        return BOOL.of(F.lit(False))
    return BOOL.of(F.coalesce(F.arrays_overlap(own.col, F.array(*[_str(t) for t in tags])), F.lit(False)))


def in_folder(c, v: Value, x: Value | None = None) -> Value:
    parent = _part(c, v, "parent")
    return BOOL.of(F.coalesce(F.contains(parent.col, x.col), F.lit(False))) if parent.kind == "str" and x is not None and x.kind == "str" else BOOL.of(F.lit(False))


def has_property(c, v: Value, k: Value | None = None) -> Value:
    """Whether the key is there, even without a value."""
    present = _part(c, v, "present")
    if present.kind == "list" and k is not None:
        return BOOL.of(F.coalesce(F.array_contains(present.col, _str(k)), F.lit(False)))
    props = _part(c, v, "properties")
    return BOOL.of(F.lit(_literal(k) in ((c.env.fields if v.kind == "namespace" else props.fields) or {})))


def file_link(c, v: Value, display: Value | None = None) -> Value:
    name = _part(c, v, "name")
    alias = F.concat(F.lit("|"), _str(display)) if display is not None else F.lit("")
    return STR.of(F.concat(F.lit("[["), name.col, alias, F.lit("]]")))


def property_names(c, v: Value, *_) -> Value:
    """The fields of the row or, of another record, those that the expression could read."""
    own = [k for k in (v.fields or {}) if not k.startswith("_")]
    return Value(F.array(*[F.lit(k) for k in own]).cast("array<string>"), "list", STR)


FILE_METHODS = {"keys": property_names, "hasTag": has_tag, "inFolder": in_folder, "hasProperty": has_property, "hasLink": has_link, "asLink": file_link, "asFile": lambda c, v: v, "toString": lambda c, v: _part(c, v, "path"), "isTruthy": lambda c, v: BOOL.of(F.lit(True) if v.kind == "namespace" else v.col.isNotNull())}

METHODS = {
    "contains": contains,
    "replace": replace,
    "split": split,
    "slice": cut,
    "lower": _of_text(F.lower),
    "upper": _of_text(F.upper),
    "title": _of_text(title),
    "trim": strip("b"),
    "lstrip": strip("l"),
    "rstrip": strip("r"),
    "zfill": zfill,
    "startsWith": _affix("startswith"),
    "endsWith": _affix("endswith"),
    "abs": _of_number(F.abs),
    "round": rounded,
    "ceil": _of_number(lambda x: F.ceil(x).try_cast("bigint"), INT),
    "floor": _of_number(lambda x: F.floor(x).try_cast("bigint"), INT),
    "toFixed": to_fixed,
    "sort": sort,
    "unique": unique,
    "join": join,
    "flat": flat,
    "count": count,
    "index": position,
    "get": get,
    "isTruthy": lambda c, v: BOOL.of(F.when(v.col.isNotNull(), truthy(v))),
    "isType": is_type,
    "toString": lambda c, v, *_: STR.of(text(v)),
    "isEmpty": is_empty,
    "keys": keys,
    "values": values,
    "matches": matches,
    "format": date_format,
    "relative": relative,
    "date": as_date,
    "time": time,
    "isoformat": lambda c, v, *_: STR.of(F.regexp_replace(text(v), " ", "T")) if v.kind in ("date", "datetime") else null(),
    "asFile": as_file,
    "linksTo": links_to,
}


# -- global functions ------------------------------------------------------------------------------------------


def to_date(c, v: Value | None = None) -> Value:
    """An ISO date, or else an ISO date and time; anything else is null."""
    if v is None:
        return null()
    if v.kind in ("date", "datetime"):
        return v
    if v.kind != "str":
        return null()
    if isinstance(v.const, str):
        day = re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{8}", v.const.strip())
        if not day:
            return DATETIME.of(v.col.try_cast("timestamp_ntz"))
    s = v.col
    day = F.when(s.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10))
    return DATE.of(day.try_cast("date"))


def to_number(c, v: Value | None = None) -> Value:
    if v is None:
        return null()
    if v.kind in ("int", "bool"):
        return number(v)
    if v.kind == "float":
        return v
    if v.kind in ("date", "datetime"):
        return FLOAT.of(micros(v) / 1000)
    if v.kind == "str":
        return FLOAT.of(F.when(F.trim(v.col).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(v.col).try_cast("double")))
    return null()


def to_list(c, *items: Value) -> Value:
    if len(items) == 1 and items[0].kind == "list":
        return items[0]
    out = Value(F.array().cast("array<string>"), "list", STR)
    for i, x in enumerate(items):
        one = Value(F.array(x.col.cast(spark_type(x))), "list", x.of(None))
        out = one if i == 0 else add(out, one)
    return out


def extreme(pick):
    def function(c, *args: Value) -> Value:
        known = [a for a in args if a.kind != "null"]
        if not known:
            return null()
        t = known[0]
        for a in known[1:]:
            t, _, _ = unify(t.of(F.lit(None)), a)
        cols = [a.col.cast(spark_type(t)) if a.kind == t.kind or {a.kind, t.kind} <= {"int", "float"} else text(a) for a in known]
        return t.of(pick(*cols) if len(cols) > 1 else cols[0])

    return function


def to_link(c, path: Value | None = None, display: Value | None = None) -> Value:
    if path is None:
        return null()
    alias = F.concat(F.lit("|"), _str(display)) if display is not None else F.lit("")
    return STR.of(F.concat(F.lit("[["), _str(path), alias, F.lit("]]")))


def to_file(c, v: Value | None = None) -> Value:
    return c.file() if v is None else as_file(c, v)


def to_duration(c, v: Value | None = None) -> Value:
    return null() if v is None else Value(durations(v if v.kind == "str" else STR.of(text(v))), "duration")


_nothing = lambda c, *_: null()

GLOBALS = {
    "now": lambda c: DATETIME.of(F.lit(c.env.now.isoformat(sep=" ")).cast("timestamp_ntz")),
    "today": lambda c: DATE.of(F.lit(c.env.now.date().isoformat()).cast("date")),
    "date": to_date,
    "number": to_number,
    "list": to_list,
    "file": to_file,
    "link": to_link,
    "duration": to_duration,
    "max": extreme(F.greatest),
    "min": extreme(F.least),
    "image": _nothing,
    "icon": _nothing,
    "html": _nothing,
    "escapeHTML": _nothing,
}
