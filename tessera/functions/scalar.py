"""Scalar functions: overloads by type, each built as a Spark expression."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.types import BOOLEAN, DURATION, FLOAT, INT, KINDS, NULL, STRING, TAG, TIME, Type, alternatives, convert, optional, required, to_spark, type_sum


@dataclass(frozen=True)
class Expr:
    col: Column
    type: Type
    literal: object = None


@dataclass(frozen=True)
class Overload:
    args: tuple[str, ...]
    result: Type | Callable[..., Type]
    build: Callable[..., Column]


@dataclass
class Function:
    description: str
    overloads: list[Overload] = field(default_factory=list)
    #: Whether unions and NULL reach it as they are.
    whole: bool = False


FUNCTIONS: dict[str, Function] = {}


def register(name: str, description: str, *overloads: tuple, whole: bool = False) -> None:
    FUNCTIONS[name] = Function(description, [Overload(tuple(a.split()), r, b) for a, r, b in overloads], whole)


def micros(d: Column) -> Column:
    """Microseconds of an interval, which Spark does not divide."""
    return F.unix_micros(F.timestamp_micros(F.lit(0).cast("bigint")) + d)


def interval(us: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)"))


def float_div(a: Column, b: Column) -> Column:
    """Division of floats as IEEE has it, where ANSI mode would raise."""
    zero = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def go_layout(layout: str) -> str:
    """A reference-time layout as a date pattern."""
    pairs = [
        ("January", "MMMM"), ("Monday", "EEEE"), ("2006", "yyyy"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("-0700", "xx"), ("-07", "x"), (".000000000", ".SSSSSSSSS"), (".000000", ".SSSSSS"), (".000", ".SSS"),
        ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"), ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("_2", "d"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
    ]
    out, i = [], 0
    while i < len(layout):
        for go, java in pairs:
            if layout.startswith(go, i):
                out.append(java)
                i += len(go)
                break
        else:
            c = layout[i]
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            i += 1
    return "".join(out)


def parse_time(layout: Expr, text: Expr) -> Column:
    if not isinstance(layout.literal, str):
        raise QueryError("the layout of parse_time must be a constant")
    return F.try_to_timestamp(text.col, F.lit(go_layout(layout.literal)))


def substr(s: Column, start: Column, n: Column | None = None) -> Column:
    """0-based and clamped."""
    first = F.greatest(start, F.lit(0))
    length = F.length(s) if n is None else F.greatest(F.least(start + n, F.length(s)) - first, F.lit(0))
    return F.substring(s, (first + 1).cast("int"), length.cast("int"))


def to_int(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("bigint"))


def to_float(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|(?i)^[+-]?(inf|infinity|nan)\z"), s.try_cast("double"))


def member(x: Expr, options: list[Expr], negated: bool) -> Column:
    """NULL among the options never matches; a NULL value gives NULL."""
    tests = [F.coalesce(compare("=", x, o).col, F.lit(False)) for o in options]
    found = functools.reduce(lambda a, b: a | b, tests, F.lit(False))
    return F.when(x.col.isNotNull(), ~found if negated else found)


def arithmetic(op: str) -> Callable[[Column, Column], Column]:
    return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}[op]


SAME = lambda a, *_: a
for _op, _text in (("<", "less than"), ("<=", "at most"), (">", "greater than"), (">=", "at least")):
    register(_op, f"Whether the first value is {_text} the second.", ("T T", BOOLEAN, {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[_op]))
register("=", "Whether the values are equal.", ("Any Any", BOOLEAN, lambda a, b: a == b), whole=True)
register("!=", "Whether the values differ.", ("Any Any", BOOLEAN, lambda a, b: a != b), whole=True)
register("<=>", "Equality that holds for two NULLs.", ("Any Any", BOOLEAN, lambda a, b: a.eqNullSafe(b)), whole=True)
register("is null", "Whether the value is NULL.", ("Any", BOOLEAN, lambda a: a.isNull()), whole=True)
register("is not null", "Whether the value is not NULL.", ("Any", BOOLEAN, lambda a: a.isNotNull()), whole=True)
register("+", "Sum, or concatenation of strings.", ("Int Int", INT, arithmetic("+")), ("Float Float", FLOAT, arithmetic("+")), ("Duration Duration", DURATION, arithmetic("+")),
         ("Time Duration", TIME, arithmetic("+")), ("Duration Time", TIME, lambda a, b: b + a), ("String String", STRING, lambda a, b: F.concat(a, b)))
register("-", "Difference or negation.", ("Int Int", INT, arithmetic("-")), ("Int", INT, lambda a: -a), ("Float Float", FLOAT, arithmetic("-")), ("Float", FLOAT, lambda a: -a),
         ("Duration Duration", DURATION, arithmetic("-")), ("Duration", DURATION, lambda a: -a), ("Time Duration", TIME, arithmetic("-")))
register("*", "Product, or repetition of a string.", ("Int Int", INT, arithmetic("*")), ("Float Float", FLOAT, arithmetic("*")), ("Duration Int", DURATION, arithmetic("*")), ("Int Duration", DURATION, lambda a, b: b * a),
         ("String Int", STRING, lambda a, b: F.repeat(a, b.cast("int"))), ("Int String", STRING, lambda a, b: F.repeat(b, a.cast("int"))))
register("/", "Quotient; of integers truncated.", ("Int Int", INT, lambda a, b: F.call_function("div", a, b)), ("Float Float", FLOAT, float_div), ("Duration Int", DURATION, lambda a, b: interval(F.call_function("div", micros(a), b))),
         ("Duration Duration", FLOAT, lambda a, b: float_div(micros(a).cast("double"), micros(b).cast("double"))))
register("div", "Truncated quotient of integers.", ("Int Int", INT, lambda a, b: F.call_function("div", a, b)))
register("%", "Remainder.", ("Int Int", INT, lambda a, b: a % b), ("Float Float", FLOAT, lambda a, b: a % b))
register("mod", "Remainder.", ("Int Int", INT, lambda a, b: a % b), ("Float Float", FLOAT, lambda a, b: a % b))
register("&", "Bitwise and.", ("Int Int", INT, lambda a, b: a.bitwiseAND(b)))
register("|", "Bitwise or.", ("Int Int", INT, lambda a, b: a.bitwiseOR(b)))
register("^", "Bitwise exclusive or.", ("Int Int", INT, lambda a, b: a.bitwiseXOR(b)))
register("<<", "Shift to the left.", ("Int Int", INT, lambda a, b: F.call_function("shiftleft", a, b.cast("int"))))
register(">>", "Shift to the right.", ("Int Int", INT, lambda a, b: F.call_function("shiftright", a, b.cast("int"))))
register("bitnot", "Bitwise complement.", ("Int", INT, lambda a: F.bitwise_not(a)))
register("abs", "Absolute value.", ("Int", INT, F.abs), ("Float", FLOAT, F.abs))
register("sqrt", "Square root.", ("Float", FLOAT, F.sqrt))
register("ceil", "The least whole number not below.", ("Float", FLOAT, lambda a: F.ceil(a).cast("double")))
register("floor", "The greatest whole number not above.", ("Float", FLOAT, lambda a: F.floor(a).cast("double")))


def log_like(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Spark gives NULL where the logarithm has no value; here it is NaN or minus infinity."""
    return lambda a: F.when(a > 0, f(a)).when(a == 0, float("-inf")).when(a.isNotNull(), float("nan"))


register("log2", "Logarithm to base 2.", ("Float", FLOAT, log_like(F.log2)))
register("log", "Natural logarithm.", ("Float", FLOAT, log_like(F.ln)))
register("log10", "Logarithm to base 10.", ("Float", FLOAT, log_like(F.log10)))
register("pow", "Power.", ("Float Float", FLOAT, F.pow))
register("not", "Negation.", ("Boolean", BOOLEAN, lambda a: ~a))
register("like", "Whether the text matches a pattern of % and _.", ("String String", BOOLEAN, lambda a, b: F.like(a, b)), ("String String String", BOOLEAN, lambda a, b, e: F.like(a, b, e)))
register("~", "Whether a regular expression is found.", ("String String", BOOLEAN, lambda a, b: F.rlike(a, b)))
register("~*", "The same without regard to case.", ("String String", BOOLEAN, lambda a, b: F.rlike(F.lower(a), F.lower(b))))
register("upper", "Upper case.", ("String", STRING, F.upper))
register("lower", "Lower case.", ("String", STRING, F.lower))
register("reverse", "The characters from last to first.", ("String", STRING, F.reverse))
register("substr", "Part of a text from a 0-based place, optionally of a length.", ("String Int", STRING, substr), ("String Int Int", STRING, substr))
register("replace", "All occurrences of a text replaced.", ("String String String", STRING, lambda a, b, c: F.replace(a, b, c)))
register("position", "0-based place of a text in another, NULL if absent.", ("String String", optional(INT), lambda a, b: (F.nullif(F.call_function("locate", b, a), F.lit(0)) - 1).cast("bigint")))
register("len", "Bytes of a text, items of a list or tuple, fields of an object.", ("String", INT, lambda a: F.octet_length(a).cast("bigint")), ("List", INT, lambda a: F.when(a.isNotNull(), F.size(a)).cast("bigint")),
         ("Struct", INT, None), ("Tuple", INT, None))
register("now", "The time at which the query runs.", ("", TIME, lambda: F.current_timestamp()))
register("parse_time", "A time read by a layout, NULL if it does not fit.", ("String String", optional(TIME), None))
register("time_from_unix", "The time of seconds since 1970.", ("Int", TIME, F.timestamp_seconds), ("Float", TIME, F.timestamp_seconds))
register("time_to_unix", "Seconds since 1970.", ("Time", INT, F.unix_seconds))
register("int", "Conversion to Int; NULL if a text is none.", ("Int", INT, SAME), ("Boolean", INT, lambda a: a.cast("bigint")), ("Float", INT, lambda a: a.cast("bigint")), ("String", optional(INT), to_int), ("Duration", INT, lambda a: micros(a) * 1000))
register("float", "Conversion to Float; NULL if a text is none.", ("Float", FLOAT, SAME), ("Int", FLOAT, lambda a: a.cast("double")), ("String", optional(FLOAT), to_float), ("Duration", FLOAT, lambda a: micros(a) / 1e6))
register("string", "The value as text.", ("Any", STRING, None), whole=True)
register("[]", "Item of a list by 0-based place, NULL past its end.", ("List Int", lambda l, _: optional(l.elem or NULL), lambda a, i: F.get(a, i.cast("int"))))
register("panic", "Fails the query with the value.", ("Any", NULL, None), whole=True)
register("in", "Whether a value is among others.", ("Any List", BOOLEAN, None), ("Any Tuple", BOOLEAN, None), whole=True)
register("not in", "Whether a value is not among others.", ("Any List", BOOLEAN, None), ("Any Tuple", BOOLEAN, None), whole=True)
register("coalesce", "The first value that is not NULL.", ("Any", lambda *t: t[0], None), whole=True)


def display(e: Expr, nested: bool = True) -> Column:
    """A value as the table format shows it; texts are quoted where nested."""
    t, c = e.type, e.col
    if t.kind == "Null":
        return F.lit("<null>")
    if t.kind == "Union":
        out = F.lit("<null>")
        for a in t.alts:
            out = F.when(c[TAG] == KINDS.index(a.kind), display(Expr(c[a.kind], a))).otherwise(out)
        return out
    if t.kind == "String":
        s = F.concat(F.lit("'"), c, F.lit("'")) if nested else c
    elif t.kind == "List":
        s = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: display(Expr(x, t.elem or NULL))), ", "), F.lit("]"))
    elif t.kind in ("Struct", "Tuple"):
        left, right = ("{ ", " }") if t.kind == "Struct" else ("(", ")")
        s = F.concat(F.lit(left), F.concat_ws(", ", *[display(Expr(c[n], f)) for n, f in t.fields]), F.lit(right))
    elif t.kind == "Time":
        s = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit("<null>"))


def numeric(a: Type, b: Type) -> bool:
    return {a.kind, b.kind} == {"Int", "Float"}


def compare(op: str, a: Expr, b: Expr, compat: bool = False) -> Expr:
    """=, != and <=> over any types: values of different types are unequal."""
    nullable = a.type.nullable or b.type.nullable
    result = BOOLEAN if op == "<=>" or not nullable else optional(BOOLEAN)
    if "Null" in (a.type.kind, b.type.kind):
        same = a.col.isNull() & b.col.isNull()
        return Expr(same if op == "<=>" else F.lit(None).cast("boolean"), result)
    both = type_sum(a.type, b.type)
    if both.kind == "Union" and numeric(a.type, b.type) and not compat:
        ca, cb = a.col.cast("double"), b.col.cast("double")
    elif both.kind == "Union" and "Union" not in (a.type.kind, b.type.kind):
        known = a.col.isNotNull() & b.col.isNotNull()
        if op == "<=>":
            return Expr(a.col.isNull() & b.col.isNull(), result)
        return Expr(F.when(known, F.lit(op == "!=")), result)
    else:
        ca, cb = convert(a.col, a.type, both), convert(b.col, b.type, both)
    return Expr(FUNCTIONS[op].overloads[0].build(ca, cb), result)


def fits(param: str, t: Type, bound: dict[str, Type]) -> bool:
    if t.kind == "Null" or param == "Any":
        return True
    if param == "T":
        have = bound.setdefault("T", required(t))
        return have.kind == t.kind
    return param == t.kind


def call(name: str, args: list[Expr], compat: bool = False, own: dict[str, Function] | None = None) -> Expr:
    """Resolves an overload; a union goes to each alternative, and those without one fail when met. own: functions
    that come before the built-in ones."""
    f = (own or {}).get(name) or FUNCTIONS.get(name)
    if f is None:
        raise QueryError(f"unknown function: {name}({', '.join(str(a.type) for a in args)})")
    if name in ("=", "!=", "<=>") and len(args) == 2:
        return compare(name, *args, compat)
    if name == "coalesce":
        if not args:
            raise QueryError("coalesce needs an argument")
        t = functools.reduce(type_sum, [a.type for a in args])
        if all(a.type.nullable for a in args):
            t = optional(t)
        elif any(not a.type.nullable for a in args):
            t = required(t)
        return Expr(F.coalesce(*[convert(a.col, a.type, t) for a in args]), t)
    if name == "string" and len(args) == 1:
        if compat or args[0].type.kind in ("List", "Struct", "Tuple", "Union", "Time", "Null"):
            shown = display(args[0], compat)
            return Expr(shown if compat else F.when(args[0].col.isNotNull(), shown), STRING if compat else STRING if not args[0].type.nullable else optional(STRING))
        return Expr(args[0].col.cast("string"), STRING if not args[0].type.nullable else optional(STRING))
    if name == "panic" and len(args) == 1:
        return Expr(F.raise_error(F.concat(F.lit("panic: "), display(args[0]))), NULL)
    for k, a in enumerate(args):
        if a.type.kind == "Union" and not f.whole:
            return per_alternative(name, args, k, compat, own)
    tries = [args]
    if not compat and any(a.type.kind == "Int" for a in args):
        tries.append([Expr(a.col.cast("double"), Type("Float", a.type.nullable)) if a.type.kind == "Int" else a for a in args])
    for given in tries:
        found = None
        for o in f.overloads:
            bound: dict[str, Type] = {}
            if len(o.args) == len(given) and all(fits(p, a.type, bound) for p, a in zip(o.args, given, strict=True)):
                found = o
                break
        if found:
            return build(name, f, found, given)
    raise QueryError(f"unknown function: {name}({', '.join(str(a.type) for a in args)})")


def build(name: str, f: Function, o: Overload, args: list[Expr]) -> Expr:
    result = o.result(*[a.type for a in args]) if callable(o.result) else o.result
    if not f.whole and any(a.type.nullable for a in args):
        result = optional(result)
    if not f.whole and any(a.type.kind == "Null" for a in args):
        if all(a.type.kind == "Null" for a in args) and result.kind != "Boolean":
            result = NULL
        return Expr(F.lit(None).cast(to_spark(result)), result)
    if name == "len" and o.build is None:
        n = F.lit(len(args[0].type.fields)).cast("bigint")
        return Expr(F.when(args[0].col.isNotNull(), n) if args[0].type.nullable else n, result)
    if name == "parse_time":
        return Expr(parse_time(*args), result)
    if name in ("in", "not in") and args[1].type.kind == "List":
        x, options = args
        elem = options.type.elem or NULL
        found = F.exists(options.col, lambda v: F.coalesce(compare("=", x, Expr(v, elem)).col, F.lit(False)))
        return Expr(F.when(x.col.isNotNull(), ~found if name == "not in" else found), optional(BOOLEAN))
    if name in ("in", "not in"):
        x, options = args
        return Expr(member(x, [Expr(options.col[n], t) for n, t in options.type.fields], name == "not in"), optional(BOOLEAN))
    return Expr(o.build(*[a.col for a in args]), result)


def per_alternative(name: str, args: list[Expr], k: int, compat: bool, own: dict[str, Function] | None) -> Expr:
    a = args[k]
    found: list[tuple[Type, Expr]] = []
    for t in alternatives(a.type):
        try:
            found.append((t, call(name, [*args[:k], Expr(a.col[t.kind], t), *args[k + 1 :]], compat, own)))
        except QueryError:
            continue
    if not found:
        raise QueryError(f"unknown function: {name}({', '.join(str(x.type) for x in args)})")
    result = functools.reduce(type_sum, [e.type for _, e in found])
    if a.type.nullable:
        result = optional(result)
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), a.col[TAG].cast("int") + 1)
    out = F.when(a.col.isNotNull(), F.raise_error(F.concat(F.lit(f"{name}: no overload for a value of type "), kind)).cast(to_spark(result)))
    for t, e in found:
        out = F.when(a.col[TAG] == KINDS.index(t.kind), convert(e.col, e.type, result)).otherwise(out)
    return Expr(out, result)


def assertion(e: Expr, kind: str) -> Expr:
    """value::type: the value if it has the type, else NULL; only types that it may have can be asked for."""
    if kind == "Null":
        return Expr(F.lit(None), NULL)
    if e.type.kind == "Union":
        for a in e.type.alts:
            if a.kind == kind:
                return Expr(F.when(e.col[TAG] == KINDS.index(kind), e.col[kind]), optional(a))
    elif e.type.kind == kind:
        return e
    if e.type.kind == "Null":
        return Expr(F.lit(None), NULL)
    raise QueryError(f"a value of type {e.type} is never {kind}: :: asserts a type; to convert, use int(), float() or string()")


def field_of(e: Expr, name: str) -> Expr:
    t, c = e.type, e.col
    if t.kind == "Union":
        own = [a for a in t.alts if a.kind == "Struct"]
        if not own:
            raise QueryError(f"no object in {t}")
        t, c = optional(own[0]), c["Struct"]
    if t.kind != "Struct":
        raise QueryError(f"-> needs an object, not {e.type}")
    for n, f in t.fields:
        if n == name:
            return Expr(c[n], optional(f) if t.nullable else f)
    raise QueryError(f"unknown field {name} in {t}")


