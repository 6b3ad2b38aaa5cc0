"""From syntax trees to DataFrames.

Names are resolved and types checked here; what comes out is an ordinary logical
plan, and pushing down, pruning, join strategies and execution are Catalyst's.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.functions import aggregates as G
from tessera.functions.scalar import Expr, assertion, call, compare, field_of
from tessera.operators import replay
from tessera.plans import ast as A
from tessera.plans.scope import Col, Emission, Relation, Scope, fresh
from tessera.sources.catalog import Catalog
from tessera.types import BOOLEAN, DURATION, FLOAT, INT, NULL, STRING, TIME, Type, convert, list_of, optional, required, to_spark, type_sum

UNIT_US = {"us": 1, "ms": 1000, "s": 10**6, "min": 6 * 10**7, "h": 36 * 10**8, "d": 864 * 10**8}
OUTER = "outer join predicate must be a conjunction of equalities"


def walk(e: object):  # noqa: ANN201
    """The nodes of an expression, without those of subqueries."""
    yield e
    if isinstance(e, (A.Sub, A.Exists)):
        return
    if isinstance(e, tuple):
        for x in e:
            yield from walk(x)
    elif dataclasses.is_dataclass(e):
        for f in dataclasses.fields(e):
            yield from walk(getattr(e, f.name))


def conjuncts(e: object) -> list:
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, A.Logic) and e.op == "and" else [e]


#: Numbers that a range beside a record explodes at a time.
BLOCK = 1 << 16


def micros_of(e: object) -> int:
    """A constant interval in microseconds."""
    if isinstance(e, A.Interval):
        if e.unit == "ns" and e.amount % 1000:
            raise QueryError("an INTERVAL must be whole microseconds")
        return e.amount // 1000 if e.unit == "ns" else e.amount * UNIT_US[e.unit]
    if isinstance(e, A.Call) and e.name in ("+", "-"):
        parts = [micros_of(a) for a in e.args]
        return -parts[0] if len(parts) == 1 else parts[0] + parts[1] * (1 if e.name == "+" else -1)
    if isinstance(e, A.Call) and e.name == "*":
        n, d = sorted(e.args, key=lambda a: not isinstance(a, A.Lit))
        return n.value * micros_of(d)
    raise QueryError("expected a constant INTERVAL")


class Analyzer:
    def __init__(self, catalog: Catalog, compat: bool = False) -> None:
        self.catalog, self.spark, self.compat = catalog, catalog.spark, compat
        #: The shortest interval of the query's poll() calls, in microseconds.
        self.poll_us: int | None = None

    # queries

    def query(self, q: A.Select | A.SetOp, scope: Scope) -> Relation:
        if q.ctes:
            scope = Scope(scope.relation, scope.outer, dict(scope.ctes))
            for name, inner in q.ctes:
                scope.ctes[name.lower()] = self.query(inner, scope)
        return self.select(q, scope) if isinstance(q, A.Select) else self.set_op(q, scope)

    def set_op(self, q: A.SetOp, scope: Scope) -> Relation:
        left, right = self.query(q.left, scope), self.query(q.right, scope)
        if len(left.cols) != len(right.cols):
            raise QueryError("both sides of a set operation need as many columns")
        cols, a, b = [], [], []
        for x, y in zip(left.cols, right.cols, strict=True):
            t = type_sum(x.type, y.type)
            if {required(x.type).kind, required(y.type).kind} == {"Int", "Float"} and not self.compat:
                t = Type("Float", x.type.nullable or y.type.nullable)
            c = Col(None, x.name, fresh(x.name), t)
            a.append(convert(F.col(x.internal), x.type, t).alias(c.internal))
            b.append(convert(F.col(y.internal), y.type, t).alias(c.internal))
            cols.append(c)
        l, r = left.df.select(*a), right.df.select(*b)
        make: dict[tuple[str, bool], Callable[[], DataFrame]] = {
            ("union", True): lambda: l.union(r), ("union", False): lambda: l.union(r).distinct(), ("intersect", True): lambda: l.intersectAll(r),
            ("intersect", False): lambda: l.intersect(r), ("except", True): lambda: l.exceptAll(r), ("except", False): lambda: l.subtract(r),
        }
        return self.ordered(Relation(make[q.op, q.all](), cols), q, scope, None)

    def select(self, q: A.Select, scope: Scope) -> Relation:
        source = self.table(q.source, scope) if q.source is not None else self.catalog.relation("dual", {}, None)
        inner = Scope(source, scope if scope.relation or scope.outer else None, scope.ctes)
        if q.where is not None:
            source = dataclasses.replace(source, df=source.df.filter(self.truth(q.where, inner).col))
            inner = dataclasses.replace(inner, relation=source)
        if q.triggers and not q.group:
            raise QueryError("TRIGGER needs GROUP BY")
        grouped = bool(q.group) or any(self.is_aggregate(n) for i in q.items for n in walk(i.value)) or (q.having is not None)
        out = self.grouped(q, inner) if grouped else self.projected(q.items, inner)
        if q.distinct:
            out = Relation(out.df.select(*[c.internal for c in out.cols]).distinct(), out.cols, out.time)
        return self.ordered(out, q, scope, None if grouped or q.distinct else inner)

    @staticmethod
    def is_aggregate(n: object) -> bool:
        return isinstance(n, A.Call) and G.is_aggregate(n.name, n.distinct)

    def constant(self, e: object, what: str) -> int:
        if not isinstance(e, A.Lit) or not isinstance(e.value, int) or isinstance(e.value, bool):
            raise QueryError(f"{what} must be a whole number")
        if e.value < 0:
            raise QueryError(f"{what} must not be negative, got {e.value}")
        return e.value

    def ordered(self, out: Relation, q: A.Select | A.SetOp, scope: Scope, source: Scope | None) -> Relation:
        df, hidden = out.df, []
        if q.order:
            keys = []
            for e, desc in q.order:
                if isinstance(e, A.Lit) and isinstance(e.value, int) and not isinstance(e.value, bool) and 1 <= e.value <= len(out.cols):
                    col = F.col(out.cols[e.value - 1].internal)
                else:
                    try:
                        col = self.expr(e, Scope(out, scope.outer, scope.ctes)).col
                    except QueryError:
                        origin = getattr(out, "origin", None)
                        if source is None or origin is None:
                            raise
                        # a column that is not selected: it was kept for this
                        name = fresh("order")
                        df = origin(name, self.expr(e, source).col)
                        origin = None
                        hidden.append(name)
                        col = F.col(name)
                keys.append(col.desc_nulls_last() if desc else col.asc_nulls_first())
            # ties go by all values, so that LIMIT takes the same rows each time
            df = df.orderBy(*keys, *[F.col(c.internal).asc_nulls_first() for c in out.cols])
        if q.offset is not None:
            df = df.offset(self.constant(q.offset, "offset"))
        if q.limit is not None:
            df = df.limit(self.constant(q.limit, "limit"))
        if hidden:
            df = df.drop(*hidden)
        return out if df is out.df else dataclasses.replace(out, df=df, emission=out.emission if not (q.order or q.limit is not None) else None)

    def names(self, wanted: list[tuple[str | None, str]]) -> list[tuple[str | None, str]]:
        """Output names without duplicates of both qualifier and name."""
        seen: set = set()
        out = []
        for qualifier, name in wanted:
            own, n = name, 1
            while (qualifier, own) in seen:
                own = f"{name}_{n}"
                n += 1
            seen.add((qualifier, own))
            out.append((qualifier, own))
        return out

    def projected(self, items: list[A.Item], scope: Scope) -> Relation:
        source = scope.relation
        wanted: list[tuple[str | None, str]] = []
        made: list[Expr] = []
        kept: list[str | None] = []
        for i in items:
            if isinstance(i.value, A.Star):
                own = [c for c in source.cols if i.value.qualifier is None or (c.qualifier or "").lower() == i.value.qualifier.lower()]
                if not own:
                    raise QueryError(f"unknown table {i.value.qualifier}")
                for c in own:
                    wanted.append((c.qualifier, c.name))
                    made.append(c.expr)
                    kept.append(c.internal)
            elif isinstance(i.value, A.Spread):
                e = self.expr(i.value.value, scope)
                if e.type.kind != "Struct":
                    raise QueryError(f"->* needs an object, not {e.type}")
                for n, _ in e.type.fields:
                    wanted.append((None, n))
                    made.append(field_of(e, n))
                    kept.append(None)
            else:
                e = self.unnest(i.value, scope) or self.expr(i.value, scope)
                col = self.column(i.value, scope) if isinstance(i.value, A.Name) else None
                if i.alias:
                    wanted.append((None, i.alias))
                elif isinstance(i.value, A.Name):
                    wanted.append((col.qualifier if col else None, i.value.name))
                else:
                    wanted.append((None, f"col_{len(wanted)}"))
                made.append(e)
                kept.append(col.internal if col else None)
        cols = [Col(q, n, fresh(n), e.type) for (q, n), e in zip(self.names(wanted), made, strict=True)]
        renamed = {k: c.internal for k, c in zip(kept, cols, strict=True) if k}
        extra = [x for x in (source.time, source.seq, source.window) if x and x not in renamed]
        extra = list(dict.fromkeys(extra))
        chosen = [e.col.alias(c.internal) for e, c in zip(made, cols, strict=True)] + [F.col(x) for x in extra]
        renamed |= {x: x for x in extra}
        time = renamed.get(source.time) if source.time in {*kept, *extra} else None
        out = Relation(source.df.select(*chosen), cols, time, renamed.get(source.seq), None, renamed.get(source.window))
        # for an ORDER BY on what is not selected
        out.origin = lambda name, col: source.df.select(*chosen, col.alias(name))
        return out

    def unnest(self, e: object, scope: Scope) -> Expr | None:
        if not (isinstance(e, A.Call) and e.name == "unnest" and len(e.args) == 1):
            return None
        own = self.unnest(e.args[0], scope) or self.expr(e.args[0], scope)
        if own.type.kind != "List" or (own.type.nullable and self.compat):
            raise QueryError(f"unnest needs a list, not {own.type}")
        return Expr(F.explode(own.col), own.type.elem or NULL)

    # grouping

    def canonical(self, e: object, scope: Scope) -> object:
        """The expression with its columns by identity, to tell equal ones."""
        if isinstance(e, A.Name):
            c = self.column(e, scope)
            return ("column", c.internal) if c else e
        if isinstance(e, tuple):
            return tuple(self.canonical(x, scope) for x in e)
        if dataclasses.is_dataclass(e) and not isinstance(e, (A.Sub, A.Exists)):
            return (type(e).__name__, *(self.canonical(getattr(e, f.name), scope) for f in dataclasses.fields(e)))
        return e

    def grouped(self, q: A.Select, scope: Scope) -> Relation:
        source = scope.relation
        by_alias = {i.alias: i.value for i in q.items if i.alias}
        group = []
        for k in q.group:
            if isinstance(k, A.Lit) and isinstance(k.value, int) and 1 <= k.value <= len(q.items):
                k = q.items[k.value - 1].value
            elif isinstance(k, A.Name) and k.qualifier is None and self.column(k, scope) is None and k.name in by_alias:
                k = by_alias[k.name]
            group.append(k)
        keys = [(fresh("key"), self.expr(k, scope), self.canonical(k, scope)) for k in group]
        found: dict[object, tuple[str, str, Expr, Expr]] = {}
        places = [*[i.value for i in q.items], *([q.having] if q.having is not None else []), *[e for e, _ in q.order]]
        for e in places:
            for n in walk(e):
                if self.is_aggregate(n):
                    if len(n.args) != 1:
                        raise QueryError(f"{n.name} takes one argument")
                    name = G.name_of(n.name, n.distinct)
                    c = (name, self.canonical(n.args[0], scope))
                    if c not in found:
                        arg = self.expr(n.args[0], scope)
                        found[c] = (fresh(name), name, arg, G.aggregate(name, arg))
        group_cols = [e.col.alias(k) for k, e, _ in keys]
        aggs = [out.col.alias(a) for a, _, _, out in found.values()]
        stream = source.df.isStreaming
        window = source.window if stream and source.window else None
        if window:
            group_cols.append(F.col(window))
        if not keys and not window:
            count = fresh("rows")
            df = source.df.agg(*aggs, F.count(F.lit(1)).alias(count)).filter(F.col(count) > 0).drop(count)
        elif aggs:
            df = source.df.groupBy(*group_cols).agg(*aggs)
        else:
            df = source.df.select(*group_cols).distinct()
        by_key = {c: Expr(F.col(k), e.type) for k, e, c in keys}
        by_agg = {c: Expr(F.col(a), out.type) for c, (a, _, _, out) in found.items()}

        def after(e: object) -> Expr:
            """An expression over the groups: keys and aggregates are its columns."""
            c = self.canonical(e, scope)
            if c in by_key:
                return by_key[c]
            if self.is_aggregate(e):
                return by_agg[G.name_of(e.name, e.distinct), self.canonical(e.args[0], scope)]
            if isinstance(e, A.Name):
                if e.qualifier is None and e.name in by_alias and by_alias[e.name] != e:
                    return after(by_alias[e.name])
                raise QueryError(f"{e.name} must be a key of GROUP BY or in an aggregate")
            return self.expr(e, Scope(None, scope, scope.ctes), after)

        if q.having is not None:
            df = df.filter(self.as_boolean(after(q.having)).col)
        wanted, made = [], []
        for i in q.items:
            if isinstance(i.value, (A.Star, A.Spread)):
                raise QueryError("* can't be selected with GROUP BY")
            made.append(after(i.value))
            if i.alias:
                wanted.append((None, i.alias))
            elif self.is_aggregate(i.value):
                arg = i.value.args[0]
                name = G.name_of(i.value.name, i.value.distinct)
                wanted.append((None, f"{name}_{arg.name}" if isinstance(arg, A.Name) else name))
            elif isinstance(i.value, A.Name):
                c = self.column(i.value, scope)
                wanted.append((c.qualifier if c else None, i.value.name))
            else:
                wanted.append((None, f"col_{len(wanted)}"))
        cols = [Col(qn, n, fresh(n), e.type) for (qn, n), e in zip(self.names(wanted), made, strict=True)]
        order = [(k, e) for k, (e, _) in enumerate(q.order) if any(self.is_aggregate(n) for n in walk(e))]
        if order:
            # an aggregate that is only sorted by becomes a column that is dropped again
            hidden = {k: fresh("order") for k, _ in order}
            full = df.select(*[e.col.alias(c.internal) for e, c in zip(made, cols, strict=True)], *[after(e).col.alias(hidden[k]) for k, e in order])
            keys_ = []
            for k, (e, desc) in enumerate(q.order):
                col = F.col(hidden[k]) if k in hidden else self.expr(e, Scope(Relation(full, cols), scope.outer, scope.ctes)).col
                keys_.append(col.desc_nulls_last() if desc else col.asc_nulls_first())
            q.order = []
            return Relation(full.orderBy(*keys_).drop(*hidden.values()), cols)
        time = next((c.internal for c, i in zip(cols, q.items, strict=True) if source.time and self.canonical(i.value, scope) == ("column", source.time)), None)
        chosen = [e.col.alias(c.internal) for e, c in zip(made, cols, strict=True)]
        out = Relation(df.select(*chosen, *([F.col(window)] if window else [])), cols, time, None, None, window)
        if q.triggers:
            self.check_triggers(q.triggers, keys, source)
            simple = {c: a for c, (a, *_) in found.items()}
            picks = []
            for i, c in zip(q.items, cols, strict=True):
                own = self.canonical(i.value, scope)
                key = next((k for k, _, kc in keys if kc == own), None)
                agg = simple.get((G.name_of(i.value.name, i.value.distinct), self.canonical(i.value.args[0], scope))) if self.is_aggregate(i.value) else None
                picks.append((key or agg, c))
            if all(p for p, _ in picks) and q.having is None:
                out.emission = Emission(source.df, [(k, e) for k, e, _ in keys], [(a, n, arg) for a, n, arg, _ in found.values()], q.triggers, None, source.seq)
                out.emission_picks = picks
        return out

    def check_triggers(self, triggers: list[A.Trigger], keys: list, source: Relation) -> None:
        for t in triggers:
            if t.kind == "watermark" and (source.time is None or not any(c == ("column", source.time) for _, _, c in keys)):
                raise QueryError("TRIGGER ON WATERMARK needs the time field among the keys")
            if t.kind == "counting" and t.count < 1:
                raise QueryError("TRIGGER COUNTING needs a positive number")

    # tables

    def table(self, t: object, scope: Scope) -> Relation:
        if isinstance(t, A.Table):
            cte = scope.ctes.get(t.name.lower())
            if cte is not None:
                return cte.distinct_names().aliased(t.alias or t.name)
            return self.catalog.relation(t.name, t.options, t.alias)
        if isinstance(t, A.Derived):
            return self.query(t.query, Scope(None, scope if scope.relation else scope.outer, scope.ctes)).aliased(t.alias)
        if isinstance(t, A.Function):
            return self.function(t, scope).aliased(t.alias)
        if isinstance(t, A.Join):
            return self.join(t, scope)
        raise QueryError(f"unknown table expression {t}")

    def merged(self, left: Relation, right: Relation, df: DataFrame, nullable: tuple[bool, bool]) -> Relation:
        cols = [dataclasses.replace(c, type=optional(c.type)) if n else c for r, n in ((left, nullable[0]), (right, nullable[1])) for c in r.cols]
        time = left.time or right.time
        if left.time and right.time:
            name = fresh("time")
            df, time = df.withColumn(name, F.greatest(left.time, right.time)), name
        return Relation(df, cols, time, left.seq, None, left.window or right.window)

    def join(self, j: A.Join, scope: Scope) -> Relation:
        left = self.table(j.left, scope)
        if j.strategy == "lookup" and isinstance(j.right, A.Function) and j.right.name == "range":
            return self.lookup_range(j, left, scope)
        try:
            right, lateral = self.table(j.right, scope), False
        except QueryError:
            if j.strategy != "lookup":
                raise
            right, lateral = self.table(j.right, Scope(left, scope.outer, scope.ctes)), True
        if j.kind in ("left", "right", "full") and j.on is None and j.using is None:
            raise QueryError("outer join without ON")
        both = Scope(self.merged(left, right, left.df, (False, False)) if not (left.time and right.time) else Relation(left.df, [*left.cols, *right.cols]), scope.outer, scope.ctes)
        nullable = (j.kind in ("right", "full"), j.kind in ("left", "full"))
        if j.using:
            pairs = [(left.find(n), right.find(n)) for n in j.using]
            if any(a is None or b is None for a, b in pairs):
                raise QueryError(f"unknown column in USING ({', '.join(j.using)})")
            on = functools.reduce(lambda a, b: a & b, [self.key(a.expr, b.expr) for a, b in pairs])
            out = self.merged(left, right, left.df.join(right.df, on, j.kind), nullable)
            drop = {b.internal for _, b in pairs} if j.kind != "right" else {a.internal for a, _ in pairs}
            return dataclasses.replace(out, cols=[c for c in out.cols if c.internal not in drop])
        if j.on is None:
            how = left.df.lateralJoin(right.df) if lateral else left.df.crossJoin(right.df)
            return self.merged(left, right, how, nullable)
        if j.kind in ("left", "right", "full"):
            on = self.outer_condition(j.on, left, right, scope)
        else:
            on = functools.reduce(lambda a, b: a & b, [self.condition(c, left, right, both) for c in conjuncts(j.on)])
        df = left.df.lateralJoin(right.df, on, "inner") if lateral else left.df.join(right.df, on, j.kind)
        return self.merged(left, right, df, nullable)

    def lookup_range(self, j: A.Join, left: Relation, scope: Scope) -> Relation:
        """A range whose bounds may depend on the left record: its numbers are exploded beside it."""
        own = Scope(left, scope.outer, scope.ctes)
        lo, hi = (self.expr(self.argument(j.right, n, needed=True), own) for n in ("start", "end"))
        if {lo.type.kind, hi.type.kind} != {"Int"}:
            raise QueryError("range needs Int bounds")
        c = Col(j.right.alias, "i", fresh("i"), INT)
        # in blocks, so that no array holds more than BLOCK numbers or starts of blocks are few
        block = fresh("block")
        df = left.df.withColumn(block, F.explode(F.when(hi.col > lo.col, F.sequence(lo.col, hi.col - 1, F.lit(BLOCK)))))
        df = df.withColumn(c.internal, F.explode(F.sequence(F.col(block), F.least(F.col(block) + (BLOCK - 1), hi.col - 1)))).drop(block)
        out = Relation(df, [*left.cols, c], left.time, left.seq, None, left.window)
        return dataclasses.replace(out, df=out.df.filter(self.truth(j.on, Scope(out, scope.outer, scope.ctes)).col)) if j.on is not None else out

    def key(self, a: Expr, b: Expr) -> Column:
        return compare("<=>" if self.compat else "=", a, b, self.compat).col

    def side(self, e: object, left: Relation, right: Relation) -> str:
        """Which input the columns of e come from: l, r, both or none."""
        seen = set()
        for n in walk(e):
            if isinstance(n, (A.Sub, A.Exists)):
                return "both"
            if isinstance(n, A.Name):
                l, r = left.find(n.name, n.qualifier), right.find(n.name, n.qualifier)
                seen.add("l" if l else "r" if r else "?")
        return seen.pop() if len(seen) == 1 else "both" if seen else "none"

    def condition(self, e: object, left: Relation, right: Relation, both: Scope) -> Column:
        if isinstance(e, A.Call) and e.name == "=" and {self.side(a, left, right) for a in e.args} == {"l", "r"}:
            return self.key(*[self.expr(a, both) for a in e.args])
        return self.truth(e, both).col

    def outer_condition(self, on: object, left: Relation, right: Relation, scope: Scope) -> Column:
        parts = []
        for e in conjuncts(on):
            if not (isinstance(e, A.Call) and e.name == "=" and len(e.args) == 2):
                raise QueryError(OUTER)
            sides = [self.side(a, left, right) for a in e.args]
            if sorted(sides) != ["l", "r"]:
                raise QueryError(f"{OUTER}, each side using one table")
            parts.append(self.key(*[self.expr(a, Scope(left if s == "l" else right, scope.outer, scope.ctes)) for a, s in zip(e.args, sides, strict=True)]))
        return functools.reduce(lambda a, b: a & b, parts)

    # table-valued functions

    def argument(self, t: A.Function, name: str, default: object = None, needed: bool = False) -> object:
        if needed and name not in t.args:
            raise QueryError(f"{t.name} needs the argument {name}")
        return t.args.get(name, default)

    def source(self, t: A.Function, scope: Scope) -> Relation:
        arg = self.argument(t, "source", needed=True)
        if not isinstance(arg, A.TableArg):
            raise QueryError(f"source of {t.name} must be TABLE(...)")
        return self.table(arg.table, scope)

    def time_of(self, t: A.Function, rel: Relation, needed: bool) -> str:
        arg = self.argument(t, "time_field", needed=needed)
        if arg is None:
            if rel.time is None:
                raise QueryError(f"{t.name}: the source has no time field, so time_field is needed")
            return rel.time
        if not isinstance(arg, A.Descriptor):
            raise QueryError(f"time_field of {t.name} must be DESCRIPTOR(column)")
        c = rel.find(arg.name.name, arg.name.qualifier)
        if c is None:
            raise QueryError(f"unknown column {arg.name.name}")
        if c.type.kind != "Time":
            raise QueryError(f"time_field must be a Time, not {c.type}")
        return c.internal

    def function(self, t: A.Function, scope: Scope) -> Relation:
        known = {"range": {"start", "end"}, "tumble": {"source", "window_length", "time_field", "offset"}, "max_diff_watermark": {"source", "max_diff", "time_field", "resolution"}, "poll": {"source", "poll_interval"}}
        if t.name not in known:
            raise QueryError(f"unknown table valued function: {t.name}")
        if extra := set(t.args) - known[t.name]:
            raise QueryError(f"{t.name} has no argument {', '.join(sorted(extra))}")
        if t.name == "range":
            return self.range(t, scope)
        rel = self.source(t, scope)
        if t.name == "poll":
            us = micros_of(self.argument(t, "poll_interval", A.Interval(1, "s")))
            c = Col(None, "time", fresh("time"), TIME)
            self.poll_us = us if self.poll_us is None else min(us, self.poll_us)
            return Relation(rel.df.withColumn(c.internal, F.current_timestamp()), [c, *rel.cols], c.internal, rel.seq)
        time = self.time_of(t, rel, t.name == "max_diff_watermark")
        if t.name == "max_diff_watermark":
            diff, step = micros_of(self.argument(t, "max_diff", needed=True)), micros_of(self.argument(t, "resolution", A.Interval(1, "s")))
            if rel.df.isStreaming:
                return dataclasses.replace(rel, df=rel.df.withWatermark(time, f"{diff} microseconds"), time=time)
            df, seq, _ = replay.drop_late(rel.df, time, rel.seq, self.duration(diff), self.duration(step))
            return dataclasses.replace(rel, df=df, time=time, seq=seq)
        length, offset = micros_of(self.argument(t, "window_length", needed=True)), micros_of(self.argument(t, "offset", A.Interval(0, "s")))
        if length <= 0:
            raise QueryError("window_length must be positive")
        start, end = Col(None, "window_start", fresh("window_start"), TIME), Col(None, "window_end", fresh("window_end"), TIME)
        if rel.df.isStreaming:
            window = fresh("window")
            origin = (offset - 62_135_596_800_000_000) % length
            df = rel.df.withColumn(window, F.window(time, f"{length} microseconds", f"{length} microseconds", f"{origin} microseconds"))
            df = df.withColumn(start.internal, F.col(window)["start"]).withColumn(end.internal, F.col(window)["end"])
            return Relation(df, [*rel.cols, start, end], end.internal, rel.seq, None, window)
        df = rel.df.withColumn(start.internal, replay.tumbling(F.col(time), length, offset)).withColumn(end.internal, F.timestamp_micros(F.unix_micros(start.internal) + length))
        return Relation(df, [*rel.cols, start, end], end.internal, rel.seq)

    def duration(self, us: int) -> Column:
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(us).cast("decimal(24,0)").cast("decimal(24,6)") / 1_000_000)

    def range(self, t: A.Function, scope: Scope) -> Relation:
        bounds = [self.argument(t, n, needed=True) for n in ("start", "end")]
        c = Col(None, "i", fresh("i"), INT)
        if all(isinstance(b, A.Lit) and isinstance(b.value, int) for b in bounds):
            lo, hi = (b.value for b in bounds)
            return Relation(self.spark.range(lo, max(lo, hi)).select(F.col("id").alias(c.internal)), [c])
        lo, hi = (self.expr(b, Scope(None, None, scope.ctes)) for b in bounds)
        if {lo.type.kind, hi.type.kind} != {"Int"}:
            raise QueryError("range needs Int bounds")
        # without columns the bounds are constants: one row tells them, and Spark deals the numbers to tasks
        lo, hi = self.spark.range(1).select(lo.col, hi.col).first()
        if lo is None or hi is None:
            lo = hi = 0
        return Relation(self.spark.range(lo, max(lo, hi)).select(F.col("id").alias(c.internal)), [c])

    # expressions

    def column(self, e: A.Name, scope: Scope) -> Col | None:
        return scope.relation.find(e.name, e.qualifier) if scope.relation else None

    def name(self, e: A.Name, scope: Scope) -> Expr:
        c = self.column(e, scope)
        if c is not None:
            return c.expr
        outer = scope.outer
        while outer is not None:
            c = self.column(e, outer)
            if c is not None:
                return Expr(F.col(c.internal).outer(), c.type)
            outer = outer.outer
        # a.b may also be field b of object a
        if e.qualifier and "." not in e.qualifier:
            try:
                return field_of(self.name(A.Name(e.qualifier), scope), e.name)
            except QueryError:
                pass
        raise QueryError(f"unknown variable: {f'{e.qualifier}.' if e.qualifier else ''}{e.name}")

    def as_boolean(self, e: Expr) -> Expr:
        if e.type.kind == "Null":
            return Expr(F.lit(None).cast("boolean"), optional(BOOLEAN))
        if e.type.kind != "Boolean":
            raise QueryError(f"expected Boolean, got {e.type}")
        return e

    def truth(self, e: object, scope: Scope) -> Expr:
        return self.as_boolean(self.expr(e, scope))

    def expr(self, e: object, scope: Scope, into: Callable[[object], Expr] | None = None) -> Expr:
        """into: how the parts are evaluated, where that is not in the scope itself."""
        sub = into or (lambda x: self.expr(x, scope))
        if isinstance(e, A.Name):
            return self.name(e, scope)
        if isinstance(e, A.Lit):
            v = e.value
            if v is None:
                return Expr(F.lit(None), NULL)
            t = BOOLEAN if isinstance(v, bool) else INT if isinstance(v, int) else FLOAT if isinstance(v, float) else STRING
            return Expr(F.lit(v).cast(to_spark(t)), t, v)
        if isinstance(e, A.Interval):
            return Expr(self.duration(micros_of(e)), DURATION)
        if isinstance(e, A.Logic):
            a, b = self.as_boolean(sub(e.left)), self.as_boolean(sub(e.right))
            t = optional(BOOLEAN) if a.type.nullable or b.type.nullable else BOOLEAN
            return Expr(a.col & b.col if e.op == "and" else a.col | b.col, t)
        if isinstance(e, A.Is):
            own = sub(e.value)
            if e.what == "null":
                return call("is not null" if e.negated else "is null", [own], self.compat)
            same = self.as_boolean(own).col.eqNullSafe(F.lit(e.what == "true"))
            return Expr(~same if e.negated else same, BOOLEAN)
        if isinstance(e, A.Assert):
            return assertion(sub(e.value), e.type)
        if isinstance(e, A.Field):
            return field_of(sub(e.value), e.name)
        if isinstance(e, A.TupleOf):
            parts = [sub(x) for x in e.items]
            return Expr(F.struct(*[p.col.alias(f"_{i + 1}") for i, p in enumerate(parts)]), Type("Tuple", fields=tuple((f"_{i + 1}", p.type) for i, p in enumerate(parts))))
        if isinstance(e, A.In):
            return self.membership(e, scope, sub)
        if isinstance(e, A.Case):
            return self.case(e, sub)
        if isinstance(e, A.Exists):
            return Expr(self.query(e.query, Scope(None, scope if scope.relation else scope.outer, scope.ctes)).df.exists(), BOOLEAN)
        if isinstance(e, A.Sub):
            return self.listed(e, scope)
        if isinstance(e, A.Call):
            if self.is_aggregate(e):
                raise QueryError(f"aggregate {e.name} is not allowed here")
            if e.name == "unnest":
                raise QueryError("unnest is allowed as a selected expression only")
            if e.name == "coalesce" and not e.args:
                raise QueryError("coalesce needs an argument")
            return call(e.name, [sub(a) for a in e.args], self.compat, self.catalog.functions)
        raise QueryError(f"unsupported expression {e}")

    def case(self, e: A.Case, sub: Callable[[object], Expr]) -> Expr:
        tests = [sub(t) if e.operand is None else sub(A.Call("=", (e.operand, t))) for t, _ in e.whens]
        values = [sub(v) for _, v in e.whens] + [sub(e.other)]
        t = functools.reduce(type_sum, [v.type for v in values])
        if t.kind == "Union" and {a.kind for a in t.alts} == {"Int", "Float"} and not self.compat:
            t = Type("Float", t.nullable)
        out = convert(values[-1].col, values[-1].type, t)
        for test, v in reversed(list(zip(tests, values[:-1], strict=True))):
            out = F.when(self.as_boolean(test).col, convert(v.col, v.type, t)).otherwise(out)
        return Expr(out, t)

    def listed(self, e: A.Sub, scope: Scope) -> Expr:
        """A subquery as a value: the list of its rows."""
        rel = self.query(e.query, Scope(None, scope if scope.relation else scope.outer, scope.ctes))
        if len(rel.cols) == 1:
            elem, item = rel.cols[0].type, F.col(rel.cols[0].internal)
        else:
            elem = Type("Struct", fields=tuple((c.name, c.type) for c in rel.cols))
            item = F.struct(*[F.col(c.internal).alias(c.name) for c in rel.cols])
        # collect_list drops NULLs, a one-field struct around the value keeps them
        boxed = F.collect_list(F.struct(item.alias("x")))
        return Expr(rel.df.select(F.transform(boxed, lambda x: x["x"]).alias("l")).scalar(), list_of(elem))

    def membership(self, e: A.In, scope: Scope, sub: Callable[[object], Expr]) -> Expr:
        if isinstance(e.options, A.Sub):
            rel = self.query(e.options.query, Scope(None, scope if scope.relation else scope.outer, scope.ctes))
            if len(rel.cols) != 1:
                raise QueryError("IN needs a subquery of one column")
            own = sub(e.value)
            # as EXISTS, so that a filter becomes a semi or anti join
            there = self.expr(e.value, Scope(None, scope if scope.relation else scope.outer, scope.ctes))
            found = rel.df.filter(compare("=", rel.cols[0].expr, there, self.compat).col).exists()
            if not own.type.nullable:
                return Expr(~found if e.negated else found, BOOLEAN)
            if not e.negated:
                return Expr(found & F.coalesce(own.col.isNotNull(), F.lit(False)), BOOLEAN)
            return Expr(~found & own.col.isNotNull(), BOOLEAN)
        return call("not in" if e.negated else "in", [sub(e.value), sub(e.options)], self.compat)


def output(rel: Relation) -> tuple[DataFrame, list[tuple[str, Type]]]:
    """The frame under its public names: a column's own name, qualified where several share it."""
    names = [c.name for c in rel.cols]
    public = []
    for c in rel.cols:
        full = f"{c.qualifier}.{c.name}" if names.count(c.name) > 1 and c.qualifier else c.name
        n, k = full, 1
        while n in public:
            n, k = f"{full}_{k}", k + 1
        public.append(n)
    return rel.df.select(*[F.col(c.internal).alias(p) for c, p in zip(rel.cols, public, strict=True)]), list(zip(public, [c.type for c in rel.cols], strict=True))
