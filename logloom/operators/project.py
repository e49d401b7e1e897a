"""Applies object models: a model becomes projections and lookup joins, item by item from left to right.

``read`` sees what has been produced, then the source; ``take`` sees the source only and uses it up. Absent values are
null. A model over plain columns has a fixed schema; over a parsed frame, name the fields first (``field_columns``).
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import SQL_FUNCTIONS
from ..functions.values import FUNCTIONS, Value, constant, convert, kind_of
from ..plans.models import Collect, Cond, Const, Fmt, Get, Item, Match, Model, ModelError, Now, Obj, Pipe, Select, Symbol, parse_model
from .lookup import Knowledge, lookup


def field_columns(df: DataFrame, fields: Mapping[str, str], parsed: str = "parsed", extras: str | None = None) -> DataFrame:
    """Named fields of a parsed frame as typed columns (name -> type), and the others in a map column ``extras``."""
    from .parse import field

    out = df.select("*", *[field(n, k, parsed).alias(n) for n, k in fields.items()])
    if extras:
        names = F.array(*[F.lit(n) for n in fields]) if fields else F.array().cast("array<string>")
        others = F.filter(F.col(f"{parsed}.fields"), lambda x: ~F.array_contains(names, x["name"]) & x["value"].isNotNull())
        first = F.filter(others, lambda x, i: F.array_position(F.transform(others, lambda y: y["name"]), x["name"]) == i + 1)
        out = out.withColumn(extras, F.map_from_entries(F.transform(first, lambda x: F.struct(x["name"], x["value"]))))
    return out.drop(parsed)


class _Scope:
    def __init__(self, df: DataFrame, now: Column):
        self.df, self.now = df, now
        self.source = {f.name: Value(F.col(f"`{f.name}`"), kind_of(f.dataType), _members(f.dataType)) for f in df.schema.fields}
        self.out: dict[str, Value] = {}
        self.statics: dict[str, Value] = {}
        self.failed: dict[str, Column] = {}

    def find(self, name: str, verb: str) -> Value | None:
        name = name.lstrip("/") if name not in self.source else name
        if verb == "read" and name in self.out:
            return self.out[name]
        if verb == "read" and name in self.statics:
            return self.statics[name]
        return self.source.get(name)


def _members(data) -> tuple:
    return tuple((f.name, Value(F.lit(None), kind_of(f.dataType), _members(f.dataType))) for f in getattr(data, "fields", ()))


def _get(s: _Scope, g: Get, target: str) -> Value | None:
    if g.option:
        found = [(n, v) for n in g.option if (v := s.find(n, g.verb)) is not None]
        got = None
        if found:
            kind = found[0][1].kind if len({v.kind for _, v in found}) == 1 else "chars"
            columns = [convert(v, kind).column for _, v in found]
            filled = [F.nullif(c, F.lit("")) if kind in ("chars", "auto") else c for c in columns]
            got = Value(F.coalesce(*filled), kind)
            if g.verb == "take":  # only the alternative that gave the value is used up
                for i, (n, v) in enumerate(found):
                    if v is s.source.get(n):
                        earlier = [f.isNotNull() for f in filled[:i]]
                        unused = F.lit(False)
                        for e in earlier:
                            unused = unused | e
                        s.source[n] = Value(F.when(unused | filled[i].isNull(), v.column), v.kind, v.members)
    else:
        name = g.name or target
        got = s.find(name, g.verb)
        if g.verb == "take":
            s.source.pop(name.lstrip("/") if name not in s.source else name, None)
    if g.default is None:
        return got
    fallback = _value(s, g.default, target)
    if got is None or fallback is None:
        return got if fallback is None else fallback
    if got.kind != fallback.kind:
        fallback = convert(fallback, got.kind) if fallback.kind == "chars" else fallback
        if got.kind != fallback.kind:
            got, fallback = (convert(got, fallback.kind), fallback) if got.kind in ("chars", "auto") else (convert(got, "chars"), convert(fallback, "chars"))
    return Value(F.coalesce(got.column, fallback.column), got.kind, got.members)


def _keys(s: _Scope, g: Get) -> list[tuple[str, Value]]:
    names = list(dict.fromkeys([*(s.out if g.verb == "read" else ()), *s.source]))
    wanted = g.keys or g.option or ((g.name,) if g.name else ())
    out = []
    for pattern in wanted:
        for n in names if "*" in pattern else [pattern]:
            if fnmatchcase(n, pattern) and n not in [x for x, _ in out] and (v := s.find(n, g.verb)) is not None:
                out.append((n, v))
                if g.verb == "take":
                    s.source.pop(n, None)
    return out


def _array(values: list[Value]) -> Value | None:
    if not values:
        return None
    kinds = {v.kind for v in values}
    columns = [v.column if len(kinds) == 1 else convert(v, "chars").column for v in values]
    made = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return Value(F.when(F.size(made) > 0, made), "array")


def _value(s: _Scope, e: object, target: str) -> Value | None:
    if isinstance(e, Get):
        return _array([v for _, v in _keys(s, e)]) if e.keys else _get(s, e, target)
    if isinstance(e, Const):
        return constant(e.kind, e.text)
    if isinstance(e, Symbol):
        return s.statics.get(e.name) or s.find(e.name, "read")
    if isinstance(e, Now):
        if e.what == "time":
            return Value(s.now.cast("timestamp_ntz"), "time")
        return Value(F.date_format(s.now, "yyyyMMdd" if e.what == "date" else "yyyyMMddHH").cast("bigint"), "digit")
    if isinstance(e, Pipe):
        v = _value(s, e.source, target)
        for name, args, quoted in e.calls:
            if name not in FUNCTIONS:
                raise ModelError(f"unknown function {name}")
            if v is not None:
                v = FUNCTIONS[name](v, *args, quoted) if name == "map_to" else FUNCTIONS[name](v, *args)
        return v
    if isinstance(e, Fmt):
        return _fmt(s, e, target)
    if isinstance(e, Obj):
        members = []
        for name, kind, value in e.members:
            v = _value(s, value, name)
            if v is not None:
                members.append((name, convert(v, kind)))
        return Value(F.struct(*[v.column.alias(n) for n, v in members]), "obj", tuple(members)) if members else None
    if isinstance(e, Collect):
        if e.source.keys or e.source.option:
            return _array([v for _, v in _keys(s, e.source)])
        v = _get(s, e.source, target)
        return v if v is None or v.kind == "array" else _array([v])
    if isinstance(e, Match):
        return _match(s, e, target)
    raise ModelError(f"unknown expression {e}")


def _fmt(s: _Scope, e: Fmt, target: str) -> Value:
    values = {}
    order = []
    for i, g in enumerate(e.args):
        v = _get(s, g, target)
        values[g.name or str(i)] = v
        order.append(v)
    at = iter(order)
    parts, every = [], F.lit(True)
    for piece in re.split(r"(\{[\w./\-]*\})", e.template):
        if re.fullmatch(r"\{[\w./\-]*\}", piece):
            v = next(at, None) if piece == "{}" else values.get(piece[1:-1])
            text = convert(v, "chars").column if v is not None else F.lit(None).cast("string")
            every = every & text.isNotNull()
            parts.append(text)
        elif piece:
            parts.append(F.lit(piece))
    return Value(F.when(every, F.concat(*parts)).otherwise(F.lit("")) if parts else F.lit(""), "chars")


def _condition(s: _Scope, v: Value, c: Cond) -> Column:
    column = v.column

    def same(k: Value) -> bool:
        return v.kind == k.kind or v.kind == "auto" or {v.kind, k.kind} == {"chars", "ip"} and k.kind == "ip"

    if c.op == "eq" or c.op == "ne":
        k = c.args[0]
        k = constant(k.kind, k.text) if isinstance(k, Const) else s.statics[k.name] if k.name in s.statics else None
        if k is None:
            raise ModelError(f"unknown static {c.args[0]}")
        made = (column == k.column if c.op == "eq" else column != k.column) if same(k) else F.lit(False)
    elif c.op == "in":
        low, high = (constant(k.kind, k.text) for k in c.args)
        if not same(low):
            made = F.lit(False)
        elif low.kind == "ip":
            made = SQL_FUNCTIONS["ip4_int"](column).between(SQL_FUNCTIONS["ip4_int"](low.column), SQL_FUNCTIONS["ip4_int"](high.column))
        else:
            made = column.between(low.column, high.column)
    else:
        made = _function(v, c)
    return F.coalesce(made, F.lit(False))


def _function(v: Value, c: Cond) -> Column:
    column, name, args = v.column, c.name, c.args
    if name in ("gt", "lt", "eq", "in_range"):
        if v.kind not in ("digit", "float", "chars", "auto"):
            return F.lit(False)
        n = column.cast("double") if v.kind in ("digit", "float") else F.trim(column).try_cast("double")
        a = float(args[0])
        return {"gt": n > a, "lt": n < a, "eq": F.abs(n - a) < 1e-10, "in_range": n.between(a, float(args[-1]))}[name]
    if v.kind not in ("chars", "auto"):
        return F.lit(False)
    if name == "regex_match":
        if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", args[0]):
            raise ModelError("look-around and back-references are not supported in patterns")
        try:
            re.compile(args[0])
        except re.error:
            return F.lit(False)
        return column.rlike(args[0])
    if name == "is_empty":
        return column == ""
    return {"starts_with": column.startswith, "ends_with": column.endswith, "contains": column.contains, "iequals": lambda x: F.lower(column) == x.lower()}[name](args[0])


def _match(s: _Scope, e: Match, target: str) -> Value | None:
    sources = [_get(s, g, target) for g in e.sources]
    default = _value(s, e.default, target) if e.default is not None else None
    results = [_value(s, r, target) for _, r in e.cases]
    if any(v is None for v in sources):
        return default
    here = F.lit(True)
    for v in sources:
        here = here & v.column.isNotNull()
    arms = []
    for (conds, _), r in zip(e.cases, results, strict=True):
        if r is None:
            continue
        met = here
        for v, alternatives in zip(sources, conds, strict=True):
            one = F.lit(False)
            for c in alternatives:
                one = one | _condition(s, v, c)
            met = met & one
        arms.append((met, r))
    kinds = {r.kind for _, r in arms} | ({default.kind} if default is not None else set())
    kind = kinds.pop() if len(kinds) == 1 else "chars"
    out = None
    for met, r in arms:
        c = convert(r, kind).column
        out = F.when(met, c) if out is None else out.when(met, c)
    if out is None:
        return default
    return Value(out.otherwise(convert(default, kind).column) if default is not None else out, kind)


def apply_model(df: DataFrame, model: Model | str, knowledge: Knowledge | None = None, now: Column | None = None, keep: tuple[str, ...] = (), failed: str | None = None) -> DataFrame:
    """The model's targets as columns, after the columns ``keep`` of the input.

    A value that its declared type cannot take is null, since a column has one type; with ``failed`` a last column of that
    name maps the targets where it happened to the text that was there (empty where all is well).

    ``now`` stands for the clock (default: the local time of the query). Targets whose names begin with two underscores
    can be read later and are not in the result. Of equal targets the first wins. A wildcard target copies what is left
    of the source and not yet produced; with a type, it takes columns of that type.
    """
    model = parse_model(model) if isinstance(model, str) else model
    s = _Scope(df, now if now is not None else F.localtimestamp())
    for item in model.statics:
        for t in item.targets:
            v = _value(s, item.value, t.name)
            if v is not None:
                s.statics[t.name] = convert(v, t.kind)
    for n, item in enumerate(model.items):
        _item(s, item, n, knowledge)
    shown = {n: v for n, v in s.out.items() if not n.startswith("__")}
    lost = [F.map_filter(F.create_map(*[x for n, c in s.failed.items() for x in (F.lit(n), c)]) if s.failed else F.create_map().cast("map<string,string>"), lambda _, t: t.isNotNull()).alias(failed)] if failed else []
    return s.df.select(*[F.col(f"`{c}`") for c in keep], *[v.column.alias(n) for n, v in shown.items()], *lost)


def _put(s: _Scope, target, v: Value) -> None:
    """A target's value in its declared type, and the text of values that do not fit."""
    if target.name in s.out:
        return
    made = convert(v, target.kind)
    s.out[target.name] = made
    if made is not v and v.kind in ("chars", "auto") and target.kind != "chars":
        s.failed[target.name] = F.when(made.column.isNull(), v.column.cast("string"))


def _item(s: _Scope, item: Item, n: int, knowledge: Knowledge | None) -> None:
    first = item.targets[0]
    if isinstance(item.value, Select):
        if knowledge is None:
            raise ModelError("a lookup needs a knowledge store")
        s.df, made = lookup(s.df, item.value, knowledge, lambda g: _get(s, g, first.name), f"_l{n}", lambda e: _value(s, e, first.name))
        for t, v in zip(item.targets, made, strict=False):
            _put(s, t, v)
        return
    if "*" in first.name:
        verb = item.value.verb if isinstance(item.value, Get) else "take"
        for name in list(s.source):
            v = s.source[name]
            matches = fnmatchcase(name, first.name) or (first.kind not in (None, "auto") and v.kind == first.kind)
            if matches and first.kind not in (None, "auto") and v.kind != first.kind and first.name == "*":
                matches = False
            if matches and name not in s.out:
                s.out[name] = v
                if verb == "take":
                    s.source.pop(name)
        return
    for t in item.targets:
        v = _value(s, item.value, t.name)
        if t.name == "_" or v is None:
            continue
        _put(s, t, v)
