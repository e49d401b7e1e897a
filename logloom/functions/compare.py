"""Typed comparison and filter expressions.

Values of different types never compare: the result is false, not a cast, and a missing variable makes a comparison
false (so ``!=`` is false too, and ``!(...)`` of it true).
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Value

_TOKEN = re.compile(r"\s*(?:(?P<op>&&|\|\||==|!=|>=|<=|=\*|[><!()])|(?P<var>\$[\w./\-]+)|(?P<const>[A-Za-z_]+\((?:\"(?:\\.|[^\"\\])*\"|'[^']*'|[^)]*)\))|(?P<isset>isset\(\s*\$[\w./\-]+\s*\)))")


class FilterError(ValueError):
    pass


def glob(pattern: str) -> str:
    """A wildcard pattern (* and ?) as an anchored regular expression."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def compare(v: Value | None, op: str, kind: str, text: str) -> Column:
    if v is None:
        return F.lit(False)
    c = v.column
    if kind in ("digit", "float"):
        if v.kind != kind:
            return F.lit(False)
        k = F.lit(int(text) if kind == "digit" else float(text))
        if op == "=*":
            return F.coalesce(c == k if kind == "digit" else F.abs(c - k) < 1e-4, F.lit(False))
    elif kind == "bool":
        if v.kind != "bool":
            return F.lit(False)
        k = F.lit(text.lower() == "true")
    elif kind == "ip":
        if v.kind != "ip":
            return F.lit(False)
        from .net import ip4_int

        c, k = ip4_int(c), ip4_int(F.lit(text))
    elif kind == "ip_net":
        if v.kind not in ("ip", "ip_net", "chars") or op not in ("==", "!="):
            return F.lit(False)
        k = F.lit(text)
    elif kind == "time":
        if v.kind != "time":
            return F.lit(False)
        k = F.lit(text).cast("timestamp_ntz")
    else:
        if v.kind not in ("chars", "auto"):
            return F.lit(False)
        if op == "=*":
            return F.coalesce(c.rlike(glob(text)), F.lit(False))
        k = F.lit(text)
    made = {"==": c == k, "!=": c != k, ">": c > k, ">=": c >= k, "<": c < k, "<=": c <= k, "=*": c == k}[op]
    return F.coalesce(made, F.lit(False))


def filter_expression(text: str, fields: Mapping[str, Value]) -> Column:
    """``$a == chars(x) && !($b > digit(3)) || isset($c)`` as a Boolean column that is never null.

    Precedence: ``!``, then ``&&``, then ``||``; parentheses group.
    """
    tokens, at = [], 0
    body = text.strip()
    iss = re.compile(r"\s*isset\(\s*\$([\w./\-]+)\s*\)")
    while at < len(body):
        if m := iss.match(body, at):
            tokens.append(("isset", m[1]))
        elif m := _TOKEN.match(body, at):
            tokens.append((m.lastgroup, m[m.lastgroup]))
        else:
            raise FilterError(f"cannot read {body[at : at + 20]!r}")
        at = m.end()
    place = 0

    def peek(value: str) -> bool:
        return place < len(tokens) and tokens[place] == ("op", value)

    def either() -> Column:
        nonlocal place
        out = both()
        while peek("||"):
            place += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal place
        out = one()
        while peek("&&"):
            place += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal place
        if peek("!"):
            place += 1
            return ~one()
        if peek("("):
            place += 1
            out = either()
            if not peek(")"):
                raise FilterError("a ) is missing")
            place += 1
            return out
        if place < len(tokens) and tokens[place][0] == "isset":
            name = tokens[place][1]
            place += 1
            return fields[name].column.isNotNull() if name in fields else F.lit(False)
        if place + 2 >= len(tokens) or tokens[place][0] != "var" or tokens[place + 1][0] != "op" or tokens[place + 2][0] != "const":
            raise FilterError(f"a comparison is expected after {tokens[:place]}")
        name, op, const = tokens[place][1][1:], tokens[place + 1][1], tokens[place + 2][1]
        place += 3
        kind, value = const[:-1].split("(", 1)
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        return compare(fields.get(name), op, kind, value)

    out = either()
    if place != len(tokens):
        raise FilterError(f"unexpected {tokens[place][1]}")
    return out


def record(df) -> dict[str, Value]:
    """The columns of a frame as typed values."""
    from .values import kind_of

    return {f.name: Value(F.col(f"`{f.name}`"), kind_of(f.dataType)) for f in df.schema.fields}
