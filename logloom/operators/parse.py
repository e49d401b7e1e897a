"""Applies parse rules to a DataFrame of payloads.

Regular rules (plain sequences of fields that stop at their own pattern or at a literal separator) become one anchored
regular expression, matched once a row inside the JVM. Other rules, and rows that no regular rule takes whole, go
through the general evaluator in Arrow batches. Both give one struct column.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import step
from ..plans.rules import Field, Rule, Separator, parse_rules
from .interpret import choose

ITEM = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
PARSED = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("fields", T.ArrayType(ITEM)),
        T.StructField("residue", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
_MARK = "\x1f"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Patterns of types whose matched text is already their canonical value.
_NATIVE = {
    "sn": "[A-Za-z0-9-]+",
    "digit": "(?:0|-?[1-9][0-9]{0,17})(?![0-9])",
    "port": "(?:0|[1-9][0-9]{0,17})(?![0-9])",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Fa-f:.])",
    "http/status": "[1-9][0-9]{2}(?![0-9])",
    "http/method": "GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|TRACE|CONNECT",
    "http/request": r"(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|TRACE|CONNECT) [^\s\x1f]+ HTTP/[0-9]+(?:\.[0-9]+)?",
    "bool": "true|false",
}
_CLF = r"\[?([0-9]{2})/(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/([0-9]{4}):([0-9]{2}:[0-9]{2}:[0-9]{2}) [+-][0-9]{4}\]?"


def native_pattern(rule: Rule) -> tuple[str, list[Field], list[int]] | None:
    """The anchored regex of a regular rule, its fields in order, and the first capture group of each (0: no value)."""
    out, fields, groups, at = "^", [], [], 1
    for g in rule.groups:
        if g.kind != "seq":
            return None
        for f in g.fields:
            if f.repeat is None or f.pipes or f.subs:
                return None
            sep = f.sep or g.sep or Separator(" ")
            if sep.literal is None or sep.literal == "\\S" or len(sep.literal) != 1:
                return None
            for _ in range(f.repeat):
                piece = _piece(f, sep)
                if piece is None:
                    return None
                text, captures = piece
                out += text
                fields.append(f)
                groups.append(at if captures else 0)
                at += captures
    return out + "$", fields, groups


def _piece(f: Field, sep: Separator) -> tuple[str, int] | None:
    stop = "" if sep.literal == "\0" else f"(?:{re.escape(sep.literal)})?"
    end = "(?=$)" if sep.literal == "\0" else f"(?:{re.escape(sep.literal)}|$)"
    lead = " *" if f.kind not in ("_", "chars") or sep.literal != "\0" else ""
    if f.kind == "symbol":
        return f"{lead}{re.escape(f.symbol or '')}{stop}", 0
    if f.scope:
        b, e = f.scope
        # possessive loops: Java's matcher runs them in place, where a plain repeated alternative takes a stack frame a turn
        quoted = len(e) == 1 and b == e
        inner = rf"(?:[^{re.escape(e)}\\\x1f]++|\\.)*+" if quoted else rf"[^{re.escape(b + e)}\x1f]*" if len(b) == len(e) == 1 else None
        if inner is None:
            return None
        if f.kind == "_":
            return f"{lead}{re.escape(b)}{inner}{re.escape(e)}{stop}", 0
        if f.kind == "chars":
            return f"{lead}{re.escape(b)}({inner}){re.escape(e)}{stop}", 1
        if f.kind == "http/agent":
            if " " in (b, e):
                return None
            # blanks before the end are not part of the value
            within = rf"(?:[^ {re.escape(e)}\\\x1f]++|\\.| ++(?!{re.escape(e)}))*+" if quoted else rf"(?:[^ {re.escape(b + e)}\x1f]++| ++(?!{re.escape(e)}))*+"
            return rf"{lead}{re.escape(b)} *(Mozilla/[0-9]{within}) *{re.escape(e)}{stop}", 1
        if f.kind == "time/clf":
            return f"{lead}{re.escape(b)}{_CLF}{re.escape(e)}{stop}", 4
        if f.kind in _NATIVE:
            return f"{lead}{re.escape(b)} *({_NATIVE[f.kind]}) *{re.escape(e)}{stop}", 1
        return None
    if f.kind == "time/clf":
        return f"{lead}{_CLF}{stop}", 4
    if f.kind in ("chars", "_"):
        if sep.literal == "\0":
            return None
        body = rf"[^{re.escape(sep.literal)}\"'\x1f\s][^{re.escape(sep.literal)}\x1f]*" if f.kind == "chars" else rf"[^{re.escape(sep.literal)}\"'\x1f][^{re.escape(sep.literal)}\x1f]*"
        return (f"{lead}({body}){end}", 1) if f.kind == "chars" else (f"{lead}{body}{end}", 0)
    if f.kind in _NATIVE:
        return f"{lead}({_NATIVE[f.kind]}){stop}", 1
    return None


def native_captures(rule: Rule, payload: Column) -> Column | None:
    """The captures of a regular rule as an array (the first element is empty), null where it does not take the payload
    whole; None if the rule is not regular.

    One run of the expression does both: a payload that it matches comes back with marks between its captures.
    """
    made = native_pattern(rule)
    if made is None:
        return None
    pattern, fields, groups = made
    text = payload
    for name in rule.steps:
        text = step(name).column(text)
    marked = F.regexp_replace(text, pattern, _MARK + _MARK.join(f"${i}" for i in range(1, _captures(fields, groups) + 1)))
    plain = ~F.contains(text, F.lit(_MARK)) & ~F.contains(text, F.lit("\n"))
    return F.when(plain & marked.startswith(_MARK), F.split(marked, _MARK, -1))


def _captures(fields: list[Field], groups: list[int]) -> int:
    return max((g + (3 if f.kind == "time/clf" else 0) for f, g in zip(fields, groups, strict=True)), default=0)


def native_struct(rule: Rule, payload: Column) -> Column | None:
    """The parsed struct of a regular rule, null where the rule does not take the payload; None if it is not regular.

    The captures are bound to a lambda's variable: the optimizer would else copy their expression into every field.
    """
    captures = native_captures(rule, payload)
    if captures is None:
        return None
    return F.get(F.transform(F.array(captures), lambda c: _struct(rule, payload, c)), F.lit(0))


def _struct(rule: Rule, payload: Column, captures: Column) -> Column:
    _, fields, groups = native_pattern(rule)
    value = lambda i: F.get(captures, F.lit(i))
    items = []
    for f, g in zip(fields, groups, strict=True):
        v: Column
        if f.kind == "symbol":
            v = F.lit(f.symbol or "")
        elif not g:
            v = F.lit(None).cast("string")
        elif f.kind == "time/clf":
            months = F.create_map(*[x for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])
            v = F.concat(value(g + 2), F.lit("-"), F.element_at(months, value(g + 1)), F.lit("-"), value(g), F.lit(" "), value(g + 3))
        elif f.kind == "http/agent":
            v = F.concat(F.rtrim(value(g)), F.lit(" "))
        elif f.kind == "chars":
            v = F.trim(value(g))
        else:
            v = value(g)
        kind = "chars" if f.kind == "symbol" else f.kind
        items.append(F.struct(F.lit(f.label).alias("name"), F.lit(kind).alias("type"), v.alias("value")))
    for k, v in rule.tags:
        items.append(F.struct(F.lit(k).alias("name"), F.lit("chars").alias("type"), F.lit(v).alias("value")))
    if rule.copy_raw:
        items.append(F.struct(F.lit(rule.copy_raw).alias("name"), F.lit("chars").alias("type"), payload.alias("value")))
    found = F.struct(F.lit("ok").alias("status"), F.lit(rule.key).alias("rule"), F.array(*items).alias("fields"), F.lit("").alias("residue"), F.lit(None).cast("string").alias("error"))
    return F.when(captures.isNotNull(), found)


def parse_events(df: DataFrame, rules: str | list[Rule], payload: str = "payload", into: str = "parsed", native: bool = True) -> DataFrame:
    """Adds ``into``: status (ok, residue, miss or blank), rule, fields (name, type, value), residue and error.

    Rules are tried in their order. A null payload is blank. ``native=False`` sends every row through the general
    evaluator.
    """
    rules = parse_rules(rules) if isinstance(rules, str) else list(rules)
    for r in rules:
        for name in r.steps:
            step(name)
    quick = []
    for r in rules if native else ():
        made = native_struct(r, F.col(f"`{payload}`"))
        if made is None:
            break
        quick.append(made)
    if not quick:
        return _general(df, rules, payload, into)
    return _general(df.withColumn(into, F.coalesce(*quick)), rules, payload, into, keep=True)


def _general(df: DataFrame, rules: list[Rule], payload: str, into: str, keep: bool = False) -> DataFrame:
    """The general evaluator; with ``keep`` only for rows whose struct is still null."""

    @F.arrow_udf(PARSED)
    def evaluate(texts: pa.Array) -> pa.Array:
        status, rule, residue, error, ends, names, kinds, values = [], [], [], [], [0], [], [], []
        for t in texts.to_pylist():
            s, r, own, rest, why = choose(rules, t) if t is not None else ("blank", None, (), "", None)
            status.append(s)
            rule.append(r)
            residue.append(rest)
            error.append(why)
            for n, k, v in own:
                names.append(n)
                kinds.append(k)
                values.append(v)
            ends.append(len(names))
        text = pa.string()
        items = pa.StructArray.from_arrays([pa.array(names, text), pa.array(kinds, text), pa.array(values, text)], names=["name", "type", "value"])
        fields = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
        return pa.StructArray.from_arrays([pa.array(status, text), pa.array(rule, text), fields, pa.array(residue, text), pa.array(error, text)], names=["status", "rule", "fields", "residue", "error"])

    # marked so that no filter on its result is pushed below it, which would run it once more for the filter
    evaluate = evaluate.asNondeterministic()
    if not keep:
        return df.withColumn(into, evaluate(F.col(f"`{payload}`")))
    # a row that is done passes a null text, so that Python sees a null instead of the payload
    left = F.when(F.col(into).isNull(), F.col(f"`{payload}`"))
    return df.withColumn("_left", evaluate(left)).withColumn(into, F.coalesce(into, "_left")).drop("_left")


def field(name: str, kind: str | None = None, parsed: str = "parsed") -> Column:
    """The first field of a name, as text or cast to the Spark type of ``kind``; null if absent or ``ignore``."""
    found = F.get(F.filter(F.col(f"{parsed}.fields"), lambda x: x["name"] == name), F.lit(0))["value"]
    spark = {"digit": "bigint", "port": "bigint", "http/status": "bigint", "float": "double", "bool": "boolean", "time": "timestamp_ntz"}.get(kind or "")
    return found.try_cast(spark) if spark else found


def present(name: str, parsed: str = "parsed") -> Column:
    """Whether a field exists, with a value or as ``ignore``."""
    return F.exists(F.col(f"{parsed}.fields"), lambda x: x["name"] == name)


def with_source_tags(df: DataFrame, tags: str = "tags", parsed: str = "parsed", source: str | None = None, ip: str | None = None) -> DataFrame:
    """Appends a source's tags, and where it came from, as chars fields unless a field of that name exists."""
    added = F.transform(F.map_entries(F.coalesce(F.col(tags), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), F.lit("chars").alias("type"), e["value"].alias("value")))
    more = [F.struct(F.lit(n).alias("name"), F.lit("chars").alias("type"), F.col(c).alias("value")) for n, c in (("src_key", source), ("src_ip", ip)) if c]
    names = F.transform(F.col(f"{parsed}.fields"), lambda x: x["name"])
    fresh = F.filter(F.concat(added, F.array(*more).cast(T.ArrayType(ITEM))) if more else added, lambda x: ~F.array_contains(names, x["name"]))
    return df.withColumn(parsed, F.col(parsed).withField("fields", F.concat(F.col(f"{parsed}.fields"), fresh)))


def infra_streams(df: DataFrame, payload: str = "payload", parsed: str = "parsed") -> dict[str, DataFrame]:
    """The side outputs of one parsed frame: accepted rows, misses with their reason, and residue lines. Blank rows go."""
    status = F.col(f"{parsed}.status")
    return {
        "accepted": df.where(status.isin("ok", "residue")),
        "miss": df.where(status == "miss").select(F.col(payload), F.col(f"{parsed}.rule").alias("rule"), F.col(f"{parsed}.error").alias("error")),
        "residue": df.where(status == "residue").select(F.concat(F.lit("rule:"), F.col(f"{parsed}.rule"), F.lit(",residue:"), F.col(f"{parsed}.residue")).alias("line")),
    }
