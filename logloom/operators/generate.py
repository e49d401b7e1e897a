"""Synthetic events from rules, or by replaying samples, with speed profiles as row counts for each second."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import Field, Rule


@dataclass(frozen=True)
class Scope:
    """What a field's values are drawn from: a range, or a list; ``form`` formats the value in a text with {val}."""

    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    form: str | None = None


def _draw(f: Field, scope: Scope | None, seed: int) -> Column:
    r = F.rand(seed)
    s = scope or Scope()
    if s.values:
        return F.get(F.array(*[F.lit(v) for v in s.values]), F.floor(r * len(s.values)).cast("int"))
    kind = f.kind
    low, high = (s.low if s.low is not None else 0), (s.high if s.high is not None else 1000)
    if kind == "digit":
        return (F.floor(r * (high - low + 1)) + low).cast("bigint").cast("string")
    if kind == "port":
        return (F.floor(r * 64511) + 1024).cast("bigint").cast("string")
    if kind == "float":
        return F.format_string("%.4f", r * (high - low) + low)
    if kind == "bool":
        return F.when(r < 0.5, "true").otherwise("false")
    if kind == "ip":
        part = lambda k: (F.floor(F.rand(seed * 7 + k) * 254) + 1).cast("string")
        return F.concat_ws(".", part(1), part(2), part(3), part(4))
    if kind == "http/status":
        return F.get(F.array(*[F.lit(x) for x in ("200", "301", "404", "500")]), F.floor(r * 4).cast("int"))
    if kind == "http/method":
        return F.get(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT")), F.floor(r * 3).cast("int"))
    if kind == "http/request":
        return F.concat(F.lit("GET /p"), F.floor(r * 1000).cast("string"), F.lit(" HTTP/1.1"))
    if kind == "http/agent":
        return F.concat(F.lit("Mozilla/5.0 (gen "), F.floor(r * 100).cast("string"), F.lit(")"))
    if kind.startswith("time"):
        at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.floor(r * 365).cast("int"), F.floor(F.rand(seed + 1) * 24).cast("int"), F.floor(F.rand(seed + 2) * 60).cast("int"), F.floor(F.rand(seed + 3) * 60))
        if kind == "time/clf":
            return F.concat(F.date_format(at, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))
        if kind == "time_timestamp":
            return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), at).cast("string")
        return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'" if kind in ("time_iso", "time_3339") else "yyyy-MM-dd HH:mm:ss")
    if kind == "hex":
        return F.concat(F.lit("0x"), F.lower(F.hex(F.floor(r * (1 << 31)).cast("bigint"))))
    if kind == "kv":
        return F.concat(F.lit((f.name or "key") + "="), F.substring(F.md5(r.cast("string")), 1, 8))
    if kind == "sn":
        return F.upper(F.substring(F.md5(r.cast("string")), 1, 12))
    if kind == "base64":
        return F.base64(F.encode(F.substring(F.md5(r.cast("string")), 1, 9), "UTF-8"))
    if kind == "json":
        return F.concat(F.lit('{"a":'), F.floor(r * 100).cast("string"), F.lit("}"))
    if kind in ("symbol", "peek_symbol"):
        return F.lit(f.symbol if kind == "symbol" else "")
    return F.substring(F.md5(r.cast("string")), 1, f.length or 10)


def from_rule(spark: SparkSession, rule: Rule, n: int, seed: int = 1, scopes: Mapping[str, Scope] | None = None, partitions: int | None = None) -> DataFrame:
    """``n`` payloads that the rule parses, drawn field by field: (event_id, payload). The same seed gives the same rows."""
    scopes = scopes or {}
    parts: list[Column] = []
    for g in rule.groups:
        for i, f in enumerate(g.fields):
            sep = f.sep or g.sep
            text = "" if sep is not None and sep.literal == "\0" else sep.literal if sep is not None and sep.literal not in (None, "\\S") else " "
            for _ in range(f.repeat or 1):
                seed += 11
                scope = scopes.get(f.label)
                v = _draw(f, scope, seed)
                if scope and scope.form:
                    v = F.replace(F.lit(scope.form), F.lit("{val}"), v)
                if f.scope:
                    v = F.concat(F.lit(f.scope[0]), v, F.lit(f.scope[1]))
                parts += [v, F.lit("" if f.kind == "peek_symbol" else text)]
    if parts and not (rule.groups[-1].fields and rule.groups[-1].fields[-1].sep):
        parts = parts[:-1]
    frame = spark.range(n) if partitions is None else spark.range(0, n, 1, partitions)
    return frame.select(F.col("id").alias("event_id"), F.concat(*parts).alias("payload"))


def from_samples(spark: SparkSession, lines: Sequence[str], n: int) -> DataFrame:
    """``n`` payloads that repeat the sample lines in turn. The samples travel as a literal; keep them few."""
    table = F.array(*[F.lit(x) for x in lines])
    return spark.range(n).select(F.col("id").alias("event_id"), F.get(table, (F.col("id") % len(lines)).cast("int")).alias("payload"))


# -- speed profiles: rows in each second


def constant(rate: float):
    return lambda t: rate


def sinusoidal(base: float, amplitude: float, period: float):
    return lambda t: max(0.0, base + amplitude * math.sin(2 * math.pi * t / period))


def stepped(steps: Sequence[tuple[float, float]], loop: bool = True):
    """(seconds, rate) pairs, one after the other."""
    whole = sum(d for d, _ in steps)

    def rate(t: float) -> float:
        t = t % whole if loop else min(t, whole - 1e-9)
        for d, r in steps:
            if t < d:
                return r
            t -= d
        return steps[-1][1]

    return rate


def burst(base: float, rate: float, length: float, every: float):
    return lambda t: rate if t % every < length else base


def ramp(start: float, end: float, seconds: float):
    return lambda t: start + (end - start) * min(1.0, t / seconds)


def random_walk(base: float, change: float, seed: int = 1):
    seen = [base]

    def rate(t: float) -> float:
        while len(seen) <= int(t):
            seen.append(max(0.0, seen[-1] + random.Random(seed * 1000003 + len(seen)).uniform(-change, change)))
        return seen[int(t)]

    return rate


def composite(profiles: Sequence, how: str = "sum"):
    join = {"sum": sum, "max": max, "min": min, "avg": lambda xs: sum(xs) / len(xs)}[how]
    return lambda t: join([p(t) for p in profiles])


def schedule(spark: SparkSession, profile, seconds: int) -> DataFrame:
    """(second, rows): how many events a profile gives in each second."""
    return spark.createDataFrame([(t, int(round(profile(t)))) for t in range(seconds)], "second long, rows long")


def timed(spark: SparkSession, events: DataFrame, plan: DataFrame) -> DataFrame:
    """Events with the second in which they are sent: event_id runs through the schedule's cumulative counts."""
    ends, total = [], 0
    for r in plan.orderBy("second").collect():
        total += r.rows
        ends.append(total)
    bounds = F.array(*[F.lit(x).cast("long") for x in ends])
    return events.withColumn("second", F.size(F.filter(bounds, lambda e: e <= F.col("event_id"))).cast("long")).where(F.col("event_id") < (ends[-1] if ends else 0))
