"""Routing: which model and which sinks a rule's records go to, filters, tags and fan-out."""

from __future__ import annotations

from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import filter_expression, record


@dataclass(frozen=True)
class Sink:
    """One output of a group. ``filter``: an expression over the record; rows stay where it equals ``expect``."""

    name: str
    filter: str | None = None
    expect: bool = True
    tags: tuple[tuple[str, str], ...] = ()
    replicas: int = 1


@dataclass(frozen=True)
class SinkGroup:
    name: str
    rules: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    sinks: tuple[Sink, ...] = ()


@dataclass
class Routes:
    groups: list[SinkGroup] = field(default_factory=list)
    default: str = "default"

    def group_of_rule(self, rule: str) -> str:
        """The group whose pattern for this rule is the longest; the infra default without any."""
        return self._longest(rule, lambda g: g.rules)

    def group_of_model(self, model: str) -> str:
        return self._longest(model, lambda g: g.models)

    def _longest(self, name: str, patterns) -> str:
        best: tuple[int, str] | None = None
        for g in self.groups:
            for p in patterns(g):
                if _matches(name, p) and (best is None or len(p) >= best[0]):
                    best = len(p), g.name
        return best[1] if best else self.default

    def column(self, rule: Column, rules: list[str]) -> Column:
        """The group of each row's rule, for the given known rules; the default for others."""
        out = F.lit(self.default)
        for r in rules:
            out = F.when(rule == r, F.lit(self.group_of_rule(r))).otherwise(out)
        return out


def _matches(name: str, pattern: str) -> bool:
    return fnmatchcase(name.strip("/"), pattern.strip("/"))


def model_of_rule(rule: str, models: list) -> object | None:
    """The first enabled model one of whose rule patterns matches."""
    return next((m for m in models if m.enabled and any(_matches(rule, p) for p in m.rules)), None)


def accepts(df: DataFrame, sink: Sink) -> Column:
    if sink.filter is None:
        return F.lit(True)
    return filter_expression(sink.filter, record(df)) == F.lit(sink.expect)


def for_sink(df: DataFrame, sink: Sink) -> DataFrame:
    """The rows that a sink gets, with its tags; a tag never replaces a column of its name."""
    out = df.where(accepts(df, sink))
    return out.select("*", *[F.lit(v).alias(k) for k, v in sink.tags if k not in df.columns])


def fan_out(df: DataFrame, group: SinkGroup, key: str | None = None) -> DataFrame:
    """One row for each record and sink that takes it, with the column ``sink``; the input is read once.

    A sink with replicas gets a row in one of them, by ``key`` modulo their number.
    """
    names = []
    for s in group.sinks:
        name = F.lit(s.name) if s.replicas == 1 or key is None else F.concat(F.lit(s.name + "#"), F.pmod(F.col(key), F.lit(s.replicas)).cast("string"))
        names.append(F.when(accepts(df, s), name))
    return df.withColumn("sink", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))


def empty_results(df: DataFrame, targets: list[str], kind: str = "empty") -> tuple[DataFrame, DataFrame]:
    """Records with a value in any target, and the others as errors with ``__err_kind``."""
    filled = F.lit(False)
    for t in targets:
        filled = filled | F.col(f"`{t}`").isNotNull()
    return df.where(filled), df.where(~filled).withColumn("__err_kind", F.lit(kind))
