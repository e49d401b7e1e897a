"""One plan for batch and streams: events -> parsed -> models -> sinks, with side outputs and dead letters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.lookup import Knowledge
from ..operators.parse import infra_streams, native_pattern, parse_events, with_source_tags
from ..operators.project import apply_model, field_columns
from ..operators.route import Routes, SinkGroup, empty_results, for_sink, model_of_rule
from ..operators.stats import Request, counters
from ..plans.models import Model, parse_model
from ..plans.rules import Rule, parse_rules
from ..sinks.writers import write


@dataclass
class Engine:
    """Rules, models, routes and sinks of a run. ``outputs``: sink name -> (kind, options).

    A sink with replicas is ``name#0``, ``name#1`` and so on in ``outputs``, and each record goes to one of them, by a hash of
    its values. ``ledger``: a folder that notes what arrived of each micro-batch; a batch that a stream runs again after a
    failure then leaves out those sinks (without it delivery is at least once). ``failed`` names the column of records that
    keeps the text of values that their type could not take.
    """

    rules: list[Rule]
    models: list[Model] = field(default_factory=list)
    routes: Routes = field(default_factory=Routes)
    outputs: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    knowledge: Knowledge | None = None
    fields: dict[str, dict[str, str]] = field(default_factory=dict)
    rescue: str | None = None
    stats: list[Request] = field(default_factory=list)
    ledger: str | None = None
    failed: str | None = None

    @classmethod
    def of(cls, rules: str, models: list[str] | None = None, **more) -> Engine:
        return cls(parse_rules(rules), [parse_model(m) for m in models or []], **more)

    def parse(self, events: DataFrame) -> DataFrame:
        parsed = parse_events(events, self.rules)
        return with_source_tags(parsed) if "tags" in events.columns else parsed

    def columns_of(self, rule: Rule) -> dict[str, str]:
        """Names and types of a rule's fields: as given for the run, else as declared in the rule."""
        if rule.key in self.fields:
            return self.fields[rule.key]
        out: dict[str, str] = {}
        made = native_pattern(rule)
        own = made[1] if made else [f for g in rule.groups for f in g.fields]
        for f in own:
            if f.kind != "_":
                out.setdefault(f.label, "time" if f.kind.startswith("time") else f.kind)
            for s in f.subs:
                if s.path and "*" not in s.path:
                    out.setdefault(s.label if s.name else s.path, s.kind)
        for k, _ in rule.tags:
            out.setdefault(k, "chars")
        return out

    def records(self, parsed: DataFrame, rule: Rule) -> DataFrame:
        """The records of one rule after its model (without one: its fields and what is left over)."""
        own = parsed.where(F.col("parsed.rule") == rule.key)
        fields = self.columns_of(rule)
        clash = [c for c in own.columns if c != "parsed" and c in fields]
        plain = field_columns(own.drop(*clash), fields, extras=None if "extras" in fields else "extras")
        rest = [c for c in ("event_id", "src_key", "payload", "tags", "ups_ip") if c in plain.columns]
        model = model_of_rule(rule.key, self.models)
        return apply_model(plain.drop(*rest), model, self.knowledge, failed=self.failed) if model is not None else plain.drop(*rest)

    def group(self, rule: Rule) -> SinkGroup | None:
        name = self.routes.group_of_rule(rule.key)
        return next((g for g in self.routes.groups if g.name == name), None)

    def deliver(self, events: DataFrame, batch: int | None = None) -> dict[str, bool]:
        """Parses once, keeps the classified rows, and writes each sink and side output from them."""
        parsed = self.parse(events).persist(StorageLevel.MEMORY_AND_DISK)
        sent: dict[str, bool] = {}
        before = self._arrived(events.sparkSession, batch)

        def send(df: DataFrame, output: str, what: str) -> None:
            if what in before:
                sent[what] = True
                return
            sent[what] = self._send(df, output)
            if sent[what] and batch is not None and self.ledger is not None:
                df.sparkSession.createDataFrame([(batch, what)], "batch long, what string").coalesce(1).write.mode("append").json(self.ledger)

        try:
            sides = infra_streams(parsed)
            for name in ("miss", "residue"):
                if name in self.outputs:
                    send(sides[name], name, name)
            for request in self.stats if "monitor" in self.outputs else ():
                send(self.monitor(parsed, request), "monitor", f"monitor:{request.name}")
            for rule in self.rules:
                group = self.group(rule)
                records = self.records(sides["accepted"], rule)
                if "error" in self.outputs and model_of_rule(rule.key, self.models) is not None and records.columns:
                    records, empty = empty_results(records, [c for c in records.columns if c != self.failed])
                    send(empty, "error", f"error:{rule.key}")
                if group is None:
                    if self.routes.default in self.outputs:
                        send(records, self.routes.default, f"{self.routes.default}:{rule.key}")
                    continue
                for sink in group.sinks:
                    own = for_sink(records, sink)
                    if sink.name in self.outputs:
                        send(own, sink.name, f"{sink.name}:{rule.key}")
                    for i in range(sink.replicas if sink.replicas > 1 else 0):
                        name = f"{sink.name}#{i}"
                        if name in self.outputs:
                            share = F.pmod(F.xxhash64(*[F.to_json(c) if isinstance(records.schema[c].dataType, (T.MapType, T.StructType)) else F.col(f"`{c}`") for c in records.columns]), F.lit(sink.replicas))
                            send(own.where(share == i), name, f"{name}:{rule.key}")
        finally:
            parsed.unpersist()
        return sent

    def _arrived(self, spark: SparkSession, batch: int | None) -> set[str]:
        if batch is None or self.ledger is None:
            return set()
        try:
            noted = spark.read.schema("batch long, what string").json(self.ledger)
            return {r.what for r in noted.where(F.col("batch") == batch).collect()}
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return set()

    def monitor(self, parsed: DataFrame, request: Request) -> DataFrame:
        """Counter rows of a request over classified events: successes are accepted rows, dimensions are fields."""
        from ..operators.parse import field as value

        dims = [value(d).alias(d) for d in request.collect]
        rows = parsed.where("parsed.status <> 'blank'").select(F.col("parsed.rule").alias("rule"), F.col("parsed.status").isin("ok", "residue").alias("_good"), *dims)
        return counters(rows, request, F.col("_good"))

    def _send(self, df: DataFrame, name: str) -> bool:
        kind, options = self.outputs[name]
        return write(df, kind, options, "normal", self.rescue, name)

    def stream(self, events: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """The same delivery for each micro-batch of a stream; without ``every`` it takes what is there and stops."""
        writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.deliver(df, n) and None)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def process_file(spark: SparkSession, rules: str, path: str, models: list[str] | None = None, options: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Offline: one file through rules (and models); the records of each rule, ``miss`` and ``residue``."""
    from ..sources.readers import file_source

    engine = Engine.of(rules, models)
    parsed = engine.parse(file_source(spark, "file", {"path": path, **(options or {})}))
    sides = infra_streams(parsed)
    return {r.key: engine.records(sides["accepted"], r) for r in engine.rules} | {k: sides[k] for k in ("miss", "residue")}


def check_rules(text: str) -> list[str]:
    """Keys of the rules of a text; raises where it has a mistake."""
    from ..functions.payload import step

    rules = parse_rules(text)
    for r in rules:
        for s in r.steps:
            step(s)
    return [r.key for r in rules]


def windowed_counters(events: DataFrame, time: str, window: str, late: str, dims: list[str]) -> DataFrame:
    """Counters by event-time windows on a stream, with a watermark after which a window is final."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *dims).agg(F.count(F.lit(1)).alias("total"))
