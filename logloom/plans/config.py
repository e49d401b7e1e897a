"""Run configuration from TOML: sources, connectors, sink groups, infra sinks, counters and knowledge tables."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators.lookup import Knowledge
from ..operators.route import Sink, SinkGroup
from ..operators.stats import Request
from ..sources.readers import Connector

INFRA = ("default", "miss", "residue", "intercept", "error", "monitor")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class SourceSpec:
    kind: str
    key: str
    options: dict[str, str]


def _tags(items: list[str]) -> dict[str, str]:
    out = {}
    for t in items:
        name, _, value = t.partition(":") if ":" in t else t.partition("=")
        out[name.strip()] = value.strip()
    return out


def _text(v) -> str:
    return "true" if v is True else "false" if v is False else ",".join(map(str, v)) if isinstance(v, list) else str(v)


def sources(text: str, connectors: dict[str, Connector] | None = None) -> list[SourceSpec]:
    """Enabled sources: tables ``source_file``, ``source_kafka``, ``source_syslog``, ``source_tcp``, or ``sources`` that name
    a connector."""
    out = []
    for name, entries in tomllib.loads(text).items():
        if not isinstance(entries, list):
            continue
        for e in entries:
            if not e.get("enable", True):
                continue
            options = {f"tag.{k}": v for k, v in _tags(e.get("tags", [])).items()}
            if name == "sources":
                c = (connectors or {}).get(e.get("connect"))
                if c is None:
                    raise ConfigError(f"unknown connector {e.get('connect')}")
                out.append(SourceSpec(c.kind, e["key"], c.with_options({**{k: _text(v) for k, v in e.get("params", {}).items()}, **options})))
            elif name.startswith("source_"):
                kind = name.removeprefix("source_")
                if kind == "syslog":
                    kind = f"syslog_{e.get('protocol', 'udp')}"
                own = {k: _text(v) for k, v in e.items() if k not in ("key", "enable", "tags", "protocol", "config")}
                out.append(SourceSpec(kind, e["key"], {**own, **options}))
    return out


def _output(params: dict) -> tuple[str, dict[str, str]]:
    kind = params.get("target") or params.get("type") or "file"
    options = {k: _text(v) for k, v in params.items() if k not in ("name", "target", "type", "filter", "tags", "filter_expect")}
    if kind == "file" and "path" not in options:
        options["path"] = f"{options.pop('base', '.').rstrip('/')}/{options.pop('file', 'out.dat')}"
    return kind, options


def sink_group(text: str, connectors: dict[str, Connector] | None = None, model_key: str = "model") -> tuple[SinkGroup, dict[str, tuple[str, dict[str, str]]]]:
    """A business group and its outputs by sink name. Tags of the group come before those of a sink, which win.

    ``model_key`` is the key under which the file lists model patterns.
    """
    g = tomllib.loads(text)["sink_group"]
    sinks, outputs = [], {}
    for s in g.get("sinks", []):
        params = {k: v for k, v in s.items() if k not in ("params", "connect")} | s.get("params", {})
        if "connect" in s:
            c = (connectors or {}).get(s["connect"])
            if c is None:
                raise ConfigError(f"unknown connector {s['connect']}")
            params = {"type": c.kind, **c.with_options({k: _text(v) for k, v in s.get("params", {}).items()})}
        name = f"{g['name']}/{s['name']}"
        tags = _tags(g.get("tags", [])) | _tags(s.get("tags", []))
        sinks.append(Sink(name, s.get("filter"), bool(s.get("filter_expect", True)), tuple(tags.items()), int(g.get("parallel", 1)) if g.get("replica") else 1))
        outputs[name] = _output(params)
    rules, models = g.get("rule", []), g.get(model_key, [])
    return SinkGroup(g["name"], tuple([rules] if isinstance(rules, str) else rules), tuple([models] if isinstance(models, str) else models), tuple(sinks)), outputs


def infra_sinks(text: str) -> dict[str, tuple[str, dict[str, str]]]:
    """The first sink of each side output (default, miss, residue, intercept, error, monitor)."""
    found = tomllib.loads(text)
    return {name: _output(found[name]["sinks"][0]) for name in INFRA if found.get(name, {}).get("sinks")}


def stat_requests(text: str) -> list[Request]:
    """Counter requests of the stages pick, parse and sink."""
    out = []
    for stage, entries in tomllib.loads(text).get("stat", {}).items():
        for e in entries if isinstance(entries, list) else ():
            target = {"*": "all", "": "ignore"}.get(e.get("target", "*"), e.get("target", "*"))
            out.append(Request(e["key"], stage, tuple(e.get("fields", ())), target, e.get("top_n")))
    return out


_SQL_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "TEXT": "string", "VARCHAR": "string", "CHAR": "string"}


def _read(spark: SparkSession, path: str) -> str | None:
    """A configuration file through Spark's readers, so that it may lie in any store; None if it is not there."""
    try:
        return spark.read.text(path, wholetext=True).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise


def knowledge(spark: SparkSession, path: str) -> Knowledge:
    """All enabled tables of a store's TOML file, each a folder with a CSV file, create.sql and perhaps insert.sql.

    create.sql gives the types, insert.sql the expressions over the CSV columns (?1, ?2 ...).
    """
    text = _read(spark, path)
    if text is None:
        raise ConfigError(f"no file {path}")
    conf = tomllib.loads(text)
    base = f"{path.rsplit('/', 1)[0]}/{conf.get('base_dir', '.')}"
    csv, default = conf.get("csv", {}), conf.get("default", {})
    if csv.get("encoding", "utf-8").lower() not in ("utf-8", "utf8"):
        raise ConfigError("only UTF-8 tables can be read")
    out = Knowledge(spark)
    for t in conf.get("tables", []):
        if not t.get("enabled", True):
            continue
        folder = f"{base}/{t.get('dir', t['name'])}"
        types = {m[1]: _SQL_TYPES[m[2].upper()] for m in re.finditer(r"(?m)^\s*\"?(\w+)\"?\s+(INTEGER|INT|BIGINT|REAL|DOUBLE|FLOAT|TEXT|VARCHAR|CHAR)\b", _read(spark, f"{folder}/create.sql") or "", re.I)}
        by = t.get("columns", {})
        names = [f"`{c}`" for c in by.get("by_header", [])] or [f"_c{i}" for i in by.get("by_index", [])]
        plain = [c.strip("`") for c in names]
        columns = dict(zip(plain, names, strict=True))
        insert = re.search(r"(?is)INSERT\s+(?:OR\s+\w+\s+)?INTO\s+\S+\s*\(([^)]*)\)\s*VALUES\s*\((.*)\)\s*;?\s*$", _read(spark, f"{folder}/insert.sql") or "")
        if insert:
            targets = [c.strip().strip('"`') for c in insert[1].split(",")]
            body = re.sub(r"\?(\d+)", lambda m, names=names: names[int(m[1]) - 1], re.sub(r"\s+", " ", insert[2]))
            from ..operators.lookup import _split

            columns = dict(zip(targets, (x.strip() for x in _split(body)), strict=True))
        rows = t.get("expected_rows", {})
        kinds = {c: k for c, k in types.items() if c in columns}
        header = csv.get("has_header", True) if by.get("by_header") else False
        out.load_csv(t["name"], f"{folder}/{t.get('data_file', 'data.csv')}", columns, kinds, header, csv.get("delimiter", ","), csv.get("trim", True), (rows.get("min"), rows.get("max")), t.get("on_error", default.get("on_error", "fail")))
    return out
