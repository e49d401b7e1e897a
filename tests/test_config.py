import json

import pytest

from logloom.operators.project import apply_model
from logloom.operators.route import Routes
from logloom.plans import config
from logloom.sources.readers import Connector, file_source
from logloom.streaming.engine import Engine

CONNECTORS = '[[connectors]]\nid = "json"\ntype = "file"\nallow_override = ["base", "file"]\n[connectors.params]\nfmt = "json"\nbase = "./out"\nfile = "x.json"\n'


def test_sources():
    text = '[[source_file]]\nkey = "f"\npath = "/a"\nencode = "hex"\ntags = ["host : h1"]\n[[source_file]]\nkey = "g"\npath = "/b"\nenable = false\n[[source_syslog]]\nkey = "s"\naddr = "0.0.0.0"\nport = 514\nprotocol = "udp"\n'
    got = config.sources(text)
    assert [(s.kind, s.key) for s in got] == [("file", "f"), ("syslog_udp", "s")]
    assert got[0].options == {"path": "/a", "encode": "hex", "tag.host": "h1"}


def test_sinks():
    text = '[sink_group]\nname = "demo"\nmodel = ["*"]\ntags = ["biz:demo"]\n[[sink_group.sinks]]\nname = "j"\nconnect = "json"\nfilter = "$n > digit(5)"\ntags = ["sink:json"]\n[sink_group.sinks.params]\nfile = "demo.json"\n'
    group, outputs = config.sink_group(text, Connector.from_toml(CONNECTORS))
    assert group.models == ("*",) and group.sinks[0].tags == (("biz", "demo"), ("sink", "json")) and group.sinks[0].filter == "$n > digit(5)"
    assert outputs == {"demo/j": ("file", {"fmt": "json", "path": "./out/demo.json"})}
    with pytest.raises(config.ConfigError):
        config.sink_group(text, {})
    assert config.infra_sinks('[miss]\nname = "m"\n[[miss.sinks]]\nname = "x"\nfmt = "raw"\ntarget = "file"\npath = "/m"\n') == {"miss": ("file", {"fmt": "raw", "path": "/m"})}


def test_knowledge_and_monitor(spark, tmp_path):
    (tmp_path / "zone").mkdir()
    (tmp_path / "zone" / "data.csv").write_text('start_ip,end_ip,zone\n"10.0.0.0",10.0.0.9,a\n10.0.1.0,10.0.1.9,b\n')
    (tmp_path / "zone" / "create.sql").write_text("CREATE TABLE {table} (\n  id INTEGER PRIMARY KEY,\n  lo INTEGER NOT NULL,\n  hi INTEGER,\n  zone TEXT\n);")
    (tmp_path / "zone" / "insert.sql").write_text("INSERT INTO {table} (lo, hi, zone)\nVALUES (ip4_int(trim_quotes(?1)), ip4_int(?2), trim_quotes(?3));")
    (tmp_path / "k.toml").write_text('version = 2\nbase_dir = "."\n[csv]\nhas_header = true\n[[tables]]\nname = "zone"\ncolumns.by_header = ["start_ip", "end_ip", "zone"]\n[tables.expected_rows]\nmin = 2\nmax = 9\n')
    k = config.knowledge(spark, str(tmp_path / "k.toml"))
    df = spark.createDataFrame([("10.0.1.5",), ("9.9.9.9",)], "ip string")
    out = apply_model(df, "name : x\n---\nz = select zone from zone where lo <= ip4_int(read(ip)) and hi >= ip4_int(read(ip)) ;", k, keep=("ip",))
    assert {r.ip: r.z for r in out.collect()} == {"10.0.1.5": "b", "9.9.9.9": None}

    (tmp_path / "in.txt").write_text("5\n6\nx\n")
    stats = config.stat_requests('[stat]\nwindow_sec = 60\n[[stat.parse]]\nkey = "p"\ntarget = "*"\nfields = []\ntop_n = 20\n')
    outputs = {n: ("file", {"path": str(tmp_path / n), "fmt": "json"}) for n in ("monitor", "error", "default")}
    engine = Engine.of("rule r { (digit:n) }", ["name : m\nrule : /r\n---\nk = match read(n) { digit(5) => chars(five) ; } ;"], routes=Routes(), outputs=outputs, stats=stats)
    engine.deliver(file_source(spark, "f", {"path": str(tmp_path / "in.txt")}))
    rows = lambda n: [json.loads(r.value) for r in spark.read.text(str(tmp_path / n)).collect()]
    assert rows("monitor") == [{"stage": "parse", "name": "p", "target": "all", "total": 3, "success": 2, "suc_rate": pytest.approx(66.6667, 1e-4)}]
    assert rows("error") == [{"__err_kind": "empty"}] and rows("default") == [{"k": "five"}]
