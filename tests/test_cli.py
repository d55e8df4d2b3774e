"""The verbs, end to end, on a small repository and a fake backend."""

import json

import pytest
from backend import FakeBackend

from annulus import cli
from annulus.sources import rrd

L = 1_800_000


@pytest.fixture
def world(tmp_path):
    fake = FakeBackend()
    home = tmp_path / "repo/snmp/1/eth0"
    home.mkdir(parents=True)
    (home / "ds.properties").write_text("in=traffic\nold=idle\n")
    kinds = [rrd.Source("in", "COUNTER", last_value=10_000.0, pdp_value=0.0), rrd.Source("cpu", "GAUGE"), rrd.Source("abs", "ABSOLUTE")]
    rows = [[float(i), i / 2, 0.0] for i in range(20)]
    (home / "traffic.rrd").write_bytes(rrd.encode(rrd.ArchiveFile("0003", 300, L, kinds, [rrd.Archive("AVERAGE", 1, 0.5, rows)]), 7))
    (home / "idle.rrd").write_bytes(rrd.encode(rrd.ArchiveFile("0003", 300, L - 90_000, [rrd.Source("temp", "GAUGE")], [rrd.Archive("AVERAGE", 1, 0.5, [[1.0]] * 5)])))
    (home / "broken.rrd").write_bytes(b"RRD\0")
    live = [{"resourceId": "snmp/1/eth0/traffic", "__name__": "in", "node": "n1", "site": "s"}, {"resourceId": "snmp/1/eth0/traffic", "__name__": "cpu", "node": "n1", "site": "s", "mtype": "count"}]
    (tmp_path / "labels.json").write_text(json.dumps(live))
    (tmp_path / "home/etc").mkdir(parents=True)
    (tmp_path / "home/etc/x.properties").write_text("metatags.node=${node:label}\nmetatags.zone=z1\n")
    (tmp_path / "other").mkdir()
    yield tmp_path, fake
    fake.close()


def run(spark, *argv):
    return cli.main([str(x) for x in argv], spark)


def test_everything(spark, world, capsys):
    top, fake = world
    plan = ["plan", "--rrd-dir", top / "repo", "--labels", top / "labels.json", "--home", top / "home", "--out", top / "plan", "--orphans", top / "o.txt", "--not-migrated", top / "n.txt", "--report", top / "r.html"]
    assert run(spark, *plan) == 0
    said = capsys.readouterr().out
    assert "class=SKIPPED" in said and "root=snmp n=4" in said.replace("\n", " ") and "not supported" in (top / "n.txt").read_text()
    assert "class=MATCHED" in said and "class=MTYPE_MISMATCH" in said and "class=ORPHAN_COMPLETE" in said
    assert (top / "o.txt").read_text() == "snmp/1/eth0/idle\n" and "broken" in (top / "n.txt").read_text() and "no group information" in (top / "n.txt").read_text()
    assert "<h2>Classes</h2>" in (top / "r.html").read_text()
    links = ["--write-url", fake.url + "/w", "--read-url", fake.url]
    state = ["--plan", top / "plan", "--state-dir", top]
    assert run(spark, "verify", *state, *links, "--all") == 1
    assert run(spark, "backfill", *state, *links, "--rate", 0, "--canary", 0) == 64
    assert run(spark, "backfill", *state, *links, "--rate", 0, "--canary", 5, "--home", top / "home") == 0
    orphan = next(dict(k) for k in fake.data if dict(k)["__name__"] == "temp")
    assert orphan == {"__name__": "temp", "resourceId": "snmp/1/eth0/idle", "mtype": "gauge", "node": "n1", "zone": "z1"}
    assert run(spark, "verify", *state, *links, "--all") == 0
    capsys.readouterr()
    idle = top / "repo/snmp/1/eth0/idle.rrd"
    raw = idle.read_bytes()
    idle.write_bytes(b"RRD\0")
    assert run(spark, "verify", *state, *links, "--all") == 1 and "read snmp/1/eth0/idle.rrd" in capsys.readouterr().out
    assert run(spark, "backfill", "--plan", top / "plan", "--state-dir", top / "other", *links, "--rate", 0, "--canary", 0, "--skip-config-check") == 1
    assert "FAILED snmp/1/eth0/idle.rrd (RECENT): read: " in capsys.readouterr().err
    idle.unlink()
    assert run(spark, "verify", *state, *links, "--all") == 1 and "read snmp/1/eth0/idle.rrd" in capsys.readouterr().out
    idle.write_bytes(raw)
    first = next(iter(fake.data.values()))
    first[max(first)] += 1000
    assert run(spark, "verify", *state, *links, "--all") == 1
    assert run(spark, "explain", "--plan", top / "plan", "--resource", "snmp/1/eth0/idle") == 0
    assert "sibling:" in capsys.readouterr().out
    assert run(spark, "explain", "--plan", top / "plan", "--resource", "nothing") == 1
    fake.answers = [503] * 50
    assert run(spark, "backfill", "--plan", top / "plan", "--state-dir", top / "home", *links, "--rate", 0, "--max-retries", 0, "--canary", 0, "--skip-config-check") == 2
    (top / "home/etc/x.properties").write_text("metatags.node=other\n")
    assert run(spark, "backfill", *state, *links, "--home", top / "home") == 1


def test_snapshot_and_preflight(spark, world):
    top, fake = world
    fake.data = {(("__name__", "in"), ("resourceId", "snmp/1/eth0/traffic")): {(L + 50) * 1000: 1.0}, (("__name__", "x"), ("resourceId", "snmp/11/y")): {(L + 50) * 1000: 1.0}}
    assert run(spark, "snapshot-labels", "--rrd-dir", top / "repo", "--read-url", fake.url, "--out", top / "s.json", "--since-days", 100_000, "--home", top / "home") == 0
    assert [x["resourceId"] for x in json.loads((top / "s.json").read_text())] == ["snmp/1/eth0/traffic"]
    assert json.loads((top / "s.meta.json").read_text())["cutover_sec"] == L
    assert run(spark, "preflight", "--rrd-dir", top / "repo", "--write-url", fake.url, "--read-url", fake.url) == 0


@pytest.mark.parametrize("argv", [[], ["nonsense"], ["plan"], ["backfill", "--plan", "p", "--threads", "0"], ["verify", "--plan", "p", "--sample", "0"]])
def test_usage(spark, argv):
    assert run(spark, *argv) == 64


def test_files_beyond_those_that_are_named(spark, world, monkeypatch):
    """More files than are opened by name: the folder is listed, and the others aren't decoded."""
    top, fake = world
    links = ["--write-url", fake.url + "/w", "--read-url", fake.url]
    assert run(spark, "plan", "--rrd-dir", top / "repo", "--labels", top / "labels.json", "--out", top / "plan", "--orphans", top / "o.txt", "--not-migrated", top / "n.txt") == 0
    monkeypatch.setattr(cli, "NAMED_FILES", 0)
    state = ["--plan", top / "plan", "--state-dir", top]
    assert run(spark, "backfill", *state, *links, "--rate", 0, "--canary", 0) == 0 and len(fake.data) == 2
    assert run(spark, "verify", *state, *links, "--all") == 0
