"""Archive files, dumps, trees and the small files around them."""

import dataclasses
import json
import math
import os
import struct

import pytest
from pyspark.sql import functions as F

from annulus.operators import kernel
from annulus.sources import documents, repository, rrd

NAN = float("nan")


def sample(n=5):
    sources = [rrd.Source("a", "COUNTER", 600, 0.0, NAN, 12345.0, 1.5, 3), rrd.Source("b", "GAUGE")]
    return rrd.ArchiveFile("0003", 300, 1_800_000, sources, [rrd.Archive("AVERAGE", 1, 0.5, [[float(i), NAN if i == 2 else i / 3] for i in range(n)]), rrd.Archive("MAX", 12, 0.5, [[1.0, 2.0]])])


def same(a, b):
    return repr(dataclasses.asdict(a)) == repr(dataclasses.asdict(b))


@pytest.mark.parametrize("current", [0, 2, 4])
def test_round_trip_unrolls_the_ring(current):
    assert same(rrd.parse(rrd.encode(sample(), current)), sample())


@pytest.mark.parametrize("damage", [
    lambda r: r[:-1], lambda r: r + b"\0", lambda r: r[:100], lambda r: r[:200], lambda r: r[:24] + struct.pack("<q", 1 << 40) + r[32:], lambda r: r[:24] + struct.pack("<q", -1) + r[32:],
    lambda r: r[:32] + struct.pack("<q", 1 << 50) + r[40:], lambda r: r[: 128 + 240 + 24] + struct.pack("<q", 1 << 60) + r[128 + 240 + 32 :], lambda r: r[: 128 + 240 + 24] + struct.pack("<q", -5) + r[128 + 240 + 32 :],
])
def test_damage_is_refused(damage):
    with pytest.raises(ValueError):
        rrd.parse(damage(rrd.encode(sample())))


@pytest.mark.parametrize("patch", [(4, b"0004\0"), (16, struct.pack(">d", rrd.COOKIE))])
def test_other_layouts_are_told_apart(patch):
    raw = bytearray(rrd.encode(sample()))
    raw[patch[0] : patch[0] + len(patch[1])] = patch[1]
    with pytest.raises(rrd.UnsupportedLayout):
        rrd.parse(bytes(raw))


DUMP = """<?xml version="1.0"?><rrd><version>0003</version><step>300</step><lastupdate>900</lastupdate>
<ds><name> a </name><type> GAUGE </type><minimal_heartbeat>600</minimal_heartbeat><min>NaN</min><max>1e3</max><last_ds>U</last_ds><value>1.5</value><unknown_sec> 2 </unknown_sec></ds>
<rra><cf>AVERAGE</cf><pdp_per_row>1</pdp_per_row><params><xff>5.0e-01</xff></params><cdp_prep><ds><value>NaN</value></ds></cdp_prep>
<database><!-- t --><row><v>1.0</v></row><row><v>NaN</v></row></database></rra></rrd>"""


def test_dump():
    f = rrd.parse_dump(DUMP.encode())
    assert (f.step, f.last_update, f.sources[0].name, f.sources[0].type, f.sources[0].unknown_sec, f.sources[0].pdp_value) == (300, 900, "a", "GAUGE", 2, 1.5)
    assert math.isnan(f.sources[0].last_value) and f.archives[0].rows[0] == [1.0] and math.isnan(f.archives[0].rows[1][0]) and f.archives[0].xff == 0.5


def test_dump_with_declarations_is_refused():
    with pytest.raises(ValueError):
        rrd.parse_dump(b'<?xml version="1.0"?><!DOCTYPE r [<!ENTITY x "y">]><rrd/>')


def test_the_second_kind(spark, tmp_path):
    sources = [rrd.Source("g", "GAUGE", 600, NAN, NAN, 20.0, 0.0, 0), rrd.Source("counter_of_20_chars_", "COUNTER", 600, 0.0, NAN, 7000.0, 30.0, 12)]
    rows = [[float(i), 1.0 if i else NAN] for i in range(10)]
    f = rrd.ArchiveFile("", 300, 1_800_000, sources, [rrd.Archive("AVERAGE", 1, 0.5, rows), rrd.Archive("MAX", 12, 0.5, rows[:5]), rrd.Archive("MIN", 24, 0.5, [])])
    for oldest in (0, 3, 9):
        back = rrd.open_archive(rrd.encode_second(f, oldest))
        assert repr(dataclasses.replace(back, version="")) == repr(f) and back.version == rrd.SECOND_KIND
    raw = rrd.encode_second(f, 3)
    for bad in (raw[:-1], raw + b"x", raw[:50], raw[:48] + struct.pack(">i", 1 << 30) + raw[52:], raw[: 64 + 80 + 40] + struct.pack(">q", 1 << 40) + raw[64 + 80 + 48 :]):
        with pytest.raises(ValueError):
            rrd.open_archive(bad)
    (tmp_path / "a.jrb").write_bytes(raw)
    (row,) = rrd.read_files(spark, str(tmp_path)).collect()
    assert row.error is None and row.sources[1].pdp_value == 30.0 and row.archives[0].rows[9] == [9.0, 1.0]


def write(tmp_path):
    for name, raw in (("good.rrd", rrd.encode(sample())), ("dump.xml", DUMP.encode()), ("bad.rrd", b"RRD\0" + b"x" * 50), ("odd.jrb", b"?")):
        (tmp_path / name).write_bytes(raw)


def test_files_as_tables(spark, tmp_path):
    write(tmp_path)
    rrd.register(spark)
    for files in (rrd.read_files(spark, str(tmp_path)), spark.read.format("rrd").load(str(tmp_path))):
        found = {os.path.basename(r.file): r for r in files.collect()}
        assert {n for n, r in found.items() if r.error} == {"bad.rrd", "odd.jrb"} and found["good.rrd"].sources[0].last_value == 12345.0
        archives, rows, sources = rrd.tables(files)
        assert archives.count() == 3 and rows.count() == 14 and sources.count() == 3
        assert kernel.history(archives, rows, sources).count() > 0


def test_properties():
    raw = "# c\n! d\na = b\\u00e9 \nk\\=1:v\nlong = x\\\n   y\nempty\nlat=\xe9\n".encode("latin-1")
    assert repository.properties(raw) == {"a": "bé ", "k=1": "v", "long": "xy", "empty": "", "lat": "é"}


def tree(top):
    def put(path, raw=b"x", mtime=None):
        os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
        with open(f"{top}/{path}", "wb") as f:
            f.write(raw)
        if mtime:
            os.utime(f"{top}/{path}", (mtime, mtime))

    put("snmp/1/eth0/ds.properties", b"a=grp\nb=grp\nc=gone\n")
    put("snmp/1/eth0/grp.rrd", mtime=100)
    put("snmp/1/eth0/grp.jrb", mtime=100)
    put("snmp/1/eth0/stray.rrd")
    put("response/10.0.0.1/icmp.rrd", mtime=100)
    put("response/10.0.0.1/icmp.jrb", mtime=200)
    put("response/10.0.0.1/icmp.meta", b"GROUP=ping\n")
    put("snmp/2/ds.properties", b"a=\\u00zz\n")
    put("snmp/2/x.meta", b"GROUP=x\n")
    put("snmp/2/x.rrd")
    put("response/10.0.0.1/lost.meta", b"GROUP=x\n")
    put("response/10.0.0.1/none.meta", b"OTHER=x\n")
    put("elsewhere/x.rrd")
    os.symlink(f"{top}/snmp/1", f"{top}/snmp/1/loop")


def test_walk(spark, tmp_path):
    tree(str(tmp_path))
    items, skipped = repository.resolve(*repository.scan(spark, str(tmp_path)))
    assert [tuple(r) for r in items.collect()] == [("response/10.0.0.1/icmp.jrb", "response/10.0.0.1/ping", "ping"), ("snmp/1/eth0/grp.rrd", "snmp/1/eth0/grp", "grp")]
    reasons = dict(tuple(r) for r in skipped.collect())
    assert reasons["snmp/1/eth0/grp.jrb"] == "older duplicate of grp.rrd" and reasons["response/10.0.0.1/icmp.rrd"] == "older duplicate of icmp.jrb"
    assert reasons["snmp/1/eth0/stray.rrd"] == "no group information" and "snmp/1/eth0/gone" in reasons and "response/10.0.0.1/lost" in reasons
    assert reasons["snmp/1/loop"].startswith("cannot read") and reasons["snmp/2/ds.properties"].startswith("cannot read") and reasons["snmp/2/x.rrd"] == "no group information"


def test_states(spark, tmp_path):
    path = str(tmp_path / "state.jsonl")
    log = documents.StateLog(path)
    log.append(file="a", **{"pass": "RECENT"}, status="FAILED", samples=0, attempts=1, error="e", labelHash=None)
    with open(path, "ab") as f:
        f.write(b'null\n{"file": "torn"')
    log.append(file="a", **{"pass": "RECENT"}, status="DONE", samples=3, attempts=2, error=None, labelHash="h")
    from annulus.operators.writing import last_states

    (row,) = last_states(documents.read_states(spark, path)).collect()
    assert (row.file, row.status, row.samples, row.label_hash) == ("a", "DONE", 3, "h")


def test_snapshot_and_labels(spark, tmp_path):
    path = str(tmp_path / "labels.json")
    sets = [{"resourceId": "snmp/1/x", "__name__": "m", "z": "é"}, {"resourceId": "snmp/1/x"}]
    (tmp_path / "in.json").write_text(json.dumps(sets))
    from annulus.operators.labels import label_index

    documents.write_label_sets(label_index(documents.label_sets(spark, str(tmp_path / "in.json"))), path)
    assert json.load(open(path)) == sets[:1]
    snapshot = documents.Snapshot(1, 2, "u")
    snapshot.save(path)
    assert documents.Snapshot.load(path) == snapshot and documents.Snapshot.load(path + "x") is None


def test_label_files_of_any_layout(spark, tmp_path):
    sets = [{"a": "1", "b": "x, ]y"}, {"a": "{"}, {}]
    texts = {"lines": "\n".join(map(json.dumps, sets)), "array": json.dumps(sets), "indented": json.dumps(sets, indent=2), "parts": "[" + ",\n".join(map(json.dumps, sets)) + "]", "none": "[\n]\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        assert sorted(map(str, (r.labels for r in documents.label_sets(spark, str(tmp_path / name)).collect()))) == (sorted(map(str, sets)) if name != "none" else []), name


def test_the_last_state_counts_in_a_log_of_many_parts(spark, tmp_path):
    from annulus.operators.writing import last_states

    path, log = str(tmp_path / "state.jsonl"), []
    for i in range(4000):
        log.append(json.dumps({"file": f"f{i % 7}", "pass": "RECENT", "status": "DONE", "samples": i, "attempts": 1, "error": None, "labelHash": None}))
    (tmp_path / "state.jsonl").write_text("\n".join(log) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        states = documents.read_states(spark, path)
        assert states.rdd.getNumPartitions() > 5
        assert {r.file: r.samples for r in last_states(states).collect()} == {f"f{i % 7}": i for i in range(3993, 4000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_node_answers_as_columns(spark):
    from annulus.sources import inventory

    answers = [
        {"id": "7", "label": "n", "foreignSource": "f", "categories": [{"id": 1, "name": "c"}], "assetRecord": {"rack-unit-no": "r", "x": "", "y": None, "z": 5, "o": {"p": 1}, "l": [1]}, "more": {}},
        {"id": 8}, {"id": 9, "assetRecord": None, "categories": []},
    ]
    node = inventory.node_columns(F.col("value"))
    rows = spark.createDataFrame([(json.dumps(a),) for a in answers], "value string").select(*(c.alias(k) for k, c in node.items())).collect()
    assert [r.asDict(True) for r in rows] == [inventory.parse_node(a) for a in answers]


def test_real_tag_keys_are_options(spark, tmp_path):
    (tmp_path / "etc/main.properties.d").mkdir(parents=True)
    (tmp_path / "etc/other.properties").write_text("my.tag.zone=z\n")
    (tmp_path / "etc/main.properties").write_text("my.tag.site=a\nmy.cats=TRUE\nu.descr=true \nmy.other=x\n")
    (tmp_path / "etc/main.properties.d/a.properties").write_text("my.tag.node=${node:label}\n")
    keys = documents.ConfigKeys("main.properties", "my.tag.", "my.cats", "u.descr", "u.keep")
    config = documents.TagConfig.load(str(tmp_path), keys)
    assert config.tags == {"node": "${node:label}", "site": "a"} and config.expose_categories and not config.prefer_descr and not config.keep_names


def test_tag_config(spark, tmp_path):
    (tmp_path / "etc/x.properties.d").mkdir(parents=True)
    (tmp_path / "etc/x.properties").write_text("metatags.node=${node:label}\nmetatags.site=a\n")
    (tmp_path / "etc/x.properties.d/b.properties").write_text("metatags.site=b\nmetatags.exposeCategories=true\n")
    config = documents.TagConfig.load(str(tmp_path))
    assert config.tags == {"node": "${node:label}", "site": "b"} and config.expose_categories
    assert {r.tag: r.scope for r in config.table(spark).collect()} == {"node": "NODE", "site": "CONSTANT"}
