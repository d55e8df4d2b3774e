"""Label resolution and classification, case by case."""

import pytest
from pyspark.sql import functions as F

from annulus.operators import labels, verify

ENTRY = "file string, resource string, ds string, ds_type string, error string, last_update long, step long"


def sets(spark, *maps):
    return labels.label_index(spark.createDataFrame([(m,) for m in maps], "labels map<string,string>"))


def one(resource, **more):
    return {"resourceId": resource, "__name__": "x"} | more


def entry(spark, resource="snmp/1/a/g", ds_type="GAUGE", error=None):
    return spark.createDataFrame([("f", resource, "x", ds_type, error, 100, 10)], ENTRY)


@pytest.mark.parametrize(("live", "exported", "ds_type", "error", "wanted"), [
    ([one("snmp/1/a/g")], [], "GAUGE", None, "MATCHED"), ([one("snmp/1/a/g")] * 2, [], "GAUGE", None, "MATCHED"), ([one("snmp/1/a/g", a="1"), one("snmp/1/a/g", a="2")], [one("snmp/1/a/g")], "GAUGE", None, "AMBIGUOUS"),
    ([], [one("snmp/1/a/g")], "GAUGE", None, "EXPORTED"), ([], [one("snmp/1/a/g", a="1"), one("snmp/1/a/g", a="2")], "GAUGE", None, "AMBIGUOUS"), ([], [], "GAUGE", None, "ORPHAN"),
    ([one("snmp/1/a/g", mtype="gauge")], [], "DERIVE", None, "MTYPE_MISMATCH"), ([one("snmp/1/a/g", mtype="count")], [], "DERIVE", None, "MATCHED"), ([one("snmp/1/a/g")], [], "ABSOLUTE", None, "SKIPPED"),
    ([one("snmp/1/a/g")], [], "GAUGE", "broken", "FAILED_READ"),
])
def test_classes(spark, live, exported, ds_type, error, wanted):
    (row,) = labels.classify(labels.match(entry(spark, ds_type=ds_type, error=error), sets(spark, *live), sets(spark, *exported))).collect()
    assert row["class"] == wanted and (row.labels is not None) == (wanted in ("MATCHED", "EXPORTED"))
    assert (row.candidates is not None and len(row.candidates) == 2) == (wanted == "AMBIGUOUS")


def state(spark, scope, resource, *live):
    tags = spark.createDataFrame([("t", scope)], "tag string, scope string")
    found = labels.lookup(entry(spark, resource), tags, sets(spark, *live)).collect()
    return (found[0].state, found[0].value) if found else None


def test_the_first_level_with_siblings_decides(spark):
    node = [one("snmp/1/b/g", t="v"), one("snmp/1/c/g", t="v")]
    assert state(spark, "NODE", "snmp/1/a/g", *node) == ("VALUE", "v")
    assert state(spark, "NODE", "snmp/1/a/g", *node, one("snmp/1/d/g")) == ("CONFLICT", "v")
    assert state(spark, "NODE", "snmp/1/a/g", one("snmp/1/b/g")) == ("EMPTY", None)
    assert state(spark, "NODE", "snmp/1/a/g", one("snmp/2/b/g", t="v")) is None
    assert state(spark, "INTERFACE", "snmp/1/a/g", one("snmp/1/a/g"), one("snmp/1/a/h", t="v")) == ("EMPTY", None)
    assert state(spark, "INTERFACE", "snmp/1/a/g", one("snmp/1/a/h", t="v")) == ("VALUE", "v")
    assert state(spark, "SERVICE", "snmp/1/a/g", one("snmp/1/a/h", t="v")) is None
    assert state(spark, "METADATA", "response/1/a/g", one("response/1/a/h", t="v")) is None
    assert state(spark, "NODE", "snmp/dom/a/g", one("snmp/dom/b/g", t="v")) is None


def test_categories(spark):
    live = sets(spark, one("snmp/1/b/g", cat_a="a", categories="a"), one("snmp/1/c/g", cat_a="a", categories="a"))
    (row,) = labels.resolve_categories(entry(spark), live).collect()
    assert row.categories == {"cat_a": "a", "categories": "a"} and row.category_source == "sibling:snmp/1/b/g"
    split = sets(spark, one("snmp/1/b/g", cat_a="a"), one("snmp/1/c/g"))
    assert labels.resolve_categories(entry(spark), split).first().categories is None
    named = spark.createDataFrame([("f", "x", ["b c", "a"], 7)], "file string, ds string, names array<string>, node_id long")
    (row,) = labels.resolve_categories(entry(spark), split, named).collect()
    assert row.categories == {"cat_b_c": "b c", "cat_a": "a", "categories": "a,b c"} and row.category_source == "rest:node/7"
    base = spark.createDataFrame([("f", "x", {"__name__": "x"}, {"__name__": "minimal"}, [], False)], "file string, ds string, labels map<string,string>, sources map<string,string>, unresolved array<string>, needs_node boolean")
    out = labels.with_categories(base, labels.resolve_categories(entry(spark), split)).first()
    assert out.unresolved == ["categories"] and out.needs_node
    assert not labels.with_categories(base, labels.resolve_categories(entry(spark), live)).first().needs_node
    for names, wanted in ((["a b", "a-b", "1x"], {"cat_a_b": "a-b", "cat_1x": "1x", "categories": "1x,a b,a-b"}), ([], {}), (["", None], {})):
        named = spark.createDataFrame([("f", "x", names, 7)], "file string, ds string, names array<string>, node_id long")
        (row,) = labels.resolve_categories(entry(spark), split, named).collect()
        assert row.categories == wanted and row.category_source == "rest:node/7"
        assert labels.with_categories(base, labels.resolve_categories(entry(spark), split, named)).first().unresolved == []


def resolved(spark, resource, tags, *live):
    orphans = spark.createDataFrame([("f", "x", resource, "gauge")], "file string, ds string, resource string, mtype string")
    return labels.resolve(orphans, spark.createDataFrame(tags, "tag string, expression string, scope string"), sets(spark, *live)).first()


def test_tags_that_are_one_label(spark):
    row = resolved(spark, "snmp/1/eth0/g", [("site.a", "two", "CONSTANT"), ("site-a", "one", "CONSTANT"), ("mtype", "other", "CONSTANT"), ("none", "", "CONSTANT"), ("b-c", "${service:x}", "SERVICE")])
    assert row.labels == {"__name__": "x", "resourceId": "snmp/1/eth0/g", "mtype": "other", "site_a": "two"} and row.unresolved == ["b_c"] and not row.needs_node
    assert row.sources == {"__name__": "minimal", "resourceId": "minimal", "mtype": "constant", "site_a": "constant"}


@pytest.mark.parametrize(("resource", "wanted"), [("snmp/1/eth0/g", "eth0"), ("snmp/fs/a/b/eth1/g", "eth1"), ("snmp/dom/al/g", "dom/al"), ("snmp/1/g", None), ("snmp/fs/a/b/g", None), ("response/1/a/g", None)])
def test_the_interface_directory(spark, resource, wanted):
    assert spark.range(1).select(labels.interface_of(F.lit(resource)).alias("x")).first().x == wanted
    row = resolved(spark, resource, [("t", " ${resource:label}", "RESOURCE")])
    assert row.labels.get("t") == wanted and row.unresolved == ([] if wanted else ["t"])


def test_a_node_is_needed_where_siblings_leave_something_open(spark):
    tags = [("t", "${node:label}", "NODE")]
    assert resolved(spark, "snmp/1/a/g", tags).needs_node
    assert not resolved(spark, "snmp/1/a/g", tags, one("snmp/1/b/g", t="v")).needs_node
    assert not resolved(spark, "snmp/1/a/g", tags, one("snmp/1/b/g")).needs_node
    assert resolved(spark, "snmp/1/a/g", tags, one("snmp/1/b/g", t="v"), one("snmp/1/b/g")).needs_node


def judged(spark, cutover=100, **more):
    row = {"file": "f", "ds": "x", "resource": "r/a", "mtype": "gauge", "last_update": 50, "step": 10, "labels": {"a": "b"}, "unresolved": [], "gone": False, "scheduled": False} | more
    options = {k: row.pop(k) for k in ("pending", "skip_orphans", "skip_partial") if k in row}
    kinds = "file string, ds string, resource string, mtype string, last_update long, step long, labels map<string,string>, unresolved array<string>, gone boolean, scheduled boolean"
    (out,) = labels.classify_orphans(spark.createDataFrame([tuple(row.values())], kinds), cutover=cutover, **options).collect()
    return out["class"], out.labels


def test_orphans(spark):
    assert judged(spark) == ("ORPHAN_COMPLETE", {"a": "b"})
    assert judged(spark, last_update=80)[0] == "PENDING" and judged(spark, last_update=79)[0] == "ORPHAN_COMPLETE"
    assert judged(spark, scheduled=True) == ("PENDING", None) and judged(spark, scheduled=True, pending=False)[0] == "ORPHAN_COMPLETE"
    assert judged(spark, last_update=99, gone=True) == ("ORPHAN_MINIMAL", {"__name__": "x", "resourceId": "r/a", "mtype": "gauge"})
    assert judged(spark, unresolved=["t"]) == ("ORPHAN_PARTIAL", {"a": "b"}) and judged(spark, unresolved=["t"], skip_partial=True) == ("ORPHAN_PARTIAL", None)
    assert judged(spark, skip_orphans=True) == ("ORPHAN_COMPLETE", None)


def test_hashes_tell_label_sets_apart(spark):
    def hashed(*rows):
        return labels.label_hash(spark.createDataFrame([("f", *r) for r in rows], "file string, ds string, labels map<string,string>")).first().label_hash

    assert hashed(("a", {"k": "1", "l": "2"}), ("b", {})) == hashed(("b", {}), ("a", {"l": "2", "k": "1"}))
    assert hashed(("a", {"k": "1"})) != hashed(("a", {"k": "2"})) != hashed(("b", {"k": "2"}))


def test_verify_needs_both_passes_with_the_planned_labels(spark):
    files = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "h")], "file string, label_hash string")
    done = [("a", "RECENT", "DONE", "h"), ("a", "OLDER", "DONE", None), ("b", "RECENT", "DONE", "h"), ("c", "RECENT", "DONE", "h"), ("c", "OLDER", "DONE", "other"), ("d", "RECENT", "FAILED", "h")]
    states = spark.createDataFrame(done, "file string, pass string, status string, label_hash string")
    assert [r.file for r in verify.not_done(files, states).collect()] == ["b", "c", "d"]


def test_nan_agrees_with_nothing(spark):
    nan = float("nan")
    rows = lambda *v: spark.createDataFrame([("s", counter, t, x) for counter, t, x in v], "canon string, counter boolean, ts long, value double")
    expected = rows((False, 1, nan), (False, 2, 1.0))
    got = rows((False, 1, nan), (False, 2, 1.0)).drop("counter")
    assert [(r.ts, r.kind) for r in verify.compare(expected, got, 1.0).collect()] == [(1, "value")]
    grown = rows((True, 1, 10.0), (True, 2, 20.0), (True, 3, 30.0))
    moved = rows((True, 1, 110.0), (True, 2, 120.0), (True, 3, 131.0)).drop("counter")
    assert [(r.ts, r.kind) for r in verify.compare(grown, moved, 0.0).collect()] == [(3, "delta")]
    assert verify.compare(grown, moved, 0.01).count() == 0


def test_selection_takes_a_share_and_all_retried(spark):
    files = spark.range(300).select(F.col("id").cast("string").alias("file"))
    states = spark.createDataFrame([("7", 2), ("8", 1)], "file string, attempts int")
    first = {r.file for r in verify.selection(files, states, percent=1.0, seed=1).collect()}
    assert "7" in first and len(first - {"7"}) in (2, 3) and first == {r.file for r in verify.selection(files, states, percent=1.0, seed=1).collect()}
    assert verify.selection(files, states, percent=1.0, seed=1, every=True).count() == 300


def test_report(spark):
    from annulus.operators import report

    kinds = "class string, labels map<string,string>, resource string, ds string, n_samples long, oldest long, note string, unresolved array<string>, candidates array<string>"
    rows = [("MATCHED", {"a": "b"}, "r/<x>", "d", 5, 1, None, [], None), ("ORPHAN_PARTIAL", None, "snmp/1/x", "d", 1, 2, "n", ["t"], None), ("AMBIGUOUS", None, "r/y", "d", 0, None, None, [], ["p", "q"])]
    page = report.page(spark.createDataFrame(rows, kinds), None, {"cutover": "<5>"})
    assert "&lt;5&gt;" in page and "<x>" not in page and "Ambiguous" in page and "http" not in page
