"""Scalar functions, value by value."""

import math

import pytest
from pyspark.sql import functions as F

from annulus.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("f", "given", "wanted"), [
    (S.metric_name, "9a:b-c", "_a:b_c"), (S.label_name, "a:b.c", "a_b_c"), (S.metric_name, "", ""), (S.node_prefix, "snmp/fs/a/b/c/d", "snmp/fs/a/b"),
    (S.node_prefix, "snmp/1/eth0", "snmp/1"), (S.node_prefix, "snmp/fs/a", "snmp/fs"), (S.dir_of, "a/b/c", "a/b"), (S.dir_of, "a", ""),
    (S.is_aliased, "snmp/dom/x", True), (S.is_aliased, "snmp/fs/x", False), (S.is_aliased, "snmp/12/x", False), (S.is_aliased, "snmp/dom", True), (S.is_aliased, "snmp/12", False), (S.is_aliased, "snmp/fs", False), (S.is_aliased, "response/dom", False),
    (S.promql_quote, 'a"\\\n', 'a\\"\\\\\\n'), (S.regex_escape, "a.b(c)", "a\\.b\\(c\\)"), (S.html_escape, "<a href='x'>&\"", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"),
    (S.scope_of, "${node:a|interface:b}", "INTERFACE"), (S.scope_of, "plain", "CONSTANT"), (S.scope_of, "${x", "UNCLASSIFIED"), (S.scope_of, "${a:b}", "METADATA"),
    (S.scope_of, "${:x|node:label}", "NODE"), (S.scope_of, "${:x}", "UNCLASSIFIED"), (S.scope_of, "${node:a}${x", "UNCLASSIFIED"), (S.scope_of, "a}b", "CONSTANT"),
])
def test_text(spark, f, given, wanted):
    assert value(spark, f(F.lit(given))) == wanted


def test_null_html_is_empty(spark):
    assert value(spark, S.html_escape(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("given", "wanted"), [("1.5", 1.5), (" -2e3 ", -2000.0), ("1_0", math.nan), ("U", math.nan), ("", math.nan), ("nan", math.nan)])
def test_lenient_double(spark, given, wanted):
    got = value(spark, S.lenient_double(F.lit(given)))
    assert got == wanted or math.isnan(got) and math.isnan(wanted)


def test_closeness(spark):
    near = lambda a, b, t: value(spark, S.is_close(F.lit(a), F.lit(b), F.lit(t)))
    assert near(1.0, 1.0, 0.0) and near(100.0, 100.5, 0.01) and not near(100.0, 102.0, 0.01) and not near(math.nan, math.nan, 1.0)


def test_backoff(spark):
    assert [r.x for r in spark.range(1, 9).select(S.backoff_seconds(F.col("id")).alias("x")).collect()] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_canonical_text_tells_sets_apart(spark):
    text = lambda **m: value(spark, S.canonical(F.create_map(*(F.lit(x) for kv in m.items() for x in kv))))
    assert text(b="1", a="2") == text(a="2", b="1") == "a=2,b=1"
    assert text(a="1,b=2") != text(a="1", b="2")


def test_interface_label(spark):
    label = lambda *a, **k: value(spark, S.interface_label(*(F.lit(x) for x in a), **k))
    assert label("eth0/1", "d", "001122334455") == "eth0_1-001122334455"
    assert label("eth0", "d", "00:11:22:33:44:55") == "eth0" and label("eth0", "d", ":001122334455.") == "eth0-001122334455" and label("eth0", "d", "0011223344") == "eth0"
    assert label(None, "d d", None) == "d_d" and label("a", "b c", "", prefer_descr=True) == "b_c"
    assert label("", "Gi 1", "") == "Gi_1" and label("é", "", "") == "__" and label("a-b", "", "", sanitize=False) == "a-b"


def test_node_expression(spark):
    node = {"id": F.lit(7), "label": F.lit(""), "location": F.lit("here"), "foreign_source": F.lit("fs"), "foreign_id": F.lit("x"), "assets": F.create_map(F.lit("rackUnit"), F.lit("r1"))}
    of = lambda e: value(spark, S.node_expression(e, node))
    assert of("${node:label|node:location}") == "here" and of("a ${node:criteria}") == "a fs:x" and of("${asset:rack-unit}") == "r1"
    assert of("${node:label}") == "" and of("${node:other}") is None and of("${open") is None and of("${node:label|none}") == "none"


def test_selectors(spark):
    m = F.create_map(F.lit("b"), F.lit('x"'), F.lit("a"), F.lit("y"))
    assert value(spark, S.exact_selector(m)) == '{a="y",b="x\\""}'
    assert value(spark, S.prefix_selector(F.lit("snmp/a.b"))) == '{resourceId=~"snmp/a\\\\.b/.+"}'
    assert value(spark, S.duration_text(F.lit(7_260_000), F.lit(1000))) == "2h 1m"
    assert value(spark, S.iso_instant(F.lit(1_700_000_000))) == "2023-11-14T22:13:20Z"
