"""The kernel against histories worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from annulus.operators import kernel

L = 1_800_000
NAN = float("nan")
ARCHIVES = "file string, rra int, cf string, pdp bigint, n bigint, step bigint, last_update bigint"
ROWS = "file string, rra int, row bigint, ds string, value double"
SOURCES = "file string, ds string, counter boolean, last_value double, pdp_value double"


def tables(spark, fine, coarse, *, last_update=L, reading=NAN, pending=NAN, counter=True, extra=()):
    shapes = [(0, "AVERAGE", 1, fine), (1, "AVERAGE", 12, coarse), *extra]
    archives = spark.createDataFrame([("f", r, cf, p, len(v), 300, last_update) for r, cf, p, v in shapes], ARCHIVES)
    rows = spark.createDataFrame([("f", r, i, "x", x) for r, _, _, v in shapes for i, x in enumerate(v)], ROWS)
    return archives, rows, spark.createDataFrame([("f", "x", counter, reading, pending)], SOURCES)


def points(out):
    return {r.ts - L: r.value for r in out.collect()}


def test_gauge_drops_what_straddles(spark):
    out = kernel.history(*tables(spark, [1.1, 1.2, 1.3, 1.4], [2.1, 2.2, 2.3], counter=False))
    assert points(out) == {-7200: 2.1, -3600: 2.2, -900: 1.1, -600: 1.2, -300: 1.3, 0: 1.4}


def test_counter_is_rebuilt_from_the_newest_reading(spark):
    out = kernel.history(*tables(spark, [1.0, 2.0, NAN, 4.0], [0.5, 0.25, 7.0], last_update=L + 100, reading=10_000.0, pending=50.0))
    assert points(out) == {-10800: -11650, -7200: -9850, -3600: -8950, -1200: 7850, -900: 8150, -600: 8750, -300: 8750, 0: 9950, 100: 10000}


def test_unknown_reading_counts_from_zero_without_a_point(spark):
    out = points(kernel.history(*tables(spark, [1.0, 2.0, 3.0, 4.0], [NAN] * 3, last_update=L + 100)))
    assert out[0] == 0 and 100 not in out and out[-1200] == -3000


def test_unknown_intervals_leave_the_reading(spark):
    assert points(kernel.history(*tables(spark, [NAN] * 4, [NAN] * 3, last_update=L + 7, reading=5.0))) == {7: 5.0}
    assert points(kernel.history(*tables(spark, [NAN] * 4, [NAN] * 3))) == {}
    assert points(kernel.history(*tables(spark, [NAN] * 4, [NAN] * 3, reading=5.0, counter=False))) == {}
    assert points(kernel.history(*tables(spark, [], [], reading=5.0))) == {}


def test_an_interval_wins_over_the_reading_at_its_end(spark):
    out = points(kernel.history(*tables(spark, [1.0] * 4, [NAN] * 3, reading=100.0, pending=10.0)))
    assert out[0] == 90


def test_selection(spark):
    extra = [(2, "MAX", 1, [0.0] * 9), (3, "AVERAGE", 12, [0.0] * 99), (4, "MAX", 12, [0.0] * 99), (5, "AVERAGE", 24, [0.0])]
    archives, *_ = tables(spark, [0.0] * 4, [0.0] * 3, extra=extra)
    assert sorted(r.rra for r in kernel.select_archives(archives).collect()) == [1, 2, 5]


def test_fold_is_sequential(spark):
    rates = [math.sin(i) * 1e3 + 1e-3 for i in range(3000)]
    out = points(kernel.history(*tables(spark, rates, [], reading=1e9, pending=0.0)))
    c, end = 1e9, 0
    for r in reversed(rates):
        assert out[end] == c
        c, end = c - r * 300, end - 300


def test_passes_split_the_history(spark):
    last = spark.createDataFrame([("f", L)], "file string, last_update bigint")
    ts = spark.createDataFrame([("f", L - 604_800 + d) for d in (-1, 0, 1)], "file string, ts bigint")
    assert [r["pass"] for r in kernel.with_pass(ts, last).orderBy("ts").collect()] == ["OLDER", "OLDER", "RECENT"]


def test_cutover_of_nothing(spark):
    assert kernel.cutover(spark.createDataFrame([], ARCHIVES)).first()[0] == 0


@pytest.mark.parametrize(("value", "before", "delta"), [(10, 4, 6), (4, 4294967290, 9)])
def test_wrap(spark, value, before, delta):
    assert spark.range(1).select(kernel.wrapped_delta(F.lit(value), F.lit(before))).first()[0] == delta
