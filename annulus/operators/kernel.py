"""The time-series kernel: archives of several resolutions to one history.

Archives come as long tables.  `archives`: file, rra, cf, pdp (steps in a row), n (rows), step,
last_update.  `rows`: file, rra, row (0 is the oldest), ds, value (a rate for counters, NULL or
NaN where unknown).  `sources`: file, ds, counter, last_value, pdp_value.  Times are epoch
seconds.  Every window is partitioned by file, or by file and data source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import RECENT_SECONDS


def known(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def row_end(last_update: Column, step: Column, pdp: Column, n: Column, row: Column) -> Column:
    """When a row's interval ends: the archive's last boundary, counted back."""
    span = step * pdp
    return last_update - F.pmod(last_update, span) - (n - 1 - row) * span


def select_archives(archives: DataFrame) -> DataFrame:
    """The archives that make the history: of those with one step in a row the one with the
    most rows, whatever its function, the first on a tie; then the first AVERAGE archive of
    every other resolution."""
    size = Window.partitionBy("file").orderBy(F.desc("n"), "rra")
    finest = archives.where("pdp = 1").withColumn("turn", F.row_number().over(size)).where("turn = 1").drop("turn")
    average = archives.where("cf = 'AVERAGE'").join(finest.select("file", "pdp"), ["file", "pdp"], "left_anti")
    first = Window.partitionBy("file", "pdp").orderBy("rra")
    coarse = average.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")
    return finest.unionByName(coarse.select(*finest.columns))


def coverage(selected: DataFrame) -> DataFrame:
    """Adds `limit`, where the finer archives' time range begins (NULL: none is finer), and
    `span`.  It goes by the range of an archive, not by which of its rows are known."""
    span = F.col("step") * F.col("pdp")
    begin = F.when(F.col("n") > 0, row_end(F.col("last_update"), F.col("step"), F.col("pdp"), F.col("n"), F.lit(0)) - span)
    finer = Window.partitionBy("file").orderBy("pdp").rowsBetween(Window.unboundedPreceding, -1)
    return selected.withColumn("span", span).withColumn("limit", F.min(begin).over(finer))


def stitch(archives: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, ds, end, span, value, partial): non-overlapping intervals (end - span, end].

    A coarse row that straddles the begin of the finer archives is cut there and marked as
    partial; what lies behind it is dropped.
    """
    chosen = coverage(select_archives(archives)).select("file", "rra", "pdp", "n", "step", "last_update", "span", "limit")
    at = rows.join(chosen, ["file", "rra"]).withColumn("t", row_end(F.col("last_update"), F.col("step"), F.col("pdp"), F.col("n"), F.col("row")))
    begin = F.col("t") - F.col("span")
    whole = F.col("limit").isNull() | (F.col("t") <= F.col("limit"))
    kept = at.where(whole | (begin < F.col("limit"))).withColumn("end", F.when(whole, F.col("t")).otherwise(F.col("limit")))
    return kept.select("file", "ds", "end", (F.col("end") - begin).alias("span"), "value", (~whole).alias("partial"))


def gauge_points(intervals: DataFrame) -> DataFrame:
    """(file, ds, ts, value): whole known intervals, at their ends."""
    return intervals.where(~F.col("partial") & known(F.col("value"))).select("file", "ds", F.col("end").alias("ts"), "value")


def counter_points(intervals: DataFrame, sources: DataFrame, last_update: DataFrame) -> DataFrame:
    """(file, ds, ts, value): readings of monotonic counters, rebuilt from the newest one back.

    The newest reading less what came since the last step is the value at the newest interval's
    end; each known interval takes its rate times its span off.  A seed row carries the first
    value through the window, so that the sum is the sequential fold.  Unknown intervals change
    nothing.  The reading itself is a point too, unless an interval has one at that time, and
    also where all intervals are unknown; without any interval there is none, and an unknown
    reading counts as 0 without a point.
    """
    steps = intervals.where(known(F.col("value"))).select("file", "ds", "end", "span", (-F.col("value") * F.col("span")).alias("change"), F.lit(1).alias("kind"))
    heads = sources.join(last_update, "file").join(intervals.select("file", "ds").distinct(), ["file", "ds"], "left_semi")
    pending = F.when(known(F.col("pdp_value")), F.col("pdp_value")).otherwise(0.0)
    first = F.when(known(F.col("last_value")), F.col("last_value") - pending).otherwise(0.0)
    seeds = heads.select("file", "ds", F.lit(None).cast("long").alias("end"), F.lit(None).cast("long").alias("span"), first.alias("change"), F.lit(0).alias("kind"))
    back = Window.partitionBy("file", "ds").orderBy("kind", F.desc("end"))
    here = F.sum("change").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.sum("change").over(back.rowsBetween(Window.unboundedPreceding, -1))
    folded = seeds.unionByName(steps).withColumn("after", here).withColumn("before", above).where("kind = 1")
    ends = F.array(F.struct(F.col("end").alias("ts"), F.col("before").alias("value")), F.struct((F.col("end") - F.col("span")).alias("ts"), F.col("after").alias("value")))
    points = folded.select("file", "ds", "end", F.explode(ends).alias("p")).select("file", "ds", "p.ts", "p.value", (-F.col("end")).alias("turn"), F.lit(1).alias("prio"))
    anchors = heads.where(known(F.col("last_value"))).select("file", "ds", F.col("last_update").alias("ts"), F.col("last_value").alias("value"), F.lit(0).cast("long").alias("turn"), F.lit(0).alias("prio"))
    every = points.unionByName(anchors.select(*points.columns))
    return every.groupBy("file", "ds", "ts").agg(F.max_by("value", F.struct("prio", "turn")).alias("value"))


def history(archives: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, ds, counter, ts, value, pass): the whole history of every data source."""
    last = archives.groupBy("file").agg(F.max("last_update").alias("last_update"))
    intervals = stitch(archives, rows).join(sources.select("file", "ds", "counter"), ["file", "ds"])
    gauges = gauge_points(intervals.where("NOT counter")).withColumn("counter", F.lit(False))
    counters = counter_points(intervals.where("counter"), sources.where("counter"), last).withColumn("counter", F.lit(True))
    return with_pass(gauges.unionByName(counters), last)


def with_pass(points: DataFrame, last: DataFrame) -> DataFrame:
    """Adds `pass`: RECENT for the last seven days of a file, OLDER before."""
    recent = F.col("ts") > F.col("last_update") - RECENT_SECONDS
    return points.join(last, "file").withColumn("pass", F.when(recent, "RECENT").otherwise("OLDER")).drop("last_update")


def to_series(points: DataFrame) -> DataFrame:
    """(file, ds, ts_ms, value) arrays, ascending: the shape at the sink only."""
    pairs = F.array_sort(F.collect_list(F.struct((F.col("ts") * 1000).alias("ts_ms"), "value")))
    made = points.groupBy("file", "ds").agg(pairs.alias("p"))
    return made.select("file", "ds", F.transform("p", lambda x: x["ts_ms"]).alias("ts_ms"), F.transform("p", lambda x: x["value"]).alias("value"))


def oldest_row_time(archives: DataFrame) -> DataFrame:
    """(file, oldest): when the first row of the selected archives ends."""
    first = row_end(F.col("last_update"), F.col("step"), F.col("pdp"), F.col("n"), F.lit(0))
    return select_archives(archives).where("n > 0").groupBy("file").agg(F.min(first).alias("oldest"))


def cutover(archives: DataFrame) -> DataFrame:
    """One row: the newest update of any file, 0 without one."""
    return archives.agg(F.coalesce(F.max("last_update"), F.lit(0).cast("long")).alias("cutover"))


def wrapped_delta(value: Column, before: Column) -> Column:
    """Increase of a 32-bit counter; where it falls, it passed its greatest value 2**32 - 1."""
    delta = value - before
    return F.when(delta < 0, delta + F.lit(4294967295)).otherwise(delta)


def ring_row(slot: Column, current: Column, n: Column) -> Column:
    """The place, oldest first, of a slot of a ring whose newest row lies at `current`."""
    return F.pmod(slot - current - 1, n)


def consolidate(samples: DataFrame, span: int) -> DataFrame:
    """(file, end, avg_value, min_value, max_value, n) of samples (file, ts, cents) by interval.

    Values are whole hundredths, so that sums don't depend on their order.
    """
    end = F.floor(F.col("ts") / span) * span + span
    grouped = samples.groupBy("file", end.alias("end"))
    return grouped.agg(
        (F.sum("cents") / F.count("*") / 100).alias("avg_value"), (F.min("cents") / 100).alias("min_value"), (F.max("cents") / 100).alias("max_value"), F.count("*").alias("n")
    )
