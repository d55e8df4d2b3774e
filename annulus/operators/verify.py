"""Completeness, verification by reading back, and the tables of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .writing import drawn

PASSES = ("RECENT", "OLDER")
LIST_ROWS = 1000


def not_done(files: DataFrame, states: DataFrame) -> DataFrame:
    """Files, sorted, that aren't done in both passes with the planned labels.  files: file, label_hash."""
    done = states.where("status = 'DONE'").join(files, "file").where(states["label_hash"].isNull() | (states["label_hash"] == files["label_hash"]))
    both = done.groupBy("file").agg(F.count_distinct("pass").alias("n")).where(F.col("n") == len(PASSES)).select("file")
    return files.join(both, "file", "left_anti").select("file").orderBy("file")


def not_migrated(entries: DataFrame) -> DataFrame:
    return entries.where("labels IS NULL").groupBy("class").agg(F.count("*").alias("n"))


def selection(files: DataFrame, states: DataFrame, *, percent: float, seed: int, every: bool = False) -> DataFrame:
    """The files to verify: a seeded share, one at least, and all that took more than one attempt."""
    if every:
        return files.select("file").distinct()
    n = files.count()
    size = min(n, max(1, -(-int(n * percent * 1000) // 100_000))) if n else 0
    retried = states.where("attempts > 1").select("file").join(files, "file", "left_semi")
    return drawn(files.select("file"), F.col("file"), size, seed).unionByName(retried.select("file")).distinct()


def compare(expected: DataFrame, stored: DataFrame, tolerance: float) -> DataFrame:
    """(canon, ts, kind): missing, value or delta.  expected: canon, counter, ts, value; stored: canon, ts, value.

    Series that the backend could not be asked for (stored has a row with an `error` for them, if
    it has that column) are one mismatch of kind read, at no time.  Gauges compare values; counters compare the increase since the expected time before, within
    the tolerance of the largest of the four values.  NaN agrees with nothing.
    """
    unread = None
    if "error" in stored.columns:
        unread = stored.where("error IS NOT NULL").select("canon").distinct()
        expected = expected.join(unread, "canon", "left_anti")
    both = expected.join(stored.select("canon", "ts", F.col("value").alias("got")), ["canon", "ts"], "left")
    order = Window.partitionBy("canon").orderBy("ts")
    both = both.withColumn("value0", F.lag("value").over(order)).withColumn("got0", F.lag("got").over(order))
    eps = F.lit(float(tolerance))
    most = F.greatest(*(F.abs(c) for c in ("value", "got", "value0", "got0")))
    drift = F.abs((F.col("got") - F.col("got0")) - (F.col("value") - F.col("value0")))
    nan = F.isnan("value") | F.isnan("got") | F.isnan("value0") | F.isnan("got0")
    wrong_delta = F.col("value0").isNotNull() & F.col("got0").isNotNull() & (nan | ~(drift <= eps * most))
    kind = F.when(F.col("got").isNull(), "missing").when(~F.col("counter") & ~S.is_close(F.col("value"), F.col("got"), eps), "value").when(F.col("counter") & wrong_delta, "delta")
    wrong = both.withColumn("kind", kind).where("kind IS NOT NULL").select("canon", "ts", "kind")
    return wrong if unread is None else wrong.unionByName(unread.select("canon", F.lit(None).cast("long").alias("ts"), F.lit("read").alias("kind")))


def unread_files(files: DataFrame, read: DataFrame) -> DataFrame:
    """(file, kind): a mismatch of kind read for each file to verify that is gone or can't be read.  read: file, error."""
    good = read.where("error IS NULL").select("file")
    return files.select("file").distinct().join(good, "file", "left_anti").select("file", F.lit("read").alias("kind"))


def root_counts(entries: DataFrame) -> DataFrame:
    """(root, n): entries of each root of the tree."""
    rows = entries.where("resource IS NOT NULL")
    return rows.groupBy(F.get(F.split("resource", "/"), 0).alias("root")).agg(F.count("*").alias("n")).orderBy("root")


def class_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("class").agg(F.count_if(F.col("labels").isNotNull()).alias("written"), F.count_if(F.col("labels").isNull()).alias("not_written"))


def label_coverage(entries: DataFrame, classes: list[str]) -> DataFrame:
    """(label, one column per class, total): written series that carry each label."""
    each = entries.where("labels IS NOT NULL").select("class", F.explode(F.map_keys("labels")).alias("label"))
    wide = each.groupBy("label").pivot("class", classes).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return wide.withColumn("total", total)


def unresolved_by_node(entries: DataFrame) -> DataFrame:
    """(node, n, tags) of partial entries."""
    partial = entries.where("class = 'ORPHAN_PARTIAL'").select(S.node_prefix(F.col("resource")).alias("node"), "unresolved")
    return partial.groupBy("node").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("unresolved")))).alias("tags")).orderBy("node")


def capped(rows: DataFrame, order: list[Column], cap: int = LIST_ROWS) -> tuple[DataFrame, int]:
    """A report's list and how many rows there are in all."""
    return rows.orderBy(*order).limit(cap), rows.count()


def plan_summary(entries: DataFrame, rate: float) -> DataFrame:
    """One row: series, samples, oldest sample and the time that writing takes."""
    written = entries.where("labels IS NOT NULL")
    totals = written.agg(F.count("*").alias("series"), F.coalesce(F.sum("n_samples"), F.lit(0)).alias("samples"), F.coalesce(F.min("oldest"), F.lit(0)).alias("oldest"))
    return totals.withColumn("eta", S.duration_text(F.col("samples"), F.lit(rate)))


def not_migrated_list(entries: DataFrame) -> DataFrame:
    rows = entries.where("labels IS NULL").select("class", F.coalesce("resource", "file").alias("what"), "ds", "note")
    return rows.orderBy("class", "what", "ds", "note")


def orphan_resources(entries: DataFrame) -> DataFrame:
    return entries.where(S.is_orphan(F.col("class"))).select("resource").distinct().orderBy("resource")


def explain(entries: DataFrame, resource: str, ds: str | None = None) -> DataFrame:
    """(ds, class, label, value, source, note): why a resource's series get their labels."""
    chosen = entries.where(F.col("resource") == resource)
    chosen = chosen.where(F.col("ds") == ds) if ds else chosen
    each = chosen.select("ds", "class", "note", "sources", F.explode_outer("labels").alias("label", "value"))
    return each.select("ds", "class", "label", "value", F.element_at("sources", F.col("label")).alias("source"), "note").orderBy("ds", "label")
