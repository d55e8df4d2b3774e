"""What is written when: resume, order, batches, retries, rate and drift, as table operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def last_states(log: DataFrame) -> DataFrame:
    """The last line of each file and pass.  log: line, file, pass, status, samples, attempts, error, label_hash."""
    last = Window.partitionBy("file", "pass").orderBy(F.desc("line"))
    return log.where("file IS NOT NULL AND pass IS NOT NULL").withColumn("turn", F.row_number().over(last)).where("turn = 1").drop("turn")


def todo(files: DataFrame, states: DataFrame, *, retry_failed: bool = False) -> DataFrame:
    """The files of a pass still to be written, with `rewrite` for those done with other labels.

    A failed file comes again only on demand; a state without a hash counts as unchanged.
    """
    both = files.join(states.select("file", "status", F.col("label_hash").alias("done_hash")), "file", "left")
    if retry_failed:
        return both.where("status = 'FAILED'").withColumn("rewrite", F.lit(False)).select(*files.columns, "rewrite")
    changed = (F.col("status") == "DONE") & F.col("done_hash").isNotNull() & (F.col("done_hash") != F.col("label_hash"))
    return both.withColumn("rewrite", F.coalesce(changed, F.lit(False))).where(F.col("status").isNull() | F.col("rewrite")).select(*files.columns, "rewrite")


def rewritten(todo: DataFrame) -> int:
    """How many files are written again because their planned labels changed."""
    return todo.where("rewrite").count()


def unwritable(files: DataFrame, entries: DataFrame, read: DataFrame) -> DataFrame:
    """(file, error) of the files of a pass that can't be written.

    entries: file, ds, labels; read: file, error, names (data sources that can be written) of the
    archive files as found now.  A file that is gone or can't be read, and one without a planned
    data source (the first by name is told), is never written in part.
    """
    planned = entries.where("labels IS NOT NULL").join(files.select("file"), "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_set("ds")).alias("planned"))
    both = planned.join(read.select("file", "names", "error", F.lit(True).alias("found")), "file", "left")
    lost = F.get(F.array_except("planned", F.coalesce("names", F.array().cast("array<string>"))), 0)
    error = (
        F.when(F.col("found").isNull(), "read: no such file").when(F.col("error").isNotNull(), F.concat(F.lit("read: "), "error"))
        .when(lost.isNotNull(), F.concat(F.lit("planned data source "), lost, F.lit(" missing from file")))
    )
    return both.select("file", error.alias("error")).where("error IS NOT NULL")


def outcomes(files: DataFrame, bad: DataFrame, sent: DataFrame) -> DataFrame:
    """(file, status, samples, attempts, error) of the files of a pass: FAILED for the unwritable,
    what the writers say (sent), and DONE for readable files that have nothing in the pass."""
    failed = bad.select("file", F.lit("FAILED").alias("status"), F.lit(0).cast("long").alias("samples"), F.lit(1).alias("attempts"), "error")
    rest = files.select("file").join(bad, "file", "left_anti").join(sent, "file", "left_anti")
    empty = rest.select("file", F.lit("DONE").alias("status"), F.lit(0).cast("long").alias("samples"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return failed.unionByName(sent.select(*failed.columns)).unionByName(empty)


def file_order(entries: DataFrame) -> DataFrame:
    """(file, has_orphan, first): files without an orphan first, else in the order of the plan."""
    grouped = entries.where("labels IS NOT NULL").groupBy("file").agg(F.bool_or(S.is_orphan(F.col("class"))).alias("has_orphan"), F.min("position").alias("first"))
    return grouped.orderBy("has_orphan", "first")


def chunks(samples: DataFrame, size: int) -> DataFrame:
    """Adds `chunk`: slices of at most `size` samples of each series, by time."""
    own = Window.partitionBy("file", "ds").orderBy("ts")
    return samples.withColumn("chunk", F.floor((F.row_number().over(own) - 1) / size))


def batches(samples: DataFrame, size: int) -> DataFrame:
    """(file, ds, chunk, n, batch): slices packed in order; a batch is closed when the next slice doesn't fit."""
    if size < 1:
        raise ValueError("a batch holds one sample at least")
    slices = chunks(samples, size).groupBy("file", "ds", "chunk").agg(F.count("*").alias("n"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ds", "chunk"])
        numbers, batch, filled = [], 0, 0
        for n in part["n"]:
            if filled and filled + n > size:
                batch, filled = batch + 1, 0
            filled += n
            numbers.append(batch)
        return part.assign(batch=numbers)[["file", "ds", "chunk", "n", "batch"]]

    kinds = dict(slices.dtypes)
    return slices.groupBy("file").applyInPandas(pack, f"file {kinds['file']}, ds {kinds['ds']}, chunk bigint, n bigint, batch bigint")


def attempts(retries: int) -> Iterator[int]:
    """Seconds to wait before each further attempt."""
    for attempt in range(1, retries + 1):
        yield min(60, 1 << min(6, attempt - 1))


def write_schedule(sizes: list[int], rate: float, arrivals: list[float] | None = None) -> list[float]:
    """When each write may begin: the first at once, no credit for idle time, no limit at rate 0."""
    starts, free = [], 0.0
    for i, n in enumerate(sizes):
        now = arrivals[i] if arrivals else 0.0
        start = max(now, free) if rate > 0 else now
        starts.append(start)
        free = start + n / rate if rate > 0 else start
    return starts


def drawn(rows: DataFrame, key: Column, n: int, seed: int, *by: str) -> DataFrame:
    """At most n rows of each stratum, or of all, by a seeded hash of their key.

    Without strata no task sorts all rows: hashes are even, so all but about n rows lie above a
    bound that the count gives, and only the others are sorted.  Should fewer than n lie below
    it, all rows are.
    """
    drawn_by = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    if not by:
        total = rows.count()
        bound = int(16**12 * min(1.0, (n + 8 * n**0.5 + 8) / max(1, total)))
        below = rows.where(F.substring(drawn_by, 1, 12) < F.lit(f"{bound:012x}")) if bound < 16**12 else rows
        return (below if below.count() >= min(n, total) else rows).orderBy(drawn_by, key).limit(n)
    turn = Window.partitionBy(*by).orderBy(drawn_by, key)
    return rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n).drop("turn")


def live_after(backend: DataFrame, cutover: int | None) -> DataFrame:
    """(canon, live): series with a sample after the cutover, or any series without one.  backend: canon, ts_ms."""
    rows = backend.where(F.col("ts_ms") > cutover * 1000) if cutover else backend
    return rows.select("canon").distinct().withColumn("live", F.lit(True))


def label_drift(entries: DataFrame, live: DataFrame, *, canary: int, seed: int) -> DataFrame:
    """(file, ds, class, kind) of what changed since the plan, from a sample of each class.

    A matched entry whose key has a live set other than the planned one, and an orphan that has
    become live with other labels, stop the writing; a pending one that is live is a notice.
    live: resource_id, metric, canon of series with samples after the cutover.
    """
    stratum = F.when(F.col("class") == "MATCHED", "matched").when(F.col("class") == "PENDING", "pending").when(S.is_orphan(F.col("class")), "orphan")
    sample = drawn(entries.withColumn("stratum", stratum).where("stratum IS NOT NULL"), F.concat_ws("/", "file", "ds"), canary, seed, "stratum")
    keyed = sample.withColumn("resource_id", S.label_value(F.col("resource"))).withColumn("metric", S.metric_name(F.col("ds"))).withColumn("planned", S.canonical(F.col("labels")))
    found = keyed.join(live.select("resource_id", "metric", F.col("canon").alias("now")), ["resource_id", "metric"])
    kind = F.when(F.col("stratum") == "pending", "notice").when(F.col("now") != F.col("planned"), "stop")
    return found.withColumn("kind", kind).where("kind IS NOT NULL").select("file", "ds", "class", "kind").distinct()
