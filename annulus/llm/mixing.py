"""Mixing sources to target weights by systematic sampling.

Each document of a source stands for target / source size expected copies.  The expected
copies are prefix-summed over the source's documents, ordered by size so that neighbours are
alike; one random offset, drawn for each source from the seed, is added, and a document is
emitted once for each integer boundary that its interval crosses.

The prefix sum is distributed: the (small) size rows are range-partitioned by source and size,
numbered within each partition, and shifted by the counts of the partitions before.  A hot
source is spread over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for a null one.  Counted from word starts, without making an array of words."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\u0001")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of each source, one row per source.

    Sources take the weights in turn, by code point with null last, and share `share` times
    all sizes; none gets more than `most` times its size, and what that leaves is shared out
    again by weight.  The fixed point is found in closed form: with sources ordered by how soon
    they are full, the first that isn't full sets the level.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everywhere) - 1, F.lit(len(weights)))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), turn.cast("int"))
    ranked = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(first * F.col("weight"), F.col("cap"))).alias("target"))


def copies(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies), one row for each input row.

    Null texts have size 0, a null source is a source of its own, rows that repeat are
    documents of their own, an empty table gives no rows.  Ties in size go by key, and equal
    (source, size, key) rows are interchangeable.  Reruns agree.
    """
    return _drawn(docs, weights, share, most, seed, key, text, source).drop("same")


def _drawn(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, key: str, text: str, source: str) -> DataFrame:
    """copies() and `same`, a hash of the text and source that the copies are of."""
    rows = pick(docs, key, text, source)
    sizes = stored(rows.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _same(text, source).alias("same")))
    goal = stored(targets(sizes, weights, share, most))
    dealt = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("source", "part").orderBy(F.col("size").desc(), F.col("doc_id").asc_nulls_last())
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), earlier.alias("shift"))
    goal = goal.withColumnRenamed("source", "g")
    at = dealt.withColumn("row", F.row_number().over(within)).join(shifts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    at = at.join(goal, F.col("source").eqNullSafe(F.col("g"))).withColumn("rank", F.col("shift") + F.col("row"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))))
    offset = F.conv(F.substring(drawn, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    taken = F.floor(F.col("rank") * rate + offset) - F.floor((F.col("rank") - 1) * rate + offset)
    return at.select("doc_id", "same", "size", "source_size", "target", F.least(taken, F.ceil(F.lit(float(most)))).cast("long").alias("copies"))


def _same(text: str, source: str) -> Column:
    return F.xxhash64(F.col(text).isNull(), text, F.col(source).isNull(), source)


def mix(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents, each as often as it was drawn, with the columns of docs.

    Rows that share key, text and source share out the copies drawn for them; all others, also
    of one key or without one, have their own.
    """
    drawn = _drawn(docs, weights, share, most, seed, key, text, source)
    drawn = drawn.groupBy(F.col("doc_id").alias("__id"), F.col("same").alias("__hash")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    id_at, text_at, source_at = (f"c{names.index(n)}" for n in (key, text, source))
    rows = docs.toDF(*inner)
    joined = rows.withColumn("__same", _same(text_at, source_at)).join(drawn, F.col(id_at).eqNullSafe(F.col("__id")) & (F.col("__same") == F.col("__hash")))
    single = joined.where("__rows = 1").withColumn("__n", F.col("__copies"))
    turn = F.row_number().over(Window.partitionBy(id_at, "__same").orderBy("__rows"))
    several = joined.where("__rows > 1").withColumn("__k", turn)
    several = several.withColumn("__n", F.expr("__copies div __rows + if(__k <= __copies % __rows, 1, 0)")).drop("__k")
    out = single.unionByName(several).where("__n > 0").withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return out.select(*inner).toDF(*names)
