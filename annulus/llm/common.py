"""What the operators share: reading columns safely, shared-folder tables, bounded bitmaps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

MOST_BITS = 1 << 30
#: A key with more than one row in HOT_SHARE is dealt out over SALTS tasks, in tables of SPREAD_FROM rows or more.
HOT_SHARE, SALTS, SPREAD_FROM = 2048, 64, 20_000
_LOCAL: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the table holds.

    Columns are taken by position, so extra columns whose names differ only in case, hold dots
    or equal an operator's own working names can't clash.
    """
    ship(df.sparkSession)
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"the table lacks the column(s) {', '.join(missing)}")
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{at[n]}").alias(n) for n in names))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="annulus-"))
    return f"{base.rstrip('/')}/annulus-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again.

    The files live there until clear(): later reads, also after the loss of any executor, depend
    on nothing else.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    for paths in (_written.setdefault(spark.sparkContext.applicationId, []), _scope.get()):
        if paths is not None:
            paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, paths: Sequence[str] | None = None) -> None:
    """Delete all that stored() has written for this application, or the given tables of it.

    Results read from what is deleted must be done.
    """
    jvm, held = spark.sparkContext._jvm, _written.get(spark.sparkContext.applicationId, [])
    for path in [*(held if paths is None else paths)]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in held:
            held.remove(path)


@contextmanager
def settled(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of what this thread stores inside; at the end all of them are deleted that were
    left in the list.  Take out (pop) what is to stay.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)
        clear(spark, paths)


class Bitmap:
    """A Bloom filter with one hash over a long or string key, sized by a count of its keys.

    It has `each` bits or more for a key, up to `most`: that is the bound of what is broadcast
    (a byte for eight bits, in blocks that a lookup joins by number).  It never misses a key that
    was put in; one in `each` of the others is let through, so an exact join always follows, and
    a table with more keys than `most` allows for only has more to join.
    """

    def __init__(self, keys: DataFrame, key: str, bits: int | None = None, hashed: bool = True, each: int = 32, most: int = MOST_BITS) -> None:
        held = keys.where(F.col(key).isNotNull())
        self.bits = bits or min(most, 1 << max(16, (each * held.count()).bit_length()))
        self.hashed = hashed
        set_bits = held.select(self._at(key).alias("at")).select(F.shiftright("at", 6).alias("w"), F.col("at").bitwiseAND(63).cast("int").alias("b"))
        self.words = set_bits.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v"))  # at most bits / 64 rows

    def _at(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)) if self.hashed else F.col(key), F.lit(self.bits))

    def dense(self) -> np.ndarray:
        """The words on the driver, for tests with numpy."""
        out, found = np.zeros(max(1, self.bits // 64), dtype=np.int64), self.words.toArrow()
        out[found.column("w").to_numpy()] = found.column("v").to_numpy()
        return out

    @cached_property
    def blocks(self) -> DataFrame:
        """(__block, __words): 64 words to a row, blocks without a key left out."""
        entry = F.struct(F.col("w").bitwiseAND(63).cast("int").alias("i"), "v")
        grouped = self.words.groupBy(F.shiftright("w", 6).alias("__block")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
        words = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
        return stored(grouped.select("__block", words.alias("__words")))

    def keep(self, df: DataFrame, key: str, inside: bool = True) -> DataFrame:
        """The rows of df whose key may be in the set, or those whose key surely isn't (nulls too)."""
        at = self._at(key)
        word = F.get(F.col("__words"), F.shiftright(at, 6).bitwiseAND(63).cast("int"))
        may_be = F.coalesce(F.col(key).isNotNull() & (_bit(word, at.bitwiseAND(63).cast("int")) == 1), F.lit(False))
        joined = df.join(F.broadcast(self.blocks), F.shiftright(at, 12) == F.col("__block"), "inner" if inside else "left")
        return joined.where(may_be if inside else ~may_be).drop("__block", "__words")


def spread_join(many: DataFrame, few: DataFrame, on: Sequence[str], total: int, how: str = "inner") -> DataFrame:
    """many joined with few, which has each key once and in `__rows` how many rows of many have it.

    A key of which many has more than one row in HOT_SHARE is hot.  There are fewer than
    HOT_SHARE such keys whatever the input (their rows add up to no more than `total`), so their
    list may be broadcast; their rows are dealt out over SALTS tasks, and their row of few is
    repeated for each.  All other keys are joined as they are.  In a table of less than
    SPREAD_FROM rows nothing is hot.  A null key joins nothing.
    """
    if total < SPREAD_FROM:
        return many.join(few.drop("__rows"), [*on], how)
    hot = F.col("__rows") * HOT_SHARE > total
    names = [f"__{i}" for i in range(len(on))]
    keys = few.where(hot).select(*(F.col(c).alias(n) for c, n in zip(on, names)), F.lit(True).alias("__hot"))
    marked = many.join(F.broadcast(keys), [F.col(c) == F.col(n) for c, n in zip(on, names)], "left").drop(*names)
    dealt = marked.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    salts = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(few.withColumn("__salt", F.explode(salts)).drop("__rows"), [*on, "__salt"], how).drop("__salt")


def _bit(word: Column, bit: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1).cast("long"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def before(values: Column, fold, zero: Column, run: int = 16) -> Column:
    """For each place of an array, the fold of the elements before it.

    Runs of elements are folded first, so that a long array costs its length times `run` and
    not its square.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, fold)

    def places(d: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / run).cast("int")), lambda b: total(F.slice(d, b * run + 1, run)))
        starts = let(runs, lambda r: F.transform(r, lambda x, b: total(F.slice(r, F.lit(1), b))))

        def at(i: Column, r: Column) -> Column:
            b = F.floor(i / run).cast("int")
            return fold(F.get(r, b), total(F.slice(d, b * run + 1, i - b * run)))

        return let(starts, lambda r: F.transform(d, lambda x, i: at(i, r)))

    return let(values, lambda d: F.when(F.size(d) > 0, places(d)).otherwise(F.slice(d, 1, 0)))
