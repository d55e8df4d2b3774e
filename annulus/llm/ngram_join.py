"""N-gram Jaccard join: which documents' sets of word n-grams are alike, and in which groups.

1. Order.  One pass counts n-gram occurrences in a sketch of bounded size; the global order of
   n-grams is (count class, hash), rare ones first.  Any fixed order gives right results; this
   one keeps passages that many documents share out of the prefixes.  Where far more n-grams
   than cells are counted a cell's count is mostly chance, whose spread is the square root of
   that count; classes are finer than it, so an n-gram that few documents share still stands
   behind those that none do.
2. Classes.  Documents with equal sets are one class, represented by the least id.
3. Prefixes.  Two sets that reach the threshold share at least MEET n-grams (or all they need)
   among the first n - ceil(t * n) + MEET of each; what two prefixes share, and what can follow
   behind them, bounds the overlap.  Prefix n-grams that only one class has are dropped.
4. Stars.  In each n-gram's bucket the members are compared with one pivot, the least id, which
   stands first where the bucket is sorted; the links found join components, and a bucket whose
   members are all in one component is finished.  Groups of copies are settled here with as many
   comparisons as members.
5. Rest.  In the other buckets every two members of different components meet, and those whose
   sizes and shared prefixes allow a link are compared: exact, without a cap.
6. Counts.  Of each set the n-grams are counted in cells by hash; the sum of the lesser counts
   of two sets bounds their overlap, so most pairs that don't link go without their texts.
7. Prefix tree.  Comparisons of one document are made together: the candidates' sets, in the
   global order, form a prefix tree, kept as sorted paths with the length that each shares with
   the one before; the overlap of a shared path is counted once, and a path is left when what
   remains of both sets, by their places in the global order, can't reach the overlap that is
   needed any more.  Rare n-grams come first, so paths of unlike sets are left early.

A token, class or pivot that very many rows hold is dealt out over several tasks where rows are
joined by it, and counted within tasks before they meet.

Hashes have 64 bits; within two compared sets of a million n-grams two different ones coincide
with a probability below one in a million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, pick, spread_join, stored
from .components import components
from .textscan import mix, shingles, slices

CELLS, MOST_CELLS = 1 << 20, 1 << 22  # one for each CELL_BYTES of text, between these
CELL_BYTES = 1 << 10
BLOCKS = 64
SALTS = 8
EXACT = 1 << 12  # counts up to this are classes of their own; beyond, STEPS to a factor of two
STEPS = 512
SHIFT = 48  # bits of a place below its class
HOT_CLASS = EXACT + 8 * STEPS  # from 2**20 occurrences on, a bucket's rows are dealt out by document as well
GROUP_BYTES = 8 << 20
CANDIDATES = 128
MEET = 3
LARGE_BUCKET = 64
BLOCK_SETS = 512
_U = np.uint64


def _need(x: int, y: int, percent: int) -> int:
    """Least overlap of sets of x and y that reaches the threshold."""
    return -(-percent * (x + y) // (100 + percent))


def cells_for(rows: DataFrame) -> int:
    """Cells of the sketch: a power of two that follows the bytes of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_CELLS, max(CELLS, 1 << (size // CELL_BYTES).bit_length()))


def count_classes(counts: np.ndarray) -> np.ndarray:
    """Class of each count, not falling: the count itself, then steps of its logarithm; below 2**14."""
    c = np.maximum(counts, _U(1))
    return np.where(c < EXACT, c, (EXACT + STEPS * np.maximum(0, np.log2(c / EXACT))).astype(np.uint64)).astype(np.uint16)


def order_classes(rows: DataFrame, k: int) -> np.ndarray:
    """Class of each sketch cell, by its count.

    Counts are summed within a task, then over salted blocks, then over blocks; the driver gets
    two bytes a cell, at most 2 * MOST_CELLS whatever the input.  Counts travel as byte planes,
    of which the upper ones are mostly zeros.
    """
    cells = cells_for(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                found = [*shingles(data, offsets, k)]
                np.add.at(total, (np.concatenate(found) & _U(cells - 1)).astype(np.int64), np.uint32(1))
        if total.any():
            yield blocks(range(BLOCKS), [planes(c) for c in total.reshape(BLOCKS, -1)])

    def blocks(ids, parts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def planes(counts: np.ndarray) -> bytes:
        narrow = np.minimum(counts, (1 << 32) - 1).astype("<u4")  # beyond that, the order is by hash
        return narrow.view(np.uint8).reshape(-1, 4).T.tobytes()

    def summed(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.ascontiguousarray(np.frombuffer(c.as_buffer(), dtype=np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.uint64)
                sums[i] = sums[i] + part if i in sums else part
        return sums

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sums := summed(batches):
            yield blocks(list(sums), [planes(c) for c in sums.values()])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sums := summed(batches):
            yield blocks(list(sums), [count_classes(c).tobytes() for c in sums.values()])

    schema = "block int, counts binary"
    parts = rows.mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = parts.repartition(BLOCKS, "block", "salt").select("block", "counts").mapInArrow(add, schema)
    classes = np.zeros((BLOCKS, cells // BLOCKS), dtype=np.uint16)
    for block, counts in salted.repartition(BLOCKS, "block").mapInArrow(classify, schema).collect():  # two bytes a cell
        classes[block] = np.frombuffer(counts, dtype=np.uint16)
    return classes.reshape(-1)


def _places(u: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The n-grams' places in the global order: the class above SHIFT bits of the hash."""
    return (classes[(u & _U(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << _U(SHIFT)) | (u >> _U(64 - SHIFT))


def cell_counts(u: np.ndarray) -> bytes:
    """How many n-grams of a set fall into each of its cells, of which there is one for two n-grams; 255 stands for that or more."""
    cells = 1 << min(13, max(5, (len(u) // 2).bit_length()))
    return np.minimum(np.bincount(((u >> _U(32)) & _U(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def overlap_bound(one: bytes, two: bytes) -> int:
    """No less than the overlap of the two sets with these cell counts; the finer ones are folded."""
    cells, folded = min(len(one), len(two)), []
    for c in (one, two):
        counts = np.frombuffer(c, dtype=np.uint8).astype(np.int32)
        counts[counts == 255] = 1 << 16  # no bound then; counts of 254 folded 2**8 to one stay below it
        folded.append(counts.reshape(-1, cells).sum(axis=0, dtype=np.int64) if len(counts) > cells else counts)
    return int(np.minimum(*folded).sum(dtype=np.int64)) if max(map(int, map(np.max, folded))) < 1 << 16 else 1 << 62


def prefixes(rows: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """(id, n, s1, s2, tokens, counts) of every row: set size, signature, ordered prefix, cell counts.

    A token is an n-gram's place in the global order; `shared` holds the broadcast classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                size, one, two, tokens, counts = [], [], [], [], []
                for found in shingles(data, offsets, k):
                    u = np.unique(found)
                    n = len(u)
                    size.append(n)
                    one.append(int(mix(u).sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(mix(u ^ _U(0x5851F42D4C957F2D))).astype(np.int64)) if n else 0)
                    counts.append(cell_counts(u))
                    token = np.sort(_places(u, classes))
                    tokens.append(token[: n - -(-percent * n // 100) + MEET if n else 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(size)), pa.array(size, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(counts, pa.binary())],
                    names=["id", "n", "s1", "s2", "tokens", "counts"],
                )

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n int, s1 bigint, s2 bigint, tokens array<bigint>, counts binary")


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(token, pos, id, n, q, m, qos) of the prefix tokens that more than one set has.

    Rows come sorted by token and id; a row stays if the one before or behind it has its token,
    so no bucket is gathered.  q, m and qos are id, n and pos of the first row of the token.
    Rows of very common tokens are dealt out by id too; all of them stay, and their q is null.
    """
    rows = sets.select(F.posexplode("tokens").alias("pos", "token"), "id", "n").select("token", "pos", "id", "n")
    hot = F.when(F.col("token") >= F.lit(HOT_CLASS << SHIFT), F.pmod(F.xxhash64("id"), F.lit(64))).otherwise(F.lit(0))

    names, types = ["token", "pos", "id", "n", "q", "m", "qos"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def laid_out(columns: list[np.ndarray], pivots: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        common = (columns[0] >= HOT_CLASS << SHIFT)[keep]
        made = [pa.array(c[keep], t) for c, t in zip(columns, types)] + [pa.array(p[keep], t, mask=common) for p, t in zip(pivots, types[4:])]
        return pa.RecordBatch.from_arrays(made, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last row, undecided
        first: list[np.ndarray] = []  # id, n and pos of the first row of its token
        twin = False  # whether it equals the one before it
        for batch in batches:
            if not len(batch):
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)] if held else columns
            t = columns[0]
            same = t[1:] == t[:-1]
            keep = np.zeros(len(t), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= twin
            keep |= t >= HOT_CLASS << SHIFT
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(t)), 0))
            pivots = [columns[i][start] for i in (2, 3, 1)]
            if held:
                for p, f in zip(pivots, first):
                    p[start == 0] = f
            yield laid_out([c[:-1] for c in columns], [p[:-1] for p in pivots], keep[:-1])
            twin, held, first = bool(keep[-1]) if len(t) > 1 else twin, [c[-1:] for c in columns], [p[-1:] for p in pivots]
        if held:
            yield laid_out(held, first, (held[0] >= HOT_CLASS << SHIFT) | twin)

    ordered = rows.repartition("token", hot).sortWithinPartitions("token", "id", "n", "pos")
    return ordered.mapInArrow(run, "token bigint, pos int, id bigint, n int, q bigint, m int, qos int")


def _meetings(both: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b, x, y, reach) for members of one bucket, of different components, whose sizes allow a link.

    both joins members with columns token, q, m, qos and d of others.  a is the smaller id, x
    and y are the sizes; reach bounds the overlap if the bucket's n-gram is the first that both have.
    """
    meet = (F.col("id") < F.col("q")) if every else (F.col("id") != F.col("q"))
    both = both.where(meet & (F.col("comp") != F.col("d")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    swap = F.col("id") > F.col("q")
    return both.select(
        F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("x"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("y"), F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("qos")).alias("reach")
    )


def _need_of(percent: int) -> Column:
    return F.ceil((F.col("x") + F.col("y")) * percent / (100 + percent))


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Members and their bucket's pivot, unless the sizes or the places in the order rule a link out.

    The pivots of very common tokens, whose rows are in several tasks, are found by a minimum.
    """
    common = stored(members.where("q IS NULL").drop("q", "m", "qos"))
    least = common.groupBy("token").agg(F.min(F.struct("id", "n", "pos")).alias("p"), F.count("*").alias("__rows"))
    pivots = least.select("token", "__rows", F.col("p.id").alias("q"), F.col("p.n").alias("m"), F.col("p.pos").alias("qos"))
    found = spread_join(common, pivots, ["token"], common.count()).select(*members.columns)
    both = members.where("q IS NOT NULL").unionByName(found).withColumns({"comp": F.col("id"), "d": F.col("q")})
    return _meetings(both, percent, False).where(F.col("reach") >= _need_of(percent)).select("a", "b").distinct()


def _behind(n: str, percent: int) -> Column:
    """How many n-grams of a set stand behind its prefix.

    What two sets share beyond their prefixes stands, in the one whose prefix ends earlier in
    the order, behind it; which one that is isn't known here, so the larger number counts.
    """
    return F.greatest(F.lit(0), F.ceil(F.col(n) * percent / 100) - MEET)


def _rest_pairs(active: DataFrame, percent: int) -> DataFrame:
    """Every pair of different components, unless what the prefixes share can't be enough.

    active: token, pos, id, n, comp, and `large` for buckets of more than LARGE_BUCKET rows.

    In small buckets members meet by a join, and the buckets in which a pair meets are counted.
    Members of large buckets are dealt into blocks, in which their shared n-grams are counted
    at once.  Either count is short of the other kind's n-grams by no more than the set with
    fewer of them has, so no pair is missed.
    """
    sets = stored(active.groupBy("id", "n", "comp").agg(F.count_if(~F.col("large")).alias("small"), F.array_sort(F.collect_list(F.when(F.col("large"), F.col("token")))).alias("tokens")))
    few = active.where(~F.col("large"))
    other = few.select("token", F.col("id").alias("q"), F.col("n").alias("m"), F.col("pos").alias("qos"), F.col("comp").alias("d"))
    met = _meetings(few.join(other, "token"), percent, True).groupBy("a", "b", "x", "y").agg(F.count("*").alias("c"))
    in_large = sets.where(F.size("tokens") > 0)
    more = in_large.select("id", F.size("tokens").alias("t"))
    met = met.join(more.withColumnsRenamed({"id": "a", "t": "ta"}), "a", "left").join(more.withColumnsRenamed({"id": "b", "t": "tb"}), "b", "left").na.fill(0, ["ta", "tb"])
    near = met.where(F.col("c") + F.least("ta", "tb") + F.greatest(_behind("x", percent), _behind("y", percent)) >= _need_of(percent)).select("a", "b")
    return near.unionByName(_block_pairs(stored(active.where("large").select("token", "id")), in_large, percent)).distinct()


def _block_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets (id, n, comp, small, tokens) that share tokens of large buckets; rows: token, id.

    Sets that meet in large buckets form clusters, and a cluster is parted into bands of sizes so
    wide that only sets of one band or of neighbouring ones can link.  A band is dealt into
    blocks of about BLOCK_SETS, and every two blocks of such bands meet in a task of their own.
    """
    width = max(0.05, 1.0001 * math.log(100 / percent))  # a little more than the widest ratio, for rounding
    band = F.floor(F.log("n") / width)
    pivots = rows.groupBy("token").agg(F.min("id").alias("b"), F.count("*").alias("__rows"))
    clusters = components(spread_join(rows, pivots, ["token"], rows.count()).select(F.col("id").alias("a"), "b").distinct())
    placed = stored(sets.join(clusters.withColumnRenamed("node", "id"), "id").withColumnRenamed("component", "cluster").withColumn("band", band))
    counted = placed.groupBy("cluster", "band").agg(F.count("*").alias("c")).withColumn("blocks", F.floor(F.col("c") / BLOCK_SETS) + 1)
    sizes = counted.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"), F.sum("c").alias("__rows"))  # a row's map grows with the logarithm of the largest set
    placed = spread_join(placed, sizes, ["cluster"], clusters.count())

    def blocks(of: Column) -> Column:
        count = F.coalesce(F.try_element_at("bands", of), F.lit(0).cast("long"))
        each = F.transform(F.sequence(F.lit(0).cast("long"), count), lambda i: F.shiftleft(of, 40) + i)
        return F.slice(each, F.lit(1), count.cast("int"))

    placed = placed.withColumn("block", F.shiftleft("band", 40) + F.pmod(F.xxhash64("id"), F.try_element_at("bands", F.col("band"))))
    meet = placed.withColumn("with", F.explode(F.concat(*(blocks(F.col("band") + d) for d in (-1, 0, 1)))))
    meet = meet.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    ordered = meet.select("cluster", "i", "j", "block", "id", "n", "comp", "small", "tokens").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if held:
                        yield _block_batch(now, held, percent)
                    now, held = row[:3], []
                held.append(row[3:])
        if held:
            yield _block_batch(now, held, percent)

    return ordered.mapInArrow(run, "a bigint, b bigint")


def _block_batch(key: tuple, held: list[tuple], percent: int) -> pa.RecordBatch:
    """The pairs of two blocks (or within one) whose counts and sizes allow a link."""
    first = [r for r in held if r[0] == key[1]]
    second = [r for r in held if r[0] == key[2]]

    def column(rows: list[tuple], i: int) -> np.ndarray:
        return np.array([r[i] for r in rows], dtype=np.int64)

    def behind(n: np.ndarray) -> np.ndarray:
        return np.maximum(0, -(-n * percent // 100) - MEET)

    places = {t: i for i, t in enumerate(sorted({t for r in first for t in r[5]} & {t for r in second for t in r[5]}))}
    common = np.zeros((len(first), len(second)), dtype=np.int64)
    for lo in range(0, len(places), 4096):
        marks = []
        for rows in (first, second):
            m = np.zeros((len(rows), 4096), dtype=np.float32)
            for i, r in enumerate(rows):
                at = [places[t] - lo for t in r[5] if t in places and lo <= places[t] < lo + 4096]
                m[i, at] = 1
            marks.append(m)
        common += (marks[0] @ marks[1].T).astype(np.int64)
    (ia, na, ca, sa), (ib, nb, cb, sb) = (tuple(column(rows, i) for i in (1, 2, 3, 4)) for rows in (first, second))
    need = -(-percent * (na[:, None] + nb[None, :]) // (100 + percent))
    reach = common + np.minimum(sa[:, None], sb[None, :]) + np.maximum(behind(na)[:, None], behind(nb)[None, :])
    fits = (100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])) & (common > 0)
    x, y = np.nonzero(fits & (reach >= need) & (ca[:, None] != cb[None, :]) & ((ia[:, None] < ib[None, :]) if key[1] == key[2] else True))
    a, b = ia[x], ib[y]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _together(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, part, b, ...): the rows of held (id, ...) of each a, with b null, and behind them those of its candidates b.

    held is thinned out by a bitmap before exact joins; the candidates of one document come in
    blocks of about CANDIDATES.
    """
    counted = pairs.groupBy("a").agg(F.count("*").alias("__rows")).withColumn("c", F.col("__rows"))
    dealt = spread_join(pairs, counted, ["a"], pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("c") / CANDIDATES) + 1).alias("part"))
    dealt = stored(dealt)
    named = dealt.select(F.col("a").alias("id")).unionByName(dealt.select(F.col("b").alias("id")))
    asked = dealt.select("a", "part").distinct().withColumn("b", F.lit(None).cast("long")).withColumn("id", F.col("a"))
    members = asked.unionByName(dealt.withColumn("id", F.col("b"))).join(Bitmap(named, "id").keep(held, "id"), "id").drop("id")
    return members.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose cell counts allow the overlap that is needed; none that links is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            first, second = [], []
            for a, part, b, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, part) != now:
                    now, own = (a, part), []
                if b is None:
                    own.append((n, counts))
                elif any(overlap_bound(c, counts) >= _need(m, n, percent) for m, c in own):
                    first.append(a)
                    second.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    held = sets.where("n > 0").select("id", "n", "counts")
    return _together(pairs, held).select("a", "part", "b", "n", "counts").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """The (a, b) of pairs whose whole texts reach the threshold, by the prefix tree.

    Texts are fetched for those pairs only that the cell counts leave.
    """
    pairs = stored(_possible(stored(pairs), sets, percent))
    grouped = _together(pairs, rows).select("a", "part", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, ids, sets, weight, classes = None, [], [], [], 0, shared.value

        def flush() -> pa.RecordBatch:
            hits = {i for mine in own if len(mine[0]) for i in _linked(mine, ids, sets, percent)}
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(hits), pa.int64()), pa.array(sorted(hits), pa.int64())], names=["a", "b"])

        for batch in batches:
            for first, data, offsets in slices(batch.column(3)):
                for i, found in enumerate(shingles(data, offsets, k), first):
                    key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                    if key != now or weight > GROUP_BYTES:
                        if ids:
                            yield flush()
                        ids, sets, weight = [], [], 0
                        own = own if key == now else []
                        now = key
                    u, b = np.unique(found), batch.column(2)[i].as_py()
                    places = _places(u, classes)
                    if b is None:
                        own.append((u, np.sort(places)))
                    elif len(u):
                        order = np.argsort(places, kind="stable")
                        ids.append(b)
                        sets.append((u[order], places[order]))
                        weight += 2 * u.nbytes
        if ids:
            yield flush()

    return grouped.mapInArrow(run, "a bigint, b bigint").distinct()


def _linked(own: tuple[np.ndarray, np.ndarray], ids: list, sets: list[tuple[np.ndarray, np.ndarray]], percent: int) -> Iterator:
    """The ids whose sets reach the threshold with `own`: one walk over the tree of their sets.

    own: hashes by value, and their places in the global order; sets: hashes and places, both in
    the global order.  Where a path stands at some place, only what own has from there on can
    still be shared.
    """
    mine, mine_at = own
    order = sorted(range(len(sets)), key=lambda i: sets[i][0].astype(">u8").tobytes())
    before, counted, depth = np.zeros(0, np.uint64), np.zeros(1, np.int64), 0
    for i in order:
        path, places = sets[i]
        need = _need(len(mine), len(path), percent)
        most = min(depth, len(path), len(before))
        differs = np.flatnonzero(path[:most] != before[:most])
        at = int(differs[0]) if len(differs) else most  # this much of the path, and its overlap, is shared
        total = np.empty(len(path) + 1, dtype=np.int64)
        total[: at + 1] = counted[: at + 1]
        while at < len(path):
            left = len(mine) - int(np.searchsorted(mine_at, places[at]))
            if total[at] + min(left, len(path) - at) < need:
                break
            part = path[at : at + 256]
            where = np.minimum(np.searchsorted(mine, part), len(mine) - 1)
            total[at + 1 : at + 1 + len(part)] = total[at] + np.cumsum(mine[where] == part)
            at += len(part)
        before, counted, depth = path, total, at
        if at == len(path) and len(path) and 100 * total[at] >= percent * (len(mine) + len(path) - total[at]):
            yield ids[i]


def jaccard_components(docs: DataFrame, *, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    Documents link when 100 * intersection >= percent * union of their sets of k-word shingles;
    component_id is the least id reachable by links, itself included.  A null, empty or blank
    text has the empty set and links with nothing; a text of fewer than k words has its whole
    sequence as its one shingle.  Rows that repeat an id are linked through it; a row with a
    null id has no component.  Other columns are not read, an empty table gives no rows.
    """
    rows = pick(docs, key, text).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(order_classes(rows.select("text"), k))  # at most 2 * MOST_CELLS bytes
    sets = stored(prefixes(rows, k, percent, shared))
    small = sets.select("id", "n", "s1", "s2")
    groups = stored(small.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    chosen = groups.select(F.col("rep").alias("id"), "n", "s1", "s2")
    members = stored(shared_tokens(sets.drop("counts").join(chosen, ["id", "n", "s1", "s2"], "left_semi")))
    # an id with several sets ties their classes together
    several = small.where("n > 0 AND id IS NOT NULL").distinct().join(groups, ["n", "s1", "s2"]).select("id", "rep")
    several = several.join(several.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z"), "id")
    links = stored(several.select("a", F.col("rep").alias("b")).where("a <> b").distinct())
    links = stored(links.unionByName(verified(_star_pairs(members, percent), rows, sets, k, percent, shared)))
    active = _unsettled(members.select("token", "pos", "id", "n"), stored(components(links)))
    links = links.unionByName(verified(_rest_pairs(active, percent), rows, sets, k, percent, shared))
    labels = stored(components(links))
    named = small.join(groups, ["n", "s1", "s2"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return named.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that link, directly or through others, with a smaller id.

    Rows that repeat an id are one document, of which the row with the greatest text stays (one
    of them, if several have it), found by a maximum within tasks first.
    Rows with a null id, and documents without words, always stay, each as often as it is there.
    Only the texts of rows that may go are shuffled.
    """
    found = jaccard_components(docs, k=k, percent=percent, key=key, text=text).select(F.col(key).alias("__id"), "n_shingles", "component_id")
    found = stored(found.where("n_shingles > 0 AND component_id IS NOT NULL"))
    groups = found.groupBy("__id").agg(F.min("component_id").alias("__first"), F.count("*").alias("__rows"))
    touched = stored(groups.where("__first <> __id OR __rows > 1"))
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = (f"c{names.index(n)}" for n in (key, text))
    rows, maybe = docs.toDF(*inner), Bitmap(touched, "__id")
    joined = maybe.keep(rows, id_at).join(touched, F.col(id_at) == F.col("__id"), "left")
    alone = joined.where("__id IS NULL").select(*inner)
    first = joined.where("__first = __id").groupBy(id_at).agg(F.max_by(F.struct(*inner), text_at).alias("r"))
    several = first.select(*(F.col(f"r.{c}").alias(c) for c in inner))
    out = maybe.keep(rows, id_at, inside=False).unionByName(alone).unionByName(several)
    return out.toDF(*names)


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several components, with their component, and `large`."""
    with_comp = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("token", "pos", "id", "n", F.coalesce("component", "id").alias("comp"))
    with_comp = stored(with_comp)
    open_tokens = with_comp.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("__rows"))
    open_tokens = open_tokens.where("lo < hi").select("token", "__rows", (F.col("__rows") > LARGE_BUCKET).alias("large"))
    return stored(spread_join(with_comp, open_tokens, ["token"], with_comp.count()))
