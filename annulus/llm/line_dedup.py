"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line takes part if it has a word.  It goes if an earlier one, by (doc_id, line number), has the
same words; from five words on, also if an earlier one of five words or more lies within the
bound: edits are counted in words, the bound is one word put in, left out or replaced.  The
earliest stays.

1. Equal lines (equal words) are one, found by the hashes of both halves and a minimum over
   places; shorter lines by a second hash of their words besides.
2. Two lines within the bound agree exactly on their first or on their last half.  Only lines
   of five words or more that share a half with another can have a neighbour; the others are done.
3. Those emit their deletion neighbourhood as hashed keys: the line itself and the line
   without each of its words, with the place left out.  The hash is an XOR over (word, place),
   so each key costs a running value and not a copy of the line.
4. Within a key, lines that leave out the same place are all within the bound of each other and
   of the line that is the rest itself, so the earliest of them is every other one's witness:
   minima replace the pairs, whatever the size of a group, and the lines of a hot key are dealt
   out over several tasks where the minima are joined back.
5. Each line and its witness are compared word by word before the line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, let, pick, spread_join, stored
from .quality import spaced

#: Of lines that are compared within the bound; equal lines go whatever their length.
MIN_WORDS = 5
_BLANK, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_RUN = 16


def _takes_part(line: Column, min_words: int) -> Column:
    """Whether a line has that many words; looks no further than the last of them."""
    return line.rlike(f"^{_BLANK}*+(?:{_SOLID}++{_BLANK}++){{{min_words - 1}}}{_SOLID}") if min_words > 0 else F.lit(True)


def _lines(rows: DataFrame) -> DataFrame:
    """(id, line, t) of every line, its blanks made spaces."""
    return rows.select("id", F.posexplode(F.split(spaced("text", keep="\n"), "\n", -1)).alias("line", "t"))


def _hashes(line: Column) -> Column:
    return F.transform(_words(line), lambda w: F.xxhash64(w))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " ", -1), lambda w: w != "")


def _halves() -> list[Column]:
    """Hashes of both halves of a line, as one of its length and as the longer one of a pair."""
    w, n, out = F.col("w"), F.col("n"), []
    for length, skip in ((n, 0), (n - 1, 1)):
        m = F.floor(length / 2).cast("int")
        out.append(F.xxhash64(F.lit(1), length, F.slice(w, F.lit(1), m)))
        out.append(F.xxhash64(F.lit(2), length, F.slice(w, m + F.lit(1 + skip), n)))
    return out


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _before(d: str) -> Column:
    """XOR of the elements before each place, from those of runs and of the rest of a run."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / _RUN).cast("int")), lambda b: _xor(F.slice(d, b * _RUN + 1, _RUN)))
    starts = let(runs, lambda r: F.transform(r, lambda x, b: _xor(F.slice(r, F.lit(1), b))))

    def at(i: Column, r: Column) -> Column:
        run = F.floor(i / _RUN).cast("int")
        return F.get(r, run).bitwiseXOR(_xor(F.slice(d, run * _RUN + 1, i - run * _RUN)))

    return let(starts, lambda r: F.transform(F.col(d), lambda x, i: at(i, r)))


def _variants(lines: DataFrame) -> DataFrame:
    """(key, gone, id, line): each line's own key with gone = -1, and its key without each word.

    A key is the XOR of the hashes of (word, place); behind a word left out, places move by one.
    """
    out = lines.withColumn("p", F.transform("w", lambda x, j: F.xxhash64(x, j))).withColumn("q", F.transform("w", lambda x, j: F.xxhash64(x, j - 1)))
    out = out.withColumn("d", F.zip_with("p", "q", lambda a, b: a.bitwiseXOR(b))).withColumn("t", _xor(F.col("q")))
    out = out.withColumn("b", _before("d"))

    def left_out(q: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(F.col("t").bitwiseXOR(q).bitwiseXOR(F.get("b", i)), F.col("n") - 1).alias("key"), i.alias("gone"))

    own = F.struct(F.xxhash64(_xor(F.col("p")), F.col("n")).alias("key"), F.lit(-1).alias("gone"))
    every = F.concat(F.array(own), F.transform("q", left_out))
    return out.select("id", "line", F.explode(every).alias("v")).select("v.key", "v.gone", "id", "line")


def _within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word apart: what they share in front and behind covers the rest."""

    def ahead(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        return let(F.array_position(same, False), lambda p: F.when(p == 0, F.size(same)).otherwise((p - 1).cast("int")))

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (ahead(a, b) + ahead(F.reverse(a), F.reverse(b)) >= longest - 1)


def kept_places(docs: DataFrame, *, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line): the places of the lines that take part and stay; `min_words` bounds the inexact comparison alone."""
    rows = pick(docs, key, text).select(F.col(key).alias("id"), F.col(text).alias("text"))
    lines = _lines(rows).where(_takes_part(F.col("t"), min(1, min_words))).select("id", "line", "t", _hashes(F.col("t")).alias("w"))
    lines = lines.withColumn("n", F.size("w"))
    place = F.struct("id", "line")
    long, (k0, k1, k2, k3) = F.col("n") >= min_words, _halves()
    # a half of a short line may be a single word's hash; k3 is null for these lines alone
    second = F.xxhash64(F.lit(3), _words(F.col("t")))
    halves = [k0.alias("k0"), k1.alias("k1"), F.when(long, k2).otherwise(second).alias("k2"), F.when(long, k3).alias("k3")]
    every = stored(lines.select("id", "line", *halves).groupBy("k0", "k1", "k2", "k3").agg(F.min(place).alias("first")))
    keyed = every.where("k3 IS NOT NULL").select("k0", "k1", "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    common = stored(keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"))
    open_lines = Bitmap(common, "k").keep(keyed, "k").join(common, "k")  # a semi-join would be moved before the bitmap
    asked = stored(open_lines.select(F.col("first.id").alias("fid"), F.col("first.line").alias("fline"), F.col("k0").alias("g0"), F.col("k1").alias("g1"), F.xxhash64("first.id", "first.line").alias("p")).distinct())
    holders = Bitmap(asked, "fid").keep(rows, "id").unionByName(rows.where("id IS NULL"))
    lines_there = Bitmap(asked, "p").keep(_lines(holders).withColumn("p", F.xxhash64("id", "line")), "p").drop("p")
    known = lines_there.join(asked, F.col("id").eqNullSafe(F.col("fid")) & (F.col("line") == F.col("fline")))
    known = known.select("id", "line", "g0", "g1", _hashes(F.col("t")).alias("w")).withColumn("n", F.size("w"))
    known = known.where((_halves()[0] == F.col("g0")) & (_halves()[1] == F.col("g1")))  # ids can repeat
    known = stored(known.dropDuplicates(["g0", "g1"]).drop("g0", "g1"))
    variants = stored(_variants(known))
    busy = stored(variants.groupBy("key").agg(F.count("*").alias("__rows")).where("__rows > 1"))
    met = spread_join(Bitmap(busy, "key").keep(variants, "key"), busy, ["key"], variants.count())
    met = stored(met.withColumn("at", place).select("key", "gone", "at"))
    same_gap = met.groupBy("key", "gone").agg(F.min("at").alias("first_gap"), F.count("*").alias("__rows"))
    either = same_gap.groupBy("key").agg(F.min(F.when(F.col("gone") < 0, F.col("first_gap"))).alias("first_own"), F.min(F.when(F.col("gone") >= 0, F.col("first_gap"))).alias("first_any"))
    seen = spread_join(met, same_gap.join(either, "key"), ["key", "gone"], met.count())
    witness = F.when(F.col("gone") < 0, F.col("first_any")).otherwise(F.least("first_gap", F.coalesce("first_own", "first_gap")))
    found = seen.withColumn("witness", witness).where("witness < at").select("at", "witness").distinct()
    mine = known.select(F.struct("id", "line").alias("at"), F.col("w").alias("a"))
    other = known.select(F.struct("id", "line").alias("witness"), F.col("w").alias("b"))
    gone = found.join(mine, "at").join(other, "witness").where(_within_one(F.col("a"), F.col("b"))).select("at").distinct()
    return every.join(gone, F.col("first").eqNullSafe(F.col("at")), "left_anti").select("first.id", "first.line")


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", counts: bool = True, chars: str | None = None, least_words: int = 0) -> DataFrame:
    """docs with text replaced by the lines that stay, joined by line feeds, and two columns more
    unless `counts` is off: `n_lines` and `n_kept_lines`.  A column `chars`, if docs has it, gets
    the new text's length.

    Lines without a word always stay; lines of fewer than `min_words` words go only as exact
    repeats (equal words) of an earlier one.  A null text stays null, with 0 lines; an empty one is
    one empty line.  Rows that repeat a key are copies of one document and keep the same places;
    rows with a null key are one document before all others.  Equal lines inside one document
    are duplicates too.  With `least_words`, a document that has lost lines and has fewer words
    left goes; one that has lost none stays, however short.  The other columns pass unchanged; an empty table gives no rows.
    """
    places = kept_places(docs, min_words=min_words, key=key, text=text).groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_set("line")).alias("__at"))
    # one byte for each line up to the last kept one: 1 where it stays
    gaps = F.transform("__at", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get(F.col("__at"), i - 1), F.lit(-1)) - 1), F.lit("1")))
    marks = places.select("__id", F.array_join(gaps, "").cast("binary").alias("__marks"))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    id_at, text_at = (f"c{names.index(n)}" for n in (key, text))
    rows = docs.toDF(*inner)
    keyed = rows.where(F.col(id_at).isNotNull()).join(marks.where("__id IS NOT NULL").hint("shuffle_hash"), F.col(id_at) == F.col("__id"), "left")
    # all rows with a null key have the same marks, one row: broadcast, they stay where they are
    unkeyed = rows.where(F.col(id_at).isNull()).join(F.broadcast(marks.where("__id IS NULL")), F.lit(True), "left")
    joined = keyed.unionByName(unkeyed)
    joined = joined.withColumn("__lines", F.split(text_at, "\n", -1))
    stays = F.filter("__lines", lambda t, i: ~_takes_part(t, min(1, min_words)) | F.coalesce(F.substring("__marks", i + 1, F.lit(1)) == F.lit(b"1"), F.lit(False)))
    joined = joined.withColumn("__kept", stays)
    joined = joined.withColumn("__text", F.array_join("__kept", "\n"))
    new = {text_at: F.col("__text")} | ({f"c{names.index(chars)}": F.length("__text").cast("long")} if chars in names else {})
    out = [new.get(c, F.col(c)).alias(c) for c in inner]
    if least_words:
        lost = F.size("__kept") < F.size("__lines")
        short = F.coalesce(lost & (F.size(_words(spaced("__text"))) < least_words), F.lit(False))
        # a filter would move below the projections above and compute them twice; a generator doesn't
        joined = joined.withColumn("__stays", F.explode(F.when(short, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))))
    if not counts:
        return joined.select(*out).toDF(*names)
    found = [F.coalesce(F.size(c), F.lit(0)).cast("long") for c in (F.col("__lines"), F.col("__kept"))]
    return joined.select(*out, F.greatest(found[0], F.lit(0)).alias("__n"), F.greatest(found[1], F.lit(0)).alias("__k")).toDF(*names, "n_lines", "n_kept_lines")
