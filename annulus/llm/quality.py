"""Quality rules with DataFrame functions only.

Every document gets base counts (words, symbols, repeated lines, words in repeated windows)
and a verdict by the hashed n-gram log-likelihood ratio: word unigrams and bigrams are hashed
into a fixed number of buckets, a trusted target (the documents labelled as good) and the raw
corpus (all documents) each give a multinomial over the buckets, and a document's score is the
mean over its n-grams of log p_target - log p_raw.  Documents below the threshold go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

BUCKETS = 1 << 14
MAX_TRUSTED = 16_384
#: In nats a n-gram: what is kept is on (geometric) average 0.89 times as likely in the target as
#: in the corpus, or more.  A document like the whole corpus scores near 0, whatever its length.
THRESHOLD = -0.12
SMOOTHING = 8.0
WINDOW = 8
#: Fixed: the blanks between words, the space first.
_BLANKS = (" ", "\t", "\n", "\u000b", "\f", "\r")
_SYMBOLS = "#*$%&|<>"


def spaced(text: Column | str, keep: str = "") -> Column:
    """A text, empty for null, with every blank but those to keep made a space."""
    out = F.coalesce(text, F.lit(""))
    for blank in _BLANKS[1:]:
        out = out if blank in keep else F.replace(out, F.lit(blank), F.lit(" "))
    return out


def _without(text: Column, chars: Sequence[str]) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_hashes(text: Column) -> Column:
    """Hash of each word `[^\\x20\\x09-\\x0D]+` of a text, in order; none for a null one.

    Blanks become single characters to split at, which needs no regular expression.
    """
    return F.transform(F.filter(F.split(spaced(text), " ", -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shifted(hashes: Column, by: int) -> Column:
    return F.slice(hashes, F.lit(by + 1), F.greatest(F.size(hashes) - by, F.lit(0)))


def _first(hashes: Column, less: int) -> Column:
    return F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - less, F.lit(0)))


def doubled(hashes: Column, by: int) -> Column:
    """From hashes of runs of `by` words those of runs of 2 * by: one for each place that has one."""
    return F.zip_with(_first(hashes, by), _shifted(hashes, by), lambda a, b: F.xxhash64(a, b))


def _repeat_words(windows: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the array of window hashes.

    Only where two are equal, windows are sorted with their places; the places of repeated
    windows, in order, cover up to eight words each.
    """

    def covered(w: Column) -> Column:
        paired = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            def twin(e: Column, i: Column) -> Column:
                return F.coalesce(F.get(s, i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))

            return F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"]))

        def total(p: Column) -> Column:
            reach = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(let(paired, repeated), total)).otherwise(F.lit(0).cast("long"))

    return covered(windows)


def _dup_lines(text: Column) -> Column:
    """\\n-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def with_hashes(rows: DataFrame, text: str) -> DataFrame:
    """Adds h, h2 and h8: the hashes of a text's words, pairs and windows of eight."""
    out = rows.withColumn("h", word_hashes(F.col(text))).withColumn("h2", doubled(F.col("h"), 1))
    return out.withColumn("h8", doubled(doubled(F.col("h2"), 2), 4))


def base_columns(text: Column) -> dict[str, Column]:
    """Over a table with_hashes()."""
    filled = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size("h").cast("long"),
        "word_chars": F.length(_without(filled, _BLANKS)).cast("long"),
        "n_symbols": (F.length(filled) - F.length(_without(filled, _SYMBOLS))).cast("long"),
        "n_dup_lines": _dup_lines(text),
        "n_repeat_words": _repeat_words(F.col("h8")),
    }


def grams(buckets: int) -> Column:
    """Bucket of every word and every pair of neighbouring words, over columns h and h2."""
    return F.transform(F.concat("h", "h2"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING, max_trusted: int = MAX_TRUSTED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: `__ratios`, log p_target - log p_raw of each bucket.

    trusted: keys of the target documents (repeats and nulls don't matter); at most
    `max_trusted` of those that docs holds are fitted on, drawn by hash, so that they can be
    broadcast.  The raw
    counts cover all documents.  Counts are summed within tasks before the shuffle; the row has
    `buckets` numbers.
    Without any target n-gram every ratio is 0, so that nothing is rejected unjudged.
    """
    rows = pick(docs, key, text)
    good = pick(trusted, key).where(F.col(key).isNotNull()).distinct().select(F.col(key).alias("__good"))
    held = rows.select(F.col(key).alias("__good")).where("__good IS NOT NULL").distinct()
    good = good.join(held, "__good").orderBy(F.xxhash64("__good"), "__good").limit(max_trusted)

    def counted(part: DataFrame, name: str) -> DataFrame:
        hashed = part.select(word_hashes(F.col(text)).alias("h")).withColumn("h2", doubled(F.col("h"), 1))
        return hashed.select(F.explode(grams(buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    target = rows.join(F.broadcast(good), F.col(key) == F.col("__good"), "left_semi")
    both = every.join(counted(rows, "raw"), "bucket", "left").join(counted(target, "good"), "bucket", "left").na.fill(0, ["raw", "good"])
    sums = both.agg(F.sum("raw").alias("r"), F.sum("good").alias("g"))
    ratio = F.log((F.col("good") + smoothing * F.col("g") / F.col("r")) / F.col("g")) - F.log((F.col("raw") + smoothing) / F.col("r"))
    found = both.crossJoin(F.broadcast(sums)).select("bucket", F.when((F.col("g") > 0) & (F.col("r") > 0), ratio).otherwise(F.lit(0.0)).alias("x"))
    return found.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "x"))), lambda e: e["x"]).alias("__ratios"))


def judge(docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    A null or empty text has no words, fails the base rules and scores 0.  Repeated rows are
    judged each on their own, equal texts alike; an empty table gives no rows.
    """
    ratios = log_ratios(docs, trusted, buckets=buckets, max_trusted=max_trusted, key=key, text=text)
    rows = verdicts(pick(docs, key, text), ratios, text, threshold=threshold, buckets=buckets)
    return rows.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def verdicts(rows: DataFrame, ratios: DataFrame, text: str, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """rows with the columns of judge() added; ratios as log_ratios() gives them."""
    scored = with_hashes(rows, text).crossJoin(F.broadcast(ratios))
    total = F.aggregate(F.concat("h", "h2"), F.lit(0.0), lambda a, h: a + F.get(F.col("__ratios"), F.pmod(h, F.lit(buckets)).cast("int")))
    counts = {n: c.alias(n) for n, c in base_columns(F.col(text)).items()}
    out = scored.select(*rows.columns, *counts.values(), (total / F.greatest(F.lit(1), 2 * F.size("h") - 1)).alias("score"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def kept(docs: DataFrame, trusted: DataFrame, *, max_trusted: int = MAX_TRUSTED, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that pass, with the columns of docs, in one narrow pass over the texts.

    The verdict is made beside the row itself, so repeated keys and null keys need no join.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    text_at = f"c{names.index(text)}"
    ratios = log_ratios(docs, trusted, key=key, text=text, max_trusted=max_trusted, buckets=options.get("buckets", BUCKETS))
    # a filter moves below deterministic projections and would compute the hashes again in each
    # of its terms; one that reads a row number stays where it is
    judged = verdicts(rows, ratios, text_at, **options).withColumn("__row", F.monotonically_increasing_id())
    return judged.where("kept AND __row >= 0").select(*inner).toDF(*names)
