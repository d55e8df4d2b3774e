"""Personal data by patterns and by bootstrapped context, with DataFrame functions only.

Base spans come from regular expressions.  Spark has no function that gives the places of all
matches; they are the running sum of the lengths of the pieces between matches and of the
matches.  Separators inside cards and dots inside domains are first replaced by one control
character each, which keeps every place and lets each expression be a plain run of a character
class: no nested repeat, so no deep recursion and no backtracking over long texts.

The method then looks for identifiers that no expression knows.  Candidates are runs of letters,
digits, _ and - with two digits or more, capital codes with a separator, and assigned values in
quotes.  Their lexical pattern is the two whole words before them, lower-cased, numbers as 0; base
spans and candidates form a bipartite graph of instances and patterns.  Seeds, with score 1, are
the base spans and assigned values that are too long and too mixed to be anything but a secret.
A pattern's score is the sum of its instances' scores over all places of the corpus where its two
words stand before a word, so that words which lead to anything else score next to nothing; an
instance's score is the noisy-or of its patterns'.  Scores only grow; rounds go on until no
pattern is newly accepted and scores stand still.  A pattern is accepted if its score is high and
enough of its instances are sure: seeds, or found by a pattern that an earlier round accepted.
Candidates behind accepted patterns become spans of kind `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, before, let, pick, spread_join, stored
from .quality import doubled, word_hashes

#: In the order in which spans at one place stand.
KINDS = ("email", "ip", "card", "phone", "id")
_M, _N = "\u0001", "\u0002"
#: Fixed: the base expressions over marked texts; M stands for an inner dot or separator.
_EMAIL = f"(?:\\G|(?<![A-Za-z0-9._%+{_M}-]))[A-Za-z0-9._%+{_M}-]++@[A-Za-z0-9-]++{_M}[A-Za-z0-9{_M}-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = f"[0-9][0-9{_M}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_ASSIGNED = r"(?:(?<=[=:]\x20[\"'])|(?<=[=:][\"']))[^\x20\x09-\x0D\"']++"
_CODE = r"(?<![A-Za-z0-9_-])[A-Z]{2,}+[_-][A-Z0-9_-]++"
_OTHER = rf"{_ASSIGNED}|{_CODE}|(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"
_MAY_HAVE_OTHER = r"[0-9]|[=:]\x20?[\"']|[A-Z]{2}[_-][A-Z0-9_-]"
_BLANK, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Of a reversed text: what may lead a word in, then the two whole words before it.
_BEFORE = rf"^[\"'`(\[{{<=:#]*+{_BLANK}++({_SOLID}++){_BLANK}++({_SOLID}++)(?:{_BLANK}|$)"
_NEAR = 256
_INNER_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
_INNER_GAP = r"(?<=[0-9])[\x20-](?=[0-9])"
_BYTE = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"
LEAST_SCORE = 0.8
LEAST_SEEDS = 3
SMOOTHING = 0.5
STANDS_STILL = 0.01


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches of a pattern with their places, as SPAN."""

    def placed(found: Column) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        # what stands before match i: pieces 0 to i and matches 0 to i - 1
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("gap"), (p + F.length(m)).alias("all")))
        sums = let(steps, lambda s: F.zip_with(s, before(F.transform(s, lambda x: x["all"]), lambda a, b: a + b, F.lit(0)), lambda x, b: b + x["gap"]))
        return F.zip_with(found, sums, lambda m, at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("end"), m.alias("text")))

    empty = F.array().cast(SPAN)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(empty))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans of a text, null as empty: by start, then by kind."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(_M), F.lit(_N))
    email = _matches(F.regexp_replace(plain, _INNER_DOT, _M), _EMAIL, 0)
    ip = F.filter(_matches(plain, _IP, 1), lambda m: F.forall(F.split(m["text"], r"\."), lambda p: p.rlike(_BYTE)))
    size = lambda m: F.length(_digits(m["text"]))
    card = F.filter(_matches(F.regexp_replace(plain, _INNER_GAP, _M), _CARD, 2), lambda m: F.when(size(m).between(14, 19), _luhn(_digits(m["text"]))).otherwise(F.lit(False)))
    phone = F.filter(_matches(plain, _PHONE, 3), lambda m: size(m).between(10, 15))
    empty = F.array().cast(SPAN)
    with_at = F.when(F.contains(plain, F.lit("@")), email).otherwise(empty)
    with_plus = F.when(F.contains(plain, F.lit("+")), phone).otherwise(empty)
    every = F.array_sort(F.concat(with_at, ip, card, with_plus))
    numbers = F.when(plain.rlike("[0-9]"), every).otherwise(with_at)
    return numbers


def _others(text: Column) -> Column:
    """Candidates of six characters or more, as SPAN: see _OTHER; runs have two digits at least."""
    plain = F.coalesce(text, F.lit(""))

    def fits(m: Column) -> Column:
        return (F.length(m["text"]) >= 6) & ((F.length(_digits(m["text"])) >= 2) | m["text"].rlike(rf"^{_CODE}$") | _assigned(plain, m["start"]))

    return F.when(plain.rlike(_MAY_HAVE_OTHER), F.filter(_matches(plain, _OTHER, 4), fits)).otherwise(F.array().cast(SPAN))


def _assigned(text: Column, start: Column) -> Column:
    """Whether a quote behind = or : leads to a place."""
    return F.substring(text, F.greatest(start - 2, F.lit(1)), F.least(start, F.lit(3))).rlike(r"[=:]\x20?[\"']$")


def _is_secret(text: Column, m: Column) -> Column:
    """An assigned value of 24 characters or more, eight digits and eight letters among them."""
    letters = F.length(F.regexp_replace(m["text"], "[^A-Za-z]", ""))
    return m["text"].rlike(r"^[A-Za-z0-9+/=_.-]{24,}$") & (F.length(_digits(m["text"])) >= 8) & (letters >= 8) & _assigned(text, m["start"])


def _plain_words(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def _context(text: Column, start: Column) -> Column:
    """Hash of the two whole words before a place; null where there aren't two.

    They are looked for in the _NEAR characters before the place, and where those don't hold
    two whole words, in all of them.
    """
    near = F.reverse(F.substring(text, F.greatest(start - (_NEAR - 1), F.lit(1)), F.least(start, F.lit(_NEAR))))
    enough = (start <= _NEAR) | near.rlike(_BEFORE.replace("|$)", ")"))
    left = F.when(enough, near).otherwise(F.reverse(F.substring(text, F.lit(1), start)))

    def hashed(words: Column) -> Column:
        return F.xxhash64(*(F.xxhash64(_plain_words(F.reverse(words[i]))) for i in ("second", "first")))

    words = let(left, lambda t: F.struct(F.regexp_extract(t, _BEFORE, 1).alias("first"), F.regexp_extract(t, _BEFORE, 2).alias("second")))
    return let(words, lambda w: F.when(w["second"] != "", hashed(w)))


def _occurrences(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted and `seen`: in how many places of the texts each wanted context stands before a word."""
    pairs = rows.select(word_hashes(_plain_words(F.col("text"))).alias("h")).where(F.size("h") > 2)
    each = pairs.select(F.explode(F.slice(doubled(F.col("h"), 1), F.lit(1), F.size("h") - 2)).alias("context"))
    counted = Bitmap(wanted.select("context"), "context").keep(each, "context").groupBy("context").agg(F.count("*").alias("seen"))
    return wanted.join(counted, "context", "left").na.fill(0, ["seen"])


def _accepted(rows: DataFrame, near: DataFrame, edges: DataFrame, rounds: int | None, least_score: float, least_seeds: int) -> DataFrame:
    """(context) of the accepted patterns of a graph of edges (context, instance, w, seed).

    Patterns of fewer than `least_seeds` instances, and those that would not score enough if all
    their instances were sure, can never be accepted and aren't scored.  Most of the latter show
    in `near`, a part of rows, already: places counted there are no more than those in all rows.
    """
    wanted = edges.groupBy("context").agg(F.count("*").alias("__rows"), F.sum("w").alias("most")).where(F.col("__rows") >= least_seeds)
    can_be = F.col("most") >= least_score * (F.col("seen") + SMOOTHING)
    wanted = stored(_occurrences(near, stored(wanted)).where(can_be).drop("seen"))
    seen = stored(_occurrences(rows, wanted).where(can_be).drop("most"))
    edges = stored(spread_join(edges, seen, ["context"], edges.count()))
    total = edges.count()
    scores = edges.groupBy("instance").agg(F.max("seed").alias("score"), (F.max("seed") > 0).alias("sure"), F.count("*").alias("__rows"))
    accepted, before_it, turn = (F.col("p") >= least_score) & (F.col("support") >= least_seeds), None, 0
    while True:
        turn += 1
        patterns = stored(spread_join(edges, scores, ["instance"], total).groupBy("context").agg(
            (F.sum(F.col("w") * F.col("score")) / (F.max("seen") + SMOOTHING)).alias("p"), F.count_if("sure").alias("support"), F.count("*").alias("__rows")
        ))
        said = patterns.agg(F.count_if(accepted), F.coalesce(F.sum("p"), F.lit(0.0))).first()
        if turn == rounds or before_it and said[0] == before_it[0] and said[1] - before_it[1] <= STANDS_STILL:
            return patterns.where(accepted).select("context")
        before_it = said
        doubt = F.sum(F.log(1 - F.least(F.col("p"), F.lit(0.999))))
        joined = spread_join(edges, patterns, ["context"], total).groupBy("instance")
        scores = stored(joined.agg(F.greatest(F.max("seed"), 1 - F.exp(doubt)).alias("score"), F.max((F.col("seed") > 0) | accepted).alias("sure"), F.count("*").alias("__rows")))


def _new_spans(rows: DataFrame, scan: DataFrame, rounds: int | None, least_score: float, least_seeds: int) -> DataFrame:
    """(id, same, start, kind, end) of the identifiers found by context."""
    spans = scan.where(F.size("all") > 0).dropDuplicates(["id", "same"]).select("id", "same", F.explode("all").alias("s")).select("id", "same", "s.*")
    own = Window.partitionBy("id", "same").orderBy("start", "kind")
    known = F.col("kind") < 4
    past = F.max(F.when(known, F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(known, F.col("start"))).over(own.rowsBetween(1, Window.unboundedFollowing))
    covered = (F.coalesce(past, F.lit(0)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end"))
    free = stored(spans.withColumn("covered", covered).where(known | ~F.col("covered")).where("context IS NOT NULL").drop("covered"))
    # copies of a text show its contexts once more each, as the places counted in all texts do
    copies = scan.where(F.size("all") > 0).groupBy(F.col("id").alias("__id"), F.col("same").alias("__same")).agg(F.count("*").alias("copies"))
    weighed = free.join(copies, F.col("id").eqNullSafe(F.col("__id")) & (F.col("same") == F.col("__same"))).select("context", "instance", "copies", "seed")
    edges = stored(weighed.groupBy("context", "instance").agg(F.sum("copies").alias("w"), F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("seed")))
    near = Bitmap(stored(free.select("same").distinct()), "same").keep(rows.withColumn("same", F.xxhash64("text")), "same")
    chosen = stored(_accepted(rows, near, edges, rounds, least_score, least_seeds))
    sizes = free.where("kind = 4").groupBy("context").agg(F.count("*").alias("__rows"))
    found = spread_join(free.where("kind = 4"), chosen.join(sizes, "context"), ["context"], free.count())
    return found.select("id", "same", "start", "kind", "end").distinct()


def find(docs: DataFrame, *, rounds: int | None = None, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base array, spans array) of every whole text, one row for each input row.

    base and spans are arrays of struct(start, kind, end), code points, end exclusive, kind an
    index of KINDS, ordered by start and kind; spans holds base and what the method adds.  A
    null or empty text has none; repeated rows get the same spans; a null key stays null; other
    columns are not read; an empty table gives no rows.  With `rounds`, scoring stops there.
    Not found: plain words without digits that aren't assigned in quotes, and identifiers whose
    two words before them lead to other things in more than one of five places.
    """
    rows = pick(docs, key, text).select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    marked = rows.select("id", "text", F.xxhash64("text").alias("same"), base_spans(F.col("text")).alias("base"), _others(F.col("text")).alias("others"))
    whole = F.transform(
        F.when(F.size("base") + F.size("others") > 0, F.concat("base", "others")).otherwise(F.array().cast(SPAN)),
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), ((s["kind"] < 4) | _is_secret(F.col("text"), s)).alias("seed"),
            _context(F.col("text"), s["start"]).alias("context"), F.xxhash64(F.lower(s["text"])).alias("instance"),
        ),
    )
    short = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    scan = stored(marked.select("id", "same", short(F.col("base")).alias("base"), whole.alias("all")))
    added = _new_spans(rows, scan, rounds, least_score, least_seeds).groupBy(F.col("id").alias("__id"), F.col("same").alias("__same")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    both = scan.join(added, F.col("id").eqNullSafe(F.col("__id")) & (F.col("same") == F.col("__same")), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return both.select(F.col("id").alias(key), "base", F.array_sort(F.concat("base", F.coalesce("more", empty))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
