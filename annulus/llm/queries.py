"""The registered queries of this subpackage: thin wrappers that name the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, langid, line_dedup, media, mixing, ngram_join, pii, quality, token_counts
from .common import pick, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_kept_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        # a second parameter of the lambda, even one with a default, would be the element's place
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")

    added = (F.size("spans") - F.size("base")).cast("long").alias("n_id")
    return found.select("doc_id", *(count(k) for k in range(4)), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def streamed(turns: DataFrame) -> DataFrame:
    """Stored turns as the log that led to them: each row is a message of its own.

    An assistant's text was streamed as a first half, thrown away, and made again from two
    deltas; any other text was begun and then edited to what is stored.  Rows of one turn stand
    by role and text; null turns come last, as in the SQL.  Rows are numbered within their turn,
    so a long conversation is spread over its turns.
    """
    row = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    message = F.struct(F.col("turn").isNull().alias("last"), "turn", row.alias("row"))
    half = F.floor(F.length("text") / 2).cast("int")
    front, back = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    none = F.lit(None).cast("string")

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(events)))

    made = log(("message", F.lit("")), ("delta", front), ("regenerate", none), ("delta", front), ("delta", back))
    events = F.when(F.col("role") == chat.TRAINED, made).otherwise(log(("message", front), ("edit", F.col("text"))))
    return turns.withColumn("message", message).select("conv_id", "message", "role", F.explode(events).alias("e")).select("conv_id", "message", "e.seq", "e.kind", "role", "e.text")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = rows.unionByName(extra)
    back = chat.read_back(chat.format_chats(streamed(turns)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.loss_texts(F.col("turns")), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic").where("quality = 1 AND toxic = 0").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.copies(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_media_columns": op3_media_columns,
    "op4_pii": op4_pii,
    "op5_bpe": op5_bpe,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}

#: Words as everywhere: runs of other characters than the six blanks.
_WORDS = "list_filter(str_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

BACK = "\\"
_ESCAPED = "regexp_replace({}, '([<\\[])(\\\\*)(\\|im_start\\|>|\\|im_end\\|>|/?s>|/?INST\\]|<SYS>>|</SYS>>)', '\\1\\\\\\2\\3', 'g')"

SQL: dict[str, str] = {
    "op2_line_dedup": f"""
WITH split AS (
  SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i AS line, ls[i] AS t, {_WORDS.format("ls[i]")} AS w
  FROM split, unnest(range(1, len(ls) + 1)) AS r(i)
), firsts AS (
  SELECT w, min((doc_id, line)) AS f FROM lines WHERE len(w) > 0 GROUP BY w
), variants AS (
  SELECT list_filter(w, lambda x, j: j <> g) AS r, g, f, w FROM firsts, unnest(range(1, len(w) + 1)) AS q(g) WHERE len(w) >= 5
  UNION ALL SELECT w, 0, f, w FROM firsts WHERE len(w) >= 5
), keyed AS (
  SELECT *, min(f) OVER (PARTITION BY r, g) AS gap, min(CASE WHEN g = 0 THEN f END) OVER (PARTITION BY r) AS own,
    min(CASE WHEN g > 0 THEN f END) OVER (PARTITION BY r) AS other
  FROM variants
), gone AS (
  SELECT DISTINCT f FROM keyed WHERE (g = 0 AND other < f) OR (g > 0 AND (gap < f OR own < f))
), kept AS (
  SELECT l.doc_id, l.line, l.t FROM lines l LEFT JOIN firsts s ON l.w = s.w
  WHERE len(l.w) = 0 OR ((l.doc_id, l.line) = s.f AND s.f NOT IN (SELECT f FROM gone))
), texts AS (
  SELECT doc_id, count(*) AS k, string_agg(t, chr(10) ORDER BY line) AS t FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(s.ls) END::BIGINT AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(t.k, 0) END::BIGINT AS n_kept_lines, sha256(coalesce(t.t, '')) AS kept_sha256
FROM documents d JOIN split s USING (doc_id) LEFT JOIN texts t USING (doc_id)
""",
    "op7_chat_formatting": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, 12 + length({_ESCAPED.format("replace(replace(role, '" + BACK + "', '" + BACK * 2 + "'), chr(10), '" + BACK + "n')")}) + 1 + length({_ESCAPED.format("text")}) + 11 AS chars FROM turns
), folded AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM folded
""",
    "op9_mixing": f"""
WITH sizes AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM totals
), levels AS (
  SELECT *, cap / weight AS fill, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / sum(weight) OVER g AS level FROM ranked
  WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    g AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), goal AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (fill, level)) FROM levels WHERE level * weight <= cap) * weight, cap)) AS target,
    ('0x' || substr(md5('17:' || coalesce('s' || source, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shift FROM levels
), placed AS (
  SELECT s.*, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY size DESC, doc_id NULLS LAST) AS k
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (least(floor(k * rate + shift) - floor((k - 1) * rate + shift), 2) * size)::BIGINT AS taken FROM placed
""",
}
