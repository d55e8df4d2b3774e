"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, BPE.

Stages take and return whole tables: rows that repeat, null keys, null and empty texts, very long
ones, ties, clashing column names and empty tables have the results that each stage names.  The
columns pass unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annulus.llm import bpe, line_dedup, mixing, ngram_join, quality
from annulus.llm.common import clear, settled, stored, table
from annulus.llm.queries import tokenizer, trusted

#: Words in a shingle of the group stage.
SHINGLE = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null, empty and very short texts are rejected.

    Each row is judged by itself, so repeated rows share their verdict.
    """
    return quality.kept(docs, trusted(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has go from the texts.

    A document that has lost lines and has fewer words left than one shingle goes: its content
    stands in earlier documents, and the next stage, which compares shingles, could not see that
    any more.  A text that loses nothing stays as it is, null and empty ones included; rows that
    repeat a key lose the same lines; rows with a null key come before all others.
    """
    return line_dedup.dedup_lines(docs, counts=False, chars="n_chars", least_words=SHINGLE)


def group_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8.

    It is the one of the least key; of rows that repeat a key, the greatest text stays.  Texts
    without a word and rows without a key always stay.
    """
    return ngram_join.one_of_each(docs, k=SHINGLE, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix draws it: 0, 1 or 2 times; one without words never.

    A null source is a source of its own, ties in size go by key, reruns draw the same.
    """
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row per drawn copy; a null text is an empty one."""
    return bpe.digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("groups", group_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The hash functions, components and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has stored is deleted when the next one's table is there."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with settled(spark) as paths:
            docs = stored(stage(spark, docs, sf_dir))
            own = paths.pop()
        if last:
            clear(spark, [last])
        last = own
    return STAGES[-1][1](spark, docs, sf_dir)
