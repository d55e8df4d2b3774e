"""The paths that hot keys, hubs and large buckets take, with their sizes set low."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import made
from pyspark.sql import functions as F

from annulus.llm import common, components, line_dedup, mixing, ngram_join, pii
from annulus.llm.textscan import shingles


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.fixture
def spread(monkeypatch):
    monkeypatch.setattr(common, "SPREAD_FROM", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    monkeypatch.setattr(common, "SALTS", 3)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_spread_join_is_a_join(spark, spread, how):
    rng = random.Random(1)
    many = spark.createDataFrame([(7 if rng.random() < 0.6 else rng.randrange(40), i) for i in range(500)] + [(None, 1)], "k long, v long")
    few = many.where("k % 3 <> 0").groupBy("k").agg(F.count("*").alias("__rows"), F.max("v").alias("m"))
    got = common.spread_join(many, few, ["k"], many.count(), how)
    plain = many.join(few.drop("__rows"), ["k"], how)
    assert got.columns == plain.columns and Counter(got.collect()) == Counter(plain.collect())
    assert "__salt" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_hub_is_dealt_out(spark, spread):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 2000) for i in range(200)] + [(299, 3000), (3000, 3001)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(300), 3000, 3001], 0), **dict.fromkeys([*range(1000, 1200), 2000], 1000)}


def test_jaccard_in_blocks(spark, spread, monkeypatch):
    """Large buckets, blocks of few sets, few candidates at once, and every token hot."""
    for name, value in {"LARGE_BUCKET": 2, "BLOCK_SETS": 4, "CANDIDATES": 3, "HOT_CLASS": 3}.items():
        monkeypatch.setattr(ngram_join, name, value)
    docs = made(1, 100)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(table(spark, docs), k=4, percent=60).collect())
    assert got == brute.components(docs, 4, 60)


def test_unlinked_sets_of_one_bucket(spark, monkeypatch):
    """More sets than LARGE_BUCKET share n-grams without all being linked."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 32)
    rng, docs = random.Random(3), []
    shared = [f"s{j}" for j in range(30)]
    for i in range(ngram_join.LARGE_BUCKET + 40):
        docs.append((i, " ".join(shared + [f"w{i // 2}x{j}" if rng.random() < 0.97 else f"r{rng.randrange(50)}" for j in range(14)])))
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(table(spark, docs), k=2, percent=60).collect())
    assert got == brute.components(docs, 2, 60)
    assert 1 < len({c for _, _, c in got}) < len(docs)


def test_shared_ngrams_stand_behind_chance(spark, monkeypatch):
    """Far more n-grams than cells: those of a passage in 40 texts still come after those of one text."""
    for name in ("CELLS", "MOST_CELLS"):
        monkeypatch.setattr(ngram_join, name, 1 << 10, raising=False)
    passage = " ".join(f"p{j}" for j in range(30))
    docs = [(i, " ".join(f"{i}w{j}" for j in range(250)) + (f" {passage}" if i < 40 else "")) for i in range(400)]
    classes = ngram_join.order_classes(table(spark, docs).select("text"), 4)
    data = np.frombuffer(passage.encode(), dtype=np.uint8)
    (u,) = shingles(data, np.array([0, len(data)]), 4)
    found = classes[(u & np.uint64(len(classes) - 1)).astype(np.int64)]
    assert np.mean([(classes < c).mean() for c in found]) > 0.9


def test_cell_counts_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n, m, common in [(1, 1, 1), (7, 9, 6), (400, 430, 380), (500, 500, 300), (30_000, 26_000, 25_000), (3_000_000, 2_700_000, 2_700_000), (9, 5000, 9)]:
        u = rng.integers(0, 1 << 64, n + m - common, dtype=np.uint64)
        bound = ngram_join.overlap_bound(ngram_join.cell_counts(np.unique(u[:n])), ngram_join.cell_counts(np.unique(u[n - common :])))
        assert bound >= common
        if n == 500:  # far from the threshold: its text isn't needed
            assert bound < ngram_join._need(n, m, 85)


def test_lines_of_one_gap(spark, spread):
    """Many lines that differ in one word, null keys, and ids that repeat."""
    docs = [(i, f"all of these lines are alike but {i % 70} for one word\nline of its own {i} {i * 7} {i * 11} {i * 13}") for i in range(150)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    assert [got[i] for i, _ in docs] == brute.dedup_lines(docs)
    null = [(None, "one two three four five six")] * 40 + [(1, "one two three four five seven")]
    assert Counter((r.doc_id, r.n_kept_lines) for r in line_dedup.dedup_lines(table(spark, null)).collect()) == {(None, 1): 40, (1, 0): 1}


def test_identifiers_of_a_hot_context(spark, spread):
    docs = [(i, f"they wrote to b{i}@mail.example later") for i in range(60)] + [(100 + i, f"they wrote to EMP-{7000 + i % 3}X again with badge number EMP-{7000 + i % 3}X") for i in range(30)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(table(spark, docs)).collect()}
    assert [got[i] for i, _ in docs] == brute.identifiers(docs)


def test_mixing_of_null_keys(spark):
    docs = [(None, "w " * (i % 9), "s") for i in range(300)] + [(i, "w " * 5, None) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert mixing.mix(frame).count() == sum(r.copies for r in mixing.copies(frame).collect())


def test_a_bitmap_follows_its_keys(spark):
    few, many = (common.Bitmap(common.stored(spark.range(n)), "id") for n in (10, 100_000))
    assert few.bits == 1 << 16 and 32 * 100_000 <= many.bits <= 64 * 100_000 and common.Bitmap(common.stored(spark.range(100_000)), "id", most=1 << 17).bits == 1 << 17
    kept = many.keep(spark.range(0, 1_000_000), "id").count()
    assert 100_000 <= kept < 140_000
    assert many.keep(spark.range(0, 1_000_000), "id", inside=False).count() == 1_000_000 - kept
    null = spark.createDataFrame([(None,), (5,)], "id long")
    assert [r.id for r in many.keep(null, "id").collect()] == [5] and [r.id for r in many.keep(null, "id", inside=False).collect()] == [None]


def test_settled_deletes_what_is_left(spark):
    import os

    with common.settled(spark) as paths:
        common.stored(spark.range(3))
        kept = common.stored(spark.range(4))
        stays, gone = paths.pop(), paths[0]
    assert kept.count() == 4 and os.path.exists(stays) and not os.path.exists(gone)


def test_the_filter_stays_above_the_hashes(spark):
    """The verdict's filter must not be moved below the projection that computes its hashes."""
    from annulus.llm import quality

    docs = table(spark, [(1, "a b c"), (2, None)])
    plan = quality.kept(docs, docs.select("doc_id"))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line and "kept" in line]
    assert len(filters) == 1 and "xxhash64" not in filters[0]
