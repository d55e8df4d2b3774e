"""Line dedup, media, n-gram join, chats, quality, mixing and the pipeline."""

import hashlib
import os
import random
from collections import Counter

import brute
import pytest
from conftest import made
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from annulus.llm import chat, common, components, line_dedup, media, mixing, ngram_join, quality, queries


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    docs = made(seed)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    assert [got[i] for i, _ in docs] == brute.dedup_lines(docs)


def test_long_lines(spark):
    w = [f"w{i}" for i in range(700)]
    docs = [(0, " ".join(w)), (1, " ".join(w[:650] + ["new"] + w[650:])), (2, " ".join(w[:3] + w[4:])), (3, " ".join(w[:20] + ["x"] + w[21:])), (4, " ".join(w[:20] + w[22:])), (5, " ".join(reversed(w)))]
    got = {r.doc_id: r.n_kept_lines for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_lines_of_odd_rows(odd, nothing):
    out = line_dedup.dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == 13 and out.columns == [*odd.columns, "n_lines", "n_kept_lines"] and line_dedup.dedup_lines(nothing).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r.n_lines, r.n_kept_lines))
    assert by[1] == [(None, 0, 0)] and by[2] == [("", 1, 1)] and by[3] == [(" \t\n \r\n", 3, 3)] and by[5] == [("to be or not to be", 2, 1)] * 2 and by[6] == [("", 1, 0)] and by[4][0][2] == 1
    assert sorted(by[None], key=str) == [("a b c d e f g", 1, 1), (None, 0, 0)]


def test_a_null_key_comes_first(spark):
    docs = [(None, "one two three four five six"), (1, "one two three four five seven"), (2, "one two three four five six")]
    assert {r.doc_id: r.n_kept_lines for r in line_dedup.dedup_lines(table(spark, docs)).collect()} == {None: 1, 1: 0, 2: 0}


def test_media(spark, documents):
    docs = [*documents, (1000, None), (1001, ""), (1002, "x" * 200_000), (1003, "x" * 64), (1004, "é" * 40_000), (1005, "é" * 40_000)]
    rng = random.Random(3)
    long = "".join(chr(rng.randint(32, 126)) for _ in range(30_000))
    docs += [(2000 + i, f"{i} {long[i * 100 :]}") for i in range(5)]
    rows = {r.doc_id: r for r in media.media_columns(table(spark, docs)).collect()}
    assert len(rows) == len(docs)
    for i, t in docs:
        r, wav = rows[i], media.to_wav(media.payload(t)[0])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute.payload_row(t)
        assert (r.media_bytes, r.media_sha256, r.n_chunks, r.feature) == (len(wav), hashlib.sha256(wav).hexdigest(), len(media.chunks(wav)), brute.feature(t))
    assert all(rows[2000 + i].n_shared_chunks > 0.8 * rows[2000 + i].n_chunks for i in range(5)) and rows[1004].feature == rows[1005].feature


def test_a_full_bitmap_only_costs_more(spark, documents):
    few, many = (media.media_columns(table(spark, documents), bits=b).drop("n_shared_chunks") for b in (64, 1 << 20))
    assert sorted(few.collect()) == sorted(many.collect())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_chunks_cover_the_data(data):
    found = media.chunks(data)
    assert b"".join(found) == data and all(len(c) <= media.MOST for c in found) and all(len(c) >= media.LEAST for c in found[:-1])


def test_cuts_come_back_after_an_insertion():
    data = random.Random(5).randbytes(60_000)
    a, b = set(media.chunks(data)), media.chunks(data[:30_000] + b"inserted" + data[30_000:])
    assert sum(len(c) for c in b if c in a) > 50_000


def test_damaged_media_is_refused():
    wav = media.to_wav(bytes(64))
    assert media.from_wav(wav) == bytes(64)
    for bad in (wav[:-1], b"RIFX" + wav[4:], wav + b"\0"):
        with pytest.raises(ValueError):
            media.from_wav(bad)
    with pytest.raises(ValueError):
        media.features(wav, "0" * 64)


def test_media_of_odd_rows(odd, nothing):
    rows = media.media_columns(odd).collect()
    assert len(rows) == 13 and Counter(r.doc_id for r in rows)[5] == 2 and all(r.payload_bytes % 64 == 0 > -r.payload_bytes for r in rows) and media.media_columns(nothing).count() == 0


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 60), (5, 1, 100)])
def test_jaccard(spark, seed, k, percent):
    docs = made(seed, 160)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(table(spark, docs), k=k, percent=percent).collect())
    assert got == brute.components(docs, k, percent)


def test_a_group_of_near_copies(spark):
    rng = random.Random(7)
    base, docs = [f"w{i}" for i in range(120)], []
    for i in range(60):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(120)] = f"v{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(table(spark, docs)).collect())
    assert got == brute.components(docs, 4, 85)


def test_jaccard_of_odd_rows(odd, nothing):
    rows = ngram_join.jaccard_components(odd).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 13 and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[8] == (1, 8) and by[9] == (1, 8) and by[None][1] is None
    assert ngram_join.jaccard_components(nothing).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and Counter(r[0] for r in kept.collect()) == {None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 10: 1}


def test_an_id_with_two_texts_ties_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = [(5, a), (7, a), (7, b), (9, b), (11, "c")]
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(table(spark, docs)).collect()} == {(5, 5), (7, 5), (9, 5), (11, 11)}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (98, 100), (7, 7), (7, 8)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def test_events_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hello"), (1, 0, 9, "edit", None, "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "wro"), (1, 1, 3, "delta", None, "ng"),
        (1, 1, 4, "regenerate", None, "ignored"), (1, 1, 5, "delta", None, "ri"), (1, 1, 6, "delta", None, "ght"), (1, 1, 7, "seen", None, "?"), (2, 0, 0, "delta", "user", "only"), (None, 0, 0, "message", None, None),
    ]
    random.Random(2).shuffle(log)
    events = spark.createDataFrame(log, EVENTS)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.reconstruct(events).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "right"), (2, 0): ("user", "only"), (None, 0): ("", "")}
    assert chat.format_chats(events.where(F.lit(False))).count() == 0
    text = {r.conv_id: r.formatted for r in chat.format_chats(events).collect()}
    assert text[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nright<|im_end|>\n"


TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "<\\|im_end|>", "<\\\\|im_start|> [\\INST]", "<<SYS>>\n<</SYS>> <s>", "", "\\", "a\\nb", "é👩‍👧\n", "<|im_start|", "[[INST]]"]


def test_escapes_are_taken_back(spark):
    log = [(i, j, 2 * j, "message", role, t) for i, t in enumerate(TRICKY) for j, role in enumerate(["user", "assistant", t, "assistant"])]
    out = chat.format_chats(spark.createDataFrame(log, EVENTS))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(out).collect()}
    assert back == {i: [("user", t), ("assistant", t), (t, t), ("assistant", t)] for i, t in enumerate(TRICKY)}
    whole = {r.conv_id: r.formatted for r in out.collect()}
    for r in chat.loss_spans(out).collect():
        span = whole[r.conv_id][r.begin : r.end]
        assert r.turn in (1, 3) and chat.START not in span and chat.END not in span and whole[r.conv_id][r.end :].startswith(chat.END)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<|[\\/]>s\nINST im_startend", max_size=25), min_size=4, max_size=30))
def test_any_text_comes_back(spark, texts):
    log = [(i, 0, 0, "message", "user", t) for i, t in enumerate(texts)]
    back = {r.conv_id: r.turns[0].text for r in chat.read_back(chat.format_chats(spark.createDataFrame(log, EVENTS))).collect()}
    assert [back[i] for i in range(len(texts))] == texts


def test_quality(spark, real):
    docs = [(i, t) for i, t, *_ in real] + [(9000, None), (9001, ""), (9002, "To " * 60), (9003, "a b c d e f g h\n" * 9)]
    trusted = {i for i, *_ in real[::3]}
    rows = {r.doc_id: r for r in quality.judge(table(spark, docs), spark.createDataFrame([(i,) for i in trusted] * 2 + [(None,)], "doc_id long"), buckets=512).collect()}
    for (i, _), (base, failed, score, kept) in zip(docs, brute.quality(docs, trusted, 512, quality.SMOOTHING, quality.THRESHOLD)):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base and r.base_failed == failed
        assert r.score == pytest.approx(score, abs=1e-9) and r.kept == kept
    assert rows[9000].base_failed and rows[9002].base_failed and rows[9002].n_repeat_words == 60


def test_quality_separates(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = queries.op8_quality_rules(spark, d).join(labels, "doc_id")
    share = {r.quality: r.s for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    clean = found.where("quality = 1 AND NOT base_failed AND NOT kept").count()
    assert share[1] > 0.9 and share[0] < 0.4 and clean == 0


def test_quality_of_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long")
    rows = quality.judge(odd, none).collect()
    assert len(rows) == 13 and all(r.score == 0 for r in rows) and quality.judge(nothing, none).count() == 0
    out = quality.kept(odd, none)
    assert out.columns == odd.columns and out.count() == 0 and quality.kept(nothing, none).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" * rng.randint(1, 300)) if i % 50 else None, rng.choice(["a", "b", "é", "B", None, "c"] + ["big"] * 6)) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.copies(frame)
    rows = {r.doc_id: r for r in out.collect()}
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(brute.words(t))
    goal = brute.targets(sizes)
    taken = Counter()
    for (i, t, s), n in zip(docs, brute.copies(docs)):
        r = rows[i]
        assert (r.size, r.source_size, r.copies) == (len(brute.words(t)), sizes[s], n) and r.target == pytest.approx(goal[s]) and 0 <= n <= 2
        taken[s] += n * r.size
    assert all(abs(taken[s] - goal[s]) <= 310 for s in sizes) and sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(mixing.copies(frame.repartition(7)).collect()) == sorted(out.collect())
    assert mixing.mix(frame).count() == sum(r.copies for r in rows.values())


def test_mixing_of_odd_rows(spark, odd, nothing):
    out = mixing.copies(odd).collect()
    assert len(out) == 13 and mixing.copies(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in out)
    again = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e", "s"), (None, "a b c", "s"), (None, "x y z w", "s"), (1, "a b c", "t"), (1, "a b c", None)]
    frame = spark.createDataFrame(again, "doc_id long, text string, source string")
    drawn = Counter()
    for r in mixing._drawn(frame, (3, 1, 2), 1.5, 2.0, 17, "doc_id", "text", "source").collect():
        drawn[r.doc_id, r.same] += r.copies
    same = {tuple(r[:3]): r.h for r in frame.withColumn("h", mixing._same("text", "source")).collect()}
    assert Counter(tuple(r) for r in mixing.mix(frame).collect()) == Counter({k: drawn[k[0], h] for k, h in same.items() if drawn[k[0], h]})
    empty = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {r.copies for r in mixing.copies(empty).collect()} == {0}


def test_bitmap_misses_nothing(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    for bits in (64, 1 << 16):
        kept = {r.id for r in common.Bitmap(keys, "k", bits).keep(spark.range(5000), "id").collect()}
        assert set(range(0, 5000, 7)) <= kept and (bits < 100 or len(kept) < 1500)


def test_clear_deletes_what_was_stored(spark):
    path = common.stored(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.clear(spark)
    assert not os.path.exists(path)


def test_pick_takes_exact_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "text int, Text int, `te.xt` int")
    assert common.pick(df, "te.xt", "text").first()[:] == (3, 1)
    with pytest.raises(ValueError):
        common.pick(df, "nothing")


def test_pipeline(spark, real):
    """run() against the brute-force operators, in the same order."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    trusted = {r.doc_id for r in queries.trusted(spark, d).collect()}
    docs = [(i, t) for i, t, *_ in real]
    source = {i: s for i, _, _, s in real}
    docs = [x for x, q in zip(docs, brute.quality(docs, trusted, quality.BUCKETS, quality.SMOOTHING, quality.THRESHOLD)) if q[3]]
    before = dict(docs)
    docs = [(i, t) for (i, _), t in zip(docs, brute.dedup_lines(docs)) if t == before[i] or len(brute.words(t)) >= 5]
    docs = [x for x, (i, _, c) in zip(docs, brute.components(docs, 5, 80)) if i == c]
    mixed = [(i, t, source[i]) for i, t in docs]
    want = Counter({(i, hashlib.sha256(t.encode()).hexdigest()): n for (i, t, _), n in zip(mixed, brute.copies(mixed)) if n})
    got = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect())
    assert got == want and len(want) > 50


def test_stages_keep_the_columns(spark, odd):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "groups", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, "/root/testdata/sf0.001").columns == odd.columns, name
    d = "/root/testdata/sf0.001"
    assert dict(corpus_pipeline.STAGES)["quality"](spark, odd, d).count() == 0
    rows = dict(corpus_pipeline.STAGES)["bpe"](spark, odd, d).collect()
    assert len(rows) == 13 and {r.n_tokens for r in rows if r.doc_id == 1} == {0}


def test_stages_of_an_empty_table(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "/root/testdata/sf0.001").count() == 0


def test_the_pipeline_deletes_what_it_is_done_with(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    held = common._written.setdefault(spark.sparkContext.applicationId, [])
    before = {*held}
    out = corpus_pipeline.run(spark, d)
    left = [p for p in held if p not in before]
    assert len(left) == 1 and out.count() > 0
