"""Token counts, BPE, language identification and personal data."""

import hashlib
import struct
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annulus.llm import bpe, langid, pii, queries, token_counts

HARD = ["", " ", "a  b   c ", "\n\n a\n", "a \n b\n\n c", "x\x1cy\x85z", "<|endoftext|>hi<|endoftext|>", "don't we'll 'S", "é́ñ 漢字 한국어 👩‍👧 ١٢٣ ²½", "\t\tx\ty ", " " * 50 + "x", "▁▁a ▁", "a　b  c"]


@pytest.fixture(scope="module")
def tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    counter = token_counts.loaded(queries.tokenizer("piece_bpe_32k.model"))
    pieces = token_counts.vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    vocabulary = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces.items()]
    whole = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, True))
    return counter, whole, tokenizers.Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))


def test_token_counts_equal_the_tokenizer(tokenizers, real):
    counter, whole, _ = tokenizers
    for t in HARD[1:] + [r[1] for r in real]:
        assert counter.count(t)[0] == len(whole.encode(token_counts.MARK + t.replace(" ", token_counts.MARK)).tokens), t[:80]
    assert counter.count("") == (0, 0, 0.0)


def test_the_query_equals_the_tokenizer(tokenizers, spark, real):
    got = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for i, t, *_ in real:
        assert got[i] == (len(tokenizers[1].encode(token_counts.MARK + t.replace(" ", token_counts.MARK)).tokens) if t else 0)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(alphabet="abcé", min_size=1, max_size=4), st.integers(-40, -1), min_size=1, max_size=30), st.lists(st.text(alphabet="abcéx", min_size=1, max_size=25), min_size=1, max_size=8))
def test_any_unigram_vocabulary(scores, texts):
    """Random vocabularies with many equal sums of scores."""
    from tokenizers import Tokenizer, models

    pieces = {p: s / 4 for p, s in scores.items()}
    vocabulary = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces.items()]
    # the unknown piece takes part in the least score of that library, so one as low stands in
    low = min(pieces.values())
    vocabulary[0] = ("<unk>", low)
    vocabulary[1:257] = [(p, low) for p, _ in vocabulary[1:257]]
    whole, counter = Tokenizer(models.Unigram(vocabulary, 0, True)), token_counts.CountingViterbi(pieces)
    for t in texts:
        assert counter.viterbi(t)[0] == len(whole.encode(t).tokens), t


def test_ties_go_to_the_path_found_first():
    counter = token_counts.CountingViterbi({"a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0, "bc": -2.0, "▁": -1.0})
    assert counter.viterbi("ab") == (1, 0, -2.0) and counter.viterbi("abc") == (2, 0, -3.0) and counter.viterbi("é")[:2] == (2, 2)


def test_token_counts_of_odd_rows(spark, odd, nothing):
    path = queries.tokenizer("piece_bpe_32k.model")
    assert {r.n_tokens for r in token_counts.token_counts(odd, path).where("doc_id = 2").collect()} == {0}
    rows = token_counts.token_counts(odd, path).collect()
    assert len(rows) == 13 and [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0] and len([r for r in rows if r.doc_id == 5]) == 2
    assert token_counts.token_counts(nothing, path).count() == 0


def test_bpe_equals_the_tokenizer(tokenizers, real):
    mine, whole = bpe.loaded(queries.tokenizer("byte_bpe_50k.json")), tokenizers[2]
    for t in HARD + [r[1] for r in real]:
        ids = whole.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == struct.pack(f"<{len(ids)}I", *ids), t[:80]
        assert mine.decode(mine.encode(t)) == whole.decode(ids, skip_special_tokens=False) == t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    whole = test_bpe_of_any_text.__dict__.setdefault("whole", Tokenizer.from_file(path))
    ids = whole.encode(text, add_special_tokens=False).ids
    assert bpe.loaded(path).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_no_token_crosses_a_certain_cut():
    mine = bpe.loaded(queries.tokenizer("byte_bpe_50k.json"))
    assert all(not mine.cuts(t) for i, t in mine.token.items() if i != 50256) and sum(mine.bound) > 0


def test_special_tokens_can_be_plain_text():
    path = queries.tokenizer("byte_bpe_50k.json")
    assert len(bpe.loaded(path).encode("<|endoftext|>")) == 4 < len(bpe.loaded(path, True).encode("<|endoftext|>"))


def test_bpe_tables(spark, odd, nothing):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in bpe.digests(odd, path).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[1].n_tokens, rows[1].ids_sha256, rows[1].decoded_sha256) == (0, empty, empty)
    assert bpe.digests(nothing, path).count() == 0 and bpe.digests(odd, path).count() == 13
    back = bpe.decode(bpe.encode(odd, path), path)
    want = Counter((r[0], r[1] or "") for r in odd.collect())
    assert Counter((r.doc_id, r.text) for r in back.collect()) == want
    assert bpe.round_trips(odd.where("doc_id > 5"), path).where("NOT same").count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_of_odd_rows(spark, odd, nothing):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("", "fr"), ("x", None)], "text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["en", "fr"]
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0 and rows[6].lang_pred in ("en", "fr")
    assert langid.predict(nothing, model).count() == 0
    empty = langid.fit(train.where("lang = 'zz'"))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.fit(train.where("lang = 'en'")).predict(np.ones(langid.BUCKETS))[0] == "en"


def test_language_equals_the_plain_version(spark, real):
    rows = [(i, t, lang) for i, t, lang, _ in real] + [(9001, "", "de"), (9002, None, "de"), (9003, "12 34", None), (9004, "la", None), (9005, "die the la les", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(t, lang) for i, t, lang in rows if lang and i % 3]
    model = langid.fit(frame.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    for (i, _, _), (lang, score, ambiguous) in zip(rows, brute.languages(train, [t for _, t, _ in rows])):
        assert (got[i].lang_pred, got[i].ambiguous) == (lang, ambiguous) and got[i].score == pytest.approx(score, abs=1e-9)
    assert any(r.ambiguous for r in got.values()) and not all(r.ambiguous for r in got.values())


def test_languages_come_in_parts(spark, real, monkeypatch):
    frame = spark.createDataFrame([(t, f"{lang}{i % 3}") for i, t, lang, _ in real if lang], "text string, lang string")
    whole = langid.fit(frame)
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    parts = langid.fit(frame)
    assert whole.languages == parts.languages and len(parts.languages) > 7
    assert np.array_equal(whole.weights, parts.weights) and np.array_equal(whole.trust, parts.trust)


def test_languages_that_fit_alike_are_ambiguous(spark):
    train = spark.createDataFrame([("the same text", "b"), ("the same text", "a"), ("ganz anders", "c")], "text string, lang string")
    found = langid.predict(spark.createDataFrame([(1, "the same text")], "doc_id long, text string"), langid.fit(train)).first()
    assert found.lang_pred == "a" and found.ambiguous


@pytest.mark.parametrize("k", [2, 4, 7, 8, 30])
def test_codewords_are_apart(k):
    code = langid.codewords(k).astype(int)
    apart = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
    assert apart >= (1 if k == 2 else 2 if k < 8 else 3)


TRICKS = [
    "a@b.co_x@y.zz", "a@b.c@d.e", "1.2.3.4.5.6.7.8 001.002.3.255 256.1.1.1", "4791 2398-5246 8395", "a@b.c..d x@y.z. q", "+1 (803) 555-4519) +1+1 +12 +1 2 3 4 5 6 7 8 9 0", "é@x.y ü 4791239852468395é \x01 x\x01y@z.w",
    "1 " * 3000, "1.1." * 2000, "a@" + "b." * 3000 + "c", "x" * 100_000, "+1 " * 3000, "9" * 50_000, None, "", "a.b.c@d.e.f-g", "😀4791239852468395 a😀b@c.d", "a@b.c," * 500, "4111 1111 1111 1111\n4111-1111-1111-1112",
]


def spans(docs):
    found = docs.select("doc_id", pii.base_spans(F.col("text")).alias("base"))
    return {r.doc_id: [tuple(s)[:3] for s in r.base] for r in found.collect()}


def test_base_spans(spark, real):
    texts = [*enumerate(TRICKS), *((100 + i, t) for i, t, *_ in real)]
    got = spans(spark.createDataFrame(texts, "doc_id long, text string"))
    for i, t in texts:
        assert got[i] == brute.personal(t), (t or "")[:80]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="1 2.@-+a()_\x01é", max_size=30), min_size=5, max_size=40))
def test_base_spans_of_any_text(spark, texts):
    got = spans(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert all(got[i] == brute.personal(t) for i, t in enumerate(texts))


def test_context_finds_unknown_identifiers(spark):
    known = [(i, f"please write to a{i}@mail.example soon") for i in range(12)]
    unknown = [(100 + i, f"they wrote to EMP-{7000 + i}X again") for i in range(3)]
    other = [(200 + i, f"in the year of ACT{1900 + i} nothing happened") for i in range(9)]
    learned = [(300 + i, f"they wrote to b{i}@mail.example later") for i in range(9)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(known + unknown + other + learned, "doc_id long, text string")).collect()}
    assert all(found[i] == [(14, 4, 23)] for i, _ in unknown)
    assert all(not found[i] for i, _ in other) and all(len(found[i]) == 1 for i, _ in known + learned)


def hard_identifiers():
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    docs = [f'set the token = "{secret(i)}" in it' for i in range(6)] + ['and the token = "short-one" too', "the token = 'UPPER_CODE' too", 'the token = "" and token = "abc"']
    docs += [f"{'w' * 400} {'v' * 300} x{i}@mail.example" for i in range(4)] + [f"{'u' * 400} {'v' * 300} EMP-77{i}X" for i in range(4)] + [f"{'w' * 400} {'v' * 300} EMP-88{i}X" for i in range(2)]
    docs += [f"of the y{i}@mail.example now" for i in range(5)] + ["of the 12345678 now"] + ["of the others of the rest"] * 9
    docs += [f"a({i}@mail.example) code: ({i}@mail.example) at \"+1 (803) 555-45{i}0\" to AB-CD_{i} on" for i in range(10, 16)] + [None, "", "123456 x", "x 123456", "a b 123456"]
    return [*enumerate(docs)]


def test_identifiers_equal_the_plain_version(spark, real):
    for docs in (hard_identifiers(), [(i, t) for i, t, *_ in real] + [(9000 + i, t) for i, t in hard_identifiers()]):
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        for (i, t), want in zip(docs, brute.identifiers(docs)):
            assert got[i] == want, (i, (t or "")[:80])
    assert any(s[1] == 4 for i, _ in hard_identifiers() for s in got[9000 + i])


def test_long_words_are_whole_words(spark):
    """Two contexts that differ only far to the left are two."""
    docs = [(i, f"{'w' * 400} {'v' * 300} x{i}@mail.example") for i in range(9)] + [(100 + i, f"{'u' * 400} {'v' * 300} EMP-77{i}X") for i in range(4)] + [(200, f"{'w' * 400} {'v' * 300} EMP-990X")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[200] == [4] and all(not got[100 + i] for i in range(4))


def test_secrets_of_the_tables_are_found(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = queries.op4_pii(spark, d).join(docs, "doc_id")
    planted = F.size(F.regexp_extract_all(F.lower("text"), F.lit('token = "[0-9a-f]{40}"'), F.lit(0)))
    said = found.agg(F.sum(planted), F.sum("n_id"), F.sum(F.least(planted, F.col("n_id")))).first()
    assert said[0] > 5 and said[2] >= 0.9 * said[0] and said[1] <= said[2] + 1


def test_personal_data_of_odd_rows(odd, nothing):
    rows = pii.find(odd).collect()
    assert len(rows) == 13 and all(not r.base for r in rows if r.doc_id in (None, 1, 2, 3)) and pii.find(nothing).count() == 0
