"""Line dedup of lines of any length."""

import brute
import pytest
from conftest import made

from annulus.llm import line_dedup


def dedup(spark, docs):
    return {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_short_exact_repeats_go(spark):
    docs = [(1, "Les.\nLes.\n\n \n漢字漢字。"), (2, "Les.\n漢字漢字。\nLes\n\n"), (3, " one  two\nthree four one two\none two"), (4, "a b c d\na b c x\na b c d e"), (5, "a b c x")]
    got = dedup(spark, docs)
    assert {i: r.text for i, r in got.items()} == {1: "Les.\n\n \n漢字漢字。", 2: "Les\n\n", 3: " one  two\nthree four one two", 4: "a b c d\na b c x\na b c d e", 5: ""}
    assert [(r.n_lines, r.n_kept_lines) for _, r in sorted(got.items())] == [(5, 4), (5, 3), (3, 2), (3, 3), (1, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_any_length(spark, seed):
    docs = made(seed)
    got = dedup(spark, docs)
    assert [got[i].text for i, _ in docs] == brute.dedup_lines(docs)


def test_documents_without_lines_can_go(spark):
    docs = [(1, "one two three four five six\nseven"), (2, "one two three four five six\neight nine"), (3, "ten"), (4, None), (5, ""), (6, "one two three four five six\na b c d e"), (7, "seven\n \n")]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), counts=False, least_words=5)
    assert {r.doc_id: r.text for r in out.collect()} == {1: docs[0][1], 3: "ten", 4: None, 5: "", 6: "a b c d e"}
