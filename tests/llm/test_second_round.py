"""Identifiers that only patterns learnt in an earlier round can find."""

from annulus.llm import pii

SCHEMA = "doc_id long, text string"


def found(spark, docs, **options):
    return {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(docs, SCHEMA), **options).collect()}


def test_a_second_round_finds_more(spark):
    seeded = [(i, f"they wrote to b{i}@mail.example later") for i in range(20)]
    first = [(100 + i, f"they wrote to EMP-{7000 + i}X again") for i in range(8)]
    second = [(200 + i, f"with badge number EMP-{7000 + i}X at hand") for i in range(8)]
    only = [(300, "with badge number EMP-8123Q at hand")]
    docs = seeded + first + second + only
    got = found(spark, docs)
    assert all(got[100 + i] == [(14, 4, 23)] and got[200 + i] == [(18, 4, 27)] for i in range(8)) and got[300] == [(18, 4, 27)]
    once = found(spark, docs, rounds=1)
    assert not once[300] and all(not once[200 + i] for i in range(8))


def test_a_pattern_is_no_support_for_itself(spark):
    seeded = [(i, "mail comes from one@mail.example today") for i in range(40)]
    docs = seeded + [(100 + i, f"mail comes from LOT-{5000 + i}Z today") for i in range(5)]
    got = found(spark, docs)
    assert all(not got[100 + i] for i in range(5))
