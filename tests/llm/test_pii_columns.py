"""The contract's columns of the personal data query, by the query itself."""

import hashlib
from collections import Counter

import brute

from annulus.llm import queries

ROWS = [
    (1, "a@b.co"), (2, "1.2.3.4"), (3, "4111 1111 1111 1111"), (4, "+1 (803) 555-4519"), (5, "a@b.co, c@d.ef and g@h.ij"), (6, "1.2.3.4 5.6.7.8 9.9.9.256"),
    (7, "4111-1111-1111-1111 1.2.3.4 é a@b.co 😀 +12345678901 4111111111111111 x@y.zz"), (8, "+1 803 555 45190 +1 803 555 45191"), (9, "none"), (10, ""), (11, None),
    (12, "a@b.co"), (12, "a@b.co"), (12, "1.2.3.4"), (None, "+12345678901 a@b.co"), (None, None), (-3, "\x01a@b.co\x01c@d.ef\x02"), (13, "10.0.0.1@b.co " * 40),
]


def wanted(doc_id, text):
    base = brute.personal(text)
    said = ",".join(f"{brute.KINDS[kind]}:{start}:{end}" for start, kind, end in base)
    return (doc_id, *(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(said.encode()).hexdigest())


def test_columns_of_any_rows(spark, real, tmp_path):
    rows = ROWS + [(1000 + i, t) for i, t, *_ in real]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_pii(spark, str(tmp_path))
    assert [(c, t) for c, t in found.dtypes[:7]] == [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k in brute.KINDS), ("base_sha256", "string"), ("spans", "string")]
    got = found.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(wanted(*r) for r in rows)
    for r in got:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert [kinds[k] for k in (*brute.KINDS, "id")] == [r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_id] and sum(kinds.values()) == r.n_spans
