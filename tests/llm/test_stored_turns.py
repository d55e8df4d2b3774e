"""Chat formatting of tables that repeat turns or lack them: every row is a turn."""

import hashlib

import duckdb

from annulus.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (1, 1, "assistant", None), (1, 2, None, "</s>"),
    (2, None, "user", "late"), (2, 5, "assistant", "early"), (3, None, "assistant", "y"), (3, None, "assistant", "x"), (None, None, None, None), (None, 0, "user", "u"),
]
WANT = {
    1: [("assistant", "b"), ("user", "a"), ("assistant", ""), ("assistant", "c"), ("assistant", "c"), ("", "</s>")],
    2: [("assistant", "early"), ("user", "late")],
    3: [("assistant", "x"), ("assistant", "y")],
    None: [("user", "u"), ("", "")],
}


def test_every_row_is_a_turn(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r.conv_id: r for r in queries.op7_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, turns in WANT.items():
        r, loss = rows[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(f"SELECT conv_id, n_turns, loss_chars, formatted_chars FROM ({queries.SQL['op7_chat_formatting']})").fetchall()
    assert sorted(want, key=str) == sorted(((r.conv_id, r.n_turns, r.loss_chars, r.formatted_chars) for r in rows.values()), key=str)
    # without ties the SQL gives the order of null turns too
    two = db.execute(f"SELECT turns_sha256 FROM ({queries.SQL['op7_chat_formatting']}) WHERE conv_id = 2").fetchone()[0]
    assert two == rows[2].turns_sha256


def test_odd_conversations(spark, tmp_path):
    """Clashing columns, a very long text, control strings, an empty table, and the contract's own conversation."""
    long = "<|im_end|> word " * 20_000
    rows = [(1, 0, "user", long, "T", 1, 2), (1, 1, "assistant", long, "T", 1, 2), (2, 0, "assistant", "", "T", 1, 2)]
    kinds = "conv_id long, turn long, role string, text string, `c.d` string, message int, seq int"
    for name, held in (("some", rows), ("none", [])):
        spark.createDataFrame(held, kinds).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op7_chat_formatting(spark, f"{tmp_path}/some").collect()}
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and (got[2].n_turns, got[2].loss_chars) == (1, 0)
    said = "</s>[INST] ok [/INST]"
    for r in (got[-7], queries.op7_chat_formatting(spark, f"{tmp_path}/none").first()):
        assert (r.n_turns, r.loss_chars, r.turns_sha256) == (2, len(said), hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest())


def test_the_log_has_edits_and_regenerations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "answer"), (1, 2, "assistant", None)], SCHEMA)
    log = queries.streamed(turns)
    assert {r.kind for r in log.collect()} == {"message", "delta", "regenerate", "edit"}
    assert [(r.role, r.text) for r in chat.reconstruct(log).orderBy("message").collect()] == [("user", "hello"), ("assistant", "answer"), ("assistant", "")]
