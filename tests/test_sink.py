"""Writing: encoding, retries, rate, resuming and what a file's outcome says."""

import pytest
from backend import FakeBackend

from annulus.operators import writing
from annulus.sources import documents
from annulus.streaming import remote_write as rw


@pytest.fixture
def fake():
    out = FakeBackend()
    yield out
    out.close()


def link(fake):
    return rw.Backend(fake.url + "/write", fake.url, "tenant")


def test_encode_round_trip():
    series = [({"b": "x", "a": "é"}, [1, 1 << 41, -5], [1.5, float("-inf"), 0.0]), ({}, [], [])]
    assert rw.decode(rw.encode(series)) == series
    assert rw.encode([({"b": "1", "a": "2"}, [], [])]) == rw.encode([({"a": "2", "b": "1"}, [], [])])


def test_backoff_and_pause(fake):
    waits, limiter = [], rw.RateLimiter(0)
    fake.answers = [500, 429, 204]
    assert rw.send(link(fake), [({"a": "b"}, [1], [2.0])], limiter, 5, waits.append) == 3 and waits == [1, 2]
    fake.answers = [503] * 9
    with pytest.raises(rw.Paused):
        rw.send(link(fake), [({"a": "b"}, [1], [2.0])], limiter, 8, waits.append)
    assert waits[2:] == [1, 2, 4, 8, 16, 32, 60, 60]
    fake.answers = [400]
    with pytest.raises(rw.WriteError):
        rw.send(link(fake), [({"a": "b"}, [1], [2.0])], limiter, 5, waits.append)
    assert fake.headers[0]["x-scope-orgid"] == "tenant" and fake.headers[0]["content-encoding"] == "snappy"


def test_rate():
    assert writing.write_schedule([100, 50, 10], 100) == [0.0, 1.0, 1.5] and writing.write_schedule([1, 1], 0) == [0.0, 0.0]
    assert writing.write_schedule([100, 100], 100, [0.0, 5.0]) == [0.0, 5.0]
    waits = []
    unlucky = type("Away", (), {"write": lambda self, series: (_ for _ in ()).throw(OSError("away"))})()
    counted = rw.RateLimiter(1000)
    with pytest.raises(rw.Paused):
        rw.send(unlucky, [({}, [1] * 500, [0.0] * 500)], counted, 2, waits.append)
    assert counted.reserve(0) <= 0.5
    now, slept = [10.0], []
    limiter = rw.RateLimiter(100, lambda: now[0], slept.append)
    for n in (100, 50, 10):
        limiter.acquire(n)
    assert slept == [1.0, 1.5]


def test_batches_pack_slices(spark):
    rows = [("f", ds, t, 1.0) for ds, n in (("a", 5), ("b", 2), ("c", 4)) for t in range(n)]
    out = writing.batches(spark.createDataFrame(rows, "file string, ds string, ts bigint, value double"), 4)
    assert [(r.ds, r.chunk, r.n, r.batch) for r in out.orderBy("ds", "chunk").collect()] == [("a", 0, 4, 0), ("a", 1, 1, 1), ("b", 0, 2, 1), ("c", 0, 4, 2)]


def history(spark):
    rows = [(f, "x", i * 300, float(i), "RECENT" if i > 5 else "OLDER") for f in ("a", "b") for i in range(10)]
    entries = [(f, "x", {"__name__": "x", "resourceId": f}) for f in ("a", "b", "none")]
    return spark.createDataFrame(rows, "file string, ds string, ts bigint, value double, pass string"), spark.createDataFrame(entries, "file string, ds string, labels map<string,string>")


def states(spark, path):
    def read():
        try:
            open(path).close()
        except OSError:
            return spark.createDataFrame([], "line int, file string, pass string, status string, samples bigint, attempts int, error string, label_hash string")
        return writing.last_states(documents.read_states(spark, path))

    return read


def test_backfill_resumes(spark, fake, tmp_path):
    points, entries = history(spark)
    log = str(tmp_path / "state.jsonl")
    run = lambda **k: rw.backfill(points, entries, link(fake), log, states(spark, log), rate=0, threads=1, retries=0, batch_samples=3, **k)
    fake.answers = [204, 204, 503]
    assert run() == "PAUSED"
    assert {r.file for r in states(spark, log)().collect()} <= {"a", "none"}
    assert run() == "DONE"
    assert sum(len(v) for v in fake.data.values()) == 20 and len(fake.data) == 2
    before = fake.writes
    assert run() == "DONE" and fake.writes == before
    assert states(spark, log)().where("status = 'DONE'").count() == 6


def test_a_governor_is_one_rate_one_flag_and_one_book():
    said, slept = [], []
    with rw.Governor(100, "localhost", said.append) as governor:
        a, b = (rw.Link(governor.address, slept.append) for _ in range(2))
        a.acquire(100)
        b.acquire(50)
        assert len(slept) == 1 and 0.5 < slept[0] <= 1.0 and a.stopped() is None
        a.report({"file": "f", "status": "PAUSED", "error": "away"})
        assert b.stopped() == "away" and said[0]["file"] == "f"
        with pytest.raises(RuntimeError):
            rw.Link((*governor.address[:2], "wrong")).acquire(1)
    with pytest.raises(RuntimeError):
        rw.Link(governor.address).stopped()


def test_unreadable_and_half_planned_files_fail(spark, fake, tmp_path):
    points, _ = history(spark)
    labels = lambda f, ds: (f, ds, {"__name__": ds, "resourceId": f})
    entries = spark.createDataFrame([labels("a", "x"), labels("b", "x"), labels("b", "y"), labels("broken", "x"), labels("gone", "x"), labels("quiet", "x")], "file string, ds string, labels map<string,string>")
    read = spark.createDataFrame([("a", None, ["x"]), ("b", None, ["x"]), ("broken", "damaged", None), ("quiet", None, ["x", "z"])], "file string, error string, names array<string>")
    log, said = str(tmp_path / "state.jsonl"), []
    run = lambda **k: rw.backfill(points, entries, link(fake), log, states(spark, log), read=read, rate=0, threads=2, say=said.append, **k)
    assert run() == "FAILED"
    rows = {(r.file, r["pass"]): (r.status, r.samples, r.attempts, r.error) for r in states(spark, log)().collect()}
    for turn, n in (("RECENT", 4), ("OLDER", 6)):
        assert rows["a", turn] == ("DONE", n, 1, None) and rows["quiet", turn] == ("DONE", 0, 1, None)
        assert rows["broken", turn] == ("FAILED", 0, 1, "read: damaged") and rows["gone", turn] == ("FAILED", 0, 1, "read: no such file")
        assert rows["b", turn] == ("FAILED", 0, 1, "planned data source y missing from file")
    assert {dict(k)["resourceId"] for k in fake.data} == {"a"} and any("FAILED broken" in x for x in said)
    whole = read.where("file = 'none'").unionByName(spark.createDataFrame([(f, None, ["x", "y"]) for f in ("a", "b", "broken", "gone", "quiet")], read.schema))
    assert rw.backfill(points, entries, link(fake), log, states(spark, log), read=whole, rate=0, retry_failed=True) == "DONE"
    assert states(spark, log)().where("status = 'DONE'").count() == 10


def test_changed_labels_are_told(spark, fake, tmp_path):
    points, entries = history(spark)
    log, said = str(tmp_path / "state.jsonl"), []
    run = lambda e: rw.backfill(points, e, link(fake), log, states(spark, log), rate=0, say=said.append)
    assert run(entries) == "DONE" and not any("again" in x for x in said)
    changed = entries.selectExpr("file", "ds", "map_concat(labels, map('new', '1')) AS labels").where("file = 'a'").unionByName(entries.where("file <> 'a'"))
    assert run(changed) == "DONE" and sum("1 files are written again" in x for x in said) == 2


def test_files_with_orphans_come_last(spark, fake):
    points, _ = history(spark)
    kinds = [("a", "x", {"f": "a"}, "ORPHAN_COMPLETE"), ("b", "x", {"f": "b"}, "MATCHED")]
    out = rw.write_files(points, spark.createDataFrame(kinds, "file string, ds string, labels map<string,string>, class string"), link(fake), rate=0, threads=1)
    assert [r.file for r in out.collect()] == ["b", "a"]


def test_a_series_that_cant_be_read_is_a_row(spark, fake):
    expected = spark.createDataFrame([("a=1", {"a": "1"}, 5)], "canon string, labels map<string,string>, ts bigint")
    (row,) = rw.read_back_table(expected, rw.Backend(None, "http://127.0.0.1:9")).collect()
    assert row.canon == "a=1" and row.ts is None and row.error


def test_refusals_fail_and_come_again_on_demand(spark, fake, tmp_path):
    points, entries = history(spark)
    log = str(tmp_path / "state.jsonl")
    run = lambda **k: rw.backfill(points, entries, link(fake), log, states(spark, log), rate=0, threads=1, retries=0, **k)
    fake.answers = [400]
    assert run() == "FAILED" and run() == "DONE" and states(spark, log)().where("status = 'FAILED'").count() == 1
    assert run(retry_failed=True) == "DONE" and states(spark, log)().where("status = 'FAILED'").count() == 0


def test_read_back_wants_exact_labels(spark, fake):
    fake.data = {(("a", "1"),): {5000: 1.0, 9000: 2.0}, (("a", "1"), ("b", "2")): {5000: 3.0}}
    assert rw.read_back(link(fake), {"a": "1"}, 5, 9) == [(5000, 1.0), (9000, 2.0)]
    expected = spark.createDataFrame([("a=1", {"a": "1"}, 5), ("a=1", {"a": "1"}, 9)], "canon string, labels map<string,string>, ts bigint")
    assert sorted(tuple(r) for r in rw.read_back_table(expected, link(fake)).collect()) == [("a=1", 5, 1.0, None), ("a=1", 9, 2.0, None)]


def test_preflight(fake):
    assert rw.preflight(link(fake), 1000, 9000, sleep=lambda _: None) == []
    fake.answers = [204, 400]
    assert len(rw.preflight(link(fake), 1000, 9001, sleep=lambda _: None)) == 1


def test_stream(spark, fake, tmp_path):
    points, entries = history(spark)
    points.select("file", "ds", "ts", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, ds string, ts bigint, value double").parquet(str(tmp_path / "in"))
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(rw.stream_to(link(fake), entries, rate=0)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(len(v) for v in fake.data.values()) == 20


def test_drift(spark):
    entries = spark.createDataFrame([("f", "r/x", "d", "MATCHED", {"a": "1"}), ("g", "r/y", "d", "ORPHAN_COMPLETE", {"a": "1"}), ("h", "r/z", "d", "PENDING", None)], "file string, resource string, ds string, class string, labels map<string,string>")
    live = lambda *rows: spark.createDataFrame(rows, "resource_id string, metric string, canon string")
    kinds = lambda *rows: {r.file: r.kind for r in writing.label_drift(entries, live(*rows), canary=5, seed=1).collect()}
    assert kinds(("r/x", "d", "a=1")) == {} and kinds(("r/x", "d", "a=2"), ("r/z", "d", "q=1")) == {"f": "stop", "h": "notice"}
    assert kinds(("r/y", "d", "a=1,b=2")) == {"g": "stop"}
