"""The sink: samples as remote-write requests, with retries, a shared rate and resumable state.

Delivery is at least once and idempotent by (labels, time).  Each file is one unit of work: its
outcome is a row, also when the backend stays away (`paused`), so Spark doesn't retry it and the
driver can stop before the next pass.  The driver alone appends to the state log, file by file:
a small server on it gives all writers one rate and one stop flag and takes their outcomes.
"""

from __future__ import annotations

import json
import math
import secrets
import socket
import socketserver
import struct
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import canonical
from ..operators import writing
from ..shipping import ship
from ..sources.documents import StateLog

CONNECT_SECONDS, WRITE_SECONDS, READ_SECONDS = 10, 30, 60
Series = tuple[dict[str, str], list[int], list[float]]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def encode(series: list[Series]) -> bytes:
    """A write request: labels sorted, samples as (value, milliseconds)."""
    out = []
    for labels, times, values in series:
        body = b"".join(_field(1, _field(1, k.encode()) + _field(2, v.encode())) for k, v in sorted(labels.items()))
        body += b"".join(_field(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _varint(t)) for t, v in zip(times, values))
        out.append(_field(1, body))
    return b"".join(out)


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    while at < len(raw):
        tag = varint()
        if tag & 7 == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        elif tag & 7 == 1:
            yield tag >> 3, raw[at : at + 8]
            at += 8
        elif tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            raise ValueError(f"wire type {tag & 7}")


def decode(raw: bytes) -> list[Series]:
    out = []
    for _, body in _fields(raw):
        labels, times, values = {}, [], []
        for number, part in _fields(body):
            found = dict(_fields(part))
            if number == 1:
                labels[found[1].decode()] = found[2].decode()
            else:
                values.append(struct.unpack("<d", found.get(1, bytes(8)))[0])
                t = found.get(2, 0)
                times.append(t - (1 << 64) if t >> 63 else t)
        out.append((labels, times, values))
    return out


def packed(series: list[Series]) -> bytes:
    """The body of a request: a write request in a snappy block."""
    return pa.compress(encode(series), codec="snappy", asbytes=True)


def unpacked(body: bytes) -> list[Series]:
    size = shift = 0
    for b in body:
        size |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            break
    return decode(pa.decompress(body, decompressed_size=size, codec="snappy", asbytes=True))


class WriteError(OSError):
    def __init__(self, status: int, body: str) -> None:
        super().__init__(f"HTTP {status}: {body}")
        self.status, self.retryable = status, status == 429 or status >= 500


@dataclass
class Backend:
    """The HTTP interface of a metrics backend."""

    write_url: str | None = None
    read_url: str | None = None
    org_id: str | None = None

    def _open(self, request: urllib.request.Request, seconds: int) -> bytes:
        if self.org_id:
            request.add_header("X-Scope-OrgID", self.org_id)
        try:
            with urllib.request.urlopen(request, timeout=seconds) as answer:
                return answer.read()
        except urllib.error.HTTPError as x:
            raise WriteError(x.code, x.read(2048).decode("utf-8", "replace")) from x

    def write(self, series: list[Series]) -> None:
        body = packed(series)
        headers = {"Content-Type": "application/x-protobuf", "Content-Encoding": "snappy", "X-Prometheus-Remote-Write-Version": "0.1.0"}
        self._open(urllib.request.Request(self.write_url, data=body, headers=headers, method="POST"), WRITE_SECONDS)

    def _get(self, path: str, **query: object) -> object:
        url = f"{self.read_url.rstrip('/')}{path}?{urllib.parse.urlencode(query)}"
        answer = json.loads(self._open(urllib.request.Request(url), READ_SECONDS))
        if answer.get("status") != "success":
            raise OSError(f"the backend says {answer.get('error', answer.get('status'))}")
        return answer["data"]

    def series(self, selector: str, start: int, end: int) -> list[dict[str, str]]:
        return self._get("/api/v1/series", **{"match[]": selector, "start": start, "end": end})

    def query(self, expression: str, at: int) -> list[Series]:
        """Vectors and matrices; times in rounded milliseconds, values from text."""
        out = []
        for r in self._get("/api/v1/query", query=expression, time=at)["result"]:
            points = r["values"] if "values" in r else [r["value"]]
            out.append((r["metric"], [round(float(t) * 1000) for t, _ in points], [float(v) for _, v in points]))
        return out


class RateLimiter:
    """Samples a second over all that share it: the first goes at once, idle time is no credit."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.clock, self.sleep, self.free, self.lock = rate, clock, sleep, -math.inf, threading.Lock()

    def reserve(self, n: int) -> float:
        """Seconds to wait before n samples may go."""
        if self.rate <= 0:
            return 0.0
        with self.lock:
            now = self.clock()
            start = max(now, self.free)
            self.free = start + n / self.rate
        return start - now

    def acquire(self, n: int) -> None:
        if (wait := self.reserve(n)) > 0:
            self.sleep(wait)

    def stopped(self) -> str | None:
        return None

    def report(self, outcome: dict) -> None:
        pass


class Governor:
    """On the driver: one rate, one stop flag and one book of outcomes for all writers of a pass.

    Writers send lines of JSON with the pass's token; each is answered by one line.
    """

    def __init__(self, rate: float, host: str, book: Callable[[dict], None] = lambda _: None) -> None:
        self.limiter, self.why, token, own, lock = RateLimiter(rate), None, secrets.token_hex(16), self, threading.Lock()

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for line in self.rfile:
                    said = json.loads(line)
                    if said.pop("token", None) != token:
                        return
                    answer = {"wait": own.limiter.reserve(said["acquire"]) if "acquire" in said else 0.0}
                    if "outcome" in said:
                        if said["outcome"]["status"] == "PAUSED":
                            own.why = own.why or said["outcome"]["error"]
                        with lock:
                            book(said["outcome"])
                    self.wfile.write(json.dumps(answer | {"stop": own.why}).encode() + b"\n")

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads = allow_reuse_address = True

        self.server = Server(("", 0), Handler)
        self.address = (host, self.server.server_address[1], token)

    def __enter__(self) -> Governor:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.server.shutdown()
        self.server.server_close()


class Link:
    """A writer's end of a Governor, with the interface of a RateLimiter."""

    def __init__(self, address: tuple[str, int, str], sleep: Callable[[float], None] = time.sleep) -> None:
        self.address, self.sleep, self.file = address, sleep, None

    def _ask(self, **said: object) -> dict:
        try:
            if self.file is None:
                self.file = socket.create_connection(self.address[:2], CONNECT_SECONDS).makefile("rwb")
            self.file.write(json.dumps(said | {"token": self.address[2]}).encode() + b"\n")
            self.file.flush()
            return json.loads(self.file.readline())
        except (OSError, ValueError) as x:  # no matter of the backend: the task fails and is run again
            raise RuntimeError(f"the driver's rate and outcome server can't be reached: {x}") from x

    def acquire(self, n: int) -> None:
        if (wait := self._ask(acquire=n)["wait"]) > 0:
            self.sleep(wait)

    def stopped(self) -> str | None:
        return self._ask()["stop"]

    def report(self, outcome: dict) -> None:
        self._ask(outcome=outcome)


class Paused(Exception):
    """The backend stays away: try later."""


def send(backend: Backend, series: list[Series], limiter: RateLimiter | Link, retries: int, sleep: Callable[[float], None] = time.sleep) -> int:
    """How many attempts a request took; refusals are raised, exhausted retries raise Paused.

    The rate counts samples once, whatever the attempts.
    """
    waits = [*writing.attempts(retries)]
    limiter.acquire(sum(len(t) for _, t, _ in series))
    for attempt in range(1, retries + 2):
        try:
            backend.write(series)
            return attempt
        except WriteError as x:
            if not x.retryable:
                x.attempts = attempt
                raise
            problem = x
        except OSError as x:
            problem = x
        if attempt <= retries:
            sleep(waits[attempt - 1])
    raise Paused(str(problem))


OUTCOME = "file string, status string, samples bigint, attempts int, error string"


def write_files(samples: DataFrame, labels: DataFrame, backend: Backend, *, rate: float = 20_000, threads: int = 4, batch_samples: int = 2_000, retries: int = 5, governor: tuple[str, int, str] | None = None) -> DataFrame:
    """OUTCOME of each file: DONE, FAILED or PAUSED.

    samples: file, ds, ts, value of one pass; labels: file, ds, labels, and class if there is
    one: files with an orphan come last.  Files are dealt to `threads` tasks; rows come sorted,
    and a task holds one batch.  The tasks share the rate and the stop flag of the governor at
    that address and report each file to it; without one they share the rate evenly.
    """
    ship(samples.sparkSession)
    late = F.bool_or(S.is_orphan(F.col("class"))) if "class" in labels.columns else F.bool_or(F.lit(False))
    order = labels.groupBy("file").agg(late.alias("late"))
    rows = samples.join(labels.select("file", "ds", F.to_json("labels").alias("labels")), ["file", "ds"]).join(order, "file")
    ordered = rows.select("file", "ds", "labels", "ts", "value", "late").repartition(threads, "file").sortWithinPartitions("late", "file", "ds", "ts").drop("late")
    share = rate / threads if rate > 0 else 0.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter, now, state, batch, filled = Link(governor) if governor else RateLimiter(share), None, None, {}, 0
        stopped = None

        def begin(file: str) -> dict:
            why = stopped or limiter.stopped()
            return {"file": file, "status": "PAUSED" if why else "DONE", "samples": 0, "attempts": 1, "error": why}

        def flush() -> None:
            nonlocal batch, filled, stopped
            if batch and state["status"] == "DONE":
                try:
                    state["attempts"] = max(state["attempts"], send(backend, [(json.loads(k), t, v) for k, (t, v) in batch.items()], limiter, retries))
                    state["samples"] += filled
                except Paused as x:
                    state.update(status="PAUSED", error=str(x))
                    stopped = str(x)
                except OSError as x:
                    state.update(status="FAILED", error=str(x), attempts=max(state["attempts"], getattr(x, "attempts", 1)))
            batch, filled = {}, 0

        def end() -> dict:
            flush()
            limiter.report(state)
            return state

        for part in parts:
            done = []
            for (file, _, labels), series in part.groupby(["file", "ds", "labels"], sort=False):
                if file != now:
                    if state:
                        done.append(end())
                    now, state = file, begin(file)
                times, values = (series["ts"] * 1000).tolist(), series["value"].tolist()
                for lo in range(0, len(times), batch_samples):
                    piece = times[lo : lo + batch_samples]
                    if filled + len(piece) > batch_samples:
                        flush()
                    held = batch.setdefault(labels, ([], []))
                    held[0].extend(piece)
                    held[1].extend(values[lo : lo + batch_samples])
                    filled += len(piece)
            yield pd.DataFrame(done, columns=["file", "status", "samples", "attempts", "error"])
        if state:
            yield pd.DataFrame([end()], columns=["file", "status", "samples", "attempts", "error"])

    return ordered.mapInPandas(run, OUTCOME)


def backfill(history: DataFrame, entries: DataFrame, backend: Backend, log: str, states: Callable[[], DataFrame], *, read: DataFrame | None = None, guard: Callable[[str], None] = lambda _: None, retry_failed: bool = False, say: Callable[[str], None] = lambda _: None, rate: float = 20_000, **options) -> str:
    """Write both passes, recent first; DONE, PAUSED or FAILED.  The state log grows file by file,
    as writers are done with them.

    history: file, ds, ts, value, pass; read: file, error, names of the archive files as found
    now (all readable and whole if there is none); states() reads the log anew before each
    pass; guard runs before each pass and may raise; say takes notices.
    """
    from ..operators.labels import label_hash

    spark, planned = history.sparkSession, entries.where("labels IS NOT NULL")
    hashes, book, any_failed = label_hash(planned), StateLog(log), False
    host = spark.conf.get("spark.driver.host", "localhost")
    # the writers carry a file's label hash as part of its name, so that the driver needs no list of files
    named = planned.join(hashes, "file").withColumn("file", F.to_json(F.struct("file", "label_hash"))).drop("label_hash")
    for turn in ("RECENT", "OLDER"):
        guard(turn)
        files = writing.todo(hashes, states().where(F.col("pass") == turn), retry_failed=retry_failed).persist(StorageLevel.DISK_ONLY)
        try:
            counts, why = _write_pass(turn, history.where(F.col("pass") == turn), files, planned, named, read, book, say, host, backend, rate, options)
        finally:
            files.unpersist()
        any_failed |= counts["FAILED"] > 0
        say(f"pass {turn}: {counts['DONE']} files done, {counts['FAILED']} failed")
        if counts["PAUSED"]:
            say(f"paused: {why}")
            return "PAUSED"
    return "FAILED" if any_failed else "DONE"


def _write_pass(turn: str, points: DataFrame, files: DataFrame, planned: DataFrame, named: DataFrame, read: DataFrame | None, book: StateLog, say: Callable[[str], None], host: str, backend: Backend, rate: float, options: dict) -> tuple[Counter, str | None]:
    """How many files ended how, and why the writers paused."""
    if again := writing.rewritten(files):
        say(f"{again} files are written again because their planned labels changed; series under the old labels stay in the backend")
    none = files.sparkSession.createDataFrame([], "file string, error string")
    bad = writing.unwritable(files, planned, read) if read is not None else none
    chosen, counts = points.join(files.select("file", "label_hash").join(bad, "file", "left_anti"), "file"), Counter()

    def note(outcome: dict) -> None:
        counts[outcome["status"]] += 1
        if outcome["status"] != "PAUSED":
            book.append(file=outcome["file"], **{"pass": turn}, status=outcome["status"], samples=outcome["samples"], attempts=outcome["attempts"], error=outcome["error"], labelHash=outcome["label_hash"])
        if outcome["status"] == "FAILED":
            say(f"FAILED {outcome['file']} ({turn}): {outcome['error']}")

    keyed = chosen.withColumn("file", F.to_json(F.struct("file", "label_hash"))).drop("label_hash")
    with Governor(rate, host, lambda o: note(o | json.loads(o["file"]))) as governor:
        outcome = write_files(keyed, named, backend, rate=rate, governor=governor.address, **options)
        outcome.write.format("noop").mode("overwrite").save()
    sent = chosen.select("file").distinct().select("file", F.lit("").alias("status"), F.lit(0).cast("long").alias("samples"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    others = writing.outcomes(files, bad, sent).where("status = 'FAILED'" if counts["PAUSED"] else "status <> ''")
    for r in others.join(files.select("file", "label_hash"), "file").toLocalIterator():
        note(r.asDict())
    return counts, governor.why


def quoted(text: str) -> str:
    """A text between the quotes of a selector."""
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def read_back(backend: Backend, labels: dict[str, str], first: int, last: int) -> list[tuple[int, float]]:
    """What the backend has of exactly this label set, in milliseconds; sets with more labels don't count."""
    selector = "{" + ",".join(f'{k}="{quoted(v)}"' for k, v in sorted(labels.items())) + "}"
    for found, times, values in backend.query(f"{selector}[{last - first + 1}s]", last):
        if found == labels:
            return [*zip(times, values)]
    return []


def read_back_table(expected: DataFrame, backend: Backend) -> DataFrame:
    """(canon, ts, value, error) of the series in expected (canon, labels, ts), one query for each;
    one that fails is a row with its error."""
    ship(expected.sparkSession)
    asked = expected.groupBy("canon").agg(F.first(F.to_json("labels")).alias("labels"), F.min("ts").alias("first"), F.max("ts").alias("last"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                try:
                    rows += [(r.canon, t // 1000, v, None) for t, v in read_back(backend, json.loads(r.labels), r.first, r.last)]
                except (OSError, ValueError, KeyError) as x:
                    rows.append((r.canon, None, None, str(x) or type(x).__name__))
            yield pd.DataFrame(rows, columns=["canon", "ts", "value", "error"]).astype({"ts": "Int64"})

    return asked.mapInPandas(run, "canon string, ts bigint, value double, error string")


def preflight(backend: Backend, oldest: int, now: int, *, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """What keeps the backend from taking the history; empty if nothing does.

    One sample a minute old and one as old as the history are written and read back.
    """
    problems = []
    for name, at, value in (("recent", now - 60, 1.0), ("oldest", oldest, 2.0)):
        labels = {"__name__": "annulus_preflight", "probe": f"{name}-{now}"}
        try:
            backend.write([(labels, [at * 1000], [value])])
        except OSError as x:
            problems.append(f"the {name} sample was refused: {x}")
            continue
        for i in range(tries):
            got = read_back(backend, labels, at - 3539, at + 60)
            if got:
                break
            if i < tries - 1:
                sleep(1.0)
        if not got:
            problems.append(f"the {name} sample was taken but can't be read back")
        elif got != [(at * 1000, value)]:
            problems.append(f"the {name} sample came back changed: {got}")
        elif not backend.series('{__name__="annulus_preflight"}', at - 60, at + 60):
            problems.append(f"the {name} sample's series isn't listed")
    return problems


def stream_to(backend: Backend, labels: DataFrame, **options) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes micro-batches of (file, ds, ts, value); its tasks share the rate evenly."""

    def write(batch: DataFrame, _: int) -> None:
        bad = write_files(batch, labels, backend, **options).where("status <> 'DONE'").limit(1).collect()
        if bad:
            raise OSError(f"{bad[0].file}: {bad[0].error}")

    return write


def live_index(series: DataFrame) -> DataFrame:
    """(canon, labels) of backend series, canonical."""
    return series.select(canonical(F.col("labels")).alias("canon"), "labels")
