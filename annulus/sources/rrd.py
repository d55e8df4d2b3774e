"""Round-robin archive files as tables.

Files are recognised by content.  Those of version 0003, little-endian with 8-byte words, and
those of the second kind, big-endian with blank-padded texts of 20 characters, are decoded
directly; XML dumps of any version are parsed.  A file that can't be read is a row with `error`,
never a failed job.
"""

from __future__ import annotations

import io
import os
import struct
import subprocess
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import is_counter
from ..shipping import ship

#: Fixed: the layout of version 0003.
MAGIC, VERSION, COOKIE = b"RRD\0", b"0003\0", 8.642135e130
HEAD, DS_DEF, RRA_DEF, LIVE_HEAD, PDP_PREP, CDP_PREP = 128, 120, 120, 16, 112, 80
#: Fixed: the layout of the second kind; every text is 20 characters of two bytes.
TEXT, SECOND_KIND = 40, "JRobin, version 0.1"
SECOND_HEAD, SECOND_DS, SECOND_RRA, SECOND_STATE = TEXT + 24, 2 * TEXT + 48, TEXT + 16, 16
NAN = float("nan")
DUMP_SECONDS = 300

SCHEMA = (
    "file string, error string, version string, step bigint, last_update bigint, "
    "sources array<struct<name:string,type:string,heartbeat:bigint,min:double,max:double,last_value:double,pdp_value:double,unknown_sec:bigint>>, "
    "archives array<struct<cf:string,pdp:bigint,xff:double,rows:array<array<double>>>>"
)


class UnsupportedLayout(ValueError):
    """A file of the right kind in a version or byte order that isn't decoded."""


@dataclass
class Source:
    name: str
    type: str
    heartbeat: int = 600
    min: float = NAN
    max: float = NAN
    last_value: float = NAN
    pdp_value: float = NAN
    unknown_sec: int = 0


@dataclass
class Archive:
    cf: str
    pdp: int
    xff: float
    rows: list[list[float]]  # oldest first, one value for each source


@dataclass
class ArchiveFile:
    version: str
    step: int
    last_update: int
    sources: list[Source] = field(default_factory=list)
    archives: list[Archive] = field(default_factory=list)


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


def number(text: str | None) -> float:
    """A number, NaN for what isn't one."""
    try:
        return NAN if text is None or "_" in text else float(text.strip())
    except ValueError:
        return NAN


def is_native(raw: bytes) -> bool:
    return raw[:4] == MAGIC


def parse(raw: bytes) -> ArchiveFile:
    """Decode a file; counts are held against its size before anything is allocated."""
    if not is_native(raw):
        raise ValueError("not a round-robin archive")
    if raw[4:9] != VERSION:
        raise UnsupportedLayout(f"version {_text(raw[4:9])!r}")
    if len(raw) < HEAD:
        raise ValueError("the file ends within its header")
    if struct.unpack_from("<d", raw, 16)[0] != COOKIE:
        raise UnsupportedLayout("other byte order or word size")
    n_ds, n_rra, step = struct.unpack_from("<qqq", raw, 24)
    if n_ds < 1 or n_rra < 1 or n_ds > len(raw) // DS_DEF or n_rra > len(raw) // RRA_DEF or step < 1:
        raise ValueError("header counts do not fit the file")
    at = HEAD
    fixed = HEAD + n_ds * (DS_DEF + PDP_PREP) + n_rra * (RRA_DEF + 8) + n_ds * n_rra * CDP_PREP + LIVE_HEAD
    if fixed > len(raw):
        raise ValueError("the file ends within its header")
    sources = []
    for _ in range(n_ds):
        heartbeat, low, high = struct.unpack_from("<qdd", raw, at + 40)
        sources.append(Source(_text(raw[at : at + 20]), _text(raw[at + 20 : at + 40]), heartbeat, low, high))
        at += DS_DEF
    shapes = []
    for _ in range(n_rra):
        rows, pdp = struct.unpack_from("<qq", raw, at + 24)
        if rows < 0 or pdp < 1 or rows > len(raw) // 8:
            raise ValueError("header counts do not fit the file")
        shapes.append((_text(raw[at : at + 20]), rows, pdp, struct.unpack_from("<d", raw, at + 40)[0]))
        at += RRA_DEF
    last_update = struct.unpack_from("<q", raw, at)[0]
    at += LIVE_HEAD
    for s in sources:
        s.last_value = number(_text(raw[at : at + 30]))
        s.unknown_sec, s.pdp_value = struct.unpack_from("<qd", raw, at + 32)
        at += PDP_PREP
    at += n_ds * n_rra * CDP_PREP
    pointers = struct.unpack_from(f"<{n_rra}q", raw, at)
    at += 8 * n_rra
    if at + 8 * n_ds * sum(rows for _, rows, _, _ in shapes) != len(raw):
        raise ValueError("the data do not end where the file does")
    archives = []
    for (cf, rows, pdp, xff), current in zip(shapes, pointers):
        ring = np.frombuffer(raw, dtype="<f8", count=rows * n_ds, offset=at).reshape(rows, n_ds)
        if rows and not 0 <= current < rows:
            raise ValueError("a row pointer lies outside its archive")
        archives.append(Archive(cf, pdp, xff, np.roll(ring, -(current + 1), axis=0).tolist() if rows else []))
        at += 8 * rows * n_ds
    return ArchiveFile("0003", step, last_update, sources, archives)


def encode(f: ArchiveFile, current: int = 0) -> bytes:
    """The inverse of parse(), with the newest row of each ring at `current`."""
    out = [struct.pack("<4s5s7xdqqq80x", MAGIC, VERSION, COOKIE, len(f.sources), len(f.archives), f.step)]
    pad = lambda s, n: s.encode("latin-1")[: n - 1].ljust(n, b"\0")
    out += [struct.pack("<20s20sqdd56x", pad(s.name, 20), pad(s.type, 20), s.heartbeat, s.min, s.max) for s in f.sources]
    out += [struct.pack("<20s4xqqd72x", pad(a.cf, 20), len(a.rows), a.pdp, a.xff) for a in f.archives]
    out.append(struct.pack("<qq", f.last_update, 0))
    for s in f.sources:
        last = "U" if np.isnan(s.last_value) else repr(s.last_value).removesuffix(".0")
        out.append(struct.pack("<30s2xqd64x", pad(last, 30), s.unknown_sec, s.pdp_value))
    out.append(bytes(CDP_PREP * len(f.sources) * len(f.archives)))
    places = [min(current, max(0, len(a.rows) - 1)) for a in f.archives]
    out.append(struct.pack(f"<{len(places)}q", *places))
    for a, place in zip(f.archives, places):
        if a.rows:
            out.append(np.roll(np.array(a.rows, dtype="<f8"), place + 1, axis=0).tobytes())
    return b"".join(out)


def is_second_kind(raw: bytes) -> bool:
    return raw[: 2 * len(SECOND_KIND)] == SECOND_KIND.encode("utf-16-be")


def parse_second(raw: bytes) -> ArchiveFile:
    """Decode a file of the second kind.

    Behind the head (signature, step, two counts, last update) stand the data sources (name, type,
    heartbeat, bounds, last reading, what came since the last step, unknown seconds), then the
    archives (function, xff, steps, rows, and for each source a state, a pointer to the oldest
    value and the ring).  Sizes are held against the file's before anything is allocated.
    """
    if not is_second_kind(raw):
        raise ValueError("not an archive of the second kind")
    if len(raw) < SECOND_HEAD:
        raise ValueError("the file ends within its header")
    text = lambda at: raw[at : at + TEXT].decode("utf-16-be").strip()
    step, n_ds, n_rra, last_update = struct.unpack_from(">qiiq", raw, TEXT)
    if n_ds < 1 or n_rra < 1 or step < 1 or SECOND_HEAD + n_ds * SECOND_DS + n_rra * SECOND_RRA > len(raw):
        raise ValueError("header counts do not fit the file")
    at, sources, archives = SECOND_HEAD, [], []
    for _ in range(n_ds):
        heartbeat, low, high, last, since, unknown = struct.unpack_from(">qddddq", raw, at + 2 * TEXT)
        if not 0 <= unknown <= max(step, heartbeat):
            raise UnsupportedLayout("a data source's unknown seconds are longer than a step")
        sources.append(Source(text(at), text(at + TEXT), heartbeat, low, high, last, since, unknown))
        at += SECOND_DS
    for _ in range(n_rra):
        if at + SECOND_RRA > len(raw):
            raise ValueError("the file ends within an archive")
        function, (xff, steps, rows) = text(at), struct.unpack_from(">dii", raw, at + TEXT)
        at += SECOND_RRA
        each = SECOND_STATE + 4 + 8 * rows
        if steps < 1 or rows < 0 or at + n_ds * each > len(raw):
            raise ValueError("the file ends within an archive")
        columns = []
        for _ in range(n_ds):
            (oldest,) = struct.unpack_from(">i", raw, at + SECOND_STATE)
            if rows and not 0 <= oldest < rows:
                raise ValueError("a row pointer lies outside its archive")
            columns.append(np.roll(np.frombuffer(raw, dtype=">f8", count=rows, offset=at + SECOND_STATE + 4), -oldest))
            at += each
        archives.append(Archive(function, steps, xff, np.stack(columns, axis=1).tolist()))
    if at != len(raw):
        raise ValueError("the data do not end where the file does")
    return ArchiveFile(text(0), step, last_update, sources, archives)


def encode_second(f: ArchiveFile, oldest: int = 0) -> bytes:
    """The inverse of parse_second(), with the oldest value of each ring at `oldest`."""
    text = lambda s: s[:20].ljust(20).encode("utf-16-be")
    out = [text(SECOND_KIND) + struct.pack(">qiiq", f.step, len(f.sources), len(f.archives), f.last_update)]
    out += [text(s.name) + text(s.type) + struct.pack(">qddddq", s.heartbeat, s.min, s.max, s.last_value, s.pdp_value, s.unknown_sec) for s in f.sources]
    for a in f.archives:
        out.append(text(a.cf) + struct.pack(">dii", a.xff, a.pdp, len(a.rows)))
        for i in range(len(f.sources)):
            at = oldest % max(1, len(a.rows))
            out.append(struct.pack(">dqi", NAN, 0, at) + np.roll(np.array([r[i] for r in a.rows], dtype=">f8"), at).tobytes())
    return b"".join(out)


def parse_dump(raw: bytes) -> ArchiveFile:
    """An XML dump; entity and type declarations are refused, numbers that are none become NaN."""
    if b"<!ENTITY" in raw[:4096] or b"<!DOCTYPE" in raw[:4096] and b"[" in raw[:4096].split(b"<!DOCTYPE", 1)[1].split(b">", 1)[0]:
        raise ValueError("declarations are not read")
    f, row, path = ArchiveFile("", 0, 0), [], []
    for event, e in ElementTree.iterparse(io.BytesIO(raw), events=("start", "end")):
        if event == "start":
            path.append(e.tag)
            if path == ["rrd", "ds"]:
                f.sources.append(Source("", ""))
            elif path == ["rrd", "rra"]:
                f.archives.append(Archive("", 1, NAN, []))
            continue
        text, where = (e.text or "").strip(), "/".join(path[1:])
        path.pop()
        if where in ("version", "step", "lastupdate"):
            setattr(f, {"lastupdate": "last_update"}.get(where, where), text if where == "version" else int(number(text)))
        elif where.startswith("ds/"):
            name = {"minimal_heartbeat": "heartbeat", "last_ds": "last_value", "value": "pdp_value"}.get(e.tag, e.tag)
            if name in ("name", "type"):
                setattr(f.sources[-1], name, text)
            elif name in ("heartbeat", "unknown_sec"):
                setattr(f.sources[-1], name, int(number(text)))
            elif name in ("min", "max", "last_value", "pdp_value"):
                setattr(f.sources[-1], name, number(text))
        elif where == "rra/cf":
            f.archives[-1].cf = text
        elif where == "rra/pdp_per_row":
            f.archives[-1].pdp = int(number(text))
        elif where == "rra/params/xff":
            f.archives[-1].xff = number(text)
        elif where == "rra/database/row/v":
            row.append(number(text))
        elif where == "rra/database/row":
            f.archives[-1].rows.append(row)
            row = []
            e.clear()
    if not f.step or not f.sources:
        raise ValueError("not a dump of an archive")
    return f


def dump(path: str, binary: str) -> bytes:
    """An XML dump by an external program, opt-in; one that takes longer than DUMP_SECONDS is an error."""
    done = subprocess.run([binary, "dump", path], capture_output=True, timeout=DUMP_SECONDS)
    if done.returncode:
        raise OSError(f"dump failed with {done.returncode}: {done.stderr[:2048].decode('utf-8', 'replace')}")
    return done.stdout


def open_archive(raw: bytes, path: str = "", mode: str = "native", binary: str | None = None) -> ArchiveFile:
    """Decode by content; mode `dump` always asks the external program, `native` only for what it can't decode."""
    if mode == "native" or not is_native(raw):
        if raw.lstrip()[:5] in (b"<?xml", b"<rrd>", b"<!DOC"):
            return parse_dump(raw)
        if is_second_kind(raw):
            return parse_second(raw)
        try:
            return parse(raw)
        except UnsupportedLayout:
            if not binary:
                raise
    if not binary:
        raise ValueError("mode `dump` needs the option `binary`")
    return parse_dump(dump(path, binary))


def _record(path: str, raw: bytes, mode: str, binary: str | None) -> dict:
    try:
        f = open_archive(raw, path, mode, binary)
        return {"file": path, "error": None, "version": f.version, "step": f.step, "last_update": f.last_update, "sources": [asdict(s) for s in f.sources], "archives": [asdict(a) for a in f.archives]}
    except Exception as x:  # noqa: BLE001  any damage is that file's own
        return dict.fromkeys(("version", "step", "last_update", "sources", "archives")) | {"file": path, "error": f"{type(x).__name__}: {x}"}


def arrow_schema() -> pa.Schema:
    source = pa.struct([("name", pa.string()), ("type", pa.string()), ("heartbeat", pa.int64()), *((n, pa.float64()) for n in ("min", "max", "last_value", "pdp_value")), ("unknown_sec", pa.int64())])
    archive = pa.struct([("cf", pa.string()), ("pdp", pa.int64()), ("xff", pa.float64()), ("rows", pa.list_(pa.list_(pa.float64())))])
    return pa.schema([("file", pa.string()), ("error", pa.string()), ("version", pa.string()), ("step", pa.int64()), ("last_update", pa.int64()), ("sources", pa.list_(source)), ("archives", pa.list_(archive))])


def read_files(spark: SparkSession, path: str | list[str], *, pattern: str = "*.{rrd,jrb,xml}", mode: str = "native", binary: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """SCHEMA rows of all files below a path, or of the files of a list, that Spark's own readers
    can open; of `only` (path, without a scheme) no others are decoded."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    if only is not None:
        files = files.join(only.distinct().withColumnRenamed("path", "__path"), F.regexp_replace("path", "^[a-z0-9]+:/*", "/") == F.col("__path"), "left_semi")

    return decoded(files, mode=mode, binary=binary)


def decoded(files: DataFrame, *, mode: str = "native", binary: str | None = None) -> DataFrame:
    """SCHEMA rows of a table (path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_pylist([_record(p, raw.as_py(), mode, binary)], schema=arrow_schema())

    return files.select("path", "content").mapInArrow(run, SCHEMA)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class RrdDataSource(DataSource):
    """spark.read.format("rrd").load(path) over folders that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "rrd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.mode = options["path"], options.get("mode", "native")
        self.binary, self.size = options.get("binary"), int(options.get("filesPerPartition", "64"))

    def partitions(self) -> list[InputPartition]:
        found = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(top, n) for top, _, names in os.walk(self.path, followlinks=True) for n in names if n.endswith((".rrd", ".jrb", ".xml")))
        return [_Files(found[i : i + self.size]) for i in range(0, len(found), self.size)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with open(path, "rb") as f:
                record = _record(path, f.read(), self.mode, self.binary)
            yield pa.RecordBatch.from_pylist([record], schema=arrow_schema())


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RrdDataSource)


def tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archives, rows, sources) for the kernel, from SCHEMA rows without an error."""
    good = files.where("error IS NULL")
    each = good.select("file", "step", "last_update", F.col("sources.name").alias("names"), F.posexplode("archives").alias("rra", "a"))
    archives = each.select("file", "rra", F.col("a.cf").alias("cf"), F.col("a.pdp").alias("pdp"), F.size("a.rows").cast("long").alias("n"), "step", "last_update")
    rows = each.select("file", "rra", "names", F.posexplode("a.rows").alias("row", "vs")).select("file", "rra", F.col("row").cast("long").alias("row"), F.explode(F.arrays_zip("names", "vs")).alias("x"))
    rows = rows.select("file", "rra", "row", F.col("x.names").alias("ds"), F.col("x.vs").alias("value"))
    sources = good.select("file", F.explode("sources").alias("s")).select("file", F.col("s.name").alias("ds"), F.col("s.type").alias("type"), is_counter(F.col("s.type")).alias("counter"), F.col("s.last_value").alias("last_value"), F.col("s.pdp_value").alias("pdp_value"))
    return archives, rows, sources
