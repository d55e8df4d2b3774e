"""The file tree: which archives exist, for which resources, and what is left out and why.

Walking is the driver's part (one listing of names and times); property files are read by tasks,
and deciding is a table operation.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

ROOTS = ("snmp", "response")
EXTENSIONS = ("rrd", "jrb")
LISTING = "dir string, name string, base string, ext string, mtime double, path string"
GROUPS = "dir string, base string, grp string, by_group boolean"
SKIPPED = "file string, reason string"


def properties(raw: bytes) -> dict[str, str]:
    """A Java properties file: Latin-1, escapes, continued lines, = or : or blanks between key and value."""
    lines, out, held = raw.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n").split("\n"), {}, ""
    for line in lines:
        line = line.lstrip(" \t\f")
        if not held and (not line or line[0] in "#!"):
            continue
        held += line
        if (len(held) - len(held.rstrip("\\"))) % 2:
            held = held[:-1]
            continue
        key, value = _halves(held)
        out[key], held = value, ""
    if held:
        key, value = _halves(held)
        out[key] = value
    return out


def _halves(line: str) -> tuple[str, str]:
    i = 0
    while i < len(line) and line[i] not in "=: \t\f":
        i += 2 if line[i] == "\\" else 1
    rest = line[i:].lstrip(" \t\f")
    return _unescaped(line[:i]), _unescaped(rest[1:].lstrip(" \t\f") if rest[:1] in ("=", ":") else rest)


def _unescaped(text: str) -> str:
    out, i, names = [], 0, {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
    while i < len(text):
        if text[i] != "\\":
            out.append(text[i])
            i += 1
        elif text[i + 1 : i + 2] == "u":
            out.append(chr(int(text[i + 2 : i + 6], 16)))
            i += 6
        else:
            out.append(names.get(text[i + 1 : i + 2], text[i + 1 : i + 2]))
            i += 2
    return "".join(out)


def listed(top: str) -> Iterator[tuple[str, str, str]]:
    """(kind, path, problem) of all files below the roots; links are followed, loops reported."""

    def walk(path: str, above: tuple) -> Iterator[tuple[str, str, str]]:
        try:
            here = os.stat(path)
            if (here.st_dev, here.st_ino) in above:
                yield "skipped", path, "cannot read: a link leads back to it"
                return
            for name in sorted(os.listdir(path)):
                full = os.path.join(path, name)
                if os.path.isdir(full):
                    yield from walk(full, (*above, (here.st_dev, here.st_ino)))
                elif os.path.exists(full):
                    yield "file", full, ""
                else:
                    yield "skipped", full, "cannot read: a broken link"
        except OSError as x:
            yield "skipped", path, f"cannot read: {x.strerror}"

    for root in ROOTS:
        if os.path.isdir(os.path.join(top, root)):
            yield from walk(os.path.join(top, root), ())


def _named(top: str, paths: list[str]) -> Iterator[tuple[str | None, str | None, str | None, bool, str | None, str | None]]:
    """(dir, base, grp, by_group, file, problem): what property files name, or why one can't be read."""
    for path in paths:
        folder, name = os.path.split(path)
        rel = os.path.relpath(folder, top)
        try:
            with open(path, "rb") as f:
                held = properties(f.read())
        except (OSError, ValueError) as x:
            yield None, None, None, False, os.path.relpath(path, top), f"cannot read: {getattr(x, 'strerror', None) or x}"
            continue
        if name == "ds.properties":
            yield from ((rel, g, g, True, None, None) for g in sorted(set(held.values())))
        elif "GROUP" in held:
            yield rel, name.removesuffix(".meta"), held["GROUP"], False, None, None


def scan(spark: SparkSession, top: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listing, groups, skipped): archive files, the file bases that each folder's properties name
    with their groups, and problems.  A folder with ds.properties names groups, any other one
    metrics, by its .meta files."""
    ship(spark)
    found = list(listed(top))
    stored_by_group = {os.path.dirname(path) for kind, path, _ in found if kind == "file" and os.path.basename(path) == "ds.properties"}
    files, named, skipped = [], [], []
    for kind, path, problem in found:
        folder, name = os.path.split(path)
        base, _, ext = name.rpartition(".")
        if kind == "skipped":
            skipped.append((os.path.relpath(path, top), problem))
        elif ext in EXTENSIONS:
            files.append((os.path.relpath(folder, top), name, base, ext, os.stat(path).st_mtime, os.path.relpath(path, top)))
        elif name == "ds.properties" or ext == "meta" and folder not in stored_by_group:
            named.append((path,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*_named(top, batch.column(0).to_pylist()))) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["dir", "base", "grp", "by_group", "file", "reason"])

    read = spark.createDataFrame(named, "path string").mapInArrow(run, f"{GROUPS}, {SKIPPED}")
    problems = spark.createDataFrame(skipped, SKIPPED).unionByName(read.where("reason IS NOT NULL").select("file", "reason"))
    return spark.createDataFrame(files, LISTING), read.where("reason IS NULL").select("dir", "base", "grp", "by_group"), problems


def resolve(listing: DataFrame, groups: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: file, resource, grp; skipped: file, reason), each sorted by path.

    The resource is the folder and the group.  Of two files of one base the newer counts, .rrd
    on a tie.  A named base without a file, and a file that nothing names, are reported.
    """
    order = Window.partitionBy("dir", "base").orderBy(F.desc("mtime"), F.desc(F.col("ext") == "rrd"))
    named = groups.select(F.col("dir").alias("d"), F.col("base").alias("b"), "grp", "by_group").distinct()
    same = (F.col("dir") == F.col("d")) & (F.col("base") == F.col("b"))
    ranked = listing.join(named, same, "left_semi").withColumn("turn", F.row_number().over(order)).withColumn("winner", F.first("name").over(order))
    items = ranked.where("turn = 1").join(named, same).select(F.col("path").alias("file"), F.concat_ws("/", "dir", "grp").alias("resource"), "grp")
    older = ranked.where("turn > 1").select(F.col("path").alias("file"), F.concat(F.lit("older duplicate of "), "winner").alias("reason"))
    missing = named.join(listing, same, "left_anti").select(F.concat_ws("/", "d", "b").alias("file"), F.when(F.col("by_group"), "no file for this group").otherwise("no file for this metric").alias("reason"))
    stray = listing.join(named, same, "left_anti").select(F.col("path").alias("file"), F.lit("no group information").alias("reason"))
    return items.orderBy("file"), skipped.unionByName(older).unionByName(missing).unionByName(stray).orderBy("file")


def node_prefixes(items: DataFrame) -> DataFrame:
    """Distinct node prefixes of the walked resources: one backend query each."""
    from ..functions.scalars import node_prefix

    return items.select(node_prefix(F.col("resource")).alias("node")).distinct()
