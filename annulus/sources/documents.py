"""Small files around a migration: label sets, plans, state logs and tag configuration."""

from __future__ import annotations

import json
import os
import threading
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SCOPES
from .repository import properties

STATE = "file string, pass string, status string, samples bigint, attempts int, error string, labelHash string"
PLAN_ENTRY = (
    "file string, resource string, ds string, mtype string, class string, labels map<string,string>, samples bigint, "
    "note string, sources map<string,string>, candidates array<map<string,string>>, unresolved array<string>, at int"
)


def label_sets(spark: SparkSession, path: str) -> DataFrame:
    """(labels): a JSON array of string maps.

    A file with whole maps on its lines, as write_label_sets() writes it, and one of JSON lines
    are read in parts by many tasks; one whose maps span lines is read whole.
    """
    line = F.regexp_replace(F.trim("value"), r"^\[?\s*(.*?)\s*,?\s*\]?$", "$1")
    held = F.from_json(F.concat(F.lit("["), "line", F.lit("]")), "array<map<string,string>>")
    lines = spark.read.text(path).select(line.alias("line")).where("line <> ''").select(held.alias("held"))
    if not lines.where("held IS NULL").limit(1).count():
        return lines.select(F.explode("held").alias("labels"))
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("labels"))


def write_label_sets(index: DataFrame, path: str) -> None:
    """One sorted JSON array, as label_sets() reads it; a snapshot of series, written by the driver."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(index.orderBy("resource_id", "metric", "canon").select("labels").toLocalIterator()):
            out.write(("," if i else "") + "\n" + json.dumps(row.labels, sort_keys=True, ensure_ascii=False))
        out.write("\n]\n")


@dataclass
class Snapshot:
    """What is noted beside a label file."""

    snapshot_sec: int
    cutover_sec: int
    backend_url: str
    config_hash: str | None = None
    expected_keys: list[str] | None = None

    @staticmethod
    def path(labels: str) -> str:
        return labels.removesuffix(".json") + ".meta.json"

    def save(self, labels: str) -> None:
        with open(self.path(labels), "w", encoding="utf-8") as out:
            json.dump(asdict(self), out, indent=2)

    @classmethod
    def load(cls, labels: str) -> Snapshot | None:
        if not os.path.exists(cls.path(labels)):
            return None
        with open(cls.path(labels), encoding="utf-8") as f:
            known = {k: v for k, v in json.load(f).items() if k in cls.__dataclass_fields__}
        return cls(**known)


def read_plan(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, entries) of a plan folder; fields that an older plan lacks are null."""
    header = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/header.json").collect()))
    return header, spark.read.schema(PLAN_ENTRY).json(f"{path}/entries")


def write_plan(header: dict, entries: DataFrame, path: str) -> None:
    """Entries as distributed JSON lines, the header beside them."""
    wanted = [x.split()[0] for x in PLAN_ENTRY.replace("map<string,string>", "m").replace("array<m>", "a").split(", ")]
    entries.select(*wanted).write.mode("overwrite").json(f"{path}/entries")
    spark = entries.sparkSession
    spark.range(1).select(F.lit(json.dumps(header, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/header.json")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """State lines with their places (`line`, which sorts as the lines do); torn, null and foreign
    lines are left out.

    The log is one file, read in parts: a place is the part's begin and the row within it.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(place.alias("line"), "value")
    parsed = lines.select("line", F.from_json("value", STATE, {"mode": "PERMISSIVE"}).alias("s")).select("line", "s.*")
    return parsed.where("file IS NOT NULL AND pass IS NOT NULL AND status IS NOT NULL").withColumnRenamed("labelHash", "label_hash")


class StateLog:
    """Append-only JSON lines, synced one by one, also from several threads; a torn last line is closed first."""

    def __init__(self, path: str) -> None:
        self.path, self.lock = path, threading.Lock()

    def append(self, **entry: object) -> None:
        with self.lock, open(self.path, "ab+") as out:
            if out.tell():
                out.seek(-1, os.SEEK_END)
                if out.read(1) != b"\n":
                    out.write(b"\n")
            out.write(json.dumps(entry, ensure_ascii=False).encode() + b"\n")
            out.flush()
            os.fsync(out.fileno())


@dataclass(frozen=True)
class ConfigKeys:
    """Where a home keeps its tag configuration: the name of the main file below etc (any
    *.properties if empty), the prefix of tags, and the keys of the switches."""

    file: str = ""
    tags: str = "metatags."
    categories: str = "metatags.exposeCategories"
    prefer_descr: str = "metatags.preferIfDescr"
    keep_names: str = "metatags.dontSanitizeIfName"


@dataclass
class TagConfig:
    tags: dict[str, str]
    expose_categories: bool = False
    prefer_descr: bool = False
    keep_names: bool = False

    @classmethod
    def load(cls, home: str, keys: ConfigKeys = ConfigKeys()) -> TagConfig:  # noqa: B008
        """From the main file(s) below etc, then *.properties of their .d folders by name; later
        files win, a missing etc is empty."""
        if not os.path.isdir(home):
            raise NotADirectoryError(home)
        etc, found = os.path.join(home, "etc"), {}
        here = sorted(os.listdir(etc)) if os.path.isdir(etc) else []
        main = [n for n in here if (n == keys.file if keys.file else n.endswith(".properties")) and os.path.isfile(os.path.join(etc, n))]
        folders = [n for n in here if (n == keys.file + ".d" if keys.file else n.endswith(".properties.d")) and os.path.isdir(os.path.join(etc, n))]
        extra = [os.path.join(d, n) for d in folders for n in sorted(os.listdir(os.path.join(etc, d))) if n.endswith(".properties")]
        for path in main + extra:
            with open(os.path.join(etc, path), "rb") as f:
                found |= properties(f.read())
        said = lambda k: found.get(k, "").lower() == "true"
        switches = (keys.categories, keys.prefer_descr, keys.keep_names)
        tags = {k.removeprefix(keys.tags): v for k, v in found.items() if k.startswith(keys.tags) and k not in switches}
        return cls(dict(sorted(tags.items())), *map(said, switches))

    def table(self, spark: SparkSession) -> DataFrame:
        """(tag, expression, scope)"""
        from ..functions.scalars import scope_of

        rows = spark.createDataFrame(list(self.tags.items()), "tag string, expression string")
        return rows.withColumn("scope", scope_of(F.col("expression")))


assert SCOPES[0] == "CONSTANT"
