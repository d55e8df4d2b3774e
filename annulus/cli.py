"""The command line: preflight, snapshot-labels, plan, backfill, verify, explain.

Exit codes: 0 done, 1 something is wrong or left, 2 paused (backfill), 64 wrong usage.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shipping
from .functions import scalars as S
from .operators import kernel, labels, report, verify, writing
from .sources import documents, inventory, repository, rrd
from .streaming import remote_write as rw

DAY = 86_400


class Usage(Exception):
    pass


def session() -> SparkSession:
    spark = SparkSession.builder.appName("annulus").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    shipping.ship(spark)
    return spark


#: So many files are opened by name; for more the folder is listed.
NAMED_FILES = 10_000


def archives(spark: SparkSession, a: argparse.Namespace, only: DataFrame | None = None) -> DataFrame:
    """Archive files as read, with their relative paths; of `only` (file) no others are opened.

    Up to NAMED_FILES are named to the reader; beyond, it lists the folder and the others' rows
    are left out before they are decoded.
    """
    top, path = os.path.abspath(a.rrd_dir).rstrip("/") + "/", a.rrd_dir
    names = [r.file for r in only.select("file").distinct().limit(NAMED_FILES + 1).collect()] if only is not None else []
    if only is not None and len(names) <= NAMED_FILES:
        path = [p for p in (os.path.join(top, n) for n in names) if os.path.exists(p)]
        if not path:
            return spark.createDataFrame([], rrd.SCHEMA)
    files = rrd.read_files(spark, path, mode=a.reader, binary=a.dump_binary, only=only.select(F.concat(F.lit(top), "file").alias("path")) if isinstance(path, str) and only is not None else None)
    return files.withColumn("file", F.expr(f"substring(regexp_replace(file, '^file:/*', '/'), {len(top) + 1})"))


def config_of(a: argparse.Namespace) -> documents.TagConfig | None:
    keys = documents.ConfigKeys(a.config_file, a.tag_prefix, a.categories_key, a.prefer_descr_key, a.keep_names_key)
    return documents.TagConfig.load(a.home, keys) if a.home else None


def load(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, skipped, files) of a repository."""
    return *repository.resolve(*repository.scan(spark, a.rrd_dir)), archives(spark, a)


def entries_of(items: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each data source of each item, with its sample count and oldest sample."""
    shapes, rows, sources = rrd.tables(files)
    points = kernel.history(shapes, rows, sources.where(S.is_supported(F.col("type"))))
    counts = points.groupBy("file", "ds").agg(F.count("*").alias("n_samples"), F.min("ts").alias("oldest"))
    each = files.select("file", "error", "step", "last_update", F.posexplode_outer("sources").alias("at", "s"))
    each = each.select("file", "error", "step", "last_update", "at", F.col("s.name").alias("ds"), F.col("s.type").alias("ds_type"))
    gone = F.when(F.col("found").isNull(), "no such file").otherwise(F.col("error"))  # since the walk
    entries = items.join(each.withColumn("found", F.lit(True)), "file", "left").withColumn("error", gone).drop("found")
    return entries.join(counts, ["file", "ds"], "left").na.fill(0, ["n_samples"])


def plan(spark: SparkSession, a: argparse.Namespace) -> int:
    with holding() as hold:
        return _plan(spark, a, hold)


def _plan(spark: SparkSession, a: argparse.Namespace, hold: Callable[[DataFrame], DataFrame]) -> int:
    config = config_of(a)
    snapshot = documents.Snapshot.load(a.labels)
    if config and snapshot and snapshot.config_hash:
        now = labels.config_hash(config.table(spark), config.expose_categories).first()[0]
        if now != snapshot.config_hash:
            print("the tag configuration has changed since the snapshot", file=sys.stderr)
            return 1
    items, skipped, files = load(spark, a)
    entries = hold(entries_of(items, files))
    live = hold(labels.label_index(documents.label_sets(spark, a.labels)))
    exported = labels.label_index(documents.label_sets(spark, a.exported)) if a.exported else None
    done = labels.classify(labels.match(entries, live, exported)).withColumn("unresolved", F.array().cast("array<string>"))
    done = done.withColumn("sources", F.when(F.col("labels").isNotNull(), F.transform_values("labels", lambda k, v: F.when(F.col("class") == "MATCHED", "live").otherwise("export"))))
    orphans = done.where("class = 'ORPHAN'")
    cutover = labels.effective_cutover(entries, snapshot.cutover_sec if snapshot else None)
    nodes = routes = scheduled = None
    if a.inventory_url and not a.no_rest:
        password = open(a.inventory_password_file, encoding="utf-8").read().strip() if a.inventory_password_file else os.environ.get("ANNULUS_INVENTORY_PASSWORD", "")
        if not password:
            print("the inventory needs a password", file=sys.stderr)
            return 1
        source = inventory.Inventory(a.inventory_url, a.inventory_user, password)
        source.ping()
        asked = [r[0] for r in orphans.select(labels.node_criteria(F.col("resource")).alias("c")).where("c IS NOT NULL").distinct().collect()]
        nodes, interfaces, addresses = inventory.load(spark, source, asked)
        routes = labels.route_nodes(orphans.select("resource"), nodes, addresses)
        placed = orphans.select("resource").distinct().join(routes.where("state = 'HIT'"), "resource")
        prefer = config.prefer_descr if config else False
        scheduled = labels.scheduled(placed, interfaces, prefer_descr=prefer, sanitize=not (config and config.keep_names)).withColumn("scheduled", F.lit(True))
    resolved = _resolved(orphans, config, live, routes, nodes, spark)
    if config and config.expose_categories:
        hits = None
        if routes is not None:
            hits = orphans.select("file", "ds", "resource").join(routes.where("state = 'HIT'"), "resource").join(nodes.select("id", F.col("categories").alias("names")), F.col("node_id") == F.col("id"))
        resolved = labels.with_categories(resolved, labels.resolve_categories(orphans, live, hits))
    joined = orphans.drop("labels", "sources", "unresolved").join(resolved, ["file", "ds"])
    joined = joined.join(scheduled, "resource", "left") if scheduled is not None else joined.withColumn("scheduled", F.lit(False))
    # a node is only asked for, and so found to be gone, where siblings leave something open
    joined = joined.join(routes.select("resource", (F.col("state") == "GONE").alias("away")), "resource", "left").withColumn("gone", F.col("away") & F.col("needs_node")) if routes is not None else joined.withColumn("gone", F.lit(False))
    judged = labels.classify_orphans(joined, cutover=cutover, pending=not a.no_pending, skip_orphans=a.skip_orphans, skip_partial=a.skip_partial)
    names = ["file", "resource", "ds", "mtype", "class", "labels", "n_samples", "oldest", "note", "sources", "unresolved", "at"]
    every = done.where("class <> 'ORPHAN'").select(*names, "candidates").unionByName(judged.select(*names, F.lit(None).cast("array<string>").alias("candidates")))
    left_out = skipped.select("file", F.lit("SKIPPED").alias("class"), F.col("reason").alias("note"), F.lit(0).cast("long").alias("n_samples"), F.array().cast("array<string>").alias("unresolved"))
    every = hold(every.unionByName(left_out, allowMissingColumns=True))
    out = every.withColumn("samples", F.col("n_samples")).withColumn("candidates", F.transform("candidates", lambda c: F.create_map(F.lit("labels"), c)))
    hashed = labels.config_hash(config.table(spark), config.expose_categories).first()[0] if config else None
    header = {"rrd_dir": a.rrd_dir, "created": int(time.time()), "cutover": cutover, "config_hash": hashed, "snapshot": snapshot.snapshot_sec if snapshot else None}
    documents.write_plan(header, labels.order_entries(out), a.out)
    _lines(a.orphans, verify.orphan_resources(every))
    _lines(a.not_migrated, verify.not_migrated_list(every), "class\tresource\tds\tnote")
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(report.page(every, config.table(spark) if config else None, {"cutover": cutover}, a.rate))
    for row in [*verify.class_summary(every).orderBy("class").collect(), *verify.root_counts(every).collect(), verify.plan_summary(every, a.rate).first()]:
        print(*(f"{k}={v}" for k, v in row.asDict().items()))
    return 0


def _resolved(orphans: DataFrame, config, live: DataFrame, routes, nodes, spark: SparkSession) -> DataFrame:
    """(file, ds, labels, sources, unresolved) of orphans; minimal ones without a configuration."""
    if config is None or not config.tags:
        base = labels.minimal_labels(F.col("resource"), F.col("ds"), F.col("mtype"))
        note = F.array(F.lit("no tag configuration")) if config is None else F.array().cast("array<string>")
        return orphans.select("file", "ds", base.alias("labels"), F.transform_values(base, lambda k, v: F.lit("minimal")).alias("sources"), note.alias("unresolved"), F.lit(False).alias("needs_node"))
    values = None
    if routes is not None:
        row = {"id": F.col("id"), "label": F.col("label"), "location": F.col("location"), "foreign_source": F.col("foreign_source"), "foreign_id": F.col("foreign_id"), "assets": F.col("assets")}
        hits = orphans.select("file", "ds", "resource").join(routes.where("state = 'HIT'"), "resource").join(nodes, F.col("node_id") == F.col("id"))
        each = F.array(*(F.struct(F.lit(t).alias("tag"), S.node_expression(e, row).alias("value")) for t, e in config.tags.items()))
        values = hits.select("file", "ds", "node_id", F.explode(each).alias("v")).select("file", "ds", "node_id", "v.tag", "v.value")
    return labels.resolve(orphans, config.table(spark), live, values)


def _lines(path: str, rows: DataFrame, head: str | None = None) -> None:
    with open(path, "w", encoding="utf-8") as out:
        if head:
            out.write(head + "\n")
        for r in rows.toLocalIterator():
            out.write("\t".join("" if x is None else str(x) for x in r) + "\n")


@contextmanager
def holding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that keeps tables on disk, until the end: what is read later is read anew."""
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.DISK_ONLY))
        return held[-1]

    try:
        yield hold
    finally:
        for df in reversed(held):
            df.unpersist(blocking=True)


def _history(spark: SparkSession, header: dict, a: argparse.Namespace, only: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(history, read) of some files (file), opened and decoded once; read: file, error, names of
    the data sources that can be written."""
    a.rrd_dir = header["rrd_dir"]
    files = hold(archives(spark, a, only))
    shapes, rows, sources = rrd.tables(files)
    points = hold(kernel.history(shapes, rows, sources.where(S.is_supported(F.col("type")))))
    supported = F.filter("sources", lambda s: S.is_supported(s["type"]))
    return points, files.select("file", "error", F.transform(supported, lambda s: s["name"]).alias("names"))


def _states(spark: SparkSession, path: str):
    empty = spark.createDataFrame([], "line struct<block:bigint,row:bigint>, file string, pass string, status string, samples bigint, attempts int, error string, label_hash string")
    return lambda: writing.last_states(documents.read_states(spark, path)) if os.path.exists(path) else empty


def backfill(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.threads < 1 or a.batch_samples < 1 or a.max_retries < 0 or a.rate < 0 or a.canary < 0:
        raise Usage("counts must be positive")
    header, entries = documents.read_plan(spark, a.plan)
    if header.get("config_hash") and not a.skip_config_check:
        if not a.home:
            raise Usage("--home is needed to check the tag configuration, or --skip-config-check")
        config = config_of(a)
        if labels.config_hash(config.table(spark), config.expose_categories).first()[0] != header["config_hash"]:
            print("the tag configuration has changed since the plan", file=sys.stderr)
            return 1
    backend, state = rw.Backend(a.write_url, a.read_url, a.org_id), os.path.join(a.state_dir, "state.jsonl")

    def guard(turn: str) -> None:
        if not (a.read_url and a.canary):
            return
        drawn = entries.where("class = 'PENDING' OR labels IS NOT NULL AND (class = 'MATCHED' OR class LIKE 'ORPHAN%')")
        chosen = writing.drawn(drawn, F.concat_ws("/", "file", "ds"), a.canary, 1, "class").select("class", "resource", "ds", S.label_value(F.col("resource")).alias("r"), S.metric_name(F.col("ds")).alias("m")).collect()
        now, cutover, found = int(time.time()), header.get("cutover") or 0, []
        since = header["snapshot"] - DAY if header.get("snapshot") else now - 7 * DAY
        for r in chosen:
            # a migration writes nothing after the cutover, so orphans that have something there are live
            start = cutover + 1 if r["class"].startswith("ORPHAN") and cutover else since
            selector = "{" + ",".join(f'{k}="{rw.quoted(v)}"' for k, v in (("__name__", r.m), ("resourceId", r.r))) + "}"
            found += [(x,) for x in backend.series(selector, start, now + 1)]
        live = labels.label_index(spark.createDataFrame(found, "labels map<string,string>"))
        drift = writing.label_drift(entries, live, canary=a.canary, seed=1).collect()
        if any(r.kind == "stop" for r in drift):
            raise RuntimeError(f"live labels differ from the plan before pass {turn}; make a new plan")
        if drift:
            print(f"{len(drift)} pending series are live now; make a new plan after this one", file=sys.stderr)

    options = {"rate": a.rate, "threads": a.threads, "batch_samples": a.batch_samples, "retries": a.max_retries}
    with holding() as hold:
        history, read = _history(spark, header, a, entries.where("labels IS NOT NULL"), hold)
        said = rw.backfill(history, entries, backend, state, _states(spark, state), read=read, guard=guard, retry_failed=a.retry_failed, say=lambda x: print(x, file=sys.stderr), **options)
    left = verify.not_done(labels.label_hash(entries), _states(spark, state)()).count()
    print(f"{said}: {left} files are left")
    return 2 if said == "PAUSED" else int(left > 0)


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    if not 0 < a.sample <= 100 or a.tolerance < 0:
        raise Usage("--sample is a percentage, --tolerance positive")
    header, entries = documents.read_plan(spark, a.plan)
    states, hashes = _states(spark, os.path.join(a.state_dir, "state.jsonl"))(), labels.label_hash(entries)
    left = verify.not_done(hashes, states)
    files = verify.selection(hashes.select("file"), states, percent=a.sample, seed=a.seed, every=a.all)
    with holding() as hold:
        files = hold(files)
        chosen = entries.where("labels IS NOT NULL").join(files, "file", "left_semi")
        history, read = _history(spark, header, a, files, hold)
        points = history.join(chosen.select("file", "ds", "labels"), ["file", "ds"])
        expected = points.select(S.canonical(F.col("labels")).alias("canon"), "labels", "counter", "ts", "value")
        back = hold(rw.read_back_table(expected, rw.Backend(None, a.read_url, a.org_id)))
        wrong = verify.compare(expected.drop("labels"), back, a.tolerance)
        unread, undone, mismatches = verify.unread_files(files, read).orderBy("file").limit(20).collect(), left.limit(20).collect(), wrong.orderBy("canon", "ts").limit(20).collect()
    for r in undone:
        print("not done:", r.file)
    for r in verify.not_migrated(entries).orderBy("class").collect():
        print("not migrated by plan:", r["class"], r.n)
    for r in unread:
        print(r.kind, r.file)
    for r in mismatches:
        print(r.kind, r.canon, r.ts)
    return int(bool(undone or unread or mismatches))


def snapshot(spark: SparkSession, a: argparse.Namespace) -> int:
    items, _, files = load(spark, a)
    now, cutover = int(time.time()), kernel.cutover(files.where("error IS NULL").select("last_update")).first()[0]
    backend = rw.Backend(None, a.read_url, a.org_id)
    start = max(now - a.since_days * DAY, cutover + 1)
    sets = []
    for (node,) in repository.node_prefixes(items).orderBy("node").collect():
        escaped = "".join("\\\\" + c if c in "\\.+*?()|[]{}^$" else c for c in node)
        sets += [(x,) for x in backend.series('{resourceId=~"' + escaped.replace('"', '\\"') + '/.+"}', start, now + 1)]
    index = labels.label_index(spark.createDataFrame(sets, "labels map<string,string>"))
    documents.write_label_sets(index, a.out)
    config = config_of(a)
    hashed = labels.config_hash(config.table(spark), config.expose_categories).first()[0] if config else None
    keys = [r[0] for r in labels.expected_keys(config.table(spark), config.expose_categories).collect()] if config else None
    documents.Snapshot(now, cutover, a.read_url, hashed, keys).save(a.out)
    return 0


def probe(spark: SparkSession, a: argparse.Namespace) -> int:
    oldest = a.oldest_epoch
    if oldest is None:
        if not a.rrd_dir:
            raise Usage("--rrd-dir or --oldest-epoch is needed")
        oldest = kernel.oldest_row_time(rrd.tables(load(spark, a)[2])[0]).agg(F.min("oldest")).first()[0]
    problems = rw.preflight(rw.Backend(a.write_url, a.read_url, a.org_id), oldest, int(time.time()))
    print("\n".join(problems) or "the backend takes the history")
    return int(bool(problems))


def why(spark: SparkSession, a: argparse.Namespace) -> int:
    _, entries = documents.read_plan(spark, a.plan)
    rows = verify.explain(entries, a.resource, a.ds).collect()
    for r in rows:
        print(r.ds, r["class"], r.label, r.value, r.source, r.note or "", sep="\t")
    return int(not rows)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="annulus", description=__doc__)
    verbs = top.add_subparsers(dest="verb")
    read = argparse.ArgumentParser(add_help=False)
    read.add_argument("--reader", choices=("native", "dump"), default="native")
    read.add_argument("--dump-binary")
    link = argparse.ArgumentParser(add_help=False)
    for name in ("--write-url", "--read-url", "--org-id"):
        link.add_argument(name)

    home = argparse.ArgumentParser(add_help=False)
    home.add_argument("--home")
    for name, default in (("--config-file", "file"), ("--tag-prefix", "tags"), ("--categories-key", "categories"), ("--prefer-descr-key", "prefer_descr"), ("--keep-names-key", "keep_names")):
        home.add_argument(name, default=getattr(documents.ConfigKeys(), default))

    def verb(name: str, run, *parents) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, parents=list(parents))
        p.set_defaults(run=run)
        return p

    p = verb("preflight", probe, link, read)
    p.add_argument("--rrd-dir")
    p.add_argument("--oldest-epoch", type=int)
    p = verb("snapshot-labels", snapshot, link, read, home)
    p.add_argument("--rrd-dir", required=True)
    p.add_argument("--since-days", type=int, default=7)
    p.add_argument("--out", default="labels.json")
    p = verb("plan", plan, read, home)
    for name in ("--rrd-dir", "--labels"):
        p.add_argument(name, required=True)
    for name in ("--exported", "--report", "--inventory-url", "--inventory-password-file"):
        p.add_argument(name)
    p.add_argument("--inventory-user", default="admin")
    for name in ("--no-rest", "--skip-orphans", "--skip-partial", "--no-pending"):
        p.add_argument(name, action="store_true")
    p.add_argument("--rate", type=float, default=20_000)
    for name, default in (("--out", "plan"), ("--orphans", "orphans.txt"), ("--not-migrated", "not-migrated.txt")):
        p.add_argument(name, default=default)
    p = verb("backfill", backfill, link, read, home)
    p.add_argument("--plan", required=True)
    p.add_argument("--state-dir", default=".")
    for name in ("--retry-failed", "--skip-config-check"):
        p.add_argument(name, action="store_true")
    p.add_argument("--rate", type=float, default=20_000)
    for name, default in (("--threads", 4), ("--batch-samples", 2000), ("--max-retries", 5), ("--canary", 50)):
        p.add_argument(name, type=int, default=default)
    p = verb("verify", check, link, read)
    p.add_argument("--plan", required=True)
    p.add_argument("--state-dir", default=".")
    p.add_argument("--sample", type=float, default=1.0)
    p.add_argument("--all", action="store_true")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--tolerance", type=float, default=0.0)
    p = verb("explain", why)
    p.add_argument("--plan", required=True)
    p.add_argument("--resource", required=True)
    p.add_argument("--ds")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as x:
        return 64 if x.code else 0
    if not a.verb:
        parser().print_usage()
        return 64
    try:
        return a.run(spark or session(), a)
    except Usage as x:
        print(x, file=sys.stderr)
        return 64
    except (OSError, RuntimeError, ValueError) as x:
        print(x, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
