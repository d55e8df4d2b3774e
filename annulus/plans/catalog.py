"""Registered queries: every operator that tables can express, on the given tables.

Event types stand for archive files (hourly steps, three resolutions), orders and line items
for files and states, customers, nations and regions for resources, nodes and labels.  Values
are summed as whole hundredths so that results don't depend on the order of a sum.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import kernel, labels, verify, writing
from ..shipping import ship
from ..sources import inventory, repository, rrd
from ..streaming import remote_write

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STEP = 3600
RRAS = "VALUES (0, 'AVERAGE', 1, 168), (1, 'AVERAGE', 6, 120), (2, 'AVERAGE', 24, 30), (3, 'MAX', 24, 30), (4, 'MAX', 1, 168), (5, 'AVERAGE', 6, 60)"
LIVE = "concat('snmp/', n_regionkey, '/', n_name, '/', c_custkey)"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.col("event_type").alias("file"), S.epoch_seconds("ts").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def _archives(spark: SparkSession, d: str) -> DataFrame:
    rras = spark.sql(f"SELECT rra, cf, CAST(pdp AS BIGINT) pdp, CAST(n AS BIGINT) n FROM {RRAS} AS r(rra, cf, pdp, n)")
    last = _samples(spark, d).groupBy("file").agg(F.max("ts").alias("last_update"))
    return last.crossJoin(F.broadcast(rras)).withColumn("step", F.lit(STEP).cast("long"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """The archives' rows: hourly, six-hourly and daily means, NULL where there are no events."""
    archives = _archives(spark, d)
    grid = archives.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row"))
    grid = grid.withColumn("end", kernel.row_end(F.col("last_update"), F.col("step"), F.col("pdp"), F.col("n"), F.col("row")))
    samples = _samples(spark, d)
    means = [kernel.consolidate(samples, STEP * p).select("file", "end", "avg_value", "max_value", F.lit(p).cast("long").alias("pdp")) for p in (1, 6, 24)]
    joined = grid.join(means[0].unionByName(means[1]).unionByName(means[2]), ["file", "pdp", "end"], "left")
    value = F.when(F.col("cf") == "MAX", F.col("max_value")).otherwise(F.col("avg_value"))
    return joined.select("file", "rra", "row", F.lit("value").alias("ds"), value.alias("value"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    samples = _samples(spark, d)
    last = samples.groupBy("file").agg(F.max("ts").alias("last_update"))
    pending = F.sum(F.when(F.col("ts") >= F.floor(F.col("last_update") / STEP) * STEP, F.col("cents")).otherwise(0)) / 100
    both = samples.join(last, "file").groupBy("file").agg((F.sum("cents") / 100).alias("last_value"), pending.alias("pdp_value"))
    return both.select("file", F.lit("value").alias("ds"), F.lit(True).alias("counter"), "last_value", "pdp_value")


@query
def counter_history(spark, d):
    # and a file whose rows are all unknown, with a known reading
    archives, rows, sources = _archives(spark, d), _rows(spark, d), _sources(spark, d)
    archives = archives.unionByName(spark.sql(f"SELECT 'silent' AS file, 0 AS rra, 'AVERAGE' AS cf, 1L AS pdp, 3L AS n, {STEP}L AS step, 1700000100L AS last_update").select(archives.columns))
    rows = rows.unionByName(spark.range(3).select(F.lit("silent").alias("file"), F.lit(0).alias("rra"), F.col("id").alias("row"), F.lit("value").alias("ds"), F.lit(None).cast("double").alias("value")))
    sources = sources.unionByName(spark.sql("SELECT 'silent' AS file, 'value' AS ds, true AS counter, 42D AS last_value, 1D AS pdp_value"))
    points = kernel.history(archives, rows, sources)
    return points.select("file", "ts", F.round("value", 3).alias("value"), "pass")


@query
def gauge_history(spark, d):
    sources = _sources(spark, d).withColumn("counter", F.lit(False))
    points = kernel.history(_archives(spark, d), _rows(spark, d), sources)
    return points.select("file", "ts", "value", "pass")


@query
def archive_consolidate(spark, d):
    out = kernel.consolidate(_samples(spark, d), 6 * STEP)
    return out.select("file", "end", "avg_value", "min_value", "max_value", "n")


@query
def archive_select_finest(spark, d):
    return kernel.select_archives(_archives(spark, d)).select("file", "rra", "pdp", "n")


@query
def stitch_intervals(spark, d):
    out = kernel.stitch(_archives(spark, d), _rows(spark, d))
    return out.select("file", "end", "span", "value", "partial")


@query
def archive_round_trip(spark, d):
    """The archives' rows written as files of both binary kinds, read and laid out as tables again."""
    ship(spark)
    shapes = _archives(spark, d).select("file", "rra", "cf", "pdp", "last_update")
    rows = _rows(spark, d).groupBy("file", "rra").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("rows"))
    each = shapes.join(rows, ["file", "rra"]).groupBy("file", "last_update").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rra", "cf", "pdp", F.transform("rows", lambda r: F.coalesce(r["value"], F.lit(float("nan")))).alias("rows"))))).alias("archives"))

    def write(parts):
        for part in parts:
            made = []
            for r in part.itertuples():
                rings = [rrd.Archive(a["cf"], a["pdp"], 0.5, [[float(v)] for v in a["rows"]]) for a in json.loads(r.archives)]
                f = rrd.ArchiveFile("0003", STEP, r.last_update, [rrd.Source("value", "GAUGE")], rings)
                made.append((r.file, rrd.encode_second(f, 5) if r.file < "l" else rrd.encode(f, 5)))
            yield pd.DataFrame(made, columns=["path", "content"])

    files = each.mapInPandas(write, "path string, content binary")
    held = rrd.tables(rrd.decoded(files))[1]
    return held.select("file", "rra", "row", F.when(kernel.known(F.col("value")), F.col("value")).alias("value"))


@query
def pass_split(spark, d):
    samples = _samples(spark, d)
    last = samples.groupBy("file").agg(F.max("ts").alias("last_update"))
    return kernel.with_pass(samples, last).groupBy("file", "pass").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query
def oldest_row_time(spark, d):
    return kernel.oldest_row_time(_archives(spark, d))


@query
def cutover(spark, d):
    return kernel.cutover(_archives(spark, d))


@query
def wrap_aware_delta(spark, d):
    own = Window.partitionBy("file").orderBy("ts", "event_id")
    total = F.sum(F.col("cents") * 100_000).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = _samples(spark, d).withColumn("reading", F.pmod(total, F.lit(4294967295)))
    return counted.select("file", "event_id", kernel.wrapped_delta(F.col("reading"), F.lag("reading").over(own)).alias("delta"))


@query
def ring_unroll(spark, d):
    own = Window.partitionBy("file").orderBy("ts", "event_id")
    slots = _samples(spark, d).withColumn("slot", F.row_number().over(own) - 1)  # of ring slot div 24
    return slots.select("file", "slot", kernel.ring_row(F.col("slot") % 24, F.lit(7), F.lit(24)).alias("row"), "cents")


@query
def series_assembly(spark, d):
    points = _samples(spark, d).groupBy("file", "ts").agg(F.max("cents").alias("value")).withColumn("ds", F.lit("value"))
    out = kernel.to_series(points)
    return out.select("file", F.size("ts_ms").alias("n"), F.get("ts_ms", F.lit(0)).alias("first_ms"), F.sha2(F.concat_ws(",", F.transform("value", lambda x: x.cast("string"))), 256).alias("values_sha256"))


def _label_sets(spark, d):
    joined = _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    segment, resource = F.col("c_mktsegment"), F.expr(LIVE)
    made = F.create_map(F.lit("resourceId"), resource, F.lit("__name__"), F.lit("acctbal"), F.lit("segment"), segment, F.lit("node"), F.col("n_name"), F.lit("mtype"), F.when(F.col("c_custkey") % 10 == 0, "count").otherwise("gauge"))
    return joined.select("c_custkey", "n_name", "n_regionkey", resource.alias("resource"), made.alias("labels"))


@query
def label_index_distinct(spark, d):
    sets = _label_sets(spark, d)
    index = labels.label_index(sets.unionByName(sets.where("c_custkey % 3 = 0")).select("labels"))
    return index.select("resource_id", "metric", F.sha2("canon", 256).alias("canon_sha256"))


@query
def label_index_counts(spark, d):
    sets = _label_sets(spark, d)
    out = labels.index_counts(labels.label_index(sets.unionByName(sets).select("labels")))
    return out


def _order_entries(spark, d):
    """Orders as entries: data source `value`; every line item of an order is a label set."""
    orders = _t(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "ABSOLUTE").when(F.col("o_orderstatus") == "F", "COUNTER").otherwise("GAUGE")
    resource = F.concat(F.lit("snmp/"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"))
    error = F.when(F.col("o_orderkey") % 97 == 0, "cannot read")
    return orders.select(F.concat(resource, F.lit("/value")).alias("file"), resource.alias("resource"), F.lit("value").alias("ds"), kind.alias("ds_type"), error.alias("error"), "o_orderkey", S.epoch_seconds("o_orderdate").alias("last_update"))


def _line_sets(spark, d, flag):
    lines = _t(spark, d, "lineitem").where(F.col("l_returnflag") == flag).join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    resource = F.concat(F.lit("snmp/"), F.col("o_custkey"), F.lit("/"), F.col("l_orderkey"))
    mtype = F.when(F.col("l_linestatus") == "F", "count").otherwise("gauge")
    sets = F.create_map(F.lit("resourceId"), resource, F.lit("__name__"), F.lit("value"), F.lit("mtype"), mtype, F.lit("supplier"), F.col("l_suppkey").cast("string"))
    return labels.label_index(lines.select(sets.alias("labels")))


def _classified(spark, d):
    entries = _order_entries(spark, d)
    return labels.classify(labels.match(entries, _line_sets(spark, d, "R"), _line_sets(spark, d, "A")))


@query
def series_match_classify(spark, d):
    matched = labels.classify(labels.match(_order_entries(spark, d), _line_sets(spark, d, "R")))
    return matched.select("o_orderkey", "n_live", "class", F.size(F.coalesce("candidates", F.array().cast("array<string>"))).alias("n_candidates"))


@query
def fallback_lookup(spark, d):
    return _classified(spark, d).select("o_orderkey", "n_live", "n_exported", "class", F.element_at("labels", F.lit("supplier")).alias("supplier"))


@query
def mtype_mismatch(spark, d):
    out = _classified(spark, d).where("class = 'MTYPE_MISMATCH'")
    return out.select("o_orderkey", "mtype", F.col("labels").isNull().alias("dropped"))


def _orphans(spark, d):
    """Customers as orphans of their nation's node, last written at their last order."""
    last = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max(S.epoch_seconds("o_orderdate")).alias("last_update"))
    sets = _label_sets(spark, d).join(last, F.col("c_custkey") == F.col("o_custkey"))
    return sets.select("c_custkey", F.col("resource").alias("file"), "resource", F.lit("acctbal").alias("ds"), F.lit("gauge").alias("mtype"), "last_update", F.lit(86_400).cast("long").alias("step"), "n_name", "n_regionkey")


@query
def orphan_pending(spark, d):
    orphans = _orphans(spark, d)
    top = labels.effective_cutover(orphans, None)
    minimal = labels.minimal_labels(F.col("resource"), F.col("ds"), F.col("mtype"))
    unresolved = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("site"))).otherwise(F.array().cast("array<string>"))
    asked = orphans.select("*", minimal.alias("labels"), unresolved.alias("unresolved"), (F.col("c_custkey") % 7 == 0).alias("gone"), (F.col("c_custkey") % 11 == 0).alias("scheduled"))
    out = labels.classify_orphans(asked, cutover=top, skip_partial=True)
    return out.select("c_custkey", "class", "note", F.col("labels").isNotNull().alias("written"))


@query
def sibling_agreement(spark, d):
    known = labels.sibling_values(labels.label_index(_label_sets(spark, d).select("labels")))
    state = labels.agreement(F.col("siblings"), F.col("having"), F.col("distinct_values"))
    return known.where("level <> 'resource'").select("level", "place", "label", "siblings", "distinct_values", state.alias("state"), "value")


@query
def scoped_level_fallback(spark, d):
    live = labels.label_index(_label_sets(spark, d).where("c_custkey % 2 = 0").select("labels"))
    tags = spark.sql("SELECT * FROM VALUES ('node', 'NODE'), ('segment', 'INTERFACE'), ('segment2', 'METADATA'), ('mtype', 'SERVICE') AS t(tag, scope)")
    orphans = _orphans(spark, d).where("c_custkey % 2 = 1")
    return labels.lookup(orphans, tags, live).join(orphans.select("file", "ds", "c_custkey"), ["file", "ds"]).select("c_custkey", "tag", "state", "value")


@query
def category_agreement(spark, d):
    sets = _label_sets(spark, d).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("categories"), F.when(F.col("n_regionkey") < 2, F.lit("core")).otherwise(F.element_at("labels", F.lit("segment"))))))
    out = labels.category_agreement(labels.label_index(sets.select("labels")), "directory")
    return out.select("place", S.canonical(F.col("categories")).alias("categories"))


@query
def category_resolution(spark, d):
    """Siblings' categories, else those of the node: some have names that are one label, some none."""
    cats = F.create_map(F.lit("categories"), F.when(F.col("n_regionkey") < 2, F.lit("core")).otherwise(F.element_at("labels", F.lit("segment"))))
    live = labels.label_index(_label_sets(spark, d).where("c_custkey % 2 = 0").select(F.map_concat("labels", cats).alias("labels")))
    orphans = _orphans(spark, d).where("c_custkey % 2 = 1")
    names = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("a b"), F.col("n_name"), F.lit("a-b"))).otherwise(F.array().cast("array<string>"))
    nodes = orphans.where("c_custkey % 3 < 2").select("file", "ds", names.alias("names"), F.col("c_custkey").alias("node_id"))
    out = labels.resolve_categories(orphans, live, nodes).join(orphans.select("file", "ds", "c_custkey"), ["file", "ds"])
    return out.select("c_custkey", F.when(F.col("categories").isNotNull(), S.canonical(F.col("categories"))).alias("categories"), "category_source")


@query
def tag_resolution(spark, d):
    live = labels.label_index(_label_sets(spark, d).where("c_custkey % 2 = 0").select("labels"))
    tags = spark.sql("SELECT * FROM VALUES ('site', 'lab', 'CONSTANT'), ('node', '${node:label}', 'NODE'), ('segment', '${interface:x}', 'INTERFACE'), ('rack', '${asset:rack}', 'NODE'), ('a.x', 'two', 'CONSTANT'), ('a-x', 'one', 'CONSTANT') AS t(tag, expression, scope)")
    orphans = _orphans(spark, d).where("c_custkey % 2 = 1")
    out = labels.resolve(orphans, tags, live).join(orphans.select("file", "ds", "c_custkey"), ["file", "ds"])
    return out.select("c_custkey", S.canonical(F.col("labels")).alias("labels"), F.array_join("unresolved", ",").alias("unresolved"))


@query
def node_route(spark, d):
    customers = _t(spark, d, "customer")
    part = F.pmod(F.col("c_custkey"), F.lit(4))
    resource = F.when(part == 0, F.concat(F.lit("snmp/"), F.col("c_nationkey"))).when(part == 1, F.concat(F.lit("snmp/fs/fs/"), F.col("c_nationkey"))).when(part == 2, F.concat(F.lit("response/10.0.0."), F.col("c_nationkey"))).otherwise(F.concat(F.lit("snmp/alias"), F.col("c_nationkey")))
    nation = _t(spark, d, "nation")
    nodes = nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.lit("fs").alias("foreign_source"), F.col("n_nationkey").cast("string").alias("foreign_id"))
    addresses = nation.select(F.concat(F.lit("10.0.0."), F.col("n_nationkey") % 20).alias("ip"), F.col("n_nationkey").alias("node_id"))
    return labels.route_nodes(customers.select(resource.alias("resource")), nodes, addresses)


@query
def scheduled_semi(spark, d):
    customers = _t(spark, d, "customer")
    resources = customers.select(F.concat(F.lit("snmp/"), F.col("c_nationkey"), F.lit("/if_"), F.col("c_custkey") % 50, F.lit("/x")).alias("resource"), F.col("c_nationkey").alias("node_id"))
    interfaces = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("node_id"), F.concat(F.lit("if-"), F.col("s_suppkey") % 50).alias("if_name"), F.lit("").alias("if_descr"), F.lit("").alias("phys_addr"), (F.col("s_suppkey") % 3 != 0).alias("collect"))
    return labels.scheduled(resources, interfaces)


def _walked(spark, d):
    """First and second lines of orders as the .rrd and .jrb file of a base; two of three orders name theirs."""
    place, ext = F.concat(F.lit("snmp/"), F.col("l_orderkey") % 10), F.when(F.col("l_linenumber") == 1, "rrd").otherwise("jrb")
    lines = _t(spark, d, "lineitem").where("l_linenumber <= 2").groupBy(place.alias("dir"), F.concat(F.lit("g"), "l_orderkey").alias("base"), ext.alias("ext")).agg(F.max(S.epoch_seconds("l_shipdate")).cast("double").alias("mtime"))
    listing = lines.withColumn("name", F.concat_ws(".", "base", "ext")).withColumn("path", F.concat_ws("/", "dir", "name"))
    by_group, key = F.col("o_orderstatus") != "P", F.col("o_orderkey")
    groups = _t(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.concat(F.lit("snmp/"), key % 10).alias("dir"), F.concat(F.lit("g"), key).alias("base"), F.concat(F.when(by_group, "g").otherwise("m"), key).alias("grp"), by_group.alias("by_group"))
    return repository.resolve(listing, groups, spark.createDataFrame([], repository.SKIPPED))


@query
def missing_anti(spark, d):
    return _walked(spark, d)[1].where("reason LIKE 'no file%'")


@query
def stray_files(spark, d):
    return _walked(spark, d)[1].where("reason = 'no group information'")


@query
def duplicate_pick(spark, d):
    items, skipped = _walked(spark, d)
    return items.select("file", "resource", "grp", F.lit(None).cast("string").alias("reason")).unionByName(skipped.where("reason LIKE 'older%'"), allowMissingColumns=True)


@query
def label_hash(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.concat(F.lit("ds"), F.col("l_linenumber")).alias("ds"), F.create_map(F.lit("supplier"), F.col("l_suppkey").cast("string"), F.lit("part"), F.col("l_partkey").cast("string")).alias("labels"))
    return labels.label_hash(lines)


def _tags(spark, d):
    return _t(spark, d, "nation").select(F.lower("n_name").alias("tag"), F.concat(F.lit("${node:label}-"), F.col("n_regionkey")).alias("expression"))


@query
def config_hash(spark, d):
    return labels.config_hash(_tags(spark, d), True)


@query
def expected_keys(spark, d):
    return labels.expected_keys(_tags(spark, d), True)


@query
def sanitize_names(spark, d):
    pages = _t(spark, d, "pages")
    return pages.select("page_id", S.metric_name(F.col("url")).alias("metric"), S.label_name(F.col("url")).alias("label"), S.metric_name(F.col("page_id").cast("string")).alias("numbered"))


@query
def truncate_label_value(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(S.label_value(F.col("text")), 256).alias("value_sha256"), F.length(S.label_value(F.col("text"))).alias("n"))


@query
def resource_paths(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", F.lit("snmp/")), r"\?.*$", "")
    pages = _t(spark, d, "pages").withColumn("resource", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("snmp/fs/a/"), path)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("snmp/"), F.col("page_id"), F.lit("/"), path)).otherwise(path))
    return pages.select("page_id", S.node_prefix(F.col("resource")).alias("node"), S.dir_of(F.col("resource")).alias("dir"), S.is_aliased(F.col("resource")).alias("aliased"))


@query
def tag_scopes(spark, d):
    forms = ("plain", "${node:label}", "${asset:x|interface:y}", "${requisition:a}", "${service:n}-${node:l}", "${resource:label}", "${nothing}", "${node:open")
    every = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(forms)))
    nations = _t(spark, d, "nation").select("n_nationkey", "n_name", F.explode(every).alias("f")).select("n_nationkey", "n_name", "f.i", "f.e")
    return nations.select("n_nationkey", "i", S.scope_of(F.concat(F.col("n_name"), F.lit(" "), F.col("e"))).alias("scope"))


@query
def node_expressions(spark, d):
    joined = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    node = {"id": F.col("c_custkey"), "label": F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name")), "location": F.col("n_name"), "foreign_source": F.when(F.col("c_custkey") % 2 == 0, F.lit("fs")), "foreign_id": F.col("c_custkey").cast("string"), "assets": F.create_map(F.lit("buildingName"), F.col("c_mktsegment"))}
    return joined.select("c_custkey", *(S.node_expression(e, node).alias(n) for n, e in (("label", "${node:label|node:location|none}"), ("criteria", "id ${node:criteria}"), ("asset", "${asset:building-name}!"), ("unknown", "${interface:x}"), ("literal", "${node:foreign-source|standby}"))))


@query
def interface_labels(spark, d):
    parts = _t(spark, d, "part")
    last, part = (F.col("p_partkey") % 90 + 10).cast("string"), F.col("p_partkey") % 5
    mac = F.when(part == 0, F.concat(F.lit("00:11:22:33:44:"), last)).when(part == 1, F.concat(F.lit("0011223344"), last)).when(part == 2, F.concat(F.lit("/0011223344"), last, F.lit("-"))).when(part == 3, F.concat(F.lit("0011.223.44"), F.substring(last, 1, 1))).otherwise("n/a")
    return parts.select("p_partkey", S.interface_label(F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name")), F.col("p_type"), mac).alias("by_name"), S.interface_label(F.col("p_name"), F.col("p_type"), mac, prefer_descr=True, sanitize=False).alias("by_descr"))


@query
def selectors(spark, d):
    hard = F.concat(F.col("url"), F.lit('"\\'), F.lit("\n(*)[x]{1}^$|+?"))
    pages = _t(spark, d, "pages")
    return pages.select("page_id", S.promql_quote(hard).alias("quoted"), S.regex_escape(hard).alias("escaped"), S.exact_selector(F.create_map(F.lit("url"), hard, F.lit("a"), F.col("page_id").cast("string"))).alias("exact"), S.prefix_selector(hard).alias("prefix"))


@query
def prefix_match(spark, d):
    pages = _t(spark, d, "pages").withColumn("prefix", S.dir_of(F.col("url")))
    prefixes = pages.select("prefix").distinct()
    found = pages.select("page_id", "url", F.explode(F.array("prefix", S.dir_of(F.col("prefix")))).alias("prefix")).join(prefixes, "prefix")
    return found.where(S.has_prefix(F.col("url"), F.col("prefix"))).groupBy("prefix").agg(F.count_distinct("page_id").alias("n"))


@query
def html_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha2(S.html_escape(F.col("html")), 256).alias("html_sha256"))


@query
def backoff_schedule(spark, d):
    tries = spark.range(1, 21).withColumnRenamed("id", "attempt")
    return tries.select("attempt", S.backoff_seconds(F.col("attempt")).cast("long").alias("seconds"), S.is_retryable(F.lit(420) + F.col("attempt")).alias("retryable"))


@query
def lenient_double(spark, d):
    words = _t(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array(F.get(F.split("text", " "), 0), F.concat(F.col("conv_id"), F.lit(".5e1")), F.lit("1_0"))).alias("w"))
    value = S.lenient_double(F.col("w"))
    return words.select("conv_id", "turn", "w", F.when(~F.isnan(value), value).alias("value"))


@query
def json_props(spark, d):
    parsed = F.from_json("props", "map<string,string>")
    return _t(spark, d, "events").select("event_id", F.element_at(parsed, F.lit("k")).alias("k"), F.size(F.map_filter(parsed, lambda k, v: v.isNotNull() & (v != ""))).alias("n"))


@query
def node_json(spark, d):
    """An inventory's answers, made of customers: empty and null fields, an object and a number among the assets."""
    customers = _t(spark, d, "customer")
    answer = F.concat(
        F.lit('{"id":"'), "c_custkey", F.lit('","label":"'), "c_name", F.lit('","foreignSource":null,"x":[1],"categories":[{"name":"a"},{"name":"'), "c_mktsegment", F.lit('"}],"assetRecord":{"building-name":"'), "c_mktsegment",
        F.lit('","rack":"","floor":null,"geo":{"x":1},"unit-no-x":'), "c_custkey", F.lit("}}"),
    )
    node = inventory.node_columns(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit('{"id":'), "c_custkey", F.lit("}"))).otherwise(answer))
    return customers.select("c_custkey", node["id"].alias("id"), node["label"].alias("label"), node["foreign_source"].alias("foreign_source"), F.array_join(node["categories"], ",").alias("categories"), S.canonical(node["assets"]).alias("assets"))


def _states(spark, d):
    """Line items as the lines of a state log: of file, pass, status, attempts and hash."""
    lines = _t(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    log = lines.select(F.col("l_orderkey").alias("file"), F.row_number().over(order).alias("line"), F.when(F.col("l_linestatus") == "F", "RECENT").otherwise("OLDER").alias("pass"), F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("DONE").alias("status"), F.col("l_quantity").cast("long").alias("samples"), (F.col("l_partkey") % 3 + 1).cast("int").alias("attempts"), F.when(F.col("l_suppkey") % 4 > 0, (F.col("l_suppkey") % 2).cast("string")).alias("label_hash"))
    return writing.last_states(log)


def _files(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 2).cast("string").alias("label_hash"))


@query
def checkpoint_last_wins(spark, d):
    return _states(spark, d).select("file", "pass", "line", "status", "samples", "attempts", "label_hash")


@query
def resume_filter(spark, d):
    return writing.todo(_files(spark, d), _states(spark, d).where("pass = 'RECENT'"))


@query
def resume_failed(spark, d):
    return writing.todo(_files(spark, d), _states(spark, d).where("pass = 'RECENT'"), retry_failed=True)


@query
def batch_slices(spark, d):
    samples = _samples(spark, d).withColumn("ds", F.lit("value"))
    own = samples.groupBy("file", "ds", "ts").agg(F.max("cents").alias("value"))
    return writing.chunks(own, 200).groupBy("file", "chunk").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query
def remote_write_round_trip(spark, d):
    """Every series as a write request, compressed, and read from its bytes again."""
    ship(spark)
    points = _samples(spark, d).groupBy("file", "ts").agg(F.max("cents").cast("double").alias("value")).withColumn("ds", F.lit("value"))
    series = kernel.to_series(points)

    def send(parts):
        for part in parts:
            for r in part.itertuples():
                body = remote_write.packed([({"file": r.file, "__name__": r.ds}, [int(t) for t in r.ts_ms], [float(v) for v in r.value])])
                for labels_, times, values in remote_write.unpacked(body):
                    yield pd.DataFrame({"file": labels_["file"], "ts_ms": times, "cents": values})

    return series.mapInPandas(send, "file string, ts_ms bigint, cents double")


@query
def batch_packing(spark, d):
    samples = _samples(spark, d).withColumn("ds", F.concat(F.lit("d"), F.col("event_id") % 3))
    return writing.batches(samples.groupBy("file", "ds", "ts").agg(F.max("cents").alias("value")), 200)


@query
def plan_order(spark, d):
    """The order of a plan: what the walk left out, matched entries, orphans; numbered within customers."""
    entries = _classified(spark, d).withColumn("at", F.lit(0))
    left_out = _t(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("snmp/"), "o_custkey", F.lit("/stray"), "o_orderkey").alias("file"), F.lit("SKIPPED").alias("class"), "o_custkey")
    every = entries.select("file", "resource", "class", "at", F.get(F.split("file", "/"), 1).cast("long").alias("o_custkey")).unionByName(left_out, allowMissingColumns=True)
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("section", "file", F.col("at").asc_nulls_first()))
    return labels.order_entries(every).withColumn("section", labels.section()).select("file", "section", turn.alias("turn"))


def _processed(spark, d):
    """(todo, planned, read): orders as files, of which some are gone, unreadable or lack a planned data source."""
    planned = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.concat(F.lit("ds"), "l_linenumber").alias("ds"), F.create_map(F.lit("part"), F.col("l_partkey").cast("string")).alias("labels"))
    key = F.col("o_orderkey")
    names = F.transform(F.sequence(F.lit(1), F.when(key % 5 == 0, 2).otherwise(7)), lambda i: F.concat(F.lit("ds"), i))
    read = _t(spark, d, "orders").where("o_orderkey % 89 <> 0").select(key.alias("file"), F.when(key % 97 == 0, "cannot read").alias("error"), F.when(key % 97 != 0, names).alias("names"))
    return writing.todo(_files(spark, d), _states(spark, d).where("pass = 'RECENT'")), planned, read


@query
def process_outcome(spark, d):
    todo, planned, read = _processed(spark, d)
    bad = writing.unwritable(todo, planned, read)
    sent = todo.where("file % 2 = 0").join(bad, "file", "left_anti").select("file", F.lit("DONE").alias("status"), F.lit(5).cast("long").alias("samples"), F.lit(2).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return writing.outcomes(todo, bad, sent)


@query
def rewrite_count(spark, d):
    todo = writing.todo(_files(spark, d), _states(spark, d).where("pass = 'RECENT'"))
    return spark.range(1).select(F.lit(writing.rewritten(todo)).cast("long").alias("n"))


@query
def file_order(spark, d):
    entries = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.when(F.col("l_returnflag") == "N", "ORPHAN_COMPLETE").otherwise("MATCHED").alias("class"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return writing.file_order(entries)


@query
def canary_sample(spark, d):
    return writing.drawn(_t(spark, d, "customer"), F.col("c_custkey"), 5, 17, "c_mktsegment").select("c_mktsegment", "c_custkey")


@query
def label_drift(spark, d):
    """Customers as entries of three classes, of which some have other labels by now, or no live series."""
    kind = F.when(F.col("c_custkey") % 3 == 0, "MATCHED").when(F.col("c_custkey") % 3 == 1, "PENDING").otherwise("ORPHAN_COMPLETE")
    sets = _label_sets(spark, d).select("c_custkey", F.col("resource").alias("file"), "resource", F.lit("acctbal").alias("ds"), kind.alias("class"), "labels")
    now = sets.where("c_custkey % 7 <> 0").select(F.when(F.col("c_custkey") % 5 == 0, F.map_concat("labels", F.create_map(F.lit("new"), F.lit("1")))).otherwise(F.col("labels")).alias("labels"))
    return writing.label_drift(sets, labels.label_index(now), canary=50, seed=1)


@query
def live_after_cutover(spark, d):
    samples = _samples(spark, d).select(F.concat(F.col("file"), F.col("event_id") % 50).alias("canon"), (F.col("ts") * 1000).alias("ts_ms"))
    top = samples.agg(F.max("ts_ms").alias("m")).first()[0]
    return writing.live_after(samples, top // 1000 - 7200).select("canon")


@query
def completeness(spark, d):
    return verify.not_done(_files(spark, d), _states(spark, d))


@query
def not_migrated_counts(spark, d):
    return verify.not_migrated(_classified(spark, d))


def _expected(spark, d):
    own = _samples(spark, d).groupBy("file", "ts").agg(F.max("cents").alias("cents"))
    return own.select(F.col("file").alias("canon"), (F.col("file") < "m").alias("counter"), "ts", "cents", (F.col("cents") / 100).alias("value"))


@query
def verify_compare(spark, d):
    expected = _expected(spark, d)
    got = expected.where("ts % 11 <> 0").select("canon", "ts", (F.when(F.col("ts") % 7 == 0, F.col("cents") + 1).otherwise(F.col("cents")) / 100).alias("value"))
    return verify.compare(expected.drop("cents"), got, 1e-3)


@query
def verify_read_errors(spark, d):
    """Files and series that can't be read are mismatches too."""
    files = verify.unread_files(_files(spark, d), _processed(spark, d)[2])
    expected, refused = _expected(spark, d), F.col("canon") >= "s"
    got = expected.select("canon", F.when(~refused, F.col("ts")).alias("ts"), F.when(~refused, F.col("value")).alias("value"), F.when(refused, "HTTP 500").alias("error"))
    series = verify.compare(expected.drop("cents"), got, 0.0)
    return files.select(F.col("file").cast("string").alias("what"), "kind").unionByName(series.select(F.col("canon").alias("what"), "kind"))


@query
def verify_counter_delta(spark, d):
    own = Window.partitionBy("canon").orderBy("ts")
    grown = _expected(spark, d).withColumn("total", F.sum("cents").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    expected = grown.select("canon", F.lit(True).alias("counter"), "ts", F.col("total").cast("double").alias("value"))
    got = grown.select("canon", "ts", (F.col("total") + 5000 + F.when(F.col("ts") % 13 == 0, 100_000).otherwise(0)).cast("double").alias("value"))
    return verify.compare(expected, got, 1e-9)


@query
def verify_select(spark, d):
    return verify.selection(_files(spark, d).select("file"), _states(spark, d), percent=1.0, seed=1)


@query
def class_summary(spark, d):
    return verify.class_summary(_classified(spark, d))


@query
def root_counts(spark, d):
    entries = _classified(spark, d).select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "response").otherwise("snmp"), F.substring("resource", 5, 100)).alias("resource"))
    return verify.root_counts(entries)


@query
def label_coverage(spark, d):
    return verify.label_coverage(_classified(spark, d), ["MATCHED", "EXPORTED"])


@query
def unresolved_by_node(spark, d):
    part = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("rack"), F.lit("site"))).otherwise(F.array(F.lit("site")))
    entries = _orphans(spark, d).select("resource", F.when(F.col("c_custkey") % 5 < 3, "ORPHAN_PARTIAL").otherwise("MATCHED").alias("class"), part.alias("unresolved"))
    return verify.unresolved_by_node(entries).select("node", "n", F.array_join("tags", ",").alias("tags"))


@query
def capped_list(spark, d):
    rows, total = verify.capped(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_custkey"), F.col("o_orderkey")])
    return rows.withColumn("total", F.lit(total).cast("long"))


@query
def eta_estimate(spark, d):
    counts = _samples(spark, d).groupBy("file").agg((F.count("*") * 1000).alias("n_samples"), F.min("ts").alias("oldest"))
    return verify.plan_summary(counts.withColumn("labels", F.create_map(F.lit("a"), F.lit("b"))), 500.0)


@query
def not_migrated_list(spark, d):
    return verify.not_migrated_list(_classified(spark, d))


@query
def orphan_resources(spark, d):
    return verify.orphan_resources(_classified(spark, d))


@query
def explain_resource(spark, d):
    sets = _label_sets(spark, d).withColumn("ds", F.lit("acctbal")).withColumn("class", F.lit("MATCHED")).withColumn("note", F.lit("live"))
    sets = sets.withColumn("sources", F.transform_values("labels", lambda k, v: F.lit("live")))
    first = sets.agg(F.min("resource")).first()[0]
    return verify.explain(sets, first)


@query
def iso_instants(spark, d):
    return _samples(spark, d).select("event_id", S.iso_instant(F.col("ts")).alias("instant"))


@query
def colliding_names(spark, d):
    pages = _t(spark, d, "pages").select(F.lit("snmp/1/x").alias("resource"), F.concat(F.lit("p"), F.when(F.col("page_id") % 2 == 0, ".").otherwise("-"), F.expr("page_id div 2")).alias("ds"))
    return labels.colliding_names(pages.distinct()).select("ds")
