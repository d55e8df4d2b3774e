"""Matching data sources to label sets, resolving what has no live series, and classifying.

Tables: `entries` (file, resource, ds, ds_type, last_update, step, n_samples, oldest, error),
`live` and `exported` (labels map), `tags` (tag, expression, scope), inventory tables.
Label sets compare by their canonical text.  All lookups are equi-joins on sanitized keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def label_index(sets: DataFrame) -> DataFrame:
    """(resource_id, metric, canon, labels): distinct label sets that have both keys."""
    keyed = sets.withColumn("resource_id", F.element_at("labels", F.lit("resourceId"))).withColumn("metric", F.element_at("labels", F.lit("__name__")))
    return keyed.where("resource_id IS NOT NULL AND metric IS NOT NULL").withColumn("canon", S.canonical(F.col("labels"))).dropDuplicates(["resource_id", "metric", "canon"]).select("resource_id", "metric", "canon", "labels")


def index_counts(index: DataFrame) -> DataFrame:
    return index.agg(F.count_distinct("resource_id", "metric").alias("keys"), F.count("*").alias("label_sets"))


def _found(index: DataFrame, name: str) -> DataFrame:
    sets = index.groupBy("resource_id", "metric").agg(F.array_sort(F.collect_list("canon")).alias(f"{name}_canon"), F.max_by("labels", "canon").alias(f"{name}_labels"), F.count("*").alias(f"n_{name}"))
    return sets


def match(entries: DataFrame, live: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """entries with n_live, live_labels, n_exported, exported_labels and all candidates.

    The exported index counts only where no live set has the key.
    """
    keyed = entries.withColumn("resource_id", S.label_value(F.col("resource"))).withColumn("metric", S.metric_name(F.col("ds")))
    out = keyed.join(_found(live, "live"), ["resource_id", "metric"], "left")
    if exported is not None:
        out = out.join(_found(exported, "exported"), ["resource_id", "metric"], "left")
    else:
        empty = F.lit(None).cast("map<string,string>")
        out = out.withColumn("n_exported", F.lit(None).cast("long")).withColumn("exported_labels", empty).withColumn("exported_canon", F.lit(None).cast("array<string>"))
    return out.na.fill(0, ["n_live", "n_exported"])


def classify(matched: DataFrame) -> DataFrame:
    """Adds class, labels (what will be written, else NULL) and candidates; ORPHAN is undecided.

    Entries that can't be read, of unsupported types, or whose mtype label contradicts the type
    of the data source are never written; `note` says why.
    """
    count = F.when(F.col("n_live") > 0, F.col("n_live")).otherwise(F.col("n_exported"))
    named = (
        F.when(F.col("error").isNotNull(), "FAILED_READ").when(~S.is_supported(F.col("ds_type")), "SKIPPED")
        .when(count > 1, "AMBIGUOUS").when(F.col("n_live") == 1, "MATCHED").when(F.col("n_exported") == 1, "EXPORTED").otherwise("ORPHAN")
    )
    labels = F.when(named == "MATCHED", F.col("live_labels")).when(named == "EXPORTED", F.col("exported_labels"))
    mtype = S.metric_type(F.col("ds_type"))
    said = F.element_at(labels, F.lit("mtype"))
    clash = said.isNotNull() & (said != mtype)
    candidates = F.when(named == "AMBIGUOUS", F.when(F.col("n_live") > 0, F.col("live_canon")).otherwise(F.col("exported_canon")))
    note = (
        F.when(named == "FAILED_READ", F.col("error")).when(named == "SKIPPED", F.concat(F.lit("data sources of type "), "ds_type", F.lit(" are not supported")))
        .when(named == "AMBIGUOUS", F.concat(count, F.when(F.col("n_live") > 0, " live label sets").otherwise(" exported label sets")))
        .when(clash, F.concat(F.lit("the label mtype is "), said, F.lit(", the data source is "), "ds_type"))
    )
    kept = [c for c in matched.columns if c not in ("mtype", "class", "labels", "candidates", "note")]
    return matched.select(*kept, mtype.alias("mtype"), F.when(clash, "MTYPE_MISMATCH").otherwise(named).alias("class"), F.when(~clash, labels).alias("labels"), candidates.alias("candidates"), note.alias("note"))


def minimal_labels(resource: Column, ds: Column, mtype: Column) -> Column:
    return F.create_map(F.lit("__name__"), S.metric_name(ds), F.lit("resourceId"), S.label_value(resource), F.lit("mtype"), S.label_value(mtype))


def effective_cutover(entries: DataFrame, snapshot: int | None) -> Column | int:
    return snapshot if snapshot else entries.agg(F.coalesce(F.max("last_update"), F.lit(0))).first()[0]


LEVELS = ("resource", "directory", "node")


def _level_key(level: str, resource: Column) -> Column:
    return {"resource": resource, "directory": S.dir_of(resource), "node": S.node_prefix(resource)}[level]


def sibling_values(index: DataFrame) -> DataFrame:
    """(level, place, label, siblings, having, distinct_values, value, source) over live sets.

    A level's siblings are all live sets below a resource, a directory or a node.
    """
    live = index.where(F.contains("resource_id", F.lit("/"))).select("resource_id", "canon", "labels")
    levels = F.array(*(F.struct(F.lit(x).alias("level"), _level_key(x, F.col("resource_id")).alias("place")) for x in LEVELS))
    placed = live.select("resource_id", "labels", F.explode(levels).alias("l")).select("resource_id", "labels", "l.level", "l.place")
    total = placed.groupBy("level", "place").agg(F.count("*").alias("siblings"))
    values = placed.select("level", "place", "resource_id", F.explode("labels").alias("label", "v"))
    grouped = values.groupBy("level", "place", "label").agg(F.count("*").alias("having"), F.count_distinct("v").alias("distinct_values"), F.min("v").alias("value"), F.min("resource_id").alias("source"))
    return total.join(grouped, ["level", "place"], "left")


def agreement(siblings: Column, having: Column, distinct_values: Column) -> Column:
    """EMPTY where no sibling has the label, VALUE where all have the same, else CONFLICT."""
    none = F.coalesce(having, F.lit(0)) == 0
    return F.when(siblings.isNull(), None).when(none, "EMPTY").when((distinct_values == 1) & (having == siblings), "VALUE").otherwise("CONFLICT")


def levels_of(scope: Column, resource: Column) -> Column:
    """The levels asked for a tag of a scope, in order."""
    both = F.array(F.lit("resource"), F.lit("directory"))
    own = F.array(F.lit("resource"))
    return (
        F.when((scope == "NODE") & S.is_aliased(resource), both).when(scope == "NODE", F.array(F.lit("node"))).when(scope == "INTERFACE", both)
        .when((scope == "METADATA") & ~F.startswith(resource, F.lit("response/")), both).otherwise(own)
    )


def lookup(orphans: DataFrame, tags: DataFrame, index: DataFrame) -> DataFrame:
    """(file, ds, tag, state, value, source): the first level that has siblings decides.

    It decides by having siblings, not by their having the label; state is NULL where no level
    has any.  tags is as small as a configuration and is broadcast after a check of its size.
    """
    if tags.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 tags are no configuration")
    asked = orphans.select("file", "ds", "resource").crossJoin(F.broadcast(tags.select("tag", "scope")))
    asked = asked.select("*", F.posexplode(levels_of(F.col("scope"), F.col("resource"))).alias("rank", "level"))
    place = F.when(F.col("level") == "resource", F.col("resource")).when(F.col("level") == "directory", S.dir_of(F.col("resource"))).otherwise(S.node_prefix(F.col("resource")))
    known = sibling_values(index)
    total = known.select("level", "place", "siblings").distinct()
    found = asked.withColumn("place", place).join(total, ["level", "place"])
    first = found.groupBy("file", "ds", "tag").agg(F.min_by(F.struct("level", "place", "siblings"), "rank").alias("at")).select("file", "ds", "tag", "at.*")
    named = first.withColumn("label", S.label_name(F.col("tag"))).join(known.drop("siblings"), ["level", "place", "label"], "left")
    return named.select("file", "ds", "tag", agreement(F.col("siblings"), F.col("having"), F.col("distinct_values")).alias("state"), "value", "source")


def is_category(label: Column) -> Column:
    return F.startswith(label, F.lit("cat_")) | (label == "categories")


def category_agreement(index: DataFrame, level: str) -> DataFrame:
    """(place, categories): the category labels of a level's siblings where they are the same for all."""
    live = index.where(F.contains("resource_id", F.lit("/")))
    own = F.map_filter("labels", lambda k, v: is_category(k))
    placed = live.select(_level_key(level, F.col("resource_id")).alias("place"), own.alias("m"), S.canonical(own).alias("c"))
    agreed = placed.groupBy("place").agg(F.count_distinct("c").alias("n"), F.max_by("m", "c").alias("categories"))
    return agreed.where("n = 1").drop("n")


def last_put(entries: Column) -> Column:
    """A map of an array of struct(k, v): of entries with one key the last counts, as in a map that is filled in order."""
    keys = F.transform(entries, lambda e: e["k"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def category_labels(names: Column) -> Column:
    """cat_<name> = name for each category, and all of them sorted and joined; no label without a category.

    Of names that are the same label the last, in order, counts; empty values are no labels.
    """
    ordered = F.array_sort(F.array_distinct(F.array_compact(names)))
    each = F.transform(ordered, lambda n: F.struct(S.label_name(F.concat(F.lit("cat_"), n)).alias("k"), S.label_value(n).alias("v")))
    whole = F.array(F.struct(F.lit("categories").alias("k"), S.label_value(F.array_join(ordered, ",")).alias("v")))
    return last_put(F.filter(F.concat(each, whole), lambda e: e["v"] != ""))


def resolve_categories(orphans: DataFrame, index: DataFrame, node_categories: DataFrame | None = None) -> DataFrame:
    """(file, ds, categories, category_source): the category labels of orphans.

    The first level that has siblings decides, if their category labels are all the same; else
    the node's categories count (node_categories: file, ds, names, node_id), also if it has
    none; else both are NULL, which is unresolved.
    """
    live = index.where(F.contains("resource_id", F.lit("/")))
    levels = F.array(*(F.struct(F.lit(x).alias("level"), _level_key(x, F.col("resource_id")).alias("place")) for x in LEVELS))
    own = F.map_filter("labels", lambda k, v: is_category(k))
    placed = live.select("resource_id", own.alias("m"), S.canonical(own).alias("c"), F.explode(levels).alias("l")).select("resource_id", "m", "c", "l.level", "l.place")
    grouped = placed.groupBy("level", "place").agg(F.count_distinct("c").alias("n"), F.max_by("m", "c").alias("m"), F.min("resource_id").alias("first"))
    asked = orphans.select("file", "ds", "resource").select("*", F.posexplode(levels_of(F.lit("NODE"), F.col("resource"))).alias("rank", "level"))
    place = F.when(F.col("level") == "resource", F.col("resource")).when(F.col("level") == "directory", S.dir_of(F.col("resource"))).otherwise(S.node_prefix(F.col("resource")))
    deciding = asked.withColumn("place", place).join(grouped, ["level", "place"]).groupBy("file", "ds").agg(F.min_by(F.struct("n", "m", "first"), "rank").alias("at"))
    agreed = deciding.where("at.n = 1").select("file", "ds", F.col("at.m").alias("agreed"), F.concat(F.lit("sibling:"), F.col("at.first")).alias("sibling"))
    out = orphans.select("file", "ds").join(agreed, ["file", "ds"], "left")
    if node_categories is None:
        return out.select("file", "ds", F.col("agreed").alias("categories"), F.col("sibling").alias("category_source"))
    named = node_categories.select("file", "ds", category_labels(F.col("names")).alias("own"), F.concat(F.lit("rest:node/"), F.col("node_id")).alias("node"))
    return out.join(named, ["file", "ds"], "left").select("file", "ds", F.coalesce("agreed", "own").alias("categories"), F.coalesce("sibling", "node").alias("category_source"))


def with_categories(resolved: DataFrame, categories: DataFrame) -> DataFrame:
    """resolved() with category labels added, or `categories` among the unresolved.

    An entry whose categories no sibling tells needs its node.
    """
    both = resolved.join(categories, ["file", "ds"], "left")
    empty = F.create_map().cast("map<string,string>")
    found = F.coalesce("categories", empty)
    free = F.map_filter("labels", lambda k, v: ~is_category(k))
    kept = F.map_filter("sources", lambda k, v: ~is_category(k))
    return both.select(
        "file", "ds", F.map_concat(free, found).alias("labels"), F.map_concat(kept, F.transform_values(found, lambda k, v: F.col("category_source"))).alias("sources"),
        F.when(F.col("categories").isNull(), F.array_append("unresolved", F.lit("categories"))).otherwise(F.col("unresolved")).alias("unresolved"),
        (F.col("needs_node") | ~F.startswith(F.coalesce("category_source", F.lit("")), F.lit("sibling:"))).alias("needs_node"),
    )


def node_criteria(resource: Column) -> Column:
    """How a resource's node is asked for: ip:<address>, fs:fid, a number, or NULL for an alias."""
    part = lambda i: F.get(F.split(resource, "/"), i)
    return (
        F.when(F.startswith(resource, F.lit("response/")), F.concat(F.lit("ip:"), part(1))).when(F.startswith(resource, F.lit("snmp/fs/")), F.concat(part(2), F.lit(":"), part(3)))
        .when(resource.rlike("^snmp/[0-9]+(/|$)"), part(1))
    )


def route_nodes(resources: DataFrame, nodes: DataFrame, addresses: DataFrame) -> DataFrame:
    """(resource, state, node_id): HIT, GONE or UNKNOWN for each distinct node prefix.

    An address that one node has is a hit, none means gone and several unknown; an alias is
    unknown.  nodes: id, criteria texts; addresses: ip, node_id.
    """
    asked = resources.select("resource", node_criteria(F.col("resource")).alias("criteria")).distinct()
    keys = nodes.select(F.col("id").alias("node_id"), F.explode(F.array_distinct(F.array(F.col("id").cast("string"), F.concat_ws(":", "foreign_source", "foreign_id")))).alias("criteria"))
    by_ip = addresses.select(F.concat(F.lit("ip:"), "ip").alias("criteria"), "node_id")
    found = asked.join(keys.unionByName(by_ip.select("node_id", "criteria")), "criteria", "left").groupBy("resource", "criteria").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("node_id"))
    state = F.when(F.col("criteria").isNull(), "UNKNOWN").when(F.col("n") == 1, "HIT").when(F.col("n") == 0, "GONE").otherwise("UNKNOWN")
    return found.select("resource", state.alias("state"), F.when(state == "HIT", F.col("node_id")).alias("node_id"))


def interface_of(resource: Column) -> Column:
    """The interface directory of a resource below an interface: domain/alias, or the parent's name.

    NULL for resources of the node itself (nothing stands between node and group) and all that
    aren't below snmp.
    """
    parts, depth = F.split(resource, "/"), F.size(F.split(S.node_prefix(resource), "/"))
    deep = F.startswith(resource, F.lit("snmp/")) & (F.size(parts) - 1 > depth)
    aliased = F.concat_ws("/", F.get(parts, 1), F.get(parts, 2))
    return F.when(deep & S.is_aliased(resource), aliased).when(deep, F.get(parts, F.size(parts) - 2))


def scheduled(resources: DataFrame, interfaces: DataFrame, *, prefer_descr: bool = False, sanitize: bool = True) -> DataFrame:
    """Distinct resources whose interface is collected.  resources: resource, node_id."""
    label = S.interface_label(F.col("if_name"), F.col("if_descr"), F.col("phys_addr"), prefer_descr=prefer_descr, sanitize=sanitize)
    active = interfaces.where("collect").select(F.col("node_id"), label.alias("interface"))
    return resources.where(~S.is_aliased(F.col("resource"))).withColumn("interface", interface_of(F.col("resource"))).join(active, ["node_id", "interface"], "left_semi").select("resource").distinct()


def resolve(orphans: DataFrame, tags: DataFrame, index: DataFrame, node_values: DataFrame | None = None) -> DataFrame:
    """(file, ds, labels, sources, unresolved, needs_node): labels of orphans, tag by tag.

    Order: constants, the interface directory for its own expression, the siblings' common value,
    left out where no sibling has the label, the node's value for tags of node scope
    (node_values: file, ds, tag, value, node_id), else unresolved.  Values that are null or
    empty aren't stored.  Tags whose names are one label are put in their order, so the last
    counts, over the minimal labels too.  needs_node tells whether a tag asked for the node.
    """
    found = orphans.select("file", "ds", "resource", "mtype").crossJoin(F.broadcast(tags)).join(lookup(orphans, tags, index), ["file", "ds", "tag"], "left")
    if node_values is not None:
        found = found.join(node_values.select("file", "ds", "tag", F.col("value").alias("node_value"), "node_id"), ["file", "ds", "tag"], "left")
    else:
        found = found.withColumn("node_value", F.lit(None).cast("string")).withColumn("node_id", F.lit(None).cast("long"))
    constant, agreed = F.col("scope") == "CONSTANT", F.col("state") == "VALUE"
    rest = (F.col("scope") == "NODE") & F.col("node_value").isNotNull()
    interface = interface_of(F.col("resource"))
    by_dir = (F.trim("expression") == "${resource:label}") & interface.isNotNull()
    value = F.when(constant, F.col("expression")).when(by_dir, interface).when(agreed, F.col("value")).when(F.col("state") == "EMPTY", None).when(rest, F.col("node_value"))
    source = F.when(constant, "constant").when(by_dir, "derived:resource-dir").when(agreed, F.concat(F.lit("sibling:"), F.col("source"))).when(rest, F.concat(F.lit("rest:node/"), F.col("node_id")))
    open_tag = ~constant & ~by_dir & ~F.coalesce(agreed, F.lit(False)) & ~F.coalesce(F.col("state") == "EMPTY", F.lit(False)) & ~F.coalesce(rest, F.lit(False))
    put = F.when(value.isNotNull() & (value != ""), F.struct("tag", S.label_name(F.col("tag")).alias("k"), S.label_value(value).alias("v"), source.alias("s")))
    node = (F.col("scope") == "NODE") & ~by_dir & ~F.coalesce(F.col("state").isin("VALUE", "EMPTY"), F.lit(False))
    unresolved = F.transform(F.array_sort(F.collect_set(F.when(open_tag, F.col("tag")))), S.label_name)
    grouped = found.groupBy("file", "ds").agg(
        F.first("resource").alias("resource"), F.first("mtype").alias("mtype"), F.array_sort(F.collect_list(put)).alias("put"), unresolved.alias("unresolved"), F.bool_or(node).alias("needs_node")
    )
    base = F.map_entries(minimal_labels(F.col("resource"), F.col("ds"), F.col("mtype")))
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    labels = F.concat(F.transform(base, lambda e: entry(e["key"], e["value"])), F.transform("put", lambda p: entry(p["k"], p["v"])))
    sources = F.concat(F.transform(base, lambda e: entry(e["key"], F.lit("minimal"))), F.transform("put", lambda p: entry(p["k"], p["s"])))
    return grouped.select("file", "ds", last_put(labels).alias("labels"), last_put(sources).alias("sources"), "unresolved", "needs_node")


def classify_orphans(orphans: DataFrame, *, cutover: int, pending: bool = True, skip_orphans: bool = False, skip_partial: bool = False) -> DataFrame:
    """Final class, labels and note.  orphans: file, ds, resource, mtype, last_update, step,
    labels, unresolved, gone, scheduled.

    A node that is gone leaves the minimal labels; else what was still written at the cutover,
    or is scheduled for collection, waits for its live series.
    """
    gone = F.coalesce("gone", F.lit(False))
    writing = F.col("last_update") >= F.lit(cutover) - 2 * F.col("step")
    waits = ~gone & (writing | F.coalesce("scheduled", F.lit(False))) & F.lit(pending)
    named = F.when(waits, "PENDING").when(gone, "ORPHAN_MINIMAL").when(F.size("unresolved") == 0, "ORPHAN_COMPLETE").otherwise("ORPHAN_PARTIAL")
    dropped = waits | F.lit(skip_orphans) | (F.lit(skip_partial) & (named == "ORPHAN_PARTIAL"))
    labels = F.when(~dropped, F.when(gone, minimal_labels(F.col("resource"), F.col("ds"), F.col("mtype"))).otherwise(F.col("labels")))
    again = S.iso_instant(F.lit(cutover) + 2 * F.col("step"))
    note = F.when(waits & writing, F.concat(F.lit("still written at the cutover; run again after "), again)).when(waits, F.concat(F.lit("scheduled for collection; run again after "), again))
    why = F.when(gone, "the inventory does not know the node").when(named == "ORPHAN_PARTIAL", F.concat(F.lit("unresolved: "), F.array_join("unresolved", ", ")))
    if skip_orphans:
        why = F.lit("left out by --skip-orphans")
    elif skip_partial:
        why = F.when(named == "ORPHAN_PARTIAL", F.concat(why, F.lit(" (left out by --skip-partial)"))).otherwise(why)
    note = note.otherwise(why)
    return orphans.withColumns({"class": named, "labels": labels, "note": note, "unresolved": F.when(gone, F.array().cast("array<string>")).otherwise(F.col("unresolved"))})


def label_hash(entries: DataFrame) -> DataFrame:
    """(file, label_hash) over the entries that will be written, whatever their order.

    The text (a line for each data source, by name, and one for its labels) is the one that state
    logs of other writers hash, so that a migration begun elsewhere is not written again.
    """
    entry = F.array_sort(F.collect_list(F.struct("ds", S.braced(F.col("labels")).alias("labels"))))
    lines = F.transform(entry, lambda e: F.concat(e["ds"], F.lit("\n"), e["labels"]))
    return entries.where("labels IS NOT NULL").groupBy("file").agg(S.fingerprint(lines).alias("label_hash"))


def config_hash(tags: DataFrame, expose_categories: bool) -> DataFrame:
    """(config_hash): one row, over the sorted tags and the switch."""
    sorted_tags = F.transform(F.array_sort(F.collect_list(F.struct("tag", "expression"))), lambda t: F.concat(F.lit("tag."), t["tag"], F.lit("="), t["expression"]))
    texts = F.array_append(sorted_tags, F.lit(f"exposeCategories={str(expose_categories).lower()}"))
    return tags.agg(S.fingerprint(texts).alias("config_hash"))


def expected_keys(tags: DataFrame, expose_categories: bool) -> DataFrame:
    keys = tags.select(S.label_name(F.col("tag")).alias("label"))
    return (keys.unionByName(tags.sparkSession.range(1).select(F.lit("categories").alias("label"))) if expose_categories else keys).distinct().orderBy("label")


def order_entries(entries: DataFrame) -> DataFrame:
    """What the walk left out (it has no resource) by path, then files by path and their data
    sources in the order of the file (`at`), then all orphans in the same order."""
    return entries.orderBy(section(), "file", F.col("at").asc_nulls_first())


def section() -> Column:
    return F.when(F.col("resource").isNull(), 0).when(S.is_orphan(F.col("class")) | (F.col("class") == "PENDING"), 2).otherwise(1)


def colliding_names(entries: DataFrame) -> DataFrame:
    """Data sources of one resource whose sanitized names are the same series."""
    own = Window.partitionBy("resource", S.metric_name(F.col("ds")))
    return entries.withColumn("same", F.count("*").over(own)).where("same > 1").drop("same")
