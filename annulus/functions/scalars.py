"""Scalar functions of the history engine, as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: an epoch that no session time zone moves.
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
COUNTERS = ("COUNTER", "DERIVE")
SUPPORTED = ("GAUGE", "COUNTER", "DERIVE")
ORPHANS = ("ORPHAN", "ORPHAN_COMPLETE", "ORPHAN_PARTIAL", "ORPHAN_MINIMAL")
VALUE_UNITS = 2048
RECENT_SECONDS = 7 * 86_400


def epoch_seconds(ts: str) -> Column:
    """Epoch seconds of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, {ts})")


def metric_name(x: Column) -> Column:
    """A metric name: letters, digits (not first), _ and :, others as _."""
    return F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9_:]", "_"), "^[0-9]", "_")


def label_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9_]", "_"), "^[0-9]", "_")


def label_value(x: Column) -> Column:
    return F.substring(x, 1, VALUE_UNITS)


def _parts(path: Column) -> Column:
    """Segments of a path; empty ones at its end don't count."""
    return F.split(F.regexp_replace(path, "/+$", ""), "/", -1)


def node_prefix(resource: Column) -> Column:
    """The first four segments of snmp/fs/..., else the first two."""
    parts = _parts(resource)
    wide = F.startswith(resource, F.lit("snmp/fs/")) & (F.size(parts) >= 4)
    return F.array_join(F.slice(parts, F.lit(1), F.when(wide, 4).otherwise(2)), "/")


def dir_of(resource: Column) -> Column:
    """Up to the last slash; empty where there is none."""
    return F.regexp_extract(resource, "^(.*)/[^/]*$", 1)


def is_aliased(resource: Column) -> Column:
    """snmp/<x>, also with more behind it, where x is neither fs nor a number."""
    return resource.rlike("^snmp/[^/]+(/|$)") & ~resource.rlike("^snmp/(fs|[0-9]+)(/|$)")


def is_counter(ds_type: Column) -> Column:
    return ds_type.isin(*COUNTERS)


def is_supported(ds_type: Column) -> Column:
    return ds_type.isin(*SUPPORTED)


def is_orphan(entry_class: Column) -> Column:
    return entry_class.isin(*ORPHANS)


def metric_type(ds_type: Column) -> Column:
    return F.when(is_counter(ds_type), "count").otherwise("gauge")


def promql_quote(x: Column) -> Column:
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def regex_escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\.+*?()|\[\]{}^$])", r"\\$1")


def canonical(labels: Column) -> Column:
    """Text that is equal for equal label maps: sorted key=value, comma-joined, escaped."""
    escape = lambda s: F.regexp_replace(s, r"([\\,=])", r"\\$1")
    return F.concat_ws(",", F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(escape(e["key"]), F.lit("="), escape(e["value"]))))


def exact_selector(labels: Column) -> Column:
    entries = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), promql_quote(e["value"]), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def prefix_selector(prefix: Column) -> Column:
    return F.concat(F.lit('{resourceId=~"'), promql_quote(regex_escape(prefix)), F.lit('/.+"}'))


def has_prefix(resource: Column, prefix: Column) -> Column:
    """What prefix_selector selects: something stands behind the prefix and a slash."""
    return F.startswith(resource, F.concat(prefix, F.lit("/"))) & (F.length(resource) > F.length(prefix) + 1)


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(60), F.call_function("shiftleft", F.lit(1), F.least(F.lit(6), attempt - 1).cast("int")))


def is_close(a: Column, b: Column, tolerance: Column) -> Column:
    """Equal, or no further apart than tolerance times the larger magnitude; a NaN is close to nothing."""
    near = (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))
    return near & ~F.isnan(a) & ~F.isnan(b)


def html_escape(x: Column) -> Column:
    out = F.coalesce(x, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def iso_instant(seconds: Column) -> Column:
    """2024-01-31T12:00:00Z, in UTC whatever the session's time zone."""
    moment = F.timestamp_add("SECOND", seconds, F.expr(_EPOCH))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def lenient_double(x: Column) -> Column:
    """A number, or NaN for what isn't one."""
    plain = F.trim(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, F.trim(x).try_cast("double")).otherwise(F.lit(float("nan")))


def is_retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def duration_text(samples: Column, rate: Column) -> Column:
    """How long writing takes: hours and minutes."""
    seconds = F.floor(samples / rate)
    return F.concat(F.floor(seconds / 3600), F.lit("h "), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.lit("m"))


def interface_label(if_name: Column, if_descr: Column, phys_addr: Column, *, prefer_descr: bool = False, sanitize: bool = True) -> Column:
    """The directory name of an interface: its name or description, cleaned, with its address.

    Every byte that is no ASCII letter or digit becomes _ (so a character of two bytes becomes
    two).  In the address such bytes become blanks; it is added only if, without the blanks at
    its ends, it has twelve characters: one with separators is left out.
    """
    first, second = (if_descr, if_name) if prefer_descr else (if_name, if_descr)
    name = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    if sanitize:
        name = F.regexp_replace(F.decode(F.encode(name, "UTF-8"), "ISO-8859-1"), "[^a-zA-Z0-9]", "_")
    mac = F.trim(F.regexp_replace(F.decode(F.encode(phys_addr, "UTF-8"), "ISO-8859-1"), "[^a-zA-Z0-9]", " "))
    return F.when(F.length(mac) == 12, F.concat(name, F.lit("-"), mac)).otherwise(name)


#: How wide the scope of a tag is, narrow ones last.
SCOPES = ("CONSTANT", "NODE", "INTERFACE", "METADATA", "SERVICE", "RESOURCE", "UNCLASSIFIED")
_CONTEXTS = {"node": "NODE", "asset": "NODE", "interface": "INTERFACE", "service": "SERVICE", "resource": "RESOURCE"}


def scope_of(expression: Column) -> Column:
    """The narrowest context that an expression's ${...} tokens name; no token is a constant, one
    that is open, or names nothing, is unclassified."""
    token = r"\$\{([^}]*)\}"
    tokens = F.regexp_extract_all(expression, F.lit(token), F.lit(1))
    choices = F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, r"\|", -1))), lambda c: F.locate(":", c) > 1)

    def ordinal(choice: Column) -> Column:
        context = F.trim(F.substring_index(choice, ":", 1))
        names = [*_CONTEXTS.items()]
        out = F.when(context == names[0][0], SCOPES.index(names[0][1]))
        for name, scope in names[1:]:
            out = out.when(context == name, SCOPES.index(scope))
        return out.otherwise(SCOPES.index("METADATA"))

    ordinals = F.transform(choices, ordinal)
    last = len(SCOPES) - 1
    unclosed = F.contains(F.regexp_replace(expression, token, ""), F.lit("${"))
    at = F.when(expression.isNull() | unclosed, last).when(F.size(tokens) == 0, 0).when(F.size(ordinals) == 0, last).otherwise(F.array_max(ordinals))
    return F.get(F.array(*(F.lit(s) for s in SCOPES)), at)


def camel(key: str) -> str:
    """An asset field's name from its dashed form."""
    head, *rest = key.split("-")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def node_expression(expression: str, node: dict[str, Column]) -> Column:
    """A tag expression over a node's columns; null where it can't be computed.

    node: id, label, location, foreign_source, foreign_id, and assets (a map).  In ${a|b} the
    first alternative with a value counts; one without a colon stands for itself; an attribute
    that is known but empty is empty, an unknown one or an unclosed token makes the whole null.
    """
    if expression.count("${") != len(re.findall(r"\$\{[^}]*\}", expression)):
        return F.lit(None).cast("string")
    attributes = {
        "label": node["label"],
        "location": node["location"],
        "foreign-source": node["foreign_source"],
        "foreign-id": node["foreign_id"],
        "criteria": F.when((F.coalesce(node["foreign_source"], F.lit("")) != "") & (F.coalesce(node["foreign_id"], F.lit("")) != ""), F.concat_ws(":", node["foreign_source"], node["foreign_id"])).otherwise(node["id"].cast("string")),
    }
    out = []
    for literal, token in re.findall(r"([^$]+|\$(?!\{))|\$\{([^}]*)\}", expression):
        if literal:
            out.append(F.lit(literal))
            continue
        values = []
        for choice in token.split("|"):
            context, colon, name = choice.partition(":")
            if not colon:
                values.append(F.lit(choice))
            elif context == "node" and name in attributes:
                values.append(F.coalesce(attributes[name], F.lit("")))
            elif context == "asset" and "assets" in node:
                values.append(F.coalesce(F.element_at(node["assets"], F.lit(camel(name))), F.lit("")))
            else:
                return F.lit(None).cast("string")
        out.append(F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit("")))
    return F.concat(*out) if out else F.lit("")


def braced(labels: Column) -> Column:
    """{key=value, key=value} of a label map, by key."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("}"))


def fingerprint(entries: Column) -> Column:
    """SHA-256 over an array of texts in their order, each with a line feed behind it."""
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e, F.lit("\n"))), ""), 256)


def as_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)
