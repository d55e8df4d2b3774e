"""The report of a plan as one self-contained HTML page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import verify


def _table(heads: list[str], rows: list[tuple]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in row)
    return f"<table><tr>{cells('th', heads)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def _section(title: str, body: str) -> str:
    return f"<h2>{html.escape(title)}</h2>{body}"


def _list(title: str, rows: DataFrame, order: list[str]) -> str:
    shown, total = verify.capped(rows, [F.col(c) for c in order])
    found = [tuple(r) for r in shown.collect()]
    note = f"<p>showing {len(found)} of {total}</p>" if total > len(found) else ""
    return _section(title, note + _table(rows.columns, found))


def page(entries: DataFrame, tags: DataFrame | None = None, facts: dict[str, object] | None = None, rate: float = 20_000) -> str:
    """Sections: facts, tags, summary, classes, label coverage, open tags, ambiguous and waiting entries."""
    summary = verify.plan_summary(entries, rate)
    classes = sorted(r["class"] for r in entries.where("labels IS NOT NULL").select("class").distinct().collect())
    parts = [_section("Snapshot", _table(["fact", "value"], sorted((facts or {}).items())))]
    if tags is not None:
        parts.append(_section("Tags", _table(tags.columns, [tuple(r) for r in tags.orderBy("tag").collect()])))
    parts.append(_section("Summary", _table(summary.columns, [tuple(r) for r in summary.collect()])))
    counts = verify.class_summary(entries).orderBy("class")
    parts.append(_section("Classes", _table(counts.columns, [tuple(r) for r in counts.collect()])))
    if classes:
        coverage = verify.label_coverage(entries, classes).orderBy("label")
        parts.append(_section("Labels", _table(coverage.columns, [tuple(r) for r in coverage.collect()])))
    open_tags = verify.unresolved_by_node(entries).select("node", "n", F.array_join("tags", ", ").alias("tags"))
    parts.append(_list("Open tags", open_tags, ["node"]))
    parts.append(_list("Ambiguous", entries.where("class = 'AMBIGUOUS'").select("resource", "ds", F.size("candidates").alias("candidates")), ["resource", "ds"]))
    parts.append(_list("Pending", entries.where("class = 'PENDING'").select("resource", "ds", "note"), ["resource", "ds"]))
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid;padding:.2em .5em;text-align:left}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Migration plan</title><style>{style}</style></head><body><h1>Migration plan</h1>{''.join(parts)}</body></html>"
