"""SQL of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

_RRAS = "(VALUES (0, 'AVERAGE', 1, 168), (1, 'AVERAGE', 6, 120), (2, 'AVERAGE', 24, 30), (3, 'MAX', 24, 30), (4, 'MAX', 1, 168), (5, 'AVERAGE', 6, 60)) r(rra, cf, pdp, n)"


def _sec(c: str) -> str:
    return f"(epoch_us({c}) // 1000000)"


_SAMPLES = f"""samples AS (
  SELECT event_id, event_type AS file, {_sec("ts")}::BIGINT AS ts, round(value * 100)::BIGINT AS cents FROM events
), lasts AS (SELECT file, max(ts) AS last_update FROM samples GROUP BY file)"""

_ARCHIVES = f"""{_SAMPLES}, archives AS (
  SELECT file, rra, cf, pdp::BIGINT AS pdp, n::BIGINT AS n, last_update, 3600::BIGINT AS step FROM lasts, {_RRAS}
), finest AS (
  SELECT * FROM archives WHERE pdp = 1 QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, rra) = 1
), coarse AS (
  SELECT * FROM archives WHERE cf = 'AVERAGE' AND (file, pdp) NOT IN (SELECT file, pdp FROM finest)
  QUALIFY row_number() OVER (PARTITION BY file, pdp ORDER BY rra) = 1
), selected AS (SELECT * FROM finest UNION ALL SELECT * FROM coarse)"""

_STITCHED = f"""{_ARCHIVES}, means AS (
  SELECT file, p AS pdp, ts // (3600 * p) * (3600 * p) + 3600 * p AS e, sum(cents)::DOUBLE / count(*) / 100 AS v
  FROM samples, (VALUES (1), (6), (24)) x(p) GROUP BY ALL
), spans AS (
  SELECT *, step * pdp AS span, last_update - last_update % (step * pdp) - (n - 1) * step * pdp AS first_end FROM selected
), limits AS (
  SELECT *, min(first_end - span) OVER (PARTITION BY file ORDER BY pdp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lim FROM spans
), grid AS (
  SELECT l.*, first_end + j * span AS t FROM limits l, unnest(range(n)) u(j)
), stitched AS (
  SELECT g.file, CASE WHEN lim IS NULL OR t <= lim THEN t ELSE lim END AS "end",
    CASE WHEN lim IS NULL OR t <= lim THEN span ELSE lim - (t - span) END AS span, m.v AS value,
    NOT (lim IS NULL OR t <= lim) AS partial
  FROM grid g LEFT JOIN means m ON m.file = g.file AND m.pdp = g.pdp AND m.e = g.t
  WHERE lim IS NULL OR t - g.span < lim
)"""

_PASS = "CASE WHEN ts > last_update - 604800 THEN 'RECENT' ELSE 'OLDER' END AS pass"
_ESC = "regexp_replace({}, '([\\\\,=])', '\\\\\\1', 'g')"


def _canon(entries: list[tuple[str, str]]) -> str:
    """Sorted key=value of fixed keys; values here hold none of the escaped characters unless escaped."""
    return " || ',' || ".join(f"'{k}=' || {_ESC.format(v)}" for k, v in sorted(entries))


_LIVE = "'snmp/' || n_regionkey || '/' || n_name || '/' || c_custkey"
_MTYPE = "CASE WHEN c_custkey % 10 = 0 THEN 'count' ELSE 'gauge' END"
_SETS = f"""sets AS (
  SELECT c_custkey, n_name, n_regionkey, {_LIVE} AS resource, c_mktsegment AS segment, {_MTYPE} AS mtype
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""
_SET_CANON = _canon([("resourceId", "resource"), ("__name__", "'acctbal'"), ("segment", "segment"), ("node", "n_name"), ("mtype", "mtype")])
_DIR = "'snmp/' || n_regionkey || '/' || n_name"

_ENTRIES = """entries AS (
  SELECT o_orderkey, 'snmp/' || o_custkey || '/' || o_orderkey AS resource,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'ABSOLUTE' WHEN o_orderstatus = 'F' THEN 'COUNTER' ELSE 'GAUGE' END AS ds_type,
    CASE WHEN o_orderkey % 97 = 0 THEN 'cannot read' END AS error
  FROM orders
), line_sets AS (
  SELECT DISTINCT l_returnflag AS flag, l_orderkey AS k, CASE WHEN l_linestatus = 'F' THEN 'count' ELSE 'gauge' END AS mtype, l_suppkey::VARCHAR AS supplier FROM lineitem
), per_key AS (
  SELECT flag, k, count(*) AS n, max(mtype) AS mtype, max(supplier) AS supplier FROM line_sets GROUP BY flag, k
)"""


def _classified(with_exported: bool) -> str:
    exported = "LEFT JOIN per_key x ON x.flag = 'A' AND x.k = o_orderkey" if with_exported else "LEFT JOIN (SELECT * FROM per_key WHERE false) x ON x.k = o_orderkey"
    return f"""{_ENTRIES}, matched AS (
  SELECT e.*, coalesce(l.n, 0) AS n_live, coalesce(x.n, 0) AS n_exported, CASE WHEN ds_type = 'COUNTER' THEN 'count' ELSE 'gauge' END AS own,
    CASE WHEN l.n > 0 THEN l.n ELSE coalesce(x.n, 0) END AS found,
    CASE WHEN l.n > 0 THEN l.mtype ELSE x.mtype END AS said, CASE WHEN l.n > 0 THEN l.supplier ELSE x.supplier END AS supplier
  FROM entries e LEFT JOIN per_key l ON l.flag = 'R' AND l.k = o_orderkey {exported}
), named AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'FAILED_READ' WHEN ds_type = 'ABSOLUTE' THEN 'SKIPPED' WHEN found > 1 THEN 'AMBIGUOUS'
    WHEN n_live = 1 THEN 'MATCHED' WHEN n_exported = 1 THEN 'EXPORTED' ELSE 'ORPHAN' END AS base FROM matched
), classified AS (
  SELECT *, CASE WHEN base IN ('MATCHED', 'EXPORTED') AND said <> own THEN 'MTYPE_MISMATCH' ELSE base END AS class,
    base IN ('MATCHED', 'EXPORTED') AND said = own AS written FROM named
)"""


_CLASSIFIED = _classified(True)
_ORPHANS = f"""{_SETS}, orphans AS (
  SELECT s.*, l.last_update FROM sets s JOIN (SELECT o_custkey, max({_sec("o_orderdate")})::BIGINT AS last_update FROM orders GROUP BY o_custkey) l ON c_custkey = o_custkey
)"""
_NODE = "'snmp/' || n_regionkey"
_STATES = """log AS (
  SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity)::INT AS line,
    CASE WHEN l_linestatus = 'F' THEN 'RECENT' ELSE 'OLDER' END AS pass, CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'DONE' END AS status,
    l_quantity::BIGINT AS samples, (l_partkey % 3 + 1)::INT AS attempts, CASE WHEN l_suppkey % 4 > 0 THEN (l_suppkey % 2)::VARCHAR END AS label_hash
  FROM lineitem
), states AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY file, pass ORDER BY line DESC) = 1),
files AS (SELECT o_orderkey AS file, (o_orderkey % 2)::VARCHAR AS label_hash FROM orders)"""
_PROCESSED = """todo AS (
  SELECT f.file FROM files f LEFT JOIN states s ON s.file = f.file AND s.pass = 'RECENT'
  WHERE s.status IS NULL OR s.status = 'DONE' AND s.label_hash IS NOT NULL AND s.label_hash <> f.label_hash
), planned AS (
  SELECT l_orderkey AS file, min('ds' || l_linenumber) FILTER (l_linenumber > 7 OR l_orderkey % 5 = 0 AND l_linenumber > 2) AS lost FROM lineitem GROUP BY 1
), judged AS (
  SELECT t.file, CASE WHEN p.file IS NULL THEN NULL WHEN t.file % 89 = 0 THEN 'read: no such file' WHEN t.file % 97 = 0 THEN 'read: cannot read'
    WHEN p.lost IS NOT NULL THEN 'planned data source ' || p.lost || ' missing from file' END AS error
  FROM todo t LEFT JOIN planned p USING (file)
)"""
_WALKED = """files AS (
  SELECT 'snmp/' || (l_orderkey % 10) AS dir, l_orderkey AS k, CASE l_linenumber WHEN 1 THEN 'rrd' ELSE 'jrb' END AS ext, 'g' || l_orderkey || '.' || CASE l_linenumber WHEN 1 THEN 'rrd' ELSE 'jrb' END AS name, max(l_shipdate) AS m
  FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL
), named AS (
  SELECT 'snmp/' || (o_orderkey % 10) AS dir, o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN 'g' ELSE 'm' END || o_orderkey AS grp, o_orderstatus <> 'P' AS by_group FROM orders WHERE o_orderkey % 3 <> 0
), ranked AS (
  SELECT f.*, grp, row_number() OVER w AS turn, first(name) OVER w AS winner FROM files f JOIN named n ON n.k = f.k WINDOW w AS (PARTITION BY f.k ORDER BY m DESC, ext = 'rrd' DESC)
)"""
_ISO = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_Q = "replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
_RX = "regexp_replace({}, '([\\\\.+*?()|\\[\\]{{}}^$])', '\\\\\\1', 'g')"
_HARD = "(url || '\"\\' || chr(10) || '(*)[x]{1}^$|+?')"
_METRIC = "regexp_replace(regexp_replace({}, '[^a-zA-Z0-9_:]', '_', 'g'), '^[0-9]', '_')"
_LABEL = "regexp_replace(regexp_replace({}, '[^a-zA-Z0-9_]', '_', 'g'), '^[0-9]', '_')"
_PREFIX = "array_to_string(list_slice(str_split(regexp_replace({0}, '/+$', ''), '/'), 1, CASE WHEN {0} LIKE 'snmp/fs/%' AND len(str_split(regexp_replace({0}, '/+$', ''), '/')) >= 4 THEN 4 ELSE 2 END), '/')"
_EXPECTED = f"{_SAMPLES}, expected AS (SELECT file AS canon, file < 'm' AS counter, ts, max(cents) AS cents FROM samples GROUP BY file, ts)"

_LEVELS = f"""{_SETS}, placed AS (
  SELECT 'directory' AS level, {_DIR} AS place, * FROM sets UNION ALL SELECT 'node', {_NODE}, * FROM sets
), each AS (
  SELECT level, place, resource, unnest(['resourceId', '__name__', 'segment', 'node', 'mtype']) AS label, unnest([resource, 'acctbal', segment, n_name, mtype]) AS v FROM placed
)"""

_TAGGED = f"""{_ORPHANS}, live AS (SELECT * FROM sets WHERE c_custkey % 2 = 0), odd AS (SELECT * FROM orphans WHERE c_custkey % 2 = 1),
by_node AS (SELECT {_NODE} AS place, count(DISTINCT n_name) AS names, min(n_name) AS name FROM live GROUP BY 1),
by_dir AS (SELECT {_DIR} AS place, count(DISTINCT segment) AS segs, min(segment) AS seg FROM live GROUP BY 1)"""

SQL: dict[str, str] = {
    "counter_history": f"""
WITH {_STITCHED}, heads AS (
  SELECT s.file, l.last_update, sum(cents)::DOUBLE / 100 AS reading, sum(CASE WHEN ts >= last_update // 3600 * 3600 THEN cents ELSE 0 END)::DOUBLE / 100 AS pending
  FROM samples s JOIN lasts l USING (file) GROUP BY s.file, l.last_update
), steps AS (
  SELECT file, "end" AS e, span, -value * span AS change, 1 AS kind FROM stitched WHERE value IS NOT NULL
  UNION ALL SELECT file, NULL, NULL, reading - pending, 0 FROM heads
), folded AS (
  SELECT *, sum(change) OVER (PARTITION BY file ORDER BY kind, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after,
    sum(change) OVER (PARTITION BY file ORDER BY kind, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM steps
), points AS (
  SELECT file, e AS ts, before AS value, 1 AS prio, -e AS turn FROM folded WHERE kind = 1
  UNION ALL SELECT file, e - span, after, 1, -e FROM folded WHERE kind = 1
  UNION ALL SELECT file, last_update, reading, 0, 0 FROM heads
), best AS (SELECT file, ts, arg_max(value, (prio, turn)) AS value FROM points GROUP BY file, ts)
SELECT file, ts, round(value, 3) AS value, {_PASS} FROM best JOIN lasts USING (file) UNION ALL SELECT 'silent', 1700000100, 42, 'RECENT'""",
    "gauge_history": f"""
WITH {_STITCHED} SELECT file, "end" AS ts, value, CASE WHEN "end" > last_update - 604800 THEN 'RECENT' ELSE 'OLDER' END AS pass
FROM stitched JOIN lasts USING (file) WHERE NOT partial AND value IS NOT NULL""",
    "archive_consolidate": f"""
WITH {_SAMPLES} SELECT file, ts // 21600 * 21600 + 21600 AS "end", sum(cents)::DOUBLE / count(*) / 100 AS avg_value, min(cents)::DOUBLE / 100 AS min_value, max(cents)::DOUBLE / 100 AS max_value, count(*) AS n
FROM samples GROUP BY ALL""",
    "archive_select_finest": f"WITH {_ARCHIVES} SELECT file, rra, pdp, n FROM selected",
    "stitch_intervals": f'WITH {_STITCHED} SELECT file, "end", span, value, partial FROM stitched',
    "archive_round_trip": f"""
WITH {_ARCHIVES}, means AS (
  SELECT file, p AS pdp, ts // (3600 * p) * (3600 * p) + 3600 * p AS e, sum(cents)::DOUBLE / count(*) / 100 AS v, max(cents)::DOUBLE / 100 AS m FROM samples, (VALUES (1), (6), (24)) x(p) GROUP BY ALL
), grid AS (
  SELECT a.*, j AS row, last_update - last_update % (step * pdp) - (n - 1 - j) * step * pdp AS t FROM archives a, unnest(range(n)) u(j)
)
SELECT g.file, rra, row, CASE WHEN cf = 'MAX' THEN m.m ELSE m.v END AS value FROM grid g LEFT JOIN means m ON m.file = g.file AND m.pdp = g.pdp AND m.e = g.t""",
    "remote_write_round_trip": f"WITH {_SAMPLES} SELECT file, ts * 1000 AS ts_ms, max(cents)::DOUBLE AS cents FROM samples GROUP BY file, ts",
    "label_drift": f"""
WITH {_SETS}, entries AS (
  SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'PENDING' ELSE 'ORPHAN_COMPLETE' END AS class FROM sets
), sample AS (
  SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY class ORDER BY md5('1:' || resource || '/acctbal'), resource) <= 50
)
SELECT resource AS file, 'acctbal' AS ds, class, CASE WHEN class = 'PENDING' THEN 'notice' ELSE 'stop' END AS kind FROM sample
WHERE c_custkey % 7 <> 0 AND (class = 'PENDING' OR c_custkey % 5 = 0)""",
    "pass_split": f"WITH {_SAMPLES} SELECT file, {_PASS}, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM samples JOIN lasts USING (file) GROUP BY file, pass",
    "oldest_row_time": f"WITH {_ARCHIVES} SELECT file, min(last_update - last_update % (step * pdp) - (n - 1) * step * pdp) AS oldest FROM selected GROUP BY file",
    "cutover": f"WITH {_SAMPLES} SELECT coalesce(max(last_update), 0) AS cutover FROM lasts",
    "wrap_aware_delta": f"""
WITH {_SAMPLES}, readings AS (SELECT file, event_id, ts, (sum(cents * 100000) OVER (PARTITION BY file ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 4294967295)::BIGINT AS v FROM samples),
deltas AS (SELECT *, v - lag(v) OVER (PARTITION BY file ORDER BY ts, event_id) AS d FROM readings)
SELECT file, event_id, CASE WHEN d < 0 THEN d + 4294967295 ELSE d END AS delta FROM deltas""",
    "ring_unroll": f"""
WITH {_SAMPLES}, slots AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) - 1 AS slot FROM samples)
SELECT file, slot, (slot % 24 - 8 + 24) % 24 AS row, cents FROM slots""",
    "series_assembly": f"""
WITH {_SAMPLES}, points AS (SELECT file, ts, max(cents) AS v FROM samples GROUP BY file, ts)
SELECT file, count(*) AS n, min(ts) * 1000 AS first_ms, sha256(string_agg(v::VARCHAR, ',' ORDER BY ts)) AS values_sha256 FROM points GROUP BY file""",
    "label_index_distinct": f"WITH {_SETS} SELECT resource AS resource_id, 'acctbal' AS metric, sha256({_SET_CANON}) AS canon_sha256 FROM sets",
    "label_index_counts": f"WITH {_SETS} SELECT count(DISTINCT resource) AS keys, count(*) AS label_sets FROM sets",
    "series_match_classify": f"WITH {_classified(False)} SELECT o_orderkey, n_live, class, CASE WHEN class = 'AMBIGUOUS' THEN n_live ELSE 0 END::INT AS n_candidates FROM classified",
    "fallback_lookup": f"WITH {_CLASSIFIED} SELECT o_orderkey, n_live, n_exported, class, CASE WHEN written THEN supplier END AS supplier FROM classified",
    "mtype_mismatch": f"WITH {_CLASSIFIED} SELECT o_orderkey, own AS mtype, NOT written AS dropped FROM classified WHERE class = 'MTYPE_MISMATCH'",
    "orphan_pending": f"""
WITH {_ORPHANS}, top AS (SELECT max(last_update) AS c FROM orphans), judged AS (
  SELECT *, c_custkey % 7 = 0 AS gone, last_update >= c - 172800 AS writing, c_custkey % 11 = 0 AS scheduled FROM orphans, top
), named AS (
  SELECT *, CASE WHEN NOT gone AND (writing OR scheduled) THEN 'PENDING' WHEN gone THEN 'ORPHAN_MINIMAL' WHEN c_custkey % 4 <> 0 THEN 'ORPHAN_COMPLETE' ELSE 'ORPHAN_PARTIAL' END AS class FROM judged
)
SELECT c_custkey, class, CASE WHEN class = 'PENDING' THEN CASE WHEN writing THEN 'still written at the cutover' ELSE 'scheduled for collection' END || '; run again after ' || {_ISO.format("c + 172800")}
  WHEN class = 'ORPHAN_MINIMAL' THEN 'the inventory does not know the node' WHEN class = 'ORPHAN_PARTIAL' THEN 'unresolved: site (left out by --skip-partial)' END AS note, class IN ('ORPHAN_MINIMAL', 'ORPHAN_COMPLETE') AS written FROM named""",
    "sibling_agreement": f"""
WITH {_LEVELS}, total AS (SELECT level, place, count(*) AS siblings FROM placed GROUP BY ALL),
byl AS (SELECT level, place, label, count(*) AS held, count(DISTINCT v) AS distinct_values, min(v) AS value FROM each GROUP BY ALL)
SELECT level, place, label, siblings, distinct_values, CASE WHEN distinct_values = 1 AND held = siblings THEN 'VALUE' ELSE 'CONFLICT' END AS state, value FROM total JOIN byl USING (level, place)""",
    "scoped_level_fallback": f"""
WITH {_TAGGED}
SELECT c_custkey, 'node' AS tag, CASE WHEN names = 1 THEN 'VALUE' ELSE 'CONFLICT' END AS state, name AS value FROM odd JOIN by_node ON place = {_NODE}
UNION ALL SELECT c_custkey, 'segment', CASE WHEN segs = 1 THEN 'VALUE' ELSE 'CONFLICT' END, seg FROM odd JOIN by_dir ON place = {_DIR}
UNION ALL SELECT c_custkey, 'segment2', 'EMPTY', NULL FROM odd JOIN by_dir ON place = {_DIR}""",
    "category_agreement": f"""
WITH {_SETS}, c AS (SELECT {_DIR} AS place, CASE WHEN n_regionkey < 2 THEN 'core' ELSE segment END AS cat FROM sets)
SELECT place, 'categories=' || min(cat) AS categories FROM c GROUP BY place HAVING count(DISTINCT cat) = 1""",
    "tag_resolution": f"""
WITH {_TAGGED}, looked AS (
  SELECT o.*, n.names, n.name, d.segs, d.seg FROM odd o LEFT JOIN by_node n ON n.place = {_NODE} LEFT JOIN by_dir d ON d.place = {_DIR}
)
SELECT c_custkey, '__name__=acctbal,a_x=two,mtype=gauge' || CASE WHEN names = 1 THEN ',node=' || name ELSE '' END || ',resourceId=' || resource || CASE WHEN segs = 1 THEN ',segment=' || seg ELSE '' END || ',site=lab' AS labels,
  array_to_string(list_filter([CASE WHEN names = 1 THEN NULL ELSE 'node' END, CASE WHEN names IS NULL THEN 'rack' END, CASE WHEN segs = 1 THEN NULL ELSE 'segment' END], lambda x: x IS NOT NULL), ',') AS unresolved
FROM looked""",
    "node_route": """
WITH asked AS (
  SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'snmp/' || c_nationkey WHEN 1 THEN 'snmp/fs/fs/' || c_nationkey WHEN 2 THEN 'response/10.0.0.' || c_nationkey ELSE 'snmp/alias' || c_nationkey END AS resource,
    c_custkey % 4 AS kind, c_nationkey AS k FROM customer
), hits AS (
  SELECT a.*, CASE WHEN kind IN (0, 1) THEN (SELECT count(*) FROM nation WHERE n_nationkey < 20 AND n_nationkey = k) WHEN kind = 2 THEN (SELECT count(*) FROM nation WHERE n_nationkey % 20 = k) END AS n,
    CASE WHEN kind = 2 THEN (SELECT min(n_nationkey) FROM nation WHERE n_nationkey % 20 = k) ELSE k END AS first FROM asked a
)
SELECT resource, CASE WHEN kind = 3 THEN 'UNKNOWN' WHEN n = 1 THEN 'HIT' WHEN n = 0 THEN 'GONE' ELSE 'UNKNOWN' END AS state, CASE WHEN kind <> 3 AND n = 1 THEN first END AS node_id FROM hits""",
    "scheduled_semi": """
SELECT DISTINCT 'snmp/' || c_nationkey || '/if_' || (c_custkey % 50) || '/x' AS resource FROM customer
WHERE (c_nationkey, c_custkey % 50) IN (SELECT s_nationkey, s_suppkey % 50 FROM supplier WHERE s_suppkey % 3 <> 0)""",
    "missing_anti": f"""
WITH {_WALKED} SELECT dir || '/g' || k AS file, CASE WHEN by_group THEN 'no file for this group' ELSE 'no file for this metric' END AS reason FROM named WHERE k NOT IN (SELECT k FROM files)""",
    "stray_files": f"WITH {_WALKED} SELECT dir || '/' || name AS file, 'no group information' AS reason FROM files WHERE k NOT IN (SELECT k FROM named)",
    "duplicate_pick": f"""
WITH {_WALKED} SELECT dir || '/' || name AS file, dir || '/' || grp AS resource, grp, NULL::VARCHAR AS reason FROM ranked WHERE turn = 1
UNION ALL SELECT dir || '/' || name, NULL, NULL, 'older duplicate of ' || winner FROM ranked WHERE turn > 1""",
    "category_resolution": f"""
WITH {_TAGGED}, firsts AS (SELECT {_NODE} AS place, min(resource) AS first FROM live GROUP BY 1),
segs AS (SELECT {_NODE} AS place, count(DISTINCT segment) AS n, min(segment) AS seg FROM live GROUP BY 1),
looked AS (
  SELECT o.*, first, CASE WHEN n_regionkey < 2 AND first IS NOT NULL THEN 'core' WHEN s.n = 1 THEN s.seg END AS cat, regexp_replace(n_name, '[^a-zA-Z0-9_]', '_', 'g') AS label
  FROM odd o LEFT JOIN firsts f ON f.place = {_NODE} LEFT JOIN segs s ON s.place = {_NODE}
)
SELECT c_custkey, CASE WHEN cat IS NOT NULL THEN 'categories=' || cat WHEN c_custkey % 3 = 0 THEN 'cat_' || label || '=' || n_name || ',cat_a_b=a-b,categories=' || n_name || '\\,a b\\,a-b' WHEN c_custkey % 3 = 1 THEN '' END AS categories,
  CASE WHEN cat IS NOT NULL THEN 'sibling:' || first WHEN c_custkey % 3 < 2 THEN 'rest:node/' || c_custkey END AS category_source FROM looked""",
    "node_json": """
SELECT c_custkey, c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS label, NULL::VARCHAR AS foreign_source, CASE WHEN c_custkey % 7 <> 0 THEN 'a,' || c_mktsegment ELSE '' END AS categories,
  CASE WHEN c_custkey % 7 <> 0 THEN 'buildingName=' || c_mktsegment || ',unitNoX=' || c_custkey ELSE '' END AS assets FROM customer""",
    "batch_packing": f"""
WITH RECURSIVE {_SAMPLES}, p AS (SELECT DISTINCT file, 'd' || (event_id % 3) AS ds, ts FROM samples),
c AS (SELECT *, (row_number() OVER (PARTITION BY file, ds ORDER BY ts) - 1) // 200 AS chunk FROM p),
o AS (SELECT file, ds, chunk, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY ds, chunk) AS r FROM c GROUP BY file, ds, chunk),
packed AS (
  SELECT file, ds, chunk, n, r, 0::BIGINT AS batch, n AS filled FROM o WHERE r = 1
  UNION ALL SELECT o.file, o.ds, o.chunk, o.n, o.r, CASE WHEN q.filled + o.n > 200 THEN q.batch + 1 ELSE q.batch END, CASE WHEN q.filled + o.n > 200 THEN o.n ELSE q.filled + o.n END
  FROM packed q JOIN o ON o.file = q.file AND o.r = q.r + 1
)
SELECT file, ds, chunk, n, batch FROM packed""",
    "plan_order": f"""
WITH {_CLASSIFIED}, every AS (
  SELECT resource || '/value' AS file, CASE WHEN class = 'ORPHAN' THEN 2 ELSE 1 END AS section, split_part(resource, '/', 2)::BIGINT AS cust FROM classified
  UNION ALL SELECT 'snmp/' || o_custkey || '/stray' || o_orderkey, 0, o_custkey FROM orders WHERE o_orderkey % 50 = 0
)
SELECT file, section, row_number() OVER (PARTITION BY cust ORDER BY section, file)::INT AS turn FROM every""",
    "process_outcome": f"""
WITH {_STATES}, {_PROCESSED}
SELECT file, CASE WHEN error IS NULL THEN 'DONE' ELSE 'FAILED' END AS status, CASE WHEN error IS NULL AND file % 2 = 0 THEN 5 ELSE 0 END::BIGINT AS samples,
  CASE WHEN error IS NULL AND file % 2 = 0 THEN 2 ELSE 1 END AS attempts, error FROM judged""",
    "rewrite_count": f"""
WITH {_STATES} SELECT count(*) AS n FROM files f JOIN states s ON s.file = f.file AND s.pass = 'RECENT' WHERE s.status = 'DONE' AND s.label_hash IS NOT NULL AND s.label_hash <> f.label_hash""",
    "verify_read_errors": f"""
WITH {_EXPECTED} SELECT o_orderkey::VARCHAR AS what, 'read' AS kind FROM orders WHERE o_orderkey % 89 = 0 OR o_orderkey % 97 = 0
UNION ALL SELECT DISTINCT canon, 'read' FROM expected WHERE canon >= 's'""",
    "root_counts": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'response' ELSE 'snmp' END AS root, count(*) AS n FROM orders GROUP BY 1",
    "label_hash": """
WITH e AS (SELECT l_orderkey AS file, 'ds' || l_linenumber AS ds, '{part=' || l_partkey || ', supplier=' || l_suppkey || '}' AS t FROM lineitem)
SELECT file, sha256(string_agg(ds || chr(10) || t || chr(10), '' ORDER BY ds, t)) AS label_hash FROM e GROUP BY file""",
    "config_hash": """
SELECT sha256(string_agg('tag.' || lower(n_name) || '=${node:label}-' || n_regionkey || chr(10), '' ORDER BY lower(n_name)) || 'exposeCategories=true' || chr(10)) AS config_hash FROM nation""",
    "expected_keys": f"SELECT DISTINCT {_LABEL.format('lower(n_name)')} AS label FROM nation UNION SELECT 'categories'",
    "sanitize_names": f"SELECT page_id, {_METRIC.format('url')} AS metric, {_LABEL.format('url')} AS label, {_METRIC.format('page_id::VARCHAR')} AS numbered FROM pages",
    "truncate_label_value": "SELECT doc_id, sha256(substring(text, 1, 2048)) AS value_sha256, length(substring(text, 1, 2048)) AS n FROM documents",
    "resource_paths": f"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', 'snmp/'), '\\?.*$', '') AS u FROM pages),
r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'snmp/fs/a/' || u WHEN 1 THEN 'snmp/' || page_id || '/' || u ELSE u END AS r FROM p)
SELECT page_id, {_PREFIX.format("r")} AS node, regexp_extract(r, '^(.*)/[^/]*$', 1) AS dir, regexp_matches(r, '^snmp/[^/]+/') AND NOT regexp_matches(r, '^snmp/(fs|[0-9]+)/') AS aliased FROM r""",
    "tag_scopes": """
SELECT n_nationkey, i, s AS scope FROM nation, (VALUES (0, 'CONSTANT'), (1, 'NODE'), (2, 'INTERFACE'), (3, 'METADATA'), (4, 'SERVICE'), (5, 'RESOURCE'), (6, 'UNCLASSIFIED'), (7, 'UNCLASSIFIED')) f(i, s)""",
    "node_expressions": """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE c_name END AS label, 'id ' || CASE WHEN c_custkey % 2 = 0 THEN 'fs:' || c_custkey ELSE c_custkey::VARCHAR END AS criteria,
  c_mktsegment || '!' AS asset, NULL::VARCHAR AS unknown, CASE WHEN c_custkey % 2 = 0 THEN 'fs' ELSE 'standby' END AS literal
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "interface_labels": """
WITH p AS (SELECT *, CASE WHEN p_partkey % 5 IN (1, 2) THEN '-0011223344' || (p_partkey % 90 + 10) WHEN p_partkey % 5 = 3 THEN '-0011 223 44' || left((p_partkey % 90 + 10)::VARCHAR, 1) ELSE '' END AS mac FROM part)
SELECT p_partkey, regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END, '[^a-zA-Z0-9]', '_', 'g') || mac AS by_name, p_type || mac AS by_descr FROM p""",
    "selectors": f"""
SELECT page_id, {_Q.format(_HARD)} AS quoted, {_RX.format(_HARD)} AS escaped, '{{a="' || page_id || '",url="' || {_Q.format(_HARD)} || '"}}' AS exact,
  '{{resourceId=~"' || {_Q.format(_RX.format(_HARD))} || '/.+"}}' AS prefix FROM pages""",
    "prefix_match": """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^(.*)/[^/]*$', 1) AS d1 FROM pages), q AS (SELECT *, regexp_extract(d1, '^(.*)/[^/]*$', 1) AS d2 FROM p),
c AS (SELECT page_id, url, unnest([d1, d2]) AS prefix FROM q)
SELECT prefix, count(DISTINCT page_id) AS n FROM c WHERE prefix IN (SELECT d1 FROM p) AND starts_with(url, prefix || '/') AND length(url) > length(prefix) + 1 GROUP BY prefix""",
    "html_escape": """SELECT page_id, sha256(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html_sha256 FROM pages""",
    "backoff_schedule": "SELECT a AS attempt, least(60, 1 << least(6, a - 1))::BIGINT AS seconds, 420 + a = 429 OR 420 + a >= 500 AS retryable FROM range(1, 21) t(a)",
    "lenient_double": """
WITH w AS (SELECT conv_id, turn, unnest([str_split(text, ' ')[1], conv_id || '.5e1', '1_0']) AS w FROM conversations)
SELECT conv_id, turn, w, CASE WHEN regexp_matches(trim(w), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trim(w) AS DOUBLE) END AS value FROM w""",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k') AS k, len(list_filter(json_keys(props), lambda x: json_extract_string(props, '$.' || x) <> '')) AS n FROM events",
    "checkpoint_last_wins": f"WITH {_STATES} SELECT file, pass, line, status, samples, attempts, label_hash FROM states",
    "resume_filter": f"""
WITH {_STATES}, s AS (SELECT f.*, s.status, coalesce(s.status = 'DONE' AND s.label_hash IS NOT NULL AND s.label_hash <> f.label_hash, false) AS rewrite FROM files f LEFT JOIN states s ON s.file = f.file AND s.pass = 'RECENT')
SELECT file, label_hash, rewrite FROM s WHERE status IS NULL OR rewrite""",
    "resume_failed": f"WITH {_STATES} SELECT f.file, f.label_hash, false AS rewrite FROM files f JOIN states s ON s.file = f.file AND s.pass = 'RECENT' WHERE s.status = 'FAILED'",
    "batch_slices": f"""
WITH {_SAMPLES}, p AS (SELECT DISTINCT file, ts FROM samples), c AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY ts) - 1) // 200 AS chunk FROM p)
SELECT file, chunk, count(*) AS n, min(ts) AS first_ts FROM c GROUP BY ALL""",
    "file_order": "SELECT l_orderkey AS file, bool_or(l_returnflag = 'N') AS has_orphan, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1",
    "canary_sample": "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('17:' || c_custkey), c_custkey) <= 5",
    "live_after_cutover": f"WITH {_SAMPLES} SELECT DISTINCT file || (event_id % 50) AS canon FROM samples WHERE ts > (SELECT max(ts) FROM samples) - 7200",
    "completeness": f"""
WITH {_STATES}, ok AS (SELECT f.file FROM files f JOIN states s USING (file) WHERE s.status = 'DONE' AND (s.label_hash IS NULL OR s.label_hash = f.label_hash) GROUP BY f.file HAVING count(DISTINCT pass) = 2)
SELECT file FROM files WHERE file NOT IN (SELECT file FROM ok)""",
    "not_migrated_counts": f"WITH {_CLASSIFIED} SELECT class, count(*) AS n FROM classified WHERE NOT written GROUP BY class",
    "verify_compare": f"""
WITH {_EXPECTED}, g AS (SELECT canon, ts, CASE WHEN ts % 7 = 0 THEN cents + 1 ELSE cents END::DOUBLE / 100 AS got FROM expected WHERE ts % 11 <> 0),
b AS (SELECT e.canon, e.ts, counter, cents::DOUBLE / 100 AS v, got FROM expected e LEFT JOIN g ON g.canon = e.canon AND g.ts = e.ts),
w AS (SELECT *, lag(v) OVER o AS v0, lag(got) OVER o AS g0 FROM b WINDOW o AS (PARTITION BY canon ORDER BY ts)),
k AS (SELECT canon, ts, CASE WHEN got IS NULL THEN 'missing' WHEN NOT counter AND NOT (v = got OR abs(v - got) <= 1e-3::DOUBLE * greatest(abs(v), abs(got))) THEN 'value'
  WHEN counter AND v0 IS NOT NULL AND g0 IS NOT NULL AND NOT (abs((got - g0) - (v - v0)) <= 1e-3::DOUBLE * greatest(abs(v), abs(got), abs(v0), abs(g0))) THEN 'delta' END AS kind FROM w)
SELECT * FROM k WHERE kind IS NOT NULL""",
    "verify_counter_delta": f"""
WITH {_EXPECTED}, t AS (SELECT canon, ts, sum(cents) OVER (PARTITION BY canon ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM expected),
b AS (SELECT canon, ts, total::DOUBLE AS v, (total + 5000 + CASE WHEN ts % 13 = 0 THEN 100000 ELSE 0 END)::DOUBLE AS got FROM t),
w AS (SELECT *, lag(v) OVER o AS v0, lag(got) OVER o AS g0 FROM b WINDOW o AS (PARTITION BY canon ORDER BY ts))
SELECT canon, ts, 'delta' AS kind FROM w WHERE v0 IS NOT NULL AND NOT (abs((got - g0) - (v - v0)) <= 1e-9::DOUBLE * greatest(abs(v), abs(got), abs(v0), abs(g0)))""",
    "verify_select": f"""
WITH {_STATES}, n AS (SELECT greatest(1, ceil(count(*) * 1.0 / 100)) AS n FROM files),
d AS (SELECT file FROM files QUALIFY row_number() OVER (ORDER BY md5('1:' || file), file) <= (SELECT n FROM n))
SELECT file FROM d UNION SELECT file FROM states WHERE attempts > 1""",
    "class_summary": f"WITH {_CLASSIFIED} SELECT class, count(*) FILTER (written) AS written, count(*) FILTER (NOT written) AS not_written FROM classified GROUP BY class",
    "label_coverage": f"""
WITH {_CLASSIFIED}, c AS (SELECT count(*) FILTER (class = 'MATCHED') AS "MATCHED", count(*) FILTER (class = 'EXPORTED') AS "EXPORTED", count(*) AS total FROM classified WHERE written)
SELECT unnest(['__name__', 'mtype', 'resourceId', 'supplier']) AS label, * FROM c""",
    "unresolved_by_node": f"""
WITH {_ORPHANS} SELECT {_NODE} AS node, count(*) AS n, CASE WHEN bool_or(c_custkey % 3 = 0) THEN 'rack,site' ELSE 'site' END AS tags FROM orphans WHERE c_custkey % 5 < 3 GROUP BY 1""",
    "capped_list": "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1000",
    "eta_estimate": f"""
WITH {_SAMPLES}, s AS (SELECT count(DISTINCT file) AS series, count(*) * 1000 AS samples, min(ts) AS oldest FROM samples)
SELECT *, (samples // 500 // 3600) || 'h ' || (samples // 500 % 3600 // 60) || 'm' AS eta FROM s""",
    "not_migrated_list": f"""
WITH {_CLASSIFIED} SELECT class, resource AS what, 'value' AS ds, CASE class WHEN 'FAILED_READ' THEN error WHEN 'SKIPPED' THEN 'data sources of type ' || ds_type || ' are not supported'
  WHEN 'AMBIGUOUS' THEN found || CASE WHEN n_live > 0 THEN ' live label sets' ELSE ' exported label sets' END
  WHEN 'MTYPE_MISMATCH' THEN 'the label mtype is ' || said || ', the data source is ' || ds_type END AS note FROM classified WHERE NOT written""",
    "orphan_resources": f"WITH {_CLASSIFIED} SELECT DISTINCT resource FROM classified WHERE class = 'ORPHAN'",
    "explain_resource": f"""
WITH {_SETS}, f AS (SELECT * FROM sets WHERE resource = (SELECT min(resource) FROM sets))
SELECT 'acctbal' AS ds, 'MATCHED' AS class, unnest(['resourceId', '__name__', 'segment', 'node', 'mtype']) AS label, unnest([resource, 'acctbal', segment, n_name, mtype]) AS value, 'live' AS source, 'live' AS note FROM f""",
    "iso_instants": f"WITH {_SAMPLES} SELECT event_id, {_ISO.format('ts')} AS instant FROM samples",
    "colliding_names": """
WITH p AS (SELECT DISTINCT 'p' || CASE WHEN page_id % 2 = 0 THEN '.' ELSE '-' END || (page_id // 2) AS ds FROM pages)
SELECT ds FROM p QUALIFY count(*) OVER (PARTITION BY regexp_replace(ds, '[^a-zA-Z0-9_:]', '_', 'g')) > 1""",
}
