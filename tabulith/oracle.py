"""ANSI SQL for DuckDB with the same results as the queries of ``queries``."""

from __future__ import annotations

SNAPS = """s AS (SELECT * FROM snapshots WHERE snapshot_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY recorded_at DESC) = 1)"""
META = """m AS (SELECT table_uuid, format_version, last_updated_ms, nullif(current_snapshot_id, -1) AS cur FROM table_metadata QUALIFY row_number() OVER (PARTITION BY table_uuid ORDER BY last_updated_ms DESC) = 1)"""
LINKS = f"""{SNAPS}, n AS (SELECT s.table_uuid, s.snapshot_id, p.snapshot_id AS parent FROM s LEFT JOIN s p ON p.snapshot_id = s.parent_snapshot_id AND p.table_uuid = s.table_uuid),
r AS (SELECT snapshot_id, snapshot_id AS root, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.snapshot_id, r.root, r.depth + 1 FROM r JOIN n ON n.parent = r.snapshot_id)"""
ABOVE = """a AS (SELECT snapshot_id AS v, parent AS u, 1 AS dist FROM n WHERE parent IS NOT NULL UNION ALL SELECT a.v, n.parent, a.dist + 1 FROM a JOIN n ON n.snapshot_id = a.u JOIN r ON r.snapshot_id = a.v WHERE n.parent IS NOT NULL)"""
PAIRS = """a AS (SELECT snapshot_id AS v, parent AS u FROM n WHERE parent IS NOT NULL UNION SELECT a.v, n.parent FROM a JOIN n ON n.snapshot_id = a.u WHERE n.parent IS NOT NULL)"""


def same_file(c: str) -> str:
    rest = f"regexp_replace(regexp_replace(regexp_replace({c}, '^[A-Za-z][A-Za-z0-9+.-]*:/', '/'), '(/\\./)(\\./)*', '/', 'g'), '/+', '/', 'g')"
    scheme = f"regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*):/', 1)"
    return f"CASE WHEN {scheme} = '' THEN {rest} WHEN {scheme} IN ('s3a', 's3n') THEN 's3:' || {rest} ELSE {scheme} || ':' || {rest} END"


NODES = """held AS (SELECT table_uuid, schema_id, schema_json AS j FROM table_schemas WHERE json_valid(schema_json) AND schema_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY table_uuid, schema_id ORDER BY recorded_at DESC) = 1),
f AS (
  SELECT table_uuid, schema_id, unnest(json_extract(j, '$.fields[*]')) AS f FROM held
  UNION ALL
  SELECT table_uuid, schema_id, unnest(CASE f->'type'->>'type'
    WHEN 'struct' THEN json_extract(f, '$.type.fields[*]')
    WHEN 'list' THEN [json_object('id', f->'type'->'element-id', 'name', 'element', 'type', f->'type'->'element', 'required', f->'type'->'element-required')]
    WHEN 'map' THEN [json_object('id', f->'type'->'key-id', 'name', 'key', 'type', f->'type'->'key', 'required', true), json_object('id', f->'type'->'value-id', 'name', 'value', 'type', f->'type'->'value', 'required', f->'type'->'value-required')]
    ELSE CAST([] AS JSON[]) END)
  FROM f WHERE json_type(f->'type') = 'OBJECT'),
x AS (SELECT table_uuid, schema_id, CAST(f->>'id' AS INT) AS field_id, f->>'name' AS name, coalesce(f->>'required', 'false') AS req, CASE json_type(f->'type') WHEN 'OBJECT' THEN f->'type'->>'type' ELSE replace(f->>'type', ' ', '') END AS kind FROM f),
v AS (SELECT table_uuid, schema_id, lag(schema_id) OVER (PARTITION BY table_uuid ORDER BY schema_id) AS prev FROM held),
w AS (SELECT v.*, x.field_id, x.name, x.req, x.kind FROM v JOIN x ON x.table_uuid = v.table_uuid AND x.schema_id = v.schema_id WHERE prev IS NOT NULL),
o AS (SELECT v.table_uuid, v.schema_id, x.field_id, x.name, x.req, x.kind FROM v JOIN x ON x.table_uuid = v.table_uuid AND x.schema_id = v.prev)"""

# the same with the parent of each field
TREE = NODES.replace("SELECT table_uuid, schema_id, unnest(json_extract(j, '$.fields[*]')) AS f FROM held", "SELECT table_uuid, schema_id, CAST(NULL AS INT) AS parent, unnest(json_extract(j, '$.fields[*]')) AS f FROM held").replace("SELECT table_uuid, schema_id, unnest(CASE", "SELECT table_uuid, schema_id, CAST(f->>'id' AS INT), unnest(CASE").replace("x AS (SELECT table_uuid, schema_id,", "x AS (SELECT table_uuid, schema_id, parent,").replace("v.*, x.field_id,", "v.*, x.parent, x.field_id,").replace("v.schema_id, x.field_id,", "v.schema_id, x.parent, x.field_id,")
SAME = "o.table_uuid = w.table_uuid AND o.schema_id = w.schema_id AND o.field_id = w.field_id"
PICKED = f"""recs AS (SELECT record_id, table_uuid, schema_id AS said, {same_file("file_path")} AS file, payload FROM data_rows WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY recorded_at DESC) = 1),
k AS (SELECT DISTINCT table_uuid, file, said, unnest(json_keys(payload)) AS name FROM recs),
top AS (SELECT table_uuid, schema_id AS v, name, count(*) OVER (PARTITION BY table_uuid, schema_id) AS width FROM x WHERE parent IS NULL),
fit AS (SELECT k.table_uuid, file, said FROM k LEFT JOIN top ON top.table_uuid = k.table_uuid AND top.v = k.said AND top.name = k.name GROUP BY ALL HAVING said IS NULL OR count(top.name) < count(*)),
score AS (SELECT k.table_uuid, k.file, k.said, top.v, any_value(top.width) AS width, count(*) AS m FROM k JOIN fit ON fit.table_uuid = k.table_uuid AND fit.file IS NOT DISTINCT FROM k.file AND fit.said IS NOT DISTINCT FROM k.said JOIN top ON top.table_uuid = k.table_uuid AND top.name = k.name GROUP BY ALL),
best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY table_uuid, file, said ORDER BY m DESC, CASE WHEN v = said THEN 0 ELSE 1 END, width, v DESC) = 1),
picked AS (SELECT recs.*, coalesce(best.v, recs.said) AS used FROM recs LEFT JOIN best ON best.table_uuid = recs.table_uuid AND best.file IS NOT DISTINCT FROM recs.file AND best.said IS NOT DISTINCT FROM recs.said)"""

LIVE = f"""{META}, {SNAPS}, l AS (SELECT m.table_uuid, {same_file("s.manifest_list")} AS list FROM m JOIN s ON s.table_uuid = m.table_uuid AND s.snapshot_id = m.cur WHERE s.expired_at IS NULL AND s.manifest_list <> ''),
f AS (SELECT table_uuid, {same_file("manifest_list")} AS list, {same_file("manifest_path")} AS path, partition_spec_id, coalesce(content, 0) AS content, manifest_length, added_files_count + existing_files_count AS entries, recorded_at FROM manifest_files),
g AS (SELECT f.* FROM f JOIN l ON l.table_uuid = f.table_uuid AND l.list = f.list QUALIFY row_number() OVER (PARTITION BY f.table_uuid, f.list, path ORDER BY recorded_at DESC) = 1),
live AS (SELECT * FROM g WHERE entries IS NULL OR entries <> 0)"""

MANIFEST_COLUMNS = ("format_version", "manifest_list", "manifest_path", "manifest_length", "partition_spec_id", "content", "sequence_number", "min_sequence_number", "added_snapshot_id", "added_files_count", "existing_files_count", "deleted_files_count", "added_rows_count", "existing_rows_count", "deleted_rows_count", "partitions", "recorded_at")
PLACES = "SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate) DESC NULLS LAST, o_orderkey) AS INT) AS place FROM orders"
MONTH = "strftime(make_timestamp({} * 1000), '%Y-%m')"
ORPHANS = f"""{META}, {SNAPS}, u AS (SELECT * FROM s WHERE expired_at IS NULL),
q AS (SELECT * FROM snapshot_refs QUALIFY row_number() OVER (PARTITION BY table_uuid, ref_name ORDER BY recorded_at DESC) = 1),
lists AS (SELECT DISTINCT {same_file("manifest_list")} AS list FROM manifest_files WHERE manifest_list IS NOT NULL),
res AS (
SELECT table_uuid, 'current_snapshot' AS ref_kind, table_uuid AS from_key, {MONTH.format("last_updated_ms")} AS month_utc FROM m WHERE cur IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.table_uuid = m.table_uuid AND u.snapshot_id = m.cur)
UNION ALL SELECT table_uuid, 'ref', ref_name, strftime(recorded_at, '%Y-%m') FROM q WHERE snapshot_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.table_uuid = q.table_uuid AND u.snapshot_id = q.snapshot_id)
UNION ALL SELECT table_uuid, 'schema', CAST(snapshot_id AS VARCHAR), {MONTH.format("timestamp_ms")} FROM u WHERE schema_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM table_schemas t WHERE t.table_uuid = u.table_uuid AND t.schema_id = u.schema_id)
UNION ALL SELECT table_uuid, 'manifest_list', CAST(snapshot_id AS VARCHAR), {MONTH.format("timestamp_ms")} FROM u WHERE manifest_list <> '' AND NOT EXISTS (SELECT 1 FROM lists WHERE list = {same_file("u.manifest_list")}))"""


def _unwrap(x: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract({x}, '$.{n}')" for n in names) + f", {x})"


def _array(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE CAST([] AS JSON[]) END"


RAW = f"""d AS (SELECT record_id, table_uuid, record_json AS j FROM manifest_lists_raw), e AS (SELECT record_id, table_uuid, CASE json_type(j) WHEN 'VARCHAR' THEN CAST(json_extract_string(j, '$') AS JSON) ELSE CAST(j AS JSON) END AS j FROM d),
ma AS (SELECT record_id, {_array("(" + _unwrap("json_extract(j, '$.manifests')", "array") + ")")} AS a FROM e),
mm AS (SELECT record_id, unnest(a) AS m, unnest(range(len(a))) AS manifest_pos FROM ma),
sa AS (SELECT record_id, manifest_pos, {_array("(" + _unwrap("json_extract(m, '$.partitions')", "array") + ")")} AS a FROM mm WHERE json_type(m) = 'OBJECT'),
su AS (SELECT record_id, manifest_pos, unnest(a) AS p, unnest(range(len(a))) AS summary_pos FROM sa),
ss AS (SELECT record_id, CAST(manifest_pos AS INT) AS manifest_pos, CAST(summary_pos AS INT) AS summary_pos, {_unwrap("json_extract(p, '$.contains_null')", "boolean")} AS cnull, {_unwrap("json_extract(p, '$.contains_nan')", "boolean")} AS cnan, {_unwrap("json_extract(p, '$.lower_bound')", "bytes")} AS lo, {_unwrap("json_extract(p, '$.upper_bound')", "bytes")} AS hi FROM su WHERE json_type(p) = 'OBJECT')"""


def _bool(x: str) -> str:
    return f"CASE CAST({x} AS VARCHAR) WHEN 'true' THEN true WHEN 'false' THEN false END"


def _txt(x: str) -> str:
    return f"CASE WHEN json_type({x}) <> 'NULL' THEN json_extract_string({x}, '$') END"


def _num(name: str, kind: str = "BIGINT") -> str:
    return f"TRY_CAST(json_extract_string({_unwrap(f'json_extract(m, $${name}$$)', 'long', 'int')}, '$') AS {kind})".replace(f"$${name}$$", f"'$.{name}'")


def sql() -> dict[str, str]:
    counts = ("added_data_files_count", "existing_data_files_count", "deleted_data_files_count", "added_rows_count", "existing_rows_count", "deleted_rows_count")
    out = {
        "p1_found": f"WITH RECURSIVE {LINKS} SELECT n.snapshot_id, coalesce(r.root, -1) AS root_snapshot_id, CAST(coalesce(r.depth, -1) AS INT) AS depth FROM n LEFT JOIN r ON r.snapshot_id = n.snapshot_id",
        "p1_hierarchy": f"""WITH RECURSIVE {LINKS}, {PAIRS}, c AS (SELECT parent, count(*) AS k FROM n WHERE parent IS NOT NULL GROUP BY parent), b AS (SELECT u, count(*) AS k FROM a GROUP BY u), o AS (SELECT DISTINCT v FROM a WHERE v = u)
SELECT n.snapshot_id, n.table_uuid, n.parent AS parent_snapshot_id, r.root, CAST(r.depth AS BIGINT) AS depth, o.v IS NOT NULL AS on_circle, r.root IS NULL AND o.v IS NULL AS below_circle, coalesce(c.k, 0) AS n_children, CASE WHEN o.v IS NULL THEN coalesce(b.k, 0) END AS n_descendants
FROM n LEFT JOIN r ON r.snapshot_id = n.snapshot_id LEFT JOIN c ON c.parent = n.snapshot_id LEFT JOIN b ON b.u = n.snapshot_id LEFT JOIN o ON o.v = n.snapshot_id""",
        "p1_paths": f"""WITH RECURSIVE {LINKS}, {ABOVE}, al AS (SELECT v, u, dist FROM a UNION ALL SELECT snapshot_id, snapshot_id, 0 FROM r),
p AS (SELECT al.v, string_agg(CAST(u AS VARCHAR), ',' ORDER BY dist DESC) FILTER (dist <= r.depth % 32) AS tail, max(u) FILTER (dist = r.depth % 32 + 1) AS nxt FROM al JOIN r ON r.snapshot_id = al.v GROUP BY al.v)
SELECT n.snapshot_id, CAST(r.depth AS BIGINT) AS depth, p.tail AS path_tail, p.nxt AS path_next FROM n LEFT JOIN r ON r.snapshot_id = n.snapshot_id LEFT JOIN p ON p.v = n.snapshot_id""",
        "p1_descendants": f"""WITH RECURSIVE {LINKS}, {PAIRS}, o AS (SELECT DISTINCT v FROM a WHERE v = u), b AS (SELECT u, count(*) AS k FROM a GROUP BY u),
t AS (SELECT n.snapshot_id AS v, n.snapshot_id AS top, [n.snapshot_id] AS line FROM n LEFT JOIN o q ON q.v = n.parent LEFT JOIN o ON o.v = n.snapshot_id WHERE o.v IS NULL AND (n.parent IS NULL OR q.v IS NOT NULL) UNION ALL SELECT n.snapshot_id, t.top, list_append(t.line, n.snapshot_id) FROM t JOIN n ON n.parent = t.v),
p AS (SELECT v, top, row_number() OVER (PARTITION BY top ORDER BY line) - 1 AS first FROM t)
SELECT n.snapshot_id, p.top, p.first, p.first + coalesce(b.k, 0) AS last FROM n LEFT JOIN p ON p.v = n.snapshot_id LEFT JOIN b ON b.u = n.snapshot_id""",
        "p2_found": f"""WITH RECURSIVE {NODES}
SELECT table_uuid, schema_id, field_id, 'added' AS change FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.table_uuid = w.table_uuid AND o.schema_id = w.schema_id AND o.field_id = w.field_id)
UNION SELECT table_uuid, schema_id, field_id, 'removed' FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE o.table_uuid = w.table_uuid AND o.schema_id = w.schema_id AND o.field_id = w.field_id)
UNION SELECT w.table_uuid, w.schema_id, w.field_id, unnest(list_filter([CASE WHEN w.name <> o.name THEN 'renamed' END, CASE WHEN w.kind <> o.kind THEN 'type' END, CASE WHEN w.req <> o.req THEN 'required' END], lambda c: c IS NOT NULL)) FROM w JOIN o ON o.table_uuid = w.table_uuid AND o.schema_id = w.schema_id AND o.field_id = w.field_id""",
        "p2_script": f"""WITH RECURSIVE {TREE}
SELECT table_uuid AS t, schema_id AS v, prev, field_id, 'added' AS change, CAST(NULL AS VARCHAR) AS before, name AS after FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE {SAME})
UNION ALL SELECT o.table_uuid, o.schema_id, v.prev, o.field_id, 'removed', o.name, NULL FROM o JOIN v ON v.table_uuid = o.table_uuid AND v.schema_id = o.schema_id WHERE v.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE {SAME})
UNION ALL SELECT w.table_uuid, w.schema_id, w.prev, w.field_id, c.what, c.before, c.after FROM (SELECT w.*, unnest([
  {{'what': 'renamed', 'before': o.name, 'after': w.name}}, {{'what': 'type', 'before': o.kind, 'after': w.kind}}, {{'what': 'required', 'before': upper(o.req[1]) || o.req[2:], 'after': upper(w.req[1]) || w.req[2:]}},
  {{'what': 'moved', 'before': coalesce(CAST(o.parent AS VARCHAR), 'None'), 'after': coalesce(CAST(w.parent AS VARCHAR), 'None')}}]) AS c FROM w JOIN o ON {SAME}) w WHERE c.before <> c.after""",
        "p2_values": f"""WITH RECURSIVE {TREE}, {PICKED}, r AS (SELECT record_id, table_uuid, used, CAST(NULL AS INT) AS id, 'struct' AS wrote, CAST(payload AS JSON) AS j FROM picked
UNION ALL SELECT e.record_id, e.table_uuid, e.used, x.field_id, x.kind, e.j FROM (SELECT record_id, table_uuid, used, id, k AS key, json_extract(j, '$."' || k || '"') AS j FROM (SELECT *, unnest(json_keys(j)) AS k FROM r WHERE wrote = 'struct' AND json_type(j) = 'OBJECT')) e
  JOIN x ON x.table_uuid = e.table_uuid AND x.schema_id = e.used AND x.name = e.key AND x.parent IS NOT DISTINCT FROM e.id WHERE json_type(e.j) <> 'NULL'),
u AS (SELECT table_uuid, field_id, arg_max(name, schema_id) AS name, arg_max(kind, schema_id) AS kind FROM x GROUP BY ALL),
y AS (SELECT r.record_id, r.used, r.id, u.name, u.kind, r.j, json_extract_string(r.j, '$') AS t FROM r JOIN u ON u.table_uuid = r.table_uuid AND u.field_id = r.id WHERE r.wrote <> 'struct')
SELECT record_id, used AS used_schema_id, id AS field_id, name, kind, CASE WHEN kind IN ('int', 'long') THEN TRY_CAST(t AS BIGINT) END AS whole, CASE WHEN kind IN ('float', 'double') OR kind LIKE 'decimal%' THEN TRY_CAST(t AS DOUBLE) END AS number,
CASE WHEN kind = 'boolean' THEN CASE lower(t) WHEN 'true' THEN true WHEN 'false' THEN false END END AS flag, CASE WHEN kind LIKE 'timestamp%' THEN epoch_us(TRY_CAST(t AS TIMESTAMP)) END AS micros, CASE WHEN kind = 'date' THEN TRY_CAST(t AS DATE) END AS day,
CASE WHEN kind IN ('string', 'uuid', 'time', 'binary') OR kind LIKE 'fixed%' THEN t END AS text, CAST(CASE WHEN kind = 'list' AND json_type(j) = 'ARRAY' THEN json_array_length(j) WHEN kind = 'map' AND json_type(j) = 'OBJECT' THEN len(json_keys(j)) END AS INT) AS n_parts FROM y""",
        "p3_found": f"WITH {LIVE} SELECT table_uuid, partition_spec_id, content FROM live GROUP BY ALL HAVING count(*) >= 10 AND avg(manifest_length) < 1048576",
        "p3_assignment": f"""WITH {LIVE}, need AS (SELECT table_uuid, partition_spec_id, content FROM live GROUP BY ALL HAVING count(*) >= 10 AND avg(manifest_length) < 1048576),
t AS (SELECT live.*, need.table_uuid IS NOT NULL AND manifest_length < 6291456 AS moved FROM live LEFT JOIN need USING (table_uuid, partition_spec_id, content))
SELECT table_uuid, partition_spec_id, content, path, manifest_length, CAST(entries AS BIGINT) AS entries, CASE WHEN moved THEN 0 END AS piece, CASE WHEN moved THEN CAST(floor((sum(CASE WHEN moved THEN manifest_length END) OVER (PARTITION BY table_uuid, partition_spec_id, content, moved ORDER BY manifest_length DESC, path ROWS UNBOUNDED PRECEDING) - manifest_length / 2) / 8388608) AS INT) END AS bin FROM t""",
        "p3_consolidated": f"""WITH {LIVE}, need AS (SELECT table_uuid, partition_spec_id, content FROM live GROUP BY ALL HAVING count(*) >= 10 AND avg(manifest_length) < 1048576),
t AS (SELECT live.* FROM live JOIN need USING (table_uuid, partition_spec_id, content) WHERE manifest_length < 6291456),
q AS (SELECT *, floor((sum(manifest_length) OVER (PARTITION BY table_uuid, partition_spec_id, content ORDER BY manifest_length DESC, path ROWS UNBOUNDED PRECEDING) - manifest_length / 2) / 8388608) AS bin FROM t)
SELECT table_uuid, partition_spec_id, content, count(*) AS n_before, count(DISTINCT bin) AS n_after, count(*) AS n_blocks, count(*) AS n_records FROM q GROUP BY ALL""",
        "p3_blockcopy_columns": "SELECT table_uuid, " + ", ".join(f"count({c}) AS n_{c}" for c in MANIFEST_COLUMNS) + ", CAST(sum(coalesce(list_sum(list_transform(partitions, lambda p: 1 + coalesce(octet_length(p.lower_bound), 0) + coalesce(octet_length(p.upper_bound), 0))), 0)) AS BIGINT) AS n_bound_bytes, max(recorded_at) AS latest FROM manifest_files GROUP BY table_uuid",
        "p3_blockcopy": "SELECT table_uuid, count(*) AS n_rows, count(DISTINCT manifest_path) AS n_paths, CAST(sum(manifest_length) AS BIGINT) AS n_bytes FROM manifest_files GROUP BY table_uuid",
        "p4_found": f"WITH {ORPHANS} SELECT DISTINCT * FROM res",
        "p4_counts": f"WITH {ORPHANS} SELECT table_uuid, ref_kind, month_utc, count(DISTINCT from_key) AS n_orphans FROM res GROUP BY ALL",
        "p5_found": f"WITH {RAW} SELECT DISTINCT record_id, manifest_pos, summary_pos, CASE CAST(cnan AS VARCHAR) WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE -1 END AS nan_flag, CASE WHEN lo IS NULL OR json_type(lo) = 'NULL' THEN 0 ELSE 1 END AS has_lower FROM ss",
        "p5_summaries": f"WITH {RAW} SELECT DISTINCT record_id, manifest_pos, summary_pos, {_bool('cnull')} AS contains_null, {_bool('cnan')} AS contains_nan, {_txt('lo')} AS lower_bound, {_txt('hi')} AS upper_bound FROM ss",
        "p5_manifests": f"WITH {RAW} SELECT DISTINCT record_id, CAST(manifest_pos AS INT) AS manifest_pos, json_extract_string(m, '$.manifest_path') AS manifest_path, {_num('manifest_length')} AS manifest_length, {_num('partition_spec_id', 'INT')} AS partition_spec_id, {_num('added_snapshot_id')} AS added_snapshot_id, {', '.join(f'{_num(c)} AS {c}' for c in counts)} FROM mm WHERE json_type(m) = 'OBJECT'",
        "p5_lists": f"WITH {RAW} SELECT DISTINCT record_id, table_uuid, CAST(j->>'format-version' AS INT) AS format_version, j->'table'->>'uuid' AS list_table_uuid, j->'table'->>'name' AS table_name, CAST(j->'snapshot'->>'snapshot-id' AS BIGINT) AS snapshot_id, CAST(j->'snapshot'->>'timestamp-ms' AS BIGINT) AS timestamp_ms FROM e",
        "p5_partitions": "WITH t AS (SELECT table_uuid, manifest_list, manifest_path, unnest(partitions) AS p, CAST(unnest(range(len(partitions))) AS INT) AS pos FROM (SELECT * FROM manifest_files QUALIFY row_number() OVER (PARTITION BY table_uuid, manifest_list, manifest_path ORDER BY recorded_at DESC) = 1)) SELECT table_uuid, manifest_list, manifest_path, pos, p.contains_null AS contains_null, p.contains_nan AS contains_nan, lower(hex(p.lower_bound)) AS lower_bound, lower(hex(p.upper_bound)) AS upper_bound FROM t WHERE p IS NOT NULL",
        "p6_found": f"""WITH {META}, c AS (SELECT s.table_uuid, snapshot_id, sequence_number, expired_at, recorded_at, CAST((parent_snapshot_id, sequence_number, timestamp_ms, manifest_list, schema_id, list_sort(map_entries(summary)), expired_at) AS VARCHAR) AS content FROM snapshots s JOIN m ON m.table_uuid = s.table_uuid AND m.format_version = 2 WHERE snapshot_id IS NOT NULL),
g AS (SELECT *, min(recorded_at) OVER (PARTITION BY snapshot_id, table_uuid, content) AS first FROM c QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY recorded_at DESC) = 1),
ad AS (SELECT table_uuid, added_snapshot_id, max(sequence_number) AS q FROM manifest_files GROUP BY ALL),
h AS (SELECT g.table_uuid, g.snapshot_id, g.first, coalesce(g.sequence_number, ad.q) AS seq FROM g LEFT JOIN ad ON ad.table_uuid = g.table_uuid AND ad.added_snapshot_id = g.snapshot_id WHERE g.expired_at IS NULL)
SELECT table_uuid, snapshot_id FROM h WHERE NOT EXISTS (SELECT 1 FROM ingest_runs i WHERE i.table_uuid = h.table_uuid AND status = 'succeeded' AND from_sequence < seq AND seq <= to_sequence AND started_at >= h.first)""",
        "p6_replay": f"""WITH v AS ({" UNION ALL ".join(f"(SELECT {i} AS run, snapshot_id, table_uuid, parent_snapshot_id, manifest_list FROM snapshots {w} QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY recorded_at DESC) = 1)" for i, w in enumerate(("WHERE recorded_at < TIMESTAMP '2024-01-01'", "WHERE recorded_at < TIMESTAMP '2024-07-01'", "")))}),
p AS (SELECT *, lag((table_uuid, parent_snapshot_id, manifest_list)) OVER (PARTITION BY snapshot_id ORDER BY run) AS was, lag(run) OVER (PARTITION BY snapshot_id ORDER BY run) AS wasrun FROM v)
SELECT snapshot_id, table_uuid, parent_snapshot_id, manifest_list FROM p WHERE wasrun IS NULL OR (table_uuid, parent_snapshot_id, manifest_list) IS DISTINCT FROM was""",
    }
    runs = ("WHERE recorded_at < TIMESTAMP '2024-01-01'", "WHERE recorded_at < TIMESTAMP '2024-07-01'", "")
    whole = "CAST((table_uuid, parent_snapshot_id, sequence_number, timestamp_ms, manifest_list, schema_id, list_sort(map_entries(summary)), expired_at) AS VARCHAR)"
    out["p6_replay_times"] = f"""WITH s AS (SELECT * FROM snapshots WHERE snapshot_id IS NOT NULL), v AS ({" UNION ALL ".join(f"(SELECT {i} AS run, snapshot_id, {whole} AS content FROM s {w} QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY recorded_at DESC) = 1)" for i, w in enumerate(runs))}),
p AS (SELECT *, lag(content) OVER (PARTITION BY snapshot_id ORDER BY run) AS was, lag(run) OVER (PARTITION BY snapshot_id ORDER BY run) AS wasrun FROM v)
SELECT snapshot_id, count(*) AS n_times FROM p WHERE wasrun IS NULL OR content IS DISTINCT FROM was GROUP BY snapshot_id"""
    return out | tables() | metadata()


def murmur_sql(column: str, table: str) -> str:
    """The 32-bit hash (seed 0) of a non-negative long as ``h``, step by step in unsigned arithmetic."""
    m = "4294967295::UBIGINT"

    def rotate(x: str, n: int) -> str:
        return f"((({x} << {n}) & {m}) | ({x} >> {32 - n}))"

    steps = [f"s0 AS (SELECT {column}::UBIGINT & {m} AS lo, {column}::UBIGINT >> 32 AS hi FROM {table})"]
    steps.append(f"s1 AS (SELECT lo * 3432918353::UBIGINT & {m} AS lo, hi * 3432918353::UBIGINT & {m} AS hi FROM s0)")
    steps.append(f"s2 AS (SELECT {rotate('lo', 15)} * 461845907::UBIGINT & {m} AS lo, {rotate('hi', 15)} * 461845907::UBIGINT & {m} AS hi FROM s1)")
    steps.append(f"s3 AS (SELECT ({rotate('lo', 13)} * 5::UBIGINT + 3864292196::UBIGINT) & {m} AS h, hi FROM s2)")
    steps.append("s4 AS (SELECT xor(h, hi) AS h FROM s3)")
    steps.append(f"s5 AS (SELECT xor(({rotate('h', 13)} * 5::UBIGINT + 3864292196::UBIGINT) & {m}, 8::UBIGINT) AS h FROM s4)")
    steps.append(f"s6 AS (SELECT xor(h, h >> 16) * 2246822507::UBIGINT & {m} AS h FROM s5)")
    steps.append(f"s7 AS (SELECT xor(h, h >> 13) * 3266489909::UBIGINT & {m} AS h FROM s6)")
    steps.append("s8 AS (SELECT xor(h, h >> 16) AS h FROM s7)")
    return "WITH " + ", ".join(steps)


def tables() -> dict[str, str]:
    """SQL of the queries over snapshot tables. The bucket of texts has none; tests hold it against known values."""
    lines = "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE "
    early = "l_shipdate < TIMESTAMP '1998-07-01'"
    count = "SELECT {} AS part, count(*) AS n FROM {} GROUP BY 1"
    window = "l_shipdate >= TIMESTAMP '1997-03-15' AND l_shipdate < TIMESTAMP '1997-06-10'"
    months = "(year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1"
    docs = "SELECT doc_id, lang, author FROM documents WHERE "
    return {
        "scan_project": "SELECT c_custkey, c_name, c_acctbal FROM customer",
        "scan_project_case_insensitive": "SELECT c_custkey, c_name FROM customer",
        "prune_by_id": "SELECT p_partkey, p_brand, p_retailprice FROM part",
        "filter_eq": lines + "l_returnflag = 'R'",
        "filter_ne": lines + "l_returnflag <> 'R'",
        "filter_is_null": docs + "lang IS NULL",
        "filter_not_null": docs + "lang IS NOT NULL AND author IS NOT NULL",
        "filter_and_or_not": lines + "NOT (l_quantity < 40 OR l_returnflag = 'N') OR (l_linenumber = 1 AND NOT l_linestatus <> 'F')",
        "filter_true": "SELECT n_nationkey, n_name FROM nation",
        "filter_false": "SELECT n_nationkey, n_name FROM nation WHERE false",
        "filter_cast_literal": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-02-29'",
        "filter_out_of_range": lines + "l_linenumber = 3000000000 OR (l_linenumber < 3000000000 AND l_returnflag = 'A')",
        "filter_in": lines + "l_linenumber IN (1, 3, 7)",
        "filter_not_in": lines + "l_linenumber NOT IN (1, 3, 7)",
        "filter_range": lines + "l_quantity > 10 AND l_quantity <= 12",
        "filter_starts_with": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'p%'",
        "filter_not_starts_with": "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE 'Brand#1%'",
        "filter_not_nan": "SELECT c_custkey, c_acctbal FROM customer WHERE NOT isnan(c_acctbal)",
        "filter_is_nan": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 = 0",
        "filter_not_nan_of_some": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0",
        "transform_identity": count.format("l_returnflag", "lineitem"),
        "transform_void": count.format("CAST(NULL AS VARCHAR)", "lineitem"),
        "transform_truncate_long": count.format("l_orderkey - l_orderkey % 100", "lineitem"),
        "transform_truncate_text": count.format("substr(c_mktsegment, 1, 3)", "customer"),
        "transform_truncate_signed": "SELECT CAST(floor(CAST(trunc(c_acctbal) AS BIGINT) / 100.0) * 100 AS BIGINT) AS whole, CAST(floor(round(c_acctbal, 2) / 5) * 5 AS DOUBLE) AS dec, count(*) AS n FROM customer GROUP BY ALL",
        "transform_year": count.format("CAST(year(o_orderdate) - 1970 AS INT)", "orders"),
        "transform_month": count.format("CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INT)", "orders"),
        "transform_day": count.format("CAST(o_orderdate AS DATE)", "orders"),
        "transform_hour": count.format("CAST(epoch_us(ts) // 3600000000 AS INT)", "events"),
        "transform_bucket_long": f"{murmur_sql('o_orderkey', 'orders')} SELECT CAST((h & 2147483647::UBIGINT) % 16 AS INT) AS part, count(*) AS n FROM s8 GROUP BY 1",
        "sort_order_places": PLACES,
        "sort_order_apply": PLACES,
        "pruning_soundness": f"SELECT l_orderkey, l_partkey, l_quantity, l_shipdate, count(*) AS n_skipping, count(*) AS n_whole FROM lineitem WHERE {window} AND l_quantity > 45 GROUP BY ALL",
        "pruning_files": f"SELECT (SELECT count(DISTINCT {months}) FROM lineitem WHERE {window}) AS files_kept, (SELECT count(*) FROM lineitem WHERE {months} IN (SELECT {months} FROM lineitem WHERE {window})) AS rows_kept, (SELECT count(DISTINCT {months}) FROM lineitem) AS files_all, (SELECT count(*) FROM lineitem) AS rows_all",
        "file_stats": f"SELECT CAST({months} AS INT) AS month, count(*) AS n_rows, count(*) AS n_values, count(*) - count(l_shipdate) AS n_nulls, min(l_orderkey) AS least_key, max(l_orderkey) AS greatest_key FROM lineitem GROUP BY ALL",
        "manifests_table": f"SELECT 0 AS content, CASE WHEN {early} THEN 1 ELSE 2 END AS sequence_number, count(*) AS added_rows, count(DISTINCT {months}) AS added_files FROM lineitem GROUP BY ALL",
        "files_table": "SELECT CAST(year(o_orderdate) - 1970 AS INT) AS year, count(*) AS n_rows FROM orders GROUP BY ALL",
        "all_files_table": f"SELECT CASE WHEN {early} THEN 1 ELSE 2 END AS sequence_number, CASE WHEN {early} THEN 2 ELSE 1 END * count(*) AS n_rows, CASE WHEN {early} THEN 2 ELSE 1 END AS n_snapshots FROM lineitem GROUP BY {early}",
        "snapshots_table": "SELECT * FROM (VALUES (1, 'append', true), (2, 'append', false)) v(sequence_number, operation, is_first)",
        "refs_table": "SELECT * FROM (VALUES ('main', 'branch'), ('early', 'tag')) v(name, type)",
        "history_table": "SELECT true AS is_current_ancestor, 2 AS n",
        "schemas_table": "SELECT * FROM (VALUES (0, 1, 'c_custkey', 'long'), (0, 2, 'c_name', 'string'), (0, 3, 'c_nationkey', 'int'), (0, 4, 'c_acctbal', 'double'), (0, 5, 'c_mktsegment', 'string'), (1, 1, 'c_custkey', 'long'), (1, 2, 'customer_name', 'string'), (1, 3, 'c_nationkey', 'int'), (1, 5, 'c_mktsegment', 'string'), (1, 100, 'note', 'string')) v(schema_id, field_id, name, type)",
        "time_travel_id": lines + early,
        "time_travel_timestamp": lines + early,
        "time_travel_tag": lines + early + " AND l_quantity > 25",
        "schema_evolution": "SELECT c_custkey, c_name AS customer_name, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 2 <> 0 THEN 'new' END AS note FROM customer",
        "position_deletes": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'again' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
        "equality_deletes": "WITH n AS (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p FROM orders) SELECT o_orderkey, p AS o_orderpriority, o_totalprice FROM n WHERE NOT (p IS NULL OR p LIKE '1%') UNION ALL SELECT o_orderkey, p, -1.0 FROM n WHERE o_orderkey % 11 = 0",
        "scan_nested": "SELECT c_custkey, c_nationkey AS nation, 'struct<home:struct<nation:int>>' AS shape FROM customer WHERE c_name >= 'Customer#000000100' AND c_mktsegment <> 'BUILDING'",
        "scan_limit": "SELECT 7 AS n",
        "min_sequence_number": "SELECT * FROM (VALUES (0, 1), (1, 1), (2, 1)) v(version, least)",
        "manifest_pruning": "SELECT 1 AS kept, 2 AS every",
        "delete_plan": "SELECT CASE WHEN k THEN 0 ELSE 1 END AS position_deletes, false AS equality_deletes, count(DISTINCT year(o_orderdate)) AS n_files FROM (SELECT o_orderdate, k FROM orders, (VALUES (true), (false)) v(k) WHERE o_orderkey % 7 = 0) t GROUP BY k",
        "metadata_log_table": "SELECT 2 AS n_earlier",
        "incremental_append": f"SELECT count(*) AS n_rows FROM lineitem WHERE NOT {early}",
    }


def metadata() -> dict[str, str]:
    """SQL of the queries over metadata, catalogs, literals and file formats."""
    from tabulith.queries_metadata import FILTERS

    renamed = "SELECT c_custkey, c_name AS customer_name, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 2 <> 0 THEN 'new' END AS note FROM customer"
    day = "CAST(o_orderdate AS DATE)"
    clock = f"epoch_us(o_orderdate) - epoch_us(CAST({day} AS TIMESTAMP))"
    hash_ = "md5(CAST(o_orderkey AS VARCHAR))"
    months = "(year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1"
    spaces = "r AS (SELECT r_regionkey AS k, replace(r_name, ' ', '_') AS r FROM region), n AS (SELECT r, replace(n_name, ' ', '_') AS n FROM nation JOIN r ON n_regionkey = k), first AS (SELECT min(r) AS r FROM n), size AS (SELECT r, count(*) AS c FROM n GROUP BY r)"
    work = f"""WITH {spaces} SELECT 'namespace' AS step, r AS result FROM size UNION ALL SELECT 'table', r || '.' || n FROM n UNION ALL SELECT 'size', r || '=' || c FROM size
UNION ALL SELECT 'left', CAST(c - 1 AS VARCHAR) FROM size JOIN first USING (r) UNION ALL SELECT 'namespaces', CAST(count(*) - 1 AS VARCHAR) FROM size
UNION ALL SELECT * FROM (VALUES ('removed', 'size'), ('updated', 'kind'), ('missing', 'none'), ('renamed', 'NoSuchTable'), ('loaded', '3'), ('again', 'NamespaceExists'), ('full', 'NamespaceNotEmpty'), ('missing', 'NoSuchNamespace'), ('refreshed', '2'), ('emptied', 'done'))"""
    return {
        "schema_evolution_orc": renamed,
        "schema_evolution_mapped": renamed + " WHERE c_name IS NOT NULL AND c_custkey >= 0",
        "scan_avro": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice >= 1000",
        "scan_format_1": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 10 AND p_size < 30",
        "manifests_format_1": "SELECT 0 AS sequence_number, 0 AS content, 0 AS known_deleted, count(DISTINCT p_size) AS added_files, 0 AS file_sequence, count(*) AS n_rows, 1 AS n_snapshots FROM part",
        "incremental_rewritten": "SELECT count(*) AS n_rows FROM supplier WHERE s_suppkey % 2 <> 0",
        "manifests_rewritten": """WITH c AS (SELECT count(DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END) AS a, count(DISTINCT CASE WHEN s_suppkey % 2 <> 0 THEN s_nationkey END) AS b, count(*) FILTER (s_suppkey % 2 = 0) AS x, count(*) AS y FROM supplier)
SELECT 0 AS version, 'append' AS operation, a AS n_manifests, x AS n_rows, a AS n_files, 1 AS n_commits FROM c UNION ALL SELECT 1, 'append', a + b, y, a + b, 2 FROM c UNION ALL SELECT 2, 'replace', 2, y, a + b, 2 FROM c UNION ALL SELECT 3, 'replace', 1, y, a + b, 2 FROM c""",
        "scan_rewritten": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 5, 7)",
        "metadata_documents": """WITH m AS (SELECT *, nullif(current_snapshot_id, -1) AS cur FROM table_metadata QUALIFY row_number() OVER (PARTITION BY table_uuid ORDER BY last_updated_ms DESC) = 1)
SELECT table_uuid, format_version AS version_read, 2 AS version_up, table_location AS location, last_updated_ms, cur AS current_snapshot_id, cur AS main_snapshot_id, CASE WHEN format_version = 2 THEN coalesce(last_sequence_number, 0) ELSE 0 END AS sequence_number, coalesce(current_schema_id, 0) AS schema_id,
CASE WHEN format_version = 1 THEN 1 ELSE 0 END AS n_spec_fields, CASE WHEN format_version = 1 THEN 1000 ELSE 999 END AS last_partition_id, 0 AS order_id, coalesce(len(map_keys(table_props)), 0) AS n_props, true AS same_again FROM m""",
        "schema_index": f"""WITH RECURSIVE {TREE}, p AS (SELECT table_uuid, schema_id, field_id, name AS full_name, [field_id] AS line FROM x WHERE parent IS NULL UNION ALL SELECT x.table_uuid, x.schema_id, x.field_id, p.full_name || '.' || x.name, list_append(p.line, x.field_id) FROM p JOIN x ON x.table_uuid = p.table_uuid AND x.schema_id = p.schema_id AND x.parent = p.field_id),
h AS (SELECT table_uuid, schema_id, max(field_id) AS highest FROM p GROUP BY ALL), l AS (SELECT h.*, p.line FROM h JOIN p ON p.table_uuid = h.table_uuid AND p.schema_id = h.schema_id AND p.field_id = h.highest),
q AS (SELECT l.table_uuid, l.schema_id, l.highest, any_value(len(l.line)) + count(x.field_id) AS kept FROM l LEFT JOIN x ON x.table_uuid = l.table_uuid AND x.schema_id = l.schema_id AND x.name = 'key' AND list_contains(l.line, x.parent) AND NOT list_contains(l.line, x.field_id) AND EXISTS (SELECT 1 FROM x m WHERE m.table_uuid = x.table_uuid AND m.schema_id = x.schema_id AND m.field_id = x.parent AND m.kind = 'map') GROUP BY ALL)
SELECT p.table_uuid, p.schema_id, p.field_id, p.full_name, true AS found, q.highest, q.kept FROM p JOIN q ON q.table_uuid = p.table_uuid AND q.schema_id = p.schema_id""",
        "literal_casts": f"""SELECT o_orderkey, CASE WHEN o_orderkey * 1000000 > 2147483647 THEN 'above' ELSE CAST(o_orderkey * 1000000 AS VARCHAR) END AS wide, CASE WHEN o_orderkey * 1000000 > 2147483648 THEN 'below' ELSE CAST(-o_orderkey * 1000000 AS VARCHAR) END AS narrow, o_orderkey AS whole, CAST(o_orderkey AS DOUBLE) AS number,
o_orderkey AS day, o_orderkey AS clock, o_orderkey || '.00' AS exact, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS single, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS twice, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) AS money, 'above' AS beyond, CAST(epoch({day}) // 86400 AS INT) AS day_of, epoch_us(o_orderdate) AS zoned,
CAST(o_orderkey AS INT) AS text_int, CASE WHEN o_orderkey < 0 THEN '' WHEN CAST(o_orderkey AS HUGEINT) * 100000000000000000 > 9223372036854775807 THEN 'above' ELSE CAST(CAST(o_orderkey AS HUGEINT) * 100000000000000000 AS VARCHAR) END AS text_long, o_totalprice AS text_number, CAST(CAST(CAST(o_totalprice AS DECIMAL(18, 3)) AS DECIMAL(15, 1)) AS VARCHAR) AS text_exact, CAST(epoch({day}) // 86400 AS INT) AS text_day, {clock} AS text_clock, epoch_us(o_orderdate) AS text_at,
epoch_us(o_orderdate) - 7200000000 AS text_zoned, o_orderkey % 2 <> 0 AS text_flag, {hash_}[1:8] || '-' || {hash_}[9:12] || '-' || {hash_}[13:16] || '-' || {hash_}[17:20] || '-' || {hash_}[21:32] AS text_uuid, o_orderpriority AS text_same, false AS text_bytes, false AS wrong, 1 AS fixed FROM orders""",
        "filter_rules": " UNION ALL ".join(f"SELECT '{name}' AS filter, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE {cond}" for name, _, cond in FILTERS),
        "plan_files_table": f"SELECT count(DISTINCT {months}) AS n_tasks, 0 AS greatest_start, count(DISTINCT {months}) AS n_long, count(DISTINCT {months}) AS n_without_deletes, count(*) AS n_rows FROM lineitem",
        "text_forms": "SELECT * FROM (VALUES ('identity', 'identity'), ('void', 'void'), ('year', 'year'), ('month', 'month'), ('day', 'day'), ('hour', 'hour'), ('bucket[16]', 'bucket[16]'), ('truncate[9]', 'truncate[9]'), ('bucket[]', 'error'), ('truncate[-1]', 'error'), ('week', 'error'), ('', 'error'), ('spec', 'truncate[19]'), ('order', 'nulls-last'), ('order without direction', 'error'), ('order of bad nulls', 'error'), ('order id', '2'), ('unsorted', '0')) v(\"case\", result)",
        "file_systems": f"SELECT DISTINCT CAST({months} AS INT) AS month, true AS same_size, true AS marked FROM lineitem",
        "catalog_local": work,
        "catalog_rest": work,
        "command_line": """SELECT * FROM (VALUES ('list', 0, 'world'), ('tables', 0, 'world.nation'), ('uuid', 0, '36'), ('location', 0, 'nation'), ('spec', 0, 'True'), ('describe', 0, 'True'), ('history', 0, '1'), ('set', 0, 'updated owner on world.nation'), ('get', 0, 'me'), ('remove', 0, 'removed owner on world.nation'), ('get again', 1, ''), ('rename', 0, 'renamed world.nation to world.land'), ('missing', 1, ''), ('drop', 0, 'dropped world.land'), ('drop namespace', 0, 'dropped world'), ('empty', 0, '')) v(command, code, printed)
UNION ALL SELECT 'schema', 0, CAST(count(*) AS VARCHAR) FROM (DESCRIBE nation) UNION ALL SELECT 'files', 0, CAST(count(DISTINCT n_regionkey) AS VARCHAR) FROM nation""",
    }
