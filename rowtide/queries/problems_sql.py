"""SQL twins of the queries in ``problems``: written from the statements, not from the operators."""

from __future__ import annotations

HEX = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13)))"
PATH = r"regexp_replace(regexp_replace(trim({0}), '^[sS]3[aA]?:/+', 's3://'), '([^:/])/{{2,}}', '\1/', 'g')"
UP = "upper(trim({0}))"


def hex_(c: str) -> str:
    return HEX.format(c)


def pkey(c: str = "partition_key") -> str:
    return f"coalesce({hex_(c)}, '')"


def path(c: str) -> str:
    return PATH.format(c)


def up(c: str) -> str:
    return UP.format(c)


_SNAP = "snap AS (SELECT snapshot_id, max(sequence_number) AS seq FROM snapshots GROUP BY 1)"
_UNITS = f"""
u0 AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY logged_at DESC NULLS LAST, attempt DESC NULLS LAST, {up('status')} DESC NULLS LAST) AS rn FROM work_units),
u AS (SELECT u0.table_id, u0.max_seq * 2 + CASE WHEN {up('u0.kind')} = 'DATA' THEN 1 ELSE 0 END AS own, s.seq AS start_seq
      FROM u0 LEFT JOIN snap s ON s.snapshot_id = u0.starting_snapshot_id WHERE rn = 1 AND {up('status')} = 'COMMITTED'),
win AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY table_id ORDER BY own), 1) AS prev FROM u)"""
_DATA = f"""
df AS (SELECT file_id, max(table_id) AS table_id, max({path('data_file_path')}) AS path, max(data_sequence_number) * 2 + 1 AS walk, max(added_snapshot_id) AS sid, max(record_count) AS n, max(removed_at) AS gone
       FROM data_files GROUP BY 1)"""
_TAKEN = "SELECT f.* FROM {0} f JOIN win w ON w.table_id = f.table_id AND f.walk > w.prev AND f.walk <= w.own JOIN snap s ON s.snapshot_id = f.sid WHERE s.seq <= w.start_seq"

_P1 = f"""
WITH {_SNAP}, {_UNITS}, {_DATA},
pk AS (SELECT table_id, max(list_sort(list_distinct(pk_field_ids))) AS ids FROM ice_tables GROUP BY 1),
ef AS (SELECT file_id, max(table_id) AS table_id, max(data_sequence_number) * 2 AS walk, max(added_snapshot_id) AS sid, max(removed_at) AS gone, max(list_sort(list_distinct(equality_ids))) AS ids
       FROM delete_files WHERE {up('content')} = 'EQUALITY_DELETES' GROUP BY 1),
cand AS (SELECT file_id, table_id, walk, sid FROM df WHERE gone IS NULL
         UNION ALL SELECT file_id, ef.table_id, walk, sid FROM ef JOIN pk ON pk.table_id = ef.table_id AND pk.ids = ef.ids WHERE gone IS NULL)
SELECT file_id FROM cand WHERE file_id NOT IN (SELECT file_id FROM ({_TAKEN.format('cand')}))
"""

_P1_DELTAS = f"""
WITH {_SNAP}, {_UNITS}, {_DATA}, taken AS ({_TAKEN.format('df')}),
dv0 AS (SELECT file_id, max(table_id) AS table_id, max({path('referenced_data_file')}) AS path, max(data_sequence_number) AS dsn, max(record_count) AS deleted, max(removed_at) AS gone
        FROM delete_files WHERE {up('content')} = 'POSITION_DELETES' AND {up('file_format')} = 'PUFFIN' GROUP BY 1),
dv AS (SELECT *, row_number() OVER (PARTITION BY table_id, path ORDER BY dsn DESC, file_id DESC, deleted DESC) AS rn FROM dv0 WHERE gone IS NULL AND path IS NOT NULL),
both_ AS (SELECT df.table_id, df.file_id, df.n, df.gone IS NULL AS now, t.file_id IS NOT NULL AS was, CASE WHEN df.gone IS NULL THEN coalesce(dv.deleted, 0) ELSE 0 END AS d
          FROM df LEFT JOIN taken t ON t.file_id = df.file_id LEFT JOIN dv ON dv.rn = 1 AND dv.table_id = df.table_id AND dv.path = df.path),
ch AS (SELECT *, CASE WHEN NOT was AND now THEN 'ADDED' WHEN was AND NOT now THEN 'REMOVED' WHEN was AND now AND d <> 0 THEN 'CHANGED' END AS change FROM both_)
SELECT table_id, change, count(*) AS files,
  CAST(sum(CASE WHEN change = 'ADDED' THEN n - d ELSE 0 END) AS BIGINT) AS records_added,
  CAST(sum(CASE WHEN change = 'REMOVED' THEN n WHEN change = 'CHANGED' THEN d ELSE 0 END) AS BIGINT) AS records_removed
FROM ch WHERE change IS NOT NULL GROUP BY 1, 2
"""

_P1_SINCE = f"""
WITH {_SNAP}, {_UNITS}, {_DATA}, taken AS ({_TAKEN.format('df')}),
tm AS (SELECT table_id, sequence_number AS seq, max(committed_at) AS at FROM snapshots GROUP BY 1, 2),
lu AS (SELECT u.table_id, own // 2 AS max_seq, start_seq, tm.at, row_number() OVER (PARTITION BY u.table_id ORDER BY own DESC, start_seq DESC NULLS LAST) AS rn
       FROM u LEFT JOIN tm ON tm.table_id = u.table_id AND tm.seq = u.start_seq),
v AS (SELECT file_id, max(table_id) AS table_id, max({path('referenced_data_file')}) AS path, max(data_sequence_number) AS dsn, max(added_snapshot_id) AS sid, max(record_count) AS deleted, max(removed_at) AS gone
      FROM delete_files WHERE {up('content')} = 'POSITION_DELETES' AND {up('file_format')} = 'PUFFIN' GROUP BY 1),
new AS (SELECT df.file_id, coalesce(arg_max(coalesce(v.deleted, 0), (v.dsn, v.file_id)), 0) AS d FROM df JOIN v ON v.table_id = df.table_id AND v.path = df.path WHERE df.gone IS NULL AND v.gone IS NULL GROUP BY 1),
old AS (SELECT t.file_id, coalesce(arg_max(coalesce(v.deleted, 0), (v.dsn, v.file_id)), 0) AS d
        FROM taken t JOIN v ON v.table_id = t.table_id AND v.path = t.path JOIN lu ON lu.rn = 1 AND lu.table_id = t.table_id JOIN snap s ON s.snapshot_id = v.sid
        WHERE v.dsn <= lu.max_seq AND s.seq <= lu.start_seq AND (v.gone IS NULL OR v.gone > lu.at OR v.gone >= t.gone) GROUP BY 1),
b AS (SELECT df.table_id, df.n, df.gone IS NULL AS now, t.file_id IS NOT NULL AS was, coalesce(old.d, 0) AS d1, coalesce(new.d, 0) AS d2
      FROM df LEFT JOIN taken t ON t.file_id = df.file_id LEFT JOIN old ON old.file_id = df.file_id LEFT JOIN new ON new.file_id = df.file_id),
ch AS (SELECT *, CASE WHEN NOT was AND now THEN 'ADDED' WHEN was AND NOT now THEN 'REMOVED' WHEN was AND now AND d1 <> d2 THEN 'CHANGED' END AS change FROM b)
SELECT table_id, change, count(*) AS files,
  CAST(sum(CASE change WHEN 'ADDED' THEN n - d2 WHEN 'CHANGED' THEN greatest(d1 - d2, 0) ELSE 0 END) AS BIGINT) AS records_added,
  CAST(sum(CASE change WHEN 'REMOVED' THEN n - d1 WHEN 'CHANGED' THEN greatest(d2 - d1, 0) ELSE 0 END) AS BIGINT) AS records_removed
FROM ch WHERE change IS NOT NULL GROUP BY 1, 2
"""

_P2_CTE = f"""
WITH t AS (SELECT table_id, max(target_delete_file_bytes) AS target FROM ice_tables GROUP BY 1),
f AS (SELECT file_id, max(table_id) AS table_id, max(spec_id) AS spec_id, max({pkey()}) AS partition_key, max({up('content')}) AS content, max({up('file_format')}) AS fmt,
      max(list_sort(list_distinct(equality_ids))) AS ids, max(file_size_in_bytes) AS size, max(record_count) AS records, max(removed_at) AS gone FROM delete_files GROUP BY 1),
small AS (SELECT f.*, count(*) OVER (PARTITION BY f.table_id, spec_id, partition_key, content, ids) AS k
          FROM f LEFT JOIN t ON t.table_id = f.table_id WHERE gone IS NULL AND coalesce(fmt, '') <> 'PUFFIN' AND size * 2 < coalesce(target, 16384))
"""
# the source after all steps, from the statement of the steps: a row goes with its position, or with a delete of its key that came later
_P1_INCREMENTAL = """
WITH e AS (SELECT event_id, user_id, event_type, coalesce(day(ts), 1) AS day FROM events),
b AS (SELECT event_type, user_id, max(event_id) AS event_id FROM e WHERE day BETWEEN 11 AND 20 GROUP BY 1, 2),
c AS (SELECT event_type, user_id, max(event_id) AS event_id FROM e WHERE day >= 21 GROUP BY 1, 2),
v AS (SELECT DISTINCT event_type, user_id FROM e WHERE event_type = 'view' AND user_id % 5 = 0),
old AS (SELECT event_id, user_id, event_type FROM e WHERE day <= 10 AND NOT EXISTS (SELECT 1 FROM b WHERE b.event_type = e.event_type AND b.user_id = e.user_id) UNION ALL SELECT event_id, user_id, event_type FROM b),
kept AS (SELECT * FROM old o WHERE event_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM v WHERE v.event_type = o.event_type AND v.user_id = o.user_id) AND NOT EXISTS (SELECT 1 FROM c WHERE c.event_type = o.event_type AND c.user_id = o.user_id))
SELECT event_id, user_id, event_type FROM kept UNION ALL SELECT event_id, user_id, event_type FROM c
"""

_P2 = _P2_CTE + "SELECT file_id FROM small WHERE k >= 2"
_P2_GROUPS = _P2_CTE + "SELECT table_id, spec_id, partition_key, content, array_to_string(ids, ',') AS equality_ids, count(*) AS files, CAST(sum(records) AS BIGINT) AS records FROM small WHERE k >= 2 GROUP BY ALL"

_P2_FILES = (
    _P2_CTE
    + f""", fp AS (SELECT file_id, max({path('file_path')}) AS path FROM delete_files GROUP BY 1), r AS (SELECT DISTINCT row_id, table_id, {path('file_path')} AS path FROM eq_delete_rows),
n AS (SELECT table_id, path, count(*) AS deletes FROM r GROUP BY 1, 2)
SELECT s.table_id, count(*) AS files, CAST(sum(records) AS BIGINT) AS records, CAST(coalesce(sum(deletes), 0) AS BIGINT) AS deletes FROM small s JOIN fp USING (file_id) LEFT JOIN n ON n.table_id = s.table_id AND n.path = fp.path WHERE k >= 2 GROUP BY 1"""
)

_LONG = f"""
WITH l AS (SELECT table_id, 'partition_key' AS key_field, {pkey()} AS key_value, * EXCLUDE (table_id) FROM index_changes
           UNION ALL SELECT table_id, 'data_file_path', {path('data_file_path')}, * EXCLUDE (table_id) FROM index_changes WHERE data_file_path IS NOT NULL)
"""
_P3 = (
    _LONG
    + """, t AS (SELECT table_id, count(*) AS n FROM index_changes GROUP BY 1), g AS (SELECT table_id, key_field, key_value, count(*) AS c FROM l GROUP BY 1, 2, 3)
SELECT g.table_id, key_field, key_value FROM g JOIN t ON t.table_id IS NOT DISTINCT FROM g.table_id WHERE c * CASE key_field WHEN 'partition_key' THEN 4 ELSE 20 END > n
"""
)
_P3_STATS = (
    _LONG
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY table_id, key_field, key_value ORDER BY changed_at DESC NULLS LAST, change_id DESC NULLS LAST) AS rn FROM l)
SELECT table_id, key_field, key_value, count(*) AS rows, count(DISTINCT (spec_id, {hex_('pk')})) AS distinct_keys, max(changed_at) AS latest_changed_at, max(CASE WHEN rn = 1 THEN change_id END) AS latest_change_id
FROM r GROUP BY 1, 2, 3
"""
)
_P3_QUANTILES = (
    _LONG
    + """, r AS (SELECT table_id, key_field, key_value, sequence_number, row_number() OVER (PARTITION BY table_id, key_field, key_value ORDER BY sequence_number) AS rn,
 count(*) OVER (PARTITION BY table_id, key_field, key_value) AS n FROM l WHERE sequence_number IS NOT NULL)
SELECT table_id, key_field, key_value, prob, n AS rows, sequence_number AS value FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) p(prob) WHERE rn = greatest(1, CAST(ceil(prob * n) AS BIGINT))
"""
)

_ORPHANS = f"""
WITH d AS (SELECT file_id, table_id, {path('data_file_path')} AS path, min(added_at) AS a, max(removed_at) AS r FROM data_files GROUP BY 1, 2, 3),
e AS (SELECT file_id, table_id, {path('file_path')} AS path, min(added_at) AS a, max(removed_at) AS r FROM delete_files WHERE {up('content')} = 'EQUALITY_DELETES' GROUP BY 1, 2, 3),
ed AS (SELECT table_id, {path('file_path')} AS path, max(data_sequence_number) AS dsn, max(added_at) AS added_at FROM delete_files GROUP BY 1, 2),
c AS (SELECT change_id, table_id, {path('data_file_path')} AS path, changed_at AS tm FROM index_changes WHERE data_file_path IS NOT NULL),
p AS (SELECT plan_id, table_id, {path('x')} AS path, planned_at AS tm FROM (SELECT plan_id, table_id, planned_at, unnest(eq_deletes_to_remove) AS x FROM commit_plans) WHERE x IS NOT NULL),
s AS (SELECT table_id, spec_id, {pkey()} AS pkey, {hex_('pk')} AS pk, sequence_number AS seq, CASE WHEN {up('file_kind')} = 'DATA' THEN 1 ELSE 0 END AS k, ordinal,
      CASE WHEN {up('op')} IN ('+I', '+U', 'INSERT', 'UPDATE_AFTER') THEN 1 ELSE 0 END AS live FROM index_changes),
q AS (SELECT row_id, x.table_id, spec_id, {pkey()} AS pkey, {hex_('pk')} AS pk, dsn, added_at FROM eq_delete_rows x LEFT JOIN ed ON ed.table_id = x.table_id AND ed.path = {path('x.file_path')}),
qs AS (SELECT q.row_id, q.table_id, q.pk, q.added_at, q.dsn, arg_max(s.live, (s.seq, s.k, s.ordinal, s.live)) AS live FROM q LEFT JOIN s ON s.table_id = q.table_id AND s.spec_id = q.spec_id AND s.pkey = q.pkey AND s.pk = q.pk AND s.seq < q.dsn
       GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT 'index_changes.data_file_path' AS ref_field, table_id, change_id AS ref_id, path AS ref_value, CAST(tm AS DATE) AS day FROM c
        WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.table_id = c.table_id AND d.path = c.path AND d.a <= c.tm AND (d.r IS NULL OR d.r > c.tm))
      UNION ALL SELECT 'commit_plans.eq_deletes_to_remove', table_id, plan_id, path, CAST(tm AS DATE) FROM p
        WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.table_id = p.table_id AND e.path = p.path AND e.a <= p.tm AND (e.r IS NULL OR e.r > p.tm))
      UNION ALL SELECT 'eq_delete_rows.pk', table_id, row_id, pk, CAST(added_at AS DATE) FROM qs WHERE coalesce(live, 0) = 0)
"""
_P4 = _ORPHANS + "SELECT DISTINCT ref_field, ref_id, ref_value FROM o"
_P4_DAYS = _ORPHANS + "SELECT ref_field, table_id, day, count(*) AS orphans FROM (SELECT DISTINCT * FROM o) GROUP BY 1, 2, 3"

_P5_CTE = f"""
WITH s AS (SELECT table_id, spec_id, {pkey()} AS partition_key, {hex_('pk')} AS pk, {path('data_file_path')} AS data_file_path, pos,
  CASE WHEN {up('op')} IN ('+I', '+U', 'INSERT', 'UPDATE_AFTER') THEN 1 ELSE 0 END AS live, sequence_number AS q, CASE WHEN {up('file_kind')} = 'DATA' THEN 1 ELSE 0 END AS k, ordinal FROM index_changes),
r AS (SELECT *, row_number() OVER (PARTITION BY table_id, spec_id, partition_key, pk ORDER BY q DESC, k DESC, ordinal DESC, live DESC, data_file_path DESC, pos DESC) AS rn FROM s),
found AS (SELECT table_id, spec_id, partition_key, pk, data_file_path, pos FROM r WHERE rn = 1 AND live = 1)
"""
_P5 = _P5_CTE + "SELECT * FROM found"
_P5_TABLES = _P5_CTE + "SELECT table_id, count(*) AS live_keys, count(DISTINCT data_file_path) AS files FROM found GROUP BY 1"

SQL = {
    "p1_found": _P1,
    "p1_version_deltas": _P1_DELTAS,
    "p1_deltas_since": _P1_SINCE,
    "p1_incremental": _P1_INCREMENTAL,
    "p2_found": _P2,
    "p2_files": _P2_FILES,
    "p2_groups": _P2_GROUPS,
    "p3_found": _P3,
    "p3_key_stats": _P3_STATS,
    "p3_quantiles": _P3_QUANTILES,
    "p4_found": _P4,
    "p4_per_table_day": _P4_DAYS,
    "p5_found": _P5,
    "p5_live_per_table": _P5_TABLES,
}
