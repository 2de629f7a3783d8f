"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_BASE = """
log AS (
  SELECT printf('user_%06d', user_id) AS user_key, event_id + 1 AS seqno, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::INTEGER AS value_type,
         CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_id // 2500 AS run_id FROM events
), newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS rn FROM log) WHERE rn = 1
), probes AS (
  SELECT DISTINCT unnest([printf('user_%06d', user_id), printf('user_%06d_absent', user_id)]) AS user_key FROM events
), dated AS (
  SELECT user_key, unnest([0, 1000, 5000, 9000])::BIGINT AS as_of FROM probes
), damaged AS (
  SELECT CASE WHEN seqno % 101 <> 0 THEN user_key END AS k, CASE WHEN seqno % 103 <> 0 THEN seqno ELSE 0 END AS s, CASE WHEN seqno % 107 <> 0 THEN value_type ELSE 7 END AS t,
         CASE WHEN seqno % 11 = 0 THEN 'x' WHEN seqno % 109 <> 0 THEN value END AS v, seqno AS n FROM log
), broken AS (
  SELECT * FROM damaged UNION ALL SELECT * FROM damaged WHERE n % 211 = 0
), sized AS (
  SELECT *, (strlen(user_key) + coalesce(strlen(value), 0) + 15)::BIGINT AS encoded, (strlen(user_key) + coalesce(strlen(value), 0) + 73)::BIGINT AS buffered FROM log
), manifest AS (
  SELECT run_id, count(*) AS num_entries, min(seqno) AS min_seqno, max(seqno) AS max_seqno, min(user_key) AS first_key, max(user_key) AS last_key,
         sum(encoded)::BIGINT AS file_size FROM sized GROUP BY run_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY user_key, seqno DESC) - 1 AS position FROM sized
), entry AS (
  SELECT *, printf('%04X', strlen(user_key)) || hex(encode(user_key)) || printf('%016X', seqno) || printf('%02X', value_type) AS key_hex,
         printf('%08X', strlen(coalesce(value, ''))) || hex(encode(coalesce(value, ''))) AS value_hex FROM log
)
"""

_PACKED = """
packed AS (
  SELECT run_id, position, user_key, seqno, encoded, value_type, value, 0::BIGINT AS block_id, 0::BIGINT AS slot, encoded AS held FROM placed WHERE position = 0
  UNION ALL
  SELECT p.run_id, p.position, p.user_key, p.seqno, p.encoded, p.value_type, p.value,
         CASE WHEN b.held + 4 * ((b.slot + 16) // 16) + 24 + p.encoded > 4096 THEN b.block_id + 1 ELSE b.block_id END,
         CASE WHEN b.held + 4 * ((b.slot + 16) // 16) + 24 + p.encoded > 4096 THEN 0 ELSE b.slot + 1 END,
         CASE WHEN b.held + 4 * ((b.slot + 16) // 16) + 24 + p.encoded > 4096 THEN p.encoded ELSE b.held + p.encoded END
  FROM packed b JOIN placed p ON p.run_id = b.run_id AND p.position = b.position + 1
), blocks AS (
  SELECT run_id, block_id, max(user_key) AS last_key, count(*) AS entries, (sum(encoded) + 4 * ((count(*) + 15) // 16) + 24)::BIGINT AS block_len FROM packed GROUP BY 1, 2
)
"""

_LIVE = "SELECT user_key, seqno, value FROM newest WHERE value_type = 0"

_TEXT = {
    "get_latest_live": _LIVE,
    "get_detail_probes": "SELECT p.user_key, CASE n.value_type WHEN 0 THEN 'Found' WHEN 1 THEN 'Deleted' ELSE 'NotFound' END AS status, coalesce(n.seqno, 0) AS seqno, n.value FROM probes p LEFT JOIN newest n USING (user_key)",
    "get_point": f"{_LIVE} AND user_key = 'user_000003'",
    "get_at_snapshot": "SELECT user_key, seqno, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS r FROM log WHERE seqno <= 5000) WHERE r = 1 AND value_type = 0",
    "get_at_probes": """
        SELECT user_key, as_of, CASE value_type WHEN 0 THEN 'Found' WHEN 1 THEN 'Deleted' ELSE 'NotFound' END AS status, coalesce(seqno, 0) AS seqno, CASE WHEN value_type = 0 THEN value END AS value FROM (
          SELECT d.user_key, d.as_of, l.seqno, l.value_type, l.value, row_number() OVER (PARTITION BY d.user_key, d.as_of ORDER BY l.seqno DESC NULLS LAST) AS r
          FROM dated d LEFT JOIN log l ON l.user_key = d.user_key AND l.seqno <= d.as_of) WHERE r = 1""",
    "deleted_keys": "SELECT user_key, seqno FROM newest WHERE value_type = 1",
    "live_semi": "SELECT user_key FROM probes WHERE user_key IN (SELECT user_key FROM newest WHERE value_type = 0)",
    "absent_anti": "SELECT user_key FROM probes WHERE user_key NOT IN (SELECT user_key FROM newest WHERE value_type = 0)",
    "resurrected_keys": "SELECT user_key, seqno, value FROM (SELECT *, lag(value_type) OVER (PARTITION BY user_key ORDER BY seqno) AS b FROM log) WHERE b = 1 AND value_type = 0",
    "version_history": "SELECT user_key, seqno, row_number() OVER w AS version, coalesce(lag(seqno) OVER w, 0) AS superseded_by FROM log WINDOW w AS (PARTITION BY user_key ORDER BY seqno DESC)",
    "range_scan": f"{_LIVE} AND user_key >= 'user_000002' AND user_key < 'user_000010'",
    "memtable_stats": "SELECT count(*) AS entries, sum(buffered)::BIGINT AS approximate_size, min(seqno) AS min_seqno, max(seqno) AS max_seqno, max(seqno) + 1 AS next_seqno FROM sized",
    "entry_sizes": "SELECT seqno, buffered, encoded, (strlen(user_key) + 11)::BIGINT AS encoded_key FROM sized",
    "merge_keep_tombstones": "SELECT user_key, seqno, value_type, value FROM newest",
    "merge_drop_tombstones": "SELECT user_key, seqno, value_type, value FROM newest WHERE value_type = 0",
    "merge_with_snapshots": """
        SELECT user_key, seqno, value_type, value FROM (
          SELECT *, max(CASE WHEN value_type = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS older FROM (
            SELECT *, row_number() OVER (PARTITION BY user_key, CASE WHEN seqno <= 2000 THEN 0 WHEN seqno <= 6000 THEN 1 ELSE 2 END ORDER BY seqno DESC) AS r FROM log) WHERE r = 1)
        WHERE value_type = 0 OR coalesce(older, 0) = 1""",
    "compaction_stats": """
        SELECT (SELECT count(*) FROM log) AS input_entries, count(*) FILTER (value_type = 0) AS output_entries, count(*) FILTER (value_type = 1) AS newest_is_delete,
               (SELECT count(DISTINCT run_id) FROM log) AS obsolete_runs, (CASE WHEN count(*) FILTER (value_type = 0) > 0 THEN 1 ELSE 0 END)::BIGINT AS new_runs FROM newest""",
    "run_manifest": "SELECT * FROM manifest",
    "l0_candidates": "SELECT d.user_key, d.as_of, m.run_id FROM dated d JOIN manifest m ON d.user_key BETWEEN m.first_key AND m.last_key AND m.min_seqno <= d.as_of",
    "read_amplification": "SELECT user_key, (SELECT max(run_id) FROM log) - max(run_id) + 1 AS runs_read FROM log GROUP BY user_key",
    "sorted_entries": "SELECT run_id, position, user_key, seqno FROM placed",
    "global_order": "SELECT row_number() OVER (ORDER BY user_key, seqno DESC) - 1 AS position, user_key, seqno FROM log",
    "seqno_assignment": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seqno FROM events",
    "restart_points": "SELECT run_id, position, user_key, seqno FROM placed WHERE position % 16 = 0",
    "encode_hex": "SELECT seqno, key_hex || value_hex AS entry, key_hex AS internal_key FROM entry",
    "decode_roundtrip": "SELECT user_key, seqno, value_type, coalesce(value, '') AS value, encoded::INTEGER AS used FROM sized",
    "value_type_codes": "SELECT (event_id % 4)::INTEGER AS code, CASE event_id % 4 WHEN 0 THEN 'put' WHEN 1 THEN 'delete' END AS name, count(*) AS n FROM events GROUP BY 1, 2",
    "log_violations": """
        SELECT * FROM (
          SELECT unnest(['null key', 'seqno below 1', 'unknown value type', 'delete with a value', 'put without a value', 'repeated version']) AS rule,
                 unnest([count(*) FILTER (k IS NULL), count(*) FILTER (s = 0), count(*) FILTER (t = 7), count(*) FILTER (t = 1 AND strlen(v) > 0), count(*) FILTER (t = 0 AND v IS NULL),
                         (SELECT count(*) FROM (SELECT 1 FROM broken GROUP BY k, s HAVING count(*) > 1))]) AS n FROM broken) WHERE n > 0""",
    "entry_checksums": "SELECT seqno, sha256(unhex(key_hex || value_hex)) AS checksum FROM entry",
    "changed_runs": "SELECT DISTINCT run_id FROM log WHERE seqno = 100",
    "bloom_no_false_negatives": "SELECT run_id, count(DISTINCT user_key) AS n, 0::BIGINT AS missed FROM log GROUP BY run_id",
    "encrypt_roundtrip": "SELECT user_key, seqno, value_type, value FROM log",
    "tamper_detect": "SELECT seqno, value IS NULL OR seqno % 3 = 0 AS authentic, value IS NULL AS with_other_key FROM log",
    "encrypted_sizes": "SELECT seqno, (strlen(value) + 28)::BIGINT AS stored_bytes FROM log WHERE value IS NOT NULL",
    "store_reopened_live": _LIVE,
    "store_compacted_detail": "SELECT p.user_key, CASE WHEN n.value_type = 0 THEN 'Found' ELSE 'NotFound' END AS status FROM probes p LEFT JOIN newest n USING (user_key)",
    "store_point": f"{_LIVE} AND user_key = 'user_000003'",
    "store_inspection": """
        SELECT CASE seqno % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END::BIGINT AS run_id, count(*) AS num_entries, min(seqno) AS min_seqno, max(seqno) AS max_seqno,
               min(user_key) AS first_key, max(user_key) AS last_key, true AS listed FROM log GROUP BY seqno % 4""",
    "store_tiers_detail": """
        SELECT p.user_key, CASE WHEN l.t IS NULL THEN CASE WHEN n.value_type = 0 THEN 'Found' ELSE 'NotFound' END WHEN l.t = 0 THEN 'Found' ELSE 'Deleted' END AS status
        FROM probes p LEFT JOIN newest n USING (user_key) LEFT JOIN (SELECT user_key, arg_max(value_type, seqno) AS t FROM log WHERE seqno % 4 = 0 GROUP BY user_key) l USING (user_key)""",
    "encrypted_store_live": _LIVE,
    "encrypted_store_inner": "SELECT seqno, (strlen(value) + 28)::BIGINT AS stored_bytes, CASE WHEN value IS NOT NULL THEN false END AS readable FROM log",
    "memory_store_live": _LIVE,
    "engine_bulk_live": _LIVE,
    "engine_snapshot_live": "SELECT user_key, seqno, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS r FROM log WHERE seqno <= 5000) WHERE r = 1 AND value_type = 0",
    "engine_reopened_detail": "SELECT p.user_key, CASE n.value_type WHEN 0 THEN 'Found' WHEN 1 THEN 'Deleted' ELSE 'NotFound' END AS status, coalesce(n.seqno, 0) AS seqno, n.value FROM probes p LEFT JOIN newest n USING (user_key)",
    "engine_single_writes": """
        SELECT n_name AS user_key, CASE WHEN n_regionkey <> 0 THEN 'Found' ELSE 'gone' END AS status, CASE WHEN n_regionkey <> 0 THEN lower(n_name) END AS value FROM nation
        UNION ALL SELECT n_name || '?', 'gone', NULL FROM nation""",
    "engine_short_buffers": """
        SELECT n_name AS name, CASE WHEN strlen(n_name) <= 6 THEN 'Found' ELSE 'BufferTooSmall' END AS status, strlen(n_name)::BIGINT AS length, CASE WHEN strlen(n_name) <= 6 THEN n_name ELSE '' END AS value FROM nation
        UNION ALL SELECT 'NOWHERE', 'NotFound', 0, ''""",
    "byte_files": """
        SELECT place, number, number % 3 <> 0 AS there, CASE WHEN number % 3 <> 0 THEN strlen(n_name) + 1 ELSE 0 END::BIGINT AS size,
               CASE WHEN number % 3 <> 0 THEN substr(n_name, 1, 4) || '<' || n_name ELSE '' END AS read, 1::BIGINT AS second_at
        FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS number FROM nation), (SELECT unnest(['memory', 'folder']) AS place)""",
    "sst_point_get": """
        SELECT user_key, as_of, CASE value_type WHEN 0 THEN 'Found' WHEN 1 THEN 'Deleted' ELSE 'NotFound' END AS status, coalesce(seqno, 0) AS seqno, CASE WHEN value_type = 0 THEN value END AS value FROM (
          SELECT d.user_key, d.as_of, l.seqno, l.value_type, l.value, row_number() OVER (PARTITION BY d.user_key, d.as_of ORDER BY l.seqno DESC NULLS LAST) AS r
          FROM dated d LEFT JOIN log l ON l.user_key = d.user_key AND l.seqno <= d.as_of) WHERE r = 1""",
    "sst_files": "SELECT run_id, num_entries AS entries, min_seqno, max_seqno, first_key, last_key FROM manifest",
    "sst_roundtrip": "SELECT run_id, user_key, seqno, value_type, value FROM log",
    "sst_open_refusals": """
        SELECT run_id, damage, damage <> 'whole' AS refused FROM manifest,
        (SELECT unnest(['whole', 'empty', 'short', 'cut at the end', 'longer', 'cut at the beginning', 'other kind', 'index changed']) AS damage)""",
    "stream_ingest_live": _LIVE,
    "windowed_activity": "SELECT date_trunc('hour', ts) AS window_start, count(*) FILTER (event_type <> 'error') AS puts, count(*) FILTER (event_type = 'error') AS deletes FROM events GROUP BY 1",
}

_PACKED_TEXT = {
    "block_packing": "SELECT run_id, user_key, seqno, block_id, slot FROM packed",
    "block_index": "SELECT *, coalesce(sum(block_len) OVER (PARTITION BY run_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_offset FROM blocks",
    "block_roundtrip": "SELECT run_id, user_key, seqno, value_type, value, block_id, slot FROM packed",
    "block_payloads": """
        SELECT p.run_id, p.block_id, count(*) AS entries, sha256(unhex(string_agg(e.key_hex || e.value_hex, '' ORDER BY slot)
               || coalesce(string_agg(printf('%08X', start), '' ORDER BY slot) FILTER (slot % 16 = 0), '') || printf('%08X', count(*) FILTER (slot % 16 = 0)) || printf('%08X', count(*)))) AS sha256
        FROM (SELECT *, coalesce(sum(encoded) OVER (PARTITION BY run_id, block_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM packed) p
        JOIN entry e USING (seqno) GROUP BY p.run_id, p.block_id""",
    "block_lookup": "SELECT b.run_id, p.user_key, min(b.block_id) AS block_id FROM probes p JOIN blocks b ON b.last_key >= p.user_key GROUP BY 1, 2",
}

_FLUSH = """
WITH RECURSIVE {base}, f AS (
  SELECT run_id, seqno, buffered AS held, 0::BIGINT AS flush_id FROM sized WHERE (seqno - 1) % 2500 = 0
  UNION ALL
  SELECT s.run_id, s.seqno, CASE WHEN f.held >= 4096 THEN s.buffered ELSE f.held + s.buffered END, CASE WHEN f.held >= 4096 THEN f.flush_id + 1 ELSE f.flush_id END
  FROM f JOIN sized s ON s.run_id = f.run_id AND s.seqno = f.seqno + 1
) SELECT run_id, seqno, flush_id FROM f
"""


def oracle_sql() -> dict[str, str]:
    out = {k: f"WITH {_BASE} {v}" for k, v in _TEXT.items()}
    out |= {k: f"WITH RECURSIVE {_BASE}, {_PACKED} {v}" for k, v in _PACKED_TEXT.items()}
    out["flush_assignment"] = _FLUSH.format(base=_BASE)
    return out
