"""DDL of the derived tables."""

ACTIONS = """unit_id STRING, project STRING, session_id STRING, session_ix INT, idx INT, effective_ts STRING,
ts TIMESTAMP, ts_inherited BOOLEAN, lane STRING, line_no BIGINT, block_pos INT, tool_use_id STRING, kind STRING,
file_path STRING, is_error BOOLEAN, write_len BIGINT, write_lines BIGINT, read_total_lines BIGINT, input_hash BIGINT,
error STRING, hunks ARRAY<STRUCT<lo: INT, hi: INT>>, command STRING, user_modified BOOLEAN, edit_old STRING,
edit_new STRING, approval_latency_s DOUBLE, auto_accept_here BOOLEAN"""
FINDINGS = """unit_id BIGINT, detector_ord INT, kind STRING, tier STRING, exact BOOLEAN, confidence STRING,
idxs ARRAY<INT>, file STRING, note STRING, nums MAP<STRING, DOUBLE>"""
MANIFEST = "path STRING, size BIGINT, mtime TIMESTAMP, sha256 STRING"
FINDING_KINDS = ["churn", "rework", "re_read", "blind_write_attempt", "failure_loop", "true_revert", "flip", "user_corrected", "opening_move", "large_write_instant_accept", "action_loop", "review_burden", "secrets_file_touched"]
