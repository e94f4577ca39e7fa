"""Registered streaming queries and payload sources; events replay as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.plans.registry import query
from recordqc.sources import scan
from recordqc.streaming import flows as T

C = F.col


def _events(t):
    return T.event_stream(t.spark, t.sf_dir)


@query("t1_continuous_index", """SELECT path, arg_max(size, (modified_us, seq)) AS size, max(modified_us) AS modified_us FROM (SELECT 'Main/u' || user_id || '/' || event_type AS path, CAST(floor(value * 100) AS BIGINT) AS size,
  epoch_us(ts) AS modified_us, event_id AS seq FROM @events) GROUP BY 1""")
def _(t):
    return T.run_snapshot(T.catalog_arrivals(_events(t)), ["path"], ["modified_us", "seq"], "catalog").select("path", "size", "modified_us")


@query("t2_scan_progress", """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, event_type, count(*) AS files, sum(value) AS total, arg_max(value, (ts, event_id)) AS last_value FROM @events
  WHERE ts IS NOT NULL GROUP BY date_trunc('hour', ts), event_type""")
def _(t):
    return T.run_closed(_events(t), T.scan_progress, "progress")


@query("t3_issue_lifecycle", """SELECT project_id, issue, status, n AS event_id FROM (SELECT user_id AS project_id, props->>'$.k' AS issue, arg_max(CASE event_type WHEN 'click' THEN 'Unresolved' ELSE 'Resolved' END, (ts, event_id)) AS status,
  arg_max(event_id, (ts, event_id)) AS n FROM @events GROUP BY 1, 2)""")
def _(t):
    return T.run_snapshot(T.issue_lifecycle(_events(t)), ["project_id", "issue"], ["at_us", "event_id"], "issues").select("project_id", "issue", "status", "event_id")


@query("t4_session_expiry", """SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS expires_us, count(*) AS actions FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM @events)) GROUP BY user_id, s""")
def _(t):
    return T.run_closed(_events(t), T.session_expiry, "sessions")


@query("t5_undo_window", """SELECT d.event_id AS discard_id, u.event_id AS undo_id, d.user_id FROM @events d JOIN @events u ON d.user_id = u.user_id AND d.event_type = 'click' AND u.event_type = 'view'
  AND u.ts >= d.ts AND u.ts <= d.ts + INTERVAL 3600 SECOND""")
def _(t):
    return T.run_append(T.undo_window(_events(t), 3600), "undo")


@query("t6_content_dedupe", "SELECT DISTINCT sha256(concat_ws('|', props, event_type)) AS hash FROM @events")
def _(t):
    return T.run_append(T.content_dedupe(_events(t)).select("hash"), "dedupe")


@query("t7_throughput", """SELECT CAST(epoch(w) AS BIGINT) AS window_start, count(*) AS completed, count(*) / 7200 AS per_second, (100000 - count(*)) / (count(*) / 7200) AS eta_seconds
  FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM @events WHERE ts IS NOT NULL) GROUP BY w""")
def _(t):
    return T.run_closed(_events(t), T.throughput, "rate")


@query("a11_chunk_payloads", """SELECT doc_id, CAST(p AS INT) AS part, substr(text, (p - 1) * 500 + 1, 500) AS payload FROM (SELECT doc_id, text, unnest(range(1, CAST(greatest(ceil(length(text) / 500), 1) AS BIGINT) + 1)) AS p FROM @documents)""")
def _(t):
    return scan.chunk_payloads(t.documents, ["doc_id"], "text", 500)


@query("a11_reassemble", "SELECT doc_id, text FROM @documents")
def _(t):
    return scan.reassemble(scan.chunk_payloads(t.documents, ["doc_id"], "text", 500), ["doc_id"])


@query("a1_catalog_scan")
def _(t):
    return scan.catalog_scan(t.spark, t.sf_dir, ["parquet"]).select("file_name", "size", F.lit(True).alias("scanned"))
