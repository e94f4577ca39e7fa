"""Registered queries of backup matching and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.functions import files as X
from recordqc.operators import backups as B
from recordqc.plans.catalog import CLASS, FULL, inlist
from recordqc.plans.registry import query

C = F.col
_BASE = FULL.replace("@files_all", "@files")
REC = f"(SELECT *, {CLASS} AS file_class, regexp_matches(folder_path, '{X.BACKUP_FOLDER}') AS signal FROM ({_BASE}) WHERE NOT is_system)"
TOK = lambda c: f"list_filter(string_split({c}, ' '), lambda t: length(t) > 2)"
MATCH = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, original_modified DESC, original_seq) AS pick FROM (
  SELECT *, CAST(CASE WHEN exact THEN 80 ELSE 0 END + CASE WHEN alike THEN 30 ELSE 0 END + 20 + CASE WHEN same_folder THEN 15 ELSE 0 END
    + CASE WHEN same_parent THEN 8 ELSE 0 END + CASE WHEN older THEN 8 ELSE 0 END AS BIGINT) AS score FROM (
  SELECT b.seq, b.path, p.path AS original, p.seq AS original_seq, p.file_name AS original_name, p.extension AS original_ext, p.normalized_base AS original_base,
    p.modified_ms AS original_modified, p.size AS original_size, b.normalized_base = p.normalized_base AS exact,
    b.folder_path = p.folder_path AS same_folder, b.parent_name = p.parent_name AS same_parent,
    b.modified_ms = 0 OR p.modified_ms = 0 OR b.modified_ms <= p.modified_ms OR b.signal AS older,
    CASE WHEN contains(b.normalized_base, p.normalized_base) OR contains(p.normalized_base, b.normalized_base)
      THEN least(length(b.normalized_base), length(p.normalized_base)) >= 6
      ELSE len({TOK('b.normalized_base')}) > 0 AND len({TOK('p.normalized_base')}) > 0 AND
        len(list_filter({TOK('p.normalized_base')}, lambda x: list_contains({TOK('b.normalized_base')}, x)))
          >= least(2, least(len(list_distinct({TOK('b.normalized_base')})), len({TOK('p.normalized_base')}))) END AS alike
  FROM {REC} b JOIN {REC} p ON b.b_suffix IS NOT NULL AND p.b_suffix IS NULL AND p.extension IN {inlist(X.ORIGINALS)}
    AND (b.b_primary = '' OR b.b_primary = p.extension) AND (b.folder_path = p.folder_path OR b.parent_name = p.parent_name OR b.signal OR p.signal))
  WHERE (exact OR alike) AND (older OR exact))) WHERE pick = 1"""


@query("f20_match_backups", f"""SELECT seq, path, original, score, CASE WHEN exact THEN 'Exact backup match' ELSE 'Likely backup' END AS confidence FROM ({MATCH})""")
def _(t):
    return B.match_backups(B.catalog_records(t.files)).select("seq", "path", "original", "score", "confidence")


GRP = f"""WITH rec AS MATERIALIZED (SELECT * FROM {REC}), mat AS MATERIALIZED ({MATCH}),
  grp AS (SELECT *, b_suffix IS NULL AS nb, count(*) FILTER (b_suffix IS NULL) OVER g AS n_nb, max(modified_ms) FILTER (b_suffix IS NULL) OVER g AS mx,
      min(modified_ms) FILTER (b_suffix IS NULL) OVER g AS mn,
      first_value(seq) OVER (PARTITION BY normalized_base, extension ORDER BY modified_ms DESC, seq) AS s0_seq,
      first_value(path) OVER (PARTITION BY normalized_base, extension ORDER BY modified_ms DESC, path) AS newest,
      bool_or((regexp_matches(base_name, '{X.COPY_NAME}') OR regexp_matches(base_name, '{X.VERSION_NAME}')) AND b_suffix IS NULL) OVER g AS sig,
      count(*) OVER (PARTITION BY normalized_base, extension, size, b_suffix IS NULL) AS same,
      first_value(seq) OVER z AS p1, nth_value(modified_ms, 1) OVER z AS p1m, nth_value(modified_ms, 2) OVER z AS p2m
    FROM rec WINDOW g AS (PARTITION BY normalized_base, extension),
      z AS (PARTITION BY normalized_base, extension, size, b_suffix IS NULL ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  cls AS (SELECT *, size > 0 AND same > 1 AS exact, NOT (size > 0 AND same > 1) AND modified_ms <> 0 AND mx - modified_ms > 2000 AND seq <> s0_seq AS older
    FROM grp WHERE nb AND n_nb >= 2),
  fo AS (SELECT normalized_base, extension, min(seq) AS first_older FROM cls WHERE older GROUP BY 1, 2),
  cl2 AS (SELECT cls.*, first_older, coalesce(seq = s0_seq AND first_older < seq AND path NOT IN (SELECT original FROM mat), false) AS skip
    FROM cls LEFT JOIN fo USING (normalized_base, extension)),
  hits AS (
    SELECT path, 'Exact Duplicate' AS label, CASE WHEN abs(CASE WHEN p1 = seq THEN p2m ELSE p1m END - modified_ms) <= 2000 THEN 'Same size, modified date, and matching name pattern'
        ELSE 'Same size and matching name pattern' END AS detail, 'exact:' || normalized_base || '|' || extension || ':' || size AS group_key,
        path = newest AS keep, false AS review, '' AS role, 1 AS phase, seq * 2 AS ord FROM cl2 WHERE exact AND NOT skip
    UNION ALL SELECT path, 'Older Version', 'Older file with matching base name', 'version:' || normalized_base || '|' || extension, false, false, 'older', 1, seq * 2 FROM cl2 WHERE older AND NOT skip
    UNION ALL SELECT path, 'Older Version', 'Newer version kept for comparison', 'version:' || normalized_base || '|' || extension, true, false, 'newer', 1, first_older * 2 + 1
      FROM grp JOIN fo USING (normalized_base, extension) WHERE seq = s0_seq
    UNION ALL SELECT path, 'Naming Duplicate', 'Similar name, but size and modified date differ', 'naming:' || normalized_base || '|' || extension, false, true, '', 1, seq * 2
      FROM cl2 WHERE NOT exact AND NOT older AND NOT skip AND sig AND greatest(mx - modified_ms, modified_ms - mn) > 2000)"""


@query("f21_classify_related", f"{GRP} SELECT path, label, detail, group_key, keep, review, role FROM hits")
def _(t):
    from recordqc.session import written
    r = written(B.catalog_records(t.files).drop("hash"), "records")
    return B.classify_related(r, B.match_backups(r, stored=True).select(C("original").alias("path"))).select("path", "label", "detail", "group_key", "keep", "review", "role")


CLEAR = " OR ".join(f"ends_with(lower(file_name), '{e}')" for e in X.CLEAR_BACKUP_ENDINGS)
ALLHITS = f"""{GRP}, bk AS (SELECT r.*, m.original, m.original_base, m.original_ext, m.original_modified, m.original_size, m.exact AS m_exact FROM rec r LEFT JOIN mat m USING (path) WHERE r.b_suffix IS NOT NULL),
  ah AS (SELECT * FROM hits
   UNION ALL SELECT path, 'Backup / Autosave', 'Possible backup - no original found', 'backup-unmatched:' || parent_name || ':' || normalized_base, false, true, 'backup', 0, seq * 2 FROM bk WHERE original IS NULL
   UNION ALL SELECT path, 'Backup / Autosave', CASE WHEN extension = 'bak' AND original_ext = 'dwg' THEN 'AutoCAD .bak file related to DWG' WHEN original_ext = '3dm' THEN 'Rhino backup/autosave file related to 3DM' ELSE b_detail END,
      'backup:' || original_base || ':' || original_ext, false, false, 'backup', 0, seq * 2 FROM bk WHERE original IS NOT NULL
   UNION ALL SELECT original, 'Backup / Autosave', 'Original/main file kept for comparison', 'backup:' || original_base || ':' || original_ext, true, false, 'original', 0, seq * 2 + 1 FROM bk WHERE original IS NOT NULL),
  dd AS (SELECT path, detail, min(phase * 1000000000 + ord) AS first_at FROM ah GROUP BY 1, 2),
  fl AS (SELECT a.path, CASE WHEN bool_or(label = 'Backup / Autosave') THEN 'Backup / Autosave' WHEN bool_or(label = 'Exact Duplicate') THEN 'Exact Duplicate'
      WHEN bool_or(label = 'Older Version') THEN 'Older Version' ELSE 'Naming Duplicate' END AS label,
      string_agg(DISTINCT label, '; ' ORDER BY label) AS labels, min(group_key) AS group_label,
      coalesce(arg_min(role, phase * 1000000000 + ord) FILTER (role <> ''), '') AS role,
      CASE WHEN bool_or(keep) THEN 'keep' WHEN bool_or(review) THEN 'review' ELSE 'discard' END AS action FROM ah a GROUP BY a.path),
  rs AS (SELECT path, string_agg(detail, '; ' ORDER BY first_at) AS reason FROM dd GROUP BY 1),
  flags AS (SELECT fl.*, rs.reason, r.file_name, r.folder_path, r.parent_name, r.extension, r.file_class, r.size, r.modified_ms, r.seq
    FROM fl JOIN rs USING (path) JOIN rec r USING (path))"""


@query("f22_finalize_flags", f"{ALLHITS} SELECT path, label, labels, reason, group_label, role, action FROM flags")
def _(t):
    return B.flag_files(t.files).select("path", "label", "labels", "reason", "group_label", "role", "action")


@query("f23_filter_flags", f"""{ALLHITS} SELECT path, label, action FROM flags WHERE label = 'Backup / Autosave' AND file_class = 'design'
  AND starts_with(folder_path, 'Main/P1') AND contains(lower(file_name || ' ' || folder_path || ' ' || reason || ' ' || label), 'original')""")
def _(t):
    return B.filter_flags(B.flag_files(t.files), "Backup / Autosave", "cad", "Main/P1", "original").select("path", "label", "action")


@query("f24_review_groups", f"""{ALLHITS}, g AS (SELECT group_label, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size, max(modified_ms) AS newest, max(size) AS largest FROM flags GROUP BY 1)
  SELECT g.*, group_label IN (SELECT group_label FROM g WHERE files > 1 ORDER BY total_size DESC, group_label LIMIT 3) AS is_largest FROM g""")
def _(t):
    return B.review_groups(B.flag_files(t.files))


STATE = "(SELECT path, seq % 3 = 0 AS selected, seq % 5 = 0 AS discarded, seq % 7 = 0 AS grouped, seq % 10 = 0 AS deleted FROM @files)"


def _state(t):
    s = C("seq")
    return t.files.select("path", (s % 3 == 0).alias("selected"), (s % 5 == 0).alias("discarded"), (s % 7 == 0).alias("grouped"), (s % 10 == 0).alias("deleted"))


@query("f25_cleanup_stats", f"""SELECT count(*) AS total_files, count(*) FILTER (p) AS selected_files, count(*) - count(*) FILTER (p) AS files_to_keep, CAST(sum(size) AS BIGINT) AS original_storage,
  CAST(coalesce(sum(size) FILTER (p), 0) AS BIGINT) AS selected_size, CAST(coalesce(sum(size) FILTER (c), 0) AS BIGINT) AS committed_size,
  CAST(sum(size) - coalesce(sum(size) FILTER (p), 0) AS BIGINT) AS storage_after, coalesce(sum(size) FILTER (c), 0) * 100.0 / sum(size) AS cleanup_percent
  FROM (SELECT f.size, coalesce(selected OR discarded OR grouped OR deleted, false) AS p, coalesce(discarded OR grouped OR deleted, false) AS c FROM @files f LEFT JOIN {STATE} s USING (path))""")
def _(t):
    a = _state(t).select("path", (C("selected") | C("discarded") | C("grouped") | C("deleted")).alias("selected"), (C("discarded") | C("grouped") | C("deleted")).alias("committed"))
    return B.cleanup_stats(t.files, a)


@query("f25_workflow_status", f"""SELECT path, CASE WHEN deleted THEN 'Recycle Bin' WHEN discarded THEN 'Review Bin' WHEN grouped THEN 'Backup grouping prepared'
  WHEN selected THEN 'Selected' ELSE 'Active' END AS workflow FROM {STATE} s""")
def _(t):
    return B.workflow_status(_state(t)).select("path", "workflow")


@query("a7_cleanup_report", f"""{ALLHITS} SELECT label AS category, file_name, f.path, file_class AS file_type, f.size, f.modified_ms, reason,
    CASE WHEN s.selected THEN 'Selected' ELSE 'Not selected' END AS selection_status,
    CASE WHEN s.deleted THEN 'Recycled' WHEN s.discarded THEN 'Review Bin' WHEN s.grouped THEN 'Backup grouping prepared' WHEN s.selected THEN 'Selected' ELSE 'Active' END AS deletion_status,
    CASE WHEN s.grouped THEN 'Prepared for grouped backup folder' ELSE '' END AS grouping_status, CASE WHEN f.seq % 23 = 0 THEN 'locked' ELSE '' END AS error
  FROM flags f LEFT JOIN {STATE} s USING (path)
  UNION ALL SELECT 'Error', list_last(string_split(path, '/')), path, '', NULL, NULL, '', '', 'Error', '', 'locked' FROM @files WHERE seq % 23 = 0""")
def _(t):
    fail = t.files.where("seq % 23 = 0").select("path", F.lit("locked").alias("message"))
    return B.cleanup_report(B.flag_files(t.files), _state(t), fail).drop("related_name")
