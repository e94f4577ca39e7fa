"""Registered queries of the file catalog and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.functions import files as X
from recordqc.operators import catalog as K
from recordqc.plans.registry import query
from recordqc.session import written

C = F.col
NOW = 1735689600000  # the clock is a parameter of every operator


def nat(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '([0-9]+|[^0-9]+)', 1), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') "
            f"THEN lpad(CAST(length(CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END) AS VARCHAR), 3, '0') || CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END "
            f"ELSE r END), '')")


def inlist(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


NAME = "list_last(string_split(path, '/'))"
SYSTEM = f"(lower({NAME}) IN ('.ds_store', 'thumbs.db', 'desktop.ini') OR starts_with(lower({NAME}), '._'))"


def ext(n: str) -> str:
    return f"CASE WHEN contains({n}, '.') THEN lower(list_last(string_split({n}, '.'))) ELSE '' END"


def base(n: str) -> str:
    return f"CASE WHEN regexp_matches({n}, '^.+\\.[^.]*$') THEN regexp_extract({n}, '^(.+)\\.[^.]*$', 1) ELSE {n} END"


def comparable(b: str) -> str:
    out = f"lower({b})"
    for tail in X.NAME_TAILS:
        out = f"regexp_replace({out}, '{tail}', '', 'g')"
    return f"trim(regexp_replace({out}, '[_\\s-]+', ' ', 'g'))"


def date_name(s: str) -> str:
    rx = r"^(\d{1,4})[\s._-]+(\d{1,2})[\s._-]+(\d{1,4})$"
    g = lambda i: f"regexp_extract(trim({s}), '{rx}', {i})"
    n = lambda i: f"TRY_CAST({g(i)} AS INT)"
    full = lambda v: f"CASE WHEN {v} >= 70 THEN 1900 + {v} ELSE 2000 + {v} END"
    case = lambda a, b, c, d: f"(CASE WHEN length({g(1)}) = 4 THEN {a} WHEN length({g(3)}) = 4 THEN {b} WHEN {n(1)} > 12 THEN {c} WHEN {n(3)} > 12 THEN {d} END)"
    y, m, d = case(n(1), n(3), full(n(1)), full(n(3))), case(n(2), n(1), n(2), n(1)), case(n(3), n(2), n(3), n(2))
    return (f"CASE WHEN {y} BETWEEN 1900 AND 2200 AND TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE) IS NOT NULL "
            f"THEN printf('%d.%02d.%02d', {y}, {m}, {d}) ELSE {s} END")


SUP = inlist(X.RENAME_SUPPORTED)
EXPORT_EXT = "CASE WHEN extension IN ('jpg','jpeg','heic','heif') THEN 'jpg' ELSE extension END"
PROCESSED = (f"(extension IN {SUP} AND regexp_matches(secondary, '^\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}$') AND export_secondary = secondary "
             f"AND starts_with(lower(file_name), lower(secondary) || '_') "
             f"AND regexp_matches(lower(substr(file_name, length(secondary) + 2)), '^[0-9]{{3}}\\.') "
             f"AND substr(lower(file_name), length(secondary) + 6) = {EXPORT_EXT})")


def enriched(src: str = "@files_all") -> str:
    return f"""SELECT *, {PROCESSED} AS already_processed,
        CASE WHEN extension = '' THEN file_name ELSE base_name || '.' || {EXPORT_EXT} END AS export_name FROM (
      SELECT *, {date_name('secondary')} AS export_secondary, {base('file_name')} AS base_name, {ext('file_name')} AS extension FROM (
        SELECT *, {NAME} AS file_name, {SYSTEM} AS is_system, {nat('path')} AS natural_key,
          CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[2] ELSE 'Root files' END AS parent_name,
          CASE WHEN len(string_split(path, '/')) > 3 THEN string_split(path, '/')[3]
               WHEN len(string_split(path, '/')) > 2 THEN 'Folder root' ELSE 'Root level' END AS secondary,
          array_to_string(string_split(path, '/')[1:-2], '/') AS folder_path FROM {src}))"""


def backup_case(field: int) -> str:
    """The wanted field (0 suffix, 1 primary, 2 detail, 3 source) of the first matching backup pattern."""
    out = "CASE "
    for s, p, d in X.BACKUP_SUFFIXES:
        stem = f"left(file_name, length(file_name) - {len(s)})"
        src = f"trim(regexp_replace(regexp_replace({comparable(base(stem))}, '{X.BACKUP_WORDS}', '', 'g'), '\\s+', ' ', 'g'))"
        out += f"WHEN ends_with(lower(file_name), '{s}') THEN {[repr(s), repr(p), repr(d), src][field]} "
    stem = f"lower({base('file_name')})"
    nm = f"regexp_extract({stem}, '{X.NAMED_BACKUP}', 1)"
    out += f"WHEN regexp_matches(lower(file_name), '{X.NUMBERED_RVT}') THEN " + [
        "'.####.rvt'", "'rvt'", "'Revit numbered backup file related to RVT'", f"regexp_extract(lower(file_name), '{X.NUMBERED_RVT}', 1)"][field] + " "
    out += f"WHEN regexp_matches(lower(file_name), '{X.RECOVERY_NAME}') THEN " + [
        "'recovery'", "''", "'Adobe temp/recovery file related to primary source'", f"regexp_extract(lower(file_name), '{X.RECOVERY_NAME}', 1)"][field] + " "
    out += f"WHEN regexp_matches({stem}, '{X.NAMED_BACKUP}') AND {nm} <> '' THEN " + [
        "'backup-name'", "''", "'Backup/autosave file related to primary source'", comparable(nm)][field] + " END"
    return out


FULL = f"""SELECT *, CASE WHEN b_source <> '' THEN b_source ELSE {comparable('base_name')} END AS normalized_base FROM (
  SELECT *, {backup_case(0)} AS b_suffix, {backup_case(1)} AS b_primary, {backup_case(2)} AS b_detail, {backup_case(3)} AS b_source
  FROM ({enriched()}))"""

CLASS = f"""CASE WHEN extension IN {inlist(X.IMAGE)} THEN 'image' WHEN extension = 'pdf' THEN 'pdf' WHEN extension IN {inlist(X.DOCUMENT)} THEN 'document'
  WHEN extension IN {inlist(X.DESIGN)} THEN 'design' WHEN extension IN {inlist(X.VIDEO)} THEN 'video' ELSE 'unsupported' END"""


@query("x_enrich_files", f"""SELECT path, file_name, folder_path, parent_name, secondary, extension, base_name, is_system, natural_key,
  export_secondary, export_name, already_processed, coalesce(b_suffix, '') AS backup_suffix, coalesce(b_primary, '') AS backup_primary,
  coalesce(b_detail, '') AS backup_detail, normalized_base, {CLASS} AS file_class,
  CASE {CLASS} WHEN 'design' THEN 'cad' WHEN 'unsupported' THEN 'other' ELSE {CLASS} END AS review_group FROM ({FULL})""")
def _(t):
    e = K.enrich_files(t.files_all)
    n = lambda c: F.coalesce(C(f"backup.{c}"), F.lit(""))
    return e.select("path", "file_name", "folder_path", "parent_name", "secondary", "extension", "base_name", "is_system", "natural_key",
                    "export_secondary", "export_name", "already_processed", n("suffix").alias("backup_suffix"),
                    n("primary").alias("backup_primary"), n("detail").alias("backup_detail"), "normalized_base", "file_class", "review_group")


def any_of(words, x="upper(filename)"):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


DTYPE = "CASE " + " ".join(f"WHEN {any_of(w)} THEN '{k}'" for k, w in X.DRAWING_TYPES) + " ELSE 'Unknown' END"
NUM = r"regexp_extract(upper(" + base("filename") + r"), '\b([A-Z]{0,3}\d{2,4}(?:\.\d+)?)\b', 1)"
SHEETS = rf"""SELECT *, trim(regexp_replace(trim(regexp_replace(CASE WHEN sheet_number = '' THEN stem ELSE
    regexp_replace(stem, '(?i)' || replace(sheet_number, '.', '\.'), '', 'g') END, '[_-]+', ' ', 'g')), '\s+', ' ', 'g')) AS sheet_title
  FROM (SELECT seq, root, filename, size, {base('filename')} AS stem, {NUM} AS sheet_number, {DTYPE} AS drawing_type,
        CASE WHEN contains(upper(filename), 'SCALE') THEN 'SCALE' ELSE '' END AS keywords FROM @sheet_files)"""


@query("x13_sheet_names", f"SELECT seq, sheet_number, sheet_title, drawing_type, keywords FROM ({SHEETS})")
def _(t):
    return K.enrich_sheet_files(t.sheet_files).select("seq", "sheet_number", "sheet_title", "drawing_type",
                                                      F.array_join("keywords", ",").alias("keywords"))


@query("a2_content_hash", "SELECT doc_id, sha256(text) AS hash FROM @documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("a3_load_index", "SELECT filename, root, size, row_number() OVER (ORDER BY filename, seq) AS pos FROM @sheet_files WHERE root = 'set7'")
def _(t):
    from recordqc.operators.scale import ranked
    return ranked(t.sheet_files.where("root = 'set7'"), [], ["filename", "seq"], "pos").select("filename", "root", "size", "pos")


DIFF = """SELECT path, c.size, c.modified_ms, p.size AS o_size, p.modified_ms AS o_modified,
  CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'stale' WHEN c.size = p.size AND c.modified_ms = p.modified_ms THEN 'unchanged'
  ELSE 'changed' END AS status FROM @files c FULL JOIN @files_prior p USING (path)"""


@query("f1_index_diff", DIFF)
def _(t):
    return K.index_diff(t.files, t.files_prior)


@query("f1_diff_counts", f"""SELECT count(*) FILTER (status <> 'stale') AS scanned, count(*) FILTER (status IN ('new', 'changed')) AS indexed,
  count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status = 'stale') AS removed FROM ({DIFF})""")
def _(t):
    return K.diff_counts(K.index_diff(t.files, t.files_prior))


@query("f2_apply_diff", f"""SELECT path, size, modified_ms, CASE WHEN status = 'unchanged' THEN 0 ELSE {NOW} END AS indexed_at
  FROM ({DIFF}) WHERE status <> 'stale'""")
def _(t):
    return K.apply_diff(K.index_diff(t.files, t.files_prior), NOW)


@query("f3_summarize_files", f"""SELECT root, count(*) AS total_files, count(*) FILTER (size > 20000000) AS oversized,
  coalesce(string_agg(DISTINCT drawing_type, ', ' ORDER BY drawing_type) FILTER (drawing_type <> 'Unknown'), '') AS drawing_types FROM ({SHEETS}) GROUP BY root""")
def _(t):
    return K.summarize_files(K.enrich_sheet_files(t.sheet_files), 20000000)


@query("f4_duplicate_titles", f"""SELECT upper(trim(CASE WHEN sheet_title <> '' THEN sheet_title ELSE stem END)) AS title, count(*) AS files
  FROM ({SHEETS}) GROUP BY 1 HAVING count(*) > 1 AND title <> ''""")
def _(t):
    return K.duplicate_titles(K.enrich_sheet_files(t.sheet_files))


@query("f5_missing_sequences", rf"""WITH n AS (SELECT DISTINCT regexp_extract(sheet_number, '^([A-Z]+)\d+$', 1) AS prefix,
    CAST(regexp_extract(sheet_number, '(\d+)$', 1) AS BIGINT) AS num, length(regexp_extract(sheet_number, '(\d+)$', 1)) AS w
    FROM ({SHEETS}) WHERE regexp_matches(sheet_number, '^[A-Z]+\d+$')),
  r AS (SELECT prefix, min(num) AS lo, max(num) AS hi, max(w) AS w FROM n GROUP BY prefix),
  a AS (SELECT prefix, w, unnest(range(lo, hi + 1)) AS num FROM r)
  SELECT prefix, prefix || lpad(CAST(num AS VARCHAR), CAST(greatest(w, length(CAST(num AS VARCHAR))) AS INT), '0') AS sheet_number
  FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.prefix = a.prefix AND n.num = a.num)""")
def _(t):
    return K.missing_sequences(K.enrich_sheet_files(t.sheet_files))


TREE = """SELECT DISTINCT array_to_string(p[1:i], '/') AS folder, i AS depth FROM (
    SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM @files_all)
    UNION ALL SELECT p, unnest(range(1, len(p) + 1)) FROM (SELECT string_split(path, '/') AS p FROM @folders_extra))"""
STATS = f"""SELECT t.folder, t.depth, list_last(string_split(t.folder, '/')) AS name,
    CASE t.depth WHEN 1 THEN 'Main Folder' WHEN 2 THEN 'Parent Folder' WHEN 3 THEN 'Secondary Folder' ELSE 'Nested Folder' END AS level,
    coalesce(f.files, 0) AS files, coalesce(f.system_files, 0) AS system_files, coalesce(f.files - f.system_files, 0) AS usable_files,
    coalesce(f.direct_files, 0) AS direct_files, coalesce(f.last_modified, 0) AS last_modified,
    coalesce(d.sub_dirs, 0) AS sub_dirs, coalesce(d.child_dirs, 0) AS child_dirs
  FROM ({TREE}) t
  LEFT JOIN (SELECT array_to_string(p[1:i], '/') AS folder, count(*) AS files, count(*) FILTER (sys) AS system_files,
      count(*) FILTER (i = len(p) - 1) AS direct_files, max(modified_ms) AS last_modified
    FROM (SELECT string_split(path, '/') AS p, {SYSTEM} AS sys, modified_ms, unnest(range(1, len(string_split(path, '/')))) AS i FROM @files_all) GROUP BY 1) f
    USING (folder)
  LEFT JOIN (SELECT array_to_string(p[1:i], '/') AS folder, count(*) AS sub_dirs, count(*) FILTER (i = len(p) - 1) AS child_dirs
    FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(folder, '/') AS p FROM ({TREE}))) GROUP BY 1) d USING (folder)"""


@query("f6_folder_tree", f"SELECT folder, CAST(depth AS INT) AS depth, name, level FROM ({STATS})")
def _(t):
    return K.folder_tree(t.files_all, t.folders_extra).select("folder", "depth", "name", "level")


@query("f7_folder_stats", f"SELECT folder, files, system_files, usable_files, direct_files, last_modified, sub_dirs, child_dirs FROM ({STATS})")
def _(t):
    return K.folder_stats(t.files_all, t.folders_extra).select(
        "folder", "files", "system_files", "usable_files", "direct_files", "last_modified", "sub_dirs", "child_dirs")


R = f"(SELECT *, 'Main/' || parent_name || '/' || secondary AS folder FROM ({enriched()}) WHERE NOT is_system AND len(string_split(path, '/')) >= 4)"


@query("f8_processing_status", f"""SELECT folder, level, direct_files, files AS descendant_files, coalesce(supported, 0) AS supported,
  coalesce(processed, 0) AS processed, coalesce(unsupported, 0) AS unsupported,
  CASE WHEN supported > 0 AND processed = supported THEN 'Already Processed' WHEN processed > 0 THEN 'Partially Processed' ELSE 'Needs Processing' END AS status
  FROM ({STATS}) LEFT JOIN (SELECT folder, count(*) FILTER (extension IN {SUP}) AS supported, count(*) FILTER (already_processed) AS processed,
    count(*) FILTER (extension NOT IN {SUP}) AS unsupported FROM {R} GROUP BY folder) USING (folder)""")
def _(t):
    return K.processing_status(t.files_all, t.folders_extra)


@query("f8_parent_status", f"""SELECT parent_name, count(*) FILTER (extension IN {SUP}) AS supported, count(*) FILTER (already_processed) AS processed,
  CASE WHEN supported = 0 THEN 'Skipped' WHEN processed = supported THEN 'Already Processed' WHEN processed > 0 THEN 'Partially Processed'
  ELSE 'Needs Processing' END AS status FROM {R} GROUP BY parent_name""")
def _(t):
    return K.parent_status(t.files_all)


EMPTY = {("browser", "lenient"): ("usable_files = 0 AND depth >= 2", "CASE WHEN system_files > 0 THEN 'Only ignored system files and empty subfolders.' ELSE 'Empty folder tree.' END"),
         ("browser", "strict"): ("direct_files = 0 AND child_dirs = 0 AND depth >= 2", "'No files or child folders.'"),
         ("server", "lenient"): ("usable_files = 0 AND depth >= 2", "CASE WHEN child_dirs > 0 THEN 'Empty folder chain' WHEN files > 0 THEN 'Only ignored system files' ELSE 'Completely empty' END"),
         ("server", "strict"): ("files = 0 AND depth >= 2", "CASE WHEN child_dirs > 0 THEN 'Empty folder chain' WHEN files > 0 THEN 'Only ignored system files' ELSE 'Completely empty' END"),
         ("renamer", "lenient"): ("usable_files = 0 AND level IN ('Parent Folder', 'Secondary Folder')", "level")}
for (_variant, _mode), (_cond, _reason) in EMPTY.items():
    @query(f"f9_empty_{_variant}_{_mode}", f"SELECT folder, {_reason} AS reason FROM ({STATS}) WHERE {_cond}")
    def _(t, v=_variant, m=_mode):
        return K.empty_folders(K.folder_stats(t.files_all, t.folders_extra), m, v).select("folder", "reason")


@query("f10_age_filter", f"""SELECT folder, CASE WHEN last_modified = 0 THEN 'Folder date unknown.' ELSE {EMPTY['browser', 'lenient'][1]} END AS reason
  FROM ({STATS}) WHERE usable_files = 0 AND depth >= 2 AND (last_modified = 0 OR {NOW} - last_modified >= CAST(90 AS BIGINT) * 86400000)""")
def _(t):
    return K.age_filter(K.empty_folders(K.folder_stats(t.files_all, t.folders_extra)), 90, True, NOW).select("folder", "reason")


@query("f12_parent_rollup", f"""SELECT parent_name, folder_count, empty_count, coalesce(file_count, 0) AS file_count,
  coalesce(secondary_count, 0) AS secondary_count, coalesce(supported, 0) AS supported, coalesce(heic, 0) AS heic
  FROM (SELECT string_split(folder, '/')[2] AS parent_name, count(*) AS folder_count, count(*) FILTER (usable_files = 0) AS empty_count
        FROM ({STATS}) WHERE depth >= 2 GROUP BY 1)
  LEFT JOIN (SELECT parent_name, count(*) AS file_count, count(DISTINCT secondary) AS secondary_count,
        count(*) FILTER (extension IN {SUP}) AS supported, count(*) FILTER (extension IN ('heic', 'heif')) AS heic
        FROM ({enriched()}) WHERE NOT is_system GROUP BY 1) USING (parent_name)""")
def _(t):
    return K.parent_rollup(t.files_all, t.folders_extra)


@query("f13_compress_targets", f"""WITH s AS (SELECT folder AS path FROM ({STATS}) WHERE usable_files = 0 AND depth >= 2)
  SELECT path FROM s WHERE NOT EXISTS (SELECT 1 FROM s a WHERE starts_with(s.path, a.path || '/'))""")
def _(t):
    e = K.empty_folders(K.folder_stats(t.files_all, t.folders_extra))
    return K.compress_targets(e.select(C("folder").alias("path")))


COPYF = X.COPY_FOLDER
DUPF = f"""SELECT dense_rank() OVER (ORDER BY first_seq, hash, pk) AS group_number, path, parent_name, hash, copies, rk = 1 AS keep FROM (
    SELECT *, count(*) OVER w AS copies, min(seq) OVER w AS first_seq, row_number() OVER (PARTITION BY pk, hash ORDER BY score, natural_key, path) AS rk
    FROM (SELECT *, lower(parent_name) AS pk, CASE WHEN len(list_filter(string_split(path, '/')[2:-2], lambda f: regexp_matches(f, '{COPYF}'))) > 0 THEN 1 ELSE 0 END AS score
          FROM ({enriched()}) WHERE NOT is_system) WINDOW w AS (PARTITION BY pk, hash)) WHERE copies > 1"""


@query("f14_duplicate_files", DUPF)
def _(t):
    return K.duplicate_files(t.files_all)


DUPD = f"""WITH f AS (SELECT array_to_string(p[1:3], '/') AS folder, p[2] AS parent_name, p[3] AS name,
      string_agg(lower(array_to_string(p[4:], '/')) || ':' || size, '|' ORDER BY lower(array_to_string(p[4:], '/')), size) AS sig
    FROM (SELECT string_split(path, '/') AS p, size FROM @files_all) WHERE len(p) >= 4 GROUP BY ALL),
  g AS (SELECT *, count(*) OVER (PARTITION BY lower(parent_name), lower(name)) AS nn, count(*) OVER (PARTITION BY lower(parent_name), sig) AS ns,
      row_number() OVER (PARTITION BY lower(parent_name), lower(name) ORDER BY {nat('folder')}, folder) AS rn,
      row_number() OVER (PARTITION BY lower(parent_name), sig ORDER BY {nat('folder')}, folder) AS rs FROM f)
  SELECT folder, CASE WHEN ns > 1 THEN 'Contents appear identical' ELSE 'Folder name matches' END AS match, ns > 1 AS exact_duplicate,
    CASE WHEN ns > 1 THEN rs = 1 ELSE true END AS exact_keep, CASE WHEN nn > 1 THEN rn = 1 ELSE rs = 1 END AS keep FROM g WHERE nn > 1 OR ns > 1"""


@query("f15_duplicate_folders", DUPD)
def _(t):
    return K.duplicate_folders(t.files_all)


IDP = f"""WITH f AS (SELECT p[2] AS parent_name, string_agg(lower(array_to_string(p[3:], '/')) || ':' || size, '|' ORDER BY lower(array_to_string(p[3:], '/')), size) AS sig,
      min(seq) AS first_seq, count(*) FILTER (NOT sys) AS file_count
    FROM (SELECT string_split(path, '/') AS p, size, seq, {SYSTEM} AS sys FROM @files) WHERE len(p) >= 3 GROUP BY 1),
  g AS (SELECT *, count(*) OVER (PARTITION BY sig) AS n, min(first_seq) OVER (PARTITION BY sig) AS gs,
      row_number() OVER (PARTITION BY sig ORDER BY {nat('parent_name')}, parent_name) AS rk FROM f)
  SELECT dense_rank() OVER (ORDER BY gs) AS group_number, parent_name, rk = 1 AS keep, file_count FROM g WHERE n > 1"""


@query("f16_identical_parents", IDP)
def _(t):
    return K.identical_parents(t.files)


@query("f16_identical_parents_selected", f"""WITH i AS ({IDP}) SELECT * FROM (SELECT * FROM i WHERE parent_name <> 'P0 clone') s
  WHERE (SELECT count(*) FROM i x WHERE x.group_number = s.group_number AND x.parent_name <> 'P0 clone') > 1""")
def _(t):
    names = t.files.select(X.part(C("path"), 1).alias("parent_name")).distinct().where("parent_name <> 'P0 clone'")
    return K.identical_parents(t.files, names)


REMOVED = f"""SELECT folder FROM ({DUPD}) WHERE exact_duplicate AND NOT exact_keep UNION SELECT 'Main/' || parent_name FROM ({IDP}) WHERE NOT keep
  UNION SELECT folder FROM ({STATS}) WHERE {EMPTY['renamer', 'lenient'][0]}"""
# the removal plan of the query works on files without system rows, so both sides use @files
PLAN = f"""WITH rf AS ({REMOVED.replace('@files_all', '@files')}), df AS (SELECT path FROM ({DUPF.replace('@files_all', '@files')}) WHERE NOT keep)
  SELECT path, seq, parent, size, modified_ms, hash, EXISTS (SELECT 1 FROM rf WHERE starts_with(f.path, rf.folder || '/')) AS by_folder,
    path IN (SELECT path FROM df) AS by_file FROM @files f"""


def _plan(t):
    rows = written(t.files, "files")  # feeds six branches
    folders, files = K.exact_mode_removals(rows, t.folders_extra)
    return K.removal_plan(rows, folders, files)


@query("f17_removal_plan", f"SELECT path, by_folder, by_file, by_folder OR by_file AS excluded FROM ({PLAN})")
def _(t):
    return _plan(t).select("path", "by_folder", "by_file", "excluded")


RENAME = f"""SELECT *, row_number() OVER (PARTITION BY parent_name, export_secondary ORDER BY natural_key, path) AS n FROM ({enriched('PLANSRC')})
  WHERE NOT is_system AND len(string_split(path, '/')) >= 4"""
RENAMED = f"""SELECT *, extension IN {SUP} AND NOT already_processed AS would_rename, 'Main/' || parent_name || '/' || export_secondary || '/' ||
  CASE WHEN extension IN {SUP} AND NOT already_processed THEN export_secondary || '_' || printf('%03d', n) || '.' || {EXPORT_EXT} ELSE export_name END AS base_path FROM ({RENAME})"""
RSTATUS = f"""CASE WHEN excluded THEN 'Will Be Removed' WHEN extension NOT IN {SUP} THEN 'Skipped' WHEN already_processed THEN 'Already Processed' ELSE 'Needs Processing' END"""
PLANSRC = f"(SELECT *, by_folder OR by_file AS excluded FROM ({PLAN}))"


@query("f18_rename_plan", f"SELECT path, export_secondary, n, would_rename, base_path, {RSTATUS} AS status FROM ({RENAMED.replace('PLANSRC', PLANSRC)})")
def _(t):
    return K.record_status(K.rename_plan(_plan(t))).select("path", "export_secondary", "n", "would_rename", "base_path", "status")


@query("f19_resolve_collisions", f"""SELECT seq, base_path, CASE WHEN k = 1 THEN base_path ELSE regexp_replace(base_path, '(\\.[^./]*)$', '') || '_duplicate-' || k ||
    regexp_extract(base_path, '(\\.[^./]*)$', 1) END AS new_path
  FROM (SELECT seq, base_path, row_number() OVER (PARTITION BY lower(base_path) ORDER BY seq) AS k FROM (
    SELECT seq, 'Out/' || (doc % 5) || '/' || file_name AS base_path FROM (SELECT seq, seq % 1000 AS doc, {NAME} AS file_name FROM @files)))""")
def _(t):
    f = t.files.select("seq", F.concat(F.lit("Out/"), (C("seq") % 1000 % 5).cast("string"), F.lit("/"), X.file_name(C("path"))).alias("base_path"))
    return K.resolve_collisions(f)


def reserved_names(files):
    """Output paths of which every seventh carries a generated suffix already."""
    name = X.file_name(C("path"))
    taken = F.regexp_replace(name, r"^(.+?)(\.[^.]*)?$", F.concat(F.lit("$1_duplicate-"), (C("seq") % 5 + 2).cast("string"), F.lit("$2")))
    name = F.when(C("seq") % 7 == 0, taken).otherwise(name)
    return files.select("seq", F.concat(F.lit("Out/"), (C("seq") % 1000 % 5).cast("string"), F.lit("/"), name).alias("base_path"))


@query("f19_reserved_names")
def _(t):
    return K.resolve_collisions(reserved_names(t.files))


@query("f26_folder_counts", """SELECT array_to_string(p[1:i], '/') AS folder, count(*) AS files, CAST(i - 1 AS INT) AS depth FROM (
  SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM @files_all)) GROUP BY folder, i""")
def _(t):
    return K.folder_counts(t.files_all)


FX = f"(SELECT *, {NAME} AS nm, {SYSTEM} AS sys FROM @files_all)"
OLDEXT = "('.pdf', '.jpg', '.jpeg', '.png', '.tif', '.tiff', '.zip')"
HYG = rf"""SELECT 1 AS kind_rank, 'Empty folder' AS kind, 'review' AS status, folder AS item FROM ({STATS}) WHERE usable_files = 0 AND depth >= 2
  UNION ALL SELECT 2, 'System-only folder', 'review', folder FROM ({STATS}) WHERE files > 0 AND usable_files = 0
  UNION ALL SELECT 3, 'Inactive folder', 'attention', folder FROM ({STATS}) WHERE last_modified > 0 AND {NOW} - last_modified > CAST(365 AS BIGINT) * 86400000 AND usable_files > 0
  UNION ALL SELECT 4, 'Naming attention', 'review', folder FROM ({STATS}) WHERE regexp_matches(name, '(?i)\b(copy|old|backup|archive|final\s*final|temp|test)\b') AND usable_files > 0
  UNION ALL SELECT 5, 'Repeated folder name', 'info', folder FROM (SELECT folder, count(*) OVER (PARTITION BY lower(name)) AS n FROM ({STATS}) WHERE depth > 1) WHERE n > 1
  UNION ALL SELECT 6, 'System file', 'review', path FROM {FX} WHERE sys
  UNION ALL SELECT 7, 'Backup/temp file', 'review', path FROM {FX} WHERE NOT sys AND (starts_with(nm, '~$') OR regexp_matches(lower(nm), '\.(bak|tmp|temp|old|skb|dwl|dwl2|sv\$)$') OR regexp_matches(lower(nm), '\.\d{{4}}\.rvt$'))
  UNION ALL SELECT 8, 'Large file', 'attention', path FROM {FX} WHERE size >= 262144000
  UNION ALL SELECT 9, 'Old export', 'review', path FROM {FX} WHERE lower(regexp_extract(nm, '(\.[^.]*)$', 1)) IN {OLDEXT} AND modified_ms > 0 AND {NOW} - modified_ms > CAST(365 AS BIGINT) * 86400000"""


@query("f27_hygiene_findings", HYG)
def _(t):
    return K.hygiene_scan(t.files_all, t.folders_extra, NOW)


@query("f27_hygiene_report", f"SELECT * FROM ({HYG}) ORDER BY kind_rank, item")
def _(t):
    return K.hygiene_scan(t.files_all, t.folders_extra, NOW).orderBy("kind_rank", "item")


WANTED = """SELECT 'plain' AS desc_id, '2024.01.15' AS folder_name, array_to_string(string_split(path, '/')[4:], '/') AS rel_path, size FROM @files WHERE starts_with(path, 'Main/P3/2024.01.15/')
  UNION ALL SELECT 'twice', '2024.01.15', array_to_string(string_split(path, '/')[4:], '/'), size FROM @files WHERE starts_with(path, 'Main/P0/2024.01.15/')
  UNION ALL SELECT 'nosize', 'p7', array_to_string(string_split(path, '/')[3:], '/'), NULL FROM @files WHERE starts_with(path, 'Main/P7/')
  UNION ALL SELECT 'other size', '2024.01.15', array_to_string(string_split(path, '/')[4:], '/'), size + 1 FROM @files WHERE starts_with(path, 'Main/P5/2024.01.15/')"""


@query("f28_match_folders", f"""WITH w AS ({WANTED}), tot AS (SELECT desc_id, count(*) AS total FROM w GROUP BY 1),
  s AS (SELECT array_to_string(p[1:i], '/') AS folder, lower(p[i]) AS fname, lower(array_to_string(p[i + 1:], '/')) AS rel, size FROM (
     SELECT string_split(path, '/') AS p, size, unnest(range(1, len(string_split(path, '/')))) AS i FROM @files)),
  m AS (SELECT desc_id, folder FROM s JOIN w ON s.fname = lower(w.folder_name) AND s.rel = lower(w.rel_path) AND (w.size IS NULL OR w.size = s.size)
     GROUP BY 1, 2 HAVING count(*) = (SELECT total FROM tot WHERE tot.desc_id = w.desc_id))
  SELECT tot.desc_id, count(folder) AS candidates, CASE count(folder) WHEN 0 THEN 'none' WHEN 1 THEN 'matched' ELSE 'multiple' END AS match_status,
    CASE WHEN count(folder) = 1 THEN min(folder) END AS folder FROM tot LEFT JOIN m USING (desc_id) GROUP BY 1""")
def _(t):
    f = t.files
    rel = lambda n: F.array_join(F.slice(X.parts(C("path")), F.lit(n), F.size(X.parts(C("path")))), "/")
    pick = lambda d, name, prefix, n, size: f.where(C("path").startswith(prefix)).select(
        F.lit(d).alias("desc_id"), F.lit(name).alias("folder_name"), rel(n).alias("rel_path"), size.cast("bigint").alias("size"))
    wanted = (pick("plain", "2024.01.15", "Main/P3/2024.01.15/", 4, C("size"))
              .unionByName(pick("twice", "2024.01.15", "Main/P0/2024.01.15/", 4, C("size")))
              .unionByName(pick("nosize", "p7", "Main/P7/", 3, F.lit(None)))
              .unionByName(pick("other size", "2024.01.15", "Main/P5/2024.01.15/", 4, C("size") + 1)))
    return K.match_folders(f, wanted)


@query("f29_cleanup_summary", f"""SELECT parent_name, count(*) AS files, count(*) FILTER (needs) AS needs, count(*) FILTER (already_processed) AS processed,
  count(*) FILTER (needs AND excluded) AS needs_removed, count(*) FILTER (needs AND by_folder) AS needs_by_folder, count(*) FILTER (needs AND by_file) AS needs_by_file,
  count(*) FILTER (needs AND by_folder AND by_file) AS overlap, count(*) FILTER (already_processed AND excluded) AS processed_removed
  FROM (SELECT *, would_rename OR (extension IN {SUP} AND base_path <> path) AS needs FROM ({RENAMED.replace('PLANSRC', PLANSRC)})) GROUP BY parent_name""")
def _(t):
    return K.cleanup_summary(t.files, t.folders_extra, _plan(t))


DT_M = "CASE " + " ".join(f"WHEN {any_of(w, 'upper(X_)')} THEN '{k}'" for k, w in X.DRAWING_TYPES) + " ELSE 'Unknown' END"


@query("f30_archive_members", f"""WITH m AS (SELECT root || '.zip' AS archive, filename AS member, size, seq, {DT_M.replace('X_', 'filename')} AS dt FROM @sheet_files)
  SELECT archive, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes, coalesce(arg_min(dt, seq) FILTER (dt <> 'Unknown'), 'Unknown') AS drawing_type,
   '' AS keywords FROM m GROUP BY archive""")
def _(t):
    return K.archive_members(t.sheet_files.select(F.concat("root", F.lit(".zip")).alias("archive"), C("filename").alias("member"), "size", "seq"))


@query("f31_restore_plan", """WITH m AS (SELECT parent AS root, 'run' || (seq % 4) AS run, path FROM @files),
  l AS (SELECT root, max(run) AS run FROM m GROUP BY root), o AS (SELECT path FROM @files WHERE seq % 3 = 0)
  SELECT root, run, path, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, CASE WHEN path IN (SELECT path FROM o) THEN 'failed' ELSE 'restore' END AS outcome,
    CASE WHEN path IN (SELECT path FROM o) THEN 'Original path already exists.' ELSE '' END AS message FROM m JOIN l USING (root, run)""")
def _(t):
    f = t.files
    m = f.select(C("parent").alias("root"), F.concat(F.lit("run"), (C("seq") % 4).cast("string")).alias("run"), "path")
    return K.restore_plan(m, f.where("seq % 3 = 0").select("path"))


@query("a8_folder_audit", f"""SELECT 'catalog' AS source, 'lenient' AS empty_definition, CAST(0 AS INT) AS age_filter_days, folder AS folder_path, string_split(folder, '/')[2] AS parent_folder,
  last_modified, 'ready' AS status, CASE WHEN depth % 2 = 0 THEN 'yes' ELSE 'no' END AS selected, {EMPTY['browser', 'lenient'][1]} AS reason FROM ({STATS}) WHERE usable_files = 0 AND depth >= 2""")
def _(t):
    rows = K.empty_folders(K.folder_stats(t.files_all, t.folders_extra))
    return K.folder_audit(rows, rows.where("depth % 2 = 0").select("folder"), "catalog", "lenient", 0)


@query("a9_file_detail", f"""SELECT path, parent_name, secondary, export_secondary, file_name, extension, size, CASE WHEN extension IN {SUP} THEN 'Yes' ELSE 'No' END AS supported,
  CASE WHEN extension IN ('heic', 'heif') THEN 'Yes' ELSE 'No' END AS heic, CASE WHEN already_processed THEN 'Yes' ELSE 'No' END AS processed, base_path AS new_path, {RSTATUS} AS status,
  CASE WHEN excluded THEN 'Remove from ZIP' ELSE 'Keep in ZIP' END AS zip_action, CASE WHEN would_rename AND NOT excluded THEN 'Yes' ELSE 'No' END AS renamed FROM ({RENAMED.replace('PLANSRC', PLANSRC)})""")
def _(t):
    return K.rename_file_detail(_plan(t))


@query("a9_parent_summary", f"""SELECT parent_name, count(DISTINCT secondary) AS secondary_folders, count(*) AS files, count(*) FILTER (extension IN {SUP}) AS supported,
  count(*) FILTER (extension IN ('heic', 'heif')) AS heic, CASE WHEN supported = 0 THEN 'Skipped' WHEN count(*) FILTER (already_processed) = supported THEN 'Already Processed'
  WHEN count(*) FILTER (already_processed) > 0 THEN 'Partially Processed' ELSE 'Needs Processing' END AS status FROM {R} GROUP BY 1""")
def _(t):
    return K.rename_parent_summary(t.files_all)
