"""Registered queries of the issue life cycle and of imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.operators import issues as I
from recordqc.operators.precedents import choose_metric, unit_sums
from recordqc.plans.precedents import FACTS, MEAN, WF, facts
from recordqc.plans.registry import query
from recordqc.session import written

C = F.col
INC = "'Equipment values incomplete'"
_U = "(chosen IS NOT NULL OR unit_rows > 0)"
DET = f"""det AS (SELECT project_id, project_number, 'Mechanical' AS discipline, 'Conflicting values' AS category, 'Recorded project total and listed equipment sum require staff review.' AS message, 'Warning' AS severity FROM facts WHERE review_required
  UNION ALL SELECT project_id, project_number, 'General', 'Square footage not shown', 'Project square footage is not recorded.', 'Warning' FROM facts WHERE square_feet IS NULL
  UNION ALL SELECT project_id, project_number, 'General', {INC}, 'No usable mechanical or electrical values are recorded.', 'Blocking' FROM facts WHERE NOT ({_U} OR panel_rows > 0 OR coalesce(duct_feet > 0, false))
  UNION ALL SELECT project_id, project_number, 'Mechanical', {INC}, 'Mechanical conditions are described in notes, but detailed equipment values are incomplete.', 'Warning' FROM facts WHERE NOT {_U} AND note <> ''
  UNION ALL SELECT project_id, project_number, 'General', 'Consultant not identified', 'MEP consultant is not identified.', 'Warning' FROM facts WHERE canonical = 'Unknown'
  UNION ALL SELECT project_id, project_number, 'Mechanical', {INC}, 'Primary equipment manufacturer is not recorded.', 'Note' FROM facts WHERE {_U} AND NOT has_manufacturer
  UNION ALL SELECT project_id, project_number, 'Mechanical', {INC}, 'Primary equipment model is not recorded.', 'Note' FROM facts WHERE {_U} AND NOT has_model
  UNION ALL SELECT project_id, project_number, 'Electrical', {INC}, 'Electrical panel information is not recorded.', 'Warning' FROM facts WHERE trim(coalesce(service_info, '')) NOT IN ('', 'Unknown') AND panel_rows = 0 AND panel_count IS NULL
  UNION ALL SELECT project_id, project_number, 'General', 'Project intentionally excluded from analysis', 'Project is excluded from estimator and consultant statistics.', 'Blocking' FROM facts WHERE excluded)"""


@query("i1_detect_issues", f"{WF}, {DET} SELECT * FROM det")
def _(t):
    return I.detect_issues(facts(t))


@query("i2_validate", f"""{WF}, {DET} SELECT project_id, same_number, CASE WHEN project_id IN (SELECT project_id FROM det WHERE severity = 'Blocking') THEN 'blocking'
  WHEN project_id > first_id THEN 'blocking' WHEN project_id IN (SELECT project_id FROM det WHERE severity = 'Warning') THEN 'warnings' ELSE 'saved' END AS outcome
  FROM (SELECT *, count(*) OVER w AS same_number, min(project_id) OVER w AS first_id FROM facts WINDOW w AS (PARTITION BY lower(project_number)))""")
def _(t):
    return I.validate(written(facts(t), "facts"))


# saved issues: what an earlier run may have stored for every third project, plus stale ones
OLD = f"""old AS (SELECT project_id, discipline, category, message, project_id AS seq, CASE WHEN project_id % 2 = 0 THEN 'Resolved' ELSE 'Unresolved' END AS status, true AS auto FROM det WHERE project_id % 3 = 0
  UNION ALL SELECT project_id, 'Mechanical', 'Other', 'Stale finding.', project_id, CASE WHEN project_id % 4 = 0 THEN 'Resolved' ELSE 'Unresolved' END, project_id % 5 <> 0 FROM facts WHERE project_id % 6 = 1)"""


def _old(f, det):
    p = C("project_id")
    a = det.where("project_id % 3 = 0").select("project_id", "discipline", "category", "message", p.alias("seq"),
                                                F.when(p % 2 == 0, "Resolved").otherwise("Unresolved").alias("status"), F.lit(True).alias("auto"))
    b = f.where("project_id % 6 = 1").select("project_id", F.lit("Mechanical").alias("discipline"), F.lit("Other").alias("category"), F.lit("Stale finding.").alias("message"),
                                             p.alias("seq"), F.when(p % 4 == 0, "Resolved").otherwise("Unresolved").alias("status"), (p % 5 != 0).alias("auto"))
    return a.unionByName(b)


@query("i3_sync_issues", f"""{WF}, {DET}, {OLD} SELECT project_id, discipline, category, message,
    CASE WHEN o.seq IS NULL THEN 'insert' WHEN d.seen IS NULL AND status <> 'Resolved' THEN 'resolve' WHEN d.seen IS NULL THEN 'keep' WHEN status = 'Resolved' THEN 'reopen' ELSE 'keep' END AS action,
    CASE action WHEN 'insert' THEN 'Unresolved' WHEN 'reopen' THEN 'Unresolved' WHEN 'resolve' THEN 'Resolved' ELSE status END AS new_status
  FROM (SELECT * FROM old WHERE auto) o FULL JOIN (SELECT DISTINCT project_id, discipline, category, message, true AS seen FROM det) d USING (project_id, discipline, category, message)
  UNION ALL SELECT project_id, discipline, category, message, 'keep', status FROM old WHERE NOT auto""")
def _(t):
    f = written(facts(t), "facts")
    det = I.detect_issues(f)
    return I.sync_issues(_old(f, det), det).select("project_id", "discipline", "category", "message", "action", "new_status")


TOKS = "list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(message), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)))"


@query("i6_quality_status", """SELECT p.project_id, CASE WHEN excluded THEN 'Excluded' WHEN blocking > 0 THEN 'Blocked' WHEN warning > 0 THEN 'Warning' WHEN related > 0 AND open_issues = 0 THEN 'Resolved' ELSE 'Complete' END AS quality
  FROM @projects p LEFT JOIN (SELECT project_id, count(*) AS related, count(*) FILTER (status <> 'Resolved') AS open_issues, count(*) FILTER (status <> 'Resolved' AND severity = 'Blocking') AS blocking,
    count(*) FILTER (status <> 'Resolved' AND severity = 'Warning') AS warning FROM @issue_log GROUP BY 1) i ON p.project_id = i.project_id""")
def _(t):
    return I.quality_status(t.projects, t.issue_log)


@query("i7_issue_view", """SELECT seq, severity, status, row_number() OVER (ORDER BY CASE WHEN status = 'Resolved' THEN 1 ELSE 0 END, CASE severity WHEN 'Blocking' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END, seq DESC) AS position
  FROM @issue_log WHERE discipline = 'Mechanical'""")
def _(t):
    return I.issue_view(t.issue_log, discipline="Mechanical").select("seq", "severity", "status", "position")


@query("i7_issue_counts", "SELECT discipline, severity, count(*) AS issues, count(*) FILTER (status <> 'Resolved') AS unresolved FROM @issue_log GROUP BY 1, 2")
def _(t):
    return I.issue_counts(t.issue_log)


NAMED = """(SELECT seq, project_id * 40 AS project_id, '19' || (90 + project_id % 10) || '-' || lpad(CAST(project_id AS VARCHAR(4)), 4, '0') AS project_number,
  CASE WHEN seq % 11 = 0 THEN 'total:' || seq WHEN seq % 3 = 0 THEN 'project ' || (seq % 2000) ELSE '' END AS project_name, discipline, category, message, status, auto FROM @issue_log)"""


def _named(t):
    s, p = C("seq"), C("project_id")
    return t.issue_log.select("seq", (p * 40).alias("project_id"), F.concat(F.lit("19"), (p % 10 + 90).cast("string"), F.lit("-"), F.lpad(p.cast("string"), 4, "0")).alias("project_number"),
                              F.when(s % 11 == 0, F.concat(F.lit("total:"), s.cast("string"))).when(s % 3 == 0, F.concat(F.lit("project "), (s % 2000).cast("string"))).otherwise("").alias("project_name"),
                              "discipline", "category", "message", "status", "auto")


@query("i8_live_issues", f"""SELECT seq, project_id, project_name FROM {NAMED} i WHERE NOT starts_with(project_name, 'total:') AND (project_id IN (SELECT project_id FROM @projects)
  OR lower(project_number) IN (SELECT lower(project_number) FROM @projects) OR lower(project_name) IN (SELECT lower(project_name) FROM @projects))""")
def _(t):
    return I.live_issues(_named(t), t.projects).select("seq", "project_id", "project_name")


@query("a12_exportable_issues", f"""{WF}, {DET} SELECT seq, status FROM {NAMED} i WHERE NOT starts_with(project_name, 'total:') AND (status = 'Resolved' OR NOT auto
  OR EXISTS (SELECT 1 FROM det d WHERE d.project_id = i.project_id AND d.discipline = i.discipline AND d.category = i.category AND d.message = i.message))""")
def _(t):
    return I.exportable_issues(_named(t), I.detect_issues(facts(t))).select("seq", "status")


@query("i9_resolve", """SELECT seq, CASE WHEN seq % 6 = 0 THEN 'Unresolved' WHEN seq % 4 = 1 THEN 'Resolved' ELSE status END AS status, CAST(CASE WHEN seq % 6 = 0 OR seq % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS entries FROM @issue_log""")
def _(t):
    log = t.issue_log.withColumn("history", F.lit(None).cast("array<struct<action:string,staff:string,at:bigint>>"))
    s = C("seq")
    dec = t.issue_log.where("seq % 6 = 0 or seq % 4 = 1").select("seq", F.when(s % 6 == 0, "reopen").otherwise("resolve").alias("decision"), F.lit("staff").alias("staff"), s.alias("at"))
    return I.resolve(log, dec).select("seq", "status", F.size("history").cast("bigint").alias("entries"))


@query("i18_apply_decisions", f"""{WF} SELECT project_id, CASE project_id % 6 WHEN 0 THEN stated WHEN 1 THEN calc_tons WHEN 2 THEN 77.0 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE chosen END AS chosen,
  CASE project_id % 6 WHEN 3 THEN 'Needs review' WHEN 5 THEN verification ELSE 'Manually confirmed' END AS verification, project_id % 6 = 4 AS excluded_by_decision
  FROM facts WHERE calc_tons IS NOT NULL OR stated IS NOT NULL""")
def _(t):
    m = choose_metric(unit_sums(t.units), t.stated_totals).where("calculated is not null or stated is not null")
    p = C("project_id") % 6
    dec = m.where("project_id % 6 <> 5").select("project_id", F.when(p == 0, "stated").when(p == 1, "calculated").when(p == 2, "corrected").when(p == 3, "review").otherwise("exclude").alias("decision"),
                                                F.lit(77.0).alias("corrected"))
    return I.apply_decisions(m, dec)


# the first 10,000 order keys have unique numbers; later ones repeat them and act as the incoming batch
EX = "(SELECT * FROM @projects WHERE project_id % 2 = 0)"
INCO = """(SELECT project_id + 1 AS project_id, seq, project_number, CASE WHEN project_id % 3 = 0 THEN upper(project_name) ELSE project_name || ' rev' END AS project_name,
  CASE WHEN project_id % 5 = 0 THEN 'OTHER' ELSE building_type END AS building_type, CASE WHEN project_id % 7 = 0 THEN 'North Group' ELSE consultant END AS consultant,
  CASE WHEN project_id % 22 = 0 THEN 1234.0 ELSE square_feet END AS square_feet, excluded FROM @projects)"""
KEY = "'number:' || upper(trim(project_number))"


def _existing(t):
    return t.projects.where("project_id % 2 = 0")


def _incoming(t):
    p = C("project_id")
    return t.projects.select(
        (p + 1).alias("project_id"), "seq", "project_number", F.when(p % 3 == 0, F.upper("project_name")).otherwise(F.concat("project_name", F.lit(" rev"))).alias("project_name"),
        F.when(p % 5 == 0, "OTHER").otherwise(C("building_type")).alias("building_type"), F.when(p % 7 == 0, "North Group").otherwise(C("consultant")).alias("consultant"),
        F.when(p % 22 == 0, 1234.0).otherwise(C("square_feet")).alias("square_feet"), "excluded")


_DIFF = " UNION ALL ".join(f"SELECT {KEY.replace('project_number', 'e.project_number')} AS pkey, '{c}' AS field, e.{c} AS saved, i.{c} AS incoming FROM {EX} e JOIN {INCO} i ON lower(trim(e.project_number)) = lower(trim(i.project_number)) "
                           f"WHERE {MEAN('e.' + c)} AND {MEAN('i.' + c)} AND lower(trim(e.{c})) <> lower(trim(i.{c}))" for c in ("project_name", "building_type", "consultant"))


@query("i19_project_conflicts", _DIFF)
def _(t):
    return I.project_conflicts(_existing(t), _incoming(t)).where("field <> 'square_feet'")


@query("i19_square_feet_conflicts", f"""SELECT {KEY.replace('project_number', 'e.project_number')} AS pkey, e.square_feet AS saved, i.square_feet AS incoming FROM {EX} e JOIN {INCO} i ON lower(trim(e.project_number)) = lower(trim(i.project_number))
  WHERE e.square_feet <> i.square_feet""")
def _(t):
    return I.project_conflicts(_existing(t), _incoming(t)).where("field = 'square_feet'").select("pkey", C("saved").cast("double").alias("saved"), C("incoming").cast("double").alias("incoming"))


for _mode in ("merge", "replace", "skip"):
    def _pick(c, m=_mode):
        ok = f"e.{c} IS NOT NULL" if c == "square_feet" else MEAN("e." + c)
        both = {"merge": f"CASE WHEN {ok} THEN e.{c} ELSE i.{c} END", "replace": f"i.{c}", "skip": f"e.{c}"}[m]
        return f"CASE WHEN i.pk IS NULL THEN e.{c} WHEN e.pk IS NULL THEN i.{c} ELSE {both} END AS {c}"

    @query(f"i20_commit_{_mode}", f"""SELECT coalesce(e.pk, i.pk) AS pkey, {', '.join(_pick(c) for c in ('project_number', 'project_name', 'building_type', 'consultant', 'square_feet'))},
      CASE WHEN e.pk IS NULL THEN 'added' WHEN i.pk IS NULL THEN 'kept' ELSE '{ {"merge": "merged", "replace": "replaced", "skip": "skipped"}[_mode]}' END AS outcome
      FROM (SELECT *, {KEY} AS pk FROM {EX}) e FULL JOIN (SELECT *, {KEY} AS pk FROM {INCO}) i ON e.pk = i.pk""")
    def _(t, m=_mode):
        return I.commit_import(_existing(t), _incoming(t), m)

SFS = """SELECT project_id, CASE WHEN project_id % 3 <> 0 THEN square_feet END AS mech_sf, CASE WHEN project_id % 4 = 0 THEN square_feet WHEN project_id % 4 = 1 THEN square_feet + 10 END AS elec_sf, square_feet AS project_sf FROM @projects"""


@query("i21_reconcile_sf", f"""SELECT project_id, coalesce(mech_sf > 0 AND elec_sf > 0 AND mech_sf <> elec_sf, false) AS sf_review,
  CASE WHEN sf_review THEN NULL ELSE coalesce(mech_sf, elec_sf, project_sf) END AS square_feet FROM ({SFS})""")
def _(t):
    p, s = C("project_id"), C("square_feet")
    d = t.projects.select("project_id", F.when(p % 3 != 0, s).alias("mech_sf"), F.when(p % 4 == 0, s).when(p % 4 == 1, s + 10).alias("elec_sf"), s.alias("project_sf"))
    return I.reconcile_sf(d).select("project_id", "sf_review", "square_feet")


@query("i22_recovery", f"""SELECT count(*) FILTER (e.square_feet IS NULL AND i.square_feet IS NOT NULL) AS recovered_sf, count(*) FILTER (NOT {MEAN('e.consultant')} AND {MEAN('i.consultant')}) AS recovered_consultant
  FROM {EX} e JOIN {INCO} i ON lower(trim(e.project_number)) = lower(trim(i.project_number))""")
def _(t):
    return I.recovery(_existing(t), _incoming(t))


@query("i23_duplicate_keys", f"SELECT {KEY} AS pkey, count(*) AS records, min(seq) AS first_seq FROM @projects GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return I.duplicate_keys(t.projects)


@query("i26_clear_discipline", f"{WF} SELECT project_id, CAST(NULL AS DOUBLE) AS tonnage, panel_count FROM facts WHERE has_elec")
def _(t):
    return I.clear_discipline(facts(t), "Mechanical")


@query("i27_preview_summary", f"""SELECT count(*) AS incoming, count(*) FILTER (NOT dup AND NOT warn) AS ready, count(*) FILTER (warn) AS with_warnings, count(*) FILTER (dup) AS duplicates, count(*) FILTER (excluded) AS excluded
  FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}) > 1 OR {KEY} IN (SELECT {KEY} FROM {EX}) AS dup, square_feet IS NULL OR NOT {MEAN('consultant')} AS warn FROM {INCO})""")
def _(t):
    return I.preview_summary(_existing(t), _incoming(t))


@query("i12_unique_headers", """SELECT workbook, sheet, pos, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END AS header FROM (SELECT l_orderkey AS workbook, 'S' AS sheet, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS pos, p_type AS name,
  row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey) AS n FROM @lineitem JOIN @part ON l_partkey = p_partkey)""")
def _(t):
    u = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).select(
        C("l_orderkey").alias("workbook"), F.lit("S").alias("sheet"), (C("l_linenumber").cast("bigint") * 10000000000 + C("l_partkey") * 10000 + C("l_suppkey")).alias("pos"), C("p_type").alias("name"))
    return I.unique_headers(u).select("workbook", "sheet", "pos", "header")


# one sheet per 200 orders: the first line of an order carries its number, some sheets end orders with a total
CELLS = """(SELECT 'W' || CAST(floor(project_id / 200) AS BIGINT) AS workbook, 'Mech' AS sheet, project_id * 100000000000 + seq AS row,
  CASE WHEN seq % 3 = 0 THEN CAST(project_id AS VARCHAR(20)) ELSE '' END AS number, CASE WHEN seq % 7 = 0 THEN 'Total tons' ELSE manufacturer END AS label, tonnage AS value FROM @units)"""
BLK = f"""SELECT *, sum(CASE WHEN project IS NOT NULL AND project IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY workbook, sheet ORDER BY row) AS block FROM (
  SELECT *, lag(project) OVER (PARTITION BY workbook, sheet ORDER BY row) AS prev FROM (
   SELECT *, last_value(nullif(number, '') IGNORE NULLS) OVER (PARTITION BY workbook, sheet ORDER BY row) AS project FROM {CELLS}))"""


def _cells(t):
    s, p = C("seq"), C("project_id")
    return t.units.select(F.concat(F.lit("W"), F.floor(p / 200).cast("string")).alias("workbook"), F.lit("Mech").alias("sheet"), (p * 100000000000 + s).alias("row"),
                          F.when(s % 3 == 0, p.cast("string")).otherwise("").alias("number"), F.when(s % 7 == 0, "Total tons").otherwise(C("manufacturer")).alias("label"), C("tonnage").alias("value"))


@query("i13_split_blocks", f"SELECT workbook, row, project, CAST(block AS BIGINT) AS block FROM ({BLK})")
def _(t):
    return I.split_blocks(_cells(t)).select("workbook", "row", "project", C("block").cast("bigint").alias("block"))


@query("i13_block_totals", f"""SELECT workbook, sheet, CAST(block AS BIGINT) AS block, max(project) AS project, count(*) AS rows, count(*) FILTER (label = 'Total tons') AS total_rows,
  sum(value) FILTER (label <> 'Total tons') AS listed, first(value ORDER BY row) FILTER (label = 'Total tons') AS stated FROM ({BLK}) GROUP BY 1, 2, 3""")
def _(t):
    return I.block_totals(I.split_blocks(_cells(t))).withColumn("block", C("block").cast("bigint"))


# as CELLS; every fifth sheet has no valid number and is read by its names, some numbers stand in unmapped cells, rows with a quantity have data
LOOSE = """SELECT 'W' || CAST(floor(project_id / 200) AS BIGINT) AS workbook, 'Mech' AS sheet, project_id * 100000000000 + seq AS row,
  CASE WHEN seq % 3 = 0 AND CAST(floor(project_id / 200) AS BIGINT) % 5 <> 3 THEN CAST(project_id AS VARCHAR(20)) END AS number,
  CASE WHEN seq % 3 = 0 AND project_id % 4 <> 0 THEN CAST(project_id AS VARCHAR(20)) ELSE '' END AS mapped_number, CASE WHEN seq % 11 = 0 AND project_id % 4 <> 0 THEN 'Name ' || project_id END AS mapped_name,
  seq % 2 = 0 AS is_total, tonnage IS NOT NULL AS has_data FROM @units"""


@query("i13_project_blocks", f"""WITH RECURSIVE x AS (SELECT *, coalesce(number, CASE WHEN NOT bool_or(number IS NOT NULL) OVER (PARTITION BY workbook, sheet) THEN coalesce(nullif(mapped_number, ''), mapped_name) END) AS id FROM ({LOOSE})),
  y AS (SELECT *, last_value(id IGNORE NULLS) OVER w AS project, row_number() OVER w AS n FROM x WINDOW w AS (PARTITION BY workbook, sheet ORDER BY row)),
  z AS (SELECT *, coalesce(id IS NOT NULL AND id IS DISTINCT FROM lag(project) OVER w, false) AS begins, coalesce(lag(is_total, 2) OVER w AND coalesce(lag(mapped_number) OVER w, '') = '' AND lag(mapped_name) OVER w IS NULL AND lag(has_data) OVER w, false) AS loose,
      lag(project) OVER w IS NOT NULL AS any_block FROM y WINDOW w AS (PARTITION BY workbook, sheet ORDER BY row)),
  s AS (SELECT workbook, sheet, n, project, begins, false AS takes FROM z WHERE n = 1 UNION ALL
        SELECT z.workbook, z.sheet, z.n, z.project, z.begins, z.begins AND z.any_block AND z.loose AND (NOT s.begins OR s.takes) AND (s.project IS NOT NULL) FROM s JOIN z ON z.workbook = s.workbook AND z.sheet = s.sheet AND z.n = s.n + 1),
  t AS (SELECT z.workbook, z.sheet, z.row, z.project, sum(z.begins::INT) OVER w AS block, coalesce(lead(s.takes) OVER w, false) AS carried, lead(z.project) OVER w AS later FROM z JOIN s USING (workbook, sheet, n) WINDOW w AS (PARTITION BY z.workbook, z.sheet ORDER BY z.row))
  SELECT workbook, sheet, row, CASE WHEN carried THEN later ELSE project END AS project, CAST(block + carried::INT AS BIGINT) AS block, carried, block = 0 AS orphan FROM t""")
def _(t):
    f, p, s = F.floor(C("project_id") / 200), C("project_id"), C("seq")
    own = (s % 3 == 0)
    rows = t.units.select(F.concat(F.lit("W"), f.cast("string")).alias("workbook"), F.lit("Mech").alias("sheet"), (p * 100000000000 + s).alias("row"), F.when(own & (f % 5 != 3), p.cast("string")).alias("number"),
                          F.when(own & (p % 4 != 0), p.cast("string")).otherwise("").alias("mapped_number"), F.when((s % 11 == 0) & (p % 4 != 0), F.concat(F.lit("Name "), p.cast("string"))).alias("mapped_name"),
                          (s % 2 == 0).alias("is_total"), C("tonnage").isNotNull().alias("has_data"))
    return I.project_blocks(rows).select("workbook", "sheet", "row", "project", "block", "carried", "orphan")


# every third user has a number that it shares with its neighbours, some messages have no words
NUMBERED = """SELECT seq, project_id, CASE WHEN project_id % 3 <> 1 THEN 'N-' || CAST(floor(project_id / 4) AS BIGINT) ELSE '' END AS project_number, discipline, category,
  CASE WHEN seq % 17 = 0 THEN '?' || (seq % 5) WHEN seq % 5 = 1 THEN 'panel ' || severity || ' missing at level ' || chr(CAST(97 + seq % 13 AS INT)) || 'xx' ELSE message END AS message FROM @issue_log"""
ALIKE = lambda x, y: f"""{x}.discipline = {y}.discipline AND ({x}.project_id = {y}.project_id OR ({x}.project_number <> '' AND {x}.project_number = {y}.project_number))
    AND (({x}.category = {y}.category AND lower({x}.message) = lower({y}.message)) OR (len({x}.tk) > 0 AND len(list_intersect({x}.tk, {y}.tk)) / greatest(len({x}.tk), len({y}.tk)) >= 0.65))"""


def _numbered(t):
    p, s = C("project_id"), C("seq")
    odd = F.concat(F.lit("panel "), "severity", F.lit(" missing at level "), F.chr(97 + s % 13), F.lit("xx"))
    return t.issue_log.select("seq", "project_id", F.when(p % 3 != 1, F.concat(F.lit("N-"), F.floor(p / 4).cast("string"))).otherwise("").alias("project_number"), "discipline", "category",
                              F.when(s % 17 == 0, F.concat(F.lit("?"), (s % 5).cast("string"))).when(s % 5 == 1, odd).otherwise(C("message")).alias("message"))


@query("i4_duplicate_issues", f"""WITH m AS MATERIALIZED (SELECT *, {TOKS} AS tk FROM ({NUMBERED})), a AS (SELECT * FROM m WHERE seq % 2 = 0), b AS (SELECT * FROM m WHERE seq % 2 = 1)
  SELECT b.seq AS incoming_seq, min(a.seq) AS existing_seq FROM b JOIN a ON {ALIKE('a', 'b')} GROUP BY 1""")
def _(t):
    from recordqc.operators.imports import stored_duplicates
    m = _numbered(t)
    return stored_duplicates(m.where("seq % 2 = 0"), m.where("seq % 2 = 1"))


@query("i5_import_issues", f"""WITH RECURSIVE m AS MATERIALIZED (SELECT *, {TOKS} AS tk FROM ({NUMBERED})), a AS (SELECT * FROM m WHERE seq % 4 = 0 AND seq % 3 = 0), b AS (SELECT * FROM m WHERE NOT (seq % 4 = 0 AND seq % 3 = 0)),
  ext AS MATERIALIZED (SELECT b.seq, min(a.seq) AS old FROM b JOIN a ON {ALIKE('a', 'b')} GROUP BY b.seq),
  free AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM b ANTI JOIN ext USING (seq)),
  e AS MATERIALIZED (SELECT x.n, any_value(x.seq) AS seq, coalesce(list(y.seq ORDER BY y.seq) FILTER (y.seq IS NOT NULL), []) AS earlier FROM free x LEFT JOIN free y ON y.seq < x.seq AND {ALIKE('x', 'y')} GROUP BY x.n),
  s AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT e.n, CASE WHEN len(list_intersect(kept, earlier)) = 0 THEN list_append(kept, seq) ELSE kept END FROM s JOIN e ON e.n = s.n + 1),
  k AS (SELECT kept FROM s ORDER BY n DESC LIMIT 1), d AS (SELECT seq, list_min(list_intersect(earlier, kept)) AS new FROM e, k)
  SELECT b.seq, CASE WHEN old IS NOT NULL OR new IS NOT NULL THEN 'skip' ELSE 'import' END AS action, CASE WHEN old IS NOT NULL THEN 'stored' WHEN new IS NOT NULL THEN 'imported' END AS duplicate_side,
    coalesce(old, new) AS duplicate_seq FROM b LEFT JOIN ext USING (seq) LEFT JOIN d USING (seq)""")
def _(t):
    from recordqc.operators.imports import import_issues
    m, s = _numbered(t), C("seq")
    stored = (s % 4 == 0) & (s % 3 == 0)
    return import_issues(m.where(stored), m.where(~stored))
