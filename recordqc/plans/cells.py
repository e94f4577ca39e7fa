"""Registered queries on spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.functions import cells as X
from recordqc.operators import cells as K
from recordqc.plans.registry import query

C = F.col
q = lambda s: s.replace("'", "''")
CL = "trim(regexp_replace(cell, '\\s+', ' ', 'g'))"
LAB = f"trim(regexp_replace(lower({CL}), '[^a-z0-9]+', ' ', 'g'))"
UNK = f"regexp_matches({CL}, '{X.UNKNOWN}')"
NUM = f"TRY_CAST(CASE WHEN NOT {UNK} THEN nullif(regexp_extract(replace(cell, ',', ''), '(-?\\d+(?:\\.\\d+)?)', 1), '') END AS DOUBLE)"
SFL = f"regexp_extract_all(cell, '{X.SQUARE_FEET}', 1)"
SF = f"CASE WHEN {UNK} THEN NULL WHEN len({SFL}) > 0 THEN TRY_CAST(replace(list_last({SFL}), ',', '') AS DOUBLE) ELSE {NUM} END"
RT = lambda i: f"CASE WHEN regexp_matches(cell, '{X.RATIO}') THEN TRY_CAST(replace(regexp_extract(cell, '{X.RATIO}', {i}), ',', '') AS DOUBLE) END"
PN = "regexp_replace(upper(trim(cell)), '\\s*-\\s*', '-', 'g')"
PNUM = f"CASE WHEN regexp_matches({PN}, '^\\d{{4}}-\\d{{2,4}}[A-Za-z]?$') THEN {PN} END"
EQ = lambda i: "CASE " + " ".join(f"WHEN regexp_matches({CL}, '{X.tag_pattern(r[0])}') THEN '{r[i]}'" for r in X.EQUIPMENT) + " END"
BT = "CASE " + " ".join(f"WHEN regexp_matches({LAB}, '{rx}') THEN '{k}'" for k, rx in X.BUILDING_TYPES) + " END"
TOT, TAG = f"regexp_matches({LAB}, '{X.TOTALS}')", f"regexp_matches({CL}, '{X.TAG}')"
NAME = (f"({CL} <> '' AND NOT {TOT} AND NOT {TAG} AND NOT regexp_matches({CL}, '{X.RATIO}') AND NOT regexp_matches({CL}, '(?i)^(error|issue|note|unknown|tbd)$') "
        f"AND NOT regexp_matches({CL}, '(?i)^(carrier|trane|lennox|york|daikin|mitsubishi|aaon)$') AND NOT regexp_matches({CL}, '(?i)\\bexisting\\b|\\bserving\\b|\\bvav\\b|no mechanical|no electrical|not sure|fill in info'))")
ENR = f"""SELECT project_id, row, cell, {NUM} AS value, {SF} AS square_feet, {RT(1)} AS ratio_sf, {RT(2)} AS ratio_tons, {RT(3)} AS ratio_duct, {PNUM} AS project_number,
  {EQ(0)} AS equipment_code, {EQ(1)} AS equipment_type, {BT} AS building_type, {TOT} AS is_total, {TAG} AS is_tag, {NAME} AS is_name FROM @cells"""


@query("x19_enrich_cells", ENR)
def _(t):
    return K.enrich_cells(t.cells).drop("workbook")


GAP = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({CL}), '{rx}') THEN '{c}' END" for c, s, rx in X.NOTE_ISSUES) + "], lambda x: x IS NOT NULL)"
BLOCK = "(" + " OR ".join(f"regexp_matches(lower({CL}), '{rx}')" for c, s, rx in X.NOTE_ISSUES if s == "Blocking") + ")"
CNT = f"regexp_extract({CL}, '(?i){X.UNIT_COUNT}', 1)"
SUG = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({CL}, '(?i){rx}') THEN '{n}' END" for n, rx in X.SUGGESTIONS) + f", CASE WHEN {CNT} <> '' THEN 'unitCount=' || {CNT} END], lambda x: x IS NOT NULL)"


@query("i16_cell_roles", f"""SELECT project_id, row, CASE WHEN {UNK} THEN 'unknown' WHEN is_total THEN 'total' WHEN ratio_sf IS NOT NULL THEN 'ratio' WHEN project_number IS NOT NULL THEN 'project' WHEN regexp_matches(cell, '{X.SQUARE_FEET}') THEN 'area'
  WHEN len({GAP}) > 0 THEN 'note' WHEN equipment_code IS NOT NULL THEN 'equipment' WHEN is_name THEN 'name' ELSE 'other' END AS role FROM ({ENR})""")
def _(t):
    return K.cell_roles(t.cells).select("project_id", "row", "role")


@query("x25_interpret_notes", f"""SELECT project_id, row, array_to_string({SUG}, '; ') AS suggestions, array_to_string({GAP}, '; ') AS gaps, CASE WHEN {BLOCK} THEN 'High' WHEN len({SUG}) > 0 THEN 'Moderate' ELSE 'Low' END AS confidence
  FROM @cells WHERE len({SUG}) > 0 OR len({GAP}) > 0""")
def _(t):
    n = K.interpret_notes(t.cells)
    return n.select("project_id", "row", F.array_join("suggestions", "; ").alias("suggestions"), F.array_join(F.transform("gaps", lambda g: g["category"]), "; ").alias("gaps"), "confidence")


@query("i15_phases", """SELECT project_id, row, coalesce(last_value(CAST(nullif(regexp_extract(cell, '(?i)^phase\\s+(\\d+)$', 1), '') AS BIGINT) IGNORE NULLS) OVER (PARTITION BY workbook, project_id ORDER BY row), 0) AS phase FROM @cells""")
def _(t):
    return K.phases(t.cells).select("project_id", "row", "phase")


@query("i14_choose_square_feet", f"""WITH c AS (SELECT project_id, sf, count(*) AS n, min(row) AS first_row FROM (SELECT project_id, row, {SF} AS sf FROM @cells WHERE regexp_matches(cell, '{X.SQUARE_FEET}')) WHERE sf IS NOT NULL GROUP BY 1, 2)
  SELECT project_id, sf AS square_feet, values, values > 1 AS conflict FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS values, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, first_row) AS rk FROM c) WHERE rk = 1""")
def _(t):
    return K.choose_square_feet(t.cells)


_HK = "trim(regexp_replace(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g'))"
_AL = "(VALUES " + ", ".join(f"('{f}', '{a}')" for f, names in X.FIELD_ALIASES.items() for a in names) + ") a(field, alias)"


@query("i11_suggest_mapping", f"""WITH h AS (SELECT name, field, alias, k FROM (SELECT DISTINCT name, {_HK} AS k FROM @headers) d JOIN {_AL}
    ON k = alias OR (length(k) >= 5 AND length(alias) >= 5 AND (contains(k, alias) OR contains(alias, k)))),
  m AS (SELECT workbook, sheet, field, min(struct_pack(r := CASE WHEN k = alias THEN 0 ELSE 1 END, pos := pos, name := name, k := k)) AS x FROM @headers JOIN h USING (name) GROUP BY workbook, sheet, field),
  b AS MATERIALIZED (SELECT workbook, sheet, field, x.name AS name, x.k AS k, x.pos AS pos FROM m),
  l AS (SELECT workbook, sheet, CASE WHEN regexp_matches(min(k), w) THEN u ELSE t END AS field FROM b JOIN (VALUES ('projectTonnage', 'tonnage', 'project|total|combined|grand'), ('projectDuctFeet', 'ductFeet', 'project|total')) p(t, u, w)
    ON field = t OR field = u GROUP BY workbook, sheet, t, u, w HAVING count(*) = 2 AND count(DISTINCT pos) = 1)
  SELECT workbook, sheet, field, name AS header, pos FROM b ANTI JOIN l USING (workbook, sheet, field)""")
def _(t):
    return K.suggest_mapping(t.headers, ["workbook", "sheet"])
