"""Registered queries of project-precedent analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.operators import precedents as P
from recordqc.plans.registry import query
from recordqc.session import written

C = F.col
CLEAN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
_W = "string_split(nm, ' ')"
DISPLAY = f"""CASE WHEN nm = '' OR lower(nm) = 'unknown' THEN 'Unknown'
  WHEN nm <> upper(nm) AND nm <> lower(nm) AND NOT (len({_W}) > 1 AND regexp_matches({_W}[1], '^[A-Z&]{{2,5}}$') AND len(list_filter({_W}[2:], lambda w: w <> lower(w))) = 0) THEN nm
  ELSE array_to_string(list_transform({_W}, lambda w: CASE WHEN upper(w) IN ('MEP','DBR','A&G','LLC','PLLC','M&E') THEN upper(w)
    WHEN regexp_matches(w, '^[A-Z0-9&]{{2,4}}$') AND NOT regexp_matches(w, '^[A-Z]{{2,4}}$') THEN upper(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ' ') END"""
MEAN = lambda c: f"({c} IS NOT NULL AND trim({c}) NOT IN ('', 'Unknown'))"
CANON = f"""SELECT *, first_value(display) OVER (PARTITION BY ckey ORDER BY seq) AS canonical FROM (
  SELECT *, lower({CLEAN('display')}) AS ckey FROM (SELECT *, {DISPLAY} AS display FROM (SELECT *, {CLEAN('consultant')} AS nm FROM @projects)))"""
FACTS = f"""SELECT p.*, coalesce(unit_rows, 0) AS unit_rows, unit_count, calc_tons, duct_feet, coalesce(has_manufacturer, false) AS has_manufacturer,
    coalesce(has_model, false) AS has_model, coalesce(has_type, false) AS has_type, coalesce(custom_units, 0) AS custom_units, stated, coalesce(stated, calc_tons) AS chosen,
    CASE WHEN stated IS NOT NULL AND calc_tons IS NOT NULL AND n_stated = 1 AND abs(stated - calc_tons) <= 0.1 THEN 'Verified'
      WHEN stated IS NOT NULL AND calc_tons IS NOT NULL THEN 'Needs review' WHEN stated IS NOT NULL THEN 'Stated total' WHEN calc_tons IS NOT NULL THEN 'Calculated'
      WHEN u.project_id IS NOT NULL THEN 'Unknown' END AS verification,
    coalesce(stated IS NOT NULL AND calc_tons IS NOT NULL AND NOT (n_stated = 1 AND abs(stated - calc_tons) <= 0.1), false) AS conflict,
    CASE WHEN conflict THEN NULL ELSE chosen END AS tonnage, coalesce(unit_rows, 0) > 0 OR chosen IS NOT NULL AS has_mech, coalesce(panel_rows, 0) AS panel_rows,
    panel_count, coalesce(panel_rows, 0) > 0 AS has_elec
  FROM ({CANON}) p
  LEFT JOIN (SELECT project_id, count(*) AS unit_rows, CAST(sum(greatest(1, quantity)) AS BIGINT) AS unit_count, sum(tonnage * greatest(1, quantity)) AS calc_tons,
      sum(duct_feet * greatest(1, quantity)) AS duct_feet, bool_or({MEAN('manufacturer')}) AS has_manufacturer, bool_or({MEAN('model')}) AS has_model,
      bool_or({MEAN('type')}) AS has_type, count(*) FILTER (classification = 'custom') AS custom_units FROM @units GROUP BY 1) u USING (project_id)
  LEFT JOIN (SELECT project_id, arg_min(stated, seq) AS stated, count(DISTINCT stated) AS n_stated FROM @stated_totals WHERE stated IS NOT NULL GROUP BY 1) s USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS panel_rows, CAST(sum(greatest(1, quantity)) AS BIGINT) AS panel_count FROM @panels GROUP BY 1) e USING (project_id)"""
WF = f"WITH facts AS MATERIALIZED ({FACTS}) "
SCOPED = """(SELECT f.*, s.scope FROM facts f JOIN (VALUES ('Mechanical'), ('Electrical'), ('Mechanical + Electrical')) s(scope)
  ON (s.scope <> 'Electrical' AND has_mech) OR (s.scope <> 'Mechanical' AND has_elec) WHERE NOT excluded)"""


def facts(t):
    return P.project_facts(t.projects, t.units, t.panels, t.stated_totals)


@query("p1_canonicalize", f"SELECT project_id, ckey, canonical FROM ({CANON})")
def _(t):
    return P.canonicalize(t.projects).select("project_id", "ckey", "canonical")


EFF = ["project_id", "canonical", "square_feet", "unit_rows", "unit_count", "tonnage", "duct_feet", "panel_count", "has_mech", "has_elec"]


@query("p2_effective_values", f"{WF} SELECT {', '.join(EFF)} FROM facts")
def _(t):
    return facts(t).select(*EFF)


@query("p3_safe_totals", f"""{WF} SELECT project_id, CASE WHEN chosen IS NULL OR abs(chosen - square_feet) <= 0.001 OR (calc_tons > 0 AND chosen > calc_tons * 20)
  THEN coalesce(calc_tons, stated) ELSE chosen END AS safe_tonnage FROM facts""")
def _(t):
    return P.safe_totals(facts(t)).select("project_id", "safe_tonnage")


for _scope, _cond in (("Mechanical", "has_mech"), ("Electrical", "has_elec"), ("Mechanical + Electrical", "(has_mech OR has_elec)")):
    @query("p4_eligible_" + {"Mechanical": "mechanical", "Electrical": "electrical"}.get(_scope, "both"),
           f"{WF} SELECT project_id, building_type FROM facts WHERE {_cond} AND NOT excluded AND NOT review_required")
    def _(t, s=_scope):
        return P.eligible(facts(t), s).select("project_id", "building_type")

RANKED = f"""ranked AS (SELECT * FROM (SELECT request_id, project_id, score, reasons, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, delta, project_name, project_id) AS rank FROM (
  SELECT *, floor((CASE WHEN same_t THEN 50 ELSE 0 END + CASE WHEN same_c THEN 30 ELSE 0 END
      + CASE WHEN sf > 0 THEN greatest(0.0, 30 * (1 - least(delta / want, 1.0))) ELSE 0 END + CASE WHEN plus THEN 5 ELSE 0 END) * 10 + 0.5) / 10 AS score,
    concat_ws('; ', CASE WHEN same_t THEN 'same building type' END, CASE WHEN same_c THEN 'same consultant' END,
      CASE WHEN sf > 0 THEN CASE WHEN delta / want <= 0.15 THEN 'very similar square footage' WHEN delta / want <= 0.35 THEN 'similar square footage' ELSE 'closest available size' END END) AS reasons
  FROM (SELECT r.request_id, f.project_id, f.project_name, abs(coalesce(f.square_feet, 0) - r.square_feet) AS delta, f.square_feet AS sf, r.square_feet AS want,
    r.scope = 'Mechanical + Electrical' AND f.has_mech AND f.has_elec AS plus,
    lower({CLEAN('f.building_type')}) = lower({CLEAN('r.building_type')}) AS same_t, r.consultant <> '' AND f.ckey = lower({CLEAN('r.consultant')}) AS same_c
  FROM @requests r JOIN {SCOPED} f ON f.scope = r.scope AND NOT f.review_required))) WHERE rank <= 5)"""


@query("p5_rank_similar", f"{WF}, {RANKED} SELECT * FROM ranked")
def _(t):
    return P.rank_similar(t.requests, facts(t))


STAGE = f"""stage AS (SELECT * FROM (SELECT *, min(level) OVER (PARTITION BY request_id) AS best FROM (
    SELECT r.request_id, r.scope, r.square_feet AS sf, l.level, f.* EXCLUDE (scope) FROM @requests r JOIN {SCOPED} f ON f.scope = r.scope
      JOIN (VALUES (0), (1), (2), (3)) l(level) ON (level IN (2, 3) OR f.building_type = r.building_type) AND (level IN (1, 3) OR (r.consultant <> '' AND f.ckey = lower({CLEAN('r.consultant')}))))) WHERE level = best)"""


@query("p6_comparable_set", f"{WF}, {STAGE} SELECT request_id, level, count(*) AS projects FROM stage GROUP BY 1, 2")
def _(t):
    return P.comparable_set(t.requests, written(facts(t), "facts")).select("request_id", "level", "projects")


def _q(m, p):
    return f"quantile_cont({m}, {p})"


def _rng(m, side):
    return f"CASE WHEN count({m}) >= 4 THEN {_q(m, .75 if side == 'hi' else .25)} ELSE {'max' if side == 'hi' else 'min'}({m}) END"


@query("p7_estimate", f"""{WF}, {STAGE}, v AS (SELECT *, CASE WHEN square_feet > 0 AND tonnage > 0 THEN square_feet / tonnage END AS r1, CASE WHEN square_feet > 0 THEN duct_feet / square_feet END AS r2,
    CASE WHEN square_feet > 0 AND unit_rows > 0 THEN square_feet / unit_rows END AS r3, CASE WHEN square_feet > 0 AND panel_count > 0 THEN square_feet / panel_count END AS r4 FROM stage),
  a AS (SELECT request_id, scope, sf, level, count(*) AS projects, count(r1) AS n1, count(r4) AS n4, {_q('r1', .5)} AS m1, {_q('r2', .5)} AS m2, {_q('r3', .5)} AS m3, {_q('r4', .5)} AS m4,
    {_rng('r1', 'hi')} AS h1, {_rng('r1', 'lo')} AS l1, {_rng('r4', 'hi')} AS h4, {_rng('r4', 'lo')} AS l4 FROM v GROUP BY ALL)
  SELECT request_id, CAST(level AS BIGINT) AS level, projects, floor(sf / m1 * 2 + 0.5) / 2 AS tonnage, floor(sf / h1 * 2 + 0.5) / 2 AS tonnage_low, floor(sf / l1 * 2 + 0.5) / 2 AS tonnage_high,
    CAST(floor(sf * m2 / 10 + 0.5) * 10 AS BIGINT) AS duct_feet, CASE WHEN m3 IS NOT NULL THEN CAST(greatest(1, floor(sf / m3 + 0.5)) AS BIGINT) END AS units,
    CASE WHEN m4 IS NOT NULL THEN CAST(greatest(1, floor(sf / m4 + 0.5)) AS BIGINT) END AS panels, CASE WHEN m4 IS NOT NULL THEN CAST(greatest(1, floor(sf / h4 + 0.5)) AS BIGINT) END AS panels_low,
    CASE WHEN m4 IS NOT NULL THEN CAST(greatest(1, floor(sf / l4 + 0.5)) AS BIGINT) END AS panels_high,
    CASE scope WHEN 'Mechanical' THEN n1 WHEN 'Electrical' THEN n4 ELSE least(n1, n4) END AS sample,
    CASE WHEN sample >= 8 AND level <= 1 THEN 'High' WHEN sample >= 3 AND level <= 2 THEN 'Moderate' ELSE 'Low' END AS confidence FROM a""")
def _(t):
    return P.estimate(t.requests, written(facts(t), "facts"))


TOP = lambda col, name: f"""(SELECT ckey, string_agg(v, ', ' ORDER BY rn) AS {name} FROM (SELECT ckey, {col} AS v, row_number() OVER (PARTITION BY ckey ORDER BY count(*) DESC, {col}) AS rn
   FROM @units JOIN facts USING (project_id) WHERE {MEAN(col)} GROUP BY ckey, {col}) WHERE rn <= 3 GROUP BY ckey)"""
_MISS = "(CASE WHEN square_feet IS NULL THEN 1 ELSE 0 END + CASE WHEN tonnage IS NULL THEN 1 ELSE 0 END + CASE WHEN panel_count IS NULL THEN 1 ELSE 0 END)"


@query("p9_consultant_stats", f"""{WF} SELECT * FROM (SELECT ckey, any_value(canonical) AS consultant, count(*) AS projects, sum(square_feet) AS total_sf, min(square_feet) AS min_sf, max(square_feet) AS max_sf,
    avg(unit_rows) FILTER (has_mech) AS mean_units, avg(panel_count) AS mean_panels, CAST(sum(custom_units) AS BIGINT) AS custom_units, sum({_MISS}) * 100.0 / (count(*) * 6) AS missing_percent,
    median(square_feet) AS median_sf, median(tonnage) AS median_ton, median(CASE WHEN square_feet > 0 AND tonnage > 0 THEN square_feet / tonnage END) AS median_ratio FROM facts GROUP BY ckey)
  LEFT JOIN {TOP('type', 'systems')} USING (ckey) LEFT JOIN {TOP('manufacturer', 'manufacturers')} USING (ckey)""")
def _(t):
    return P.consultant_stats(written(facts(t), "facts"), t.units)


@query("p10_electrical_stats", f"""{WF}, pn AS (SELECT p.*, ckey FROM @panels p JOIN facts USING (project_id) WHERE NOT excluded)
  SELECT * FROM (SELECT ckey, min(amps) AS min_amps, max(amps) AS max_amps, min(disconnect_amps) AS min_disconnect, max(disconnect_amps) AS max_disconnect,
    count(*) FILTER (amps IS NULL AND load_kva IS NULL) AS unusable, median(load_kva) AS median_kva FROM pn GROUP BY 1)
  LEFT JOIN (SELECT ckey, avg(panel_count) AS mean_panels, median(CAST(panel_count AS DOUBLE)) AS median_panels FROM facts WHERE NOT excluded AND panel_count > 0 GROUP BY 1) USING (ckey)
  LEFT JOIN (SELECT ckey, string_agg(disconnect_name, ', ' ORDER BY rn) AS disconnects FROM (SELECT ckey, disconnect_name, row_number() OVER (PARTITION BY ckey ORDER BY min(struct_pack(p := project_id, s := seq))) AS rn
     FROM pn WHERE disconnect_name <> '' GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1) USING (ckey)""")
def _(t):
    return P.electrical_stats(written(facts(t), "facts"), t.panels)


@query("p11_consultant_summary", f"""{WF} SELECT CASE WHEN {MEAN('consultant')} THEN trim(consultant) ELSE 'Unknown' END AS raw, count(*) AS projects, avg(square_feet) AS mean_sf, avg(tonnage) AS mean_tons,
  string_agg(DISTINCT building_type, ', ' ORDER BY building_type) AS building_types, median(square_feet) AS median_sf FROM facts WHERE NOT excluded GROUP BY 1""")
def _(t):
    return P.consultant_summary(written(facts(t), "facts"))


@query("p12_similar_consultants", f"""{WF}, {RANKED} SELECT * FROM (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY count(*) DESC, min(canonical)) AS rank, min(canonical) AS consultant,
  count(*) AS projects FROM ranked JOIN facts USING (project_id) WHERE canonical <> 'Unknown' GROUP BY request_id, ckey) WHERE rank <= 3""")
def _(t):
    f = written(facts(t).select("project_id", "project_name", "square_feet", "building_type", "ckey", "canonical", "excluded", "review_required", "has_mech", "has_elec"), "facts")
    return P.similar_consultants(P.rank_similar(t.requests, f), f)


@query("p13_portfolio", f"""{WF} SELECT count(*) AS projects, sum(square_feet) AS total_sf, count(DISTINCT ckey) FILTER (canonical <> 'Unknown') AS consultants,
  median(CASE WHEN square_feet > 0 AND tonnage > 0 THEN square_feet / tonnage END) AS median_sf_ton FROM facts""")
def _(t):
    return P.portfolio(written(facts(t), "facts"))


@query("p13_latest_projects", f"SELECT project_id, project_number, project_name FROM @projects ORDER BY seq DESC LIMIT 5")
def _(t):
    return P.latest_projects(t.projects)


@query("p14_attention", f"""{WF} SELECT count(*) FILTER (review_required) AS needs_review, count(*) FILTER (canonical = 'Unknown') AS missing_consultant, count(*) FILTER (square_feet IS NULL) AS missing_sf,
  count(*) FILTER (NOT has_elec) AS missing_electrical, count(*) FILTER (NOT excluded AND NOT review_required AND (has_mech OR has_elec)) AS usable FROM facts""")
def _(t):
    return P.attention(facts(t))


@query("p15_filter_projects", f"""{WF} SELECT project_id, canonical FROM facts WHERE contains(lower(concat_ws(' ', project_number, project_name, building_type, canonical)), 'delta')
  AND custom_units > 0 AND project_id IN (SELECT project_id FROM @units WHERE type = 'ECONOMY')""")
def _(t):
    return P.filter_projects(facts(t), t.units, text="delta", unit_type="ECONOMY", custom_only=True).select("project_id", "canonical")


@query("p16_project_warnings", f"""{WF} SELECT project_id, array_to_string(w, '; ') AS warnings, CAST(len(w) AS BIGINT) AS n FROM (SELECT project_id, list_filter([CASE WHEN square_feet IS NULL THEN 'Missing overall square footage.' END,
  CASE WHEN canonical = 'Unknown' THEN 'Missing consultant.' END, CASE WHEN has_mech AND tonnage IS NULL THEN 'Missing total tonnage.' END, CASE WHEN NOT has_elec THEN 'Missing electrical data.' END,
  CASE WHEN note <> '' THEN note END], lambda x: x IS NOT NULL) AS w FROM facts) WHERE len(w) > 0""")
def _(t):
    return P.project_warnings(facts(t))


@query("p17_distinct_values", f"{WF} SELECT DISTINCT canonical FROM facts WHERE canonical <> 'Unknown'")
def _(t):
    return P.distinct_values(P.canonicalize(t.projects), "canonical")


AV = f"""av AS (SELECT f.*, coalesce(related, 0) AS related, coalesce(open_issues, 0) AS open_issues, coalesce(tonnage > 0, false) AS tn, coalesce(square_feet > 0, false) AS s, coalesce(duct_feet > 0, false) AS du,
    tn OR unit_rows > 0 OR has_type OR du OR panel_rows > 0 AS useful FROM facts f
  LEFT JOIN (SELECT project_id, count(*) AS related, count(*) FILTER (status <> 'Resolved') AS open_issues FROM @issue_log GROUP BY 1) USING (project_id)),
  mat AS (SELECT project_id, 'tonnage-history' AS use, tn AS available, 'approved HVAC tonnage is not recorded' AS why FROM av
    UNION ALL SELECT project_id, 'unit-history', unit_rows > 0, 'equipment rows or a confirmed unit count are not recorded' FROM av
    UNION ALL SELECT project_id, 'equipment-types', has_type, 'equipment types are not recorded' FROM av
    UNION ALL SELECT project_id, 'duct-analysis', du, 'duct linear feet are not recorded' FROM av
    UNION ALL SELECT project_id, 'sf-per-ton', s AND tn, CASE WHEN s THEN 'approved HVAC tonnage is not recorded' ELSE 'square footage is not recorded' END FROM av
    UNION ALL SELECT project_id, 'consultant-comparison', canonical <> 'Unknown', 'consultant is not recorded' FROM av
    UNION ALL SELECT project_id, 'similar-projects', useful, 'more project size, type, or MEP information is needed' FROM av
    UNION ALL SELECT project_id, 'electrical-panels', panel_rows > 0, 'electrical panel information is not recorded' FROM av)"""


@query("p18_availability", f"""{WF}, {AV} SELECT project_id, CASE WHEN excluded THEN 'Excluded' WHEN NOT useful OR review_required THEN 'Review Needed' WHEN related > 0 AND open_issues = 0 THEN 'Complete History'
  WHEN open_issues > 0 OR project_id IN (SELECT project_id FROM mat WHERE NOT available) THEN 'Limited Data' ELSE 'Ready' END AS data_status FROM av""")
def _(t):
    return P.availability(facts(t), t.issue_log).select("project_id", "data_status")


@query("p18_availability_matrix", f"{WF}, {AV} SELECT project_id, use, available, CASE WHEN available THEN '' ELSE why END AS reason FROM mat")
def _(t):
    return P.availability_matrix(P.availability(facts(t), t.issue_log))


@query("p19_electrical_project_summary", """SELECT project_id, CAST(sum(greatest(1, quantity)) AS BIGINT) AS panels, min(amps) AS min_amps, max(amps) AS max_amps, count(*) FILTER (disconnect_name <> '') AS disconnects,
  min(disconnect_amps) FILTER (disconnect_name <> '') AS min_disconnect, max(disconnect_amps) FILTER (disconnect_name <> '') AS max_disconnect FROM @panels GROUP BY 1""")
def _(t):
    return P.electrical_project_summary(t.panels)


@query("p20_totals_badge", f"{WF} SELECT project_id, CASE WHEN excluded THEN 'Excluded' ELSE coalesce(verification, 'Unknown') END AS badge FROM facts")
def _(t):
    return P.totals_badge(facts(t))


FIRSTS = lambda c: f"(SELECT project_id, string_agg(v, '; ' ORDER BY a) AS {c}s FROM (SELECT project_id, {c} AS v, min(seq) AS a FROM @units WHERE {MEAN(c)} GROUP BY 1, 2) GROUP BY 1)"


@query("a4_projects_export", f"""{WF} SELECT project_number, project_name, building_type, canonical AS consultant, square_feet, tonnage, duct_feet, unit_count, panel_count,
  coalesce(types, '') AS unit_types, coalesce(manufacturers, '') AS manufacturers, note AS quality FROM facts LEFT JOIN {FIRSTS('type')} USING (project_id) LEFT JOIN {FIRSTS('manufacturer')} USING (project_id)""")
def _(t):
    return P.projects_export(facts(t), t.units)


@query("i17_choose_metric", f"""{WF} SELECT project_id, chosen, verification, conflict FROM facts WHERE calc_tons IS NOT NULL OR stated IS NOT NULL""")
def _(t):
    return P.choose_metric(P.unit_sums(t.units), t.stated_totals).where("calculated is not null or stated is not null").select("project_id", "chosen", "verification", "conflict")


@query("x23_enrich_projects", f"""SELECT project_id, display, lower({CLEAN('display')}) AS ckey, tens, halves FROM (SELECT *, {DISPLAY} AS display, floor(square_feet / 10 + 0.5) * 10 AS tens,
  floor(square_feet / 300 * 2 + 0.5) / 2 AS halves FROM (SELECT *, {CLEAN('consultant')} AS nm FROM @projects))""")
def _(t):
    from recordqc.functions import projects as X
    return t.projects.select("project_id", X.consultant_name(C("consultant")).alias("display"), X.consultant_key(X.consultant_name(C("consultant"))).alias("ckey"),
                             X.round_ten(C("square_feet")).cast("double").alias("tens"), X.round_half(C("square_feet") / 300).cast("double").alias("halves"))


_HEAD = "JOIN facts f USING (project_id)"
_TABLES = {
    "Mechanical Equipment": f"""SELECT project_number, project_name, canonical AS consultant, u.seq AS unit_seq, type, manufacturer, model, CAST(greatest(1, quantity) AS BIGINT) AS quantity, u.tonnage, u.tonnage * greatest(1, quantity) AS total_tonnage,
      u.duct_feet, classification FROM @units u {_HEAD}""",
    "Electrical": f"SELECT project_number, project_name, canonical AS consultant, p.seq AS panel_seq, name AS panel, amps, load_kva, disconnect_name, disconnect_amps FROM @panels p {_HEAD}",
    "Errors": f"SELECT project_number, project_name, discipline, category, severity, status, message FROM @issue_log i {_HEAD}",
    "Notes": "SELECT project_number, project_name, note FROM facts WHERE note <> ''"}
for _name, _sql in _TABLES.items():
    @query("a10_" + _name.lower().replace(" ", "_"), f"{WF} {_sql}")
    def _(t, n=_name):
        return P.export_tables(facts(t), t.units, t.panels, t.issue_log)[n]
