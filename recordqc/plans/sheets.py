"""Registered queries of drawing-set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.functions import sheets as X
from recordqc.operators import sheets as S
from recordqc.plans.registry import query
from recordqc.session import written

C = F.col


def esc(p: str) -> str:
    return p.replace("'", "''")


def m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '(?i){esc(pattern)}')"


NUMBER = lambda c: f"upper(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}.]', '', 'g'))"
PREFIX = "regexp_extract(upper(sheet_number), '^([A-Z]+)', 1)"
DISC = "CASE " + " ".join(f"WHEN {PREFIX} = '{k}' THEN '{v}'" for k, v in X.DISCIPLINES.items()) + " " + \
    " ".join(f"WHEN left({PREFIX}, 1) = '{k}' THEN '{v}'" for k, v in X.DISCIPLINES.items() if len(k) == 1) + " ELSE 'General' END"


@query("x11_enrich_pages", f"""SELECT doc_id, {NUMBER('sheet_number')} AS number, {DISC} AS discipline, CASE WHEN {m('text', X.NON_OFFICIAL)} THEN 'Non-Official' WHEN {m('text', X.OFFICIAL)} THEN 'Official' ELSE 'Unknown' END AS set_marker,
  CASE WHEN seal_present OR {m('text', X.SEAL)} THEN 'Present' WHEN trim(text) <> '' THEN 'Missing' ELSE 'Not Detected' END AS seal_state FROM @sheet_pages""")
def _(t):
    return S.enrich_pages(t.sheet_pages).select("doc_id", "number", "discipline", "set_marker", "seal_state")


KW = " UNION ALL ".join(f"SELECT set_id, page_number, '{n}' AS keyword FROM @sheet_pages WHERE {m('text', p)}" for n, p in X.KEYWORDS)


@query("x16_keyword_pages", KW)
def _(t):
    return S.keyword_pages(t.sheet_pages)


@query("s26_coverage_check", r"""WITH n AS (SELECT set_id, count(*) AS pages, count(*) FILTER (title_block_text <> '') AS tb, count(*) FILTER (regexp_matches(sheet_number, '[A-Za-z0-9.]')) AS sn,
    count(*) FILTER (regexp_matches(text, '\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b')) AS dt,
    count(*) FILTER (seal_present OR regexp_matches(text, '(?i)\b(P\.?E\.?|AIA|REGISTERED|LICENSE|TBAE|TABS|SEAL|SIGNATURE|SIGNED|DIGITAL\s+SIGNATURE|DIGITALLY\s+SIGNED)\b')) AS ss
    FROM @sheet_pages GROUP BY 1)
  SELECT set_id, keyword, pages, hits, hits / pages AS ratio, hits / pages >= CAST(threshold AS DOUBLE) AS ok FROM (
    SELECT set_id, pages, 'title_block' AS keyword, tb AS hits, 0.75 AS threshold FROM n UNION ALL SELECT set_id, pages, 'sheet_number', sn, 0.75 FROM n
    UNION ALL SELECT set_id, pages, 'issue_date', dt, 0.60 FROM n UNION ALL SELECT set_id, pages, 'seal_signature', ss, 0.60 FROM n)""")
def _(t):
    return S.coverage_check(t.sheet_pages).drop("threshold")


IDX = f"(SELECT *, {NUMBER('sheet_number')} AS number FROM @sheet_index)"
PHY = f"(SELECT *, {NUMBER('sheet_number')} AS number FROM @physical_sheets)"
PRES = f"""SELECT set_id, 'missing' AS kind, number, index_position AS position FROM {IDX} i WHERE NOT EXISTS (SELECT 1 FROM {PHY} p WHERE p.set_id = i.set_id AND p.number = i.number)
  UNION ALL SELECT set_id, 'extra', number, page_number FROM {PHY} p WHERE number <> '' AND NOT EXISTS (SELECT 1 FROM {IDX} i WHERE p.set_id = i.set_id AND p.number = i.number)
  UNION ALL SELECT set_id, 'duplicate', number, page_number FROM (SELECT *, row_number() OVER (PARTITION BY set_id, number ORDER BY page_number) AS rn FROM {PHY} WHERE number <> '') WHERE rn > 1
  UNION ALL SELECT set_id, 'unnumbered', number, page_number FROM {PHY} WHERE number = ''"""


@query("s2_compare_presence", PRES)
def _(t):
    return S.compare_presence(t.sheet_index, t.physical_sheets)


@query("s2_presence_status", f"""SELECT set_id, count(kind) AS findings, CASE WHEN count(kind) = 0 THEN 'Pass' ELSE 'Fail' END AS status
  FROM (SELECT set_id FROM @sheet_index UNION SELECT set_id FROM @physical_sheets) LEFT JOIN ({PRES}) USING (set_id) GROUP BY 1""")
def _(t):
    return S.presence_status(t.sheet_index, t.physical_sheets)


SEQ = f"""SELECT set_id, number, index_position, page_number FROM (SELECT *, max(index_position) OVER (PARTITION BY set_id ORDER BY page_number, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (
  SELECT p.set_id, p.number, min(page_number) AS page_number, max(i.index_position) AS index_position FROM {PHY} p JOIN {IDX} i ON i.set_id = p.set_id AND i.number = p.number WHERE p.number <> '' GROUP BY 1, 2)) WHERE index_position < seen"""


@query("s3_out_of_sequence", SEQ)
def _(t):
    return S.out_of_sequence(t.sheet_index, t.physical_sheets)


@query("s3_sequence_status", f"""SELECT DISTINCT set_id, CASE WHEN set_id IN (SELECT set_id FROM ({SEQ})) OR set_id IN (SELECT i.set_id FROM {IDX} i WHERE EXISTS (SELECT 1 FROM {PHY} p WHERE p.set_id = i.set_id AND p.number = i.number)
   GROUP BY i.set_id, i.number HAVING count(*) > 1) THEN 'Fail' ELSE 'Pass' END AS status FROM @sheet_index""")
def _(t):
    return S.sequence_status(t.sheet_index, t.physical_sheets)


_sc = lambda p, n: f"CASE WHEN regexp_matches(up, '{p}') THEN {n} ELSE 0 END"
COV = f"""SELECT set_id, page_number, sheet_number, CAST(score AS BIGINT) AS score, CASE WHEN row_number() OVER (PARTITION BY set_id ORDER BY strong DESC, score DESC, page_number) = 1 THEN 'primary' ELSE 'secondary' END AS cover_type
  FROM (SELECT *, CASE WHEN regexp_matches(up, '\\bCIVIL\\s+(?:COVER|CONSTRUCTION\\s+PLAN(?:S)?)\\b') AND NOT regexp_matches(up, '\\b(?:DESIGN\\s+CONSULTANT\\s+TEAM|OWNER)\\b') THEN 0 ELSE
    CASE WHEN regexp_replace(upper(sheet_number), '[^A-Z0-9]', '', 'g') IN ('CS', 'CS1', 'CS001', 'G000', 'G001', 'A000') THEN 100 ELSE 0 END + {_sc(r'\bCOVER\s+SHEET\b', 45)} + {_sc(r'\bSHEET\s+INDEX\b', 20)}
    + {_sc(r'\b(?:LOCATION|VICINITY)\s+MAP\b', 15)} + {_sc(r'\bDESIGN\s+CONSULTANT\s+TEAM\b', 15)} + {_sc(r'\bCONSTRUCTION\s+PLANS\b', 15)} END AS score,
    CAST(regexp_matches(up, '\\bDESIGN\\s+CONSULTANT\\s+TEAM\\b') AND regexp_matches(up, '\\bOWNER\\b') AS INT) AS strong FROM (SELECT *, upper(text) AS up FROM @sheet_pages)) WHERE score >= 65"""


@query("s7_classify_covers", COV)
def _(t):
    return S.classify_covers(t.sheet_pages)


@query("s5_physical_position", f"""WITH c AS ({COV}) SELECT set_id, page_number, CAST(page_number - (SELECT count(*) FROM c WHERE c.set_id = p.set_id AND c.page_number < p.page_number AND cover_type = 'secondary'
   AND NOT regexp_matches(upper(c.sheet_number), '^(B[- ]?\\d+(\\.\\d+)?|C[- ]?0(\\.0+)?)$')) AS BIGINT) AS position FROM @sheet_pages p""")
def _(t):
    return S.physical_position(t.sheet_pages, S.classify_covers(t.sheet_pages))


@query("s9_scope_pages", f"""SELECT set_id, page_number FROM @sheet_pages p WHERE starts_with({NUMBER('sheet_number')}, 'A') OR EXISTS (SELECT 1 FROM ({COV}) c WHERE c.set_id = p.set_id AND c.page_number = p.page_number)""")
def _(t):
    return S.scope_pages(t.sheet_pages, S.classify_covers(t.sheet_pages)).select("set_id", "page_number")


LEG, STOP = esc(X.KEYNOTE_LEGEND), esc(X.SECTION_STOP)
ENT = f"""SELECT set_id, page_number, string_split(e, chr(2))[1] AS note, trim(regexp_replace(string_split(e, chr(2))[2], '\\s+', ' ', 'g'), ' .;:-') AS content FROM (
  SELECT set_id, page_number, unnest(string_split(regexp_replace(trim(regexp_replace(CASE WHEN regexp_matches(tail, '(?i){STOP}') THEN regexp_extract(tail, '(?is)^(.*?){STOP}', 1) ELSE tail END, '\\s+', ' ', 'g')),
    '(^|\\s)(\\d{{1,3}})\\s*[).:\\-]', chr(1) || '\\2' || chr(2), 'g'), chr(1))[2:]) AS e FROM (
   SELECT set_id, page_number, substr(text, length(regexp_extract(text, '(?is)^(.*?{LEG})', 1)) + 1) AS tail FROM @sheet_pages WHERE regexp_matches(text, '(?i){LEG}'))) WHERE content <> ''"""


@query("s10_keynote_entries", ENT)
def _(t):
    return S.keynote_entries(t.sheet_pages)


DUPK = f"""SELECT set_id, page_number, norm, count(DISTINCT note) AS numbers, CAST(min(CAST(note AS INT)) AS BIGINT) AS first_number FROM (SELECT *, trim(regexp_replace(upper(regexp_replace(regexp_replace(content, '\\([^)]*\\)', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g')) AS norm FROM ({ENT}))
  WHERE norm <> '' AND NOT contains(upper(content), 'REFER FINISHES') AND NOT contains(upper(content), 'REFER TO FINISH')
    AND NOT (ends_with(norm, 'AS SCHEDULED') AND regexp_matches(norm, 'DOOR|WINDOW|STOREFRONT|WALL BASE|GYPSUM BOARD')) GROUP BY 1, 2, 3 HAVING count(DISTINCT note) >= 2"""


@query("s11_duplicate_keynotes", DUPK)
def _(t):
    return S.duplicate_keynotes(t.sheet_pages)


_ks = r"\b" + X.KEYNOTE_SECTION + r"\b"
HASK = f"len(regexp_extract_all(text, '(?i){_ks}')) > len(regexp_extract_all(text, '(?i)\\b(?:NO|WITHOUT|LACKS?)\\s+{_ks[2:]}'))"
VT = esc(X.VIEW_TITLE)


@query("s13_viewports", f"""SELECT set_id, page_number, upper(d) AS detail, regexp_replace(upper(l), '\\s+', ' ', 'g') AS label, regexp_replace(upper(s), '\\s+', ' ', 'g') AS scale FROM (
  SELECT set_id, page_number, unnest(regexp_extract_all(text, '(?i){VT}', 1)) AS d, unnest(regexp_extract_all(text, '(?i){VT}', 2)) AS l, unnest(regexp_extract_all(text, '(?i){VT}', 3)) AS s FROM @sheet_pages WHERE {HASK})""")
def _(t):
    return S.viewports(t.sheet_pages)


_ALONE = lambda c: f"list_filter(regexp_split_to_array(regexp_replace({c}, '(?i){esc(X.VIEW_SCALE)}', ' ', 'g'), '[^\\w./-]+'), lambda w: regexp_full_match(w, '\\d{{1,3}}'))"
KPAGE = f"""(SELECT *, CASE WHEN regexp_matches(tail, '(?i){STOP}') THEN regexp_extract(tail, '(?is)^(.*?){STOP}', 1) ELSE tail END AS body,
    CASE WHEN regexp_matches(text, '(?i){LEG}') THEN regexp_extract(text, '(?is)^(.*?){LEG}', 1) ELSE text END AS drawn
  FROM (SELECT *, CASE WHEN regexp_matches(text, '(?i){LEG}') THEN substr(text, length(regexp_extract(text, '(?is)^(.*?{LEG})', 1)) + 1) ELSE '' END AS tail FROM @sheet_pages WHERE {HASK}))"""
KC = f"""SELECT p.set_id, p.page_number, sheet_number, coalesce(repeats, 0) AS repeats,
    CASE WHEN regexp_matches(tail, '(?i)^\\s*\\d{{1,3}}\\s*[).:-]\\s*(?:SAMPLE|PLACEHOLDER|TBD|N/?A|NONE)[ \\t]*(?:\\n|$)') AND NOT regexp_matches(left(tail, 80), '(?i){LEG}') THEN 'Not Applicable'
      WHEN NOT (graphic_present OR len(list_distinct(list_filter(notes, lambda n: list_contains(near, n)))) >= 2
        OR len(list_filter(list_distinct(notes), lambda n: len(list_filter(far, lambda w: w = n)) >= 3)) >= 3) OR coalesce(repeats, 0) > 0 THEN 'Fail' ELSE 'Pass' END AS status
  FROM (SELECT *, regexp_extract_all(trim(regexp_replace(body, '\\s+', ' ', 'g')), '(^|\\s)(\\d{{1,3}})\\s*[).:\\-]', 2) AS notes, {_ALONE('drawn')} AS near, {_ALONE('tail')} AS far FROM {KPAGE}) p LEFT JOIN (SELECT set_id, page_number, count(*) AS repeats FROM ({DUPK}) GROUP BY 1, 2) d USING (set_id, page_number)"""


@query("s12_keynote_compliance", KC)
def _(t):
    return S.keynote_compliance(t.sheet_pages)


TYPES = f"""SELECT set_id, CASE WHEN bool_or({m('text', X.NON_OFFICIAL)}) THEN 'Non-Official' WHEN bool_or({m('text', X.OFFICIAL)}) THEN 'Official' ELSE 'Unknown' END AS set_type FROM @sheet_pages GROUP BY 1"""


@query("x17_set_types", TYPES)
def _(t):
    return S.set_types(t.sheet_pages)


SEALS = f"""SELECT set_id, page_number, sheet_number, CASE WHEN set_type IS DISTINCT FROM 'Official' THEN 'Not Applicable' WHEN seal_present THEN 'Pass' ELSE 'Fail' END AS status FROM @sheet_pages LEFT JOIN ({TYPES}) USING (set_id)"""


@query("s15_seal_compliance", SEALS)
def _(t):
    return S.seal_compliance(t.sheet_pages, S.set_types(t.sheet_pages))


_soft = {"project_identifier": r"\bPROJECT\b", "central_image": r"\b(?:RENDER|RENDERING|ISOMETRIC|PERSPECTIVE|IMAGE)\b", "registration": r"\bTDLR\b|\bTABS\b\s*#?\s*\d+",
         "consultant_team": r"\bDESIGN\s+CONSULTANT\s+TEAM\b|\bCONSULTANTS?\b", "owner_section": r"\b(?:OWNER|CLIENT)\b", "vicinity_map": r"\b(?:VICINITY|LOCATION)\s+MAP\b"}
CHK = f"""SELECT set_id, unnest([{', '.join("'" + k + "'" for k in _soft)}, 'sheet_index', 'set_type_marker']) AS item, unnest([{', '.join(f"CASE WHEN bool_or({m('text', p)}) THEN 'Pass' ELSE 'Needs Review' END" for p in _soft.values())},
   CASE WHEN bool_or({m('text', X.INDEX_HEADER)}) THEN 'Pass' ELSE 'Fail' END, CASE any_value(set_type) WHEN 'Official' THEN CASE WHEN bool_or({m('text', X.SEAL)} OR seal_present) THEN 'Pass' ELSE 'Fail' END
   WHEN 'Non-Official' THEN CASE WHEN bool_or({m('text', X.NON_OFFICIAL)}) THEN 'Pass' ELSE 'Fail' END ELSE 'Needs Review' END]) AS status FROM @sheet_pages JOIN ({TYPES}) USING (set_id) GROUP BY set_id"""


def _check(t):
    types = S.set_types(t.sheet_pages)
    return S.cover_checklist(t.sheet_pages, types), S.keynote_compliance(t.sheet_pages), S.seal_compliance(t.sheet_pages, types)


@query("s8_cover_checklist", CHK)
def _(t):
    return _check(t)[0]


@query("s16_qc_summary", f"""SELECT *, cover_failed + keynote_failed + seals_failed AS failed_items, CASE WHEN failed_items > 0 THEN 'Fail' WHEN cover_review > 0 THEN 'Needs Review' ELSE 'Pass' END AS overall FROM (
  SELECT set_id, cover_failed, cover_review, coalesce(keynote_sheets, 0) AS keynote_sheets, coalesce(keynote_failed, 0) AS keynote_failed, coalesce(seals_failed, 0) AS seals_failed
  FROM (SELECT set_id, count(*) FILTER (status = 'Fail') AS cover_failed, count(*) FILTER (status = 'Needs Review') AS cover_review FROM ({CHK}) GROUP BY 1)
  LEFT JOIN (SELECT set_id, count(*) AS keynote_sheets, count(*) FILTER (status = 'Fail') AS keynote_failed FROM ({KC}) GROUP BY 1) USING (set_id)
  LEFT JOIN (SELECT set_id, count(*) FILTER (status = 'Fail') AS seals_failed FROM ({SEALS}) GROUP BY 1) USING (set_id))""")
def _(t):
    return S.qc_summary(*_check(t))


REP = f"""SELECT set_id, 1 AS section_order, 'Cover Sheet Checklist' AS section, item, status, '' AS sheet, CAST(NULL AS BIGINT) AS page FROM ({CHK})
  UNION ALL SELECT set_id, 2, 'Sheet Keynote Compliance', 'SHEET KEYNOTES gate', status, sheet_number, page_number FROM ({KC})
  UNION ALL SELECT set_id, 3, 'Sheet Seal Compliance', 'Right-side professional seal', status, sheet_number, page_number FROM ({SEALS})"""


@query("a5_qc_report", REP)
def _(t):
    return S.qc_report(*_check(t))


@query("a6_missing_items", f"SELECT * FROM ({REP}) WHERE status IN ('Fail', 'Needs Review')")
def _(t):
    return S.missing_items(S.qc_report(*_check(t)))


_kw = dict(X.KEYWORDS)
_h = lambda k: f"bool_or({m('up', _kw[k])}) AS {k}"
_share = lambda c, low, s: f"{c} >= greatest({low}, floor(pages * CAST({s} AS DOUBLE)))"
_rules = [("title_blocks < greatest(1, floor(pages * CAST(0.5 AS DOUBLE)))", 1, "High", "Missing title block"), ("NOT (project_name AND project_address AND owner_client)", 2, "High", "Missing or incorrect project information"),
          ("NOT sheet_index", 3, "High", "Missing drawing index"), ("NOT consultant_team", 4, "Medium", "Missing consultant information"), ("NOT (north_arrow OR scale OR graphic_scale)", 5, "Medium", "Missing north arrow or scale"),
          ("NOT revision_block", 6, "Medium", "Missing revision block"), ("NOT (professional_seal OR signature)", 7, "High", "Missing professional seal or signature"),
          ("coalesce(repeated, 0) > 0", 8, "High", "Incorrect or duplicate sheet numbers"), ("blank > 0", 9, "Medium", "Missing, blank, or extra sheets"), ("placeholders > 0", 10, "High", "Placeholder text not removed"),
          (_share("untitled", 2, 0.08), 11, "Medium", "Incorrect sheet titles"), (_share("unscaled", 8, 0.30), 12, "Medium", "Missing view titles or scales"), (_share("unrevised", 5, 0.35), 13, "Low", "Missing revision history"),
          (_share("cropped", 3, 0.08), 14, "Medium", "Views cropped incorrectly or placed off sheet"), ("NOT issue_date", 15, "High", "Missing or incorrect issue date")]
RUL = f"""WITH a AS (SELECT set_id, count(*) AS pages, count(*) FILTER (tb) AS title_blocks, {', '.join(_h(k) for k in ('project_name', 'project_address', 'owner_client', 'sheet_index', 'consultant_team', 'issue_date', 'north_arrow', 'scale', 'graphic_scale', 'revision_block', 'professional_seal', 'signature'))},
    count(*) FILTER (sz < 80 OR {m('up', _kw['blank_marker'])}) AS blank, count(*) FILTER ({m('up', _kw['placeholder'])}) AS placeholders, count(*) FILTER (tb AND sheet_title = '') AS untitled,
    count(*) FILTER (regexp_matches(up, 'PLAN|ELEVATION|SECTION|DETAIL') AND NOT {m('up', _kw['scale'])}) AS unscaled, count(*) FILTER (tb AND NOT {m('up', _kw['revision'])}) AS unrevised,
    count(*) FILTER (regexp_matches(up, 'MATCHLINE|SEE CONTINUATION|CONTINUED|CROP|VIEWPORT') AND sz < 250) AS cropped FROM (SELECT *, upper(text) AS up, length(trim(upper(text))) AS sz, title_block_text <> '' AS tb FROM @sheet_pages) GROUP BY 1),
  b AS (SELECT a.*, (SELECT count(*) FROM (SELECT upper(sheet_number) AS n FROM @sheet_pages p WHERE p.set_id = a.set_id GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM a),
  r AS ({' UNION ALL '.join(f"SELECT set_id, '{c}' AS category, '{sv}' AS severity, {S.SEVERITY[sv]} AS sev, CAST({i} AS BIGINT) AS rule_no FROM b WHERE {cond}" for cond, i, sv, c in _rules)})
  SELECT * FROM r"""


@query("s17_document_rules", f"SELECT * FROM ({RUL})")
def _(t):
    return S.document_rules(t.sheet_pages)


@query("s17_top_findings", f"SELECT set_id, category, severity, rule_no FROM ({RUL}) ORDER BY sev, category, set_id, rule_no LIMIT 10")
def _(t):
    return S.top_findings(S.document_rules(t.sheet_pages))


@query("s20_issue_counts", f"SELECT category, count(*) AS issues FROM ({RUL}) GROUP BY 1")
def _(t):
    return S.document_rules(t.sheet_pages).groupBy("category").agg(F.count(F.lit(1)).alias("issues"))


REFS = f"(SELECT DISTINCT set_id, upper(r) AS number FROM (SELECT set_id, unnest(regexp_extract_all(text, '(?i){esc(X.CALLOUT)}', 2)) AS r FROM @sheet_pages))"
HAVE = "(SELECT DISTINCT set_id, upper(sheet_number) AS number FROM @sheet_pages)"


@query("s19_callouts", f"""SELECT *, 'broken' AS kind FROM {REFS} r WHERE NOT EXISTS (SELECT 1 FROM {HAVE} h WHERE h.set_id = r.set_id AND h.number = r.number)
  UNION ALL SELECT *, 'unreferenced' FROM {HAVE} h WHERE NOT EXISTS (SELECT 1 FROM {REFS} r WHERE h.set_id = r.set_id AND h.number = r.number)""")
def _(t):
    return S.callouts(t.sheet_pages)


@query("s21_presence_checks", f"""SELECT set_id, CASE WHEN bool_or({m('text', X.SEAL)} OR seal_present) THEN 'Present' WHEN rd THEN 'Missing' ELSE 'Not Detected' END AS seal, CASE WHEN bool_or({m('text', X.INDEX_HEADER)}) THEN 'Present' WHEN rd THEN 'Missing' ELSE 'Not Detected' END AS sheet_index,
  CASE WHEN bool_or({m('title_block_text', 'PROJECT')}) THEN 'Present' WHEN rd THEN 'Missing' ELSE 'Not Detected' END AS project, count(*) FILTER (sheet_title = '') AS untitled
  FROM (SELECT *, bool_or(trim(text) <> '' OR trim(title_block_text) <> '') OVER (PARTITION BY set_id) AS rd FROM @sheet_pages) GROUP BY set_id, rd""")
def _(t):
    return S.presence_checks(t.sheet_pages)


@query("s18_title_mismatch")
def _(t):
    p = t.sheet_pages
    titles = p.select("set_id", F.upper("sheet_number").alias("number"), F.when(C("doc_id") % 3 == 0, "ROOF PLAN").otherwise("ELECTRICAL POWER").alias("index_title")).distinct()
    return S.title_mismatch(p, titles)


FIX = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in X.CORRECTIONS.items() if k != "waterproofng") + ") f(bad, good)"


@query("s22_spell_check", f"""WITH w AS (SELECT set_id, page_number, sheet_number, text, ws, gs, unnest(range(1, len(ws) + 1)) AS i FROM (
    SELECT *, regexp_extract_all(text, '{esc(X.WORD)}') AS ws, regexp_split_to_array(text, '{esc(X.WORD)}') AS gs FROM @sheet_pages)),
  h AS (SELECT *, ws[i] AS word, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) AS INT) AS start, good AS suggestion FROM w JOIN {FIX} ON lower(ws[i]) = bad),
  c AS (SELECT *, trim(regexp_replace(substr(text, greatest(start - 70, 0) + 1, start + length(word) + 70 - greatest(start - 70, 0)), '\\s+', ' ', 'g')) AS context FROM h),
  o AS (SELECT *, row_number() OVER (PARTITION BY set_id, page_number, lower(word), lower(context) ORDER BY start) AS d FROM c WHERE NOT {m('context', X.TITLE_LABEL)})
  SELECT set_id, page_number, sheet_number, word, suggestion, start, context FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY page_number, start) AS k FROM o WHERE d = 1)""")
def _(t):
    return S.spell_check(t.sheet_pages, ["waterproofng"])


_TOK = lambda c: f"list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z''.-]{{2,}}'), lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), lambda w: length(w) >= 3)"


@query("s23_metadata_dictionary", f"""WITH l AS (SELECT unnest(regexp_split_to_array(title_block_text || chr(10) || text, '[\\r\\n]+')) AS line FROM @sheet_pages)
  SELECT word FROM (SELECT unnest({_TOK('line')}) AS word FROM l WHERE {m('line', X.TITLE_LABEL)}
   UNION SELECT word FROM (SELECT unnest(list_distinct({_TOK('title_block_text')})) AS word FROM @sheet_pages) GROUP BY 1 HAVING count(*) >= 2 UNION SELECT 'acme')
  WHERE word NOT IN ({', '.join("'" + k + "'" for k in X.CORRECTIONS)})""")
def _(t):
    return S.metadata_dictionary(t.sheet_pages, ["Acme"])


@query("s24_standards_profile", """SELECT row_number() OVER (ORDER BY sheets DESC, first_seen) AS rank, title, sheets FROM (SELECT upper(sheet_title) AS title, count(*) AS sheets, min(doc_id) AS first_seen FROM @sheet_pages WHERE sheet_title <> '' GROUP BY 1)
  ORDER BY rank LIMIT 50""")
def _(t):
    return S.standards_profile(t.sheet_pages)


@query("s24_discipline_counts", f"SELECT {DISC} AS discipline, count(DISTINCT set_id) AS documents, count(*) AS sheets FROM @sheet_pages GROUP BY 1")
def _(t):
    return S.discipline_counts(t.sheet_pages)


@query("s25_similar_references", """SELECT vec_id, rank, ref_id FROM (SELECT q.vec_id, r.vec_id AS ref_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9) DESC, r.vec_id) AS rank
  FROM @embeddings q JOIN @embeddings r ON r.vec_id <> q.vec_id) WHERE rank <= 3""")
def _(t):
    e = t.embeddings
    return S.similar_references(e, e).drop("cosine")


@query("s28_merge_overrides", """SELECT set_id, page_number, CASE WHEN doc_id % 7 = 3 THEN 'Z' || doc_id ELSE sheet_number END AS sheet_number, CASE WHEN doc_id % 14 = 3 THEN 'EDITED' ELSE sheet_title END AS sheet_title, seal_present FROM @sheet_pages""")
def _(t):
    p = t.sheet_pages
    edits = p.where("doc_id % 7 = 3").select("set_id", "page_number", F.concat(F.lit("Z"), C("doc_id").cast("string")).alias("sheet_number"),
                                             F.when(C("doc_id") % 14 == 3, "EDITED").alias("sheet_title"))
    return S.merge_overrides(p, edits)


@query("s29_needs_work", """WITH c AS (SELECT sha256(text) AS hash, max(doc_id % 3) AS version FROM @documents WHERE doc_id % 4 <> 0 GROUP BY 1)
  SELECT doc_id, CASE WHEN version IS NULL THEN 'extract' WHEN version < 2 THEN 're-evaluate' ELSE 'reuse' END AS work FROM @documents d LEFT JOIN c ON sha256(d.text) = c.hash""")
def _(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return S.needs_work(d, d.where("doc_id % 4 <> 0").select("hash", (C("doc_id") % 3).alias("version")), 2)


@query("s32_sheet_register", f"""SELECT p.set_id, page_number, sheet_number, sheet_title AS title, {DISC} AS discipline, regexp_extract(text, '(?i){VT}', 3) AS scale, set_type AS phase FROM @sheet_pages p LEFT JOIN ({TYPES}) USING (set_id)""")
def _(t):
    return S.sheet_register(t.sheet_pages, S.set_types(t.sheet_pages))


@query("s27_run_history", """SELECT run_id, modified, status, replace(status, 'Needs Review', 'Pass') AS shown FROM (SELECT o_orderkey AS run_id, CAST(epoch(o_orderdate) AS BIGINT) AS modified, CASE o_orderstatus WHEN 'F' THEN 'Fail' WHEN 'P' THEN 'Needs Review' ELSE 'Pass' END AS status FROM @orders)
  ORDER BY modified DESC, run_id LIMIT 25""")
def _(t):
    runs = t.orders.select(C("o_orderkey").alias("run_id"), C("o_orderdate").cast("timestamp").cast("bigint").alias("modified"),
                           F.when(C("o_orderstatus") == "F", "Fail").when(C("o_orderstatus") == "P", "Needs Review").otherwise("Pass").alias("status"))
    return S.run_history(runs)


@query("s4_exclude_covers", f"""WITH k AS (SELECT set_id, count(*) AS k FROM ({COV}) WHERE cover_type = 'secondary' AND NOT regexp_matches(upper(sheet_number), '^(B[- ]?\\d+(\\.\\d+)?|C[- ]?0(\\.0+)?)$') GROUP BY 1),
  u AS (SELECT set_id, index_position, row_number() OVER (PARTITION BY set_id ORDER BY index_position) AS nth FROM @page_index i WHERE {m('sheet_name', r'COVER\s+SHEET')}
    AND NOT EXISTS (SELECT 1 FROM @sheet_pages p WHERE p.set_id = i.set_id AND {NUMBER('p.sheet_number')} = {NUMBER('i.sheet_number')}))
  SELECT set_id, index_position, {NUMBER('sheet_number')} AS number, EXISTS (SELECT 1 FROM u JOIN k USING (set_id) WHERE u.set_id = i.set_id AND u.index_position = i.index_position AND nth <= k) AS ignored FROM @page_index i""")
def _(t):
    covers = written(S.classify_covers(t.sheet_pages), "covers")  # the texts are read once and not stored
    return S.exclude_covers(t.page_index, t.sheet_pages.select("set_id", "page_number", "sheet_number"), covers).select("set_id", "index_position", "number", "ignored")


@query("s9_scope_index", f"""SELECT set_id, index_position, number, row_number() OVER (PARTITION BY set_id ORDER BY index_position) AS position FROM (SELECT *, {NUMBER('sheet_number')} AS number FROM @page_index) i
  WHERE starts_with(number, 'A') OR (regexp_matches(number, '^(CS\\d*|G0+\\.?0*)$') AND NOT starts_with(upper(sheet_number), 'CS-'))
    OR EXISTS (SELECT 1 FROM @sheet_pages p WHERE p.set_id = i.set_id AND {NUMBER('p.sheet_number')} = i.number AND (starts_with({NUMBER('p.sheet_number')}, 'A')
      OR EXISTS (SELECT 1 FROM ({COV}) c WHERE c.set_id = p.set_id AND c.page_number = p.page_number)))""")
def _(t):
    covers = written(S.classify_covers(t.sheet_pages), "covers")
    return S.scope_index(t.page_index, S.scope_pages(t.sheet_pages.select("set_id", "page_number", "sheet_number"), covers)).select("set_id", "index_position", "number", "position")


@query("x18_page_scales", f"""SELECT set_id, page_number,
   CASE WHEN regexp_matches(flat, '^(N\\.?T\\.?S\\.?|NOT TO SCALE|NO SCALE)$') THEN 'NTS' ELSE flat END AS scale, count(*) AS marks FROM (
  SELECT set_id, page_number, trim(regexp_replace(upper(raw), '\\s+', ' ', 'g'), ' .') AS flat FROM (SELECT set_id, page_number, unnest(regexp_extract_all(text, '(?i)({esc(X.VIEW_SCALE)})', 1)) AS raw
   FROM @sheet_pages)) GROUP BY 1, 2, 3""")
def _(t):
    return S.page_scales(t.sheet_pages)
