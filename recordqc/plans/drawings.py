"""Registered queries of sheet indexes, sheet identities and views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.operators import drawings as O
from recordqc.plans.registry import query
from recordqc.session import written

C = F.col

HEAD = r"(?i)\b(?:SHEET\s+INDEX|DRAWING\s+INDEX|INDEX\s+OF\s+SHEETS|INDEX\s+OF\s+DRAWINGS|SHEET\s+LIST)\b"
NUMBER = (r"(?:ADA|CS(?:[- .]?\d{1,4})?|(?:G|A|AD|ADA|AS|B|D|I|ID|IR|LS|L|C|S|SD|M|MD|MG|MP|MS|P|PD|PP|E|ED|EG|EL|EP|ES|FP|FA|T|MEP|MEPD|FS|SP)"
          r"[- .]?\d{1,4}(?:\.\d+)?(?:[-.]\d+)?[A-Z]?)")
COVER = r"CS[- ]+[A-Z][A-Z0-9-]{1,20}"
NO_TITLE = (r"(?i)(?:\b\d{3,6}\s+[A-Z0-9 .''-]+(?:AVE|AVENUE|BLVD|BOULEVARD|ST|STREET|RD|ROAD|DR|DRIVE|LN|LANE|HWY|HIGHWAY)\b|\b[A-Z .''-]+,?\s+(?:TX|TEXAS)\s+\d{5}(?:-\d{4})?\b"
            r"|\b(?:SUITE|STE\.?|P\.?O\.?\s*BOX)\s+\w+\b|\b(?:PROJECT|JOB)\s*(?:NO\.?|NUMBER|#)?\s*\d{2,5}[-.]\d{2,5}\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}[-.]\d{3,5}\b"
            r"|\b(?:TBPELS|FIRM\s+REGISTRATION)\b|\b(?:KNOW\s+WHAT''?S\s+BELOW|BEFORE\s+YOU\s+DIG|PRIOR\s+TO\s+DIGGING)\b|@|\b(?:COPYRIGHT|DO NOT REPRODUCE)\b|\bNO\s+SHEET\s+NUMBER\b)")
NOT_ALONE = (rf"(?i)(?:(?:PROJECT|OWNER|CLIENT|ARCHITECT|ENGINEER|CONSULTANT|DRAWN|CHECKED|DATE|SCALE|REVISION|SHEET|NUMBER|NO\.?|TITLE|ISSUE|ISSUED|SEAL|STAMP|LICENSE|COPYRIGHT)"
             rf"|{NUMBER}|[A-Z]{{1,5}}[- ]?\d{{1,4}}(?:\.\d+)?(?:[-.]\d+)?[A-Z]?)")
LINES = r"list_transform(string_split_regex({}, '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' '))"

INDEX_PAGES = rf"""
p AS MATERIALIZED (SELECT set_id, page_number, doc_id, text, row_number() OVER (PARTITION BY set_id ORDER BY page_number, doc_id) AS rn, regexp_matches(text, '{HEAD}') AS headed FROM @index_pages),
h AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY page_number, doc_id) AS hn, min(rn) OVER (PARTITION BY set_id) AS least FROM p WHERE headed),
cand AS (SELECT set_id, page_number, doc_id, text FROM h WHERE CASE WHEN least <= 5 THEN rn <= 5 ELSE hn <= 3 END)"""

ENTRIES = INDEX_PAGES + rf""",
ln AS MATERIALIZED (SELECT set_id, page_number, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT *, {LINES.format('text')} AS x FROM cand)),
fl AS MATERIALIZED (SELECT *, regexp_matches(line, '{HEAD}') AS is_head, length(line) BETWEEN 1 AND 24 AND (upper(replace(line, ' ', '')) = 'ADA' OR regexp_full_match(line, '(?i){COVER}') OR regexp_full_match(line, '(?i){NUMBER}')) AS is_number FROM ln),
run AS (SELECT doc_id, min(i) AS lo, max(i) AS hi, count(*) AS size FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM fl WHERE is_number) GROUP BY doc_id, g),
best AS (SELECT f.doc_id, r.lo, r.hi, r.size FROM fl f JOIN run r ON r.doc_id = f.doc_id AND r.hi < f.i WHERE is_head QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.i ORDER BY r.size DESC, r.lo) = 1),
span AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT doc_id, lo, hi FROM best WHERE size >= 3 UNION ALL
    SELECT f.doc_id, g.i, g.i FROM fl f JOIN fl g ON g.doc_id = f.doc_id AND g.is_number AND g.i > f.i AND g.i <= f.i + 260 WHERE f.is_head) GROUP BY doc_id),
taken AS (SELECT set_id, page_number, f.doc_id, i, line FROM fl f JOIN span s ON s.doc_id = f.doc_id AND f.i BETWEEN lo AND hi + 3
    UNION ALL SELECT set_id, page_number, doc_id, generate_subscripts(x, 1), unnest(x) FROM (SELECT *, {LINES.format(f"substr(text, strpos(text, regexp_extract(text, '{HEAD}')))")} AS x FROM cand ANTI JOIN span USING (doc_id))),
num AS (SELECT *, upper(regexp_replace(CASE WHEN regexp_matches(line, '(?i)\b{COVER}\b') THEN regexp_extract(line, '(?i)\b{COVER}\b') ELSE regexp_extract(line, '(?i)\b{NUMBER}\b') END, '\s+', '', 'g')) AS sheet_number,
    [lead(line, 1) OVER w, lead(line, 2) OVER w, lead(line, 3) OVER w] AS nx FROM taken WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT *, trim(regexp_replace(trim(line, ' :-' || chr(9)), '(?i)\b\Q' || sheet_number || '\E\b', '', 'g'), ' :-' || chr(9)) AS t FROM num
    WHERE length(line) BETWEEN 1 AND 180 AND sheet_number <> '' AND (sheet_number <> 'ADA' OR upper(line) = 'ADA')),
nm AS (SELECT *, CASE WHEN length(t) NOT BETWEEN 4 AND 90 OR regexp_matches(t, '{NO_TITLE}') OR regexp_full_match(t, '{NOT_ALONE}') OR length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < 4
    OR upper(t) = sheet_number THEN '' ELSE upper(t) END AS name, list_filter(nx, lambda x: x <> '' AND upper(x) <> sheet_number)[1] AS nb FROM t),
e AS (SELECT set_id, page_number, doc_id, i, sheet_number, CASE WHEN upper(line) = sheet_number AND name = '' AND regexp_full_match(coalesce(nb, ''), '(?i)COVER\s+SHEET') THEN nb ELSE name END AS sheet_name,
    regexp_replace(sheet_number, '[^A-Z0-9.]', '', 'g') AS number FROM nm),
one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY set_id, number ORDER BY page_number, doc_id, i) = 1),
entries AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY page_number, doc_id, i) AS index_position, sheet_number, sheet_name, page_number,
    CASE WHEN sheet_name <> '' THEN 80 ELSE 62 END::BIGINT AS confidence FROM one)"""


@query("s1_index_entries", f"WITH {ENTRIES} SELECT * FROM entries")
def _(t):
    return O.index_entries(t.index_pages)


@query("s1_index_summary", f"""WITH {ENTRIES} SELECT set_id, source_pages, entries, CASE WHEN entries > 0 THEN 90 ELSE 0 END::BIGINT AS confidence, entries = 0 AS needs_review FROM (
  SELECT s.set_id, (SELECT count(*) FROM cand c WHERE c.set_id = s.set_id) AS source_pages, (SELECT count(*) FROM entries e WHERE e.set_id = s.set_id) AS entries FROM (SELECT DISTINCT set_id FROM p) s)""")
def _(t):
    return O.index_summary(t.index_pages, O.index_entries(t.index_pages))


LABEL = (r"(?i)\b((?:ENLARGED\s+)?(?:FLOOR|ROOF|SITE|UTILITY|LIGHTING|POWER|PLUMBING|MECHANICAL|ELECTRICAL|LANDSCAPE|FOUNDATION|FRAMING|DEMO(?:LITION)?|DRAINAGE(?:\s*&\s*GRADING)?"
         r"|DIMENSION(?:AL)?\s+CONTROL)\s+PLAN|REFLECTED\s+CEILING\s+PLAN|RCP|(?:[A-Z][A-Z0-9/&''.-]*\s+){1,5}DETAIL|(?:(?:BUILDING|WALL|INTERIOR|EXTERIOR|INT\.?|ENLARGED)\s+)"
         r"(?:SECTION|ELEVATION|DETAIL)|PERSPECTIVE)\b")
SCALE = (r"(?i)(?:\bN\.?T\.?S\.?\b|\bNOT\s+TO\s+SCALE\b|\bNO\s+SCALE\b|(?:\d+/\d+|\d+(?:\.\d+)?)\s*\"\s*=\s*(?:\d+\s*''\s*(?:-\s*(?:\d+(?:\s+\d+/\d+)?)\s*\"?)?|\d+(?:\s+\d+/\d+)?\s*\"))")
DETAIL = r"[A-Z]?\d{1,3}(?:\.\d+)?[A-Z]?"
MARKS = "translate({}, '‘’′“”″', '''''''\"\"\"')"
FRAGMENT = lambda x: f"trim(regexp_replace({MARKS.format(x)}, '{SCALE}', ' ', 'g'), ' .:-')"
IN_FRAGMENT = lambda x: rf"CASE WHEN regexp_full_match({FRAGMENT(x)}, '(?i){DETAIL}') THEN {FRAGMENT(x)} ELSE regexp_extract({FRAGMENT(x)}, '(?i)(?:^|\s)({DETAIL})(?:\s|$)', 1) END"


@query("s14_missing_scales", rf"""WITH p AS (SELECT set_id, page_number, doc_id, sheet_number, scale_mark, list_filter({LINES.format('text')}, lambda x: x <> '') AS w FROM @view_pages
    WHERE NOT is_cover AND NOT regexp_matches(sheet_title, '(?i)\b(?:COVER|INDEX)\s+SHEET\b|\bSHEET\s+INDEX\b|\bINDEX\s+OF\s+SHEETS\b')
      AND NOT regexp_matches(text, '(?i)\bSHEET\s+INDEX\b|\bINDEX\s+OF\s+SHEETS\b|\b(?:DOOR|WINDOW|ROOM\s+FINISH)\s+SCHEDULE\b|\bGLAZING\s+TYPES?\b|\bCEILING\s+TILE\s+TYPES?\b')
      AND NOT (regexp_matches(text, '(?i)\b(?:DOOR|WINDOW)\s+(?:HEAD|JAMB|SILL)\s+DETAILS?\b') AND regexp_matches(text, '(?i)\b(?:AS|PER)\s+SCHEDULED?\b')
        AND regexp_matches(sheet_title, '(?i)\b(?:DOOR|WINDOW|LEAD-LINED|GLAZING)\b'))),
  l AS (SELECT *, w[i] AS line FROM (SELECT *, generate_subscripts(w, 1) AS i FROM p) WHERE regexp_matches(w[i], '{LABEL}') AND NOT regexp_matches(w[i], '(?i)\b(?:KEY)?NOTES?\b')),
  m AS (SELECT *, string_split(regexp_replace(line, '{LABEL}', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS s FROM l),
  k AS (SELECT *, replace(array_to_string(s[1:k], ''), chr(2), '') AS pre, string_split(s[k + 1], chr(2))[1] AS lab, string_split(s[k + 1], chr(2))[2] || replace(array_to_string(s[k + 2:], ''), chr(2), '') AS post
    FROM (SELECT *, unnest(range(1, len(s))) AS k FROM m)),
  v AS (SELECT *, upper(coalesce(nullif(regexp_extract(trim(pre, ' .:-'), '(?i)(?:^|\s)({DETAIL})$', 1), ''), nullif({IN_FRAGMENT("trim(post, ' .:-')")}, ''),
      list_filter([trim(w[i - 1], ' .:-'), CASE WHEN i > 2 THEN trim(w[i - 2], ' .:-') END], lambda x: i > 1 AND regexp_full_match(x, '(?i){DETAIL}'))[1],
      list_filter(list_transform(w[i + 1:i + 3], lambda x: {IN_FRAGMENT("x")}), lambda x: x <> '')[1])) AS d, trim(regexp_replace(upper(lab), '\s+', ' ', 'g')) AS view
    FROM k WHERE NOT regexp_matches(pre, '(?i)\bREFER\s+TO\b') AND NOT regexp_matches(right(pre, 12), '(?i)\b(?:RE|REF|REFERENCE)\.?\s*:?\s*$') AND NOT regexp_matches(left(post, 30), '(?i)^\s+FOR\s+(?:SIZES|LOCATION|REFERENCE|INFORMATION)\b')
      AND NOT regexp_matches(array_to_string(list_concat(w[greatest(i - 2, 1):i - 1], [pre]), ' '), '(?i)\bREFER\s+TO\b|\bREFERENCE\s*:?\s*$|\bREF\.?\s+NOTES?\b')
      AND NOT (regexp_matches(array_to_string(w[greatest(i - 10, 1):i], ' '), '(?i)\b(?:INDEX|LIST)\s+OF\s+SHEETS\b|\bSHEET\s+(?:INDEX|LIST)\b')
        AND len(list_filter(w[greatest(i - 3, 1):i], lambda x: regexp_full_match(x, '(?i)[A-Z]{{1,5}}[- ]?\d{{1,4}}(?:\.\d+)?(?:[-.]\d+)?[A-Z]?'))) > 0)),
  z AS (SELECT *, trim(regexp_replace(upper(regexp_extract({MARKS.format("array_to_string(w[greatest(i - 4, 1):i + 2], ' ')")}, '{SCALE}')), '\s+', ' ', 'g'), ' .') AS found FROM v
    WHERE d IS NOT NULL AND NOT (view = 'ROOF PLAN' AND regexp_matches(line, '(?i)\b(?:REFER|REF\.?|SEE|LEGEND|SCHEDULE|FINISH)\b')) AND NOT regexp_matches(view, '\bSEE\s+DETAILS?$')
      AND (sheet_number = '' OR regexp_replace(d, '[^A-Z0-9.]', '', 'g') <> regexp_replace(upper(sheet_number), '[^A-Z0-9.]', '', 'g'))),
  y AS (SELECT *, CASE WHEN regexp_full_match(found, 'N\.?T\.?S\.?|NOT TO SCALE|NO SCALE') THEN 'NTS' WHEN found = '' AND view = 'SITE PLAN' AND scale_mark THEN 'Visual scale marker' ELSE found END AS scale FROM z)
  SELECT set_id, page_number, doc_id, CASE WHEN sheet_number <> '' THEN sheet_number ELSE 'Page ' || page_number END AS sheet_number, d AS detail_number, view AS view_label, scale,
    CASE WHEN scale <> '' THEN 'Pass' ELSE 'Warning' END AS status, CASE WHEN scale <> '' THEN '' ELSE 'Missing scale or NTS designation.' END AS comment
  FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, d, view ORDER BY scale = '', i, k) = 1""")
def _(t):
    return O.missing_scales(t.view_pages)


NORM = lambda c: rf"upper(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}.]', '', 'g'))"
PRE = lambda c: f"regexp_extract({c}, '^([A-Z]+)', 1)"
DRAWN = lambda c: f"""((visual_present AND visual_confidence >= 70) OR ({PRE(c)} IN ('C', 'S', 'SD') AND dark_pixels >= 1800 AND ink_pixels >= 2200)
    OR ({PRE(c)} IN ('AD', 'AS', 'D', 'E', 'ED', 'EL', 'EP', 'ES', 'FP', 'FA', 'FS', 'I', 'ID', 'IR', 'M', 'MD', 'MG', 'MP', 'MS', 'P', 'PD', 'MEP', 'MEPD') AND dark_pixels >= 850 AND ink_pixels >= 1200))"""
LABELLED = lambda c: rf"""coalesce(NOT ({c} IN ('CS', 'COVER') AND regexp_matches(label_text, '(?i)\bCIVIL\b')) AND ((lab <> '' AND lab = {c}) OR (lab = 'SI' AND {c} = 'S1'
    AND regexp_matches(label_text || chr(10) || title_block_text || chr(10) || text, '(?i)\bGENERAL\s+NOTES\b') AND regexp_matches(label_text || chr(10) || title_block_text || chr(10) || text, '(?i)\bSTRUCTURAL\b'))), false)"""


@query("s6_sheet_identity", rf"""WITH i AS MATERIALIZED (SELECT *, {NORM('sheet_number')} AS num FROM @identity_index WHERE {NORM('sheet_number')} <> ''),
  p AS (SELECT *, {NORM('sheet_number')} AS own, {NORM('label_number')} AS lab, sheet_source IN ('sheet_index_position') AS inf,
      cover_type = 'secondary' AND NOT regexp_full_match(upper(sheet_number), 'B[- ]?\d+(\.\d+)?|C[- ]?0(\.0+)?') AS sec FROM @identity_pages),
  q AS MATERIALIZED (SELECT *, regexp_replace(upper(title_block_text || ' ' || CASE WHEN inf THEN '' ELSE sheet_name END), '\s+', ' ', 'g') AS ctx,
      page_number - (SELECT count(*) FROM p o WHERE o.set_id = p.set_id AND o.sec AND o.page_number < p.page_number) AS pos FROM p),
  c AS (SELECT *, CASE WHEN is_cover OR cover_type <> '' THEN NULL WHEN NOT regexp_matches(ctx, '\b(DEMOLITION|DEMO)\b') THEN CASE WHEN regexp_matches(ctx, '\b(ACCESSIBILITY|ADA)\b') THEN 'ADA' END
      WHEN regexp_matches(ctx, '\bELECTRICAL\b') THEN 'ED' WHEN regexp_matches(ctx, '\bPLUMBING\b') THEN 'PD' WHEN regexp_matches(ctx, '\bMECHANICAL\b') THEN 'MD' WHEN regexp_matches(ctx, '\bARCHITECTURAL\b') THEN 'AD'
      WHEN regexp_matches(ctx, '\b(ACCESSIBILITY|ADA)\b') THEN 'ADA' END AS clue, (SELECT bool_and(o.pos IN (SELECT index_position FROM i WHERE i.set_id = o.set_id)) FROM q o WHERE o.set_id = q.set_id) AS aligned FROM q),
  t AS (SELECT c.set_id, c.page_number, i.num, i.sheet_number AS shown, i.sheet_name AS nm, i.confidence AS cf, i.index_position AS ip FROM c JOIN i ON i.set_id = c.set_id AND {PRE('i.num')} = c.clue
      AND abs(i.index_position - c.page_number) <= 3 QUALIFY row_number() OVER (PARTITION BY c.set_id, c.page_number ORDER BY abs(i.index_position - c.page_number), i.index_position) = 1),
  j AS (SELECT c.*, t.num AS tn, t.shown AS ts, t.nm AS tm, t.cf AS tc, t.ip AS ti, l.num AS ln, l.sheet_number AS ls, l.sheet_name AS lm, l.confidence AS lc, l.index_position AS li,
      CASE WHEN t.num IS NULL AND regexp_matches(ctx, '\b(ACCESSIBILITY|ADA)\b') AND {PRE('a.num')} = 'AD' THEN NULL ELSE a.num END AS an, a.sheet_number AS as_, a.sheet_name AS am, a.confidence AS ac, a.index_position AS ai,
      EXISTS (SELECT 1 FROM i x WHERE x.set_id = c.set_id) AS indexed
    FROM c LEFT JOIN t USING (set_id, page_number) LEFT JOIN i a ON a.set_id = c.set_id AND a.index_position = c.pos LEFT JOIN i l ON l.set_id = c.set_id AND l.num = c.lab),
  k AS (SELECT *, CASE WHEN ln IS NOT NULL AND {LABELLED('ln')} AND {DRAWN('ln')} THEN 'l' WHEN tn IS NOT NULL THEN 't' WHEN an IS NULL OR (ln IS NULL AND lab <> '' AND label_confidence >= 90 AND NOT {LABELLED('an')}
      AND {PRE('lab')} <> '' AND {PRE('an')} <> '' AND {PRE('lab')} <> {PRE('an')}) THEN NULL ELSE 'a' END AS pick FROM j),
  w AS (SELECT *, CASE pick WHEN 'l' THEN ln WHEN 't' THEN tn WHEN 'a' THEN an END AS wn, CASE pick WHEN 'l' THEN ls WHEN 't' THEN ts WHEN 'a' THEN as_ END AS ws, CASE pick WHEN 'l' THEN lm WHEN 't' THEN tm WHEN 'a' THEN am END AS wm,
      CASE pick WHEN 'l' THEN lc WHEN 't' THEN tc WHEN 'a' THEN ac END AS wc, CASE pick WHEN 'l' THEN li WHEN 't' THEN ti WHEN 'a' THEN ai END AS wi, CASE WHEN inf THEN '' ELSE own END AS cur FROM k),
  s AS (SELECT *, CASE WHEN NOT indexed THEN NULL
      WHEN sec THEN CASE WHEN wn IS NOT NULL AND regexp_matches(upper(wm), '\bCOVER\s+SHEET\b') AND NOT upper(ws) LIKE 'CS-%' AND NOT regexp_full_match(upper(ws), 'C[- ]?0(\.0+)?') THEN 'cover' ELSE 'ignored' END
      WHEN wn IS NULL THEN 'none' WHEN NOT (needs_review OR cur = '' OR confidence < 60 OR (aligned AND cur <> wn)) THEN 'kept'
      WHEN cur <> '' THEN CASE WHEN tn IS NOT NULL THEN 'clue' ELSE 'position' END
      WHEN {LABELLED('wn')} THEN CASE WHEN {DRAWN('wn')} THEN 'label_visual' ELSE 'label_only' END
      WHEN (tn IS NOT NULL AND {DRAWN('wn')}) OR (wn = 'ADA' AND visual_present AND visual_confidence >= 70 AND page_number > 1 AND NOT is_cover AND cover_type = '') THEN 'clue_visual'
      WHEN aligned AND {DRAWN('wn')} AND pos = wi THEN 'position_visual' ELSE 'position_only' END AS step FROM w),
  f AS (SELECT *, CASE WHEN step IS NULL OR step IN ('ignored', 'kept') OR (step = 'none' AND NOT inf) THEN sheet_number WHEN step = 'none' THEN '' ELSE ws END AS fin,
      step IS NOT NULL AND step NOT IN ('ignored', 'kept', 'none') AS takes FROM s)
  SELECT set_id, page_number, fin AS sheet_number, CASE WHEN takes AND wm <> '' THEN wm WHEN step = 'none' AND inf THEN '' ELSE sheet_name END AS sheet_name,
    CASE WHEN takes THEN greatest(confidence, wc) WHEN step = 'none' AND inf THEN 0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN takes THEN false WHEN step = 'none' AND inf THEN true ELSE needs_review END AS needs_review,
    CASE step WHEN 'cover' THEN 'sheet_index_position' WHEN 'position' THEN 'sheet_index_position' WHEN 'position_only' THEN 'sheet_index_position' WHEN 'label_visual' THEN 'page_label_visual_match'
      WHEN 'label_only' THEN 'page_label_index_match' WHEN 'clue' THEN 'title_clue_visual_match' WHEN 'clue_visual' THEN 'title_clue_visual_match' WHEN 'position_visual' THEN 'sheet_index_visual_match' ELSE sheet_source END AS sheet_source,
    CASE WHEN step IN ('label_only', 'position_only') THEN fin END AS inferred_number, coalesce(step = 'ignored', false) AS ignored,
    CASE WHEN step IN ('label_only', 'position_only') THEN true WHEN step = 'none' THEN {NORM('fin')} = '' WHEN step IS NOT NULL THEN false END AS missing,
    CASE step WHEN 'cover' THEN 'Secondary cover matched a cover entry at the same sheet-index position.'
      WHEN 'ignored' THEN 'Secondary cover page is excluded from sheet-index sheet-number checks.' WHEN 'label_visual' THEN 'PDF page label matched the sheet index and visual sheet-number glyphs were detected in the title block.'
      WHEN 'label_only' THEN 'Sheet number was inferred from the PDF page label/index, but no physical title-block number was confirmed.'
     
      WHEN 'clue_visual' THEN 'Sheet number was matched from strong title text clues and nearby sheet-index entry with visual title-block glyphs.' WHEN 'position_visual' THEN 'Sheet number matched the same sheet-index position and visual sheet-number glyphs were detected in the title block.'
      WHEN 'position_only' THEN 'Sheet number was inferred from sheet-index position only.' WHEN 'clue' THEN 'Detected title-block context was reconciled to a nearby sheet-index entry using strong title text clues.'
     
      WHEN 'position' THEN 'Detected title-block number was reconciled to the sheet index position.' WHEN 'kept' THEN 'Physical title-block sheet number was detected with sufficient confidence.' WHEN 'none' THEN 'No matching sheet-index position was available for this page.' END AS reason,
    CASE WHEN step = 'kept' THEN ws WHEN step NOT IN ('none', 'ignored') AND an IS NOT NULL THEN as_ END AS position_number, CASE WHEN step <> 'ignored' THEN ls END AS label_entry,
    CASE WHEN step = 'ignored' THEN visual_present WHEN step IS NOT NULL THEN {DRAWN(NORM('fin'))} END AS drawn, CASE WHEN step IS NOT NULL THEN step <> 'ignored' AND {LABELLED(NORM('fin'))} END AS label_matches
  FROM f""")
def _(t):
    from recordqc.operators.identity import reconcile
    got = reconcile(t.identity_pages, t.identity_index)
    return got.select(*[c for c in got.columns if c != "decision"], C("decision.missing").alias("missing"), "decision.reason", "decision.evidence.position_number", "decision.evidence.label_entry",
                      "decision.evidence.drawn", "decision.evidence.label_matches")
