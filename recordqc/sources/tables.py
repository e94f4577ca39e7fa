"""The model tables, derived from the given parquet tables.

The SQL is written once, in the part of the language that Spark and DuckDB
share. ``@name`` stands for a given table or another model table. Spark reads
the parquet files directly; DuckDB gets the same text as a WITH chain.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"}

_FILE_COLS = """
  SELECT doc_id, lang, 'P' || (n_chars % 20) AS parent,
         CASE doc_id % 3 WHEN 0 THEN '2024.01.15' WHEN 1 THEN '1-15-2024' ELSE 'Copy of ' || lang END AS sec,
         'floor plan ' || (doc_id % 8) || ' r' || CAST(floor(doc_id / 840) AS BIGINT) AS base,
         CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' - Copy' WHEN 2 THEN '_v2' WHEN 3 THEN '_old'
                         WHEN 4 THEN ' (2)' WHEN 5 THEN '_backup' ELSE '_draft' END AS suffix,
         CASE doc_id % 5 WHEN 0 THEN 'dwg' WHEN 1 THEN 'dwg.bak' WHEN 2 THEN 'pdf' WHEN 3 THEN 'jpg' ELSE 'HEIC' END AS ext,
         n_chars - n_chars % 500 AS size, SHA256(text) AS hash,
         1704067200000 + ((doc_id * 7919) % 100000) * 1000 AS modified_ms
  FROM @documents"""

_SHEET = """CASE {n} % 12 WHEN 0 THEN CASE {n} WHEN 0 THEN 'CS' WHEN 12 THEN 'C0' ELSE 'CS-CIVIL' END WHEN 1 THEN CASE {n} WHEN 1 THEN 'ADA' ELSE 'ADA' || {n} END WHEN 2 THEN 'AD1.' || {n} WHEN 3 THEN 'A' || (100 + {n})
      WHEN 4 THEN 'S' || ({n} - 3) WHEN 5 THEN 'ED' || {n} WHEN 6 THEN 'PD' || {n} WHEN 7 THEN 'MD' || {n} WHEN 8 THEN 'E-' || {n} WHEN 9 THEN 'C-' || {n} || '.0' WHEN 10 THEN 'M' || {n} || '.1' ELSE 'FP' || {n} END"""

VIEWS: dict[str, str] = {
    # clones of two parents and of one folder give identical-folder groups
    "files": f"""
      SELECT doc_id + shift AS seq, 'Main/' || parent || '/' || sec || '/' || base || suffix || '.' || ext AS path,
             'Main/' || parent AS parent, size, modified_ms, hash
      FROM (
        SELECT doc_id, 0 AS shift, parent, sec, base, suffix, ext, size, modified_ms, hash FROM ({_FILE_COLS}) a
        UNION ALL
        SELECT doc_id, 1000000, parent || ' clone', sec, base, suffix, ext, size, modified_ms, hash
        FROM ({_FILE_COLS}) b WHERE parent IN ('P0', 'P1')
        UNION ALL
        SELECT doc_id, 2000000, parent, '2024.01.16', base, suffix, ext, size, modified_ms, hash
        FROM ({_FILE_COLS}) c WHERE sec = '2024.01.15' AND parent IN ('P3', 'P4')) u""",
    "files_all": """
      SELECT seq, path, parent, size, modified_ms, hash FROM @files
      UNION ALL
      SELECT 3000000 + n_nationkey, 'Main/P' || (n_nationkey % 20) || '/sys_' || n_nationkey || '/Thumbs.db',
             'Main/P' || (n_nationkey % 20), 4096, 1609459200000, 'sys' FROM @nation""",
    "folders_extra": """
      SELECT 'Main/P' || (n_nationkey % 20) || '/empty_' || n_nationkey AS path FROM @nation
      UNION ALL
      SELECT 'Main/P' || (n_nationkey % 20) || '/empty_' || n_nationkey || '/inner' FROM @nation WHERE n_nationkey % 4 = 0
      UNION ALL SELECT 'Main/Q' || r_regionkey FROM @region""",
    "files_prior": """
      SELECT path, size, CASE WHEN seq % 11 = 0 THEN modified_ms - 60000 ELSE modified_ms END AS modified_ms
      FROM @files WHERE seq % 13 <> 0
      UNION ALL SELECT path || '.gone', size, modified_ms FROM @files WHERE seq % 17 = 0""",
    "sheet_files": """
      SELECT o_orderkey AS seq, 'set' || (o_custkey % 50) AS root,
             CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'S' ELSE 'FP' END
               || (101 + o_custkey % 400) || CASE WHEN o_orderkey % 10 = 0 THEN '.1' ELSE '' END
               || CASE o_orderkey % 4 WHEN 0 THEN '_FLOOR-PLAN' WHEN 1 THEN ' site plan' WHEN 2 THEN '-hvac__duct' ELSE ' Details' END
               || '.pdf' AS filename,
             CAST(floor(o_totalprice * 100) AS BIGINT) AS size
      FROM @orders""",
    # one drawing set per order: positions only need to be ordered, not consecutive
    "sheet_index": """
      SELECT l_orderkey AS set_id,
             CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS index_position,
             CASE l_suppkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'a' WHEN 2 THEN 'G-' WHEN 3 THEN 'S ' ELSE 'M' END
               || (100 + l_partkey % 400) AS sheet_number,
             upper(p_name) AS sheet_name
      FROM @lineitem JOIN @part ON l_partkey = p_partkey""",
    "physical_sheets": """
      SELECT l_orderkey AS set_id,
             CAST(date_diff_days(l_shipdate) AS BIGINT) * 100000000000 + CAST(l_linenumber AS BIGINT) * 10000000000
               + l_partkey * 10000 + l_suppkey AS page_number,
             CASE WHEN l_partkey % 29 = 0 THEN '' WHEN l_partkey % 31 = 0 THEN 'X9' || (l_partkey % 100)
                  ELSE CASE l_suppkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'G' WHEN 3 THEN 'S' ELSE 'M' END
                    || (100 + l_partkey % 400) END AS sheet_number
      FROM @lineitem WHERE NOT (l_returnflag = 'R' AND l_partkey % 3 = 0)""",
    "sheet_pages": """
      SELECT source AS set_id, CAST(floor(doc_id / 20) AS BIGINT) + 1 AS page_number, doc_id,
             CASE WHEN doc_id % 40 < 20 THEN 'A' WHEN doc_id % 3 = 0 THEN 'G' ELSE 'S' END || (100 + doc_id % 90)
               || CASE WHEN doc_id % 7 = 0 THEN '.1' ELSE '' END AS sheet_number,
             CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'PROJECT 2024-' || (100 + doc_id % 900) || ' OWNER ' || upper(lang) || chr(10) || 'DRAWN BY X' END AS title_block_text,
             CASE WHEN doc_id % 9 = 0 OR doc_id % 5 = 0 THEN '' WHEN doc_id % 4 = 0 THEN 'ROOF PLAN' ELSE 'FLOOR PLAN ' || (doc_id % 30) END AS sheet_title,
             doc_id % 4 = 0 AS seal_present, doc_id % 8 = 0 AS graphic_present,
             CASE doc_id % 6
               WHEN 0 THEN '3 FLOOR PLAN 1/8" = 1''-0"' || chr(10) || 'A4 SECTION NTS' || chr(10) || 'SCALE' || chr(10) || '12/A101 REFER' || chr(10)
               WHEN 1 THEN '1' || chr(10) || '2' || chr(10) || '7 FLOOR PLAN NTS' || chr(10) || 'SHEET KEYNOTES' || chr(10) || '1. GYPSUM BOARD (TYP)' || chr(10) || '2) PAINT WALL' || chr(10)
                     || CASE WHEN doc_id % 4 = 1 THEN '3: GYPSUM  BOARD' ELSE '3: WALL BASE' END || chr(10) || 'GENERAL NOTES' || chr(10)
               WHEN 2 THEN 'SHEET INDEX' || chr(10) || 'A' || (100 + doc_id % 90) || ' FLOOR PLAN' || chr(10) || 'REVISION HISTORY' || chr(10)
               WHEN 3 THEN '100% PERMIT SET 01/15/2024 SIGNED AND SEALED' || chr(10) || 'PROJECT NAME' || chr(10) || 'DETAIL 4/S12' || chr(10)
               WHEN 4 THEN 'NOT FOR CONSTRUCTION' || chr(10) || 'accomodate seperation of waterproofng at enviroment' || chr(10) || 'TBD' || chr(10)
               ELSE 'COVER SHEET' || chr(10) || 'SHEET INDEX' || chr(10) || 'DESIGN CONSULTANT TEAM' || chr(10) || 'OWNER: ACME' || chr(10)
                     || CASE WHEN doc_id % 4 = 1 THEN 'NO SHEET KEYNOTES' ELSE 'VICINITY MAP' END || chr(10) END || text AS text
      FROM @documents""",
    # front matter in six forms before each text: a run before the heading, numbers behind it, entries on one line, none, too short a run, named covers
    "index_pages": """
      SELECT source AS set_id, CAST(floor(doc_id / 20) AS BIGINT) + 1 AS page_number, doc_id,
             CASE doc_id % 6
               WHEN 0 THEN 'PROJECT 12345-678' || chr(10) || 'A' || (100 + doc_id % 90) || chr(10) || 'a-' || (200 + doc_id % 50) || chr(10) || 'S ' || (100 + doc_id % 70) || chr(10)
                     || 'M101' || chr(10) || 'DRAWING  INDEX' || chr(10) || 'FLOOR PLAN' || chr(10) || 'E' || (doc_id % 9) || '.1' || chr(10) || 'POWER PLAN' || chr(10)
               WHEN 1 THEN 'G001' || chr(10) || 'COVER NOTES' || chr(10) || 'Index of Sheets' || chr(10) || 'G00' || (doc_id % 5) || chr(10) || 'COVER SHEET' || chr(10) || 'ADA' || chr(10)
                     || 'FP-' || (100 + doc_id % 30) || chr(10) || '  ' || chr(10) || 'SPRINKLER PLAN' || chr(10)
               WHEN 2 THEN 'see the sheet list' || chr(10) || 'A' || (100 + doc_id % 90) || '  floor plan level ' || (doc_id % 4) || chr(10) || 'A' || (300 + doc_id % 40) || '.2: SECTION' || chr(10)
                     || 'A7 100 Main Street' || chr(10) || 'ADA notes' || chr(10) || 'REVISION HISTORY' || chr(10)
               WHEN 3 THEN 'A900' || chr(10) || 'LEGEND' || chr(10)
               WHEN 4 THEN 'A1' || chr(10) || 'A2' || chr(10) || 'SHEET INDEX  P' || (doc_id % 60) || ' PLUMBING' || chr(10) || 'A3 01/02/2024' || chr(10)
               ELSE 'SHEET' || chr(10) || 'INDEX' || chr(10) || 'CS- NORTH' || (doc_id % 3) || ' COVER SHEET' || chr(10) || 'ADA' || chr(10) || 'CS' || chr(10) || 'cover  sheet' || chr(10) END || text AS text
      FROM @documents""",
    # views in twelve forms before each text: scale before, behind, on the line, absent; references, notes, index rows, schedules, site and roof plans
    "view_pages": """
      SELECT source AS set_id, CAST(floor(doc_id / 20) AS BIGINT) + 1 AS page_number, doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'A' || (100 + doc_id % 90) END AS sheet_number,
             CASE WHEN doc_id % 23 = 0 THEN 'COVER SHEET' WHEN doc_id % 12 = 8 THEN 'DOOR DETAILS' ELSE 'PLANS' END AS sheet_title, doc_id % 19 = 0 AS is_cover, doc_id % 24 = 5 AS scale_mark,
             CASE doc_id % 12
               WHEN 0 THEN '1/8" = 1''-0"' || chr(10) || (1 + doc_id % 9) || chr(10) || 'FLOOR PLAN' || chr(10) || '4' || chr(10) || 'ENLARGED  FLOOR PLAN N.T.S.' || chr(10)
               WHEN 1 THEN (1 + doc_id % 9) || chr(10) || 'BUILDING SECTION' || chr(10) || 'ROOF ASSEMBLY' || chr(10) || chr(10) || '2 wall section' || chr(10) || 'x' || chr(10) || '3/4” = 1’-0”' || chr(10)
               WHEN 2 THEN 'REFER TO FLOOR PLAN 3' || chr(10) || 'ref: ROOF PLAN 2' || chr(10) || 'KEYNOTES 5 ROOF PLAN' || chr(10) || '6 SITE PLAN FOR LOCATION' || chr(10) || '7 POWER PLAN' || chr(10)
               WHEN 3 THEN 'LIST OF SHEETS' || chr(10) || 'A101' || chr(10) || '3 FLOOR PLAN' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || '9 RCP' || chr(10)
               WHEN 4 THEN 'A' || (100 + doc_id % 90) || ' SITE PLAN' || chr(10) || '12B SITE PLAN no scale' || chr(10) || '5 DOOR JAMB DETAIL 6 WALL DETAIL 1" = 20''' || chr(10)
               WHEN 5 THEN '1 SITE PLAN' || chr(10) || 'GRAPHIC' || chr(10)
               WHEN 6 THEN 'DOOR SCHEDULE' || chr(10) || '1 FLOOR PLAN' || chr(10)
               WHEN 7 THEN 'ROOF PLAN 8' || chr(10) || '9 ROOF PLAN SEE LEGEND' || chr(10) || '10 TRIM SEE DETAIL' || chr(10) || 'PERSPECTIVE' || chr(10) || 'q' || chr(10) || '2.1' || chr(10)
               WHEN 8 THEN 'WINDOW SILL DETAIL AS SCHEDULED 1 WALL SECTION' || chr(10)
               WHEN 9 THEN '3 FLOOR PLAN' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || 'e' || chr(10) || 'f' || chr(10) || '3 FLOOR PLAN' || chr(10) || '1/4" = 1''-0"' || chr(10)
               WHEN 10 THEN 'FLOOR PLAN' || chr(10) || '1/4" = 1''-0" 7' || chr(10) || 'f1' || chr(10) || 'interior elevation' || chr(10)
               ELSE '' END || text AS text
      FROM @documents""",
    # sets of 30 pages whose marks agree, disagree or are absent in many ways; every third set has a short index, every seventh none
    "identity_index": f"""
      SELECT 'S' || CAST(floor(doc_id / 30) AS BIGINT) AS set_id, doc_id % 30 + 1 AS index_position, {_SHEET.format(n="(doc_id % 30)")} AS sheet_number,
             CASE WHEN doc_id % 12 = 0 OR doc_id % 30 = 17 THEN 'COVER SHEET' WHEN doc_id % 30 = 20 THEN '' ELSE 'PLAN ' || (doc_id % 30) END AS sheet_name, CAST(60 + doc_id % 3 * 10 AS BIGINT) AS confidence
      FROM @documents WHERE CAST(floor(doc_id / 30) AS BIGINT) % 7 <> 6 AND NOT (CAST(floor(doc_id / 30) AS BIGINT) % 3 = 0 AND doc_id % 30 > 22)""",
    "identity_pages": f"""
      SELECT 'S' || CAST(floor(doc_id / 30) AS BIGINT) AS set_id, doc_id % 30 + 1 AS page_number,
             CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN {_SHEET.format(n="(doc_id % 30)")} WHEN 2 THEN lower({_SHEET.format(n="(doc_id % 30)")}) WHEN 3 THEN {_SHEET.format(n="((doc_id + 1) % 30)")} WHEN 4 THEN 'B-1' WHEN 5 THEN '' ELSE 'X9' END AS sheet_number,
             CASE WHEN doc_id % 13 = 0 THEN 'ADA' ELSE 'OLD NAME' END AS sheet_name, CAST(doc_id % 4 * 30 AS DOUBLE) AS confidence, doc_id % 11 = 0 AS needs_review,
             CASE doc_id % 17 WHEN 0 THEN 'sheet_index_position' WHEN 1 THEN 'manual' ELSE '' END AS sheet_source, CASE WHEN doc_id % 30 = 0 THEN 'primary' WHEN doc_id % 19 = 9 THEN 'secondary' ELSE '' END AS cover_type,
             doc_id % 30 = 0 AS is_cover, CASE doc_id % 5 WHEN 0 THEN {_SHEET.format(n="(doc_id % 30)")} WHEN 1 THEN {_SHEET.format(n="((doc_id + 1) % 30)")} WHEN 2 THEN 'SI' ELSE '' END AS label_number,
             CASE doc_id % 3 WHEN 0 THEN 'CS CIVIL' ELSE 'Structural general notes' END AS label_text, CAST(CASE doc_id % 2 WHEN 0 THEN 97 ELSE 50 END AS DOUBLE) AS label_confidence,
             doc_id % 9 = 0 AS visual_present, CAST(60 + doc_id % 5 * 10 AS DOUBLE) AS visual_confidence, doc_id * 37 % 4000 AS dark_pixels, doc_id * 53 % 6000 AS ink_pixels,
             CASE doc_id % 8 WHEN 0 THEN 'ELECTRICAL  DEMOLITION PLAN' WHEN 1 THEN 'demo plan plumbing' WHEN 2 THEN 'Accessibility notes' WHEN 3 THEN 'MECHANICAL DEMOLITION' WHEN 4 THEN 'ARCHITECTURAL DEMO' ELSE 'PLAN' END AS title_block_text, text
      FROM @documents""",
    "page_index": """
      SELECT source AS set_id, doc_id AS index_position, CASE WHEN doc_id % 8 < 5 THEN 'A' || (100 + doc_id % 90) ELSE 'CV-' || (doc_id % 50) END AS sheet_number,
             CASE WHEN doc_id % 8 > 4 OR doc_id % 11 = 0 THEN 'Cover  sheet ' || (doc_id % 3) ELSE 'FLOOR PLAN' END AS sheet_name
      FROM @documents""",
    "projects": """
      SELECT o_orderkey AS project_id, o_orderkey AS seq,
             CAST(year(o_orderdate) AS BIGINT) || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR(4)), 4, '0') AS project_number,
             'Project ' || (o_orderkey % 700) AS project_name, c_mktsegment AS building_type,
             CASE o_custkey % 9 WHEN 0 THEN 'ACME MEP' WHEN 1 THEN 'acme  mep' WHEN 2 THEN 'Acme Mep ' WHEN 3 THEN 'Delta Engineers' WHEN 4 THEN 'DELTA ENGINEERS'
               WHEN 5 THEN 'Hvac Partners LLC' WHEN 6 THEN 'Unknown' WHEN 7 THEN '' ELSE 'North Group' END AS consultant,
             CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10) AS DOUBLE) END AS square_feet,
             o_orderstatus = 'P' AND o_orderkey % 5 = 0 AS excluded, o_orderkey % 13 = 0 AS review_required,
             CASE WHEN o_orderkey % 4 = 0 THEN 'tonnage by others' WHEN o_orderkey % 4 = 1 THEN 'custom unit' ELSE '' END AS note,
             CASE o_custkey % 6 WHEN 0 THEN '480V 3-phase' WHEN 1 THEN 'Unknown' WHEN 2 THEN '208V' WHEN 3 THEN NULL ELSE '' END AS service_info
      FROM @orders JOIN @customer ON o_custkey = c_custkey""",
    "units": """
      SELECT l_orderkey AS project_id, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq,
             CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity / 2 END AS tonnage, 1 + l_linenumber % 3 AS quantity, p_type AS type,
             CASE WHEN l_partkey % 19 = 0 THEN '' ELSE p_brand END AS manufacturer, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'M' || l_suppkey END AS model,
             CAST(floor(l_extendedprice / 100) AS DOUBLE) AS duct_feet, CASE l_suppkey % 10 WHEN 0 THEN 'custom' ELSE 'standard' END AS classification
      FROM @lineitem JOIN @part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'""",
    "panels": """
      SELECT l_orderkey AS project_id, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq,
             'P' || l_linenumber AS name, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity * 10 END AS amps,
             CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(floor(l_extendedprice / 1000) AS DOUBLE) END AS load_kva,
             CASE WHEN l_partkey % 4 = 0 THEN 'D' || (l_suppkey % 30) ELSE '' END AS disconnect_name,
             CASE WHEN l_partkey % 4 = 0 THEN l_quantity * 8 END AS disconnect_amps, 1 + l_linenumber % 2 AS quantity
      FROM @lineitem WHERE l_returnflag = 'N'""",
    "stated_totals": """
      SELECT project_id, 'tonnage' AS metric, seq, tons * CASE WHEN project_id % 7 = 0 THEN 1.2 ELSE 1.0 END AS stated
      FROM (SELECT project_id, min(seq) AS seq, sum(tonnage * quantity) AS tons FROM @units GROUP BY project_id) q WHERE project_id % 3 <> 0
      UNION ALL SELECT project_id, 'tonnage', seq + 1, tons + 5.0
      FROM (SELECT project_id, min(seq) AS seq, sum(tonnage * quantity) AS tons FROM @units GROUP BY project_id) r WHERE project_id % 19 = 1""",
    "requests": """
      SELECT CAST(r * 100 + ascii(segment) AS BIGINT) AS request_id, 5000.0 + 7000.0 * r + 90.0 * ascii(segment) AS square_feet, segment AS building_type,
             CASE r WHEN 0 THEN 'acme mep' WHEN 1 THEN 'Delta Engineers' WHEN 2 THEN 'Nobody' WHEN 3 THEN 'Hvac Partners LLC' ELSE '' END AS consultant,
             CASE ascii(segment) % 3 WHEN 0 THEN 'Mechanical' WHEN 1 THEN 'Electrical' ELSE 'Mechanical + Electrical' END AS scope
      FROM (SELECT c_mktsegment AS segment, EXPLODE(SEQUENCE(0, 4)) AS r FROM (SELECT DISTINCT c_mktsegment FROM @customer) d) s""",
    # spreadsheet-like cells whose numbers come from the order lines
    "cells": """
      SELECT 'W' || (l_orderkey % 50) AS workbook, l_orderkey AS project_id, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS row,
        CASE (l_partkey + l_linenumber) % 16
          WHEN 0 THEN CAST(1 + l_partkey % 90 AS VARCHAR(9)) || ',' || lpad(CAST(l_suppkey % 1000 AS VARCHAR(9)), 3, '0') || ' SF'
          WHEN 1 THEN 'SUITE 280: 2,' || lpad(CAST(l_partkey % 1000 AS VARCHAR(9)), 3, '0') || ' sq. ft.' WHEN 2 THEN (1000 + l_partkey) || ' : ' || (l_suppkey % 40) || '.5 : ' || (l_partkey % 900)
          WHEN 3 THEN 'RTU-' || (l_suppkey % 9) WHEN 4 THEN 'AHU ' || l_linenumber WHEN 5 THEN 'n/a' WHEN 6 THEN 'Total tonnage' WHEN 7 THEN '20' || (10 + l_partkey % 15) || ' - 0' || (100 + l_suppkey % 900) || 'b'
          WHEN 8 THEN 'Trane' WHEN 9 THEN (1 + l_linenumber) || ' existing RTU units, no mechanical CD' WHEN 10 THEN 'Mini-split by VAV' WHEN 11 THEN 'Phase ' || (1 + l_suppkey % 3)
          WHEN 12 THEN 'Riverside ' || lower(p_name) || ' medical office' WHEN 13 THEN '-' || (l_partkey % 70) || '.25 tons' WHEN 14 THEN 'County ' || lower(p_name) || ' storage' ELSE 'partial equipment schedule' END AS cell
      FROM @lineitem JOIN @part ON l_partkey = p_partkey""",
    "headers": """
      SELECT l_orderkey AS workbook, 'S' AS sheet, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS pos,
        CASE (l_partkey + l_linenumber) % 15 WHEN 0 THEN 'Project Number' WHEN 1 THEN 'Project  Name' WHEN 2 THEN 'MEP Consultant' WHEN 3 THEN 'Overall SF' WHEN 4 THEN 'Total Tonnage' WHEN 5 THEN 'Unit Tag'
          WHEN 6 THEN 'Tons' WHEN 7 THEN 'System Type' WHEN 8 THEN 'Qty' WHEN 9 THEN 'Mfr' WHEN 10 THEN 'Model No.' WHEN 11 THEN 'Duct Linear Ft' WHEN 12 THEN 'Remarks' WHEN 13 THEN 'Tonnage (each)' ELSE 'Linear Feet Total' END AS name
      FROM @lineitem""",
    "issue_log": """
      SELECT event_id AS seq, user_id AS project_id,
             CASE event_type WHEN 'click' THEN 'Mechanical' WHEN 'view' THEN 'Electrical' ELSE 'General' END AS discipline,
             CASE event_type WHEN 'error' THEN 'Equipment values incomplete' ELSE 'Conflicting values' END AS category,
             'Check value ' || (event_id % 7) || ' of the ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' schedule again' ELSE ' schedule' END AS message,
             CASE event_type WHEN 'error' THEN 'Blocking' WHEN 'click' THEN 'Warning' ELSE 'Note' END AS severity,
             CASE WHEN event_id % 4 = 0 THEN 'Resolved' ELSE 'Unresolved' END AS status, event_id % 2 = 0 AS auto, value
      FROM @events""",
}


def _dialect(sql: str, spark_dir: str | None) -> str:
    if spark_dir is not None:
        sql = sql.replace("EXPLODE(SEQUENCE(0, 4))", "explode(sequence(0, 4))")
        sql = re.sub(r"SHA256\(([^()]+)\)", r"sha2(\1, 256)", sql)
        return re.sub(r"date_diff_days\((\w+)\)", r"datediff(\1, DATE'1992-01-01')", sql)
    sql = sql.replace("EXPLODE(SEQUENCE(0, 4))", "unnest(range(0, 5))")
    return re.sub(r"date_diff_days\((\w+)\)", r"date_diff('day', DATE '1992-01-01', CAST(\1 AS DATE))", sql)


def _needs(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"@(\w+)", sql):
        if name in VIEWS and name not in seen:
            _needs(VIEWS[name], seen)
            seen.append(name)
        elif name not in VIEWS and name not in BASE:
            raise KeyError(name)
    return seen


def render(sql: str, spark_dir: str | None = None) -> str:
    """Expand ``@name`` and put the model tables in front as a WITH chain."""
    def ref(match: re.Match) -> str:
        name = match.group(1)
        return f"parquet.`{spark_dir}/{name}.parquet`" if name in BASE and spark_dir is not None else name

    chain = ",\n".join(f"{n} AS ({re.sub(r'@(\w+)', ref, VIEWS[n])})" for n in _needs(sql, []))
    body = re.sub(r"@(\w+)", ref, sql)
    text = f"WITH {chain}\nSELECT * FROM (\n{body}\n) result_rows" if chain else body
    return _dialect(text, spark_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a model table as a lazy DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "files":
        return _files(spark, sf_dir)
    if name in DERIVED:
        return DERIVED[name](spark, sf_dir)
    df = spark.sql(render(f"SELECT * FROM @{name}", sf_dir))
    return spread(df) if name in WIDE else df


# text tables, on which the pattern work dwarfs a shuffle
WIDE = {"sheet_pages"}


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that arrives as too few splits.

    A large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the same rows as the SQL text, with one scan of the text column instead of three
    one = spark.sql(render(_FILE_COLS, sf_dir))
    copy = lambda cond, shift, parent, sec: F.when(cond, F.struct(F.lit(shift).alias("shift"), parent.alias("p"), sec.alias("s")))
    p, s = F.col("parent"), F.col("sec")
    copies = F.filter(F.array(
        copy(F.lit(True), 0, p, s),
        copy(p.isin("P0", "P1"), 1000000, F.concat(p, F.lit(" clone")), s),
        copy(p.isin("P3", "P4") & (s == "2024.01.15"), 2000000, p, F.lit("2024.01.16"))), lambda c: c.isNotNull())
    return one.withColumn("c", F.explode(copies)).select(
        (F.col("doc_id") + F.col("c.shift")).alias("seq"),
        F.concat(F.lit("Main/"), F.col("c.p"), F.lit("/"), F.col("c.s"), F.lit("/"), "base", "suffix", F.lit("."), "ext").alias("path"),
        F.concat(F.lit("Main/"), F.col("c.p")).alias("parent"), "size", "modified_ms", "hash")


def _files_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    parent = F.concat(F.lit("Main/P"), (n % 20).cast("string"))
    system = table(spark, sf_dir, "nation").select(
        (n + 3000000).cast("bigint").alias("seq"),
        F.concat(parent, F.lit("/sys_"), n.cast("string"), F.lit("/Thumbs.db")).alias("path"),
        parent.alias("parent"), F.lit(4096).cast("bigint").alias("size"),
        F.lit(1609459200000).alias("modified_ms"), F.lit("sys").alias("hash"))
    return _files(spark, sf_dir).unionByName(system)


def _files_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    kept = f.where("seq % 13 <> 0").select(
        "path", "size", F.when(F.col("seq") % 11 == 0, F.col("modified_ms") - 60000).otherwise(F.col("modified_ms")).alias("modified_ms"))
    gone = f.where("seq % 17 = 0").select(F.concat("path", F.lit(".gone")).alias("path"), "size", "modified_ms")
    return kept.unionByName(gone)


DERIVED = {"files_all": _files_all, "files_prior": _files_prior}
