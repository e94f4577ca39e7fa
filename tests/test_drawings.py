"""Sheet indexes, views without scales and sheet identities on small hand-made pages."""

import pytest
from pyspark.sql import functions as F

from recordqc.operators import drawings as O

PAGE = "set_id string, page_number bigint, doc_id bigint, text string"


def numbers(spark, *texts):
    pages = spark.createDataFrame([("s", n, n, t) for n, t in enumerate(texts, 1)], PAGE)
    return [(r.sheet_number, r.sheet_name) for r in O.index_entries(pages).orderBy("index_position").collect()]


COLUMN = ["CS", "ADA1", "AD1.0", "A1.01", "M1.1", "E1.1", "P3.1"]


@pytest.mark.parametrize("text,found", [
    ("SHEET INDEX\nCS-CIVIL    COVER SHEET", [("CS-CIVIL", "COVER SHEET")]),
    ("SHEET INDEX\nGENERAL\nCS1\nCOVER SHEET", [("CS1", "COVER SHEET")]),
    ("SHEET INDEX\nADA STANDARDS & GENERAL NOTES\nCS\nG1.01\nADA\nAD1.01", [("CS", ""), ("G1.01", ""), ("ADA", ""), ("AD1.01", "")]),
    ("\n".join(COLUMN + ["N.T.S.", "VICINITY MAP", "SHEET INDEX", "COVER SHEET", "FIRE PROTECTION PLAN", "FP1.1"]), [(n, "") for n in COLUMN + ["FP1.1"]]),
    ("A9\nA8\nx\nSHEET INDEX\nG1\nG2\nG1", [("G1", ""), ("G2", "")]),
    ("Drawing List\nSHEET LIST: A101 Floor Plan\nA102 - 1200 Main Street\nA103 12345", [("A101", "SHEET LIST:  FLOOR PLAN"), ("A102", ""), ("A103", "")]),
    ("\n".join(["SHEET INDEX", "CS"] + [f"DETAILS {i}" for i in range(70)] + ["PP01", "FP1.01"]), [("CS", ""), ("PP01", ""), ("FP1.01", "")]),
    ("SHEET\nINDEX\nA1 ROOF PLAN", [("A1", "ROOF PLAN")]), ("NO HEADING\nA1", []), ("", [])])
def test_index_entries(spark, text, found):
    assert numbers(spark, text) == found


def test_index_pages_and_order(spark):
    late = ["x"] * 6 + ["SHEET INDEX\nA1", "SHEET INDEX\nA2\nA1", "SHEET INDEX\nA3", "SHEET INDEX\nA4"]
    assert [n for n, _ in numbers(spark, *late)] == ["A1", "A2", "A3"]
    assert [n for n, _ in numbers(spark, "x", "SHEET INDEX\nA7", *late)] == ["A7"]
    pages = spark.createDataFrame([("s", 1, 1, "SHEET INDEX\nA1"), ("t", 1, 2, "SHEET INDEX"), ("u", 1, 3, None)], PAGE)
    got = {r.set_id: (r.source_pages, r.entries, r.confidence, r.needs_review) for r in O.index_summary(pages, O.index_entries(pages)).collect()}
    assert got == {"s": (1, 1, 90, False), "t": (1, 0, 0, True), "u": (0, 0, 0, True)}


def views(spark, text, sheet="A101", title="", mark=False, cover=False):
    pages = spark.createDataFrame([("s", 10, 1, text, sheet, title, mark, cover)], PAGE + ", sheet_number string, sheet_title string, scale_mark boolean, is_cover boolean")
    return sorted((r.detail_number, r.view_label, r.scale, r.status) for r in O.missing_scales(pages).collect())


@pytest.mark.parametrize("text,found", [
    ("1/8\" = 1'-0\"\n1\nFLOOR PLAN", [("1", "FLOOR PLAN", "1/8\" = 1'-0\"", "Pass")]),
    ("1″ = 20′-0″\n1\nSITE PLAN EXISTING DEMO", [("1", "SITE PLAN", "1\" = 20'-0\"", "Pass")]),
    ("SCALE: 1\" = 10'\n02\nSITE PLAN", [("02", "SITE PLAN", "1\" = 10'", "Pass")]),
    ("FOUNDATION PLAN 1\n1/4\" = 1'-0\"", [("1", "FOUNDATION PLAN", "1/4\" = 1'-0\"", "Pass")]),
    ("FOUNDATION PLAN\n1/4\"\n= 1'-0\"\n1", [("1", "FOUNDATION PLAN", "1/4\" = 1'-0\"", "Pass")]),
    ("5 WALL DETAIL N.T.S.", [("5", "WALL DETAIL", "NTS", "Pass")]),
    ("1\nTYPICAL MOUNTING HEIGHT DETAIL\nNOT TO SCALE", [("1", "TYPICAL MOUNTING HEIGHT DETAIL", "NTS", "Pass")]),
    ("03\nNO SCALE\nDIMMING WALL STATION SCHEMATIC DETAIL", [("03", "DIMMING WALL STATION SCHEMATIC DETAIL", "NTS", "Pass")]),
    ("3\nBUILDING SECTION\nROOF ASSEMBLY", [("3", "BUILDING SECTION", "", "Warning")]),
    ("Building section requirements shall comply with the code.", []),
    ("M10001\n*NOT TO SCALE\nTYPICAL MEP INSTALLATION\nRE: FLOOR PLAN FOR SIZES\n7\n8\n9\n2. REFER TO MECHANICAL FLOOR PLAN FOR NECK SIZES.", []),
    ("SHEET KEYNOTES\n31.\n4\" WIDE PAINTED STRIPES (REF. NOTES\nON SITE PLAN FOR COLOR TYP.)\n3/4\" = 1'-0\"\n1\nPARKING SIGN DETAIL\n", [("1", "PARKING SIGN DETAIL", "3/4\" = 1'-0\"", "Pass")]),
    ("8\nSHAPED PLATE SEE DETAIL\n1 1/2\" = 1'-0\"\n2\nGATE LATCH DETAILS", []),
    ("10.\nTPO ROOFING, RE. ROOF PLAN", []), ("DOOR SCHEDULE\n1 FLOOR PLAN", []), ("SHEET INDEX\n1 FLOOR PLAN", []), ("A101 FLOOR PLAN", []),
    ("3 FLOOR PLAN\na\nb\nc\nd\ne\nf\n3 FLOOR PLAN NTS", [("3", "FLOOR PLAN", "NTS", "Pass")]), ("", []), (None, [])])
def test_missing_scales(spark, text, found):
    assert views(spark, text) == found


def test_missing_scales_by_page(spark):
    assert views(spark, "02\nSITE PLAN", mark=True) == [("02", "SITE PLAN", "Visual scale marker", "Pass")]
    assert views(spark, "1 FLOOR PLAN", cover=True) == views(spark, "1 FLOOR PLAN", title="COVER SHEET") == []
    assert views(spark, "DOOR HEAD DETAIL AS SCHEDULED\n1 WALL SECTION", title="DOOR DETAILS") == []


FIELDS = {"page_number": 1, "sheet_number": "", "sheet_name": "", "title_block_text": "", "text": "", "confidence": 0.0, "needs_review": True, "sheet_source": "", "cover_type": "", "is_cover": False,
          "label_number": "", "label_text": "", "label_confidence": 0.0, "visual_present": False, "visual_confidence": 0.0, "dark_pixels": 0, "ink_pixels": 0}
KINDS = {int: "bigint", str: "string", float: "double", bool: "boolean"}
LABEL = {"label_confidence": 97.0}


def decide(spark, index, *pages, firms=()):
    from recordqc.operators.identity import reconcile
    schema = "set_id string, " + ", ".join(f"{k} {KINDS[type(v)]}" for k, v in FIELDS.items())
    p = spark.createDataFrame([("s", *{**FIELDS, **x}.values()) for x in pages], schema)
    i = spark.createDataFrame([("s", n, num, name, 80) for n, num, name in index], "set_id string, index_position bigint, sheet_number string, sheet_name string, confidence bigint")
    return reconcile(p, i, firms).orderBy("page_number").collect()


@pytest.mark.parametrize("index,page,number,source,missing", [
    ([(17, "C-7.0", "DETAILS")], {"page_number": 17}, "C-7.0", "sheet_index_position", True),
    ([(17, "C-7.0", "DETAILS")], {"page_number": 17, "label_number": "C-7.0", **LABEL}, "C-7.0", "page_label_index_match", True),
    ([(17, "S1.1", "DETAILS")], {"page_number": 17, "label_number": "S-1.1", **LABEL, "visual_present": True, "visual_confidence": 82.0}, "S1.1", "page_label_visual_match", False),
    ([(10, "C1.0", "NOTES")], {"page_number": 10, "label_number": "C-1.0", **LABEL, "dark_pixels": 4278, "ink_pixels": 14626}, "C1.0", "page_label_visual_match", False),
    ([(25, "S1", "NOTES")], {"page_number": 25, "label_number": "S1", **LABEL, "dark_pixels": 2043, "ink_pixels": 2251}, "S1", "page_label_visual_match", False),
    ([(34, "M4.1", "M"), (35, "E1.1", "E")], {"page_number": 34, "label_number": "E1.1", **LABEL, "dark_pixels": 1810, "ink_pixels": 2859}, "E1.1", "page_label_visual_match", False),
    ([(4, "ADA3", "A")], {"page_number": 4, "label_number": "ADA3", **LABEL, "dark_pixels": 1908, "ink_pixels": 4837}, "ADA3", "page_label_index_match", True),
    ([(3, "AD1.0", "D")], {"page_number": 3, "title_block_text": "ADA STANDARDS"}, "", "", True),
    ([(3, "AD1.0", "D"), (5, "ADA2", "A")], {"page_number": 3, "title_block_text": "ADA STANDARDS", "visual_present": True, "visual_confidence": 90.0}, "ADA2", "title_clue_visual_match", False),
    ([(3, "A1", "D"), (7, "ED1", "X")], {"page_number": 3, "title_block_text": "Electrical demo"}, "A1", "sheet_index_position", True),
    ([(3, "A1", "D"), (6, "ED1", "X")], {"page_number": 3, "title_block_text": "Electrical demo", "sheet_number": "A1", "confidence": 90.0, "needs_review": False}, "ED1", "title_clue_visual_match", False),
    ([(2, "A2", "PLAN")], {"page_number": 2, "sheet_number": "A2", "confidence": 90.0, "needs_review": False, "sheet_source": "manual"}, "A2", "manual", False),
    ([(2, "A2", "PLAN")], {"page_number": 2, "sheet_number": "A9", "confidence": 90.0, "needs_review": False}, "A2", "sheet_index_position", False),
    ([(3, "E3", "PLAN")], {"page_number": 3, "label_number": "M1", **LABEL}, "", "", True),
    ([(3, "E3", "PLAN")], {"page_number": 3, "dark_pixels": 850, "ink_pixels": 1200}, "E3", "sheet_index_visual_match", False),
    ([(2, "S1", "N")], {"page_number": 2, "label_number": "SI", **LABEL, "text": "general notes, structural"}, "S1", "page_label_index_match", True),
    ([(9, "A1", "N")], {"page_number": 2, "sheet_number": "A7", "sheet_source": "sheet_index_position", "confidence": 80.0, "needs_review": False}, "", "sheet_index_position", True)])
def test_identity(spark, index, page, number, source, missing):
    got, = decide(spark, index, page)
    assert got.sheet_number == number and got.sheet_source == source and got.decision.missing == missing


def test_identity_of_covers_and_positions(spark):
    index = [(1, "CS", "COVER SHEET"), (2, "A1", "PLAN"), (3, "A2", "PLAN")]
    got = decide(spark, index, {"page_number": 1, "sheet_number": "CS", "cover_type": "primary", "confidence": 90.0, "needs_review": False}, {"page_number": 2, "cover_type": "secondary"},
                 {"page_number": 3, "sheet_number": "A1", "confidence": 90.0, "needs_review": False}, {"page_number": 4})
    assert [(r.sheet_number, r.ignored, r.decision.source) for r in got] == [("CS", False, "title_block"), ("", True, "ignored_secondary_cover"), ("A1", False, "title_block"), ("A2", False, "sheet_index_position")]
    named, = decide(spark, [(2, "G2", "CIVIL COVER SHEET")], {"page_number": 2, "cover_type": "secondary"})
    assert (named.sheet_number, named.ignored, named.decision.source) == ("G2", False, "sheet_index_position")
    bare, = decide(spark, [(2, "C-0", "COVER SHEET")], {"page_number": 2, "cover_type": "secondary"})
    assert bare.ignored
    firm, = decide(spark, [(2, "S1", "N")], {"page_number": 2, "label_number": "SI", "text": "GENERAL NOTES by Some Engineers"}, firms=(r"SOME\s+ENGINEERS",))
    assert firm.decision.evidence.label_matches


def test_identity_without_index(spark):
    from recordqc.operators.identity import reconcile
    page, = decide(spark, [(1, "", "")], {"sheet_number": "A1"})
    assert (page.sheet_number, page.decision, page.ignored) == ("A1", None, False)
    nulls = spark.createDataFrame([("s", 1, *[None] * 15, None)], "set_id string, page_number bigint, " + ", ".join(f"{k} {KINDS[type(v)]}" for k, v in FIELDS.items() if k != "page_number"))
    index = spark.createDataFrame([("s", 1, "A1", None, None)], "set_id string, index_position bigint, sheet_number string, sheet_name string, confidence bigint")
    row, = reconcile(nulls, index).collect()
    assert (row.sheet_number, row.sheet_name, row.sheet_source, row.decision.missing) == ("A1", "", "sheet_index_position", True)
    assert reconcile(nulls.limit(0), index).count() == 0
