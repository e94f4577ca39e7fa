"""Header detection and cell values on hand-made sheets."""

import pytest
from pyspark.sql import functions as F

from recordqc.functions import cells as X
from recordqc.operators import cells as K


def test_header_block_of_two_rows(spark):
    rows = [["Mechanical survey", None, None, None], ["Job", "Job", "Unit", "Duct"], ["No", "Name", "Tag", "Ft"], ["2024-0012", "Clinic", "RTU-1", "5"]]
    df = spark.createDataFrame([("w", "s", n, r) for n, r in enumerate(rows)], "workbook string, sheet string, row int, cells array<string>")
    r = K.detect_header(df).first()
    assert (r.start, r.height) == (1, 2)


def test_total_and_unit_columns_share_no_header(spark):
    df = spark.createDataFrame([("w", "s", 1, "Total Tonnage"), ("v", "s", 1, "Tonnage (each)")], "workbook string, sheet string, pos int, name string")
    got = {(r.workbook, r.field) for r in K.suggest_mapping(df, ["workbook", "sheet"]).collect()}
    assert ("w", "projectTonnage") in got and ("w", "tonnage") not in got
    assert ("v", "tonnage") in got and ("v", "projectTonnage") not in got


@pytest.mark.parametrize("cell,number,area", [("1,250.5 tons", 1250.5, 1250.5), ("SUITE 280: 2,008 SF", 280.0, 2008.0), ("TBD", None, None), ("-", None, None), ("-3", -3.0, -3.0)])
def test_numbers(spark, cell, number, area):
    r = spark.range(1).select(X.number(F.lit(cell)).alias("n"), X.square_feet(F.lit(cell)).alias("a")).first()
    assert (r.n, r.a) == (number, area)
