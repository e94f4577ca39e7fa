"""Interpretation of spreadsheet cells: values, roles, phases and field choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordqc.functions import cells as X
from recordqc.functions.projects import normalize_project_number
from recordqc.operators.scale import first_per, join_back, running

C = F.col


def enrich_cells(cells: DataFrame) -> DataFrame:
    """Numbers, areas, ratios, project numbers, equipment and building types of every cell."""
    c = C("cell")
    num = normalize_project_number(c)
    return cells.withColumns({
        "value": X.number(c), "square_feet": X.square_feet(c), "ratio_sf": X.ratio_part(c, 1), "ratio_tons": X.ratio_part(c, 2), "ratio_duct": X.ratio_part(c, 3),
        "project_number": F.when(num.rlike(r"^\d{4}-\d{2,4}[A-Za-z]?$"), num), "equipment_code": X.equipment(c, 0), "equipment_type": X.equipment(c, 1),
        "building_type": X.building_type(c), "is_total": X.is_total(c), "is_tag": X.is_tag(c), "is_name": X.is_strong_name(c)})


def cell_roles(cells: DataFrame) -> DataFrame:
    """Row role of a cell: total, ratio, number, equipment, area, note or name."""
    e = enrich_cells(cells)
    role = (F.when(X.is_unknown(C("cell")), "unknown").when(C("is_total"), "total").when(C("ratio_sf").isNotNull(), "ratio").when(C("project_number").isNotNull(), "project")
            .when(C("cell").rlike(X.SQUARE_FEET), "area").when(F.size(X.note_issues(C("cell"))) > 0, "note").when(C("equipment_code").isNotNull(), "equipment")
            .when(C("is_name"), "name").otherwise("other"))
    return e.withColumn("role", role)


def interpret_notes(cells: DataFrame) -> DataFrame:
    """Suggestions, reported gaps and confidence of free-text notes."""
    n = cells.withColumn("suggestions", X.note_suggestions(C("cell"))).withColumn("gaps", X.note_issues(C("cell"))).where((F.size("suggestions") > 0) | (F.size("gaps") > 0))
    blocking = F.exists("gaps", lambda g: g["severity"] == "Blocking")
    return n.withColumn("confidence", F.when(blocking, "High").when(F.size("suggestions") > 0, "Moderate").otherwise("Low"))


def phases(cells: DataFrame) -> DataFrame:
    """Phase number in force at every row of a project, from the last phase marker above it."""
    mark = F.regexp_extract("cell", r"(?i)^phase\s+(\d+)$", 1)
    r = running(cells, ["workbook", "project_id"], ["row"], phase=("last", F.when(mark != "", mark.try_cast("bigint"))))
    return r.withColumn("phase", F.coalesce("phase", F.lit(0)))


def choose_square_feet(cells: DataFrame) -> DataFrame:
    """The most repeated area of a project, the first on ties; several values are a conflict."""
    e = cells.withColumn("sf", X.square_feet(C("cell"))).where(C("cell").rlike(X.SQUARE_FEET) & C("sf").isNotNull())
    counts = e.groupBy("project_id", "sf").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("at"))
    best = first_per(counts, ["project_id"], ["-n", "at"])
    total = counts.groupBy("project_id").agg(F.count(F.lit(1)).alias("values"))
    return join_back(best, total, ["project_id"]).select("project_id", C("sf").alias("square_feet"), "values", (C("values") > 1).alias("conflict"))


TOTAL_OR_UNIT = [("projectTonnage", "tonnage", "project|total|combined|grand"), ("projectDuctFeet", "ductFeet", "project|total")]  # fixed pairs


def suggest_mapping(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Field to header per sheet: exact alias before partial, then header order.

    A total column and its unit column never share a header: the words of the
    header decide which of the two keeps it.
    """
    k = X.label(C("name"))
    aliases = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias")) for f, names in X.FIELD_ALIASES.items() for a in names])
    partial = lambda a: (F.length(a) >= 5) & (F.length(C("k")) >= 5) & (F.contains(C("k"), a) | F.contains(a, C("k")))
    names = headers.select("name").distinct().withColumn("k", k)
    hits = names.withColumn("h", F.explode(F.filter(aliases, lambda s: (s["alias"] == C("k")) | partial(s["alias"])))) \
                .groupBy("name", "k", C("h.field").alias("field")).agg(F.min(F.when(C("h.alias") == C("k"), 0).otherwise(1)).alias("rank"))
    best = headers.join(hits, "name").groupBy(*keys, "field").agg(F.min(F.struct("rank", "pos", "name", "k")).alias("b"))
    best = best.select(*keys, "field", C("b.name").alias("header"), C("b.k").alias("k"), C("b.pos").alias("pos"))
    out = best
    for total, unit, words in TOTAL_OR_UNIT:
        both = best.where(C("field").isin(total, unit)).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("d"), F.min("k").alias("hk")).where("n = 2 and d = 1")
        lose = both.select(*keys, F.when(C("hk").rlike(words), unit).otherwise(total).alias("field"))
        out = out.join(lose, [*keys, "field"], "left_anti")
    return out.select(*keys, "field", "header", "pos")


def detect_header(sheet_rows: DataFrame, first_rows: int | None = None) -> DataFrame:
    """Best header block (start row, height 1 to 3) of every sheet by mapped fields.

    ``sheet_rows(workbook, sheet, row, cells)`` with rows counted from 0. All rows are searched, or the first ``first_rows``.
    """
    key = ["workbook", "sheet"]
    if first_rows is not None:
        sheet_rows = sheet_rows.where(C("row") < first_rows)
    top = sheet_rows.select(*key, "row", F.posexplode("cells").alias("pos", "cell"))
    top = top.withColumn("cell", X.cleaned(C("cell"))).where("cell <> ''")
    last = sheet_rows.groupBy(*key).agg(F.max("row").alias("last_row"))
    blocks = top.join(last, key).withColumn("height", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))) \
                .withColumn("start", F.explode(F.sequence(C("row") - C("height") + 1, C("row")))).where((C("start") >= 0) & (C("start") + C("height") - 1 <= C("last_row")))
    cand = [*key, "start", "height"]
    named = blocks.groupBy(*cand, "pos").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "cell"))), lambda s: s["cell"])), " ").alias("name"))
    m = suggest_mapping(named, cand)
    n = lambda *fields: F.count_if(C("field").isin(*fields))
    scored = m.groupBy(*cand).agg((F.count(F.lit(1)) * 10 + n("projectNumber", "projectName") * 8 + n("unitName", "tonnage", "unitType") * 4).alias("points"))
    scored = scored.withColumn("score", C("points") - C("height") * 0.25)
    return first_per(scored, key, ["-score", "start", "height"]).select(*cand, "score")
