"""Sheet index read from page texts, sheet identities, and views without a scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.functions import drawings as D
from recordqc.functions import sheets as X
from recordqc.operators.scale import first_per, join_back, ranked, top_k

C = F.col
FRONT, ANYWHERE = 5, 3  # pages that are searched for an index: of the first ones, or else the first with a heading


def index_pages(pages: DataFrame) -> DataFrame:
    """Pages that may hold a set's sheet index: those among its first five with a heading, or else its first three with one."""
    order = ["page_number", "doc_id"]
    headed = X.has(C("text"), X.INDEX_HEADER)
    front = top_k(pages.select("set_id", *order, "text"), ["set_id"], order, FRONT).where(headed).drop("rn")
    late = top_k(pages.where(headed).select("set_id", *order, "text").join(front.select("set_id").distinct(), "set_id", "left_anti"), ["set_id"], order, ANYWHERE).drop("rn")
    return front.unionByName(late)


def index_stretch(text: Column) -> Column:
    """The lines of a page that its index is read from.

    Lines that are sheet numbers form runs. Before each heading the longest run counts if it has three lines or more, behind it all
    number lines of the next 260. The stretch reaches from the first of these to three lines behind the last. A page without any
    is read from its first heading on. A page is one row; its lines never leave it.
    """
    lines = D.lines(text)
    at = lambda test: F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    whole = F.struct(lines.alias("lines"), at(lambda x: X.has(x, X.INDEX_HEADER)).alias("heads"), at(D.is_number_line).alias("numbers"))

    def stretch(p: Column) -> Column:
        begin, end = (F.sort_array(F.array_except(p["numbers"], F.transform(p["numbers"], lambda x: x + step))) for step in (1, -1))
        runs = F.transform(F.arrays_zip(begin.alias("begin"), end.alias("end")), lambda r: F.struct((r["end"] - r["begin"]).alias("size"), (-r["begin"]).alias("first"), r["end"].alias("end")))

        def around(h: Column) -> Column:
            before = F.array_max(F.filter(runs, lambda r: r["end"] < h))
            after = F.filter(p["numbers"], lambda x: (x > h) & (x <= h + 260))
            long = before["size"] >= 2
            return F.struct(F.least(F.when(long, -before["first"]), F.array_min(after)).alias("lo"), F.greatest(F.when(long, before["end"]), F.array_max(after)).alias("hi"))
        spans = F.transform(p["heads"], around)
        lo, hi = F.array_min(spans["lo"]), F.array_max(spans["hi"])
        tail = D.lines(F.substr(text, F.regexp_instr(text, F.lit(X.any_case(X.INDEX_HEADER)))))
        return F.when(lo.isNotNull(), F.slice(p["lines"], lo + 1, hi + 4 - lo)).otherwise(tail)
    return F.transform(F.array(whole), stretch)[0]


def index_entries(pages: DataFrame) -> DataFrame:
    """The sheet index of each set: one entry a normalised number, the first, in reading order."""
    p = index_pages(pages).withColumn("lines", index_stretch(C("text")))
    near = lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.slice(C("lines"), i + 2, F.lit(3)).alias("next"))
    rows = p.select("set_id", "page_number", "doc_id", F.explode(F.filter(F.transform("lines", near), lambda r: (r["line"] != "") & (F.length(r["line"]) <= 180))).alias("r")) \
        .select("set_id", "page_number", "doc_id", "r.*")
    e = rows.withColumn("sheet_number", D.index_number(C("line"))).where((C("sheet_number") != "") & ((C("sheet_number") != "ADA") | (F.upper("line") == "ADA")))
    named = D.clean_title(C("line"), C("sheet_number"))
    e = e.withColumn("sheet_name", F.when(named == C("sheet_number"), "").otherwise(named))
    following = F.element_at(F.concat(F.filter("next", lambda x: (x != "") & (F.upper(x) != C("sheet_number"))), F.array(F.lit(""))), 1)
    cover = (F.upper("line") == C("sheet_number")) & (C("sheet_name") == "") & following.rlike(r"(?i)^COVER\s+SHEET$")
    e = e.withColumn("sheet_name", F.when(cover, following).otherwise(C("sheet_name"))).withColumn("number", X.normalize_number(C("sheet_number")))
    order = ["page_number", "doc_id", "line_no"]
    one = first_per(e.drop("line", "next"), ["set_id", "number"], order)
    return ranked(one, ["set_id"], order, "index_position").select(
        "set_id", "index_position", "sheet_number", "sheet_name", "page_number", F.when(C("sheet_name") != "", 80).otherwise(62).cast("bigint").alias("confidence"))


def index_summary(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Whether each set's index was read: number of its pages and entries, confidence, need of a review."""
    n = index_pages(pages).groupBy("set_id").agg(F.count(F.lit(1)).alias("source_pages"))
    e = entries.groupBy("set_id").agg(F.count(F.lit(1)).alias("entries"))
    out = pages.select("set_id").distinct().join(n, "set_id", "left").join(e, "set_id", "left").fillna(0, ["source_pages", "entries"])
    return out.withColumn("confidence", F.when(C("entries") > 0, 90).otherwise(0).cast("bigint")).withColumn("needs_review", C("entries") == 0)


SCALE_OPTIONAL = r"(?i)\bSHEET\s+INDEX\b|\bINDEX\s+OF\s+SHEETS\b|\b(?:DOOR|WINDOW|ROOM\s+FINISH)\s+SCHEDULE\b|\bGLAZING\s+TYPES?\b|\bCEILING\s+TILE\s+TYPES?\b"


def scale_optional(pages: DataFrame) -> Column:
    """Index sheets, schedules and scheduled door or window details need no scales."""
    t, name = C("text"), C("sheet_title")
    details = (t.rlike(r"(?i)\b(?:DOOR|WINDOW)\s+(?:HEAD|JAMB|SILL)\s+DETAILS?\b") & t.rlike(r"(?i)\b(?:AS|PER)\s+SCHEDULED?\b") & name.rlike(r"(?i)\b(?:DOOR|WINDOW|LEAD-LINED|GLAZING)\b"))
    label = C("page_label") if "page_label" in pages.columns else F.lit("")
    return (name.rlike(r"(?i)\b(?:COVER|INDEX)\s+SHEET\b|\bSHEET\s+INDEX\b|\bINDEX\s+OF\s+SHEETS\b") | label.rlike(r"(?i)\b(?:COVER|INDEX)\s+SHEET\b|\bSHEET\s+INDEX\b")
            | t.rlike(SCALE_OPTIONAL) | details)


def missing_scales(pages: DataFrame) -> DataFrame:
    """Views of each page with their detail number and scale: Pass, or Warning where neither a scale nor NTS stands near.

    A view is a label with a detail number on its line, the two lines before or the three behind. Its scale is the first in the lines from four before to
    two behind. References, notes and rows of a sheet index are not views. Of equal (detail, label) on a page the first with a scale counts, or else the first.
    Cover pages (``is_cover``) have no views. ``scale_mark`` says that a graphic scale stands on the page, which serves site plans. Only lines with a label leave
    the page, with the few lines around them.
    """
    flag = lambda n: F.coalesce(C(n), F.lit(False)) if n in pages.columns else F.lit(False)
    p = pages.where(~flag("is_cover") & C("text").rlike(X.any_case(D.VIEW_LABEL)) & ~F.coalesce(scale_optional(pages), F.lit(False)))
    p = p.select("set_id", "page_number", "doc_id", "sheet_number", flag("scale_mark").alias("scale_mark"), F.filter(D.lines(C("text")), lambda x: x != "").alias("lines"))
    around = lambda i, back, n: F.slice(C("lines"), F.greatest(i - back, F.lit(0)) + 1, n + F.least(i, F.lit(back)))
    line = lambda x, i: F.when(x.rlike(X.any_case(D.VIEW_LABEL)) & ~x.rlike(r"(?i)\b(?:KEY)?NOTES?\b"), F.struct(
        i.alias("line_no"), x.alias("line"), around(i, 2, 0).alias("two"), F.slice(C("lines"), i + 2, F.lit(3)).alias("next"),
        around(i, 4, 3).alias("near"), around(i, 10, 1).alias("ten")))
    v = p.withColumn("v", F.explode(F.filter(F.transform("lines", line), lambda r: r.isNotNull()))).select("set_id", "page_number", "doc_id", "sheet_number", "scale_mark", "v.*")
    v = v.withColumn("parts", F.split(F.regexp_replace("line", X.any_case(D.VIEW_LABEL), "\u0001$1\u0002"), "\u0001"))
    text = lambda a: F.replace(F.array_join(a, ""), F.lit("\u0002"), F.lit(""))
    v = v.withColumn("nth", F.explode(F.sequence(F.lit(1), F.size("parts") - 1))).withColumns({
        "before": text(F.slice("parts", F.lit(1), C("nth"))), "label": F.substring_index(C("parts")[C("nth")], "\u0002", 1),
        "after": F.concat(F.substring_index(C("parts")[C("nth")], "\u0002", -1), text(F.slice("parts", C("nth") + 2, F.size("parts"))))})
    context = F.array_join(F.concat("two", F.array("before")), " ")
    refers = (C("before").rlike(r"(?i)\bREFER\s+TO\b") | F.right("before", F.lit(12)).rlike(r"(?i)\b(?:RE|REF|REFERENCE)\.?\s*:?\s*$")
              | F.left("after", F.lit(30)).rlike(r"(?i)^\s+FOR\s+(?:SIZES|LOCATION|REFERENCE|INFORMATION)\b")
              | context.rlike(r"(?i)\bREFER\s+TO\b|\bREFERENCE\s*:?\s*$|\bREF\.?\s+NOTES?\b"))
    recent = F.slice("ten", F.greatest(F.size("ten") - 3, F.lit(1)), F.lit(4))
    indexed = F.array_join("ten", " ").rlike(r"(?i)\b(?:INDEX|LIST)\s+OF\s+SHEETS\b|\bSHEET\s+(?:INDEX|LIST)\b") & F.exists(recent, lambda x: D.whole(x, D.LOOSE_NUMBER))
    edge = F.lit(" .:-")
    own = F.regexp_extract(F.btrim("before", edge), rf"(?i)(?:^|\s)({D.DETAIL_NUMBER})$", 1)
    previous = F.filter(F.transform(F.reverse("two"), lambda x: F.btrim(x, edge)), lambda x: D.whole(x, D.DETAIL_NUMBER))
    following = F.filter(F.transform("next", D.detail_in), lambda x: x != "")
    first = lambda a: F.element_at(F.concat(a, F.array(F.lit(""))), 1)
    detail = F.coalesce(*[F.when(x != "", x) for x in (own, D.detail_in(F.btrim("after", edge)), first(previous), first(following))])
    v = v.where(~refers & ~indexed).withColumn("detail", F.upper(detail)).withColumn("label", D.squeezed(F.upper("label"))).where(C("detail").isNotNull())
    compact = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9.]", "")
    roof = (C("label") == "ROOF PLAN") & C("line").rlike(r"(?i)\b(?:REFER|REF\.?|SEE|LEGEND|SCHEDULE|FINISH)\b")
    v = v.where(~roof & ~C("label").rlike(r"\bSEE\s+DETAILS?$") & ((compact("sheet_number") == "") | (compact("detail") != compact("sheet_number"))))
    read = D.scale_of(F.array_join("near", " "))
    v = v.withColumn("scale", F.when((read == "") & (C("label") == "SITE PLAN") & C("scale_mark"), "Visual scale marker").otherwise(read))
    best = F.min(F.struct((C("scale") == "").cast("int").alias("none"), "line_no", "nth", "scale")).alias("b")
    one = v.groupBy("set_id", "page_number", "doc_id", "sheet_number", "detail", "label").agg(best)
    return one.select("set_id", "page_number", "doc_id", F.when(C("sheet_number") != "", C("sheet_number")).otherwise(F.concat(F.lit("Page "), "page_number")).alias("sheet_number"),
                      C("detail").alias("detail_number"), C("label").alias("view_label"), C("b.scale").alias("scale"),
                      F.when(C("b.scale") != "", "Pass").otherwise("Warning").alias("status"),
                      F.when(C("b.scale") != "", "").otherwise("Missing scale or NTS designation.").alias("comment"))
