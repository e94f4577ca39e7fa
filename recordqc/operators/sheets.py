"""Drawing sets: index against pages, covers, keynotes, views, seals, rules, spelling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.functions import sheets as X
from recordqc.operators.scale import first_per, join_back, running, top_k
from recordqc.session import written

C = F.col


def presence(found: Column, readable: Column) -> Column:
    """Present where found; what is not found is missing only where there is text to find it in."""
    return F.when(found, "Present").when(readable, "Missing").otherwise("Not Detected")


def enrich_pages(pages: DataFrame) -> DataFrame:
    """Normalised number, discipline, set type and tri-state presence of every page."""
    return pages.withColumns({"number": X.normalize_number(C("sheet_number")), "discipline": X.discipline(C("sheet_number")),
                              "set_marker": X.set_type(C("text")),
                              "seal_state": presence(C("seal_present") | X.has(C("text"), X.SEAL), F.trim("text") != "")})


def keyword_pages(pages: DataFrame) -> DataFrame:
    """(set, keyword, page) wherever a named pattern matches."""
    hits = F.filter(F.array(*[F.when(X.has(C("text"), p), F.lit(n)) for n, p in X.KEYWORDS]), lambda x: x.isNotNull())
    return pages.select("set_id", "page_number", F.explode(hits).alias("keyword"))


# Least share of a set's pages that must carry each mark.
COVERAGE = {"title_block": 0.75, "sheet_number": 0.75, "issue_date": 0.60, "seal_signature": 0.60}


def coverage_check(pages: DataFrame, thresholds: dict[str, float] = COVERAGE) -> DataFrame:
    """Share of a set's pages with title block, sheet number, issue date, and seal or signature, against its threshold."""
    kw = dict(X.KEYWORDS)
    marks = {"title_block": C("title_block_text") != "", "sheet_number": X.normalize_number(C("sheet_number")) != "",
             "issue_date": X.has(C("text"), kw["issue_date"]),
             "seal_signature": C("seal_present") | X.has(C("text"), kw["professional_seal"]) | X.has(C("text"), kw["signature"])}
    a = pages.groupBy("set_id").agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(marks[k]).alias(k) for k in thresholds])
    rows = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(v).alias("threshold"), C(k).alias("hits")) for k, v in thresholds.items()])
    j = a.select("set_id", "pages", F.explode(rows).alias("k")).select("set_id", "pages", "k.*")
    return j.withColumn("ratio", C("hits") / C("pages")).withColumn("ok", C("ratio") >= C("threshold"))


def _numbered(index: DataFrame, physical: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (index.withColumn("number", X.normalize_number(C("sheet_number"))).where("number <> ''"),
            physical.withColumn("number", X.normalize_number(C("sheet_number"))))


def compare_presence(index: DataFrame, physical: DataFrame) -> DataFrame:
    """missing, extra, duplicate and unnumbered rows per set."""
    i, p = _numbered(index, physical)
    named = p.where("number <> ''")
    key = ["set_id", "number"]
    row = lambda df, kind, pos: df.select("set_id", F.lit(kind).alias("kind"), "number", C(pos).alias("position"))
    again = join_back(named, named.groupBy(*key).agg(F.min("page_number").alias("first_page")), key).where("page_number > first_page")
    return (row(i.join(named.select(*key).distinct(), key, "left_anti"), "missing", "index_position")
            .unionByName(row(named.join(i.select(*key).distinct(), key, "left_anti"), "extra", "page_number"))
            .unionByName(row(again, "duplicate", "page_number")).unionByName(row(p.where("number = ''"), "unnumbered", "page_number")))


def presence_status(index: DataFrame, physical: DataFrame) -> DataFrame:
    bad = compare_presence(index, physical).groupBy("set_id").agg(F.count(F.lit(1)).alias("findings"))
    sets = index.select("set_id").union(physical.select("set_id")).distinct()
    return sets.join(bad, "set_id", "left").fillna(0, ["findings"]).withColumn("status", F.when(C("findings") == 0, "Pass").otherwise("Fail"))


def out_of_sequence(index: DataFrame, physical: DataFrame) -> DataFrame:
    """Sheets placed before one that the index lists earlier: position below the running maximum."""
    i, p = _numbered(index, physical)
    key = ["set_id", "number"]
    pos = i.groupBy(*key).agg(F.max("index_position").alias("index_position"))
    first = p.where("number <> ''").groupBy(*key).agg(F.min("page_number").alias("page_number"))
    common = first.join(pos, key)
    return running(common, ["set_id"], ["page_number", "number"], seen=("max_before", "index_position")).where("index_position < seen") \
        .select("set_id", "number", "index_position", "page_number")


def sequence_status(index: DataFrame, physical: DataFrame) -> DataFrame:
    i, p = _numbered(index, physical)
    key = ["set_id", "number"]
    twice = i.join(p.select(*key), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("set_id")
    bad = twice.union(out_of_sequence(index, physical).select("set_id")).distinct().withColumn("bad", F.lit(True))
    return i.select("set_id").distinct().join(bad, "set_id", "left").select("set_id", F.when(C("bad"), "Fail").otherwise("Pass").alias("status"))


def classify_covers(pages: DataFrame) -> DataFrame:
    """Cover pages by weighted evidence; the best of a set is primary, the rest secondary."""
    t = F.upper("text")
    sheet = F.regexp_replace(F.upper("sheet_number"), "[^A-Z0-9]", "")
    w = lambda p, n: F.when(t.rlike(p), n).otherwise(0)
    civil = t.rlike(r"\bCIVIL\s+(?:COVER|CONSTRUCTION\s+PLAN(?:S)?)\b") & ~t.rlike(r"\b(?:DESIGN\s+CONSULTANT\s+TEAM|OWNER)\b")
    score = (F.when(sheet.isin("CS", "CS1", "CS001", "G000", "G001", "A000"), 100).otherwise(0) + w(r"\bCOVER\s+SHEET\b", 45) + w(r"\bSHEET\s+INDEX\b", 20)
             + w(r"\b(?:LOCATION|VICINITY)\s+MAP\b", 15) + w(r"\bDESIGN\s+CONSULTANT\s+TEAM\b", 15) + w(r"\bCONSTRUCTION\s+PLANS\b", 15))
    strong = t.rlike(r"\bDESIGN\s+CONSULTANT\s+TEAM\b") & t.rlike(r"\bOWNER\b")
    c = pages.select("set_id", "page_number", "sheet_number", F.when(civil, 0).otherwise(score).alias("score"), strong.cast("int").alias("strong")).where("score >= 65")
    best = c.groupBy("set_id").agg(F.max(F.struct("strong", "score", -C("page_number"))).alias("b"))
    return join_back(c, best, ["set_id"]).select("set_id", "page_number", "sheet_number", C("score").cast("bigint").alias("score"),
                                                 F.when(C("b.col3") == -C("page_number"), "primary").otherwise("secondary").alias("cover_type"))


def _ignorable(c: Column) -> Column:
    up = F.upper(c)
    return ~up.rlike(r"^B[- ]?\d+(?:\.\d+)?$") & ~up.rlike(r"^C[- ]?0(?:\.0+)?$")


def physical_position(pages: DataFrame, covers: DataFrame) -> DataFrame:
    """Page number minus the ignorable secondary covers before it."""
    skip = covers.where((C("cover_type") == "secondary") & _ignorable(C("sheet_number"))).select("set_id", "page_number", F.lit(1).alias("skip"))
    j = pages.select("set_id", "page_number").join(skip, ["set_id", "page_number"], "left").fillna(0, ["skip"])
    r = running(j, ["set_id"], ["page_number"], before=("sum_before", "skip"))
    return r.select("set_id", "page_number", (C("page_number") - F.coalesce("before", F.lit(0))).cast("bigint").alias("position"))


def scope_pages(pages: DataFrame, covers: DataFrame) -> DataFrame:
    c = covers.select("set_id", "page_number", F.lit(True).alias("cover"))
    j = pages.join(c, ["set_id", "page_number"], "left")
    return j.where(C("cover").isNotNull() | X.normalize_number(C("sheet_number")).startswith("A")).drop("cover")


NOTE_NUMBER = r"(^|\s)(\d{1,3})\s*[).:\-]"


def _legend(tail: Column) -> Column:
    """The legend on one line: what is behind its heading, up to the next stop heading."""
    return F.trim(F.regexp_replace(X.until_first(tail, X.SECTION_STOP), r"\s+", " "))


def text_callouts(text: Column, tail: Column) -> Column:
    """Whether numbers of the legend are called out in the text: two of them before the heading, or three of them thrice behind it."""
    legend = F.regexp_extract_all(_legend(tail), F.lit(NOTE_NUMBER), F.lit(2))
    alone = lambda c: F.filter(F.split(F.regexp_replace(c, X.any_case(X.VIEW_SCALE), " "), r"[^\w./-]+"), lambda w: w.rlike(r"^\d{1,3}$"))
    before = F.array_intersect(legend, alone(X.until_first(text, X.KEYNOTE_LEGEND)))
    behind = F.filter(F.array_distinct(legend), lambda n: F.size(F.filter(alone(tail), lambda w: w == n)) >= 3)
    return (F.size(before) >= 2) | (F.size(behind) >= 3)


def placeholder_legend(tail: Column) -> Column:
    """Whether the first line behind the heading is a numbered placeholder and no second heading is near."""
    return tail.rlike(r"(?i)^\s*\d{1,3}\s*[).:-]\s*(?:SAMPLE|PLACEHOLDER|TBD|N/?A|NONE)[ \t]*(?:\n|$)") & ~X.has(F.left(tail, F.lit(80)), X.KEYNOTE_LEGEND)


def keynote_entries(pages: DataFrame) -> DataFrame:
    """Number and text of every legend entry behind a keynotes heading, up to the next stop heading."""
    p = pages.where(X.has(C("text"), X.KEYNOTE_LEGEND)).withColumn("tail", X.after_first(C("text"), X.KEYNOTE_LEGEND))
    marked = F.regexp_replace(_legend(C("tail")), NOTE_NUMBER, "\u0001$2\u0002")
    p = p.withColumn("entry", F.explode(F.slice(F.split(marked, "\u0001"), F.lit(2), F.greatest(F.size(F.split(marked, "\u0001")) - 1, F.lit(0)))))
    text = F.btrim(F.regexp_replace(F.substring_index("entry", "\u0002", -1), r"\s+", " "), F.lit(" .;:-"))
    return p.select("set_id", "page_number", F.substring_index("entry", "\u0002", 1).alias("note"), text.alias("content")).where("content <> ''")


def duplicate_keynotes(pages: DataFrame) -> DataFrame:
    """The same keynote text under two or more numbers of one page."""
    norm = F.trim(F.regexp_replace(F.upper(F.regexp_replace(F.regexp_replace("content", r"\([^)]*\)", " "), "[^A-Za-z0-9]+", " ")), " +", " "))
    e = keynote_entries(pages).withColumn("norm", norm)
    up = F.upper("content")
    term = C("norm").contains("DOOR") | C("norm").contains("WINDOW") | C("norm").contains("STOREFRONT") | C("norm").contains("WALL BASE") | C("norm").contains("GYPSUM BOARD")
    allowed = up.contains("REFER FINISHES") | up.contains("REFER TO FINISH") | (C("norm").endswith("AS SCHEDULED") & term)
    per = e.where((C("norm") != "") & ~allowed).groupBy("set_id", "page_number", "norm", "note").agg(F.lit(1).alias("x"))
    return per.groupBy("set_id", "page_number", "norm").agg(F.count(F.lit(1)).alias("numbers"), F.min(C("note").cast("int")).cast("bigint").alias("first_number")).where("numbers >= 2")


def viewports(pages: DataFrame) -> DataFrame:
    """Every view title with its detail number, label and scale on pages with keynotes."""
    rx = X.any_case(X.VIEW_TITLE)
    part = lambda i: F.regexp_extract_all("text", F.lit(rx), F.lit(i))
    p = pages.where(X.has_keynote_section(C("text"))).select("set_id", "page_number", F.explode(F.arrays_zip(
        part(1).alias("detail"), part(2).alias("label"), part(3).alias("scale"))).alias("v"))
    clean = lambda c: F.regexp_replace(F.upper(C(c)), r"\s+", " ")
    return p.select("set_id", "page_number", F.upper("v.detail").alias("detail"), clean("v.label").alias("label"), clean("v.scale").alias("scale"))


def keynote_compliance(pages: DataFrame) -> DataFrame:
    """Verdict on the keynote section of a page by its symbols, text callouts and repeated texts; placeholders need none."""
    d = duplicate_keynotes(pages).groupBy("set_id", "page_number").agg(F.count(F.lit(1)).alias("repeats"))
    p = pages.where(X.has_keynote_section(C("text"))).withColumn("tail", X.after_first(C("text"), X.KEYNOTE_LEGEND)) \
        .select("set_id", "page_number", "sheet_number", (C("graphic_present") | text_callouts(C("text"), C("tail"))).alias("shown"), placeholder_legend(C("tail")).alias("empty"))
    j = p.join(d, ["set_id", "page_number"], "left").fillna(0, ["repeats"])
    return j.withColumn("status", F.when(C("empty"), "Not Applicable").when(~C("shown") | (C("repeats") > 0), "Fail").otherwise("Pass")).drop("shown", "empty")


def set_types(pages: DataFrame) -> DataFrame:
    """Official or not, from the pages of a set that are given."""
    return pages.groupBy("set_id").agg(F.max(X.has(C("text"), X.NON_OFFICIAL)).alias("non"), F.max(X.has(C("text"), X.OFFICIAL)).alias("off")) \
        .select("set_id", F.when(C("non"), "Non-Official").when(C("off"), "Official").otherwise("Unknown").alias("set_type"))


def seal_compliance(pages: DataFrame, types: DataFrame) -> DataFrame:
    j = join_back(pages.select("set_id", "page_number", "sheet_number", "seal_present"), types, ["set_id"])
    official = F.coalesce(C("set_type") == "Official", F.lit(False))
    return j.select("set_id", "page_number", "sheet_number", F.when(~official, "Not Applicable").when(C("seal_present"), "Pass").otherwise("Fail").alias("status"))


def cover_checklist(pages: DataFrame, types: DataFrame) -> DataFrame:
    """Checklist rows per set from the texts of the pages that are given."""
    t = C("text")
    has = lambda p: F.max(X.has(t, p))
    a = pages.groupBy("set_id").agg(
        has(r"\bPROJECT\b").alias("project_identifier"), has(r"\b(?:RENDER|RENDERING|ISOMETRIC|PERSPECTIVE|IMAGE)\b").alias("central_image"),
        has(r"\bTDLR\b|\bTABS\b\s*#?\s*\d+").alias("registration"), has(r"\bDESIGN\s+CONSULTANT\s+TEAM\b|\bCONSULTANTS?\b").alias("consultant_team"),
        has(r"\b(?:OWNER|CLIENT)\b").alias("owner_section"), has(r"\b(?:VICINITY|LOCATION)\s+MAP\b").alias("vicinity_map"),
        has(X.INDEX_HEADER).alias("sheet_index"), has(X.SEAL).alias("seal"), has(X.NON_OFFICIAL).alias("nfc"), F.max("seal_present").alias("seal_mark"))
    a = a.join(types, "set_id")
    soft = ["project_identifier", "central_image", "registration", "consultant_team", "owner_section", "vicinity_map"]
    marker = (F.when(C("set_type") == "Official", F.when(C("seal") | C("seal_mark"), "Pass").otherwise("Fail"))
              .when(C("set_type") == "Non-Official", F.when(C("nfc"), "Pass").otherwise("Fail")).otherwise("Needs Review"))
    rows = [F.struct(F.lit(c).alias("item"), F.when(C(c), "Pass").otherwise("Needs Review").alias("status")) for c in soft]
    rows += [F.struct(F.lit("sheet_index").alias("item"), F.when(C("sheet_index"), "Pass").otherwise("Fail").alias("status")),
             F.struct(F.lit("set_type_marker").alias("item"), marker.alias("status"))]
    return a.select("set_id", F.explode(F.array(*rows)).alias("r")).select("set_id", "r.*")


def qc_summary(checklist: DataFrame, keynotes: DataFrame, seals: DataFrame) -> DataFrame:
    """Failed items and the overall status of every set."""
    fail = lambda df, name: df.groupBy("set_id").agg(F.count_if(C("status") == "Fail").alias(name))
    k = keynotes.groupBy("set_id").agg(F.count(F.lit(1)).alias("keynote_sheets"), F.count_if(C("status") == "Fail").alias("keynote_failed"))
    review = checklist.groupBy("set_id").agg(F.count_if(C("status") == "Fail").alias("cover_failed"), F.count_if(C("status") == "Needs Review").alias("cover_review"))
    j = review.join(k, "set_id", "left").join(fail(seals, "seals_failed"), "set_id", "left").fillna(0)
    total = C("cover_failed") + C("keynote_failed") + C("seals_failed")
    return j.withColumn("failed_items", total).withColumn(
        "overall", F.when(total > 0, "Fail").when(C("cover_review") > 0, "Needs Review").otherwise("Pass"))


def qc_report(checklist: DataFrame, keynotes: DataFrame, seals: DataFrame) -> DataFrame:
    """The flat report: section, item, status, sheet, page in section order."""
    none_s, none_p = F.lit("").alias("sheet"), F.lit(None).cast("bigint").alias("page")
    r = checklist.select("set_id", F.lit(1).alias("section_order"), F.lit("Cover Sheet Checklist").alias("section"), "item", "status", none_s, none_p)
    k = keynotes.select("set_id", F.lit(2).alias("section_order"), F.lit("Sheet Keynote Compliance").alias("section"), F.lit("SHEET KEYNOTES gate").alias("item"), "status",
                        C("sheet_number").alias("sheet"), C("page_number").alias("page"))
    s = seals.select("set_id", F.lit(3).alias("section_order"), F.lit("Sheet Seal Compliance").alias("section"), F.lit("Right-side professional seal").alias("item"), "status",
                     C("sheet_number").alias("sheet"), C("page_number").alias("page"))
    return r.unionByName(k).unionByName(s)


def missing_items(report: DataFrame) -> DataFrame:
    """Report rows that need work; seals that do not apply are left out."""
    return report.where(C("status").isin("Fail", "Needs Review") & (C("status") != "Not Applicable"))


SEVERITY = {"High": 0, "Medium": 1, "Low": 2}  # fixed order


def document_rules(pages: DataFrame) -> DataFrame:
    """Document rules from page aggregates: all findings of each set."""
    t = C("text")
    kw = dict(X.KEYWORDS)
    has = lambda k: F.max(X.has(t, kw[k])).alias(k)
    view = t.rlike("PLAN|ELEVATION|SECTION|DETAIL")
    short = F.length(F.trim(t))
    cut = t.rlike("MATCHLINE|SEE CONTINUATION|CONTINUED|CROP|VIEWPORT")
    p = pages.withColumn("text", F.upper("text")).withColumn("tb", C("title_block_text") != "")
    a = p.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("tb").alias("title_blocks"), has("project_name"), has("project_address"), has("owner_client"), has("sheet_index"),
        has("consultant_team"), has("issue_date"), has("north_arrow"), has("scale"), has("graphic_scale"),
        has("revision_block"), has("professional_seal"), has("signature"),
        F.count_if((short < 80) | X.has(t, kw["blank_marker"])).alias("blank"), F.count_if(X.has(t, kw["placeholder"])).alias("placeholders"),
        F.count_if(C("tb") & (C("sheet_title") == "")).alias("untitled"), F.count_if(view & ~X.has(t, kw["scale"])).alias("unscaled"),
        F.count_if(C("tb") & ~X.has(t, kw["revision"])).alias("unrevised"), F.count_if(cut & (short < 250)).alias("cropped"))
    dup = p.groupBy("set_id", F.upper("sheet_number").alias("n")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy("set_id").agg(F.count(F.lit(1)).alias("repeated"))
    a = a.join(dup, "set_id", "left").fillna(0, ["repeated"])
    share = lambda n, low, s: n >= F.greatest(F.lit(low), F.floor(C("pages") * F.lit(s)))
    rule = lambda cond, i, sev, cat: F.when(cond, F.struct(F.lit(SEVERITY[sev]).alias("sev"), F.lit(cat).alias("category"), F.lit(i).alias("ord"), F.lit(sev).alias("severity")))
    rules = F.array(
        rule(C("title_blocks") < F.greatest(F.lit(1), F.floor(C("pages") * 0.5)), 1, "High", "Missing title block"),
        rule(~(C("project_name") & C("project_address") & C("owner_client")), 2, "High", "Missing or incorrect project information"),
        rule(~C("sheet_index"), 3, "High", "Missing drawing index"), rule(~C("consultant_team"), 4, "Medium", "Missing consultant information"),
        rule(~(C("north_arrow") | C("scale") | C("graphic_scale")), 5, "Medium", "Missing north arrow or scale"), rule(~C("revision_block"), 6, "Medium", "Missing revision block"),
        rule(~(C("professional_seal") | C("signature")), 7, "High", "Missing professional seal or signature"),
        rule(C("repeated") > 0, 8, "High", "Incorrect or duplicate sheet numbers"), rule(C("blank") > 0, 9, "Medium", "Missing, blank, or extra sheets"),
        rule(C("placeholders") > 0, 10, "High", "Placeholder text not removed"), rule(share(C("untitled"), 2, 0.08), 11, "Medium", "Incorrect sheet titles"),
        rule(share(C("unscaled"), 8, 0.30), 12, "Medium", "Missing view titles or scales"), rule(share(C("unrevised"), 5, 0.35), 13, "Low", "Missing revision history"),
        rule(share(C("cropped"), 3, 0.08), 14, "Medium", "Views cropped incorrectly or placed off sheet"),
        rule(~C("issue_date"), 15, "High", "Missing or incorrect issue date"))
    return a.select("set_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("set_id", "r.category", "r.severity", C("r.sev").alias("sev"), C("r.ord").cast("bigint").alias("rule_no"))


def top_findings(rules: DataFrame, n: int = 10) -> DataFrame:
    return rules.orderBy("sev", "category", "set_id", "rule_no").limit(n).drop("sev")


def callouts(pages: DataFrame) -> DataFrame:
    """References to sheets that do not exist, and sheets nobody refers to."""
    rx = X.any_case(X.CALLOUT)
    refs = pages.select("set_id", F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(2))).alias("r")).select("set_id", F.upper("r").alias("number")).distinct()
    have = pages.select("set_id", F.upper("sheet_number").alias("number")).distinct()
    key = ["set_id", "number"]
    return refs.join(have, key, "left_anti").withColumn("kind", F.lit("broken")).unionByName(have.join(refs, key, "left_anti").withColumn("kind", F.lit("unreferenced")))


def presence_checks(pages: DataFrame) -> DataFrame:
    """Document items per set, tri-state by ``presence``."""
    p = pages.groupBy("set_id").agg(F.max("seal_present").alias("mark"), F.max((F.trim("text") != "") | (F.trim("title_block_text") != "")).alias("readable"), F.max(X.has(C("text"), X.SEAL)).alias("seal"), F.max(X.has(C("text"), X.INDEX_HEADER)).alias("index"),
                                    F.max(X.has(C("title_block_text"), r"\bPROJECT\b")).alias("project"), F.count_if(C("sheet_title") == "").alias("untitled"))
    tri = lambda found: presence(found, C("readable"))
    return p.select("set_id", tri(C("seal") | C("mark")).alias("seal"), tri(C("index")).alias("sheet_index"), tri(C("project")).alias("project"), "untitled")


def title_mismatch(pages: DataFrame, titles: DataFrame, below: float = 0.55) -> DataFrame:
    """Sheet titles that differ from the index title by sequence ratio; ``titles(set_id, number, index_title)``."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64"))
    j = pages.where("sheet_title <> ''").select("set_id", "page_number", X.normalize_number(C("sheet_number")).alias("number"), F.upper("sheet_title").alias("title")) \
        .join(titles.where("index_title <> ''"), ["set_id", "number"])
    pairs = j.select("title", F.upper("index_title").alias("want")).distinct().where("title <> want").withColumn("ratio", ratio("title", "want")).where(C("ratio") < below)
    return j.withColumn("want", F.upper("index_title")).join(pairs, ["title", "want"]).select("set_id", "page_number", "number", "ratio")


def _correction_table() -> Column:
    return F.create_map(*[F.lit(x) for kv in X.CORRECTIONS.items() for x in kv])


def spell_check(pages: DataFrame, custom: list[str], cap: int | None = None) -> DataFrame:
    """Known misspellings with their place and context; all of them, or the first ``cap`` per set."""
    fixes = {k: v for k, v in X.CORRECTIONS.items() if k not in {c.lower() for c in custom}}
    table = F.create_map(*[F.lit(x) for kv in fixes.items() for x in kv])
    words = pages.select("set_id", "page_number", "sheet_number", "text",
                         F.regexp_extract_all("text", F.lit(f"({X.WORD})"), F.lit(1)).alias("words"))
    hit = words.withColumn("hit", F.explode(F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("word"))),
                                                     lambda s: F.lower(s["word"]).isin(list(fixes)))))
    # offset of a word: the gaps up to it and the words before it
    gaps = F.split("text", X.WORD)
    size = lambda arr, n: F.aggregate(F.slice(arr, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
    hit = hit.withColumn("start", size(gaps, C("hit.i") + 1) + F.when(C("hit.i") > 0, size(C("words"), C("hit.i"))).otherwise(0))
    lo = F.greatest(C("start") - 70, F.lit(0))
    context = F.trim(F.regexp_replace(F.substr("text", lo + 1, C("start") + F.length("hit.word") + 70 - lo), r"\s+", " "))
    out = hit.select("set_id", "page_number", "sheet_number", C("hit.word").alias("word"), F.try_element_at(table, F.lower("hit.word")).alias("suggestion"), "start", context.alias("context"))
    out = out.where(~C("context").rlike(X.any_case(X.TITLE_LABEL)))
    once = first_per(out.withColumn("lw", F.lower("word")).withColumn("lc", F.lower("context")), ["set_id", "page_number", "lw", "lc"], ["start"])
    once = once.drop("lw", "lc")
    return once if cap is None else top_k(once, ["set_id"], ["page_number", "start"], cap).drop("rn")


def metadata_dictionary(pages: DataFrame, extra: list[str]) -> DataFrame:
    """Words of title-block lines, words repeated in title blocks, and staff words."""
    tok = F.explode(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("line", F.lit("([A-Za-z][A-Za-z'.-]{2,})"), F.lit(1)),
                                                          lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", ""))), lambda w: F.length(w) >= 3)))
    lines = pages.select(F.explode(F.split(F.concat("title_block_text", F.lit("\n"), "text"), r"[\r\n]+")).alias("line")).where(X.has(C("line"), X.TITLE_LABEL))
    meta = lines.select(tok.alias("word")).distinct()
    twice = pages.select(C("title_block_text").alias("line")).select(tok.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("word")
    out = meta.union(twice)
    if extra:
        staff = pages.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w.lower()) for w in extra])).alias("word"))
        out = out.union(staff)
    return out.distinct().where(~C("word").isin(list(X.CORRECTIONS)))


def standards_profile(pages: DataFrame, n: int = 50) -> DataFrame:
    """The most frequent titles with their counts; ties by first page seen."""
    t = pages.where("sheet_title <> ''").groupBy(F.upper("sheet_title").alias("title")).agg(F.count(F.lit(1)).alias("sheets"), F.min("doc_id").alias("first_seen"))
    return top_k(t.withColumn("one", F.lit(1)), ["one"], ["-sheets", "first_seen"], n, "rank").select("rank", "title", "sheets")


def discipline_counts(pages: DataFrame) -> DataFrame:
    return enrich_pages(pages).groupBy("discipline").agg(F.count_distinct("set_id").alias("documents"), F.count(F.lit(1)).alias("sheets"))


def similar_references(queries: DataFrame, refs: DataFrame, k: int = 3, block_rows: int = 20000) -> DataFrame:
    """Exact top-k cosine per query over blocks of both sides; rows with the query's own ``vec_id`` are no references.

    Every (query block, reference block) cell multiplies two bounded matrices
    and returns its own top k, so no pair of vectors becomes a row. Rows without
    an id are left out; a missing vector has no cosine and comes behind all others.
    """
    queries, refs = (df.where("vec_id is not null") for df in (queries, refs))
    nq, nr = (max(1, -(-df.count() // block_rows)) for df in (queries, refs))

    def side(df: DataFrame, mine: str, n: int, other: str, m: int) -> DataFrame:
        return df.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(mine),
                         F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    q = side(queries, "qb", nq, "rb", nr)
    r = side(refs, "rb", nr, "qb", nq).select(C("vec_id").alias("ref_id"), C("embedding").alias("ref_vec"), C("qb").alias("qb2"), C("rb").alias("rb2"))

    def vectors(col):
        size = next((len(v) for v in col if v is not None), 1)
        none = np.array([v is None for v in col])
        m = np.stack([np.zeros(size) if v is None else v for v in col]).astype("float64")
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30), none

    def nearest(queries, blank, refs, bare, own, width: int = 64):
        """(row of ``queries``, place in ``refs``, product) of what can be among the k best of a row by rounded product, then place.

        Pairs with a missing vector (``blank``, ``bare``) count -2, below every cosine; ``own`` has the places from and to that are no references of a row. The k-th largest
        maximum over strided groups of places bounds the k-th largest product from below, so only groups that reach it are looked through.
        """
        m, n = len(queries), len(refs)
        groups = -(-n // width)
        sims = np.full((m, groups * width), -np.inf)
        np.matmul(queries, refs.T, out=sims[:, :n])
        sims[:, :n][:, bare] = -2.0
        sims[blank, :n] = -2.0
        for row in np.nonzero(own[0] < own[1])[0]:
            sims[row, own[0][row]:own[1][row]] = -np.inf
        cube = sims.reshape(m, width, groups)
        top = cube.max(axis=1)
        least = np.partition(top, groups - k, axis=1)[:, groups - k] - 1e-8 if groups > k else np.full(m, -np.inf)
        rows, at = np.nonzero(top >= least[:, None])
        found = cube[rows, :, at]
        pick, lane = np.nonzero((found >= least[rows, None]) & (found > -np.inf))
        return rows[pick], lane * groups + at[pick], found[pick, lane]

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("ref_id", kind="stable")
            ids, mine = right["ref_id"].to_numpy(), left["vec_id"].to_numpy()
            (a, no_a), (b, no_b) = vectors(left["embedding"]), vectors(right["ref_vec"])
            if a.shape[1] != b.shape[1]:  # one side has no vector at all
                a, b = np.zeros((len(a), 1)), np.zeros((len(b), 1))
            for at in range(0, len(left), 128):
                to = slice(at, at + 128)
                own = np.searchsorted(ids, mine[to], "left"), np.searchsorted(ids, mine[to], "right")
                rows, place, value = nearest(a[to], no_a[to], b, no_b, own)
                order = np.lexsort((place, -np.round(value, 9), rows))
                rows, place, value = rows[order], place[order], value[order]
                best = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
                out.append(pd.DataFrame({"vec_id": mine[to][rows[best]], "ref_id": ids[place[best]], "cosine": np.where(value[best] < -1.5, np.nan, value[best])}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "ref_id": [], "cosine": []}).astype({"vec_id": "int64", "ref_id": "int64"})
    cells = q.groupBy("qb", "rb").cogroup(r.groupBy("qb2", "rb2")).applyInPandas(cell, "vec_id bigint, ref_id bigint, cosine double") \
        .withColumn("cosine", F.when(~F.isnan("cosine"), C("cosine")))
    return top_k(cells.withColumn("c", F.round("cosine", 9)), ["vec_id"], ["-c", "ref_id"], k, "rank").select("vec_id", "rank", "ref_id", C("cosine"))


def merge_overrides(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited page fields win; fields that were not edited keep the stored value."""
    e = edits.select("set_id", "page_number", C("sheet_number").alias("e_number"), C("sheet_title").alias("e_title"))
    return stored.join(e, ["set_id", "page_number"], "left").select(
        "set_id", "page_number", F.coalesce("e_number", "sheet_number").alias("sheet_number"), F.coalesce("e_title", "sheet_title").alias("sheet_title"), "seal_present")


def needs_work(docs: DataFrame, cache: DataFrame, rules_version: int) -> DataFrame:
    """extract / re-evaluate / reuse per document by content hash and rules version."""
    c = cache.groupBy("hash").agg(F.max("version").alias("version"))
    return docs.join(c, "hash", "left").select("doc_id", F.when(C("version").isNull(), "extract").when(C("version") < rules_version, "re-evaluate").otherwise("reuse").alias("work"))


def sheet_register(pages: DataFrame, types: DataFrame) -> DataFrame:
    """Listing of sheets over all sets with discipline and phase."""
    p = pages.select("set_id", "page_number", "sheet_number", C("sheet_title").alias("title"), X.discipline(C("sheet_number")).alias("discipline"),
                     F.regexp_extract("text", X.any_case(X.VIEW_TITLE), 3).alias("scale"))
    return join_back(p, types, ["set_id"]).withColumnRenamed("set_type", "phase")


def run_history(runs: DataFrame, n: int = 25) -> DataFrame:
    """The newest runs; display shows reviewed runs as passed."""
    return runs.orderBy(C("modified").desc(), C("run_id")).limit(n).withColumn("shown", F.regexp_replace("status", "Needs Review", "Pass"))


def exclude_covers(index: DataFrame, physical: DataFrame, covers: DataFrame) -> DataFrame:
    """Index entries with the ones that stand for ignored secondary covers marked: the first k unmatched ``COVER SHEET`` entries of a set."""
    from recordqc.operators.scale import ranked
    k = covers.where((C("cover_type") == "secondary") & _ignorable(C("sheet_number"))).groupBy("set_id").agg(F.count(F.lit(1)).alias("k"))
    i = index.withColumn("number", X.normalize_number(C("sheet_number")))
    have = physical.select("set_id", X.normalize_number(C("sheet_number")).alias("number")).distinct()
    loose = i.where(X.has(C("sheet_name"), r"\bCOVER\s+SHEET\b")).join(have, ["set_id", "number"], "left_anti").join(k, "set_id", "left_semi")
    first = join_back(ranked(loose, ["set_id"], ["index_position"], "nth"), k, ["set_id"]).where("nth <= k").select("set_id", "index_position", F.lit(True).alias("hit"))
    return i.join(first, ["set_id", "index_position"], "left").withColumn("ignored", F.coalesce("hit", F.lit(False))).drop("hit")


def scope_index(index: DataFrame, scoped_pages: DataFrame) -> DataFrame:
    """Index entries of reviewed sheets, renumbered in index order."""
    from recordqc.operators.scale import ranked
    i = index.withColumn("number", X.normalize_number(C("sheet_number")))
    have = scoped_pages.select("set_id", X.normalize_number(C("sheet_number")).alias("number")).distinct().withColumn("in_scope", F.lit(True))
    cover = C("number").rlike(r"^(CS\d*|G0+\.?0*)$") & ~F.upper("sheet_number").startswith("CS-")
    kept = i.join(have, ["set_id", "number"], "left").where(C("in_scope") | cover | C("number").startswith("A"))
    return ranked(kept.drop("in_scope"), ["set_id"], ["index_position"], "position")


def page_scales(pages: DataFrame) -> DataFrame:
    """Every scale or not-to-scale mark of a page, normalised."""
    glyphs = F.translate("text", "\u2018\u2019\u2032\u201c\u201d\u2033", "'''\"\"\"")
    p = pages.select("set_id", "page_number", F.explode(F.regexp_extract_all(glyphs, F.lit(X.any_case("(" + X.VIEW_SCALE + ")")), F.lit(1))).alias("raw"))
    flat = F.btrim(F.regexp_replace(F.upper("raw"), r"\s+", " "), F.lit(" ."))
    return p.select("set_id", "page_number", F.when(flat.rlike(r"^(N\.?T\.?S\.?|NOT TO SCALE|NO SCALE)$"), "NTS").otherwise(flat).alias("scale")) \
            .groupBy("set_id", "page_number", "scale").agg(F.count(F.lit(1)).alias("marks"))
