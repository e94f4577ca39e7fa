"""Sheet identities: which number each page of a set carries, by its title block, page label, place in the index and title words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.functions import sheets as X
from recordqc.operators.scale import join_back, running
from recordqc.session import written

C = F.col
# Sources of numbers that were inferred, reach of a title clue, ink that a drawn number needs by prefix, and the texts of decisions.
INFERRED = ("page_label_index_match", "page_label_visual_match", "sheet_index_position", "sheet_index_visual_match", "title_clue_visual_match")
REACH = 3
HEAVY_INK = ("C", "S", "SD")
LIGHT_INK = ("AD", "AS", "D", "E", "ED", "EL", "EP", "ES", "FP", "FA", "FS", "I", "ID", "IR", "M", "MD", "MG", "MP", "MS", "P", "PD", "MEP", "MEPD")
CLUES = (("ELECTRICAL", "ED"), ("PLUMBING", "PD"), ("MECHANICAL", "MD"), ("ARCHITECTURAL", "AD"))
REASONS = {
    "cover": "Secondary cover matched a cover entry at the same sheet-index position.",
    "ignored": "Secondary cover page is excluded from sheet-index sheet-number checks.",
    "label_visual": "PDF page label matched the sheet index and visual sheet-number glyphs were detected in the title block.",
    "label_only": "Sheet number was inferred from the PDF page label/index, but no physical title-block number was confirmed.",
    "clue_visual": "Sheet number was matched from strong title text clues and nearby sheet-index entry with visual title-block glyphs.",
    "position_visual": "Sheet number matched the same sheet-index position and visual sheet-number glyphs were detected in the title block.",
    "position_only": "Sheet number was inferred from sheet-index position only.",
    "clue": "Detected title-block context was reconciled to a nearby sheet-index entry using strong title text clues.",
    "position": "Detected title-block number was reconciled to the sheet index position.",
    "title_block": "Physical title-block sheet number was detected with sufficient confidence.",
    "none": "No matching sheet-index position was available for this page."}


def _blank(c) -> Column:
    return F.coalesce(c, F.lit(""))


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _prefix(number: Column) -> Column:
    return F.regexp_extract(number, "^([A-Z]+)", 1)


def _ignorable() -> Column:
    up = F.upper(_blank("sheet_number"))
    return _false(C("cover_type") == "secondary") & ~up.rlike(r"^(?:B[- ]?\d+(?:\.\d+)?|C[- ]?0(?:\.0+)?)$")


def _drawn(number: Column) -> Column:
    """Whether the title block shows a drawn sheet number, by its detector or by enough ink for the expected prefix."""
    p = _prefix(number)
    ink = lambda dark, all_: (C("dark_pixels") >= dark) & (C("ink_pixels") >= all_)
    return _false((C("visual_present") & (C("visual_confidence") >= 70)) | (p.isin(*HEAVY_INK) & ink(1800, 2200)) | (p.isin(*LIGHT_INK) & ink(850, 1200)))


def _labelled(number: Column, firms: str) -> Column:
    """Whether the page label names the number. ``SI`` reads as ``S1`` on a page of structural general notes."""
    context = F.upper(F.concat_ws("\n", "label_text", "title_block_text", "text"))
    read = (C("label") == "SI") & (number == "S1") & context.rlike(r"\bGENERAL\s+NOTES\b") & context.rlike(rf"\b(?:STRUCTURAL{firms})\b")
    civil = number.isin("CS", "COVER") & F.upper(_blank("label_text")).rlike(r"\bCIVIL\b")
    return _false(~civil & (((C("label") != "") & (C("label") == number)) | read))


def _entries(index: DataFrame) -> DataFrame:
    i = index.select("set_id", C("index_position").cast("bigint").alias("position"), C("sheet_number").alias("shown"), _blank("sheet_name").alias("name"),
                     F.coalesce(C("confidence").cast("double"), F.lit(0.0)).alias("sure"), X.normalize_number(C("sheet_number")).alias("number"))
    return i.where("number <> ''").withColumn("e", F.struct("position", "shown", "name", "sure", "number"))


def reconcile(pages: DataFrame, index: DataFrame, firms: tuple[str, ...] = ()) -> DataFrame:
    """One decision a page: number, name, confidence, source, whether the printed number is missing, reason and evidence.

    Clues are, in this order: title words that point to an entry of their discipline within ``REACH`` positions of the page; the entry at the page's position,
    not counting secondary covers before it; and, over both, a page label that the index has and a drawn number confirms. A title block that was read well stays,
    unless all pages of the set are aligned with the index and it disagrees.

    Title clues look at seven positions by equality, so no range join is planned; only pages with such words take part. Positions come from a running count that does not put a
    set into one task. Pages of sets without an index stay as they are, without a decision. Null fields count as empty; ``(set_id, page_number)`` identifies a page, of entries with
    one number or one position the last counts. Extra columns are dropped. ``firms`` are patterns of structural engineers' names.
    """
    p = pages.select("set_id", "page_number", "sheet_number", "sheet_name", "title_block_text", "text", "confidence", "needs_review", "sheet_source", "cover_type", "is_cover",
                     "label_number", "label_text", "label_confidence", "visual_present", "visual_confidence", "dark_pixels", "ink_pixels")
    inferred = _blank("sheet_source").isin(*INFERRED)
    context = F.regexp_replace(F.upper(F.concat(_blank("title_block_text"), F.lit(" "), F.when(inferred, "").otherwise(_blank("sheet_name")))), r"\s+", " ")
    demo = C("context").rlike(r"\bDEMOLITION\b|\bDEMO\b")
    clue = F.coalesce(*[F.when(demo & C("context").rlike(rf"\b{word}\b"), prefix) for word, prefix in CLUES], F.when(C("context").rlike(r"\bACCESSIBILITY\b|\bADA\b"), "ADA"))
    cover = _false(C("is_cover")) | (_blank("cover_type") != "")
    p = p.withColumns({"context": context, "secondary": _ignorable(), "inferred": inferred, "label": X.normalize_number(C("label_number")), "own": X.normalize_number(C("sheet_number"))}) \
        .withColumn("clue", F.when(~cover, clue))
    key = ["set_id", "page_number"]
    placed = running(p.select(*key, C("secondary").cast("bigint").alias("skip")), ["set_id"], ["page_number"], before=("sum_before", "skip")) \
        .select(*key, (C("page_number") - F.coalesce("before", F.lit(0))).alias("position"))

    entries = written(_entries(index), "entries")
    last = lambda by, name: entries.groupBy("set_id", by).agg(F.max("e").alias(name))
    at, numbered = last("position", "at"), last("number", "named").withColumnRenamed("number", "label")
    beside = p.where("clue is not null").select(*key, C("clue").alias("prefix"), F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))).alias("off")) \
        .withColumn("position", C("page_number") + C("off"))
    near = beside.join(entries.withColumn("prefix", _prefix(C("number"))), ["set_id", "prefix", "position"]) \
        .groupBy(*key).agg(F.min_by("e", F.struct(F.abs("off").alias("d"), C("position").alias("p"))).alias("clued"))
    found = placed.join(at, ["set_id", "position"], "left")
    aligned = found.groupBy("set_id").agg(F.bool_and(C("at").isNotNull()).alias("aligned"))
    j = p.join(found, key).join(near, key, "left").join(numbered, ["set_id", "label"], "left")
    j = join_back(join_back(j, aligned, ["set_id"]), entries.groupBy("set_id").agg(F.lit(True).alias("indexed")), ["set_id"])

    firm = "".join("|" + f for f in firms)
    accessible = C("context").rlike(r"\bACCESSIBILITY\b|\bADA\b")
    j = j.withColumn("at", F.when(~(C("clued").isNull() & accessible & (_prefix(C("at.number")) == "AD")), C("at")))
    conflict = (C("label") != "") & _false(C("label_confidence") >= 90) & ~_labelled(C("at.number"), firm) & (_prefix(C("label")) != "") & (_prefix(C("at.number")) != "") \
        & (_prefix(C("label")) != _prefix(C("at.number")))
    barred = C("clued").isNull() & C("named").isNull() & _false(conflict)
    by_label = C("named").isNotNull() & _labelled(C("named.number"), firm) & _drawn(C("named.number"))
    j = j.withColumn("want", F.when(by_label, C("named")).otherwise(F.coalesce("clued", F.when(~barred, C("at")))))

    want, has_want = C("want.number"), C("want").isNotNull()
    index_cover = _false(~F.upper("want.shown").rlike(r"^C[- ]?0(?:\.0+)?$") & ~F.upper("want.shown").startswith("CS-") & F.upper("want.name").rlike(r"\bCOVER\s+SHEET\b"))
    current = F.when(C("inferred"), "").otherwise(C("own"))
    sure = F.coalesce(C("confidence").cast("double"), F.lit(0.0))
    weak = _false(C("needs_review")) | (current == "") | (sure < 60) | (C("aligned") & (current != want))
    drawn, labelled = _drawn(want), _labelled(want, firm)
    alone = (want == "ADA") & _false(C("visual_present") & (C("visual_confidence") >= 70)) & (C("page_number") > 1) & ~cover
    by_clue, by_place = (C("clued").isNotNull() & drawn) | alone, C("aligned") & drawn & (C("position") == C("want.position"))
    step = (F.when(~_false(C("indexed")), F.lit(None))
            .when(C("secondary"), F.when(has_want & index_cover, "cover").otherwise("ignored"))
            .when(~has_want, "none").when(~weak, "title_block")
            .when(current != "", F.when(C("clued").isNotNull(), "clue").otherwise("position"))
            .when(labelled, F.when(drawn, "label_visual").otherwise("label_only"))
            .when(by_clue, "clue_visual").when(by_place, "position_visual").otherwise("position_only"))
    j = j.withColumn("step", step)
    kept = F.coalesce(F.when(C("sheet_source") != "", C("sheet_source")), F.lit("title_block"))
    source = (F.when(C("step").isin("cover", "position", "position_only"), "sheet_index_position").when(C("step") == "ignored", "ignored_secondary_cover")
              .when(C("step") == "label_visual", "page_label_visual_match").when(C("step") == "label_only", "page_label_index_match")
              .when(C("step").isin("clue", "clue_visual"), "title_clue_visual_match").when(C("step") == "position_visual", "sheet_index_visual_match")
              .when(C("step").isNotNull(), kept))
    takes = ~F.coalesce(C("step").isin("ignored", "none", "title_block"), F.lit(True))
    dropped = (C("step") == "none") & C("inferred")
    j = j.withColumns({
        "source": source,
        "final": F.when(takes, C("want.shown")).when(dropped, "").otherwise(_blank("sheet_number")),
        "final_name": F.when(takes & (C("want.name") != ""), C("want.name")).when(dropped, "").otherwise(_blank("sheet_name")),
        "final_confidence": F.when(takes, F.greatest(sure, "want.sure")).when(dropped, 0.0).otherwise(sure),
        "review": F.when(takes, False).when(dropped, True).otherwise(_false(C("needs_review")))})
    empty = X.normalize_number(C("final")) == ""
    missing = F.when(C("step").isin("label_only", "position_only"), True).when(C("step") == "none", empty).when(C("step").isNotNull(), False)
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    shown = X.normalize_number(C("final"))
    evidence = F.struct(
        F.when(C("step") == "title_block", C("want.shown")).when(~C("step").isin("none", "ignored"), C("at.shown")).alias("position_number"),
        F.when(C("step") != "ignored", C("named.shown")).alias("label_entry"),
        F.when(C("step") == "ignored", _false(C("visual_present"))).otherwise(_drawn(shown)).alias("drawn"),
        ((C("step") != "ignored") & _labelled(shown, firm)).alias("label_matches"),
        (~C("source").isin(*INFERRED) & (X.normalize_number(F.when(C("step") == "none", C("final")).otherwise(_blank("sheet_number"))) != "")).alias("trusted"))
    decided = F.when(C("step").isNotNull(), F.struct(C("source"), missing.alias("missing"), F.try_element_at(reasons, C("step")).alias("reason"), evidence.alias("evidence")))
    return j.select("set_id", "page_number", C("final").alias("sheet_number"), C("final_name").alias("sheet_name"), C("final_confidence").alias("confidence"), C("review").alias("needs_review"),
                    F.when(takes, C("source")).otherwise(_blank("sheet_source")).alias("sheet_source"), F.when(missing & (C("step") != "none"), C("final")).alias("inferred_number"),
                    (_false(C("step") == "ignored")).alias("ignored"), decided.alias("decision"))
