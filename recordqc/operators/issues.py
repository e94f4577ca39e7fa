"""Issue detection, synchronisation, de-duplication, import merges and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.functions import projects as X
from recordqc.operators.scale import join_back, ranked, running
from recordqc.session import written

C = F.col


def detect_issues(facts: DataFrame) -> DataFrame:
    """One row per rule a project breaks. Panels are asked for where the electrical service is known (``service_info``, if there is such a column)."""
    issue = lambda cond, d, cat, msg, sev: F.when(cond, F.struct(F.lit(d).alias("discipline"), F.lit(cat).alias("category"),
                                                                 F.lit(msg).alias("message"), F.lit(sev).alias("severity")))
    tons, units, pan = C("chosen").isNotNull(), C("unit_rows") > 0, C("panel_rows") > 0
    useful = tons | units | pan | F.coalesce(C("duct_feet") > 0, F.lit(False))
    mech = tons | units
    served = X.meaningful(C("service_info")) if "service_info" in facts.columns else F.lit(False)
    inc = "Equipment values incomplete"
    rules = F.array(
        issue(C("review_required"), "Mechanical", "Conflicting values", "Recorded project total and listed equipment sum require staff review.", "Warning"),
        issue(C("square_feet").isNull(), "General", "Square footage not shown", "Project square footage is not recorded.", "Warning"),
        issue(~useful, "General", inc, "No usable mechanical or electrical values are recorded.", "Blocking"),
        issue(~units & ~tons & (C("note") != ""), "Mechanical", inc,
              "Mechanical conditions are described in notes, but detailed equipment values are incomplete.", "Warning"),
        issue(C("canonical") == "Unknown", "General", "Consultant not identified", "MEP consultant is not identified.", "Warning"),
        issue(mech & ~C("has_manufacturer"), "Mechanical", inc, "Primary equipment manufacturer is not recorded.", "Note"),
        issue(mech & ~C("has_model"), "Mechanical", inc, "Primary equipment model is not recorded.", "Note"),
        issue(served & (C("panel_rows") == 0) & C("panel_count").isNull(), "Electrical", inc, "Electrical panel information is not recorded.", "Warning"),
        issue(C("excluded"), "General", "Project intentionally excluded from analysis",
              "Project is excluded from estimator and consultant statistics.", "Blocking"))
    return facts.select("project_id", "project_number", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("i")).select("project_id", "project_number", "i.*")


def validate(facts: DataFrame) -> DataFrame:
    """saved / warnings / blocking per project; a number that an earlier project has is blocking."""
    sev = detect_issues(facts).groupBy("project_id").agg(F.max(C("severity") == "Blocking").alias("b"), F.max(C("severity") == "Warning").alias("w"))
    dup = facts.groupBy(F.lower(F.trim("project_number")).alias("k")).agg(F.count(F.lit(1)).alias("same_number"), F.min("project_id").alias("first_id"))
    f = facts.withColumn("k", F.lower(F.trim("project_number")))
    j = join_back(f, dup, ["k"]).join(sev, "project_id", "left").fillna(False, ["b", "w"])
    missing = ~X.meaningful(C("project_number")) | ~X.meaningful(C("project_name"))
    return j.select("project_id", "same_number", F.when(missing | C("b") | (C("project_id") > C("first_id")), "blocking").when(C("w"), "warnings").otherwise("saved").alias("outcome"))


ISSUE_KEY = ["project_id", "discipline", "category", "message"]


def sync_issues(existing: DataFrame, detected: DataFrame) -> DataFrame:
    """Existing automatic issues against the detected ones: resolve, keep, reopen or insert. Manual issues are kept as they are."""
    e = existing.where("auto").groupBy(*ISSUE_KEY).agg(F.min("seq").alias("seq"), F.max_by("status", "seq").alias("status"))
    d = detected.select(*ISSUE_KEY, F.lit(True).alias("seen")).distinct()
    j = e.join(d, ISSUE_KEY, "full")
    gone = C("seen").isNull()
    action = (F.when(C("seq").isNull(), "insert").when(gone & (C("status") != "Resolved"), "resolve").when(gone, "keep")
              .when(C("status") == "Resolved", "reopen").otherwise("keep"))
    synced = j.withColumn("action", action).withColumn(
        "new_status", F.when(C("action").isin("insert", "reopen"), "Unresolved").when(C("action") == "resolve", "Resolved").otherwise(C("status"))).drop("seen")
    manual = existing.where(~F.coalesce("auto", F.lit(False))).select(*ISSUE_KEY, "seq", "status", F.lit("keep").alias("action"), C("status").alias("new_status"))
    return synced.unionByName(manual)


def _note_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), r"\s+"), lambda t: F.length(t) > 2))


def quality_status(projects: DataFrame, issues: DataFrame) -> DataFrame:
    per = issues.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("related"), F.count_if(C("status") != "Resolved").alias("open"),
        F.count_if((C("status") != "Resolved") & (C("severity") == "Blocking")).alias("blocking"),
        F.count_if((C("status") != "Resolved") & (C("severity") == "Warning")).alias("warning"))
    j = projects.join(per, "project_id", "left").fillna(0, ["related", "open", "blocking", "warning"])
    return j.select("project_id", F.when(C("excluded"), "Excluded").when(C("blocking") > 0, "Blocked").when(C("warning") > 0, "Warning")
                    .when((C("related") > 0) & (C("open") == 0), "Resolved").otherwise("Complete").alias("quality"))


def issue_view(issues: DataFrame, discipline: str = "", severity: str = "") -> DataFrame:
    """Unresolved first, then severity, then the newest; numbered over ranges."""
    out = issues
    if discipline:
        out = out.where(C("discipline") == discipline)
    if severity:
        out = out.where(C("severity") == severity)
    rank = F.when(C("severity") == "Blocking", 0).when(C("severity") == "Warning", 1).otherwise(2)
    out = out.withColumn("closed", (C("status") == "Resolved").cast("int")).withColumn("sev", rank)
    return ranked(out, [], ["closed", "sev", "-seq"], "position").drop("closed", "sev")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("discipline", "severity").agg(F.count(F.lit(1)).alias("issues"), F.count_if(C("status") != "Resolved").alias("unresolved"))


def live_issues(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """Issues whose project still exists by id, number or name."""
    i = issues.withColumn("num", F.lower(F.trim("project_number"))).withColumn("nam", F.lower(F.trim("project_name")))
    by = lambda col, key: i.join(projects.select(F.lower(F.trim(C(col).cast("string"))).alias(key)).distinct(), key, "left_semi").select("seq")
    i_id = i.withColumn("pid", C("project_id").cast("string"))
    ids = i_id.join(projects.select(C("project_id").cast("string").alias("pid")).distinct(), "pid", "left_semi").select("seq")
    keep = ids.union(by("project_number", "num")).union(by("project_name", "nam")).distinct()
    return issues.where(~C("project_name").startswith("total:")).join(keep, "seq", "left_semi")


def exportable_issues(issues: DataFrame, detected: DataFrame) -> DataFrame:
    """Drop total pseudo-projects; keep resolved issues and automatic ones that still apply."""
    d = detected.select(*ISSUE_KEY, F.lit(True).alias("still")).distinct()
    return issues.where(~C("project_name").startswith("total:")).join(d, ISSUE_KEY, "left") \
        .where((C("status") == "Resolved") | ~C("auto") | C("still")).drop("still")


def resolve(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply ``decisions(seq, decision, staff, at)`` and append them to the history."""
    j = issues.join(decisions, "seq", "left")
    entry = F.struct(C("decision").alias("action"), "staff", "at")
    hist = F.coalesce(C("history"), F.array().cast("array<struct<action:string,staff:string,at:bigint>>"))
    return j.withColumn("status", F.when(C("decision") == "resolve", "Resolved").when(C("decision") == "reopen", "Unresolved").otherwise(C("status"))) \
            .withColumn("history", F.when(C("decision").isNotNull(), F.concat(hist, F.array(entry))).otherwise(hist)).drop("decision", "staff", "at")


def apply_decisions(totals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Staff choice for a conflicting total."""
    j = totals.join(decisions, "project_id", "left")
    d = C("decision")
    value = (F.when(d == "stated", C("stated")).when(d == "calculated", C("calculated")).when(d == "corrected", C("corrected"))
             .when(d.isin("review", "exclude"), F.lit(None)).otherwise(C("chosen")))
    return j.select("project_id", value.cast("double").alias("chosen"),
                    F.when(d == "review", "Needs review").when(d.isNotNull(), "Manually confirmed").otherwise(C("verification")).alias("verification"),
                    F.coalesce(d == "exclude", F.lit(False)).alias("excluded_by_decision"))


COMPARED = ["project_name", "building_type", "consultant", "square_feet"]


def keyed(projects: DataFrame) -> DataFrame:
    return projects.withColumn("pkey", X.project_key(C("project_number"), C("project_name")))


def duplicate_keys(projects: DataFrame) -> DataFrame:
    return keyed(projects).groupBy("pkey").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq")).where("records > 1")


def project_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fields that differ between a saved and an incoming project, both meaningful.

    Every pair of records with one key is compared, so what a value needs is done once a record and not once a pair.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        fields = keyed(df).select("pkey", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), C(c).cast("string").alias(name)) for c in COMPARED])).alias("f")).select("pkey", "f.*")
        return fields.where(X.meaningful(C(name))).withColumn(f"{name}_low", F.lower(F.trim(name)))
    j = long(existing, "saved").join(long(incoming, "incoming"), ["pkey", "field"])
    return j.where("saved_low <> incoming_low").select("pkey", "field", "saved", "incoming")


def commit_import(existing: DataFrame, incoming: DataFrame, duplicate: str = "merge") -> DataFrame:
    """Next project table; ``duplicate`` is merge (fill gaps), replace or skip.

    Every pair of records with one key is a row, so whether a saved value stays is decided once a record and not once a pair.
    """
    e, i = keyed(existing), keyed(incoming)
    cols = ["project_number", *COMPARED]
    stays = lambda c: {"merge": C(c).isNotNull() if c == "square_feet" else X.meaningful(C(c)), "replace": F.lit(False), "skip": F.lit(True)}[duplicate]
    j = e.select("pkey", *[C(c).alias(f"e_{c}") for c in cols], *[stays(c).alias(f"stays_{c}") for c in cols], F.lit(True).alias("in_e")).join(
        i.select("pkey", *[C(c).alias(f"i_{c}") for c in cols], F.lit(True).alias("in_i")), "pkey", "full")
    pick = lambda c: F.when(C(f"stays_{c}") | C("in_i").isNull(), C(f"e_{c}")).otherwise(C(f"i_{c}")).alias(c)
    return j.select("pkey", *[pick(c) for c in cols], F.when(C("in_e").isNull(), "added").when(C("in_i").isNull(), "kept")
                    .otherwise({"merge": "merged", "replace": "replaced", "skip": "skipped"}[duplicate]).alias("outcome"))


def reconcile_sf(df: DataFrame) -> DataFrame:
    """Mechanical, electrical and project area; conflicting sources give null and a review flag."""
    m, e, p = C("mech_sf"), C("elec_sf"), C("project_sf")
    clash = F.coalesce((m > 0) & (e > 0) & (m != e), F.lit(False))
    return df.withColumn("square_feet", F.when(~clash, F.coalesce(F.when(m > 0, m), F.when(e > 0, e), F.when(p > 0, p)))).withColumn("sf_review", clash)


def recovery(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many missing areas and consultants the import supplies."""
    e = keyed(existing).select("pkey", C("square_feet").alias("e_sf"), C("consultant").alias("e_c"))
    i = keyed(incoming).select("pkey", C("square_feet").alias("i_sf"), C("consultant").alias("i_c"))
    return e.join(i, "pkey").agg(F.count_if(C("e_sf").isNull() & C("i_sf").isNotNull()).alias("recovered_sf"),
                                 F.count_if(~X.meaningful(C("e_c")) & X.meaningful(C("i_c"))).alias("recovered_consultant"))


def preview_summary(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Counts shown before an import: ready, warnings, duplicates in the batch or the store."""
    i = keyed(incoming)
    batch = i.groupBy("pkey").agg(F.count(F.lit(1)).alias("in_batch"))
    store = keyed(existing).select("pkey").distinct().withColumn("stored", F.lit(True))
    j = join_back(i, batch, ["pkey"]).join(store, "pkey", "left")
    dup = (C("in_batch") > 1) | C("stored").isNotNull()
    warn = C("square_feet").isNull() | ~X.meaningful(C("consultant"))
    return j.agg(F.count(F.lit(1)).alias("incoming"), F.count_if(~dup & ~warn).alias("ready"), F.count_if(warn).alias("with_warnings"),
                 F.count_if(dup).alias("duplicates"), F.count_if(C("excluded")).alias("excluded"))


def clear_discipline(facts: DataFrame, discipline: str) -> DataFrame:
    """Null out one discipline and drop projects that have nothing left."""
    mech = discipline == "Mechanical"
    out = facts.withColumn("tonnage", F.lit(None).cast("double") if mech else C("tonnage")) \
               .withColumn("panel_count", C("panel_count") if mech else F.lit(None).cast("bigint"))
    return out.where(C("has_elec") if mech else C("has_mech")).select("project_id", "tonnage", "panel_count")


# --- spreadsheet cells: rows arrive as sheet_cells(workbook, sheet, row, cells) ---

def unique_headers(headers: DataFrame) -> DataFrame:
    """Repeated header names get `` (n)``; ``headers(workbook, sheet, pos, name)``."""
    r = ranked(headers, ["workbook", "sheet", "name"], ["pos"], "n")
    return r.withColumn("header", F.when(C("n") == 1, C("name")).otherwise(F.concat("name", F.lit(" ("), C("n").cast("string"), F.lit(")")))).drop("n")


def split_blocks(rows: DataFrame) -> DataFrame:
    """Block number per row: a new block begins where the project number changes. Rows above the first number are block 0."""
    number = F.nullif(C("number"), F.lit(""))
    return running(rows, ["workbook", "sheet"], ["row"], project=("last", number), block=("changes", number))


def project_blocks(rows: DataFrame) -> DataFrame:
    """Every row with its project block; ``rows(workbook, sheet, row, number, mapped_number, mapped_name, is_total, has_data)``.

    ``number`` is a valid project number. A sheet in which no row has one is read by the texts mapped to project number or name instead (``strict`` is false there). A row above the first number
    is an orphan: block 0, no project. Where a block ends with a total row and a row of data without an identity behind it, that last row was written above its own
    project's number: it is ``carried`` into the next block.

    The block number comes from one ordered pass in which ranges carry their last number over. What is carried is decided on one row a block: its size, its last row and what stands before that.
    Blocks of one row only pass on a carried row if they got one. Null flags count as false; ``row`` is unique in its sheet; other columns are kept.
    """
    sheet, blank = ["workbook", "sheet"], lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    false = lambda c: F.coalesce(c, F.lit(False))
    strict = rows.groupBy(*sheet).agg(F.bool_or(blank("number").isNotNull()).alias("strict"))
    text = F.coalesce(blank("mapped_number"), blank("mapped_name"))
    r = join_back(rows, strict, sheet).withColumn("__id", F.coalesce(blank("number"), F.when(~C("strict"), text)))
    r = running(r, sheet, ["row"], project=("last", "__id"), block=("changes", "__id"), __above=("lag", false(C("is_total"))))
    last = F.max(F.struct(C("row").alias("row"), false(C("__above")).alias("above"), text.isNotNull().alias("named"), false(C("has_data")).alias("data"))).alias("last")
    b = r.where("block > 0").groupBy(*sheet, "block").agg(F.count(F.lit(1)).alias("size"), F.max("project").alias("own"), last)
    loose = C("last.above") & ~C("last.named") & C("last.data")
    b = running(b.withColumn("loose", loose), sheet, ["block"], large=("max", F.when(C("size") > 1, C("block"))), fixed=("max", F.when(~C("loose"), C("block"))))
    moved = b.where(C("loose") & (C("large") > F.coalesce("fixed", F.lit(0)))).select(*sheet, "block", C("last.row").alias("row"))
    to = b.select(*sheet, (C("block") - 1).alias("block"), C("own").alias("__to"))
    got = r.join(moved.join(to, [*sheet, "block"]), [*sheet, "block", "row"], "left")
    carried = C("__to").isNotNull()
    return got.withColumns({"project": F.coalesce("__to", "project"), "block": C("block") + carried.cast("int"), "carried": carried, "orphan": C("block") == 0}).drop("__to", "__id", "__above")


def block_totals(blocks: DataFrame) -> DataFrame:
    """Per block: rows, first total row and the sum of its listed values; orphans are block 0."""
    total = F.upper(F.trim("label")).rlike("^(GRAND )?TOTALS?\\b")
    return blocks.groupBy("workbook", "sheet", "block").agg(
        F.max("project").alias("project"), F.count(F.lit(1)).alias("rows"), F.count_if(total).alias("total_rows"),
        F.sum(F.when(~total, C("value"))).alias("listed"), F.min_by("value", F.when(total, C("row"))).alias("stated"))
