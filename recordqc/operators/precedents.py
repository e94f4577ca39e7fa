"""Project facts, comparable projects, range estimates and consultant statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.functions import projects as X
from recordqc.operators.scale import first_per, join_back, percentiles, running, top_k
from recordqc.session import written

C = F.col
SCOPES = ["Mechanical", "Electrical", "Mechanical + Electrical"]


def canonicalize(projects: DataFrame) -> DataFrame:
    """Every spelling of a consultant shows the display name seen first."""
    p = projects.withColumn("display", X.consultant_name(C("consultant")))
    p = p.withColumn("ckey", X.consultant_key(C("display")))
    names = p.groupBy("ckey").agg(F.min_by("display", "seq").alias("canonical"))
    return join_back(p, names, ["ckey"]).drop("display")


def choose_metric(sums: DataFrame, stated: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Stated against calculated total: value, verification status and conflict."""
    s = stated.groupBy("project_id").agg(F.min_by("stated", "seq").alias("stated"), F.count_distinct("stated").alias("n_stated"))
    j = sums.select("project_id", C("calc_tons").alias("calculated")).join(s, "project_id", "full")
    st, ca = C("stated").isNotNull(), C("calculated").isNotNull()
    close = (C("n_stated") == 1) & (F.abs(C("stated") - C("calculated")) <= tolerance)
    return j.select("project_id", "stated", "calculated", F.coalesce("stated", "calculated").alias("chosen"),
                    F.when(st & ca & close, "Verified").when(st & ca, "Needs review").when(st, "Stated total").when(ca, "Calculated")
                    .otherwise("Unknown").alias("verification"), F.coalesce(st & ca & ~close, F.lit(False)).alias("conflict"))


def unit_sums(units: DataFrame) -> DataFrame:
    q = F.greatest(F.lit(1), F.coalesce(C("quantity"), F.lit(1)))
    return units.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("unit_rows"), F.sum(q).cast("bigint").alias("unit_count"), F.sum(C("tonnage") * q).alias("calc_tons"),
        F.sum(C("duct_feet") * q).alias("duct_feet"), F.max(X.meaningful(C("manufacturer"))).alias("has_manufacturer"),
        F.max(X.meaningful(C("model"))).alias("has_model"), F.max(X.meaningful(C("type"))).alias("has_type"),
        F.count_if(C("classification").rlike("(?i)custom|unusual")).alias("custom_units"))


def project_facts(projects: DataFrame, units: DataFrame, panels: DataFrame, stated: DataFrame) -> DataFrame:
    """One row per project with the values every analysis starts from."""
    us = unit_sums(units)
    m = choose_metric(us, stated)
    ps = panels.groupBy("project_id").agg(F.count(F.lit(1)).alias("panel_rows"),
                                          F.sum(F.greatest(F.lit(1), F.coalesce(C("quantity"), F.lit(1)))).cast("bigint").alias("panel_count"))
    out = (canonicalize(projects).join(us, "project_id", "left").join(m.drop("calculated"), "project_id", "left").join(ps, "project_id", "left"))
    zero = {c: 0 for c in ("unit_rows", "panel_rows", "custom_units")}
    out = out.fillna(zero).fillna(False, ["has_manufacturer", "has_model", "has_type", "conflict"])
    return out.withColumn("tonnage", F.when(~C("conflict"), C("chosen"))).withColumn(
        "has_mech", (C("unit_rows") > 0) | C("chosen").isNotNull()).withColumn("has_elec", C("panel_rows") > 0)


def safe_totals(facts: DataFrame) -> DataFrame:
    """Tonnage that equals the floor area or is 20 times the calculated sum is not trusted."""
    t, sf, ca = C("chosen"), C("square_feet"), C("calc_tons")
    bad = (F.abs(t - sf) <= 0.001) | ((ca > 0) & (t > ca * 20))
    return facts.withColumn("safe_tonnage", F.when(t.isNull() | F.coalesce(bad, F.lit(False)), F.coalesce(ca, C("stated"))).otherwise(t))


def eligible(facts: DataFrame, scope: str) -> DataFrame:
    hit = {"Mechanical": C("has_mech"), "Electrical": C("has_elec")}.get(scope, C("has_mech") | C("has_elec"))
    return facts.where(hit & ~C("excluded") & ~C("review_required"))


def _by_scope(facts: DataFrame, ranking: bool) -> DataFrame:
    hits = {"Mechanical": C("has_mech"), "Electrical": C("has_elec"), "Mechanical + Electrical": C("has_mech") | C("has_elec")}
    scopes = F.filter(F.array(*[F.when(h, F.lit(s)) for s, h in hits.items()]), lambda x: x.isNotNull())
    ok = ~C("excluded") & ~C("review_required") if ranking else ~C("excluded")
    return facts.where(ok).withColumn("scope", F.explode(scopes))


def _groups(df: DataFrame, both: Column, type_col: Column, cons: Column) -> DataFrame:
    """Rows once per (type or any, consultant or any) group."""
    g = lambda t, c: F.struct(t.alias("gt"), c.alias("gc"))
    any_ = F.lit("*")
    return df.withColumn("both", both).withColumn("g", F.explode(F.array(g(type_col, cons), g(type_col, any_), g(any_, cons), g(any_, any_)))) \
             .select("*", "g.gt", "g.gc").drop("g")


def _nearest(facts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Eligible projects once for each of their scopes, without those that cannot be among the ``k`` nearest of any request.

    The areas that are asked for cut the axis into slots. A slot lies on one side of every request, so of its projects
    with the same flags, type and consultant only the ``k`` at either end can be near enough. Types and consultants that
    nobody asks for are null here: they match no request. What is left has a size that the requests decide, not the projects.
    """
    p = facts.where(~C("excluded") & ~C("review_required") & (C("has_mech") | C("has_elec"))).select(
        "project_id", "project_name", F.coalesce("square_feet", F.lit(0.0)).alias("sf"), "has_mech", "has_elec",
        F.lower(X.clean(C("building_type"))).alias("t"), X.consultant_key(C("canonical")).alias("c"))
    for name in ("t", "c"):
        p = p.join(asked.select(name, F.lit(True).alias("wanted")).distinct(), name, "left").withColumn(name, F.when(C("wanted"), C(name))).drop("wanted")
    bounds = asked.where("sf is not null").select("sf").distinct().withColumn("bound", F.lit(1))
    rows = p.withColumn("bound", F.lit(0)).unionByName(bounds, allowMissingColumns=True)
    placed = written(running(rows, [], ["sf", "bound", "project_name", "project_id"], at=("row_number", None), slot=("sum", "bound")).where("bound = 0").drop("bound"), "slots")
    cell = ["has_mech", "has_elec", "t", "c", "slot"]
    low, high = (top_k(placed, cell, [f"{way}sf", "project_name", "project_id"], k).drop("rn") for way in ("", "-"))
    return _by_scope(written(low.unionByName(high).dropDuplicates(["at"]), "nearest").withColumns({"excluded": F.lit(False), "review_required": F.lit(False)}), True)


def rank_similar(requests: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most similar projects of each request, without pairing all of them.

    Inside one (scope, type match, consultant match) group the score falls with
    the distance in floor area, so the winners are among the ``k`` nearest on
    either side. They are found by position in the group ordered by area, to
    which only the rows go that ``_nearest`` leaves. ``facts`` is read once.
    """
    key = ["scope", "both", "gt", "gc"]
    r = written(requests.select("request_id", "scope", C("square_feet").alias("sf"), F.lower(X.clean(C("building_type"))).alias("t"), X.consultant_key(C("consultant")).alias("c")), "requests")
    p = _nearest(facts, r, k)
    pg = _groups(p, (C("scope") == SCOPES[2]) & C("has_mech") & C("has_elec"), C("t"), C("c"))
    rg = _groups(r.withColumn("b", F.explode(F.array(F.lit(False), F.lit(True)))), C("b"), C("t"), C("c"))
    pg = pg.join(rg.select(*key).distinct(), key, "left_semi")
    rows = pg.select(*key, "sf", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("request_id"), "project_id", "project_name", "t", "c").unionByName(
        rg.select(*key, "sf", F.lit(1).alias("kind"), "request_id", F.lit(None).cast("bigint").alias("project_id"), F.lit(None).cast("string").alias("project_name"), "t", "c"))
    is_p = F.when(C("kind") == 0, 1).otherwise(0)
    found = None
    for tie, offsets in (("-", range(-k + 1, 1)), ("", range(1, k + 1))):
        placed = running(rows, key, ["sf", "kind", f"{tie}project_name", f"{tie}project_id"], pos=("sum", is_p))
        want = placed.where("kind = 1").select(*key, "request_id", C("sf").alias("r_sf"), C("t").alias("r_t"), C("c").alias("r_c"),
                                               F.explode(F.array(*[F.lit(i) for i in offsets])).alias("o"), "pos").withColumn("pos", C("pos") + C("o"))
        have = placed.where("kind = 0").select(*key, "pos", "project_id", "project_name", "sf", "t", "c")
        got = want.join(have, [*key, "pos"]).select("request_id", "scope", "both", "r_sf", "r_t", "r_c", "project_id", "project_name", "sf", "t", "c")
        found = got if found is None else found.unionByName(got)
    found = found.distinct()
    delta = F.abs(C("sf") - C("r_sf"))
    size = F.when(C("sf") > 0, F.greatest(F.lit(0.0), (1 - F.least(delta / C("r_sf"), F.lit(1.0))) * 30)).otherwise(0.0)
    same_t, same_c = (C("r_t") != "") & (C("t") == C("r_t")), (C("r_c") != "") & (C("c") == C("r_c"))
    score = X.one_decimal(F.when(same_t, 50).otherwise(0) + F.when(same_c, 30).otherwise(0) + size + F.when(C("both"), 5).otherwise(0))
    near = delta / C("r_sf")
    reasons = F.concat_ws("; ", F.when(same_t, "same building type"), F.when(same_c, "same consultant"),
                          F.when(C("sf") > 0, F.when(near <= 0.15, "very similar square footage").when(near <= 0.35, "similar square footage")
                                 .otherwise("closest available size")))
    scored = found.withColumn("score", score).withColumn("delta", delta).withColumn("reasons", reasons)
    return top_k(scored, ["request_id"], ["-score", "delta", "project_name", "project_id"], k, "rank").select(
        "request_id", "rank", "project_id", "score", "reasons")


def similar_consultants(ranked: DataFrame, facts: DataFrame, n: int = 3) -> DataFrame:
    j = ranked.join(facts.select("project_id", "ckey", "canonical"), "project_id").where("canonical <> 'Unknown'")
    counts = j.groupBy("request_id", "ckey").agg(F.count(F.lit(1)).alias("projects"), F.min("canonical").alias("consultant"))
    return top_k(counts, ["request_id"], ["-projects", "consultant"], n, "rank").select("request_id", "rank", "consultant", "projects")


def ratios() -> dict[str, Column]:
    """The four planning ratios; null where a part is missing."""
    sf = C("square_feet")
    per = lambda ok, value: F.when((sf > 0) & ok, value)
    return {"sf_ton": per(C("tonnage") > 0, sf / C("tonnage")), "duct_sf": per(C("duct_feet").isNotNull(), C("duct_feet") / sf),
            "sf_unit": per(C("unit_rows") > 0, sf / C("unit_rows")), "sf_panel": per(C("panel_count") > 0, sf / C("panel_count"))}


def comparable_groups(facts: DataFrame) -> DataFrame:
    p = _by_scope(facts, False)
    return _groups(p, F.lit(False), C("building_type"), X.consultant_key(C("canonical")))


def comparable_set(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Per request the first non-empty of the four stages and its number of projects."""
    sizes = comparable_groups(facts).groupBy("scope", "gt", "gc").agg(F.count(F.lit(1)).alias("projects"))
    t, c = C("building_type"), X.consultant_key(C("consultant"))
    st = lambda level, gt, gc, ok: F.when(ok, F.struct(F.lit(level).alias("level"), gt.alias("gt"), gc.alias("gc")))
    any_ = F.lit("*")
    stages = F.filter(F.array(st(0, t, c, (t != "") & (c != "")), st(1, t, any_, t != ""), st(2, any_, c, c != ""), st(3, any_, any_, F.lit(True))),
                      lambda x: x.isNotNull())
    r = requests.withColumn("s", F.explode(stages)).select("request_id", "scope", "square_feet", "s.*")
    hit = r.join(sizes, ["scope", "gt", "gc"], "left").where(C("projects").isNotNull() | (C("level") == 3))
    return first_per(hit, ["request_id"], ["level"]).withColumn("projects", F.coalesce("projects", F.lit(0)))


def estimate(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Median-ratio estimate with range and confidence.

    Percentiles are taken once per comparable group; a request only looks up
    the group of its first non-empty stage.
    """
    chosen = comparable_set(requests, facts)
    g = comparable_groups(facts).join(chosen.select("scope", "gt", "gc").distinct(), ["scope", "gt", "gc"], "left_semi")
    long = g.select("scope", "gt", "gc", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in ratios().items()])).alias("m")) \
            .select("scope", "gt", "gc", "m.*")
    q = percentiles(long, ["scope", "gt", "gc", "metric"], "value", {"p0": 0, "p25": .25, "p50": .5, "p75": .75, "p100": 1}, "n")
    wide = q.groupBy("scope", "gt", "gc").agg(*[F.max(F.when(C("metric") == m, F.struct("n", "p0", "p25", "p50", "p75", "p100"))).alias(m) for m in ratios()])
    e = chosen.join(wide, ["scope", "gt", "gc"], "left")
    sf = C("square_feet")
    lo = lambda m: F.when(C(f"{m}.n") >= 4, C(f"{m}.p25")).otherwise(C(f"{m}.p0"))
    hi = lambda m: F.when(C(f"{m}.n") >= 4, C(f"{m}.p75")).otherwise(C(f"{m}.p100"))
    whole = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(1), X.js_round(x))).cast("bigint")
    n = lambda m: F.coalesce(C(f"{m}.n"), F.lit(0))
    sample = F.when(C("scope") == "Mechanical", n("sf_ton")).when(C("scope") == "Electrical", n("sf_panel")).otherwise(F.least(n("sf_ton"), n("sf_panel")))
    return e.select("request_id", C("level").cast("bigint").alias("level"), "projects", X.round_half(sf / C("sf_ton.p50")).alias("tonnage"),
                    X.round_half(sf / hi("sf_ton")).alias("tonnage_low"), X.round_half(sf / lo("sf_ton")).alias("tonnage_high"),
                    X.round_ten(sf * C("duct_sf.p50")).cast("bigint").alias("duct_feet"), whole(sf / C("sf_unit.p50")).alias("units"),
                    whole(sf / C("sf_panel.p50")).alias("panels"), whole(sf / hi("sf_panel")).alias("panels_low"),
                    whole(sf / lo("sf_panel")).alias("panels_high"), sample.alias("sample"),
                    F.when((sample >= 8) & (C("level") <= 1), "High").when((sample >= 3) & (C("level") <= 2), "Moderate").otherwise("Low").alias("confidence"))


def _top_values(df: DataFrame, key: str, value: str, n: int, name: str) -> DataFrame:
    counts = df.where(X.meaningful(C(value))).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    top = top_k(counts, [key], ["-c", value], n)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", C(value).alias("v")))), lambda s: s["v"]), ", ").alias(name))


def consultant_stats(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Totals, medians, means, top systems and makers, percent missing per consultant."""
    missing = sum((F.when(~X.meaningful(C(c)), 1).otherwise(0) for c in ("project_number", "project_name", "building_type")), F.lit(0)) \
        + sum((F.when(C(c).isNull(), 1).otherwise(0) for c in ("square_feet", "tonnage", "panel_count")), F.lit(0))
    base = facts.groupBy("ckey").agg(
        F.first("canonical").alias("consultant"), F.count(F.lit(1)).alias("projects"), F.sum("square_feet").alias("total_sf"), F.min("square_feet").alias("min_sf"),
        F.max("square_feet").alias("max_sf"), F.avg(F.when(C("has_mech"), C("unit_rows"))).alias("mean_units"), F.avg("panel_count").alias("mean_panels"),
        F.sum("custom_units").alias("custom_units"), (F.sum(missing) * 100.0 / (F.count(F.lit(1)) * 6)).alias("missing_percent"))
    long = facts.select("ckey", F.explode(F.array(
        F.struct(F.lit("sf").alias("m"), C("square_feet").alias("v")), F.struct(F.lit("ton").alias("m"), C("tonnage").alias("v")),
        F.struct(F.lit("ratio").alias("m"), ratios()["sf_ton"].alias("v")))).alias("x")).select("ckey", "x.m", "x.v")
    med = percentiles(long, ["ckey", "m"], "v", {"p": .5}).groupBy("ckey").agg(
        *[F.max(F.when(C("m") == m, C("p"))).alias(f"median_{m}") for m in ("sf", "ton", "ratio")])
    u = units.join(facts.select("project_id", "ckey"), "project_id")
    return (base.join(med, "ckey", "left").join(_top_values(u, "ckey", "type", 3, "systems"), "ckey", "left")
            .join(_top_values(u, "ckey", "manufacturer", 3, "manufacturers"), "ckey", "left"))


def electrical_stats(facts: DataFrame, panels: DataFrame) -> DataFrame:
    """Panels, amp ranges, load medians and the first disconnects per consultant."""
    p = panels.join(facts.where("not excluded").select("project_id", "ckey"), "project_id")
    per_project = facts.where("not excluded and panel_count > 0").select("ckey", "panel_count")
    base = p.groupBy("ckey").agg(F.min("amps").alias("min_amps"), F.max("amps").alias("max_amps"), F.min("disconnect_amps").alias("min_disconnect"),
                                 F.max("disconnect_amps").alias("max_disconnect"), F.count_if(C("amps").isNull() & C("load_kva").isNull()).alias("unusable"))
    mean = per_project.groupBy("ckey").agg(F.avg("panel_count").alias("mean_panels"))
    med = percentiles(per_project.withColumn("v", C("panel_count").cast("double")), ["ckey"], "v", {"median_panels": .5})
    kva = percentiles(p, ["ckey"], "load_kva", {"median_kva": .5})
    names = p.where("disconnect_name <> ''").groupBy("ckey", "disconnect_name").agg(F.min(F.struct("project_id", "seq")).alias("at"))
    first = top_k(names, ["ckey"], [C("at").asc()], 3).groupBy("ckey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "disconnect_name"))), lambda s: s["disconnect_name"]), ", ").alias("disconnects"))
    return base.join(mean, "ckey", "left").join(med, "ckey", "left").join(kva, "ckey", "left").join(first, "ckey", "left")


def consultant_summary(facts: DataFrame) -> DataFrame:
    """Medians, means and building types by the consultant text as recorded."""
    e = facts.where("not excluded").withColumn("raw", F.when(X.meaningful(C("consultant")), F.trim("consultant")).otherwise("Unknown"))
    base = e.groupBy("raw").agg(F.count(F.lit(1)).alias("projects"), F.avg("square_feet").alias("mean_sf"), F.avg("tonnage").alias("mean_tons"),
                                F.array_join(F.array_sort(F.collect_set("building_type")), ", ").alias("building_types"))
    return base.join(percentiles(e, ["raw"], "square_feet", {"median_sf": .5}), "raw", "left")


def portfolio(facts: DataFrame) -> DataFrame:
    one = facts.withColumn("one", F.lit(1)).withColumn("ratio", ratios()["sf_ton"])
    base = one.groupBy("one").agg(F.count(F.lit(1)).alias("projects"), F.sum("square_feet").alias("total_sf"),
                                  F.count_distinct(F.when(C("canonical") != "Unknown", C("ckey"))).alias("consultants"))
    return base.join(percentiles(one, ["one"], "ratio", {"median_sf_ton": .5}), "one", "left").drop("one")


def latest_projects(facts: DataFrame, n: int = 5) -> DataFrame:
    return facts.orderBy(C("seq").desc()).limit(n).select("project_id", "project_number", "project_name")


def attention(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count_if("review_required").alias("needs_review"), F.count_if(C("canonical") == "Unknown").alias("missing_consultant"),
                     F.count_if(C("square_feet").isNull()).alias("missing_sf"), F.count_if(~C("has_elec")).alias("missing_electrical"),
                     F.count_if(~C("excluded") & ~C("review_required") & (C("has_mech") | C("has_elec"))).alias("usable"))


def filter_projects(facts: DataFrame, units: DataFrame, text: str = "", building_type: str = "", consultant: str = "", unit_type: str = "",
                    custom_only: bool = False) -> DataFrame:
    out = facts
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "project_number", "project_name", "building_type", "canonical")), F.lit(text.lower())))
    if building_type:
        out = out.where(C("building_type") == building_type)
    if consultant:
        out = out.where(C("ckey") == consultant.lower())
    if unit_type:
        out = out.join(units.where(C("type") == unit_type).select("project_id"), "project_id", "left_semi")
    if custom_only:
        out = out.where("custom_units > 0")
    return out


def project_warnings(facts: DataFrame) -> DataFrame:
    w = F.array_distinct(F.filter(F.array(
        F.when(C("square_feet").isNull(), "Missing overall square footage."), F.when(C("canonical") == "Unknown", "Missing consultant."),
        F.when(C("has_mech") & C("tonnage").isNull(), "Missing total tonnage."), F.when(~C("has_elec"), "Missing electrical data."),
        F.when(C("note") != "", C("note"))), lambda x: x.isNotNull()))
    return facts.select("project_id", F.array_join(w, "; ").alias("warnings"), F.size(w).cast("bigint").alias("n")).where("n > 0")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(X.meaningful(C(col))).select(col).distinct().orderBy(col)


def availability(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Eight analytical uses with reasons and the data status of every project."""
    iss = issues.groupBy("project_id").agg(F.count(F.lit(1)).alias("related"), F.count_if(C("status") != "Resolved").alias("open"))
    f = facts.join(iss, "project_id", "left").fillna(0, ["related", "open"])
    ident = X.meaningful(C("project_number"), True) & X.meaningful(C("project_name"), True)
    tons, sf = F.coalesce(C("tonnage") > 0, F.lit(False)), F.coalesce(C("square_feet") > 0, F.lit(False))
    un, pan, duct = C("unit_rows") > 0, C("panel_rows") > 0, F.coalesce(C("duct_feet") > 0, F.lit(False))
    cons, typ = C("canonical") != "Unknown", C("has_type")
    useful = tons | un | typ | duct | pan
    f = f.withColumns({"ident": ident, "useful": useful})
    uses = [("tonnage-history", tons, F.lit("approved HVAC tonnage is not recorded")),
            ("unit-history", un, F.lit("equipment rows or a confirmed unit count are not recorded")),
            ("equipment-types", typ, F.lit("equipment types are not recorded")), ("duct-analysis", duct, F.lit("duct linear feet are not recorded")),
            ("sf-per-ton", sf & tons, F.when(sf, "approved HVAC tonnage is not recorded").otherwise("square footage is not recorded")),
            ("consultant-comparison", cons, F.lit("consultant is not recorded")),
            ("similar-projects", C("ident") & C("useful") & (sf | X.meaningful(C("building_type"), True)),
             F.when(C("ident"), "more project size, type, or MEP information is needed").otherwise("project identity is incomplete")),
            ("electrical-panels", pan, F.lit("electrical panel information is not recorded"))]
    f = f.withColumn("uses", F.array(*[F.struct(F.lit(k).alias("use"), ok.alias("available"), F.when(ok, "").otherwise(why).alias("reason")) for k, ok, why in uses]))
    lacking = F.exists("uses", lambda u: ~u["available"])
    status = (F.when(C("excluded"), "Excluded").when(~C("ident") | ~C("useful") | C("review_required"), "Review Needed")
              .when((C("related") > 0) & (C("open") == 0), "Complete History").when(lacking | (C("open") > 0), "Limited Data").otherwise("Ready"))
    return f.withColumn("data_status", status)


def availability_matrix(av: DataFrame) -> DataFrame:
    return av.select("project_id", F.explode("uses").alias("u")).select("project_id", "u.*")


def electrical_project_summary(panels: DataFrame) -> DataFrame:
    named = C("disconnect_name") != ""
    return panels.groupBy("project_id").agg(
        F.sum(F.greatest(F.lit(1), C("quantity"))).cast("bigint").alias("panels"), F.min("amps").alias("min_amps"), F.max("amps").alias("max_amps"),
        F.count_if(named).alias("disconnects"), F.min(F.when(named, C("disconnect_amps"))).alias("min_disconnect"),
        F.max(F.when(named, C("disconnect_amps"))).alias("max_disconnect"))


def totals_badge(facts: DataFrame) -> DataFrame:
    return facts.select("project_id", F.when(C("excluded"), "Excluded").when(C("verification") == "Needs review", "Needs review")
                        .when(C("verification") == "Verified", "Verified").when(C("verification") == "Calculated", "Calculated")
                        .when(C("verification") == "Stated total", "Stated total").otherwise("Unknown").alias("badge"))


def projects_export(facts: DataFrame, units: DataFrame) -> DataFrame:
    """The twelve columns of the projects file; write with ``write_projects_csv``."""
    first = lambda c: (units.where(X.meaningful(C(c))).groupBy("project_id", c).agg(F.min("seq").alias("at")).groupBy("project_id")
                       .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", C(c).alias("v")))), lambda s: s["v"]), "; ").alias(c + "s")))
    j = facts.join(first("type"), "project_id", "left").join(first("manufacturer"), "project_id", "left")
    blank = lambda c: F.coalesce(C(c), F.lit(""))
    return j.select("project_number", "project_name", "building_type", C("canonical").alias("consultant"), "square_feet", "tonnage", "duct_feet",
                    "unit_count", "panel_count", blank("types").alias("unit_types"), blank("manufacturers").alias("manufacturers"), C("note").alias("quality"))


def write_projects_csv(export: DataFrame, path: str) -> None:
    export.write.mode("overwrite").option("header", True).option("quoteAll", True).option("lineSep", "\r\n").csv(path)


def export_tables(facts: DataFrame, units: DataFrame, panels: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """Denormalised tables of an export: projects, equipment, electrical, errors, consultants, notes."""
    head = facts.select("project_id", "project_number", "project_name", C("canonical").alias("consultant"))
    q = F.greatest(F.lit(1), F.coalesce(C("quantity"), F.lit(1)))
    return {
        "Projects": projects_export(facts, units),
        "Mechanical Equipment": units.join(head, "project_id").select(
            "project_number", "project_name", "consultant", C("seq").alias("unit_seq"), "type", "manufacturer", "model", q.cast("bigint").alias("quantity"), "tonnage",
            (C("tonnage") * q).alias("total_tonnage"), "duct_feet", "classification"),
        "Electrical": panels.join(head, "project_id").select("project_number", "project_name", "consultant", C("seq").alias("panel_seq"), C("name").alias("panel"), "amps", "load_kva",
                                                             "disconnect_name", "disconnect_amps"),
        "Errors": issues.join(head, "project_id").select("project_number", "project_name", "discipline", "category", "severity", "status", "message"),
        "Consultant Summary": consultant_summary(facts),
        "Notes": facts.where("note <> ''").select("project_number", "project_name", "note")}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name.lower().replace(' ', '_')}")
