"""Backup matching, related-file groups and the review of flagged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.functions import files as X
from recordqc.operators.catalog import enrich_files
from recordqc.operators.scale import join_back, top_k
from recordqc.session import written

C = F.col
CLOSE_MS = 2000


def _tokens(base: Column) -> Column:
    return F.filter(F.split(base, " "), lambda t: F.length(t) > 2)


def _contained(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(long, short) with ``short`` (6 characters or more) inside ``long``.

    Every start in the long name is probed by its 6-character gram, then by the
    exact text of each length in use for that gram. A long name meets only
    names that it contains, so nothing is paired by a common gram alone.
    """
    s = shorter.select(C("base").alias("short")).where(F.length("short") >= 6)
    lens = s.groupBy(F.left("short", F.lit(6)).alias("gram")).agg(F.collect_set(F.length("short")).alias("lens"))
    at = longer.where(F.length("base") >= 6).select(C("base").alias("long"), F.explode(F.sequence(F.lit(1), F.length("base") - 5)).alias("i"))
    at = at.withColumn("gram", F.substr("long", C("i"), F.lit(6))).join(lens, "gram")
    cut = at.select("long", C("i"), F.explode("lens").alias("n")).where(C("i") + C("n") - 1 <= F.length("long")) \
            .select("long", F.substr("long", C("i"), C("n")).alias("short")).distinct()
    return cut.join(s.distinct(), "short", "left_semi")


def _short_pairs(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """Similar names of which at least one has fewer than 6 characters.

    A name that short has one token at most, so few distinct short names share
    a token and the pairs stay in proportion to the distinct names.
    """
    tok = lambda df, name: df.select(C("base").alias(name), F.explode(F.array_distinct(_tokens(C("base")))).alias("t"))
    p, b = tok(primary, "p"), tok(backup, "b")
    short = lambda df, name: df.where(F.length(name) < 6)
    pairs = short(p, "p").join(b, "t").unionByName(p.where(F.length("p") >= 6).join(short(b, "b"), "t"))
    return pairs.where(~F.contains(C("p"), C("b")) & ~F.contains(C("b"), C("p"))).select("p", "b").distinct()


def _name_keys(primary: DataFrame, backup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys under which similar names meet: two names are similar iff they share one.

    e: same name, or a primary name inside the backup name; c: a backup name
    inside the primary name; n: short names; 1, s, 2: shared tokens by the
    number of tokens on each side.
    """
    key = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    inside_backup = _contained(backup, primary).select(C("long").alias("base"), key("e", C("short")).alias("key"))
    inside_primary = _contained(primary, backup).select(C("long").alias("base"), key("c", C("short")).alias("key"))
    short = _short_pairs(primary, backup).select(C("p").alias("base"), key("n", C("b")).alias("key"))

    def tokens(df: DataFrame, side: str) -> DataFrame:
        long = df.where(F.length("base") >= 6).withColumn("t", _tokens(C("base")))
        if side == "backup":  # a set of tokens
            long = long.withColumn("t", F.array_distinct("t"))
            n, t = F.size("t"), C("t")
            one = F.when(n == 1, F.transform(t, lambda x: key("1", x))).when(n > 1, F.transform(t, lambda x: key("s", x)))
            pair = F.when(n > 1, F.flatten(F.transform(t, lambda x: F.transform(F.filter(t, lambda y: x <= y), lambda y: F.concat(F.lit("2:"), x, F.lit(" "), y)))))
        else:  # a list: repeated tokens count twice
            n, t = F.size("t"), C("t")
            one = F.concat(F.transform(t, lambda x: key("1", x)), F.when(n == 1, F.transform(t, lambda x: key("s", x))).otherwise(F.array().cast("array<string>")))
            pair = F.when(n > 1, F.flatten(F.transform(t, lambda x, i: F.transform(
                F.filter(t, lambda y, j: i < j), lambda y: F.concat(F.lit("2:"), F.least(x, y), F.lit(" "), F.greatest(x, y))))))
        none = F.array().cast("array<string>")
        return long.select("base", F.explode(F.array_distinct(F.concat(F.coalesce(one, none), F.coalesce(pair, none)))).alias("key"))

    own = lambda df, kind: df.select("base", key(kind, C("base")).alias("key"))
    p_keys = own(primary, "e").unionByName(inside_primary).unionByName(short).unionByName(tokens(primary, "primary"))
    b_keys = (own(backup, "e").unionByName(inside_backup).unionByName(own(backup, "c")).unionByName(own(backup, "n"))
              .unionByName(tokens(backup, "backup")))
    return p_keys.distinct(), b_keys.distinct()


def catalog_records(files: DataFrame) -> DataFrame:
    """Enriched non-system files outside a review folder."""
    e = enrich_files(files)
    return e.where(~C("is_system") & ~F.array_contains(F.split(F.lower("path"), "/"), "review_bin")) \
            .withColumn("signal", C("folder_path").rlike(X.BACKUP_FOLDER))


def match_backups(records: DataFrame, stored: bool = False) -> DataFrame:
    """The best original of every backup file, exact and without pairing names.

    A backup wants one original: the highest score, then the latest date. For
    one name key and one scope (folder, parent, signalled, anywhere) that is
    always the latest original or an undated one, so originals are reduced to
    these two before any backup looks them up. ``stored`` says that ``records``
    are a written table already.
    """
    # records, groups, names and keys feed many branches: each is written once instead of computed again in each
    records = records.select("seq", "path", "folder_path", "parent_name", "signal", "modified_ms", "backup", "normalized_base",
                             "file_name", "extension", "size")
    if not stored:
        records = written(records, "match")
    plain = F.trim(F.regexp_replace(F.regexp_replace(X.comparable_name(C("file_name")), X.BACKUP_WORDS, ""), r"\s+", " "))
    backups = records.where(C("backup").isNotNull()).select(
        "seq", "path", "folder_path", "parent_name", "signal", C("modified_ms").alias("b_modified"), C("backup.primary").alias("pext"),
        F.coalesce(F.nullif(C("normalized_base"), F.lit("")), plain).alias("base"))
    primaries = records.where(C("backup").isNull() & C("extension").isin(X.ORIGINALS) & (C("normalized_base") != ""))
    info = F.struct(C("modified_ms").alias("m"), (-C("seq")).alias("ns"), C("path").alias("path"), C("folder_path").alias("folder"),
                    C("parent_name").alias("parent"), C("normalized_base").alias("base"), C("size").alias("size"),
                    C("extension").alias("ext"), C("file_name").alias("file_name"))
    reps = primaries.groupBy(C("normalized_base").alias("base"), "folder_path", "parent_name", "signal", "extension").agg(
        F.max(F.when(C("modified_ms") > 0, info)).alias("dated"), F.max(F.when(C("modified_ms") == 0, info)).alias("undated"))
    reps = written(reps, "originals")
    b_groups = written(backups.groupBy("base", "folder_path", "parent_name", "signal", "pext").agg(F.count(F.lit(1)).alias("n")), "backup-groups")
    p_names = written(reps.select("base").distinct(), "original-names")
    b_names = written(b_groups.select("base").distinct(), "backup-names")
    p_keys, b_keys = _name_keys(p_names, b_names)
    b_keys = written(b_keys, "backup-keys")
    p_keys = p_keys.join(b_keys.select("key").distinct(), "key", "left_semi")

    def scoped(df: DataFrame, anywhere: Column, signalled: Column, exts: Column) -> DataFrame:
        s = lambda kind, v: F.struct(F.lit(kind).alias("scope"), v.alias("place"))
        scopes = F.filter(F.array(s("F", C("folder_path")), s("P", C("parent_name")), F.when(signalled, s("S", F.lit(""))),
                                  F.when(anywhere, s("A", F.lit("")))), lambda x: x.isNotNull())
        return df.withColumn("sc", F.explode(scopes)).withColumn("ext", F.explode(exts)).select("*", "sc.scope", "sc.place").drop("sc")

    rep_rows = scoped(reps.join(p_keys, "base"), F.lit(True), C("signal"), F.array(C("extension"), F.lit("*")))
    best = rep_rows.groupBy("key", "scope", "place", "ext").agg(F.max("dated").alias("dated"), F.max("undated").alias("undated"))
    ask = scoped(b_groups.join(b_keys, "base"), C("signal"), F.lit(True), F.array(F.when(C("pext") == "", "*").otherwise(C("pext"))))
    group = ["base", "folder_path", "parent_name", "signal", "pext"]
    offers = (ask.join(best, ["key", "scope", "place", "ext"])
              .select(*group, F.explode(F.filter(F.array("dated", "undated"), lambda x: x.isNotNull())).alias("o")).distinct())
    cand = backups.join(offers, group)
    exact = C("base") == C("o.base")
    older = (C("b_modified") == 0) | (C("o.m") == 0) | (C("b_modified") <= C("o.m")) | C("signal")
    score = (F.when(exact, F.when(F.length("base") >= 6, 110).otherwise(80)).otherwise(30) + 20
             + F.when(C("folder_path") == C("o.folder"), 15).otherwise(0) + F.when(C("parent_name") == C("o.parent"), 8).otherwise(0)
             + F.when(older, 8).otherwise(0))
    cand = cand.where(exact | older).withColumn("score", score).withColumn("exact", exact)
    won = cand.groupBy("seq", "path").agg(F.max(F.struct("score", "o", "exact")).alias("w"))
    return won.select("seq", "path", C("w.o.path").alias("original"), C("w.score").cast("bigint").alias("score"),
                      F.when(C("w.exact"), "Exact backup match").otherwise("Likely backup").alias("confidence"),
                      (-C("w.o.ns")).alias("original_seq"), C("w.o.file_name").alias("original_name"), C("w.o.ext").alias("original_ext"),
                      C("w.o.base").alias("original_base"), C("w.o.m").alias("original_modified"), C("w.o.size").alias("original_size"))


HIT = ["path", "label", "detail", "group_key", "keep", "review", "role", "related", "recommendation", "tone", "confidence",
       "original_name", "phase", "ord"]


def _hit(df: DataFrame, **cols) -> DataFrame:
    blank = {"keep": F.lit(False), "review": F.lit(False), "role": F.lit(""), "related": F.lit(""), "recommendation": F.lit(""),
             "tone": F.lit(""), "confidence": F.lit(""), "original_name": F.lit("")}
    got = {**blank, **{k: (v if isinstance(v, Column) else F.lit(v)) for k, v in cols.items()}}
    return df.select(*[got[c].alias(c) for c in HIT])


def backup_hits(records: DataFrame, matches: DataFrame) -> DataFrame:
    """Flag rows of backups, with and without an original, and of the originals."""
    b = records.where(C("backup").isNotNull()).join(matches.drop("seq"), "path", "left")
    none = b.where(C("original").isNull())
    name = F.coalesce(F.nullif(C("normalized_base"), F.lit("")), F.nullif(C("base_name"), F.lit("")), C("file_name"))
    text = "Possible backup - no original found"
    unmatched = _hit(none, path=C("path"), label="Backup / Autosave", detail=text, review=True, role="backup", recommendation=text,
                     group_key=F.concat(F.lit("backup-unmatched:"), "parent_name", F.lit(":"), name), tone="caution",
                     confidence="Unmatched backup", original_name="???", phase=F.lit(0), ord=C("seq") * 2)
    m = b.where(C("original").isNotNull())
    key = F.concat(F.lit("backup:"), "original_base", F.lit(":"), F.coalesce(F.nullif(C("original_ext"), F.lit("")), C("extension")))
    reason = (F.when((C("extension") == "bak") & (C("original_ext") == "dwg"), "AutoCAD .bak file related to DWG")
              .when((C("extension") == "skb") & (C("original_ext") == "skp"), "SketchUp .skb backup file related to SKP")
              .when(C("original_ext") == "3dm", "Rhino backup/autosave file related to 3DM").otherwise(C("backup.detail")))
    low, clear = F.lower("file_name"), F.lit(False)
    for e in X.CLEAR_BACKUP_ENDINGS:
        clear = clear | low.endswith(e)
    older = (C("modified_ms") > 0) & (C("original_modified") > 0) & (C("modified_ms") < C("original_modified"))
    drift = F.when(C("original_size") > 0, F.abs(C("size") - C("original_size")) / C("original_size")).otherwise(0.0)
    sure = (C("confidence") == "Exact backup match") | (clear & older & (drift < 0.75))
    matched = _hit(m, path=C("path"), label="Backup / Autosave", detail=reason, group_key=key, role="backup", related=C("original"),
                   recommendation=F.when(sure, "Recommended to delete").otherwise("Double-check before deleting"),
                   tone=F.when(sure, "safe").otherwise("caution"), confidence=C("confidence"), original_name=C("original_name"),
                   phase=F.lit(0), ord=C("seq") * 2)
    kept = _hit(m, path=C("original"), label="Backup / Autosave", detail="Original/main file kept for comparison", group_key=key, keep=True,
                role="original", related=C("path"), recommendation="Original kept", tone="safe", confidence=C("confidence"),
                original_name=C("original_name"), phase=F.lit(0), ord=C("seq") * 2 + 1)
    return unmatched.unionByName(matched).unionByName(kept)


def classify_related(records: DataFrame, originals: DataFrame) -> DataFrame:
    """Exact, older and naming duplicates inside (name, extension) groups.

    ``originals(path)`` are the files that backup matching already gave a role.
    """
    g = ["normalized_base", "extension"]
    nb = C("backup").isNull()
    keyed = records.where(C("normalized_base") != "").select("seq", "path", "size", "modified_ms", "base_name", nb.alias("nb"), *g)
    signal = C("base_name").rlike(X.COPY_NAME) | C("base_name").rlike(X.VERSION_NAME)
    groups = keyed.groupBy(*g).agg(
        F.count_if("nb").alias("n_nb"), F.max(F.struct(C("modified_ms"), -C("seq"))).alias("__top"),
        F.max("modified_ms").alias("__top_m"),
        F.max(F.when(C("nb"), C("modified_ms"))).alias("mx"), F.min(F.when(C("nb"), C("modified_ms"))).alias("mn"),
        F.max(F.when(C("nb"), signal)).alias("signal")).where("n_nb >= 2")
    groups = groups.withColumn("s0_seq", -C("__top").getField("col2")).drop("__top")
    rows = join_back(keyed, groups, g, "inner")
    newest = rows.where(C("modified_ms") == C("__top_m")).groupBy(*g).agg(F.min("path").alias("newest"))
    rows = join_back(rows, newest, g)
    sized = rows.where("nb and size > 0")
    first = sized.groupBy(*g, "size").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("seq", "modified_ms")).alias("p1"))
    second = join_back(sized, first, [*g, "size"]).where(C("seq") != C("p1.seq")).groupBy(*g, "size").agg(F.min(F.struct("seq", "modified_ms")).alias("p2"))
    peers = join_back(first.where("same > 1"), second, [*g, "size"])
    rows = join_back(rows, peers, [*g, "size"]).where("nb")
    exact = C("same").isNotNull()
    older = ~exact & (C("modified_ms") != 0) & (C("mx") - C("modified_ms") > CLOSE_MS) & (C("seq") != C("s0_seq"))
    rows = written(rows.withColumn("exact", exact).withColumn("older", older), "related")
    first_older = rows.where("older").groupBy(*g).agg(F.min("seq").alias("first_older"))
    rows = join_back(rows, first_older, g)
    had_role = originals.select("path").distinct().withColumn("had_role", F.lit(True))
    rows = rows.join(had_role, "path", "left")
    skip = (C("seq") == C("s0_seq")) & C("had_role").isNull() & (C("first_older") < C("seq"))
    rows = rows.withColumn("skip", F.coalesce(skip, F.lit(False)))
    group_key = F.concat("normalized_base", F.lit("|"), "extension")
    peer_m = F.when(C("p1.seq") == C("seq"), C("p2.modified_ms")).otherwise(C("p1.modified_ms"))
    hits = _hit(rows.where("exact and not skip"), path=C("path"), label="Exact Duplicate",
                detail=F.when(F.abs(peer_m - C("modified_ms")) <= CLOSE_MS, "Same size, modified date, and matching name pattern")
                .otherwise("Same size and matching name pattern"),
                group_key=F.concat(F.lit("exact:"), group_key, F.lit(":"), C("size").cast("string")), keep=C("path") == C("newest"),
                phase=F.lit(1), ord=C("seq") * 2)
    version = F.concat(F.lit("version:"), group_key)
    hits = hits.unionByName(_hit(rows.where("older and not skip"), path=C("path"), label="Older Version", detail="Older file with matching base name",
                                 group_key=version, role="older", phase=F.lit(1), ord=C("seq") * 2))
    tops = join_back(keyed, groups.join(first_older, g), g, "inner").where(C("seq") == C("s0_seq"))
    hits = hits.unionByName(_hit(tops, path=C("path"), label="Older Version", detail="Newer version kept for comparison", group_key=version,
                                 keep=True, role="newer", phase=F.lit(1), ord=C("first_older") * 2 + 1))
    # some peer of another size more than two seconds away, and any copy or version word in the group
    far = F.greatest(C("mx") - C("modified_ms"), C("modified_ms") - C("mn")) > CLOSE_MS
    naming = rows.where(~C("exact") & ~C("older") & ~C("skip") & far & C("signal"))
    return hits.unionByName(_hit(naming, path=C("path"), label="Naming Duplicate", detail="Similar name, but size and modified date differ",
                                 group_key=F.concat(F.lit("naming:"), group_key), review=True, phase=F.lit(1), ord=C("seq") * 2))


LABEL_RANK = ["Backup / Autosave", "Exact Duplicate", "Older Version", "Naming Duplicate"]  # fixed order


def finalize_flags(hits: DataFrame) -> DataFrame:
    """One row per flagged file: label sets, first roles, strongest label and the action."""
    when = F.struct("phase", "ord")
    one = hits.groupBy("path", "detail", "group_key", "label").agg(
        F.min(when).alias("at"), F.bool_or("keep").alias("keep"), F.bool_or("review").alias("review"),
        *[F.min_by(c, F.when(C(c) != "", when)).alias(c) for c in ("role", "related", "recommendation", "tone", "confidence", "original_name")],
        *[F.min(F.when(C(c) != "", when)).alias(f"{c}_at") for c in ("role", "related")])
    rank = F.array_position(F.array(*[F.lit(x) for x in LABEL_RANK]), C("label"))
    agg = one.groupBy("path").agg(
        F.min_by("label", rank).alias("label"), F.array_sort(F.collect_set("label")).alias("labels"),
        F.array_sort(F.collect_list(F.struct("at", "detail"))).alias("details"), F.min("group_key").alias("group_label"),
        F.bool_or("keep").alias("keep"), F.bool_or("review").alias("review"),
        F.min_by("role", C("role_at")).alias("role"), F.min_by("related", C("related_at")).alias("related"),
        *[F.min_by(c, F.when(C(c).isNotNull(), C("at"))).alias(c) for c in ("recommendation", "tone", "confidence", "original_name")])
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return agg.select("path", "label", F.array_join("labels", "; ").alias("labels"),
                      F.array_join(F.array_distinct(F.transform("details", lambda d: d["detail"])), "; ").alias("reason"),
                      "group_label", blank("role"), blank("related"), blank("recommendation"), blank("tone"), blank("confidence"),
                      blank("original_name"),
                      F.when(C("keep"), "keep").when(C("review"), "review").otherwise("discard").alias("action"))


def flag_files(files: DataFrame) -> DataFrame:
    """All flagged files of a catalog with their details."""
    records = written(catalog_records(files).drop("hash"), "records")
    hits_b = written(backup_hits(records, match_backups(records, stored=True)), "hits")
    hits = hits_b.unionByName(classify_related(records, hits_b.where("role <> ''").select("path")))
    flags = finalize_flags(hits)
    return flags.join(records.select("path", "seq", "file_name", "folder_path", "parent_name", "extension", "file_class", "review_group", "size",
                                     "modified_ms", "normalized_base"), "path")


def filter_flags(flags: DataFrame, label: str = "all", group: str = "all", folder: str = "all", text: str = "") -> DataFrame:
    out = flags
    if label != "all":
        out = out.where(C("label") == label)
    if group != "all":
        out = out.where(C("review_group") == group)
    if folder != "all":
        out = out.where(C("folder_path").startswith(folder))
    if text:
        hit = F.lit(False)
        for c in ("file_name", "folder_path", "reason", "label", "file_class", "extension"):
            hit = hit | F.contains(F.lower(C(c)), F.lit(text.lower()))
        out = out.where(hit)
    return out


def review_groups(flags: DataFrame, largest: int = 3) -> DataFrame:
    """Totals per review group; the biggest groups with more than one row are marked."""
    g = flags.groupBy("group_label").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_size"),
                                         F.max("modified_ms").alias("newest"), F.max("size").alias("largest"))
    top = top_k(g.where("files > 1").withColumn("one", F.lit(1)), ["one"], ["-total_size", "group_label"], largest)
    return g.join(top.select("group_label", F.lit(True).alias("big")), "group_label", "left") \
            .withColumn("is_largest", F.coalesce("big", F.lit(False))).drop("big")


def cleanup_stats(files: DataFrame, actions: DataFrame) -> DataFrame:
    """Kept files, selected and committed bytes; ``actions(path, selected, committed)``."""
    a = files.join(actions, "path", "left")
    sel, com = F.coalesce("selected", F.lit(False)), F.coalesce("committed", F.lit(False))
    pick = sel | com
    t = a.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(pick).alias("selected_files"), F.sum("size").alias("original_storage"),
              F.coalesce(F.sum(F.when(pick, C("size"))), F.lit(0)).alias("selected_size"),
              F.coalesce(F.sum(F.when(com, C("size"))), F.lit(0)).alias("committed_size"))
    return t.select("total_files", "selected_files", (C("total_files") - C("selected_files")).alias("files_to_keep"), "original_storage",
                    "selected_size", "committed_size", (C("original_storage") - C("selected_size")).alias("storage_after"),
                    F.when(C("original_storage") > 0, C("committed_size") * 100.0 / C("original_storage")).otherwise(0.0).alias("cleanup_percent"))


def workflow_status(state: DataFrame) -> DataFrame:
    return state.withColumn("workflow", F.when(C("deleted"), "Recycle Bin").when(C("discarded"), "Review Bin")
                            .when(C("grouped"), "Backup grouping prepared").when(C("selected"), "Selected").otherwise("Active"))


def cleanup_report(flags: DataFrame, state: DataFrame, failures: DataFrame) -> DataFrame:
    """Report rows of flagged files and of failures; ``state(path, selected, discarded, grouped, deleted)``."""
    yes = lambda c: F.coalesce(C(c), F.lit(False))
    f = flags.join(state, "path", "left")
    f = workflow_status(f.withColumns({c: yes(c) for c in ("selected", "discarded", "grouped", "deleted")}))
    rel = flags.select(C("path").alias("related"), C("file_name").alias("related_name"))
    fail = failures.groupBy("path").agg(F.min("message").alias("error"))
    rows = f.join(rel, "related", "left").join(fail, "path", "left")
    status = F.when(C("workflow") == "Recycle Bin", "Recycled").otherwise(C("workflow"))
    out = rows.select(C("label").alias("category"), "file_name", "path", C("file_class").alias("file_type"), "size", "modified_ms", "reason",
                      F.when(C("selected"), "Selected").otherwise("Not selected").alias("selection_status"), status.alias("deletion_status"),
                      F.when(C("grouped"), "Prepared for grouped backup folder").otherwise("").alias("grouping_status"),
                      F.coalesce("related_name", F.lit("")).alias("related_name"), F.coalesce("error", F.lit("")).alias("error"))
    errors = failures.select(F.lit("Error").alias("category"), X.file_name(C("path")).alias("file_name"), "path", F.lit("").alias("file_type"),
                             F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("modified_ms"), F.lit("").alias("reason"),
                             F.lit("").alias("selection_status"), F.lit("Error").alias("deletion_status"), F.lit("").alias("grouping_status"),
                             F.lit("").alias("related_name"), C("message").alias("error"))
    return out.unionByName(errors)
