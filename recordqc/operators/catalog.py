"""File and folder catalog: diff, tree, statistics, duplicates, rename and removal plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.functions import files as X
from recordqc.operators.scale import first_per, join_back, multiset_digest, ranked, running, top_k, with_totals
from recordqc.session import written

C = F.col


def enrich_files(files: DataFrame) -> DataFrame:
    """Name, type, backup and date columns of every file; narrow projections only.

    Each step refers to columns of the step before, so that an expression is
    computed once and the generated code stays small.
    """
    p, n = C("parts"), F.size("parts")
    s1 = files.withColumn("parts", X.parts(C("path"))).withColumns({
        "file_name": F.element_at(p, -1), "folder_path": F.array_join(F.slice(p, F.lit(1), n - 1), "/"),
        "main": F.when(n > 1, F.get(p, F.lit(0))).otherwise("Selected Folder"),
        "parent_name": F.when(n > 2, F.get(p, F.lit(1))).otherwise("Root files"),
        "secondary": F.when(n > 3, F.get(p, F.lit(2))).when(n > 2, "Folder root").otherwise("Root level"),
        "depth": n, "natural_key": X.natural_key(C("path"))}).drop("parts")
    name = C("file_name")
    s2 = s1.withColumns({"extension": X.extension(name), "base_name": X.base_name(name), "is_system": X.is_system_name(name),
                         "backup": X.backup_kind(name), "__dates": X.date_numbers(C("secondary"))})
    s3 = s2.withColumns({"__stem": X.backup_stem(name, C("backup.suffix")), "file_class": X.file_class(C("extension")),
                         "review_group": X.review_group(C("extension")),
                         "export_secondary": X.date_folder(C("secondary"), C("__dates")),
                         "export_name": X.normalized_file_name(name, C("base_name"), C("extension"))})
    s4 = s3.withColumns({"__plain": X.comparable_name(C("base_name")), "__cmp": X.comparable_name(C("__stem")),
                         "already_processed": X.already_processed(name, C("extension"), C("secondary"), C("export_secondary"))})
    s5 = s4.withColumn("backup_source", X.backup_source(C("__stem"), C("backup.suffix"), C("__cmp")))
    return s5.withColumn("normalized_base", F.coalesce(F.nullif(C("backup_source"), F.lit("")), C("__plain"))) \
             .drop("__dates", "__stem", "__plain", "__cmp")


def enrich_sheet_files(df: DataFrame) -> DataFrame:
    """Sheet number, title, drawing type and keywords from file names."""
    name = C("filename")
    return (df.withColumn("sheet_number", X.sheet_number_from_name(name)).withColumn("sheet_title", X.sheet_title_from_name(name, C("sheet_number")))
            .withColumn("drawing_type", X.drawing_type(name)).withColumn("keywords", X.keywords_in(name)))


def index_diff(current: DataFrame, prior: DataFrame) -> DataFrame:
    """new / changed / unchanged / stale per path by (size, modified)."""
    c = current.select("path", C("size").alias("size"), C("modified_ms").alias("modified_ms"))
    o = prior.select("path", C("size").alias("o_size"), C("modified_ms").alias("o_modified"))
    status = (F.when(C("o_size").isNull(), "new").when(C("size").isNull(), "stale")
              .when((C("size") == C("o_size")) & (C("modified_ms") == C("o_modified")), "unchanged").otherwise("changed"))
    return c.join(o, "path", "full").withColumn("status", status)


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count_if(C("status") != "stale").alias("scanned"), F.count_if(C("status").isin("new", "changed")).alias("indexed"),
                    F.count_if(C("status") == "unchanged").alias("skipped"), F.count_if(C("status") == "stale").alias("removed"))


def apply_diff(diff: DataFrame, now_ms: int, prior_indexed_ms: int = 0) -> DataFrame:
    """The next snapshot: stale rows dropped, new and changed rows stamped."""
    return diff.where("status <> 'stale'").select(
        "path", "size", "modified_ms",
        F.when(C("status") == "unchanged", F.lit(prior_indexed_ms)).otherwise(F.lit(now_ms)).alias("indexed_at"))


def duplicate_titles(sheets: DataFrame) -> DataFrame:
    stem = X.base_name(C("filename"))
    title = F.upper(F.trim(F.when(C("sheet_title") != "", C("sheet_title")).otherwise(stem)))
    return (sheets.groupBy(title.alias("title")).agg(F.count(F.lit(1)).alias("files"))
            .where((C("files") > 1) & (C("title") != "")))


def missing_sequences(sheets: DataFrame) -> DataFrame:
    """Numbers absent between the lowest and highest of a letter prefix.

    Gaps are found between neighbours, so the work and the emitted rows follow
    the gaps and not the span of a prefix.
    """
    rx = r"^([A-Z]+)(\d+)$"
    up = F.upper(C("sheet_number"))
    got = sheets.where(up.rlike(rx)).select(F.regexp_extract(up, rx, 1).alias("prefix"), F.regexp_extract(up, rx, 2).alias("txt"))
    nums = got.groupBy("prefix", C("txt").cast("bigint").alias("num")).agg(F.max(F.length("txt")).alias("w"))
    width = nums.groupBy("prefix").agg(F.max("w").alias("width"))
    gaps = running(nums, ["prefix"], ["num"], prev=("lag", "num")).where(C("prev").isNotNull() & (C("num") > C("prev") + 1))
    gaps = join_back(gaps, width, ["prefix"])
    return gaps.select("prefix", "width", F.explode(F.sequence(C("prev") + 1, C("num") - 1)).alias("n")).select(
        "prefix", F.concat("prefix", F.when(F.length(C("n").cast("string")) >= C("width"), C("n").cast("string"))
                           .otherwise(F.lpad(C("n").cast("string"), C("width"), F.lit("0")))).alias("sheet_number"))


def summarize_files(sheets: DataFrame, oversized_bytes: int) -> DataFrame:
    return sheets.groupBy("root").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(C("size") > oversized_bytes).alias("oversized"),
        F.array_join(F.array_sort(F.collect_set(F.when(C("drawing_type") != "Unknown", C("drawing_type")))), ", ").alias("drawing_types"))


def _ancestors(path, include_self: bool):
    """Every folder above a normalised path, outermost first."""
    n = F.size(F.split(path, "/")) if include_self else F.size(F.split(path, "/")) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", path, F.lit("/"), i)))


def folder_tree(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Every folder on the way to a file or a listed folder, with depth and level."""
    seen = files.select(F.explode(_ancestors(C("path"), False)).alias("folder")).distinct() \
        .union(folders.select(F.explode(_ancestors(C("path"), True)).alias("folder"))).distinct()
    n = F.size(F.split("folder", "/"))
    return seen.select("folder", n.alias("depth"), F.element_at(F.split("folder", "/"), -1).alias("name"),
                       F.when(n > 1, F.regexp_replace("folder", "/[^/]*$", "")).otherwise("").alias("parent_path"),
                       F.when(n <= 1, "Main Folder").when(n == 2, "Parent Folder").when(n == 3, "Secondary Folder")
                       .otherwise("Nested Folder").alias("level"))


def folder_stats(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Subtree and direct counters per folder; partial sums before every shuffle."""
    tree = folder_tree(files, folders)
    sysf = X.is_system(C("path"))
    f = files.select(F.explode(_ancestors(C("path"), False)).alias("folder"), X.folder_of(C("path")).alias("home"),
                     sysf.alias("sys"), "modified_ms")
    sums = f.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("sys").alias("system_files"), F.count_if(~C("sys")).alias("usable_files"),
        F.count_if(C("folder") == C("home")).alias("direct_files"), F.max("modified_ms").alias("last_modified"))
    dirs = (tree.select(F.explode(_ancestors(C("folder"), False)).alias("folder"), C("parent_path"))
            .groupBy("folder").agg(F.count(F.lit(1)).alias("sub_dirs"), F.count_if(C("folder") == C("parent_path")).alias("child_dirs")))
    zero = {c: 0 for c in ("files", "system_files", "usable_files", "direct_files", "last_modified", "sub_dirs", "child_dirs")}
    return tree.join(sums, "folder", "left").join(dirs, "folder", "left").fillna(zero)


def empty_folders(stats: DataFrame, mode: str = "lenient", variant: str = "browser", max_level: str | None = None) -> DataFrame:
    """Folders without usable content, with the reason text of the chosen variant."""
    usable, any_file = C("usable_files") == 0, C("files") == 0
    if variant == "browser":
        keep = (C("direct_files") == 0) & (C("child_dirs") == 0) if mode == "strict" else usable
        reason = F.lit("No files or child folders.") if mode == "strict" else \
            F.when(C("system_files") > 0, "Only ignored system files and empty subfolders.").otherwise("Empty folder tree.")
        scope = C("depth") >= 2
    elif variant == "server":
        keep = any_file if mode == "strict" else usable
        reason = F.when(C("child_dirs") > 0, "Empty folder chain").when(C("files") > 0, "Only ignored system files") \
            .otherwise("Completely empty")
        scope = C("depth") >= 2
    else:  # the renamer looks at parent and secondary folders only
        keep, reason, scope = usable, C("level"), C("level").isin("Parent Folder", "Secondary Folder")
    return stats.where(keep & scope).withColumn("reason", reason)


def age_filter(rows: DataFrame, days: int, include_unknown: bool, now_ms: int) -> DataFrame:
    if not days:
        return rows
    known = C("last_modified") > 0
    old = (F.lit(now_ms) - C("last_modified")) >= days * 86400000
    unknown = rows.where(~known).withColumn("reason", F.lit("Folder date unknown.")) if include_unknown else None
    kept = rows.where(known & old)
    return kept if unknown is None else kept.unionByName(unknown)


def parent_rollup(files: DataFrame, folders: DataFrame) -> DataFrame:
    stats = folder_stats(files, folders).where("depth >= 2").withColumn("parent_name", X.part(C("folder"), 1))
    by_folder = stats.groupBy("parent_name").agg(F.count(F.lit(1)).alias("folder_count"),
                                                 F.count_if(C("usable_files") == 0).alias("empty_count"))
    f = enrich_files(files).where(~C("is_system"))
    pairs = f.groupBy("parent_name", "secondary").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C("extension").isin(X.RENAME_SUPPORTED)).alias("sup"),
        F.count_if(C("extension").isin(X.HEIC_FAMILY)).alias("heic"))
    by_file = pairs.groupBy("parent_name").agg(F.sum("n").alias("file_count"), F.count(F.lit(1)).alias("secondary_count"),
                                               F.sum("sup").alias("supported"), F.sum("heic").alias("heic"))
    return by_folder.join(by_file, "parent_name", "left").fillna(0)


def processing_status(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Per folder: direct and descendant files, supported, done, and the status."""
    stats = folder_stats(files, folders)
    records = enrich_files(files).where(~C("is_system") & (C("depth") >= 4))
    sup = C("extension").isin(X.RENAME_SUPPORTED)
    per = records.groupBy(F.concat_ws("/", "main", "parent_name", "secondary").alias("folder")).agg(
        F.count_if(sup).alias("supported"), F.count_if("already_processed").alias("processed"), F.count_if(~sup).alias("unsupported"))
    status = F.when((C("supported") > 0) & (C("processed") == C("supported")), "Already Processed") \
        .when(C("processed") > 0, "Partially Processed").otherwise("Needs Processing")
    return (stats.join(per, "folder", "left").fillna(0, ["supported", "processed", "unsupported"])
            .select("folder", "level", "direct_files", C("files").alias("descendant_files"), "supported", "processed",
                    "unsupported", status.alias("status")))


def parent_status(files: DataFrame) -> DataFrame:
    r = enrich_files(files).where(~C("is_system") & (C("depth") >= 4))
    sup = C("extension").isin(X.RENAME_SUPPORTED)
    n, d = F.count_if(sup), F.count_if("already_processed")
    return r.groupBy("parent_name").agg(n.alias("supported"), d.alias("processed")).withColumn(
        "status", F.when(C("supported") == 0, "Skipped").when(C("processed") == C("supported"), "Already Processed")
        .when(C("processed") > 0, "Partially Processed").otherwise("Needs Processing"))


def compress_targets(paths: DataFrame) -> DataFrame:
    """Selected folders without a selected ancestor."""
    up = paths.select("path", F.explode(_ancestors(C("path"), False)).alias("ancestor"))
    hit = up.join(paths.select(C("path").alias("ancestor")), "ancestor", "left_semi").select("path").distinct()
    return paths.join(hit, "path", "left_anti")


def _content_groups(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Non-system files, and the groups of equal contents in a parent with the path to keep (``best.path``)."""
    f = enrich_files(files).where(~C("is_system"))
    inner = F.slice(F.split("folder_path", "/"), F.lit(2), F.greatest(C("depth") - 2, F.lit(0)))
    f = f.withColumn("copy_score", F.when(F.exists(inner, lambda p: p.rlike(X.COPY_FOLDER)), 1).otherwise(0)) \
         .withColumn("pkey", F.lower("parent_name"))
    order = F.struct("copy_score", "natural_key", "path")
    groups = f.groupBy("pkey", "hash").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("best"), F.min("seq").alias("first_seq")) \
              .where("copies > 1")
    return f, groups


def duplicate_files(files: DataFrame) -> DataFrame:
    """Same content inside one parent folder: one row per copy, with the one to keep."""
    f, groups = _content_groups(files)
    groups = ranked(groups, [], ["first_seq", "hash", "pkey"], "group_number")
    return f.join(groups, ["pkey", "hash"]).select(
        "group_number", "path", "parent_name", "hash", "copies", (C("path") == C("best.path")).alias("keep"))


def _secondary_rows(files: DataFrame, min_parts: int = 4):
    p = X.parts(C("path"))
    return files.where(F.size(p) >= min_parts).withColumn("p", p)


def duplicate_folders(files: DataFrame) -> DataFrame:
    """Secondary folders of one parent with the same name or the same contents."""
    f = _secondary_rows(files)
    rel = F.lower(F.array_join(F.slice(C("p"), F.lit(4), F.size("p")), "/"))
    folders = f.groupBy(F.array_join(F.slice("p", 1, 3), "/").alias("folder"), F.get("p", F.lit(1)).alias("parent_name"),
                        F.get("p", F.lit(2)).alias("name")).agg(*multiset_digest(rel, C("size")))
    folders = folders.withColumn("pk", F.lower("parent_name")).withColumn("nk", F.lower("name")) \
                     .withColumn("nat", X.natural_key(C("folder")))
    first = F.min(F.struct("nat", "folder"))
    named = with_totals(folders, ["pk", "nk"], F.count(F.lit(1)).alias("n_name"), first.alias("f_name"))
    digest = ["pk", "__d1", "__d2", "__dn"]
    both = join_back(named, folders.groupBy(*digest).agg(F.count(F.lit(1)).alias("n_same"), first.alias("f_same")), digest)
    by_name, exact = C("n_name") > 1, C("n_same") > 1
    exact_first = C("f_same.folder") == C("folder")
    return both.where(by_name | exact).select(
        "folder", F.when(exact, "Contents appear identical").otherwise("Folder name matches").alias("match"),
        exact.alias("exact_duplicate"), F.when(exact, exact_first).otherwise(F.lit(True)).alias("exact_keep"),
        F.when(by_name, C("f_name.folder") == C("folder")).otherwise(exact_first).alias("keep"))


CONTENTS = ["__d1", "__d2", "__dn"]


def _parent_groups(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents, and the groups of equal contents with the parent to keep (``best.parent_name``)."""
    f = _secondary_rows(files, 3)
    rel = F.lower(F.array_join(F.slice(C("p"), F.lit(3), F.size("p")), "/"))
    sysf = X.is_system(C("path"))
    parents = f.groupBy(F.get("p", F.lit(1)).alias("parent_name")).agg(
        *multiset_digest(rel, C("size")), F.min("seq").alias("first_seq"), F.count_if(~sysf).alias("file_count"))
    parents = parents.withColumn("nat", X.natural_key(C("parent_name")))
    groups = parents.groupBy(*CONTENTS).agg(F.count(F.lit(1)).alias("n"), F.min("first_seq").alias("group_seq"),
                                          F.min(F.struct("nat", "parent_name")).alias("best")).where("n > 1")
    return parents, groups


def identical_parents(files: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Parents with equal contents; under a selection only groups that still have two."""
    parents, groups = _parent_groups(files)
    groups = ranked(groups, [], ["group_seq"], "group_number")
    out = parents.join(groups, CONTENTS).select("group_number", "parent_name", (C("best.parent_name") == C("parent_name")).alias("keep"),
                                              "file_count")
    if selected is None:
        return out
    out = out.join(selected, "parent_name", "left_semi")
    return join_back(out, out.groupBy("group_number").agg(F.count(F.lit(1)).alias("n")), ["group_number"]).where("n > 1").drop("n")


def removal_plan(files: DataFrame, removed_folders: DataFrame, removed_files: DataFrame) -> DataFrame:
    """Excluded = below a removed folder, or a removed file itself."""
    up = files.select("path", F.explode(_ancestors(C("path"), False)).alias("folder"))
    by_folder = up.join(removed_folders.select("folder").distinct(), "folder", "left_semi").select("path").distinct() \
        .withColumn("f", F.lit(True))
    by_file = removed_files.select("path").distinct().withColumn("d", F.lit(True))
    out = files.join(by_folder, "path", "left").join(by_file, "path", "left")
    yes = lambda c: F.coalesce(C(c), F.lit(False))
    return out.withColumn("by_folder", yes("f")).withColumn("by_file", yes("d")) \
              .withColumn("excluded", yes("f") | yes("d")).drop("f", "d")


def exact_mode_removals(files: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removal sets when every automatic choice is taken; groups need no numbers here."""
    dup = duplicate_folders(files).where("exact_duplicate and not exact_keep").select("folder")
    parents, same = _parent_groups(files)
    par = parents.join(same, CONTENTS).where(C("parent_name") != C("best.parent_name")).select(F.concat(F.lit("Main/"), "parent_name").alias("folder"))
    records, copies = _content_groups(files)
    extra = records.join(copies, ["pkey", "hash"]).where(C("path") != C("best.path")).select("path")
    emp = empty_folders(folder_stats(files, folders), variant="renamer").select("folder")
    return dup.union(par).union(emp).distinct(), extra


def rename_plan(plan: DataFrame, skip_processed: bool = True) -> DataFrame:
    """Running numbers per (parent, export folder) over all selected records in natural order."""
    r = enrich_files(plan).where(~C("is_system") & (C("depth") >= 4))
    r = ranked(r, ["parent_name", "export_secondary"], ["natural_key", "path"], "n")
    sup = C("extension").isin(X.RENAME_SUPPORTED)
    folder = F.concat_ws("/", "main", "parent_name", "secondary")
    r = r.withColumn("folder", folder)
    if skip_processed:
        skip = C("already_processed")
    else:
        skip = F.lit(False)
    can = sup & ~skip
    name = F.when(can, F.concat("export_secondary", F.lit("_"), F.format_string("%03d", C("n")), F.lit("."),
                                X.export_extension(C("extension")))).otherwise(C("export_name"))
    return r.withColumn("would_rename", can).withColumn(
        "base_path", F.concat_ws("/", "main", "parent_name", "export_secondary", name))


def record_status(r: DataFrame) -> DataFrame:
    sup = C("extension").isin(X.RENAME_SUPPORTED)
    return r.withColumn("status", F.when(C("excluded"), "Will Be Removed").when(~sup, "Skipped")
                        .when(C("already_processed"), "Already Processed").when(X.needs_processing(C("secondary"), C("export_secondary")), "Needs Processing")
                        .otherwise("Needs Processing"))


_STEM = r"^(.*/[^/]+?|[^/]+?)(\.[^./]*)?$"


def _numbered(path: Column, suffix: str, k: Column) -> Column:
    return F.concat(F.regexp_extract(path, _STEM, 1), F.lit(suffix), k.cast("string"), F.regexp_extract(path, _STEM, 2))


def resolve_collisions(plan: DataFrame, suffix: str = "_duplicate-") -> DataFrame:
    """First free ``<base><suffix>k`` (k from 2) for repeated output paths, in ``seq`` order; ``seq`` must be unique.

    Repeats are numbered with a range-partitioned count. Names that already carry the suffix reserve a number of the
    name they extend, from their first row on; ``_around_reserved`` numbers the families in which that happens.
    """
    low, mark = F.lower("base_path"), f"\\Q{suffix.lower()}\\E"
    rx = f"{mark}[0-9]+(?=(\\.[^./]*)?$)"
    # strip every trailing generated suffix, so that all names that can meet share one family
    family = F.regexp_replace(low, f"(?:{mark}[0-9]+)+(?=(\\.[^./]*)?$)", "")
    p = ranked(plan.select("seq", "base_path", low.alias("low"), family.alias("family")), ["low"], ["seq"], "k")
    tangled = p.where(C("low").rlike(rx)).select("family").distinct()
    path = C("base_path")
    plain = p.join(tangled, "family", "left_anti") \
        .select("seq", "base_path", F.when(C("k") == 1, path).otherwise(_numbered(path, suffix, C("k"))).alias("new_path"))
    return plain.unionByName(_around_reserved(p.join(tangled, "family", "left_semi").drop("family"), suffix))


def _around_reserved(p: DataFrame, suffix: str) -> DataFrame:
    """``seq, base_path, new_path`` of families with reserved numbers, from rows ``seq, base_path, low, k`` (``k``-th row of its name).

    Level by level, from names without the suffix to those that carry it most often: a name is only ever taken from it
    by the name it extends. On a level the repeats of a name take the numbers from 2 in order. A number is skipped if its
    reserving row comes before the repeat that would reach it; otherwise the repeat takes it, and all rows of the reserving
    name are repeats on the next level. Whether a number is skipped depends on how many before it were (``fold``): the
    distinct reserved numbers of a name, not its rows, are read in order for that, by one task in constant memory. Rows
    are counted over ranges, so a name with most rows is spread over tasks.
    """
    stem, mark, count = F.regexp_extract("low", _STEM, 1), f"\\Q{suffix.lower()}\\E", "[2-9]|[1-9][0-9]{1,8}"
    own = f"^(.*[^/]){mark}({count})$"
    up = F.concat(F.regexp_extract(stem, own, 1), F.regexp_extract("low", _STEM, 2))
    p = p.withColumn("parent", F.when(stem.rlike(own), up)).withColumn("number", F.when(stem.rlike(own), F.regexp_extract(stem, own, 2).cast("bigint")))
    tail = F.regexp_extract(stem, f"^.*?[^/]((?:{mark}(?:{count}))+)$", 1)
    names = written(p.withColumn("level", F.size(F.split(tail, mark)) - 1), "collisions")
    deepest = names.agg(F.max("level")).first()[0]  # one number; a level a suffix in a name
    taken = names.where("false").select("low")
    out = []
    for level in range((deepest or 0) + 1):
        here = names.where(C("level") == level).join(taken.withColumn("lost", F.lit(1)), "low", "left") \
            .withColumn("j", C("k") - 1 + F.coalesce("lost", F.lit(0))).select("seq", "base_path", "low", "j")
        here = written(here, "collisions-level")
        out.append(here.where("j = 0").select("seq", "base_path", C("base_path").alias("new_path")))
        # the first row of a reserving name, among the repeats of the name it extends
        held = names.where((C("level") == level + 1) & (C("k") == 1)).select(C("parent").alias("low"), "seq", "number", C("low").alias("child"))
        repeats = here.where("j > 0")
        events = repeats.select("low", "seq", F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("string").alias("child"), F.lit(1).alias("one")) \
            .unionByName(held.withColumn("one", F.lit(0)))
        held = running(events, ["low"], ["seq"], earlier=("sum_before", "one")).where("number is not null") \
            .select("low", "number", "child", F.coalesce("earlier", F.lit(0)).alias("earlier"))
        held = held.repartition("low").sortWithinPartitions("low", "number")
        held = written(held.mapInPandas(_fold, "low string, child string, reached bigint, skipped boolean"), "collisions-held")
        taken = held.where("not skipped").select(C("child").alias("low"))
        marks = repeats.select("low", C("j").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("skip"), "seq", "base_path").unionByName(
            held.where("skipped").select("low", C("reached").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("skip"),
                                         F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("base_path")))
        numbers = running(marks, ["low"], ["at", "kind"], skips=("sum", "skip")).where("kind = 1")
        out.append(numbers.select("seq", "base_path", _numbered(C("base_path"), suffix, C("at") + 1 + C("skips")).alias("new_path")))
    return reduce(DataFrame.unionByName, out)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For reserved numbers in order: the repeat that reaches each, and whether that finds it used."""
    low, skips = None, 0
    for pdf in batches:
        reached, skipped = [], []
        for name, number, earlier in zip(pdf["low"], pdf["number"], pdf["earlier"]):
            if name != low:
                low, skips = name, 0
            reached.append(number - 1 - skips)
            skipped.append(earlier < reached[-1])
            skips += skipped[-1]
        yield pd.DataFrame({"low": pdf["low"], "child": pdf["child"], "reached": reached, "skipped": skipped})


def folder_counts(files: DataFrame) -> DataFrame:
    return (files.select(F.explode(_ancestors(C("path"), False)).alias("folder")).groupBy("folder")
            .agg(F.count(F.lit(1)).alias("files")).withColumn("depth", F.size(F.split("folder", "/")) - 1))


def hygiene_scan(files: DataFrame, folders: DataFrame, now_ms: int, per_name: int | None = None, report_rows: int | None = None) -> DataFrame:
    """Folder and file findings; ``per_name`` and ``report_rows`` cut repeated names and the ordered report."""
    stats = folder_stats(files, folders)
    year = 365 * 86400000
    empty = empty_folders(stats)
    row = lambda df, rank, kind, status, item: df.select(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"),
                                                         F.lit(status).alias("status"), C(item).alias("item"))
    named = C("name").rlike(r"(?i)\b(copy|old|backup|archive|final\s*final|temp|test)\b")
    out = [row(empty, 1, "Empty folder", "review", "folder"),
           row(stats.where("files > 0 and usable_files = 0"), 2, "System-only folder", "review", "folder"),
           row(stats.where((C("last_modified") > 0) & (F.lit(now_ms) - C("last_modified") > year) & (C("usable_files") > 0)),
               3, "Inactive folder", "attention", "folder"),
           row(stats.where(named & (C("usable_files") > 0)), 4, "Naming attention", "review", "folder")]
    tree = stats.where("depth > 1").withColumn("k", F.lower("name"))
    repeated = tree.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rep = join_back(tree, repeated, ["k"]).where("n > 1")
    rep = rep if per_name is None else top_k(rep, ["k"], ["folder"], per_name)
    out.append(row(rep, 5, "Repeated folder name", "info", "folder"))
    name = X.file_name(C("path"))
    f = files.withColumn("sys", X.is_system(C("path"))).withColumn("nm", name).withColumn("ext", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    out.append(row(f.where("sys"), 6, "System file", "review", "path"))
    out.append(row(f.where(~C("sys") & X.is_backup_or_temp(C("nm"))), 7, "Backup/temp file", "review", "path"))
    out.append(row(f.where(C("size") >= 250 * 1024 * 1024), 8, "Large file", "attention", "path"))
    old = C("ext").isin(".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".zip") & (C("modified_ms") > 0) & (F.lit(now_ms) - C("modified_ms") > year)
    out.append(row(f.where(old), 9, "Old export", "review", "path"))
    union = out[0]
    for o in out[1:]:
        union = union.unionByName(o)
    return union if report_rows is None else union.orderBy("kind_rank", "item").limit(report_rows)


def match_folders(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Folders that hold every described file (relative path and, if given, size).

    ``wanted(desc_id, folder_name, rel_path, size)``; one row per description.
    """
    w = wanted.select("desc_id", F.lower("folder_name").alias("fname"), F.lower("rel_path").alias("rel"), C("size").alias("w_size")).distinct()
    total = w.groupBy("desc_id").agg(F.count(F.lit(1)).alias("total"))
    p = X.parts(C("path"))
    spots = files.select("size", F.explode(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(
        F.array_join(F.slice(p, F.lit(1), i), "/").alias("folder"), F.lower(F.element_at(p, i)).alias("fname"),
        F.lower(F.array_join(F.slice(p, i + 1, F.size(p)), "/")).alias("rel")))).alias("s")).select("size", "s.*")
    hit = spots.join(w, ["fname", "rel"]).where(C("w_size").isNull() | (C("size") == C("w_size")))
    full = hit.groupBy("desc_id", "folder").agg(F.count(F.lit(1)).alias("n")).join(total, "desc_id").where("n = total")
    per = full.groupBy("desc_id").agg(F.count(F.lit(1)).alias("candidates"), F.min(F.struct(X.natural_key(C("folder")), "folder")).alias("m"))
    return total.join(per, "desc_id", "left").select(
        "desc_id", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.when(C("candidates").isNull(), "none").when(C("candidates") == 1, "matched").otherwise("multiple").alias("match_status"),
        F.when(C("candidates") == 1, C("m.folder")).alias("folder"))


def restore_plan(manifests: DataFrame, existing: DataFrame) -> DataFrame:
    """Entries of the newest run, shallow first; occupied targets fail."""
    last = manifests.groupBy("root").agg(F.max("run").alias("run"))
    e = manifests.join(last, ["root", "run"]).withColumn("depth", F.size(F.split("path", "/")).cast("bigint"))
    taken = existing.select("path").distinct().withColumn("taken", F.lit(True))
    return e.join(taken, "path", "left").select(
        "root", "run", "path", "depth", F.when(C("taken"), "failed").otherwise("restore").alias("outcome"),
        F.when(C("taken"), "Original path already exists.").otherwise("").alias("message"))


def archive_members(members: DataFrame) -> DataFrame:
    """Keywords and drawing type of an archive from its member names; system files dropped."""
    m = members.where(~X.is_system(C("member"))).withColumn("t", X.drawing_type(C("member")))
    per = m.groupBy("archive").agg(
        F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"),
        *[F.max(F.contains(F.upper("member"), F.lit(w))).alias(w) for w in X.QA_KEYWORDS],
        F.min_by("t", F.when(C("t") != "Unknown", C("seq"))).alias("first_type"))
    own = X.drawing_type(C("archive"))
    return per.select("archive", "members", "bytes",
                      F.when(own != "Unknown", own).otherwise(F.coalesce("first_type", F.lit("Unknown"))).alias("drawing_type"),
                      F.concat_ws(", ", *[F.when(C(w) | F.contains(F.upper("archive"), F.lit(w)), w) for w in sorted(X.QA_KEYWORDS)]).alias("keywords"))


def cleanup_summary(files: DataFrame, folders: DataFrame, plan: DataFrame) -> DataFrame:
    """Counters per parent over files, needed renames and what the removal plan drops."""
    r = rename_plan(plan)
    needs = C("would_rename") | (C("extension").isin(X.RENAME_SUPPORTED) & (C("base_path") != C("path")))
    return r.groupBy("parent_name").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(needs).alias("needs"), F.count_if("already_processed").alias("processed"),
        F.count_if(needs & C("excluded")).alias("needs_removed"), F.count_if(needs & C("by_folder")).alias("needs_by_folder"),
        F.count_if(needs & C("by_file")).alias("needs_by_file"), F.count_if(needs & C("by_folder") & C("by_file")).alias("overlap"),
        F.count_if(C("already_processed") & C("excluded")).alias("processed_removed"))


def folder_audit(rows: DataFrame, selected: DataFrame, source: str, definition: str, days: int) -> DataFrame:
    """Audit rows of reviewed folders."""
    sel = selected.select("folder").distinct().withColumn("sel", F.lit("yes"))
    return rows.join(sel, "folder", "left").select(
        F.lit(source).alias("source"), F.lit(definition).alias("empty_definition"), F.lit(days).alias("age_filter_days"), C("folder").alias("folder_path"),
        F.get(F.split("folder", "/"), F.lit(1)).alias("parent_folder"), "last_modified", F.lit("ready").alias("status"),
        F.coalesce("sel", F.lit("no")).alias("selected"), "reason")


def rename_file_detail(plan: DataFrame) -> DataFrame:
    """One report row per record of the rename plan."""
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    r = record_status(rename_plan(plan))
    return r.select("path", "parent_name", "secondary", "export_secondary", "file_name", "extension", "size", yes(C("extension").isin(X.RENAME_SUPPORTED)).alias("supported"),
                    yes(C("extension").isin(X.HEIC_FAMILY)).alias("heic"), yes(C("already_processed")).alias("processed"), C("base_path").alias("new_path"), "status",
                    F.when(C("excluded"), "Remove from ZIP").otherwise("Keep in ZIP").alias("zip_action"), yes(C("would_rename") & ~C("excluded")).alias("renamed"))


def rename_parent_summary(files: DataFrame) -> DataFrame:
    r = enrich_files(files).where(~C("is_system") & (C("depth") >= 4))
    per = r.groupBy("parent_name", "secondary").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("extension").isin(X.HEIC_FAMILY)).alias("h"))
    sums = per.groupBy("parent_name").agg(F.count(F.lit(1)).alias("secondary_folders"), F.sum("n").alias("files"), F.sum("h").alias("heic"))
    return sums.join(parent_status(files).drop("processed"), "parent_name")
