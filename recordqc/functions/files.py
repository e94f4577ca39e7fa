"""Column expressions on file paths and names. All are shuffle-free."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension families, system file names and backup suffixes.
SYSTEM_NAMES = [".ds_store", "thumbs.db", "desktop.ini"]
RENAME_SUPPORTED = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif", "mov", "pdf"]
JPG_FAMILY = ["jpg", "jpeg", "heic", "heif"]
HEIC_FAMILY = ["heic", "heif"]
IMAGE = ["jpg", "jpeg", "png", "heic", "tif", "tiff", "webp"]
DOCUMENT = ["pdf", "doc", "docx", "xls", "xlsx", "rtf"]
DESIGN = ["3dm", "dwg", "dxf", "skp", "rvt", "obj", "fbx"]
VIDEO = ["mov", "mp4"]
ORIGINALS = ["dwg", "skp", "pdf", "doc", "docx", "xls", "xlsx", "rtf", "3dm", "dxf", "rvt", "jpg", "jpeg", "png",
             "tif", "tiff", "webp", "mp4", "mov"]
BACKUP_SUFFIXES = [
    (".dwg.bak", "dwg", "AutoCAD .bak file related to DWG"),
    (".3dmbak", "3dm", "Rhino backup/autosave file related to 3DM"),
    (".bak", "", "Backup file related to primary source"),
    (".tmp", "", "Temporary/recovery file related to primary source"),
    (".autosave", "", "Autosave file related to primary source"),
    (".backup", "", "Backup file related to primary source"),
    (".recovered", "", "Recovered file related to primary source"),
    (".rhl", "3dm", "Rhino lock/recovery file related to 3DM"),
    (".sv$", "dwg", "AutoCAD autosave file related to DWG"),
    (".$v$", "dwg", "AutoCAD autosave file related to DWG"),
    (".ac$", "dwg", "AutoCAD temporary file related to DWG"),
    (".rws", "3dm", "Rhino workspace/recovery file related to 3DM"),
    (".rhk", "3dm", "Rhino backup/recovery file related to 3DM"),
    (".skb", "skp", "SketchUp .skb backup file related to SKP"),
]
CLEAR_BACKUP_ENDINGS = [".bak", ".3dmbak", ".dwg.bak", ".sv$", ".$v$", ".ac$", ".skb", ".tmp", ".backup", ".autosave",
                        ".recovered"]
BACKUP_FOLDER = r"(?i)\b(backup|backups|autosave|auto-save|recovery|recover|temp|temporary|archive)\b"
VERSION_NAME = (r"(?i)(?:^|[_\s-])(?:v(?:ersion)?\s*\d+|rev(?:ision)?\s*\d+|old|older|previous|final|draft)"
                r"(?:$|[_\s-]|\d)")
COPY_NAME = r"(?i)(?:\s-\scopy\b|[_\s-](?:copy|duplicate|dupe)\b|\(\d+\)\s*$)"
COPY_FOLDER = r"(?i)(?:^|[\s._-])copy(?:[\s._-]|\d|$)"
NAME_TAILS = [r"\s-\scopy\b", r"[_\s-]+(copy|backup|old|duplicate|final copy|revised copy|back up)\b",
              r"[_\s-]+(?:v(?:ersion)?\s*\d+|rev(?:ision)?\s*\d+|draft|previous|recovered|recovery|temp)\b",
              r"\s*\(\d+\)\s*$"]
BACKUP_WORDS = r"\b(?:autosave|auto save|backup|back up|recovered|recovery|temp|temporary)\b"
NAMED_BACKUP = r"^(.*?)(?:[_\s-]+(?:autosave|auto-save|backup|back up|recovered|recovery|temp|temporary))$"
RECOVERY_NAME = r"^(.*?)(?:[_\s-]+recovered|[_\s-]+recovery|[_\s-]+temp)$"
NUMBERED_RVT = r"^(.*)\.\d{3,4}\.rvt$"
DRAWING_TYPES = [
    ("Architectural", ["ARCHITECTURAL", "FLOOR PLAN", "REFLECTED CEILING", "ELEVATION"]),
    ("Civil", ["CIVIL", "SITE PLAN", "GRADING", "DRAINAGE"]),
    ("Structural", ["STRUCTURAL", "FOUNDATION", "FRAMING"]),
    ("Mechanical", ["MECHANICAL", "HVAC", "DUCT"]),
    ("Electrical", ["ELECTRICAL", "POWER PLAN", "LIGHTING"]),
    ("Plumbing", ["PLUMBING", "PIPING", "SANITARY"]),
    ("Fire Protection", ["FIRE PROTECTION", "SPRINKLER"]),
]
QA_KEYWORDS = ["SCALE", "KEYNOTES"]


def natural_key(c: Column) -> Column:
    """Sort key: case-insensitive, digit runs by number; the path itself breaks ties."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def padded(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 3, "0"), digits)).otherwise(run)
    return F.array_join(F.transform(runs, padded), "")


def parts(path: Column) -> Column:
    clean = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    return F.filter(F.split(clean, "/"), lambda p: p != "")


def part(path: Column, i: int) -> Column:
    return F.get(parts(path), F.lit(i))


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def folder_of(path: Column) -> Column:
    p = parts(path)
    return F.array_join(F.slice(p, 1, F.size(p) - 1), "/")


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def base_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1), F.lit("")), name)


def is_system_name(name: Column) -> Column:
    return F.lower(name).isin(SYSTEM_NAMES) | name.startswith("._")


def is_system(path: Column) -> Column:
    return is_system_name(F.substring_index(path, "/", -1))


def file_class(ext: Column) -> Column:
    return (F.when(ext.isin(IMAGE), "image").when(ext == "pdf", "pdf").when(ext.isin(DOCUMENT), "document")
            .when(ext.isin(DESIGN), "design").when(ext.isin(VIDEO), "video").otherwise("unsupported"))


def review_group(ext: Column) -> Column:
    kind = file_class(ext)
    return F.when(kind == "design", "cad").when(kind == "unsupported", "other").otherwise(kind)


def comparable_name(base: Column) -> Column:
    out = F.lower(base)
    for tail in NAME_TAILS:
        out = F.regexp_replace(out, tail, "")
    return F.trim(F.regexp_replace(out, r"[_\s-]+", " "))


def backup_kind(name: Column) -> Column:
    """Null for a normal file, else struct(suffix, primary, detail); the first matching pattern wins."""
    def kind(suffix, primary, detail):
        return F.struct(F.lit(suffix).alias("suffix"), F.lit(primary).alias("primary"), F.lit(detail).alias("detail"))
    low, out = F.lower(name), F.when(F.lit(False), kind("", "", ""))
    for suffix, primary, detail in BACKUP_SUFFIXES:
        out = out.when(low.endswith(suffix), kind(suffix, primary, detail))
    return (out.when(low.rlike(NUMBERED_RVT), kind(".####.rvt", "rvt", "Revit numbered backup file related to RVT"))
            .when(low.rlike(RECOVERY_NAME), kind("recovery", "", "Adobe temp/recovery file related to primary source"))
            .when(F.regexp_extract(F.lower(base_name(name)), NAMED_BACKUP, 1) != "",
                  kind("backup-name", "", "Backup/autosave file related to primary source")))


def backup_stem(name: Column, suffix: Column) -> Column:
    """The part of a backup's name that points at its source, before normalising."""
    low = F.lower(name)
    return (F.when(suffix == ".####.rvt", F.regexp_extract(low, NUMBERED_RVT, 1))
            .when(suffix == "recovery", F.regexp_extract(low, RECOVERY_NAME, 1))
            .when(suffix == "backup-name", F.regexp_extract(F.lower(base_name(name)), NAMED_BACKUP, 1))
            .when(suffix.isNotNull(), base_name(F.left(name, F.length(name) - F.length(suffix)))))


def backup_source(stem: Column, suffix: Column, comparable: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(comparable, BACKUP_WORDS, ""), r"\s+", " "))
    return (F.when(suffix.isin(".####.rvt", "recovery"), stem).when(suffix == "backup-name", comparable)
            .when(suffix.isNotNull(), plain))


def date_numbers(name: Column) -> Column:
    """The three number texts of a date-like folder name, or an empty array."""
    text = F.trim(name)
    return F.when(text.rlike(r"^(\d{1,4})[\s._-]+(\d{1,2})[\s._-]+(\d{1,4})$"), F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)))


def date_folder(name: Column, numbers: Column | None = None) -> Column:
    """``YYYY.MM.DD`` for a recognisable date folder, else the name unchanged.

    ``numbers`` takes the column of ``date_numbers`` when it is already there.
    """
    t = date_numbers(name) if numbers is None else numbers

    def parsed(x: Column) -> Column:
        a, b, c = (F.get(x, F.lit(i)) for i in range(3))
        full = lambda y: F.when(y.cast("int") >= 70, y.cast("int") + 1900).otherwise(y.cast("int") + 2000)
        ymd = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
        return (F.when(F.length(a) == 4, ymd(a, b, c)).when(F.length(c) == 4, ymd(c, a, b))
                .when(a.cast("int") > 12, ymd(full(a), b, c)).when(c.cast("int") > 12, ymd(full(c), a, b)))

    def checked(d: Column) -> Column:
        real = (d["y"].between(1900, 2200) & d["m"].between(1, 12) & d["d"].between(1, 31)
                & F.try_to_timestamp(F.format_string("%04d-%02d-%02d", d["y"], d["m"], d["d"]), F.lit("yyyy-MM-dd")).isNotNull())
        return F.when(real, F.format_string("%d.%02d.%02d", d["y"], d["m"], d["d"]))
    # transform over a one-element array keeps each step evaluated once
    got = F.get(F.transform(F.transform(F.array(t), parsed), checked), F.lit(0))
    return F.when(t.isNotNull(), F.coalesce(got, name)).otherwise(name)


def export_extension(ext: Column) -> Column:
    return F.when(ext.isin(JPG_FAMILY), "jpg").otherwise(F.lower(ext))


def normalized_file_name(name: Column, base: Column, ext: Column) -> Column:
    return F.when(ext == "", name).otherwise(F.concat(base, F.lit("."), export_extension(ext)))


def needs_processing(folder: Column, export_name: Column) -> Column:
    """Not yet a clean date folder; ``export_name`` is ``date_folder(folder)``."""
    clean = F.trim(folder).rlike(r"^\d{4}\.\d{2}\.\d{2}$") & (export_name == F.trim(folder))
    return ~clean | (folder != export_name)


def already_processed(name: Column, ext: Column, secondary: Column, export_name: Column) -> Column:
    """Supported file in a clean date folder called ``<folder>_NNN.<ext>``."""
    stem_ok = F.lower(F.left(name, F.length(secondary) + 1)) == F.lower(F.concat(secondary, F.lit("_")))
    rest = F.lower(F.substr(name, F.length(secondary) + 2))
    tail_ok = rest.rlike(r"^[0-9]{3}\.") & (F.substr(rest, F.lit(5)) == export_extension(ext))
    return F.coalesce(ext.isin(RENAME_SUPPORTED) & ~needs_processing(secondary, export_name) & stem_ok & tail_ok, F.lit(False))


def sheet_number_from_name(name: Column) -> Column:
    return F.regexp_extract(F.upper(base_name(name)), r"\b([A-Z]{0,3}\d{2,4}(?:\.\d+)?)\b", 1)


def sheet_title_from_name(name: Column, number: Column) -> Column:
    stem = base_name(name)
    cut = F.when(number == "", stem).otherwise(F.regexp_replace(stem, F.concat(F.lit("(?i)\\Q"), number, F.lit("\\E")), F.lit("")))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(cut, r"[_\-]+", " ")), r"\s+", " "))


def drawing_type(text: Column) -> Column:
    up, out = F.upper(text), None
    for kind, words in DRAWING_TYPES:
        hit = F.lit(False)
        for w in words:
            hit = hit | up.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Unknown")


def keywords_in(text: Column, words: list[str] = QA_KEYWORDS) -> Column:
    up = F.upper(text)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(up, w))


def is_backup_or_temp(name: Column) -> Column:
    low = F.lower(name)
    return low.startswith("~$") | low.rlike(r"\.(bak|tmp|temp|old|skb|dwl|dwl2|sv\$)$") | low.rlike(r"\.\d{4}\.rvt$")
