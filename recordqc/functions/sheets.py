"""Column expressions on page texts and sheet numbers, with the fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the drawing-set checks (case-insensitive).
INDEX_HEADER = r"\b(?:SHEET\s+INDEX|DRAWING\s+INDEX|INDEX\s+OF\s+SHEETS|INDEX\s+OF\s+DRAWINGS|SHEET\s+LIST)\b"
OFFICIAL = (r"\b(?:100%\s+)?(?:PERMIT(?:\s+(?:SET|PDF|PACKAGE|DOCUMENTS?|DRAWINGS?))?|CONSTRUCTION\s+(?:SET|DOCUMENTS?|DRAWINGS?|PACKAGE)"
            r"|BID\s+SET|SIGNED\s+AND\s+SEALED)\b")
NON_OFFICIAL = r"\b(?:SD|DD|DESIGN\s+DEVELOPMENT|SCHEMATIC\s+DESIGN|PROGRESS\s+DRAWING|PROGRESS\s+SET|N\.?F\.?C\.?|NOT\s+FOR\s+CONSTRUCTION)\b"
SEAL = r"\b(?:SEAL|SIGNED|SIGNATURE|REGISTERED\s+ARCHITECT|ARCHITECT|TBAE|LICENSE|LIC\.?|AIA)\b"
KEYNOTE_SECTION = (r"(?:SHEET|PLAN|DEMOLITION(?:\s+PLAN)?|CONSTRUCTION(?:\s+PLAN)?|FLOOR\s+PLAN|ROOF\s+PLAN|REFLECTED\s+CEILING\s+PLAN)\s+KEYNOTES")
KEYNOTE_LEGEND = rf"\b(?:{KEYNOTE_SECTION}|KEYNOTE\s+LEGEND)\b"
SECTION_STOP = r"\b(?:GENERAL\s+NOTES|DEMOLITION\s+NOTES|PLAN\s+NOTES|CONSTRUCTION\s+NOTES|LEGEND|ABBREVIATIONS|SHEET\s+INDEX)\b"
VIEW_TITLE = (r"\b([A-Z0-9.-]{1,6})\s+(REFLECTED\s+CEILING\s+PLAN|FLOOR\s+PLAN|INT\.?\s+ELEVATION|ELEVATION|SECTION|DETAIL|PERSPECTIVE|PLAN)\s+"
              r"((?:\d+/\d+|\d+(?:\.\d+)?)\s*\"\s*=\s*(?:\d+|\d+/\d+)\s*'-?\s*\d*\"?|NTS)\b")
VIEW_SCALE = (r"\bN\.?T\.?S\.?\b|\bNOT\s+TO\s+SCALE\b|\bNO\s+SCALE\b|(?:\d+/\d+|\d+(?:\.\d+)?)\s*\"\s*=\s*"
              r"(?:\d+\s*'\s*(?:-\s*(?:\d+(?:\s+\d+/\d+)?)\s*\"?)?|\d+(?:\s+\d+/\d+)?\s*\")")
CALLOUT = r"\b(?:DETAIL|SECTION|ELEVATION)?\s*([A-Z0-9.-]{1,6})\s*/\s*([A-Z]{1,4}-?\d+(?:\.\d+)?)\b"
WORD = r"[A-Za-z][A-Za-z'-]{2,}"
TITLE_LABEL = (r"\b(?:ARCHITECT|CONSULTANT|ENGINEER|CLIENT|OWNER|CONTRACTOR|PROJECT|MANUFACTURER|COMPANY|ADDRESS|PHONE|EMAIL|WEBSITE|PERMIT|TDLR|"
               r"REGISTRATION|PROJECT\s+NO|JOB\s+NO|ISSUED\s+BY|DRAWN\s+BY|CHECKED\s+BY|CONTACT|CITY|LOCATION)\b")
# The named page patterns in their fixed order; firm names are added by ``keywords``.
KEYWORDS = [
    ("sheet_index", r"\b(?:SHEET|DRAWING)\s+INDEX\b|\bINDEX\s+PH\d*\b"),
    ("project_name", r"\bPROJECT\s+NAME\b|\bPROJECT\b"),
    ("project_address", r"\b(?:ADDRESS|LOCATION)\b|\b\d{2,6}\s+[A-Z0-9 .'-]+(?:ST|STREET|AVE|AVENUE|BLVD|ROAD|RD|DR|DRIVE|EXPRESSWAY|HIGHWAY|HWY)\b"),
    ("owner_client", r"\b(?:OWNER|CLIENT)\b"),
    ("issue_description", r"\b(?:ISSUED?\s+FOR|ISSUE\s+DESCRIPTION|PERMIT|BID|CONSTRUCTION|ISSUE)\b"),
    ("vicinity_map", r"\b(?:VICINITY|LOCATION)\s+MAP\b|\bSITE\s+LOCATION\b"),
    ("code_summary", r"\b(?:CODE\s+SUMMARY|CODE\s+ANALYSIS|BUILDING\s+CODE)\b"),
    ("occupancy_load", r"\b(?:OCCUPANCY|OCCUPANT\s+LOAD|LOAD\s+DATA)\b"),
    ("project_number", r"\b(?:PROJECT\s+NO\.?|PROJECT\s+NUMBER|JOB\s+NO\.?)\b|\b20\d{2}-\d{3,5}\b"),
    ("legend", r"\bLEGEND\b"),
    ("north_arrow", r"\bNORTH\b|\bN\.?\s*ARROW\b"),
    ("general_notes", r"\bGENERAL\s+NOTES?\b"),
    ("construction_notes", r"\bCONSTRUCTION\s+NOTES?\b"),
    ("keynotes", r"\bKEYNOTES?\b"),
    ("revision", r"\bREV(?:ISION)?\b|REVISION\s+CLOUD"),
    ("revision_block", r"\b(?:REVISION\s+BLOCK|REVISION\s+HISTORY|REVISIONS?)\b"),
    ("issue_date", r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"),
    ("scale", r"\bSCALE\b"),
    ("graphic_scale", r"\bGRAPHIC\s+SCALE\b"),
    ("professional_seal", r"\b(?:P\.?E\.?|AIA|REGISTERED|LICENSE|TBAE|TABS|SEAL|SIGNATURE)\b"),
    ("signature", r"\b(?:SIGNATURE|SIGNED|DIGITAL\s+SIGNATURE|DIGITALLY\s+SIGNED)\b"),
    ("registration_number", r"\b(?:REGISTRATION|LICENSE|NO\.|#)\s*[A-Z-]*\d{3,}\b|\bF-\d{3,}\b"),
    ("firm_information", r"\b(?:ARCHITECT|ENGINEERING|ARCHITECTURE|LLC|INC\.?|FIRM)\b"),
    ("firm_logo_name", r"\b(?:ARCHITECT|ARCHITECTURE|ENGINEERING)\b"),
    ("drawn_checked", r"\b(?:DRAWN|CHECKED|CHK|DRN|DRAWN\s+BY|CHECKED\s+BY)\b"),
    ("copyright", r"\b(?:COPYRIGHT|DO\s+NOT\s+REPRODUCE|ALL\s+RIGHTS\s+RESERVED)\b"),
    ("seal_placeholder", r"\b(?:SEAL|PROFESSIONAL\s+SEAL|STAMP)\b"),
    ("consultant_team", r"\b(?:CIVIL|STRUCTUR(?:E|AL)|MEP|MECHANICAL|ELECTRICAL|PLUMBING|LANDSCAPE|DESIGN\s+CONSULTANT\s+TEAM)\b"),
    ("placeholder", r"\b(?:PLACEHOLDER|TBD|TO\s+BE\s+DETERMINED|DUMMY|NOT\s+FOR\s+ISSUE)\b"),
    ("blank_marker", r"\b(?:INTENTIONALLY\s+BLANK|THIS\s+PAGE\s+INTENTIONALLY\s+LEFT\s+BLANK)\b"),
    ("door_schedule", r"\bDOOR\s+SCHEDULE\b"),
    ("room_finish_schedule", r"\bROOM\s+FINISH\s+SCHEDULE\b"),
    ("code_analysis", r"\bCODE\s+ANALYSIS\b"),
    ("life_safety", r"\bLIFE\s+SAFETY\b"),
    ("accessibility", r"\bACCESSIBILITY\b|\bACCESSIBLE\b"),
]
# Disciplines by sheet prefix.
DISCIPLINES = {"G": "General", "A": "Architectural", "AD": "Architectural", "I": "Interiors", "LS": "Life Safety", "C": "Civil", "S": "Structural",
               "M": "Mechanical", "P": "Plumbing", "E": "Electrical", "FP": "Fire Protection"}
# Known misspellings.
CORRECTIONS = {
    "accomodate": "accommodate", "accomodates": "accommodates", "accomodated": "accommodated", "accomodating": "accommodating",
    "seperation": "separation", "seperate": "separate", "seperated": "separated", "waterproofng": "waterproofing", "firestoping": "firestopping",
    "flasing": "flashing", "substrat": "substrate", "recieve": "receive", "recieved": "received", "occured": "occurred", "occurance": "occurrence",
    "maintainence": "maintenance", "clearence": "clearance", "accesible": "accessible", "acessible": "accessible", "commerical": "commercial",
    "construcion": "construction", "coordiante": "coordinate", "coordinationg": "coordinating", "requred": "required", "requirment": "requirement",
    "requirments": "requirements", "typcial": "typical", "typicaly": "typically", "teh": "the", "windw": "window", "widnow": "window",
    "adress": "address", "enviroment": "environment", "manuevering": "maneuvering", "manuvering": "maneuvering", "penatration": "penetration",
    "penatrations": "penetrations"}


def keywords(firms: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """The page patterns, with the caller's firm names (patterns) beside the general words of ``firm_logo_name``."""
    named = "".join("|" + f for f in firms)
    return [(k, p.replace("|ENGINEERING)", f"|ENGINEERING{named})") if k == "firm_logo_name" else p) for k, p in KEYWORDS]


def any_case(pattern: str) -> str:
    return "(?i)" + pattern


def normalize_number(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}.]", ""))


def discipline(number: Column) -> Column:
    prefix = F.regexp_extract(F.upper(number), "^([A-Z]+)", 1)
    table = F.create_map(*[F.lit(x) for kv in DISCIPLINES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, prefix), F.try_element_at(table, F.left(prefix, F.lit(1))), F.lit("General"))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(any_case(pattern))


def set_type(text: Column) -> Column:
    return F.when(has(text, NON_OFFICIAL), "Non-Official").when(has(text, OFFICIAL), "Official").otherwise("Unknown")


def after_first(text: Column, pattern: str) -> Column:
    """Text behind the first match; empty when there is none."""
    head = F.regexp_extract(text, rf"(?is)^(.*?{pattern})", 1)
    return F.when(head != "", F.substr(text, F.length(head) + 1)).otherwise("")


def until_first(text: Column, pattern: str) -> Column:
    return F.when(has(text, pattern), F.regexp_extract(text, rf"(?is)^(.*?){pattern}", 1)).otherwise(text)


def has_keynote_section(text: Column) -> Column:
    """A keynotes heading that is not negated (``NO SHEET KEYNOTES``)."""
    p = rf"\b{KEYNOTE_SECTION}\b"
    return F.regexp_count(text, F.lit(any_case(p))) > F.regexp_count(text, F.lit(any_case(r"\b(?:NO|WITHOUT|LACKS?)\s+" + p[2:])))
