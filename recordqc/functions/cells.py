"""Column expressions that interpret spreadsheet cells and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unknown markers, total labels, equipment tags, building types, note rules.
UNKNOWN = r"(?i)^(\?+|-+|tbd\.?|n/?a\.?|unknown|not known|not sure( yet)?|to be confirmed|not shown|not provided|not found|no file|no mechanical cd|no electrical cd)$"
TOTALS = r"^(total|project total|total tonnage|combined tonnage|grand total|total lf|total linear feet|total panels|subtotal)( |$)"
EQUIPMENT = [("RTU", "Packaged rooftop unit"), ("AHU", "Air-handling unit"), ("FCU", "Fan-coil unit"), ("CU", "Condensing unit"), ("HP", "Heat pump"),
             ("DOAS", "Dedicated outdoor-air system"), ("MAU", "Make-up air unit"), ("VAV", "Variable-air-volume terminal"), ("EF", "Exhaust fan"),
             ("ERV", "Energy-recovery ventilator"), ("VRF / VRV", "Variable-refrigerant-flow system"), ("Mini-split", "Split system"), ("Split", "Split system")]
SPECIAL_TAGS = {"VRF / VRV": r"\b(VRF|VRV)(\b|[-_\d])", "Mini-split": r"\bmini[- ]?split\b", "Split": r"\bsplit\b"}
BUILDING_TYPES = [
    ("Medical Office", r"\b(medical office|medical center|mob)\b"), ("Healthcare", r"\b(clinic|chiropractic|veterinary|wellness|behavioral health)\b"),
    ("Public Safety", r"\b(fire station|police station|public safety)\b"), ("Education", r"\b(school|academy|institute|university|college|stisd)\b"),
    ("Storage / Industrial", r"\b(storage|warehouse|industrial)\b"), ("Restaurant / Food Service", r"\b(restaurant|smoothie|cafe|coffee|food)\b"),
    ("Retail / Tenant Finish-Out", r"\b(retail|plaza|shopping|store|finish out|tenant)\b"), ("Office", r"\b(office|law office|corporate|headquarters|hq)\b"),
    ("Financial", r"\b(bank|credit union|financial)\b"), ("Religious", r"\b(church|chapel|ministry|worship)\b"),
    ("Government / Civic", r"\b(public works|city of|county|municipal|government)\b"), ("Residential", r"\b(residential|apartment|housing|multifamily)\b")]
NOTE_ISSUES = [
    ("Missing mechanical drawings", "Blocking", r"no mechanical (cd|construction documents?)|no mechanical .*server|missing mechanical drawings?"),
    ("Missing electrical drawings", "Blocking", r"no electrical (cd|construction documents?)|no electrical .*server|missing electrical drawings?"),
    ("No file found on server", "Blocking", r"no file( found)?( on (the )?server)?"),
    ("Incomplete consultant set", "Warning", r"equipment schedule only|partial equipment schedule|only provided for"),
    ("Square footage not shown", "Blocking", r"square footage (is )?not shown|no (overall )?(sf|square footage)")]
SUGGESTIONS = [("systemType=Variable air volume", r"\bvav\b"), ("equipmentType=Air-handling unit", r"\bair[- ]?handler|\bahu(\b|[-_\d])"),
               ("equipmentType=Packaged rooftop unit", r"\brtu(\b|[-_\d])"), ("existingCondition=true", r"\bexisting\b")]
FIELD_ALIASES = {
    "projectNumber": ["project number", "project no", "project #", "job number", "job no", "project id"],
    "projectName": ["project name", "job name", "name of project"],
    "consultant": ["mep", "mep consultant", "consultant", "electrical consultant", "engineer"],
    "buildingType": ["building type", "project type", "facility type", "occupancy"],
    "squareFeet": ["overall sf", "overall square footage", "square footage", "building sf", "total sf", "sf"],
    "projectTonnage": ["project total hvac tonnage", "project total tonnage", "total hvac tonnage", "total tonnage", "combined tonnage", "grand total tons",
                       "project tons"],
    "projectDuctFeet": ["project total duct linear feet", "total duct linear feet", "total linear feet", "total lf", "project duct feet"],
    "unitName": ["unit name", "equipment name", "equipment tag", "unit tag", "tag", "name"],
    "tonnage": ["individual tonnage", "unit tonnage", "tonnage", "tons", "capacity tons"],
    "unitType": ["unit type", "equipment type", "system type", "type"],
    "quantity": ["quantity", "qty", "unit quantity", "equipment quantity", "count"],
    "manufacturer": ["manufacturer", "mfr", "make"],
    "model": ["model", "model number", "model no"],
    "ductFeet": ["linear ft", "linear feet", "duct linear ft", "duct length", "duct ft"],
    "classification": ["classification", "standard unusual custom", "equipment classification"],
    "notes": ["notes", "comments", "remarks", "other information", "error note"],
}
UNIT_COUNT = r"\b(\d+)\s+(?:existing\s+)?(?:rtu|ahu|fcu|unit|units)\b"
RATIO = r"^\s*(\d[\d,]*(?:\.\d+)?)\s*:\s*(\d[\d,]*(?:\.\d+)?)\s*:\s*(\d[\d,]*(?:\.\d+)?)\s*$"
SQUARE_FEET = r"(?i)(-?\d[\d,]*(?:\.\d+)?)\s*(?:sf|sq\.?\s*ft\.?|square\s*feet)\b"
TAG = r"(?i)\b(RTU|AHU|FCU|CU|HP|DOAS|MAU|VAV|EF|ERV|VRF|VRV)(\b|[-_\d])|[A-Za-z]{2,}[-_ ]?\d+[A-Za-z]?\b"


def tag_pattern(code: str) -> str:
    return "(?i)" + SPECIAL_TAGS.get(code, rf"\b{code}(\b|[-_\d])")


def cleaned(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(cleaned(c)), "[^a-z0-9]+", " "))


def is_unknown(c: Column) -> Column:
    return cleaned(c).rlike(UNKNOWN)


def number(c: Column) -> Column:
    """First signed number of a cell; commas dropped, unknown markers null."""
    return F.when(~is_unknown(c), F.regexp_extract(F.regexp_replace(c, ",", ""), r"(-?\d+(?:\.\d+)?)", 1)).try_cast("double")


def square_feet(c: Column) -> Column:
    """The last number that names its unit, else the first number."""
    named = F.regexp_extract_all(c, F.lit(SQUARE_FEET), F.lit(1))
    return F.when(is_unknown(c), F.lit(None)).when(F.size(named) > 0, F.regexp_replace(F.element_at(named, -1), ",", "").try_cast("double")).otherwise(number(c))


def ratio_part(c: Column, i: int) -> Column:
    return F.when(c.rlike(RATIO), F.regexp_replace(F.regexp_extract(c, RATIO, i), ",", "").try_cast("double"))


def is_total(c: Column) -> Column:
    return label(c).rlike(TOTALS)


def is_tag(c: Column) -> Column:
    return cleaned(c).rlike(TAG)


def is_strong_name(c: Column) -> Column:
    text = cleaned(c)
    return ((text != "") & ~is_total(c) & ~is_tag(c) & ~text.rlike(RATIO) & ~text.rlike("(?i)^(error|issue|note|unknown|tbd)$")
            & ~text.rlike("(?i)^(carrier|trane|lennox|york|daikin|mitsubishi|aaon)$")
            & ~text.rlike(r"(?i)\bexisting\b|\bserving\b|\bvav\b|no mechanical|no electrical|not sure|fill in info"))


def equipment(c: Column, which: int) -> Column:
    """First matching tag: its code (0) or normalised type (1)."""
    out = F.when(F.lit(False), "")
    for row in EQUIPMENT:
        out = out.when(cleaned(c).rlike(tag_pattern(row[0])), row[which])
    return out


def building_type(c: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, rx in BUILDING_TYPES:
        out = out.when(label(c).rlike(rx), kind)
    return out


def note_suggestions(c: Column) -> Column:
    text = cleaned(c)
    count = F.regexp_extract(text, "(?i)" + UNIT_COUNT, 1)
    found = [F.when(text.rlike("(?i)" + rx), name) for name, rx in SUGGESTIONS] + [F.when(count != "", F.concat(F.lit("unitCount="), count))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def note_issues(c: Column) -> Column:
    found = [F.when(F.lower(cleaned(c)).rlike(rx), F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"))) for cat, sev, rx in NOTE_ISSUES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
