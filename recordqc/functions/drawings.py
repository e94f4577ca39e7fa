"""Column expressions on lines of drawing pages, with the fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordqc.functions.sheets import VIEW_SCALE, any_case

# Patterns of sheet numbers, title lines and views (case-insensitive).
SHEET_NUMBER = (r"\b(?:ADA|CS(?:[- .]?\d{1,4})?|(?:G|A|AD|ADA|AS|B|D|I|ID|IR|LS|L|C|S|SD|M|MD|MG|MP|MS|P|PD|PP|E|ED|EG|EL|EP|ES|FP|FA|T|MEP|MEPD|FS|SP)"
                r"[- .]?\d{1,4}(?:\.\d+)?(?:[-.]\d+)?[A-Z]?)\b")
NAMED_COVER = r"\bCS[- ]+[A-Z][A-Z0-9-]{1,20}\b"
LOOSE_NUMBER = r"\b[A-Z]{1,5}[- ]?\d{1,4}(?:\.\d+)?(?:[-.]\d+)?[A-Z]?\b"
TITLE_STOPWORD = (r"\b(?:PROJECT|OWNER|CLIENT|ARCHITECT|ENGINEER|CONSULTANT|DRAWN|CHECKED|DATE|SCALE|REVISION|SHEET|NUMBER|NO\.?|TITLE|ISSUE|ISSUED|SEAL|STAMP"
                  r"|LICENSE|COPYRIGHT)\b")
TITLE_METADATA = (r"(?:\b\d{3,6}\s+[A-Z0-9 .'-]+(?:AVE|AVENUE|BLVD|BOULEVARD|ST|STREET|RD|ROAD|DR|DRIVE|LN|LANE|HWY|HIGHWAY)\b"
                  r"|\b[A-Z .'-]+,?\s+(?:TX|TEXAS)\s+\d{5}(?:-\d{4})?\b|\b(?:SUITE|STE\.?|P\.?O\.?\s*BOX)\s+\w+\b"
                  r"|\b(?:PROJECT|JOB)\s*(?:NO\.?|NUMBER|#)?\s*\d{2,5}[-.]\d{2,5}\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}[-.]\d{3,5}\b"
                  r"|\b(?:TBPELS|FIRM\s+REGISTRATION)\b|\b(?:KNOW\s+WHAT'?S\s+BELOW|BEFORE\s+YOU\s+DIG|PRIOR\s+TO\s+DIGGING)\b|@|\b(?:COPYRIGHT|DO NOT REPRODUCE)\b)")
VIEW_LABEL = (r"\b((?:ENLARGED\s+)?(?:FLOOR|ROOF|SITE|UTILITY|LIGHTING|POWER|PLUMBING|MECHANICAL|ELECTRICAL|LANDSCAPE|FOUNDATION|FRAMING|DEMO(?:LITION)?"
              r"|DRAINAGE(?:\s*&\s*GRADING)?|DIMENSION(?:AL)?\s+CONTROL)\s+PLAN|REFLECTED\s+CEILING\s+PLAN|RCP|(?:[A-Z][A-Z0-9/&'.-]*\s+){1,5}DETAIL"
              r"|(?:(?:BUILDING|WALL|INTERIOR|EXTERIOR|INT\.?|ENLARGED)\s+)(?:SECTION|ELEVATION|DETAIL)|PERSPECTIVE)\b")
DETAIL_NUMBER = r"[A-Z]?\d{1,3}(?:\.\d+)?[A-Z]?"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|[\n\r]"), squeezed)


def whole(c: Column, pattern: str) -> Column:
    return c.rlike(rf"(?i)^(?:{pattern})$")


def is_number_line(line: Column) -> Column:
    """A short line that is nothing but a sheet number."""
    return (line != "") & (F.length(line) <= 24) & ((F.upper(F.replace(line, F.lit(" "))) == "ADA") | whole(line, NAMED_COVER) | whole(line, SHEET_NUMBER))


def index_number(line: Column) -> Column:
    """A named cover's number, or else the first sheet number of a line, without blanks."""
    named = F.regexp_extract(line, any_case(NAMED_COVER), 0)
    return F.upper(F.regexp_replace(F.when(named != "", named).otherwise(F.regexp_extract(line, any_case(SHEET_NUMBER), 0)), r"\s+", ""))


def clean_title(line: Column, number: Column) -> Column:
    """A line without its number if that can be a sheet title, or else ''."""
    edge = F.lit(" :-\t")
    own = F.concat(F.lit(r"(?i)\b\Q"), number, F.lit(r"\E\b"))
    t = F.btrim(squeezed(F.replace(line, F.lit("\0"), F.lit(" "))), edge)
    t = F.when(number != "", F.btrim(F.regexp_replace(t, own, F.lit("")), edge)).otherwise(t)
    barred = (~F.length(t).between(4, 90) | t.rlike(any_case(TITLE_METADATA)) | whole(t, TITLE_STOPWORD) | whole(t, SHEET_NUMBER) | whole(t, LOOSE_NUMBER)
              | t.rlike(r"(?i)\bNO\s+SHEET\s+NUMBER\b") | (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 4))
    return F.when(barred, "").otherwise(F.upper(t))


def plain_marks(c: Column) -> Column:
    """Typographic feet and inch marks as plain ones."""
    return F.translate(c, "‘’′“”″", "'''\"\"\"")


def scale_of(c: Column) -> Column:
    """The first scale of a text, normalised; '' if there is none."""
    flat = F.btrim(F.regexp_replace(F.upper(F.regexp_extract(plain_marks(c), any_case(VIEW_SCALE), 0)), r"\s+", " "), F.lit(" ."))
    return F.when(flat.rlike(r"^(?:N\.?T\.?S\.?|NOT TO SCALE|NO SCALE)$"), "NTS").otherwise(flat)


def detail_in(fragment: Column) -> Column:
    """A detail number that stands by itself in a fragment without its scale."""
    f = F.btrim(F.regexp_replace(plain_marks(fragment), any_case(VIEW_SCALE), " "), F.lit(" .:-"))
    return F.when(whole(f, DETAIL_NUMBER), f).otherwise(F.regexp_extract(f, rf"(?i)(?:^|\s)({DETAIL_NUMBER})(?:\s|$)", 1))
