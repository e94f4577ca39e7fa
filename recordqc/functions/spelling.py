"""Words and patterns of the spelling rules, and expressions on single words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordqc.functions import sheets as X

# Words of the trade that are never misspelled.
TRADE = """soffit gypsum millwork storefront egress parapet cladding firestopping waterproofing flashing substrate cmu eifs lvl act vct ada ansi astm
bldg clearance concealed continuous coordination demolition fastener fasteners finish finishes firestop firestopped framing glazing membrane maneuvering
masonry penetration penetrations rated required rough-in sealant sheathing termination typical verify shaped resistant mounted braced framed sized grade
height width""".split()
# Second parts of a compound whose first part is one letter.
COMPOUND = "shaped rated resistant mounted braced framed sized grade height width".split()
# What marks a line or a context as title-block matter.
BUSINESS = (r"\b(?:LLC|INC|CO|CORP|CORPORATION|COMPANY|LTD|LP|LLP|PLLC|PA|ARCHITECTS?|ENGINEERS?|ENGINEERING|CONSULTANTS?|CONTRACTORS?|CONSTRUCTION|"
            r"MANUFACTURING|SYSTEMS|PRODUCTS)\b")
ADDRESS = (r"(?:\b\d{1,6}\s+(?:[A-Za-z0-9'.-]+\s+){0,5}(?:STREET|ST|ROAD|RD|AVENUE|AVE|BOULEVARD|BLVD|DRIVE|DR|LANE|LN|COURT|CT|CIRCLE|CIR|HIGHWAY|HWY|"
           r"PARKWAY|PKWY|LOOP|WAY|PLAZA|PLZ)\b)|(?:\b(?:SUITE|STE|UNIT|BLDG|BUILDING|ROOM|RM|FLOOR|FL)\.?\s*[A-Z0-9-]+\b)|(?:\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b)")
CONTACT = (r"(?:[A-Z0-9._%+-]@[A-Z0-9.-]+\.[A-Z]{2,})|(?:(?:HTTPS?://|WWW\.)\S+)|(?:\b(?:PHONE|TEL|FAX|EMAIL|WEB|WEBSITE|WWW)\b)|"
           r"(?:\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4})")
NUMBERED = r"\b(?:PROJECT|PROJ|JOB|PERMIT|TDLR|REGISTRATION|APPLICATION|NO|NUMBER|#)\b[^A-Z0-9]{0,8}[A-Z0-9][A-Z0-9.-]{2,}"
TOKEN = "[A-Za-z][A-Za-z'.-]{2,}"
#: A line with one of the first four is a source of names; a context with any of the five is not judged.
LINE_MARKS = [X.TITLE_LABEL, BUSINESS, ADDRESS, CONTACT]
CONTEXT_MARKS = [CONTACT, ADDRESS, NUMBERED, X.TITLE_LABEL, BUSINESS]


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches; accented letters are letters at word ends whatever the Java release (``U``)."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike("(?iU)" + p)
    return out


def plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "[^A-Za-z0-9]", ""))


def compound_parts(word: Column) -> Column:
    """Lower-case parts of a word with hyphens; null without two of them."""
    parts = F.filter(F.transform(F.split(F.lower(word), "-"), lambda p: F.regexp_replace(p, "^'+|'+$", "")), lambda p: p != "")
    return F.when(F.contains(word, F.lit("-")) & (F.size(parts) > 1), parts)


def singulars(word: Column) -> Column:
    """What a plain word may be the plural of; empty where it does not look like a plural."""
    cut = lambda n, tail="": F.concat(F.left(word, F.length(word) - n), F.lit(tail))
    made = F.array(F.when(word.endswith("ies") & (F.length(word) > 4), cut(3, "y")),
                   F.when(word.rlike("(?:ch|sh|x|z|s)es$") & (F.length(word) > 4), cut(2)),
                   F.when(~word.endswith("ss"), cut(1)))
    return F.when(word.endswith("s") & (F.length(word) > 3), F.array_compact(made)).otherwise(F.array().cast("array<string>"))


def neighbourhood(word: Column) -> Column:
    """The word and all that one deletion makes of it; words one edit apart (insert, delete, replace, swap) share an entry."""
    return F.array_distinct(F.concat(F.array(word), F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different words are one insertion, deletion, replacement or swap of neighbours apart."""
    swapped = lambda i: F.concat(F.left(a, i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b
    return (F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swapped))
