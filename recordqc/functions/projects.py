"""Column expressions on project records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALWAYS_UPPER = ["MEP", "DBR", "A&G", "LLC", "PLLC", "M&E"]  # fixed values


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def consultant_key(c: Column) -> Column:
    return F.lower(clean(c))


def consultant_name(c: Column) -> Column:
    """Display name: mixed case is kept, all-upper or all-lower names get title case."""
    name = clean(c)
    words = F.split(name, " ")
    rest_lower = F.forall(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))), lambda w: w == F.lower(w))
    acronym = (F.size(words) > 1) & F.get(words, F.lit(0)).rlike("^[A-Z&]{2,5}$") & rest_lower
    keep = (name != F.upper(name)) & (name != F.lower(name)) & ~acronym

    def one(w: Column) -> Column:
        return (F.when(F.upper(w).isin(ALWAYS_UPPER), F.upper(w))
                .when(w.rlike("^[A-Z0-9&]{2,4}$") & ~w.rlike("^[A-Z]{2,4}$"), F.upper(w))
                .otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))))
    return (F.when((name == "") | (F.lower(name) == "unknown"), "Unknown").when(keep, name)
            .otherwise(F.array_join(F.transform(words, one), " ")))


def meaningful(c: Column, strict: bool = False) -> Column:
    blank = ["", "Unknown", "Not recorded"] if strict else ["", "Unknown"]
    return c.isNotNull() & ~F.trim(c).isin(blank)


def js_round(c: Column) -> Column:
    """Half up toward plus infinity, unlike ``round``."""
    return F.floor(c + 0.5)


def round_half(c: Column) -> Column:
    return js_round(c * 2) / 2


def round_ten(c: Column) -> Column:
    return js_round(c / 10) * 10


def one_decimal(c: Column) -> Column:
    return js_round(c * 10) / 10


def normalize_project_number(c: Column) -> Column:
    """Upper case, plain hyphens, no blanks around them."""
    dashed = F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), "\u2010\u2011\u2012\u2013\u2014\u2212", "------")
    return F.regexp_replace(F.regexp_replace(dashed, r"\s*-\s*", "-"), r"\s+", " ")


def project_key(number: Column, name: Column) -> Column:
    num = normalize_project_number(number)
    return F.when(num != "", F.concat(F.lit("number:"), num)).otherwise(F.concat(F.lit("name:"), F.lower(F.trim(F.coalesce(name, F.lit(""))))))
