"""Spelling of page texts against a frequency dictionary: known corrections, then dictionary words one edit away.

Words are judged once for each set, not at each place. A word that nothing knows meets the dictionary over a deletion neighbourhood: two words one
edit apart share a string that one deletion (or none) makes of either, so an equality join finds them. Such a string belongs to at most 27 words for each
place in it, so no key is hot whatever the sizes. The most frequent word is suggested, of equally frequent ones the first by alphabet.

No side of a join is known to be small: a word list of a few MB as a file is many times that as rows and again as neighbourhoods. So all joins are
asked for as merge joins and nothing is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.functions import sheets as X
from recordqc.functions import spelling as W
from recordqc.operators.scale import first_per
from recordqc.session import written

C = F.col
RADIUS = 70


def _tokens(text: Column) -> Column:
    """Plain words of a title-block line; a name in the possessive also without it."""
    raw = F.regexp_extract_all(text, F.lit(f"({W.TOKEN})"), F.lit(1))
    good = F.filter(raw, lambda w: (F.length(W.plain(w)) > 2) & ~W.plain(w).isin(list(X.CORRECTIONS)))
    owners = F.transform(F.filter(good, lambda w: w.endswith("'s")), lambda w: W.plain(F.left(w, F.length(w) - 2)))
    return F.array_distinct(F.concat(F.transform(good, W.plain), owners))


def title_words(pages: DataFrame) -> DataFrame:
    """(set_id, word): words of a set's title-block lines, sheet titles, and those that two of its title blocks repeat."""
    block = F.coalesce("title_block_text", F.lit(""))
    lines = pages.select("set_id", F.explode(F.split(F.concat(block, F.lit("\n"), F.coalesce("text", F.lit(""))), r"[\r\n]+")).alias("line"))
    named = lines.where(W.any_of(C("line"), W.LINE_MARKS)).select("set_id", F.explode(_tokens(C("line"))).alias("word"))
    titles = pages.select("set_id", F.explode(_tokens(C("sheet_title"))).alias("word"))
    twice = pages.select("set_id", F.explode(_tokens(block)).alias("word")).groupBy("set_id", "word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.unionByName(titles).unionByName(twice.select("set_id", "word")).distinct()


def lexicon(dictionary: DataFrame, custom: list[str]) -> DataFrame:
    """(word, n): the dictionary with the words of the trade (2 each) and the caller's own (1 each) added."""
    own = [(w, 2) for w in W.TRADE] + [(w.lower(), 1) for w in sorted(set(custom))]
    extra = dictionary.sparkSession.createDataFrame(own, "word string, n bigint")
    return dictionary.select("word", C("n").cast("bigint")).unionByName(extra).where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


def within_one_edit(words: DataFrame, known: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, word, near, n): entries ``near`` of ``known`` one edit away from ``word``. Both have different words for each ``by``."""
    by = by or []
    left = words.select(*by, "word", F.explode(W.neighbourhood(C("word"))).alias("key"))
    right = known.select(*by, C("word").alias("near"), "n", F.explode(W.neighbourhood(C("word"))).alias("key"))
    return left.join(right.hint("merge"), [*by, "key"]).where("word <> near").where(W.one_edit(C("word"), C("near"))).select(*by, "word", "near", "n").distinct()


def _places(pages: DataFrame) -> DataFrame:
    """(set_id, doc_id, word, starts): each different word of a page with its offsets in code points."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    found = re.compile(X.WORD)
    schema = pages.select("set_id", "doc_id", F.lit("").alias("word"), F.array(F.lit(0)).alias("starts")).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for set_id, doc_id, text in zip(*[c.to_pylist() for c in b.columns]):
                at: dict[str, list[int]] = {}
                for m in found.finditer(text or ""):
                    at.setdefault(m.group(), []).append(m.start())
                if at:
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([set_id] * n, arrow.field(0).type), pa.array([doc_id] * n, arrow.field(1).type),
                                                      pa.array(list(at), arrow.field(2).type), pa.array(list(at.values()), arrow.field(3).type)], schema=arrow)

    return pages.select("set_id", "doc_id", "text").mapInArrow(run, schema)


def _judged(words: DataFrame, known: DataFrame, names: DataFrame, own: list[str]) -> DataFrame:
    """(set_id, word, suggestion, source) of each word that is misspelled."""
    words = words.withColumn("plain", W.plain(C("word"))).withColumn("parts", W.compound_parts(C("word")))
    fix = F.try_element_at(F.create_map(*[F.lit(x) for kv in X.CORRECTIONS.items() for x in kv]), C("plain"))
    words = words.withColumn("fix", fix).where(C("fix").isNull() | ~C("plain").isin(own))
    lettered = F.coalesce((F.length(C("parts")[0]) == 1) & C("parts")[1].isin(W.COMPOUND), F.lit(False))
    words = words.where(~lettered)

    # all that a word is looked up by: itself, its parts, its singulars
    tests = F.concat(F.array(F.struct(F.lit("self").alias("role"), C("plain").alias("look"))),
                     F.transform(F.coalesce("parts", F.array().cast("array<string>")), lambda p: F.struct(F.lit("part").alias("role"), p.alias("look"))),
                     F.transform(F.when(C("fix").isNull(), W.singulars(C("plain"))).otherwise(F.array().cast("array<string>")),
                                 lambda p: F.struct(F.lit("single").alias("role"), p.alias("look"))))
    looked = words.select("set_id", "word", "plain", "fix", F.explode(tests).alias("t")).select("set_id", "word", "plain", "fix", "t.*")
    looked = looked.join(known.select(C("word").alias("look"), F.lit(True).alias("a")).hint("merge"), "look", "left") \
        .join(names.select("set_id", C("word").alias("look"), F.lit(True).alias("b")).hint("merge"), ["set_id", "look"], "left")
    is_known = C("a").isNotNull() | C("b").isNotNull() | (C("look").rlike("^[a-z]$") & (C("role") == "part"))
    role = lambda name, how: F.coalesce(how(F.when(C("role") == name, is_known)), F.lit(False))
    open_ = looked.groupBy("set_id", "word", "plain", "fix").agg(role("self", F.max).alias("self"), role("part", F.min).alias("parts"), role("single", F.max).alias("single")) \
        .where("not parts and not single")
    fixed = open_.where("fix is not null").select("set_id", "word", C("fix").alias("suggestion"), F.lit("known_correction").alias("source"))

    unknown = written(open_.where((C("fix").isNull()) & ~C("self") & (F.length("plain") > 3) & ~C("word").rlike("^[A-Z]{2,6}$")).select("set_id", "word", "plain"), "spelling-unknown")
    asked = unknown.select("set_id", C("plain").alias("word")).distinct()
    general = asked.join(within_one_edit(asked.select("word").distinct(), known).hint("merge"), "word")
    local = within_one_edit(asked, names.withColumn("n", F.lit(1).cast("bigint")), ["set_id"])
    near = general.select("set_id", "word", "near", "n").unionByName(local).groupBy("set_id", "word", "near").agg(F.sum("n").alias("n"))
    best = near.groupBy("set_id", "word").agg(F.min(F.struct((-C("n")).alias("n"), C("near"))).alias("best")).select("set_id", C("word").alias("plain"), C("best.near").alias("suggestion"))
    return fixed.unionByName(unknown.join(best.hint("merge"), ["set_id", "plain"]).select("set_id", "word", "suggestion", F.lit("dictionary").alias("source")))


def spelling(pages: DataFrame, dictionary: DataFrame, custom: list[str] | None = None) -> DataFrame:
    """Findings ``set_id, page_number, doc_id, sheet, word, suggestion, source, start, context``: each word of a page and context once.

    ``pages`` has ``set_id, page_number, doc_id, sheet_number, sheet_title, title_block_text, text``, ``doc_id`` identifies a row; a page without text is read by its
    title block. ``dictionary`` is (word, n), lower-case, frequencies added up where a word repeats. ``custom`` are words (and firms' names) that are right.
    Null sets are left out, null texts have no words. Writes intermediate tables when called.
    """
    custom = custom or []
    own = sorted({*W.TRADE, *[w.lower() for w in custom]})
    pages = pages.where("set_id is not null and doc_id is not null")
    read = pages.select("set_id", "page_number", "doc_id", "sheet_number", F.coalesce(F.nullif("text", F.lit("")), "title_block_text").alias("text"))
    places = written(_places(read), "spelling-places")
    known, names = written(lexicon(dictionary, custom), "spelling-lexicon"), written(title_words(pages), "spelling-names")
    hits = places.join(_judged(places.select("set_id", "word").distinct(), known, names, own).hint("merge"), ["set_id", "word"]) \
        .select("doc_id", "word", "suggestion", "source", F.explode("starts").alias("start"))
    lo, end = F.greatest(C("start") - RADIUS, F.lit(0)), C("start") + F.length("word") + RADIUS
    cut = F.trim(F.regexp_replace(F.substr("text", lo + 1, end - lo), r"\s+", " "))
    context = F.concat(F.when(lo > 0, "...").otherwise(""), cut, F.when(end < F.length("text"), "...").otherwise(""))
    sheet = F.coalesce(F.nullif(F.trim("sheet_number"), F.lit("")), F.concat(F.lit("Page "), C("page_number").cast("string")))
    out = hits.join(read.hint("merge"), "doc_id").select("set_id", "page_number", "doc_id", sheet.alias("sheet"), "word", "suggestion", "source", "start", context.alias("context"))
    out = out.where(~W.any_of(C("context"), W.CONTEXT_MARKS)).withColumns({"lw": F.lower("word"), "lc": F.lower("context")})
    return first_per(out, ["set_id", "page_number", "lw", "lc"], ["doc_id", "start"]).drop("lw", "lc")
