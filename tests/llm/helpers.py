import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka lo mi ren tu sa vel do pri an".split() for b in "ba ne so ti ra mel ku vo da shi".split()]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(spark, texts, langs=("en",), sources=("a", "b", None)):
    rows = [(i, t, langs[i % len(langs)], sources[i % len(sources)], len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows(spark):
    """Nulls everywhere, empty and wordless texts, repeated rows, a long text."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, " \n\t ", None, "a", 4), (3, "kaba", "en", "a", 4), (3, "kaba", "en", "a", 4),
            (None, "kaba nete", "en", "a", 9), (5, long, "en", "b", len(long)), (6, long, "en", "b", len(long)), (7, "x" * 50_000, "en", "b", 50_000),
            (8, "\x00 é 日本   ¿", "xx", "ü", 10)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, *names):
    """``df`` with extra columns named like an operator's own."""
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df.withColumn("extra", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
