"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words; its documents get expected copies that add
up to it exactly. The whole part of the copies is certain. The rest is an
inclusion probability ``p``: documents are ranked by the random odds
``u / (1 - u)`` divided by the inclusion odds ``p / (1 - p)`` and the first ones
are taken until the source's remaining words are nearest.

Longer texts get more expected copies than shorter ones (``tilt``), so the
probabilities inside a source differ. The rank is never sorted over a whole
source: words are summed by 65,536 ranges of it, and only the range in which
the target falls is ordered.

Null or wordless texts have size 0 and are taken 0 times. Null sources form one
source, the last. Repeated rows are separate documents that draw the same rank
(they share id and text), so either all of them or none fall below the cut.
An empty table gives an empty result. Extra columns pass through; columns named
like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordqc.llm.common import n_words, stored, unit

RANGES = 1 << 16
#: Words at which a text gets half of the tilt, and the grid on which the tilt is added up exactly.
HALF, GRID = 400, 1_000_000


def targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Water filling: ``source, source_size, target`` from ``source, source_size``.

    The level is found in one pass over the sources ordered by ``cap * size / weight``: a source is capped
    exactly when the level of the sources from it on is above that ratio. One row a source, so one task orders it.
    """
    named = sizes.withColumn("__w", F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1,
                                               F.lit(len(weights))) + 1).cast("int")))
    ratio = F.lit(cap) * F.col("source_size") / F.col("__w")
    by = Window.orderBy("__r", F.col("source").asc_nulls_last())
    before, all_rows = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = named.withColumn("__r", ratio).select(
        "*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("__s"),
        F.coalesce(F.sum("__w").over(before), F.lit(0.0)).alias("__u"), F.row_number().over(by).alias("__k"),
        F.sum("source_size").over(all_rows).alias("__all"), F.sum("__w").over(all_rows).alias("__weights"))
    level = (F.col("__all") - F.lit(cap) * F.col("__s")) / (F.col("__weights") - F.col("__u"))
    first = F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__k", "__level"))).over(all_rows)["__level"]
    return (left.withColumn("__level", level).withColumn("__level", F.coalesce(first, F.lit(0.0)))
            .select("source", "source_size",
                    F.least(F.lit(cap) * F.col("source_size"), F.col("__level") * F.col("__w")).alias("target")))


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    digest = F.xxhash64(F.col("text"), F.length("text"))
    return (docs.withColumn("size", n_words(F.col("text"))).withColumn("__text", digest)
            .withColumn("__u", unit(F.lit(seed), F.col("doc_id"), F.col("__text")))
            .withColumn("__t", F.floor(F.lit(GRID) * F.col("size") / (F.col("size") + HALF)).cast("long")))


def _copies(df: DataFrame, cap: float, tilt: float) -> DataFrame:
    """Expected copies from the source's columns, and the rank of the fraction."""
    rho = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    lean = F.col("__t") / F.lit(float(GRID)) - F.col("__mean")
    df = df.withColumn("__a", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.least(
        F.lit(cap), rho + F.least(rho, F.lit(cap) - rho) * F.lit(tilt) * lean))).otherwise(F.lit(0.0)))
    df = df.withColumn("__whole", F.floor("__a").cast("long")).withColumn("__p", F.col("__a") - F.floor("__a"))
    odds = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))
    df = df.withColumn("__q", F.when(F.col("__p") > 0, odds))
    return (df.withColumn("__range", F.floor(F.col("__q") / (1 + F.col("__q")) * RANGES))
            .withColumn("__key", F.struct("__q", "doc_id", "__text")))


def mix(docs: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), tilt: float = 0.5,
        seed: int = 20_240_601) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with ``size, source_size, target, copies, taken`` (see the module).

    ``taken = copies * size``; no document is copied more than ``cap`` times (rounded down).
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*made)
    slim = stored(_drawn(docs, seed).select("doc_id", "source", "size", "__text", "__u", "__t"), "mix-draws")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"),
                                        F.sum((F.col("__t") * F.col("size")).cast("decimal(38,0)")).alias("__ts"))
    mean = F.when(F.col("source_size") > 0, F.col("__ts").cast("double") / GRID / F.col("source_size")).otherwise(F.lit(0.0))
    goal = targets(totals.select("source", "source_size"), cap, weights)
    shares = stored(_joined(goal, totals.select("source", mean.alias("__mean"))), "mix-shares")

    ranked = _copies(_joined(slim, shares), cap, tilt)
    rest = _joined(shares.select("source", "target"), ranked.groupBy("source").agg(F.sum(F.col("__whole") * F.col("size")).alias("__certain"))) \
        .select("source", (F.col("target") - F.col("__certain")).alias("__rest"))
    sums = ranked.where("__q is not null").groupBy("source", "__range").agg(F.sum("size").alias("__n"))
    upto = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    edge = (_joined(sums.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))), rest)
            .where((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__n")))
            .groupBy("source", "__rest").agg(F.max(F.struct("__range", "__before")).alias("__e"))
            .select("source", "__rest", F.col("__e.__range").alias("__edge"), F.col("__e.__before").alias("__before")))
    inside = _joined(ranked.where("__q is not null").select("source", "__range", "__key", "size"), edge, "inner").where("__range = __edge")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("__key")
                                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__before")
    cut = inside.withColumn("__ok", before + F.col("size") / 2 <= F.col("__rest")).where("__ok") \
        .groupBy("source").agg(F.max("__key").alias("__cut"))
    # a source whose target lies behind its last rank has no edge and takes every fraction
    plan = stored(_joined(_joined(shares, edge.select("source", "__edge")), cut), "mix-plan")

    out = _copies(_joined(_drawn(docs, seed), plan), cap, tilt)
    more = F.col("__q").isNotNull() & (F.col("__edge").isNull() | (F.col("__range") < F.col("__edge"))
                                       | ((F.col("__range") == F.col("__edge")) & F.coalesce(F.col("__key") <= F.col("__cut"), F.lit(False))))
    copies = F.col("__whole") + F.when(more, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("int")).withColumn("taken", (copies * F.col("size")).cast("long")) \
        .select(*docs.columns, *made)


def _joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Null-safe join by source; the right side has one row a source, Spark weighs its size."""
    other = right.withColumnRenamed("source", "__source")
    return left.join(other, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as often as it was mixed in."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("__copy")
