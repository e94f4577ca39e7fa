"""Ordered and per-group work that stays even when one group holds most rows.

A plain ``Window.partitionBy(key)`` puts a whole group into one task. The
functions here range-partition on (key, order) instead, so that a hot group is
spread over many tasks, do the ordered work inside each range, and carry the
state of the earlier ranges over. A range begins inside at most one group, so
the carried table never has more rows than there are ranges; that bound is why
it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordqc.session import written

RANGE = "__range"


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def join_back(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one-row-per-key results to the rows; keys compare null-safe.

    The right side is unique per key, so adaptive execution can split a hot
    key on the left without changing the result.
    """
    return _null_safe(df, per_key, keys, how)


def _directed(order: Sequence) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, str):
            out.append(F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_first())
        else:
            out.append(o)
    return out


def running(df: DataFrame, keys: Sequence[str], order: Sequence, **exprs: tuple[str, Column | str | None]) -> DataFrame:
    """Ordered per-key columns: ``name=(kind, column)``.

    kinds: ``row_number``; ``sum`` and ``max`` (inclusive); ``sum_before`` and
    ``max_before`` (strictly earlier rows); ``last`` (last non-null so far,
    inclusive); ``last_before``; ``lag`` (value on the row before); ``changes`` (how often a non-null value
    so far differed from the non-null one before it, the first included).
    ``order`` must be a total order for a deterministic result; a name with a
    leading ``-`` sorts descending.
    """
    keys = list(keys)
    inputs = df
    for name, (_kind, col) in exprs.items():
        value = F.lit(1) if col is None else (F.col(col) if isinstance(col, str) else col)
        inputs = inputs.withColumn(f"__in_{name}", value)
    directed = _directed(order)
    tagged = inputs.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *directed)
    tagged = written(tagged.withColumn(RANGE, F.spark_partition_id()), "ranges")

    local = Window.partitionBy(RANGE, *keys).orderBy(*directed)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    here, ends = tagged, tagged.withColumn("__pos", F.row_number().over(local))
    summary, carried, changes = [], [], []
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _col) in exprs.items():
        x, s, c = F.col(f"__in_{name}"), f"__s_{name}", f"__c_{name}"
        if kind == "row_number":
            here = here.withColumn(name, F.row_number().over(local).cast("bigint"))
            summary.append(F.count(F.lit(1)).alias(s))
            carried.append(F.sum(s).over(earlier).alias(c))
        elif kind in ("sum", "sum_before"):
            here = here.withColumn(name, F.sum(x).over(upto if kind == "sum" else before))
            summary.append(F.sum(x).alias(s))
            carried.append(F.sum(s).over(earlier).alias(c))
        elif kind in ("max", "max_before"):
            here = here.withColumn(name, F.max(x).over(upto if kind == "max" else before))
            summary.append(F.max(x).alias(s))
            carried.append(F.max(s).over(earlier).alias(c))
        elif kind in ("last", "last_before"):
            here = here.withColumn(name, F.last(x, ignorenulls=True).over(upto if kind == "last" else before))
            summary.append(F.max_by(x, F.when(x.isNotNull(), F.col("__pos"))).alias(s))
            carried.append(F.last(s, ignorenulls=True).over(earlier).alias(c))
        elif kind == "changes":
            # a range counts its first value as a change; whether it is one, the last value of earlier ranges tells
            known = F.last(x, ignorenulls=True).over(before)
            here = here.withColumn(name, x.isNotNull() & ~x.eqNullSafe(known)).withColumn(name, F.sum(F.col(name).cast("bigint")).over(upto))
            ends = ends.withColumn(c, x.isNotNull() & ~x.eqNullSafe(known))
            summary += [F.sum(F.col(c).cast("bigint")).alias(s), F.min_by(x, F.when(x.isNotNull(), F.col("__pos"))).alias(f"{s}_first"),
                        F.max_by(x, F.when(x.isNotNull(), F.col("__pos"))).alias(f"{s}_last")]
            changes.append(name)
            carried += [F.sum(s).over(earlier).alias(c), F.col(f"{s}_same").alias(f"{c}_same")]
        elif kind == "lag":
            here = here.withColumn(name, F.struct(F.lag(x).over(local).alias("v"),
                                                  (F.row_number().over(local) == 1).alias("first")))
            summary.append(F.max_by(F.struct(x.alias("v")), F.col("__pos")).alias(s))
            carried.append(F.last(s).over(earlier).alias(c))
        else:
            raise ValueError(kind)
    states = ends.groupBy(RANGE, *keys).agg(*summary)
    for s in (f"__s_{name}" for name in changes):
        states = states.withColumn(f"{s}_same", F.col(f"{s}_first").eqNullSafe(F.last(f"{s}_last", ignorenulls=True).over(earlier)) & F.col(f"{s}_first").isNotNull()) \
                       .withColumn(s, F.col(s) - F.col(f"{s}_same").cast("bigint"))
    carry = (states
             .select(RANGE, *keys, *carried, F.count(F.lit(1)).over(earlier).alias("__seen"))
             .where("__seen > 0").drop("__seen"))
    out = _null_safe(here, F.broadcast(carry), [RANGE, *keys], "left")
    for name, (kind, _col) in exprs.items():
        c = F.col(f"__c_{name}")
        if kind in ("row_number",):
            out = out.withColumn(name, F.col(name) + F.coalesce(c, F.lit(0)))
        elif kind == "changes":
            again = F.when((F.col(name) > 0) & F.col(f"__c_{name}_same"), 1).otherwise(0)
            out = out.withColumn(name, F.col(name) + F.coalesce(c, F.lit(0)) - again).drop(f"__c_{name}_same")
        elif kind in ("sum", "sum_before"):
            out = out.withColumn(name, F.when(F.col(name).isNull() & c.isNull(), F.lit(None))
                                 .otherwise(F.coalesce(F.col(name), F.lit(0)) + F.coalesce(c, F.lit(0))))
        elif kind in ("max", "max_before"):
            out = out.withColumn(name, F.greatest(F.col(name), c))
        elif kind in ("last", "last_before"):
            out = out.withColumn(name, F.coalesce(F.col(name), c))
        else:
            out = out.withColumn(name, F.when(F.col(f"{name}.first"), c["v"]).otherwise(F.col(f"{name}.v")))
    return out.drop(RANGE, *[f"__in_{n}" for n in exprs], *[f"__c_{n}" for n in exprs])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rn") -> DataFrame:
    """``row_number`` per key without putting a hot key into one task."""
    return running(df, keys, order, **{name: ("row_number", None)})


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_directed(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k) \
             .withColumn(name, F.col(name).cast("bigint"))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_k(df, keys, order, 1, "__one").drop("__one")


def with_totals(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Per-key aggregates joined back to the rows (partial sums before the shuffle)."""
    return join_back(df, df.groupBy(*keys).agg(*aggs), keys)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                count: str | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles per key.

    Values are counted per (key, value) before the shuffle, cumulated over
    ranges and only the two order statistics that a percentile needs are kept.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")) \
               .agg(F.count(F.lit(1)).alias("__c"))
    cum = running(counts, keys, ["__v"], __hi=("sum", "__c"))
    totals = cum.groupBy(*keys).agg(F.max("__hi").alias("__n"))
    both = join_back(cum, totals, keys)
    lo_row = F.col("__hi") - F.col("__c")
    picks = []
    for name, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        for tag, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((lo_row <= idx) & (idx < F.col("__hi")), F.col("__v"))).alias(f"__{name}_{tag}"))
    got = both.groupBy(*keys).agg(F.max("__n").alias("__n"), *picks)
    cols = [*keys]
    if count:
        cols.append(F.col("__n").cast("bigint").alias(count))
    for name, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*cols)


def multiset_digest(*cols: Column) -> list[Column]:
    """Order-free 128-bit digest of a group's rows, as three partial aggregates.

    Equal groups get equal digests whatever the row order, and no group is
    ever collected.
    """
    wide = "decimal(38,0)"
    return [F.sum(F.xxhash64(F.lit(17), *cols).cast(wide)).alias("__d1"),
            F.sum(F.xxhash64(F.lit(4099), *[c for c in reversed(cols)]).cast(wide)).alias("__d2"),
            F.count(F.lit(1)).alias("__dn")]
