"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard that its id decides, and each group takes the
label that most of its members have (ties by a hash); as groups share no links, one round settles the labels. Groups
larger than half a shard are first divided by a hash of the row, as no shard could hold them. Then groups are seated
whole, all of them: the large ones first, by size, each in the shard with most of its members among those with room;
the others in the order of a hash where their label is, as far as the shard's room reaches, and the rest one after
another in the room that is left anywhere. Only a group at the end of a shard's room can exceed it. At the end rows are
ranked inside their shard, linked ones first; what exceeds the shard's quota fills the others, so that counts are at
most one apart (law ``rows``) and slots have no gaps.

What is joined is one row a group and shard, never pairs of documents; the driver seats fewer than 64 groups a shard. Null texts are not linked and have size 8 and checksum 0; repeated rows are rows. An empty
table gives an empty result. Extra columns pass through; columns named like the result's are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordqc.llm.common import stored
from recordqc.operators.scale import ranked, running

#: A group is large if its rows are more than this part of a shard.
LARGE = 64
MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _facts(docs: DataFrame) -> DataFrame:
    raw = F.col("text").cast("binary")
    return docs.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")) \
        .withColumn("text_crc32", F.coalesce(F.crc32(raw), F.lit(0)).cast("long")).withColumn("__g", F.md5(raw))


def _labelled(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """``rows`` with ``__part`` (its linked group or null) and a first ``__label``."""
    half = max(1, total // shards // 2)
    groups = rows.where("__g is not null").groupBy("__g").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1") \
        .select("__g", F.ceil(F.col("__n") / half).alias("__parts"))
    cut = F.pmod(F.xxhash64(F.lit(2), "doc_id", "__row"), F.col("__parts"))
    return rows.join(groups, "__g", "left") \
        .withColumn("__part", F.when(F.col("__parts").isNotNull(), F.concat_ws("/", "__g", cut.cast("string")))) \
        .withColumn("__label", F.pmod(F.xxhash64(F.lit(1), "doc_id", "__row"), F.lit(shards)).cast("int")).drop("__parts", "__g")


def _seats(held: dict[str, dict[int, int]], room: dict[int, int]) -> dict[str, int]:
    """A shard for each group of ``held`` (its rows by shard), largest first; takes what it uses from ``room``."""
    out = {}
    for part in sorted(held, key=lambda p: (-sum(held[p].values()), p)):
        size = sum(held[part].values())
        fits = [s for s in room if room[s] >= size]
        out[part] = max(fits, key=lambda s: (held[part].get(s, 0), room[s])) if fits else max(room, key=room.get)
        room[out[part]] -= size
    return out


def _moves(state: DataFrame, quota: dict[int, int], total: int) -> DataFrame:
    """``__part, __label`` and the shard ``__to`` where the group's rows meet."""
    spark, shards = state.sparkSession, len(quota)
    cells = stored(state.where("__part is not null").groupBy("__part", "__label").agg(F.count(F.lit(1)).alias("__n")), "shard-cells")
    most = F.max(F.struct("__n", F.xxhash64(F.lit(3), "__part", "__label").alias("h"), F.col("__label").alias("l")))
    parts = stored(cells.groupBy("__part").agg(F.sum("__n").alias("__size"), most.alias("__b")).select("__part", "__size", F.col("__b.l").alias("__to")), "shard-parts")
    large = F.col("__size") * LARGE * shards > total

    held, room = defaultdict(dict), dict(quota)
    for r in cells.join(parts.where(large).select("__part"), "__part").collect():  # fewer than LARGE x shards groups, a row a shard
        held[r["__part"]][r["__label"]] = r["__n"]
    seated = spark.createDataFrame([*_seats(held, room).items()], "__part string, __to int")

    at = lambda values: F.get(F.array(*[F.lit(max(0, values[s])).cast("long") for s in range(shards)]), F.col("__to"))
    small = parts.where(~large).withColumn("__h", F.xxhash64(F.lit(5), "__part"))
    small = stored(running(small, ["__to"], ["__h", "__part"], __upto=("sum", "__size")).withColumn("__fits", F.col("__upto") <= at(room)), "shard-seats")
    for r in small.where("__fits").groupBy("__to").agg(F.sum("__size").alias("n")).collect():  # a row a shard
        room[r["__to"]] -= r["n"]
    seated = seated.union(small.where("__fits").select("__part", "__to"))
    begins = [0, *accumulate(max(0, room[s]) for s in range(shards))]
    rest = small.where("not __fits").select("__part", "__size", "__h", F.lit(0).alias("__all"))
    rest = running(rest, ["__all"], ["__h", "__part"], __from=("sum_before", "__size"))
    shard_at = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in begins[:-1]]), lambda x: x <= F.coalesce("__from", F.lit(0)))) - 1
    seated = seated.union(rest.select("__part", shard_at.cast("int").alias("__to")))
    return cells.join(seated, "__part").where("__label <> __to").select("__part", "__label", "__to")


def _counts(state: DataFrame, shards: int) -> dict[int, int]:
    """Rows by shard."""
    got = {r["__label"]: r["n"] for r in state.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    return {s: got.get(s, 0) for s in range(shards)}


def place(rows: DataFrame, shards: int = 24) -> DataFrame:
    """``rows`` (stored, with ``doc_id, __g, __row``) with ``shard, slot``."""
    total = rows.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    state = stored(_labelled(rows, shards, total), "shard-start")
    moved = state.join(_moves(state, quota, total), ["__part", "__label"], "left").withColumn("__label", F.coalesce("__to", "__label"))
    state = stored(moved.select(*state.columns), "shard-moved")
    counts = _counts(state, shards)
    numbered = ranked(state.withColumn("__single", F.col("__part").isNull()), ["__label"], ["__single", "__part", "doc_id", "__row"], "__rank") \
        .withColumn("__rank", F.col("__rank") - 1)
    over = [max(0, counts[s] - quota[s]) for s in range(shards)]
    free = [max(0, quota[s] - counts[s]) for s in range(shards)]
    over_from, free_from = [0, *accumulate(over)], [0, *accumulate(free)]
    table = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    at = lambda values, i: F.get(table(values), i.cast("int"))
    label = F.col("__label")
    place_no = at(over_from, label) + F.col("__rank") - at([quota[s] for s in range(shards)], label)
    target = F.size(F.filter(table(free_from), lambda x: x <= F.col("__place"))) - 1  # the last shard whose free slots begin at or before it
    # shards without free slots begin where the next one does: the last of equals has them
    stays = F.col("__rank") < at([quota[s] for s in range(shards)], label)
    out = numbered.withColumn("__place", F.when(~stays, place_no))
    out = out.withColumn("shard", F.when(stays, label).otherwise(target).cast("int"))
    filled = at([min(counts[s], quota[s]) for s in range(shards)], F.col("shard")) + F.col("__place") - at(free_from[:-1], F.col("shard"))
    return out.withColumn("slot", F.when(stays, F.col("__rank")).otherwise(filled).cast("long")).drop("__place", "__rank", "__single", "__label", "__part")


def shard(docs: DataFrame, shards: int = 24, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard`` (see the module)."""
    docs = docs.drop(*MADE)
    last = [F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    if not keep_text:
        rows = stored(_facts(docs).withColumn("__row", F.col("text_crc32")).drop("text"), "shard-rows")
        return place(rows, shards).select(*[c for c in docs.columns if c != "text"], "size", "text_crc32", *last)
    # rows get a number that is written with them: equal rows stay apart, and a task that runs again cannot renumber
    named = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "shard-docs")
    placed = place(stored(_facts(named).select("doc_id", "__row", "__g", "size", "text_crc32"), "shard-rows"), shards)
    return named.join(placed.drop("doc_id"), "__row").select(*docs.columns, "size", "text_crc32", *last)
