"""Source divergence audit: how far the term shares of a language's sources are from each other, and by which terms.

Each language keeps the terms of at least ``least`` of its documents. A group (language and source) and the language itself give each
kept term the integer p = 1 + floor(10**9 * (count + 1) / (N + V)). Divergence of p from q is the sum of floor((p - q)**2 / q) over all kept terms.

Most groups hold few of the terms, and absent ones have the group's zero share p0. Sums are therefore taken row by row over what
is there, in the way of Gustavson's sparse product: a task holds a shard of the term-major index (for each term its
groups and their p). A group's row scatters its terms through that index into one dense accumulator with a place for each peer; pairs of
postings are added where they meet and never become rows. The accumulator starts from the baselines of zeros:

    V f(p0, q0)  +  own terms: f(p, q0) - f(p0, q0)  +  the peer's: f(p0, q) - f(p0, q0)
                 +  common terms: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

A task returns a row for each pair of groups of its language, which the result has anyway, and its best terms; shards are summed. Shards have
about ``POSTINGS`` postings, whichever language holds them. Counting makes one row for each group and term of a task.

Null text, lang and source are ''. Rows that repeat an id or a text count as documents of their own. Groups without terms, and languages without
kept terms (value 0 for all pairs), are in the result; so is nothing for an empty table. Equal values rank by item. Only these three columns are read.
Arithmetic is exact: integers of 64 bits, products by long division, sums over shards as decimals.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordqc.llm.common import stored
from recordqc.operators.scale import top_k

LEAST, TOP = 3, 200
POSTINGS = 1 << 16
#: Entries that a task counts before it sends them.
HELD = 400_000
_LOWER = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def _counted(batches):
    """Occurrences of a term in a group, and documents of the group that have it."""
    def rows(held):
        flat = [(lang, source, t, n, docs[t]) for (lang, source), (total, docs) in held.items() for t, n in total.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat), (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))],
                                          names=["lang", "source", "term", "c", "docs"])

    held = defaultdict(lambda: (Counter(), Counter()))
    for b in batches:
        for text, lang, source in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            terms = (text.as_py() or b"").translate(_LOWER).split()
            if terms:
                total, docs = held[lang, source]
                total.update(terms)
                docs.update(set(terms))
        if sum(len(t) for t, _ in held.values()) > HELD:
            yield rows(held)
            held.clear()
    if held:
        yield rows(held)


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total) by long division in 64 bits; 0 <= count < total < 9 * 10**15."""
    out, rest = np.divmod(np.asarray(count, np.int64) + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return 1 + out


def apart(p, q):
    return (p - q) * (p - q) // q


class Shard:
    """A shard of one language's term-major index: ``term``, ``group``, ``p`` of each posting, sorted by term."""

    def __init__(self, term, group, count, n, v: int):
        order = np.argsort(term, kind="stable")
        self.term, self.group, self.count = term[order], group[order], count[order]
        self.zero = share(np.zeros(len(n), np.int64), n + v)
        self.p = share(self.count, (n + v)[self.group])
        self.begin = np.searchsorted(self.term, np.arange(int(self.term.max(initial=-1)) + 2))
        pairs = np.unique(np.stack([self.group, self.p]), axis=1, return_counts=True)
        (self.peer, self.q), self.times = pairs
        self.row = np.argsort(self.group, kind="stable")
        self.rows = np.searchsorted(self.group[self.row], np.arange(len(n) + 1))

    def accumulate(self, i: int) -> np.ndarray:
        """What this shard adds to the divergence of group ``i`` from each peer, zero baselines but for V f(p0, q0)."""
        q0, p0 = self.zero, self.zero[i]
        none = apart(p0, q0)
        mine = self.row[self.rows[i]:self.rows[i + 1]]
        acc = np.zeros(len(q0), np.int64)
        np.add.at(acc, self.peer, self.times * (apart(p0, self.q) - none[self.peer]))
        for p, times in zip(*np.unique(self.p[mine], return_counts=True)):
            acc += times * (apart(p, q0) - none)
        begin = self.begin[self.term[mine]]
        size = self.begin[self.term[mine] + 1] - begin
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        peer, q, p = self.group[at], self.p[at], np.repeat(self.p[mine], size)
        np.add.at(acc, peer, apart(p, q) - apart(p, q0[peer]) - apart(p0, q) + none[peer])
        return acc


_OUT = "lang string, source string, part string, item string, value long"


def _audit(top: int):
    def run(postings: pa.Table, roster: pa.Table) -> pa.Table:
        roster = roster.sort_by("source")
        lang, shard = roster["lang"][0].as_py(), roster["shard"][0].as_py()
        names = roster["source"].to_pylist()
        n, v = roster["n"].to_numpy(), roster["v"][0].as_py()
        number = {s: i for i, s in enumerate(names)}
        terms = postings["term"].combine_chunks().dictionary_encode()
        words = terms.dictionary.to_pylist()
        group = np.array([number[s] for s in postings["source"].to_pylist()], np.int64)
        count = postings["c"].to_numpy()
        s = Shard(terms.indices.to_numpy().astype(np.int64), group, count, n, v) if v else None
        total = np.zeros(len(words), np.int64)
        if v:
            np.add.at(total, s.term, s.count)
            q = share(total, int(n.sum()) + v)[s.term]
            value = apart(s.p, q)
        out: list[list] = [[], [], [], []]
        for i, name in enumerate(names):
            acc = np.zeros(len(names), np.int64)
            if v:
                acc = s.accumulate(i)
                if shard == 0:
                    acc = acc + v * apart(s.zero[i], s.zero)
                mine = s.row[s.rows[i]:s.rows[i + 1]]
                mine = mine[s.p[mine] > q[mine]]
                best = sorted(zip((-value[mine]).tolist(), (words[t] for t in s.term[mine].tolist())))[:top]
                for column, made in zip(out, ([name] * len(best), ["term"] * len(best), [t.decode("utf-8", "replace") for _, t in best], [-x for x, _ in best])):
                    column += made
            peers = [j for j in range(len(names)) if j != i]
            for column, made in zip(out, ([name] * len(peers), ["pair"] * len(peers), [names[j] for j in peers], acc[peers].tolist())):
                column += made
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), *[pa.array(c, pa.string()) for c in out[:3]], pa.array(out[3], pa.int64())],
                        names=["lang", "source", "part", "item", "value"])
    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """lang, source, part (``pair``: item is a peer, all ranks; ``term``: item is a term, ``top`` ranks), item, value, rank.

    Writes intermediate tables when called.
    """
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    docs = docs.select(F.col("text").cast("binary").alias("text"), blank("lang"), blank("source"))
    counted = docs.mapInArrow(_counted, "lang string, source string, term binary, c long, docs long").repartition("lang", "term")
    by_term = Window.partitionBy("lang", "term")
    kept = counted.groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")) \
        .withColumn("all", F.sum("docs").over(by_term)).withColumn("one", F.min("source").over(by_term) == F.col("source")) \
        .where(F.col("all") >= least).select("lang", "source", "term", "c", "one")
    kept = stored(kept, "terms")
    shards = kept.count() // postings + 1
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count_if("one").alias("ones"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["n", "ones"])
    roster = groups.withColumn("v", F.sum("ones").over(Window.partitionBy("lang"))).drop("ones") \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    placed = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "source", "term", "c")
    added = stored(placed.groupBy("lang", "shard").cogroup(roster.groupBy("lang", "shard")).applyInArrow(_audit(top), _OUT), "divergence")
    pairs = added.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = top_k(added.where("part = 'term'"), ["lang", "source"], ["-value", "item"], top, "rank")
    return pairs.unionByName(terms.withColumn("rank", F.col("rank").cast("int")))
