"""MinHash near-dedup by ProbMinHash: shingles, banding, exact verification, classes.

A text's shingles are its different sequences of five words (one sequence of all words if there are fewer), all of one
weight. Each shingle is a Poisson process of rate one: its arrivals hit random registers, and a register keeps the
shingle that arrives first. A shingle stops as soon as its next arrival is later than all registers of the text. With
equal weights two texts agree in a register with the Jaccard similarity of their shingle sets, however often a shingle
is repeated. Registers are hashed in bands; texts that share a band are candidates, and a candidate pair is a link if
that similarity is ``similarity`` or more.

Equal texts are one node from the start. In a band's bucket every node is first verified against two centres only (the node
with most neighbours and one more); links make classes (connected components). Nodes of one bucket whose classes still
differ meet in blocks of bounded size and are decided inside the task, in the first band they share: pairs whose
sizes or rarest shingles rule a link out (both bounds are exact) are passed over, the others verified, and what leaves
the task are links that join classes. So a bucket of thousands of copies costs a few pairs each, and no pair of a
bucket stays undecided.

Texts without words, and null texts, are classes of their own. A class is named by its smallest ``doc_id``; null ids
are larger than others, and a class of null ids only is named null. So different classes can have one name, if an id is null or
repeated; ``root`` (the digest of one of its texts) tells them apart. Repeated rows fall in one class. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType
from pyspark.sql.window import Window

from recordqc.llm.common import map_batches, stored, texts_of
from recordqc.llm.shingles import mixed, offsets, sequences, word_hashes

WORDS = 5


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    hashes = word_hashes(text.encode().split())
    return sequences(hashes, min(words, len(hashes))) if len(hashes) else hashes


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(texts: list[str], registers: int) -> np.ndarray:
    """[text, register] hash of the shingle that arrives first; 0 for texts without words."""
    each = [np.unique(shingle_hashes(t)) for t in texts]
    at = offsets([len(x) for x in each])
    shingle = np.concatenate(each) if each else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    first = np.full(len(texts) * registers, np.inf)
    kept = np.zeros(len(texts) * registers, np.uint64)
    last = np.full(len(texts), np.inf)
    time = np.zeros(len(shingle))
    step = 0
    while len(shingle):
        step += 1
        h = mixed(shingle + np.uint64(step * 0xD1342543DE82EF95 % 2 ** 64))
        time = time - np.log(_unit(h))
        alive = time < last[doc]
        shingle, doc, time, h = shingle[alive], doc[alive], time[alive], h[alive]
        register = doc * registers + (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = first[register] == time
        kept[register[won]] = shingle[won]
        if step % 4 == 0 or step < 4:
            last = first.reshape(-1, registers).max(axis=1)
            alive = time < last[doc]
            shingle, doc, time = shingle[alive], doc[alive], time[alive]
    return kept.reshape(len(texts), registers)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def rarest(sets: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """Numbers of each set's rarest members, so many that two sets with ``similarity`` or more have one of them in common."""
    at = offsets([len(s) for s in sets])
    _, number, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = []
    for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
        mine = number[start:end]
        common = math.ceil(similarity * len(mine) - 1e-9)  # members that a similar set has at least
        out.append(mine[np.lexsort((mine, seen[mine]))[:len(mine) - common + 1]])
    return out


def banded(docs: DataFrame, bands: int, rows: int, block: int = 2_000) -> DataFrame:
    """``doc_id, node`` (digest of the text) and ``keys``, one hash a band; null without words."""
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def made(batch):
        texts, out = texts_of(batch), []
        for i in range(0, len(texts), block):  # bounds the registers held at once
            part = texts[i:i + block]
            found = signatures(part, bands * rows).reshape(len(part), bands, rows)
            key = np.zeros((len(part), bands), np.uint64)
            for r in range(rows):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + found[:, :, r])
            key = (key ^ salt).view(np.int64)
            out += [k if f.any() else None for k, f in zip(key.tolist(), found)]
        return [out]

    named = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("node"), F.length("text").alias("chars"), "text")
    return map_batches(named, made, [("keys", ArrayType(LongType()))], ["doc_id", "node", "chars"])


def _block_links(similarity: float):
    """Links between a block's nodes of different classes, for pairs whose first common band is this one."""
    import pyarrow as pa

    def links(band, nodes, roots, parts, keys, texts):
        k = np.array(keys, np.int64)
        _, root, sizes = np.unique(roots, return_inverse=True, return_counts=True)
        part, major = np.array(parts), sizes.argmax()
        above, todo = list(range(len(sizes))), {}

        def top(r):
            while above[r] != r:
                above[r] = above[above[r]]
                r = above[r]
            return r

        both = part.min() != part.max()
        for y in np.flatnonzero(root != major).tolist():
            ok = (root != root[y]) & ((k == k[y]).argmax(1) == band)  # by the keys that make the buckets
            ok &= (part != part[y]) if both else True
            ok[:y] &= root[:y] == major  # the other way round those have been seen
            if ok.any():
                todo[y] = ok
        if not todo:
            return
        used = np.logical_or.reduce(list(todo.values()))
        used[list(todo)] = True
        used = np.flatnonzero(used).tolist()
        sets = {i: np.unique(shingle_hashes(texts[i])) for i in used}
        size = np.zeros(len(nodes))
        size[used] = [len(sets[i]) for i in used]
        rare = dict(zip(used, rarest([sets[i] for i in used], similarity)))
        holder, held = np.repeat(used, [len(r) for r in rare.values()]), np.concatenate(list(rare.values()))
        by = held.argsort(kind="stable")
        holder, starts = holder[by], np.searchsorted(held[by], np.arange(held.max() + 2))
        for y, ok in todo.items():
            met = np.zeros(len(nodes), bool)
            for n in rare[y].tolist():
                met[holder[starts[n]:starts[n + 1]]] = True
            met &= ok & (np.minimum(size, size[y]) >= similarity * np.maximum(size, size[y]) - 1e-9)
            for x in np.flatnonzero(met).tolist():
                ry, rx = top(root[y]), top(root[x])
                if rx != ry and jaccard(sets[x], sets[y]) >= similarity:
                    above[rx] = ry
                    yield nodes[x], nodes[y]

    def made(batches):
        group, held = None, []
        for b in batches:
            out = []
            for task, band, *row in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("task", "band", "node", "root", "part", "keys", "text")]):
                if group != (task, band):
                    if len(held) > 1:
                        out += links(group[1], *zip(*held))
                    group, held = (task, band), []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b"])
        out = list(links(group[1], *zip(*held))) if len(held) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b"])

    return made


def _open_links(placed: DataFrame, facts: DataFrame, texts: DataFrame, similarity: float, bands: int, rows: int, block: int = 1_000,
                block_chars: int = 8_000_000) -> DataFrame:
    """Links ``a, b`` of nodes that share a bucket but no class; a task holds two blocks at most."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("chars") / block_chars)).cast("int")
    mixed_up = placed.groupBy("key").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi"), parts.alias("__parts")) \
        .where("__lo <> __hi").select("key", "__parts")
    rows_in = stored(placed.join(mixed_up, "key"), "near-open")
    wanted = rows_in.select("node", "doc_id").distinct()
    match = (F.col("w.node") == F.col("f.node")) & F.col("w.doc_id").eqNullSafe(F.col("f.doc_id"))
    keys = facts.select("node", "doc_id", "keys").alias("f").join(wanted.alias("w"), match, "left_semi").dropDuplicates(["node"]).select("node", "keys")
    part = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("__parts")).cast("int")
    dealt = rows_in.withColumn("part", part).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))) \
        .select("band", "node", "root", "part", F.concat_ws("/", "key", F.least("part", "__other"), F.greatest("part", "__other")).alias("task"))
    made = _block_links(similarity)
    return dealt.join(keys.join(texts, "node"), "node").repartition("task").sortWithinPartitions("task", "node").mapInArrow(made, "a string, b string")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` whose shingle sets are similar enough; ``texts`` has one row a ``node``."""
    def made(batch):
        out, last, mine = [], None, None
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "ta", "tb")]
        for a, ta, tb in zip(*columns):
            if a != last:
                last, mine = a, np.unique(shingle_hashes(ta))
            out.append(jaccard(mine, np.unique(shingle_hashes(tb))))
        return [out]

    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b") \
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return map_batches(joined, made, [("similarity", DoubleType())], ["a", "b"]).where(F.col("similarity") >= similarity)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for nodes of ``links`` (a, b): equal roots for nodes that reach each other.

    Each round sends every node to its smallest neighbour, looks that one up once more, and replaces the links by
    those between different ends; what is joined shrinks from round to round.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
    labels = None
    while labels is None or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        step = stored(ends.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("to")), "near-steps")
        far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = stored(step.join(far, "to").select("node", F.col("far").alias("root")), "near-roots")
        if labels is None:
            labels = step
        else:
            after = step.select(F.col("node").alias("root"), F.col("root").alias("__next"))
            labels = stored(labels.join(after, "root", "left").select("node", F.coalesce("__next", "root").alias("root")), "near-labels")
        to = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"__{end}"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("__a <> __b")
        edges = stored(moved.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct(), "near-links")
    return labels


def classes(docs: DataFrame, similarity: float = 0.8, bands: int = 40, rows: int = 7) -> DataFrame:
    """``doc_id, node, class_id, root`` a row of ``docs`` (doc_id, text); ``root`` is the class itself, ``class_id`` its name.

    With 40 bands of 7 registers a pair whose shingle sets have 0.8 is missed as a candidate with probability 8e-5.
    """
    facts = stored(banded(docs, bands, rows), "near-bands")
    one = Window.partitionBy("node").orderBy(F.col("doc_id").asc_nulls_last())  # limited to one row a node before the shuffle
    reps = facts.where("keys is not null").withColumn("__k", F.row_number().over(one)).where("__k = 1").drop("__k")
    members = reps.select("node", "doc_id", "chars", F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    inside = stored(members.join(sizes, "key"), "near-buckets")
    degree = inside.groupBy("node").agg(F.sum("__n").alias("__d"))
    order = lambda t: F.min(F.struct((-F.col("__d") if t == 0 else F.xxhash64(F.lit(t), "node")).alias("h"), "node"))
    centres = inside.join(degree, "node").groupBy("key").agg(*[order(t).alias(f"c{t}") for t in range(2)]) \
        .select("key", F.array_distinct(F.array(*[f"c{t}.node" for t in range(2)])).alias("centres"))
    pairs = stored(inside.join(centres, "key").select("node", F.explode("centres").alias("c")).where("node <> c")
                   .select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct(), "near-pairs")

    wanted = inside.select("node", "doc_id").distinct()
    named = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("node"), "text")
    match = (F.col("w.node") == F.col("d.node")) & F.col("w.doc_id").eqNullSafe(F.col("d.doc_id"))
    texts = stored(named.alias("d").join(wanted.alias("w"), match, "left_semi").select("node", "text").dropDuplicates(["node"]), "near-texts")

    links = stored(_verified(pairs, texts, similarity), "near-verified")
    roots = components(links)
    placed = inside.select("key", "band", "node", "doc_id", "chars").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = stored(_open_links(placed, facts, texts, similarity, bands, rows), "near-verified")
    if not more.isEmpty():
        roots = components(links.select("a", "b").union(more.select("a", "b")))

    out = facts.select("doc_id", "node", F.col("keys").isNull().alias("__own")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = out.where("not __own").groupBy("root").agg(F.min("doc_id").alias("__name"))
    return out.join(names, "root", "left").select("doc_id", "node", F.when(F.col("__own"), F.col("doc_id")).otherwise(F.col("__name")).alias("class_id"), "root", "__own")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest ``doc_id``; texts without words all stay.

    Of rows with one id and text the first by their other columns (as JSON) stays.
    """
    key = F.md5(F.col("text").cast("binary"))
    found = classes(docs.select("doc_id", "text"), **how).where("not __own")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")).alias("w")).select("w.doc_id", "w.node")
    tagged = docs.withColumn("__node", key)
    wordless = tagged.where(~F.coalesce(F.regexp_like("text", F.lit(r"[^ \t\n\x0B\f\r]")), F.lit(False)))
    match = (F.col("d.__node") == F.col("b.node")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
    kept = tagged.alias("d").join(best.alias("b"), match, "left_semi")
    rest = [F.to_json(F.struct(*[c for c in docs.columns if c not in ("text", "doc_id")]))] if set(docs.columns) - {"text", "doc_id"} else [F.lit(0)]
    once = kept.withColumn("__k", F.row_number().over(Window.partitionBy("__node", "doc_id").orderBy(*rest))).where("__k = 1")
    return once.select(*docs.columns).union(wordless.select(*docs.columns))
