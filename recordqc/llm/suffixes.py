"""Suffix-array dedup by distributed prefix doubling: bytes covered by a string of ``length`` bytes that starts twice or more.

Sorting every byte position of a corpus at every offset would shuffle a row a byte and round. Positions are therefore
sorted first by what is cheap, and only those whose rank is still shared go on:

1. **Offset ``anchor``.** Every string of ``length`` bytes has an anchor, the one of its ``anchor``-byte strings with the smallest
   hash (the leftmost of equals). Equal strings have equal anchors at equal places. Neighbouring starts with one anchor
   are a segment: the bytes from its first start to its last start's end. An anchor that occurs once has a rank of its
   own, and its starts are unique.
2. **Offset of a segment.** Segments of shared anchors are ranked by all their bytes. Equal segments have equal ranks at each smaller
   offset too: all their starts are repeated, and one of them stands for all from here on. If an anchor's segments are all equal,
   no rank can split any more.
3. **Offsets 8, 16, 32, 64, 128, ``length``.** What is left are anchors with unlike segments, the edges of copies and passages. Spark deals
   them by anchor, so that equal strings meet, and each byte position is ranked by its first 8 bytes, then by pairs of
   the rank here and the rank an offset later, which are sorted and ranked again. A position whose rank is unique is
   dropped, and so is every pair with it. Starts that still share a rank at ``length`` are repeated. These ranks come from the bytes, no hash
   decides here.
4. **Hot anchors.** An anchor with over ``hot`` unlike segments (an edge of a passage that a large part of all documents shares)
   would put them into one task. The starts of such anchors are dealt by all their ``length`` bytes instead, as segments of one start.

Steps 1 to 3 read the texts once each. Which anchors go on is told to the tasks by bit tables of a fixed size
(``rolling.table_of``); what these let through wrongly is sorted for nothing and changes no result. Step 2 and hot
starts compare 128 bits of hash.

Each row is a document of its own: rows with equal texts of ``length`` bytes or more lose all their bytes, repeated ids
included. Null texts are empty. Texts shorter than ``length`` stay whole. An empty table gives an empty result. Invalid
UTF-8 is treated as the bytes that it is. Other columns are kept; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from recordqc.llm.common import small_batches, stored
from recordqc.llm.rolling import BASES, Prefixes, found, table_of
from recordqc.llm.shingles import mixed

LENGTH, ANCHOR = 200, 64
HOT = 2_000
#: Bytes of text that are hashed at once; a longer text is cut into overlapping blocks. Places take PLACE bits.
BLOCK, PLACE = 1 << 17, 24
#: Texts of which a task remembers that it has seen them, and rows that are cut at once.
SEEN, CUT = 10_000, 500
#: Byte positions that are ranked at once.
RANKED = 1 << 18
ADDED = ("n_bytes", "n_removed", "n_spans", "spans", "kept")


class _Segments:
    """Segments of a list of (text number, first byte, bytes) blocks."""

    def __init__(self, blocks, length: int, anchor: int):
        sizes = np.array([len(b) for _, _, b in blocks], np.int64)
        self.data = np.frombuffer(b"".join(b for _, _, b in blocks), np.uint8)
        at = np.concatenate(([0], np.cumsum(sizes)))
        self.sums = Prefixes(self.data)
        grams = self.sums.windows(anchor)
        least = grams >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(grams), dtype=np.uint64)
        reach, step = length - anchor + 1, 1
        while step * 2 <= reach:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if reach > step:
            least = np.minimum(least[:step - reach], least[reach - step:])
        starts = np.maximum(0, sizes - length + 1)
        block = np.repeat(np.arange(len(sizes)), starts)
        start = np.arange(len(block)) - np.repeat(np.cumsum(starts) - starts, starts) + at[block]
        place = (least[start] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (block[1:] != block[:-1])))) if len(block) else np.zeros(0, np.int64)
        self.count = np.diff(np.concatenate((new, [len(block)]))) if len(new) else np.zeros(0, np.int64)
        self.first = start[new]
        self.anchor = grams[place[new]].view(np.int64)
        self.text = np.array([n for n, _, _ in blocks], np.int64)[block[new]]
        self.place = self.first - at[block[new]] + np.array([p for _, p, _ in blocks], np.int64)[block[new]]
        self.end = self.first + self.count - 1 + length


def _occurrence(digests: list[bytes], text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One long for each place of a text."""
    heads = np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64)
    return mixed(heads[text] + mixed(place.astype(np.uint64) + np.uint64(1))).view(np.int64)


def _parts(batches, length: int, size: int):
    """(digests, blocks) of at most about ``size`` bytes; a text that came among the last ``SEEN`` or fewer is left out."""
    seen = set()
    for batch in batches:
        digests, blocks, held = [], [], 0
        for value in batch.column(0):
            text = value.as_buffer()
            if text is None or text.size < length:
                continue
            text = text.to_pybytes()
            digest = hashlib.md5(text).digest()
            if digest in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(digest)
            digests.append(digest)
            for p in range(0, len(text) - length + 1, size):
                blocks.append((len(digests) - 1, p, text[p:p + size + length - 1]))
                held += len(blocks[-1][2])
                if held >= size:
                    yield digests, blocks
                    blocks, held = [], 0
        if blocks:
            yield digests, blocks


def _binary(rows) -> pa.Array:
    return pa.array(rows, pa.binary())


def _anchors(length, anchor, block):
    def run(batches):
        for digests, blocks in _parts(batches, length, block):
            s = _Segments(blocks, length, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(s.anchor), pa.array(_occurrence(digests, s.text, s.place))], names=["a", "occ"])
    return run, "a long, occ long"


_SEGMENT = "a long, s1 long, s2 long, occ long, d binary, place long, n int"


def _columns(digests, s: _Segments, keep, a, s1, s2):
    return [pa.array(a), pa.array(s1), pa.array(s2), pa.array(_occurrence(digests, s.text[keep], s.place[keep])),
            _binary([digests[i] for i in s.text[keep].tolist()]), pa.array(s.place[keep]), pa.array(s.count[keep].astype(np.int32))]


def _shared_segments(length, anchor, block, shared):
    names = [x.split(" ")[0] for x in _SEGMENT.split(", ")]

    def run(batches):
        for digests, blocks in _parts(batches, length, block):
            s = _Segments(blocks, length, anchor)
            keep = np.flatnonzero(found(shared.value, s.anchor))
            second = Prefixes(s.data, BASES[1])
            first, end = s.first[keep], s.end[keep]
            yield pa.RecordBatch.from_arrays(_columns(digests, s, keep, s.anchor[keep], s.sums.hashes(first, end).view(np.int64),
                                                      second.hashes(first, end).view(np.int64)), names=names)
    return run, _SEGMENT


def _unsettled(length, anchor, block, chosen, hot):
    """Segments to be ranked by their bytes, and the single starts of hot anchors (without bytes)."""
    names = [x.split(" ")[0] for x in _SEGMENT.split(", ")] + ["bytes"]

    def run(batches):
        for digests, blocks in _parts(batches, length, block):
            s = _Segments(blocks, length, anchor)
            zero = np.zeros(0, np.int64)
            is_hot = found(hot.value, s.anchor) if hot else np.zeros(len(s.anchor), bool)
            keep = np.flatnonzero(~is_hot & found(chosen.value, _occurrence(digests, s.text, s.place)))
            raw = s.data.tobytes()
            if len(keep):
                none = np.zeros(len(keep), np.int64)
                text = [raw[i:j] for i, j in zip(s.first[keep].tolist(), s.end[keep].tolist())]
                yield pa.RecordBatch.from_arrays([*_columns(digests, s, keep, s.anchor[keep], none, none), _binary(text)], names=names)
            keep = np.flatnonzero(is_hot)
            if len(keep):
                times = s.count[keep]
                row = np.repeat(keep, times)
                shift = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                first, place, text = s.first[row] + shift, s.place[row] + shift, s.text[row]
                s1 = s.sums.hashes(first, first + length).view(np.int64)
                s2 = Prefixes(s.data, BASES[1]).hashes(first, first + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s1), pa.array(s2), pa.array(_occurrence(digests, text, place)),
                                                  _binary([digests[i] for i in text.tolist()]), pa.array(place), pa.array(np.ones(len(row), np.int32)),
                                                  pa.nulls(len(row), pa.binary())], names=names)
    return run, _SEGMENT + ", bytes binary"


def _reranked(key: np.ndarray):
    """Ranks of sorted keys from 0, and how many positions have each rank."""
    _, rank, times = np.unique(key, return_inverse=True, return_counts=True)
    return rank.astype(np.int64), times


def repeated_starts(groups: np.ndarray, segments: list[bytes], length: int) -> np.ndarray:
    """Positions in the joined segments at which a string of ``length`` bytes starts that starts in its group twice or more.

    Prefix doubling: ranks of 8 bytes, then sorted pairs of ranks at growing offsets. Positions with a rank of their own
    go; ``length`` must be 16 or more.
    """
    sizes = np.array([len(x) for x in segments], np.int64)
    data = np.frombuffer(b"".join(segments) + b"\0" * 8, np.uint8)
    total = int(sizes.sum())
    segment = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    first = np.ndarray((total,), ">u8", data, strides=(1,))
    rank = np.full(total, -1, np.int64)
    alive = np.flatnonzero(np.arange(total) + 8 <= end)
    value, _ = _reranked(first[alive].astype(np.uint64))
    value, times = _reranked(groups[segment[alive]] << 32 | value)
    h = 8
    while True:
        more = times[value] > 1
        alive = alive[more]
        rank[:] = -1
        rank[alive] = value[more]
        if h == length or not len(alive):
            return alive
        step = min(h, length - h)
        alive = alive[alive + step + h <= end[alive]]
        later = rank[alive + step]
        alive, later = alive[later >= 0], later[later >= 0]
        value, times = _reranked(rank[alive] << 32 | later)
        h += step


def _doubling(length):
    def settle(held):
        rows = list({(d, p): (a, b) for a, d, p, b in held}.items())
        order = {a: i for i, a in enumerate({a for _, (a, _) in rows})}
        groups = np.array([order[a] for _, (a, _) in rows], np.int64)
        sizes = np.array([len(b) for _, (_, b) in rows], np.int64)
        offset = np.concatenate(([0], np.cumsum(sizes)))
        starts = repeated_starts(groups, [b for _, (_, b) in rows], length)
        row = np.searchsorted(offset, starts, "right") - 1
        new = np.concatenate(([True], (np.diff(starts) > 1) | (np.diff(row) > 0))) if len(starts) else np.zeros(0, bool)
        new = np.flatnonzero(new)
        last = np.concatenate((new[1:] - 1, [len(starts) - 1])) if len(new) else new
        place = np.array([p for (_, p), _ in rows], np.int64)
        begin = place[row[new]] + starts[new] - offset[row[new]]
        return pa.RecordBatch.from_arrays([_binary([rows[i][0][0] for i in row[new].tolist()]), pa.array(begin),
                                           pa.array(begin + starts[last] - starts[new] + length)], names=["d", "s", "e"])

    def run(batches):
        held, bytes_held, last = [], 0, None
        for b in batches:
            for a, d, p, text in zip(*(c.to_pylist() for c in b.columns)):
                if a != last and bytes_held >= RANKED:
                    yield settle(held)
                    held, bytes_held = [], 0
                held.append((a, d, p, text))
                bytes_held += len(text)
                last = a
        if held:
            yield settle(held)
    return run, "d binary, s long, e long"


def _equal(segments: DataFrame) -> DataFrame:
    """Unlike segments with whether they occur at two places or more."""
    return segments.groupBy("a", "s1", "s2").agg(F.min("occ").alias("occ"), (F.min("occ") != F.max("occ")).alias("multi"))


def _removed(segments: DataFrame, multi: DataFrame, length: int) -> DataFrame:
    """Spans of all segments that are equal to another one."""
    got = segments.join(multi.where("multi").select("a", "s1", "s2"), ["a", "s1", "s2"])
    return got.select("d", F.col("place").alias("s"), (F.col("place") + F.col("n") - 1 + length).alias("e"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(d, s, e): bytes ``s`` to ``e`` of the text with MD5 ``d`` are covered by repeated strings; one row a text and span or more.

    ``texts`` has one binary column. Copies of a text count as that text once.
    """
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    anchors = texts.mapInArrow(*_anchors(length, anchor, block)).groupBy("a").agg(F.min("occ").alias("l"), F.max("occ").alias("m")).where("l <> m")
    shared = share(table_of(anchors, "a"))
    segments = stored(texts.mapInArrow(*_shared_segments(length, anchor, block, shared)), "segments")
    ranked = stored(_equal(segments), "segment-ranks")
    classes = stored(ranked.groupBy("a").agg(F.count(F.lit(1)).alias("unlike"), F.bool_or(~F.col("multi")).alias("single")).where("unlike > 1 and single"), "open-anchors")
    heavy = classes.where(F.col("unlike") > hot).select("a")
    hot_table = share(table_of(heavy, "a")) if heavy.limit(1).count() else None
    chosen = share(table_of(ranked.join(classes.where(F.col("unlike") <= hot).select("a"), "a", "left_semi"), "occ"))
    unsettled = stored(texts.mapInArrow(*_unsettled(length, anchor, block, chosen, hot_table)), "unsettled")
    dealt = unsettled.where("bytes is not null").select("a", "d", "place", "bytes").repartition("a").sortWithinPartitions("a")
    spans = _removed(segments, ranked, length).unionByName(dealt.mapInArrow(*_doubling(length)))
    if hot_table:
        single = unsettled.where("bytes is null")
        spans = spans.unionByName(_removed(single, _equal(single), length))
    return spans


def _cut(length):
    def run(batches):
        for b in (whole.slice(at, CUT) for whole in batches for at in range(0, whole.num_rows, CUT)):
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            size, removed, runs, spans, kept = [], [], [], [], []
            for text, copies, starts, ends in zip(column["__text"], column["__copies"].to_pylist(), column["__s"].to_pylist(), column["__e"].to_pylist()):
                text = text.as_py() or b""
                if copies and copies > 1 and len(text) >= length:
                    cut = [[0, len(text)]]
                else:
                    cut = []
                    for s, e in sorted(zip(starts or [], ends or [])):
                        if cut and s <= cut[-1][1]:
                            cut[-1][1] = max(cut[-1][1], e)
                        else:
                            cut.append([s, e])
                at, left = 0, []
                for s, e in cut:
                    left.append(text[at:s])
                    at = e
                left.append(text[at:])
                kept.append(b"".join(left))
                size.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                runs.append(len(cut))
                spans.append([{"start": s, "end": e} for s, e in cut])
            made = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), _binary(kept)]
            rest = [n for n in column if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*[column[n] for n in rest], *made], names=[*rest, *ADDED])
    return run


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` with n_bytes, n_removed, n_spans, spans (start, end) and the bytes ``kept``; needs ``text``.

    Writes intermediate tables when called.
    """
    own = [c for c in docs.columns if c not in ADDED]
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    rows = docs.select(*own, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("__text")).withColumn("__d", F.unhex(F.md5("__text")))
    copies = rows.groupBy("__d").agg(F.count(F.lit(1)).alias("__copies")).where("__copies > 1")
    with small_batches(docs.sparkSession):
        spans = repeated_spans(texts, length, anchor, hot, block).groupBy("d").agg(F.collect_set(F.struct("s", "e")).alias("x"))
        known = stored(copies.join(spans.withColumnRenamed("d", "__d"), "__d", "full_outer").select("__d", "__copies", F.col("x.s").alias("__s"), F.col("x.e").alias("__e")), "spans")
    joined = rows.join(known, "__d", "left").drop("__d")
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([docs.schema[c] for c in own] + [StructField(n, LongType()) for n in ADDED[:3]] + [StructField("spans", ArrayType(span)), StructField("kept", BinaryType())])
    return joined.mapInArrow(_cut(length), schema)
