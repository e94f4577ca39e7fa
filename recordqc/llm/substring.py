"""Substring dedup with suffix automata of reference shards.

A word goes if a window of ``WINDOW`` words around it also starts in a document with a smaller id. Sending one
automaton of every shard of the corpus to every task would cost the square of the corpus; here a shard's automaton
meets exactly the document parts that can match it:

0. Of documents with equal texts all but the first are settled: all their words in windows go.
1. Each window has an anchor, its six-word sequence of smallest hash. Equal windows have equal anchors, so a run of
   windows with one anchor can only match runs with the same one.
2. Anchors that one document alone holds are dropped. Tasks settle what they see themselves and send an anchor once,
   so a passage that a third of all documents share sends a row for each batch, not for each document.
3. Of equal runs in a slice of a batch the smallest document's is kept and the others are settled. Runs of shared anchors are
   dealt by anchor: a partition is a reference shard with its queries. Equal runs count once,
   with the smallest id; windows whose hash occurs once go; over the rest one automaton is built for at most
   ``SHARD`` words, every state with the smallest id of its occurrences. Runs stream through it, and where the match is
   a window long, the state tells whether a smaller document holds it.
   At the edges of a passage that very many documents share, runs have one anchor but different words. The windows of
   such heavy anchors are runs of their own, dealt by their words, so no more than equal windows meet in a task. Heavy
   are the at most ``HEAVY`` anchors with most runs among those that make up over 1 / ``HEAVY`` of a batch: every anchor
   with over 2 / ``HEAVY`` of all runs is one of them. Which ones they are changes no result.
4. Removed windows are gathered by document and cut from its words.

Null texts have no words. Null ids count as one document after all others. Rows that repeat an id are that document;
each is cut by its own text. Texts shorter than a window stay whole. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from recordqc.llm.automaton import SuffixAutomaton
from recordqc.llm.common import map_batches, slices, stored
from recordqc.llm.shingles import mixed, offsets, sequences, word_hashes

WINDOW, ANCHOR = 13, 6
REACH = WINDOW - ANCHOR + 1  # anchors a window can have; 8, so that three doublings find the smallest
SHARD = 60_000
HEAVY = 4096
#: Bytes of text whose words a task holds at once.
SLICE = 8 << 20
LAST = 2 ** 63 - 1
#: Start that stands for all windows of a text.
WHOLE = -1


class _Runs:
    """Runs of windows with one anchor, for a batch of texts."""

    def __init__(self, words: list[list[bytes]]):
        at = offsets([len(w) for w in words])
        grams = sequences(word_hashes([w for ws in words for w in ws]), ANCHOR)
        n = max(0, len(grams) - REACH + 1)
        value, place = grams, np.arange(len(grams))
        for shift in (1, 2, 4):
            size = len(value) - shift
            if size <= 0:
                value, place = value[:0], place[:0]
                break
            less = value[shift:] < value[:size]
            value, place = np.where(less, value[shift:], value[:size]), np.where(less, place[shift:], place[:size])
        doc = np.repeat(np.arange(len(words)), np.maximum(0, np.diff(at) - WINDOW + 1))
        start = np.arange(len(doc)) - np.repeat(offsets(np.maximum(0, np.diff(at) - WINDOW + 1))[:-1], np.maximum(0, np.diff(at) - WINDOW + 1)) + at[doc] \
            if len(doc) else np.zeros(0, np.int64)
        assert len(doc) == 0 or start[-1] < n
        anchor = place[start]
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
        self.doc, self.start = doc[new], start[new] - at[doc[new]]
        self.count = np.diff(np.concatenate((new, [len(anchor)])))
        self.anchor = mixed(grams[anchor[new]])


def _words(batch) -> list[list[bytes]]:
    return [(t or "").encode().split() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _batch(schema, *columns):
    import pyarrow as pa
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split(" ")[1]]) for c, x in zip(columns, schema.split(", "))], names=names)


def _distinct(anchor, doc):
    """Sorted pairs without repeats and, for each, whether another document holds the anchor."""
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    keep = np.ones(len(anchor), bool)
    keep[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    anchor, doc = anchor[keep], doc[keep]
    same = np.concatenate(([False], anchor[1:] == anchor[:-1], [False]))
    return anchor, doc, same[:-1] | same[1:], ~same[:-1]


def _heavy(heavy, most, batches):
    """Anchors with a large share of a batch's runs, and their number of runs in it."""
    for b in batches:
        values, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part in slices(b, most):
            found, n = np.unique(_Runs(_words(part)).anchor, return_counts=True)
            total += int(n.sum())
            values, inverse = np.unique(np.concatenate((values, found)), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate((counts, n)), len(values)).astype(np.int64)
        large = (counts > 1) & (counts * heavy > total)
        if large.any():
            yield _batch("anchor long, n long", values[large].view(np.int64), counts[large])


def _heavy_anchors(texts: DataFrame, heavy: int, most: int) -> np.ndarray:
    """At most ``heavy`` anchors, on the driver."""
    proposed = texts.mapInArrow(partial(_heavy, heavy, most), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.array([r["anchor"] for r in proposed.orderBy(F.desc("n"), "anchor").limit(heavy).collect()], np.int64).view(np.uint64)


ANCHORS = "anchor long, doc long, settled boolean"


def _anchors(most, batches):
    """Anchors of each document, those that two documents of a batch share as settled."""
    for b in batches:
        found = []
        for part in slices(b, most):
            runs = _Runs(_words(part))
            found.append((runs.anchor, _column(part, "doc").to_numpy()[runs.doc]))
        if not any(len(ids) for _, ids in found):
            continue
        anchor, doc, shared, first = _distinct(*map(np.concatenate, zip(*found)))
        sent = first | ~shared
        yield _batch(ANCHORS, np.concatenate((anchor[sent], anchor[shared])).view(np.int64), np.concatenate((doc[sent], doc[shared])),
                     np.repeat([False, True], [sent.sum(), shared.sum()]))


def _shared(batches):
    """From the anchors of a partition, (doc, anchor) that another document holds too."""
    held = []
    for b in batches:
        anchor, doc, settled = _column(b, "anchor").to_numpy().view(np.uint64), _column(b, "doc").to_numpy(), _column(b, "settled").to_numpy(zero_copy_only=False)
        if settled.any():
            yield _batch("doc long, anchor long", doc[settled], anchor[settled].view(np.int64))
        held.append((anchor[~settled], doc[~settled]))
    if held:
        anchor, doc, shared, _ = _distinct(*map(np.concatenate, zip(*held)))
        if shared.any():
            yield _batch("doc long, anchor long", doc[shared], anchor[shared].view(np.int64))


def _windows_of(split, doc, start, count, anchor):
    """The runs, with each window of those in ``split`` as a run of its own, and ``split`` for them."""
    times = np.where(split, count, 1)
    step = np.arange(times.sum()) - np.repeat(offsets(times)[:-1], times)
    return np.repeat(doc, times), np.repeat(start, times) + step, np.repeat(np.where(split, 1, count), times), np.repeat(anchor, times), np.repeat(split, times)


RUNS = "anchor long, run binary, doc long, own long, starts array<int>, mask int"


def _runs(most, heavy, batches):
    """Words of the runs whose anchor is in the document's list ``anchors``; each window of ``heavy`` anchors by itself.

    Equal runs of a document are one row with all their ``starts``. Of equal runs in a slice only the smallest document's
    goes on; the others lose all of its windows at once (``mask``) and are dealt out evenly without words.
    """
    for b in (part for whole in batches for part in slices(whole, most)):
        words = _words(b)
        for i, (own, copies) in enumerate(zip(_column(b, "own").to_pylist(), _column(b, "copies").to_pylist())):
            if own in copies:
                words[i] = []
        runs = _Runs(words)
        lists = _column(b, "anchors")
        flat = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
        owner = np.repeat(np.arange(len(words)), np.diff(np.asarray(lists.offsets)))
        tag = lambda anchor, doc: mixed(anchor + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        hit = np.flatnonzero(np.isin(tag(runs.anchor, runs.doc), tag(flat, owner)))
        if len(hit):
            doc, start, count, anchor, split = _windows_of(np.isin(runs.anchor[hit], heavy), *(x[hit] for x in (runs.doc, runs.start, runs.count, runs.anchor)))
            text = [b" ".join(words[d][s:s + n + WINDOW - 1]) for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist())]
            if split.any():
                at = np.flatnonzero(split)
                anchor[at] = word_hashes([text[i] for i in at.tolist()])
            places: dict[tuple[int, bytes], list[int]] = {}
            for key, s in zip(zip(doc.tolist(), text), start.tolist()):
                places.setdefault(key, []).append(s)
            index = {key: i for i, key in enumerate(zip(doc.tolist(), text))}
            rows = np.array([index[key] for key in places])
            doc, count, anchor, text = doc[rows], count[rows], anchor[rows], [t for _, t in places]
            ids = np.array(_column(b, "doc").to_pylist(), np.int64)[doc]
            first: dict[bytes, int] = {}
            for t, d in zip(text, ids.tolist()):
                if d < first.get(t, LAST + 1):
                    first[t] = d
            later = ids > np.array([first[t] for t in text], np.int64)
            anchor = np.where(later, tag(anchor, doc), anchor)
            yield _batch(RUNS, anchor.view(np.int64), [b"" if gone else t for gone, t in zip(later.tolist(), text)], ids,
                         np.array(_column(b, "own").to_pylist(), np.int64)[doc], list(places.values()), np.where(later, (1 << count) - 1, 0).astype(np.int32))


REMOVED = "doc long, own long, starts array<int>, mask int"


class _Shard:
    """Groups of unequal runs until they make an automaton."""

    def __init__(self):
        self.runs: list[tuple[list[bytes], list[tuple[int, int, list[int]]]]] = []
        self.size = 0

    def add(self, run: bytes, rows):
        words = run.split(b" ")
        self.runs.append((words, rows))
        self.size += len(words)

    def removed(self):
        """(doc, own, starts, mask of windows from each start) of rows that lose windows."""
        if not self.runs:
            return
        at = offsets([len(w) for w, _ in self.runs])
        hashes = sequences(word_hashes([x for w, _ in self.runs for x in w]), WINDOW)
        index = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        _, inverse, counts = np.unique(hashes[index], return_inverse=True, return_counts=True)
        again = np.zeros(at[-1] + 1, bool)
        again[index] = counts[inverse] > 1
        parts: dict[tuple, int] = {}
        spans = []
        for k, (words, rows) in enumerate(self.runs):
            kept = np.flatnonzero(again[at[k]:at[k + 1]])
            if rows[0][0] != rows[-1][0]:  # two documents hold all of this run
                lo, hi = 0, len(words) - WINDOW
            elif len(kept):
                lo, hi = int(kept[0]), int(kept[-1])
            else:
                continue
            part = tuple(words[lo:hi + WINDOW])
            parts[part] = min(parts.get(part, LAST), rows[0][0])
            spans.append((part, lo, rows))
        automaton = SuffixAutomaton()
        for part in parts:
            automaton.add(part)
        least = [LAST] * len(automaton.next)
        for part, doc in parts.items():
            state = 0
            for c in part:  # every prefix of an added sequence is read without a break
                state = automaton.next[state][c]
                if doc < least[state]:
                    least[state] = doc
        link, longest = automaton.link, automaton.longest
        for state in automaton.by_length():
            if least[state] < least[link[state]]:
                least[link[state]] = least[state]
        smallest: dict[tuple, list[int]] = {}
        for part, lo, rows in spans:
            if part not in smallest:
                found = smallest[part] = []
                for state, length in automaton.walk(part):
                    if length >= WINDOW:
                        while longest[link[state]] >= WINDOW:
                            state = link[state]
                        found.append(least[state])
            for doc, own, starts in rows:
                mask = sum(1 << i for i, d in enumerate(smallest[part]) if d < doc)
                if mask:
                    yield doc, own, [s + lo for s in starts], mask


def _matched(most, batches):
    """Removed windows from runs sorted by anchor, run and document."""
    shard, out = _Shard(), []
    anchor, group, run = None, [], None  # group: (run, rows) of the current anchor

    def close():
        if len(group) == 1:  # equal runs: each window's smallest document is theirs
            words, rows = group[0]
            mask = (1 << (words.count(b" ") + 2 - WINDOW)) - 1
            out.extend((doc, own, starts, mask) for doc, own, starts in rows if doc > rows[0][0])
        else:
            for text, rows in group:
                shard.add(text, rows)

    for b in batches:
        for a, text, mask, *row in zip(*[_column(b, c).to_pylist() for c in ("anchor", "run", "mask", "doc", "own", "starts")]):
            if mask:
                out.append((*row, mask))
                continue
            if a != anchor:
                close()
                if shard.size >= most:
                    out.extend(shard.removed())
                    shard = _Shard()
                anchor, group, run = a, [], None
            if text != run:
                group.append((text, []))
                run = text
            group[-1][1].append(tuple(row))
        if out:
            yield _batch(REMOVED, *zip(*out))
            out.clear()
    close()
    out.extend(shard.removed())
    if out:
        yield _batch(REMOVED, *zip(*out))


def dedup(docs: DataFrame, shard_words: int = SHARD, slice_bytes: int = SLICE, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words that stay, joined by one space) of each row of ``docs`` (doc_id, text)."""
    named = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("own"))
    split = _heavy_anchors(named.select("text"), heavy, slice_bytes)
    sent = named.select("doc", "text").mapInArrow(partial(_anchors, slice_bytes), ANCHORS)
    dealt = sent.repartition(F.when(F.col("settled"), F.xxhash64("doc")).otherwise(F.col("anchor")))
    equal = named.select("doc", "own", F.md5(F.col("text").cast("binary")).alias("digest"))
    firsts = equal.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    copies = stored(equal.join(firsts, "digest").where("doc > first").select("doc", "own").distinct(), "substring-copies")
    nothing = lambda kind: F.lit(None).cast(kind)
    lists = dealt.mapInArrow(_shared, "doc long, anchor long").select("doc", "anchor", nothing("long").alias("own")) \
        .union(copies.select("doc", nothing("long"), "own")) \
        .groupBy("doc").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("own").alias("copies"))
    # both joins below read the same exchange of the texts, so they ask for the same columns
    runs = named.join(lists.hint("shuffle_hash"), "doc").select("doc_id", "doc", "own", "text", "anchors", "copies").mapInArrow(partial(_runs, slice_bytes, split), RUNS)
    removed = runs.repartition("anchor").sortWithinPartitions("anchor", "run", "doc").mapInArrow(partial(_matched, shard_words), REMOVED)
    whole = copies.select("doc", "own", F.array(F.lit(WHOLE)).alias("starts"), F.lit(0).alias("mask"))
    cuts = removed.union(whole).groupBy("doc").agg(F.collect_list(F.struct("own", "starts", "mask")).alias("cuts"))

    def made(batch):
        counts, gone, kept = [], [], []
        own = _column(batch, "own").to_pylist()
        for words, mine, cut in zip(_words(batch), own, _column(batch, "cuts").to_pylist()):
            counts.append(len(words))
            edge = np.zeros(len(words) + 1, np.int32)
            for c in cut or ():
                if c["own"] == mine and c["starts"] == [WHOLE]:
                    edge[0] += len(words) >= WINDOW  # from the first word to the last
                elif c["own"] == mine:
                    starts = np.array(c["starts"])  # all different
                    for i in range(c["mask"].bit_length()):
                        if c["mask"] >> i & 1:
                            edge[starts + i] += 1
                            edge[starts + i + WINDOW] -= 1
            stays = np.cumsum(edge)[:-1] == 0
            gone.append(int(len(words) - stays.sum()))
            kept.append((b" ".join(words) if not gone[-1] else b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])).decode())
        return [counts, gone, kept]

    final = named.join(cuts.hint("shuffle_hash"), "doc", "left")
    return map_batches(final.select("doc_id", "text", "own", "cuts"), made, [("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType())], ["doc_id"], slice_bytes)
