"""Benchmark decontamination with generalised suffix automata of normalised items.

Items and texts are lower-cased (A-Z) and cut into words of letters, digits and
characters beyond ASCII. Items are cut into pieces that overlap by one word less
than the window, pieces are dealt to shards of at most ``shard_words`` words, and
one automaton is built for a shard: that bound is what makes it fit for a
broadcast. Documents stream through it once a shard; the longest match at each
word tells which words lie inside a window, and which items hold it. An item
shorter than a window counts as a whole.

Null and empty texts have no words; null and empty items give no windows.
Repeated items give the same windows; their ids are sorted as strings. Items
with a null id are hit and cut like others and count as one item in ``n_items``;
only the list of ids leaves them out. An empty benchmark leaves every document clean. Extra columns pass
through; columns named like the result's are replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from recordqc.llm.automaton import SuffixAutomaton
from recordqc.llm.common import map_batches, stored, texts_of

#: Bytes outside words become spaces, A-Z become a-z; bytes of characters beyond ASCII stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_BUILT: dict = {}
#: An index of 100,000 words takes about 80 MB of a Python worker; a shard has at most twice as many words.
SHARD_WORDS = 100_000


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class _Index:
    """An automaton over pieces with, by state, the items of its windows and the short items that end there."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in pieces]
        self.window, self.automaton = window, SuffixAutomaton()
        for _, seq in coded:
            self.automaton.add(seq)
        a, marks = self.automaton, {}
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, seq in coded:
            for state, length in a.walk(seq):
                marks.setdefault(state, set()).add(item)
            if len(seq) < window:  # the last state read holds the whole item
                self.short.setdefault(state, []).append((len(seq), item))
        for state in a.by_length():
            found = marks.pop(state, set())
            if a.longest[a.link[state]] < window <= a.longest[state]:
                self.items[state] = found
            elif a.longest[state] >= window:
                marks.setdefault(a.link[state], set()).update(found)
        self.least = min([len(seq) for _, seq in coded if len(seq) < window], default=window)
        self.at: dict[int, int] = {}

    def _window_state(self, state: int) -> int:
        """The state that holds the last ``window`` words of a match."""
        found = self.at.get(state)
        if found is None:
            a, found = self.automaton, state
            while a.longest[a.link[found]] >= self.window:
                found = a.link[found]
            self.at[state] = found
        return found

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Disjoint [start, end) spans of hit words, and the items."""
        spans: list[list[int]] = []
        items: set[str] = set()
        if len(words) < self.least:
            return spans, items
        codes = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0]))))
        for start, end in zip(known[::2].tolist(), known[1::2].tolist()):
            if end - start >= self.least:
                self._run(codes[start:end].tolist(), start, spans, items)
        return spans, items

    def _run(self, codes, offset, spans, items):
        a, short = self.automaton, self.short
        for i, (state, length) in enumerate(a.walk(codes), offset + 1):
            size = 0
            if length >= self.window:
                size = self.window
                items |= self.items[self._window_state(state)]
            if short:
                s = state
                while s > 0:
                    for n, item in short.get(s, ()):
                        if n <= length:
                            size = max(size, n)
                            items.add(item)
                    s = a.link[s]
            if size:
                start = i - size
                while spans and spans[-1][1] >= start:  # short and long spans may nest
                    start = min(start, spans.pop()[0])
                spans.append([start, i])


def pieces_of(benchmark: DataFrame, window: int, piece_words: int) -> DataFrame:
    """``item, piece`` (array of words): items cut so that each window lies in a piece."""
    def made(batch):
        out = []
        for text in texts_of(batch):
            words = [w.decode() for w in words_of(text)]
            step = piece_words - window + 1
            out.append([" ".join(words[i:i + piece_words]) for i in range(0, max(1, len(words) - window + 1), step)] if words else [])
        return [out]
    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    cut = map_batches(named, made, [("pieces", ArrayType(StringType()))], ["item"])
    return cut.select("item", F.explode("pieces").alias("piece"))


def shards_of(benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS) -> tuple[int, Iterator[list[tuple[str | None, str]]]]:
    """Number of shards, and their pieces: a shard is fetched when it is asked for and has at most twice ``shard_words`` words."""
    piece_words = max(2 * window, min(10_000, shard_words // 10))
    pieces = stored(pieces_of(benchmark, window, piece_words).distinct(), "benchmark-pieces")
    size = F.size(F.split("piece", " "))
    total = pieces.agg(F.sum(size)).first()[0] or 0
    n = math.ceil(total / shard_words)
    dealt = pieces.withColumn("__shard", F.pmod(F.xxhash64("item", "piece"), F.lit(max(n, 1))))
    largest = dealt.groupBy("__shard").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > 2 * shard_words:
        raise ValueError(f"a benchmark shard has {largest} words; raise shard_words")
    return n, ([(r.item, r.piece) for r in dealt.where(F.col("__shard") == i).select("item", "piece").collect()] for i in range(n))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words, n_hit, hit_spans`` (flat start, end pairs in words) ``, hit_items`` (sorted as strings) ``, n_items``."""
    made_names = ["n_words", "n_hit", "hit_spans", "hit_items", "n_items"]
    docs = docs.drop(*made_names)
    columns, (n, shards) = docs.columns, shards_of(benchmark, window, shard_words)
    spark = docs.sparkSession
    fields = [("n_words", LongType()), ("hit_spans", ArrayType(IntegerType())), ("hit_items", ArrayType(StringType()))]
    for k in range(max(n, 1)):
        sent, token, last = spark.sparkContext.broadcast(next(shards, [])), uuid.uuid4().hex, k >= n - 1

        def made(batch, sent=sent, token=token, first=k == 0):
            if token not in _BUILT:
                _BUILT.clear()
                _BUILT[token] = _Index([(item, [w.encode() for w in piece.split(" ")]) for item, piece in sent.value], window)
            counts, spans, items = [], [], []
            before = None if first else [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__spans", "__items")]
            for i, text in enumerate(texts_of(batch)):
                words = words_of(text)
                s, found = _BUILT[token].hits(words)
                if before:
                    old = before[0][i]
                    s = _merged(s + [old[j:j + 2] for j in range(0, len(old), 2)])
                    found = found.union(before[1][i])
                counts.append(len(words))
                spans.append([x for pair in s for x in pair])
                items.append(sorted(found - {None}) + [None] * (None in found))
            return [counts, spans, items]

        keep = columns if keep_text or not last else [c for c in columns if c != "text"]
        docs = map_batches(docs, made, fields, keep)
        if not last:
            docs = stored(docs.drop("n_words").withColumnsRenamed({"hit_spans": "__spans", "hit_items": "__items"}), "benchmark-pass")
    n_hit = F.aggregate("hit_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda acc, x: F.when(
        acc["s"] < 0, F.struct(acc["n"].alias("n"), x.cast("long").alias("s"))).otherwise(
        F.struct((acc["n"] + x - acc["s"]).alias("n"), F.lit(-1).cast("long").alias("s"))), lambda acc: acc["n"])
    docs = docs.withColumn("n_items", F.size("hit_items").cast("long")).withColumn("hit_items", F.filter("hit_items", lambda x: x.isNotNull()))
    return docs.withColumn("n_hit", n_hit).select(*[c for c in docs.columns if c not in made_names], *made_names)


def _merged(spans):
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut_words(text: str, spans: list[int]) -> str:
    """``text`` without the characters of the words in ``spans``; what is left is joined by a line break."""
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    parts, pos = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        parts.append(raw[pos:at[start][0]].rstrip())
        pos = at[end - 1][1]
    parts.append(raw[pos:].lstrip() if spans else raw[pos:])
    return b"\n".join(p for p in parts if p).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.8, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without hit spans; documents of which ``coverage`` of the words are hit go.

    Joined remains could spell an item anew, so cut documents are marked again until none is hit; every round
    shortens the texts it repeats.
    """
    columns = docs.columns
    todo, clean = docs, None
    while True:
        marked = stored(mark(todo, benchmark, window, shard_words), "benchmark-marked")
        done = marked.where("n_hit = 0").select(*columns)
        clean = done if clean is None else clean.unionByName(done)
        hit = marked.where((F.col("n_hit") > 0) & (F.col("n_hit") < coverage * F.col("n_words")))
        if hit.isEmpty():
            return clean

        def made(batch):
            spans = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
            return [[cut_words(t, s) for t, s in zip(texts_of(batch), spans)]]

        cut = map_batches(hit.withColumnRenamed("text", "__old").withColumn("text", F.col("__old")).drop("__old"), made, [("__cut", StringType())],
                          [c for c in columns if c != "text"])
        todo = cut.withColumnRenamed("__cut", "text").select(*columns)
        if "n_chars" in columns:
            todo = todo.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
