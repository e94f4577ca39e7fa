"""Phrase collocations: contiguous word sequences that occur more often together than their parts apart.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``. Everything is counted
per language (null: ``und``). Three readings of the texts:

1. Prefix polynomials of the bytes give the fingerprint of every sequence of one and two words. Tasks sum their own, a shuffle sums the rest and keeps
   one occurrence as a pointer (a hash of the text and the place). Fingerprints with ``least`` occurrences go into a bit table of fixed size.
2. A longer phrase is frequent only if all its pairs are. Fingerprints of three and four words whose pairs are in the table are summed likewise.
3. Only what is frequent gets a text: where an occurrence's pointer is among those kept (a bit table again, then an exact join), its words are read.

Each pointer carries 12 bits of a second fingerprint, and their sum over all occurrences is compared to what equal ones give. If it differs, two phrases
have the fingerprint: the texts are read once more and these are counted by text. So a table that lets too much through, or a shared fingerprint,
changes no count; two phrases that agree in 76 bits would.

The rest is DataFrame code: the cuts of a candidate are joined to the counts of their parts, the lowest score counts. A candidate
goes if a longer one holds it and is at least ``cover`` percent as frequent.

Null texts are empty. Rows that repeat an id or a text count each time. Ties rank by count, then by phrase. An empty table gives an empty result.
Only ``text`` and ``lang`` are read, so other columns of any name may be there.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordqc.llm.common import stored
from recordqc.llm.rolling import BASES, Prefixes, found, table_of
from recordqc.llm.shingles import mixed, word_hashes
from recordqc.operators.scale import ranked

LEAST, COVER, TOP, MOST = 30, 80, 2000, 4
#: Bytes of text whose words are hashed at once; entries that a task holds before it sends them.
BLOCK, HELD = 1 << 18, 1 << 17
CHECK = np.uint64((1 << 12) - 1)  # so that sums of checks stay in 64 bits up to 2e15 occurrences
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class _Slice:
    """Words of some texts of one language, with the place of each word as a hash."""

    def __init__(self, lang: str, data: bytes, start, end, piece, place):
        self.start, self.end, self.piece, self.place = start, end, piece, place
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        self.prefixes, self.second = Prefixes(raw), Prefixes(raw, BASES[1])
        self.lang = word_hashes([lang.encode()])[0]

    def sequences(self, n: int, words: int):
        """Fingerprints, byte starts and ends of the ``n`` words from each of the first ``words`` on, and which are inside a piece."""
        size = max(0, min(words, len(self.start) - n + 1))
        start, end = self.start[:size], self.end[n - 1:n - 1 + size]
        inside = self.piece[:size] == self.piece[n - 1:n - 1 + size]
        return mixed(self.prefixes.hashes(start, end) ^ self.lang), start, end, inside

    def pointers(self, n: int, rows, start, end) -> np.ndarray:
        """52 bits of the place and 12 of a second fingerprint."""
        return (mixed(self.place[rows] + np.uint64(n)) & ~CHECK | self.second.hashes(start, end) >> np.uint64(52)).view(np.int64)


def _slices(batches, block: int):
    """(lang, slice, words that begin sequences); three more words follow them where the text goes on."""
    def parts():
        held, size = defaultdict(list), Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_buffer()
                if raw is not None and raw.size:
                    held[lang].append(raw.to_pybytes())
                    size[lang] += raw.size
                    if size[lang] >= block:
                        size[lang] = 0
                        yield lang, held.pop(lang)
            if size.total() >= 16 * block:
                yield from held.items()
                held.clear()
                size.clear()
        yield from held.items()

    for lang, part in parts():
        folded, heads = [], []
        for raw in part:
            text = raw.translate(_FOLD)
            while b"  " in text:
                text = text.replace(b"  ", b" ")
            heads.append(xxhash.xxh3_64_intdigest(raw))
            folded.append(text)
        data = b"\n".join(folded)
        x = np.frombuffer(data, np.uint8)
        gap = np.ones(len(x) + 2, bool)
        gap[1:-1] = (x == 32) | (x == 10)
        start, end = np.flatnonzero(gap[:-2] & ~gap[1:-1]), np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        piece = np.cumsum(x == 10, dtype=np.int64)[start]
        offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in folded])))
        text = np.searchsorted(offset, start, "right") - 1
        place = mixed(np.array(heads, np.uint64)[text] + mixed((start - offset[text]).astype(np.uint64)))
        first = 0
        while first < len(start):
            last = max(first + 1, int(np.searchsorted(start, start[first] + block)))
            upto = min(last + MOST - 1, len(start))
            base, cut = int(start[first]), slice(first, upto)
            yield lang, _Slice(lang, data[base:end[upto - 1]], start[cut] - base, end[cut] - base, piece[cut], place[cut]), last - first
            first = last


def _summed(rows):
    """Sums and a pointer for each fingerprint; unlike checks of one fingerprint stay apart."""
    key, n, occ = (np.concatenate(x) for x in zip(*rows))
    if not len(key):
        return key, n, occ
    order = np.argsort(key, kind="stable")
    key, occ = key[order], occ[order]
    check = occ.view(np.uint64) & CHECK
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]))))
    return key[new], np.add.reduceat(n[order], new, dtype=np.int32), np.minimum.reduceat(occ, new)


def _fingerprints(block, pairs=None):
    """Fingerprints and their numbers: of one and two words, or of three and four whose pairs are in the table."""
    def batch(rows):
        key, n, occ = rows
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(occ), pa.array(n * (occ & np.int64(CHECK)))], names=["key", "n", "occ", "c"])

    def run(batches):
        held, size = [], 0
        for _, s, words in _slices(batches, block):
            if pairs is not None:
                f, _, _, ok = s.sequences(2, words + MOST)
                good = ok & found(pairs.value, f)
            for n in (1, 2) if pairs is None else range(3, MOST + 1):
                f, start, end, ok = s.sequences(n, words)
                for k in range(n - 1 if pairs is not None else 0):
                    ok = ok & good[k:k + len(f)]
                rows = np.flatnonzero(ok)
                held.append(_summed([(f[rows], np.ones(len(rows), np.int32), s.pointers(n, rows, start[rows], end[rows]))]))
                size += len(held[-1][0])
            if size >= HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield batch(held[0])
                    held, size = [], 0
        if held:
            yield batch(_summed(held))
    return run, "key long, n int, occ long, c long"


def _texts(block, chosen):
    """Phrases at the places that are pointed to, and the number of words of each language as the empty phrase."""
    def run(batches):
        words_of = Counter()
        for lang, s, words in _slices(batches, block):
            words_of[lang] += words
            for n in range(1, MOST + 1):
                f, start, end, ok = s.sequences(n, words)
                rows = np.flatnonzero(ok)
                rows = rows[found(chosen.value, mixed(s.place[rows] + np.uint64(n)))]
                occ = s.pointers(n, rows, start[rows], end[rows])
                _, first = np.unique(occ, return_index=True)
                rows, occ = rows[first], occ[first]
                if len(rows):
                    text = [s.data[a:b] for a, b in zip(start[rows].tolist(), end[rows].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(f[rows].view(np.int64)), pa.array(occ), pa.array([lang] * len(rows), pa.string()),
                                                      pa.array(text, pa.binary()), pa.nulls(len(rows), pa.int64())], names=["key", "occ", "lang", "phrase", "n"])
        if words_of:
            none = pa.nulls(len(words_of), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(list(words_of), pa.string()), pa.array([b""] * len(words_of), pa.binary()),
                                              pa.array(list(words_of.values()), pa.int64())], names=["key", "occ", "lang", "phrase", "n"])
    return run, "key long, occ long, lang string, phrase binary, n long"


def _by_text(block, keys):
    """Occurrences of fingerprints in a table, counted by their texts."""
    def run(batches):
        for lang, s, words in _slices(batches, block):
            held = Counter()
            for n in range(1, MOST + 1):
                f, start, end, ok = s.sequences(n, words)
                rows = np.flatnonzero(ok & found(keys.value, f))
                held.update(zip(f[rows].view(np.int64).tolist(), (s.data[a:b] for a, b in zip(start[rows].tolist(), end[rows].tolist()))))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([lang] * len(held), pa.string()),
                                                  pa.array([t for _, t in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "lang", "phrase", "f"])
    return run, "key long, lang string, phrase binary, f long"


def counts(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, f): phrases of one to four words with ``least`` occurrences or more, and all words of a language as the phrase ''."""
    share = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.col("text").cast("binary"), F.coalesce("lang", F.lit("und")).alias("lang"))
    often = lambda made: texts.mapInArrow(*made).groupBy("key").agg(
        F.sum("n").alias("f"), F.min("occ").alias("occ"),
        (F.sum("c") != F.sum("n") * F.min("occ").bitwiseAND(F.lit(int(CHECK)))).alias("unlike")).where(F.col("f") >= least)
    short = stored(often(_fingerprints(block)), "fingerprints")
    long = often(_fingerprints(block, share(table_of(short))))
    frequent = stored(short.unionByName(long), "frequent")
    read = stored(texts.mapInArrow(*_texts(block, share(table_of(frequent, "occ")))), "phrase-texts")
    named = read.where("key is not null").select("key", "occ", "lang", "phrase").distinct().join(frequent.where("not unlike"), ["key", "occ"]).select("lang", "phrase", "f")
    words = read.where("key is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    unlike = frequent.where("unlike").select("key")
    if unlike.limit(1).count():
        again = texts.mapInArrow(*_by_text(block, share(table_of(unlike)))).join(unlike, "key", "left_semi")
        named = named.unionByName(again.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    return named.unionByName(words).withColumn("phrase", F.col("phrase").cast("string"))


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score. Writes intermediate tables when called."""
    known = stored(counts(docs, least, block), "phrases")
    size = F.size(F.split("phrase", " "))
    candidates = known.where(size > 1).select("lang", "phrase", F.col("f").alias("a"), size.alias("size"))
    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))) \
        .withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    part = lambda name, number: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(number))
    cut = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("(cast(2000000 as decimal(8, 0)) * a) div (l + r)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")) \
        .select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = candidates.where("size > 2").withColumn("w", F.split("phrase", " ")) \
        .withColumn("n", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("s", F.explode(F.expr("sequence(1, size - n + 1)"))) \
        .groupBy("lang", F.array_join(F.expr("slice(w, s, n)"), " ").alias("phrase")).agg(F.max("a").alias("within"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < cover * F.col("a"))).drop("within")
    best = ranked(kept, ["lang"], ["-score", "-a", "phrase"], "rank").where(F.col("rank") <= top)
    words = known.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
