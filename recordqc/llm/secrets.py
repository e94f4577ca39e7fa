"""Secret scans: rules, and character Markov models that tell random strings from ordinary text.

The rules (``assign``, ``access``, ``hex``) label the samples: characters inside
their matches are random, all others of the same texts are ordinary. Two
first-order models over 68 symbols (letters, digits, ``+ / _ - = .`` as one
mark each, everything else as one) are counted from all texts, with counts
combined before the shuffle; what reaches the driver is two tables of 68 x 68
counts. A candidate is a run of ``[A-Za-z0-9+/_=-]`` with ``least`` characters
or more outside rule matches. It is a ``markov`` span if its log-likelihood
ratio is at least ``per_char`` for each character.

Null texts are empty and have no spans. Repeated rows are scanned each. With no
labelled sample the random model is uniform, by its prior. An empty table gives
an empty result. Extra columns pass through; columns named like the result's are
replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from recordqc.llm.common import map_batches, texts_of

KINDS = ["assign", "access", "hex", "markov"]
_any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters and more
HEX = re.compile(r"[0-9a-f]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1
_CODE = np.full(256, SIZE - 1, np.uint16)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(SIZE - 1)


def base_spans(text: str) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(start, kind, end, span of the secret) of rule matches, sorted."""
    low = text.lower()
    found = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end(), m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.span()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.span()) for m in HEX.finditer(text)]
    return sorted(found)


def _pairs(text: str) -> np.ndarray:
    """Symbol pairs of a text; characters beyond ASCII are one ``other`` symbol for each of their bytes."""
    codes = _CODE[np.frombuffer(text.encode(), np.uint8)]
    return codes[:-1].astype(np.int64) * SIZE + codes[1:]


def train(docs: DataFrame, run: re.Pattern) -> np.ndarray:
    """Counts of symbol pairs [2, SIZE, SIZE] over all texts: ordinary, random. Candidates (``run``) that no rule labels are in neither."""
    def made(batches):
        import pyarrow as pa
        counts = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            texts = texts_of(batch)
            counts[0] += np.bincount(_pairs("\n".join(texts)), minlength=SIZE * SIZE)
            inside, unlabelled = [], []
            for text in texts:
                end, base = 0, base_spans(text)
                unlabelled += [m.group() for m in run.finditer(text) if not any(b[0] < m.end() and b[2] > m.start() for b in base)]
                for start, stop in sorted(s for *_, s in base):
                    if start >= end:
                        inside.append(text[start:stop])
                    elif stop > end:
                        inside.append(text[end:stop])
                    end = max(end, stop)
            for s in inside:
                counts[1] += np.bincount(_pairs(s), minlength=SIZE * SIZE)
            for s in unlabelled:
                counts[0] -= np.bincount(_pairs(s), minlength=SIZE * SIZE)
        counts[0] -= counts[1]
        model, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(pair), pa.array(counts[model, pair])], names=["model", "pair", "n"])

    rows = docs.select("text").mapInArrow(made, "model long, pair long, n long").groupBy("model", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIZE * SIZE))
    for r in rows:  # at most 2 x SIZE x SIZE rows, whatever the table
        counts[r.model, r.pair] = r.n
    return np.maximum(counts.reshape(2, SIZE, SIZE), 0)


def ratios(counts: np.ndarray, prior: float = 200.0) -> np.ndarray:
    """Log-likelihood ratio random : ordinary of each pair.

    The random model's prior is uniform over the alphabet with ``prior`` samples a symbol, so that kinds of
    random strings that no rule labels stay likely; the ordinary model's are its symbols' own frequencies.
    """
    random = counts[1] + prior / SIZE
    mixed = (random.sum(0, keepdims=True) + prior) / (random.sum() + prior * SIZE)  # symbols alone, for contexts never seen
    random = 0.5 * random / random.sum(1, keepdims=True) + 0.5 * (0.5 * mixed + 0.5 / SIZE)
    alone = (counts[0].sum(0) + 1.0) / (counts[0].sum() + SIZE)  # for contexts that ordinary text hardly has
    plain = counts[0] + 50.0 * alone
    plain /= plain.sum(1, keepdims=True)
    marks, other = [ALPHABET.index(c) for c in "+/_=-."], SIZE - 1
    upper, lower = slice(0, 26), slice(26, 52)  # identifiers join ordinary words by marks or by case
    plain[:, marks] = np.maximum(plain[:, marks], plain[:, [other]] / 2)
    plain[marks] = np.maximum(plain[marks], plain[other])
    plain[lower, upper] = np.maximum(plain[lower, upper], plain[lower, [other]] * plain[other, upper])
    return np.log(random) - np.log(plain)


def random_parts(run: str, table: np.ndarray, least: int, per_char: float) -> list[tuple[int, int]]:
    """Stretches of a run that look random: all of it, or else those of largest score above ``per_char`` a character.

    A stretch has ``least`` characters or more and reaches to the next mark on either side; what is left and right of it is judged again.
    """
    found, open_ = [], [(0, len(run))]
    while open_:
        at, end = open_.pop()
        if end - at < least:
            continue
        codes = _CODE[np.frombuffer(run[at:end].encode(), np.uint8)]
        scores = table[codes[:-1], codes[1:]]
        if scores.sum() >= per_char * (end - at):
            found.append((at, end))
            continue
        total = np.concatenate(([0.0], np.cumsum(scores - per_char)))  # total[j] - total[i]: pairs of the characters i to j
        low = np.minimum.accumulate(total[:len(total) - least + 1])
        gain = total[least - 1:] - low
        j = int(np.argmax(gain))
        if gain[j] < per_char:
            continue
        begin, stop = at + int(np.argmin(total[:j + 1])), at + j + least
        while begin > at and run[begin - 1].isalnum():
            begin -= 1
        while stop < end and run[stop].isalnum():
            stop += 1
        found.append((begin, stop))
        open_ += [(at, begin), (stop, end)]
    return sorted(found)


def scan(docs: DataFrame, least: int = 20, per_char: float = 1.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_assign, n_access, n_hex, n_markov, base_list, span_list`` (kind:start:end strings, end exclusive)."""
    run = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % least)
    table = ratios(train(docs, run))
    fields = [("n_assign", LongType()), ("n_access", LongType()), ("n_hex", LongType()), ("n_markov", LongType()),
              ("base_list", ArrayType(StringType())), ("span_list", ArrayType(StringType()))]

    def made(batch):
        out = [[] for _ in fields]
        for text in texts_of(batch):
            base = base_spans(text)
            spans = [(s, k, e) for s, k, e, _ in base]
            taken = sorted((s, e) for s, _, e in spans)
            more = []
            for m in run.finditer(text):
                at = m.start()
                for s, e in [*(t for t in taken if t[0] < m.end() and t[1] > m.start()), (m.end(), m.end())]:
                    more += [(at + b, 3, at + e2) for b, e2 in random_parts(text[at:s], table, least, per_char)]
                    at = max(at, e)
            kinds = [k for _, k, _ in spans]
            for k in range(3):
                out[k].append(kinds.count(k))
            out[3].append(len(more))
            out[4].append([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])
            out[5].append([f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans + more)])
        return out

    docs = docs.drop(*[n for n, _ in fields])
    return map_batches(docs, made, fields, [c for c in docs.columns if keep_text or c != "text"])
