"""Divergence audit and phrases against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recordqc.llm import divergence, phrases, rolling
from tests.llm.helpers import clashing, corpus, empty, odd_rows, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall(fold(text))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for x, _, w in docs if x == lang for t in set(w))
        kept = [t for t in seen if seen[t] >= least]
        groups = defaultdict(Counter)
        for x, source, w in docs:
            if x == lang:
                groups[source].update(t for t in w if seen[t] >= least)
        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s in p:
            pair = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in p if o != s))
            term = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(found)}
    return out


def documents():
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = prose(rng, rng.randint(0, 60)).split(" ") + rng.choices(["Été", "ÇA", "x-y", "日本", "A_b"], k=3)
        rows.append((" ".join(rng.choice([w, w.upper()]) for w in words), rng.choice(["en", "de", None, "x"][:3 if i else 4]), rng.choice(["a", "b", "c", "", None, "é", "z"])))
    return rows + [("only here", "one", "a"), (None, "one", "b"), (None, None, "quiet"), ("", "en", "quiet")]


@pytest.mark.parametrize("postings", [1 << 16, 40])
def test_audit_equals_plain_sums(spark, postings):
    rows = documents()
    docs = clashing(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string"), "value", "rank", "term", "item", "v")
    out = divergence.audit(docs, top=7, postings=postings)
    assert {tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()} == audit(rows, top=7)


def test_shares_by_long_division():
    for count, total in ((0, 1), (5, 7), (10 ** 14, 10 ** 14 + 3), (8 * 10 ** 15, 8 * 10 ** 15 + 1)):
        assert divergence.share(np.array([count]), np.array([total])).tolist() == [1 + 10 ** 9 * (count + 1) // total]


def test_audit_odd(spark):
    docs = odd_rows(spark)
    got = {tuple(r) for r in divergence.audit(docs).collect()}
    assert got == audit([(r.text, r.lang, r.source) for r in docs.collect()])
    assert divergence.audit(empty(spark)).count() == 0


def mined(rows, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang in f:
        c = f[lang]
        often = [p for p in c if len(p) > 1 and c[p] >= least]
        gone = {p[i:i + k] for p in often for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c[p] >= cover * c[p[i:i + k]]}
        rows = []
        for p in often:
            if p not in gone:
                score, k = min((2000000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}
    return out


def spoken():
    rng = random.Random(9)
    made = ["New York", "state of the art", "as well as", "per  cent", "été\tlong", "a a a a a"]
    rows = []
    for i in range(120):
        words = prose(rng, rng.randint(0, 80), ["ka", "lo", "mi", "re", "Tu"] + made).split(" ")
        rows.append(("".join(w + rng.choice([" ", " ", " ", ", ", "\n", "  "]) for w in words), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), ("\n\n. ,", "fr"), (" solo ", "fr")]


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_phrases_equal_plain_counts(spark, block):
    rows = spoken()
    docs = clashing(spark.createDataFrame(rows, "text string, lang string"), "a", "n", "phrase", "rank", "key")
    got = {tuple(r) for r in phrases.collocations(docs, 12, 80, 25, block).collect()}
    assert got == mined(rows, 12, 80, 25)


def test_phrases_with_a_full_table(spark, monkeypatch):
    """What a table lets through wrongly changes no count."""
    monkeypatch.setattr(phrases, "table_of", lambda keys, column="key": b"\xff" * (1 << 13))
    rows = spoken()
    got = {tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), 12, 80, 25).collect()}
    assert got == mined(rows, 12, 80, 25)


def test_phrases_with_shared_fingerprints(spark, monkeypatch):
    """Phrases that share fingerprints are counted by text."""
    made = phrases._fingerprints

    def colliding(block, pairs=None):
        run, schema = made(block, pairs)

        def shared(batches):
            import pyarrow.compute as pc
            for b in run(batches):
                odd = pc.equal(pc.bit_wise_and(b.column(0), 3), 1)
                yield b.set_column(3, "c", pc.if_else(odd, pc.add(b.column(3), 1), b.column(3)))
        return shared, schema

    monkeypatch.setattr(phrases, "_fingerprints", colliding)
    rows = spoken()
    got = {tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), 12, 80, 25, 500).collect()}
    assert got == mined(rows, 12, 80, 25)


def test_sums_keep_unlike_checks_apart():
    import numpy as np
    key, n, occ = (np.array(x) for x in ([7, 5, 7, 7], [1, 1, 2, 4], [9 << 12, 8 << 12, 3 << 12, (1 << 12) + 1]))
    assert [x.tolist() for x in phrases._summed([(key, n, occ)])] == [[5, 7, 7], [1, 3, 4], [8 << 12, 3 << 12, (1 << 12) + 1]]


def test_phrases_odd(spark):
    docs = odd_rows(spark)
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = {tuple(r) for r in phrases.collocations(docs, 3, 80, 50).collect()}
    assert got == mined(rows, 3, 80, 50)
    assert phrases.collocations(empty(spark)).count() == 0


def test_bit_table(spark):
    keys = [0, -1, 2 ** 62, -2 ** 63, 12345678901234567]
    table = rolling.table_of(spark.createDataFrame([(k,) for k in keys], "key long"), bits=20)
    assert len(table) == 1 << 17 and sum(bin(x).count("1") for x in table) == len({(k % 2 ** 64) >> 44 for k in keys})
    assert rolling.found(table, np.array(keys, np.int64)).all() and not rolling.found(table, np.array([2 ** 50], np.int64)).any()
