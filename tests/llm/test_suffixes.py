"""Suffix-array dedup against a plain count of all strings."""

import random
from collections import Counter

import pytest

from recordqc.llm import suffixes
from tests.llm.helpers import clashing, corpus, empty, odd_rows, prose


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    starts = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), runs, bytes(x for x, h in zip(t, hit) if not h)))
    return out


def texts():
    rng = random.Random(3)
    shared = [prose(rng, 40) for _ in range(4)]
    out = []
    for i in range(80):
        words = prose(rng, rng.randint(0, 120)).split(" ")
        if i % 3 == 0:
            words.insert(rng.randint(0, len(words)), shared[rng.randint(0, 3)])
        if i % 4 == 1 and out:
            words = out[rng.randint(0, len(out) - 1)].split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randint(0, len(words) - 1)] = "änders"
        out.append(" ".join(words))
    same = prose(rng, 60)
    return out + [same, same, "x" * 900, "ab" * 300, prose(rng, 30) * 3, "", None, "é" * 150, same[:150]] + [prose(rng, 20) + shared[0] + prose(rng, 20) for _ in range(30)]


@pytest.mark.parametrize("length, anchor, hot, block", [(200, 64, 2000, 1 << 20), (60, 20, 3, 1 << 20), (40, 16, 2000, 128)])
def test_equals_plain_count(spark, length, anchor, hot, block):
    docs = corpus(spark, texts())
    want = plain(texts(), length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(docs, length, anchor, hot, block).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_ranks_of_growing_strings():
    import numpy as np
    a, b, c = b"0123456789abcdefghijXYZ", b"--0123456789abcdefghij-", b"0123456789abcdefghiJ..."
    assert suffixes.repeated_starts(np.array([0, 0, 0]), [a, b, c], 20).tolist() == [0, 25]
    assert suffixes.repeated_starts(np.array([0, 1, 0]), [a, b, c], 20).tolist() == []
    assert suffixes.repeated_starts(np.array([5]), [b"a" * 40], 20).tolist() == list(range(21))


def test_odd(spark):
    docs = clashing(odd_rows(spark), "kept", "spans", "place", "bytes", "d", "e")
    out = suffixes.dedup(docs)
    assert set(out.columns) == set(docs.columns) | set(suffixes.ADDED)
    rows = sorted(out.collect(), key=str)
    assert len(rows) == docs.count() and all(r.place == "mine" for r in rows)
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id in (5, 6, 7, 8)} == {5: rows[0].n_bytes if rows[0].doc_id == 5 else max(r.n_bytes for r in rows if r.doc_id == 5),
                                                                                 6: max(r.n_bytes for r in rows if r.doc_id == 6), 7: 50_000, 8: 0}
    assert suffixes.dedup(empty(spark)).count() == 0


def test_a_task_holds_little_beside_its_texts():
    """Peak of a fresh process over 8,000 texts of 4,000 bytes in Arrow batches of 1,000; hashing larger blocks took over 150 MB more than its start."""
    import subprocess
    import sys
    code = """
import random, resource
import numpy as np, pyarrow as pa
from recordqc.llm import suffixes as S
rng = np.random.default_rng(1)
class Table: value = bytes(1 << 24)
def batches(n):
    for _ in range(n):
        yield pa.RecordBatch.from_arrays([pa.array([rng.integers(97, 123, 4000, dtype=np.uint8).tobytes() for _ in range(1000)])], names=["text"])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
for _ in batches(2): pass
before = peak()
for run, _ in (S._anchors(200, 64, S.BLOCK), S._shared_segments(200, 64, S.BLOCK, Table), S._unsettled(200, 64, S.BLOCK, Table, None)):
    for _ in run(batches(8)): pass
print(peak() - before)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 80


def test_batches_are_small_only_while_the_jobs_run(spark):
    from recordqc.llm.common import small_batches
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    rows = lambda: max(r.n for r in spark.range(0, 5000, 1, 1).mapInPandas(lambda parts: ([p.head(1).assign(n=len(p))[["n"]] for p in parts]), "n long").collect())
    with pytest.raises(KeyError), small_batches(spark):
        assert rows() == 1000
        raise KeyError
    assert spark.conf.get(name) == own and rows() == 5000
