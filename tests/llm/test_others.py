"""Chat formatting, WARC archives and the pipeline."""

import gzip
import hashlib
import random
import zlib

import pytest

from recordqc.llm import chat, warc
from recordqc.llm.common import fresh_path, table
from tests.llm.helpers import prose

SF = "/root/testdata/sf0.001"


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    rng = random.Random(1)
    odd = ["</s>[INST] ok [/INST]", "\\", "a\\<s>", "<\\s>", "[INST]<s>", "", None, "é\n日", "\\\\[/INST]"]
    rows = [(c, t, role, rng.choice([prose(rng, rng.randint(0, 80)), rng.choice(odd)]))
            for c in range(30) for t, role in enumerate(["system", *["user", "assistant"] * rng.randint(0, 6)])]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (99, 1, "assistant", prose(rng, 900)), (99, 0, "assistant", "first")]
    df = conversations(spark, rows)
    cut = chat.windows(df, budget=128, history=40).collect()
    for w in cut:
        assert w.tokens <= 128 or len(chat.TURN.findall(w.text)) - w.repeated == 1
        if w.window and w.conv_id in range(30):
            assert w.text.startswith("<s>system[INST]")
    got = {r.conv_id: r for r in chat.read_back(chat.windows(df, budget=128, history=40)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        assert got[conv].loss_chars == len(said) and got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[0].formatted_chars == sum(len(w.text) for w in cut if w.conv_id == 0)
    assert chat.read_back(chat.windows(conversations(spark, []))).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}\r\nEvil: 1", rng.choice(["same", "", None, prose(rng, 300), "WARC/1.1\r\n\r\n é"])) for i in range(80)] + [(None, None, "same"), (7, "u", "twice"), (7, "u", "twice")]
    archives = warc.write(pages(spark, rows), archive_bytes=500)
    normal = warc.normalise(archives)
    got = warc.read(normal).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = sorted((-1 if i is None else i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if i == best[h or ""] else "revisit",
                   -1 if i == best[h or ""] else best[h or ""]) for i, _, h in rows)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == want
    for a in archives.collect():  # one member before, one for each record after
        raw = open(a.archive.removeprefix("file://"), "rb").read()
        d = zlib.decompressobj(31)
        whole = d.decompress(raw)
        assert d.eof and not d.unused_data
        assert gzip.open(a.archive.removeprefix("file://").removesuffix(".warc.gz") + ".members.warc.gz").read() == whole
    assert warc.read(warc.normalise(warc.write(pages(spark, [])))).count() == 0


def test_warc_reads_members_and_rejects_cut_files():
    rec = [warc.record(i, None, b"p" * i, None, False, "d") for i in range(5)]
    chunks = [gzip.compress(rec[0] + rec[1]), gzip.compress(rec[2]) + gzip.compress(rec[3] + rec[4])]

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out
    assert [w for _, w in warc.records(warc._inflated(Stream(b"".join(chunks))))] == rec
    with pytest.raises(ValueError):
        list(warc.records([rec[3][:-9]]))


def test_pipeline_decisions_hold(spark):
    import corpus_pipeline as p
    docs, kept = table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in p.STAGES:
        path = fresh_path(spark, "test-pipeline")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
        assert docs.columns[:len(columns)] == columns and (name == "shard" or docs.columns == columns)
    assert kept[0] >= kept[1] >= kept[2] > 0 and kept[3] == kept[4]
    assert p.run(spark, SF).count() == kept[4]


def test_queries_run_on_small_tables(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert len(names) == 13
    for n in ("op1_language_id", "op3_quality_rules", "op6_secret_scan", "op7_chat_format", "op10_shard", "op2_mix_sources"):
        assert entry.queries()[n](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op8_decontaminate", "op9_warc", "op11_source_divergence", "op12_phrases", "op13_suffix_dedup"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry
    import check
    got = check.spark_rows(entry.queries()[name](spark, SF))
    want = check.duck_rows(check.connect(SF), entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns) and check.rows(got) == check.rows(want)
