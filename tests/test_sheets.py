"""Index and page comparisons on small hand-made sets."""

import pytest

from pyspark.sql import functions as F

from recordqc.functions import sheets as X
from recordqc.operators import sheets as S
from recordqc.operators.issues import sync_issues
from recordqc.operators.precedents import canonicalize
from recordqc.streaming import flows as T

INDEX = "set_id bigint, index_position bigint, sheet_number string, sheet_name string"
PHYS = "set_id bigint, page_number bigint, sheet_number string"


def pair(spark, index, physical):
    i = spark.createDataFrame([(1, n, s, s) for n, s in enumerate(index, 1)], INDEX)
    p = spark.createDataFrame([(1, n, s) for n, s in enumerate(physical, 1)], PHYS)
    return i, p


@pytest.mark.parametrize("index,physical,sequence,presence,kinds", [
    (["G001", "A101", "A201"], ["G001", "A101", "A201"], "Pass", "Pass", []),
    (["G001", "A101", "A201"], ["G001", "A201", "A101"], "Fail", "Pass", []),
    (["G001", "A101", "A201"], ["G001", "A301"], "Pass", "Fail", ["extra", "missing", "missing"]),
    (["G001", "A101"], ["G-001", "A999", "A101"], "Pass", "Fail", ["extra"]),
    (["G001", "A101"], ["G001", "G001", "A101"], "Pass", "Fail", ["duplicate"]),
    (["G001", "A101"], ["G001", "", "A101"], "Pass", "Fail", ["unnumbered"])])
def test_index_against_pages(spark, index, physical, sequence, presence, kinds):
    i, p = pair(spark, index, physical)
    assert S.sequence_status(i, p).first().status == sequence
    assert S.presence_status(i, p).first().status == presence
    assert sorted(r.kind for r in S.compare_presence(i, p).collect()) == kinds


def test_repeated_keynote_text(spark):
    text = "7 FLOOR PLAN NTS\nSHEET KEYNOTES\n1. Paint wall (typ)\n2) Door as scheduled\n3: PAINT  WALL\n4. Door as scheduled\nGENERAL NOTES\n9. Paint wall"
    pages = spark.createDataFrame([("s", 1, text)], "set_id string, page_number bigint, text string")
    assert [(r.norm, r.numbers, r.first_number) for r in S.duplicate_keynotes(pages).collect()] == [("PAINT WALL", 2, 1)]
    assert [(r.detail, r.label, r.scale) for r in S.viewports(pages).collect()] == [("7", "FLOOR PLAN", "NTS")]


PAGE = "set_id string, page_number bigint, sheet_number string, title_block_text string, sheet_title string, seal_present boolean, graphic_present boolean, text string"
LEGEND = "SHEET KEYNOTES 1. GYPSUM BOARD 2. RESISTANT PANEL 3. BATTEN STRIP"


@pytest.mark.parametrize("text,graphic,status", [
    ("2 3 ENLARGED FLOOR PLAN 1/4\" = 1'-0\" " + LEGEND, False, "Pass"),
    ("FLOOR PLAN 1/4\" = 1'-0\" " + LEGEND, False, "Fail"),
    ("FLOOR PLAN " + LEGEND, True, "Pass"),
    (LEGEND + " WALL 1 2 3 DOOR 1 2 3 BASE 1 2 3", False, "Pass"),
    ("FLOOR PLAN\nSHEET KEYNOTES\n1. TBD\n2. SAMPLE\n", False, "Not Applicable")])
def test_keynote_verdicts(spark, text, graphic, status):
    page = spark.createDataFrame([("s", 1, "A1", "", "", False, graphic, text)], PAGE)
    assert [r.status for r in S.keynote_compliance(page).collect()] == [status]


def test_long_legends_and_many_findings_are_read_whole(spark):
    text = "SHEET KEYNOTES\n" + "\n".join(f"{n}. WALL TYPE NUMBER {n} WITH A LONG NAME" for n in range(1, 121))
    page = spark.createDataFrame([("s", 1, "", "", "", False, False, text), ("s", 2, "", "", "", False, False, "TBD")], PAGE)
    assert S.keynote_entries(page).count() == 120 and len(text) > 1800
    found = {r.category for r in S.document_rules(page).collect()}
    assert len(found) > 10 and "Missing or incorrect issue date" in found


def test_presence_has_three_states(spark):
    pages = spark.createDataFrame([("flag", 1, "", "", "", True, False, ""), ("word", 1, "", "", "", False, False, "SIGNED"), ("text", 1, "", "", "", False, False, "WALL"),
                                   ("none", 1, "", "", "", False, False, " ")], PAGE)
    assert {r.set_id: r.seal for r in S.presence_checks(pages).collect()} == {"flag": "Present", "word": "Present", "text": "Missing", "none": "Not Detected"}


def test_firm_names_are_a_parameter():
    assert dict(X.keywords(("ACME",)))["firm_logo_name"].endswith("ACME)\\b") and len(X.KEYWORDS) == 35


def test_spelling_offsets_and_custom_words(spark):
    pages = spark.createDataFrame([("s", 1, "A1", "We accomodate it. Seperation of accomodate waterproofng")],
                                  "set_id string, page_number bigint, sheet_number string, text string")
    got = {(r.word, r.suggestion, r.start) for r in S.spell_check(pages, ["waterproofng"]).collect()}
    assert got == {("accomodate", "accommodate", 3), ("Seperation", "separation", 18)}


def test_similar_references_over_several_blocks(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<float>")
    got = {(r.vec_id, r["rank"]): r.ref_id for r in S.similar_references(df.where("vec_id < 10"), df.where("vec_id >= 10"), 3, block_rows=7).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for q in range(10):
        order = np.argsort(-(unit[10:] @ unit[q]))[:3] + 10
        assert [got[q, r] for r in (1, 2, 3)] == list(order)


def test_similar_references_asks_for_every_vector(spark, tmp_path):
    """Each vector against all others, with ties, a missing vector and an id that comes twice, beside the query's SQL."""
    import check
    import duckdb
    import numpy as np

    import __spark_entry__ as entry
    rng = np.random.default_rng(6)
    vecs = [[float(x) for x in v] for v in rng.normal(size=(150, 4)).astype("float32")]
    vecs[7] = vecs[8] = vecs[90]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(3, vecs[20]), (150, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = check.rows(check.duck_rows(con, entry.oracle_sql()["s25_similar_references"]))
    got = entry.queries()["s25_similar_references"](spark, str(tmp_path))
    assert check.rows(check.spark_rows(got)) == want and len(want) == 3 * 151
    for block in (40, 90):
        assert check.rows(check.spark_rows(S.similar_references(df, df, block_rows=block).drop("cosine"))) == want


def test_sync_is_idempotent(spark):
    ddl = "project_id bigint, discipline string, category string, message string, seq bigint, status string, auto boolean"
    old = spark.createDataFrame([(1, "M", "c", "gone", 1, "Unresolved", True), (1, "M", "c", "back", 2, "Resolved", True), (1, "M", "c", "hand", 3, "Unresolved", False)], ddl)
    found = spark.createDataFrame([(1, "M", "c", "back"), (1, "M", "c", "new")], "project_id bigint, discipline string, category string, message string")
    first = {r.message: (r.action, r.new_status) for r in sync_issues(old, found).collect()}
    assert first == {"gone": ("resolve", "Resolved"), "back": ("reopen", "Unresolved"), "new": ("insert", "Unresolved"), "hand": ("keep", "Unresolved")}
    again = spark.createDataFrame([(1, "M", "c", m, n, s, m != "hand") for n, (m, (_, s)) in enumerate(first.items())], ddl)
    assert {r.action for r in sync_issues(again, found).collect()} == {"keep"}


def test_first_spelling_names_the_consultant(spark):
    df = spark.createDataFrame([(1, 3, "DELTA engineers"), (2, 1, "delta engineers"), (3, 2, " Delta  Engineers"), (4, 4, "unknown"), (5, 5, "ABC mep"), (6, 6, None)],
                               "project_id bigint, seq bigint, consultant string")
    got = {r.project_id: r.canonical for r in canonicalize(df).collect()}
    assert got == {1: "Delta Engineers", 2: "Delta Engineers", 3: "Delta Engineers", 4: "Unknown", 5: "Abc MEP", 6: "Unknown"}


def test_snapshot_over_batches_equals_one_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in range(3):
        rows.where(f"event_id % 3 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema(T.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")))
    got = T.run_snapshot(T.catalog_arrivals(stream), ["path"], ["modified_us", "seq"], "parity")
    want = T.newest(T.catalog_arrivals(rows.withColumn("ts", F.col("ts").cast("timestamp"))), ["path"], ["modified_us", "seq"])
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in got.columns) for r in want.collect())


def test_one_edit_neighbours_equal_brute_force(spark):
    import random

    from recordqc.operators import spelling as SP
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    left, right = words[::2], words[1::2] + words[:20]

    def edits(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        made = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        made |= {a + c + b for a, b in cuts for c in "abc"} | {a + c + b[1:] for a, b in cuts if b for c in "abc"}
        return made - {w}

    want = {(w, k) for w in left for k in set(right) & edits(w)}
    frame = lambda ws: spark.createDataFrame([(w, 1) for w in sorted(set(ws))], "word string, n bigint")
    got = SP.within_one_edit(frame(left).select("word"), frame(right)).collect()
    assert len(got) == len({(r.word, r.near) for r in got}) and {(r.word, r.near) for r in got} == want and want


def test_spelling_against_a_dictionary(spark):
    from recordqc.operators import spelling as SP
    ddl = "set_id string, page_number bigint, doc_id bigint, sheet_number string, sheet_title string, title_block_text string, text string"
    text = ("the corridr wall and the corridr wall near doors, x-rated wall-door walls; accomodate a CORRI slab zzzzzz, corrdior " + "the wall and " * 8
            + "fire wals at the stiar. " + "and the " * 20)
    pages = spark.createDataFrame([("s", 1, 1, "A1", None, None, text), ("s", 1, 2, " ", None, "Zumthor", "zumthr and the wall"), ("s", 2, 3, None, None, "Zumthor", None),
                                   ("t", 1, 4, "B1", None, None, "zumthr"), ("t", 2, 5, "B2", None, "wal", ""), (None, 1, 6, "C", None, None, "corridr"), ("e", 1, 7, "C", None, None, None), ("p", 1, 8, "C", None, None, "call 555-123-4567 for corridr")], ddl)
    words = spark.createDataFrame([("the", 90), ("and", 80), ("wall", 20), ("corridor", 5), ("corridon", 5), ("door", 7), ("near", 3), ("slab", 3), ("fire", 3), ("stair", 3),
                                   ("stir", 9), ("call", 3), ("for", 9), ("walt", 1), (None, 3)], "word string, n int")
    rows = SP.spelling(pages, words, ["Acme"]).collect()
    got = sorted((r.set_id, r.sheet, r.word, r.suggestion, r.source, r.start) for r in rows)
    assert got == sorted([
        ("s", "A1", "corridr", "corridor", "dictionary", 4), ("s", "A1", "corridr", "corridor", "dictionary", text.index("corridr wall near")),
        ("s", "A1", "accomodate", "accommodate", "known_correction", text.index("accomodate")), ("s", "A1", "corrdior", "corridor", "dictionary", text.index("corrdior")),
        ("s", "A1", "wals", "wall", "dictionary", text.index("wals")), ("s", "A1", "stiar", "stir", "dictionary", text.index("stiar")),
        ("s", "Page 1", "zumthr", "zumthor", "dictionary", 0)])
    one = next(r for r in rows if r.word == "wals")
    assert one.context.startswith("...") and one.context.endswith("...") and "fire wals at the stiar." in one.context
    assert SP.spelling(pages.where("false"), words).count() == 0 and SP.spelling(pages, words.where("false"), ["zumthr"]).where("source = 'dictionary'").count() == 0


def test_streams_resume_and_close(spark, tmp_path):
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    put = lambda rows: spark.createDataFrame([(i, t, u, "view", v, "{}") for i, t, u, v in rows], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = lambda: T.event_stream(spark, str(tmp_path / "in"), "*.parquet")
    snapshot = lambda: {tuple(r) for r in T.run_snapshot(T.catalog_arrivals(events()), ["path"], ["modified_us", "seq"], "x", str(tmp_path / "snap")).select("path", "size", "seq").collect()}
    put([(1, at(1), 1, 1.0), (2, at(1, 30), 2, 2.0)])
    assert snapshot() == {("Main/u1/view", 100, 1), ("Main/u2/view", 200, 2)}
    assert snapshot() == {("Main/u1/view", 100, 1), ("Main/u2/view", 200, 2)}  # nothing new
    first = T.run_append(T.scan_progress(events()), "x", str(tmp_path / "open"))
    assert first.count() == 0  # the hour is not over
    put([(3, at(2), 1, 3.0), (4, at(0), 2, 9.0), (5, at(5), 3, 4.0)])
    assert snapshot() == {("Main/u1/view", 300, 3), ("Main/u2/view", 200, 2), ("Main/u3/view", 400, 5)}
    resumed = T.run_append(T.scan_progress(events()), "x", str(tmp_path / "open"))
    hours = lambda df: sorted((int(r.window_start) // 3600 % 24, r.files) for r in df.collect())
    base = hours(T.run_closed(events(), T.scan_progress, "x"))
    assert [n for _, n in base] == [1, 2, 1, 1] and base[-1][0] - base[0][0] == 5  # the last hour is there
    assert set(hours(resumed)) < set(base)
    sessions = T.run_closed(events(), T.session_expiry, "x").collect()
    assert sorted((r.user_id, r.actions) for r in sessions) == [(1, 2), (2, 2), (3, 1)]
    assert T.run_closed(events().where("false"), T.scan_progress, "x").count() == 0


def test_spelling_broadcasts_nothing(spark):
    """A dictionary of a few MB as a file is hundreds of MB of neighbourhoods, which the driver would collect."""
    from recordqc.operators import spelling as SP
    words = spark.createDataFrame([("foundation", 9), ("concrete", 5)], "word string, n long")
    near = SP.within_one_edit(spark.createDataFrame([("foundatoin",), ("concrte",)], "word string"), words)
    assert sorted((r.word, r.near) for r in near.collect()) == [("concrte", "concrete"), ("foundatoin", "foundation")]
    pages = spark.createDataFrame([("s", 1, 1, "A1", "", "", "the foundatoin is of concrte here")],
                                  "set_id string, page_number long, doc_id long, sheet_number string, sheet_title string, title_block_text string, text string")
    out = SP.spelling(pages, words)
    assert sorted(r.suggestion for r in out.collect()) == ["concrete", "foundation"]
    for df in (near, out):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
