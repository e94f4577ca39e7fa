"""Project blocks and issue imports against the sequential rules."""

import random

import pytest
from pyspark.sql import functions as F

from recordqc.operators import issues as I
from recordqc.operators.scale import running

ROWS = "workbook string, sheet string, row bigint, number string, mapped_number string, mapped_name string, is_total boolean, has_data boolean"


def test_changes_over_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), i, rng.choice([None, None, "x", "y", "z"])) for i in range(900)]
    got = {(r.k, r.i): r.n for r in running(spark.createDataFrame(rows, "k string, i bigint, v string"), ["k"], ["i"], n=("changes", "v")).collect()}
    state = {}
    for k, i, v in rows:
        last, n = state.get(k, (None, 0))
        if v is not None and v != last:
            last, n = v, n + 1
        state[k] = last, n
        assert got[k, i] == n


def sequential(rows):
    """Blocks of one sheet, one row at a time."""
    strict = any(r[3] for r in rows)
    out, current, block = {}, None, 0
    for r in rows:
        ident = r[3] or (None if strict else (r[4] or r[5]))
        if ident and (current is None or current[0] != ident):
            carried = None
            if current and len(current[1]) >= 2:
                candidate, above = current[1][-1], current[1][-2]
                if above[6] and not (candidate[4] or candidate[5]) and candidate[7]:
                    carried = current[1].pop()
            block += 1
            current = (ident, [carried, r] if carried else [r])
            if carried:
                out[carried[2]] = (ident, block, True, False)
            out[r[2]] = (ident, block, False, False)
        elif current:
            current[1].append(r)
            out[r[2]] = (current[0], block, False, False)
        else:
            out[r[2]] = (None, 0, False, True)
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7])
def test_project_blocks(spark, share):
    rng = random.Random(share)
    rows = []
    for sheet in range(12):
        loose = sheet % 4 == 3
        for i in range(200 if sheet == 0 else 40):
            number = rng.choice(["P1", "P2", "P3"]) if rng.random() < share and not loose else None
            rows.append(("w", f"s{sheet}", i, number, number if number and rng.random() < 0.5 else "", rng.choice([None, None, None, "Name"]), rng.random() < 0.5, rng.random() < 0.7))
    got = I.project_blocks(spark.createDataFrame(rows, ROWS)).collect()
    for sheet in range(12):
        want = sequential([r for r in rows if r[1] == f"s{sheet}"])
        assert {r.row: (r.project, r.block, r.carried, r.orphan) for r in got if r.sheet == f"s{sheet}"} == want


def test_project_blocks_odd(spark):
    one = spark.createDataFrame([("w", "s", 1, None, None, None, None, None)], ROWS)
    row, = I.project_blocks(one).collect()
    assert (row.project, row.block, row.carried, row.orphan) == (None, 0, False, True)
    assert I.project_blocks(one.limit(0)).count() == 0


ISSUE = "seq bigint, project_id string, project_number string, discipline string, category string, message string"
TALK = "panel schedule missing value check again unit roof duct total load of a".split()


def tokens(message):
    import re
    return {t for t in re.sub("[^a-z0-9 ]", " ", (message or "").lower()).split() if len(t) > 2}


def alike(a, b):
    place = (a[1] and a[1] == b[1]) or (a[2] and b[2] and a[2].lower() == b[2].lower())
    if not place or (a[3] or "") != (b[3] or ""):
        return False
    if (a[4] or "") == (b[4] or "") and (a[5] or "").lower() == (b[5] or "").lower():
        return True
    x, y = tokens(a[5]), tokens(b[5])
    return bool(x and y) and len(x & y) / max(len(x), len(y)) >= 0.65


def one_by_one(existing, incoming):
    stored, out = [("stored", r) for r in existing], {}
    for r in incoming:
        hit = next(((side, s[0]) for side, s in stored if alike(s, r)), None)
        out[r[0]] = ("skip", *hit) if hit else ("import", None, None)
        if not hit:
            stored.append(("imported", r))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_import_equals_the_sequential_rule(spark, seed):
    from recordqc.operators.imports import import_issues
    rng = random.Random(seed)

    def issue(i):
        words = [rng.choice(TALK) for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 8]))]
        return (i, rng.choice(["1", "1", "1", "2", None]), rng.choice(["N-1", "n-1", "N-2", "", None]), rng.choice(["M", "M", "E", None]), rng.choice(["c", "d"]), rng.choice([" ", ", "]).join(words) or rng.choice(["", "?", None, "of a"]))
    existing, incoming = [issue(i) for i in range(40)], [issue(i) for i in range(260)]
    got = import_issues(spark.createDataFrame(existing, ISSUE), spark.createDataFrame(incoming, ISSUE)).collect()
    assert {r.seq: (r.action, r.duplicate_side, r.duplicate_seq) for r in got} == one_by_one(existing, incoming)


def test_import_actions_and_projects(spark):
    from recordqc.operators.imports import attach_projects, import_issues
    rows = spark.createDataFrame([(1, None, "N-1", "M", "c", "panel missing value"), (2, None, None, "M", "c", "panel missing value")], ISSUE).withColumn("project_name", F.lit("Tower"))
    projects = spark.createDataFrame([(1, "7", "N-1", "Other"), (2, "8", "N-9", "Tower")], "seq bigint, project_id string, project_number string, project_name string")
    attached = attach_projects(rows, projects)
    assert sorted((r.seq, r.project_id, r.project_number) for r in attached.collect()) == [(1, "7", "N-1"), (2, "8", "N-9")]
    twice = spark.createDataFrame([(1, "7", "", "M", "c", "panel missing value"), (2, "7", None, "M", "d", "Panel: missing value")], ISSUE)
    none = twice.limit(0)
    assert [r.action for r in import_issues(none, twice, "keep").collect()] == ["import", "import"]
    assert sorted((r.seq, r.action, r.duplicate_side, r.duplicate_seq) for r in import_issues(none, twice, "merge").collect()) == [(1, "import", None, None), (2, "merge", "imported", 1)]
    assert import_issues(twice, none).count() == 0


def test_pairs_of_one_key_repeat_no_text_work(spark):
    """Every pair of records with one key is compared: what a value needs (trimming, lower case, blanks) is done below the join."""
    from recordqc.operators import issues as I
    ddl = "project_number string, project_name string, building_type string, consultant string, square_feet double"
    saved = spark.createDataFrame([("1-1", " Hall", "Lab", "Unknown", 5.0), ("1-1", "HALL ", None, "x", None), ("2", "a", "b", "c", 1.0), (None, "n", "", None, None)], ddl)
    new = spark.createDataFrame([(" 1 - 1", "hall", "lab2", "X", 6.0), ("3", "d", "e", "f", 2.0), ("", "N ", "z", "y", 3.0)], ddl)
    clash = I.project_conflicts(saved, new)
    assert sorted((r.pkey, r.field, r.saved, r.incoming) for r in clash.collect()) == [("number:1-1", "building_type", "Lab", "lab2"), ("number:1-1", "square_feet", "5.0", "6.0")]
    want = {"merge": [("added", "d", "e", "f", 2.0), ("kept", "a", "b", "c", 1.0), ("merged", " Hall", "Lab", "X", 5.0), ("merged", "HALL ", "lab2", "x", 6.0), ("merged", "n", "z", "y", 3.0)],
            "replace": [("added", "d", "e", "f", 2.0), ("kept", "a", "b", "c", 1.0), ("replaced", "N ", "z", "y", 3.0), ("replaced", "hall", "lab2", "X", 6.0), ("replaced", "hall", "lab2", "X", 6.0)],
            "skip": [("added", "d", "e", "f", 2.0), ("kept", "a", "b", "c", 1.0), ("skipped", " Hall", "Lab", "Unknown", 5.0), ("skipped", "HALL ", None, "x", None), ("skipped", "n", "", None, None)]}
    for mode, rows in want.items():
        out = I.commit_import(saved, new, mode)
        assert sorted(((r.outcome, r.project_name, r.building_type, r.consultant, r.square_feet) for r in out.collect()), key=str) == sorted(rows, key=str)
        assert "trim(" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    plan = clash._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lower(" in line for line in plan.splitlines() if "Join" in line)
