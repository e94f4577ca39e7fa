"""File expressions, collisions and backup matching against hand-made cases and brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recordqc.functions import files as X
from recordqc.operators import backups as B
from recordqc.operators import catalog as K


@pytest.mark.parametrize("name,want", [
    ("2024 1 5", "2024.01.05"), ("1-15-2024", "2024.01.15"), ("15.1.24", "2015.01.24"), ("1-2-99", "1999.01.02"), ("2024.02.30", "2024.02.30"),
    ("123 1 2", "2023.01.02"), ("3-4-5", "3-4-5"), ("Site", "Site"), (" 2024_12_31 ", "2024.12.31"), ("1850.01.01", "1850.01.01")])
def test_date_folder(spark, name, want):
    assert spark.range(1).select(X.date_folder(F.lit(name))).first()[0] == want


def test_natural_order(spark):
    names = ["img_010b", "IMG_10", "img_9", "IMG_2", "img_2000000000000000000000001"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").orderBy(X.natural_key(F.col("p")), "p").collect()
    assert [r.p for r in rows] == ["IMG_2", "img_9", "IMG_10", "img_010b", "img_2000000000000000000000001"]


@pytest.mark.parametrize("name,suffix,source", [
    ("Plan.dwg.bak", ".dwg.bak", "plan"), ("Site_backup.3dmbak", ".3dmbak", "site"), ("house.0012.rvt", ".####.rvt", "house"),
    ("poster recovered", "recovery", "poster"), ("Deck_autosave.pdf", "backup-name", "deck"), ("Deck.pdf", None, None)])
def test_backup_kinds(spark, name, suffix, source):
    f = spark.createDataFrame([(1, "Main/P/S/" + name, 1, 1)], "seq bigint, path string, size bigint, modified_ms bigint")
    r = K.enrich_files(f).first()
    assert (r.backup.suffix if r.backup else None) == suffix
    assert r.backup_source == source


def greedy(paths):
    used, out = set(), []
    for p in paths:
        pick, k = p, 2
        head, _, name = p.rpartition("/")
        dot = name.rfind(".")
        b, e = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        while pick.lower() in used:
            pick, k = f"{head}/{b}_duplicate-{k}{e}", k + 1
        used.add(pick.lower())
        out.append(pick)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_collisions_follow_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    names = ["o/a.pdf", "o/A.pdf", "o/a_duplicate-2.pdf", "o/a_duplicate-3.pdf", "o/b", "o/b_duplicate-2", "o/c.d.pdf", "p/a.pdf", "o/a_duplicate-2_duplicate-2.pdf"]
    names += ["o/a_Duplicate-5.pdf", "o/a_duplicate-9.pdf", "o/a_duplicate-02.pdf", "o/_duplicate-2.pdf", "o/.b", "o/.b_duplicate-2", "o/z_duplicate-4.pdf", "o/a.b_duplicate-2"]
    names += [f"o/a_duplicate-{k}.pdf" for k in range(12, 60, 3)] + ["o/a_duplicate-12_duplicate-3.pdf", "o/a_duplicate-2_duplicate-2_duplicate-2.pdf"]
    paths = [rnd.choice(names[:2] if rnd.random() < 0.5 else names) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(paths)), "seq bigint, base_path string")
    got = [r.new_path for r in K.resolve_collisions(df).orderBy("seq").collect()]
    assert got == greedy(paths)
    assert len({p.lower() for p in got}) == len(got)


def test_reserved_names_query(spark):
    got = entry.queries()["f19_reserved_names"](spark, "/root/testdata/sf0.001").orderBy("seq").collect()
    assert [r.new_path for r in got] == greedy([r.base_path for r in got])
    assert any("_duplicate-" in r.base_path for r in got) and any(r.new_path != r.base_path for r in got)


def test_missing_sequences(spark):
    df = spark.createDataFrame([("A101",), ("A104",), ("B1",), ("S001",), ("S003",), ("X",)], "sheet_number string")
    assert sorted(r.sheet_number for r in K.missing_sequences(df).collect()) == ["A102", "A103", "S002"]


def similar(a, b):
    if not a or not b:
        return False
    if a in b or b in a:
        return min(len(a), len(b)) >= 6
    at, bt = {t for t in a.split(" ") if len(t) > 2}, [t for t in b.split(" ") if len(t) > 2]
    if not at or not bt:
        return False
    return sum(t in at for t in bt) >= min(2, len(at), len(bt))


def brute(records):
    best = {}
    for b in records:
        if not b.backup:
            continue
        offers = []
        for p in records:
            if p.backup or p.extension not in X.ORIGINALS or not p.normalized_base:
                continue
            if b.backup.primary and p.extension != b.backup.primary:
                continue
            if not (b.folder_path == p.folder_path or b.parent_name == p.parent_name or b.signal or p.signal):
                continue
            exact, sim = b.normalized_base == p.normalized_base, similar(b.normalized_base, p.normalized_base)
            older = not b.modified_ms or not p.modified_ms or b.modified_ms <= p.modified_ms or b.signal
            if not (exact or sim) or not (older or exact):
                continue
            score = 80 * exact + 30 * sim + 20 + 15 * (b.folder_path == p.folder_path) + 8 * (b.parent_name == p.parent_name) + 8 * older
            offers.append((-score, -p.modified_ms, p.seq, p.path))
        if offers:
            best[b.path] = (min(offers)[3], -min(offers)[0])
    return best


def test_backup_matching_equals_brute_force(spark):
    rnd = random.Random(11)
    words = ["plan", "roof", "abc", "ab", "site", "level", "core", "x", "floor", "abc d"]
    folders = ["Main/P1/S", "Main/P1/T", "Main/P2/S", "Main/P2/archive", "Main/P3/S"]
    rows = []
    for i, folder in enumerate(itertools.chain.from_iterable(itertools.repeat(folders, 60))):
        base = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 3])))
        ext = rnd.choice(["dwg", "pdf", "dwg.bak", "bak", "tmp", "skp", "skb"])
        rows.append((i, f"{folder}/{base} {'' if rnd.random() < .5 else i}.{ext}".replace(" .", "."), rnd.randrange(3) * 500, rnd.choice([0, 1000, 5000, 9000, 20000])))
    rows = list({r[1]: r for r in rows}.values())
    rec = B.catalog_records(spark.createDataFrame(rows, "seq bigint, path string, size bigint, modified_ms bigint"))
    got = {r.path: (r.original, r.score) for r in B.match_backups(rec).collect()}
    assert got == brute(rec.collect())
    assert len(got) > 50 and re.search("archive", str(got))
