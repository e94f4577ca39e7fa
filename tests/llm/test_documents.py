"""Operators on documents against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from recordqc.llm import decontam, langid, mixing, probminhash, quality, secrets, sharding, substring
from tests.llm.helpers import clashing, corpus, empty, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality rules

def base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_base_statistics(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 120), ["ka", "lo", "mi"] if i % 2 else ["ka|", "<lo>", "é日", "x#", "a\nb", "a\nb"]) for i in range(60)] + ["a a a a", "a b c\na b c\n\n \n", None, ""]
    got = quality.measure(corpus(spark, texts)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text), r.text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_quality_rejects_junk_and_keeps_prose(spark, tmp_path):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(60, 600)) for _ in range(300)] + [" ".join(w + "%%%" for w in prose(rng, 90).split()) for _ in range(15)]
    measured = quality.measure(clashing(corpus(spark, texts, sources=("a",)), "kept", "distance", "n_words"))
    measured.write.parquet(f"{tmp_path}/m")
    out = quality.judge(spark.read.parquet(f"{tmp_path}/m"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 315))
    assert "extra" in out.columns


@pytest.mark.parametrize("make", [odd_rows, empty])
def test_quality_odd(spark, make):
    docs = make(spark)
    out = quality.judge(quality.measure(docs)).collect()
    assert len(out) == docs.count()
    assert all(not r.kept for r in out if r.n_words < 50)


def test_quality_texts_without_words_beside_an_estimate(spark, tmp_path):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 600)) for _ in range(80)] + ["", None, " \n\t "]
    quality.measure(corpus(spark, texts, sources=("a",))).write.parquet(f"{tmp_path}/m")
    got = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{tmp_path}/m")).collect()}
    assert all(got[i].kept and got[i].distance is not None for i in range(80))
    assert all(not got[i].kept and got[i].distance is None for i in range(80, 83))


def test_chi_square():
    assert abs(quality.chi2_quantile(0.975, 5) - 12.8325) < 1e-3


# mixing

def water(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_targets_and_sizes(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 5, 40, 300])) for _ in range(900)]
    sources = ["a", "b", "c", None, "é", "tiny"] + ["a"] * 6
    docs = clashing(corpus(spark, texts, sources=sources), "taken", "size")
    out = mixing.mix(docs)
    rows = out.collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == len(WORD.findall(r.text))
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
    want = water(sizes)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert mine[0].source_size == sizes[s] and abs(mine[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) <= 300
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.repeated(out).count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("make", [odd_rows, empty])
def test_mixing_odd(spark, make):
    docs = make(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(r.taken == 0 for r in out if r.size == 0)


# near dedup

def pieces(text):
    w = (text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [pieces(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("qua que qui quo".split())
    return " ".join(w)


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    hub = prose(rng, 150)
    texts += [edited(rng, rng.choice(texts), rng.randint(0, 6)) for _ in range(60)] + [edited(rng, hub, rng.randint(1, 9)) for _ in range(70)] + ["", "  "]
    got = {r.doc_id: r.class_id for r in probminhash.classes(corpus(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))
    kept = probminhash.keep_one(clashing(corpus(spark, texts), "node"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and "extra" in kept.columns


def test_near_dedup_blocks_find_what_one_block_finds(spark):
    rng = random.Random(6)
    hub = prose(rng, 120)
    docs = corpus(spark, [edited(rng, hub, rng.randint(1, 12)) for _ in range(80)])
    facts = probminhash.banded(docs, 40, 7)
    texts = facts.select("node", "doc_id").join(docs, "doc_id").select("node", "text")
    placed = facts.select("node", "doc_id", "chars", F.posexplode("keys").alias("band", "key")).withColumn("root", F.col("node"))
    found = []
    for block in (1000, 17):
        links = probminhash._open_links(placed, facts, texts, 0.8, 40, 7, block=block)
        roots = probminhash.components(links)
        groups = defaultdict(set)
        for r in roots.collect():
            groups[r.root].add(r.node)
        found.append(sorted(map(sorted, groups.values())))
    assert found[0] == found[1] and found[0]


def repeating(rng, n, times):
    """A text and the same with one passage of its words repeated."""
    w = prose(rng, n).split()
    at = rng.randrange(n - 24)
    return " ".join(w), " ".join(w[:at] + w[at:at + 24] * times + w[at + 24:])


def test_registers_agree_as_sets_do_where_passages_repeat():
    rng = random.Random(21)
    pairs = [repeating(rng, 104, 10) for _ in range(20)]
    found = probminhash.signatures([t for p in pairs for t in p], 280)
    agree = (found[::2] == found[1::2]).mean()
    sets = [[pieces(t) for t in p] for p in pairs]
    assert abs(agree - sum(len(a & b) / len(a | b) for a, b in sets) / 20) < 0.02


def test_near_dedup_decides_pairs_with_repeats(spark):
    rng = random.Random(22)
    texts = [t for _ in range(30) for t in repeating(rng, 104, 10)]
    docs = corpus(spark, texts)
    facts = probminhash.banded(docs, 40, 7)
    stored = facts.select("node", "doc_id").join(docs, "doc_id").select("node", "text")
    placed = facts.select("node", "doc_id", "chars", F.posexplode("keys").alias("band", "key")).withColumn("root", F.col("node"))
    of = {r.node: r.doc_id for r in facts.collect()}
    for block in (1000, 9):
        found = {tuple(sorted((of[r.a], of[r.b]))) for r in probminhash._open_links(placed, facts, stored, 0.8, 40, 7, block=block).collect()}
        assert found == {(i, i + 1) for i in range(0, 60, 2)}


def test_near_dedup_first_common_band_is_of_the_keys(spark):
    """Band 0 has one unequal register whose byte is equal: the keys differ there, the texts meet in band 1 only."""
    text = prose(random.Random(23), 50)
    facts = spark.createDataFrame([(1, "a", 300, [1, 5, 7], bytearray(3)), (2, "b", 300, [2, 5, 8], bytearray(3))],
                                  "doc_id long, node string, chars int, keys array<long>, marks binary")
    texts = spark.createDataFrame([("a", text), ("b", text + " kaba")], "node string, text string")
    placed = facts.select("node", "doc_id", "chars", F.lit(1).alias("band"), F.lit(5).cast("long").alias("key"), F.col("node").alias("root"))
    assert [sorted(r) for r in probminhash._open_links(placed, facts, texts, 0.8, 3, 1).collect()] == [["a", "b"]]


def test_components_of_a_chain(spark):
    names = [f"n{i:03d}" for i in range(120)]
    links = spark.createDataFrame([*zip(names[:60], names[1:61]), *zip(names[70:100], names[71:101]), ("n070", "n070")], "a string, b string")
    roots = {r.node: r.root for r in probminhash.components(links).collect()}
    assert len({roots[n] for n in names[:61]}) == 1 and len({roots[n] for n in names[70:101]}) == 1 and roots["n000"] != roots["n070"]


def test_near_dedup_odd(spark):
    out = probminhash.classes(odd_rows(spark)).collect()
    assert len(out) == 10
    of = defaultdict(list)
    for r in out:
        of[r.doc_id].append(r.class_id)
    assert of[3] == [3, 3] and of[5] == of[6] == [5] and of[1] == [1] and of[2] == [2]
    assert sorted(r.doc_id for r in probminhash.keep_one(odd_rows(spark)).collect() if r.doc_id is not None) == [1, 2, 3, 5, 7, 8]
    assert probminhash.classes(empty(spark)).count() == 0 and probminhash.keep_one(empty(spark)).count() == 0


def test_near_dedup_keeps_classes_of_one_name_apart(spark):
    """Different texts under null ids, and under one id."""
    rng = random.Random(24)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (5, c), (6, c), (5, d), (7, d + " kaba")], "doc_id long, text string")
    kept = probminhash.keep_one(docs).collect()
    assert sorted(r.text for r in kept) == sorted([a, b, c, d]) and sorted(str(r.doc_id) for r in kept) == ["5", "5", "None", "None"]
    assert len({r.root for r in probminhash.classes(docs).collect()}) == 4


# substring dedup

def brute_kept(rows):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 12):
            g = tuple(w[i:i + 13])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < d:
                gone |= set(range(i, i + 13))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"shard_words": 40, "slice_bytes": 500}, {"heavy": 0}, {"heavy": 0, "shard_words": 40, "slice_bytes": 500}, {"heavy": 30}])
def test_substring_equals_brute_force(spark, limits):
    rng = random.Random(7)
    shared = [prose(rng, n) for n in (12, 13, 14, 20, 50, 200)]
    texts = []
    for i in range(150):
        texts.append(" ".join(rng.choice([prose(rng, rng.randint(0, 30)), rng.choice(shared), prose(rng, 8, ["ka", "lo"])]) for _ in range(rng.randint(0, 6))))
    texts += ["is so. " * rng.randint(40, 90) + prose(rng, i) for i in range(12)]
    texts += [texts[3], texts[9], shared[4], " ".join(shared[3].split()), prose(rng, 300, ["ka"])]
    got = substring.dedup(corpus(spark, texts).repartition(5), **limits).collect()
    assert sorted(map(tuple, got)) == brute_kept(list(enumerate(texts)))


def test_substring_heavy_anchors(spark):
    rng = random.Random(11)
    shared = prose(rng, 40)
    texts = [" ".join((prose(rng, 20), shared, prose(rng, 20))) for _ in range(200)] + [prose(rng, 400) for _ in range(200)]
    docs = corpus(spark, texts).repartition(4)
    few = substring._heavy_anchors(docs.select("text"), 200, 1 << 20)
    in_passage = set(substring._Runs([shared.encode().split()]).anchor.tolist())
    assert 0 < len(few) <= 200 and in_passage <= set(few.tolist())
    rows = substring.dedup(docs, heavy=200).collect()
    assert sorted(map(tuple, rows)) == brute_kept(list(enumerate(texts)))


def test_substring_odd(spark):
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.dedup(odd_rows(spark)).collect())
    assert (5, 6000, 0) in got and (6, 6000, 6000) in got and len(got) == 10
    assert substring.dedup(empty(spark)).count() == 0


# secrets

def test_secret_rules_and_models(spark):
    rng = random.Random(8)
    token = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(40))
    cases = [str.lower, str.title, str.upper, lambda t: t.replace(" ", " 1985 ")]  # ordinary text has all of them
    texts = [cases[i % 4](prose(rng, 400)) for i in range(40)] + [
        "é password = 'abcDEF123456=' x", "API_KEY:short", "tOkEn:\"aaaaaaaaaaaa\" AKIAABCDEFGHIJKLMN1 AKIASHORT", "0123456789abcdef 0123456789abcde", f"see {token} now",
        "ſecret=abcdefghijklmnop", "kaba_lone_miso_renti_tura_same kabaLoneMisoRentiTuraSameVelku --------------------------"]
    out = {r.doc_id: r for r in secrets.scan(clashing(corpus(spark, texts), "n_hex", "span_list")).collect()}
    assert out[40].base_list == ["assign:2:27"] and out[41].base_list == [] and out[42].base_list == ["assign:0:19", "access:21:40"]
    assert out[43].base_list == ["hex:0:16"] and out[44].span_list == ["markov:4:44"] and out[45].base_list == [] and out[46].n_markov == 0
    assert all(out[i].span_list == [] for i in range(40))


def test_secrets_odd(spark):
    assert secrets.scan(odd_rows(spark)).count() == 10 and secrets.scan(empty(spark)).count() == 0


# language ID

def test_forward_sums_all_segmentations():
    import numpy as np
    vocab = ["▁", "▁a", "a", "b", "ab", "▁ab", "abc"]
    pieces = langid.Pieces(vocab)
    p = np.random.RandomState(0).rand(len(vocab) + 1, 2) / 10

    def total(s, lang):
        if not s:
            return 1.0
        out = sum(p[vocab.index(s[:k]), lang] * total(s[k:], lang) for k in range(1, len(s) + 1) if s[:k] in vocab)
        return out + (p[-1, lang] * total(s[1:], lang) if s[0] not in vocab else 0.0)
    for word in ("a", "abc", "abcabcabz", "zzzz" * 5):
        got = langid.forward(pieces.lattice([word]), p)[0]
        assert np.allclose(got, [np.log(total("▁" + word, k)) for k in range(2)])


def test_language_held_out_accuracy(spark):
    rng = random.Random(9)
    en, de = ["the", "and", "thing", "ation", "with", "other"], ["der", "und", "schung", "keit", "nicht", "über"]
    docs = corpus(spark, [prose(rng, 20, en if i % 2 else de) for i in range(200)] + [None, "", "123 --", "ж" * 3000], langs=("de", "en"))
    out = {r.doc_id: r for r in langid.predict(clashing(docs, "score"), docs.where("doc_id < 100")).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "de") for i in range(100, 200)) and all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and out[203].lang_pred in ("de", "en")


def test_language_odd(spark):
    assert {r.lang_pred for r in langid.predict(odd_rows(spark), empty(spark)).collect()} == {"und"}
    assert langid.predict(empty(spark), odd_rows(spark)).count() == 0


# decontamination

def brute_hits(texts, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            x = cut(text)
            n = min(window, len(x))
            wins = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if x else set()
            for i in range(len(w) - n + 1 if x else 0):
                if tuple(w[i:i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("shard_words", [1_000_000, 60])
def test_decontamination_equals_brute_force(spark, shard_words):
    rng = random.Random(10)
    small = ["Ka", "lo", "mi", "ré"]
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 25]), small if i % 2 else WORDS_)) for i in range(12)] + [(90, None), (91, " - "), (3, "lo lo mi")]
    texts = []
    for _ in range(60):
        part = items[rng.randrange(12)][1]
        texts.append(f"{prose(rng, rng.randint(0, 20), small)}, {part.upper() if rng.random() < .5 else part}! {prose(rng, 5)}")
    texts += [None, "", prose(rng, 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = corpus(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in decontam.mark(clashing(docs, "n_hit"), bench, shard_words=shard_words).collect()}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items)
    clean = decontam.decontaminate(docs, bench, shard_words=shard_words)
    assert decontam.mark(clean, bench).where("n_hit > 0").isEmpty()
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert all(kept[i] == texts[i] for i, x in got.items() if x[1] == 0)


WORDS_ = [a + b for a in "zu ze zi".split() for b in "ra rb rc rd".split()]


def test_decontamination_odd(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.mark(odd_rows(spark), none).where("n_hit > 0").count() == 0 and decontam.mark(odd_rows(spark), none).count() == 10
    assert decontam.mark(empty(spark), none).count() == 0 and decontam.decontaminate(odd_rows(spark), none).count() == 10


@pytest.mark.parametrize("shard_words", [1_000_000, 60])
def test_decontamination_of_items_without_id(spark, shard_words):
    rng = random.Random(14)
    a, b = prose(rng, 12), prose(rng, 80)
    bench = spark.createDataFrame([(None, a), (None, b), (7, b)], "item_id long, text string")
    docs = corpus(spark, [f"mi {a} lo", b, "mi lo"])
    got = {r.doc_id: (r.n_hit, r.n_items, r.hit_items) for r in decontam.mark(docs, bench, shard_words=shard_words).collect()}
    assert got == {0: (12, 1, []), 1: (80, 2, ["7"]), 2: (0, 0, [])}
    assert [r.doc_id for r in decontam.decontaminate(docs, bench, shard_words=shard_words).collect()] == [2]


# sharding

def check_shards(rows, n=24):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_keeps_groups_and_counts(spark):
    rng = random.Random(11)
    texts = [prose(rng, 5) for _ in range(500)]
    texts += [t for t in texts[:60] for _ in range(3)] + ["hot text"] * 400
    rows = sharding.shard(clashing(corpus(spark, texts), "shard", "slot")).collect()
    check_shards(rows)
    split = Counter()
    for t in texts[:60]:
        split[len({r.shard for r in rows if r.text == t})] += 1
    assert split[1] >= 50 and "extra" in rows[0]
    assert all(r.law == "rows" and r.size == len(r.text.encode()) + 8 for r in rows)


@pytest.mark.parametrize("keep_text", [True, False])
def test_sharding_odd(spark, keep_text):
    rows = sharding.shard(odd_rows(spark), shards=4, keep_text=keep_text).collect()
    assert len(rows) == 10
    check_shards(rows, 4)
    assert [r for r in rows if r.size == 8 and r.text_crc32 == 0]
    assert sharding.shard(empty(spark)).count() == 0


def test_sharding_keeps_groups_where_most_rows_are_copies(spark):
    rng = random.Random(12)
    pairs = [prose(rng, 6) for _ in range(2400)]
    rows = sharding.shard(corpus(spark, pairs * 2)).collect()
    check_shards(rows)
    of = defaultdict(set)
    for r in rows:
        of[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 48


def test_sharding_keeps_a_hot_group_in_few_shards(spark):
    rng = random.Random(13)
    rows = sharding.shard(corpus(spark, ["hot text"] * 1600 + [prose(rng, 6) for _ in range(800)] * 4)).collect()
    check_shards(rows)
    of = defaultdict(set)
    for r in rows:
        of[r.text].add(r.shard)
    assert len(of.pop("hot text")) <= 18 and sum(len(s) > 1 for s in of.values()) <= 48  # a third of all rows is 16 or 17 halves of a shard
