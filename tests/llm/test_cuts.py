"""Nothing is cut off: words of scripts without spaces, tokens behind long paths, rows that share id and text."""

import random
import string

import numpy as np

from recordqc.llm import decontam, langid, probminhash, secrets
from tests.llm.helpers import corpus, prose


def test_languages_without_spaces(spark):
    rng = random.Random(11)
    han = [chr(0x4E00 + i * 7) for i in range(300)]
    texts, langs = [], []
    for i in range(160):
        zh = i % 2 == 0
        texts.append("".join(rng.choice(han) if rng.random() < 0.98 else "。" for _ in range(120)) if zh else prose(rng, 40))
        langs.append("zh" if zh else "en")
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.drop("lang"), docs.where("doc_id < 120").select("text", "lang")).collect()}
    assert sum(got[i] == langs[i] for i in range(120, 160)) >= 39


def token(rng):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))


def test_tokens_behind_long_paths(spark):
    rng = random.Random(12)
    path = "kaba/" + "/".join(prose(rng, 7).split()) + "/"
    texts = [f"{prose(rng, 30)} {path}{token(rng)} {prose(rng, 10)}" for _ in range(40)] + [f"{prose(rng, 30)} {path}{'/'.join(prose(rng, 6).split())} {prose(rng, 10)}" for _ in range(40)]
    texts += [prose(rng, 200) + f" password = {token(rng)}" for _ in range(60)]
    out = {r.doc_id: r for r in secrets.scan(corpus(spark, texts)).collect()}
    found = [out[i].n_markov > 0 for i in range(80)]
    assert sum(found[:40]) >= 38 and not any(found[40:])
    for i in range(40):
        start, end = texts[i].index(path) + len(path), texts[i].index(path) + len(path) + 32
        assert any(int(s.split(":")[1]) <= start + 2 and int(s.split(":")[2]) == end for s in out[i].span_list) or not found[i]


def test_random_parts_of_a_run():
    table = np.full((secrets.SIZE, secrets.SIZE), -2.0)
    digits = [secrets.ALPHABET.index(c) for c in "0123456789"]
    table[np.ix_(digits, digits)] = 4.0
    parts = lambda s: [s[a:b] for a, b in secrets.random_parts(s, table, 8, 1.5)]
    assert parts("1234567890") == ["1234567890"] and parts("abcdefghijkl") == []
    assert parts("ordinary/words/12345678901/and/more/98765432109/end") == ["12345678901", "98765432109"]
    assert parts("a/1234/b") == []


def test_rows_of_one_id_and_text_keep_the_same_one(spark):
    text = prose(random.Random(1), 60)
    docs = spark.createDataFrame([(1, text, "en", s, 5) for s in "hgfedcba"], "doc_id long, text string, lang string, source string, n_chars long")
    assert {probminhash.keep_one(docs.repartition(n)).first().source for n in (1, 3, 7)} == {"a"}


def test_a_full_default_shard_is_small():
    import tracemalloc
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 60000)}" for _ in range(decontam.SHARD_WORDS)]
    tracemalloc.start()
    decontam._Index([(str(i), [w.encode() for w in words[i * 1000:(i + 1) * 1000]]) for i in range(len(words) // 1000)], 10)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 300e6
