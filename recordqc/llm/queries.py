"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.llm import chat, decontam, divergence, langid, mixing, phrases, probminhash, quality, secrets, sharding, substring, suffixes, warc
from recordqc.llm.common import stored, table
from recordqc.llm.registry import ORACLES, QUERIES, query


def queries():
    import corpus_pipeline
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracles():
    import corpus_pipeline
    return dict(ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    learn = docs.where(~F.coalesce(held_out, F.lit(False)))
    return langid.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), learn, keep_text=False)


@query("op2_mix_sources")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op3_quality_rules")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = stored(quality.measure(docs).drop("text"), "quality")
    return quality.judge(measured).drop("lang", "source")


@query("op6_secret_scan")
def op6(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base_list", ","), 256).alias("base_sha256"),
                        F.array_join("span_list", ",").alias("spans"), "n_markov")


_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""


@query("op8_decontaminate", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
        FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, n, s, item_id FROM pos JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op8(spark, sf_dir):
    docs = decontam.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return docs.select("doc_id", "n_words", "n_hit", "n_items",
                       F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_chat_format")
def op7(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.read_back(stored(chat.windows(rows.unionByName(extra)), "chat"))


_BASE32 = """array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(h), g * 5 + 1, 5))::BIGINT) >> b) & 31)::INT + 1, 1)), '')), '')"""


@query("op9_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k""")
def op9(spark, sf_dir):
    archives = warc.normalise(warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return warc.read(archives).drop("payload")


@query("op10_shard")
def op10(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


@query("op4_near_dedup")
def op4(spark, sf_dir):
    return probminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


_PLAIN_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query("op5_substring_dedup", f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM win JOIN least USING (g) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op5(spark, sf_dir):
    kept = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op13_suffix_dedup", """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, b, substr(h, b * 800 + 1, 1198) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 800 + 1)) AS b FROM d)),
w AS (SELECT r, b * 400 + s AS p, md5(substr(h, s * 2 + 1, 400)) AS g FROM (SELECT r, b, h, unnest(range(0, least(400, len(h) // 2 - 199))) AS s FROM c WHERE len(h) >= 400)),
m AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, p FROM w SEMI JOIN m USING (g)),
isl AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 200, true) AS new FROM hit),
run AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM isl) GROUP BY r, k),
gap AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS f, s AS t, e - s AS n FROM run UNION ALL SELECT r, max(e), NULL, 0 FROM run GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, f * 2 + 1, CASE WHEN t IS NULL THEN len(h) ELSE (t - f) * 2 END), '' ORDER BY f) AS k, sum(n) AS n, count(t) AS c FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""")
def op13(spark, sf_dir):
    kept = suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_TERMS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""


@query("op11_source_divergence", f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, sum(c) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
    FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (x + 1)) // (sum(x) OVER (PARTITION BY lang) + v) AS q
    FROM (SELECT lang, term, sum(c) AS x FROM c GROUP BY ALL) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT i.lang, i.source, j.source AS peer, sum(((i.p - j.p) * (i.p - j.p)) // j.p) AS x FROM p i JOIN p j ON i.lang = j.lang AND i.term = j.term AND i.source <> j.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.peer = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pair UNION ALL FROM term)
QUALIFY part = 'pair' OR rank <= 200""")
def op11(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_phrases", """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS t FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)),
f AS MATERIALIZED (SELECT lang, n AS size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[b:b + n - 1], ' ') AS phrase, max(f) AS within FROM (SELECT lang, f, w, n, unnest(range(1, size - n + 2)) AS b
    FROM (SELECT *, unnest(range(2, size)) AS n FROM c)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low LEFT JOIN inner_ USING (lang, phrase) JOIN words USING (lang) WHERE within IS NULL OR 100 * within < 80 * a QUALIFY rank <= 2000""")
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
