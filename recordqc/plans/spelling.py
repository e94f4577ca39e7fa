"""Registered queries of spelling against a dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordqc.functions import sheets as X
from recordqc.functions import spelling as W
from recordqc.operators import spelling as S
from recordqc.plans.registry import query
from recordqc.plans.sheets import esc, m

#: A word of this many documents is in the dictionary of the queries.
COMMON = 8
OWN = ["acme", "waterproofng"]


def dictionary(t):
    """(word, n): words by the number of documents that use them."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), F.lit(1)), F.lower))
    return t.documents.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)


# RE2 knows ASCII word ends only: other letters become underscores
_any = lambda c, patterns: "(" + " OR ".join(m(f"regexp_replace({c}, '[\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{2C1}}\\x{{370}}-\\x{{1FFF}}\\x{{3040}}-\\x{{D7FF}}]', '_', 'g')", p) for p in patterns) + ")"
_list = lambda words: ", ".join(f"'{w}'" for w in words)
_plain = lambda c: f"lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"
_good = lambda c: f"list_filter(regexp_extract_all({c}, '{esc(W.TOKEN)}'), lambda x: length({_plain('x')}) > 2 AND {_plain('x')} NOT IN ({_list(X.CORRECTIONS)}))"
_tokens = lambda c: f"list_distinct(list_concat(list_transform({_good(c)}, lambda y: {_plain('y')}), list_transform(list_filter({_good(c)}, lambda z: z LIKE '%''s'), lambda z: {_plain('z[:-3]')})))"
DICTIONARY = f"(SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{{3,}}'), lambda x: lower(x)))) AS word FROM @documents) GROUP BY word HAVING count(*) >= {COMMON})"

SQL = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, coalesce(title_block_text, '') AS tb FROM @sheet_pages),
  names AS MATERIALIZED (SELECT DISTINCT set_id, word FROM (
    SELECT set_id, unnest({_tokens('line')}) AS word FROM (SELECT set_id, unnest(regexp_split_to_array(tb || chr(10) || text, '[\\r\\n]+')) AS line FROM p) WHERE {_any('line', W.LINE_MARKS)}
    UNION ALL SELECT set_id, unnest({_tokens('sheet_title')}) FROM p
    UNION ALL SELECT set_id, word FROM (SELECT set_id, unnest({_tokens('tb')}) AS word FROM p) GROUP BY ALL HAVING count(*) > 1)),
  lex AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT word, n FROM {DICTIONARY} UNION ALL SELECT unnest([{_list(W.TRADE)}]), 2 UNION ALL SELECT unnest([{_list(OWN)}]), 1) GROUP BY word),
  pairs AS (SELECT set_id, page_number, doc_id, sheet_number, text, regexp_extract_all(text, '{esc(X.WORD)}') AS ws, regexp_split_to_array(text, '{esc(X.WORD)}') AS gs FROM p),
  words AS (SELECT DISTINCT set_id, unnest(ws) AS word FROM pairs),
  v AS MATERIALIZED (SELECT set_id, word, {_plain('word')} AS pl, fixes.good AS fix,
      list_filter(list_transform(string_split(lower(word), '-'), lambda x: trim(x, '''')), lambda x: x <> '') AS parts
    FROM words LEFT JOIN (VALUES {", ".join(f"('{k}', '{g}')" for k, g in X.CORRECTIONS.items())}) fixes(bad, good) ON {_plain('word')} = bad),
  all_known AS MATERIALIZED (SELECT s.set_id, word FROM lex, (SELECT DISTINCT set_id FROM p) s UNION SELECT set_id, word FROM names),
  compound AS (SELECT set_id, word FROM v WHERE word LIKE '%-%' AND len(parts) > 1 AND len(parts[1]) = 1 AND parts[2] IN ({_list(W.COMPOUND)})
    UNION SELECT q.set_id, q.word FROM (SELECT v.set_id, v.word, unnest(parts) AS part FROM v WHERE word LIKE '%-%' AND len(parts) > 1) q
      LEFT JOIN all_known k ON k.set_id = q.set_id AND k.word = q.part GROUP BY q.set_id, q.word HAVING bool_and(k.word IS NOT NULL OR regexp_full_match(part, '[a-z]'))),
  plural AS (SELECT DISTINCT q.set_id, q.word FROM (SELECT set_id, word, unnest([CASE WHEN pl LIKE '%ies' AND length(pl) > 4 THEN pl[:-4] || 'y' END,
      CASE WHEN regexp_matches(pl, '(ches|shes|xes|zes|ses)$') AND length(pl) > 4 THEN pl[:-3] END, CASE WHEN pl NOT LIKE '%ss' THEN pl[:-2] END]) AS one
      FROM v WHERE fix IS NULL AND pl LIKE '%s' AND length(pl) >= 4) q JOIN all_known k ON k.set_id = q.set_id AND k.word = q.one),
  o AS MATERIALIZED (SELECT * FROM v WHERE (set_id, word) NOT IN (FROM compound) AND (set_id, word) NOT IN (FROM plural)),
  u AS MATERIALIZED (SELECT set_id, word, pl FROM o WHERE fix IS NULL AND length(pl) >= 4 AND NOT regexp_full_match(word, '[A-Z]{{2,6}}') AND (set_id, pl) NOT IN (FROM all_known)),
  k AS MATERIALIZED (SELECT word, length(word) + unnest([-1, 0, 1]) AS l FROM (SELECT word FROM lex UNION SELECT word FROM names)),
  asked AS MATERIALIZED (SELECT DISTINCT pl, length(pl) AS l FROM u),
  near AS MATERIALIZED (SELECT pl, word AS near FROM asked JOIN k ON asked.l = k.l AND left(pl, asked.l // 2 - 1) = left(word, k.l // 2 - 1) WHERE damerau_levenshtein(pl, word) = 1
    UNION SELECT pl, word FROM asked JOIN k ON asked.l = k.l AND right(pl, asked.l - asked.l // 2) = right(word, k.l - k.l // 2) WHERE damerau_levenshtein(pl, word) = 1),
  best AS (SELECT set_id, pl, arg_min(near, (-n, near)) AS good FROM (SELECT a.set_id, a.pl, near, coalesce(lex.n, 0) + CASE WHEN names.word IS NULL THEN 0 ELSE 1 END AS n
    FROM (SELECT DISTINCT set_id, pl FROM u) a JOIN near USING (pl) LEFT JOIN lex ON lex.word = near LEFT JOIN names ON names.set_id = a.set_id AND names.word = near) WHERE n > 0 GROUP BY set_id, pl),
  j AS (SELECT set_id, word, fix AS suggestion, 'known_correction' AS source FROM o WHERE fix IS NOT NULL AND pl NOT IN ({_list(sorted({*W.TRADE, *OWN}))})
    UNION ALL SELECT set_id, word, good, 'dictionary' FROM u JOIN best USING (set_id, pl)),
  h AS (SELECT t.*, suggestion, source FROM (SELECT set_id, page_number, doc_id, sheet_number, text, unnest(ws) AS word, ws, gs, unnest(range(1, len(ws) + 1)) AS i FROM pairs) t JOIN j USING (set_id, word)),
  c AS (SELECT *, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) AS INT) AS start FROM h),
  d AS (SELECT * EXCLUDE (ws, gs), CASE WHEN start > 70 THEN '...' ELSE '' END || trim(regexp_replace(substr(text, greatest(start - 70, 0) + 1, start + length(word) + 70 - greatest(start - 70, 0)), '\\s+', ' ', 'g'))
    || CASE WHEN start + length(word) + 70 < length(text) THEN '...' ELSE '' END AS context FROM c)
  SELECT set_id, page_number, doc_id, sheet_number AS sheet, word, suggestion, source, start, context FROM d WHERE NOT {_any('context', W.CONTEXT_MARKS)}
  QUALIFY row_number() OVER (PARTITION BY set_id, page_number, lower(word), lower(context) ORDER BY doc_id, start) = 1"""


@query("s22_suggestions", SQL)
def _(t):
    return S.spelling(t.sheet_pages, dictionary(t), OWN)
