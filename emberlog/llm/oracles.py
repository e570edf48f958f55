"""The queries that SQL can express, in DuckDB's SQL over the same tables."""

EXACT = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = min(doc_id) OVER w, min(doc_id) OVER w IS NULL) AS kept, sha256(s) AS text_sha256
FROM t WINDOW w AS (PARTITION BY s)
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line,
         [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END
          FOR t IN string_split(trim(regexp_replace(ls[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ')] AS ts
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), m AS (
  SELECT doc_id, line, ts, array_to_string(ts, ' ') AS masked, len(ts) AS n, array_to_string(ts[:3], ' ') AS lead FROM l
), v AS (
  SELECT masked, any_value(ts) AS ts, any_value(n) AS n, any_value(lead) AS lead, count(DISTINCT doc_id) AS docs
  FROM m WHERE masked <> '' GROUP BY masked
), g AS (
  SELECT masked, docs, n, ts,
         first_value(masked) OVER w AS leader, first_value(ts) OVER w AS leader_ts
  FROM v WINDOW w AS (PARTITION BY n, lead ORDER BY docs DESC, masked)
), p AS (
  SELECT masked,
         CASE WHEN len([1 FOR i IN range(1, n + 1) IF ts[i] = leader_ts[i]]) >= 0.7::DOUBLE * n THEN leader ELSE masked END AS first
  FROM g
), f AS (SELECT first FROM p JOIN m USING (masked) GROUP BY first HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT masked FROM p JOIN f USING (first))
SELECT m.doc_id, count(*) AS n_lines, count(r.masked) AS n_dropped,
       coalesce(string_agg(CASE WHEN r.masked IS NOT NULL THEN line::VARCHAR END, ',' ORDER BY line), '') AS dropped_lines
FROM m LEFT JOIN r USING (masked) GROUP BY m.doc_id
"""

MIXING = r"""
WITH RECURSIVE s AS (
  SELECT source, (sum(coalesce(length(text), 0)) + count(*))::DOUBLE AS size FROM documents GROUP BY source
), r AS (
  SELECT source, sum(size) OVER () * pow(size, 0.5) / sum(pow(size, 0.5)) OVER () / size AS rate FROM s
), c AS (
  SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate) - ln(k + 1), c + exp(lp + ln(rate) - ln(k + 1))
  FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
), d AS (
  SELECT doc_id, source,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents
), n AS (
  SELECT d.doc_id, d.source, count(*) FILTER (WHERE c.c <= d.u) AS mix_copies
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL
)
SELECT doc_id, source, mix_copies, mix_copy,
       md5('17 order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || mix_copy) AS mix_key
FROM (SELECT *, unnest(range(1, mix_copies + 1)) AS mix_copy FROM n)
"""

CONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)
), h AS (
  SELECT w.doc_id, w.s, g.k, g.item_id
  FROM (SELECT doc_id, s, k, array_to_string(ws[s:s + k - 1], ' ') AS gram
        FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM g))) w
  JOIN g ON g.k = w.k AND g.gram = w.gram
), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
"""

WORD_WINDOWS = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), w AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d WHERE len(ws) >= 50)
), r AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS m FROM w) WHERE m < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM r),
a AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT a.doc_id, string_agg(ws[a.p], ' ' ORDER BY a.p) AS kept, count(*) AS n
      FROM a ANTI JOIN p ON a.doc_id = p.doc_id AND a.p = p.p GROUP BY a.doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

CHATS = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), c AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\\\2\3', 'g') AS escaped,
         regexp_matches(text, '[<\[]\\+/?(?:s>|INST\]|SYS\]|ROLE\])')
         OR contains(text, CASE role WHEN 'user' THEN '[/INST]' WHEN 'system' THEN '[/SYS]' ELSE '</s>' END)
         OR (role = 'assistant' AND regexp_matches(text, '^\[(INST|SYS|ROLE)\]')) AS conflict
  FROM t
), p AS (
  SELECT *, length(CASE WHEN conflict THEN escaped ELSE text END)
         + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4 ELSE 17 + length(role) END AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

RANKED = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS len FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(len)::BIGINT AS words FROM d),
m AS (SELECT doc_id, 10 + (90 * len * docs) // words AS m FROM d, c),
f AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c
), s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
