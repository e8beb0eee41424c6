"""Queries of the training-data operators and the SQL that some of them have."""

from __future__ import annotations

from chatloom.llm.decontaminate import op6_decontaminate
from chatloom.llm.language import op8_language
from chatloom.llm.lines import op12_lines
from chatloom.llm.lm import op3_lm
from chatloom.llm.mixing import op9_mixing
from chatloom.llm.neardup import op5_neardup
from chatloom.llm.passages import op10_passages
from chatloom.llm.prefixes import op11_prefixes
from chatloom.llm.repeats import op2_repeats
from chatloom.llm.repetition import op7_repetition
from chatloom.llm.secrets import op1_secrets
from chatloom.llm.spelling import op13_spelling
from chatloom.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_repeats": op2_repeats,
    "op3_lm": op3_lm,
    "op4_toxicity": op4_toxicity,
    "op5_neardup": op5_neardup,
    "op6_decontaminate": op6_decontaminate,
    "op7_repetition": op7_repetition,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_passages": op10_passages,
    "op11_prefixes": op11_prefixes,
    "op12_lines": op12_lines,
    "op13_spelling": op13_spelling,
}

# The mix as plain SQL, with one window per source.
MIXING = r"""
WITH sized AS (
  SELECT doc_id,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS token,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key
  FROM documents),
ranked AS (
  SELECT source_key, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source_key) - 1 AS rank
  FROM sized GROUP BY source_key),
weighed AS (
  SELECT *, (CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight,
         (CASE rank % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END)::DOUBLE AS slope,
         (2 * source_size)::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted
  FROM ranked),
leveled AS (
  SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, rank
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
open AS (
  SELECT level AS open_level FROM leveled WHERE cap > weight * level
  ORDER BY cap / weight, rank LIMIT 1),
sources AS (
  SELECT source_key, source_size, slope,
         CASE WHEN cap <= weight * level THEN cap
              ELSE weight * (SELECT open_level FROM open) END AS target
  FROM leveled),
totals AS (
  SELECT sum(target * (1 - slope)) AS linear, sum(target * slope) AS square FROM sources),
placed AS (
  SELECT doc_id, size, source_size, target, slope, linear, square,
         coalesce(sum(size) OVER (PARTITION BY source_key ORDER BY token, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start
  FROM sized JOIN sources USING (source_key) CROSS JOIN totals),
taken AS (
  SELECT *, (start + size / 2.0::DOUBLE) AS middle,
         (CASE WHEN size > 0 AND start + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END
          + CASE WHEN size > 0 AND start + source_size + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END) AS times
  FROM placed),
timed AS (
  SELECT *, CASE WHEN slope = 0 THEN middle / target
                 ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * (middle / target)))
                      / (2 * slope) END AS time
  FROM taken)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * times)::BIGINT AS taken,
       CASE WHEN times > 0 THEN round(linear * time + square * time * time, 3) END AS position
FROM timed
"""

# CRC-32 of the bytes of a text: eight shifts a byte.
CRC32 = r"""
xor(list_reduce(
  [4294967295::BIGINT] || flatten(list_transform(
    range(octet_length(encode({0}))),
    lambda i: [('0x' || hex(encode({0}))[2 * i + 1:2 * i + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)
"""

PREFIXES = rf"""
WITH turns AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS digest, length(text) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.pos, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt),
keyed AS (
  SELECT conv_id, depth, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
paths AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM keyed),
nodes AS (
  SELECT depth, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n, min(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY depth, key),
counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes GROUP BY ALL) c
  USING (depth, key)),
sums AS (
  SELECT p.depth, p.key, sum((c.n_children = 0)::INT)::BIGINT AS n_leaves, sum((c.n - 1) * c.chars)::BIGINT AS saved_tokens
  FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY ALL)
SELECT c.conv_id, c.depth, u.conv_id AS parent_conv_id, c.n AS n_convs, c.n_children,
       s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (depth, key)
LEFT JOIN nodes u ON u.depth = c.depth - 1 AND u.key = c.up
"""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINES = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row_no, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), {LOWER}) AS key FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key
  HAVING min(doc_id) < max(doc_id) OR (count(doc_id) > 0 AND count(doc_id) < count(*))),
judged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_no, doc_id
"""

# Words that lose a letter at the same place and become equal, or of which one
# becomes the other, are one edit apart.
SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), {LOWER}) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS named, {CRC32.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
  FROM counted),
written AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
ranked AS (
  SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS rank
  FROM near JOIN words ON words.word = other),
ruled AS (
  SELECT w.word, CASE WHEN r.n >= 2 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.rank = 1),
followed AS (
  SELECT word, word AS root, form AS next FROM ruled
  UNION ALL SELECT f.word, r.word, r.form FROM followed f JOIN ruled r ON r.word = f.next)
SELECT r.word, r.form, f.root, r.n, r.n_near, r.form_n
FROM ruled r JOIN followed f ON f.word = r.word AND f.next IS NULL
"""

SQL: dict[str, str] = {
    "op9_mixing": MIXING,
    "op11_prefixes": PREFIXES,
    "op12_lines": LINES,
    "op13_spelling": SPELLING,
}
