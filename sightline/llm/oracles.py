"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sightline.llm.decontam import WINDOW as ITEM_WINDOW
from sightline.llm.quality import POLICIES, RULES
from sightline.llm.sharding import BITS
from sightline.llm.substring_dedup import WINDOW

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality() -> str:
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))
    policy = sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES["v1"])
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
windows AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t FROM places),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS c FROM windows) x WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) y GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS BIGINT) AS n_letter_words,
    CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN line_counts USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (failures & {policy}) = 0 AS kept, failures
FROM f"""


def sharding(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
lv AS (SELECT d.*, k AS depth, h >> ({BITS} - k) AS prefix FROM d, range(0, {BITS} + 1) r(k)),
b AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs, min(h) AS lo, max(h) AS hi FROM lv GROUP BY depth, prefix),
ok AS (SELECT lv.doc_id, lv.n_bytes, CAST(lv.depth AS INT) AS depth, lv.prefix, b.shard_bytes, b.shard_docs,
  row_number() OVER (PARTITION BY lv.doc_id ORDER BY lv.depth) AS r
  FROM lv JOIN b USING (depth, prefix) WHERE b.shard_bytes <= {limit} OR b.lo = b.hi),
leaf AS (SELECT * FROM ok WHERE r = 1),
sized AS (SELECT *, 2 * n_bytes > {limit} AS large FROM leaf),
paged AS (SELECT *, CASE WHEN shard_bytes <= {limit} THEN 0 WHEN large THEN 2 * row_number() OVER (PARTITION BY depth, prefix, large ORDER BY doc_id, n_bytes) - 1
  ELSE 2 * (2 * CAST(coalesce(sum(n_bytes) OVER (PARTITION BY depth, prefix, large ORDER BY doc_id, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {limit}) END AS page FROM sized)
SELECT doc_id, n_bytes, depth, prefix, CAST(page AS BIGINT) AS page,
  (CASE WHEN depth = 0 THEN '-' ELSE lpad(bin(prefix), depth, '0') END) || '.' || page AS shard,
  CAST(sum(n_bytes) OVER (PARTITION BY depth, prefix, page) AS BIGINT) AS shard_bytes, count(*) OVER (PARTITION BY depth, prefix, page) AS shard_docs
FROM paged"""


def decontamination() -> str:
    words = r"regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM (SELECT item_id, {lower} AS lower_ascii FROM benchmark) x),
iw AS (SELECT DISTINCT item_id, least(len(w), {ITEM_WINDOW}) AS n, array_to_string(w[p:p + least(len(w), {ITEM_WINDOW}) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {ITEM_WINDOW} + 1, 1) + 1)) AS p FROM i WHERE len(w) > 0) y),
d AS (SELECT doc_id, {words} AS w FROM (SELECT doc_id, {lower} AS lower_ascii FROM documents) x),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n) y),
hits AS (SELECT DISTINCT doc_id, item_id, dw.n, p FROM dw JOIN iw USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) z GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def substring_dedup() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS p FROM d WHERE len(w) >= {WINDOW}) x),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY t) AS c FROM windows) x WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS p FROM twice),
each AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) x),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def hard_negatives() -> str:
    return """
WITH e AS (SELECT vec_id, min(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, min(list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3"""


def filter_audit() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) THEN 16 ELSE 0 END AS bits
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) t(x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, k AS step, CAST(1 << (ascii(o[k]) - 65) AS BIGINT) AS f, CAST(list_sum(list_transform(range(1, 6), lambda j: CASE WHEN j < k THEN 1 << (ascii(o[j]) - 65) ELSE 0 END)) AS BIGINT) AS before
  FROM o, range(1, 6) r(k) WHERE len(o) = 5),
m AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN bits & (f | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN bits & f <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & f <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bits = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & f <> 0 AND bits & before = 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN bits & f <> 0 AND bits & before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, {', '.join(f'CAST({x} AS BIGINT) AS {x}' for x in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM m"""
