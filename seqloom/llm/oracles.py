"""DuckDB SQL for the registered queries that SQL can express, written from their contracts and not from their plans."""

from __future__ import annotations

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Each control string in a text is a match; guarding adds one character to it.
GUARDED = r"\[\\*/INST\]|\[\\*/ROLE\]|\[\\*INST\]|\[\\*/SYS\]|\[\\*ROLE\]|\[\\*TEXT\]|\[\\*SYS\]|<\\*/s>|<\\*s>"
CHAT = f"""WITH said AS (SELECT '</s>[INST] ok [/INST]' AS s),
  t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', s FROM said UNION ALL SELECT -7, 1, 'assistant', s FROM said),
  n AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS r, coalesce(text, '') AS x FROM t),
  m AS (SELECT *, length(x) + len(regexp_extract_all(x, '{GUARDED}')) AS guarded,
    CASE r WHEN 'assistant' THEN 7 WHEN 'user' THEN 15 WHEN 'system' THEN 13 ELSE 23 + length(r) + len(regexp_extract_all(r, '{GUARDED}')) END AS marks FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(guarded + marks) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id"""

#: All pairs of different texts that share an n-gram, exactly; classes by reachability.
JOIN = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT t, row_number() OVER (ORDER BY t) AS k, count(*) AS copies, min(doc_id) AS least FROM d GROUP BY t),
  w AS (SELECT k, list_filter(regexp_split_to_array(lower(t), '[{SPACE}]+'), lambda x: x <> '') AS w FROM n),
  g AS (SELECT k, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) > 0),
  s AS (SELECT k, count(*) AS n FROM g GROUP BY k), p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
  e AS (SELECT a, b FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b WHERE 9 * c >= 4 * (x.n + y.n)), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  reach AS (SELECT k, k AS r FROM n UNION SELECT reach.k, b FROM reach JOIN both_ways ON a = r), root AS (SELECT k, min(r) AS root FROM reach GROUP BY k),
  c AS (SELECT root, min(least) AS class_id, CAST(sum(copies) AS BIGINT) AS class_size FROM root JOIN n USING (k) GROUP BY root), l AS (SELECT a AS k, sum(copies) AS links FROM both_ways JOIN n ON n.k = b GROUP BY a)
SELECT d.doc_id, c.class_id, c.class_size, CAST(n.copies - 1 + coalesce(l.links, 0) AS BIGINT) AS n_links FROM d JOIN n USING (t) JOIN root USING (k) JOIN c USING (root) LEFT JOIN l ON l.k = n.k"""

URL = r"(?s)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@\[\]]+)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
ARCHIVE = f"""WITH p AS (SELECT page_id, lower(url) AS u, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
  f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
  x AS (SELECT *, regexp_extract(u, '{URL}', 1) AS host, regexp_extract(u, '{URL}', 2) AS port, rtrim(regexp_extract(u, '{URL}', 3), '/') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '{URL}', 4), '&'), lambda y: y <> '')), '&') AS q FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  CASE WHEN host = '' THEN u ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS url_key,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 315360000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM x JOIN f USING (h)"""

#: Every query against every row. The graphs are approximate; on tables of a few hundred rows they find all of these.
NEAREST = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
  u AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])) AS score FROM u q JOIN u c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM s WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 20"""

#: Targets by water filling; blocks in order until a source's rest is met, in each block documents by their digest.
MIX = r"""WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS source_key, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, '')))[1:15] AS BIGINT) AS u FROM documents),
  s AS (SELECT source_key, source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY ALL),
  r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) + 1] AS weight, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
  f AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(cap) OVER up + cap / weight * (sum(weight) OVER () - sum(weight) OVER up) AS need FROM r WINDOW up AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
  w AS (SELECT *, total - sum(CASE WHEN need <= total THEN cap ELSE 0.0::DOUBLE END) OVER () AS rest, sum(CASE WHEN need <= total THEN 0.0::DOUBLE ELSE weight END) OVER () AS open FROM f),
  t AS (SELECT source_key, source_size, CASE WHEN need <= total THEN cap ELSE least(cap, weight * (rest / nullif(open, 0))) END AS target, CAST(ceil(n / 512) AS BIGINT) AS blocks FROM w),
  q AS (SELECT *, CAST(round(target) AS BIGINT) AS quota, coalesce(CAST(round(target) AS BIGINT) // nullif(source_size, 0), 0) AS passes FROM t),
  o AS (SELECT d.*, source_size, target, passes, CASE WHEN source_size > 0 THEN quota - passes * source_size ELSE 0 END AS rest, sum(size) OVER (PARTITION BY source_key ORDER BY u % blocks, u ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN q USING (source_key))
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM o"""

#: Each order applied to each document, by the first filter that it fails.
AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents), f AS (SELECT x, min(doc_id) AS least FROM d GROUP BY x),
  w AS (SELECT d.*, least, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM d JOIN f USING (x)),
  l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
  t AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
  m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM t GROUP BY ALL),
  c(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM c a, c b, c c, c d, c e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
  s AS (SELECT part, o, k, o[k] AS f, o[1:k - 1] AS before, fails, n, good, toxic FROM o, range(1, 6) AS r(k), m),
  g AS (SELECT *, contains(fails, f) AS hit, len(list_filter(string_split(before, ''), lambda b: b <> '' AND contains(fails, b))) > 0 AS gone FROM s),
  r AS (SELECT part, o AS filter_order, k AS step, f, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = f), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

ORACLE = {"op1_chat_format": CHAT, "op3_mixing": MIX, "op6_ngram_join": JOIN, "op7_warc": ARCHIVE, "op9_hnsw": NEAREST, "op12_filter_audit": AUDIT}
