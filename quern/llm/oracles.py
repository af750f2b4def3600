"""SQL counterparts (DuckDB) of the queries whose full result SQL can express."""

from __future__ import annotations

#: Every window of ten words, or all words of a shorter item, joined on equality.
DECONTAMINATE = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), words AS (
  SELECT kind, id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split
), ahead AS (
  SELECT kind, id, n, pos, list(word) OVER (PARTITION BY kind, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w FROM words
), items AS (
  SELECT DISTINCT id AS item_id, least(n, 10) AS m, array_to_string(w[1:least(n, 10)], ' ') AS said FROM ahead WHERE kind = 1 AND pos + least(n, 10) <= n
), places AS (
  SELECT id AS doc_id, pos, m, array_to_string(w[1:m], ' ') AS said FROM ahead, (SELECT DISTINCT m FROM items) WHERE kind = 0 AND pos + m <= n
), found AS (
  SELECT doc_id, pos, m, item_id FROM places JOIN items USING (m, said)
), hits AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS word FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT s.id AS doc_id, len(s.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hits h ON h.doc_id = s.id LEFT JOIN named i ON i.doc_id = s.id WHERE s.kind = 0
"""

#: All pairs that share a shingle, counted, then reachability.
NEAR_DUP = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split
), ahead AS (
  SELECT doc_id, n, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM words
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w, ' ') AS shingle FROM ahead WHERE pos + least(n, 3) <= n
), sizes AS (
  SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id
), alike AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM alike JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * same >= 85 * (sx.size + sy.size - same)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), least_of AS (
  SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(s.size, 0) AS n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.low, d.doc_id) AS kept
FROM split d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id
"""

#: The same links at 90 percent.
NGRAM_JOIN = (
    NEAR_DUP.replace(">= 85 *", ">= 90 *")
    .replace("d.doc_id <= coalesce(l.low, d.doc_id) AS kept", "coalesce(n.n, 0) AS n_links")
    .replace("LEFT JOIN least_of l", "LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM both_ways GROUP BY x) n ON n.doc_id = d.doc_id LEFT JOIN least_of l")
)

#: crc32 by its table; then the cheapest edits row by row, for each place in the pattern the least cost and its least letters.
REPAIR = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(b::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k : xor(c >> 1, (c & 1) * 3988292384::BIGINT)) ORDER BY b) AS t FROM range(256) r(b)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), faults AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i : ascii(k[i])::BIGINT)), lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS fault
  FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faults, range(2) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_open, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again AND NOT is_blank) AS duplicate,
    count(*) FILTER (is_open AND NOT is_blank AND NOT is_again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), inserts(p, q, letters, extra, said) AS (
  VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 2, chr(10) || 'user:'), (1, 2, 'I', 2, chr(10) || 'user:'), (2, 3, 'I', 2, chr(10) || 'assistant:'),
    (3, 2, 'I', 2, chr(10) || 'user:'), (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')
), wants(q, role, initial, ahead) AS (
  VALUES (0, 'user', 'u', 2), (1, 'user', 'u', 2), (2, 'assistant', 'a', 3), (3, 'user', 'u', 2)
), edits AS (
  SELECT conv_id, i, q, q AS place, 'D' AS letter, 3 AS cost, '' AS said FROM judged, wants
  UNION ALL SELECT conv_id, i, q, ahead, 'K', is_open::INT, chr(10) || j.role || ':' || text FROM judged j, wants w WHERE j.role[1] = initial AND NOT is_blank AND NOT is_again
  UNION ALL SELECT conv_id, i, 0, 1, 'K', is_open::INT, chr(10) || role || ':' || text FROM judged WHERE role[1] = 's' AND NOT is_blank AND NOT is_again
  UNION ALL SELECT conv_id, i, q, ahead, 'R', 2 + is_open::INT, chr(10) || w.role || ':' || text FROM judged, wants w WHERE NOT is_blank AND NOT is_again
), paths(conv_id, i, place, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'said': ''} FROM counts
  UNION ALL
  SELECT s.conv_id, s.i + 1, e.place, min({'cost': s.best.cost + x.extra + e.cost, 'audit': s.best.audit || x.letters || e.letter, 'said': s.best.said || x.said || e.said})
  FROM paths s JOIN inserts x ON x.p = s.place JOIN edits e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i + 1 AND e.q = x.q GROUP BY s.conv_id, s.i, e.place
), ends AS (
  SELECT c.conv_id, min({'cost': s.best.cost + x.extra, 'audit': s.best.audit || x.letters, 'said': s.best.said || x.said}) AS best
  FROM counts c JOIN paths s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n JOIN inserts x ON x.p = s.place WHERE x.q IN (0, 3) GROUP BY c.conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(e.best.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLES: dict[str, str] = {"op7_decontaminate": DECONTAMINATE, "op8_near_dup": NEAR_DUP, "op11_conversation_repair": REPAIR, "op12_ngram_join": NGRAM_JOIN}
