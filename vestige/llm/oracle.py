"""The SQL of those operators that SQL can express."""

OP8 = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM placed),
frequent AS (
  SELECT line_key, max(doc_id) AS holder FROM keyed WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.place, k.line, f.holder IS NOT NULL AND k.doc_id < f.holder AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Classes of texts whose sets of five-word shingles have a Jaccard of 0.8 or more.
SIMILAR = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingle
  FROM split WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 10 * c.n >= 8 * (p.n + q.n - c.n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a)
SELECT d.doc_id, coalesce(least(min(r.b), d.doc_id), d.doc_id) AS class_id, coalesce(max(s.n), 0) AS n_shingles
FROM documents d LEFT JOIN reached r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

# Trees of runs of 16 over each source's leaves and over the sources' roots; ``now`` is a leaf after tampering.
MERKLE = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS entries
  FROM (SELECT unnest(range(256)) AS i)),
marked AS (
  SELECT d.*, doc_id IS NOT NULL AND xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)),
           lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1]))) % 5 = 0 AS changed
  FROM documents d, crc),
parts AS (
  SELECT doc_id, source, changed, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM marked),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS now
  FROM parts),
levels AS (
  SELECT 0 AS level, tree, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, tree, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM levels WHERE n > 1 GROUP BY level, tree, place // 16, (n + 15) // 16),
subroots AS (SELECT tree, h AS subroot, tree AS place, count(*) OVER () AS n FROM levels WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 16, (n + 15) // 16),
runs AS (
  SELECT tree, level, place // 16 AS run, list(h ORDER BY place) AS hs FROM levels WHERE n > 1 GROUP BY tree, level, place // 16
  UNION ALL
  SELECT -1, level, place // 16, list(h ORDER BY place) FROM tops WHERE n > 1 GROUP BY level, place // 16),
climb AS (
  SELECT doc_id, leaf, tree AS own, tree, 0 AS level, place, n, now AS fold, '' AS proof FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own, CASE WHEN c.n = 1 THEN -1 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
         CASE WHEN c.n = 1 THEN c.own ELSE c.place // 16 END, CASE WHEN c.n = 1 THEN s.n ELSE (c.n + 15) // 16 END,
         CASE WHEN c.n = 1 THEN c.fold ELSE sha256(array_to_string(hs[:c.place % 16], '') || c.fold || array_to_string(hs[c.place % 16 + 2:], '')) END,
         CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || array_to_string(hs[:c.place % 16], '') || array_to_string(hs[c.place % 16 + 2:], '') END
  FROM climb c JOIN subroots s ON s.tree = c.own
  LEFT JOIN runs r ON c.n > 1 AND r.tree = c.tree AND r.level = c.level AND r.run = c.place // 16
  WHERE c.n > 1 OR c.tree >= 0)
SELECT c.doc_id, c.leaf, s.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root, c.fold = t.h AS verified
FROM climb c JOIN subroots s ON s.tree = c.own, (SELECT h FROM tops WHERE n = 1) t
WHERE c.tree = -1 AND c.n = 1
"""

# All windows of 100 bytes, as hexadecimal text; those seen earlier, in runs; what is left between the runs.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 200)) AS k FROM d, unnest(range(n - 99)) AS t(i)),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM windows),
gone AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, TRUE) AS new FROM placed WHERE later),
numbered AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
between_runs AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
short AS (
  SELECT d.doc_id, d.n, sum(b - a)::BIGINT AS removed, count(*) AS spans,
         string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept
  FROM d JOIN between_runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id, d.n)
SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN short s ON s.doc_id = d.doc_id
"""
