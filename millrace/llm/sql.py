"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), edges AS (
  SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
), reach AS (
  SELECT doc_id AS node, doc_id AS found FROM documents UNION SELECT e.b, r.found FROM reach r JOIN edges e ON r.node = e.a
), least AS (SELECT node, min(found) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l ON l.node = d.doc_id
"""

OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), formatted AS (
  SELECT *, '<|im_start|>' || role || chr(10)
    || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>)', '\1\\\2\3', 'g') || '<|im_end|>' || chr(10) AS f FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, sum(length(f))::BIGINT AS formatted_chars
FROM formatted GROUP BY conv_id
"""

OP4 = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS win FROM split
), twice AS (
  SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '^\P{L}*\p{Lu}{2,}\P{L}*$'))) AS n_shouted,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM split s LEFT JOIN covered c USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines > 4 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 5 * n_shouted > n_words OR 2 * n_letter_words < n_words) AS kept
FROM judged
"""

OP9 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(bin(strlen(coalesce(text, '')))) AS tier,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY source
), tried AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER o AS place,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, place) FROM tried WHERE cap > level * weight)), cap) AS target FROM tried
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, floor(round(target - whole * source_size, 6))::BIGINT AS need FROM targets
), units AS (
  SELECT source, tier, key, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY ALL
), tiers AS (
  SELECT source, tier, sum(n * size)::BIGINT AS total, min(size) AS least_size, row_number() OVER (PARTITION BY source ORDER BY tier DESC) AS t FROM units GROUP BY source, tier
), given AS (
  SELECT source, 0::BIGINT AS t, NULL::BIGINT AS tier, 0::BIGINT AS above, 0::BIGINT AS quota, 0::BIGINT AS upto FROM shares
  UNION ALL
  SELECT source, t, tier, above, quota, upto + quota FROM (
    SELECT g.source, x.t, x.tier, g.above + x.total AS above, g.upto,
      least(s.need, floor(s.need::DOUBLE * (g.above + x.total) / s.source_size + 0.5)::BIGINT) - g.upto AS wanted, CASE WHEN wanted < x.least_size THEN 0 ELSE least(wanted, x.total) END AS quota
    FROM given g JOIN tiers x ON g.source IS NOT DISTINCT FROM x.source AND x.t = g.t + 1 JOIN shares s ON s.source IS NOT DISTINCT FROM g.source)
), passed AS (
  SELECT u.*, g.quota, sum(n * size) OVER (PARTITION BY u.source, u.tier ORDER BY key) - n * size AS before FROM units u JOIN given g ON u.source IS NOT DISTINCT FROM g.source AND u.tier = g.tier
), first AS (
  SELECT *, CASE WHEN before > quota THEN 0 ELSE least(n, (quota - before) // size) END::BIGINT AS copies FROM passed
), lacking AS (
  SELECT *, (need - sum(copies * size) OVER (PARTITION BY f.source))::BIGINT AS lacking,
    coalesce(sum(n - copies) OVER (PARTITION BY f.source, tier ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skipped
  FROM first f JOIN (SELECT source AS name, need FROM shares) s ON f.source IS NOT DISTINCT FROM s.name
), next AS (
  SELECT source, key, size, n - copies AS rest, lacking, row_number() OVER (PARTITION BY source ORDER BY tier DESC, key) AS turn FROM lacking WHERE skipped < 64 AND copies < n AND size <= lacking
), filled AS (
  SELECT source, 0::BIGINT AS turn, NULL::VARCHAR AS key, 0::BIGINT AS more, max(lacking)::BIGINT AS left_over FROM next GROUP BY source
  UNION ALL
  SELECT f.source, x.turn, x.key, least(x.rest, f.left_over // x.size)::BIGINT, (f.left_over - least(x.rest, f.left_over // x.size) * x.size)::BIGINT
  FROM filled f JOIN next x ON f.source IS NOT DISTINCT FROM x.source AND x.turn = f.turn + 1
), chosen AS (
  SELECT l.source, l.key, l.copies + coalesce(f.more, 0) AS copies FROM first l LEFT JOIN filled f ON l.source IS NOT DISTINCT FROM f.source AND l.key = f.key
), numbered AS (SELECT *, row_number() OVER (PARTITION BY source, key) AS nth FROM sized)
SELECT d.doc_id, d.size, s.source_size, s.target, (d.size * CASE WHEN s.source_size > 0 THEN s.whole + (d.nth <= coalesce(c.copies, 0))::BIGINT ELSE 0 END)::BIGINT AS taken
FROM numbered d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN chosen c ON c.source IS NOT DISTINCT FROM d.source AND c.key = d.key
"""
