"""SQL for the operators that SQL can express."""

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

TWINS = {
    "op10_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, repeated.k IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), digits AS (
  SELECT *, list_transform(range(8), lambda g: ('0x' || substr(sha, 5 * g + 1, 5))::BIGINT) AS fives FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM digits""",
    "op6_chat_format": r"""
WITH talks AS (
  SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT pair_id, max({'turn': turn, 'text': text}) AS l FROM talks WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY pair_id
), cut AS (
  SELECT pair_id, l.turn AS cut, coalesce(lead(l.text) OVER by_id, first_value(l.text) OVER by_id) AS donated
  FROM last WINDOW by_id AS (ORDER BY pair_id)
), sides AS (
  SELECT 'chosen' AS side, talks.* FROM talks JOIN cut USING (pair_id)
  UNION ALL
  (SELECT 'rejected', talks.* FROM talks JOIN cut USING (pair_id) WHERE turn < cut OR turn IS NULL
   UNION SELECT 'rejected', pair_id, cut, 'assistant', donated FROM cut)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn NULLS FIRST, role, text) AS n,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM sides
), prefix AS (
  SELECT pair_id, coalesce(min(n) FILTER (WHERE sides < 2) - 1, max(n)) AS prompt_turns
  FROM (SELECT pair_id, n, count(*) OVER (PARTITION BY pair_id, n, role, text) AS sides FROM ranked) GROUP BY pair_id
), placed AS (
  SELECT ranked.*, prompt_turns, n <= prompt_turns AS shared,
    sum(length(shown)) OVER (PARTITION BY side, pair_id, n <= prompt_turns ORDER BY n) AS until
  FROM ranked JOIN prefix USING (pair_id)
)
SELECT pair_id, any_value(prompt_turns) AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (WHERE shared AND side = 'chosen'), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (WHERE NOT shared AND side = 'chosen'), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (WHERE NOT shared AND side = 'rejected'), '') AS rejected,
  coalesce(string_agg((until - length(text) - 11)::BIGINT || '-' || until::BIGINT, ',' ORDER BY n)
    FILTER (WHERE NOT shared AND side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((until - length(text) - 11)::BIGINT || '-' || until::BIGINT, ',' ORDER BY n)
    FILTER (WHERE NOT shared AND side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), seen AS (
  SELECT lang, 1 AS words, w[i] AS phrase FROM spots
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM spots WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spots WHERE i + 2 <= len(w)
), f AS (
  SELECT lang, words, phrase, count(*) AS n FROM seen GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::BIGINT AS total FROM f WHERE words = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, words, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1 AND n >= 10)
), valued AS (
  SELECT c.*, h.n AS l, t.n AS r, ((1000000::HUGEINT * a * a) // (h.n::HUGEINT * t.n))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.phrase = tail
), lowest AS (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, n
  FROM f WHERE words = 3 AND n >= 10
), kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM longer b WHERE b.lang = c.lang AND b.phrase = c.phrase AND 100 * b.n >= 50 * c.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, total AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
