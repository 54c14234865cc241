"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

_ROW_TEXT = r"""'\### Assistant: </turn> ok'"""

OP4 = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', {_ROW_TEXT} UNION ALL SELECT -7, 1, 'assistant', {_ROW_TEXT}
), shown AS (
    SELECT *,
        CASE WHEN contains(text, '### ') OR contains(text, '</turn>') OR contains(text, '\b') OR contains(text, '\h') OR contains(text, '\l')
             THEN 1 ELSE 0 END AS escaped
    FROM rows
), sized AS (
    SELECT *, length(text) + escaped * (length(text) * 3 - length(replace(text, '\', '')) - length(replace(text, '#', ''))
                                        - length(replace(text, '<', ''))) AS shown_chars
    FROM shown
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(4 + length(role) + 2 + shown_chars + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PLAIN_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

OP3 = f"""
WITH d AS (
    SELECT doc_id, {_BENCH_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents
), b AS (
    SELECT item_id, {_BENCH_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows), doc_windows AS (
    SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, item_id, s, n FROM doc_windows JOIN item_windows USING (n, win)
), words_hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP7 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, {_PLAIN_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS sh
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.seen
), component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN component ON component.node = d.doc_id
"""

OP9 = """
WITH RECURSIVE e AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), sound AS (
    SELECT vec_id, v FROM e
    WHERE v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0
), ways AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM ways GROUP BY a), reach AS (
    SELECT vec_id AS node, vec_id AS seen FROM e
    UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.seen
), component AS (SELECT node AS vec_id, min(seen) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e LEFT JOIN n USING (vec_id) JOIN component USING (vec_id)
"""

OP10 = f"""
WITH d AS (
    SELECT doc_id, {_PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM documents
), windows AS (
    SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)
), first AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM windows JOIN first USING (win) WHERE doc_id > first
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0
), left_over AS (
    SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
    FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over ON left_over.doc_id = d.doc_id
"""

#: The tables' pages mark the main text up as an article of paragraphs without anything else inside; SQL reads just that.
OP11 = r"""
WITH article AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS inside FROM pages
), parts AS (
    SELECT page_id, url, list_transform(regexp_split_to_array(inside, '</?(?:p|h1)>'),
        lambda x: trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(x, '<br>', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
            '&amp;?', '&', 'g'), '&#x27;', chr(39)), '\s+', ' ', 'g'))) AS parts
    FROM article
), joined AS (
    SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM parts
)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""

ORACLE_SQL = {"op3_decontamination": OP3, "op4_chat": OP4, "op6_warc": OP6, "op7_near_dup": OP7, "op9_embed_dup": OP9,
              "op10_substring_dedup": OP10, "op11_html": OP11}
