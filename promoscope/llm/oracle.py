"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from promoscope.llm.common import LOWER, UPPER

# Fixed values of the quality rules, written out here so that the SQL does not lean on the operator's lists.
MENU_WORDS = ["about", "archive", "back", "categories", "contact", "faq", "help", "home", "login", "logout", "menu", "more",
              "newsletter", "next", "previous", "register", "search", "share", "sitemap", "subscribe", "tags", "top", "tweet"]
FURNITURE = ["accept cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript",
             "javascript is disabled", "lorem ipsum", "privacy policy", "sign up for our", "skip to content",
             "terms of service", "terms of use"]
SENTENCE_END = ".!?…:;\"'”’»)]。！？：；」』｡।॥۔؟؛։።፧។៕၊။๚๛༎"
WORD = r"[^\x20\x09-\x0D]+"
NEWLINE = "chr(10)"


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(items))


# the 160 bits of a SHA-1 in groups of five: two hexadecimal digits hold each group
_NIBBLE = "(strpos('0123456789abcdef', substr(hex, {0} + 1, 1)) - 1)"
_GROUP = (f"(({_NIBBLE.format('(5 * i // 4)')} * 16 + {_NIBBLE.format('(5 * i // 4 + 1)')}) "
          "// (CAST(1 AS BIGINT) << CAST(3 - (5 * i) % 4 AS INTEGER))) % 32")
WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_GROUP} AS INTEGER) + 1, 1)), 'string_agg', '')
           AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""

LINES = f"""
WITH l AS (
    SELECT doc_id, i, ls[i] AS line,
           translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), {NEWLINE}) AS ls FROM documents))),
     frequent AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
     marked AS (SELECT l.*, f.key IS NOT NULL AS gone FROM l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, {NEWLINE} ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_ENDS = SENTENCE_END.replace("'", "''")
_LOWER_START = r"^[a-z\x{00DF}-\x{00F6}\x{00F8}-\x{00FF}\x{03B1}-\x{03C9}\x{0430}-\x{045F}]"
QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM t),
     base AS (
         SELECT doc_id, len(ws) AS n_words,
                length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
     tri AS (
         SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
     twice AS (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) > 1),
     rep AS (
         SELECT doc_id, count(DISTINCT place) AS n_repeat_words
         FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM tri JOIN twice USING (doc_id, g))
         GROUP BY doc_id),
     split AS (SELECT doc_id, string_split(text, {NEWLINE}) AS ls FROM t),
     each AS (SELECT doc_id, i, ls[i] AS line, regexp_extract_all(ls[i], '{WORD}') AS lw
              FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
     lines AS (
         SELECT *, lag(lw) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(lw) OVER (PARTITION BY doc_id ORDER BY i) AS after
         FROM each),
     full_lines AS (
         SELECT *, length(regexp_replace(line, '[^|»>]', '', 'g')) AS separators,
                len(lw) >= 5 AND (
                    (coalesce(len(after), 0) > 0 AND regexp_matches(after[1], '{_LOWER_START}'))
                    OR (coalesce(len(before), 0) > 0 AND NOT contains('{_ENDS}', right(before[len(before)], 1))
                        AND regexp_matches(lw[1], '{_LOWER_START}'))) AS wrapped
         FROM lines WHERE len(lw) > 0),
     faults AS (
         SELECT doc_id, line, length(list_aggregate(lw, 'string_agg', '')) AS n,
                CASE WHEN separators >= 2 AND separators * 8 >= len(lw) THEN 'navigation'
                     WHEN len(lw) <= 6 AND len(list_filter(lw, lambda x: lower(x) NOT IN ({quoted(MENU_WORDS)}))) = 0
                     THEN 'navigation'
                     WHEN len(lw) <= 25 AND ({' OR '.join(f"contains(lower(line), '{p}')" for p in FURNITURE)}) THEN 'boilerplate'
                     WHEN len(list_filter(lw, lambda x: contains('{_ENDS}', right(x, 1)))) = 0
                     THEN CASE WHEN NOT wrapped THEN 'punctuation' END
                     WHEN len(list_filter(lw, lambda x: regexp_matches(x, '[#*$%&|<>!?]{{2,}}$'))) > 0.5 * len(lw)
                     THEN 'punctuation' END AS fault
         FROM full_lines),
     by_doc AS (
         SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
                count(*) FILTER (WHERE fault = 'navigation') AS n_navigation,
                count(*) FILTER (WHERE fault = 'boilerplate') AS n_boilerplate,
                count(*) FILTER (WHERE fault = 'punctuation') AS n_punctuation,
                CAST(coalesce(sum(n) FILTER (WHERE fault IS NOT NULL), 0) AS BIGINT) AS lost
         FROM faults GROUP BY doc_id),
     v AS (
         SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_navigation, 0) AS n_navigation,
                coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_punctuation, 0) AS n_punctuation,
                coalesce(lost, 0) AS lost,
                n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
         FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN by_doc USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= 0.5 * word_chars AS kept, n_navigation, n_boilerplate, n_punctuation,
       CASE WHEN word_chars > 0 THEN CAST(lost AS DOUBLE) / word_chars ELSE 0.0 END AS lost_share
FROM v"""

NEGATIVES = """
WITH r AS (
         SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
         FROM embeddings
         WHERE label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (
         SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
         FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (
         SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
         QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
     AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM documents),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM benchmark),
     tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
     len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
     total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
     m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM len, total),
     w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
     s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""

ORACLE = {"op1_warc": WARC, "op7_line_dedup": LINES, "op10_line_quality": QUALITY,
          "op12_hard_negatives": NEGATIVES, "op13_bag_search": RANKED}
