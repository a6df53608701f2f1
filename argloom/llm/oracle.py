"""SQL for DuckDB whose length would bury the queries it stands beside."""

from __future__ import annotations

FILL_IN_MIDDLE = """
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
        FROM documents
    ), cuts AS (
        SELECT *, len(units) AS n,
               ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS c2,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                      OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                    WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ), parts AS (
        SELECT *, coalesce(array_to_string(list_slice(units, 1, least(c1, c2)), ''), '') AS prefix,
               coalesce(array_to_string(list_slice(units, least(c1, c2) + 1, greatest(c1, c2)), ''), '') AS middle,
               coalesce(array_to_string(list_slice(units, greatest(c1, c2) + 1, n), ''), '') AS suffix
        FROM cuts
    )
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text
                  WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
"""

# The cheapest edits turn by turn: places are 0 start, 1 after s, 2 after u, 3 after a.
REPAIR = """
    WITH RECURSIVE powers AS (
        SELECT list(c ORDER BY n) AS t FROM (
            SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM range(256) r(n))
    ), named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
        FROM conversations
    ), drawn AS (
        SELECT * EXCLUDE (t), xor(list_reduce(
                list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw
        FROM named, powers
    ), damaged AS (
        SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
               CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM drawn, range(2) copies(copy) WHERE draw <> 0 AND (copy = 0 OR draw = 3)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged
    ), judged AS (
        SELECT *, left(role, 1) AS initial,
               CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                    WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
               END AS fault,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
        FROM placed
    ), inserted(p, q, plus, letters) AS (
        VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'),
               (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')
    ), steps(p, initial, q) AS (
        VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
    ), options AS (
        SELECT conv_id, k, p, p AS q, 2 AS plus, 'D' AS letter FROM judged, (VALUES (0), (1), (2), (3)) places(p)
        UNION ALL
        SELECT conv_id, k, p, q, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K'
        FROM judged JOIN steps USING (initial) WHERE fault IS NULL OR fault = 'truncated'
        UNION ALL
        SELECT conv_id, k, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R'
        FROM judged, steps WHERE steps.initial IN ('u', 'a') AND (fault IS NULL OR fault = 'truncated')
    ), ways AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS place, '00000000' AS way FROM conversations
        UNION ALL
        SELECT o.conv_id, o.k, o.q, min(printf('%08d', way[1:8]::INTEGER + i.plus + o.plus) || way[9:] || i.letters || o.letter)
        FROM ways w JOIN inserted i ON i.p = w.place
          JOIN options o ON o.conv_id = w.conv_id AND o.k = w.k + 1 AND o.p = i.q
        GROUP BY o.conv_id, o.k, o.q
    ), sums AS (
        SELECT c.conv_id, count(k) AS rows,
               coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged USING (conv_id) GROUP BY c.conv_id
    ), chosen AS (
        SELECT s.*, (best[1:8])::BIGINT AS cost, best[9:] AS audit FROM sums s JOIN (
            SELECT w.conv_id, w.k, min(printf('%08d', way[1:8]::INTEGER + i.plus) || way[9:] || i.letters) AS best
            FROM ways w JOIN inserted i ON i.p = w.place WHERE i.q IN (0, 3) GROUP BY w.conv_id, w.k
        ) b ON b.conv_id = s.conv_id AND b.k = s.rows
    ), letters AS (
        SELECT conv_id, i, audit[i] AS letter,
               length(replace(audit[1:i], 'I', '')) AS k, length(replace(audit[1:i], 'D', '')) AS out
        FROM chosen, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS i)
    ), kept AS (
        SELECT l.*, j.role, j.text, j.initial,
               max((letter = 'K' AND initial = 's')::INTEGER) OVER (PARTITION BY l.conv_id) AS system
        FROM letters l LEFT JOIN judged j ON j.conv_id = l.conv_id AND j.k = l.k AND letter <> 'I' WHERE letter <> 'D'
    ), mended AS (
        SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE (out - system) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
               || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS repaired
        FROM kept GROUP BY conv_id
    )
    SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM chosen LEFT JOIN mended USING (conv_id)
"""
