"""The corpus queries in SQL, where SQL can express them."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(13)"

ORACLES = {
    "op3_line_dedup": f"""
        WITH split AS (
          SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), spread AS (
          SELECT trim(line, {_BLANK}) AS line
          FROM (SELECT source, unnest(lines) AS line FROM split)
          GROUP BY trim(line, {_BLANK})
          HAVING count(DISTINCT source) >= 10 AND trim(line, {_BLANK}) <> ''
        ), bad AS (SELECT list(line) AS lines FROM spread),
        kept AS (
          SELECT doc_id, s.lines,
                 list_filter(s.lines, lambda x: NOT list_contains(b.lines, trim(x, {_BLANK}))) AS stays
          FROM split s, (SELECT coalesce(lines, []) AS lines FROM bad) b
        )
        SELECT doc_id, len(lines) AS n_lines, len(lines) - len(stays) AS n_removed,
               sha256(array_to_string(stays, chr(10))) AS text_sha256
        FROM kept
    """,
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op5_url_filters": r"""
        WITH rules(rhost, rpath, rverdict) AS (
          VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), p AS (
          SELECT page_id,
                 coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
          FROM pages
        ), numbered AS (SELECT *, row_number() OVER () AS i FROM p),
        best AS (
          SELECT i, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
                 max_by(rverdict, length(rhost || rpath)) AS verdict
          FROM numbered JOIN rules
            ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
          GROUP BY i
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM numbered LEFT JOIN best USING (i)
    """,
    "op6_chat_formatting": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(text, '') AS text,
                 regexp_replace(coalesce(role, 'unknown'), '[\r\n]+|<\|', ' ', 'g') AS role
          FROM conversations
        ), numbered AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i FROM t
        ), who AS (SELECT DISTINCT conv_id AS of_id, role AS perspective FROM t WHERE role <> 'system'),
        seg AS (
          SELECT conv_id, perspective, i // 512 AS part, i, role,
                 '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
                                        ELSE 'user name=' || role END || chr(10) AS head,
                 replace(text, '<|', '< |') || '<|im_end|>' AS body
          FROM numbered JOIN who ON conv_id IS NOT DISTINCT FROM of_id
        ), placed AS (
          SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS start
          FROM seg WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY i ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, perspective, part::BIGINT AS part, count(*) AS n_turns,
               sum(length(head) + length(body) + 1)::BIGINT AS n_chars,
               sha256(string_agg(head || body || chr(10), '' ORDER BY i)) AS text_sha256,
               coalesce(string_agg(start::BIGINT::VARCHAR || '-' || (start + length(body))::BIGINT::VARCHAR, ','
                          ORDER BY i) FILTER (role = perspective), '') AS spans
        FROM placed GROUP BY conv_id, perspective, part
    """,
    "op10_mixing": """
        WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        rates AS (
          SELECT source, round(pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM sizes)
                               * (SELECT sum(n) FROM sizes)::DOUBLE / n, 9) AS rate
          FROM sizes
        ), steps(source, rate, k, p, c) AS (
          SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
          UNION ALL
          SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps
          WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 20)
        ), drawn AS (
          SELECT doc_id, source, text,
                 (('0x' || substr(md5('16/0:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE)
                   / 4503599627370496.0::DOUBLE AS u
          FROM documents
        ), times AS (
          SELECT doc_id, d.source, any_value(text) AS text, count(*) FILTER (c < u) AS n
          FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY doc_id, d.source
        ), copies AS (SELECT doc_id, source, text, unnest(range(n)) AS i FROM times)
        SELECT doc_id, source, text, i::INTEGER AS copy,
               md5('16:' || doc_id::VARCHAR || '/' || i::VARCHAR) AS shuffle_key
        FROM copies
    """,
    "op11_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
          FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank
          FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
