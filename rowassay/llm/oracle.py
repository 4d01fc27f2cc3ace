"""DuckDB twins of the operators that SQL can express."""

from rowassay.llm.chat import END, SAYS, TURN

SQL = {
    "op2_cap_filters": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
        ), reach AS (
            SELECT vec_id AS node, vec_id AS seen FROM v
            UNION
            SELECT node, b FROM reach JOIN l ON seen = a
        ), root AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
        degree AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN root ON vec_id = node LEFT JOIN degree ON vec_id = a""",
    "op4_bit_sliced": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_chat_parts": f"""
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(i, r)
        ), e AS (
            SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) + {len(TURN + SAYS + END)} AS n FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_iceberg_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        by_doc AS (SELECT id, lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM by_doc GROUP BY lang, term HAVING count(*) >= 3),
        langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
        cells AS (SELECT lang, source, term, sum(b.n)::HUGEINT AS n FROM by_doc b JOIN kept USING (lang, term) GROUP BY ALL),
        totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY ALL),
        groups AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source)),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
            FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
                SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
        ), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
