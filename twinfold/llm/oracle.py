"""DuckDB twins of the queries that SQL can express, written from their contracts alone.

They compare everything with everything (all windows, all strings, all variants as text) and know nothing of the
operators' keys. Queries with a trained model, a Feistel network or their own hash functions have none.
"""

from __future__ import annotations

from twinfold.llm import mixing

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
         FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                FROM d, (SELECT DISTINCT k FROM wins) ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT g.doc_id, g.i, g.k, x.item_id FROM grams g JOIN wins x ON g.k = x.k AND g.s = x.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS s
            FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d WHERE len(h) >= 400)),
again AS (SELECT doc_id, p FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 200 THEN 0 ELSE 1 END AS opens
           FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY doc_id, span),
pieces AS (SELECT s.doc_id, s.a, substr(d.h, 2 * coalesce(lag(s.b) OVER w, 0) + 1,
                  2 * (s.a - coalesce(lag(s.b) OVER w, 0))) AS piece
           FROM spans s JOIN d ON s.doc_id = d.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.a)),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS k FROM pieces GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed,
       coalesce(s.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.k, '') || substr(d.h, 2 * coalesce(s.last, 0)::BIGINT + 1))) AS kept_sha256
FROM d LEFT JOIN sums s ON d.doc_id = s.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP8 = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos
               FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, pos, line, t, string_split(t, ' ') AS w
        FROM (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM lines)),
judged AS (SELECT * FROM cut WHERE t <> ''),
firsts AS (SELECT t, any_value(w) AS w, min(row(doc_id, pos)) AS o FROM judged GROUP BY t),
variants AS (SELECT t, o, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS rest, len(w) AS n
             FROM (SELECT t, o, w, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 5)),
replaced AS (SELECT t FROM (SELECT t, o, min(o) OVER (PARTITION BY n, i, rest) AS least FROM variants) WHERE least < o),
inserted AS (SELECT CASE WHEN f.o < v.o THEN v.t ELSE f.t END AS t
             FROM variants v JOIN firsts f ON v.rest = f.t AND v.n = len(f.w) + 1 AND len(f.w) >= 5),
near AS (SELECT t FROM replaced UNION SELECT t FROM inserted),
stay AS (SELECT c.doc_id, c.pos, c.line FROM cut c LEFT JOIN firsts f ON c.t = f.t
         WHERE c.t = '' OR (row(c.doc_id, c.pos) = f.o AND c.t NOT IN (SELECT t FROM near))),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM stay GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_lines, coalesce(t.n, 0) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN total t ON d.doc_id = t.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP12 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.u LEFT JOIN n ON v.vec_id = n.u
"""

OP13 = """
WITH turns AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(k := k, bytes := bytes) ORDER BY turn NULLS FIRST, k) AS t FROM turns GROUP BY conv_id),
-- CRC-32 bit by bit: a list of each digit's code and eight shifts.
crc AS (SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
          lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 9 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.t, [])[:c.h], c.t[c.h + 1:]) AS t
            FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - ((c.conv_id % 5) + 5) % 5),
paths AS (SELECT conv_id, list_transform(t, lambda x: x.k) AS p, list_transform(t, lambda x: x.bytes) AS bytes FROM rebuilt),
steps AS (SELECT conv_id, p, bytes, unnest(range(0, len(p) + 1)) AS d FROM paths),
nodes AS (SELECT d, p[:d] AS node, min(conv_id) AS rep, count(*) AS n, (count(*) - 1) * coalesce(max(bytes[d]), 0) AS cost,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(p) = d), '') AS ends FROM steps GROUP BY d, p[:d]),
kids AS (SELECT d - 1 AS d, node[:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
above AS (SELECT node, cost, k.n IS NULL AS leaf, unnest(range(0, nodes.d + 1)) AS up FROM nodes LEFT JOIN kids k USING (d, node)),
sums AS (SELECT up AS d, node[:up] AS node, sum(cost) AS saved, count(*) FILTER (leaf) AS leaves FROM above GROUP BY ALL)
SELECT o.rep AS conv_id, o.d AS depth, q.rep AS parent_conv_id, o.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM nodes o JOIN sums s USING (d, node) LEFT JOIN kids k USING (d, node) LEFT JOIN nodes q ON q.d = o.d - 1 AND q.node = o.node[:o.d - 1]
"""

SQL = {
    "op4_decontaminate": OP4,
    "op5_suffix_dedup": OP5,
    "op8_line_dedup": OP8,
    "op10_mixing": mixing.SQL,
    "op12_embedding_pq": OP12,
    "op13_turn_trie": OP13,
}
