"""DuckDB statements for the queries that SQL can express."""

WHITE = "[\\x20\\x09-\\x0D]+"
AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingles(table: str, key: str) -> str:
    """Distinct five-word shingles of each text; shorter texts are one shingle."""
    words = f"regexp_extract_all({AZ.format('text')}, '[^\\x20\\x09-\\x0D]+')"
    return f"""
        SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN []
            ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
                lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
        FROM (SELECT {key}, {words} AS w FROM {table})"""


OP8 = f"""
WITH item AS ({shingles('benchmark', 'item_id')}),
doc AS ({shingles('documents', 'doc_id')}),
size AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
found AS (
    SELECT doc_id, item_id, count(*) AS n_found FROM doc JOIN item USING (s)
    GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, n_found,
    CAST(n_found AS DOUBLE) / n AS containment
FROM found JOIN size USING (item_id) WHERE 5 * n_found >= 4 * n
"""

NOTICES = """('mit', 'released under the mit license'),
('mit', 'licensed under the mit license'),
('apache-2', 'licensed under the apache license version 2 0'),
('gpl-3', 'licensed under the gnu general public license version 3'),
('gpl-2', 'licensed under the gnu general public license version 2'),
('agpl-3', 'licensed under the gnu affero general public license version 3'),
('lgpl-3', 'licensed under the gnu lesser general public license version 3'),
('mpl-2', 'subject to the terms of the mozilla public license version 2 0'),
('bsd-3', 'licensed under the bsd 3 clause license'),
('isc', 'licensed under the isc license'),
('cc-by-nc', 'licensed under cc by nc 4 0'),
('cc-by-sa', 'licensed under cc by sa 4 0'),
('cc-by-nd', 'licensed under cc by nd 4 0'),
('cc0', 'dedicated to the public domain under cc0 1 0')"""
PASSAGES = """('mit', 'permission is hereby granted free of charge to any person obtaining a copy of
this software and associated documentation files the software to deal in the software without
restriction'),
('bsd-3', 'redistribution and use in source and binary forms with or without modification are
permitted provided that the following conditions are met'),
('isc', 'permission to use copy modify and or distribute this software for any purpose with or
without fee is hereby granted'),
('unlicense', 'this is free and unencumbered software released into the public domain')"""
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def matched(blocks: str, templates: str) -> str:
    """Templates of which a block has nine in ten distinct words."""
    return f"""
        SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS c
        FROM (SELECT doc_id, list_distinct(regexp_extract_all(unnest({blocks}), '{WORD}')) AS b
              FROM d),
        (SELECT label, list_distinct(regexp_split_to_array(text, '\\s+')) AS t
         FROM (VALUES {templates}) v(label, text))
        WHERE 10 * len(list_intersect(t, b)) >= 9 * len(t)"""


OP1 = f"""
WITH d AS (SELECT doc_id, {AZ.format("coalesce(text, '')")} AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM d),
p AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'),
    (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc'))
    v(phrase, label)),
spot AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1),
    lambda i: w[i:i + len(phrase) - 1] = phrase)) - 1 AS place FROM w, p),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spot GROUP BY doc_id),
m AS ({matched("string_split(text, chr(10))", NOTICES)}
    UNION ALL {matched("regexp_split_to_array(text, chr(10) || '[ \\t\\r\\f\\v]*' || chr(10))", PASSAGES)}),
found AS (SELECT doc_id, label, c FROM m UNION ALL SELECT doc_id, label, 1.0 FROM spot),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(c) AS score FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word,
    last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def parts(url: str) -> str:
    rest = f"""CASE WHEN instr({url}, '://') > 0
        THEN substring({url}, instr({url}, '://') + 3) ELSE '' END"""
    return f"""{AZ.format(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} AS host,
        regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract({rest}, '^[^?#]*([?][^#]*)?', 1) AS query, {rest} AS rest"""


def ruled(table: str) -> str:
    return f"""SELECT t.*, r.rule, r.verdict FROM {table} t LEFT JOIN LATERAL (
        SELECT rule, verdict FROM (VALUES ('com', '/', 'com/', 'allow'),
            ('example.com', '/en/', 'example.com/en/', 'block'),
            ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
            ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block'))
            v(h, p, rule, verdict)
        WHERE (t.host = h OR ends_with(t.host, '.' || h)) AND starts_with(t.path, p)
        ORDER BY length(rule) DESC LIMIT 1) r ON true"""


OP6 = f"""
WITH RECURSIVE page AS (SELECT *, CASE WHEN rest != '' THEN host || path || query END AS node
    FROM (SELECT page_id, html, {parts("coalesce(url, '')")} FROM pages)),
link AS (SELECT host, path, node, replace(unnest([
    regexp_extract(html, '(?i)<link[^>]*rel=.?canonical[^>]*href=["'']?([^"''\\s>]+)', 1),
    regexp_extract(html, '(?i)<link[^>]*href=["'']?([^"''\\s>]+)[^>]*rel=.?canonical', 1),
    regexp_extract(html, '(?i)<meta[^>]*http-equiv=.?refresh[^>]*url=([^"''\\s>]+)', 1)]), '&amp;', '&') AS l
    FROM page WHERE node IS NOT NULL),
target AS (SELECT node AS a, CASE WHEN contains(l, '://') THEN l
    WHEN starts_with(l, '//') THEN 'http:' || l
    WHEN starts_with(l, '/') THEN 'http://' || host || l
    ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)[^/]*$', 1), ''), '/')
        || l END AS url FROM link WHERE l != ''),
edge AS (SELECT a, host || path || query AS b FROM (SELECT a, {parts('url')} FROM target)
    WHERE rest != ''),
ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a, a AS b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
node AS (SELECT DISTINCT b, {parts("'x://' || b")} FROM reach),
alias AS (SELECT r.a FROM reach r JOIN ({ruled('node')}) n ON r.b = n.b GROUP BY r.a
    HAVING bool_or(coalesce(n.verdict = 'block', false))
        AND NOT bool_or(coalesce(n.verdict = 'allow', false)))
SELECT page_id, host, path, rule,
    CASE WHEN verdict IS NOT NULL THEN verdict WHEN alias.a IS NOT NULL THEN 'block'
        ELSE 'allow' END AS verdict
FROM ({ruled('page')}) LEFT JOIN alias ON alias.a = node
"""

OP11 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x != 0)) > 0 AS good FROM embeddings),
link AS (SELECT x.i AS a, y.i AS b FROM v x JOIN v y
    ON x.label = y.label AND x.i != y.i AND len(x.e) = len(y.e)
    WHERE x.good AND y.good AND list_cosine_similarity(x.e, y.e) >= 0.93),
reach AS (SELECT i AS a, i AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON b = i GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id,
    vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN low ON low.a = i LEFT JOIN degree ON degree.a = i
"""

# crc32 of the decimal id, bit by bit from the lowest of each byte
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    flatten([[(ord(c) >> k) & 1 for k in range(8)] for c in string_split(doc_id::VARCHAR, '')])),
    lambda crc, bit: xor(crc >> 1, 3988292384::BIGINT * (xor(crc, bit) & 1))))"""


def fields(*names: str) -> str:
    return " || ".join(
        f"coalesce(octet_length(encode(({n})::VARCHAR)) || ':' || ({n})::VARCHAR, '-')" for n in names
    )


OP12 = f"""
WITH RECURSIVE leaf AS (SELECT doc_id, lang, row_number() OVER (
        PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, changed
    FROM (SELECT doc_id, lang, sha256({fields('doc_id', 'source', 'lang', 'n_chars', 'text')}) AS h,
        CASE WHEN {CRC32} % 7 = 0 AND n_chars IS NOT NULL THEN
            sha256({fields('doc_id', 'source', 'lang', 'n_chars + 1', 'text')}) END AS changed
        FROM documents)),
tree AS (SELECT 0 AS up, lang, pos, h, count(*) OVER (PARTITION BY lang) AS n FROM leaf
    UNION ALL SELECT up + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM tree WHERE n > 1 GROUP BY up, lang, pos // 2, n),
top AS (SELECT lang, h AS subroot, up AS rise,
    row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM tree WHERE n = 1),
crown AS (SELECT 0 AS up, place AS pos, subroot AS h, count(*) OVER () AS n FROM top
    UNION ALL SELECT up + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM crown WHERE n > 1 GROUP BY up, pos // 2, n),
every AS (SELECT t.lang, t.up, t.pos, t.h FROM tree t JOIN top ON t.lang IS NOT DISTINCT FROM top.lang
        WHERE t.up < top.rise
    UNION ALL SELECT top.lang, top.rise + c.up, c.pos, c.h FROM top JOIN crown c ON c.n > 1),
walk AS (SELECT doc_id, leaf.lang, pos AS start, h AS leaf, 0 AS up, pos, place, subroot, rise,
        coalesce(changed, h) AS seen, '' AS proof
        FROM leaf JOIN top ON leaf.lang IS NOT DISTINCT FROM top.lang
    UNION ALL SELECT doc_id, w.lang, start, leaf, w.up + 1, here // 2, place, subroot, rise,
        CASE WHEN e.h IS NULL THEN sha256(seen) WHEN here % 2 = 1 THEN sha256(e.h || seen)
            ELSE sha256(seen || e.h) END, proof || coalesce(e.h, '')
    FROM (SELECT *, CASE WHEN up = rise THEN place ELSE pos END AS here FROM walk
        WHERE up < rise + (SELECT max(up) FROM crown)) w
    LEFT JOIN every e ON w.lang IS NOT DISTINCT FROM e.lang AND w.up = e.up
        AND e.pos = CASE WHEN here % 2 = 1 THEN here - 1 ELSE here + 1 END)
SELECT doc_id, leaf, subroot, c.h AS root, sha256(proof) AS proof_sha256, seen AS folded_root,
    seen = c.h AS verified
FROM walk, (SELECT up, h FROM crown WHERE n = 1) c WHERE walk.up = rise + c.up
"""

TERMS = f"regexp_extract_all({AZ.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {TERMS} AS w FROM documents),
total AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM doc WHERE len(w) > 0),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM doc) GROUP BY d, t),
item AS (SELECT i, item_id, unnest(list_distinct(w)) AS t FROM (
    SELECT row_number() OVER () AS i, item_id, {TERMS} AS w FROM benchmark)),
weight AS (SELECT t, floor(1000 * ln((2 * N + 2) / (2 * df + 1)))::BIGINT AS w FROM (
    SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM item) GROUP BY t), total),
impact AS (SELECT d, t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(doc.w) * N) // L)) AS v
    FROM tf JOIN doc USING (d), total WHERE t IN (SELECT t FROM item)),
score AS (SELECT i, item_id, d, sum(w * v)::BIGINT AS score
    FROM item JOIN weight USING (t) JOIN impact USING (t) GROUP BY i, item_id, d),
placed AS (SELECT item_id, row_number() OVER (
        PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
    FROM score JOIN doc USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": OP1,
    "op6_url_rules": OP6,
    "op8_decontamination": OP8,
    "op11_embedding_links": OP11,
    "op12_merkle_manifest": OP12,
    "op13_ranked_search": OP13,
}
