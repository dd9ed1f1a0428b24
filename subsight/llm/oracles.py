"""SQL, as DuckDB runs it, for those queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op1_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS g FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY g, n) END AS f FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest,
  CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM m""",
    "op2_line_windows": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM b WHERE bare <> ''),
w AS (SELECT doc_id, i, bare || chr(10) || lead(bare) OVER d || chr(10) || lead(bare, 2) OVER d AS run
    FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM w WHERE run IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS t(k)),
g AS (SELECT s.doc_id, s.p FROM s JOIN c USING (doc_id, i)),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS kept, count(*) AS n
    FROM l ANTI JOIN g USING (doc_id, p) GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS gone FROM g GROUP BY doc_id)
SELECT documents.doc_id,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(kept, '') END AS text,
  CAST(coalesce(gone, 0) AS INT) AS lines_removed
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op3_source_mix": r"""
WITH z AS (SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
d AS (SELECT *, length(bin(size)) * 8 - 8 + ((size * 8) >> (length(bin(size)) - 1)) AS cls,
    CAST('0x' || substr(md5('11:' || doc_id), 1, 15) AS BIGINT) AS draw FROM z),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
    CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
f AS (SELECT cap / weight AS fill, sum(cap) AS caps, sum(weight) AS weights FROM o GROUP BY 1),
u AS (SELECT *, sum(caps) OVER (ORDER BY fill) - caps AS caps_before,
    sum(weights) OVER () - (sum(weights) OVER (ORDER BY fill) - weights) AS open FROM f),
v AS (SELECT fill, ((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - caps_before) / open AS level FROM u),
x AS (SELECT min_by(level, fill) AS level FROM v WHERE level <= fill),
t AS (SELECT source, source_size, coalesce(least(cap, weight * level), cap) AS target FROM o, x),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('11:source:' || coalesce(source, '')), 1, 15) AS BIGINT)
      / CAST(1152921504606846976 AS DOUBLE) AS start FROM t),
n AS (SELECT source, cls, count(*) AS n, sum(count(*)) OVER (PARTITION BY source ORDER BY cls) AS upto FROM d GROUP BY source, cls),
k AS (SELECT n.source, cls, source_size, target, rate,
    floor(start + CAST(upto AS DOUBLE) * (rate - floor(rate)))
      - floor(start + CAST(upto - n AS DOUBLE) * (rate - floor(rate))) AS wanted
    FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source),
q AS (SELECT d.*, source_size, target, rate, wanted, rank() OVER (PARTITION BY d.source, d.cls ORDER BY draw) AS place
    FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.cls = k.cls)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN place <= wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q""",
    "op11_phrase_collocations": r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(low, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
    FROM q, (VALUES (1), (2), (3), (4)) AS v(s) WHERE len(w) >= s),
c AS (SELECT lang, s, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, s, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE s = 1 GROUP BY lang),
a AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE s > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, s)) AS k FROM a),
x AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, (2000000 * k.a) // (l.f + r.f) AS score FROM k
    JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
    JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, a, unnest([array_to_string(w[1:s - 1], ' '), array_to_string(w[2:], ' ')]
    || CASE WHEN s = 4 THEN [array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '), array_to_string(w[3:], ' ')]
       ELSE [] END) AS phrase FROM a WHERE s > 2),
h AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY lang, phrase),
b AS (SELECT m.* FROM m LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * m.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
  CAST(score AS BIGINT) AS score
FROM z JOIN n USING (lang) WHERE rank <= 2000""",
}
