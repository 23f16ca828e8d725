"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

OP2 = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50), h AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h FROM g),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM m WHERE first < doc_id), k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d), r AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) AS kept FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.i = a.i WHERE c.i IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)"""

OP4 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""

OP9 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT doc_id, x, len(x) // 2 AS n FROM d),
g AS (SELECT doc_id, unnest(range(0, n - 399)) AS s, x FROM n WHERE n >= 400), h AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 800)) AS h FROM g),
m AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
e AS (SELECT doc_id, s, s > coalesce(max(s + 400) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM m),
i AS (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM e), sp AS (SELECT doc_id, k, min(s) AS a, max(s) + 400 AS b FROM i GROUP BY ALL),
o AS (SELECT doc_id, list({'a': a, 'b': b} ORDER BY a) AS sp FROM sp GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(list_sum(list_transform(sp, lambda z: z.b - z.a)), 0)::BIGINT AS n_removed, coalesce(len(sp), 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN sp IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(sp) + 1), lambda j: substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * sp[j].b + 1 END, CASE WHEN j = len(sp) THEN 2 * n ELSE 2 * sp[j + 1].a END - CASE WHEN j = 0 THEN 0 ELSE 2 * sp[j].b END)), '') END)) AS kept_sha256
FROM n LEFT JOIN o USING (doc_id)"""


OP11 = r"""WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
  FROM w, range(1, 5) AS s(size) WHERE len(w) >= size) GROUP BY ALL HAVING count(*) >= 30),
p AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
e AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM p, range(1, 4) AS t(k) WHERE k < size),
c AS (SELECT e.*, x.a AS l, y.a AS r, (2000000::HUGEINT * e.a) // (x.a + y.a) AS score FROM e JOIN f x ON x.lang = e.lang AND x.phrase = e.head JOIN f y ON y.lang = e.lang AND y.phrase = e.tail),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, array_to_string(w[i : i + z - 1], ' ') AS phrase, max(a) AS longer FROM p, range(2, 4) AS t(z), range(1, 4) AS u(i) WHERE z < size AND i + z - 1 <= size GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000"""

OP12 = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM f JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

OP13 = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
m AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT k.doc_id, i, line, m.key IS NOT NULL AND last <> k.doc_id AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": OP2, "op4_exact_top_k": OP4, "op9_suffix_array_dedup": OP9, "op11_phrase_collocations": OP11, "op12_source_divergence": OP12, "op13_line_dedup": OP13,
    }
