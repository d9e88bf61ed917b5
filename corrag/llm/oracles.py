"""SQL counterparts of the n-gram join, the vector search and substring dedup, for tables of test size."""

_REACHED = """reached(id, other) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other)"""

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
elements AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS e
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id
  GROUP BY ALL),
pairs AS (SELECT a, b, c, x.n AS na, y.n AS nb FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c)),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACHED},
classes AS (SELECT a, min(b) AS b FROM pairs WHERE na = c AND nb = c GROUP BY a)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       (SELECT min(other) FROM reached r WHERE r.id = w.doc_id) AS component_id,
       least(w.doc_id, coalesce(c.b, w.doc_id)) AS class_id
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN classes c ON c.a = w.doc_id
"""

NEARDUP = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACHED},
labels_ AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM labels_
"""

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS sequence
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY sequence) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM repeated),
places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       (SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words
  FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
        FROM (SELECT coalesce(lang, 'und') AS lang,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents))),
w AS MATERIALIZED (
  SELECT lang, word AS w1, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4
  FROM (SELECT lang, piece, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM pieces) WINDOW p AS (PARTITION BY piece ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 30),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS n FROM w WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS n FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f4 AS MATERIALIZED (SELECT lang, w1, w2, w3, w4, count(*) AS n FROM w WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f AS MATERIALIZED (
  SELECT lang, w1 AS phrase, n FROM f1 UNION ALL SELECT lang, w1 || ' ' || w2, n FROM f2
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, n FROM f3 UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, n FROM f4),
cuts AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, n AS a, 1 AS cut, w1 AS x, w2 AS y FROM f2
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, n, 1, w1, w2 || ' ' || w3 FROM f3
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, n, 2, w1 || ' ' || w2, w3 FROM f3
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, n, 1, w1, w2 || ' ' || w3 || ' ' || w4 FROM f4
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, n, 2, w1 || ' ' || w2, w3 || ' ' || w4 FROM f4
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, n, 3, w1 || ' ' || w2 || ' ' || w3, w4 FROM f4),
scored AS (
  SELECT c.*, l.n AS l, r.n AS r, (2000000::HUGEINT * a) // (l.n + r.n) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, unnest([w1 || ' ' || w2, w2 || ' ' || w3]) AS phrase, n FROM f3
  UNION ALL SELECT lang, unnest([w1 || ' ' || w2, w2 || ' ' || w3, w3 || ' ' || w4, w1 || ' ' || w2 || ' ' || w3, w2 || ' ' || w3 || ' ' || w4]), n FROM f4),
longer AS (SELECT lang, phrase, max(n) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM least c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
