"""SQL fragments that several counterparts share."""

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
N_TOKENS = r"len(regexp_extract_all({0}, '\S+'))"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def words(expr: str) -> str:
    return WORDS.format(expr)


def n_tokens(expr: str) -> str:
    return N_TOKENS.format(expr)


def strip(expr: str) -> str:
    return STRIP.format(expr)


PAPERS = """papers AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, text, lang, source, n_chars,
         string_split(text, chr(10))[1] AS title,
         coalesce(string_split(text, chr(10))[2], '') AS abstract,
         CAST(2000 + n_chars % 25 AS VARCHAR) || '-01-01' AS published_date
  FROM documents)"""


LATEX = r"\$\$[\s\S]*?\$\$|\$[^$\n]*?\$|\\[a-zA-Z]+\{[^}]*\}|\\[a-zA-Z]+"


def equation_only(expr: str, min_prose: int = 150) -> str:
    prose = strip(f"regexp_replace({expr}, '{LATEX}', '', 'g')")
    return f"(regexp_matches({expr}, '{LATEX}') AND length({prose}) < {min_prose})"


def children(max_tokens: int = 128, overlap: int = 16, filtered: bool = False) -> str:
    """Overlapping windows of every document: ``chunk_id, paper_id, parent_chunk_id, text``.

    ``filtered`` leaves out the documents that are only formulas.
    """
    step = max_tokens - overlap
    where = f" AND NOT {equation_only('text')}" if filtered else ""
    return rf"""pieces AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, text, regexp_extract_all(text, '\s*\S+') AS toks
  FROM documents WHERE text <> ''{where}),
windows AS (
  SELECT paper_id, text, toks,
         unnest(range(0, greatest(0, len(toks) - {overlap + 1}) + 1, {step})) AS start
  FROM pieces),
children AS (
  SELECT paper_id || '#0#' || CAST(start // {step} AS VARCHAR) AS chunk_id, paper_id,
         paper_id || '#0' AS parent_chunk_id, CAST(start // {step} AS INTEGER) AS child_idx,
         CASE WHEN len(toks) = 0 THEN text
              ELSE array_to_string(toks[start + 1 : start + {max_tokens}], '') END AS text
  FROM windows)"""


def hash_vectors(name: str, source: str, id_: str, text: str, dim: int, extra: str = "") -> str:
    """CTE ``name(id, vector)``: signed hashed word counts of unit length."""
    return rf"""{name}_w AS (
  SELECT {id_} AS id, unnest({words(text)}) AS w FROM {source}),
{name}_h AS (
  SELECT id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {dim} AS bucket,
         CASE WHEN CAST(('0x' || substr(md5(w), 9, 1)) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END AS s
  FROM {name}_w),
{name}_c AS (SELECT id, bucket, CAST(sum(s) AS DOUBLE) AS v FROM {name}_h GROUP BY id, bucket),
{name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_c GROUP BY id),
{name} AS (
  SELECT c.id, c.bucket, CAST(CAST(CASE WHEN n.norm > 0 THEN c.v / n.norm ELSE 0 END AS FLOAT) AS DOUBLE) AS v
  FROM {name}_c c JOIN {name}_n n USING (id))"""


def bm25(docs: str, doc_id: str, paper: str, text: str, idf: bool, avg_len: str | None = None) -> str:
    """CTEs ending in ``sparse(query_id, chunk_id, paper_id, score)`` for all benchmark items."""
    mean = f"CAST({avg_len} AS DOUBLE)" if avg_len else "(SELECT avg(len(ws)) FROM doc_words)"
    weight = ("ln(1 + ((SELECT count(*) FROM doc_words) - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE))"
              if idf else "1.0::DOUBLE")
    return rf"""doc_words AS (
  SELECT {doc_id} AS chunk_id, {paper} AS paper_id, {words(text)} AS ws FROM {docs}),
doc_terms AS (
  SELECT chunk_id, paper_id, len(ws) AS n, unnest(ws) AS term FROM doc_words),
tf AS (
  SELECT chunk_id, paper_id, n, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
postings AS (
  SELECT term, chunk_id, paper_id,
         tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / {mean})) AS weight
  FROM tf),
stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
query_terms AS (
  SELECT q.query_id, q.term, {weight} AS qw
  FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest({words('text')}) AS term
        FROM benchmark) q JOIN stats d USING (term)),
sparse AS (
  SELECT query_id, chunk_id, paper_id, round(sum(qw * weight), 6) AS score
  FROM query_terms JOIN postings USING (term) GROUP BY ALL HAVING round(sum(qw * weight), 6) > 0)"""


def ranked(source: str, name: str, k: int, order: str = "score DESC, chunk_id") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER)
                        AS rank FROM {source}) WHERE rank <= {k})"""
