"""Reusable DuckDB SQL fragments for the oracle queries.

They restate the semantics of the Spark operators in plain SQL so that the
two engines can be compared on the same parquet tables.
"""

from __future__ import annotations

from quarry.functions.text import STOP_WORDS, sql_string_list

NL = "chr(10)"
STOP_LIST = "[" + sql_string_list(STOP_WORDS) + "]"


def terms_expr(text: str) -> str:
    """Index terms of a text column: letter runs, lower case, no stop words."""
    return (f"list_filter(regexp_extract_all(lower({text}), '\\p{{L}}+'), "
            f"lambda x: NOT list_contains({STOP_LIST}, x))")


def words_expr(text: str) -> str:
    return f"regexp_extract_all({text}, '\\S+')"


def token_chunks_cte(src: str = "documents", size: int = 800, overlap: int = 200,
                     extra: str = "") -> str:
    """CTE ``chunks(doc_id, chunk_index, chunk_id, text [, extra])``."""
    step = size - overlap
    ex = f", {extra}" if extra else ""
    return f"""
_w AS (SELECT doc_id{ex}, {words_expr('text')} AS words FROM {src}),
_n AS (SELECT doc_id{ex}, words,
              CASE WHEN len(words) <= {size} THEN 1
                   ELSE CAST(ceil((len(words) - {size}) / {step}.0) AS BIGINT) + 1 END AS nc
       FROM _w),
_i AS (SELECT doc_id{ex}, words, unnest(range(nc)) AS i FROM _n),
chunks AS (SELECT doc_id{ex}, CAST(i AS INTEGER) AS chunk_index,
                  CAST(doc_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS chunk_id,
                  array_to_string(list_slice(words, i * {step} + 1, i * {step} + {size}), ' ') AS text
           FROM _i)"""


def bm25_cte(corpus: str, corpus_id: str, queries: str, query_id: str,
             k: int = 2, k1: float = 1.2, b: float = 0.75) -> str:
    """CTE ``hits(query_id, rank, doc_id, score)`` (BM25, score rounded to
    4 places before ranking, ties by doc id)."""
    return f"""
_dt AS (SELECT {corpus_id} AS doc_id, {terms_expr('text')} AS terms FROM {corpus}),
_dl AS (SELECT doc_id, len(terms) AS doc_len FROM _dt),
_stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM _dl),
_posts AS (SELECT doc_id, term, count(*) AS tf
           FROM (SELECT doc_id, unnest(terms) AS term FROM _dt) GROUP BY doc_id, term),
_q AS (SELECT DISTINCT query_id, term FROM
         (SELECT {query_id} AS query_id, unnest(list_distinct({terms_expr('text')})) AS term
          FROM {queries})),
_dfs AS (SELECT term, count(*) AS df FROM _posts WHERE term IN (SELECT term FROM _q) GROUP BY term),
_scored AS (
  SELECT _q.query_id, p.doc_id,
         round(sum(ln(1.0 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * {k1 + 1}
                   / (p.tf + {k1} * (1 - {b} + {b} * l.doc_len / s.avg_len))), 4) AS score
  FROM _q JOIN _dfs d ON d.term = _q.term JOIN _posts p ON p.term = _q.term
       JOIN _dl l ON l.doc_id = p.doc_id CROSS JOIN _stats s
  GROUP BY _q.query_id, p.doc_id),
_ranked AS (SELECT query_id, doc_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
            FROM _scored),
hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM _ranked WHERE rank <= {k})"""


def dense_cte(k: int = 2, digits: int = 6) -> str:
    """CTE ``dense(query_id, rank, doc_id, score)``: benchmark items as
    query vectors over all embeddings, self excluded."""
    return f"""
_qv AS (SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS qv
        FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
_ds AS (SELECT _qv.query_id, e.vec_id AS doc_id,
               round(list_dot_product(_qv.qv, CAST(e.embedding AS DOUBLE[]))
                     / (sqrt(list_dot_product(_qv.qv, _qv.qv))
                        * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))),
                     {digits}) AS score
        FROM _qv CROSS JOIN embeddings e WHERE e.vec_id <> _qv.query_id),
_dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM _ds),
dense AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM _dr WHERE rank <= {k})"""


def embed_cte(src: str, id_col: str, dim: int = 768, name: str = "emb") -> str:
    """CTE ``<name>(id, bucket, value)``: hashed embedding, unit length,
    values rounded to 6 places."""
    p = f"_{name}"
    return f"""
{p}_t AS (SELECT {id_col} AS id, unnest({terms_expr('text')}) AS term FROM {src}),
{p}_b AS (SELECT id, CAST(CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {dim} AS INTEGER) AS bucket,
               CASE WHEN CAST(('0x' || substr(md5(term), 9, 1)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sgn
        FROM {p}_t),
{p}_r AS (SELECT id, bucket, sum(sgn) AS raw FROM {p}_b GROUP BY id, bucket HAVING sum(sgn) <> 0),
{name} AS (SELECT id, bucket, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)), 6) AS value FROM {p}_r)"""


SENT_SQL = ("list_filter(list_transform(regexp_extract_all({t}, '[^.!?]+[.!?]*'), "
            "lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) > 0)")


def sentences_expr(text: str) -> str:
    return SENT_SQL.format(t=text)


def term_set_expr(text: str) -> str:
    return f"list_distinct({terms_expr(text)})"


def supported_fraction_expr(text: str, pool: str, tau: float = 0.6) -> str:
    """Supported sentences / sentences with terms (NULL when none)."""
    toks = f"list_filter(list_transform({sentences_expr(text)}, lambda s: {term_set_expr('s')}), lambda t: len(t) > 0)"
    ok = f"len(list_filter({toks}, lambda t: len(list_intersect(t, {pool})) / len(t) >= {tau}))"
    return f"CASE WHEN len({toks}) > 0 THEN {ok} / len({toks}) END"


def context_cte(queries: str, query_id: str = "query_id", k: int = 2) -> str:
    """CTEs ``chunks``, ``hits`` (BM25 over token chunks of documents),
    ``fmt(query_id, rank, formatted)`` and ``ctx(query_id, context)``.
    ``queries`` must have columns ``{query_id}`` and ``text``."""
    return f"""{token_chunks_cte(extra='source')},
{bm25_cte('chunks', 'chunk_id', queries, query_id, k=k)},
fmt AS (SELECT h.query_id, h.rank, c.text AS content,
             '**Document Chunk ' || CAST(h.rank AS VARCHAR) || '**' || chr(10)
             || 'Source: ' || coalesce(c.source, 'Unknown file')
             || ' (Page ' || CAST(greatest(1, (c.chunk_index * 800) // 2000 + 1) AS VARCHAR) || ')'
             || chr(10) || chr(10) || 'Content:' || chr(10) || c.text AS formatted
      FROM hits h JOIN chunks c ON c.chunk_id = h.doc_id),
ctx AS (SELECT q.{query_id} AS query_id,
       CASE WHEN count(fmt.rank) = 0 THEN 'No relevant documents found for this query.'
            ELSE chr(10) || chr(10) || repeat('=', 50)
                 || string_agg(fmt.formatted, chr(10) || chr(10) ORDER BY fmt.rank) END AS context
       FROM {queries} q LEFT JOIN fmt ON fmt.query_id = q.{query_id}
       GROUP BY q.{query_id})"""
