"""Registered checks: page conversion, Markdown, chunking, enrichment,
hashed embeddings and the composed ingest chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chunk as C
from quarry.operators.convert import blocks_to_markdown, page_blocks
from quarry.operators.embed import hash_embed_sparse
from quarry.operators.enrich import (context_or_default, context_prompt, contextual_chunks,
                                     extractive_context, lead_sentence)
from quarry.plans.registry import Tables, register, scratch
from quarry.plans.sqlparts import embed_cte as _embed_cte
from quarry.plans.sqlparts import token_chunks_cte

# ---------------------------------------------------------------------------
# SQL builders
# ---------------------------------------------------------------------------


# markup that the raw pages lack, put behind each page
MORE_HTML = ("<h2>Head two</h2><table><caption>Cap</caption><tr><th>k</th><td>v &lt;1&gt; &amp;amp; x</td></tr></table>"
             "<pre>keep  this</pre><blockquote>quoted &#233;&#x2014;</blockquote><div>bare <b>bold</b> text<br/>after</div><dl><dt>t</dt><dd>d</dd></dl>tail")


# a page for each page whose markup is hard to read, with the page's address
HARD_HTML = ("<nav><a href='/x'>Menu</a><ul><li>item one</li></ul></nav><p>1 < 2 and 3 > 2 stays</p><p title=\"a > b\" data-x='<q>'>at ",
             "</p><p class=it's>it's fine</p><!-- note > gone --><div>mail <me@here.org> if x<y</div><footer>foot <b>note</b></footer>"
             "after<!-- open words <p>kept</p><script>var unclosed = <b>1;")
HARD_BLOCKS = ((1, "nav", "Menu"), (3, "nav", "item one"), (7, "p", "1 < 2 and 3 > 2 stays"), (9, "p", "at {url}"), (11, "p", "it's fine"),
               (13, "text", "mail <me@here.org> if x<y"), (15, "footer", "foot note"), (16, "text", "after<!-- open words"), (17, "p", "kept"),
               (18, "text", "var unclosed = 1;"))


def more_pages(pages):
    hard = pages.select((-F.col("page_id") - 1).alias("page_id"), F.concat(F.lit(HARD_HTML[0]), "url", F.lit(HARD_HTML[1])).alias("html"))
    return pages.select("page_id", F.concat("html", F.lit(MORE_HTML)).alias("html")).unionByName(hard)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hard_blocks_sql() -> str:
    """The blocks of the hard pages, as they are written above."""
    rows = ", ".join(f"({n}, {_quoted(k)}, {_quoted(t)})" for n, k, t in HARD_BLOCKS)
    return (f"SELECT -p.page_id - 1 AS page_id, CAST(b.pos AS INTEGER) AS block_pos, b.kind, replace(b.text, '{{url}}', p.url) AS text"
            f" FROM pages p, (VALUES {rows}) b(pos, kind, text)")


def _without(h: str, opens: str, closes: str) -> str:
    """``h`` without what stands between two strings."""
    parts = f"string_split({h}, '{opens}')"
    return (f"array_to_string(list_concat({parts}[1:1], list_transform({parts}[2:], lambda x: ' ' || substr(x, strpos(x, '{closes}') + {len(closes)}))), '')")


def _clean_html(h: str) -> str:
    for opens, closes in (("<script", "</script>"), ("<style", "</style>"), ("<!--", "-->")):
        h = _without(h, opens, closes)
    return h


def _decoded(t: str) -> str:
    """The references that the pages have; the ampersand comes last."""
    for name, c in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("apos", "chr(39)"), ("nbsp", "chr(160)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("#39", "chr(39)"),
                    ("#233", "chr(233)"), ("#x2014", "chr(8212)"), ("amp", "'&'")):
        t = f"replace({t}, '&{name};', {c})"
    return t


def _blocks_cte() -> str:
    h = _clean_html(f"html || '{MORE_HTML}'")
    block = "h1|h2|h3|h4|h5|h6|p|li|td|th|pre|blockquote|dt|dd|caption|title"
    other = ("html|head|body|div|section|article|main|header|aside|form|figure|figcaption|ul|ol|dl|table|thead|tbody|tfoot|tr|hr|br")
    h = f"regexp_replace({h}, '(?i)<(nav|footer)(\\s[^>]*)?>', chr(3) || '\\1' || chr(4), 'g')"
    h = f"regexp_replace({h}, '(?i)</(nav|footer)>', chr(3) || chr(4), 'g')"
    h = f"regexp_replace({h}, '(?i)<({block})(\\s[^>]*)?/?>', chr(1) || '\\1' || chr(2), 'g')"
    h = f"regexp_replace({h}, '(?i)</?({block}|{other})(\\s[^>]*)?/?>', chr(1) || 'text' || chr(2), 'g')"
    return f"""
_h AS (SELECT page_id, string_split(chr(4) || {h}, chr(3)) AS regions FROM pages),
_pp AS (SELECT page_id, flatten(list_transform(regions, lambda r: list_transform(
          string_split('text' || chr(2) || split_part(r, chr(4), 2), chr(1)), lambda p: split_part(r, chr(4), 1) || chr(3) || p))) AS parts FROM _h),
_pc AS (SELECT page_id, unnest(parts) AS piece, unnest(range(len(parts))) AS block_pos FROM _pp),
_raw AS (SELECT page_id, CAST(block_pos AS INTEGER) AS block_pos,
                  CASE WHEN split_part(piece, chr(3), 1) <> '' THEN lower(split_part(piece, chr(3), 1))
                       ELSE lower(split_part(split_part(piece, chr(3), 2), chr(2), 1)) END AS kind,
                  trim(regexp_replace(regexp_replace(split_part(piece, chr(2), 2), '<[^>]*>', ' ', 'g'),
                                      '\\s+', ' ', 'g')) AS text
           FROM _pc),
blocks AS (SELECT page_id, block_pos, kind, {_decoded('text')} AS text FROM _raw WHERE length(text) > 0
           UNION ALL {_hard_blocks_sql()})"""


def _markdown_docs_sql() -> str:
    first = "split_part(text, chr(10), 1)"
    return (f"SELECT doc_id, source, '# ' || source || chr(10) || '## Document ' || CAST(doc_id AS VARCHAR)"
            f" || chr(10) || {first} || chr(10) || '```' || chr(10) || '# not a heading' || chr(10)"
            f" || '```' || chr(10) || '### Details' || chr(10) || substr(text, length({first}) + 2)"
            f" || chr(10) || '####### Deep' || chr(10) || 'x' || chr(10) || '######### Deeper' || chr(10) || 'y' || chr(10) || '######## Between' AS text"
            f" FROM documents")


def _sections_cte(src: str) -> str:
    head = "'(?s)^(#+)\\s(.*)'"
    w_before = "(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    w_upto = "(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
_md AS ({src}),
_l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS pos FROM _md),
_f AS (SELECT *, CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END AS fence FROM _l),
_g AS (SELECT *, coalesce(sum(fence) OVER {w_before}, 0) AS fences_before FROM _f),
_hd AS (SELECT *, CASE WHEN fences_before % 2 = 0 AND fence = 0
                         AND length(regexp_extract(line, {head}, 1)) > 0
                       THEN length(regexp_extract(line, {head}, 1)) END AS level FROM _g),
_t AS (SELECT *, CASE WHEN level IS NOT NULL THEN trim(regexp_extract(line, {head}, 2)) END AS title,
              sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER {w_upto} AS section_index
       FROM _hd),
_hh AS (SELECT doc_id, pos, level, title FROM _t WHERE level IS NOT NULL),
_up AS (SELECT h.doc_id, h.pos, string_agg(a.title, '/' ORDER BY a.pos) AS anc
        FROM _hh h JOIN _hh a ON a.doc_id = h.doc_id AND a.pos < h.pos AND a.level < h.level
        WHERE NOT EXISTS (SELECT 1 FROM _hh b WHERE b.doc_id = h.doc_id AND b.pos > a.pos AND b.pos < h.pos AND b.level <= a.level)
        GROUP BY h.doc_id, h.pos),
_pth AS (SELECT _t.doc_id, _t.pos, line, section_index,
                CASE WHEN level IS NOT NULL THEN coalesce('/' || anc || '/', '/') END AS path
         FROM _t LEFT JOIN _up ON _up.doc_id = _t.doc_id AND _up.pos = _t.pos),
sections AS (SELECT doc_id, CAST(section_index AS INTEGER) AS section_index,
                    coalesce(max(path), '/') AS header_path,
                    string_agg(line, chr(10) ORDER BY pos) AS text
             FROM _pth GROUP BY doc_id, section_index
             HAVING length(trim(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\\s+', ' ', 'g'))) > 0)"""


SENT_SQL = ("list_filter(list_transform(regexp_extract_all({t}, '[^.!?]+[.!?]*'), "
            "lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) > 0)")


def _lead_sql(text: str) -> str:
    return SENT_SQL.format(t=text) + "[1]"


def markdown_docs(documents):
    """Markdown built per document: '# <source>', '## Document <id>', the
    first line, a code fence holding a '#' line, '### Details', the rest, and
    headings deeper than HTML has."""
    first = F.substring_index("text", "\n", 1)
    rest = F.expr("substr(text, length(substring_index(text, char(10), 1)) + 2)")
    md = F.concat(F.lit("# "), F.col("source"), F.lit("\n## Document "), F.col("doc_id").cast("string"),
                  F.lit("\n"), first, F.lit("\n```\n# not a heading\n```\n### Details\n"), rest,
                  F.lit("\n####### Deep\nx\n######### Deeper\ny\n######## Between"))
    return documents.select("doc_id", "source", md.alias("text"))


# ---------------------------------------------------------------------------
# T1 / K2
# ---------------------------------------------------------------------------
@register("page_blocks", ops=("T1",), sql=f"""
WITH {_blocks_cte()}
SELECT page_id, block_pos, kind, text FROM blocks WHERE length(text) > 0""")
def q_page_blocks(spark, sf):
    return page_blocks(more_pages(Tables(spark, sf).pages))


def _page_words_sql() -> str:
    """Words of pages by their angle brackets alone, and those of the hard
    pages as they are written."""
    h = f"string_split({_clean_html(f"html || '{MORE_HTML}'")}, '<')"
    text = f"array_to_string(list_concat({h}[1:1], list_transform({h}[2:], lambda x: ' ' || substr(x, strpos(x, '>') + 1))), '')"
    plain = f"translate({text}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
    return f"""
WITH b AS (SELECT page_id, list_filter(string_split({plain}, ' '), lambda w: w <> '') AS words FROM pages),
k AS (SELECT page_id, {_decoded("array_to_string(words, ' ')")} AS text FROM b WHERE len(words) > 0
      UNION ALL SELECT -page_id - 1, replace({_quoted(' '.join(t for _, _, t in HARD_BLOCKS))}, '{{url}}', url) FROM pages)
SELECT page_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words, md5(text) AS digest FROM k"""


@register("page_text_kept", ops=("T1",), sql=_page_words_sql())
def q_page_text_kept(spark, sf):
    """All words of the blocks, in order, are the words of the page."""
    b = page_blocks(more_pages(Tables(spark, sf).pages))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "text"))), lambda x: x["text"]), " ")
    return (b.groupBy("page_id").agg(text.alias("text"))
            .select("page_id", F.size(F.split("text", " ")).cast("long").alias("n_words"), F.md5("text").alias("digest")))


@register("blocks_to_markdown", ops=("K2",), sql=f"""
WITH {_blocks_cte()}
SELECT page_id,
       string_agg(CASE WHEN kind = 'li' THEN '- ' WHEN regexp_matches(kind, '^h[1-6]$')
                         THEN repeat('#', CAST(substr(kind, 2) AS INT)) || ' ' ELSE '' END || text,
                  chr(10) || chr(10) ORDER BY block_pos) AS markdown,
       count(*) AS n_blocks
FROM blocks WHERE kind NOT IN ('title', 'nav', 'footer')
GROUP BY page_id""")
def q_blocks_to_markdown(spark, sf):
    return blocks_to_markdown(page_blocks(more_pages(Tables(spark, sf).pages)))


# ---------------------------------------------------------------------------
# T2, T6, T7
# ---------------------------------------------------------------------------
@register("md_sections", ops=("T2",), sql=f"""
WITH {_sections_cte(_markdown_docs_sql())}
SELECT doc_id, section_index, header_path, text FROM sections""")
def q_md_sections(spark, sf):
    return C.markdown_sections(markdown_docs(Tables(spark, sf).documents))


@register("chunk_links", ops=("T6",), sql=f"""
WITH {token_chunks_cte()}
SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id
FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""")
def q_chunk_links(spark, sf):
    ch = C.token_chunks(Tables(spark, sf).documents)
    return C.chunk_links(ch).select("chunk_id", "prev_id", "next_id")


@register("two_line_cap", ops=("T7",), sql="""
SELECT conv_id, turn, array_to_string(list_slice(string_split(
  trim(chr(10) || ' ' || text || chr(9), ' ' || chr(9) || chr(10) || chr(13)), chr(10)), 1, 2), chr(10)) AS summary
FROM conversations WHERE role = 'assistant'""")
def q_two_line_cap(spark, sf):
    c = Tables(spark, sf).conversations.where(F.col("role") == "assistant")
    padded = F.concat(F.lit("\n "), F.col("text"), F.lit("\t"))
    return c.select("conv_id", "turn", C.first_lines(padded, 2).alias("summary"))


def _sentence_chunks_sql(limit: int = 1024, overlap: int = 50) -> str:
    """Greedy packing in SQL: prefix sums by window, the end of a chunk
    and the next start by ASOF joins on the (increasing) prefix sums, the
    chain of starts by a recursive CTE."""
    sep = "chr(10) || chr(10) || chr(10)"
    w = "(PARTITION BY doc_id, paragraph ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
WITH RECURSIVE
_pa AS (SELECT doc_id, unnest(string_split(text, {sep})) AS ptext,
               unnest(range(len(string_split(text, {sep})))) AS paragraph FROM documents),
_ss AS (SELECT doc_id, paragraph, {SENT_SQL.format(t='ptext')} AS ss FROM _pa),
_ex AS (SELECT doc_id, paragraph, len(ss) AS n, unnest(ss) AS sent, unnest(range(len(ss))) AS idx FROM _ss),
_ln AS (SELECT doc_id, paragraph, n, idx, len(string_split(sent, ' ')) AS ln FROM _ex),
_pf AS (SELECT doc_id, paragraph, n, idx, sum(ln) OVER {w} AS p1, sum(ln) OVER {w} - ln AS p0 FROM _ln),
_a AS (SELECT a.doc_id, a.paragraph, a.n, a.idx AS s, b.idx AS i_first
       FROM _pf a ASOF LEFT JOIN _pf b
         ON a.doc_id = b.doc_id AND a.paragraph = b.paragraph AND a.p0 + {limit} < b.p1),
_b AS (SELECT *, CASE WHEN i_first IS NULL THEN n ELSE least(n, greatest(i_first, s + 1)) END AS e FROM _a),
_c AS (SELECT _b.*, x.p0 AS pe, x.p1 AS pe1 FROM _b LEFT JOIN _pf x
         ON x.doc_id = _b.doc_id AND x.paragraph = _b.paragraph AND x.idx = _b.e),
_d AS (SELECT *, greatest(pe - {overlap}, pe1 - {limit}) AS lb FROM _c),
_j AS (SELECT _d.*, y.idx AS j0 FROM _d ASOF LEFT JOIN _pf y
         ON _d.doc_id = y.doc_id AND _d.paragraph = y.paragraph AND _d.lb <= y.p0),
_nx AS (SELECT doc_id, paragraph, s, e,
               CASE WHEN e >= n THEN NULL
                    WHEN j0 IS NOT NULL AND greatest(j0, s + 1) <= e THEN greatest(j0, s + 1)
                    ELSE e END AS nxt
        FROM _j),
_chain AS (SELECT doc_id, paragraph, s, 0 AS k FROM _nx WHERE s = 0
           UNION ALL
           SELECT c.doc_id, c.paragraph, x.nxt, c.k + 1 FROM _chain c
           JOIN _nx x ON x.doc_id = c.doc_id AND x.paragraph = c.paragraph AND x.s = c.s
           WHERE x.nxt IS NOT NULL),
_ck AS (SELECT c.doc_id, c.paragraph, c.k, c.s, x.e FROM _chain c
        JOIN _nx x ON x.doc_id = c.doc_id AND x.paragraph = c.paragraph AND x.s = c.s),
_out AS (SELECT _ck.doc_id, _ck.paragraph, _ck.k, _ck.s, _ck.e,
                array_to_string(list_slice(_ss.ss, _ck.s + 1, _ck.e), ' ') AS text
         FROM _ck JOIN _ss ON _ss.doc_id = _ck.doc_id AND _ss.paragraph = _ck.paragraph)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, text, CAST(s AS INTEGER) AS first_sentence,
       CAST(e - s AS INTEGER) AS n_sentences,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, k) - 1 AS INTEGER) AS chunk_index,
       CAST(doc_id AS VARCHAR) || '-' ||
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, k) - 1 AS VARCHAR) AS chunk_id
FROM _out"""


@register("sentence_chunks", ops=("T4",), sql=_sentence_chunks_sql())
def q_sentence_chunks(spark, sf):
    """Also checked against a brute-force packer in tests (3 settings)."""
    return C.sentence_chunks(Tables(spark, sf).documents)


# ---------------------------------------------------------------------------
# E1, E2, P5, P6
# ---------------------------------------------------------------------------
@register("chunk_context", ops=("E1", "P10"), sql=f"""
WITH _d AS (SELECT doc_id, source, text, {_lead_sql('text')} AS lead FROM documents),
{token_chunks_cte(src='_d', extra='source, lead')},
_nc AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT c.chunk_id,
       'Part of ' || c.source || ' (chunk ' || CAST(c.chunk_index + 1 AS VARCHAR) || ' of '
         || CAST(_nc.n AS VARCHAR) || '). ' || coalesce(c.lead, '') AS context,
       CAST(greatest(1, (c.chunk_index * 800) // 2000 + 1) AS INTEGER) AS page_number
FROM chunks c JOIN _nc ON _nc.doc_id = c.doc_id""")
def q_chunk_context(spark, sf):
    return contextual_chunks(Tables(spark, sf).documents).select("chunk_id", "context", "page_number")


@register("context_or_default", ops=("E2",), sql=f"""
WITH _d AS (SELECT doc_id, source, text, {_lead_sql('text')} AS lead FROM documents),
{token_chunks_cte(src='_d', extra='source, lead')},
_nc AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
_c AS (SELECT c.chunk_id, c.source,
              CASE WHEN (c.doc_id + c.chunk_index) % 7 = 0 THEN NULL ELSE
              'Part of ' || c.source || ' (chunk ' || CAST(c.chunk_index + 1 AS VARCHAR) || ' of '
                || CAST(_nc.n AS VARCHAR) || '). ' || coalesce(c.lead, '') END AS context
       FROM chunks c JOIN _nc ON _nc.doc_id = c.doc_id)
SELECT chunk_id, coalesce(context, 'Part of ' || coalesce(source || '.md', 'document')) AS context FROM _c""")
def q_context_or_default(spark, sf):
    d = Tables(spark, sf).documents.withColumn("_lead", lead_sentence("text"))
    ch = C.token_chunks(d, keep=("source", "_lead"))
    failed = (F.col("doc_id") + F.col("chunk_index")) % 7 == 0     # provider failure stand-in
    ctx = F.when(~failed, extractive_context("source", "chunk_index", "n_chunks", "_lead"))
    return ch.select("chunk_id", context_or_default(ctx, F.concat("source", F.lit(".md"))).alias("context"))


@register("context_prompt", ops=("P5", "P6"), sql=f"""
WITH {token_chunks_cte(src='(SELECT doc_id, text, text AS full_text FROM documents)', extra='full_text')}
SELECT chunk_id,
       'Situate the chunk below within its document.' || chr(10) || chr(10) || '<document>' || chr(10)
       || substring(full_text, 1, 8000) || chr(10) || '</document>' || chr(10) || chr(10) || '<chunk>'
       || chr(10) || text || chr(10) || '</chunk>' || chr(10) || chr(10)
       || 'Answer with one or two sentences of context only.' AS prompt
FROM chunks""")
def q_context_prompt(spark, sf):
    d = Tables(spark, sf).documents.withColumn("full_text", F.col("text"))
    ch = C.token_chunks(d, keep=("full_text",))
    return ch.select("chunk_id", context_prompt("full_text", "text").alias("prompt"))


# ---------------------------------------------------------------------------
# E3, T5
# ---------------------------------------------------------------------------
@register("hash_embed", ops=("E3",), sql=f"""
WITH {_embed_cte('benchmark', 'item_id')}
SELECT id AS item_id, bucket, value FROM emb""")
def q_hash_embed(spark, sf):
    return hash_embed_sparse(Tables(spark, sf).benchmark, "item_id")


def contextual_cte(src: str) -> str:
    """CTEs ``_cx(chunk_id, text, src_doc, page_number, context)`` and
    ``_in(chunk_id, text)``, the contextual chunks of the Markdown ``src``
    and what is searched of them."""
    return f"""{_sections_cte(src)},
_sd AS (SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(section_index AS VARCHAR) AS doc_id,
               doc_id AS src_doc, header_path, text, {_lead_sql('text')} AS lead FROM sections),
{token_chunks_cte(src='_sd', extra='src_doc, header_path, lead')},
_nc AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
_cx AS (SELECT c.chunk_id, c.text, c.src_doc, CAST(greatest(1, (c.chunk_index * 800) // 2000 + 1) AS INTEGER) AS page_number,
               'Part of ' || CAST(c.src_doc AS VARCHAR) || ' ' || c.header_path || ' (chunk '
                 || CAST(c.chunk_index + 1 AS VARCHAR) || ' of ' || CAST(_nc.n AS VARCHAR) || '). '
                 || coalesce(c.lead, '') AS context
        FROM chunks c JOIN _nc ON _nc.doc_id = c.doc_id),
_in AS (SELECT chunk_id, context || chr(10) || text AS text FROM _cx)"""


def formatted_cte(hits: str = "hits", source: str = "d.source") -> str:
    """CTE ``fmt(query_id, rank, formatted)`` of contextual chunks."""
    return f"""
fmt AS (SELECT h.query_id, h.rank, '**Document Chunk ' || CAST(h.rank AS VARCHAR) || '**' || chr(10)
             || 'Source: ' || {source} || ' (Page ' || CAST(c.page_number AS VARCHAR) || ')'
             || chr(10) || 'Context: ' || c.context || chr(10) || chr(10) || 'Content:' || chr(10) || c.text AS formatted
      FROM {hits} h JOIN _cx c ON c.chunk_id = h.doc_id JOIN documents d ON d.doc_id = c.src_doc)"""


ANSWERED = """
SELECT q.item_id AS query_id,
       CASE WHEN count(fmt.rank) = 0 THEN 'No relevant documents found for this query.'
            ELSE chr(10) || chr(10) || repeat('=', 50) || string_agg(fmt.formatted, chr(10) || chr(10) ORDER BY fmt.rank) END AS context
FROM benchmark q LEFT JOIN fmt ON fmt.query_id = q.item_id GROUP BY q.item_id"""


def contextual_answer_sql(source: str = "d.source") -> str:
    from quarry.plans.sqlparts import bm25_cte
    return (f"WITH {contextual_cte(_markdown_docs_sql())},{bm25_cte('_in', 'chunk_id', 'benchmark', 'item_id')},"
            f"{formatted_cte(source=source)}{ANSWERED}")


def contextual_answer(spark, sf):
    """Sections, token chunks, context and page, one index over context and
    text, and the answers with source, page and context."""
    from quarry.plans import index_store
    t = Tables(spark, sf)
    path = scratch(spark, "contextual")
    index_store.build(markdown_docs(t.documents), path, contextual=True)
    return index_store.answer(spark, path, t.benchmark.withColumnRenamed("item_id", "query_id"))


@register("contextual_answer", ops=("E1", "E5", "R8", "P7"), sql=contextual_answer_sql())
def q_contextual_answer(spark, sf):
    return contextual_answer(spark, sf)


_INGEST_SQL = f"""
WITH {contextual_cte(_markdown_docs_sql())},
{_embed_cte('_in', 'chunk_id')},
_nz AS (SELECT id, count(*) AS nnz, round(sum(value * value), 6) AS sq FROM emb GROUP BY id)
SELECT _cx.chunk_id, _cx.page_number, _cx.context, coalesce(_nz.nnz, 0) AS nnz, _nz.sq AS norm_sq
FROM _cx LEFT JOIN _nz ON _nz.id = _cx.chunk_id"""


@register("ingest_chain", ops=("T5", "E4"), sql=_INGEST_SQL)
def q_ingest_chain(spark, sf):
    from quarry.plans.ingest import contextual_index
    return contextual_index(markdown_docs(Tables(spark, sf).documents))


@register("ingest_pipeline", ops=("T5", "E4"), sql=_INGEST_SQL)
def q_ingest_pipeline(spark, sf):
    """The ingest as a saved and loaded pipeline of transformers."""
    from pyspark.ml import PipelineModel
    from quarry.plans.ingest import squares
    from quarry.plans.transformers import ingest_pipeline
    path = scratch(spark, "pipeline")
    ingest_pipeline().save(path)
    rows = PipelineModel.load(path).transform(markdown_docs(Tables(spark, sf).documents))
    return rows.select("chunk_id", "page_number", "context", *squares("embedding"))
