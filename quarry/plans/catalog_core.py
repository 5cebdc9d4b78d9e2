"""Registered checks: sources, column functions, audits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.functions.text import sentences
from quarry.operators.chunk import token_chunks
from quarry.operators.index import sample_row, vector_audit
from quarry.sources import files
from quarry.sources.sinks import batch_progress
from quarry.plans.registry import Tables, register
from quarry.plans.sqlparts import token_chunks_cte

# SQL pieces for URLs (DuckDB has no URL parser; Spark uses java.net.URI)
HOST_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
PATH_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SCHEME_SQL = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"


def _url_cols(pages):
    return pages.select("page_id", "url", X.url_host("url").alias("host"),
                        X.url_path("url").alias("path"))


# S2 -------------------------------------------------------------------------
@register("suffix_filter", ops=("S2",), sql=f"""
SELECT page_id, {PATH_SQL} AS path FROM pages WHERE lower({PATH_SQL}) LIKE '%.html'""")
def q_suffix_filter(spark, sf):
    p = Tables(spark, sf).pages.select("page_id", X.url_path("url").alias("path"))
    return p.where(files.has_suffix("path", (".html",)))


# S4 / P9 --------------------------------------------------------------------
@register("scan_vectors", ops=("S4",), sql="""
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims,
       round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
FROM embeddings""")
def q_scan_vectors(spark, sf):
    e = Tables(spark, sf).embeddings
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("vec_id", "label", F.size("embedding").alias("dims"),
                    F.round(F.sqrt(sq), 6).alias("norm"))


@register("vector_dims", ops=("P9", "A2"), sql="""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE embedding IS NOT NULL) AS with_vector,
       count(*) FILTER (WHERE len(embedding) <> 64) AS bad_dims,
       CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim
FROM embeddings""")
def q_vector_dims(spark, sf):
    e = Tables(spark, sf).embeddings
    return vector_audit(e, "embedding", expected_dim=64,
                        extra=(F.min(F.size("embedding")).alias("min_dim"),
                               F.max(F.size("embedding")).alias("max_dim")))


# S5 -------------------------------------------------------------------------
@register("context_fallback", ops=("S5",), sql="""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic,
       CASE WHEN l.doc_id IS NOT NULL THEN 'preferred' ELSE 'regular' END AS origin
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_context_fallback(spark, sf):
    t = Tables(spark, sf)
    return files.prefer_rows(t.documents.select("doc_id"), t.labels, "doc_id", ["quality", "toxic"],
                             defaults={"quality": -1, "toxic": -1})


# S6 -------------------------------------------------------------------------
@register("resolve_path", ops=("S6",), sql=f"""
WITH p AS (SELECT page_id, url, {HOST_SQL} AS host, {PATH_SQL} AS path FROM pages),
cand AS (
  SELECT page_id, 'file_path' AS key, 0 AS priority,
         CASE WHEN url LIKE 'https:%' THEN '/data/' || host || path END AS value FROM p
  UNION ALL SELECT page_id, 'path', 2, host || path FROM p
  UNION ALL SELECT page_id, 'source', 3, url FROM p
  UNION ALL SELECT page_id, 'filename', 4, string_split(path, '/')[-1] FROM p
  UNION ALL SELECT page_id, 'doc_id', 6, CAST(page_id AS VARCHAR) FROM p),
c2 AS (SELECT page_id, key, priority,
              CASE WHEN value LIKE '/%' THEN value ELSE '/data/' || value END AS path
       FROM cand WHERE length(value) > 0),
listing AS (SELECT DISTINCT '/data/' || host || path AS path FROM p
            WHERE url NOT LIKE '%?%' AND url NOT LIKE '%#%'),
found AS (SELECT * FROM c2 WHERE path IN (SELECT path FROM listing)),
best AS (SELECT page_id, arg_min(path, priority) AS path, arg_min(key, priority) AS key
         FROM found GROUP BY page_id)
SELECT p.page_id, best.path, best.key FROM p LEFT JOIN best ON best.page_id = p.page_id""")
def q_resolve_path(spark, sf):
    u = _url_cols(Tables(spark, sf).pages)
    meta = u.select("page_id", F.create_map(
        F.lit("file_path"), F.when(F.col("url").startswith("https:"),
                                   F.concat(F.lit("/data/"), "host", "path")),
        F.lit("path"), F.concat("host", "path"),
        F.lit("source"), F.col("url"),
        F.lit("filename"), X.basename("path")).alias("metadata"))
    listing = (u.where(~F.col("url").contains("?") & ~F.col("url").contains("#"))
               .select(F.concat(F.lit("/data/"), "host", "path").alias("path")))
    return files.resolve_paths(meta, listing, "/data", id_col="page_id")


# P1 -------------------------------------------------------------------------
@register("tag_source", ops=("P1",), sql="""
SELECT doc_id, source || '.md' AS source_file, lang FROM documents""")
def q_tag_source(spark, sf):
    d = Tables(spark, sf).documents
    return X.with_source_file(d, F.concat("source", F.lit(".md"))).select("doc_id", "source_file", "lang")


# P2 -------------------------------------------------------------------------
# names beside those of the pages: hidden files, several suffixes, dots at the ends
ODD_NAMES = (".bashrc", "a.", "..x", ".a.b", "a.b.c", "...", "x..", ".a.", "plain", "dir.d/.hidden", "dir.d/file")


@register("path_parts", ops=("P2",), sql=f"""
WITH p AS (SELECT page_id, {PATH_SQL} AS path FROM pages
           UNION ALL SELECT page_id, '/odd/' || name FROM pages, (VALUES {", ".join(f"('{n}')" for n in ODD_NAMES)}) o(name)),
b AS (SELECT page_id, path, string_split(path, '/')[-1] AS base FROM p),
d AS (SELECT *, length(base) - strpos(reverse(base), '.') + 1 AS dot FROM b)
SELECT page_id, path, base,
       CASE WHEN contains(base, '.') AND dot > 1 AND dot < length(base) THEN substr(base, 1, dot - 1) ELSE base END AS stem
FROM d""")
def q_path_parts(spark, sf):
    p = Tables(spark, sf).pages.select("page_id", X.url_path("url").alias("path"))
    odd = p.select("page_id", F.explode(F.array(*[F.lit(f"/odd/{n}") for n in ODD_NAMES])).alias("path"))
    return p.unionByName(odd).select("page_id", "path", X.basename("path").alias("base"),
                                     X.stem(X.basename("path")).alias("stem"))


# P3 -------------------------------------------------------------------------
@register("text_preview", ops=("P3",), sql="""
SELECT doc_id, substring(text, 1, 200) AS preview_200,
       CASE WHEN text IS NOT NULL THEN substring(text, 1, 100) END AS preview_100,
       substring(source, 1, 80) AS source_80
FROM documents""")
def q_text_preview(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.substring("text", 1, 200).alias("preview_200"),
                    X.preview("text", 100).alias("preview_100"),
                    F.substring("source", 1, 80).alias("source_80"))


# P4 -------------------------------------------------------------------------
@register("doc_length", ops=("P4",), sql="""
SELECT doc_id, CAST(length(text) AS INTEGER) AS text_len, n_chars, length(text) = n_chars AS same
FROM documents""")
def q_doc_length(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.length("text").alias("text_len"), "n_chars",
                    (F.length("text") == F.col("n_chars")).alias("same"))


# P8 -------------------------------------------------------------------------
@register("json_field", ops=("P8",), sql="""
SELECT event_id, json_extract_string(props, '$.k') AS k_text,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type
FROM events""")
def q_json_field(spark, sf):
    e = Tables(spark, sf).events
    k = X.json_field("props", "k")
    return e.select("event_id", k.alias("k_text"), k.cast("int").alias("k"), "event_type")


# P11 ------------------------------------------------------------------------
SENTENCES_SQL = ("list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), "
                 "lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) > 0)")


@register("every_nth", ops=("P11",), sql=f"""
WITH s AS (SELECT doc_id, {SENTENCES_SQL} AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS i FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, sentence FROM e WHERE (i + 1) % 50 = 0""")
def q_every_nth(spark, sf):
    d = Tables(spark, sf).documents
    s = d.select("doc_id", F.posexplode_outer(sentences("text")).alias("sentence_index", "sentence"))
    return s.where(X.every_nth("sentence_index", 50)).select("doc_id", "sentence_index", "sentence")


# P13 / P14 ------------------------------------------------------------------
def _dsn(pages):
    u = _url_cols(pages)
    scheme = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return u.select("page_id", F.concat(
        scheme, F.lit("://user"), F.col("page_id").cast("string"), F.lit(":pw"),
        F.col("page_id").cast("string"), F.lit("@"), F.col("host"), F.lit(":"),
        (F.col("page_id") + 5000).cast("string"), F.col("path")).alias("dsn"))


DSN_SQL = f"""
_p AS (SELECT page_id, url, {HOST_SQL} AS host, {PATH_SQL} AS path, {SCHEME_SQL} AS scheme FROM pages),
_d AS (SELECT page_id, scheme || '://user' || CAST(page_id AS VARCHAR) || ':pw' || CAST(page_id AS VARCHAR)
              || '@' || host || ':' || CAST(page_id + 5000 AS VARCHAR) || path AS dsn FROM _p)"""


@register("url_parts", ops=("P13",), sql=f"""
WITH {DSN_SQL}
SELECT page_id, regexp_extract(dsn, '://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
       CAST(regexp_extract(dsn, '://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1) AS INTEGER) AS port,
       regexp_replace(regexp_extract(dsn, '://[^/?#]*([^?#]*)', 1), '^/+', '') AS database,
       regexp_extract(dsn, '://([^:/@]+)[^/@]*@', 1) AS user_name
FROM _d""")
def q_url_parts(spark, sf):
    d = _dsn(Tables(spark, sf).pages)
    return d.select("page_id", X.url_host("dsn").alias("host"), X.url_port("dsn").alias("port"),
                    X.url_database("dsn").alias("database"), X.url_user("dsn").alias("user_name"))


@register("mask_secret", ops=("P14",), sql=f"""
WITH {DSN_SQL},
_v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN dsn WHEN 1 THEN replace(dsn, ':pw', ':p@ss')
              WHEN 2 THEN replace(dsn, '://user', '://') WHEN 3 THEN 'http://h:80/x@y' ELSE 'http://u@h:80/a:b@c' END AS u FROM _d),
_a AS (SELECT *, strpos(u, '://') + 3 AS s, split_part(split_part(split_part(substr(u, strpos(u, '://') + 3), '/', 1), '?', 1), '#', 1) AS auth FROM _v),
_i AS (SELECT *, length(auth) - strpos(reverse(auth), '@') AS n, strpos(auth, ':') AS c, strpos(auth, '@') > 0 AS has FROM _a)
SELECT page_id, CASE WHEN has AND c > 0 AND c <= n
  THEN substr(u, 1, s - 1) || substr(auth, 1, c) || '******' || substr(u, s + n) ELSE u END AS masked FROM _i""")
def q_mask_secret(spark, sf):
    """Passwords with '@', empty users, ports and paths that look like one."""
    m = F.col("page_id") % 5
    u = (F.when(m == 0, F.col("dsn")).when(m == 1, F.replace("dsn", F.lit(":pw"), F.lit(":p@ss")))
         .when(m == 2, F.replace("dsn", F.lit("://user"), F.lit("://"))).when(m == 3, F.lit("http://h:80/x@y"))
         .otherwise(F.lit("http://u@h:80/a:b@c")))
    return _dsn(Tables(spark, sf).pages).select("page_id", X.mask_password(u).alias("masked"))


# A1-A3 ----------------------------------------------------------------------
@register("index_audit", ops=("A1", "A2", "A3"), sql="""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE d.text IS NOT NULL) AS with_text,
       count(CASE WHEN l.quality IS NOT NULL THEN 1 END) AS with_quality,
       count(CASE WHEN l.toxic = 1 THEN 1 END) AS flagged
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_index_audit(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total_rows"),
                 F.count_if(F.col("text").isNotNull()).alias("with_text"),
                 F.count(F.when(F.col("quality").isNotNull(), 1)).alias("with_quality"),
                 F.count(F.when(F.col("toxic") == 1, 1)).alias("flagged"))


# A4 -------------------------------------------------------------------------
@register("exists_check", ops=("A4",), sql="""
SELECT s.source, EXISTS (SELECT 1 FROM documents d JOIN labels l ON l.doc_id = d.doc_id
                         WHERE d.source = s.source AND l.toxic = 1) AS has_flagged
FROM (SELECT DISTINCT source FROM documents) s""")
def q_exists_check(spark, sf):
    t = Tables(spark, sf)
    flagged = (t.documents.select("doc_id", "source")
               .join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
               .select("source").distinct().withColumn("has_flagged", F.lit(True)))
    return (t.documents.select("source").distinct().join(flagged, "source", "left")
            .select("source", F.coalesce("has_flagged", F.lit(False)).alias("has_flagged")))


# A6 -------------------------------------------------------------------------
@register("sample_row", ops=("A6",), sql="""
SELECT doc_id, CASE WHEN text IS NOT NULL THEN substring(text, 1, 100) END AS text, lang
FROM documents ORDER BY doc_id LIMIT 1""")
def q_sample_row(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text", "lang")
    return sample_row(d, "doc_id")


# A8 / K3 --------------------------------------------------------------------
@register("chunks_per_doc", ops=("A8",), sql=f"""
WITH {token_chunks_cte()}
SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY doc_id""")
def q_chunks_per_doc(spark, sf):
    ch = token_chunks(Tables(spark, sf).documents)
    return ch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"),
                                    F.sum(F.length("text")).alias("n_chars"))


@register("batch_progress", ops=("K3",), sql=f"""
WITH {token_chunks_cte(size=100, overlap=20)},
per AS (SELECT doc_id, CAST(floor(chunk_index / 100) AS INTEGER) AS batch, count(*) AS rows
        FROM chunks GROUP BY ALL),
tot AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT per.doc_id, batch, rows,
       CAST(least((batch + 1) * 100, n) AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS progress
FROM per JOIN tot ON tot.doc_id = per.doc_id""")
def q_batch_progress(spark, sf):
    ch = token_chunks(Tables(spark, sf).documents, size=100, overlap=20)
    return batch_progress(ch, "doc_id", "chunk_index", 100)


# R10-R13, A7 ----------------------------------------------------------------
@register("missing_ids", ops=("R10",), sql="""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_missing_ids(spark, sf):
    t = Tables(spark, sf)
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@register("vector_text_join", ops=("R11", "K4"), sql="""
SELECT e.vec_id, e.label, CAST(len(e.embedding) AS INTEGER) AS dims, d.text, CAST(list_sum(list_transform(e.embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS micro_sum
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""")
def q_vector_text_join(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    micro = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * 1000000).cast("long"))
    return (t.embeddings.select("vec_id", "label", F.size("embedding").alias("dims"), micro.alias("micro_sum"))
            .join(d, "vec_id"))


@register("union_sources", ops=("R12",), sql="""
SELECT 'documents' AS origin, doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents
UNION ALL
SELECT 'benchmark' AS origin, item_id AS doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM benchmark""")
def q_union_sources(spark, sf):
    t = Tables(spark, sf)
    a = t.documents.select(F.lit("documents").alias("origin"), "doc_id", F.length("text").alias("n_chars"))
    b = t.benchmark.select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("doc_id"),
                           F.length("text").alias("n_chars"))
    return a.unionByName(b)


@register("dedup_keep_first", ops=("R13",), sql="""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 13 <> 5 THEN text END AS text FROM documents)
SELECT doc_id, source FROM d WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM d GROUP BY text)""")
def q_dedup_keep_first(spark, sf):
    """Every 13th text is unknown: those rows all stay."""
    d = Tables(spark, sf).documents.select("doc_id", "source", F.expr("case when doc_id % 13 <> 5 then text end as text"))
    return files.dedup_keep_first(d, "text", "doc_id").select("doc_id", "source")


@register("dup_counts", ops=("R13",), sql="""
SELECT min(doc_id) AS first_id, count(*) - 1 AS n_removed FROM documents GROUP BY text HAVING count(*) > 1""")
def q_dup_counts(spark, sf):
    return files.duplicate_counts(Tables(spark, sf).documents, "text", "doc_id")


@register("dup_names", ops=("R13", "A7"), sql="""
SELECT source || '.md' AS name, min(doc_id) AS first_id, count(*) - 1 AS n_removed
FROM documents GROUP BY source HAVING count(*) > 1""")
def q_dup_names(spark, sf):
    """Files of one name, however their contents differ."""
    d = (Tables(spark, sf).documents
         .select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("source"), F.lit(".md")).alias("path")))
    named = d.select("doc_id", X.basename("path").alias("name"))
    return (files.duplicate_counts(named, "name", "doc_id")
            .join(named.withColumnRenamed("doc_id", "first_id"), "first_id").select("name", "first_id", "n_removed"))


@register("dup_totals", ops=("A7",), sql="""
WITH c AS (SELECT count(*) - 1 AS n_removed FROM documents GROUP BY text HAVING count(*) > 1)
SELECT CAST(coalesce(sum(n_removed), 0) AS BIGINT) AS total_removed, count(*) AS keys_with_duplicates FROM c""")
def q_dup_totals(spark, sf):
    return files.duplicate_totals(files.duplicate_counts(Tables(spark, sf).documents, "text", "doc_id"))
