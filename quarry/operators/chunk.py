"""Chunking: token windows, Markdown sections, sentence packing, links.

All chunkers are narrow (row-local array functions + explode): a document
is never split across tasks and no shuffle is needed.

Generators are ``*_outer`` followed by a NULL filter on purpose: for an
inner explode Catalyst infers ``size(array) > 0`` and pushes it below the
projection, evaluating the (expensive) array expression twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import let, sentences, strip, words

# Chunking parameters of the ingest.
TOKEN_CHUNK_SIZE = 800
TOKEN_CHUNK_OVERLAP = 200
PAGE_CHARS = 2000           # page estimate: characters per page
PAGE_CHUNK_CHARS = 800      # page estimate: characters per chunk index
SENTENCE_CHUNK_SIZE = 1024
SENTENCE_CHUNK_OVERLAP = 50
PARAGRAPH_SEPARATOR = "\n\n\n"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_id(doc_id, index) -> Column:
    return F.concat(_c(doc_id).cast("string"), F.lit("-"), _c(index).cast("string"))


# T3 -------------------------------------------------------------------------
def n_windows(n_words: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return F.when(n_words <= size, F.lit(1)).otherwise(
        (F.ceil((n_words - size) / F.lit(step)) + 1).cast("int"))


def token_chunks(docs: DataFrame, size: int = TOKEN_CHUNK_SIZE,
                 overlap: int = TOKEN_CHUNK_OVERLAP, id_col: str = "doc_id",
                 text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Sliding windows of ``size`` tokens that overlap by ``overlap``.

    Windows start at 0, step, 2*step, ...; the last one is the first to
    reach the end of the document. The chunk texts are built inside the row
    (``transform`` over the window starts) and exploded once, so each chunk
    string is materialised exactly once.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    chunks = let(words(text_col), lambda w: F.transform(
        F.sequence(F.lit(0), n_windows(F.size(w), size, overlap) - 1),
        lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")))
    out = docs.select(F.col(id_col), *[F.col(k) for k in keep], chunks.alias("_chunks"))
    return (out.select(F.col(id_col), *[F.col(k) for k in keep],
                       F.size("_chunks").alias("n_chunks"),
                       F.posexplode_outer("_chunks").alias("chunk_index", "text"))
            .where(F.col("chunk_index").isNotNull())
            .withColumn("chunk_id", chunk_id(id_col, "chunk_index")))


# P10 ------------------------------------------------------------------------
def page_estimate(chunk_index, chunk_chars: int = PAGE_CHUNK_CHARS,
                  page_chars: int = PAGE_CHARS) -> Column:
    """Page of a chunk from its 0-based position: max(1, i*800 // 2000 + 1)."""
    i = _c(chunk_index).cast("long")
    return F.greatest(F.lit(1), F.floor(i * chunk_chars / page_chars) + 1).cast("int")


# T6 -------------------------------------------------------------------------
def chunk_links(chunks: DataFrame, doc_col: str = "doc_id",
                index_col: str = "chunk_index", id_col: str = "chunk_id") -> DataFrame:
    """Previous / next chunk ids inside a document (window per document)."""
    w = Window.partitionBy(doc_col).orderBy(index_col)
    return chunks.select("*", F.lag(id_col).over(w).alias("prev_id"),
                         F.lead(id_col).over(w).alias("next_id"))


# T7 -------------------------------------------------------------------------
def first_lines(text, n: int = 2) -> Column:
    """Keep the first n lines of a text without white space at its ends."""
    return F.array_join(F.slice(F.split(strip(text), "\n"), 1, n), "\n")


# T2 -------------------------------------------------------------------------
HEADING = r"(?s)^(#+)\s(.*)"
_HEAD = "struct<pos:int,level:int,title:string>"


def _headings(lines: Column) -> Column:
    """The headings outside code fences: position, level and title."""
    def found(fences):
        def one(line, i):
            outside = (F.get(fences, i) % 2 == 0) & ~F.ltrim(line).startswith("```")
            level = F.length(F.regexp_extract(line, HEADING, 1))
            return F.when(outside & F.startswith(line, F.lit("#")) & (level > 0),
                          F.struct(i.alias("pos"), level.alias("level"), F.trim(F.regexp_extract(line, HEADING, 2)).alias("title")))
        return F.filter(F.transform(lines, one), lambda h: h.isNotNull())
    # a document without fences needs no running count of them
    fence = F.transform(lines, lambda line: F.ltrim(line).startswith("```").cast("long"))
    counts = let(fence, lambda f: F.when(F.array_max(f) == 1, prefix_sums(f)).otherwise(f))
    return let(counts, found)


def _paths(heads: Column) -> Column:
    """The path of titles above each heading, by a stack of the headings
    that are still open: a heading closes those of its own and deeper levels.

    The fold goes over runs of about the square root of the headings, so that
    no step copies the paths of the whole document."""
    def step(acc, h):
        def opened(above):
            path = F.when(F.size(above) == 0, F.lit("/")).otherwise(
                F.concat(F.lit("/"), F.array_join(F.transform(above, lambda a: a["title"]), "/"), F.lit("/")))
            return F.struct(F.concat(above, F.array(h)).alias("open"), F.concat(acc["paths"], F.array(path)).alias("paths"))
        return let(F.filter(acc["open"], lambda a: a["level"] < h["level"]), opened)

    none = F.array().cast("array<string>")
    width = F.ceil(F.sqrt(F.size(heads))).cast("int")

    def run(acc, i):
        start = F.struct(acc["open"].alias("open"), none.alias("paths"))
        return let(F.aggregate(F.slice(heads, i + 1, width), start, step),
                   lambda x: F.struct(x["open"].alias("open"), F.concat(acc["paths"], F.array(x["paths"])).alias("paths")))
    start = F.struct(F.array().cast(f"array<{_HEAD}>").alias("open"), F.array().cast("array<array<string>>").alias("paths"))
    folded = F.aggregate(F.sequence(F.lit(0), F.size(heads) - 1, width), start, run)
    return F.when(F.size(heads) > 0, F.flatten(folded["paths"])).otherwise(none)


def markdown_sections(docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Split Markdown at headings outside code fences.

    Output: doc_id, the columns ``keep`` of the document, section_index,
    header_path, text (heading line included).
    ``header_path`` is '/' + ancestor titles joined by '/' + '/', or '/'.
    Headings may have any level. All of it is folded inside the row of a
    document, without a shuffle; text before the first heading is section 0,
    blank sections and NULL texts give no row.
    """
    def cut(lines):
        def with_heads(heads):
            def with_paths(paths):
                def section(i):
                    start = F.when(i == 0, F.lit(0)).otherwise(F.get(heads, i - 1)["pos"])
                    end = F.coalesce(F.get(heads, i)["pos"], F.size(lines))
                    return F.struct(i.alias("section_index"), F.when(i == 0, F.lit("/")).otherwise(F.get(paths, i - 1)).alias("header_path"),
                                    F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("text"))
                return F.transform(F.sequence(F.lit(0), F.size(heads)), section)
            return let(_paths(heads), with_paths)
        return let(_headings(lines), with_heads)

    cuts = let(F.split(_c(text_col), "\n", -1), cut)
    out = docs.select(F.col(id_col), *keep, F.explode_outer(F.when(_c(text_col).isNotNull(), cuts)).alias("_s"))
    out = out.where(F.col("_s").isNotNull()).select(F.col(id_col), *keep, "_s.section_index", "_s.header_path", "_s.text")
    return out.where(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0)


# T4 -------------------------------------------------------------------------
def prefix_sums(arr: Column) -> Column:
    """Inclusive prefix sums of a numeric array inside the row.

    Hillis-Steele scan: step k adds the element 2**k places back, for as many
    steps as the array needs, whatever its length: O(n log n), where
    appending in a fold would be O(n^2).
    """
    def step(a, k):
        return F.transform(a, lambda x, i: x + F.when(
            i >= F.call_function("shiftleft", F.lit(1), k),
            F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))).otherwise(F.lit(0)))

    def scan(a):
        steps = F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)))).cast("int")
        return F.aggregate(F.sequence(F.lit(0), steps), a, step)
    return let(F.transform(arr, lambda x: F.coalesce(x, F.lit(0)).cast("long")), scan)


def sentence_chunks(docs: DataFrame, limit: int = SENTENCE_CHUNK_SIZE,
                    overlap: int = SENTENCE_CHUNK_OVERLAP,
                    paragraph_separator: str = PARAGRAPH_SEPARATOR,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Greedy sentence packing (sizes in words), paragraph by paragraph.

    With prefix sums P of sentence word counts, a chunk [s, e) ends before
    the first sentence i > s with P[i+1] - P[s] > limit. The next chunk
    starts at the smallest j in (s, i] with P[i] - P[j] <= overlap and
    P[i+1] - P[j] <= limit, or at i. A sentence longer than the limit is a
    chunk of its own. Row-local: a fold over the sentence array of one
    paragraph, no shuffle.
    """
    paras = docs.select(F.col(id_col),
                        F.posexplode_outer(F.split(_c(text_col), paragraph_separator, -1))
                        .alias("paragraph", "ptext")).where(F.col("paragraph").isNotNull())
    sents = paras.withColumn("_s", sentences("ptext"))
    sents = sents.withColumn("_len", F.transform("_s", lambda s: F.size(F.split(s, " "))))
    # prefix sums P[0..n] (long)
    sents = sents.withColumn("_P", F.concat(F.array(F.lit(0).cast("long")),
                                            prefix_sums(F.col("_len"))))
    P = F.col("_P")

    def p(i):  # P[i], 0-based
        return F.element_at(P, (i + 1).cast("int"))

    n = F.size("_len")
    init = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc, i):
        s = acc["s"]
        overflow = (i > s) & ((p(i + 1) - p(s)) > limit)
        cand = F.filter(F.sequence(s + 1, F.greatest(i, s + 1)),
                        lambda j: (j <= i) & ((p(i) - p(j)) <= overlap) & ((p(i + 1) - p(j)) <= limit))
        nxt = F.coalesce(F.array_min(cand), i)
        return F.when(overflow, F.struct(
            nxt.alias("s"),
            F.concat(acc["out"], F.array(F.struct(s.alias("s"), i.alias("e")))).alias("out"),
        )).otherwise(acc)

    folded = F.aggregate(F.sequence(F.lit(0), n - 1), init, step)
    bounds = F.when(n == 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(
        F.concat(folded["out"], F.array(F.struct(folded["s"].alias("s"), n.alias("e")))))
    out = sents.select(F.col(id_col), "paragraph", "_s",
                       F.posexplode_outer(bounds).alias("_k", "_b")).where(F.col("_k").isNotNull())
    out = out.select(
        F.col(id_col), "paragraph", F.col("_k").alias("chunk_in_paragraph"),
        F.array_join(F.slice("_s", F.col("_b.s") + 1, F.col("_b.e") - F.col("_b.s")), " ").alias("text"),
        F.col("_b.s").alias("first_sentence"), (F.col("_b.e") - F.col("_b.s")).alias("n_sentences"),
    )
    w = Window.partitionBy(id_col).orderBy("paragraph", "chunk_in_paragraph")
    return (out.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("int"))
            .withColumn("chunk_id", chunk_id(id_col, "chunk_index"))
            .drop("chunk_in_paragraph"))
