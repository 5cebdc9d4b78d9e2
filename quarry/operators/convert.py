"""Raw pages to ordered blocks, and blocks back to Markdown (T1, K2).

A page is read once from left to right into tokens (comments, script and
style elements, tags with their quoted attributes, text), each token is
mapped on its own, and the pieces between blocks are exploded: all inside the
page's row, so pages convert in parallel with no shuffle, and malformed
markup is text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The block rule.
RAW_ELEMENTS = ("script", "style")          # no text for readers
REGIONS = ("nav", "footer")                 # the kind of all text inside
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "blockquote", "dt", "dd", "caption", "title")
CONTAINERS = ("html", "head", "body", "div", "section", "article", "main", "header", "aside", "form", "figure", "figcaption",
              "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "hr", "br")
OTHER = "text"
BREAK, KIND_END, REGION, REGION_END = "\x01", "\x02", "\x03", "\x04"
MARKDOWN_PREFIX = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### ", "li": "- "}
# attributes up to the end of a tag; a quote counts right behind an equals sign
ATTRIBUTES = """(?=[\\s/>])(?:=\\s*+"[^"]*+"|=\\s*+'[^']*+'|[^<>=]++|=)*+>"""
TOKEN = ("(?is)<!--.*?-->|<[!?][a-z][^>]*+>"
         f"|<({'|'.join(RAW_ELEMENTS)}){ATTRIBUTES}.*?</\\1\\s*+>"
         f"|</?[a-z][a-z0-9:-]*+{ATTRIBUTES}|[^<]++|<")
ENTITY = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def decode_entities(text: str) -> str:
    """SQL: ``text`` with its character references decoded, each once (so
    ``&amp;lt;`` gives ``&lt;``); unknown names stay as they are."""
    from html.entities import name2codepoint
    names = ", ".join(f"'{n}', {c}" for n, c in sorted(name2codepoint.items()) + [("apos", 39)])
    code = (f"case when name like '#x%' or name like '#X%' then cast(conv(substring(name, 3), 16, 10) as int)"
            f" when name like '#%' then cast(substring(name, 2) as int) else names[name] end")
    char = ("if(code is null or code <= 0 or code > 1114111 or (code >= 55296 and code <= 57343), concat('&', name, ';'),"
            " decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32'))")

    def let(name, value, body):
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"
    one = let("code", code, char)
    many = (f"array_join(transform(sequence(0, size(rest) - 1), i -> concat(rest[i], if(i < size(found),"
            f" {let('name', 'coalesce(get(found, i), cast(null as string))', one)}, ''))), '')")
    body = let("names", f"map({names})", let("found", f"regexp_extract_all({text}, r'{ENTITY}', 1)",
                                             let("rest", f"split({text}, r'{ENTITY}', -1)", many)))
    return f"case when contains({text}, '&') then {body} else {text} end"


def _mapped(token):
    """What a token becomes: text stays, tags of blocks and regions become
    marks, all other markup a space."""
    name = F.lower(F.regexp_extract(token, "^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    closing = F.startswith(token, F.lit("</"))
    raw = F.lower(token).rlike(f"^<({'|'.join(RAW_ELEMENTS)})[\\s/>]")
    tag = (F.when(raw, F.lit(" "))
           .when(name.isin(*REGIONS), F.concat(F.lit(REGION), F.when(closing, F.lit("")).otherwise(name), F.lit(REGION_END)))
           .when(name.isin(*BLOCKS) & ~closing, F.concat(F.lit(BREAK), name, F.lit(KIND_END)))
           .when(name.isin(*BLOCKS, *CONTAINERS), F.lit(BREAK + OTHER + KIND_END))
           .otherwise(F.lit(" ")))
    is_text = ~F.startswith(token, F.lit("<")) | (F.length(token) == 1)
    return F.when(is_text, F.translate(token, BREAK + KIND_END + REGION + REGION_END, "    ")).otherwise(tag)


def _pieces(region):
    """(kind, text) of the pieces of one region."""
    kind, body = F.substring_index(region, REGION_END, 1), F.substring_index(region, REGION_END, -1)
    return F.transform(F.split(F.concat(F.lit(OTHER + KIND_END), body), BREAK, -1), lambda p: F.struct(
        F.when(kind != "", kind).otherwise(F.substring_index(p, KIND_END, 1)).alias("kind"),
        F.trim(F.regexp_replace(F.substring_index(p, KIND_END, -1), r"\s+", " ")).alias("text")))


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, block_pos, kind, text) for every piece of text of a page.

    Comments, declarations and whole script and style elements are no text.
    Every opening or closing tag of a block or a container ends a piece; a
    piece that a block tag opens has that tag as its kind, all text inside
    ``nav`` and ``footer`` that kind, all other text is kind ``text``. What
    looks like markup but is none is text: a bare ``<`` or ``>``, a comment or
    a script that never ends. Inline tags become spaces, runs of whitespace
    one space, character references are decoded. Positions follow the page
    order (with gaps).
    """
    marked = F.array_join(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(TOKEN), 0), _mapped), "")
    regions = F.split(F.concat(F.lit(REGION_END), marked), REGION, -1)
    # outer explode: an inner one makes Catalyst push ``size(..) > 0``
    # to the scan, which would run the whole chain twice
    out = pages.select(F.col(id_col), F.posexplode_outer(F.flatten(F.transform(regions, _pieces))).alias("block_pos", "piece"))
    out = out.where(F.length("piece.text") > 0).select(id_col, "block_pos", "piece.kind", "piece.text")
    return out.withColumn("text", F.expr(decode_entities("text")))


def blocks_to_markdown(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, markdown, n_blocks): body blocks rendered in page order,
    headings with one '#' for each level, list items as '- ', all else
    but the title, navigation and footers as is, joined by a blank line. Grouped per page (bounded by the page's own size)."""
    prefix = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in MARKDOWN_PREFIX.items()], F.lit(""))
    body = blocks.where(~F.col("kind").isin("title", *REGIONS))
    md = body.select(id_col, "block_pos", F.concat(prefix, F.col("text")).alias("md"))
    return (md.groupBy(id_col)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "md"))),
                                          lambda s: s["md"]), "\n\n").alias("markdown"),
                 F.count(F.lit(1)).alias("n_blocks")))
