"""Small column functions: paths, previews, metadata defaults, JSON, URLs.

Each returns a Column built from Spark built-ins so it is pushed into the
generated code of the stage that uses it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# P1 -------------------------------------------------------------------------
def with_source_file(df, value, name: str = "source_file"):
    """Tag every row with the file it came from."""
    return df.withColumn(name, _c(value) if not isinstance(value, str) or value in df.columns
                         else F.lit(value))


# P2 -------------------------------------------------------------------------
def basename(path) -> Column:
    """Last path component (``os.path.basename``); '' for a trailing '/'."""
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(name) -> Column:
    """File name without its last suffix (``Path.stem``): a name that begins
    or ends with its last dot has none."""
    return F.regexp_replace(_c(name), r"(?s)^(.+)\.[^./]+\z", "$1")


def decode_file_name(path) -> Column:
    """``_metadata.file_path`` is percent-encoded; decode it, keeping '+'."""
    return F.url_decode(F.replace(_c(path), F.lit("+"), F.lit("%2B")))


# P3 / P5 --------------------------------------------------------------------
def preview(text, n: int) -> Column:
    """First n characters; NULL stays NULL."""
    t = _c(text)
    return F.when(t.isNotNull(), F.substring(t, 1, n))


# P7 -------------------------------------------------------------------------
def non_empty(c) -> Column:
    """NULL when empty, so that it can be used in ``coalesce``."""
    c = _c(c)
    return F.when(F.length(c) > 0, c)


def first_non_empty(*cols, default: str | None = None) -> Column:
    parts = [non_empty(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


# P8 -------------------------------------------------------------------------
def json_field(js, field: str) -> Column:
    return F.get_json_object(_c(js), f"$.{field}")


# P11 ------------------------------------------------------------------------
def every_nth(index, n: int, offset: int = 1) -> Column:
    """True for every n-th row of a 0-based index ((i + offset) % n == 0)."""
    return ((_c(index) + offset) % n) == 0


# P13 ------------------------------------------------------------------------
def url_host(u) -> Column:
    return F.try_parse_url(_c(u), F.lit("HOST"))


def url_path(u) -> Column:
    return F.try_parse_url(_c(u), F.lit("PATH"))


def url_user(u) -> Column:
    info = F.try_parse_url(_c(u), F.lit("USERINFO"))
    return F.when(info.isNotNull(), F.substring_index(info, ":", 1))


def url_port(u) -> Column:
    auth = F.try_parse_url(_c(u), F.lit("AUTHORITY"))
    port = F.regexp_extract(auth, r":([0-9]+)$", 1)
    return F.when(F.length(port) > 0, port.cast("int"))


def url_database(u) -> Column:
    """Path without its leading '/' (the database name of a DSN)."""
    return F.regexp_replace(url_path(u), r"^/+", "")


# P14 ------------------------------------------------------------------------
def mask_password(u) -> Column:
    """The password of an URL's authority, which ends at its last ``@``;
    the user may be empty, and a port or a path is no password."""
    return F.regexp_replace(_c(u), r"(://[^:/?#]*):[^/?#]*@", "$1:******@")


def quote_plus(s) -> Column:
    return F.url_encode(_c(s))
