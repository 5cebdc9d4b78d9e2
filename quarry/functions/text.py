"""Token, term and sentence column functions.

All of them are built-in Spark expressions (JVM side, no Python), so they
stay inside whole-stage code generation and run where the data is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words removed before full-text indexing
# (the common Snowball English list, alphabetical).
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because "
    "been before being below between both but by can did do does doing don "
    "down during each few for from further had has have having he her here "
    "hers herself him himself his how i if in into is it its itself just me "
    "more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own s same she should so some such t than that the "
    "their theirs them themselves then there these they this those through to "
    "too under until up very was we were what when where which while who whom "
    "why will with you your yours yourself yourselves"
).split()

WORD_PATTERN = r"\S+"          # token for chunking: maximal non-blank run
TERM_PATTERN = r"\p{L}+"       # term for full-text search: run of letters
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text) -> Column:
    """White space of any kind removed at both ends (``trim`` only removes
    blanks)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+\z", "")


def words(text) -> Column:
    """Whitespace tokens of a text, in order (ARRAY<STRING>)."""
    return F.regexp_extract_all(_c(text), F.lit(WORD_PATTERN), 0)


def raw_terms(text) -> Column:
    """Lower-cased letter runs, stop words kept."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TERM_PATTERN), 0)


_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


def stop_word_array() -> Column:
    """The stop list as one array literal (built by a single SQL expression:
    127 ``lit`` calls would cost a py4j round trip each)."""
    return F.expr(f"array({_STOP_SQL})")


def terms(text) -> Column:
    """Index terms: lower-cased letter runs without stop words (R3).

    For a named column the whole expression is one SQL string, whose
    ``IN (...)`` list is planned as a hash-set lookup (InSet). Other
    inputs (lambda variables, computed columns) test membership in the
    stop-list array."""
    if isinstance(text, str) and "." not in text and "`" not in text:
        return F.expr(f"filter(regexp_extract_all(lower(`{text}`), r'{TERM_PATTERN}', 0), "
                      f"t -> NOT t IN ({_STOP_SQL}))")
    stops = stop_word_array()
    return F.filter(raw_terms(text), lambda t: ~F.array_contains(stops, t))


def term_set(text) -> Column:
    """Distinct index terms in order of first occurrence (hash-based
    ``array_except`` removes the stop words and the repeats at once)."""
    return F.array_except(raw_terms(text), stop_word_array())


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A Column expression repeated inside a lambda is re-evaluated per
    element (e.g. a regex over the whole text per chunk); binding it as a
    lambda variable computes it once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sentences(text) -> Column:
    """Sentences: runs up to and including terminal punctuation, blanks
    collapsed, empty ones dropped."""
    parts = F.regexp_extract_all(_c(text), F.lit(SENTENCE_PATTERN), 0)
    cleaned = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(cleaned, lambda s: F.length(s) > 0)


def sql_string_list(values) -> str:
    """SQL literal list, for oracle queries that need the same fixed values."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
