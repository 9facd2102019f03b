"""Column builders for Python-compatible string semantics.

Spark's ``trim`` removes only the space character, and Java's ``\\s`` is ASCII-only, while the
rules we reproduce use Python's ``str.strip`` (every character for which ``isspace`` holds).
All builders here are plain JVM expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
PY_WS_CLASS = (
    "[\\t\\n\\x0B\\x0C\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same characters listed one by one, for the (non-regex) trim functions.
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Python ``str.strip()`` of a string column: ``trim`` with Python's whitespace set (no regex)."""
    return F.trim(col_(c), F.lit(PY_WS_CHARS))


def py_lstrip(c) -> Column:
    return F.ltrim(col_(c), F.lit(PY_WS_CHARS))


def leading_ws(c) -> Column:
    """``len(line) - len(line.lstrip())``."""
    return F.length(col_(c)) - F.length(py_lstrip(c))


def count_sub(c, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring (Python ``str.count``)."""
    c = col_(c)
    removed = F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))
    # most lines lack most keywords: test first, build the replaced string only on a hit
    return F.when(c.contains(sub), (removed / F.lit(len(sub))).cast("long")).otherwise(F.lit(0).cast("long"))


def count_any(c, subs) -> Column:
    """Sum of ``str.count`` over a list of literal substrings."""
    if not subs:
        return F.lit(0).cast("long")
    return reduce(lambda a, b: a + b, [count_sub(c, s) for s in subs])


def contains_any(c, subs) -> Column:
    c = col_(c)
    return reduce(lambda a, b: a | b, [c.contains(s) for s in subs])


def ends_with_any(c, suffixes) -> Column:
    c = col_(c)
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])


def by_language(lang, table: dict, builder, default) -> Column:
    """``CASE lang WHEN k THEN builder(v) ... ELSE default`` for a per-language table."""
    lang = col_(lang)
    out = None
    for k, v in table.items():
        out = (F.when(lang == k, builder(v)) if out is None else out.when(lang == k, builder(v)))
    return default if out is None else out.otherwise(default)


def normalise_newlines(c) -> Column:
    """Universal-newline reading: CRLF and lone CR become LF."""
    return F.regexp_replace(col_(c), "\\r\\n?", "\n")


def filled(sentence: str, value=None) -> Column:
    """A report sentence as a column, with ``value`` (a column) in the place of ``{}``."""
    if value is None:
        return F.lit(sentence)
    before, after = sentence.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))
