"""Column functions over whole texts, built only from Spark's JVM built-ins.

Regex character classes are spelled out (no ``\\s``/``\\w``/``\\b``) because
Java and RE2 disagree on some of them; every pattern here means the same in
both engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Java's String.trim() removes: every code point <= U+0020.
CTRL_SPACE = r"\x00-\x20"
# Java's \s: space, tab, newline, vertical tab, form feed, carriage return.
JAVA_SPACE = r"[\t\n\x0B\f\r ]"

# Decision points counted by the cyclomatic complexity rule.
DECISION_WORDS = ("if", "for", "while", "case", "catch")
DECISION_SYMBOLS = ("&&", "||", "?")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c: Column | str) -> Column:
    """String.trim(): strip code points <= U+0020 at both ends."""
    return F.regexp_replace(_c(c), rf"^[{CTRL_SPACE}]+|[{CTRL_SPACE}]+$", "")


def lines(c: Column | str) -> Column:
    """The text split at '\\n' (trailing empty piece kept, like the reader)."""
    return F.split(_c(c), "\n")


def line_count(c: Column | str) -> Column:
    """Number of physical lines: count of '\\n' plus one."""
    t = _c(c)
    return F.length(t) - F.length(F.regexp_replace(t, "\n", "")) + 1


def strip_comments(c: Column | str) -> Column:
    """Remove /* ... */ blocks and // line comments (no string awareness)."""
    return F.regexp_replace(_c(c), r"(?s)/\*.*?\*/|//[^\n]*", "")


def sloc(c: Column | str) -> Column:
    """Physical lines that are not blank after comment removal."""
    ls = F.split(strip_comments(c), "\n")
    return F.size(F.filter(ls, lambda x: java_trim(x) != F.lit("")))


def identifiers(c: Column | str) -> Column:
    """ASCII identifier-like tokens ``[A-Za-z_][A-Za-z0-9_]*`` in order."""
    return F.regexp_extract_all(_c(c), F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)


def ascii_tokens(c: Column | str) -> Column:
    """Lower-cased ASCII word tokens ``[a-z0-9]+`` in order (clone tokens)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), 0)


def count_substring(c: Column | str, needle: str) -> Column:
    t = _c(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("long")


def decision_count(c: Column | str, words: Sequence[str] = DECISION_WORDS,
                   symbols: Sequence[str] = DECISION_SYMBOLS) -> Column:
    """Number of decision keywords (whole identifiers) plus decision symbols."""
    ws = F.array(*[F.lit(w) for w in words])
    n_words = F.size(F.filter(identifiers(c), lambda t: F.array_contains(ws, t)))
    n_syms = sum((count_substring(c, s) for s in symbols), F.lit(0).cast("long"))
    return n_words.cast("long") + n_syms


def cyclomatic(c: Column | str, words: Sequence[str] = DECISION_WORDS,
               symbols: Sequence[str] = DECISION_SYMBOLS) -> Column:
    """1 + decision points (our definition; not claimed equal to any external tool)."""
    return decision_count(c, words, symbols) + 1


def first_token(c: Column | str) -> Column:
    """``s.trim().split("\\s")[0]``: leading run of non-space characters."""
    return F.regexp_extract(java_trim(c), rf"^([^\t\n\x0B\f\r ]*)", 1)


def marker_line(c: Column | str, marker_prefix: str, needle: str) -> Column:
    """Struct(marker, match, value) of the line-count report rule.

    ``marker`` = first line whose lower-cased trimmed text starts with
    ``marker_prefix``; ``match`` = first later line that contains ``needle``;
    ``value`` = the first token of the matched line. Positions are 0-based;
    the struct is NULL when either line is missing. Runs per row on the whole
    text (no shuffle).
    """
    ls = lines(c)
    flags = F.transform(ls, lambda x: F.startswith(F.lower(java_trim(x)), F.lit(marker_prefix)))
    m = F.array_position(flags, F.lit(True))  # 1-based, 0 if absent
    after = F.slice(ls, F.greatest(m, F.lit(1)).cast("int") + 1, F.size(ls))
    rel = F.array_position(F.transform(after, lambda x: F.contains(x, F.lit(needle))), F.lit(True))
    k = m + rel
    return F.when((m > 0) & (rel > 0), F.struct(
        (m - 1).alias("marker"), (k - 1).alias("match"),
        first_token(F.element_at(ls, k.cast("int"))).alias("value")))


def with_marker_line(df, text_col: str, marker_prefix: str, needle: str, out: str = "m"):
    """DataFrame form of ``marker_line``: the split lines and the marker index are
    materialised as columns in their own projections, so each is computed once
    per row instead of once per use."""
    ls, m = "_ml_lines", "_ml_marker"
    staged = df.withColumn(ls, lines(text_col))
    staged = staged.withColumn(m, F.array_position(F.transform(
        ls, lambda x: F.startswith(F.lower(java_trim(x)), F.lit(marker_prefix))), F.lit(True)))
    after = F.slice(ls, F.greatest(F.col(m), F.lit(1)).cast("int") + 1, F.size(ls))
    staged = staged.withColumn("_ml_rel", F.array_position(
        F.transform(after, lambda x: F.contains(x, F.lit(needle))), F.lit(True)))
    k = F.col(m) + F.col("_ml_rel")
    res = F.when((F.col(m) > 0) & (F.col("_ml_rel") > 0), F.struct(
        (F.col(m) - 1).alias("marker"), (k - 1).alias("match"),
        first_token(F.element_at(ls, k.cast("int"))).alias("value")))
    return staged.withColumn(out, res).drop(ls, m, "_ml_rel")
