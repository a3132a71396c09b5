"""Numbers and key=value triples embedded in report messages (EXP1, EXP2).

Spark 4 runs with ANSI mode on, so parsing uses ``try_cast`` and
``try_element_at``: malformed input becomes NULL instead of failing a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number preceded by one whitespace character (Java's \s spelled out), so
# identifiers that contain digits do not match.
NUMBER_AFTER_SPACE = r"[\t\n\x0B\f\r ]([0-9]+)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message_numbers(c: Column | str) -> Column:
    """All numbers preceded by whitespace, as BIGINT (NULL if out of range)."""
    found = F.regexp_extract_all(_c(c), F.lit(NUMBER_AFTER_SPACE), 1)
    return F.transform(found, lambda x: x.try_cast("bigint"))


def value_and_max(c: Column | str) -> Column:
    """Struct(value, max, n): first number, second number (or NULL), count.

    NULL when the message holds no number (the reference writes no row).
    """
    nums = message_numbers(c)
    return F.when(F.size(nums) > 0, F.struct(
        F.try_element_at(nums, F.lit(1)).alias("value"),
        F.try_element_at(nums, F.lit(2)).alias("max"),
        F.size(nums).cast("long").alias("n_numbers")))


def key_value_pairs(c: Column | str, open_: str = "?", close: str = "#", item_sep: str = "&",
                    kv_sep: str = "=") -> Column:
    """Array of struct(key, value) for the text between ``open_`` and ``close``.

    Items are split on ``item_sep`` and then at the first ``kv_sep``; keys and
    values are trimmed; an empty value is NULL. Empty items are dropped.
    """
    o, cl = _re_escape(open_), _re_escape(close)
    inner = F.regexp_extract(_c(c), f"{o}([^{cl}]*)", 1)
    items = F.filter(F.split(inner, _re_escape(item_sep)), lambda x: x != F.lit(""))

    def pair(x: Column) -> Column:
        key = F.trim(F.substring_index(x, kv_sep, 1))
        has = F.locate(kv_sep, x) > 0
        val = F.when(has, F.trim(F.substring(x, F.locate(kv_sep, x) + len(kv_sep), F.length(x))))
        return F.struct(key.alias("key"), F.nullif(val, F.lit("")).alias("value"))

    return F.transform(items, pair)


def godclass_triple(c: Column | str) -> Column:
    """Struct(wmc int, atfd int, tcc double) from ``...(WMC=a, ATFD=b, TCC=c)...``.

    Text between the first '(' and the next ')', split at ',', each at '=';
    unparsable parts are NULL.
    """
    inner = F.regexp_extract(_c(c), r"\(([^)]*)\)", 1)
    parts = F.split(inner, ",")

    def nth(i: int) -> Column:
        item = F.try_element_at(parts, F.lit(i))
        return F.trim(F.try_element_at(F.split(item, "="), F.lit(2)))

    return F.struct(nth(1).try_cast("int").alias("wmc"), nth(2).try_cast("int").alias("atfd"),
                    nth(3).try_cast("double").alias("tcc"))


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/-" else ch for ch in s)
