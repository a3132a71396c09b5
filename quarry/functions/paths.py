"""Path and URL pieces (EXP3-EXP6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def id_from_name(c: Column | str) -> Column:
    """Integer before the first '.' of a file name (NULL when not an integer)."""
    return F.substring_index(_c(c), ".", 1).try_cast("int")


def base_name(c: Column | str) -> Column:
    """Last non-empty '/'-separated segment (a trailing '/' is ignored)."""
    return F.regexp_extract(_c(c), r"([^/]+)/?$", 1)


def suffix(c: Column | str) -> Column:
    """Text after the last '.' of a name, '' when there is none."""
    c = _c(c)
    return F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", -1)).otherwise(F.lit(""))


def sanitize(c: Column | str) -> Column:
    """'(' and ')' replaced by '_' (names the line counter cannot take)."""
    return F.translate(_c(c), "()", "__")


def url_host(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^[a-z]+://([^/?#]+)", 1)


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def url_origin(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^([a-z]+://[^/?#]+)", 1)


def rebase(c: Column | str, old_root: Column, new_root: Column) -> Column:
    """Swap a leading root for another (tree-prefix rewrite)."""
    c = _c(c)
    return F.when(F.startswith(c, old_root),
                  F.concat(new_root, F.substring(c, F.length(old_root) + 1, F.length(c)))).otherwise(c)
