"""SQL text helpers for the DuckDB oracle side."""

from __future__ import annotations


def duck_display_number(x: str) -> str:
    """DuckDB expression equal to Java's ``DecimalFormat("0.#")`` of DOUBLE ``x``.

    Java rounds half-even on the exact binary value. x*10 is split exactly as
    x*8 + x*2 (both exact); a two-sum error term tells whether the exact
    product lies below, on or above a .5 tie that the rounded product shows.
    """
    ax = f"abs(CAST({x} AS DOUBLE))"
    a, b = f"({ax} * 8.0)", f"({ax} * 2.0)"
    s = f"({a} + {b})"
    err = f"({b} - ({s} - {a}))"
    fl = f"floor({s})"
    fr = f"({s} - {fl})"
    r = (f"CAST(CASE WHEN {fr} > 0.5 THEN {fl} + 1 WHEN {fr} < 0.5 THEN {fl} "
         f"WHEN {err} > 0 THEN {fl} + 1 WHEN {err} < 0 THEN {fl} "
         f"WHEN CAST({fl} AS BIGINT) % 2 = 0 THEN {fl} ELSE {fl} + 1 END AS BIGINT)")
    sign = f"CASE WHEN CAST({x} AS DOUBLE) < 0 THEN '-' ELSE '' END"
    digits = (f"CAST({r} // 10 AS VARCHAR) || CASE WHEN {r} % 10 = 0 THEN '' "
              f"ELSE '.' || CAST({r} % 10 AS VARCHAR) END")
    return f"CASE WHEN {x} IS NULL THEN '' ELSE {sign} || {digits} END"
