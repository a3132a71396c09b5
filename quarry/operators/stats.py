"""Descriptive statistics: histograms, exact order statistics, prevalence, cumulative share.

All functions are DataFrame in, DataFrame out. Nothing is collected.

The order statistics never sort raw rows. Values are first reduced to a
per-value histogram ``(keys, value, count)`` by a partially aggregated
``groupBy``; the running count window then sees one row per *distinct*
value of a key, and a final ``groupBy(keys)`` reuses the window's
partitioning. For integer metrics (counts, sizes) the number of distinct values
is tiny compared with the number of rows, whatever the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.prefix import running_sum

FIVE_NUMBER_COLUMNS = ("n", "mean", "min", "q1", "median", "q3", "max")


def histogram(df: DataFrame, value_col: str, count_alias: str = "n",
              buckets: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``value, COUNT(*)`` per value (optionally per extra keys ``by``).

    ``buckets`` restricts the output to an explicit list of values; buckets
    with no rows are not zero-filled (the reference's IN-list histograms).
    """
    if buckets is not None:
        df = df.filter(F.col(value_col).isin(list(buckets)))
    keys = [*by, value_col]
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_alias))
            .orderBy(*keys))


def _rank_positions(n: Column) -> dict[str, tuple[Column, Column]]:
    """0-based (low, high) positions of Q1, median and Q3 in the sorted sample.

    The rule is the reference's own (not an interpolating percentile):
      median  n even: mean of n/2-1 and n/2;  odd: n div 2
      Q1      n%4=0:  mean of n/4-1 and n/4;  else: n div 4
      Q3      n odd:  n div 4 + ceil(n/2);  n%4=0: mean of 3n/4-1 and 3n/4;
              n%4=2: n div 4 + n/2
    For n = 1 the Q3 position is out of range and the result is NULL.
    """
    q = F.floor(n / 4)
    h = F.floor(n / 2)
    med_lo = F.when(n % 2 == 0, h - 1).otherwise(h)
    q1_lo = F.when(n % 4 == 0, q - 1).otherwise(q)
    q3_hi = F.when(n % 2 == 1, q + F.ceil(n / 2)).otherwise(q + h)
    q3_lo = F.when(n % 4 == 0, q3_hi - 1).otherwise(q3_hi)
    return {"q1": (q1_lo, q), "median": (med_lo, h), "q3": (q3_lo, q3_hi)}


def five_number(df: DataFrame, value_col: str, keys: Sequence[str] = (),
                rule: str = "reference", method: str = "window") -> DataFrame:
    """Exact ``n, mean, min, q1, median, q3, max`` of ``value_col`` per ``keys``.

    ``rule="reference"`` reproduces the reference's rank rule (see
    ``_rank_positions``); ``rule="linear"`` (alias ``"standard"``) gives the
    interpolated quartiles of Spark's exact ``percentile``. Keys with no rows
    produce no output row.

    ``method`` chooses how the running count over the per-key value histogram
    is computed: ``"window"`` (one task per key over its distinct values - right
    for counts and sizes, whose distinct values are few) or ``"range"``
    (``prefix.running_sum``: range-partitioned, for keys with very many
    distinct values, e.g. unrounded doubles).
    """
    keys = list(keys)
    v = F.col(value_col)
    if rule in ("linear", "standard"):
        pct = F.percentile(v.cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return (df.filter(v.isNotNull()).groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("n"), F.avg(v.cast("double")).alias("mean"),
                     F.min(v).cast("double").alias("min"), pct.alias("_p"),
                     F.max(v).cast("double").alias("max"))
                .select(*keys, "n", "mean", "min", F.col("_p")[0].alias("q1"),
                        F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q3"), "max"))
    if rule != "reference":
        raise ValueError(f"unknown rule {rule!r}")

    hist = (df.filter(v.isNotNull())
            .groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    if method == "range":
        upto = running_sum(hist, keys, ["_v"], "_c", out="_upto", method="range")
        if keys:
            n_tab = upto.groupBy(*keys).agg(F.max("_upto").alias("_n"))
            upto = upto.join(n_tab, keys)
        else:  # one group: n is a scalar subquery, no join
            upto = upto.withColumn("_n", hist.select(F.sum("_c")).scalar())
        ranked = upto.withColumn("_before", F.col("_upto") - F.col("_c"))
    elif method == "window":
        by_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
        running = by_key.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = (hist
                  .withColumn("_n", F.sum("_c").over(by_key))
                  .withColumn("_before", F.sum("_c").over(running) - F.col("_c")))
    else:
        raise ValueError(f"unknown method {method!r}")
    n = F.col("_n")
    positions = _rank_positions(n)

    def value_at(pos: Column) -> Column:
        hit = (F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_c"))
        return F.max(F.when(hit, F.col("_v").cast("double")))

    aggs = [F.max("_n").alias("n"),
            (F.sum(F.col("_v").cast("double") * F.col("_c")) / F.max("_n")).alias("mean"),
            F.min("_v").cast("double").alias("min")]
    pieces = []
    for name, (lo, hi) in positions.items():
        aggs += [value_at(lo).alias(f"_{name}_lo"), value_at(hi).alias(f"_{name}_hi")]
        pieces.append(((F.col(f"_{name}_lo") + F.col(f"_{name}_hi")) / 2).alias(name))
    aggs.append(F.max("_v").cast("double").alias("max"))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "n", "mean", "min", pieces[0], pieces[1], pieces[2], "max")


def summary(long_df: DataFrame, group_col: str = "metric_group", ord_col: str = "ord",
            name_col: str = "name", value_col: str = "value",
            rule: str = "reference", method: str = "window") -> DataFrame:
    """Grouped summary table: one five-number row per (group, ord, name).

    ``long_df`` holds every metric in one long frame so that all rows of the
    table come out of one job (one histogram shuffle, one window, one agg).
    """
    return five_number(long_df, value_col, keys=[group_col, ord_col, name_col], rule=rule,
                       method=method)


def zero_prevalence(wide: DataFrame, feature_cols: Sequence[str],
                    feature_alias: str = "feature") -> DataFrame:
    """For each feature column: rows where it is 0, all rows, and the share in %.

    One unpivot and one aggregation instead of one scan per feature.
    """
    long = wide.select(*[F.col(c).cast("long").alias(c) for c in feature_cols]).unpivot(
        [], list(feature_cols), feature_alias, "_value")
    agg = long.groupBy(feature_alias).agg(
        F.sum(F.when(F.col("_value") == 0, 1).otherwise(0)).cast("long").alias("zero_count"),
        F.count(F.lit(1)).alias("total"))
    return agg.withColumn(
        "pct", F.round(F.lit(100.0) * F.col("zero_count") / F.col("total"), 2))


def pareto_share(df: DataFrame, value_col: str, share: float = 0.2,
                 method: str = "window") -> DataFrame:
    """How many of the smallest entities together hold at most ``share`` of the total.

    Entities are taken in ascending order of ``value_col`` (ties in any fixed
    order, which does not change the counts) while the running sum stays
    <= share * total. Computed from the per-value histogram: the running sum
    runs over distinct values only (``method="range"`` range-partitions it
    for very many distinct values), and the cut inside the last value group
    is integer arithmetic, so no global row-level sort happens.
    """
    v = F.col(value_col).cast("long")
    hist = (df.filter(F.col(value_col).isNotNull()).groupBy(v.alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")))
    hist = hist.withColumn("_s", F.col("_v") * F.col("_c"))
    ranked = running_sum(hist, [], ["_v"], "_s", out="_upto", method=method)
    # the two totals are scalar subqueries: computed once, no join
    ranked = (ranked.withColumn("_total", hist.select(F.sum("_s")).scalar())
              .withColumn("_entities", hist.select(F.sum("_c")).scalar())
              .withColumn("_before", F.col("_upto") - F.col("_s")))
    limit = F.floor(F.lit(float(share)) * F.col("_total")).cast("long")
    fit = (F.when(F.col("_before") > limit, F.lit(0))
           .when(F.col("_v") <= 0, F.col("_c"))
           .otherwise(F.least(F.col("_c"), F.floor((limit - F.col("_before")) / F.col("_v"))
                              .cast("long"))))
    out = ranked.agg(F.sum(fit).cast("long").alias("n_entities"),
                     F.max("_entities").alias("n_total"),
                     F.sum(fit * F.col("_v")).cast("long").alias("covered"),
                     F.max("_total").cast("long").alias("total"))
    return out.select(
        "n_entities", "n_total",
        F.round(F.try_divide(F.lit(100.0) * F.col("n_entities"), F.col("n_total")), 2).alias("entity_pct"),
        "covered", "total",
        F.round(F.try_divide(F.lit(100.0) * F.col("covered"), F.col("total")), 2).alias("covered_pct"))


def display_number(c: Column) -> Column:
    """The reference's display format ``0.#`` (half-even on the exact binary value)."""
    return F.call_function("format_number", c.cast("double"), F.lit("0.#"))


def latex_rows(summary_df: DataFrame, group_col: str = "metric_group",
               ord_col: str = "ord", name_col: str = "name") -> DataFrame:
    """One LaTeX table row per summary row; the group label only on its first row."""
    first = F.row_number().over(Window.partitionBy(group_col).orderBy(ord_col)) == 1
    label = F.when(first, F.col(group_col)).otherwise(F.lit(""))
    cells = [display_number(F.col(c)) for c in ("mean", "min", "q1", "median", "q3", "max")]
    line = F.concat_ws(" & ", F.concat(F.lit(" "), label), F.col(name_col),
                       *[F.coalesce(c, F.lit("")) for c in cells])
    return summary_df.select(group_col, ord_col, F.concat(line, F.lit(" \\\\ ")).alias("line"))


def share_text(n: Column, total: Column, digits: int = 2) -> Column:
    """EXP12 display: ``"n (p) of N"`` with p = 100 n / N rounded to ``digits`` decimals and
    shown without trailing zeros (e.g. ``"1988 (33.3) of 5968"``); NULL share when N is 0."""
    pct = F.round(F.try_divide(F.lit(100.0) * n, total), digits)
    return F.concat(n.cast("string"), F.lit(" ("), F.coalesce(pct.cast("string"), F.lit("")),
                    F.lit(") of "), total.cast("string"))
