"""Relational and statistics queries on the TPC-H-like tables.

Fixture mapping (the reference's corpus is not shipped): project = customer,
file = order, violation = lineitem, rule dimension = event type / part type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import relational as rel
from quarry.operators import rules as rl
from quarry.operators import stats
from quarry.operators.dimension import StoredDimension
from quarry.plans.registry import register
from quarry.plans.sqlfmt import duck_display_number
from quarry.sources.tables import table

# Fixed values of the fixture tables used as feature columns.
ORDER_STATUSES = ["F", "O", "P"]
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SIZE_BUCKETS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 16, 24, 32, 40, 48]


def lines_per_order(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


def order_line_counts(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Every order with its number of lines (0 when it has none)."""
    per = lines_per_order(lineitem)
    return (orders.select("o_orderkey")
            .join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select("o_orderkey", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines")))


# --------------------------------------------------------------------------- AG1 / AG3
@register("q_histogram", """
SELECT n_lines, CAST(COUNT(*) AS BIGINT) AS order_count
FROM (SELECT o.o_orderkey, COUNT(l.l_orderkey) AS n_lines
      FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
      GROUP BY o.o_orderkey) t
GROUP BY n_lines ORDER BY n_lines
""")
def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by number of lineitems (AG1): per-entity count, then value histogram."""
    per_order = order_line_counts(table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    return stats.histogram(per_order, "n_lines", "order_count")


# --------------------------------------------------------------------------- AG2 / EXP10
@register("q_inlist_hist", f"""
SELECT p_size, CAST(COUNT(*) AS BIGINT) AS part_count FROM part
WHERE p_retailprice > 0 AND p_size IN ({", ".join(map(str, SIZE_BUCKETS))})
GROUP BY p_size ORDER BY p_size
""")
def q_inlist_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram restricted to an explicit bucket list; empty buckets are not zero-filled."""
    part = table(spark, sf, "part").filter(F.col("p_retailprice") > 0)
    return stats.histogram(part, "p_size", "part_count", buckets=SIZE_BUCKETS)


# --------------------------------------------------------------------------- EXP11 / JN1
@register("q_scalar_subquery", """
SELECT n.n_name, CAST(COUNT(*) AS BIGINT) AS n_customers
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE n.n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')
GROUP BY n.n_name
""")
def q_scalar_subquery(spark: SparkSession, sf: str) -> DataFrame:
    """Customers per nation of the region named by a scalar subquery.

    Customers are pre-aggregated per nation key before the join, so the join
    sees one row per nation instead of one per customer.
    """
    region = table(spark, sf, "region")
    asia = region.filter(F.col("r_name") == "ASIA").select("r_regionkey").scalar()
    nation = table(spark, sf, "nation").filter(F.col("n_regionkey") == asia)
    per_nation = (table(spark, sf, "customer").groupBy("c_nationkey")
                  .agg(F.count(F.lit(1)).alias("n_customers")))
    return (per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.sum("n_customers").cast("long").alias("n_customers")))


# --------------------------------------------------------------------------- JN3 / AG5
@register("q_distinct_3way", """
SELECT c.c_mktsegment, CAST(COUNT(DISTINCT c.c_custkey) AS BIGINT) AS n_customers
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
WHERE l.l_returnflag = 'R'
GROUP BY c.c_mktsegment
""")
def q_distinct_3way(spark: SparkSession, sf: str) -> DataFrame:
    """COUNT DISTINCT over a 3-way join, as semi-join + distinct before the last join."""
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    custs = rel.distinct_through(li, "l_orderkey", table(spark, sf, "orders"), "o_orderkey",
                                 "o_custkey")
    cust = table(spark, sf, "customer")
    return (cust.join(custs, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
            .groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers")))


def _round_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "n", *[F.round(c, 6).alias(c) for c in
                                   ("mean", "min", "q1", "median", "q3", "max")])


def _duck_five_number(src: str, keys: list[str]) -> str:
    """DuckDB text of the reference rank rule over ``src(keys..., value)``."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    sel = f"{k}, " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    return f"""
r AS (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY value) - 1 AS rk,
             COUNT(*) OVER ({part}) AS n FROM {src}),
p AS (SELECT *,
        CASE WHEN n % 4 = 0 THEN n // 4 - 1 ELSE n // 4 END AS q1_lo, n // 4 AS q1_hi,
        CASE WHEN n % 2 = 0 THEN n // 2 - 1 ELSE n // 2 END AS md_lo, n // 2 AS md_hi,
        CASE WHEN n % 2 = 1 THEN n // 4 + (n + 1) // 2 WHEN n % 4 = 0 THEN n // 4 + n // 2 - 1
             ELSE n // 4 + n // 2 END AS q3_lo,
        CASE WHEN n % 2 = 1 THEN n // 4 + (n + 1) // 2 ELSE n // 4 + n // 2 END AS q3_hi
      FROM r),
s AS (SELECT {sel}CAST(max(n) AS BIGINT) AS n, avg(value) AS mean, min(value) AS min,
        (max(CASE WHEN rk = q1_lo THEN value END) + max(CASE WHEN rk = q1_hi THEN value END)) / 2 AS q1,
        (max(CASE WHEN rk = md_lo THEN value END) + max(CASE WHEN rk = md_hi THEN value END)) / 2 AS median,
        (max(CASE WHEN rk = q3_lo THEN value END) + max(CASE WHEN rk = q3_hi THEN value END)) / 2 AS q3,
        max(value) AS max
      FROM p {grp})"""


def _duck_round(keys: list[str]) -> str:
    ks = "".join(f"{k}, " for k in keys)
    return (f"SELECT {ks}n, round(mean, 6) AS mean, round(min, 6) AS min, round(q1, 6) AS q1, "
            f"round(median, 6) AS median, round(q3, 6) AS q3, round(max, 6) AS max FROM s")


# --------------------------------------------------------------------------- JN4
FILTERED_SRC = """
po AS (SELECT l_orderkey, COUNT(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
cs AS (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey),
v AS (SELECT 'Lines per order of frequent customers' AS name, CAST(po.n_lines AS DOUBLE) AS value
      FROM po JOIN orders o ON po.l_orderkey = o.o_orderkey
      JOIN cs ON o.o_custkey = cs.o_custkey
      WHERE cs.n_orders >= 10 AND po.n_lines > 0)"""


@register("q_filtered_join_stats",
          "WITH " + FILTERED_SRC + "," + _duck_five_number("v", ["name"]) + "\n"
          + _duck_round(["name"]))
def q_filtered_join_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per-file values joined to per-project stats, filtered on both sides, summarised."""
    orders = table(spark, sf, "orders")
    per_order = (lines_per_order(table(spark, sf, "lineitem"))
                 .join(orders.select("o_orderkey", "o_custkey"),
                       F.col("l_orderkey") == F.col("o_orderkey")))
    cust_stats = orders.groupBy(F.col("o_custkey").alias("c_key")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    joined = (per_order.join(cust_stats, F.col("o_custkey") == F.col("c_key"))
              .filter((F.col("n_orders") >= 10) & (F.col("n_lines") > 0))
              .select(F.lit("Lines per order of frequent customers").alias("name"),
                      F.col("n_lines").cast("double").alias("value")))
    return _round_stats(stats.five_number(joined, "value", keys=["name"]), ["name"])


# --------------------------------------------------------------------------- AG8-AG10
SUMMARY_SRC = r"""
v AS (
  SELECT 'Size' AS metric_group, 1 AS ord, 'Lines per order' AS name, CAST(COUNT(*) AS DOUBLE) AS value
    FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'Size', 2, 'Quantity per order', CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE)
    FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'Size', 3, 'Orders per customer', CAST(COUNT(*) AS DOUBLE) FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'Size', 4, 'Document size (KB)', CAST(n_chars // 1024 AS DOUBLE) FROM documents
  UNION ALL SELECT 'Size', 5, 'Lines per document',
    CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) FROM documents
  UNION ALL SELECT 'Value', 1, 'Customer balance', c_acctbal FROM customer
  UNION ALL SELECT 'Value', 2, 'Part size', CAST(p_size AS DOUBLE) FROM part
  UNION ALL SELECT 'Value', 3, 'Supplier balance', s_acctbal FROM supplier)"""


def summary_long(spark: SparkSession, sf: str) -> DataFrame:
    """All summary metrics as one long (metric_group, ord, name, value) frame.

    Tables feeding several metrics are scanned once: each row emits one
    (metric, value) row per metric through ``inline``.
    """
    li = table(spark, sf, "lineitem")
    docs = table(spark, sf, "documents")

    def metric(group: str, ord_: int, name: str, value) -> Column:
        return F.struct(F.lit(group).alias("metric_group"), F.lit(ord_).alias("ord"),
                        F.lit(name).alias("name"), value.cast("double").alias("value"))

    def rows(df: DataFrame, *metrics: Column) -> DataFrame:
        return df.select(F.inline(F.array(*metrics)))

    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").cast("long").alias("qty"))
    per_cust = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"))
    parts = [
        rows(per_order, metric("Size", 1, "Lines per order", F.col("n_lines")),
             metric("Size", 2, "Quantity per order", F.col("qty"))),
        rows(per_cust, metric("Size", 3, "Orders per customer", F.col("n_orders"))),
        rows(docs, metric("Size", 4, "Document size (KB)", F.expr("n_chars div 1024")),
             metric("Size", 5, "Lines per document", T.line_count("text"))),
        rows(table(spark, sf, "customer"), metric("Value", 1, "Customer balance", F.col("c_acctbal"))),
        rows(table(spark, sf, "part"), metric("Value", 2, "Part size", F.col("p_size"))),
        rows(table(spark, sf, "supplier"), metric("Value", 3, "Supplier balance", F.col("s_acctbal"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SUMMARY_KEYS = ["metric_group", "ord", "name"]


@register("q_summary", "WITH " + SUMMARY_SRC + "," + _duck_five_number("v", SUMMARY_KEYS)
          + "\n" + _duck_round(SUMMARY_KEYS))
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The grouped five-number table (AG8-AG10), every row from one job.

    The balances are doubles with many distinct values, so the running count
    is range-partitioned (``method="range"``) rather than one window per metric.
    """
    return _round_stats(stats.summary(summary_long(spark, sf), method="range"), SUMMARY_KEYS)


def _latex_sql() -> str:
    cells = " || ' & ' || ".join(duck_display_number(c)
                                 for c in ("mean", "min", "q1", "median", "q3", "max"))
    return ("WITH " + SUMMARY_SRC + "," + _duck_five_number("v", SUMMARY_KEYS) + f"""
SELECT metric_group, ord,
  ' ' || CASE WHEN ROW_NUMBER() OVER (PARTITION BY metric_group ORDER BY ord) = 1
              THEN metric_group ELSE '' END
  || ' & ' || name || ' & ' || {cells} || ' \\\\ ' AS line
FROM s""")


@register("q_latex_rows", _latex_sql())
def q_latex_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Summary rows rendered as LaTeX table lines (SNK6, WN3, EXP8)."""
    return stats.latex_rows(stats.summary(summary_long(spark, sf), method="range"))


# --------------------------------------------------------------------------- AG4 / AG7 / EXP12
def _feature(prefix: str, v: str) -> str:
    return prefix + v.split("-")[0] if prefix == "prio_" else prefix + v


PREVALENCE_FEATURES = ([_feature("status_", s) for s in ORDER_STATUSES]
                       + [_feature("prio_", p) for p in ORDER_PRIORITIES])


def customer_order_profile(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Per customer: number of orders in each status and priority (0 if none)."""
    aggs = ([F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)).alias(_feature("status_", s))
             for s in ORDER_STATUSES]
            + [F.sum(F.when(F.col("o_orderpriority") == p, 1).otherwise(0)).alias(_feature("prio_", p))
               for p in ORDER_PRIORITIES])
    per = orders.groupBy("o_custkey").agg(*aggs)
    joined = customer.select("c_custkey").join(
        per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", *[F.coalesce(F.col(f), F.lit(0)).cast("long").alias(f)
                                        for f in PREVALENCE_FEATURES])


def _prevalence_sql() -> str:
    cols = ",\n".join(
        [f"COALESCE(SUM(CASE WHEN o.o_orderstatus = '{s}' THEN 1 ELSE 0 END), 0) AS {_feature('status_', s)}"
         for s in ORDER_STATUSES]
        + [f"COALESCE(SUM(CASE WHEN o.o_orderpriority = '{p}' THEN 1 ELSE 0 END), 0) AS {_feature('prio_', p)}"
           for p in ORDER_PRIORITIES])
    unions = "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(SUM(CASE WHEN {f} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_count, "
        f"CAST(COUNT(*) AS BIGINT) AS total FROM w" for f in PREVALENCE_FEATURES)
    return f"""
WITH w AS (SELECT c.c_custkey, {cols}
           FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey),
z AS ({unions})
SELECT feature, zero_count, total, round(100.0 * zero_count / total, 2) AS pct FROM z"""


@register("q_prevalence", _prevalence_sql())
def q_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with a zero count per feature, with % of all (AG7: one unpivot, one agg)."""
    prof = customer_order_profile(table(spark, sf, "customer"), table(spark, sf, "orders"))
    return stats.zero_prevalence(prof, PREVALENCE_FEATURES)


# --------------------------------------------------------------------------- MET23 / AG13 / JN2
ORDER_RULES = [
    ("ManyLines", "n_lines", ">=", 7.0),
    ("BigQuantity", "sum_qty", ">", 250.0),
    ("Expensive", "total_price", ">=", 400000.0),
    ("ManyReturns", "n_returned", ">=", 4.0),
    ("SingleLine", "n_lines", "<=", 1.0),
    ("ExactlyFive", "n_lines", "=", 5.0),
]


def order_metrics_long(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(o_orderkey, o_custkey, metric, value) for every order with lines."""
    per = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_quantity").cast("double").alias("sum_qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("n_returned"))
    wide = per.join(orders.select("o_orderkey", "o_custkey",
                                  F.col("o_totalprice").cast("double").alias("total_price")),
                    F.col("l_orderkey") == F.col("o_orderkey"))
    return wide.unpivot(["o_orderkey", "o_custkey"], ["n_lines", "sum_qty", "n_returned", "total_price"],
                        "metric", "value")


def _rules_sql() -> str:
    values = ", ".join(f"('{r}', '{m}', '{o}', {t})" for r, m, o, t in ORDER_RULES)
    return f"""
WITH per AS (SELECT l_orderkey, CAST(COUNT(*) AS DOUBLE) AS n_lines, CAST(SUM(l_quantity) AS DOUBLE) AS sum_qty,
                    CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS n_returned
             FROM lineitem GROUP BY l_orderkey),
wide AS (SELECT o.o_orderkey, o.o_custkey, per.n_lines, per.sum_qty, per.n_returned,
                CAST(o.o_totalprice AS DOUBLE) AS total_price
         FROM per JOIN orders o ON per.l_orderkey = o.o_orderkey),
lng AS (UNPIVOT wide ON n_lines, sum_qty, n_returned, total_price INTO NAME metric VALUE value),
rules(rule, metric, op, threshold) AS (VALUES {values}),
viol AS (SELECT lng.o_custkey, rules.rule FROM lng JOIN rules ON lng.metric = rules.metric
         WHERE CASE rules.op WHEN '>=' THEN lng.value >= rules.threshold WHEN '>' THEN lng.value > rules.threshold
                             WHEN '<=' THEN lng.value <= rules.threshold WHEN '<' THEN lng.value < rules.threshold
                             WHEN '=' THEN lng.value = rules.threshold ELSE false END)
SELECT rule, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS n_customers FROM viol GROUP BY rule
UNION ALL SELECT '*any*', CAST(COUNT(DISTINCT o_custkey) AS BIGINT) FROM viol"""


@register("q_threshold_rules", _rules_sql())
def q_threshold_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Projects per threshold rule, plus 'any' (rule table as data, one rollup)."""
    long = order_metrics_long(table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    viol = rl.apply_rules(long, rl.rules_frame(spark, ORDER_RULES))
    return rl.rule_prevalence(viol, "o_custkey", alias="n_customers")


# --------------------------------------------------------------------------- AG14
@register("q_pareto", """
WITH per AS (SELECT o.o_custkey, COUNT(*) AS n_lines FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
             GROUP BY o.o_custkey),
r AS (SELECT n_lines, SUM(n_lines) OVER (ORDER BY n_lines, o_custkey ROWS UNBOUNDED PRECEDING) AS run,
             SUM(n_lines) OVER () AS total, COUNT(*) OVER () AS n_total FROM per),
c AS (SELECT CAST(COUNT(*) FILTER (WHERE run <= floor(0.2 * total)) AS BIGINT) AS n_entities,
             CAST(max(n_total) AS BIGINT) AS n_total,
             CAST(COALESCE(SUM(n_lines) FILTER (WHERE run <= floor(0.2 * total)), 0) AS BIGINT) AS covered,
             CAST(max(total) AS BIGINT) AS total FROM r)
SELECT n_entities, n_total, round(100.0 * n_entities / n_total, 2) AS entity_pct,
       covered, total, round(100.0 * covered / total, 2) AS covered_pct FROM c
""")
def q_pareto(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest customers (by lines) that together hold <= 20 % of all lines (AG14)."""
    orders = table(spark, sf, "orders")
    per = (lines_per_order(table(spark, sf, "lineitem"))
           .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
           .groupBy("o_custkey").agg(F.sum("n_lines").alias("n_lines")))
    return stats.pareto_share(per, "n_lines", 0.2)


# --------------------------------------------------------------------------- JN8 / SET2
@register("q_anti_join", """
SELECT o.o_orderkey, o.o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
""")
def q_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with no lineitem (left anti join)."""
    return rel.missing_from(table(spark, sf, "orders"), table(spark, sf, "lineitem"),
                            "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


# --------------------------------------------------------------------------- SNK9 / WN1 / JN7
DIM_SQL = """
dim AS (SELECT event_type, min(event_id) AS first_event_id FROM events GROUP BY event_type),
ids AS (SELECT event_type, first_event_id,
               CAST(ROW_NUMBER() OVER (ORDER BY first_event_id, event_type) AS BIGINT) AS type_id FROM dim)"""


@register("q_dedupe_dim", "WITH " + DIM_SQL + "\nSELECT * FROM ids")
def q_dedupe_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Dimension of distinct event types with dense ids in first-seen order."""
    return rel.first_seen_ids(table(spark, sf, "events"), "event_type", "event_id", "type_id")


@register("q_lookup_fk", "WITH " + DIM_SQL + """
SELECT e.event_id, e.event_type, ids.type_id FROM events e LEFT JOIN ids ON e.event_type = ids.event_type""")
def q_lookup_fk(spark: SparkSession, sf: str) -> DataFrame:
    """Fact rows with the surrogate id of their dimension key (NULL when unknown)."""
    events = table(spark, sf, "events")
    dim = rel.first_seen_ids(events, "event_type", "event_id", "type_id")
    return rel.lookup_ids(events.select("event_id", "event_type"), dim, "event_type", "type_id")


# --------------------------------------------------------------------------- loads into a stored dimension
VISITS_SQL = """
visits AS (SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS visit_day, event_id < half AS early
           FROM events, (SELECT max(event_id) // 2 AS half FROM events) h),
one AS (SELECT user_id, visit_day, min(event_id) AS event_id FROM visits WHERE early GROUP BY user_id, visit_day),
two AS (SELECT user_id, visit_day, min(event_id) AS event_id FROM visits v WHERE NOT early AND NOT EXISTS (
          SELECT 1 FROM one WHERE one.user_id = v.user_id AND one.visit_day = v.visit_day) GROUP BY user_id, visit_day),
dimension AS (
  SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY event_id, user_id, visit_day) AS BIGINT) AS visit_id FROM one
  UNION ALL SELECT *, CAST((SELECT COUNT(*) FROM one) + ROW_NUMBER() OVER (ORDER BY event_id, user_id, visit_day) AS BIGINT)
  FROM two)"""


def _visits(spark: SparkSession, sf: str) -> tuple[DataFrame, StoredDimension]:
    """The events as visits (user and day), and the dimension of visits after two loads, one per half of the events."""
    events = table(spark, sf, "events")
    visits = events.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("visit_day"))
    half = events.select(F.floor(F.max("event_id") / 2)).scalar()
    dim = StoredDimension(spark, ["user_id", "visit_day"], "event_id", "visit_id")
    dim.load(visits.filter(F.col("event_id") < half))
    dim.load(visits.filter(F.col("event_id") >= half))
    return visits, dim


@register("q_stored_dimension", "WITH " + VISITS_SQL + "\nSELECT user_id, visit_day, event_id, visit_id FROM dimension")
def q_stored_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """A stored dimension after two loads by INSERT IGNORE: the ids of the first load stay (SNK9, WN1)."""
    _, dim = _visits(spark, sf)
    return dim.taken(dim.rows())


@register("q_stored_lookup", "WITH " + VISITS_SQL + """
SELECT v.event_id, d.visit_id FROM visits v LEFT JOIN dimension d ON d.user_id = v.user_id AND d.visit_day = v.visit_day""")
def q_stored_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Fact rows with their id in the stored dimension; only the facts are shuffled (JN7)."""
    visits, dim = _visits(spark, sf)
    return dim.taken(dim.lookup(visits).select("event_id", "visit_id"))
