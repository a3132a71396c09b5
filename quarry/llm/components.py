"""Connected components of an edge table, by alternating star contraction.

Each round re-points every node to the smallest node it touches (large stars
to bigger neighbours, then small stars to smaller ones) until each component
is one star around its smallest node: O(log^2 n) rounds, each two partially
aggregated minima and two joins. The minima are checkpointed before the
join, so both join sides are plain exchanges and AQE may split the rows of a
hot node; sort-merge joins keep the many small tables of the rounds off the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tables import kept, remove
from quarry.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node of its
    component. Self-loops, repeated edges and edges with a null end are allowed and ignored
    (a null end links nothing). No edges: no rows."""
    ensure_checkpoint_dir(edges.sparkSession)
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e, path = kept(e.select(hi, lo).distinct())
    print_of = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    while True:
        # large star: neighbours above a node point to the smallest node it touches
        sym = e.union(e.select("v", "u"))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
        large = (sym.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct().checkpoint())
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        pairs = large.join(low.hint("merge"), "u")
        old = path
        e, path = kept(pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                       .union(low.select("u", F.col("m").alias("v"))).distinct())
        remove(edges.sparkSession, old)
        now = e.agg(F.count("*"), print_of).first()
        if now == before:
            break
        before = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select("v", "v").distinct())
