"""Connected components of a link table, by alternating large-star and small-star rounds of joins.

Defined results: links of a node to itself and null ends are left out; repeated links count once; an empty table gives
an empty one; only the first two columns are read, whatever their names.  A hub that many nodes link to is joined by
broadcast (see common.join_hot), so none of its links goes to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def _star(edges: DataFrame, small: bool, n_edges: int) -> DataFrame:
    """Link neighbours to the least of them.  edges: (u, v) with u > v, written."""
    back = edges if small else edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = back.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    linked = join_hot(back, least, ["u"], "n", 2 * n_edges)
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(linked.select("u", F.col("m").alias("v")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node that can be reached; only nodes with a link appear.

    Rounds go on until one changes nothing; their number grows with the logarithm of the links' longest path.  Each round is
    written to the shared folder, so that a lost executor costs one round."""
    u, v = links.columns[:2]
    edges = materialize(links.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while True:
        edges = materialize(_star(materialize(_star(edges, False, before[0])), True, before[0]))
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
