"""Connected components of an edge table by alternating star contraction.

Large-star links every node's larger neighbours to its smallest one, small-star links the
smaller neighbours; a few alternations turn every component into a star around its
smallest node.  Both steps are a minimum per node (combined before the shuffle) and a
join; each round is kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def component_of(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node.

    Loops and rows with a null end are ignored; repeated edges count once; without edges
    there are no rows.
    """
    links = edges.select(edges[a].alias("a"), edges[b].alias("b")).where("a <> b").distinct()
    links = saved(links)
    while True:
        # finished when every node points at one node, which points nowhere
        inner = links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        twice = links.groupBy("a").count().where("count > 1")
        down = links.where("b > a")
        if inner.isEmpty() and twice.isEmpty() and down.isEmpty():
            break
        links = saved(_small_star(_large_star(links)))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
