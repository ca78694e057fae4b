"""Connected components of an edge table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from every node that has an edge.

    ``edges`` holds two integer node columns (either order, repeats, self-loops
    and nulls allowed; rows with a null end are no edge). Returns ``node,
    component``, one row per node that has an edge to another node; an empty
    edge table gives an empty result.

    Each round hooks every node on its smallest neighbour, follows those hooks
    to their roots by pointer jumping, and replaces the edges by edges between
    roots. A round leaves at most half of the nodes that still have edges, so
    rounds grow with the logarithm of the table. Every step is a join or a
    partially aggregated minimum, and is written to the shared checkpoint
    folder, so lost executors re-read files.
    """
    spark = edges.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    left = materialize(
        edges.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "cc-edges")
    found = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hooks = materialize(both.groupBy("node").agg(F.min("to").alias("to"))
                            .select("node", F.least("node", "to").alias("root")), "cc-hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            hooks = materialize(hooks.join(up, "root").select("node", F.col("up").alias("root"),
                                                              (F.col("up") != F.col("root")).alias("moved")), "cc-jump")
            if hooks.filter("moved").isEmpty():
                hooks = hooks.select("node", "root")
                break
            hooks = hooks.select("node", "root")
        if found is None:
            found = hooks
        else:
            over = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            found = materialize(found.join(over, "root", "left").select("node", F.coalesce("up", "root").alias("root")),
                                "cc-found")
        ra = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialize(left.join(ra, "a").join(rb, "b").filter(F.col("ra") != F.col("rb"))
                           .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(),
                           "cc-edges")
    if found is None:
        return spark.createDataFrame([], "node long, component long")
    return found.select("node", F.col("root").alias("component"))
