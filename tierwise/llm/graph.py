"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links that a task takes, and the least number of tasks: rounds are many and links few, so that tasks in
#: the number of the session's shuffle partitions would take longer to start than to run.
TASK_LINKS, LEAST_TASKS = 20_000, 8


def _smallest(pairs: DataFrame, tasks: int) -> DataFrame:
    """(u, m): the smallest of each node and its partners. Stored, so that the
    join that follows shuffles both sides and a node with very many partners
    can be split there."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return stored(least.coalesce(tasks), "least")


def _star(edges: DataFrame, larger: bool, tasks: int) -> DataFrame:
    """One contraction. Large stars hang a node's larger partners on its
    smallest one; small stars hang the node and its smaller partners there."""
    if larger:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(pairs, tasks)
    joined = pairs.join(least, "u")
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return stored(out.where(F.col("u") != F.col("v")).distinct().coalesce(tasks), "star")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link in ``edges`` (u, v);
    ``component`` is the smallest node that can be reached. Each round is
    stored; their number grows with the logarithm of the largest component."""
    now = edges.where(F.col("u") != F.col("v")).select("u", "v")
    tasks = max(LEAST_TASKS, -(-edges.count() // TASK_LINKS))
    while True:
        now = _star(_star(now, True, tasks), False, tasks)
        # done once every node hangs on one other, which hangs on none
        ends = now.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("held"))
        ends = ends.unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("hangs"), F.lit(1).alias("held")))
        ends = ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("held").alias("held"))
        if not ends.where("hangs > 1 OR hangs > 0 AND held > 0").coalesce(tasks).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
