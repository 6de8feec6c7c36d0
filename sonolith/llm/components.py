"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.session import discard, stash


#: A key of more than 1/HUBS of all rows is joined by broadcast - there are fewer than HUBS of them -, where all rows are
#: more than a task may hold.
HUBS, TASK_ROWS = 1000, 1 << 20


def meet(rows: DataFrame, keyed: DataFrame, on: str, total: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows joined with keyed (one row a key; n: about its rows, which is dropped) on a column. total: all rows. No task
    gets all rows of a key that many have."""
    if total <= task_rows:
        return rows.join(keyed.drop("n"), on)
    hubs = F.broadcast(keyed.where(F.col("n") * HUBS > total).drop("n"))
    return rows.join(hubs, on).unionByName(rows.join(hubs.select(on), on, "left_anti").join(keyed.drop("n"), on))


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges with u > v; loops and nulls go."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _downward(meet(both, low, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = meet(edges, low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _downward(moved.unionAll(low.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has a link; edges: columns u, v (long), in either
    direction, repeats and loops allowed.

    Every step is a few joins and partial aggregates over the links that are left, written to the shared folder; the
    driver sees two numbers a step. The number of steps grows with the logarithm of the largest component.
    """
    now = stash(_downward(edges), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        then, mid = now, _large_star(now, state[0])
        if state[0] > TASK_ROWS:  # the next step reads it more than once
            mid = stash(mid, "links")
        now = stash(_small_star(mid, state[0]), "links")
        discard(then)
        if state[0] > TASK_ROWS:
            discard(mid)
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
