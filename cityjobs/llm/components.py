"""Connected components of links by repeated hooking to the least neighbour, in joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows (node, comp) with the least node of each component, for the nodes of ``links`` (a, b).

    ``labels`` are components known so far, which the links only join further. Every round
    contracts the graph: components hook to their least neighbour, and hooks are shortened,
    so that the edges left fall fast; each round is written, so a lost executor re-reads it.
    ``links`` and ``labels`` are written tables.
    """
    n_edges = links.count()
    n_nodes = 2 * n_edges + (labels.count() if labels is not None else 0)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    fresh = nodes.join(labels, "node", "left_anti") if labels is not None else nodes
    fresh = fresh.select("node", F.col("node").alias("comp"))
    known = fresh if labels is None else labels.unionByName(fresh)
    edges = links.select("a", "b")
    up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up")) if labels is not None else None
    hooked: list[DataFrame] = []
    while True:
        if up is not None:  # an end that is in ``up`` is now what that says
            for end in ("a", "b"):
                edges = edges.join(up.select(F.col("comp").alias(end), F.col("up").alias("__up")), end, "left").withColumn(end, F.coalesce("__up", end)).drop("__up")
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = materialize(edges, "edges", n_edges)
        if edges.isEmpty():
            break
        # every component hooks to its least neighbour if that is smaller, then hooks are followed twice
        hooks = materialize(edges.groupBy(F.col("b").alias("comp")).agg(F.min("a").alias("up")), "hooks", n_edges)
        short = hooks
        for _ in range(2):
            nxt = hooks.select(F.col("comp").alias("up"), F.col("up").alias("up2"))
            short = short.join(nxt, "up", "left").select("comp", F.coalesce("up2", "up").alias("up"))
        up = short
        hooked.append(up)
    for up in hooked:
        known = known.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return materialize(known, "labels", n_nodes)
