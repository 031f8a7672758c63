"""Connected components by contraction, with a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexloom.llm.store import Workspace


def _links(edges: DataFrame) -> DataFrame:
    """Undirected links without loops or repeats."""
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest node reachable.

    ``edges`` holds links ``a, b`` between long ids; order, repeats and loops do not matter
    and null ends are ignored. Each round hooks every node to its smallest neighbour, follows
    the hooks to their end and contracts the links to the ends. All but the local minima
    vanish, so at most half of the linked nodes are left for the next round.
    """
    links = work.keep(_links(edges.where("a is not null and b is not null")), "links")
    labels = None
    while labels is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = work.keep(both.groupBy(F.col("a").alias("node"))
                          .agg(F.least(F.first("a"), F.min("b")).alias("root")), "hooks")
        while True:
            ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
            jumped = work.keep(hooks.join(ends, "root").select(
                "node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")),
                "jumps")
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "root")
            if not moved:
                break
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
            labels = work.keep(labels.join(step, "root", "left")
                               .select("node", F.coalesce("end", "root").alias("root")), "labels")
        ends = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        other = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = work.keep(_links(links.join(ends, "a").join(other, "b")
                                 .select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
    return labels
