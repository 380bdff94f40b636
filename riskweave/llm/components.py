"""Connected components of links, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``); equal roots are connected.

    Each round maps every node to the smallest node among itself and its neighbours and joins the
    links anew between those. A node that is not the smallest of its neighbourhood disappears, so
    the links shrink until none is left. Minima are combined before the shuffle; the two joins of a
    round are plain equi-joins, whose hot keys adaptive execution splits. The tables of a round are
    written to the shared folder: nothing is collected, and a lost executor repeats one round.
    Self-links give a node of its own. No links: no rows.
    """
    rounds: list[DataFrame] = []
    edges = links.select("a", "b").distinct()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")),
            "component-parents",
        )
        rounds.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(
            edges.join(left, "a")
            .join(right, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "component-links",
        )
        if edges.isEmpty():
            break
    labels = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        labels = labels.join(step, "root", "left").select(
            "node", F.coalesce("_next", "root").alias("root")
        )
    return labels
