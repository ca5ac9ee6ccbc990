"""Connected components of a large set of links, by contraction.

Every round each node takes the least of itself and its neighbours as its label, links are rewritten
to labels, and links inside a label go. Least is by id in even rounds, which contracts stars around a smallest
node at once, and by a hash in odd ones, in which the number of nodes with links falls by a
constant share whatever the shape; so rounds grow with the logarithm of the data. Minima combine on the map side, so a node with very many links is no hot group; the
joins back are split by adaptive execution. Each round is written to the scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphproof.session import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the smallest node connected with it) for every node of ``links`` (a, b)."""
    links = links.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    links = scratch.write(links, f"{name}-links")
    found, turn = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), 0
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = (lambda c: F.xxhash64(F.lit(turn), c)) if turn % 2 else (lambda c: F.lit(0).cast("long"))  # noqa: B023
        rank = lambda c: F.struct(first(c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        labels = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(
            F.col("a").alias("node"), F.least(rank("a"), F.col("near"))["id"].alias("label"),
        )
        labels = scratch.write(labels, f"{name}-labels-{turn}")
        if turn == 0:
            found = labels
        else:
            step = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            found = found.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b")]
        links = links.join(ends[0], "a").join(ends[1], "b").filter("la <> lb")
        links = links.selectExpr("least(la, lb) AS a", "greatest(la, lb) AS b").distinct()
        links = scratch.write(links, f"{name}-links-{turn}")
        turn += 1
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return scratch.write(found.join(least, "label").select("node", "component"), f"{name}-components")
