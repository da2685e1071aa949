"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import discard, stage


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, component (its least node) for the ends of edges (a, b long).

    A round gives every node the least of its neighbours and itself as parent, follows parents to their roots, and contracts: edges
    become edges between roots, once each, and those within a root go. Each round at least halves the
    nodes left, and a dense group is gone after one. Tables of a round are staged, and deleted when the next has read them; only whether any
    row is left reaches the driver. Least neighbours are found before the shuffle; the joins read staged tables, which adaptive execution
    splits at a hub.
    """
    left = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stage(left.distinct(), f"{label}-edges")
    found = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), f"{label}-parents")
        while True:
            up = roots.select(F.col("node").alias("at"), F.col("root").alias("up"))
            before, roots = roots, stage(roots.select("node", "root").join(up, F.col("root") == F.col("at")).select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), f"{label}-roots")
            discard(before)
            if not roots.where("moved").limit(1).count():
                break
        kept, roots = roots, roots.select("node", "root")
        first = found is None
        if first:
            found = roots.withColumnRenamed("root", "component")
        else:
            found = found.join(roots.withColumnRenamed("node", "at"), F.col("component") == F.col("at"), "left")
            found = stage(found.select("node", F.coalesce("root", "component").alias("component")), f"{label}-found")
        ends = left.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").select("b", "x")
        ends = ends.join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x != y")
        before, left = left, stage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{label}-edges")
        discard(before, *([] if first else [kept]))
        if not left.limit(1).count():
            return found
