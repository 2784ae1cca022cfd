"""Connected components over edge tables of any size, by repeated contraction.

A round sends each node to the least node of its neighbourhood, follows those
pointers 2**round steps, renames both ends of every edge and drops the loops.
Connectivity survives the renaming and the least node of a component never
moves, so once no edge is left every node's trail ends at that least node.
Star-shaped graphs, which near-duplicates give, vanish in one or two rounds; a
path of n nodes takes about log2(n).

No node's neighbours are gathered in one place: a round is a partially
aggregated minimum and equi-joins of written tables, which adaptive execution
may split where one node (the hub of many copies) is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Workspace


def connected_components(ws: Workspace, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the least node reachable.

    Nulls and loops are ignored; repeated and reversed edges count once.  Nodes
    without any edge to another node do not appear.
    """
    current = ws.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    trails: list[DataFrame] = []
    for round_no in range(max_rounds):
        if current.isEmpty():
            break
        up = current.groupBy("u").agg(F.min("v").alias("p"))
        alone = current.select(F.col("v").alias("u"), F.col("v").alias("p"))
        step = ws.save(up.unionByName(alone).groupBy("u").agg(F.min("p").alias("p")), "step")
        for _ in range(round_no):
            step = ws.save(step.join(step.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), "step")
        trails.append(step)
        left = step.select("u", F.col("p").alias("x"))
        right = step.select(F.col("u").alias("v"), F.col("p").alias("y"))
        moved = current.join(left, "u").join(right, "v").where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        before, current = current, ws.save(moved, "edges")
        ws.drop(before)
    else:
        raise RuntimeError("components did not settle")
    if not trails:
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = trails[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for step in trails[1:]:
        hop = step.select(F.col("u").alias("component"), F.col("p").alias("next"))
        label = label.join(hop, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return ws.save(label, "components") if len(trails) > 1 else label
