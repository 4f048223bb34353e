"""Connected components over an edge table by contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.sources.scratch import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected ``edges(a, b)`` as ``(node, component)``, the smallest reachable node.

    Every round each node joins the first of its neighbours and itself, and then what that one joined; ends of
    edges are replaced by it, and loops and repeated edges are dropped: settled groups leave, so that what a
    round joins shrinks. The first is the least, which settles stars and dense groups at once, but in every
    third round the first in a new hash order, under which a chain of any numbering shrinks by a constant
    factor on average. Tables of a round are written to the shared folder. Null ends and loops are ignored; nodes without an edge do
    not appear.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(edges.filter("a is not null and b is not null and a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(rounds)

        def place(name: str, turn: int = turn) -> Column:
            node = F.col(name)
            return F.struct(F.xxhash64(F.lit(turn), node).alias("order"), node.alias("node")) if turn % 3 == 2 else node

        ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
        both = edges.select(F.explode(ways).alias("way")).select("way.*")
        first = both.groupBy("node").agg(F.min(place("near")).alias("first"))
        # A table: rows that join one hub are then a skewed partition that Spark can split.
        via = F.least("first", place("node"))
        step = materialize(first.select("node", (via["node"] if turn % 3 == 2 else via).alias("via")), "step")
        jump = step.select(F.col("node").alias("via"), F.col("via").alias("to"))
        joined = materialize(step.join(jump, "via").select("node", "to"), "joined")
        rounds.append(joined)
        left = joined.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = joined.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        ends = edges.join(left, "a").join(right, "b")
        ends = ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        rest = materialize(ends.filter("a <> b").distinct(), "edges")
        discard(edges, step)
        edges = rest
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # What a node joined may have joined another node in a later round.
    roots = rounds[-1].select("node", F.col("to").alias("root"))
    for joined in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = joined.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    roots = materialize(roots, "roots")
    least = materialize(roots.groupBy("root").agg(F.min("node").alias("component")), "least")
    components = materialize(roots.join(least, "root").select("node", "component"), "components")
    discard(edges, roots, least, *rounds)
    return components
