"""Connected components by random contraction, in a logarithmic number of rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.storage import discard, follow, join_checked, join_groups, materialize, rows_of


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node of ``edges``; a component's id is its smallest node.

    First each task replaces the edges it reads by stars that join the same nodes.  Then every round
    ranks the nodes, first as they are, later anew by a hash; each node points to its neighbour of least
    rank if that is below its own, pointers jump twice, and the graph is contracted along
    them.  A node with a neighbour is a least one with a chance of at most a half, so a round
    leaves half of the nodes at most on average, whatever the graph's shape: chains, stars
    and cliques alike end after about log2 n rounds, and all rounds together are as large as a few times
    the first.  The pointers of the rounds are then followed from the last to the first.
    Rounds are cut by tables in the shared folder.  Edges with a null end are ignored; an
    empty input gives an empty result; loops and repeated edges change nothing.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    first = materialize(ends.distinct())
    left, steps = materialize(_stars(first)), []
    while rows_of(left):
        step = materialize(_pointers(left, len(steps)))
        ends = follow(follow(left, "u", step), "v", step).filter("u <> v")
        new = materialize(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        steps.append(step)
        discard(left)
        left = new
    discard(left)
    # each step leads to nodes that a later one may move; a node that others point to may move twice, to one root
    roots = None
    for step in reversed(steps):
        moved = step if roots is None else materialize(follow(step, "to", roots).unionByName(roots).distinct())
        if roots is not None:
            discard(step)
            discard(roots)
        roots = moved
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if roots is None:
        return nodes.withColumn("component", F.col("node"))
    named = materialize(join_checked(nodes, roots, "node", "left").select("node", F.coalesce("to", "node").alias("root")))
    least = materialize(named.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size")))
    out = materialize(join_groups(named, least, "root", "size", rows_of(named)).select("node", "component"))
    for used in (first, roots, named, least):
        discard(used)
    return out


def _stars(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Edges that join the same nodes, ``most`` edges at a time: each node but the smallest of a group with that one."""

    def run(batches):
        parent: dict = {}
        seen, schema = 0, None

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def found():
            nodes = [x for x in parent if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], schema[0].type), pa.array(nodes, schema[0].type)], names=["u", "v"])

        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= most:
                yield found()
                parent, seen = {}, 0
        if schema is not None:
            yield found()

    return edges.filter("u <> v").mapInArrow(run, edges.schema)


def _pointers(edges: DataFrame, turn: int) -> DataFrame:
    """``node, to`` of each node that a neighbour outranks this turn, after two jumps."""

    def rank(c: str) -> Column:
        return F.struct((F.xxhash64(F.col(c), F.lit(turn)) if turn else F.lit(0)).alias("h"), F.col(c).alias("n"))

    ranked = edges.select(F.least(rank("u"), rank("v")).alias("low"), F.greatest(rank("u"), rank("v"))["n"].alias("node"))
    near = materialize(ranked.groupBy("node").agg(F.min("low")["n"].alias("to")))
    return follow(follow(near, "to", near), "to", near)
