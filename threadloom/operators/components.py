"""Strong components by contraction: chains spliced, cycles merged, and colours for what is left.

A graph is edges(a, b) of nodes of any type that can be compared. Each step writes its new graph and what it did to nodes:
merges (node, into) are sure to share a component; a splice (node, before, after) shares one exactly if both its ends share it.
Labels are read back from these tables in reverse order.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: With more edges a node ways are short, so colours spread in few rounds and cycles of picked edges are rare.
DENSE = 4


def checkpointed(df: DataFrame) -> DataFrame:
    return written(df, "round")


def strong_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component (its least member) for the nodes of edges(a, b) that lie on a cycle.

    A turn drops nodes without way in or out, splices chains (any length, by doubling), and merges the cycles among one
    hashed edge of each node (by doubling, too). Where that takes less than a quarter of the edges, colours finish whole
    components. So chains and rings need rounds in the order of the logarithm of their number and length; what stays linear is
    the depth of a layered graph in which no node has one way in and one out. Work is linear in the edges for each
    round; the closure is never formed. Every turn finishes a node at least; a bound on the turns that is reached raises.
    Null ends, loops and repeated edges count for nothing.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    done: list[tuple[str, DataFrame]] = []
    size = edges.count()
    for turn in count():
        if not size:
            return _labelled(edges, done)
        if turn == rounds:
            raise RuntimeError(f"cycles are left after {rounds} rounds")
        before = size
        edges = checkpointed(_both_ways(edges))
        edges = _spliced(edges, done)
        edges = _contracted(edges, turn, done)
        size = edges.count()
        if 4 * size > 3 * before:
            edges = _coloured(edges, turn, done)
            size = edges.count()


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges whose begin has a way in and whose end has a way out."""
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_anti").join(nodes.select(F.col("node").alias("b")), "b", "left_anti")


def _spliced(edges: DataFrame, done: list) -> DataFrame:
    """Nodes with one way in and one out go; an edge leads past each chain of them. Rings of such nodes alone are merged."""
    ways_in = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n_in"), F.min("a").alias("before"))
    ways_out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_out"), F.min("b").alias("after"))
    chain = checkpointed(ways_in.join(ways_out, "node").where("n_in = 1 AND n_out = 1").select("node", "before", "after", F.col("node").alias("least")))
    n = chain.count()
    if not n:
        return edges
    jump = chain
    for _ in range(n.bit_length()):  # twice as far each time: beyond n nodes at the end
        ahead = jump.select(F.col("node").alias("after"), F.col("after").alias("after2"), F.col("least").alias("least2"))
        behind = jump.select(F.col("node").alias("before"), F.col("before").alias("before2"))
        step = jump.join(ahead, "after", "left").join(behind, "before", "left")
        jump = checkpointed(step.select("node", F.coalesce("before2", "before").alias("before"), F.coalesce("after2", "after").alias("after"), F.least("least", "least2").alias("least"), F.col("after2").isNotNull().alias("moved")))
        if not jump.where("moved").take(1):
            break
    inside = chain.select(F.col("node").alias("after"))
    ring = jump.join(inside, "after", "left_semi").select("node", F.col("least").alias("into"))
    open_ = checkpointed(jump.join(inside, "after", "left_anti").select("node", "before", "after"))
    loop = open_.where("before = after").select("node", F.col("before").alias("into"))
    past = open_.where("before <> after")
    done.append(("splice", past))
    done.append(("merge", checkpointed(ring.unionByName(loop).unionByName(loop.select(F.col("into").alias("node"), "into").distinct()))))
    return checkpointed(_without(edges, chain).unionByName(past.select(F.col("before").alias("a"), F.col("after").alias("b"))).distinct())


def _contracted(edges: DataFrame, turn: int, done: list) -> DataFrame:
    """Every node follows one edge, drawn by hash, those that lead both ways first; the cycles these make become a node each."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
    pick = F.min(F.struct(F.col("back").isNull().alias("one_way"), F.xxhash64("a", "b", F.lit(turn)).alias("h"), F.col("b")))
    step = checkpointed(edges.join(back, ["a", "b"], "left").groupBy(F.col("a").alias("node")).agg(pick.alias("p"), F.count("*").alias("n_out")).select("node", F.col("p.b").alias("after"), F.col("node").alias("least"), "n_out"))
    n, m = step.agg(F.count("*"), F.coalesce(F.sum("n_out"), F.lit(0))).first()
    if m > DENSE * n:
        return edges
    for _ in range(n.bit_length()):
        ahead = step.select(F.col("node").alias("after"), F.col("after").alias("after2"), F.col("least").alias("least2"))
        # ways that end leave the table
        step = checkpointed(step.join(ahead, "after").select("node", F.col("after2").alias("after"), F.least("least", "least2").alias("least")))
        if not step.take(1):
            return edges
    # so far ahead, all have come to a cycle, and each of its nodes is come to; there the least is that of the cycle
    merges = checkpointed(step.join(step.select(F.col("after").alias("node")).distinct(), "node", "left_semi").select("node", F.col("least").alias("into")))
    if not merges.take(1):
        return edges
    done.append(("merge", merges))
    ends = edges.join(merges.select(F.col("node").alias("a"), F.col("into").alias("a2")), "a", "left").join(merges.select(F.col("node").alias("b"), F.col("into").alias("b2")), "b", "left")
    return checkpointed(ends.select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b").distinct())


def _coloured(edges: DataFrame, turn: int, done: list) -> DataFrame:
    """Every node takes the least colour that reaches it, of colours drawn by hash. Back from the node whose own it is, within
    its colour, lies a whole component of each colour: these go, and with them edges between colours."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    label = checkpointed(nodes.select("node", F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("root")).alias("colour")))
    while True:
        reach = edges.join(label.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "colour")
        after = checkpointed(label.unionByName(reach).groupBy("node").agg(F.min("colour").alias("colour")))
        changed = after.join(label, ["node", "colour"], "left_anti").take(1)
        label = after
        if not changed:
            break
    of = label.select("node", F.col("colour.root").alias("into"))
    within = checkpointed(edges.join(of.select(F.col("node").alias("a"), F.col("into")), "a").join(of.select(F.col("node").alias("b"), F.col("into").alias("into_b")), "b").where("into = into_b").select("a", "b", "into"))
    part = frontier = checkpointed(of.where("node = into"))
    while True:
        back = within.join(frontier.select(F.col("node").alias("b"), "into"), ["b", "into"]).select(F.col("a").alias("node"), "into").distinct()
        frontier = checkpointed(back.join(part, ["node", "into"], "left_anti"))
        if not frontier.take(1):
            break
        part = checkpointed(part.unionByName(frontier))
    others = part.where("node <> into")
    done.append(("merge", checkpointed(others.unionByName(others.select(F.col("into").alias("node"), "into").distinct()))))
    return checkpointed(_without(within.select("a", "b"), part))


def _labelled(edges: DataFrame, done: list) -> DataFrame:
    """From the last step to the first: a merged node has the label of what it went into, a spliced one that of both its ends."""
    label = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    for kind, rows in reversed(done):
        if not rows.take(1):
            continue
        if kind == "merge":
            new = rows.join(label.select(F.col("node").alias("into"), "component"), "into", "left").select("node", F.coalesce("component", "into").alias("component"))
        else:
            first = label.select(F.col("node").alias("before"), "component")
            second = label.select(F.col("node").alias("after"), F.col("component").alias("component2"))
            new = rows.join(first, "before").join(second, "after").where("component = component2").select("node", "component")
        label = checkpointed(label.unionByName(new).distinct())
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return label.join(least, "component").select("node", F.col("least").alias("component"))
