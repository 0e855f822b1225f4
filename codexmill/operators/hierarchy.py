"""Parent-child rows to full hierarchies (problem 5).

Frontier joins from the roots, level-wise with halving strides. The edges are first composed with themselves: edges of
1, 2, 4, 8, ... levels, each with the keys it passes. Of those only nodes that deep are left, so that the tables shrink as
the strides grow. The frontier then starts at the roots and takes the longest stride first: a join with the edges of 2^k
levels adds all nodes at odd multiples of 2^k below what was reached, with their paths and depths, down to single
levels. A tree of d levels takes 2 log2(d) joins where one join a level would take d.

Two strides that leave equally many nodes tell that all that are left run into a cycle (a node deeper than 2^(k+1) has an
ancestor between both strides). What the longest stride reaches from those (usually few) nodes, doubled until its parents
are as many as itself, are the nodes on cycles; the smallest key of each cycle follows by doubling too. They are roots of
the frontier as well: strides that would leave a node on a cycle are taken out, and what they reach leads in.

Defined results: edges with a null end are ignored; repeated edges count once; a node with several different parents has
none; trees of any depth end. Keys of different trees never mix. A node on a cycle has itself as path; the other nodes of
its cycle share its root_key and are told by that, not as descendants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.session import Scratch


def _compose(edges: DataFrame) -> DataFrame:
    """``edges`` (tree, node, at, path) taken twice: twice as many levels, both paths in one."""
    upper = edges.select("tree", F.col("node").alias("at"), F.col("at").alias("top"), F.col("path").alias("first"))
    return edges.join(upper, ["tree", "at"]).select("tree", "node", F.col("top").alias("at"), F.concat("first", "path").alias("path"))


def _strides(scratch: Scratch, longest: DataFrame) -> tuple[list[DataFrame], int]:
    """Ever longer strides behind ``longest``, and how many nodes the last one leaves that all run into a cycle."""
    found, left = [longest], longest.count()
    while left:
        longer = scratch.cut(_compose(found[-1]))
        n = longer.count()
        if n == left:  # nobody was too high for the longer stride
            scratch.drop(longer)
            break
        found.append(longer)
        left = n
    return found, left


def _double(jump: DataFrame) -> DataFrame:
    ahead = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
    return jump.join(ahead, ["tree", "to"]).select("tree", "node", F.col("to2").alias("to"), F.least("low", "low2").alias("low"))


def _cycles(scratch: Scratch, edges: DataFrame, endless: DataFrame) -> DataFrame:
    """(tree, node, root) of the nodes on cycles, root the smallest key of the cycle. ``endless`` (tree, node, at): a stride of nodes that all run into one."""
    jump = endless.select("tree", "node", F.col("at").alias("to"), F.col("at").alias("low"))
    while True:
        image = scratch.cut(jump.select("tree", F.col("to").alias("node")).distinct())
        steps = scratch.cut(edges.join(image, ["tree", "node"], "left_semi").select("tree", "node", F.col("parent").alias("to"), F.least("node", "parent").alias("low")))
        if steps.select("tree", "to").distinct().count() == image.count():  # the parents of the image are the image: all on cycles
            break
        scratch.drop(steps)
        jump = scratch.cut(_double(jump))
    while True:  # the least key of ever longer stretches, until nothing changes any more
        further = scratch.cut(_double(_double(steps)).join(steps.select("tree", "node", F.col("low").alias("was")), ["tree", "node"]))
        settled = further.where(F.col("low") != F.col("was")).isEmpty()
        scratch.drop(steps)
        steps = further.drop("was")
        if settled:
            return steps.select("tree", "node", F.col("low").alias("root"))


def resolve_hierarchy(edges: DataFrame) -> DataFrame:
    """Hierarchy of ``edges`` (tree, node, parent): tree, node_key, root_key, depth, cycle_state, path (keys from the root).

    One row for each node that has a parent.
    """
    scratch = Scratch(edges.sparkSession, "hierarchy")
    clean = edges.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"))
    e = scratch.cut(clean.where(F.col("parent") == F.col("other")).drop("other"))
    roots = scratch.cut(e.select("tree", F.col("parent").alias("node")).distinct().join(e, ["tree", "node"], "left_anti"))
    start = roots.select("tree", "node", F.array("node").alias("path"), F.lit("none").alias("cycle_state"))
    strides, left = _strides(scratch, e.select("tree", "node", F.col("parent").alias("at"), F.array("node").alias("path")))
    on = None
    if left:
        on = scratch.cut(_cycles(scratch, e, strides[-1]))
        start = start.unionByName(on.select("tree", "node", F.array("node").alias("path"), F.lit("leads").alias("cycle_state")))
        # a stride whose first key is on a cycle leaves from there only to go round
        block = on.select("tree", F.col("node").alias("child"))
        strides = [x.withColumn("child", F.col("path")[0]).join(block, ["tree", "child"], "left_anti").drop("child") for x in strides]
        strides = strides[:-1] + _strides(scratch, scratch.cut(strides[-1]))[0]
    reached = [start]
    for step in reversed(strides):
        at = reduce(DataFrame.unionByName, reached).select("tree", F.col("node").alias("at"), F.col("path").alias("first"), "cycle_state")
        reached.append(scratch.cut(step.join(at, ["tree", "at"]).select("tree", "node", F.concat("first", "path").alias("path"), "cycle_state")))
    found = reduce(DataFrame.unionByName, reached[1:]).select("tree", F.col("node").alias("node_key"), F.col("path")[0].alias("root_key"), (F.size("path") - 1).cast("long").alias("depth"), "cycle_state", "path")
    if on is None:
        return found
    return found.unionByName(on.select("tree", F.col("node").alias("node_key"), F.col("root").alias("root_key"), F.lit(0).cast("long").alias("depth"), F.lit("on").alias("cycle_state"), F.array("node").alias("path")))


def descendants(hierarchy: DataFrame) -> DataFrame:
    """All (tree, ancestor, node_key, distance) pairs of acyclic ancestry, from the paths; a node is no descendant of itself."""
    steps = hierarchy.where(F.col("cycle_state") != "on").select("tree", "node_key", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "ancestor"), F.size("path").alias("n"))
    return steps.select("tree", "ancestor", "node_key", (F.col("n") - 1 - F.col("i")).cast("long").alias("distance"))


def fallback_edges(declarations: DataFrame) -> DataFrame:
    """A declaration's parent is the one declaration of its book that its trimmed fallback names; copies give copies."""
    from codexmill.operators.orphans import trimmed

    owner = (
        declarations.select("pub_id", trimmed("id").alias("ref"), "decl_key")
        .where(F.col("ref").isNotNull() & F.col("decl_key").isNotNull())
        .groupBy("pub_id", "ref")
        .agg(F.min("decl_key").alias("parent"), F.max("decl_key").alias("other"))
        .where(F.col("parent") == F.col("other"))
    )
    child = declarations.select("pub_id", trimmed("fallback").alias("ref"), F.col("decl_key").alias("node")).where(F.col("ref").isNotNull())
    return child.join(owner, ["pub_id", "ref"]).select(F.lit("fallback").alias("tree"), "node", "parent")


def navigation_edges(points: DataFrame) -> DataFrame:
    """A point's parent is the point of the same book and list whose path is its own without the last index; copies give copies."""
    p = points.where(F.col("point_path").isNotNull() & F.col("nav_key").isNotNull()).select("pub_id", "list_index", "point_path", "nav_key")
    owner = p.groupBy("pub_id", "list_index", "point_path").agg(F.min("nav_key").alias("parent"))
    child = p.where(F.size("point_path") > 1).select("pub_id", "list_index", F.slice("point_path", 1, F.size("point_path") - 1).alias("point_path"), F.col("nav_key").alias("node"))
    return child.join(owner, ["pub_id", "list_index", "point_path"]).select(F.lit("nav").alias("tree"), "node", "parent")
