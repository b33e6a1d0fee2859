"""Closures, hierarchy and derivation states over the edges, as joins of frontiers; every round is written once."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.ids import counter
from quillspark.storage import forget, written


def edges_of(kb: SimpleNamespace, *types: str) -> DataFrame:
    """(src, dst) of the active concept edges of some types, each once."""
    e = kb.edge.where(F.col("relation_type").isin(*types) & (F.col("lifecycle_status") == "ACTIVE") & F.col("to_concept_id").isNotNull())
    return e.select(F.col("from_concept_id").alias("src"), F.col("to_concept_id").alias("dst")).distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) for every node that a path of one edge or more leads to; a seed reaches itself only on a cycle.

    Frontiers are joined with the edges and less what has been reached; rounds are as many as the longest shortest path.
    """
    frontier = written(seeds.select(F.col("node").alias("seed")).distinct().join(edges, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct(), "frontier")
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, ["seed", "node"], "left_anti"), "frontier")
        seen = seen.union(frontier)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependency_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All edges from the seeds and from every node that they reach."""
    nodes = reachable(edges, seeds).select("node").union(seeds.select("node")).distinct()
    return edges.join(nodes, F.col("src") == F.col("node"), "left_semi")


def dependent_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All edges from the seeds and from every node that reaches them."""
    nodes = reachable(reverse(edges), seeds).select("node").union(seeds.select("node")).distinct()
    return edges.join(nodes, F.col("src") == F.col("node"), "left_semi")


def least_reaching(edges: DataFrame) -> DataFrame:
    """(node, least) of every node on an edge: the smallest node from which a path leads to it, itself included. Labels move along edges until none changes."""
    now = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("least", F.col("node")), "labels")
    while True:
        came = edges.join(now.select(F.col("node").alias("src"), F.col("least").alias("l")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("l").alias("l"))
        new = written(now.join(came, "node", "left").select("node", F.least("least", F.coalesce("l", "least")).alias("least"), (F.coalesce("l", "least") < F.col("least")).alias("moved")), "labels")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def _core(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an edge in or without one out are peeled off, again and again: what cycles lie on, and paths between them."""
    now, n = written(edges, "core"), None
    while True:
        ends = now.select(F.col("src").alias("x")).distinct().join(now.select(F.col("dst").alias("x")), "x", "left_semi")
        kept = written(now.join(ends.withColumnRenamed("x", "src"), "src", "left_semi").join(ends.withColumnRenamed("x", "dst"), "dst", "left_semi").select("src", "dst"), "core")
        n, before = kept.count(), now.count() if n is None else n
        now = kept
        if n in (0, before):
            return now


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge: strongly connected, named by the smallest node.

    What lies on no cycle is peeled off. Each node of the rest takes the smallest node that reaches it as its colour;
    what reaches that node within the colour is its component. Components are set aside and the rest is coloured anew.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    found, left = None, _core(edges)
    while not left.isEmpty():
        colour = least_reaching(left)
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("least").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("least").alias("b")), "dst").where("a = b").select("src", "dst")
        inside = written(inside, "colours")
        back = reachable(reverse(inside), colour.where("node = least").select("node"))
        one = written(back.select(F.col("node"), F.col("seed").alias("component")).union(colour.where("node = least").select("node", "least")).distinct(), "component")
        found = one if found is None else found.union(one)
        gone = one.select("node")
        left = _core(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic(edges: DataFrame) -> DataFrame:
    """(node) of the nodes on a cycle, one that leads to itself included."""
    together = components(edges)
    many = together.join(together.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component", "left_semi").select("node")
    return many.union(edges.where("src = dst").select("src")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (u, v) names; root is the smallest node of its component.

    Alternating large and small stars; null ends and loops are left out, repeated edges count once, no edges give no rows.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
        if mark["n"] == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "stars")


#: The types that a hierarchy is made of, and whether the parent is where the edge starts.
HIERARCHY = {"PARENT_OF": True, "COMPOSED_OF": True, "PART_OF": False, "INSTANCE_OF": False}


def hierarchy_edges(kb: SimpleNamespace) -> DataFrame:
    """(src, dst) from parent to child of the active edges of the four types, each turned the right way."""
    parts = [edges_of(kb, t) if down else reverse(edges_of(kb, t)) for t, down in HIERARCHY.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


def hierarchy(edges: DataFrame) -> DataFrame:
    """(root, node, depth, path) of every simple path down from a root, however deep. Cycles end a path.

    Roots are parents without a parent; of nodes that no root leads to, the smallest that no smaller one leads to is a
    root too, so each cycle is shown from its first node.
    """
    tops = written(edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("node")), "tops")
    shown = reachable(edges, tops).select("node").union(tops)
    rest = edges.join(shown.select(F.col("node").alias("src")), "src", "left_anti")
    turns = least_reaching(rest).where("node = least").select("node").join(rest.select(F.col("src").alias("node")), "node", "left_semi")
    level = written(tops.union(turns).select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path")), "level")
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        down = level.join(edges, (F.col("node") == F.col("src")) & ~F.array_contains("path", F.col("dst")))
        level = written(down.select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path")), "level")
        out = out.union(level)
    return out


def states(edges: DataFrame, available: DataFrame, conflicting: DataFrame | None = None, lacking: DataFrame | None = None) -> DataFrame:
    """(node, state, round) of every node on an edge (src requires dst) or available, round the one in which it was settled.

    CONFLICTING as given; then AVAILABLE as given; BLOCKED on a cycle; MISSING without a requirement; BLOCKED if a
    requirement is missing, blocked or in conflict, or if the node is in `lacking`, whose requirements can't all be
    used; DERIVED when all requirements are available or derived. Rounds are as many as the longest chain.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(available.select("node")).distinct()
    first = nodes
    for name, marked in (("given", available), ("clash", conflicting), ("lacks", lacking), ("circles", cyclic(edges)), ("needs", edges.select(F.col("src").alias("node")))):
        marked = nodes.limit(0) if marked is None else marked.select("node").distinct()
        first = first.join(marked.withColumn(name, F.lit(True)), "node", "left")
    state = F.when(F.col("clash"), "CONFLICTING").when(F.col("given"), "AVAILABLE").when(F.col("circles"), "BLOCKED").when(F.col("lacks"), "BLOCKED").when(F.col("needs").isNull(), "MISSING")
    now = written(first.select("node", state.alias("state"), F.lit(0).alias("round")), "states")
    done = 0
    while True:
        done += 1
        needs = edges.join(now.select(F.col("node").alias("dst"), F.col("state").alias("s")), "dst").groupBy(F.col("src").alias("node")).agg(
            F.min(F.coalesce(F.col("s").isin("AVAILABLE", "DERIVED"), F.lit(False)).cast("int")).alias("all_there"), F.max(F.coalesce(F.col("s").isin("MISSING", "BLOCKED", "CONFLICTING"), F.lit(False)).cast("int")).alias("one_lacks"))
        settled = F.coalesce("state", F.when(F.col("one_lacks") == 1, "BLOCKED").when(F.col("all_there") == 1, "DERIVED"))
        new = now.join(needs, "node", "left").select("node", settled.alias("state"), F.when(F.col("state").isNull() & settled.isNotNull(), F.lit(done)).otherwise(F.col("round")).alias("round"), F.col("state").isNull().alias("was_open"))
        new = written(new, "states")
        now = new.drop("was_open")
        if new.where("was_open and state is not null").isEmpty():
            return now


def derivation_steps(found: DataFrame) -> DataFrame:
    """(step, node) of the derived nodes of states, in an order in which each comes after what it requires: by round, then by number."""
    rounds = found.where("state = 'DERIVED'").withColumn("n", F.row_number().over(W.partitionBy("round").orderBy(counter("node"), "node")))
    before = found.where("state = 'DERIVED'").groupBy("round").count().select("round", F.coalesce(F.sum("count").over(W.orderBy("round").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rounds.join(F.broadcast(before), "round").select((F.col("before") + F.col("n")).cast("long").alias("step"), "node")


def missing_nodes(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, required_by) of the nodes without a requirement, with the nodes that require them in order of their numbers."""
    lacking = found.where("state = 'MISSING'").select("node")
    by = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set(F.struct(counter("src").alias("n"), "src"))).alias("x"))
    return lacking.join(by, "node").select("node", F.array_join(F.col("x.src"), ",").alias("required_by"))


def derivable(edges: DataFrame, available: DataFrame) -> DataFrame:
    """(node) of all that can be derived from the available nodes."""
    return states(edges, available).where("state = 'DERIVED'").select("node")


#: Chains that are listed for a target, and the most that are looked at.
MAX_PATHS, MAX_STATES = 1000, 100_000
#: Open chains that a round keeps for each chain that may be listed.
WIDTH = 4


def chains_of(edges: DataFrame, available: DataFrame, targets: DataFrame, limit: int = MAX_PATHS, states: int = MAX_STATES) -> DataFrame:
    """(target, place, path, complete) of the simple chains from available nodes to targets (target), inputs first, by the numbers of their nodes: the first `limit`, and whether these are all.

    A chain goes on through nodes that are available themselves. Only nodes from which an available one can be had are
    entered, so nearly every open chain ends in a listed one, and a round keeps the first WIDTH * limit open chains of a
    target. A target whose rounds had to leave some out, or that has looked at `states` chains, is not complete. A graph
    with however many chains takes as many rounds as its longest chain, each of bounded size.
    """
    e = written(edges.select("src", "dst").distinct(), "edges")
    there = written(available.select(F.col("node").alias("at")).distinct(), "available")
    useful = reachable(reverse(e), there.select(F.col("at").alias("node"))).select("node").union(there.select("at")).distinct()
    e = written(e.join(useful.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "useful")
    number = lambda c: F.struct(counter(c).alias("n"), c.alias("id"))
    one = targets.select("target").distinct()
    level = written(one.select("target", F.col("target").alias("at"), F.array(number(F.col("target"))).alias("path")), "open")
    seen, found, cut = written(one.withColumn("seen", F.lit(0).cast("long")), "seen"), None, one.limit(0)
    while True:
        step = level.join(e, F.col("at") == F.col("src")).where(~F.exists("path", lambda x: x["id"] == F.col("dst")))
        step = step.select("target", F.col("dst").alias("at"), F.concat("path", F.array(number(F.col("dst")))).alias("path"))
        left = F.least(F.lit(WIDTH * limit), F.lit(states) - F.col("seen"))
        ranked = step.join(seen, "target").withColumn("k", F.row_number().over(W.partitionBy("target").orderBy("path"))).withColumn("left", left)
        ranked = written(ranked.where(F.col("k") <= F.greatest(F.col("left"), F.lit(0)) + 1), "ranked")
        if ranked.isEmpty():
            break
        cut = written(cut.union(ranked.where("k > left").select("target")).distinct(), "cut")
        before, level = level, written(ranked.where("k <= left").select("target", "at", "path"), "open")
        forget(before)
        seen = written(seen.join(level.groupBy("target").agg(F.count("*").alias("more")), "target", "left").select("target", (F.col("seen") + F.coalesce("more", F.lit(0).cast("long"))).alias("seen")), "seen")
        done = level.join(there, "at", "left_semi").select("target", F.reverse("path").alias("path"))
        both = done if found is None else found.union(done)
        # more than the limit are never needed: the first ones, and one that says that there are others
        best = both.withColumn("k", F.row_number().over(W.partitionBy("target").orderBy("path"))).where(F.col("k") <= limit + 1).drop("k")
        before, found = found, written(best, "found")
        forget(before)
        forget(ranked)
    if found is None:
        return one.select("target", F.lit(1).cast("long").alias("place"), F.array("target").alias("path"), F.lit(True).alias("complete")).limit(0)
    per = found.withColumn("place", F.row_number().over(W.partitionBy("target").orderBy("path")).cast("long")).withColumn("n", F.count("*").over(W.partitionBy("target")))
    per = per.where(F.col("place") <= limit).join(cut.withColumn("cut", F.lit(True)), "target", "left")
    return per.select("target", "place", F.transform("path", lambda x: x["id"]).alias("path"), ((F.col("n") <= limit) & F.col("cut").isNull()).alias("complete"))


def chains(edges: DataFrame, available: DataFrame, target: str, limit: int = MAX_PATHS) -> DataFrame:
    """(path, complete) of the chains of one target; see chains_of."""
    one = edges.sparkSession.createDataFrame([(target,)], "target string")
    return chains_of(edges, available, one, limit).orderBy("place").select("path", "complete")


def shared_hierarchy(edges: DataFrame) -> DataFrame:
    """(root, node, n_paths, least_depth, most_depth) for every node that a root leads to: how many ways lead down to it, and the shortest and longest.

    A part that many parents share is one row for each root, not one for each way. Edges between nodes of one circle are
    left out (see hierarchy_cycles); roots are parents that no other edge leads to. Ways are counted length by length,
    so there are as many rounds as the longest way is long and never more rows than roots and nodes.
    """
    together = written(components(edges), "components")
    side = lambda c: together.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    e = written(edges.distinct().join(side("src"), "src").join(side("dst"), "dst").where("src_of <> dst_of").select("src", "dst"), "edges")
    tops = e.select("src").distinct().join(e.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("root"))
    level = written(tops.select("root", F.col("root").alias("node"), F.lit(1).cast("decimal(38,0)").alias("n_paths")), "level")
    out, depth = level.withColumn("depth", F.lit(0)), 0
    while not level.isEmpty():
        depth += 1
        level = written(level.join(e, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.sum("n_paths").cast("decimal(38,0)").alias("n_paths")), "level")
        out = out.union(level.withColumn("depth", F.lit(depth)))
    return out.groupBy("root", "node").agg(F.sum("n_paths").cast("decimal(38,0)").alias("n_paths"), F.min("depth").alias("least_depth"), F.max("depth").alias("most_depth"))


def hierarchy_cycles(edges: DataFrame) -> DataFrame:
    """(component, path) of each group of nodes that lead to one another: the shortest way from its smallest node back to itself, the first of these by name."""
    together = components(edges)
    side = lambda c: together.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    e = written(edges.distinct().join(side("src"), "src").join(side("dst"), "dst").where("src_of = dst_of").select("src", "dst", F.col("src_of").alias("component")), "edges")
    first = e.where("src = component")
    level = written(first.select("component", F.array("src", "dst").alias("path"), F.col("dst").alias("at")), "level")
    out = None
    while not level.isEmpty():
        done = level.where("at = component").groupBy("component").agg(F.min("path").alias("path"))
        out = done if out is None else out.union(done)
        still = level.where("at <> component").join(done, "component", "left_anti")
        # of the ways of a length to a node only the first can be part of the first shortest circle
        step = still.join(e, [still["component"] == e["component"], F.col("at") == F.col("src")]).where((F.col("dst") == still["component"]) | ~F.array_contains("path", F.col("dst")))
        level = written(step.select(still["component"], F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")).groupBy("component", "at").agg(F.min("path").alias("path")).select("component", "path", "at"), "level")
    return edges.select(F.col("src").alias("component"), F.array("src").alias("path")).limit(0) if out is None else out
