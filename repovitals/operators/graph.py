"""Dependency graphs as tables of edges (src, dst): fans, closure, components, chains."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import materialised


def fans(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of every node, in one aggregation over both ends."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def hubs(edges: DataFrame, fan_in: int = 10, fan_out: int = 5) -> DataFrame:
    return fans(edges).where((F.col("fan_in") >= fan_in) & (F.col("fan_out") >= fan_out))


def hub_score(edges: DataFrame, fan_in: int = 10, fan_out: int = 5) -> DataFrame:
    """(modules, hubs, score): 1 less three times the hubs' share; 1 where there is no module."""
    hub = (F.col("fan_in") >= fan_in) & (F.col("fan_out") >= fan_out)
    return fans(edges).agg(F.count("*").alias("modules"), F.count(F.when(hub, 1)).alias("hubs")).withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - F.coalesce(3 * F.col("hubs") / F.nullif("modules", F.lit(0)), F.lit(0.0))), 9))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs with a path, by doubling: each round joins paths with paths, so rounds grow with the
    logarithm of the longest path. Meant for module graphs; sketches() estimates reach of larger ones."""
    known = materialised(edges.select("src", "dst").distinct(), "closure")
    size = known.count()
    while True:
        longer = known.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        known = materialised(known.unionByName(longer).distinct(), "closure", known)
        now = known.count()
        if now == size:
            return known
        size = now


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def reach(edges: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """(node, reach, reverse_reach): other nodes it reaches and is reached from.

    Paths are closed among strong components, not nodes: a component's nodes all reach what the component reaches."""
    comp = comp if comp is not None else strong_components(edges)
    of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    between = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").where("c_src <> c_dst")
    paths = closure(between.select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")))
    sizes = comp.select("component", "size").distinct()
    total = lambda end, other, name: paths.join(sizes.withColumnRenamed("component", other), other).groupBy(F.col(end).alias("component")).agg(F.sum("size").alias(name))
    found = comp.join(total("src", "dst", "f"), "component", "left").join(total("dst", "src", "b"), "component", "left")
    count = lambda c, n: (F.col("size") - 1 + F.coalesce(c, F.lit(0))).alias(n)
    return found.select("node", count("f", "reach"), count("b", "reverse_reach"))


def sketches(edges: DataFrame) -> DataFrame:
    """(node, reach) estimated by merging HyperLogLog sketches along edges until nothing grows: rows stay one a node."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    now = materialised(nodes.groupBy("node").agg(F.hll_sketch_agg("node").alias("s")), "sketch")
    before = None
    while True:
        got = edges.join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "s")
        now = materialised(now.unionByName(got).groupBy("node").agg(F.hll_union_agg("s").alias("s")), "sketch", now)
        told = now.agg(F.sum(F.hll_sketch_estimate("s"))).first()[0]
        if told == before:
            break
        before = told
    return now.select("node", (F.hll_sketch_estimate("s") - 1).alias("reach"))


def propagation_cost(edges: DataFrame, comp: DataFrame | None = None, target: float = 0.3, scale: float = 0.4) -> DataFrame:
    """(modules, cost, score): sum of reverse reach over n squared."""
    sums = reach(edges, comp).agg(F.count("*").alias("modules"), F.sum("reverse_reach").alias("r"))
    cost = F.coalesce(F.col("r") / (F.col("modules") * F.col("modules")), F.lit(0.0))
    return sums.select("modules", F.round(cost, 9).alias("cost"), F.round(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cost - target) / scale)), 9).alias("score"))


def _least_reaching(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, label): the least label (node, label) from which a path leads to the node, its own included."""
    now, before = start, None
    while True:
        last = now
        for _ in range(2):  # two steps a round, for fewer rounds
            got = edges.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
            now = now.unionByName(got).groupBy("node").agg(F.min("label").alias("label"))
        now = materialised(now, "labels", last if before is not None else None)
        told = now.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if told == before:
            return now
        before = told


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those whose source nothing leads to or whose end leads nowhere: they lie on no cycle. Three layers at a time."""
    for _ in range(3):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return materialised(edges.select("src", "dst"), "trimmed")


#: Edges that one task takes at once; a larger graph is coloured over the cluster, with the same result.
SMALL = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, label): components of a graph of at most SMALL edges, by a depth-first search without recursion."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches):
        out: dict = {}
        for batch in batches:
            type_ = batch.schema.field(0).type
            for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.setdefault(src, []).append(dst)
                out.setdefault(dst, [])
        seen, low, held, label = {}, {}, [], {}
        for start in out:
            if start in seen:
                continue
            path = [(start, iter(out[start]))]
            seen[start] = low[start] = len(seen)
            held.append(start)
            while path:
                node, rest = path[-1]
                for other in rest:
                    if other not in seen:
                        seen[other] = low[other] = len(seen)
                        held.append(other)
                        path.append((other, iter(out[other])))
                        break
                    if other not in label:
                        low[node] = min(low[node], seen[other])
                else:
                    path.pop()
                    if path:
                        low[path[-1][0]] = min(low[path[-1][0]], low[node])
                    if low[node] == seen[node]:
                        members = []
                        while not members or members[-1] != node:
                            members.append(held.pop())
                        label.update(dict.fromkeys(members, min(members)))
        if label:
            yield pa.record_batch([pa.array(list(label), type_), pa.array(list(label.values()), type_)], ["node", "label"])

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, label {kind}")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size): nodes that reach one another; component is the smallest of them.

    By colours: a node's colour is the smallest node that reaches it; nodes that reach their colour's root over nodes of
    the colour are its component. They are taken out, and what is left is coloured again. Rows stay one an edge or node."""
    plain = materialised(edges.select("src", "dst").distinct(), "edges")
    if plain.count() <= SMALL:
        small = materialised(_in_one_task(plain), "components")
        return small.select("node", F.col("label").alias("component")).withColumn("size", F.count("*").over(W.partitionBy("component")))
    left = _trimmed(plain.where("src <> dst"))
    found = None
    while not left.isEmpty():
        colours = _least_reaching(left, _nodes(left).withColumn("label", F.col("node")))
        of = lambda side: colours.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}"))  # noqa: B023, E731
        same = materialised(left.join(of("src"), "src").join(of("dst"), "dst").where("l_src = l_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "same")
        roots = colours.where("node = label")
        members = _least_reaching(same, roots)  # backwards, within a colour: all labels there are its root
        found = members if found is None else found.unionByName(members)
        gone = members.select("node")
        kept = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _trimmed(kept.select("src", "dst"))
    nodes = _nodes(edges)
    label = nodes.withColumn("component", F.col("node"))
    if found is not None:
        label = nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("component"))
    return label.withColumn("size", F.count("*").over(W.partitionBy("component")))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, break_src, break_dst): components of two and more, or with a self-loop, and the edge inside
    whose source has the fewest edges inside (ties: smallest src, dst)."""
    comp = strong_components(edges)
    of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"), F.col("size").alias(f"n_{side}"))
    inner = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst AND (n_src > 1 OR src = dst)")
    fan = inner.withColumn("fan", F.count("*").over(W.partitionBy("src")))
    return fan.groupBy(F.col("c_src").alias("component")).agg(F.max("n_src").alias("size"), F.min(F.struct("fan", "src", "dst")).alias("b")).select("component", "size", F.col("b.src").alias("break_src"), F.col("b.dst").alias("break_dst"))


def cycle_score(found: DataFrame) -> DataFrame:
    """(cycles, largest, score): 1 - min(.45, .05 n) - size penalty, at least .05."""
    penalty = F.least(F.lit(0.5), 0.05 * F.log2(F.greatest(F.lit(1.0), F.col("largest").cast("double"))))
    return found.agg(F.count("*").alias("cycles"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")).withColumn("score", F.round(F.when(F.col("cycles") == 0, 1.0).otherwise(F.greatest(F.lit(0.05), 1 - F.least(F.lit(0.45), 0.05 * F.col("cycles")) - penalty)), 9))


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth, cyclic): steps of the longest chain that starts at a node, and whether a cycle is on its way.

    A cycle counts the steps around it once. Rows stay one a node: components first, then one layer a round."""
    comp = materialised(strong_components(edges), "components")
    of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    between = materialised(edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").where("c_src <> c_dst").select("c_src", "c_dst").distinct(), "between")
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    each = comp.join(own, "node", "left").groupBy("component").agg(F.max("size").alias("size"), F.coalesce(F.bool_or("loop"), F.lit(False)).alias("loop"))
    steps = F.when(F.col("size") > 1, F.col("size")).otherwise(F.col("loop").cast("long"))
    base = materialised(each.select("component", steps.cast("long").alias("steps"), (F.col("size") > 1).alias("many"), (steps > 0).alias("cyclic")), "steps")
    now = base.select("component", F.col("steps").alias("depth"), "cyclic")
    while True:
        got = between.join(now.withColumnRenamed("component", "c_dst"), "c_dst").groupBy(F.col("c_src").alias("component")).agg((F.max("depth") + 1).alias("d"), F.bool_or("cyclic").alias("c"))
        # From inside a cycle the longest way out goes around it first.
        next_ = base.join(got, "component", "left").select("component", F.greatest("steps", F.coalesce("d", F.lit(0)) + F.when(F.col("many"), F.col("steps") - 1).otherwise(0)).alias("depth"), (F.col("cyclic") | F.coalesce("c", F.lit(False))).alias("cyclic"))
        next_ = materialised(next_, "depths")
        if next_.exceptAll(now).isEmpty():
            return comp.join(next_, "component").select("node", "depth", "cyclic")
        now = next_


def chain_score(edges: DataFrame, free: float = 3, scale: float = 3) -> DataFrame:
    """(depth, cyclic, score) of re-exports (src, dst): the longest chain beyond `free`, as a share of `scale`."""
    found = depths(edges).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.coalesce(F.bool_or("cyclic"), F.lit(False)).alias("cyclic"))
    return found.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.col("depth") - free) / scale), 9))


def ancestors(parents: DataFrame, sha: str) -> DataFrame:
    """(node): a commit and all before it, by rows (sha, parent)."""
    seed = parents.sparkSession.createDataFrame([(sha,)], "node string")
    return spread(seed, parents.select(F.col("parent").alias("src"), F.col("sha").alias("dst")))


def pull_in_chains(direct: DataFrame, depends: DataFrame) -> DataFrame:
    """(node, chain): of every node that direct ones (node) bring, through (src, dst), a shortest chain from a direct one;
    of equal ones the least. A breadth-first round for each length."""
    known = fresh = materialised(direct.select("node", F.array("node").alias("chain")).groupBy("node").agg(F.min("chain").alias("chain")), "chain")
    while not fresh.isEmpty():
        got = depends.join(fresh.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.array_append("chain", F.col("dst")).alias("chain"))
        fresh = materialised(got.join(known.select("node"), "node", "left_anti").groupBy("node").agg(F.min("chain").alias("chain")), "chain")
        known = known.unionByName(fresh)
    return known


def chains(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(start, last, depth, cyclic): every walk from the starts (node) that ends or closes a cycle, or has `most` steps where that is given."""
    walk = starts.select(F.col("node").alias("start"), F.col("node").alias("last"), F.array("node").alias("path"))
    done = None
    hop = edges.select(F.col("src").alias("last"), F.col("dst").alias("to")).distinct()
    step = 0
    while True:
        met = walk.join(hop, "last", "left")
        over = F.lit(True) if step == most else F.col("to").isNull()
        again = F.array_contains("path", F.col("to"))
        ended = met.where(over | again).select("start", "last", (F.size("path") - 1).alias("depth"), F.coalesce(again, F.lit(False)).alias("cyclic")).distinct()
        done = ended if done is None else done.unionByName(ended)
        if step == most:
            break
        walk = met.where(~over & ~again).select("start", F.col("to").alias("last"), F.array_append("path", F.col("to")).alias("path"))
        step += 1
        if most is None:
            walk = materialised(walk, "chains")
            if walk.isEmpty():
                break
    return done


def spread(seeds: DataFrame, calls: DataFrame) -> DataFrame:
    """(node): the least set that holds the seeds (node) and every caller (src) of a member (dst): semi-naive rounds."""
    known = fresh = materialised(seeds.select("node").distinct(), "spread")
    while not fresh.isEmpty():
        got = calls.join(fresh.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct()
        fresh = materialised(got.join(known, "node", "left_anti"), "spread")
        known = known.unionByName(fresh)
    return known
