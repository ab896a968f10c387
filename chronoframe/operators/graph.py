"""Causal and reference graphs as edge tables (parent, child).

Closures grow by joins of the newest pairs with the edges until none is new; lineage is
cut each round in the checkpoint folder.  Pairs seen before are dropped, so cycles end.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.lineage import cut


def closure(edges: DataFrame, start: DataFrame | None = None, down: bool = True) -> DataFrame:
    """(src, dst) for everything reachable from each node of ``start`` (column ``node``), or
    from every node: descendants, or ancestors if not ``down``."""
    a, b = ("parent", "child") if down else ("child", "parent")
    step = edges.select(F.col(a).alias("mid"), F.col(b).alias("dst")).distinct()
    new = step.select(F.col("mid").alias("src"), "dst")
    if start is not None:
        new = new.join(start.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    new = cut(new)
    seen = new
    while not new.isEmpty():
        ahead = new.select("src", F.col("dst").alias("mid")).join(step, "mid").select("src", "dst")
        new = cut(ahead.distinct().join(seen, ["src", "dst"], "left_anti"))
        seen = cut(seen.union(new))
    # a node on a cycle reaches itself; that is no ancestor
    return seen.where("src <> dst")


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges, start, down=False)


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges, start)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()


def frontier(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Nodes without children."""
    of = nodes(edges) if of is None else of
    return of.join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


def roots(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Nodes without parents."""
    of = nodes(edges) if of is None else of
    return of.join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("parent").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select("child", F.lit(0), F.lit(1))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("children"), F.sum("i").alias("parents"))


def lca(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lca): one of the two if it is the other's ancestor, else the common ancestor
    with most of the common ones below it; ties to the smaller id."""
    up = cut(closure(edges, pairs.select(F.explode(F.array("a", "b")).alias("node")), down=False))
    direct = pairs.join(up.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.lit(1).alias("x")), ["a", "b"], "left")
    direct = direct.join(up.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("y")), ["a", "b"], "left")
    mine = pairs.join(up.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a")
    both = cut(mine.join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"]))
    inner = closure(edges, both.select(F.col("c").alias("node")).distinct(), down=False)
    below = both.join(inner.select(F.col("src").alias("d"), F.col("dst").alias("c")), "c")
    below = below.join(both.select("a", "b", F.col("c").alias("d")), ["a", "b", "d"], "left_semi")
    counts = below.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    ranked = both.join(counts, ["a", "b", "c"], "left").groupBy("a", "b").agg(
        F.min_by("c", F.struct(-F.coalesce("n", F.lit(0)), F.col("c"))).alias("common")
    )
    own = F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("x") == 1, F.col("a")).when(F.col("y") == 1, F.col("b"))
    return direct.join(ranked, ["a", "b"], "left").select("a", "b", F.coalesce(own, "common").alias("lca"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that an undirected path leads to."""
    both = cut(edges.select("parent", "child").union(edges.select("child", "parent")).toDF("a", "b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        # a neighbour's label, then the label that this label's own node has
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hop = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(hop.join(far, "component").select("node", F.least("component", "up").alias("component"), "was"))
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels


def connected(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are one node or joined by an undirected path."""
    c = components(edges)
    x = c.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    y = c.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(x, "a").join(y, "b").where("ca = cb").select("a", "b")


def related(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of which one is the other's ancestor, or that share an ancestor."""
    up = closure(edges, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), down=False)
    own = pairs.select(F.explode(F.array("a", "b")).alias("src")).distinct().select("src", F.col("src").alias("dst"))
    up = cut(up.union(own))
    x, y = up.toDF("a", "c"), up.toDF("b", "c")
    return pairs.join(x, "a").join(y, ["b", "c"]).select("a", "b").distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 12) -> DataFrame:
    """(a, b, path) along undirected edges, for pairs at most ``hops`` apart; of equally
    short paths the one that sorts first."""
    both = edges.select("parent", "child").union(edges.select("child", "parent")).toDF("at", "to").distinct()
    left = cut(pairs.select("a", "b").distinct())
    open_ = left.select("a", "b", F.col("a").alias("at"), F.array("a").alias("path"))
    done = None
    seen = open_.select("a", "b", "at")
    for _ in range(hops + 1):
        found = open_.where("at = b").select("a", "b", "path")
        done = found if done is None else done.union(found)
        open_ = open_.join(found.select("a", "b"), ["a", "b"], "left_anti")
        ahead = open_.join(both, "at").select("a", "b", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        ahead = ahead.groupBy("a", "b", "at").agg(F.min("path").alias("path"))
        open_ = cut(ahead.join(seen, ["a", "b", "at"], "left_anti"))
        if open_.isEmpty():
            break
        seen = cut(seen.union(open_.select("a", "b", "at")))
    return done


def highly_connected(edges: DataFrame, k: int) -> DataFrame:
    """Score a + d + floor((a + d) / 2) of each node with a ancestors and d descendants."""
    reach = cut(closure(edges))
    ends = reach.select(F.col("src").alias("node"), F.lit(1).alias("d"), F.lit(0).alias("a")).union(
        reach.select("dst", F.lit(0), F.lit(1))
    )
    by = ends.groupBy("node").agg(F.sum("a").alias("ancestors"), F.sum("d").alias("descendants"))
    total = F.col("ancestors") + F.col("descendants")
    return by.withColumn("score", total + F.floor(total / 2)).orderBy(F.desc("score"), "node").limit(k)


def garbage(edges: DataFrame, of: DataFrame, kept: DataFrame) -> DataFrame:
    """Nodes that nothing refers to and that are neither frontier nor kept roots."""
    referred = edges.select(F.col("child").alias("node"))
    leaves = frontier(edges, of)
    out = of.select("node").distinct()
    for others in (referred, leaves.select("node"), kept.select("node")):
        out = out.join(others, "node", "left_anti")
    return out


def hot_candidates(edges: DataFrame, threshold: int) -> DataFrame:
    counts = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("refs"))
    return counts.where(F.col("refs") >= threshold).orderBy(F.desc("refs"), "node")


def without_node(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes of ``gone``."""
    for end in ("parent", "child"):
        edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return edges


def shape(edges: DataFrame) -> DataFrame:
    """Roots, branches (several children) and convergences (several parents)."""
    d = degrees(edges)
    return d.agg(
        F.count_if(F.col("parents") == 0).alias("roots"),
        F.count_if(F.col("children") > 1).alias("branches"),
        F.count_if(F.col("parents") > 1).alias("convergences"),
    )


def random_walks(edges: DataFrame, walks: int, steps: int, seed: int = 5) -> DataFrame:
    """(walk, path, novelty) of seeded walks along undirected edges.

    Each step is a join of all walks with the neighbours of where they stand; a walk takes
    the neighbour whose hash with (seed, walk, step) is least.
    """
    both = cut(edges.select("parent", "child").union(edges.select("child", "parent")).toDF("at", "to").distinct())
    size = both.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    mean = size.agg(F.avg("n")).first()[0] or 1.0
    first = [r[0] for r in size.orderBy(F.xxhash64("at", F.lit(seed))).limit(walks).select("at").collect()]
    if not first:
        return both.select(F.lit(0).alias("walk"), F.array("at").alias("path"), F.lit(0.0).alias("novelty")).limit(0)
    rng = random.Random(seed)
    starts = [(w, rng.choice(first)) for w in range(walks)]
    kind = both.schema["at"].dataType.simpleString()
    now = edges.sparkSession.createDataFrame(starts, f"walk int, at {kind}").withColumn("path", F.array("at"))
    for s in range(steps):
        ahead = now.join(both, "at").groupBy("walk", "path").agg(
            F.min_by("to", F.struct(F.xxhash64("to", "walk", F.lit(s), F.lit(seed)), F.col("to"))).alias("at")
        )
        now = cut(ahead.select("walk", "at", F.concat("path", F.array("at")).alias("path")))
    novelty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.size("path"), F.lit(100)) / (mean**0.5)))
    return now.where(F.get("path", F.lit(0)) != F.col("at")).select("walk", "path", novelty.alias("novelty"))


