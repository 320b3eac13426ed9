"""Reachability: a frontier that moves one hop a round and never visits a node twice."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import storage


#: Graphs of at most this many edges are walked in one go on the driver; the result is the same.
SMALL_EDGES = 250_000
#: Pairs that the driver makes at most.
SMALL_PAIRS = 500_000


def _few(edges: DataFrame, limit: int | None) -> list | None:
    """The (src, dst) pairs if there are at most `limit`."""
    limit = SMALL_EDGES if limit is None else limit
    if not limit or edges.count() > limit:
        return None
    rows = edges.select("src", "dst").toPandas()
    return list(zip(rows["src"], rows["dst"], strict=True))


def _few_nodes(nodes: DataFrame) -> list[str] | None:
    """The distinct nodes if there are at most SMALL_EDGES."""
    rows = nodes.select("node").distinct().limit(SMALL_EDGES + 1).collect()
    return [r.node for r in rows] if len(rows) <= SMALL_EDGES else None


def reach(edges: DataFrame, start: DataFrame, direction: str = "down", depth: int | None = None, stop: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(node, distance): nodes within `depth` hops of the start nodes (one column, node), themselves included.

    down follows edges, up goes against them; depth None has no limit. Nodes in `stop` are reached but not left. A round
    joins the frontier, broadcast while it is small, with the edges, and drops visited nodes; cycles end by themselves.
    Up to `small` edges (SMALL_EDGES by default), SMALL_EDGES start nodes and without stop nodes the walk runs on the driver.
    """
    spark = edges.sparkSession
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    pairs = _few(edges, small) if stop is None else None
    first = _few_nodes(start) if pairs is not None else None
    if first is not None:
        after = defaultdict(list)
        for s, t in pairs:
            after[s if direction == "down" else t].append(t if direction == "down" else s)
        seen = dict.fromkeys(first, 0)
        front, at = list(seen), 0
        while front and (depth is None or at < depth):
            at += 1
            front = [n for n in dict.fromkeys(n for f in front for n in after[f]) if n not in seen]
            seen |= dict.fromkeys(front, at)
        return spark.createDataFrame(list(seen.items()), "node string, distance int")
    hops = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
    levels = storage.Levels(spark, "node string, distance int", "reach")
    frontier, n = levels.add(start.select("node", F.lit(0).alias("distance")).distinct())
    at = 0
    while n and (depth is None or at < depth):
        at += 1
        leave = frontier.join(stop, "node", "left_anti") if stop is not None else frontier
        found = hops.join(storage.small(leave.select("node"), n), "node").select(F.col("next").alias("node")).distinct()
        found = found.join(levels.all().select("node"), "node", "left_anti")
        frontier, n = levels.add(found.select("node", F.lit(at).alias("distance")))
    return levels.all()


def window(edges: DataFrame, focus: DataFrame, up: int | None, down: int | None) -> DataFrame:
    """(node): within `up` hops against and `down` hops along the edges from any focus node, the focus included."""
    return reach(edges, focus, "up", up).select("node").union(reach(edges, focus, "down", down).select("node")).distinct()


def reach_pairs(edges: DataFrame, roots: DataFrame, direction: str = "up", small: int | None = None) -> DataFrame:
    """(root, node, distance) for every root (one column, node) and every node it reaches, itself at 0.

    Grows with the pairs it returns: one join a round for all roots together. Up to `small` edges and SMALL_EDGES roots, it
    is done on the driver, as long as there are at most SMALL_PAIRS pairs; beyond those it starts anew in rounds.
    """
    spark = edges.sparkSession
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    schema = "root string, node string, distance int"
    pairs = _few(edges, small)
    first = _few_nodes(roots) if pairs is not None else None
    if first is not None:
        after = defaultdict(list)
        for s, t in pairs:
            after[s if direction == "down" else t].append(t if direction == "down" else s)
        out = []
        for root in first:
            seen, front, at = {root: 0}, [root], 0
            while front:
                at += 1
                front = [n for n in dict.fromkeys(n for f in front for n in after[f]) if n not in seen]
                seen |= dict.fromkeys(front, at)
            out += [(root, n, d) for n, d in seen.items()]
            if len(out) > SMALL_PAIRS:
                break
        else:
            return spark.createDataFrame(out, schema)
    hops = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    levels = storage.Levels(spark, schema, "pairs")
    front, n = levels.add(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("distance")).distinct())
    at = 0
    while n:
        at += 1
        found = front.join(hops, "node").select("root", F.col("next").alias("node")).distinct()
        found = found.join(levels.all().select("root", "node"), ["root", "node"], "left_anti")
        front, n = levels.add(found.select("root", "node", F.lit(at).alias("distance")))
    return levels.all()


def layers(edges: DataFrame, nodes: DataFrame, small: int | None = None) -> DataFrame:
    """(node, layer): the longest path from a root; layers of nodes on or after a cycle are null.

    A round takes off the nodes that wait for nothing, and counts them off at the nodes they point to. nodes has one column, node.
    """
    spark = edges.sparkSession
    pairs = _few(edges, small)
    if pairs is not None and nodes.count() <= SMALL_EDGES:
        todo, after = {r.node: 0 for r in nodes.collect()}, defaultdict(set)
        for s, t in pairs:
            after[s].add(t)
        for ts in after.values():
            for t in ts:
                if t in todo:
                    todo[t] += 1
        front, got, at = [n for n, k in todo.items() if not k], {}, 0
        while front:
            got |= dict.fromkeys(front, at)
            nxt = []
            for n in front:
                for t in after[n]:
                    if t in todo:
                        todo[t] -= 1
                        if not todo[t]:
                            nxt.append(t)
            front, at = nxt, at + 1
        return spark.createDataFrame([(n, got.get(n)) for n in todo], "node string, layer int")
    hops = storage.stored(edges.select("src", "dst").distinct(), "layer-edges")
    waits = hops.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("waits"))
    rest = storage.stored(nodes.select("node").distinct().join(waits, "node", "left").select("node", F.coalesce("waits", F.lit(0)).cast("long").alias("waits")), "layer-nodes")
    out = storage.Levels(spark, "node string, layer int", "layers")
    at = 0
    while True:
        front, n = out.add(rest.where("waits = 0").select("node", F.lit(at).alias("layer")))
        rest = rest.where("waits > 0")
        if not n:
            return out.all().union(rest.select("node", F.lit(None).cast("int")))
        met = hops.join(storage.small(front.select(F.col("node").alias("src")), n), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met"))
        rest = storage.stored(rest.join(met, "node", "left").select("node", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits")), "layer-nodes")
        at += 1


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges from which a cycle can be reached; none in an acyclic graph. A round takes off edges into dead ends."""
    left = storage.stored(edges.select("src", "dst").distinct(), "cycle-edges")
    n = left.count()
    while n:
        kept = storage.stored(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "cycle-edges")
        m = kept.count()
        if m == n:
            break
        left, n = kept, m
    return left


def find_cycle(edges: DataFrame) -> list[str]:
    """One cycle, its first node repeated at the end; [] if there is none.

    From the smallest node that reaches a cycle the walk takes the smallest next node, of which there always is one,
    until a node comes again. Where successors are few they are followed on the driver; else by pointer doubling: after
    j rounds a node on the walk's cycle is known, 2^j steps from the start, and only the cycle itself is then collected.
    """
    rest = on_cycles(edges)
    step = storage.stored(rest.groupBy("src").agg(F.min("dst").alias("dst")), "successors")
    first = step.agg(F.min("src")).first()[0]
    if first is None:
        return []
    many = step.count()
    if many > FEW_STEPS:
        step = _walked(step, first, many)
    few = dict(step.select("src", "dst").collect())
    path, seen = [first], {first: 0}
    while True:
        at = few[path[-1]]
        if at in seen:
            return path[seen[at] :] + [at]
        seen[at] = len(path)
        path.append(at)


#: Successors that the driver follows itself.
FEW_STEPS = 10_000


def _walked(step: DataFrame, first: str, many: int) -> DataFrame:
    """The successors of the nodes that the walk from `first` meets: a round doubles how many are known, by jumps that double too."""
    spark = step.sparkSession
    met = spark.createDataFrame([(first,)], "node string")
    jump, n = step, 1
    for _ in range(many.bit_length() + 1):
        more = met.join(jump, met["node"] == jump["src"]).select(F.col("dst").alias("node"))
        met = storage.stored(met.union(more).distinct(), "walk")
        now = met.count()
        if now == n:  # all that follows is met already
            break
        n = now
        jump = storage.stored(jump.alias("a").join(step_to(jump), F.col("a.dst") == F.col("b_src")).select("a.src", F.col("b_dst").alias("dst")), "jump")
    return step.join(met, step["src"] == met["node"], "left_semi")


def step_to(jump: DataFrame) -> DataFrame:
    return jump.select(F.col("src").alias("b_src"), F.col("dst").alias("b_dst"))
