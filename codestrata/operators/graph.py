"""Degrees, traversal, paths, cycles, centrality and communities over an edge table (source, target, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codestrata.session import durable


def degrees(edges: DataFrame) -> DataFrame:
    """(path, fan_in, fan_out, total) of every node with an edge; edge rows count, not neighbours. Null ends are passed over."""
    o = edges.select(F.col("source").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    i = edges.select(F.col("target").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    d = o.unionByName(i).where("path is not null").groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return d.withColumn("total", F.col("fan_in") + F.col("fan_out"))


def hubs(edges: DataFrame, files: DataFrame, top: int = 10) -> DataFrame:
    """Most connected nodes: total, then fan-in, then path."""
    d = degrees(edges).join(files.select("path", "layer"), "path", "left")
    return d.orderBy(F.desc("total"), F.desc("fan_in"), "path").limit(max(1, top))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct neighbours without self loops."""
    return edges.where("source <> target").select("source", "target").dropDuplicates()


def symmetric(edges: DataFrame) -> DataFrame:
    a = adjacency(edges)
    return a.unionByName(a.select(F.col("target").alias("source"), F.col("source").alias("target"))).dropDuplicates()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes within max_depth steps of each seed, all that can be reached if None; the seed itself has depth 0.

    By breadth: each round joins the frontier with the edges and drops what is known, until it is empty. Lineage is cut every round,
    the known ones in one table per round, of which a round reads each once. The result has a row per seed and node reached.
    """
    adj = adjacency(edges).select(F.col("source").alias("node"), F.col("target").alias("next"))
    front = durable(seeds.select(F.col("node").alias("seed"), "node").where("node is not null").dropDuplicates().withColumn("depth", F.lit(0)))
    seen, d = front, 0
    while max_depth is None or d < max_depth:
        d += 1
        front = durable(front.join(adj, "node").select("seed", F.col("next").alias("node")).dropDuplicates().join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def numbered(rows: DataFrame, order: list[str], name: str = "step") -> DataFrame:
    """Adds the place (from 1) of each row in a total order: ranges are sorted each by itself, and shifted by the counts of those before."""
    r = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before, shift = 0, []
    for x in r.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row per partition
        shift.append((x._part, before))
        before += x.n
    at = F.broadcast(rows.sparkSession.createDataFrame(shift, "_part int, _before long"))
    w = W.partitionBy("_part").orderBy(*order)
    return r.withColumn("_k", F.row_number().over(w)).join(at, "_part").withColumn(name, (F.col("_k") + F.col("_before")).cast("long")).drop("_part", "_k", "_before")


def avoiding_paths(edges: DataFrame, starts: list[str], ends: list[str], avoid: list[str] = (), max_len: int = 12, stop: int = 10) -> DataFrame:
    """(path, length): the `stop` shortest paths without repeated nodes from a start to an end that pass no gate, of up to max_len steps; ties by node names.

    Steps that cannot lead to an end in what is left of the length are never taken: distances to the ends are found first. Lengths
    grow one by one, and the search ends with the first at which `stop` paths are found.
    """
    spark = edges.sparkSession
    adj = adjacency(edges)
    if avoid:
        adj = adj.where(~F.col("target").isin(*avoid) & ~F.col("source").isin(*avoid))
    back = adj.select(F.col("target").alias("source"), F.col("source").alias("target"))
    far = reach(back, spark.createDataFrame([(x,) for x in ends], "node string"), max_len).groupBy("node").agg(F.min("depth").alias("left"))
    step = durable(adj.join(far.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node"), F.col("target").alias("next"), "left"))
    first = spark.createDataFrame([(x, [x]) for x in starts if x not in avoid], "node string, path array<string>")
    schema = "path string, length long"
    for top in range(1, max_len + 1):
        cur, done = first, None
        for d in range(1, top + 1):
            cur = cur.join(step.where(F.col("left") <= top - d), "node").where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
            cur = durable(cur)
            hit = cur.where(F.col("node").isin(*ends))
            done = hit if done is None else done.unionByName(hit)
        if done.count() >= stop or top == max_len:
            return done.select(F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).cast("long").alias("length")).orderBy("length", "path").limit(stop)
    return spark.createDataFrame([], schema)


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(path, length): the shortest directed path, least by node names among equals; no row if there is none. Paths may be of any length."""
    spark = edges.sparkSession
    adj = adjacency(edges).select(F.col("source").alias("node"), F.col("target").alias("next"))
    cur = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = cur.select("node")
    while True:
        hit = cur.where(F.col("node") == end)
        if not hit.isEmpty():
            return hit.select(F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).cast("long").alias("length"))
        cur = durable(cur.join(adj, "node").groupBy(F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path")).join(seen, "node", "left_anti"))
        if cur.isEmpty():
            return hit.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("length"))
        seen = seen.unionByName(cur.select("node"))


def cycles(edges: DataFrame, max_len: int = 4) -> DataFrame:
    """(members, length): elementary cycles of up to max_len nodes, each once, beginning with its least node."""
    adj = adjacency(edges)
    cur = adj.select(F.col("source").alias("first"), F.col("target").alias("node"), F.array("source", "target").alias("path")).where("node > first")
    step = adj.select(F.col("source").alias("node"), F.col("target").alias("next"))
    out = None
    for _ in range(max_len - 1):
        j = cur.join(step, "node")
        closed = j.where("next = first").select(F.array_join("path", ",").alias("members"), F.size("path").cast("long").alias("length"))
        out = closed if out is None else out.unionByName(closed)
        cur = j.where(F.col("next") > F.col("first")).where(~F.array_contains("path", F.col("next"))).select("first", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
    return out


def _spread_least(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, color): the least node from which each node can be reached, itself included."""
    color = durable(nodes.select("node", F.col("node").alias("color")))
    while True:
        new = adj.join(color.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("color").alias("c"))
        nxt = durable(color.join(new, "node", "left").select("node", F.least("color", "c").alias("color"), (F.col("c") < F.col("color")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select("node", "color")
        color = nxt.select("node", "color")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by a node of them; nodes outside any cycle have no row.

    Nodes without a way in or out are peeled off; the rest is coloured by the least node that reaches it, and what leads back to that
    node inside its colour is a component. Whatever is left goes round again, so nothing is bounded.
    """
    adj = durable(adjacency(edges))
    out = None
    while True:
        while True:  # peel
            keep = adj.select(F.col("source").alias("node")).intersect(adj.select(F.col("target").alias("node")))
            k = durable(adj.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi"))
            same = k.count() == adj.count()
            adj = k
            if same:
                break
        if adj.isEmpty():
            break
        color = _spread_least(adj, adj.select(F.col("source").alias("node")).dropDuplicates())
        a, b = color.toDF("source", "ca"), color.toDF("target", "cb")
        inside = durable(adj.join(a, "source").join(b, "target").where("ca = cb").select("source", "target", "ca"))
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        roots = color.where("node = color").select("node")
        comp = durable(reach(back, roots).select("node", F.col("seed").alias("component")))
        big = comp.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        part = durable(comp.join(big, "component", "left_semi").select("node", "component"))
        out = part if out is None else out.unionByName(part)
        adj = durable(adj.join(comp.select(F.col("node").alias("source")), "source", "left_anti").join(comp.select(F.col("node").alias("target")), "target", "left_anti"))
    return out if out is not None else edges.select(F.col("source").alias("node"), F.col("target").alias("component")).limit(0)


def cycle_sets(edges: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges, length): every set of nodes that lie on common cycles, and the length of the shortest cycle in it through its least node.

    Cycles may be of any length; that there are as many as a component has back edges is left to `cycles` for short ones.
    """
    comp = durable(strong_components(edges))
    least = comp.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n_nodes"))
    c = durable(comp.join(least, "component").select("node", F.col("least").alias("component"), "n_nodes"))
    a = c.select(F.col("node").alias("source"), "component", "n_nodes")
    inside = durable(adjacency(edges).join(a, "source").join(c.select(F.col("node").alias("target"), F.col("component").alias("cb")), "target").where("component = cb").select("source", "target", "component", "n_nodes"))
    dist = reach(inside.select("source", "target"), c.select(F.col("component").alias("node")).dropDuplicates())
    home = inside.where("target = component").select(F.col("source").alias("node"), "component").dropDuplicates()
    length = dist.join(home, "node").where("seed = component").groupBy("component").agg((F.min("depth") + 1).cast("long").alias("length"))
    return inside.groupBy("component", "n_nodes").agg(F.count("*").alias("n_edges")).join(length, "component")


def topological_phases(edges: DataFrame) -> DataFrame:
    """(path, phase): layers of nodes whose prerequisites (sources) lie in earlier phases; what lies on or after a cycle comes last."""
    adj = durable(adjacency(edges))
    left = durable(adj.select(F.col("source").alias("path")).unionByName(adj.select(F.col("target").alias("path"))).dropDuplicates())
    out, phase = None, 0
    while True:
        waiting = adj.select(F.col("target").alias("path")).dropDuplicates()
        ready = durable(left.join(waiting, "path", "left_anti"))
        if ready.isEmpty():
            break
        part = ready.withColumn("phase", F.lit(phase))
        out = part if out is None else out.unionByName(part)
        left = durable(left.join(ready, "path", "left_anti"))
        adj = durable(adj.join(ready.withColumnRenamed("path", "source"), "source", "left_anti"))
        phase += 1
    rest = left.withColumn("phase", F.lit(phase))
    return rest if out is None else out.unionByName(rest)


def betweenness(edges: DataFrame, sample: int = 100, exact_up_to: int = 500) -> DataFrame:
    """(path, betweenness, sampled): Brandes centrality of directed simple edges, ends excluded, over (n-1)(n-2).

    Above exact_up_to nodes, `sample` sources (by the digest of their names) stand for all, scaled up. Numbers of shortest paths are
    found by breadth from all sources at once, a join and an aggregation per level; dependencies come back level by level. The
    graph is never gathered in one place. Nodes of score 0 are dropped; under 3 nodes there is none.
    """
    adj = durable(adjacency(edges))
    nodes = durable(adj.select(F.col("source").alias("node")).unionByName(adj.select(F.col("target").alias("node"))).dropDuplicates())
    n = nodes.count()
    sampled = n > exact_up_to
    src = nodes.orderBy(F.md5(F.col("node").cast("binary")), "node").limit(sample) if sampled else nodes
    step = adj.select(F.col("source").alias("v"), F.col("target").alias("w"))
    levels = [durable(src.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("n")))]
    seen = levels[0].select("s", "v")
    while True:
        nxt = levels[-1].join(step, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("n").alias("n")).join(seen, ["s", "v"], "left_anti")
        nxt = durable(nxt)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("s", "v"))
    part = None
    below = levels[-1].withColumn("delta", F.lit(0.0))
    for level in reversed(levels[:-1]):
        part = below.select("v", "delta") if part is None else part.unionByName(below.select("v", "delta"))
        up = level.join(step, "v").join(below.select("s", F.col("v").alias("w"), F.col("n").alias("m"), "delta"), ["s", "w"])
        up = up.groupBy("s", "v").agg(F.sum(F.col("n") / F.col("m") * (1 + F.col("delta"))).alias("delta"))
        below = durable(level.join(up, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0))))
    k = (n / sample if sampled else 1.0) / max((n - 1) * (n - 2), 1)
    if part is None or n < 3:
        return nodes.select(F.col("node").alias("path"), F.lit(0.0).alias("betweenness"), F.lit(sampled).alias("sampled")).limit(0)
    got = part.groupBy(F.col("v").alias("path")).agg(F.round(F.sum("delta") * k, 6).alias("betweenness"))
    return got.where("betweenness > 0").withColumn("sampled", F.lit(sampled))


def communities(edges: DataFrame, weight: str | None = None, resolution: float = 1.0, sweeps: int = 20) -> DataFrame:
    """(path, community) by moves that raise the modularity, over undirected weights without self loops.

    In each sweep half of the nodes (by a digest of name and sweep) move to the neighbouring community of the greatest gain
    k_in / m - resolution * total * k / (2 m^2), if that exceeds their own; ties go to the least name. Moving half at a time keeps two
    nodes from changing places for ever. The search ends when two sweeps in turn move nothing, or after `sweeps` (the feature's own bound).
    """
    w = F.col(weight) if weight else F.lit(1)
    e = edges.where("source <> target").select("source", "target", w.cast("double").alias("w"))
    sym = durable(e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "w")).groupBy("source", "target").agg((F.sum("w") if weight else F.max("w")).alias("w")))
    label = durable(sym.groupBy(F.col("source").alias("path")).agg(F.sum("w").alias("k")).withColumn("community", F.col("path")))
    m = (label.agg(F.sum("k")).first()[0] or 2.0) / 2
    idle = 0
    for sweep in range(sweeps):
        turn = F.pmod(F.crc32(F.concat("path", F.lit(f"#{sweep // 2}")).cast("binary")), F.lit(2)) == sweep % 2
        movers = label.where(turn)
        links = sym.join(movers.withColumnRenamed("path", "source"), "source").join(label.select(F.col("path").alias("target"), F.col("community").alias("to")), "target").groupBy("source", "community", "k", "to").agg(F.sum("w").alias("k_in"))
        # The own community counts as well, without the node itself.
        own = movers.select(F.col("path").alias("source"), "community", "k", F.col("community").alias("to"), F.lit(0.0).alias("k_in"))
        links = links.unionByName(own).groupBy("source", "community", "k", "to").agg(F.sum("k_in").alias("k_in"))
        total = label.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("total"))
        own_part = F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
        gain = F.col("k_in") / m - resolution * (F.col("total") - own_part) * F.col("k") / (2 * m * m)
        g = links.join(total, "to").withColumn("gain", F.round(gain, 12))
        best = g.groupBy("source").agg(F.max(F.struct("gain", (F.col("to") == F.col("community")).alias("stay"))).alias("b"))
        to = g.join(best, "source").where((F.col("gain") == F.col("b.gain")) & ((F.col("to") == F.col("community")) == F.col("b.stay"))).groupBy(F.col("source").alias("path")).agg(F.min("to").alias("to"))
        label = durable(label.join(to, "path", "left").select("path", "k", F.coalesce("to", "community").alias("community"), F.coalesce(F.col("to") != F.col("community"), F.lit(False)).alias("moved")))
        idle = idle + 1 if label.where("moved").isEmpty() else 0
        label = label.drop("moved")
        if idle == 2:
            break
    return label.select("path", "community")


def modularity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(modularity, n_communities) of an assignment over undirected simple edges."""
    sym = symmetric(edges)
    m2 = sym.agg(F.count("*").alias("m2"))
    a = assignment.select(F.col("path").alias("source"), F.col("community").alias("ca"))
    b = assignment.select(F.col("path").alias("target"), F.col("community").alias("cb"))
    j = sym.join(a, "source").join(b, "target")
    per = j.groupBy("ca").agg(F.count("*").alias("deg"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    q = per.join(F.broadcast(m2)).agg(F.round(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), 2)), 3).alias("modularity"), F.count("*").alias("n_communities"))
    return q


def cohesion(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(community, n_files, inside, across, cohesion): share of the undirected edges of a community that stay within it, to two decimals."""
    sym = symmetric(edges)
    a = assignment.select(F.col("path").alias("source"), F.col("community").alias("community"))
    b = assignment.select(F.col("path").alias("target"), F.col("community").alias("cb"))
    same = F.col("community") == F.col("cb")
    per = sym.join(a, "source").join(b, "target").groupBy("community").agg((F.count_if(same) / 2).cast("long").alias("inside"), F.count_if(~same).alias("across"))
    n = assignment.groupBy("community").agg(F.count("*").alias("n_files"))
    return n.join(per, "community", "left").na.fill(0, ["inside", "across"]).withColumn("cohesion", F.round(F.col("inside") / F.greatest(F.col("inside") + F.col("across"), F.lit(1)), 2))
