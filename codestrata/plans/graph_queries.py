"""Traversal and graph analytics on the nation graph, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import graph
from codestrata.plans.bindings import Registry, edges, functions, gfiles, links, nodes, top_sources

R = Registry()
QUERIES, SQL = R.queries, R.sql

_DEG = "d AS (SELECT path, CAST(sum(i) AS BIGINT) fan_in, CAST(sum(o) AS BIGINT) fan_out, CAST(sum(i + o) AS BIGINT) total FROM (SELECT source path, 1 o, 0 i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY 1)"


@R.add("hub_nodes", f"WITH {_DEG} SELECT d.path, fan_in, fan_out, total, layer FROM d LEFT JOIN gfiles USING (path) ORDER BY total DESC, fan_in DESC, path LIMIT 10")
def hub_nodes(spark, sf):
    return graph.hubs(edges(spark, sf), gfiles(spark, sf))


@R.add("degree_centrality", f"WITH {_DEG} SELECT * FROM d")
def degree_centrality(spark, sf):
    return graph.degrees(edges(spark, sf))


def _seeds(spark, names):
    return spark.createDataFrame([(x,) for x in names], "node string")


def _back(e):
    return e.select(F.col("target").alias("source"), F.col("source").alias("target"))


_HUB = "(SELECT source FROM tops WHERE k = 1)"


def _all(r: str, start: str, forth: bool = True) -> str:
    """Everything that can be reached from `start`, with the depth."""
    a, b = ("source", "target") if forth else ("target", "source")
    return f"{r}(node, depth) USING KEY (node) AS ({start} UNION SELECT l.{b}, min({r}.depth) + 1 FROM {r} JOIN links l ON l.{a} = {r}.node LEFT JOIN recurring.{r} x ON x.node = l.{b} WHERE x.node IS NULL GROUP BY l.{b})"


@R.add("find_path", f"""WITH p(node, d, path) USING KEY (node) AS (SELECT source, 0, [source] FROM tops WHERE k = 1 UNION SELECT l.target, p.d + 1, min(list_append(p.path, l.target)) FROM p JOIN links l ON l.source = p.node LEFT JOIN recurring.p x ON x.node = l.target WHERE x.node IS NULL GROUP BY l.target, p.d + 1)
  SELECT array_to_string(path, ' -> ') path, CAST(d AS BIGINT) "length" FROM p ORDER BY d DESC, node LIMIT 1""")
def find_path(spark, sf):
    """The way from the greatest hub to the node that is farthest from it."""
    e, hub = links(spark, sf), top_sources(spark, sf, 1)
    if not hub:
        return graph.shortest_path(e, "", "")
    far = graph.reach(e, _seeds(spark, hub)).orderBy(F.desc("depth"), "node").first()
    return graph.shortest_path(e, hub[0], far.node)


@R.add("traverse", """WITH f(seed, node, depth) AS (SELECT source, source, 0 FROM tops WHERE k <= 5 UNION SELECT seed, target, depth + 1 FROM f JOIN links ON node = source WHERE depth < 3), g(seed, node, depth) AS (SELECT source, source, 0 FROM tops WHERE k <= 5 UNION SELECT seed, source, depth + 1 FROM g JOIN links ON node = target WHERE depth < 3)
  SELECT 'callees' direction, seed, node, min(depth) depth FROM f GROUP BY ALL UNION ALL SELECT 'callers', seed, node, min(depth) FROM g GROUP BY ALL""")
def traverse(spark, sf):
    """Within three steps of each asked start, both ways."""
    e, s = links(spark, sf), _seeds(spark, top_sources(spark, sf, 5))
    one = lambda d, x: graph.reach(x, s, 3).select(F.lit(d).alias("direction"), "seed", "node", "depth")
    return one("callees", e).unionByName(one("callers", _back(e)))


@R.add("traverse_budget", f"""WITH r(node, depth) AS (SELECT source, 0 FROM tops WHERE k = 1 UNION SELECT target, depth + 1 FROM r JOIN links ON node = source WHERE depth < 3), m AS (SELECT node, min(depth) depth FROM r GROUP BY 1),
  t AS (SELECT *, 10 * row_number() OVER (ORDER BY depth, node) tokens FROM m) SELECT node, depth, tokens FROM t WHERE tokens <= 80""")
def traverse_budget(spark, sf):
    """Breadth-first nodes within a token budget: 10 a node, so no more rows than the budget allows are ever ordered."""
    r = graph.reach(links(spark, sf), _seeds(spark, top_sources(spark, sf, 1)), 3).select("node", "depth").orderBy("depth", "node").limit(80 // 10)
    return graph.numbered(r, ["depth", "node"], "k").select("node", "depth", (F.col("k") * 10).alias("tokens"))


@R.add("call_chain", f"""WITH f(node, depth) AS (SELECT source, 0 FROM tops WHERE k = 1 UNION SELECT target, depth + 1 FROM f JOIN links ON node = source WHERE depth < 2),
  g(node, depth) AS (SELECT source, 0 FROM tops WHERE k = 1 UNION SELECT source, depth + 1 FROM g JOIN links ON node = target WHERE depth < 2)
  SELECT 'callees' direction, node, min(depth) hops FROM f WHERE node <> {_HUB} GROUP BY 1, 2 UNION SELECT 'callers', node, min(depth) FROM g WHERE node <> {_HUB} GROUP BY 1, 2""")
def call_chain(spark, sf):
    """Callers and callees within two steps."""
    e, seed = links(spark, sf), _seeds(spark, top_sources(spark, sf, 1))
    one = lambda d, x: graph.reach(x, seed, 2).where("depth > 0").select(F.lit(d).alias("direction"), "node", F.col("depth").alias("hops"))
    return one("callees", e).unionByName(one("callers", _back(e)))


@R.add("reachability", """WITH r(seed, node, depth) USING KEY (seed, node) AS (SELECT source, source, 0 FROM tops WHERE k <= 20 UNION SELECT r.seed, l.target, min(r.depth) + 1 FROM r JOIN links l ON l.source = r.node LEFT JOIN recurring.r x ON x.seed = r.seed AND x.node = l.target WHERE x.node IS NULL GROUP BY 1, 2)
  SELECT seed, count(*) - 1 n_reached, max(depth) max_depth FROM r GROUP BY 1""")
def reachability(spark, sf):
    """How many nodes each asked start reaches at all, and how far the farthest is."""
    r = graph.reach(links(spark, sf), _seeds(spark, top_sources(spark, sf, 20)))
    return r.groupBy("seed").agg((F.count("*") - 1).alias("n_reached"), F.max("depth").alias("max_depth"))


_SUSPECT = "(SELECT target FROM links GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1)"


@R.add("anomaly", f"""WITH {_all('g', f'SELECT {_SUSPECT}, 0', False)}, {_all('f', f'SELECT {_SUSPECT}, 0')}
  SELECT node, coalesce(min(up), -1) upstream, coalesce(min(down), -1) downstream FROM (SELECT node, depth up, NULL down FROM g UNION ALL SELECT node, NULL, depth FROM f) WHERE node <> {_SUSPECT} GROUP BY 1""")
def anomaly(spark, sf):
    """Everything upstream and downstream of a suspect (what most lead to), with distances; -1 where there is no way."""
    e = links(spark, sf)
    who = [r.target for r in e.groupBy("target").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "target").limit(1).collect()]
    seed = _seeds(spark, who)
    up = graph.reach(_back(e), seed).select("node", F.col("depth").alias("upstream"))
    down = graph.reach(e, seed).select("node", F.col("depth").alias("downstream"))
    far = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return up.join(down, "node", "full_outer").where(~F.col("node").isin(*who)).select("node", far("upstream"), far("downstream"))


@R.add("safety_trace")
def safety_trace(spark, sf):
    """The ten shortest ways from the second hub to the third that do not pass the first."""
    tops = [*top_sources(spark, sf, 3), "", "", ""]
    return graph.avoiding_paths(links(spark, sf), [tops[1]], [tops[2]], avoid=[tops[0]])


@R.add("eval_coverage", f"""WITH s AS (SELECT path FROM nodes WHERE layer = (SELECT min(layer) FROM nodes)), {_all('r', 'SELECT path, 0 FROM s')}
  SELECT count(*) n_files, count(r.node) n_covered, round(100.0 * count(r.node) / count(*), 2) pct FROM nodes LEFT JOIN r ON node = path""")
def eval_coverage(spark, sf):
    """Share of nodes that the nodes of one type reach."""
    g = nodes(spark, sf)
    layer = g.agg(F.min("layer")).first()[0]
    s = g.where(F.col("layer") == F.lit(layer)).select(F.col("path").alias("node"))
    # All starts are one source here: which of them reaches a node does not matter.
    e = links(spark, sf).select("source", "target").unionByName(s.select(F.lit("\u0000").alias("source"), F.col("node").alias("target")))
    r = graph.reach(e, _seeds(spark, ["\u0000"])).select(F.col("node").alias("path")).withColumn("hit", F.lit(1))
    return g.select("path").join(r, "path", "left").agg(F.count("*").alias("n_files"), F.count("hit").alias("n_covered"), F.round(100.0 * F.count("hit") / F.count("*"), 2).alias("pct"))


@R.add("cycles", """WITH c(a, b, d) USING KEY (a, b) AS (SELECT source, target, 1 FROM links UNION SELECT c.a, l.target, min(c.d) + 1 FROM c JOIN links l ON l.source = c.b LEFT JOIN recurring.c x ON x.a = c.a AND x.b = l.target WHERE x.b IS NULL GROUP BY 1, 2),
  k AS (SELECT x.a node, min(x.b) component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY 1),
  n AS (SELECT component, count(*) n_nodes FROM k GROUP BY 1), e AS (SELECT a.component, count(*) n_edges FROM links JOIN k a ON a.node = source JOIN k b ON b.node = target WHERE a.component = b.component GROUP BY 1)
  SELECT n.component, n_nodes, n_edges, CAST(c.d AS BIGINT) "length" FROM n JOIN e USING (component) JOIN c ON c.a = n.component AND c.b = n.component""")
def cycles(spark, sf):
    return graph.cycle_sets(links(spark, sf))


@R.add("short_cycles", """WITH p(first, node, path, d) AS (SELECT source, target, [source, target], 2 FROM links WHERE target > source UNION ALL SELECT first, target, list_append(path, target), d + 1 FROM p JOIN links ON node = source WHERE d < 3 AND target > first AND NOT list_contains(path, target))
  SELECT array_to_string(path, ',') members, CAST(d AS BIGINT) "length" FROM p JOIN links ON node = source AND target = first""")
def short_cycles(spark, sf):
    """All elementary cycles of two or three nodes."""
    return graph.cycles(links(spark, sf), 3)


@R.add("dependency_phases", """WITH t(node, d) USING KEY (node) AS (SELECT a.source, 0 FROM links a WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.target = a.source) UNION SELECT l.target, max(t.d) + 1 FROM t JOIN links l ON l.source = t.node LEFT JOIN recurring.t x ON x.node = l.target WHERE x.node IS NULL AND NOT EXISTS (SELECT 1 FROM links o LEFT JOIN recurring.t y ON y.node = o.source WHERE o.target = l.target AND y.node IS NULL) GROUP BY 1)
  SELECT path, CAST(coalesce(d, (SELECT max(d) + 1 FROM t)) AS INTEGER) phase FROM nodes LEFT JOIN t ON t.node = path""")
def dependency_phases(spark, sf):
    return graph.topological_phases(links(spark, sf))


@R.add("bridge_nodes", """WITH v AS (SELECT path node FROM nodes), m AS (SELECT count(*) n, count(*) > 500 big, CASE WHEN count(*) > 500 THEN count(*) / CAST(100 AS DOUBLE) ELSE 1 END k FROM v), s AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY md5(node), node) r FROM v), m WHERE NOT big OR r <= 100),
  f(s, node, d, n) USING KEY (s, node) AS (SELECT node, node, 0, CAST(1 AS DOUBLE) FROM s UNION SELECT f.s, l.target, f.d + 1, sum(f.n) FROM f JOIN links l ON l.source = f.node LEFT JOIN recurring.f x ON x.s = f.s AND x.node = l.target WHERE x.node IS NULL GROUP BY 1, 2, 3),
  b(s, node, d, n, delta) AS (SELECT s, node, d, n, CAST(0 AS DOUBLE) FROM f WHERE d = (SELECT max(d) FROM f)
    UNION ALL SELECT f.s, f.node, f.d, f.n, coalesce(w.delta, 0) FROM f JOIN (SELECT min(d) - 1 d FROM b) mm ON f.d = mm.d LEFT JOIN (SELECT y.s, l.source node, sum(g.n / y.n * (1 + y.delta)) delta FROM b y JOIN links l ON l.target = y.node JOIN f g ON g.s = y.s AND g.node = l.source AND g.d = y.d - 1 GROUP BY 1, 2) w ON w.s = f.s AND w.node = f.node)
  SELECT * FROM (SELECT node path, round(sum(delta) * any_value(k) / ((any_value(m.n) - 1) * (any_value(m.n) - 2)), 6) betweenness, any_value(big) sampled FROM b, m WHERE d > 0 GROUP BY 1) WHERE betweenness > 0""")
def bridge_nodes(spark, sf):
    """Betweenness over the whole graph; above 500 nodes from 100 sources, by the digest of their names."""
    return graph.betweenness(links(spark, sf))


@R.add("communities")
def communities(spark, sf):
    return graph.communities(links(spark, sf), weight="n")


@R.add("community_modularity", """WITH s AS (SELECT source, target FROM links UNION SELECT target, source FROM links), j AS (SELECT a.layer ca, b.layer cb FROM s JOIN nodes a ON a.path = source JOIN nodes b ON b.path = target),
  p AS (SELECT ca, count(*) deg, count(*) FILTER (ca = cb) inside FROM j GROUP BY 1) SELECT round(sum(inside / (SELECT count(*) FROM s) - power(deg / (SELECT count(*) FROM s), 2)), 3) modularity, count(*) n_communities FROM p""")
def community_modularity(spark, sf):
    """Modularity of the entity types as communities."""
    return graph.modularity(links(spark, sf), nodes(spark, sf).select("path", F.col("layer").alias("community")))


@R.add("community_cohesion", """WITH s AS (SELECT source, target FROM links UNION SELECT target, source FROM links), p AS (SELECT a.layer community, count(*) FILTER (a.layer = b.layer) // 2 inside, count(*) FILTER (a.layer <> b.layer) across FROM s JOIN nodes a ON a.path = source JOIN nodes b ON b.path = target GROUP BY 1)
  SELECT community, n_files, inside, across, round(inside / greatest(inside + across, 1), 2) cohesion FROM p JOIN (SELECT layer community, count(*) n_files FROM nodes GROUP BY 1) USING (community)""")
def community_cohesion(spark, sf):
    """How much of each type's edges stay within it."""
    return graph.cohesion(links(spark, sf), nodes(spark, sf).select("path", F.col("layer").alias("community")))


@R.add("connected_components", """WITH u AS (SELECT source, target FROM links UNION SELECT target, source FROM links), r(node, component) USING KEY (node) AS (SELECT path, path FROM nodes UNION SELECT u.target, min(r.component) FROM r JOIN u ON u.source = r.node JOIN recurring.r x ON x.node = u.target WHERE r.component < x.component GROUP BY 1)
  SELECT node, component FROM r""")
def connected_components(spark, sf):
    from codestrata.operators.components import connected_components as cc

    return cc(links(spark, sf), "source", "target")


@R.add("type_peers", "SELECT a.repo_id, a.return_type, a.fn_id, count(*) - 1 n_peers FROM functions a JOIN functions b ON a.repo_id = b.repo_id AND a.return_type = b.return_type GROUP BY ALL")
def type_peers(spark, sf):
    """Functions by return type: the type is kept as a group key, the quadratic pairs are never built."""
    from pyspark.sql import Window as W

    f = functions(spark, sf).where("return_type is not null")
    n = f.groupBy("repo_id", "return_type").agg((F.count("*") - 1).alias("n_peers"))
    return f.select("repo_id", "return_type", "fn_id").join(n, ["repo_id", "return_type"])


@R.add("type_propagation", """WITH t AS (SELECT repo_id, return_type, count(*) n_functions, count(DISTINCT file) n_files FROM functions WHERE return_type IS NOT NULL GROUP BY 1, 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n_functions DESC, return_type) rank FROM t) WHERE rank <= 10""")
def type_propagation(spark, sf):
    """The ten most common return types of each repository."""
    from pyspark.sql import Window as W

    t = functions(spark, sf).where("return_type is not null").groupBy("repo_id", "return_type").agg(F.count("*").alias("n_functions"), F.countDistinct("file").alias("n_files"))
    w = W.partitionBy("repo_id").orderBy(F.desc("n_functions"), "return_type")
    return t.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")


@R.add("exec_flow", f"""WITH p(node, parent, depth) AS (SELECT source, CAST(NULL AS VARCHAR), 0 FROM tops WHERE k = 1 UNION SELECT target, node, depth + 1 FROM p JOIN links ON node = source WHERE depth < 3),
  m AS (SELECT node, min(depth) depth FROM p GROUP BY 1), q AS (SELECT m.node, min(parent) parent, m.depth FROM m JOIN p ON p.node = m.node AND p.depth = m.depth GROUP BY m.node, m.depth)
  SELECT node, parent, depth, row_number() OVER (ORDER BY depth, node) step FROM q""")
def exec_flow(spark, sf):
    """Steps of a flow from an entry point: breadth-first order over three levels, with the least parent one step before."""
    e = links(spark, sf)
    r = graph.reach(e, _seeds(spark, top_sources(spark, sf, 1)), 3).select("node", "depth")
    par = r.withColumnRenamed("node", "parent").withColumnRenamed("depth", "pd").join(graph.adjacency(e).select(F.col("source").alias("parent"), F.col("target").alias("node")), "parent")
    j = r.join(par, "node", "left").where("pd is null or depth = 0 or pd = depth - 1").groupBy("node", "depth").agg(F.min(F.when(F.col("depth") > 0, F.col("parent"))).alias("parent"))
    return graph.numbered(j, ["depth", "node"]).select("node", "parent", "depth", "step")


_NEAR = f"near AS (SELECT {_HUB} node UNION SELECT target FROM links WHERE source = {_HUB} UNION SELECT source FROM links WHERE target = {_HUB}), ge AS (SELECT DISTINCT source, target FROM links JOIN near a ON a.node = source JOIN near b ON b.node = target)"


@R.add("function_graph", f"""WITH {_NEAR} SELECT 'dot' format, '"' || source || '" -> "' || target || '"' AS line FROM ge UNION ALL SELECT 'mermaid', source || ' --> ' || target FROM ge UNION ALL SELECT 'json', '{{"source":"' || source || '","target":"' || target || '"}}' FROM ge""")
def function_graph(spark, sf):
    """Lines of the neighbourhood of a node, both ways, as DOT, Mermaid and JSON."""
    e, seed = links(spark, sf), _seeds(spark, top_sources(spark, sf, 1))
    near = graph.reach(e, seed, 1).select("node").unionByName(graph.reach(_back(e), seed, 1).select("node")).dropDuplicates()
    j = e.join(near.withColumnRenamed("node", "source"), "source", "left_semi").join(near.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target").dropDuplicates()
    forms = {"dot": F.format_string('"%s" -> "%s"', "source", "target"), "mermaid": F.concat("source", F.lit(" --> "), "target"), "json": F.to_json(F.struct("source", "target"))}
    return j.select(F.explode(F.array(*[F.struct(F.lit(k).alias("format"), v.alias("line")) for k, v in forms.items()])).alias("x")).select("x.format", "x.line")


@R.add("process_trace", "WITH r(process, node, depth) AS (SELECT source, source, 0 FROM tops WHERE k <= 5 UNION SELECT process, target, depth + 1 FROM r JOIN links ON node = source WHERE depth < 8) SELECT process, count(DISTINCT node) n_files, max(d) max_depth FROM (SELECT process, node, min(depth) d FROM r GROUP BY 1, 2) GROUP BY 1")
def process_trace(spark, sf):
    """Files and depth of the process that begins at each entry, eight levels deep."""
    r = graph.reach(links(spark, sf), _seeds(spark, top_sources(spark, sf, 5)), 8)
    return r.groupBy(F.col("seed").alias("process")).agg(F.count("*").alias("n_files"), F.max("depth").alias("max_depth"))


@R.add("graph_query", "SELECT source, count(*) n FROM links GROUP BY 1")
def graph_query(spark, sf):
    """A read-only SQL text over the graph."""
    from codestrata.operators.guard import guarded_sql

    links(spark, sf).createOrReplaceTempView("codestrata_edges")
    return guarded_sql(spark, "SELECT source, count(*) AS n FROM codestrata_edges GROUP BY source")


