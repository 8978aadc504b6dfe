import random

import pytest

from codestrata.operators import graph as G, metrics as M
from codestrata.operators.classes import linearize
from codestrata.operators.components import connected_components
from codestrata.operators.guard import guarded_sql, is_read_only


def edges(spark, pairs, count=1):
    return spark.createDataFrame([(a, b, "f", count) for a, b in pairs], "source string, target string, fn string, count long")


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, layer string")


def test_hub(spark):
    e = edges(spark, [("a", "c"), ("b", "c"), ("d", "c"), ("c", "a")])
    top = G.hubs(e, files(spark, [("a", "x"), ("c", "util")])).first()
    assert (top.path, top.fan_in, top.fan_out, top.total, top.layer) == ("c", 3, 1, 4, "util")
    assert G.degrees(edges(spark, [])).count() == 0


def test_bridge(spark):
    e = edges(spark, [(x, "bridge") for x in "abc"] + [("bridge", x) for x in "xyz"])
    got = G.betweenness(e).collect()
    assert [(r.path, r.betweenness, r.sampled) for r in got] == [("bridge", 0.3, False)]
    assert G.betweenness(edges(spark, [("a", "b")])).count() == 0


def test_rare_pair(spark):
    f = files(spark, [("c1", "controller"), ("s1", "service"), ("d1", "database"), ("a1", "audit")])
    e = edges(spark, [("c1", "s1")] * 4 + [("s1", "d1")] * 2 + [("c1", "a1")])
    r = M.rare_connections(f, e).orderBy("pair_count").first()
    assert (r.source_layer, r.target_layer, r.pair_count, r.rarity) == ("controller", "audit", 1, 85.7)


def test_gaps(spark):
    names = [f"src/{x}.ts" for x in "abcdef"]
    f = files(spark, [(n, "core") for n in names] + [("src/hub.ts", "core"), ("src/thin.ts", "thinlayer"), ("src/orphan.ts", "core")])
    e = edges(spark, [(n, "src/hub.ts") for n in names] + [("src/thin.ts", n) for n in names])
    got = {(r.kind, r.item) for r in M.knowledge_gaps(f, e).collect()}
    assert got == {("isolated", "src/orphan.ts"), ("untested_hotspot", "src/hub.ts"), ("weak_layer", "thinlayer")}


def test_paths_cycles_phases(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a")])
    assert G.shortest_path(e, "a", "d").first().path == "a -> b -> c -> d"
    assert G.shortest_path(e, "d", "a").count() == 0
    assert [tuple(r) for r in G.cycles(e).collect()] == [("a,b,c", 3)]
    p = {r.path: r.phase for r in G.topological_phases(edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])).collect()}
    assert p == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_reach_and_components_against_brute_force(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)]
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
    want = set()
    for s in adj:
        seen, front = {s}, [s]
        while front:
            front = [y for x in front for y in adj.get(x, ()) if y not in seen and not seen.add(y)]
        want |= {(s, x) for x in seen}
    seeds = spark.createDataFrame([(s,) for s in adj], "node string")
    assert {(r.seed, r.node) for r in G.reach(edges(spark, pairs), seeds, 40).collect()} == want
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_communities_split_cliques(spark):
    c = lambda s: [(a, b) for a in s for b in s if a < b]
    e = edges(spark, c("abcd") + c("wxyz") + [("d", "w")])
    got = {r.path: r.community for r in G.communities(e).collect()}
    assert len({got[x] for x in "abc"}) == 1 and got["a"] != got["z"]


def test_c3_order(spark):
    d = spark.createDataFrame([("r", "A", [], ["f"]), ("r", "B", ["A"], ["f"]), ("r", "C", ["A"], []), ("r", "D", ["B", "C"], ["f"])], "repo_id string, name string, bases array<string>, methods array<string>")
    r = {x.name: x for x in linearize(d).collect()}
    assert r["D"].linearization == ["D", "B", "C", "A"] and r["D"].overridden == ["f"]


def test_guard(spark):
    assert is_read_only("SELECT 'drop table x' AS s") and not is_read_only("DROP TABLE x") and not is_read_only("select 1; delete from t")
    with pytest.raises(ValueError):
        guarded_sql(spark, "INSERT INTO t VALUES (1)")


def test_dead_functions_and_confidence(spark):
    f = spark.createDataFrame([(1, "r", "a.py", "used", 1, True, False, False, []), (2, "r", "a.py", "dead", 2, True, False, False, []), (3, "r", "a.py", "main", 3, True, False, False, []), (4, "r", "a.py", "deco", 4, True, False, False, ["x"])], "fn_id long, repo_id string, file string, name string, line int, is_top_level boolean, is_exported boolean, is_class_method boolean, decorators array<string>")
    assert [r.name for r in M.dead_functions(f, spark.createDataFrame([("r", "used")], "repo_id string, name string")).collect()] == ["dead"]
    e = edges(spark, [("p/a", "p/b")]).unionByName(edges(spark, [("p/a", "q/c")], 5)).unionByName(edges(spark, [("p/a", "q/d")]))
    got = {r.target: r.confidence for r in M.confidence(None, e, edges(spark, [("p/a", "q/d")])).collect()}
    assert got == {"p/b": 0.8, "q/c": 0.6, "q/d": 1.0}


def test_long_chains_have_no_bound(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(9)]
    e = edges(spark, chain)
    assert G.shortest_path(e, "n000", "n009").first().length == 9
    assert G.reach(e, spark.createDataFrame([("n000",)], "node string")).count() == 10
    assert {r.phase for r in G.topological_phases(e).collect()} == set(range(10))
    ring = edges(spark, [*chain, ("n009", "n000"), ("x", "n000"), ("n005", "y")])
    assert [tuple(r) for r in G.cycle_sets(ring).select("component", "n_nodes", "n_edges", "length").collect()] == [("n000", 10, 10, 10)]
    assert G.cycle_sets(e).count() == 0


def test_strong_components_and_betweenness_against_brute_force(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(55)})
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})

    def levels(s):
        dist, ways, front = {s: 0}, {s: 1.0}, [s]
        while front:
            nxt = []
            for x in front:
                for y in adj.get(x, ()):
                    if y not in dist:
                        dist[y], ways[y] = dist[x] + 1, 0.0
                        nxt.append(y)
                    if dist[y] == dist[x] + 1:
                        ways[y] += ways[x]
            front = nxt
        return dist, ways

    all_ = {s: levels(s) for s in nodes}
    mutual = {}
    for a in nodes:
        own = frozenset(b for b in nodes if b in all_[a][0] and a in all_[b][0])
        if len(own) > 1:
            mutual[a] = own
    e = edges(spark, pairs)
    got = {}
    for r in G.strong_components(e).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(v) for v in got.values()} == set(mutual.values())
    n, want = len(nodes), dict.fromkeys(nodes, 0.0)
    for s in nodes:
        d, w = all_[s]
        for t in d:
            for v in d:
                if v not in (s, t) and t in all_[v][0] and d[v] + all_[v][0][t] == d[t]:
                    want[v] += w[v] * all_[v][1][t] / w[t]
    got = {r.path: r.betweenness for r in G.betweenness(e).collect()}
    assert got == {v: pytest.approx(x / ((n - 1) * (n - 2)), abs=2e-6) for v, x in want.items() if x / ((n - 1) * (n - 2)) >= 5e-7}


def test_paths_that_avoid_gates(spark):
    e = edges(spark, [("in", "gate"), ("gate", "out"), ("in", "a"), ("a", "b"), ("b", "out"), ("a", "out"), ("b", "a"), ("c", "out"), ("in", "dead")])
    assert [tuple(r) for r in G.avoiding_paths(e, ["in"], ["out"], ["gate"], 4).collect()] == [("in -> a -> out", 2), ("in -> a -> b -> out", 3)]
    assert G.avoiding_paths(e, ["in"], ["gate"], ["gate"], 2).count() == 0


def test_numbers_in_order(spark):
    rows = [(k * 37 % 101, f"x{k % 7}") for k in range(101)]
    got = G.numbered(spark.createDataFrame(rows, "a int, b string"), ["a", "b"]).collect()
    assert [r.step for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(1, 102))


def test_communities_raise_modularity(spark):
    rng = random.Random(2)
    pairs = [(f"{g}{a}", f"{g}{b}") for g in "pqrs" for a in range(12) for b in range(12) if a < b and rng.random() < 0.5] + [(f"{rng.choice('pqrs')}{rng.randrange(12)}", f"{rng.choice('pqrs')}{rng.randrange(12)}") for _ in range(12)]
    e = edges(spark, pairs)
    c = G.communities(e)
    assert G.modularity(e, c).first().modularity > 0.5
    assert G.cohesion(e, c).agg({"cohesion": "min"}).first()[0] > 0.5
    assert G.communities(e.limit(0)).count() == 0
