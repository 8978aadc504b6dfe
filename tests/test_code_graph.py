import datetime as dt

import pytest
from pyspark.sql import functions as F

from codestrata.functions import security as V
from codestrata.operators import extract as E, propgraph as P
from codestrata.sources import history as H

TEXTS = {
    "a.py": "import os\nfrom .b import c\nclass A(Base):\n    async def f(self):\n        pass\n\ndef g(x):\n    return x\n",
    "b.ts": "import { x } from './y';\nexport const h = async (a: number) => a;\nexport default function k() {}\nexport class B<T> extends lib.A { }\n",
    "c.java": "import java.util.List;\npackage q;\npublic class C extends D {\n  public static int m(int a) {\n    if (a > 0) {\n    return n(a);\n  }\n}\n",
    "d.go": 'package d\n\nimport (\n\t"fmt"\n\tx "example.org/y"\n)\n\ntype T struct {\n}\n\nfunc (t *T) Get(a int) int {\n\treturn 1\n}\nfunc Put() {}\n',
    "e.c": "#include <stdio.h>\nstatic int add(int a, int b) {\n  return a + b;\n}\nint proto(int);\nstruct node {\n};\n",
    "f.rs": "use std::fmt;\npub fn run() {}\npub struct S;\n", "g.rb": "class R < Q\n  def self.z\n  end\nend\n", "h.php": "class P extends O {\n  public function w() {}\n}\n", "i.kt": "class K : L() {\n  private fun v() {}\n}\n",
    "j.swift": "public class U: V {\n  func t() {}\n}\n", "k.scala": "object N\nclass X extends Y\n  def s() = 1\n", "l.lua": "local function lu() end\n", "m.pl": "package Pk;\nsub pe { }\n", "n.ex": "defmodule M.N do\n  defp el(a) do\n", "o.sh": "start() {\n}\n",
    "p.cs": "public class Cs : Ba {\n  public async Task<int> Do(int a)\n", "q.cpp": "class Cp : public Cb {\n};\nint go(int a) {\n", "r.dart": "class Da extends Db {}\nint di(int a) {\n", "s.jsx": "function Jx() {}\n", "t.md": "def no(): pass\n", "u.py": None, "v.py": "",
}


def files(spark, texts=TEXTS):
    rows = [(k, "r", p, t) for k, (p, t) in enumerate(texts.items())]
    return spark.createDataFrame([*rows, *rows[:1]], "file_id int, repo_id string, path string, content string").withColumn("line", F.lit(0)).withColumn("name", F.lit("x"))


def test_definitions_of_nineteen_languages(spark):
    d = E.definitions(files(spark)).collect()
    got = {(r.path, r.kind, r.name) for r in d}
    fns = {("a.py", "f"), ("a.py", "g"), ("b.ts", "h"), ("b.ts", "k"), ("c.java", "m"), ("d.go", "Get"), ("d.go", "Put"), ("e.c", "add"), ("f.rs", "run"), ("g.rb", "z"), ("h.php", "w"), ("i.kt", "v"), ("j.swift", "t"), ("k.scala", "s"), ("l.lua", "lu"), ("m.pl", "pe"), ("n.ex", "el"), ("o.sh", "start"), ("p.cs", "Do"), ("q.cpp", "go"), ("r.dart", "di"), ("s.jsx", "Jx")}
    assert {(p, n) for p, k, n in got if k == "function"} == fns and len(d) == len(got) and len(E.LANGUAGES) == 19
    bases = {(r.path, r.name): r.base for r in d if r.kind == "class"}
    assert bases["a.py", "A"] == "Base" and bases["b.ts", "B"] == "lib.A" and bases["c.java", "C"] == "D" and bases["g.rb", "R"] == "Q" and bases["d.go", "T"] is None and bases["q.cpp", "Cp"] == "Cb"
    i = {(r.path, r.spec): r.is_std for r in E.imports(files(spark)).collect()}
    assert i == {("a.py", "os"): False, ("a.py", ".b"): False, ("b.ts", "./y"): False, ("c.java", "java.util.List"): True, ("d.go", "fmt"): True, ("d.go", "example.org/y"): False, ("e.c", "stdio.h"): False, ("f.rs", "std::fmt"): True}


FN = "fn_id long, repo_id string, file string, name string, line int, code string, is_class_method boolean"
FUNCS = [(1, "r", "src/user.ts", "getUser", 2, "x", False), (2, "r", "src/auth.ts", "login", 3, "getUser(); new Session(a)", False), (3, "r", "src/auth.ts", "helper", 20, "x", False), (4, "r", "lib/other.ts", "lonely", 1, "x", False), (5, "r", "src/auth.ts", "constructor", 11, "x", True), (6, "r", "src/auth.ts", "open", 12, "x", True), (7, "r", "lib/z.ts", "twice", 1, "x", False), (8, "r", "lib/y.ts", "twice", 1, "x", False)]


def test_property_graph(spark):
    fn = spark.createDataFrame(FUNCS, FN)
    f = spark.createDataFrame(
        [("r", "src/auth.ts", ["./user", "express", "../../out"], "login getUser"), ("r", "src/user.ts", ["../lib"], ""), ("r", "lib/index.ts", [], ""), ("r", "src/auth.test.ts", ["./auth"], "it('logs in', () => login())"), ("r", "pkg/m/a.py", [".b", "..c.d", "os"], ""), ("r", "pkg/m/b.py", None, ""), ("r", "pkg/c/d/__init__.py", None, "")],
        "repo_id string, path string, imports array<string>, content string",
    )
    i = P.import_edges(f)
    assert {(r.source, r.target) for r in i.collect()} == {("src/auth.ts", "src/user.ts"), ("src/user.ts", "lib/index.ts"), ("src/auth.test.ts", "src/auth.ts"), ("pkg/m/a.py", "pkg/m/b.py"), ("pkg/m/a.py", "pkg/c/d/__init__.py")}
    called = spark.createDataFrame([("r", "src/auth.ts", n, 1) for n in ("getUser", "helper", "lonely", "twice", "unknown")], "repo_id string, path string, fn string, count long")
    assert {(r.fn, r.target, r.confidence) for r in P.calls(called, fn, i).collect()} == {("helper", "src/auth.ts", 0.95), ("getUser", "src/user.ts", 0.9), ("lonely", "lib/other.ts", 0.5)}
    cls = spark.createDataFrame([("r", "src/auth.ts", "Session", "m.Base", 10), ("r", "lib/b.ts", "Base", None, 1), ("r", "lib/c.ts", "Base", "Base", 1)], "repo_id string, path string, name string, base string, line int")
    assert [tuple(x) for x in P.extends(cls, i).select("name", "base", "confidence").collect()] == [("Session", "Base", 0.9)]
    assert {(r.fn_id, r.class_name, r.kind) for r in P.members(fn, cls).collect()} == {(5, "Session", "constructor"), (6, "Session", "method")}
    assert [tuple(x) for x in P.constructor_queries(fn, cls).collect()] == [(2, "Session")]
    hits = spark.createDataFrame([("r", "src/auth.ts", 5, "users"), ("r", "src/auth.ts", 99, "late"), ("r", "src/auth.ts", 1, "early")], "repo_id string, path string, line_no int, name string")
    assert [tuple(x) for x in P.orm_queries(fn, hits).collect()] == [(2, "users", 5)]
    t, c = P.test_edges(f, fn, i)
    assert [(r.source, r.target) for r in t.collect()] == [("src/auth.test.ts", "src/auth.ts")] and [r.fn_id for r in c.collect()] == [2]
    assert P.defines(fn).count() == 8 and P.import_edges(f.limit(0)).count() == 0 and P.members(fn.limit(0), cls).count() == 0


def test_cypher(spark):
    n = spark.createDataFrame([("a", "File", "a.ts", 3), ("b", "File", "b.ts", 5), ("c", "Fn", "c", None), ("d", "Fn", "it's", 1)], "id string, label string, name string, size int")
    e = spark.createDataFrame([("a", "b", "IMPORTS"), ("a", "c", "DEFINES"), ("b", "d", "DEFINES"), ("c", "d", "CALLS"), ("d", "c", "CALLS")], "source string, target string, type string")
    q = lambda t: [tuple(r) for r in P.cypher(t, n, e).collect()]
    assert q("MATCH (f:File) RETURN f.name AS name ORDER BY name") == [("a.ts",), ("b.ts",)]
    assert q("MATCH (f:File)-[:DEFINES]->(g) RETURN f.id, g.id ORDER BY f.id") == [("a", "c"), ("b", "d")]
    assert q("match (g)<-[:DEFINES]-(f {name: 'a.ts'}) return g.id as g") == [("c",)]
    assert sorted(q("MATCH (x)-[r:CALLS*1..3]->(y) WHERE x.id = 'c' RETURN y.id AS y, r.hops AS h, r.walks AS w")) == [("c", 2, 1), ("d", 1, 1), ("d", 3, 1)]
    assert q("MATCH (a)-[:IMPORTS|DEFINES]-(b) RETURN count(*) AS n, count(DISTINCT a.id) AS k") == [(6, 4)]
    assert q("MATCH (a:Fn) WHERE a.size IS NULL RETURN a") == [("c",)]
    assert q("MATCH (a:File)-[]->(b:File) WHERE b.size > a.size AND NOT a.name ENDS WITH 'x' RETURN DISTINCT a.name LIMIT 5") == [("a.ts",)]
    assert q("MATCH (n) RETURN n.label AS l, avg(n.size) AS m ORDER BY l DESC") == [("Fn", 1.0), ("File", 4.0)]
    for bad in ("CREATE (n) RETURN n", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n) RETURN n.nothing", "MATCH (a)-[]->(b)-[]->(c) RETURN a", "MATCH (n) WHERE n.id = 'a' OR n.id = 'b' RETURN n.id"):
        with pytest.raises(P.CypherError):
            P.cypher(bad, n, e)


def test_history(spark):
    log = ["s1\u0002ann\u00022024-01-02T00:00:00Z\u0002\n3\t1\ta.py\n-\t-\tb.png", "s2\u0002bob\u00022024-01-03T00:00:00Z\u0002s1\n1\t0\ta.py", "s3\u0002bob\u00022024-01-04T00:00:00Z\u0002s1 s2\n1\t0\ta.py", "s4\u0002ann\u00022024-01-05T00:00:00Z\u0002s3"]
    c = H.parse_git_log(spark.createDataFrame([(x,) for x in log], "record string"))
    assert {(r.sha, r.path, r.added, r.parents) for r in c.collect()} == {("s1", "a.py", 3, 0), ("s1", "b.png", 0, 0), ("s2", "a.py", 1, 1), ("s3", "a.py", 1, 2)}
    assert {tuple(r) for r in H.churn(c).collect()} == {("a.py", 2), ("b.png", 1)}
    assert {(r.path, r.top_contributor, r.contributor_count) for r in H.ownership(c).collect()} == {("a.py", "bob", 2), ("b.png", "ann", 1)}
    t = H.timeline(c, 2).orderBy("date").collect()
    assert [(r.sha, r.n_files, r.added) for r in t] == [("s2", 1, 1), ("s3", 1, 1)] and t[0].date == dt.datetime(2024, 1, 3)
    f = spark.createDataFrame([("r", "package.json"), ("r", "packages/a/package.json"), ("r", "packages/a/src/x.ts"), ("r", "packages/a/src/go.mod"), ("r", "y.ts"), ("q", "services/z/w.py")], "repo_id string, path string")
    got = {(r.repo_id, r.path): r.workspace for r in H.file_workspace(f, H.workspaces(f)).collect()}
    assert got["r", "packages/a/src/x.ts"] == "packages/a/src" and got["r", "packages/a/package.json"] == "packages/a" and got["r", "y.ts"] is None and got["q", "services/z/w.py"] == "services/z"
    i = spark.createDataFrame([("app/x.ts", "@/u/v"), ("app/x.ts", "@lib"), ("x.ts", "@/q"), ("x.ts", "react")], "source string, spec string")
    p = spark.createDataFrame([("", 0, "@/*", "src/*"), ("app", 0, "@/*", "code/*"), ("", 1, "@lib", "lib/index")], "folder string, ord int, pattern string, target string")
    assert {(r.source, r.spec, r.target) for r in H.resolve_aliases(i, p).collect()} == {("app/x.ts", "@/u/v", "app/code/u/v"), ("app/x.ts", "@lib", "lib/index"), ("x.ts", "@/q", "src/q")}


def test_scores_and_codec(spark):
    known = {"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1, "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H": 7.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N": 0.0, "nonsense": None}
    d = spark.createDataFrame([(k,) for k in known], "v string").select("v", V.cvss_score(F.col("v")).alias("s"))
    assert {r.v: r.s for r in d.collect()} == known
    assert {r.s: r.x for r in d.select("s", V.cvss_severity(F.col("s")).alias("x")).collect()} == {9.8: "critical", 6.1: "medium", 7.8: "high", 10.0: "critical", 0.0: "low", None: None}
    v = spark.createDataFrame([([1.5, -2.25],), ([],), (None,)], "e array<float>").select("e", V.floats_to_bytes("e").alias("b"))
    assert [(list(r.e) if r.e is not None else None, len(r.b) if r.b is not None else None) for r in v.collect()] == [([1.5, -2.25], 8), ([], 0), (None, None)]
    assert v.select(V.bytes_to_floats("b").eqNullSafe(F.col("e")).alias("x")).where("not x").count() == 0
