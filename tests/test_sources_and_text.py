import json

from pyspark.sql import functions as F

from codestrata.functions import scalar as S
from codestrata.operators import diffs as D, exports as X, lines as L, search as Q
from codestrata.operators.similarity import lcs_ratio
from codestrata.sources import readers as R


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(c).first()[0]


def test_scalars(spark):
    assert one(spark, S.round_half_up(F.col("x")), x=-2.5) == -2 and one(spark, S.round_half_up(F.col("x"), 1), x=0.25) == 0.3
    assert one(spark, S.score_grade(F.col("x")), x=80) == "B" and one(spark, S.complexity_grade(F.col("x")), x=30) == "D"
    assert one(spark, S.layer_of(F.col("p")), p="src/api/x.ts") == "services" and one(spark, S.is_test(F.col("p")), p="a/test_x.py")
    assert one(spark, S.snake_plural(F.col("p")), p="UserAccount") == "user_accounts"
    assert one(spark, S.nesting_depth(F.col("p")), p="{ { } { { } } }") == 3 and one(spark, S.nesting_depth(F.col("p")), p="") == 0
    assert one(spark, S.xml_text(F.col("p")), p='a<"&') == "a&lt;&quot;&amp;"


def test_chunking_and_html():
    assert R.chunk("hello world") == ["hello world"] and R.chunk("") == [] and R.chunk(None) == []
    parts = R.chunk("\n\n".join(["a" * 2000] * 3), 200)
    assert len(parts) > 1 and all(len(p) <= 1300 for p in parts)
    assert R.html_text("<title>T</title><style>x</style><p>a &amp; b &lt; c &#65;</p><script>1</script>") == ("T", "a & b < c A")


def test_reports(spark):
    d = spark.createDataFrame(list(enumerate(["SF:a", "DA:1,1", "DA:2,0"])), "line_no int, line string")
    assert [tuple(r) for r in R.lcov(d).collect()] == [("a", 2, 1, 50.0)]
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["x=1\n", "y"], "execution_count": 2, "outputs": [{}]}, {"cell_type": "markdown", "source": ["t"]}, {"cell_type": "code", "source": ["z"], "execution_count": 1, "outputs": []}]})
    r = R.notebook_cells(spark.createDataFrame([("n.ipynb", nb)], "path string, content string")).first()
    assert (r.content, r.n_code_cells, r.has_output, r.unordered) == ("x=1\ny\nz", 2, True, True)
    assert R.parse_unified_diff("--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@\n+a\n") == [("x", 3, 6)]
    assert R.parse_source("https://github.com/o/r.git") == {"type": "github", "owner": "o", "repo": "r"} and R.parse_source("./x")["type"] == "local"
    ep = R.openapi_endpoints(spark.createDataFrame([('{"paths":{"/a":{"get":{},"x-y":{}}}}',)], "content string")).collect()
    assert [tuple(x) for x in ep] == [("GET", "/a")]


def test_scan_directory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x\ny")
    (tmp_path / "src" / ".hidden").write_text("x")
    (tmp_path / "node_modules" / "b.js").write_text("x")
    assert [(r.path, r.lines, r.is_code) for r in R.scan_directory(spark, str(tmp_path)).collect()] == [("src/a.py", 2, True)]


def test_line_scans(spark):
    f = spark.createDataFrame([(1, "a.ts", "const x = process.env.API_KEY;\nbus.emit('saved')\nbus.on('saved', f)"), (2, "b.ts", None), (3, "c.ts", "")], "file_id int, path string, content string")
    assert [(r.line_no, r.name) for r in L.scan(f, ["file_id"], L.ENV_READS).collect()] == [(1, "API_KEY")]
    assert [(r.line_no, r.name) for r in L.scan(f, ["file_id"], L.EVENT_SUBSCRIBES).collect()] == [(3, "saved")]
    p = spark.createDataFrame([(1, "for (const a of b) {\n  const r = await db.find(a);\n}\ndb.find(1);\nfs.readFileSync('x');")], "file_id int, content string")
    assert {(r.line_no, r.pattern) for r in L.loop_findings(p, ["file_id"]).collect()} == {(2, "n+1"), (5, "sync-io")}


def test_similarity():
    assert lcs_ratio("abc", "abc") == 1.0 and lcs_ratio(None, "x") == 0.0 and abs(lcs_ratio("abcdef", "abxdef") - 5 / 6) < 1e-9
    assert lcs_ratio("x = 1  # c", "x = 22") == 1.0


def test_diffs(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 1), ("z", None)], "k string, v int"), spark.createDataFrame([("y", 2), ("w", 1), ("z", None)], "k string, v int")
    assert {tuple(r) for r in D.states(a, b, ["k"], "v").collect()} == {("x", "only_old"), ("y", "diverged"), ("z", "identical"), ("w", "only_new")}
    assert one(spark, D.semver_verdict(F.col("r"), F.col("a"), F.col("b")), r=1, a=0, b="minor") == "breach" and one(spark, D.drift_level(F.col("h"), F.lit(0), F.lit(0)), h=-6) == "DEGRADED"


def test_search(spark):
    d = spark.createDataFrame([(1, "cache cache x"), (2, "cache y z w"), (3, None), (4, "other")], "id int, text string")
    assert [r.key for r in Q.bm25(d, "id", "text", ["Cache"]).collect()] == [1, 2]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id int, v array<double>")
    assert [(r.key, r.score) for r in Q.nearest(v, "id", "v", [1.0, 0.0], 2).collect()] == [(1, 1.0), (2, 0.0)]
    assert Q.fuse([Q.bm25(d, "id", "text", ["cache"]), Q.nearest(v, "id", "v", [1.0, 0.0], 2)]).first().key == 1


def test_exports(spark, tmp_path):
    e = spark.createDataFrame([('a"b', "c<d", "f", 2)], "source string, target string, fn string, count long")
    for fmt in X.FORMATS:
        t = "\n".join(r.line for r in X.export_graph(e, fmt).orderBy("ord", "line").collect())
        assert "c" in t and (fmt not in ("graphml", "gexf") or "c&lt;d" in t)
    X.write_lines(X.export_graph(e, "dot"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 5
    s = X.sarif(spark.createDataFrame([("p", 3, "high:SQL Injection Risk")], "path string, line_no int, tag string")).first()[0]
    assert json.loads(s)["ruleId"] == "sql-injection-risk" and json.loads(s)["level"] == "error"
    assert "#4c1" in X.badge("health", "A")
