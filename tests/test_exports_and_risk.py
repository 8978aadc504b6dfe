import json
from xml.etree import ElementTree

import pytest

from codestrata.operators import diffs as D, exports as X, metrics as M
from codestrata.session import durable
from codestrata.sources import readers
from codestrata.streaming import traces as T

NAMES = [("src/a b.ts", 'we"ird<&>.ts', 3), ("src/a b.ts", "x[1].ts", 1), ("x[1].ts", 'we"ird<&>.ts', 2)]


def text(spark, fmt, edges=NAMES, top=None):
    d = X.export_graph(spark.createDataFrame([(a, b, "f", n) for a, b, n in edges], "source string, target string, fn string, count long"), fmt, top)
    return "\n".join(r.line for r in d.orderBy("ord", "line").collect())


@pytest.mark.parametrize(("fmt", "nodes", "edges"), [("graphml", "node", "edge"), ("gexf", "node", "edge"), ("dgml", "Node", "Link")])
def test_xml_exports_are_read_back(spark, fmt, nodes, edges):
    root = ElementTree.fromstring(text(spark, fmt))
    tags = [e.tag.split("}")[1] for e in root.iter()]
    assert (tags.count(nodes), tags.count(edges)) == (3, 3)
    ids = {e.get("id") or e.get("Id") for e in root.iter() if e.tag.endswith(nodes)}
    assert ids == {"src/a b.ts", 'we"ird<&>.ts', "x[1].ts"}
    parents = {c: p.tag.split("}")[1] for p in root.iter() for c in p}
    if fmt != "graphml":
        assert {parents[e] for e in root.iter() if e.tag.endswith(nodes) and e.get("id", e.get("Id"))} == {nodes.lower() + "s" if fmt == "gexf" else "Nodes"}


def test_drawio_and_canvas_are_read_back(spark):
    root = ElementTree.fromstring(text(spark, "drawio"))
    cells = list(root.iter("mxCell"))
    ids = {c.get("id") for c in cells}
    assert len(ids) == len(cells) == 8 and {"0", "1"} <= ids
    assert all(c.get("source") in ids and c.get("target") in ids and c.find("mxGeometry") is not None for c in cells if c.get("edge"))
    canvas = json.loads(text(spark, "obsidian"))
    names = {n["id"] for n in canvas["nodes"]}
    assert names == {"src/a b.ts", 'we"ird<&>.ts', "x[1].ts"} and len(canvas["edges"]) == 3
    assert all(e["fromNode"] in names and e["toNode"] in names for e in canvas["edges"])
    assert json.loads(text(spark, "obsidian", [])) == {"nodes": [], "edges": []}


def test_mermaid_ids_are_plain(spark):
    for line in text(spark, "mermaid").split("\n")[1:]:
        word = line.strip().split("[")[0].split(" ")[0]
        assert word.replace("_", "").isalnum()


def test_change_risk_by_hand(spark):
    f = spark.createDataFrame([("a", "s", 2, 4, 10), ("b", "s", 0, 8, 30), ("c", "t", 50, 30, 900)], "path string, change_set string, fan_in int, complexity int, churn int")
    got = {r.change_set: (r.score, r.level) for r in M.change_risk(f, spark.createDataFrame([("a",)], "path string")).collect()}
    # s: blast min(100, 2/3*500) = 100, complexity 5*6 = 30, churn 20, violations 20
    assert got == {"s": (pytest.approx(35 + 7.5 + 4 + 4), "medium"), "t": (pytest.approx(35 + 25 + 20), "high")}


def test_stale_looks_for_tests(spark):
    f = spark.createDataFrame([(1, "r", "src/parser.py", 20, 0, True), (2, "r", "src/loader.py", 20, 0, True), (3, "r", "tests/test_parser.py", 0, 9, True), (4, "q", "src/parser.py", 20, 0, True)], "file_id int, repo_id string, path string, fan_in int, churn int, is_code boolean")
    assert {r.file_id: r.score for r in M.stale_files(f, f).collect()} == {1: 75, 2: 100, 4: 100}


def test_api_changes(spark):
    s = "k string, v int"
    d = D.api_changes(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], s), spark.createDataFrame([("b", 1), ("c", 2), ("d", 1)], s), ["k"], "v")
    assert {(r.k, r.severity) for r in d.collect()} == {("a", "critical"), ("c", "high"), ("d", "info")}


def test_merge_keeps_the_later_by_time(spark, tmp_path):
    rows = [[("a", 5, "new"), ("a", 1, "old")], [("a", 3, "late"), ("b", 1, "b")]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "path string, t int, v string").coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    s = spark.readStream.schema("path string, t int, v string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    T.merge_batches(s, str(tmp_path / "t"), ["path"], str(tmp_path / "c"), order="t", keep=1).awaitTermination(90)
    left = list((tmp_path / "t").glob("v*"))
    assert len(left) == 1 and {(r.path, r.v) for r in spark.read.parquet(str(left[0])).collect()} == {("a", "new"), ("b", "b")}


def test_reports_are_read_apart(spark):
    d = spark.createDataFrame([(r, k, x) for r in "xy" for k, x in enumerate(["SF:" + r, "DA:1,1", "DA:2,0", "end_of_record"])] + [("z", 0, "DA:1,1")], "report string, line_no int, line string")
    assert sorted(tuple(r) for r in readers.lcov(d).collect()) == [("x", 2, 1, 50.0), ("y", 2, 1, 50.0)]


def test_chunks_hold_every_word_of_all_documents(spark):
    docs = [(1, "word%d " * 900 % tuple(range(900))), (2, None), (3, ""), (4, "ein Satz mit ü."), (5, "p\n\n" * 50)]
    got = readers.chunk_documents(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    for k, t in docs:
        assert set((t or "").split()) <= {w for r in got if r.doc_id == k for w in r.chunk.split()}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    frame = type("F", (), {"sparkSession": type("P", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d=None: None})()})()})()
    with pytest.raises(RuntimeError):
        durable(frame)
