import json

from codestrata.operators import tools as T

FILES = "file_id int, repo_id string, path string, name string, folder string, layer string, language string, lines int, complexity int, nesting_depth int, churn int, is_code boolean, coupling_in int, coupling_out int, health_grade string, imports array<string>"


def files(spark, **change):
    rows = [
        (1, "r", "src/big.py", "big.py", "src", "core", "Python", 900, 40, 3, 10, True, 31, 2, "F", ["json", ".util", 'we"ird']),
        (2, "r", "src/util.py", "util.py", "src", "utils", "Python", 20, 2, 1, 0, True, 1, 0, "A", []),
        (3, "r", "tests/test_util.py", "test_util.py", "tests", "test", "Python", 10, 1, 1, 0, True, 0, 1, "A", None),
        (4, "q", "lib/one.go", "one.go", "lib", "lib", "Go", 5, 1, 0, 1, True, 0, 0, None, ["fmt"]),
        (5, "q", "conf.yaml", "conf.yaml", "", "config", None, 5, 0, 0, 0, False, 99, 0, "A", None),
    ]
    return spark.createDataFrame(rows, FILES)


def functions(spark):
    rows = [(k, "r", "src/big.py", f"f{k}", k, False) for k in range(1, 52)] + [(60, "r", "src/util.py", "load_it", 1, True), (61, "q", "lib/one.go", "load_it", 1, False), (62, "q", "lib/one.go", "quiet", 9, True)]
    return spark.createDataFrame(rows, "fn_id long, repo_id string, file string, name string, line int, is_exported boolean")


def test_suggestions_and_health_by_hand(spark):
    f = T.code_files(files(spark), functions(spark))
    findings = spark.createDataFrame([(1, "r", "high"), (1, "r", "high"), (2, "r", "low")], "file_id int, repo_id string, severity string")
    dead = spark.createDataFrame([(1, "r")] * 6 + [(2, "r")], "file_id int, repo_id string")
    got = {(r.kind, r.file_id): (r.effort, r.impact, r.ratio) for r in T.suggestions(f, findings, dead, spark.createDataFrame([(2,)], "file_id int")).collect()}
    # file 1: 3*31 + 25.5 + 2 = 120.5 -> 100; impact of weight 3: 60 + 62 -> 100, of 2: 100 (102), of 1: 82
    assert got == {("god_file", 1): (100, 100, 1.0), ("fan_in", 1): (100, 100, 1.0), ("complexity", 1): (100, 100, 1.0), ("security", 1): (100, 100, 1.0), ("dead_code", 1): (100, 82, 0.82), ("cycle", 2): (4, 62, 15.5)}
    h = {r.repo_id: (r.score, r.grade) for r in T.repository_health(f, functions(spark), findings, dead, spark.createDataFrame([("r", "x")], "repo_id string, component string")).collect()}
    # r: cycles 5, high 8, god 3, coupled 2, dead round(30*7/52) = 4; q: one configuration file is coupled
    assert h == {"r": (78, "C"), "q": (98, "A")}
    assert T.suggestions(f.limit(0), findings, dead, dead).count() == 0


def test_first_issues_and_gaps(spark):
    f = T.code_files(files(spark), functions(spark))
    assert [r.file_id for r in T.first_issues(f).collect()] == [4]
    g = {(r.repo_id, r.folder): (r.n_functions, r.n_covered, r.n_risky, r.pct) for r in T.coverage_gaps(files(spark), functions(spark), spark.createDataFrame([(1,), (60,)], "fn_id long")).collect()}
    assert g == {("r", "src"): (52, 2, 50, 3.85), ("q", "lib"): (2, 0, 0, 0.0)}


def test_calls_and_contracts(spark):
    called = spark.createDataFrame([("r", "src/big.py", "load_it", 2), ("r", "src/util.py", "load_it", 1), ("q", "x.go", "quiet", 1)], "repo_id string, path string, fn string, count long")
    assert {(r.repo_id, r.name, r.n_files, r.n_callers, r.risk) for r in T.api_impact(functions(spark), called, "LOAD%").collect()} == {("r", "load_it", 1, 1, 15), ("q", "load_it", 1, 0, 10)}
    s = {(r.repo_id, r.kind, r.path, r["rank"]) for r in T.shape(functions(spark), called, "load_it").collect()}
    assert s == {("r", "definition", "src/util.py", 1), ("q", "definition", "lib/one.go", 1), ("r", "call", "src/big.py", 1), ("r", "call", "src/util.py", 2)}
    calls = spark.createDataFrame([("r", "src/util.py", "f1", "src/big.py", 1), ("r", "src/big.py", "f2", "src/big.py", 3), ("r", "src/big.py", "load_it", "src/util.py", 2)], "repo_id string, source string, fn string, target string, count long")
    c = {(r.fn, r.provider): (r.state, r.n_consumers, r.usage) for r in T.contracts(functions(spark), calls).collect()}
    assert c == {("f1", "src/big.py"): ("violation", 1, 1), ("f2", "src/big.py"): ("orphaned", 0, 0), ("load_it", "src/util.py"): ("used", 1, 2), ("quiet", "lib/one.go"): ("orphaned", 0, 0)}


def test_impact(spark):
    f = T.code_files(files(spark), functions(spark))
    p = T.patch_impact(spark.createDataFrame([("r", 7, "src/big.py"), ("r", 7, "src/util.py"), ("r", 7, "src/util.py"), ("r", 8, "gone")], "repo_id string, sha int, path string"), f).collect()
    assert [(r.sha, r.n_files, r.impact, r.n_functions, r.priority) for r in p] == [(7, 2, 32, 52, 84)]
    i = spark.createDataFrame([("r", "src/util.py", "src/big.py"), ("r", "tests/test_util.py", "src/util.py"), ("q", "src/util.py", "lib/one.go")], "repo_id string, source string, target string")
    d = {r.file_id: r.distance for r in T.dependency_impact(files(spark), i, ["json"]).collect()}
    assert d == {1: 0, 2: 1, 3: 2}


def test_bills_of_materials_are_json(spark):
    for form, key in (("cyclonedx", "components"), ("spdx", "packages")):
        rows = T.bill_of_materials(files(spark), form).orderBy("repo_id", "ord", "line").collect()
        docs = {x: json.loads("".join(r.line for r in rows if r.repo_id == x)) for x in ("r", "q")}
        assert {p["name"] for p in docs["r"][key]} == {"json", 'we"ird'} and [p["name"] for p in docs["q"][key]] == ["fmt"]
    assert docs["q"]["spdxVersion"] == "SPDX-2.3"
