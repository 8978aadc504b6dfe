import json
import random

from codestrata.operators.snapshots import is_json, snapshot_changes

SCHEMA = "id long, repo_id string, name string, created_at long, data string"


def found(spark, rows):
    return sorted(tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect())


def snap(i, t, data, repo="r"):
    return (i, repo, "n", t, data if data is None or isinstance(data, str) else json.dumps(data))


def test_added_removed_changed(spark):
    rows = [
        snap(1, 10, {"healthScore": 50, "fileCoupling": {"a": {"in": 1, "out": 2}, "b": {"in": 1, "out": 1}}, "untestedFilePaths": ["x", "y"]}),
        snap(2, 20, {"healthScore": "50.0", "fileCoupling": {"./a": {"in": "1", "out": 2.0}, "c\\\\d".replace("\\\\", "\\"): {"in": 0, "out": 0}}, "untestedFilePaths": ["y", "y", "z"]}),
    ]
    assert found(spark, rows) == [("r", 2, "fileCoupling", "b", "removed"), ("r", 2, "fileCoupling", "c/d", "added"), ("r", 2, "untestedFilePaths", "x", "removed"), ("r", 2, "untestedFilePaths", "z", "added")]


def test_unreadable_and_absent_fields_are_passed_over(spark):
    rows = [snap(1, 1, {"healthScore": 1, "untestedFilePaths": ["a"]}), snap(2, 2, '{"healthScore": 2'), snap(3, 3, {"untestedFilePaths": ["a", "b"]}), snap(4, 4, ""), snap(5, 5, None), snap(6, 6, {"healthScore": 3, "untestedFilePaths": None})]
    assert found(spark, rows) == [("r", 3, "untestedFilePaths", "b", "added"), ("r", 6, "healthScore", "healthScore", "changed")]


def test_order_ties_repeats_nulls_and_extra_columns(spark):
    rows = [snap(2, 5, {"healthScore": 2}), snap(1, 5, {"healthScore": 1}), snap(2, 5, {"healthScore": 2}), snap(7, None, {"healthScore": 9}), (8, None, None, None, '{"healthScore": 1}')]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("field", __import__("pyspark").sql.functions.lit(1)).withColumn("next_id", __import__("pyspark").sql.functions.lit(2))
    assert sorted(tuple(r) for r in snapshot_changes(df).collect()) == [("r", 1, "healthScore", "healthScore", "changed"), ("r", 2, "healthScore", "healthScore", "changed")]
    assert found(spark, []) == []


def test_trailing_matter_is_no_json(spark):
    d = spark.createDataFrame([(x,) for x in ['{"a":1}', '{"a":1}]', '{"a":1},{}', "[]", "", None, " {} "]], "d string")
    assert [r[0] for r in d.select(is_json("d")).collect()] == [True, False, False, True, False, False, True]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for repo in "pq":
        for i in range(12):
            rows.append(snap(i, rng.randrange(5) * 50_000, {"healthScore": rng.choice([1, 2, None]), "untestedFilePaths": rng.sample("abcd", 2), "fileCoupling": {k: {"in": rng.randrange(2), "out": 0} for k in rng.sample("abcd", 3)}}, repo))
    want = set()
    for repo in "pq":
        own = sorted((r for r in rows if r[1] == repo), key=lambda r: (r[3], r[0]))
        last = {}
        for r in own:
            d = json.loads(r[4])
            for f in ("healthScore", "untestedFilePaths", "fileCoupling"):
                if d.get(f) is None:
                    continue
                cur = {"healthScore": float(d[f])} if f == "healthScore" else dict.fromkeys(d[f]) if isinstance(d[f], list) else {k: (v["in"], v["out"]) for k, v in d[f].items()}
                if f in last:
                    for k in cur.keys() | last[f].keys():
                        c = "added" if k not in last[f] else "removed" if k not in cur else "changed" if cur[k] != last[f][k] else None
                        if c:
                            want.add((repo, r[0], f, k, c))
                last[f] = cur
    assert set(found(spark, rows)) == want
