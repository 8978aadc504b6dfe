import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codestrata.operators import references as R

T0 = datetime(2024, 1, 1)
REL = "id string, src_id string, dst_id string, doc_id string, loaded_at timestamp_ntz"
ENT = "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
DOC = "id string, indexed_at long, deleted_at timestamp_ntz"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def brute(rels, ents):
    out = set()
    for rid, src, *_, t in rels:
        k = (src or "").strip().lower()
        if not k:
            continue
        own = [(s or datetime.min, d) for i, s, d in ents if i.strip().lower() == k]
        tt = t or datetime.max
        if any(s <= tt and not (d is not None and d <= tt) for s, d in own):
            continue
        out.add((rid, "src_id", "missing" if not own else "later" if all(s > tt for s, _ in own) else "deleted"))
    return out


def run(spark, rels, ents):
    d = R.relation_orphans(spark.createDataFrame(rels, REL).withColumn("key", F.lit(1)), spark.createDataFrame(ents, ENT).withColumn("start", F.lit(1)), spark.createDataFrame([], DOC))
    return {(r.id, r.ref, r.state) for r in d.collect()}


def test_states_blanks_case_and_nulls(spark):
    ents = [("E1", day(0), None), ("e2", day(5), None), ("e3", day(0), day(2)), ("e3", day(8), None), ("e4", None, None)]
    rels = [("a", " E1 ", None, "", day(1)), ("b", "e2", None, None, day(1)), ("c", "e3", None, None, day(4)), ("d", "e3", None, None, day(9)), ("e", "nope", None, None, day(1)), ("f", "  ", None, None, day(1)), ("g", "e4", None, None, day(0)), ("h", "e3", None, None, None), ("e", "nope", None, None, day(1))]
    assert run(spark, rels, ents) == {("b", "src_id", "later"), ("c", "src_id", "deleted"), ("e", "src_id", "missing")} == brute(rels, ents)


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("a", "x", None, None, day(1))], []) == {("a", "src_id", "missing")}


def test_heavy_and_wide_keys_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_INTERVALS", 3)
    rng = random.Random(3)
    ents = []
    for k in range(12):
        for _ in range(rng.choice([1, 2, 9])):
            s = rng.randrange(60)
            ents.append((f"k{k}", day(s), rng.choice([None, day(s + rng.randrange(-2, 20))])))
    rels = [(f"r{i}", rng.choice(["k0"] * 30 + ["k1"] * 5 + [f"k{j}" for j in range(14)]), None, None, day(rng.randrange(80))) for i in range(3000)]
    assert run(spark, rels, ents) == brute(rels, ents)


def test_sweep_counts_open_intervals(spark):
    refs = spark.createDataFrame([("a", "s", "t", "k", day(3)), ("b", "s", "t", "k", day(40))], "id string, ref string, target string, key string, t timestamp_ntz")
    iv = spark.createDataFrame([("t", "k", day(1), day(10)), ("t", "k", day(2), day(5)), ("t", "k", day(30), day(20))], "target string, key string, start timestamp_ntz, end timestamp_ntz")
    got = {r.id: (r.there, r.seen) for r in R.sweep_presence(refs, iv).collect()}
    assert got == {"a": (2, 2), "b": (0, 3)}
