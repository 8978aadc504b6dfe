"""Scores, rankings and findings over files and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codestrata.functions import scalar as S
from codestrata.operators.graph import degrees

# Weights and thresholds of the scores.
HOTSPOT_WEIGHTS = {"fan_in": 40, "complexity": 40, "lines": 20}
STALE_WEIGHTS = {"churn": 0.4, "fan_in": 0.35, "tests": 0.25}
RISK_WEIGHTS = {"blast": 0.35, "complexity": 0.25, "churn": 0.20, "violations": 0.20}
MAX_FUNCTIONS, MAX_COUPLING_IN, MAX_LINES = 50, 30, 500


def with_degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(edges).select("path", "fan_in", "fan_out")
    return files.join(d, "path", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fan_in", "fan_out")})


def _top(c: str) -> Column:
    """The table's greatest value, at least 1; a one-row aggregate that is joined, so nothing is ordered in one task."""
    return F.greatest(F.max(c), F.lit(1)).alias(f"top_{c}")


def hotspots(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, score): weighted sum of fan-in, complexity and lines, each over its greatest value."""
    f = with_degrees(files, edges)
    tops = f.agg(*[_top(c) for c in HOTSPOT_WEIGHTS])
    j = f.join(F.broadcast(tops), F.lit(True))  # one row
    score = sum((F.lit(w) * F.col(c) / F.col(f"top_{c}") for c, w in HOTSPOT_WEIGHTS.items()), F.lit(0))
    return j.select("path", "fan_in", "complexity", "lines", S.round_half_up(score).alias("score"))


def stale(files: DataFrame, edges: DataFrame, min_fan_in: int = 1) -> DataFrame:
    """Much used, seldom changed files without a test: weighted score of 100."""
    f = with_degrees(files, edges).where(~S.is_test(F.col("path")))
    tops = f.agg(_top("churn"))
    j = f.where(F.col("fan_in") >= min_fan_in).join(F.broadcast(tops), F.lit(True))
    w = STALE_WEIGHTS
    score = 100 * (w["churn"] * (1 - F.col("churn") / F.col("top_churn")) + w["fan_in"] * F.least(F.col("fan_in") / 20.0, F.lit(1.0)) + w["tests"])
    return j.select("path", "fan_in", "churn", S.round_half_up(score).alias("score"))


def stale_files(files: DataFrame, everything: DataFrame, min_fan_in: int = 1) -> DataFrame:
    """As `stale`, for files with their fan-in and repository: the part for tests is given only where no test file's name holds a word (of three signs and more) of the file's stem."""
    word = F.explode(F.split(F.regexp_replace(F.lower(F.regexp_replace("path", r"^.*/", "")), r"[^a-z0-9]+", " "), " "))
    tests = files.where(S.is_test(F.col("path"))).select("repo_id", word.alias("w")).dropDuplicates().withColumn("hit", F.lit(1))
    f = files.where((F.col("fan_in") >= min_fan_in) & F.coalesce("is_code", F.lit(False)) & ~S.is_test(F.col("path")))
    own = f.select("file_id", "repo_id", F.explode(F.split(F.regexp_replace(F.lower(S.stem(F.col("path"))), r"[^a-z0-9]+", " "), " ")).alias("w")).where(F.length("w") >= 3)
    tested = own.join(tests, ["repo_id", "w"]).select("file_id").dropDuplicates().withColumn("tested", F.lit(True))
    top = everything.where(~S.is_test(F.col("path"))).agg(_top("churn"))
    j = f.join(tested, "file_id", "left").join(F.broadcast(top), F.lit(True)).withColumn("tested", F.coalesce("tested", F.lit(False)))
    w = STALE_WEIGHTS
    score = 100 * (w["churn"] * (1 - F.col("churn") / F.col("top_churn")) + w["fan_in"] * F.least(F.col("fan_in") / 20.0, F.lit(1.0)) + F.when(F.col("tested"), 0.0).otherwise(w["tests"]))
    return j.withColumn("score", S.round_half_up(score))


def change_risk(files: DataFrame, violating: DataFrame) -> DataFrame:
    """(change_set, score, level) from files with fan_in, complexity, churn and the change set they belong to; violating: (path) with a layer violation.

    Blast radius is 500 times the set's fan-in over all files; complexity weighs five times its mean, a violation 20; each part ends at 100.
    """
    n = files.agg(F.count("*").alias("n_all"))
    v = violating.select("path").dropDuplicates().withColumn("bad", F.lit(1))
    c = files.join(v, "path", "left").groupBy("change_set").agg(F.sum("fan_in").alias("f"), F.avg("complexity").alias("x"), F.avg("churn").alias("h"), F.count("bad").alias("v")).join(F.broadcast(n), F.lit(True))
    w, cap = RISK_WEIGHTS, F.lit(100)
    score = w["blast"] * F.least(cap, S.round_half_up(500.0 * F.col("f") / F.col("n_all"))) + w["complexity"] * F.least(cap, 5 * F.col("x")) + w["churn"] * F.least(cap, F.col("h")) + w["violations"] * F.least(cap, 20 * F.col("v"))
    s = F.round(score, 4)
    return c.select("change_set", s.alias("score"), F.when(s <= 33, "low").when(s <= 66, "medium").otherwise("high").alias("level"))


def layer_violations(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from a foundation layer to one more than a step above it."""
    lv = files.select("path", "layer").withColumn("level", S.layer_level(F.col("layer"))).where("level is not null")
    a = lv.select(F.col("path").alias("source"), F.col("layer").alias("source_layer"), F.col("level").alias("a"))
    b = lv.select(F.col("path").alias("target"), F.col("layer").alias("target_layer"), F.col("level").alias("b"))
    return edges.join(a, "source").join(b, "target").where("a < b and b - a > 1").select("source", "source_layer", "target", "target_layer", "fn")


def rule_violations(files: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that a FORBIDDEN(from, to) rule names by layer; `*` is any. rules is a short list given by the user."""
    a = files.select(F.col("path").alias("source"), F.col("layer").alias("sl"))
    b = files.select(F.col("path").alias("target"), F.col("layer").alias("tl"))
    r = F.broadcast(rules.select(F.col("from").alias("rule_from"), F.col("to").alias("rule_to")))
    j = edges.join(a, "source").join(b, "target").join(r, ((F.col("rule_from") == "*") | (F.col("rule_from") == F.col("sl"))) & ((F.col("rule_to") == "*") | (F.col("rule_to") == F.col("tl"))))
    return j.select("rule_from", "rule_to", "source", "target", "fn")


def rare_connections(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Cross-layer edges by the rarity of their layer pair in percent; multi-edges count, file pairs come out once."""
    a = files.select(F.col("path").alias("source"), F.col("layer").alias("source_layer"))
    b = files.select(F.col("path").alias("target"), F.col("layer").alias("target_layer"))
    x = edges.join(a, "source").join(b, "target").where("source_layer <> target_layer")
    total = x.agg(F.count("*").alias("total"))
    per = x.groupBy("source_layer", "target_layer").agg(F.count("*").alias("pair_count"))
    p = x.select("source", "target", "source_layer", "target_layer").dropDuplicates()
    j = p.join(per, ["source_layer", "target_layer"]).join(F.broadcast(total), F.lit(True))
    return j.select("source", "target", "source_layer", "target_layer", "pair_count", S.round_half_up(100.0 * (1 - F.col("pair_count") / F.col("total")), 1).alias("rarity"))


def knowledge_gaps(files: DataFrame, edges: DataFrame, hot: int = 5) -> DataFrame:
    """(kind, item): isolated files, much used files without a test, and thin layers that reach out a lot."""
    f = with_degrees(files, edges)
    tests = f.where(S.is_test(F.col("path"))).select(S.stem(F.col("path")).alias("t"))
    words = tests.select(F.explode(F.split(F.lower("t"), r"[^a-z0-9]+")).alias("w")).where("w <> ''").dropDuplicates()
    isolated = f.where("fan_in + fan_out = 0").select(F.lit("isolated").alias("kind"), F.col("path").alias("item"))
    hotf = f.where((F.col("fan_in") > hot) & ~S.is_test(F.col("path"))).withColumn("w", F.lower(S.stem(F.col("path"))))
    untested = hotf.join(words, "w", "left_anti").select(F.lit("untested_hotspot").alias("kind"), F.col("path").alias("item"))
    weak = f.groupBy("layer").agg(F.count("*").alias("n"), F.sum("fan_out").alias("o")).where("n < 3 and o > 5").select(F.lit("weak_layer").alias("kind"), F.col("layer").alias("item"))
    return isolated.unionByName(untested).unionByName(weak)


def confidence(files: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges with a confidence: explicit import 1.0, same folder .8, three calls or more .6, else .4."""
    i = imports.select("source", "target").dropDuplicates().withColumn("imp", F.lit(True))
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    j = edges.join(i, ["source", "target"], "left")
    conf = F.when(F.col("imp"), 1.0).when((folder("source") == folder("target")) & (folder("source") != ""), 0.8).when(F.col("count") >= 3, 0.6).otherwise(0.4)
    return j.select("source", "target", "fn", "count", conf.alias("confidence"))


def health(n_files: Column, cycles: Column, high: Column, god: Column, coupled: Column, dead: Column, functions: Column) -> Column:
    """0 to 100 from counts of problems; 100 where there is no code."""
    dead_part = F.least(F.lit(10), S.round_half_up(30.0 * dead / F.greatest(functions, F.lit(1))))
    score = 100 - F.least(F.lit(30), 5 * cycles) - F.least(F.lit(20), 4 * high) - F.least(F.lit(15), 3 * god) - F.least(F.lit(10), 2 * coupled) - dead_part
    return F.when(n_files == 0, 100).otherwise(F.greatest(F.lit(0), score)).cast("long")


def dead_functions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Top-level functions that nothing calls and no exemption covers. calls: (repo_id, name)."""
    # Names that frameworks call.
    entry = ["main", "create_app", "make_app", "get_app", "setup", "configure", "register", "on_startup", "on_shutdown", "lifespan", "setUp", "tearDown", "setUpClass", "tearDownClass"]
    f = functions.where("is_top_level and not coalesce(is_class_method, false)").where(F.coalesce(F.size("decorators"), F.lit(0)) <= 0)
    f = f.where(~F.col("name").isin(*entry) & ~F.col("name").rlike(r"^__.*__$|^test_")).where(~S.is_test(F.col("file")))
    f = f.where(~(F.coalesce("is_exported", F.lit(False)) & F.col("file").rlike(r"\.[jt]sx?$")))
    return f.join(calls.select("repo_id", "name").dropDuplicates(), ["repo_id", "name"], "left_anti").select("fn_id", "repo_id", "file", "name", "line")


def call_edges(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, source, target, fn, count): calls by name between files of a repository, first definition wins.

    Names before a parenthesis are taken from the text once and joined with the definitions; no name is tried on a file that lacks it.
    """
    w = W.partitionBy("repo_id", "name").orderBy("fn_id")
    defs = functions.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("repo_id", F.col("name").alias("fn"), F.col("file").alias("source"))
    names = F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1)
    # Of a file given twice the names are compared, not the texts.
    called = files.where("is_code and content is not null").select("repo_id", F.col("path").alias("target"), names.alias("fns")).dropDuplicates(["repo_id", "target"]).select("repo_id", "target", F.explode("fns").alias("fn"))
    called = called.groupBy("repo_id", "target", "fn").agg(F.count("*").alias("count"))
    return called.join(defs, ["repo_id", "fn"]).where("source <> target").select("repo_id", "source", "target", "fn", "count")
