"""Reports on code, as functions of the tables they need: files, functions, calls, findings. Queries only bind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codestrata.functions import scalar as S
from codestrata.operators import graph as G, metrics as M

# Thresholds and weights of the reports.
GOD, COUPLED, COMPLEX, DEAD = 50, 30, 30, 5
SEVERITY = {"high": 3, "medium": 2, "low": 1}


def code_files(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Files with the number of functions in each (n_functions)."""
    n = functions.groupBy("repo_id", F.col("file").alias("path")).agg(F.count("*").alias("n_functions"))
    return files.join(n, ["repo_id", "path"], "left").withColumn("n_functions", F.coalesce("n_functions", F.lit(0).cast("long")))


def file_metrics(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(file_id, path, lines, n_functions, complexity, nesting, fan_in, fan_out, churn) of each file."""
    return code_files(files, functions).select("file_id", "path", "lines", "n_functions", "complexity", F.coalesce("nesting_depth", F.lit(0)).alias("nesting"), F.col("coupling_in").alias("fan_in"), F.col("coupling_out").alias("fan_out"), "churn")


def suggestions(files: DataFrame, findings: DataFrame, dead: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(kind, file_id, path, effort, impact, ratio): what to mend, by six rules.

    files as of `code_files`; findings (file_id, severity); dead and cyclic (file_id, ...): dead functions, and files on import cycles.
    Effort is 3 a user, half a function and a fifth of the churn; impact 20 a step of severity and 2 a user; both end at 100.
    """
    f = files.where("is_code").select("file_id", "path", "coupling_in", "n_functions", "churn", "complexity")
    worst = findings.where("severity = 'high'").select("file_id").dropDuplicates().select(F.lit("security").alias("kind"), "file_id", F.lit(3).alias("weight"))
    many = dead.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") > DEAD).select(F.lit("dead_code").alias("kind"), "file_id", F.lit(1).alias("weight"))
    loops = cyclic.select("file_id").dropDuplicates().select(F.lit("cycle").alias("kind"), "file_id", F.lit(3).alias("weight"))
    rule = lambda k, c, w: F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight")))
    own = f.select("file_id", F.explode(F.filter(F.array(rule("god_file", F.col("n_functions") > GOD, 3), rule("fan_in", F.col("coupling_in") > COUPLED, 2), rule("complexity", F.col("complexity") > COMPLEX, 3)), lambda x: x.isNotNull())).alias("r")).select("r.kind", "file_id", "r.weight")
    j = own.unionByName(worst).unionByName(many).unionByName(loops).join(f, "file_id")
    cap = F.lit(100)
    effort = F.least(cap, S.round_half_up(3 * F.col("coupling_in") + 0.5 * F.col("n_functions") + 0.2 * F.col("churn")))
    impact = F.least(cap, S.round_half_up(20.0 * F.col("weight") + 2 * F.col("coupling_in")))
    return j.select("kind", "file_id", "path", effort.alias("effort"), impact.alias("impact")).withColumn("ratio", S.round_half_up(F.col("impact") / F.greatest("effort", F.lit(1)), 2))


def repository_health(files: DataFrame, functions: DataFrame, findings: DataFrame, dead: DataFrame, cycles: DataFrame) -> DataFrame:
    """(repo_id, cycles, high, god, coupled, dead, score, grade). files as of `code_files`; cycles: (repo_id), a row each."""
    f = files.groupBy("repo_id").agg(F.count_if("is_code").alias("n_files"), F.count_if((F.col("n_functions") > GOD) & ~F.col("name").startswith("index.")).alias("god"), F.count_if(F.col("coupling_in") > COUPLED).alias("coupled"))
    n = lambda d, c, name: d.where(c).groupBy("repo_id").agg(F.count("*").alias(name))
    always = F.lit(True)
    for d in (n(functions, always, "n_fn"), n(findings, F.col("severity") == "high", "high"), n(dead, always, "dead"), n(cycles, always, "cycles")):
        f = f.join(d, "repo_id", "left")
    f = f.na.fill(0, ["n_fn", "high", "dead", "cycles"])
    s = f.withColumn("score", M.health(*[F.col(c) for c in ("n_files", "cycles", "high", "god", "coupled", "dead", "n_fn")]))
    return s.select("repo_id", "cycles", "high", "god", "coupled", "dead", "score", S.score_grade(F.col("score")).alias("grade"))


def first_issues(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, n_functions): small, little coupled, quiet code files without a test file of their name. files as of `code_files`."""
    bare = F.regexp_replace(F.lower(S.stem(F.col("path"))), r"^test_|_test$|\.test$|\.spec$", "")
    tests = files.where(S.is_test(F.col("path"))).select("repo_id", bare.alias("stem")).dropDuplicates()
    f = files.where("is_code and coupling_in <= 2 and coupling_out <= 3 and n_functions < 10 and churn <= 2").where(~S.is_test(F.col("path"))).withColumn("stem", F.lower(S.stem(F.col("path"))))
    return f.join(tests, ["repo_id", "stem"], "left_anti").select("file_id", "repo_id", "path", "n_functions")


def coverage_gaps(files: DataFrame, functions: DataFrame, covered: DataFrame) -> DataFrame:
    """(repo_id, folder, n_functions, n_covered, n_risky, pct) per folder: functions no test covers, and of these those in files of much churn (over 3 and two fifths of the greatest)."""
    top = files.agg(F.greatest(F.lit(3), F.floor(0.4 * F.max("churn"))).alias("much"))
    f = functions.where("file is not null").select("fn_id", "repo_id", F.col("file").alias("path")).join(covered.select("fn_id").dropDuplicates().withColumn("hit", F.lit(1)), "fn_id", "left")
    j = f.join(files.select("repo_id", "path", "folder", "churn"), ["repo_id", "path"]).join(F.broadcast(top), F.lit(True))
    return j.groupBy("repo_id", "folder").agg(F.count("*").alias("n_functions"), F.count("hit").alias("n_covered"), F.count_if(F.col("hit").isNull() & (F.col("churn") >= F.col("much"))).alias("n_risky"), F.round(100.0 * F.count("hit") / F.count("*"), 2).alias("pct"))


def api_impact(functions: DataFrame, called: DataFrame, like: str) -> DataFrame:
    """(repo_id, name, n_files, n_callers, risk) of the handlers whose name matches: defining files, calling files, ten a file and five a caller, to 100. called: (repo_id, path, fn)."""
    f = functions.where(F.col("name").ilike(like)).select("repo_id", "name", "file").dropDuplicates()
    n = f.groupBy("repo_id", "name").agg(F.count("file").alias("n_files"))
    c = called.select("repo_id", F.col("fn").alias("name"), F.col("path").alias("file")).dropDuplicates().join(f, ["repo_id", "name", "file"], "left_anti").groupBy("repo_id", "name").agg(F.count("*").alias("n_callers"))
    j = n.join(c, ["repo_id", "name"], "left").withColumn("n_callers", F.coalesce("n_callers", F.lit(0).cast("long")))
    return j.withColumn("risk", F.least(F.lit(100), 10 * F.col("n_files") + 5 * F.col("n_callers")).cast("long"))


def shape(functions: DataFrame, called: DataFrame, like: str, definitions: int = 5, sites: int = 50) -> DataFrame:
    """(repo_id, kind, path, line, rank): the first definitions of a function and the first files that call it, per repository (both counts are the feature's)."""
    d = functions.where(F.col("name").ilike(like)).select("repo_id", F.lit("definition").alias("kind"), F.col("file").alias("path"), "line", "fn_id", "name")
    names = d.select("repo_id", F.col("name").alias("fn")).dropDuplicates()
    c = called.join(names, ["repo_id", "fn"], "left_semi").select("repo_id", F.lit("call").alias("kind"), "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("fn_id")).dropDuplicates()
    w = W.partitionBy("repo_id", "kind").orderBy("path", "line", "fn_id")
    a = d.drop("name").unionByName(c).withColumn("rank", F.row_number().over(w).cast("long"))
    return a.where(F.col("rank") <= F.when(F.col("kind") == "call", sites).otherwise(definitions)).select("repo_id", "kind", "path", "line", "rank")


def contracts(functions: DataFrame, calls: DataFrame, least: int = 3) -> DataFrame:
    """(repo_id, provider, fn, state, n_consumers, usage): what files offer and others use.

    A contract is what is exported or called `least` times. `violation`: used by another file without being offered; `orphaned`: offered
    and used by none; `used` otherwise. calls: (repo_id, source, fn, target, count) resolved, from the caller to the definer.
    """
    f = functions.where("file is not null").groupBy("repo_id", F.col("file").alias("provider"), F.col("name").alias("fn")).agg(F.bool_or(F.coalesce("is_exported", F.lit(False))).alias("exported"))
    other = F.col("source") != F.col("target")
    u = calls.groupBy("repo_id", F.col("target").alias("provider"), "fn").agg(F.sum("count").alias("total"), F.count_if(other).alias("n_consumers"), F.coalesce(F.sum(F.when(other, F.col("count"))), F.lit(0)).alias("usage"))
    j = f.join(u, ["repo_id", "provider", "fn"], "left").na.fill(0, ["total", "n_consumers", "usage"])
    offered = F.col("exported") | (F.col("total") >= least)
    state = F.when(~offered & (F.col("usage") > 0), "violation").when(offered & (F.col("usage") == 0), "orphaned").when(offered, "used")
    return j.select("repo_id", "provider", "fn", state.alias("state"), "n_consumers", "usage").where("state is not null")


def patch_impact(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, sha, n_files, impact, n_functions, priority) of change sets: users and functions of the files they touch, and their sum. changes: (repo_id, sha, path); files as of `code_files`."""
    j = changes.select("repo_id", "sha", "path").dropDuplicates().join(files.select("repo_id", "path", "coupling_in", "n_functions").dropDuplicates(["repo_id", "path"]), ["repo_id", "path"])
    return j.groupBy("repo_id", "sha").agg(F.count("*").alias("n_files"), F.sum("coupling_in").alias("impact"), F.sum("n_functions").alias("n_functions")).withColumn("priority", F.col("impact") + F.col("n_functions"))


def dependency_impact(files: DataFrame, imported: DataFrame, packages: list[str]) -> DataFrame:
    """(file_id, repo_id, path, churn, distance): files that import one of the packages (0), and all that import those, however far.

    imported: (repo_id, source, target) between files. Distances are found from all importers at once, so each file is reached once.
    """
    f = files.select("file_id", "repo_id", "path", "churn", "imports")
    node = lambda c: F.concat_ws("\u0000", "repo_id", c)
    direct = f.where(F.arrays_overlap("imports", F.array(*[F.lit(x) for x in packages]))).select(node("path").alias("node")).dropDuplicates()
    back = imported.select(node("target").alias("source"), node("source").alias("target")).unionByName(direct.select(F.lit("\u0001").alias("source"), F.col("node").alias("target")))
    r = G.reach(back, f.sparkSession.createDataFrame([("\u0001",)], "node string")).where("depth > 0").select("node", (F.col("depth") - 1).alias("distance"))
    return f.withColumn("node", node("path")).join(r, "node").select("file_id", "repo_id", "path", "churn", "distance")


def bill_of_materials(files: DataFrame, form: str) -> DataFrame:
    """(repo_id, ord, line): a CycloneDX 1.4 or SPDX 2.3 document per repository, line by line; a package is what files import by name.

    Written in the order of ord and line, a repository's lines are one JSON document.
    """
    p = files.select("repo_id", F.explode("imports").alias("lib")).where("lib is not null and repo_id is not null and not startswith(lib, '.')").dropDuplicates()
    if form == "cyclonedx":
        head, tail = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), F.lit(1).alias("version"))), "]}"
        key, item = "components", F.struct(F.col("lib").alias("name"), F.lit("library").alias("type"))
    else:
        head = F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("repo_id").alias("name")))
        key, item, tail = "packages", F.struct(F.col("lib").alias("name"), F.concat(F.lit("SPDXRef-"), F.left(F.md5(F.col("lib").cast("binary")), F.lit(12))).alias("SPDXID"), F.lit("NOASSERTION").alias("downloadLocation")), "]}"
    last = p.groupBy("repo_id").agg(F.max(F.to_json(item)).alias("top"))
    rows = p.join(last, "repo_id").withColumn("j", F.to_json(item)).select("repo_id", F.lit(1).alias("ord"), F.concat("j", F.when(F.col("j") == F.col("top"), "").otherwise(",")).alias("line"))
    repos = last.select("repo_id")
    start = repos.select("repo_id", F.lit(0).alias("ord"), F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(f',"{key}":[')).alias("line"))
    return start.unionByName(rows).unionByName(repos.select("repo_id", F.lit(2).alias("ord"), F.lit(tail).alias("line")))


def organisation(files: DataFrame) -> DataFrame:
    """(kind, item, n): grades of the repositories, their languages by files, and the ten files of most churn."""
    points = F.when(F.col("health_grade") == "A", 5).when(F.col("health_grade") == "B", 4).when(F.col("health_grade") == "C", 3).when(F.col("health_grade") == "D", 2).otherwise(1)
    g = files.where("health_grade is not null").groupBy("repo_id").agg(F.avg(points).alias("gpa"))
    grade = lambda c: S.ladder(c, [(4.5, "A"), (3.5, "B"), (2.5, "C"), (1.5, "D")], "F")
    a = g.groupBy(grade(F.col("gpa")).alias("item")).agg(F.count("*").alias("n")).select(F.lit("grade").alias("kind"), "item", "n")
    o = g.agg(F.avg("gpa").alias("gpa"), F.count("*").alias("n")).select(F.lit("overall").alias("kind"), grade(F.col("gpa")).alias("item"), "n")
    lang = files.where("language is not null").groupBy(F.col("language").alias("item")).agg(F.count("*").alias("n")).select(F.lit("language").alias("kind"), "item", "n")
    hot = files.orderBy(F.desc("churn"), "repo_id", "path").limit(10).select(F.lit("churn").alias("kind"), F.concat_ws(":", "repo_id", "path").alias("item"), F.col("churn").cast("long").alias("n"))
    return a.unionByName(o).unionByName(lang).unionByName(hot)


def severity(tag: Column) -> Column:
    """Of a finding's tag, `severity:title`."""
    return F.substring_index(tag, ":", 1)


def entity_facts(relations: DataFrame, entities: DataFrame, chunks: DataFrame, node: str, facts: int = 20, texts: int = 3) -> DataFrame:
    """(kind, item, detail) of one entity: its first neighbours by weight, then name, and the first chunks of its documents (both counts are the feature's).

    relations: (src, dst, type, weight); entities: (id, doc_id); chunks: (id, doc_id, idx).
    """
    out = relations.where(F.col("src") == node).select(F.lit("out").alias("d"), F.col("dst").alias("item"), "type", "weight")
    r = out.unionByName(relations.where(F.col("dst") == node).select(F.lit("in").alias("d"), F.col("src").alias("item"), "type", "weight"))
    a = r.orderBy(F.desc_nulls_last("weight"), "item", "d", "type").limit(facts).select(F.lit("fact").alias("kind"), "item", F.concat_ws(":", "d", "type").alias("detail"))
    d = entities.where(F.lower(F.btrim("id")) == node).select("doc_id").dropDuplicates()
    b = chunks.join(F.broadcast(d), "doc_id", "left_semi").orderBy("doc_id", "idx", "id").limit(texts).select(F.lit("chunk").alias("kind"), F.col("id").alias("item"), F.col("doc_id").alias("detail"))
    return a.unionByName(b)


def answer_material(question: str, chunks: DataFrame, entities: DataFrame, relations: DataFrame, top_chunks: int = 8, top_entities: int = 5, neighbours: int = 6) -> DataFrame:
    """(kind, item, detail) for a question: the chunks with most of its keywords, the most mentioned entities named by one, and neighbours of each.

    Keywords are the question's first ten words of three letters and more. An answer is composed from these rows; no model is called.
    """
    words = list(dict.fromkeys(w for w in "".join(c if c.isalnum() else " " for c in question.lower()).split() if len(w) > 2))[:10]
    w = chunks.where("text is not null").select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))).alias("w")).where(F.col("w").isin(*words))
    c = w.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(top_chunks).select(F.lit("chunk").alias("kind"), F.col("id").alias("item"), F.col("n").cast("string").alias("detail"))
    named = F.exists(F.array(*[F.lit(x) for x in words]), lambda x: F.contains(F.lower("name"), x)) if words else F.lit(False)
    e = entities.where(named).groupBy(F.lower(F.btrim("id")).alias("id")).agg(F.max("mentions").alias("m")).orderBy(F.desc_nulls_last("m"), "id").limit(top_entities)
    both = relations.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(relations.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    near = both.join(F.broadcast(e.select("id")), "id").dropDuplicates()
    near = near.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("other"))).where(F.col("k") <= neighbours)
    return c.unionByName(e.select(F.lit("entity").alias("kind"), F.col("id").alias("item"), F.col("m").cast("string").alias("detail"))).unionByName(near.select(F.lit("fact").alias("kind"), F.col("id").alias("item"), F.col("other").alias("detail")))


def duties(hits: DataFrame, imported: DataFrame, files: DataFrame, near: int = 30) -> DataFrame:
    """(file_id, severity): files that initiate and approve: within `near` lines critical, else high; files that only import one of each medium.

    hits: (file_id, line_no, tag); nearest pairs are found by a frame over lines, without a self-join. imported: (repo_id, source, target).
    """
    w = W.partitionBy("file_id").orderBy("line_no").rangeBetween(-near, near)
    g = hits.withColumn("near", F.max(F.when(F.col("tag") == "approve", 1)).over(w))
    g = g.groupBy("file_id").agg(F.max(F.when(F.col("tag") == "initiate", F.coalesce("near", F.lit(0)))).alias("near"), F.count_if(F.col("tag") == "approve").alias("n"))
    own = g.where("n > 0 and near is not null").select("file_id", F.when(F.col("near") == 1, "critical").otherwise("high").alias("severity"))
    f = files.select("file_id", "repo_id", "path")
    side = g.join(f, "file_id").select("repo_id", F.col("path").alias("target"), (F.col("near").isNotNull()).alias("i"), (F.col("n") > 0).alias("a"))
    m = imported.join(side, ["repo_id", "target"]).groupBy("repo_id", F.col("source").alias("path")).agg(F.bool_or("i").alias("i"), F.bool_or("a").alias("a")).where("i and a")
    return own.unionByName(m.join(f, ["repo_id", "path"]).join(own, "file_id", "left_anti").select("file_id", F.lit("medium").alias("severity")))


def file_context(files: DataFrame, calls: DataFrame, findings: DataFrame) -> DataFrame:
    """(file_id, layer, complexity, n_functions, n_dependents, n_dependencies, n_findings). files as of `code_files`; calls resolved (repo_id, source, target)."""
    e = calls.where("source <> target").select("repo_id", "source", "target").dropDuplicates()
    a = e.groupBy("repo_id", F.col("target").alias("path")).agg(F.count("*").alias("n_dependents"))
    b = e.groupBy("repo_id", F.col("source").alias("path")).agg(F.count("*").alias("n_dependencies"))
    n = findings.groupBy("file_id").agg(F.count("*").alias("n_findings"))
    j = files.join(a, ["repo_id", "path"], "left").join(b, ["repo_id", "path"], "left").join(n, "file_id", "left").na.fill(0, ["n_dependents", "n_dependencies", "n_findings"])
    return j.select("file_id", "layer", "complexity", "n_functions", "n_dependents", "n_dependencies", "n_findings")
