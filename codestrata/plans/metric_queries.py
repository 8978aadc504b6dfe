"""Filter, join, aggregate, score and top-k operators, with SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from codestrata.functions import scalar as S
from codestrata.operators import metrics as M
from codestrata.operators.graph import degrees
from codestrata.plans.bindings import Registry, contents, edges, entities, files, functions, gfiles, links, relations
from codestrata.session import load

R = Registry()
QUERIES, SQL = R.queries, R.sql
_DEG = "d AS (SELECT path, CAST(sum(i) AS BIGINT) fan_in, CAST(sum(o) AS BIGINT) fan_out FROM (SELECT source path, 1 o, 0 i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY 1), g AS (SELECT gfiles.*, coalesce(fan_in, 0) fan_in, coalesce(fan_out, 0) fan_out FROM gfiles LEFT JOIN d USING (path))"
_TEST = r"(regexp_matches(path, '(?i)(^|/)(tests?|__tests__|__mocks__|fixtures?|spec|specs|cypress|e2e)(/|$)|\.(test|spec)\.[a-zA-Z0-9]+$|(^|/)test_[^/]+$|_test\.[a-zA-Z0-9]+$'))"


@R.add("file_deps", "SELECT source, list_sort(list(DISTINCT fn)) fns, CAST(sum(\"count\") AS BIGINT) n_calls FROM edges WHERE target = 'NATION_7' GROUP BY 1")
def file_deps(spark, sf):
    """What a file depends on: definers, their functions and calls."""
    return edges(spark, sf).where("target = 'NATION_7'").groupBy("source").agg(F.array_sort(F.collect_set("fn")).alias("fns"), F.sum("count").alias("n_calls"))


@R.add("dependents", "SELECT target, count(DISTINCT fn) n_fns, CAST(sum(\"count\") AS BIGINT) n_calls, (SELECT count(DISTINCT target) FROM edges WHERE source = 'NATION_7') blast_radius FROM edges WHERE source = 'NATION_7' GROUP BY 1")
def dependents(spark, sf):
    """Users of a file and its blast radius."""
    e = edges(spark, sf).where("source = 'NATION_7'")
    n = e.agg(F.countDistinct("target").alias("blast_radius"))
    return e.groupBy("target").agg(F.countDistinct("fn").alias("n_fns"), F.sum("count").alias("n_calls")).join(F.broadcast(n), F.lit(True))


@R.add("architecture", "SELECT DISTINCT layer, repo_id, path, count(*) OVER (PARTITION BY layer) n_files FROM (SELECT DISTINCT layer, repo_id, path FROM files)")
def architecture(spark, sf):
    """Files by layer, a row each beside the size of the layer; no layer is gathered in one row."""
    f = files(spark, sf).select("layer", "repo_id", "path").dropDuplicates()
    return f.join(f.groupBy("layer").agg(F.count("*").alias("n_files")), "layer")


@R.add("layer_counts", "SELECT repo_id, layer, count(*) n_files, CAST(sum(\"lines\") AS BIGINT) n_lines FROM files GROUP BY 1, 2")
def layer_counts(spark, sf):
    return files(spark, sf).groupBy("repo_id", "layer").agg(F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"))


@R.add("hotspots", f"WITH {_DEG} SELECT path, fan_in, complexity, \"lines\", CAST(floor(40.0 * fan_in / (SELECT greatest(max(fan_in), 1) FROM g) + 40.0 * complexity / (SELECT greatest(max(complexity), 1) FROM g) + 20.0 * \"lines\" / (SELECT greatest(max(\"lines\"), 1) FROM g) + 0.5) AS BIGINT) score FROM g")
def hotspots(spark, sf):
    return M.hotspots(gfiles(spark, sf), edges(spark, sf))


@R.add("code_hotspots", "SELECT repo_id, path, complexity, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, \"lines\" DESC, path, file_id) rank FROM files WHERE is_code) WHERE rank <= 5")
def code_hotspots(spark, sf):
    """Five most complex files of each repository."""
    w = W.partitionBy("repo_id").orderBy(F.desc("complexity"), F.desc("lines"), "path", "file_id")
    return files(spark, sf).where("is_code").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("repo_id", "path", "complexity", "rank")


@R.add("file_metrics", "SELECT f.file_id, f.path, f.\"lines\", f.complexity, coalesce(n, 0) n_functions FROM files f LEFT JOIN (SELECT repo_id, file, count(*) n FROM functions GROUP BY 1, 2) x ON x.repo_id = f.repo_id AND x.file = f.path")
def file_metrics(spark, sf):
    n = functions(spark, sf).groupBy("repo_id", F.col("file").alias("path")).agg(F.count("*").alias("n"))
    return files(spark, sf).join(n, ["repo_id", "path"], "left").select("file_id", "path", "lines", "complexity", F.coalesce("n", F.lit(0).cast("long")).alias("n_functions"))


@R.add("complexity_grades", "SELECT CASE WHEN complexity > 30 THEN 'F' WHEN complexity > 20 THEN 'D' WHEN complexity > 10 THEN 'C' WHEN complexity > 5 THEN 'B' ELSE 'A' END grade, count(*) n FROM files WHERE is_code GROUP BY 1")
def complexity_grades(spark, sf):
    return files(spark, sf).where("is_code").groupBy(S.complexity_grade(F.col("complexity")).alias("grade")).agg(F.count("*").alias("n"))


@R.add("god_files", "SELECT repo_id, file, count(*) n_functions FROM functions GROUP BY 1, 2 HAVING count(*) > 4")
def god_files(spark, sf):
    return functions(spark, sf).groupBy("repo_id", "file").agg(F.count("*").alias("n_functions")).where("n_functions > 4")


@R.add("high_coupling", "SELECT target, count(*) n FROM edges GROUP BY 1 HAVING count(*) > 30")
def high_coupling(spark, sf):
    return edges(spark, sf).groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") > M.MAX_COUPLING_IN)


_CALLS = r"""defs AS (SELECT repo_id, name fn, file source FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY fn_id) rn FROM functions) WHERE rn = 1),
 called AS (SELECT repo_id, path target, fn, count(*) "count" FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) fn FROM files WHERE is_code AND content IS NOT NULL) GROUP BY 1, 2, 3)"""


@R.add("call_edges", f"WITH {_CALLS} SELECT c.repo_id, source, target, c.fn, \"count\" FROM called c JOIN defs d ON c.repo_id = d.repo_id AND c.fn = d.fn WHERE source <> target")
def call_edges(spark, sf):
    return M.call_edges(contents(spark, sf), functions(spark, sf))


@R.add("unused", rf"""WITH {_CALLS} SELECT fn_id, repo_id, file, name, line FROM functions f WHERE is_top_level AND NOT coalesce(is_class_method, false) AND coalesce(len(decorators), 0) = 0
 AND name NOT IN ('main', 'create_app', 'make_app', 'get_app', 'setup', 'configure', 'register', 'on_startup', 'on_shutdown', 'lifespan', 'setUp', 'tearDown', 'setUpClass', 'tearDownClass') AND NOT regexp_matches(name, '^__.*__$|^test_') AND NOT {_TEST.replace('path', 'file')}
 AND NOT (coalesce(is_exported, false) AND regexp_matches(file, '\.[jt]sx?$')) AND NOT EXISTS (SELECT 1 FROM called c JOIN defs d ON c.repo_id = d.repo_id AND c.fn = d.fn WHERE source <> target AND c.repo_id = f.repo_id AND c.fn = f.name)""")
def unused(spark, sf):
    f = functions(spark, sf)
    return M.dead_functions(f, M.call_edges(contents(spark, sf), f).select("repo_id", F.col("fn").alias("name")))


@R.add("stale", f"""WITH t AS (SELECT DISTINCT repo_id, unnest(string_split(regexp_replace(lower(regexp_replace(path, '^.*/', '')), '[^a-z0-9]+', ' ', 'g'), ' ')) w FROM files WHERE {_TEST}), u AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]+$', '')), '[^a-z0-9]+', ' ', 'g') st FROM files WHERE is_code AND coupling_in >= 1 AND NOT {_TEST}),
 h AS (SELECT u.file_id, bool_or(t.w IS NOT NULL) tested FROM (SELECT file_id, repo_id, unnest(string_split(st, ' ')) w FROM u) u LEFT JOIN t ON t.repo_id = u.repo_id AND t.w = u.w AND length(u.w) >= 3 GROUP BY 1)
 SELECT u.file_id, coupling_in fan_in, churn, tested, CAST(floor(100 * (0.4 * (1 - churn / (SELECT greatest(max(churn), 1) FROM files WHERE NOT {_TEST})) + 0.35 * least(coupling_in / 20.0, 1.0) + CASE WHEN tested THEN 0 ELSE 0.25 END) + 0.5) AS BIGINT) score FROM u JOIN h USING (file_id)""")
def stale(spark, sf):
    f = files(spark, sf).where(F.coalesce("is_code", F.lit(False)) | S.is_test(F.col("path")))
    return M.stale_files(f.withColumn("fan_in", F.col("coupling_in")), files(spark, sf)).select("file_id", "fan_in", "churn", "tested", "score")


_RISK = f"""WITH {_DEG}, lv AS (SELECT r_name layer, r_regionkey * 2 level FROM region), vi AS (SELECT DISTINCT e.source FROM edges e JOIN gfiles a ON a.path = e.source JOIN gfiles b ON b.path = e.target JOIN lv x ON x.layer = a.layer JOIN lv y ON y.layer = b.layer WHERE y.level - x.level > 1),
 s AS (SELECT layer, least(100, floor(500.0 * sum(fan_in) / (SELECT count(*) FROM g) + 0.5)) blast, least(100, 5 * avg(complexity)) cx, least(100, avg(churn)) churn, least(100, 20 * count(vi.source)) violations FROM g LEFT JOIN vi ON vi.source = g.path GROUP BY 1),
 t AS (SELECT layer change_set, round(0.35 * blast + 0.25 * cx + 0.20 * churn + 0.20 * violations, 4) score FROM s)"""


@R.add("change_risk", _RISK + " SELECT change_set, score, CASE WHEN score <= 33 THEN 'low' WHEN score <= 66 THEN 'medium' ELSE 'high' END level FROM t")
def change_risk(spark, sf):
    """Risk of each change set (the files of a region): blast radius, complexity, churn and violations, each capped, and the level."""
    g, e = gfiles(spark, sf), edges(spark, sf)
    levels = F.broadcast(load(spark, sf, "region").select(F.col("r_name").alias("layer"), (F.col("r_regionkey") * 2).alias("level")))
    lv = g.select("path", "layer").join(levels, "layer").select("path", "level")
    bad = e.select("source", "target").join(lv.withColumnRenamed("path", "source").withColumnRenamed("level", "a"), "source").join(lv.withColumnRenamed("path", "target").withColumnRenamed("level", "b"), "target").where("b - a > 1").select(F.col("source").alias("path")).dropDuplicates()
    return M.change_risk(M.with_degrees(g, e).withColumn("change_set", F.col("layer")), bad)


@R.add("surprising_connections", """WITH x AS (SELECT e.source, e.target, a.layer source_layer, b.layer target_layer FROM edges e JOIN gfiles a ON a.path = e.source JOIN gfiles b ON b.path = e.target WHERE a.layer <> b.layer)
 SELECT DISTINCT source, target, source_layer, target_layer, pair_count, floor(1000.0 * (1 - pair_count / (SELECT count(*) FROM x)) + 0.5) / 10 rarity FROM x JOIN (SELECT source_layer, target_layer, count(*) pair_count FROM x GROUP BY 1, 2) USING (source_layer, target_layer)""")
def surprising_connections(spark, sf):
    return M.rare_connections(gfiles(spark, sf), edges(spark, sf))


@R.add("knowledge_gaps", f"""WITH d AS (SELECT path, CAST(sum(i) AS BIGINT) fan_in, CAST(sum(o) AS BIGINT) fan_out FROM (SELECT source path, 1 o, 0 i FROM links UNION ALL SELECT target, 0, 1 FROM links) GROUP BY 1), e AS (SELECT lower(trim(id)) path, min(type) layer FROM entities WHERE type IS NOT NULL GROUP BY 1), g AS (SELECT e.*, coalesce(fan_in, 0) fan_in, coalesce(fan_out, 0) fan_out FROM e LEFT JOIN d USING (path))
 SELECT 'isolated' kind, path item FROM g WHERE fan_in + fan_out = 0 UNION ALL SELECT 'untested_hotspot', path FROM g WHERE fan_in > 5 UNION ALL SELECT 'weak_layer', layer FROM g GROUP BY layer HAVING count(*) < 3 AND sum(fan_out) > 5""")
def knowledge_gaps(spark, sf):
    e = entities(spark, sf).where("type is not null").groupBy(F.lower(F.btrim("id")).alias("path")).agg(F.min("type").alias("layer"))
    return M.knowledge_gaps(e, links(spark, sf))


@R.add("suggested_questions", f"""WITH {_DEG} (SELECT 1 ord, 'Why do ' || fan_in || ' edges lead to ' || path || '?' question FROM g ORDER BY fan_in DESC, path LIMIT 1) UNION ALL (SELECT 2, 'What makes ' || path || ' so complex?' FROM g ORDER BY complexity DESC, path LIMIT 1) UNION ALL (SELECT 3, 'Who changes ' || path || ' so often?' FROM g ORDER BY churn DESC, path LIMIT 1)""")
def suggested_questions(spark, sf):
    g = M.with_degrees(gfiles(spark, sf), edges(spark, sf))
    one = lambda k, by, text, *cols: g.orderBy(F.desc(by), "path").limit(1).select(F.lit(k).alias("ord"), F.format_string(text, *cols).alias("question"))
    return one(1, "fan_in", "Why do %d edges lead to %s?", "fan_in", "path").unionByName(one(2, "complexity", "What makes %s so complex?", "path")).unionByName(one(3, "churn", "Who changes %s so often?", "path")).limit(10)


@R.add("rules_check", "SELECT 'ASIA' rule_from, '*' rule_to, source, target, fn FROM edges JOIN gfiles ON path = source WHERE layer = 'ASIA' UNION ALL SELECT 'EUROPE', 'AFRICA', source, target, fn FROM edges JOIN gfiles a ON a.path = source JOIN gfiles b ON b.path = target WHERE a.layer = 'EUROPE' AND b.layer = 'AFRICA'")
def rules_check(spark, sf):
    rules = spark.createDataFrame([("ASIA", "*"), ("EUROPE", "AFRICA")], "`from` string, `to` string")
    return M.rule_violations(gfiles(spark, sf), edges(spark, sf), rules)


_LV = "(VALUES ('config', 0), ('util', 1), ('utils', 1), ('helper', 1), ('lib', 1), ('core', 1), ('data', 2), ('model', 2), ('classes', 2), ('service', 3), ('services', 3), ('api', 3), ('feature', 3), ('modules', 4), ('component', 4), ('components', 4), ('ui', 5), ('page', 5), ('view', 5), ('presentation', 5), ('forms', 5), ('test', 6)) l(layer, level)"


@R.add("layer_violations", f"""WITH {_CALLS}, ce AS (SELECT c.repo_id || ':' || source source, c.repo_id || ':' || target target, c.fn FROM called c JOIN defs d ON c.repo_id = d.repo_id AND c.fn = d.fn WHERE source <> target),
 lv AS (SELECT DISTINCT repo_id || ':' || path path, files.layer, level FROM files JOIN {_LV} ON l.layer = lower(files.layer)) SELECT source, a.layer source_layer, target, b.layer target_layer, fn FROM ce JOIN lv a ON a.path = source JOIN lv b ON b.path = target WHERE a.level < b.level AND b.level - a.level > 1""")
def layer_violations(spark, sf):
    f = files(spark, sf)
    ce = M.call_edges(contents(spark, sf), functions(spark, sf))
    full = lambda c: F.concat("repo_id", F.lit(":"), c)
    e = ce.select(full("source").alias("source"), full("target").alias("target"), "fn")
    return M.layer_violations(f.select(full("path").alias("path"), "layer").dropDuplicates(), e)


@R.add("contributors", "SELECT coalesce(top_contributor, 'unknown') owner, count(*) n_files, CAST(sum(churn) AS BIGINT) churn, CAST(sum(coupling_out) AS BIGINT) impact, count(*) FILTER (contributor_count = 1 AND churn >= 5) bus_factor_files FROM files GROUP BY 1")
def contributors(spark, sf):
    return files(spark, sf).groupBy(F.coalesce("top_contributor", F.lit("unknown")).alias("owner")).agg(F.count("*").alias("n_files"), F.sum("churn").alias("churn"), F.sum("coupling_out").alias("impact"), F.count_if((F.col("contributor_count") == 1) & (F.col("churn") >= 5)).alias("bus_factor_files"))


@R.add("confidence", """WITH c AS (SELECT source, target, n, CASE WHEN EXISTS (SELECT 1 FROM relations r WHERE r.src = source AND r.dst = target AND lower(trim(r.type)) = 'imports') THEN CAST(1 AS DOUBLE) WHEN n >= 3 THEN 0.6 ELSE 0.4 END confidence FROM links)
 SELECT confidence, count(*) n_edges, round(100.0 * count(*) / (SELECT count(*) FROM c), 2) pct FROM c GROUP BY 1""")
def confidence(spark, sf):
    """How many edges have which confidence: explicit imports, frequent ones, others."""
    e = links(spark, sf).withColumnRenamed("n", "count").withColumn("fn", F.lit(""))
    i = relations(spark, sf).where(F.lower(F.btrim("type")) == "imports").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    c = M.confidence(None, e, i).groupBy("confidence").agg(F.count("*").alias("n_edges"))
    n = c.agg(F.sum("n_edges").alias("n"))
    return c.join(F.broadcast(n), F.lit(True)).select("confidence", "n_edges", F.round(100.0 * F.col("n_edges") / F.col("n"), 2).alias("pct"))


@R.add("pr_comment", "SELECT target, count(*) n FROM edges WHERE source IN (SELECT path FROM gfiles WHERE layer = 'ASIA') AND target NOT IN (SELECT path FROM gfiles WHERE layer = 'ASIA') GROUP BY 1 ORDER BY n DESC, target LIMIT 10")
def pr_comment(spark, sf):
    """Files outside a change set that use it most."""
    c = gfiles(spark, sf).where("layer = 'ASIA'").select("path")
    e = edges(spark, sf).join(c.withColumnRenamed("path", "source"), "source", "left_semi").join(c.withColumnRenamed("path", "target"), "target", "left_anti")
    return e.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(10)


@R.add("minimal_context", f"""WITH {_DEG} (SELECT 'language' kind, language item, n FROM (SELECT language, count(*) n FROM files WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, language LIMIT 3)) UNION ALL (SELECT 'hub', path, fan_in FROM g ORDER BY fan_in DESC, path LIMIT 3) UNION ALL (SELECT 'layer', layer, n FROM (SELECT layer, count(*) n FROM files GROUP BY 1 ORDER BY n DESC, layer LIMIT 4))""")
def minimal_context(spark, sf):
    f = files(spark, sf)
    lang = f.where("language is not null").groupBy(F.col("language").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(3).select(F.lit("language").alias("kind"), "item", "n")
    hub = M.with_degrees(gfiles(spark, sf), edges(spark, sf)).orderBy(F.desc("fan_in"), "path").limit(3).select(F.lit("hub").alias("kind"), F.col("path").alias("item"), F.col("fan_in").alias("n"))
    lay = f.groupBy(F.col("layer").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(4).select(F.lit("layer").alias("kind"), "item", "n")
    return lang.unionByName(hub).unionByName(lay)


@R.add("architecture_overview", f"WITH {_DEG}, r AS (SELECT layer, path, fan_in + fan_out total, row_number() OVER (PARTITION BY layer ORDER BY fan_in + fan_out DESC, path) rank FROM g) SELECT layer, path, total, rank, (SELECT count(*) FROM edges JOIN gfiles a ON a.path = source JOIN gfiles b ON b.path = target WHERE a.layer = r.layer AND b.layer <> r.layer) cross_edges FROM r WHERE rank <= 3")
def architecture_overview(spark, sf):
    """Three hubs of each layer, with the edges that leave the layer."""
    g, e = gfiles(spark, sf), edges(spark, sf)
    r = M.with_degrees(g, e).withColumn("total", F.col("fan_in") + F.col("fan_out")).withColumn("rank", F.row_number().over(W.partitionBy("layer").orderBy(F.desc("total"), "path")).cast("long")).where("rank <= 3")
    out = e.join(g.select(F.col("path").alias("source"), F.col("layer").alias("layer")), "source").join(g.select(F.col("path").alias("target"), F.col("layer").alias("tl")), "target").where("layer <> tl").groupBy("layer").agg(F.count("*").alias("cross_edges"))
    return r.join(out, "layer", "left").select("layer", "path", "total", "rank", F.coalesce("cross_edges", F.lit(0).cast("long")).alias("cross_edges"))


@R.add("onboard", f"WITH {_DEG} SELECT path, layer, CAST(CASE layer WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END * 1000 - fan_in AS BIGINT) score FROM g WHERE contains(path, '1')")
def onboard(spark, sf):
    """Reading order: by layer, then by use."""
    order = F.when(F.col("layer") == "EUROPE", 0).when(F.col("layer") == "ASIA", 1).otherwise(2)
    return M.with_degrees(gfiles(spark, sf), edges(spark, sf)).where(F.contains("path", F.lit("1"))).select("path", "layer", (order * 1000 - F.col("fan_in")).cast("long").alias("score"))


@R.add("subsystems", "SELECT a.s source_subsystem, b.s target_subsystem, count(*) n FROM edges JOIN (SELECT path, CASE WHEN path LIKE 'NATION\\_1%' ESCAPE '\\' THEN 'one' WHEN path LIKE 'NATION\\_2%' ESCAPE '\\' THEN 'two' END s FROM gfiles) a ON a.path = source JOIN (SELECT path, CASE WHEN path LIKE 'NATION\\_1%' ESCAPE '\\' THEN 'one' WHEN path LIKE 'NATION\\_2%' ESCAPE '\\' THEN 'two' END s FROM gfiles) b ON b.path = target WHERE a.s <> b.s GROUP BY 1, 2")
def subsystems(spark, sf):
    """Edges between subsystems, which are path prefixes, the first that matches counts."""
    sub = lambda c: F.when(c.startswith("NATION_1"), "one").when(c.startswith("NATION_2"), "two")
    e = edges(spark, sf).select(sub(F.col("source")).alias("source_subsystem"), sub(F.col("target")).alias("target_subsystem"))
    return e.where("source_subsystem <> target_subsystem").groupBy("source_subsystem", "target_subsystem").agg(F.count("*").alias("n"))


@R.add("diff_symbols", "WITH h AS (SELECT repo_id, path, churn + 1 start, churn + 8 stop FROM files WHERE churn > 0) SELECT DISTINCT f.fn_id FROM functions f JOIN h ON h.repo_id = f.repo_id AND h.path = f.file AND f.line BETWEEN start - 5 AND stop + 5")
def diff_symbols(spark, sf):
    """Functions within five lines of a changed range: an equality on the file with a range on the line."""
    h = files(spark, sf).where("churn > 0").select("repo_id", F.col("path").alias("file"), (F.col("churn") + 1).alias("start"), (F.col("churn") + 8).alias("stop"))
    j = functions(spark, sf).join(h, ["repo_id", "file"]).where("line between start - 5 and stop + 5")
    return j.select("fn_id").dropDuplicates()


@R.add("detect_changes", "WITH h AS (SELECT repo_id, path, churn + 1 start, churn + 8 stop FROM files WHERE churn > 0), t AS (SELECT repo_id, count(DISTINCT fn_id) n FROM functions f JOIN h USING (repo_id) WHERE h.path = f.file AND f.line BETWEEN start AND stop GROUP BY 1) SELECT repo_id, n, CASE WHEN n > 20 THEN 'CRITICAL' WHEN n > 10 THEN 'HIGH' WHEN n > 3 THEN 'MEDIUM' ELSE 'LOW' END risk FROM t")
def detect_changes(spark, sf):
    h = files(spark, sf).where("churn > 0").select("repo_id", F.col("path").alias("file"), (F.col("churn") + 1).alias("start"), (F.col("churn") + 8).alias("stop"))
    t = functions(spark, sf).join(h, ["repo_id", "file"]).where("line between start and stop").groupBy("repo_id").agg(F.countDistinct("fn_id").alias("n"))
    return t.withColumn("risk", S.ladder(F.col("n"), [(20, "CRITICAL"), (10, "HIGH"), (3, "MEDIUM")], "LOW", strict=True))


@R.add("org_graph", "WITH l AS (SELECT DISTINCT repo_id, unnest(imports) lib FROM files), s AS (SELECT lib FROM l GROUP BY 1 HAVING count(DISTINCT repo_id) >= 3) SELECT lib, count(DISTINCT repo_id) n_repos FROM l JOIN s USING (lib) GROUP BY 1")
def org_graph(spark, sf):
    """Libraries that three or more repositories share."""
    return files(spark, sf).select("repo_id", F.explode("imports").alias("lib")).dropDuplicates().groupBy("lib").agg(F.countDistinct("repo_id").alias("n_repos")).where("n_repos >= 3")


@R.add("wiki", "SELECT repo_id, split_part(path, '/', 1) page, count(*) n_files, CAST(sum(\"lines\") AS BIGINT) n_lines FROM files GROUP BY 1, 2")
def wiki(spark, sf):
    """Pages by top folder."""
    return files(spark, sf).groupBy("repo_id", F.substring_index("path", "/", 1).alias("page")).agg(F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"))


@R.add("skillmd", "SELECT repo_id, string_agg(name, ', ' ORDER BY name, fn_id) exports FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name, fn_id) rn FROM functions WHERE is_exported) WHERE rn <= 12 GROUP BY 1")
def skillmd(spark, sf):
    """Twelve exports of each repository as one line."""
    f = functions(spark, sf).where("is_exported").withColumn("rn", F.row_number().over(W.partitionBy("repo_id").orderBy("name", "fn_id"))).where("rn <= 12")
    return f.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "fn_id"))), lambda x: x["name"]), ", ").alias("exports"))


@R.add("hooks", "SELECT source, CAST(sum(\"count\") AS BIGINT) n_calls FROM edges GROUP BY 1 HAVING sum(\"count\") >= 1000 ORDER BY 2 DESC, 1 LIMIT 20")
def hooks(spark, sf):
    """Critical files whose change should warn."""
    return edges(spark, sf).groupBy("source").agg(F.sum("count").alias("n_calls")).where("n_calls >= 1000").orderBy(F.desc("n_calls"), "source").limit(20)


@R.add("config_check", "SELECT source, count(DISTINCT target) blast_radius FROM edges GROUP BY 1 HAVING count(DISTINCT target) > 20")
def config_check(spark, sf):
    return edges(spark, sf).groupBy("source").agg(F.countDistinct("target").alias("blast_radius")).where("blast_radius > 20")


@R.add("jira_issues", "WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) w FROM documents WHERE source = 'forum') SELECT w AS stem, count(*) n FROM w WHERE w IN ('cache', 'parser', 'router') GROUP BY 1")
def jira_issues(spark, sf):
    w = load(spark, sf, "documents").where("source = 'forum'").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))).alias("stem"))
    return w.where(F.col("stem").isin("cache", "parser", "router")).groupBy("stem").agg(F.count("*").alias("n"))


@R.add("refactor", "SELECT file_id, path, 'split ' || name || ' (' || complexity || ')' step FROM files WHERE is_code AND complexity > 20")
def refactor(spark, sf):
    return files(spark, sf).where("is_code and complexity > 20").select("file_id", "path", F.format_string("split %s (%d)", "name", "complexity").alias("step"))
