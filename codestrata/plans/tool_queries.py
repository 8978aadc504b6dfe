"""Reports of operators/tools on the files at hand, with SQL written from their descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import exports as X, graph as G, lines as L, metrics as M, tools as T
from codestrata.operators.snapshots import snapshot_changes
from codestrata.plans import code_queries as C, metric_queries as MQ
from codestrata.plans.bindings import Registry, chunks, contents, edges, entities, files, functions, gfiles, links, relations
from codestrata.plans.data_queries import _P1
from codestrata.plans.search_queries import kg_hubs
from codestrata.session import load

R = Registry()
QUERIES, SQL = R.queries, R.sql
_CF = "cf AS (SELECT f.*, coalesce(x.n, 0) nf FROM files f LEFT JOIN (SELECT repo_id, file, count(*) n FROM functions GROUP BY 1, 2) x ON x.repo_id = f.repo_id AND x.file = f.path)"
_SEC = L.scan_sql(L.SECURITY).replace("ln AS", "sl AS").replace("FROM ln", "FROM sl").replace("hits AS", "sh AS")
_TEST = MQ._TEST
_DEAD = "dead AS (SELECT * FROM (" + MQ.SQL["unused"] + "))"
_LOOPS = f"{C._IE}, cl(repo_id, a, b) USING KEY (repo_id, a, b) AS (SELECT repo_id, source, target FROM ie UNION SELECT cl.repo_id, cl.a, ie.target FROM cl JOIN ie ON ie.repo_id = cl.repo_id AND ie.source = cl.b LEFT JOIN recurring.cl x ON x.repo_id = cl.repo_id AND x.a = cl.a AND x.b = ie.target WHERE x.b IS NULL), lo AS (SELECT repo_id, a path FROM cl WHERE a = b)"


def _code_files(spark, sf):
    return T.code_files(files(spark, sf), functions(spark, sf))


def _findings(spark, sf):
    return L.scan(contents(spark, sf), ["file_id", "repo_id", "path"], L.SECURITY).select("file_id", "repo_id", T.severity(F.col("tag")).alias("severity"))


def _dead(spark, sf):
    f = functions(spark, sf)
    return M.dead_functions(f, M.call_edges(contents(spark, sf), f).select("repo_id", F.col("fn").alias("name")))


def _cyclic(spark, sf):
    """(repo_id, path, component) of the files on import cycles."""
    i = C._file_imports(spark, sf)
    e = i.select(F.concat_ws("\u0000", "repo_id", "source").alias("source"), F.concat_ws("\u0000", "repo_id", "target").alias("target"))
    n = F.split("node", "\u0000")
    return G.strong_components(e).select(n[0].alias("repo_id"), n[1].alias("path"), "component")


@R.add("metrics", f"WITH {_CF} SELECT file_id, path, \"lines\", nf n_functions, complexity, coalesce(nesting_depth, 0) nesting, coupling_in fan_in, coupling_out fan_out, churn FROM cf")
def metrics(spark, sf):
    return T.file_metrics(files(spark, sf), functions(spark, sf))


@R.add("suggest", f"""WITH {_CF}, {_SEC}, {_DEAD}, {_LOOPS},
 s AS (SELECT 'god_file' kind, file_id, 3 w FROM cf WHERE nf > 50 UNION ALL SELECT 'fan_in', file_id, 2 FROM cf WHERE coupling_in > 30 UNION ALL SELECT 'complexity', file_id, 3 FROM cf WHERE complexity > 30
  UNION ALL SELECT DISTINCT 'security', file_id, 3 FROM sh WHERE starts_with(tag, 'high:') UNION ALL SELECT 'dead_code', file_id, 1 FROM cf JOIN (SELECT repo_id, file, count(*) n FROM dead GROUP BY 1, 2 HAVING count(*) > 5) d ON d.repo_id = cf.repo_id AND d.file = cf.path
  UNION ALL SELECT 'cycle', file_id, 3 FROM cf JOIN lo ON lo.repo_id = cf.repo_id AND lo.path = cf.path),
 v AS (SELECT kind, file_id, path, CAST(least(100, floor(3 * coupling_in + 0.5 * nf + 0.2 * churn + 0.5)) AS BIGINT) effort, CAST(least(100, floor(20.0 * w + 2 * coupling_in + 0.5)) AS BIGINT) impact FROM s JOIN cf USING (file_id) WHERE is_code)
 SELECT *, floor(impact / greatest(effort, 1) * 100 + 0.5) / 100 ratio FROM v""")
def suggest(spark, sf):
    f = _code_files(spark, sf)
    by_path = f.select("file_id", "repo_id", "path")
    dead = _dead(spark, sf).withColumnRenamed("file", "path").join(by_path, ["repo_id", "path"])
    return T.suggestions(f, _findings(spark, sf), dead, _cyclic(spark, sf).join(by_path, ["repo_id", "path"]))


@R.add("health_score", f"""WITH {_CF}, {_SEC}, {_DEAD}, {_LOOPS}, x AS (SELECT repo_id, count(*) FILTER (is_code) n_files, count(*) FILTER (nf > 50 AND NOT starts_with(name, 'index.')) god, count(*) FILTER (coupling_in > 30) coupled FROM cf GROUP BY 1),
 h AS (SELECT repo_id, count(*) high FROM sh WHERE starts_with(tag, 'high:') GROUP BY 1), d AS (SELECT repo_id, count(*) dead FROM dead GROUP BY 1), n AS (SELECT repo_id, count(*) n_fn FROM functions GROUP BY 1), cy AS (SELECT repo_id, count(DISTINCT least_path) cycles FROM (SELECT cl.repo_id, cl.a, min(cl.b) least_path FROM cl JOIN cl r ON r.repo_id = cl.repo_id AND r.a = cl.b AND r.b = cl.a GROUP BY 1, 2) GROUP BY 1),
 v AS (SELECT x.repo_id, coalesce(cycles, 0) cycles, coalesce(high, 0) high, god, coupled, coalesce(dead, 0) dead, CAST(CASE WHEN n_files = 0 THEN 100 ELSE greatest(0, 100 - least(30, 5 * coalesce(cycles, 0)) - least(20, 4 * coalesce(high, 0)) - least(15, 3 * god) - least(10, 2 * coupled) - least(10, floor(30.0 * coalesce(dead, 0) / greatest(coalesce(n_fn, 0), 1) + 0.5))) END AS BIGINT) score FROM x LEFT JOIN h USING (repo_id) LEFT JOIN d USING (repo_id) LEFT JOIN n USING (repo_id) LEFT JOIN cy USING (repo_id))
 SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END grade FROM v""")
def health_score(spark, sf):
    """Score and grade per repository, with what they are made of."""
    cycles = _cyclic(spark, sf).select("repo_id", "component").dropDuplicates()
    return T.repository_health(_code_files(spark, sf), functions(spark, sf), _findings(spark, sf), _dead(spark, sf), cycles)


_BARE = "regexp_replace(lower(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]+$', '')), '^test_|_test$|\\.test$|\\.spec$', '')"


@R.add("good_first_issues", f"WITH {_CF}, t AS (SELECT DISTINCT repo_id, {_BARE} stem FROM files WHERE {_TEST}) SELECT file_id, repo_id, path, nf n_functions FROM cf WHERE is_code AND coupling_in <= 2 AND coupling_out <= 3 AND nf < 10 AND churn <= 2 AND NOT {_TEST} AND NOT EXISTS (SELECT 1 FROM t WHERE t.repo_id = cf.repo_id AND t.stem = lower(regexp_replace(regexp_replace(cf.path, '^.*/', ''), '\\.[^.]+$', '')))")
def good_first_issues(spark, sf):
    return T.first_issues(_code_files(spark, sf))


@R.add("coverage_gaps", f"WITH {C._IE}, {C._CV} SELECT f.repo_id, g.folder, count(*) n_functions, count(c.fn_id) n_covered, count(*) FILTER (c.fn_id IS NULL AND g.churn >= (SELECT greatest(3, floor(0.4 * max(churn))) FROM files)) n_risky, round(100.0 * count(c.fn_id) / count(*), 2) pct FROM functions f JOIN files g ON g.repo_id = f.repo_id AND g.path = f.file LEFT JOIN (SELECT DISTINCT fn_id FROM cv) c ON c.fn_id = f.fn_id GROUP BY 1, 2")
def coverage_gaps(spark, sf):
    return T.coverage_gaps(files(spark, sf), functions(spark, sf), C._tests(spark, sf)[1])


_LIKE = "load%"


@R.add("api_impact", f"WITH {C._CN}, f AS (SELECT DISTINCT repo_id, name, file FROM functions WHERE name ILIKE '{_LIKE}'), c AS (SELECT cn.repo_id, cn.fn, count(DISTINCT cn.source) n FROM cn WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo_id = cn.repo_id AND f.name = cn.fn AND f.file = cn.source) GROUP BY 1, 2) SELECT f.repo_id, f.name, count(f.file) n_files, coalesce(max(c.n), 0) n_callers, CAST(least(100, 10 * count(f.file) + 5 * coalesce(max(c.n), 0)) AS BIGINT) risk FROM f LEFT JOIN c ON c.repo_id = f.repo_id AND c.fn = f.name GROUP BY 1, 2")
def api_impact(spark, sf):
    return T.api_impact(functions(spark, sf), C._called(spark, sf), _LIKE)


@R.add("shape_check", f"WITH {C._CN}, d AS (SELECT repo_id, 'definition' kind, file path, line, fn_id, name FROM functions WHERE name ILIKE '{_LIKE}'), a AS (SELECT repo_id, kind, path, line, fn_id FROM d UNION ALL SELECT DISTINCT cn.repo_id, 'call', cn.source, NULL, NULL FROM cn JOIN (SELECT DISTINCT repo_id, name FROM d) n ON n.repo_id = cn.repo_id AND n.name = cn.fn) SELECT repo_id, kind, path, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, kind ORDER BY path NULLS FIRST, line NULLS FIRST, fn_id) rank FROM a) WHERE rank <= CASE kind WHEN 'call' THEN 50 ELSE 5 END")
def shape_check(spark, sf):
    return T.shape(functions(spark, sf), C._called(spark, sf), _LIKE)


_PC = "pc AS (SELECT * FROM (" + C.SQL["pg_calls"] + "))"


@R.add("contracts", f"""WITH {_PC}, f AS (SELECT repo_id, file provider, name fn, bool_or(coalesce(is_exported, false)) ex FROM functions WHERE file IS NOT NULL GROUP BY 1, 2, 3), u AS (SELECT repo_id, target provider, fn, sum("count") total, count(*) FILTER (source <> target) n_consumers, coalesce(sum("count") FILTER (source <> target), 0) usage FROM pc GROUP BY 1, 2, 3),
 j AS (SELECT f.*, coalesce(total, 0) total, coalesce(n_consumers, 0) n_consumers, CAST(coalesce(usage, 0) AS BIGINT) usage FROM f LEFT JOIN u USING (repo_id, provider, fn)) SELECT * FROM (SELECT repo_id, provider, fn, CASE WHEN NOT (ex OR total >= 3) AND usage > 0 THEN 'violation' WHEN (ex OR total >= 3) AND usage = 0 THEN 'orphaned' WHEN ex OR total >= 3 THEN 'used' END state, n_consumers, usage FROM j) WHERE state IS NOT NULL""")
def contracts(spark, sf):
    return T.contracts(functions(spark, sf), C.pg_calls(spark, sf))


@R.add("patch_impact", f"WITH {_P1}, {_CF} SELECT d.repo_id, d.snapshot_id sha, count(*) n_files, CAST(sum(coupling_in) AS BIGINT) impact, CAST(sum(nf) AS BIGINT) n_functions, CAST(sum(coupling_in) + sum(nf) AS BIGINT) priority FROM (SELECT DISTINCT repo_id, snapshot_id, item FROM d WHERE change IS NOT NULL AND field <> 'healthScore') d JOIN cf ON cf.repo_id = d.repo_id AND cf.path = d.item GROUP BY 1, 2")
def patch_impact(spark, sf):
    """Deliveries of snapshots as patches: the files whose entries they changed."""
    c = snapshot_changes(load(spark, sf, "snapshots")).where("field <> 'healthScore'").select("repo_id", F.col("snapshot_id").alias("sha"), F.col("item").alias("path"))
    return T.patch_impact(c, _code_files(spark, sf))


_PACKAGES = ["json", "fmt"]


@R.add("dep_impact", f"WITH {C._IE}, r(repo_id, path, distance) USING KEY (repo_id, path) AS (SELECT DISTINCT repo_id, path, 0 FROM files WHERE list_has_any(imports, ['json', 'fmt']) UNION SELECT ie.repo_id, ie.source, min(r.distance) + 1 FROM r JOIN ie ON ie.repo_id = r.repo_id AND ie.target = r.path LEFT JOIN recurring.r x ON x.repo_id = ie.repo_id AND x.path = ie.source WHERE x.path IS NULL GROUP BY 1, 2) SELECT file_id, f.repo_id, f.path, churn, distance FROM files f JOIN r ON r.repo_id = f.repo_id AND r.path = f.path")
def dep_impact(spark, sf):
    return T.dependency_impact(files(spark, sf), C._file_imports(spark, sf), _PACKAGES)


_LIB = "pl AS (SELECT DISTINCT repo_id, lib FROM (SELECT repo_id, unnest(imports) lib FROM files) WHERE NOT starts_with(lib, '.') AND repo_id IS NOT NULL)"


def _bom_sql(item: str, head: str) -> str:
    return f"WITH {_LIB}, j AS (SELECT repo_id, {item} j FROM pl), t AS (SELECT repo_id, max(j) top FROM j GROUP BY 1) SELECT repo_id, 0 ord, {head} line FROM t UNION ALL SELECT j.repo_id, 1, j || CASE WHEN j = top THEN '' ELSE ',' END FROM j JOIN t USING (repo_id) UNION ALL SELECT repo_id, 2, ']}}' FROM t"


@R.add("sbom", _bom_sql("'{\"name\":' || to_json(lib) || ',\"type\":\"library\"}'", "'{\"bomFormat\":\"CycloneDX\",\"specVersion\":\"1.4\",\"version\":1,\"components\":['"))
def sbom(spark, sf):
    return T.bill_of_materials(files(spark, sf), "cyclonedx")


@R.add("sbom_spdx", _bom_sql("'{\"name\":' || to_json(lib) || ',\"SPDXID\":\"SPDXRef-' || left(md5(lib), 12) || '\",\"downloadLocation\":\"NOASSERTION\"}'", "'{\"spdxVersion\":\"SPDX-2.3\",\"dataLicense\":\"CC0-1.0\",\"SPDXID\":\"SPDXRef-DOCUMENT\",\"name\":' || to_json(repo_id) || ',\"packages\":['"))
def sbom_spdx(spark, sf):
    return T.bill_of_materials(files(spark, sf), "spdx")


@R.add("org_summary", """WITH g AS (SELECT repo_id, avg(CASE health_grade WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 ELSE 1 END) gpa FROM files WHERE health_grade IS NOT NULL GROUP BY 1), s AS (SELECT 'grade' kind, gpa, 1 n FROM g UNION ALL SELECT 'overall', avg(gpa), count(*) FROM g)
 SELECT kind, item, CAST(sum(n) AS BIGINT) n FROM (SELECT kind, CASE WHEN gpa >= 4.5 THEN 'A' WHEN gpa >= 3.5 THEN 'B' WHEN gpa >= 2.5 THEN 'C' WHEN gpa >= 1.5 THEN 'D' ELSE 'F' END item, n FROM s) GROUP BY 1, 2
 UNION ALL SELECT 'language', language, count(*) FROM files WHERE language IS NOT NULL GROUP BY 2 UNION ALL (SELECT 'churn', repo_id || ':' || path, churn FROM files ORDER BY churn DESC, repo_id, path LIMIT 10)""")
def org_summary(spark, sf):
    return T.organisation(files(spark, sf))


@R.add("kg_trace", """WITH m AS (SELECT lower(trim(id)) id, max(mentions) mentions FROM entities WHERE lower(trim(id)) IN (SELECT source FROM links UNION SELECT target FROM links) GROUP BY 1), ab AS (SELECT id, row_number() OVER (ORDER BY mentions DESC, id) k FROM m),
 u AS (SELECT source, target FROM links UNION SELECT target, source FROM links), p(node, d, path) USING KEY (node) AS (SELECT id, 0, [id] FROM ab WHERE k = 1 UNION SELECT u.target, p.d + 1, min(list_append(p.path, u.target)) FROM p JOIN u ON u.source = p.node LEFT JOIN recurring.p x ON x.node = u.target WHERE x.node IS NULL GROUP BY u.target, p.d + 1)
 SELECT array_to_string(path, ' -> ') path, CAST(d AS BIGINT) "length" FROM p WHERE node = (SELECT id FROM ab WHERE k = 2)""")
def kg_trace(spark, sf):
    """The shortest way, in either direction, between the two most mentioned entities that have relations."""
    e = links(spark, sf)
    have = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).dropDuplicates()
    m = entities(spark, sf).groupBy(F.lower(F.btrim("id")).alias("id")).agg(F.max("mentions").alias("mentions")).join(have, "id", "left_semi")
    two = [r.id for r in m.orderBy(F.desc("mentions"), "id").limit(2).collect()]
    return G.shortest_path(G.symmetric(e), *two) if len(two) == 2 else G.shortest_path(e, "", "\u0000")


@R.add("export_csv", f"""WITH {MQ._DEG} SELECT 'connections' sheet, source || ',' || target || ',' || CAST(sum("count") AS BIGINT) line FROM edges GROUP BY source, target UNION ALL SELECT 'files', path || ',' || layer || ',' || "lines" || ',' || complexity || ',' || fan_in || ',' || fan_out FROM g UNION ALL SELECT 'issues', 'High Coupling,' || path || ',' || fan_in FROM g WHERE fan_in > 30""")
def export_csv(spark, sf):
    """Three sheets of CSV lines: files, aggregated connections, issues."""
    g = M.with_degrees(gfiles(spark, sf), edges(spark, sf))
    text = lambda *cs: F.concat_ws(",", *[X.csv_cell(c) for c in cs]).alias("line")
    a = X.export_csv(edges(spark, sf)).select(F.lit("connections").alias("sheet"), "line")
    b = g.select(F.lit("files").alias("sheet"), text("path", "layer", "lines", "complexity", "fan_in", "fan_out"))
    c = g.where(F.col("fan_in") > T.COUPLED).select(F.lit("issues").alias("sheet"), F.concat_ws(",", F.lit("High Coupling"), X.csv_cell("path"), F.col("fan_in").cast("string")).alias("line"))
    return a.unionByName(b).unionByName(c)


_HUB = "(SELECT node FROM (SELECT src node FROM relations UNION ALL SELECT dst FROM relations WHERE dst <> src) GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 1)"


@R.add("kg_explain", f"""WITH r AS (SELECT 'out' d, dst item, type, weight FROM relations WHERE src = {_HUB} UNION ALL SELECT 'in', src, type, weight FROM relations WHERE dst = {_HUB})
 (SELECT 'fact' kind, item, concat_ws(':', d, type) detail FROM r ORDER BY weight DESC NULLS LAST, item, d, type NULLS FIRST LIMIT 20) UNION ALL (SELECT 'chunk', id, doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM entities WHERE lower(trim(id)) = {_HUB}) ORDER BY doc_id, idx, id LIMIT 3)""")
def kg_explain(spark, sf):
    """Facts and texts about the best-connected entity."""
    top = [r.node for r in kg_hubs(spark, sf).limit(1).collect()] or [""]
    return T.entity_facts(relations(spark, sf), entities(spark, sf), chunks(spark, sf), top[0])


_QUESTION = "How does the cache of the graph hold a token?"


@R.add("kg_ask", """WITH k(w) AS (VALUES ('how'), ('does'), ('the'), ('cache'), ('graph'), ('hold'), ('token')), c AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w FROM chunks WHERE text IS NOT NULL) JOIN k USING (w)),
 e AS (SELECT lower(trim(id)) id, max(mentions) m FROM entities WHERE EXISTS (SELECT 1 FROM k WHERE contains(lower(name), w)) GROUP BY 1 ORDER BY m DESC NULLS LAST, 1 LIMIT 5), b AS (SELECT DISTINCT id, other FROM (SELECT src id, dst other FROM relations UNION ALL SELECT dst, src FROM relations) JOIN e USING (id))
 (SELECT 'chunk' kind, id item, CAST(count(*) AS VARCHAR) detail FROM c GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 8) UNION ALL SELECT 'entity', id, CAST(m AS VARCHAR) FROM e UNION ALL SELECT 'fact', id, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other) k FROM b) WHERE k <= 6""")
def kg_ask(spark, sf):
    return T.answer_material(_QUESTION, chunks(spark, sf), entities(spark, sf), relations(spark, sf))


@R.add("duties", f"""WITH {L.scan_sql(L.DUTIES)}, {C._IE}, p AS (SELECT file_id, bool_or(tag = 'initiate') i, bool_or(tag = 'approve') a FROM hits GROUP BY 1), o AS (SELECT file_id, CASE WHEN EXISTS (SELECT 1 FROM hits x JOIN hits y ON x.file_id = y.file_id AND x.tag = 'initiate' AND y.tag = 'approve' AND abs(x.line_no - y.line_no) <= 30 WHERE x.file_id = p.file_id) THEN 'critical' ELSE 'high' END severity FROM p WHERE i AND a)
 SELECT * FROM o UNION ALL SELECT f.file_id, 'medium' FROM (SELECT ie.repo_id, ie.source FROM ie JOIN files t ON t.repo_id = ie.repo_id AND t.path = ie.target JOIN p ON p.file_id = t.file_id GROUP BY 1, 2 HAVING bool_or(i) AND bool_or(a)) m JOIN files f ON f.repo_id = m.repo_id AND f.path = m.source WHERE f.file_id NOT IN (SELECT file_id FROM o)""")
def duties(spark, sf):
    h = L.scan(contents(spark, sf), ["file_id", "repo_id", "path"], L.DUTIES).select("file_id", "line_no", "tag")
    return T.duties(h, C._file_imports(spark, sf), files(spark, sf))


@R.add("context", f"""WITH {_CF}, {_PC}, {_SEC}, e AS (SELECT DISTINCT repo_id, source, target FROM pc WHERE source <> target), a AS (SELECT repo_id, target path, count(*) n FROM e GROUP BY 1, 2), b AS (SELECT repo_id, source path, count(*) n FROM e GROUP BY 1, 2), s AS (SELECT file_id, count(*) n FROM sh GROUP BY 1)
 SELECT cf.file_id, layer, complexity, nf n_functions, coalesce(a.n, 0) n_dependents, coalesce(b.n, 0) n_dependencies, coalesce(s.n, 0) n_findings FROM cf LEFT JOIN a ON a.repo_id = cf.repo_id AND a.path = cf.path LEFT JOIN b ON b.repo_id = cf.repo_id AND b.path = cf.path LEFT JOIN s ON s.file_id = cf.file_id""")
def context(spark, sf):
    return T.file_context(_code_files(spark, sf), C.pg_calls(spark, sf), _findings(spark, sf))


@R.add("resolve_receiver", f"WITH {C._CN}, k AS (SELECT repo_id, fn, CAST(sum(\"count\") AS BIGINT) n_calls FROM cn GROUP BY 1, 2) SELECT f.repo_id, f.name, count(DISTINCT coalesce(class_name, file)) n_owners, CASE WHEN count(DISTINCT coalesce(class_name, file)) = 1 THEN 'resolved' ELSE 'ambiguous' END state, coalesce(max(n_calls), 0) n_calls FROM functions f LEFT JOIN k ON k.repo_id = f.repo_id AND k.fn = f.name WHERE is_class_method GROUP BY 1, 2")
def resolve_receiver(spark, sf):
    """Methods by name: of one class, or ambiguous, with their calls."""
    m = functions(spark, sf).where("is_class_method").groupBy("repo_id", "name").agg(F.countDistinct(F.coalesce("class_name", "file")).alias("n_owners"))
    k = C._called(spark, sf).groupBy("repo_id", F.col("fn").alias("name")).agg(F.sum("count").alias("n_calls"))
    return m.join(k, ["repo_id", "name"], "left").select("repo_id", "name", "n_owners", F.when(F.col("n_owners") == 1, "resolved").otherwise("ambiguous").alias("state"), F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"))


@R.add("types", "SELECT f.repo_id, f.file, count(*) n_functions, count(return_type) n_typed, round(100.0 * count(return_type) / count(*), 2) pct, coalesce(max(g.coupling_in), 0) fan_in FROM functions f LEFT JOIN files g ON g.repo_id = f.repo_id AND g.path = f.file WHERE regexp_matches(f.file, '\\.(ts|tsx|py)$') GROUP BY 1, 2")
def types(spark, sf):
    """How much of each file's functions is typed, with the file's users."""
    t = functions(spark, sf).where(F.col("file").rlike(r"\.(ts|tsx|py)$")).groupBy("repo_id", F.col("file").alias("path")).agg(F.count("*").alias("n_functions"), F.count("return_type").alias("n_typed"), F.round(100.0 * F.count("return_type") / F.count("*"), 2).alias("pct"))
    g = files(spark, sf).groupBy("repo_id", "path").agg(F.max("coupling_in").alias("fan_in"))
    return t.join(g, ["repo_id", "path"], "left").select("repo_id", F.col("path").alias("file"), "n_functions", "n_typed", "pct", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


@R.add("explain", """SELECT DISTINCT 'callers' kind, source item FROM links WHERE target = (SELECT target FROM links GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1) UNION ALL SELECT DISTINCT 'callees', target FROM links WHERE source = (SELECT target FROM links GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1)""")
def explain(spark, sf):
    """All callers and callees of the node that most lead to."""
    e = links(spark, sf)
    top = [r.target for r in e.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(1).collect()] or [""]
    a = e.where(F.col("target") == top[0]).select(F.lit("callers").alias("kind"), F.col("source").alias("item")).dropDuplicates()
    return a.unionByName(e.where(F.col("source") == top[0]).select(F.lit("callees").alias("kind"), F.col("target").alias("item")).dropDuplicates())


@R.add("issues", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) w FROM documents WHERE source = 'issue_threads' AND text IS NOT NULL), m AS (SELECT DISTINCT lower(regexp_replace(name, '\\.[^.]+$', '')) stem FROM files), j AS (SELECT stem, doc_id, row_number() OVER (PARTITION BY stem ORDER BY doc_id) k, count(*) OVER (PARTITION BY stem) n FROM m JOIN w ON w = stem) SELECT stem, max(n) n_issues, list(doc_id ORDER BY doc_id) first_issues FROM j WHERE k <= 5 GROUP BY 1")
def issues(spark, sf):
    """Files that issues mention, by an equality on words rather than a search of every name in every text, with the first five issues."""
    from pyspark.sql import Window as W

    w = load(spark, sf, "documents").where("source = 'issue_threads' and text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), 1))).alias("stem")).dropDuplicates()
    j = w.join(files(spark, sf).select(F.lower(F.regexp_replace("name", r"\.[^.]+$", "")).alias("stem")).dropDuplicates(), "stem")
    n = j.groupBy("stem").agg(F.count("*").alias("n_issues"))
    five = j.withColumn("k", F.row_number().over(W.partitionBy("stem").orderBy("doc_id"))).where("k <= 5").groupBy("stem").agg(F.array_sort(F.collect_list("doc_id")).alias("first_issues"))
    return n.join(five, "stem")


@R.add("mro", f"""WITH {C._DF}, k AS (SELECT repo_id, "name", min(regexp_extract(base, '([^.]*)$', 1)) base FROM df WHERE kind = 'class' GROUP BY 1, 2), r(repo_id, "name", up, o) AS (SELECT repo_id, "name", base, ["name"] FROM k UNION ALL SELECT r.repo_id, r."name", k.base, list_append(r.o, r.up) FROM r LEFT JOIN k ON k.repo_id = r.repo_id AND k."name" = r.up WHERE r.up IS NOT NULL AND r.up <> '' AND NOT list_contains(r.o, r.up))
 SELECT repo_id, "name", arg_max(o, len(o)) linearization FROM r GROUP BY 1, 2""")
def mro(spark, sf):
    """Linearized bases of the classes found in the texts."""
    from codestrata.operators.classes import linearize

    c = C._classes(spark, sf).where("repo_id is not null").groupBy("repo_id", "name").agg(F.min(F.regexp_extract("base", r"([^.]*)$", 1)).alias("base"))
    c = c.select("repo_id", "name", F.when(F.coalesce("base", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("base")).alias("bases"), F.array().cast("array<string>").alias("methods"))
    return linearize(c).select("repo_id", "name", "linearization")


@R.add("sarif", f"""WITH {_SEC}, j AS (SELECT DISTINCT '{{"ruleId":"' || lower(regexp_replace(split_part(tag, ':', 2), '[^A-Za-z0-9]+', '-', 'g')) || '","level":"' || CASE split_part(tag, ':', 1) WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":' || to_json(split_part(tag, ':', 2)) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(path) || '}},"region":{{"startLine":' || line_no || '}}}}}}]}}' j FROM sh WHERE path IS NOT NULL)
 SELECT 0 ord, '{X.SARIF_HEAD}' line UNION ALL SELECT 1, j || CASE WHEN j = (SELECT max(j) FROM j) THEN '' ELSE ',' END FROM j UNION ALL SELECT 2, ']}}]}}'""")
def sarif(spark, sf):
    """One SARIF document of the findings, line by line."""
    return X.sarif_document(L.scan(contents(spark, sf), ["file_id", "path"], L.SECURITY).where("path is not null"))
