"""Extraction, property graph, history and store operators on the files at hand, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import security as V
from codestrata.operators import extract as E, lines as L, metrics as M, propgraph as P
from codestrata.plans import search_queries
from codestrata.plans.bindings import Registry, contents, entities, files, functions, links, relations
from codestrata.session import load, ship
from codestrata.sources import history as H

R = Registry()
QUERIES, SQL = R.queries, R.sql
_DF = E.definitions_sql()


@R.add("extract_definitions", f"WITH {_DF} SELECT file_id, kind, \"name\", base, line FROM df")
def extract_definitions(spark, sf):
    """Functions and classes of all files, from their text."""
    return E.definitions(contents(spark, sf)).select("file_id", "kind", "name", "base", "line")


@R.add("extract_agreement", f"WITH {_DF}, x AS (SELECT DISTINCT repo_id, path, \"name\" FROM df WHERE kind = 'function') SELECT count(*) n_functions, count(x.\"name\") n_found FROM (SELECT DISTINCT f.repo_id, f.file, f.name FROM functions f JOIN files g ON g.repo_id = f.repo_id AND g.path = f.file AND g.content IS NOT NULL WHERE f.file IS NOT NULL) f LEFT JOIN x ON x.repo_id = f.repo_id AND x.path = f.file AND x.\"name\" = f.name")
def extract_agreement(spark, sf):
    """How many of the functions that are given for files with a text are found in it."""
    d = E.definitions(contents(spark, sf)).where("kind = 'function'").select("repo_id", "path", "name").dropDuplicates().withColumn("hit", F.lit(1))
    have = load(spark, sf, "file_records").where("content is not null").select("repo_id", "path").dropDuplicates()
    f = functions(spark, sf).select("repo_id", F.col("file").alias("path"), "name").where("path is not null").dropDuplicates().join(have, ["repo_id", "path"], "left_semi")
    return f.join(d, ["repo_id", "path", "name"], "left").agg(F.count("*").alias("n_functions"), F.count("hit").alias("n_found"))


_SEC = L.scan_sql(L.SECURITY).replace("ln AS", "sl AS").replace("FROM ln", "FROM sl").replace("hits AS", "sh AS")


@R.add("analyze", f"WITH {_DF}, {_SEC}, d AS (SELECT repo_id, count(*) FILTER (kind = 'function') n_functions, count(*) FILTER (kind = 'class') n_classes FROM df GROUP BY 1), c AS (SELECT repo_id, CAST(sum(len(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\('))) AS BIGINT) n_calls FROM files WHERE is_code AND content IS NOT NULL GROUP BY 1), s AS (SELECT repo_id, count(*) n_findings FROM sh GROUP BY 1)\n SELECT f.repo_id, n_files, n_lines, coalesce(n_functions, 0) n_functions, coalesce(n_classes, 0) n_classes, coalesce(n_calls, 0) n_calls, coalesce(n_findings, 0) n_findings FROM (SELECT repo_id, count(*) n_files, CAST(sum(\"lines\") AS BIGINT) n_lines FROM files GROUP BY 1) f LEFT JOIN d USING (repo_id) LEFT JOIN c USING (repo_id) LEFT JOIN s USING (repo_id)")
def analyze(spark, sf):
    """A scan of every repository from its texts: files, lines, functions, classes, calls and findings."""
    t = contents(spark, sf)
    d = E.definitions(t).groupBy("repo_id").agg(F.count_if(F.col("kind") == "function").alias("n_functions"), F.count_if(F.col("kind") == "class").alias("n_classes"))
    c = t.where("is_code and content is not null").select("file_id", "repo_id", F.regexp_count("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\(")).alias("n")).dropDuplicates(["file_id"]).groupBy("repo_id").agg(F.sum("n").cast("long").alias("n_calls"))
    s = L.scan(t, ["file_id", "repo_id", "path"], L.SECURITY).groupBy("repo_id").agg(F.count("*").alias("n_findings"))
    f = files(spark, sf).groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"))
    for x in (d, c, s):
        f = f.join(x, "repo_id", "left")
    return f.na.fill(0, ["n_functions", "n_classes", "n_calls", "n_findings"])


@R.add("parse_imports", f"WITH {E.imports_sql()} SELECT file_id, language, spec, is_std FROM im")
def parse_imports(spark, sf):
    """What the import lines of all files name."""
    return E.imports(contents(spark, sf)).select("file_id", "language", "spec", "is_std")


# -- property graph
def _file_imports(spark, sf):
    return P.import_edges(load(spark, sf, "file_records"))


_TRIES = [*P.SUFFIXES, ".py", "/__init__.py", ".java", ".go", ".c", ".h"]
_IE = r"""fi AS (SELECT DISTINCT ON (repo_id, path) repo_id, path, imports FROM file_records), isp AS (SELECT DISTINCT repo_id, path source, unnest(imports) spec FROM fi),
 ist AS (SELECT *, string_split(source, '/')[1:-2] folder, length(regexp_extract(spec, '^(\.+)\w', 1)) dots FROM isp WHERE starts_with(spec, '.')),
 isu AS (SELECT *, CASE WHEN dots > 0 THEN dots - 1 ELSE len(regexp_extract_all(spec, '\.\./')) END ups, CASE WHEN dots > 0 THEN replace(regexp_replace(spec, '^\.+', ''), '.', '/') ELSE regexp_replace(spec, '^(?:\.{1,2}/)+', '') END rest FROM ist),
 isx AS (SELECT repo_id, source, spec, array_to_string(list_append(folder[1:len(folder) - ups], rest), '/') stem FROM isu WHERE ups <= len(folder)),
 ie AS (SELECT DISTINCT repo_id, source, arg_min(target, k) target FROM (SELECT x.repo_id, x.source, x.spec, x.stem || s.s target, s.k FROM isx x, (VALUES """ + ", ".join(f"({k}, '{s}')" for k, s in enumerate(_TRIES)) + r""") s(k, s)) c
   WHERE target <> source AND EXISTS (SELECT 1 FROM fi WHERE fi.repo_id = c.repo_id AND fi.path = c.target) GROUP BY repo_id, source, spec)"""
_CN = r"""cn AS (SELECT repo_id, path source, fn, count(*) "count" FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) fn FROM files WHERE is_code AND content IS NOT NULL) GROUP BY 1, 2, 3),
 cd AS (SELECT DISTINCT repo_id, name fn, file FROM functions WHERE file IS NOT NULL), cu AS (SELECT repo_id, fn, min(file) target FROM cd GROUP BY 1, 2 HAVING count(*) = 1)"""


def _called(spark, sf):
    names = F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1)
    f = contents(spark, sf).where("is_code and content is not null").select("repo_id", "path", names.alias("fns")).dropDuplicates(["repo_id", "path"])
    return f.select("repo_id", "path", F.explode("fns").alias("fn")).groupBy("repo_id", "path", "fn").agg(F.count("*").alias("count"))


@R.add("pg_defines", "SELECT DISTINCT repo_id, file source, fn_id target FROM functions WHERE file IS NOT NULL")
def pg_defines(spark, sf):
    return P.defines(functions(spark, sf))


@R.add("pg_imports", f"WITH {_IE} SELECT * FROM ie")
def pg_imports(spark, sf):
    return _file_imports(spark, sf)


@R.add("pg_calls", f"""WITH {_IE}, {_CN}, a AS (SELECT cn.repo_id, cn.source, cn.fn, "count", min(CASE WHEN cd.file = cn.source THEN file END) own, min(CASE WHEN ie.target IS NOT NULL THEN file END) via FROM cn JOIN cd ON cd.repo_id = cn.repo_id AND cd.fn = cn.fn LEFT JOIN ie ON ie.repo_id = cn.repo_id AND ie.source = cn.source AND ie.target = cd.file GROUP BY ALL)
 SELECT * FROM (SELECT a.repo_id, a.source, a.fn, coalesce(own, via, cu.target) target, "count", CASE WHEN own IS NOT NULL THEN 0.95::DOUBLE WHEN via IS NOT NULL THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END confidence FROM a LEFT JOIN cu ON cu.repo_id = a.repo_id AND cu.fn = a.fn) WHERE target IS NOT NULL""")
def pg_calls(spark, sf):
    """Calls with their targets, resolved by scope."""
    return P.calls(_called(spark, sf), functions(spark, sf), _file_imports(spark, sf))


@R.add("edge_admission", f"""WITH {_IE}, {_CN}, e AS (SELECT cn.repo_id, cn.source, cn.fn, cd.file target, "count" FROM cn JOIN cd ON cd.repo_id = cn.repo_id AND cd.fn = cn.fn WHERE cd.file <> cn.source),
 x AS (SELECT *, lower(regexp_extract(source, '\\.([A-Za-z0-9]+)$', 1)) a, lower(regexp_extract(target, '\\.([A-Za-z0-9]+)$', 1)) b FROM e)
 SELECT repo_id, source, fn, target, "count" FROM x WHERE CASE WHEN a IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx') THEN EXISTS (SELECT 1 FROM ie WHERE ie.repo_id = x.repo_id AND ie.source = x.source AND ie.target = x.target) ELSE a = b AND split_part(source, '/', 1) = split_part(target, '/', 1) END""")
def edge_admission(spark, sf):
    """Calls by name that may be edges: in script languages the caller imports the definer, in others both are of one language and top folder."""
    d = functions(spark, sf).select("repo_id", F.col("name").alias("fn"), F.col("file").alias("target")).where("target is not null").dropDuplicates()
    e = _called(spark, sf).withColumnRenamed("path", "source").join(d, ["repo_id", "fn"]).where("source <> target")
    script = E.extension(F.col("source")).isin("js", "jsx", "mjs", "cjs", "ts", "tsx")
    a = e.where(script).join(_file_imports(spark, sf), ["repo_id", "source", "target"], "left_semi")
    b = e.where(~script).where((E.extension(F.col("source")) == E.extension(F.col("target"))) & (F.substring_index("source", "/", 1) == F.substring_index("target", "/", 1)))
    return a.unionByName(b).select("repo_id", "source", "fn", "target", "count")


def _classes(spark, sf):
    return E.definitions(contents(spark, sf)).where("kind = 'class'").select("repo_id", "path", "name", "base", "line")


@R.add("pg_classes", f"WITH {_DF} SELECT repo_id, path, \"name\", base, line FROM df WHERE kind = 'class'")
def pg_classes(spark, sf):
    return _classes(spark, sf)


@R.add("pg_extends", f"""WITH {_DF}, {_IE}, k AS (SELECT repo_id, "name" base FROM df WHERE kind = 'class' GROUP BY 1, 2)
 SELECT DISTINCT d.repo_id, d."name", k.base, d.path, CASE WHEN EXISTS (SELECT 1 FROM ie WHERE ie.repo_id = d.repo_id AND ie.source = d.path) THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END confidence FROM df d JOIN k ON k.repo_id = d.repo_id AND k.base = regexp_extract(d.base, '([^.]*)$', 1) WHERE d.kind = 'class' AND d.base IS NOT NULL AND d.base <> d."name" """)
def pg_extends(spark, sf):
    return P.extends(_classes(spark, sf), _file_imports(spark, sf))


@R.add("pg_members", f"""WITH {_DF}, m AS (SELECT f.repo_id, f.file path, f.fn_id, f.name, arg_max(d."name", (d.line, d."name")) class_name FROM functions f JOIN df d ON d.repo_id = f.repo_id AND d.path = f.file AND d.kind = 'class' AND d.line <= f.line WHERE f.is_class_method GROUP BY ALL)
 SELECT repo_id, path, class_name, fn_id, CASE WHEN name IN ('__init__', 'constructor') OR name = class_name THEN 'constructor' ELSE 'method' END kind FROM m""")
def pg_members(spark, sf):
    """Methods and constructors of classes."""
    return P.members(functions(spark, sf), _classes(spark, sf))


@R.add("pg_constructors", f"""WITH {_DF}, n AS (SELECT DISTINCT fn_id, repo_id, file, unnest(regexp_extract_all(code, '\\bnew\\s+([A-Za-z_]\\w*)\\s*\\(', 1)) n FROM functions WHERE code IS NOT NULL) SELECT DISTINCT fn_id, n class_name FROM n WHERE EXISTS (SELECT 1 FROM df d WHERE d.kind = 'class' AND d.repo_id = n.repo_id AND d.path = n.file AND d."name" = n.n)""")
def pg_constructors(spark, sf):
    return P.constructor_queries(functions(spark, sf), _classes(spark, sf))


_STORE = [("sql", r"(?i)\b(?:from|into|update|join)\s+([a-z_]\w*)")]


@R.add("pg_orm", f"""WITH {L.scan_sql(_STORE)}, o AS (SELECT h.repo_id, h.path, h.line_no, h."name" model, arg_max(f.fn_id, (f.line, f.fn_id)) fn_id, max(f.line) fl FROM hits h JOIN functions f ON f.repo_id = h.repo_id AND f.file = h.path AND f.line <= h.line_no GROUP BY ALL) SELECT DISTINCT fn_id, model, line_no line FROM o WHERE line_no - fl <= 50""")
def pg_orm(spark, sf):
    """Which function names which table in its query texts."""
    return P.orm_queries(functions(spark, sf), L.scan(contents(spark, sf), ["file_id", "repo_id", "path"], _STORE))


_TE = r"(regexp_matches({p}, '(?i)(^|/)(tests?|__tests__|__mocks__|fixtures?|spec|specs|cypress|e2e)(/|$)|\.(test|spec)\.[a-zA-Z0-9]+$|(^|/)test_[^/]+$|_test\.[a-zA-Z0-9]+$'))"
_CV = f"""tw AS (SELECT DISTINCT repo_id, path source, unnest(regexp_extract_all(content, '([A-Za-z_]\\w*)', 1)) "name" FROM files WHERE content IS NOT NULL AND {_TE.format(p='path')}), tt AS (SELECT repo_id, source, target FROM ie WHERE {_TE.format(p='source')}),
 cv AS (SELECT f.repo_id, tt.source, f.fn_id, 0.9::DOUBLE confidence FROM functions f JOIN tt ON tt.repo_id = f.repo_id AND tt.target = f.file WHERE EXISTS (SELECT 1 FROM tw WHERE tw.repo_id = tt.repo_id AND tw.source = tt.source AND tw."name" = f.name))"""


def _tests(spark, sf):
    return P.test_edges(contents(spark, sf), functions(spark, sf), _file_imports(spark, sf))


@R.add("pg_tests", f"WITH {_IE}, {_CV} SELECT * FROM tt")
def pg_tests(spark, sf):
    return _tests(spark, sf)[0]


@R.add("pg_covers", f"WITH {_IE}, {_CV} SELECT * FROM cv")
def pg_covers(spark, sf):
    return _tests(spark, sf)[1]


@R.add("covers_lookup", f"WITH {_IE}, {_CV} SELECT f.repo_id, count(*) n_functions, count(c.fn_id) n_covered FROM functions f LEFT JOIN (SELECT DISTINCT fn_id FROM cv) c USING (fn_id) GROUP BY 1")
def covers_lookup(spark, sf):
    """Covered functions per repository."""
    c = _tests(spark, sf)[1].select("fn_id").dropDuplicates().withColumn("hit", F.lit(1))
    return functions(spark, sf).select("fn_id", "repo_id").join(c, "fn_id", "left").groupBy("repo_id").agg(F.count("*").alias("n_functions"), F.count("hit").alias("n_covered"))


# -- Cypher over entities and relations
def _graph(spark, sf):
    n = entities(spark, sf).groupBy(F.lower(F.btrim("id")).alias("id")).agg(F.min(F.regexp_replace(F.lower("type"), "[^a-z]+", "")).alias("label"), F.min("name").alias("name"), F.max("mentions").alias("mentions"))
    e = relations(spark, sf).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.regexp_replace(F.lower("type"), "[^a-z_]+", "").alias("type"), "weight")
    return n, e


_PG = "gn AS (SELECT lower(trim(id)) id, min(regexp_replace(lower(type), '[^a-z]+', '', 'g')) label, min(name) \"name\", max(mentions) mentions FROM entities GROUP BY 1), ge AS (SELECT src source, dst target, regexp_replace(lower(type), '[^a-z_]+', '', 'g') type, weight FROM relations)"


@R.add("cypher_calls", f"WITH {_PG} SELECT a.label label, count(*) n, max(e.weight) top_weight FROM gn a JOIN ge e ON e.source = a.id JOIN gn b ON b.id = e.target WHERE e.type = 'calls' AND b.label = 'function' AND a.mentions > 1 GROUP BY 1")
def cypher_calls(spark, sf):
    return P.cypher("MATCH (a)-[r:calls]->(b:function) WHERE a.mentions > 1 RETURN a.label AS label, count(*) AS n, max(r.weight) AS top_weight", *_graph(spark, sf))


@R.add("cypher_walks", f"WITH {_PG}, w1 AS (SELECT a.id, e.target t FROM gn a JOIN ge e ON e.source = a.id WHERE a.label = 'service' AND e.type = 'calls'), w2 AS (SELECT DISTINCT w1.id, e.target t FROM w1 JOIN ge e ON e.source = w1.t AND e.type = 'calls') SELECT DISTINCT a, b, hops FROM (SELECT id a, t b, 1 hops FROM w1 UNION ALL SELECT id, t, 2 FROM w2) JOIN gn ON gn.id = b")
def cypher_walks(spark, sf):
    return P.cypher("MATCH (a:service)-[r:calls*1..2]->(b) RETURN DISTINCT a.id AS a, b.id AS b, r.hops AS hops", *_graph(spark, sf))


@R.add("cypher_top", f"WITH {_PG} SELECT a.id id, count(DISTINCT b.id) n FROM gn a JOIN (SELECT source s, target t FROM ge UNION ALL SELECT target, source FROM ge) e ON e.s = a.id JOIN gn b ON b.id = e.t WHERE NOT contains(b.\"name\", '_') GROUP BY 1 ORDER BY n DESC, id LIMIT 10")
def cypher_top(spark, sf):
    return P.cypher("MATCH (a)-[]-(b) WHERE NOT b.name CONTAINS '_' RETURN a.id AS id, count(DISTINCT b.id) AS n ORDER BY n DESC, id LIMIT 10", *_graph(spark, sf))


@R.add("graph_node_counts", f"WITH {_PG} SELECT label, count(*) n FROM gn GROUP BY 1")
def graph_node_counts(spark, sf):
    return P.cypher("MATCH (n) RETURN n.label AS label, count(*) AS n", *_graph(spark, sf))


# -- history: orders are commits by priority, parts are paths
def _commits(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("parents"))
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_quantity").cast("int").alias("added"), F.col("l_linenumber").alias("deleted"))
    return li.join(o, "o_orderkey").select(F.col("o_orderkey").cast("string").alias("sha"), "author", "date", "parents", "path", "added", "deleted")


_CM = "cm AS (SELECT CAST(o_orderkey AS VARCHAR) sha, o_orderpriority author, o_orderdate date, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END parents, 'part/' || l_partkey path, CAST(l_quantity AS INT) added, l_linenumber deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@R.add("git_churn", f"WITH {_CM} SELECT path, count(DISTINCT sha) churn FROM cm WHERE parents <= 1 GROUP BY 1")
def git_churn(spark, sf):
    return H.churn(_commits(spark, sf))


@R.add("git_ownership", f"WITH {_CM}, p AS (SELECT path, author, count(DISTINCT sha) n FROM cm GROUP BY 1, 2) SELECT path, top_contributor, contributor_count FROM (SELECT path, author top_contributor, count(*) OVER (PARTITION BY path) contributor_count, row_number() OVER (PARTITION BY path ORDER BY n DESC, author) k FROM p) WHERE k = 1")
def git_ownership(spark, sf):
    return H.ownership(_commits(spark, sf))


@R.add("git_timeline", f"WITH {_CM}, l AS (SELECT DISTINCT sha, author, date FROM cm ORDER BY date DESC, sha LIMIT 100) SELECT l.sha, l.author, l.date, count(DISTINCT path) n_files, CAST(sum(added) AS BIGINT) added, CAST(sum(deleted) AS BIGINT) deleted FROM l JOIN cm ON cm.sha = l.sha GROUP BY 1, 2, 3")
def git_timeline(spark, sf):
    return H.timeline(_commits(spark, sf))


@R.add("include_filter", "SELECT kind, count(*) n FROM (SELECT CASE WHEN e IN (" + ", ".join(f"'{x}'" for x in H.CODE) + ") THEN 'code' WHEN e IN (" + ", ".join(f"'{x}'" for x in H.TEXT) + ") THEN 'text' WHEN e IN (" + ", ".join(f"'{x}'" for x in H.BINARY) + ") THEN 'binary' ELSE 'other' END kind FROM (SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) e FROM files)) GROUP BY 1")
def include_filter(spark, sf):
    return files(spark, sf).groupBy(H.file_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


_WS = r"ws AS (SELECT DISTINCT repo_id, regexp_extract(path, '^((?:packages|apps|services|libs)/[^/]+)/', 1) workspace FROM files WHERE regexp_matches(path, '^(?:packages|apps|services|libs)/[^/]+/') UNION SELECT DISTINCT repo_id, regexp_extract(path, '^(.*)/[^/]+$', 1) FROM files WHERE regexp_extract(path, '([^/]+)$', 1) IN (" + ", ".join(f"'{x}'" for x in H.MANIFESTS) + ") AND contains(path, '/') AND len(string_split(path, '/')) <= 4)"


@R.add("workspace_detection", f"WITH {_WS} SELECT * FROM ws")
def workspace_detection(spark, sf):
    return H.workspaces(load(spark, sf, "file_records"))


@R.add("file_workspace", f"WITH {_WS}, p AS (SELECT DISTINCT repo_id, path FROM files) SELECT p.repo_id, p.path, arg_max(ws.workspace, length(ws.workspace)) workspace FROM p LEFT JOIN ws ON ws.repo_id = p.repo_id AND starts_with(p.path, ws.workspace || '/') GROUP BY 1, 2")
def file_workspace(spark, sf):
    f = load(spark, sf, "file_records")
    return H.file_workspace(f, H.workspaces(f))


# -- stores and search
@R.add("cascade_delete", "WITH d AS (SELECT repo_id FROM files GROUP BY 1 ORDER BY count(*) DESC, repo_id LIMIT 1) SELECT 'files' tbl, count(*) n_left FROM files WHERE repo_id NOT IN (SELECT repo_id FROM d) UNION ALL SELECT 'functions', count(*) FROM functions WHERE repo_id NOT IN (SELECT repo_id FROM d) UNION ALL SELECT 'snapshots', count(*) FROM snapshots WHERE repo_id NOT IN (SELECT repo_id FROM d)")
def cascade_delete(spark, sf):
    """What is left of three tables when the greatest repository and all that refers to it is deleted."""
    f = files(spark, sf)
    gone = F.broadcast(f.groupBy("repo_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo_id").limit(1).select("repo_id"))
    left = lambda name, d: d.where("repo_id is not null").join(gone, "repo_id", "left_anti").agg(F.count("*").alias("n_left")).select(F.lit(name).alias("tbl"), "n_left")
    return left("files", f.select("repo_id")).unionByName(left("functions", functions(spark, sf).select("fn_id", "repo_id"))).unionByName(left("snapshots", load(spark, sf, "snapshots").select("repo_id")))


@R.add("search_enriched")
def search_enriched(spark, sf):
    """Lexical and vector hits fused, with what is known of each text."""
    s = search_queries.search(spark, sf)
    key = s.columns[0]
    d = load(spark, sf, "documents").select(F.col("doc_id").alias(key), F.coalesce("source", F.lit("unknown")).alias("layer"), F.coalesce("n_chars", F.lit(0).cast("long")).alias("size")).dropDuplicates([key])
    return s.join(d, key, "left").na.fill({"layer": "unknown", "size": 0})


SQL["search_enriched"] = "WITH s AS (" + search_queries.SQL["search"] + ") SELECT s.*, coalesce(d.layer, 'unknown') layer, coalesce(d.size, 0) size FROM s LEFT JOIN (SELECT DISTINCT ON (doc_id) doc_id, source layer, n_chars size FROM documents) d ON d.doc_id = s.\"key\""


@R.add("vector_codec")
def vector_codec(spark, sf):
    """Vectors as bytes and back."""
    ship(spark)
    e = load(spark, sf, "embeddings").select("vec_id", "embedding", V.floats_to_bytes("embedding").alias("b"))
    return e.select("vec_id", F.octet_length("b").alias("n_bytes"), (V.bytes_to_floats("b") == F.col("embedding")).alias("equal"))


# What coding rules for embedded languages forbid, as (rule, expression).
CODING_RULES = [("goto", r"\b(goto)\s+\w+"), ("dynamic_memory", r"\b(malloc|calloc|realloc|free)\s*\("), ("long_jump", r"\b(setjmp|longjmp)\s*\("), ("octal", r"[=(,\s](0[0-7]+)\b"), ("undef", r"^\s*#\s*(undef)\b"), ("union", r"\b(union)\s+\w*\s*\{"), ("unsafe_text", r"\b(gets|strcpy|strcat|sprintf)\s*\("), ("unchecked", r"\b(Unchecked_Conversion|Unchecked_Deallocation)\b"), ("abort", r"\b(abort|exit)\s*\(")]
_EMB = "(SELECT * FROM files WHERE regexp_matches(path, '\\.(c|h|cc|cpp|hpp|adb|ads)$'))"


@R.add("coding_rules", f"WITH {L.scan_sql(CODING_RULES, table=_EMB)} SELECT file_id, line_no, tag, \"name\" FROM hits")
def coding_rules(spark, sf):
    """Breaches of coding rules in the files of embedded languages."""
    f = contents(spark, sf).where(F.col("path").rlike(r"\.(c|h|cc|cpp|hpp|adb|ads)$"))
    return L.scan(f, ["file_id", "repo_id", "path"], CODING_RULES).select("file_id", "line_no", "tag", "name")


@R.add("org_report", """WITH x AS (SELECT repo_id, count(*) n_files, CAST(sum("lines") AS BIGINT) n_lines, min(health_grade) best, max(health_grade) worst FROM files GROUP BY 1)
 SELECT 0 ord, '<table><tr><th>repository</th><th>files</th><th>lines</th><th>best</th><th>worst</th></tr>' line UNION ALL SELECT 1, '<tr><td>' || replace(replace(repo_id, '&', '&amp;'), '<', '&lt;') || '</td><td>' || n_files || '</td><td>' || n_lines || '</td><td>' || coalesce(best, '-') || '</td><td>' || coalesce(worst, '-') || '</td></tr>' FROM x WHERE repo_id IS NOT NULL UNION ALL SELECT 2, '</table>'""")
def org_report(spark, sf):
    """A page's table of all repositories, line by line."""
    x = files(spark, sf).where("repo_id is not null").groupBy("repo_id").agg(F.count("*").alias("f"), F.sum("lines").alias("l"), F.min("health_grade").alias("b"), F.max("health_grade").alias("w"))
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("-")), F.lit("</td>"))
    name = F.replace(F.replace(F.col("repo_id"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = x.select(F.lit(1).alias("ord"), F.concat(F.lit("<tr>"), cell(name), cell(F.col("f").cast("string")), cell(F.col("l").cast("string")), cell(F.col("b")), cell(F.col("w")), F.lit("</tr>")).alias("line"))
    one = lambda k, t: spark.createDataFrame([(k, t)], "ord int, line string")
    return one(0, "<table><tr><th>repository</th><th>files</th><th>lines</th><th>best</th><th>worst</th></tr>").unionByName(rows).unionByName(one(2, "</table>"))
