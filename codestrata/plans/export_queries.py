"""Sources, sinks and exporters as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import exports as X, lines as L
from codestrata.plans.bindings import Registry, edges, files, gfiles, links, nodes
from codestrata.session import load
from codestrata.sources import readers

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _sql(fmt: str, max_nodes: int | None = None) -> str:
    head, node, between, edge, tail = X.FORMATS[fmt]
    q = lambda s: s.replace("'", "''")
    plain = fmt in ("mermaid", "plantuml")
    ident = lambda c: f"regexp_replace({c}, '[^A-Za-z0-9_]', '_', 'g') || '_' || left(md5({c}), 8)" if plain else c

    def fill(t: str, *cols: str) -> str:
        t = q(t)
        for k, c in enumerate(cols, 1):
            t = t.replace(f"%{k}$s", f"' || {c} || '")
        return f"'{t}'"

    lim = f" ORDER BY total DESC, path LIMIT {max_nodes}" if max_nodes else ""
    kept = "WHERE source IN (SELECT path FROM k) AND target IN (SELECT path FROM k)" if max_nodes else ""
    own = "left(md5(source || chr(0) || target), 16)"
    last_node = f"CASE WHEN {ident('path')} = (SELECT max({ident('path')}) FROM k) THEN '' ELSE ',' END"
    last_edge = f"CASE WHEN {own} = (SELECT max({own}) FROM e) THEN '' ELSE ',' END"
    return (
        f"WITH dd AS (SELECT path, count(*) total FROM (SELECT source path FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1), k AS (SELECT path FROM dd{lim}), e AS (SELECT source, target, CAST(CAST(sum(\"count\") AS BIGINT) AS VARCHAR) n FROM edges {kept} GROUP BY 1, 2) "
        f"SELECT 0 ord, '{q(head)}' line UNION ALL SELECT 1, {fill(node, ident('path'), 'path', last_node)} FROM k UNION ALL SELECT 3, {fill(edge, ident('source'), ident('target'), 'n', own, last_edge)} FROM e" + (f" UNION ALL SELECT 2, '{q(between)}'" if between else "") + (f" UNION ALL SELECT 4, '{q(tail)}'" if tail else "")
    )


def _export(name: str, fmt: str, max_nodes: int | None = None) -> None:
    @R.add(name, _sql(fmt, max_nodes))
    def f(spark, sf):
        return X.export_graph(edges(spark, sf), fmt, max_nodes)

    f.__doc__ = f"The graph as {fmt}."


for _n, _f, _m in [("export_graphml", "graphml", None), ("export_cypher", "cypher", None), ("export_obsidian", "obsidian", None), ("export_dot", "dot", 10), ("export_mermaid", "mermaid", 10), ("export_d2", "d2", 10), ("export_plantuml", "plantuml", 10), ("export_dgml", "dgml", None), ("export_gexf", "gexf", None), ("export_drawio", "drawio", 10)]:
    _export(_n, _f, _m)


@R.add("diagram", "SELECT '  System_Boundary(' || replace(layer, ' ', '_') || ', \"' || layer || '\") ' || count(*) AS line FROM gfiles GROUP BY layer")
def diagram(spark, sf):
    """Containers of a C4 diagram."""
    return gfiles(spark, sf).groupBy("layer").agg(F.count("*").alias("n")).select(F.format_string('  System_Boundary(%s, "%s") %d', F.replace("layer", F.lit(" "), F.lit("_")), "layer", "n").alias("line"))


@R.add("generate_agents_md", "SELECT repo_id, '## ' || layer || ' (' || count(*) || ' files)' AS line FROM files GROUP BY repo_id, layer")
def generate_agents_md(spark, sf):
    return files(spark, sf).groupBy("repo_id", "layer").agg(F.count("*").alias("n")).select("repo_id", F.format_string("## %s (%d files)", "layer", "n").alias("line"))


@R.add("generate_skills", "SELECT repo_id, folder, '# ' || folder || ': ' || count(*) || ' files' AS line FROM files GROUP BY 1, 2")
def generate_skills(spark, sf):
    return files(spark, sf).groupBy("repo_id", "folder").agg(F.count("*").alias("n")).select("repo_id", "folder", F.format_string("# %s: %d files", "folder", "n").alias("line"))


@R.add("embed", "SELECT repo_id, '<img src=\"badge/' || repo_id || '.svg\" height=\"20\">' snippet FROM (SELECT DISTINCT repo_id FROM files)")
def embed(spark, sf):
    return files(spark, sf).select("repo_id").dropDuplicates().select("repo_id", F.format_string('<img src="badge/%s.svg" height="20">', "repo_id").alias("snippet"))


@R.add("adr", "SELECT 'Decision for ' || layer || ': keep ' || count(*) || ' files together' AS line FROM gfiles GROUP BY layer")
def adr(spark, sf):
    """Decision records from a template; no language model is called."""
    return gfiles(spark, sf).groupBy("layer").agg(F.count("*").alias("n")).select(F.format_string("Decision for %s: keep %d files together", "layer", "n").alias("line"))


@R.add("pr_review", "SELECT file_id, path || ': complexity ' || complexity AS finding FROM files WHERE is_code AND complexity >= 10 AND churn > 5")
def pr_review(spark, sf):
    return files(spark, sf).where("is_code and complexity >= 10 and churn > 5").select("file_id", F.format_string("%s: complexity %d", "path", "complexity").alias("finding"))


@R.add("deps_dev", "SELECT lib, count(DISTINCT repo_id) n_dependents FROM (SELECT repo_id, unnest(imports) lib FROM files) GROUP BY 1")
def deps_dev(spark, sf):
    """Dependents of each package among the repositories at hand."""
    return files(spark, sf).select("repo_id", F.explode("imports").alias("lib")).groupBy("lib").agg(F.countDistinct("repo_id").alias("n_dependents"))


# -- sources on literal inputs
@R.add("coverage", "SELECT * FROM (VALUES ('a.ts', 2, 1, 50.0::DOUBLE), ('b.ts', 1, 1, 100.0::DOUBLE)) t(path, n_lines, n_hit, pct)")
def coverage(spark, sf):
    rows = list(enumerate(["SF:a.ts", "DA:1,3", "DA:2,0", "end_of_record", "SF:b.ts", "DA:1,1", "end_of_record"]))
    return readers.lcov(spark.createDataFrame(rows, "line_no int, line string"))


@R.add("bundle", "SELECT * FROM (VALUES ('./src/a.js', 300, 75.0::DOUBLE), ('./src/b.js', 100, 25.0::DOUBLE)) t(\"name\", size, share)")
def bundle(spark, sf):
    return readers.bundle_modules(spark.createDataFrame([('{"modules":[{"name":"./src/a.js","size":300},{"name":"./src/b.js","size":100}]}',)], "content string"))


@R.add("otel_trace", "SELECT 'src/a.ts' path, 2 n")
def otel_trace(spark, sf):
    span = '{"name":"s","attributes":[{"key":"code.filepath","value":{"stringValue":"src/a.ts"}}]}'
    return readers.otel_calls(spark.createDataFrame([(f'{{"resourceSpans":[{{"scopeSpans":[{{"spans":[{span},{span}]}}]}}]}}',)], "content string"))


@R.add("manifest_packages", "SELECT * FROM (VALUES ('package.json', 'npm', 'lodash', '^4.0.0'), ('requirements.txt', 'pypi', 'numpy', '1.26'), ('go.mod', 'go', 'github.com/x/y', '1.2.3')) t(path, ecosystem, \"name\", version)")
def manifest_packages(spark, sf):
    return readers.manifest_packages(spark.createDataFrame([("package.json", '{"dependencies":{"lodash":"^4.0.0"}}'), ("requirements.txt", "# x\nnumpy==1.26\n"), ("go.mod", "module m\nrequire github.com/x/y v1.2.3\n")], "path string, content string"))


@R.add("ingest")
def ingest(spark, sf):
    """All documents cut into chunks, with the length of each."""
    c = readers.chunk_documents(load(spark, sf, "documents").dropDuplicates(["doc_id"]), "doc_id", "text")
    return c.select("doc_id", "idx", F.length("chunk").alias("n"))


@R.add("chunks_all")
def chunks_all(spark, sf):
    """All documents cut into chunks of 800 tokens with an overlap of 100."""
    return readers.chunk_documents(load(spark, sf, "documents").dropDuplicates(["doc_id"]), "doc_id", "text")


@R.add("python_imports", "SELECT * FROM (VALUES ('a/b/c.py', '.d', 'a/b/d.py'), ('a/b/c.py', 'e', 'a/e/__init__.py')) t(source, spec, target)")
def python_imports(spark, sf):
    i = spark.createDataFrame([("a/b/c.py", ".d"), ("a/b/c.py", "e"), ("a/b/c.py", "zz")], "source string, spec string")
    return readers.resolve_python_imports(i, spark.createDataFrame([("a/b/d.py",), ("a/e/__init__.py",), ("a/b/c.py",)], "path string"))


@R.add("llm_status", "SELECT 'none' backend, false usable")
def llm_status(spark, sf):
    """No language model is part of the engine."""
    return spark.createDataFrame([("none", False)], "backend string, usable boolean")


@R.add("detect_impact", "SELECT source, count(DISTINCT target) n FROM links GROUP BY 1")
def detect_impact(spark, sf):
    """Direct users of each file, the first step of an impact prompt."""
    return links(spark, sf).groupBy("source").agg(F.countDistinct("target").alias("n"))


@R.add("generate_map", "SELECT a.layer source_layer, b.layer target_layer, count(*) n FROM links JOIN nodes a ON a.path = source JOIN nodes b ON b.path = target GROUP BY 1, 2")
def generate_map(spark, sf):
    """Layer-to-layer map."""
    g = nodes(spark, sf).select("path", "layer")
    return links(spark, sf).join(g.select(F.col("path").alias("source"), F.col("layer").alias("source_layer")), "source").join(g.select(F.col("path").alias("target"), F.col("layer").alias("target_layer")), "target").groupBy("source_layer", "target_layer").agg(F.count("*").alias("n"))
