"""Text and line-scan operators on the files at hand, with SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from codestrata.functions import scalar as S
from codestrata.operators import lines as L
from codestrata.plans.bindings import Registry, contents, files, functions
from codestrata.session import load

R = Registry()
QUERIES, SQL = R.queries, R.sql
_K = ["file_id", "repo_id", "path"]


def _code(spark, sf):
    return contents(spark, sf).select("file_id", "repo_id", "path", "content", "layer")


def _scan(name: str, library: list, doc: str, config: bool = True) -> None:
    @R.add(name, f"WITH {L.scan_sql(library)} SELECT * FROM hits")
    def q(spark, sf):
        return L.scan(_code(spark, sf), _K, library)

    q.__doc__ = doc


for _n, _l, _d in [
    ("security", L.SECURITY, "Findings of the rule library by line."), ("route_map", L.ROUTES, "Routes by dialect."), ("tool_map", L.TOOLS, "Tool and procedure registrations."), ("pii_trace", L.PII_SINKS, "Lines where data leaves."),
    ("latency", L.LATENCY, "Slow operations by line."), ("model_risk", L.MODEL_CHECKS, "Numeric checks by line."), ("irq", L.IRQ, "Interrupt code that allocates or sleeps."), ("multilang", L.MULTILANG, "Borders between languages."), ("ecss", L.ECSS, "Coding rule checks."), ("plugins", L.PLUGINS, "Extension points and implementations."),
]:
    _scan(_n, _l, _d)


@R.add("env_vars", f"WITH {L.scan_sql(L.ENV_READS)} SELECT \"name\", count(DISTINCT file_id) n_files, count(*) n_reads, bool_and(regexp_matches(path, '/test')) test_only FROM hits GROUP BY 1")
def env_vars(spark, sf):
    h = L.scan(_code(spark, sf), _K, L.ENV_READS)
    return h.groupBy("name").agg(F.countDistinct("file_id").alias("n_files"), F.count("*").alias("n_reads"), F.bool_and(F.col("path").rlike("/test")).alias("test_only"))


@R.add("undocumented_env", f"WITH {L.scan_sql(L.ENV_READS)}, doc AS (SELECT DISTINCT unnest(regexp_extract_all(content, '(?m)^(?:export )?([A-Z_][A-Z0-9_]+)=', 1)) \"name\" FROM files WHERE NOT is_code AND content IS NOT NULL) SELECT DISTINCT \"name\" FROM hits WHERE \"name\" NOT IN (SELECT \"name\" FROM doc)")
def undocumented_env(spark, sf):
    f = contents(spark, sf)
    doc = f.where("not is_code and content is not null").select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(?:export )?([A-Z_][A-Z0-9_]+)="), 1)).alias("name")).dropDuplicates()
    return L.scan(_code(spark, sf), _K, L.ENV_READS).select("name").dropDuplicates().join(doc, "name", "left_anti")


@R.add("events", f"WITH {L.scan_sql(L.EVENT_EMITS).replace('hits AS', 'em AS')}, {L.scan_sql(L.EVENT_SUBSCRIBES).replace('ln AS', 'ln2 AS').replace('FROM ln', 'FROM ln2').replace('hits AS', 'su AS')}, a AS (SELECT \"name\", count(*) n_emits FROM em GROUP BY 1), b AS (SELECT \"name\", count(*) n_subscribes FROM su GROUP BY 1) SELECT coalesce(a.\"name\", b.\"name\") \"name\", coalesce(n_emits, 0) n_emits, coalesce(n_subscribes, 0) n_subscribes FROM a FULL JOIN b ON a.\"name\" = b.\"name\"")
def events(spark, sf):
    """Event names with their emitters and subscribers."""
    c = _code(spark, sf)
    a = L.scan(c, _K, L.EVENT_EMITS).groupBy("name").agg(F.count("*").alias("n_emits"))
    b = L.scan(c, _K, L.EVENT_SUBSCRIBES).groupBy("name").agg(F.count("*").alias("n_subscribes"))
    zero = F.lit(0).cast("long")
    return a.join(b, "name", "full_outer").select("name", F.coalesce("n_emits", zero).alias("n_emits"), F.coalesce("n_subscribes", zero).alias("n_subscribes"))


_FLAG_ORDER = "CASE tag " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(dict.fromkeys(t for t, _ in L.FLAGS))) + " END"


@R.add("feature_flags", f"WITH {L.scan_sql(L.FLAGS)} SELECT \"name\", arg_min(tag, {_FLAG_ORDER}) flag_source, count(*) n FROM hits GROUP BY 1")
def feature_flags(spark, sf):
    """Flags by name, with the source whose pattern stands first in the library."""
    order = F.array(*[F.lit(t) for t in dict.fromkeys(t for t, _ in L.FLAGS)])
    h = L.scan(_code(spark, sf), _K, L.FLAGS)
    return h.groupBy("name").agg(F.min_by("tag", F.array_position(order, F.col("tag"))).alias("flag_source"), F.count("*").alias("n"))


@R.add("orm_map", f"WITH {L.scan_sql(L.ORM_CALLS)} SELECT tag orm, \"name\" model, count(*) n FROM hits GROUP BY 1, 2")
def orm_map(spark, sf):
    return L.scan(_code(spark, sf), _K, L.ORM_CALLS).groupBy(F.col("tag").alias("orm"), F.col("name").alias("model")).agg(F.count("*").alias("n"))


_NOT = ", ".join(f"'{x}'" for x in L.NOT_TABLES)


@R.add("db_coupling", f"WITH {L.scan_sql(L.TABLE_REFS)} SELECT lower(\"name\") table_name, count(DISTINCT file_id) n_files, CASE WHEN count(DISTINCT file_id) >= 5 THEN 'god' WHEN count(DISTINCT file_id) >= 3 THEN 'high' ELSE 'low' END coupling FROM hits WHERE lower(\"name\") NOT IN ({_NOT}) GROUP BY 1")
def db_coupling(spark, sf):
    h = L.scan(_code(spark, sf), _K, L.TABLE_REFS).select(F.lower("name").alias("table_name"), "file_id").where(~F.col("table_name").isin(*L.NOT_TABLES))
    n = F.countDistinct("file_id")
    return h.groupBy("table_name").agg(n.alias("n_files"), F.when(n >= 5, "god").when(n >= 3, "high").otherwise("low").alias("coupling"))


@R.add("api_surface", f"WITH {L.scan_sql(L.ROUTES)} SELECT \"name\" path, min(tag) dialect, count(*) n FROM hits GROUP BY 1")
def api_surface(spark, sf):
    return L.scan(_code(spark, sf), _K, L.ROUTES).groupBy(F.col("name").alias("path")).agg(F.min("tag").alias("dialect"), F.count("*").alias("n"))


@R.add("patterns", f"WITH {L.scan_sql(L.PATTERNS)} SELECT tag pattern, count(DISTINCT file_id) n_files FROM hits GROUP BY 1 UNION ALL SELECT 'Long File', count(*) FROM files WHERE is_code AND \"lines\" > 90")
def patterns(spark, sf):
    """Design patterns and anti-patterns with their files."""
    a = L.scan(_code(spark, sf), _K, L.PATTERNS).groupBy(F.col("tag").alias("pattern")).agg(F.countDistinct("file_id").alias("n_files"))
    return a.unionByName(files(spark, sf).where("is_code and lines > 90").agg(F.count("*").alias("n_files")).select(F.lit("Long File").alias("pattern"), "n_files"))


@R.add("kconfig", f"WITH {L.scan_sql(L.KCONFIG)} SELECT \"name\", count(DISTINCT file_id) n_files, count(DISTINCT file_id) > 50 high_risk FROM hits GROUP BY 1")
def kconfig(spark, sf):
    n = F.countDistinct("file_id")
    return L.scan(_code(spark, sf), _K, L.KCONFIG).groupBy("name").agg(n.alias("n_files"), (n > 50).alias("high_risk"))


@R.add("license", f"WITH {L.scan_sql(L.LICENSES)} SELECT repo_id, \"name\" license, CASE WHEN \"name\" IN ('MIT', 'Apache-2.0', 'BSD-3-Clause', 'BSD-2-Clause', 'ISC') THEN 'permissive' WHEN \"name\" LIKE '%GPL%' OR \"name\" LIKE 'MPL%' THEN 'copyleft' ELSE 'unknown' END category, count(DISTINCT file_id) n_files FROM hits GROUP BY 1, 2")
def license(spark, sf):
    h = L.scan(_code(spark, sf), _K, L.LICENSES)
    # Permissive licences.
    cat = F.when(F.col("name").isin("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC"), "permissive").when(F.col("name").contains("GPL") | F.col("name").startswith("MPL"), "copyleft").otherwise("unknown")
    return h.groupBy("repo_id", F.col("name").alias("license")).agg(F.first(cat).alias("category"), F.countDistinct("file_id").alias("n_files"))


@R.add("req_trace", f"WITH {L.scan_sql(L.REQ_TAGS)} SELECT r.id, count(DISTINCT file_id) n_files, CASE WHEN count(file_id) > 0 THEN 'covered' ELSE 'uncovered' END state FROM (VALUES ('REQ-1'), ('REQ-2')) r(id) LEFT JOIN hits ON \"name\" = r.id GROUP BY 1")
def req_trace(spark, sf):
    r = spark.createDataFrame([("REQ-1",), ("REQ-2",)], "id string")
    h = L.scan(_code(spark, sf), _K, L.REQ_TAGS).groupBy(F.col("name").alias("id")).agg(F.countDistinct("file_id").alias("n"))
    return F.broadcast(r).join(h, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n_files"), F.when(F.col("n") > 0, "covered").otherwise("uncovered").alias("state"))


@R.add("reg_impact", "WITH h AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(interface|schema|database)\\b', 1)) n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(n AS BIGINT) n_hits, CASE WHEN n > 50 THEN 'critical' WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END risk FROM h WHERE n > 0")
def reg_impact(spark, sf):
    """Texts by hits of regulated words."""
    h = load(spark, sf, "documents").where("text is not null").select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"\b(interface|schema|database)\b")).cast("long").alias("n_hits"))
    return h.where("n_hits > 0").withColumn("risk", S.ladder(F.col("n_hits"), [(50, "critical"), (20, "high"), (5, "medium")], "low", strict=True))


@R.add("perf")
def perf(spark, sf):
    """Calls inside loops and blocking calls."""
    f = L.loop_findings(_code(spark, sf), _K)
    return f.dropDuplicates(["file_id", *[c for c in f.columns if c not in _K]])


@R.add("dead_packages", "WITH used AS (SELECT DISTINCT repo_id, unnest(imports) p FROM files), declared AS (SELECT DISTINCT repo_id, p FROM files, (VALUES ('fmt'), ('lodash'), ('express')) d(p)) SELECT * FROM declared EXCEPT SELECT * FROM used")
def dead_packages(spark, sf):
    """Declared packages that no file of the repository imports."""
    f = files(spark, sf)
    declared = f.select("repo_id", F.explode(F.array(*[F.lit(x) for x in ("fmt", "lodash", "express")])).alias("p")).dropDuplicates()
    return declared.join(f.select("repo_id", F.explode("imports").alias("p")).dropDuplicates(), ["repo_id", "p"], "left_anti")


@R.add("migration_plan", "WITH x AS (SELECT file_id, len(regexp_extract_all(content, '\\b(console|logging|fmt)\\b', 1)) usages, len(list_filter(imports, lambda i: i IN ('logging', 'fmt'))) sites FROM files WHERE content IS NOT NULL) SELECT file_id, CAST(3 * sites + usages AS BIGINT) effort, CASE WHEN 3 * sites + usages <= 3 THEN 'low' WHEN 3 * sites + usages <= 12 THEN 'medium' ELSE 'high' END bucket FROM x WHERE sites > 0")
def migration_plan(spark, sf):
    x = contents(spark, sf).where("content is not null").select("file_id", F.regexp_count("content", F.lit(r"\b(console|logging|fmt)\b")).alias("u"), F.size(F.filter("imports", lambda i: i.isin("logging", "fmt"))).alias("s")).dropDuplicates(["file_id"]).where("s > 0")
    e = (3 * F.col("s") + F.col("u")).cast("long")
    return x.select("file_id", e.alias("effort"), F.when(e <= 3, "low").when(e <= 12, "medium").otherwise("high").alias("bucket"))


@R.add("vulnerabilities", "SELECT repo_id, lib, severity FROM (SELECT DISTINCT repo_id, unnest(imports) lib FROM files) JOIN (VALUES ('fmt', 'low'), ('java.util.List', 'high')) a(lib, severity) USING (lib)")
def vulnerabilities(spark, sf):
    """Components that an advisory table names; the table is given, since nothing is fetched."""
    a = spark.createDataFrame([("fmt", "low"), ("java.util.List", "high")], "lib string, severity string")
    return files(spark, sf).select("repo_id", F.explode("imports").alias("lib")).dropDuplicates().join(F.broadcast(a), "lib").select("repo_id", "lib", "severity")


@R.add("similarity", "WITH n AS (SELECT file_id, repo_id, md5(regexp_replace(regexp_replace(regexp_replace(content, '\"[^\"\\n]*\"', 'S', 'g'), '\\b\\d+\\.?\\d*\\b', 'N', 'g'), '\\s+', ' ', 'g')) h FROM files WHERE content IS NOT NULL) SELECT h fingerprint, count(*) n_files, min(file_id) first_file FROM n GROUP BY 1 HAVING count(*) > 1")
def similarity(spark, sf):
    """Files that are equal once texts, numbers and blanks are normalised."""
    h = F.md5(F.regexp_replace(F.regexp_replace(F.regexp_replace("content", '"[^"\n]*"', "S"), r"\b\d+\.?\d*\b", "N"), r"\s+", " "))
    return contents(spark, sf).where("content is not null").select("file_id", h.alias("fingerprint")).dropDuplicates(["file_id"]).groupBy("fingerprint").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file")).where("n_files > 1")


_FP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code, '//[^\n]*', '', 'g'), '[''\"`][^''\"`]*[''\"`]', '', 'g'), '\b[a-zA-Z_$][a-zA-Z0-9_$]*\b', 'I', 'g'), '\b\d+\.?\d*\b', 'N', 'g'), '\s+', '', 'g')"


@R.add("structural_fingerprint", rf"WITH s AS (SELECT fn_id, {_FP} t FROM functions WHERE length(code) >= 50), p AS (SELECT fn_id, 'C' || len(regexp_extract_all(t, '\?')) || 'F' || len(regexp_extract_all(t, 'I\(')) || 'S' || CAST(length(t) // 50 * 50 AS BIGINT) fp FROM s) SELECT fp, count(*) n, min(fn_id) first_fn FROM p GROUP BY 1 HAVING count(*) > 1")
def structural_fingerprint(spark, sf):
    """Buckets of functions of the same structure."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("code", r"//[^\n]*", ""), "['\"`][^'\"`]*['\"`]", ""), r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b", "I"), r"\b\d+\.?\d*\b", "N"), r"\s+", "")
    s = functions(spark, sf).where(F.length("code") >= 50).select("fn_id", t.alias("t"))
    fp = F.concat(F.lit("C"), F.regexp_count("t", F.lit(r"\?")).cast("string"), F.lit("F"), F.regexp_count("t", F.lit(r"I\(")).cast("string"), F.lit("S"), (F.floor(F.length("t") / 50) * 50).cast("string"))
    return s.select("fn_id", fp.alias("fp")).groupBy("fp").agg(F.count("*").alias("n"), F.min("fn_id").alias("first_fn")).where("n > 1")


@R.add("rename", r"SELECT file_id, len(regexp_extract_all(content, '\bitem\b')) n, md5(regexp_replace(content, '\bitem\b', 'element', 'g')) digest FROM files WHERE regexp_matches(content, '\bitem\b')")
def rename(spark, sf):
    """Whole-word occurrences of a name and the digest of the text after the renaming."""
    f = contents(spark, sf).where(F.col("content").rlike(r"\bitem\b"))
    return f.select("file_id", F.regexp_count("content", F.lit(r"\bitem\b")).cast("long").alias("n"), F.md5(F.regexp_replace("content", r"\bitem\b", "element")).alias("digest")).dropDuplicates(["file_id"])


@R.add("apply_refactor", r"SELECT file_id, md5(regexp_replace(regexp_replace(content, '\bitem\b', 'element', 'g'), '\blimit\b', 'bound', 'g')) digest FROM files WHERE regexp_matches(content, '\b(item|limit)\b')")
def apply_refactor(spark, sf):
    """Several renamings one after the other."""
    c = F.col("content")
    for a, b in (("item", "element"), ("limit", "bound")):
        c = F.regexp_replace(c, rf"\b{a}\b", b)
    return contents(spark, sf).where(F.col("content").rlike(r"\b(item|limit)\b")).select("file_id", F.md5(c).alias("digest")).dropDuplicates(["file_id"])


@R.add("layer_detection", "SELECT file_id, CASE WHEN regexp_matches(p, '/test|test_\\w+\\.py$|\\w+_test\\.py$|conftest') THEN 'test' WHEN regexp_matches(p, '/ui/|/views/|/pages/|/templates/|/static/') THEN 'ui' WHEN contains(p, '/component') THEN 'components' WHEN regexp_matches(p, '/service|/api/|/controller|/endpoint|/router|/middleware|/handler|/signal') THEN 'services' WHEN regexp_matches(p, '/util|/helper|/lib/|/common/') THEN 'utils' WHEN regexp_matches(p, '/data|/model|/store|/schema|/serializer|/migration|/fixtures/') THEN 'data' WHEN regexp_matches(p, '/task|/worker|/celery|/job') THEN 'services' WHEN regexp_matches(p, '/config|/settings|settings\\.py$') THEN 'config' WHEN regexp_matches(p, '/modules/|/bas/') THEN 'modules' WHEN regexp_matches(p, '/forms/|/userforms/') THEN 'ui' WHEN contains(p, '/classes/') THEN 'data' ELSE 'utils' END layer FROM (SELECT file_id, lower(path) p FROM files)")
def layer_detection(spark, sf):
    return files(spark, sf).select("file_id", S.layer_of(F.col("path")).alias("layer"))


@R.add("complexity", r"SELECT file_id, CAST(1 + CASE WHEN path LIKE '%.py' THEN len(regexp_extract_all(content, '\bif\s+')) + len(regexp_extract_all(content, '\belif\s+')) + len(regexp_extract_all(content, '\bwhile\s+')) + len(regexp_extract_all(content, '\bfor\s+\w+\s+in\s+')) + len(regexp_extract_all(content, '\bexcept\b')) + len(regexp_extract_all(content, '\bwith\s+')) + len(regexp_extract_all(content, '\band\b')) + len(regexp_extract_all(content, '\bor\b')) ELSE len(regexp_extract_all(content, '\bif\s*\(')) + len(regexp_extract_all(content, '\belse\s+if\s*\(')) + len(regexp_extract_all(content, '\bwhile\s*\(')) + len(regexp_extract_all(content, '\bfor\s*\(')) + len(regexp_extract_all(content, '\bcase\s+')) + len(regexp_extract_all(content, '\bcatch\s*\(')) + len(regexp_extract_all(content, '&&')) + len(regexp_extract_all(content, '\|\|')) END AS BIGINT) complexity FROM files WHERE is_code AND content IS NOT NULL")
def complexity(spark, sf):
    """Branches by pattern, plus one."""
    # What branches, in Python and in the brace languages.
    py = [r"\bif\s+", r"\belif\s+", r"\bwhile\s+", r"\bfor\s+\w+\s+in\s+", r"\bexcept\b", r"\bwith\s+", r"\band\b", r"\bor\b"]
    other = [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bcase\s+", r"\bcatch\s*\(", r"&&", r"\|\|"]
    n = lambda ps: sum((F.regexp_count("content", F.lit(p)) for p in ps), F.lit(1))
    return contents(spark, sf).where("is_code and content is not null").select("file_id", F.when(F.col("path").endswith(".py"), n(py)).otherwise(n(other)).cast("long").alias("complexity")).dropDuplicates(["file_id"])


@R.add("nesting", "WITH c AS (SELECT file_id, unnest(range(1, len(s) + 1)) i, unnest(s) x FROM (SELECT file_id, regexp_extract_all(content, '[{}]') s FROM files WHERE content IS NOT NULL)), r AS (SELECT file_id, sum(CASE x WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY file_id ORDER BY i) d FROM c) SELECT f.file_id, CAST(coalesce(max(greatest(d, 0)), 0) AS INTEGER) depth FROM files f LEFT JOIN r ON r.file_id = f.file_id WHERE content IS NOT NULL GROUP BY 1")
def nesting(spark, sf):
    return contents(spark, sf).where("content is not null").select("file_id", S.nesting_depth(F.col("content")).alias("depth")).dropDuplicates(["file_id"])


@R.add("import_edges", "SELECT repo_id, path source, unnest(imports) target FROM files")
def import_edges(spark, sf):
    return files(spark, sf).select("repo_id", F.col("path").alias("source"), F.explode("imports").alias("target"))


@R.add("duplicate_names", "SELECT repo_id, name, count(DISTINCT file) n_files FROM functions GROUP BY 1, 2 HAVING count(DISTINCT file) >= 3")
def duplicate_names(spark, sf):
    return functions(spark, sf).groupBy("repo_id", "name").agg(F.countDistinct("file").alias("n_files")).where("n_files >= 3")


@R.add("code_similarity")
def code_similarity(spark, sf):
    """Longest-common-subsequence similarity of the first two definitions of each repeated name."""
    from codestrata.operators.similarity import first_two_similar

    return first_two_similar(functions(spark, sf))
