"""Two-input operators, with SQL. The states are those of whole tables at two times, or of the first and the last snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import scalar as S
from codestrata.operators import diffs as D
from codestrata.plans.bindings import NEW_STATE, OLD_STATE, Registry, edges, files, functions, relations, symbols
from codestrata.session import load

R = Registry()
QUERIES, SQL = R.queries, R.sql
_AB = "o AS (SELECT repo_id, file, name FROM symbols_old), n AS (SELECT repo_id, file, name FROM symbols_new)"


def _two(spark, sf):
    """The symbols at two times, whole tables both."""
    k = ["repo_id", "file", "name"]
    return symbols(spark, sf, OLD_STATE).select(*k), symbols(spark, sf, NEW_STATE).select(*k), k


@R.add("diff", f"WITH {_AB} SELECT *, 'added' change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def diff(spark, sf):
    o, n, k = _two(spark, sf)
    return D.added_removed(o, n, k)


@R.add("api_diff", """WITH c AS (SELECT dst name, count(*) n_callers FROM relations GROUP BY 1), d AS (SELECT coalesce(o.repo_id, n.repo_id) repo_id, coalesce(o.file, n.file) file, coalesce(o.name, n.name) name, CASE WHEN n.name IS NULL THEN 'critical' WHEN o.name IS NULL THEN 'info' ELSE 'high' END severity
   FROM symbols_old o FULL JOIN symbols_new n ON o.repo_id = n.repo_id AND o.file = n.file AND o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.sig IS DISTINCT FROM n.sig) SELECT d.*, coalesce(n_callers, 0) n_callers FROM d LEFT JOIN c USING (name)""")
def api_diff(spark, sf):
    """Removed symbols (critical), changed signatures (high) and added ones (info), with their callers."""
    k = ["repo_id", "file", "name"]
    d = D.api_changes(symbols(spark, sf, OLD_STATE), symbols(spark, sf, NEW_STATE), k, "sig")
    c = relations(spark, sf).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n_callers"))
    return d.join(c, "name", "left").select(*k, "severity", F.coalesce("n_callers", F.lit(0).cast("long")).alias("n_callers"))


_RATE = "WITH {ab}, u AS (SELECT coalesce(o.repo_id, n.repo_id) repo_id, o.name a, n.name b FROM o FULL JOIN n ON o.repo_id = n.repo_id AND o.file = n.file AND o.name = n.name) "


@R.add("api_stability", _RATE.format(ab=_AB) + "SELECT repo_id, count(a) n_old, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) n_kept, CASE WHEN count(a) = 0 THEN 100.0 ELSE round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(a), 2) END pct FROM u GROUP BY 1")
def api_stability(spark, sf):
    o, n, k = _two(spark, sf)
    u = o.withColumn("a", F.lit(1)).join(n.withColumn("b", F.lit(1)), k, "full_outer")
    kept = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return u.groupBy("repo_id").agg(F.count("a").alias("n_old"), kept.alias("n_kept"), F.when(F.count("a") == 0, 100.0).otherwise(F.round(100.0 * kept / F.count("a"), 2)).alias("pct"))


@R.add("abi_diff", _RATE.format(ab=_AB) + "SELECT repo_id, count(*) FILTER (b IS NULL) n_removed, count(*) FILTER (a IS NULL) n_added, CAST(floor(100.0 * (count(a) - count(*) FILTER (b IS NULL)) / greatest(count(a), 1) + 0.5) AS BIGINT) score FROM u GROUP BY 1")
def abi_diff(spark, sf):
    o, n, k = _two(spark, sf)
    u = o.withColumn("a", F.lit(1)).join(n.withColumn("b", F.lit(1)), k, "full_outer")
    rem = F.count_if(F.col("b").isNull())
    return u.groupBy("repo_id").agg(rem.alias("n_removed"), F.count_if(F.col("a").isNull()).alias("n_added"), S.round_half_up(100.0 * (F.count("a") - rem) / F.greatest(F.count("a"), F.lit(1))).alias("score"))


@R.add("semver", _RATE.format(ab=_AB) + "SELECT repo_id, CASE WHEN count(*) FILTER (b IS NULL) > 0 THEN 'breach' WHEN count(*) FILTER (a IS NULL) > 0 THEN 'ok' ELSE 'ok' END verdict FROM u GROUP BY 1")
def semver(spark, sf):
    """Whether a minor bump was enough."""
    o, n, k = _two(spark, sf)
    u = o.withColumn("a", F.lit(1)).join(n.withColumn("b", F.lit(1)), k, "full_outer")
    return u.groupBy("repo_id").agg(D.semver_verdict(F.count_if(F.col("b").isNull()), F.count_if(F.col("a").isNull()), F.lit("minor")).alias("verdict"))


_FORKS = """r AS (SELECT repo_id, row_number() OVER (ORDER BY count(DISTINCT path) DESC, repo_id) k FROM files GROUP BY 1), fc AS (SELECT repo_id, file path, count(*) v FROM functions GROUP BY 1, 2),
 v AS (SELECT DISTINCT k, f.path, coalesce(v, 0) v FROM files f JOIN r ON r.repo_id = f.repo_id LEFT JOIN fc ON fc.repo_id = f.repo_id AND fc.path = f.path WHERE k <= 2)"""


@R.add("fork_diff", f"WITH {_FORKS} SELECT coalesce(o.path, n.path) path, CASE WHEN o.path IS NULL THEN 'only_new' WHEN n.path IS NULL THEN 'only_old' WHEN o.v = n.v THEN 'identical' ELSE 'diverged' END state FROM (SELECT * FROM v WHERE k = 1) o FULL JOIN (SELECT * FROM v WHERE k = 2) n ON o.path = n.path")
def fork_diff(spark, sf):
    """The two repositories of most files against each other; files of one path diverge if their numbers of functions differ."""
    f = files(spark, sf).select("repo_id", "path").dropDuplicates()
    two = [r.repo_id for r in f.groupBy("repo_id").agg(F.count("path").alias("n")).orderBy(F.desc("n"), "repo_id").limit(2).collect()]
    n = functions(spark, sf).groupBy("repo_id", F.col("file").alias("path")).agg(F.count("*").alias("v"))
    one = lambda k: f.where(F.col("repo_id") == F.lit(two[k] if len(two) > k else None)).join(n, ["repo_id", "path"], "left").select("path", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return D.states(one(0), one(1), ["path"], "v")


@R.add("cross_repo", "SELECT 'name' kind, name item, count(DISTINCT repo_id) n_repos FROM functions WHERE length(name) > 3 GROUP BY 1, 2 HAVING count(DISTINCT repo_id) > 1 UNION ALL SELECT 'layer', layer, count(DISTINCT repo_id) FROM files GROUP BY 1, 2 HAVING count(DISTINCT repo_id) > 1")
def cross_repo(spark, sf):
    """What repositories have in common."""
    n = F.countDistinct("repo_id").alias("n_repos")
    a = functions(spark, sf).where(F.length("name") > 3).groupBy(F.lit("name").alias("kind"), F.col("name").alias("item")).agg(n)
    b = files(spark, sf).groupBy(F.lit("layer").alias("kind"), F.col("layer").alias("item")).agg(n)
    return a.unionByName(b).where("n_repos > 1")


@R.add("run_diff", "WITH a AS (SELECT 'r' || r_regionkey k, r_name v FROM region), b AS (SELECT 'r' || (r_regionkey + 1) k, r_name v FROM region) SELECT coalesce(a.k, b.k) \"key\", a.v old_value, b.v new_value FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def run_diff(spark, sf):
    """Keys of two configurations whose values differ, null-safe."""
    r = load(spark, sf, "region")
    a = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("old_value"))
    b = r.select(F.concat(F.lit("r"), (F.col("r_regionkey") + 1).cast("string")).alias("key"), F.col("r_name").alias("new_value"))
    return a.join(b, "key", "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


_SNAPS = """sn AS (SELECT repo_id, id, created_at, data->>'$.healthGrade' grade, TRY_CAST(data->>'$.healthScore' AS DOUBLE) health, TRY_CAST(data->>'$.circularDepCount' AS BIGINT) cycles FROM (SELECT DISTINCT repo_id, id, created_at, data FROM snapshots WHERE json_valid(data) AND json_type(data) = 'OBJECT'))"""


@R.add("arch_diff", f"""WITH {_SNAPS}, e AS (SELECT repo_id, first(grade ORDER BY created_at, id) old_grade, last(grade ORDER BY created_at, id) new_grade, last(health ORDER BY created_at, id) - first(health ORDER BY created_at, id) health_delta FROM sn WHERE grade IS NOT NULL AND health IS NOT NULL GROUP BY 1)
 SELECT * FROM e WHERE list_position(['A', 'B', 'C', 'D', 'F'], new_grade) > list_position(['A', 'B', 'C', 'D', 'F'], old_grade)""")
def arch_diff(spark, sf):
    """Repositories whose grade is worse in the last readable snapshot than in the first, with the change of health."""
    s = D.readable_snapshots(load(spark, sf, "snapshots")).where("grade is not null and health is not null")
    v = F.struct("created_at", "id", "grade", "health")
    e = s.groupBy("repo_id").agg(F.min(v).alias("a"), F.max(v).alias("b"))
    return e.where(D.grade_worse(F.col("a.grade"), F.col("b.grade"))).select("repo_id", F.col("a.grade").alias("old_grade"), F.col("b.grade").alias("new_grade"), (F.col("b.health") - F.col("a.health")).alias("health_delta"))


@R.add("diff_snapshots", f"""WITH {_SNAPS}, w AS (SELECT *, lag(id) OVER o prev, health - lag(health) OVER o dh, cycles - lag(cycles) OVER o dc FROM sn WINDOW o AS (PARTITION BY repo_id ORDER BY created_at, id)),
 c AS (SELECT sn.repo_id, sn.id, regexp_replace(regexp_replace(replace(e.key, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '') path, max(TRY_CAST(e.value->>'$.in' AS DOUBLE)) n FROM (SELECT DISTINCT repo_id, id, data FROM snapshots WHERE json_valid(data) AND json_type(data, '$.fileCoupling') = 'OBJECT') sn, json_each(data->'$.fileCoupling') e GROUP BY ALL),
 g AS (SELECT w.id, w.repo_id, count(*) n_grown FROM w JOIN c a ON a.repo_id = w.repo_id AND a.id = w.prev JOIN c b ON b.repo_id = w.repo_id AND b.id = w.id AND b.path = a.path WHERE b.n - a.n >= 2 AND b.n > a.n * 1.2 GROUP BY ALL)
 SELECT w.repo_id, w.id snapshot_id, dh health_delta, dc cycles_delta, coalesce(n_grown, 0) n_grown, CASE WHEN dh <= -20 OR dc >= 5 OR coalesce(n_grown, 0) >= 5 THEN 'CRITICAL' WHEN dh <= -5 OR dc >= 1 OR coalesce(n_grown, 0) >= 2 THEN 'DEGRADED' ELSE 'STABLE' END drift FROM w LEFT JOIN g ON g.repo_id = w.repo_id AND g.id = w.id WHERE dh IS NOT NULL""")
def diff_snapshots(spark, sf):
    """Drift between consecutive readable snapshots: health, cycles, and files whose incoming coupling grew by two and a fifth."""
    return D.snapshot_drift(load(spark, sf, "snapshots"))


@R.add("heritage", "SELECT repo_id, count(*) FILTER (churn > 0) n_changed, count(*) n_files, round(100.0 * count(*) FILTER (churn = 0) / count(*), 2) heritage_pct FROM files GROUP BY 1")
def heritage(spark, sf):
    """Share of files taken over unchanged."""
    return files(spark, sf).groupBy("repo_id").agg(F.count_if(F.col("churn") > 0).alias("n_changed"), F.count("*").alias("n_files"), F.round(100.0 * F.count_if(F.col("churn") == 0) / F.count("*"), 2).alias("heritage_pct"))


@R.add("icd", "WITH w AS (SELECT DISTINCT repo_id, name, unnest(string_split(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_')) w FROM functions WHERE is_exported) SELECT i.entry, count(DISTINCT repo_id || name) n_implementations FROM (VALUES ('load'), ('cache'), ('missing')) i(entry) LEFT JOIN w ON w.w = i.entry GROUP BY 1")
def icd(spark, sf):
    """Interface entries and the exports that implement them, matched by word."""
    i = spark.createDataFrame([("load",), ("cache",), ("missing",)], "entry string")
    f = functions(spark, sf).where("is_exported").select("repo_id", "name", F.explode(F.split(F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2")), "_")).alias("entry")).dropDuplicates()
    n = f.groupBy("entry").agg(F.countDistinct("repo_id", "name").alias("n"))
    return F.broadcast(i).join(n, "entry", "left").select("entry", F.coalesce("n", F.lit(0).cast("long")).alias("n_implementations"))


@R.add("reuse", "SELECT repo_id, count(*) FILTER (is_exported) n_exported, count(*) n, CASE WHEN 100.0 * count(*) FILTER (is_exported) / count(*) >= 60 THEN 'green' WHEN 100.0 * count(*) FILTER (is_exported) / count(*) >= 30 THEN 'amber' ELSE 'red' END rag FROM functions GROUP BY 1")
def reuse(spark, sf):
    pct = 100.0 * F.count_if("is_exported") / F.count("*")
    return functions(spark, sf).groupBy("repo_id").agg(F.count_if("is_exported").alias("n_exported"), F.count("*").alias("n"), F.when(pct >= 60, "green").when(pct >= 30, "amber").otherwise("red").alias("rag"))


@R.add("set_operations", "SELECT (SELECT count(*) FROM (SELECT source FROM edges WHERE fn = 'R' INTERSECT SELECT target FROM edges WHERE fn = 'N')) n_both, (SELECT count(*) FROM (SELECT source, target FROM edges WHERE fn = 'R' EXCEPT SELECT source, target FROM edges WHERE fn = 'N')) n_only")
def set_operations(spark, sf):
    e = edges(spark, sf)
    a = e.where("fn = 'R'").select("source").intersect(e.where("fn = 'N'").select(F.col("target").alias("source"))).agg(F.count("*").alias("n_both"))
    b = e.where("fn = 'R'").select("source", "target").subtract(e.where("fn = 'N'").select("source", "target")).agg(F.count("*").alias("n_only"))
    return a.join(F.broadcast(b), F.lit(True))
