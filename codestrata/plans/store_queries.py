"""Registry, store, time and trace operators, with SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from codestrata.functions import scalar as S
from codestrata.plans.bindings import OLD_STATE, Registry, files, functions, symbols, traces
from codestrata.plans.data_queries import _P1
from codestrata.session import load

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _repos(spark, sf):
    return files(spark, sf).groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"), F.max("indexed_at").alias("indexed_at"), F.round(F.avg("complexity"), 4).alias("avg_complexity"))


_REPOS = "repos AS (SELECT repo_id, count(*) n_files, CAST(sum(\"lines\") AS BIGINT) n_lines, max(indexed_at) indexed_at, round(avg(complexity), 4) avg_complexity FROM files GROUP BY 1)"


@R.add("repos", f"WITH {_REPOS} SELECT * FROM repos")
def repos(spark, sf):
    return _repos(spark, sf)


QUERIES["brain_status"], SQL["brain_status"] = repos, SQL["repos"]


@R.add("registry_list", f"WITH {_REPOS}, s AS (SELECT repo_id, list_sort(list(DISTINCT id)) sessions FROM snapshots GROUP BY 1) SELECT repo_id, n_files, coalesce(len(sessions), 0) n_sessions FROM repos LEFT JOIN s USING (repo_id)")
def registry_list(spark, sf):
    s = load(spark, sf, "snapshots").groupBy("repo_id").agg(F.countDistinct("id").alias("n"))
    return _repos(spark, sf).join(s, "repo_id", "left").select("repo_id", "n_files", F.coalesce("n", F.lit(0).cast("long")).alias("n_sessions"))


@R.add("registry_status", f"WITH {_REPOS} SELECT count(*) n_repos, CAST(sum(n_files) AS BIGINT) n_files, count(*) FILTER (avg_complexity > 8) n_complex FROM repos")
def registry_status(spark, sf):
    return _repos(spark, sf).agg(F.count("*").alias("n_repos"), F.sum("n_files").alias("n_files"), F.count_if(F.col("avg_complexity") > 8).alias("n_complex"))


@R.add("sessions", "SELECT repo_id, id, created_at FROM (SELECT DISTINCT repo_id, id, created_at FROM snapshots) WHERE created_at + 30 * 86400 > 1712000000")
def sessions(spark, sf):
    """Sessions that have not expired at a given time."""
    return load(spark, sf, "snapshots").select("repo_id", "id", "created_at").dropDuplicates().where(F.col("created_at") + 30 * 86400 > 1712000000)


@R.add("latest_snapshot", "SELECT repo_id, max(struct_pack(c := created_at, i := id)).i id FROM snapshots GROUP BY 1")
def latest_snapshot(spark, sf):
    return load(spark, sf, "snapshots").groupBy("repo_id").agg(F.max(F.struct("created_at", "id")).alias("m")).select("repo_id", "m.id")


@R.add("snapshot", "SELECT repo_id, path, coupling_in, coupling_out, CAST(sum(coupling_in) OVER w AS BIGINT) coupling, count(*) OVER w n_files FROM (SELECT DISTINCT repo_id, path, coupling_in, coupling_out FROM files WHERE is_code) WINDOW w AS (PARTITION BY repo_id)")
def snapshot(spark, sf):
    """The rows of a snapshot, one per code file beside its repository's totals; no repository is gathered in one row."""
    f = files(spark, sf).where("is_code").select("repo_id", "path", "coupling_in", "coupling_out").dropDuplicates()
    return f.join(f.groupBy("repo_id").agg(F.sum("coupling_in").alias("coupling"), F.count("*").alias("n_files")), "repo_id")


@R.add("snapshot_history", "SELECT repo_id, id FROM (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, id DESC) rn FROM (SELECT DISTINCT repo_id, id, created_at FROM snapshots)) WHERE rn <= 5")
def snapshot_history(spark, sf):
    """Retention: the last five snapshots of each repository."""
    w = W.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("id"))
    return load(spark, sf, "snapshots").select("repo_id", "id", "created_at").dropDuplicates().withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("repo_id", "id")


@R.add("group_list", "SELECT DISTINCT workspace, repo_id FROM files WHERE workspace IS NOT NULL")
def group_list(spark, sf):
    """Members of each group, a row each."""
    return files(spark, sf).where("workspace is not null").select("workspace", "repo_id").dropDuplicates()


@R.add("group_add", "SELECT DISTINCT workspace, repo_id FROM files WHERE workspace IS NOT NULL UNION SELECT 'new', 'repo'")
def group_add(spark, sf):
    """Adding a member twice changes nothing."""
    f = files(spark, sf).where("workspace is not null").select("workspace", "repo_id")
    return f.unionByName(spark.createDataFrame([("new", "repo"), ("new", "repo")], "workspace string, repo_id string")).dropDuplicates()


@R.add("graph_schema", "SELECT 'files' table_name, count(*) n_rows FROM files UNION ALL SELECT 'functions', count(*) FROM functions UNION ALL SELECT 'relations', count(*) FROM kg_relations")
def graph_schema(spark, sf):
    n = lambda d, t: d.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
    return n(files(spark, sf), "files").unionByName(n(functions(spark, sf), "functions")).unionByName(n(load(spark, sf, "kg_relations"), "relations"))


QUERIES["repo_schema"], SQL["repo_schema"] = graph_schema, SQL["graph_schema"]


@R.add("store_top_files", "SELECT file_id, path, complexity FROM files WHERE layer = 'services' AND complexity >= 5 ORDER BY complexity DESC, file_id LIMIT 20")
def store_top_files(spark, sf):
    return files(spark, sf).where("layer = 'services' and complexity >= 5").orderBy(F.desc("complexity"), "file_id").limit(20).select("file_id", "path", "complexity")


@R.add("store_like", "SELECT fn_id, name FROM functions WHERE name ILIKE '%\\_by\\_id%' ESCAPE '\\' ORDER BY fn_id LIMIT 50")
def store_like(spark, sf):
    """Names by pattern; the escape keeps the underscore literal."""
    return functions(spark, sf).where(F.lower("name").contains("_by_id")).orderBy("fn_id").limit(50).select("fn_id", "name")


@R.add("store_range", "SELECT fn_id, line FROM functions WHERE line BETWEEN 10 AND 20")
def store_range(spark, sf):
    return functions(spark, sf).where(F.col("line").between(10, 20)).select("fn_id", "line")


@R.add("store_min_by", "SELECT repo_id, folder, min(coupling_in) depth, min_by(path, (coupling_in, path)) path FROM files GROUP BY 1, 2")
def store_min_by(spark, sf):
    """The row of the least value, ties to the lesser path."""
    return files(spark, sf).groupBy("repo_id", "folder").agg(F.min("coupling_in").alias("depth"), F.min_by("path", F.struct("coupling_in", "path")).alias("path"))


@R.add("brain_index", "SELECT repo_id, count(DISTINCT path) n_files, count(DISTINCT folder) n_folders FROM files GROUP BY 1")
def brain_index(spark, sf):
    return files(spark, sf).groupBy("repo_id").agg(F.countDistinct("path").alias("n_files"), F.countDistinct("folder").alias("n_folders"))


@R.add("repo_context", f"WITH {_REPOS} SELECT repo_id, n_files, date_diff('day', indexed_at, TIMESTAMP '2026-01-01') age_days, date_diff('day', indexed_at, TIMESTAMP '2026-01-01') > 365 stale FROM repos")
def repo_context(spark, sf):
    age = F.datediff(F.lit("2026-01-01").cast("date"), F.to_date("indexed_at")).cast("long")
    return _repos(spark, sf).select("repo_id", "n_files", age.alias("age_days"), (age > 365).alias("stale"))


@R.add("repo_clusters", "SELECT repo_id, split_part(path, '/', 1) cluster, count(*) n_files, list_sort(list(path))[1:5] samples FROM files GROUP BY 1, 2")
def repo_clusters(spark, sf):
    """Files by top folder, with five samples: the least paths, kept by a bounded top-k, not by collecting the group."""
    c = files(spark, sf).select("repo_id", F.substring_index("path", "/", 1).alias("cluster"), "path")
    w = W.partitionBy("repo_id", "cluster").orderBy("path")
    s = c.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("repo_id", "cluster").agg(F.array_sort(F.collect_list("path")).alias("samples"))
    return c.groupBy("repo_id", "cluster").agg(F.count("*").alias("n_files")).join(s, ["repo_id", "cluster"])


@R.add("repo_cluster", "SELECT file_id, path FROM files WHERE folder LIKE 'src/core%'")
def repo_cluster(spark, sf):
    return files(spark, sf).where(F.col("folder").startswith("src/core")).select("file_id", "path")


@R.add("repo_processes", "SELECT user_id process, count(DISTINCT event_type) n_steps, count(*) n FROM events GROUP BY 1")
def repo_processes(spark, sf):
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("process")).agg(F.countDistinct("event_type").alias("n_steps"), F.count("*").alias("n"))


@R.add("repo_process", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) step FROM events")
def repo_process(spark, sf):
    return load(spark, sf, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("step"))


@R.add("setup", f"WITH {_REPOS} SELECT 'repository ' || repo_id || ': ' || n_files || ' files' AS line FROM repos")
def setup(spark, sf):
    return _repos(spark, sf).select(F.format_string("repository %s: %d files", "repo_id", "n_files").alias("line"))


# -- traces and time
@R.add("runtime_calls", "WITH c AS (SELECT caller, callee, count(*) n, CAST(sum(CAST(ms AS DECIMAL(18, 6))) AS DOUBLE) ms FROM traces GROUP BY 1, 2) SELECT caller, callee, n, round(ms / n, 2) avg_ms, rank FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY n DESC, caller) rank FROM c) WHERE rank = 1")
def runtime_calls(spark, sf):
    """For each callee the caller with most calls."""
    c = traces(spark, sf).groupBy("caller", "callee").agg(F.count("*").alias("n"), F.sum(F.col("ms").cast("decimal(18,6)")).cast("double").alias("ms"))
    w = W.partitionBy("callee").orderBy(F.desc("n"), "caller")
    return c.withColumn("rank", F.row_number().over(w).cast("long")).where("rank = 1").select("caller", "callee", "n", F.round(F.col("ms") / F.col("n"), 2).alias("avg_ms"), "rank")


@R.add("trace_accumulator", "SELECT caller, callee, count(*) n, round(CAST(sum(CAST(ms AS DECIMAL(18, 6))) AS DOUBLE), 4) total_ms, min(ms) min_ms, max(ms) max_ms, count(*) FILTER (callee = 'error') n_errors FROM traces GROUP BY 1, 2 HAVING count(*) >= 5")
def trace_accumulator(spark, sf):
    from codestrata.streaming.traces import accumulate

    return accumulate(traces(spark, sf), min_count=5)


@R.add("service_graph", "SELECT caller service, callee AS \"to\", count(*) weight FROM traces GROUP BY 1, 2")
def service_graph(spark, sf):
    return traces(spark, sf).groupBy(F.col("caller").alias("service"), F.col("callee").alias("to")).agg(F.count("*").alias("weight"))


@R.add("hot_files", "SELECT callee, count(*) n, round(CAST(sum(CAST(ms AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 4) avg_ms FROM traces GROUP BY 1")
def hot_files(spark, sf):
    return traces(spark, sf).groupBy("callee").agg(F.count("*").alias("n"), F.round(F.sum(F.col("ms").cast("decimal(18,6)")).cast("double") / F.count("*"), 4).alias("avg_ms"))


@R.add("commits", "SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') n_7d, count(*) FILTER (ts >= TIMESTAMP '2024-01-01') n_30d FROM events GROUP BY 1")
def commits(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")).alias("n_7d"), F.count_if(F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")).alias("n_30d"))


@R.add("ci_status", "SELECT event_type workflow, max_by(event_id, (ts, event_id)) latest_run FROM events GROUP BY 1")
def ci_status(spark, sf):
    return load(spark, sf, "events").groupBy(F.col("event_type").alias("workflow")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_run"))


@R.add("dora", "SELECT date_trunc('week', ts) \"week\", count(*) FILTER (event_type = 'purchase') deploys, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 4) failure_pct FROM events GROUP BY 1")
def dora(spark, sf):
    return load(spark, sf, "events").groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.count_if(F.col("event_type") == "purchase").alias("deploys"), F.round(100.0 * F.count_if(F.col("event_type") == "error") / F.count("*"), 4).alias("failure_pct"))


@R.add("timeline", "WITH c AS (SELECT DISTINCT CAST(ts AS DATE) d, user_id, event_type f FROM events) SELECT a.f a, b.f b, count(*) n FROM c a JOIN c b ON a.d = b.d AND a.user_id = b.user_id AND a.f < b.f GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, a, b LIMIT 10")
def timeline(spark, sf):
    """Things that change together: pairs within one commit (user and day), whose size the event types bound."""
    c = load(spark, sf, "events").select(F.to_date("ts").alias("d"), "user_id", F.col("event_type").alias("f")).groupBy("d", "user_id").agg(F.array_sort(F.collect_set("f")).alias("fs"))
    p = c.select(F.explode("fs").alias("a"), "fs").select("a", F.explode(F.filter("fs", lambda x: x > F.col("a"))).alias("b"))
    return p.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "a", "b").limit(10)


@R.add("ownership", "WITH c AS (SELECT event_type path, user_id author, count(*) n, min(ts) first_ts FROM events GROUP BY 1, 2) SELECT path, max_by(author, (n, -epoch(first_ts), author)) top_author, count(*) n_authors FROM c GROUP BY 1")
def ownership(spark, sf):
    """Top author of each path (most commits, then the earliest) and the number of authors."""
    c = load(spark, sf, "events").groupBy(F.col("event_type").alias("path"), F.col("user_id").alias("author")).agg(F.count("*").alias("n"), F.min("ts").alias("t"))
    return c.groupBy("path").agg(F.max_by("author", F.struct(F.col("n"), -F.unix_micros(F.col("t").cast("timestamp")), F.col("author"))).alias("top_author"), F.count("*").alias("n_authors"))


@R.add("tumbling_counts", "SELECT date_trunc('day', ts) start, event_type, count(*) n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@R.add("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) k FROM g) SELECT user_id, min(ts) start, count(*) n FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    """Events of one user with gaps below an hour: the quiet period of a debounced watch."""
    e = load(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("s")).select("user_id", F.col("s").alias("start"), "n")


@R.add("transition_edges", "SELECT caller source, callee target, count(*) n FROM traces GROUP BY 1, 2")
def transition_edges(spark, sf):
    return traces(spark, sf).groupBy(F.col("caller").alias("source"), F.col("callee").alias("target")).agg(F.count("*").alias("n"))


@R.add("rate_limit", "SELECT user_id, count(*) FILTER (n > 5) n_limited_windows, CAST(sum(greatest(n - 5, 0)) AS BIGINT) n_rejected FROM (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) b, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def rate_limit(spark, sf):
    """Requests beyond five per fixed window and key."""
    e = load(spark, sf, "events")
    c = e.groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.count_if(F.col("n") > 5).alias("n_limited_windows"), F.sum(F.greatest(F.col("n") - 5, F.lit(0))).cast("long").alias("n_rejected"))


@R.add("digest", "SELECT * FROM (SELECT event_type, d, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY d) change FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') d, count(*) n FROM events GROUP BY 1, 2)) WHERE change IS NOT NULL")
def digest(spark, sf):
    """Each day against the day before."""
    c = load(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n"))
    return c.withColumn("change", F.col("n") - F.lag("n").over(W.partitionBy("event_type").orderBy("d"))).where("change is not null")


@R.add("audit_log", "SELECT event_id FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 50")
def audit_log(spark, sf):
    return load(spark, sf, "events").where("user_id = 3").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id")


@R.add("vuln_watch", "WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-05'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05') SELECT * FROM b EXCEPT SELECT * FROM a")
def vuln_watch(spark, sf):
    """What a rescan finds that the one before did not."""
    from codestrata.streaming.traces import new_since

    e = load(spark, sf, "events").select("user_id", "event_type", "ts")
    cut = F.lit("2024-01-05").cast("timestamp_ntz")
    return new_since(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["user_id", "event_type"])


@R.add("watch", f"""WITH {_P1}, l AS (SELECT repo_id, last(id ORDER BY created_at NULLS FIRST, id) snapshot_id FROM s0 GROUP BY 1)
 SELECT d.repo_id, d.snapshot_id, count(*) FILTER (field = 'fileCoupling' AND change = 'added') n_added, count(*) FILTER (field = 'fileCoupling' AND change = 'removed') n_removed, count(*) FILTER (field = 'fileCoupling' AND change = 'changed') n_changed, count(*) FILTER (field = 'healthScore') > 0 health_changed FROM d JOIN l ON l.repo_id IS NOT DISTINCT FROM d.repo_id AND l.snapshot_id = d.snapshot_id WHERE change IS NOT NULL GROUP BY ALL""")
def watch(spark, sf):
    """What the newest readable delivery of each repository changed against the one before; no row if it changed nothing."""
    from codestrata.operators.diffs import readable_snapshots
    from codestrata.operators.snapshots import snapshot_changes

    d = snapshot_changes(load(spark, sf, "snapshots"))
    is_ = lambda f, c=None: (F.col("field") == f) & (F.lit(True) if c is None else F.col("change") == c)
    per = d.groupBy("repo_id", "snapshot_id").agg(*[F.count_if(is_("fileCoupling", c)).alias(f"n_{c}") for c in ("added", "removed", "changed")], (F.count_if(is_("healthScore")) > 0).alias("health_changed"))
    last = readable_snapshots(load(spark, sf, "snapshots")).groupBy("repo_id").agg(F.max(F.struct("created_at", "id"))["id"].alias("last_id"))
    newest = last.select(F.col("repo_id").alias("_r"), "last_id")
    return per.join(newest, F.col("repo_id").eqNullSafe(F.col("_r")) & (F.col("snapshot_id") == F.col("last_id"))).select(*per.columns)


@R.add("incremental_merge", "WITH o AS (SELECT name, max(sig) v FROM symbols_old GROUP BY 1), n AS (SELECT lower(trim(id)) name, max(mentions) v FROM kg_entities WHERE loaded_at > TIMESTAMP '2024-10-01' GROUP BY 1) SELECT coalesce(n.name, o.name) name, CASE WHEN n.name IS NULL THEN o.v ELSE n.v END v FROM o FULL JOIN n ON o.name = n.name")
def incremental_merge(spark, sf):
    """The old state with the rows that came later put in by key: affected rows replaced, the others kept."""
    old = symbols(spark, sf, OLD_STATE).groupBy("name").agg(F.max("sig").alias("v"))
    late = load(spark, sf, "kg_entities").where(F.col("loaded_at").cast("timestamp_ntz") > F.lit(OLD_STATE).cast("timestamp_ntz"))
    fresh = late.groupBy(F.lower(F.btrim("id")).alias("name")).agg(F.max("mentions").alias("v"))
    return old.join(fresh.select("name"), "name", "left_anti").unionByName(fresh)


@R.add("rollup_report", "SELECT repo_id, layer, count(*) n FROM files GROUP BY ROLLUP (repo_id, layer)")
def rollup_report(spark, sf):
    return files(spark, sf).rollup("repo_id", "layer").agg(F.count("*").alias("n"))
