"""Model tables over the tables at hand, and the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codestrata.session import load


def files(spark, sf) -> DataFrame:
    """Files of all repositories, each once; missing figures are 0."""
    f = load(spark, sf, "file_records").select("file_id", "repo_id", "path", "name", "folder", "content", "language", "lines", "layer", "churn", "is_code", "complexity", "nesting_depth", "coupling_in", "coupling_out", "health_grade", "imports", "top_contributor", "contributor_count", "workspace", "indexed_at")
    return f.dropDuplicates(["file_id"]).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lines", "complexity", "churn", "coupling_in", "coupling_out")}).withColumn("layer", F.coalesce("layer", F.lit("unknown")))


def contents(spark, sf) -> DataFrame:
    """Files with their text as they stand; what comes of a text, not the text itself, is freed of repeated rows afterwards, so no text is shuffled."""
    f = load(spark, sf, "file_records").select("file_id", "repo_id", "path", "content", "layer", "is_code", "imports", "language")
    return f.withColumn("layer", F.coalesce("layer", F.lit("unknown")))


#: The times at which two states are compared.
OLD_STATE, NEW_STATE = "2024-10-01 00:00:00", "2025-12-31 00:00:00"


def symbols(spark, sf, at: str) -> DataFrame:
    """The symbols that were there at a time: (repo_id, file, name, sig) of the entities with a row loaded by then and not deleted by then."""
    e = load(spark, sf, "kg_entities").select("id", "type", "doc_id", "mentions", F.col("loaded_at").cast("timestamp_ntz").alias("s"), F.col("deleted_at").cast("timestamp_ntz").alias("e"))
    t = F.lit(at).cast("timestamp_ntz")
    e = e.where((F.col("s") <= t) & (F.col("e").isNull() | (F.col("e") > t)))
    by = [F.coalesce(F.regexp_replace(F.lower("type"), "[^a-z]+", ""), F.lit("none")).alias("repo_id"), F.coalesce("doc_id", F.lit("-")).alias("file"), F.lower(F.btrim("id")).alias("name")]
    return e.groupBy(*by).agg(F.max("mentions").alias("sig"))


def functions(spark, sf) -> DataFrame:
    return load(spark, sf, "fn_defs").dropDuplicates(["fn_id"])


def edges(spark, sf) -> DataFrame:
    """Weighted multigraph of nations: supplier's nation to customer's nation, labelled by return flag."""
    t = lambda n, *c: load(spark, sf, n).select(*c)
    nation = t("nation", "n_nationkey", "n_name")
    sup = t("supplier", "s_suppkey", "s_nationkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("source"))
    cust = t("customer", "c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("target"))
    orders = t("orders", "o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "target")
    li = t("lineitem", "l_orderkey", "l_suppkey", F.col("l_returnflag").alias("fn"))
    j = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("source", "target", "fn").agg(F.count("*").alias("count"))


def pairs(spark, sf) -> DataFrame:
    return edges(spark, sf).where("source <> target").groupBy("source", "target").agg(F.sum("count").alias("n"))


def links(spark, sf) -> DataFrame:
    """The whole graph of the relations: which entity leads to which other one, with the number of relations. Half a million edges and a hub of a tenth of them at scale 1."""
    r = relations(spark, sf).where("src <> dst")
    return r.groupBy(F.col("src").alias("source"), F.col("dst").alias("target")).agg(F.count("*").alias("n"))


def top_sources(spark, sf, k: int) -> list[str]:
    """The k nodes with most ways out, the asked starts of traversals: at most k names."""
    n = links(spark, sf).groupBy("source").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "source").limit(k)
    return [r.source for r in n.collect()]


def nodes(spark, sf) -> DataFrame:
    """The nodes of the graph of relations as files: layer is the entity's type."""
    e = links(spark, sf)
    n = e.select(F.col("source").alias("path")).unionByName(e.select(F.col("target").alias("path"))).dropDuplicates()
    return n.join(entities(spark, sf).select(F.lower(F.btrim("id")).alias("path"), "type").groupBy("path").agg(F.min("type").alias("type")), "path", "left").select("path", F.coalesce("type", F.lit("unknown")).alias("layer"))


def gfiles(spark, sf) -> DataFrame:
    """Nodes of the nation graph as files: layer is the region, lines customers, complexity suppliers, churn orders."""
    n = load(spark, sf, "nation").join(F.broadcast(load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("path"), F.col("r_name").alias("layer"))
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("lines"))
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("complexity"))
    o = load(spark, sf, "orders").select("o_custkey").join(load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")).groupBy("n_nationkey").agg(F.count("*").alias("churn"))
    j = n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").join(o, "n_nationkey", "left")
    return j.select("path", "layer", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("lines", "complexity", "churn")])


def relations(spark, sf) -> DataFrame:
    """Relations of the knowledge graph with canonical ends, each once."""
    from codestrata.operators.references import canonical_key

    r = load(spark, sf, "kg_relations").dropDuplicates(["id"])
    return r.select("id", canonical_key(F.col("src_id")).alias("src"), canonical_key(F.col("dst_id")).alias("dst"), "src_name", "dst_name", "type", "method", "weight", "confidence").where("src is not null and dst is not null")


def entities(spark, sf) -> DataFrame:
    """Entities, the first loaded row of each id."""
    w = W.partitionBy("id").orderBy(F.col("loaded_at").asc_nulls_first(), "name")
    e = load(spark, sf, "kg_entities").dropDuplicates()
    return e.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "name", "type", "doc_id", "method", "mentions")


def chunks(spark, sf) -> DataFrame:
    return load(spark, sf, "kg_chunks").select("id", "doc_id", "idx", "text").dropDuplicates(["id"])


def traces(spark, sf) -> DataFrame:
    """Events as calls between the event types of one user, in order."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf, "events").withColumn("callee", F.lead("event_type").over(w)).withColumn("ms", F.col("value"))
    return e.where("callee is not null").select("event_id", "ts", "user_id", F.col("event_type").alias("caller"), "callee", "ms")


SQL_BASE = r"""
files AS (SELECT DISTINCT ON (file_id) file_id, repo_id, path, name, folder, content, language, coalesce(lines, 0) "lines", coalesce(layer, 'unknown') layer, coalesce(churn, 0) churn, is_code, coalesce(complexity, 0) complexity, nesting_depth, coalesce(coupling_in, 0) coupling_in, coalesce(coupling_out, 0) coupling_out, health_grade, imports, top_contributor, contributor_count, workspace, indexed_at FROM file_records),
functions AS (SELECT DISTINCT ON (fn_id) * FROM fn_defs),
edges AS (SELECT sn.n_name source, cn.n_name target, l_returnflag fn, count(*) "count" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey GROUP BY ALL),
pairs AS (SELECT source, target, CAST(sum("count") AS BIGINT) n FROM edges WHERE source <> target GROUP BY ALL),
gfiles AS (SELECT n_name path, r_name layer, coalesce(l, 0) "lines", coalesce(x, 0) complexity, coalesce(o, 0) churn FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT c_nationkey k, count(*) l FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey k, count(*) x FROM supplier GROUP BY 1) b ON b.k = n_nationkey
  LEFT JOIN (SELECT c_nationkey k, count(*) o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c ON c.k = n_nationkey),
relations AS (SELECT DISTINCT ON (id) id, nullif(lower(trim(src_id)), '') src, nullif(lower(trim(dst_id)), '') dst, src_name, dst_name, type, method, weight, confidence FROM kg_relations WHERE nullif(trim(src_id), '') IS NOT NULL AND nullif(trim(dst_id), '') IS NOT NULL),
entities AS (SELECT id, name, type, doc_id, method, mentions FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS FIRST, name) rn FROM (SELECT DISTINCT * FROM kg_entities)) WHERE rn = 1),
links AS (SELECT src source, dst target, count(*) n FROM relations WHERE src <> dst GROUP BY ALL),
tops AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) k FROM links GROUP BY 1),
nodes AS (SELECT path, coalesce(type, 'unknown') layer FROM (SELECT source path FROM links UNION SELECT target FROM links) LEFT JOIN (SELECT lower(trim(id)) path, min(type) type FROM entities GROUP BY 1) USING (path)),
symbols_old AS (SELECT coalesce(regexp_replace(lower(type), '[^a-z]+', '', 'g'), 'none') repo_id, coalesce(doc_id, '-') file, lower(trim(id)) name, max(mentions) sig FROM kg_entities WHERE loaded_at <= TIMESTAMP '2024-10-01' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '2024-10-01') GROUP BY ALL),
symbols_new AS (SELECT coalesce(regexp_replace(lower(type), '[^a-z]+', '', 'g'), 'none') repo_id, coalesce(doc_id, '-') file, lower(trim(id)) name, max(mentions) sig FROM kg_entities WHERE loaded_at <= TIMESTAMP '2025-12-31' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '2025-12-31') GROUP BY ALL),
chunks AS (SELECT DISTINCT ON (id) id, doc_id, idx, text FROM kg_chunks),
traces AS (SELECT event_id, ts, user_id, event_type caller, callee, value ms FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) callee FROM events) WHERE callee IS NOT NULL)
"""


class Registry:
    """Collects queries with their SQL; the SQL may use the model tables by name."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = f"WITH RECURSIVE {SQL_BASE} {',' if sql.lstrip().lower().startswith('with ') else ''} " + (sql.lstrip()[5:] if sql.lstrip().lower().startswith("with ") else sql)
            return f

        return put
