"""Search, retrieval and knowledge-graph operators, with SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from codestrata.functions import scalar as S
from codestrata.operators import graph, search as Q
from codestrata.plans.bindings import OLD_STATE, Registry, chunks, entities, functions, relations
from codestrata.session import load

R = Registry()
QUERIES, SQL = R.queries, R.sql
_WORDS = ["schema", "cache", "reflection"]
_BM = """w AS (SELECT doc_id "key", regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) n, avg(len(w)) a FROM w),
 tf AS (SELECT "key", len, term, count(*) tf FROM (SELECT "key", len(w) len, unnest(w) term FROM w) WHERE term IN ('schema', 'cache', 'reflection') GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
 bm AS (SELECT "key", round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) score FROM tf JOIN df USING (term), st GROUP BY 1)"""
_CS = """q AS (SELECT embedding e FROM embeddings WHERE vec_id = 0), cs AS (SELECT vec_id "key", round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(e[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-8), 6) score FROM embeddings, q)"""


def _query_vector(spark, sf):
    return [float(x) for x in load(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@R.add("lexical_search", f"WITH {_BM} SELECT * FROM bm ORDER BY score DESC, \"key\" LIMIT 10")
def lexical_search(spark, sf):
    return Q.bm25(load(spark, sf, "documents"), "doc_id", "text", _WORDS)


@R.add("vector_search", f"WITH {_CS} SELECT * FROM cs ORDER BY score DESC, \"key\" LIMIT 10")
def vector_search(spark, sf):
    return Q.nearest(load(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf))


@R.add("search", f"WITH {_BM}, {_CS}, a AS (SELECT \"key\", row_number() OVER (ORDER BY score DESC, \"key\") r FROM bm ORDER BY score DESC, \"key\" LIMIT 20), b AS (SELECT \"key\", row_number() OVER (ORDER BY score DESC, \"key\") r FROM cs ORDER BY score DESC, \"key\" LIMIT 20) SELECT \"key\", round(sum(1.0 / (60 + r)), 9) score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY score DESC, \"key\" LIMIT 10")
def search(spark, sf):
    """Lexical and vector lists of twice the limit, fused by rank."""
    a = Q.bm25(load(spark, sf, "documents"), "doc_id", "text", _WORDS, 20)
    b = Q.nearest(load(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 20)
    return Q.fuse([a, b])


@R.add("semantic_search", "SELECT fn_id, name FROM functions WHERE contains(lower(name), 'cache') ORDER BY length(name), name, fn_id LIMIT 10")
def semantic_search(spark, sf):
    """Keyword fallback: names that hold the word, shorter ones first."""
    return functions(spark, sf).where(F.lower("name").contains("cache")).orderBy(F.length("name"), "name", "fn_id").limit(10).select("fn_id", "name")


@R.add("term_index", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term FROM documents WHERE text IS NOT NULL) SELECT term, count(DISTINCT doc_id) n_docs, count(*) n FROM t GROUP BY 1")
def term_index(spark, sf):
    """Inverted index statistics over all documents."""
    return Q.terms_of(load(spark, sf, "documents").dropDuplicates(["doc_id"]), "doc_id", "text").groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


@R.add("ask", "SELECT CASE WHEN regexp_matches(lower(name), 'cycle|circular') THEN 'cycles' WHEN regexp_matches(lower(name), 'health|score') THEN 'health' WHEN regexp_matches(lower(name), 'hotspot|risk') THEN 'hotspots' WHEN regexp_matches(lower(name), 'layer|depend') THEN 'architecture' WHEN regexp_matches(lower(name), 'secur|token') THEN 'security' ELSE 'complexity' END intent, count(*) n FROM functions GROUP BY 1")
def ask(spark, sf):
    """Intent of a question by ordered expressions, here over function names."""
    # Intents in order.
    rules = [("cycle|circular", "cycles"), ("health|score", "health"), ("hotspot|risk", "hotspots"), ("layer|depend", "architecture"), ("secur|token", "security")]
    n, out = F.lower("name"), None
    for p, i in rules:
        out = F.when(n.rlike(p), i) if out is None else out.when(n.rlike(p), i)
    return functions(spark, sf).groupBy(out.otherwise("complexity").alias("intent")).agg(F.count("*").alias("n"))


# -- knowledge graph
@R.add("kg_stats", "SELECT (SELECT count(DISTINCT id) FROM kg_docs) n_docs, (SELECT count(*) FROM chunks) n_chunks, (SELECT count(*) FROM entities) n_entities, (SELECT count(*) FROM relations) n_relations, (SELECT count(*) FROM relations WHERE method = 'EXTRACTED') n_extracted, (SELECT count(*) FROM relations WHERE method = 'INFERRED') n_inferred")
def kg_stats(spark, sf):
    n = lambda d, a: d.agg(F.count("*").alias(a))
    r = relations(spark, sf)
    parts = [n(load(spark, sf, "kg_docs").select("id").dropDuplicates(), "n_docs"), n(chunks(spark, sf), "n_chunks"), n(entities(spark, sf), "n_entities"), n(r, "n_relations").join(F.broadcast(r.agg(F.count_if(F.col("method") == "EXTRACTED").alias("n_extracted"), F.count_if(F.col("method") == "INFERRED").alias("n_inferred"))), F.lit(True))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))
    return out


_KD = "dg AS (SELECT node, count(*) degree FROM (SELECT src node FROM relations UNION ALL SELECT dst FROM relations WHERE dst <> src) GROUP BY 1)"


@R.add("kg_hubs", f"WITH {_KD} SELECT node, degree FROM dg ORDER BY degree DESC, node LIMIT 10")
def kg_hubs(spark, sf):
    """Entities by degree; a relation of an entity with itself counts once."""
    r = relations(spark, sf)
    return r.select(F.col("src").alias("node")).unionByName(r.where("src <> dst").select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(10)


_TOP = "(SELECT node FROM dg ORDER BY degree DESC, node LIMIT 1)"


@R.add("kg_neighbours", f"WITH {_KD}, t AS {_TOP} SELECT DISTINCT other, direction FROM (SELECT dst other, 'out' direction FROM relations, t WHERE src = node UNION ALL SELECT src, 'in' FROM relations, t WHERE dst = node)")
def kg_neighbours(spark, sf):
    r = relations(spark, sf)
    t = F.broadcast(kg_hubs(spark, sf).limit(1).select("node"))
    return r.join(t, r.src == F.col("node")).select(F.col("dst").alias("other"), F.lit("out").alias("direction")).unionByName(r.join(t, r.dst == F.col("node")).select(F.col("src").alias("other"), F.lit("in").alias("direction"))).dropDuplicates()


@R.add("entity_lookup", "SELECT id, name, mentions FROM entities WHERE lower(name) LIKE '%cache%' ORDER BY mentions DESC NULLS LAST, id LIMIT 10")
def entity_lookup(spark, sf):
    return entities(spark, sf).where(F.lower("name").contains("cache")).orderBy(F.col("mentions").desc_nulls_last(), "id").limit(10).select("id", "name", "mentions")


@R.add("kg_upsert", "SELECT 'rel_' || substr(sha1(lower(src || '::' || type || '::' || dst)), 1, 12) id, count(*) n, CAST(sum(weight) AS BIGINT) weight, CASE WHEN max(CASE WHEN method = 'EXTRACTED' THEN 1 ELSE 0 END) = 1 THEN 'EXTRACTED' ELSE 'INFERRED' END method FROM relations WHERE type IS NOT NULL GROUP BY 1")
def kg_upsert(spark, sf):
    """Relations merged by identity: weights add up, an extracted one outranks an inferred one."""
    r = relations(spark, sf).where("type is not null")
    return r.groupBy(S.relation_id(F.col("src"), F.col("type"), F.col("dst")).alias("id")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.when(F.max((F.col("method") == "EXTRACTED").cast("int")) == 1, "EXTRACTED").otherwise("INFERRED").alias("method"))


@R.add("kg_extract", "WITH h AS (SELECT doc_id, 'topic' kind, unnest(regexp_extract_all(text, '(?m)^#{1,6}\\s+([^\\r\\n]+)', 1)) \"name\" FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'code', unnest(regexp_extract_all(text, '`([A-Za-z_][\\w.]*)[^`\\n]*`', 1)) FROM documents WHERE text IS NOT NULL) SELECT kind, trim(\"name\") \"name\", count(DISTINCT doc_id) n_docs, count(*) mentions FROM h GROUP BY 1, 2")
def kg_extract(spark, sf):
    """Topics from headings and code names from backticks, with their mentions."""
    d = load(spark, sf, "documents").where("text is not null")
    a = d.select("doc_id", F.lit("topic").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}\s+([^\r\n]+)"), 1)).alias("name"))
    b = d.select("doc_id", F.lit("code").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_][\w.]*)[^`\n]*`"), 1)).alias("name"))
    return a.unionByName(b).groupBy("kind", F.trim("name").alias("name")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("mentions"))


@R.add("kg_export", "SELECT '\"' || src || '\" -> \"' || dst || '\"' AS line FROM relations WHERE src IN (SELECT id FROM entities) AND dst IN (SELECT id FROM entities)")
def kg_export(spark, sf):
    """Relations both of whose ends are kept entities."""
    e = entities(spark, sf).select("id")
    r = relations(spark, sf).join(e.withColumnRenamed("id", "src"), "src", "left_semi").join(e.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return r.select(F.format_string('"%s" -> "%s"', "src", "dst").alias("line"))


@R.add("embedding_refresh", "WITH o AS (SELECT lower(trim(id)) id, md5(coalesce(name, '') || '|' || coalesce(attrs, '')) h FROM kg_entities WHERE loaded_at <= TIMESTAMP '2024-10-01'), n AS (SELECT DISTINCT lower(trim(id)) id, md5(coalesce(name, '') || '|' || coalesce(attrs, '')) h FROM kg_entities WHERE loaded_at > TIMESTAMP '2024-10-01') SELECT n.id, n.h FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND o.h = n.h)")
def embedding_refresh(spark, sf):
    """Rows loaded since the last run whose (key, content hash) is not yet stored: an anti join."""
    e = load(spark, sf, "kg_entities").select(F.lower(F.btrim("id")).alias("id"), F.md5(F.concat(F.coalesce("name", F.lit("")), F.lit("|"), F.coalesce("attrs", F.lit("")))).alias("h"), (F.col("loaded_at").cast("timestamp_ntz") <= F.lit(OLD_STATE).cast("timestamp_ntz")).alias("old"))
    return e.where("not old").select("id", "h").dropDuplicates().join(e.where("old").select("id", "h"), ["id", "h"], "left_anti")
