"""The property graph of code: node and edge tables, and a read-only subset of Cypher over such tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codestrata.functions import scalar as S

# Confidence of a call by how its target was found, and suffixes an import is tried with.
SAME_FILE, IMPORTED, UNIQUE, MEMBER, COVERED = 0.95, 0.90, 0.50, 1.0, 0.9
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]
ORM_LINES = 50


def defines(functions: DataFrame) -> DataFrame:
    """(repo_id, source, target): file to function, by the function's id."""
    return functions.select("repo_id", F.col("file").alias("source"), F.col("fn_id").alias("target")).where("source is not null").dropDuplicates()


def relative_path(path: Column, spec: Column) -> Column:
    """What `./x`, `../x` or Python's `.x` means in a file's folder; null for other imports and where it leads out of the root."""
    folder = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    dots = F.length(F.regexp_extract(spec, r"^(\.+)\w", 1))  # Python's: one dot is the folder itself
    ups = F.when(dots > 0, dots - 1).otherwise(F.regexp_count(spec, F.lit(r"\.\./")))
    rest = F.when(dots > 0, F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))).otherwise(F.regexp_replace(spec, r"^(?:\.{1,2}/)+", ""))
    base = F.slice(folder, 1, F.greatest(F.size(folder) - ups, F.lit(0)))
    joined = F.concat_ws("/", base, F.array(rest))
    return F.when(spec.startswith(".") & (ups <= F.size(folder)), joined)


def import_edges(files: DataFrame) -> DataFrame:
    """(repo_id, source, target): relative imports resolved to files of the repository, the first suffix that exists wins; no self edges.

    files: repo_id, path, imports. Candidates are made per import and joined by equality; nothing is tried against every file.
    """
    f = files.select("repo_id", "path", "imports").dropDuplicates(["repo_id", "path"])
    tries = [*SUFFIXES, ".py", "/__init__.py", ".java", ".go", ".c", ".h"]
    i = f.select("repo_id", F.col("path").alias("source"), F.explode("imports").alias("spec")).dropDuplicates()
    i = i.withColumn("stem", relative_path(F.col("source"), F.col("spec"))).where("stem is not null")
    c = i.select("repo_id", "source", "spec", F.posexplode(F.array(*[F.concat("stem", F.lit(x)) for x in tries])).alias("k", "target"))
    hit = c.join(f.select("repo_id", F.col("path").alias("target")), ["repo_id", "target"]).where("source <> target")
    return hit.groupBy("repo_id", "source", "spec").agg(F.min_by("target", "k").alias("target")).select("repo_id", "source", "target").dropDuplicates()


def calls(called: DataFrame, functions: DataFrame, imported: DataFrame) -> DataFrame:
    """(repo_id, source, fn, target, count, confidence): calls resolved by scope: the same file, else an imported one, else the only one of the name.

    called: (repo_id, path, fn, count), the names a file calls; imported: (repo_id, source, target). A name that several other files
    define, none of them imported, resolves to nothing. Of several imported definers the least path counts.
    """
    d = functions.select("repo_id", F.col("name").alias("fn"), "file").where("file is not null").dropDuplicates()
    own = called.join(d.withColumnRenamed("file", "path"), ["repo_id", "fn", "path"], "left_semi").select("repo_id", F.col("path").alias("source"), "fn", F.col("path").alias("target"), "count", F.lit(SAME_FILE).alias("confidence"))
    rest = called.join(d.withColumnRenamed("file", "path"), ["repo_id", "fn", "path"], "left_anti").withColumnRenamed("path", "source")
    via = rest.join(imported, ["repo_id", "source"]).join(d.withColumnRenamed("file", "target"), ["repo_id", "fn", "target"]).groupBy("repo_id", "source", "fn", "count").agg(F.min("target").alias("target")).withColumn("confidence", F.lit(IMPORTED))
    only = d.groupBy("repo_id", "fn").agg(F.min("file").alias("target"), F.max("file").alias("hi")).where("target = hi").drop("hi")
    left = rest.join(via.select("repo_id", "source", "fn"), ["repo_id", "source", "fn"], "left_anti").join(only, ["repo_id", "fn"]).withColumn("confidence", F.lit(UNIQUE))
    c = ["repo_id", "source", "fn", "target", "count", "confidence"]
    return own.select(*c).unionByName(via.select(*c)).unionByName(left.select(*c))


def extends(classes: DataFrame, imported: DataFrame) -> DataFrame:
    """(repo_id, name, base, path, confidence): classes whose base is a class of the repository, found by name; .9 if the file has imports, else .5.

    classes: (repo_id, path, name, base). Of several classes of one name the greatest path counts, for the base.
    """
    known = classes.groupBy("repo_id", F.col("name").alias("base")).agg(F.max("path").alias("base_path"))
    has = imported.select("repo_id", F.col("source").alias("path")).dropDuplicates().withColumn("imp", F.lit(True))
    j = classes.where("base is not null and base <> name").select("repo_id", "path", "name", F.substring_index("base", ".", -1).alias("base")).dropDuplicates().join(known, ["repo_id", "base"]).join(has, ["repo_id", "path"], "left")
    return j.select("repo_id", "name", "base", "path", F.when(F.col("imp"), 0.9).otherwise(0.5).alias("confidence"))


def members(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(repo_id, path, class_name, fn_id, kind): methods of the class that begins last before them in their file; constructors by their names.

    functions: fn_id, repo_id, file, line, name, is_class_method. One merge of both in line order per file, no range join.
    """
    f = functions.where("is_class_method").select("repo_id", F.col("file").alias("path"), "line", F.lit(1).alias("is_fn"), "fn_id", "name", F.lit(None).cast("string").alias("cls"))
    c = classes.select("repo_id", "path", "line", F.lit(0).alias("is_fn"), F.lit(None).cast("long").alias("fn_id"), F.lit(None).cast("string").alias("name"), F.col("name").alias("cls"))
    w = W.partitionBy("repo_id", "path").orderBy("line", "is_fn", "cls", "fn_id").rowsBetween(W.unboundedPreceding, 0)
    j = f.unionByName(c).withColumn("class_name", F.last("cls", ignorenulls=True).over(w)).where("is_fn = 1 and class_name is not null")
    made = F.col("name").isin("__init__", "constructor") | (F.col("name") == F.col("class_name"))
    return j.select("repo_id", "path", "class_name", "fn_id", F.when(made, "constructor").otherwise("method").alias("kind"))


def constructor_queries(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(fn_id, class_name): functions that say `new X(` where X is a class of the same file."""
    named = functions.select("fn_id", "repo_id", F.col("file").alias("path"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\bnew\s+([A-Za-z_]\w*)\s*\("), 1))).alias("name"))
    return named.join(classes.select("repo_id", "path", "name").dropDuplicates(), ["repo_id", "path", "name"], "left_semi").select("fn_id", F.col("name").alias("class_name")).dropDuplicates()


def orm_queries(functions: DataFrame, hits: DataFrame) -> DataFrame:
    """(fn_id, model, line): each query line belongs to the nearest function that begins at most ORM_LINES lines above it. hits: (repo_id, path, line_no, name)."""
    f = functions.select("repo_id", F.col("file").alias("path"), F.col("line").alias("at"), F.lit(0).alias("k"), "fn_id", F.lit(None).cast("string").alias("model"))
    h = hits.select("repo_id", "path", F.col("line_no").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("fn_id"), F.col("name").alias("model"))
    w = W.partitionBy("repo_id", "path").orderBy("at", "k", "fn_id").rowsBetween(W.unboundedPreceding, 0)
    j = f.unionByName(h).withColumn("last", F.last(F.when(F.col("k") == 0, F.struct("fn_id", "at")), ignorenulls=True).over(w)).where("k = 1")
    return j.where(F.col("at") - F.col("last.at") <= ORM_LINES).select(F.col("last.fn_id").alias("fn_id"), "model", F.col("at").alias("line")).dropDuplicates()


def test_edges(files: DataFrame, functions: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(TESTS, COVERS): test file to the file it imports, and to the functions there whose name its text holds as a word.

    files: repo_id, path, content. The words of a test are joined with names by equality; no name is sought in every text.
    """
    tests = files.where(S.is_test(F.col("path")))
    t = imported.join(tests.select("repo_id", F.col("path").alias("source")).dropDuplicates(), ["repo_id", "source"], "left_semi")
    words = tests.where("content is not null").select("repo_id", F.col("path").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)"), 1))).alias("name")).dropDuplicates()
    c = functions.select("repo_id", "fn_id", "name", F.col("file").alias("target")).join(t, ["repo_id", "target"]).join(words, ["repo_id", "source", "name"], "left_semi")
    return t, c.select("repo_id", "source", "fn_id", F.lit(COVERED).alias("confidence"))


# -- Cypher
class CypherError(ValueError):
    """A text outside the subset."""


_NODE = r"\(\s*(?P<{0}>\w*)\s*(?::\s*(?P<{0}l>\w+))?\s*(?:\{{\s*(?P<{0}k>\w+)\s*:\s*(?P<{0}v>'[^']*'|-?\d+(?:\.\d+)?)\s*\}})?\s*\)"
_MATCH = re.compile(
    r"^\s*MATCH\s+" + _NODE.format("a") + r"(?:\s*(?P<back><)?-\s*\[\s*(?P<r>\w*)\s*(?::\s*(?P<type>\w+(?:\|\w+)*))?\s*(?P<star>\*\s*(?P<lo>\d*)\s*(?P<dots>\.\.)?\s*(?P<hi>\d*))?\s*\]\s*-(?P<fore>>)?\s*" + _NODE.format("b") + r")?"
    r"(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<ret>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$",
    re.I | re.S,
)
_PROP = re.compile(r"^(\w+)\.(\w+)$")
_TEST = re.compile(r"^\s*(NOT\s+)?(\w+)\.(\w+)\s*(=|<>|<=|>=|<|>|CONTAINS|STARTS\s+WITH|ENDS\s+WITH|IS\s+NOT\s+NULL|IS\s+NULL)\s*('[^']*'|-?\d+(?:\.\d+)?|\w+\.\w+)?\s*$", re.I)
MOST_STEPS = 5


def cypher(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A read-only query over nodes (id, label, properties...) and edges (source, target, type, properties...).

    The subset: MATCH of one node, or two with one relationship in either direction or none, of given types, of fixed or variable
    length up to MOST_STEPS (walks; the property `hops` of the relationship); one property in braces per node; WHERE of comparisons
    joined by AND; RETURN of properties, whole nodes by id, and count, min, max, sum, avg, count(DISTINCT ...), with AS; DISTINCT,
    ORDER BY of returned names, LIMIT. Anything else is a CypherError, writing above all.
    """
    m = _MATCH.match(text)
    if not m or re.search(r"\b(?:CREATE|MERGE|DELETE|DETACH|SET|REMOVE|DROP|CALL|LOAD)\b", re.sub(r"'[^']*'", "", text), re.I):
        raise CypherError(f"not in the read-only subset: {text[:80]}")
    props = [c for c in nodes.columns if c != "label"]

    def side(k: str) -> DataFrame:
        d = nodes
        if m[k + "l"]:
            d = d.where(F.col("label") == m[k + "l"])
        if m[k + "k"]:
            d = d.where(F.col(m[k + "k"]) == F.lit(_literal(m[k + "v"])))
        return d.select(*[F.col(c).alias(f"{k}__{c}") for c in ("label", *props)])

    names = {m["a"] or "_a": "a"}
    out = side("a")
    if m["b"] is not None:
        names[m["b"] or "_b"] = "b"
        e = edges
        if m["type"]:
            e = e.where(F.col("type").isin(*m["type"].split("|")))
        if m["back"] and m["fore"]:
            raise CypherError("a relationship has one direction")
        turned = e.select(*[F.col({"source": "target", "target": "source"}.get(c, c)).alias(c) for c in e.columns])
        e = turned if m["back"] else e if m["fore"] else e.unionByName(turned)
        if m["star"]:
            lo = int(m["lo"] or 1)
            hi = int(m["hi"]) if m["hi"] else (lo if m["lo"] and not m["dots"] else MOST_STEPS)
            lo, hi = max(1, min(lo, MOST_STEPS)), max(1, min(hi, MOST_STEPS))
            # Walks are counted by number, not listed: one row per pair of ends and number of steps.
            step = e.groupBy("source", "target").agg(F.count("*").alias("w"))
            cur = out.select(F.col("a__id").alias("r__source")).dropDuplicates().join(step.withColumnRenamed("source", "r__source"), "r__source").select("r__source", F.col("target").alias("at"), "w")
            walks = None
            for h in range(1, hi + 1):
                if h > 1:
                    cur = cur.join(step.select(F.col("source").alias("at"), F.col("target").alias("next"), F.col("w").alias("v")), "at").groupBy("r__source", F.col("next").alias("at")).agg(F.sum(F.col("w") * F.col("v")).alias("w"))
                if h >= lo:
                    part = cur.select("r__source", F.col("at").alias("r__target"), F.lit(h).alias("r__hops"), F.col("w").alias("r__walks"))
                    walks = part if walks is None else walks.unionByName(part)
            rel = walks
        else:
            rel = e.select(*[F.col(c).alias(f"r__{c}") for c in e.columns])
        if m["r"]:
            names[m["r"]] = "r"
        out = out.join(rel, F.col("a__id") == F.col("r__source")).join(side("b"), F.col("r__target") == F.col("b__id"))

    def ref(text: str) -> Column:
        p = _PROP.match(text.strip())
        if p and p[1] in names and f"{names[p[1]]}__{p[2]}" in out.columns:
            return F.col(f"{names[p[1]]}__{p[2]}")
        if text.strip() in names and names[text.strip()] in "ab":
            return F.col(f"{names[text.strip()]}__id")
        raise CypherError(f"unknown: {text}")

    for t in re.split(r"\s+AND\s+", m["where"], flags=re.I) if m["where"] else ():
        w = _TEST.match(t)
        if not w:
            raise CypherError(f"not in the subset: {t}")
        c, op = ref(f"{w[2]}.{w[3]}"), re.sub(r"\s+", " ", w[4].upper())
        v = None if w[5] is None else ref(w[5]) if _PROP.match(w[5]) and not w[5][0].isdigit() and w[5][0] != "-" else F.lit(_literal(w[5]))
        if v is None and not op.startswith("IS"):
            raise CypherError(f"nothing to compare with: {t}")
        cond = {"=": lambda: c == v, "<>": lambda: c != v, "<": lambda: c < v, ">": lambda: c > v, "<=": lambda: c <= v, ">=": lambda: c >= v, "CONTAINS": lambda: c.contains(v), "STARTS WITH": lambda: c.startswith(v), "ENDS WITH": lambda: c.endswith(v), "IS NULL": c.isNull, "IS NOT NULL": c.isNotNull}[op]()
        out = out.where(~cond if w[1] else cond)
    keys, aggs, order = [], [], []
    for item in re.split(r",(?![^(]*\))", m["ret"]):
        x = re.match(r"^\s*(.+?)(?:\s+AS\s+(\w+))?\s*$", item, re.I | re.S)
        body, name = x[1], x[2] or re.sub(r"\W+", "_", x[1]).strip("_")
        g = re.match(r"^(count|min|max|sum|avg)\s*\(\s*(DISTINCT\s+)?(\*|[\w.]+)\s*\)$", body, re.I)
        if g:
            if g[1].lower() == "count":
                col = F.count("*") if g[3] == "*" else F.countDistinct(ref(g[3])) if g[2] else F.count(ref(g[3]))
            else:
                col = getattr(F, g[1].lower())(ref(g[3]))
            aggs.append(col.alias(name))
        else:
            keys.append(ref(body).alias(name))
        order.append(name)
    res = (out.groupBy(*keys).agg(*aggs) if keys else out.agg(*aggs)).select(*order) if aggs else out.select(*keys)
    if m["distinct"]:
        res = res.dropDuplicates()
    if m["order"]:
        by = []
        for o in m["order"].split(","):
            x = re.match(r"^\s*([\w.]+)(?:\s+(ASC|DESC))?\s*$", o, re.I)
            name = re.sub(r"\W+", "_", x[1]) if x else ""
            if name not in order:
                raise CypherError(f"ORDER BY takes returned names: {o}")
            by.append(F.desc(name) if (x[2] or "").upper() == "DESC" else F.asc(name))
        res = res.orderBy(*by)
    return res.limit(int(m["limit"])) if m["limit"] else res


def _literal(v: str):
    return v[1:-1] if v.startswith("'") else float(v) if "." in v else int(v)
