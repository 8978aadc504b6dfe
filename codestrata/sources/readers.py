"""Reading repositories, documents, reports and traces."""

from __future__ import annotations

import html as _html
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from codestrata.functions import scalar as S
from codestrata.session import ship

# Limits and lists of the local scan.
MAX_FILE_BYTES = 1_048_576
SKIPPED_DIRS = r"/(?:node_modules|\.git|dist|build|vendor|__pycache__|\.venv|target|coverage)/|/\.[^/]+/"
CODE_SUFFIX = r"\.(?:js|jsx|ts|tsx|mjs|cjs|py|go|rs|java|c|h|cc|cpp|hpp|cs|rb|php|kt|swift|scala|lua|sh|sql|ipynb)$"


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, lines, layer, is_code) of a local or mounted tree: one distributed read, paths relative to the root.

    Skipped folders, hidden files and files over MAX_FILE_BYTES are left out; undecodable bytes are replaced.
    """
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_FILE_BYTES)
    rel = F.regexp_replace("path", rf"^.*?{re.escape(root.rstrip('/'))}/", "")
    b = b.withColumn("rel", rel).where(~F.concat(F.lit("/"), F.col("rel")).rlike(SKIPPED_DIRS)).where(~S.base_name(F.col("rel")).startswith("."))
    text = F.col("content").cast("string")
    c = b.select(F.col("rel").alias("path"), text.alias("content"))
    return c.select("path", "content", F.size(F.split("content", "\n")).alias("lines"), S.layer_of(F.col("path")).alias("layer"), F.lower("path").rlike(CODE_SUFFIX).alias("is_code"))


def html_text(doc: str | None) -> tuple[str | None, str]:
    """(title, text) of an HTML document: scripts, styles and tags dropped, entities decoded, blanks collapsed."""
    if not doc:
        return None, ""
    t = re.search(r"<title[^>]*>(.*?)</title>", doc, re.I | re.S)
    s = re.sub(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<title[^>]*>.*?</title>", " ", doc, flags=re.I | re.S)
    s = re.sub(r"<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n", s, flags=re.I)
    s = _html.unescape(re.sub(r"<[^>]+>", " ", s)).replace("\xa0", " ")
    s = re.sub(r"[ \t]+", " ", re.sub(r" *\n *", "\n", s))
    return (_html.unescape(t[1]).strip() if t else None), re.sub(r"\n{3,}", "\n\n", s).strip()


def chunk(text: str | None, max_tokens: int = 800, overlap: int = 100) -> list[str]:
    """Paragraphs packed to four characters a token, with an overlap; a longer paragraph is cut hard. No text gives no chunk."""
    if not text or not text.strip():
        return []
    size, over = max_tokens * 4, overlap * 4
    out, cur = [], ""
    for p in re.split(r"\n\s*\n", text.strip()):
        while len(p) > size:
            if cur:
                out.append(cur)
                cur = ""
            out.append(p[:size])
            p = p[size - over :]
        if cur and len(cur) + len(p) + 2 > size:
            out.append(cur)
            cur = cur[-over:] if over else ""
        cur = f"{cur}\n\n{p}" if cur else p
    return [*out, cur] if cur else out


def chunk_documents(docs: DataFrame, key: str, text: str, max_tokens: int = 800, overlap: int = 100) -> DataFrame:
    """(key, idx, chunk): whole texts, in order."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b[text]) for i, c in enumerate(chunk(t, max_tokens, overlap))]
            yield pd.DataFrame(rows, columns=[key, "idx", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, idx int, chunk string")


def notebook_cells(books: DataFrame) -> DataFrame:
    """(path, content, n_code_cells, has_output, unordered): code cells of notebooks joined, with flags of reproducibility."""
    nb = books.select("path", F.from_json("content", "cells array<struct<cell_type:string,source:array<string>,execution_count:int,outputs:array<string>>>").alias("n"))
    code = F.filter("n.cells", lambda c: c["cell_type"] == "code")
    counts = F.filter(F.transform(code, lambda c: c["execution_count"]), lambda x: x.isNotNull())
    return nb.select("path", F.array_join(F.transform(code, lambda c: F.array_join(c["source"], "")), "\n").alias("content"), F.size(code).alias("n_code_cells"), F.exists(code, lambda c: F.size(c["outputs"]) > 0).alias("has_output"), (counts != F.array_sort(counts)).alias("unordered"))


def lcov(lines: DataFrame) -> DataFrame:
    """(path, n_lines, n_hit, pct) of lcov reports given as (line_no, line) with, if there are several, the report they are of (report).

    The last SF line of a report owns the DA lines after it. Each report is read in order by itself.
    """
    d = lines if "report" in lines.columns else lines.withColumn("report", F.lit(""))
    w = W.partitionBy("report").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    s = d.withColumn("path", F.last(F.when(F.col("line").startswith("SF:"), F.substr("line", F.lit(4))), ignorenulls=True).over(w)).where(F.col("line").startswith("DA:") & F.col("path").isNotNull())
    hit = F.split(F.substr("line", F.lit(4)), ",")[1].cast("int") > 0
    return s.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(hit).alias("n_hit"), F.round(100.0 * F.count_if(hit) / F.count("*"), 2).alias("pct"))


def bundle_modules(stats: DataFrame) -> DataFrame:
    """(name, size, share) of the modules of a bundler's stats JSON."""
    m = stats.select(F.explode(F.from_json("content", "modules array<struct<name:string,size:long>>")["modules"]).alias("m")).select("m.name", "m.size")
    total = m.agg(F.sum("size").alias("t"))
    return m.join(F.broadcast(total), F.lit(True)).select("name", "size", F.round(100.0 * F.col("size") / F.col("t"), 2).alias("share"))


def otel_calls(traces: DataFrame) -> DataFrame:
    """(path, n): spans of an OTEL export by their code.filepath attribute."""
    attr = "array<struct<key:string,value:struct<stringValue:string>>>"
    s = f"resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<name:string,attributes:{attr}>>>>>>"
    t = traces.select(F.explode(F.from_json("content", s)["resourceSpans"]).alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("p"))
    a = t.select(F.element_at(F.filter("p.attributes", lambda x: x["key"] == "code.filepath"), 1)["value"]["stringValue"].alias("path"))
    return a.where("path is not null").groupBy("path").agg(F.count("*").alias("n"))


def openapi_endpoints(specs: DataFrame) -> DataFrame:
    """(method, path) of OpenAPI documents."""
    p = specs.select(F.from_json("content", "paths map<string,map<string,string>>")["paths"].alias("p")).select(F.explode("p").alias("path", "ops"))
    return p.select("path", F.explode(F.map_keys("ops")).alias("method")).where(F.lower("method").isin("get", "post", "put", "delete", "patch", "head", "options")).select(F.upper("method").alias("method"), "path").dropDuplicates()


def manifest_packages(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version) declared by package.json, requirements.txt, go.mod and Cargo.toml files."""
    base = S.base_name(F.col("path"))
    npm = files.where(base == "package.json").select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    npm = npm.select("path", F.explode(F.map_concat(F.coalesce("j.dependencies", F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce("j.devDependencies", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce("j.dependencies", F.create_map().cast("map<string,string>")), k)))).alias("name", "version")).withColumn("ecosystem", F.lit("npm"))
    rows = files.where(base.isin("requirements.txt", "go.mod", "Cargo.toml")).select("path", base.alias("b"), F.explode(F.split("content", r"\r?\n")).alias("l"))
    # A declaration line by manifest.
    rules = [("requirements.txt", "pypi", r"^([A-Za-z0-9_.-]+)\s*(?:[=~><!]=?\s*([\w.]+))?"), ("go.mod", "go", r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v([\w.+-]+)"), ("Cargo.toml", "cargo", r"^([\w-]+)\s*=\s*\"[\^~=]?([\d.]+)\"")]
    out = npm.select("path", "ecosystem", "name", "version")
    for b, eco, p in rules:
        r = rows.where((F.col("b") == b) & F.col("l").rlike(p) & ~F.col("l").rlike(r"^\s*(?:#|//|\[)"))
        out = out.unionByName(r.select("path", F.lit(eco).alias("ecosystem"), F.regexp_extract("l", p, 1).alias("name"), F.nullif(F.regexp_extract("l", p, 2), F.lit("")).alias("version")))
    return out


def resolve_python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, spec, target): dotted imports resolved to files: relative ones from the importer's folder, others from any ancestor, `.py` before `/__init__.py`, nearest first.

    Candidates are generated with an order and joined with the files on the path.
    """
    folder = F.regexp_replace("source", r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    name = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    ups = F.when(dots > 0, F.array(dots - 1)).otherwise(F.sequence(F.lit(0), F.size(parts)))
    c = imports.select("source", "spec", parts.alias("parts"), name.alias("name"), F.posexplode(ups).alias("k", "up")).where(F.col("up") <= F.size("parts"))
    stem = F.array_join(F.concat(F.slice("parts", F.lit(1), F.size("parts") - F.col("up")), F.array("name")), "/")
    c = c.select("source", "spec", "k", stem.alias("stem")).select("source", "spec", F.posexplode(F.array(F.concat("stem", F.lit(".py")), F.concat("stem", F.lit("/__init__.py")))).alias("v", "target"), "k")
    hit = c.join(files.select(F.col("path").alias("target")), "target")
    return hit.groupBy("source", "spec").agg(F.min_by("target", F.struct("k", "v")).alias("target"))


def parse_unified_diff(text: str) -> list[tuple[str, int, int]]:
    """(path, first line, last line) of the new side of each hunk."""
    out, path = [], None
    for line in text.splitlines():
        if line.startswith("+++ "):
            path = re.sub(r"^[ab]/", "", line[4:].split("\t")[0].strip())
        elif (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)) and path and path != "/dev/null":
            start, n = int(m[1]), int(m[2] or 1)
            out.append((path, start, start + max(n, 1) - 1))
    return out


def parse_source(text: str) -> dict:
    """What kind of repository a source text names; local paths first, then the forges by host."""
    # Hosts in the order they are tried.
    hosts = [("gitlab", r"gitlab\."), ("bitbucket", r"bitbucket\.org"), ("azure", r"dev\.azure\.com|visualstudio\.com"), ("gitea", r"gitea\.|codeberg\.org"), ("github", r"github\.com")]
    if text.startswith(("/", "./", "../", "~")):
        return {"type": "local", "path": text}
    for kind, pattern in hosts:
        if re.search(pattern, text):
            m = re.search(r"[/:]([\w.-]+)/([\w.-]+?)(?:\.git)?/?$", text)
            return {"type": kind, "owner": m[1] if m else None, "repo": m[2] if m else None}
    m = re.fullmatch(r"([\w.-]+)/([\w.-]+)", text)
    return {"type": "github", "owner": m[1], "repo": m[2]} if m else {"type": "unknown"}


def load_groups(text: str) -> dict[str, list[str]]:
    """Groups of sources from their JSON map; each source once."""
    return {k: list(dict.fromkeys(v)) for k, v in json.loads(text).items()}
