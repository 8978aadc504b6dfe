"""Exporters: each format is a DataFrame of text lines (ord, line), to be written as text in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import scalar as S
from codestrata.operators.graph import degrees

# The elements of the formats: opening, node, what stands between nodes and edges, edge, ending. %1$s is a name (of a
# node, or an edge's source) as an id, %2$s the node's label or the edge's target, %3$s the count, %4$s the edge's own id; at the end of a
# list's items (%3$s of a node, %5$s of an edge) the comma that all but the last have.
FORMATS = {
    "dot": ("digraph G {", '  "%1$s" [label="%2$s"];', "", '  "%1$s" -> "%2$s" [label="%3$s"];', "}"),
    "mermaid": ("graph LR", '  %1$s["%2$s"]', "", "  %1$s -->|%3$s| %2$s", ""),
    "d2": ("direction: right", '"%1$s": "%2$s"', "", '"%1$s" -> "%2$s": %3$s', ""),
    "plantuml": ("@startuml", 'component "%2$s" as %1$s', "", "%1$s --> %2$s : %3$s", "@enduml"),
    "cypher": ("// nodes and edges", 'CREATE (:File {id: "%1$s", name: "%2$s"});', "", 'MATCH (a:File {id: "%1$s"}), (b:File {id: "%2$s"}) CREATE (a)-[:CALLS {count: %3$s}]->(b);', ""),
    "graphml": (
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="count" for="edge" attr.name="count" attr.type="long"/><graph edgedefault="directed">',
        '<node id="%1$s"><data key="label">%2$s</data></node>', "", '<edge source="%1$s" target="%2$s"><data key="count">%3$s</data></edge>', "</graph></graphml>",
    ),
    "gexf": ('<gexf xmlns="http://www.gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>', '<node id="%1$s" label="%2$s"/>', "</nodes><edges>", '<edge id="%4$s" source="%1$s" target="%2$s" weight="%3$s"/>', "</edges></graph></gexf>"),
    "dgml": ('<DirectedGraph xmlns="http://schemas.microsoft.com/vs/2009/dgml"><Nodes>', '<Node Id="%1$s" Label="%2$s"/>', "</Nodes><Links>", '<Link Source="%1$s" Target="%2$s" Label="%3$s"/>', "</Links></DirectedGraph>"),
    "drawio": (
        '<mxfile><diagram><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>', '<mxCell id="n:%1$s" value="%2$s" vertex="1" parent="1"><mxGeometry width="160" height="40" as="geometry"/></mxCell>', "",
        '<mxCell id="%4$s" source="n:%1$s" target="n:%2$s" value="%3$s" edge="1" parent="1"><mxGeometry relative="1" as="geometry"/></mxCell>', "</root></mxGraphModel></diagram></mxfile>",
    ),
    "obsidian": ('{"nodes":[', '{"id":"%1$s","type":"text","text":"%2$s","x":0,"y":0,"width":240,"height":60}%3$s', '],"edges":[', '{"id":"%4$s","fromNode":"%1$s","toNode":"%2$s","label":"%3$s"}%5$s', "]}"),
}
_XML = {"graphml", "gexf", "dgml", "drawio"}


def _label(fmt: str, c: Column) -> Column:
    """A name as text in the format."""
    if fmt in _XML:
        return S.xml_text(c)
    if fmt == "mermaid":
        return F.regexp_replace(c, r'["\[\]|]', " ")
    return S.quoted(c)


def _id(fmt: str, c: Column) -> Column:
    """A name as an id in the format; where ids must be plain words, other signs give way, and a digest keeps names apart."""
    if fmt in ("mermaid", "plantuml"):
        return F.concat(F.regexp_replace(c, r"[^A-Za-z0-9_]", "_"), F.lit("_"), F.left(F.md5(c.cast("binary")), F.lit(8)))
    return _label(fmt, c)


def top_nodes(edges: DataFrame, max_nodes: int | None) -> DataFrame:
    """The most connected nodes, ties to the lesser name."""
    d = degrees(edges).select("path", "total")
    return (d.orderBy(F.desc("total"), "path").limit(max_nodes) if max_nodes else d).select("path")


def export_graph(edges: DataFrame, fmt: str, max_nodes: int | None = None) -> DataFrame:
    """(ord, line) of a graph in one of FORMATS: head, nodes, what parts them from the edges, edges between kept nodes with summed counts, tail."""
    head, node, between, edge, tail = FORMATS[fmt]
    spark = edges.sparkSession
    keep = top_nodes(edges, max_nodes)
    e = edges.groupBy("source", "target").agg(F.sum("count").alias("n"))
    if max_nodes:
        k = F.broadcast(keep)  # at most max_nodes rows
        e = e.join(k.withColumnRenamed("path", "source"), "source", "left_semi").join(k.withColumnRenamed("path", "target"), "target", "left_semi")
    one = lambda o, text: spark.createDataFrame([(o, text)], "ord int, line string")
    comma = lambda is_last: F.when(is_last, "").otherwise(",")
    k = keep.select(_id(fmt, F.col("path")).alias("i"), _label(fmt, F.col("path")).alias("l"))
    k = k.join(F.broadcast(k.agg(F.max("i").alias("top"))), F.lit(True))
    nodes = k.select(F.lit(1).alias("ord"), F.format_string(node, "i", "l", comma(F.col("i") == F.col("top"))).alias("line"))
    own = F.left(F.md5(F.concat_ws("\0", "source", "target").cast("binary")), F.lit(16))
    e = e.select(_id(fmt, F.col("source")).alias("s"), _id(fmt, F.col("target")).alias("t"), F.col("n").cast("string").alias("n"), own.alias("own"))
    e = e.join(F.broadcast(e.agg(F.max("own").alias("top"))), F.lit(True))
    links = e.select(F.lit(3).alias("ord"), F.format_string(edge, "s", "t", "n", "own", comma(F.col("own") == F.col("top"))).alias("line"))
    out = one(0, head).unionByName(nodes).unionByName(links)
    out = out.unionByName(one(2, between)) if between else out
    return out.unionByName(one(4, tail)) if tail else out


def csv_cell(c: str) -> Column:
    """A column as a cell of CSV."""
    return S.csv_text(F.col(c).cast("string"))


def export_csv(edges: DataFrame) -> DataFrame:
    """Aggregated connections as CSV lines."""
    e = edges.groupBy("source", "target").agg(F.sum("count").alias("n"))
    return e.select(F.concat_ws(",", S.csv_text(F.col("source")), S.csv_text(F.col("target")), F.col("n").cast("string")).alias("line"))


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding (path, line_no, tag as severity:title), as JSON; the report's frame is added by the writer."""
    # Levels by severity.
    sev = F.substring_index("tag", ":", 1)
    level = F.when(sev == "high", "error").when(sev == "medium", "warning").otherwise("note")
    rule = F.lower(F.regexp_replace(F.substring_index("tag", ":", -1), r"[^A-Za-z0-9]+", "-"))
    loc = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(F.substring_index("tag", ":", -1).alias("text")).alias("message"), F.array(loc).alias("locations"))).alias("result"))


#: What stands before the results of a SARIF document.
SARIF_HEAD = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"codestrata"}},"results":['


def sarif_document(findings: DataFrame) -> DataFrame:
    """(ord, line): the results of `sarif`, each once, in the frame of a document; in the order of ord and line one JSON text."""
    r = sarif(findings).select(F.col("result").alias("j")).dropDuplicates()
    r = r.join(F.broadcast(r.agg(F.max("j").alias("top"))), F.lit(True)).select(F.lit(1).alias("ord"), F.concat("j", F.when(F.col("j") == F.col("top"), "").otherwise(",")).alias("line"))
    one = lambda k, t: findings.sparkSession.createDataFrame([(k, t)], "ord int, line string")
    return one(0, SARIF_HEAD).unionByName(r).unionByName(one(2, "]}]}"))


def badge(label: str, grade: str) -> str:
    """A small SVG with a label and a grade."""
    # Colours by grade.
    colour = {"A": "#4c1", "B": "#97ca00", "C": "#dfb317", "D": "#fe7d37", "F": "#e05d44"}.get(grade, "#9f9f9f")
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="120" height="20"><rect width="120" height="20" fill="#555"/><rect x="80" width="40" height="20" fill="{colour}"/><text x="8" y="14" fill="#fff">{label}</text><text x="95" y="14" fill="#fff">{grade}</text></svg>'


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes (ord, line) as text files whose names follow the order."""
    lines.repartitionByRange("ord", "line").sortWithinPartitions("ord", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
