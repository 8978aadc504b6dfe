"""Version history and workspaces, from tables of commits and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parse_git_log(lines: DataFrame) -> DataFrame:
    """(sha, author, date, parents, path, added, deleted) of the text of `git log --numstat --format=%x01%H%x02%an%x02%aI%x02%P`, one row per record.

    records: a column `record`, the text split at %x01. Binary files count no lines; a record without files gives no row.
    """
    p = F.split(F.col("record"), "\n")
    head = F.split(p[0], "\u0002")
    r = lines.select(head[0].alias("sha"), head[1].alias("author"), F.to_timestamp(head[2]).alias("date"), F.when(F.coalesce(head[3], F.lit("")) == "", 0).otherwise(F.size(F.split(head[3], " "))).alias("parents"), F.explode(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).alias("x"))
    c = F.split("x", "\t")
    n = lambda k: F.coalesce(c[k].try_cast("int"), F.lit(0))
    return r.where(F.size(c) == 3).select("sha", "author", "date", "parents", c[2].alias("path"), n(0).alias("added"), n(1).alias("deleted"))


def churn(commits: DataFrame) -> DataFrame:
    """(path, churn): commits that are no merges, per path. commits: sha, path, parents."""
    return commits.where("coalesce(parents, 1) <= 1").groupBy("path").agg(F.countDistinct("sha").alias("churn"))


def ownership(commits: DataFrame) -> DataFrame:
    """(path, top_contributor, contributor_count): the author of most commits (ties: the least name) and how many there are.

    Counts per path and author come first, so that no path's commits are gathered.
    """
    per = commits.where("author is not null").groupBy("path", "author").agg(F.countDistinct("sha").alias("n"))
    m = per.groupBy("path").agg(F.max("n").alias("n"), F.count("*").alias("contributor_count"))
    top = per.join(m.select("path", "n"), ["path", "n"]).groupBy("path").agg(F.min("author").alias("top_contributor"))
    return top.join(m.select("path", "contributor_count"), "path")


def timeline(commits: DataFrame, n: int = 100) -> DataFrame:
    """(sha, author, date, n_files, added, deleted) of the last n commits; ties by sha."""
    last = commits.select("sha", "author", "date").dropDuplicates(["sha"]).orderBy(F.desc("date"), "sha").limit(n)
    s = commits.join(F.broadcast(last.select("sha")), "sha", "left_semi").groupBy("sha").agg(F.countDistinct("path").alias("n_files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return last.join(s, "sha")


# Files that make their folder a workspace, and suffixes of what is scanned.
MANIFESTS = ["package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "setup.py"]
CODE = "py js jsx ts tsx mjs cjs java go c h cc cpp hpp cs rs rb php kt swift scala lua pl ex exs sh dart sql vue svelte".split()
TEXT = "md txt json yaml yml toml ini cfg env xml html css scss csv rst".split()
BINARY = "png jpg jpeg gif ico pdf zip gz tar jar class exe dll so woff woff2 ttf mp3 mp4 mov".split()


def file_kind(path: Column) -> Column:
    """`code`, `text`, `binary` or `other` by the path's suffix."""
    e = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(e.isin(*CODE), "code").when(e.isin(*TEXT), "text").when(e.isin(*BINARY), "binary").otherwise("other")


def workspaces(files: DataFrame) -> DataFrame:
    """(repo_id, workspace): folders of depth 1 to 3 that hold a manifest, or, where a repository has none, `packages/x` and the like.

    files: repo_id, path.
    """
    p = files.select("repo_id", "path").dropDuplicates()
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    by_manifest = p.where(F.substring_index("path", "/", -1).isin(*MANIFESTS)).select("repo_id", folder.alias("workspace")).where(F.size(F.split("workspace", "/")) <= 3)
    by_name = p.select("repo_id", F.regexp_extract("path", r"^((?:packages|apps|services|libs)/[^/]+)/", 1).alias("workspace"))
    return by_manifest.unionByName(by_name).where("workspace <> ''").dropDuplicates()


def file_workspace(files: DataFrame, spaces: DataFrame) -> DataFrame:
    """(repo_id, path, workspace): the longest workspace that is a prefix of the path's folders; its prefixes are joined by equality. Null without one."""
    p = files.select("repo_id", "path").dropDuplicates()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    c = p.where(F.size(parts) > 1).select("repo_id", "path", F.explode(prefixes).alias("workspace")).join(spaces, ["repo_id", "workspace"])
    best = c.groupBy("repo_id", "path").agg(F.max_by("workspace", F.length("workspace")).alias("workspace"))
    return p.join(best, ["repo_id", "path"], "left")


def resolve_aliases(imports: DataFrame, patterns: DataFrame) -> DataFrame:
    """(source, spec, target): imports through path aliases; of the patterns that fit, that of the deepest folder, then the first, counts.

    patterns: (folder, ord, pattern, target), as in a compiler's `paths`, with at most one `*` each; a user's short list, so it is sent to all.
    """
    pre, post = F.substring_index("pattern", "*", 1), F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1)).otherwise("")
    p = F.broadcast(patterns.select("folder", "ord", "pattern", F.col("target").alias("to"), pre.alias("pre"), post.alias("post")))
    star = F.contains("pattern", F.lit("*"))
    fits = F.when(star, F.startswith(F.col("spec"), F.col("pre")) & F.endswith(F.col("spec"), F.col("post")) & (F.length("spec") >= F.length("pre") + F.length("post"))).otherwise(F.col("spec") == F.col("pattern"))
    inside = (F.col("folder") == "") | F.startswith(F.col("source"), F.concat("folder", F.lit("/")))
    j = imports.select("source", "spec").dropDuplicates().join(p, fits & inside)
    middle = F.substr("spec", F.length("pre") + 1, F.length("spec") - F.length("pre") - F.length("post"))
    target = F.concat_ws("/", F.nullif("folder", F.lit("")), F.when(star, F.replace("to", F.lit("*"), middle)).otherwise(F.col("to")))
    return j.withColumn("target", target).groupBy("source", "spec").agg(F.min_by("target", F.struct(-F.length("folder"), "ord")).alias("target"))
