"""Source files that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codestrata.llm.arrow import map_rows

_OUT = "repo_id string, path string, language string, n_errors int, first_line int, first_cause string, errors array<struct<line:int,what:string>>"


def with_path_language(files: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """Adds path_language, what the path's extension stands for (null without one). ext_languages is a fixed list of extensions."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    known = F.broadcast(ext_languages.select(F.lower("ext").alias("_ext"), F.col("language").alias("path_language")).dropDuplicates(["_ext"]))
    return files.withColumn("_ext", ext).join(known, "_ext", "left").drop("_ext")


def parse_files(files: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """Every file whose path names a parsed language, with all its syntax errors, their number and the first cause.

    Recursive-descent statements, precedence-climbing expressions, panic-mode recovery; see `codestrata.llm.syntax`.
    Defined results: null content gives no row; empty content parses in each language whose grammar allows it (not JSON, not
    Go); files of other languages give no row; a file given twice gives two rows; whole texts are parsed, whatever their length.
    """
    from codestrata.llm.syntax import LANGUAGES, syntax_errors

    def one(r: dict) -> list[tuple]:
        e = syntax_errors(r["content"], r["path_language"])
        return [(r["repo_id"], r["path"], r["path_language"], len(e), e[0][0] if e else None, e[0][1] if e else None, [{"line": a, "what": b} for a, b in e])]

    todo = with_path_language(files.select("repo_id", "path", "content").where("content is not null"), ext_languages)
    return map_rows(todo.where(F.col("path_language").isin(*LANGUAGES)).select("repo_id", "path", "content", "path_language"), _OUT, one, spread=True)


def invalid_files(files: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """(repo_id, path) of files that do not parse, each once."""
    return parse_files(files, ext_languages).where("n_errors > 0").select("repo_id", "path").dropDuplicates()


def parse_rates(files: DataFrame, fn_defs: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files, acceptance, errors, and the weak hint of ast_backed.

    n_ast_hint counts invalid files of which some function is said not to be backed by a syntax tree.
    """
    hint = fn_defs.where("ast_backed = false").select("repo_id", F.col("file").alias("path")).dropDuplicates().withColumn("hint", F.lit(True))
    p = parse_files(files, ext_languages).drop("errors").dropDuplicates().join(hint, ["repo_id", "path"], "left")
    bad = F.col("n_errors") > 0
    return p.groupBy("repo_id", "language").agg(
        F.count("*").alias("n_files"), F.count_if(bad).alias("n_invalid"), F.round(F.avg((~bad).cast("int")), 4).alias("acceptance"),
        F.sum("n_errors").cast("long").alias("n_errors"), F.count_if(bad & F.col("hint")).alias("n_ast_hint"),
    )
