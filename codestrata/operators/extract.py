"""Functions, classes and imports from source text, by line patterns of each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.operators.lines import explode_lines

# How each language writes a function (name in group 1) and a class (name in group 1, what it extends in group 2).
_JS_FN = [r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]*)?=>|[A-Za-z_$][\w$]*\s*=>)"]
_JS_CLASS = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s*<[^>]*>)?(?:\s+extends\s+([A-Za-z_$][\w$.]*))?"
_JVM_FN = r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|internal|override|virtual|async|sealed)\s+)+(?:<[^>]*>\s*)?[\w<>\[\],.?]+(?:\s+[\w<>\[\],.?]+)*\s+([A-Za-z_]\w*)\s*\("
_C_FN = r"^(?:(?:static|inline|extern|const|unsigned|signed|struct)\s+)*[A-Za-z_]\w*[\s*]+(?:[A-Za-z_]\w*[\s*]+)*([A-Za-z_]\w*)\s*\([^;=]*(?:\)\s*\{|,\s*$)"
LANGUAGES: dict[str, tuple[list[str], list[str], str | None]] = {
    "Python": (["py", "pyi"], [r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"], r"^\s*class\s+([A-Za-z_]\w*)\s*(?:\(\s*([A-Za-z_][\w.]*))?"),
    "JavaScript": (["js", "jsx", "mjs", "cjs"], _JS_FN, _JS_CLASS),
    "TypeScript": (["ts", "tsx", "mts"], _JS_FN, _JS_CLASS),
    "Java": (["java"], [_JVM_FN], r"^\s*(?:(?:public|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+(\w+))?"),
    "Go": (["go"], [r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"], r"^type\s+(\w+)\s+(?:struct|interface)()"),
    "C": (["c", "h"], [_C_FN], r"^\s*(?:typedef\s+)?struct\s+(\w+)()\s*\{"),
    "C++": (["cpp", "cc", "hpp", "cxx"], [_C_FN], r"^\s*(?:class|struct)\s+(\w+)(?:\s*:\s*(?:public|private|protected)\s+(\w+))?"),
    "C#": (["cs"], [_JVM_FN], r"^\s*(?:(?:public|internal|abstract|sealed|static|partial)\s+)*(?:class|interface|struct|record)\s+(\w+)(?:\s*:\s*(\w+))?"),
    "Rust": (["rs"], [r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"], r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)()"),
    "Ruby": (["rb"], [r"^\s*def\s+(?:self\.)?(\w+)"], r"^\s*class\s+(\w+)(?:\s*<\s*([\w:]+))?"),
    "PHP": (["php"], [r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)"], r"^\s*(?:(?:abstract|final)\s+)*class\s+(\w+)(?:\s+extends\s+(\w+))?"),
    "Kotlin": (["kt", "kts"], [r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\("], r"^\s*(?:\w+\s+)*class\s+(\w+)(?:[^:{]*:\s*(\w+))?"),
    "Swift": (["swift"], [r"^\s*(?:\w+\s+)*func\s+(\w+)"], r"^\s*(?:\w+\s+)*(?:class|struct|protocol)\s+(\w+)(?:\s*:\s*(\w+))?"),
    "Scala": (["scala"], [r"^\s*(?:\w+\s+)*def\s+(\w+)"], r"^\s*(?:\w+\s+)*(?:class|trait|object)\s+(\w+)(?:[^{]*\bextends\s+(\w+))?"),
    "Lua": (["lua"], [r"^\s*(?:local\s+)?function\s+([\w.:]+)"], None),
    "Perl": (["pl", "pm"], [r"^\s*sub\s+(\w+)"], r"^\s*package\s+([\w:]+)()"),
    "Elixir": (["ex", "exs"], [r"^\s*defp?\s+(\w+)"], r"^\s*defmodule\s+([\w.]+)()"),
    "Bash": (["sh", "bash"], [r"^\s*(?:function\s+)?(\w+)\s*\(\)"], None),
    "Dart": (["dart"], [r"^\s*(?:static\s+)?[\w<>?]+\s+(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{"], r"^\s*(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"),
}
#: Words that stand before a parenthesis without being a function's name.
NOT_NAMES = ["if", "for", "while", "switch", "return", "else", "catch", "new", "sizeof"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    """The language that a path's extension stands for, or null."""
    out = F.lit(None).cast("string")
    for name, (exts, _, _) in LANGUAGES.items():
        out = F.when(extension(path).isin(*exts), name).otherwise(out)
    return out


def definitions(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, language, kind, name, base, line) of functions and classes; files: file_id, repo_id, path, content.

    One pass over the lines, each against the patterns of its file's language only; lines that cannot begin a definition give
    nothing. Null and empty texts and files of other languages give no row; a file given twice gives its definitions once (finds are
    compared, not texts).
    """
    f = files.select("file_id", "repo_id", "path", "content").where("content is not null").withColumn("language", language_of(F.col("path"))).where("language is not null")
    lines = explode_lines(f, ["file_id", "repo_id", "path", "language"])
    fn, cls, base = F.lit(""), F.lit(""), F.lit("")
    for name, (_, fns, c) in LANGUAGES.items():
        is_ = F.col("language") == name
        found = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in fns])
        fn = F.when(is_, F.coalesce(found, F.lit(""))).otherwise(fn)
        if c:
            cls, base = F.when(is_, F.regexp_extract("line", c, 1)).otherwise(cls), F.when(is_, F.regexp_extract("line", c, 2)).otherwise(base)
    d = lines.select("file_id", "repo_id", "path", "language", "line_no", fn.alias("fn"), cls.alias("cls"), base.alias("base")).where("fn <> '' or cls <> ''")
    one = lambda kind, name, b: F.struct(F.lit(kind).alias("kind"), name.alias("name"), b.alias("base"))
    none = F.lit(None).cast("string")
    both = F.filter(F.array(one("function", F.col("fn"), none), one("class", F.col("cls"), F.nullif("base", F.lit("")))), lambda x: x["name"] != "")
    d = d.select("file_id", "repo_id", "path", "language", F.col("line_no").alias("line"), F.explode(both).alias("d")).select("file_id", "repo_id", "path", "language", "d.kind", "d.name", "d.base", "line")
    return d.where(~F.col("name").isin(*NOT_NAMES)).dropDuplicates(["file_id", "line", "kind"])


def definitions_sql(table: str = "files") -> str:
    """The same in SQL, as the expressions `df`."""
    q = lambda s: s.replace("'", "''")
    lang = "CASE " + " ".join(f"WHEN e IN ({', '.join(repr(x) for x in exts)}) THEN '{n}'" for n, (exts, _, _) in LANGUAGES.items()) + " END"
    fn = "CASE language " + " ".join(f"WHEN '{n}' THEN coalesce({', '.join(f'''nullif(regexp_extract(line, '{q(p)}', 1), '')''' for p in fns)}, '')" for n, (_, fns, _) in LANGUAGES.items()) + " ELSE '' END"
    cls = lambda g: "CASE language " + " ".join(f"WHEN '{n}' THEN regexp_extract(line, '{q(c)}', {g})" for n, (_, _, c) in LANGUAGES.items() if c) + " ELSE '' END"
    words = ", ".join(f"'{x}'" for x in NOT_NAMES)
    return (
        f"dl AS (SELECT file_id, repo_id, path, {lang} language, content FROM (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) e FROM {table}) WHERE content IS NOT NULL), "
        "dn AS (SELECT file_id, repo_id, path, language, unnest(range(1, len(l) + 1)) line_no, unnest(l) line FROM (SELECT *, string_split(content, chr(10)) l FROM dl WHERE language IS NOT NULL)), "
        f"dx AS (SELECT file_id, repo_id, path, language, line_no, {fn} fn, {cls(1)} cls, {cls(2)} base FROM dn), "
        f"df AS (SELECT file_id, repo_id, path, language, 'function' kind, fn \"name\", CAST(NULL AS VARCHAR) base, line_no line FROM dx WHERE fn <> '' AND fn NOT IN ({words}) UNION ALL SELECT file_id, repo_id, path, language, 'class', cls, nullif(base, ''), line_no FROM dx WHERE cls <> '' AND cls NOT IN ({words}))"
    )


# How import lines name what they import, by language (in group 1).
IMPORTS: dict[str, list[str]] = {
    "Go": [r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*(?:\r|//|$)'],
    "Rust": [r"^\s*(?:pub\s+)?use\s+([\w:]+)"],
    "Java": [r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"],
    "Python": [r"^\s*from\s+([.\w]+)\s+import\b", r"^\s*import\s+([\w.]+)"],
    "JavaScript": [r"""(?:^|[^\w.])import\s+(?:[^'"]*\s+from\s+)?['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""],
    "TypeScript": [r"""(?:^|[^\w.])import\s+(?:[^'"]*\s+from\s+)?['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""],
    "C": [r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]"""],
}


def _std(language: Column, spec: Column) -> Column:
    """Whether an import names the language's own library: no dot in a Go path's first part, Rust's own crates, Java's own packages."""
    go = ~F.split(spec, "/")[0].contains(".")
    return F.when(language == "Go", go).when(language == "Rust", spec.rlike(r"^(?:std|core|alloc)\b")).when(language == "Java", spec.rlike(r"^javax?\.")).otherwise(F.lit(False))


def imports(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, language, spec, is_std): what the import lines of a text name, each once per file."""
    f = files.select("file_id", "repo_id", "path", "content").where("content is not null").withColumn("language", language_of(F.col("path"))).where(F.col("language").isin(*IMPORTS))
    lines = explode_lines(f, ["file_id", "repo_id", "path", "language"])
    spec = F.lit("")
    for name, patterns in IMPORTS.items():
        found = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in patterns], F.lit(""))
        spec = F.when(F.col("language") == name, found).otherwise(spec)
    d = lines.select("file_id", "repo_id", "path", "language", spec.alias("spec")).where("spec <> ''").dropDuplicates(["file_id", "spec"])
    return d.withColumn("is_std", _std(F.col("language"), F.col("spec")))


def imports_sql(table: str = "files") -> str:
    q = lambda s: s.replace("'", "''")
    spec = "CASE language " + " ".join(f"WHEN '{n}' THEN coalesce({', '.join(f'''nullif(regexp_extract(line, '{q(p)}', 1), '')''' for p in ps)}, '')" for n, ps in IMPORTS.items()) + " ELSE '' END"
    return definitions_sql(table).split(", dx AS")[0] + f", im AS (SELECT DISTINCT file_id, repo_id, path, language, spec, CASE language WHEN 'Go' THEN NOT contains(split_part(spec, '/', 1), '.') WHEN 'Rust' THEN regexp_matches(spec, '^(?:std|core|alloc)\\b') WHEN 'Java' THEN regexp_matches(spec, '^javax?\\.') ELSE false END is_std FROM (SELECT *, {spec} spec FROM dn) WHERE spec <> '')"
