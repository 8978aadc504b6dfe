"""Line scans: a pattern library applied to every line of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Patterns by scanner, as (tag, expression); group 1 is the name that is found.
ENV_READS = [
    ("node", r"process\.env\.([A-Z_][A-Z0-9_]+)"), ("getenv", r"os\.getenv\(['\"]([A-Z_][A-Z0-9_]+)['\"]\)"), ("environ", r"os\.environ(?:\.get)?\[['\"]([A-Z_][A-Z0-9_]+)['\"]\]"),
    ("environ_get", r"os\.environ\.get\(['\"]([A-Z_][A-Z0-9_]+)['\"]\)"), ("getenv_any", r"getenv\(['\"]([A-Z_][A-Z0-9_]+)['\"]\)"), ("config", r"config\.get\(['\"]([A-Z_][A-Z0-9_]+)['\"]\)"), ("ruby", r"ENV\[['\"]([A-Z_][A-Z0-9_]+)['\"]\]"),
]
EVENT_EMITS = [
    ("emit", r"\.emit\(['\"]([^'\"]+)['\"]"), ("dispatch_event", r"dispatchEvent\(new\s+\w*Event\(['\"]([^'\"]+)['\"]"), ("dispatch", r"dispatch\(\s*\{[^}]*type:\s*['\"]([^'\"]+)['\"]"),
    ("publish", r"\.publish\(['\"]([^'\"]+)['\"]"), ("trigger", r"\.trigger\(['\"]([^'\"]+)['\"]"), ("create_action", r"createAction\(['\"]([^'\"]+)['\"]"),
]
EVENT_SUBSCRIBES = [
    ("on", r"\.on\(['\"]([^'\"]+)['\"]"), ("once", r"\.once\(['\"]([^'\"]+)['\"]"), ("listener", r"addEventListener\(['\"]([^'\"]+)['\"]"), ("subscribe", r"\.subscribe\(['\"]([^'\"]+)['\"]"), ("add_listener", r"\.addListener\(['\"]([^'\"]+)['\"]"),
]
FLAGS = [
    ("launchdarkly", r"ldClient\.variation\(['\"]([^'\"]+)['\"]"), ("launchdarkly", r"useFlags\(\)\.([a-zA-Z_][a-zA-Z0-9_-]*)"), ("growthbook", r"gb\.isOn\(['\"]([^'\"]+)['\"]"), ("growthbook", r"gb\.getFeatureValue\(['\"]([^'\"]+)['\"]"),
    ("openfeature", r"client\.getBooleanValue\(['\"]([^'\"]+)['\"]"), ("env", r"process\.env\.(FEATURE_[A-Z0-9_]+|FF_[A-Z0-9_]+|ENABLE_[A-Z0-9_]+)"), ("custom", r"flags\.get\(['\"]([^'\"]+)['\"]"), ("custom", r"features\.enabled\(['\"]([^'\"]+)['\"]"), ("custom", r"isFeatureEnabled\(['\"]([^'\"]+)['\"]"),
]
ROUTES = [
    ("js", r"(?i)(?:app|router|server)\.(?:get|post|put|delete|patch|head|options|all)\s*\(\s*['\"`]([^'\"` ]+)['\"`]"), ("py", r"(?i)@(?:app|router|blueprint)\.(?:get|post|put|delete|patch|head|options)\s*\(\s*[\"']([^\"']+)[\"']"), ("go", r"(?:r|router|engine|g)\.(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\(\s*\"([^\"]+)\""),
]
TOOLS = [("tool", r"(?:registerTool|\.tool)\s*\(\s*['\"]([\w-]+)['\"]"), ("rpc", r"\brpc\s+(\w+)\s*\(")]
ORM_CALLS = [
    ("prisma", r"prisma\.(\w+)\.(?:findMany|findFirst|findUnique|create|update|delete|upsert|count|aggregate)"), ("typeorm", r"(?:repository|getRepository)\((\w+)\)\.(?:find|findOne|save|delete|count)"),
    ("sequelize", r"(\w+)\.(?:findAll|findOne|create|update|destroy|count)\s*\("), ("sqlalchemy", r"(?:session|db)\.(query|execute|add|delete)\s*\("),
]
TABLE_REFS = [
    ("sqlalchemy", r"__tablename__\s*=\s*['\"]([a-zA-Z_][a-zA-Z0-9_]*)['\"]"), ("sqlalchemy_fk", r"ForeignKey\(['\"]([a-zA-Z_][a-zA-Z0-9_]*)\.\w+['\"]\)"), ("typeorm", r"@Entity\(\s*['\"]([a-zA-Z_][a-zA-Z0-9_]*)['\"]\s*\)"), ("sequelize", r"\.define\(\s*['\"]([a-zA-Z_][a-zA-Z0-9_]*)['\"]"),
    ("sequelize_name", r"tableName\s*:\s*['\"]([a-zA-Z_][a-zA-Z0-9_]*)['\"]"), ("drizzle", r"(?:pgTable|mysqlTable|sqliteTable)\(\s*['\"]([a-zA-Z_][a-zA-Z0-9_]*)['\"]"), ("mongoose", r"\.model\(\s*['\"]([A-Za-z][a-zA-Z0-9_]*)['\"]"), ("prisma", r"^model\s+([A-Z][a-zA-Z0-9_]*)\s*\{"), ("sql", r"(?i)\b(?:from|join|into|update)\s+([a-z_][a-z0-9_]+)\b"),
]
SECURITY = [
    ("high:Hardcoded Secret", r"(?i)((?:password|passwd|pwd|secret|api_key|apikey|token|auth)\s*[=:]\s*['\"][^'\"]{4,}['\"])"), ("high:XSS Vulnerability", r"(innerHTML\s*=[^=])"), ("medium:Dynamic Code Execution", r"(\beval\s*\()"),
    ("medium:Function Constructor", r"(new\s+Function\s*\()"), ("high:Python exec()", r"(\bexec\s*\()"), ("high:Pickle Deserialization", r"(\bpickle\.load)"), ("high:Shell Injection Risk", r"(subprocess\.\w+\([^)]*shell\s*=\s*True)"), ("high:OS Command Execution", r"(\bos\.(?:system|popen)\s*\()"),
    ("medium:Dynamic Import", r"(__import__\s*\()"), ("medium:Debug Mode Enabled", r"(\bDEBUG\s*=\s*True\b)"), ("low:Debug Statements", r"(console\.(?:log|debug|info)\()"), ("low:Code Comments", r"((?://|\*|#).*\b(?:TODO|FIXME|HACK|XXX)\b)"),
]
PATTERNS = [
    ("Singleton", r"(getInstance|let\s+instance\s*=|private\s+static\s+instance)"), ("Factory", r"(create[A-Z]\w*\s*\(|return new)"), ("Observer/Event", r"(subscribe|addEventListener|\.on\(|emit\()"), ("Strategy", r"(class\s+\w+Strategy\b|setStrategy\s*\()"), ("State Machine", r"(class\s+\w+State\b|setState\s*\(|\btransitionTo\s*\()"),
    ("Custom Hooks", r"(export\s+(?:const|function)\s+use[A-Z])"), ("Context Provider", r"(createContext|Provider|useContext)"), ("Dataclasses", r"(@dataclass)"), ("Abstract Base Classes", r"(\bABC\b|@abstractmethod|ABCMeta)"), ("Context Managers", r"(@contextmanager|def\s+__enter__)"), ("Mixins", r"(class\s+\w*Mixin)"), ("Middleware", r"(class\s+\w*Middleware|def\s+middleware\s*\()"),
]
PERF = [("n+1", r"((?:find|findOne|findAll|findById|query|execute|fetch)\s*\()"), ("sync-io", r"(fs\.readFileSync|fs\.writeFileSync|fs\.existsSync|execSync)"), ("serialization-in-loop", r"(JSON\.(?:parse|stringify)\s*\()")]
PII_SINKS = [("log", r"(?i)((?:console\.log|logger?\.\w+|print)\s*\()"), ("send", r"(?i)((?:fetch|axios|request|send)\s*\()"), ("write", r"(?i)((?:writeFile|open)\s*\()")]
LATENCY = [("allocation", r"(\bnew\s+\w+|\bmake\(|\bmalloc\s*\()"), ("lock", r"(\block\s*\(|\bLock\(|synchronized)"), ("blocking", r"(\bsleep\s*\(|\bwait\s*\()"), ("io", r"(\bprintf\s*\(|console\.|fmt\.Print)")]
MODEL_CHECKS = [("magic_number", r"\b(\d{2,}(?:\.\d+)?)\b"), ("division", r"\b(\w+\s*/\s*\w+)\b"), ("float_equality", r"(==\s*\d+\.\d+)"), ("nan", r"\b((?i:isnan|nan))\b")]
DUTIES = [("initiate", r"(?i)\b((?:create|submit|initiate|build|load)\w*)\s*\("), ("approve", r"(?i)\b((?:approve|authorize|release|merge|apply)\w*)\s*\(")]
KCONFIG = [("kconfig", r"\b(CONFIG_[A-Z0-9_]+)\b")]
IRQ = [("irq", r"\b(request_irq|irq_handler|IRQ_HANDLED|__interrupt)\b"), ("alloc", r"\b(malloc|kmalloc|calloc|new)\b"), ("sleep", r"\b(sleep|msleep|usleep|schedule)\b")]
MULTILANG = [("ada", r"(?i)(pragma\s+Import\s*\(\s*C)"), ("ctypes", r"(ctypes\.(?:CDLL|cdll))"), ("wasm", r"(WebAssembly\.\w+)")]
ECSS = [("goto", r"\b(goto)\b"), ("recursion_guard", r"\b(depth|limit)\b"), ("dynamic_memory", r"\b(malloc|calloc|realloc|free)\b"), ("unbounded_loop", r"((?:while|for)\s*\(\s*(?:true|1|;;)\s*\))")]
REQ_TAGS = [("tag", r"\b((?:REQ|SRS|SYS)-\d+)\b")]
PLUGINS = [("extension_point", r"(?i)\b(register\w*)\s*\("), ("implementation", r"\b(implements\s+\w+|extends\s+\w+)")]
LICENSES = [("spdx", r"SPDX-License-Identifier:\s*([\w.+-]+)")]
NOT_TABLES = ["select", "where", "set", "values", "the", "a", "an", "left", "right", "full", "inner", "outer", "union", "this", "that", "it", "and", "or"]


def explode_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, line): lines ended by \\n, numbered from 1. Null content has none."""
    return files.where("content is not null").select(*keys, F.posexplode(F.split("content", "\n")).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def scan(files: DataFrame, keys: list[str], library: list[tuple[str, str]]) -> DataFrame:
    """(keys, line_no, tag, name) of every match of every pattern: one pass over the lines, in generated code.

    A whole text that matches no pattern is dropped before its lines are exploded. A text given twice (by the first key) gives its
    finds once: these are compared, so no text is shuffled.
    """
    any_ = "|".join(f"(?:{p})" for _, p in library)
    lines = explode_lines(files.where(F.col("content").rlike(f"(?m){any_}")), keys)

    def tagged(tag: str, pattern: str):
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), 1), lambda m: F.struct(F.lit(tag).alias("tag"), m.alias("name")))

    hits = F.concat(*[tagged(t, p) for t, p in library])
    found = lines.select(*keys, "line_no", F.posexplode(hits).alias("_at", "h")).select(*keys, "line_no", "_at", "h.tag", "h.name")
    return found.dropDuplicates([keys[0], "line_no", "_at"]).drop("_at")


def scan_sql(library: list[tuple[str, str]], keys: str = "file_id, repo_id, path", table: str = "files") -> str:
    """The same scan in SQL."""
    q = lambda s: s.replace("'", "''")
    hits = " UNION ALL ".join(f"SELECT {keys}, line_no, '{q(t)}' tag, unnest(regexp_extract_all(line, '{q(p)}', 1)) \"name\" FROM ln" for t, p in library)
    return f"ln AS (SELECT {keys}, unnest(range(1, len(l) + 1)) line_no, unnest(l) line FROM (SELECT {keys}, string_split(content, chr(10)) l FROM {table} WHERE content IS NOT NULL)), hits AS ({hits})"


def loop_findings(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, pattern): calls inside loops and blocking calls; loop depth follows the braces from line to line.

    The state runs over the lines of one file inside one fold, so no file is split and no window is sorted.
    """
    lines = F.split("content", "\n")
    is_loop = lambda x: x.rlike(r"^\s*(?:for|while)[\s(]")
    braces = lambda x: F.length(F.regexp_replace(x, r"[^{]", "")) - F.length(F.regexp_replace(x, r"[^}]", ""))

    def step(s, x):
        inside = (s["d"] > 0) | is_loop(x)
        d = F.when(inside, F.greatest(s["d"] + braces(x), F.lit(0))).otherwise(F.lit(0))
        return F.struct(d.alias("d"), F.concat(s["f"], F.array(inside)).alias("f"))

    flags = F.aggregate(lines, F.struct(F.lit(0).alias("d"), F.array().cast("array<boolean>").alias("f")), step)["f"]
    x = files.where("content is not null").select(*keys, F.posexplode(F.arrays_zip(lines.alias("line"), flags.alias("loop"))).alias("p", "z"))
    tags = F.array_compact(F.array(*[F.when(F.col("z.line").rlike(p) & (F.lit(t == "sync-io") | F.col("z.loop")), F.lit(t)) for t, p in PERF]))
    return x.select(*keys, (F.col("p") + 1).alias("line_no"), F.explode(tags).alias("pattern"))
