"""Column functions shared by the operators; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Where a grade begins, and the order of layers from foundation to presentation.
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
COMPLEXITY_GRADES = [(30, "F"), (20, "D"), (10, "C"), (5, "B")]
LAYER_LEVELS = {
    "config": 0, "util": 1, "utils": 1, "helper": 1, "lib": 1, "core": 1, "data": 2, "model": 2, "classes": 2, "service": 3, "services": 3, "api": 3, "feature": 3,
    "modules": 4, "component": 4, "components": 4, "ui": 5, "page": 5, "view": 5, "presentation": 5, "forms": 5, "test": 6,
}
# Path parts by layer, the first that matches counts; the rest is `utils`.
LAYER_RULES = [
    (r"\.ipynb$", "notebook"), (r"/test|test_\w+\.py$|\w+_test\.py$|conftest", "test"), (r"/ui/|/views/|/pages/|/templates/|/static/", "ui"), (r"/component", "components"),
    (r"/service|/api/|/controller|/endpoint|/router|/middleware|/handler|/signal", "services"), (r"/util|/helper|/lib/|/common/", "utils"),
    (r"/data|/model|/store|/schema|/serializer|/migration|/fixtures/", "data"), (r"/task|/worker|/celery|/job", "services"), (r"/config|/settings|settings\.py$", "config"),
    (r"/modules/|/bas/", "modules"), (r"/forms/|/userforms/", "ui"), (r"/classes/", "data"),
]
# What makes a path a test.
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|__mocks__|fixtures?|spec|specs|cypress|e2e)(/|$)|\.(test|spec)\.[a-zA-Z0-9]+$|(^|/)test_[^/]+$|_test\.[a-zA-Z0-9]+$"


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounds .5 toward plus infinity, also for negative numbers."""
    k = float(10**digits)
    r = F.floor(c * F.lit(k) + F.lit(0.5))
    return r.cast("long") if digits == 0 else r / F.lit(k)


def ladder(c: Column, steps: list[tuple], rest, strict: bool = False) -> Column:
    """The value of the first step that c reaches."""
    out = None
    for least, value in steps:
        cond = c > least if strict else c >= least
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(rest)


def score_grade(c: Column) -> Column:
    return ladder(c, GRADES, "F")


def complexity_grade(c: Column) -> Column:
    return ladder(c, COMPLEXITY_GRADES, "A", strict=True)


def layer_of(path: Column) -> Column:
    p, out = F.lower(path), None
    for pattern, layer in LAYER_RULES:
        out = F.when(p.rlike(pattern), layer) if out is None else out.when(p.rlike(pattern), layer)
    return out.otherwise("utils")


def layer_level(layer: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LAYER_LEVELS.items() for x in kv])[F.lower(layer)]


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def repo_key(source: Column) -> Column:
    """Identity of a repository: 16 hex digits of SHA-256."""
    return F.substring(F.sha2(source, 256), 1, 16)


def entity_id(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("ent_"), F.substring(F.sha1(F.concat(F.lower(name), F.lit("::"), F.lower(kind)).cast("binary")), 1, 12))


def relation_id(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat(F.lit("rel_"), F.substring(F.sha1(F.lower(F.concat(src, F.lit("::"), kind, F.lit("::"), dst)).cast("binary")), 1, 12))


def snake_plural(name: Column) -> Column:
    """CamelCase to snake_case, with an s at the end."""
    s = F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2"))
    return F.when(s.endswith("s"), s).otherwise(F.concat(s, F.lit("s")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))


def xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def csv_text(c: Column) -> Column:
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def quoted(c: Column) -> Column:
    """For DOT and Cypher: quotes and backslashes escaped."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def nesting_depth(content: Column) -> Column:
    """Deepest running count of opened minus closed braces."""
    signs = F.regexp_extract_all(content, F.lit(r"([{}])"), 1)
    state = F.aggregate(
        signs, F.struct(F.lit(0).alias("cur"), F.lit(0).alias("top")),
        lambda s, x: F.struct((s["cur"] + F.when(x == "{", 1).otherwise(-1)).alias("cur"), F.greatest(s["top"], s["cur"] + F.when(x == "{", 1).otherwise(-1)).alias("top")),
    )
    return F.coalesce(state["top"], F.lit(0))
