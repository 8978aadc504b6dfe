"""Generated, minified, vendored and data files among source code."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from codestrata.llm.arrow import map_rows
from codestrata.operators.components import connected_components
from codestrata.session import durable

#: Word shingles, permutations in bands, and the similarity from which two files belong to one family.
SHINGLE, BANDS, ROWS, SIMILAR = 5, 16, 6, 0.8
#: Files of fewer different shingles are of one family where these are equal, as one other shingle takes most of them below the similarity.
LEAST_SHINGLES = 4
#: A family is generated if on average at least this share of its files' masked shingles occurs REPEATS times or more within the file,
#: and a blob if that share of them holds literals and signs only. A family of one file must have ALONE masked tokens.
REPEATED, LITERAL, REPEATS, ALONE = 0.9, 0.85, 4, 60
#: A family passes on what the comments and paths of at least so many of its files say, if they are at least this share of it.
FAMILY_LEAST, FAMILY_SHARE = 3, 0.5
#: Least masked tokens of a file that counts as a copy if another repository holds the same tokens, names included.
COPY_TOKENS = 50
#: Keys with more than this share of all rows are joined by broadcast: at most so many.
HOT_KEYS = 1000
#: Longs of the parity sketch that bounds what two classes share, and classes of a bucket held against the bucket in one part.
SKETCH, BUCKET_PART = 16, 2000

# Path parts and comment phrases that by public convention mark such files.
VENDOR_DIRS = frozenset("node_modules vendor third_party thirdparty 3rdparty third-party bower_components jspm_packages site-packages dist-packages external externals extern deps godeps pods carthage vendored".split())
GENERATED_DIRS = frozenset("generated __generated__ autogen gen auto_generated generated-src generated-sources codegen_out".split())
BUILD_DIRS = frozenset("dist".split())
OUTPUT_DIRS = frozenset("build out public static target obj bin".split())
GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.py|\.pb\.(?:go|cc|h)|\.(?:gen|generated|g)\.[a-z]+|\.tab\.[ch]|\.yy\.c|outerclass\.java|_generated\.[a-z]+)$", re.I)
MINIFIED_NAME = re.compile(r"(?:[.-](?:min|bundle|chunk|pack)\.[a-z]+|-[0-9a-f]{8,}\.[a-z]+)$", re.I)
VENDOR_NAME = re.compile(r"-v?\d+\.\d+(?:\.\d+)*(?:[.-](?:min|slim))?\.[a-z]+$", re.I)
GENERATED_SAYS = re.compile(
    r"(?<!not )(?:\bcode generated (?:by|from|with)\b|@generated\b|<auto-?generated>|\b(?:this|the) (?:file|\w+) (?:is|was|has been) (?:auto-?|automatically |machine[- ])?generated\b|\b(?:auto|machine)-?generated(?::| by\b| from\b)|"
    r"\bautomatically (?:generated|produced|created) (?:by|from)\b|\bgenerated (?:on|at) \d[\d-]* by\b|^\W*generated (?:by|from|with)\b|\bdo not (?:edit|modify)\b|\bchanges will be lost\b|"
    r"\bautomatisch (?:erzeugt|generiert)\b|\bnicht von hand ändern\b)",
    re.I | re.M,
)
_VERSION = r"v?\d+\.\d+\.\d+(?:[-+.]\w+)?"
VENDOR_SAYS = re.compile(
    rf"(?:^\W*!?\s*[\w.@/-]+ {_VERSION}\b|@license\b[^\n]*{_VERSION}|\b(?:library,? )?(?:release|version) {_VERSION}[^\n]*(?:copyright|\(c\))|\(c\) the \w+ authors\b|\b\d{{4}} \w+ contributors\b|\b(?:originally|vendored|copied|taken|imported|adapted) from\b|\b(?:local|bundled|vendored) copy\b)",
    re.I | re.M,
)

_TOKEN = re.compile(r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z)|(?:(?<=\n)|\A)[ \t]*#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|pragma)\b)[^\n]*)|(?P<s>\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<n>\d[\w.]*)|(?P<i>[^\W\d]\w*)|(?P<p>[^\s\w])", re.S)
_KEEP = frozenset(
    "import from package const let var function return if else for while do switch case break continue new try catch throw class extends implements static public private protected void int long double boolean char func range type struct interface map make def lambda in not and or is None True False null true false export default include unsigned sizeof final".split()
)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def path_kind(path: str | None) -> str | None:
    """What the path alone says."""
    if not path:
        return None
    p = path.replace("\\", "/").lower()
    parts = p.split("/")
    name = parts[-1]
    if VENDOR_DIRS.intersection(parts[:-1]) or VENDOR_NAME.search(name):
        return "vendored"
    if GENERATED_DIRS.intersection(parts[:-1]) or GENERATED_NAME.search(name):
        return "generated"
    if MINIFIED_NAME.search(name):
        return "minified"
    return "built" if BUILD_DIRS.intersection(parts[:-1]) else "output" if OUTPUT_DIRS.intersection(parts[:-1]) else None


def tokens_of(text: str) -> tuple[list[str], list[str]]:
    """Masked tokens (identifiers I, texts S, numbers N; words of the languages and signs as they are) and the comments, each with how many tokens precede it."""
    out, comments = [], []
    for m in _TOKEN.finditer(text):
        k = m.lastgroup
        if k == "c":
            comments.append((m.start(), m[0], len(out)))
        elif k == "s":
            out.append("S")
        elif k == "n":
            out.append("N")
        elif k == "i":
            out.append(m[0] if m[0] in _KEEP else "I")
        else:
            out.append(m[0])
    return out, comments


def shingles(masked: list[str]) -> np.ndarray:
    """Distinct hashes of five-token shingles, sorted; a shorter file is one shingle."""
    if not masked:
        return np.zeros(0, np.uint64)
    t = " ".join
    h = {xxhash.xxh3_64_intdigest(t(masked[i : i + SHINGLE])) for i in range(max(1, len(masked) - SHINGLE + 1))}
    return np.sort(np.fromiter(h, np.uint64, len(h)))


def band_keys(sh: np.ndarray) -> list[int]:
    """One key per band of the MinHash signature of shingle hashes."""
    sh = sh.astype(np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sh), 4096):
        with np.errstate(over="ignore"):
            x = sh[at : at + 4096, None] * _A + _B
        x ^= x >> np.uint64(31)
        low = np.minimum(low, x.min(0))
    return [xxhash.xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - 2**63 for b in range(BANDS)]


def content_kind(text: str, masked: list[str], comments: list) -> str | None:
    """What the text's first and last comments say of its origin.

    First comments are those before the first code, however long (texts that stand alone there are no code), and those early in the
    text; last ones follow all code.
    """
    first = next((k for k, t in enumerate(masked) if t not in ("S", ";")), len(masked))
    says = "\n".join(c for p, c, k in comments if k <= first or k == len(masked) or p < 1500)
    return "generated" if GENERATED_SAYS.search(says) else "vendored" if VENDOR_SAYS.search(says) else None


def shape(masked: list[str]) -> tuple[float, float]:
    """Shares of the masked shingles that occur REPEATS times or more, and of those that hold literals and signs only."""
    n = max(1, len(masked) - SHINGLE + 1)
    seen = Counter(zip(*(masked[k:] for k in range(SHINGLE)))) if len(masked) >= SHINGLE else Counter([tuple(masked)])
    worded = [any(t[0].isalpha() and t not in ("S", "N") for t in s) for s in seen]
    return sum(c for c in seen.values() if c >= REPEATS) / n, sum(c for c, w in zip(seen.values(), worded) if not w) / n


def is_dense(text: str, masked: list[str]) -> bool:
    """Whether the code, comments and texts aside, stands in long lines without blanks."""
    code = _TOKEN.sub(lambda m: "" if m.lastgroup == "c" else '""' if m.lastgroup == "s" else m[0], text)
    lines = [x for x in code.split("\n") if x.strip()]
    return bool(lines) and len(masked) >= 60 and max(map(len, lines)) > 250 and sum(c in " \t" for c in code) < 0.1 * len(code) and len(code) > 100 * len(lines)


def file_traits(files: DataFrame) -> DataFrame:
    """Per file: what path and comments say, the digest of its tokens with names, and its masked shingles with their shape."""

    def one(r: dict) -> list[tuple]:
        text, key = r["content"], (r["repo_id"], r["path"], r["indexed_at"], r["content"] is None, path_kind(r["path"]))
        if text is None:
            return [(*key, None, None, None, None, None, None, None, None)]
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        masked, comments = tokens_of(text)
        sh = shingles(masked)
        short = np.unique((sh >> np.uint64(32)).astype(np.uint32)).view(np.int32)  # enough to tell the shingles of two files apart
        cls = xxhash.xxh3_64_intdigest(sh.tobytes()) - 2**63 if len(sh) else None
        copy = xxhash.xxh3_64_intdigest("\0".join(m[0] for m in _TOKEN.finditer(text) if m.lastgroup != "c")) - 2**63 if len(masked) >= COPY_TOKENS else None
        return [(*key, content_kind(text, masked, comments), cls, copy, short.tolist(), len(masked), *shape(masked), is_dense(text, masked))]

    cols = files.select("repo_id", "path", (F.col("indexed_at").cast("timestamp").cast("long") if "indexed_at" in files.columns else F.lit(None).cast("long")).alias("indexed_at"), "content")
    return map_rows(cols, "repo_id string, path string, indexed_at long, no_content boolean, by_path string, by_comment string, class long, copy long, shingles array<int>, n_tokens int, repeated double, literal double, dense boolean", one, spread=True)


def parity_sketch(short: np.ndarray) -> list[int]:
    """Whether the number of shingles of each of the sketch's bits is odd; two sets differ in at least as many shingles as sketches in bits."""
    odd = np.bincount(short.view(np.uint32) % np.uint32(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _similar(both, n, m):
    return both >= SIMILAR * (n + m - both)


def _verified(pairs: DataFrame, s: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose shingles are similar."""
    v = pairs.join(s.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(s.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    return v.where(_similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def _across(cls: DataFrame, fam: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of classes that share a bucket and are not yet of one family.

    All such pairs are looked at, but the sketches rule out nearly all that are not similar, and never a similar one, before
    shingles are sent; large buckets are dealt out in parts.
    """
    bits = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    b = cls.join(fam, "class").select("class", "family", F.size("shingles").alias("n"), *bits, F.posexplode("bands").alias("band", "key"))
    mixed = b.groupBy("band", "key").agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.ceil(F.count("*") / BUCKET_PART).cast("int").alias("parts")).where("lo <> hi").drop("lo", "hi")
    b = b.join(mixed, ["band", "key"])
    left = b.withColumn("part", F.pmod(F.hash("class"), "parts")).drop("parts")
    right = b.select("band", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("class").alias("other"), F.col("family").alias("other_family"), F.col("n").alias("m"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH)])
    j = left.join(right, ["band", "key", "part"]).where((F.col("class") < F.col("other")) & (F.col("family") != F.col("other_family")) & (F.col("n") >= SIMILAR * F.col("m")) & (F.col("m") >= SIMILAR * F.col("n")))
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(SKETCH)), F.lit(0))
    at_most = (F.col("n") + F.col("m") - differ) / 2
    pairs = j.where(_similar(at_most, F.col("n"), F.col("m"))).select(F.col("class").alias("a"), F.col("other").alias("b")).dropDuplicates()
    return _verified(pairs, cls.select("class", "shingles"))


def families(traits: DataFrame) -> DataFrame:
    """(class, family): files of equal shingles are one class, classes of similarity 0.8 or more that share a band bucket one family.

    In each band bucket every class is first held against the bucket's least class, which joins most of a family by as many
    candidates as the bucket has classes. What is similar without being similar to the least is then found among the pairs of the
    bucket that are still of different families. Both are verified on the shingles themselves. Files too short for bands are of one
    family where they are of one class.
    """
    given = F.col("bands") if "bands" in traits.columns else F.lit(None).cast("array<long>")
    distinct = traits.where("class is not null").select("class", "shingles", given.alias("bands")).dropDuplicates(["class"])
    few = F.size("shingles") < LEAST_SHINGLES
    short = distinct.where(few).select("class", F.col("class").alias("family"))

    def one(r: dict) -> list[tuple]:
        sh = np.array(r["shingles"], np.int32)
        return [(r["class"], r["shingles"], r["bands"] or band_keys(sh.view(np.uint32)), parity_sketch(sh))]

    cls = durable(map_rows(distinct.where(~few), "class long, shingles array<int>, bands array<long>, sketch array<long>", one))
    b = cls.select("class", F.posexplode("bands").alias("band", "key"))
    least = b.groupBy("band", "key").agg(F.min("class").alias("rep"), F.count("*").alias("n")).where("n > 1")
    pairs = b.join(least, ["band", "key"]).where("class <> rep").select("class", "rep").dropDuplicates()
    # Files whose numbers of shingles differ too much cannot be similar; their shingles need not be sent.
    size = cls.select("class", F.size("shingles").alias("n"))
    pairs = pairs.join(size, "class").join(size.select(F.col("class").alias("rep"), F.col("n").alias("m")), "rep")
    pairs = pairs.where((F.col("n") >= SIMILAR * F.col("m")) & (F.col("m") >= SIMILAR * F.col("n"))).select(F.col("class").alias("a"), F.col("rep").alias("b"))
    comp = connected_components(_verified(pairs, cls.select("class", "shingles")), "a", "b").select(F.col("node").alias("class"), F.col("component").alias("family"))
    first = durable(cls.select("class").join(comp, "class", "left").withColumn("family", F.coalesce("family", "class")))
    links = _across(cls, first).join(first.toDF("a", "u"), "a").join(first.toDF("b", "v"), "b").select("u", "v").dropDuplicates()
    joined = connected_components(durable(links), "u", "v").select(F.col("node").alias("family"), F.col("component").alias("whole"))
    return first.join(joined, "family", "left").select("class", F.coalesce("whole", "family").alias("family")).unionByName(short)


def _join_hot(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join with a table that has each key once. Keys with over 1/HOT_KEYS of all rows are sent to all; the others are shuffled."""
    n = rows.count()
    hot = F.broadcast(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(1000, n // HOT_KEYS)).select(key))
    heavy = rows.join(hot, key, "left_semi").join(F.broadcast(other.join(hot, key, "left_semi")), key, "left")
    return rows.join(hot, key, "left_anti").join(other, key, "left").unionByName(heavy)


def family_kinds(traits: DataFrame, fam: DataFrame) -> DataFrame:
    """(class, family_size, by_family): what its family says of each class.

    The shape is averaged over the files of a family: literal-only shingles make it a blob (`data`), code in dense lines `minified`,
    and shingles that mostly come again and again within the files `generated`. A family without such a shape is what most of its files
    say that they are, by comment or path.
    """
    mark = F.coalesce("by_comment", F.when(F.col("by_path") != "output", F.col("by_path")))
    means = {"repeated": F.col("repeated"), "literal": F.col("literal"), "dense": F.col("dense").cast("int"), "tokens": F.col("n_tokens"), "says": mark.isin("generated", "built").cast("int")}
    per_class = traits.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in means.items()]).join(fam, "class")
    per = per_class.groupBy("family").agg(F.sum("n").alias("family_size"), *[(F.sum(k) / F.sum("n")).alias(k) for k in means])
    kind = F.when(F.col("literal") >= LITERAL, "data").when(F.col("dense") >= 0.5, "minified").when(F.col("repeated") >= REPEATED, "generated")
    voted = F.when((F.col("says") >= FAMILY_SHARE) & (F.col("says") * F.col("family_size") >= FAMILY_LEAST - 0.5), "generated")
    per = per.select("family", "family_size", F.coalesce(F.when((F.col("family_size") > 1) | (F.col("tokens") >= ALONE), kind), voted).alias("by_family"))
    return _join_hot(per_class.select("class", "family"), per, "family").drop("family")


def copied(traits: DataFrame) -> DataFrame:
    """(copy, origin): what several repositories hold token by token, and the one that had it first (ties: the least name)."""
    c = traits.where("copy is not null").groupBy("copy").agg(F.min(F.struct(F.coalesce("indexed_at", F.lit(2**62)), "repo_id"))["repo_id"].alias("origin"), F.min("repo_id").alias("lo"), F.max("repo_id").alias("hi"))
    return c.where("lo <> hi").select("copy", "origin")


def not_handwritten(files: DataFrame) -> DataFrame:
    """Files that nobody wrote by hand in that repository: (repo_id, path, kind, evidence, family_size).

    Masked five-token shingles are clustered by MinHash banding and verified at 0.8. Families decide by their shape alone what is
    generated, minified or a blob of data, whatever path and comments say. Files whose tokens, names included, several repositories
    hold are vendored in all but the first of them. A family cannot tell a single third-party file that only one repository holds:
    there path and first or last comments are the evidence. A folder for all kinds of output counts only where there is no content.
    Defined results: is_code false or null gives no row; null content is judged by its path; an empty text only by its path;
    a file given twice gives one row.
    """
    t = durable(file_traits(files.where("is_code")))
    kinds = durable(family_kinds(t, families(t)))
    marks = t.drop("shingles", "repeated", "literal", "dense", "n_tokens").dropDuplicates(["repo_id", "path"])
    out = _join_hot(_join_hot(marks, kinds, "class"), copied(t), "copy")
    by = {
        "family": F.col("by_family"),
        "copy": F.when(F.col("repo_id") != F.col("origin"), "vendored"),
        "comment": F.col("by_comment"),
        "path": F.when((F.col("by_path") != "output") | F.col("no_content"), F.col("by_path")),
    }
    ev = F.concat_ws(",", *[F.when(c.isNotNull(), k) for k, c in by.items()])
    found = out.select("repo_id", "path", F.coalesce(*by.values()).alias("kind"), ev.alias("evidence"), F.coalesce("family_size", F.lit(1)).cast("long").alias("family_size"))
    return found.where("kind is not null")
