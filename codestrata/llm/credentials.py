"""Credentials embedded in source code, by trigram index and verified expressions."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.llm.arrow import map_rows
from codestrata.llm.trigrams import required_trigrams

CHUNK, OVERLAP = 4096, 768

# Prefixes that issuers give their tokens.
_PREFIXED = (
    r"(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|npm_[A-Za-z0-9]{30,}|AIza[\w-]{35}|sk-[A-Za-z0-9]{20,}|"
    r"[a-z]{2,8}_(?:live|test|prod)_[A-Za-z0-9]{14,}|eyJ[\w-]{10,}\.eyJ[\w-]{6,}\.[\w-]{10,}|hvs\.[\w-]{20,})"
)
_NAME = r"(?:password|passwd|passphrase|phrase|pwd|pass|secret|token|api[_-]?key|auth|cred|credential|credentials|bearer|(?:signing|deploy|cookie|hmac|tls|access|private|secret|encryption|session|ssh|service|master|storage|account|license)[_-]?key)"
_SHORT = ("pw", "k[0-9]", "key")
_OPENS = r"[\"']?\s*(?::\s*[\w<>\[\]]+\s*(?==))?(?::=|=>|=|:)\s*\(?\s*(?:[fbruL]{1,2}(?=[\"']))?(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\]){6,})(?P=q)"

_VALUE = r"\s*\(?\s*(?:[fbruL]{1,2}(?=[\"']))?(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\]){6,})(?P=q)"
# Short names are spelled out with the sign after them, so that three signs in a row are always required.
_SHORT_OPENS = "(?:" + "|".join(rf"{n}=|{n}:(?:=|\s*[\w<>\[\]]+\s*=)?|{n}[ \"']\s*(?::\s*[\w<>\[\]]+\s*(?==))?(?::=|=>|=|:)" for n in _SHORT) + ")"

#: Rule: (name, expression with the credential as group v, strength its value must have, only in configuration files).
RULES: list[tuple[str, str, str, bool]] = [
    ("key_block", r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)", "any", False),
    ("prefixed", rf"(?<![A-Za-z0-9+/=_-])(?P<v>{_PREFIXED})(?![A-Za-z0-9+/_-])", "any", False),
    ("vault_token", r"[\"'`= ]s\.(?P<v>[A-Za-z0-9]{24})(?![A-Za-z0-9(.])", "mixed", False),
    ("named", rf"(?<![\w.-])[\w.-]*?{_NAME}{_OPENS}", "named", False),
    ("short_named", rf"(?<![A-Za-z0-9_.-]){_SHORT_OPENS}{_VALUE}", "short", False),
    ("config", rf"^[ \t]*(?:export[ \t]+|- )?[\"']?[\w.-]*?{_NAME}[ \t]*[:=][ \t]*(?P<v>[^\s\"'`#;,]{{6,}})[ \t\r]*$", "named", True),
    ("config_short", r"^[ \t]*(?:export[ \t]+|- )?(?:pw[ =:]|k[0-9][ =:]|key[ =:])[ \t:=]*(?P<v>[^\s\"'`#;,:=][^\s\"'`#;,]{5,})[ \t\r]*$", "short", True),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@\"'<>]*:(?P<v>[^\s/@\"'<>]{3,})@[\w.\[-]", "weak", False),
    ("authorization", r"(?:authorization|auth)[\"']?\s*[:=]\s*[\"']?(?:bearer|token|apikey)\s+(?P<v>[A-Za-z0-9._~+/=-]{12,})", "mixed", False),
    ("bearer", r"bearer +(?P<v>[A-Za-z0-9._~+/=-]{16,})", "mixed", False),
    ("basic", r"basic +(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])", "basic", False),
    ("x_header", r"x-(?:auth|api|access|amz)[\w-]*[\"']?\s*[:=]\s*[\"']?(?P<v>[A-Za-z0-9._~+/=-]{16,})", "mixed", False),
    ("cookie", r"cookie[\"']?\s*[:=]\s*[\"']?[\w-]*?(?:sid|session|token|auth)[\w-]*\s*=\s*(?P<v>[^\s;\"'`]{16,})", "mixed", False),
    ("connection", r"(?<=[;\s\"'?&])(?:password|passwd|pwd)=(?P<v>[^\s;\"'`&,()\[\]{}]{6,})(?=[;\s\"'`&]|$)", "weak", False),
    ("auth_token", r"_auth(?:token)?=[\"']?(?P<v>[^\s\"'`;]{6,})", "weak", False),
    ("mysql", r"(?:mysql|mysqldump|mysqladmin|mariadb|sshpass)\b[^\n\"'`]*?\s-p(?P<v>[^\s\"'`]{6,})", "weak", False),
    ("curl", r"(?:curl|wget|http)\b[^\n\"'`]*?\s(?:-u|--user)[ =]+[^\s:\"'`]+:(?P<v>[^\s\"'`@]{4,})", "weak", False),
    ("option", r"--(?:password|passwd|token|secret|api-key)[ =](?P<v>[^\s\"'`;]{6,})", "weak", False),
    ("comment", r"\b(?:(?:key|pass|password|passphrase|token|secret|login|credential)(?: is| was|:)|works with)[ \t]+(?P<v>[^\s\"'`,]{6,})", "comment", False),
]
_COMPILED = {n: re.compile(p, (re.M if n in ("key_block", "prefixed", "vault_token") else re.M | re.I)) for n, p, _, _ in RULES}
_STRENGTH = {n: s for n, _, s, _ in RULES}
_CONFIG_ONLY = {n for n, _, _, c in RULES if c}

_PLACEHOLDER = re.compile(
    r"(?:\$[\w{(].*|%[({].*|<.*>|\{\{.*|\{.*\}|.*\$\{.*|change.?me.*|example.*|placeholder.*|your[-_. ].*|replace.?me.*|x{4,}|\*{3,}|\.{3,}|-{3,}|#{3,}|insert[-_ ].*|dummy.*|to.?do.*|none|null|nil|true|false|undefined|"
    r"secret|password|passwd|test(?:ing)?|redacted.*|enter[-_ ].*|process\.env.*|os\.(?:environ|getenv).*|system\.getenv.*|env[.(].*|vault[:/].*|(.)\1+)$",
    re.I,
)
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_PREFIX = re.compile(_PREFIXED + "$")
_HASHED = re.compile(r"(?:sha\d+[-:]|md5[-:]|\{?(?:SSHA|bcrypt)\}?|\$2[aby]\$|\$argon|\$[156]\$|data:)", re.I)


def _strong(v: str, how: str) -> bool:
    """Whether a value can be a credential where it stands."""
    if how == "any":
        return True
    if _PLACEHOLDER.match(v) or _UUID.match(v) or _HASHED.match(v):
        return False
    if _PREFIX.match(v):
        return True
    low, up, dig = any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v)
    if how == "basic":
        try:
            user, _, secret = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
        except (binascii.Error, ValueError):
            return False
        return bool(user and len(secret) >= 3 and secret.isprintable() and not _PLACEHOLDER.match(secret))
    if how == "weak":
        return v.strip("0123456789") != "" or len(v) >= 8
    if any(c.isspace() for c in v):
        return False
    if how == "mixed":
        return dig and (low or up)
    inside = any(not c.isalnum() for c in v[1:-1])
    mixed = low and up and inside and len(v) >= 8
    if v.startswith(("./", "../")) or re.match(r"[a-z][a-z0-9+.-]*://", v) or re.match(r"/[a-z0-9_.-]+(?:/[a-z0-9_.-]+)*/?$", v):
        return False
    if how == "named":
        return bool((dig and (low or up)) or mixed or (dig and len(v) >= 12))
    if how == "short":
        return len(v) >= 6 and bool((dig and (low or up) and (len(v) >= 16 or up or inside or re.search(r"\d{3,}$", v))) or mixed)
    if how == "comment":
        if re.match(r"v?\d+(?:\.\d+)+\W*$", v) or re.search(r"[()=]|::|\.\w{1,4}$", v) or re.match(r"[A-Za-z]+[_-][a-z]+\W*$", v):
            return False
        return bool(dig and (low or up) and (len(v) >= 16 or re.search(r"\d{2,}\W?$", v) or (up and low) or inside)) or mixed and bool(re.search(r"[#_!$@%^&*]", v))
    raise ValueError(how)


_JOINT = re.compile(r"([\"'])[ \t]*(?:\+|\\|\.|\.\.)?[ \t]*\r?\n[ \t]*(?:\+[ \t]*)?\1")


def _joined(text: str) -> tuple[str, list[int], list[int]]:
    """The text with strings that go on in the next line joined, and where its parts begin in both."""
    parts, at, src, n, last = [], [0], [0], 0, 0
    for m in _JOINT.finditer(text):
        parts.append(text[last : m.start()])
        n += m.start() - last
        last = m.end()
        at.append(n)
        src.append(last)
    parts.append(text[last:])
    return "".join(parts), at, src


def _in_comment(text: str, at: int) -> bool:
    """Whether a sign of a comment stands before `at` in its line, with no quote in between."""
    start = max(text.rfind(c, 0, at) for c in "\n\"'") + 1
    return any(text.find(c, start, at) >= 0 for c in ("//", "#", "*", "--", ";"))


def find_credentials(text: str, config: bool = False, rules: list[str] | None = None) -> list[tuple[str, list[tuple[int, int]]]]:
    """(rule, spans) of each credential in order; more than one span where a string goes on in the next line.

    Overlapping finds count once, the longest rule order first. Whole texts are read; an empty text has none.
    """
    joined, at, src = _joined(text)

    def spans(a: int, b: int) -> list[tuple[int, int]]:
        out = []
        i = bisect_right(at, a) - 1
        while a < b:
            end = min(b, at[i + 1] if i + 1 < len(at) else len(joined))
            if end > a:
                out.append((src[i] + a - at[i], src[i] + end - at[i]))
            a, i = max(a, end), i + 1
        return out

    found: list[tuple[int, int, str]] = []
    for name, _, _, only in RULES:
        if (only and not config) or (rules is not None and name not in rules):
            continue
        for m in _COMPILED[name].finditer(joined):
            v = m["v"]
            a, b = m.span("v")
            if name == "key_block":
                end = joined.find("-----END", b)
                close = joined.find("-----", end + 8) if end >= 0 else -1
                nxt = joined.find("-----BEGIN", b)
                if close >= 0 and not 0 <= nxt < end:
                    b = close + 5
                found.append((a, b, name))
            elif name == "comment" and not _in_comment(joined, m.start()):
                continue
            elif _strong(v.strip() if name not in ("named", "short_named") else v, _STRENGTH[name]) and not v.startswith("-----BEGIN"):
                found.append((a, b, name))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], -1
    for a, b, name in found:
        if a >= end:
            out.append((name, spans(a, b)))
            end = b
    return out


def redact(text: str, found: list[tuple[str, list[tuple[int, int]]]], mark: str = "REDACTED") -> str:
    """The text with only the credentials replaced; of a key block the marker lines and line ends stay."""
    out, last = [], 0
    for name, spans in found:
        for k, (a, b) in enumerate(spans):
            out.append(text[last:a])
            if name == "key_block":
                body = text[a:b]
                m = re.match(r"(-----BEGIN [^\n]*?-----)(.*?)(-----END [^\n]*?-----)?$", body, re.S)
                out.append(m[1] + re.sub(r"[A-Za-z0-9+/=]{12,}", mark, m[2]) + (m[3] or "") if m else body if k else mark)
            else:
                out.append(mark if k == 0 else "")
            last = b
    out.append(text[last:])
    return "".join(out)


# -- the index
def rule_trigrams(spark: SparkSession) -> DataFrame:
    """(trigram, rule, alt, bit, full): the trigrams each rule needs; as many rows as the fixed rules have."""
    rows = []
    for name, pattern, _, _ in RULES:
        for alt, grams in enumerate(required_trigrams(pattern)):
            short = sorted(grams)[:60]
            rows.extend((g, name, alt, 1 << i, (1 << len(short)) - 1) for i, g in enumerate(short))
    return spark.createDataFrame(rows, "trigram string, rule string, alt int, bit long, full long")


#: Letters that expressions without case take for i and s, though lower() does not.
_FOLD = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s"})


def trigram_index(texts: DataFrame, wanted: frozenset) -> DataFrame:
    """Postings (trigram, source_table, row_id, chunk) of all chunks of all texts, for the trigrams that rules can ask for.

    Texts are indexed as they are verified, with strings that go on in the next line joined.
    """
    def one(r: dict) -> list[tuple]:
        t, out = _joined(r["text"])[0].translate(_FOLD).lower(), []
        for k, at in enumerate(range(0, max(len(t), 1), CHUNK)):
            c = t[at : at + CHUNK + OVERLAP]
            out.extend((g, r["source_table"], r["row_id"], k) for g in {c[i : i + 3] for i in range(len(c) - 2)} & wanted)
        return out

    return map_rows(texts.select("source_table", "row_id", "text"), "trigram string, source_table string, row_id long, chunk int", one, spread=True)


def candidates(texts: DataFrame) -> DataFrame:
    """(source_table, row_id, rules): texts whose chunks together hold all trigrams a rule requires, however long the match is."""
    rules = rule_trigrams(texts.sparkSession)
    wanted = frozenset(g for _, p, _, _ in RULES for alt in required_trigrams(p) for g in alt)
    hits = trigram_index(texts, wanted).join(F.broadcast(rules), "trigram")
    met = hits.groupBy("source_table", "row_id", "rule", "alt", "full").agg(F.bit_or("bit").alias("bits")).where("bits = full")
    return met.groupBy("source_table", "row_id").agg(F.collect_set("rule").alias("rules"))


def all_texts(files: DataFrame, fn_defs: DataFrame) -> DataFrame:
    """(source_table, row_id, text, config) of both tables; null texts hold nothing."""
    a = files.select(F.lit("file_records").alias("source_table"), F.col("file_id").alias("row_id"), F.col("content").alias("text"), (~F.coalesce("is_code", F.lit(True))).alias("config"))
    b = fn_defs.select(F.lit("fn_defs").alias("source_table"), F.col("fn_id").alias("row_id"), F.col("code").alias("text"), F.lit(False).alias("config"))
    return a.unionByName(b).where("text is not null and text <> ''")


def verified(files: DataFrame, fn_defs: DataFrame) -> DataFrame:
    """Per text with credentials: their rules and lines, and the text redacted.

    A trigram index over overlapping chunks gives candidates (a text and the rules whose required trigrams its chunks hold);
    only these are verified, on the whole text. Defined results: null and empty texts give no row; a row given twice gives one row;
    lines are ended by \\n; a credential that goes on in the next line counts where it begins.
    """

    def one(r: dict) -> list[tuple]:
        t = r["text"]
        f = find_credentials(t, r["config"], r["rules"])
        if not f:
            return []
        at = [s[0][0] for _, s in f]
        return [(r["source_table"], r["row_id"], [{"line_no": t.count("\n", 0, p) + 1, "rule": n} for p, (n, _) in zip(at, f)], redact(t, f))]

    texts = all_texts(files, fn_defs)
    # The list of candidates is joined by size: sent to all where small, shuffled where not.
    todo = texts.join(candidates(texts), ["source_table", "row_id"])
    out = map_rows(todo, "source_table string, row_id long, found array<struct<line_no:int,rule:string>>, redacted string", one)
    return out.dropDuplicates(["source_table", "row_id"])
