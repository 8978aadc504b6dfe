"""Missing or wrong document language labels, by compression."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from codestrata.llm.arrow import map_rows

#: Training: at most about so many labelled documents per language, and so many bytes of text per dictionary.
DOCS_PER_LANGUAGE, DICTIONARY_BYTES, LEVEL = 400, 49_152, 9
#: Bytes that are encoded at once.
BLOCK = 4096
#: Share of the sample's documents that is held out of the dictionaries and calibrates the confidence, and paragraphs per language for that.
HELD_OUT, CALIBRATION = 0.25, 60
#: A paragraph is rejected if its encoding without any dictionary is not larger enough to speak for its language (probability below this).
LEAST_FIT = 0.5
#: A paragraph is rejected if the second smallest encoding is larger by less than this share and by less than so many bytes.
LEAST_MARGIN, LEAST_BYTES = 0.02, 2

# Other usual spellings of the languages' names (ISO 639-2/B codes and the languages' own names).
ALIASES = {
    "ger": "de", "fre": "fr", "dut": "nl", "chi": "zh", "cmn": "zh", "deutsch": "de", "français": "fr", "francais": "fr", "español": "es", "espanol": "es", "castellano": "es", "castilian": "es",
    "português": "pt", "portugues": "pt", "italiano": "it", "nederlands": "nl", "flemish": "nl", "русский": "ru", "中文": "zh", "汉语": "zh", "mandarin": "zh", "日本語": "ja", "한국어": "ko", "हिन्दी": "hi", "हिंदी": "hi",
}

_LINE = re.compile(r"\r\n|\r|\n|\x0b|\x0c|\x85| | ")
_ZERO = dict.fromkeys(map(ord, "​‌‍﻿⁠"))
_HAN, _KANA, _HANGUL, _DEVA, _CYR = (re.compile(x) for x in (r"[㐀-鿿]", r"[぀-ヿㇰ-ㇿ]", r"[가-힯ᄀ-ᇿ]", r"[ऀ-ॿ]", r"[Ѐ-ӿ]"))
_SCRIPT = {"zh": "han", "ja": "han", "ko": "hangul", "hi": "deva", "ru": "cyr"}
_WORD = re.compile(r"[^\W\d_]+")


def paragraphs(text: str) -> list[str]:
    """Paragraphs in order: runs of lines that are not white space only."""
    out, cur = [], []
    for line in _LINE.split(text):
        if line.translate(_ZERO).strip():
            cur.append(line)
        elif line.strip():
            cur.append(line)
        elif cur:
            out.append("\n".join(cur))
            cur = []
    if cur:
        out.append("\n".join(cur))
    return out


_CODE_LINE = re.compile(
    r"^\s*(?:\$ |> ?\$ |@@ |\+\+\+ |--- |[+-]\s*[\w.]+\(|[+-]{1}\s*\w+\s*=|\|.*\||at [\w.$<>]+\(|File \"|Traceback|Caused by:|\w[\w.]* \([\w./-]+:\d+\)|[{}\[\]();]+\s*$|(?:def|class|func|function|fn|const|let|var|return|import|from|package|public|private|static|void|int|char|#include|type|struct|elif|else|if|for|while|try|except|catch|async|await|export)\b.*[{(:;=]|"
    r".*[;{]\s*$|//|/\*|\*/|#!|`[^`]*`\s*$|\w+\s*(?:\+|-)?=\s*\S+\s*$|[\w.]+\([^()]*\)\s*;?\s*$|\s*\w+\s*\+=)"
)
_VERSION = re.compile(r"^\W*(?:v|version|release)?\s*\d+(?:\.\d+)+\S*(?:\s*[-–(\[]*\s*(?:\d{4}-\d\d-\d\d|[0-9a-f]{7,40})\W*)?$", re.I)


def _is_prose(p: str) -> bool:
    """Sentences, headings and lists of sentences; not code, tables, signatures, commands, diffs, traces or version lines."""
    lines = [x for x in (y.translate(_ZERO) for y in p.split("\n")) if x.strip()]
    letters = sum(len(w) for w in _WORD.findall(p))
    if not letters:
        return False
    code = sum(bool(_CODE_LINE.match(x)) or bool(_VERSION.match(x.strip())) for x in lines)
    if code * 2 >= len(lines):
        return False
    signs = sum(c in "{}[]()<>=;|_\\/$@#*&^~`+%" for x in lines for c in re.sub(r"^\s*(?:[-*>#+]+\s*)+", "", x))
    wide = any(x.search(p) for x in (_HAN, _KANA, _HANGUL, _DEVA))
    if signs > letters * (0.35 if not wide else 0.6):
        return False
    return True


def prose(text: str) -> list[tuple[int, str]]:
    """(number, text) of the prose paragraphs; fenced blocks go on over blank lines."""
    out, fence = [], None
    for k, p in enumerate(paragraphs(text)):
        lines, plain = p.split("\n"), []
        for x in lines:
            m = re.match(r"\s*(?:[>*-]\s*)?(```+|~~~+)", x.translate(_ZERO))
            if m and (fence is None or m[1][0] == fence):
                fence = None if fence else m[1][0]
            elif fence is None:
                plain.append(x)
        rest = "\n".join(plain)
        if rest.strip() and (len(plain) == len(lines) or len(plain) * 2 > len(lines)) and _is_prose(rest):
            out.append((k, rest))
    return out


def script_of(text: str) -> str:
    """The writing that most letters belong to; kana counts as Han."""
    n = {"han": len(_HAN.findall(text)) * 2 + len(_KANA.findall(text)) * 2, "hangul": len(_HANGUL.findall(text)) * 2, "deva": len(_DEVA.findall(text)), "cyr": len(_CYR.findall(text))}
    best = max(n, key=lambda k: n[k])
    latin = len(re.findall(r"[A-Za-zÀ-ɏ]", text))
    return best if n[best] * 2 > latin else "latin"


#: Weights (constant, slope) of the two probabilities before there is any held-out paragraph, which also steady small fits.
PRIOR_BETWEEN, PRIOR_OWN = (0.2, 12.0), (-2.0, 20.0)


class Compression:
    """One zstandard raw-content dictionary per language; the smallest encoding names the language.

    between: weights of the probability that the smallest encoding is right, by its margin over the second. own: by language, weights
    of the probability that a text is of it at all, by how much smaller its dictionary makes the text than no dictionary does.
    """

    def __init__(self, texts: dict[str, bytes], between: tuple = PRIOR_BETWEEN, own: dict[str, tuple] | None = None):
        self.by_script: dict = defaultdict(list)
        self.between, self.own = between, own or {}
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=4)
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        self.by_lang = {}
        for lang in sorted(texts):
            d = zstandard.ZstdCompressionDict(texts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by_lang[lang] = zstandard.ZstdCompressor(compression_params=params, dict_data=d)
            self.by_script[_SCRIPT.get(lang, "latin")].append((lang, self.by_lang[lang]))

    @staticmethod
    def blocks(text: str) -> list[bytes]:
        """Very short texts are not encoded at all unless repeated; long ones are encoded in blocks, so that each block meets the dictionary."""
        data = _clean(text).encode("utf-8")
        return [(b"\n" + data) * 3] if len(data) < 64 else [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]

    def gain(self, lang: str, blocks: list[bytes], plain: int) -> float:
        """How much smaller the language's dictionary makes the text than no dictionary does, scaled by its length."""
        return scaled(plain - sum(len(self.by_lang[lang].compress(b)) for b in blocks), plain, blocks)

    def classify(self, text: str) -> tuple[str | None, float]:
        """(language or None, confidence): None where the margin is narrow, the dictionary hardly helps, or none has the writing.

        A writing of one language is no proof of it: its dictionary has to make the text as much smaller as it does with its own.
        """
        blocks = self.blocks(text)
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.by_script.get(script_of(text), []))
        if not sizes:
            return None, 0.0
        plain = sum(len(self.plain.compress(b)) for b in blocks)
        a, lang = sizes[0]
        fit = _probability(self.own.get(lang, PRIOR_OWN), scaled(plain - a, plain, blocks))
        b = sizes[1][0] if len(sizes) > 1 else None
        conf = round(fit * (1.0 if b is None else _probability(self.between, scaled(b - a, b, blocks))), 4)
        if fit < LEAST_FIT or b is not None and (b - a) / max(b, 1) < LEAST_MARGIN and b - a < LEAST_BYTES:
            return None, conf
        return lang, conf


def scaled(saved: int, size: int, blocks: list[bytes]) -> float:
    """The share saved, of more weight in longer texts."""
    return saved / max(size, 1) * math.sqrt(min(sum(map(len, blocks)), 400) / 60)


def _probability(w: tuple, x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * x))))


def logistic(x: list[float], y: list[bool], prior: tuple) -> tuple[float, float]:
    """(constant, slope) of a logistic regression by Newton's steps, halved until they help; the prior counts as a few observations."""
    w, p0 = np.array(prior, float), np.array(prior, float)
    m, t = np.column_stack([np.ones(len(x)), x]) if x else np.zeros((0, 2)), np.array(y, float)
    ridge = np.diag([0.2, 0.02])

    def cost(w) -> float:
        z = m @ w
        return float(np.sum(np.logaddexp(0, z) - t * z) + (w - p0) @ ridge @ (w - p0) / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + ridge, m.T @ (t - p) - ridge @ (w - p0))
        while cost(w + step) > cost(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def calibrate(texts: dict[str, bytes], held: list[tuple[str, str]]) -> tuple[tuple, dict[str, tuple]]:
    """(between, own) from held-out paragraphs (language, text), of which no dictionary has seen the documents."""
    m = Compression(texts)
    x, y = [], []
    gains: dict = {k: ([], []) for k in texts}
    for lang, p in held:
        blocks = m.blocks(p)
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), k) for k, c in m.by_script.get(script_of(p), []))
        if len(sizes) > 1:
            x.append(scaled(sizes[1][0] - sizes[0][0], sizes[1][0], blocks))
            y.append(sizes[0][1] == lang)
        plain = sum(len(m.plain.compress(b)) for b in blocks)
        for k in texts:
            gains[k][0].append(m.gain(k, blocks, plain))
            gains[k][1].append(k == lang)
    return logistic(x, y, PRIOR_BETWEEN), {k: logistic(*g, PRIOR_OWN) for k, g in gains.items()}


def _clean(text: str) -> str:
    """Numbers and marks of lists carry no language."""
    t = re.sub(r"\d+", "0", text.translate(_ZERO))
    return re.sub(r"\s+", " ", re.sub(r"(?m)^\s*(?:[-*>#+]+\s*)+", "", t)).strip()


def label_code(label: Column, codes: dict[str, str]) -> Column:
    """The code that a label names in any usual spelling, or null."""
    base = F.lower(F.btrim(label, F.lit(" \t\n\r ")))
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(table[base], table[F.split(base, r"[-_@. (]")[0]])


def known_codes(lang_codes: DataFrame) -> dict[str, str]:
    """Spelling -> code; lang_codes is a fixed list of languages."""
    out = dict(ALIASES)
    for r in lang_codes.select("code", "code3", "lang_name").collect():
        out |= {x.lower(): r.code for x in (r.code, r.code3, r.lang_name) if x}
    return out


def labelled_sample(documents: DataFrame, codes: dict[str, str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(code, text) of a bounded sample of labelled documents, about DOCS_PER_LANGUAGE each: those to learn from and those held out."""
    d = documents.where("text is not null").select("doc_id", "text", label_code(F.col("lang"), codes).alias("code")).where("code is not null")
    n = {r.code: r["n"] for r in d.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not n:
        return [], []
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, DOCS_PER_LANGUAGE / v))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) / 1_000_003.0
    out = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0 < HELD_OUT  # by the text, so that copies stand on one side
    # Very long texts are left to the classifier; for training, documents of ordinary length do, so the sample has a bound in bytes as well.
    sample = d.where(F.length("text") <= 20_000).where(u < share[F.col("code")]).withColumn("out", out).orderBy("doc_id").limit(2 * DOCS_PER_LANGUAGE * len(n)).collect()
    return [(r.code, r.text) for r in sample if not r.out], [(r.code, r.text) for r in sample if r.out]


class Words:
    """Shares of a label's documents that hold a word; only says whether a paragraph's words speak for its label, as labels may be wrong."""

    def __init__(self, docs: list[tuple[str, str]]):
        self.words: dict[str, Counter] = defaultdict(Counter)
        self.total: Counter = Counter()
        for code, text in docs:
            self.words[code].update({w.lower() for _, p in prose(text) for w in _tokens(_clean(p))})
            self.total[code] += 1

    def speak_for(self, code: str, p: str) -> bool:
        t = [w.lower() for w in _tokens(p)]
        if not t or script_of(p) != _SCRIPT.get(code, "latin"):
            return False
        score = {k: sum(math.log((w[x] + 0.1) / (self.total[k] + 20)) for x in t) for k, w in self.words.items()}
        return max(score, key=lambda k: score[k]) == code if score else False


def dictionaries(docs: list[tuple[str, str]], words: Words) -> dict[str, bytes]:
    """Dictionary texts per language from labelled documents, of paragraphs whose words speak for the label."""
    parts: dict[str, list[str]] = defaultdict(list)
    for code, text in docs:
        parts[code].extend(_clean(p) for _, p in prose(text))
    out: dict[str, bytes] = {}
    for c, ps in parts.items():
        kept, size = [], 0
        sentences = Counter(p for p in ps if words.speak_for(c, p))
        # Short pieces such as headings first go to the far end, frequent ones to the near end of the dictionary.
        seen_words: Counter = Counter()
        for p in sorted(sentences, key=lambda x: (sentences[x], -len(x), x), reverse=True):
            fresh = [w for w in _tokens(p) if seen_words[w.lower()] < 30]
            if size < DICTIONARY_BYTES and (fresh or len(p) < 60):
                kept.append(p)
                size += len(p.encode()) + 1
                seen_words.update(w.lower() for w in _tokens(p))
        if kept:
            out[c] = "\n".join(reversed(kept)).encode()
    return out


def train(documents: DataFrame, codes: dict[str, str]) -> dict[str, bytes]:
    """Dictionary texts per language from the sample's documents that are not held out."""
    docs, _ = labelled_sample(documents, codes)
    return dictionaries(docs, Words(docs))


def fit(documents: DataFrame, codes: dict[str, str]) -> tuple[dict[str, bytes], tuple, dict[str, tuple]]:
    """What `Compression` takes: dictionary texts, and the weights of its probabilities by held-out documents."""
    docs, held = labelled_sample(documents, codes)
    words = Words(docs)
    texts = dictionaries(docs, words)
    each: dict[str, list] = defaultdict(list)
    for code, text in held:
        for _, p in prose(text):
            if len(each[code]) < CALIBRATION and code in texts and words.speak_for(code, _clean(p)):
                each[code].append((code, p))
    return (texts, *calibrate(texts, [x for v in each.values() for x in v]))


def _tokens(p: str) -> list[str]:
    """Words; in writings without blanks between words, pairs of signs."""
    out = []
    for w in _WORD.findall(p):
        if _HAN.search(w) or _KANA.search(w):
            out.extend(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        else:
            out.append(w)
    return out


def judge(text: str, model: Compression) -> tuple[str | None, float, list[tuple[int, str | None, float]]]:
    """The document's language with its confidence, and (number, language, confidence) of each prose paragraph."""
    parts = [(k, p, *model.classify(p)) for k, p in prose(text)]
    votes: Counter = Counter()
    for _, p, lang, _ in parts:
        if lang:
            votes[lang] += 1
    if not votes:
        return None, 0.0, [(k, lang, c) for k, _, lang, c in parts]
    size = Counter()
    for _, p, lang, _ in parts:
        size[lang] += len(p)
    best = max(votes, key=lambda x: (votes[x], size[x], x))
    conf = round(sum(c for _, _, lang, c in parts if lang == best) / sum(votes.values()), 4)
    return best, conf, [(k, lang, c) for k, _, lang, c in parts]


def document_languages(documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """Per document: doc_id, lang (found), confidence, label (code its label names, or null), and its paragraphs.

    Confidences are calibrated on held-out documents. Defined results: null, empty and blank texts and texts without prose have lang
    null; a paragraph of narrow margin, or of a language that no dictionary is of, has lang null; whole texts are read; a row given twice gives two rows.
    """
    codes = known_codes(lang_codes)
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, codes))  # at most DICTIONARY_BYTES per language
    holder: dict = {}

    def one(r: dict) -> list[tuple]:
        model = holder.get("m")
        if model is None:
            model = holder["m"] = Compression(*shared.value)
        lang, conf, parts = judge(r["text"] or "", model)
        return [(r["doc_id"], lang, conf, r["label"], [{"para": k, "lang": x, "confidence": c} for k, x, c in parts])]

    d = documents.select("doc_id", "text", label_code(F.col("lang"), codes).alias("label"))
    return map_rows(d, "doc_id long, lang string, confidence double, label string, paragraphs array<struct<para:int,lang:string,confidence:double>>", one, spread=True)


def language_findings(judged: DataFrame) -> DataFrame:
    """(doc_id, para, lang): para -1 for a missing or wrong label, and each prose paragraph in another language than its document."""
    item = lambda para, lang: F.struct(para.cast("int").alias("para"), lang.alias("lang"))
    wrong = F.coalesce(F.col("label") != F.col("lang"), F.lit(True))
    own = F.when(wrong, F.array(item(F.lit(-1), F.col("lang")))).otherwise(F.array().cast("array<struct<para:int,lang:string>>"))
    other = F.transform(F.filter("paragraphs", lambda p: p["lang"].isNotNull() & (p["lang"] != F.col("lang"))), lambda p: item(p["para"], p["lang"]))
    f = judged.where("lang is not null").select("doc_id", F.explode(F.concat(own, other)).alias("f"))
    return f.select("doc_id", "f.para", "f.lang").dropDuplicates()
