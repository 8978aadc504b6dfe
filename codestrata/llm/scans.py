"""Noise in text from scanned pages: damaged characters, broken words, running titles and page numbers."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from codestrata.llm.arrow import map_rows
from codestrata.session import durable

#: Words that occur at least so often are known, however large the corpus.
LEAST_COUNT = 5
#: Training sees the counts of at most so many words, the most frequent ones.
TRAINING_WORDS = 200_000
#: What is read for what is learned from pairs of words that differ in one place: so many pairs, the meant word so many times as frequent, words of so many letters.
PAIRS, PAIR_RATIO, PAIR_LETTERS = 5, 10, 5
#: Training uses at most so many clean chunks, and so many letters of each.
TRAINING_CHUNKS, TRAINING_LETTERS, EPOCHS = 1500, 20_000, 4
#: So many times rarer than another word, a word that can be its misreading is taken for one (short words, and those of five letters and more).
RARER, RARER_LONG = 25, 5
#: Training goes on until the right edit leads by this score.
MARGIN = 2.0
#: Lines from the page's edge that can be furniture, not counting page numbers.
EDGE = 3

# What recognition commonly reads instead of what stands on the page (read -> meant); what a corpus shows is learned besides.
CONFUSIONS = [
    ("c", "e"), ("0", "o"), ("5", "s"), ("f", "t"), ("ri", "n"), ("l", "i"), ("1", "l"), ("1", "i"), ("cl", "d"), ("b", "h"), ("rn", "m"), ("ii", "u"), ("q", "g"), ("vv", "w"), ("m", "rn"), ("o", "a"),
    ("8", "b"), ("6", "g"), ("2", "z"), ("9", "g"), ("u", "v"), ("li", "h"), ("lc", "k"), ("tl", "d"), ("|", "l"), ("!", "l"), ("$", "s"), ("@", "a"),
]
_HYPHENS = "-‐‑­¬"
_BREAK = re.compile(rf"(\w+)([{_HYPHENS}])[ \t]*\n(?:[ \t]*\n)?[ \t]*(\w+)")
_WORD = re.compile(r"[^\W_][\w|!$@]*[^\W_]|[^\W_]")
_NUMBER = r"(?:[0-9OlIS]*[0-9][0-9OlIS]*|[ivxlcIVXLC]+)"
PAGE_NUMBER = re.compile(rf"^\W*(?:(?:page|pg|p|seite|page no|no)\b\.?\s*)?{_NUMBER}(?:\s*(?:of|/|\||von|sur|de)\s*{_NUMBER})?\W*$", re.I)


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def line_key(line: str) -> str:
    """One key for a running title however it was read: numbers dropped, signs that are mistaken for each other made the same."""
    s = re.sub(r"(?<!\w)[\dIlO]*\d[\dIlO]*(?!\w)", "", line).lower()
    for a, b in (("l", "i"), ("1", "i"), ("0", "o"), ("a", "o"), ("5", "s"), ("c", "e"), ("f", "t"), ("b", "h"), ("q", "g"), ("ei", "d"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w")):
        s = s.replace(a, b)
    return re.sub(r"[^a-zà-ÿ]", "", s)


def edge_lines(text: str) -> list[tuple[int, int, str, bool]]:
    """(line index, place from the edge, line, at the top) of the lines that can be furniture; page numbers do not count as places."""
    lines = _lines(text)
    full = [i for i, x in enumerate(lines) if x.strip()]
    out = {}
    for order, top in ((full, True), (full[::-1], False)):
        place = 0
        for i in order:
            if place >= EDGE:
                break
            if not PAGE_NUMBER.match(lines[i]):
                if i not in out or out[i][1] > place:
                    out[i] = (i, place, lines[i], top)
                place += 1
    return sorted(out.values())


# -- the averaged perceptron
class Perceptron:
    """Linear scores over named features, averaged over all examples."""

    def __init__(self, weights: dict | None = None):
        self.w = dict(weights or {})
        self._sum: dict = defaultdict(float)
        self._at: dict = defaultdict(int)
        self._n = 0

    def score(self, feats) -> float:
        get = self.w.get
        return sum(get(f, 0.0) for f in feats)

    def step(self) -> None:
        """One more example; the average runs over examples, whether they changed anything or not."""
        self._n += 1

    def update(self, good, bad) -> None:
        for fs, d in ((good, 1.0), (bad, -1.0)):
            for f in fs:
                self._sum[f] += (self._n - self._at[f]) * self.w.get(f, 0.0)
                self._at[f] = self._n
                self.w[f] = self.w.get(f, 0.0) + d

    def finish(self) -> dict:
        n = max(self._n, 1)
        return {f: v for f, w in self.w.items() if (v := (self._sum[f] + (n - self._at[f]) * w) / n)}


def _bucket(n: int) -> int:
    return 0 if n == 0 else 1 + min(8, int(math.log2(n) / 1.5))


def trigrams(lexicon) -> Counter:
    """Counts of the letter trigrams of words, their ends marked."""
    return Counter(w[i : i + 3] for word in lexicon for w in [f"^{word}$"] for i in range(len(w) - 2))


def _shape(low: str, tri: dict) -> int:
    """How usual the word's rarest trigram is."""
    w = f"^{low}$"
    return min(_bucket(tri.get(w[i : i + 3], 0)) for i in range(len(w) - 2))


def by_first(table) -> dict[str, list[tuple[str, str]]]:
    """read -> meant by the first character of what is read."""
    out: dict = defaultdict(list)
    for read, meant in table:
        out[read[0]].append((read, meant))
    return dict(out)


_COMMON = by_first(CONFUSIONS)


def edits(word: str, table: dict | None = None) -> list[tuple[int, str, str, str, list]]:
    """Operations at each character of a word: (place, read, meant, result, what is done to the characters)."""
    low, out, table = word.lower(), [], _COMMON if table is None else table
    for i, c in enumerate(low):
        for read, meant in table.get(c, ()):
            if low.startswith(read, i):
                ops = [("replace", meant[0])] + [("insert", x) for x in meant[1:]] + [("delete", "")] * (len(read) - 1)
                out.append((i, read, meant, low[:i] + meant + low[i + len(read) :], ops))
    return out


def _kind(c: str) -> str:
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "sign" if c else "end"


def _context(low: str, i: int, n: int) -> tuple[str, str]:
    return _kind(low[i - 1 : i]), _kind(low[i + n : i + n + 1])


def _keep_features(word: str, i: int, lexicon: dict, tri: dict) -> list:
    """Keeping the character at `i`."""
    low = word.lower()
    known = _bucket(lexicon.get(low, 0))
    return ["keep", ("k", known), ("k-shape", min(_shape(low, tri), 4), known > 0), ("k-char", _kind(low[i]), known > 0), ("k-around", _kind(low[i]), *_context(low, i, 1)), ("k-digit", any(c.isdigit() for c in word), any(c.isalpha() for c in word))]


def _edit_features(word: str, e: tuple, lexicon: dict, tri: dict) -> list:
    i, read, meant, new, ops = e
    low = word.lower()
    a, b = lexicon.get(low, 0), lexicon.get(new, 0)
    ratio = min(9, int(math.log2((b + 1) / (a + 1)))) if b > a else -1
    odd = any(not c.isalpha() for c in read)
    x, y = _shape(low, tri), _shape(new, tri)
    f = ["edit", ("to", _bucket(b)), ("ratio", ratio), ("known", b > 0, a > 0), ("lead", _bucket(a), ratio), ("op", read, meant, b > 0), ("odd", odd, b > 0), ("len", min(len(word), 6), b > 0), ("place", "start" if i == 0 else "end" if i + len(read) == len(low) else "in", b > 0)]
    f += [("shape", min(y, 4), y > x, b > 0), ("around", odd, *_context(low, i, len(read)), b > 0)]
    f.extend(("char", kind, c, b > 0) for kind, c in ops)
    if odd:
        f.append(("odd-shape", min(y, 4), sum(c.isdigit() for c in word)))
    return f


def next_form(word: str, lexicon: dict, model: Perceptron, tri: dict, table: dict) -> str | None:
    """The word after the surest operation of those predicted for its characters; None if every character is kept."""
    if len(word) < 2 or not any(c.isalpha() for c in word):
        return None
    best, top, keep = None, 0.0, {}
    for e in edits(word, table):
        i = e[0]
        if i not in keep:
            keep[i] = model.score(_keep_features(word, i, lexicon, tri))
        s = model.score(_edit_features(word, e, lexicon, tri)) - keep[i]
        if s > top:
            best, top = e, s
    if best is None:
        return None
    i, read, meant, _, _ = best
    seg = word[i : i + len(read)]
    upper = word.isupper() if sum(c.isalpha() for c in word) > 1 else False
    if upper or (seg[0].isupper() and i == 0):
        meant = meant.upper() if upper else meant[0].upper() + meant[1:]
    return word[:i] + meant + word[i + len(read) :]


def fix_word(word: str, lexicon: dict, model: Perceptron, tri: dict, table: dict) -> str:
    """The word when every character is kept, or it would become what it was before."""
    seen = {word}
    while (new := next_form(word, lexicon, model, tri, table)) is not None and new not in seen:
        seen.add(new)
        word = new
    return word


def _join_features(left: str, mark: str, right: str, lexicon: dict) -> tuple[list, list]:
    whole = _bucket(lexicon.get((left + right).lower(), 0))
    a, b = _bucket(lexicon.get(left.lower(), 0)), _bucket(lexicon.get(right.lower(), 0))
    f = [("whole", whole), ("parts", a > 0, b > 0, whole > 0), ("mark", "-" if mark == "-" else "other"), ("lower", right[:1].islower(), left[-1:].islower()), ("digit", left[-1:].isdigit() or right[:1].isdigit()), ("short", min(len(left), 4), min(len(right), 4), whole > 0)]
    return [("join", x) for x in f] + ["join"], [("apart", x) for x in f] + ["apart"]


def _line_features(line: str, place: int, top: bool, repeated: bool, width: int) -> dict[str, list]:
    s = line.strip()
    words = [w for w in re.findall(r"[^\W\d_]+", s) if len(w) > 2]
    caps = sum(w[0].isupper() for w in words) / len(words) if words else 0.0
    number = bool(PAGE_NUMBER.match(line))
    f = [
        ("number", number), ("place", place, top, repeated), ("repeated", repeated), ("caps", int(caps * 4), repeated), ("upper", s.isupper(), repeated), ("end", s[-1:] in ".,;:!?-" + _HYPHENS, repeated),
        ("mark", s[:1] in "#*->|•`" or s.startswith("//"), repeated), ("wide", min(4, int(4 * len(s) / max(width, 1))), repeated), ("words", min(8, len(words)), repeated), ("title", caps > 0.9 and len(words) >= 1 and s[-1:] not in ".,;:", repeated),
    ]
    return {c: [(c, x) for x in f] + [c] for c in ("body", "header", "page_number")}


class Editor:
    """What training gives: three sets of weights, the usual trigrams and what is read for what; and the lexicon.

    fixes: for the text at hand, what its words become, if that was found beforehand; the lexicon then has to hold the words at its line ends only.
    """

    def __init__(self, lexicon: dict, words: dict, joins: dict, lines: dict, tri: dict, table: list, fixes: dict | None = None):
        self.lexicon, self.words, self.joins, self.lines, self.tri, self.table, self.fixes = lexicon, Perceptron(words), Perceptron(joins), Perceptron(lines), tri, by_first(table), fixes

    def word(self, w: str) -> str:
        return fix_word(w, self.lexicon, self.words, self.tri, self.table) if self.fixes is None else self.fixes.get(w, w)

    def joins_at(self, left: str, mark: str, right: str) -> bool:
        a, b = _join_features(left, mark, right, self.lexicon)
        return self.joins.score(a) > self.joins.score(b)

    def furniture(self, text: str, repeated: set[str]) -> dict[int, str]:
        """Line index -> `header` or `page_number`."""
        lines = _lines(text)
        full = [i for i, x in enumerate(lines) if x.strip()]
        width = max((len(x.strip()) for x in lines), default=1)
        out = {}
        for i, place, line, top in edge_lines(text):
            key = line_key(line)
            if key and key in repeated and self._line(line, place, top, True, width) == "header":
                out[i] = "header"
        # A page number stands at the edge, with nothing but furniture beyond it.
        for order, top in ((full, True), (full[::-1], False)):
            for i in order[: EDGE + 1] if len(full) > 1 else ():
                if i not in out and PAGE_NUMBER.match(lines[i]) and self._line(lines[i], 0, top, False, width) == "page_number":
                    out[i] = "page_number"
                if i not in out:
                    break
        return out

    def _line(self, *args) -> str:
        f = _line_features(*args)
        return max(sorted(f), key=lambda c: self.lines.score(f[c]))

    def repair(self, text: str, repeated: set[str]) -> tuple[list[str], str]:
        """The kinds of damage of a chunk, and its text as continuous paragraphs."""
        noise = set()
        lines = _lines(text)
        out = self.furniture(text, repeated)
        noise.update(out.values())
        # Furniture is read for damage as well before it goes.
        for i, kind in out.items():
            if kind == "header" and any(self.word(w) != w for w in _WORD.findall(lines[i])):
                noise.add("misread")
        body = "\n".join(x for i, x in enumerate(lines) if i not in out)

        def join(m: re.Match) -> str:
            if not self.joins_at(m[1], m[2], m[3]):
                return m[0]
            noise.add("hyphenation")
            return m[1] + m[3] + "\n"

        body = re.sub(rf"{_BREAK.pattern}(\S*)[ \t]*\n?", lambda m: (join(m)[:-1] + m[4] + "\n") if self.joins_at(m[1], m[2], m[3]) else m[0], body)

        def word(m: re.Match) -> str:
            new = self.word(m[0])
            if new != m[0]:
                noise.add("misread")
            return new

        fixed = []
        for line in body.split("\n"):
            s = line.strip()
            fixed.append(line if s.startswith(("|", "    def ", "```", "$ ")) and s.count("|") > 1 else _WORD.sub(word, line))
        if not noise:
            return [], text
        paras, cur = [], []
        for line in fixed:
            if not line.strip() or (line[:1] in " \t" and cur and not cur[-1].startswith(("-", "*"))) or re.match(r"\s*(?:[-*•#>|]|\d+[.)])\s", line):
                if cur:
                    paras.append(" ".join(cur))
                cur = []
            if line.strip():
                cur.append(line.strip())
        if cur:
            paras.append(" ".join(cur))
        return sorted(noise), "\n\n".join(paras)


# -- training
def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n) over all texts, words broken over lines put together: words of letters, and besides those with digits or signs among them."""
    t = F.lower(F.regexp_replace("text", rf"(\p{{L}})[{_HYPHENS}][ \t]*\r?\n[ \t]*(\p{{L}})", "$1$2"))
    mixed = F.filter(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}|!$@]*[\p{L}\p{N}]"), F.lit(0)), lambda w: w.rlike(r"\p{L}") & w.rlike(r"[^\p{L}]"))
    w = chunks.where("text is not null").select(F.explode(F.concat(F.split(t, r"[^\p{L}]+"), mixed)).alias("word"))
    return w.where(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n"))


def damage(word: str, rng: random.Random, table: list = CONFUSIONS[:16]) -> str | None:
    """The word with one place misread, or None if nothing in it can be."""
    low = word.lower()
    places = [(i, read, meant) for read, meant in table for i in range(len(low) - len(meant) + 1) if low.startswith(meant, i)]
    if not places:
        return None
    i, read, meant = rng.choice(places)
    seg = word[i : i + len(meant)]
    return word[:i] + (read.upper() if seg.isupper() and len(word) > 1 and word.isupper() else read) + word[i + len(meant) :]


def learned_confusions(counts: DataFrame) -> list[tuple[str, str]]:
    """(read, meant) pairs of one or two characters that the corpus itself shows, most usual first.

    Words are brought together by what is left when one or two characters are taken out. Where the most frequent word of such a
    group is PAIR_RATIO times as frequent as another, the characters taken out are counted as read and meant; pairs found at PAIRS
    words or more are no chance. At most as many rows come back as there are pairs of characters.
    """

    def one(r: dict) -> list[tuple]:
        w = r["word"]
        return [(w[:i] + "\0" + w[i + k :], w[i : i + k], r["n"]) for k in (1, 2) for i in range(len(w) - k + 1)]

    k = map_rows(counts.where(F.length("word") >= PAIR_LETTERS), "key string, piece string, n long", one)
    top = k.groupBy("key").agg(F.max(F.struct("n", "piece")).alias("m"), F.count("*").alias("c")).where("c > 1").select("key", F.col("m.n").alias("top"), F.col("m.piece").alias("meant"))
    p = k.join(top, "key").where((F.col("piece") != F.col("meant")) & (F.col("top") >= PAIR_RATIO * F.col("n"))).select(F.col("piece").alias("read"), "meant")
    # A longer pair that begins or ends alike is a shorter one seen again.
    p = p.where("left(read, 1) <> left(meant, 1) and right(read, 1) <> right(meant, 1)")
    found = p.groupBy("read", "meant").agg(F.count("*").alias("n")).where(F.col("n") >= PAIRS).orderBy(F.desc("n"), "read", "meant").collect()
    return [(r.read, r.meant) for r in found]


def train(texts: list[str], lexicon: dict, table: list | None = None, seed: int = 11) -> tuple[dict, dict, dict, dict, list]:
    """Weights of the character editor, the line joiner and the furniture classifier, from clean texts damaged on purpose, with the trigrams and the table of operations."""
    rng = random.Random(seed)
    common_reads = CONFUSIONS[:16]
    table = list(dict.fromkeys([*(table or ()), *CONFUSIONS]))
    usual = [x for x in table if x in common_reads or x not in CONFUSIONS]
    first = by_first(table)
    words, joins, lines = Perceptron(), Perceptron(), Perceptron()
    vocab = [w for t in texts for w in _WORD.findall(t)]
    tri = dict(trigrams({*lexicon, *(w.lower() for w in vocab if w.isalpha())}))
    rng.shuffle(vocab)
    vocab = vocab[:60_000]
    common = sorted(lexicon, key=lambda w: (-lexicon[w], w))[:4000]
    for _ in range(EPOCHS):
        for w in vocab[:: max(1, len(vocab) // 15_000)] + common:
            known = w.lower() in lexicon
            bad = damage(w, rng, usual) if rng.random() < 0.4 else None
            seen, gold = bad or w, w.lower()
            if bad and (bad.lower() in lexicon or not known and not any(c.isdigit() for c in bad)):
                continue
            # Each character has its right operation: the one that gives the word back, or to be kept.
            at: dict = defaultdict(list)
            for e in edits(seen, first):
                at[e[0]].append(e)
            right = [e for e in (x for v in at.values() for x in v) if e[3] == gold]
            if bad and not right:
                continue
            for i, ops in at.items():
                own = [e for e in ops if e[3] == gold] if bad else []
                if bad and not own and any(e[3] == gold for e in ops):
                    continue
                words.step()
                keep = _keep_features(seen, i, lexicon, tri)
                good = [_edit_features(seen, e, lexicon, tri) for e in own] or [keep]
                wrong = [_edit_features(seen, e, lexicon, tri) for e in ops if e[3] != gold] + ([keep] if own else [])
                if wrong:
                    g, x = max(good, key=words.score), max(wrong, key=words.score)
                    if words.score(g) < words.score(x) + MARGIN:
                        words.update(g, x)
        for w in rng.sample(vocab, min(6000, len(vocab))):
            if len(w) < 5 or not w.isalpha():
                continue
            if rng.random() < 0.75:
                k = rng.randint(2, len(w) - 2)
                left, right, gold = w[:k], w[k:], True
            else:
                left, right, gold = rng.choice(common or vocab), rng.choice(common or vocab), False
                if (left + right).lower() in lexicon:
                    continue
            mark = rng.choice(_HYPHENS[:4]) if gold else "-"
            joins.step()
            a, b = _join_features(left, mark, right, lexicon)
            if (joins.score(a) > joins.score(b)) != gold:
                joins.update(*((a, b) if gold else (b, a)))
        for t in rng.sample(texts, min(600, len(texts))):
            page = [x for x in _lines(t) if x.strip()][:40]
            flat = " ".join(x.strip() for x in page)
            width = rng.randint(40, 80)
            wrapped = re.findall(rf".{{1,{width}}}(?:\s+|$)", flat) or page
            body = [x.strip() for x in (wrapped if rng.random() < 0.7 or len(page) < 2 else page)]
            if len(body) < 2:
                continue
            title = " ".join(rng.choice(common or ["page"]).capitalize() for _ in range(rng.randint(2, 4)))
            title = rng.choice([title, title.upper(), f"{title} | Part {rng.randint(1, 9)} | {rng.choice(common or ['page']).capitalize()}", f"{title}    Rev. {rng.randint(1, 9)}", f"{title} - {rng.randint(1, 99)}"])
            n = rng.randint(1, 30)
            number = rng.choice([str(n), f"- {n} -", f"[{n}]", f"Page {n} of {n + 9}", f"p. {n}", f"{n} / {n + 3}", " " * 30 + str(n), rng.choice("ii iii iv v vi vii viii ix x xi xii".split())])
            w = max(map(len, body))
            cases = [(title, rng.randint(0, 1), rng.random() < 0.5, True, "header"), (number, rng.randint(0, 1), rng.random() < 0.5, False, "page_number")]
            cases += [(body[0], 0, True, rng.random() < 0.5, "body"), (body[-1], 0, False, rng.random() < 0.5, "body"), (body[len(body) // 2], 2, True, rng.random() < 0.3, "body"), ("# " + title, 0, True, True, "body"), (f"| {title} | {n} |", 0, False, True, "body"), (title, 0, True, False, "body")]
            for line, place, top, rep, gold in cases:
                lines.step()
                f = _line_features(line, place, top, rep, w)
                got = max(sorted(f), key=lambda c: lines.score(f[c]))
                if got != gold:
                    lines.update(f[gold], f[got])
    return words.finish(), joins.finish(), lines.finish(), tri, table


def known_words(counts: DataFrame, table: dict) -> DataFrame:
    """(word, n) of the words that occur LEAST_COUNT times, but those that are a much rarer misreading of another one."""
    known = counts.where(F.col("n") >= LEAST_COUNT)
    e = map_rows(known, "word string, n long, other string", lambda r: [(r["word"], r["n"], x[3]) for x in edits(r["word"], table)])
    j = e.join(known.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    rarer = F.when(F.length("word") < 5, RARER).otherwise(RARER_LONG)
    return known.join(j.where(F.col("m") >= rarer * F.col("n")).select("word").dropDuplicates(), "word", "left_anti")


def fit(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, tuple]:
    """(known words with their counts, what an Editor takes). Counts cover all texts; training uses a bounded sample of chunks that show no trace of a page.

    docs.kind is a hint only, so a chunk is clean if its document is not called a scan and no line ends in a hyphen or is a page number.
    """
    counts = durable(word_counts(chunks))
    table = list(dict.fromkeys([*learned_confusions(counts), *CONFUSIONS]))
    known = durable(known_words(counts.where(F.col("word").rlike(r"^\p{L}+$")), by_first(table)))
    lexicon = {r.word: r.n for r in known.orderBy(F.desc("n"), "word").limit(TRAINING_WORDS).collect()}
    scans = docs.where(F.lower("kind").isin("pdf", "image")).select(F.col("id").alias("doc_id")).dropDuplicates()
    clean = chunks.where("text is not null").where(~F.col("text").rlike(rf"[{_HYPHENS}][ \t]*[\r\n]|(?m)^\W*\d+\W*$"))
    clean = clean.join(scans, "doc_id", "left_anti")
    sample = [r.text for r in clean.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(TRAINING_CHUNKS).select(F.left("text", F.lit(TRAINING_LETTERS)).alias("text")).collect()]
    return known, train(sample, lexicon, table)


def word_fixes(words: DataFrame, known: DataFrame, model) -> DataFrame:
    """(word, fixed) of the words that change. words: one column, each once. model: a broadcast of what an Editor takes.

    What each operation would give is looked up among the known words by a join, so their number has no bound; one operation a
    round is carried out, until no word changes.
    """
    cur = words.select("word", F.col("word").alias("form"), F.array("word").alias("seen"))
    table = by_first(model.value[4])
    done = None
    while True:
        look = map_rows(cur.select("form").dropDuplicates(), "form string, low string", lambda r: [(r["form"], x) for x in {r["form"].lower(), *(e[3] for e in edits(r["form"], table))}])
        counts = look.join(known.withColumnRenamed("word", "low"), "low").groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("low", "n"))).alias("counts"))
        holder: dict = {}

        def one(r: dict) -> list[tuple]:
            m = holder.get("m")
            if m is None:
                w, _, _, tri, pairs = model.value
                m = holder["m"] = Perceptron(w), tri, by_first(pairs)
            new = next_form(r["form"], dict(r["counts"] or ()), *m)
            return [] if new is None or new in r["seen"] else [(r["word"], new, [*r["seen"], new])]

        nxt = durable(map_rows(cur.join(counts, "form", "left"), "word string, form string, seen array<string>", one))
        if nxt.isEmpty():
            break
        done = nxt if done is None else done.join(nxt, "word", "left_anti").unionByName(nxt)
        cur = nxt
    done = cur.limit(0) if done is None else done
    return done.select("word", F.col("form").alias("fixed"))


@lru_cache(maxsize=1 << 18)
def _editable(word: str, reads: tuple) -> bool:
    """Whether any operation is possible in a word."""
    low = word.lower()
    return len(word) > 1 and any(x in low for x in reads)


def looked_up(text: str, reads: tuple) -> tuple[set[str], set[str]]:
    """The words of a text that may be misread, broken ones put together, and the words at its line breaks, in small letters."""
    body = "\n".join(_lines(text))
    ends = {x.lower() for m in _BREAK.finditer(body) for x in (m[1], m[3], m[1] + m[3])}
    words = set(_WORD.findall(body))
    if ends:
        words.update(_WORD.findall(_BREAK.sub(lambda m: m[1] + m[3], body)))
    return {w for w in words if _editable(w, reads)}, ends


def repeated_edges(chunks: DataFrame) -> DataFrame:
    """(id, keys): edge lines of a chunk that stand at the edge of at least two chunks of its document."""

    def one(r: dict) -> list[tuple]:
        return [(r["id"], r["doc_id"], k) for k in {line_key(x) for _, _, x, _ in edge_lines(r["text"])} if k]

    e = map_rows(chunks.where("text is not null").select("id", "doc_id", "text"), "id string, doc_id string, key string", one).dropDuplicates()
    salted = e.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)))
    often = e.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("salt"))
    return salted.join(often, ["doc_id", "key", "salt"]).groupBy("id").agg(F.collect_set("key").alias("keys"))


def repaired_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, doc_id, idx, noise, text): each chunk with its kinds of damage and its repaired text.

    Defined results: null text gives no noise and null text; empty text stays empty; a chunk without damage keeps its text; a
    chunk given twice gives one row; whole texts are read; running titles need two chunks of one document (null doc_id is one document).
    """
    c = chunks.select("id", F.coalesce("doc_id", F.lit("\u0000")).alias("doc_id"), "idx", "text").dropDuplicates(["id"])
    known, parts = fit(chunks, docs)
    model = chunks.sparkSession.sparkContext.broadcast(parts)  # weights, trigrams and pairs of characters; no list of words

    reads = tuple(sorted({read for read, _ in parts[4]}))

    def needs(r: dict) -> list[tuple]:
        return [(r["id"], w, k) for k, ws in enumerate(looked_up(r["text"], reads)) for w in ws]

    need = durable(map_rows(c.where("text is not null").select("id", "text"), "id string, word string, at_end int", needs))
    fixes = durable(word_fixes(need.where("at_end = 0").select("word").dropDuplicates(), known, model))
    of_words = need.where("at_end = 0").join(fixes, "word").select("id", "word", "fixed", F.lit(0).cast("long").alias("n"))
    of_ends = need.where("at_end = 1").join(known, "word").select("id", "word", F.lit(None).cast("string").alias("fixed"), "n")
    look = of_words.unionByName(of_ends).groupBy("id").agg(F.collect_list(F.struct("word", "fixed", "n")).alias("look"))  # words of one chunk
    holder: dict = {}

    def one(r: dict) -> list[tuple]:
        m = holder.get("m")
        if m is None:
            m = holder["m"] = Editor({}, *model.value)
        if r["text"] is None:
            return [(r["id"], r["doc_id"], r["idx"], [], None)]
        m.fixes = {x["word"]: x["fixed"] for x in r["look"] or () if x["fixed"] is not None}
        m.lexicon = {x["word"]: x["n"] for x in r["look"] or () if x["fixed"] is None}
        noise, text = m.repair(r["text"], set(r["keys"] or ()))
        return [(r["id"], r["doc_id"], r["idx"], noise, text)]

    d = c.join(repeated_edges(c), "id", "left").join(look, "id", "left")
    out = map_rows(d, "id string, doc_id string, idx int, noise array<string>, text string", one)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != "\u0000", F.col("doc_id")))
