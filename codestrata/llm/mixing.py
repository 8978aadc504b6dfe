"""Mixing sources to target weights."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from codestrata.llm import tokenization
from codestrata.session import durable, ship

#: Hashed features of the classifier, and bins of each level of the final rounding.
FEATURES, BINS = 1 << 13, 4096
#: The gradient ends when no domain total moves by this share of its target any more; after so many rounds it is given up with an error.
TOLERANCE, MOST_ROUNDS = 1e-4, 400

_WORD = re.compile(r"[^\W\d_]{2,24}")


def features(text: str | None, lang: str | None, project: str | None, path: str | None) -> list[int]:
    """Distinct hashed features: words of the whole text, language, project, and the parts of the path."""
    out = {"w" + w.lower() for w in _WORD.findall(text or "")}
    if lang:
        out.add("l" + lang.strip().lower())
    if project:
        out.add("p" + project.strip().lower())
    for k, part in enumerate((path or "").replace("\\", "/").split("/")[:-1]):
        out.add(f"d{k}{part.lower()}")
        out.add(f"e{k}{part.lower()}")  # a second bucket, as what the path says weighs more
    return [xxhash.xxh32_intdigest(x) % FEATURES for x in out]


def _counts(labelled: DataFrame) -> pd.DataFrame:
    """(source, feature, n) over all labelled documents: at most FEATURES rows per source. Feature -1 counts documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            acc: dict = {}
            for src, *cols in b[["source", "text", "lang", "project", "path"]].itertuples(index=False):
                for f in [-1, *features(*cols)]:
                    acc[src, f] = acc.get((src, f), 0) + 1
            yield pd.DataFrame([(s, f, n) for (s, f), n in acc.items()], columns=["source", "feature", "n"])

    c = labelled.select("source", "text", "lang", "project", "path").mapInPandas(run, "source string, feature int, n long")
    return c.groupBy("source", "feature").agg(F.sum("n").alias("n")).toPandas()


def fit_posteriors(labelled: DataFrame, sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a Bernoulli-style naive Bayes over the sources: (log odds by feature, log priors)."""
    c = _counts(labelled)
    w, prior = np.zeros((FEATURES, len(sources))), np.full(len(sources), -1e9)
    for k, s in enumerate(sources):
        own = c[c.source == s]
        docs = float(own.loc[own.feature == -1, "n"].sum())
        if not docs:
            continue
        n = np.zeros(FEATURES)
        f = own[own.feature >= 0]
        n[f.feature.to_numpy()] = f.n.to_numpy()
        w[:, k], prior[k] = np.log((n + 0.1) / (docs + 1.0)), math.log(docs)
    return w, prior


def memberships(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """(doc_id, source, n_tokens, p): each document once, with its posterior over the target sources; and the targets in order.

    A document of a target source belongs to it wholly; one without a source gets the classifier's posterior; one of a source
    that no target names belongs to none. Null, empty and repeated rows weigh nothing or count once.
    """
    spark = documents.sparkSession
    ship(spark)
    goals = [(r.source, float(r.target_share or 0), int(r.max_repeats or 1)) for r in targets.where("source is not null").orderBy("source").collect()]
    names = [g[0] for g in goals]
    d = documents.select("doc_id", "text", "lang", "project", "path", F.nullif(F.btrim("source"), F.lit("")).alias("source")).dropDuplicates(["doc_id"])
    w, prior = fit_posteriors(d.where(F.col("source").isin(names) & F.col("text").isNotNull()), names) if names else (np.zeros((FEATURES, 0)), np.zeros(0))
    model = spark.sparkContext.broadcast((w, prior))  # FEATURES numbers per source
    index = {s: k for k, s in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenization.encoder()
        w, prior = model.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.iloc[at : at + 512]
                rows = []
                for r in b.itertuples(index=False):
                    n = len(tokenization.encode(enc, r.text))
                    p = np.zeros(len(index))
                    if r.source is None or r.source != r.source:
                        if n and len(index) and (prior > -1e8).any():
                            s = prior + w[features(r.text, r.lang, r.project, r.path)].sum(0)
                            e = np.exp(s - s.max())
                            p = e / e.sum()
                    elif r.source in index:
                        p[index[r.source]] = 1.0
                    rows.append((r.doc_id, r.source, n, p.tolist()))
                yield pd.DataFrame(rows, columns=["doc_id", "source", "n_tokens", "p"])

    out = d.select("doc_id", "source", "text", "lang", "project", "path").mapInPandas(run, "doc_id long, source string, n_tokens long, p array<double>")
    return durable(out), goals


def _rates(p: np.ndarray, start: np.ndarray, caps: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Document rates after all steps so far: each step moves along the gradient and is projected on [0, cap].

    The cap of a document of several memberships is their mean, and never more than that of the source it most belongs to.
    """
    cap = np.minimum(p @ caps, np.where(p.sum(1) > 0, caps[p.argmax(1)], 0)) if len(caps) else np.zeros(len(p))
    r = np.clip(p @ start, 0, cap)
    for step in history:
        r = np.clip(r - p @ step, 0, cap)
    return r


def fit_rates(members: DataFrame, goals: list[tuple], total: float | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(start, steps, wanted totals, available tokens) of nonnegative rates whose expected totals per source match the targets.

    Least squares over sources of the relative error, by projected gradient, preconditioned with the tokens at hand, until it stands
    still; if it never does, an error says so. Rates are a function of the memberships and the steps, so documents of equal
    memberships (all those of a known source) are one row of a table that is made once, and each round takes one vector back.
    total: tokens of the mix; by default the most that the repetition caps allow at the exact target shares.
    """
    k = len(goals)
    classes = durable(members.where("n_tokens > 0").groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")))
    caps, share = np.array([g[2] for g in goals], float), np.array([g[1] for g in goals], float)

    def sums(f) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros(k)
            for b in batches:
                if len(b) and k:
                    p = np.vstack(b.p.to_numpy())
                    acc += (f(p) * b.n_tokens.to_numpy()) @ p
            yield pd.DataFrame({"v": [acc.tolist()]})

        parts = classes.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("k", "v"))
        out = np.zeros(k)
        for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r.k] = r.v
        return out

    have = sums(lambda p: np.ones(len(p)))
    able = (have > 0) & (share > 0)
    goal = np.where(able, share, 0) / max(share[able].sum(), 1e-12)
    if total is None:
        total = float(np.min(caps[able] * have[able] / goal[able])) if able.any() else 0.0
    y = goal * total
    start = np.where(able, y / np.where(able, have, 1), 0)
    steps: list[np.ndarray] = []
    before = np.full(k, np.inf)
    while able.any():
        s = sums(lambda p: _rates(p, start, caps, steps))
        moved = np.abs(s - before) / np.where(y > 0, y, 1)
        if np.max(np.where(able, moved, 0)) < TOLERANCE:
            break
        if len(steps) >= MOST_ROUNDS:
            raise ArithmeticError(f"rates do not settle in {MOST_ROUNDS} rounds; totals still move by {np.max(moved):.2g} of their targets")
        before = s
        steps.append(np.where(able, (s - y) / np.where(able, have, 1), 0))
    return start, steps, y, have


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, list[tuple], np.ndarray]:
    """(doc_id, source, n_tokens, p, rate, repeats) of all documents, the targets, and the tokens at hand per source.

    Rates become whole numbers: the rate's floor, and one more below a cut of the document's hash. The cut of each source is found
    from token histograms over hash bins on two levels (bounded rows), so the total misses its target by about one document.
    """
    members, goals = memberships(documents, targets)
    start, steps, y, have = fit_rates(members, goals, total)
    caps = np.array([g[2] for g in goals], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.vstack(b.p.to_numpy()) if len(b) else np.zeros((0, len(goals)))
            r = _rates(p, start, caps, steps) if len(goals) else np.zeros(len(b))
            r = np.where(b.n_tokens.to_numpy() > 0, r, 0)
            yield b.assign(rate=r, main=p.argmax(1) if len(goals) else 0)

    d = members.mapInPandas(run, "doc_id long, source string, n_tokens long, p array<double>, rate double, main int")
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(BINS * BINS))
    d = durable(d.withColumn("low", F.floor(F.col("rate") + F.lit(1e-9))).withColumn("part", F.greatest(F.col("rate") - F.col("low"), F.lit(0.0))).withColumn("bin", F.floor(h / BINS)).withColumn("sub", F.pmod(h, F.lit(BINS))))
    # Expected tokens of the broken parts, to be met by documents below the cut.
    need = {r.main: r.need for r in d.groupBy("main").agg(F.sum(F.col("part") * F.col("n_tokens")).alias("need")).collect()}

    def cut(level: DataFrame, by: str, need: dict) -> tuple[dict, dict]:
        hist: dict = {}
        for r in level.where("part > 0").groupBy("main", by).agg(F.sum("n_tokens").alias("n")).collect():
            hist.setdefault(r.main, {})[r[by]] = r.n
        at, left = {}, {}
        for k, v in need.items():
            run_, own = 0, hist.get(k, {})
            at[k], left[k] = max(own, default=-1) + 1, 0.0
            for b in sorted(own):
                if run_ + own[b] > v:
                    at[k], left[k] = b, v - run_
                    break
                run_ += own[b]
        return at, left

    if not goals or not need:
        return d.withColumn("repeats", F.lit(0)), goals, have
    at, left = cut(d, "bin", need)
    as_map = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("main")]
    edge = d.where(F.col("bin") == as_map({k: int(v) for k, v in at.items()}))
    at2, _ = cut(edge, "sub", {k: float(v) + 0.5 for k, v in left.items()})
    b, s = as_map({k: int(v) for k, v in at.items()}), as_map({k: int(at2.get(k, 0)) for k in at})
    more = (F.col("part") > 1e-9) & ((F.col("bin") < b) | ((F.col("bin") == b) & (F.col("sub") < s)))
    return d.withColumn("repeats", (F.col("low") + more.cast("int")).cast("int")), goals, have


def mixed_documents(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, rate, repeats) of the documents that are used."""
    d, _, _ = mixture(documents, targets)
    return d.where("repeats > 0").select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), "repeats")


def reached_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share of all tokens, documents used, tokens at hand and taken.

    A source without documents reaches 0; the others then share its part in proportion.
    """
    d, goals, have = mixture(documents, targets)
    spark = documents.sparkSession
    got = d.where("repeats > 0").select("repeats", "n_tokens", F.posexplode("p").alias("k", "w")).where("w > 0")
    per = got.groupBy("k").agg(F.sum(F.col("w") * F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count_if(F.col("w") > 0.5).alias("n_used"), F.max(F.when(F.col("w") > 0.5, F.col("repeats"))).alias("most_repeats"))
    base = spark.createDataFrame([(k, *g, float(have[k])) for k, g in enumerate(goals)], "k int, source string, target_share double, max_repeats int, tokens_at_hand double")
    j = base.join(per, "k", "left").fillna({"tokens": 0.0, "n_used": 0, "most_repeats": 0})
    total = per.agg(F.sum("tokens")).first()[0] or 1.0
    return j.select("source", "target_share", F.round(F.col("tokens") / F.lit(total), 6).alias("reached_share"), "max_repeats", "most_repeats", "n_used", F.round("tokens_at_hand", 3).alias("tokens_at_hand"), F.round("tokens", 3).alias("tokens"))
