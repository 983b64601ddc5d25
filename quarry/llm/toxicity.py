"""Toxicity by maximum-scoring segments of token log-odds.

*Weights.* Log-odds of a word between toxic and clean documents under an informative Dirichlet prior: the prior of a
word comes from its first four and five letters, theirs from the corpus, so inflected forms that were never seen
take their stem's weight. Only significant weights (by z) are kept; other words lose a constant, so a clean text
drifts down.
*Segments.* A linear scan finds all maximal scoring segments of a text (the disjoint runs of highest total score).
*Calibration.* The best score of a clean text of n words follows an extreme-value law in score - ln(n) / rate; its
two constants are fitted on clean documents that the weights have not seen. A segment's surprise is minus the
log of its tail probability; a document's score is a logistic function of its largest surprise and of the sum over
its significant segments.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, slices, stored

#: Bound of the labelled sample (picked by hash) and of the model's entries.
MAX_LABELLED, MAX_ENTRIES = 60_000, 20_000
PRIOR, DRIFT, MOST = 50.0, 0.5, 8.0
#: Least z of a word and of a stem.
WORD_Z, STEM_Z = 3.0, 2.33
#: Tail probability under which a segment counts as significant.
SIGNIFICANT = 0.01
STEMS = (5, 4)


@dataclass
class Weights:
    words: dict[str, float]
    stems: dict[str, float]

    def of(self, word: str) -> float:
        w = self.words.get(word)
        for n in STEMS:
            if w is None and len(word) >= n:
                w = self.stems.get(word[:n])
        return -DRIFT if w is None else w


def _tokens():
    import re

    return re.compile(r"[^\W\d_]+").findall


def _odds(y1, y0, n1, n0, a1, a0):
    """Log-odds ratio and its z under Dirichlet pseudo-counts a1, a0 (all arrays or numbers)."""
    t1, t0 = n1 + PRIOR, n0 + PRIOR
    p, q = y1 + a1, y0 + a0
    delta = np.log(p / (t1 - p)) - np.log(q / (t0 - q))
    return delta, delta / np.sqrt(1 / p + 1 / q)


def learn(texts: DataFrame) -> Weights:
    """Weights from a table (text, toxic). Counts are of documents, so a word repeated in one text counts once; and
    of a word's toxic documents only as many count as it has different preceding words (told apart by 64 hashes),
    so near copies of one text don't make its words look toxic."""
    def run(batches):
        import zlib

        find, ctx = _tokens(), {}
        seen: dict[tuple[str, int], list[int]] = {}

        def rows():
            return {"token": [k[0] for k in seen], "toxic": [k[1] for k in seen], "n": [v[0] for v in seen.values()],
                    "before": [v[1] - (1 << 64) * (v[1] >> 63) for v in seen.values()]}

        for b in slices(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = find(t.lower())
                masks: dict[str, int] = {"": 1}  # documents
                last = 0
                for w in words:
                    masks[w] = masks.get(w, 0) | 1 << last
                    last = ctx.get(w)
                    if last is None:
                        last = ctx[w] = zlib.crc32(w.encode()) & 63
                for w in [w for w in masks if len(w) >= min(STEMS)]:
                    for n in STEMS:
                        if len(w) >= n:
                            masks["^" + w[:n]] = masks.get("^" + w[:n], 0) | masks[w]
                for g, m in masks.items():
                    v = seen.get((g, y))
                    if v is None:
                        seen[g, y] = [1, m]
                    else:
                        v[0] += 1
                        v[1] |= m
            if len(ctx) > 200_000:
                ctx.clear()
            if len(seen) > 120_000:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    counts = (map_arrow(texts.select("text", F.col("toxic").cast("int")), run, "token string, toxic int, n long, before long")
              .groupBy("token").agg(F.coalesce(F.sum(F.expr("if(toxic = 1, n, 0)")), F.lit(0)).alias("y1"),
                                    F.coalesce(F.sum(F.expr("if(toxic = 0, n, 0)")), F.lit(0)).alias("y0"),
                                    F.bit_count(F.bit_or(F.expr("if(toxic = 1, before, 0)"))).cast("long").alias("before"))
              .select("token", "y0", F.expr("if(token = '' or before >= 48, y1, least(y1, before))").alias("y1")))
    counts = stored(counts, "tokens")
    total = counts.where("token = ''").first()
    if total is None or not total.y1 or not total.y0:
        return Weights({}, {})
    n1, n0 = float(total.y1), float(total.y0)
    # only entries seen in toxic documents clearly more often can gain a significant weight
    best = (counts.where(f"token <> '' and y1 >= 3 and y1 * {n0} > 2 * y0 * {n1}")
            .orderBy((F.col("y1") / n1 / (F.col("y0") + 1)).desc(), "token").limit(4 * MAX_ENTRIES).toPandas())
    stem = best.token.str.startswith("^")
    share = n1 / (n1 + n0)
    s = best[stem]
    d, z = _odds(s.y1.to_numpy(float), s.y0.to_numpy(float), n1, n0, 0.5 * share, 0.5 * (1 - share))
    stems = {t[1:]: (float(x), float(k)) for t, x, k in zip(s.token, d, z, strict=True)}
    ratio = {t: math.exp(x) * n1 / (math.exp(x) * n1 + n0) for t, (x, _) in stems.items()}  # toxic share of the stem's documents
    w = best[~stem]
    of = np.array([next((ratio[t[:n]] for n in STEMS if t[:n] in ratio), share) for t in w.token], float)
    d, z = _odds(w.y1.to_numpy(float), w.y0.to_numpy(float), n1, n0, 1.0 * of, 1.0 * (1 - of))
    words = sorted(((float(k), t, float(x)) for t, x, k in zip(w.token, d, z, strict=True) if k >= WORD_Z), reverse=True)
    keep = {t: min(x, MOST) - DRIFT for _, t, x in words[:MAX_ENTRIES] if x > DRIFT}
    kept_stems = sorted(((k, t, x) for t, (x, k) in stems.items() if k >= STEM_Z and x > 2.0), reverse=True)
    return Weights(keep, {t: min(x, MOST) - DRIFT for _, t, x in kept_stems[:MAX_ENTRIES]})


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a sequence in which the listed positions score as
    given and all others ``-drift``; positions rise. Linear time (Ruzzo & Tompa 1999): a stack of candidate segments, each
    with the running total before and at its end and a link to the nearest one that began lower, so the search for
    what a new segment can be joined to skips the others."""
    # total before, total at the end, first, last, place of the nearest entry below with a smaller total before (-1: none)
    stack: list[tuple] = []
    total, at = 0.0, 0
    for i, s in scores:
        total -= drift * (i - at)
        at = i + 1
        left, right, first = total, total + s, i
        total = right
        if s <= 0:
            continue
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, i, j))
                break
            # the entry, all behind it and the new segment become one
            left, _, first, _, below = stack[j]
            del stack[j:]
            j = below
    return [(r - a, f, e) for a, r, f, e, _ in stack]


@dataclass
class Calibration:
    rate: float
    shift: float
    coef: tuple[float, float, float]

    def surprise(self, score: float, n_words: int) -> float:
        """-log10 of the chance that a clean text of so many words holds a segment of this score."""
        x = self.rate * (score - self.shift) - math.log(max(n_words, 1))
        tail = math.exp(-x) if x > 20 else -math.expm1(-math.exp(-x)) if x > -5 else 1.0
        return -math.log10(max(tail, 1e-12))

    def score(self, best: float, total: float) -> float:
        a, b, c = self.coef
        z = a + b * best + c * total
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def passages(text: str | None, weights: Weights, calibration: Calibration | None, find, cache: dict) -> tuple[list, int]:
    """The text's segments (score, first word, last word) and its number of words."""
    words = find((text or "").lower())
    get = cache.get
    hits = []
    for i, w in enumerate(words):
        s = get(w)
        if s is None:
            s = cache[w] = weights.of(w)
        if s > 0:
            hits.append((i, s))
    return segments(hits), len(words)


def _evidence(segs, n_words: int, cal: Calibration) -> tuple[float, float]:
    bits = [cal.surprise(s, n_words) for s, _, _ in segs]
    return max(bits, default=0.0), min(sum(b for b in bits if b > -math.log10(SIGNIFICANT)), 60.0)


def calibrate(scored: pd.DataFrame) -> Calibration:
    """From (toxic, n_words, scores of the segments) of documents that the weights have not seen."""
    clean = scored[scored.toxic == 0]
    top = np.array([max(s, default=0.0) for s in clean.scores])
    some = top > 0
    ln_n = np.log(clean.n_words.clip(lower=1).to_numpy(float))
    # method of moments on the texts with any segment; few or none: one word of the lowest weight a thousand texts
    if some.sum() >= 20 and top[some].std() > 0:
        rate = math.pi / (top[some].std() * math.sqrt(6))
        rate = min(max(rate, 0.5), 3.0)
    else:
        rate = 1.0
    # share of clean texts that reach half a point: sets the shift so that the tail matches it
    mean = float((top - ln_n / rate).mean()) if len(top) else 0.0
    shift = mean - 0.5772 / rate
    cal = Calibration(rate, shift, (0.0, 0.0, 0.0))
    feats = np.array([(1.0, *_evidence([(s, 0, 0) for s in r.scores], int(r.n_words), cal)) for r in scored.itertuples()])
    y = scored.toxic.to_numpy(float)
    w = np.zeros(3)
    for _ in range(60):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(feats @ w, -50, 50)))
        grad = feats.T @ (p - y) + 0.1 * w
        hess = (feats * (p * (1 - p))[:, None]).T @ feats + 0.1 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Calibration(rate, shift, tuple(map(float, w)))


@dataclass
class Model:
    weights: Weights
    calibration: Calibration


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most MAX_LABELLED labelled documents, picked by a hash of the id; equal texts count once. The
    calibration is fitted on one half with weights from the other; the weights kept are those of both. Null labels, texts and ids are left out. Without
    documents of both labels every text scores 0."""
    # bounded: MAX_LABELLED rows of two numbers
    sample = (labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
              .where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("id")).limit(MAX_LABELLED))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    labelled = src.join(F.broadcast(sample), "id")
    first = labelled.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("id", "toxic"), "id").alias("x"))
    sample = stored(first.select("x.id", "x.toxic"), "sample")  # no more rows than before
    labelled = src.join(F.broadcast(sample), "id")
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0
    weights = learn(labelled.where(half))

    def run(batches):
        find, cache = _tokens(), {}
        for b in batches:
            if len(cache) > 200_000:
                cache.clear()
            got = [passages(t, weights, None, find, cache) for t in b.column(0).to_pylist()]
            yield {"toxic": b.column(1), "n_words": [n for _, n in got], "scores": [[s for s, _, _ in g] for g, _ in got]}

    scored = map_arrow(labelled.where(~half).select("text", "toxic"), run, "toxic int, n_words long, scores array<double>").toPandas()
    if not len(scored) or scored.toxic.nunique() < 2:
        return Model(weights, Calibration(1.0, 0.0, (-50.0, 0.0, 0.0)))
    return Model(learn(labelled), calibrate(scored))


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, passages (first and last word, score, surprise, words of every
    significant segment). Null and empty texts have no passage; an empty table gives no rows; other columns are not
    read."""
    m = model  # bounded by MAX_ENTRIES; travels with the task's code

    def run(batches):
        find, cache = _tokens(), {}
        least = -math.log10(SIGNIFICANT)
        for b in slices(batches):
            scores, found = [], []
            for t in b.column(1).to_pylist():
                segs, n = passages(t, m.weights, m.calibration, find, cache)
                scores.append(m.calibration.score(*_evidence(segs, n, m.calibration)))
                big = [(f, e, s, x) for s, f, e in segs if (x := m.calibration.surprise(s, n)) > least]
                words = find(t.lower()) if big else []
                found.append([{"first": f, "last": e, "score": s, "surprise": x, "text": " ".join(words[f:e + 1])} for f, e, s, x in big])
            if len(cache) > 200_000:
                cache.clear()
            yield {"doc_id": b.column(0), "score": scores, "passages": found}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
                     "doc_id long, score double, passages array<struct<first int, last int, score double, surprise double, text string>>")


def scorer(model: Model):
    """A pandas UDF from texts to scores, for filters that keep all columns."""
    m = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        find, cache = _tokens(), {}
        out = []
        for t in texts:
            if len(cache) > 200_000:
                cache.clear()
            segs, n = passages(t, m.weights, m.calibration, find, cache)
            out.append(m.calibration.score(*_evidence(segs, n, m.calibration)))
        return pd.Series(out, dtype="float64")

    return score
