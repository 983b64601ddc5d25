"""URL filter: rules first, then the ratio of two character language models.

Rules are pairs of a host and a path's beginning; the longest that fits decides. The urls that rules decide are the
accepted and rejected examples of two variable-order Markov models over bytes: the probability of a byte is
interpolated (Witten-Bell) over contexts of 0 to ``ORDER`` bytes, as far back as a context was seen. A url's
score is the difference of its log-likelihoods under the two models, divided by its number of symbols and calibrated by
a logistic curve on examples that the models did not learn from.

All examples are counted, summed in Spark before and behind the shuffle. A pair of context and byte is kept when it
is at least a ``RESOLUTION``-th of all positions, so no order keeps more than ``RESOLUTION`` pairs and the model that
travels to tasks stays under (ORDER + 1) * RESOLUTION rows at any size of the input; rarer contexts fall back to
shorter ones, which is what makes the order variable.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, slices

#: Longest context in bytes; pairs that an order keeps at most; every FOLDS-th example is kept for calibration.
ORDER, RESOLUTION, FOLDS = 5, 1 << 17, 5
#: Symbols beside the bytes, in SYMBOL_BITS bits each.
START, END, SYMBOL_BITS = 256, 257, 9
UNIFORM = 1.0 / 257
#: Width of a histogram bin of score differences, for calibration.
BIN = 1 / 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, else nulls. Rules of one length: the one
    with the longer host, then in the order of their text. The list is part of the plan: for lists of up to some
    hundred rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0] + r[1])):  # the last that fits decides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def symbols(urls: list) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all urls, each between START and END, and each symbol's distance from its START."""
    parts = [np.frombuffer((u or "").encode(), np.uint8) for u in urls]
    sizes = np.array([len(p) + 2 for p in parts], np.int64)
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    out[first], out[first + sizes - 1] = START, END
    at = np.arange(len(out)) - np.repeat(first, sizes)
    inner = (at > 0) & (at < np.repeat(sizes, sizes) - 1)
    out[inner] = np.concatenate(parts) if parts else []
    return out, at


def codes(sym: np.ndarray, at: np.ndarray):
    """For each order: the places of the symbols with that much before them, and their codes. A code holds the symbol in
    its lowest bits, the context above it, the nearest symbol first."""
    place = np.flatnonzero(at > 0)
    code = sym[place]
    for k in range(ORDER + 1):
        if k:
            far = at[place] >= k
            place, code = place[far], code[far] | sym[place[far] - k] << (SYMBOL_BITS * k)
        yield k, place, code


@dataclass
class Model:
    """For each order the sorted codes with counts (accepted, rejected), and the sorted contexts with totals and numbers of
    different symbols in both models; then the calibration: p = 1 / (1 + exp(-(slope * difference + offset)))."""

    pairs: list
    contexts: list
    slope: float = 1.0
    offset: float = 0.0


def build(rows: list) -> Model:
    """From (order, code, accepted, rejected) rows as four arrays."""
    order, code, acc, rej = rows
    pairs, contexts = [], []
    for k in range(ORDER + 1):
        at = np.flatnonzero(order == k)
        at = at[np.argsort(code[at], kind="stable")]
        c, n = code[at], np.stack([acc[at], rej[at]], 1).astype(float).reshape(-1, 2)
        ctx, which = np.unique(c >> SYMBOL_BITS, return_inverse=True)
        total, kinds = np.zeros((len(ctx), 2)), np.zeros((len(ctx), 2))
        np.add.at(total, which, n)
        np.add.at(kinds, which, (n > 0).astype(float))
        pairs.append((c, n))
        contexts.append((ctx, total, kinds))
    return Model(pairs, contexts)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def differences(urls: list, pairs: list, contexts: list) -> np.ndarray:
    """Mean over a url's symbols (its end included) of log P(accepted) - log P(rejected)."""
    sym, at = symbols(urls)
    p = np.full((len(sym), 2), UNIFORM)
    for k, place, code in codes(sym, at):
        (keys, n), (ctx, total, kinds) = pairs[k], contexts[k]
        c, known = _find(ctx, code >> SYMBOL_BITS)
        place, code, c = place[known], code[known], c[known]  # a context not seen leaves the shorter one's probability
        i, seen = _find(keys, code)
        count = np.where(seen[:, None], n[i], 0.0) if len(keys) else 0.0
        room = total[c] + kinds[c]
        p[place] = np.where(room > 0, (count + kinds[c] * p[place]) / np.where(room > 0, room, 1), p[place])
    first = np.flatnonzero(at == 0)
    each = np.log(p[:, 0]) - np.log(p[:, 1])
    each[first] = 0
    return np.add.reduceat(each, first) / (np.diff([*first, len(sym)]) - 1) if len(first) else np.zeros(0)


def count(examples: DataFrame) -> DataFrame:
    """order, code, accepted, rejected over rows (url, good)."""
    def run(batches):
        for b in slices(batches, 2048):
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            sym, at = symbols(b.column(0).to_pylist())
            kind = good[np.cumsum(at == 0) - 1]
            for k, place, code in codes(sym, at):
                found, n = np.unique(code << 1 | kind[place], return_counts=True)
                yield {"order": np.full(len(found), k), "code": found >> 1, "accepted": n * (found & 1), "rejected": n * (1 - (found & 1))}

    return (map_arrow(examples.select("url", "good"), run, "order int, code long, accepted long, rejected long")
            .groupBy("order", "code").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))


def calibrate(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through a histogram of differences; both kinds weigh alike, and each
    side has one example's worth of doubt (Platt). Without examples of both kinds: the sign of the difference."""
    n, m = good.sum(), bad.sum()
    if not n or not m:
        return 1.0, 0.0
    w_good, w_bad = good / n, bad / m
    x, w = bins * BIN, w_good + w_bad
    t = (w_good * (n + 1) / (n + 2) + w_bad / (m + 2)) / w
    theta = np.zeros(2)
    feats = np.stack([x, np.ones(len(x))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(feats @ theta, -500, 500)))
        grad = feats.T @ (w * (p - t)) + 1e-6 * theta
        hess = (feats * (w * p * (1 - p))[:, None]).T @ feats + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        norm = np.abs(step).max()
        theta -= step * min(1.0, 10 / norm) if norm else 0
        if norm < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def train(examples: DataFrame) -> Model:
    """Fit on rows (url string, good boolean), all of them: every ``FOLDS``-th by crc32 of the url calibrates, the others
    are counted. Null urls count as empty; an empty table, or one kind alone, gives a model that still scores."""
    held = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % FOLDS == 0
    learn = count(examples.where(~held))
    total = learn.where("order = 0").agg(F.sum(F.col("accepted") + F.col("rejected")).alias("n")).first().n or 0
    kept = learn.where(F.col("accepted") + F.col("rejected") >= total / RESOLUTION).toArrow()
    model = build([kept.column(n).to_numpy() for n in ("order", "code", "accepted", "rejected")])
    # log-probabilities are bounded by the counts, so there are a few thousand bins at most
    told = examples.where(held).select("good", F.floor(difference(examples, model)(F.col("url")) / BIN).alias("bin"))
    hist = told.groupBy("bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas()
    model.slope, model.offset = calibrate(hist["bin"].to_numpy(float) + 0.5, hist["good"].to_numpy(float), hist["bad"].to_numpy(float))
    return model


def difference(df: DataFrame, model: Model):
    """A pandas UDF for ``differences``; the model's arrays travel once to each executor."""
    shared = df.sparkSession.sparkContext.broadcast((model.pairs, model.contexts))

    @F.pandas_udf("double")
    def fn(urls: pd.Series) -> pd.Series:
        out = [differences(urls.iloc[at:at + 1024].tolist(), *shared.value) for at in range(0, len(urls), 1024)]
        return pd.Series(np.concatenate(out) if out else [], index=urls.index, dtype=float)

    return fn


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict (allow or block), probability (that the url is
    accepted, by the models), difference.

    ``rules`` are (host, path, verdict). A url without a rule is allowed if its probability is at least a half. Null
    urls and urls without "://" have an empty host and path and no rule; the models read null as an empty text, others
    whole. Repeated rows are judged and counted each. Without examples of both kinds every url without a rule has a
    half or what the sign of the difference says. An empty table gives no rows; other columns are not read."""
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    src = src.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = src.withColumn("rule", rule).withColumn("ruled", verdict)
    model = train(ruled.where("ruled is not null").select("url", (F.col("ruled") == "allow").alias("good")))
    told = ruled.withColumn("difference", difference(pages, model)(F.col("url")))
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("difference") + F.lit(model.offset))))
    judged = F.coalesce("ruled", F.when(F.col("probability") >= 0.5, "allow").otherwise("block"))
    return told.withColumn("probability", p).select(F.col("id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), "probability", "difference")
