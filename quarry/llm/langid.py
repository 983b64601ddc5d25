"""Language identification with a byte convolutional network.

Filters of width 2, 3 and 4 over byte classes, max pooling over a fixed-length window, softmax. Trained in numpy on
a bounded sample of labelled text; every window of every text is scored. For speed the filters are summed into
tables by byte pair, so a window costs two table look-ups a byte for all filters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS, FILTERS, CLASSES = (2, 3, 4), 8, 128
#: Bounds of the training sample: documents of a language, documents in all, windows of a document.
SAMPLE_PER_LANGUAGE, SAMPLE_ALL, SAMPLE_WINDOWS = 1500, 100_000, 2
#: Parts that a language's documents are picked from.
PARTS = 1 << 53

_CLASS = np.zeros(256, "uint8")  # 0 white space and padding, 1 other ASCII, 2 digits, 3-28 letters, 29-127 the rest
_CLASS[33:127] = 1
_CLASS[48:58] = 2
for _i in range(26):
    _CLASS[65 + _i] = _CLASS[97 + _i] = 3 + _i
_CLASS[128:] = 29 + np.arange(128) % 99


def _windows(text: bytes) -> np.ndarray:
    """All windows of a text, as byte classes; the last is padded and repeats nothing."""
    n = -(-len(text) // WINDOW) or 1
    out = np.zeros(n * WINDOW, "uint8")
    out[:len(text)] = _CLASS[np.frombuffer(text, "uint8")]
    return out.reshape(n, WINDOW)


class ByteNet:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype("float32") for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, "float32")
        self.dense = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))).astype("float32")
        self.out_bias = np.zeros(len(langs), "float32")

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By byte pair (i, i+1): all filters' first two taps; by pair (i+2, i+3): the taps left."""
        c2, c3, c4 = self.conv
        first = np.concatenate([c[0][:, None] + c[1][None] for c in (c2, c3, c4)], 2)
        rest = np.concatenate([np.zeros((CLASSES, CLASSES, FILTERS)), np.broadcast_to(c3[2][:, None], (CLASSES, CLASSES, FILTERS)),
                               c4[2][:, None] + c4[3][None]], 2)
        n = len(WIDTHS) * FILTERS
        return first.reshape(-1, n).astype("float32"), rest.reshape(-1, n).astype("float32")

    def activations(self, x: np.ndarray, tables) -> np.ndarray:
        """Of every position whose four bytes lie in the window: [windows, positions, filters]."""
        x = x.astype("int32")
        pair = x[:, :-1] * CLASSES + x[:, 1:]
        a = tables[0][pair[:, :-2]]
        a += tables[1][pair[:, 2:]]
        return a

    def log_probs(self, x: np.ndarray, tables) -> np.ndarray:
        out = []
        for at in range(0, len(x), 128):  # small blocks stay in the processor's cache
            pooled = np.maximum(self.activations(x[at:at + 128], tables).max(1) + self.bias, 0)
            z = pooled @ self.dense + self.out_bias
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.bias, self.dense, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                i = order[at:at + batch]
                b = x[i].astype("int64")
                a = self.activations(b, self.tables())
                best = a.argmax(1)  # [batch, filters]
                pooled = np.maximum(np.take_along_axis(a, best[:, None], 1)[:, 0] + self.bias, 0)
                z = pooled @ self.dense + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                back = (p @ self.dense.T) * (pooled > 0)
                grads = [np.zeros_like(c) for c in self.conv] + [back.sum(0), pooled.T @ p, p.sum(0)]
                for k, w in enumerate(WIDTHS):
                    cols = np.arange(k * FILTERS, (k + 1) * FILTERS)
                    for tap in range(w):
                        cls = np.take_along_axis(b, best[:, cols] + tap, 1)
                        np.add.at(grads[k][tap], (cls, np.broadcast_to(np.arange(FILTERS), cls.shape)), back[:, cols])
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", seed: int = 7) -> ByteNet | None:
    """Fit on a sample of ``labelled``: of every language about SAMPLE_PER_LANGUAGE documents (fewer where there are so many
    languages that all would pass SAMPLE_ALL), picked by a hash of the key and the text, and up to SAMPLE_WINDOWS
    windows of each, picked by the same hash. Only those windows and one row a language reach the driver. None where
    there is no labelled text."""
    src = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                          F.xxhash64(F.col(key_col).cast("string"), F.col(text_col)).alias("h"))
    src = src.where("lang is not null and text rlike '\\\\p{L}'")
    sizes = src.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return None
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ALL // len(sizes)))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], max(1, int(min(1, each / r["count"]) * PARTS))) for r in sizes], "lang string, share long")

    def window(k):
        start = F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1)
        return F.substring("text", start.cast("int") + 1, F.lit(WINDOW))

    picked = (src.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(PARTS)) < F.col("share"))
              .select("lang", "h", F.array(*[window(k) for k in range(SAMPLE_WINDOWS)]).alias("w"))
              .orderBy("h").collect())
    langs = sorted(r["lang"] for r in sizes)
    rows = [(w, langs.index(r["lang"])) for r in picked for w in dict.fromkeys(r["w"]) if any(c.isalpha() for c in w)]
    if not rows:
        return None
    x = np.concatenate([_windows(w.encode()[:WINDOW]) for w, _ in rows])
    return ByteNet(langs, seed).fit(x, np.array([k for _, k in rows]))


def predictor(net: ByteNet):
    """A pandas UDF from texts to (lang, score): letter-weighted mean of the windows' log-probabilities."""
    tables = net.tables()

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        import regex

        letter = regex.compile(r"\p{L}").search
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        at, parts, owners = 0, [], []

        def flush():
            x = np.concatenate(parts)
            lp = net.log_probs(x, tables) * ((x >= 3).sum(1, keepdims=True) + 1e-3)
            starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
            total = np.add.reduceat(lp, starts, axis=0)
            total /= np.add.reduceat((x >= 3).sum(1, keepdims=True) + 1e-3, starts, axis=0)
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, row in zip(owners, p, strict=True):
                k = int(row.argmax())
                langs[i], scores[i] = net.langs[k], float(row[k])

        for i, t in enumerate(texts):
            if t and letter(t):
                parts.append(_windows(t.encode("utf-8", "surrogatepass")))
                owners.append(i)
                at += len(parts[-1])
                if at >= 2048:
                    flush()
                    at, parts, owners = 0, [], []
        if parts:
            flush()
        return pd.DataFrame({"lang": langs, "score": np.minimum(scores, 1.0)})

    return predict


def predict(docs: DataFrame, net: ByteNet | None, text_col: str = "text"):
    """A struct column (lang, score) for ``docs``: ``und`` and 0 for null texts and texts without a letter, and for
    all texts where no network could be trained."""
    if net is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    return predictor(net)(F.col(text_col))
