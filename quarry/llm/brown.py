"""Class-based language model: exchange clustering, class transitions, word emissions.

Every training document is counted and every word of it gets a class. The exchange moves a word to the class that raises
the likelihood of the class bigrams most. It begins on the driver with the SEEDS most frequent words, the others being one
type. Then the FREQUENT words' neighbours among themselves are dealt by word once (at most two numbers for two words, at
any size of the corpus), and tasks move one half of the words after the other, at the same time, against the table of class
bigrams, until both halves together bring less than SETTLED nats a bigram; the map with the highest likelihood is kept.
One more pass counts each other word's frequent neighbours by class (at most two counts a class) and places it by the same
rule. The table of class bigrams is that of all pairs, those of two other words by a join. The probability of a word after
another is that of its class after the other's class times that of the word in its class, each smoothed; the unseen words of
a class share one word's place. A word that training has not seen counts in the class that most words with its last three
bytes have, or else that most words seen once have.

Other words stand in the pairs by a hash of 64 bits; those that share one share their class. The driver sees the bigrams of
the seeds, the table of class bigrams and the FREQUENT words. Their counts and classes travel with the tasks; the others
meet the documents that hold them in a join by word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, frequent_from, map_arrow, slices, stored

#: Words that are clustered first, classes, words (and endings) whose counts and classes travel with the tasks.
SEEDS, CLASSES, FREQUENT = 1000, 40, 40_000
ADD = 0.1
#: Passes of the exchange over the seeds; nats a bigram that two turns over the frequent words must bring for another.
SWEEPS, SETTLED = 4, 0.001
#: Words that a task takes in before it sums their pairs.
CHUNK = 1_000_000
END_TYPE, OTHER_TYPE = 0, 1
#: The end of text among the numbers and hashes; hashes keep away from numbers below SMALL.
END, SMALL = 0, 1 << 20


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; the end of text is not listed."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), c: counts over all texts, summed inside each task first."""
    def run(batches):
        from collections import Counter

        seen: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                seen.update(tokens(t))
            if len(seen) > 200_000:
                yield {"word": list(seen), "c": list(seen.values())}
                seen.clear()
        if seen:
            yield {"word": list(seen), "c": list(seen.values())}

    return map_arrow(texts, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def code(word: bytes) -> int:
    """A word's hash, never END nor another number up to SMALL."""
    h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
    return h if not 0 <= h <= SMALL else h - 2 * SMALL


def pairs_of(batches, number) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words and their next words of many texts at once; a text begins after an end and closes with one.
    ``number`` turns a text's words into numbers."""
    def joined(held):
        path = np.concatenate(held)
        keep = np.ones(len(path) - 1, bool)
        keep[np.cumsum([len(x) for x in held])[:-1] - 1] = False  # not a pair: the end of a text and the beginning of the next
        return path[:-1][keep], path[1:][keep]

    held, n = [], 0
    for b in slices(batches, 256):
        for t in b.column(0).to_pylist():
            held.append(np.array([END, *number(tokens(t)), END], "int64"))
            n += len(held[-1])
            if n > CHUNK:
                yield joined(held)
                held, n = [], 0
    if held:
        yield joined(held)


def hashes(known: dict[bytes, int]):
    """Numbers of words: those of ``known``, hashes for the others (kept for a while)."""
    rare: dict[bytes, int] = {}

    def number(words):
        if len(rare) > 200_000:
            rare.clear()
        ids = [known.get(w) for w in words]
        for i, x in enumerate(ids):
            if x is None:
                w = words[i]
                ids[i] = rare.get(w)
                if ids[i] is None:
                    ids[i] = rare[w] = code(w)
        return ids

    return number


def summed(a: np.ndarray, b: np.ndarray) -> Iterator[dict]:
    """a, b, n: how often each pair occurs."""
    got = pa.table({"a": a, "b": b}).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
    for i in range(0, got.num_rows, 200_000):
        part = got.slice(i, 200_000).combine_chunks()
        yield {"a": part["a"].to_numpy(), "b": part["b"].to_numpy(), "n": part["count_all"].to_numpy()}


def bigrams(texts: DataFrame, shared=None) -> DataFrame:
    """a, b, n: counts of word after word over all texts, summed inside each task first; by hash, or, with the broadcast
    ``shared`` numbers of some words, by number and of those words (and the end of text) alone."""
    def run(batches):
        if shared is None:
            for a, b in pairs_of(batches, hashes({})):
                yield from summed(a, b)
            return
        known = shared.value
        for a, b in pairs_of(batches, lambda words: [known.get(w, -1) for w in words]):
            both = (a >= 0) & (b >= 0)
            yield from summed(a[both], b[both])

    return map_arrow(texts, run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def surroundings(texts: DataFrame, shared, cls: np.ndarray, k: int) -> DataFrame:
    """a, b, n of words without a number, by hash: how often ``a`` stands before a numbered word of class b (0 to k - 1),
    after one of class b - k (k to 2 * k - 1), before itself (2 * k), or before another word without a number (b, its
    hash). Summed inside each task only."""
    def run(batches):
        for a, b in pairs_of(batches, hashes(shared.value)):
            no_a, no_b = (a < 0) | (a > SMALL), (b < 0) | (b > SMALL)
            before, after, both = no_a & ~no_b, no_b & ~no_a, no_a & no_b
            x, y = a[both], b[both]
            yield from summed(np.concatenate([a[before], b[after], x]),
                              np.concatenate([cls[b[before]], k + cls[a[after]], np.where(x == y, 2 * k, y)]))

    return map_arrow(texts, run, "a long, b long, n long")


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type. Type 0 (end of text) keeps class 0 for itself."""
    n = pairs.astype("float64")
    size = len(n)
    classes = max(2, min(classes, size))
    weight = n.sum(0) + n.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[order != END_TYPE]
    cls = np.zeros(size, "int64")
    cls[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), cls] = 1
    table = member.T @ n @ member  # class after class
    log = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            out = np.bincount(cls, weights=n[w], minlength=classes)
            into = np.bincount(cls, weights=n[:, w], minlength=classes)
            own, old = n[w, w], cls[w]
            out[old] -= own
            into[old] -= own
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            rows, cols = table.sum(1), table.sum(0)
            gain = (log(table + out) - log(table)).sum(1) + (log(table.T + into) - log(table.T)).sum(1)
            d = np.diagonal(table)
            k = np.arange(classes)
            gain += log(d + out[k] + into[k] + own) - log(d + out[k]) - log(d + into[k]) + log(d)
            gain -= log(rows + out.sum() + own) - log(rows) + log(cols + into.sum() + own) - log(cols)
            gain[0] = -np.inf
            new = int(gain.argmax())
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            if new != old:
                cls[w], moved = new, moved + 1
        if not moved:
            break
    return cls


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(table: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most, for each of some words that leave their class ``old`` (-1: none) alone:
    ``out`` and ``into`` are a word's counts before and after each class (words by classes), ``own`` those after itself,
    which the two leave out. Class 0 is the end of text's."""
    hot = old[:, None] == np.arange(len(table))

    def side(table, x, y):
        w, j = np.nonzero(x)
        gain = np.zeros(x.shape)
        if len(w):
            v, same = x[w, j][:, None], hot[w, j][:, None]
            base = table[:, j].T - hot[w] * (v + same * own[w][:, None]) - same * y[w]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[first]] = np.add.reduceat(_xlogx(base + v) - _xlogx(base), first, axis=0)
        return gain

    each = own[:, None]
    gain = side(table, out, into) + side(table.T, into, out)
    d = np.diagonal(table) - hot * (out + into + each)
    gain += _xlogx(d + out + into + each) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
    for sums, x in ((table.sum(1), out), (table.sum(0), into)):
        n = x.sum(1, keepdims=True) + each
        left = sums - hot * n
        gain -= _xlogx(left + n) - _xlogx(left)
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def neighbours(pairs: DataFrame, size: int) -> DataFrame:
    """w, e: every numbered word's counts (k, n) with the words after it (their numbers) and before it (``size`` more). No
    list is longer than twice the ``size`` numbers."""
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("k"), "n"),
                                         F.struct(F.col("b").alias("w"), (F.col("a") + size).alias("k"), "n"))))
    return both.groupBy("w").agg(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "n")).alias("e"))


def _counts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (word, list of k and n): the words, and of each count its row, k and n."""
    e = batch.column(1)
    flat = e.flatten()
    return (batch.column(0).to_numpy(), pc.list_parent_indices(e).to_numpy(),
            flat.field("k").to_numpy(), flat.field("n").to_numpy().astype("float64"))


def class_table(near: DataFrame, cls: np.ndarray, k: int) -> np.ndarray:
    """Counts of class after class among numbered words that have a class."""
    def run(batches):
        sums = np.zeros(k * k)
        for b in slices(batches):
            w, row, j, n = _counts(b)
            use = j < len(cls)
            x, y, n = cls[w[row[use]]], cls[j[use]], n[use]
            use = (x >= 0) & (y >= 0)
            sums += np.bincount(x[use] * k + y[use], weights=n[use], minlength=k * k)
        yield {"cell": np.arange(k * k), "n": sums}

    return _table(map_arrow(near, run, "cell int, n double"), k)


def _table(cells: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k * k)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # k * k rows
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def moves(near: DataFrame, table: np.ndarray, cls: np.ndarray, k: int, turn: int) -> np.ndarray:
    """The class map after a turn: turn 0 places the words that have no class, later ones move one half of the words."""
    def run(batches):
        for b in slices(batches, 256):
            w, row, j, n = _counts(b)
            go = (w != END) & ((cls[w] < 0) if turn == 0 else (w % 2 == turn % 2))
            at = np.cumsum(go) - 1
            own = w[row] == j % len(cls)
            other = cls[j % len(cls)]
            use = go[row] & (other >= 0) & ~own
            dense = np.bincount(at[row[use]] * 2 * k + other[use] + k * (j[use] >= len(cls)), weights=n[use],
                                minlength=2 * k * go.sum()).reshape(-1, 2 * k)
            use = go[row] & own & (j < len(cls))
            itself = np.bincount(at[row[use]], weights=n[use], minlength=go.sum())
            yield {"w": w[go], "cls": best_classes(table, dense[:, :k], dense[:, k:], itself, cls[w[go]])}

    got = map_arrow(near, run, "w int, cls int").toArrow()  # bounded: at most the numbered words
    out = cls.copy()
    out[got.column("w").to_numpy()] = got.column("cls").to_numpy()
    return out


def exchange_numbered(near: DataFrame, size: int, k: int = CLASSES, seeds: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each of ``size`` numbers (0: the end of text) from their ``neighbours``, and the counts of class after
    class. The first ``seeds`` numbers are clustered first."""
    seeds = min(seeds, size - 1)
    typed = lambda c: F.when(c == END, END_TYPE).when(c <= seeds, c + 1).otherwise(OTHER_TYPE)
    after = near.select("w", F.inline("e")).where(F.col("k") < size)
    got = after.groupBy(typed(F.col("w")).alias("x"), typed(F.col("k")).alias("y")).agg(F.sum("n").alias("n")).toArrow()  # at most a row for two seeds
    n = np.zeros((seeds + 2,) * 2, "int64")
    n[got.column("x").to_numpy(), got.column("y").to_numpy()] = got.column("n").to_numpy()
    first = exchange(n, k)
    cls = np.full(size, -1, "int64")
    cls[END], cls[1:seeds + 1] = 0, first[2:]
    table, best, turn = class_table(near, cls, k), None, 0
    total = max(float(n.sum()), 1.0)
    gains: list[float] = []
    while True:
        cls = moves(near, table, cls, k, turn)
        if turn == 0:  # words that are beside no seed begin anywhere
            cls = np.where(cls < 0, 1 + np.arange(size) % (k - 1), cls)
        table = class_table(near, cls, k)
        reached = likelihood(table) / total
        if best is not None:
            gains.append(reached - best[2])
        if best is None or reached > best[2]:
            best = cls, table, reached
        if len(gains) > 1 and sum(gains[-2:]) < SETTLED:
            return best[0], best[1]
        turn += 1


def place(around: DataFrame, words: DataFrame, table: np.ndarray, k: int) -> tuple[DataFrame, np.ndarray]:
    """h, cls of the words without a number (``words``: h) by their ``surroundings``, and the counts of class after class in
    those. A word beside no numbered word begins anywhere."""
    def run(batches):
        for b in slices(batches):
            h, row, j, n = _counts(b)
            dense = np.bincount(row * (2 * k + 1) + j, weights=n, minlength=(2 * k + 1) * len(h)).reshape(-1, 2 * k + 1)
            yield {"h": h, "e": b.column(1), "cls": best_classes(table, dense[:, :k], dense[:, k:2 * k], dense[:, 2 * k], np.full(len(h), -1))}

    known = F.col("b").between(0, 2 * k)
    cells = around.where(known).groupBy("a", F.col("b").cast("int").alias("k")).agg(F.sum("n").alias("n"))
    each = cells.groupBy(F.col("a").alias("h")).agg(F.collect_list(F.struct("k", "n")).alias("e"))  # at most 2 k + 1 a word
    placed = stored(map_arrow(each, run, "h long, e array<struct<k:int,n:long>>, cls int"), "placed")
    start = (1 + F.pmod("h", F.lit(k - 1))).cast("int")
    classes = stored(words.select("h").distinct().join(placed.select("h", "cls"), "h", "left").select("h", F.coalesce("cls", start).alias("cls")), "classes")
    beside = placed.select("cls", F.inline("e")).select(
        F.when(F.col("k") < k, F.col("cls") * k + F.col("k")).when(F.col("k") < 2 * k, (F.col("k") - k) * k + F.col("cls"))
        .otherwise(F.col("cls") * k + F.col("cls")).alias("cell"), "n")
    of = lambda side, name: classes.select(F.col("h").alias(side), F.col("cls").alias(name))
    ahead = around.where(~known).join(of("a", "x"), "a").groupBy("x", "b").agg(F.sum("n").alias("n"))
    among = ahead.join(of("b", "y"), "b").select((F.col("x") * k + F.col("y")).alias("cell"), "n")
    sums = _table(beside.unionByName(among), k)
    discard(placed)
    return classes, sums


@dataclass
class Types:
    """Types are the frequent words, then the classes, for all other words."""

    frequent: dict[bytes, int]
    words: DataFrame  # word, c, cls
    endings: dict[bytes, int]  # class of unseen words by their last three bytes
    unseen: int  # class of other unseen words

    def of(self, word: bytes) -> int:
        t = self.frequent.get(word)
        if t is None:
            row = self.words.where(F.col("word") == F.lit(word)).first()
            t = len(self.frequent) + (self.endings.get(word[-3:], self.unseen) if row is None else row["cls"])
        return t


@dataclass
class Model:
    types: Types
    cls: np.ndarray  # class of each type
    step: np.ndarray  # log10 probability of class after class
    room: np.ndarray  # log10 of a class's smoothed total
    ends: int  # training documents
    words: DataFrame  # word, c, cls
    frequent: dict[bytes, int]
    total: int  # training tokens
    distinct: int


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all of ``docs`` and cluster the words."""
    texts = docs.select(F.col(text_col).alias("text"))
    hashed = F.udf(code, "long", useArrow=True)
    counted = stored(word_counts(texts).withColumn("h", hashed("word")), "words")
    n_docs = texts.count()
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = F.col("c") >= frequent_from(counted, FREQUENT, "c")
    most = sorted(counted.where(often).select("c", "word").toArrow().to_pylist(), key=lambda r: (-r["c"], r["word"]))  # bounded: FREQUENT rows
    numbers = {bytes(r["word"]): i + 1 for i, r in enumerate(most)}
    k, size = CLASSES, len(numbers) + 1
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    near = stored(neighbours(bigrams(texts, shared), size), "near")
    cls, table = exchange_numbered(near, size, k)
    discard(near)
    around = stored(surroundings(texts, shared, cls, k), "around")
    classes, others = place(around, counted.where(~often), table, k)
    table = table + others
    discard(around)
    class_of = docs.sparkSession.createDataFrame([(bytearray(w), int(cls[i])) for w, i in numbers.items()], "word binary, cls int")
    words = stored(counted.where(often).join(F.broadcast(class_of), "word").select("word", "c", "cls").unionByName(
        counted.where(~often).join(classes, "h").select("word", "c", "cls")), "words")
    discard(counted)
    discard(classes)
    top = words.where(often).toArrow()  # the same words
    frequent = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    mass, variety, once = np.zeros(k), np.zeros(k), np.zeros(k)
    for r in words.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect():
        mass[r["cls"]], variety[r["cls"]], once[r["cls"]] = r["c"], r["n"], r["once"]
    unseen = int(1 + (once if once.any() else variety)[1:].argmax())
    ending = F.substring("word", F.greatest(F.octet_length("word") - 2, F.lit(1)), F.lit(3)).alias("e")
    by_end = stored(words.groupBy(ending, "cls").agg(F.count("*").alias("n")).groupBy("e").agg(
        F.max_by("cls", F.struct("n", -F.col("cls"))).alias("cls"), F.sum("n").alias("n")), "endings")
    ends = by_end.where(F.col("n") >= frequent_from(by_end, FREQUENT)).toArrow()  # bounded: FREQUENT rows
    endings = dict(zip(ends.column("e").to_pylist(), ends.column("cls").to_pylist(), strict=True))
    mass[0], variety[0] = n_docs, 1  # the end of text
    prior = (mass + ADD) / (mass.sum() + ADD * k)
    strength = float(k)
    step = np.log10((table + strength * prior) / (table.sum(1, keepdims=True) + strength))
    room = np.log10(mass + ADD * (variety + 1))
    types = Types({w: i for i, w in enumerate(frequent)}, words, endings, unseen)
    cls = np.array([*top.column("cls").to_pylist(), *range(k)], "int64")
    return Model(types, cls, step, room, n_docs, words, frequent,
                 int(sums[0]) + n_docs, int(sums[1]) + (n_docs > 0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score (smoothed unigrams), score (the class model),
    both log10 probabilities of the text and its end. Null and empty texts hold the end alone; an empty table gives
    no rows; other columns are not read."""
    step, room, ends, total, distinct = (model.step, model.room, model.ends, model.total, model.distinct)
    base_end = math.log10(ends + ADD)
    end = base_end - float(room[0])
    log_all = math.log10(total + ADD * (distinct + 1))
    shared = docs.sparkSession.sparkContext.broadcast(
        ({w: (math.log10(c + ADD), int(k)) for (w, c), k in zip(model.frequent.items(), model.cls)}, model.types.endings, model.types.unseen))

    def run(batches):
        (common, endings, unseen), rest = shared.value, (None, -1)
        for b in slices(batches, 256):
            out_doc, out_row, out_word, out_n, out = [], [], [], [], []
            for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = tokens(text)
                got = [common.get(w, rest) for w in words]
                logs = [x[0] for x in got if x[0] is not None]
                path = np.array([0, *(x[1] for x in got), 0], "int16")
                # the document's own row: a key that no word can have, so that it is dealt out like the others
                out_doc.append(doc)
                out_row.append(row)
                out_word.append(b" %d" % row)
                out_n.append(0)
                out.append((len(words) + 1, len(logs) + (ends > 0), math.fsum(logs), path.tobytes(), 0))
                rare: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(path < 0):
                    rare.setdefault(words[i - 1], []).append(i)
                for w, at in rare.items():
                    out_doc.append(None)
                    out_row.append(row)
                    out_word.append(w)
                    out_n.append(len(at))
                    out.append((0, 0, 0.0, np.array(at, "int32").tobytes(), endings.get(w[-3:], unseen)))
            yield {"row": out_row, "doc_id": out_doc, "word": out_word, "n": out_n, "n_tokens": [x[0] for x in out],
                   "n_known": [x[1] for x in out], "logs": [x[2] for x in out], "path": [x[3] for x in out], "guess": [x[4] for x in out]}

    def along(batches):  # the path of classes, with those of the rare words at their places
        for b in slices(batches):
            paths, rare = b.column(4).to_pylist(), b.column(5)
            c = np.frombuffer(b"".join(paths), "int16").astype("int64")
            starts = np.cumsum([0, *(len(x) // 2 for x in paths)])
            flat = rare.flatten()
            places = flat.field("path").to_pylist()
            n = np.array([len(x) // 4 for x in places], "int64")
            c[np.repeat(starts[pc.list_parent_indices(rare).to_numpy()], n) + np.frombuffer(b"".join(places), "int32")] = np.repeat(flat.field("cls").to_numpy(), n)
            gains = np.r_[step[c[:-1], c[1:]], 0.0]  # of the step to the next word
            gains[starts[1:] - 1] = 0
            inner = room[c]
            inner[starts[:-1]] = inner[starts[1:] - 1] = 0
            whole = np.add.reduceat(gains - inner, starts[:-1]) + end
            yield {name: b.column(i) for i, name in enumerate(("doc_id", "n_tokens", "n_known", "logs"))} | {"whole": whole}

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = map_arrow(src, run, "row long, doc_id long, word binary, n long, n_tokens long, n_known long, logs double, path binary, guess int")
    c, rare = F.coalesce("c", F.lit(0)), F.col("n") > 0
    met = parts.join(model.words, "word", "left").select(
        "row", "doc_id", "n_tokens", (F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("logs") + F.col("n") * F.log10(c + ADD)).alias("logs"), F.when(~rare, F.col("path")).alias("path"),
        F.when(rare, F.struct(F.coalesce("cls", "guess").alias("cls"), "path")).alias("rare"))
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "logs")],
                                  F.max("path").alias("path"), F.collect_list("rare").alias("rare")).drop("row")
    told = map_arrow(sums, along, "doc_id long, n_tokens long, n_known long, logs double, whole double")
    return told.select("doc_id", "n_tokens", "n_known",
                       (F.col("logs") + base_end - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
                       (F.col("logs") + F.col("whole")).alias("score"))
