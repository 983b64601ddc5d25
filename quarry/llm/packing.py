"""Best-fit packing by matching large items.

Lengths are whole numbers up to the capacity, so the packing depends on the histogram of lengths alone: at most
``capacity`` counts, however many documents there are. The plan is made on those counts (bounded by the capacity
squared, not by the data) and then applied to every piece by its rank among the pieces of its length.

Large pieces (over a third of the capacity) share a bin with one other large piece at most: in falling order of
length each takes the longest large piece that still fits, which gives the most pairs. The others go best-fit, in
falling order, into the smallest gap that takes them; what is left opens new bins.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, stored, worker_state

CAPACITY = 4096
#: Words whose ids a Python worker keeps.
CACHE_WORDS = 1_000_000
#: Texts that are encoded together, and the characters they have in all (a longer one is encoded alone).
BATCH, BATCH_CHARS = 2048, 8 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def word_encoder(vocab: bytes):
    """A function from a list of texts to each text's ids as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space before it merges, and in plain Latin text neither normalisation nor lower
    case looks beyond a character, so such a text's ids are its words' ids in a row and words can be looked up.
    Any other text goes to the tokenizer whole."""
    import re
    from array import array

    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(vocab)
    plain = re.compile(r"[\t\n\x0b\x0c\r -~¡-ɏ]*").fullmatch
    known: dict[str, bytes] = {}

    def ids(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    #: A character that no plain text holds and that stands for itself: between words, it tells their ids apart.
    mark = ids(["\x01"])[0]

    def learn(words: list[str]) -> None:
        """Add words to the known ones; the tokenizer takes many at a time. A word's last stops are ids of their own."""
        if len(mark) != 4:  # a vocabulary that writes it as more than one id
            known.update(zip(words, ids(words), strict=True))
            return
        stem = {w: c for w in words if (c := w.rstrip(".,;:!?")) != w and c and c[-1].isalpha()}
        parts = {x for w, c in stem.items() for x in (c, w[len(c):])} | {w for w in words if w not in stem}
        fresh = [x for x in parts if x not in known]
        for at in range(0, len(fresh), 50_000):
            part = fresh[at:at + 50_000]
            texts = [" \x01 ".join(part[i:i + 64]) for i in range(0, len(part), 64)]
            end = int.from_bytes(mark, "little")
            row = np.concatenate([np.array([*e.ids, end], "<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
            raw, cuts = row.tobytes(), (4 * np.flatnonzero(row == end)).tolist()
            known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *(c + 4 for c in cuts)], cuts, strict=False))
        known.update((w, known[c] + known[w[len(c):]]) for w, c in stem.items())

    def words_of(texts: list[str]) -> list[bytes]:
        """Ids of plain texts. Each distinct word of all of them is looked up once; the texts' ids are gathered from
        those of the words with numpy."""
        if len(known) > CACHE_WORDS:
            known.clear()
        split = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))  # the plain texts hold no other white space
        coded = split.values.dictionary_encode()
        words, look = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), known.get
        found = list(map(look, words))
        fresh = [w for w, x in zip(words, found, strict=True) if x is None]
        if fresh:
            learn(fresh)
            found = list(map(known.__getitem__, words))
        size = np.fromiter(map(len, found), "int64", len(found)) // 4
        held, begin, code = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = held[np.repeat(begin[code] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        simple = [i for i, t in enumerate(texts) if plain(t) and "<|" not in t]
        held = set(simple)
        rest = [i for i in range(len(texts)) if i not in held]
        for places, coder in ((simple, words_of), (rest, ids)):
            if places:
                for i, x in zip(places, coder([texts[i] for i in places]), strict=True):
                    out[i] = x
        return out

    return encode


def tokenize_pieces(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = 1,
                    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: its ids, then ``end_id``, cut into ``capacity`` ids where longer.
    A null text counts as empty, which is one piece of the end id. ``with_ids`` adds the ids themselves."""
    with open(vocab_path, "rb") as f:
        vocab = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.uint32(end_id).tobytes()
    cut = 4 * capacity

    def run(batches):
        import os

        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = worker_state(("bpe", zlib.crc32(vocab.value)), lambda: word_encoder(vocab.value))
        for b in batches:
            doc, texts = b.column(0).to_pylist(), b.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            at = 0
            while at < len(doc):
                end_at = min(at + BATCH, max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, "right"))), len(doc))
                raws = [x + end for x in encode([t or "" for t in texts[at:end_at].to_pylist()])]
                ids, starts = doc[at:end_at], [0] * len(raws)
                at = end_at
                if max(map(len, raws)) > cut:  # only longer ones are cut
                    cuts = [(d, p, raw[p:p + cut]) for d, raw in zip(ids, raws, strict=True) for p in range(0, len(raw), cut)]
                    ids, starts, raws = map(list, zip(*cuts, strict=True))
                out = {"doc_id": ids, "piece": [p // cut for p in starts], "start": [p // 4 for p in starts],
                       "length": [len(x) // 4 for x in raws], "ids_crc32": list(map(zlib.crc32, raws))}
                if with_ids:
                    out["ids"] = [np.frombuffer(x, "<u4").astype("int64") for x in raws]
                yield out

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
                     PIECES + ", ids array<long>" * with_ids)


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Packing of ``counts[n]`` items of length n: rules (length, first rank, items, first bin, offset, items a bin)
    and the number of bins. A rule sends the items from its first rank on to bins from its first bin on."""
    left, used = counts.astype("int64").copy(), np.zeros(capacity + 1, "int64")
    rules: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> (first bin, bins)
    open_gap = np.zeros(capacity + 1, bool)
    bins = 0

    def put(length, n, first, offset, each=1):
        rules.append((length, int(used[length]), n, first, offset, each))
        used[length] += n
        left[length] -= n

    def room(gap, first, n):
        if gap and n:
            gaps[gap].append((first, n))
            open_gap[gap] = True

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            fits = np.flatnonzero(left[third + 1:min(a, capacity - a) + 1]) + third + 1
            if len(fits) and fits[-1] == a and left[a] < 2:
                fits = fits[:-1]
            b = int(fits[-1]) if len(fits) else 0
            n = int(left[a]) if not b else int(left[a]) // 2 if a == b else int(min(left[a], left[b]))
            put(a, n, bins, 0)
            if b:
                put(b, n, bins, a)
            room(capacity - a - b, bins, n)
            bins += n
    for a in range(third, 0, -1):
        while left[a]:
            fits = np.flatnonzero(open_gap[a:])
            gap = int(fits[0]) + a if len(fits) else capacity
            if len(fits):
                first, n = gaps[gap].pop()
                open_gap[gap] = bool(gaps[gap])
            else:
                first, n = bins, -(-int(left[a]) // (capacity // a))
                bins += n
            each = gap // a
            full, rest = divmod(int(left[a]), each)
            full = min(full, n)
            if full:
                put(a, full * each, first, capacity - gap, each)
                room(gap - each * a, first, full)
            if full < n:
                if rest := min(rest, int(left[a])):
                    put(a, rest, first + full, capacity - gap, rest)
                    room(gap - rest * a, first + full, 1)
                room(gap, first + full + bool(rest), n - full - bool(rest))
    return np.array(rules, "int64").reshape(-1, 6), bins


def assign(items: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to ``items`` with a ``length`` of 1 to ``capacity``. ``items`` is read three times:
    give a stored table. A common length is ranked in many slices, so no task gets all items of a length."""
    spark = items.sparkSession
    # 256 slices of a length at least; as many as shuffle partitions on a larger cluster
    slices = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = items.withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(slices)))
    counts = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    hist = np.zeros(capacity + 1, "int64")
    for r in items.groupBy("length").count().collect():  # one row a length: capacity rows at most
        hist[r[0]] = r[1]
    rules, _ = plan(hist, capacity)
    rules = rules[np.lexsort((rules[:, 1], rules[:, 0]))]
    shared = spark.sparkContext.broadcast(rules)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = shared.value
        n, k = length.to_numpy("int64"), rank.to_numpy("int64")
        rule = r[np.searchsorted((r[:, 0] << 48) + r[:, 1], (n << 48) + k, side="right") - 1]
        i = k - rule[:, 1]
        return pd.DataFrame({"sequence_id": rule[:, 3] + i // rule[:, 5], "offset": rule[:, 4] + i % rule[:, 5] * n})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")
    start = counts.select("length", "slice", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy(*keys)) - 1
    ranked = cut.withColumn("within", within).join(start, ["length", "slice"])
    placed = ranked.withColumn("at", place("length", F.col("before") + F.col("within")))
    return placed.select(*items.columns, "at.sequence_id", "at.offset")


def pack(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` ids as the method finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one piece of the
    end id; repeated rows are packed as often as they occur; an empty table gives no rows; other columns are not
    read; a null doc_id is kept as it is."""
    pieces = stored(tokenize_pieces(docs, vocab_path, capacity, end_id), "pieces")
    return assign(pieces, capacity)
