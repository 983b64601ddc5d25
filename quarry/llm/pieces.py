"""SentencePiece encoding and decoding with a relational lattice.

The work is done once for each distinct word. A word's substrings up to the longest piece are exploded and
equi-joined with the piece table; the edges that match are folded, by end and start, into the best path (highest sum of
piece scores; ties go to the longer last piece), all words of a task at once, position after position. A character
that is no piece falls back to its bytes. A walk back along the path gives the ids. A long word takes the same fold position
by position inside its task, which holds the scores of the last ``longest`` positions and one step back a position, so
a word of any length has its one best path. Documents then take their words' ids; the table of frequent words (bounded)
travels with the tasks, the others meet their words in a join. Each document's whole list of ids is put together, and decoded
as a whole.

The whole text is encoded: a mark stands in front of it and in place of each space, and every other character stays.
Its words are the units that no piece crosses: a run of marks with the characters behind it, or a run of line breaks and
tabs. So the best paths of the words, one after the other, are the best path of the text, and decoding gives it back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_list, discard, frequent_from, map_arrow, slices, stored
from quarry.llm.importance import shift, shift_tables

MARK = "▁"
#: A word, before its spaces become marks; every text is a row of them.
WORD = re.compile(r" *[^ \t\n]+| +|[\t\n]+")
#: Code points of a word above which the path is folded position by position, words whose ids travel with the tasks, a
#: byte's score.
LONG_WORD, FREQUENT, BYTE_SCORE = 256, 100_000, -1e6
#: Distinct words of a task (some 65 substrings and 25 edges each) and their characters.
WORDS_A_TASK, CHARACTERS_A_TASK = 40_000, 600_000
#: Texts cut at a time, distinct words that a task holds before it hands them on, edges folded at a time.
TEXTS, HELD, EDGES = 256, 100_000, 100_000
#: Characters of a piece's beginning by which the substrings that can be pieces are bounded.
FRONT = 4
#: Ids of a word above which its digest is taken from its decimal text as a whole.
MANY_IDS = 64
#: Modulus and factor of the documents' order-sensitive digest.
PRIME, FACTOR = 2_147_483_647, 1_000_003
#: Parts of the texts whose ids are put together one after the other.
PARTS = 5


@dataclass
class Pieces:
    table: DataFrame  # piece, id, score
    longest: int
    byte_ids: list[int]
    texts: list[str]
    bytes_: dict[int, int]
    scores: dict[str, tuple[float, int]]  # of each piece, with its id


def load(spark: SparkSession, model_path: str) -> Pieces:
    """The piece table of a SentencePiece model file (some ten thousand rows: it may be broadcast)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    rows, byte_ids = [], [0] * 256
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            rows.append((m.id_to_piece(i), i, float(m.get_score(i))))
    crossing = [r[0] for r in rows if not WORD.fullmatch(r[0].replace(MARK, " "))]
    if crossing:
        raise ValueError(f"pieces that go across words: {crossing[:5]}")
    return Pieces(spark.createDataFrame(rows, "piece string, id int, score double"), max(len(r[0]) for r in rows), byte_ids,
                  [m.id_to_piece(i) for i in range(m.get_piece_size())], {x: b for b, x in enumerate(byte_ids)},
                  {piece: (score, i) for piece, i, score in rows})


def long_path(word: str, scores: dict[str, tuple[float, int]], longest: int, byte_ids: list[int]) -> list[int]:
    """The ids of the best path of one word, by the rule of ``encode_words``."""
    size = longest + 1
    last, back = [0.0] * size, np.zeros(len(word) + 1, "int32")  # score of position p at p % size, start of its last piece
    for end in range(1, len(word) + 1):
        best = None
        for start in range(max(0, end - longest), end):
            found = scores.get(word[start:end])
            if found is None and end - start > 1:
                continue
            score = last[start % size] + (found[0] if found else len(word[start:end].encode()) * BYTE_SCORE)
            if best is None or score > best:
                best, back[end] = score, start
        last[end % size] = best
    out, end = [], len(word)
    while end:
        start = int(back[end])
        found = scores.get(word[start:end])
        out.extend([found[1]] if found else [byte_ids[b] for b in reversed(word[start:end].encode())])
        end = start
    return out[::-1]


def best_paths(first: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray,
               scores: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the best paths of many words, one after the other, and the number of each word's. Edges come by word, start
    and end; ``first`` are the words' first edges, ``sizes`` their characters. An edge of one character that is no piece has
    -1 less its code point as id."""
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
    if not np.array_equal(np.bincount(of[end == start + 1], minlength=len(first)), sizes) or (np.diff(of * 1024 + start) < 0).any():
        raise ValueError("the edges of a word must come together, by start")
    octets = lambda x: 1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000)
    base = np.cumsum(sizes + 1) - sizes - 1  # position 0 of each word
    order = np.argsort(end.astype("uint16"), kind="stable")  # by end, word, start
    of, ids = of[order], ids[order]
    src, dst = base[of] + start[order], base[of] + end[order]
    score = np.where(ids < 0, octets(-1 - ids) * BYTE_SCORE, scores[np.maximum(ids, 0)])
    best, back = np.zeros(int((sizes + 1).sum())), np.zeros(int((sizes + 1).sum()), "int64")
    longest_word = int(sizes.max(initial=0))
    cuts = np.searchsorted(end[order], np.arange(1, longest_word + 2))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        to, reached = dst[lo:hi], best[src[lo:hi]] + score[lo:hi]
        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        most = np.maximum.reduceat(reached, heads)
        group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, hi - lo]))
        hit = np.flatnonzero(reached == most[group])
        hit = hit[np.r_[True, group[hit][1:] != group[hit][:-1]]]  # the longest of equals
        best[to[heads]], back[to[heads]] = most, lo + hit
    words, path, at, going = [], [], base + sizes, np.flatnonzero(sizes)
    while len(going):
        edge = back[at[going]]
        words.append(going)
        path.append(ids[edge])
        at[going] = src[edge]
        going = going[at[going] > base[going]]
    if not words:
        return np.zeros(0, "int32"), np.zeros(len(first), "int64")
    words, path = np.concatenate(words)[::-1], np.concatenate(path)[::-1]
    order = np.argsort(words, kind="stable")
    words, path = words[order], path[order]
    room = np.where(path < 0, octets(-1 - path), 1)
    out = np.repeat(path, room)
    if (path < 0).any():
        out[out < 0] = byte_ids[np.frombuffer("".join(map(chr, (-1 - path[path < 0]).tolist())).encode(), "uint8")]
    return out.astype("int32"), np.bincount(words, weights=room, minlength=len(first)).astype("int64")


def whole_groups(batches, begins, least: int):
    """Tables of at least ``least`` rows, but for the last; ``begins`` tells where groups begin in a table, and none is cut."""
    held, rows, enough = [], 0, least
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= enough:
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(begins(t)[-1])
            if last:
                yield t.slice(0, last).combine_chunks()
                held = t.slice(last).combine_chunks().to_batches()
                rows -= last
            enough = least if last else 2 * rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` (word, and other columns; read twice, give each word once) with ``ids``: the best path's ids. Words are dealt
    out once; edges stay in the task of their word, packed into a number each (id, start, end), the first of a word with its row. Substrings
    meet the pieces by 64 bits, then by their text; those longer than any piece with the same FRONT first characters are not
    made."""
    count, letters, longest_word = words.agg(F.count("*"), F.sum(F.length("word").cast("long")), F.max(F.length("word"))).first()
    n = max(1, -(-count // WORDS_A_TASK), -(-(letters or 0) // CHARACTERS_A_TASK))
    long, names, size = F.length("word") > LONG_WORD, words.columns, F.length("word")
    table = pieces.table.select(F.xxhash64("piece").alias("k"), F.col("piece").alias("known"), "id")
    if table.select("k").distinct().count() < len(pieces.scores):
        raise ValueError("two pieces share 64 bits")
    reach = pieces.table.groupBy(F.xxhash64(F.substring("piece", 1, FRONT)).alias("front")).agg(F.max(F.length("piece")).alias("reach"))
    starts = words.where(~long).repartition(n, "word").select(*names, F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    front = F.xxhash64(F.expr(f"substring(word, start + 1, {FRONT})"))
    starts = starts.withColumn("front", front).join(F.broadcast(reach), "front", "left").withColumn(
        "stop", F.least(size, F.col("start") + F.greatest(F.coalesce("reach", F.lit(0)), F.lit(FRONT - 1))))
    subs = starts.select(*names, "start", F.explode(F.sequence(F.col("start") + 1, F.col("stop"))).alias("end")).withColumn(
        "piece", F.expr("substring(word, start + 1, end - start)")).withColumn("k", F.xxhash64("piece"))
    one = F.col("end") == F.col("start") + 1
    met = subs.join(F.broadcast(table), "k", "left").where((F.col("known") == F.col("piece")) | one)
    edge = F.when(F.col("known") == F.col("piece"), F.col("id")).otherwise(-1 - F.ascii("piece")).cast("long") * (1 << 20) + F.col("start") * 1024 + F.col("end")
    edges = met.select(edge.alias("edge"), *[F.when((F.col("start") == 0) & one, F.col(c)).alias(f"of_{c}") for c in names])
    longest, scores, byte_ids = pieces.longest, np.zeros(len(pieces.texts)), np.array(pieces.byte_ids, "int32")
    for score, i in pieces.scores.values():
        scores[i] = score
    begins = lambda t: np.flatnonzero((t.column("edge").to_numpy() & (1 << 20) - 1) == 1)

    def fold(batches):
        for t in whole_groups(batches, begins, EDGES):
            first, edge = begins(t), t.column("edge").to_numpy()
            rows = {c: t.column(f"of_{c}").combine_chunks().take(pa.array(first)) for c in names}
            sizes = pc.utf8_length(rows["word"]).to_numpy(zero_copy_only=False).astype("int64")
            flat, counts = best_paths(first, sizes, edge >> 10 & 1023, edge & 1023, edge >> 20, scores, byte_ids)
            yield rows | {"ids": as_list(flat, np.r_[0, np.cumsum(counts)], pa.int32())}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", ids array<int>"
    out = map_arrow(edges, fold, schema)
    if (longest_word or 0) <= LONG_WORD:
        return out
    known = pieces.scores

    def run(batches):
        for b in slices(batches, 64):
            paths = [long_path(w, known, longest, pieces_bytes) for w in b.column(at).to_pylist()]
            yield {c: b.column(i) for i, c in enumerate(names)} | {"ids": paths}

    at, pieces_bytes = names.index("word"), pieces.byte_ids
    return out.unionByName(map_arrow(words.where(long).repartition(n, "word"), run, schema))


def split_words(text: str | None) -> list[str]:
    """The words of a text, with marks for its spaces and one in front; joined, they are the whole text."""
    return [w.replace(" ", MARK) for w in spaced_words(text)]


def spaced_words(text: str | None) -> list[str]:
    """The words of a text with spaces in place of marks."""
    return WORD.findall(" " + text) if text else []


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of many texts (``spaced_words``), one text's after the other's, and the number of each text's."""
    texts = pc.fill_null(texts, "")
    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    ends = np.frombuffer(spaced.buffers()[1], "int32")[spaced.offset:spaced.offset + len(spaced) + 1]
    octets = np.frombuffer(spaced.buffers()[2] or b"", "uint8")[ends[0]:ends[-1]]
    ends = ends - ends[0]
    if not len(octets):
        return pa.array([], pa.string()), np.zeros(len(texts), "int64")
    space, line = octets == 32, (octets == 9) | (octets == 10)
    begins = np.ones(len(octets), bool)
    begins[1:] = (line[1:] != line[:-1]) | (space[1:] & ~space[:-1])
    begins[ends[:-1][ends[1:] > ends[:-1]]] = True
    at = np.flatnonzero(begins)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, len(octets)].astype("int32")), pa.py_buffer(np.ascontiguousarray(octets)))
    return words, np.diff(np.searchsorted(at, ends))


def marked(words: pa.Array) -> pa.Array:
    return pc.replace_substring(words, " ", MARK)


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: all distinct words of all texts, summed inside each task first."""
    def run(batches):
        def summed(held):
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

        def told(t):
            return {"word": marked(t.column("word").combine_chunks()), "n": t.column("n").combine_chunks()}

        held, rows = [], 0
        for b in slices(batches, TEXTS):
            words, _ = cut(b.column(0))
            if not len(words):
                continue
            counts = words.value_counts()
            held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
            rows += len(counts)
            if rows > 2 * HELD:
                held = [summed(held)]
                rows = held[0].num_rows
                if rows > HELD:
                    yield told(held[0])
                    held, rows = [], 0
        if held:
            yield told(summed(held))

    return map_arrow(docs.select(F.col(text_col)), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The ids of all words of a corpus."""

    table: DataFrame  # word, n, ids
    shared: Broadcast  # the frequent words, with spaces in place of their marks, their ids and where those of each begin


def coded_words(docs: DataFrame, pieces: Pieces, text_col: str = "text", frequent: int = FREQUENT) -> Words:
    words = stored(vocabulary(docs, text_col), "words")
    coded = stored(encode_words(words, pieces), "coded")
    discard(words)
    top = coded.where(F.col("n") >= frequent_from(coded, frequent)).select(F.replace("word", F.lit(MARK), F.lit(" ")).alias("word"), "ids", "n").toArrow().sort_by([("n", "descending")]).combine_chunks()  # bounded: ``frequent`` rows
    ids = top.column("ids").combine_chunks()
    ends = np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))].astype("int64")
    return Words(coded, docs.sparkSession.sparkContext.broadcast(
        (top.column("word").cast(pa.string()).combine_chunks(), ids.flatten().to_numpy(zero_copy_only=False).astype("int32"), ends)))


def both_hashes(word):
    """128 bits of a word, as two columns."""
    return F.xxhash64(word).alias("k1"), F.xxhash64(F.lit(1), word).alias("k2")


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of each span, one span after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def ends_of(counts: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Offsets of lists that hold ``each`` for each of so many of its numbers in a row as ``counts`` says."""
    return np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(counts)]]


def asked(docs: DataFrame, words: Words, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, sha256 of each text, with codes, the number of each frequent word, or of another word -1 less its place in
    rare, and rare, those other words by first appearance. Stored."""
    shared = words.shared

    def run(batches):
        known = shared.value[0]
        for b in slices(batches, TEXTS):
            cut_words, counts = cut(b.column(3))
            coded = cut_words.dictionary_encode()
            which, distinct = coded.indices.to_numpy(), coded.dictionary
            codes = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False)[which]
            # each text's other words, once each
            other, size = np.flatnonzero(codes < 0), max(len(distinct), 1)
            key, seen, back = np.unique(np.repeat(np.arange(b.num_rows), counts)[other] * size + which[other], return_index=True, return_inverse=True)
            order = np.argsort(seen)
            asking = np.bincount(key // size, minlength=b.num_rows)
            nth = np.empty(len(key), "int64")
            nth[order] = spans(np.zeros(b.num_rows, "int64"), asking)
            codes[other] = -1 - nth[back]
            yield {"row": b.column(0), "doc_id": b.column(1), "sha256": b.column(2), "codes": as_list(codes, np.r_[0, np.cumsum(counts)], pa.int32()),
                   "rare": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(asking)], pa.int32()), marked(distinct).take(pa.array(key[order] % size)))}

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), sha256(F.col(text_col)).alias("sha256"), F.col(text_col))
    kind = src.schema["doc_id"].dataType.simpleString()
    return stored(map_arrow(src, run, f"row long, doc_id {kind}, sha256 string, codes array<int>, rare array<string>"), "asked")


def sha256(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def put_together(src: DataFrame, words: Words) -> DataFrame:
    """The rows of ``asked`` with ids, those of the whole text in order, and sizes, the number of each word's. A document's
    words outside the frequent ones meet their ids by 128 bits of the word, and come back behind its row."""
    shared = words.shared
    begins = lambda t: np.flatnonzero(t.column("nth").to_numpy() < 0)

    def run(batches):
        _, known, ends = shared.value
        for t in whole_groups(batches, begins, 10_000):
            docs, lists = begins(t), t.column("ids").combine_chunks()
            flat, lengths = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
            if not np.array_equal(t.column("nth").to_numpy(), spans(np.full(len(docs), -1), np.diff(np.r_[docs, len(lengths)]))):
                raise ValueError("a word has no ids")
            starts, counts = np.cumsum(lengths) - lengths, lengths[docs]
            codes = flat[spans(starts[docs], counts)].astype("int64")
            rare = np.flatnonzero(codes < 0)
            answer = np.repeat(docs, counts)[rare] - codes[rare]  # the row of its ids
            codes[rare] = 0
            begin, size = ends[codes], ends[np.minimum(codes + 1, len(ends) - 1)] - ends[codes]
            begin[rare], size[rare] = len(known) + starts[answer], lengths[answer]
            out = {c: t.column(c).combine_chunks().take(pa.array(docs)) for c in ("row", "doc_id", "sha256")}
            yield out | {"ids": as_list(np.concatenate([known, flat])[spans(begin, size)], ends_of(counts, size), pa.int32()),
                         "sizes": as_list(size, np.r_[0, np.cumsum(counts)], pa.int32())}

    rare = src.select("row", F.posexplode("rare").alias("nth", "word")).select("row", "nth", *both_hashes("word"))
    met = rare.join(words.table.select(*both_hashes("word"), "ids"), ["k1", "k2"]).select("row", "nth", "ids")
    both = src.select("row", F.lit(-1).alias("nth"), F.col("codes").alias("ids"), "doc_id", "sha256").unionByName(met, allowMissingColumns=True)
    dealt = both.repartition("row").sortWithinPartitions("row", "nth")
    return map_arrow(dealt, run, f"row long, doc_id {src.schema['doc_id'].dataType.simpleString()}, sha256 string, ids array<int>, sizes array<int>")


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """row, doc_id, ids: every document's ids in order. Null and empty texts have none; an empty table gives no rows."""
    words = coded_words(docs, pieces, text_col, frequent)
    return put_together(asked(docs, words, id_col, text_col), words).select("row", "doc_id", "ids")


def decode(coded: DataFrame, pieces: Pieces, ids_col: str = "ids", front: str = " ") -> DataFrame:
    """Add ``decoded``: the text of a list of ids, without the mark in ``front`` of it (of a word, "" keeps it)."""
    octets = pa.array([bytes([pieces.bytes_[i]]) if i in pieces.bytes_ and t.startswith("<0x") else t.encode() for i, t in enumerate(pieces.texts)], pa.binary())

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.concat_arrays([texts(ids.slice(at, TEXTS)) for at in range(0, max(len(ids), 1), TEXTS)])

    def texts(ids: pa.Array) -> pa.Array:
        rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))]), pa.int32()),
                                        octets.take(ids.flatten()))
        joined = pc.binary_join(rows, b"")
        try:
            out = joined.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            out = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
        return pc.replace_substring_regex(pc.replace_substring(out, MARK, " "), f"^{front}", "", max_replacements=1)

    return coded.withColumn("decoded", text(F.col(ids_col)))


def word_digests(ids: pa.Array, sizes: pa.Array) -> pa.Array:
    """Of each list of ids, by the sizes of its words: the digest of ``digests``."""
    import zlib

    numbers = np.arange(1 + (pc.max(ids.flatten()).as_py() or 0))
    alone, behind = (np.array([zlib.crc32(form % i) for i in numbers.tolist()], "uint32") for form in (b"%d", b",%d"))
    width = 2 + sum((numbers >= 10 ** k).astype("int64") for k in range(1, 10))  # of a number with a comma
    tables = shift_tables(4)

    def of(ids, sizes):
        flat, size = (x.flatten().to_numpy(zero_copy_only=False).astype("int64") for x in (ids, sizes))
        start, crc = np.cumsum(size) - size, np.zeros(len(size), "uint32")
        going, k = np.flatnonzero((size > 0) & (size <= MANY_IDS)), 0
        while len(going):  # the CRC of the ids so far, shifted by the next one's characters, and that of the next one
            x = flat[start[going] + k]
            crc[going] = shift(crc[going], width[x], tables) ^ behind[x] if k else alone[x]
            k += 1
            going = going[size[going] > k]
        for i in np.flatnonzero(size > MANY_IDS).tolist():
            crc[i] = zlib.crc32(",".join(map(str, flat[start[i]:start[i] + size[i]].tolist())).encode())
        counts = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False)
        first = np.cumsum(counts) - counts
        place = (np.arange(len(size)) - np.repeat(first, counts) + 1) * FACTOR % PRIME
        sums = np.concatenate([[0], np.cumsum(crc.astype("int64") % PRIME * place % PRIME)])  # below 2^63 for 2^32 words
        return (sums[first + counts] - sums[first]) % PRIME

    return pa.array(np.concatenate([of(ids.slice(at, TEXTS), sizes.slice(at, TEXTS)) for at in range(0, max(len(ids), 1), TEXTS)]), pa.int64())


def digests(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``, from its whole list of ids and the text decoded from it: doc_id, n_words, n_pieces, exact
    (the decoded text is the text, by their SHA-256), ids_digest: the sum over words, numbered i from 0, of crc32(the word's ids as decimal
    text with commas) * (FACTOR * (i + 1) mod PRIME) mod PRIME. Null and empty texts have 0 words; repeated rows come back
    as often as they occur; an empty table gives no rows; other columns are not read. Texts are taken in PARTS parts by a
    hash of the id, so the disk holds the shuffled texts and words of one at a time."""
    words = coded_words(docs, pieces, text_col, frequent)
    digest = F.arrow_udf(word_digests, "long")
    out = []
    for part in range(PARTS):
        src = asked(docs.where(F.pmod(F.xxhash64(id_col), F.lit(PARTS)) == part), words, id_col, text_col)
        coded = decode(put_together(src, words), pieces).select(
            F.col("doc_id").cast("long").alias("doc_id"), F.size("sizes").cast("long").alias("n_words"), F.size("ids").cast("long").alias("n_pieces"),
            (sha256(F.col("decoded")) == F.col("sha256")).alias("exact"), digest("ids", "sizes").alias("ids_digest"))
        out.append(stored(coded, "digests"))
        discard(src)
    return reduce(DataFrame.unionAll, out)
