"""Exact Jaccard self-join on word shingles: size-banded tiles, bitmap signatures, sorted-array intersection.

*Tiles.* Sets are banded by size so that linked sets lie in one band or in neighbouring ones. Two sets linked in
band j differ in at most D elements; the hash space is cut into D + 1 + spare slices, so in at least 1 + spare
slices they hold the same elements. A tile is (band, slice, what the set holds there): linked sets always share
one. Slices with very few elements, which unlinked sets share by chance, are left out where a set has no more than
``spare`` of them; a set with more sends all of its slices, which keeps the guarantee for any pair. Near copies share
many tiles: tiles of the same members are kept once.

*Signatures.* 512 bits, bit b the parity of the number of elements hashed to b. The bits in which two signatures
differ are at most the elements in which the sets differ, so bit counts bound the overlap from above.

*Links.* Inside a tile sets are first compared with the tile's centre (linear in the tile), then only members of
different components are, by bit counts inside the join; what passes both is decided by intersecting the sorted
hash arrays; only the sets of such pairs travel, in parts that hold no more than all sets do. Equal sets are one class with a number of its own throughout, so ids that occur with several texts keep
all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_list, discard, map_arrow, slices, stored, worker_state
from quarry.llm.components import components

WORDS_KEPT = 150_000
BITS = [f"b{i}" for i in range(8)]
#: Members of a tile that a task holds to see whether another tile has the same; a larger tile stays as it is.
TILE_HELD = 1 << 20
#: Ids of compared sets up to which they are broadcast to the table of sets instead of shuffling it.
IDS_SENT = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _shingler(width: int):
    """A function from a text to the sorted distinct 64-bit hashes of its shingles of ``width`` words."""
    import xxhash

    known = worker_state("shingle words", dict)
    digest = xxhash.xxh3_64_intdigest
    odd = _mix(np.arange(1, width + 1, dtype="uint64")) | _U(1)

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, "uint64")
        if len(known) > WORDS_KEPT:
            known.clear()
        get = known.get
        h = [get(w) for w in words]
        for i, x in enumerate(h):
            if x is None:
                h[i] = known[words[i]] = digest(words[i])
        h = np.array(h, "uint64")
        if len(h) < width:
            return _mix((h * odd[:len(h)]).sum(keepdims=True) ^ _U(len(h)))
        total = h[:len(h) - width + 1] * odd[0]
        for i in range(1, width):
            total = total + h[i:len(h) - width + 1 + i] * odd[i]
        return np.unique(_mix(total))

    return shingles


class Bands:
    """Size bands for a threshold num/den: for band j its smallest size, largest partner, slices, spare, thin."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40, slack: float = 0.15):
        self.low, self.rows = [1], []
        while self.low[-1] <= largest:
            self.low.append(self.low[-1] * den // num + 1)
        for lo, nxt in zip(self.low, self.low[1:], strict=False):
            a = nxt - 1
            b = a * den // num
            differ = (a + b) * (den - num) // (den + num)
            spare = math.ceil(slack * (differ + 1))
            k = differ + 1 + spare
            # leave out slices of fewer than `thin` elements: as many as the smallest set of the band is likely to spare
            thin, share, term = 0, 0.0, math.exp(-lo / k)
            while thin < 8:
                share += term
                if share * k + math.sqrt(share * k) > spare:
                    break
                thin += 1
                term *= lo / k / thin
            self.rows.append((b, differ, k, spare, thin))
        self.low = np.array(self.low, "int64")

    def tiles(self, x: np.ndarray) -> np.ndarray:
        """Tile keys of a set of sorted hashes (equal sets are classes already: bands with no difference send none)."""
        n, out = len(x), []
        if not n:
            return np.empty(0, "int64")
        home = int(np.searchsorted(self.low, n, side="right")) - 1
        sums = None
        for j in (home, home - 1):
            if j < 0 or not self.rows[j][1] or n > self.rows[j][0]:
                continue
            _, _, k, spare, thin = self.rows[j]
            if sums is None:
                sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(_mix(x), dtype="uint64")])
            ends = np.searchsorted(((x >> _U(32)) * _U(k)) >> _U(32), np.arange(k + 1, dtype="uint64"))
            held = np.diff(ends)
            keys = _mix(np.diff(sums[ends]) + _mix(np.arange(k, dtype="uint64") + _U(j << 32)) + held.astype("uint64"))
            few = held < thin
            out.append(keys[~few] if few.sum() <= spare else keys)
        return np.concatenate(out).view("int64") if out else np.empty(0, "int64")


def _signature(x: np.ndarray) -> np.ndarray:
    bits = np.bincount(((x * _U(0xD6E8FEB86659FD93)) >> _U(55)).astype("int64"), minlength=512) & 1
    return np.packbits(bits.astype("uint8")).view("int64")


def set_sizes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest (d1, d2) of each document's shingle set."""
    def run(batches):
        import xxhash

        shingles = _shingler(width)
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "int64").reshape(-1, 2)
            yield {"doc_id": b.column(0), "n_shingles": [len(s) for s in sets], "d1": both[:, 0], "d2": both[:, 1]}

    return map_arrow(docs, run, "doc_id long, n_shingles long, d1 long, d2 long")


def _own_sets(batch: pa.RecordBatch, shingles) -> tuple[pa.Array, list]:
    """Class numbers and shingle sets of rows (id, text, d1, d2), without rows whose text is not their class's (another
    text of the same doc_id)."""
    import xxhash

    sets = [shingles(t) for t in batch.column(1).to_pylist()]
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "int64").reshape(-1, 2)
    own = (digest[:, 0] == batch.column(2).to_numpy()) & (digest[:, 1] == batch.column(3).to_numpy())
    return batch.column(0).filter(pa.array(own)), [s for s, x in zip(sets, own, strict=True) if x]


def _tile_rows(texts: DataFrame, width: int, bands: Bands) -> DataFrame:
    def run(batches):
        shingles = _shingler(width)
        for b in slices(batches):
            ids, sets = _own_sets(b, shingles)
            if not sets:
                continue
            keys = [bands.tiles(s) for s in sets]
            yield {"id": ids, "keys": as_list(np.concatenate(keys), np.cumsum([0] + [len(k) for k in keys]), pa.int64())}

    return map_arrow(texts, run, "id long, keys array<long>").select("id", F.explode("keys").alias("tile"))


def _shared_tiles(rows: DataFrame) -> DataFrame:
    """(tile, id) of tiles with two members or more, those of the same members once: one shuffle, sorted by tile, each tile
    named by the hash of its members. (Names that meet by chance make one tile of two, which compares more.)"""
    def named(tile, ids, starts):
        sizes = np.diff(np.append(starts, len(ids)))
        names = _mix(np.add.reduceat(_mix(ids.view("uint64")), starts)).view("int64") if tile is None else np.full(len(starts), tile)
        shared = np.repeat(sizes > 1, sizes)
        return {"tile": np.repeat(names, sizes)[shared], "id": ids[shared]}

    def run(batches):
        last, held, large = None, [], False  # the tile that may go on in the next batch, its members, it keeps its own name

        def ended():
            return named(last if large else None, np.concatenate(held), np.zeros(1, int))

        for b in batches:
            tile, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            if tile[0] == last:
                held.append(ids[:starts[1] if len(starts) > 1 else None])
                if len(starts) == 1:
                    if sum(map(len, held)) > TILE_HELD:
                        large = True
                        yield ended()
                        held = [ids[:0]]
                    continue
                starts = starts[1:]
            if last is not None:
                if large:  # parts of a shared tile, of any size
                    rest = np.concatenate(held)
                    yield {"tile": np.full(len(rest), last), "id": rest}
                else:
                    yield ended()
            if len(starts) > 1:
                yield named(None, ids[starts[0]:starts[-1]], starts[:-1] - starts[0])
            last, held, large = int(tile[-1]), [ids[starts[-1]:]], False
        if last is not None:
            if large:
                rest = np.concatenate(held)
                yield {"tile": np.full(len(rest), last), "id": rest}
            else:
                yield ended()

    dealt = rows.select("tile", "id").repartition("tile").sortWithinPartitions("tile")
    return map_arrow(dealt, run, "tile long, id long").distinct()


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """id, n, the signature's words and the sorted hashes, kept as signed longs in the order of their bits."""
    def run(batches):
        shingles = _shingler(width)
        for b in slices(batches):
            ids, sets = _own_sets(b, shingles)
            if not sets:
                continue
            bits = np.stack([_signature(s) for s in sets])
            hashes = as_list(np.concatenate(sets).view("int64"), np.cumsum([0] + [len(s) for s in sets]), pa.int64())
            yield {"id": ids, "n": [len(s) for s in sets], **{c: bits[:, i] for i, c in enumerate(BITS)}, "hashes": hashes}

    return map_arrow(texts, run, "id long, n int, " + "".join(f"{c} long, " for c in BITS) + "hashes array<long>")


def _may_link(x: str, y: str, num: int, den: int):
    """The sizes and bit counts of rows x and y leave room for a link."""
    n, m = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in BITS), F.lit(0))
    # overlap <= (n + m - differ) / 2, and a link needs (num + den) * overlap >= num * (n + m)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & ((n + m - differ) * (num + den) >= 2 * num * (n + m))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sorted hash arrays overlap enough."""
    def run(batches):
        for b in batches:
            keep = []
            (xo, x), (yo, y) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (b.column(2), b.column(3)))
            for i in range(b.num_rows):
                u, v = x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(den * both >= num * (len(u) + len(v) - both))
            yield {"a": b.column(0).filter(pa.array(keep)), "b": b.column(1).filter(pa.array(keep))}

    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "compared")
    few = ids.count() <= IDS_SENT
    s = sets.select("id", "hashes").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    full = (pairs.join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b").select("a", "b", "x", "y"))
    return map_arrow(full, run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int, room: int) -> DataFrame | None:
    """``_verify`` of the pairs (a, b, n: elements of a), stored; in parts whose sets a hold about ``room`` elements, however
    many pairs there are."""
    pairs = stored(pairs, "pairs")
    parts = -(-(pairs.agg(F.sum("n")).first()[0] or 0) // max(room, 1))
    links = None
    for part in range(parts):
        some = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part)
        found = stored(_verify(some.select("a", "b"), sets, num, den), "links")
        links = found if links is None else links.union(found)
    discard(pairs)
    return links


def near_duplicate_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id",
                          text_col: str = "text", centre_rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of ``width`` words (words split at white space, A-Z lowered); with
    fewer words the whole sequence is one shingle; null, empty and blank texts have the empty set and link with
    nothing. Documents link when intersection / union >= num / den; component_id is the smallest doc_id reachable
    by links, its own included. A null doc_id takes no part and gets a null component. Rows of one doc_id are one
    document, whatever links one of its texts has; its rows without words keep their own id. An empty table gives no
    rows; other columns are not read."""
    bands = Bands(num, den)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes = stored(set_sizes(src, width), "sizes")
    some = sizes.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def texts(of):
        return src.join(of.select("doc_id", "id", "d1", "d2"), "doc_id").select("id", "text", "d1", "d2")

    tiles = stored(_shared_tiles(_tile_rows(texts(classes), width, bands)), "tiles")
    members = classes.join(tiles.select("id").distinct(), "id")
    sets = stored(_sets(texts(members), width), "sets")
    count = sets.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.sum("n").alias("room")).first()
    if count["rows"] > count["ids"]:  # rows that occur several times
        again, sets = sets, stored(sets.dropDuplicates(["id"]), "sets")
        discard(again)
    short = sets.drop("hashes")

    links = group = None
    now_tiles = tiles
    for turn in range(centre_rounds + 1):
        now = now_tiles
        if group is not None:  # tiles whose members are not in one component yet
            now = now.drop("g").join(group, "id", "left").withColumn("g", F.coalesce("g", "id"))
            mixed = now.groupBy("tile").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("tile")
            now = now.join(mixed, "tile", "left_semi")
        else:
            now = now.withColumn("g", F.col("id"))
        before, now_tiles = now_tiles, stored(now, "open")
        discard(before)
        if now_tiles.isEmpty():
            break
        full = now_tiles.join(short, "id")
        if turn < centre_rounds:
            centre = now_tiles.groupBy("tile").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("id"))
            centre = centre.join(now_tiles.groupBy("id").agg(F.first("g").alias("g")), "id").join(short, "id")
            near = full.alias("x").join(centre.alias("y"), F.col("x.tile") == F.col("y.tile"))
            near = near.where((F.col("x.g") != F.col("y.g")) & _may_link("x", "y", num, den))
        else:
            near = full.alias("x").join(full.alias("y"), (F.col("x.tile") == F.col("y.tile")) & (F.col("x.id") < F.col("y.id"))
                                        & (F.col("x.g") != F.col("y.g")) & _may_link("x", "y", num, den))
        pairs = near.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"),
                            F.when(F.col("x.id") < F.col("y.id"), F.col("x.n")).otherwise(F.col("y.n")).alias("n")).distinct()
        found = _links(pairs, sets, num, den, count["room"])
        if found is not None and not found.isEmpty():
            links = found if links is None else links.union(found)
            group = components(links).select("id", F.col("component").alias("g"))

    # a doc_id of several texts links their classes
    key = F.struct("n_shingles", "d1", "d2")
    several = stored(some.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id"), "several")
    if not several.isEmpty():
        theirs = some.join(several, "doc_id").distinct().join(classes.drop("doc_id"), ["n_shingles", "d1", "d2"]).select("doc_id", "id")
        first = theirs.groupBy("doc_id").agg(F.min("id").alias("b"))
        more = theirs.join(first, "doc_id").select(F.col("id").alias("a"), "b")
        links = more if links is None else links.select("a", "b").union(more)
        group = components(links).select("id", F.col("component").alias("g"))

    # classes of equal sets, then their components, named by their smallest doc_id
    ids = classes.withColumn("g", F.col("id"))
    if group is not None:
        ids = classes.join(group, "id", "left").withColumn("g", F.coalesce("g", "id"))
        named = ids.groupBy("g").agg(F.min("doc_id").alias("component_id"))
        ids = ids.join(named, "g")
    else:
        ids = ids.withColumn("component_id", F.col("doc_id"))
    return (sizes.join(ids.select("n_shingles", "d1", "d2", "component_id"), ["n_shingles", "d1", "d2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest doc_id of each group only; columns as they were, rows without a doc_id stay."""
    from quarry.llm.common import free_name

    groups = near_duplicate_groups(docs, width, num, den, id_col, text_col)
    key = free_name(docs, "gone_id")
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[key], "left_anti")
