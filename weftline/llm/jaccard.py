"""Exact Jaccard self-join of documents over word shingles.

Method: size-banded tiles with hashed bitmap signatures.

1.  Each document becomes the sorted array of the hashes of its distinct shingles and a
    bitmap signature: bit ``h mod W`` is flipped for each hash h, where W is the power of
    two at or above its size.  Two bitmaps differ in at most as many bits as the sets
    differ in elements, so the count of differing bits bounds the overlap from above.
2.  Documents meet in tiles.  Sets of similarity t share an element among the first
    n - ceil(t n) + 1 of any common order; the order is by hash, elements that very many
    documents have coming last, so that boilerplate opens no tile.  A tile holds the
    documents with one such element; within it only sizes within the band 1 : 1/t are
    compared, by bit counts.  What survives is kept as a spanning forest.
3.  Forests make coarse classes, outside which there is no link.  Each class is dealt into
    exact tiles (large classes by size band and block); there, sorted arrays are
    intersected, and every link between still unconnected documents is found.
4.  Components of the verified links are the classes.

Copies with equal sets that a task meets again are linked at once and go no further; those
of different tasks are found by the digests of their sets, and only the one with the
smallest id has its bitmap and array compared.  Nothing is dropped, capped or sampled.  The list of frequent elements is bounded by a share of the corpus (at most
``avg size / (FREQUENT / 4)`` entries for any corpus) and only sets an order and how tiles
are counted: those of frequent elements by partial sums that are sent to all tasks (a row
for each entry), so that no task gathers the documents of one; the others travel as packed
arrays in hash buckets of about ``PAIRS`` each.  Blocks of tiles are bounded by rows and by
bytes of bitmaps.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer
words than a shingle make one shingle; rows with the same id are one document in links and
keep a row each; a null id is never linked and its class is null; other columns are not read.
``keep_first`` judges rows: where an id repeats, each of its rows is linked, kept or removed
by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textblocks as tb
from weftline.llm.components import components
from weftline.llm.sieve import Sieve
from weftline.llm.spill import arrow_rows, release, settle, table

WIDTH = 5
#: The least similarity, as a fraction of integers.
NUMER, DENOM = 4, 5
#: Elements that about this share of documents have are put last in the order.
FREQUENT = 0.005
FREQUENT_ENTRIES = 500_000
#: Rows and bytes of bitmaps of a tile, and shingles of an exact tile, beyond which it is dealt into blocks.
TILE_ROWS, TILE_BYTES, TILE_SHINGLES = 4096, 16 << 20, 3_000_000
#: Elements of prefixes, each with its document, in a bucket in which tiles are told.
PAIRS, MOST_TASKS = 1 << 19, 50_000
_CHUNK, _PACKED = 1_000_000, 500_000
_SEEN = 100_000
#: Documents that go to a Python worker at once.
ARROW_ROWS = 1000

BASE = "row_key long, n_shingles int, same_as long, bits binary, keys array<long>, late int, print binary"


def sets_of(offsets: np.ndarray, data: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    hashes, first = tb.shingles_of(tb.words_of(offsets, data, tb.SPACE_SPLIT), width)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]


def signature(s: np.ndarray) -> bytes:
    w = max(64, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(bits_apart: np.ndarray, a, b, numer: int, denom: int) -> np.ndarray:
    """Whether sets of sizes a and b that differ in at least ``bits_apart`` elements can have similarity numer/denom: |A ^ B| <= (a + b) (1 - t) / (1 + t)."""
    return bits_apart * (denom + numer) <= (a + b) * (denom - numer)


def _each_block(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        offsets, data = tb.string_parts(batch.column(1))
        for a, b in tb.blocks(offsets):
            yield batch.column(0).slice(a, b - a), offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]


def _frequent(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0

        def out():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= max(8, int(FREQUENT * docs))
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some])], names=["h", "c"])

        for _, offsets, data in _each_block(batches):
            hashes, _ = tb.shingles_of(tb.words_of(offsets, data, tb.SPACE_SPLIT), width)
            held.append(hashes)
            docs, size = docs + len(offsets) - 1, size + len(hashes)
            if size >= _CHUNK:
                yield out()
                held, docs, size = [], 0, 0
        if size:
            yield out()

    return count


def frequent_elements(narrow: DataFrame, width: int) -> np.ndarray:
    """Hashes that stand out in blocks of the corpus and in all of it, sorted.  Every document is read."""
    n = narrow.count()
    counted = narrow.mapInArrow(tb.frugal(_frequent(width)), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = counted.where(F.col("c") >= max(8.0, FREQUENT / 4 * n)).orderBy(F.desc("c"), "h").limit(FREQUENT_ENTRIES).select("h").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)


def _signer(width: int, numer: int, denom: int, frequent_of):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = frequent_of.value
        some = np.zeros(1 << 22, dtype=bool)
        some[(frequent >> np.uint64(42)).astype(np.int64)] = True
        seen: dict[bytes, int] = {}
        for keys, offsets, data in _each_block(batches):
            out = []
            for key, s in zip(keys.to_pylist(), sets_of(offsets, data, width)):
                n = len(s)
                if not n or key is None:
                    out.append((key, n, None, None, None, None, None))
                    continue
                print_ = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                same = seen.get(print_)
                if same is not None:
                    out.append((key, n, same, None, None, None, None))
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen[print_] = key
                length = n - -(-numer * n // denom) + 1
                late = some[(s >> np.uint64(42)).astype(np.int64)]
                if late.any():
                    late &= np.isin(s, frequent)
                    ordered = np.concatenate([s[~late], s[late]])
                else:
                    ordered = s
                out.append((key, n, None, signature(s), ordered[:length].view(np.int64), max(0, length - int(n - late.sum())), print_))
            cols = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in BASE.split(", ")])

    return sign


PACKED = "bucket int, least long, rows binary, sizes binary, keys binary"


def _packer(buckets: int):
    """From rows (row_key, size, keys): the elements of prefixes by hash bucket, with the document and the binary order of its bitmap's size, packed."""

    def packed(rows: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        bucket = (tb.mix(keys) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, sizes, keys, bucket = rows[order], sizes[order], keys[order], bucket[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        least = int(rows.min())
        moved = rows - least
        moved = moved.astype(np.uint32) if moved.max() < 1 << 32 and int(rows.max()) - least < 1 << 32 else moved
        part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array([least] * (len(cuts) - 1), pa.int64()), part(moved), part(sizes), part(keys)], names=["bucket", "least", "rows", "sizes", "keys"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            counts = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.array([max(0, int(x) - 1).bit_length() for x in batch.column(1).to_pylist()], np.uint8)
            held.append((np.repeat(batch.column(0).to_numpy(), counts), np.repeat(order, counts), keys))
            n += len(keys)
            if n >= _PACKED:
                yield packed(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*held)))

    return pack


def _told(tile_rows: int, tile_bytes: int):
    """From packed rows sorted by bucket: (s, t, blocks, row_key) of each document of each tile, tiles of the same documents once."""

    def told_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in runs(batches, 1):
            parts = list(zip(*(bucket.column(i).to_pylist() for i in range(1, 5))))
            keys = np.concatenate([np.frombuffer(k, np.uint64) for *_, k in parts])
            rows = np.concatenate([np.frombuffer(r, np.int64 if len(r) == len(k) else np.uint32).astype(np.int64) + least for least, r, _, k in parts])
            sizes = np.concatenate([np.frombuffer(s, np.uint8) for *_, s, _ in parts])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            m = np.diff(np.append(begins, len(keys)))
            # Only elements of two documents and more make a tile.
            order = order[np.repeat(m > 1, m)]
            m = m[m > 1]
            if not len(m):
                continue
            begins = np.concatenate([[0], np.cumsum(m)[:-1]])
            rows, sizes = rows[order], sizes[order]
            hashed = tb.mix(rows.view(np.uint64))
            s, t = np.add.reduceat(hashed, begins), np.add.reduceat(tb.mix(hashed + np.uint64(7)), begins)
            blocks = np.maximum(-(-m // tile_rows), -(-np.add.reduceat(1 << sizes.astype(np.int64), begins) // tile_bytes))
            # Elements with the same documents make one tile.
            by = np.lexsort((t, s))
            once = np.zeros(len(s), dtype=bool)
            once[by] = np.concatenate([[True], (s[by][1:] != s[by][:-1]) | (t[by][1:] != t[by][:-1])])
            rows, m = rows[np.repeat(once, m)], m[once]
            columns = [np.repeat(x[once], m) for x in (s.view(np.int64), t.view(np.int64), blocks.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, rows)], names=["s", "t", "blocks", "row_key"])

    return told_of


class Group:
    """Documents of one tile, by ascending id, with bitmaps by width."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, bits: list[bytes]):
        self.ids, self.sizes = ids, sizes.astype(np.int64)
        self.width = np.array([len(b) for b in bits])
        self.of = {int(w): np.flatnonzero(self.width == w) for w in np.unique(self.width)}
        self.bits = {w: np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), w // 8) for w, rows in self.of.items()}
        self.at = np.zeros(len(ids), int)
        for rows in self.of.values():
            self.at[rows] = np.arange(len(rows))

    @staticmethod
    def _half(x: np.ndarray) -> np.ndarray:
        h = x.shape[-1] // 2
        return x[..., :h] ^ x[..., h:]

    def near(self, seed: int, open_: np.ndarray, numer: int, denom: int) -> np.ndarray:
        """Open documents that the sizes and the bit counts allow to link with the seed."""
        w = int(self.width[seed])
        own = self.bits[w][self.at[seed]]
        found = []
        for other in (w // 2, w, 2 * w):
            rows = self.of.get(other)
            if rows is None:
                continue
            rows = rows[open_[rows]]
            sizes, size = self.sizes[rows], self.sizes[seed]
            rows = rows[(np.minimum(sizes, size) * denom >= np.maximum(sizes, size) * numer)]
            if not len(rows):
                continue
            theirs = self.bits[other][self.at[rows]]
            apart = np.bitwise_count(theirs ^ own if other == w else (theirs ^ self._half(own) if other < w else self._half(theirs) ^ own)).sum(axis=1, dtype=np.int64)
            found.append(rows[may_link(apart, self.sizes[rows], self.sizes[seed], numer, denom)])
        return np.concatenate(found) if found else np.zeros(0, int)

    def forest(self, numer: int, denom: int, exact=None) -> Iterator[tuple[int, int]]:
        """Links that connect all that may link, or that do by ``exact``; each is between a reached document and one not yet reached."""
        open_ = np.ones(len(self.ids), dtype=bool)
        for start in range(len(self.ids)):
            if not open_[start]:
                continue
            open_[start] = False
            queue = [start]
            while queue:
                seed = queue.pop()
                new = self.near(seed, open_, numer, denom)
                if exact is not None and len(new):
                    new = new[exact(seed, new)]
                open_[new] = False
                for i in new.tolist():
                    queue.append(i)
                    if self.ids[i] != self.ids[seed]:
                        yield int(self.ids[seed]), int(self.ids[i])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal values in the first ``keys`` columns, from a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            value = tuple(c[a] for c in cols)
            if held and value != last:
                yield pa.Table.from_batches(held)
                held = []
            last = value
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tiles(numer: int, denom: int):
    """From rows (s, t, i, j, row_key, n, bits) sorted by tile: the coarse forest."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        told: set[tuple[int, int]] = set()
        for tile in runs(batches, 4):
            ids = tile.column(4).to_numpy()
            if len(ids) < 2:
                continue
            name = ids.tobytes()
            name = name if len(name) <= 64 else hashlib.blake2b(name, digest_size=16).digest()
            if name in seen:
                continue
            if len(seen) >= _SEEN:
                seen.clear()
            seen.add(name)
            group = Group(ids, tile.column(5).to_numpy(), tile.column(6).to_pylist())
            new = [p for p in group.forest(numer, denom) if p not in told]
            if len(told) + len(new) > _SEEN:
                told.clear()
            told.update(new)
            if new:
                yield _pairs(new)

    return join


def _arrays(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = tb.string_parts(batch.column(1))
            for a, b in tb.blocks(offsets):
                sets = sets_of(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) if len(s) else b"\0" * 8 for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["row_key", "n", "bits", "elements"],
                )

    return make


def _exact_tiles(numer: int, denom: int):
    """From rows (class, band, i, j, row_key, n, bits, elements) sorted by tile: verified links."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, 4):
            if tile.num_rows < 2:
                continue
            arrays = [np.frombuffer(e, np.uint64) for e in tile.column(7).to_pylist()]
            group = Group(tile.column(4).to_numpy(), tile.column(5).to_numpy(), tile.column(6).to_pylist())

            def exact(seed: int, others: np.ndarray) -> np.ndarray:
                own = arrays[seed]
                parts = [arrays[i] for i in others]
                all_ = np.concatenate(parts)
                at = np.searchsorted(own, all_)
                at[at == len(own)] = 0
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts[:-1]])]).astype(int)
                shared = np.add.reduceat((own[at] == all_).astype(np.int64), starts)
                return shared * denom >= (group.sizes[seed] + group.sizes[others] - shared) * numer

            links = list(group.forest(numer, denom, exact))
            if links:
                yield _pairs(links)

    return join


def _dealt(rows: DataFrame, blocks: F.Column, on: str) -> DataFrame:
    """rows with (i, j): tiles of one block have (0, 0); of more, each pair of blocks, and a row goes to the pairs of its own block."""
    rows = rows.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(3), on), F.col("nb")).cast("int"))
    pairs = F.when(F.col("nb") <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), (F.greatest("nb", F.lit(1)) - 1).cast("int")), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    )
    return rows.withColumn("ij", pairs)


def _equal_sets(base: DataFrame) -> DataFrame:
    """(row_key, first, print) of rows whose set another task has met too, under a smaller id: the first."""
    rows = base.where("print is not null").select("row_key", "print")
    first = rows.groupBy("print").agg(F.min("row_key").alias("first"), F.max("row_key").alias("last")).where("first < last").select("print", "first")
    return rows.join(first, "print").where("row_key <> first")


def _coarse_classes(base: DataFrame, equal: DataFrame, numer: int, denom: int) -> DataFrame:
    """(id, component) by the forests of all tiles: no link leaves such a class, but those of equal sets."""
    # Tiles of two documents and more, told by two hashes of the set of their ids: copies share very many elements, and tiles of the same documents become one.
    of = {"m": F.count("*"), "s": F.bit_xor(F.xxhash64("row_key")), "t": F.bit_xor(F.xxhash64(F.lit(7), "row_key")), "w": F.sum("size")}
    blocks = F.greatest(F.ceil(F.col("m") / F.lit(TILE_ROWS)), F.ceil(F.col("w") / F.lit(TILE_BYTES))).cast("int").alias("blocks")
    rows = base.where("keys is not null").select("row_key", F.octet_length("bits").cast("long").alias("size"), "keys", (F.size("keys") - F.col("late")).alias("first"), "late")
    buckets = -(-rows.agg(F.coalesce(F.sum("first"), F.lit(0))).first()[0] // PAIRS) or 1
    packed = rows.where("first > 0").select("row_key", "size", F.slice("keys", F.lit(1), F.col("first")).alias("keys")).mapInArrow(tb.frugal(_packer(buckets)), PACKED)
    some = packed.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(tb.frugal(_told(TILE_ROWS, TILE_BYTES)), "s long, t long, blocks int, row_key long")
    # Each of the frequent elements gets a row of sums, at most FREQUENT_ENTRIES of them.
    late = rows.where("late > 0").select("row_key", "size", F.explode(F.slice("keys", F.col("first") + 1, F.col("late"))).alias("key"))
    sums = late.groupBy("key").agg(*(v.alias(k) for k, v in of.items())).where("m > 1")
    many = late.join(F.broadcast(sums), "key").select("s", "t", blocks, "row_key")
    met = some.unionByName(many).distinct()
    met = _dealt(met, F.col("blocks"), "row_key").select("s", "t", "row_key", F.explode("ij").alias("ij"))
    bits = base.where("keys is not null").select("row_key", "n_shingles", "bits", "print").join(equal.select("row_key", F.col("print").alias("as")), "row_key", "left")
    met = met.join(bits.where("`as` is null or `as` <> print"), "row_key")
    tiles = met.select("s", "t", "ij.i", "ij.j", "row_key", "n_shingles", "bits").repartition("s", "t", "i", "j").sortWithinPartitions("s", "t", "i", "j", "row_key")
    return components(tiles.mapInArrow(tb.frugal(_tiles(numer, denom)), "a long, b long"))


def link(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, numer: int = NUMER, denom: int = DENOM) -> tuple[DataFrame, DataFrame]:
    """(row_key, n_shingles) of every row, and (id, component) of every document that is not the first of its class."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _link(docs, key, text, width, numer, denom)


def _link(docs: DataFrame, key: str, text: str, width: int, numer: int, denom: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_elements(narrow, width))
    base = table(narrow.mapInArrow(tb.frugal(_signer(width, numer, denom, frequent)), BASE))

    release(spark)
    equal = settle(_equal_sets(base))
    coarse = _coarse_classes(base, equal, numer, denom)
    release(spark)

    # Exact tiles of each coarse class.
    member = coarse.unionByName(coarse.select(F.col("component").alias("id"), "component").distinct())
    member = member.join(base.where("keys is not null").select(F.col("row_key").alias("id"), F.col("n_shingles").alias("n")).distinct(), "id")
    member = member.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(denom / numer))).cast("int"))
    whole = member.groupBy("component").agg(F.sum("n").alias("total"))
    member = member.join(whole, "component")
    small = F.col("total") <= TILE_SHINGLES
    # Of a large class, sizes that can link are in the same band of sizes or in neighbouring ones; a tile holds a band and the next.
    member = member.withColumn("band", F.explode(F.when(small, F.array(F.lit(-1))).otherwise(F.array(F.col("band"), F.col("band") + 1))))
    banded = member.groupBy("component", "band").agg(F.sum("n").alias("in_band"))
    member = _dealt(member.join(banded, ["component", "band"]), F.ceil(F.col("in_band") / F.lit(TILE_SHINGLES)), "id")
    member = member.groupBy("id").agg(F.flatten(F.collect_list(F.transform("ij", lambda p: F.struct("component", "band", p["i"].alias("i"), p["j"].alias("j"))))).alias("tiles"))
    # Sorted arrays are made where texts are read, of documents that may be in a class; texts never move.
    near = Sieve(coarse.select("id").unionByName(coarse.select(F.col("component").alias("id")).distinct()), "id").rows(narrow, "row_key", True)
    arrays = near.mapInArrow(tb.frugal(_arrays(width)), "row_key long, n int, bits binary, elements binary").where("n > 0")
    # Both sides grow with the corpus, so the plan is the same at every size.
    exact = arrays.join(member.withColumnRenamed("id", "row_key").hint("merge"), "row_key").select(F.explode("tiles").alias("t"), "row_key", "n", "bits", "elements").select("t.component", "t.band", "t.i", "t.j", "row_key", "n", "bits", "elements")
    exact = exact.repartition("component", "band", "i", "j").sortWithinPartitions("component", "band", "i", "j", "row_key")
    links = exact.mapInArrow(tb.frugal(_exact_tiles(numer, denom)), "a long, b long")
    copies = base.where("same_as is not null").select(F.col("row_key").alias("a"), F.col("same_as").alias("b")).unionByName(equal.select(F.col("row_key").alias("a"), F.col("first").alias("b")))
    return base.select("row_key", "n_shingles"), components(links.unionByName(copies))


def contract(spark, sf_dir: str) -> DataFrame:
    """The digest of op1 for every document."""
    sizes, classes = link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = sizes.join(classes.withColumnRenamed("id", "row_key"), "row_key", "left")
    return out.select(F.col("row_key").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "row_key").alias("component_id"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, that with the smallest id; rows that link with nothing stay, and so do rows without an id.

    Where ids repeat, rows are numbered first (which keeps a copy of the stage's input in the
    shared folder) and judged each by its own text: of identical rows one stays.
    """
    spark, names = docs.sparkSession, docs.columns
    if docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        _, classes = link(docs, key=key, text=text)
        release(spark)
        return _without(docs, classes.select(F.col("id").alias(key)), key)
    row = "row_"
    while row in {c.lower() for c in names}:
        row += "_"
    numbered = table(docs.withColumn(row, F.when(F.col(key).isNotNull(), F.monotonically_increasing_id())))
    _, classes = link(numbered, key=row, text=text)
    release(spark)
    member = classes.unionByName(classes.select(F.col("component").alias("id"), "component").distinct())
    member = member.join(numbered.select(F.col(row).alias("id"), F.col(key).alias("own")), "id")
    first = member.groupBy("component").agg(F.min(F.struct("own", "id")).alias("first"))
    gone = member.join(first, "component").where("id <> first.id").select(F.col("id").alias(row))
    return _without(numbered, gone, row).select(*names)


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs without the keys in gone; only rows that may be among them are moved."""
    sieve = Sieve(gone, key)
    moved = sieve.rows(docs, key, True).join(gone, key, "left_anti").select(*docs.columns)
    return sieve.rows(docs, key, False).unionByName(moved)
