"""Benchmark decontamination with suffix arrays over the training text.

Method.  Each block of documents is a shard.  The shard's suffix array lists the
places at which a suffix of some test item could match for at least a few words
(their leading words occur in the test set; no other suffix can share that much
with a test suffix), sorted word by word.  Every suffix of every test item is then
binary-searched in every shard: the range of suffixes that share a whole window gives
every occurrence.  Every suffix of the array is binary-searched among the sorted test
suffixes: its two neighbours there give the longest verbatim match of each document and
its place, whatever else is in the shard.  Matches of more than ``DEPTH`` words are followed
to their end by prefix hashes, and matches too short for the array are looked up as words
and pairs.  Documents with a hit are affected and can be removed.

The shards need no shuffle.  The test set travels to the executors in blocks of at
most ``MAX_TEST_BYTES`` of text, ``BLOCKS_SENT`` of them at a time; a worker holds the index
of one block (600 bytes a word while it is made, some 190 MB for a block) and up to ``HELD_BYTES`` of documents, which it takes
through the blocks in turn.  A larger test set takes several rounds, with what rows have so
far kept in the shared folder between them; so what is broadcast and what a worker holds
have bounds for a test set of any size (an item longer than a block is a block of its own).

Defined cases: a null or empty text has no words and no hit; items without words are
ignored; items with a null id are searched like others, and only the list of ids leaves
them out (the registered digest passes over such items); items with fewer words than a window are one window; repeated items count
once for each item id; of a document's longest matches the first is told, with one of the
items that have it; repeated documents are judged row by row; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textblocks as tb
from weftline.llm.spill import table

WINDOW = 10
#: Suffixes are compared word by word for so many words, and by hashes beyond.
DEPTH = 16
MAX_TEST_BYTES, BLOCKS_SENT = 2 << 20, 32
#: Documents that meet one block's index before it makes way for the next, where there are several.
HELD_BYTES = 64 << 20
_BITS = 20

SCHEMA = "row_key long, n_words long, hit_from array<int>, hit_to array<int>, items array<string>, longest int, longest_item string, longest_at int"


class TestSet:
    """Test suffixes of a block of items, as rank sequences in sorted order."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, depth: int = DEPTH):
        offsets, data = tb.string_parts(pa.array([t for _, t in items], pa.large_string()))
        words = tb.words_of(offsets, data, tb.ALNUM_SPLIT)
        self.window, self.depth = window, max(depth, window)
        self.vocabulary = np.unique(words.hash)
        self.ids = [i for i, _ in items]
        rank = (np.searchsorted(self.vocabulary, words.hash) + 1).astype(np.int64)
        counts = np.diff(words.first)
        last = np.repeat(words.first[1:], counts)
        at = np.arange(len(rank))
        left = last - at
        whole = np.minimum(counts, window)[words.doc] if len(at) else at
        keys = suffix_keys(rank, at, np.minimum(left, self.depth), self.depth)
        order = suffix_order(keys, rank, at, left)
        # All that follows is in the order of the suffixes.
        self.keys, self.item, self.whole = keys[order], words.doc[order], whole[order]
        #: Only these begin a window; the others only lengthen the longest match.
        self.opens = left[order] >= self.whole
        self.rank, self.at, self.left = rank, at[order], left[order]
        self.sums = prefix_sums(rank) if len(left) and left.max() > self.depth else None
        #: Leading words which an indexed suffix must share with some test suffix.
        self.lead = int(min(3, whole.min())) if len(at) else 1
        starts = at[left >= self.lead]
        self.leads = lead_hashes(rank, starts, self.lead)
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.leads >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.leads = np.unique(self.leads)
        #: For each length below that, the codes of all runs of words and a suffix that begins with each.
        self.short = {}
        for size in range(1, self.lead):
            some = np.flatnonzero(self.left >= size)
            codes, first = np.unique(self.code(rank, self.at[some], size), return_index=True)
            self.short[size] = codes, some[first]

    def code(self, rank: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """One number for one or two words."""
        return rank[at] if size == 1 else rank[at] * (len(self.vocabulary) + 1) + rank[at + 1]


def suffix_order(keys: np.ndarray, rank: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The order of whole suffixes: by their keys, then by doubling the words that count until none are left."""
    sorted_bytes = as_bytes(keys)
    order, width = np.argsort(sorted_bytes, kind="stable"), keys.shape[1]
    if not len(left) or left.max() <= width:
        return order
    sorted_bytes = sorted_bytes[order]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate([[True], sorted_bytes[1:] != sorted_bytes[:-1]]))
    while width < left.max():
        on = np.where(left > width, group[np.minimum(at + width, len(at) - 1)], 0)
        order = np.lexsort((on, group))
        g, o = group[order], on[order]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])]))
        width *= 2
    return order


def prefix_sums(rank: np.ndarray) -> list[np.ndarray]:
    """Sums from which run_hashes takes the hashes of any run of words, one for each prime."""
    values = tb.mix(rank.astype(np.uint64))
    return [tb.run_sums(values % np.uint64(p), p, base, 2 * tb._EXACT_RUN) for p, base in tb.PRIMES]


def same_runs(a: list[np.ndarray], at: np.ndarray, b: list[np.ndarray], bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether runs of ``size`` words are equal, by their hashes."""
    same = np.ones(len(at), dtype=bool)
    for x, y, (p, base) in zip(a, b, tb.PRIMES):
        same &= tb.run_hash(x, at, at + size, p, base) == tb.run_hash(y, bt, bt + size, p, base)
    return same


def long_matches(rank: np.ndarray, place: np.ndarray, left: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """The longest match of suffixes of any length (``left`` words) of a shard, and a test suffix that has it: a binary search over whole test suffixes, each comparison a binary search over the words in common."""
    sums = prefix_sums(rank)
    own, other = np.append(rank, 0), np.append(tests.rank, 0)

    def shared(s: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(place), np.int64), np.minimum(left, tests.left[s])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = same_runs(sums, place, tests.sums, tests.at[s], middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    low, high = np.zeros(len(place), np.int64), np.full(len(place), len(tests.at))
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(tests.at) - 1)
        n = shared(middle)
        next_own = np.where(n < left, own[place + n], 0)
        next_other = np.where(n < tests.left[middle], other[tests.at[middle] + n], 0)
        after = (low < high) & (next_other < next_own)
        low, high = np.where(after, middle + 1, low), np.where(after | (low >= high), high, middle)
    above, below = np.minimum(low, len(tests.at) - 1), np.maximum(low - 1, 0)
    up, down = shared(above), shared(below)
    return np.maximum(up, down), np.where(up >= down, above, below)


def lead_hashes(rank: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(len(at), dtype=np.uint64)
    for j, factor in enumerate(tb.powers(0xA24BAED4963EE407, width)):
        total += rank[at + j].astype(np.uint64) * factor
    return tb.mix(total)


def suffix_keys(rank: np.ndarray, at: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Each suffix as big-endian ranks, so that byte order is word order; beyond its end it is zero, below any word."""
    padded = np.concatenate([rank, np.zeros(depth, rank.dtype)])
    out = np.zeros((len(at), depth), dtype=">u4")
    for j in range(depth):
        out[:, j] = np.where(left > j, padded[at + j], 0)
    return out


def as_bytes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1] * 4}").ravel() if len(keys) else np.zeros(0, f"S{keys.shape[1] * 4}")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words which rows of a and b share from the start (a zero ends a row)."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


def longest_matches(array: np.ndarray, sorted_bytes: np.ndarray, place: np.ndarray, rank: np.ndarray, words: tb.Words, tests: TestSet) -> dict[int, tuple[int, int, int]]:
    """For each document of a shard with any word of the test set its first longest match: words, item and place."""
    # The longest match of each suffix is with one of its two neighbours among the test suffixes.
    where = np.searchsorted(as_bytes(tests.keys), sorted_bytes)
    above, below = np.minimum(where, len(tests.keys) - 1), np.maximum(where - 1, 0)
    up, down = common(array, tests.keys[above]), common(array, tests.keys[below])
    with_, length = np.where(up >= down, above, below), np.maximum(up, down)
    if tests.sums is not None and (full := np.flatnonzero(length == tests.depth)).size:
        # An unknown word or the document's end ends a suffix.
        ends = np.union1d(np.flatnonzero(rank == 0), words.first[1:])
        left = ends[np.searchsorted(ends, place[full], "right")] - place[full]
        length[full], with_[full] = long_matches(rank, place[full], left, tests)
    best = first_longest(place, length, with_, words, tests)
    for size in range(tests.lead - 1, 0, -1):
        # What the array leaves out is shorter than a lead.
        open_ = np.ones(len(words.first) - 1, dtype=bool)
        open_[list(best)] = False
        at = np.flatnonzero((rank > 0) & open_[words.doc])
        if size > 1:
            at = at[(at + 1 < words.first[words.doc[at] + 1]) & (np.append(rank, 0)[at + 1] > 0)]
        codes, first = tests.short[size]
        code = tests.code(rank, at, size)
        found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        same = codes[found] == code
        best |= first_longest(at[same], np.full(int(same.sum()), size), first[found[same]], words, tests)
    return best


def first_longest(place: np.ndarray, length: np.ndarray, with_: np.ndarray, words: tb.Words, tests: TestSet) -> dict[int, tuple[int, int, int]]:
    doc = words.doc[place]
    order = np.lexsort((place, -length, doc))
    order = order[np.diff(doc[order], prepend=-1) > 0]
    return {d: (n, i, p) for d, n, i, p in zip(doc[order].tolist(), length[order].tolist(), tests.item[with_[order]].tolist(), (place - words.first[doc])[order].tolist())}


def match_block(offsets: np.ndarray, data: np.ndarray, tests: TestSet, longest: bool = True) -> Iterator[tuple]:
    """A tuple of SCHEMA without the key for each document of a shard; without ``longest``, the longest match is not looked for."""
    words = tb.words_of(offsets, data, tb.ALNUM_SPLIT)
    rows, n = len(offsets) - 1, len(words.hash)
    counts = np.diff(words.first)
    hits: dict[int, list] = {}
    best: dict[int, tuple[int, int, int]] = {}
    if n and len(tests.leads):
        at = np.searchsorted(tests.vocabulary, words.hash)
        at[at == len(tests.vocabulary)] = 0
        rank = np.where(tests.vocabulary[at] == words.hash, at + 1, 0)
        end = np.repeat(words.first[1:], counts)
        place = np.flatnonzero((rank > 0) & (end - np.arange(n) >= tests.lead))
        for j in range(1, tests.lead):
            place = place[rank[place + j] > 0]
        lead = lead_hashes(rank, place, tests.lead)
        some = tests.bits[(lead >> np.uint64(64 - _BITS)).astype(np.int64)]
        place, lead = place[some], lead[some]
        found = np.searchsorted(tests.leads, lead)
        found[found == len(tests.leads)] = 0
        place = place[tests.leads[found] == lead]
        # The first unknown word ends a suffix too: no test suffix goes on with it.
        left = np.minimum(end[place] - place, tests.depth)
        array = suffix_keys(rank, place, left, tests.depth)
        unknown = np.minimum.accumulate(array != 0, axis=1)
        array = np.where(unknown, array, 0).astype(">u4")
        order = np.argsort(as_bytes(array), kind="stable")
        array, place = array[order], place[order]
        sorted_bytes = as_bytes(array)
        if longest:
            best = longest_matches(array, sorted_bytes, place, rank, words, tests)
        if len(place):
            # Those which share a whole window are next to each other.
            opens = np.flatnonzero(tests.opens)
            low = tests.keys[opens].copy()
            columns = np.arange(tests.depth)[None, :]
            low[columns >= tests.whole[opens][:, None]] = 0
            high = low.copy()
            high[columns >= tests.whole[opens][:, None]] = 0xFFFFFFFF
            lo, hi = np.searchsorted(sorted_bytes, as_bytes(low)), np.searchsorted(sorted_bytes, as_bytes(high), "right")
            for s in np.flatnonzero(hi > lo):
                w, item = int(tests.whole[opens[s]]), int(tests.item[opens[s]])
                for p in place[lo[s] : hi[s]].tolist():
                    hits.setdefault(int(words.doc[p]), []).append((p, p + w, item))
    for d in range(rows):
        own = hits.get(d, [])
        base = int(words.first[d])
        spans: list[list[int]] = []
        for a, b, _ in sorted(own):
            if spans and a - base <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b - base)
            else:
                spans.append([a - base, b - base])
        length, item, place_ = best.get(d, (0, -1, 0))
        yield int(counts[d]), [a for a, _ in spans], [b for _, b in spans], sorted({tests.ids[i] for _, _, i in own} - {None}), length, tests.ids[item] if length else None, place_ if length else None


_TYPES = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def merged(a: tuple, b: tuple) -> tuple:
    """Results of one document against two blocks of items; overlapping spans become one."""
    spans: list[list[int]] = []
    for x, y in sorted([*zip(a[1], a[2]), *zip(b[1], b[2])]):
        if spans and x <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], y)
        else:
            spans.append([x, y])
    return a[0], [x for x, _ in spans], [y for _, y in spans], sorted({*a[3], *b[3]}), *max(a[4:], b[4:], key=lambda t: t[0])


class Indexes:
    """The index of each broadcast block, one held at a time; with a single block it stays."""

    def __init__(self, blocks: list):
        self.blocks, self.now, self.tests = blocks, -1, None

    def __iter__(self) -> Iterator[TestSet]:
        for i, block in enumerate(self.blocks):
            if i != self.now:
                self.tests = None
                self.now, self.tests = i, TestSet(block.value)
                if len(self.blocks) > 1:
                    # What the worker read of the broadcast would stay beside the index.
                    block.__dict__.pop("_value", None)
            yield self.tests


def held(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``limit`` bytes of text."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.column(text).nbytes
        if size >= limit:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def _searcher(blocks: list, more: bool, before: bool):
    """Matches of some blocks of items; ``before``: rows carry what earlier rounds found, ``more``: texts go on to the next round."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = Indexes(blocks)
        for batch in held(batches, 1, HELD_BYTES) if len(blocks) > 1 else batches:
            offsets, data = tb.string_parts(batch.column(1))
            found = list(zip(*(batch.column(i + 2).to_pylist() for i in range(len(_TYPES))))) if before else None
            for tests in indexes:
                out = [row for a, b in tb.blocks(offsets) for row in match_block(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], tests)]
                found = out if found is None else [merged(x, y) for x, y in zip(found, out)]
            for a, b in tb.blocks(offsets):
                columns = [pa.array(c, t) for c, t in zip(zip(*found[a:b]), _TYPES)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(2 if more else 1)), *columns], names=["row_key", *(["text"] if more else []), *_NAMES[1:]])

    return search


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The test set in blocks of a bounded size; it is streamed, one block is held at a time."""
    block: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col))
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def _rounds(spark: SparkSession, benchmark: DataFrame, item: str, item_text: str, limit: int) -> Iterator[tuple[list, bool]]:
    """Broadcast blocks of the test set, as many as go together, and whether there are more; one empty block for an empty test set."""
    rounds = batched(item_blocks(benchmark, item, item_text, limit), BLOCKS_SENT)
    now = next(rounds, ([],))
    while now is not None:
        after = next(rounds, None)
        yield [spark.sparkContext.broadcast(b) for b in now], after is not None
        now = after


def find_matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = MAX_TEST_BYTES) -> DataFrame:
    """row_key, n_words, merged hit spans in words, items found, and the longest match with its item and place, for each document."""
    rows, before = docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text")), False
    wide = SCHEMA.replace("row_key long, ", "row_key long, text string, ", 1)
    for blocks, more in _rounds(docs.sparkSession, benchmark, item, item_text, limit):
        rows = rows.mapInArrow(tb.frugal(_searcher(blocks, more, before)), wide if more else SCHEMA)
        before = True
        if more:
            rows = table(rows)
            for b in blocks:
                b.destroy()
    return rows


def n_hit() -> F.Column:
    """Words inside any occurrence of a window."""
    return F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)


def remove_affected(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = MAX_TEST_BYTES) -> DataFrame:
    """docs without those in which a test window occurs.  Whole rows are kept or removed; a null key is kept apart and judged by its own text."""
    kept, at, schema = docs, docs.columns.index(text), docs.schema
    for blocks, more in _rounds(docs.sparkSession, benchmark, item, item_text, limit):
        kept = kept.mapInArrow(tb.frugal(_remover(blocks, at)), schema)
        if more:
            kept = table(kept)
            for b in blocks:
                b.destroy()
    return kept


def _remover(blocks: list, at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = Indexes(blocks)
        for batch in held(batches, at, HELD_BYTES) if len(blocks) > 1 else batches:
            for tests in indexes:
                offsets, data = tb.string_parts(batch.column(at))
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, b in tb.blocks(offsets):
                    keep[a:b] = [not row[1] for row in match_block(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], tests, longest=False)]
                batch = batch.filter(pa.array(keep))
            yield batch

    return clean


def contract(spark, sf_dir: str) -> DataFrame:
    """The digest of op7 for every document."""
    found = find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id IS NOT NULL"))
    return found.select(
        F.col("row_key").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_from") > 0).alias("contaminated"),
    )


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: Windows of item and document meet as strings.
ORACLE_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql("text")} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS k, array_to_string(list_slice(w, s, s + least({WINDOW}, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_words_sql("text")}, []) AS w FROM documents),
dw AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.s, dw.k, iw.item FROM dw JOIN iw ON iw.k = dw.k AND iw.win = dw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
