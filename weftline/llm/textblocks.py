"""Vectorised word handling over Arrow string columns.

A block is a run of whole documents, at most ``BLOCK_BYTES`` of UTF-8 unless one
document alone is larger.  Words are found and hashed with numpy on the raw
bytes, so nothing here works row by row and nothing is cut to a prefix.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_SEED = np.random.default_rng(20240607)
#: One random 64-bit value for each byte, the alphabet of the polynomial word hash.
BYTE_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z folded onto a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[FOLD]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
#: Primes and bases of two more polynomials: modulo 2**64 alone, some pairs of long words (Thue-Morse sequences) are equal for any base.
PRIMES = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_812_433_253))
#: Runs of so many values below 2**9 sum up exactly in 64 bits before the remainder is taken.
_EXACT_RUN = 1 << 23

#: Byte classes: everything but ASCII white space; and ASCII digits, letters and all of UTF-8 beyond ASCII.
SPACE_SPLIT = np.ones(256, dtype=bool)
SPACE_SPLIT[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_SPLIT = np.zeros(256, dtype=bool)
ALNUM_SPLIT[0x30:0x3A] = ALNUM_SPLIT[0x41:0x5B] = ALNUM_SPLIT[0x61:0x7B] = ALNUM_SPLIT[0x80:] = True

_powers: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(n if n <= 64 else max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def prime_powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo a prime below 2**31."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.ones(size, dtype=np.uint32)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, prime))
            have[done : 2 * done] = have[: min(done, size - done)] * step % np.uint64(prime)
            done *= 2
        _powers[base, prime] = have
    return have[:n]


def run_sums(values: np.ndarray, prime: int, base: int, longest: int) -> np.ndarray:
    """Prefix sums from which ``run_hash`` takes the polynomial of any run of at most ``longest`` values (below 2**9, or else reduced) modulo a prime."""
    inverse = pow(base, -1, prime)
    terms = np.multiply(values, prime_powers(inverse, prime, len(values)), dtype=np.uint64)
    if longest > _EXACT_RUN:
        terms %= np.uint64(prime)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(terms, out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, prime: int, base: int) -> np.ndarray:
    """The polynomial modulo the prime of values start to end, wherever the run stands."""
    return (sums[end] - sums[start]) % np.uint64(prime) * prime_powers(base, prime, len(sums))[start] % np.uint64(prime)


def frugal(run: Callable) -> Callable:
    """A function over batches, after which its worker gives freed memory back to the system: Spark keeps workers for later tasks, beside an executor's heap that has grown meanwhile."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # a system without it keeps the memory
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits of a hash are alike."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a block: ``doc`` is the row within the block, ``first`` the index of each row's first word (one more entry than rows)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows; nulls are empty) and bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(offsets: np.ndarray, size: int | None = None, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of whole documents of about ``size`` bytes, and of ``rows`` documents at most."""
    size = size or BLOCK_BYTES
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(at + 1, to), at + (rows or n))
        yield at, to
        at = to


def words_of(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray, fold: bool = True) -> Words:
    """Words of the documents whose bytes ``data`` holds one after the other."""
    rows = len(offsets) - 1
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64))
    inside = is_word[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | begins[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | begins[1:n]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(finish) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((FOLDED_VALUES if fold else BYTE_VALUES)[data] * powers(_BASE_INV, n), out=sums[1:])
    hashed = (sums[end] - sums[start]) * powers(_BASE, n)[start] + (end - start).astype(np.uint64)
    values = (FOLD if fold else np.arange(256, dtype=np.uint8))[data].astype(np.uint16) + np.uint16(1)
    longest = int((end - start).max()) if len(start) else 0
    for prime, base in PRIMES:
        hashed = mix(hashed) + run_hash(run_sums(values, prime, base, longest), start, end, prime, base)
    hashed = mix(hashed)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(rows), np.diff(first))
    return Words(start, end, doc, first, hashed)


def shingles_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and each row's first index in them; a row of fewer words, but not none, has one run, of all its words."""
    n, rows = len(words.hash), len(words.first) - 1
    counts = np.diff(words.first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    if n == 0:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) - np.repeat(first[:-1], made) + np.repeat(words.first[:-1], made)
    factor = powers(0xD6E8FEB86659FD93, width)
    padded = np.concatenate([words.hash, np.zeros(width, np.uint64)])
    total = np.zeros(len(at), dtype=np.uint64)
    size = np.repeat(np.minimum(counts, width), made)
    short = counts.min() < width
    for j in range(width):
        part = padded[at + j] * factor[j]
        total += np.where(size > j, part, np.uint64(0)) if short else part
    return mix(total + size.astype(np.uint64)), first

