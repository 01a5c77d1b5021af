"""Shared helpers: text blocks as byte arrays, word hashes, staged tables.

The array code works on a *block*: the UTF-8 bytes of some documents end to end, and the
offsets where each begins. Blocks hold about a quarter of a megabyte, so memory does not grow
with the size of an Arrow batch, and at most 512 texts; a single longer text forms a block of
its own.
"""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeframe.session import materialise, scratch_path  # noqa: F401

BLOCK_BYTES, BLOCK_ROWS = 1 << 18, 512
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)

#: white space of the word rule `[^\x20\x09-\x0D]+`
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: separators of the word rule `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, with A-Z lower-cased first
NON_ALNUM = np.ones(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    NON_ALNUM[_lo : _hi + 1] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """:func:`materialise` of rows that carry whole texts through Python: for as long as the write
    takes, an Arrow batch holds no more than ``batch_rows`` of them. The session gets its setting
    back."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        return materialise(df, name)
    finally:
        conf.set(BATCH_ROWS, before)


def crc_of_id(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def worker_cache(name: str, make):
    """An object that lives as long as the Python worker, shared by the tasks it runs."""
    home = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def build(size):
        up = np.full(size, BASE, U64)
        down = np.full(size, U64(pow(int(BASE), -1, 2**64)), U64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)

    size = 1 << max(20, int(n).bit_length())
    return worker_cache(f"powers_{size}", lambda: build(size))


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    values = random_words(seed, 256) | U64(1)
    if fold_case:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


class Rolling:
    """Hashes of any substrings of ``buf`` from one running sum: equal bytes, equal hash."""

    def __init__(self, buf: np.ndarray, values: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(values[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow text column; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def blocks(column, limit: int = BLOCK_BYTES):
    """Yields (first row, last row, bytes, offsets from 0) of consecutive rows."""
    buf, offsets = column_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, min(i + BLOCK_ROWS, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Start and end byte of every word, and the number of the first word of each text."""
    inside = ~separators[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf, offsets, separators, seed: int = 11):
    """64-bit hashes of all words, A-Z in lower case, with their start and end bytes and each
    text's first word."""
    starts, ends, first = words(buf, offsets, separators)
    return span_hashes(buf, starts, ends, seed), starts, ends, first


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A sum over the bytes of each span of a scrambled function of byte and place. Unlike a
    polynomial modulo 2^64, in which complementary Thue-Morse words agree whatever the base, no
    two words are known to share it."""
    values, places = byte_values(seed, True), random_words(seed + 1, 1 << 12)
    sizes = ends - starts
    total = np.cumsum(sizes)
    place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - sizes, sizes)
    x = places[place & 0xFFF]
    if len(sizes) and sizes.max() > len(places):
        x = x + mix((place >> 12).astype(U64) * BASE)
    x += values[buf[np.repeat(starts, sizes) + place]]
    sums = np.zeros(len(place) + 1, U64)
    np.cumsum(mix(x), out=sums[1:])
    return mix(sums[total] - sums[total - sizes] + sizes.astype(U64) * U64(0xD6E8FEB86659FD93))


def id_list(column) -> list:
    return column.to_pylist()


def map_texts(docs: DataFrame, text_column: str, schema: str, fn, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of ``schema`` that ``fn(bytes, offsets)`` finds per text.

    ``keep`` are the columns that stay (all of them if not given); one of them that has the
    name of a new column is replaced. The text always reaches ``fn`` whole.
    """
    new = [c.split()[0] for c in schema.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    types = docs.select(*keep).schema
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in types] + [schema])
    # a text that stays is sent once and given back
    stays = text_column in keep
    at = keep.index(text_column) if stays else 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, buf, offsets in blocks(batch.column(at)):
                part = batch.slice(i, j - i)
                found = fn(buf, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns[0 if stays else 1 :], *found], [*keep, *new])

    sent = docs.select(*keep) if stays else docs.select(F.col(text_column).alias("__text"), *keep)
    return sent.mapInArrow(run, fields)
