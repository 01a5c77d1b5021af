"""Benchmark decontamination by spaced seeds.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. Two texts
*overlap* where, laid side by side at a fixed distance, some ``WINDOW`` consecutive words
agree in all but ``MISSES`` places: substitutions are tolerated, and every window that agrees
belongs to the overlap. A benchmark item shorter than the window must occur whole, with at
most one word changed; one of one to four words must occur as it is.

Search: a mask names the word positions that are hashed together and skips the others. The
three masks are chosen such that any two substitutions within thirteen words leave at least
one mask, at some shift, untouched, so no overlap escapes (checked in the tests). Hashes of
the benchmark are joined with those of the documents, and each hit's alignment is verified
word by word.

Scale: the benchmark is a stated query set. It is split by a hash of its items into blocks of
at most about ``block_words`` words; each block's seed table has that bound and goes to the
tasks, which pass over the documents without any shuffle.

Defined results: null or empty text has no words and is clean; null or empty items match
nothing; items without id are searched under keys of their own, below all ids and below 0;
repeated rows are judged alike; an empty benchmark leaves every document clean;
columns of clashing names are replaced by the new ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.llm.common import NON_ALNUM, U64, map_texts, mix, random_words, word_hashes

WINDOW, MISSES, INEXACT, SHORT_MISSES = 13, 2, 5, 1
MASKS = ((0, 1, 2, 4, 5, 8, 9), (0, 1, 2, 3, 4, 6, 7), (0, 1, 3, 6, 8, 9, 10))
SCHEMA = (
    "n_words bigint, contaminated boolean, item_ids array<bigint>, matched_words bigint, "
    "overlaps array<struct<item_id:bigint,start:bigint,end:bigint>>"
)
FACTORS = random_words(31, 64) | U64(1)


def short_masks(size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Masks of an item of ``size`` words, numbered: one changed word leaves one of them. All
    words but one where halves would be too common, else the two halves. Items that must occur
    as they are have one mask."""
    if size < INEXACT:
        masks = [tuple(range(size))]
    elif size < 8:
        masks = [tuple(k for k in range(size) if k != gone) for gone in range(size)]
    else:
        masks = [tuple(range(size // 2)), tuple(range(size // 2, size))]
    return [(16 * size + k, mask) for k, mask in enumerate(masks)]


def seeds(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of the masked words at every start where the mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64((number + 1) * int(FACTORS[63]) % 2**64), U64)
    for k, at in enumerate(mask):
        out += h[at : at + n] * FACTORS[k]
    return mix(out)


class Index:
    """Seed table of a block of items: sorted hashes with item and position."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        lists: dict[tuple, list] = {}
        for n, (_, h) in enumerate(items):
            if len(h) >= WINDOW:
                masks = enumerate(MASKS)
            elif len(h):
                masks = short_masks(len(h))
            else:
                continue
            for number, mask in masks:
                s = seeds(h, mask, number)
                if len(h) < WINDOW:
                    s = s[:1]  # a short item counts as a whole only
                lists.setdefault((number, mask), []).append((s, np.full(len(s), n), np.arange(len(s))))
        self.tables = []
        for (number, mask), parts in lists.items():
            s, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(s, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(s >> U64(44)).astype(np.int64)] = True
            self.tables.append((number, mask, s[order], item[order], at[order], bits))

    def alignments(self, h: np.ndarray) -> np.ndarray:
        """Distinct pairs (item, start in the text minus start in the item) with a seed hit;
        starts count from the block's first word."""
        found = []
        for number, mask, table, item, at, bits in self.tables:
            s = seeds(h, mask, number)
            hit = np.flatnonzero(bits[(s >> U64(44)).astype(np.int64)])
            first = np.searchsorted(table, s[hit], "left")
            n = np.searchsorted(table, s[hit], "right") - first
            if not n.sum():
                continue
            where = np.repeat(hit, n)
            row = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([item[row], where - at[row]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def overlaps(self, h: np.ndarray, first: np.ndarray):
        """(text, item id, start, end, agreeing words), starts counted in the text's words."""
        for n, shift in self.alignments(h).tolist():
            key, item = self.items[n]
            size = min(WINDOW, len(item))
            need = size - (MISSES if size == WINDOW else SHORT_MISSES if size >= INEXACT else 0)
            lo, hi = max(0, shift), min(len(h), shift + len(item))
            texts = range(int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi, "left")))
            for t in texts:  # an alignment may reach over several short texts
                a, b = max(lo, int(first[t])), min(hi, int(first[t + 1]))
                if b - a < size:
                    continue
                same = np.concatenate([[0], np.cumsum(h[a:b] == item[a - shift : b - shift])])
                good = np.flatnonzero(same[size:] - same[:-size] >= need)
                for run in np.split(good, np.flatnonzero(np.diff(good) > size) + 1) if len(good) else ():
                    s, e = int(run[0]), int(run[-1]) + size
                    yield t, key, a - int(first[t]) + s, a - int(first[t]) + e, int(same[e] - same[s])


def _items(tests: DataFrame, id_column: str, text_column: str, lowest: int) -> list[tuple[int, np.ndarray]]:
    def hashes(buf, offsets):
        import pyarrow as pa

        h, _, _, first = word_hashes(buf, offsets, NON_ALNUM)
        return [pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())]

    rows = [(r[0], r[1]) for r in map_texts(tests, text_column, "h binary", hashes, [id_column]).collect()]
    nameless = sorted(h for key, h in rows if key is None and h)
    keyed = [(key, h) for key, h in rows if key is not None]
    keyed += [(lowest - 1 - k, h) for k, h in enumerate(nameless)]
    return sorted(((key, np.frombuffer(h, U64)) for key, h in keyed), key=lambda r: (r[0], r[1].tobytes()))


def find_overlaps(
    docs: DataFrame,
    tests: DataFrame,
    keep: list[str] | None = None,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_words: int = 1_000_000,
) -> DataFrame:
    """``docs`` (its ``keep`` columns, or all) with the overlaps of every text added."""
    tests = tests.select(F.col(item_column).alias("item_id"), F.col(item_text_column).alias("item_text"))
    chars, lowest = tests.agg(F.sum(F.length("item_text")), F.min("item_id")).first()
    chars, lowest = chars or 0, min(lowest or 0, 0)
    n = 1 + int(chars // (2 * block_words))  # a word and its separator are two characters at least
    new = [c.split()[0] for c in SCHEMA.split(", ", 4)]
    keep = [c for c in (keep or docs.columns) if c not in new]
    out = docs.select(*keep, *([] if text_column in keep else [text_column]))
    for k in range(n):
        block = tests.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n)) == k) if n > 1 else tests
        items = _items(block, "item_id", "item_text", lowest)
        lowest = min([lowest, *[key for key, _ in items]])
        out = _search(out, Index(items), text_column, k)
    if n > 1:
        names = [f"__found_{k}" for k in range(n)]
        out = out.withColumn("__found_0", F.array_sort(F.flatten(F.array(*names))))
    hits = F.col("__found_0")
    return out.select(
        *keep,
        F.col("__words_0").alias("n_words"),
        (F.size(hits) > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["item_id"]))).alias("item_ids"),
        F.coalesce(F.array_max(F.transform(hits, lambda x: x["same"])), F.lit(0)).cast("bigint").alias("matched_words"),
        F.transform(hits, lambda x: F.struct(x["item_id"], x["start"], x["end"])).alias("overlaps"),
    )


def _search(docs: DataFrame, index: Index, text_column: str, k: int) -> DataFrame:
    def run(buf, offsets):
        import pyarrow as pa

        h, _, _, first = word_hashes(buf, offsets, NON_ALNUM)
        found: list[list] = [[] for _ in range(len(offsets) - 1)]
        for t, key, start, end, same in index.overlaps(h, first):
            found[t].append({"item_id": key, "start": start, "end": end, "same": same})
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "end", "same")]))
        found = [sorted(f, key=lambda x: tuple(x.values())) for f in found]
        return [pa.array(np.diff(first), pa.int64()), pa.array(found, kind)]

    schema = f"__words_{k} bigint, __found_{k} array<struct<item_id:bigint,start:bigint,end:bigint,same:bigint>>"
    return map_texts(docs, text_column, schema, run)
