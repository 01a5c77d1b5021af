"""Removal of repeated passages by fingerprints of windows anchored at minimisers.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller id, or
same document and earlier start) is removed. Strings are judged on the input; they do not
cross documents.

The dealt method, a suffix array refined by bucket pointers, was swapped for this: an array of
all positions would be some ten times the corpus, and its refinement a join of all entries per
round. Only *anchors* are entered: positions whose ``gram`` is the least (by hash) among all grams of some window of
``length`` bytes. Which gram that is depends on the window's bytes alone, so equal strings
have their anchors in the same place, and about one position in ``(length - gram + 2) / 2``
is one. An anchor stands for all windows that chose it.

Buckets (nothing is sorted, and no identifier of another anchor's bucket is used):

1. *Gram buckets.* Anchors are bucketed by their gram. Bucket identifiers are made from the
   bytes, so all tasks agree on them without a sort; a bucket with one member is finished.
2. *Refined buckets.* A bucket is split by the identifier of everything its windows reach, at
   later and earlier offsets. Members of one refined bucket have the same windows, so all
   but the earliest are repeats as a whole; a gram bucket with one refined bucket is finished.
3. *Single windows.* Only buckets that still hold different strings go on, with one
   representative per refined bucket and the bytes its windows reach: here each single window
   gets its identifier, and all but its earliest
   start are repeats. Small buckets are split inside a task, a large one sends its windows
   through the shuffle one by one.

Identifiers are 128 bits of two rolling hashes, computed from the running sums of one pass.

Hot strings: a task first settles what repeats inside its own batch and sends one member per
refined bucket and at most ``PER_BATCH`` refined buckets per gram bucket under the bucket's
own key; further ones travel under a key of their own, and such a bucket counts as large, as
does one of more than ``IN_MEMORY`` members. Texts travel compressed; tables between steps lie in the shared
folder; each step is one shuffle.

Defined results: null text is empty; rows without an id neither match nor lose anything;
rows that repeat an id count as one document, so their copies of each other are no repeats;
texts shorter than ``length`` stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.llm.common import U64, Rolling, blocks, byte_values, map_texts, materialise, mix

GRAM = 24
PIECE = 1 << 22
HELD = 1 << 20
ROWS = "key bigint, c bigint, doc_id bigint, start bigint, n bigint, kind int"
#: plain; first of a bucket that had more; of the further ones; settled bytes; context to split
NORMAL, MORE, SEVERAL, SPAN, CONTEXT = 0, 1, 2, 3, 4
PER_BATCH, IN_MEMORY = 64, 8192


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Gram identifiers, context identifiers, text number, first window, number of windows."""
    found = []
    for a in range(0, max(len(buf) - length + 1, 0), PIECE):
        piece = buf[a : a + PIECE + length - 1]
        one, two = Rolling(piece, byte_values(41, False)), Rolling(piece, byte_values(42, False))
        n = len(piece)
        ids = mix((one.sums[gram:] - one.sums[:-gram]) * one.down[: n - gram + 1])
        # unique and leftmost among equals: the low bits are the position
        rank = (ids & ~U64((1 << 24) - 1)) | np.arange(len(ids), dtype=U64)
        chosen = (sliding_min(rank, length - gram + 1) & U64((1 << 24) - 1)).astype(np.int64)
        valid = np.ones(len(chosen), bool)
        ends = offsets[1:] - a
        for e in ends[(ends > 0) & (ends - length + 1 < len(chosen))].tolist():
            valid[max(0, e - length + 1) : e] = False
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        chosen = chosen[at]
        new = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(at) != 1)) + 1
        first = at[np.concatenate([[0], new])]
        last = at[np.concatenate([new - 1, [len(at) - 1]])]
        p = chosen[np.concatenate([[0], new])]
        context = two.of(first, last + length) + mix((p - first).astype(U64))
        found.append((ids[p], mix(context), first + a, last - first + 1))
    if not found:
        return (np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
    b, c, first, n = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(offsets, first, "right") - 1
    return b, c, text, first - offsets[text], n


def windows_of(buf: np.ndarray, starts: np.ndarray, length: int):
    one, two = Rolling(buf, byte_values(43, False)), Rolling(buf, byte_values(44, False))
    return one.of(starts, starts + length), two.of(starts, starts + length)


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of spans per document; ends grow with starts."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] > end[:-1])) + 1
    heads = np.concatenate([[0], new])
    return doc[heads], start[heads], np.maximum.reduceat(end, heads)


def _reaches(which: np.ndarray, n: int) -> np.ndarray:
    """For numbers counting up from 0 in each group: whether the group has over ``n`` members."""
    heads = np.flatnonzero(which == 0)
    sizes = np.diff(np.append(heads, len(which)))
    return np.repeat(sizes > n, sizes)


def settle(b, c, doc, start, n, length):
    """What one batch can decide: rows for the exchange, as columns of ``ROWS``."""
    order = np.lexsort((start, doc, c, b))
    b, c, doc, start, n = (x[order] for x in (b, c, doc, start, n))
    new_b = np.concatenate([[True], b[1:] != b[:-1]])
    new_c = new_b | np.concatenate([[True], c[1:] != c[:-1]])
    head = np.maximum.accumulate(np.where(new_c, np.arange(len(b)), 0))
    repeat = (doc != doc[head]) | (start != start[head])
    spans = _spans(doc[repeat], start[repeat], start[repeat] + n[repeat] + length - 1)
    rep = np.flatnonzero(new_c)
    which = np.arange(len(rep)) - np.maximum.accumulate(np.where(new_b[rep], np.arange(len(rep)), 0))
    extra = which >= PER_BATCH
    kind = np.where(extra, SEVERAL, NORMAL)
    kind[(which == 0) & _reaches(which, PER_BATCH)] = MORE
    key = b[rep].copy()
    key[extra] = mix(key[extra] ^ c[rep][extra])
    return [
        np.concatenate([key, mix(spans[0].astype(U64) * U64(3) + spans[1].astype(U64))]).view(np.int64),
        np.concatenate([c[rep], np.zeros(len(spans[0]), U64)]).view(np.int64),
        np.concatenate([doc[rep], spans[0]]),
        np.concatenate([start[rep], spans[1]]),
        np.concatenate([n[rep], spans[2] - spans[1]]),
        np.concatenate([kind, np.full(len(spans[0]), SPAN)]).astype(np.int32),
    ]


def _gather(docs: DataFrame, make, length: int) -> DataFrame:
    """Rows of ``ROWS``: ``make(batch)`` yields anchor columns, settled a large batch at a time."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in ROWS.split(", ")]
        held, size = [], 0

        def out():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for i in range(0, len((settled := settle(*columns, length))[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in settled], names)

        for batch in batches:
            for columns in make(batch):
                if len(columns[0]):
                    held.append(columns)
                    size += len(columns[0])
                if size >= HELD:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return docs.mapInArrow(run, ROWS)


def zipped_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    def run(buf, offsets):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        data = buf.tobytes()
        return [pa.array([squeeze(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())]

    ids = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return map_texts(ids, "text", "zipped binary", run, ["doc_id"])


def repeated_spans(
    docs: DataFrame, length: int = 100, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows ``doc_id, start, n``: bytes to remove; spans of a document may overlap."""
    ids = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    ids = ids.where(F.col("doc_id").isNotNull())

    def from_texts(batch):
        doc = np.asarray(batch.column(0))
        for i, _, buf, offsets in blocks(batch.column(1)):
            b, c, text, start, n = anchors(buf, offsets, length, gram)
            yield b, c, doc[i + text], start, n

    rows = _gather(ids, from_texts, length).repartition("key")
    earliest = Window.partitionBy("key", "c").orderBy("doc_id", "start")
    bucket = Window.partitionBy("key")
    several = F.max(F.col("kind").isin(MORE, SEVERAL).cast("int")).over(bucket) == 1
    rows = rows.withColumn("place", F.rank().over(earliest))
    rows = rows.withColumn("open", (F.min("c").over(bucket) != F.max("c").over(bucket)) | several)
    rows = rows.withColumn("large", several | (F.count("*").over(bucket) > IN_MEMORY))
    span = (F.col("kind") == SPAN) | (F.col("place") > 1)
    rows = rows.where(span | F.col("open")).select(
        "key", "doc_id", "start",
        F.when((F.col("kind") != SPAN) & span, F.col("n") + (length - 1)).otherwise(F.col("n")).alias("n"),
        "large", span.alias("settled"),
    )
    rows = materialise(rows, "suffix-buckets")

    open_ = rows.where("NOT settled").groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "start", "n", "large")).alias("ranges")
    )
    texts = zipped_texts(docs, id_column, text_column)
    reached = open_.join(texts, "doc_id").select("doc_id", "ranges", "zipped")
    reached = reached.mapInArrow(_reach(length), f"{ROWS}, bytes binary")
    reached = reached.repartition("key").sortWithinPartitions("key", "c", "doc_id", "start")
    split = reached.mapInArrow(_split(length), "doc_id bigint, start bigint, n bigint")
    return rows.where("settled").select("doc_id", "start", "n").unionByName(split)


def _reach(length: int):
    """Open anchors become their bytes, or one row per window where the bucket is large."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        names = [*(c.split()[0] for c in ROWS.split(", ")), "bytes"]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, near, single = batch.slice(i, 512), [], []
                for doc, ranges, zipped in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    data = unzip(zipped)
                    buf, starts = np.frombuffer(data, np.uint8), []
                    for r in ranges:
                        a, n = r["start"], min(r["n"], len(data) - length + 1 - r["start"])
                        if n <= 0:
                            continue
                        if r["large"]:
                            starts.append(np.arange(a, a + n))
                        else:
                            near.append((r["key"], 0, doc, a, n, CONTEXT, data[a : a + n + length - 1]))
                    if starts:
                        starts = np.unique(np.concatenate(starts))
                        h = windows_of(buf, starts, length)
                        single.append((*h, np.full(len(starts), doc), starts, np.ones(len(starts), np.int64)))
                if near:
                    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*near, strict=True), kinds, strict=True)], names
                    )
                if single:
                    columns = settle(*(np.concatenate(x) for x in zip(*single, strict=True)), length)
                    for k in range(0, len(columns[0]), 1 << 16):
                        cut = [pa.array(x[k : k + (1 << 16)]) for x in columns]
                        yield pa.RecordBatch.from_arrays([*cut, pa.nulls(len(cut[0]), pa.binary())], names)

    return run


def _repeats(h1, h2, doc, start, length: int):
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = (doc != doc[head]) | (start != start[head])
    return _spans(doc[again], start[again], start[again] + length)


def _split(length: int):
    """Rows come ordered by key: contexts of one bucket, or windows of one identifier."""

    def run(batches):
        import pyarrow as pa

        def spans(doc, start, end):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc, start, end - start)], ["doc_id", "start", "n"]
            )

        def contexts(rows):
            doc, start, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            buf = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            first = np.cumsum(n + length - 1) - (n + length - 1)
            ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = windows_of(buf, np.repeat(first, n) + ramp, length)
            return spans(*_repeats(*h, np.repeat(doc, n), np.repeat(start, n) + ramp, length))

        held: list[tuple] = []
        last = (None, None, None, None)  # key, c, id and start that the current window began with
        for batch in batches:
            key, c, doc, start, n, kind = (np.asarray(batch.column(k)) for k in range(6))
            done = kind == SPAN
            if done.any():
                yield spans(doc[done], start[done], start[done] + n[done])
            plain = np.flatnonzero((kind != SPAN) & (kind != CONTEXT))
            if len(plain):
                k, g, d, a = key[plain], c[plain], doc[plain], start[plain]
                new = np.concatenate([[(k[0], g[0]) != last[:2]], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
                head = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
                head_doc = np.where(head >= 0, d[head], last[2] if last[2] is not None else 0)
                head_start = np.where(head >= 0, a[head], last[3] if last[3] is not None else 0)
                again = (d != head_doc) | (a != head_start)
                last = (k[-1], g[-1], head_doc[-1], head_start[-1])
                if again.any():
                    yield spans(*_spans(d[again], a[again], a[again] + length))
            near = np.flatnonzero(kind == CONTEXT)
            if len(near):
                texts = batch.column(6)
                held += [(key[r], doc[r], start[r], n[r], texts[int(r)].as_py()) for r in near]
                if len(held) >= 4096:  # all buckets but the last are complete
                    end = len(held)
                    while end and held[end - 1][0] == held[-1][0]:
                        end -= 1
                    if end:
                        yield contexts(held[:end])
                        held = held[end:]
        if held:
            yield contexts(held)

    return run


def remove_repeats(
    docs: DataFrame, length: int = 100, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per document; ``kept`` holds
    the remaining bytes."""
    spans = repeated_spans(docs, length, gram, id_column, text_column)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    texts = zipped_texts(docs, id_column, text_column).join(spans, "doc_id", "left").select("doc_id", "zipped", "spans")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def run(batches):
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, rows = batch.slice(i, 512), []
                for doc, zipped, spans in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    data = unzip(zipped)
                    out, at, count, end = [], 0, 0, -1
                    for start, stop in sorted((s["start"], min(s["start"] + s["n"], len(data))) for s in spans or ()):
                        if stop <= start:
                            continue
                        if start > end:
                            count += 1
                            out.append(data[at:start])
                        end = max(end, stop)
                        at = end
                    out.append(data[at:])
                    kept = b"".join(out)
                    rows.append((doc, len(data), len(data) - len(kept), count, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=True
                    )],
                    [c.split()[0] for c in schema.split(", ")],
                )

    return texts.mapInArrow(run, schema)
