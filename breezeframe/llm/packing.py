"""Packing documents into fixed-length training sequences, in order.

Each task takes its input partition as one stream of tokens (a document's ids, then the end
id) and chooses the cuts between sequences by dynamic programming over candidate cuts:

* after a document: free,
* after a sentence: ``sentence_penalty``,
* elsewhere, only inside stretches without either: ``hard_penalty``.

With ``best(j)`` the least cost of a stream cut at ``j``::

    best(j) = penalty(j) + length - j + min over j - length <= i < j of (best(i) + i)

so the minimum runs over a window that only moves forward, and a monotone queue gives it in
constant amortised time. Cost counts padding tokens, so a penalty is the number of padding
tokens a cut is worth. The stream's remainder is cut so that it needs no padding to
``length``: its last sequence is padded to the next power of two only.

Memory: the stream is solved in segments of ``segment`` tokens; the last two sequences of a
segment go into the next one. A task holds one segment and one document. A re-run task reads
the same partition and gives the same sequences.

Null text counts as empty (the document is its end id alone); repeated rows are packed as
often as they occur; null ids stay null; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from breezeframe.llm.common import worker_cache
from breezeframe.llm.tokens import Encoder, Files

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
END_ID = 2


def sentence_ends(files: Files) -> np.ndarray:
    """Whether an id closes a sentence."""
    ends = np.zeros(files.size + 1, bool)
    for mark in (".", "!", "?", ".\"", "!\"", "?\"", "…", "。"):
        ids = files.tokenizer.encode(mark, add_special_tokens=False).ids
        if len(ids) == 1:
            ends[ids[0]] = True
    return ends


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indices into ``positions`` (ascending, the last is the stream's end) of the best cuts.

    Neighbouring positions, and 0 and the first one, lie at most ``length`` apart.
    """
    n = len(positions)
    back = [-1] * n
    queue: deque = deque([(0.0, 0, -1)])  # best(i) + i ascending; position; index
    pos, pen = positions.tolist(), penalties.tolist()
    for j in range(n):
        here = pos[j]
        while queue[0][1] < here - length:
            queue.popleft()
        value, at, i = queue[0]
        best = value + pen[j] + length - here
        back[j] = i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    cuts, j = [], n - 1
    while j >= 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, length: int, sentence_penalty, hard_penalty):
    """Cut positions of a stream and their penalties; no gap is wider than ``length / 64``."""
    total = len(ids)
    cost = np.full(total + 1, np.inf)
    cost[np.flatnonzero(ends[ids]) + 1] = sentence_penalty
    cost[doc_ends] = 0
    cost[total] = 0
    natural = np.flatnonzero(np.isfinite(cost))
    step = max(1, length // 64)
    edges = np.concatenate([[0], natural])
    for g in np.flatnonzero(np.diff(edges) > step):
        inner = np.arange(edges[g] + step, edges[g + 1], step)
        cost[inner] = hard_penalty
    cost[0] = np.inf
    positions = np.flatnonzero(np.isfinite(cost))
    return positions, cost[positions]


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 4096,
    end_id: int = END_ID,
    sentence_penalty: float = 8.0,
    hard_penalty: float = 48.0,
    segment: int = 1 << 21,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``tokenizer`` is the path of a tokenizer file that every executor can open; ids are those of
    its plain call without special tokens added (the text of a special token is that token).
    """
    docs = docs.select(id_column, text_column)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files = worker_cache(f"files_{tokenizer}", lambda: Files(tokenizer))
        encoder, ends = Encoder(files), sentence_ends(files)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
        held: list[tuple] = []  # (id, ids, first id not yet packed)
        size = 0

        def solve(last: bool):
            nonlocal held, size, sequence
            stream = np.concatenate([ids[a:] for _, ids, a in held])
            doc_ends = np.cumsum([len(ids) - a for _, ids, a in held])
            positions, penalties = candidates(stream, doc_ends, ends, length, sentence_penalty, hard_penalty)
            cuts = positions[choose_cuts(positions, penalties, length)].tolist()
            if not last:
                cuts = cuts[:-2]
            rows: list[tuple] = []
            begin, d, at = 0, 0, held[0][2]
            for cut in cuts:
                offset = 0
                while begin < cut:
                    key, ids, _ = held[d]
                    take = min(cut - begin, len(ids) - at)
                    crc = zlib.crc32(ids[at : at + take].astype("<u4").tobytes())
                    rows.append((key, at, take, crc, len(ids), sequence, offset))
                    offset += take
                    begin += take
                    at += take
                    if at == len(ids):
                        d, at = d + 1, held[d + 1][2] if d + 1 < len(held) else 0
                sequence += 1
            held = [(k, ids, at if n == 0 else a) for n, (k, ids, a) in enumerate(held[d:])]
            size = sum(len(ids) - a for _, ids, a in held)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema
            ) if rows else None

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    held.append((key, np.append(ids, ids.dtype.type(end_id)), 0))
                    size += len(ids) + 1
                if size >= segment and (out := solve(False)) is not None:
                    yield out
        if held and (out := solve(True)) is not None:
            yield out

    return docs.mapInArrow(run, SCHEMA)
