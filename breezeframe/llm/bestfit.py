"""Best-fit packing planned over a histogram of lengths.

How many sequences are needed, and what lies in each, depends only on how many pieces there
are of every length. So:

1. Each task tokenises its documents and cuts those above ``length`` into full pieces and a
   rest. It numbers the pieces of one length as it meets them (``rank``, per task and length),
   so that no sort or window over the documents is needed. The pieces, a few numbers each, are
   written to the shared folder; the texts are not read again.
2. Counts per task and length are summed over the tasks before each one: a piece's rank among
   all pieces of its length is that sum plus its own rank. Only counts are ordered here.
3. The histogram, at most ``length`` rows, goes to the driver, which runs best-fit decreasing
   over *counts*: all open sequences of one filling are one class, and a length is put into as
   many sequences of the tightest class at a time as it fills. The plan is a list of runs: "the
   pieces of length l from rank a to b take m places each in the sequences from s on, at offset
   o". A length splits at most one class and opens at most two, so the plan is bounded by the
   square of ``length`` at worst and has a few thousand runs in practice, however many
   documents there are.
4. Pieces join the plan on their length and find their run by rank. A third of all pieces may
   have one length: the plan side is small, so that join needs no shuffle of the pieces.

Best-fit decreasing over counts gives the same fillings as over the pieces one by one: between
equal lengths it does not matter which piece takes a place.

Defined results: null text counts as empty (the document is its end id alone); repeated rows
are packed as often as they occur; null ids stay null; an empty table gives no rows; other
columns of the input are ignored. Sequence numbers run from 0 without gaps. A run again may
deal pieces of equal length to other sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.llm.common import materialise, worker_cache
from breezeframe.llm.tokens import Encoder, Files

PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, rank bigint"
)
RUNS = "length bigint, runs array<struct<first:bigint,until:bigint,per:bigint,sequence:bigint,offset:bigint>>"


def cut(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """One row per piece, numbered per task and length."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder(worker_cache(f"files_{tokenizer}", lambda: Files(tokenizer)))
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        seen: dict[int, int] = {}
        schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in PIECES.split(", ")])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), length)):
                        piece = ids[start : start + length]
                        rank = seen.get(len(piece), 0)
                        seen[len(piece)] = rank + 1
                        rows.append((key, n, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, rank))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                    )

    return docs.select(F.col(id_column).cast("bigint"), text_column).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], length: int) -> tuple[dict[int, list[tuple]], int]:
    """Best-fit decreasing over counts: per piece length the runs ``(first rank, rank after the
    last, places per sequence, first sequence, offset)``, and the number of sequences."""
    runs: dict[int, list[tuple]] = {}
    rooms: list[int] = []  # room left in open classes, ascending and distinct
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]
    total = 0

    def add(room, first, many):
        if room and many:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, many))

    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        left, rank = histogram[size], 0
        found = runs.setdefault(size, [])
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:  # nothing has room: new sequences, as many as this length needs
                room, first, many = length, total, -(-left // (length // size))
                total += many
            per = room // size
            full = min(many, left // per)
            if full:
                found.append((rank, rank + full * per, per, first, length - room))
                rank, left = rank + full * per, left - full * per
                add(room - per * size, first, full)
                first, many = first + full, many - full
            if left and many:  # the last, partly filled one
                found.append((rank, rank + left, left, first, length - room))
                add(room - left * size, first, 1)
                first, many, left = first + 1, many - 1, 0
            add(room, first, many)
    return runs, total


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document, and the place it takes.

    ``tokenizer`` is the path of a tokenizer file that every executor can open. A document is its
    ids and ``end_id``. The pieces are made when this is called, not when the result is read.
    """
    spark = docs.sparkSession
    pieces = materialise(cut(docs, tokenizer, length, end_id, id_column, text_column), "bestfit-pieces")
    counts = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("many")), "bestfit-counts")
    histogram = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    runs, _ = plan(histogram, length)
    rows = [(size, [(a, b, m, s, o) for a, b, m, s, o in found]) for size, found in runs.items()]
    plans = spark.createDataFrame(rows, RUNS)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    mine = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["until"]))[0]
    placed = placed.join(F.broadcast(plans), "length").withColumn("run", mine)
    nth = F.col("rank") - F.col("run.first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("run.sequence") + F.floor(nth / F.col("run.per"))).alias("sequence_id"),
        (F.col("run.offset") + nth % F.col("run.per") * F.col("length")).alias("offset"),
    )
