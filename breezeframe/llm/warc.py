"""WARC archives: write, normalise to one gzip member per record, read back.

Writing goes through Spark's own text writer with gzip, so an archive is one monolithic gzip
stream and may lie in any store Spark can write to: every row is a record (header and
payload), and the line separator is the record separator ``CR LF CR LF``.

The normaliser opens each archive where it lies, inflates its stream once, piece by piece, cuts it into records
by their ``Content-Length``, writes every record as a gzip member of its own and, beside the
new archive, a sidecar index: a tab-separated line of page, offset and length of the member,
type, digest and payload size. Members are written to a temporary name and moved into place,
so a task that runs again leaves one whole file. Archives are read and written with pyarrow's
file systems, by the path's own scheme; a worker holds a piece and a record, never an archive.
Reading back goes by slices of ``SLICE`` index lines, dealt to as many tasks.

Of records with equal payloads (of ``min_bytes`` or more) the one with the smallest id is a
*response*, the others are *revisits* without payload that refer to it.

Defined results: a null payload is the empty one; rows without id count as copies of a row
that has one, else all of them are responses; rows that repeat the smallest id are all
responses; a null address is written as an empty one, line breaks in it as ``%0D`` and
``%0A``; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeframe.llm.common import materialise, scratch_path

SEPARATOR = "\r\n\r\n"
PIECE = 1 << 20
#: records read back by one row, and the most tasks that archives or slices are dealt to
SLICE, MOST_TASKS = 2000, 20_000
FIELDS = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "url string, payload binary, archive string, offset bigint"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def typed(pages: DataFrame, min_bytes: int = 0, id_column="page_id", url_column="url", payload_column="html") -> DataFrame:
    """Adds size, digest, type and the page referred to. The payload is shuffled once, by its
    digest; the hot digest of a large group of copies is an ordinary skewed join."""
    full = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_column), F.lit("")).alias("payload"),
    )
    full = full.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", base32_sha1(F.col("payload")))
    first = full.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    joined = full.join(first, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record(date: str = "1970-01-01T00:00:00Z") -> Column:
    """One row of :func:`typed` as WARC text, without the separator behind it."""
    shown = F.when(F.col("type") == "response", F.col("payload")).otherwise("")
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(shown).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(SEPARATOR), shown)


def write_archives(pages: DataFrame, path: str, records_per_archive: int = 50_000) -> None:
    """Monolithic gzip archives below ``path``; ``pages`` as :func:`typed` gives them."""
    writer = pages.select(record().alias("value")).write.option("lineSep", SEPARATOR)
    writer.option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def inflate(stream, piece: int = PIECE):
    """Bytes of a gzip stream (also of several members), a piece at a time."""
    engine = zlib.decompressobj(31)
    while data := stream.read(piece):
        while data:
            yield engine.decompress(data, piece)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, piece)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
    yield engine.flush()


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:80]!r}")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])


def records(pieces):
    """(header fields, whole record) of an inflated archive, in order."""
    held, end = bytearray(), SEPARATOR.encode()
    pieces = iter(pieces)

    def fill(size: int) -> bool:
        while len(held) < size:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        at, seen = held.find(end), 0
        while at < 0:
            seen = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                if held:
                    raise ValueError("the archive ends inside a header")
                return
            at = held.find(end, seen)
        fields = parse(bytes(held[:at]))
        size = at + 4 + int(fields["Content-Length"]) + 4
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[:size])
        del held[:size]


def _page(text: str | None) -> str:
    return (text or "")[len("<urn:page:") : -1]


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive below ``source``; one row per archive: path, index, records."""

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, folder = _store(target)
                name = path.rsplit("/", 1)[-1].split(".")[0]
                draft = f"{folder}/.{name}-{os.urandom(4).hex()}"
                store.create_dir(folder)
                at, lines = 0, []
                origin, file = _store(path)
                with origin.open_input_stream(file, compression=None) as stream, store.open_output_stream(draft) as out:
                    for fields, whole in records(inflate(stream)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(whole) + engine.flush()
                        out.write(member)
                        lines.append("\t".join((
                            _page(fields["WARC-Record-ID"]), str(at), str(len(member)), fields["WARC-Type"],
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["X-Payload-Length"],
                        )))
                        at += len(member)
                with store.open_output_stream(f"{draft}.idx") as out:
                    out.write("".join(f"{x}\n" for x in lines).encode())
                store.move(f"{draft}.idx", f"{folder}/{name}.warc.idx")
                store.move(draft, f"{folder}/{name}.warc.gz")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{target}/{name}.warc.gz"]), pa.array([f"{target}/{name}.warc.idx"]), pa.array([len(lines)])],
                    ["archive", "index", "records"],
                )

    # names only: the content is never a cell
    files = materialise(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path"), "warc-files")
    return _dealt(files, "path").mapInArrow(run, "archive string, index string, records bigint")


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """A row a task, as far as ``MOST_TASKS`` goes. Small rows that stand for much work would
    be put into one task otherwise; a counted repartition is left alone."""
    return rows.repartition(min(max(rows.count(), 1), MOST_TASKS), *by)


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, fetched member by member through the index; a
    payload is checked against its digest."""

    def run(batches):
        import base64

        import pyarrow as pa

        names = [c.split()[0] for c in FIELDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

        for batch in batches:
            for path, index, begin in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                store, file = _store(path)
                with store.open_input_stream(_store(index)[1], compression=None) as f:
                    entries = f.read().decode().splitlines()[begin : begin + SLICE]
                rows, size = [], 0
                with store.open_input_file(file) as f:
                    for entry in entries:
                        page, offset, length, kind, digest, n = entry.split("\t")
                        f.seek(int(offset))
                        ((fields, whole),) = records([zlib.decompress(f.read(int(length)), 31)])
                        payload = whole[whole.index(SEPARATOR.encode()) + 4 : -4]
                        if kind == "response" and (
                            len(payload) != int(n) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
                        ):
                            raise ValueError(f"{path} at {offset}: the payload does not match its digest")
                        first = _page(fields.get("WARC-Refers-To"))
                        rows.append((
                            int(page) if page else None, int(n), digest, kind, int(first) if first else None,
                            fields["WARC-Target-URI"], payload, path, int(offset),
                        ))
                        size += len(payload)
                        if size > PIECE:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.lit(SLICE).cast("bigint")))
    slices = archives.where("records > 0").select("archive", "index", begins.alias("begin"))
    return _dealt(slices, "archive", "begin").mapInArrow(run, FIELDS)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, **columns) -> DataFrame:
    """Write, normalise and read back; ``folder`` defaults to one in the shared folder."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_archives(typed(pages, min_bytes, **columns), f"{folder}/raw")
    return read_records(materialise(normalise(spark, f"{folder}/raw", f"{folder}/members"), "warc-list"))
