"""WARC archives: monolithic gzip files normalised to one gzip member per record.

Crawlers often compress a whole archive as one gzip stream, which can only be read from
its start. The normaliser inflates such a file once, rewrites every record as a member of
its own and writes a sidecar index of offsets, so any record can then be read alone. All
files live in the shared folder and are written under a temporary name first, so a task
that runs again leaves nothing half done.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.runtime import delete_at_exit, shared_dir, shuffle_partitions, written

#: Payloads shorter than this are always stored; raw bytes after which a new archive begins.
LEAST_REVISIT, ARCHIVE_BYTES = 100, 64 << 20
#: Neighbouring records of so many compressed bytes are read by one task.
READ_BYTES = 1 << 20
_END = b"\r\n\r\n"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn[10:-1] else None


def format_record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None, when: datetime) -> bytes:
    """One uncompressed record; a revisit carries no payload but names the full one's digest and size."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + _END + payload + _END


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:])


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed stream; memory holds one record and one chunk."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(_END, at)) >= 0:
            last = end + 4 + int(parse_head(bytes(held[at:end]))["Content-Length"]) + 4
            if last > len(held):
                break
            yield bytes(held[at:last])
            at = last
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def inflate(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members, read once from its start."""
    machine = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            yield machine.decompress(data)
            if not machine.eof:
                break
            data, machine = machine.unused_data, zlib.decompressobj(31)


def deflated(data: bytes) -> bytes:
    machine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return machine.compress(data) + machine.flush()


def _published(store: fs.FileSystem, path: str):
    """A stream to a temporary name, and what gives it its real one."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    return store.open_output_stream(draft, compression=None), lambda: store.move(draft, path)


def assign(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Records to write: of equal payloads of at least 100 bytes the smallest id is stored, others revisit it.

    A null payload is empty; a row with a null id revisits if any equal payload has an id.
    Rows that repeat the smallest id are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and first is not null").select("digest", "first")
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    return rows.join(first, "digest", "left").select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size", F.when(again, F.col("first")).alias("refers_to")
    )


def writers_for(pages: DataFrame, payload_col: str = "html") -> int:
    """Tasks that fill whole archives, one for each core at least."""
    size = pages.agg(F.sum(F.octet_length(payload_col).cast("long"))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // ARCHIVE_BYTES))


def write_monolithic(records: DataFrame, folder: str, writers: int | None = None, when: datetime = datetime(2020, 1, 1, tzinfo=UTC)) -> DataFrame:
    """Write records as archives that are each one gzip stream; gives ``(path, n_records)`` of each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, seq, held, n = TaskContext.get().partitionId(), 0, 0, 0
        out = machine = publish = None
        done = []

        def close() -> None:
            out.write(machine.flush())
            out.close()
            publish()
            done.append((path, n))

        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and held > ARCHIVE_BYTES:
                    close()
                    out = None
                if out is None:
                    path = f"{root}/part-{part:06d}-{seq:04d}.warc.gz"
                    (out, publish), machine, held, n, seq = _published(store, path), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0, seq + 1
                record = format_record(row["page_id"], row["url"], row["kind"], row["payload"], row["digest"], row["size"], row["refers_to"], when)
                out.write(machine.compress(record))
                held, n = held + len(record), n + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "n_records"])

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    records = records.coalesce(writers) if writers else records
    return written(records.mapInArrow(write, "path string, n_records long"), "archives", merge=False)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``(path)`` with a member for every record; gives ``(path, offset, length)`` of all records.

    The same offsets are written beside each archive as ``<archive>.idx``, a line of
    record id, offset and length for each record.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path = f"{root}/members-{source.rsplit('/', 1)[-1]}"
                (out, publish), at, index, lines = _published(store, path), 0, [], []
                with store.open_input_stream(source, compression=None) as stream:
                    for record in split_records(inflate(stream)):
                        member = deflated(record)
                        out.write(member)
                        index.append((path, at, len(member)))
                        lines.append(f"{parse_head(record[: record.index(_END)])['WARC-Record-ID']}\t{at}\t{len(member)}\n")
                        at += len(member)
                out.close()
                publish()
                side, publish = _published(store, f"{path}.idx")
                side.write("".join(lines).encode())
                side.close()
                publish()
                columns = list(zip(*index, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "offset", "length"])

    spread = archives.select("path").repartition(shuffle_partitions(archives.sparkSession), "path")
    return written(spread.mapInArrow(rewrite, "path string, offset long, length long"), "offsets")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Read every record of an index by its offset; sizes and digests of responses are taken from the payload."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        current, file = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] != current:
                    if file is not None:
                        file.close()
                    current, file = row["path"], store.open_input_file(row["path"])
                record = zlib.decompress(file.read_at(row["length"], row["offset"]), 31)
                end = record.index(_END)
                head = parse_head(record[:end])
                size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response":
                    payload = record[end + 4 : end + 4 + int(head["Content-Length"])]
                    size, found = len(payload), hashlib.sha256(payload).hexdigest()
                    if found != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
                out.append((_page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To"))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    near = (F.col("offset") / READ_BYTES).cast("long")
    spread = index.repartition(shuffle_partitions(index.sparkSession), "path", near).sortWithinPartitions("path", "offset")
    return spread.mapInArrow(load, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive every page, normalise the archives and read them back: one row for every page.

    Ids must be integers. A null id is written and read back as null, repeated rows are
    records of their own, and a null payload is empty. An empty table gives no archive and no
    rows. Other columns are not read. A folder of our own is deleted when the driver ends.
    """
    if folder is None:
        folder = f"{shared_dir(pages.sparkSession)}/braidlog-warc-{uuid.uuid4().hex}"
        delete_at_exit(pages.sparkSession, folder)
    archives = write_monolithic(assign(pages), folder, writers_for(pages))
    return read(normalise(archives, folder), folder)
