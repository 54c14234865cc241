"""WARC archives (6): index first.

Writing leaves one gzip member per record and an index row (file, offset,
length, url, digest, type) per record.  Reading starts from index rows: they
are sorted by place, neighbouring byte ranges of a file are coalesced into one
read, and each record is parsed from its own member.

Records with equal payloads of at least ``min_bytes`` bytes: that with the
smallest page_id is the response, the others are revisits that name it and
carry the payload's digest and size in their header.  Smaller payloads are
always responses.  Null html is an empty payload; a null url leaves the target
out; a row without page_id is never the one that others refer to; rows that
repeat a page_id are records of their own; an empty table gives empty archives;
extra columns are ignored.

Archives and index lie in the shared folder.  A task writes files of its own
attempt, and only files named by rows of the finished index count, so lost or
repeated tasks leave no wrong record.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import shared_dir, small_batches, written

INDEX_SCHEMA = ("file string, offset long, length long, page_id long, url string, payload_digest string, "
                "payload_bytes long, record_type string, refers_to long")
RECORD_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
                 "payload binary")
#: A new file begins beyond FILE_BYTES; ranges at most GAP_BYTES apart are read together, up to READ_BYTES.
FILE_BYTES, GAP_BYTES, READ_BYTES = 128 << 20, 64 << 10, 4 << 20
#: Bytes of archives that a reading task gets on average.
TASK_BYTES = 16 << 20
END = b"\r\n"


def _store(folder: str):
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(path, recursive=True)
    return store, path


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record; a response holds an HTTP message, a revisit no block."""
    revisit = refers_to is not None
    block = b"" if revisit else (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
                                 % len(payload)) + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>", f"X-Page-ID: {page_id}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if revisit:
        target = uuid.uuid5(uuid.NAMESPACE_URL, f"{refers_to} {digest}")
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:uuid:{target}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return END.join([*(h.encode() for h in head), b"", block, b"", b""])


def _parse(data: bytes) -> tuple[dict, bytes]:
    """(header fields, payload) of one record."""
    head, _, rest = data.partition(END * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(END * 2)[2]


def write_archives(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Writes a record per row of (page_id, url, html) and returns the written index."""
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    # only payloads that repeat need a name; counts combine in the map tasks, however hot one payload is
    repeated = written(rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                       .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
                       .select("payload_digest", "first"))
    rows = rows.join(repeated, "payload_digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "payload", "payload_digest", "payload_bytes", refers.alias("refers_to"))
    folder = shared_dir(pages.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        store, path = _store(folder)
        out, name, at, number = None, None, 0, 0
        base = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
        try:
            for batch in batches:
                index = []
                for i in range(len(batch)):
                    page_id, url, payload, digest, size, refers_to = (c[i].as_py() for c in batch.columns)
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, number = f"{base}-{number}.warc.gz", 0, number + 1
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    member = _member(_record(page_id, url, payload, digest, size, refers_to))
                    out.write(member)
                    index.append((name, at, len(member), page_id, url, digest, size,
                                  "response" if refers_to is None else "revisit", refers_to))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in index], t) for k, t in enumerate(kinds)], names)
        finally:
            if out is not None:
                out.close()

    index = written(rows.mapInArrow(run, INDEX_SCHEMA))
    return index.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of some index rows, read back from the archives; digest and size of a response are taken anew.

    Tasks are dealt by the bytes that they will read, not by the index's own size.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    places = (index.select("file", "offset", "length")
              .repartition(max(1, -(-total // TASK_BYTES)), F.col("file"), F.floor(F.col("offset") / F.lit(TASK_BYTES // 4)))
              .sortWithinPartitions("file", "offset"))

    def ranges(batches):
        """(file, [(offset, length)...]) of places that one read covers."""
        held, name, first, end = [], None, 0, 0
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (file != name or offset - end > GAP_BYTES or offset + length - first > READ_BYTES):
                    yield name, held
                    held = []
                if not held:
                    name, first = file, offset
                held.append((offset, length))
                end = offset + length
        if held:
            yield name, held

    def run(batches):
        import pyarrow as pa
        open_name, source, opened = None, None, {}
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        for name, held in ranges(batches):
            if name != open_name:
                if source is not None:
                    source.close()
                folder, _, file = name.rpartition("/")
                if folder not in opened:
                    opened[folder] = _store(folder)
                store, path = opened[folder]
                open_name, source = name, store.open_input_file(f"{path}/{file}")
            first = held[0][0]
            source.seek(first)
            data = source.read(held[-1][0] + held[-1][1] - first)
            rows = []
            for offset, length in held:
                fields, payload = _parse(zlib.decompress(data[offset - first:offset - first + length], 31))
                page_id = fields["X-Page-ID"]
                response = fields["WARC-Type"] == "response"
                rows.append((None if page_id == "None" else int(page_id), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                             None if response else int(fields["X-Refers-To-Page-ID"]),
                             len(payload) if response else int(fields["X-Payload-Length"]),
                             hashlib.sha256(payload).hexdigest() if response
                             else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                             payload if response and with_payload else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return places.mapInArrow(run, RECORD_SCHEMA)
