"""Writing and reading WARC archives.

The writer makes one gzip member for each record.  The reader is splittable:
tasks get byte ranges, look for gzip magic, decode the head of a candidate to see
whether a record begins there, and own the records that start inside their
range, reading past its end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import fresh_path, materialise, parallelism
from loomline.sources.files import opened

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 64 << 20
_READ = 1 << 18
_HEAD = b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least this many bytes are revisited; smaller ones are stored each time.
LEAST_REVISIT = 0
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, number: str | None = None) -> str:
    """The id of a record: that of its page, and a number of its own where several pages share it or have none."""
    return f"<urn:loomline:page:{'' if page_id is None else page_id}{f':{number}' if number else ''}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, number: str | None = None) -> bytes:
    """One record as a gzip member.  The payload of a revisit is left out; its length and digest are those of the whole."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id, number)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {target}"] if target is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(first)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple:
    """(page_id, url, type, refers_to, payload_bytes, digest, payload) of a decoded record; the digest of a stored payload is computed, and must match."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    ident = lambda urn: int(x) if (x := urn.rstrip(">").split(":")[3]) else None
    revisit = fields["WARC-Type"] == "revisit"
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (digest(payload) != said or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return ident(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], ident(fields["WARC-Refers-To"]) if revisit else None, size, said, None if revisit else payload


def write(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write one archive a partition; returns the folder and a table of (path, records, bytes).

    Of pages with equal payloads the one of the smallest page_id is stored and
    the others revisit it.  Rows that share that page_id are all stored.  A null
    page_id revisits whatever equal page has an id; without one it is stored.
    Records of pages that share an id, or lack one, get a number after it, so
    that record ids are unique.  Payloads may be of any length.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("_sha1"), F.xxhash64(payload).alias("_h"))
    groups = rows.groupBy("_sha1", "_h").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    groups = materialise(groups.select(F.col("_sha1").alias("_g"), "_h", "first"), "payload_groups")
    rows = rows.join(groups.withColumnRenamed("_h", "_gh"), (F.col("_sha1") == F.col("_g")) & (F.col("_h") == F.col("_gh")), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= LEAST_REVISIT), F.lit(False))
    shared = rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 or page_id is null").select(F.col("page_id").alias("_shared"))
    shared = materialise(shared, "shared_ids")
    rows = rows.join(shared, F.col("page_id").eqNullSafe(F.col("_shared")), "left") if shared.limit(1).count() else rows.withColumn("_shared", F.lit(None).cast("long"))
    many = F.col("_shared").isNotNull() | F.col("page_id").isNull()
    rows = rows.select("page_id", "url", "payload", "first", revisit.alias("revisit"), many.alias("many")).sortWithinPartitions("page_id", "url")

    def run(batches):
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs, path = opened(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                draft = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
                out = fs.open_output_stream(draft, compression=None)
            for *row, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(*row, f"{TaskContext.get().partitionId()}-{n}" if many else None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            fs.move(draft, path)  # a repeated attempt puts the same bytes in the same place
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["path", "records", "bytes"])

    return folder, materialise(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def scan(read, begin: int, end: int, size: int):
    """Decoded records that start in [begin, end) of a file of ``size`` bytes; read(offset, n) gives its bytes."""
    at = begin
    while at < end:
        # the next place in the range that may begin a member; magic may straddle two reads
        data = read(at, min(_READ, size - at))
        found = data.find(MAGIC)
        if found < 0:
            if at + len(data) >= size:
                return
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        z, parts, pos, bad = zlib.decompressobj(31), [], at, False
        while not z.eof and not bad:
            data = read(pos, min(_READ, size - pos))
            if not data:
                bad = True
                break
            try:
                parts.append(z.decompress(data))
            except zlib.error:
                bad = True
            pos += len(data)
            head = b"".join(parts)[: len(_HEAD)] if len(parts) < 3 else _HEAD
            bad |= not _HEAD.startswith(head) if len(head) < len(_HEAD) else head != _HEAD
        if bad:
            at += 1
            continue
        yield b"".join(parts)
        at = pos - len(z.unused_data)


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all archives (*.gz) in a folder, by ranges of split_bytes."""
    fs, path = opened(folder)
    base = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    found = [f for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".gz") and f.size]
    splits = [(f"{base}{f.path}", i, min(i + split_bytes, f.size), f.size) for f in sorted(found, key=lambda f: f.path) for i in range(0, f.size, split_bytes)]
    if not splits:
        return spark.createDataFrame([], RECORD)
    ranges = spark.createDataFrame(splits, "path string, begin long, end long, size long").repartition(min(len(splits), 4 * parallelism(spark)))

    def run(batches):
        for batch in batches:
            for name, begin, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, place = opened(name)
                with source.open_input_file(place) as file:
                    rows, held = [], 0
                    for data in scan(lambda at, n: file.read_at(n, at), begin, end, size):
                        rows.append(parse(data))
                        held += len(data)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return ranges.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in RECORD.split(", ")])


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url leaves the target out.  Repeated
    rows are records each.  An empty table makes no archive and gives no rows.
    Extra columns are ignored.
    """
    folder, _ = write(pages)
    return read(pages.sparkSession, folder, split_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
