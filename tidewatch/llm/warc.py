"""WARC archives through a table of payload chunks.

A page's payload becomes rows of record key, chunk number and at most ``CHUNK_BYTES`` bytes, cut by Spark before any Python
code sees them. The table carries the bytes and the SHA-1 of the payload up to each chunk's end, computed from chunk to
chunk; a record's digest is that of its last chunk. Arrow batches hold at most ``BATCH_ROWS`` chunks. Writer tasks get the
chunks of a record in order and stream them into ``.warc.gz`` files (one gzip member per record), hashing on and comparing
with the table's digest at the end; readers stream the files the same way. Only the value in Spark's own row is whole.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is a response, the others are
revisits that name it by its id and URI and hold no payload.

Defined results: a null payload is empty; records of null id in a group with other ids are revisits, in a group of
their own responses; repeated rows of one id and payload each give a record of the same type, with a record id of its own;
an empty table gives no archive and no row; other columns are ignored and may have any name. A file is written under a
temporary name and moved in place when complete, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import Workspace, make_dir, move_file, open_file, rows_per_batch, shared_dir

CHUNK_BYTES = 256 << 10
#: Rows of an Arrow batch of chunks, and of one of records read.
BATCH_ROWS = 256
READ_ROWS = 4_096
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, uri, key, content, n_bytes, n_chunks, chunk_no, data) of ``pages`` (id, uri, payload): ``key`` numbers the page
    rows, ``content`` is a hash of the payload. The chunks of a row follow each other."""
    rows = pages.select("id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.monotonically_increasing_id().alias("key"), F.xxhash64("payload").alias("content"), F.octet_length("payload").cast("long").alias("n_bytes"))
    rows = rows.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes)).cast("int"))
    cut = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    data = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return cut.select("id", "uri", "key", "content", "n_bytes", "n_chunks", "chunk_no", data.alias("data"))


def chunk_table(pages: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``chunk_rows`` with bytes_so_far, digest_so_far and last; without the data if only these are wanted."""
    import pyarrow as pa

    rest = ["id", "uri", "key", "content", "n_bytes", "chunk_no"]
    schema = "id long, uri string, key long, content long, n_bytes long, chunk_no int, bytes_so_far long, digest_so_far string, last boolean" + ", data binary" * with_data

    def run(batches):
        running, seen = hashlib.sha1(), 0
        for batch in batches:
            sizes, digests, lasts = [], [], []
            for chunk_no, n_chunks, data in zip(batch.column("chunk_no").to_pylist(), batch.column("n_chunks").to_pylist(), batch.column("data"), strict=True):
                if chunk_no == 0:
                    running, seen = hashlib.sha1(), 0
                piece = memoryview(data.as_buffer())
                running.update(piece)
                seen += len(piece)
                sizes.append(seen)
                digests.append(base32(running.digest()))
                lasts.append(chunk_no + 1 == n_chunks)
            columns = [*[batch.column(c) for c in rest], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(lasts, pa.bool_())]
            names = [*rest, "bytes_so_far", "digest_so_far", "last"]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("data")] if with_data else columns, [*names, "data"] if with_data else names)

    return chunk_rows(pages, chunk_bytes).mapInArrow(run, schema)


def record_types(pages: DataFrame, min_bytes: int, space: Workspace) -> DataFrame:
    """(id, content, n_bytes, digest, refers_to, refers_uri), once for each id and payload; revisits refer to a response.

    Groups are counted with partial sums; only groups of several records are joined back, through two plain exchanges,
    so that the partition of a payload that a large part of all pages share is split at run time."""
    with rows_per_batch(pages.sparkSession, BATCH_ROWS):
        found = chunk_table(pages, with_data=False).filter("last").select("id", "uri", "content", "n_bytes", F.col("digest_so_far").alias("digest"))
        found = space.write(found, "payload-digests")
    groups = found.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.min("id").alias("first"), F.min_by("uri", "id").alias("first_uri"), F.count("*").alias("n"))
    shared = space.write(groups.filter("n > 1 AND first IS NOT NULL").drop("n"), "shared-payloads")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    typed = found.join(shared, ["digest", "n_bytes"], "left").select("id", "content", "n_bytes", "digest", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_uri")).alias("refers_uri"))
    return space.write(typed.distinct(), "record-types")


def head(record_type: str, id_, uri, digest: str, n_bytes: int, refers_to, refers_uri, date: str, place: str) -> bytes:
    """Headers of a record; ``place`` (file and number) makes its id its own."""

    def address(of):
        return "".join(of.splitlines())

    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMES, f'{id_}/{digest}/{place}')}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(HTTP_HEAD) + (n_bytes if record_type == 'response' else 0)}",
    ]
    if id_ is not None:
        lines.append(f"X-Page-ID: {id_}")
    if uri:
        lines.append("WARC-Target-URI: " + address(uri))
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        if refers_uri:
            lines.append("WARC-Refers-To-Target-URI: " + address(refers_uri))
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, folder: str, space: Workspace, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Streams the chunks (with digest, refers_to and refers_uri) into archives; returns the manifest: path, n_records."""
    import pyarrow as pa
    from pyspark import TaskContext

    make_dir(folder)
    names = ["id", "uri", "n_bytes", "digest", "chunk_no", "n_chunks", "refers_to", "refers_uri", "data"]

    def run(batches):
        task = TaskContext.get()
        path, file, n_records, member, running = f"{folder}/part-{task.partitionId():06d}.warc.gz", None, 0, None, None
        temporary = f"{path}.{task.taskAttemptId()}.tmp"
        for batch in batches:
            for id_, uri, n_bytes, digest, chunk_no, n_chunks, refers_to, refers_uri, data in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                file = file or open_file(temporary, "wb")
                is_response = refers_to is None
                if chunk_no == 0:
                    member, running, n_records = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1(), n_records + 1
                    place = f"{task.partitionId()}/{n_records}"
                    file.write(member.compress(head("response" if is_response else "revisit", id_, uri, digest, n_bytes, refers_to, refers_uri, date, place) + HTTP_HEAD))
                if is_response:
                    running.update(data)
                    file.write(member.compress(data))
                if not is_response or chunk_no + 1 == n_chunks:
                    if is_response and base32(running.digest()) != digest:
                        raise ValueError(f"page {id_}: its chunks do not give the digest of its payload")
                    file.write(member.compress(b"\r\n\r\n") + member.flush())
        if file:
            file.close()
            move_file(temporary, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n_records]})

    ordered = chunks.select("key", *names).sortWithinPartitions("id", "key", "chunk_no")
    with rows_per_batch(chunks.sparkSession, BATCH_ROWS):
        return space.write(ordered.select(*names).mapInArrow(run, "path string, n_records long"), "warc-manifest")


def records(path: str):
    """Headers (lower-case names) and payload size and digest of each record, by streaming."""
    with open_file(path, "rb") as raw, gzip.GzipFile(fileobj=raw) as file:
        while line := file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: not a WARC record")
            fields = {}
            while (line := file.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name.lower()] = value.strip()
            left = int(fields["content-length"])
            while left:
                line = file.readline(left)
                left -= len(line)
                if not line.strip():
                    break
            running, size = hashlib.sha1(), left
            while left:
                piece = file.read(min(left, CHUNK_BYTES))
                if not piece:
                    raise ValueError(f"{path}: cut short")
                running.update(piece)
                left -= len(piece)
            yield fields, size, base32(running.digest())


READ = "id long, uri string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per record of the archives: id, uri, record_id, payload_bytes, payload_digest, record_type, refers_to."""
    import pyarrow as pa

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in READ.split(", ")])

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for fields, size, digest in records(path):
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (said, fields["x-payload-length"]) != (digest, str(size)):
                        raise ValueError(f"{path}: payload of {fields['warc-record-id']} is damaged")
                    number = [int(x) if (x := fields.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page")]
                    rows.append((number[0], fields.get("warc-target-uri"), fields["warc-record-id"], int(fields["x-payload-length"]), said, fields["warc-type"], number[1]))
                    if len(rows) == READ_ROWS:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n_tasks).mapInArrow(run, READ)


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record for each page row to ``folder``; returns the manifest of the archives."""
    space = Workspace(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), F.col(payload_col).cast("binary").alias("payload"))
    types = record_types(own, min_bytes, space).withColumnsRenamed({c: f"own_{c}" for c in ("id", "content", "n_bytes")})
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content")) & (F.col("n_bytes") == F.col("own_n_bytes"))
    # Revisits go on without their payload, in one row.
    typed = chunk_rows(own).join(types, same).filter("refers_to IS NULL OR chunk_no = 0").withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")))
    manifest = write_archives(typed, folder, space)
    space.drop("payload-digests", "shared-payloads", "record-types")
    return manifest


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder and returns the records as read back."""
    spark = pages.sparkSession
    return read_archives(spark, archive_pages(pages, shared_dir(spark, "warc"), min_bytes=min_bytes))
