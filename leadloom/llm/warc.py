"""WARC archives: written as one gzip stream, normalised to one member per record with an offset index, read back.

Each task writes its records to a monolithic .warc.gz, a single gzip stream as crawlers that compress whole files
leave it.  The normaliser inflates such a stream once, in pieces, writes every record as its own gzip member and beside
the archive an index of offset, length and record id.  Readers seek to a member by that index and inflate it alone.

Payloads of at least ``MIN_PAYLOAD`` bytes that are equal are stored once: the record with the largest id is the
response, the others are revisits that refer to it and hold no payload.  Rows that repeat the response's id and
payload are responses too.  Null html is an empty payload; a null url gets a urn of the id.  An empty table gives no archive.

Files go to the shared folder; names carry the task attempt and only those that finished tasks report are read,
so a task that runs again leaves a file that nobody reads.  The monolithic files are removed by the driver once
the normalised ones are reported.
"""

import json
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.tables import new_path, stored

MIN_PAYLOAD = 1000
#: A task starts a new archive beyond so many bytes of records.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
#: Up to so many repeated payloads (36 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_PAYLOADS = 1_000_000
_PIECE = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a shared folder: a plain path or any URI that Arrow knows."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark takes it: a plain path is one of the default file system, not of this machine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _name(page_id) -> str:
    """An id as a URN without characters that end a line or the URN; null and the empty text differ."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def _page(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:"):-1]) if urn and urn.startswith("<urn:page:") else None


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record with its closing blank lines."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {_clean(url or _name(page_id)[1:-1])}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = _HTTP + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def inflated(source, piece: int = _PIECE) -> Iterator[bytes]:
    """A gzip file of one or several members, inflated in pieces of bounded size."""
    inflate = zlib.decompressobj(31)
    while data := source.read(piece):
        while data:
            yield inflate.decompress(data, piece)
            while inflate.unconsumed_tail and not inflate.eof:
                yield inflate.decompress(inflate.unconsumed_tail, piece)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
                if not data.strip(b"\0"):
                    data = b""
            else:
                data = b""
    yield inflate.flush()


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream, one at a time; a stream that ends within one is an error."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        got = next(pieces, None)
        if got is None:
            return False
        held.extend(got)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("the archive ends within a record's head")
                return
        size = end + 4 + int(headers(bytes(held[:end]))["Content-Length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:size])
        del held[:size]


def parsed(whole: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    end = whole.index(b"\r\n\r\n")
    head = headers(whole[:end])
    body = whole[end + 4:end + 4 + int(head["Content-Length"])]
    return head, body[body.index(b"\r\n\r\n") + 4:]


def _gzip():
    return zlib.compressobj(LEVEL, zlib.DEFLATED, 31)


def written(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(archive, n) of the monolithic archives; equal payloads are found by length and digest."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    again = (rows.where(F.col("bytes") >= MIN_PAYLOAD).groupBy("digest", "bytes")
             .agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    again = stored(again, "payloads")
    few = again.count() <= BROADCAST_PAYLOADS
    rows = rows.join(F.broadcast(again) if few else again, ["digest", "bytes"], "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _folder(folder)
        task = TaskContext.get()
        out, gzip, size, done, count = None, None, 0, [], 0

        def close():
            out.write(gzip.flush())
            out.close()
            done.append((name, count))

        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                page_id, url, payload, digest, refers_to = (v.as_py() for v in row)
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                    out, gzip, size, count = system.open_output_stream(f"{top}/{name}", compression=None), _gzip(), 0, 0
                whole = record(page_id, url, payload, digest, refers_to)
                out.write(gzip.compress(whole))
                size, count = size + len(whole), count + 1
                if size > ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done]), pa.array([n for _, n in done])], ["archive", "n"])

    _folder(folder)[0].create_dir(_folder(folder)[1], recursive=True)
    return rows.mapInArrow(run, "archive string, n long")


def normalised(archives: DataFrame, source: str, target: str) -> DataFrame:
    """(archive, n) again, after each archive has been rewritten member by member with an index beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _folder(source)
        _, goal = _folder(target)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz"
                offset = count = 0
                with (system.open_input_stream(f"{top}/{name}", compression=None) as read,
                      system.open_output_stream(f"{goal}/{made}", compression=None) as out,
                      system.open_output_stream(f"{goal}/{made}.idx", compression=None) as index):
                    for whole in records(inflated(read)):
                        gzip = _gzip()
                        member = gzip.compress(whole) + gzip.flush()
                        out.write(member)
                        record_id = headers(whole[:whole.index(b"\r\n\r\n")])["WARC-Record-ID"]
                        index.write((json.dumps([offset, len(member), record_id]) + "\n").encode())
                        offset, count = offset + len(member), count + 1
                if count != n:
                    raise ValueError(f"{name} has {count} records, not {n}")
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([n])], ["archive", "n"])

    _folder(target)[0].create_dir(_folder(target)[1], recursive=True)
    return archives.repartition(max(1, archives.count())).mapInArrow(run, "archive string, n long")


def read_back(archives: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, found through the indexes.

    A response's figures come from the payload read; it must have the digest that its head states.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with (system.open_input_stream(f"{top}/{name}.idx", compression=None) as index,
                      system.open_input_file(f"{top}/{name}") as archive):
                    for line in index.read().splitlines():
                        offset, length, _ = json.loads(line)
                        archive.seek(offset)
                        head, payload = parsed(zlib.decompress(archive.read(length), 31))
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response" and (sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{name}, offset {offset}: the payload is not the one that was stored")
                        rows.append((_page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"],
                                     _page(head.get("WARC-Refers-To"))))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    read = archives.repartition(max(1, archives.count())).mapInArrow(
        run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.select(F.col("page_id").cast(id_type), *names[1:4], F.col("refers_to").cast(id_type))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, normalise and read back the archives of a table of pages."""
    spark = pages.sparkSession
    whole, split = (qualified(spark, new_path(spark, n)) for n in ("warc-whole", "warc"))
    first = stored(written(pages, whole, id_col, url_col, html_col), "warc-list")
    second = stored(normalised(first, whole, split), "warc-list")
    system, top = _folder(whole)
    system.delete_dir(top)
    return read_back(second, split, pages.schema[id_col].dataType.simpleString())
