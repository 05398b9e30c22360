"""WARC archives: a writer with revisit records and a splittable reader.

Archives are gzip files with one member per record. The reader's tasks take byte ranges: a task looks for
gzip magic from the start of its range, accepts a place only if the member inflates to a WARC record header,
and then follows the chain of members. It owns the records that start inside its range and reads the last
one past the range's end, so each record is read by exactly one task whatever the ranges are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.session import scratch_path, stored

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Rows up to which the list of revisit decisions is broadcast; longer lists are joined by a shuffle.
BROADCAST_ROWS = 200_000


def open_fs(uri: str):
    """(file system, path) of a URI in any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One gzip member. A revisit holds no payload, but its digest and size; the original is named by refers_to."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"]
    head += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Bytes: {len(payload)}"]
    head += [f"X-Page-Id: {page_id}"] * (page_id is not None) + [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] * revisit
    text = "\r\n".join([*head, "Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(text) + squeeze.flush()


def decisions(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, key, refers_to of the pages that revisit another: equal payloads, smallest page_id first.

    Payloads shorter than ``least_bytes`` never revisit. Rows with a null page_id neither revisit nor are
    referred to. Rows that repeat the smallest page_id with its payload are responses too.
    """
    keyed = pages.select("page_id", "key", "size").where("page_id is not null").where(F.col("size") >= least_bytes)
    first = keyed.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return keyed.join(first, "key").where("page_id <> refers_to").select("page_id", "key", "refers_to").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into archives, one a task; path, bytes, records of each.

    Null html is an empty payload. A task writes under a name of its own and renames it when it is whole, and
    the returned manifest names finished files only, so tasks that are run again or twice do no harm.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"key": F.unhex(F.sha2(F.col("html"), 256)), "size": F.octet_length("html")})
    to = stored(decisions(rows, least_bytes), "warc-revisits")
    small = to.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    typed = rows.drop("size").join(F.broadcast(to) if small else to, ["page_id", "key"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        file = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        name = f"{base}/{file}"
        size = count = 0
        out = None
        for b in batches:
            for page, url, html, to in zip(*(b.column(i) for i in range(4)), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{name}.open")
                raw = record(page.as_py(), url.as_py(), html.as_py().encode(), to.as_py())
                out.write(raw)
                size, count = size + len(raw), count + 1
        if out is not None:
            out.close()
            fs.move(f"{name}.open", name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{file}"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

    return stored(typed.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class Window:
    """Bytes of a file from a place on, fetched a chunk at a time; grown and cut in place."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, bytearray()

    def more(self) -> bool:
        self.file.seek(self.base + len(self.data))
        got = self.file.read(CHUNK)
        self.data += got
        return bool(got)

    def forget(self, before: int) -> None:
        del self.data[: before - self.base]
        self.base = before


def is_member(window: Window, at: int) -> bool:
    """Whether a gzip member that holds a WARC record starts at a place: its first bytes inflate to a header, whatever follows it."""
    while len(window.data) < at - window.base + 4096 and window.more():
        pass
    inflater, text = zlib.decompressobj(31), b""
    try:
        for place in range(at - window.base, min(len(window.data), at - window.base + (1 << 16)), 256):
            text += inflater.decompress(bytes(window.data[place : place + 256]))
            if b"\r\n\r\n" in text or inflater.eof or len(text) >= 5 and text[:5] != b"WARC/":
                break
    except zlib.error:
        pass
    return text[:5] == b"WARC/" and b"warc-type:" in text.lower()


def inflate(window: Window, at: int) -> tuple[bytes, int]:
    """The whole content of the member at a place, and the place after it. Its checksum is verified by zlib."""
    inflater, parts, used = zlib.decompressobj(31), [], at - window.base
    while not inflater.eof:
        if used >= len(window.data) and not window.more():
            raise ValueError(f"member at {at} ends early")
        piece = bytes(window.data[used : used + CHUNK])
        parts.append(inflater.decompress(piece))
        used += len(piece) - len(inflater.unused_data)
    return b"".join(parts), window.base + used


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, content, None) of the members that start in [start, end), and (place, None, error) of damaged ones.

    A member whose header inflates but not its whole content is an error at its place, and so are bytes that
    follow a member, or begin the file, without being one.
    """
    window, at, chained = Window(file, start), start, start == 0
    while at < end:
        if chained and not window.data and not window.more():
            return
        if not chained or window.data[at - window.base : at - window.base + 3] != MAGIC or not is_member(window, at):
            gap = at if chained else None
            at += chained
            chained = False
            while True:  # the next magic that is a record's
                place = window.data.find(MAGIC, at - window.base)
                if place >= 0:
                    at = window.base + place
                    if at >= end or is_member(window, at):
                        break
                    at += 1
                    continue
                at = max(at, window.base + len(window.data) - 2)
                window.forget(at)
                if at >= end or not window.more():
                    at = max(at, end)
                    break
            if gap is not None:
                yield gap, None, "bytes that are no record"
            if at >= end:
                return
        try:
            content, after = inflate(window, at)
        except (zlib.error, ValueError) as e:  # a damaged member: look for the next
            yield at, None, str(e)[:200]
            window.forget(at + 1)
            at, chained = at + 1, False
            continue
        yield at, content, None
        window.forget(after)
        while len(window.data) < 3 and window.more():
            pass
        at, chained = after, True
        if not window.data:
            return


def parse(content: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """(fields by lower-case name, body, what is wrong) of a record. Of a repeated field the last counts; lines without a colon are passed over."""
    head, end, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {name.strip().lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines) if colon}
    length = fields.get("content-length", "0")
    if not (length.isascii() and length.isdigit()) or len(length) > 18:
        return fields, b"", "the content length is no number"
    if not end or int(length) > len(rest):
        return fields, b"", "the record is shorter than its content length"
    return fields, rest[: int(length)], None


RECORD = "path string, place long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary, error string"


def _number(value: str | None) -> int | None:
    """The number in a field, if it is one that a long holds."""
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def read(spark: SparkSession, manifest: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives in a manifest (path, bytes), read by ranges of ``range_bytes``.

    A response's digest and size are those of the payload as read; a revisit's are its header's, and its
    payload is null. A damaged record, or bytes that are none, give a row with path, place and error alone; see
    complete() for records of which nothing is left. Very long records are read whole. An empty manifest gives no rows.
    """
    starts = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = [f.split()[0] for f in RECORD.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def row(path: str, place: int, content: bytes | None, error: str | None) -> tuple:
            if error:
                return (path, place, *[None] * 7, error)
            h, body, wrong = parse(content)
            if wrong:
                return (path, place, *[None] * 7, wrong)
            kind = h.get("warc-type")
            if kind == "revisit":
                return (path, place, kind, _number(h.get("x-page-id")), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), _number(h.get("x-payload-bytes")), _number(h.get("x-refers-to-page")), None, None)
            sha = digest(body)
            if h.get("warc-payload-digest") not in (None, f"sha1:{sha}"):
                return (path, place, *[None] * 7, "the payload is not that of the digest")
            return (path, place, kind, _number(h.get("x-page-id")), h.get("warc-target-uri"), sha, len(body), None, body, None)

        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, inner = open_fs(path)
                out, held = [], 0
                with fs.open_input_file(inner) as f:
                    for place, content, error in members(f, start, start + range_bytes):
                        out.append(row(path, place, content, error))
                        held += len(content or b"")
                        if held > 4 << 20:
                            yield made(out)
                            out, held = [], 0
                if out:
                    yield made(out)

    return ranges.mapInArrow(run, RECORD)


def complete(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, records, found, errors of the archives that are not read whole: records missing, too many or damaged."""
    got = records.groupBy("path").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("found"), F.count("error").alias("errors"))
    both = manifest.select("path", "records").join(got, "path", "left").na.fill(0, ["found", "errors"])
    return both.where("records <> found or errors > 0")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: a row per page without its payload.

    The records are counted against the manifest; where one is damaged or missing the job fails instead of losing a row.
    """
    spark = pages.sparkSession
    manifest = write(pages, scratch_path(spark, "warc"), least_bytes)
    records = stored(read(spark, manifest).drop("payload"), "warc-records")
    broken = complete(records, manifest).limit(5).collect()
    if broken:
        raise ValueError(f"archives that were not read whole: {broken}")
    return records.drop("error")
