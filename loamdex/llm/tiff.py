"""TIFF media columns: a writer for text payloads and a reader that walks image directories.

The reader takes both byte orders, strips and tiles, planar or chunky 8-bit samples, no compression,
PackBits, LZW and deflate, undoes the horizontal predictor, and gives one row per page. A page that
cannot be read gives a row with its error instead of failing the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Fixed values of the TIFF 6.0 format: tag numbers, field type sizes and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 284, 317, 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257
#: How many bytes one byte of a part may stand for: LZW's longest entries are the most that any supported form gives.
MOST_EXPANDED = 4096
#: What a reader may raise on a damaged file; each is reported in an error row.
DAMAGE = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)

#: Rows of a page, and pixels (RGB) of a row, that text payloads are stored in.
PAGE_ROWS, ROW_PIXELS = 1024, 64
#: Bytes of decoded samples or payloads after which rows are handed on.
BATCH_BYTES = 8 << 20
ROW_BYTES = 3 * ROW_PIXELS


# --- compression ---------------------------------------------------------------------------------
#: Runs of equal bytes this long or longer are packed as runs.
LEAST_RUN = 3


def packbits(data: bytes) -> bytes:
    """Runs are found at once; what lies between them is copied 128 bytes at a time."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.nonzero(np.diff(raw))[0] + 1, [len(raw)]]) if len(raw) else np.zeros(1, np.int64)
    long = np.nonzero(np.diff(edges) >= LEAST_RUN)[0]
    out, done = bytearray(), 0

    def literal(start: int, end: int) -> None:
        for at in range(start, end, 128):
            part = data[at : min(end, at + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, end in zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True):
        literal(done, start)
        for at in range(start, end, 128):
            n = min(128, end - at)
            out.extend((257 - n & 255, data[at]) if n > 1 else (0, data[at]))
        done = end
    literal(done, len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while len(out) < size and at < n:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


#: Codes from a clear on are 9 bits wide up to this place, then 10, 11 and 12 (entries 511, 1023 and 2047 are made there).
WIDER = (254, 766, 1790)
#: The last code before a clear: the one that makes entry 4094.
SEGMENT = 3837


def widths(n: int) -> np.ndarray:
    """Bits of each of the n codes that follow a clear."""
    return 9 + np.searchsorted(WIDER, np.arange(n), side="right")


def lzw(data: bytes) -> bytes:
    """Most significant bit first. Codes are found byte by byte; their bits are laid out at once."""
    codes, sizes = [np.array([CLEAR])], [np.array([9])]
    table: dict[int, int] = {}
    held, size, own = -1, 258, []
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = held << 8 | byte
        code = table.get(key)
        if code is not None:
            held = code
            continue
        own.append(held)
        table[key] = size
        size += 1
        held = byte
        if size == 4095:
            codes += [np.array(own), np.array([CLEAR])]
            sizes += [widths(len(own)), np.array([12])]
            table, size, own = {}, 258, []
    if held >= 0:
        own.append(held)
    codes.append(np.array([*own, END]))
    sizes.append(widths(len(own) + 1))
    code, width = np.concatenate(codes).astype(np.uint16), np.concatenate(sizes)
    bits = np.unpackbits(code.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16)[None] >= 16 - width[:, None]]).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    """The codes up to the next clear are cut out at once, then looked up one by one."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    out, at, total = bytearray(), 0, 8 * len(data)
    while len(out) < size and at + 9 <= total:
        width = widths(min((total - at) // 9, 4096))
        start = at + np.cumsum(width) - width
        fits = start + width <= total
        start, width = start[fits], width[fits]
        place = start >> 3
        window = raw[place] << 24 | raw[place + 1] << 16 | raw[place + 2] << 8 | raw[place + 3]
        codes = window >> (32 - width - (start & 7)).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
        stops = np.nonzero((codes == CLEAR) | (codes == END))[0]
        n = int(stops[0]) if len(stops) else len(codes)
        table, held = base.copy(), b""
        for code in codes[:n].tolist():
            if not held:
                held = table[code]
            else:
                got = table[code] if code < len(table) else held + held[:1]
                table.append(held + got[:1])
                held = got
            out += held
        if not len(stops) or codes[n] == END:
            break
        at = int(start[n] + width[n])
    return bytes(out[:size])


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression} is not supported")


def squeeze(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 3)}[compression](data)


# --- writing -------------------------------------------------------------------------------------
def encode_page(samples: np.ndarray, compression: int, predictor: bool, tile: tuple[int, int] | None = None, strip_rows: int = 256) -> tuple[list[bytes], dict[int, list[int]]]:
    """The strips or (height, width) tiles of an (h, w, channels) page, and its directory without their offsets."""
    h, w, c = samples.shape
    tags = {WIDTH: [w], HEIGHT: [h], BITS: [8] * c, COMPRESSION: [compression], PHOTOMETRIC: [2 if c >= 3 else 1], SAMPLES: [c], PLANAR: [1], PREDICTOR: [2 if predictor else 1]}
    if tile:
        th, tw = tile
        full = np.zeros((-(-h // th) * th, -(-w // tw) * tw, c), np.uint8)
        full[:h, :w] = samples
        parts = [full[y : y + th, x : x + tw] for y in range(0, len(full), th) for x in range(0, full.shape[1], tw)]
        tags |= {TILE_WIDTH: [tw], TILE_HEIGHT: [th]}
    else:
        parts = [samples[y : y + strip_rows] for y in range(0, h, strip_rows)]
        tags |= {ROWS_PER_STRIP: [strip_rows]}
    if predictor:
        parts = [np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1) for p in parts]  # wraps modulo 256
    return [squeeze(p.tobytes(), compression) for p in parts], tags


def write_tiff(pages: list[tuple[list[bytes], dict[int, list[int]]]]) -> bytes:
    """A little-endian file of pages from encode_page()."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for parts, tags in pages:
        offsets = []
        for p in parts:
            offsets.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        tags = tags | {TILES if TILE_WIDTH in tags else STRIPS: offsets, TILE_BYTES if TILE_WIDTH in tags else STRIP_BYTES: [len(p) for p in parts]}
        entries = b""
        for tag, values in sorted(tags.items()):
            kind, form = (4, "I") if tag in (WIDTH, HEIGHT, STRIPS, STRIP_BYTES, TILES, TILE_BYTES, ROWS_PER_STRIP) else (3, "H")
            raw = struct.pack(f"<{len(values)}{form}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: The forms of text payloads; which one a payload takes is drawn by its checksum, whatever its size.
FORMS = [(kind, tile, predictor) for kind in (PACKBITS, LZW, DEFLATE) for tile in (None, (16, 32)) for predictor in (False, True)]


def text_tiff(payload: bytes) -> bytes:
    """A payload of whole rows as RGB pages of at most PAGE_ROWS rows, in the form its crc32 draws from FORMS."""
    kind, tile, predictor = FORMS[zlib.crc32(payload) % len(FORMS)]
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 3)
    return write_tiff([encode_page(rows[at : at + PAGE_ROWS], kind, predictor, tile) for at in range(0, len(rows), PAGE_ROWS)])


# --- reading -------------------------------------------------------------------------------------
def _values(data: bytes, order: str, kind: int, count: int, field: bytes) -> list[int]:
    size = TYPE_SIZE[kind] * count
    if size > len(data) + 4:
        raise ValueError(f"a field of {size} bytes")
    raw = field[:size] if size <= 4 else data[(at := struct.unpack(f"{order}I", field)[0]) : at + size]
    form = {1: "B", 3: "H", 4: "I"}.get(kind)
    return list(struct.unpack(f"{order}{count}{form}", raw)) if form else []


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The directories in file order; a loop of links ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(f"{order}I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(f"{order}H", data[at : at + 2])[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack(f"{order}HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            if kind in TYPE_SIZE:
                tags[tag] = _values(data, order, kind, count, data[at + 10 + 12 * i : at + 14 + 12 * i])
        yield tags
        at = struct.unpack(f"{order}I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def decode_page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """(h, w, channels) samples of one directory."""
    one = lambda tag, default: (tags.get(tag) or [default])[0]
    w, h, c = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    if any(b != 8 for b in tags.get(BITS) or [1]):
        raise ValueError("only 8-bit samples are supported")
    planes, per = (c, 1) if one(PLANAR, 1) == 2 else (1, c)
    tiled = TILES in tags
    pw, ph = (one(TILE_WIDTH, w), one(TILE_HEIGHT, h)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    if min(w, h, c, pw, ph) < 1:
        raise ValueError(f"a page of {w} x {h} x {c} in parts of {pw} x {ph}")
    across, down = -(-w // pw), -(-h // ph)
    parts = planes * across * down
    if min(len(offsets), len(sizes)) < parts:
        raise ValueError(f"{min(len(offsets), len(sizes))} of {parts} parts are listed")
    # nothing is allocated that the file's bytes could not fill
    if w * h * c > MOST_EXPANDED * min(sum(sizes[:parts]), parts * len(data)) or pw * ph * per > MOST_EXPANDED * max(sizes[:parts]):
        raise ValueError(f"a page of {w} x {h} x {c} cannot come from {sum(sizes[:parts])} bytes")
    out = np.zeros((h, w, c), np.uint8)
    for k in range(parts):
        plane, place = divmod(k, across * down)
        y, x = place // across * ph, place % across * pw
        rows = ph if tiled else min(ph, h - y)
        raw = unpack(data[offsets[k] : offsets[k] + sizes[k]], one(COMPRESSION, NONE), rows * pw * per)
        if len(raw) < rows * pw * per:
            raise ValueError(f"part {k} has {len(raw)} of {rows * pw * per} bytes")
        part = np.frombuffer(raw, np.uint8).reshape(rows, pw, per)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + pw, plane * per : plane * per + per] = part[: h - y, : w - x]
    return out


def decode(data: bytes | None) -> Iterator[tuple]:
    """(page, width, height, channels, samples, error) of each page; an unreadable file is one row with an error."""
    page = 0
    try:
        for tags in directories(data or b""):
            try:
                px = decode_page(data, tags)
                yield page, px.shape[1], px.shape[0], px.shape[2], px.tobytes(), None
            except DAMAGE as e:
                yield page, None, None, None, None, (str(e) or type(e).__name__)[:200]
            page += 1
    except DAMAGE as e:
        yield page, None, None, None, None, (str(e) or type(e).__name__)[:200]


# --- operators -----------------------------------------------------------------------------------
def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" ")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a TIFF file) of every row. Null text is empty; null ids and repeated rows stay.

    Very long texts become many pages of one file, whole. An empty table gives no rows.
    """

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for key, text in zip(b.column(0), b.column(1), strict=True):
                n, payload = padded(text.as_py())
                rows.append((key.as_py(), n, text_tiff(payload)))
                held += len(payload)
                if held > BATCH_BYTES or len(rows) == 1000:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


PAGE_FIELDS = "page int, width int, height int, channels int, samples binary, error string"


def pages(table: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of each row's TIFF: the row's other columns, then page (from 0), width, height, channels, samples, error.

    Pages of a row stand together, in order. A null or unreadable file gives one row with page 0 and an
    error. Columns of the table named like a page column are dropped in its favour.
    """
    own = [f.split()[0] for f in PAGE_FIELDS.split(", ")]
    keep = [c for c in table.columns if c != media_col and c not in own]
    fields = StructType([*(table.schema[c] for c in keep), *StructType.fromDDL(PAGE_FIELDS)])
    kinds = [pa.int32()] * 4 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            rows = pa.array([i for i, _ in found], pa.int64())
            columns = [b.column(j).take(rows) for j in range(len(keep))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([p[j] for _, p in found], kind) for j, kind in enumerate(kinds))], names=[*keep, *own])

        for b in batches:
            found, held = [], 0
            for i, media in enumerate(b.column(len(keep))):
                for p in decode(media.as_py()):
                    found.append((i, p))
                    held += len(p[4] or b"")
                    if held > BATCH_BYTES or len(found) == 1000:
                        yield made(b, found)
                        found, held = [], 0
            if found:
                yield made(b, found)

    return table.select(*keep, F.col(media_col).cast("binary").alias(media_col)).mapInArrow(run, fields)


def text_features(pages_of_texts: DataFrame) -> DataFrame:
    """Fold the page rows of to_media() + pages() into a row per text: what was stored, read back.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes) and feature: pages, samples, mean of
    each channel in 1/1000, mean absolute difference of neighbouring samples in 1/1000 and distinct sample
    values. Pages of a text stand together (pages() is narrow), a page 0 begins the next. Unreadable pages
    give null digests.
    """
    import hashlib

    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    names = [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    def fold(own: list, parts: list[bytes]) -> tuple:
        if not parts or any(p is None for p in parts):
            return (*own, None, None, None, None)
        data = b"".join(parts)
        px = np.frombuffer(data, np.uint8)
        means = [int(px[c::3].sum(dtype=np.int64)) * 1000 // len(px[c::3]) for c in range(3)]
        jumps = int(np.abs(np.diff(px.astype(np.int16))).sum(dtype=np.int64)) * 1000 // max(1, len(px) - 1)
        distinct = int((np.bincount(px, minlength=256) > 0).sum())
        feature = f"p{len(parts)}:n{len(px)}:m{'/'.join(map(str, means))}:g{jumps}:v{distinct}"
        return (*own, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        own, parts, out = None, [], []
        for b in batches:
            heads = [b.column(i).to_pylist() for i in range(5)]
            for i in range(b.num_rows):
                if heads[4][i] == 0 and own is not None:
                    out.append(fold(own, parts))
                    parts = []
                own = [h[i] for h in heads[:4]]
                parts.append(b.column(5)[i].as_py())
            if out:
                yield made(out)
                out = []
        if own is not None:
            yield made([fold(own, parts)])

    fields = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return pages_of_texts.select(*keep, "page", "samples").mapInArrow(run, fields)
