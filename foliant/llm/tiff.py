"""Media columns: TIFF files as rows of pages.

``store_tiff`` writes byte payloads as multi-page 8-bit TIFF; ``tiff_pages`` walks
the image directories of a binary column, decodes strips or tiles (none, PackBits,
LZW, deflate), undoes the horizontal predictor and gives one row per page, page by
page; ``file_digests`` folds the pages of each file, as they come, into one row.

Defined cases: null media gives no pages and no error; bytes that are no TIFF, a
broken strip, a page beyond what its strips or a row (2**31 - 1 bytes) can hold, or an
unsupported layout give a row with ``error`` behind the pages before it; a directory
chain that loops ends at the first directory seen twice. Repeated rows are decoded
each on its own. Other columns pass unchanged, but for those that have the name of a
column added, which are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean

#: Rows and bytes of a batch of pages.
OUT_ROWS, OUT_BYTES = 500, 8 << 20
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773

# Tag numbers of TIFF 6.0.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
#: struct codes of field types 1-13 and 16-18 (BigTIFF).
FIELD_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class TiffError(ValueError):
    pass


# ---------------------------------------------------------------- compression

def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more become repeat packets, the rest literal packets."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edge))
    lengths = np.diff(np.concatenate((starts, [len(a)])))
    out, pending = bytearray(), 0

    def literal(lo: int, hi: int) -> None:
        for k in range(lo, hi, 128):
            n = min(128, hi - k)
            out.append(n - 1)
            out.extend(data[k : k + n])

    for k in np.flatnonzero(lengths >= 3):
        at, n = int(starts[k]), int(lengths[k])
        literal(pending, at)
        pending = at + n
        while n > 1:
            m = min(128, n)
            out += bytes((257 - m, data[at]))
            n -= m
        pending -= n
    literal(pending, len(data))
    return bytes(out)


def packbits_decode(data: bytes, most: int) -> bytes:
    """At least ``most`` bytes of what data decodes to, or all of it."""
    out, have, i, end = [], 0, 0, len(data)
    while i < end and have < most:
        n = data[i]
        i += 1
        if n < 128:
            out.append(data[i : i + n + 1])
            have += n + 1
            i += n + 1
        elif n > 128:
            if i >= end:
                raise TiffError("PackBits data ends within a run")
            out.append(data[i : i + 1] * (257 - n))
            have += 257 - n
            i += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    codes, widths = [256], [9]
    table: dict[int, int] = {}
    fill, width, last = 258, 9, -1
    for byte in data:
        if last < 0:
            last = byte
            continue
        pair = last << 8 | byte
        known = table.get(pair)
        if known is not None:
            last = known
            continue
        codes.append(last)
        widths.append(width)
        table[pair] = fill
        fill += 1
        if fill == 4095:
            codes.append(256)
            widths.append(width)
            table = {}
            fill, width = 258, 9
        elif fill > (1 << width) - 1:
            width += 1
        last = byte
    if last >= 0:
        codes.append(last)
        widths.append(width)
        fill += 1
        if fill > (1 << width) - 1 and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    c, w = np.array(codes), np.array(widths)
    end = np.cumsum(w)
    bits = np.zeros(-(-int(end[-1]) // 8) * 8, np.uint8)
    for k in range(12):  # bit k from the low end of each code
        some = w > k
        bits[end[some] - 1 - k] = c[some] >> k & 1
    return np.packbits(bits).tobytes()


def lzw_decode(data: bytes, most: int) -> bytes:
    """At least ``most`` bytes of what data decodes to, or all of it."""
    out: list[bytes] = []
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, width, acc, held, before, have = list(base), 9, 0, 0, b"", 0
    for byte in data:
        acc = (acc << 8) | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257 or have >= most:
            break
        if code == 256:
            table, width, before = list(base), 9, b""
            continue
        size = len(table)
        if not before:
            if code > 255:
                raise TiffError("LZW data starts with a code that is not defined")
            before = table[code]
            out.append(before)
            have += 1
            continue
        if code < size:
            now = table[code]
        elif code == size:
            now = before + before[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(now)
        have += len(now)
        if size < 4096:
            table.append(before + now[:1])
            size += 1
            if size >= 2047:
                width = 12
            elif size >= 1023:
                width = 11
            elif size >= 511:
                width = 10
        before = now
    return b"".join(out)


def compress(data: bytes, how: int, level: int = 6) -> bytes:
    if how == NONE:
        return data
    if how in (DEFLATE, DEFLATE_OLD):
        return zlib.compress(data, level)
    if how == PACKBITS:
        return packbits_encode(data)
    if how == LZW:
        return lzw_encode(data)
    raise TiffError(f"compression {how} is not supported")


#: Bytes that one byte of data can stand for, at most.
EXPANSION = {NONE: 1, PACKBITS: 64, DEFLATE: 1100, DEFLATE_OLD: 1100, LZW: 4096}


def expand(data: bytes, how: int, need: int) -> bytes:
    """At least the first ``need`` bytes, if there are as many; hardly more is ever made."""
    if how == NONE:
        return data
    if how in (DEFLATE, DEFLATE_OLD):
        try:
            return zlib.decompressobj().decompress(data, need)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    if how == PACKBITS:
        return packbits_decode(data, need)
    if how == LZW:
        return lzw_decode(data, need)
    raise TiffError(f"compression {how} is not supported")


# -------------------------------------------------------------------- writing

def encode_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, level: int = 6, order: str = "<") -> bytes:
    """Pages of shape (height, width, samples), uint8 or uint16, as a TIFF file.
    With tile (height, width) the page is cut into padded tiles instead of strips."""
    parts = [b"II*\0\0\0\0\0" if order == "<" else b"MM\0*\0\0\0\0"]
    at, link = 8, 4
    links: list[tuple[int, int]] = []

    def add(b: bytes) -> int:
        nonlocal at
        if at % 2:
            parts.append(b"\0")
            at += 1
        where = at
        parts.append(b)
        at += len(b)
        return where

    for page in pages:
        height, width, samples = page.shape
        bits = page.dtype.itemsize * 8
        kind = page.dtype.newbyteorder(order)
        step = tile or (rows_per_strip, width)
        offsets, counts = [], []
        for y in range(0, height, step[0]):
            for x in range(0, width, step[1]):
                cut = page[y : y + step[0], x : x + step[1]]
                if tile and cut.shape[:2] != tile:
                    cut = np.pad(cut, ((0, tile[0] - cut.shape[0]), (0, tile[1] - cut.shape[1]), (0, 0)), mode="edge")
                if predictor == 2:
                    cut = np.concatenate((cut[:, :1], np.diff(cut, axis=1)), axis=1)
                b = compress(cut.astype(kind).tobytes(), compression, level)
                offsets.append(add(b))
                counts.append(len(b))
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        fields.sort()
        entries = [struct.pack(order + "H", len(fields))]
        for tag, kind_no, values in fields:
            b = struct.pack(f"{order}{len(values)}{FIELD_CODES[kind_no]}", *values)
            b = b.ljust(4, b"\0") if len(b) <= 4 else struct.pack(order + "I", add(b))
            entries.append(struct.pack(order + "HHI", tag, kind_no, len(values)) + b)
        here = add(b"".join(entries) + b"\0\0\0\0")
        links.append((link, here))
        link = at - 4
    out = bytearray(b"".join(parts))
    for where, to in links:
        struct.pack_into(order + "I", out, where, to)
    return bytes(out)


# -------------------------------------------------------------------- reading

def walk_directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory in the order of the chain, classic or BigTIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("not a TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 42:
        head, count, entry, word, size = 4, "H", "HHI", "I", 4
    elif magic == 43:
        head, count, entry, word, size = 8, "Q", "HHQ", "Q", 8
    else:
        raise TiffError("not a TIFF header")
    try:
        at, seen = struct.unpack_from(order + word, data, head)[0], set()
        while at and at not in seen:
            seen.add(at)
            n = struct.unpack_from(order + count, data, at)[0]
            p, tags = at + struct.calcsize(count), {"order": order}
            for _ in range(n):
                tag, kind, many = struct.unpack_from(order + entry, data, p)
                p += struct.calcsize(order + entry)
                if code := FIELD_CODES.get(kind):
                    long = many * struct.calcsize(order + code)
                    where = p if long <= size else struct.unpack_from(order + word, data, p)[0]
                    if where + long > len(data):
                        raise TiffError(f"the values of tag {tag} are out of bounds")
                    tags[tag] = struct.unpack_from(f"{order}{many * len(code)}{code[0]}", data, where)
                p += size
            yield tags
            at = struct.unpack_from(order + word, data, p)[0]
    except struct.error as e:
        raise TiffError(f"directory out of bounds: {e}") from e


#: Bytes of a page's samples, at most: those of a binary value of a row.
MOST_BYTES = (1 << 31) - 1


def _whole(tags: dict, tag: int, default: int | None = None, least: int = 1) -> int:
    """The first value of a tag, a whole number of ``least`` or more."""
    value = tags[tag][0] if tags.get(tag) else default
    if not isinstance(value, int) or value < least:
        raise TiffError(f"tag {tag} is missing or no whole number of {least} or more")
    return value


def decode_page(data: bytes, tags: dict) -> np.ndarray:
    """The samples of one directory, shape (height, width, samples)."""
    width, height, samples = _whole(tags, WIDTH), _whole(tags, LENGTH), _whole(tags, SAMPLES, 1)
    bits = set(tags.get(BITS, (1,)))
    if bits not in ({8}, {16}):
        raise TiffError(f"bits per sample {sorted(bits)} are not supported")
    kind = np.dtype("u1" if bits == {8} else tags["order"] + "u2")
    how, predictor, planar = _whole(tags, COMPRESSION, NONE), _whole(tags, PREDICTOR, 1), _whole(tags, PLANAR, 1)
    if predictor > 2:
        raise TiffError(f"predictor {predictor} is not supported")
    if how not in EXPANSION:
        raise TiffError(f"compression {how} is not supported")
    tiled = TILE_OFFSETS in tags
    if tiled:
        step = _whole(tags, TILE_LENGTH), _whole(tags, TILE_WIDTH)
        offsets, counts = tags[TILE_OFFSETS], tags.get(TILE_COUNTS, ())
    else:
        step = min(_whole(tags, ROWS_PER_STRIP, height), height), width
        offsets, counts = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    parts = planes * -(-height // step[0]) * -(-width // step[1])
    if parts > min(len(offsets), len(counts)):
        raise TiffError("strips or tiles are missing")
    if not all(isinstance(v, int) and v >= 0 for v in (*offsets[:parts], *counts[:parts])):
        raise TiffError("places of strips or tiles are no whole numbers")
    size, of_tile = height * width * samples * kind.itemsize, step[0] * step[1] * depth * kind.itemsize
    if max(size, of_tile) > MOST_BYTES or size > EXPANSION[how] * sum(min(n, len(data)) for n in counts[:parts]):
        raise TiffError(f"a page of {size} bytes is larger than its data or a row can be")
    out = np.empty((height, width, samples), kind.newbyteorder("="))
    where = ((c, y, x) for c in range(planes) for y in range(0, height, step[0]) for x in range(0, width, step[1]))
    for (c, y, x), at, n in zip(where, offsets, counts, strict=False):
        rows = step[0] if tiled else min(step[0], height - y)
        need = rows * step[1] * depth * kind.itemsize
        raw = expand(data[at : at + n], how, need)
        if len(raw) < need:
            raise TiffError(f"a strip or tile has {len(raw)} of {need} bytes")
        cut = np.frombuffer(raw[:need], kind).reshape(rows, step[1], depth)
        if predictor == 2:
            cut = np.cumsum(cut, axis=1, dtype=out.dtype)
        cut = cut[: height - y, : width - x]
        out[y : y + step[0], x : x + step[1], c : c + depth] = cut
    return out


def average_hash(page: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid are lighter than the page's mean."""
    rows = np.linspace(0, page.shape[0], 9).astype(int)
    cols = np.linspace(0, page.shape[1], 9).astype(int)
    total = np.zeros((page.shape[0] + 1, page.shape[1] + 1))
    total[1:, 1:] = page.sum(axis=2, dtype=np.float64).cumsum(0).cumsum(1)
    area = np.maximum(np.outer(np.diff(rows), np.diff(cols)), 1)
    cell = (total[rows[1:]][:, cols[1:]] - total[rows[:-1]][:, cols[1:]] - total[rows[1:]][:, cols[:-1]] + total[rows[:-1]][:, cols[:-1]]) / area
    return int("".join("01"[int(b)] for b in (cell > total[-1, -1] / (page.shape[0] * page.shape[1])).ravel()), 2)


# ------------------------------------------------------------------ operators

PAGE = "page_no int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, tiled boolean, sample_sum bigint, sample_squares bigint, grid_hash string, samples binary, error string"
PAGE_FIELDS = [f.split()[0] for f in PAGE.split(", ")]


def read_pages(data: bytes | None) -> Iterator[dict]:
    """The pages of one file, one after the other; a last one with ``error`` where the walk ended early."""
    n = 0
    try:
        for tags in walk_directories(data) if data is not None else ():
            page = decode_page(data, tags)
            wide = page.astype(np.int64)
            yield {
                "page_no": n, "width": page.shape[1], "height": page.shape[0], "samples_per_pixel": page.shape[2], "bits": page.dtype.itemsize * 8,
                "compression": tags.get(COMPRESSION, (NONE,))[0], "predictor": tags.get(PREDICTOR, (1,))[0], "tiled": TILE_OFFSETS in tags,
                "sample_sum": int(wide.sum()), "sample_squares": int((wide * wide).sum()), "grid_hash": f"{average_hash(page):016x}", "samples": page.tobytes(),
            }
            n += 1
    except TiffError as e:
        yield {"page_no": n, "error": str(e)}
    except Exception as e:  # noqa: BLE001 - whatever broken bytes do to the reader is this file's error
        yield {"page_no": n, "error": f"{type(e).__name__}: {e}"}


#: How a file is stored: compression, predictor, and tile (height, width) or None for strips.
Layout = tuple[int, int, tuple[int, int] | None]
PLAIN: tuple[Layout, ...] = ((DEFLATE, 2, None),)
EVERY: tuple[Layout, ...] = tuple((how, predictor, tile) for how in (NONE, PACKBITS, LZW, DEFLATE, DEFLATE_OLD) for predictor in (1, 2) for tile in (None, (16, 32)))


def store_tiff(df: DataFrame, payload: str, out: str = "media", width: int = 64, samples: int = 3, page_rows: int = 4096, layouts: tuple[Layout, ...] = PLAIN) -> DataFrame:
    """Replace the binary column ``payload`` by a TIFF of 8-bit samples in ``out``.

    A payload is padded with spaces to a positive multiple of one row (width *
    samples bytes) and cut into pages of at most page_rows rows. Null counts as
    empty. Equal payloads give equal files: a checksum of the bytes chooses among
    ``layouts``."""
    bound_batches(df.sparkSession)
    row = width * samples
    kept = [f for f in df.schema.fields if f.name not in (payload, out)]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for value in batch.column(batch.num_columns - 1):
                data = value.as_py() or b""
                data += b" " * (row - len(data) if len(data) < row else -len(data) % row)
                how, predictor, tile = layouts[zlib.crc32(data) % len(layouts)]
                image = np.frombuffer(data, np.uint8).reshape(-1, width, samples)
                files.append(encode_tiff([image[y : y + page_rows] for y in range(0, len(image), page_rows)], how, predictor, tile=tile))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(files, pa.binary())], names=schema.names)

    return df.select(*(f.name for f in kept), F.col(payload).alias("__payload")).mapInArrow(lean(encode), schema)


def tiff_pages(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row per page of each file, the pages of a file one behind the other: the columns
    ``keep`` (all but media if None), then those of the page, and error."""
    bound_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c != media and c not in PAGE_FIELDS]
    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string(PAGE).fields])
    arrow = pa.schema([("page_no", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("sample_sum", pa.int64()), ("sample_squares", pa.int64()), ("grid_hash", pa.string()), ("samples", pa.binary()), ("error", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, pages, held = [], [], 0

            def made() -> pa.RecordBatch:
                told = pa.RecordBatch.from_pylist(pages, schema=arrow)
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int32())) for c in batch.columns[:-1]), *told.columns], names=schema.names)  # noqa: B023

            for k, value in enumerate(batch.column(batch.num_columns - 1)):
                for page in read_pages(value.as_py()):
                    of.append(k)
                    pages.append(page)
                    held += len(page.get("samples") or b"")
                    if held >= OUT_BYTES or len(pages) >= OUT_ROWS:
                        yield made()
                        of, pages, held = [], [], 0
            if pages:
                yield made()

    return df.select(*keep, F.col(media).alias("__media")).mapInArrow(lean(decode), schema)


DIGESTS = "n_pages int, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string, error string"


def file_digests(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each file from the rows that tiff_pages gave, which have to be as they came:
    ``keep``, then the number of pages, the length and SHA-256 of the samples of all pages in
    their order, the CRC-32 of the last 16, a feature (pages, rows, sum and sum of squares of
    samples, grid hash of each page) and the error. A file in hand is a few numbers."""
    schema = T.StructType([*(pages.schema[c] for c in keep), *T._parse_datatype_string(DIGESTS).fields])
    arrow = pa.schema([("n_pages", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string()), ("error", pa.string())])
    columns = ("page_no", "height", "sample_sum", "sample_squares", "grid_hash", "samples", "error")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, first = None, None  # the file in hand, and its kept columns

        def closed() -> dict:
            hashes = ",".join(file["hashes"])
            return {"n_pages": len(file["hashes"]), "payload_bytes": file["size"], "payload_sha256": file["sha"].hexdigest(), "tail_crc32": zlib.crc32(file["tail"]), "feature": f"{len(file['hashes'])}:{file['rows']}:{file['sum']}:{file['squares']}:{hashes}", "error": file["error"]}

        def told(heads: list[pa.RecordBatch], rows: list[dict]) -> pa.RecordBatch:
            kept = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*kept.columns, *pa.RecordBatch.from_pylist(rows, schema=arrow).columns], names=schema.names)

        for batch in batches:
            head, done, heads = batch.select(keep), [], []
            for k, row in enumerate(zip(*(batch.column(c) for c in columns), strict=True)):
                page_no, height, total, squares, grid, samples, error = (v.as_py() for v in row)
                if page_no == 0:
                    if file is not None:
                        done.append(closed())
                        heads.append(first)
                    file, first = {"sha": hashlib.sha256(), "size": 0, "tail": b"", "rows": 0, "sum": 0, "squares": 0, "hashes": [], "error": None}, head.slice(k, 1)
                if error is not None:
                    file["error"] = error
                    continue
                file["sha"].update(samples)
                file["size"] += len(samples)
                file["tail"] = (file["tail"] + samples[-16:])[-16:]
                file["rows"] += height
                file["sum"] += total
                file["squares"] += squares
                file["hashes"].append(grid)
            if done:
                yield told(heads, done)
            if first is not None:  # a copy, so that the batch can go
                first = pa.RecordBatch.from_pylist(first.to_pylist(), schema=first.schema)
        if file is not None:
            yield told([first], [closed()])

    return pages.select(*keep, *columns).mapInArrow(lean(fold), schema)
