"""Op 5: TIFF images in a binary column.

The reader walks the chain of image directories, decodes strips or tiles (no compression, PackBits,
LZW, deflate), undoes horizontal prediction, and emits a row for each page with its samples. The
writer makes multi-page grey images with the same codings, one page held at a time; which coding, strips
or tiles, and prediction a page of the query gets is decided by its own bytes, so all of them occur.

Defined cases: a null or empty image has no pages; a damaged one gives one row with page -1 and an
error after the pages before the damage; directories that repeat (a loop) end the walk with an error, and
so do other predictors and pages above `LARGEST` bytes of samples (a parameter; decoding never makes more
than a page's own size); very long texts become images of many pages; repeated rows are read each, equal
ones alike; there are no ties; other columns pass through in a struct, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, slices

#: Fixed values of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_A_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Samples in a row of the images made of texts, and rows of a page.
ROW, PAGE_ROWS = 64, 4096
#: Bytes of samples that a page may have.
LARGEST = 1 << 30
RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def unpack_bits(data: bytes, most: int) -> bytes:
    """At most so many bytes; each header byte tells of bytes as they are or of one that repeats."""
    out, at, made = [], 0, 0
    while at < len(data) and made < most:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
            made += n + 1
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
            made += 257 - n
        else:
            at += 1
    return b"".join(out)[:most]


def pack_bits(data: bytes) -> bytes:
    """Bytes that repeat three times or more become runs, those between them go as they are."""
    out, at = [], 0

    def plain(end):
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(bytes([len(part) - 1]) + part)

    for run in RUNS.finditer(data):
        plain(run.start())
        at = run.end()
        out.append(bytes([257 - at + run.start(), data[at - 1]]))
    plain(len(data))
    return b"".join(out)


def unlzw(data: bytes, most: int) -> bytes:
    """At most so many bytes. Codes of 9 to 12 bits, most significant first, that widen one code early; 256 clears, 257 ends."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, bits, held, last, out, made = list(start), 9, 0, 0, None, [], 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & (1 << held) - 1
        if code == 257 or made >= most:
            break
        if code == 256:
            table, width, last = list(start), 9, None
            continue
        if last is None:
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code == len(table):
            word = last + last[:1]
            table.append(word)
        else:
            raise ValueError("LZW code out of range")
        out.append(word)
        made += len(word)
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:most]


SINGLES = {bytes([i]): i for i in range(256)}


def lzw(data: bytes) -> bytes:
    """Words grow byte by byte while the table has them; the table starts anew when it is full."""
    codes, widths = [256], [9]
    at, n = 0, len(data)
    table, width, free = dict(SINGLES), 9, 258
    while at < n:
        end = at + 1
        word = code = None
        while end <= n:
            more = data[at:end]
            known = table.get(more)
            if known is None:
                break
            word, code, end = more, known, end + 1
        codes.append(code)
        widths.append(width)
        at += len(word)
        if at < n:
            table[more] = free
        free += 1
        if free == 4094 and at < n:
            codes.append(256)
            widths.append(12)
            table, width, free = dict(SINGLES), 9, 258
        elif free >= 1 << width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    # Codes to bits, all at once: bit j of a code of w bits stands w-1-j places after its start.
    code, wide = np.array(codes, np.int64), np.array(widths, np.int64)
    ends = np.cumsum(wide)
    shift = np.repeat(ends, wide) - np.arange(int(ends[-1])) - 1
    return np.packbits((np.repeat(code, wide) >> shift & 1).astype(np.uint8)).tobytes()


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


CODERS = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}
DECODERS = {NONE: lambda x, most: x[:most], PACKBITS: unpack_bits, LZW: unlzw, DEFLATE: inflate, OLD_DEFLATE: inflate}


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """Whole-number fields of the directory at `at`, and where the next one is."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = FIELD_SIZE.get(kind, 0) * count
        where = at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if kind in (1, 3, 4):
            fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def page_samples(data: bytes, f: dict[int, list[int]], order: str) -> np.ndarray:
    """The samples of a page: rows x columns x samples of a pixel."""
    width, height, each = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, [1])[0]
    depth = set(f.get(BITS, [8])) & {8, 16}
    if len(set(f.get(BITS, [8]))) != 1 or not depth:
        raise ValueError("only samples of 8 or 16 bits")
    kind = np.dtype("u1") if depth == {8} else np.dtype(order + "u2")
    planes = each if f.get(PLANAR, [1])[0] == 2 else 1
    wide = each // planes
    tiled = TILE_OFFSETS in f
    across, down = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(f.get(ROWS_A_STRIP, [height])[0], height))
    offsets, lengths = (f[TILE_OFFSETS], f[TILE_BYTES]) if tiled else (f[STRIP_OFFSETS], f[STRIP_BYTES])
    coding, predictor = f.get(COMPRESSION, [1])[0], f.get(PREDICTOR, [1])[0]
    if coding not in DECODERS:
        raise ValueError(f"no decoder of compression {coding}")
    if predictor not in (1, 2):
        raise ValueError(f"no predictor {predictor}")
    if not (width and height and across and down and wide) or max(height * width, across * down) * each * kind.itemsize > LARGEST:
        raise ValueError("a page of no samples or too many")
    decode = DECODERS[coding]
    out = np.zeros((height, width, each), kind)
    columns, rows = -(-width // across), -(-height // down)
    for i, (offset, length) in enumerate(zip(offsets, lengths, strict=True)):
        plane, i = divmod(i, columns * rows)
        y, x = i // columns * down, i % columns * across
        tall = down if tiled else min(down, height - y)
        raw = np.frombuffer(decode(data[offset : offset + length], tall * across * wide * kind.itemsize), kind, tall * across * wide).reshape(tall, across, wide)
        if predictor == 2:
            raw = np.cumsum(raw, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        fit = raw[: height - y, : width - x]
        out[y : y + tall, x : x + across, plane * wide : plane * wide + wide] = fit
    return out


def pages(data: bytes) -> Iterator[tuple[dict[int, list[int]], np.ndarray]]:
    """Fields and samples of each page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        fields, at = directory(data, at, order)
        yield fields, page_samples(data, fields, order)


def write_page(out: bytearray, samples: np.ndarray, compression: int, predictor: int, tile: tuple[int, int] | None, strip_rows: int, link: int) -> int:
    """Appends a grey page and its directory, sets the link to it, and returns where its own link is."""
    height, width = samples.shape
    down, across = tile or (strip_rows, width)
    offsets, lengths = [], []
    for y in range(0, height, down):
        for x in range(0, width, across):
            part = samples[y : y + down, x : x + across]
            if tile:
                part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype))
            code = CODERS[compression](part.tobytes())
            offsets.append(len(out))
            lengths.append(len(code))
            out += code
    out += b"\0" * (len(out) % 2)

    def longs(values):
        if len(values) == 1:
            return values[0]
        at = len(out)
        out.extend(struct.pack(f"<{len(values)}I", *values))
        return at

    where = [(TILE_WIDTH, 4, 1, across), (TILE_HEIGHT, 4, 1, down), (TILE_OFFSETS, 4, len(offsets), longs(offsets)), (TILE_BYTES, 4, len(lengths), longs(lengths))] if tile else [(STRIP_OFFSETS, 4, len(offsets), longs(offsets)), (ROWS_A_STRIP, 4, 1, down), (STRIP_BYTES, 4, len(lengths), longs(lengths))]
    fields = sorted([(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor), *where])
    struct.pack_into("<I", out, link, len(out))
    out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + b"\0\0\0\0"
    return len(out) - 4


def payload_of(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of 64."""
    return text + b"\0" * ((-len(text)) % ROW or (ROW if not text else 0))


def image_of(payload: bytes) -> bytes:
    """payload as a grey image of 64 columns. A page's CRC-32 picks PackBits, LZW or deflate, strips or tiles, and prediction."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for at in range(0, len(samples), PAGE_ROWS):
        page = samples[at : at + PAGE_ROWS]
        pick = zlib.crc32(page)
        link = write_page(out, page, (PACKBITS, LZW, DEFLATE, DEFLATE)[pick % 4], 1 + pick // 4 % 2, (64, 64) if pick // 8 % 2 else None, 1024, link)
    return bytes(out)


def with_images_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches, 64):
        texts = as_bytes(batch.column("__text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(list(map(len, texts)), pa.int64()), pa.array([image_of(payload_of(t)) for t in texts], pa.binary())], names=["doc", "n_bytes", "media"])


def with_images(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as a struct `doc`, with n_bytes of the text and the image `media` of it."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).alias("_")]
    packed = docs.select(F.struct(*rest).alias("doc"), F.col(text).alias("__text"))
    return packed.mapInArrow(with_images_batches, T.StructType([packed.schema["doc"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


PAGE = [("media_bytes", "long"), ("media_sha256", "string"), ("page", "int"), ("last", "boolean"), ("width", "int"), ("height", "int"), ("samples_a_pixel", "int"), ("compression", "int"), ("samples", "binary"), ("error", "string")]


#: Bytes of samples after which rows leave a task.
FLUSH = 4 << 20


def page_rows(data: bytes) -> Iterator[tuple]:
    """The values of PAGE for each page of an image."""
    import hashlib

    told, held = (len(data), hashlib.sha256(data).hexdigest()), None
    try:
        for i, (f, x) in enumerate(pages(data) if data else ()):
            if held:
                yield (*told, *held)
            held = [i, False, x.shape[1], x.shape[0], x.shape[2], f.get(COMPRESSION, [1])[0], x.astype(x.dtype.newbyteorder("<")).tobytes(), None]
    except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
        if held:
            yield (*told, *held)
        held = [-1, False, None, None, None, None, None, f"{type(e).__name__}: {e}"]
    if held:
        held[1] = True
        yield (*told, *held)


def read_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    for batch in slices(batches, 64):
        names = [n for n in batch.schema.names if n != "media"]
        of, rows, held = [], [], 0

        def table(of, rows, batch=batch, names=names):
            carried = [batch.column(n).take(pa.array(of)) for n in names]
            return pa.RecordBatch.from_arrays([*carried, *(pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), PAGE, strict=True))], names=[*names, *(n for n, _ in PAGE)])

        for i in range(batch.num_rows):
            for row in page_rows(batch.column("media")[i].as_py() or b""):
                of.append(i)
                rows.append(row)
                held += len(row[8] or b"")
                if held > FLUSH:
                    yield table(of, rows)
                    of, rows, held = [], [], 0
        if rows:
            yield table(of, rows)


def read_pages(images: DataFrame) -> DataFrame:
    """A row for each page of column `media` of images, in order; other columns pass through."""
    rest = [f for f in images.schema.fields if f.name != "media"]
    added = [T.StructField(n, T._parse_datatype_string(k)) for n, k in PAGE]
    return images.mapInArrow(read_batches, T.StructType([*rest, *added]))


def document_batches(batches: Iterator) -> Iterator:
    """Consecutive pages of an image to one row: digests and features of its samples. Of an image it holds sums and 64 bytes, not pages."""
    import hashlib

    import pyarrow as pa

    fresh = lambda: (hashlib.sha256(), b"", 0, np.zeros(256, np.int64), [], None)
    sha, tail, size, count, codings, fault = fresh()
    levels = np.arange(256)
    for batch in slices(batches, 64):
        of, rows = [], []
        for i, (data, last, coding, error) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("samples", "last", "compression", "error")), strict=True)):
            data = data or b""
            sha.update(data)
            tail, size = (tail + data[-64:])[-64:], size + len(data)
            count += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            codings, fault = [*codings, coding] if error is None else codings, fault or error
            if last:
                p = count[count > 0] / max(1, size)
                mean = float(count @ levels) / max(1, size)
                spread = float(np.sqrt(max(0.0, float(count @ levels**2) / max(1, size) - mean**2)))
                told = f"pages={len(codings)};codings={'+'.join(str(c) for c in sorted(set(codings)))};rows={size // ROW};mean={mean:.4f};sd={spread:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};levels={len(p)}"
                rows.append((size, sha.hexdigest(), zlib.crc32(tail), told if fault is None else f"error={fault};{told}"))
                of.append(i)
                sha, tail, size, count, codings, fault = fresh()
        if rows:
            carried = [batch.column(x).take(pa.array(of)) for x in ("doc", "n_bytes", "media_bytes", "media_sha256")]
            yield pa.RecordBatch.from_arrays([*carried, *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True))], names=["doc", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def by_document(rows: DataFrame) -> DataFrame:
    kind = T.StructType([rows.schema["doc"], *(T.StructField(n, T._parse_datatype_string(k)) for n, k in [("n_bytes", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("feature", "string")])])
    return rows.select("doc", "n_bytes", "media_bytes", "media_sha256", "last", "compression", "error", "samples").mapInArrow(document_batches, kind)


def op5_tiff(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = by_document(read_pages(with_images(docs)))
    return out.select("doc.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
