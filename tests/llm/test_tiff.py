import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from lattica.llm import tiff

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(some.binary(max_size=2000))
def test_codings_round_trip(data):
    for most in (len(data), len(data) // 2):
        assert tiff.unpack_bits(tiff.pack_bits(data), most) == data[:most]
        assert tiff.unlzw(tiff.lzw(data), most) == data[:most]
        assert most == 0 or tiff.inflate(zlib.compress(data), most) == data[:most]


def test_long_lzw_widens_and_clears():
    data = np.random.default_rng(0).integers(0, 256, 60000, dtype=np.uint8).tobytes() + b"ab" * 9000
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_published_lzw_and_packbits_examples():
    assert tiff.unlzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80]), 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert tiff.unpack_bits(packed, 99) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")


@pytest.mark.parametrize("coding", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_round_trip(coding, predictor, tile):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 9, shape, dtype=np.uint8) for shape in ((1, 1), (37, 50), (16, 32))]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for x in images:
        link = tiff.write_page(out, x, coding, predictor, tile, 8, link)
    got = [x[:, :, 0] for _, x in tiff.pages(bytes(out))]
    assert len(got) == 3 and all(np.array_equal(a, b) for a, b in zip(got, images, strict=True))


def test_big_endian_16_bit_planes():
    x = np.arange(24, dtype=">u2").reshape(2, 3, 4) * 999
    planes = [x[:, :, i] for i in range(4)]
    coded = [zlib.compress(np.diff(p, axis=1, prepend=np.zeros((2, 1), ">u2")).astype(">u2").tobytes()) for p in planes]
    body = bytearray(b"MM\0*\0\0\0\0")
    offsets = []
    for c in coded:
        offsets.append(len(body))
        body += c
    places = {}
    for name, fmt, values in (("o", "I", offsets), ("n", "I", [len(c) for c in coded]), ("b", "H", [16] * 4)):
        places[name] = len(body)
        body += struct.pack(f">4{fmt}", *values)
    struct.pack_into(">I", body, 4, len(body))
    fields = [(256, 4, 1, 3), (257, 4, 1, 2), (258, 3, 4, places["b"]), (259, 3, 1, 8 << 16), (273, 4, 4, places["o"]), (277, 3, 1, 4 << 16), (278, 4, 1, 2), (279, 4, 4, places["n"]), (284, 3, 1, 2 << 16), (317, 3, 1, 2 << 16)]
    body += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + b"\0\0\0\0"
    ((_, got),) = tiff.pages(bytes(body))
    np.testing.assert_array_equal(got, x)


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in tiff.op5_tiff(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(texts)
    codings = set()
    for t in texts:
        b = (t.text or "").encode()
        p, r = b + b"\0" * ((-len(b)) % 64 or (0 if b else 64)), got[t.doc_id]
        image = tiff.image_of(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        codings.update(r.feature.split("codings=")[1].split(";")[0].split("+"))
        assert not r.feature.startswith("error")
        assert f"mean={np.frombuffer(p, np.uint8).mean():.4f};" in r.feature


    assert codings == {str(tiff.PACKBITS), str(tiff.LZW), str(tiff.DEFLATE)}


def field(data, tag, value, kind=None):
    """An image of one page with another value of a field."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    for i in range(struct.unpack_from("<H", out, at)[0]):
        if struct.unpack_from("<H", out, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<I", out, at + 10 + 12 * i, value)
    return bytes(out)


def test_hostile_images_are_errors():
    out, bomb = bytearray(b"II*\0\0\0\0\0"), bytearray(b"II*\0\0\0\0\0")
    tiff.write_page(out, np.zeros((8, 64), np.uint8), tiff.DEFLATE, 1, None, 8, 4)
    good = bytes(out)
    assert [r[2] for r in tiff.page_rows(good)] == [0]
    for tag, value in ((tiff.WIDTH, 2**31), (tiff.HEIGHT, 2**31), (tiff.HEIGHT, 0), (tiff.PREDICTOR, 3), (tiff.COMPRESSION, 7), (tiff.ROWS_A_STRIP, 0), (tiff.BITS, 1), (tiff.STRIP_BYTES, 3)):
        ((*_, page, last, _, _, _, _, samples, error),) = tiff.page_rows(field(good, tag, value))
        assert (page, last, samples) == (-1, True, None) and error, tag
    tiff.write_page(bomb, np.zeros((4096, 4096), np.uint8), tiff.DEFLATE, 1, None, 4096, 4)
    small = field(field(bytes(bomb), tiff.WIDTH, 8), tiff.HEIGHT, 8)
    ((*_, samples, error),) = tiff.page_rows(small)
    assert error is None and samples == bytes(64)  # what is beyond the page's own size is not decoded


def test_faults_show_in_features(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    hurt = tiff.with_images(docs).withColumn("media", F.concat(F.substring("media", 1, 8), F.lit(b"\xff" * 60)))
    (row,) = tiff.by_document(tiff.read_pages(hurt)).collect()
    assert row.feature.startswith("error=")


def test_rows_for_pages(spark):
    two = tiff.image_of(tiff.payload_of(b"z" * 64 * 5000))
    loop = bytearray(tiff.image_of(tiff.payload_of(b"a")))
    struct.pack_into("<I", loop, len(loop) - 4, struct.unpack_from("<I", loop, 4)[0])
    rows = [("two", two), ("two", two), ("null", None), ("empty", b""), ("bad", b"II*\0\xff\xff\0\0"), ("loop", bytes(loop)), ("text", b"hello")]
    images = spark.createDataFrame(rows, "page string, media binary").withColumnRenamed("page", "key")
    got = [(r.key, r.page, r.last, r.height, r.error is None) for r in tiff.read_pages(images).collect()]
    assert got.count(("two", 0, False, 4096, True)) == 2 and got.count(("two", 1, True, 904, True)) == 2
    assert ("loop", 0, False, 1, True) in got and ("loop", -1, True, None, False) in got
    assert {g[0] for g in got} == {"two", "bad", "loop", "text"} and len(got) == 8
    assert tiff.read_pages(images.limit(0)).count() == 0


def test_null_and_repeated_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "x" * 400000, "c")], "doc_id long, text string, media string")
    got = tiff.by_document(tiff.read_pages(tiff.with_images(docs))).collect()
    assert len(got) == 4 and len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == 2
    assert {r.doc.media for r in got} == {"a", "b", "c"}
