import random
import zlib
from base64 import b32encode
from hashlib import md5, sha1, sha256

import pytest

from lattica.llm import warc

SF = "/root/testdata/sf0.001"


def digest(b):
    return b32encode(sha1(b).digest()).decode()


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in warc.op4_salvage(spark, SF).collect()}
    assert len(got) == len(pages)
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault((p.html or "").encode(), p.page_id)
    for p in pages:
        b = (p.html or "").encode()
        r = got[p.page_id]
        again = first[b] != p.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), digest(b), "revisit" if again else "response", first[b] if again else None)


ROWS = [(5, "http://a b", "same"), (2, None, "same"), (9, "http://c", None), (8, "u", ""), (None, "n", "same"), (None, "m", "alone"), (7, "x", "long " * 30000), (2, "again", "same"), (7, "y", "other")]


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, compress):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumnRenamed("url", "url")
    got = warc.read_archives(warc.write_archives(warc.plan(pages), 1000, compress)).collect()
    assert len(got) == len(ROWS) and {r.kind for r in got} == {"record"}
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("<urn:page:5>", "revisit", "<urn:page:2>"), ("<urn:page:2>", "response", None), ("<urn:page:2>", "response", None), ("<urn:page:9>", "revisit", "<urn:page:8>"), ("<urn:page:8>", "response", None), ("<urn:page:>", "revisit", "<urn:page:2>"), ("<urn:page:>", "response", None), ("<urn:page:7>", "response", None), ("<urn:page:7>", "response", None)])
    assert all(r.payload_digest == digest(r.payload) for r in got if r.record_type == "response")
    least = warc.read_archives(warc.write_archives(warc.plan(pages, least=5)))
    assert least.filter("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(warc.plan(pages.limit(0)))).count() == 0


def records(n=6):
    return [warc.record(i, b"http://x/%d" % i, b, digest(b)) for i, b in ((i, f"page {i} ".encode() * (50 * i + 1)) for i in range(n))]


def covered(data):
    parts = list(warc.salvage(data))
    bounds = list(dict.fromkeys((p[1], p[2]) for p in parts))  # records of a member share its bounds
    assert [a for a, _ in bounds] == [0, *[b for _, b in bounds]][: len(bounds)] and (not parts or bounds[-1][1] == len(data))
    return [p[3]["id"] for p in parts if p[0] == "record"], [p for p in parts if p[0] == "gap"]


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_its_own_records_only(compress):
    own = [warc.member(r) if compress else r for r in records()]
    ids = [f"<urn:page:{i}>" for i in range(6)]
    assert covered(b"".join(own)) == (ids, [])
    rng = random.Random(4)
    for _ in range(60):
        hurt = rng.randrange(6)
        broken = bytearray(own[hurt])
        at = rng.randrange(len(broken))
        broken[at] ^= 1 << rng.randrange(8)
        got, gaps = covered(b"".join([*own[:hurt], bytes(broken), *own[hurt + 1 :]]))
        want = [x for i, x in enumerate(ids) if i != hurt]
        assert [x for x in got if x in want] == want  # a flipped bit in a header field may leave the record readable
        assert gaps or len(got) == 6
    got, gaps = covered(b"junk" + own[0] + b"\x00" * 50 + own[1] + own[2][: len(own[2]) // 2] + own[3] + own[4][:-9])
    assert got == [ids[0], ids[1], ids[3]] and len(gaps) == 4
    assert covered(b"") == ([], []) and covered(b"nothing here")[0] == []
    mixed = records()[0] + warc.member(records()[1]) + records()[2]
    assert covered(mixed) == (ids[:3], [])


def test_lengths_that_lie_do_not_swallow_later_records():
    a, b = records()[1:3]
    n = int(a.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    for lie in (n - 3, n + 40, 10**12):
        got, gaps = covered(a.replace(b"Content-Length: %d\r\n\r\n" % n, b"Content-Length: %d\r\n\r\n" % lie, 1) + b)
        assert got == ["<urn:page:2>"] and len(gaps) == 1


def test_members_of_several_records_and_other_digests():
    one, two, three = records()[1:4]
    body = b"x" * 300
    for told in ("sha256:" + sha256(body).hexdigest(), "sha-256:" + b32encode(sha256(body).digest()).decode(), "md5:" + md5(body).hexdigest(), "sha1:" + sha1(body).hexdigest(), "blake9:whatever"):
        four = warc.record(9, b"u", body, digest(body)).replace(b"sha1:" + digest(body).encode(), told.encode())
        assert covered(warc.member(one + two) + warc.member(four) + three) == (["<urn:page:1>", "<urn:page:2>", "<urn:page:9>", "<urn:page:3>"], [])
    wrong = warc.record(9, b"u", body, digest(body)).replace(b"sha1:" + digest(body).encode(), b"sha256:" + sha256(b"y").hexdigest().encode())
    assert covered(wrong + three)[0] == ["<urn:page:3>"]
    assert len(covered(one.replace(b"Content-Length: ", b"Content-Length: " + b"9" * 6000, 2) + three)[1]) == 1


def test_time_grows_with_the_file(monkeypatch):
    """Bytes given to the unpacker and looked through for ends of headers, for files of n and 4n records."""
    looked = []
    rng = random.Random(1)
    bodies = [rng.randbytes(5000) for _ in range(400)]
    every = [warc.member(warc.record(i, b"u", b, digest(b))) for i, b in enumerate(bodies)]
    plain = [warc.record(i, b"u", b, digest(b)) for i, b in enumerate(bodies)]
    broken = [r.replace(b"\r\n\r\n", b"\r\n..") for r in plain]  # version lines without any end of a header after them
    real = zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.own = real(bits)

        def decompress(self, data):
            looked.append(len(data))
            return self.own.decompress(data)

        def __getattr__(self, name):
            return getattr(self.own, name)

    class Text(bytes):
        def find(self, mark, at=0):
            got = bytes.find(self, mark, at)
            looked.append((got if got >= 0 else len(self)) - at)
            return got

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    for parts in (every, plain, broken):
        spent = []
        for n in (100, 400):
            looked.clear()
            found = [p for p in warc.salvage(Text(b"".join(parts[:n]))) if p[0] == "record"]
            assert len(found) == (0 if parts is broken else n)
            spent.append(sum(looked))
        assert spent[1] < 5 * spent[0]


def test_base32(spark):
    df = spark.createDataFrame([(bytes([i]) * i,) for i in range(20)], "b binary")
    assert all(r[1] == digest(bytes(r[0])) for r in df.select("b", warc.base32_sha1(df.b)).collect())
    assert zlib.decompress(warc.member(b"x"), 31) == b"x"
