"""Round trips, and streams that are broken on purpose."""

import hashlib
import random
import zlib

import pytest

from slipmill.llm import transport as ts


def test_round_trip():
    rng = random.Random(1)
    for n in [1, 5, 85, 86, 87, 95, 100, 400, ts.AU_BYTES, ts.AU_BYTES // 192 + 1, 1000]:
        payload = rng.randbytes(192 * n)
        media = ts.mux(payload)
        back, units, packets = ts.demux(media)
        assert back == payload and packets * 188 == len(media)
        assert [u[0] for u in units] == [k * ts.AU_TICKS for k in range(-(-len(payload) // ts.AU_BYTES))]
        assert [u[2] for u in units] == [k % ts.RAP_EVERY == 0 for k in range(len(units))]


def test_every_tail():
    for n in range(1, 600):
        assert ts.demux(ts.mux(b"\x47" * n))[0] == b"\x47" * n


def test_time_stamps():
    for pts in (0, 1, 32768, 1 << 22, (1 << 33) - 1):
        t = ts._stamp(pts)
        assert (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1 == pts and len(t) == 5


def test_crc():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7  # the check value of CRC-32/MPEG-2


def test_broken_streams():
    media = ts.mux(random.Random(2).randbytes(192 * 20))
    with pytest.raises(ts.Broken, match="counter"):
        ts.demux(media[: 188 * 4] + media[188 * 5 :])
    for bad in (b"", media[:-1], b"\0" + media[1:], media[188:], media[:20] + b"!" + media[21:]):
        with pytest.raises((ts.Broken, IndexError)):
            ts.demux(bad)


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "é" * 97), (4, "é" * 97), (5, "long " * 100_000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", ts.F.lit("clash"))
    got = ts.read(ts.store(df)).collect()
    for r in got:
        assert r["stream"]["payload"] == ts.padded(r["text"]) and r["stream"]["error"] is None
    broken = ts.read(spark.createDataFrame([(b"nothing",), (None,)], "media binary")).collect()
    assert all(r["stream"]["payload"] is None and r["stream"]["error"] for r in broken)


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in ts.op5_transport_stream(spark, sf).collect():
        data = docs[r["doc_id"]].encode()
        p = data.ljust(-(-max(1, len(data)) // 192) * 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r["media_sha256"], r["media_bytes"]) == (hashlib.sha256(ts.mux(p)).hexdigest(), len(ts.mux(p)))


# --- streams that mux() doesn't make, put together by hand ---


def packet(pid, counter, payload=b"", start=False, flags=None, control=None, scrambled=0):
    """One packet; what the payload doesn't fill is stuffing in the adaptation field."""
    room = 184 - len(payload)
    field = b""
    if flags is not None or room:
        body = bytes([flags or 0]) if room > 1 or flags is not None else b""
        field = bytes([room - 1]) + body.ljust(room - 1, b"\xff")
    control = control if control is not None else (0x10 if payload else 0) | (0x20 if field else 0)
    return bytes([0x47, 0x40 * start | pid >> 8, pid & 0xFF, scrambled << 6 | control | counter & 15]) + field + payload


def section(table, extension, body):
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + extension.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + ts.crc32_mpeg(head + body).to_bytes(4, "big")


def tables(*programs, descriptors=b""):
    """PAT, and a PMT for each (number, pid of the PMT, pids of its streams)."""
    pat = section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid, _ in programs))
    out = packet(0, 0, (b"\0" + pat).ljust(184, b"\xff"), start=True)
    for n, pid, streams in programs:
        body = (0xE000 | streams[0]).to_bytes(2, "big") + (0xF000 | len(descriptors)).to_bytes(2, "big") + descriptors
        body += b"".join(b"\x1b" + (0xE000 | x).to_bytes(2, "big") + b"\xf0\0" for x in streams)
        data, k = b"\0" + section(2, n, body), 0
        while data:
            out += packet(pid, k, data[:184].ljust(184, b"\xff"), start=k == 0)
            data, k = data[184:], k + 1
    return out


def pes(payload, pts=None, size=None, stream=0xE0):
    head = (b"\x80\x80\x05" + ts._stamp(pts)) if pts is not None else b"\x80\0\0"
    return b"\0\0\1" + bytes([stream]) + (len(head + payload) if size is None else size).to_bytes(2, "big") + head + payload


ONE = tables((1, 0x100, [0x50]))


def test_unbounded_packets():
    a, b = pes(b"a" * 300, 90, size=0), pes(b"b" * 100, 180, size=0)
    media = ONE + packet(0x50, 0, a[:184], start=True, control=0x10) + packet(0x50, 1, a[184:]) + packet(0x50, 2, b, start=True)
    payload, units, _ = ts.demux(media)
    assert payload == b"a" * 300 + b"b" * 100 and [u[0] for u in units] == [90, 180] and [u[3] for u in units] == [300, 100]


def test_legal_packets_without_news():
    a = pes(b"x" * 400, 5)
    first, second, third = packet(0x50, 7, a[:184], start=True), packet(0x50, 8, a[184:368]), packet(0x50, 9, a[368:])
    bare = packet(0x50, 8, flags=0x10)  # an adaptation field alone: the counter stands still
    null = packet(0x1FFF, 3, b"\xff" * 184)
    media = ONE + first + null + second + bare + second + null + third + third
    assert ts.demux(media)[0] == b"x" * 400
    with pytest.raises(ts.Broken, match="counter"):
        ts.demux(ONE + first + second + second + second + third)  # a packet may come twice, not three times
    with pytest.raises(ts.Broken, match="counter"):
        ts.demux(ONE + first + second[:-1] + b"y" + second + third)


def test_told_discontinuity():
    a, b = pes(b"x" * 50, 5), pes(b"y" * 50, 6)
    one, two = packet(0x50, 3, a, start=True), packet(0x50, 11, b, start=True)
    told = packet(0x50, 11, b, start=True, flags=0x80)
    assert ts.demux(ONE + one + told)[0] == b"x" * 50 + b"y" * 50
    assert ts.demux(ONE + one + packet(0x50, 3, flags=0x80) + two)[0] == b"x" * 50 + b"y" * 50
    with pytest.raises(ts.Broken, match="counter"):
        ts.demux(ONE + one + two)


def test_programs_and_long_tables():
    head = tables((4, 0x100, [0x50]), (2, 0x101, [0x60, 0x61]), descriptors=b"\x05\x28" + b"d" * 240)
    media = head + packet(0x50, 0, pes(b"four", 1), start=True) + packet(0x60, 5, pes(b"two"), start=True, flags=0x40) + packet(0x61, 5, pes(b"more"), start=True)
    assert ts.programs(ts.Packets(media)) == {4: [(0x50, 0x1B)], 2: [(0x60, 0x1B), (0x61, 0x1B)]}
    payload, units, n = ts.demux(media)
    assert payload == b"two" and units == [(None, n - 2, True, 3)]  # without a time stamp, at a random-access point
    assert ts.demux(media, program=4)[0] == b"four"
    with pytest.raises(ts.Broken, match="program"):
        ts.demux(media, program=9)


def test_streams_that_are_refused():
    a = pes(b"x" * 50, 5)
    with pytest.raises(ts.Broken, match="scrambled"):
        ts.demux(ONE + packet(0x50, 0, a, start=True, scrambled=2))
    damaged = bytearray(packet(0x50, 0, a, start=True))
    damaged[1] |= 0x80
    with pytest.raises(ts.Broken, match="damaged"):
        ts.demux(ONE + bytes(damaged))
    with pytest.raises(ts.Broken, match="short"):
        ts.demux(ONE + packet(0x50, 0, pes(b"x" * 50, 5, size=200), start=True))
    bare = b"\0\0\1\xbf" + (4).to_bytes(2, "big") + b"bare"
    assert ts.demux(ONE + packet(0x50, 0, bare, start=True))[:2] == (b"bare", [(None, 2, False, 4)])


def test_feature(spark, sf):
    """Level, crossings and centre of the spectrum, sample by sample in plain Python."""
    import cmath
    import math

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in ts.op5_transport_stream(spark, sf).collect()}
    for doc_id in sorted(docs, key=lambda d: len(docs[d] or ""))[:6]:
        p = list(ts.padded(docs[doc_id]))
        mean = sum(p) / len(p)
        level = math.sqrt(sum((x - mean) ** 2 for x in p) / len(p))
        crossings = sum((x >= mean) != (y >= mean) for x, y in zip(p, p[1:]))
        power = [sum(abs(sum(p[f + t] * cmath.exp(-2j * math.pi * k * t / 192) for t in range(192))) ** 2 for f in range(0, len(p), 192)) for k in range(1, 97)]
        centre = sum(k * x for k, x in enumerate(power, 1)) / sum(power) if sum(power) > 1e-6 else 0.0
        found = dict(x.split("=") for x in got[doc_id]["feature"].split(";"))
        assert abs(float(found["level"]) - level) < 2e-3 and int(found["crossings"]) == crossings and abs(float(found["centroid"]) - centre) < 2e-3
        units = got[doc_id]["units"]
        assert sum(u["bytes"] for u in units) == len(p) and [u["pts"] for u in units] == [k * ts.AU_TICKS for k in range(len(units))]
        assert found["points"] == ",".join(str(u["packet"]) for u in units if u["random_access"])
