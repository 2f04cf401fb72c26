"""Media columns: payloads in MPEG transport streams, and a reader that checks and reassembles them."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipmill.llm.common import stored, utf8

#: Fixed values of the format: packet size, sync byte, identifiers, stream ids and clocks (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PROGRAM = 188, 0x47, 0x0000, 0x1000, 0x0100, 1
PRIVATE_STREAM, PRIVATE_TYPE, TICKS = 0xBD, 0x06, 90_000
#: Stream ids whose packets have no optional header (map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 E, directory).
BARE_STREAMS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
#: One access unit of AU_BYTES each AU_TICKS; each RAP_EVERY-th unit is a random-access point.
AU_BYTES, AU_TICKS, RAP_EVERY = 16 * 1024, 3600, 8
UNIT = 192


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    """A program table section in a packet's payload: pointer, header, body, CRC."""
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + extension.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return b"\0" + head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10]) + section).ljust(PACKET, b"\xff")


HEAD = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _clock(ticks: int) -> bytes:
    return bytes([ticks >> 25 & 0xFF, ticks >> 17 & 0xFF, ticks >> 9 & 0xFF, ticks >> 1 & 0xFF, (ticks & 1) << 7 | 0x7E, 0])


def padded(text: str | None) -> bytes:
    data = utf8(text)
    return data + b" " * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def mux(payload: bytes) -> bytes:
    """The payload as one program with one private stream: PAT, PMT, then a PES packet for each access unit."""
    parts, counter = [HEAD], 0
    for k, at in enumerate(range(0, len(payload), AU_BYTES)):
        pts = k * AU_TICKS
        unit = payload[at : at + AU_BYTES]
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # The first packet has an adaptation field with the clock, and the random-access flag where it holds.
        field = bytes([7, 0x10 | 0x40 * (k % RAP_EVERY == 0)]) + _clock(pts)
        room = PACKET - 4 - len(field)
        if len(pes) < room:
            field = bytes([len(field) - 1 + room - len(pes)]) + field[1:] + b"\xff" * (room - len(pes))
            room = len(pes)
        rest = len(pes) - room
        full, last = divmod(rest, PACKET - 4)
        n = 1 + full + (last > 0)
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        out[0, 3] |= 0x20
        out[0, 4:] = np.frombuffer(field + pes[:room], np.uint8)
        body = np.frombuffer(pes, np.uint8)[room:]
        out[1 : 1 + full, 4:] = body[: full * (PACKET - 4)].reshape(full, PACKET - 4)
        if last:  # stuffing in an adaptation field: its length, flags if it has room for them, then 0xFF
            stuff = PACKET - 4 - last
            out[-1, 3] |= 0x20
            out[-1, 4] = stuff - 1
            if stuff > 1:
                out[-1, 5] = 0
            out[-1, PACKET - last :] = body[full * (PACKET - 4) :]
        counter += n
        parts.append(out.tobytes())
    return b"".join(parts)


class Broken(ValueError):
    """A stream that breaks the format."""


_CRC: dict[bytes, int] = {}


def crc32_mpeg_cached(section: bytes) -> int:
    if section not in _CRC:
        if len(_CRC) > 1000:
            _CRC.clear()
        _CRC[section] = crc32_mpeg(section)
    return _CRC[section]


class Packets:
    """A stream's packets as a matrix, with what their headers say."""

    def __init__(self, media: bytes):
        if len(media) % PACKET or not media:
            raise Broken("not whole packets")
        self.rows = rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        if (rows[:, 0] != SYNC).any():
            raise Broken("lost sync")
        self.pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
        self.starts, self.failed = rows[:, 1] & 0x40 > 0, rows[:, 1] & 0x80 > 0
        self.scrambled, self.counter = rows[:, 3] & 0xC0 > 0, rows[:, 3].astype(np.int16) & 15
        self.has_payload, adapted = rows[:, 3] & 0x10 > 0, rows[:, 3] & 0x20 > 0
        # An adaptation field of length 0 has no flags.
        flags = np.where(adapted & (rows[:, 4] > 0), rows[:, 5], 0)
        self.jumps, self.random_access = flags & 0x80 > 0, flags & 0x40 > 0
        self.begins = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
        if (self.begins[self.has_payload] > PACKET).any():
            raise Broken("an adaptation field is longer than its packet")

    def of(self, pid: int) -> np.ndarray:
        """The packets of a pid that carry payload, each once: continuity counters are checked, repeated packets go."""
        index = np.flatnonzero((self.pid == pid) & self.has_payload)
        if self.failed[index].any():
            raise Broken(f"a packet of pid {pid} is marked as damaged")
        if self.scrambled[index].any():
            raise Broken(f"pid {pid} is scrambled")
        step = np.diff(self.counter[index]) % 16
        again = np.concatenate([[False], step == 0])
        for k in np.flatnonzero(again):  # a packet may be sent twice, with the clock alone changed
            x, y = self.rows[index[k - 1]], self.rows[index[k]]
            again[k] = not self.jumps[index[k]] and not again[k - 1] and (x[self.begins[index[k - 1]] :].tobytes() == y[self.begins[index[k]] :].tobytes())
        gaps = np.concatenate([[False], step != 1]) & ~again
        # After a discontinuity, also one that a packet without payload tells of, any counter may follow.
        told = np.cumsum((self.pid == pid) & self.jumps)[index]
        gaps[1:] &= told[1:] == told[:-1]
        if gaps.any():
            raise Broken("a continuity counter is off")
        return index[~again]

    def payload(self, index: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The payload of packets end to end, and where each one's begins (and the last one's ends)."""
        own = self.rows[index]
        return own[np.arange(PACKET) >= self.begins[index][:, None]].tobytes(), np.cumsum(np.concatenate([[0], PACKET - self.begins[index]]))

    def sections(self, pid: int, table_id: int) -> list[bytes]:
        """The bodies of a table's sections, which may go over several packets; those that aren't yet in force are left out."""
        index = self.of(pid)
        found = []
        data, at = self.payload(index)
        starts = np.flatnonzero(self.starts[index])
        for n, k in enumerate(starts):
            begin = at[k] + 1 + data[at[k]]  # after the pointer
            # What follows up to the pointer's target of the next start belongs to the last section here.
            stop = at[-1] if n + 1 == len(starts) else at[starts[n + 1]] + 1 + data[at[starts[n + 1]]]
            piece = data[begin : at[starts[n + 1]]] + data[at[starts[n + 1]] + 1 : stop] if n + 1 < len(starts) else data[begin:stop]
            while len(piece) > 3 and piece[0] != 0xFF:
                size = 3 + ((piece[1] & 0x0F) << 8 | piece[2])
                section, piece = piece[:size], piece[size:]
                if section[0] != table_id:
                    continue
                if len(section) < size or crc32_mpeg_cached(section):
                    raise Broken(f"table {table_id} is damaged")
                if section[5] & 1:
                    found.append(section[8:-4])
        if not found:
            raise Broken(f"no table {table_id}")
        return list(dict.fromkeys(found))


def programs(packets: Packets) -> dict[int, list[tuple[int, int]]]:
    """Each program's elementary streams (pid, type), by way of the program tables."""
    out = {}
    for body in packets.sections(PAT_PID, 0x00):
        for k in range(0, len(body) - 3, 4):
            number, pid = int.from_bytes(body[k : k + 2], "big"), (body[k + 2] & 0x1F) << 8 | body[k + 3]
            if number:  # 0 is the network table
                streams = []
                for pmt in packets.sections(pid, 0x02):
                    at = 4 + ((pmt[2] & 0x0F) << 8 | pmt[3])
                    while at + 5 <= len(pmt):
                        streams.append(((pmt[at + 1] & 0x1F) << 8 | pmt[at + 2], pmt[at]))
                        at += 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])
                out[number] = streams
    return out


def _unit(pes: bytes) -> tuple[int | None, bytes]:
    """Time stamp (none if it has none) and payload of an elementary packet; one of length 0 goes on to the next start."""
    if pes[:3] != b"\0\0\1":
        raise Broken("no packet start code")
    size = int.from_bytes(pes[4:6], "big")
    if size and len(pes) < 6 + size:
        raise Broken("an elementary packet is cut short")
    stop = 6 + size if size else len(pes)
    if pes[3] in BARE_STREAMS:
        return None, pes[6:stop]
    pts = None
    if pes[7] & 0x80:
        t = pes[9:14]
        pts = (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1
    return pts, pes[9 + pes[8] : stop]


def demux(media: bytes, program: int | None = None) -> tuple[bytes, list[tuple[int | None, int, bool, int]], int]:
    """Payload, (time stamp, packet index, random access, bytes) of each access unit, and the number of packets.

    Follows the tables to the first elementary stream of a program (the least one unless it is given). Packets without
    payload, repeated packets, null packets and told discontinuities are legal; Broken is raised for lost sync, damaged,
    scrambled or missing packets, a damaged or missing table, and elementary packets that are cut short.
    """
    packets = Packets(media)
    found = programs(packets)
    number = min(found, default=None) if program is None else program
    if not found.get(number):
        raise Broken("no such program, or one without a stream")
    index = packets.of(found[number][0][0])
    data, at = packets.payload(index)
    starts = np.flatnonzero(packets.starts[index])
    units, parts = [], []
    for a, b in zip(starts, [*starts[1:], len(index)], strict=True):
        pts, payload = _unit(data[at[a] : at[b]])
        parts.append(payload)
        units.append((pts, int(index[a]), bool(packets.random_access[index[a]]), len(payload)))
    return b"".join(parts), units, len(packets.rows)


def unit_features(samples: np.ndarray) -> tuple[float, int]:
    """Of a unit's 8-bit samples: the level (root of the mean square around their mean), and how often they cross the mean."""
    off = samples - samples.mean() if len(samples) else samples.astype(float)
    level = float(np.sqrt((off * off).mean())) if len(off) else 0.0
    return level, int(np.count_nonzero((off[1:] >= 0) != (off[:-1] >= 0)))


def centroid(samples: np.ndarray) -> float:
    """The spectrum's centre of mass in bins, over frames of 192 samples, without the constant part; 0 for silence."""
    frames = samples[: len(samples) // UNIT * UNIT].reshape(-1, UNIT).astype(float)
    power = (np.abs(np.fft.rfft(frames - frames.mean(axis=1, keepdims=True), axis=1)) ** 2).sum(axis=0)[1:]
    return float((power * np.arange(1, len(power) + 1)).sum() / power.sum()) if power.sum() > 1e-6 else 0.0


def encode_udf():
    return F.arrow_udf(lambda texts: pa.array([mux(padded(t)) for t in texts.to_pylist()], pa.binary()), T.BinaryType())


READ = T.StructType([
    T.StructField("payload", T.BinaryType()), T.StructField("packets", T.LongType()), T.StructField("units", T.ArrayType(T.StructType([
        T.StructField("pts", T.LongType()), T.StructField("packet", T.LongType()), T.StructField("random_access", T.BooleanType()),
        T.StructField("bytes", T.LongType()), T.StructField("level", T.DoubleType()), T.StructField("crossings", T.LongType()),
    ]))), T.StructField("error", T.StringType()),
])
UNITS_ARROW = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.int64()), ("level", pa.float64()), ("crossings", pa.int64())]))
READ_ARROW = pa.struct([("payload", pa.binary()), ("packets", pa.int64()), ("units", UNITS_ARROW), ("error", pa.string())])


def _read_one(media: bytes | None) -> dict:
    try:
        payload, found, packets = demux(media or b"")
    except (Broken, IndexError) as e:
        return {"payload": None, "packets": len(media or b"") // PACKET, "units": [], "error": str(e)}
    samples, at, units = np.frombuffer(payload, np.uint8), 0, []
    for pts, packet, random_access, size in found:
        level, crossings = unit_features(samples[at : at + size])
        units.append({"pts": pts, "packet": packet, "random_access": random_access, "bytes": size, "level": level, "crossings": crossings})
        at += size
    return {"payload": payload, "packets": packets, "units": units, "error": None}


def decode_udf():
    return F.arrow_udf(lambda media: pa.array([_read_one(m) for m in media.to_pylist()], READ_ARROW), READ)


def store(docs: DataFrame) -> DataFrame:
    """docs with a column `media`: the text's UTF-8 bytes, padded with blanks to a positive multiple of 192, as a
    transport stream. A null text counts as empty (one block of blanks). A column `media` of docs is replaced."""
    return docs.withColumn("media", encode_udf()(F.col("text")))


def read(stored: DataFrame) -> DataFrame:
    """A table with `media`, with a struct `stream`: payload, packets, units (time stamp, packet index, random-access
    flag, bytes, level and mean crossings of the samples) and error. A stream that breaks the format, or null, has an error and no payload; none stops the job."""
    return stored.withColumn("stream", decode_udf()(F.col("media")))


DIGEST = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), READ["units"],
])
DIGEST_ARROW = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("units", UNITS_ARROW)])


def feature(stream: dict) -> str:
    """Level, crossings and spectral centre of the samples, and the packets of random-access points, as text."""
    samples = np.frombuffer(stream["payload"], np.uint8)
    level, crossings = unit_features(samples)
    points = ",".join(str(u["packet"]) for u in stream["units"] if u["random_access"])
    return f"level={level:.3f};crossings={crossings};centroid={centroid(samples):.3f};points={points}"


def _digest_one(media: bytes) -> dict:
    stream = _read_one(media)
    if stream["error"]:
        raise Broken(stream["error"])
    payload = stream["payload"]
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(stream), "units": stream["units"],
    }


def op5_transport_stream(spark, sf_dir: str) -> DataFrame:
    """Documents as transport streams in a stored media column, and digests of what is read back from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    media = stored(store(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media"), "media", compression="zstd")
    digest = F.arrow_udf(lambda batch: pa.array([_digest_one(m) for m in batch.to_pylist()], DIGEST_ARROW), DIGEST)
    return media.withColumn("d", digest(F.col("media"))).select("doc_id", "n_bytes", "d.*")
