"""Media columns as MPEG transport streams: multiplex a payload, and read streams back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, PAT_TABLE, PMT_TABLE, PRIVATE_DATA, PRIVATE_STREAM, CLOCK = 188, 0x47, 0, 0x00, 0x02, 0x06, 0xBD, 90_000

#: Of the streams written here: the PIDs, bytes of payload in an access unit, ticks between units, and units from one random-access point to the next.
PMT_PID, DATA_PID, UNIT, TICKS, RANDOM_ACCESS = 0x100, 0x101, 16_384, 3_600, 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _section_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _section_packet(PAT_PID, _section(PAT_TABLE, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _section_packet(
    PMT_PID, _section(PMT_TABLE, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_DATA, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
)


def _pes(payload: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])
    return b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(payload) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + payload


def multiplex(payload: bytes) -> bytes:
    """A stream of one program with one private elementary stream that carries the payload: access units of
    UNIT bytes, each a packet with a timestamp, every RANDOM_ACCESS-th marked as a random-access point."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pes = _pes(payload[at : at + UNIT], k * TICKS % (1 << 33))
        access = k % RANDOM_ACCESS == 0
        room = PACKET - 4
        first = min(len(pes), room - 2 if access else room)
        rest = -(-(len(pes) - first) // room)
        grid = np.full((1 + rest, PACKET), 0xFF, np.uint8)
        grid[:, 0], grid[:, 1], grid[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        grid[0, 1] |= 0x40
        grid[:, 3] = 0x10 | (counter + np.arange(1 + rest)) % 16
        counter += 1 + rest
        data = np.frombuffer(pes, np.uint8)
        sizes = [first] + [room] * rest
        sizes[-1] = len(pes) - sum(sizes[:-1])
        for row in {0, rest}:  # these may be stuffed; the others are full
            stuffing = room - sizes[row]
            if stuffing:
                grid[row, 3] |= 0x20
                grid[row, 4] = stuffing - 1
                if stuffing > 1:
                    grid[row, 5] = 0x40 if access and row == 0 else 0
            grid[row, PACKET - sizes[row] :] = data[: first] if row == 0 else data[len(pes) - sizes[row] :]
        if rest > 1:
            grid[1:rest, 4:] = data[first : first + (rest - 1) * room].reshape(rest - 1, room)
        out.append(grid.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: program -> {pid: stream type}, the payload of the first elementary stream,
    and for each access unit its timestamp, offset in the payload and whether it is a random-access point. missing: bytes
    that elementary packets state and that didn't arrive."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    lost: int = 0
    repeated: int = 0
    missing: int = 0


def _read_section(packets: np.ndarray, starts: np.ndarray, table: int) -> bytes:
    """The body of the first whole section in a PID's packets: after the 8 bytes of its head, up to its checksum."""
    got = b""
    for row, start in zip(packets, starts, strict=True):
        part = row[start:].tobytes()
        if row[1] & 0x40:
            if got:
                break
            got = part[1 + part[0] :]
        elif got:
            got += part
        if len(got) >= 3 and len(got) >= (need := 3 + ((got[1] & 15) << 8 | got[2])):
            if got[0] != table or crc_mpeg(got[:need]):
                raise ValueError("a program table is damaged")
            return got[8 : need - 4]
    raise ValueError("a program table is missing")


def demultiplex(media: bytes) -> Stream:
    """Read a stream: program tables by their checksums, continuity counters (a repeated packet counts once, a gap
    is counted as lost), then the elementary packets' payloads. ValueError if it isn't such a stream."""
    if not media or len(media) % PACKET:
        raise ValueError("a transport stream has whole packets")
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise ValueError("a packet lacks its sync byte")
    pids = (grid[:, 1].astype(np.int32) & 31) << 8 | grid[:, 2]
    adapted = grid[:, 3] & 0x20 != 0
    starts = np.where(adapted, 5 + grid[:, 4].astype(np.int32), 4)
    starts[grid[:, 3] & 0x10 == 0] = PACKET

    out = Stream()
    at = pids == PAT_PID
    body = _read_section(grid[at], starts[at], PAT_TABLE)
    for i in range(0, len(body), 4):
        number, pid = body[i] << 8 | body[i + 1], (body[i + 2] & 31) << 8 | body[i + 3]
        if not number:
            continue
        at = pids == pid
        table = _read_section(grid[at], starts[at], PMT_TABLE)
        kinds, k = {}, 4 + ((table[2] & 15) << 8 | table[3])
        while k + 5 <= len(table):
            kinds[(table[k + 1] & 31) << 8 | table[k + 2]] = table[k]
            k += 5 + ((table[k + 3] & 15) << 8 | table[k + 4])
        out.programs[number] = kinds
    wanted = next((pid for kinds in out.programs.values() for pid in kinds), None)
    at = np.flatnonzero((pids == wanted) & (grid[:, 3] & 0x10 != 0)) if wanted is not None else np.zeros(0, np.int64)
    if not len(at):
        return out
    counters = grid[at, 3].astype(np.int32) & 15
    step = np.diff(counters) % 16
    same = np.concatenate([[False], step == 0])
    out.repeated = int(same.sum())
    announced = (grid[at, 3] & 0x20 != 0) & (grid[at, 4] > 0) & (grid[at, 5] & 0x80 != 0)
    out.lost = int(((step > 1) & ~announced[1:]).sum())
    at = at[~same]
    rows, begin = grid[at], starts[at]
    data = rows[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    unit = np.flatnonzero(rows[:, 1] & 0x40)
    edges = [*(ends[unit] - (PACKET - begin[unit])).tolist(), len(data)]
    access = ((rows[unit, 3] & 0x20 != 0) & (rows[unit, 4] > 0) & (rows[unit, 5] & 0x40 != 0)).tolist()
    parts, done = [], 0
    for i, point in enumerate(access):
        pes = data[edges[i] : edges[i + 1]]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            raise ValueError("an elementary packet lacks its start code")
        if pes[7] & 0x80:
            p = pes[9:14]
            pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 254) << 14 | p[3] << 7 | p[4] >> 1
        else:
            pts = -1
        size = pes[4] << 8 | pes[5]
        body = pes[9 + pes[8] : 6 + size if size else None]
        out.missing += max(0, 6 + size - len(pes)) if size else 0
        out.timestamps.append(pts)
        out.offsets.append(done)
        out.random_access.append(point)
        parts.append(body)
        done += len(body)
    out.payload = b"".join(parts)
    return out


def pad(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of `unit`."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


#: What read_streams() adds to each row.
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, programs int, lost int, repeated int, missing long, timestamps array<long>, offsets array<long>, random_access array<boolean>, error string"


#: Bytes of streams from which a batch ends: all of a task's at once would lie in the JVM and in two workers.
BATCH_BYTES = 1 << 22


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """(ids, n_bytes, media) of rows (id, text), in batches of some BATCH_BYTES."""
    ids, sizes, media, held = [], [], [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            ids.append(i.as_py())
            sizes.append(len(raw))
            media.append(multiplex(pad(raw)))
            held += len(media[-1])
            if held >= BATCH_BYTES:
                yield ids, sizes, media
                ids, sizes, media, held = [], [], [], 0
    if ids:
        yield ids, sizes, media


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def write_streams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text's UTF-8 bytes, padded, as a transport stream. A null text is empty,
    and an empty one 64 zero bytes. The stream depends on the text alone. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, media in _streams(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return _slim(docs, key, text).mapInArrow(tidy(run), "id long, n_bytes long, media binary").withColumnRenamed("id", key)


def stream_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, *FEATURES) of each whole text's stream, read back from the bytes that write_streams() has for it: what read_streams() gives, but
    the streams, larger than the texts, stay in the task that writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, media in _streams(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *_feature_arrays(media)], names=["id", "n_bytes", *_NAMES])

    return _slim(docs, key, text).mapInArrow(tidy(run), f"id long, n_bytes long, {FEATURES}").withColumnRenamed("id", key)


def features(media: bytes | None) -> tuple:
    """FEATURES of one stream; null media give nulls, and what isn't a stream nulls and an error."""
    if media is None:
        return (None,) * 13
    try:
        s = demultiplex(media)
    except (ValueError, IndexError) as e:
        return (None, None, None, len(media), hashlib.sha256(media).hexdigest(), *(None,) * 7, str(e))
    return (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(s.programs), s.lost, s.repeated, s.missing, s.timestamps, s.offsets, s.random_access, None)


_NAMES = [x.split()[0] for x in FEATURES.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.string()]


def _feature_arrays(media: Iterable[bytes | None]) -> list[pa.Array]:
    found = [features(m) for m in media]
    return [pa.array([f[i] for f in found], t) for i, t in enumerate(_TYPES)]


def read_streams(media: DataFrame, key: str = "doc_id", column: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, *FEATURES) of each stream in a column of bytes."""
    slim = media.select(F.col(key), *keep, F.col(column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", " + FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = _feature_arrays(m.as_py() for m in b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], *_NAMES])

    return slim.mapInArrow(tidy(run), schema)
