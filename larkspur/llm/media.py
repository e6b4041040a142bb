"""MPEG audio columns: a reader that resynchronises, and a writer that carries bytes in valid, silent frames.

Reading: ID3v2 and ID3v1 tags are skipped and noted (between frames too), frame headers are found again after damage
(see resumes), a Xing, Info or VBRI table of the first frame is parsed, checksums (CRC-16) of Layer III frames are verified,
and exact durations and the byte offset of every frame are kept. Checksums of Layers I and II, which cover other bits, and
free-format frames, which state no size, are not read.

Writing: MPEG-1 Layer III, 48 kHz, mono. The side information says that no granule has any coded bits, so a player hears
silence; 576 bytes of payload follow in each frame as ancillary data, which the format passes on as it is.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, narrow, raw_texts

#: Payload bytes of a frame; samples of a Layer III granule.
UNIT = 576

# Fixed values of the MPEG audio format: kbit/s by bitrate index, samples a second by rate index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.int64) << 8
    for _ in range(8):
        x = np.where(x & 0x8000, (x << 1) ^ 0x8005, x << 1) & 0xFFFF
    return x


_CRC = _crc_table()


def crc16(blocks: np.ndarray) -> np.ndarray:
    """The frame checksum of each row of bytes (polynomial 0x8005, start 0xFFFF)."""
    crc = np.full(len(blocks), 0xFFFF, np.int64)
    for column in blocks.T:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ column]
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25 for MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    channels: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        """Bytes of the whole frame."""
        if self.layer == 1:
            return (12_000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.channels == 1 else 32) if self.version == 1 else (9 if self.channels == 1 else 17)

    @property
    def body(self) -> int:
        """Where the data after the header, the checksum and the side information begin."""
        return 4 + 2 * self.protected + self.side


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """A frame header, or None if these bytes aren't one (free-format frames count as none: they state no size)."""
    if four not in _HEADERS:
        if len(_HEADERS) > 10_000:
            _HEADERS.clear()
        _HEADERS[four] = _header(four)
    return _HEADERS[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    rate, bits = four[2] >> 2 & 3, four[2] >> 4
    if version is None or layer == 4 or rate == 3 or bits in (0, 15) or four[3] & 3 == 2:
        return None
    kbps = BITRATES[(1 if version == 1 else 2), layer][bits]
    return Header(version, layer, not four[1] & 1, kbps, RATES[version][rate], four[2] >> 1 & 1, 1 if four[3] >> 6 == 3 else 2)


@dataclass
class Audio:
    frames: list[tuple[int, Header]] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None  # of a Xing or Info frame
    table_at: int = -1
    skipped: int = 0  # bytes between frames that belong to none
    resyncs: int = 0
    checked: int = 0
    bad_crc: int = 0
    truncated: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for _, h in self.frames)

    @property
    def duration(self) -> float:
        """Seconds."""
        by_rate: dict[int, int] = {}
        for _, h in self.frames:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        return sum(n / rate for rate, n in sorted(by_rate.items()))

    def seek(self, seconds: float) -> int:
        """Byte offset of the frame that plays at this time; the first or last one outside the stream, -1 without frames."""
        past, at = 0.0, -1
        for offset, h in self.frames:
            if at >= 0 and past > seconds:
                break
            at, past = offset, past + h.samples / h.rate
        return at


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict[str, str]]:
    """Size of the ID3v2 tag at a position (0 if there is none) and its text frames."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return 0, {}
    synchsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    size, major, flags = synchsafe(data[at + 6 : at + 10]), data[at + 3], data[at + 5]
    end, k, tags = min(len(data), at + 10 + size), at + 10, {}
    while major in (3, 4) and k + 10 <= end and data[k : k + 1].isalpha():
        name, raw = data[k : k + 4].decode("latin-1"), data[k + 4 : k + 8]
        n = synchsafe(raw) if major == 4 and max(raw) < 128 else int.from_bytes(raw, "big")
        if name[0] == "T" and n > 1 and k + 10 + n <= end:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[k + 10], "latin-1")
            tags[name] = data[k + 11 : k + 10 + n].decode(coding, "replace").rstrip("\0")
        k += 10 + n
    return min(len(data) - at, 10 + size + 10 * bool(flags & 0x10)), tags


def xing(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in the frame at a position, or None."""
    k = at + h.body
    kind = data[k : k + 4]
    if kind not in (b"Xing", b"Info"):
        return None
    flags, k, out = int.from_bytes(data[k + 4 : k + 8], "big"), k + 8, {"kind": kind.decode()}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name], k = int.from_bytes(data[k : k + 4], "big"), k + 4
    if flags & 4:
        out["toc"], k = list(data[k : k + 100]), k + 100
    if flags & 8:
        out["quality"] = int.from_bytes(data[k : k + 4], "big")
    return out


def vbri(data: bytes, at: int) -> dict | None:
    """The other kind of variable-bitrate table, 32 bytes after the header of the first frame, or None: bytes and frames
    of the stream, and the size of each of its stretches (entries of 1 to 4 bytes, times a scale)."""
    k = at + 36
    if data[k : k + 4] != b"VBRI" or len(data) < k + 26:
        return None
    number = lambda place, n: int.from_bytes(data[k + place : k + place + n], "big")
    entries, scale, width, per = (number(place, 2) for place in (18, 20, 22, 24))
    if not 1 <= width <= 4 or len(data) < k + 26 + entries * width:
        return None
    return {"kind": "VBRI", "frames": number(14, 4), "bytes": number(10, 4), "frames_per_entry": per, "toc": [scale * number(26 + j * width, width) for j in range(entries)]}


def alike(h: Header, audio: Audio) -> bool:
    """A stream keeps its version, layer and sample rate; a header of another kind is damage."""
    known = audio.frames[-1][1] if audio.frames else h
    return (h.version, h.layer, h.rate) == (known.version, known.layer, known.rate)


def resumes(data: bytes, at: int, end: int, h: Header, audio: Audio) -> bool:
    """Does the stream go on with this header after damage? It has a right checksum if it carries one, and another
    header of its kind or the end behind it."""
    if not alike(h, audio):
        return False
    if h.protected and h.layer == 3:
        held = np.frombuffer(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side], np.uint8)[None]
        if int(crc16(held)[0]) != int.from_bytes(data[at + 4 : at + 6], "big"):
            return False
    behind = header(data[at + h.size : at + h.size + 4])
    return at + h.size == end or behind is not None and (behind.version, behind.layer, behind.rate) == (h.version, h.layer, h.rate)


def parse(data: bytes) -> Audio:
    """Read a stream from end to end; damage is skipped and counted, never an error."""
    out = Audio()
    at, out.tags = id3v2(data)
    whole = end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    lost = False
    while at < end:
        h = header(data[at : at + 4])
        if h and end < at + h.size <= whole and resumes(data, at, whole, h, out):
            end = whole  # these letters are a frame's own bytes
        if h and at + h.size <= end and (resumes(data, at, end, h, out) if lost else alike(h, out)):
            if not out.frames and out.table is None and (table := xing(data, at, h) or vbri(data, at)):
                out.table, out.table_at = table, at
            else:
                out.frames.append((at, h))
            at, lost = at + h.size, False
            continue
        if (size := id3v2(data, at)[0]) and at + size <= end:  # a tag between frames, as in joined files
            at += size
            continue
        if h and at + h.size > end and not lost:
            out.truncated += 1
        out.resyncs += not lost
        lost = True
        found = data.find(b"\xff", at + 1, end)
        out.skipped += (found if found >= 0 else end) - at
        at = found if found >= 0 else end
    if end < whole:
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    if (own := [(o, h) for o, h in out.frames if h.protected and h.layer == 3]):
        raw = np.frombuffer(data, np.uint8)
        for side in {h.side for _, h in own}:
            offsets = np.array([o for o, h in own if h.side == side])
            held = np.concatenate([raw[offsets[:, None] + [2, 3]], raw[offsets[:, None] + np.arange(6, 6 + side)]], axis=1)
            stated = raw[offsets + 4].astype(np.int64) << 8 | raw[offsets + 5]
            out.checked += len(offsets)
            out.bad_crc += int((crc16(held) != stated).sum())
    return out


#: Bitrate indexes of written frames: 224 kbit/s (672 bytes at 48 kHz), and 256 (768 bytes) for every eighth one.
_USUAL, _EIGHTH = 12, 13


def _head(bits: int) -> tuple[bytes, Header]:
    """Header, checksum and side information of a silent, protected mono frame."""
    four = bytes([0xFF, 0xFA, bits << 4 | 1 << 2, 0xC0])
    h = header(four)
    assert h is not None
    side = np.zeros((1, 2 + h.side), np.uint8)
    side[0, :2] = list(four[2:])
    return four + int(crc16(side)[0]).to_bytes(2, "big") + bytes(h.side), h


def pack(payload: bytes) -> bytes:
    """A variable-bitrate stream that carries a payload of whole units: an ID3v2 tag, a Xing frame, then the frames."""
    count = len(payload) // UNIT
    bits = [_EIGHTH if k % 8 == 7 else _USUAL for k in range(count)]
    made = {b: _head(b) for b in (_USUAL, _EIGHTH)}
    sizes = np.array([made[b][1].size for b in bits], np.int64)
    length = str(round(count * 1152 / 48)).encode()
    tag = b"TLEN" + (1 + len(length)).to_bytes(4, "big") + b"\0\0" + b"\0" + length
    tag = b"ID3\x03\0\0" + bytes([len(tag) >> s & 127 for s in (21, 14, 7, 0)]) + tag
    first, h = made[_USUAL]
    offsets = h.size + np.concatenate(([0], np.cumsum(sizes)))
    total = int(offsets[-1])
    toc = bytes(int(offsets[min(count - 1, p * count // 100)] * 256 // total) for p in range(100))
    table = b"Xing" + (15).to_bytes(4, "big") + (count + 1).to_bytes(4, "big") + total.to_bytes(4, "big") + toc + (0).to_bytes(4, "big")
    out = [tag, (first + table).ljust(h.size, b"\0")]
    for k, b in enumerate(bits):
        head, h = made[b]
        out += [head, payload[k * UNIT : (k + 1) * UNIT], bytes(h.size - len(head) - UNIT)]
    return b"".join(out)


def unpack(data: bytes, audio: Audio) -> bytes:
    """The payload of a stream that pack() has made."""
    return b"".join([data[o + h.body : o + h.body + UNIT] for o, h in audio.frames])


def describe(audio: Audio) -> str:
    """Exact duration, frame counts, checksums and seek offsets (those of each tenth of the stream) in one line."""
    n = len(audio.frames)
    seeks = [audio.frames[k * n // 10][0] for k in range(10)] if n else []
    kbps = sum(h.kbps for _, h in audio.frames) / n if n else 0
    return (
        f"frames={n};samples={audio.samples};seconds={audio.duration:.6f};kbps={kbps:.3f};"
        f"table={(audio.table or {}).get('kind', '-')}:{(audio.table or {}).get('frames', 0)};"
        f"crc={audio.checked - audio.bad_crc}/{audio.checked};resyncs={audio.resyncs};skipped={audio.skipped};"
        f"truncated={audio.truncated};tags={','.join(sorted(audio.tags))};seek={','.join(map(str, seeks))}"
    )


def mpeg_audio(media: DataFrame, column: str = "media") -> DataFrame:
    """Parse a binary column of MPEG audio beside its key doc_id.

    Columns doc_id, frames, samples, seconds, offsets (of every frame), resyncs, skipped, bad_crc, truncated, tags (names),
    table (its kind). Null and empty media and bytes without any frame give 0 frames and 0 seconds.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse(x or b"") for x in batch.column("media").to_pylist()]
        cols = {
            "frames": ([len(a.frames) for a in found], pa.int64()), "samples": ([a.samples for a in found], pa.int64()),
            "seconds": ([a.duration for a in found], pa.float64()), "offsets": ([[o for o, _ in a.frames] for a in found], pa.list_(pa.int64())),
            "resyncs": ([a.resyncs for a in found], pa.int64()), "skipped": ([a.skipped for a in found], pa.int64()),
            "bad_crc": ([a.bad_crc for a in found], pa.int64()), "truncated": ([a.truncated for a in found], pa.int64()),
            "tags": ([sorted(a.tags) for a in found], pa.list_(pa.string())), "table": ([(a.table or {}).get("kind") for a in found], pa.string()),
        }
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, t) for v, t in cols.values()]], ["doc_id", *cols])

    media = media.select(media["doc_id"].cast("bigint").alias("doc_id"), media[column].cast("binary").alias("media"))
    return map_arrow(media, run, "doc_id bigint, frames bigint, samples bigint, seconds double, offsets array<bigint>, resyncs bigint, skipped bigint, bad_crc bigint, truncated bigint, tags array<string>, table string")


def padded(raw: bytes) -> bytes:
    """Bytes with 255 appended up to a positive multiple of UNIT."""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def media_files(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's payload as an MPEG stream."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack(padded(x)) for x in raw_texts(batch)], pa.binary())], ["doc_id", "media"])

    return map_arrow(narrow(docs, "doc_id", "text"), run, "doc_id bigint, media binary")


def media_columns(docs: DataFrame) -> DataFrame:
    """Digests of every text stored as MPEG audio and read back; one row out for each row in, a null text is empty.

    Columns doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the payload as read back),
    media_bytes, media_sha256 (of the stored stream), feature, offsets (of every frame, for seeking). Equal texts give equal
    values. Rows that repeat a doc_id or a text come out each; a null doc_id stays null; an empty table gives an empty
    result. Texts of any length are stored whole. Other columns, whatever their names, are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw in raw_texts(batch):
            media = pack(padded(raw))
            audio = parse(media)
            back = unpack(media, audio)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(audio), [o for o, _ in audio.frames]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "offsets"]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    return map_arrow(narrow(docs, "doc_id", "text"), run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, offsets array<bigint>")
