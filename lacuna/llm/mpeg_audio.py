"""Media columns: MPEG audio.

``encode`` keeps any bytes losslessly in a playable MPEG-1 Layer III stream: an ID3v2 tag with the payload's length,
a Xing frame with the variable-bitrate table, then silent frames whose ancillary data hold the payload, and an ID3v1 tag.
``parse`` reads any such stream: it skips tags, resynchronises on frame headers (a header counts when another header, a
tag or the end follows where it says), verifies CRCs and returns exact durations and the byte offset of each frame.

``media_features`` runs both on every row of a table, one row at a time inside Arrow batches, without a shuffle.
Defined results: null text counts as empty; empty payloads are padded to 64 zero bytes; equal texts give equal rows;
repeated rows give repeated rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm.common import id_text

UNIT = 64
#: Fixed values of the MPEG audio format: kbit/s by index for MPEG-1 (layers I, II, III) and MPEG-2/2.5 (layer I, others).
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Samples a second by the version's bits (0: 2.5, 2: 2, 3: 1) and index.
RATES = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}
SIDE_MONO = 17


def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, initial value 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    length: int
    samples: int
    rate: int
    kbps: int
    crc: bool
    side: int


def read_header(four: bytes) -> Header | None:
    """The header in four bytes, or None where they are none. Free-format frames are not supported."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    family = 1 if version == 3 else 2
    kbps, hertz, pad = KBPS[family, layer][bitrate], RATES[version][rate], four[2] >> 1 & 1
    mono = four[3] >> 6 == 3
    if layer == 1:
        length, samples = (12_000 * kbps // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and family == 2 else 1152
        length = samples // 8 * 1000 * kbps // hertz + pad
    side = 0 if layer < 3 else (SIDE_MONO if mono else 32) if family == 1 else (9 if mono else SIDE_MONO)
    return Header(length, samples, hertz, kbps, not four[1] & 1, side)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _frame_start(index: int) -> bytes:
    """Header, CRC and empty side information of a mono MPEG-1 Layer III frame at 32 kHz."""
    header = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
    side = bytes(SIDE_MONO)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


STARTS = {i: _frame_start(i) for i in range(1, 15)}
LENGTHS = {i: KBPS[1, 3][i] * 144 // 32 for i in range(1, 15)}
#: Payload bytes that a frame holds, in whole units.
ROOM = {i: (LENGTHS[i] - len(STARTS[i])) // UNIT * UNIT for i in range(1, 15)}


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def encode(payload: bytes) -> bytes:
    """Store whole units of bytes: full frames at the highest bitrate, then the smallest frame that holds the rest."""
    full, rest = divmod(len(payload), ROOM[14])
    frames = []
    pad = bytes(LENGTHS[14] - len(STARTS[14]) - ROOM[14])
    for k in range(full):
        frames += (STARTS[14], payload[k * ROOM[14] : (k + 1) * ROOM[14]], pad)
    if rest:
        last = next(i for i in range(1, 15) if ROOM[i] >= rest)
        frames += (STARTS[last], payload[full * ROOM[14] :], bytes(LENGTHS[last] - len(STARTS[last]) - rest))
    n, audio = full + bool(rest), b"".join(frames)
    total = LENGTHS[1] + len(audio)
    toc = bytes(min(255, 256 * (LENGTHS[1] + min(n - 1, n * p // 100) * LENGTHS[14]) // total) for p in range(100))
    xing = STARTS[1] + b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + bytes(4)
    text = b"\0payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    return b"ID3\3\0\0" + _synchsafe(len(tag)) + tag + xing.ljust(LENGTHS[1], b"\0") + audio + b"TAG" + bytes(124) + b"\xff"


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_right: int = 0
    crc_wrong: int = 0
    skipped: int = 0
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    vbr_toc: bytes = b""

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def seconds(self) -> float:
        return sum(h.samples / h.rate for h in self.headers)


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    size = sum((data[6 + i] & 0x7F) << 7 * (3 - i) for i in range(4))
    end, at, tags = min(len(data), 10 + size), 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        n = int.from_bytes(data[at + 4 : at + 8], "big")
        if data[3] >= 4:
            n = sum((data[at + 4 + i] & 0x7F) << 7 * (3 - i) for i in range(4))
        body = data[at + 10 : min(end, at + 10 + n)]
        name = data[at : at + 4].decode("latin-1")
        if name[0] == "T" and body:
            value = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
            key, _, value = value.partition("\0") if name == "TXXX" else (name, "", value)
            tags[key] = value.rstrip("\0")
        at += 10 + n
    return tags, 10 + size + 10 * (data[5] >> 4 & 1)


def parse(data: bytes) -> Stream:
    """Read tags, the variable-bitrate table (Xing, Info or VBRI) and every frame; skip what is no frame, and count it."""
    out = Stream()
    out.tags, at = _id3v2(data)
    end = len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
    headers: dict[bytes, Header | None] = {}
    sums: dict[bytes, int] = {}
    in_step, first = False, True
    while at + 4 <= end:
        if (four := data[at : at + 4]) not in headers:
            headers[four] = read_header(four)
        head = headers[four]
        good = head is not None and at + head.length <= end
        if good and not in_step:
            after = at + head.length
            good = after >= end or read_header(data[after : after + 4]) is not None
        if not good:
            in_step = False
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        in_step = True
        body = at + 4 + 2 * head.crc
        if head.crc and head.side:
            covered = four[2:] + data[body : body + head.side]
            if covered not in sums:
                sums[covered] = crc16(covered)
            right = sums[covered] == int.from_bytes(data[at + 4 : at + 6], "big")
            out.crc_right += right
            out.crc_wrong += not right
        if first:
            first = False
            mark, vbri = body + head.side, at + 36
            if data[mark : mark + 4] in (b"Xing", b"Info"):
                flags, at_field = int.from_bytes(data[mark + 4 : mark + 8], "big"), mark + 8
                if flags & 1:
                    out.vbr_frames, at_field = int.from_bytes(data[at_field : at_field + 4], "big"), at_field + 4
                if flags & 2:
                    out.vbr_bytes, at_field = int.from_bytes(data[at_field : at_field + 4], "big"), at_field + 4
                if flags & 4:
                    out.vbr_toc = data[at_field : at_field + 100]
                at += head.length
                continue
            if data[vbri : vbri + 4] == b"VBRI":
                out.vbr_bytes, out.vbr_frames = (int.from_bytes(data[vbri + k : vbri + k + 4], "big") for k in (10, 14))
                at += head.length
                continue
        out.offsets.append(at)
        out.headers.append(head)
        at += head.length
    out.skipped += max(0, end - at)
    return out


def decode(data: bytes) -> tuple[bytes, Stream]:
    """The payload of a stream that ``encode`` made, read from its frames."""
    stream = parse(data)
    left, parts = int(stream.tags["payload"]), []
    for at, head in zip(stream.offsets, stream.headers, strict=True):
        start = at + 4 + 2 * head.crc + head.side
        n = min(left, (head.length - (start - at)) // UNIT * UNIT)
        parts.append(data[start : start + n])
        left -= n
    if left:
        raise ValueError(f"{left} payload bytes are missing")
    return b"".join(parts), stream


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long, crc_failures long"


def _row(text: str) -> tuple:
    raw = text.encode()
    media = encode(padded(raw))
    payload, s = decode(media)
    us = round(s.seconds * 1e6)
    seek = zlib.crc32(b"".join(x.to_bytes(8, "little") for x in s.offsets))
    feature = f"frames={len(s.offsets)};samples={s.samples};us={us};vbr={s.vbr_frames}/{s.vbr_bytes};toc={zlib.crc32(s.vbr_toc):08x};seek={seek:08x};crc={s.crc_right}/{s.crc_wrong};skipped={s.skipped}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(s.offsets), us, s.crc_wrong


def media_features(docs: DataFrame) -> DataFrame:
    """Encode every text, read the stored bytes back and describe them."""

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [_row(x.as_py()) for x in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.string() if f"{n} string" in SCHEMA else pa.int64() for n in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return id_text(docs).mapInArrow(run, SCHEMA)


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the stored stream, for a table of media."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(padded(x.as_py().encode())) for x in batch.column("text")], pa.binary())], ["doc_id", "media"])

    return id_text(docs).mapInArrow(run, "doc_id long, media binary")


def seek_table(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """Of each stream (null: none): tags, exact seconds, frame seek offsets, checksum failures and skipped bytes."""

    def run(batches):
        for batch in batches:
            found = [parse(x.as_py() or b"") for x in batch.column(media_col)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array([s.seconds for s in found], pa.float64()), pa.array([s.offsets for s in found], pa.list_(pa.int64())), pa.array([list(s.tags.items()) for s in found], pa.map_(pa.string(), pa.string())), pa.array([s.crc_wrong for s in found], pa.int64()), pa.array([s.skipped for s in found], pa.int64())],
                ["doc_id", "seconds", "seek_offsets", "tags", "crc_failures", "skipped_bytes"],
            )

    return media.select(id_col, media_col).mapInArrow(run, "doc_id long, seconds double, seek_offsets array<long>, tags map<string,string>, crc_failures long, skipped_bytes long")
