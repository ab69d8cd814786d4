"""Media columns: MPEG audio streams written and read without a codec.

``write_stream`` puts a payload into the main data of Layer III frames behind an ID3v2 tag and
a Xing frame (frame count, bytes, table of contents); ``read_stream`` resynchronises on frame
headers, parses ID3v2, ID3v1, Xing, Info and VBRI data, verifies the frame checksums of all
layers, and gives the exact duration and every frame's offset. Samples are never decoded, so any
MPEG-1, 2 or 2.5 stream of Layer I to III can be read, free-format ones too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: kbit/s by (MPEG-1?, layer), and Hz of MPEG-1.
KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}  # bytes of Layer III side information by (MPEG-1?, mono?)

# Bits of a Layer II allocation by subband: MPEG-1 at high and at low bitrates, MPEG-2.
ALLOCATION_HIGH, ALLOCATION_LOW, ALLOCATION_2 = [4] * 11 + [3] * 12 + [2] * 7, [4] * 2 + [3] * 10, [4] * 4 + [3] * 7 + [2] * 19

LENGTH_FRAME = b"payload_bytes"
FREE_BYTES = 1 << 14  # no free-format frame is longer: the next sync is looked for that far
PAD = 64


class Header:
    """A frame header, or ValueError. ``free`` is the size of the stream's free-format frames without padding."""

    def __init__(self, data: bytes, at: int, free: int = 0) -> None:
        if at + 4 > len(data):
            raise ValueError("cut off")
        word = int.from_bytes(data[at : at + 4], "big")
        version, layer, rate, hertz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
        if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate == 15 or not (rate or free) or hertz == 3:
            raise ValueError("no frame")
        self.mpeg1, self.layer, self.protected, self.mono = version == 3, layer, not word >> 16 & 1, word >> 6 & 3 == 3
        self.joint = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 0 if self.mono else 32  # subbands with two allocations
        self.hertz = HERTZ[hertz] >> (0 if version == 3 else 1 if version == 2 else 2)
        self.samples = 384 if layer == 1 else 1152 if layer == 2 or self.mpeg1 else 576
        unit = 4 if layer == 1 else 1
        self.free, self.padding = not rate, (word >> 9 & 1) * unit
        self.kbits = KBITS[self.mpeg1, layer][rate - 1] if rate else free * 8 * self.hertz // self.samples // 1000
        self.size = (self.samples // 8 * self.kbits * 1000 // self.hertz // unit * unit if rate else free) + self.padding
        self.side = SIDE[self.mpeg1, self.mono] if layer == 3 else 0
        self.body = 4 + 2 * self.protected + self.side
        self.kind = word & 0xFFFE0C00  # what may not change within a stream


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def checksum(covered: bytes, bits: int | None = None) -> int:
    """CRC-16 of the last two header bytes and what follows them; of that many bits, if given."""
    whole, spare = divmod(len(covered) * 8 if bits is None else bits, 8)
    c = 0xFFFF
    for b in covered[:whole]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    for i in range(spare):
        top = c >> 15 ^ covered[whole] >> 7 - i & 1
        c = (c << 1 & 0xFFFF) ^ 0x8005 * top
    return c


def covered_bits(frame: bytes, h: Header) -> int:
    """Bits behind the checksum that it covers: side information, or allocation and, in Layer II, scale factor selection."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 + h.joint)
    each = h.kbits if h.mono else h.kbits // 2
    if not h.mpeg1:
        widths = ALLOCATION_2
    elif each < 56:
        widths = ALLOCATION_LOW[: 12 if h.hertz == 32000 else 8]
    else:
        widths = ALLOCATION_HIGH[: 30 if each >= 96 and h.hertz != 48000 else 27]
    text, at, used = int.from_bytes(frame[6:54].ljust(48, b"\0"), "big"), 0, 0
    for band, width in enumerate(widths):
        both = not h.mono and band >= h.joint  # one allocation for two channels, each with its own selection
        for _ in range(2 if band < h.joint else 1):
            at += width
            used += (1 + both) * bool(text >> 384 - at & (1 << width) - 1)
    return at + 2 * used


def is_sound(frame: bytes, h: Header) -> bool:
    """A protected frame whose checksum agrees."""
    if not h.protected:
        return False
    bits = covered_bits(frame, h)
    return len(frame) * 8 >= 48 + bits and int.from_bytes(frame[4:6], "big") == checksum(frame[2:4] + frame[6:], 16 + bits)


def free_size(data: bytes, at: int, end: int) -> int:
    """Size without padding of the free-format frames that begin here, from the next sync; 0 if there are none.

    The sync must be confirmed by a third one at the same distance, or by the end of the data.
    """

    def header(place: int) -> Header:
        h = Header(data, place, 1)
        if not h.free or place + 4 > end:
            raise ValueError("not free format")
        return h

    try:
        first = header(at)
    except ValueError:
        return 0
    there = at + first.body - 1
    while 0 <= (there := data.find(b"\xff", there + 1, min(end, at + FREE_BYTES))):
        try:
            if header(there).kind != first.kind:
                continue
            size = there - at - first.padding
            after = there + size + header(there).padding
            if size > 0 and (after == end or header(after).kind == first.kind):
                return size
        except ValueError:
            continue
    return 0


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _frame(rate: int, body: bytes, size: int) -> bytes:
    """A mono, protected MPEG-1 Layer III frame at 44.1 kHz; its side information counts the body's bits."""
    head = bytes((0xFF, 0xFA, rate << 4, 0xC0))
    side = len(body).to_bytes(2, "big") + bytes(SIDE[True, True] - 2)
    return (head + checksum(head[2:] + side).to_bytes(2, "big") + side + body).ljust(size, b"\0")


def frame_sizes() -> list[int]:
    return [144 * k * 1000 // 44100 for k in KBITS[True, 3]]


def write_stream(payload: bytes) -> bytes:
    """The payload as a tagged, variable-bitrate stream: full frames, then the smallest that fits."""
    sizes, fixed = frame_sizes(), 6 + SIDE[True, True]
    room, frames = sizes[-1] - fixed, []
    for at in range(0, len(payload), room):
        body = payload[at : at + room]
        rate = next(i for i, n in enumerate(sizes) if n - fixed >= len(body))
        frames.append(_frame(rate + 1, body, sizes[rate]))
    total = sum(map(len, frames))
    first = next(i for i, n in enumerate(sizes) if n - fixed >= 116)
    ends, toc = np.cumsum([sizes[first], *map(len, frames)]), []
    for percent in range(100):
        toc.append(min(255, int(ends[percent * len(frames) // 100]) * 256 // (total + sizes[first])))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total + sizes[first]) + bytes(toc)
    text = b"\0" + LENGTH_FRAME + b"\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\3\0\0" + _syncsafe(len(tag)) + tag + _frame(first + 1, xing, sizes[first]) + b"".join(frames)


def _unsafe(raw: bytes) -> int:
    """A number of seven bits a byte."""
    return sum((b & 127) << 7 * i for i, b in enumerate(reversed(raw)))


def _synchronised(raw: bytes) -> bytes:
    """Takes out the zero bytes that unsynchronisation put behind 0xFF."""
    return raw.replace(b"\xff\0", b"\xff")


def _texts(body: bytes) -> list[str]:
    """The strings of a text frame; its first byte names the encoding."""
    codec = {1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    raw = body[1:]
    if codec == "utf-16":
        codec = "utf-16-be" if raw[:2] == b"\xfe\xff" else "utf-16-le"
    return [x.removeprefix("\ufeff") for x in raw.decode(codec, "replace").split("\0")]


def read_tag(data: bytes) -> tuple[dict[str, str], int]:
    """Texts of a leading ID3v2 tag (2.2, 2.3 and 2.4), and where the tag ends."""
    found: dict[str, str] = {}
    if data[:3] != b"ID3" or len(data) < 10:
        return found, 0
    version, flags, end = data[3], data[5], 10 + _unsafe(data[6:10])
    tag, at = data[10:end], 0
    if flags & 0x80 and version < 4:
        tag = _synchronised(tag)
    if flags & 0x40 and version >= 3:  # an extended header; its size leaves itself out up to 2.3
        at = _unsafe(tag[:4]) if version >= 4 else 4 + int.from_bytes(tag[:4], "big")
    letters, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(tag) and tag[at : at + letters].strip(b"\0"):
        name, raw = tag[at : at + letters].decode("latin-1"), tag[at + letters : at + 2 * letters]
        n = _unsafe(raw) if version >= 4 else int.from_bytes(raw, "big")
        body = tag[at + head : at + head + n]
        if version >= 4:
            body = body[4:] if tag[at + 9] & 1 else body  # a data length comes first
            body = _synchronised(body) if tag[at + 9] & 2 or flags & 0x80 else body
        if name[0] == "T":
            texts = _texts(body)
            if name.startswith("TXX"):
                found[texts[0]] = texts[1] if len(texts) > 1 else ""
            else:
                found[name] = texts[0]
        at += head + n
    return found, min(end + 10 * bool(version >= 4 and flags & 0x10), len(data))


class Stream:
    """What ``read_stream`` finds; ``body`` joins the frames' own bytes."""

    def __init__(self, data: bytes) -> None:
        self.tags, at = read_tag(data)
        end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
        self.id3v1, self.vbr, self.start, self.head = end < len(data), None, 0, None
        self.offsets, self.skipped, self.bad, self.checked = [], 0, 0, 0
        self.samples, self.duration, bodies, kind = 0, Fraction(0), [], None
        free, own = 0, LENGTH_FRAME.decode() in self.tags
        while at < end:
            if kind is None:
                free = free_size(data, at, end) if at + 4 <= end and not data[at + 2] >> 4 else 0
            try:
                h = Header(data, at, free)
                if at + h.size > end or kind not in (None, h.kind):
                    raise ValueError
                frame = data[at : at + h.size]
                sound = is_sound(frame, h)
                if kind is None and not sound and at + h.size + 4 <= end and Header(data, at + h.size, free).kind != h.kind:
                    raise ValueError  # the first frame needs a good checksum or a second that agrees
            except ValueError:
                step = data.find(b"\xff", at + 1, end)
                step = end if step < 0 else step
                self.skipped += step - at
                at = step
                continue
            kind, self.head = h.kind, self.head or h
            if h.protected:
                self.checked += 1
                self.bad += not sound
            table = self._table(frame, h) if not self.offsets and self.vbr is None else None
            if table:
                self.vbr, self.start = table, at
            else:
                self.offsets.append(at)
                self.samples += h.samples
                self.duration += Fraction(h.samples, h.hertz)
                used = int.from_bytes(frame[h.body - h.side : h.body - h.side + 2], "big")
                bodies.append(frame[h.body :] if not own or h.layer != 3 or used > h.size - h.body else frame[h.body : h.body + used])
            self.last, at = h, at + h.size
        self.body = b"".join(bodies)
        gaps = (self.vbr or {}).get("delay", 0) + (self.vbr or {}).get("filler", 0)
        self.played = max(Fraction(0), self.duration - Fraction(gaps, self.last.hertz)) if self.offsets else self.duration  # without what the encoder added

    @staticmethod
    def _table(frame: bytes, h: Header) -> dict | None:
        mark, own = frame[h.body : h.body + 4], frame[36:40]
        if mark in (b"Xing", b"Info"):
            at, found = h.body + 8, {"kind": mark.decode()}
            flags = int.from_bytes(frame[at - 4 : at], "big")
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[name] = int.from_bytes(frame[at : at + 4], "big")
                    at += 4
            if flags & 4:
                found["toc"] = list(frame[at : at + 100])
                found["seek"] = [x * found.get("bytes", 0) // 256 for x in found["toc"]]
                at += 100
            at += 4 * bool(flags & 8)
            if frame[at : at + 4] in (b"LAME", b"Lavc", b"Lavf"):  # samples that an encoder put before and behind
                gaps = int.from_bytes(frame[at + 21 : at + 24], "big")
                found["delay"], found["filler"] = gaps >> 12, gaps & 0xFFF
            return found
        if own == b"VBRI":
            entries, scale, width, each = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58, 60))
            steps = [int.from_bytes(frame[62 + width * i : 62 + width * (i + 1)], "big") * scale for i in range(entries if 0 < width <= 4 else 0)]
            found = {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
            return found | {"seek": [sum(steps[:i]) for i in range(len(steps))], "frames_per_entry": each}
        return None

    def seek(self, seconds: Fraction | float) -> tuple[int, int]:
        """Number and offset of the frame that holds a moment, from the frames themselves; the last one beyond the end."""
        if not self.offsets:
            raise ValueError("no frames")
        n = min(len(self.offsets) - 1, max(0, int(Fraction(seconds) * len(self.offsets) / self.duration)))
        return n, self.offsets[n]

    def table_error(self) -> int | None:
        """Most bytes by which the stored seek table is off a frame's true place; null without a table.

        A Xing entry is a 256th of the bytes, so up to that much is rounding.
        """
        if not self.vbr or not self.offsets or not self.vbr.get("seek"):
            return None
        places, n = self.vbr["seek"], len(self.offsets)
        step = self.vbr.get("frames_per_entry")
        first = self.start
        at = [min(n - 1, i * step if step else i * n // len(places)) for i in range(len(places))]
        return max(abs(first + p - self.offsets[k]) for p, k in zip(places, at, strict=True))


def read_stream(data: bytes) -> Stream:
    return Stream(data)


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded with zeros to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD if text else PAD)


MEDIA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema(
    [("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    + [("duration_num", pa.int64()), ("duration_den", pa.int64()), ("bad_frames", pa.int64()), ("skipped_bytes", pa.int64()), ("frame_offsets", pa.list_(pa.int64()))]
)
READ_DDL = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_num long, duration_den long, bad_frames long, skipped_bytes long, frame_offsets array<long>"


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, media: each text as an MPEG audio stream.

    A null text is empty, and an empty one is a payload of PAD zeros. Ids may be null or
    repeated; each row makes its own stream, the same for equal texts. Only the named columns
    are read; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            texts = b["body"].to_pylist()
            yield pa.record_batch([b["id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([write_stream(payload_of(t)) for t in texts], pa.binary())], schema=MEDIA)

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return source.mapInArrow(run, "id long, n_bytes long, media binary")


def describe(payload: bytes, s: Stream) -> str:
    """Figures of the samples and of the stream."""
    a = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    level = int((a * a).sum())
    turns = int(((a[1:] < 0) != (a[:-1] < 0)).sum())
    crc = f"{s.checked - s.bad}/{s.checked}"
    form = f"layer{s.head.layer} {s.head.hertz} {'mono' if s.head.mono else 'stereo'}" if s.head else "no frames"
    return f"{form} {s.vbr['kind'] if s.vbr else 'CBR'}; frames {len(s.offsets)}; samples {s.samples}; crc {crc}; energy {level}; turns {turns}"


def _stated(tag: str | None, whole: int) -> int:
    """The payload's length that a tag states; the whole body if it states none that the body can hold."""
    return int(tag) if tag and tag.isascii() and tag.isdigit() and int(tag) <= whole else whole


def read(media: DataFrame) -> DataFrame:
    """Reads streams of a ``media`` column back: payload digests, features, exact duration
    (duration_num / duration_den seconds), bad checksums, bytes skipped to resynchronise, and
    each frame's offset. A null stream, or one without a frame, has an empty payload. A length tag
    that is no number, or more than the body holds, is passed over."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in READ}
            for doc, n, data in zip(b["id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist(), strict=True):
                data = data or b""
                s = read_stream(data)
                payload = s.body[: _stated(s.tags.get(LENGTH_FRAME.decode()), len(s.body))]
                row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), describe(payload, s), s.duration.numerator, s.duration.denominator, s.bad, s.skipped, s.offsets)
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
            yield from pa.table(out, schema=READ).to_batches()

    return media.select("id", "n_bytes", "media").mapInArrow(run, READ_DDL)
