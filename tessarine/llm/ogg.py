"""Media columns: Ogg containers in a binary column.

The parser walks the pages of a container, verifies each page's checksum, reassembles
packets from lacing values (also across pages), sorts them by logical stream, and turns
granule positions into seconds by the rate that the stream's first packet names (Opus,
Vorbis, Speex, FLAC; other streams have no times). A page's granule position is that of the
last packet that ends on it; the packets since the position before it are spread evenly between
the two (exact where packets have one duration), the first ones from position 0. No packet
between two positions that a loss parts has a time, nor has one behind the last position, nor
a header.

Damage: a page with a wrong checksum is dropped and the next capture pattern searched; its
stream loses the packet that it would have continued. Missing page numbers, packets without
a beginning and an unfinished last packet are counted, never guessed at.

Defined results: a NULL container has no streams (NULL), an empty one or one without a
valid page an empty list. Streams come in the order of their first page. Rows are parsed
on their own; repeated rows give repeated results. Where media has a column of the result's
name, the result's gets an underscore.

``mux`` writes containers, for fixtures and for ``from_documents``, which turns the documents
table into a media column: its lines as the packets of one stream, its language and source
as another. The query parses that column, so its result can be told from the table by SQL.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import _run

CAPTURE = b"OggS"
_HEADER = "<4sBBqIIIB"
_FLIP = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4
STREAM = (
    "serial bigint, codec string, rate int, pages int, bad_pages int, lost_pages int, packets int, broken_packets int, "
    "bytes bigint, md5 string, first_time double, last_time double, times array<double>, ended boolean"
)


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, no inversion, over a page whose own field is 0.

    zlib has the mirrored form: mirroring bytes on the way in and the result on the way out
    gives this one, and its inversions cancel against the start value.
    """
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Stream:
    serial: int
    codec: str | None = None
    rate: int | None = None
    skip: int = 0
    headers: int = 0
    pages: int = 0
    bad_pages: int = 0
    lost_pages: int = 0
    broken_packets: int = 0
    packets: list[bytes] = field(default_factory=list)
    #: By packet: its page's granule position if it is the last to end there.
    granules: list[int | None] = field(default_factory=list)
    ended: bool = False
    #: Packets in front of which something was lost.
    gaps: set[int] = field(default_factory=set)
    _next: int | None = None
    _part: list[bytes] | None = None

    def describe(self, packet: bytes) -> None:
        """Codec, rate and number of header packets from the first packet."""
        if packet.startswith(b"OpusHead") and len(packet) >= 12:
            self.codec, self.rate, self.skip, self.headers = "opus", 48_000, struct.unpack_from("<H", packet, 10)[0], 2
        elif packet.startswith(b"\x01vorbis") and len(packet) >= 16:
            self.codec, self.rate, self.headers = "vorbis", struct.unpack_from("<I", packet, 12)[0], 3
        elif packet.startswith(b"Speex   ") and len(packet) >= 40:
            self.codec, self.rate, self.headers = "speex", struct.unpack_from("<I", packet, 36)[0], 2
        elif packet.startswith(b"\x7fFLAC") and len(packet) >= 30:
            self.codec, self.rate = "flac", int.from_bytes(packet[27:30], "big") >> 4
            self.headers = 1 + struct.unpack_from(">H", packet, 7)[0]

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        self.pages += 1
        if self._next is not None and number != self._next:
            self.lost_pages += max(number - self._next, 1)
            self.gaps.add(len(self.packets))
            if self._part is not None:
                self.broken_packets += 1
                self._part = None
        self._next = number + 1
        skipping = bool(flags & CONTINUED) and self._part is None
        if not flags & CONTINUED and self._part is not None:
            self.broken_packets += 1
            self._part = None
        at = start = 0
        last = None
        for value in lacing:
            at += value
            if value == 255:
                continue
            if skipping:
                self.broken_packets += 1
                self.gaps.add(len(self.packets))
                skipping = False
            else:
                packet = b"".join([*(self._part or ()), body[start:at]])
                if not self.packets:
                    self.describe(packet)
                self.packets.append(packet)
                self.granules.append(None)
                last = len(self.packets) - 1
            self._part, start = None, at
        if last is not None and granule >= 0:
            self.granules[last] = granule
        if lacing and lacing[-1] == 255 and not skipping:
            self._part = [*(self._part or ()), body[start:at]]
        self.ended |= bool(flags & LAST)

    def time(self, granule: float | None) -> float | None:
        return None if granule is None or not self.rate else round((granule - self.skip) / self.rate, 6)

    def positions(self) -> list[float | None]:
        """Granule position at the end of each packet."""
        out: list[float | None] = [None] * len(self.packets)
        base, start = 0, self.headers
        for k in range(self.headers, len(self.packets)):
            mark = self.granules[k]
            if mark is None:
                continue
            whole = mark >= base and not any(g in self.gaps for g in range(start, k + 1))
            for i in range(start, k) if whole else ():
                out[i] = base + (mark - base) * (i - start + 1) / (k - start + 1)
            out[k], base, start = mark, mark, k + 1
        return out

    def times(self) -> list[float | None]:
        """Seconds at the end of each packet."""
        return [self.time(x) for x in self.positions()]

    def data(self) -> list[bytes]:
        return self.packets[self.headers :]

    def summary(self) -> dict:
        data, times = self.data(), self.times()[self.headers :]
        return {
            "serial": self.serial, "codec": self.codec, "rate": self.rate, "pages": self.pages, "bad_pages": self.bad_pages,
            "lost_pages": self.lost_pages, "packets": len(data), "broken_packets": self.broken_packets + (self._part is not None),
            "bytes": sum(map(len, data)), "md5": hashlib.md5(b"".join(data)).hexdigest(),
            "first_time": times[0] if times else None, "last_time": next((t for t in reversed(times) if t is not None), None), "times": times, "ended": self.ended,
        }


def parse(container: bytes) -> list[Stream]:
    """The logical streams of a container."""
    streams: dict[int, Stream] = {}
    at = container.find(CAPTURE)
    while at >= 0:
        lacing = container[at + 27 : at + 27 + container[at + 26]] if at + 27 <= len(container) else b""
        end = at + 27 + len(lacing) + sum(lacing)
        whole = at + 27 <= len(container) and len(lacing) == container[at + 26] and end <= len(container) and container[at + 4] == 0
        if whole:
            _, _, flags, granule, serial, number, crc, _ = struct.unpack_from(_HEADER, container, at)
            if checksum(container[at : at + 22] + b"\0\0\0\0" + container[at + 26 : end]) == crc:
                stream = streams.setdefault(serial, Stream(serial))
                stream.add(flags, granule, number, lacing, container[at + 27 + len(lacing) : end])
                at = container.find(CAPTURE, end)
                continue
            if serial in streams:
                streams[serial].bad_pages += 1
        at = container.find(CAPTURE, at + 1)
    return list(streams.values())


def mux(streams: list[tuple[int, list[tuple[bytes, int]]]], page_segments: int = 255) -> bytes:
    """A container of (serial, [(packet, granule)]) streams, page by page in turn.

    The first packet of a stream has pages of its own; the segments of the others fill pages one
    after the other. The last page has the end mark.
    """
    queues = []
    for serial, packets in streams:
        pages = []
        for own in (packets[:1], packets[1:]):
            lacing, ends, begins = bytearray(), {}, {0}
            for packet, granule in own:
                lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
                ends[len(lacing) - 1] = granule
                begins.add(len(lacing))
            body, at = b"".join(p for p, _ in own), 0
            for start in range(0, len(lacing), page_segments):
                part = bytes(lacing[start : start + page_segments])
                last = max((k for k in range(start, start + len(part)) if k in ends), default=None)
                pages.append((part, body[at : at + sum(part)], -1 if last is None else ends[last], start not in begins))
                at += sum(part)
        queues.append((serial, pages))
    out = []
    for number in range(max((len(pages) for _, pages in queues), default=0)):
        for serial, pages in queues:
            if number < len(pages):
                lacing, body, mark, go_on = pages[number]
                flags = CONTINUED * go_on + FIRST * (number == 0) + LAST * (number == len(pages) - 1)
                head = struct.pack(_HEADER, CAPTURE, 0, flags, mark, serial, number, 0, len(lacing))
                page = head + lacing + body
                out.append(page[:22] + checksum(page).to_bytes(4, "little") + page[26:])
    return b"".join(out)


def demux(media: DataFrame, column: str = "media", into: str = "streams") -> DataFrame:
    """media with one struct for each logical stream in the array column ``into``."""

    [into] = _run.fresh(media, into)

    def parsed(containers: pa.Array) -> pa.Array:
        return pa.array([None if c is None else [s.summary() for s in parse(c)] for c in containers.to_pylist()], _STREAMS)

    return media.withColumn(into, F.arrow_udf(parsed, f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in STREAM.split(', '))}>>")(column))


def packets(media: DataFrame, column: str = "media", into: str = "packets") -> DataFrame:
    """media with every packet as a struct (serial, number, time, data) in the array column ``into``."""

    [into] = _run.fresh(media, into)

    def parsed(containers: pa.Array) -> pa.Array:
        out = []
        for c in containers.to_pylist():
            found = [] if c is not None else None
            for s in parse(c) if c is not None else ():
                found += [
                    {"serial": s.serial, "number": k, "time": t, "data": p} for k, (p, t) in enumerate(zip(s.packets, s.times(), strict=True))
                ]
            out.append(found)
        kind = pa.list_(pa.struct([("serial", pa.int64()), ("number", pa.int32()), ("time", pa.float64()), ("data", pa.binary())]))
        return pa.array(out, kind)

    return media.withColumn(into, F.arrow_udf(parsed, "array<struct<serial: bigint, number: int, time: double, data: binary>>")(column))


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}
_STREAMS = pa.list_(pa.struct([(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in STREAM.split(", "))]))

_OPUS = b"OpusHead\x01\x01" + struct.pack("<HIhB", 312, 48_000, 0, 0)
_TAGS = b"OpusTags" + struct.pack("<II", 0, 0)
_VORBIS = b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 1, 8_000, 0, 0, 0, 0xB8) + b"\x01"


def document_container(text: str, note: str) -> bytes:
    """One document: each line a packet of 20 ms in an Opus-like stream, the note one of 1 s in a Vorbis-like one."""
    lines = [(line.encode(), 960 * (k + 1)) for k, line in enumerate(text.split("\n"))]
    notes = [(_VORBIS, 0), (b"\x03vorbis", 0), (b"\x05vorbis", 0), (note.encode(), 8_000)]
    return mux([(1, [(_OPUS, 0), (_TAGS, 0), *lines]), (2, notes)])


def from_documents(docs: DataFrame, into: str = "media") -> DataFrame:
    """docs(text, lang, source) with a container of each document; NULL for a NULL text."""

    def muxed(texts: pa.Array, notes: pa.Array) -> pa.Array:
        both = zip(texts.to_pylist(), notes.to_pylist(), strict=True)
        return pa.array([None if t is None else document_container(t, n) for t, n in both], pa.binary())

    [into] = _run.fresh(docs, into)
    note = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")))
    return _run.text_batches(docs).withColumn(into, F.arrow_udf(muxed, "binary")("text", note))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    media = from_documents(docs).select("doc_id", "media")
    return demux(media).select("doc_id", F.explode("streams").alias("s")).select("doc_id", "s.*")


SQL = """
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines, coalesce(lang, '') || '/' || coalesce(source, '') AS note
  FROM documents WHERE text IS NOT NULL),
p AS (
  SELECT doc_id, text, note, len(lines) AS n,
         list_sum(list_transform(lines, lambda x: octet_length(encode(x)) // 255 + 1)) AS segments,
         octet_length(encode(note)) // 255 + 1 AS note_segments
  FROM d)
SELECT doc_id, 1::BIGINT AS serial, 'opus' AS codec, 48000::INTEGER AS rate, (1 + (1 + segments + 254) // 255)::INTEGER AS pages,
       n::INTEGER AS packets, 0::INTEGER AS bad_pages,
       0::INTEGER AS lost_pages, 0::INTEGER AS broken_packets, (octet_length(encode(text)) - n + 1)::BIGINT AS bytes,
       md5(replace(text, chr(10), '')) AS md5, round((960 - 312) / 48000, 6) AS first_time, round((960 * n - 312) / 48000, 6) AS last_time,
       list_transform(range(1, n + 1), lambda k: round((960 * k - 312) / 48000, 6)) AS times, true AS ended
FROM p
UNION ALL
SELECT doc_id, 2::BIGINT, 'vorbis', 8000::INTEGER, (1 + (2 + note_segments + 254) // 255)::INTEGER, 1::INTEGER, 0::INTEGER, 0::INTEGER, 0::INTEGER,
       octet_length(encode(note))::BIGINT, md5(note), 1.0, 1.0, [1.0::DOUBLE], true
FROM p
"""
