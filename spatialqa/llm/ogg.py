"""Ogg media columns: a writer, and a reader that proves each page and puts packets back.

A payload becomes ``STREAMS`` logical streams that share one file. Packets of ``PACKET``
samples (8 bits each) are dealt to the streams in turn. Each stream opens with a header
packet; the granule position of a page is the number of the file's samples up to the end of
the last packet that ends on it.
"""
from __future__ import annotations

import struct
import zlib
from typing import Callable, Iterator, NamedTuple

from pyspark.sql import DataFrame

from spatialqa.llm.common import add_columns, fields

PACKET, STREAMS, RATE = 4000, 2, 8000
#: Page layout: capture pattern, version, flags, granule position, serial, number, checksum, segments.
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NAME = struct.Struct("<8sIHH")
FLIPPED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, not reflected, from 0 and not inverted: zlib's with all bits mirrored."""
    mirrored = zlib.crc32(page.translate(FLIPPED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(FLIPPED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    value = checksum(head + body)
    return head[:22] + value.to_bytes(4, "little") + head[26:] + body


class Stream:
    """Writes the pages of one logical stream."""

    def __init__(self, serial: int) -> None:
        self.serial, self.number = serial, 0

    def packet(self, data: bytes, granule: int, flags: int = 0) -> bytes:
        """The pages of one packet: lacing values of 255 and one below it, at most 255 a page; -1 where no packet ends."""
        lacing = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        out, at, more = [], 0, 0
        while lacing:
            now, lacing = lacing[:255], lacing[255:]
            size = sum(now)
            last = flags & LAST if not lacing else 0
            out.append(page(flags & FIRST | last | more, granule if not lacing else -1, self.serial, self.number, now, data[at:at + size]))
            at, more, self.number = at + size, CONTINUED, self.number + 1
        return b"".join(out)


def write(payload: bytes, packet: int = PACKET, streams: int = STREAMS) -> bytes:
    """An Ogg file that holds ``payload`` without loss."""
    writers = [Stream(i + 1) for i in range(streams)]
    out = [w.packet(NAME.pack(b"samples8", RATE, streams, i), 0, FIRST) for i, w in enumerate(writers)]
    starts = range(0, len(payload), packet)
    ends = {i % streams: i for i in range(len(starts))}
    for i, start in enumerate(starts):
        stop = min(start + packet, len(payload))
        out.append(writers[i % streams].packet(payload[start:stop], stop, LAST if ends[i % streams] == i else 0))
    out += [writers[i].packet(b"", len(payload), LAST) for i in range(streams) if i not in ends]
    return b"".join(out)


class Packet(NamedTuple):
    serial: int
    first: int
    granule: int
    data: bytes


class Parsed(NamedTuple):
    packets: list[Packet]
    pages: int
    bad: int
    lost: int
    ended: int


def read(media: bytes) -> Parsed:
    """All packets of all logical streams, in the order of their ends in the file.

    A page with a wrong checksum counts as bad and is left out; a packet of which a page is
    missing counts as lost. Bytes that belong to no page are skipped.
    ``first`` is the granule position where a packet starts, ``granule`` where it ends.
    """
    packets: list[Packet] = []
    parts: dict[int, list[bytes] | None] = {}
    numbers: dict[int, int] = {}
    pages = bad = lost = ended = at = 0
    while (at := media.find(b"OggS", at)) >= 0:
        if at + HEAD.size > len(media):
            bad += 1
            break
        _, version, flags, granule, serial, number, value, segments = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size:at + HEAD.size + segments]
        start = at + HEAD.size + segments
        stop = start + sum(lacing)
        if version or stop > len(media) or checksum(b"".join((media[at:at + 22], b"\0\0\0\0", media[at + 26:stop]))) != value:
            bad, at = bad + 1, at + 4
            continue
        pages += 1
        gap = number != numbers.get(serial, -1) + 1
        numbers[serial] = number
        open_parts = parts.get(serial)
        if open_parts is not None and (gap or not flags & CONTINUED):
            lost, open_parts = lost + 1, None
        skip = bool(flags & CONTINUED) and open_parts is None  # its head is on a page that is missing
        whole: list[bytes] = []
        for size in lacing:
            if open_parts is None:
                open_parts = []
            open_parts.append(media[start:start + size])
            start += size
            if size < 255:
                if skip:
                    lost, skip = lost + 1, False
                else:
                    whole.append(b"".join(open_parts))
                open_parts = None
        parts[serial] = None if skip else open_parts
        end = granule
        for data in reversed(whole):  # a page tells where its last packet ends; those before end where the next starts
            samples = 0 if flags & FIRST else len(data)
            packets.append(Packet(serial, end - samples, end, data))
            end -= samples
        packets[len(packets) - len(whole):] = reversed(packets[len(packets) - len(whole):])
        ended += bool(flags & LAST)
        at = stop
    lost += sum(p is not None for p in parts.values())
    return Parsed(packets, pages, bad, lost, ended)


def payload(parsed: Parsed) -> bytes:
    """The samples of all streams in the order of their timestamps; header packets have none."""
    return b"".join(p.data for p in sorted((p for p in parsed.packets if p.granule > p.first), key=lambda p: (p.first, p.serial)))


def describe(parsed: Parsed) -> str:
    """Pages, bad pages, lost packets, and of each stream its serial, packets, bytes, first start and last end in seconds."""
    streams: dict[int, list] = {}
    for p in parsed.packets:
        s = streams.setdefault(p.serial, [0, 0, None, 0])
        s[0], s[1], s[3] = s[0] + 1, s[1] + len(p.data), max(s[3], p.granule)
        if p.granule > p.first:
            s[2] = p.first if s[2] is None else min(s[2], p.first)
    each = " ".join(f"{k}:{n},{b},{(f or 0) / RATE:.4f}-{e / RATE:.4f}" for k, (n, b, f, e) in sorted(streams.items()))
    return f"pages={parsed.pages} bad={parsed.bad} lost={parsed.lost} ended={parsed.ended} {each}".rstrip()


def add_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with an Ogg file that holds the UTF-8 bytes of ``text``, filled with bytes 0 to a positive multiple of 64.

    A null or empty text gives 64 bytes 0. Equal texts give equal files.
    """
    def start() -> Callable:
        def one(value: str | None) -> tuple[bytes]:
            data = (value or "").encode("utf-8", "replace")
            return (write(data + bytes(-len(data) % 64 if data else 64)),)
        return one

    return add_columns(df, start, [text], fields(f"{media} binary"))


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what the stored bytes hold: ``payload``, ``tail_crc32`` of its last 64 bytes, ``feature`` (see ``describe``).

    A null or empty file has an empty payload and no page; damaged pages are counted, never raised.
    """
    def start() -> Callable:
        def one(value: bytes | None) -> tuple:
            parsed = read(value or b"")
            data = payload(parsed)
            return data, zlib.crc32(data[-64:]), describe(parsed)
        return one

    return add_columns(df, start, [media], fields("payload binary,tail_crc32 long,feature string"))


def packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row for each packet: ``key``, serial, seconds of its start and end, its bytes."""
    from spatialqa.llm.common import flat_map
    from pyspark.sql.types import StructType

    def start() -> Callable[..., Iterator[tuple]]:
        return lambda k, value: ((k, p.serial, p.first / RATE, p.granule / RATE, p.data) for p in read(value or b"").packets)

    schema = StructType([df.schema[key], *fields("serial long,from_s double,to_s double,data binary").fields])
    return flat_map(df.select(key, media), start, schema)
