"""ZIP directory parsing: end record, ZIP64 records, central directory, member offsets."""

from __future__ import annotations

import struct
from typing import NamedTuple

# Fixed values of the ZIP format.
END = b"PK\x05\x06"
END64_LOCATOR = b"PK\x06\x07"
END64 = b"PK\x06\x06"
CENTRAL = b"PK\x01\x02"
LOCAL = b"PK\x03\x04"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
STORED = 0


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored_size: int
    header: int  # offset of the local header


class BadArchive(ValueError):
    pass


def directory_place(read, size: int) -> tuple[int, int, int]:
    """(offset, length, entries) of the central directory; ``read(offset, length)`` reads a range."""
    tail_at = max(0, size - 22 - MAX16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadArchive("no end of central directory")
    entries, length, offset = struct.unpack("<HII", tail[at + 10:at + 20])
    if entries == MAX16 or length == MAX32 or offset == MAX32:
        locator_at = tail_at + at - 20
        locator = read(locator_at, 20) if locator_at >= 0 else b""
        if locator[:4] != END64_LOCATOR:
            raise BadArchive("no ZIP64 locator")
        record = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != END64:
            raise BadArchive("no ZIP64 end record")
        entries, length, offset = struct.unpack("<QQQ", record[32:56])
    return offset, length, entries


def members(read, size: int) -> list[Member]:
    """All members of an archive, from its (ZIP64) central directory."""
    offset, length, entries = directory_place(read, size)
    raw, at, out = read(offset, length), 0, []
    for _ in range(entries):
        if raw[at:at + 4] != CENTRAL:
            raise BadArchive("bad central directory entry")
        flags, method = struct.unpack("<HH", raw[at + 8:at + 12])
        stored, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[at + 20:at + 34])
        header = int.from_bytes(raw[at + 42:at + 46], "little")
        name = raw[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e:e + 4])
            if kind == 1:  # ZIP64 fields, present in this order where the 32-bit field is full
                body, b = extra[e + 4:e + 4 + n], 0
                if plain == MAX32:
                    plain, b = int.from_bytes(body[b:b + 8], "little"), b + 8
                if stored == MAX32:
                    stored, b = int.from_bytes(body[b:b + 8], "little"), b + 8
                if header == MAX32:
                    header, b = int.from_bytes(body[b:b + 8], "little"), b + 8
            e += 4 + n
        out.append(Member(name, method, plain, stored, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(read, member: Member) -> int:
    """Where a member's bytes start (its local header has fields of its own length)."""
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise BadArchive(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member.header + 30 + n_name + n_extra
