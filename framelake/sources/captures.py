"""Capture files as frames: (source, frame_id, timestamp_ns, link_type, interface_id, data).

Files are read with Spark's own binary reader, wherever they are stored, one task a file; the
`capture` data source reads files on a mounted folder without loading them whole, splits PCAP and
PCAPNG files at block boundaries that a pass over their headers finds, and streams.

A fault ends a file, or, where the format has a mark to look for, what stands before the next mark;
read with faults it is a row of its own, with its text in `error` and no data.
"""

from __future__ import annotations

import io
import os
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "frame_id bigint, timestamp_ns bigint, link_type int, interface_id int, data binary"
Frame = tuple[int, int, int, bytes]  # time, link type, interface, bytes
LINK_ETHERNET, LINK_SOCKETCAN, LINK_LIN, LINK_FLEXRAY = 1, 227, 212, 210


class CaptureError(ValueError):
    pass


def _exactly(f: BinaryIO, n: int) -> bytes | None:
    data = f.read(n)
    if len(data) < n:
        if data:
            raise CaptureError("cut off")
        return None
    return data


ORDERS = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1)}


def _pcap_head(f: BinaryIO) -> tuple[str, int, int] | None:
    """(byte order, nanoseconds of a unit, link type)"""
    head = _exactly(f, 24)
    if head is None:
        return None
    if head[:4] not in ORDERS:
        raise CaptureError("not a pcap file")
    order, unit = ORDERS[head[:4]]
    return order, unit, struct.unpack(order + "I", head[20:])[0] & 0xFFFF


def pcap(f: BinaryIO, state: tuple | None = None, stop: int | None = None) -> Iterator[Frame]:
    """state: the head, for a part of a file from where f stands up to the place `stop`."""
    state = state or _pcap_head(f)
    if state is None:
        return
    order, unit, link = state
    while (stop is None or f.tell() < stop) and (h := _exactly(f, 16)) is not None:
        seconds, part, size, _ = struct.unpack(order + "IIII", h)
        data = _exactly(f, size) if size else b""
        if data is None:
            raise CaptureError("cut off")
        yield seconds * 10**9 + part * unit, link, 0, data


def _interface(order: str, body: bytes) -> tuple[int, int, int]:
    """(link type, units a second, seconds to add) of an interface block."""
    link, at, res, off = struct.unpack(order + "H", body[:2])[0], 8, 10**6, 0
    while at + 4 <= len(body) - 4:
        code, n = struct.unpack(order + "HH", body[at : at + 4])
        value = body[at + 4 : at + 4 + n]
        if code == 0:
            break
        if code == 9 and n:
            res = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
        if code == 14 and n == 8:
            (off,) = struct.unpack(order + "q", value)
        at += 4 + n + -n % 4
    return link, res, off


def pcapng(f: BinaryIO, state: tuple | None = None, stop: int | None = None) -> Iterator[Frame]:
    """state: byte order and interfaces, as in pcap()."""
    order, faces = (state[0], list(state[1])) if state else ("<", [])
    while (stop is None or f.tell() < stop) and (h := _exactly(f, 8)) is not None:
        if h[:4] == b"\x0a\x0d\x0d\x0a":
            order, faces = _section(f, h), []
            continue
        kind, size = struct.unpack(order + "II", h)
        if size < 12 or size % 4:
            raise CaptureError("bad block")
        body = _exactly(f, size - 8)
        if body is None:
            raise CaptureError("cut off")
        if kind == 1:
            faces.append(_interface(order, body))
        elif kind == 6:
            face, high, low, n = struct.unpack(order + "IIII", body[:16])
            if face >= len(faces):
                raise CaptureError("no such interface")
            link, res, off = faces[face]
            yield (high << 32 | low) * 10**9 // res + off * 10**9, link, face, body[20 : 20 + n]
        elif kind == 3 and faces:
            (n,) = struct.unpack(order + "I", body[:4])
            yield 0, faces[0][0], 0, body[4 : 4 + min(n, len(body) - 8)]


def _section(f: BinaryIO, head: bytes) -> str:
    """The byte order of a section, whose head is passed over."""
    magic = _exactly(f, 4)
    order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
    (size,) = struct.unpack(order + "I", head[4:])
    if size < 28 or _exactly(f, size - 12) is None:
        raise CaptureError("bad section")
    return order


Split = tuple[int, int, int, tuple]  # start, stop, number of the first frame, state


def splits(f: BinaryIO, kind: str, size: int) -> list[Split]:
    """Parts of a PCAP or PCAPNG file of about `size` bytes, whole blocks each. Only headers are read; a fault ends the last part, whose reader meets it again."""
    f.seek(0, os.SEEK_END)
    end = f.tell()
    f.seek(0)
    out: list[Split] = []
    state = _pcap_head(f) if kind == "pcap" else ("<", ())
    if state is None:
        return []
    start, first, n = f.tell(), 0, 0
    opened = state
    while f.tell() < end:
        at = f.tell()
        if at - start >= size:
            out.append((start, at, first, opened))
            start, first, opened = at, n, state
        h = f.read(16 if kind == "pcap" else 8)
        if len(h) < (16 if kind == "pcap" else 8):
            break
        if kind == "pcap":
            f.seek(struct.unpack(state[0] + "I", h[8:12])[0], os.SEEK_CUR)
            n += 1
            continue
        if h[:4] == b"\x0a\x0d\x0d\x0a":
            try:
                state = (_section(f, h), ())
            except CaptureError:
                break
            continue
        block, length = struct.unpack(state[0] + "II", h)
        if length < 12 or length % 4:
            break
        if block == 1:
            body = f.read(length - 8)
            if len(body) < length - 8:
                break
            state = (state[0], (*state[1], _interface(state[0], body)))
        else:
            f.seek(length - 8, os.SEEK_CUR)
            n += block == 6 or (block == 3 and bool(state[1]))
    out.append((start, end, first, opened))
    return out


def _can(ident: int, data: bytes) -> bytes:
    return struct.pack(">IB3x", ident, len(data)) + data


def can_fd(ident: int, data: bytes, brs: bool, esi: bool) -> bytes:
    """A SocketCAN frame with the FD bit beside its length."""
    return struct.pack(">IBB2x", ident, len(data), 4 | brs | esi << 1) + data


def lin_frame(ident: int, data: bytes, checksum: int | None = None, model: int = 2) -> bytes:
    """A LIN frame with its protected id; the checksum is the enhanced one where none is given. model: 1 classic, 2 enhanced, 0 not said."""
    from framelake.dissect.app import lin_checksum, lin_parity

    pid = ident & 63 | lin_parity(ident & 63) << 6
    return struct.pack(">B3xBBBB", 1, len(data) << 4 | model, pid, lin_checksum(data, pid) if checksum is None else checksum, 0) + data


def flexray_frame(ident: int, cycle: int, crc: int, data: bytes, b: bool = False) -> bytes:
    """Channel, no errors, the five bytes of the bus header and the payload."""
    words = (len(data) + 1) // 2
    head = 1 << 37 | (ident & 0x7FF) << 24 | words << 17 | (crc & 0x7FF) << 6 | cycle & 63
    return struct.pack(">BB", 128 if b else 0, 0) + head.to_bytes(5, "big") + data.ljust(2 * words, b"\0")


def blf(f: BinaryIO, most: int = 1 << 28, resumed: bool = False) -> Iterator[Frame]:
    """CAN, CAN FD, LIN, FlexRay and Ethernet objects, in containers or plain. most: bytes that a container may unpack to; resumed: f stands at an object."""
    if not resumed:
        head = _exactly(f, 8)
        if head is None:
            return
        if head[:4] != b"LOGG":
            raise CaptureError("not a BLF file")
        _exactly(f, struct.unpack("<I", head[4:])[0] - 8)
    rest = b""

    def objects(data: bytes) -> tuple[list[Frame], bytes]:
        out, at = [], 0
        while at + 16 <= len(data):
            if data[at : at + 4] != b"LOBJ":
                at += 1
                continue
            hsize, _, size, kind = struct.unpack("<HHII", data[at + 4 : at + 16])
            if at + size > len(data):
                break
            if hsize >= 32 and kind in (1, 86, 100, 101, 71, 11, 50):
                flags, _, _, stamp = struct.unpack("<IHHQ", data[at + 16 : at + 32])
                time = stamp * 10_000 if flags == 1 else stamp
                body = data[at + hsize : at + size]
                if kind == 71:
                    src, channel, dst, _, etype, tpid, tci, n = struct.unpack("<6sH6sHHHHH", body[:24])
                    tag = struct.pack(">HH", tpid, tci) if tpid else b""
                    out.append((time, LINK_ETHERNET, channel, dst + src + tag + struct.pack(">H", etype) + body[32 : 32 + n]))
                elif kind == 11:  # LIN: channel, id, length, then the bytes
                    channel, ident, n = struct.unpack("<HBB", body[:4])
                    out.append((time, LINK_LIN, channel, lin_frame(ident, body[4 : 4 + min(n, 8)])))
                elif kind == 50:  # FlexRay: channel, .., frame id, header CRC, .., cycle, .., length, .., bytes
                    channel, mask, _, _, _, ident, crc, size, n, cycle = struct.unpack("<HBBIIHHHHB", body[:21])
                    out.append((time, LINK_FLEXRAY, channel, flexray_frame(ident, cycle, crc, body[40 : 40 + min(n, 254)], mask == 2)))
                elif kind == 101:
                    channel, _, n, _, ident, _, bits = struct.unpack("<BBBBIII", body[:16])
                    value = body[40 : 40 + n]
                    out.append((time, LINK_SOCKETCAN, channel, can_fd(ident, value, bool(bits & 0x2000), bool(bits & 0x4000)) if bits & 0x1000 else _can(ident | (0x40000000 if bits & 0x10 else 0), value)))
                elif kind == 100:
                    channel, flags_, _, ident, _, _, bits, n = struct.unpack("<HBBIIBBB", body[:15])
                    value = body[20 : 20 + n]
                    out.append((time, LINK_SOCKETCAN, channel, can_fd(ident, value, bool(bits & 2), bool(bits & 4)) if bits & 1 else _can(ident | (0x40000000 if flags_ & 0x80 else 0), value)))
                else:
                    channel, flags_, dlc, ident = struct.unpack("<HBBI", body[:8])
                    out.append((time, LINK_SOCKETCAN, channel, _can(ident | (0x40000000 if flags_ & 0x80 else 0), body[8 : 8 + min(dlc, 8)])))
            at += size + size % 4
        return out, data[at:]

    while (h := _exactly(f, 16)) is not None:
        if h[:4] != b"LOBJ":
            raise CaptureError("bad object")
        if struct.unpack("<I", h[8:12])[0] < 16:
            raise CaptureError("bad length")
        hsize, _, size, kind = struct.unpack("<HHII", h[4:])
        body = f.read(size - 16)
        f.read(size % 4)
        if kind == 10:
            method, unpacked = struct.unpack("<H6xI", body[:12])
            if unpacked > most:
                raise CaptureError("container too large")
            data = body[16:]
            rest += zlib.decompressobj().decompress(data, most) if method == 2 else data
            frames, rest = objects(rest)
            yield from frames
        else:
            yield from objects(h + body)[0]


def _nanos(stamp: str) -> int:
    whole, _, part = stamp.partition(".")
    return int(whole) * 10**9 + int((part + "0" * 9)[:9])


def _ident(shown: str, radix: int) -> int:
    """An x at the end marks a long identifier."""
    return int(shown.rstrip("xX"), radix) | (0x80000000 if shown[-1] in "xX" else 0)


_LIN_SUM = re.compile(r"checksum\s*[=:]\s*([0-9a-f]+)", re.IGNORECASE)
_LIN_MODEL = re.compile(r"CSM\s*[=:]\s*(classic|enhanced)", re.IGNORECASE)
_BUS = re.compile(r"Li|L[0-9]+|Fr|ETH|AFDX", re.IGNORECASE)


def _numbers(words: list[str], radix: int, most: int) -> bytes:
    """The bytes at the start of words, as far as they are bytes."""
    out = bytearray()
    for w in words[:most]:
        try:
            value = int(w, radix)
        except ValueError:
            break
        if not 0 <= value <= 255:
            break
        out.append(value)
    return bytes(out)


def _asc_lin(words: list[str], radix: int) -> tuple[int, int, bytes]:
    """After the time: channel, id, direction if there is one, length, bytes, then named values."""
    channel = 1 if words[0].lower() == "li" else int(words[0][1:])
    ident, at = int(words[1], radix), 3 if words[2].lower() in ("rx", "tx", "txrq", "slave", "master") else 2
    size = int(words[at], radix)
    if not 0 <= ident <= 63 or not 0 <= size <= 8 or (channel < 2 and words[0].lower() != "li") or channel > 255:
        raise ValueError("not a LIN line")
    tail = " ".join(words[at + 1 :])
    told, model = _LIN_SUM.search(tail), _LIN_MODEL.search(tail)
    kind = {"classic": 1, "enhanced": 2}[model[1].lower()] if model else 0
    return LINK_LIN, channel, lin_frame(ident, _numbers(words[at + 1 :], radix, size), int(told[1], radix) & 255 if told else 0, kind)


def _asc_flexray(words: list[str], radix: int) -> tuple[int, int, bytes]:
    """RMSG or PDU: cluster, client, channel, mask, slot, cycle, direction, four values, header CRC, name, length, logged length,
    bytes. Before: channel, version, slot, cycle, two flags, header CRC, name, length, bytes."""
    if words[1].upper() in ("RMSG", "PDU"):
        channel, mask, slot, cycle = (int(w, radix) for w in words[4:8])
        crc, size, logged, data = int(words[13], radix), int(words[15], radix), int(words[16], radix), words[17:]
        if mask not in (1, 2, 3) or logged > size or words[8].lower() not in ("rx", "tx"):
            raise ValueError("not a FlexRay line")
        value = _numbers(data, radix, logged)
        if len(value) < logged:
            raise ValueError("bytes are missing")
        value, second = value.ljust(size, b"\0"), mask != 1
    else:
        shown = words[1].upper()
        second = shown == "B" or shown == "2"
        channel = "AB".index(shown) + 1 if shown in ("A", "B") else int(shown, radix)
        slot, cycle, crc, size = (int(words[i], radix) for i in (3, 4, 7, 9))
        value = _numbers(words[10:], radix, size)
    if not (0 <= slot < 2048 and 0 <= cycle < 64 and 0 <= size <= 254):
        raise ValueError("not a FlexRay line")
    return LINK_FLEXRAY, channel, flexray_frame(slot, cycle, crc, value, second)


def _asc_ethernet(words: list[str], radix: int) -> tuple[int, int, int, str]:
    """Link type, channel, length and the hex digits of the line; more of them may follow on lines of their own."""
    at = 6 if words[0].upper() == "AFDX" else 3
    if words[2].lower() not in ("rx", "tx", "txrq", "txfwd"):
        raise ValueError("not a packet")
    size, colon, digits = "".join(words[at:]).partition(":")
    if not colon or not 0 <= int(size, radix) <= 1518 or not set(digits) <= set(string.hexdigits):
        raise ValueError("not a packet")
    return LINK_ETHERNET, int(words[1]), int(size, radix), digits


def asc(f: BinaryIO) -> Iterator[Frame]:
    """Lines of CAN, CAN FD, LIN, FlexRay and Ethernet messages. Times are absolute, or since the line before. Other lines, and such as break their form, are left out."""
    relative, radix, now = False, 16, 0
    begun: tuple[int, int, int, str] | None = None  # a packet whose digits go on: time, channel, length, digits
    for line in io.TextIOWrapper(f, "utf-8", "replace"):
        words = line.split()
        if not words:
            continue
        if begun:
            if all(c in string.hexdigits for w in words for c in w):
                begun = (*begun[:3], begun[3] + "".join(words))
                if len(begun[3]) >= 2 * begun[2]:
                    yield begun[0], LINK_ETHERNET, begun[1], bytes.fromhex(begun[3][: 2 * begun[2]])
                    begun = None
                continue
            begun = None
        if words[0].lower() == "base":
            radix = 16 if "hex" in line.lower() else 10
            relative = "relative" in line.lower()
            continue
        if len(words) >= 5 and words[0][0].isdigit() and _BUS.fullmatch(words[1]):
            try:
                stamp, bus = _nanos(words[0]), words[1].lower()
                if bus in ("eth", "afdx"):
                    link, channel, size, digits = _asc_ethernet(words[1:], radix)
                    value = bytes.fromhex(digits[: 2 * size]) if len(digits) >= 2 * size else None
                else:
                    link, channel, value = (_asc_flexray if bus == "fr" else _asc_lin)(words[1:], radix)
            except (ValueError, IndexError):
                continue
            now = now + stamp if relative else stamp
            if value is None:
                begun = (now, channel, size, digits)
            else:
                yield now, link, channel, value
            continue
        if len(words) >= 9 and words[0][0].isdigit() and words[1].upper() == "CANFD" and words[2].isdigit():
            # channel, direction, id, a name or none, two flags, the length's code, the length, bytes
            rest = words[5:] if words[5] in ("0", "1") and words[6] in ("0", "1") else words[6:]
            if len(rest) < 4 or not rest[3].isdigit():
                continue
            stamp = _nanos(words[0])
            now = now + stamp if relative else stamp
            yield now, LINK_SOCKETCAN, int(words[2]), can_fd(_ident(words[4], radix), bytes(int(w, radix) for w in rest[4 : 4 + int(rest[3])]), rest[0] == "1", rest[1] == "1")
            continue
        if len(words) < 6 or not words[0][0].isdigit() or words[4].lower() not in ("d", "r") or not words[1].isdigit():
            continue
        stamp = _nanos(words[0])
        now = now + stamp if relative else stamp
        number = _ident(words[2], radix)
        n = int(words[5], 16) if words[4].lower() == "d" else 0
        yield now, LINK_SOCKETCAN, int(words[1]), _can(number | (0x40000000 if words[4].lower() == "r" else 0), bytes(int(w, radix) for w in words[6 : 6 + n]))


FORMATS: dict[str, Callable[[BinaryIO], Iterator[Frame]]] = {"pcap": pcap, "pcapng": pcapng, "blf": blf, "asc": asc}


def detect(head: bytes) -> str:
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        return "pcapng"
    if head[:4] in (b"\xa1\xb2\xc3\xd4", b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\x3c\x4d", b"\x4d\x3c\xb2\xa1"):
        return "pcap"
    if head[:4] == b"LOGG":
        return "blf"
    return "asc"


def parse(data: BinaryIO, kind: str | None = None, tolerant: bool = True, on_fault: Callable[[str], None] | None = None, **part: object) -> Iterator[Frame]:
    """tolerant: what follows a fault is left out, up to the next mark of an object in BLF files, and on_fault is told; else the fault is raised. part: state and stop, for a part of a file."""
    if kind is None:
        head = data.read(4)
        kind = detect(head)
        data.seek(0)
    while True:
        try:
            yield from FORMATS[kind](data, **part)
            return
        except (CaptureError, struct.error, zlib.error, ValueError) as e:
            if not tolerant:
                raise
            if on_fault:
                on_fault(f"{kind}: {e}" + ("" if data.closed else f" (before byte {data.tell()})"))
            if kind != "blf" or data.closed or not _next_object(data):
                return
            part = {"resumed": True}


def _next_object(f: BinaryIO, chunk: int = 1 << 16) -> bool:
    """Puts f at the next mark of an object, if there is one."""
    kept = b""
    while block := f.read(chunk):
        both = kept + block
        at = both.find(b"LOBJ")
        if at >= 0:
            f.seek(at - len(both), os.SEEK_CUR)
            return True
        kept = both[-3:]
    return False


def _numbered(f: BinaryIO, kind: str | None, tolerant: bool, faults: bool, first: int = 0, **part: object) -> Iterator[tuple]:
    """(frame_id, time, link type, interface, data) and, with faults, error; a fault is a row without data."""
    met: list[str] = []
    n = first
    for frame in parse(f, kind, tolerant, met.append, **part):
        for text in met if faults else ():
            yield n, 0, -1, 0, None, text
        met.clear()
        yield (n, *frame, None) if faults else (n, *frame)
        n += 1
    for text in met if faults else ():
        yield n, 0, -1, 0, None, text


def read_captures(spark: SparkSession, path: str, kind: str | None = None, tolerant: bool = True, faults: bool = False) -> DataFrame:
    """(source, SCHEMA and, with faults, error) of the files of a path; frame ids count from 0 in each."""
    columns = [*_COLUMNS, "error"] if faults else _COLUMNS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for row in _numbered(io.BytesIO(content), kind, tolerant, faults):
                    rows.append((path, *row))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"source string, {SCHEMA}" + (", error string" if faults else ""))


_COLUMNS = ["source", "frame_id", "timestamp_ns", "link_type", "interface_id", "data"]


class _File(InputPartition):
    def __init__(self, path: str, kind: str | None, split: Split | None = None) -> None:
        super().__init__(path)
        self.path, self.kind, self.split = path, kind, split


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import glob

        most, out = int(self.options.get("splitBytes", 1 << 27)), []
        for path in sorted(glob.glob(self.options["path"])):
            with open(path, "rb") as f:
                kind = self.options.get("format") or detect(f.read(4))
                if kind in ("pcap", "pcapng") and os.path.getsize(path) > most:
                    out += [_File(path, kind, s) for s in splits(f, kind, most)]
                else:
                    out.append(_File(path, kind))
        return out

    def read(self, partition: _File):
        tolerant, faults = self.options.get("mode", "PERMISSIVE").upper() == "PERMISSIVE", self.options.get("faults", "false").lower() == "true"
        with open(partition.path, "rb") as f:
            part: dict = {}
            first = 0
            if partition.split:
                start, stop, first, state = partition.split
                f.seek(start)
                part = {"state": state, "stop": stop}
            for row in _numbered(f, partition.kind, tolerant, faults, first, **part):
                yield (partition.path, *row)


class _Stream(SimpleDataSourceStreamReader):
    """Files in the order of their names; an offset is the number of files read."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"files": 0}

    def _rows(self, start: int, stop: int | None) -> tuple[Iterator[tuple], int]:
        parts = _Reader({**self.options, "splitBytes": str(1 << 62)}).partitions()[start:stop]
        return (row for p in parts for row in _Reader(self.options).read(p)), start + len(parts)

    def read(self, start: dict):
        rows, end = self._rows(start["files"], start["files"] + int(self.options.get("maxFilesPerTrigger", 16)))
        return rows, {"files": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._rows(start["files"], end["files"])[0]


class CaptureSource(DataSource):
    """spark.dataSource.register(CaptureSource); spark.read.format("capture").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return f"source string, {SCHEMA}" + (", error string" if self.options.get("faults", "false").lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)
