"""Header compression of HTTP/2 (RFC 7541): header blocks to names and values.

The dynamic table belongs to one direction of one connection, so that blocks are decoded in order
within it: rows are dealt by connection, sorted in their partition and streamed through, with one
table held at a time. A connection never has to fit in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.dissect.app import Malformed

# The static table of RFC 7541, appendix A, from index 1.
STATIC = [
    (":authority", ""),
    (":method", "GET"),
    (":method", "POST"),
    (":path", "/"),
    (":path", "/index.html"),
    (":scheme", "http"),
    (":scheme", "https"),
    (":status", "200"),
    (":status", "204"),
    (":status", "206"),
    (":status", "304"),
    (":status", "400"),
    (":status", "404"),
    (":status", "500"),
    ("accept-charset", ""),
    ("accept-encoding", "gzip, deflate"),
    ("accept-language", ""),
    ("accept-ranges", ""),
    ("accept", ""),
    ("access-control-allow-origin", ""),
    ("age", ""),
    ("allow", ""),
    ("authorization", ""),
    ("cache-control", ""),
    ("content-disposition", ""),
    ("content-encoding", ""),
    ("content-language", ""),
    ("content-length", ""),
    ("content-location", ""),
    ("content-range", ""),
    ("content-type", ""),
    ("cookie", ""),
    ("date", ""),
    ("etag", ""),
    ("expect", ""),
    ("expires", ""),
    ("from", ""),
    ("host", ""),
    ("if-match", ""),
    ("if-modified-since", ""),
    ("if-none-match", ""),
    ("if-range", ""),
    ("if-unmodified-since", ""),
    ("last-modified", ""),
    ("link", ""),
    ("location", ""),
    ("max-forwards", ""),
    ("proxy-authenticate", ""),
    ("proxy-authorization", ""),
    ("range", ""),
    ("referer", ""),
    ("refresh", ""),
    ("retry-after", ""),
    ("server", ""),
    ("set-cookie", ""),
    ("strict-transport-security", ""),
    ("transfer-encoding", ""),
    ("user-agent", ""),
    ("vary", ""),
    ("via", ""),
    ("www-authenticate", ""),
]

# Lengths of the Huffman codes of RFC 7541, appendix B. ASCII symbols that are shown, by
# length; of the others the numbers. The code is canonical: codes ascend by length, then by symbol.
_SHOWN = {5: "012aceiost", 6: " %-./3456789=A_bdfghlmnpru", 7: ":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz", 8: "&*,;XZ", 10: "!\"()?", 11: "'+|", 12: "#>", 13: "$@[]~", 14: "^}", 15: "<`{", 19: "\\"}
_OTHERS = {
    13: (0,),
    19: (195, 208),
    20: (128, 130, 131, 162, 184, 194, 224, 226),
    21: (153, 161, 167, 172, 176, 177, 179, 209, 216, 217, 227, 229, 230),
    22: (129, 132, 133, 134, 136, 146, 154, 156, 160, 163, 164, 169, 170, 173, 178, 181, 185, 186, 187, 189, 190, 196, 198, 228, 232, 233),
    23: (1, 135, 137, 138, 139, 140, 141, 143, 147, 149, 150, 151, 152, 155, 157, 158, 165, 166, 168, 174, 175, 180, 182, 183, 188, 191, 197, 231, 239),
    24: (9, 142, 144, 145, 148, 159, 171, 206, 215, 225, 236, 237),
    25: (199, 207, 234, 235),
    26: (192, 193, 200, 201, 202, 205, 210, 213, 218, 219, 238, 240, 242, 243, 255),
    27: (203, 204, 211, 212, 214, 221, 222, 223, 241, 244, 245, 246, 247, 248, 250, 251, 252, 253, 254),
    28: (2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 23, 24, 25, 26, 27, 28, 29, 30, 31, 127, 220, 249),
    30: (10, 13, 22, 256),
}
END = 256


def _codes() -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    lengths = {ord(c): n for n, shown in _SHOWN.items() for c in shown} | {s: n for n, others in _OTHERS.items() for s in others}
    out, code, before = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        out[n, code] = symbol
        code, before = code + 1, n
    return out


CODES = _codes()


def unhuffman(data: bytes) -> bytes:
    out, code, n = bytearray(), 0, 0
    for byte in data:
        for k in range(7, -1, -1):
            code, n = code << 1 | byte >> k & 1, n + 1
            symbol = CODES.get((n, code))
            if symbol is not None:
                if symbol == END:
                    raise Malformed("end of string inside a string")
                out.append(symbol)
                code = n = 0
            elif n > 30:
                raise Malformed("no such code")
    if n > 7 or code != (1 << n) - 1:
        raise Malformed("bad padding")
    return bytes(out)


class Decoder:
    """One direction of one connection. limit: what the settings allow the table to hold."""

    def __init__(self, limit: int = 4096) -> None:
        self.limit = self.most = limit
        self.size, self.table = 0, deque()

    def _evict(self) -> None:
        while self.size > self.most:
            name, value = self.table.pop()
            self.size -= len(name) + len(value) + 32

    def _number(self, data: bytes, at: int, bits: int) -> tuple[int, int]:
        if at >= len(data):
            raise Malformed("too short")
        top = (1 << bits) - 1
        value, at, shift = data[at] & top, at + 1, 0
        if value < top:
            return value, at
        while True:
            if at >= len(data) or shift > 56:
                raise Malformed("bad number")
            value += (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    def _text(self, data: bytes, at: int) -> tuple[bytes, int]:
        coded = at < len(data) and data[at] >= 128
        n, at = self._number(data, at, 7)
        if at + n > len(data):
            raise Malformed("too short")
        return unhuffman(data[at : at + n]) if coded else data[at : at + n], at + n

    def _entry(self, index: int) -> tuple[bytes, bytes]:
        if 1 <= index <= len(STATIC):
            return STATIC[index - 1][0].encode(), STATIC[index - 1][1].encode()
        if 0 <= index - len(STATIC) - 1 < len(self.table):
            return self.table[index - len(STATIC) - 1]
        raise Malformed("no such entry")

    def decode(self, block: bytes) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(block):
            first = block[at]
            if 32 <= first < 64:
                self.most, at = self._number(block, at, 5)
                if self.most > self.limit:
                    raise Malformed("table too large")
                self._evict()
                continue
            if first >= 128:
                index, at = self._number(block, at, 7)
                name, value = self._entry(index)
            else:
                index, at = self._number(block, at, 6 if first >= 64 else 4)
                name, at = (self._entry(index)[0], at) if index else self._text(block, at)
                value, at = self._text(block, at)
                if first >= 64:
                    self.table.appendleft((name, value))
                    self.size += len(name) + len(value) + 32
                    self._evict()
            out.append((name.decode("utf-8", "replace"), value.decode("utf-8", "replace")))
        return out


def fragment(kind: int, flags: int, body: bytes) -> bytes:
    """The header block in a HEADERS (1), PUSH_PROMISE (5) or CONTINUATION (9) frame, without padding and priority."""
    start, stop = 0, len(body)
    if kind in (1, 5) and flags & 8:
        if not body:
            raise Malformed("too short")
        start, stop = 1, stop - body[0]
    start += 5 if kind == 1 and flags & 32 else 4 if kind == 5 else 0
    if start > stop:
        raise Malformed("bad padding")
    return body[start:stop]


def headers(frames: DataFrame, connection: str = "connection", order: str = "packet_id", limit: int = 4096) -> DataFrame:
    """(connection, order, stream_id, position, name, value, error) of frames (connection, order, stream_id, kind, flags, body).

    connection names one direction. A block is given at the frame that ends it. After a fault the
    table can't be known: the fault is given once, and the rest of its connection is left out.
    """
    types = dict(frames.dtypes)
    columns = [connection, order, "stream_id", "position", "name", "value", "error"]
    schema = f"`{connection}` {types[connection]}, `{order}` {types[order]}, stream_id long, position int, name string, value string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = run
        decoder, parts, failed = Decoder(limit), [], False
        for batch in batches:
            rows = []
            for conn, at, stream, kind, flags, body in zip(*[batch[c] for c in (connection, order, "stream_id", "kind", "flags", "body")], strict=True):
                if conn != now:
                    now, decoder, parts, failed = conn, Decoder(limit), [], False
                if failed:
                    continue
                try:
                    parts.append(fragment(kind, flags, bytes(body)))
                    if flags & 4:
                        rows += [(conn, at, stream, i, n, v, None) for i, (n, v) in enumerate(decoder.decode(b"".join(parts)))]
                        parts = []
                except Malformed as e:
                    failed = True
                    rows.append((conn, at, stream, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"position": "Int32"})

    blocks = frames.filter(F.col("kind").isin(1, 5, 9) & F.col(connection).isNotNull() & F.col("body").isNotNull())
    return blocks.repartition(F.col(connection)).sortWithinPartitions(connection, order).mapInPandas(run, schema)
