"""Where the first message of a stream's buffer ends, for `reassembly.messages`.

Each returns the length of the first message, None if the buffer has to grow, or 0 if no message
starts here, so that the stream goes on at the next byte.
"""

from __future__ import annotations

MOST_HEAD = 1 << 16
STARTS = (b"GET ", b"POST ", b"PUT ", b"HEAD ", b"DELETE ", b"OPTIONS ", b"PATCH ", b"TRACE ", b"CONNECT ", b"HTTP/1.")
PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"


def tls_record(buffer: bytes) -> int | None:
    if not 20 <= buffer[0] <= 24 or buffer[1:2] not in (b"", b"\x03"):
        return 0
    return None if len(buffer) < 5 else 5 + int.from_bytes(buffer[3:5], "big")


def http2_frame(buffer: bytes) -> int | None:
    """The preface counts as a message."""
    if buffer[:24] == PREFACE[: len(buffer)]:
        return 24 if len(buffer) >= 24 else None
    return None if len(buffer) < 9 else 9 + int.from_bytes(buffer[:3], "big")


def http1(buffer: bytes) -> int | None:
    """A head with what it announces: chunks, a length, or nothing. A body that only the connection's end closes isn't counted."""
    if not any(s.startswith(buffer[: len(s)]) for s in STARTS):
        return 0
    end = buffer.find(b"\r\n\r\n", 0, MOST_HEAD)
    if end < 0:
        return None if len(buffer) < MOST_HEAD else 0
    first, *lines = buffer[:end].split(b"\r\n")
    fields = {}
    for line in lines:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().lower()
    at = end + 4
    if first.startswith(b"HTTP/1.") and first.split(b" ")[1:2] and (first.split(b" ")[1][:1] == b"1" or first.split(b" ")[1] in (b"204", b"304")):
        return at
    if fields.get(b"transfer-encoding", b"").endswith(b"chunked"):
        return _chunks(buffer, at)
    size = fields.get(b"content-length", b"0")
    return at + int(size) if size.isdigit() else 0


def _chunks(buffer: bytes, at: int) -> int | None:
    while True:
        stop = buffer.find(b"\r\n", at)
        if stop < 0:
            return None
        try:
            size = int(buffer[at:stop].split(b";")[0], 16)
        except ValueError:
            return 0
        if size == 0:  # trailers, up to an empty line
            close = stop if buffer[stop + 2 : stop + 4] == b"\r\n" else buffer.find(b"\r\n\r\n", stop)
            return None if close < 0 or len(buffer) < stop + 4 else close + 4
        at = stop + 2 + size + 2
        if at > len(buffer):
            return None
