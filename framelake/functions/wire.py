"""Byte-level column functions: endian reads and writes, slices, bit fields, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(data: Column, offset: int | Column, width: int) -> Column:
    """The unsigned big-endian number of `width` bytes, null if they aren't all there; 8 bytes give a decimal."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(data, at + 1, F.lit(width))
    number = F.conv(F.hex(part), 16, 10)
    return F.when(F.octet_length(data) >= at + width, number.cast("decimal(20,0)" if width >= 8 else "bigint"))


def le(data: Column, offset: int | Column, width: int) -> Column:
    """The unsigned little-endian number of `width` bytes."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = F.concat(*[F.substring(data, at + 1 + i, F.lit(1)) for i in reversed(range(width))])
    return F.when(F.octet_length(data) >= at + width, F.conv(F.hex(part), 16, 10).cast("decimal(20,0)" if width >= 8 else "bigint"))


def be_bytes(number: Column, width: int) -> Column:
    """`width` bytes, the highest first; negative numbers in two's complement."""
    digits = F.hex(number.cast("bigint"))
    return F.unhex(F.substring(F.lpad(digits, 16, "0"), 17 - 2 * width, 2 * width))


def raw(data: Column, start: int | Column, stop: int | Column | None = None) -> Column:
    """data[start:stop], null if data is shorter than stop."""
    at = F.lit(start) if isinstance(start, int) else start
    end = F.octet_length(data) if stop is None else F.lit(stop) if isinstance(stop, int) else stop
    return F.when((F.octet_length(data) >= end) & (end >= at), F.substring(data, at + 1, end - at))


def bits(number: Column, low: int, count: int) -> Column:
    """`count` bits of a number, counted from the lowest."""
    return F.shiftrightunsigned(number, low).bitwiseAND(F.lit((1 << count) - 1).cast("bigint"))


def words_sum(data: Column) -> Column:
    """The sum of the 16-bit words; an odd last byte counts as the high one."""
    padded = F.concat(data, F.unhex(F.when(F.octet_length(data) % 2 == 1, "00").otherwise("")))
    words = F.greatest(F.octet_length(padded) / 2, F.lit(0)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0))), lambda i: F.conv(F.hex(F.substring(padded, i * 2 + 1, F.lit(2))), 16, 10).cast("bigint"))
    return F.when(words == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0))))


def fold(total: Column) -> Column:
    """A sum of words, folded to 16 bits."""
    once = F.shiftright(total, 16) + total.bitwiseAND(F.lit(65535))
    return F.shiftright(once, 16) + once.bitwiseAND(F.lit(65535))


def internet_checksum(*parts: Column) -> Column:
    """The one's complement of the folded sum: 0 over data that holds its right checksum. All parts but the last have even lengths."""
    total = words_sum(parts[0])
    for p in parts[1:]:
        total = total + words_sum(p)
    return F.lit(65535) - fold(total)



def signal_raw(payload: Column, start_bit: int, length: int, big_endian: bool = False) -> Column:
    """The unsigned bits of a signal. Little-endian: start_bit is the lowest, counting upward. Big-endian: start_bit is
    the highest; bits go down to bit 0 of its byte, then on from bit 7 of the next."""
    if not 1 <= length <= 64:
        raise ValueError("a signal has 1 to 64 bits")
    if big_endian:
        first = start_bit // 8
        skip = 7 - start_bit % 8
        width = (skip + length + 7) // 8
        parts = F.substring(payload, first + 1, width)
    else:
        first, low = divmod(start_bit, 8)
        width = (low + length + 7) // 8
        parts = F.concat(*[F.substring(payload, first + 1 + i, 1) for i in reversed(range(width))])
        skip = 8 * width - low - length
    pieces = [F.lpad(F.conv(F.hex(F.substring(parts, i + 1, 1)), 16, 2), 8, "0") for i in range(width)]
    taken = F.substring(F.concat(*pieces), skip + 1, length)
    number = F.conv(taken, 2, 10)
    return F.when(F.octet_length(payload) >= first + width, number.cast("decimal(20,0)" if length > 63 else "bigint"))


def signal_physical(raw_value: Column, factor: float, offset: float) -> Column:
    return raw_value * F.lit(float(factor)) + F.lit(float(offset))


def xor_mask(data: Column, key: Column) -> Column:
    """data with the four-byte key repeated over it."""
    n = F.octet_length(data)
    out = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.lpad(F.hex((F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")).bitwiseXOR(F.conv(F.hex(F.substring(key, (i - 1) % 4 + 1, F.lit(1))), 16, 10).cast("int"))), 2, "0"))
    return F.when(n == 0, data).otherwise(F.unhex(F.array_join(out, "")))
