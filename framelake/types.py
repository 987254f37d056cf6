"""Field types: their order code, their Spark type, and how a value looks as bytes and as text."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions import text as T
from framelake.functions import wire as W


class FieldType(IntEnum):
    """The numbers order values of types that have no order of their own."""

    NONE = 0
    I64 = 1
    U64 = 2
    F64 = 3
    STRING = 4
    BYTES = 5
    MAC = 6
    IPV4 = 7
    IPV6 = 8
    EUI64 = 9
    UUID = 10
    TIMESTAMP = 11
    BOOL = 12


NUMBERS = (FieldType.I64, FieldType.U64, FieldType.F64, FieldType.BOOL)

#: Numbers that fit 63 bits are longs, whatever their sign; WIDE_U64 is for fields declared wider.
SPARK = {
    FieldType.NONE: "void",
    FieldType.I64: "bigint",
    FieldType.U64: "bigint",
    FieldType.F64: "double",
    FieldType.STRING: "string",
    FieldType.BYTES: "binary",
    FieldType.MAC: "bigint",
    FieldType.IPV4: "bigint",
    FieldType.IPV6: "binary",
    FieldType.EUI64: "decimal(20,0)",
    FieldType.UUID: "binary",
    FieldType.TIMESTAMP: "bigint",
    FieldType.BOOL: "boolean",
}
WIDE_U64 = "decimal(20,0)"

#: Bytes of the byte view; strings and bytes have their own length.
WIDTH = {FieldType.I64: 8, FieldType.U64: 8, FieldType.F64: 8, FieldType.MAC: 6, FieldType.IPV4: 4, FieldType.IPV6: 16, FieldType.EUI64: 8, FieldType.UUID: 16, FieldType.TIMESTAMP: 8, FieldType.BOOL: 1}


def to_bytes(v: Column, kind: FieldType) -> Column:
    """The byte view of a value: big-endian for numbers and addresses."""
    if kind in (FieldType.BYTES, FieldType.IPV6, FieldType.UUID):
        return v
    if kind == FieldType.STRING:
        return v.cast("binary")
    if kind == FieldType.BOOL:
        return F.unhex(F.when(v, "01").otherwise("00"))
    if kind == FieldType.F64:
        raise ValueError("floats have no byte view in expressions")
    if kind == FieldType.EUI64:
        return F.unhex(F.lpad(F.conv(v.cast("string"), 10, 16), 16, "0"))
    return W.be_bytes(v, WIDTH[kind])


def default_text(v: Column, kind: FieldType) -> Column:
    """How a value is shown where nothing else was set."""
    return {
        FieldType.BYTES: T.hex_pairs,
        FieldType.MAC: T.mac,
        FieldType.IPV4: T.ipv4,
        FieldType.IPV6: T.ipv6,
        FieldType.EUI64: T.eui64,
        FieldType.UUID: T.uuid,
        FieldType.TIMESTAMP: T.iso_ns,
        FieldType.BOOL: lambda c: F.when(c, "True").otherwise("False"),
        FieldType.NONE: lambda c: F.lit(""),
    }.get(kind, lambda c: c.cast("string"))(v)




#: The node layout has one nullable column for each storage class.
NODE_COLUMN = {
    FieldType.I64: "i64",
    FieldType.U64: "i64",
    FieldType.MAC: "i64",
    FieldType.IPV4: "i64",
    FieldType.TIMESTAMP: "i64",
    FieldType.F64: "f64",
    FieldType.STRING: "str",
    FieldType.BYTES: "bin",
    FieldType.IPV6: "bin",
    FieldType.UUID: "bin",
    FieldType.EUI64: "dec",
    FieldType.BOOL: "bool",
}
NODE_TYPES = {"i64": "bigint", "f64": "double", "str": "string", "bin": "binary", "dec": "decimal(20,0)", "bool": "boolean"}
