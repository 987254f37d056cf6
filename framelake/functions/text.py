"""Text forms of values, and guards for text outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(digits: Column, sep: str) -> Column:
    return F.array_join(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), sep)


def hex_pairs(data: Column) -> Column:
    return _pairs(F.hex(data), " ")


def mac(v: Column) -> Column:
    return _pairs(F.lpad(F.hex(v), 12, "0"), ":")


def eui64(v: Column) -> Column:
    return _pairs(F.lpad(F.conv(v.cast("string"), 10, 16), 16, "0"), ":")


def ipv4(v: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def ipv4_number(s: Column) -> Column:
    """The number of a dotted address; null if it isn't one."""
    parts = F.split(s, r"\.")
    ok = s.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, sum((F.get(parts, F.lit(i)).try_cast("bigint") * (1 << 24 - 8 * i) for i in range(4)), F.lit(0).cast("bigint")))


def ipv6(v: Column) -> Column:
    """Upper-case groups, the longest run of two or more zero groups (the first of equals) as `::`."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.hex(F.substring(v, i * 2 + 1, F.lit(2))), 16, 16))
    full = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    out = full
    done = F.lit(False)
    for n in range(8, 1, -1):
        run = ":" + "0:" * n
        hit = F.instr(full, run) > 0
        at = F.instr(full, run)
        out = F.when(~done & hit, F.concat(F.substring(full, F.lit(1), at), F.lit(":"), F.substring(full, at + len(run), F.length(full)))).otherwise(out)
        done = done | hit
    # one bound colon on each side was put on above; a pair at an end stays
    out = F.regexp_replace(out, "^:(?!:)", "")
    return F.regexp_replace(out, "(?<!:):$", "")


def uuid(v: Column) -> Column:
    h = F.hex(v)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def iso_ns(v: Column) -> Column:
    """UTC, nine digits, whatever the session's time zone."""
    nanos = F.pmod(v, F.lit(1_000_000_000))
    seconds = F.floor((v - nanos) / F.lit(1_000_000_000)).cast("bigint")
    return F.concat(F.date_format(F.timestamp_add("SECOND", seconds, F.expr(EPOCH)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(nanos.cast("string"), 9, "0"), F.lit("Z"))


def formula_guard(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def escape_line(c: Column) -> Column:
    """Control characters, written out."""
    for char, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(shown))
    return c


def display_line(ui_name: Column, value_text: Column, custom_repr: Column, custom_text: Column, valued: Column) -> Column:
    """A field as a reader sees it: its own text, else its name and value, else its name."""
    return F.coalesce(custom_text, F.when(valued, F.concat(ui_name, F.lit(": "), F.coalesce(custom_repr, value_text))).otherwise(ui_name))
