"""Projections of packets: selected fields, all valued fields, trees."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.catalog import Field, FilterError
from framelake.plans.compiler import Layout
from framelake.types import NODE_COLUMN, FieldType, default_text

OCCURRENCES = ("all", "first", "last")


def first(layout: Layout, name: str) -> Column:
    """The first occurrence, null if there is none."""
    return F.try_element_at(F.col(f"`{layout.columns[name]}`"), F.lit(1))


def field_table(df: DataFrame, layout: Layout, name: str, occurrences: str = "all") -> DataFrame:
    """(packet_id, occurrence, value) of one field. The last occurrence has number 0, as it is the only one."""
    (f,) = layout.catalog.select([name])
    if occurrences not in OCCURRENCES:
        raise FilterError(f"occurrences are one of {', '.join(OCCURRENCES)}")
    values = F.col(f"`{layout.columns[name]}`")
    if occurrences == "all":
        return df.select(layout.packet_id, F.posexplode(values).alias("occurrence", "value"))
    one = F.try_element_at(values, F.lit(1 if occurrences == "first" else -1))
    return df.filter(F.size(values) > 0).select(layout.packet_id, F.lit(0).alias("occurrence"), one.alias("value"))


def selected(df: DataFrame, layout: Layout, names: Iterable[str], occurrences: str = "all") -> dict[str, DataFrame]:
    return {f.name: field_table(df, layout, f.name, occurrences) for f in layout.catalog.select(names)}


def long_rows(df: DataFrame, layout: Layout, names: Iterable[str] | None = None) -> DataFrame:
    """(packet_id, field, occurrence, value) with values as text, in one pass over df: every valued field unless names are given."""
    fields = layout.catalog.select(names) if names is not None else [f for f in layout.catalog.fields.values() if f.type != FieldType.NONE and f.name in layout.columns]

    def rows(f: Field) -> Column:
        return F.transform(F.col(f"`{layout.columns[f.name]}`"), lambda v, i: F.struct(F.lit(f.name).alias("field"), i.alias("occurrence"), default_text(v, f.type).alias("value")))

    each = [rows(f) for f in fields]
    return df.select(layout.packet_id, F.explode(F.concat(*each)).alias("r")).select(layout.packet_id, "r.*")


def wide_rows(df: DataFrame, layout: Layout, names: Iterable[str], separator: str = "|") -> DataFrame:
    """One row a packet, a column of text for each field, occurrences joined; empty where there is none."""
    fields = layout.catalog.select(names)

    def cell(f: Field) -> Column:
        return F.array_join(F.transform(F.col(f"`{layout.columns[f.name]}`"), lambda v: default_text(v, f.type)), separator)

    return df.select(layout.packet_id, *[cell(f).alias(f.name.replace(".", "_")) for f in fields])


def node_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """The tree, one row a node in pre-order."""
    return df.select(layout.packet_id, F.explode(layout.nodes).alias("n")).select(layout.packet_id, "n.*")


def node_text(n: Column, layout: Layout) -> Column:
    """The default text of a node's value."""
    out = F.lit(None).cast("string")
    for kind in {f.type for f in layout.catalog.fields.values()} - {FieldType.NONE}:
        names = [f.name for f in layout.catalog.fields.values() if f.type == kind]
        out = F.when(n["name"].isin(names), default_text(n[NODE_COLUMN[kind]], kind)).otherwise(out)
    return out


def tree_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """(packet_id, node_id, parent_node_id, path, field, value): the path names the containers above. Stays inside the row: no join."""
    nodes = F.col(layout.nodes)

    def of(n: Column) -> Column:
        above = F.filter(nodes, lambda m: (m["node_id"] <= n["node_id"]) & (m["stop"] >= n["node_id"]))
        path = F.array_join(F.transform(above, lambda m: m["name"]), "/")
        return F.struct(n["node_id"].alias("node_id"), n["parent"].alias("parent_node_id"), path.alias("path"), n["name"].alias("field"), node_text(n, layout).alias("value"))

    return df.select(layout.packet_id, F.explode(F.transform(nodes, of)).alias("r")).select(layout.packet_id, "r.*")


def descendants(df: DataFrame, layout: Layout, name: str) -> DataFrame:
    """(packet_id, anchor, node_id, name): the nodes below each node of a name."""
    nodes = F.col(layout.nodes)
    pairs = F.flatten(F.transform(F.filter(nodes, lambda a: a["name"] == name), lambda a: F.transform(F.filter(nodes, lambda n: (n["node_id"] > a["node_id"]) & (n["node_id"] <= a["stop"])), lambda n: F.struct(a["node_id"].alias("anchor"), n["node_id"].alias("node_id"), n["name"].alias("name")))))
    return df.select(layout.packet_id, F.explode(pairs).alias("r")).select(layout.packet_id, "r.*")


def children(df: DataFrame, layout: Layout, name: str) -> DataFrame:
    nodes = F.col(layout.nodes)
    pairs = F.flatten(F.transform(F.filter(nodes, lambda a: a["name"] == name), lambda a: F.transform(F.filter(nodes, lambda n: n["parent"] == a["node_id"]), lambda n: F.struct(a["node_id"].alias("anchor"), n["node_id"].alias("node_id"), n["name"].alias("name")))))
    return df.select(layout.packet_id, F.explode(pairs).alias("r")).select(layout.packet_id, "r.*")


def byte_columns(df: DataFrame, *columns: str) -> DataFrame:
    """df with <column>_hex and <column>_base64 of columns of bytes (of arrays, the first)."""
    kinds = dict(df.dtypes)
    for c in columns:
        v = F.try_element_at(F.col(f"`{c}`"), F.lit(1)) if kinds[c].startswith("array") else F.col(f"`{c}`")
        df = df.withColumns({f"{c}_hex": F.hex(v), f"{c}_base64": F.base64(v)})
    return df
