"""The frozen registry of protocols, fields and aliases that expressions and outputs are resolved against."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from framelake.types import FieldType


class FilterError(ValueError):
    """A refused expression or selection; span is the part of the text that it is about."""

    def __init__(self, message: str, span: tuple[int, int] | None = None) -> None:
        super().__init__(message if span is None else f"{message} (at {span[0]})")
        self.span = span


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    protocol: str
    ui_name: str = ""
    description: str = ""
    group: str = ""
    parent: str = ""  # the container that it stands in, for trees


@dataclass
class Catalog:
    protocols: dict[str, str] = field(default_factory=dict)  # name -> shown name
    fields: dict[str, Field] = field(default_factory=dict)
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    frozen: bool = False

    def protocol(self, name: str, ui_name: str = "") -> Catalog:
        self._open()
        if name in self.protocols:
            raise FilterError(f"protocol {name} is there already")
        self.protocols[name] = ui_name or name
        return self

    def add(self, name: str, kind: FieldType, protocol: str | None = None, **more: str) -> Catalog:
        self._open()
        if name in self.fields:
            raise FilterError(f"field {name} is there already")
        owner = protocol or name.split(".")[0]
        if owner not in self.protocols:
            raise FilterError(f"{name}: no protocol {owner}")
        self.fields[name] = Field(name, kind, owner, more.pop("ui_name", "") or name, **more)
        return self

    def alias(self, name: str, members: Iterable[str]) -> Catalog:
        self._open()
        members = tuple(members)
        for m in members:
            if m not in self.fields:
                raise FilterError(f"{name}: no field {m}")
        self.aliases[name] = members
        return self

    def build(self) -> Catalog:
        self.frozen = True
        return self

    def _open(self) -> None:
        if self.frozen:
            raise FilterError("the catalog is built")

    def members(self, name: str, span: tuple[int, int] | None = None) -> tuple[Field, ...]:
        """The fields that a name stands for where a value is needed: protocols come first, and have none."""
        if name in self.protocols:
            raise FilterError(f"type mismatch: {name} is a protocol and has no value", span)
        if name in self.fields:
            return (self.fields[name],)
        if name in self.aliases:
            return tuple(self.fields[m] for m in self.aliases[name])
        raise FilterError(f"unknown name {name}{self.suggestion(name)}", span)

    def names(self) -> list[str]:
        return sorted({*self.protocols, *self.fields, *self.aliases})

    def suggestion(self, name: str) -> str:
        """The nearest name, if its edit distance is at most 1, 2 or 3 for short, middling and long names."""
        most = 1 if len(name) <= 4 else 2 if len(name) <= 8 else 3
        best = min(((distance(name.lower(), n.lower(), most), n) for n in self.names()), default=(99, ""))
        return f"; did you mean {best[1]}?" if best[0] <= most else ""

    def select(self, names: Iterable[str]) -> list[Field]:
        """Fields for a projection; unknown, repeated and valueless ones are refused."""
        out: list[Field] = []
        for n in names:
            if n not in self.fields:
                raise FilterError(f"unknown field {n}{self.suggestion(n)}")
            f = self.fields[n]
            if f.type == FieldType.NONE:
                raise FilterError(f"{n} has no value")
            if f in out:
                raise FilterError(f"{n} is selected twice")
            out.append(f)
        return out

    def field_id(self, name: str) -> int:
        return list(self.fields).index(name)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The catalog as a table, whose size is that of the declarations."""
        pid = {p: i for i, p in enumerate(self.protocols)}
        rows = [(i, f.name, f.ui_name, f.type.name, pid[f.protocol], f"field_{i}" if f.type != FieldType.NONE else None, f.description) for i, f in enumerate(self.fields.values())]
        return spark.createDataFrame(rows, "field_id int, name string, ui_name string, field_type string, protocol_id int, table_name string, description string")

    def protocol_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, n, u) for i, (n, u) in enumerate(self.protocols.items())], "protocol_id int, name string, ui_name string")


def distance(a: str, b: str, most: int) -> int:
    """Edit distance; most + 1 if it is above."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)
