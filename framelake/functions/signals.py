"""Signal messages: columns made from a description of the bits of a payload."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import wire as W


@dataclass(frozen=True)
class Signal:
    """physical = raw * factor + offset; names: shown instead of a raw value; group: the value of the selector at which the signal is there."""

    name: str
    start: int
    length: int
    big_endian: bool = False
    factor: float = 1.0
    offset: float = 0.0
    names: dict[int, str] = field(default_factory=dict)
    group: int | None = None
    selector: bool = False

    def raw(self, payload: Column) -> Column:
        return W.signal_raw(payload, self.start, self.length, self.big_endian)


@dataclass(frozen=True)
class Message:
    ident: int
    name: str
    signals: tuple[Signal, ...]

    def __post_init__(self) -> None:
        if sum(s.selector for s in self.signals) > 1:
            raise ValueError(f"{self.name}: more than one selector")
        if len({s.name for s in self.signals}) < len(self.signals):
            raise ValueError(f"{self.name}: a signal is there twice")


def load(text: str) -> list[Message]:
    """Messages of a JSON list: {id, name, signals: [{name, start, length, ...}]}."""
    out = []
    for m in json.loads(text):
        signals = tuple(Signal(**{**s, "names": {int(k): v for k, v in s.get("names", {}).items()}}) for s in m["signals"])
        out.append(Message(int(m["id"]), m["name"], signals))
    return out


def decode(df: DataFrame, messages: list[Message], ident: str = "id", payload: str = "payload") -> DataFrame:
    """(all columns, message, signals: map of the physical values, shown: map of the names of raw values)."""
    data = F.col(payload)
    name, values, shown = F.lit(None).cast("string"), F.lit(None).cast("map<string,double>"), F.lit(None).cast("map<string,string>")
    for m in messages:
        selector = next((s.raw(data) for s in m.signals if s.selector), None)
        pairs, texts = [], []
        for s in m.signals:
            raw = s.raw(data)
            there = raw.isNotNull() if s.group is None or selector is None else raw.isNotNull() & (selector == s.group)
            pairs.append(F.when(there, F.struct(F.lit(s.name).alias("key"), W.signal_physical(raw.cast("double"), s.factor, s.offset).alias("value"))))
            for value, label in s.names.items():
                texts.append(F.when(there & (raw == value), F.struct(F.lit(s.name).alias("key"), F.lit(label).alias("value"))))
        hit = F.col(ident) == m.ident
        name = F.when(hit, m.name).otherwise(name)
        values = F.when(hit, F.map_from_entries(F.array_compact(F.array(*pairs)))).otherwise(values)
        if texts:
            shown = F.when(hit, F.map_from_entries(F.array_compact(F.array(*texts)))).otherwise(shown)
    return df.withColumns({"message": name, "signals": values, "shown": shown})
