"""What the parser makes of a filter's text."""

from __future__ import annotations

from dataclasses import dataclass

Span = tuple[int, int]


@dataclass(frozen=True)
class Literal:
    """kind: int, float, str, bool, ipv4, ipv6, mac or bytes; addresses as numbers, IPv6 and bytes as bytes."""

    kind: str
    value: object
    span: Span = (0, 0)


@dataclass(frozen=True)
class Operand:
    """A field or alias, its slice [start, stop) or its length."""

    name: str
    span: Span
    start: int | None = None
    stop: int | None = None
    length: bool = False


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Presence:
    name: str
    span: Span


@dataclass(frozen=True)
class Compare:
    operand: Operand
    op: str
    literal: Literal


@dataclass(frozen=True)
class InSet:
    operand: Operand
    literals: tuple[Literal, ...]


@dataclass(frozen=True)
class InRange:
    operand: Operand
    low: Literal
    high: Literal


@dataclass(frozen=True)
class Contains:
    operand: Operand
    text: str


@dataclass(frozen=True)
class Matches:
    operand: Operand
    pattern: str


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Scope:
    name: str
    span: Span
    index: int | None
    inner: object


@dataclass(frozen=True)
class Window:
    """packets, or nanoseconds."""

    packets: int | None = None
    nanos: int | None = None


@dataclass(frozen=True)
class Flank:
    operand: Operand
    span: Span
    window: Window
    from_: tuple[str, Literal] | None = None
    to: tuple[str, Literal] | None = None
    by: tuple[str, int] | None = None
    changed: bool = False
    when: object | None = None

    @property
    def armed(self) -> bool:
        return self.from_ is not None and (self.to is not None or self.by is not None)


def walk(node: object):
    """The node and all below it."""
    yield node
    for name in ("inner", "left", "right", "when"):
        child = getattr(node, name, None)
        if child is not None:
            yield from walk(child)
