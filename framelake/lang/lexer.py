"""Tokens of the filter language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from framelake.catalog import FilterError

#: Kinds in the order in which they are tried.
_PATTERNS = [
    ("space", r"\s+"),
    ("string", r'"(?:[^"\\]|\\.)*"'),
    ("duration", r"\d[\d_]*(?:\.\d+)?(?:ns|us|ms|s|m|h|packets?)\b"),
    ("mac_or_bytes", r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2})+(?![0-9A-Za-z:])"),
    ("ipv6", r"(?=[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:)[0-9A-Fa-f:]+(?:\.\d+\.\d+\.\d+)?(?![0-9A-Za-z:])"),
    ("ipv4", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d])"),
    ("float", r"-?\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?|-?\d[\d_]*[eE][+-]?\d+"),
    ("int", r"-?(?:0[xX][0-9A-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*)"),
    ("name", r"[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z0-9_]+)*"),
    ("op", r"&&|\|\||==|!=|<=|>=|\.\.|[&|!<>=()\[\]{},:$]"),
]
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS))


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    stop: int

    @property
    def span(self) -> tuple[int, int]:
        return self.start, self.stop


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise FilterError(f"unexpected {source[at]!r}", (at, at + 1))
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    out.append(Token("end", "", at, at))
    return out
