"""Filter nodes to one null-free boolean column: no UDF, so that Catalyst sees and prunes what a filter needs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.catalog import Catalog, Field, FilterError
from framelake.functions.stage import staged
from framelake.lang import nodes as N
from framelake.lang.parser import parse
from framelake.types import NODE_COLUMN, NUMBERS, SPARK, WIDTH, FieldType, to_bytes

LITERAL_TYPE = {"int": FieldType.U64, "float": FieldType.F64, "str": FieldType.STRING, "bool": FieldType.BOOL, "ipv4": FieldType.IPV4, "ipv6": FieldType.IPV6, "mac": FieldType.MAC, "bytes": FieldType.BYTES}
_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def constant(op: str, sign: int) -> Column:
    """What op says of two values whose order is known."""
    return F.lit(_OPS[op](sign, 0))


def compare(v: Column, kind: FieldType, op: str, lit: N.Literal) -> Column:
    """v op literal, by the one order over all types."""
    other = LITERAL_TYPE[lit.kind]
    apply = _OPS[op]
    if kind in NUMBERS and other in NUMBERS:
        if kind == FieldType.F64 or other == FieldType.F64:
            number = v.cast("int").cast("double") if kind == FieldType.BOOL else v.cast("double")
            plain = apply(number, F.lit(float(lit.value)))
            return F.when(F.isnan(v), constant(op, -1)).otherwise(plain) if kind == FieldType.F64 else plain  # NaN is below all
        number = v.cast("int") if kind == FieldType.BOOL else v
        value = int(lit.value)
        if value >= 1 << 63:
            return apply(number.cast("decimal(20,0)"), F.lit(str(value)).cast("decimal(20,0)"))
        return apply(number, F.lit(value).cast("bigint"))
    if kind == other:
        if kind in (FieldType.BYTES, FieldType.IPV6):
            return apply(v, F.lit(bytearray(lit.value)))
        return apply(v, F.lit(lit.value).cast("bigint") if kind in (FieldType.MAC, FieldType.IPV4) else F.lit(lit.value))
    if {kind, other} == {FieldType.MAC, FieldType.EUI64}:
        return apply(v.cast("decimal(20,0)"), F.lit(str(lit.value)).cast("decimal(20,0)"))
    code = FieldType.I64 if lit.kind == "int" and lit.value < 0 else other
    return constant(op, (kind > code) - (kind < code))


@dataclass(frozen=True)
class Container:
    """A node kind whose occurrences are the structs of one array column (None: there is one, the packet itself). members: field -> member of the struct."""

    column: str | None
    members: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Inside:
    """A scope's domain where the layout has containers: one struct of a container, or one value of a field."""

    name: str
    members: dict[str, str]
    at: Column

    def values(self, name: str) -> Column | None:
        if name == self.name:
            return F.array(self.at)
        return F.array(self.at[self.members[name]]) if name in self.members else None


@dataclass
class Layout:
    """Where a frame keeps packets: an array column for each field (its position is the occurrence), an array of nodes, or both.

    nodes: array<struct<name, node_id, parent, depth, stop, i64, f64, str, bin, dec, bool>> in pre-order: node_id is the place in
    the array, stop the last node below, so that what is below a node is one slice.
    containers: scopes over them look at the fields' own arrays, and need no tree.
    trees: the protocols that the tree holds, where it doesn't hold all.
    exhaustive: `protocols` names the protocol of every field there is, so that presence implies it; carriers: of a protocol
    that may be missing there, the one around it.
    """

    catalog: Catalog
    columns: dict[str, str] = field(default_factory=dict)
    nodes: str | None = None
    protocols: str | None = "protocols"
    packet_id: str = "packet_id"
    timestamp: str = "timestamp_ns"
    exhaustive: bool = False
    containers: dict[str, Container] = field(default_factory=dict)
    trees: frozenset[str] | None = None
    carriers: dict[str, str] = field(default_factory=dict)


@dataclass
class FlankCall:
    column: str
    flank: N.Flank
    sample: Column
    kind: FieldType
    gate: Column


@dataclass
class Filter:
    text: str
    node: object
    column: Column
    flanks: list[FlankCall]
    implied: Column | None
    tree_used: bool = False

    @property
    def stateful(self) -> bool:
        return bool(self.flanks)

    def rederive(self, layout: Layout) -> Filter:
        """The same expression over another layout; what that doesn't know is refused."""
        return compile_filter(self.text, layout)


class Compiler:
    def __init__(self, layout: Layout, short_circuit: bool = False) -> None:
        self.layout, self.catalog, self.short_circuit = layout, layout.catalog, short_circuit
        self.flanks: list[FlankCall] = []
        self.tree_used = False

    # values

    def in_domain(self, domain: Column | None) -> Column:
        self.tree_used = True
        nodes = F.coalesce(F.col(self.layout.nodes), F.array())
        return nodes if domain is None else F.slice(nodes, domain["node_id"] + 1, domain["stop"] - domain["node_id"] + 1)

    def values(self, f: Field, domain: Column | Inside | None) -> Column:
        """All occurrences, in order; an empty or null array where there is none."""
        if isinstance(domain, Inside):
            found = domain.values(f.name)
            return found if found is not None else F.array().cast(f"array<{SPARK[f.type]}>")
        if domain is None and f.name in self.layout.columns:
            return F.col(f"`{self.layout.columns[f.name]}`")
        if not self.layout.nodes:
            raise FilterError(f"{f.name} isn't part of this layout")
        own = F.filter(self.in_domain(domain), lambda n: n["name"] == f.name)
        return F.transform(own, lambda n: n[NODE_COLUMN[f.type]]) if f.type in NODE_COLUMN else F.transform(own, lambda n: n["name"])

    def any_of(self, operand: N.Operand, domain: Column | None, test) -> Column:
        """Whether an occurrence of any member passes; absent ones don't."""
        hits = []
        for f in self.catalog.members(operand.name, operand.span):
            if f.type == FieldType.NONE:
                raise FilterError(f"type mismatch: {f.name} has no value", operand.span)
            view, kind = self.view(f, operand)
            predicate = test(kind, f)
            hits.append(self.exists(self.values(f, domain), view, predicate))
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    @staticmethod
    def exists(values: Column, view, predicate) -> Column:
        return F.coalesce(F.exists(values, lambda v: F.coalesce(predicate(view(v)), F.lit(False))), F.lit(False))

    def view(self, f: Field, operand: N.Operand):
        """What of a value is looked at: itself, its slice (null if it is too short) or its length in bytes."""
        if operand.start is not None:
            if f.type in (FieldType.STRING, FieldType.F64):
                raise FilterError(f"{f.name} can't be sliced", operand.span)
            start, stop = operand.start, operand.stop

            def part(v: Column) -> Column:
                data = to_bytes(v, f.type)
                return F.when(F.octet_length(data) >= stop, F.substring(data, start + 1, stop - start))

            return ((lambda v: F.octet_length(part(v)).cast("bigint")), FieldType.U64) if operand.length else (part, FieldType.BYTES)
        if operand.length:
            width = WIDTH.get(f.type)
            if width and f.type not in (FieldType.STRING, FieldType.BYTES):
                return (lambda v: F.lit(width).cast("bigint")), FieldType.U64
            return (lambda v: F.octet_length(v).cast("bigint")), FieldType.U64
        return (lambda v: v), f.type

    # conditions

    def presence(self, name: str, span, domain: Column | None) -> Column:
        if name in self.catalog.protocols:
            if isinstance(domain, Inside):
                return F.lit(name == domain.name or any(self.catalog.fields[m].protocol == name for m in domain.members))
            if domain is None and self.layout.protocols:
                return F.coalesce(F.array_contains(F.col(self.layout.protocols), name), F.lit(False))
            own = [f for f in self.catalog.fields.values() if f.protocol == name]
            out = F.lit(False)
            if self.layout.nodes:
                names = [name, *[f.name for f in own]]
                return F.coalesce(F.exists(self.in_domain(domain), lambda n: n["name"].isin(names)), F.lit(False))
            for f in own:
                out = out | (F.coalesce(F.size(self.values(f, domain)), F.lit(0)) > 0)
            return out
        found = self.catalog.members(name, span)
        out = F.lit(False)
        for f in found:
            out = out | (F.coalesce(F.size(self.values(f, domain)), F.lit(0)) > 0)
        return out

    def compile(self, node: object, domain: Column | None = None, gate: Column | None = None) -> Column:
        match node:
            case N.Const(value):
                return F.lit(value)
            case N.Presence(name, span):
                return self.presence(name, span, domain)
            case N.Compare(operand, op, lit):
                return self.any_of(operand, domain, lambda kind, f: lambda v: compare(v, kind, op, lit))
            case N.InSet(operand, lits):

                def member(kind, f):
                    def test(v):
                        out = F.lit(False)
                        for lit in lits:
                            out = out | F.coalesce(compare(v, kind, "==", lit), F.lit(False))
                        return out

                    return test

                return self.any_of(operand, domain, member)
            case N.InRange(operand, low, high):
                return self.any_of(operand, domain, lambda kind, f: lambda v: compare(v, kind, ">=", low) & compare(v, kind, "<=", high))
            case N.Contains(operand, text):
                return self.any_of(operand, domain, lambda kind, f: self.text_test(kind, f, operand, lambda v: F.contains(v, F.lit(text))))
            case N.Matches(operand, pattern):
                return self.any_of(operand, domain, lambda kind, f: self.text_test(kind, f, operand, lambda v: v.rlike(pattern)))
            case N.Not(inner):
                return ~self.compile(inner, domain, gate)
            case N.And(left, right):
                a = self.compile(left, domain, gate)
                return a & self.compile(right, domain, self.narrowed(gate, a))
            case N.Or(left, right):
                a = self.compile(left, domain, gate)
                return a | self.compile(right, domain, self.narrowed(gate, ~a))
            case N.Scope(name, span, index, inner):
                return self.scope(node, domain)
            case N.Flank():
                return self.flank(node, domain, gate)
        raise TypeError(node)

    def narrowed(self, gate: Column | None, more: Column) -> Column | None:
        """With short-circuits, what stands before a flank decides whether it sees a packet."""
        return gate if not self.short_circuit else more if gate is None else gate & more

    def text_test(self, kind: FieldType, f: Field, operand: N.Operand, test):
        if kind != FieldType.STRING:
            raise FilterError(f"type mismatch: {f.name} is no text", operand.span)
        return test

    def scope(self, node: N.Scope, domain: Column | None) -> Column:
        if not self.layout.nodes:
            raise FilterError("this layout has no tree to look into", node.span)
        if any(isinstance(x, N.Flank) for x in N.walk(node.inner)):
            raise FilterError("flank inside a scope", node.span)
        fast = self.contained(node, domain)
        if fast is not None:
            return fast
        names = [node.name] if node.name in self.catalog.protocols else [f.name for f in self.catalog.members(node.name, node.span)]
        owners = {n if n in self.catalog.protocols else self.catalog.fields[n].protocol for n in names}
        if self.layout.trees is not None and not owners <= self.layout.trees:
            raise FilterError(f"{node.name} isn't part of the tree", node.span)
        hits = F.filter(self.in_domain(domain), lambda n: n["name"].isin(names))
        if node.index is not None:  # breadth first is by depth, then in order
            found = F.array_sort(F.transform(hits, lambda n: F.struct(n["depth"].alias("depth"), n["node_id"].alias("node_id"), n["stop"].alias("stop"))))
            hits = F.slice(found, node.index + 1, 1)
        return F.coalesce(F.exists(hits, lambda n: self.compile(node.inner, n)), F.lit(False))

    def contained(self, node: N.Scope, domain: Column | Inside | None) -> Column | None:
        """The scope over a container or a field, without the tree; None if the layout can't say it so."""
        if not self.layout.containers or isinstance(domain, Column):
            return None
        own = self.layout.containers.get(node.name)
        if own is not None and own.column is None:
            if domain is not None:
                return None
            return F.lit(False) if node.index else self.presence(node.name, node.span, None) & self.compile(node.inner)
        if own is not None:
            if domain is not None:
                return None
            rows, made = F.col(f"`{own.column}`"), lambda x: Inside(node.name, own.members, x)
        elif node.name in self.catalog.fields:
            f = self.catalog.fields[node.name]
            rows, made = self.values(f, domain), lambda x: Inside(f.name, {}, x)
        else:
            return None
        if node.index is not None:
            rows = F.slice(rows, node.index + 1, 1)
        return F.coalesce(F.exists(rows, lambda x: self.compile(node.inner, made(x))), F.lit(False))

    def flank(self, node: N.Flank, domain: Column | None, gate: Column | None) -> Column:
        found = self.catalog.members(node.operand.name, node.operand.span)
        kinds = {f.type for f in found}
        if len(kinds) > 1 or FieldType.NONE in kinds:
            raise FilterError("flank needs fields of one type", node.operand.span)
        (kind,) = kinds
        if node.by is not None and kind not in (FieldType.I64, FieldType.U64):
            raise FilterError("by: needs a field of whole numbers", node.operand.span)
        view, kind = self.view(found[0], node.operand)
        sample = F.coalesce(*[F.try_element_at(self.values(f, None), F.lit(1)) for f in found])
        visible = F.lit(True) if gate is None else gate
        if node.when is not None:
            if any(isinstance(x, N.Flank) for x in N.walk(node.when)):
                raise FilterError("when: takes no flank", node.span)
            visible = visible & self.compile(node.when)
        name = f"__flank_{len(self.flanks)}"
        self.flanks.append(FlankCall(name, node, view(sample), kind, visible))
        return F.col(name)

    # what a match implies

    def implied(self, node: object) -> Column | None:
        """A condition on `protocols` that every match meets, or None; never of what is stateful."""
        if not (self.layout.exhaustive and self.layout.protocols) or any(isinstance(x, N.Flank) for x in N.walk(node)):
            return None
        return self._implied(node)

    def _implied(self, node: object) -> Column | None:
        protocols = F.col(self.layout.protocols)
        match node:
            case N.Presence(name, _):
                owners = {name} if name in self.catalog.protocols else {f.protocol for f in self.catalog.members(name)}
            case N.Compare(operand) | N.InSet(operand) | N.InRange(operand) | N.Contains(operand) | N.Matches(operand):
                owners = {f.protocol for f in self.catalog.members(operand.name)}
            case N.And(left, right):
                known = [c for c in (self._implied(left), self._implied(right)) if c is not None]
                return None if not known else known[0] if len(known) == 1 else known[0] & known[1]
            case N.Or(left, right):
                a, b = self._implied(left), self._implied(right)
                return None if a is None or b is None else a | b
            case _:
                return None
        out = F.lit(False)
        for p in sorted({self.layout.carriers.get(p, p) for p in owners}):
            out = out | F.coalesce(F.array_contains(protocols, p), F.lit(False))
        return out


def compile_filter(text: str, layout: Layout, short_circuit: bool = False) -> Filter:
    """short_circuit: flanks don't see packets that what stands before them decides."""
    node = parse(text)
    c = Compiler(layout, short_circuit)
    column = c.compile(node)
    return Filter(text, node, column, c.flanks, c.implied(node), c.tree_used)


def compile_observer(text: str, layout: Layout) -> Filter:
    """A filter that needs no tree and follows one thing at most: scopes and further flanks are refused."""
    node = parse(text)
    for x in N.walk(node):
        if isinstance(x, N.Scope):
            raise FilterError("a scope needs the tree", x.span)
    f = compile_filter(text, layout)
    if len(f.flanks) > 1:
        raise FilterError("more than one flank")
    return f


def apply_filter(df: DataFrame, text: str, layout: Layout, short_circuit: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """The packets of df that match. partition_by: flanks follow each of its groups by itself."""
    from framelake.operators.flank import add_flank

    f = compile_filter(text, layout, short_circuit)
    if isinstance(f.node, N.Const) and f.node.value:
        return df
    out = df
    if f.tree_used:
        out = staged(out, **{layout.nodes: F.col(layout.nodes)})  # else the tree is built again at each of its uses, of which some are once a hit
    for call in f.flanks:
        out = add_flank(out, call, layout, partition_by or [])
    if f.implied is not None:
        out = out.filter(f.implied)
    return out.filter(f.column).drop(*[c.column for c in f.flanks])


OPERATORS = {
    "text": ["!=", "<", "<=", "==", ">", ">=", "contains", "in", "matches"],
    "value": ["!=", "<", "<=", "==", ">", ">=", "in"],
}
START = ["!", "$", "false", "flank(", "len(", "not", "true"]
JOIN = ["&&", "||", "and", "or"]


def completions(text: str, caret: int, catalog: Catalog) -> list[str]:
    """What may stand at the caret: names that go on from what stands before it, and where a value has just been named, the operators that it takes."""
    start = caret
    while start and (text[start - 1].isalnum() or text[start - 1] in "._"):
        start -= 1
    word, before = text[start:caret], text[:start].rstrip()
    if not word and before and before != text[:start]:  # a space after something whole
        last = before
        at = len(last)
        while at and (last[at - 1].isalnum() or last[at - 1] in "._"):
            at -= 1
        name = last[at:]
        if name in catalog.protocols or name in ("true", "false"):
            return JOIN
        if name in catalog.fields or name in catalog.aliases:
            found = catalog.members(name)
            kinds = {f.type for f in found}
            if kinds == {FieldType.NONE}:
                return JOIN
            return OPERATORS["text" if kinds == {FieldType.STRING} else "value"] + JOIN
        if last[-1] in ")}\"" or last[-1].isdigit():
            return JOIN
        if last[-1] in "=<>":
            return []
    names = [n for n in catalog.names() if n.startswith(word)]
    return names if word else START + names if not before or before[-1] in "(!&|{" or before.split()[-1] in ("and", "or", "not") else names
