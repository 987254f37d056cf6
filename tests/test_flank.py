import random

import pytest

from framelake.catalog import Catalog
from framelake.lang.parser import parse
from framelake.operators import flank as flank_module
from framelake.operators import running
from framelake.operators.flank import Latch, delta_test
from framelake.plans.compiler import Layout, apply_filter
from framelake.types import FieldType


def layout():
    c = Catalog().protocol("f").add("f.v", FieldType.U64).add("f.g", FieldType.BOOL)
    return Layout(c.build(), {n: n for n in c.fields})


def run(spark, text, values, times=None, gates=None, ids=None, **more):
    rows = [(ids[i] if ids else i, times[i] if times else i * 10**6, ["f"], [] if v is None else [v], [gates[i] if gates else True], i % 2) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "packet_id long, timestamp_ns long, protocols array<string>, `f.v` array<long>, `f.g` array<boolean>, part int")
    fired = {r["packet_id"] for r in apply_filter(df, text, layout(), **more).collect()}
    return [int(r[0] in fired) for r in rows]


#: Sequences and what fires, from the language's description.
CASES = [
    ("from: 1, to: 2, within: 10packets", [1, 3, 3, 2], [0, 0, 0, 1]),
    ("from: 1, to: 2, within: 10packets", [1, 1, 2, 1, 2], [0, 0, 1, 0, 1]),
    ("from: 1, to: 2, within: 10packets", [1, 1, 2, 2], [0, 0, 1, 0]),
    ("from: 1, to: 2, within: 2packets", [1, 9, 9, 2], [0, 0, 0, 0]),
    ("from: 1, to: 2, within: 2packets", [1, 1, 9, 2], [0, 0, 0, 1]),
    ("from: 1, to: 2, within: 4packets", [1, 1, 1, 2], [0, 0, 0, 1]),
    ("from: < 10, to: >= 10, within: 5s", [8, 12, 15], [0, 1, 0]),
    ("from: > 100, to: <= 50, within: 1s", [200, 150, 40], [0, 0, 1]),
    ("from: 1, to: 2, within: 10packets", [3, 3, 2, 2], [0, 0, 0, 0]),
    ("from: 1, to: 2, within: 10packets", [1, 2, 3, 1, 2], [0, 1, 0, 0, 1]),
    ("from: 1, to: 2, within: 10packets", [1, 3, 2, 3, 2], [0, 0, 1, 0, 0]),
    ("from: 64, to: 1, within: 1s", [64, 2, 1], [0, 0, 1]),
    ("from: 1, by: >= 5, within: 2packets", [1, 2, 3, 10], [0, 0, 0, 0]),
    ("from: 1, to: 2, within: 2packets", [1, 9, 9, 1, 2], [0, 0, 0, 0, 1]),
    ("changed, within: 1packet", [1, 1, 2, 2, 3], [0, 0, 1, 0, 1]),
    ("within: 1packet", [1, 2, 2], [0, 1, 0]),
    ("to: 2, within: 5packets", [2, 2, 1, 2], [0, 0, 0, 1]),
    ("from: 2, within: 5packets", [2, 2, 1, 2, 3], [0, 0, 1, 0, 1]),
    ("by: 2, within: 5packets", [1, 3, 5, 6], [0, 1, 1, 0]),
    ("by: <= 0, within: 5packets", [5, 5, 4, 9], [0, 1, 1, 0]),
    ("changed, within: 1packet", [1, None, 2], [0, 0, 0]),
]


@pytest.mark.parametrize(("text", "values", "fires"), CASES)
def test_described_sequences(spark, text, values, fires):
    assert run(spark, f"flank(f.v, {text})", values) == fires


def test_time_window_expires(spark):
    assert run(spark, "flank(f.v, from: 0, to: >= 5, within: 100ms)", [0, 3, 8], [0, 50 * 10**6, 200 * 10**6]) == [0, 0, 0]


def test_invisible_packets_leave_no_trace(spark):
    assert run(spark, "flank(f.v, changed, within: 5packets, when: f.g == true)", [1, 9, 1, 2], gates=[True, False, True, True]) == [0, 0, 0, 1]


def test_what_stands_before_gates_only_with_short_circuits(spark):
    values, gates = [64, 63, 64], [True, False, True]
    assert run(spark, "f.g == true && flank(f.v, changed, within: 9packets)", values, gates=gates) == [0, 0, 1]
    assert run(spark, "f.g == true && flank(f.v, changed, within: 9packets)", values, gates=gates, short_circuit=True) == [0, 0, 0]


def test_parts_are_followed_by_themselves(spark):
    assert run(spark, "flank(f.v, changed, within: 9packets)", [1, 2, 1, 2, 3, 2], partition_by=["part"]) == [0, 0, 0, 0, 1, 0]


def simple(text, rows):
    """The latch over all rows in one go."""
    node = parse(text)
    ops = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b}
    test = lambda end, v: end is None or ops[end[0]](v, end[1].value)
    latch, out = Latch(node.window, delta_test(node.by)), []
    for p, t, v in rows:
        out.append(int(latch.step(p, t, v, test(node.from_, v), test(node.to, v))))
    return out


@pytest.mark.parametrize("text", ["flank(f.v, from: < 3, to: >= 7, within: 4packets)", "flank(f.v, from: < 3, by: > 4, within: 3packets)", "flank(f.v, from: < 3, to: >= 7, within: 5ms)", "flank(f.v, from: < 4, to: >= 2, within: 3packets)"])
def test_runs_in_parallel_are_the_one_latch(spark, text, monkeypatch):
    monkeypatch.setattr(running, "BUCKET", 7)
    monkeypatch.setattr(flank_module.carried, "__defaults__", ("last", False, 7))
    rng = random.Random(len(text))
    ids = sorted(rng.sample(range(900), 300))
    times = [max(0, i * 10**6 + rng.choice([0, 0, 0, -3, 2]) * 10**6) for i in ids]  # clocks may run back
    values = [rng.randrange(10) for _ in ids]
    assert run(spark, text, values, times, ids=ids) == simple(text, list(zip(ids, times, values, strict=True)))


def test_pairwise_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(flank_module.carried, "__defaults__", ("last", False, 4))
    rng = random.Random(3)
    values = [rng.choice([1, 2, None]) for _ in range(100)]
    want, last = [], None
    for i, v in enumerate(values):
        want.append(int(v is not None and last is not None and i - last[0] <= 3 and v != last[1]))
        last = (i, v) if v is not None else last
    assert run(spark, "flank(f.v, changed, within: 3packets)", values) == want
