import pytest

from framelake.catalog import Catalog, FilterError
from framelake.lang import nodes as N
from framelake.lang.parser import parse
from framelake.plans.compiler import Layout, apply_filter, compile_filter, completions
from framelake.types import FieldType


def layout():
    c = Catalog().protocol("p").protocol("q")
    for name, kind in (("p.u", FieldType.U64), ("p.i", FieldType.I64), ("p.f", FieldType.F64), ("p.s", FieldType.STRING), ("p.b", FieldType.BYTES), ("p.m", FieldType.MAC), ("p.a", FieldType.IPV4), ("p.x", FieldType.IPV6), ("p.t", FieldType.BOOL), ("p.none", FieldType.NONE), ("q.u", FieldType.U64)):
        c.add(name, kind)
    c.alias("any.u", ["p.u", "q.u"])
    return Layout(c.build(), {f: f for f in c.fields if f != "p.none"}, exhaustive=True)


SCHEMA = "packet_id long, timestamp_ns long, protocols array<string>, `p.u` array<long>, `p.i` array<long>, `p.f` array<double>, `p.s` array<string>, `p.b` array<binary>, `p.m` array<long>, `p.a` array<long>, `p.x` array<binary>, `p.t` array<boolean>, `q.u` array<long>"


@pytest.fixture(scope="module")
def packets(spark):
    rows = [
        (0, 0, ["p"], [1, 5], [-3], [1.5, float("nan")], ["Abc", "é"], [b"\x00\x11\x22\x33"], [0x001122334455], [0x0A000001], [bytes(15) + b"\x01"], [True], []),
        (1, 1, ["p", "q"], [], [], [], [], [], [], [], [], [], [7]),
        (2, 2, [], None, None, None, None, None, None, None, None, None, None),
        (3, 3, ["p"], [1 << 40], [4], [float("nan")], ["=x"], [b""], [1], [0xC0A80001], [b"\xff" * 16], [False], []),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("", [0, 1, 2, 3]),
        ("  ", [0, 1, 2, 3]),
        ("p", [0, 1, 3]),
        ("!p", [2]),
        ("p.u", [0, 3]),
        ("any.u", [0, 1, 3]),
        ("p.u == 5", [0]),
        ("p.u != 5", [0, 3]),
        ("!(p.u == 5)", [1, 2, 3]),
        ("p.u > 0xFF_FF", [3]),
        ("any.u == 7 || p.u == 1", [0, 1]),
        ("p.i < -2", [0]),
        ("p.i in {-3, 9}", [0]),
        ("p.i in -5..0", [0]),
        ("p.f < 0", [0, 3]),  # NaN is below all numbers
        ("p.f == 1.5", [0]),
        ("p.f > 1", [0]),
        ("p.u < 18446744073709551615", [0, 3]),
        ('p.s contains "b"', [0]),
        ('p.s matches "^[A-Z]"', [0]),
        ('p.s matches "(?=.*c)A"', [0]),
        ('p.s == "\\u00e9"', [0]),
        ("len(p.s) == 2", [0, 3]),  # bytes, not characters
        ("p.b[0:2] == 00:11", [0]),
        ("p.b[2:9] == 00:11", []),
        ("len(p.b) == 0", [3]),
        ("p.m == 00:11:22:33:44:55", [0]),
        ("p.m[0:3] == 00:11:22", [0]),
        ("p.m[0:6] == 00:11:22:33:44:55", []),  # bytes are never an address
        ("p.a in 10.0.0.0..10.0.0.255", [0]),
        ("p.x == ::1", [0]),
        ("p.x > 10.0.0.1", [0, 3]),  # every IPv6 address is above every IPv4 address
        ("p.t == 1", [0]),
        ("p.t == false", [3]),
        ("p.s > 5", [0, 3]),  # types have an order
        ("p.s == 5", []),
        ("p.s != 5", [0, 3]),
        ("p && q or p.u == 1 and not q", [0, 1]),
        ("p | q & false", [0, 1, 3]),
        ("TRUE && NOT FALSE", [0, 1, 2, 3]),
    ],
)
def test_matches(packets, text, ids):
    assert sorted(r["packet_id"] for r in apply_filter(packets, text, layout()).collect()) == ids


@pytest.mark.parametrize(
    "text",
    ["p.u ==", "p.u == ", "(p", "p.u in {}", "p.u in {1,", "p.unknown", "p.uu == 1", "p == 5", "p.s[0:2] == 00", "p.u contains \"x\"", "p.s matches \"(\"", "p.b[3:3] == 00:11", "stream(p).count()", "seq(p)", "let x", "flank(p.u)", "flank(p.u, changed, from: 1, within: 1s)", "flank(p.u, to: 1, by: 2, within: 1s)", "flank(p.f, by: 1, within: 1s)", "flank(p.u, by: 1.5, within: 1s)", "flank(p.u, within: 5)", "p.none == 1", "$p { flank(p.u, within: 1s) }", "p.u == 99999999999999999999", "len(len(p.s)) == 1", "p.u ? 1", "p q"],
)
def test_refused(text):
    with pytest.raises(FilterError):
        compile_filter(text, layout())


def test_limits():
    with pytest.raises(FilterError):
        parse("(" * 65 + "p" + ")" * 65)
    with pytest.raises(FilterError):
        parse(" || ".join(["p"] * 1025))
    assert parse("!" * 60 + "p")


def test_precedence():
    assert parse("a || b && !c") == N.Or(N.Presence("a", (0, 1)), N.And(N.Presence("b", (5, 6)), N.Not(N.Presence("c", (11, 12)))))


def test_six_pairs_are_an_address_and_other_numbers_of_them_bytes():
    kinds = {"00:11:22:33:44:55": "mac", "00:11": "bytes", "00:11:22:33:44:55:66": "bytes", "1.2.3.4": "ipv4", "::1": "ipv6", "2001:db8::2": "ipv6"}
    assert {t: parse(f"f == {t}").literal.kind for t in kinds} == kinds


@pytest.mark.parametrize(("text", "nanos"), [("5s", 5 * 10**9), ("100ms", 10**8), ("2h", 7200 * 10**9), ("1.5us", 1500), ("3m", 180 * 10**9), ("7ns", 7)])
def test_durations(text, nanos):
    assert parse(f"flank(f, within: {text})").window == N.Window(nanos=nanos)


def test_suggestions_and_completions():
    with pytest.raises(FilterError, match="did you mean p.u"):
        compile_filter("p.uu == 1", layout())
    assert completions("p.u == 1 && q", 13, layout().catalog) == ["q", "q.u"]


def test_implied_presence_reaches_the_plan(packets):
    plan = apply_filter(packets, "p.u == 5 && q.u == 1", layout())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains") == 2
    assert compile_filter("p.u == 5 || !q", layout()).implied is None
    assert compile_filter("flank(p.u, within: 1s) && p", layout()).implied is None


def test_catalog_refuses():
    c = Catalog().protocol("p").add("p.u", FieldType.U64)
    for bad in (lambda: c.add("p.u", FieldType.U64), lambda: c.add("z.u", FieldType.U64), lambda: c.alias("a", ["no"]), lambda: c.select(["p.u", "p.u"]), lambda: c.select(["nope"])):
        with pytest.raises(FilterError):
            bad()
    c.build()
    with pytest.raises(FilterError):
        c.protocol("late")
