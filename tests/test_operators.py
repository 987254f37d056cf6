import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from framelake import views
from framelake.catalog import FilterError
from framelake.operators import merge, projection, reassembly, series
from framelake.operators.presence import Presence
from framelake.sinks import writers
from framelake.sources import captures, synthetic
from framelake.streaming import session

SF = "/root/testdata/sf0.001"


def ids(spark, values):
    return Presence(spark.createDataFrame([(v,) for v in values], "packet_id long"))


def test_presence(spark):
    rng = random.Random(1)
    a, b = set(rng.sample(range(500), 200)), set(rng.sample(range(500), 200))
    pa, pb = ids(spark, a), ids(spark, b)
    got = lambda p: {r[0] for r in p.ids.collect()}
    assert (got(pa.and_(pb)), got(pa.or_(pb)), got(pa.and_not(pb)), got(pa.xor(pb))) == (a & b, a | b, a - b, a ^ b)
    assert sorted((r[0], r[1]) for r in pa.numbered(bucket=64).collect()) == [(v, i) for i, v in enumerate(sorted(a))]
    assert pa.select(10).first()[0] == sorted(a)[10] and pa.rank(250).first()[0] == len([v for v in a if v <= 250])


@pytest.mark.parametrize("sizes", [[3, 3], [5, 1, 3], [0, 4], [7]])
def test_round_robin(spark, sizes, monkeypatch):
    monkeypatch.setattr(merge, "BUCKET", 4)
    rows = [(f"s{s}", i * 3) for s, n in enumerate(sizes) for i in range(n)]
    want, queues = [], [[r for r in rows if r[0] == f"s{s}"] for s in range(len(sizes))]
    while any(queues):
        want += [q.pop(0) for q in queues if q]
    got = merge.round_robin(spark.createDataFrame(rows, "source string, at long"), "source", "at").orderBy("packet_id").collect()
    assert [(r["source"], r["at"]) for r in got] == want and [r["packet_id"] for r in got] == list(range(len(want)))


def test_fragments(spark):
    data = bytes(range(64))
    rows = [(1, 0, 0, True, data[:16]), (2, 1, 0, True, data[:24]), (1, 2, 32, False, data[32:]), (1, 3, 16, True, data[16:32]), (2, 4, 16, True, b"x" * 16), (2, 5, 32, False, data[32:40]), (3, 6, 5, True, b"12345678"), (4, 7, 65528, False, bytes(16))]
    df = spark.createDataFrame(rows, "k long, packet_id long, offset long, more boolean, data binary")
    got = {r["packet_id"]: r for r in reassembly.reassemble(df, ["k"]).collect()}
    assert got[0]["outcome"] == got[2]["outcome"] == "pending" and got[3]["outcome"] == "complete" and bytes(got[3]["payload"]) == data
    assert bytes(got[5]["payload"]) == data[:16] + b"x" * 16 + data[32:40]  # what came later wins
    assert got[6]["outcome"] == "discarded:alignment" and got[7]["outcome"] == "discarded:extent"
    strict = {r["packet_id"]: r["outcome"] for r in reassembly.reassemble(df.filter("k = 2"), ["k"], reassembly.IPV6).collect()}
    assert strict[4] == "discarded:overlap"
    first = {r["packet_id"]: r for r in reassembly.reassemble(df.filter("k = 2"), ["k"], reassembly.FragmentPolicy("keep_first", 8)).collect()}
    assert bytes(first[5]["payload"]) == data[:24] + b"x" * 8 + data[32:40]


def test_messages(spark):
    stream = b"".join(struct.pack(">H", n) + bytes([n % 256]) * n for n in (3, 1, 300, 1))
    rows = [(k, i, stream[i * 7 : i * 7 + 7]) for k in (1, 2) for i in range(len(stream) // 7 + 1)]
    got = reassembly.messages(spark.createDataFrame(rows, "k long, seq long, payload binary"), "k", reassembly.length_prefix(0, 2, 2)).collect()
    assert sorted((r["k"], r["n"], len(r["data"])) for r in got) == [(k, i, n + 2) for k in (1, 2) for i, n in enumerate((3, 1, 300, 1))]


def test_pairs_take_the_latest_pending_request(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.choice("qr")) for i in range(200)]
    want, pending = {}, {}
    for k, i, kind in rows:
        if kind == "q":
            pending.setdefault(k, []).append(i)
            want[k, i] = None
        elif pending.get(k):
            want[k, pending[k].pop()] = i
    got = reassembly.pair_latest(spark.createDataFrame(rows, "k long, i long, kind string"), ["k"], "i", F.col("kind") == "q", F.col("kind") == "r").collect()
    assert {(r["k"], r["request"]): r["response"] for r in got} == want


def test_projection_refuses(spark):
    df, lay = views.orders(spark, SF), views.orders_layout()
    for bad in (lambda: projection.field_table(df, lay, "line.qtty"), lambda: projection.selected(df, lay, ["line.qty", "line.qty"]), lambda: projection.field_table(df, lay, "line.qty", "some")):
        with pytest.raises(FilterError):
            bad()


def test_series(spark):
    s = series.series(views.events(spark, SF), views.events_layout(), "event.value")
    assert series.monotone(s).first()["times_ascend"] and series.tail(s, 990).count() == series.id_range(s, 990, 10**9).count()
    rows, more = series.capped(s, 10)
    assert rows.count() == 10 and more.first()[0]


def test_dataset_and_texts(spark, tmp_path):
    df, lay = views.orders(spark, SF), views.orders_layout()
    writers.write_dataset(df, lay, str(tmp_path / "d"), ["line.qty", "order.status"], hierarchy=True)
    back = spark.read.parquet(str(tmp_path / "d" / f"field_{lay.catalog.field_id('line.qty')}"))
    assert back.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count() and set(back.columns) == {"packet_id", "occurrence", "value"}
    info = {r["key"]: r["value"] for r in spark.read.parquet(str(tmp_path / "d" / "export_info")).collect()}
    assert info["layout_version"] == "1" and info["shape"] == "hierarchy"
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        writers.write_dataset(df, lay, str(tmp_path / "d"), ["line.qty"])
    tree = writers.json_trees(df.limit(3), lay).first()["json"]
    assert tree.startswith('[{"name":"order"') and '"fields":[{"name":"order.key"' in tree
    lines = writers.text_lines(df.filter("size(`line.qty`) > 0").limit(1), lay).first()["text"].split("\n")
    assert lines[0].startswith("Order") and any(x.startswith("    Quantity: ") for x in lines)
    assert writers.csv_rows(df, lay).columns == ["No.", "Time", "Info"]


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_capture_round_trip(spark, tmp_path, kind):
    spark.dataSource.register(writers.CaptureSink)
    spark.dataSource.register(captures.CaptureSource)
    frames = synthetic.frames(spark, 200, "mixed")
    frames.select("timestamp_ns", "data").write.format("capture_file").option("format", kind).mode("append").save(str(tmp_path / "out"))
    want = sorted((r["timestamp_ns"], bytes(r["data"])) for r in frames.collect())
    back = captures.read_captures(spark, str(tmp_path / "out"))
    assert sorted((r["timestamp_ns"], bytes(r["data"])) for r in back.collect()) == want
    again = spark.read.format("capture").load(str(tmp_path / "out" / f"*.{kind}"))
    assert sorted((r["timestamp_ns"], bytes(r["data"])) for r in again.collect()) == want


def test_faults_end_a_file_or_the_job(spark, tmp_path):
    good = b"".join(writers.pcap_bytes([(5, b"abc"), (6, b"defg")]))
    (tmp_path / "a.pcap").write_bytes(good[:-2])
    assert captures.read_captures(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="cut off"):
        captures.read_captures(spark, str(tmp_path), tolerant=False).count()


def test_asc_and_blf(tmp_path):
    import io

    asc = b"date Mon\nbase hex timestamps absolute\n  0.010000 1 123 Rx d 2 0A FF\n  0.020000 2 1ABCDEFx Tx d 1 01\nnoise\n"
    got = list(captures.parse(io.BytesIO(asc)))
    assert [(g[0], g[2]) for g in got] == [(10_000_000, 1), (20_000_000, 2)]
    assert got[0][3] == struct.pack(">IB3x", 0x123, 2) + b"\x0a\xff" and got[1][3][:4] == struct.pack(">I", 0x81ABCDEF)
    relative = b"base hex timestamps relative\n 1.5 1 1 Rx d 0\n 0.5 1 1 Rx d 0\n"
    assert [g[0] for g in captures.parse(io.BytesIO(relative))] == [1_500_000_000, 2_000_000_000]
    body = struct.pack("<HBBI", 1, 0, 3, 0x55) + b"abc" + bytes(5)
    one = b"LOBJ" + struct.pack("<HHII", 32, 1, 32 + len(body), 1) + struct.pack("<IHHQ", 2, 0, 0, 777) + body
    packed = zlib.compress(one * 2)
    inner = struct.pack("<H6xI4x", 2, 2 * len(one)) + packed
    box = b"LOBJ" + struct.pack("<HHII", 16, 1, 16 + len(inner), 10) + inner
    blf = b"LOGG" + struct.pack("<I", 144) + bytes(136) + box + b"\0" * ((16 + len(inner)) % 4)
    got = list(captures.parse(io.BytesIO(blf)))
    assert len(got) == 2 and got[0][0] == 777 and got[0][3] == struct.pack(">IB3x", 0x55, 3) + b"abc"


def test_synthetic_is_repeatable(spark):
    a = synthetic.frames(spark, 50, "udp", seed=3).collect()
    assert a == synthetic.frames(spark, 50, "udp", seed=3).collect() and a != synthetic.frames(spark, 50, "udp", seed=4).collect()
    for mode in synthetic.MODES:
        assert synthetic.frames(spark, 10, mode).filter("data is not null and length(data) > 0").count() == 10


def test_sessions(spark, tmp_path):
    lay = views.events_layout()
    df = views.events(spark, SF)
    df.filter("packet_id < 500").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("packet_id >= 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []
    session.listen(stream, lambda batch, _: got.extend(r["packet_id"] for r in batch.collect()), str(tmp_path / "c"), "click && event.value > 50", lay, available_now=True).awaitTermination(60)
    from framelake.plans.compiler import apply_filter

    assert sorted(got) == sorted(r["packet_id"] for r in apply_filter(df, "click && event.value > 50", lay).collect())
    with pytest.raises(ValueError, match="listen_flank"):
        session.listen(stream, print, str(tmp_path / "c2"), "flank(event.value, within: 1s)", lay)


@pytest.mark.parametrize("text", ["flank(event.user_id, from: < 30, by: > 40, within: 6packets)", "flank(event.value, to: >= 100, within: 5packets)"])
def test_flank_stream(spark, tmp_path, text):
    from framelake.plans.compiler import apply_filter

    lay = views.events_layout()
    df = views.events(spark, SF).withColumn("one", F.lit(1))
    df.orderBy("packet_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []
    session.listen(session.flank_stream(stream, text, lay, "one"), lambda batch, _: got.extend(r["packet_id"] for r in batch.collect()), str(tmp_path / "c"), available_now=True).awaitTermination(90)
    assert sorted(got) == sorted(r["packet_id"] for r in apply_filter(df, text, lay).collect())
