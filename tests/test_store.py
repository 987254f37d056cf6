"""Sessions that are kept, faults and splits of capture files, outputs of whole packets, and the command line."""

import io
import json
import os
import struct

import pytest

from framelake import __main__ as cli
from framelake import views
from framelake.dissect import packet
from framelake.operators import merge, running, series
from framelake.sinks import writers
from framelake.sources import captures, synthetic
from framelake.streaming import store
from tests.test_packets import ETH, frames_of, ip4, udp

SF = "/root/testdata/sf0.001"


def some(spark, first, n):
    rows = [(i, i * 10, 1, i % 2, ETH + ip4(17, udp(b"x" * (i % 5 + 1), 4000 + i % 3))) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "frame_id long, timestamp_ns long, link_type int, interface_id int, data binary")


def test_session(spark, tmp_path):
    s = store.Session(spark, str(tmp_path / "s"))
    assert s.ingest(some(spark, 0, 20)) == 0 and s.ingest(some(spark, 0, 20), 0) == 0  # tried again
    s.record("ports", "udp.srcport")
    with pytest.raises(store.OutOfOrder):
        s.ingest(some(spark, 30, 5))
    with pytest.raises(store.OutOfOrder):
        s.ingest(some(spark, 20, 5), 7)
    cache = store.MatchCache(s)
    assert {r[0] for r in cache.ids("udp.srcport == 4001").collect()} == set(range(1, 20, 3))
    s.ingest(some(spark, 20, 10))
    assert {r[0] for r in cache.ids("udp.srcport == 4001").collect()} == set(range(1, 30, 3))
    assert s.series("ports").count() == 30 and [r[0] for r in s.packets(18, 4).select("packet_id").orderBy("packet_id").collect()] == [18, 19, 20, 21]
    assert [r[0] for r in s.matching("udp.srcport == 4000", 15, 10).select("packet_id").orderBy("packet_id").collect()] == [15, 18, 21, 24]
    snap = s.snapshot("ports")
    s.ingest(some(spark, 30, 2).drop("frame_id"))
    assert (snap.rows.count(), snap.tail(s.series("ports")).count()) == (30, 2)
    before = sorted(map(tuple, s.series("ports").collect()))
    assert s.restart() == 1 and sorted(map(tuple, s.series("ports").collect())) == before
    seen = tmp_path / "seen"
    seen.mkdir()
    at = str(seen)

    def visitor(rows):
        ids = [r["packet_id"] for r in rows]
        if ids:
            with open(f"{at}/{ids[0]}", "w") as f:
                f.write(",".join(map(str, ids)))

    s.visit(visitor, 5, 10, "udp")
    assert sorted(int(x) for f in os.listdir(at) for x in open(f"{at}/{f}").read().split(",")) == list(range(5, 15))
    s.export(str(tmp_path / "out"), "udp.srcport == 4002", names=["udp.srcport"])
    assert spark.read.parquet(str(tmp_path / "out/packets")).count() == 10


def test_session_follows_a_stream(spark, tmp_path):
    for i in range(3):
        some(spark, i * 4, 4).drop("frame_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = store.Session(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema("timestamp_ns long, link_type int, interface_id int, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s.follow(stream, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(r[0] for r in s.frames().select("frame_id").collect()) == list(range(12)) and len(s.state["batches"]) == 3


FRAMES = [(10**9 + i, bytes([i % 256]) * (i % 50 + 1)) for i in range(500)]


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_split_files_are_whole(spark, tmp_path, kind):
    data = b"".join(writers.WRITERS[kind](FRAMES, 1))
    path = tmp_path / f"a.{kind}"
    path.write_bytes(data)
    parts = captures.splits(io.BytesIO(data), kind, 4000)
    assert len(parts) > 3
    spark.dataSource.register(captures.CaptureSource)
    df = spark.read.format("capture").option("splitBytes", "4000").load(str(path))
    assert df.rdd.getNumPartitions() == len(parts)
    got = sorted((r["frame_id"], r["timestamp_ns"], bytes(r["data"])) for r in df.collect())
    assert got == [(i, t, d) for i, (t, d) in enumerate(FRAMES)]


def test_faults_are_rows(spark, tmp_path):
    data = b"".join(writers.WRITERS["pcapng"](FRAMES[:5], 1))
    (tmp_path / "cut.pcapng").write_bytes(data[:-7])
    can = [(i, struct.pack(">IB3x", i, 1) + b"x", 1) for i in range(3)]
    blf = b"".join(writers.WRITERS["blf"](can))
    (tmp_path / "bad.blf").write_bytes(blf + b"\0" * 40)
    rows = captures.read_captures(spark, str(tmp_path), faults=True).collect()
    bad = [(os.path.basename(r["source"]), r["frame_id"], r["error"].split(":")[0]) for r in rows if r["error"]]
    assert sorted(bad) == [("bad.blf", 3, "blf"), ("cut.pcapng", 4, "pcapng")]
    assert sum(r["data"] is not None for r in rows) == 7
    assert captures.read_captures(spark, str(tmp_path)).count() == 7
    with pytest.raises(Exception):
        captures.read_captures(spark, str(tmp_path), tolerant=False).count()


def test_synthetic_modes(spark):
    for mode in synthetic.MODES:
        df = synthetic.frames(spark, 32, mode)
        assert df.count() == 32
        layers = [r["protocols"] for r in packet.packets(df, ["can.id"]).orderBy("packet_id").collect()]
        want = {"ipv6": "ipv6", "udp6": "udp", "tcp6": "tcp", "tcpstream": "tcp", "tcpstream6": "tcp", "canfd": "can", "can": "can", "udp": "udp", "ipv4": "ip", "ethernet": "eth"}.get(mode)
        assert all(want in x for x in layers) if want else layers


@pytest.mark.parametrize("mode", ["tcpstream", "tcpstream6"])
def test_synthetic_streams_are_conversations(spark, mode):
    from framelake.dissect import wire
    from framelake.operators import tcp

    rows = tcp.tcp_analysis(wire.dissect(synthetic.frames(spark, 48, mode))).orderBy("packet_id").collect()
    assert {r["analysis"] for r in rows} == {""}
    assert [r["phase"] for r in rows[-3:]] == ["FIN_WAIT_1", "LAST_ACK", "TIME_WAIT"] and rows[-1]["completeness"] == 31


def test_many_sources_in_turn(spark):
    df = spark.createDataFrame([(f"s{i % 7}", i) for i in range(100)] + [("s0", 1000 + i) for i in range(20)], "source string, n long")
    few = sorted((r["source"], r["n"], r["packet_id"]) for r in merge.round_robin(df, "source", "n").collect())
    old, merge.PLAN_SOURCES = merge.PLAN_SOURCES, 3
    try:
        many = sorted((r["source"], r["n"], r["packet_id"]) for r in merge.round_robin(df, "source", "n").collect())
    finally:
        merge.PLAN_SOURCES = old
    assert few == many and sorted(x[2] for x in few) == list(range(120))


def test_running_sums(spark):
    df = spark.range(1000).withColumnRenamed("id", "packet_id")
    rows = running.summed(df, "s", df["packet_id"], "packet_id", bucket=64).collect()
    assert all(r["s"] == r["packet_id"] * (r["packet_id"] - 1) // 2 for r in rows)


def test_ids_out_of_order(spark):
    s = spark.createDataFrame([(2, 5, 0, 1.0, 0), (1, 6, 0, 2.0, 1)], "packet_id long, timestamp_ns long, occurrence int, value double, row long")
    assert tuple(series.monotone(s, "row").first()) == (False, True)
    assert tuple(series.id_span(s, 1, 2, "row").first()) == (False, None, None)
    assert tuple(series.id_span(s, 1, 2).first()) == (True, 0, 2)


def test_dataset_in_one_pass(spark, tmp_path):
    df = packet.find(frames_of(spark, [(1, ETH + ip4(17, udp(b"abc"))), (1, ETH + ip4(6, b"short"))]), "", ["packet.info", "frame.data", "udp.payload"])
    lay, out = packet.layout(), str(tmp_path / "d")
    writers.write_dataset(df, lay, out, ["udp.dstport", "ip.ttl"], buffers=["udp.payload"])
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert set(read("packets").columns) == {"packet_id", "timestamp_ns", "info", "frame_bytes"} and read("packets").count() == 2
    assert [tuple(r) for r in read(f"field_{lay.catalog.field_id('udp.dstport')}").collect()] == [(0, 0, 5000)]
    assert read("packet_buffers").first()["bytes"] == b"abc" and not [x for x in os.listdir(out) if x.startswith("_rows")]
    with pytest.raises(FileExistsError):
        writers.write_dataset(df, lay, out, ["ip.ttl"])
    writers.write_dataset(df, lay, out, ["ip.ttl"], overwrite=True)
    assert not os.path.exists(f"{out}/packet_buffers")


def test_tree_dataset_and_duckdb(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    df, lay, out = views.orders(spark, SF), views.orders_layout(), str(tmp_path / "d")
    writers.write_dataset(df, lay, out, hierarchy=True, node_ids=True)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert spark.read.parquet(f"{out}/topology").filter("name = 'line'").count() == lines
    writers.write_duckdb(out, str(tmp_path / "d.duckdb"))
    with duckdb.connect(str(tmp_path / "d.duckdb")) as con:
        assert con.execute(f"select count(*), count(distinct node_id) > 1 from field_{lay.catalog.field_id('line.qty')}").fetchone() == (lines, True)


def test_json_trees_parse(spark):
    tree = writers.json_trees(views.orders(spark, SF).limit(20), views.orders_layout()).collect()
    for r in tree:
        (top,) = json.loads(r["json"])
        assert top["name"] == "order" and all(f["name"] != "line" or len(f["fields"]) == 5 for f in top["fields"])
    pretty = writers.json_trees(views.orders(spark, SF).limit(1), views.orders_layout(), indent=True).first()["json"]
    assert "\n  " in pretty and json.loads(pretty)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcap").write_bytes(b"".join(writers.WRITERS["pcap"]([(i, ETH + ip4(17, udp(b"abc", 4000 + i))) for i in range(6)], 1)))
    (tmp_path / "in/b.asc").write_bytes(b"".join(writers.WRITERS["asc"]([(i, struct.pack(">IB3x", 7 + i, 1) + b"x", 1) for i in range(3)])))
    cli.main(["export", str(tmp_path / "in"), str(tmp_path / "flat"), "--format", "json-flat", "--filter", "can.id == 8 || udp.srcport == 4002", "--fields", "can.id,udp.srcport"], spark)
    lines = sorted(json.loads(r["value"])["can.id"] for r in spark.read.text(str(tmp_path / "flat")).collect())
    assert lines == [[], [8]]
    cli.main(["convert", str(tmp_path / "in"), str(tmp_path / "all"), "--format", "pcapng"], spark)
    assert sorted(os.listdir(tmp_path / "all")) == ["link-1", "link-227"]
    assert captures.read_captures(spark, str(tmp_path / "all/link-227")).count() == 3
    cli.main(["convert", str(tmp_path / "in"), str(tmp_path / "cut"), "--link-type", "1", "--split-packets", "5"], spark)
    assert len(os.listdir(tmp_path / "cut")) == 2
    cli.main(["settings"])
    assert json.loads(capsys.readouterr().out)["tcp_ports"]["443"] == "tls"
    cli.main(["profile", str(tmp_path / "in"), "--filter", "udp"], spark)
    assert "filter\t6" in capsys.readouterr().out
