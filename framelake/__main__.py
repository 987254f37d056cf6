"""Command line: `python -m framelake convert|export|profile|fields|layers|settings`.

    convert IN OUT --format pcapng            capture files to capture files of another format
    export IN OUT --format parquet --filter "udp.port == 53" --fields ip.src,ip.dst
    profile IN --filter "tcp"                 how long reading and filtering take
    settings --settings FILE                  the tables from ports to layers, with those of a file
    fields [PREFIX]                           names, types and protocols that filters know
    layers --plugin my_module                 application layers, with those of modules that register more
"""

from __future__ import annotations

import argparse
import importlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.dissect import app, packet, wire
from framelake.operators import merge, projection
from framelake.sinks import writers
from framelake.sources import captures


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="framelake", description=__doc__.split("\n")[0])
    verbs = parser.add_subparsers(dest="verb", required=True)
    convert, export = verbs.add_parser("convert"), verbs.add_parser("export")
    for p in (convert, export):
        p.add_argument("source")
        p.add_argument("target")
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--strict", action="store_true", help="stop at a fault instead of leaving out what follows it")
        p.add_argument("--max-packets", type=int)
    convert.add_argument("--format", choices=sorted(writers.WRITERS), default="pcapng")
    convert.add_argument("--link-type", type=int, help="only frames of this link type; by default each has a folder of its own where there are several")
    convert.add_argument("--split-packets", type=int, help="packets of a folder")
    convert.add_argument("--split-bytes", type=int, help="bytes of the frames of a folder")
    export.add_argument("--format", choices=("parquet", "csv", "json", "json-flat", "json-tree", "text"), default="parquet")
    export.add_argument("--fields", default="", help="names with commas between; those of the fixed headers by default")
    export.add_argument("--occurrences", choices=("all", "first", "last"), default="all")
    export.add_argument("--codec", choices=writers.CODECS, default="zstd")
    profile = verbs.add_parser("profile")
    profile.add_argument("source")
    profile.add_argument("--strict", action="store_true")
    for p in (export, profile):
        p.add_argument("--filter", default="")
        p.add_argument("--plugin", action="append", default=[])
        p.add_argument("--settings", help="a JSON file, as `settings` prints it")
        p.add_argument("--reassemble", action="store_true", help="put fragments together first")
    verbs.add_parser("fields").add_argument("prefix", nargs="?", default="")
    verbs.add_parser("layers").add_argument("--plugin", action="append", default=[])
    verbs.add_parser("settings").add_argument("--settings")
    return parser


def settings(file: str | None = None) -> dict:
    """The tables that lead from ports to layers; a file's entries take the place of those that stand there."""
    if file:
        with open(file, encoding="utf-8") as f:
            given = json.load(f)
        unknown = set(given) - {"udp_ports", "tcp_ports"}
        if unknown:
            raise SystemExit(f"unknown settings: {', '.join(sorted(unknown))}")
        for table, name in ((wire.UDP_PORTS, "udp_ports"), (wire.TCP_PORTS, "tcp_ports")):
            for port, layer in given.get(name, {}).items():
                if layer is not None and layer not in app.REGISTRY:
                    raise SystemExit(f"no layer {layer}")
                table.pop(int(port), None)
                if layer is not None:
                    table[int(port)] = layer
    return {"udp_ports": {str(k): v for k, v in sorted(wire.UDP_PORTS.items())}, "tcp_ports": {str(k): v for k, v in sorted(wire.TCP_PORTS.items())}}


def frames_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Frames of all files, numbered from 0 by taking one of each file in turn."""
    found = captures.read_captures(spark, args.source, tolerant=not args.strict)
    return merge.round_robin(found, "source", "frame_id").withColumnRenamed("packet_id", "merged_id")


def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    spark.dataSource.register(writers.CaptureSink)
    out = frames_of(spark, args)
    if args.link_type is not None:
        out = out.filter(f"link_type = {args.link_type}")
    if args.max_packets is not None:
        out = merge.limit_matches(out, args.max_packets, "merged_id")
    links = [args.link_type] if args.link_type is not None else sorted(r[0] for r in out.select("link_type").distinct().collect())
    split = merge.parts(out, args.split_packets, "merged_id") if args.split_packets else merge.parts_by_bytes(out, "data", args.split_bytes, "merged_id") if args.split_bytes else None
    numbers = sorted(r[0] for r in split.select("part").distinct().collect()) if split is not None else [None]
    for link in links:
        for number in numbers:
            some = (out if number is None else split.filter(f"part = {number}")).filter(f"link_type = {link}")
            target = args.target + (f"/link-{link}" if len(links) > 1 else "") + (f"/part-{number:05d}" if number is not None else "")
            rows = some.orderBy("merged_id").select("timestamp_ns", "data", "interface_id")
            rows.write.format("capture_file").option("format", args.format).option("link_type", str(link)).mode("overwrite" if args.overwrite else "append").save(target)


def kept_packets(spark: SparkSession, args: argparse.Namespace, names: list[str]) -> DataFrame:
    frames = frames_of(spark, args).drop("frame_id").withColumnRenamed("merged_id", "frame_id")
    return packet.find(frames, args.filter, names, datagrams=args.reassemble)


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    layout = packet.layout()
    names = [n for n in args.fields.split(",") if n] or list(wire.FIELDS)
    layout.catalog.select(names)
    tree = ["nodes"] if args.format == "json-tree" else []
    kept = kept_packets(spark, args, [*names, *tree])
    if args.max_packets is not None:
        kept = merge.limit_matches(kept, args.max_packets)
    mode = "overwrite" if args.overwrite else "errorifexists"
    if args.format == "parquet":
        writers.write_dataset(kept, layout, args.target, names, args.occurrences, codec=args.codec, overwrite=args.overwrite)
    elif args.format == "csv":
        projection.wide_rows(kept, layout, names).write.mode(mode).csv(args.target, header=True)
    elif args.format == "json":
        kept.select("packet_id", "timestamp_ns", "protocols", *[f"`{n}`" for n in names]).write.mode(mode).json(args.target)
    elif args.format == "json-tree":
        plain, trees = writers.json_flat(kept, layout, names), writers.json_trees(kept, layout)
        both = plain.withColumnRenamed("json", "fields").join(trees.withColumnRenamed("json", "layers"), "packet_id")
        both.select(F.concat(F.lit('{"packet":'), F.col("packet_id").cast("string"), F.lit(',"fields":'), F.col("fields"), F.lit(',"layers":'), F.col("layers"), F.lit("}")).alias("value")).write.mode(mode).text(args.target)
    elif args.format == "json-flat":
        writers.json_flat(kept, layout, names).select("json").write.mode(mode).text(args.target)
    else:
        writers.text_flat(kept, layout, names).select("text").write.mode(mode).text(args.target)


def profile(spark: SparkSession, args: argparse.Namespace) -> None:
    """Seconds and frames a second of reading, and of reading and filtering."""
    for name, df in (("read", frames_of(spark, args)), ("filter", kept_packets(spark, args, []))):
        start = time.perf_counter()
        n = df.select("data").count() if name == "read" else df.select("packet_id").count()
        seconds = time.perf_counter() - start
        print(f"{name}\t{n}\t{seconds:.3f} s\t{n / seconds:.0f} a second")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments().parse_args(argv)
    if args.verb == "fields":
        for f in packet.layout().catalog.fields.values():
            if f.name.startswith(args.prefix):
                print(f"{f.name}\t{f.type.name}\t{f.ui_name}")
    elif args.verb == "layers":
        for module in args.plugin:
            importlib.import_module(module)
        print("\n".join(sorted(app.REGISTRY)))
    elif args.verb == "settings":
        print(json.dumps(settings(args.settings), indent=2))
    else:
        for module in getattr(args, "plugin", []):
            importlib.import_module(module)
        settings(getattr(args, "settings", None))
        spark = spark or SparkSession.builder.appName("framelake").getOrCreate()
        {"convert": convert, "export": export, "profile": profile}[args.verb](spark, args)


if __name__ == "__main__":
    main()
