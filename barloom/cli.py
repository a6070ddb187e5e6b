"""Commands for spark-submit: resample, structure, synthetic, overlay, search, payloads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators
from barloom.operators import bars as bar
from barloom.operators.layers import FIELDS, Settings, layer
from barloom.operators.overlay import overlays
from barloom.operators.structure_df import search
from barloom.sources import tables, vendor


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="barloom")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        return p

    command("resample", "source", "target").add_argument("--tf", required=True)
    p = command("structure", "source", "target")
    p.add_argument("--layer", choices=sorted(FIELDS), default="strokes")
    p.add_argument("--mode", choices=["wide", "strict", "new"], default="wide")
    p.add_argument("--segments", choices=["v0", "v1"], default="v1")
    p = command("synthetic", "source", "target", "a", "b")
    p.add_argument("--kind", choices=["spread", "ratio"], default="spread")
    p = command("indicator", "source", "target", "name")
    p.add_argument("--param", action="append", default=[], metavar="name=value")
    command("overlay", "source", "target").add_argument("--limit", type=int)
    command("search", "folder", "text")
    p = command("payloads", "target", "fetch", "symbols")
    p.add_argument("--throttle", type=float, default=vendor.THROTTLE)
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The table that a command makes."""
    if args.command == "search":
        return search(tables.listing(spark, args.folder), args.text, ["symbol", "name"])
    if args.command == "payloads":
        return vendor.series_bars(vendor.fetched(spark, args.symbols.split(","), args.fetch, args.throttle))
    bars = tables.read_bars(spark, args.source)
    if bars is None:
        raise FileNotFoundError(args.source)
    if args.command == "resample":
        return bar.resample(bars, args.tf)
    if args.command == "structure":
        return layer(bars, args.layer, Settings(stroke_mode=args.mode, segments=args.segments))
    if args.command == "synthetic":
        make = bar.spread if args.kind == "spread" else bar.ratio
        return make(*[bars.where(F.col("stream_id") == s) for s in (args.a, args.b)], f"{args.a}_{args.b}_{args.kind}")
    if args.command == "indicator":
        return indicators.compute(bars, args.name, dict(p.split("=", 1) for p in args.param))
    return overlays(bars, limit=args.limit)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"barloom {args.command}").getOrCreate()
    made = run(spark, args)
    if getattr(args, "target", None):
        made.write.mode("overwrite").parquet(args.target)
    else:
        made.show(100, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
