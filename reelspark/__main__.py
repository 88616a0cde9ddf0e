"""Command line over media files and tables of facts.

    python -m reelspark measure FACTS.parquet MEDIA... [--prober PROGRAM]
    python -m reelspark probe FACTS.parquet [--file ID]
    python -m reelspark compare FACTS.parquet LEFT_ID RIGHT_ID [--fps-tolerance X] [--duration-tolerance X]
    python -m reelspark plan FACTS.parquet OUT.parquet --target analysis|playback
    python -m reelspark transcode FACTS.parquet OUTPUT --target analysis|playback [--allow-hardware]

measure runs the prober on the executors and writes a table of facts with the files' paths.
compare exits with 0 for duplicate, 3 distinct, 4 different timing, 5 timing unknown, 6 unminted.
transcode plans and runs the cheapest repair of each file; OUTPUT is a folder, or a file if there is one.
Any error exits with 1, and is told on the error stream.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import policy
from .functions import scalar
from .live import tools
from .operators import convert, facts, identity, planner, verdict
from .sources import media, probe_text

PROFILES = {"chrome-149": policy.PROFILE}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="reelspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    add = {name: sub.add_parser(name) for name in ("measure", "probe", "compare", "plan", "transcode")}
    for p in add.values():
        p.add_argument("facts")
    add["measure"].add_argument("media", nargs="+")
    add["measure"].add_argument("--prober", default="ffprobe")
    add["probe"].add_argument("--file", type=int)
    for side in ("left", "right"):
        add["compare"].add_argument(side, type=int)
    for what in ("fps", "duration"):
        add["compare"].add_argument(f"--{what}-tolerance", type=float)
    for name, out in (("plan", "out"), ("transcode", "output")):
        add[name].add_argument(out)
        add[name].add_argument("--target", choices=("analysis", "playback"), required=True)
        add[name].add_argument("--profile", choices=sorted(PROFILES), default="chrome-149")
        add[name].add_argument("--allow-hardware", action="store_true")
    add["transcode"].add_argument("--seconds", type=float, default=3600.0)
    return parser


def measured(spark: SparkSession, paths: list[str], prober: str) -> tuple[DataFrame, DataFrame]:
    """(facts with path, errors (path, error)) of media files."""
    files, lines = media.probed(spark, paths, prober)
    files, lines = files.cache(), lines.cache()
    heads, packets = probe_text.headers(files.where("json IS NOT NULL").select("file_id", "json")), probe_text.timed(probe_text.packets(lines))
    boxes = files.select("file_id", F.posexplode("boxes").alias("ordinal", "box_type"))
    source = packets.groupBy("file_id").agg(F.first("source").alias("source"))
    named = heads.where("error IS NULL").join(source, "file_id").withColumn("timing_source", scalar.timing_source(F.col("source"), F.col("container")))
    named = named.withColumns({c: F.col(c).cast("long") for c in identity.INTEGERS})
    table = facts.facts(heads, packets, probe_text.moov_first(boxes), identity.mint(packets, named), tools.version(prober))
    told = files.select("file_id", "path", F.col("error").alias("e1")).join(heads.select("file_id", F.col("error").alias("e2")), "file_id", "left")
    told = told.join(probe_text.scan_errors(lines).withColumnRenamed("error", "e3"), "file_id", "left").join(table.select("file_id", F.lit(True).alias("fine")), "file_id", "left")
    errors = told.where("fine IS NULL").select("path", F.coalesce("e1", "e2", "e3", F.lit("no packets")).alias("error"))
    return files.select("file_id", "path").join(table, "file_id"), errors


def planned(table: DataFrame, args: argparse.Namespace, output: str | None = None) -> DataFrame:
    profile = PROFILES[args.profile]
    if output is not None:
        to, error = planner.resolve_output(F.col("path"), F.lit(output), F.lit(os.path.isdir(output)))
        table = table.withColumns({"source": F.col("path"), "destination": to, "refused": error})
    usable = F.lit(args.allow_hardware and tools.encoder_usable(planner.AV1_HARDWARE))
    encoding = policy.ANALYSIS if args.target == "analysis" else policy.PLAYBACK
    return planner.build_command(verdict.derive(table, profile), args.target, encoding, args.allow_hardware, usable)


def transcode(table: DataFrame, args: argparse.Namespace) -> int:
    if not os.path.isdir(args.output) and table.limit(2).count() > 1:
        print("several files need a folder to go to", file=sys.stderr)
        return 1
    plans = planned(table, args, args.output)
    plans = plans.withColumn("error", F.coalesce("error", F.when(F.col("argv").isNotNull(), F.col("refused"))))
    done = convert.run_plans(plans, args.seconds).join(plans.select("file_id", "source", "operation", "encoder_name", "stream_transcode"), "file_id")
    bad = 0
    for r in done.orderBy("file_id").toLocalIterator():
        if r["error"] is not None:
            print(f"transcode of {r['source']} failed: {r['error']}", file=sys.stderr)
            bad = 1
        elif not r["performed"]:
            print(f"{r['source']} is clean for {args.target}; nothing to do")
        else:
            how = ", ".join(x for x in (r["operation"], r["encoder_name"]) if x)
            print(f"wrote {r['destination']} ({how})" + (", which was optional" if args.target == "playback" and r["stream_transcode"] == "recommended" else ""))
    return bad


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("reelspark").getOrCreate()
    if args.command == "measure":
        table, errors = measured(spark, [os.path.abspath(p) for p in args.media], args.prober)
        table.write.parquet(args.facts)
        bad = [*errors.orderBy("path").toLocalIterator()]
        for r in bad:
            print(f"probing {r['path']} failed: {r['error']}", file=sys.stderr)
        return int(bool(bad))
    table = spark.read.parquet(args.facts)
    if args.command == "probe":
        rows = facts.as_json(verdict.derive(table if args.file is None else table.where(F.col("file_id") == args.file)))
        for r in rows.toLocalIterator():
            print(r["json"])
        return 0
    if args.command == "compare":
        cols = ("content_digest", "timing_source", "fps", "duration")
        side = lambda name, i: table.where(F.col("file_id") == i).select(F.lit(0).alias("k"), *[F.col(c).alias(f"{name}_{c}") for c in cols]).limit(1)
        both = identity.compare(side("left", args.left).join(side("right", args.right), "k"), args.fps_tolerance, args.duration_tolerance)
        row = both.select("verdict", "fps_delta", "duration_delta", "fps_tolerance", "duration_tolerance").first()
        if row is None:
            print("no such file", file=sys.stderr)
            return 1
        print(json.dumps(row.asDict(), indent=2, sort_keys=True))
        return policy.EXIT_CODES[row["verdict"]]
    if args.command == "plan":
        made = planned(table.withColumns({c: F.col(c) if c in table.columns else F.lit(None).cast("string") for c in ("source", "destination")}), args)
        made.select("file_id", "operation", "argv", "encoder_name", "reasons", "error").write.parquet(args.out)
        return 0
    return transcode(table, args)


if __name__ == "__main__":
    sys.exit(main())
