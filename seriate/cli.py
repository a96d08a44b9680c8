"""Command line: ``python -m seriate <command>``; files are local."""

from __future__ import annotations

import argparse
import csv
import os
import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .functions import text as fmt
from .operators import alarms, report, semantics
from .params import CLI, CODINGS, PREDICTORS
from .sources import blobs, generate, text


def session() -> SparkSession:
    b = SparkSession.builder.appName("seriate").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seriate", description=__doc__)
    sub = p.add_subparsers(dest="command")

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    c = command("encode", "input", "output")
    c.add_argument("--dt", type=float, required=True)
    c.add_argument("--t0", required=True)
    c.add_argument("--unit", required=True)
    c.add_argument("--segment-mode", choices=["fixed", "adaptive"], default=CLI.segment_mode)
    c.add_argument("--segment-length", type=int, default=CLI.segment_length)
    c.add_argument("--min-segment-length", type=int, default=CLI.min_segment_length)
    c.add_argument("--max-segment-length", type=int, default=CLI.max_segment_length)
    c.add_argument("--mse-threshold", type=float, default=CLI.mse_threshold)
    c.add_argument("--predictor", choices=[*PREDICTORS, "auto"], default=CLI.predictor)
    c.add_argument("--residual-coding", choices=list(CODINGS), default=CLI.residual_coding)
    command("decode", "input", "output")
    command("info", "input").add_argument("-v", "--verbose", action="store_true")
    for name in ("export-tags", "export-motifs", "export-profile", "clusters"):
        command(name, "input", "output")
    c = command("events", "input")
    c.add_argument("output", nargs="?")
    c.add_argument("-o", "--out")
    c = sub.add_parser("batch-profile")
    c.add_argument("inputs", nargs="+")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-r", "--recursive", action="store_true")
    c = command("alarms", "input", "output")
    c.add_argument("--dt", type=float, default=60.0)
    c.add_argument("--time-column", default="timestamp")
    c.add_argument("--type-column", default="type")
    c.add_argument("--severity-column", default="severity")
    c.add_argument("--time-format")
    command("demo-data", "output")
    command("demo-alarms", "output").add_argument("--seed", type=int, default=42)
    c = command("plot-tags", "input")
    c.add_argument("--no-position", action="store_true")
    c.add_argument("--no-energy", action="store_true")
    command("plot-alarms", "input").add_argument("-o", "--output")
    return p


def _save(path: str, head: Sequence[str] | None, rows: Iterable[Sequence[str]]) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        if head:
            out.writerow(head)
        out.writerows(rows)


def _blob(spark: SparkSession, path: str) -> DataFrame:
    with open(path, "rb") as f:
        data = f.read()
    return spark.createDataFrame([(os.path.basename(path), data)], "series_id string, payload binary")


def _tagged(spark: SparkSession, path: str) -> DataFrame:
    return semantics.tags(blobs.segments(_blob(spark, path)))


def _profile_rows(payloads: DataFrame) -> list[list[str]]:
    rows = semantics.profiles(semantics.tags(blobs.segments(payloads)), blobs.metadata(payloads))
    return [fmt.profile_row(r.asDict()) for r in rows.select(*semantics.PROFILE_COLUMNS).orderBy("file").toLocalIterator()]


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.command == "encode":
        p = CLI.but(segment_mode=a.segment_mode, segment_length=a.segment_length, min_segment_length=a.min_segment_length, max_segment_length=a.max_segment_length, mse_threshold=a.mse_threshold, predictor=a.predictor, residual_coding=a.residual_coding)
        points, meta = text.series_from_text(spark, a.input, a.dt, a.t0, a.unit)
        got = blobs.encode(points, meta, p).first()
        if got is None:
            raise ValueError("an empty series cannot be encoded")
        with open(a.output, "wb") as f:
            f.write(got["payload"])
    elif a.command == "decode":
        _save(a.output, None, ([fmt.g(r["value"], 10)] for r in blobs.decode(_blob(spark, a.input)).orderBy("idx").toLocalIterator()))
    elif a.command == "info":
        b = _blob(spark, a.input)
        print("\n".join(report.lines(report.describe(blobs.metadata(b), blobs.segments(b)), os.path.basename(a.input), a.verbose)))
    elif a.command == "export-tags":
        _save(a.output, fmt.TAGS, (fmt.tag_row(r.asDict()) for r in _tagged(spark, a.input).orderBy("seg_id").toLocalIterator()))
    elif a.command == "export-motifs":
        _save(a.output, fmt.MOTIFS, (fmt.motif_row(r.asDict()) for r in semantics.motifs(_tagged(spark, a.input)).orderBy("motif_id").toLocalIterator()))
    elif a.command == "export-profile":
        _save(a.output, semantics.PROFILE_COLUMNS, _profile_rows(_blob(spark, a.input)))
    elif a.command == "batch-profile":
        rows = [[os.path.basename(r[0]), *r[1:]] for r in _profile_rows(semantics.by_path(blobs.read(spark, *a.inputs, recursive=a.recursive)))]
        if not rows:
            raise SystemExit("no encoded files found")
        _save(a.output, semantics.PROFILE_COLUMNS, rows)
    elif a.command == "events":
        if bool(a.output) == bool(a.out):
            raise SystemExit("give the output either as second argument or with -o")
        _save(a.output or a.out, ("file", "event_type"), (list(r) for r in semantics.events(text.profiles_from_csv(spark, a.input)).toLocalIterator()))
    elif a.command == "clusters":
        got = semantics.clusters(text.profiles_from_csv(spark, a.input))
        _save(a.output, got.columns, (["" if v is None else str(v) for v in r] for r in got.toLocalIterator()))
    elif a.command == "alarms":
        log = text.alarms_from_csv(spark, a.input, a.time_column, a.type_column, a.severity_column, a.time_format).cache()
        rows = alarms.intensity(log, a.dt).orderBy("bin")
        _save(a.output, ("value",), ([f"{r['value']:.6f}"] for r in rows.toLocalIterator()))
        first = log.agg(F.min("ts")).first()[0]
        print(f"--t0 {first.isoformat()} --dt {a.dt:g}" if first else "no alarms")
    elif a.command == "demo-data":
        for kind in generate.KINDS:
            _save(os.path.join(a.output, f"{kind}.csv"), ("value",), ([f"{r['value']:.6f}"] for r in generate.series(spark, kind).orderBy("idx").toLocalIterator()))
    elif a.command == "demo-alarms":
        _save(a.output, ("timestamp", "type", "severity"), ([r["ts"].isoformat(), r["type"], f"{r['severity']:g}"] for r in generate.alarms(spark, a.seed).orderBy("ts").toLocalIterator()))
    elif a.command in ("plot-tags", "plot-alarms"):
        from . import plots

        if a.command == "plot-tags":
            plots.tags(text.tags_from_csv(spark, a.input).collect(), a.input, not a.no_position, not a.no_energy)
        else:
            plots.values([r["value"] for r in text.values_from_csv(spark, a.input).collect()], a.output or a.input + ".alarms.png")


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not a.command:
        p.print_help()
        return 0
    try:
        run(a, session())
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
