"""python -m lodestrata organise|undo|journal|verify|config|generate ... ; nothing is changed without --commit."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import lifecycle, reports
from .plans import settings as conf
from .plans.settings import SettingsError
from .sources import gazetteer

USER_FILE = Path("~/.config/lodestrata/config.toml")
# Settings that the command line can give, and how each is read there.
FLAGS = {"output_dir": str, "journal_dir": str, "chunk_size": int, "date_directory_format": str, "filename_format": str, "duplicates_dir": str, "unsorted_dir": str, "default_timezone": str, "filesystem_date_warning_percent": int, "hash_threads": int, "verbose": int}
SWITCHES = {"include_location": argparse.BooleanOptionalAction, "require_exif": argparse.BooleanOptionalAction, "sidecars": argparse.BooleanOptionalAction, "no_prompt": "store_true"}


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("lodestrata", description=__doc__)
    top.add_argument("--config", help="a settings file instead of the user's and the nearest project's")
    top.add_argument("--no-config", action="store_true", help="leave settings files out; variables still count")
    what = top.add_subparsers(dest="command", required=True)
    o = what.add_parser("organise", help="plan where files go; --commit moves them")
    o.add_argument("roots", nargs="+")
    o.add_argument("--commit", action="store_true")
    o.add_argument("--no-journal", action="store_true")
    o.add_argument("--acknowledge-no-undo", action="store_true")
    o.add_argument("--places", help="places to name files by: Parquet or CSV (name, country, lat, lon), or a tab-separated gazetteer")
    o.add_argument("--countries", help="the gazetteer's table of countries, to name them in full")
    o.add_argument("--skip", action="append", dest="skip_patterns")
    for key, kind in FLAGS.items():
        o.add_argument("--" + key.replace("_", "-"), type=kind)
    for key, action in SWITCHES.items():
        o.add_argument("--" + key.replace("_", "-"), action=action, default=None)
    u = what.add_parser("undo", help="put a run's files back")
    u.add_argument("library")
    u.add_argument("--run")
    u.add_argument("--commit", action="store_true")
    u.add_argument("--journal-dir")
    j = what.add_parser("journal", help="list runs or show one")
    j.add_argument("action", choices=("list", "show"))
    j.add_argument("library")
    j.add_argument("run", nargs="?")
    j.add_argument("--journal-dir")
    v = what.add_parser("verify", help="hold duplicates against their originals")
    v.add_argument("directory")
    v.add_argument("--digest", choices=("sha512", "blake3"), default="sha512", help="blake3 reads parts of a large file side by side")
    c = what.add_parser("config", help="show settings and where they come from, what was looked for, check files, or write a starter file")
    c.add_argument("action", choices=("show", "path", "validate", "init"))
    c.add_argument("path", nargs="?", help="the file to check or to write")
    c.add_argument("--project", action="store_true", help="write the starter into this directory instead of the user's")
    c.add_argument("--force", action="store_true")
    g = what.add_parser("generate", help="write a library of small media for trials")
    g.add_argument("directory")
    g.add_argument("--profile", default="realistic")
    g.add_argument("--seed", type=int, default=42)
    return top


def load(args: argparse.Namespace) -> conf.Loaded:
    return conf.load(args.config, args.no_config, USER_FILE.expanduser(), Path.cwd())


def resolve(args: argparse.Namespace, loaded: conf.Loaded | None = None) -> conf.Settings:
    """The settings of all layers for these arguments."""
    own = {k: getattr(args, k, None) for k in (*FLAGS, *SWITCHES, "skip_patterns")}
    return (loaded or load(args)).resolve({k: conf.validate(k, x, "--" + k.replace("_", "-") + ": ") for k, x in own.items() if x is not None})


def configure(args: argparse.Namespace) -> list[str]:
    """What the config commands print."""
    if args.action == "init":
        at = Path(args.path) if args.path else Path.cwd() / conf.FILES[0] if args.project else USER_FILE.expanduser()
        conf.write_starter(at, args.force)
        return [str(at)]
    if args.action == "validate" and args.path:
        return conf.validation_report(conf.load(args.path, variables={}))
    loaded = load(args)
    return conf.report(resolve(args, loaded)) if args.action == "show" else conf.search_report(loaded, args.no_config) if args.action == "path" else conf.validation_report(loaded)


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lodestrata").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ask(chunk: int) -> bool:
    """Whether to go on with the next chunk, asked at a terminal."""
    return input(f"chunk {chunk + 1}: move it? [y/N] ").strip().lower() in ("y", "yes")


def organise(args: argparse.Namespace, settings: conf.Settings) -> int:
    lifecycle.refuse_unsafe(args.commit, not args.no_journal, args.acknowledge_no_undo)
    spark, v = session(), settings.values
    places = None
    if args.places:
        places = gazetteer.load(spark, args.places, args.countries)
    made = lifecycle.plan(spark, args.roots, settings, places)
    dates, counts = made.dates(), dict(made.counts)
    print(reports.banner(args.commit))
    if v["verbose"]:
        print("\n".join(conf.report(settings)))
    for line in (*reports.duplicate_lines(made), *reports.orphan_lines(made.orphans)):
        print(line)
    if not args.commit:
        for line in reports.plan_lines(made):
            print(line)
        counts["organised"] = made.moves["organised"]
        print("\n".join([*reports.summary(counts, dates, v["filesystem_date_warning_percent"]), "Nothing was moved: this was a preview"]))
        return 0
    go_on = None if v["no_prompt"] or not sys.stdin.isatty() else ask
    done, at = lifecycle.commit(made, sys.argv[1:], go_on, not args.no_journal)
    counts |= {"organised": done.moved - done.sidecars, "sidecars_moved": done.sidecars, "unprocessed": done.unprocessed, "errors": done.failed}
    print("\n".join(reports.summary(counts, dates, v["filesystem_date_warning_percent"], at)))
    return 1 if done.failed or done.unprocessed else 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        if args.command == "generate":
            from .sources import generator

            print(f"{generator.write(args.directory, args.profile, args.seed)} files in {args.directory}")
            return 0
        if args.command == "verify":
            verdicts, code = lifecycle.check_duplicates(session(), args.directory, args.digest)
            for line in reports.verdict_lines(verdicts):
                print(line)
            return code
        if args.command == "config":
            print("\n".join(configure(args)))
            return 0
        settings = resolve(args)
        if args.command == "organise":
            return organise(args, settings)
        where = args.journal_dir or lifecycle.journal_dir(os.path.abspath(args.library), settings)
        if args.command == "undo":
            done = lifecycle.take_back(session(), where, args.run, args.commit, tell=lambda line: print(line))
            print("\n".join(reports.restored(done, args.commit)))
            return done.exit_code if args.commit else 0
        if args.action == "list":
            print("\n".join(reports.runs(lifecycle.recorded_runs(session(), where))))
        else:
            for line in reports.run_detail(*lifecycle.run_detail(session(), where, args.run)):
                print(line)
        return 0
    except (SettingsError, ValueError, OSError, PySparkException) as e:
        print(f"lodestrata: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
