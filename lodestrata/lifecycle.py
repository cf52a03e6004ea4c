"""Organise, undo and verify: the operators put together over directories of media.

Executors scan, digest, read metadata, plan, move files and take them back; what the driver sees of a run is a row a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dates, geo, names, paths
from .operators import cascade, ledger, pairing, tallies, tree_digest, verify
from .plans import moves, sink, target, undo
from .plans.settings import Settings, SettingsError
from .runtime import cut, measured, ready
from .sources import journal, manifest, media, readers, xmp

ORDER = ["phase", "group", "depth", "key"]


@dataclass
class Plan:
    """A plan's rows in no particular order, the counters of what led to it, and where it goes."""

    rows: DataFrame
    counts: dict[str, int]
    output: str
    settings: Settings
    #: Companions without a file: path and reason.
    orphans: DataFrame | None = None
    #: How many rows there are (moves), and how many of them are filed (organised).
    moves: dict[str, int] | None = None

    def ordered(self) -> DataFrame:
        """Duplicates by group and member, then the rest by path."""
        return self.rows.orderBy(*ORDER)

    def dates(self):
        """The tally of date sources over files that are filed, with its warning."""
        filed = self.rows.where("phase = 1")
        return tallies.warning(tallies.date_sources(filed), self.settings.values["filesystem_date_warning_percent"]).first()


def machine_zone() -> str | None:
    """The IANA name of this machine's zone, if it says one."""
    if found := os.environ.get("TZ", "").lstrip(":"):
        return found
    at = os.path.realpath("/etc/localtime")
    return at.split("/zoneinfo/", 1)[1] if "/zoneinfo/" in at else None


def output_of(roots: list[str], settings: Settings) -> str:
    return os.path.abspath(settings.values["output_dir"] or roots[0])


def journal_dir(output: str, settings: Settings) -> str:
    return settings.values["journal_dir"] or os.path.join(output, paths.METADATA_DIR, "journal")


@F.arrow_udf(xmp.STRUCT)
def _xmp_at(path: pa.Array) -> pa.Array:
    def content(p: str) -> bytes | None:
        try:
            with open(p, "rb") as f:
                return f.read(xmp.LIMIT + 1)
        except OSError:
            return None

    return xmp.read(content(p) for p in path.to_pylist())


#: Tasks that read files at a time unless the settings say otherwise: more wait for the device rather than use it.
READERS = 8


def readers_at_once(spark: SparkSession, settings: Settings) -> int:
    return settings.values["hash_threads"] or max(1, min(spark.sparkContext.defaultParallelism, READERS))


def _listing(batches):
    """(directory, name) of what the directories hold already."""
    for pdf in batches:
        held = [(d, n) for d in pdf["directory"] if os.path.isdir(d) for n in os.listdir(d)]
        yield pd.DataFrame(held, columns=["directory", "name"])


def _read_dates(files: DataFrame, paired: DataFrame, settings: Settings) -> DataFrame:
    """Adds ts, date_source, tz_source, lat and lon to ``files(path, kind, size, mtime, birthtime)``."""
    configured = settings.values["default_timezone"]
    zone = configured or machine_zone() or "UTC"
    taken_from = "configured" if configured else "system" if machine_zone() else "utc"
    dated = paired.where("parent is not null and lower(path) like '%.xmp'").select("parent", "path", _xmp_at("path")["naive"].alias("naive"))
    by_parent = dated.groupBy(F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.struct("path", "naive"))).alias("x")).select("path", F.col("x.naive").alias("companion_dates"))
    m = files.withColumn("m", readers.metadata_udf("path", "kind")).join(by_parent, "path", "left")
    kind = F.coalesce("m.kind", F.when(F.col("m.offset_s").isNotNull(), "zoned").otherwise("wall_clock"))
    m = m.withColumn("r", dates.resolve(kind, F.col("m.naive"), F.col("m.offset_s"), zone))
    own = F.when(dates.representable(F.col("r.local_ts")), F.col("r.local_ts"))
    status = F.when(own.isNull() & (F.col("m.status") == "ok"), "unreadable").otherwise(F.col("m.status"))
    on_disk = F.convert_timezone(F.current_timezone(), F.lit(zone), F.coalesce("birthtime", "mtime").cast("timestamp_ntz"))
    said = F.coalesce("companion_dates", F.array().cast("array<timestamp_ntz>"))
    picked = dates.prioritised(own, said, on_disk, dates.fallback_source(status, F.lit(False), F.col("size")))
    m = m.withColumn("p", picked)
    zoned = F.when((F.col("p.source") == "exif") & (F.col("r.tz_source") == "recorded"), "recorded").otherwise(taken_from)
    return m.select(*files.columns, F.col("p.ts").alias("ts"), F.col("p.source").alias("date_source"), zoned.alias("tz_source"), F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"))


def plan(spark: SparkSession, roots: list[str], settings: Settings, places: DataFrame | None = None) -> Plan:
    """What organising ``roots`` would do; nothing is changed.

    Rows: phase (0 duplicates, 1 the rest), group (-1 for the rest), source, destination, size, hash,
    copies, original, companions, and for the rest ts, date_source, tz_source, unsorted, has_location.
    A path that overlapping roots list twice counts once. Names carry a place only if ``places(name,
    country, lat, lon)`` is given. Group numbers go on after the directories that an earlier run left.
    """
    v, output = settings.values, output_of(roots, settings)
    entries = media.scan(ready(spark), [os.path.abspath(r) for r in roots], v["skip_patterns"], v["sidecars"], **v["extensions"]).dropDuplicates(["path", "status"])
    listed, scanned = measured(entries, scan_skipped=F.count_if(F.col("status") == "unreadable"), excluded=F.count_if(F.col("status") == "excluded"))
    files = listed.where("status = 'ok' and kind <> 'sidecar'").select("path", "size", "extension", "kind", "mtime", "birthtime")
    parent = F.col("parent")
    paired, sides = measured(pairing.pair(files, listed.where("status = 'ok' and kind = 'sidecar'").select("path")), sidecars_found=F.count_if(parent.isNotNull()), sidecar_orphans=F.count_if(parent.isNull()))
    role = F.col("role")
    classified, read = measured(
        cascade.classify_paths(files, threads=readers_at_once(spark, settings)), scanned=F.count(F.lit(1)), duplicate_groups=F.count_if(role == "original"), duplicate_files=F.count_if(role == "duplicate"), hash_skipped=F.count_if(role == "skipped")
    )
    key = {"depth": F.size(paths.components(F.col("path"))), "key": F.translate("path", "/", "\0")}
    again = classified.where("role = 'duplicate'").join(cascade.groups(classified).select(F.col("hash").alias("known_hash"), "number"), "known_hash")
    group = (F.col("number") + _next_group(os.path.join(output, v["duplicates_dir"]))).cast("int")
    duplicates = again.withColumns(key).select(
        F.lit(0).alias("phase"), group.alias("group"), "depth", "key", "path", "size", F.col("known_hash").alias("hash"), (F.col("copies") - 1).alias("copies"), F.col("original_path").alias("original"),
        F.concat(F.lit(f"{output}/"), cascade.group_directory(group, v["duplicates_dir"])).alias("directory"), paths.file_name(F.col("path")).alias("name"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("date_source"), F.lit(None).cast("string").alias("tz_source"), F.lit(False).alias("unsorted"), F.lit(False).alias("has_location"),
    )
    rest = cut(_read_dates(classified.where("role in ('unique', 'original')"), paired, settings))
    nowhere = [F.lit(None).cast("string").alias(c) for c in ("place", "country")]
    placed = rest.select("*", *nowhere) if places is None or not v["include_location"] else rest.join(geo.nearest(rest, places, "path"), "path", "left")
    named = placed.withColumns({**key, "original_stem": paths.stem(paths.file_name(F.col("path"))), "ext": F.col("extension")})
    layout = target.Layout(v["date_directory_format"], v["filename_format"], v["unsorted_dir"], v["include_location"], v["require_exif"])
    filed = target.target(named, layout).select(
        F.lit(1).alias("phase"), F.lit(-1).alias("group"), "depth", "key", "path", "size", F.col("known_hash").alias("hash"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("original"),
        F.concat(F.lit(f"{output}/"), F.col("directory")).alias("directory"), "name", "ts", "date_source", "tz_source", "unsorted", "has_location",
    )
    planned = cut(duplicates.unionByName(filed))
    existing = planned.select("directory").distinct().mapInPandas(_listing, "directory string, name string")
    settled = ledger.assign(planned, ORDER, existing)
    companions = pairing.for_parents(settled, paired)
    rows = settled.join(companions, "path").select("*", F.concat("directory", F.lit("/"), "final_name").alias("destination")).withColumnRenamed("path", "source").drop("directory", "name", "final_name")
    rows, moves = measured(rows, moves=F.count(F.lit(1)), organised=F.count_if(F.col("phase") == 1))
    return Plan(rows, scanned | sides | read, output, settings, paired.where("parent is null").select("path", "reason"), moves)


def _next_group(directory: str) -> int:
    held = os.listdir(directory) if os.path.isdir(directory) else []
    return max((int(n) + 1 for n in held if re.fullmatch(r"\d+", n)), default=0)


def commit(made: Plan, argv: list[str] = (), go_on=None, journaled: bool = True) -> tuple[sink.Outcome, Path | None]:
    """Carries a plan out; returns what happened and the journal's path.

    Every group's manifest is on disk before the first move. Tasks write the manifests, move the files and record what they
    do, so the journal is ahead of the disk everywhere. ``go_on`` is asked before each chunk, if there is somebody to ask.
    Without a journal nothing can be undone.
    """
    v = made.settings.values
    run, log, at = names.run_id(), None, None
    if journaled:
        where = Path(journal_dir(made.output, made.settings))
        where.mkdir(parents=True, exist_ok=True)
        at = where / f"{run}.jsonl"
        log = journal.Writer(at, run, datetime.now(timezone.utc).isoformat(), made.output, list(argv))
    duplicates = os.path.join(made.output, v["duplicates_dir"])
    try:
        if made.counts["duplicate_files"]:
            manifest.write(manifest.intended(made.rows.where("phase = 0")), duplicates).count()
        done = moves.carry_out(made.rows, ORDER, log, duplicates, v["chunk_size"], go_on, made.moves["moves"])
    finally:
        if log:
            log.close()
    return done, at


def pick_run(directory: str, run: str | None) -> Path:
    """The journal of ``run``, or of the newest run."""
    found = journal.newest_first(directory)
    found = [p for p in found if p.stem == run] if run else found
    if not found:
        raise journal.JournalError(f"no run {run} is recorded in {directory}" if run else f"no runs are recorded in {directory}")
    return found[0]


def header(path: Path) -> dict:
    with open(path, encoding="utf-8") as f:
        try:
            return json.loads(f.readline())
        except ValueError as e:
            raise journal.JournalError(f"{path.name}: no header") from e


@dataclass
class Undone:
    """Steps by status of a preview, or counters of a restore; what stayed unresolved; what the restore fell short of."""

    counts: dict[str, int]
    unresolved: int
    shortfall: str | None
    journal: Path | None = None

    @property
    def exit_code(self) -> int:
        return 1 if self.shortfall or self.unresolved else 0


def _statuses(batches):
    """Steps with whether what they would take back is as it was left."""
    for pdf in batches:
        found = [sink.verify_step(d, None if pd.isna(n) else int(n), h) for d, n, h in zip(pdf["destination"], pdf["size"], pdf["hash"], strict=True)]
        yield pdf[["line_no", "source", "destination"]].assign(status=found)


def take_back(spark: SparkSession, directory: str, run: str | None = None, commit: bool = False, tell=lambda line: None) -> Undone:
    """Previews, or with ``commit`` carries out, the undoing of a run recorded in ``directory``; the restore is journaled too.

    ``tell`` gets a line for each step of a preview and for each move without an outcome.
    """
    path = pick_run(directory, run)
    root = header(path)["output_dir"]
    entries = cut(journal.read(ready(spark), str(path)))
    steps = [] if not entries.take(1) else undo.restore_plan(entries)
    lost = 0
    for r in undo.unresolved(entries).orderBy("line_no").toLocalIterator():
        lost += 1
        tell(f"no outcome recorded: {r.source} -> {r.destination}")
    if not steps or not steps.take(1):
        return Undone({}, lost, None)
    if not commit:
        kind = "line_no int, source string, destination string, status string"
        looked = cut(steps.select("line_no", "source", "destination", "size", "hash").mapInPandas(_statuses, kind))
        for s in looked.orderBy(F.desc("line_no")).toLocalIterator():
            tell(f"{s.status}: {s.destination} -> {s.source}")
        return Undone({r.status: r["count"] for r in looked.groupBy("status").count().collect()}, lost, None)
    own = names.run_id()
    at = Path(directory) / f"{own}.jsonl"
    log = journal.Writer(at, own, datetime.now(timezone.utc).isoformat(), root, ["undo", path.stem])
    try:
        counts = moves.take_back(steps, log, root)
    finally:
        log.close()
    short = [f"{counts[k]} {label}" for k, label in tallies.SHORTFALLS.items() if counts.get(k)]
    return Undone(counts, lost, ", ".join(short) or None, at)


def run_detail(spark: SparkSession, directory: str, run: str | None = None):
    """What ``reports.run_detail`` shows of a run, or of the newest: header, counters, steps, intents without an outcome."""
    path = pick_run(directory, run)
    entries = cut(journal.read(ready(spark), str(path)))
    return header(path), undo.runs(entries).first(), undo.restore_plan(entries), undo.unresolved(entries)


def recorded_runs(spark: SparkSession, directory: str) -> list[dict]:
    """The runs in ``directory``, newest first; one that can't be read is a row with what is wrong. All journals are read at once."""
    found = journal.newest_first(directory)
    if not found:
        return []
    numbered = cut(journal.run_lines(ready(spark), f"{directory}/*.jsonl"))
    states = {r.run_id: r for r in journal.state(numbered).collect()}  # one row a run
    made = {r.run_id: r for r in undo.runs(journal.parse(numbered).where("corrupt is null")).collect()}
    out = []
    for p in found:
        state, run = states.get(p.stem), made.get(p.stem)
        try:
            if wrong := journal.fault(state) if state else "no header":
                raise journal.JournalError(f"{p.stem}: {wrong}")
            out.append({"run_id": p.stem, "started_at": header(p)["started_at"], "n_restorable": run.n_restorable if run else 0, "interrupted": run.interrupted if run else True, "error": None})
        except (journal.JournalError, KeyError) as e:
            out.append({"run_id": p.stem, "started_at": None, "n_restorable": 0, "interrupted": True, "error": str(e)})
    return out


def _keyed(path: str | None) -> str | None:
    """The verification digest of a file, or null where there is none to read."""
    if path is None or not os.path.isfile(path):
        return None
    h = hashlib.sha512(verify.KEY)
    with open(path, "rb") as f:
        while block := f.read(1 << 17):
            h.update(block)
    return h.hexdigest()


@F.pandas_udf(T.StringType())
def _keyed_udf(path: pd.Series) -> pd.Series:
    return path.map(_keyed)


def _members(batches):
    """(group_id, is_copy, path) of group directories that have a manifest."""
    for pdf in batches:
        rows = []
        for d in pdf["directory"]:
            at = os.path.join(d, manifest.NAME)
            if not os.path.isfile(at):
                continue
            with open(at, encoding="utf-8", errors="replace") as f:
                rows.append((os.path.basename(d), False, manifest.original_of(f)))
            rows += [(os.path.basename(d), True, e.path) for e in os.scandir(d) if e.is_file() and e.name != manifest.NAME]
        yield pd.DataFrame(rows, columns=["group_id", "is_copy", "path"])


def _sized(batches):
    """(path, size) of files that are there."""
    for pdf in batches:
        held = [(p, os.path.getsize(p)) for p in pdf["path"] if p is not None and os.path.isfile(p)]
        yield pd.DataFrame(held, columns=["path", "size"])


def check_duplicates(spark: SparkSession, directory: str, digest: str = "sha512") -> tuple[DataFrame, int]:
    """Verdicts of the group directories under ``directory``, by a digest that dedup does not use, and the exit code.

    ``sha512`` reads a file in one task; ``blake3`` reads parts of it in many.
    """
    groups = sorted(e.path for e in os.scandir(directory) if e.is_dir())
    held = ready(spark).createDataFrame([(g,) for g in groups], "directory string").mapInPandas(_members, "group_id string, is_copy boolean, path string")
    if digest == "blake3":
        held = cut(held)
        taken = tree_digest.tree_digests(held.select("path").distinct().mapInPandas(_sized, "path string, size long"), tree_digest.KEY)
        met = cut(held.join(taken.select("path", "digest"), "path", "left"))
    else:
        met = cut(held.withColumn("digest", _keyed_udf("path")))
    verdicts = cut(verify.group_verdicts(met.where("not is_copy"), met.where("is_copy")))
    return verdicts.orderBy("group_id"), verify.exit_code(verdicts)


def refuse_unsafe(commit: bool, journaled: bool, acknowledged: bool) -> None:
    if commit and not journaled and not acknowledged:
        raise SettingsError("committing without a journal has to be acknowledged")
