"""Text reports of plans, runs, restores and verdicts, a list of lines each."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import functions as F

from .functions import names, paths
from .operators import cascade, numbering

# The summary's labels, in order; those in the second table are left out while their figure is zero.
ALWAYS = {"scanned": "Files scanned:", "organised": "Files organised:", "duplicate_groups": "Duplicate groups:", "duplicate_files": "Duplicate files:"}
NONZERO = {"scan_skipped": "Skipped while scanning:", "hash_skipped": "Skipped while reading:", "excluded": "Excluded by pattern:"}
SIDECARS = {"sidecars_found": "Sidecars found:", "sidecars_moved": "Sidecars moved:", "sidecar_orphans": "Sidecars without a file:"}
LAST = {"unprocessed": "Not processed:", "errors": "Errors:"}


def _line(label: str, value) -> str:
    return f"  {label:<26}{value}"


def banner(commit: bool) -> str:
    return "Moving files; every move is recorded first" if commit else "Preview: nothing is changed without --commit"


def _some(df, most: int, more: str, total: int | None = None):
    """At most ``most`` rows, then, if there are others, how many: the text ``more`` with their number; they are counted only then."""
    rows = df.toLocalIterator()
    yield from islice(rows, most)
    if next(rows, None) is not None:
        yield more.format((df.count() if total is None else total) - most)


def duplicate_lines(made, most: int = 1000):
    """Each group of copies: its digest, the file that stays and those that go; after ``most`` lines, how many are left."""
    group = None
    for r in _some(made.rows.where("phase = 0").orderBy("group", "depth", "key"), most, "    ... and {} more copies", made.counts["duplicate_files"]):
        if isinstance(r, str):
            yield r
            continue
        if r.group != group:
            group = r.group
            yield f"Group {r.group:03d}  {r.hash[:16]}  {r.size} bytes, {r.copies + 1} files"
            yield f"    stays {r.original}"
        yield f"    goes  {r.source}"


def duplicate_rows(classified):
    """``duplicate_lines`` of classified files as rows (number, line_no, line), however many there are: no group is gathered."""
    groups = cascade.groups(classified)
    head = F.format_string("Group %03d  %s  %d bytes, %d files", "number", names.abbreviate(F.col("hash"), 16), "size", "copies")
    first = groups.select("number", F.posexplode(F.array(head, F.concat(F.lit("    stays "), "original"))).alias("n", "line")).select("number", (F.col("n") + 1).cast("long").alias("line_no"), "line")
    goes = classified.where("role = 'duplicate'").join(groups.select(F.col("hash").alias("known_hash"), "number"), "known_hash").select("number", "path", F.size(paths.components(F.col("path"))).alias("depth"), paths.components(F.col("path")).alias("parts"))
    rest = numbering.ranked(goes, ["number"], ["depth", "parts"], "n").select("number", F.col("n") + 3, F.concat(F.lit("    goes  "), "path"))
    return first.union(rest)


# Why a companion has no file.
REASONS = {"no_parent": "no file of that name", "ambiguous": "more than one file of that name"}


def orphan_lines(orphans, most: int = 1000):
    """Companions that stay where they are, with the reason; after ``most`` lines, how many are left."""
    if orphans is None:
        return
    for r in _some(orphans.orderBy("path"), most, "Left alone: {} more"):
        yield r if isinstance(r, str) else f"Left alone: {r.path} ({REASONS.get(r.reason, r.reason)})"


def run_detail(head: dict, run, steps, unresolved, most: int = 1000):
    """A recorded run: when and how it was called, its counters, each step that can be taken back, each intent without an outcome; of both at most ``most``, then how many are left."""
    yield f"Run {head.get('run_id')}"
    yield _line("Started:", head.get("started_at"))
    yield _line("Output:", head.get("output_dir"))
    yield _line("Arguments:", " ".join(head.get("argv") or []))
    if run is None:
        yield "  Nothing is recorded"
        return
    yield _line("Can be restored:", run.n_restorable)
    yield "  Interrupted: it has no completion" if run.interrupted else _line("Moved, failed, skipped:", f"{run.moved}, {run.failed}, {run.skipped}")
    for r in _some(steps, most, "  ... and {} more", run.n_restorable):
        yield r if isinstance(r, str) else f"  {r.destination} -> {r.source}" + (f"  {names_abbreviated(r.hash)}" if r.hash else "")
    for r in _some(unresolved, most, "  no outcome recorded: {} more"):
        yield r if isinstance(r, str) else f"  no outcome recorded: {r.source} -> {r.destination}"


def names_abbreviated(digest: str) -> str:
    return digest[:12]


def plan_lines(made, most: int = 1000):
    """One line a planned move, read from the plan as it is printed; after ``most`` lines, how many are left."""
    for r in _some(made.ordered(), most, "... and {} more", made.moves["moves"]):
        if isinstance(r, str):
            yield r
            continue
        tags = "" if r.phase == 0 else " " + names.DATE_TAGS[r.date_source] + ("" if r.unsorted else f" [tz:{r.tz_source}]")
        yield f"{r.source} -> {r.destination}{tags}"
        for c in r.companions:
            yield f"    with {c.path}"


def summary(counts: dict, dates, percent: int, journal=None) -> list[str]:
    out = [_line(label, counts.get(k, 0)) for k, label in ALWAYS.items()]
    out += [_line(label, counts[k]) for k, label in NONZERO.items() if counts.get(k)]
    if counts.get("sidecars_found") or counts.get("sidecar_orphans"):
        out += [_line(label, counts.get(k, 0)) for k, label in SIDECARS.items()]
    out += [_line(label, counts[k]) for k, label in LAST.items() if counts.get(k)]
    out.append(_line("Dates:", f"{dates.n_exif} recorded, {dates.n_sidecar} from sidecars, {dates.from_filesystem} from the file system, {dates.n_none} none; {dates.n_unsorted} unsorted"))
    if dates.warns:
        out.append(f"  Warning: {dates.percent}% of dated files have only the file system's date (more than {percent}%)")
    if journal:
        out.append(_line("Journal:", journal))
    return out


def runs(rows: list[dict]) -> list[str]:
    if not rows:
        return ["no runs are recorded"]
    return [f"{r['run_id']}  {r['error']}" if r["error"] else f"{r['run_id']}  {r['started_at']}  {r['n_restorable']} files" + ("  interrupted" if r["interrupted"] else "") for r in rows]


def restored(done, commit: bool) -> list[str]:
    out = [_line(f"{k.replace('_', ' ')}:", n) for k, n in sorted(done.counts.items()) if n or not commit]
    if done.unresolved:
        out.append(f"  {done.unresolved} moves have no recorded outcome: check them by hand")
    if done.shortfall:
        out.append(f"  Not fully put back: {done.shortfall}")
    return out or ["nothing to restore"]


def verdict_lines(verdicts):
    for r in verdicts.toLocalIterator():
        yield f"{r.group_id}  {r.verdict}  {r.n_matching} of {r.n_copies} copies match"
