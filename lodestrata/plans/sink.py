"""Carrying out a plan on the driver: journal first, never overwriting, every outcome recorded."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from ..operators.ledger import ATTEMPTS, candidate
from ..functions import blake3
from ..sources.journal import Writer
from ..sources.manifest import Manifests
from ..sources.readers import full_digest


def place(source: str, target: str) -> str:
    """Puts a file at ``target`` or the first free candidate beside it; returns where. Nothing is ever overwritten."""
    directory, name = os.path.split(target)
    os.makedirs(directory, exist_ok=True)
    for k in range(ATTEMPTS):
        at = os.path.join(directory, candidate(name, k))
        try:
            os.link(source, at, follow_symlinks=False)
        except FileExistsError:
            continue
        except OSError:
            if not _copied(source, at):
                continue
        os.unlink(source)
        return at
    raise FileExistsError(f"{target}: no free name")


def _copied(source: str, at: str) -> bool:
    """A verified copy under a name that must not exist; False if it does."""
    temp = f"{at}.part-{os.getpid()}"
    h = hashlib.sha256()
    with open(source, "rb") as src, open(temp, "xb") as dst:
        try:
            while block := src.read(1 << 17):
                h.update(block)
                dst.write(block)
            dst.flush()
            os.fsync(dst.fileno())
        except BaseException:
            os.unlink(temp)
            raise
    try:
        if full_digest(temp) != h.hexdigest():
            raise OSError(f"{at}: the copy differs")
        shutil.copystat(source, temp)
        os.link(temp, at)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(temp)


@dataclass
class Outcome:
    moved: int = 0
    failed: int = 0
    skipped: int = 0
    sidecars: int = 0
    unprocessed: int = 0


def execute(rows: Iterable, journal: Writer, chunk_size: int = 100, go_on: Callable[[int], bool] = lambda n: True, manifests: Manifests | None = None) -> Outcome:
    """Moves rows (source, destination, size, hash, group, companions) in order; ``go_on`` is asked before each chunk; what is left
    when it says no is counted as unprocessed.

    An intent is on disk before its move and an outcome after it. Companions follow to where their
    parent landed. A failure costs one file; a journal that can't be written stops the run, and a
    manifest that can't be written stops its group.
    """
    out, seq, stopped = Outcome(), 0, set()

    def move(source: str, destination: str, size, digest, kind: str, group=None) -> str | None:
        nonlocal seq
        seq += 1
        journal.append("move_intent", seq=seq, source=source, destination=destination, source_size=size if size is not None else os.path.getsize(source), source_hash=digest, kind=kind)
        try:
            at = place(source, destination)
        except OSError as e:
            journal.append("move_failed", seq=seq, reason=str(e))
            out.failed += 1
            return None
        if group is None:
            journal.append("move_committed", seq=seq, final_destination=at, move_kind="renamed")
        else:
            journal.append("duplicate_moved", seq=seq, group=group, source=source, destination=at)
        out.moved += 1
        return at

    rows = iter(rows)
    for n, row in enumerate(rows):
        if chunk_size and n % chunk_size == 0 and not go_on(n // chunk_size):
            out.unprocessed += 1 + sum(1 for _ in rows)
            break
        group = row["group"] if "group" in row else None
        if group is not None and group in stopped:
            out.unprocessed += 1
            continue
        if not os.path.lexists(row["source"]):
            out.skipped += 1
            continue
        at = move(row["source"], row["destination"], row["size"], row["hash"], "organise" if group is None else "duplicate", group)
        if at and manifests is not None:
            try:
                if group is None:
                    manifests.original_moved(row["source"], at)
                else:
                    manifests.moved(group, row["source"], at)
            except OSError:
                out.failed += 1
                stopped.add(group)
        for c in (row["companions"] or []) if at else ():
            base = os.path.basename(at) if c["convention"] == "full_name" else os.path.splitext(os.path.basename(at))[0]
            ext = os.path.splitext(c["path"])[1].lower()
            if os.path.lexists(c["path"]):
                out.sidecars += bool(move(c["path"], os.path.join(os.path.dirname(at), base + ext), None, None, "sidecar"))
    journal.append("run_completed", moved=out.moved, failed=out.failed, skipped=out.skipped, ended_at=None)
    return out


def verify_step(destination: str, size: int | None, digest: str | None) -> str:
    """intact, missing, modified or unverifiable, cheapest test first; a digest may be SHA-256 or BLAKE3."""
    if not os.path.lexists(destination):
        return "missing"
    if not os.path.isfile(destination) or os.path.islink(destination):
        return "unverifiable"
    if size is not None and os.path.getsize(destination) != size:
        return "modified"
    if digest is not None and full_digest(destination) != digest and blake3.of_file(destination) != digest:
        return "modified"
    return "intact"


def restore(steps: Iterable, journal: Writer, root: str) -> dict[str, int]:
    """Takes steps (source, destination, size, hash) back, each verified just before; then prunes emptied directories."""
    counts = dict.fromkeys(("restored", "conflicted", "failed", "skipped_missing", "skipped_modified"), 0)
    left: set[str] = set()
    for seq, s in enumerate(steps, 1):
        status = verify_step(s["destination"], s["size"], s["hash"])
        if status != "intact":
            counts["skipped_missing" if status == "missing" else "skipped_modified" if status == "modified" else "failed"] += 1
            continue
        journal.append("move_intent", seq=seq, source=s["destination"], destination=s["source"], source_size=s["size"], source_hash=s["hash"], kind="restore")
        try:
            at = place(s["destination"], s["source"])
        except OSError as e:
            journal.append("move_failed", seq=seq, reason=str(e))
            counts["failed"] += 1
            continue
        journal.append("move_committed", seq=seq, final_destination=at, move_kind="renamed")
        counts["restored" if at == s["source"] else "conflicted"] += 1
        left.add(os.path.dirname(s["destination"]))
    for d in sorted(left, key=len, reverse=True):
        p = Path(d)
        while p != Path(root) and Path(root) in p.parents and p.is_dir() and not any(p.iterdir()):
            p.rmdir()
            p = p.parent
    return counts
