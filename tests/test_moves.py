import json
import os

import pytest

from lodestrata import lifecycle
from lodestrata.plans import moves, undo
from lodestrata.sources import journal
from tests.test_lifecycle import settings, tree

START = "2024-01-01T00:00:00Z"


def entries(path):
    return [json.loads(x) for x in open(path).read().splitlines()[1:]]


def library(root, n=40):
    for i in range(n):
        d = root / f"d{i % 7}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{i}.jpg").write_text(f"text {i // 2 if i % 5 == 0 else i}")
    for i in range(0, n, 10):
        (root / f"copy{i}.jpg").write_text(f"text {i}")


def test_moves_are_many_tasks_and_one_journal(spark, tmp_path):
    library(tmp_path / "in")
    before = tree(tmp_path / "in")
    made = lifecycle.plan(spark, [str(tmp_path / "in")], settings(output_dir=str(tmp_path / "out"), chunk_size=0))
    parts = []
    done, at = lifecycle.commit(made)
    assert done.failed == done.unprocessed == done.skipped == 0 and done.moved == len(before)
    found = entries(at)
    intents = [e for e in found if e["type"] == "move_intent"]
    assert len({e["seq"] for e in intents}) == len(intents) == done.moved and found[-1]["type"] == "run_completed" and found[-1]["moved"] == done.moved
    settled = {e["seq"]: k for k, e in enumerate(found) if e["type"] in ("move_committed", "duplicate_moved")}
    assert all(settled[e["seq"]] == k + 1 for k, e in enumerate(found) if e["type"] == "move_intent")
    assert not [p for p in os.listdir(at.parent) if p.endswith(journal.PARTS)], parts
    phases = {e["seq"]: e["kind"] for e in intents}
    assert [phases[s] for s in sorted(phases)] == sorted(phases.values())  # copies first
    back = lifecycle.take_back(spark, str(at.parent), commit=True)
    assert back.counts["restored"] == done.moved and tree(tmp_path / "in") == before


def test_a_task_that_runs_again_goes_on(tmp_path):
    """What its segment records isn't done again: outcomes are taken over, an intent whose file has gone is settled, a torn line goes."""
    for name in "abcd":
        (tmp_path / f"{name}.jpg").write_text(name)
    p = lambda x: str(tmp_path / x)
    rows = [{"n": i, "group": -1, "heads": -1, "source": p(f"{x}.jpg"), "destination": p(f"out/{x}.jpg"), "size": 1, "hash": None, "companions": []} for i, x in enumerate("abcd")]
    parts = tmp_path / "r.parts"
    parts.mkdir()
    (tmp_path / "out").mkdir()
    os.rename(p("a.jpg"), p("out/a.jpg"))
    os.rename(p("b.jpg"), p("out/b.jpg"))
    intent = lambda i, x: {"type": "move_intent", "seq": i + 1, "source": p(f"{x}.jpg"), "destination": p(f"out/{x}.jpg"), "source_size": 1, "source_hash": None, "kind": "organise"}
    lines = [intent(0, "a"), {"type": "move_committed", "seq": 1, "final_destination": p("out/a.jpg"), "move_kind": "renamed"}, intent(1, "b")]
    (parts / "000000000000.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + '{"type":"move_int')
    for _ in range(2):
        task = moves._Task(str(parts), 0, str)
        for r in rows:
            task.organise(r, 1)
        row = task.row().iloc[0]
        assert (row.moved, row.failed, row.skipped) == (4, 0, 0)
        found = [json.loads(x) for x in (parts / "000000000000.jsonl").read_text().splitlines()]
        assert [e["type"] for e in found] == ["move_intent", "move_committed"] * 4 and sorted(os.listdir(tmp_path / "out")) == ["a.jpg", "b.jpg", "c.jpg", "d.jpg"]
    gone = moves._Task(None, 0, str)
    gone.organise(rows[0], 1)
    assert gone.counts["skipped"] == 1


def test_a_stopped_run_can_be_taken_back(spark, tmp_path):
    """Segments that a run left are read with its journal, less their torn last lines."""
    at = tmp_path / "20240101-000000-abcdef.jsonl"
    log = journal.Writer(at, "20240101-000000-abcdef", START, str(tmp_path / "out"), [])
    (tmp_path / "out").mkdir()
    for k in range(3):
        task = moves._Task(log.parts(), 10 * k, str)
        for i in range(10 * k, 10 * k + 4):
            (tmp_path / f"{i}.jpg").write_text(str(i))
            task.organise({"n": i, "group": -1, "heads": -1, "source": str(tmp_path / f"{i}.jpg"), "destination": str(tmp_path / f"out/{i}.jpg"), "size": len(str(i)), "hash": None, "companions": []}, 1)
        task.row()
    log.close()
    with open(tmp_path / "20240101-000000-abcdef.parts/000000000010.jsonl", "a") as f:
        f.write('{"type":"move_intent","seq":')
    found = journal.read(spark, str(at))
    assert found.count() == 24 and undo.runs(found).first().interrupted and undo.runs(found).first().n_restorable == 12
    assert [r["interrupted"] for r in lifecycle.recorded_runs(spark, str(tmp_path))] == [True]
    back = lifecycle.take_back(spark, str(tmp_path), commit=True)
    assert back.counts["restored"] == 12 and not (tmp_path / "out" / "0.jpg").exists() and (tmp_path / "20.jpg").exists()


def test_steps_wait_for_those_in_their_way(spark, tmp_path):
    """a went to b, c to a, d to c: back in waves, the last first, so that each finds its place free."""
    for name, text in (("b", "1"), ("a", "2"), ("c", "3")):
        (tmp_path / name).write_text(text)
    p = lambda x: str(tmp_path / x)
    steps = spark.createDataFrame([(2, p("a"), p("b"), 1, None), (4, p("c"), p("a"), 1, None), (6, p("d"), p("c"), 1, None), (8, p("x"), p("gone"), 1, None)], "line_no int, source string, destination string, size long, hash string")
    log = journal.Writer(tmp_path / "u.jsonl", "u", START, str(tmp_path), [])
    counts = moves.take_back(steps, log, str(tmp_path))
    log.close()
    assert counts == {"restored": 3, "conflicted": 0, "failed": 0, "skipped_missing": 1, "skipped_modified": 0}
    assert {x: (tmp_path / x).read_text() for x in "acd"} == {"a": "1", "c": "2", "d": "3"} and not (tmp_path / "b").exists()


def test_a_manifest_that_cannot_be_written_stops_its_group(tmp_path):
    rows = []
    for i in range(3):
        (tmp_path / f"{i}.jpg").write_text("x")
        rows.append({"n": i, "group": 4, "heads": -1, "source": str(tmp_path / f"{i}.jpg"), "destination": str(tmp_path / f"dup/{i}.jpg"), "size": 1, "hash": "h", "companions": []})
    task = moves._Task(None, 0, lambda group: str(tmp_path / "no/such/manifest.txt"))
    for r in rows:
        task.organise(r, 1)
    assert task.counts["moved"] == 1 and task.counts["failed"] == 1 and task.counts["unprocessed"] == 2


def test_nobody_to_ask_and_no_journal(spark, tmp_path):
    library(tmp_path / "in", 9)
    made = lifecycle.plan(spark, [str(tmp_path / "in")], settings(output_dir=str(tmp_path / "out"), chunk_size=2))
    asked = []
    done, at = lifecycle.commit(made, go_on=lambda k: asked.append(k) or k < 2, journaled=False)
    assert at is None and asked == [0, 1, 2] and done.moved == 4 and done.unprocessed == made.moves["moves"] - 4
    with pytest.raises(journal.JournalError):
        lifecycle.pick_run(str(tmp_path / "out"), None)
