import os
import re
import shutil
from pathlib import Path

import pytest

from lodestrata import __main__ as cli
from lodestrata import lifecycle, reports
from lodestrata.plans import settings as conf
from lodestrata.plans.settings import SettingsError
from lodestrata.sources import generator, journal, manifest, readers


def tree(root: Path) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and ".lodestrata" not in p.parts}


def settings(**values) -> conf.Settings:
    return conf.merge({"command_line": {"default_timezone": "UTC", **values}})


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    at = tmp_path_factory.mktemp("lib") / "in"
    generator.write(at, "awkward", 7)
    return at


def test_generated_files_say_what_they_should(tmp_path):
    assert generator.write(tmp_path / "a", "minimal", 3) == generator.write(tmp_path / "b", "minimal", 3)
    assert tree(tmp_path / "a") == tree(tmp_path / "b")
    m = readers.image_metadata(generator.photo("2020:01:02 03:04:05", "+09:00", (-33.8688, 151.2093)))
    assert (str(m["naive"]), m["offset_s"], m["status"]) == ("2020-01-02 03:04:05", 32400, "ok")
    assert m["lat"] == pytest.approx(-33.8688, abs=1e-5) and m["lon"] == pytest.approx(151.2093, abs=1e-5)
    with pytest.raises(FileExistsError):
        generator.write(tmp_path / "a")
    with pytest.raises(ValueError, match="profile"):
        generator.write(tmp_path / "c", "none")


def test_preview_commit_verify_undo(spark, library, tmp_path):
    root = tmp_path / "in"
    shutil.copytree(library, root)
    before = tree(root)
    _, _, raw, copies, _ = generator.PROFILES["awkward"]
    s = settings(output_dir=str(tmp_path / "out"), require_exif=True)
    made = lifecycle.plan(spark, [str(root)], s, generator.places(spark))
    assert tree(root) == before and made.counts["duplicate_files"] == made.counts["duplicate_groups"] == copies
    assert made.counts["sidecars_found"] == raw and made.counts["sidecar_orphans"] == 1
    rows = {os.path.relpath(r.source, root): r for r in made.rows.collect()}
    assert len({r.destination for r in rows.values()}) == len(rows) == made.counts["scanned"] - made.counts["hash_skipped"]
    assert rows["awkward/LOUD.JPG"].date_source == "exif" and "/2021-05-06/2021-05-06-070809" in rows["awkward/LOUD.JPG"].destination
    assert rows["raw/DSC_0000.cr2"].date_source == "sidecar" and len(rows["raw/DSC_0000.cr2"].companions) == 1
    assert all(rows[f"undated/scan_{i}.jpg"].unsorted for i in range(3))
    assert len([*reports.plan_lines(made, 3)]) >= 4

    done, at = lifecycle.commit(made, ["organise"])
    assert done.failed == done.unprocessed == 0 and done.moved == len(rows) + raw and done.sidecars == raw
    out = tree(tmp_path / "out")
    manifests = [p for p in out if p.endswith(manifest.NAME)]
    assert len(manifests) == copies and len(out) == len(rows) + raw + copies
    verdicts, code = lifecycle.check_duplicates(spark, str(tmp_path / "out/duplicates"))
    assert code == 0 and {r.verdict for r in verdicts.collect()} == {"confirmed"}

    where = lifecycle.journal_dir(made.output, s)
    assert lifecycle.take_back(spark, where).counts == {"intact": done.moved}
    assert not lifecycle.recorded_runs(spark, where)[0]["interrupted"]
    back = lifecycle.take_back(spark, where, commit=True)
    assert back.exit_code == 0 and back.counts["restored"] == done.moved
    assert tree(root) == before
    assert [r["n_restorable"] for r in lifecycle.recorded_runs(spark, where)] == [done.moved] * 2
    with pytest.raises(journal.JournalError):
        lifecycle.pick_run(where, "none")


def test_altered_copy_and_lost_original_are_told(spark, tmp_path):
    for rel, text in {"a.jpg": "same", "x/a.jpg": "same", "b.jpg": "other", "x/b.jpg": "other"}.items():
        (tmp_path / "in" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / rel).write_text(text)
    made = lifecycle.plan(spark, [str(tmp_path / "in")], settings(output_dir=str(tmp_path / "out")))
    lifecycle.commit(made)
    d = tmp_path / "out/duplicates"
    next(p for p in (d / "000").iterdir() if p.suffix == ".jpg").write_text("changed")
    for line in (d / "001" / manifest.NAME).read_text().splitlines():
        if line.startswith(manifest.MOVED):
            os.unlink(line.removeprefix(manifest.MOVED))
    verdicts, code = lifecycle.check_duplicates(spark, str(d))
    assert [r.verdict for r in verdicts.collect()] == ["mismatch", "original_missing"] and code == 1
    again = lifecycle.plan(spark, [str(d)], settings(output_dir=str(tmp_path / "out")))
    assert again.counts["duplicate_files"] == 0


def test_stopping_between_chunks_and_an_empty_directory(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.jpg").write_text(str(i))
    made = lifecycle.plan(spark, [str(tmp_path)], settings(chunk_size=2))
    done, _ = lifecycle.commit(made, go_on=lambda chunk: chunk < 1)
    assert done.moved == 2 and done.unprocessed == 3
    (tmp_path / "none").mkdir()
    assert lifecycle.plan(spark, [str(tmp_path / "none")], settings()).counts["scanned"] == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["generate", "in", "--profile", "minimal"]) == 0
    before = tree(tmp_path / "in")
    assert cli.main(["organise", "in", "--default-timezone", "UTC"]) == 0 and tree(tmp_path / "in") == before
    assert "Nothing was moved" in capsys.readouterr().out
    assert cli.main(["organise", "in", "--commit", "--no-journal"]) == 1
    assert cli.main(["organise", "in", "--commit", "--output-dir", "out", "--no-prompt"]) == 0
    assert cli.main(["journal", "list", "out"]) == 0 and "files" in capsys.readouterr().out
    assert cli.main(["journal", "show", "out"]) == 0
    shown = capsys.readouterr().out
    assert "Can be restored:" in shown and "Moved, failed, skipped:" in shown and shown.count(" -> ") == len([p for p in tree(tmp_path / "out") if not p.endswith(manifest.NAME) and ".lodestrata" not in p])
    assert cli.main(["verify", "out/duplicates"]) == 0 == cli.main(["verify", "out/duplicates", "--digest", "blake3"])
    assert cli.main(["undo", "out", "--commit"]) == 0 and tree(tmp_path / "in") == before
    assert cli.main(["config", "show"]) == 0 and cells(capsys.readouterr().out)["chunk_size"] == ["100", "default"]
    assert cli.main(["organise", "in", "--chunk-size", "-1"]) == 1
    with pytest.raises(SettingsError):
        lifecycle.refuse_unsafe(True, False, False)


def cells(out):
    """A printed table's rows by their first cell, without the head."""
    rows = [re.split(r"  +", line) for line in out.splitlines()[1:]]
    return {r[0]: r[1:] for r in rows}


def test_settings_are_loaded_in_order(tmp_path, monkeypatch, capsys):
    """The user's file, the nearest project's, variables; a named file replaces both, and can't be named and refused at once."""
    user, project, named = tmp_path / "home/config.toml", tmp_path / "lodestrata.toml", tmp_path / "named.toml"
    monkeypatch.setattr(cli, "USER_FILE", user)
    (tmp_path / "sub").mkdir()
    monkeypatch.chdir(tmp_path / "sub")
    assert cli.main(["config", "path"]) == 0 and all(c[1] == "absent" for p, c in cells(capsys.readouterr().out).items() if p != "(variables)")
    assert cli.main(["config", "validate"]) == 0 and cells(capsys.readouterr().out) == {}
    assert cli.main(["config", "init"]) == 0 and user.is_file() and cli.main(["config", "init"]) == 1 and cli.main(["config", "init", "--force"]) == 0
    assert cli.main(["config", "init", "--project"]) == 0 and (tmp_path / "sub/lodestrata.toml").is_file()
    (tmp_path / "sub/lodestrata.toml").unlink()
    text = user.read_text()
    assert all(f"# {k}" in text for k in conf.DEFAULTS if k != "extensions") and "# [extensions]" in text and conf.file_layer(user) == {}
    user.write_text('chunk_size = 5\nunsorted_dir = "later"')
    project.write_text('chunk_size = 6\n[extensions]\nvideo = [".MP4"]')
    named.write_text("verbose = 1")
    capsys.readouterr()
    assert cli.main(["config", "show"]) == 0
    shown = cells(capsys.readouterr().out)
    assert shown["chunk_size"] == ["6", "project", str(project)] and shown["unsorted_dir"] == ['"later"', "user", str(user)] and shown["extensions.video"][0] == '["mp4"]' and shown["output_dir"] == ["-", "default"]
    assert cli.main(["--config", str(named), "config", "show"]) == 0
    shown = cells(capsys.readouterr().out)
    assert shown["chunk_size"] == ["100", "default"] and shown["verbose"] == ["1", "project", str(named)] and shown["unsorted_dir"][0] == '"unsorted"'
    monkeypatch.setenv("LODESTRATA_CHUNK_SIZE", "9")
    assert cli.main(["--no-config", "config", "show"]) == 0
    shown = cells(capsys.readouterr().out)
    assert shown["chunk_size"] == ["9", "environment"] and shown["unsorted_dir"][0] == '"unsorted"'
    assert cli.main(["--no-config", "config", "path"]) == 0 and cells(capsys.readouterr().out) == {"(files)": ["-", "off", "0"], "(variables)": ["environment", "read", "1"]}
    assert cli.main(["--no-config", "--config", str(named), "config", "show"]) == 1 and "contradict" in capsys.readouterr().err
    assert cli.main(["config", "path"]) == 0
    found = cells(capsys.readouterr().out)
    assert found[str(user)] == ["user", "read", "2"] and found[str(project)] == ["project", "read", "2"] and any(c[1] == "absent" for c in found.values())
    assert cli.main(["config", "validate"]) == 0 and set(cells(capsys.readouterr().out)) == {str(user), str(project)}
    assert cli.main(["config", "validate", str(named)]) == 0 and cells(capsys.readouterr().out) == {str(named): ["project", "verbose"]}


@pytest.mark.parametrize("line", ['chunk_size = "5"', "chunk_size = -1", "hash_threads = 0", "hash_threads = 1025", "output_dir = 3", "skip_patterns = 'x'", "skip_patterns = [1]", "skip_patterns = ['[']", "extensions = 3", "[extensions]\naudio = ['mp3']", "[extensions]\nvideo = [3]", "[extensions]\nvideo = ['.']", "sidecars = 1", "default_timezone = 'Mars/Base'", "default_timezone = '+banana'", "default_timezone = '+99:99'", "default_timezone = ''", "unsorted_dir = '/x'", "commit = true", "nothing = 1"])
def test_settings_are_checked(tmp_path, line):
    (tmp_path / "x.toml").write_text(line)
    with pytest.raises(SettingsError, match="x.toml"):
        conf.file_layer(tmp_path / "x.toml")


def test_lists_out_of_variables():
    got = conf.env_layer({"LODESTRATA_EXTENSIONS_IMAGE": "", "LODESTRATA_EXTENSIONS_VIDEO": " .MP4, mov ,", "LODESTRATA_SKIP_PATTERNS": "", "LODESTRATA_DEFAULT_TIMEZONE": "+0530"})
    assert got == {"extensions": {"image": [], "video": ["mp4", "mov"]}, "skip_patterns": [], "default_timezone": "+0530"}
    made = conf.merge({"environment": got}).values["extensions"]
    assert made["image"] == [] and made["sidecar"] == ["xmp", "aae", "thm"]
    for name in ("EXTENSIONS", "EXTENSIONS_AUDIO", "EXTENSIONS_"):
        with pytest.raises(SettingsError):
            conf.env_layer({f"LODESTRATA_{name}": "x"})


@pytest.mark.parametrize(("text", "fine"), [("Z", True), ("+08:00", True), ("-0330", True), ("+08", True), ("Asia/Tokyo", True), ("+banana", False), ("+99:99", False), ("", False), ("-", False), ("08:00", False), ("../etc/passwd", False)])
def test_zones_are_checked(text, fine):
    if fine:
        assert conf.env_layer({"LODESTRATA_DEFAULT_TIMEZONE": text}) == {"default_timezone": text}
    else:
        with pytest.raises(SettingsError):
            conf.env_layer({"LODESTRATA_DEFAULT_TIMEZONE": text})


def test_settings_as_rows(spark):
    layers = [
        ("user", "# mine\nchunk_size = 5\n  nope = 1\nverbose = -1\n[extensions]\nvideo = ['.MP4']\n"), ("project", "verbose = \n"), ("project", "commit = true"), ("project", 'output_dir = "a'), ("environment", "HOME=/\nLODESTRATA_SIDECARS=no\nLODESTRATA_NOPE=1\nLODESTRATA_EXTENSIONS_IMAGE="), ("user", None), ("user", ""),
    ]
    rows = conf.rows_of(spark.createDataFrame(layers, "layer string, text string")).select("layer", "key", "value", "line", "column", "error").collect()
    fine = {tuple(r)[:4] for r in rows if r.error is None}
    assert fine == {("user", "chunk_size", "5", 2), ("user", "extensions", '{"video": ["mp4"]}', 5), ("environment", "sidecars", "false", 2), ("environment", "extensions", '{"image": []}', 4)}
    faults = sorted((r.layer, r.line, r.column, r.error.split(":")[0]) for r in rows if r.error)
    assert faults == [("environment", 3, 1, "LODESTRATA_NOPE"), ("project", 1, 1, "commit can only be given on the command line"), ("project", 1, 11, "Invalid value"), ("project", 1, 16, "Unterminated string"), ("user", 3, 3, "nope"), ("user", 4, 1, "verbose")]


def test_readers_at_once(spark):
    most = spark.sparkContext.defaultParallelism
    assert lifecycle.readers_at_once(spark, settings()) == min(most, 8) and lifecycle.readers_at_once(spark, settings(hash_threads=40)) == 40


def test_reports_of_a_plan(spark, library, tmp_path, caplog):
    root = tmp_path / "in"
    shutil.copytree(library, root)
    made = lifecycle.plan(spark, [str(root), str(tmp_path / "nowhere")], settings(output_dir=str(tmp_path / "out"), hash_threads=2))
    assert "nowhere is not a directory" in caplog.text and made.counts["scan_skipped"] == 0
    lines = [*reports.duplicate_lines(made)]
    copies = generator.PROFILES["awkward"][3]
    assert sum(x.startswith("Group ") for x in lines) == copies and sum("    goes" in x for x in lines) == copies and sum("    stays" in x for x in lines) == copies
    assert any("orphan.xmp (no file of that name)" in x for x in reports.orphan_lines(made.orphans))
    for shown, most in ((reports.plan_lines(made, 2), 2), (reports.duplicate_lines(made, 1), 1), (reports.plan_lines(made, made.moves["moves"]), None)):
        last = [*shown][-1]
        assert ("more" in last) == (most is not None)
    assert f"... and {made.moves['moves'] - 2} more" in [*reports.plan_lines(made, 2)] and [*reports.orphan_lines(made.orphans, 0)] == ["Left alone: 1 more"]
    assert made.moves == {"moves": made.rows.count(), "organised": made.rows.where("phase = 1").count()}
    done, at = lifecycle.commit(made)
    with open(at, "a") as f:
        f.write('{"type":"move_intent","seq":999,"source":"/a","destination":"/b"}\n')
    told = []
    back = lifecycle.take_back(spark, str(at.parent), tell=told.append)
    assert back.unresolved == 1 and "no outcome recorded: /a -> /b" in told and sum(x.startswith("intact: ") for x in told) == done.moved
    assert "  no outcome recorded: 1 more" in [*reports.run_detail(*lifecycle.run_detail(spark, str(at.parent)), most=0)]
    shown = [*reports.run_detail(*lifecycle.run_detail(spark, str(at.parent)))]
    assert "  no outcome recorded: /a -> /b" in shown and any("Can be restored:" in x for x in shown)
