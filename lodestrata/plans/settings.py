"""Layered settings: default, user, project, environment, command line; the last layer that says something wins."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths
from ..sources.clocks import parse_offset

# The keys and their defaults.
DEFAULTS = {
    "output_dir": None, "chunk_size": 100, "hash_threads": None, "no_prompt": False, "verbose": 0, "journal_dir": None,
    "date_directory_format": "%Y-%m-%d", "filename_format": "{date}-{time}{location}.{ext}", "include_location": True,
    "duplicates_dir": "duplicates", "unsorted_dir": "unsorted", "skip_patterns": [], "default_timezone": None, "require_exif": False,
    "sidecars": True, "filesystem_date_warning_percent": 20, "extensions": {"image": list(paths.IMAGE), "video": list(paths.VIDEO), "sidecar": list(paths.COMPANION)},
}
LAYERS = ("default", "user", "project", "environment", "command_line")
PREFIX, FILES = "LODESTRATA_", ("lodestrata.toml", ".lodestrata.toml")
SAFETY = ("commit", "force", "no_journal")
NUMBERS = ("chunk_size", "hash_threads", "verbose", "filesystem_date_warning_percent")
#: What each setting is for, as the starter file says it.
MEANING = {
    "output_dir": "where files are filed; the first input directory if unset", "chunk_size": "files moved between two questions; 0 asks once", "hash_threads": "tasks that read files at a time, 1 to 1024", "no_prompt": "go on without asking between chunks",
    "verbose": "1 and more show the settings of a run", "journal_dir": "where runs are recorded; below the output if unset", "date_directory_format": "directories of dated files, by strftime", "filename_format": "names of dated files: {date} {time} {location} {ext} {original_stem}",
    "include_location": "put the nearest place into names", "duplicates_dir": "where copies go", "unsorted_dir": "where files without a date go", "skip_patterns": "globs of what is left alone", "default_timezone": "zone of clocks without an offset: a name, an offset or Z",
    "require_exif": "file by recorded dates only", "sidecars": "let companions travel with their files", "filesystem_date_warning_percent": "warn when more dated files than this have only the file system's date", "extensions": "what counts as image, video and sidecar; a list replaces its default",
}


class SettingsError(ValueError):
    """What is wrong with a setting, and where."""


def parse_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parse_bool(text: str) -> bool:
    low = text.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise SettingsError(f"{text!r} is neither true nor false")


def list_of(text: Column) -> Column:
    """``parse_list`` as an expression."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def bool_of(text: Column) -> Column:
    """``parse_bool`` as an expression; null where that refuses."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False)


def number_of(text: Column) -> Column:
    """A whole number of digits alone, blanks around it aside; null for anything else."""
    return F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text).try_cast("long"))


def _zone(text: str) -> None:
    """Refuses what is neither Z, an offset nor the name of a zone."""
    if text == "Z" or text[:1] in ("+", "-") and parse_offset(text) is not None:
        return
    if not text or text[0] in "+-":
        raise ValueError(f"{text!r} is no offset and no zone")
    ZoneInfo(text)


def _extension_list(kind: str, found) -> list[str]:
    if kind not in DEFAULTS["extensions"]:
        raise ValueError(f"no such list: {kind}")
    if not isinstance(found, list) or not all(isinstance(x, str) and x.strip(". ") for x in found):
        raise ValueError(f"{kind} must be a list of extensions")
    return [x.strip().lstrip(".").lower() for x in found]


def validate(key: str, value, where: str = "") -> object:
    """Returns the value if the key allows it."""

    def bad(why: str):
        return SettingsError(f"{where}{key}: {why}")

    if key not in DEFAULTS:
        raise bad("no such setting")
    if value is None:
        return value
    default = DEFAULTS[key]
    if isinstance(default, bool) and not isinstance(value, bool):
        raise bad("must be true or false")
    if isinstance(default, list) and not (isinstance(value, list) and all(isinstance(x, str) for x in value)):
        raise bad("must be a list of strings")
    if (default is None and key not in NUMBERS or isinstance(default, str)) and not isinstance(value, str):
        raise bad("must be a string")
    if key == "extensions":
        if not isinstance(value, dict):
            raise bad("must be a table of image, video and sidecar lists")
        try:
            return {kind: _extension_list(kind, found) for kind, found in value.items()}
        except ValueError as e:
            raise bad(str(e)) from e
    if key in NUMBERS:
        low, high = {"hash_threads": (1, 1024), "filesystem_date_warning_percent": (0, 100)}.get(key, (0, 1 << 62))
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise bad(f"must be a whole number from {low} to {high}")
    try:
        if key == "date_directory_format":
            names.strftime_pattern(value)
        elif key == "filename_format":
            names.parse_template(value)
        elif key in ("duplicates_dir", "unsorted_dir"):
            names.refuse(value)
        elif key == "skip_patterns":
            for p in value:
                paths.glob_regex(p)
        elif key == "default_timezone":
            _zone(value)
    except (ValueError, KeyError, OSError) as e:
        raise bad(str(e)) from e
    return value


def file_layer(path: str | Path) -> dict:
    """A TOML file's settings; errors name the file, line and column."""
    found, faults = read_file(Path(path).read_text())
    if faults:
        line, column, why = faults[0]
        raise SettingsError(f"{path}: {why}" + (f" (line {line}, column {column})" if line else ""))
    return {key: value for key, value, _ in found}


_KEY = re.compile(r"""^[ \t]*["']?([A-Za-z0-9_-]+)["']?[ \t]*=""", re.M)
_TABLE = re.compile(r"^[ \t]*\[[ \t]*([A-Za-z0-9_-]+)[ \t]*\]", re.M)
_PLACE = re.compile(r"^(.*?) \(at (?:line (\d+), column (\d+)|end of document)\)$", re.S)


def read_file(text: str) -> tuple[list[tuple[str, object, int | None]], list[tuple[int | None, int | None, str]]]:
    """A settings file's (key, value, line), and what is wrong with it as (line, column, why); TOML that can't be read has one fault and no keys."""
    try:
        held = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        m = _PLACE.match(str(e))
        lines = text.split("\n")
        line, column = (int(m[2]), int(m[3])) if m and m[2] else (len(lines), len(lines[-1]) + 1)
        return [], [(line, column, m[1] if m else str(e))]
    at = {}
    for pattern in (_KEY, _TABLE):
        for m in pattern.finditer(text):
            at.setdefault(m[1], (text.count("\n", 0, m.start(1)) + 1, m.start(1) - text.rfind("\n", 0, m.start(1))))
    found, faults = [], []
    for key, value in held.items():
        line, column = at.get(key, (None, None))
        try:
            if key in SAFETY:
                raise SettingsError(f"{key} can only be given on the command line")
            found.append((key, validate(key, value), line))
        except SettingsError as e:
            faults.append((line, column, str(e)))
    return found, faults


def variable(name: str, text: str) -> tuple[str, object] | None:
    """(key, value) of one variable, None if it hasn't the prefix; lists are parted by commas, and an empty text is an empty list.

    ``..._EXTENSIONS_IMAGE`` and its like give one list of ``extensions``.
    """
    if not name.startswith(PREFIX):
        return None
    key = name.removeprefix(PREFIX).lower()
    table, _, kind = key.partition("_")
    if table == "extensions" and kind in DEFAULTS["extensions"]:
        return table, validate(table, {kind: parse_list(text)}, f"{name}: ")
    if key in SAFETY:
        raise SettingsError(f"{name}: {key} can only be given on the command line")
    if key not in DEFAULTS or key == "extensions":
        raise SettingsError(f"{name}: no such setting")
    default = DEFAULTS[key]
    if isinstance(default, bool):
        value = parse_bool(text)
    elif isinstance(default, list):
        value = parse_list(text)
    elif key in NUMBERS:
        if not re.fullmatch(r"\s*[0-9]+\s*", text):
            raise SettingsError(f"{name}: {text!r} is no whole number")
        value = int(text)
    else:
        value = text
    return key, validate(key, value, f"{name}: ")


def env_layer(variables: dict[str, str] | None = None) -> dict:
    """Settings from variables with the prefix; a name that is no setting is an error."""
    out: dict = {}
    for name, text in (os.environ if variables is None else variables).items():
        if said := variable(name, text):
            key, value = said
            out[key] = {**out.get(key, {}), **value} if key == "extensions" else value
    return out


def find_project_file(start: str | Path) -> Path | None:
    """The nearest ancestor's settings file, the plain name before the hidden one."""
    for d in (p := Path(start).resolve(), *p.parents):
        for name in FILES:
            if (d / name).is_file():
                return d / name
    return None


@dataclass
class Settings:
    values: dict
    source: dict = field(default_factory=dict)


def merge(layers: dict[str, dict]) -> Settings:
    """Settings of the layers in LAYERS' order; lists replace, the extension table merges list by list."""
    values, source = {**DEFAULTS, "extensions": dict(DEFAULTS["extensions"])}, dict.fromkeys(DEFAULTS, "default")
    for name in LAYERS[1:]:
        for key, value in layers.get(name, {}).items():
            if value is None:
                continue
            values[key] = {**values[key], **value} if key == "extensions" else value
            source[key] = name
    return Settings(values, source)


def check_safety(flags: dict[str, bool], acknowledged: bool = False) -> None:
    if flags.get("commit") and flags.get("no_journal") and not acknowledged:
        raise SettingsError("committing without a journal has to be acknowledged")


@dataclass
class Loaded:
    """Layers below the command line as (name, file or None, settings), lowest first; files looked for, with whether they were there."""

    layers: list[tuple[str, Path | None, dict]] = field(default_factory=list)
    searched: list[tuple[Path, bool]] = field(default_factory=list)

    def resolve(self, command_line: dict | None = None) -> Settings:
        """All layers merged; ``source`` names the layer, with its file where it has one."""
        out = merge({name: values for name, _, values in self.layers} | {"command_line": command_line or {}})
        files = {name: path for name, path, _ in self.layers if path}
        out.source = {k: f"{name} {files[name]}" if name in files else name for k, name in out.source.items()}
        return out


def load(explicit: str | Path | None = None, no_config: bool = False, user: Path | None = None, start: str | Path | None = None, variables: dict[str, str] | None = None) -> Loaded:
    """Reads the layers in ascending priority: the user's file, the nearest project file, the environment.

    A file named on the command line replaces both files; ``no_config`` leaves files out, and the two
    contradict each other. The environment always counts.
    """
    out = Loaded()
    if explicit and no_config:
        raise SettingsError("--config and --no-config contradict each other")
    if explicit:
        out.layers.append(("project", Path(explicit), file_layer(explicit)))
        out.searched.append((Path(explicit), True))
    elif not no_config:
        if user is not None:
            out.searched.append((user, user.is_file()))
            if user.is_file():
                out.layers.append(("user", user, file_layer(user)))
        if start is not None:
            found = find_project_file(start)
            for d in (p := Path(start).resolve(), *p.parents):
                for name in FILES:
                    if found is None or found not in [x for x, _ in out.searched]:
                        out.searched.append((d / name, d / name == found))
            if found:
                out.layers.append(("project", found, file_layer(found)))
    if environment := env_layer(variables):
        out.layers.append(("environment", None, environment))
    return out


def _toml(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else str(value)


def columns(head: tuple[str, ...], rows: list[tuple[str, ...]]) -> list[str]:
    """Rows under their heads, each column as wide as its widest cell."""
    wide = [max(len(r[i]) for r in (head, *rows)) for i in range(len(head))]
    return ["  ".join(cell.ljust(n) for cell, n in zip(r, wide, strict=True)).rstrip() for r in (head, *rows)]


def report(settings: Settings) -> list[str]:
    """A table of the settings: key, value ("-" if unset), the layer that decided it, and its file."""
    rows = []
    for k in DEFAULTS:
        layer, _, file = settings.source.get(k, "default").partition(" ")
        values = {f"{k}.{kind}": v for kind, v in settings.values[k].items()} if k == "extensions" else {k: settings.values[k]}
        rows += [(name, "-" if v is None else _toml(v), layer, file) for name, v in values.items()]
    return columns(("SETTING", "VALUE", "LAYER", "FILE"), rows)


def search_report(loaded: Loaded, no_config: bool = False) -> list[str]:
    """A table of the layers' files in ascending priority: path, layer, whether it was read and how many settings it gave."""
    read = {path: (name, len(values)) for name, path, values in loaded.layers if path}
    rows = [(str(path), *((read[path][0], "read", str(read[path][1])) if path in read else ("-", "absent", "0"))) for path, _ in loaded.searched]
    given = sum(len(values) for name, path, values in loaded.layers if path is None)
    rows.append(("(variables)", "environment", "read", str(given)))
    return columns(("PATH", "LAYER", "STATE", "SETTINGS"), ([("(files)", "-", "off", "0")] if no_config else []) + rows)


def validation_report(loaded: Loaded) -> list[str]:
    """A table of the files that were checked, each with its layer and the settings that it gives; a fault has stopped the run before."""
    return columns(("CHECKED", "LAYER", "SETTINGS"), [(str(path), name, ", ".join(values) or "-") for name, path, values in loaded.layers if path])


def write_starter(path: str | Path, force: bool = False) -> None:
    """A settings file with every key at its default, commented out, under what it is for."""
    out = ["# Settings; take the # off a line to change it.", ""]
    for k, v in DEFAULTS.items():
        if k == "extensions":
            out += [f"# {MEANING[k]}", "# [extensions]", *(f"# {kind} = {_toml(some)}" for kind, some in v.items())]
        else:
            out += [f"# {MEANING[k]}", f"# {k} = {_toml(v) if v is not None else ''}".rstrip() + ("" if v is not None else "  (unset)"), ""]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w" if force else "x", encoding="utf-8") as f:
        f.write("\n".join(out) + "\n")


def deciding(layers: DataFrame, *by: str) -> DataFrame:
    """(``by``, key, value, layer) of ``layers(layer, priority, key, value)``: the highest layer with a value."""
    said = F.when(F.col("value").isNotNull(), F.col("priority"))
    return layers.groupBy(*by, "key").agg(F.max_by("value", said).alias("value"), F.max_by("layer", said).alias("layer"))


def nearest_files(starts: DataFrame, listing: DataFrame) -> DataFrame:
    """``starts(start)`` with ``file``: of ``listing(path)`` the settings file of the nearest directory at or above each, the plain name before the hidden one; null if there is none."""
    name = paths.file_name(F.col("path"))
    held = listing.where(name.isin(*FILES)).select(paths.directory(F.col("path")).alias("above"), F.struct(F.array_position(F.array(*map(F.lit, FILES)), name).alias("turn"), F.col("path").alias("file")).alias("f"))
    held = held.groupBy("above").agg(F.min("f")["file"].alias("file"))
    parts = paths.components(F.col("start"))
    up = starts.select("start").distinct().select("start", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("above", F.concat_ws("/", F.slice(parts, 1, F.col("depth"))))
    found = up.join(held, "above").groupBy("start").agg(F.max_by("file", "depth").alias("file"))
    return starts.join(found, "start", "left")


class _Rows:
    """A table function: a layer's text as rows of settings, one row for each fault."""

    def eval(self, layer: str, text: str):
        if text is None:
            return
        if layer != "environment":
            found, faults = read_file(text)
            yield from ((key, _said(value), line, None, None) for key, value, line in found)
            yield from ((None, None, line, column, why) for line, column, why in faults)
            return
        for n, one in enumerate(text.split("\n"), 1):
            name, equals, value = one.partition("=")
            if not equals:
                continue
            try:
                if said := variable(name, value):
                    yield said[0], _said(said[1]), n, None, None
            except SettingsError as e:
                yield None, None, n, 1, str(e)


def _said(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


ROWS = "key string, value string, line int, column int, error string"


def rows_of(layers: DataFrame) -> DataFrame:
    """Adds key, value (as JSON), line, column and error to ``layers(layer, text)``: a row for each setting that a text gives and each fault of it.

    The layer ``environment`` has a variable on each line, the others are TOML. A null or empty text gives no row; what a text
    says is judged by itself, so equal texts give equal rows.
    """
    made = F.udtf(_Rows, returnType=ROWS)
    return layers.lateralJoin(made(F.col("layer").outer(), F.col("text").outer()))
