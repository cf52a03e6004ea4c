"""Names of files: sanitising, templates, companions, manifests."""

from __future__ import annotations

import random
import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitise(text: Column) -> Column:
    """Letters, digits, - and _ stay; a space becomes -, any other code point _."""
    return F.regexp_replace(F.regexp_replace(text, " ", "-"), r"[^\p{IsAlphabetic}\p{N}_-]", "_")


def sanitised_components(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), sanitise)


def one_component(name: Column) -> Column:
    """A name that is one safe path component: never empty, never led by a dot."""
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(F.regexp_replace(name, r"^\.", "_"))


# Strftime directives and what they are in Spark's date patterns.
_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "y": "yy"}


class TemplateError(ValueError):
    """A template that can't be used, with the reason."""


def refuse(pattern: str) -> str:
    """Returns the pattern if it can't lead out of the library; raises otherwise."""
    if not pattern:
        raise TemplateError("the pattern is empty")
    if "\0" in pattern:
        raise TemplateError("the pattern holds a NUL")
    if pattern.startswith("/"):
        raise TemplateError("the pattern is absolute")
    if ".." in pattern:
        raise TemplateError("the pattern holds ..")
    return pattern


def refusal(pattern: Column) -> Column:
    """Why a pattern can't be used, as ``refuse`` says it; null if it can."""
    return (
        F.when(pattern == "", "the pattern is empty")
        .when(F.contains(pattern, F.lit("\0")), "the pattern holds a NUL")
        .when(F.startswith(pattern, F.lit("/")), "the pattern is absolute")
        .when(F.contains(pattern, F.lit("..")), "the pattern holds ..")
    )


def strftime_pattern(fmt: str) -> str:
    """A strftime format as a Spark date pattern."""
    out, i = "", 0
    refuse(fmt)
    while i < len(fmt):
        c = fmt[i]
        if c == "%":
            i += 1
            d = fmt[i : i + 1]
            if d == "%":
                out += "%"
            elif d in _DIRECTIVES:
                out += _DIRECTIVES[d]
            else:
                raise TemplateError(f"%{d} isn't supported")
        elif c == "'":
            out += "''"
        else:
            out += f"'{c}'" if c.isalpha() else c
        i += 1
    return out.replace("''", "") if "'" not in fmt else out


def date_directory(ts: Column, fmt: str = "%Y-%m-%d") -> Column:
    """The directory of a date: rendered, each component sanitised, empty ones dropped; null if nothing is left."""
    parts = sanitised_components(F.date_format(ts, strftime_pattern(fmt)))
    return F.when(F.size(parts) > 0, F.concat_ws("/", parts))


TOKENS = ("date", "time", "location", "ext", "original_stem")


def parse_template(template: str) -> list[tuple[str, str]]:
    """A filename template as (literal, text) and (token, name) pieces; { and } are doubled to stand for themselves."""
    refuse(template)
    if "/" in template:
        raise TemplateError("a file name holds no /")
    pieces, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}|[{}]", template):
        if m.start() > at:
            pieces.append(("literal", template[at : m.start()]))
        at = m.end()
        if m[0] in ("{{", "}}"):
            pieces.append(("literal", m[0][0]))
        elif m[1] is None:
            raise TemplateError(f"a lone {m[0]} in the template")
        elif m[1] not in TOKENS:
            raise TemplateError(f"unknown token {m[1]}")
        else:
            pieces.append(("token", m[1]))
    if at < len(template):
        pieces.append(("literal", template[at:]))
    return pieces


def is_template(template: Column) -> Column:
    """Whether ``parse_template`` takes a template."""
    pieces = r"^([^{}/]|\{\{|\}\}|\{(" + "|".join(TOKENS) + r")\})+$"
    return template.rlike("(?s)" + pieces) & refusal(template).isNull()


def render(template: str, values: dict[str, Column]) -> Column:
    """The template as one expression; token values are sanitised, literals are not. ``location`` carries its own dash."""
    cols = [F.lit(text) if what == "literal" else F.coalesce(sanitise(values[text]), F.lit("")) for what, text in parse_template(template)]
    return one_component(F.concat(*cols))


def location_part(place: Column, country: Column) -> Column:
    """-Place-CC, or nothing where no place is known."""
    return F.when(place.isNotNull(), F.concat(F.lit("-"), sanitise(place), F.lit("-"), sanitise(country))).otherwise("")


def unsorted_name(original_stem: Column, ext: Column, refused: Column) -> Column:
    """The sanitised stem where a date was refused, else ``unknown``."""
    clean = sanitise(original_stem)
    base = F.when(refused & (clean != ""), clean).otherwise("unknown")
    return one_component(F.when(F.coalesce(ext, F.lit("")) != "", F.concat(base, F.lit("."), sanitise(F.lower(ext)))).otherwise(base))


def collision_candidate(name: Column, attempt: Column) -> Column:
    """stem-N.ext, or stem-N without an extension."""
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.concat(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"), F.lit("-"), attempt.cast("string"), ext)


def companion_name(parent_name: Column, companion_ext: Column, full_name: Column) -> Column:
    """The companion's name beside its parent: after the parent's full name or its stem."""
    base = F.when(full_name, parent_name).otherwise(F.regexp_replace(parent_name, r"^(.+)\.[^.]*$", "$1"))
    return F.concat(base, F.lit("."), sanitise(F.lower(companion_ext)))


def manifest_escape(path: Column) -> Column:
    r"""Newlines as \n, carriage returns as \r, other controls as \u{hex}; a backslash stays."""
    out = F.replace(F.replace(path, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    rest = out
    for code in [*range(32), *range(127, 160)]:
        if chr(code) not in "\n\r":
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{{{code:x}}}"))
    return F.when(path.rlike("[\\x00-\\x09\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"), rest).otherwise(out)


def elide(text: Column, most: int = 160) -> Column:
    """Text of over ``most`` bytes cut on a character's edge, with an ellipsis and how many bytes there were."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most)
    # Take off up to three bytes of a character that the cut went through.
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(cut, 1, most - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(whole, F.lit("… ("), F.octet_length(text).cast("string"), F.lit(" bytes)")))


def abbreviate(digest: Column, n: int = 12) -> Column:
    return F.substring(digest, 1, n)


def run_id(now: datetime | None = None, rng: random.Random | None = None) -> str:
    """YYYYMMDD-HHMMSS- and six base-36 characters."""
    now, rng = now or datetime.now(timezone.utc), rng or random.SystemRandom()
    return now.strftime("%Y%m%d-%H%M%S-") + "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(6))


def run_id_of(at: Column, number: Column) -> Column:
    """The run id of a time and a number below 36^6, as an expression."""
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss-"), F.lpad(F.lower(F.conv(number.cast("string"), 10, 36)), 6, "0"))


# Tags of where a date or a time zone came from.
DATE_TAGS = {"exif": "[EXIF]", "sidecar": "[SIDECAR]", "filesystem": "[FS]", "unreadable": "[FS: UNREADABLE]", "unsupported": "[FS: UNSUPPORTED]", "none": "[NO DATE]"}


def date_tag(source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DATE_TAGS.items() for x in kv]), source)


def zone_tag(source: Column) -> Column:
    return F.concat(F.lit("[tz:"), source, F.lit("]"))
