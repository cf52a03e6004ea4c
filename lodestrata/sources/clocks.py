"""Wall clocks and offsets as files spell them."""

from __future__ import annotations

import re
from datetime import datetime


def parse_offset(text: str) -> int | None:
    m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})?", text)
    if not m or int(m[2]) > 23 or int(m[3] or 0) > 59:
        return None
    return (-1 if m[1] == "-" else 1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60)


def parse_wall_clock(text: str) -> tuple[datetime, int | None] | None:
    """The four spellings of a wall clock, two of them with an offset."""
    for fmt in ("%Y:%m:%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"):
        try:
            return datetime.strptime(text, fmt), None
        except ValueError:
            continue
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})(Z|[+-]\d{2}(?::?\d{2})?)", text)
    offset = (0 if m[2] == "Z" else parse_offset(m[2])) if m else None
    if offset is None:
        return None
    try:
        return datetime.strptime(m[1].replace(" ", "T"), "%Y-%m-%dT%H:%M:%S"), offset
    except ValueError:
        return None
