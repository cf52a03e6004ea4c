"""Wall clocks, offsets and zones. A wall clock is TIMESTAMP_NTZ beside an offset in seconds, never an instant."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wall-clock patterns without an offset, and those that need one, in the order they are tried.
BARE = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
ZONED = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
_OFFSET = r"([+-])(\d{2}):?(\d{2})?$"


def offset_seconds(text: Column) -> Column:
    """+08:00, +0800 or +08 in seconds; null unless it starts with a sign and is within a day."""
    at = F.regexp_extract(text, r"^" + _OFFSET, 1)
    hours, minutes = (F.coalesce(F.regexp_extract(text, r"^" + _OFFSET, g).try_cast("int"), F.lit(0)) for g in (2, 3))
    ok = (at != "") & (hours < 24) & (minutes < 60)
    return F.when(ok, F.when(at == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60))


def zone_offset(text: Column) -> Column:
    """Z or a signed offset, in seconds."""
    return F.when(text == "Z", 0).otherwise(offset_seconds(text))


def zone(text: Column) -> Column:
    """struct(kind, offset_s) of Z, a signed offset or the name of a zone: fixed, named or refused."""
    seconds = zone_offset(text)
    return F.struct(F.when(seconds.isNotNull(), "fixed").when(text.isin(*sorted(available_timezones())), "named").otherwise("refused").alias("kind"), seconds.alias("offset_s"))


def wall_clock(text: Column) -> Column:
    """struct(naive, offset_s): the digits by the first pattern that fits, and a trailing offset where there is one."""
    tail = F.regexp_extract(text, r":\d{2}(Z|[+-]\d{2}(?::?\d{2})?)$", 1)
    digits = F.regexp_replace(text, r"(?<=:\d{2})(Z|[+-]\d{2}(?::?\d{2})?)$", "")
    offset = zone_offset(tail)

    def first(values: Column, patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_to_timestamp(values, F.lit(p)).cast("timestamp_ntz") for p in patterns])

    naive = F.when(tail == "", first(text, BARE)).when(offset.isNotNull(), first(digits, ZONED))
    return F.struct(naive.alias("naive"), F.when(naive.isNotNull(), offset).alias("offset_s"))


def instant(naive: Column, offset_s: Column) -> Column:
    """The UTC wall clock of a local one; the digits of the local one are never moved."""
    return naive - F.make_dt_interval(secs=offset_s)


def local(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def offset_in(naive: Column, zone: str) -> Column:
    """Offset of a wall clock in a named zone: the earlier one in an overlap; in a gap that of the digits read as UTC."""

    def seconds(later: Column, earlier: Column) -> Column:
        return F.timestamp_diff("SECOND", earlier, later).cast("int")

    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), naive)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    as_utc = F.convert_timezone(F.lit("UTC"), F.lit(zone), naive)
    return F.when(back == naive, seconds(naive, utc)).otherwise(seconds(as_utc, naive))


def resolve(kind: Column, naive: Column, offset_s: Column, zone: str) -> Column:
    """struct(local_ts, offset_s, tz_source) of a reading: a zoned one keeps its own, an instant moves into the zone, a wall clock takes the zone's offset."""
    moved = local(naive, zone)
    return (
        F.when(kind == "zoned", F.struct(naive.alias("local_ts"), offset_s.cast("int").alias("offset_s"), F.lit("recorded").alias("tz_source")))
        .when(kind == "instant", F.struct(moved.alias("local_ts"), F.timestamp_diff("SECOND", naive, moved).cast("int").alias("offset_s"), F.lit("configured").alias("tz_source")))
        .otherwise(F.struct(naive.alias("local_ts"), offset_in(naive, zone).alias("offset_s"), F.lit("configured").alias("tz_source")))
    )


def container_kind(offset_s: Column) -> Column:
    """A container's value: a non-zero offset is zoned, a zero one an instant, none a wall clock."""
    return F.when(offset_s.isNull(), "wall_clock").when(offset_s == 0, "instant").otherwise("zoned")


def representable(ts: Column) -> Column:
    return F.year(ts).between(0, 9999)


def recorded(source: Column) -> Column:
    return source.isin("exif", "sidecar")


def from_filesystem(source: Column) -> Column:
    return source.isin("filesystem", "unreadable", "unsupported")


def fallback_source(status: Column, recognised: Column, size: Column) -> Column:
    """Why a file's own date is missing: absent, unreadable or unsupported."""
    return F.when(size < 2, "unsupported").when(status == "absent", "filesystem").when(status == "unreadable", "unreadable").when(recognised, "unreadable").otherwise("unsupported")


def prioritised(recorded_ts: Column, companion_dates: Column, file_ts: Column, fallback: Column) -> Column:
    """struct(ts, source): the recorded date, else the first companion date, else the file system's."""
    companion = F.element_at(F.filter(companion_dates, lambda x: x.isNotNull()), F.lit(1))
    companion = F.when(F.size(F.filter(companion_dates, lambda x: x.isNotNull())) > 0, companion)
    return (
        F.when(recorded_ts.isNotNull(), F.struct(recorded_ts.alias("ts"), F.lit("exif").alias("source")))
        .when(companion.isNotNull(), F.struct(companion.alias("ts"), F.lit("sidecar").alias("source")))
        .when(file_ts.isNotNull(), F.struct(file_ts.alias("ts"), fallback.alias("source")))
        .otherwise(F.struct(F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("none").alias("source")))
    )
