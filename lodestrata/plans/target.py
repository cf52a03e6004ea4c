"""Where each file goes: dated or unsorted directory, rendered name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names


@dataclass(frozen=True)
class Layout:
    date_directory: str = "%Y-%m-%d"
    filename: str = "{date}-{time}{location}.{ext}"
    unsorted: str = "unsorted"
    include_location: bool = True
    embedded_only: bool = False


def target(files: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Adds directory, name, unsorted and has_location to ``files(original_stem, ext, ts, date_source, place, country, lat, lon)``.

    Total: a file without an admitted, representable date is unsorted, under its own stem if a date was
    refused by the policy and as ``unknown`` otherwise.
    """
    ts, source = F.col("ts"), F.col("date_source")
    refused = ts.isNotNull() & ~dates.recorded(source) if layout.embedded_only else F.lit(False)
    day = names.date_directory(ts, layout.date_directory)
    dated = F.coalesce(ts.isNotNull() & ~refused & dates.representable(ts) & day.isNotNull(), F.lit(False))
    location: Column = names.location_part(F.col("place"), F.col("country")) if layout.include_location else F.lit("")
    values = {"date": F.date_format(ts, "yyyy-MM-dd"), "time": F.date_format(ts, "HHmmss"), "location": location, "ext": F.lower("ext"), "original_stem": F.col("original_stem")}
    return files.withColumns(
        {
            "directory": F.when(dated, day).otherwise(layout.unsorted),
            "name": F.when(dated, names.render(layout.filename, values)).otherwise(names.unsorted_name(F.col("original_stem"), F.col("ext"), refused)),
            "unsorted": ~dated,
            "has_location": F.col("lat").isNotNull() & F.col("lon").isNotNull(),
        }
    )
