"""Small formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.constants import INDEX_VERSION, SOURCE_WARN_LIMIT


def format_duration(seconds: Column) -> Column:
    """about 40 s, about 3 min, about 1 h 10 min; halves go to the even side."""
    s = F.greatest(seconds, F.lit(0.0))
    whole, minutes = F.greatest(F.bround(s), F.lit(1.0)).cast("long"), F.bround(s / 60).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    long = F.when(rest > 0, F.concat(F.lit("about "), hours.cast("string"), F.lit(" h "), rest.cast("string"), F.lit(" min")))
    return (
        F.when(s < 60, F.concat(F.lit("about "), whole.cast("string"), F.lit(" s")))
        .when(minutes < 60, F.concat(F.lit("about "), minutes.cast("string"), F.lit(" min")))
        .otherwise(F.coalesce(long, F.concat(F.lit("about "), hours.cast("string"), F.lit(" h"))))
    )


def format_bytes(count: Column) -> Column:
    size = count.cast("double")
    step = lambda k, unit: F.format_string(f"%.1f {unit}", size / 1024**k)
    return F.when(size < 1024, F.format_string("%.0f B", size)).when(size < 1024**2, step(1, "KB")).when(size < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))


def short_id(source_id: Column) -> Column:
    return F.substring(source_id, 1, 8)


def stale_reason(title: Column, filename: Column, version: Column) -> Column:
    """Why a source's index is rebuilt; null if it is current."""
    name = F.coalesce(F.when(title != "", title), filename)
    said = F.concat(name, F.lit(": index version "), version.cast("string"), F.lit(f" is older than {INDEX_VERSION}, so it is built again"))
    return F.when(version < INDEX_VERSION, said)


def library_warning(n_sources: Column) -> Column:
    """A note for a library beyond the comfortable size; null otherwise."""
    return F.when(n_sources > SOURCE_WARN_LIMIT, F.format_string(f"the library has %d sources; searches may slow down beyond {SOURCE_WARN_LIMIT}", n_sources))
