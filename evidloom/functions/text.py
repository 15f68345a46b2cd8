"""String, conversion and display functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, Unicode separators such as U+3000 included.
_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def first_full(*arrays: Column) -> Column:
    """The first array that is neither null nor empty; empty if there is none (as ``a or b or []``)."""
    out = None
    for a in arrays:
        out = F.when(F.size(a) > 0, a) if out is None else out.when(F.size(a) > 0, a)
    return out.otherwise(F.filter(arrays[0], lambda x: F.lit(False)))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def contains_folded(whole: Column, part: Column) -> Column:
    """Case-insensitive containment; the empty text is contained in every text, nothing in null."""
    return F.coalesce(F.contains(F.lower(whole), F.lower(part)), F.lit(False))


def close_to(c: Column, value: float | Column, tolerance: float = 0.01) -> Column:
    """Whether a number is nearer than ``tolerance``; false where it can't be read as a number."""
    return F.coalesce(F.abs(c.cast("string").try_cast("double") - (value if isinstance(value, Column) else F.lit(float(value)))) < tolerance, F.lit(False))


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def asset_type(name: Column) -> Column:
    """``pdf`` or ``video`` by extension; null for a type that isn't taken."""
    return F.when(extension(name) == "pdf", "pdf").when(extension(name).isin("mp4", "mkv", "mov"), "video")


def minutes(seconds: Column) -> Column:
    """Seconds as m:ss."""
    whole = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def anchor(modality: Column, at: Column) -> Column:
    """Where evidence is: a time for video, a page for documents."""
    return F.when(modality == "video", minutes(at)).otherwise(F.concat(F.lit("P."), at.cast("int").cast("string")))


def scaled_box(box: Column, width: float, page_width: float = 595.28) -> Column:
    """A JSON box ``[x0, y0, x1, y1]`` in pixels of a page shown ``width`` wide; null where it isn't four numbers."""
    parsed = F.from_json(box, "array<double>")
    return F.when(F.size(parsed) == 4, F.transform(parsed, lambda x: x * F.lit(width / page_width)))


def unfenced(c: Column) -> Column:
    """Text without the code fences that a model puts around JSON."""
    return stripped(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def frame_name(seconds: Column) -> Column:
    return F.format_string("time_%.2f.jpg", seconds)


def frame_seconds(path: Column) -> Column:
    """The seconds in a frame's file name; null for other names."""
    return F.regexp_extract(file_name(path), r"^time_([0-9.]+)\.jpg$", 1).try_cast("double")


def session_name(first_message: Column) -> Column:
    return F.concat(F.lit("Chat-"), F.substring(first_message, 1, 12))


def session_id() -> Column:
    return F.concat(F.lit("CH-"), F.upper(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)))


def without_any(c: Column, keywords: list[str]) -> Column:
    """Whether a line holds none of the keywords, one expression whatever their number; false for null."""
    if not keywords:
        return c.isNotNull()
    return F.coalesce(~F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(c, k)), F.lit(False))


def iso_stamp(ts: Column) -> Column:
    """A time as ISO text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def log_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def clock(ts: Column) -> Column:
    """Hours and minutes of a time."""
    return F.date_format(ts, "HH:mm")


def preview_path(path: Column) -> Column:
    """A stored file's path as it is served: without ``storage``, wherever it stands."""
    return F.replace(path, F.lit("storage"), F.lit(""))
