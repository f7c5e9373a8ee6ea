"""Time codes, interval measures, names and geometry as Column expressions; NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS = 25


def seconds_to_minute(seconds: Column) -> Column:
    """m:ss of whole seconds."""
    whole = F.floor(seconds)
    return F.when(whole.isNotNull(), F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))


def frame_to_minute(frame: Column, half: Column | None = None, fps: int = FPS) -> Column:
    """m:ss of a frame; with a half column, second-half frames count on from minute 45."""
    shift = F.when(half == "secondHalf", 2700).otherwise(0) if half is not None else F.lit(0)
    return seconds_to_minute(F.floor(frame / fps) + shift)


def frames_to_timecode(frames: Column, form: str = "hms", fps: int = FPS) -> Column:
    """hh:mm:ss ('' for NULL) or, as ms, mm:ss.mmm."""
    if form == "hms":
        s = F.floor(frames / fps)
        return F.coalesce(F.when(frames.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)), F.lit(""))
    if form == "ms":
        ms = F.floor(frames * 1000 / fps)
        return F.coalesce(F.when(frames.isNotNull(), F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms % 60000 / 1000), ms % 1000)), F.lit(""))
    raise ValueError(f"unknown time code form: {form}")


def hms_to_seconds(text: Column) -> Column:
    p = F.split(text, ":")
    return F.try_element_at(p, F.lit(1)).try_cast("long") * 3600 + F.try_element_at(p, F.lit(2)).try_cast("long") * 60 + F.try_element_at(p, F.lit(3)).try_cast("long")


def mmss_to_seconds(text: Column) -> Column:
    """Of mm:ss; minutes may pass 59, and what isn't one gives NULL."""
    p = F.split(text, ":")
    return F.try_element_at(p, F.lit(1)).try_cast("long") * 60 + F.try_element_at(p, F.lit(2)).try_cast("double")


def mmss_to_frame(text: Column, half: Column, fps: int = FPS) -> Column:
    """Frame within the half of a running match clock."""
    shift = F.when(half == "secondHalf", 2700).otherwise(0)
    return F.rint((mmss_to_seconds(text) - shift) * fps).cast("long")


def frame_to_mmss(frame: Column, half: Column, fps: int = FPS) -> Column:
    s = F.floor(frame / fps) + F.when(half == "secondHalf", 2700).otherwise(0)
    return F.when(s.isNotNull(), F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def parse_mmssms(text: Column) -> Column:
    """Seconds of mm:ss:ms, NULL where a part is missing or no number."""
    p = F.split(text, ":")
    return F.try_element_at(p, F.lit(1)).try_cast("long") * 60 + F.try_element_at(p, F.lit(2)).try_cast("long") + F.try_element_at(p, F.lit(3)).try_cast("long") / 1000


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common length of two intervals; below 0 it is their distance."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def temporal_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union; 0 for an empty interval."""
    shared = F.greatest(overlap(a_start, a_end, b_start, b_end), F.lit(0))
    union = (a_end - a_start) + (b_end - b_start) - shared
    return F.when((a_end <= a_start) | (b_end <= b_start) | (union <= 0), 0.0).otherwise(shared / union)


def match_id_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"DFL-MAT-([A-Z0-9]+)", 1), F.lit(""))


def half_of(name: Column) -> Column:
    return F.when(name.contains("firstHalf"), "firstHalf").when(name.contains("secondHalf"), "secondHalf")


def utc(text: Column) -> Column:
    """ISO 8601 with an offset as a timestamp; the session's zone should be UTC."""
    return F.try_to_timestamp(text)


def safe_int(text: Column, default: int | None = None) -> Column:
    got = F.trim(text.cast("string")).try_cast("double").try_cast("long")
    return got if default is None else F.coalesce(got, F.lit(default))


def short_name(name: Column, longest: int = 10) -> Column:
    """First initial and last name, cut; a single name is only cut."""
    p = F.split(F.trim(name), r"\s+")
    both = F.concat(F.substring(F.element_at(p, 1), 1, 1), F.lit(". "), F.element_at(p, -1))
    return F.substring(F.when(F.size(p) > 1, both).otherwise(F.element_at(p, 1)), 1, longest)


def display_name(short: Column, first: Column, last: Column, person_id: Column) -> Column:
    def given(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return F.coalesce(given(short), given(F.concat_ws(" ", given(first), given(last))), person_id)


def name_contains(name: Column, part: str) -> Column:
    return F.lower(name).contains(part.lower())


def straightness(x: str, y: str) -> Column:
    """Aggregate: the root mean square distance of points from their best line."""
    a, b, c = F.var_pop(x), F.covar_pop(x, y), F.var_pop(y)
    return F.sqrt(F.greatest((a + c) / 2 - F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b), F.lit(0.0)))


def attack_angle(dx: Column, dy: Column) -> Column:
    """0 (straight at goal) to 90 (square) degrees."""
    return F.when(F.abs(dx) + F.abs(dy) < 1e-6, 0.0).otherwise(F.degrees(F.atan2(F.abs(dy).cast("double"), F.abs(dx).cast("double"))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def influence_radius(distance: Column, least: float = 4.0, most: float = 10.0) -> Column:
    return F.least(F.greatest(least + 6.0 * (1 - F.exp(-distance / 10.0)), F.lit(least)), F.lit(most))
