"""Small rules as Column expressions: strides, gates, windows, formats, casts, names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the delivered clips, in seconds: length, and the least of it at a video's end.
CLIP, LEAST_CLIP = 7.75, 4.0


def processed_fps(raw_fps: Column, stride: Column) -> Column:
    return raw_fps / F.greatest(stride, F.lit(1))


def sampled(raw_frame: Column, stride: Column) -> Column:
    """Whether a raw frame, from 0, is one that is processed."""
    return F.pmod(raw_frame + 1, F.greatest(stride, F.lit(1))) == 0


def raw_index(frame: Column, stride: Column) -> Column:
    """The raw frame of a processed one."""
    return (frame + 1) * F.greatest(stride, F.lit(1)) - 1


def rectangle_distance(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Distance from a point to the part of a box where a ball is played (20 % wider on either side, from 35 % to 120 % of its height), in box heights."""
    dx = F.greatest(x - 0.2 * w - px, F.lit(0.0), px - (x + 1.2 * w))
    dy = F.greatest(y + 0.35 * h - py, F.lit(0.0), py - (y + 1.2 * h))
    return F.sqrt(dx * dx + dy * dy) / F.greatest(h, F.lit(1.0))


def torso_gate(w: Column, h: Column, edge: Column, overlap: Column, contrast: Column, sharpness: Column, most_overlap: float, least_contrast: float, least_sharpness: float) -> Column:
    """The first reason against a crop of 8 by 16 or more, or accepted."""
    return (
        F.when((w < 8) | (h < 16), "too_small").when(edge, "frame_edge").when(overlap > most_overlap, "person_overlap")
        .when(contrast < least_contrast, "low_information").when(sharpness < least_sharpness, "blurred").otherwise("accepted")
    )


def clip_window(at: Column, before: float, after: float, duration: Column) -> tuple[Column, Column]:
    """[max(0, at - before), min(duration, at + after)], to three digits."""
    return F.round(F.greatest(F.lit(0.0), at - before), 3), F.round(F.least(duration, at + after), 3)


def delivery_window(centre: Column, duration: Column) -> tuple[Column, Column]:
    """A clip of CLIP seconds around its centre, within the video; one that would be too short at the end begins earlier."""
    start = F.greatest(F.lit(0.0), centre - CLIP / 2)
    end = F.least(duration, start + CLIP)
    start = F.when(end - start < LEAST_CLIP, F.greatest(F.lit(0.0), end - CLIP)).otherwise(start)
    return F.round(start, 3), F.round(end, 3)


def minutes(seconds: Column, floor: bool = False, field: int | None = None) -> Column:
    """MM:SS, rounded or cut; null stays null. From 100 minutes on, minutes take as many digits as they need, unless `field` fixes the characters of both parts: longer ones then lose their end, and time before zero has its sign in each part."""
    s = (F.floor(seconds) if floor else F.round(seconds)).cast("long")
    if field is not None:
        rest = s % 60
        part = lambda v: F.lpad(v.cast("string"), field, "0")
        return F.concat(part(((s - rest) / 60).cast("long")), F.lit(":"), part(rest))
    return F.when(s.isNotNull(), F.format_string("%02d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60))))


def number(text: Column, default: float) -> Column:
    """The text as a finite number, else the default."""
    v = text.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v).otherwise(F.lit(default))


def first_present(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in cols])


def number_status(status: Column, value: Column) -> Column:
    """confirmed (with a number only), conflict or unreadable."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    sure = s.isin("confirmed", "eligible_confirmed") & (F.trim(F.coalesce(value, F.lit(""))) != "")
    return F.when(sure, "confirmed").when(s.isin("conflict", "excluded_conflict"), "conflict").otherwise("unreadable")


def team_label(custom: Column, default: Column, team: Column) -> Column:
    return first_present(custom, default, team)


def metric_text(value: Column, digits: int, unit: str, missing: str = "-") -> Column:
    return F.when(value.isNull(), missing).otherwise(F.concat(F.format_string(f"%.{digits}f", F.round(value, digits)), F.lit(f" {unit}")))


def pitch_pixel(x: Column, y: Column, bounds: tuple[float, float, float, float], width: int, height: int, margin: int) -> tuple[Column, Column]:
    """Metres to pixels: bounds (x_min, x_max, y_min, y_max) fill a picture within its margin."""
    sx, sy = (width - 2 * margin) / (bounds[1] - bounds[0]), (height - 2 * margin) / (bounds[3] - bounds[2])
    return F.round(margin + (x - bounds[0]) * sx, 3), F.round(margin + (y - bounds[2]) * sy, 3)


def file_name(text: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; other runs become one underscore."""
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def trial_window(total: Column, start: float = 300.0, length: float = 120.0) -> tuple[Column, Column]:
    """(start, length) of the trial: minutes 5 to 7, or the end of a shorter video."""
    n = F.greatest(F.lit(0.0), F.least(F.lit(length), total))
    return F.when(total <= 0, 0.0).when(start + n <= total, start).otherwise(F.greatest(F.lit(0.0), total - n)), n


def frame_domain(frame: Column, n: Column) -> Column:
    """Whether a frame is one of 0..n-1."""
    return F.coalesce(frame.between(0, n - 1), F.lit(False))


def in_ranges(**ranges: tuple[Column, float, float]) -> Column:
    """The names of the parameters that are null or outside [low, high], joined; empty if all are fine."""
    return F.concat_ws(";", *[F.when(~F.coalesce(c.between(lo, hi), F.lit(False)), name) for name, (c, lo, hi) in ranges.items()])


def verdict(score: Column) -> Column:
    """How well a player fits, by fixed bounds 86 and 72."""
    return F.when(score >= 86, "strong").when(score >= 72, "fit").otherwise("develop")


def extremes(scores: Column, best: int = 4, worst: int = 2) -> tuple[Column, Column]:
    """Names of the best and of the worst dimensions of an array of (name, score), by score, then name."""
    s = F.transform(scores, lambda x: F.struct((-x["score"]).alias("s"), x["name"].alias("name")))
    up = F.array_sort(s)
    down = F.array_sort(F.transform(scores, lambda x: F.struct(x["score"].alias("s"), x["name"].alias("name"))))
    names = lambda a, n: F.array_join(F.transform(F.slice(a, 1, n), lambda x: x["name"]), ";")
    return names(up, best), names(down, worst)


def person_key(explicit: Column, roster: Column, team: Column, number: Column, name: Column, linked: Column | None = None) -> Column:
    """Who a row is about: the explicit key, else roster:<index>, else manual:<team>|<number>|<name> in lower case where there is a name, else linked:<ids> of an array of ids, else ''."""
    said = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    manual = F.concat(F.lit("manual:"), F.concat_ws("|", *[F.lower(said(c)) for c in (team, number, name)]))
    out = F.when(said(explicit) != "", said(explicit)).when(roster.isNotNull(), F.concat(F.lit("roster:"), roster.cast("string"))).when(said(name) != "", manual)
    if linked is not None:
        out = out.when(F.size(linked) > 0, F.concat(F.lit("linked:"), F.array_join(linked.cast("array<string>"), ",")))
    return out.otherwise("")


def short_date(text: Column) -> Column:
    """2024-05-06... as 2024.05.06; other texts as they are."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    iso = (F.length(t) >= 10) & (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-")
    return F.when(iso, F.translate(F.substring(t, 1, 10), "-", ".")).otherwise(t)


def venue(text: Column) -> Column:
    """A name for a folder on any system: characters that some system forbids become one underscore, dots and spaces at the ends go; new_venue where nothing is left."""
    t = F.regexp_replace(F.trim(text), r'[<>:"/\\|?*\x00-\x1f]+', "_")
    t = F.regexp_replace(t, r"^[ .]+|[ .]+$", "")
    return F.when(F.coalesce(t, F.lit("")) != "", t).otherwise("new_venue")


def trimmed(duration: Column, most: float = 8.0) -> tuple[Column, Column]:
    """(offset, length) of a clip of at most so many seconds: its middle part, or all of it up to a hundredth more."""
    fits = duration <= most + 0.01
    return F.when(fits, 0.0).otherwise((duration - most) / 2.0), F.when(fits, F.least(duration, F.lit(most))).otherwise(most)


def merged(incoming: Column, defaults: Column) -> Column:
    """A map over its defaults: what is there wins, null or not, and what isn't follows from the defaults."""
    rest = F.map_filter(defaults, lambda k, v: ~F.coalesce(F.map_contains_key(incoming, k), F.lit(False)))
    return F.map_concat(F.coalesce(incoming, F.map_filter(defaults, lambda k, v: F.lit(False))), rest)


def padded(items: Column, n: int, blank: Column) -> Column:
    """The first n items, and blanks up to n."""
    have = F.slice(F.coalesce(items, F.filter(F.array(blank), lambda x: F.lit(False))), 1, n)
    return F.concat(have, F.array_repeat(blank, (F.lit(n) - F.size(have)).cast("int")))


def reid_stride(seconds: float, fps: Column) -> Column:
    """Frames between two appearance samples, halves to the even one, and one at least."""
    return F.greatest(F.lit(1), F.bround(F.lit(seconds) * fps).cast("int"))
