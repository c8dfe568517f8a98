"""Names, verdicts and times as Column expressions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper hue bounds of the colour names.
HUES = [(10, "red"), (24, "orange"), (42, "yellow"), (88, "green"), (135, "blue"), (165, "purple"), (256, "red")]

# Kinds of annotated actions and the words that tell them, the first that applies counts.
ACTIONS = [
    ("shot", ["射门"]),
    ("clearance", ["解围"]),
    ("pass_or_distribution", ["传球", "传递", "送出", "转移"]),
    ("possession_loss_or_tackle", ["抢断", "丢球", "失去球权", "被断", "拦截"]),
    ("dribble", ["盘带", "推进", "带球"]),
    ("ball_protection", ["护球"]),
]


def colour_name(hue: Column, saturation: Column, value: Column) -> Column:
    """A name for a colour of hue 0..180 and the others 0..255: dark and pale ones first, then by hue."""
    out = F.when(value < 55, "black").when((saturation < 45) & (value >= 145), "white").when(saturation < 45, "gray")
    for bound, name in HUES:
        out = out.when(hue < bound, name)
    return out


def keyword_kind(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = ACTIONS, default: str = "key_action") -> Column:
    """The first rule of which a word occurs in the text; the default for none and for null."""
    out = None
    for kind, words in rules:
        hit = F.coalesce(functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(default)


def seconds(text: Column) -> Column:
    """H:M:S, M:S, a fraction of a day (below 1) or plain seconds; null for anything else."""
    p = F.split(F.trim(text), ":")
    n = lambda k: F.get(p, F.lit(k)).try_cast("double")
    one = n(0)
    return (
        F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2))
        .when(F.size(p) == 2, n(0) * 60 + n(1))
        .when((F.size(p) == 1) & (one >= 0) & (one < 1), one * 86400)
        .when(F.size(p) == 1, one)
    )


def number_verdict(votes: Column, runner_votes: Column, margin: Column, confidence: Column, head: Column, full_body: Column) -> Column:
    """A shirt number is in conflict where a second one has support and the margin is narrow, confirmed where it passes every gate, else unreadable."""
    split = (F.coalesce(runner_votes, F.lit(0)) >= 2) & (margin < 0.15)
    sure = (votes >= 5) & (confidence >= 0.20) & (head >= 0.55) & (margin >= 0.10) & full_body
    return F.when(votes.isNull(), "unreadable").when(split, "conflict").when(sure, "confirmed").otherwise("unreadable")


def camera_class(shift: Column, shift_p75: Column, moving: Column, turn: Column, residual: Column, stable: Column) -> Column:
    """fixed, pan_rotate or handheld_translate, from medians and shares of the shifts over the image's diagonal; unknown without measurements."""
    still = (shift < 0.0015) & (shift_p75 < 0.0025) & (moving < 0.20) & (turn < 0.08) & (residual < 1.8)
    pans = (stable >= 0.60) & ((moving >= 0.20) | (shift_p75 >= 0.0025))
    return F.when(shift.isNull(), "unknown").when(still, "fixed").when(pans, "pan_rotate").otherwise("handheld_translate")
