"""Levels, steps, scores and checks as column expressions. The numbers and names stated here are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Scan quality: the least (or, falling, the most) value of each level; the last level has none.
LEVELS = ("good", "attention", "poor")
SHORT_EDGE_PX = (2000, 1200)
SKEW_DEG = (0.5, 5)
CONTRAST = (0.75, 0.45)
NOISE = (0.2, 0.4)
PERSPECTIVE_DEG = (1.0, 5.0)
#: Millimetres a pixel that can be read, and how far a manual scale may be from an estimated one.
SCALE_RANGE, SCALE_DEVIATION = (1, 200), 0.15
#: Seconds before each further try.
BACKOFF = (60, 300, 900, 3600)
#: Steps of a run and their share of its progress in percent.
STEP_WEIGHTS = (5, 30, 20, 15, 20, 10)
#: Share of a size by which it may differ, the bonus of a style, and what lacks a measure.
SIZE_TOLERANCE, STYLE_BONUS, NO_MEASURE = 0.15, 10.0, 100.0
#: Letters of the identifiers of spatial things, and their bodies.
SPATIAL_ID = "[0-9A-Z]{10,64}"
ULID = "[0-9A-HJKMNP-TV-Z]{26}"


def _level(*bounds: Column) -> Column:
    return F.when(bounds[0], LEVELS[0]).when(bounds[1], LEVELS[1]).otherwise(LEVELS[2])


def resolution_level(short_edge_px: Column) -> Column:
    return _level(*[short_edge_px >= b for b in SHORT_EDGE_PX])


def skew_level(degrees: Column) -> Column:
    """Either way alike; the second bound is out."""
    return _level(F.abs(degrees) <= SKEW_DEG[0], F.abs(degrees) < SKEW_DEG[1])


def contrast_level(score: Column) -> Column:
    return _level(*[score >= b for b in CONTRAST])


def noise_level(score: Column) -> Column:
    return _level(*[score <= b for b in NOISE])


def perspective_level(degrees: Column) -> Column:
    """An unknown spread is good."""
    return _level(degrees.isNull() | (degrees <= PERSPECTIVE_DEG[0]), degrees < PERSPECTIVE_DEG[1])


def worst_level(levels: Column) -> Column:
    """The worst of an array of levels; good where it is empty."""
    rank = F.array_max(F.transform(levels, lambda x: F.array_position(F.lit(list(LEVELS)), x)))
    return F.element_at(F.lit(list(LEVELS)), F.greatest(F.coalesce(rank, F.lit(1)), F.lit(1)).cast("int"))


def scale_range(mm_per_px: Column) -> Column:
    return F.when(mm_per_px < SCALE_RANGE[0], "belowRange").when(mm_per_px > SCALE_RANGE[1], "aboveRange").otherwise("inRange")


def scale_deviation(manual: Column, estimated: Column) -> Column:
    """Relative deviation; 0 for an estimate that is not positive."""
    return F.when(estimated > 0, (manual - estimated) / estimated).otherwise(0.0)


def backoff_step(tries: Column, steps: tuple[int, ...] = BACKOFF) -> Column:
    """Seconds to wait before the next try; null after the last step."""
    return F.try_element_at(F.lit(list(steps)), (tries + 1).cast("int"))


def progress_percent(steps_done: Column) -> Column:
    """The weights of the steps done in a row, summed."""
    upto = [sum(STEP_WEIGHTS[:i]) for i in range(len(STEP_WEIGHTS) + 1)]
    return F.element_at(F.lit(upto), (F.greatest(F.least(steps_done, F.lit(len(STEP_WEIGHTS))), F.lit(0)) + 1).cast("int"))


def fits_size(w: Column, d: Column, want_w: Column, want_d: Column) -> Column:
    """Whether both sides differ by the tolerance at most, turned by 90 degrees or not."""
    near = lambda a, b: F.abs(a - b) <= SIZE_TOLERANCE * F.greatest(b, F.lit(1.0))
    return (near(w, want_w) & near(d, want_d)) | (near(w, want_d) & near(d, want_w))


def style_score(styles: Column, style: Column, lightness: Column, warmth: Column, target: tuple[float, float]) -> Column:
    """The style first, a little more where it is the first named, then nearness of lightness and warmth."""
    bonus = F.when(F.array_contains(styles, style), STYLE_BONUS).otherwise(0.0) + F.when(F.try_element_at(styles, F.lit(1)) == style, 1.0).otherwise(0.0)
    off = F.abs(lightness - target[0]) + F.abs(warmth - target[1])
    return bonus - F.coalesce(off, F.lit(NO_MEASURE))


def has_id(prefix: str, value: Column) -> Column:
    """Whether value is the prefix, an underscore and the body of an identifier."""
    return value.rlike(f"^{prefix}_{ULID}$")


def has_spatial_id(letter: str, value: Column) -> Column:
    return value.rlike(f"^{letter}-{SPATIAL_ID}$")


def any_of(parts: list[Column]) -> Column:
    """Whether any holds; nulls don't."""
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts])
