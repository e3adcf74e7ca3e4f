"""Pointwise pixel expressions. Integer arithmetic only, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rasterloom import fixed_values as fixed


def clamp_int(value: Column, lo: int, hi: int) -> Column:
    """Clamp to lo..hi; the lower bound wins if lo > hi."""
    return F.greatest(F.lit(lo), F.least(value, F.lit(hi)))


def round_half_away(value: Column) -> Column:
    """Nearest integer, halves away from zero (P10)."""
    return F.when(value >= 0, F.floor(value + 0.5)).otherwise(F.ceil(value - 0.5)).cast("int")


def luminance(b: Column, g: Column, r: Column) -> Column:
    """Gray value of a colour pixel in fixed-point arithmetic."""
    wb, wg, wr = fixed.LUMA_WEIGHTS
    weighted = b * wb + g * wg + r * wr + (1 << (fixed.LUMA_SHIFT - 1))
    return F.shiftright(weighted, fixed.LUMA_SHIFT).cast("int")


def negative(value: Column) -> Column:
    """255 - v (P3, P4)."""
    return F.lit(255) - value


def brightness(value: Column, amount: int) -> Column:
    """v + amount, saturated at 0 and 255."""
    return clamp_int(value + F.lit(int(amount)), 0, 255)


def threshold(value: Column, cutoff: int) -> Column:
    """255 where v is strictly above the cutoff, else 0."""
    return F.when(value > F.lit(int(cutoff)), 255).otherwise(0)


def in_range(value: Column, lo: Column | int, hi: Column | int) -> Column:
    """Inclusive value-range mask (F1)."""
    return value.between(lo, hi)


def composite_level(reflectance: Column, scale: float = 255.0) -> Column:
    """One band of the true-colour composite as a byte.

    The gain is fixed; how the gained reflectance becomes a byte is the remote service's choice, so
    ``scale`` is a parameter: 255 for reflectances in 0..1.
    """
    gained = reflectance * F.lit(fixed.COMPOSITE_GAIN) * F.lit(float(scale))
    return clamp_int(round_half_away(gained), 0, 255)


def gray_text(x: Column, y: Column, v: Column) -> Column:
    """Inspection text of a gray pixel; dashes where the pixel is missing."""
    return _text_or_dashes(x, y, v, v.cast("string"))


def colour_text(x: Column, y: Column, b: Column, g: Column, r: Column, a: Column | None = None) -> Column:
    """Inspection text of a colour pixel, with alpha where there is one."""
    bgr = F.concat(F.lit("BGR("), F.concat_ws(", ", b, g, r), F.lit(")"))
    if a is None:
        return _text_or_dashes(x, y, b, bgr)
    bgra = F.concat(F.lit("BGRA("), F.concat_ws(", ", b, g, r, a), F.lit(")"))
    return _text_or_dashes(x, y, b, F.when(a.isNull(), bgr).otherwise(bgra))


def _text_or_dashes(x: Column, y: Column, present: Column, value: Column) -> Column:
    text = F.concat(F.lit("x: "), x.cast("string"), F.lit(", y: "), y.cast("string"), F.lit(", value: "), value)
    return F.when(present.isNull(), "x: -, y: -, value: -").otherwise(text)
