"""Default ranges, names and colours of clusters.

A cluster count is an argument of at most a few dozen, so these are literals that end up as constants
in the plan, never as tables to join.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.schema import LEVELS


def equal_ranges(k: int) -> list[tuple[int, int]]:
    """Equal-width ranges that tile 0..255."""
    if k < 1:
        raise ValueError("at least one cluster is needed")
    width = LEVELS / k
    starts = [int(i * width) for i in range(k)]
    ends = [int(i * width) - 1 for i in range(1, k)] + [LEVELS - 1]
    return list(zip(starts, ends))


def default_ranges(k: int) -> list[tuple[int, int]]:
    """Classification ranges: the preset for six clusters, else equal widths."""
    if k == len(fixed.SIX_CLUSTERS):
        return [(lo, hi) for lo, hi, _, _ in fixed.SIX_CLUSTERS]
    return equal_ranges(max(1, k))


def default_names(k: int) -> list[str]:
    if k == len(fixed.SIX_CLUSTERS):
        return [name for _, _, name, _ in fixed.SIX_CLUSTERS]
    return [fixed.CLUSTER_NAMES[i] if i < len(fixed.CLUSTER_NAMES) else fixed.OTHER for i in range(k)]


def default_colours(k: int) -> list[tuple[int, int, int]]:
    """Preset colours for six clusters, else evenly spaced hues."""
    if k == len(fixed.SIX_CLUSTERS):
        return [rgb for _, _, _, rgb in fixed.SIX_CLUSTERS]
    return [hsv_to_rgb(int(i * 255 / k), fixed.CLUSTER_SATURATION, fixed.CLUSTER_VALUE) for i in range(k)]


def hsv_to_rgb(hue: int, saturation: int, value: int) -> tuple[int, int, int]:
    """Hue in degrees, the rest in 0..255; channels are rounded at 16 bits and cut to 8."""
    sector, part = divmod(hue / 60.0, 1.0)
    s = saturation / 255.0

    def channel(weight: float) -> int:
        return int(value * 257 * weight + 0.5) >> 8

    full, low = channel(1.0), channel(1.0 - s)
    falling, rising = channel(1.0 - s * part), channel(1.0 - s * (1.0 - part))
    wheel = [
        (full, rising, low),
        (falling, full, low),
        (low, full, rising),
        (low, falling, full),
        (rising, low, full),
        (full, low, falling),
    ]
    return wheel[int(sector) % 6]


def ranges_literal(ranges: list[tuple[int, int]]) -> Column:
    """array<struct<cluster, lo, hi>> for ranges that all images share."""
    return F.array(
        *[F.struct(F.lit(i).alias("cluster"), F.lit(int(lo)).alias("lo"), F.lit(int(hi)).alias("hi"))
          for i, (lo, hi) in enumerate(ranges)]
    )


def pick(values: list, index: Column, missing) -> Column:
    """values[index], or ``missing`` where the index is null or past the list."""
    hit = F.try_element_at(F.array(*[F.lit(v) for v in values]), index + 1)
    return F.coalesce(F.when(index >= 0, hit), F.lit(missing))
