"""Deterministic intensity k-means (C1, C3, C10, A8..A10, J2, J3).

Lloyd's algorithm sees pixels only through their 256 level counts, so it runs on one row per image. The
sums are integers far below 2^53: the centroids equal those of a pass over every pixel to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.functions.colour import equal_ranges, ranges_literal
from rasterloom.functions.pixel import in_range, round_half_away
from rasterloom.operators.histogram import image_counts
from rasterloom.operators.lookup import Settled, lookup_join
from rasterloom.schema import LEVELS

_FIT = "centroids array<double>, iterations int, converged boolean"
_BLOCK = 256  # images clustered at once inside a task


def _lloyd(counts: np.ndarray, start: np.ndarray, max_iter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lloyd steps on many images at once: counts (m, 256), start (m, k)."""
    images, k = start.shape
    levels = np.arange(LEVELS, dtype=np.float64)
    centroids = start.copy()
    iterations = np.zeros(images, dtype=np.int32)
    converged = np.zeros(images, dtype=bool)
    for _ in range(max_iter):
        live = np.flatnonzero(~converged)
        if not live.size:
            break
        now, n = centroids[live], counts[live]
        # ties go to the lowest cluster
        nearest = np.abs(levels[None, :, None] - now[:, None, :]).argmin(axis=2)
        slot = (nearest + np.arange(live.size)[:, None] * k).ravel()
        members = np.bincount(slot, weights=n.ravel(), minlength=live.size * k).reshape(-1, k)
        totals = np.bincount(slot, weights=(n * levels).ravel(), minlength=live.size * k).reshape(-1, k)
        # a cluster without pixels stays where it is
        moved = np.where(members > 0, totals / np.maximum(members, 1), now)
        centroids[live] = moved
        iterations[live] += 1
        converged[live] = np.abs(moved - now).max(axis=1) < fixed.KMEANS_SHIFT
    return centroids, iterations, converged


def _fit_udf(max_iter: int):
    @F.pandas_udf(_FIT)
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for counts, start in batches:
            parts = []
            for at in range(0, len(counts), _BLOCK):
                n = np.stack(counts[at : at + _BLOCK].to_list()).astype(np.float64)
                c = np.stack(start[at : at + _BLOCK].to_list()).astype(np.float64)
                centroids, iterations, converged = _lloyd(n, c, max_iter)
                parts.append(
                    pd.DataFrame(
                        {"centroids": list(np.sort(centroids)), "iterations": iterations, "converged": converged}
                    )
                )
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
                {"centroids": [], "iterations": [], "converged": []}
            )

    return fit


def _midpoints(ranges: Column) -> Column:
    return F.transform(ranges, lambda r: (r["lo"] + r["hi"]) / F.lit(2.0))


def kmeans(
    pixels: DataFrame,
    k: int = fixed.KMEANS_K,
    max_iter: int = fixed.KMEANS_MAX_ITER,
    ranges: list[tuple[int, int]] | DataFrame | None = None,
) -> DataFrame:
    """One row per image: sorted centroids, final ranges, pixel counts, iterations, convergence.

    The start is the midpoints of ``ranges``: equal widths by default, a list for all images, or a table
    (image_id, cluster, lo, hi) for ranges edited per image. There must be exactly max(2, k) of them.
    """
    k = max(2, int(k))
    dense = image_counts(pixels)
    if isinstance(ranges, DataFrame):
        edited = ranges.groupBy("image_id").agg(
            F.array_sort(F.collect_list(F.struct("cluster", "lo", "hi"))).alias("ranges")
        )
        dense = dense.join(edited, "image_id", "left")
        given = F.coalesce(F.col("ranges"), ranges_literal(equal_ranges(k)))
        wrong = F.concat(F.lit(f"expected {k} ranges for image "), F.col("image_id").cast("string"))
        start = F.when(F.size(given) == k, _midpoints(given)).otherwise(F.raise_error(wrong))
    else:
        shared = list(ranges) if ranges else equal_ranges(k)
        if len(shared) != k:
            raise ValueError(f"expected {k} ranges, got {len(shared)}")
        start = F.array(*[F.lit((lo + hi) / 2.0) for lo, hi in shared])
    fit = _fit_udf(int(max_iter))("counts", "start")
    fitted = dense.withColumn("start", start).withColumn("fit", fit)
    ranged = fitted.select(
        "image_id", "counts", "total", "fit.*", ranges_of(F.col("fit.centroids")).alias("ranges")
    )
    members = F.transform("ranges", lambda r: count_between(F.col("counts"), r["lo"], r["hi"]))
    return ranged.withColumn("members", members)


def count_between(counts: Column, lo: Column, hi: Column) -> Column:
    """Pixels with a level in lo..hi, from the 256 counts; 0 if lo > hi."""
    inside = F.slice(counts, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))
    return F.aggregate(inside, F.lit(0).cast("long"), lambda a, n: a + n)


def ranges_of(centroids: Column) -> Column:
    """Ranges between the midpoints of sorted centroids, open to 0 and 255 at the ends."""
    last = F.size(centroids) - 1

    def middle(i: Column) -> Column:
        return F.floor((F.get(centroids, i) + F.get(centroids, i + 1)) / 2.0).cast("int")

    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("cluster"),
            F.when(i == 0, 0).otherwise(middle(i - 1) + 1).alias("lo"),
            F.when(i == last, LEVELS - 1).otherwise(middle(i)).alias("hi"),
        ),
    )


def centroid_table(model: DataFrame) -> DataFrame:
    """(image_id, cluster, centroid), ascending by centroid (O1)."""
    return model.select("image_id", F.posexplode_outer("centroids").alias("cluster", "centroid"))


def range_table(model: DataFrame) -> DataFrame:
    return model.select("image_id", F.inline_outer("ranges"))


def member_table(model: DataFrame) -> DataFrame:
    """(image_id, cluster, n): pixels per cluster by the final ranges."""
    return model.select("image_id", F.posexplode_outer("members").alias("cluster", "n"))


def run_table(model: DataFrame) -> DataFrame:
    return model.select("image_id", F.size("centroids").alias("clusters"), "iterations", "converged")


def range_lookup(ranges: Column) -> Column:
    """array<int> of 256: the cluster of each level, null where no range covers it.

    Where ranges overlap, the highest cluster wins.
    """
    return F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda v: F.array_max(
            F.transform(ranges, lambda r: F.when(in_range(v, r["lo"], r["hi"]), r["cluster"]))
        ),
    )


def nearest_lookup(centroids: Column) -> Column:
    """array<int> of 256: the cluster whose centroid is nearest to each level, ties to the lowest."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda v: F.array_min(
            F.transform(centroids, lambda c, i: F.struct(F.abs(v - c).alias("gap"), i.alias("cluster")))
        )["cluster"],
    )


def level_lookup(model: DataFrame) -> DataFrame:
    """(image_id, lookup, n_pixels): what :func:`with_cluster` joins to the pixels, one row per image."""
    return model.select("image_id", range_lookup(F.col("ranges")).alias("lookup"), F.col("total").alias("n_pixels"))


def with_cluster(pixels: DataFrame, model: DataFrame | Settled, broadcast_bytes: int | None = None) -> DataFrame:
    """Pixels with the cluster of their final range, 0 where no range covers the level.

    Pixels are scanned, not shuffled: each image contributes one 256-entry lookup row. The lookups are settled now, to
    measure them; pass ``settled(level_lookup(model))`` instead of the model to do that once for several uses.
    """
    lookup = model if isinstance(model, Settled) else level_lookup(model)
    joined = lookup_join(pixels, lookup, ["image_id"], "inner", weight="n_pixels", broadcast_bytes=broadcast_bytes)
    cluster = F.coalesce(F.get("lookup", F.col("v")).cast("int"), F.lit(0))
    return joined.withColumn("cluster", cluster).drop("lookup")


def labels(pixels: DataFrame, model: DataFrame) -> DataFrame:
    """(image_id, y, x, cluster)."""
    return with_cluster(pixels, model).select("image_id", "y", "x", "cluster")


def centroid_drift(stored_centroids: DataFrame, model: DataFrame) -> DataFrame:
    """(image_id, cluster, stored, fresh, drift): stored rounded centroids against those of ``model``.

    ``stored_centroids``: (image_id, cluster, centroid), as read back from run files.
    """
    fresh = centroid_table(model).withColumn("fresh", round_half_away(F.col("centroid"))).drop("centroid")
    both = stored_centroids.withColumnRenamed("centroid", "stored").join(fresh, ["image_id", "cluster"], "full")
    return both.select("image_id", "cluster", "stored", "fresh", (F.col("fresh") - F.col("stored")).alias("drift"))
