"""Convex hull per group as a decomposable aggregate.

The hull of a union is the hull of the hulls, so every task reduces its own points first and
only hull vertices are shuffled, in two rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MERGE_FANOUT = 32
# Sine of the smallest turn at a vertex.  Points in a row, such as a projected meridian, are in
# line only up to rounding and must not count as vertices.
STRAIGHT = 1e-9


def _half(points: np.ndarray) -> list[int]:
    """Indices of one monotone half of the hull of lexicographically sorted points."""
    kept: list[int] = []
    for i in range(len(points)):
        cx, cy = points[i]
        while len(kept) > 1:
            (ax, ay), (bx, by) = points[kept[-2]], points[kept[-1]]
            ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
            if ux * vy - uy * vx > STRAIGHT * np.hypot(ux, uy) * np.hypot(vx, vy):
                break
            kept.pop()
        kept.append(i)
    return kept


def _sorted_distinct(points: np.ndarray) -> np.ndarray:
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    fresh = np.ones(len(points), dtype=bool)
    fresh[1:] = np.any(points[1:] != points[:-1], axis=1)
    return points[fresh]


def _outer(points: np.ndarray) -> np.ndarray:
    """Drop points clearly inside the polygon of the extremes of 16 directions."""
    angles = np.arange(16) * (np.pi / 8)
    reach = points @ np.stack([np.cos(angles), np.sin(angles)])
    corners = points[reach.argmax(axis=0)]
    edges = np.roll(corners, -1, axis=0) - corners
    real = np.any(edges != 0, axis=1)
    corners, edges = corners[real], edges[real]
    if len(corners) < 3:
        return points
    dx = points[:, 0, None] - corners[:, 0]
    dy = points[:, 1, None] - corners[:, 1]
    left = edges[:, 0] * dy - edges[:, 1] * dx
    # rounding can only keep a point too many, never drop a vertex
    slack = 1e-9 * np.abs(edges).max() * np.abs(reach).max()
    return points[(left <= slack).any(axis=1)]


def hull_ring(points: np.ndarray) -> np.ndarray:
    """Strict hull vertices, counter-clockwise from the lowest x."""
    points = np.asarray(points, dtype=float).reshape(-1, 2)
    if len(points) > 64:
        points = _outer(points)
    points = _sorted_distinct(points)
    if len(points) < 3:
        return points
    lower = points[_half(points)]
    upper = points[::-1][_half(points[::-1])]
    return np.concatenate([lower[:-1], upper[:-1]])


def _merge(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[object, np.ndarray] = {}
        for batch in batches:
            for group, part in batch.groupby(key, sort=False):
                points = part[["x", "y"]].to_numpy()
                if group in kept:
                    points = np.concatenate([kept[group], points])
                kept[group] = hull_ring(points)
        for group, ring in kept.items():
            yield pd.DataFrame({key: group, "x": ring[:, 0], "y": ring[:, 1]})

    return run


def convex_hull(points: DataFrame, key: str) -> DataFrame:
    """Hull vertices per group as (key, seq, x, y), counter-clockwise.

    ``x`` and ``y`` must not be NULL.  The running hull of a task never exceeds one batch plus
    the hull so far.  The fan-in to the last merge is one hull per (task group, key).
    """
    kind = points.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, x double, y double"
    partial = points.select(key, "x", "y").mapInPandas(_merge(key), shape)
    # a vertex's own coordinates decide its merge group: the same on every run
    salted = partial.repartition(F.pmod(F.xxhash64("x", "y"), F.lit(MERGE_FANOUT)))
    merged = salted.mapInPandas(_merge(key), shape)

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        ring = hull_ring(part[["x", "y"]].to_numpy())
        return pd.DataFrame(
            {key: part[key].iloc[0], "seq": np.arange(len(ring)), "x": ring[:, 0], "y": ring[:, 1]}
        )

    return merged.groupBy(key).applyInPandas(finish, f"{key} {kind}, seq int, x double, y double")
