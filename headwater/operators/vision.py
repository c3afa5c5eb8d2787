"""Image matching in numpy, by frame and logo: homographies, boxes, templates found in a frame.

A group is one logo in one region of one frame, bounded by the key points of an image.
Features come from a function that the caller gives; no library here extracts them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Matching
from . import matching


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points (n, 2) under a homography; those sent to infinity become nan."""
    x = np.column_stack([points, np.ones(len(points))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(x[:, 2:]) > 1e-12, x[:, :2] / x[:, 2:], np.nan)


def fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The homography of least algebraic error that maps src to dst, by direct linear transform on normalised points."""
    if len(src) < 4:
        return None

    def normal(p: np.ndarray) -> np.ndarray:
        centre = p.mean(axis=0)
        spread = np.sqrt(((p - centre) ** 2).sum(axis=1)).mean()
        s = np.sqrt(2) / spread if spread > 1e-12 else 1.0
        return np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])

    t, u = normal(src), normal(dst)
    a, b = project(t, src), project(u, dst)
    zero, one = np.zeros(len(a)), np.ones(len(a))
    rows_x = np.column_stack([-a, -one, zero, zero, zero, b[:, :1] * a, b[:, 0]])
    rows_y = np.column_stack([zero, zero, zero, -a, -one, b[:, 1:] * a, b[:, 1]])
    h = np.linalg.inv(u) @ np.linalg.svd(np.concatenate([rows_x, rows_y]))[2][-1].reshape(3, 3) @ t
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 and np.isfinite(h).all() else None


def homography(src: np.ndarray, dst: np.ndarray, threshold: float = 1.0, tries: int = 500, seed: int = 1) -> tuple[np.ndarray | None, np.ndarray]:
    """A homography by random sample consensus, fitted anew to those that agree, twice; and which points agree.

    Few points are tried in all combinations of four, more by `tries` seeded draws.
    """

    def consensus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, best = len(a), np.zeros(len(a), bool)
        draws = combinations(range(n), 4) if n <= 10 else (rng.choice(n, 4, replace=False) for _ in range(tries))
        for four in draws:
            h = fit(a[list(four)], b[list(four)])
            if h is not None:
                own = np.sqrt(((project(h, a) - b) ** 2).sum(axis=1)) <= threshold
                if own.sum() > best.sum():
                    best = own
        return best

    rng = np.random.default_rng(seed)
    inside = consensus(src, dst)
    if inside.sum() < 4:
        return None, inside
    again = consensus(src[inside], dst[inside])
    inside[np.flatnonzero(inside)[~again]] = False
    return (fit(src[inside], dst[inside]) if inside.sum() >= 4 else None), inside


def smallest_box(points: np.ndarray, share: float = 0.9) -> tuple[float, float, float, float]:
    """x, y, width, height of the least box that holds the share of the points (rounded up).

    Of boxes of one area, the one with the least x, then y, then right, then bottom edge.
    """
    need = int(np.ceil(round(len(points) * share, 9)))
    if not len(points):
        return 0.0, 0.0, 0.0, 0.0
    across = int(len(np.unique(points[:, 1])) > len(np.unique(points[:, 0])))  # edges are tried along the axis of fewer values
    slid, tried = points[np.argsort(points[:, across], kind="stable")][:, [across, 1 - across]].T
    values, counts = np.unique(tried, return_counts=True)
    upto, best = np.concatenate([[0], np.cumsum(counts)]), None
    for i in range(np.searchsorted(upto, len(points) - need, side="right")):
        for j in range(np.searchsorted(upto, upto[i] + need) - 1, len(values)):
            low, high = values[i], values[j]
            x = slid[(tried >= low) & (tried <= high)]
            if low == high:  # no area, whatever the other edges: they begin at the first point
                first, last = slid[0], x[need - 1]
            else:
                k = int(np.argmin((x[need - 1 :] - x[: len(x) - need + 1]) * (high - low)))
                first, last = x[k], x[k + need - 1]
                if first == last:
                    low = values[0]
            area = (last - first) * (high - low)
            found = (area, low, first, high, last) if across else (area, first, low, last, high)
            if best is None or found < best:
                best = found
    _, left, top, right, bottom = best
    return float(left), float(top), float(right - left), float(bottom - top)


def boxes(points: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """keys, x, y, width, height: the smallest box of each group of (keys, px, py)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        box = smallest_box(group[["px", "py"]].to_numpy(float), share)
        return pd.DataFrame([(*(group[k].iloc[0] for k in keys), *box)], columns=[*keys, "x", "y", "width", "height"])

    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    return points.select(*keys, "px", "py").groupBy(*keys).applyInPandas(run, f"{kinds}, x double, y double, width double, height double")


def regular(corners: np.ndarray, width: float, height: float) -> bool:
    """Whether four corners make a plausible view of a region; the same test as matching.quadrilateral_ok."""
    if not np.isfinite(corners).all():
        return False
    nxt, far = np.roll(corners, -1, axis=0), np.roll(corners, -2, axis=0)
    side = ((nxt - corners) ** 2).sum(axis=1)
    even = all(side[j] > 0 and side[i] <= 3 * side[j] and 3 * side[i] >= side[j] for i, j in ((0, 2), (1, 3)))
    w, h = corners.max(axis=0) - corners.min(axis=0)
    doubled = abs((corners[:, 0] * nxt[:, 1] - nxt[:, 0] * corners[:, 1]).sum())
    turn = (nxt[:, 0] - corners[:, 0]) * (far[:, 1] - corners[:, 1]) - (nxt[:, 1] - corners[:, 1]) * (far[:, 0] - corners[:, 0])
    convex = turn.min() > 0.01 or turn.max() < -0.01
    return bool(even and w >= 10 and h >= 10 and w <= 2 * width and h <= 2 * height and doubled >= w * h / 2 and convex)


def locate(logo: np.ndarray, region: np.ndarray, logo_size: tuple[float, float], roi: tuple[float, float, float, float], params: Matching) -> tuple[int, int, int, int] | None:
    """Where a logo lies in a frame (x, y, width, height), from matched points of the logo and of the region roi; None if nowhere.

    The smallest box of most of the logo's points, with a margin, goes through the
    homography; the result must be regular and is cut to the region.
    """
    if len(logo) < params.least_matches:
        return None
    h, _ = homography(logo, region, params.reprojection)
    if h is None:
        return None
    x, y, width, height = smallest_box(logo, params.box_share)
    dx, dy = logo_size[0] * params.margin, logo_size[1] * params.margin
    left, right = max(x - dx, 0.0), min(x + width + dx, logo_size[0] - 1)
    top, bottom = max(y - dy, 0.0), min(y + height + dy, logo_size[1] - 1)
    corners = project(h, np.array([[left, top], [right, top], [right, bottom], [left, bottom]]))
    if not regular(corners, roi[2], roi[3]):
        return None
    low = np.maximum(0, np.trunc(np.minimum(corners.min(axis=0), 1e9))).astype(int)
    high = np.minimum(np.array(roi[2:]), np.trunc(corners.max(axis=0))).astype(int)
    return int(low[0] + roi[0]), int(low[1] + roi[1]), int(high[0] - low[0]), int(high[1] - low[1])


def match_images(logos: DataFrame, regions: DataFrame, params: Matching | None = None) -> DataFrame:
    """logo, region, n_matches, rect: which logos lie in which regions, and where (null: nowhere).

    logos: logo, id, feat, px, py, width, height (of the logo's image); regions: region, id,
    feat, px, py (within the region), x, y, width, height (of the region). Features are
    matched to their two nearest both ways, tested for distinctness and symmetry within each
    pair of logo and region, and the points that remain are located.
    """
    params = params or Matching()
    pair = ("logo", "region")
    names = regions.select("region").distinct(), logos.select("logo").distinct()
    # each side once for every image of the other, which is how often it is searched
    a = logos.crossJoin(F.broadcast(names[0]))
    b = regions.crossJoin(F.broadcast(names[1]))
    forward = matching.ratio_test(matching.two_nearest(a.select("id", "feat", *pair), b.select("id", "feat", *pair), pair), params.ratio, pair)
    backward = matching.ratio_test(matching.two_nearest(b.select("id", "feat", *pair), a.select("id", "feat", *pair), pair), params.ratio, pair)
    both = matching.mutual(forward, backward, pair)
    both = both.join(logos.select("logo", "id", F.col("px").alias("lx"), F.col("py").alias("ly"), F.col("width").alias("lw"), F.col("height").alias("lh")), ["logo", "id"])
    both = both.join(regions.select("region", F.col("id").alias("near"), "px", "py", "x", "y", "width", "height"), ["region", "near"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["id", "near"])
        one = g.iloc[0]
        rect = locate(g[["lx", "ly"]].to_numpy(float), g[["px", "py"]].to_numpy(float), (one["lw"], one["lh"]), tuple(one[["x", "y", "width", "height"]]), params)
        return pd.DataFrame([(one["logo"], one["region"], len(g), list(rect) if rect else None)], columns=["logo", "region", "n_matches", "rect"])

    kinds = f"logo {logos.schema['logo'].dataType.simpleString()}, region {regions.schema['region'].dataType.simpleString()}"
    return both.groupBy(*pair).applyInPandas(run, f"{kinds}, n_matches long, rect array<int>")


def extract(images: DataFrame, features: Callable[[bytes, int, int], list[list[float]]], image: str = "image") -> DataFrame:
    """images' columns without the image, then n features as feat: array<double>, by the caller's function of (data, rows, cols).

    The function runs in Arrow batches; an image that is null or that the function can't read has no features.
    """
    others = [c for c in images.columns if c != image]

    def run(parts):
        for part in parts:
            found = []
            for x in part[image]:
                try:
                    found.append(features(bytes(x["data"]), x["rows"], x["cols"]) if x is not None else [])
                except ValueError:
                    found.append([])
            out = part.drop(columns=[image])
            out["feat"] = found
            out["n"] = [len(f) for f in found]
            yield out[[*others, "n", "feat"]]

    kinds = "".join(f"`{c}` {images.schema[c].dataType.simpleString()}, " for c in others)
    return images.mapInPandas(run, f"{kinds}n long, feat array<array<double>>")


def crop(rows: int, cols: int, data: bytes, x: int, y: int, width: int, height: int, channels: int = 1) -> bytes:
    """The bytes of a region of an image, row by row."""
    a = np.frombuffer(data, np.uint8).reshape(rows, cols, channels)
    return a[y : y + height, x : x + width].tobytes()
