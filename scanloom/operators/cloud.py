"""From depth images to fused voxels and free space: one row for each frame and voxel leaves Python, never one for each pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.capture import unpacked
from . import relational as R

#: Voxel edge, confidence and range of fusion; fixed values of the LiDAR tier and of the estimated tiers.
LIDAR = {"voxel": 0.02, "min_frames": 2, "min_conf": 2, "res": 0.02, "near": 0.1, "far": 5.0}
ESTIMATED = LIDAR | {"voxel": 0.04, "min_frames": 1, "min_conf": 1, "res": 0.05}


def parameters(tier: str, **changed) -> dict:
    return (LIDAR if tier == "lidar" else ESTIMATED) | changed


def back_project(depth: np.ndarray, conf: np.ndarray | None, k: tuple, r: np.ndarray, t: np.ndarray, min_conf: int = 2, near: float = 0.1, far: float = 5.0, flip: bool = False, step: int = 1) -> np.ndarray:
    """World points of the pixels that count, row by row; filters come before the pose is applied."""
    fx, fy, cx, cy = k
    d = depth[::step, ::step]
    good = (d >= near) & (d <= far)
    if conf is not None:
        good &= conf[::step, ::step] >= min_conf
    v, u = np.nonzero(good)
    z = d[v, u].astype(np.float64)
    x, y = (u * step - cx) * z / fx, (v * step - cy) * z / fy
    p = np.stack((x, -y, -z) if flip else (x, y, z), axis=1)
    return p @ np.asarray(r).reshape(3, 3).T + np.asarray(t)


def voxel_rows(points: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed keys in order, numbers of points, sums in micrometres."""
    index = np.floor(points / size).astype(np.int64) + R.KEY_OFFSET
    key = index[:, 0] << 42 | index[:, 1] << 21 | index[:, 2]
    order = np.argsort(key)  # sums are of whole numbers, so equal keys may come in any order
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    scaled = points * 1e6
    um = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled).astype(np.int64)[order]
    sums = np.add.reduceat(um, first, axis=0) if len(key) else um
    return key[first], np.diff(np.concatenate((first, [len(key)]))), sums


def joined_frames(frames: DataFrame, depth: DataFrame, conf: DataFrame) -> DataFrame:
    return frames.join(depth, ["capture_id", "frame"]).join(conf.drop("w", "h"), ["capture_id", "frame"])


def fuse(frames: DataFrame, depth: DataFrame, conf: DataFrame, voxel: float = 0.02, min_frames: int = 2, min_conf: int = 2, near: float = 0.1, far: float = 5.0, stride: int = 1, **_) -> DataFrame:
    """Fused voxels ``(capture_id, voxel, n_points, n_frames, x, y, z)`` seen by at least ``min_frames`` frames."""
    first = frames.groupBy("capture_id").agg(F.min("frame").alias("_first"))
    taken = frames.join(F.broadcast(first), "capture_id").where((F.col("frame") - F.col("_first")) % stride == 0).drop("_first") if stride > 1 else frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                metres, sure = unpacked(row)
                key, n, sums = voxel_rows(back_project(metres, sure, (row.fx, row.fy, row.cx, row.cy), row.r, row.t, min_conf, near, far), voxel)
                yield pd.DataFrame({"capture_id": row.capture_id, "frame": row.frame, "voxel": key, "n": n, "sx": sums[:, 0], "sy": sums[:, 1], "sz": sums[:, 2]})

    partial = joined_frames(taken, depth, conf).mapInPandas(run, "capture_id string, frame int, voxel long, n long, sx long, sy long, sz long")
    return R.fuse_voxels(partial, min_frames, ("capture_id",))


def ray_cells(camera: np.ndarray, ends: np.ndarray, origin: tuple[float, float], res: float, shape: tuple[int, int], stop: float = 0.08) -> np.ndarray:
    """How many rays pass each cell of a raster: samples every half cell, ended ``stop`` before the surface, a cell once for each run of it."""
    h, w = shape
    count = np.zeros(h * w, np.int64)
    delta = ends - camera
    length = np.hypot(delta[:, 0], delta[:, 1])
    steps = np.floor(np.maximum(length - stop, 0) / (res / 2)).astype(np.int64)
    for n in np.unique(steps):
        rays = np.flatnonzero(steps == n)
        at = np.arange(n + 1) * (res / 2)
        x = camera[0] + delta[rays, :1] / np.maximum(length[rays, None], 1e-12) * at
        y = camera[1] + delta[rays, 1:] / np.maximum(length[rays, None], 1e-12) * at
        cx, cy = np.floor((x - origin[0]) / res).astype(np.int64), np.floor((y - origin[1]) / res).astype(np.int64)
        inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
        cell = np.where(inside, cy * w + cx, -1)
        new = np.concatenate((np.ones((len(rays), 1), bool), cell[:, 1:] != cell[:, :-1]), axis=1) & inside
        count += np.bincount(cell[new], minlength=h * w)
    return count.reshape(h, w)


def carve(frames: DataFrame, depth: DataFrame, conf: DataFrame, plan: dict, stride: int = 5, step: int = 4, low: float = -0.1, high: float = 2.0) -> DataFrame:
    """Free space ``(capture_id, cell, rays)`` over the raster that ``plan`` names, saturated at 65,535."""
    from . import rooms

    first = frames.groupBy("capture_id").agg(F.min("frame").alias("_first"))
    taken = frames.join(F.broadcast(first), "capture_id").where((F.col("frame") - F.col("_first")) % stride == 0).drop("_first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor, theta, origin, res, shape = plan["floor"], plan["theta"], plan["origin"], plan["res"], plan["shape"]
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                metres, sure = unpacked(row)
                world = back_project(metres, sure, (row.fx, row.fy, row.cx, row.cy), row.r, row.t, 2, 0.1, 5.0, step=step)
                h = rooms.heights_over(world, floor)
                ends = rooms.plan_xy(world[(h >= low) & (h <= high)], theta)
                count = ray_cells(rooms.plan_xy(np.array([row.t]), theta)[0], ends, origin, res, shape).ravel()
                seen = np.flatnonzero(count)
                yield pd.DataFrame({"capture_id": row.capture_id, "cell": seen, "n": count[seen]})

    return R.saturating_count(joined_frames(taken, depth, conf).mapInPandas(run, "capture_id string, cell long, n long"), ["capture_id", "cell"], F.col("n"))
