"""Drift of a trajectory, from walls and floor seen again: observations in parallel, a small least-squares problem, poses corrected.

The trajectory is cut into chunks of some seconds. Each chunk gets a shift, a turn and a lift (x, y, yaw, h in the plan) such that
every wall and the floor lie at one place in all chunks. Half-second segments of odd number are held out to choose how far
the corrections may go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.capture import unpacked
from . import cloud
from . import rooms as K
from .walls import Room

#: Fixed values.
CHUNK, SEGMENT, PIXEL_STEP, WINDOW, MIN_LENGTH, MIN_POINTS, NEAR_WALL = 4.0, 0.5, 2, 0.06, 0.5, 30, 0.15
SIGMA = np.array([0.01, 0.01, np.radians(0.1), 0.005])
SCALES = (0.03, 0.06, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
MARGIN, WIDE, LANDMARK_PRIOR, PINNED = 0.05, 50.0, 1e-3, 1e6
FLOOR = -1


@dataclass
class Landmark:
    room: int
    nx: float
    ny: float
    c: float
    start: tuple[float, float]
    length: float


def landmarks(rooms: list[Room]) -> list[Landmark]:
    """Walls that were measured and are long enough."""
    return [Landmark(i, w.nx, w.ny, w.c, tuple(w.start), w.length) for i, r in enumerate(rooms) for w in r.walls if not w.inferred and w.length >= MIN_LENGTH]


def seen_by_frame(xy: np.ndarray, h: np.ndarray, camera: np.ndarray, outlines: list[np.ndarray], marks: list[Landmark]) -> list[tuple]:
    """``(landmark, n, sum of offsets, sum of x, sum of y)`` of one frame, sums in micrometres; the floor's offset is the height."""
    um = lambda v: int((np.sign(v) * np.floor(np.abs(v) * 1e6 + 0.5)).sum())
    out = []
    floor = np.abs(h) < 0.05
    if floor.any():
        out.append((FLOOR, int(floor.sum()), um(h[floor]), 0, 0))
    room = next((i for i, p in enumerate(outlines) if len(p) >= 3 and K.contains(p, camera[None])[0]), None)
    band = ~floor & (h >= K.WALL_LOW) & (h <= K.WALL_HIGH)
    if room is None or not band.any():
        return out
    p = xy[band]
    for i, m in enumerate(marks):
        if m.room != room:
            continue
        s = p @ (m.nx, m.ny) - m.c
        t = (p - m.start) @ (-m.ny, m.nx)
        near = (np.abs(s) <= WINDOW) & (t >= NEAR_WALL) & (t <= m.length - NEAR_WALL)
        if near.any():
            out.append((i, int(near.sum()), um(s[near]), um(p[near, 0]), um(p[near, 1])))
    return out


def observations(frames: DataFrame, depth: DataFrame, conf: DataFrame, floor: tuple, theta: float, rooms: list[Room]) -> tuple[DataFrame, DataFrame]:
    """Sums by landmark, chunk and segment, and the mean place of the camera in each chunk. Whole numbers: the order of frames doesn't matter."""
    marks, outlines = landmarks(rooms), [r.corners for r in rooms]
    first = frames.groupBy("capture_id").agg(F.min("ts").alias("t0"))
    timed = frames.join(F.broadcast(first), "capture_id").withColumn("chunk", F.floor((F.col("ts") - F.col("t0")) / CHUNK).cast("int")).withColumn("segment", F.floor((F.col("ts") - F.col("t0")) / SEGMENT).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["capture_id", "chunk", "segment", "landmark", "n", "s", "px", "py"]
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                metres, sure = unpacked(row)
                world = cloud.back_project(metres, sure, (row.fx, row.fy, row.cx, row.cy), row.r, row.t, 2, 0.1, 4.0, step=PIXEL_STEP)
                camera = K.plan_xy(np.array([row.t]), theta)[0]
                rows += [(row.capture_id, row.chunk, row.segment, *o) for o in seen_by_frame(K.plan_xy(world, theta), K.heights_over(world, floor), camera, outlines, marks)]
            yield pd.DataFrame(rows, columns=names)

    joined = cloud.joined_frames(timed, depth, conf)
    each = joined.mapInPandas(run, "capture_id string, chunk int, segment int, landmark int, n long, s long, px long, py long")
    # the floor isn't held out, so its segments are one
    by = each.withColumn("segment", F.when(F.col("landmark") == FLOOR, 0).otherwise(F.col("segment")))
    sums = by.groupBy("capture_id", "landmark", "chunk", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "s", "px", "py")]).where(F.col("n") >= MIN_POINTS)
    chunks = sums.where(F.col("landmark") != FLOOR).groupBy("capture_id", "landmark").agg(F.count_distinct("chunk").alias("chunks"))
    kept = sums.join(chunks, ["capture_id", "landmark"], "left").where((F.col("landmark") == FLOOR) | (F.col("chunks") >= 2)).drop("chunks")
    c, s = np.cos(theta), np.sin(theta)
    x, z = F.col("t")[0], F.col("t")[2]
    way = timed.groupBy("capture_id", "chunk").agg(F.avg(c * x - s * z).alias("x"), F.avg(-s * x - c * z).alias("y"))
    return kept, way


@dataclass
class Correction:
    """For each chunk its middle time, pivot and (dx, dy, yaw, dh); ``scale`` 0 if nothing was worth correcting."""

    middle: np.ndarray
    pivot: np.ndarray
    move: np.ndarray
    scale: float
    before: float
    after: float
    held_out: dict[float, float]

    def at(self, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot and move at times: linear between the middles of chunks, constant beyond."""
        lerp = lambda m: np.column_stack([np.interp(ts, self.middle, m[:, k]) for k in range(m.shape[1])])
        return lerp(self.pivot), lerp(self.move)


def weight(n: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(0.01**2 / np.minimum(n, 200) + 0.002**2)


class System:
    """Rows ``move . g - offset of the landmark = -mean offset``; unknowns are 4 per chunk after the first, the landmarks, the floor."""

    def __init__(self, obs: pd.DataFrame, pivot: np.ndarray, marks: list[Landmark]):
        self.chunks = len(pivot)
        self.columns = {m: i for i, m in enumerate(sorted(set(obs["landmark"])))}
        n = obs["n"].to_numpy(float)
        self.value, self.w = obs["s"].to_numpy(float) / n / 1e6, weight(n)
        self.chunk, self.mark = obs["chunk"].to_numpy(int), obs["landmark"].map(self.columns).to_numpy(int)
        wall = obs["landmark"].to_numpy() != FLOOR
        self.test = wall & (obs["segment"].to_numpy() % 2 == 1)
        place = obs[["px", "py"]].to_numpy(float) / n[:, None] / 1e6 - pivot[self.chunk]
        normal = np.array([(marks[m].nx, marks[m].ny) if m != FLOOR else (0.0, 0.0) for m in obs["landmark"]]).reshape(-1, 2)
        self.g = np.column_stack((normal, normal[:, 1] * place[:, 0] - normal[:, 0] * place[:, 1], ~wall))
        self.wall = wall

    def solve(self, scale: float, train: bool) -> tuple[np.ndarray, np.ndarray]:
        """Moves (chunks x 4) and offsets of landmarks. Scale 0 leaves all moves at zero."""
        moves, marks = 4 * (self.chunks - 1), len(self.columns)
        rows = np.flatnonzero(~self.test) if train else np.arange(len(self.value))
        a = np.zeros((len(rows), moves + marks))
        free = self.chunk[rows] > 0
        if scale > 0:
            at = 4 * (self.chunk[rows][free] - 1)
            for k in range(4):
                a[np.flatnonzero(free), at + k] = self.g[rows][free, k]
        a[np.arange(len(rows)), moves + self.mark[rows]] = -1
        w = self.w[rows, None]
        parts, rhs = [a * w], [-self.value[rows] * self.w[rows]]
        if moves:
            eye = np.eye(moves, moves + marks)
            if scale > 0:
                step = eye.copy()
                step[4:, :moves] -= np.eye(moves)[:-4]
                sigma = np.tile(SIGMA * scale, self.chunks - 1)[:, None]
                parts += [step / sigma, eye / (sigma * WIDE)]
                rhs += [np.zeros(moves)] * 2
            else:
                parts.append(eye * PINNED)
                rhs.append(np.zeros(moves))
        prior = np.zeros((marks, moves + marks))
        prior[:, moves:] = np.eye(marks) * LANDMARK_PRIOR
        x = np.linalg.lstsq(np.concatenate([*parts, prior]), np.concatenate([*rhs, np.zeros(marks)]), rcond=None)[0]
        return np.concatenate((np.zeros((1, 4)), x[:moves].reshape(-1, 4))), x[moves:]

    def scatter(self, move: np.ndarray, offset: np.ndarray, rows: np.ndarray) -> float:
        """Weighted rms of the walls' rests; the weight is w, not its square."""
        rest = self.value + (self.g * move[self.chunk]).sum(axis=1) - offset[self.mark]
        w = self.w[rows]
        return float(np.sqrt((w * rest[rows] ** 2).sum() / w.sum())) if w.sum() else 0.0


def estimate(obs: pd.DataFrame, way: pd.DataFrame, marks: list[Landmark], t0: float) -> Correction:
    """Chooses the scale of the prior on the held-out rows: a wider one must be better than the best so far by the margin."""
    n = int(max(way["chunk"].max(), obs["chunk"].max() if len(obs) else 0)) + 1
    pivot = np.zeros((n, 2))
    pivot[way["chunk"].to_numpy(int)] = way[["x", "y"]].to_numpy(float)
    middle = t0 + (np.arange(n) + 0.5) * CHUNK
    still = Correction(middle, pivot, np.zeros((n, 4)), 0.0, 0.0, 0.0, {})
    if not len(obs):
        return still
    system = System(obs.sort_values(["landmark", "chunk", "segment"]).reset_index(drop=True), pivot, marks)
    best_scale, best = 0.0, system.scatter(*system.solve(0.0, True), system.test)
    held_out = {0.0: best}
    for scale in SCALES:
        held_out[scale] = system.scatter(*system.solve(scale, True), system.test)
        if held_out[scale] < best * (1 - MARGIN):
            best_scale, best = scale, held_out[scale]
    move, offset = system.solve(best_scale, False)
    before = system.scatter(*system.solve(0.0, False), system.wall)
    return Correction(middle, pivot, move, best_scale, before, system.scatter(move, offset, system.wall), held_out)


def corrected(r: np.ndarray, t: np.ndarray, ts: np.ndarray, theta: float, c: Correction) -> tuple[np.ndarray, np.ndarray]:
    """Poses (n x 3 x 3, n x 3) after the correction: a turn about the vertical through the pivot, then the shift and lift."""
    pivot, move = c.at(ts)
    to_world = lambda p: np.column_stack((np.cos(theta) * p[:, 0] - np.sin(theta) * p[:, 1], np.zeros(len(p)), -(np.sin(theta) * p[:, 0] + np.cos(theta) * p[:, 1])))
    cos, sin, zero = np.cos(move[:, 2]), np.sin(move[:, 2]), np.zeros(len(ts))
    turn = np.stack((np.stack((cos, zero, sin), 1), np.stack((zero, zero + 1, zero), 1), np.stack((-sin, zero, cos), 1)), 1)
    at = to_world(pivot)
    lift = np.column_stack((zero, move[:, 3], zero))
    return turn @ r, np.einsum("nij,nj->ni", turn, t - at) + at + to_world(move[:, :2]) + lift


def apply(frames: DataFrame, theta: float, c: Correction) -> DataFrame:
    """``frames`` with corrected poses; the correction is a row for each chunk of one capture, so it travels with the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r, t = corrected(np.stack(pdf["r"]).reshape(-1, 3, 3), np.stack(pdf["t"]), pdf["ts"].to_numpy(), theta, c)
            yield pdf.assign(r=list(r.reshape(-1, 9)), t=list(t))

    return frames.mapInPandas(run, frames.schema)


def report(c: Correction) -> dict:
    """What is kept of an iteration."""
    return {
        "prior_scale": c.scale, "scatter_before_mm": round(c.before * 1000, 3), "scatter_after_mm": round(c.after * 1000, 3),
        "held_out_mm": {str(k): round(v * 1000, 3) for k, v in c.held_out.items()},
        "max_shift_m": float(np.hypot(c.move[:, 0], c.move[:, 1]).max(initial=0)), "max_yaw_rad": float(np.abs(c.move[:, 2]).max(initial=0)),
    }
