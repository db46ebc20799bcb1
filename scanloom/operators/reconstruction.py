"""Around model outputs of video and photo captures: orientation, scale, gravity, chaining, links, and the export they end in.

The models themselves are outside; what they give (depths, points, matches) comes in as tables and arrays.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import png
from . import relational as R
from .compare import robust_umeyama

#: Fixed values.
LONG_SIDE, PATCH, SCALE_FLOOR, BANDS, MIN_INLIERS = 518, 14, 0.06, (0.3, 0.6), 40
MARGIN, MAX_PITCH, MIN_RANGE, AXIS_ANGLE, MIN_SEGMENT = 0.3, 0.35, 1.8, 3.0, 30.0


def upright_turns(frames: DataFrame, by: list[str]) -> DataFrame:
    """Quarter turns that make a camera's images upright, from the upper medians of how its x and y axes rise."""
    axes = frames.select(*by, F.col("r")[3].alias("_x"), F.col("r")[4].alias("_y"))
    m = R.order_statistics(axes, by, "_x", {"_x": R.upper_median}).join(R.order_statistics(axes, by, "_y", {"_y": R.upper_median}), by)
    sideways = F.abs("_x") > F.abs("_y")
    turns = F.when(~sideways & (F.col("_y") <= 0), 0).when(~sideways, 2).when(F.col("_x") > 0, 3).otherwise(1)
    return m.select(*by, turns.alias("turns"))


def image_rotate(image: np.ndarray, turns: int) -> np.ndarray:
    """An image (rows, columns, maybe channels) after ``turns`` quarter turns clockwise, as ``upright_turns`` counts them."""
    return np.ascontiguousarray(np.rot90(image, -turns))


def model_size(width: Column, height: Column) -> tuple[Column, Column]:
    """The size a model sees: the long side fixed, both multiples of the patch."""
    scale = F.lit(float(LONG_SIDE)) / F.greatest(width, height)
    fit = lambda v: F.greatest(F.rint(v * scale / PATCH) * PATCH, F.lit(float(PATCH))).cast("int")
    return fit(width), fit(height)


def metric_scale(ratios: DataFrame, by: list[str], frame: str, ratio: str) -> DataFrame:
    """The scale of a reconstruction: the median over frames of the median ratio of each frame, its robust spread, and its relative error."""
    each = ratios.where(F.col(ratio) > 0).groupBy(*by, frame).agg(F.percentile(ratio, F.lit(0.5)).alias("m"))
    scale = each.groupBy(*by).agg(F.percentile("m", F.lit(0.5)).alias("scale"), F.count("*").alias("frames"))
    off = each.join(scale, by).withColumn("d", F.abs(F.col("m") - F.col("scale")))
    spread = off.groupBy(*by, "scale", "frames").agg((F.percentile("d", F.lit(0.5)) * 1.4826).alias("spread"))
    return spread.withColumn("rel_sigma", F.hypot(F.col("spread") / F.col("scale"), F.lit(SCALE_FLOOR)))


def confidence_bands(pixels: DataFrame, frame: list[str], score: str) -> DataFrame:
    """0, 1 or 2 for each pixel by its frame's quantiles."""
    q = pixels.groupBy(*frame).agg(F.percentile(score, F.array(*[F.lit(b) for b in BANDS])).alias("_q"))
    band = F.when(F.col(score) >= F.col("_q")[1], 2).when(F.col(score) >= F.col("_q")[0], 1).otherwise(0)
    return pixels.join(q, frame).withColumn("confidence", band).drop("_q")


def axis_lengths(segments: DataFrame, by: list[str]) -> DataFrame:
    """Lengths of image segments near the vertical and near the horizontal: what speaks for one way up or the other."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    angle = F.degrees(F.atan2(F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("x1") - F.col("x0"))))
    long = segments.withColumns({"_l": length, "_a": angle}).where(F.col("_l") >= MIN_SEGMENT)
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("_l"))), F.lit(0.0))
    return long.groupBy(*by).agg(some(F.col("_a") <= AXIS_ANGLE).alias("horizontal"), some(F.col("_a") >= 90 - AXIS_ANGLE).alias("vertical"))


def best_links(matches: DataFrame, least: int = MIN_INLIERS) -> DataFrame:
    """``matches(photo_a, photo_b, room_a, room_b, inliers)``: for each pair of rooms the pair of photos with the most inliers."""
    enough = matches.where((F.col("room_a") != F.col("room_b")) & (F.col("inliers") >= least))
    one, two = F.struct(F.col("room_a").alias("r"), F.col("photo_a").alias("p")), F.struct(F.col("room_b").alias("r"), F.col("photo_b").alias("p"))
    sided = enough.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), "inliers")
    best = sided.groupBy(F.col("a.r").alias("room_a"), F.col("b.r").alias("room_b")).agg(F.max(F.struct("inliers", F.col("a.p").alias("pa"), F.col("b.p").alias("pb"))).alias("m"))
    return best.select("room_a", "room_b", F.col("m.pa").alias("photo_a"), F.col("m.pb").alias("photo_b"), F.col("m.inliers").alias("inliers"))


def inside_with_margin(points: DataFrame, edges: DataFrame, key: list[str], x: str, y: str, margin: float = MARGIN) -> DataFrame:
    """Points inside a polygon and at least ``margin`` from all its edges; a point meets the edges of its polygons only."""
    inside = R.in_polygons(points, edges, key, x, y)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    squared = dx * dx + dy * dy
    t = F.when(squared == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(x) - F.col("x0")) * dx + (F.col(y) - F.col("y0")) * dy) / F.nullif(squared, F.lit(0.0)))))
    away = F.hypot(F.col("x0") + t * dx - F.col(x), F.col("y0") + t * dy - F.col(y))
    own = dict.fromkeys([*key, x, y])
    near = points.select(*own).join(inside, key).join(edges, "polygon")
    return near.groupBy(*key, "polygon").agg(F.min(away).alias("distance")).where(F.col("distance") >= margin)


def photo_frames(frames: DataFrame) -> DataFrame:
    """Frames worth taking as photos: well inside a room, level enough, with a view that goes far enough."""
    return frames.where((F.col("distance") >= MARGIN) & (F.abs("pitch") < MAX_PITCH) & (F.col("range") >= MIN_RANGE))


# -- gravity and chaining ----------------------------------------------------------------------------------------------------


def rotation_to_y(v: np.ndarray) -> np.ndarray:
    """The smallest rotation that takes a direction to +y."""
    v = np.asarray(v, float) / np.linalg.norm(v)
    axis, cos = np.cross(v, (0.0, 1.0, 0.0)), float(v[1])
    if np.linalg.norm(axis) < 1e-12:
        return np.eye(3) if cos > 0 else np.diag((1.0, -1.0, -1.0))
    k = np.array(((0, -axis[2], axis[1]), (axis[2], 0, -axis[0]), (-axis[1], axis[0], 0)))
    return np.eye(3) + k + k @ k / (1 + cos)


def floor_up(points: np.ndarray, up: np.ndarray, tries: int = 500, reach: float = 0.02, tilt: float = 0.5, seed: int = 0) -> np.ndarray:
    """The upward normal of the plane that most of the lower points lie on, among planes not too far from ``up``."""
    rng = np.random.default_rng(seed)
    height = points @ up
    low = points[height <= np.quantile(height, 0.4)]
    best, most = np.asarray(up, float), -1
    for _ in range(tries):
        a, b, c = low[rng.choice(len(low), 3, replace=False)]
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        if size < 1e-12:
            continue
        n = n / size * (1 if n @ up > 0 else -1)
        if n @ up < np.cos(tilt):
            continue
        count = int((np.abs((low - a) @ n) <= reach).sum())
        if count > most:
            best, most = n, count
    return best


def chain(chunks: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Similarities that bring each chunk into the first one's place; each comes with the points that it shares with the
    one before: ``(these points in the chunk before, the same points in this chunk)``."""
    out = [(1.0, np.eye(3), np.zeros(3))]
    for before, here in chunks[1:]:
        s, r, t = robust_umeyama(here, before)
        s0, r0, t0 = out[-1]
        out.append((s0 * s, r0 @ r, s0 * r0 @ t + t0))
    return out


# -- export ------------------------------------------------------------------------------------------------------------------


def write_export(folder: str, frames: list[dict], tier: str, rgb: tuple[int, int], rel_sigma: float = 0.0, models: list[dict] | None = None) -> None:
    """Frames with ``ts, position, quaternion, k, depth, score`` (metres; scores become confidence bands) in the layout of a capture."""
    for kind in ("depth", "confidence"):
        os.makedirs(os.path.join(folder, kind), exist_ok=True)
    rows = ["timestamp,frame,x,y,z,qx,qy,qz,qw,fx,fy,cx,cy"]
    for i, f in enumerate(frames):
        d = f["depth"]
        good = np.isfinite(d) & (d > 0) & (d < 65.535)
        low, high = np.quantile(f["score"], BANDS)
        band = (f["score"] >= low).astype(np.uint8) + (f["score"] >= high).astype(np.uint8)
        for kind, image in (("depth", np.where(good, np.round(np.where(good, d, 0) * 1000), 0).astype(np.uint16)), ("confidence", np.where(good, band, 0).astype(np.uint8))):
            with open(os.path.join(folder, kind, f"{i:06d}.png"), "wb") as out:
                out.write(png.encode(image))
        rows.append(",".join(str(x) for x in (f["ts"], i, *f["position"], *f["quaternion"], *f["k"])))
    fx, fy, cx, cy = frames[0]["k"]
    for name, text in (
        ("odometry.csv", "\n".join(rows) + "\n"),
        ("camera_matrix.csv", f"{fx},0,{cx}\n0,{fy},{cy}\n0,0,1\n"),
        ("meta.json", json.dumps({"tier": tier, "rgb_width": rgb[0], "rgb_height": rgb[1], "scale_rel_sigma": rel_sigma, "models": models or []})),
    ):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
            out.write(text)


def write_detections(path: str, model: str, threshold: float, detections: pd.DataFrame) -> None:
    """``frame, class, prompt, score, box`` as the file that ``sources.capture.read_detections`` reads."""
    said = {"model": model, "threshold": threshold, "frames": sorted({int(f) for f in detections["frame"]}), "detections": [{**r, "box": [float(x) for x in r["box"]]} for r in detections.to_dict("records")]}
    with open(path, "w", encoding="utf-8") as out:
        json.dump(said, out)


# -- diagnosis of repeats --------------------------------------------------------------------------------------------------------


def decomposition(walls: DataFrame) -> DataFrame:
    """``walls(pair, room, i, delta, offset_mismatch, measured)`` in plan order: a wall's length comes from the walls before and after it,
    so pairs are split by whether both of these were measured, and summed up."""
    from pyspark.sql import Window

    order = Window.partitionBy("pair", "room").orderBy("i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("measured").over(order), F.last("measured").over(whole))
    after = F.coalesce(F.lead("measured").over(order), F.first("measured").over(whole))
    ends = F.when(before & after, "both ends measured").when(before | after, "one end measured").otherwise("no end measured")
    split = walls.select(ends.alias("ends"), F.abs("delta").alias("median"), F.abs("offset_mismatch").alias("median_offset"))
    found = split.groupBy("ends").agg(F.count("*").alias("pairs"), F.count_if(F.col("median") <= 0.01).alias("passed"))
    for c in ("median", "median_offset"):
        found = found.join(R.order_statistics(split, ["ends"], c, {c: R.upper_median}), "ends")
    return found
