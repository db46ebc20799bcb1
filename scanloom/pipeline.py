"""From a capture to its plan: fuse, extract, correct drift, place damage, write. The parts are in ``operators``."""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cloud, damage, drift
from .operators import rooms as K
from .operators import walls as W
from .plans import document
from .sources import capture
from .storage import saved

DRIFT_ROUNDS = 2


class Extracted:
    """Scene, rooms and openings of one state of the poses."""

    def __init__(self, frames: DataFrame, depth: DataFrame, conf: DataFrame, p: dict):
        points = cloud.fuse(frames, depth, conf, **p).orderBy("voxel").select("x", "y", "z").toArrow()  # one capture's voxels
        path = frames.orderBy("ts").select("t").toArrow().column("t").to_pylist()
        xyz = np.column_stack([points.column(c).to_numpy() for c in "xyz"]) if points.num_rows else np.zeros((0, 3))

        def rays(floor, theta, raster):
            plan = {"floor": floor, "theta": theta, "origin": (raster.x0, raster.y0), "res": raster.res, "shape": raster.shape}
            count = np.zeros(raster.heights.size, np.int64)
            for cell, n in cloud.carve(frames, depth, conf, plan).select("cell", "rays").toLocalIterator():
                count[cell] = n
            return count.reshape(raster.shape)

        self.scene = K.scene_of(xyz, np.array(path), p["res"], rays)
        self.rooms = W.rooms_of(self.scene)
        self.openings = W.assign_openings(self.scene, self.rooms) + W.open_boundaries(self.scene, self.rooms)


def correct_drift(frames: DataFrame, depth: DataFrame, conf: DataFrame, state: Extracted, p: dict, rounds: int = DRIFT_ROUNDS) -> tuple[DataFrame, Extracted, list[dict]]:
    """Estimates, applies and extracts again until nothing is worth correcting; poses are saved in each round."""
    reports = []
    for _ in range(rounds):
        floor, theta = state.scene.floor["plane"], state.scene.theta
        obs, way = drift.observations(frames, depth, conf, floor, theta, state.rooms)
        first = frames.agg(F.min("ts")).first()[0]
        c = drift.estimate(obs.toPandas(), way.toPandas(), drift.landmarks(state.rooms), first)
        reports.append(drift.report(c))
        if c.scale == 0:
            break
        frames = saved(drift.apply(frames, theta, c), "frames")
        state = Extracted(frames, depth, conf, p)
    return frames, state, reports


def run_capture(spark: SparkSession, path: str, out: str | None = None, capture_id: str | None = None, detections: str | None = None, drift_rounds: int = DRIFT_ROUNDS, calibrated: bool = True, **changed) -> dict:
    """The plan of a capture on disk; written with its drawing, and a report on drift, if ``out`` names a folder.

    Video and photo captures must have been reconstructed to the same layout; ``detections`` is the file of a detector.
    """
    began = time.time()
    name = capture_id or os.path.basename(os.path.normpath(path))
    frames, depth, conf, meta = capture.load_capture(spark, path, name)
    p = cloud.parameters(meta["tier"], **changed)
    depth, conf = saved(depth, "depth"), saved(conf, "conf")  # decoded once, read by every round
    state = Extracted(frames, depth, conf, p)
    frames, state, reports = correct_drift(frames, depth, conf, state, p, drift_rounds) if drift_rounds else (frames, state, [])
    plan = document.assemble(name, state.rooms, state.openings, meta["tier"], meta["scale_rel_sigma"], calibrated, time.time() - began, "on" if any(r["prior_scale"] for r in reports) else "off")
    if detections and meta["tier"] == "lidar":
        plan = with_damage(spark, plan, detections, frames, depth, conf, state, meta)
    if out:
        os.makedirs(out, exist_ok=True)
        document.write_json(os.path.join(out, "plan.json"), plan)
        document.write_svg(os.path.join(out, "plan.svg"), plan)
        with open(os.path.join(out, "drift.json"), "w", encoding="utf-8") as f:
            json.dump({"iterations": reports}, f, indent=2)
    return plan


def with_damage(spark: SparkSession, plan: dict, detections: str, frames: DataFrame, depth: DataFrame, conf: DataFrame, state: Extracted, meta: dict) -> dict:
    found = capture.read_detections(spark, detections).select(F.lit(plan["capture_id"]).alias("capture_id"), F.monotonically_increasing_id().alias("seq"), "frame", "class", "score", "box")
    placed = damage.place_detections(found, frames, depth, conf, state.scene.floor["plane"], state.scene.theta, state.rooms, (meta["rgb_width"], meta["rgb_height"]))
    regions = saved(damage.regions(placed), "regions")
    rows = [(plan["capture_id"], i, o.wall, o.offset, o.offset + o.width, o.height or 2.05) for i, r in enumerate(state.rooms) for o in state.openings if o.room == r.label and o.kind != "unobserved"]
    openings = spark.createDataFrame(rows, "capture_id string, room int, wall int, u0 double, u1 double, head double")
    as_dicts = lambda df: [r.asDict() for r in df.orderBy("region").collect()]  # a plan's regions
    return damage.add_damage(plan, as_dicts(regions), as_dicts(damage.flags(regions, openings)))
