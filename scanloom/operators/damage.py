"""Detections in images placed on surfaces, merged to regions, judged by rules, turned into repair lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.capture import unpacked
from . import cloud
from . import rooms as K
from .walls import Room

#: Fixed values.
FLOOR_SURFACE, CEILING_SURFACE = -1, -2
NEAR, FAR, MIN_CONF, MIN_PIXELS, CENTRAL, STEP_BACK = 0.1, 5.0, 1, 20, 0.1, 0.15
FLOOR_BELOW, CEILING_WITHIN, CEILING_DEFAULT, WALL_WITHIN, FACE_WITHIN, FACE_SHARE, SLACK = 0.05, 0.15, 2.2, 0.25, 0.06, 0.5, 0.10
KEEP_SCORE, REPORT_SCORE, REPORT_VIEWS, MAX_AREA = 0.20, 0.35, 2, 4.0
DETECT_SCORE, DETECT_AREA, DISTRACTOR_IOU, DISTRACTOR_RATIO = 0.15, 0.20, 0.3, 0.8
RULE_REACH, EXTENT_SIGMA, EXTENT_SHARE = 0.3, 0.03, 0.15
#: Repair action and unit by class, what classes are called, and what rules say (with the class and the height).
SCOPE = {
    "water_stain": ("Stain-block and repaint (after the source is fixed)", "m2"),
    "mould": ("Treat mould, stain-block and repaint", "m2"),
    "peeling_paint": ("Scrape, prime and repaint", "m2"),
    "crack": ("Rake out, fill and repaint crack", "m"),
    "hole": ("Patch and repaint", "each"),
}
OTHER_SCOPE = ("Inspect", "each")
LABELS = {"water_stain": "Water stain", "mould": "Mould", "peeling_paint": "Peeling paint", "crack": "Crack", "hole": "Hole"}
MESSAGES = {
    "R-WET-CEIL-01": "Water stain or mould on the ceiling: possible leak above the ceiling (roof, pipe or the room above).",
    "R-WALL-BASE-01": "%s at the base of the wall (from %.2f m): possible moisture in the wall cavity (rising or penetrating damp).",
    "R-CRACK-DIAG-01": "Crack starting at the corner of an opening: possible structural movement; inspect lintel and foundations.",
}


def at_share(values: np.ndarray, p: float) -> float:
    """The element at index floor(p (n - 1)) of the sorted values."""
    return float(np.sort(values)[int(p * (len(values) - 1))])


def place(depth: np.ndarray, conf: np.ndarray, k: tuple, r, t, box, rgb: tuple[int, int], floor: tuple, theta: float, rooms: list[Room]) -> tuple | None:
    """The surface a box lies on and its extent there, ``(room, wall, u0, u1, v0, v1)``; None for what is on no surface.

    Along walls u runs from the wall's start and v is the height; on floors and ceilings they are plan x and y.
    """
    sx, sy = depth.shape[1] / rgb[0], depth.shape[0] / rgb[1]
    x0, y0, x1, y1 = box
    u0, u1 = int((x0 + CENTRAL * (x1 - x0)) * sx), int((x1 - CENTRAL * (x1 - x0)) * sx)
    v0, v1 = int((y0 + CENTRAL * (y1 - y0)) * sy), int((y1 - CENTRAL * (y1 - y0)) * sy)
    mask = np.zeros(depth.shape, np.uint8)
    mask[max(v0, 0) : v1 + 1, max(u0, 0) : u1 + 1] = 1
    world = cloud.back_project(depth, np.where(mask == 1, conf, 0), k, r, t, MIN_CONF, NEAR, FAR)
    if len(world) < MIN_PIXELS:
        return None
    points = np.column_stack((K.plan_xy(world, theta), K.heights_over(world, floor)))
    centre = np.array([at_share(c, 0.5) for c in points.T])
    at = room_towards(centre[:2], K.plan_xy(np.asarray(t, float)[None], theta)[0], rooms)
    if at is None:
        return None
    table = surfaces(rooms[at])
    chosen = table.nearest(centre)
    if chosen is None or not table.lies_on(points, chosen):
        return None
    along = (points - table.origin[chosen]) @ table.axes[chosen].T
    return (at, int(table.name[chosen]), *(at_share(along[:, i], p) for i in (0, 1) for p in (0.1, 0.9)))


def room_towards(centre: np.ndarray, camera: np.ndarray, rooms: list[Room]) -> int | None:
    """The room of a place on a surface, which is on the very outline: asked a little nearer to the camera."""
    away = camera - centre
    far = float(np.hypot(*away))
    asked = centre + away * (min(STEP_BACK, far) / far if far > 1e-6 else 0.0)
    return next((i for i, q in enumerate(rooms) if K.contains(q.corners, asked[None])[0]), None)


@dataclass
class Surfaces:
    """A room's floor, ceiling and measured walls as planes in plan x, plan y and height, in this order."""

    name: np.ndarray
    normal: np.ndarray
    offset: np.ndarray
    origin: np.ndarray
    axes: np.ndarray  # the two directions in which extents are taken

    def nearest(self, centre: np.ndarray) -> int | None:
        """The floor for what is low, the ceiling for what is high, else the nearest wall in reach."""
        away = self.normal @ centre - self.offset
        rank = np.abs(away)
        rank[rank >= WALL_WITHIN] = np.inf
        rank[0] = -2.0 if away[0] < FLOOR_BELOW else np.inf
        rank[1] = -1.0 if away[1] > -CEILING_WITHIN else np.inf
        best = int(rank.argmin())
        return best if rank[best] < np.inf else None

    def lies_on(self, points: np.ndarray, chosen: int) -> bool:
        """Whether enough points are in the surface itself: things that stand before it aren't."""
        away = points @ self.normal[chosen] - self.offset[chosen]
        if self.name[chosen] == CEILING_SURFACE:
            return at_share(away, 0.9) - at_share(away, 0.1) <= 2 * FACE_WITHIN
        middle = 0.0 if self.name[chosen] == FLOOR_SURFACE else at_share(away, 0.5)
        return float((np.abs(away - middle) <= FACE_WITHIN).mean()) >= FACE_SHARE


def surfaces(room: Room) -> Surfaces:
    height = room.ceiling.get("height", CEILING_DEFAULT) if room.ceiling.get("observed") else CEILING_DEFAULT
    flat = (np.array([0.0, 0.0, 1.0]), np.zeros(3), np.eye(3)[:2])
    rows = [(FLOOR_SURFACE, flat[0], 0.0, *flat[1:]), (CEILING_SURFACE, flat[0], height, *flat[1:])]
    up = [0.0, 0.0, 1.0]
    rows += [(i, np.append(w.normal, 0.0), w.c, np.append(w.start, 0.0), np.array([np.append(w.along, 0.0), up])) for i, w in enumerate(room.walls) if not w.inferred]
    return Surfaces(*(np.array(c) for c in zip(*rows, strict=True)))


PLACED = "capture_id string, seq long, frame int, class string, score double, room int, wall int, u0 double, u1 double, v0 double, v1 double"


def place_detections(detections: DataFrame, frames: DataFrame, depth: DataFrame, conf: DataFrame, floor: tuple, theta: float, rooms: list[Room], rgb: tuple[int, int]) -> DataFrame:
    """``detections(capture_id, seq, frame, class, score, box)`` that count, with their surface and extent; others drop out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PLACED.split(", ")]
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                metres, sure = unpacked(row)
                found = place(metres, sure, (row.fx, row.fy, row.cx, row.cy), row.r, row.t, row.box, rgb, floor, theta, rooms)
                if found is not None:
                    rows.append((row.capture_id, row.seq, row.frame, row.label, row.score, *found))
            yield pd.DataFrame(rows, columns=names)

    kept = detections.where(F.col("score") >= KEEP_SCORE).withColumnRenamed("class", "label")
    return cloud.joined_frames(frames, depth, conf).join(kept, ["capture_id", "frame"]).mapInPandas(run, PLACED)


def merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Extents in order: each goes into the first region that it overlaps, with some slack, or begins one."""
    regions: list[dict] = []
    for r in rows.sort_values("seq").itertuples(index=False):
        for o in regions:
            if r.u0 <= o["u1"] + SLACK and r.u1 >= o["u0"] - SLACK and r.v0 <= o["v1"] + SLACK and r.v1 >= o["v0"] - SLACK:
                o.update(u0=min(o["u0"], r.u0), u1=max(o["u1"], r.u1), v0=min(o["v0"], r.v0), v1=max(o["v1"], r.v1), score=max(o["score"], r.score))
                o["frames"].add(r.frame)
                break
        else:
            regions.append({"seq": r.seq, "score": r.score, "u0": r.u0, "u1": r.u1, "v0": r.v0, "v1": r.v1, "frames": {r.frame}})
    out = pd.DataFrame(regions)
    out["views"] = [len(f) for f in out.pop("frames")]
    return out


def regions(placed: DataFrame) -> DataFrame:
    """Regions of one class on one surface that were seen surely, from several frames, and aren't too large; the best score first."""
    key = ["capture_id", "class", "room", "wall"]
    schema = "capture_id string, class string, room int, wall int, seq long, score double, u0 double, u1 double, v0 double, v1 double, views int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = merge(pdf)
        for k in key:
            found[k] = pdf[k].iloc[0]
        return found[[c.split()[0] for c in schema.split(", ")]]

    merged = placed.groupBy(*key).applyInPandas(run, schema)
    area = (F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))
    kept = merged.where((F.col("score") >= REPORT_SCORE) & (F.col("views") >= REPORT_VIEWS) & (area <= MAX_AREA))
    order = Window.partitionBy("capture_id").orderBy(F.desc("score"), "seq")
    return kept.withColumn("region", F.row_number().over(order) - 1)


def flags(found: DataFrame, openings: DataFrame) -> DataFrame:
    """The first rule that holds for a region: ``(capture_id, region, rule_id, message)``. ``openings(capture_id, room, wall, u0, u1, head)``."""
    wet = F.col("class").isin("water_stain", "mould")
    damp = wet | (F.col("class") == "peeling_paint")
    o = openings.select("capture_id", "room", "wall", F.col("u0").alias("o0"), F.col("u1").alias("o1"), "head")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < RULE_REACH
    corner = (near("u0", "o0") | near("u1", "o1") | near("u1", "o0") | near("u0", "o1")) & near("v0", "head")
    cracks = found.where((F.col("class") == "crack") & (F.col("wall") >= 0))
    hit = cracks.join(o, ["capture_id", "room", "wall"]).where(corner).select("capture_id", "region").distinct().withColumn("at_corner", F.lit(True))
    rule = (
        F.when((F.col("wall") == CEILING_SURFACE) & wet, "R-WET-CEIL-01")
        .when((F.col("wall") >= 0) & (F.col("v0") <= RULE_REACH) & damp, "R-WALL-BASE-01")
        .when(F.col("at_corner"), "R-CRACK-DIAG-01")
    )
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("class")]
    message = F.coalesce(*[F.when(F.col("rule_id") == k, F.format_string(text, label, F.col("v0")) if "%" in text else F.lit(text)) for k, text in MESSAGES.items()])
    judged = found.join(hit, ["capture_id", "region"], "left").withColumn("rule_id", rule).where("rule_id IS NOT NULL")
    return judged.select("capture_id", "region", "rule_id", message.alias("message"))


def filter_detections(detections: DataFrame, distractors: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes that are sure and small enough and that no distractor of the same frame overlaps while scoring about as high."""
    box = lambda a, i: F.col(a)[i]
    area = (box("box", 2) - box("box", 0)) * (box("box", 3) - box("box", 1))
    good = detections.where((F.col("score") >= DETECT_SCORE) & (area <= DETECT_AREA * width * height)).withColumn("_area", area)
    other = distractors.select("frame", F.col("box").alias("dbox"), F.col("score").alias("dscore"))
    wide = F.greatest(F.least(box("box", 2), box("dbox", 2)) - F.greatest(box("box", 0), box("dbox", 0)), F.lit(0.0))
    high = F.greatest(F.least(box("box", 3), box("dbox", 3)) - F.greatest(box("box", 1), box("dbox", 1)), F.lit(0.0))
    both = wide * high
    dsize = (box("dbox", 2) - box("dbox", 0)) * (box("dbox", 3) - box("dbox", 1))
    covered = (both / (F.col("_area") + dsize - both) > DISTRACTOR_IOU) & (F.col("dscore") >= DISTRACTOR_RATIO * F.col("score"))
    return good.join(other, (good["frame"] == other["frame"]) & covered, "left_anti").drop("_area")


def add_damage(plan: dict, found: list[dict], flagged: list[dict]) -> dict:
    """The plan with its damage, flags and repair lines, ids in order; extents carry an interval of their own."""
    from ..plans.document import measurement, rounded

    names = [r["id"] for r in plan["rooms"]]
    walls = [[w["id"] for w in r["walls"]] for r in plan["rooms"]]
    damage, concealed, scope, ids = [], [], [], {}
    for i, r in enumerate(found, 1):
        surface = {FLOOR_SURFACE: "floor", CEILING_SURFACE: "ceiling"}.get(r["wall"]) or walls[r["room"]][r["wall"]]
        where = {"room": names[r["room"]], "surface": surface}
        w, h = r["u1"] - r["u0"], r["v1"] - r["v0"]
        sigma = lambda v: math.hypot(EXTENT_SIGMA, EXTENT_SHARE * v)
        ids[r["region"]] = (f"D{i}", where)
        damage.append({"id": f"D{i}", "class": r["class"], "location": where, "centre_m": [rounded((r["u0"] + r["u1"]) / 2), rounded((r["v0"] + r["v1"]) / 2)], "area_m2": measurement(w * h, math.hypot(sigma(w) * h, sigma(h) * w)), "width_m": measurement(w, sigma(w)), "height_m": measurement(h, sigma(h)), "detection_confidence": rounded(r["score"]), "views": int(r["views"])})
    for i, f in enumerate(flagged, 1):
        name, where = ids[f["region"]]
        concealed.append({"id": f"F{i}", "rule_id": f["rule_id"], "location": where, "damage_ids": [name], "message": f["message"]})
    for i, (r, d) in enumerate(zip(found, damage, strict=True), 1):
        action, unit = SCOPE.get(r["class"], OTHER_SCOPE)
        longer = d["width_m"] if d["width_m"]["value"] >= d["height_m"]["value"] else d["height_m"]
        quantity = {"m2": d["area_m2"], "m": longer}.get(unit) or {"value": 1.0, "ci90": [1.0, 1.0], "source": "measured"}
        line = {"id": f"S{i}", "location": d["location"], "action": action, "quantity": quantity, "unit": unit, "damage_ids": [d["id"]]}
        if mine := [f["id"] for f in concealed if d["id"] in f["damage_ids"]]:
            line["flag_ids"] = mine
        scope.append(line)
    return plan | {"damage": damage, "concealed_flags": concealed, "scope": scope}
