"""The plan document: building it from rooms and openings, checking it, reading and writing it."""

from __future__ import annotations

import json
import math
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Z90
from ..operators import rooms as K
from ..operators import walls as W

VERSION = "1.0"
FACE_SYSTEMATIC, HEIGHT_SYSTEMATIC, INFERRED_SIGMA = 0.005, 0.005, 0.10
RASTER_WIDTH_SIGMA, JAMB_WIDTH_SIGMA = 0.025, 0.012
#: Extra spread from repeat captures, in metres for lengths and relative for areas. Fixed values.
LENGTH_TAU, AREA_TAU = 0.16663, 0.15435
HIGH_AREA, HIGH_LENGTH, LOW = 2.2, 1.6, 0.8
TIERS, SOURCES = {"lidar", "video", "photo"}, {"measured", "inferred"}
OPENING_TYPES = {"door", "window", "opening"}
DAMAGE_CLASSES = {"water_stain", "mould", "crack", "hole", "peeling_paint", "broken_tile"}
NOTE_CODES = {"unobserved_gap", "glass_gap", "mirror", "other"}
UNITS = {"m", "m2", "each"}
RULE_ID = re.compile(r"R-[A-Z]+(?:-[A-Z]+)*-\d{2}")

M = "struct<value:double,ci90:array<double>,source:string>"
SURFACE = "struct<room:string,surface:string>"
PLAN_SCHEMA = (
    "schema_version string, capture_id string, tier string, "
    f"rooms array<struct<id:string,label:string,polygon:array<array<double>>,walls:array<struct<id:string,start:array<double>,end:array<double>,length_m:{M},inferred:boolean>>,"
    f"openings:array<struct<id:string,wall:string,type:string,offset_m:{M},width_m:{M},height_m:{M},sill_m:{M}>>,"
    "ceiling_height_m:struct<observed:boolean,value:double,ci90:array<double>,source:string,reason:string,prior:double>,"
    f"floor_area_m2:{M},notes:array<struct<code:string,wall:string,message:string>>>>, "
    f"adjacency array<struct<rooms:array<string>,via:array<string>>>, footprint_area_m2 {M}, "
    f"damage array<struct<id:string,class:string,location:{SURFACE},centre_m:array<double>,area_m2:{M},width_m:{M},height_m:{M},detection_confidence:double,views:int>>, "
    f"concealed_flags array<struct<id:string,rule_id:string,location:{SURFACE},damage_ids:array<string>,message:string>>, "
    f"scope array<struct<id:string,location:{SURFACE},action:string,quantity:{M},unit:string,damage_ids:array<string>,flag_ids:array<string>>>, "
    "provenance struct<pipeline_version:string,input:string,models:array<struct<name:string,version:string>>,drift_correction:string,runtime_s:double>, diagnostics string"
)


def rounded(v: float, digits: int = 3) -> float:
    """Half away from zero."""
    scale = 10**digits
    return math.copysign(math.floor(abs(v) * scale + 0.5) / scale, v) if v else 0.0


def measurement(v: float, sigma: float, source: str = "measured", scale: float = 0.0, power: int = 1) -> dict:
    wide = math.hypot(sigma, power * scale * v)
    return {"value": rounded(v), "ci90": [rounded(v - Z90 * wide), rounded(v + Z90 * wide)], "source": source}


def lopsided(v: float, high: float) -> dict:
    """For what was seen only in part: a little less to much more."""
    return {"value": rounded(v), "ci90": [rounded(LOW * v), rounded(high * v)], "source": "inferred"}


def face_sigma(w: W.Wall) -> float:
    return INFERRED_SIGMA if w.inferred or w.support <= 0 else math.sqrt(w.spread**2 / w.support + FACE_SYSTEMATIC**2)


def assemble(capture_id: str, rooms: list[W.Room], openings: list[W.Opening], tier: str = "lidar", scale: float = 0.0, calibrated: bool = True, runtime: float = 0.0, drift: str = "off") -> dict:
    """The document of a plan; ids are numbered in the order of rooms, walls and openings."""
    names = {r.label: f"R{i}" for i, r in enumerate(rooms, 1)}
    out, via, wall_no, opening_no = [], {}, 0, 0
    area_sum = area_var = 0.0
    for r in rooms:
        walls, wall_ids, sigmas = [], [], [face_sigma(w) for w in r.walls]
        for i, w in enumerate(r.walls):
            wall_no += 1
            wall_ids.append(f"W{wall_no}")
            sigma = math.hypot(sigmas[i - 1], sigmas[(i + 1) % len(sigmas)])
            if calibrated:
                sigma = math.hypot(sigma, LENGTH_TAU)
            length = lopsided(w.length, HIGH_LENGTH) if r.fallback else measurement(w.length, sigma, "inferred" if w.inferred else "measured", scale)
            walls.append({"id": wall_ids[-1], "start": [rounded(x) for x in w.start], "end": [rounded(x) for x in w.end], "length_m": length, "inferred": bool(w.inferred)})
        own, notes = [], []
        for o in openings:
            if o.room != r.label:
                continue
            if o.kind == "unobserved":
                notes.append({"code": "unobserved_gap", "wall": wall_ids[o.wall], "message": f"a gap of {o.width:.2f} m was not seen well enough to say what it is"})
                continue
            opening_no += 1
            sigma = JAMB_WIDTH_SIGMA if o.jambs else RASTER_WIDTH_SIGMA
            own.append({"id": f"O{opening_no}", "wall": wall_ids[o.wall], "type": o.kind, "offset_m": measurement(o.offset, sigma / math.sqrt(2), scale=scale), "width_m": measurement(o.width, sigma, scale=scale)})
            if len(o.sides) == 2 and all(x in names for x in o.sides):
                via.setdefault(tuple(sorted(o.sides)), []).append(f"O{opening_no}")
        area = K.polygon_area(r.corners)
        variance = sum((w.length * s) ** 2 for w, s in zip(r.walls, sigmas, strict=True))
        if calibrated:
            variance += (AREA_TAU * area) ** 2
        area_sum, area_var = area_sum + area, area_var + variance
        c = r.ceiling
        if c.get("observed"):
            sigma = math.hypot(math.sqrt(c["spread"] ** 2 / max(c["support"], 1)), HEIGHT_SYSTEMATIC)
            ceiling = {"observed": True} | measurement(c["height"], sigma, scale=scale)
        else:
            ceiling = {"observed": False, "value": None, "reason": c.get("reason", "not seen")}
        if r.fallback:
            notes.append({"code": "other", "message": "the outline is the extent of the floor that was seen"})
        whole = lopsided(area, HIGH_AREA) if r.fallback else measurement(area, math.sqrt(variance), scale=scale, power=2)
        out.append({"id": names[r.label], "polygon": [[rounded(x) for x in p] for p in r.corners], "walls": walls, "openings": own, "ceiling_height_m": ceiling, "floor_area_m2": whole, "notes": notes})
    lengths = {n: rounded(K.polygon_area(r.corners), 2) for n, r in zip(names.values(), rooms, strict=True)}
    return {
        "schema_version": VERSION, "capture_id": capture_id, "tier": tier, "rooms": out,
        "adjacency": [{"rooms": [names[a], names[b]], "via": ids} for (a, b), ids in via.items()],
        "footprint_area_m2": measurement(area_sum, math.sqrt(area_var), scale=scale, power=2),
        "damage": [], "concealed_flags": [], "scope": [],
        "provenance": {"pipeline_version": VERSION, "models": [], "drift_correction": drift, "runtime_s": rounded(runtime)},
        "diagnostics": {"region_areas_m2": lengths},
    }


# -- checking ------------------------------------------------------------------------------------------------------------


def validate(plan: dict) -> list[str]:
    """What is wrong with a document; nothing if it is valid. Fields that aren't known are wrong, too."""
    wrong: list[str] = []

    def fields(where: str, d, need: str, may: str = "") -> bool:
        if not isinstance(d, dict):
            wrong.append(f"{where}: an object is expected")
            return False
        missing, unknown = set(need.split()) - set(d), set(d) - set(need.split()) - set(may.split())
        wrong.extend([f"{where}: {k} is missing" for k in sorted(missing)] + [f"{where}: {k} isn't known" for k in sorted(unknown)])
        return not missing

    def one_of(where: str, v, known: set) -> None:
        if v not in known:
            wrong.append(f"{where}: {v!r} isn't one of {', '.join(sorted(known))}")

    def interval(where: str, ci) -> None:
        if not (isinstance(ci, list) and len(ci) == 2 and all(isinstance(x, int | float) for x in ci) and ci[0] <= ci[1]):
            wrong.append(f"{where}: ci90 must be two numbers in order")

    def measured(where: str, m) -> None:
        if fields(where, m, "value ci90", "source"):
            if not isinstance(m["value"], int | float):
                wrong.append(f"{where}: value must be a number")
            interval(where, m["ci90"])
            if "source" in m:
                one_of(where, m["source"], SOURCES)

    def location(where: str, d) -> None:
        fields(where, d, "room surface")

    def each(name: str, of: dict):
        for i, x in enumerate(of.get(name) or []):
            yield f"{name}[{i}]", x

    if not fields("plan", plan, "schema_version capture_id tier rooms adjacency footprint_area_m2 damage concealed_flags scope provenance", "diagnostics"):
        return wrong
    one_of("tier", plan["tier"], TIERS)
    measured("footprint_area_m2", plan["footprint_area_m2"])
    for where, r in each("rooms", plan):
        if not fields(where, r, "id polygon walls openings ceiling_height_m floor_area_m2", "label notes"):
            continue
        if len(r["polygon"]) < 3:
            wrong.append(f"{where}: a polygon has three corners at least")
        measured(f"{where}.floor_area_m2", r["floor_area_m2"])
        for w, wall in each("walls", r):
            if fields(f"{where}.{w}", wall, "id start end length_m inferred"):
                measured(f"{where}.{w}.length_m", wall["length_m"])
        for o, opening in each("openings", r):
            if fields(f"{where}.{o}", opening, "id wall type width_m", "offset_m height_m sill_m"):
                one_of(f"{where}.{o}", opening["type"], OPENING_TYPES)
                for k in ("offset_m", "width_m", "height_m", "sill_m"):
                    if k in opening:
                        measured(f"{where}.{o}.{k}", opening[k])
        for n, note in each("notes", r):
            if fields(f"{where}.{n}", note, "code message", "wall"):
                one_of(f"{where}.{n}", note["code"], NOTE_CODES)
        c, at = r["ceiling_height_m"], f"{where}.ceiling_height_m"
        if fields(at, c, "observed value", "ci90 source reason prior"):
            if c["observed"]:
                if c["value"] is None or "ci90" not in c:
                    wrong.append(f"{at}: what was observed has a value and ci90")
                else:
                    interval(at, c["ci90"])
            elif c["value"] is not None or not c.get("reason"):
                wrong.append(f"{at}: what wasn't observed has no value but a reason")
    for where, a in each("adjacency", plan):
        if fields(where, a, "rooms via") and len(a["rooms"]) != 2:
            wrong.append(f"{where}: two rooms are expected")
    for where, d in each("damage", plan):
        if fields(where, d, "id class location area_m2 width_m height_m detection_confidence", "centre_m views"):
            one_of(where, d["class"], DAMAGE_CLASSES)
            location(f"{where}.location", d["location"])
            for k in ("area_m2", "width_m", "height_m"):
                measured(f"{where}.{k}", d[k])
    for where, f in each("concealed_flags", plan):
        if fields(where, f, "id rule_id location damage_ids message"):
            if not RULE_ID.fullmatch(f["rule_id"]):
                wrong.append(f"{where}: {f['rule_id']!r} isn't a rule id")
            location(f"{where}.location", f["location"])
    for where, s in each("scope", plan):
        if fields(where, s, "id location action quantity unit", "damage_ids flag_ids"):
            one_of(where, s["unit"], UNITS)
            measured(f"{where}.quantity", s["quantity"])
    fields("provenance", plan["provenance"], "pipeline_version models runtime_s", "input drift_correction")
    return wrong


def write_json(path: str, plan: dict) -> None:
    """Writes the document; one that isn't valid is written, too, and then raises."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(plan, out, indent=2, ensure_ascii=False)
    if wrong := validate(plan):
        raise ValueError(f"{path}: " + "; ".join(wrong))


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """Plan documents as nested rows."""
    return spark.read.schema(PLAN_SCHEMA).json(path, multiLine=True)


def plan_walls(plans: DataFrame) -> DataFrame:
    """A row for each wall with its outward normal and line, in plan order."""
    rooms = plans.select("capture_id", F.explode("rooms").alias("room"))
    walls = rooms.select("capture_id", F.col("room.id").alias("room"), F.posexplode("room.walls").alias("i", "w"))
    dx, dy = F.col("w.end")[0] - F.col("w.start")[0], F.col("w.end")[1] - F.col("w.start")[1]
    length = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    nx, ny = dy / length, -dx / length
    return walls.select("capture_id", "room", "i", F.col("w.id").alias("wall"), F.col("w.inferred").alias("inferred"), F.col("w.length_m").alias("length"), nx.alias("nx"), ny.alias("ny"), (nx * F.col("w.start")[0] + ny * F.col("w.start")[1]).alias("c"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


# -- many captures at once ------------------------------------------------------------------------------------------------


def plan_of(capture_id: str, points: np.ndarray, path: np.ndarray, res: float = 0.02, rays=None, **said) -> dict:
    """A capture's plan from its fused points and the camera's way."""
    scene = K.scene_of(points, path, res, rays)
    rooms = W.rooms_of(scene)
    openings = W.assign_openings(scene, rooms) + W.open_boundaries(scene, rooms)
    return assemble(capture_id, rooms, openings, **said)


def extract_plans(points: DataFrame, poses: DataFrame, res: float = 0.02, tier: str = "lidar") -> DataFrame:
    """``points(capture_id, x, y, z)`` and ``poses(capture_id, ts, x, y, z)`` to ``(capture_id, plan, error)``, plan as JSON.

    A capture is one task's work: its cloud is some millions of voxels at most, as fusion bounds it by the space it covers.
    """

    def run(key, cloud: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        plan = error = None
        try:
            ordered = cloud.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy()
            plan = json.dumps(plan_of(key[0], ordered, way.sort_values("ts")[["x", "y", "z"]].to_numpy(), res, tier=tier))
        except K.ExtractionError as e:
            error = str(e)
        return pd.DataFrame({"capture_id": [key[0]], "plan": [plan], "error": [error]})

    return points.groupBy("capture_id").cogroup(poses.groupBy("capture_id")).applyInPandas(run, "capture_id string, plan string, error string")


# -- drawings --------------------------------------------------------------------------------------------------------------

#: Pixels a metre, the margin, the shortest wall with a size, the smallest ring.
SCALE, MARGIN, LABELLED, RING = 100.0, 60.0, 0.4, 6.0


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def pieces(length: float, cuts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What cuts leave of [0, length]."""
    out, at = [], 0.0
    for a, b in sorted(cuts):
        if a > at:
            out.append((at, min(a, length)))
        at = max(at, b)
    if at < length:
        out.append((at, length))
    return out


def draw_svg(plan: dict) -> str:
    """Title, walls without their openings, door arcs, windows, sizes with intervals, rooms with ceilings, damage by width, and a scale bar."""
    corners = np.array([p for r in plan["rooms"] for p in r["polygon"]] or [[0.0, 0.0]])
    low, high = corners.min(axis=0), corners.max(axis=0)
    place = lambda p: ((p[0] - low[0]) * SCALE + MARGIN, (high[1] - p[1]) * SCALE + MARGIN)
    width, height = (high - low) * SCALE + 2 * MARGIN
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height + 40:.0f}" font-family="sans-serif" font-size="12">']

    def line(a, b, style: str) -> None:
        (x0, y0), (x1, y1) = place(a), place(b)
        out.append(f'<line x1="{x0:.1f}" y1="{y0:.1f}" x2="{x1:.1f}" y2="{y1:.1f}" {style}/>')

    def text(p, said: str, more: str = "") -> None:
        x, y = place(p)
        out.append(f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="middle" {more}>{escaped(said)}</text>')

    def between(m: dict) -> str:
        return f"{m['value']:.1f} m² [{m['ci90'][0]:.1f}, {m['ci90'][1]:.1f}]"

    surfaces = {}
    title = f"{plan['capture_id']}, {plan['tier']}, footprint {between(plan['footprint_area_m2'])}"
    out.append(f'<text x="{MARGIN:.0f}" y="24" font-size="16">{escaped(title)}</text>')
    for r in plan["rooms"]:
        out.append('<polygon points="' + " ".join("{:.1f},{:.1f}".format(*place(p)) for p in r["polygon"]) + '" fill="#f4f4f4"/>')
        middle = np.mean(r["polygon"], axis=0)
        surfaces[r["id"], "floor"] = surfaces[r["id"], "ceiling"] = (middle, np.zeros(2))
        for w in r["walls"]:
            a, b = np.array(w["start"]), np.array(w["end"])
            length = float(np.hypot(*(b - a)))
            along = (b - a) / max(length, 1e-9)
            surfaces[r["id"], w["id"]] = (a, along)
            own = [(o, o["offset_m"]["value"], o["offset_m"]["value"] + o["width_m"]["value"]) for o in r["openings"] if o["wall"] == w["id"] and "offset_m" in o]
            for s, e in pieces(length, [(s, e) for _, s, e in own]):
                line(a + s * along, a + e * along, 'stroke="#222" stroke-width="4"' + ' stroke-dasharray="6 4"' * w["inferred"])
            for o, s, e in own:
                p, q = a + s * along, a + e * along
                if o["type"] == "window":
                    line(p, q, 'stroke="#48c" stroke-width="2"')
                elif o["type"] == "door":
                    (x0, y0), (x1, y1) = place(p), place(q)
                    radius = (e - s) * SCALE
                    leaf = place(p + (e - s) * np.array((-along[1], along[0])))
                    out.append(f'<path d="M {x1:.1f} {y1:.1f} A {radius:.1f} {radius:.1f} 0 0 0 {leaf[0]:.1f} {leaf[1]:.1f} L {x0:.1f} {y0:.1f}" fill="none" stroke="#a62"/>')
                text((p + q) / 2, f"{o['type']} {o['width_m']['value']:.2f}", 'fill="#a62" font-size="10" dy="-8"')
            if length >= LABELLED:
                near, far = w["length_m"]["ci90"]
                text((a + b) / 2, f"{w['length_m']['value']:.2f} m ±{(far - near) * 50:.0f} cm", 'fill="#555"')
        ceiling = r["ceiling_height_m"]
        text(middle, r["id"], 'font-weight="bold" dy="-14"')
        text(middle, between(r["floor_area_m2"]))
        text(middle, f"ceiling {ceiling['value']:.2f} m" if ceiling["observed"] and ceiling["value"] is not None else "ceiling not observed", 'dy="14"')
    rules: dict[str, list[str]] = {}
    for f in plan["concealed_flags"]:
        for i in f["damage_ids"]:
            rules.setdefault(i, []).append(f["rule_id"])
    for d in plan["damage"]:
        at, along = surfaces.get((d["location"]["room"], d["location"]["surface"]), (low, np.zeros(2)))
        centre = d.get("centre_m") or [0.0, 0.0]
        p = at + centre[0] * along if along.any() else np.array(centre)
        x, y = place(p)
        radius, on = max(RING, d["width_m"]["value"] * SCALE / 2), d["location"]["surface"]
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{radius:.1f}" fill="none" stroke="#c22" stroke-width="2"/>')
        said = [d["id"], d["class"].replace("_", " "), f"{d['area_m2']['value']:.2f} m²", f"({on})" if on in ("floor", "ceiling") else "", ", ".join(rules.get(d["id"], []))]
        text(p, " ".join(x for x in said if x), f'fill="#c22" dy="{-radius - 2:.0f}"')
    x, y = MARGIN, height + 10
    out.append(f'<line x1="{x}" y1="{y:.0f}" x2="{x + SCALE}" y2="{y:.0f}" stroke="#000" stroke-width="2"/><text x="{x + SCALE / 2}" y="{y + 16:.0f}" text-anchor="middle">1 m</text>')
    return "\n".join([*out, "</svg>"])


def write_svg(path: str, plan: dict) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write(draw_svg(plan))


def write_ply(path: str, points: DataFrame) -> int:
    """Points in the order of their voxels as binary little-endian floats; streamed, not gathered. Returns their number."""
    body = f"{path}.body"
    n = 0
    with open(body, "wb") as out:
        for row in points.orderBy("voxel").select("x", "y", "z").toLocalIterator():
            out.write(np.array(row, "<f4").tobytes())
            n += 1
    with open(path, "wb") as out, open(body, "rb") as rest:
        out.write(f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n".encode())
        while part := rest.read(1 << 20):
            out.write(part)
    os.remove(body)
    return n


def raster_image(scene: K.Scene) -> bytes:
    """Layers of a raster as a grey PNG, y up: floor, occupied, walls, gaps, rooms."""
    from ..sources import png

    r = scene.raster
    image = np.zeros(r.shape, np.uint8)
    image[r.floor > 0] = 60
    image[r.occupied] = 110
    image[scene.label > 0] = 80 + 10 * (scene.label[scene.label > 0] % 8).astype(np.uint8)
    for g in scene.gaps:
        image[g.slices()] = 200
    image[r.wall] = 255
    return png.encode(image[::-1])
