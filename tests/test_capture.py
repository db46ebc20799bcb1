"""Captures on disk: loading, errors, fusion, a whole run on a rendered room."""

import json
import os

import numpy as np
import pytest

from scanloom.operators import cloud, damage
from scanloom.sources import capture, png
from scanloom.storage import saved

HEADER = "timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy, distortion_center_x, distortion_center_y"


def write_capture(folder, rows, depths, confs, matrix="1600,0,959.5\n0,1600,719.5\n0,0,1\n", meta=None):
    for kind in ("depth", "confidence"):
        os.makedirs(folder / kind, exist_ok=True)
    (folder / "camera_matrix.csv").write_text(matrix)
    (folder / "odometry.csv").write_text(HEADER + "\n" + "\n".join(rows) + "\n")
    for i, (d, c) in enumerate(zip(depths, confs, strict=True)):
        (folder / "depth" / f"{i:06d}.png").write_bytes(png.encode(d))
        (folder / "confidence" / f"{i:06d}.png").write_bytes(png.encode(c))
    if meta:
        (folder / "meta.json").write_text(json.dumps(meta))
    return str(folder)


@pytest.fixture
def two_frames(tmp_path):
    d, c = np.zeros((192, 256), np.uint16), np.zeros((192, 256), np.uint8)
    d[0, 0], c[0, 0] = 1500, 2
    half = np.sqrt(0.5)
    rows = ["0.0, 0, 0, 0, 0, 0, 0, 0, 1, 1500, 1500, 959.5, 719.5, , ", f"0.1, 1, 1, 2, 3, 0, {half}, 0, {half}, , , , , , "]
    return write_capture(tmp_path, rows, [d, d], [c, c])


def test_load(spark, two_frames):
    frames, depth, conf, meta = capture.load_capture(spark, two_frames)
    assert meta["tier"] == "lidar"
    one, two = frames.orderBy("frame").collect()
    s = 256 / 1920
    assert one["fx"] == pytest.approx(1500 * s) and two["fx"] == pytest.approx(1600 * s)
    assert (one["cx"], one["cy"]) == pytest.approx((127.5, 95.5))
    r = np.array(two["r"]).reshape(3, 3)
    assert np.allclose(r @ (1, 0, 0), (0, 0, -1)) and two["t"] == [1, 2, 3]
    row = cloud.joined_frames(frames, depth, conf).orderBy("frame").first()
    metres, sure = capture.unpacked(row)
    assert metres[0, 0] == 1.5 and metres[0, 1] == 0 and sure[0, 0] == 2


def test_missing_depth_fails_at_once(spark, two_frames):
    os.remove(f"{two_frames}/depth/000001.png")
    with pytest.raises(capture.CaptureError, match="frame 1"):
        capture.load_capture(spark, two_frames)


def test_bad_matrix_and_empty_odometry(spark, two_frames):
    with open(f"{two_frames}/camera_matrix.csv", "w") as f:
        f.write("1,2\n3,4\n")
    with pytest.raises(capture.CaptureError):
        capture.load_capture(spark, two_frames)


def test_tiers(tmp_path, two_frames):
    assert capture.detect_tier(two_frames) == "lidar"
    (tmp_path / "walk.MP4").write_bytes(b"")
    assert capture.detect_tier(str(tmp_path / "walk.MP4")) == "video"
    (tmp_path / "photos" / "room1").mkdir(parents=True)
    (tmp_path / "photos" / "room1" / "a.jpg").write_bytes(b"")
    assert capture.detect_tier(str(tmp_path / "photos")) == "photo"


def test_three_equal_frames_are_one_voxel(spark, tmp_path):
    rows = [f"{i}, {i}, 0, 0, 0, 0, 0, 0, 1, , , , , , " for i in range(3)]
    d, c = np.full((2, 2), 1000, np.uint16), np.zeros((2, 2), np.uint8)
    path = write_capture(tmp_path, rows, [d] * 3, [c] * 3, "1000,0,-0.5\n0,1000,-0.5\n0,0,1\n", {"rgb_width": 2, "rgb_height": 2})
    frames, depth, conf, _ = capture.load_capture(spark, path)
    voxels = cloud.fuse(frames, depth, conf, min_conf=0).collect()
    assert [(v["n_points"], v["n_frames"]) for v in voxels] == [(12, 3)]


def test_unchanged_stamp(spark, two_frames):
    was = saved(capture.stamp(spark, two_frames + "/depth"), "stamp")
    assert capture.unchanged(was, capture.stamp(spark, two_frames + "/depth"))
    with open(f"{two_frames}/depth/000001.png", "ab") as f:
        f.write(b"x")
    assert not capture.unchanged(was, capture.stamp(spark, two_frames + "/depth"))


def regions_of(spark, rows):
    return spark.createDataFrame(rows, "capture_id string, region int, class string, room int, wall int, u0 double, u1 double, v0 double, v1 double")


def test_rules(spark):
    found = regions_of(spark, [("c", 0, "water_stain", 0, -2, 0.0, 1.0, 0.0, 1.0), ("c", 1, "mould", 0, 1, 0.0, 0.5, 0.1, 0.5), ("c", 2, "crack", 0, 2, 1.85, 2.3, 2.1, 2.6), ("c", 3, "water_stain", 0, 1, 0.0, 0.5, 1.2, 1.5)])
    openings = spark.createDataFrame([("c", 0, 2, 1.0, 1.9, 2.05)], "capture_id string, room int, wall int, u0 double, u1 double, head double")
    got = {r["region"]: r["rule_id"] for r in damage.flags(found, openings).collect()}
    assert got == {0: "R-WET-CEIL-01", 1: "R-WALL-BASE-01", 2: "R-CRACK-DIAG-01"}


def test_place_on_wall(spark):
    from scanloom.operators import walls as W

    room = W.rectangle(1, 0, 0, 4, 3)
    for w in room.walls:
        w.inferred = False
    depth, conf = np.full((192, 256), 1.5), np.full((192, 256), 2, np.uint8)
    r = np.diag((1.0, -1.0, -1.0))
    found = damage.place(depth, conf, (200, 200, 128, 96), r, (2, 1.5, -1.5), (108, 76, 148, 116), (256, 192), (0.0, 0.0, 0.0), 0.0, [room])
    assert found[:2] == (0, 2)
    u0, u1, v0, v1 = found[2:]
    assert (u0 + u1) / 2 == pytest.approx(2, abs=0.02) and (v0 + v1) / 2 == pytest.approx(1.5, abs=0.02) and 0.17 <= u1 - u0 <= 0.24
    rows = [("c", i, f, k, s, *found) for i, (f, k, s) in enumerate([(10, "water_stain", 0.6), (20, "water_stain", 0.5), (30, "crack", 0.2)])]
    placed = spark.createDataFrame(rows, damage.PLACED)
    got = damage.regions(placed).collect()
    assert [(g["class"], g["wall"], g["views"]) for g in got] == [("water_stain", 2, 2)]
    assert damage.regions(placed.limit(1)).count() == 0


def rendered(position, yaw, pitch=0.0, size=(160, 120), room=(4.0, 3.0, 2.5)):
    """Depth of a box room seen by a camera that looks down by ``pitch``, and its rotation."""
    w, h = size
    f = w / 1.6
    u, v = np.meshgrid(np.arange(w), np.arange(h))
    ray = np.stack(((u - (w - 1) / 2) / f, (v - (h - 1) / 2) / f, np.ones((h, w))), axis=-1)
    # plan direction of view and world axes: x right, y up, z towards -plan y
    level = np.array((np.cos(yaw), 0.0, -np.sin(yaw)))
    right = np.cross((0.0, -1.0, 0.0), level)
    forward = np.cos(pitch) * level + np.sin(pitch) * np.array((0.0, -1.0, 0.0))
    down = np.cross(forward, right)
    r = np.column_stack((right, down, forward))
    d = ray @ r.T
    low, high = np.array((0.0, 0.0, -room[1])), np.array((room[0], room[2], 0.0))
    with np.errstate(divide="ignore"):
        t = np.where(d > 0, (high - position) / d, np.where(d < 0, (low - position) / d, np.inf)).min(axis=-1)
    return np.round(t * 1000).astype(np.uint16), r, f


def quaternion(r):
    w = np.sqrt(max(0.0, 1 + np.trace(r))) / 2
    if w > 1e-6:
        return (r[2, 1] - r[1, 2]) / (4 * w), (r[0, 2] - r[2, 0]) / (4 * w), (r[1, 0] - r[0, 1]) / (4 * w), w
    k = int(np.argmax(np.diag(r)))
    q = np.zeros(3)
    q[k] = np.sqrt(max(0.0, (1 + 2 * r[k, k] - np.trace(r)))) / 2
    for j in range(3):
        if j != k:
            q[j] = (r[j, k] + r[k, j]) / (4 * q[k])
    return (*q, 0.0)


def test_rendered_room_from_disk_to_plan(spark, tmp_path):
    from scanloom.pipeline import run_capture
    from scanloom.plans import document

    rows, depths = [], []
    for i in range(72):
        a = 2 * np.pi * i / 24
        position = np.array((2 + 0.4 * np.cos(a), 1.4, -1.5 - 0.3 * np.sin(a)))
        depth, r, f = rendered(position, a, (0.0, 0.5, 0.9)[i // 24])
        depths.append(depth)
        rows.append(", ".join(str(x) for x in (i * 0.25, i, *position, *quaternion(r))) + ", , , , , , ")
    matrix = f"{f},0,79.5\n0,{f},59.5\n0,0,1\n"
    conf = [np.full((120, 160), 2, np.uint8)] * 72
    path = write_capture(tmp_path / "in", rows, depths, conf, matrix, {"rgb_width": 160, "rgb_height": 120})
    plan = run_capture(spark, path, str(tmp_path / "out"), voxel=0.04, min_frames=1, res=0.05)
    assert document.validate(plan) == []
    assert len(plan["rooms"]) == 1
    assert plan["footprint_area_m2"]["value"] == pytest.approx(12, abs=0.5)
    again = document.read_plans(spark, str(tmp_path / "out" / "plan.json"))
    walls = document.plan_walls(again).collect()
    assert sorted(round(w["length"]["value"], 1) for w in walls) == pytest.approx([3, 3, 4, 4], abs=0.11)
    assert os.path.exists(tmp_path / "out" / "plan.svg") and os.path.exists(tmp_path / "out" / "drift.json")
