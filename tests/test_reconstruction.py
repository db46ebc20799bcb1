"""Orientation, gravity, chaining, exports; many captures at once; files and the command line."""

import json

import numpy as np
import pandas as pd
import pytest
from synthetic import room_points

from scanloom.operators import matching
from scanloom.operators import reconstruction as X
from scanloom.plans import document
from scanloom.sources import capture, png


def test_rotation_to_y():
    rng = np.random.default_rng(0)
    for v in [*rng.normal(size=(20, 3)), (0, 1, 0), (0, -2, 0)]:
        r = X.rotation_to_y(np.array(v, float))
        assert np.allclose(r @ v / np.linalg.norm(v), (0, 1, 0)) and np.linalg.det(r) == pytest.approx(1) and np.allclose(r @ r.T, np.eye(3))


def test_floor_up_finds_the_floor():
    rng = np.random.default_rng(1)
    normal = np.array((0.05, 1.0, -0.03))
    normal /= np.linalg.norm(normal)
    xz = rng.uniform(-3, 3, (4000, 2))
    y = -(normal[0] * xz[:, 0] + normal[2] * xz[:, 1]) / normal[1] + rng.normal(0, 0.003, 4000)
    clutter = rng.uniform((-3, 0.1, -3), (3, 2, 3), (2000, 3))
    up = X.floor_up(np.concatenate((np.column_stack((xz[:, 0], y, xz[:, 1])), clutter)), np.array((0.0, 1.0, 0.0)))
    assert np.degrees(np.arccos(up @ normal)) < 0.5


def test_chain_brings_chunks_into_one_place():
    rng = np.random.default_rng(2)
    world = rng.normal(size=(3, 40, 3))
    turn = lambda a: np.array(((np.cos(a), -np.sin(a), 0), (np.sin(a), np.cos(a), 0), (0, 0, 1)))
    own = [lambda p: p, lambda p: 2 * p @ turn(0.4).T + 1, lambda p: 0.5 * p @ turn(-0.7).T - 2]
    chunks = [(None, None), (own[0](world[1]), own[1](world[1])), (own[1](world[2]), own[2](world[2]))]
    s, r, t = X.chain(chunks)[2]
    assert np.allclose(s * own[2](world[0]) @ r.T + t, world[0])


def test_export_is_a_capture(spark, tmp_path):
    rng = np.random.default_rng(3)
    depth = rng.uniform(0.5, 4, (2, 6, 8))
    depth[0, 0, 0] = np.nan
    frames = [{"ts": float(i), "position": (0, 1, i), "quaternion": (0, 0, 0, 1), "k": (5.0, 5.0, 3.5, 2.5), "depth": d, "score": rng.random((6, 8))} for i, d in enumerate(depth)]
    X.write_export(str(tmp_path), frames, "video", (8, 6), 0.06)
    got, images, conf, meta = capture.load_capture(spark, str(tmp_path))
    assert meta["tier"] == "video" and meta["scale_rel_sigma"] == 0.06 and got.count() == 2
    row = images.join(conf.drop("w", "h"), "frame").orderBy("frame").first()
    metres, sure = capture.unpacked(row)
    assert metres[0, 0] == 0 and sure[0, 0] == 0 and np.abs(metres - np.nan_to_num(depth[0])).max() <= 0.0005
    assert set(np.unique(sure)) == {0, 1, 2}


def test_detections_round_trip(spark, tmp_path):
    found = pd.DataFrame([{"frame": 3, "class": "mould", "prompt": "mould on a wall", "score": 0.5, "box": [1, 2, 3, 4]}])
    X.write_detections(str(tmp_path / "d.json"), "m", 0.15, found)
    assert [r.asDict() for r in capture.read_detections(spark, str(tmp_path / "d.json")).collect()] == [{"frame": 3, "class": "mould", "prompt": "mould on a wall", "score": 0.5, "box": [1.0, 2.0, 3.0, 4.0]}]


def test_many_captures_at_once(spark):
    clouds, ways = [], []
    for name, turn in (("a", 20.0), ("b", 50.0)):
        p, w = room_points(turn)
        clouds.append(pd.DataFrame(p, columns=list("xyz")).assign(capture_id=name))
        ways.append(pd.DataFrame(w, columns=list("xyz")).assign(capture_id=name, ts=np.arange(len(w)) / 10))
    clouds.append(pd.DataFrame({"x": [0.0], "y": [0.0], "z": [0.0], "capture_id": ["c"]}))
    ways.append(pd.DataFrame({"x": [0.0], "y": [0.0], "z": [0.0], "capture_id": ["c"], "ts": [0.0]}))
    got = {r["capture_id"]: r for r in document.extract_plans(spark.createDataFrame(pd.concat(clouds)), spark.createDataFrame(pd.concat(ways))).collect()}
    for name in "ab":
        plan = json.loads(got[name]["plan"])
        assert document.validate(plan) == [] and plan["footprint_area_m2"]["value"] == pytest.approx(12, abs=0.1)
    assert got["c"]["plan"] is None and "too few" in got["c"]["error"]


def test_ply_and_raster(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)], "voxel long, x double, y double, z double")
    assert document.write_ply(str(tmp_path / "p.ply"), rows) == 2
    head, body = (tmp_path / "p.ply").read_bytes().split(b"end_header\n")
    assert b"element vertex 2" in head and np.frombuffer(body, "<f4").tolist() == [4, 5, 6, 1, 2, 3]
    from scanloom.operators import rooms as K

    points, path = room_points()
    scene = K.scene_of(points, path)
    assert png.decode(document.raster_image(scene), 8).shape == scene.raster.shape


def test_command_line(tmp_path, capsys):
    from scanloom.__main__ import main

    for name, turn in (("a", 20.0), ("b", 65.0)):
        document.write_json(str(tmp_path / f"{name}.json"), document.plan_of(name, *room_points(turn)))
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    main(["repeat", a, b])
    main(["calibrate", a, b])
    out = capsys.readouterr().out
    assert "4 of 4 wall pairs" in out and '"kind": "length"' in out
    main(["overlay", a, b, str(tmp_path / "o.svg")])
    assert "polygon" in (tmp_path / "o.svg").read_text()


def test_spaced_rows_keep_the_best():
    rows = pd.DataFrame({"t": [0.0, 5.0, 9.0, 30.0], "score": [1.0, 3.0, 2.0, 1.0]})
    assert sorted(matching.spaced(rows, "t", "score", 6.0)["t"]) == [5.0, 30.0]


def test_streams_equal_tables(spark):
    from scanloom.streaming import chunks

    path = "/root/testdata/sf0.001/events.parquet"
    pytest.importorskip("pyspark")
    import os

    if not os.path.exists(path):
        pytest.skip("no tables")
    want = {tuple(r) for r in chunks.chunked(spark.read.parquet(path)).collect()}
    assert {tuple(r) for r in chunks.run_to_end(spark, path).select("user_id", "start_us", "n", "s_um").collect()} == want
    stream = chunks.stream(spark, path)
    q = stream.writeStream.format("memory").queryName("late_chunks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("SELECT * FROM late_chunks").collect()} <= want


def test_image_rotate():
    image = np.arange(6).reshape(2, 3)
    assert X.image_rotate(image, 0).tolist() == image.tolist()
    assert X.image_rotate(image, 1).tolist() == [[3, 0], [4, 1], [5, 2]]
    assert X.image_rotate(image, 2).tolist() == [[5, 4, 3], [2, 1, 0]]
    assert X.image_rotate(X.image_rotate(image, 1), 3).tolist() == image.tolist()
    assert X.image_rotate(np.zeros((2, 3, 4)), 1).shape == (3, 2, 4)
