"""Numpy kernels against brute force and shapes with known results."""

import numpy as np
import pytest
from synthetic import room_points

from scanloom.operators import cloud, compare, drift
from scanloom.operators import rooms as K
from scanloom.operators import walls as W
from scanloom.plans import document
from scanloom.sources import png


def test_distances_equal_brute_force():
    mask = np.random.default_rng(2).random((17, 23)) < 0.8
    outside = np.argwhere(~np.pad(mask, 1)) - 1
    want = np.zeros(mask.shape)
    for y, x in np.argwhere(mask):
        want[y, x] = ((outside - (y, x)) ** 2).sum(axis=1).min()
    assert np.abs(K.squared_distances(mask) - want).max() < 1e-9


def test_components_equal_flood_fill():
    mask = np.random.default_rng(5).random((30, 40)) < 0.55
    label, n = K.components(mask)
    assert ((label > 0) == mask).all()
    for i in range(1, n + 1):
        seed = tuple(np.argwhere(label == i)[0])
        assert (K.flood(mask, seed) == (label == i)).all()


def test_outline_of_an_l():
    grid = np.zeros((6, 6), bool)
    grid[1:3, 1:5] = grid[3:5, 1:3] = True
    corners = K.trace_outline(grid)
    assert corners == [(1, 1), (5, 1), (5, 3), (3, 3), (3, 5), (1, 5)]
    assert K.polygon_area(np.array(corners, float)) == 12


def test_small_features_go_and_a_real_alcove_stays():
    p = [(0, 0), (2, 0), (2, -0.5), (3, -0.5), (3, 0), (4, 0), (4, 1), (4.2, 1), (4.2, 2.5), (4, 2.5), (4, 3), (1.5, 3), (1.5, 3.15), (1, 3.15), (1, 3), (0, 3)]
    q = W.without_small_features(np.array(p, float))
    assert len(q) == 8 and K.polygon_area(q) == pytest.approx(12.5)


def test_rectangles_that_overlap_share_a_wall():
    a, b = W.separate_fallbacks([W.rectangle(1, 0, 0, 3, 4), W.rectangle(2, 2, 1, 5, 3)])
    assert W.bounds(a)[2] == 2.5 == W.bounds(b)[0]


def test_tilted_floor():
    rng = np.random.default_rng(1)
    x, z = rng.uniform(0, 6, 20_000), rng.uniform(0, 5, 20_000)
    floor = np.column_stack((x, 0.004 * x - 0.002 * z - 1.45 + rng.normal(0, 0.003, 20_000), z))
    clutter = np.column_stack((rng.uniform(0, 6, 8000), rng.uniform(-1.15, 0.85, 8000), rng.uniform(0, 5, 8000)))
    f = K.estimate_floor(np.concatenate((floor, clutter)))
    assert np.allclose(f["plane"][:2], (0.004, -0.002), atol=2e-4) and abs(f["plane"][2] + 1.45) < 2e-3 and f["residual"] <= 0.005


def test_too_few_points_is_an_error():
    with pytest.raises(K.ExtractionError):
        K.scene_of(np.zeros((10, 3)), np.zeros((1, 3)))


def test_synthetic_room_end_to_end():
    points, path = room_points()
    scene = K.scene_of(points, path)
    assert abs(np.degrees(scene.theta) - 20) < 0.05
    rooms = W.rooms_of(scene)
    assert len(rooms) == 1 and not any(w.inferred for w in rooms[0].walls)
    assert sorted(round(w.length, 2) for w in rooms[0].walls) == pytest.approx([3, 3, 4, 4], abs=0.011)
    assert K.polygon_area(rooms[0].corners) == pytest.approx(12, abs=0.08)
    openings = W.assign_openings(scene, rooms)
    assert [(o.kind, o.crossed) for o in openings] == [("door", True)]
    assert openings[0].width == pytest.approx(0.9, abs=0.025)  # points are two centimetres apart
    plan = document.plan_of("c", points, path)
    assert document.validate(plan) == []
    assert "door" in str(plan["rooms"][0]["openings"]) and "<svg" in document.draw_svg(plan)


def test_two_scans_of_a_room_agree():
    a, b = (document.plan_of(n, *room_points(turn)) for n, turn in (("a", 20.0), ("b", 65.0)))
    c = compare.compare(a, b)
    assert c.overlap > 0.97 and c.summary()["pairs"] == 4 and c.summary()["pass"] == 4
    assert "| R1 | R1 |" in compare.markdown(c, "a", "b")
    pairs = compare.calibration_pairs(a, b)
    assert list(pairs["kind"]) == ["length"] * 4 + ["area"]


def test_tau_of_known_pairs():
    import pandas as pd

    need = np.arange(1, 11) / 10
    pairs = pd.DataFrame({"difference": need * np.sqrt(2) * document.Z90, "sigma_a": 0.0, "sigma_b": 0.0})
    value, covered = compare.tau(pairs)
    assert value == pytest.approx(0.9) and covered == pytest.approx(0.9)


def test_flat_floor_back_projection():
    depth = np.full((6, 8), 1.5)
    r = np.array([[1, 0, 0], [0, 0, -1], [0, 1, 0]])
    p = cloud.back_project(depth, np.full((6, 8), 2), (5, 5, 3.5, 2.5), r, (0, 1.5, 0))
    assert len(p) == 48 and np.abs(p[:, 1]).max() < 1e-9
    u = np.tile(np.arange(8), 6)
    assert np.allclose(p[:, 0], (u - 3.5) * 1.5 / 5)


def test_back_projection_filters():
    depth = np.array([[1.0, 0.0, 9.0]])
    args = ((5, 5, 1, 0), np.eye(3), (0, 0, 0))
    assert len(cloud.back_project(depth, np.array([[2, 2, 2]]), *args)) == 1
    assert len(cloud.back_project(depth, np.array([[1, 2, 2]]), *args)) == 0


def test_voxels_floor_negative_values():
    key, n, sums = cloud.voxel_rows(np.array([[-0.001, 0.0, 0.02], [-0.02, 0.019, 0.021], [-0.021, 0, 0]]), 0.02)
    assert list(n) == [1, 2] and sums[1, 0] == -21_000


def test_correction_moves_plan_points_as_the_model_says():
    theta, q = 0.7, np.array([0.3, -0.5, 0.1, 0.8])
    x, y, z, w = q / np.linalg.norm(q)
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    t = np.array([1.2, 0.3, -2.5])
    pivot, d, yaw, dh = np.array([0.4, -1.1]), np.array([0.05, -0.03]), 0.02, 0.01
    c = drift.Correction(np.array([10.0]), pivot[None], np.array([[*d, yaw, dh]]), 1.0, 0.0, 0.0, {})
    r2, t2 = drift.corrected(r[None], t[None], np.array([10.0]), theta, c)
    camera = np.array([[0, 0, 2], [0.5, -0.3, 1.5], [-1, 0.4, 3]])
    before, after = camera @ r.T + t, camera @ r2[0].T + t2[0]
    turn = np.array([[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]])
    want = (K.plan_xy(before, theta) - pivot) @ turn.T + pivot + d
    assert np.allclose(K.plan_xy(after, theta), want, atol=1e-9) and np.allclose(after[:, 1], before[:, 1] + dh)


def test_injected_drift_is_found():
    import pandas as pd

    marks = [drift.Landmark(0, 1, 0, 4, (4, 0), 3), drift.Landmark(0, -1, 0, 0, (0, 3), 3), drift.Landmark(0, 0, 1, 3, (4, 3), 4), drift.Landmark(0, 0, -1, 0, (0, 0), 4)]
    truth = np.array([[0, 0, 0, 0], [0.02, -0.01, 0.002, 0.004], [0.04, -0.02, 0.004, 0.008], [0.03, -0.03, 0.001, 0.002]])
    pivot, rows = np.array([[2.0, 1.5]] * 4), []
    rng = np.random.default_rng(3)
    for j, (dx, dy, yaw, dh) in enumerate(truth):
        for i, m in enumerate(marks):
            for seg in range(8):
                p = np.array(m.start) + rng.uniform(0.5, m.length - 0.5) * np.array((-m.ny, m.nx))
                g = p - pivot[j]
                s = -(m.nx * dx + m.ny * dy + yaw * (m.ny * g[0] - m.nx * g[1]))
                rows.append((i, j, 8 * j + seg, 200, round(s * 200e6), round(p[0] * 200e6), round(p[1] * 200e6)))
        rows.append((drift.FLOOR, j, 0, 200, round(-dh * 200e6), 0, 0))
    obs = pd.DataFrame(rows, columns=["landmark", "chunk", "segment", "n", "s", "px", "py"])
    way = pd.DataFrame({"chunk": range(4), "x": pivot[:, 0], "y": pivot[:, 1]})
    c = drift.estimate(obs, way, marks, 0.0)
    assert c.scale > 0 and c.after < c.before / 3
    assert np.abs(c.move - truth)[:, :2].max() < 0.006 and np.abs(c.move - truth)[:, 2].max() < 0.003


def test_umeyama_recovers_a_similarity():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(50, 3))
    r, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    r *= np.sign(np.linalg.det(r))
    s, q, t = compare.umeyama(a, 1.7 * a @ r.T + (1, 2, 3))
    assert s == pytest.approx(1.7) and np.allclose(q, r) and np.allclose(t, (1, 2, 3))


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("kind", range(5))
def test_png_filters_round_trip(bits, kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 2**bits, (7, 9)).astype(np.uint16 if bits == 16 else np.uint8)
    assert (png.decode(png.encode(image), bits) == image).all()
    unit = bits // 8
    row, above = (rng.integers(0, 256, 9 * unit).astype(np.uint8) for _ in range(2))
    out = png.unfiltered(kind, row, above, unit).astype(int)
    left = np.concatenate((np.zeros(unit, int), out[:-unit]))
    corner = np.concatenate((np.zeros(unit, int), above[:-unit].astype(int)))
    up = above.astype(int)
    p = left + up - corner
    pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
    guess = [0 * up, left, up, (left + up) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))][kind]
    assert ((out - guess) % 256 == row).all()


def test_wrong_depth_is_refused():
    with pytest.raises(ValueError):
        png.decode(png.encode(np.zeros((2, 2), np.uint8)), 16)


def mutations():
    def drop_ci(p):
        del p["footprint_area_m2"]["ci90"]

    def unseen_with_value(p):
        p["rooms"][0]["ceiling_height_m"] = {"observed": False, "value": 2.4, "reason": "x"}

    def seen_without_ci(p):
        p["rooms"][0]["ceiling_height_m"] = {"observed": True, "value": 2.4}

    def tier(p):
        p["tier"] = "drone"

    def damage_class(p):
        p["damage"][0]["class"] = "scratch"

    def rule(p):
        p["concealed_flags"][0]["rule_id"] = "wet ceiling"

    return [drop_ci, unseen_with_value, seen_without_ci, tier, damage_class, rule]


def damaged_plan():
    from scanloom.operators import damage

    plan = document.plan_of("c", *room_points())
    found = [{"region": 0, "class": "mould", "room": 0, "wall": 1, "u0": 1.0, "u1": 1.3, "v0": 0.1, "v1": 0.4, "score": 0.6, "views": 2}, {"region": 1, "class": "crack", "room": 0, "wall": 2, "u0": 1.0, "u1": 1.05, "v0": 1.0, "v1": 1.7, "score": 0.5, "views": 3}, {"region": 2, "class": "hole", "room": 0, "wall": -2, "u0": 1.0, "u1": 1.2, "v0": 1.0, "v1": 1.2, "score": 0.4, "views": 2}]
    return damage.add_damage(plan, found, [{"region": 0, "rule_id": "R-WALL-BASE-01", "message": "damp"}])


def test_damage_output_validates():
    plan = damaged_plan()
    assert document.validate(plan) == []
    assert len(plan["damage"]) == 3 == len(plan["scope"]) and len(plan["concealed_flags"]) == 1
    crack = next(s for s, d in zip(plan["scope"], plan["damage"]) if d["class"] == "crack")
    assert crack["unit"] == "m" and crack["quantity"]["value"] >= 0.6
    svg = document.draw_svg(plan)
    assert all(x in svg for x in ("D1", "mould", "crack", "hole", "R-WALL-BASE-01"))
    low, high = plan["footprint_area_m2"]["ci90"]
    assert f"{plan['footprint_area_m2']['value']:.1f} m² [{low:.1f}, {high:.1f}]" in svg and "ceiling not observed" in svg
    near, far = plan["rooms"][0]["walls"][0]["length_m"]["ci90"]
    assert f"±{(far - near) * 50:.0f} cm" in svg and "(ceiling)" in svg
    assert f"door {plan['rooms'][0]['openings'][0]['width_m']['value']:.2f}" in svg
    assert 'r="6.0"' in svg and f'r="{plan["damage"][0]["width_m"]["value"] * 50:.1f}"' in svg
    plan["rooms"][0]["ceiling_height_m"] = {"observed": True, "value": 2.5, "ci90": [2.4, 2.6], "source": "measured"}
    plan["capture_id"] = "a<b"
    svg = document.draw_svg(plan)
    assert "ceiling 2.50 m" in svg and "a&lt;b, lidar" in svg


def test_simplified_outline():
    square = np.array([(0, 0), (1, 0.01), (2, 0), (2, 2), (1, 1.98), (0, 2)], float)
    assert K.simplified(square, 0.05).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]]
    assert K.simplified(square, 0.0).tolist() == square.tolist()
    assert K.simplified(square[:3], 9.0).tolist() == square[:3].tolist()
    assert K.simplified(np.zeros((0, 2)), 1.0).shape == (0, 2)
    same = np.zeros((5, 2))
    assert K.simplified(same, 0.1).tolist() == [[0, 0]]
    around = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    circle = np.stack([np.cos(around), np.sin(around)], axis=1)
    rest = K.simplified(circle, 0.01)
    ends = np.roll(rest, -1, axis=0) - rest
    gap = [min(np.hypot(*(p - a - np.clip((p - a) @ d / (d @ d), 0, 1) * d)) for a, d in zip(rest, ends, strict=True)) for p in circle]
    assert 4 < len(rest) < 60 and max(gap) <= 0.01 + 1e-12


@pytest.mark.parametrize("change", mutations(), ids=lambda f: f.__name__)
def test_invalid_plans_are_refused(change):
    plan = damaged_plan()
    change(plan)
    assert document.validate(plan)
