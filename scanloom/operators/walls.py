"""Walls of rooms: outlines to lines, lines fitted to the points of their faces, openings in them, ceilings over them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from . import rooms as K
from .rooms import H, V, Gap, Raster, Scene

#: Fixed values.
SNAP, SEARCH_IN, SEARCH_OUT, FACE_BIN, FACE_BINS, FACE_BAND, TRIM = 15.0, 0.15, 0.04, 0.005, 39, 0.015, 0.10
MIN_COVERAGE, COVERAGE_BIN, MIN_EDGE, MIN_WALL, SMALL_FEATURE = 0.30, 0.05, 0.12, 0.25, 0.30
JOG, JOG_MEASURED, JOG_INFERRED, LAYER_SHARE = 0.35, 0.04, 0.10, 0.15
MIN_OPENING, JAMB_BAND, JAMB_SEARCH, ASSIGN, SIDE_REACH, CROSS = 0.50, 0.04, 0.30, 0.20, 0.30, 0.10
PASSAGE_FLOOR, HEADER_SHARE, SILL_SHARE = 0.3, 0.5, 0.5
CEILING_LOW, CEILING_BINS, CEILING_BAND, CEILING_COVER, CEILING_CELL, CEILING_SHARE, LEVEL_GAP, LEVEL_SAME = 1.9, 261, 0.02, 0.20, 0.10, 0.10, 0.1, 0.05


@dataclass
class Wall:
    """A line n . p = c with n outward, and what was seen of it."""

    nx: float
    ny: float
    c: float
    start: np.ndarray
    end: np.ndarray
    support: int = 0
    spread: float = 0.0
    coverage: float = 0.0
    inferred: bool = True

    @property
    def normal(self) -> np.ndarray:
        return np.array((self.nx, self.ny))

    @property
    def along(self) -> np.ndarray:
        return np.array((-self.ny, self.nx))

    @property
    def length(self) -> float:
        return float(np.hypot(*(self.end - self.start)))

    @property
    def axis(self) -> int:
        """H for walls along x, V for walls along y, 0 for oblique ones."""
        return H if abs(self.nx) < 1e-9 else V if abs(self.ny) < 1e-9 else 0


@dataclass
class Room:
    label: int
    walls: list[Wall]
    fallback: bool = False
    ceiling: dict = field(default_factory=dict)

    @property
    def corners(self) -> np.ndarray:
        return np.array([w.start for w in self.walls])


# -- outlines --------------------------------------------------------------------------------------------------------


def without_collinear(p: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """Corners at which the way turns; repeated ones go too."""
    while len(p) >= 3:
        before, after = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
        turn = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
        keep = (turn > least) & (np.abs(before).sum(axis=1) > least)
        if keep.all():
            return p
        p = p[keep]
    return p


def without_small_features(p: np.ndarray, least: float = SMALL_FEATURE) -> np.ndarray:
    """Bumps and niches of a right-angled outline that are less deep or less wide than ``least`` are flattened, the smallest first."""
    p = without_collinear(np.asarray(p, float))
    while len(p) > 4:
        e = np.roll(p, -1, axis=0) - p
        length = np.abs(e).sum(axis=1)
        found = []
        for i in range(len(p)):
            before, after = i - 1, (i + 1) % len(p)
            if e[before] @ e[after] < 0:
                depth = min(length[before], length[after])
                if min(depth, length[i]) < least:
                    found.append((min(depth, length[i]), i, depth))
        if not found:
            return p
        _, i, depth = min(found)
        shift = -e[i - 1] / length[i - 1] * depth
        p = p.copy()
        p[i] += shift
        p[(i + 1) % len(p)] += shift
        p = without_collinear(p)
    return p


def snapped_edges(p: np.ndarray) -> list[Wall]:
    """Each edge as a line with its outward normal; edges near an axis go exactly along it, through their middle."""
    out = []
    for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
        t = np.arctan2(b[1] - a[1], b[0] - a[0])
        axis = np.rint(t / (np.pi / 2)) * (np.pi / 2)
        if abs(t - axis) <= np.radians(SNAP):
            nx, ny = np.rint(np.sin(axis)), -np.rint(np.cos(axis))
        else:
            nx, ny = np.sin(t), -np.cos(t)
        out.append(Wall(float(nx) + 0.0, float(ny) + 0.0, float((nx, ny) @ (a + b) / 2), a.copy(), b.copy()))
    return out


def with_corners(walls: list[Wall]) -> list[Wall] | None:
    """Walls cut at the lines before and after them; None if two neighbours are parallel."""
    out = []
    for i, w in enumerate(walls):
        ends = []
        for u, v in ((walls[i - 1], w), (w, walls[(i + 1) % len(walls)])):
            det = u.nx * v.ny - u.ny * v.nx
            if abs(det) < 1e-9:
                return None
            ends.append(np.array(((u.c * v.ny - u.ny * v.c) / det, (u.nx * v.c - u.c * v.nx) / det)))
        out.append(replace(w, start=ends[0], end=ends[1]))
    return out


def regular(walls: list[Wall]) -> list[Wall] | None:
    """Neighbours on one side that lie within ``MIN_EDGE`` become one line; others get a connector; None if fewer than three are left."""
    out: list[Wall] = []
    for w in walls:
        if out and np.dot(out[-1].normal, w.normal) > 0.99 and abs(out[-1].c - w.c) < MIN_EDGE:
            a, b = out[-1].length, w.length
            out[-1] = replace(out[-1], c=(out[-1].c * a + w.c * b) / max(a + b, 1e-9), end=w.end)
        elif w.length >= MIN_EDGE or not out or abs(np.dot(out[-1].normal, w.normal)) < 0.99:
            out.append(w)
    joined: list[Wall] = []
    for i, w in enumerate(out):
        joined.append(w)
        after = out[(i + 1) % len(out)]
        if len(out) > 1 and abs(np.dot(w.normal, after.normal)) > 0.99:
            middle = w.end
            n = w.along if np.dot(after.start - w.end, w.normal) < 0 else -w.along
            joined.append(Wall(float(n[0]) + 0.0, float(n[1]) + 0.0, float(n @ middle), w.end, after.start))
    return joined if len(joined) >= 3 else None


# -- faces -------------------------------------------------------------------------------------------------------------


def face_points(w: Wall, points: np.ndarray, inside: float = SEARCH_IN, outside: float = SEARCH_OUT) -> tuple[np.ndarray, np.ndarray]:
    """Positions along the wall and offsets outward of the wall points near its face."""
    t = (points[:, :2] - w.start) @ w.along
    s = points[:, :2] @ w.normal - w.c
    near = (t >= TRIM) & (t <= w.length - TRIM) & (s >= -inside) & (s < outside)
    return t[near], s[near]


def fitted(w: Wall, points: np.ndarray) -> Wall:
    """The wall moved to the densest layer of points near it; left where it is, and inferred, if too little of it is covered."""
    t, s = face_points(w, points)
    if w.length < MIN_WALL or not len(t):
        return replace(w, support=0, spread=0.0, coverage=0.0, inferred=True)
    n = np.bincount(np.clip(np.floor((s + SEARCH_IN) / FACE_BIN).astype(np.int64), 0, FACE_BINS - 1), minlength=FACE_BINS)
    k = n.copy()
    k[1:] += n[:-1]
    k[:-1] += n[1:]
    centre = -SEARCH_IN + (int(k.argmax()) + 0.5) * FACE_BIN
    layer = np.abs(s - centre) <= FACE_BAND
    covered = len(np.unique(np.floor(t[layer] / COVERAGE_BIN)))
    coverage = min(1.0, covered / max((w.length - 2 * TRIM) / COVERAGE_BIN, 1.0))
    if coverage < MIN_COVERAGE:
        return replace(w, support=int(layer.sum()), coverage=float(coverage), inferred=True)
    return replace(w, c=w.c + float(s[layer].mean()), support=int(layer.sum()), spread=float(s[layer].std()), coverage=float(coverage), inferred=False)


def layers(w: Wall, points: np.ndarray) -> list[dict]:
    """Layers of points in front of and behind a wall that are at least a share of the densest one: offset, density, coverage."""
    t, s = face_points(w, points, 0.5, 0.5)
    if not len(s):
        return []
    bin_ = np.floor((s + 0.5) / 0.01).astype(np.int64)
    n = np.bincount(bin_, minlength=101).astype(float)
    k = n.copy()
    k[1:] += n[:-1]
    k[:-1] += n[1:]
    before, after = np.concatenate(([0], k[:-1])), np.concatenate((k[1:], [0]))
    top = np.flatnonzero((before <= k) & (after < k) & (k >= LAYER_SHARE * k.max()))
    cells = max(w.length / COVERAGE_BIN, 1.0)
    return [{"offset": -0.5 + (int(i) + 0.5) * 0.01, "density": float(k[i] / k.max()), "coverage": min(1.0, len(np.unique(np.floor(t[np.abs(bin_ - i) <= 1] / COVERAGE_BIN))) / cells)} for i in top]


def without_jogs(walls: list[Wall]) -> list[Wall]:
    """A short connector between two walls on one side goes if their faces nearly agree; the faces are averaged by support."""
    out, i = list(walls), 0
    while len(out) > 4 and i < len(out):
        a, jog, b = out[i - 1], out[i], out[(i + 1) % len(out)]
        limit = JOG_INFERRED if a.inferred or b.inferred else JOG_MEASURED
        if np.dot(a.normal, b.normal) > 0.99 and jog.length <= JOG and abs(a.c - b.c) <= limit:
            wa, wb = (a.support, b.support) if a.support + b.support else (a.length, b.length)
            whole = replace(a, c=(a.c * wa + b.c * wb) / (wa + wb), end=b.end, support=a.support + b.support, inferred=a.inferred and b.inferred)
            at = (i - 1) % len(out)
            out = [whole if k == at else w for k, w in enumerate(out) if k not in (i, (i + 1) % len(out))]
            i = 0
        else:
            i += 1
    return out


def fit_room(outline: np.ndarray, points: np.ndarray, label: int) -> Room | None:
    """A room from its outline; None if no closed polygon of at least three walls comes of it."""
    p = without_small_features(outline)
    if len(p) < 3:
        return None
    walls = regular(snapped_edges(p))
    for step in (lambda w: [fitted(x, points) for x in w], without_jogs, lambda w: [fitted(x, points) for x in w]):
        walls = with_corners(walls) if walls is not None else None
        if walls is None:
            return None
        walls = step(walls)
    walls = with_corners(walls)
    return Room(label, walls) if walls and K.polygon_area(np.array([w.start for w in walls])) > 0 else None


def rectangle(label: int, x0: float, y0: float, x1: float, y1: float) -> Room:
    p = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    return Room(label, snapped_edges(p), fallback=True)


def fallback_room(label: int, cells: np.ndarray, floor_cells: np.ndarray, raster: Raster) -> Room | None:
    """The extent of a region's floor without its outer twentieths; None if that is under a square metre."""
    taken = floor_cells if len(floor_cells) >= 50 else cells
    if not len(taken):
        return None
    xy = (taken + 0.5) * raster.res + (raster.x0, raster.y0)
    s = np.sort(xy, axis=0)
    low, high = (s[int(p * (len(s) - 1))] for p in (0.05, 0.95))
    return rectangle(label, *low, *high) if np.prod(high - low) >= 1.0 else None


def bounds(r: Room) -> tuple[float, float, float, float]:
    c = r.corners
    return (*c.min(axis=0), *c.max(axis=0))


def separate_fallbacks(rooms: list[Room]) -> list[Room]:
    """Rectangles that overlap share the middle of the overlap's shorter side as a wall, pair by pair in order."""
    out = list(rooms)
    for i in range(len(out)):
        for j in range(i + 1, len(out)):
            if not (out[i].fallback and out[j].fallback):
                continue
            a, b = list(bounds(out[i])), list(bounds(out[j]))
            wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if wide <= 0 or high <= 0:
                continue
            k = 0 if wide <= high else 1
            middle = (max(a[k], b[k]) + min(a[k + 2], b[k + 2])) / 2
            first, second = (a, b) if a[k] <= b[k] else (b, a)
            first[k + 2] = second[k] = middle
            out[i], out[j] = rectangle(out[i].label, *a), rectangle(out[j].label, *b)
    return out


# -- openings ----------------------------------------------------------------------------------------------------------


@dataclass
class Opening:
    room: int
    wall: int
    kind: str
    offset: float
    width: float
    sides: tuple[int, ...]
    crossed: bool
    jambs: bool
    height: float | None = None


def side_labels(gap: Gap, raster: Raster, label: np.ndarray) -> tuple[int, ...]:
    """Rooms found a little to either side of a gap."""
    reach = int(SIDE_REACH / raster.res)
    grid = label if gap.axis == H else label.T
    rows = [r for r in (gap.c0 - reach, gap.c1 - 1 + reach) if 0 <= r < grid.shape[0]]
    return tuple(sorted({int(x) for r in rows for x in np.unique(grid[r, gap.a0 : gap.a1])} - {0}))


def crosses(path: np.ndarray, w: Wall, a: float, b: float) -> bool:
    """Whether two consecutive places of a way lie on different sides of a wall while in a strip along [a, b] of it."""
    s = path @ w.normal - w.c
    t = (path - w.start) @ w.along
    near = (t >= a - CROSS) & (t <= b + CROSS) & (np.abs(s) <= 4 * CROSS)
    side, last = np.sign(s), 0.0
    for ok, x in zip(near, side, strict=True):
        if not ok:
            last = 0.0
        elif x:
            if last == -x:
                return True
            last = x
    return False


def jambs(w: Wall, points: np.ndarray, a: float, b: float) -> tuple[float, float] | None:
    """The ends of the wall's points on either side of an opening."""
    t = (points[:, :2] - w.start) @ w.along
    near = t[np.abs(points[:, :2] @ w.normal - w.c) <= JAMB_BAND]
    middle = (a + b) / 2
    left = near[(near < middle) & (near >= a - JAMB_SEARCH) & (near <= a + JAMB_SEARCH)]
    right = near[(near >= middle) & (near >= b - JAMB_SEARCH) & (near <= b + JAMB_SEARCH)]
    if len(left) and len(right) and right.min() - left.max() >= 0.4:
        return float(left.max()), float(right.min())
    return None


def kind_of(gap: Gap, crossed: bool, sides: int) -> str:
    passage = crossed or gap.floor >= PASSAGE_FLOOR
    if gap.sill >= SILL_SHARE and not crossed and sides < 2:
        return "window"
    if passage or sides == 2 and gap.sill < SILL_SHARE:
        return "door" if gap.header >= HEADER_SHARE else "opening"
    return "unobserved"


def assign_openings(scene: Scene, rooms: list[Room]) -> list[Opening]:
    """Each gap that is wide enough goes to the nearest wall of a room beside it that runs the same way."""
    raster, found = scene.raster, []
    band = scene.points[(scene.points[:, 2] >= K.WALL_LOW) & (scene.points[:, 2] <= K.WALL_HIGH)]
    for g in scene.gaps:
        if (g.a1 - g.a0) * raster.res < MIN_OPENING:
            continue
        sides = side_labels(g, raster, scene.label)
        along = (np.array([g.a0, g.a1]) * raster.res) + (raster.x0 if g.axis == H else raster.y0)
        across = (g.c0 + g.c1) / 2 * raster.res + (raster.y0 if g.axis == H else raster.x0)
        ends = np.column_stack((along, [across] * 2)) if g.axis == H else np.column_stack(([across] * 2, along))
        best, least = None, ASSIGN
        for r in rooms:
            if r.label not in sides:
                continue
            for i, w in enumerate(r.walls):
                t = float((ends.mean(axis=0) - w.start) @ w.along)
                d = abs(float(ends.mean(axis=0) @ w.normal) - w.c)
                if w.axis == g.axis and 0 <= t <= w.length and d < least:
                    best, least = (r, i, w), d
        if best is None:
            continue
        room, i, w = best
        a, b = sorted(((ends - w.start) @ w.along).tolist())
        exact = jambs(w, band, a, b)
        if exact is not None:
            a, b = exact
        if b - a < MIN_OPENING:
            continue
        crossed = crosses(scene.path, w, a, b)
        kind = kind_of(g, crossed, len(sides))
        found.append(Opening(room.label, i, kind, a, b - a, sides, crossed, exact is not None, 2.05 if kind == "door" else None))
    return without_overlaps(found)


def without_overlaps(found: list[Opening]) -> list[Opening]:
    """Openings of a wall that overlap the last one kept become one: the one with jambs, else the wider; crossed if either is."""
    out: list[Opening] = []
    for o in sorted(found, key=lambda o: (o.room, o.wall, o.offset)):
        last = out[-1] if out else None
        if last is not None and (last.room, last.wall) == (o.room, o.wall) and o.offset < last.offset + last.width:
            better = o if (o.jambs, o.width) > (last.jambs, last.width) else last
            out[-1] = replace(better, crossed=o.crossed or last.crossed)
        else:
            out.append(o)
    return out


def open_boundaries(scene: Scene, rooms: list[Room]) -> list[Opening]:
    """Where two rooms' cells meet without a wall: an opening in the nearest wall of the first."""
    by_label = {r.label: r for r in rooms}
    met: dict[tuple[int, int], list[tuple[float, float]]] = {}
    label, raster = scene.label, scene.raster
    for dx, dy in ((1, 0), (0, 1)):
        other = K.shifted(label, dx, dy)
        for y, x in np.argwhere((label > 0) & (other > 0) & (label != other)):
            pair = tuple(sorted((int(label[y, x]), int(other[y, x]))))
            met.setdefault(pair, []).append((raster.x0 + (x + 0.5 + dx / 2) * raster.res, raster.y0 + (y + 0.5 + dy / 2) * raster.res))
    out = []
    for (a, b), places in met.items():
        if a not in by_label or b not in by_label:
            continue
        p = np.array(places)
        best, least = None, np.inf
        for r in (by_label[a], by_label[b]):
            for i, w in enumerate(r.walls):
                t = (p - w.start) @ w.along
                d = float(np.abs(p @ w.normal - w.c).mean())
                if -0.1 * w.length <= t.mean() <= 1.1 * w.length and d < least:
                    best, least = (r, i, w, t), d
        if best is None:
            continue
        r, i, w, t = best
        low, high = max(0.0, float(t.min())), min(w.length, float(t.max()))
        if high - low >= MIN_OPENING:
            out.append(Opening(r.label, i, "opening", low, high - low, (a, b), crosses(scene.path, w, low, high), False))
    return out


# -- ceilings ----------------------------------------------------------------------------------------------------------


def estimate_ceiling(room: Room, points: np.ndarray, area: float) -> dict:
    """The level over a room that covers most of it, of the strong ones; other levels well apart from it."""
    inside = points[K.contains(room.corners, points[:, :2])]
    up = inside[(inside[:, 2] >= CEILING_LOW) & (inside[:, 2] < CEILING_LOW + CEILING_BINS * 0.01)]
    if not len(up):
        return {"observed": False, "reason": "no points above"}
    n = np.bincount(np.floor((up[:, 2] - CEILING_LOW) / 0.01).astype(np.int64), minlength=CEILING_BINS)
    s = n.copy()
    s[1:] += n[:-1]
    s[:-1] += n[1:]
    before, after = np.concatenate(([0], s[:-1])), np.concatenate((s[1:], [0]))
    levels = []
    for i in np.flatnonzero((before <= s) & (after < s) & (s >= CEILING_SHARE * s.max())):
        height = CEILING_LOW + (int(i) + 0.5) * 0.01
        near = up[np.abs(up[:, 2] - height) <= CEILING_BAND]
        cells = len(np.unique(np.floor(near[:, :2] / CEILING_CELL).astype(np.int64), axis=0))
        levels.append((cells * CEILING_CELL**2 / max(area, 1e-9), height, near))
    cover, height, near = max(levels, key=lambda x: x[0])
    if cover < CEILING_COVER:
        return {"observed": False, "reason": "too little of it was seen"}
    others: list[float] = []
    for _, h, _ in levels:
        if abs(h - height) > LEVEL_GAP and all(abs(h - o) > LEVEL_SAME for o in others):
            others.append(h)
    return {"observed": True, "height": float(near[:, 2].mean()), "spread": float(near[:, 2].std()), "support": len(near), "coverage": float(min(cover, 1.0)), "others": others}


def rooms_of(scene: Scene) -> list[Room]:
    """Rooms of a scene with walls and ceilings; regions without a closed outline get a rectangle, or go if that is too small."""
    raster = scene.raster
    label = K.clean_labels(scene.label, raster.res)
    arrangement = K.build_arrangement(raster, scene.flags, label)
    band = scene.points[(scene.points[:, 2] >= K.WALL_LOW) & (scene.points[:, 2] <= K.WALL_HIGH)]
    found = []
    for i in range(1, int(scene.label.max(initial=0)) + 1):
        outline = arrangement.outline(i)
        room = fit_room(outline, band, i) if outline is not None else None
        if room is None:
            cells = np.argwhere(scene.label == i)[:, ::-1]
            on_floor = np.argwhere((scene.label == i) & (raster.floor > 0))[:, ::-1]
            room = fallback_room(i, cells, on_floor, raster)
        if room is not None:
            found.append(room)
    found = separate_fallbacks(found)
    for r in found:
        r.ceiling = estimate_ceiling(r, scene.points, K.polygon_area(r.corners))
    return found
