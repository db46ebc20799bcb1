"""Inputs for tests, made with numpy."""

from __future__ import annotations

import numpy as np


def room_points(turn: float = 20.0, floor: float = -1.4) -> tuple[np.ndarray, np.ndarray]:
    """A 4 x 3 m room turned by degrees, with a door 0.9 m wide at 1.0 m along the first wall, and the camera's way through it."""
    rng = np.random.default_rng(7)
    parts = []

    def add(x, y, h):
        parts.append(np.column_stack((x, y, np.broadcast_to(h, x.shape))))

    gx, gy = (a.ravel() for a in np.meshgrid(np.arange(0.01, 4, 0.02), np.arange(0.01, 3, 0.02)))
    add(gx, gy, 0.0)
    gx, gy = (a.ravel() for a in np.meshgrid(np.arange(0.9, 2.0, 0.02), np.arange(-0.8, 0.0, 0.02)))
    add(gx, gy, 0.0)
    for (ax, ay), (bx, by), door in (((0, 0), (4, 0), True), ((4, 0), (4, 3), False), ((4, 3), (0, 3), False), ((0, 3), (0, 0), False)):
        length = np.hypot(bx - ax, by - ay)
        t, z = (a.ravel() for a in np.meshgrid(np.arange(0.01, length, 0.02), np.arange(0.01, 2.5, 0.02)))
        if door:
            open_ = (t >= 1.0) & (t < 1.9) & (z < 2.05)
            t, z = t[~open_], z[~open_]
        add(ax + (bx - ax) * t / length, ay + (by - ay) * t / length, z)
    p = np.concatenate(parts)
    p = p + rng.normal(0, 0.001, p.shape)
    inside = np.linspace((0.5, 0.5), (3.5, 2.5), 200)
    out = np.linspace((1.45, 1.0), (1.45, -0.6), 50)
    way = np.concatenate((inside, out))
    p[:, :2] += (1.2345, 0.7772)
    way = way + (1.2345, 0.7772)
    a = np.radians(turn)

    def world(xy, h):
        x, y = np.cos(a) * xy[:, 0] - np.sin(a) * xy[:, 1], np.sin(a) * xy[:, 0] + np.cos(a) * xy[:, 1]
        return np.column_stack((x, h + floor, -y))

    return world(p[:, :2], p[:, 2]), world(way, np.full(len(way), 1.4))
