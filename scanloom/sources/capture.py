"""Captures on disk as DataFrames: odometry, intrinsics, metadata, depth and confidence images.

A capture is a folder with ``odometry.csv``, ``camera_matrix.csv``, ``depth/000000.png``, ``confidence/000000.png`` and maybe
``meta.json``. Images are read and decoded in parallel, by frame number, and only when a query asks for them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import png

MANDATORY = ["timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw"]
OPTIONAL = ["fx", "fy", "cx", "cy"]
VIDEO_ENDINGS = (".mp4", ".mov", ".m4v")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".heic")
META_SCHEMA = "tier string, rgb_width int, rgb_height int, scale_rel_sigma double, models array<struct<name string, version string>>, runtime_s double, notes array<string>"
META_DEFAULTS = {"tier": "lidar", "rgb_width": 1920, "rgb_height": 1440, "scale_rel_sigma": 0.0}
DETECTIONS_SCHEMA = "model string, threshold double, frames array<int>, detections array<struct<frame int, class string, prompt string, score double, box array<double>>>"


class CaptureError(ValueError):
    """A capture that can't be read."""


def detect_tier(path: str) -> str:
    """``video`` for a video file or a folder around one, ``photo`` for folders of images, else ``lidar``."""
    if os.path.isfile(path):
        return "video" if path.lower().endswith(VIDEO_ENDINGS) else "lidar"
    try:
        capture_dir(path)
    except CaptureError:
        names = os.listdir(path)
        if any(n.lower().endswith(VIDEO_ENDINGS) for n in names):
            return "video"
        folders = [os.path.join(path, n) for n in names if os.path.isdir(os.path.join(path, n))]
        if any(f.lower().endswith(IMAGE_ENDINGS) for d in folders for f in os.listdir(d)):
            return "photo"
    return "lidar"


def capture_dir(path: str) -> str:
    """The folder itself if it's a capture, or the only capture right below it."""
    if os.path.exists(os.path.join(path, "odometry.csv")):
        return path
    below = [os.path.join(path, n) for n in sorted(os.listdir(path))] if os.path.isdir(path) else []
    found = [p for p in below if os.path.exists(os.path.join(p, "odometry.csv"))]
    if len(found) != 1:
        raise CaptureError(f"{path} has {len(found)} captures; one is expected")
    return found[0]


def read_meta(spark: SparkSession, folder: str) -> dict:
    """``meta.json`` over its defaults; it may be missing."""
    try:
        rows = spark.read.schema(META_SCHEMA).json(f"{folder}/meta.json", multiLine=True).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    said = rows[0].asDict(recursive=True) if rows else {}
    return META_DEFAULTS | {k: v for k, v in said.items() if v is not None}


def read_camera_matrix(spark: SparkSession, folder: str) -> tuple[float, float, float, float]:
    """fx, fy, cx, cy of a matrix of exactly three rows and columns."""
    text = spark.read.text(f"{folder}/camera_matrix.csv", wholetext=True).first()
    rows = [[c.strip() for c in line.split(",")] for line in (text[0] if text else "").splitlines() if line.strip()]
    if len(rows) != 3 or any(len(r) != 3 for r in rows):
        raise CaptureError("camera_matrix.csv must have three rows of three numbers")
    m = [[float(c) for c in r] for r in rows]
    return m[0][0], m[1][1], m[0][2], m[1][2]


def read_frames(spark: SparkSession, folder: str, camera: tuple[float, float, float, float], rgb_width: int, depth_width: int, capture_id: str = "capture") -> DataFrame:
    """Odometry by the trimmed names of its header; rows without usable intrinsics take the camera's. Poses as R (row-major) and t.

    A mandatory value that isn't a number fails the query with the row's frame in the message.
    """
    raw = spark.read.csv(f"{folder}/odometry.csv", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    missing = [c for c in MANDATORY if c not in raw.columns]
    if missing:
        raise CaptureError(f"odometry.csv has no column {', '.join(missing)}")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.raise_error(F.concat(F.lit(f"odometry.csv: {c} isn't a number at frame "), F.coalesce("frame", F.lit("?")))).cast("double"))
    given = [F.coalesce(F.when(F.col(c).try_cast("double").isNotNull(), F.col(c).try_cast("double"))) if c in raw.columns else F.lit(None).cast("double") for c in OPTIONAL]
    usable = given[0].isNotNull() & (given[0] > 0) & given[1].isNotNull() & given[2].isNotNull() & given[3].isNotNull()
    fx, fy, cx, cy = (F.when(usable, g).otherwise(F.lit(float(c))) for g, c in zip(given, camera, strict=True))
    sfx, scx = G.rescaled(fx, cx, rgb_width, depth_width)
    sfy, scy = G.rescaled(fy, cy, rgb_width, depth_width)
    r = G.quaternion_matrix(number("qx"), number("qy"), number("qz"), number("qw"))
    return raw.select(
        F.lit(capture_id).alias("capture_id"), number("frame").cast("int").alias("frame"), number("timestamp").alias("ts"),
        F.array(*r).alias("r"), F.array(number("x"), number("y"), number("z")).alias("t"),
        sfx.alias("fx"), sfy.alias("fy"), scx.alias("cx"), scy.alias("cy"),
    )


def frame_number(path: str = "path") -> F.Column:
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("int")


def image_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(f"{folder}/{kind}")
    return files.select(frame_number().alias("frame"), "path", "content")


def read_images(spark: SparkSession, folder: str, kind: str, capture_id: str = "capture") -> DataFrame:
    """``depth`` in millimetres or ``confidence``: ``(capture_id, frame, w, h, pixels)``, pixels little-endian and row by row."""
    bits, name = {"depth": (16, "depth"), "confidence": (8, "conf")}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [png.decode(bytes(c), bits) for c in pdf["content"]]
            yield pd.DataFrame({"frame": pdf["frame"], "w": [i.shape[1] for i in images], "h": [i.shape[0] for i in images], name: [i.astype("<u2" if bits == 16 else "u1").tobytes() for i in images]})

    decoded = image_files(spark, folder, kind).mapInPandas(run, f"frame int, w int, h int, {name} binary")
    return decoded.withColumn("capture_id", F.lit(capture_id))


def load_capture(spark: SparkSession, path: str, capture_id: str = "capture") -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Frames, depth, confidence and metadata. Fails at once if there are no frames or an image is missing; decodes none of them."""
    folder = capture_dir(path)
    meta = read_meta(spark, folder)
    try:
        files = {k: image_files(spark, folder, k).select("frame") for k in ("depth", "confidence")}
        head = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(f"{folder}/depth").select("content").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise CaptureError(f"{folder} has no depth or confidence folder") from e
    if head is None:
        raise CaptureError(f"{folder} has no depth image")
    width, _ = png.size(bytes(head[0]))
    frames = read_frames(spark, folder, read_camera_matrix(spark, folder), meta["rgb_width"], width, capture_id)
    if frames.isEmpty():
        raise CaptureError("odometry.csv has no rows")
    for kind, found in files.items():
        lost = frames.join(found, "frame", "left_anti").orderBy("frame").first()
        if lost is not None:
            raise CaptureError(f"frame {lost['frame']} has no {kind} image")
    return frames, read_images(spark, folder, "depth", capture_id), read_images(spark, folder, "confidence", capture_id), meta


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTIONS_SCHEMA).json(path, multiLine=True).selectExpr("inline(detections)")


def unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    """Depth in metres and confidence of a joined row."""
    shape = (row.h, row.w)
    return np.frombuffer(row.depth, "<u2").reshape(shape) / 1000.0, np.frombuffer(row.conf, np.uint8).reshape(shape)


def stamp(spark: SparkSession, path: str) -> DataFrame:
    """What a result that is kept depends on: path, size and time of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("modified"))


def unchanged(was: DataFrame, now: DataFrame) -> bool:
    return was.exceptAll(now).isEmpty() and now.exceptAll(was).isEmpty()
