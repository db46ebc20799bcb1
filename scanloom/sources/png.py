"""Grey PNG images of 8 and 16 bits, to and from numpy. Spark's image source keeps only 8 bits of a sample."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def size(data: bytes) -> tuple[int, int]:
    """Width and height from the header alone."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">II", data[16:24])


def decode(data: bytes, bits: int) -> np.ndarray:
    """Rows of samples; the image must be grey, of so many bits, and not interlaced."""
    width, height = size(data)
    depth, colour, _, _, interlaced = data[24:29]
    if (depth, colour, interlaced) != (bits, 0, 0):
        raise ValueError(f"a grey image of {bits} bits is expected, not depth {depth} and colour type {colour}")
    at, packed = 8, []
    while at < len(data):
        (length,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + length])
        at += length + 12
    unit = bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * unit)
    out = np.zeros((height, width * unit), np.uint8)
    above = np.zeros(width * unit, np.uint8)
    for y in range(height):
        above = out[y] = unfiltered(int(raw[y, 0]), raw[y, 1:], above, unit)
    return out.reshape(height, width, unit).astype(np.uint16) @ np.array([256, 1], np.uint16) if unit == 2 else out


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray, unit: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, unit), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError(f"unknown filter {kind}")
    out, up, values = bytearray(len(row)), above.tolist(), row.tolist()
    for i, v in enumerate(values):
        left = out[i - unit] if i >= unit else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - unit] if i >= unit else 0
            # the neighbour nearest to left + up - corner, in this order
            by = (abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner))
            guess = (left, up[i], corner)[by.index(min(by))]
        out[i] = (v + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def encode(image: np.ndarray) -> bytes:
    """A grey image of uint8 or uint16, or one of three uint8 channels."""
    colour = image.ndim == 3
    raw = image.astype(">u2").view(np.uint8) if image.dtype == np.uint16 else image.astype(np.uint8)
    rows = raw.reshape(image.shape[0], -1)
    body = zlib.compress(np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes())

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    header = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16 if image.dtype == np.uint16 else 8, 2 if colour else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
