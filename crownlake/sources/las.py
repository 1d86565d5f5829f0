"""LAS point clouds (versions 1.0 to 1.4, uncompressed)."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import files
from .ply import POINTS

#: Where the colours begin in the point formats that have them.
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


def decode(content: bytes) -> pd.DataFrame:
    """x, y, z by scale and offset, colours from 0 to 1 (null in formats without them)."""
    if content[:4] != b"LASF":
        raise ValueError("no LAS file")
    minor = content[25]
    start, (kind, size) = struct.unpack_from("<I", content, 96)[0], struct.unpack_from("<BH", content, 104)
    (count,) = struct.unpack_from("<I", content, 107)
    if minor >= 4 and not count:
        (count,) = struct.unpack_from("<Q", content, 247)
    if kind & 0xC0:
        raise ValueError("compressed points are not read")
    scale, offset = struct.unpack_from("<3d", content, 131), struct.unpack_from("<3d", content, 155)
    raw = np.frombuffer(content, np.uint8, count * size, start).reshape(count, size)
    place = np.ascontiguousarray(raw[:, :12]).view("<i4")
    out = pd.DataFrame({a: place[:, k] * scale[k] + offset[k] for k, a in enumerate("xyz")})
    if kind in COLOUR_AT:
        rgb = np.ascontiguousarray(raw[:, COLOUR_AT[kind] : COLOUR_AT[kind] + 6]).view("<u2") / 65535.0
        return out.assign(r=rgb[:, 0], g=rgb[:, 1], b=rgb[:, 2])
    return out.assign(r=None, g=None, b=None)


def encode(points: pd.DataFrame, scale: float = 0.001) -> bytes:
    """Version 1.2, point format 2."""
    n = len(points)
    low = [float(points[a].min()) if n else 0.0 for a in "xyz"]
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, 2, 26, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *low)
    rows = np.zeros(n, np.dtype([("p", "<i4", 3), ("rest", "u1", 8), ("c", "<u2", 3)]))
    for k, a in enumerate("xyz"):
        rows["p"][:, k] = np.round((points[a].to_numpy(float) - low[k]) / scale)
    for k, a in enumerate("rgb"):
        rows["c"][:, k] = np.clip(np.round(points[a].fillna(0).to_numpy(float) * 65535), 0, 65535)
    return bytes(head) + rows.tobytes()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Points of all .las files below ``path``, as one cloud."""
    return files.decoded(spark, path, "*.las", decode, POINTS)
