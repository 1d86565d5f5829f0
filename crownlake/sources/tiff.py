"""Rasters in TIFF files: one band in strips or tiles, plain, LZW or deflate, with their place on the ground."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import files

#: Struct letters and sizes of TIFF field types.
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, first bit highest, 256 clears, 257 ends."""
    out, table, width, held, bits, before = [], [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def decode(content: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """The band (missing values as NaN) and x0, y0, pixel width, pixel height."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    if struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("no TIFF file")
    (at,) = struct.unpack_from(order + "I", content, 4)
    (n,) = struct.unpack_from(order + "H", content, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
        if kind not in FIELD:
            continue
        size = struct.calcsize(FIELD[kind]) * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", content, place)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    wide, high, bits, form = one(256), one(257), one(258, 8), one(339, 1)
    if one(277, 1) != 1:
        raise ValueError("one band is read")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    unpack = {1: bytes, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress}[one(259, 1)]
    tiled = 324 in tags
    w, h = (one(322), one(323)) if tiled else (wide, one(278, high))
    out = np.zeros((high, wide), float)
    for k, (start, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        across = -(-wide // w)
        r, c = (k // across) * h, (k % across) * w
        rows = h if tiled else min(h, high - r)
        block = np.frombuffer(unpack(content[start : start + size]), dtype, rows * w).reshape(rows, w)
        if one(317, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=dtype)
        out[r : r + rows, c : c + w] = block[: high - r, : wide - c]
    if 42113 in tags:
        text = b"".join(tags[42113]).split(b"\0")[0].decode().strip()
        if text.lower() != "nan":
            out[out == float(text)] = np.nan
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    return out, (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1])


def encode(band: np.ndarray, x0: float, y0: float, res: float) -> bytes:
    """A float32 file with NaN for missing values, deflate-compressed in one strip."""
    data = zlib.compress(band.astype("<f4").tobytes())
    fields = [
        (256, 4, (band.shape[1],)), (257, 4, (band.shape[0],)), (258, 3, (32,)), (259, 3, (8,)), (262, 3, (1,)), (273, 4, (0,)), (277, 3, (1,)), (278, 4, (band.shape[0],)),
        (279, 4, (len(data),)), (339, 3, (3,)), (33550, 12, (res, res, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)), (42113, 2, (b"n", b"a", b"n", b"\0")),
    ]
    more_at = 8 + 2 + 12 * len(fields) + 4
    more, entries = b"", []
    data_at = more_at + sum(s for s in (struct.calcsize("<" + FIELD[k] * len(v)) for _, k, v in fields) if s > 4)
    for tag, kind, values in fields:
        values = (data_at,) if tag == 273 else values
        raw = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, kind, len(values), more_at + len(more)))
            more += raw
        else:
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
    return struct.pack("<2sHIH", b"II", 42, 8, len(fields)) + b"".join(entries) + bytes(4) + more + data


def read(spark: SparkSession, path: str) -> DataFrame:
    """row, col, v, x0, y0, res, file of all .tif files below ``path``; missing pixels have no row."""

    def rows(content: bytes) -> pd.DataFrame:
        band, (x0, y0, res, _) = decode(content)
        r, c = np.nonzero(~np.isnan(band))
        return pd.DataFrame({"row": r.astype("int32"), "col": c.astype("int32"), "v": band[r, c], "x0": x0, "y0": y0, "res": res})

    return files.decoded(spark, path, "*.tif*", rows, "row int, col int, v double, x0 double, y0 double, res double")


def save(raster: DataFrame, path: str, name: str, n_rows: int, n_cols: int, x0: float, y0: float, res: float) -> int:
    """Writes row, col, v as one TIFF file; the raster is the unit of memory."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        band = np.full((n_rows, n_cols), np.nan)
        band[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf["v"].to_numpy(float)
        return pd.DataFrame({"name": [name], "content": [encode(band, x0, y0, res)]})

    return files.save(raster.select("row", "col", "v").groupBy().applyInPandas(whole, "name string, content binary"), path, overwrite=False)
